"""A paged search as a Python data source: one partition for each (query, page), so pages are fetched by many tasks and a lost one is fetched again.

`client(options)` gives the function that fetches a page; the one here reads recorded responses from a shared folder, so no
network is needed. Pages without a response or without hits give no rows, and a gap among pages hides none behind it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

HIT = "page_id long, url string"
#: Hits of a page.
PER_PAGE = 100


def record(hits: DataFrame, folder: str, per_page: int = PER_PAGE) -> None:
    """Write responses of a search: hits (query, page_id, url) by query and page, a line of JSON for each hit.

    A page is a range of per_page ids, so a page has at most per_page distinct hits of a query, and no row needs its rank among a
    query's hits. Rows with a null query or page_id, and negative ids, are no hits. Queries stand in hex in the folders' names.
    """
    rows = hits.filter("query IS NOT NULL AND page_id >= 0").select(F.hex("query").alias("q"), F.expr(f"page_id div {int(per_page)}").alias("page"), F.to_json(F.struct("page_id", "url")).alias("value"))
    # A page's rows are written by one task, to one file.
    rows.repartition("q", "page").write.partitionBy("q", "page").text(folder)


def recorded(folder: str) -> Callable[[str, int], Iterator[dict]]:
    """fetch(query, page) over recorded responses."""
    uri = folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder
    files, root = pyarrow.fs.FileSystem.from_uri(uri)

    def fetch(query: str, page: int) -> Iterator[dict]:
        at = pyarrow.fs.FileSelector(f"{root}/q={query.encode().hex().upper()}/page={page}", allow_not_found=True)
        for info in sorted(files.get_file_info(at), key=lambda f: f.path):
            if info.base_name.startswith("part-"):
                with files.open_input_stream(info.path) as f:
                    for line in f.read().decode().split("\n"):
                        if line:
                            yield json.loads(line)

    return fetch


@dataclass
class Page(InputPartition):
    query: str
    page: int


class SearchReader(DataSourceReader):
    def __init__(self, options: dict):
        # Keys of options are in lower case.
        self.folder, self.queries = options["folder"], json.loads(options["queries"])
        self.pages, self.after = int(options["pages"]), json.loads(options.get("after", "{}"))

    def partitions(self) -> list[InputPartition]:
        return [Page(q, p) for q in self.queries for p in range(self.after.get(q, -1) + 1, self.pages)]

    def read(self, partition: Page | None) -> Iterator[tuple]:
        if partition is None:  # What a source without partitions gets.
            return
        for hit in recorded(self.folder)(partition.query, partition.page):
            yield partition.query, partition.page, hit.get("page_id"), hit.get("url")


class SearchSource(DataSource):
    """Options: folder, queries (JSON list), pages (how many a query has at most), after (JSON object: the last page of a query that was read before)."""

    @classmethod
    def name(cls) -> str:
        return "paged_search"

    def schema(self) -> str:
        return f"query string, page int, {HIT}"

    def reader(self, schema: StructType) -> DataSourceReader:
        return SearchReader(self.options)


def search(spark: SparkSession, folder: str, queries: list[str], pages: int, after: dict[str, int] | None = None) -> DataFrame:
    """query, page, page_id, url of all hits; with `after`, of the pages behind those read before."""
    spark.dataSource.register(SearchSource)
    options = {"folder": folder, "queries": json.dumps(queries), "pages": str(pages), "after": json.dumps(after or {})}
    return spark.read.format(SearchSource.name()).options(**options).load()


def offsets(found: DataFrame) -> DataFrame:
    """query, page: the last page with a hit, one row a query; what `after` takes."""
    return found.groupBy("query").agg(F.max("page").alias("page"))


def by_url(found: DataFrame) -> DataFrame:
    """One row for each url (null urls none): page_id, the smallest with it, and in how many queries it was found."""
    each = found.filter(F.col("url").isNotNull()).groupBy("url", "query").agg(F.min("page_id").alias("page_id"))
    return each.groupBy("url").agg(F.min("page_id").alias("page_id"), F.count("*").alias("queries"))
