"""Scans: JSON lines, CSV, manifests, nested documents; schemas are explicit and fields may be missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"
MESSAGE = T.StructType([T.StructField(c, T.StringType()) for c in ("role", "channel", "content")])
RECORD = T.StructType(
    [
        *[T.StructField(c, T.StringType()) for c in ("id", "source", "license", "content", "cfg")],
        T.StructField("result", T.StructType([T.StructField("tier", T.StringType()), T.StructField("parse_errors", T.ArrayType(T.StringType())), T.StructField("check_errors", T.ArrayType(T.StringType())), T.StructField("output", T.StringType()), T.StructField("runtime_seconds", T.DoubleType())])),
        T.StructField("annotation", T.StructType([T.StructField("description", T.StringType()), T.StructField("domain", T.StringType()), T.StructField("difficulty", T.IntegerType()), T.StructField("key_invariants", T.ArrayType(T.StringType()))])),
        T.StructField("messages", T.MapType(T.StringType(), T.ArrayType(MESSAGE))),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)


def json_lines(spark: SparkSession, path, schema: T.StructType | str, bad: str = "fail") -> DataFrame:
    """bad: fail (the read is an error), drop (malformed lines are left out) or keep (in column _corrupt_record). Blank lines are skipped."""
    if bad == "fail":
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return rows if bad == "keep" else rows.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def malformed(rows: DataFrame) -> DataFrame:
    """One row: good and bad line counts of a scan that keeps malformed lines, and how many have the first field."""
    bad = F.col(CORRUPT).isNotNull()
    return rows.agg(F.count_if(~bad).alias("good"), F.count_if(bad).alias("bad"), F.count(rows.columns[0]).alias("filled"))


def records(spark: SparkSession, path) -> DataFrame:
    """Corpus records with nested, nullable members."""
    return json_lines(spark, path, RECORD)


def csv_strings(spark: SparkSession, path, columns: list[str], recursive: bool = False) -> DataFrame:
    """CSV with a header, all strings; quoted fields may hold line ends and doubled quotes. file and cycle come from the file's name.

    Files may differ in their columns: those of one header are read together, the sets are united by name, and columns that a
    file lacks are null. What is gathered on the driver is one header and path for each file.
    """
    options = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "recursiveFileLookup": recursive}
    first = F.regexp_replace(F.substring_index("value", "\n", 1), "\r$", "")
    heads = spark.read.option("recursiveFileLookup", recursive).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), first.alias("head"))
    out = spark.createDataFrame([], ", ".join([f"`{c}` string" for c in columns] + ["`file` string", "`modified` timestamp"]))
    for head, paths in heads.groupBy("head").agg(F.array_sort(F.collect_list("path"))).orderBy("head").collect():
        names = [c.strip().strip('"') for c in head.split(",")]
        schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
        rows = spark.read.options(**options).schema(schema).csv(paths)
        rows = rows.select(*[c for c in columns if c in names], F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_modification_time").alias("modified"))
        out = out.unionByName(rows, allowMissingColumns=True)
    written = F.try_to_timestamp(F.nullif(F.regexp_extract("file", r"(\d{8}_\d{6})", 1), F.lit("")), F.lit("yyyyMMdd_HHmmss"))
    return out.withColumn("cycle", F.regexp_extract("file", r"_c(\d+)_", 1).try_cast("int")).withColumn("written", written)


def typed(df: DataFrame, ints: list[str]) -> DataFrame:
    """Empty integers are 0; rows with a bad one are left out."""
    good = F.lit(True)
    for c in ints:
        good = good & ((F.trim(F.coalesce(c, F.lit(""))) == "") | F.col(c).try_cast("int").isNotNull())
    return df.filter(good).withColumns({c: F.coalesce(F.col(c).try_cast("int"), F.lit(0)) for c in ints})


def json_document(spark: SparkSession, path, schema: T.StructType | str) -> DataFrame:
    """A document that is one array or object over many lines."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def topics(batches: DataFrame) -> DataFrame:
    """batches: array<struct<domain, topics array<string>>> -> domain, topic."""
    return batches.select(F.explode("batches").alias("b")).select(F.col("b.domain").alias("domain"), F.explode("b.topics").alias("topic"))


def manifest(index: DataFrame, clean: DataFrame, original: DataFrame, config: DataFrame, comment: DataFrame) -> DataFrame:
    """Index rows with their texts: the clean one, else the original; rows without either are left out. Texts: (name, text)."""
    named = lambda df, c: df.select("name", F.col("text").alias(c))
    j = index.join(named(clean, "clean"), "name", "left").join(named(original, "original"), "name", "left").join(named(config, "cfg"), "name", "left").join(named(comment, "comment"), "name", "left")
    return j.withColumn("content", F.coalesce("clean", "original")).filter("content is not null").drop("clean", "original")


def whole_texts(spark: SparkSession, path, suffix: str = "") -> DataFrame:
    """name (the file's, without its suffix), text."""
    df = spark.read.text(path, wholetext=True)
    return df.select(F.regexp_replace(F.col("_metadata.file_name"), rf"{suffix}$", "").alias("name"), F.col("value").alias("text"))


def state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A state table, or an empty one where there is none that can be read."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def synthetic(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """n seeded sums: id, a, b, question, answer."""
    draw = lambda k: (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|{k}|"), F.col("id").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % 100).cast("int")
    df = spark.range(n).withColumn("a", draw(1)).withColumn("b", draw(2))
    return df.withColumn("question", F.format_string("What is %d + %d?", "a", "b")).withColumn("answer", F.col("a") + F.col("b"))


def newest_file(spark: SparkSession, path, schema: str, suffix: str = "csv", **options) -> DataFrame:
    """Rows of the file changed last among those under path that have any, with its name as `source`; of equal times the smaller name.

    The choice is one aggregation of files' metadata, so nothing is listed on the driver, and other files are skipped by the filter on it."""
    rows = spark.read.schema(schema).options(recursiveFileLookup=True, pathGlobFilter=f"*.{suffix}", **options).format(suffix).load(path)
    found = rows.select("*", F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_modification_time").alias("changed"))
    newest = found.groupBy("source").agg(F.max("changed").alias("changed")).agg(F.min_by("source", F.struct(-F.unix_micros("changed"), "source"))).first()[0]
    return found.filter(F.col("source") == newest).drop("changed") if newest else found.limit(0).drop("changed")


def final_answer(text: Column) -> Column:
    """What follows #### in a worked answer, commas out."""
    return F.replace(F.nullif(F.regexp_extract(text, r"####\s*(-?[\d,.]+)", 1), F.lit("")), F.lit(","), F.lit(""))


def pending(keys: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Work that isn't in the cache yet."""
    return keys.join(done.select(*on).distinct(), on, "left_anti")
