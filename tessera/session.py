"""Sessions, and the package's code on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(name: str = "tessera", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the settings that the library's plans count on: AQE with skew joins, UTC."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false"}
    for k, v in (settings | {k.replace("__", "."): str(v) for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


#: Arrow batches that go to Python: so many rows or bytes at most, as texts may be long. Settings of the application's own stay.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's modules to the executors' Python workers, once a session, and bound the batches that they get."""
    sc, archive = spark.sparkContext, f"{__package__}.zip"
    for k, v in ARROW.items():
        if not sc.getConf().contains(k):
            spark.conf.set(k, v)
    if archive not in sc._python_includes:
        root = Path(__file__).parent
        path = os.path.join(tempfile.mkdtemp(), archive)
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(path)
    return spark
