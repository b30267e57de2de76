"""What a session needs to run the engine's Python functions."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_own: list[str] = []


def on_one_machine(spark: SparkSession) -> bool:
    return re.match(r"local(\[|$)", spark.sparkContext.master) is not None


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and the session is on one machine, a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not on_one_machine(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="sieveline-"))
        base = _own[0]
    return base.rstrip("/")


def folder(spark: SparkSession, what: str) -> str:
    """A folder of one call in the shared one, removed when the session ends."""
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """`df` as a table in the shared folder: computed once, and not again if an executor is lost."""
    path = folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application; they need not have it installed."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="sieveline-"), "sieveline.zip")  # on the driver; Spark serves it
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
