"""What the training-data operators share: scratch tables, word rules and folds."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: A word is a run of anything but the six ASCII blanks; A-Z are the only letters that are folded.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Largest number of rows of a table that the driver made itself and that a join may broadcast.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_case(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def fold_of(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's text, modulo `parts`; null ids hash as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def lean(run: Callable[[Iterator[Any]], Iterator[Any]]) -> Callable[[Iterator[Any]], Iterator[Any]]:
    """`run`, after which a worker gives back the memory that it has freed; workers live on for the stages that follow."""

    def go(batches: Iterator[Any]) -> Iterator[Any]:
        try:
            yield from run(batches)
        finally:
            import pyarrow as pa

            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries than GNU's
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return go


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast `df` if its known number of rows is small, else leave the join to Spark."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


#: Bytes of text that pass to a Python worker at once; the default of ten thousand rows has no bound in bytes.
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Make a session fit for Python functions: they get the package, and Arrow batches of bounded size, for long texts add up.

    A lower bound that is set already stays.
    """
    ship(spark)
    now = int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES + 1)).rstrip("b") or 0)
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


@lru_cache(maxsize=1)
def _own_folder() -> str:
    """For sessions on one machine without a shared folder, as in tests."""
    return "file://" + tempfile.mkdtemp(prefix="sieveline-")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any store that Spark knows, if it is there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables written to the folder that the whole cluster shares (spark.checkpoint.dir).

    A table read back has no lineage, so a lost executor costs no recomputation, and no partitioning that
    would keep adaptive execution from splitting a hot key in a later join.
    """

    def __init__(self, spark: SparkSession, what: str) -> None:
        self.spark = spark
        prepare(spark)
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        base = base or _own_folder()
        self.root = f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"
        self.count = 0
        self.paths: dict[int, str] = {}
        atexit.register(self._remove, self.root)

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def table(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        path = self.path(name)
        df.write.parquet(path, compression=compression)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def numbered(self, df: DataFrame, name: str, key: str = "_row") -> DataFrame:
        """The written table with a number of its own for every row."""
        return self.table(df.withColumn(key, F.monotonically_increasing_id()), name)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing will read again."""
        for t in tables:
            if path := self.paths.pop(id(t), None):
                self._remove(path)

    def _remove(self, path: str) -> None:
        try:
            remove(self.spark, path)
        except Exception:  # the session may be gone already
            pass
