"""Lines of files and of text columns, other inputs, and sinks."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterable
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import shared_folder


def strip_return(line: str = "line") -> F.Column:
    """A return before the line feed goes; one elsewhere is data."""
    return F.when(F.col(line).endswith("\r"), F.expr(f"left({line}, length({line}) - 1)")).otherwise(F.col(line))


def spool(spark: SparkSession, stream: BinaryIO, size: int = 8 << 20) -> str:
    """A stream copied, piece by piece, to a file in the folder that the cluster shares."""
    path = f"{shared_folder(spark)}/stdin-{uuid.uuid4().hex}.log"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where)
    try:
        while piece := stream.read(size):
            out.write(bytearray(piece))
    finally:
        out.close()
    return path


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """`file, line_no, line` of text files; .gz, .bz2 and .zst are unpacked by their names, `-` is standard input.

    Splits of a file are numbered by the offset at which they begin, so only the numbers, not the lines, pass the window.
    """
    if path == "-":
        return read_lines(spark, spool(spark, sys.stdin.buffer)).withColumn("file", F.lit("-"))
    raw = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("at"))
    first = raw.groupBy("file", "start").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    first = first.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    out = raw.join(F.broadcast(first), ["file", "start"])  # a row for each split
    return out.select("file", (F.col("base") + F.col("at") - F.col("first")).alias("line_no"), strip_return().alias("line"))


def text_lines(df: DataFrame, file: str, text: str) -> DataFrame:
    """`file, line_no, line` of a text column; the empty piece after a last line feed is no line."""
    out = df.select(F.col(file).alias("file"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "line"), F.size(F.split(F.col(text), "\n", -1)).alias("n"))
    out = out.filter((F.col("line_no") < F.col("n") - 1) | (F.col("line") != ""))
    return out.select("file", F.col("line_no").cast("long").alias("line_no"), strip_return().alias("line"))


def first_nonempty(lines: DataFrame, n: int = 1000) -> DataFrame:
    """The first n lines of each file that have any character."""
    rank = F.row_number().over(Window.partitionBy("file").orderBy("line_no"))
    return lines.filter("line <> ''").withColumn("rank", rank).filter(F.col("rank") <= n)


def write_ndjson(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_text(lines: Iterable[str], path: str) -> None:
    """Lines of a rendered summary, one after the other, to a file or to standard output."""
    if path == "-":
        sys.stdout.writelines(x + "\n" for x in lines)
    else:
        with open(path, "w", encoding="utf-8") as f:
            f.writelines(x + "\n" for x in lines)
