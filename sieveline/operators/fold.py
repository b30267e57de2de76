"""Folding of continuation lines into records.

A line begins a record if it is empty or its indentation is at most that of the last record's first line.  Those
first lines never gain indentation, so that is the least indentation of all earlier lines: one running minimum.
A file is one window; `number_large` splits huge files first and passes only each part's minimum and sums on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

#: Lines of a part of a huge file.
PART_LINES = 1_000_000


def _order():  # noqa: ANN202
    return Window.partitionBy("file").orderBy("line_no")


def _before():  # noqa: ANN202
    return _order().rowsBetween(Window.unboundedPreceding, -1)


def _upto():  # noqa: ANN202
    return _order().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def begins(start: str | None = None) -> Column:
    """Whether a line begins a record: by indentation, or by its first byte if `start` is given."""
    first = F.row_number().over(_order()) == 1
    if start:
        return first | F.col("line").startswith(start)
    return first | (F.col("line") == "") | (T.indent("line") <= F.min(T.indent("line")).over(_before()))


def number_records(lines: DataFrame, start: str | None = None) -> DataFrame:
    """Adds `begins` and `record_id`, counted from 0 in each file, and `byte_offset` of the line."""
    size = F.octet_length("line") + 1
    out = lines.withColumn("begins", begins(start)).withColumn("byte_offset", F.coalesce(F.sum(size).over(_before()), F.lit(0)))
    return out.withColumn("record_id", F.sum(F.col("begins").cast("long")).over(_upto()) - 1)


def number_large(lines: DataFrame, start: str | None = None, part_lines: int = PART_LINES) -> DataFrame:
    """`number_records` for files too large for one window: parts of `part_lines` consecutive lines, of which only sums and minima pass on."""
    first = lines.groupBy("file").agg(F.min("line_no").alias("first"))
    cut = lines.withColumn("part", F.floor(F.col("line_no") / part_lines)).withColumn("pad", T.indent("line"))
    earlier = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    least = cut.groupBy("file", "part").agg(F.min("pad").alias("least"), F.sum(F.octet_length("line") + 1).alias("bytes"))
    least = least.select("file", "part", F.min("least").over(earlier).alias("floor"), F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("ahead"))
    cut = cut.join(least.join(first, "file"), ["file", "part"])
    within = Window.partitionBy("file", "part").orderBy("line_no")
    before, upto = within.rowsBetween(Window.unboundedPreceding, -1), within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_first = F.col("line_no") == F.col("first")
    bound = F.least(F.min("pad").over(before), F.col("floor"))
    begins_ = is_first | (F.col("line").startswith(start) if start else (F.col("line") == "") | (F.col("pad") <= bound))
    cut = cut.withColumn("begins", begins_).withColumn("byte_offset", F.col("ahead") + F.coalesce(F.sum(F.octet_length("line") + 1).over(before), F.lit(0)))
    starts = cut.groupBy("file", "part").agg(F.sum(F.col("begins").cast("long")).alias("n"))
    cut = cut.join(starts.select("file", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")), ["file", "part"])
    out = cut.withColumn("record_id", F.col("base") + F.sum(F.col("begins").cast("long")).over(upto) - 1)
    return out.drop("part", "pad", "floor", "ahead", "first", "base")


def fold(lines: DataFrame, start: str | None = None, large: bool = False) -> DataFrame:
    """`file, record_id, message, raw_line, n_lines, byte_offset`: the first line is the message, all lines the raw line."""
    rows = (number_large if large else number_records)(lines, start).groupBy("file", "record_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line", "byte_offset"))).alias("rows"))
    return rows.select("file", "record_id", F.col("rows")[0]["line"].alias("message"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("raw_line"), F.size("rows").alias("n_lines"), F.col("rows")[0]["byte_offset"].alias("byte_offset"))


def run_stats(lines: DataFrame, format: str = "raw", start: str | None = None, large: bool = False) -> DataFrame:
    """Bytes, lines, records and records that fell back to raw: all of them if a structured format was found, else none."""
    numbered = (number_large if large else number_records)(lines, start)
    records = F.sum(F.col("begins").cast("long"))
    return numbered.agg(F.sum(F.octet_length("line") + 1).alias("bytes"), F.count("*").alias("lines"), records.alias("records"), (records if format != "raw" else F.lit(0).cast("long")).alias("unparseable"))
