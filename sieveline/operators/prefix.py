"""Running sums over a whole table in an order, without a task for the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import written


def running_sum(df: DataFrame, value: str, order: Sequence[Column | str], into: str) -> DataFrame:
    """Adds `into`: the sum of the column `value` (a long) over all rows up to this one in `order`.

    The rows are sorted by ranges into a written table.  Each range is summed up on its own; the driver adds up the totals, a number for
    each range.
    """
    spark = df.sparkSession
    rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "running")
    part = F.shiftrightunsigned("_at", 33)
    base, bases = 0, []
    for r in sorted(rows.groupBy(part.alias("p")).agg(F.sum(value).alias("s")).collect()):
        bases.append((r["p"], base))
        base += r["s"] or 0
    known = spark.createDataFrame(bases, "_part long, _base long")
    within = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumn("_part", part).join(F.broadcast(known), "_part")  # a row for each range
    return out.withColumn(into, F.col("_base") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("_part", "_at", "_base")
