"""Mixing sources to target weights by entropy balancing.

Every document gets a rate (how many times the mix takes it).  Among all rates that meet each source's token
constraint, entropy balancing takes those nearest, in relative entropy, to taking everything once, with two
copies as the ceiling.  Their dual is convex, with one multiplier for each source, and its solution tilts the
rates exponentially: rate = min(ceiling, exp(multiplier * size / mean size)).  Newton's steps are sums over the
(source, size) classes, which Spark makes; the driver holds one row for each source.

Only DataFrame functions are used.  Rounding works on (source, size) classes by running sums (see _whole): a source ends
within half of its shortest documents of its target wherever the ceiling allows.  Within a class, copies go to
documents in the order of a hash of their ids.  Sums are taken in decimals, so that reruns agree.

Defined cases: a null or empty text has size 0 and nothing is taken of it; null is a source of its own, the last
in order; repeated rows are documents of their own; an empty table gives an empty result; only the named
columns are read, so further columns of any name do no harm.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import WORD, Scratch, bounded, fresh

#: Rows of equal source and size that are ranked together, about, so that a large group of copies has no task of its own.
PART = 1_000


def targets(sizes: Sequence[float], weights: Sequence[float], share: float, ceiling: float) -> list[float]:
    """Share `share` of all sizes by weight; what lies above `ceiling` times a size is shared again."""
    out, left = [0.0] * len(sizes), share * sum(sizes)
    free = [i for i, s in enumerate(sizes) if s > 0]
    while free and left > 0:
        unit = left / sum(weights[i] for i in free)
        full = [i for i in free if unit * weights[i] > ceiling * sizes[i]]
        if not full:
            for i in free:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = ceiling * sizes[i]
            left -= out[i]
        free = [i for i in free if i not in set(full)]
    return out


class _Multiplier:
    """Newton's method for one source, kept within a bracket because the ceiling bends the curve."""

    def __init__(self, target: float, size: float, least: float, ceiling: float) -> None:
        self.target, self.at, self.low, self.high = target, 0.0, -math.inf, math.inf
        self.done = size <= 0
        if size > 0 and target >= ceiling * size * (1 - 1e-12):
            self.at, self.done = math.log(ceiling) / least + 1, True  # every document is at the ceiling
        self.tolerance = 1e-9 * max(target, 1.0)

    def step(self, value: float, slope: float) -> None:
        gap = value - self.target
        if self.done or abs(gap) <= self.tolerance:
            self.done = True
            return
        if gap > 0:
            self.high = self.at
        else:
            self.low = self.at
        new = self.at - gap / slope if slope > 0 else math.nan
        if not self.low < new < self.high:
            if math.isinf(self.low):
                new = min(2 * self.high, self.high - 1)
            elif math.isinf(self.high):
                new = max(2 * self.low, self.low + 1)
            else:
                new = (self.low + self.high) / 2
        self.done = new == self.at or (self.high - self.low) < 1e-13 * max(1.0, abs(new))
        self.at = new


def _exact(value: Column) -> Column:
    """A sum in decimals, which is the same in any order."""
    return F.sum(value.cast("decimal(38,12)")).cast("double")


def _whole(rated: DataFrame, scratch: Scratch, goal: Sequence[float], ceiling: int) -> DataFrame:
    """`sid, _size, k`: whole copies for the classes `sid, _size, n, rate`.

    First the running sum of n * rate from long to short documents is rounded: as sizes only fall, a source then misses
    its target by at most half of its longest document.  What is missing is spread over the room of classes that are short
    beside it, again by rounded running sums, so it shrinks by half at least and mostly sixteenfold; the last step
    moves a single copy.  All sums are windows and aggregates over narrow rows, a row for each source and size.
    """
    fall = Window.partitionBy("sid").orderBy(F.col("_size").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.sum((F.col("n") * F.col("rate")).cast("decimal(38,12)")).over(fall)
    whole = lambda c: F.floor(c + F.lit(0.5)).cast("long")
    got = rated.filter("_size > 0").withColumn("upto", upto).withColumn("upto", F.round("upto").cast("long"))
    copies = got.withColumn("k", F.col("upto") - F.lag("upto", 1, 0).over(Window.partitionBy("sid").orderBy(F.col("_size").desc()))).select("sid", "_size", "n", "k")
    copies = scratch.table(copies, "copies")
    while True:
        taken = {r["sid"]: r["t"] for r in copies.groupBy("sid").agg(F.sum(F.col("k") * F.col("_size")).alias("t")).collect()}
        miss = [(i, goal[i] - t) for i, t in taken.items() if abs(goal[i] - t) > 0.5]
        if not miss:
            return copies
        near = copies.join(bounded(copies.sparkSession.createDataFrame(miss, "sid int, miss double"), len(miss)), "sid")
        near = near.withColumn("far", F.abs("miss")).withColumn("room", F.when(F.col("miss") > 0, ceiling * F.col("n") - F.col("k")).otherwise(F.col("k"))).filter("room > 0 and _size < 2 * far")
        words = F.col("room") * F.col("_size")
        found = near.groupBy("sid").agg(F.first("miss").alias("miss"), F.sum(F.when(F.col("_size") * 16 <= F.col("far"), words)).alias("short"), F.sum(F.when(F.col("_size") <= F.col("far"), words)).alias("fit"), F.min("_size").alias("least")).collect()
        if not found:
            return copies
        steps = []  # sid, sign, greatest size that moves, share of the room
        for r in found:
            far = abs(r["miss"])
            if not r["fit"]:
                steps.append((r["sid"], math.copysign(1, r["miss"]), float(r["least"]), 0.0))
            else:
                words_, most = (r["short"], far / 16) if (r["short"] or 0) >= far else (r["fit"], far)
                steps.append((r["sid"], math.copysign(1, r["miss"]), most, min(1.0, far / words_)))
        plan = bounded(copies.sparkSession.createDataFrame(steps, "sid int, sign double, most double, share double"), len(steps))
        moved = copies.join(plan, "sid", "left")
        room = F.when((F.col("_size") <= F.col("most")), F.when(F.col("sign") > 0, ceiling * F.col("n") - F.col("k")).otherwise(F.col("k"))).otherwise(0)
        moved = moved.withColumn("room", room).withColumn("upto", whole(F.sum("room").over(fall) * F.coalesce("share", F.lit(0.0))))
        by = F.least("room", F.col("upto") - F.lag("upto", 1, 0).over(Window.partitionBy("sid").orderBy(F.col("_size").desc())))
        one = (F.col("share") == 0) & (F.col("_size") == F.col("most"))
        moved = moved.withColumn("by", F.when(one, F.lit(1)).otherwise(F.greatest(by, F.lit(0))))
        after = scratch.table(moved.select("sid", "_size", "n", (F.col("k") + F.coalesce((F.col("by") * F.col("sign")).cast("long"), F.lit(0))).alias("k")), "copies")
        scratch.drop(copies)
        copies = after


def mix(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[float] = (5.0, 2.0, 1.0), share: float = 1.5, ceiling: int = 2, iterations: int = 200) -> DataFrame:
    """Copies of each document: `doc_id, size, source_size, target, taken, rate, copies`.

    `weights` repeat over the sources in code-point order.  A source that Newton's steps, which bisect where they must, have not
    solved after `iterations` is an error.  The number of sources (not of documents) must fit the driver.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "mixing")
    sized = docs.select(F.col(doc_id).alias("_id"), F.col(source).cast("string").alias("_source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("_size"))
    sized = scratch.numbered(sized, "sized", "_number")
    classes = sized.groupBy("_source", "_size").agg(F.count("*").alias("n"))
    classes = scratch.table(classes, "classes")
    sums = classes.groupBy("_source").agg(F.sum(F.col("_size") * F.col("n")).alias("total"), F.sum("n").alias("docs"), F.min(F.when(F.col("_size") > 0, F.col("_size"))).alias("least")).collect()
    sums = sorted(sums, key=lambda r: (r["_source"] is None, r["_source"] or ""))
    sizes = [int(r["total"] or 0) for r in sums]
    goal = targets(sizes, [float(weights[i % len(weights)]) for i in range(len(sums))], share, ceiling)
    scale = [max(1.0, s / max(1, r["docs"])) for s, r in zip(sizes, sums, strict=True)]
    solve = [_Multiplier(t, s, (r["least"] or 1) / c, ceiling) for t, s, r, c in zip(goal, sizes, sums, scale, strict=True)]

    def known(tilts: bool) -> DataFrame:
        rows = [(r["_source"], i, s, float(t), float(c), round(m.at, 10)) for i, (r, s, t, c, m) in enumerate(zip(sums, sizes, goal, scale, solve, strict=True)) if tilts or not m.done]
        return bounded(spark.createDataFrame(rows, "k string, sid int, source_size long, target double, scale double, tilt double"), len(rows))

    x, tilt = F.col("_size") / F.col("scale"), F.exp(F.least(F.col("tilt") * F.col("_size") / F.col("scale"), F.lit(50.0)))
    for _ in range(iterations):
        if all(m.done for m in solve):
            break
        rate = F.least(tilt, F.lit(float(ceiling)))
        sums_now = classes.join(known(False), F.col("_source").eqNullSafe(F.col("k"))).groupBy("sid").agg(_exact(F.col("n") * F.col("_size") * rate).alias("value"), _exact(F.when(tilt < ceiling, F.col("n") * F.col("_size") * x * tilt).otherwise(0.0)).alias("slope"))
        for r in sums_now.collect():
            solve[r["sid"]].step(r["value"], r["slope"])
    else:
        raise RuntimeError(f"no solution within {iterations} steps for the sources {[r['_source'] for r, m in zip(sums, solve, strict=True) if not m.done]}")

    rated = classes.join(known(True), F.col("_source").eqNullSafe(F.col("k"))).select("sid", "_size", "n", F.least(tilt, F.lit(float(ceiling))).alias("rate"))
    copies = _whole(scratch.table(rated, "rated"), scratch, goal, ceiling).select("sid", "_size", F.col("k").alias("copies"))

    # rows of equal source and size are ranked in parts of about PART rows; rows without an id spread by their own number
    most = classes.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    part = F.pmod(F.coalesce(F.when(F.col("_id").isNotNull(), F.xxhash64("_id")), F.xxhash64("_number")), F.lit(max(1, math.ceil(most / PART))))
    placed = sized.withColumn("_part", part).join(known(True).select("k", "sid", "source_size", "target", "scale", "tilt"), F.col("_source").eqNullSafe(F.col("k"))).drop("k")
    parts = placed.groupBy("sid", "_size", "_part").agg(F.count("*").alias("m"))
    upto = Window.partitionBy("sid", "_size").orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.join(copies.hint("merge"), ["sid", "_size"], "left").withColumn("upto", F.sum("m").over(upto)).withColumn("all", F.sum("m").over(Window.partitionBy("sid", "_size")))
    share_of = lambda rows: F.floor(F.coalesce("copies", F.lit(0)).cast("decimal(20,0)") * rows / F.col("all")).cast("long")
    parts = scratch.table(parts.select("sid", "_size", "_part", "m", (share_of(F.col("upto")) - share_of(F.col("upto") - F.col("m"))).alias("got")), "parts")
    rank = F.row_number().over(Window.partitionBy("sid", "_size", "_part").orderBy(F.xxhash64("_id"), "_id"))
    out = placed.join(parts.hint("merge"), ["sid", "_size", "_part"]).withColumn("_rank", rank)
    out = out.withColumn("copies", F.floor(F.col("got") / F.col("m")).cast("long") + (F.col("_rank") <= F.col("got") % F.col("m")).cast("long"))
    return out.select(F.col("_id").alias(doc_id), F.col("_size").alias("size"), "source_size", "target", (F.col("copies") * F.col("_size")).alias("taken"), F.least(tilt, F.lit(float(ceiling))).alias("rate"), "copies")


def copy_rows(docs: DataFrame, mixed: DataFrame, *, doc_id: str = "doc_id") -> DataFrame:
    """The rows of `docs`, each as often as `mixed` takes it.  Rows of one id get the rounded mean of the id's copies each;
    mixed_rows() is for tables in which ids are null or repeated."""
    taken = mixed.groupBy(F.col(doc_id).alias("_mixed_id")).agg(F.round(F.avg("copies")).cast("int").alias("_copies")).filter("_copies > 0")
    taken = Scratch(docs.sparkSession, "copies").table(taken, "copies")
    rows = docs.select(docs[doc_id].alias("_doc_id"), F.struct(*[docs[c] for c in docs.columns]).alias("_doc")).join(taken.hint("merge"), F.col("_doc_id").eqNullSafe(F.col("_mixed_id")))
    return rows.select("_doc", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_doc.*")


def mixed_rows(docs: DataFrame, **how: Any) -> DataFrame:
    """The rows of `docs`, each as often as mix() takes it; every row has its own copies, whatever its id."""
    key = fresh(docs, "_row")
    rows = Scratch(docs.sparkSession, "mixed").numbered(docs, "rows", key)
    return copy_rows(rows, mix(rows, doc_id=key, **how), doc_id=key).select(docs.columns)
