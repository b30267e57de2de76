"""History of templates: decay, surprise, promotion, ranking, drift, and the Count-Min sketch as a relation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows and columns of the sketch, and the multiplier of each row's hash.
ROWS, COLUMN_BITS, COUNTER_MAX = 5, 20, 4294967295
MULTIPLIERS = [0x9E3779B97F4A7C15, 0x6C62272E07BB0142, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9, 0xE37E28C8BB4EC5EA]
#: Promotions from the least, their tags, colours, and least bits of surprise.
PROMOTIONS = {"normal": "", "elevated": "[ELEVATED]", "anomaly": "[ANOMALY]", "novelty": "[NEW]"}
COLOURS = {"normal": "\x1b[0m", "elevated": "\x1b[1;33m", "anomaly": "\x1b[1;31m", "novelty": "\x1b[1;35m"}
ELEVATED_BITS, ANOMALY_BITS = 1.0, 3.0
HALF_LIFE_HOURS = 168.0


def surprise(count: Column, total: Column, past: Column, past_total: Column) -> Column:
    """Bits by which a template is more frequent than before; infinite if it has no past, never negative."""
    unseen = (F.coalesce(past, F.lit(0)) == 0) | (F.coalesce(past_total, F.lit(0)) == 0)
    return F.when(total == 0, 0.0).when(unseen, F.lit(math.inf)).otherwise(F.greatest(F.lit(0.0), F.log2((count / total) / (past / past_total))))


def promotion(bits: Column) -> Column:
    return F.when(bits == math.inf, "novelty").when(bits >= ANOMALY_BITS, "anomaly").when(bits >= ELEVATED_BITS, "elevated").otherwise("normal")


def promotion_rank(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, PROMOTIONS)), name).cast("int") - 1


def lookup(table: dict[str, str], name: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[name]


def run_counts(templates: DataFrame) -> DataFrame:
    return templates.groupBy("template_id").agg(F.sum("count").alias("count"))


def decay_factor(now: Column, then: Column, half_life: float = HALF_LIFE_HOURS) -> Column:
    """Weight of counts of a time (seconds) in the past; times ahead of now count in full."""
    return F.exp(-(math.log(2) / half_life) * F.greatest(F.lit(0), now - then) / 3600.0)


def decayed(history: DataFrame, now: int, half_life: float = HALF_LIFE_HOURS) -> DataFrame:
    """`template_id, past`: counts of earlier runs, each run weighed by its age, cut to whole numbers."""
    return history.groupBy("template_id").agg(F.floor(F.sum(F.col("count") * decay_factor(F.lit(now), F.col("run_ts"), half_life))).cast("long").alias("past"))


def flush(history: DataFrame, counts: DataFrame, now: int, half_life: float = HALF_LIFE_HOURS) -> DataFrame:
    """`template_id, count`: the history decayed to now, and then this run's counts added."""
    both = decayed(history, now, half_life).withColumnRenamed("past", "count").unionByName(run_counts(counts))
    return run_counts(both)


def last_runs(history: DataFrame, runs: int) -> DataFrame:
    """History of the latest runs only; a run has one time, so the ranked table is that of runs."""
    kept = history.select("run_ts").distinct().orderBy(F.col("run_ts").desc()).limit(runs)
    return history.join(kept, "run_ts", "left_semi")


def score(templates: DataFrame, past: DataFrame) -> DataFrame:
    """Templates with `surprise, promotion, promotion_rank, historic_estimate`; totals are one-row aggregates."""
    now, before = templates.agg(F.sum("count").alias("_total")), past.agg(F.sum("past").alias("_past_total"))
    out = templates.join(past, "template_id", "left").join(F.broadcast(now)).join(F.broadcast(before))
    out = out.withColumn("surprise", surprise(F.col("count"), F.col("_total"), F.col("past"), F.col("_past_total"))).withColumn("promotion", promotion(F.col("surprise")))
    return out.withColumn("promotion_rank", promotion_rank(F.col("promotion"))).withColumn("historic_estimate", F.coalesce("past", F.lit(0))).drop("_total", "_past_total", "past")


#: Order of a summary: promotion, count, then what makes it the same on every run.
def ranking() -> list[Column]:
    return [F.col("promotion_rank").desc(), F.col("count").desc(), F.col("pattern"), F.col("template_id")]


def novel(templates: DataFrame, past: DataFrame) -> DataFrame:
    return templates.join(past, "template_id", "left_anti")


def cosine_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of two `template_id, count` histograms, one row."""
    both = a.select("template_id", F.col("count").alias("x")).join(b.select("template_id", F.col("count").alias("y")), "template_id", "full").na.fill(0, ["x", "y"])
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    return both.agg((1 - F.sum(x * y) / F.nullif(F.sqrt(F.sum(x * x)) * F.sqrt(F.sum(y * y)), F.lit(0.0))).alias("distance"))


def needs_retraining(runs: int, distance: float | None) -> bool:
    return runs >= 50 or (distance or 0.0) > 0.3


def sketch_column(template_id: Column, row: Column) -> Column:
    """Top bits of id * multiplier modulo 2 ** 64, in decimals, for products of 64-bit numbers overflow."""
    by = F.array(*[F.lit(m).cast("decimal(20,0)") for m in map(str, MULTIPLIERS)])
    low, high = F.lit(str(1 << 32)).cast("decimal(20,0)"), F.lit(str(1 << 64)).cast("decimal(20,0)")
    m = F.get(by, row)
    i = template_id.cast("decimal(20,0)")
    # id * multiplier = (id div 2^32 * multiplier mod 2^32) * 2^32 + (id mod 2^32) * multiplier, modulo 2^64
    top = F.pmod(F.floor(i / low).cast("decimal(10,0)") * m.cast("decimal(20,0)"), low.cast("decimal(38,0)")).cast("decimal(10,0)")
    rest = (F.pmod(i, low).cast("decimal(10,0)") * m).cast("decimal(38,0)")
    product = F.pmod((top * low).cast("decimal(38,0)") + rest, high.cast("decimal(38,0)")).cast("decimal(20,0)")
    return F.floor(product / F.lit(str(1 << (64 - COLUMN_BITS))).cast("decimal(20,0)")).cast("long")


def sketch(counts: DataFrame) -> DataFrame:
    """`row, col, count`: the counters that are not zero, saturated at 32 bits."""
    cells = counts.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(ROWS - 1))))
    cells = cells.withColumn("col", sketch_column(F.col("template_id"), F.col("row")))
    return cells.groupBy("row", "col").agg(F.least(F.sum("count"), F.lit(COUNTER_MAX)).alias("count"))


def decay_sketch(cells: DataFrame, factor: Column) -> DataFrame:
    return cells.withColumn("count", F.floor(F.col("count") * factor).cast("long"))


def add_sketches(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("row", "col").agg(F.least(F.sum("count"), F.lit(COUNTER_MAX)).alias("count"))


def estimate(ids: DataFrame, cells: DataFrame) -> DataFrame:
    """`template_id, estimate`: the least counter of each id over the rows."""
    at = ids.select("template_id").withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(ROWS - 1))))
    at = at.withColumn("col", sketch_column(F.col("template_id"), F.col("row")))
    return at.join(cells, ["row", "col"], "left").groupBy("template_id").agg(F.min(F.coalesce("count", F.lit(0))).alias("estimate"))


def sample(df: DataFrame, by: list[str], index: str, size: int = 200, seed: int = 0) -> DataFrame:
    """A repeatable uniform sample of at most `size` rows of each group."""
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in (*by, index)]))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(draw, index))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= size).drop("_rank")
