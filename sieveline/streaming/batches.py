"""Structured Streaming: every micro-batch of lines is one run, scored against the history of earlier batches.

What mining remembers goes on from batch to batch: the beginnings of messages, which routing ranks by their first record, and the
templates of every leaf with their counts.  So the templates and counts after any number of batches are those of one run over all
their lines.  A batch's state is a table of its own, so a batch that is repeated after a failure begins from the same state.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators import drain, score
from ..operators.prefix import running_sum
from ..plans.condense import Options, past_of
from ..session import written
from ..sources.state import BEGINNINGS, LEAVES, State

LEAF = ["word_count", "path", "k"]


@dataclass
class Mined:
    """Beginnings that are new, all leaves, and the templates that the batch has records of (with `count` and `first_record_id` of the batch)."""

    beginnings: DataFrame
    leaves: DataFrame
    templates: DataFrame


def advance(messages: DataFrame, beginnings: DataFrame, leaves: DataFrame, options: Options = Options()) -> Mined:  # noqa: B008
    """Mine `record_id, message` on top of what there was; record ids are greater than all earlier ones."""
    rows = drain.tokenised(messages)
    new = written(drain.heads(rows, options.depth).join(beginnings, ["root", "word_count", "head"], "left_anti"), "beginnings")
    routed = written(drain.route(rows, options.depth, options.max_children, beginnings=beginnings.unionByName(new.select(beginnings.columns))), "routed")
    closed = drain.literal_share(F.col("path"), F.col("word_count")) >= options.sim_threshold
    count = [F.count("*").alias("now"), F.min("record_id").alias("began")]

    shut = drain.closed_templates(routed.filter(closed)).select("word_count", "path", F.lit(0).alias("k"), F.col("tokens").alias("own"), F.col("count").alias("now"), F.col("first_record_id").alias("began"))
    both = F.when(F.col("tokens").isNull(), F.col("own")).when(F.col("own").isNull(), F.col("tokens")).otherwise(F.zip_with("tokens", "own", lambda a, b: F.when(a == b, a)))
    shut = leaves.filter(closed).join(shut, LEAF, "full").withColumn("tokens", both).drop("own")

    templates, records = drain.evolved(routed.filter(~closed), options.sim_threshold, leaves.filter(~closed))
    counts = records.groupBy(*LEAF).agg(*count)
    open_ = templates.join(leaves.select(*LEAF, "count", "first_record_id"), LEAF, "left").join(counts, LEAF, "left")
    after = written(shut.unionByName(open_, allowMissingColumns=True).select(*LEAF, "tokens", "count", "first_record_id", "now", "began"), "leaves")
    total = after.select(*LEAF, "tokens", (F.coalesce("count", F.lit(0)) + F.coalesce("now", F.lit(0))).alias("count"), F.coalesce("first_record_id", "began").alias("first_record_id"))
    own = after.filter("now > 0").select("word_count", "path", "tokens", F.col("now").alias("count"), F.col("began").alias("first_record_id"))
    return Mined(new, total, templates_of(own))


def templates_of(leaves: DataFrame) -> DataFrame:
    """`template_id, pattern, word_count, wildcard_count, count, first_record_id` of leaves, a row for each pattern."""
    named = leaves.withColumns({"template_id": T.template_id("tokens"), "pattern": T.render("tokens"), "wildcard_count": T.wildcards("tokens")})
    return named.groupBy("template_id", "pattern", "word_count", "wildcard_count").agg(F.sum("count").alias("count"), F.min("first_record_id").alias("first_record_id"))


def condense_stream(spark: SparkSession, folder: str, state: State, out: str, checkpoint: str, options: Options = Options(), clock=None) -> StreamingQuery:  # noqa: ANN001, B008
    """Condense text files as they arrive in `folder`; scored templates go to `out`, a folder for each batch.

    A batch that is repeated after a failure replaces its own output, its own state and its own rows of the history, and is scored
    against earlier batches only.
    """
    lines = spark.readStream.format("text").option("lineSep", "\n").load(folder)

    def run(batch: DataFrame, number: int) -> None:
        now = clock(number) if clock else int(spark.sql("SELECT unix_timestamp()").first()[0])
        name = f"batch-{number:09d}"
        leaves = state.latest("leaves", LEAVES, name)
        before = leaves.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
        rows = batch.select(F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r$", "").alias("message"), F.lit(1).cast("long").alias("one"))
        messages = running_sum(rows, "one", ["at"], "n").select((F.col("n") + before).alias("record_id"), "message")
        mined = advance(messages, state.before("beginnings", BEGINNINGS, name), leaves, options)
        earlier = state.history().filter(F.col("run_id") < name)
        scored = written(score.score(mined.templates, past_of(earlier, now, options)), "scored")
        scored.write.mode("overwrite").parquet(f"{out}/batch={number}")
        state.put("beginnings", mined.beginnings, name)
        state.put("leaves", mined.leaves, name)
        state.append(scored.select("template_id", "pattern", "count"), name, now)

    return lines.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def level_counts(stream: DataFrame, watermark: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Records of each level in windows of event time, of a stream with `ts` and `level`."""
    return stream.withWatermark("ts", watermark).groupBy(F.window("ts", window), "level").agg(F.count("*").alias("records"))
