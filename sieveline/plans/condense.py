"""The whole run: fold, parse, mine templates, score against history, rank."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import detect, drain, fold, jsondoc, parse, render, score
from ..operators.prefix import running_sum
from ..session import written


@dataclass(frozen=True)
class Options:
    """Parameters of a run; `mode` and `format` override what is detected, `merge` joins templates that differ in one word, `by_path` mines
    messages of every `source_path` apart (and then only templates of different paths are joined), and templates with fewer records than `min_cluster_size` show their first record."""

    depth: int = drain.DEPTH
    max_children: int = drain.MAX_CHILDREN
    sim_threshold: float = drain.THRESHOLD
    multiline_start: str | None = None
    half_life: float = score.HALF_LIFE_HOURS
    history_runs: int | None = None
    min_cluster_size: int = 1
    entropy_threshold: float = 3.5
    max_depth: int = jsondoc.MAX_DEPTH
    mode: str | None = None
    format: str | None = None
    tokens: int | None = None
    bytes_per_token: float = 4.0
    merge: bool = False
    by_path: bool = False


def is_large(lines: DataFrame) -> bool:
    """Whether a file has more lines than one window should hold."""
    return (lines.agg(F.max("line_no")).first()[0] or 0) >= fold.PART_LINES


def records(lines: DataFrame, options: Options = Options()) -> DataFrame:  # noqa: B008
    """Folded and parsed records of `file, line_no, line`, with a long `record_id` in the order of files and lines."""
    folded = fold.fold(lines, options.multiline_start, is_large(lines))
    read = lambda rows, form: parse.parse(rows.withColumnRenamed("message", "line"), form) if form != "raw" else rows
    if options.format:
        out = read(folded, options.format)
    else:
        # every file has a format of its own; there are only a few formats
        found = written(detect.formats(lines), "formats")
        kinds = [r["format"] for r in found.select("format").distinct().orderBy("format").collect()]
        if len(kinds) <= 1:
            out = read(folded, kinds[0] if kinds else "raw")
        else:
            told = folded.join(found, "file", "left").withColumn("format", F.coalesce("format", F.lit("raw")))
            parts = [read(told.filter(F.col("format") == k).drop("format"), k) for k in sorted({*kinds, "raw"})]
            out = parts[0]
            for part in parts[1:]:
                out = out.unionByName(part, allowMissingColumns=True)
    files = running_sum(lines.select("file").distinct().withColumn("_one", F.lit(1).cast("long")), "_one", ["file"], "place").drop("_one")
    return out.join(files, "file").withColumn("record_id", F.shiftleft("place", 40) + F.col("record_id")).drop("place")


def past_of(history: DataFrame, now: int, options: Options = Options()) -> DataFrame:  # noqa: B008
    kept = score.last_runs(history, options.history_runs) if options.history_runs else history
    return score.decayed(kept, now, options.half_life)


def condense(messages: DataFrame, past: DataFrame | None = None, options: Options = Options()) -> DataFrame:  # noqa: B008
    """Scored templates of `record_id, message`; `past` is `template_id, past`, by default nothing."""
    templates = drain.mine(messages, options.depth, options.max_children, options.sim_threshold)
    # one pattern can come from several leaves
    keys = ["template_id", "pattern", "word_count", "wildcard_count"]
    merged = templates.groupBy(*keys).agg(F.first("tokens").alias("tokens"), F.sum("count").alias("count"), F.min("first_record_id").alias("first_record_id"))
    if options.merge:
        joined = drain.merge_similar(merged).withColumn("word_count", F.size("tokens"))
        merged = joined.groupBy(*keys).agg(F.sum("count").alias("count"), F.min("first_record_id").alias("first_record_id"))
    merged = merged.drop("tokens")
    if options.min_cluster_size > 1:
        shown = messages.select(F.col("record_id").alias("first_record_id"), F.col("message").alias("_shown"))
        small = merged.join(shown, "first_record_id", "left")
        merged = small.withColumn("pattern", F.when(F.col("count") < options.min_cluster_size, F.col("_shown")).otherwise(F.col("pattern"))).drop("_shown")
    if past is None:
        past = messages.sparkSession.createDataFrame([], "template_id long, past long")
    return score.score(merged, past)


def condense_onward(messages: DataFrame, earlier: DataFrame, past: DataFrame, options: Options = Options()) -> DataFrame:  # noqa: B008
    """`condense` of the next part of a stream: what a template of `earlier` (`template_id, pattern`) has all words of counts for it, and
    only the rest is mined, so templates stay what they were from batch to batch."""
    rows = drain.tokenised(messages)
    hits = drain.covered(rows, drain.parsed(earlier))
    counts = hits.groupBy("template_id").agg(F.count("*").alias("count"), F.min("record_id").alias("first_record_id"))
    old = drain.parsed(earlier).join(counts, "template_id").select("template_id", F.col("template").alias("tokens"), "word_count", "count", "first_record_id")
    old = old.withColumn("pattern", T.render("tokens")).withColumn("wildcard_count", T.wildcards("tokens"))
    keys = ["template_id", "pattern", "word_count", "wildcard_count"]
    new = drain.mine(messages.join(hits, "record_id", "left_anti"), options.depth, options.max_children, options.sim_threshold)
    both = old.select(*keys, "count", "first_record_id").unionByName(new.select(*keys, "count", "first_record_id"))
    return score.score(both.groupBy(*keys).agg(F.sum("count").alias("count"), F.min("first_record_id").alias("first_record_id")), past)


def entries(messages: DataFrame, past: DataFrame | None = None, options: Options = Options(), exact: bool = False) -> DataFrame:  # noqa: B008
    """`condense` with the parts of each entry: `examples`, `slots`, and where `messages` has the columns, `paths` of `source_path`
    and `first_seen, last_seen` and quantiles `p50, p99` of the gaps of `ts`.

    A template that several paths have is one entry.  The records with their templates are written once, for all parts; the lists are bounded by the template's
    words, the examples and the distinct paths.
    """
    shard = "source_path" if options.by_path else None
    own = drain.assigned(messages, options.depth, options.max_children, options.sim_threshold, shard)
    own = written(drain.merged_records(own, shard) if options.merge else own, "assigned")
    templates = drain.templates_of(own)
    if past is None:
        past = messages.sparkSession.createDataFrame([], "template_id long, past long")
    parts = [drain.examples(own), render.slot_summaries(own, exact)]
    if "source_path" in messages.columns:
        parts.append(drain.source_paths(own).select("template_id", "paths"))
    if "ts" in messages.columns:
        parts.append(render.gaps(own, exact=exact))
    out = score.score(templates.drop("tokens"), past)
    for part in parts:
        out = out.join(part, "template_id", "left")
    return out.withColumn("pattern", F.when(F.col("count") < options.min_cluster_size, F.col("examples")[0]).otherwise(F.col("pattern")))


def condense_json(nodes: DataFrame, past: DataFrame | None = None, options: Options = Options(), exact: bool = False) -> DataFrame:  # noqa: B008
    """Entries of the texts in JSON documents, from the nodes of a walk, with the paths they come from.

    Texts of several lines are folded, so each record of one counts; records come in the order of documents and places.  The texts are
    written once, for lines, folded texts and the sort's sample would each walk all documents.
    """
    texts = jsondoc.text_records(nodes, options.entropy_threshold)
    raw = F.when(F.col("class") == "multiline", F.col("raw_line")).alias("raw_line")
    texts = written(texts.select("doc", "place", "source_path", "class", "message", raw), "texts")
    lines = texts.filter("class = 'line'").select("doc", "place", "source_path", F.lit(0).cast("long").alias("record_id"), "message")
    rows = lines.unionByName(jsondoc.fold_texts(texts).select("doc", "place", "source_path", "record_id", "message"))
    rows = in_order(rows, ["doc", "place", "record_id"])
    return entries(rows.select("record_id", "message", "source_path"), past, replace(options, by_path=True), exact)


def in_order(rows: DataFrame, keys: list[str]) -> DataFrame:
    """`rows` as a written table with a `record_id` that ascends in the order of `keys`: a sort by ranges, with no task for all of them."""
    return written(rows.orderBy(*keys).withColumn("record_id", F.monotonically_increasing_id()), "ordered")


def summary(scored: DataFrame, options: Options = Options()) -> list[str]:  # noqa: B008
    """The rendered summary within the token budget, if there is one."""
    if options.tokens is None:
        return list(render.text_lines(scored))
    fitted = render.within_budget(scored, options.tokens, options.bytes_per_token)
    left = fitted.filter(~F.col("kept")).count()
    return render.render_text(fitted.filter("kept")) + ([f"[...truncated: {left} templates omitted]"] if left else [])
