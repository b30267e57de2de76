"""Command line: condense a log, an NDJSON log or a JSON document."""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import detect, fold, jsondoc, render, score
from .plans.condense import Options, condense, condense_json, entries, is_large, past_of, records, summary
from .sources.lines import read_lines, spool, write_text
from .sources.state import State

#: Paths that a summary of a document shows.
SHOWN_PATHS = 200


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="sieveline", description=__doc__)
    p.add_argument("file", nargs="?", default="-", help="file, folder or pattern that Spark can read; - is standard input")
    p.add_argument("-o", "--output", default="-", help="a file, or for json and raw a folder that Spark writes")
    p.add_argument("-f", "--format", choices=["text", "json", "human", "raw", "report"], default="text")
    p.add_argument("--mode", choices=["auto", "log", "json"], default="auto")
    p.add_argument("--project", help="whose history is used; by default that of the working folder")
    p.add_argument("--state-dir")
    p.add_argument("--no-state", action="store_true")
    p.add_argument("--reset-state", action="store_true")
    p.add_argument("--sim-threshold", type=float, default=Options.sim_threshold)
    p.add_argument("--max-children", type=int, default=Options.max_children)
    p.add_argument("--depth", type=int, default=Options.depth)
    p.add_argument("--multiline-start")
    p.add_argument("--min-cluster-size", type=int, default=1)
    p.add_argument("--merge", action="store_true", help="join templates that differ in one word")
    p.add_argument("--examples", action="store_true", help="first records, values at wildcards and times of each template, in json and report")
    p.add_argument("--half-life", type=float, default=Options.half_life, help="hours")
    p.add_argument("--history-runs", type=int)
    p.add_argument("--tokens", type=int)
    p.add_argument("--bytes-per-token", type=float, default=Options.bytes_per_token)
    p.add_argument("--json-path")
    p.add_argument("--max-depth", type=int, default=jsondoc.MAX_DEPTH)
    p.add_argument("--entropy-threshold", type=float, default=Options.entropy_threshold)
    p.add_argument("--schema-only", action="store_true")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("-q", "--quiet", action="store_true")
    return p.parse_args(argv)


def schema_lines(schema: DataFrame, samples: bool) -> list[str]:
    """A line for each path: type, distinct values, range, samples."""
    out = []
    for r in schema.orderBy("path").limit(SHOWN_PATHS).collect():
        parts = [f"{r['path'] or '(document)'}: {r['dominant']} ×{r['observed']}"]
        if r["distinct"] is not None:
            parts.append(f"{r['distinct']} distinct")
        if r["min"] is not None:
            parts.append(f"range=[{r['min']:g}, {r['max']:g}] p50={r['p50']:g} p99={r['p99']:g}")
        if r["hidden"]:
            parts.append(f"{r['becomes']} ×{r['hidden']}")
        if samples and r["samples"]:
            parts.append(", ".join(repr(s[:60]) for s in r["samples"]))
        out.append("  ".join(parts))
    more = schema.count() - SHOWN_PATHS
    return [*out, f"... ({more} more paths) ..."] if more > 0 else out


def shown(scored: DataFrame, form: str, options: Options, title: str, stats: dict | None) -> Iterator[str]:
    if form == "human":
        yield from render.render_human(scored)
    elif form == "report":
        yield from render.render_report(scored, title)
    else:
        yield from summary(scored, options)
        if stats:
            yield from ["## Run Stats", *[f"{k}: {v}" for k, v in stats.items()]]


def objects(rows: DataFrame, output: str) -> Iterator[str]:
    """Rows of `json` in their order: to the folder `output` by Spark's writer, or one after the other if it is standard output."""
    if output != "-":
        rows.select("json").write.mode("overwrite").text(output)
    else:
        yield from (r["json"] for r in rows.select("json").toLocalIterator())


def lines_of(spark: SparkSession, a: argparse.Namespace) -> Iterator[str]:
    """The output of a run, line by line; what Spark itself writes is not among it."""
    state = State(spark, a.state_dir, a.project)
    if a.reset_state:
        state.reset()
        return
    options = Options(a.depth, a.max_children, a.sim_threshold, a.multiline_start, a.half_life, a.history_runs, a.min_cluster_size, a.entropy_threshold, a.max_depth, tokens=a.tokens, bytes_per_token=a.bytes_per_token, merge=a.merge)
    now = int(time.time())
    past = None if a.no_state else past_of(state.history(), now, options)
    source = spool(spark, sys.stdin.buffer) if a.file == "-" else a.file
    lines = read_lines(spark, source)
    if a.mode == "auto":
        # a document can be one line: its beginning is enough
        first = lines.select("file", "line_no", F.left("line", F.lit(detect.HEAD)).alias("line")).orderBy("file", "line_no").limit(detect.NDJSON_LINES)
        head = "\n".join(r["line"] for r in first.collect())
        found = spark.createDataFrame([(head,)], "head string").select(detect.probe_mode(detect.head_of(F.col("head")))).first()[0]
        a.mode = "json" if found == "json_document" else "log"
    stats, out = None, []
    if a.mode == "json":
        nodes = jsondoc.walk_files(spark, source, a.max_depth)
        if a.json_path:
            values = jsondoc.leaf_scan(nodes, a.json_path).orderBy(F.col("n").desc(), "path", "value")
            out = (f"{r['path']}: {r['value']} ×{r['n']}" for r in values.toLocalIterator())  # all of them, one after the other
        else:
            out = schema_lines(jsondoc.bounded_schema(nodes), not a.schema_only)
        if a.schema_only:
            yield from out
            return
        scored = condense_json(nodes, past, options)
    else:
        rows = records(lines, options)
        if a.format == "raw":
            yield from objects(rows.select("record_id", F.to_json(F.struct(*[c for c in rows.columns if c != "record_id"])).alias("json")).orderBy("record_id"), a.output)
            return
        stats = fold.run_stats(lines, detect.detect_format(lines), a.multiline_start, is_large(lines)).first().asDict() if a.verbose else None
        if a.examples:
            extra = [c for c in ("ts",) if c in rows.columns]
            scored = entries(rows.select("record_id", "message", *extra), past, options)
        else:
            scored = condense(rows.select("record_id", "message"), past, options)
    scored = scored.persist()
    try:
        yield from out
        yield from objects(render.ndjson(scored.orderBy(*score.ranking())), a.output) if a.format == "json" else shown(scored, a.format, options, a.file, stats)
        if not a.no_state:
            state.append(scored.select("template_id", "pattern", "count"), f"run-{now}", now)
            if a.mode == "json":
                state.put("sketches", jsondoc.sketches(nodes), f"run-{now}")
            state.refresh_dictionary(lines.select("line"))
    finally:
        scored.unpersist()


def run(spark: SparkSession, argv: list[str]) -> list[str]:
    """The lines of a run; none if it is to be quiet."""
    a = arguments(argv)
    out = list(lines_of(spark, a))
    return [] if a.quiet else out


def main() -> None:
    spark = SparkSession.builder.appName("sieveline").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    a = arguments(sys.argv[1:])
    out = lines_of(spark, a)
    if a.quiet:
        for _ in out:
            pass
    elif a.output != "-" and a.format in ("json", "raw") and not a.reset_state:
        write_text(out, "-")  # Spark writes the objects, what is left is the schema of documents
    else:
        write_text(out, a.output)


if __name__ == "__main__":
    main()
