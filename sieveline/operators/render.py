"""Compression of templates to entries, statistics of wildcards, time between records, token budget and rendering."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from . import score as S
from .prefix import running_sum

#: Lines of the normal section, and distinct words that a slot lists.
NORMAL_LINES, LISTED = 50, 20
#: Record ids that a window over a template's records spans.
SPAN = 1_000_000
SECTIONS = {"novelty": "NEW", "anomaly": "ANOMALY", "elevated": "NORMAL", "normal": "NORMAL"}


def slots(assigned: DataFrame) -> DataFrame:
    """The words at wildcards: `template_id, pos, tok` of records with `template` and `tokens`."""
    spots = F.filter(F.transform(F.arrays_zip("tokens", "template"), lambda z, i: F.struct(i.alias("pos"), z["tokens"].alias("tok"), z["template"].alias("t"))), lambda z: z["t"].isNull())
    return assigned.select("template_id", F.inline(spots)).drop("t")


def slot_stats(assigned: DataFrame, exact: bool = False) -> DataFrame:
    """Of each wildcard: count, whether all are numbers, their range and quantiles, or the distinct words, at most LISTED of them."""
    v = F.expr("try_cast(tok as double)")
    words = slots(assigned).groupBy("template_id", "pos", "tok").agg(F.count("*").alias("n"))  # distinct words first, they are fewer
    quantile = lambda p: F.percentile(v, p, F.col("n")) if exact else F.percentile_approx(v, p, F.lit(10000))
    return words.groupBy("template_id", "pos").agg(F.sum("n").alias("n"), (F.count(v) == F.count("*")).alias("is_numeric"), F.min(v).alias("min"), F.max(v).alias("max"), quantile(0.5).alias("p50"), quantile(0.99).alias("p99"), F.count("*").alias("distinct"))


def slot_words(assigned: DataFrame) -> DataFrame:
    """The distinct words of wildcards that have few."""
    words = slots(assigned).select("template_id", "pos", "tok").distinct()
    few = words.groupBy("template_id", "pos").agg(F.count("*").alias("distinct")).filter(F.col("distinct") <= LISTED)
    return words.join(few, ["template_id", "pos"]).groupBy("template_id", "pos").agg(F.array_sort(F.collect_list("tok")).alias("words"))


def previous(assigned: DataFrame, column: str, span: int = SPAN) -> DataFrame:
    """Adds `before`: the column of the template's record before this one.

    Windows hold a template's records of `span` consecutive record ids, so that a frequent template is not one task; what
    crosses from one span to the next is one value for each template and span.
    """
    out = assigned.withColumn("_span", F.floor(F.col("record_id") / span))
    near = F.lag(F.struct(column)).over(Window.partitionBy("template_id", "_span").orderBy("record_id"))
    out = out.withColumn("_near", near)
    last = out.groupBy("template_id", "_span").agg(F.max_by(F.struct(column), "record_id").alias("_last"))
    last = last.select("template_id", "_span", F.lag("_last").over(Window.partitionBy("template_id").orderBy("_span")).alias("_far"))
    out = out.join(last, ["template_id", "_span"])
    return out.withColumn("before", F.coalesce("_near", "_far")[column]).drop("_span", "_near", "_far")


def gaps(assigned: DataFrame, ts: str = "ts", exact: bool = False) -> DataFrame:
    """Quantiles of the milliseconds between records of a template, and when it was first and last seen."""
    own = previous(assigned.select("template_id", "record_id", ts), ts)
    ms = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("before").cast("timestamp"))) / 1000
    q = lambda p: F.percentile("ms", p) if exact else F.percentile_approx("ms", p, F.lit(10000))
    return own.select("template_id", ts, ms.alias("ms")).groupBy("template_id").agg(q(0.5).alias("p50"), q(0.99).alias("p99"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))


def slot_summaries(assigned: DataFrame, exact: bool = False) -> DataFrame:
    """`template_id, slots`: of each wildcard its place, range and quantiles if all are numbers, else its words if they are few, and how many."""
    both = slot_stats(assigned, exact).join(slot_words(assigned), ["template_id", "pos"], "left")
    number = lambda c: F.when(F.col("is_numeric"), F.col(c)).alias(c)
    one = F.struct("pos", "n", "is_numeric", *[number(c) for c in ("min", "max", "p50", "p99")], "distinct", F.when(~F.col("is_numeric"), F.col("words")).alias("words"))
    return both.groupBy("template_id").agg(F.array_sort(F.collect_list(one)).alias("slots"))  # as many as the template has wildcards


def slot_text(slot: Column) -> Column:
    """A wildcard in words: its range, its values, or their number."""
    n = lambda c: F.format_string("%.6g", slot[c])
    numeric = F.concat(n("min"), F.lit(".."), n("max"), F.lit(" p50="), n("p50"), F.lit(" p99="), n("p99"))
    return F.concat(F.lit("slot "), slot["pos"].cast("string"), F.lit(": "), F.when(slot["is_numeric"], numeric).when(slot["words"].isNotNull(), F.array_join(slot["words"], ", ")).otherwise(F.concat(F.lit("("), slot["distinct"].cast("string"), F.lit(" distinct values)"))))


def changes(assigned: DataFrame) -> DataFrame:
    """Positions and words in which a record differs from the one before it of the same template."""
    out = previous(assigned.select("template_id", "record_id", "tokens"), "tokens").filter("before is not null")
    diff = F.expr("filter(transform(tokens, (t, i) -> if(t = before[i], null, concat(cast(i as string), '=', t))), x -> x is not null)")
    return out.select("template_id", "record_id", diff.alias("changed"))


def entries(scored: DataFrame) -> DataFrame:
    """What a summary shows of a template."""
    return scored.select("template_id", "pattern", "count", "promotion", "promotion_rank", "surprise", "historic_estimate")


def line(entry_pattern: str = "pattern") -> Column:
    """`{tag} {pattern} (count: n)`; the tag of normal entries is empty."""
    return F.concat(S.lookup(S.PROMOTIONS, F.col("promotion")), F.lit(" "), F.col(entry_pattern), F.lit(" (count: "), F.col("count").cast("string"), F.lit(")"))


def ranked(scored: DataFrame) -> DataFrame:
    """Entries with their place within their section and in all, of which only bounded prefixes are shown."""
    section = F.create_map(*[F.lit(x) for kv in SECTIONS.items() for x in kv])[F.col("promotion")]
    out = scored.withColumn("section", section)
    return out.withColumn("place", F.row_number().over(Window.partitionBy("section").orderBy(*S.ranking())))


def summary_lines(scored: DataFrame) -> DataFrame:
    """`section, place, line` of a summary, normal entries cut to the first lines."""
    return ranked(scored).filter((F.col("section") != "NORMAL") | (F.col("place") <= NORMAL_LINES)).select("section", "place", line().alias("line"))


def within_budget(scored: DataFrame, tokens: int, bytes_per_token: float = 4.0) -> DataFrame:
    """All novelties and anomalies, then the others by count while their estimated tokens fit; `kept` marks them."""
    must = F.col("promotion").isin("novelty", "anomaly")
    out = scored.withColumn("tokens_needed", T.token_estimate(F.concat(line(), F.lit("\n")), bytes_per_token))
    order = [must.desc(), F.col("count").desc(), F.col("pattern"), F.col("template_id")]
    return running_sum(out, "tokens_needed", order, "used").withColumn("kept", must | (F.col("used") <= tokens))


def text_lines(scored: DataFrame, stats: dict | None = None) -> Iterator[str]:
    """The lines of the plain summary one after the other: all novelties and anomalies, and a bounded number of others."""
    normal = scored.filter(F.col("promotion").isin("normal", "elevated")).count()
    for name in ("NEW", "ANOMALY", "NORMAL"):
        yield f"## {name}"
        rows = scored.filter(F.col("promotion").isin(*[k for k, v in SECTIONS.items() if v == name])).orderBy(*S.ranking())
        rows = rows.limit(NORMAL_LINES) if name == "NORMAL" else rows
        yield from (r["line"] for r in rows.select(line().alias("line")).toLocalIterator())
    if normal > NORMAL_LINES:
        yield f"{normal - NORMAL_LINES} normal patterns omitted for brevity"
    if stats:
        yield "## Run Stats"
        yield from (f"{k}: {v}" for k, v in stats.items())


def render_text(scored: DataFrame, stats: dict | None = None) -> list[str]:
    """The plain summary as a list."""
    return list(text_lines(scored, stats))


def details(scored: DataFrame) -> Column:
    """Lines below an entry: times, gaps, wildcards, paths, as far as `scored` has them."""
    lines = []
    if "first_seen" in scored.columns:
        lines.append(F.concat(F.lit("first: "), F.col("first_seen").cast("string"), F.lit("  last: "), F.col("last_seen").cast("string")))
        lines.append(F.format_string("delta_p50=%.6gms  delta_p99=%.6gms", "p50", "p99"))
    out = F.filter(F.array(*lines), lambda x: x.isNotNull()) if lines else F.expr("cast(array() as array<string>)")
    if "slots" in scored.columns:
        out = F.concat(out, F.coalesce(F.transform("slots", slot_text), F.expr("cast(array() as array<string>)")))
    if "paths" in scored.columns:
        out = F.concat(out, F.coalesce(F.transform("paths", lambda p: F.concat(F.lit("path: "), p["path"], F.lit(" ×"), p["n"].cast("string"))), F.expr("cast(array() as array<string>)")))
    return out


def render_report(scored: DataFrame, title: str, shown: int = NORMAL_LINES) -> Iterator[str]:
    """A fuller report with a header, counts in front, and how often a pattern was usual: all novelties and anomalies, and `shown` others."""
    totals = {r["promotion"]: r["n"] for r in scored.groupBy("promotion").agg(F.count("*").alias("n")).collect()}
    rule = "═" * 51
    detailed = scored.withColumn("_details", details(scored))
    yield from [rule, f"SUMMARY  {title}", f"Templates: {sum(totals.values())}  │  Novel: {totals.get('novelty', 0)}  │  Anomalous: {totals.get('anomaly', 0)}", rule]
    for names, head in ((["novelty"], "[NEW] NOVEL PATTERNS"), (["anomaly"], "[ANOMALY] UNUSUAL PATTERNS"), (["elevated", "normal"], "NORMAL PATTERNS")):
        yield f"── {head} " + "─" * max(0, 45 - len(head))
        rows = detailed.filter(F.col("promotion").isin(names)).orderBy(*S.ranking())
        rows = rows.limit(shown) if "normal" in names else rows
        for r in rows.toLocalIterator():
            tag = S.PROMOTIONS[r["promotion"]]
            usual = f"  (usual: ~{r['historic_estimate']}/run)" if r["promotion"] == "anomaly" else ""
            yield f"{tag + ' ' if tag else ''}[×{r['count']:,}] {r['pattern']}{usual}"
            yield from (f"    {x}" for x in r["_details"])
        more = sum(totals.get(n, 0) for n in names) - shown
        if "normal" in names and more > 0:
            yield f"... ({more} more templates) ..."
    yield rule


def render_human(scored: DataFrame) -> list[str]:
    """The plain summary in colours."""
    colour = lambda x: next((S.COLOURS[k] + x + S.COLOURS["normal"] for k, t in S.PROMOTIONS.items() if t and x.startswith(t)), x)
    return [colour(x) for x in text_lines(scored)]


#: Parts of an entry that are shown where they are there.
PARTS = ["examples", "slots", "paths", "first_seen", "last_seen", "p50", "p99"]


def ndjson(scored: DataFrame) -> DataFrame:
    """`template_id, json`: one object for each template, with the parts of an entry that `scored` has."""
    more = [c for c in PARTS if c in scored.columns]
    return scored.select("template_id", F.to_json(F.struct("pattern", "count", "promotion", "historic_estimate", *more)).alias("json"))
