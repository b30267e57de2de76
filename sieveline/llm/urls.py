"""URL filters by association rules.

Curated rules (host and path prefix, the longest wins) judge the URLs they cover.  The others are judged by
association rules: the judged URLs are transactions of tokens and their verdict, Spark's FP-growth mines the
combinations of at least `min_support`, and rules `tokens -> verdict` of at most `max_tokens` tokens and at least
`min_confidence` are kept unless one with fewer of the same tokens is as sure.  A URL gets the verdict of its surest rule (then the best supported,
then block before allow), or `default` if none matches.

Matching uses an inverted index: a rule is filed under the rarest of its tokens, so that a URL meets only rules
that share a rare token, and these are verified on the whole set.  Equal token sets are judged once.

Tokens: labels of the host, the last one marked as such, segments of the path with numbers as `#`, the file ending, and keys of the query.

Defined cases: null urls and those without `://` have empty host and path, no rule, and no tokens, so they get the
default; an empty table, and one that no curated rule judges, has no mined rules; repeated rows are judged each;
extra columns are not read.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import Scratch, bounded, fold_case

VERDICT = "verdict="
#: Frequent tokens of a group.
GROUP = 3
#: Bytes of the index of rules that are broadcast at most; a larger one is joined.
INDEX_BYTES = 16 << 20


def split_url(df: DataFrame, url: str) -> DataFrame:
    """Adds `_url, host, path, query`; only A-Z of the host are folded."""
    rest = F.expr("coalesce(if(instr(_url, '://') > 0, substring(_url, instr(_url, '://') + 3), ''), '')")
    out = df.withColumn("_url", F.col(url).cast("string")).withColumn("_rest", rest).withColumn("_host", F.regexp_extract("_rest", "^[^/?#]*", 0))
    out = out.withColumn("_tail", F.expr("substring(_rest, length(_host) + 1)"))
    return out.withColumn("host", fold_case(F.col("_host"))).withColumn("path", F.regexp_extract("_tail", "^[^?#]*", 0)).withColumn("query", F.regexp_extract("_tail", "^[^?#]*[?]([^#]*)", 1)).drop("_rest", "_host", "_tail")


def curated(rules: Sequence[tuple[str, str, str]]) -> Column:
    """`rule, verdict` of the longest of the rules (verdict, host, path) that fits, else null.

    Rules are looked up by every suffix of the host that begins after a dot, so the expression does not grow with their number.
    """
    by: dict[str, list[dict]] = {}
    for say, host, path in rules:
        by.setdefault(host, []).append({"size": len(host + path), "verdict": say, "host": host, "path": path})
    known = F.from_json(F.lit(json.dumps(by)), "map<string,array<struct<size:int,verdict:string,host:string,path:string>>>")
    labels = F.split("host", "[.]")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    near = F.flatten(F.transform(suffixes, lambda s: F.coalesce(F.try_element_at(known, s), F.from_json(F.lit("[]"), "array<struct<size:int,verdict:string,host:string,path:string>>"))))
    best = F.array_max(F.filter(near, lambda r: F.col("path").startswith(r["path"])))
    return F.when(best.isNotNull(), F.struct(F.concat(best["host"], best["path"]).alias("rule"), best["verdict"].alias("verdict")))


def tokens() -> Column:
    """Sorted distinct tokens of `host`, `path` and `query`."""
    return F.expr(r"""
        array_sort(array_distinct(filter(concat(
          transform(filter(slice(split(host, '[.]'), 1, greatest(0, size(split(host, '[.]')) - 1)), x -> x <> ''), x -> concat('h=', x)),
          if(host = '', array(), array(concat('top=', regexp_extract(host, '[^.]*$', 0)))),
          transform(split(regexp_replace(path, '[.][A-Za-z0-9]+$', ''), '/'), x -> if(x = '', null, concat('p=', regexp_replace(x, '[0-9]+', '#')))),
          if(path rlike '[.][A-Za-z0-9]+$', array(concat('end=', lower(regexp_extract(path, '[.]([A-Za-z0-9]+)$', 1)))), array()),
          transform(split(query, '&'), x -> if(x = '', null, concat('q=', regexp_extract(x, '^[^=]*', 0))))
        ), x -> x is not null)))""")


def mine(labelled: DataFrame, *, min_support: float = 0.01, min_confidence: float = 0.8, max_tokens: int = 3) -> DataFrame:
    """Rules `tokens, verdict, confidence, support` from rows with `tokens` (sorted array) and `verdict`; rules have at most `max_tokens` tokens.

    FP-growth makes frequent sets of all sizes, which are 2 ** n for n tokens that are common together.  So the frequent tokens
    are dealt out to groups of GROUP, and every row gives a transaction for each combination of at most `max_tokens` of the groups that it has
    tokens of, with the tokens of these.  A set of at most `max_tokens` tokens is counted where the groups are just its own, once for each of its rows;
    no transaction has more than GROUP * max_tokens tokens.
    """
    scratch = Scratch(labelled.sparkSession, "mining")
    labelled = scratch.table(labelled.filter(F.size("tokens") > 0).select("tokens", "verdict", F.xxhash64("tokens").alias("set")), "labelled")
    total = max(1, labelled.count())
    least = max(1, math.ceil(min_support * total - 1e-9))
    # at most (tokens of a row) / (share of the rows)
    often = labelled.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    group = F.floor((F.row_number().over(Window.orderBy(F.col("n").desc(), "token")) - 1) / GROUP).cast("int")
    often = scratch.table(often.select("token", group.alias("g")), "often")
    own = labelled.select("set", "tokens").distinct().select("set", F.explode("tokens").alias("token")).join(bounded(often, often.count()), "token")
    own = own.groupBy("set", "g").agg(F.array_sort(F.collect_list("token")).alias("own")).groupBy("set").agg(F.array_sort(F.collect_list(F.struct("g", "own"))).alias("groups"))  # of one row
    deal = F.transform("groups", lambda x: F.array(x))
    every = deal
    for _ in range(1, max_tokens):
        deal = F.flatten(F.transform(deal, lambda c: F.transform(F.filter("groups", lambda x: x["g"] > F.element_at(c, -1)["g"]), lambda x: F.concat(c, F.array(x)))))
        every = F.concat(every, deal)
    dealt = own.select("set", F.explode(every).alias("c")).withColumn("name", F.array_join(F.transform("c", lambda x: x["g"].cast("string")), "."))
    dealt = dealt.select("set", F.flatten(F.transform("c", lambda x: F.transform(x["own"], lambda t: F.concat_ws("|", "name", x["g"].cast("string"), t)))).alias("own"))
    items = scratch.table(labelled.select("set", "verdict").join(dealt, "set").select(F.concat("own", F.array(F.concat(F.lit(VERDICT), "verdict"))).alias("items")), "items")
    rows = items.count()
    if not rows:
        return labelled.select("tokens", "verdict", F.lit(1.0).alias("confidence"), F.lit(1.0).alias("support")).limit(0)
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / rows), minConfidence=min_confidence).fit(items)
    is_verdict = lambda x: x.startswith(VERDICT)
    sets = model.freqItemsets.filter(F.size("items") <= max_tokens + 1)
    sets = sets.select(F.filter("items", lambda x: ~is_verdict(x)).alias("own"), F.element_at(F.concat(F.filter("items", is_verdict), F.array(F.lit(""))), 1).alias("verdict"), "freq")
    parts = F.transform("own", lambda x: F.split(x, "[|]", 3))
    sets = sets.filter(F.size("own").between(1, max_tokens)).withColumn("parts", parts)
    groups = F.array_join(F.transform(F.array_sort(F.array_distinct(F.transform("parts", lambda x: x[1].cast("int")))), lambda g: g.cast("string")), ".")
    sets = sets.filter(F.col("parts")[0][0] == groups)  # the others are counted elsewhere
    sets = scratch.table(sets.select(F.array_sort(F.transform("parts", lambda x: x[2])).alias("tokens"), "verdict", "freq"), "sets")
    base = sets.filter("verdict = ''").select("tokens", F.col("freq").alias("all"))
    rules = sets.filter("verdict <> ''").join(base, "tokens").withColumn("confidence", F.col("freq") / F.col("all")).filter(F.col("confidence") >= min_confidence)
    return scratch.table(rules.select("tokens", F.expr(f"substring(verdict, {len(VERDICT) + 1})").alias("verdict"), "confidence", (F.col("freq") / F.lit(total)).alias("support")), "rules")


def prune(rules: DataFrame) -> DataFrame:
    """Without rules of which one on fewer of the tokens says the same at least as surely; that one matches wherever they do."""
    parts = F.expr("transform(sequence(1, shiftleft(1, size(tokens)) - 2), m -> filter(tokens, (t, i) -> getbit(m, i) = 1))")
    wide = rules.filter("size(tokens) > 1").select("tokens", "verdict", "confidence", F.explode(parts).alias("part"))
    less = rules.select(F.col("tokens").alias("part"), "verdict", F.col("confidence").alias("sure"))
    beaten = wide.join(less, ["part", "verdict"]).filter("sure >= confidence").select("tokens", "verdict").distinct()
    return rules.join(beaten, ["tokens", "verdict"], "left_anti")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], *, page_id: str = "page_id", url: str = "url", default: str = "allow", **mining: float) -> DataFrame:
    """`page_id, host, path, rule, verdict, mined`: `mined` is the association rule that decided, if one did."""
    scratch = Scratch(pages.sparkSession, "urls")
    rows = split_url(pages.select(F.col(page_id).alias("_id"), F.col(url)), url)
    rows = rows.select("_id", "host", "path", curated(rules).alias("_by"), tokens().alias("tokens"))
    rows = scratch.table(rows.select("_id", "host", "path", "_by.rule", F.col("_by.verdict").alias("said"), "tokens", F.xxhash64("tokens").alias("set")), "rows")
    mined = scratch.table(mine(rows.filter("said is not null").select("tokens", F.col("said").alias("verdict")), **mining), "rules")
    mined = scratch.table(prune(mined).withColumn("r", F.xxhash64("tokens", "verdict")), "pruned")
    sets = scratch.table(rows.filter("said is null and size(tokens) > 0").select("set", "tokens").distinct(), "sets")
    # a rule is filed under its rarest token among the sets to be judged
    often = sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("often"))
    filed = mined.select("*", F.explode("tokens").alias("token")).join(often, "token", "left")
    filed = filed.groupBy("r").agg(F.min_by("token", F.struct(F.coalesce("often", F.lit(0)), "token")).alias("token"), *[F.first(c).alias(c) for c in ("tokens", "verdict", "confidence", "support")])
    filed = scratch.table(filed.withColumnRenamed("tokens", "needs").drop("r"), "index")
    size = filed.agg(F.coalesce(F.sum(F.octet_length(F.array_join("needs", "")) + F.octet_length("token") + 64), F.lit(0))).first()[0]
    hits = sets.select("set", "tokens", F.explode("tokens").alias("token")).join(F.broadcast(filed) if size <= INDEX_BYTES else filed.hint("merge"), "token").filter(F.size(F.array_except("needs", "tokens")) == 0)
    best = F.struct("confidence", "support", (F.col("verdict") == "block").alias("strict"), F.array_join("needs", " ").alias("needs"), "verdict")
    chosen = scratch.table(hits.groupBy("set", "tokens").agg(F.max(best).alias("best")).select("set", "tokens", F.col("best.verdict").alias("guess"), F.col("best.needs").alias("mined")), "chosen")
    out = rows.join(chosen.hint("merge"), ["set", "tokens"], "left")
    guess = F.col("said").isNull()
    return out.select(F.col("_id").alias(page_id), "host", "path", "rule", F.coalesce("said", "guess", F.lit(default)).alias("verdict"), F.when(guess, F.col("mined")).alias("mined"))
