"""Template mining: routing by length and first words, templates of leaves, merging, counts by path.

Routing sends a message down a tree: its number of words, then up to `depth` words.  A node takes at most
`max_children` words of their own, those that came first; all others share one child.  Records with the same
first words go the same way, so these are aggregated first, a level is two windows over the distinct beginnings, and
one join brings the paths back to the records.

In a leaf whose literal path covers the needed share of words all messages are alike enough, so it has exactly one
template: a word where all agree, else a wildcard.  Other leaves are order dependent: the messages that can change their templates stream through the
online loop, which writes every version of a template, and records meet the versions of their leaf.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..session import ship, written

#: Default parameters and the number of example records.
DEPTH, MAX_CHILDREN, THRESHOLD, EXAMPLES = 4, 128, 0.5, 3


def tokenised(records: DataFrame, message: str = "message") -> DataFrame:
    return records.withColumn("tokens", T.tokens(message)).withColumn("word_count", F.size("tokens"))


def shard(path: Column, level: Column, words: Column, shards: int) -> Column:
    """A number below `shards` from a record's path, level (perhaps null) and word count, for merge_similar()."""
    key = F.concat_ws("|", F.coalesce(path, F.lit("")), F.coalesce(level, F.lit("")), words.cast("string"))
    return (F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long") % shards).cast("int")


def heads(records: DataFrame, depth: int = DEPTH, shard: str | None = None) -> DataFrame:
    """The distinct beginnings of `record_id, tokens, word_count` with the record that was `first`; of each `shard` its own, if that is a column."""
    root = F.concat(F.lit("S"), F.coalesce(F.col(shard).cast("string"), F.lit(""))) if shard else F.lit("")
    return records.groupBy(root.alias("root"), "word_count", F.slice("tokens", 1, max(1, depth)).alias("head")).agg(F.min("record_id").alias("first"))


def paths(beginnings: DataFrame, depth: int = DEPTH, max_children: int = MAX_CHILDREN) -> DataFrame:
    """`root, word_count, head, path`.  What comes later never moves what was there before, so beginnings can be added to those of earlier runs."""
    out = beginnings.withColumn("path", F.when(F.col("root") == "", F.expr("cast(array() as array<string>)")).otherwise(F.array("root")))
    for k in range(depth):
        came = F.min("first").over(Window.partitionBy("word_count", "path", F.get("head", F.lit(k))))
        out = out.withColumn("came", came)
        rank = F.dense_rank().over(Window.partitionBy("word_count", "path").orderBy("came"))
        step = F.when(F.col("rank") <= max_children, F.concat(F.lit("L"), F.get("head", F.lit(k)))).otherwise("W")
        out = out.withColumn("rank", rank).withColumn("path", F.when(F.col("word_count") > k, F.concat("path", F.array(step))).otherwise(F.col("path")))
    return out.select("root", "word_count", "head", "path")


def route(records: DataFrame, depth: int = DEPTH, max_children: int = MAX_CHILDREN, shard: str | None = None, beginnings: DataFrame | None = None) -> DataFrame:
    """Adds `path` (array of L + word, or W for the shared child) to records with `record_id, tokens, word_count`.

    With `shard`, a column, every value of it has a tree of its own.  `beginnings` are those of all records so far, if these are not all.
    """
    own = heads(records, depth, shard) if beginnings is None else beginnings
    root = F.concat(F.lit("S"), F.coalesce(F.col(shard).cast("string"), F.lit(""))) if shard else F.lit("")
    rows = records.withColumns({"head": F.slice("tokens", 1, max(1, depth)), "root": root})
    return rows.join(paths(own, depth, max_children), ["root", "word_count", "head"]).drop("head", "root")


def literal_share(path: Column, words: Column) -> Column:
    literal = F.size(F.filter(path, lambda p: p.startswith("L")))
    return F.when(words == 0, F.lit(1.0)).otherwise(literal / words)


def _finish(groups: DataFrame) -> DataFrame:
    return groups.withColumn("template_id", T.template_id("tokens")).withColumn("pattern", T.render("tokens")).withColumn("wildcard_count", T.wildcards("tokens"))


def closed_templates(routed: DataFrame) -> DataFrame:
    """One template a leaf: `word_count, path, tokens, count, first_record_id, template_id, pattern, wildcard_count`."""
    keys = ["word_count", "path"]
    spots = routed.select(*keys, "record_id", F.posexplode_outer("tokens").alias("pos", "tok"))
    spots = spots.groupBy(*keys, "pos").agg(F.min("tok").alias("low"), F.max("tok").alias("high"), F.count("*").alias("count"), F.min("record_id").alias("first_record_id"))
    spot = F.when(F.col("pos").isNotNull(), F.struct("pos", F.when(F.col("low") == F.col("high"), F.col("low")).alias("tok")))
    tokens = F.transform(F.array_sort(F.collect_list(spot)), lambda s: s["tok"])  # a row for each position
    return _finish(spots.groupBy(*keys).agg(tokens.alias("tokens"), F.max("count").alias("count"), F.min("first_record_id").alias("first_record_id")))


def online(messages: list[list[str]], threshold: float) -> tuple[list[list[str | None]], list[int]]:
    """Templates and each message's template, for the messages of one leaf in order.

    Best share of agreeing positions, then fewest wildcards, then the oldest; a template below the threshold is not joined.
    """
    templates: list[list[str | None]] = []
    chosen: list[int] = []
    memory: dict[tuple[str, ...], int] = {}
    for words in messages:
        key = tuple(words)
        if key not in memory:
            best = None
            for i, t in enumerate(templates):
                same = sum(b is None or a == b for a, b in zip(words, t, strict=True))
                rank = (same / len(t) if t else 1.0, -sum(b is None for b in t), -i)
                if best is None or rank > best[0]:
                    best = rank, i
            if best is not None and best[0][0] >= threshold:
                i = best[1]
                new = [a if a == b else None for a, b in zip(words, templates[i], strict=True)]
                if new != templates[i]:
                    templates[i], memory = new, {}
            else:
                i = len(templates)
                templates.append(list(words))
                memory = {}
            memory[key] = i
        chosen.append(memory[key])
    return templates, chosen


class Leaf:
    """The templates of an order-dependent leaf while its messages pass; only words of templates are remembered."""

    def __init__(self, width: int, templates: list[list[str | None]] = ()) -> None:  # noqa: B006
        self.width, self.n = width, 0
        self.number: dict[str, int] = {}
        self.words: list[str] = []
        self.known = np.full((16, width), -2, dtype=np.int64)
        self.wild = np.zeros(16, dtype=np.int64)
        for t in templates:
            self.add(t)

    def add(self, template: list[str | None]) -> int:
        if self.n == len(self.known):
            self.known, self.wild = np.concatenate([self.known, np.full_like(self.known, -2)]), np.concatenate([self.wild, np.zeros_like(self.wild)])
        for at, w in enumerate(template):
            if w is not None and w not in self.number:
                self.number[w] = len(self.words)
                self.words.append(w)
            self.known[self.n, at] = -1 if w is None else self.number[w]
        self.wild[self.n] = (self.known[self.n] == -1).sum()
        self.n += 1
        return self.n - 1

    def take(self, message: list[str], threshold: float) -> int | None:
        """The number of the template that a message makes or changes; None if one has all its words already."""
        row = np.array([self.number.get(w, -3) for w in message], dtype=np.int64)
        known = self.known[: self.n]
        if not self.n:
            return self.add(message)
        same = ((known == row) | (known == -1)).sum(1)
        most = same.max()
        if (most / self.width if self.width else 1.0) < threshold:
            return self.add(message)
        if most == self.width:
            return None
        near = np.flatnonzero(same == most)
        i = int(near[np.argmin(self.wild[near])])  # the first of those with the fewest wildcards
        known[i][known[i] != row] = -1
        self.wild[i] = (known[i] == -1).sum()
        return i

    def template(self, i: int) -> list[str | None]:
        return [None if c < 0 else self.words[c] for c in self.known[i].tolist()]


def evolve(messages: list[list[str]], first: list[int], threshold: float, templates: list[list[str | None]] = ()) -> tuple[list[list[str | None]], list[list[tuple[int, int]]]]:  # noqa: B006
    """What evolved() finds, of one leaf's distinct messages in a list, in the order of their `first` records: its templates, beginning
    with `templates`, and for each message the records from which on a template is its own."""
    leaf = Leaf(len(messages[0]) if messages else 0, templates)
    versions = [(-1, k, list(t)) for k, t in enumerate(templates)]
    for m, at in zip(messages, first, strict=True):
        i = leaf.take(m, threshold)
        if i is not None:
            versions.append((at, i, leaf.template(i)))
    since: list[list[tuple[int, int]]] = []
    for m, began in zip(messages, first, strict=True):
        live: dict[int, int] = {}
        mine: dict[int, int] = {}
        for at, k, t in versions:
            if all(y is None or x == y for x, y in zip(m, t, strict=True)):
                live[k] = t.count(None)
            if live:
                mine[max(at, began)] = min(live, key=lambda k: (live[k], k))
        since.append(list(mine.items()))
    return [leaf.template(i) for i in range(leaf.n)], since


LEAF = ["word_count", "path"]
#: Versions of templates: that with number `k` of its leaf has had `tokens` since the record `at`.
VERSIONS = "word_count int, path array<string>, k int, at long, tokens array<string>"
#: Records of each leaf that go through the loop before all others are held against its templates, and templates that one row lists.
AHEAD, PAGE = 1000, 64


def _grow(threshold: float):  # noqa: ANN202
    """Of sorted leaves, in each the templates that it has (with `k`) and then messages, the versions that the messages make."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: tuple[int, list[str]] | None = None
        leaf = Leaf(0)
        kinds = (pa.int32(), pa.list_(pa.string()), pa.int32(), pa.int64(), pa.list_(pa.string()))
        names = ["word_count", "path", "k", "at", "tokens"]
        for b in batches:
            made: list[tuple] = []
            for words, path, k, at, tokens in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                if (words, path) != here:
                    here, leaf = (words, path), Leaf(words)
                if k is not None:
                    leaf.add(tokens)
                elif (i := leaf.take(tokens, threshold)) is not None:
                    made.append((words, path, i, at, leaf.template(i)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], t) for i, t in enumerate(kinds)], names)

    return run


def _latest(versions: DataFrame) -> DataFrame:
    return versions.groupBy(*LEAF, "k").agg(F.max_by("tokens", "at").alias("tokens"))


def _grown(messages: DataFrame, templates: DataFrame | None, threshold: float) -> DataFrame:
    """Versions that `messages` make of `templates`; a leaf streams through a task that holds its templates only."""
    rows = messages.select(*LEAF, F.lit(None).cast("int").alias("k"), F.col("record_id").alias("at"), "tokens")
    if templates is not None:
        rows = rows.unionByName(templates.select(*LEAF, "k", F.lit(None).cast("long").alias("at"), "tokens"))
    # by a hash of its own, for a shuffle that repeats one before would be left out, and what is before may change while it runs
    placed = rows.repartition(F.xxhash64(*LEAF)).sortWithinPartitions(*LEAF, F.col("k").asc_nulls_last(), "at")
    return written(placed.mapInArrow(_grow(threshold), VERSIONS), "versions")


def _owned(rows: DataFrame, versions: DataFrame, page: int) -> DataFrame:
    """Adds `k`: of the versions of its leaf at a record's time that have all its words, that with the fewest wildcards, then the oldest.

    A leaf with more than `page` templates has them in several lists; what these say of a record is put together.
    """
    until = F.lead("at", 1, (1 << 63) - 1).over(Window.partitionBy(*LEAF, "k").orderBy("at"))
    literals = F.filter(F.transform("tokens", lambda t, i: F.struct(i.alias("pos"), t.alias("tok"))), lambda w: w["tok"].isNotNull())
    one = F.struct(T.wildcards("tokens").alias("wild"), "k", "at", "until", literals.alias("words"))
    lists = versions.withColumn("until", until).groupBy(*LEAF, F.floor(F.col("k") / page).alias("page")).agg(F.collect_list(one).alias("versions"))
    lists = lists.withColumn("lists", F.count("*").over(Window.partitionBy(*LEAF)))
    has = lambda words: F.forall(words, lambda w: F.get("tokens", w["pos"]) == w["tok"])
    fits = lambda v: (v["at"] <= F.col("record_id")) & (F.col("record_id") < v["until"]) & has(v["words"])
    best = F.array_min(F.transform(F.filter("versions", fits), lambda v: F.struct(v["wild"].alias("wild"), v["k"].alias("k"))))
    columns = [*rows.columns, "k"]
    few = rows.join(lists.filter("page = 0").drop("page"), LEAF, "left").filter("coalesce(lists, 1) = 1").withColumn("k", best["k"])
    keys = [*LEAF, "record_id", "tokens"]
    found = rows.select(*keys).join(lists.filter("lists > 1"), LEAF).withColumn("best", best).filter("best is not null").groupBy(*keys).agg(F.min("best")["k"].alias("k"))
    many = rows.join(lists.filter("page = 0 and lists > 1").select(*LEAF), LEAF, "left_semi").join(found, keys, "left")
    return few.select(*columns).unionByName(many.select(*columns))


def evolved(routed: DataFrame, threshold: float = THRESHOLD, earlier: DataFrame | None = None, ahead: int = AHEAD, page: int = PAGE) -> tuple[DataFrame, DataFrame]:
    """Templates `word_count, path, k, tokens` of order-dependent leaves, and the records with their template's number `k`.

    A template only ever gets more general, so a message that one has all words of changes nothing, then and later.  The first `ahead`
    records of each leaf go through the loop; of the others only those that no template has by then.  `earlier` are templates of the
    same columns that the leaves had before.
    """
    ship(routed.sparkSession)
    messages = routed.select(*LEAF, "record_id", "tokens")
    always = lambda templates: templates.select(*LEAF, "k", F.lit(-(1 << 63)).cast("long").alias("at"), "tokens")
    missed = lambda templates: _owned(messages, always(templates), page).filter("k is null").drop("k")
    rank = F.row_number().over(Window.partitionBy(*LEAF).orderBy("record_id"))
    if earlier is not None:
        messages = written(missed(earlier), "missed")  # templates only get more general, so the others stay theirs
    first = messages.withColumn("rank", rank).filter(F.col("rank") <= ahead).drop("rank")
    versions = _grown(first, earlier, threshold)
    versions = versions if earlier is None else always(earlier).unionByName(versions)
    versions = versions.unionByName(_grown(missed(_latest(versions)), _latest(versions), threshold))
    return _latest(versions), _owned(routed, versions, page)


def online_assigned(routed: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Records of order-dependent leaves, with `template` (of the whole run) and `template_id`; further columns stay."""
    templates, rows = evolved(routed, threshold)
    named = templates.withColumnRenamed("tokens", "template").withColumn("template_id", T.template_id("template"))  # once for a template
    return rows.join(named, LEAF + ["k"]).select(*routed.columns, "template", "template_id")


def online_templates(routed: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The templates of leaves by the online loop, with the columns of `closed_templates`."""
    own = online_assigned(routed.select("record_id", "word_count", "path", "tokens"), threshold)
    out = own.groupBy("word_count", "path", F.col("template").alias("tokens")).agg(F.count("*").alias("count"), F.min("record_id").alias("first_record_id"))
    return _finish(out)


def mine(records: DataFrame, depth: int = DEPTH, max_children: int = MAX_CHILDREN, threshold: float = THRESHOLD) -> DataFrame:
    """Templates of `record_id, message`: closed leaves by aggregation, the others by the online loop.  Routed records are written once for both."""
    routed = written(route(tokenised(records), depth, max_children).select("record_id", "word_count", "path", "tokens"), "routed")
    closed = literal_share(F.col("path"), F.col("word_count")) >= threshold
    cols = ["word_count", "path", "tokens", "count", "first_record_id", "template_id", "pattern", "wildcard_count"]
    return closed_templates(routed.filter(closed)).select(*cols).unionByName(online_templates(routed.filter(~closed), threshold).select(*cols))


def assigned(records: DataFrame, depth: int = DEPTH, max_children: int = MAX_CHILDREN, threshold: float = THRESHOLD, shard: str | None = None) -> DataFrame:
    """Every record of `record_id, message, ...` with `tokens`, its `template` and `template_id`; values of `shard` are mined apart."""
    routed = written(route(tokenised(records), depth, max_children, shard), "routed")
    closed = literal_share(F.col("path"), F.col("word_count")) >= threshold
    shut = routed.filter(closed)
    return assign(shut, closed_templates(shut)).unionByName(online_assigned(routed.filter(~closed), threshold))


def parsed(templates: DataFrame) -> DataFrame:
    """`template_id, template, word_count` of `template_id, pattern`; the id tells which of the stars are wildcards."""
    words = F.when(F.col("pattern") == "", F.expr("cast(array() as array<string>)")).otherwise(F.split("pattern", " "))
    # a star is a wildcard in most templates; where all stars are words, the id is that of the words alone
    open_ = F.transform(words, lambda t: F.when(t != "*", t))
    template = F.when(T.template_id(open_) == F.col("template_id"), open_).when(T.template_id(words) == F.col("template_id"), words)
    return templates.select("template_id", "pattern").distinct().select("template_id", template.alias("template")).filter("template is not null").withColumn("word_count", F.size("template"))


def covered(tokenised_: DataFrame, known: DataFrame) -> DataFrame:
    """Records `record_id, tokens, word_count` that a known template (see `parsed`) has all words of: `record_id, template_id`.

    The one with the fewest wildcards, then the least id, has the record.  Templates meet records by their number of words and their
    first word where that is no wildcard.
    """
    rows = tokenised_.select("record_id", "tokens", "word_count").withColumn("first", F.get("tokens", F.lit(0)))
    known = known.withColumn("first", F.get("template", F.lit(0)))
    fits = F.forall(F.arrays_zip("tokens", "template"), lambda z: z["template"].isNull() | (z["template"] == z["tokens"]))
    by_word = rows.join(known.filter("first is not null"), ["word_count", "first"])
    by_size = rows.join(known.filter("first is null").drop("first"), "word_count")
    hits = by_word.select("record_id", "tokens", "template", "template_id").unionByName(by_size.select("record_id", "tokens", "template", "template_id")).filter(fits)
    best = F.min(F.struct(F.size(F.filter("template", lambda t: t.isNull())).alias("wild"), "template_id"))["template_id"]
    return hits.groupBy("record_id").agg(best.alias("template_id"))


def templates_of(assigned_: DataFrame) -> DataFrame:
    """`template_id, pattern, tokens, word_count, wildcard_count, count, first_record_id` of assigned records, a row for each pattern."""
    out = assigned_.groupBy("template_id", "word_count").agg(F.first("template").alias("tokens"), F.count("*").alias("count"), F.min("record_id").alias("first_record_id"))
    return _finish(out)


def assign(routed: DataFrame, templates: DataFrame) -> DataFrame:
    """Records of closed leaves with their template's id."""
    return routed.join(templates.select("word_count", "path", "template_id", F.col("tokens").alias("template")), ["word_count", "path"])


def examples(assigned: DataFrame, n: int = EXAMPLES) -> DataFrame:
    """The first n messages of each template."""
    rank = F.row_number().over(Window.partitionBy("template_id").orderBy("record_id"))
    first = assigned.withColumn("rank", rank).filter(F.col("rank") <= n)
    return first.groupBy("template_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "message"))), lambda s: s["message"]).alias("examples"))


def source_paths(assigned: DataFrame, path: str = "source_path") -> DataFrame:
    """Distinct non-empty paths of each template in order of arrival, with counts."""
    by = assigned.filter(F.col(path) != "").groupBy("template_id", F.col(path).alias("path")).agg(F.min("record_id").alias("first"), F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("first", "path", "n")))
    return by.groupBy("template_id").agg(F.transform(ordered, lambda s: F.struct(s["path"], s["n"])).alias("paths"), F.sum("n").alias("count"))


def _families(templates: DataFrame, groups: list[str], shard: str | None) -> DataFrame:
    """Templates with the `family` they belong to and, as `tokens`, what its members have in common."""
    masked = templates.select("template_id", *groups, *([shard] if shard else []), F.posexplode("tokens").alias("pos", "tok"), "tokens")
    masked = masked.withColumn("mask", F.expr("transform(tokens, (t, i) -> if(i = pos, 'W', coalesce('L' || t, 'W')))"))
    keys = [*groups, "pos", "mask"]
    met = masked.groupBy(*keys).agg(F.countDistinct("template_id").alias("n"), F.countDistinct(shard).alias("shards") if shard else F.lit(2).alias("shards"))
    first = masked.join(met.filter("n > 1 and shards > 1"), keys).groupBy("template_id").agg(F.min(F.struct("pos", F.array_join("mask", " ").alias("mask"))).alias("m"))
    out = templates.join(first, "template_id", "left")
    named = F.coalesce(F.concat(F.col("m.pos").cast("string"), F.lit(":"), F.col("m.mask")), F.concat(F.lit("-:"), F.col("template_id").cast("string")))
    return out.withColumn("family", named).withColumn("tokens", F.when(F.col("m").isNotNull(), F.expr("transform(tokens, (t, i) -> if(i = m.pos, null, t))")).otherwise(F.col("tokens"))).drop("m")


def merge_similar(templates: DataFrame, groups: list[str] | None = None, shard: str | None = None) -> DataFrame:
    """One pass that joins templates which differ in one word.

    Every template is filed under itself with one position masked, lowest first; the lowest position under which it
    meets another decides.  `groups` are columns that must agree.  With `shard`, a column, templates only meet others of another shard.
    A key has as many rows as a position has words; nothing is compared pair by pair.
    """
    groups = groups or []
    out = _families(templates, groups, shard)
    merged = out.groupBy(*groups, "family").agg(F.min_by("tokens", "first_record_id").alias("tokens"), F.sum("count").alias("count"), F.min("first_record_id").alias("first_record_id"), F.count("*").alias("members"))
    return _finish(merged.drop("family"))


def merged_records(assigned_: DataFrame, shard: str | None = None) -> DataFrame:
    """Assigned records whose templates went through the merge pass; with `shard`, a column, only templates that differ in it meet."""
    templates = templates_of(assigned_)
    if shard:
        templates = templates.join(assigned_.select("template_id", F.coalesce(F.col(shard).cast("string"), F.lit("")).alias("_shard")).distinct(), "template_id")
    out = _families(templates, [], "_shard" if shard else None).select("template_id", F.col("tokens").alias("template")).distinct()
    return assigned_.drop("template").join(out, "template_id").withColumn("template_id", T.template_id("template"))


def verbatim_small(templates: DataFrame, examples: DataFrame, least: int) -> DataFrame:
    """Templates with fewer records than `least` show their first record instead of the pattern."""
    return templates.join(examples, "template_id", "left").withColumn("shown", F.when(F.col("count") < least, F.col("examples")[0]).otherwise(F.col("pattern")))
