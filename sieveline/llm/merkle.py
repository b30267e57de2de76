"""A Merkle manifest of a table: a tree of digests for each group, one tree over the groups, and proofs for all leaves.

Nodes are addressed by coordinates: the tree, the level and the index on it.  Up to `fanout` nodes of consecutive indices
are a run, and the digest of a run is a node of the next level, so a leaf's index and its tree's size tell the coordinates of
everything that its proof needs.  The nodes are a written table; coordinates are exploded and looked up there by a join,
ordered, concatenated and folded.

All leaves of a run need the same nodes above their own level, so these are looked up once for the run, and a leaf takes its
siblings from the run itself.  Nodes near a root are needed by everything below: they are copied for every BLOCK runs, and
a lookup goes to the copy of its block, so no key of a join has more than BLOCK rows, however large a group is.  Indices come
from a range-partitioned sort and running sums over its partitions; no task holds a group.

Null values are encoded as `-`.  A null group is a tree of its own, before all others.  Leaves ascend by key, null first, and
by digest where keys are equal.  An empty table has no root and no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import Scratch

FANOUT = 16
#: Runs that share a copy of the nodes above them.
BLOCK = 4096


def digest(value: Column) -> Column:
    return F.sha2(value, 256)


def leaf(fields: Sequence[Column]) -> Column:
    """Digest of a row: each value as its number of UTF-8 bytes, a colon and the value, `-` if null."""
    parts = [f.cast("string") for f in fields]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]))


def _powers(fanout: int) -> list[int]:
    out = [1]
    while out[-1] * fanout < 1 << 62:
        out.append(out[-1] * fanout)
    return out


def _power(level: Column, fanout: int) -> Column:
    return F.element_at(F.array(*[F.lit(p).cast("long") for p in _powers(fanout)]), level.cast("int") + 1)


def _div(value: Column, by: Column) -> Column:
    """Whole division of longs."""
    return F.call_function("div", value, by)


def _up(size: Column, by: Column) -> Column:
    return _div(size + by - 1, by)


def _levels(size: Column, fanout: int) -> Column:
    """Levels of a tree that have more than one node."""
    return F.size(F.filter(F.array(*[F.lit(p).cast("long") for p in _powers(fanout)]), lambda p: p < size))


def indexed(scratch: Scratch, rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """`rows` with `tree` (a string) as a written table, with `index` within the tree in `order`, null first, and the tree's `size`."""
    order = ["tree", *order]
    placed = scratch.table(rows.repartitionByRange(*[F.asc_nulls_first(c) for c in order]).sortWithinPartitions(*[F.asc_nulls_first(c) for c in order]).withColumn("at", F.monotonically_increasing_id()), f"{name}-sorted")
    part = F.shiftrightunsigned("at", 33)
    spans = placed.groupBy("tree", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))  # as many rows as partitions and trees
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = scratch.table(spans.select("tree", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(Window.partitionBy("tree")).alias("size")), f"{name}-spans")
    out = placed.withColumn("part", part).join(spans, ["tree", "part"])
    return scratch.table(out.withColumn("index", F.col("base") + F.col("at") - F.col("first")).drop("at", "part", "first", "base"), name)


def nodes(scratch: Scratch, leaves: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """The nodes `tree, index, size, digest` of each level, from `leaves`; `size` is that of the level.  The last level has the roots only."""
    now = leaves.select("tree", "index", "size", "digest")
    most = now.agg(F.max("size")).first()[0] or 0
    levels = [now]
    while most > 1:
        run = _div(F.col("index"), F.lit(fanout))
        runs = now.filter("size > 1").groupBy("tree", run.alias("run")).agg(F.sort_array(F.collect_list(F.struct("index", "digest"))).alias("own"), F.first("size").alias("size"))
        now = runs.select("tree", F.col("run").alias("index"), _up(F.col("size"), F.lit(fanout)).alias("size"), digest(F.array_join("own.digest", "")).alias("digest"))
        now = scratch.table(now, f"level{len(levels)}")
        levels.append(now)
        most = -(-most // fanout)
    return levels


def roots(levels: list[DataFrame]) -> DataFrame:
    """`tree, digest`: the one node that is left of each tree."""
    tops = [x.filter("size = 1").select("tree", "digest") for x in levels]
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return out


STEP = "array<struct<left:string,right:string>>"


def paths(scratch: Scratch, levels: list[DataFrame], name: str, fanout: int = FANOUT) -> DataFrame:
    """For every run of leaves, `tree, run, size, own, above`: its leaves in order, and what stands beside the way from it to the root.

    `above` has a pair of concatenated digests, left and right, for each level.
    """
    run = _div(F.col("index"), F.lit(fanout))
    runs = levels[0].groupBy("tree", run.alias("run")).agg(F.transform(F.sort_array(F.collect_list(F.struct("index", "digest"))), lambda s: s["digest"]).alias("own"), F.first("size").alias("size"))
    runs = scratch.table(runs, f"{name}-runs")
    table = None
    for k, level in enumerate(levels[1:-1], 1):  # the last level has no siblings
        # runs of leaves below the run that this node is in, in blocks
        span = F.lit(fanout**k).cast("long")
        low = _div(F.col("index"), F.lit(fanout)) * span
        blocks = F.sequence(_div(low, F.lit(BLOCK)), _div(low + span - 1, F.lit(BLOCK)))
        leaf_runs = F.col("size") * F.lit(fanout ** (k - 1)).cast("long")  # at most
        blocks = F.filter(blocks, lambda b: b * BLOCK < leaf_runs)
        copies = level.filter("size > 1").select("tree", F.lit(k).alias("level"), F.col("index").alias("sibling"), F.explode(blocks).alias("block"), "digest")
        table = copies if table is None else table.unionByName(copies)
    steps = F.greatest(_levels(F.col("size"), fanout) - 1, F.lit(0))
    runs = runs.withColumn("steps", steps)
    if table is None:
        return runs.select("tree", "run", "size", "own", F.expr(f"cast(array() as {STEP})").alias("above"))
    table = scratch.table(table, f"{name}-nodes")
    at = runs.filter("steps > 0").select("tree", "run", "size", F.explode(F.sequence(F.lit(1), F.col("steps"))).alias("level"))
    mine = _div(F.col("run"), _power(F.col("level") - 1, fanout))
    first = _div(mine, F.lit(fanout)) * fanout
    last = F.least(first + fanout, _up(F.col("size"), _power(F.col("level"), fanout))) - 1
    wanted = at.withColumn("mine", mine).withColumn("sibling", F.explode(F.filter(F.sequence(first, last), lambda j: j != mine)))
    wanted = wanted.select("tree", "run", "level", "sibling", (F.col("sibling") < F.col("mine")).alias("is_left"), _div(F.col("run"), F.lit(BLOCK)).alias("block"))
    found = wanted.join(table, ["tree", "level", "sibling", "block"])
    found = found.groupBy("tree", "run").agg(F.sort_array(F.collect_list(F.struct("level", "sibling", "is_left", "digest"))).alias("found"))  # a run's siblings of all levels
    out = runs.join(found, ["tree", "run"], "left")
    side = lambda k, left: F.array_join(F.transform(F.filter("found", lambda s: (s["level"] == k) & (s["is_left"] == left)), lambda s: s["digest"]), "")
    above = F.transform(F.sequence(F.lit(1), F.col("steps")), lambda k: F.struct(F.coalesce(side(k, True), F.lit("")).alias("left"), F.coalesce(side(k, False), F.lit("")).alias("right")))
    above = F.when(F.col("steps") > 0, above).otherwise(F.expr(f"cast(array() as {STEP})"))
    return scratch.table(out.select("tree", "run", "size", "own", above.alias("above")), f"{name}-paths")


def beside(fanout: int = FANOUT) -> Column:
    """The whole path of a leaf with `index, size, own, above`: its siblings in its run, then what is above."""
    at = F.pmod("index", F.lit(fanout)).cast("int")
    left = F.array_join(F.slice("own", F.lit(1), at), "")
    right = F.array_join(F.slice("own", at + 2, F.lit(fanout)), "")
    return F.when(F.col("size") > 1, F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), F.col("above"))).otherwise(F.expr(f"cast(array() as {STEP})"))


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and the digests beside its way lead to."""
    return F.aggregate(path, start, lambda now, s: digest(F.concat(s["left"], now, s["right"])))


def manifest(rows: DataFrame, leaf_digest: Column, *, group: str, key: str, carry: Sequence[tuple[str, Column]] = (), fanout: int = FANOUT) -> DataFrame:
    """A row for each row of `rows`: `key`, `leaf`, `subroot` of its group's tree, `root` of the tree over the subroots in the order of
    their groups, `path` (pairs of the concatenated digests left and right, level by level, from the leaf to the root), `index`, `size` and the
    columns of `carry`."""
    scratch = Scratch(rows.sparkSession, "merkle")
    # nulls sort before all groups, and these bytewise
    tree = F.coalesce(F.concat(F.lit("="), rows[group].cast("string")), F.lit("-"))
    leaves = rows.select(tree.alias("tree"), rows[key].alias("_key"), leaf_digest.alias("digest"), *[c.alias(f"_carry_{n}") for n, c in carry])
    leaves = indexed(scratch, leaves, ["_key", "digest"], "leaves")
    levels = nodes(scratch, leaves, fanout)
    runs = paths(scratch, levels, "leaves", fanout)

    subroots = roots(levels).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    subroots = indexed(scratch, subroots, ["name"], "subroots")
    upper = nodes(scratch, subroots, fanout)
    root = roots(upper).select("tree", F.col("digest").alias("root"))
    tops = subroots.withColumn("run", _div(F.col("index"), F.lit(fanout))).join(paths(scratch, upper, "subroots", fanout).drop("size"), ["tree", "run"])
    tops = tops.join(root, "tree").select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "root", beside(fanout).alias("top"))

    # the way from a subroot to the root goes to all runs of its tree, block by block
    count = leaves.groupBy("tree").agg(F.first("size").alias("leaves"))
    last = _div(_up(F.col("leaves"), F.lit(fanout)) - 1, F.lit(BLOCK))
    tops = scratch.table(tops.join(count, "tree").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last))).drop("leaves"), "tops")
    runs = runs.drop("size").withColumn("block", _div(F.col("run"), F.lit(BLOCK))).join(tops, ["tree", "block"])
    runs = scratch.table(runs.select("tree", "run", "own", "above", "top", "subroot", "root"), "ways")
    out = leaves.withColumn("run", _div(F.col("index"), F.lit(fanout))).join(runs, ["tree", "run"])
    return out.select(F.col("_key").alias(key), F.col("digest").alias("leaf"), "subroot", "root", F.concat(beside(fanout), F.col("top")).alias("path"), "index", "size", *[F.col(f"_carry_{n}").alias(n) for n, _ in carry])


def proof(path: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))
