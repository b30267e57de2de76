"""Near-duplicates by SuperMinHash signatures, banding, verification on whole sets and union-find grouping.

SuperMinHash: every shingle visits the slots of the signature in a random order of its own and offers slot
`order[j]` the value j + uniform; a slot keeps the least value.  As each shingle's values carry its ranks 0, 1,
2 ..., the slots of one signature are negatively correlated and the estimate has less variance than with
independent hashes.  The orders are the affine maps j -> b + j * a modulo a prime number of slots, which have the
same joint distribution of any two ranks as uniform permutations.  Values offered in round j are at least j, so a
text stops as soon as all its slots are filled; long texts stop after one or two rounds.

Steps: (1) signature, set size and a 128-bit key of each text's set; (2) equal sets become one class; (3) classes
that agree in a band share a bucket, and each is verified, on whole sets, against the smallest id of all its buckets;
(4) components of these links; (5) in buckets that still hold several components, sets leave that have too few
shingles in common with all other components together to be linked with any; (6) the others meet up to HUBS members
that are not in their component yet; (7) (5) again, and what is left is verified against all sets of other
components in its bucket, in blocks of bounded size.  So every pair that
shares a band is verified, ruled out by counting or already joined, no candidate is dropped, and no step forms all pairs of a bucket that
verified sets already hold together.  A hot hub is a skewed join of two tables, which adaptive execution splits.

Defined cases: null and empty texts and texts without words have no shingles and are linked with nothing, each its
own component; rows with a null id take no part (component null, kept); rows that repeat an id are judged by their
own texts and share the id's result; an empty table gives an empty result; only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._bytes import U64, Words, chunks, scramble
from ._shared import Scratch, lean
from .graph import components

#: Sets of a bucket are compared in blocks of about so many sets and shingles.
BLOCK, BLOCK_SHINGLES = 100, 1_000_000
#: Members of its buckets that a set meets in the second round.
HUBS = 8
#: Columns (distinct shingles) of the matrices that count common shingles.
WIDTH = 4096
#: Bits of the bitmap that tells which texts are read again (4 MB).
BITS = 25
EMPTY = U64(0xFFFFFFFFFFFFFFFF)


def signatures(shingles: np.ndarray, begin: np.ndarray, slots: int) -> np.ndarray:
    """SuperMinHash signatures, a row for each text; `slots` is a prime below 256.  Texts without shingles keep EMPTY."""
    n = len(begin) - 1
    sig = np.full(n * slots, EMPTY, dtype=U64)
    rows = sig.reshape(n, slots)
    text = np.repeat(np.arange(n), np.diff(begin))
    seed = scramble(shingles + U64(0xD1B54A32D192ED03))
    step = (1 + (seed >> U64(32)) % U64(slots - 1)).astype(np.int64)
    slot = ((seed & U64(0xFFFFFFFF)) % U64(slots)).astype(np.int64)
    for j in range(slots):
        value = (scramble(shingles + U64((0x9E3779B97F4A7C15 * (j + 1)) & 0xFFFFFFFFFFFFFFFF)) >> U64(8)) | U64(j << 56)
        np.minimum.at(sig, text * slots + slot, value)
        own = np.unique(text)
        open_ = np.zeros(n, dtype=bool)
        open_[own] = (rows[own] == EMPTY).any(axis=1)
        more = open_[text]
        if not more.any():
            break
        shingles, text, step, slot = shingles[more], text[more], step[more], slot[more]
        slot = (slot + step) % slots
    return rows


def band_keys(rows: np.ndarray, bands: int, width: int) -> np.ndarray:
    keys = np.tile(np.arange(1, bands + 1, dtype=U64), (len(rows), 1))
    for k in range(width):
        keys = scramble(keys * U64(0x9E3779B97F4A7C15) + rows[:, k : bands * width : width])
    return keys.view(np.int64)


def _features(words: int, bands: int, width: int, slots: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, "t"):
                s, begin = Words(texts).shingles(words)
                size = np.diff(begin)
                full = size > 0
                keys = band_keys(signatures(s, begin, slots)[full], bands, width)
                k1, k2 = np.zeros(len(size), U64), np.zeros(len(size), U64)
                if full.any():
                    k1[full] = np.add.reduceat(scramble(s), begin[:-1][full])
                    k2[full] = np.bitwise_xor.reduceat(scramble(s ^ U64(0xA0761D6478BD642F)), begin[:-1][full])
                at = np.concatenate([np.zeros(1, np.int32), np.cumsum(full * bands)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(size), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.ListArray.from_arrays(pa.array(at), pa.array(keys.ravel()))], names=["id", "n", "k1", "k2", "bands"])

    return run


def _sets(words: int, wanted):  # noqa: ANN001, ANN202
    """Sets of the texts whose bit is set in the bitmap: all candidates, and few others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column("bit").to_numpy()
            batch = batch.filter(pa.array(wanted.value[bit >> 3] >> (bit & 7) & 1 == 1))
            for part, texts in chunks(batch, "t"):
                s, begin = Words(texts).shingles(words)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(begin)), pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(s.view(np.int64)))], names=["id", "n", "shingles"])

    return run


def bitmap(ids: DataFrame, bits: int) -> np.ndarray:
    """Bits of the hashes of a column `id`; the driver gets 2 ** bits of them, however many ids there are."""
    spot = F.pmod(F.xxhash64("id"), F.lit(1 << bits)) + 1  # Spark's bitmaps count from one
    rows = ids.groupBy(F.bitmap_bucket_number(spot).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("b")).collect()
    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for r in rows:
        at = (r["k"] - 1) * len(r["b"])
        out[at : at + len(r["b"])] |= np.frombuffer(r["b"], dtype=np.uint8)
    return out


def common(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of `left` with each of `right`; sets as (elements, begins)."""
    nl, nr = len(left[1]) - 1, len(right[1]) - 1
    owner = np.concatenate([np.repeat(np.arange(nl), np.diff(left[1])), nl + np.repeat(np.arange(nr), np.diff(right[1]))])
    _, col = np.unique(np.concatenate([left[0], right[0]]), return_inverse=True)
    in_left = np.bincount(col[owner < nl], minlength=(col.max() + 1) if len(col) else 0) > 0
    in_right = np.bincount(col[owner >= nl], minlength=len(in_left)) > 0
    number = np.cumsum(in_left & in_right) - 1
    keep = (in_left & in_right)[col] if len(col) else np.zeros(0, bool)
    owner, col = owner[keep], number[col[keep]]
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    out = np.zeros((nl, nr), dtype=np.int64)
    for at in range(0, int(col[-1]) + 1 if len(col) else 0, WIDTH):
        a, b = np.searchsorted(col, [at, at + WIDTH])
        m = np.zeros((nl + nr, WIDTH), dtype=np.float32)
        m[owner[a:b], col[a:b] - at] = 1
        out += np.rint(m[:nl] @ m[nl:].T).astype(np.int64)
    return out


def spanning(pairs: np.ndarray) -> list[tuple[int, int]]:
    """A forest with the components of the pairs."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for a, b in pairs.tolist():
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _verify(percent: int):  # noqa: ANN202
    def run(table: pa.Table) -> pa.Table:
        side = table.column("open").to_numpy(zero_copy_only=False).astype(bool)
        ids, own, sizes = (table.column(c).to_numpy() for c in ("id", "c", "n"))

        def of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            lists = table.column("shingles").filter(pa.array(mask)).combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            return lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes[mask])])

        if side.all() or not side.any():
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        both = common(of(side), of(~side))
        union = sizes[side][:, None] + sizes[~side][None, :] - both
        i, j = np.nonzero((100 * both >= percent * union) & (own[side][:, None] != own[~side][None, :]))
        found = spanning(np.stack([own[side][i], own[~side][j]], axis=1))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    return run


def _alike(n: str, own: str, other_n: str, other: str, percent: int) -> Column:
    """Whether two sets are linked; sets of too different sizes are not compared."""
    both = F.size(F.array_intersect(own, other))
    return (100 * F.least(n, other_n) >= percent * F.greatest(n, other_n)) & (100 * both >= percent * (F.col(n) + F.col(other_n) - both))


def _open(scratch: Scratch, members: DataFrame, found: DataFrame) -> DataFrame:
    """`band, id, n, c, least_n` of the buckets (band, id, n) that hold several components c; of buckets with equal members, one."""
    own = members.join(found.hint("merge"), F.col("id") == F.col("node"), "left").select("band", "id", "n", F.coalesce("root", "id").alias("c"))
    own = scratch.table(own, "own")
    sums = own.groupBy("band").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.min("n").alias("least_n"), F.count("*").alias("k"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    kept = sums.filter("low <> high").groupBy("k", "x", "y").agg(F.min(F.struct("band", "least_n")).alias("b")).select("b.*")
    out = scratch.table(own.join(scratch.table(kept, "open").hint("merge"), "band"), "several")
    scratch.drop(own)
    return out


def _linkable(scratch: Scratch, open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Members `band, id, n` that can be linked with another component of their bucket, judged by shingles that no other component has.

    A set's intersection with any set of another component is at most the number of its shingles that several of
    all these components have; its partner has at least the bucket's least size.
    """
    own = open_.select("id", "c").distinct().join(sets.hint("merge"), "id").select("id", "c", F.explode("shingles").alias("s"))
    same = Window.partitionBy("s")  # a set has a shingle once, so no shingle has more than a small share of the rows
    shared = own.withColumns({"low": F.min("c").over(same), "high": F.max("c").over(same)}).filter("low <> high")
    support = scratch.table(shared.groupBy("id").agg(F.count("*").alias("support")), "support")
    partner = F.greatest("least_n", F.ceil(F.col("n") * percent / 100))
    fits = F.col("support") * (100 + percent) >= percent * (F.col("n") + partner)
    out = scratch.table(open_.join(support.hint("merge"), "id").filter(fits).select("band", "id", "n"), "linkable")
    scratch.drop(support)
    return out


def _linked(scratch: Scratch, pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs `id, hub, ...` whose sets are alike."""
    hubs = sets.select(F.col("id").alias("hub"), F.col("n").alias("hub_n"), F.col("shingles").alias("hub_set"))
    met = sets.join(pairs.hint("merge"), "id").join(hubs.hint("merge"), "hub")
    return scratch.table(met.filter(_alike("n", "shingles", "hub_n", "hub_set", percent)).select(*pairs.columns), "linked")


def _more_hubs(scratch: Scratch, open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links `a, b` of components: every set meets up to HUBS members of its buckets that are in other components.

    A hub is a bucket's least member in an order of its own, so most of what is like a large component joins it here.
    """
    order = lambda k, who: F.xxhash64(who, F.lit(k))
    hubs = open_.groupBy("band").agg(F.array(*[F.min_by(F.struct("id", "c"), order(k, "id")) for k in range(HUBS)]).alias("hubs"))
    hubs = scratch.table(hubs, "hubs")
    seen = open_.join(hubs.hint("merge"), "band")
    best = [F.min_by(F.get("hubs", F.lit(k)), F.when(F.get("hubs", F.lit(k))["c"] != F.col("c"), order(k, F.get("hubs", F.lit(k))["id"]))) for k in range(HUBS)]
    one = seen.groupBy("id", "c").agg(F.array_distinct(F.array(*best)).alias("hubs")).select("id", "c", F.inline("hubs").alias("hub", "hub_c"))
    pairs = scratch.table(one.filter("hub is not null and hub_c <> c"), "pairs")
    return _linked(scratch, pairs, sets, percent).select(F.col("c").alias("a"), F.col("hub_c").alias("b"))


def _blocks(scratch: Scratch, open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links `a, b` of components: in every bucket of `band, id, c`, all sets of different components are compared, block by block.

    A bucket's commonest component is not compared with itself; the others meet everything.
    """
    by = open_.groupBy("band", "c").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    plan = by.groupBy("band").agg(F.sum("k").alias("k"), F.sum("n").alias("n"), F.max(F.struct("k", "c", "n")).alias("m"))
    blocks = lambda k, n: (F.ceil(k / BLOCK) + F.floor(n / BLOCK_SHINGLES)).cast("int")
    plan = scratch.table(plan.select("band", F.col("m.c").alias("main"), blocks(F.col("k"), F.col("n")).alias("wide"), blocks(F.col("k") - F.col("m.k"), F.col("n") - F.col("m.n")).alias("deep")), "plan")
    member = scratch.table(open_.drop("n").join(plan.hint("merge"), "band"), "spread")
    spot = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    every = member.select("band", "id", "c", F.lit(False).alias("open"), spot("wide").alias("x"), F.explode(F.sequence(F.lit(0), F.col("deep") - 1)).alias("y"))
    rest = member.filter("c <> main").select("band", "id", "c", F.lit(True).alias("open"), F.explode(F.sequence(F.lit(0), F.col("wide") - 1)).alias("x"), spot("deep").alias("y"))
    tasks = every.unionByName(rest).join(sets.hint("merge"), "id").select("band", "x", "y", "open", "id", "c", "n", "shingles")
    links = scratch.table(tasks.groupBy("band", "x", "y").applyInArrow(_verify(percent), "a long, b long"), "links")
    scratch.drop(member, plan)
    return links


def _joined(scratch: Scratch, found: DataFrame, links: DataFrame) -> DataFrame:
    """`node, root` after links `a, b` between roots; a root may be a node that `found` does not have."""
    over = scratch.table(components(scratch, links).select(F.col("node").alias("root"), F.col("root").alias("least")), "over")
    # by one aggregate: a large component's root occurs in most links
    ends = links.select(F.explode(F.array("a", "b")).alias("node"), F.lit(None).cast("long").alias("root"))
    known = found.unionByName(ends).groupBy("node").agg(F.coalesce(F.max("root"), F.col("node")).alias("root"))
    return scratch.table(known.join(over.hint("merge"), "root", "left").select("node", F.coalesce("least", "root").alias("root")), "joined")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, bands: int = 30, width: int = 5, slots: int = 151) -> DataFrame:
    """`doc_id, n_shingles, component_id, kept`: texts whose sets have 100 * |both| >= percent * |either| are linked.

    `bands` of `width` slots miss a pair of similarity s with probability (1 - s ** width) ** bands.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "neardup")
    narrow = docs.select(docs[doc_id].cast("long").alias("id"), docs[text].cast("string").alias("t"))
    feats = scratch.table(narrow.mapInArrow(lean(_features(words, bands, width, slots)), "id long, n long, k1 long, k2 long, bands array<long>"), "features")
    classes = scratch.table(feats.filter("n > 0 and id is not null").groupBy("n", "k1", "k2").agg(F.min("id").alias("id"), F.min_by("bands", "id").alias("bands")), "classes")

    # every class meets the least id of all its buckets
    banded = classes.select("id", "n", F.explode("bands").alias("band"))
    buckets = scratch.table(banded.groupBy("band").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least <> most").select("band", "least"), "buckets")
    members = scratch.table(banded.join(buckets.hint("merge"), "band"), "members")
    scratch.drop(buckets)
    stars = scratch.table(members.groupBy("id").agg(F.min("least").alias("hub")), "stars")
    wanted = spark.sparkContext.broadcast(bitmap(stars.select("id"), BITS))
    texts = narrow.filter("id is not null").select("id", F.pmod(F.xxhash64("id"), F.lit(1 << BITS)).alias("bit"), "t")
    # an id that is repeated with other texts is judged by the text of its class
    sets = scratch.table(texts.mapInArrow(lean(_sets(words, wanted)), "id long, n long, shingles array<long>").filter("n > 0"), "sets")
    linked = _linked(scratch, stars.filter("id <> hub"), sets, percent)
    found = components(scratch, linked.select(F.col("id").alias("a"), F.col("hub").alias("b")))

    # buckets that still hold several components: more hubs for what can be linked, then blocks for the rest
    for links_of in (_more_hubs, _blocks):
        open_ = _open(scratch, members, found)
        if open_.isEmpty():
            break
        members = _linkable(scratch, open_, sets, percent)
        found = _joined(scratch, found, links_of(scratch, _open(scratch, members, found), sets, percent))
    scratch.drop(sets, members)

    named = classes.select("n", "k1", "k2", "id").join(found.hint("merge"), F.col("id") == F.col("node"), "left")
    named = scratch.table(named.select("n", "k1", "k2", F.coalesce("root", "id").alias("component")), "named")
    scratch.drop(classes)
    out = feats.select("id", "n", "k1", "k2").join(named.hint("merge"), ["n", "k1", "k2"], "left")
    component = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "id"))
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
