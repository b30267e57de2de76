"""Repeated windows of bytes: every byte that a string of `length` bytes covers which also starts elsewhere goes.

The suffixes of all texts are ordered through `length` bytes only, by most-significant-digit passes; suffixes that are equal
then are the repeated windows.  To send every suffix through a shuffle would cost many times the input, so the first pass takes a
digit of each window that equal windows have in common and neighbouring ones mostly share: its anchor, the least hash of `length` / 4
consecutive bytes in it.  Consecutive windows with one anchor are a run, which travels as one row.

1. Runs are counted by anchor.  One that occurs once has no repeated windows.  One whose runs all have equal bytes has only
   repeated ones; nothing is sorted for these, so copies of texts cost no more than others.
2. The other runs are brought together by anchor, each distinct content once, and with its bytes.  They are sorted by digits of
   eight bytes; in every pass only groups of several windows go on.
3. An anchor with more than LARGE contents is not sorted in one task.  Its windows are compared in cells of consecutive
   distances to the anchor, by hashes of 128 bits that are counted over all contents: a cell's windows are all repeated if the bytes of
   all of them occur twice, and none is if the bytes that they have in common occur once.  Other cells are cut into smaller ones,
   down to single windows; contents that are equal there go on as one.

Texts are known by a hash of 128 bits, so equal ones are read once in step 2.  A window is looked for in all texts, its own included, and
matches never cross texts.  Null texts count as empty, shorter ones than `length` have no windows.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import U64, chunks, scramble
from ._shared import Scratch, fresh, lean

#: Contents of an anchor that are sorted in one task, and windows of a cell in each pass over those of larger ones.
LARGE, CELLS = 512, (16, 4, 1)
#: Windows of a text that are hashed at once.
PIECE = 1 << 18
#: Bytes of contents that are sorted at once.
SORTED_BYTES = 1 << 20
_ODD = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An odd number for each byte value; powers of an odd base and of its inverse modulo 2^64."""
    inverse = _ODD
    for _ in range(6):
        inverse = inverse * (2 - _ODD * inverse) % (1 << 64)
    power = lambda b: np.concatenate([np.ones(1, U64), np.multiply.accumulate(np.full(2 * PIECE, b, U64))])
    return scramble(np.arange(256, dtype=U64)) | U64(1), power(_ODD), power(inverse)


def anchored(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of a text with one anchor: the anchors' hashes and places, the first windows and how many they are.

    The anchor is the leftmost of the least hashes in a window, so equal windows have equal ones at equal distances.  A long
    text is cut into pieces; a run that ends at a cut is two, and what differs only by that is found by step 2.
    """
    values, power, inverse = _powers()
    width = max(1, length // 4)
    parts: list[tuple[np.ndarray, ...]] = []
    for begin in range(0, max(0, len(data) - length + 1), PIECE):
        x = np.frombuffer(data, dtype=np.uint8, count=min(PIECE + length - 1, len(data) - begin), offset=begin)
        n, reach = len(x) - width + 1, length - width + 1
        sums = np.zeros(len(x) + 1, U64)
        np.cumsum(values[x] * power[: len(x)], out=sums[1:])
        h = scramble((sums[width:] - sums[:-width]) * inverse[:n])
        # the least hash of `reach` consecutive ones, from the least up to and from the borders of blocks
        low = (h & U64(0xFFFFFFFF00000000)) | np.arange(n, dtype=U64)
        low = np.concatenate([low, np.full(-n % reach, ~U64(0))]).reshape(-1, reach)
        upto, after = np.minimum.accumulate(low, 1).ravel(), np.minimum.accumulate(low[:, ::-1], 1)[:, ::-1].ravel()
        at = (np.minimum(after[: n - reach + 1], upto[reach - 1 : n]) & U64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        parts.append((h[at[first]], at[first] + begin, first + begin, np.diff(np.concatenate([first, [len(at)]]))))
    if not parts:
        return np.zeros(0, U64), *(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def equal_windows(data: np.ndarray, starts: np.ndarray, groups: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of `data` at `starts` that are equal to another one of their group: their numbers, and the class of each.

    A radix sort, most significant digits first: each pass orders what is left by the next eight bytes and lets alone
    what has become unique.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray(shape=(len(data) + 1,), dtype=">u8", buffer=padded.data, strides=(1,))
    left, group = np.arange(len(starts)), groups
    for depth in range(0, length, 8):
        digit = lanes[starts[left] + depth].astype(U64)
        if depth + 8 > length:
            digit >>= U64(8 * (depth + 8 - length))
        order = np.lexsort((digit, group))
        left, group, digit = left[order], group[order], digit[order]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])]) if len(left) else np.zeros(0, bool)
        group = np.cumsum(new)
        several = np.bincount(group)[group] > 1
        left, group = left[several], group[several]
    return left, group


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x, dtype=U64).view(np.int64))


def _runs(length: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, "t"):
                found = [anchored(x, length) for x in texts]
                sizes = [len(f[0]) for f in found]
                anchor, at, first, width = (np.concatenate(c) for c in zip(*found, strict=True))
                own = np.repeat(np.arange(len(texts)), sizes)
                content = np.fromiter((xxhash.xxh3_64_intdigest(texts[i][f : f + w + length - 1], p - f) for i, p, f, w in zip(own.tolist(), at.tolist(), first.tolist(), width.tolist(), strict=True)), U64, len(own))
                k1, k2 = (part.column(c).take(pa.array(own)) for c in ("k1", "k2"))
                yield pa.RecordBatch.from_arrays([_signed(anchor), _signed(content), k1, k2, pa.array(first), pa.array(at - first), pa.array(width)], ["a", "c", "k1", "k2", "first", "place", "width"])

    return run


def _contents(length: int):  # noqa: ANN202
    """The bytes of picked runs, from texts with the runs `picks` in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, "t"):
                rows = [(p, x) for x, own in zip(texts, part.column("picks").to_pylist(), strict=True) for p in own]
                cols = {c: pa.array([p[c] for p, _ in rows], pa.int64()) for c in ("a", "c", "place", "width", "several")}
                cols["data"] = pa.array([x[p["first"] : p["first"] + p["width"] + length - 1] for p, x in rows], pa.binary())
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return run


def _sorted(length: int):  # noqa: ANN202
    """Of contents that come sorted by anchor the repeated windows, as ranges `a, c, low, high` of numbers within the content."""

    def work(rows: pa.Table) -> pa.RecordBatch:
        a, c, width = (rows.column(k).to_numpy() for k in ("a", "c", "width"))
        joined = rows.column("data").combine_chunks()
        ends = np.frombuffer(joined.buffers()[1], dtype=np.int32)[joined.offset : joined.offset + len(joined) + 1].astype(np.int64)
        data = np.frombuffer(joined.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]]
        owner = np.repeat(np.arange(len(a)), width)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(width) - width, width)
        group = np.cumsum(np.concatenate([[True], a[1:] != a[:-1]]))[owner]
        hit = np.sort(equal_windows(data, (ends[:-1] - ends[0])[owner] + number, group, length)[0])
        new = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]])]) if len(hit) else np.zeros(0, bool)
        low, high = (hit[new], hit[np.concatenate([new[1:], [True]])]) if len(hit) else (hit, hit)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a[owner[low]], c[owner[low]], number[low], number[high])], ["a", "c", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        size = 0

        def whole(last: bool) -> pa.Table | None:
            """What is kept, up to the last complete anchor; the rest stays."""
            nonlocal kept, size
            rows = pa.Table.from_batches(kept).combine_chunks()
            a = rows.column("a").to_numpy()
            new = np.flatnonzero(a[1:] != a[:-1])
            to = len(a) if last else int(new[-1]) + 1 if len(new) else 0
            kept = rows.slice(to).to_batches()
            size = 0
            return rows.slice(0, to) if to else None

        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                kept.append(part)
                size += int(np.sum(part.column("width").to_numpy())) + length * len(part)
                if size >= SORTED_BYTES and (rows := whole(False)) is not None:
                    yield work(rows)
        if kept and (rows := whole(True)) is not None:
            yield work(rows)

    return run


CELL = ["a", "cell", "k1", "k2", "o1", "o2"]


def _cells(length: int, size: int):  # noqa: ANN202
    """Cells of `size` windows of contents `a, c, place, data` in their `ranges`: hashes of what all windows of a cell have in common (k1,
    k2), and of the bytes of those that are in the range and where these lie in the cell (o1, o2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hashes = [], []
            for a, c, place, data, ranges in zip(*(batch.column(k).to_pylist() for k in ("a", "c", "place", "data", "ranges")), strict=True):
                for r in ranges:
                    for cell in range((place - r["high"]) // size, (place - r["low"]) // size + 1):
                        first, last = place - (cell * size + size - 1), place - cell * size
                        low, high = max(first, r["low"]), min(last, r["high"])
                        rows.append((a, c, cell, low, high))
                        common = xxhash.xxh3_128_intdigest(data[last : max(last, first + length)])
                        hashes.append((*divmod(common, 1 << 64), *divmod(xxhash.xxh3_128_intdigest(data[low : high + length], (low - first) * size + high - first), 1 << 64)))
            cols = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] if rows else [pa.nulls(0, pa.int64())] * 5
            marks = np.array(hashes, dtype=U64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([*cols, *(_signed(marks[:, k]) for k in range(4))], ["a", "c", "cell", "low", "high", "k1", "k2", "o1", "o2"])

    return run


def _large(scratch: Scratch, data: DataFrame, length: int) -> DataFrame:
    """The repeated windows of contents `a, c, place, width, data` of large anchors, by passes over cells."""
    todo = data.select("a", "c", "place", "data", F.array(F.struct(F.lit(0).cast("long").alias("low"), (F.col("width") - 1).alias("high"))).alias("ranges"))
    found = None
    for size in CELLS:
        cells = scratch.table(todo.mapInArrow(lean(_cells(length, size)), "a long, c long, cell long, low long, high long, k1 long, k2 long, o1 long, o2 long"), f"cells{size}")
        equal = scratch.table(cells.groupBy(*CELL).agg(F.count("*").alias("n"), F.min(F.struct("c", "low", "high")).alias("one")), f"equal{size}")
        here = cells.join(equal.filter("n > 1").select(*CELL), CELL).select("a", "c", "low", "high")
        found = here if found is None else found.unionByName(here)
        unlike = equal.groupBy(*CELL[:4]).agg(F.count("*").alias("m")).filter("m > 1").drop("m")
        ranges = equal.join(unlike, CELL[:4]).groupBy("a", "one.c").agg(F.collect_list(F.struct("one.low", "one.high")).alias("ranges"))  # of one content
        todo = data.select("a", "c", "place", "data").join(ranges, ["a", "c"])
    return found


def spans_of(runs: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal spans of bytes that windows from the first to the last of each run cover."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(runs):
        if out and low <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], high + length)
        else:
            out.append((low, high + length))
    return out


RESULT = T.StructType(
    [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()),
        T.StructField("kept_sha256", T.StringType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("kept", T.BinaryType()),
    ]
)


def _release(df: DataFrame) -> DataFrame:
    """Shuffle files go when the driver collects its garbage; large ones should not wait for that."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df


def repeated_runs(scratch: Scratch, texts: DataFrame, length: int) -> DataFrame:
    """`k1, k2, low, high`: distinct ranges of starts of repeated windows, of the texts `k1, k2, t`."""
    long = texts.filter(F.octet_length("t") >= length)
    table = lambda df, name: _release(scratch.table(df, name))
    runs = table(long.mapInArrow(lean(_runs(length)), "a long, c long, k1 long, k2 long, first long, place long, width long"), "runs")
    anchors = runs.groupBy("a").agg(F.count("*").alias("n"), F.min("c").alias("low"), F.max("c").alias("high")).filter("n > 1")
    anchors = table(anchors.select("a", (F.col("low") != F.col("high")).alias("mixed")), "anchors")
    repeated = table(runs.join(anchors, "a"), "repeated")
    scratch.drop(runs)

    contents = repeated.filter("mixed").groupBy("a", "c").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "first", "place", "width")).alias("pick"))
    contents = table(contents.select("a", "c", "n", "pick.*"), "contents")
    several = contents.groupBy("a").agg(F.count("*").alias("several"))
    picks = contents.join(several, "a").groupBy("k1", "k2").agg(F.collect_list(F.struct("a", "c", "first", "place", "width", "several")).alias("picks"))  # at most a text's own runs
    once = long.dropDuplicates(["k1", "k2"]).join(picks.hint("merge"), ["k1", "k2"]).select("t", "picks")
    data = table(once.mapInArrow(lean(_contents(length)), "a long, c long, place long, width long, several long, data binary"), "data")
    small = data.filter(F.col("several") <= LARGE).repartition("a").sortWithinPartitions("a").mapInArrow(lean(_sorted(length)), "a long, c long, low long, high long")
    places = table(small.unionByName(_large(scratch, data.filter(F.col("several") > LARGE), length)), "places")
    single = contents.filter("n = 1").join(places, ["a", "c"]).select("k1", "k2", (F.col("first") + F.col("low")).alias("low"), (F.col("first") + F.col("high")).alias("high"))
    whole = repeated.filter("not mixed").select("k1", "k2", "first", "width").unionByName(repeated.filter("mixed").join(contents.filter("n > 1").select("a", "c"), ["a", "c"]).select("k1", "k2", "first", "width"))
    whole = whole.select("k1", "k2", F.col("first").alias("low"), (F.col("first") + F.col("width") - 1).alias("high"))
    return table(single.unionByName(whole).distinct(), "ranges")


def remove_repeats(docs: DataFrame, *, text: str = "text", length: int = 200, spans: bool = False, kept: bool = False, into: str = "repeats") -> DataFrame:
    """The rows of `docs` with a struct `into` of `n_bytes, n_removed, n_spans, kept_sha256`, and of `spans` (begin, end) and the `kept` bytes
    if asked for, else null; a column of that name is replaced.  What is kept may end within a character."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    docs = docs.drop(into)
    t = docs[text].cast("string")
    hashes = F.xxhash64(t), F.xxhash64(F.lit(length), t)
    ranges = repeated_runs(scratch, docs.select(hashes[0].alias("k1"), hashes[1].alias("k2"), t.alias("t")).filter("t is not null"), length)
    ranges = ranges.groupBy("k1", "k2").agg(F.collect_list(F.struct("low", "high")).alias("_ranges"))  # at most a text's own windows
    k1, k2, raw, found = (fresh(docs, c) for c in ("_k1", "_k2", "_t", "_ranges"))
    rows = docs.withColumns({k1: hashes[0], k2: hashes[1], raw: t})
    rows = rows.join(ranges.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("_ranges").alias(found)).hint("merge"), [k1, k2], "left").select(*docs.columns, raw, found)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, raw):
                made = []
                for x, own in zip(texts, part.column(found).to_pylist(), strict=True):
                    cut = spans_of([(r["low"], r["high"]) for r in own or ()], length)
                    edges = [0, *(e for s in cut for e in s), len(x)]
                    rest = b"".join(x[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2))
                    made.append({"n_bytes": len(x), "n_removed": len(x) - len(rest), "n_spans": len(cut), "kept_sha256": hashlib.sha256(rest).hexdigest(), "spans": [{"begin": a, "end": b} for a, b in cut] if spans else None, "kept": rest if kept else None})
                kind = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], pa.array(made, kind)], [*columns, into])

    return rows.mapInArrow(lean(run), T.StructType([*docs.schema.fields, T.StructField(into, RESULT)]))
