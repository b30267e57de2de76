"""JSON documents of any size and layout, cut into parts that are parsed on their own.

A file is read as pieces between commas, which Spark splits wherever it likes, and pieces are put together to blocks of about
`block` bytes.  What a block does to the state of a parser is summed up without knowing that state: how many containers it closes,
which it opens, how many elements it passes, and what is left over of a text, once if it begins outside a string and once if
inside.  These sums are put together in order, a row for each block, which gives each block the state it begins in.  Knowing
it, all blocks cut out their parts at once: a value that a block has as a whole is a part; a container that it does not is a node
with the number of values seen here, and its values are parts.

A document that is no JSON is left out as a whole; so is one with a key twice in an object, and one that something follows.
"""

from __future__ import annotations

import json
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, written

BLOCK = 4 << 20
_BLANK = b" \t\r\n"
_STRUCTURAL = np.zeros(256, dtype=bool)
_STRUCTURAL[list(b"{}[]:,")] = True
_STEP = np.zeros(256, dtype=np.int64)
_STEP[list(b"{[")] = 1
_STEP[list(b"}]")] = -1


#: A scalar and nothing else; Spark's parser would pass over what follows one.
_SCALAR = re.compile(rb'[ \t\r\n]*(?:"[^"\\\x00-\x1f]*(?:\\.[^"\\\x00-\x1f]*)*"|-?[0-9][0-9.eE+-]*|true|false|null)[ \t\r\n]*\Z', re.DOTALL)


class Broken(ValueError):
    """A document that is no JSON."""


def structure(text: bytes, inside: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places of the structural characters outside of strings that have to be looked at, whether each opens a container that is closed in
    the text, and whether the end is inside a string.  Everything within such a container is passed over."""
    x = np.frombuffer(text, dtype=np.uint8)
    quote = np.flatnonzero(x == 0x22)
    after = quote[(quote > 0) & (x[quote - 1] == 0x5C)]
    if len(after):
        other = np.maximum.accumulate(np.where(x == 0x5C, -1, np.arange(len(x))))
        odd = (after - 1 - other[after - 1]) % 2 == 1
        quote = np.setdiff1d(quote, after[odd], assume_unique=True)
    at = np.flatnonzero(_STRUCTURAL[x])
    at = at[(np.searchsorted(quote, at) + inside) % 2 == 0]
    step = _STEP[x[at]]
    depth = np.cumsum(step)
    # the innermost level that was there before the text or stays open after it
    spine = np.maximum(np.minimum.accumulate(np.minimum(depth, 0)), np.minimum.accumulate(depth[::-1])[::-1]) if len(at) else depth
    seen = np.minimum(depth, depth - step) <= spine
    return at[seen], (depth > spine)[seen], bool((len(quote) + inside) % 2)


class Sum:
    """What a block does to a parser whose state is not known."""

    def __init__(self, text: bytes, inside: bool) -> None:
        at, whole, self.inside = structure(text, inside)
        self.closed, self.passed, self.any = 0, 0, len(at) > 0
        self.opened: list[list] = []  # kind, (raw key, whether what was left over goes before it) or None, elements passed, place in the block
        key: tuple[bytes, bool] | None = None
        last, skip = -1, False
        for place, complete in zip(at.tolist(), whole.tolist(), strict=True):
            c = text[place : place + 1]
            if skip:
                skip = False
            elif c in b"{[" and complete:
                skip = True
            elif c in b"{[":
                self.opened.append([c, key, 0, place])
                key = None
            elif c == b":":
                key = text[last + 1 : place], last < 0
            elif c == b",":
                key = None
                if self.opened:
                    self.opened[-1][2] += 1
                else:
                    self.passed += 1
            else:
                key = None
                if self.opened:
                    self.opened.pop()
                else:
                    self.closed, self.passed = self.closed + 1, 0
            last = place
        self.key, self.tail = key, text[last + 1 :]


class Frame:
    """An open container: kind (the root is R), place, path, depth, a name of its own, for two places can be written alike, and elements
    passed."""

    def __init__(self, kind: bytes, place: str | None, path: str, depth: int, own: str, passed: int = 0) -> None:
        self.kind, self.place, self.path, self.depth, self.own, self.passed = kind, place, path, depth, own, passed
        self.values = 0

    def child(self, key: str | None) -> tuple[str, str, str | None, int, int | None]:
        """place, path, parent, depth and index of the value at hand."""
        if self.kind == b"R":
            return "$", "", None, 0, None
        if self.kind == b"[":
            return f"{self.place}[{self.passed}]", self.path + "[]", self.place, self.depth + 1, self.passed
        if key is None:
            raise Broken("a value without a key")
        return f"{self.place}.{key}", f"{self.path}.{key}" if self.path else key, self.place, self.depth + 1, None


def name(raw: bytes) -> str:
    raw = raw.strip(_BLANK)
    if len(raw) < 2 or raw[:1] != b'"' or raw[-1:] != b'"':
        raise Broken("a key is no string")
    try:
        return json.loads(raw.decode("utf-8", "replace"))
    except ValueError as e:
        raise Broken(str(e)) from None


class State:
    """A parser between two blocks."""

    def __init__(self) -> None:
        self.frames = [Frame(b"R", None, "", -1, "")]
        self.key: str | None = None
        self.tail, self.inside, self.begun = b"", False, False

    def take(self, s: Sum, here: str) -> None:
        """Go on behind the block `here`."""
        if s.closed >= len(self.frames):
            raise Broken("a bracket too many")
        if s.closed:
            del self.frames[-s.closed :]
        self.frames[-1].passed += s.passed
        raw = lambda k: name((self.tail if k[1] else b"") + k[0]) if k else None
        for kind, key, passed, at in s.opened:
            place, path, _, depth, _ = self.frames[-1].child(raw(key))
            self.frames.append(Frame(kind, place, path, depth, f"{here}.{at}", passed))
        self.key = raw(s.key) if s.any else self.key
        self.tail = s.tail if s.any else self.tail + s.tail
        self.inside, self.begun = s.inside, True


def parts(state: State, text: bytes, last: bool, here: str) -> Iterator[tuple]:
    """place, path, parent, depth, index, kind, values, text, own, up: parts and containers of the block `here`, with the names of the container
    and of the one around it; what a container that was open before has got has no path."""
    at, whole, inside = structure(text, state.inside)
    frames, key, tail = state.frames, state.key, state.tail
    before = "," if state.begun and not state.inside else "?" if state.begun else ""
    done = False  # a container has just been the value at hand
    start = 0
    skip = -1
    born: dict[str, tuple] = {}

    def value(raw: bytes, scalar: bool = True) -> tuple:
        if scalar and not _SCALAR.match(raw):
            raise Broken("no value")
        top = frames[-1]
        if top.kind == b"R" and top.values:
            raise Broken("a second document")
        where = top.child(key)
        top.values += 1
        return *where, "value", None, raw, None, top.own

    def left(f: Frame) -> Iterator[tuple]:
        """What a container has got here."""
        if f.own in born:
            where, up = born[f.own]
            yield *where, "object" if f.kind == b"{" else "array", f.values, None, f.own, up
        elif f.kind != b"R" and f.values:
            yield None, None, None, None, None, "values", f.values, None, f.own, None

    for place, complete in zip(at.tolist(), whole.tolist(), strict=True):
        c = text[place : place + 1]
        if skip >= 0:
            yield value(text[skip : place + 1], False)
            skip, done, start, before = -1, True, place + 1, "}"
            continue
        segment = tail + text[start:place]
        tail = b""
        blank = not segment.strip(_BLANK)
        top = frames[-1]
        if c in b"{[":
            if not blank or done or (top.kind == b"R" and top.values) or (top.kind == b"{" and key is None):
                raise Broken("an unexpected bracket")
            if complete:
                skip = place
                continue
            where = top.child(key)
            top.values += 1
            frames.append(Frame(c, where[0], where[1], where[3], f"{here}.{place}"))
            born[frames[-1].own] = where, top.own
            key = None
        elif c == b":":
            if top.kind != b"{" or key is not None or done:
                raise Broken("an unexpected colon")
            key = name(segment)
        else:
            if top.kind == b"R" or (c != b"," and (top.kind == b"{") != (c == b"}")):
                raise Broken("an unexpected end of a value")
            if done or not blank:
                if done and not blank:
                    raise Broken("an unexpected value")
                if not done:
                    yield value(segment)
            elif c == b"," or before not in "{[" or not before:
                raise Broken("no value")
            key = None
            if c == b",":
                top.passed += 1
                done = False
            else:
                yield from left(frames.pop())
                done = True
        before, start = c.decode(), place + 1
    tail += text[start:]
    if last:
        if len(frames) > 1 or inside:
            raise Broken("the document has no end")
        if tail.strip(_BLANK) and done:
            raise Broken("a second document")
        if tail.strip(_BLANK):
            yield value(tail)
        elif not done:
            raise Broken("an empty document")
    elif done and tail.strip(_BLANK):
        raise Broken("an unexpected value")
    for f in frames:
        yield from left(f)


def blocks(spark: SparkSession, path: str, block: int) -> DataFrame:
    """`file` (a hash of its name), `start, k` in order and `text`, of files."""
    ship(spark)
    raw = spark.read.text(path, lineSep=",").select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple[int, int] | None = None
        k = size = 0
        kept: list[bytes] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([at[1]]), pa.array([k], pa.int64()), pa.array([b",".join(kept) + b","], pa.binary())], ["file", "start", "k", "text"])

        for b in batches:
            files, starts = b.column("file").to_numpy(), b.column("start").to_numpy()
            cuts = np.flatnonzero((files[1:] != files[:-1]) | (starts[1:] != starts[:-1])) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(files)], strict=True):
                if i == j:
                    continue
                here = int(files[i]), int(starts[i])
                if here != at:
                    if kept:
                        yield out()
                    at, k, size, kept = here, 0, 0, []
                for v in b.column("v").slice(i, j - i).cast(pa.binary()).to_pylist():
                    kept.append(v)
                    size += len(v) + 1
                    if size >= block:
                        yield out()
                        k, size, kept = k + 1, 0, []
        if kept:
            yield out()

    return raw.mapInArrow(run, "file long, start long, k long, text binary")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = [pickle.dumps([vars(Sum(t, False)), vars(Sum(t, True))]) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("file"), b.column("start"), b.column("k"), pa.array(made, pa.binary())], ["file", "start", "k", "sums"])


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state that each block begins in, null from where its document is broken; the last block of a file is marked."""
    file: int | None = None
    state: State | None = None
    row: tuple | None = None

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["file", "start", "k", "state", "last"])

    for b in batches:
        rows = []
        for f, start, k, sums in zip(*(b.column(c).to_pylist() for c in ("file", "start", "k", "sums")), strict=True):
            if row is not None:
                rows.append((*row, f != file))
            if f != file:
                file, state = f, State()
            row = (f, start, k, None if state is None else pickle.dumps(state))
            if state is not None:
                s = Sum.__new__(Sum)
                vars(s).update(pickle.loads(sums)[state.inside])
                try:
                    state.take(s, f"{start}.{k}")
                except Broken:
                    state = None
        yield out(rows)
    if row is not None:
        yield out([(*row, True)])


PARTS = "file long, place string, path string, parent string, depth int, index int, kind string, values long, text string, own string, up string"


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in PARTS.split(", ")]
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x if not isinstance(x, bytes) else x.decode("utf-8", "replace") for x in c], t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)], names)

    for b in batches:
        for f, start, k, text, state, last in zip(*(b.column(c).to_pylist() for c in ("file", "start", "k", "text", "state", "last")), strict=True):
            rows: list[tuple] = []
            try:
                if state is None:
                    raise Broken("a document that ended before")
                for p in parts(pickle.loads(state), text[:-1] if last else text, last, f"{start}.{k}"):
                    rows.append((f, *p))
                    if len(rows) >= 10_000:
                        yield out(rows)
                        rows = []
            except Broken:
                rows.append((f, *[None] * 5, "broken", *[None] * 4))
            yield out(rows)


def cut(spark: SparkSession, path: str, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Of JSON files the parts `doc, place, path, parent, depth, index, v` (a variant), and the containers around them, which have `type` and
    `size` instead of `v`."""
    text = blocks(spark, path, block)
    sums = written(text.mapInArrow(_sums, "file long, start long, k long, sums binary"), "json-sums")
    states = written(sums.repartition("file").sortWithinPartitions("file", "start", "k").mapInArrow(_states, "file long, start long, k long, state binary, last boolean"), "json-states")
    found = text.join(states, ["file", "start", "k"]).mapInArrow(_parts, PARTS)
    found = written(found.withColumn("v", F.try_parse_json("text")).drop("text"), "json-parts")

    broken = found.filter((F.col("kind") == "broken") | ((F.col("kind") == "value") & F.col("v").isNull())).select("file")
    twice = found.filter("path is not null and parent is not null and index is null").groupBy("file", "up", "place").agg(F.count("*").alias("n")).filter("n > 1").select("file")
    names = spark.read.format("binaryFile").load(path).select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_path").alias("doc"))
    good = names.join(written(broken.unionByName(twice).distinct(), "json-broken"), "file", "left_anti")
    values = found.filter("kind = 'value'").join(good, "file").select("doc", "place", "path", "parent", "depth", "index", "v")
    around = found.filter("kind <> 'value'").groupBy("file", "own").agg(*[F.max(c).alias(c) for c in ("place", "path", "parent", "depth", "index")], F.max(F.when(F.col("kind") != "values", F.col("kind"))).alias("type"), F.sum("values").alias("size"))
    return values, around.join(good, "file").select("doc", "place", "path", "parent", "depth", "index", "type", "size")
