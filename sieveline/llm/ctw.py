"""Language-model scores by context-tree weighting over bytes.

The text, folded to lower case with one blank between words and a line end after it, is coded byte by byte, and
each byte as eight binary decisions, the highest bit first.  A decision has a node in the context tree at each
depth 0 to DEPTH: the bits before it in its byte together with that many preceding bytes.  Every node holds
a Krichevsky-Trofimov estimate of its training counts, and the nodes on the path are mixed with the weights of
context-tree weighting: a node weighs its own block probability against the product of its children's.  A path
ends at the deepest node that the training texts reached.  The sum of log2 is the code length; the score is its
log10 and the length per byte is returned too.

Distribution: one pass deals the texts to blocks of about `BLOCK` bytes and counts each block's distinct 6-grams of
bytes (a context of DEPTH bytes and the byte) and words; rows of an equal n-gram meet in a partial aggregation, so
what is gathered grows with the corpus.  The subtrees below the three nearest bytes are worked out in groups of about
`GROUP` n-grams; the nodes at two bytes are sums over them, at most 2 ** 24 of them (256 * 256 contexts with 256 bit
prefixes, whatever the input; some ten thousands in text), and the driver mixes these and the levels above.  The
log-probability of every n-gram that occurs, trained or not, and the count of every word go back to the blocks in
which they occur, by a join, and meet the texts, which travel compressed, there.  So texts are read once more, a task holds one block and its n-grams, and nothing that grows with the corpus
passes through the driver or is broadcast.

Base score: the add-one unigram model of words.

Defined cases: a null or empty text is its end token alone; without training texts every node is empty and each
decision costs one bit; rows that repeat an id are scored each by its own text; rows with a null id belong to
the fold of the empty string; an empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ._bytes import END, U64, Words, chunks, scramble
from ._shared import Scratch, lean

DEPTH = 5
#: Depth at which subtrees are handed out; the levels above are the crown.
TOP = 3
#: Bytes of text in a block, and n-grams in a group of subtrees, about.
BLOCK, GROUP = 32 << 20, 250_000
_GRAM = (1 << 48) - 1
_TARGET = 40
#: Word hashes carry the top bit, n-grams (48 bits) don't; the end token has a key of its own.
_TOP = U64(1 << 63)
END_KEY = -1

# lgamma at n + 1/2 and n + 1, by Stirling's series shifted upward; numpy has none.


def _lgamma(x: np.ndarray) -> np.ndarray:
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift[low] -= np.log(y[low])
        y[low] += 1
    return shift + (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)


def block(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    n0, n1 = np.asarray(n0, np.float64), np.asarray(n1, np.float64)
    return _lgamma(n0 + 0.5) + _lgamma(n1 + 0.5) - math.log(math.pi) - _lgamma(n0 + n1 + 1)


def context(code: np.ndarray, depth: int) -> np.ndarray:
    """The nearest `depth` bytes before the coded byte."""
    return (code >> (_TARGET - 8 * depth)) & ((1 << (8 * depth)) - 1)


def _prefix(byte: np.ndarray, level: int) -> np.ndarray:
    """The first `level` bits of a byte after a leading one: a number from 1 to 255 for levels 0 to 7."""
    return (1 << level) | (byte >> (8 - level))


class Layer:
    """The nodes of one depth and one bit level, with counts of zeros and ones."""

    def __init__(self, key: np.ndarray, bit: np.ndarray, count: np.ndarray) -> None:
        self.keys, self.of = np.unique(key, return_inverse=True)
        self.n1 = np.bincount(self.of, weights=count * bit, minlength=len(self.keys))
        self.n0 = np.bincount(self.of, weights=count * (1 - bit), minlength=len(self.keys))
        self.own = block(self.n0, self.n1)


def mixed(code: np.ndarray, count: np.ndarray, top: int, deep: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]:
    """For distinct n-grams of one subtree: P(bit = the coded one) at depth `top`, a column for each bit, NaN where no node is
    trained there; and for each bit level the nodes at depth `top`: keys, n0, n1, log weighted probability.
    """
    byte = code >> _TARGET
    out = np.full((len(code), 8), np.nan)
    tops = []
    for level in range(8):
        bit = (byte >> (7 - level)) & 1
        below = None
        p = np.full(len(code), np.nan)
        for depth in range(deep, top - 1, -1):
            layer = Layer((context(code, depth) << 8) | _prefix(byte, level), bit, count)
            seen = (layer.n0 + layer.n1)[layer.of] > 0
            kt = (np.where(bit == 1, layer.n1[layer.of], layer.n0[layer.of]) + 0.5) / ((layer.n0 + layer.n1)[layer.of] + 1)
            weighted = layer.own
            if below is not None:
                parent = np.zeros(len(below[0].keys), dtype=np.int64)
                parent[below[0].of] = layer.of
                kids = np.bincount(parent, weights=below[1], minlength=len(layer.keys))
                beta = np.exp(np.clip(layer.own - kids, -700, 700))[layer.of]
                weighted = math.log(0.5) + np.logaddexp(layer.own, kids)
                p = np.where(np.isnan(p), kt, (beta * kt + p) / (beta + 1))
            else:
                p = kt
            p = np.where(seen, p, np.nan)
            below = layer, weighted
        out[:, level] = p
        tops.append((below[0].keys, below[0].n0, below[0].n1, below[1]))
    return out, tops


class Crown:
    """Depths TOP - 1 to 0, from the nodes at depth TOP - 1: keys (context << 8 | bit prefix), counts, sums of the children's log weighted probabilities."""

    def __init__(self, keys: np.ndarray, n0: np.ndarray, n1: np.ndarray, kids: np.ndarray) -> None:
        self.levels = []
        for depth in range(TOP - 1, -1, -1):
            keys, of = np.unique(keys, return_inverse=True)
            n0, n1, kids = (np.bincount(of, weights=x, minlength=len(keys)) for x in (n0, n1, kids))
            own = block(n0, n1)
            self.levels.append((depth, keys, n0, n1, np.exp(np.clip(own - kids, -700, 700))))
            kids = math.log(0.5) + np.logaddexp(own, kids)
            keys = (keys >> 16) << 8 | (keys & 255)  # the nearest byte is highest

    def finish(self, code: np.ndarray, p: np.ndarray) -> np.ndarray:
        """log2 probability of the coded bytes from the bits' probabilities at depth TOP."""
        byte = code >> _TARGET
        total = np.zeros(len(code))
        for level in range(8):
            bit, prefix = (byte >> (7 - level)) & 1, _prefix(byte, level)
            q = p[:, level]
            for depth, keys, n0, n1, beta in self.levels:
                if not len(keys):
                    continue
                key = context(code, depth) << 8 | prefix
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                kt = (np.where(bit == 1, n1[at], n0[at]) + 0.5) / (n0[at] + n1[at] + 1)
                q = np.where(keys[at] == key, np.where(np.isnan(q), kt, (beta[at] * kt + q) / (beta[at] + 1)), np.nan)
            total += np.log2(np.where(np.isnan(q), 0.5, q))
        return total


def grams(words: Words) -> np.ndarray:
    """The n-gram of every byte: DEPTH bytes before it (line ends before a text's begin) and the byte, the oldest lowest."""
    n = len(words.bytes) - 8
    padded = np.concatenate([np.full(DEPTH, END, np.uint8), words.bytes])
    code = np.ndarray(shape=(n,), dtype="<u8", buffer=padded.data, strides=(1,)).astype(np.int64) & _GRAM
    begin = np.concatenate([np.zeros(1, np.int64), words.ends[:-1] + 1])[: words.n]
    ends = int.from_bytes(bytes([END]) * 8, "little")
    for k in range(DEPTH):
        at = begin[begin + k <= words.ends] + k
        low = (1 << (8 * (DEPTH - k))) - 1
        code[at] = (code[at] & ~low) | (ends & low)
    return code


def _word_keys(words: Words) -> np.ndarray:
    """Keys of words, never END_KEY."""
    return ((words.hashes() >> U64(1)) | _TOP).view(np.int64)


def _tally(values: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, and how often each occurs where `learn` is set."""
    d = pa.array(values).dictionary_encode()
    return d.dictionary.to_numpy(), np.bincount(d.indices.to_numpy()[learn], minlength=len(d.dictionary))


_ROWS = ["block", "ids", "learn", "texts", "key", "trained"]


def _packed(texts: list[bytes]) -> bytes:
    return zstandard.compress(np.array([len(t) for t in texts], dtype=np.int64).tobytes() + b"".join(texts))


def _unpacked(data: bytes, n: int) -> list[bytes]:
    data = zstandard.decompress(data)
    ends = (np.cumsum(np.frombuffer(data, dtype=np.int64, count=n)) + 8 * n).tolist()
    return [data[a:b] for a, b in zip([8 * n, *ends], ends, strict=False)]


def _count(size: int):  # noqa: ANN202
    """Rows of packed texts with their block, and rows of a block's distinct n-grams, words and end token with their training counts.

    A block is closed when it has `size` bytes, or n-grams and words for an eighth of that.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, room, kind = TaskContext.get().partitionId() << 32, [], size, None

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, trained = (np.concatenate(x) for x in zip(*held, strict=True))
            keys, of = np.unique(keys, return_inverse=True)
            return keys, np.bincount(of, weights=trained, minlength=len(keys)).astype(np.int64)

        def close() -> pa.RecordBatch:
            keys, trained = merged()
            n = len(keys)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), pa.nulls(n, pa.list_(kind)), pa.nulls(n, pa.list_(pa.bool_())), pa.nulls(n, pa.binary()), pa.array(keys), pa.array(trained)], names=_ROWS)

        for batch in batches:
            for part, texts in chunks(batch, "t"):
                w, kind = Words(texts), part.column("id").type
                learn = part.column("learn").to_numpy(zero_copy_only=False).astype(bool)
                sizes = np.diff(np.concatenate([[-1], w.ends]))
                held += [_tally(grams(w), np.repeat(learn, sizes)), _tally(_word_keys(w), learn[w.text_of]), (np.array([END_KEY]), np.array([learn.sum()]))]
                whole = pa.array([0, part.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.ListArray.from_arrays(whole, part.column("id")), pa.ListArray.from_arrays(whole, part.column("learn")), pa.array([_packed(texts)], pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], names=_ROWS)
                room -= sum(map(len, texts))
                if len(held) > 24:
                    held = [merged()]
                if room <= 0 or 8 * len(held[0][0]) > size:
                    yield close()
                    number, held, room = number + 1, [], size
        if held:
            yield close()

    return run


def _summary(table: pa.Table) -> pa.Table:
    """Of the subtrees of a group: for each node at depth TOP its parent, counts, log weighted probability."""
    code, count = table.column("key").to_numpy(), table.column("trained").to_numpy().astype(np.float64)
    code, count = code[count > 0], count[count > 0]
    if not len(code):
        return pa.table({"node": pa.array([], pa.int64()), "n0": pa.array([], pa.int64()), "n1": pa.array([], pa.int64()), "w": pa.array([], pa.float64())})
    _, tops = mixed(code, count, TOP, DEPTH)
    keys, n0, n1, w = (np.concatenate(x) for x in zip(*tops, strict=True))
    return pa.table({"node": (keys >> 16) << 8 | (keys & 255), "n0": n0.astype(np.int64), "n1": n1.astype(np.int64), "w": w})


def _logs(crown):  # noqa: ANN001, ANN202
    def run(table: pa.Table) -> pa.Table:
        code, count = table.column("key").to_numpy(), table.column("trained").to_numpy().astype(np.float64)
        p, _ = mixed(code, count, TOP, DEPTH)
        return pa.table({"key": code, "value": crown.value.finish(code, p)})

    return run


def _score(total: int, distinct: int, schema: pa.Schema):  # noqa: ANN202
    """The texts of a block, each with its sums; the block's table has the logarithms of n-grams and the counts of words."""

    def run(texts_: pa.Table, known: pa.Table) -> pa.Table:
        keys, values = known.column("key").to_numpy(), known.column("value").to_numpy()
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[order]

        def look(wanted: np.ndarray) -> np.ndarray:
            d = pa.array(wanted).dictionary_encode()
            return values[np.searchsorted(keys, d.dictionary.to_numpy())][d.indices.to_numpy()]

        out, share = [], math.log10(total + distinct + 1)
        for ids, learn, data in zip(*(texts_.column(c) for c in ("ids", "learn", "texts")), strict=True):
            n = len(ids)
            w = Words(_unpacked(data.as_py(), n))
            bits = np.add.reduceat(look(grams(w)), np.concatenate([np.zeros(1, np.int64), w.ends[:-1] + 1]))
            end, count = look(np.array([END_KEY]))[0], look(_word_keys(w))
            base = np.bincount(w.text_of, weights=np.log10(count + 1) - share, minlength=n) + math.log10(end + 1) - share
            seen = np.bincount(w.text_of, weights=count > 0, minlength=n).astype(np.int64) + int(end > 0)
            size = np.diff(np.concatenate([[-1], w.ends]))
            cols = [ids.values, learn.values, w.counts + 1, seen, np.full(n, total), base, bits * math.log10(2), size, -bits / size]
            out.append(pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=schema.names).cast(schema))
        return pa.Table.from_batches(out, schema)

    return run


def score(docs: DataFrame, learn: Column, *, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """`doc_id, learned, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte` for every row.

    The model is trained on the rows for which `learn` holds.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "ctw")
    narrow = docs.select(docs[doc_id].alias("id"), F.coalesce(learn, F.lit(False)).alias("learn"), docs[text].cast("string").alias("t"))
    kind = narrow.schema["id"].dataType.simpleString()
    rows = scratch.table(narrow.mapInArrow(lean(_count(block)), f"block long, ids array<{kind}>, learn array<boolean>, texts binary, key long, trained long"), "blocks", compression="zstd")
    held = rows.filter("key is not null").select("block", "key", "trained")
    counts = scratch.table(held.groupBy("key").agg(F.sum("trained").alias("trained")), "counts")
    words, ngrams = counts.filter("key < 0"), counts.filter("key >= 0")
    total, distinct = words.filter("trained > 0").agg(F.coalesce(F.sum("trained"), F.lit(0)), F.count("*")).first()

    near = F.shiftright("key", _TARGET - 8 * TOP).bitwiseAND(F.lit((1 << 8 * TOP) - 1))
    parts = max(1, math.ceil(ngrams.count() / group))
    trees = ngrams.groupBy(F.pmod(F.xxhash64(near), F.lit(parts)).alias("part"))
    # decimals: a sum is the same in any order
    nodes = trees.applyInArrow(_summary, "node long, n0 long, n1 long, w double").groupBy("node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum(F.col("w").cast("decimal(38,12)")).cast("double").alias("w")).toArrow()
    crown = spark.sparkContext.broadcast(Crown(*[nodes.column(c).to_numpy().astype(t) for c, t in (("node", np.int64), ("n0", np.float64), ("n1", np.float64), ("w", np.float64))]))
    values = trees.applyInArrow(_logs(crown), "key long, value double").unionByName(words.select("key", F.col("trained").cast("double").alias("value")))
    values = scratch.table(values, "values")
    scratch.drop(counts)
    known = held.select("block", "key").join(values.hint("merge"), "key").select(F.col("block").alias("home"), "key", "value")
    texts = rows.filter("texts is not null").select("block", "ids", "learn", "texts")
    schema = f"`{doc_id}` {kind}, learned boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
    run = _score(int(total), int(distinct), to_arrow_schema(_parse_datatype_string(schema)))
    return texts.groupBy("block").cogroup(known.groupBy("home")).applyInArrow(run, schema)
