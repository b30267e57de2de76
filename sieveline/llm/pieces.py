"""SentencePiece encoding and decoding with offsets.

Normalisation is done here: at every place the longest prefix that the model's compiled character map knows (a
double-array trie and a pool of replacements) is replaced, and for every byte of the normalised text the place in
the source text is recorded.  Places where nothing known begins are found by the first bytes of all that the map
knows and copied as they are, so a model with an empty map goes the same way.  Blanks become U+2581 and a leading one is
added, as the model's flags say.

The normalised text is then cut into runs of U+2581 and what follows them.  If no piece of the vocabulary goes on
with U+2581 after another character, no merge crosses such a cut, so every run is segmented on its own and
remembered; the library's merges do that, on the model with its own normaliser switched off.  If some piece does,
the whole text is one run.  The lengths of the pieces then give places in the normalised text, and these give
spans of bytes of the source; spans of one text follow one another and cover it, but for blanks at its ends that the
normaliser drops.  A byte-fallback character's
bytes share its span: the first piece has it, the others are empty.

Defined cases: null and empty texts have no pieces and decode to the empty text; texts of any length are encoded
whole; rows with null or repeated ids are rows like others; an empty table gives an empty result; only id and text
are read.
"""

from __future__ import annotations

import hashlib
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from ._bytes import chunks
from ._shared import lean, prepare

#: Fixed values of the formats: the visible blank, field numbers of the model and its normaliser, piece types.
MARK = "▁"
PIECES, NORMALIZER = 1, 3
MAP, DUMMY_PREFIX, STRIP, ESCAPE = 2, 3, 4, 5
NORMAL, UNKNOWN, BYTE = 1, 2, 6
#: Bytes of segmented runs that a worker remembers; beyond, it starts anew.  Longer runs than LONG are rare and are not remembered.
REMEMBERED, LONG = 32 << 20, 64
#: Bytes that an entry takes beside its run and its ids, about.
ENTRY = 200


def fields(data: bytes) -> list[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message, in order."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value, at

    out, at = [], 0
    while at < len(data):
        key, at = number(at)
        kind = key & 7
        if kind == 0:
            value, at = number(at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = number(at)
            value, at = data[at : at + size], at + size
        out.append((key >> 3, value))
    return out


def message(items: list[tuple[int, int | bytes]]) -> bytes:
    """The inverse of `fields` for numbers and byte strings."""

    def number(x: int) -> bytes:
        out = bytearray()
        while x > 127:
            out.append(x & 127 | 128)
            x >>= 7
        return bytes([*out, x])

    return b"".join(number(f << 3) + number(v) if isinstance(v, int) else number(f << 3 | 2) + number(len(v)) + v for f, v in items)


class CharacterMap:
    """The compiled map: size of the trie in bytes, its 32-bit units, then replacements that end with a zero byte."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if blob else ()
        self.pool = blob[4 + size :]

    def leads(self) -> np.ndarray:
        """For every byte, whether something the map knows begins with it."""
        out = np.zeros(256, dtype=bool)
        for byte in range(256 if self.units else 0):
            node = self._offset(self.units[0]) ^ byte
            out[byte] = node < len(self.units) and self.units[node] & 0x800000FF == byte
        return out

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix of data[at:] and its replacement."""
        if not self.units:
            return None
        found, node, k = None, self._offset(self.units[0]), at
        while k < len(data):
            node ^= data[k]
            unit = self.units[node] if node < len(self.units) else 0
            if unit & 0x800000FF != data[k] or node >= len(self.units):
                break
            node ^= self._offset(unit)
            k += 1
            if unit >> 8 & 1:
                found = k - at, self.units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.pool[found[1] : self.pool.index(0, found[1])]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 1 << 9) >> 6)


class Normalizer:
    """Normalised bytes and, for each of them and the end, the byte of the source where it comes from."""

    def __init__(self, spec: bytes) -> None:
        flags = dict(fields(spec))
        self.map = CharacterMap(flags.get(MAP, b""))
        self.leads = self.map.leads()
        self.dummy, self.strip, self.escape = (bool(flags.get(k, 1)) for k in (DUMMY_PREFIX, STRIP, ESCAPE))
        self.blank = MARK.encode() if self.escape else b" "

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        raw = np.frombuffer(data, dtype=np.uint8)
        raw, source = self._replace(data, raw)
        end = len(data)
        if self.strip and len(raw):
            blank = raw == 0x20
            extra = blank & np.concatenate([[True], blank[:-1]])  # at the begin and after another one
            raw, source = raw[~extra], source[~extra]
            if len(raw) and raw[-1] == 0x20:
                end, raw, source = int(source[-1]), raw[:-1], source[:-1]
        if not len(raw):
            return b"", np.full(1, end, dtype=np.int64)
        lead = self.blank if self.dummy else b""
        source = np.repeat(source, np.where(raw == 0x20, len(self.blank), 1))
        return lead + raw.tobytes().replace(b" ", self.blank), np.concatenate([np.full(len(lead), source[0]), source, [end]])

    def _replace(self, data: bytes, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest known prefix is replaced at every place where one can begin; what it becomes lies where it began."""
        size, new, at = np.ones(len(raw), dtype=np.int64), [], 0
        for place in np.flatnonzero(self.leads[raw]).tolist() if self.leads.any() else ():
            if place >= at and (hit := self.map.longest(data, place)):
                at = place + hit[0]
                size[place:at] = 0
                size[place] = len(hit[1])
                new.append((place, hit[1]))
        source = np.repeat(np.arange(len(raw)), size)
        if not new:
            return raw, source
        out, begin = np.repeat(raw, size), np.cumsum(size) - size
        for place, text in new:
            out[begin[place] : begin[place] + len(text)] = np.frombuffer(text, dtype=np.uint8)
        return out, source


class Encoder:
    """Ids and spans of texts, exactly the library's ids."""

    def __init__(self, model: bytes) -> None:
        parts = fields(model)
        self.normalize = Normalizer(next((v for f, v in parts if f == NORMALIZER), b""))
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        off = message([(1, b"identity"), (MAP, b""), (DUMMY_PREFIX, 0), (STRIP, 0), (ESCAPE, 0)])
        plain = b"".join(message([(f, v)]) for f, v in parts if f != NORMALIZER) + message([(NORMALIZER, off)])
        self.segment = sentencepiece.SentencePieceProcessor(model_proto=plain)
        pieces = [dict(fields(v)) for f, v in parts if f == PIECES]
        kinds = [p.get(3, NORMAL) for p in pieces]
        names = [p[1].decode() for p in pieces]
        self.cuts = self.normalize.escape and all(k in (NORMAL, UNKNOWN, BYTE, 3) for k in kinds) and not any(MARK in n.lstrip(MARK) for n, k in zip(names, kinds, strict=True) if k == NORMAL)
        # bytes of the normalised text that a piece takes; of a character in bytes, the first takes all
        lead = lambda b: 1 if b < 0x80 else 0 if b < 0xC0 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
        self.sizes = np.array([lead(int(n[3:5], 16)) if k == BYTE else len(n.encode()) if k == NORMAL else -1 for n, k in zip(names, kinds, strict=True)], dtype=np.int64)
        # every id as digits and a comma, in rows of equal width
        digits = [f"{i},".encode() for i in range(len(names))]
        width = max(map(len, digits), default=0)
        self.digits = np.frombuffer(b"".join([d.ljust(width, b"\0") for d in digits]), dtype=np.uint8).reshape(-1, width)
        self.memory: dict[str, bytes] = {}
        self.held = 0

    def _runs(self, text: str) -> list[str]:
        """Runs of MARK, each with what follows up to the next one."""
        if not self.cuts:
            return [text]
        parts = text.split(MARK)
        if "" not in parts[1:]:
            return [parts[0], *[MARK + p for p in parts[1:]]] if parts[0] else [MARK + p for p in parts[1:]]
        out, lead = [parts[0]] if parts[0] else [], ""
        for p in parts[1:]:
            lead += MARK
            if p:
                out.append(lead + p)
                lead = ""
        return [*out, lead] if lead else out

    def _learn(self, runs: list[str]) -> dict[str, bytes]:
        """The ids of runs as 32-bit numbers, by one call of the library; short runs are remembered."""
        new = {r: array("i", ids).tobytes() for r, ids in zip(runs, self.segment.encode(runs, num_threads=1), strict=True)}
        short = {r: ids for r, ids in new.items() if len(r) <= LONG}
        self.held += sum(ENTRY + 2 * len(r) + len(ids) for r, ids in short.items())
        if self.held > REMEMBERED:
            self.memory, self.held = {}, 0
        else:
            self.memory.update(short)
        return new

    def joined(self, ids: np.ndarray) -> bytes:
        """Ids in decimals, joined by commas."""
        rows = self.digits[ids]
        return rows[rows > 0].tobytes()[:-1]

    def encode_all(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, str]]:
        """Of each text ids, begins and ends (bytes of the source) of the pieces, and the ids joined by commas."""
        normal = [self.normalize(x) for x in texts]
        runs = [self._runs(n.decode()) if n else [] for n, _ in normal]
        known = {r: self.memory.get(r) for own in runs for r in own}
        if new := [r for r, ids in known.items() if ids is None]:
            known |= self._learn(new)
        out = []
        for (text, source), own in zip(normal, runs, strict=True):
            ids = np.frombuffer(b"".join([known[r] for r in own]), dtype=np.int32)
            sizes = self.sizes[ids]
            if (sizes < 0).any():  # unknown pieces without byte fallback: only the pieces' own texts tell
                sizes = np.array([len(p.encode()) for p in self.segment.encode(text.decode(), out_type=str)], dtype=np.int64)
            spans = source[np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])]
            out.append((ids, spans[:-1], spans[1:], self.joined(ids).decode()))
        return out

    def encode(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, str]:
        return self.encode_all([data])[0]


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(Path(SparkFiles.get(path)).read_bytes())


def encode(docs: DataFrame, model: str, *, doc_id: str = "doc_id", text: str = "text", pieces: bool = True, digests: bool = False) -> DataFrame:
    """`doc_id, n_tokens`, with `pieces` the arrays `ids, begins, ends`, with `digests` `ids_sha256, decoded_sha256, spans_sha256, covered`.

    `model` is the path of a model file on the driver, which is sent to the executors.  `spans_sha256` is of
    the spans as pairs of little-endian 32-bit numbers, begin and end.  `covered` says that the spans follow one another from
    the first byte of the text to the last, which they do unless the model's normaliser drops blanks at the ends.
    """
    spark = docs.sparkSession
    prepare(spark)
    spark.sparkContext.addFile(model)
    name = Path(model).name
    narrow = docs.select(docs[doc_id].alias("id"), docs[text].cast("string").alias("t"))
    schema = f"`{doc_id}` {narrow.schema['id'].dataType.simpleString()}, n_tokens long" + ", ids array<int>, begins array<int>, ends array<int>" * pieces + ", ids_sha256 string, decoded_sha256 string, spans_sha256 string, covered boolean" * digests

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(name)
        for batch in batches:
            for part, texts in chunks(batch, "t"):
                done = coder.encode_all(texts)
                cols = {doc_id: part.column("id"), "n_tokens": pa.array([len(d[0]) for d in done], pa.int64())}
                if pieces:
                    at = pa.array(np.concatenate([[0], np.cumsum([len(d[0]) for d in done])]).astype(np.int32))
                    for k, c in enumerate(("ids", "begins", "ends")):
                        cols[c] = pa.ListArray.from_arrays(at, pa.array(np.concatenate([np.asarray(d[k], dtype=np.int32) for d in done])))
                if digests:
                    cols["ids_sha256"] = pa.array([hashlib.sha256(d[3].encode()).hexdigest() for d in done])
                    cols["decoded_sha256"] = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in coder.library.decode([d[0].tolist() for d in done])])
                    cols["spans_sha256"] = pa.array([hashlib.sha256(np.stack([d[1], d[2]], axis=1).astype("<i4").tobytes()).hexdigest() for d in done])
                    cols["covered"] = pa.array([not len(d[0]) if not x else bool(d[1][0] == 0 and d[2][-1] == len(x) and (d[1][1:] == d[2][:-1]).all()) for d, x in zip(done, texts, strict=True)])
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return narrow.mapInArrow(lean(run), schema)
