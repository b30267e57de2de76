"""Media columns: Ogg pages and packets.

The writer cuts packets into lacing values, packets into pages, interleaves the pages of several logical streams
and gives every page its checksum.  The reader verifies each checksum and sequence number, puts packets together
from their lacing values across pages, separates the streams by serial number and derives timestamps from the
granule positions.

The checksum has polynomial 0x04C11DB7, most significant bit first, and zero as start and final value.  The CRC of
zlib is the same one for mirrored bits, so mirroring the bytes before and the 32 bits after makes zlib's loop do.

Defined cases: null and empty texts hold a payload of 192 blanks; texts of any length span as many pages as they
need; equal texts give equal bytes; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ._shared import prepare

#: Fixed values of the format: page header layout, flags and the largest lacing value.
HEADER = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST, LACE = 1, 2, 4, 255

_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))

RATE, STREAMS, SAMPLES, UNIT = 8000, 2, 4096, 192
MAGIC = struct.Struct("<4sBBII")


class OggError(ValueError):
    """The bytes are not a whole and undamaged Ogg file."""


def checksum(data: bytes) -> int:
    crc = zlib.crc32(data.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_MIRROR), "big")


def pages(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """Pages of one logical stream; packets are (data, granule position at the end).  The first has a page of its own."""
    laces, owner = [], []
    for i, (data, _) in enumerate(packets):
        n = len(data) // LACE
        laces += [LACE] * n + [len(data) - n * LACE]
        owner += [i] * (n + 1)
    cuts, first = [0], len(packets[0][0]) // LACE + 1
    while cuts[-1] < len(laces):
        cuts.append(min(cuts[-1] + 255, len(laces)) if cuts[-1] or first > 255 else first)
    body = b"".join(d for d, _ in packets)
    out, at = [], 0
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        own = laces[a:b]
        ended = next((owner[x] for x in range(b - 1, a - 1, -1) if laces[x] < LACE), None)
        flags = (CONTINUED if a and laces[a - 1] == LACE else 0) | (FIRST if not a else 0) | (LAST if b == len(laces) else 0)
        head = HEADER.pack(b"OggS", 0, flags, -1 if ended is None else packets[ended][1], serial, k, 0, len(own)) + bytes(own)
        page = head + body[at : at + sum(own)]
        at += sum(own)
        out.append(page[:22] + checksum(page).to_bytes(4, "little") + page[26:])
    return out


def multiplex(streams: list[list[bytes]]) -> bytes:
    """First pages of all streams, then the others in turn."""
    rest = max(map(len, streams), default=0)
    return b"".join(s[k] for k in range(rest) for s in streams if k < len(s))


@dataclass
class Stream:
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    open: bytes | None = None
    ended: bool = False


def demultiplex(data: bytes) -> dict[int, Stream]:
    """Logical streams by serial number, in order of their first page; raises OggError on any damage."""
    out: dict[int, Stream] = {}
    at = 0
    while at < len(data):
        if len(data) - at < HEADER.size:
            raise OggError("a page header is cut off")
        magic, version, flags, granule, serial, number, crc, n = HEADER.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise OggError(f"no page at byte {at}")
        laces = data[at + HEADER.size : at + HEADER.size + n]
        end = at + HEADER.size + n + sum(laces)
        if len(laces) < n or end > len(data):
            raise OggError("a page is cut off")
        if checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise OggError(f"wrong checksum at byte {at}")
        s = out.get(serial)
        if bool(flags & FIRST) != (s is None):
            raise OggError("a stream starts twice or not at all")
        s = out.setdefault(serial, Stream())
        if number != s.pages or s.ended or bool(flags & CONTINUED) != (s.open is not None):
            raise OggError("a page is missing")
        s.pages += 1
        s.ended = bool(flags & LAST)
        pos, start = at + HEADER.size + n, at + HEADER.size + n
        done = 0
        for x in laces:
            pos += x
            if x < LACE:
                s.packets.append((s.open or b"") + data[start:pos])
                s.granules.append(-1)
                s.open, start, done = None, pos, done + 1
        if done:
            s.granules[-1] = granule
        elif granule != -1:
            raise OggError("a granule position without the end of a packet")
        if n and laces[-1] == LACE:
            s.open = (s.open or b"") + data[start:pos]
        at = end
    if any(s.open is not None or not s.ended for s in out.values()):
        raise OggError("a stream has no end")
    return out


def timestamps(stream: Stream, rate: int) -> list[tuple[int, float]]:
    """(packet, seconds at its end) of the packets that end a page."""
    return [(i, g / rate) for i, g in enumerate(stream.granules) if g >= 0]


def encode(payload: bytes) -> bytes:
    """8-bit samples, dealt to two channels, each a logical stream with a header packet."""
    streams = []
    for c in range(STREAMS):
        own = payload[c::STREAMS]
        packets = [(MAGIC.pack(b"svl8", c, STREAMS, RATE, len(own)), 0)]
        packets += [(own[i : i + SAMPLES], min(i + SAMPLES, len(own))) for i in range(0, len(own), SAMPLES)]
        streams.append(pages(c + 1, packets))
    return multiplex(streams)


def decode(data: bytes) -> tuple[bytes, dict[int, Stream]]:
    streams = demultiplex(data)
    parts: dict[int, bytes] = {}
    for s in streams.values():
        magic, channel, n, _, samples = MAGIC.unpack(s.packets[0])
        parts[channel] = b"".join(s.packets[1:])
        if magic != b"svl8" or n != len(streams) or len(parts[channel]) != samples:
            raise OggError("a channel is damaged")
    out = bytearray(sum(map(len, parts.values())))
    for c, own in parts.items():
        out[c :: len(parts)] = own
    return bytes(out), streams


def features(payload: bytes, streams: dict[int, Stream]) -> str:
    """Whole numbers only, so that any machine writes the same string."""
    x = np.frombuffer(payload, dtype=np.uint8)
    seconds = max(timestamps(s, RATE)[-1][1] for s in streams.values())
    turns = int(np.count_nonzero((x[1:] ^ x[:-1]) & 0x20))
    return f"streams={len(streams)};pages={sum(s.pages for s in streams.values())};packets={sum(len(s.packets) for s in streams.values())};ms={round(seconds * 1000)};min={x.min()};max={x.max()};sum={int(x.sum(dtype=np.int64))};turns={turns}"


def pad(raw: bytes) -> bytes:
    return raw + b" " * (-len(raw) % UNIT if raw else UNIT)


COLUMNS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store(texts: pd.Series) -> Iterator[tuple[bytes, bytes, dict[int, Stream], int]]:
    """For each text its media file, the payload read back from it, its streams and its length in bytes."""
    for text in texts:
        raw = (text or "").encode() if isinstance(text, str) else b""
        data = encode(pad(raw))
        payload, streams = decode(data)
        yield data, payload, streams, len(raw)


def media(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", keep_file: bool = False) -> DataFrame:
    """Store every text as an Ogg file and read it back: the digests of `COLUMNS`, and the file as `media` if kept."""
    prepare(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    narrow = docs.select(docs[doc_id].alias("k"), docs[text].cast("string").alias("t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for data, payload, streams, n in store(b["t"]):
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), features(payload, streams), *([data] if keep_file else [])))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in COLUMNS.split(", ")] + ["media"] * keep_file)
            out.insert(0, doc_id, b["k"].array)
            yield out

    return narrow.mapInPandas(run, f"`{doc_id}` {kind}, {COLUMNS}" + ", media binary" * keep_file)
