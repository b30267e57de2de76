"""Token counts of documents in flat token files, by a scan for separators.

A flat file is nothing but token ids of fixed width, one document after the other, each closed by the
end-of-document id; it has no index, and its blocks end anywhere, also within a token.  Every block is searched for the
separator at once (a vectorised comparison).  A block yields only its number of tokens and the places of its
separators; a prefix scan over the blocks of a file (running sums of tokens and separators, running
maximum of the last separator) gives each block its start, its first document's number and where that document began.
So a document may cross any number of blocks.  Blocks are read once and in any order; the scan passes a few numbers for
each block, in spans of SPAN blocks, and the separators stay where they were found.

`flatten` writes such files from texts: a file for each partition, cut into blocks that are rows of a table, and beside
it the ids of the documents in order.  `read_flat` cuts files of any size that are there already.

Defined cases: null and empty texts have no tokens; tokens after the last separator are a document that is marked
`open`; an empty file has no documents; texts of any length are kept whole; rows with null or repeated ids are
documents like others; an empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

from ._bytes import chunks
from ._shared import Scratch, prepare

#: Bytes of a block; odd, so that blocks end within tokens and the stitching is always at work.
BLOCK = (1 << 20) + 1
#: Blocks that one window of the prefix scan holds.
SPAN = 4096


@lru_cache(maxsize=2)
def _tokenizer(name: str, pattern: str):  # noqa: ANN202
    import tiktoken

    with open(SparkFiles.get(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def flatten(docs: DataFrame, ranks: str, pattern: str, end: int, *, doc_id: str = "doc_id", text: str = "text", dtype: str = "<u2", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Blocks `file, number, data` and documents `file, place, doc_id`; `end` is no id of the vocabulary in `ranks`."""
    spark = docs.sparkSession
    prepare(spark)
    spark.sparkContext.addFile(ranks)
    name = ranks.rsplit("/", 1)[-1]
    narrow = docs.select(docs[doc_id].alias("id"), docs[text].cast("string").alias("t"))
    kind = narrow.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, file = _tokenizer(name, pattern), TaskContext.get().partitionId()
        number = place = 0
        rest = b""
        for batch in batches:
            for part, texts in chunks(batch, "t"):
                parts = [rest]
                for t in texts:
                    ids = coder.encode_ordinary(t.decode())
                    ids.append(end)
                    parts.append(np.array(ids, dtype=dtype).tobytes())
                rest = b"".join(parts)
                n, k = len(rest) // block, part.num_rows
                own = part.column("id")
                yield pa.RecordBatch.from_arrays([pa.array([file] * k, pa.int32()), pa.array(np.arange(place, place + k)), own, pa.nulls(k, pa.binary())], names=["file", "number", "id", "data"])
                yield pa.RecordBatch.from_arrays([pa.array([file] * n, pa.int32()), pa.array(np.arange(number, number + n)), pa.nulls(n, own.type), pa.array([rest[i * block : (i + 1) * block] for i in range(n)], pa.binary())], names=["file", "number", "id", "data"])
                rest, number, place = rest[n * block :], number + n, place + k
        if rest:
            yield pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([number], pa.int64()), pa.nulls(1, own.type), pa.array([rest], pa.binary())], names=["file", "number", "id", "data"])

    rows = Scratch(spark, "tokens").table(narrow.mapInArrow(run, f"file int, number long, id {kind}, data binary"), "flat", compression="zstd")
    return rows.filter("data is not null").select("file", "number", "data"), rows.filter("data is null").select("file", F.col("number").alias("place"), F.col("id").alias(doc_id))


class _Ranges(DataSource):
    """Reads byte ranges of files of any size; every range is a partition of its own, read by seeking."""

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return "file string, number long, data binary"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _RangeReader(self.options["path"], int(self.options["block"]), int(self.options["blocks"]))


class _RangeReader(DataSourceReader):
    def __init__(self, path: str, block: int, blocks: int) -> None:
        self.path, self.block, self.blocks = path, block, blocks

    def partitions(self) -> list[InputPartition]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        own = fs.get_file_info(root)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True)) if own.type == pafs.FileType.Directory else [own]
        files = sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and f.size and not f.base_name.startswith(("_", ".")))
        span = self.block * self.blocks
        return [InputPartition((path, at, min(size, at + span))) for path, size in files for at in range(0, size, span)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path, at, to = partition.value
        fs, _ = pafs.FileSystem.from_uri(self.path)
        with fs.open_input_file(path) as f:
            while at < to:
                data = f.read_at(min(self.block, to - at), at)
                yield path, at // self.block, data
                at += len(data)


def read_flat(spark: SparkSession, path: str, block: int = BLOCK, blocks: int = 64) -> DataFrame:
    """Blocks `file, number, data` of a file or of the files in a folder (a URI that pyarrow can open, or a local path).

    The driver sees names and sizes only; `blocks` of them make a partition, so files of any size are read in parallel.
    """
    prepare(spark)
    spark.dataSource.register(_Ranges)
    return spark.read.format("byte_ranges").option("path", path if "://" in path else "file://" + os.path.abspath(path)).option("block", block).option("blocks", blocks).load()


def _separators(dtype: str, end: int):  # noqa: ANN202
    """Per block: bytes, and the places of the separator's first bytes as if a token began at each of the block's first bytes.

    Where tokens begin depends on the bytes before the block, which the scan finds out later; so each of the `width`
    alignments is searched.  A token that crosses the end is completed with the next block's first bytes: these, and
    the own first ones, are handed on.
    """
    width = np.dtype(dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[] for _ in range(5)]
            for data in batch.column("data"):
                raw = data.as_buffer().to_pybytes()
                found = []
                for shift in range(width):
                    if shift >= len(raw):
                        found.append([])
                        continue
                    n = (len(raw) - shift) // width
                    found.append((np.flatnonzero(np.frombuffer(raw, dtype=dtype, count=n, offset=shift) == end) * width + shift).tolist())
                rows[0].append(len(raw)), rows[1].append(found), rows[2].append(raw[: width - 1]), rows[3].append(raw[len(raw) - width + 1 :] if width > 1 else b"")
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("number"), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.list_(pa.list_(pa.int64()))), pa.array(rows[2], pa.binary()), pa.array(rows[3], pa.binary())], names=["file", "number", "size", "found", "head", "tail"])

    return run


def _running(rows: DataFrame, sums: dict[str, str], last: str | None = None) -> DataFrame:
    """Adds, over the blocks of a file, the sums of earlier blocks' columns (new name: column), and the last value before as `since`.

    Two levels: sums of SPAN consecutive blocks first, then within them, so that a window holds at most SPAN rows or one for each span.
    """
    span = F.floor(F.col("number") / SPAN)
    rows = rows.withColumn("span", span)
    totals = rows.groupBy("file", "span").agg(*[F.sum(c).alias(f"{k}_all") for k, c in sums.items()], *([F.max(last).alias("last_all")] if last else []))
    over = Window.partitionBy("file").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    ahead = totals.select("file", "span", *[F.coalesce(F.sum(f"{k}_all").over(over), F.lit(0).cast("long")).alias(f"{k}_base") for k in sums], *([F.max("last_all").over(over).alias("last_base")] if last else []))
    within = Window.partitionBy("file", "span").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(ahead, ["file", "span"])
    out = out.withColumns({k: F.col(f"{k}_base") + F.coalesce(F.sum(c).over(within), F.lit(0).cast("long")) for k, c in sums.items()})
    if last:
        out = out.withColumn("since", F.coalesce(F.greatest(F.max(last).over(within), F.col("last_base")), F.lit(-1).cast("long")))
    return out.drop("span", "last_base", *[f"{k}_base" for k in sums])


def scan(blocks: DataFrame, end: int, *, dtype: str = "<u2") -> DataFrame:
    """`file, place, n_tokens, open` of every document of the files; `dtype` is the width and order of a token's bytes.

    Blocks of a file are numbered from 0 and must all have at least as many bytes as a token, but for the last.
    """
    spark = blocks.sparkSession
    scratch = Scratch(spark, "scan")
    width = np.dtype(dtype).itemsize
    kind = blocks.schema["file"].dataType.simpleString()
    found = blocks.mapInArrow(_separators(dtype, end), f"file {kind}, number long, size long, found array<array<bigint>>, head binary, tail binary")
    found = scratch.table(found, "found")
    # the prefix scans see numbers only: sizes, then counts of separators and the last one; places join again afterwards
    rows = _running(found.select("file", "number", "size", "tail", F.transform("found", lambda x: F.size(x).cast("long")).alias("ns"), F.transform("found", F.array_max).alias("lasts")), {"start": "size"})
    rows = rows.withColumn("skip", F.pmod(-F.col("start"), F.lit(width)).cast("int"))  # bytes of a token that the block before began
    # a separator that crosses into the next block counts for this one
    heads = found.select("file", (F.col("number") - 1).alias("number"), F.col("head").alias("next"))
    rows = rows.join(heads, ["file", "number"], "left")
    bytes_ = np.array([end], dtype=dtype).tobytes().hex()
    cut = F.pmod(F.col("start") + F.col("size"), F.lit(width)).cast("int")  # bytes of the last, cut token
    ends = F.concat(F.lower(F.hex("tail")), F.lower(F.hex("next")))
    crosses = F.coalesce((cut > 0) & (F.substring(ends, (2 * (width - 1) - 2 * cut + 1), F.lit(2 * width)) == bytes_), F.lit(False))
    rows = rows.withColumns({"crosses": crosses, "cut": cut})
    token = lambda p: ((F.col("start") + p) / width).cast("long")
    last = F.when(F.col("crosses"), token(F.col("size") - F.col("cut"))).otherwise(token(F.get("lasts", F.col("skip"))))
    rows = rows.select("file", "number", "start", "size", "skip", "crosses", "cut", (F.get("ns", F.col("skip")) + F.col("crosses").cast("long")).alias("n"), last.alias("last"))
    rows = scratch.table(_running(rows, {"first_place": "n"}, "last"), "starts")
    placed = rows.filter("n > 0").join(found.select("file", "number", "found"), ["file", "number"])
    own = F.concat(F.get("found", F.col("skip")), F.when(F.col("crosses"), F.array(F.col("size") - F.col("cut"))).otherwise(F.expr("cast(array() as array<bigint>)")))
    docs = placed.withColumn("at", F.transform(own, token)).select("file", "first_place", "since", F.transform("at", lambda p, i: F.struct(i.alias("i"), p.alias("p"), F.when(i > 0, F.get("at", i - 1)).alias("q"))).alias("at"))
    docs = docs.select("file", "first_place", "since", F.inline("at"))
    closed = docs.select("file", (F.col("first_place") + F.col("i")).alias("place"), (F.col("p") - F.coalesce("q", "since") - 1).alias("n_tokens"), F.lit(False).alias("open"))
    left = rows.groupBy("file").agg(F.sum("n").alias("place"), ((F.sum("size") / width).cast("long") - F.coalesce(F.max("last"), F.lit(-1).cast("long")) - 1).alias("n_tokens"))
    return closed.unionByName(left.filter("n_tokens > 0").withColumn("open", F.lit(True)))


def count(docs: DataFrame, ranks: str, pattern: str, end: int, *, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """`doc_id, n_tokens, file, place`: texts flattened, and their lengths found again by the scan."""
    blocks, order = flatten(docs, ranks, pattern, end, doc_id=doc_id, text=text, block=block)
    return order.join(scan(blocks, end), ["file", "place"]).select(doc_id, "n_tokens", "file", "place")
