"""Compression dictionaries: trained on a bounded sample of a project's lines, applied to columns and files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from ..session import ship

#: Bytes of a dictionary, and of the lines that it is trained on, at most.
SIZE, SAMPLE = 112_640, 16 << 20


def train(lines: DataFrame, line: str = "line", size: int = SIZE, sample: int = SAMPLE) -> bytes:
    """A dictionary of at most `size` bytes; empty if there are too few lines to learn from.

    The sample is the lines first in the order of a hash, at most `sample` bytes of them; the order is that of the distinct lines.
    """
    drawn = lines.select(F.col(line).alias("x")).filter("x <> ''").distinct().orderBy(F.xxhash64("x"), "x").limit(sample // 64)
    texts, left = [], sample
    for r in drawn.toLocalIterator():
        data = r["x"].encode()
        if len(data) > left:
            break
        left -= len(data)
        texts.append(data)
    if len(texts) < 8 or sample - left < 1024:
        return b""
    try:
        return zstandard.train_dictionary(min(size, max(1024, (sample - left) // 4)), texts).as_bytes()
    except zstandard.ZstdError:  # lines too alike or too short
        return b""


def pack(column: Column, dictionary: bytes, lines: DataFrame) -> Column:
    """A text column compressed with the dictionary."""
    ship(lines.sparkSession)

    @F.pandas_udf(BinaryType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor()
        for batch in batches:
            yield batch.map(lambda x: None if x is None else coder.compress(x.encode()))

    return run(column)


def unpack(column: Column, dictionary: bytes, rows: DataFrame) -> Column:
    """The inverse of `pack`."""
    ship(rows.sparkSession)

    @F.pandas_udf(StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()
        for batch in batches:
            yield batch.map(lambda x: None if x is None else coder.decompress(x).decode())

    return run(column)
