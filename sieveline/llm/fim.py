"""Fill-in-the-middle: texts cut at two token boundaries, their parts reordered between marks.

A token is a word with the blanks before it; blanks at the end of a text are a token of their own.  A text is decoded to an
array of UTF-32 code points; where a blank follows anything else, a token begins, so comparing neighbours gives all
boundaries at once.  The two cuts are chosen by a hash of the document's id, so they are the same on every run.

Null texts count as empty.  Empty texts and those that contain a mark stay plain.  A null id is hashed as the empty string,
equal ids get equal cuts ranks.  Bytes that are no UTF-8 count as a code point each and come back as they were.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import chunks
from ._shared import fresh, lean, prepare

#: Marks before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
RESULT = T.StructType([T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])


def code_points(text: bytes) -> np.ndarray:
    return np.frombuffer(text.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), dtype="<u4")


def encoded(codes: np.ndarray) -> bytes:
    return codes.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogateescape")


def boundaries(codes: np.ndarray) -> np.ndarray:
    """Where each token begins, and the end of the text; one number for an empty text."""
    blank = (codes == 0x20) | ((codes >= 0x09) & (codes <= 0x0D))
    inner = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    return np.concatenate([np.zeros(1, np.int64), inner, np.full(1, len(codes))]) if len(codes) else np.zeros(1, np.int64)


def cut(text: bytes, first: int, second: int) -> tuple[int, np.ndarray, int, int]:
    """Tokens, code points, and where prefix and middle end, for two numbers of which the remainders by tokens + 1 count."""
    codes = code_points(text)
    at = boundaries(codes)
    a, b = sorted((first % len(at), second % len(at)))
    return len(at) - 1, codes, int(at[a]), int(at[b])


def arranged(codes: np.ndarray, a: int, b: int, form: str, marks: Sequence[bytes]) -> bytes:
    """The parts before a, from a to b and after b between the marks; spm puts the suffix first, psm the prefix."""
    prefix, middle, suffix = (marks[0] + encoded(codes[:a])), (marks[2] + encoded(codes[a:b])), (marks[1] + encoded(codes[b:]))
    return suffix + prefix + middle if form == "spm" else prefix + suffix + middle


def _strings(values: list[bytes]) -> pa.Array:
    """Without a check of the UTF-8."""
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(v) for v in values])])
    return pa.LargeStringArray.from_buffers(len(values), pa.py_buffer(ends), pa.py_buffer(b"".join(values)))


def draws(seed: int, doc_id: Column) -> list[Column]:
    """Four unsigned 32-bit numbers from the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", seed: int = 42, share: int = 50, spm: int = 80, marks: Sequence[str] = MARKS, into: str = "fim") -> DataFrame:
    """The rows of `docs` with a struct `into` of `n, form, prefix_chars, middle_chars, output`; a column of that name is replaced.

    `share` percent of the texts are cut, `spm` percent of those suffix first.  `n` counts tokens; the characters are null in
    plain texts.  No mark may begin as another one ends, or restored() could not tell where they are.
    """
    if any(x[-k:] == y[:k] for x in marks for y in marks for k in range(1, len(x))) or len({*marks}) != 3 or "" in marks:
        raise ValueError("the marks have to be three that do not overlap")
    prepare(docs.sparkSession)
    docs = docs.drop(into)
    names = [fresh(docs, f"_h{k}") for k in range(4)]
    t = fresh(docs, "_t")
    rows = docs.withColumns(dict(zip(names, draws(seed, docs[doc_id]), strict=True)) | {t: docs[text].cast("string")})
    signs = [m.encode() for m in marks]
    kept = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, t):
                n, forms, prefix, middle, out = [], [], [], [], []
                for x, h1, h2, h3, h4 in zip(texts, *(part.column(c).to_pylist() for c in names), strict=True):
                    units, codes, a, b = cut(x, h1, h2)
                    plain = not x or h3 % 100 >= share or any(s in x for s in signs)
                    form = "plain" if plain else "spm" if h4 % 100 < spm else "psm"
                    n.append(units)
                    forms.append(form)
                    prefix.append(None if plain else a)
                    middle.append(None if plain else b - a)
                    out.append(x if plain else arranged(codes, a, b, form, signs))
                made = pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), _strings(out)], [f.name for f in RESULT])
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], made], [*kept, into])

    return rows.mapInArrow(lean(run), T.StructType([*docs.schema.fields, T.StructField(into, RESULT)]))


def restored(output: Column, form: Column, marks: Sequence[str] = MARKS) -> Column:
    """The text that an output was made of, byte by byte."""
    p, s, m = marks
    between = lambda a, b: F.substring_index(F.substring_index(output, a, -1), b, 1)
    middle = F.substring_index(output, m, -1)
    return F.when(form == "plain", output).when(form == "spm", F.concat(between(p, m), middle, between(s, p))).otherwise(F.concat(between(p, s), middle, between(s, m)))
