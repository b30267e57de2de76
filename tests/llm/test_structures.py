"""Fill-in-the-middle, Merkle manifests and repeated windows against plain Python, with odd rows and small blocks."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sieveline.llm import fim, merkle, queries, suffixes

from test_operators import DOCS, FOLD, ODD, documents

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_merkle_manifest", "op13_repeated_windows"])
def test_same_as_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    theirs = c.sql(queries.oracle_sql()[name]).df()
    ours = queries.queries()[name](spark, sf).toPandas()
    assert sorted(ours.columns) == sorted(theirs.columns)
    key = lambda f: sorted(tuple("~" if pd.isna(v) else str(int(v)) if isinstance(v, (int, float, np.number)) else str(v) for v in r) for r in f[sorted(f.columns)].astype(object).itertuples(index=False))
    assert key(ours) == key(theirs)


# ---- 11


def plain_fim(doc_id, text):
    text = text or ""
    units = TOKEN.findall(text)
    assert "".join(units) == text
    h = sha(f"42:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in fim.MARKS) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    if h4 % 100 < 80:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_fill_in_middle(spark):
    rng = random.Random(11)
    letters = "ab \t\n\r\x0b\x0c\x1f\xa0éß中\U0001f600<>PSM\x00"
    rows = ODD + [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(60))), "s") for i in range(100, 400)] + [(500, "a <P> b", "s"), (501, "<S>", "s"), (502, "x<M>", "s"), (503, "a<", "s"), (504, "P>b c", "s")]
    docs = documents(spark, rows).withColumn("fim", F.lit(1)).withColumn("_t", F.lit("t"))
    out = fim.transform(docs)
    assert out.columns == [*[c for c in docs.columns if c != "fim"], "fim"]
    got = out.select("doc_id", "text", "_t", "fim.*", fim.restored(F.col("fim.output"), F.col("fim.form")).alias("back")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_fim(r.doc_id, r.text)
        assert r.back == (r.text or "") and r._t == "t"
    assert {r.form for r in got} == {"plain", "spm", "psm"}
    assert fim.transform(docs.limit(0)).count() == 0


def test_fill_in_middle_keeps_bytes_that_are_no_text(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.expr("cast(concat(x'61ff20', x'c328', cast(cast(id as string) as binary), x'80') as string)").alias("text"))
    out = fim.transform(docs)
    bad = out.filter(F.col("text").cast("binary") != fim.restored(F.col("fim.output"), F.col("fim.form")).cast("binary"))
    assert bad.count() == 0


def test_marks_must_not_overlap(spark):
    with pytest.raises(ValueError):
        fim.transform(documents(spark, ODD), marks=("<a<", "<b", "c"))


# ---- 12


def plain_tree(leaves, fanout=16):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def plain_beside(levels, i, fanout=16):
    out = []
    for level in levels[:-1]:
        a = i // fanout * fanout
        out.append(("".join(level[a:i]), "".join(level[i + 1 : a + fanout])))
        i //= fanout
    return out


def plain_manifest(rows, fanout):
    """Digests, sources and ids of rows to (leaf, subroot, root, path), sorted."""
    trees = {}
    for s in sorted({s for _, s, _ in rows}, key=lambda s: (s is not None, (s or "").encode())):
        trees[s] = plain_tree([h for _, h in sorted(((i is not None, i or 0), h) for h, x, i in rows if x == s)], fanout)
    top = plain_tree([t[-1][0] for t in trees.values()], fanout)
    return sorted((h, t[-1][0], top[-1][0], str(plain_beside(t, i, fanout) + plain_beside(top, k, fanout))) for k, t in enumerate(trees.values()) for i, h in enumerate(t[0]))


@pytest.mark.parametrize(("fanout", "block"), [(16, 4096), (3, 2), (2, 1)])
def test_manifest(spark, monkeypatch, fanout, block):
    monkeypatch.setattr(merkle, "BLOCK", block)
    rng = random.Random(12)
    rows = ODD + [(rng.randrange(10**6), f"Text {k}", f"s{min(k % 40, 7) if k % 3 else k % 19}") for k in range(400)] + [(9, "one", "lone"), (9, "one", "lone"), (None, None, "lone")]
    docs = documents(spark, rows)
    fields = [docs[c] for c in ("doc_id", "source", "text")]
    out = merkle.manifest(docs, merkle.leaf(fields), group="source", key="doc_id", carry=[("extra", F.col("n_chars"))], fanout=fanout)
    got = out.withColumn("folded", merkle.fold(F.col("leaf"), F.col("path"))).withColumn("proof", merkle.proof(F.col("path"))).collect()
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    expected = plain_manifest([(sha(*map(enc, (i, s, t))), s, i) for i, t, s in rows], fanout)
    assert sorted((r.leaf, r.subroot, r.root, str([tuple(p) for p in r.path])) for r in got) == expected
    assert all(r.folded == r.root and r.extra == 0 and r.proof == sha(*[x for p in r.path for x in p]) for r in got)


def test_manifest_of_one_row_and_of_none(spark):
    for rows in ([(1, "a", "s")], []):
        docs = documents(spark, rows)
        out = merkle.manifest(docs, merkle.leaf([docs["text"]]), group="source", key="doc_id").collect()
        assert [(r.leaf, r.subroot, r.root, r.path) for r in out] == [(sha("1:a"),) * 3 + ([],)] * len(rows)


def test_tampered_rows_are_found(spark):
    got = {r.doc_id: r for r in queries.op12_merkle_manifest(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    changed = {r.doc_id for r in docs if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.text and r.text != r.text.translate(FOLD)}
    assert changed and {i for i, r in got.items() if not r.verified} == changed


# ---- 13


def plain_repeats(texts, length):
    count = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            count[t[i : i + length]] = count.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = [(m.start(), m.end()) for m in re.finditer(rb"\x01+", bytes(gone))]
        out.append((len(t), sum(gone), len(spans), bytes(x for x, g in zip(t, gone, strict=True) if not g), spans))
    return out


@pytest.mark.parametrize(("length", "large"), [(20, 512), (20, 2), (7, 0), (1, 512), (33, 0)])
def test_repeated_windows(spark, monkeypatch, length, large):
    monkeypatch.setattr(suffixes, "LARGE", large)
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdé中") for _ in range(rng.randrange(1, 7)))
    passage = " ".join(word() for _ in range(12))
    texts = [" ".join(word() for _ in range(rng.randrange(40))) + (passage if k % 3 == 0 else "") + word() for k in range(120)]
    texts += [texts[5], texts[5], "a" * 50, "ab" * 40, "a" * 19, "a" * 20, "x" + "y" * 20 + "z", "", None, texts[7][3:], " " * 90, passage[:-1] + "!"]
    rows = [(k if k % 9 else None, t, "s") for k, t in enumerate(texts)]
    docs = documents(spark, rows).withColumn("at", F.monotonically_increasing_id()).withColumn("repeats", F.lit(0))
    got = suffixes.remove_repeats(docs, length=length, spans=True, kept=True).orderBy("at").collect()
    assert [r.text for r in got] == texts
    expected = plain_repeats([(t or "").encode() for t in texts], length)
    for r, (n, gone, spans, kept, where) in zip(got, expected, strict=True):
        assert (r.repeats.n_bytes, r.repeats.n_removed, r.repeats.n_spans, bytes(r.repeats.kept)) == (n, gone, spans, kept)
        assert r.repeats.kept_sha256 == hashlib.sha256(kept).hexdigest()
        assert [(s.begin, s.end) for s in r.repeats.spans] == where


def test_repeated_windows_of_odd_rows(spark):
    got = suffixes.remove_repeats(documents(spark, ODD)).collect()
    assert len(got) == len(ODD)
    by = {(r.doc_id, r.source): r.repeats for r in got}
    assert by[8, "hot"].n_removed == 60_000 and by[6, None].n_removed == 70_000  # every window occurs elsewhere in the text
    assert by[1, "a"].n_bytes == 0 and by[1, "a"].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert suffixes.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_equal_windows_have_equal_anchors(monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 100)
    suffixes._powers.cache_clear()
    rng = random.Random(5)
    data = bytes(rng.choice(b"abc") for _ in range(1000))
    anchor, at, first, width = suffixes.anchored(data, 24)
    windows = {}
    for h, p, f, w in zip(anchor.tolist(), at.tolist(), first.tolist(), width.tolist(), strict=True):
        for s in range(f, f + w):
            assert s <= p <= s + 24 - 6
            assert windows.setdefault(data[s : s + 24], (h, p - s)) == (h, p - s)
    assert sum(width) == len(data) - 23 and sorted(s for f, w in zip(first, width, strict=True) for s in range(f, f + w)) == list(range(len(data) - 23))
    suffixes._powers.cache_clear()


def test_radix_sort_of_windows():
    rng = random.Random(6)
    data = np.frombuffer(bytes(rng.choice(b"ab") for _ in range(3000)), dtype=np.uint8)
    starts = np.arange(3000 - 12)
    left, classes = suffixes.equal_windows(data, starts, np.zeros(len(starts), np.int64), 13)
    found = {}
    for i, c in zip(left.tolist(), classes.tolist(), strict=True):
        found.setdefault(c, set()).add(i)
    expected = {}
    for i in starts.tolist():
        expected.setdefault(data[i : i + 13].tobytes(), set()).add(i)
    assert sorted(map(sorted, found.values())) == sorted(sorted(v) for v in expected.values() if len(v) > 1)
