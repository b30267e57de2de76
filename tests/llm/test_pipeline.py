"""The pipeline's stages against plain Python on a small corpus."""

import collections
import random

import pytest
from test_operators import brute_groups, near_copies, toxic_corpus, words

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    toxic = toxic_corpus(300, 5)
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t, _, _ in toxic]
    rows += [(5000 + i, t, "en", "s1", len(t)) for i, t in near_copies(2, 12)] + [(9000, None, "en", None, 0), (9001, "", "en", None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path + "/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y, _ in toxic], "doc_id long, quality int, toxic int").write.parquet(path + "/labels.parquet")
    return path, rows, {i for i, _, _, bad in toxic if bad}


def test_stages(spark, folder, tmp_path):
    path, rows, bad = folder
    docs = spark.read.parquet(path + "/documents.parquet")
    results = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        results.append(docs.collect())
        if k < 3:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean, single, mixed, coded = results
    kept = {r.doc_id for r in clean}
    clean_rows = {r[0] for r in rows} - bad
    assert len(kept & bad) <= 2 and len(clean_rows - kept) <= 2
    groups = brute_groups([(r.doc_id, r.text) for r in clean], 5, 80)
    assert sorted(r.doc_id for r in single) == sorted(i for i, g in groups.items() if g[2])
    copies = collections.Counter(r.doc_id for r in mixed)
    assert set(copies.values()) <= {1, 2} and set(copies) <= {r.doc_id for r in single}
    total = sum(len(words(r.text)) for r in single)
    assert abs(sum(len(words(r.text)) for r in mixed) / (1.5 * total) - 1) < 0.01
    assert collections.Counter(r.doc_id for r in coded) == copies
    assert corpus_pipeline.run(spark, path).count() == len(coded)


def test_one_row_of_each_group(spark):
    body = " ".join(f"w{i}" for i in range(40))
    near, other = body.replace("w39", "x"), "null alone with words of its own here"
    rows = [(1, body)] * 50 + [(2, near), (None, body), (None, body), (4, near), (4, "quite different words stand here in this text")]
    rows += [(5, ""), (5, ""), (5, None), (6, ""), (None, other), (None, other), (None, ""), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", -1, -1, -1) for i, t in rows], "doc_id long, text string, lang string, source string, _row long, component_id long, n_shingles long")
    kept = corpus_pipeline.one_of_each_group(spark, docs, "")
    out = kept.collect()
    assert kept.columns == docs.columns and {(r._row, r.component_id, r.n_shingles) for r in out} == {(-1, -1, -1)}
    want = [(1, body), (4, "quite different words stand here in this text"), (5, ""), (5, None), (6, ""), (None, other), (None, "")]
    assert collections.Counter((r.doc_id, r.text) for r in out) == collections.Counter(want)


def test_stages_keep_rows_and_columns_of_any_name(spark, tmp_path):
    """Null ids, repeated rows, null columns, and columns that the stages use inside, through all stages."""
    rng = random.Random(2)
    plain = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(500)) for _ in range(30)) for _ in range(40)]
    rows = [(i if i % 3 else None, t, "en", "s" if i % 2 else None) for i, t in enumerate(plain)] + [(7, "same text of six words here", None, None)] * 4 + [(None, None, None, None), (50, "", "en", "s")]
    names = "_row _copies _doc size taken score id t".split()
    docs = spark.createDataFrame([(*r, 0, *[-1] * len(names)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} long" for c in names))
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.filter(" or ".join(f"{c} <> -1" for c in names)).count() == 0
        if k == 1:
            assert sorted(r.text or "" for r in docs.collect()) == sorted([*plain, "same text of six words here", "", ""])
    coded = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert coded.count() == docs.count() > 40 and coded.filter("not covered").count() == 0
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
        assert empty.count() == 0
