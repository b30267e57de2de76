"""The registered queries over the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from sieveline.llm import queries

SF = "/root/testdata/sf0.001"

COLUMNS = {
    1: "page_id host path rule verdict",
    2: "doc_id held_out score predicted",
    3: "query_id rank vec_id score",
    4: "doc_id n_shingles component_id kept",
    5: "doc_id n_tokens ids_sha256 decoded_sha256",
    6: "doc_id size text_crc32 law shard slot grown_shard",
    7: "doc_id n_tokens",
    8: "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    9: "doc_id size source_size target taken",
    10: "doc_id held_out n_tokens n_known train_tokens base_score score",
    11: "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256",
    12: "doc_id leaf subroot root proof_sha256 folded_root verified",
    13: "doc_id n_bytes n_removed n_spans kept_sha256",
}


@pytest.fixture(scope="module")
def results(spark):
    return {int(n[2:].split("_")[0]): f(spark, SF).toPandas() for n, f in queries.queries().items()}


def test_all_rows_and_columns(results):
    assert set(results) == set(COLUMNS)
    docs, pages = (len(pd.read_parquet(f"{SF}/{t}.parquet")) for t in ("documents", "pages"))
    for n, frame in results.items():
        assert set(COLUMNS[n].split()) <= set(frame.columns)
        assert len(frame) == {1: pages, 3: 50}.get(n, docs)


def test_same_as_sql(results):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    theirs = c.sql(queries.oracle_sql()["op4_superminhash_neardup"]).df()
    order = ["doc_id", "n_shingles", "component_id", "kept"]
    key = lambda f: sorted(map(tuple, f[order].astype(int).to_numpy().tolist()))
    assert key(results[4]) == key(theirs)


def test_recall(results):
    v = pd.read_parquet(f"{SF}/embeddings.parquet")
    x = np.stack(v.embedding.to_numpy()).astype(float)
    u, ids = x / np.linalg.norm(x, axis=1, keepdims=True), v.vec_id.to_numpy()
    hits = 0
    for q, own in results[3].groupby("query_id"):
        i = int(np.flatnonzero(ids == q)[0])
        near = u @ u[i]
        near[i] = -2
        hits += len(set(own.vec_id) & set(ids[np.argsort(-near, kind="stable")[:5]]))
    assert hits >= 0.9 * len(results[3])


def test_reshard_writes_the_shards(spark, monkeypatch):
    made, rewrite = [], queries.sharding.rewrite
    monkeypatch.setattr(queries.sharding, "rewrite", lambda docs, placed, path, **more: made.append(path) or rewrite(docs, placed, path, **more))
    out = queries.op6_min_cost_reshard(spark, SF).toPandas()
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    files = spark.read.parquet(made[0]).toPandas()
    key = lambda f, *c: sorted(map(tuple, f[list(c)].astype(str).to_numpy().tolist()))
    assert key(files, "doc_id", "text", "source") == key(docs, "doc_id", "text", "source")
    assert key(files, "doc_id", "shard", "slot") == key(out, "doc_id", "shard", "slot")
