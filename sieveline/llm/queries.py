"""The queries of this subpackage, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ctw, fim, media, merkle, mixing, neardup, oracles, pieces, sharding, suffixes, tokens, toxicity, urls, vptree
from ._shared import Scratch, fold_case, fold_of, table


#: The contract's rules: verdict, host, path.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Pruning factor of the nearest-neighbour search.
NEAR_FACTOR = 1.15


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op2_mil_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, fold_of(F.col("doc_id"), 5) != 0)
    scored = toxicity.score(docs, model)
    worst = F.array_max(F.transform("offending", lambda s: F.struct(s["score"], s["begin"], s["end"])))
    return scored.select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted", F.size("offending").alias("n_offending"), worst["begin"].alias("worst_begin"), worst["end"].alias("worst_end"))


def op3_vantage_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, factor=NEAR_FACTOR)


def op4_superminhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles at 0.85; 25 bands of 6 slots miss a pair at the threshold with probability 7e-6."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85, bands=25, width=6)


def tokenizer_model() -> str:
    """The model file: $SIEVELINE_PIECE_MODEL or the public 32k model."""
    import public_tokenizers

    return os.environ.get("SIEVELINE_PIECE_MODEL") or public_tokenizers.path("piece_bpe_32k.model")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans go into `spans_sha256`."""
    return pieces.encode(table(spark, sf_dir, "documents"), tokenizer_model(), pieces=False, digests=True)


def op6_min_cost_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve old shards by source, so of very unequal sizes, into sixteen of equal bytes.

    The affected shards are written, and their rows come from the files read back; the rows of a shard that keeps its
    files come from the table.
    """
    docs = table(spark, sf_dir, "documents")
    old = F.pmod(F.crc32(F.coalesce(F.col("source"), F.lit("")).cast("binary")), F.lit(12)).cast("int")
    placed = sharding.reshard(docs, old, n_old=12, n_new=16)
    files = Scratch(spark, "shards").path("new")
    touched = sharding.rewrite(docs, placed, files, old=old)
    columns = ["doc_id", "size", "text_crc32", "shard", "slot", "old_shard"]
    rows = placed.filter(~F.col("shard").isin(touched)).select(columns)
    if touched:
        raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
        back = spark.read.schema(docs.drop("shard", "slot").withColumns({"slot": F.lit(0).cast("long"), "shard": F.lit(0)}).schema).parquet(files)
        back = back.withColumns({"size": (F.octet_length(raw) + 1).cast("long"), "text_crc32": F.crc32(raw), "old_shard": old}).select(columns)
        rows = back.unionByName(rows) if len(touched) < 16 else back
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op7_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the public 50k byte vocabulary in 16 bits; 50256, which it leaves free, ends a document."""
    import public_tokenizers

    return tokens.count(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 50256)


def op8_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media(table(spark, sf_dir, "documents"))


def op9_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = ctw.score(docs, fold_of(docs["doc_id"], 7) != 2)
    return scored.select("doc_id", (~F.col("learned")).alias("held_out"), *scored.columns[2:])


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = fim.restored(F.col("fim.output"), F.col("fim.form"))
    return done.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", F.sha2("fim.output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of the rows are tampered with: their texts are lower-cased before they are checked against the manifest."""
    docs = table(spark, sf_dir, "documents")
    fields = lambda text: [docs["doc_id"], docs["source"], docs["lang"], docs["n_chars"], text]
    checked = F.when(fold_of(docs["doc_id"], 5) == 0, merkle.leaf(fields(fold_case(docs["text"]))))
    out = merkle.manifest(docs, merkle.leaf(fields(docs["text"])), group="source", key="doc_id", carry=[("tampered", checked)])
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("path"))
    out = out.withColumns({"proof_sha256": merkle.proof(F.col("path")), "folded_root": folded})
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffixes.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=200)
    return done.select("doc_id", "repeats.n_bytes", "repeats.n_removed", "repeats.n_spans", "repeats.kept_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_rules, op2_mil_toxicity, op3_vantage_point, op4_superminhash_neardup, op5_sentencepiece, op6_min_cost_reshard, op7_separator_scan, op8_ogg_media, op9_entropy_mix, op10_context_tree, op11_fill_in_middle, op12_merkle_manifest, op13_repeated_windows)}


def oracle_sql() -> dict[str, str]:
    return {"op4_superminhash_neardup": oracles.NEARDUP, "op11_fill_in_middle": oracles.FILL_IN_MIDDLE, "op12_merkle_manifest": oracles.merkle(), "op13_repeated_windows": oracles.repeated_windows()}
