"""A corpus pipeline over `documents`: reject toxic texts, keep one of each group of near-duplicates, mix the sources, tokenise.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again
as the next stage's documents.  Rows are judged one by one by their own texts, whether their ids are null, repeated or
neither.  All but the last stage return the columns of `documents`; in the mixed corpus a
document occurs once for each of its copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import mixing, neardup, pieces, toxicity
from sieveline.llm._shared import Scratch, fold_of, fresh, table
from sieveline.llm.queries import tokenizer_model


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the model, trained on the labelled ones of this corpus, holds to be toxic."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold_of(F.col("doc_id"), 5) != 0)
    return toxicity.filter_clean(docs, model)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8 or more; one row of each group stays, that with the smallest id, null last.

    Texts without shingles are alike only if id and text are equal or both null.
    """
    scratch = Scratch(spark, "kept")
    row = fresh(docs, "_row")
    rows = scratch.numbered(docs, "rows", row)
    groups = neardup.near_duplicates(rows, doc_id=row, words=5, percent=80, bands=30, width=5)
    groups = scratch.table(groups.select(F.col(row).alias("_row"), "component_id", "n_shingles"), "groups")
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))["_row"].alias("_row")
    narrow = rows.select(F.col(row).alias("_row"), "doc_id", "text")
    first = narrow.select("_row", "doc_id").join(groups.filter("n_shingles > 0"), "_row").groupBy("component_id").agg(least).select("_row")
    bare = narrow.join(groups.filter("n_shingles = 0").select("_row").hint("merge"), "_row", "left_semi").groupBy("doc_id", "text").agg(F.min("_row").alias("_row"))
    kept = scratch.table(first.unionByName(bare.select("_row")), "ids")
    return rows.join(kept.withColumnRenamed("_row", row).hint("merge"), row, "left_semi").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weigh 5, 2, 1, repeating, and share 150% of all words; a row for every copy taken."""
    return mixing.mixed_rows(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids, spans of bytes in the text, and digests of every row."""
    return pieces.encode(docs, tokenizer_model(), pieces=True, digests=True)


STAGES = [("toxicity", reject_toxic), ("near_duplicates", one_of_each_group), ("mix", mix_sources), ("sentencepiece", tokenise)]

#: The stages are beyond SQL; tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
