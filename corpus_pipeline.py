"""Corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input.

Stages: (name, function of (spark, docs, sf_dir) returning a DataFrame). All but the last keep the columns of
``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.llm.mixing import mixed_documents
from signalloom.llm.packing import pack_documents
from signalloom.llm.paritysketch import SMALL, near_duplicates
from signalloom.llm.store import shared_folder, stored
from signalloom.llm.tokens import public_path
from signalloom.llm.toxicity import score_documents, train


def set_aside(docs: DataFrame, *used: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with columns that a stage uses for itself under free names, and the names of all its columns there."""
    names = [f"{uuid.uuid4().hex}_{c}" if c.lower() in used else c for c in docs.columns]
    return docs.toDF(*names), names


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold; the classifier learns from labelled documents.

    Null and empty texts score the intercept, very long ones are scored whole, repeated rows each. Without labels, or
    labels of one kind, nothing is rejected unless the intercept says so. Extra columns stay as they are, whatever their
    names; empty documents give no rows."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs.select("doc_id", "text"), labels)
    rows, names = set_aside(docs, "score", "predicted")
    return score_documents(rows, model).where(F.col("predicted") == 0).select(names).toDF(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates (five words, Jaccard similarity of 0.8 or
    more); documents without id or words stay. Rows that repeat an id and text, or a text without id, are one document:
    one of them stays, with the extra columns of any one of them. Extra columns may have any names; empty documents give
    no rows."""
    groups = near_duplicates(docs.select("doc_id", "text"), shingle=5, num=80, den=100)
    gone = stored(groups.where("doc_id is not null and component_id <> doc_id").select("doc_id").distinct())
    small = gone.count() <= SMALL
    rows, names = set_aside(docs, "digest")
    kept = rows.join(F.broadcast(gone) if small else gone, "doc_id", "left_anti").withColumn("digest", F.sha2("text", 256))
    return kept.dropDuplicates(["doc_id", "digest"]).select(names).toDF(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the weights of their domain, language and source; those of several epochs come several times.

    A null language or source is the empty name, an unknown source the domain ``other``. Rows of one id are taken together.
    Null, empty and blank texts add no tokens and are taken with their leaf; a leaf of nothing else has no budget. Extra
    columns stay as they are, whatever their names; empty documents give no rows."""
    rows, names = set_aside(docs, "mix_domain", "mix_lang", "mix_source", "epoch", "tokens", "leaf_budget", "supply", "whole", "rest", "cut", "epochs")
    return mixed_documents(rows).select(names).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all kept documents in sequences.

    Null and empty texts are one end id, texts longer than a sequence are cut into several pieces, repeated rows and epochs
    are packed each. Extra columns are ignored; empty documents give no rows."""
    return pack_documents(docs.select("doc_id", "text"), public_path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", one_of_each), ("mixing", mix), ("packing", pack)]

#: SQL expresses neither the classifier nor the tokenizer; the tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
