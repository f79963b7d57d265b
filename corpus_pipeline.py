"""A corpus made from ``documents``: toxic and poor documents go, one document of each
group of near duplicates stays, sources are mixed to target weights, and texts become token ids.

Each stage takes what its predecessor wrote and returns the columns of
``documents``, the last one the ids.  A stage on an empty table returns an empty table.

Null text is the empty text and is scored like any; a null source is a source of its own; rows
with a null id stay unless their text is that of a row with an id.  Texts are read
whole, however long.  Rows with equal id and text are one document, rows that share only the id are
documents of their own.  Ties: of a group of near duplicates the document with the least id
stays; a score at the threshold counts as toxic, and as good.  Further columns, whatever their
names, are carried along up to the last stage, which leaves them out.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, mixing, ominhash, quality, toxicity
from quarry.llm.queries import QUALITY_FROM, TOXIC_FROM, VOCABULARY
from quarry.llm.tables import remainder_of_id, table
from quarry.session import ensure_checkpoint_dir


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold."""
    labelled = toxicity.labelled_documents(docs, table(spark, sf_dir, "labels"), "toxic",
                                           remainder_of_id("doc_id", 3) != 1, toxicity.FIT_ROWS)
    scored = toxicity.score_documents(docs, toxicity.fit(labelled), out="__score")
    return scored.where(F.col("__score") < TOXIC_FROM).drop("__score")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality reaches the threshold."""
    labelled = toxicity.labelled_documents(docs, table(spark, sf_dir, "labels"), "quality",
                                           remainder_of_id("doc_id", 5) != 0, quality.FIT_ROWS)
    scored = quality.score_documents(docs, quality.fit(labelled), out="__score")
    return scored.where(F.col("__score") >= QUALITY_FROM).drop("__score")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near duplicates."""
    return ominhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document; ``exact`` says whether they decode to its text."""
    kept = [c for c in ("doc_id", "text", "lang", "source", "n_chars") if c in docs.columns]
    return bpe.tokenise_documents(docs.select(*kept), VOCABULARY, public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", not_toxic), ("quality", good_quality), ("near_dedup", one_of_each),
    ("mixing", mixed), ("byte_bpe", tokens)]

#: Models, sketches and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}_{name}")
            docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return docs
