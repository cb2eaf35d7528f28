"""A training corpus from ``documents``: filter, deduplicate, mix and pack.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame; all but the
last keep the columns of ``documents``. :func:`run` writes each stage's rows and reads them for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.llm import exact, jaccard, mixing, packing, shared, toxicity
from repolith.llm.queries import TOKENIZER, TOXIC


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score ``TOXIC`` or more; learns from the labelled documents outside the held-out third. Null and
    empty texts score the bias and stay; each row is judged by its text alone."""
    machine = toxicity.fit(docs, toxicity.learnable(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return docs.filter(toxicity.score(machine)(F.col("text")) < TOXIC)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact.without_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the smallest doc_id stays."""
    return jaccard.without_near_duplicates(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents towards the default targets of source, language and topic; nulls count as ``other``, rows of one id
    are drawn together."""
    return mixing.selected(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 tokens; null and empty texts are their end id alone."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), end_id=2, capacity=1024)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: A trained model and a tokenizer are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        # What a stage wrote on the way goes once its rows are written.
        with shared.scope(spark):
            docs = shared.written(stage(spark, docs, sf_dir), name.replace(" ", "-"), keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
