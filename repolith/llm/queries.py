"""The numbered queries, thin digests of the operators' results, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.llm import clusters, exact, hmm, jaccard, licenses, mixing, packing, pii, quality, shared, substrings, token_counts, toxicity, trie

TOXIC = 0.7
TOKENIZER = "byte_bpe_50k.json"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir), width=4, percent=85)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), end_id=2, capacity=1024)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base kinds; ``spans`` lists all kinds and ``n_spans`` counts them."""
    found = pii.find_spans(documents(spark, sf_dir))
    entry = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    listed = lambda spans: F.array_join(F.transform(spans, entry), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    return found.select(
        "doc_id", *[count(k) for k in pii.KINDS[:4]], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mixed(documents(spark, sf_dir))
    return rows.select("row.doc_id", "source", "lang", "topic", F.col("tokens").alias("n_words"), F.round("probability", 6).alias("probability"), "selected")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    machine = toxicity.fit(docs, toxicity.learnable(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    scored = docs.select("doc_id", held_out.alias("held_out"), toxicity.score(machine)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= TOXIC).cast("int"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(documents(spark, sf_dir), window=20)


def op8_hidden_markov_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.language_scores(documents(spark, sf_dir))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicate_report(documents(spark, sf_dir))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts are cached in the shared folder: a later run encodes only contents that no run before it met."""
    cache = f"{shared.shared_dir(spark)}/repolith/token-counts"
    counts = token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), cache)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and places of the base phrases, labels of both kinds; ``spans`` lists what the rules found as label:form:start:end."""
    found = licenses.find_licenses(documents(spark, sf_dir))
    labels = lambda spans: F.transform(spans, lambda s: s["label"])
    listed = lambda names: F.array_join(F.array_sort(F.array_distinct(names)), ",")
    starts = F.transform("base", lambda s: s["start"])
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        listed(labels(F.col("base"))).alias("base_labels"), listed(F.concat(labels(F.col("base")), labels(F.col("spans")))).alias("labels"), "score",
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["form"], s["start"], s["end"])), ",").alias("spans"),
    )


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=40, rounds=5, components=64, seed=2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_ngram_jaccard_join, op2_best_fit_packing, op3_quality_rules, op4_pii, op5_mixing, op6_toxicity,
        op7_substring_dedup, op8_hidden_markov_scores, op9_exact_dedup, op10_token_counts, op11_conversation_trie, op12_license_scan, op13_centroid_clusters,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    from repolith.llm import sql

    return sql.ORACLES
