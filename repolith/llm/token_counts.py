"""Token counts through a cache keyed by digests of content and tokenizer.

Contents that occur once (by a two-pass Bloom filter) are encoded where they are read; only possibly repeated ones
shuffle, to be encoded once. The cache is a Parquet table (version, digest, n_tokens) to which misses are appended.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from repolith.llm import bloom, shared, tokens

CACHE_SCHEMA = "version string, digest binary, n_tokens long"


def _counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = tokens.encoder(path)
        for batch in batches:
            counts = [len(ids(text.as_py())) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return count


def _stored(spark, cache: str, version: str) -> DataFrame | None:
    try:
        rows = spark.read.schema(CACHE_SCHEMA).parquet(cache).filter(F.col("version") == version)
        # Two writers may have stored one digest.
        return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, bits_per_row: int = 64) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_bytes (UTF-8), n_tokens.

    ``tokenizer``: a file that every executor has. ``cache``: a table in shared storage that is made where it is missing;
    without one, a new one is used.
    Null texts count as empty; repeated rows each get a row; an empty table gives an empty table.
    """
    spark, version = docs.sparkSession, tokens.version(tokenizer)
    shared.small_batches(spark)
    cache = cache or shared.new_path(spark, "token-counts")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    bits = bloom.filter_bits(docs.count(), bits_per_row)
    contents = rows.select("digest", "text")
    stored = _stored(spark, cache, version)
    if stored is not None:
        contents = bloom.anti_join(contents, stored, "digest", bits)
    repeated = bloom.repeated_filter(docs.select(F.xxhash64(text).alias("h")), "h", bits)
    split = bloom.flagged(contents, F.xxhash64("text"), repeated, bits, "maybe")
    misses = split.filter("not maybe").drop("maybe").unionByName(split.filter("maybe").groupBy("digest").agg(F.first("text").alias("text")))
    found = misses.mapInArrow(_counter(tokenizer), "digest binary, n_tokens long")
    found.select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache)
    counts = _stored(spark, cache, version)
    slim = rows.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    return slim.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens")
