"""Exact duplicates by two passes over a Bloom filter, with DataFrame operations only.

Pass one reads the texts alone and counts hash positions, summed before the shuffle; positions hit twice or more make
the filter. Pass two reads the rows again: those that the filter excludes have no equal and pass straight through,
the others shuffle, by a SHA-256 digest that decides equality.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolith.llm import bloom, shared


def normalised(text: Column) -> Column:
    """A-Z lower-cased and nothing else; null is empty. Texts of ASCII only take the JVM's faster ``lower``."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def _split(docs: DataFrame, per_row: int) -> DataFrame:
    """``row`` (all of a row of ``docs``), ``norm`` (its normalised text) and ``maybe``: whether another row may have an
    equal text."""
    bits = bloom.filter_bits(docs.count(), per_row)
    hashes = docs.select(F.xxhash64(normalised(F.col("text"))).alias("h"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), normalised(F.col("text")).alias("norm"))
    return bloom.flagged(rows, F.xxhash64("norm"), bloom.repeated_filter(hashes, "h", bits), bits, "maybe")


def duplicate_report(docs: DataFrame, bits_per_row: int = 64) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays; null ids come last, and of rows that repeat that doc_id with
    an equal text one stays. Null texts count as empty. An empty table gives an empty table; other columns are ignored.
    """
    rows = _split(docs.select("doc_id", "text"), bits_per_row).select("row.doc_id", F.sha2("norm", 256).alias("text_sha256"), "maybe")
    alone = rows.filter("not maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    # A row for each distinct (digest, doc_id) and its count; a hot digest is summed before the shuffle.
    counted = rows.filter("maybe").groupBy("text_sha256", "doc_id").agg(F.count("*").alias("n"))
    # Written, so that the join below deals its sides itself and can split a large group.
    groups = shared.written(counted.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size")), "groups")
    copies = (
        counted.join(groups, "text_sha256")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
        .select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")
    )
    return alone.unionByName(copies)


def without_duplicates(docs: DataFrame, bits_per_row: int = 64) -> DataFrame:
    """``docs`` with one whole row of each set of equal texts: that with the largest doc_id (null ids last; of equal ids
    the one whose other columns hash highest). Keeps all columns, whatever they are called."""
    split = _split(docs, bits_per_row)
    order = F.struct(F.col("row.doc_id").isNotNull(), F.col("row.doc_id"), F.xxhash64("row"))
    best = split.filter("maybe").groupBy(F.sha2("norm", 256).alias("digest")).agg(F.max_by("row", order).alias("row"))
    return split.filter("not maybe").select("row").unionByName(best.select("row")).select("row.*")
