"""Quality rules of documents and verdicts on their hosts, with DataFrame operations only.

Rules are evaluated on each document by itself. Failures are summed by host, each host's rate is shrunk towards the
mean of all hosts by a beta prior that is fitted to the hosts' own rates, and hosts that fail too often take their
documents with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.llm import shared

WORD = r"[^\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def features(docs: DataFrame) -> DataFrame:
    """For each row of ``docs`` (doc_id, text, source): doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    n_repeat_words: words within 3-word windows that the text holds twice or more. Windows are sorted by hash with
    their places, so equal ones are neighbours: n log n for any text. Null texts have no words.
    """
    text = F.coalesce("text", F.lit(""))
    length = lambda c: F.char_length(c).cast("long")
    rows = docs.select(
        "doc_id", F.col("source").alias("host"),
        F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words"),
        length(F.translate(text, WHITE, "")).alias("word_chars"),
        (length(text) - length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]"))).alias("lines"),
    )
    n = F.size("words")
    # Hashes of windows, each with its place.
    windows = F.when(
        n >= 3,
        F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda i: F.struct(F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("i")),
        ),
    ).otherwise(F.array().cast("array<struct<h: bigint, i: int>>"))
    rows = rows.withColumn("sorted", F.sort_array(windows))
    equal = lambda x, i: (x["h"] == F.get("sorted", i - 1)["h"]) | (x["h"] == F.get("sorted", i + 1)["h"])
    rows = rows.withColumn("places", F.sort_array(F.transform(F.filter("sorted", lambda x, i: F.coalesce(equal(x, i), F.lit(False))), lambda x: x["i"])))
    step = F.transform("places", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("places", i + 1) - p, F.lit(3))))
    covered = F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select(
        "doc_id", "host", n.cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
    )


def judged(rows: DataFrame, most_symbols: float = 0.2, most_dup_lines: float = 0.5, host_limit: float = 0.5, least_prior: float = 10.0, most_broadcast: int = 100_000) -> DataFrame:
    """``rows`` of :func:`features` with base_failed, failed (one of four rules), host_rate and kept.

    A host's rate is that of its documents that fail a rule: (failures + a) / (documents + a + b), with a and b from
    mean and variance of the hosts' raw rates (method of moments; the prior weighs ``least_prior`` documents at least).
    A host is rejected above ``host_limit``. Documents without a host are judged by themselves.
    """
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    more = (F.col("n_symbols") > most_symbols * F.col("word_chars")) | (F.col("n_dup_lines") > most_dup_lines * F.col("n_words"))
    # Counts are summed before the shuffle, so hosts of any size are cheap.
    rows = rows.withColumn("base_failed", base).withColumn("failed", base | more)
    hosts = rows.filter("host is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("x"))
    total = hosts.agg(
        (F.sum("x") / F.sum("n")).alias("m"),
        F.sum("n").alias("docs"),
        F.count("*").alias("hosts"),
        F.var_pop(F.col("x") / F.col("n")).alias("v"),
        F.avg(1 / F.col("n")).alias("inverse"),
    )
    # Between hosts' variance: what their rates vary beyond sampling of their documents.
    between = F.greatest(F.col("v") - F.col("m") * (1 - F.col("m")) * F.col("inverse"), F.lit(1e-9))
    weight = F.greatest(F.col("m") * (1 - F.col("m")) / between - 1, F.lit(least_prior))
    prior = total.select("m", F.least(weight, F.lit(1e6)).alias("weight"))
    # The prior is one row: each host is joined to it by a constant key.
    rates = (
        hosts.withColumn("one", F.lit(1)).join(F.broadcast(prior.withColumn("one", F.lit(1))), "one")
        .select("host", ((F.col("x") + F.col("m") * F.col("weight")) / (F.col("n") + F.col("weight"))).alias("host_rate"))
    )
    # Hosts are as many as the web has: they are broadcast up to a checked number, else AQE splits the join's large hosts.
    rates = shared.written(rates, "host-rates")
    out = rows.join(F.broadcast(rates) if rates.count() <= most_broadcast else rates, "host", "left")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("host_rate") > host_limit, F.lit(False)))


def quality_report(docs: DataFrame, **limits: float) -> DataFrame:
    """One row for each row of ``docs``; the features are computed once and written to the shared folder."""
    return judged(shared.written(features(docs), "quality"), **limits).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host", "host_rate"
    )
