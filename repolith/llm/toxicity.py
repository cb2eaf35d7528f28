"""Toxicity by a factorisation machine over hashed terms.

Terms are words and their first 4, 5 and 6 bytes, ASCII lower-cased and hashed. A bounded sample of labelled documents
tells which terms set toxic documents apart (counts summed over tasks) and trains the machine: a weight and a few
factors for each term, so that pairs of terms can count for more or less than their sum. Scoring is a pass of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.llm import shared
from repolith.llm.text import Words, mix, texts

PREFIXES = (4, 5, 6)
BUCKETS = 1 << 20


def _terms(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, distinct buckets) of each text."""
    for row, _, data, offsets in texts(column, 1 << 20):
        words = Words(data, offsets)
        whole = words.hashes(lower=True)
        parts = [whole]
        ends = words.ends
        for i, k in enumerate(PREFIXES):
            words.ends = np.minimum(words.starts + k, ends)
            parts.append(mix(words.hashes(lower=True) + np.uint64(i + 1)))
        words.ends = ends
        buckets = (np.stack(parts, axis=1) & np.uint64(BUCKETS - 1)).astype(np.int64)
        for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
            yield row + i, np.unique(buckets[a:b])


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each task's rows: (bucket, documents, toxic documents)."""
    every, toxic = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.int32)
    for batch in batches:
        label = batch.column("toxic").to_numpy(zero_copy_only=False)
        for row, terms in _terms(batch.column("text")):
            every[terms] += 1
            toxic[terms] += int(label[row])
    some = np.flatnonzero(every)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(every[some].astype(np.int64)), pa.array(toxic[some].astype(np.int64))], ["bucket", "n", "x"])


@dataclass
class Machine:
    """Sorted ``buckets`` with their weights and factors, and the bias."""

    buckets: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def known(self, terms: np.ndarray) -> np.ndarray:
        if not len(self.buckets):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.buckets, terms), len(self.buckets) - 1)
        return at[self.buckets[at] == terms]

    def probability(self, terms: np.ndarray) -> float:
        at = self.known(terms)
        v = self.factors[at]
        z = self.bias + self.weights[at].sum() + 0.5 * (v.sum(0) ** 2 - (v**2).sum(0)).sum()
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(rows: list[np.ndarray], labels: np.ndarray, buckets: np.ndarray, k: int = 4, steps: int = 200, rate: float = 0.05, decay: float = 2e-4) -> Machine:
    """Adam on the log loss of all rows, each a list of indices into ``buckets``; deterministic."""
    rng = np.random.default_rng(7)
    n, m = len(rows), len(buckets)
    share = float(np.clip(labels.mean() if n else 0.1, 1e-3, 1 - 1e-3))
    bias, w, v = np.array([np.log(share / (1 - share))]), np.zeros(m), rng.normal(0, 0.01, (m, k))
    if not n or not m:
        return Machine(buckets, float(bias[0]), w, v)
    flat = np.concatenate(rows).astype(np.int64)
    doc = np.repeat(np.arange(n), [len(r) for r in rows])
    by_doc = lambda x: np.bincount(doc, x, n)
    by_term = lambda x: np.bincount(flat, x, m)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (bias, w, v)]
    for step in range(1, steps + 1):
        sums = np.stack([by_doc(v[flat, f]) for f in range(k)], 1)
        squares = by_doc((v[flat] ** 2).sum(1))
        z = bias[0] + by_doc(w[flat]) + 0.5 * ((sums**2).sum(1) - squares)
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels
        at = error[doc]
        slope_w = by_term(at) / n + decay * w
        slope_v = np.stack([by_term(at * (sums[doc, f] - v[flat, f])) for f in range(k)], 1) / n + decay * v
        for p, slope, (first, second) in zip((bias, w, v), (np.array([error.mean()]), slope_w, slope_v), state):
            first += 0.1 * (slope - first)
            second += 0.001 * (slope**2 - second)
            p -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Machine(buckets, float(bias[0]), w, v)


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 12_000, most_terms: int = 4096, common_terms: int = 256, least_chi: float = 30.0) -> Machine:
    """A machine from ``labels`` (doc_id, toxic) and the texts of ``docs`` (doc_id, text); other columns are ignored.

    Rows without id, text or label teach nothing; without any row the machine gives every text the same score. Of equal
    texts the one marked toxic counts. ``most_rows`` labelled documents, by least hash of their id, are the sample; equal texts count once. The driver
    gets ``most_terms`` terms by chi-squared, ``common_terms`` by frequency, and the sample's rows in those terms:
    bounded by the three parameters.
    """
    shared.small_batches(docs.sparkSession)
    known = labels.filter("doc_id is not null and toxic is not null").select("doc_id", "toxic", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)).alias("h"))
    # A threshold leaves some twice as many rows as are needed to be compared.
    chosen = known.filter(F.col("h") <= int(2 * most_rows / max(known.count(), 1) * (1 << 40))).orderBy("h", "doc_id").limit(most_rows).select("doc_id", "toxic")
    sample = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(chosen), "doc_id")
    sample = sample.groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic").persist()
    counts = sample.mapInArrow(_class_counts, "bucket long, n long, x long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    total = sample.agg(F.count("*"), F.sum("toxic")).first()
    n, x = total[0], total[1] or 0
    # Chi-squared of the term's two-by-two table.
    a, b = F.col("x"), F.col("n") - F.col("x")
    chi = n * F.pow(a * F.lit(float(n - x)) - b * F.lit(float(x)), F.lit(2)) / (F.col("n") * (n - F.col("n")) * F.lit(float(max(x * (n - x), 1))))
    telling = counts.filter(F.col("n") < n).filter("n >= 3").withColumn("chi", chi).filter(F.col("chi") >= least_chi).orderBy(F.desc("chi"), "bucket").limit(most_terms)
    # Terms that tell nothing alone may tell something in pairs: the most frequent ones are learned too.
    common = counts.filter((F.col("n") >= 0.02 * n) & (F.col("n") < 0.5 * n)).orderBy(F.desc("n"), "bucket").limit(common_terms)
    buckets = np.sort(np.array([r["bucket"] for r in telling.select("bucket").union(common.select("bucket")).distinct().collect()], np.int64))
    chooser = Machine(buckets, 0.0, np.zeros(len(buckets)), np.zeros((len(buckets), 1)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [chooser.known(terms) for _, terms in _terms(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int32()), pa.array(found, pa.list_(pa.int32()))], ["toxic", "terms"])

    table = sample.mapInArrow(rows, "toxic int, terms array<int>").toArrow()
    sample.unpersist()
    order = sorted((r["terms"], r["toxic"]) for r in table.to_pylist())
    return train([np.array(t, np.int64) for t, _ in order], np.array([y for _, y in order], float), buckets)


def score(machine: Machine):
    """A function from a column of texts to the probability that each is toxic; null and empty texts get the bias alone.
    Tasks receive the texts and nothing else of a row."""

    @F.arrow_udf("double")
    def scored(column: pa.Array) -> pa.Array:
        found = np.full(len(column), machine.probability(np.zeros(0, np.int64)))
        for row, terms in _terms(column):
            found[row] = machine.probability(terms)
        return pa.array(found)

    return scored


def learnable(labels: DataFrame) -> DataFrame:
    """Labels outside the held-out third: crc32 of the id as text, mod 3, is not 1."""
    return labels.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
