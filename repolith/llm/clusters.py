"""Clusters of vectors around centroids in exact integers, with Elkan's bounds.

A table of state carries each vector, its cluster, an upper bound of its distance to it and a lower bound to each other
centroid. A round is one map over the state: bounds and the distances between centroids exclude most centroids, what is
left is computed as integers. Tasks emit one row of sums besides, so centroids are averaged from a table whose size
depends on clusters and components alone; nothing is shuffled by cluster, so a hot vector makes no hot task. Bounds are
rounded outwards and exclude only what is strictly farther, so ties stay with the smaller number.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repolith.llm import shared

#: Components below this are added and squared as 64-bit integers; vectors with larger ones, and rounds with a larger
#: centroid, are computed with Python's integers and without bounds.
SMALL = 1 << 26
#: Entries of a row of sums that are no components.
COUNT, INERTIA = -1, -2
LONG = (1 << 63) - 1

_SUM = T.ArrayType(T.StructType([T.StructField("c", T.IntegerType()), T.StructField("d", T.IntegerType()), T.StructField("limb", T.IntegerType()), T.StructField("n", T.LongType())]))
_SUM_ARROW = pa.list_(pa.struct([("c", pa.int32()), ("d", pa.int32()), ("limb", pa.int32()), ("n", pa.int64())]))


def quantised(x: float) -> int:
    """floor(256 * x); large doubles are integers already."""
    return int(x) * 256 if abs(x) >= 1 << 53 else math.floor(256 * x)


def _down(root: np.ndarray) -> np.ndarray:
    """Bounds as 32-bit floats that are no larger than the roots of the integers behind ``root``."""
    return np.nextafter(np.float32(np.nextafter(root, -np.inf)), np.float32(-np.inf))


def _up(root: np.ndarray) -> np.ndarray:
    return np.nextafter(np.float32(np.nextafter(root, np.inf)), np.float32(np.inf))


def _root(squared: int, up: bool) -> float:
    """A bound of the root of an integer of any size."""
    root = (math.isqrt(squared << 40) + up) / (1 << 20) if squared < 1 << 200 else math.inf if up else 1e29
    return math.nextafter(root, math.inf if up else 0.0)


def between(a: list[int], b: list[int]) -> int:
    return sum((x - y) * (x - y) for x, y in zip(a, b))


class Round:
    """Centroids of one round, with half the distances between them and how far each one has come since the last."""

    def __init__(self, centres: list[list[int]], before: list[list[int]] | None = None):
        self.centres, k = centres, len(centres)
        self.small = all(abs(x) < SMALL for c in centres for x in c)
        self.half = np.zeros((k, k))
        for i in range(k):
            for j in range(i):
                self.half[i, j] = self.half[j, i] = _root(between(centres[i], centres[j]), False) / 2
        self.moved = np.array([_root(between(a, b), True) if a != b else 0.0 for a, b in zip(centres, before or centres)])
        self.array = np.array(centres, np.int64) if self.small else None

    def pruned(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, int]:
        """Assigns the rows of ``x`` and updates ``cluster`` (-1: none yet), ``upper`` and ``lower`` in place. Returns squared distances,
        -1 where none was needed, and how many were computed."""
        new = cluster < 0
        cluster[new] = 0
        upper[~new] = _up(upper[~new].astype(np.float64) + self.moved[cluster[~new]])
        lower[:] = np.maximum(_down(lower.astype(np.float64) - self.moved), 0)
        upper[new], lower[new] = np.inf, 0
        best = np.full(len(x), -1, np.int64)

        def squares(at: np.ndarray, centre: np.ndarray) -> np.ndarray:
            gap = x[at] - centre
            return np.einsum("ij,ij->i", gap, gap)

        left = (lower <= upper[:, None]) & (self.half[cluster] <= upper[:, None])
        left[np.arange(len(x)), cluster] = False
        rows = np.flatnonzero(left.any(1) | new)
        best[rows] = squares(rows, self.array[cluster[rows]])
        upper[rows], computed = _up(np.sqrt(best[rows].astype(np.float64))), len(rows)
        lower[rows, cluster[rows]] = _down(np.sqrt(best[rows].astype(np.float64)))
        for j in range(len(self.array)):
            at = rows[(cluster[rows] != j) & (lower[rows, j] <= upper[rows]) & (self.half[cluster[rows], j] <= upper[rows])]
            found = squares(at, self.array[j])
            computed += len(at)
            lower[at, j] = _down(np.sqrt(found.astype(np.float64)))
            wins = (found < best[at]) | ((found == best[at]) & (j < cluster[at]))
            at, found = at[wins], found[wins]
            best[at], cluster[at], upper[at] = found, j, _up(np.sqrt(found.astype(np.float64)))
        return best, computed

    def plain(self, vector: list[int]) -> tuple[int, int]:
        """(squared distance, number) of the nearest centroid."""
        return min((between(vector, c), j) for j, c in enumerate(self.centres))

    def own(self, x: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        gap = x - self.array[cluster]
        return np.einsum("ij,ij->i", gap, gap)


class _Sums:
    """Sums of components, counts and distances by cluster, as Python integers."""

    def __init__(self) -> None:
        self.of: dict[tuple[int, int], int] = {}

    def add(self, c: int, d: int, n: int) -> None:
        self.of[c, d] = self.of.get((c, d), 0) + n

    def entries(self) -> list[dict]:
        """Numbers below 2**40 as they are, larger ones in limbs of 32 bits, so that longs can hold the sums over all tasks."""
        out = []
        for (c, d), total in self.of.items():
            sign, rest, limb = (-1 if total < 0 else 1), abs(total), 0
            while rest or not limb:
                part = rest if limb == 0 and rest < 1 << 40 else rest & 0xFFFFFFFF
                out.append({"c": c, "d": d, "limb": limb, "n": sign * part})
                rest, limb = (0 if part == rest else rest >> 32), limb + 1
        return out


def _step(centres: Round, k: int, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, names, ids = _Sums(), None, None
        for batch in batches:
            names, n, ids = batch.schema.names, len(batch), batch.column("vec_id")
            cluster = batch.column("cluster").to_numpy(zero_copy_only=False).copy()
            distance: list[int | None] = [None] * n
            upper = batch.column("upper").to_numpy(zero_copy_only=False).astype(np.float32)
            lower = np.frombuffer(b"".join(batch.column("lower").to_pylist()), np.float32).reshape(n, k).copy()
            v, raw = batch.column("v"), batch.column("raw")
            fast = np.flatnonzero(v.is_valid().to_numpy(zero_copy_only=False)) if centres.small else np.zeros(0, np.int64)
            if len(fast):
                x = v.drop_null().flatten().to_numpy().astype(np.int64).reshape(len(fast), -1)
                c, u, low = cluster[fast], upper[fast], lower[fast]
                centres.pruned(x, c, u, low)
                cluster[fast], upper[fast], lower[fast] = c, u, low
                if last:
                    exact = centres.own(x, c)
                    for i, d in zip(fast.tolist(), exact.tolist()):
                        distance[i] = d
                for j in np.unique(c).tolist():
                    own = x[c == j]
                    sums.add(j, COUNT, len(own))
                    for d, total in enumerate(own.sum(0).tolist()):
                        sums.add(j, d, total)
                    if last:
                        sums.add(j, INERTIA, int(exact[c == j].sum(dtype=object)))
            for i in np.setdiff1d(np.arange(n), fast).tolist():
                vector = v[i].as_py() or [quantised(a) for a in raw[i].as_py()]
                squared, j = centres.plain(vector)
                cluster[i], upper[i], lower[i] = j, np.inf, 0
                distance[i] = squared if squared <= LONG else None
                sums.add(j, COUNT, 1)
                sums.add(j, INERTIA, squared)
                for d, a in enumerate(vector):
                    sums.add(j, d, a)
            bounds = pa.array([row.tobytes() for row in lower], pa.binary())
            columns = [ids, v, raw, pa.array(cluster, pa.int32()), pa.array(distance, pa.int64()), pa.array(upper, pa.float32()), bounds, pa.nulls(n, _SUM_ARROW)]
            yield pa.RecordBatch.from_arrays(columns, [*names[:4], "distance", *names[4:], "sums"])
        if names:
            none = [pa.nulls(1, t) for t in (ids.type, v.type, raw.type, pa.int32(), pa.int64(), pa.float32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, pa.array([sums.entries()], _SUM_ARROW)], [*names[:4], "distance", *names[4:], "sums"])

    return step


def _totals(table: DataFrame) -> dict[tuple[int, int], int]:
    """Sums over all tasks: a number for each cluster and component, so their size is that of the centroids."""
    rows = table.filter("sums is not null").select(F.inline("sums")).groupBy("c", "d", "limb").agg(F.sum("n").alias("n")).collect()
    out: dict[tuple[int, int], int] = {}
    for r in rows:
        out[r.c, r.d] = out.get((r.c, r.d), 0) + (r.n << 32 * r.limb)
    return out


def clustered(vectors: DataFrame, k: int = 40, rounds: int = 5, components: int = 64, seed: int = 2) -> DataFrame:
    """One row for each kept row of ``vectors`` (vec_id, embedding): vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly ``components`` components, none null or not finite; others have no row. Each component x
    counts as floor(256 * x). The first centroids are the ``k`` kept vectors with the smallest SHA-256 of ``seed:vec_id``
    (equal ids: by components; a null id is the empty string), fewer if there are fewer. ``rounds`` times every vector
    goes to its nearest centroid, of equally near ones to that of the smallest number, and centroids that have vectors
    become their floored means; then vectors are assigned once more. distance is squared; cluster_inertia and inertia
    sum it over the cluster and over all; those beyond 64 bits are null. The hash is of the final centroid's components, joined
    by commas. Repeated rows count each. An empty table gives an empty table; other columns are ignored.
    """
    spark = vectors.sparkSession
    shared.small_batches(spark)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    kept = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("e")).filter((F.size("e") == components) & F.forall("e", finite))
    small = F.forall("e", lambda x: F.abs(x) < SMALL >> 8)
    kept = kept.select("vec_id", F.when(small, F.transform("e", lambda x: F.floor(x * 256).cast("int"))).alias("v"), F.when(~small, F.col("e")).alias("raw"))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.orderBy(order, "vec_id", "v", "raw").limit(k).collect()
    centres, before = [r.v or [quantised(a) for a in r.raw] for r in first], None
    k = len(centres)
    state = kept.select("*", F.lit(-1).alias("cluster"), F.lit(float("inf")).cast("float").alias("upper"), F.lit(bytes(4 * k)).alias("lower"))
    schema = T.StructType([*state.schema.fields[:4], T.StructField("distance", T.LongType()), *state.schema.fields[4:], T.StructField("sums", _SUM)])
    for field in schema.fields:
        field.nullable = True
    path = None
    for turn in range(rounds + 1):
        table = state.mapInArrow(_step(Round(centres, before), k, turn == rounds), schema)
        was, path = path, shared.until_exit(spark, shared.new_path(spark, "clusters"))
        table.write.parquet(path)
        if was:
            shared.delete(spark, was)
        table = spark.read.schema(schema).parquet(path)
        total = _totals(table)
        state = table.filter("sums is null").select("vec_id", "v", "raw", "cluster", "upper", "lower")
        if turn < rounds:
            before = centres
            centres = [[total[c, d] // total[c, COUNT] for d in range(components)] if (c, COUNT) in total else old for c, old in enumerate(centres)]
    fits = lambda n: n if n <= LONG else None
    inertia = sum(total.get((c, INERTIA), 0) for c in range(k))
    report = [(c, fits(total.get((c, INERTIA), 0)), fits(inertia), hashlib.sha256(",".join(map(str, centre)).encode()).hexdigest()) for c, centre in enumerate(centres)]
    # A row for each centroid.
    report = F.broadcast(spark.createDataFrame(report, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    return table.filter("sums is null").select("vec_id", "cluster", "distance").join(report, "cluster").select("vec_id", "cluster", "distance", *report.columns[1:])
