"""Packing tokenised documents into sequences of bounded length by bin completion.

Lengths are whole numbers up to the sequence length, so how many pieces have each length says all that matters. That
histogram (one row for each length, 1024 at most by default) goes to the driver, where best fit and bin completion find
patterns and how often each is used. A small table of ranges of ranks takes each piece to its place; pieces never leave Spark.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repolith.llm import shared, tokens

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces of each document's ids and its end id; a longer document's first piece holds what is left over."""
    shared.small_batches(docs.sparkSession)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(tokenizer)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                found = encode(text.as_py() or "")
                ids = np.empty(len(found) + 1, "<u4")
                ids[:-1], ids[-1] = found, end_id
                bounds = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                out += [(doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]
            columns = zip(*out) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(pieces, PIECES)


#: Times, and the lengths of one bin with how many pieces of each it holds, longest first.
Pattern = tuple[int, tuple[tuple[int, int], ...]]


def least_bins(left: np.ndarray, capacity: int) -> int:
    """No packing of ``left`` (pieces of each length) has fewer bins: pieces over half a bin need one each, and what is
    at least a and doesn't fit beside them needs more, for each a up to half a bin."""
    sizes = np.arange(capacity + 1)
    number = np.concatenate([[0], np.cumsum(left)])
    total = np.concatenate([[0], np.cumsum(left * sizes)])
    a, half = np.arange(capacity // 2 + 1), capacity // 2 + 1
    over = number[-1] - number[half]
    # Pieces that leave room for a: over half, up to capacity - a.
    top = capacity - a + 1
    room = np.maximum(number[top] - number[half], 0) * capacity - np.maximum(total[top] - total[half], 0)
    small = total[half] - total[a]
    return int(over + np.maximum(-(-(small - room) // capacity), 0).max())


def best_fit(left: np.ndarray, capacity: int) -> list[Pattern]:
    """Best fit by falling length: each piece goes to the fullest bin that has room. Like bins are kept as one group; each
    length adds at most four groups."""
    by_room: dict[int, list[list]] = {}
    for size in np.flatnonzero(left)[::-1].tolist():
        n = int(left[size])
        for room in sorted(r for r in by_room if r >= size):
            fits = room // size
            groups, by_room[room] = by_room[room], []
            for times, use in groups:
                full = min(times, n // fits)
                n -= full * fits
                one = n if full < times and n else 0
                n -= one
                for k, pieces in ((full, fits), (1 if one else 0, one), (times - full - (1 if one else 0), 0)):
                    if k:
                        by_room.setdefault(room - pieces * size, []).append([k, (*use, (size, pieces)) if pieces else use])
            if not by_room[room]:
                del by_room[room]
            if not n:
                break
        fits = capacity // size
        for k, pieces in ((n // fits, fits), (1, n % fits)):
            if k and pieces:
                by_room.setdefault(capacity - pieces * size, []).append([k, ((size, pieces),)])
    return [(k, use) for groups in by_room.values() for k, use in groups]


def _fillings(room: int, left: list[int], steps: int) -> tuple[list[tuple[tuple[int, int], ...]], bool]:
    """Undominated ways to fill ``room``, least waste first and then the largest pieces first; and whether the search ended.

    A filling into which a remaining piece would still fit is dominated by the one with that piece; of two with equally
    many pieces, one that is nowhere larger is dominated by the other. ``steps`` bounds the search.
    """
    found: list[tuple[int, tuple[tuple[int, int], ...]]] = []
    sizes = [s for s in range(min(room, len(left) - 1), 0, -1) if left[s]]

    def grow(at: int, rest: int, taken: tuple[tuple[int, int], ...]) -> None:
        nonlocal steps
        steps -= 1
        while at < len(sizes) and sizes[at] > rest:
            at += 1
        if at == len(sizes):
            used = dict(taken)
            if not any(s <= rest and left[s] > used.get(s, 0) for s in sizes):
                found.append((rest, taken))
            return
        for n in range(min(left[sizes[at]], rest // sizes[at]), -1, -1):
            if steps <= 0 and found:
                return
            grow(at + 1, rest - n * sizes[at], (*taken, (sizes[at], n)) if n else taken)

    # One or two pieces that fill the room exactly are looked up first.
    exact = [(0, ((room, 1),))] if room < len(left) and left[room] else []
    for s in sizes:
        if s < room <= 2 * s and left[room - s] > (room == 2 * s):
            exact.append((0, ((s, 1), (room - s, 1)) if room < 2 * s else ((s, 2),)))
    if steps < 1000 and exact:
        return [f for _, f in exact[:3]], False
    grow(0, room, ())
    flat = lambda f: [s for s, n in f for _ in range(n)]
    best: list[tuple[list[int], tuple[tuple[int, int], ...]]] = []
    for _, filling in sorted(set(found + exact), key=lambda f: (f[0], [-s for s in flat(f[1])])):
        mine = flat(filling)
        if not any(len(theirs) == len(mine) and all(a >= b for a, b in zip(theirs, mine)) for theirs, _ in best):
            best.append((mine, filling))
    return [f for _, f in best], steps > 0


def complete_bins(counts: dict[int, int], capacity: int, nodes: int = 1500, exhaustive: int = 60) -> list[Pattern]:
    """Patterns that place all ``counts`` pieces in few bins, never more than best fit by falling length needs.

    Depth-first branch and bound: the largest length left is completed by each undominated filling, as often as the
    counts allow and then once. Best fit of all pieces is the first incumbent, and its completions of partial solutions
    are further ones; a branch ends when its bins and the least bins of the rest can't beat the incumbent, the search
    when the incumbent meets the bound of all pieces or after ``nodes`` fillings. Up to ``exhaustive`` pieces a filling's
    search isn't cut either, so that the result is a minimum unless the budget of nodes ran out.
    """
    start = np.zeros(capacity + 1, np.int64)
    for s, n in counts.items():
        start[s] = n
    best = best_fit(start, capacity)
    bins_of = lambda patterns: sum(k for k, _ in patterns)
    least, fewest = least_bins(start, capacity), bins_of(best)
    whole = int(start.sum()) <= exhaustive
    budget = nodes * (20 if whole else 1)
    stack: list[tuple[np.ndarray, list, int]] = [(start, [], 0)]
    while stack and fewest > least and budget > 0:
        left, chosen, bins = stack.pop()
        if bins + least_bins(left, capacity) >= fewest:
            continue
        budget -= 1
        if whole or budget % 16 == 0 or len(chosen) < 8:
            rest = best_fit(left, capacity)
            if bins + bins_of(rest) < fewest:
                best, fewest = chosen + rest, bins + bins_of(rest)
        top = int(np.flatnonzero(left)[-1])
        left[top] -= 1
        fillings, _ = _fillings(capacity - top, left.tolist(), 100_000 if whole else 200)
        left[top] += 1
        options: list[tuple[int, tuple]] = []
        for filling in fillings or [()]:
            use = dict(filling)
            use[top] = use.get(top, 0) + 1
            options.append((min(int(left[s]) // n for s, n in use.items()), tuple(sorted(use.items(), reverse=True))))
        options += [(1, use) for times, use in options if times > 1]
        for times, use in reversed(options if whole else options[:4]):
            after = left.copy()
            for s, n in use:
                after[s] -= times * n
            if after.any():
                stack.append((after, [*chosen, (times, use)], bins + times))
            elif bins + times < fewest:
                best, fewest = [*chosen, (times, use)], bins + times
    return best


def slots(patterns: list[tuple[int, tuple[tuple[int, int], ...]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first bin, pieces of it in a bin, first offset) for each length of each pattern."""
    out, taken, first_bin = [], {}, 0
    for times, use in patterns:
        offset = 0
        for length, n in use:
            rank = taken.get(length, 0)
            out.append((length, rank, rank + times * n, first_bin, n, offset))
            taken[length] = rank + times * n
            offset += length * n
        first_bin += times
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, rows_per_bucket: int = 10_000) -> DataFrame:
    """A row for each piece of each row of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are their end id alone. Repeated rows are packed each; an empty table gives an empty table.
    Texts may be of any length; rows and columns beyond doc_id and text are ignored. The histogram and the table of
    places are bounded by ``capacity``, not by the input: best fit makes some four groups for each length, of at most
    sqrt(2 * capacity) lengths each, and the search adds its nodes.
    """
    spark = docs.sparkSession
    pieces = shared.written(cut(docs, tokenizer, end_id, capacity), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    places = spark.createDataFrame(slots(complete_bins(histogram, capacity)), "length long, lo long, hi long, first_bin long, n long, first_offset long")
    # Ranks among pieces of one length, counted in buckets so that a frequent length is no single task.
    buckets = max(64, sum(histogram.values()) // rows_per_bucket)
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = keyed.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = keyed.withColumn("row", F.row_number().over(within) - 1).join(base, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("row"))
    at = F.col("rank") - F.col("lo")
    return (
        ranked.join(F.broadcast(places), (ranked["length"] == places["length"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
        .select(
            "doc_id", "piece", "start", ranked["length"], "ids_crc32",
            (F.col("first_bin") + F.floor(at / F.col("n"))).cast("long").alias("sequence_id"),
            (F.col("first_offset") + (at % F.col("n")) * ranked["length"]).cast("long").alias("offset"),
        )
    )
