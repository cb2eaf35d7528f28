"""Prefix tries of conversations as tables of nodes.

A node is a sequence of turns that some conversation starts with; its key is a rolling hash of the turns' digests modulo
2**127 - 1. Tasks read turns sorted by conversation and combine what they read into partial tries; tables of nodes are
then merged by key in rounds of a bounded fan, and subtree sums are rolled up by doubling: round i adds to each node the
sums of its descendants 2**i levels below, so rounds are logarithmic in depth. Turns are sorted in ranges, not grouped: a
conversation may lie in many tasks. Rolling hashes compose, so a task that starts inside a conversation hashes
from zero, and a row for each task says what to start from instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolith.llm import shared

PRIME = (1 << 127) - 1
BASE = 0x2545F4914F6CDD1D_9E3779B97F4A7C15 % PRIME
#: Nodes that a task combines before it sends them on, rows of an Arrow batch, bytes of a piece of an end list.
MOST_NODES, BATCH, PIECE = 100_000, 5_000, 1 << 16
FAN = 64

#: kind: node, end, turn and stop (node and end of a conversation that began in another task, to be hashed on), range (a task's summary).
SCANNED = (
    "kind string, range int, conv_id long, depth long, node binary, parent binary, chars long, n_convs long, began boolean, last_conv long, last_node binary, last_depth long"
)
_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
_FIELDS = [f.split(" ") for f in SCANNED.split(", ")]


def _key(state: int) -> bytes:
    return state.to_bytes(16, "big")


def _state(key: bytes) -> int:
    return int.from_bytes(key, "big")


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], _TYPES[k]) for n, k in _FIELDS], [n for n, _ in _FIELDS])


class _Partial:
    """A task's partial trie and the rows that it sends on; both are bounded."""

    def __init__(self, number: int):
        self.number, self.nodes, self.rows = number, {}, []

    def visit(self, conv: int, depth: int, state: int, parent: int | None, chars: int) -> None:
        known = self.nodes.get(state)
        if known:
            known["n_convs"] += 1
            known["conv_id"] = min(known["conv_id"], conv)
        else:
            self.nodes[state] = {"kind": "node", "range": self.number, "conv_id": conv, "depth": depth, "node": _key(state), "parent": None if parent is None else _key(parent), "chars": chars, "n_convs": 1}

    def send(self, **row) -> None:
        self.rows.append(row | {"range": self.number})

    def full(self, everything: bool = False) -> Iterator[pa.RecordBatch]:
        if everything or len(self.nodes) >= MOST_NODES:
            self.rows += self.nodes.values()
            self.nodes = {}
        while len(self.rows) >= BATCH or everything and self.rows:
            yield _batch(self.rows[:BATCH])
            self.rows = self.rows[BATCH:]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, key, chars), sorted; a null key begins a conversation. Turns before the first one that begins here are
    hashed from zero and numbered from 1."""
    part = _Partial(TaskContext.get().partitionId())
    conv, state, depth, began, other = None, 0, 0, False, None
    for batch in batches:
        for c, key, chars in zip(batch.column("conv_id").to_pylist(), batch.column("key").to_pylist(), batch.column("chars").to_pylist()):
            if key is None:
                if began:
                    part.send(kind="end", conv_id=conv, node=_key(state))
                elif other:
                    part.send(kind="stop", **other)
                conv, state, depth, began = c, 0, 0, True
                part.visit(c, 0, 0, None, 0)
                continue
            before, state, depth, conv = state, (state * BASE + int.from_bytes(key, "big")) % PRIME, depth + 1, c
            if began:
                part.visit(c, depth, state, before, chars)
            else:
                other = {"conv_id": c, "depth": depth, "node": _key(state)}
                part.send(kind="turn", parent=_key(before), chars=chars, **other)
        yield from part.full()
    if conv is not None:
        entry = other or {"depth": 0, "node": _key(0)}
        part.send(kind="range", depth=entry["depth"], node=entry["node"], began=began, last_conv=conv, last_node=_key(state), last_depth=depth)
    yield from part.full(everything=True)


def _starts(ranges: list) -> tuple[dict[int, tuple[int, int]], list[tuple[int, bytes]]]:
    """What each task's first turns are to be hashed on from (state, depth), and the ends that no task saw. ``ranges`` has a
    row for each task."""
    starts, ends, now = {}, [], None
    for r in sorted(ranges, key=lambda r: r["range"]):
        if r["depth"]:
            starts[r["range"]] = now[1:]
        elif now:
            ends.append((now[0], _key(now[1])))
        if r["began"]:
            now = (r["last_conv"], _state(r["last_node"]), r["last_depth"])
        else:
            now = (now[0], (now[1] * pow(BASE, r["depth"], PRIME) + _state(r["node"])) % PRIME, now[2] + r["depth"])
    return starts, ends + ([(now[0], _key(now[1]))] if now else [])


def _hashed_on(starts: dict[int, tuple[int, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = _Partial(TaskContext.get().partitionId())
        for batch in batches:
            for r in batch.to_pylist():
                state, depth = starts[r["range"]]
                on = lambda key, n: (state * pow(BASE, n, PRIME) + _state(key)) % PRIME  # noqa: B023, E731
                if r["kind"] == "stop":
                    part.send(kind="end", conv_id=r["conv_id"], node=_key(on(r["node"], r["depth"])))
                else:
                    part.visit(r["conv_id"], depth + r["depth"], on(r["node"], r["depth"]), on(r["parent"], r["depth"] - 1), r["chars"])
            yield from part.full()
        yield from part.full(everything=True)

    return run


def merged(partial: DataFrame, ranges: int, fan: int = FAN) -> DataFrame:
    """(node, depth, parent, chars, n_convs, conv_id) from partial tries, ``fan`` of neighbouring tasks at a time."""
    combine = (F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), *[F.first(c).alias(c) for c in ("depth", "parent", "chars")])
    while ranges > fan:
        partial = partial.groupBy("node", F.floor(F.col("range") / fan).cast("int").alias("range")).agg(*combine)
        ranges = -(-ranges // fan)
    return partial.groupBy("node").agg(*combine)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted (node, conv_id): comma-joined ids of a node, ``PIECE`` bytes at most at a time, with the first id."""
    node, first, held, size, rows = None, None, [], 0, []
    for batch in batches:
        for n, c in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist()):
            if held and (n != node or size >= PIECE):
                rows.append((node, first, ",".join(held)))
                held, size = [], 0
            if not held:
                node, first = n, c
            held.append(str(c))
            size += len(held[-1]) + 1
        if len(rows) >= BATCH or sum(len(r[2]) for r in rows) > 16 * PIECE:
            yield _piece_batch(rows)
            rows = []
    yield _piece_batch([*rows, (node, first, ",".join(held))] if held else rows)


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.string()))], ["node", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From pieces sorted by (node, first): the SHA-256 of each node's whole list, one piece at a time."""
    node, digest, out = None, None, []
    for batch in batches:
        for n, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
            if n == node:
                digest.update(b",")
            else:
                out += [(node, digest.hexdigest())] if digest else []
                node, digest = n, hashlib.sha256()
            digest.update(ids.encode())
        yield _digest_batch(out)
        out = []
    yield _digest_batch([(node, digest.hexdigest())] if digest else [])


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["node", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) from (node, conv_id). Lists are sorted in ranges and joined in pieces, so a long one is many tasks' work
    but for the digest itself, which takes piece after piece."""
    pieces = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_pieces, "node binary, first long, ids string")
    return pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_digests, "node binary, ends_sha256 string")


def rolled_up(nodes: DataFrame, depth: int) -> DataFrame:
    """(node, n_leaves, saved_tokens) from (node, parent, leaves, saved): each node's sums over its subtree."""
    sums = [F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")]
    table = nodes.select("node", F.col("parent").alias("up"), "leaves", "saved")
    step = 1
    while step <= depth:
        # ``up`` is the node ``step`` levels above, null where there is none.
        sent = table.filter("up is not null").groupBy(F.col("up").alias("node")).agg(*sums)
        held = table.select("node", "leaves", "saved").unionByName(sent).groupBy("node").agg(*sums)
        above = table.select(F.col("node").alias("up"), F.col("up").alias("further"))
        onward = table.filter("up is not null").select("node", "up").join(above, "up").filter("further is not null").select("node", F.col("further").alias("up"))
        table = shared.written(held.join(onward, "node", "left").select("node", "up", "leaves", "saved"), "rolled-up")
        step *= 2
    return table.select("node", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))


def prefix_trie(turns: DataFrame, order: list[str]) -> DataFrame:
    """One row for each node of the trie of ``turns`` (conv_id long, key binary of 16 bytes, chars long): conv_id (its smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns of a conversation follow each other by ``order``, equal ones in any order; a row with a null key begins each, before all
    its turns, so conversations without turns are members of the root. Keys say which turns are equal. saved_tokens sums
    (n_convs - 1) * chars over the subtree; ends_sha256 is of the sorted, comma-joined ids of conversations that end at
    the node. An empty table gives an empty table. Keys of nodes are equal for different sequences up to a chance of
    about 1 in 2**100 for 10**8 of them.
    """
    spark = turns.sparkSession
    shared.small_batches(spark)
    by = ["conv_id", *order]
    with shared.scope(spark):
        scanned = shared.written(turns.repartitionByRange(*by).sortWithinPartitions(*by).select("conv_id", "key", "chars").mapInArrow(_scan, SCANNED), "scanned")
        ranges = scanned.filter("kind = 'range'").collect()
        starts, unseen = _starts(ranges)
        late = scanned.filter("kind in ('turn', 'stop')").mapInArrow(_hashed_on(starts), SCANNED)
        known = shared.written(scanned.filter("kind in ('node', 'end')").unionByName(late), "partial")
        nodes = merged(known.filter("kind = 'node'"), max([r["range"] for r in ranges], default=0) + 1)
        nodes = shared.written(nodes, "nodes")
        children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"), F.lit(0).alias("leaves"))
        one = nodes.join(children, "node", "left").withColumn("leaves", F.coalesce("leaves", F.lit(1)).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("chars"))
        one = shared.written(one.select("node", "parent", "conv_id", "depth", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "leaves", "saved"), "nodes")
        sums = rolled_up(one, one.agg(F.max("depth")).first()[0] or 0)
        # A row for each task at most.
        ends = known.filter("kind = 'end'").select("node", "conv_id").unionByName(spark.createDataFrame([(bytearray(n), c) for c, n in unseen], "node binary, conv_id long"))
        above = one.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
        out = one.join(above, "parent", "left").join(sums, "node").join(end_digests(ends), "node", "left")
        out = out.select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        )
        path = shared.until_exit(spark, shared.new_path(spark, "trie"))
        out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def turn_key(role: Column, text: Column) -> Column:
    """16 bytes that are equal for equal (role, text) only, up to collisions of MD5 digests."""
    return F.unhex(F.md5(F.concat_ws(":", F.length(role), role, text)))


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, key, salt, chars) of turns with an id; null role or text is empty. Written, as ``salt`` tells repeats apart."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id is not null").select("conv_id", "turn", turn_key(role, text).alias("key"), F.monotonically_increasing_id().alias("salt"), F.length(text).cast("long").alias("chars"))
    return shared.written(rows, "turns")


def regrown(conversations: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """Turns for :func:`prefix_trie`, order (part, turn, key, salt): each conversation c of ``conversations`` (conv_id, turn, role, text) starts
    with the first h turns of conversation c - c % group (all if fewer, none if absent), in place of its own first h, with
    h = crc32(decimal c) % most.

    Turns are ordered by turn, null first, then by digest of role and text. Rows without conv_id belong to no conversation and
    are ignored. ``Window`` keeps the first turns before the shuffle, so a long conversation costs each task a few rows.
    """
    spark = conversations.sparkSession
    turns = numbered(conversations)
    place = F.struct(F.col("turn").isNotNull(), "turn", "key", "salt")
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "key", "salt"))
    early = turns.withColumn("rank", rank).filter(F.col("rank") < most)
    listed = F.array_sort(F.collect_list(F.struct("rank", F.struct(F.col("turn").isNotNull(), "turn", "key", "salt").alias("place"), "key", "chars")))
    firsts = shared.written(early.groupBy("conv_id").agg(listed.alias("first")), "firsts")
    h = F.crc32(F.col("conv_id").cast("string")) % most
    cut = firsts.select("conv_id", h.alias("h"), F.get("first", (h - 1).cast("int"))["place"].alias("cut"))
    own = turns.join(cut, "conv_id").filter((F.col("h") == 0) | F.coalesce(place > F.col("cut"), F.lit(False)))
    sources = firsts.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("source"), "first")
    head = firsts.select("conv_id", h.cast("int").alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("source")).filter("h > 0").join(sources, "source")
    head = head.select("conv_id", F.inline(F.slice("first", F.lit(1), F.col("h"))))
    none = lambda kind: F.lit(None).cast(kind)
    start = firsts.select("conv_id", F.lit(0).alias("part"), none("long").alias("turn"), none("binary").alias("key"), F.lit(0).cast("long").alias("salt"), F.lit(0).cast("long").alias("chars"))
    head = head.select("conv_id", F.lit(1).alias("part"), F.col("rank").cast("long").alias("turn"), "key", F.lit(0).cast("long").alias("salt"), "chars")
    return start.unionByName(head).unionByName(own.select("conv_id", F.lit(2).alias("part"), F.col("turn").cast("long").alias("turn"), "key", "salt", "chars"))


ORDER = ["part", "turn", "key", "salt"]


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """:func:`prefix_trie` of :func:`regrown` conversations."""
    with shared.scope(conversations.sparkSession):
        return prefix_trie(regrown(conversations), ORDER)
