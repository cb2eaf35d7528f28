"""Exact Jaccard self-join of shingle sets, with the relations between sets used to skip work.

Sets are ordered by a global order (rarer shingles first, then by hash); two sets that are similar enough share a
shingle of their prefixes. Equal sets are joined once.

Answers are derived from those of a similar set. Each shingle's list first pairs its sets with its head alone, the set
with the fewest rarer shingles; what these pairs say joins sets to components and finds cells, a component's
representative with the sets around it. A set's overlap with any other set of its cell follows from the shingles in
which the two differ from the representative. Two that are similar without sharing such a difference are both similar
to the representative and need no look at all, so only shared differences are joined: a family of k near copies costs
k rows and not k squared.

What is left are sets of different cells and components. Their lists are cut into blocks by set size and position, and
block pairs whose sizes or positions can't reach the overlap, or that lie in one cell or component, are skipped whole. A
parity sketch of each set bounds the difference of a pair from below and drops the hopeless; what remains is verified
on the sets themselves. Exact up to equal 64-bit hashes of words and shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolith.llm import bloom, shared
from repolith.llm.components import connected_components
from repolith.llm.text import Words, mix, ngrams, signed, texts

#: Bits of a set's sketch.
LEAST_BITS, MOST_BITS = 1 << 10, 1 << 16
#: Lists of shingles in 2**LONG sets or more are dealt over as many tasks as keep each below that.
LONG = 12


def _sets(column: pa.Array, width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Slices: first row, and of each text the sorted distinct shingle hashes; a text of fewer words has its whole
    sequence as one. Slices are small, so are the arrays and batches made from them."""
    for row, _, data, offsets in texts(column, 1 << 19):
        words = Words(data, offsets)
        hashes = words.hashes(lower=True)
        grams = ngrams(hashes, width)
        sets = []
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
            if b - a >= width:
                sets.append(np.unique(grams[a : b - width + 1]))
            elif b > a:
                sets.append(mix(ngrams(hashes[a:b], b - a) + np.uint64(b - a)))
            else:
                sets.append(np.zeros(0, np.uint64))
        yield row, sets


def _prefix(n: int, percent: int) -> int:
    """So many first shingles hold one of any set with at least the overlap that ``percent`` needs."""
    return n - -(-percent * n // 100) + 1


def _sketch(s: np.ndarray) -> bytes:
    """The parity of how many hashes fall on each bit; about a bit for each hash, so that long sets are told apart too."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (max(len(s), 1) - 1).bit_length()))
    odd = np.bincount((s >> np.uint64(40)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _differing(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """Differing bits of each pair of sketches; the longer one is folded to the shorter one's length."""
    sizes = np.array([(len(a), len(b)) for a, b in zip(x, y)], np.int64).reshape(-1, 2)
    out = np.zeros(len(x), np.int64)
    for la, lb in np.unique(sizes, axis=0).tolist():
        at = np.flatnonzero((sizes == (la, lb)).all(1))
        sides = []
        for part, length in ((x, la), (y, lb)):
            side = np.frombuffer(b"".join(part[i] for i in at), np.uint8).reshape(-1, length)
            while side.shape[1] > min(la, lb):
                side = side[:, : side.shape[1] // 2] ^ side[:, side.shape[1] // 2 :]
            sides.append(side)
        out[at] = np.bitwise_count(sides[0] ^ sides[1]).sum(1, dtype=np.int64)
    return out


def _key(s: np.ndarray) -> tuple[int, int]:
    """Two digests of a set, 0 and 0 of an empty one."""
    if not len(s):
        return 0, 0
    mixed = mix(s)
    return int(np.add.reduce(mixed)), int(np.add.reduce(mix(mixed ^ np.uint64(0xA5A5A5A5A5A5A5A5))))


def _node(n: int, a: int, b: int) -> int:
    """A set's number among nodes, from its size and digests."""
    return int(mix(mix(np.array([a], np.uint64)) ^ np.uint64(b) ^ np.uint64(n))[0].view(np.int64))


def _describe(width: int):
    """Of each row: its node and size and the set's parity sketch."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, node, sketches = [], [], []
            for _, sets in _sets(batch.column("text"), width):
                for s in sets:
                    n.append(len(s))
                    node.append(_node(len(s), *_key(s)))
                    sketches.append(_sketch(s))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rid"), pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(sketches, pa.binary())], ["doc", "rid", "node", "n", "sketch"])

    return emit


def _low(n: int, percent: int) -> int:
    """So many first shingles by hash are counted for every set: a quarter more than the prefix."""
    return _prefix(n, percent) * 5 // 4 + 2


class Frequent:
    """Shingles that many sets hold, sorted, each with the bit length of its count."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        order = np.argsort(tokens)
        self.tokens = tokens[order]
        self.classes = np.frompyfunc(int.bit_length, 1, 1)(counts[order].astype(object)).astype(np.int8) if len(counts) else np.zeros(0, np.int8)

    def classes_of(self, s: np.ndarray) -> np.ndarray:
        """0 for shingles that aren't frequent."""
        if not len(self.tokens):
            return np.zeros(len(s), np.int8)
        at = np.minimum(np.searchsorted(self.tokens, s), len(self.tokens) - 1)
        return np.where(self.tokens[at] == s, self.classes[at], 0)


def _counted_shingles(width: int, percent: int, known=None):
    """The first shingles by hash; with ``known`` frequent ones, all others of those sets whose first ones don't hold a
    prefix of rarer shingles (members of large groups of near copies)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in _sets(batch.column("text"), width):
                parts = []
                for s in sets:
                    low = s[: _low(len(s), percent)]
                    if not len(s):
                        continue
                    if known is None:
                        parts.append(low)
                    elif np.count_nonzero(known.value.classes_of(low) == 0) < min(len(s), _prefix(len(s), percent)):
                        parts.append(s[len(low) :])
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(parts)) if parts else [], pa.int64())], ["token"])

    return emit


def _postings(width: int, percent: int, frequent):
    """Rows (token, salt, node, n, pos) of each set's prefix, rarer classes first. Long lists are salted."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frequent.value
        for batch in batches:
            for _, sets in _sets(batch.column("text"), width):
                out: list[tuple[np.ndarray, ...]] = []
                for s in sets:
                    if not len(s):
                        continue
                    node = _node(len(s), *_key(s))
                    classes = known.classes_of(s)
                    order = np.argsort(classes, kind="stable")[: _prefix(len(s), percent)]
                    tokens, p = s[order], len(order)
                    parts = np.left_shift(1, np.maximum(classes[order].astype(np.int64) - LONG, 0))
                    salt = (mix(tokens ^ np.uint64(node & 0xFFFFFFFFFFFFFFFF)) % parts.astype(np.uint64)).astype(np.int64) + (parts > 1)
                    out.append((signed(tokens), salt, np.full(p, node), np.full(p, len(s)), np.arange(p)))
                columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 5
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c).cast(k) for c, k in zip(columns, kinds)], ["token", "salt", "node", "n", "pos"])

    return emit


#: Rows of :func:`_heads`.
PAIR, POSTING, HEAD = 0, 1, 2


def _heads(percent: int):
    """From postings sorted by (token, salt, pos, n, node): PAIR rows (head, set) of each list, POSTING rows of lists that
    these pairs don't exhaust (three sets or more, or salted), and the HEAD rows of salted lists.

    The head has the fewest rarer shingles of its own, so it is next to what a family's sets have in common. A list is
    streamed: of one that goes on beyond a batch, its head and up to two rows are held.
    """
    names = ["token", "salt", "node", "n", "pos"]

    def out(rows: list[np.ndarray], first: list[int] | None, long: bool) -> pa.RecordBatch:
        """``first``: the head of the first list if it began before; ``long``: whether that had three rows or more."""
        token, salt, node, n, pos = rows
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])])
        starts = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        size = np.diff(np.append(starts, len(token)))
        open_ = (size > 2)[run] | (salt > 0)
        heads = [c[starts] for c in (node, n)]
        if first:
            heads[0][0], heads[1][0] = first
            open_ |= (run == 0) & long
        head, m = (h[run] for h in heads)
        pair = np.flatnonzero((node != head) & (100 * np.minimum(n, m) >= (2 * percent - 100) * np.maximum(n, m)))
        ab = np.unique(np.stack([head[pair], node[pair]]), axis=1) if len(pair) else np.zeros((2, 0), np.int64)
        open_, lead = np.flatnonzero(open_), starts[bool(first) :]
        lead = lead[salt[lead] > 0]
        zero = np.zeros(ab.shape[1], np.int64)
        columns = [np.concatenate([x, y[open_], y[lead]]) for x, y in ((ab[0], token), (ab[1], node), (zero, n), (zero, pos))]
        kind = np.repeat([PAIR, POSTING, HEAD], [ab.shape[1], len(open_), len(lead)])
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c).cast(k) for c, k in zip([kind, *columns], kinds)], ["kind", "x", "y", "n", "pos"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 5
        first, key = None, None
        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names]
            if not len(now[0]):
                continue
            if key and key != (now[0][0], now[1][0]):
                if len(held[0]):
                    yield out(held, None, False)
                held, first = [c[:0] for c in held], None
            rows = [np.concatenate([a, b]) for a, b in zip(held, now)]
            key = (rows[0][-1], rows[1][-1])
            begun = np.flatnonzero((rows[0] != key[0]) | (rows[1] != key[1]))
            begun = int(begun[-1]) + 1 if len(begun) else 0
            goes_on = first if begun == 0 else None
            last = len(rows[0]) - begun
            # Up to two rows of the last list wait; of a longer one its head is enough.
            if goes_on or last > 2:
                head = goes_on or [int(rows[2][begun]), int(rows[3][begun])]
                yield out(rows, first, True)
                held, first = [c[:0] for c in rows], head
            else:
                if begun:
                    yield out([c[:begun] for c in rows], first, True)
                held, first = [c[begun:] for c in rows], None
        if len(held[0]):
            yield out(held, None, False)

    return emit


def _shingles(width: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in _sets(batch.column("text"), width):
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(np.concatenate(sets))))
                nodes = pa.array([_node(len(s), *_key(s)) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([nodes, lists], ["node", "shingles"])

    return emit


def _likely(percent: int):
    """Keeps the pairs that sizes and sketches allow within twice the difference that similar sets have, with ``h``, the
    differing bits, which are no more than differing shingles; ``maybe``: whether they can be similar."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_a", "n_b"))
            differ = _differing(*(batch.column(c).to_pylist() for c in ("sketch_a", "sketch_b")))
            keep = pa.array(differ * (100 + percent) <= 2 * (100 - percent) * (n + m))
            maybe = (differ * (100 + percent) <= (100 - percent) * (n + m)) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
            columns = [batch.column("a"), batch.column("b"), pa.array(differ), pa.array(maybe)]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], ["a", "b", "h", "maybe"])

    return emit


def _sketched(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Distinct ``pairs`` (a, b) that lie near each other, with h and maybe."""
    side = lambda c: sizes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    near = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    return shared.written(near.mapInArrow(_likely(percent), "a long, b long, h long, maybe boolean"), "pairs")


def _closest(pairs: DataFrame, keys: list[Column]) -> DataFrame:
    """The pair of least h for each value of ``keys``, each pair once."""
    best = F.min_by(F.struct("a", "b"), F.struct("h", "a", "b")).alias("best")
    return shared.written(pairs.groupBy(*keys).agg(best).select("best.*").distinct(), "closest")


def _apart(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """``pairs`` whose ends lie in different components, those as c and d."""
    side = lambda c, name: components.select(F.col("node").alias(c), F.col("component").alias(name))
    out = pairs.join(side("a", "c"), "a", "left").join(side("b", "d"), "b", "left")
    return out.withColumns({"c": F.coalesce("c", "a"), "d": F.coalesce("d", "b")}).filter("c <> d")


class Links:
    """Links found so far among sets, and what is verified of them."""

    def __init__(self, reps: DataFrame, width: int, percent: int, bits: int):
        self.reps, self.width, self.percent, self.bits = reps, width, percent, bits
        self.found: DataFrame | None = None
        self.components = None

    def sets(self, nodes: DataFrame) -> DataFrame:
        """(node, shingles) of distinct ``nodes`` (node, rid)."""
        rows = bloom.semi_join(self.reps, nodes.select("rid"), "rid", self.bits)
        return shared.written(rows.select("text").mapInArrow(_shingles(self.width), "node long, shingles array<long>").dropDuplicates(["node"]), "sets")

    def similar(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Of distinct ``pairs`` (a, b) those whose sets are similar enough."""
        s = sets.select(F.col("node").alias("a"), F.col("shingles").alias("s"))
        t = sets.select(F.col("node").alias("b"), F.col("shingles").alias("t"))
        common = F.size(F.array_intersect("s", "t"))
        enough = 100 * common >= self.percent * (F.size("s") + F.size("t") - common)
        return pairs.select("a", "b").join(s, "a").join(t, "b").filter(enough).select("a", "b")

    def add(self, links: DataFrame) -> None:
        links = shared.written(links.select("a", "b").distinct(), "found")
        self.found = links if self.found is None else self.found.unionByName(links)
        self.components = shared.written(connected_components(self.found), "components")

    def verify(self, pairs: DataFrame, sets: DataFrame) -> None:
        """Adds the similar ones of ``pairs`` (a, b, h), or at least what joins the same sets to the same components: of
        each set the closest pair first, then of each two components, then the others between components."""
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node"), "a", "b", "h")
        done = _closest(nodes if self.components is None else _apart(nodes, self.components), [F.col("node")])
        self.add(self.similar(done, sets))
        second = _closest(_apart(pairs.join(done, ["a", "b"], "left_anti"), self.components), [F.least("c", "d"), F.greatest("c", "d")])
        self.add(self.similar(second, sets))
        rest = pairs.join(done.unionByName(second), ["a", "b"], "left_anti")
        self.add(self.similar(shared.written(_apart(rest, self.components).select("a", "b"), "rest"), sets))


def _cells(near: DataFrame, components: DataFrame) -> DataFrame:
    """(node, cell) of sets in cells; a cell is named by its representative, the set of a component that is head of most
    pairs (a, b). A set that is linked with none is a component too, so that a family without links has a cell. A set
    goes to the representative of most pairs among that of its own component and those of its near heads'. Cells that
    are one component need none: its sets are linked already."""
    nodes = near.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(components, "node", "left")
    nodes = shared.written(nodes.withColumn("component", F.coalesce("component", "node")), "cell-nodes")
    heads = near.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("pairs")).join(nodes, "node")
    leads = heads.groupBy("component").agg(F.max(F.struct("pairs", "node")).alias("lead")).select("component", "lead.pairs", F.col("lead.node").alias("cell"))
    leads = shared.written(leads, "cell-leads")
    own = nodes.select("node", "component", F.lit(False).alias("foreign"))
    other = _apart(near, components).select(F.col("b").alias("node"), F.col("c").alias("component"), F.lit(True).alias("foreign"))
    places = own.unionByName(other).join(leads, "component").groupBy("node").agg(F.max(F.struct("pairs", "cell", "foreign")).alias("to"))
    places = shared.written(places.select("node", "to.cell", "to.foreign"), "cell-places")
    return places.join(places.filter("foreign").select("cell").distinct(), "cell").select("node", "cell")


def _differences(cells: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of each set of a cell: n, the representative's size m, the shingles that it has beyond the representative (more) and
    that it lacks (less), their number d, and whether it links with the representative. Sets beyond twice the
    difference of similar ones leave the cell."""
    own = sets.select("node", F.col("shingles").alias("s"))
    lead = sets.select(F.col("node").alias("cell"), F.col("shingles").alias("r"))
    rows = cells.join(own, "node").join(lead, "cell")
    rows = rows.select(
        "node", "cell", F.size("s").cast("long").alias("n"), F.size("r").cast("long").alias("m"),
        F.array_sort(F.array_except("s", "r")).alias("more"), F.array_sort(F.array_except("r", "s")).alias("less"),
    )
    rows = rows.withColumn("d", (F.size("more") + F.size("less")).cast("long"))
    bound = (100 - percent) * (F.col("n") + F.col("m"))
    rows = rows.withColumn("linked", F.col("d") * (100 + percent) <= bound)
    return rows.filter(F.col("d") * (100 + percent) <= 2 * bound)


def _within(differences: DataFrame, components: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of different components within a cell that may be similar: they share a difference.

    |x ^ y| = d_x + d_y - 2 |D_x & D_y|. Let y not link with the representative. x is similar to it only if more than
    (d_x - c (n_x - m)) / 2 of x's own differences are y's too, c being the share of sizes by which similar sets may
    differ. So x is found by a prefix of its differences, among all those of y. Differences that the representative
    holds come last: many lack the same of its shingles, few share what they have beyond it.
    """
    whole, free = 100 + percent, 100 - percent
    least = F.greatest(F.lit(1), F.floor((F.col("d") * whole - free * (F.col("n") - F.col("m"))) / (2 * whole)) + 1)
    component = components.select("node", "component")
    rows = differences.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    slim = rows.select("node", "cell", "n", "d", "linked", "component", F.concat("more", "less").alias("all"), least.cast("long").alias("least"))
    slim = shared.written(slim, "differences")
    prefix = slim.filter("d >= least").withColumn("all", F.slice("all", 1, (F.col("d") - F.col("least") + 1).cast("int")))
    at = lambda df, p: df.select("cell", *[F.col(c).alias(f"{p}_{c}") for c in ("node", "n", "d", "component")], F.posexplode("all").alias(f"{p}_pos", "token"))
    x, y = at(prefix, "x"), at(slim.filter("not linked"), "y")
    shared_most = F.least(F.col("x_d") - F.col("x_pos"), F.col("y_d") - F.col("y_pos"))
    enough = 2 * whole * shared_most >= whole * (F.col("x_d") + F.col("y_d")) - free * (F.col("x_n") + F.col("y_n"))
    pairs = x.join(y, ["cell", "token"]).filter((F.col("x_component") != F.col("y_component")) & enough)
    return pairs.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()


def _across(postings: DataFrame, components: DataFrame, cells: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of different components and cells that a list holds and sizes and positions allow, by blocks."""
    rows = postings.join(components, "node", "left").join(cells, "node", "left")
    rows = rows.withColumn("component", F.coalesce("component", "node")).withColumn("cell", F.coalesce("cell", "component"))
    open_ = rows.groupBy("token").agg(*[f(c).alias(f"{name}_{c}") for c in ("component", "cell") for name, f in (("lo", F.min), ("hi", F.max))])
    open_ = open_.filter("lo_component < hi_component and lo_cell < hi_cell").select("token")
    rows = rows.join(shared.written(open_, "open-lists"), "token")
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    ratio = float(np.log(100 / percent))
    rows = rows.withColumn("size_block", F.floor(F.log(F.col("n").cast("double")) / ratio).cast("int")).withColumn("pos_block", F.floor(F.col("pos") * 4 / prefix).cast("int"))
    rows = shared.written(rows, "open-postings")
    block = ["token", "size_block", "pos_block"]
    blocks = rows.groupBy(*block).agg(*[f(c).alias(f"{name}_{c}") for c in ("n", "pos", "component", "cell") for name, f in (("min", F.min), ("max", F.max))])
    left = blocks.select([F.col(c).alias(c if c == "token" else f"l_{c}") for c in blocks.columns])
    right = blocks.select([F.col(c).alias(c if c == "token" else f"r_{c}") for c in blocks.columns])

    def reachable(n_a: Column, n_b: Column, pos_a: Column, pos_b: Column, low_a: Column, low_b: Column) -> Column:
        """Whether sets of at most n_a and n_b, from these positions on, can overlap as the least sizes need."""
        return (F.least(n_a - pos_a, n_b - pos_b)) * (100 + percent) >= percent * (low_a + low_b)

    def apart(name: str) -> Column:
        return (F.col(f"l_min_{name}") != F.col(f"r_max_{name}")) | (F.col(f"l_max_{name}") != F.col(f"r_min_{name}"))

    sizes_meet = (100 * F.col("l_max_n") >= percent * F.col("r_min_n")) & (100 * F.col("r_max_n") >= percent * F.col("l_min_n"))
    in_reach = reachable(F.col("l_max_n"), F.col("r_max_n"), F.col("l_min_pos"), F.col("r_min_pos"), F.col("l_min_n"), F.col("r_min_n"))
    ordered = (F.col("l_size_block") < F.col("r_size_block")) | ((F.col("l_size_block") == F.col("r_size_block")) & (F.col("l_pos_block") <= F.col("r_pos_block")))
    near = left.join(right, "token").filter(sizes_meet & in_reach & apart("component") & apart("cell") & ordered)
    near = near.select("token", "l_size_block", "l_pos_block", "r_size_block", "r_pos_block")
    member = lambda p: rows.select("token", *[F.col(c).alias(f"{p}_{c}") for c in ("size_block", "pos_block", "node", "n", "pos", "component", "cell")])
    pairs = near.join(member("l"), ["token", "l_size_block", "l_pos_block"]).join(member("r"), ["token", "r_size_block", "r_pos_block"])
    n_l, n_r = F.col("l_n"), F.col("r_n")
    meet = (100 * F.least(n_l, n_r) >= percent * F.greatest(n_l, n_r)) & reachable(n_l, n_r, F.col("l_pos"), F.col("r_pos"), n_l, n_r)
    pairs = pairs.filter((F.col("l_component") != F.col("r_component")) & (F.col("l_cell") != F.col("r_cell")) & meet)
    return pairs.select(F.least("l_node", "r_node").alias("a"), F.greatest("l_node", "r_node").alias("b")).distinct()


def _frequent(reps: DataFrame, width: int, percent: int, frequent: int, most_frequent: int):
    """The broadcast :class:`Frequent` shingles: those of more than ``frequent`` sets, or of more than the least count that
    leaves ``most_frequent`` of them at each of two counts."""
    context = reps.sparkSession.sparkContext

    def often(known=None) -> pa.Table:
        counts = reps.select("text").mapInArrow(_counted_shingles(width, percent, known), "token long").groupBy("token").count()
        counts = shared.written(counts.filter(F.col("count") > frequent), "frequent")
        # As many rows as there are different counts.
        by_count = sorted((r["count"], r["tokens"]) for r in counts.groupBy("count").agg(F.count("*").alias("tokens")).collect())
        held, least = sum(n for _, n in by_count), frequent
        for count, n in by_count:
            if held <= most_frequent:
                break
            held, least = held - n, count
        return counts.filter(F.col("count") > least).toArrow()

    def as_frequent(table: pa.Table):
        return context.broadcast(Frequent(table["token"].to_numpy().view(np.uint64), table["count"].to_numpy()))

    first = often()
    known = as_frequent(first)
    more = often(known)
    known.unpersist()
    return as_frequent(pa.concat_tables([first, more]).group_by("token").aggregate([("count", "max")]).rename_columns({"count_max": "count"}))


def _components(sized: DataFrame, rows: DataFrame, width: int, percent: int, frequent: int, most_frequent: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """Of rows (rid, text) and their descriptions ``sized``: leads (node, lead, rid, n, sketch), one for each set, with the
    least doc and its rid; and (node, component) of sets that are linked."""
    leads = sized.groupBy("node", "n").agg(F.min(F.struct("doc", "rid")).alias("lead"), F.first("sketch").alias("sketch"))
    leads = shared.written(leads.select("node", "n", "sketch", F.col("lead.doc").alias("lead"), "lead.rid"), "leads", keep=True)
    # Equal sets: only one row goes on.
    others = shared.written(sized.select("rid").distinct().join(leads.select("rid"), "rid", "left_anti"), "copies")
    reps = bloom.anti_join(rows, others, "rid", bits)
    known = _frequent(reps, width, percent, frequent, most_frequent)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    postings = reps.select("text").mapInArrow(_postings(width, percent, known), "token long, salt int, node long, n int, pos int")
    lists = postings.repartition(n, "token", "salt").sortWithinPartitions("token", "salt", "pos", "n", "node")
    lists = shared.written(lists.mapInArrow(_heads(percent), "kind int, x long, y long, n int, pos int"), "lists")
    # The heads of one salted list are paired with the first of them.
    heads = lists.filter(F.col("kind") == HEAD).select(F.col("x").alias("token"), F.col("y").alias("b"), F.struct("pos", "n", "y").alias("at"))
    top = heads.groupBy("token").agg(F.min("at.y").alias("least"), F.min("at").alias("at")).select("token", F.col("at.y").alias("a"))
    pairs = lists.filter(F.col("kind") == PAIR).select(F.col("x").alias("a"), F.col("y").alias("b"))
    pairs = pairs.unionByName(heads.join(top, "token").filter("a <> b").select("a", "b"))
    near = _sketched(pairs.distinct(), leads, percent)
    ids = leads.select("node", "rid")
    ends = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    links = Links(reps, width, percent, bits)
    sets = links.sets(shared.written(ends.join(ids, "node"), "ends"))
    links.verify(near.filter("maybe"), sets)

    differences = shared.written(_differences(_cells(near, links.components), sets, percent), "cells")
    links.add(differences.filter("linked and node <> cell").select(F.col("node").alias("a"), F.col("cell").alias("b")))
    postings = lists.filter(F.col("kind") == POSTING).select(F.col("x").alias("token"), F.col("y").alias("node"), "n", "pos")
    left = _across(postings, links.components, differences.select("node", "cell"), percent).unionByName(_within(differences, links.components, percent))
    left = left.distinct().join(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), ["a", "b"], "left_anti")
    left = _sketched(left, leads, percent).filter("maybe")
    more = left.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    known_sets = sets.join(more, "node", "left_semi")
    new_sets = links.sets(shared.written(more.join(ends, "node", "left_anti").join(ids, "node"), "ends"))
    links.verify(left, known_sets.unionByName(new_sets))
    return leads, links.found


def _described(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, rid, text) of ``docs``, rid being a hash of id and text, and their descriptions as a table."""
    shared.small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("rid"))
    return rows, shared.written(rows.mapInArrow(_describe(width), "doc long, rid long, node long, n long, sketch binary"), "sizes", keep=True)


def near_duplicates(docs: DataFrame, width: int = 4, percent: int = 85, frequent: int = 4, most_frequent: int = 1 << 20, bits: int = bloom.MAX_BITS) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    Sets of distinct ``width``-word shingles (ASCII lower-cased) link when 100 * intersection >= ``percent`` * union;
    component_id is the least doc_id that links reach. Texts without words and null ids link with nothing: their
    component is their own id. Rows that repeat an id are one node, whatever their texts. Texts may be of any length;
    an empty table gives an empty table; other columns are ignored. Shingles of more than ``frequent`` sets, or of as many
    more as leave ``most_frequent`` of them, come late in the order, by classes of their count; at most twice
    ``most_frequent`` of them (20 MB) go to the driver and to tasks. The order never changes results.
    """
    with shared.scope(docs.sparkSession):
        rows, sized = _described(docs, width)
        linked = sized.filter("n > 0 and doc is not null")
        leads, found = _components(linked, rows.filter("doc_id is not null").select("rid", "text"), width, percent, frequent, most_frequent, bits)
        # Rows of one id are one node.
        several = linked.groupBy("doc").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a < z")
        same_id = linked.select("doc", F.col("node").alias("b")).join(several, "doc").filter("a <> b").select("a", "b")
        components = shared.written(connected_components(found.unionByName(same_id.distinct())), "components")
        least = components.join(leads.select("node", "lead"), "node")
        least = least.join(least.groupBy("component").agg(F.min("lead").alias("component_id")), "component").select("node", "component_id")
        answers = shared.written(leads.select("node", "lead").join(least, "node", "left").select("node", F.coalesce("component_id", "lead").alias("component_id")), "answers", keep=True)
    out = linked.join(answers, "node").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")
    # Empty texts, whose id may be that of another row.
    empty = sized.filter("n = 0 and doc is not null").select(F.col("doc").alias("doc_id"))
    ids = empty.distinct()
    theirs = linked.select(F.col("doc").alias("doc_id"), "node").join(ids, "doc_id", "left_semi").join(answers, "node").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    empty = empty.join(theirs, "doc_id", "left").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    null = sized.filter("doc is null").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(empty).unionByName(null)


def without_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bits: int = bloom.MAX_BITS) -> DataFrame:
    """``docs`` with one row of each group of texts that links join: that of the least doc_id. Texts without words and null
    ids all stay. Rows are told apart by id and text: another row of the same id stays or goes by its own text, and rows
    equal in both go together or all stay. Keeps all columns, whatever they are called; an empty table stays empty."""
    with shared.scope(docs.sparkSession):
        rows, sized = _described(docs, width)
        linked = sized.filter("n > 0 and doc is not null")
        leads, found = _components(linked, rows.filter("doc_id is not null").select("rid", "text"), width, percent, 4, 1 << 20, bits)
        components = shared.written(connected_components(found), "components").join(leads.select("node", "lead", "rid"), "node")
        first = components.groupBy("component").agg(F.min(F.struct("lead", "rid")).alias("first")).select("component", F.col("first.rid").alias("stays"))
        gone = components.join(first, "component").filter("rid <> stays").select("rid")
        copies = linked.select("rid").distinct().join(leads.select("rid"), "rid", "left_anti")
        gone = shared.written(gone.unionByName(copies).distinct(), "near-copies", keep=True)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    packed = packed.withColumn("rid", F.when(F.col("row.doc_id").isNotNull(), F.xxhash64("row.doc_id", "row.text")))
    return bloom.anti_join(packed, gone, "rid", bits).select("row.*")
