"""Prefix tries of conversations against a trie built in memory."""

import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from repolith.llm import trie
from tests.llm.conftest import same

SCHEMA = "conv_id long, turn long, role string, text string, node string, depth int, chars string, `part` int, kind string"


def brute(rows):
    """Each node of the trie as a tuple of turns; ties of a conversation's turns go by digest."""
    conversations, nodes, children = {}, {}, {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            place = (turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}:{text}".encode()).digest())
            conversations.setdefault(c, []).append((place, (role, text)))
    conversations = {c: [t for _, t in sorted(turns)] for c, turns in conversations.items()}
    for c, turns in conversations.items():
        h = zlib.crc32(str(c).encode()) % 6
        turns = tuple(conversations.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:])
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append((c, d == len(turns)))
    for node in nodes:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(nodes, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[b] for b in below) if below else 1
        saved[node] = (len(nodes[node]) - 1) * (len(node[-1][1]) if node else 0) + sum(saved[b] for b in below)
    least = {node: min(c for c, _ in members) for node, members in nodes.items()}
    ends = {node: ",".join(str(c) for c in sorted(c for c, end in members if end)) for node, members in nodes.items()}
    return [
        (least[n], len(n), least[n[:-1]] if n else None, len(m), len(children.get(n, [])), leaves[n], saved[n], hashlib.sha256(ends[n].encode()).hexdigest())
        for n, m in nodes.items()
    ]


def odd_conversations():
    """Few distinct turns, so that prefixes are shared; null turns, ties, repeats, negative ids, a conversation of a third of all rows,
    sources that are missing, one text of a megabyte."""
    rng, rows = random.Random(3), []
    for c in [*range(-205, -190), *range(0, 60), *range(110, 130), *range(300, 330)]:
        for turn in range(rng.randint(1, 7)):
            rows.append((c, rng.choice([turn, None, 0]), rng.choice(["u", "a", None, "1:u"]), rng.choice(["x", "y", None, "é😀", ":x"])))
    rows += [(300, i // 3, "u", rng.choice("ab")) for i in range(300)] + rows[:40]
    rows += [(c, 0, "u", "same") for c in range(700, 760)] + [(None, 1, "u", "x"), (None, None, None, None), (900, 0, "u", "long " * 200_000)]
    return [(*r, "n", 1, "c", 2, "k") for r in rows]


@pytest.fixture(scope="module")
def conversations(spark):
    rows = odd_conversations()
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_against_brute_force(conversations):
    rows, df = conversations
    same(trie.conversation_trie(df), brute(rows))


def test_conversations_over_many_tasks(conversations, spark):
    """With as many ranges as this, most begin inside a conversation and some hold no beginning at all."""
    rows, df = conversations
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "90")
        same(trie.conversation_trie(df), brute(rows))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert trie.conversation_trie(empty).count() == 0
    assert trie.conversation_trie(spark.createDataFrame([(None, 1, "u", "x", None, None, None, None, None)], SCHEMA)).count() == 0


def test_merging_in_rounds(spark):
    partial = spark.createDataFrame([(bytearray(b"n%d" % (i % 3)), 1, None, 5, 2, i, i) for i in range(300)], "node binary, depth long, parent binary, chars long, n_convs long, conv_id long, range int")
    same(trie.merged(partial, 300, fan=4).select(F.col("node").cast("string"), "n_convs", "conv_id"), [(f"n{i}", 200, i) for i in range(3)])


def test_end_lists_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 20)
    ids = [*range(-40, 500), 10**12]
    ends = spark.createDataFrame([(bytearray(b"a"), i) for i in ids] + [(bytearray(b"b"), 7)], "node binary, conv_id long").repartition(6)
    digest = lambda of: hashlib.sha256(",".join(map(str, of)).encode()).hexdigest()
    same(trie.end_digests(ends).select(F.col("node").cast("string"), "ends_sha256"), [("a", digest(ids)), ("b", digest([7]))])


def test_deep_trie_takes_rounds_of_its_logarithm(spark):
    n = 700
    chain = [(bytearray(i.to_bytes(2, "big")), bytearray((i - 1).to_bytes(2, "big")) if i else None, int(i == n - 1), i) for i in range(n)]
    nodes = spark.createDataFrame(chain, "node binary, parent binary, leaves long, saved long")
    got = trie.rolled_up(nodes, n - 1).select(F.hex("node"), "n_leaves", "saved_tokens")
    same(got, [(i.to_bytes(2, "big").hex().upper(), 1, sum(range(i, n))) for i in range(n)])
