"""Exact, near and substring duplicates against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from repolith.llm import exact, jaccard, substrings
from repolith.llm.components import connected_components
from tests.llm.conftest import same

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = (1 << 63) - 1


def exact_brute(rows):
    groups = {}
    for i, text, *_ in rows:
        groups.setdefault((text or "").translate(LOWER), []).append(i)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        first = True
        for i in ids:
            kept = i == keep and first
            first = first and not kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return out


def test_exact(odd, none):
    rows, docs = odd
    same(exact.duplicate_report(docs), exact_brute(rows))
    assert exact.duplicate_report(none).count() == 0


def test_exact_with_a_full_filter(odd):
    rows, docs = odd
    same(exact.duplicate_report(docs, bits_per_row=1), exact_brute(rows))


def test_exact_keeps_whole_rows(odd, none):
    rows, docs = odd
    kept = exact.without_duplicates(docs)
    assert kept.columns == docs.columns
    same(kept.select("doc_id"), [(i,) for i, _, _, k, _ in exact_brute(rows) if k])
    assert exact.without_duplicates(none).count() == 0


def components_brute(links):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


@pytest.mark.parametrize("links", [[(i, i + 1) for i in range(300)], [(0, i) for i in range(1, 200)], [(i, (i * 7) % 50 + 50 * (i // 50)) for i in range(200)], []])
def test_components(spark, links):
    df = spark.createDataFrame(links, "a long, b long").repartition(7)
    for rows in (200_000, 3):
        same(connected_components(df, rows_per_task=rows), list(components_brute([link for link in links if link[0] != link[1]]).items()))


def near_brute(rows, width, percent):
    sets, parent = [], {}
    for i, text, *_ in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets.append((i, {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())))
    links = [(i, i) for i, _ in sets if i is not None]
    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                links.append((i, j))
    parent = components_brute(links)
    return [(i, len(s), parent.get(i)) for i, s in sets]


@pytest.mark.parametrize("options", [{"width": 4, "percent": 85}, {"width": 5, "percent": 80, "frequent": 2}, {"width": 4, "percent": 85, "most_frequent": 1, "bits": 1024}])
def test_near(odd, options):
    rows, docs = odd
    same(jaccard.near_duplicates(docs, **options), near_brute(rows, options["width"], options["percent"]))


def test_a_family_costs_its_rows(spark):
    """Copies of one text with one to six words changed, some alike; no two are compared that share nothing but the text."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(400):
        words = base.copy()
        for _ in range(rng.randint(1, 6)):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([[f"x{rng.randrange(4)}"], [f"y{rng.randrange(10**6)}"], [], [words[at], "z"]])
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for options in ({"width": 4, "percent": 85}, {"width": 4, "percent": 92, "most_frequent": 1}):
        same(jaccard.near_duplicates(docs, **options), near_brute(rows, options["width"], options["percent"]))


def test_lists_are_streamed_like_whole_ones():
    rng = np.random.default_rng(6)
    rows = sorted({(int(t), int(t) % 3, int(p), int(n), int(d)) for t, p, n, d in zip(rng.integers(0, 12, 300), rng.integers(0, 4, 300), rng.integers(50, 90, 300), rng.integers(0, 60, 300))})
    table = pa.table({c: pa.array(v, k) for c, v, k in zip(("token", "salt", "pos", "n", "node"), zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()))})
    answers = []
    for size in (1, 2, 3, 7, 300):
        out = [tuple(r.values()) for b in jaccard._heads(85)(table.to_batches(max_chunksize=size)) for r in b.to_pylist()]
        answers.append(sorted(set(out)))
        for kind in (jaccard.POSTING, jaccard.HEAD):
            assert len([r for r in out if r[0] == kind]) == len({r for r in out if r[0] == kind})
    assert all(a == answers[0] for a in answers)


def test_words_of_equal_letters_differ(spark):
    """Thue-Morse words have equal polynomial hashes modulo a power of two."""
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    same(jaccard.near_duplicates(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")).select("doc_id", "component_id"), [(1, 1), (2, 2)])


def test_rows_of_one_id(spark):
    near = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(near)), (5, " ".join(near)), (5, ""), (5, " ".join([*near[:-1], "x"])), (5, "alone"), (7, " ".join([*near[:-1], "x"])), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    same(jaccard.near_duplicates(docs), near_brute(rows, 4, 85))
    same(jaccard.without_near_duplicates(docs).select("doc_id", "text"), [rows[0], rows[2], rows[4], rows[6]])


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(3)
    for n in (1, 500, 3000, 40_000):
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        for other in (base, np.concatenate([base[: n * 9 // 10], rng.integers(0, 1 << 63, n, dtype=np.uint64)])):
            differ = jaccard._differing([jaccard._sketch(base)] * 2, [jaccard._sketch(other)] * 2)
            assert (differ <= len(np.setxor1d(base, other))).all()


def test_near_stage(odd, none):
    rows, docs = odd
    gone = {i for i, _, c in near_brute(rows, 5, 80) if c is not None and c != i}
    kept = jaccard.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    same(kept.select("doc_id"), [(i,) for i, *_ in rows if i not in gone])
    assert jaccard.near_duplicates(none).count() == 0
    assert jaccard.without_near_duplicates(none).count() == 0


def substrings_brute(rows, window):
    docs = sorted(((LAST if i is None else i, (t or "").encode().split(), i) for i, t, *_ in rows), key=lambda d: d[0])
    first = {}
    for d, w, _ in docs:
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, (d, s)), (d, s))
    out = []
    for d, w, i in docs:
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (d, s):
                gone[s : s + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("options", [{}, {"hot": 1, "shard_words": 100}, {"bits": 1024}])
def test_substrings(odd, options):
    rows, docs = odd
    same(substrings.remove_repeats(docs, **options), substrings_brute(rows, 20))


def test_substrings_of_nothing(none):
    assert substrings.remove_repeats(none).count() == 0


def test_automaton_finds_first_places():
    automaton = substrings.SuffixAutomaton()
    for c in "abcabcab":
        automaton.add(c)
    assert list(automaton.matches("xabcaz", 3)) == [(3, 2), (4, 3)]
    assert list(automaton.matches("bcab", 4)) == [(3, 4)]


def test_duplicates_need_no_shuffle_of_texts(odd):
    _, docs = odd
    plan = exact.duplicate_report(docs.select(F.col("doc_id"), F.col("text")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
