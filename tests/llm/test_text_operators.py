"""Tokens, packing, PII, quality, mixing, toxicity and language scores."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from repolith.llm import hmm, mixing, packing, pii, quality, token_counts, tokens, toxicity
from tests.llm.conftest import same

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
library = Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t\x0b'sIl\x85 　<|>")), max_size=60))
def test_ids_are_the_library_s(text):
    for t in (text, text + "<|endoftext|>" + text):
        assert tokens.encoder(PATH)(t) == library.encode(t, add_special_tokens=False).ids


def test_other_tokenizers():
    assert len(tokens.encoder(public_tokenizers.path("piece_bpe_32k.model"))("two words")) >= 2
    word = public_tokenizers.path("word_bpe_49k.json")
    assert tokens.encoder(word)("Two words") == Tokenizer.from_file(word).encode("Two words", add_special_tokens=False).ids


def test_token_counts_and_cache(odd, none, tmp_path):
    rows, docs = odd
    cache = f"file://{tmp_path}/cache"
    expected = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows]
    half = docs.filter("doc_id < 60")
    same(token_counts.count_tokens(half, PATH, cache), [e for e in expected if e[0] is not None and e[0] < 60])
    stored = docs.sparkSession.read.parquet(cache).count()
    same(token_counts.count_tokens(docs, PATH, cache), expected)
    assert docs.sparkSession.read.parquet(cache).count() == len({t or "" for _, t, *_ in rows})
    same(token_counts.count_tokens(docs, PATH, cache), expected)
    assert stored < docs.sparkSession.read.parquet(cache).count() == len({t or "" for _, t, *_ in rows})
    assert token_counts.count_tokens(none, PATH).count() == 0


def pieces_brute(rows, capacity=1024):
    out = []
    for i, text, *_ in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        head = len(ids) % capacity or capacity
        bounds = [0, *range(head, len(ids) + 1, capacity)]
        out += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]
    return out


def test_packing(odd, none):
    rows, docs = odd
    packed = packing.pack(docs, PATH)
    same(packed.select("doc_id", "piece", "start", "length", "ids_crc32"), pieces_brute(rows))
    bins = {}
    for r in packed.collect():
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    assert packing.pack(none, PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 30), max_size=25))
def test_bins_are_whole_and_few(counts):
    placed = Counter()
    patterns = packing.complete_bins(counts, 100)
    for times, use in patterns:
        assert times > 0 and sum(s * n for s, n in use) <= 100
        placed.update({s: n * times for s, n in use})
    assert placed == Counter(counts)
    bins = sum(t for t, _ in patterns)
    first_fit = []
    for s in sorted((s for s, n in counts.items() for _ in range(n)), reverse=True):
        i = min((i for i, room in enumerate(first_fit) if room >= s), key=lambda i: first_fit[i], default=None)
        if i is None:
            first_fit.append(100 - s)
        else:
            first_fit[i] -= s
    left = np.array([counts.get(s, 0) for s in range(101)])
    assert packing.least_bins(left, 100) <= bins <= len(first_fit)
    assert sum(t for t, _ in packing.best_fit(left, 100)) == len(first_fit)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=10))
def test_few_pieces_are_packed_into_the_least_bins(sizes):
    def fewest(left, rooms):
        if not left:
            return len(rooms)
        top, rest = left[0], left[1:]
        options = {r for r in rooms if r >= top}
        return min([fewest(rest, sorted([*rooms, 20 - top])), *(fewest(rest, sorted([*rooms[: (i := rooms.index(r))], r - top, *rooms[i + 1 :]])) for r in options)])

    assert sum(t for t, _ in packing.complete_bins(Counter(sizes), 20)) == fewest(sorted(sizes, reverse=True), [])


def test_bins_of_the_small_table():
    lengths = Counter()
    for text in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist():
        n = len(tokens.encoder(PATH)(text or "")) + 1
        lengths.update({n % 1024: 1, 1024: n // 1024})
    counts = {s: n for s, n in lengths.items() if s and n}
    assert 962 <= sum(t for t, _ in packing.complete_bins(counts, 1024)) <= 964


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000, "7" * 1_000_000, "a" * 1_000_000, "!" * 1_000_000, " " * 1_000_000 + "w \t x" + "\u3000" * 9])
def test_ids_of_long_texts(text):
    assert tokens.encoder(PATH)(text) == library.encode(text, add_special_tokens=False).ids


def test_the_query_s_cache_is_kept(spark, tmp_path):
    from repolith.llm import queries, shared

    spark.createDataFrame([(1, "some words"), (2, "other words"), (3, "some words")], "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    stored = lambda: spark.read.parquet(f"{shared.shared_dir(spark)}/repolith/token-counts")
    first = sorted(queries.op10_token_counts(spark, f"file://{tmp_path}").collect())
    files = set(stored().inputFiles())
    # Two writers may have stored the same digests.
    stored().limit(1).write.mode("append").parquet(f"{shared.shared_dir(spark)}/repolith/token-counts")
    rows = stored().count()
    assert sorted(queries.op10_token_counts(spark, f"file://{tmp_path}").collect()) == first and [r.n_tokens for r in first] == [2, 2, 2]
    assert stored().count() == rows and files


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 12 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="aZ0123456789.@+- ()é:/\n_%", max_size=50))
def test_base_spans_equal_the_patterns(text):
    assert [s for s in pii.spans(text) if s[0] in pii.BASE] == base_brute(text)


def test_base_spans_of_planted_text(odd):
    rows, docs = odd
    planted = "4111 1111 1111 1111 x 5555-5555-5555-4444 +49 (30) 1234-5678 a.b@c-d.example.org@x.y 255.255.255.255.1 300.1.1.1"
    assert [s for s in pii.spans(planted) if s[0] in pii.BASE] == base_brute(planted)
    kinds = [s[0] for s in pii.spans("IBAN: DE89 3704 0044 0532 0130 00, SSN 123-45-6789, account no. 1234-5678, https://me:secret@host.example/")]
    assert {"iban", "ssn", "account", "userinfo"} <= set(kinds)
    secrets = 'x token = "24be64439e3e49cf46b2d7c90f3602a3" client_secret_key: abcdefgh12345678 password=aaaaaaaaaaaaaaaaaaaa1 token of 24be64439e3e49cf46'
    assert [secrets[a:b] for kind, a, b in pii.spans(secrets) if kind == "secret"] == ["24be64439e3e49cf46b2d7c90f3602a3", "abcdefgh12345678"]
    assert pii.spans("token=" * 200_000) == []
    assert pii.find_spans(docs).count() == len(rows)
    assert pii.find_spans(docs.limit(0)).count() == 0
    assert pii.spans("7" * 1_000_000) == [] and pii.spans("1." * 500_000)[:1] == [("ip", 0, 7)]


def quality_brute(text):
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_quality(odd, none):
    rows, docs = odd
    got = quality.quality_report(docs)
    expected = [(i, *(f := quality_brute(t or "")), f[0] < 50 or 100 * f[4] > 50 * f[0]) for i, t, *_ in rows]
    same(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"), expected)
    assert got.filter("base_failed and kept").count() == 0
    assert quality.quality_report(none).count() == 0


def test_hosts_are_shrunk_and_rejected(spark):
    rows = [("bad", k, k < 95) for k in range(100)] + [("good", k, k < 2) for k in range(100)] + [("small", 1, True)]
    features = spark.createDataFrame([(k, h, 30 if bad else 100, 500, 0, 0, 0) for h, k, bad in rows], "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    out = {(r.host, r.base_failed): (r.kept, r.host_rate) for r in quality.judged(features).collect()}
    assert out["bad", False][0] is False and out["good", False][0] is True
    assert out["good", False][1] < 0.1 and out["small", True][1] < 1


def test_mixing_meets_targets(spark):
    rows = [(i, "w " * 200, ["en", "de"][i % 5 == 0], ["src0", "src1", "src2"][min(i % 7, 2)], 400) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sources, langs, topics = {"src0": 2.0, "src1": 1.0, "src2": 1.0}, {"en": 3.0, "de": 1.0}, {"long": 1.0}
    out = mixing.mixed(docs, sources, langs, topics, share=0.01)
    weight = {m: {r[0]: r[1] for r in out.groupBy(m).agg(F.sum(F.col("tokens") * F.col("probability"))).collect()} for m in ("source", "lang")}
    for margin, targets in (("source", sources), ("lang", langs)):
        total = sum(weight[margin].values())
        for k, v in targets.items():
            assert weight[margin][k] / total == pytest.approx(v / sum(targets.values()), abs=1e-4)
    chosen = mixing.selected(docs, sources=sources, langs=langs, topics=topics, share=0.01)
    assert chosen.columns == docs.columns
    assert chosen.count() == pytest.approx(out.agg(F.sum("probability")).first()[0], rel=0.1)


def test_one_thin_category_does_not_shrink_the_sample(spark):
    kinds = [f"src{i}" for i in range(20)]
    rows = [(i, "w " * 200, ["en", "en", "en", "de", "fr", "es"][i % 6], kinds[i % 20], 400) for i in range(3000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    kept = lambda rows: mixing.mixed(spark.createDataFrame(rows, schema)).agg(F.sum(F.col("tokens") * F.col("probability")) / F.sum("tokens")).first()[0]
    before = kept(rows)
    assert before >= 0.25
    for thin in ((3000, "w " * 300, "en", None, 600), (3000, "w " * 300, None, "src1", 600), (3000, "w", "en", "src1", 1)):
        assert kept([*rows, thin]) == pytest.approx(before, abs=0.01)
    out = mixing.mixed(spark.createDataFrame([*rows, (3000, "w " * 300, "en", None, 600)], schema))
    assert out.filter("row.doc_id = 3000").first()["probability"] > 0.9 and out.agg(F.max("probability")).first()[0] <= 1


def test_mixing_of_odd_rows(odd, none):
    rows, docs = odd
    assert mixing.mixed(docs).count() == len(rows)
    assert mixing.selected(docs).columns == docs.columns
    assert mixing.selected(none).count() == 0


def test_toxicity_learns_pairs_and_words(spark):
    rng = random.Random(2)
    filler = [f"w{i}" for i in range(400)]
    docs, labels = [], []
    for i in range(900):
        words = [rng.choice(filler) for _ in range(rng.randint(5, 80))]
        kind = i % 5
        words += {0: ["badword"], 1: ["mean", "group"], 2: ["mean"], 3: ["group"]}.get(kind, [])
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, int(kind < 2)))
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    learn = toxicity.learnable(y)
    machine = toxicity.fit(d, learn)
    scores = {r.doc_id: r.score for r in d.withColumn("score", toxicity.score(machine)("text")).collect()}
    held = set(range(900)) - {r.doc_id for r in learn.collect()}
    assert len(held) > 200
    right = sum((scores[i] >= 0.5) == bool(labels[i][1]) for i in held) / len(held)
    assert right > 0.97
    pairs = [i for i in held if i % 5 == 1]
    assert sum(scores[i] >= 0.5 for i in pairs) / len(pairs) > 0.9


def test_toxicity_of_odd_rows(odd, none):
    rows, docs = odd
    machine = toxicity.fit(docs, docs.select("doc_id", F.lit(1).alias("toxic")).limit(0))
    out = docs.select(toxicity.score(machine)("text").alias("score"))
    assert out.filter("score between 0 and 1").count() == len(rows)
    assert none.select(toxicity.score(machine)("text")).count() == 0
    empty = toxicity.fit(none, none.select("doc_id", F.lit(1).alias("toxic")))
    assert docs.select(toxicity.score(empty)("text").alias("score")).distinct().count() == 1


def test_a_machine_s_probability_is_its_pairwise_sum():
    rng = np.random.default_rng(4)
    machine = toxicity.Machine(np.arange(0, 60, 2), -0.3, rng.normal(size=30), rng.normal(size=(30, 4)))
    terms = np.array([0, 1, 4, 10, 33, 58])
    held = [t // 2 for t in terms if t % 2 == 0]
    z = -0.3 + sum(machine.weights[i] for i in held)
    z += sum(float(machine.factors[i] @ machine.factors[j]) for a, i in enumerate(held) for j in held[:a])
    assert machine.probability(terms) == pytest.approx(1 / (1 + math.exp(-z)))


def forward_brute(model, symbols):
    now = model.start * model.emit[:, symbols[0]]
    for s in symbols[1:]:
        now = (now @ model.move) * model.emit[:, s]
    return math.log10(now.sum())


def test_forward_and_expected_counts():
    rng = np.random.default_rng(1)
    k, m = 3, 6
    model = hmm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(m), k))
    sequences = [rng.integers(0, m, n) for n in (1, 7, 3, 12, 1, 5)]
    assert hmm.forward(model, sequences) == pytest.approx([forward_brute(model, s) for s in sequences])
    starts, moves, emits = hmm.expected(model, sequences)
    assert starts.sum() == pytest.approx(6) and moves.sum() == pytest.approx(sum(len(s) - 1 for s in sequences)) and emits.sum() == pytest.approx(sum(map(len, sequences)))
    better = hmm.Model(starts / starts.sum(), moves / moves.sum(1, keepdims=True), emits / emits.sum(1, keepdims=True))
    assert sum(hmm.forward(better, sequences)) > sum(hmm.forward(model, sequences))


@pytest.mark.parametrize("held", [1 << 20, 30, 0])
def test_language_scores(odd, held):
    rows, docs = odd
    words = [(i, WORD.findall((t or "").translate(LOWER)) + ["\n"]) for i, t, *_ in rows]
    out_of = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, ws in words if not out_of(i) for w in ws)
    n, v = sum(c.values()), len(c)
    expected = sorted(((i, out_of(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for i, ws in words), key=str)
    got = hmm.language_scores(docs, states=3, emissions=20, held=held).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == expected
    assert all(r.score < 0 for r in got)
    assert sum(r.score for r in got if not r.held_out) > sum(r.base_score for r in got if not r.held_out)


def test_words_beyond_the_most_frequent_have_states(spark):
    """Two kinds of documents, each with words that tell it and 12,000 of its own that occur twice: over 20,000 in all."""
    rng = random.Random(4)
    ids = (i for i in range(1000) if zlib.crc32(str(i).encode()) % 5 != 1)
    rows = [(next(ids), " ".join(w for j in range(100) for w in [f"{kind}{(i * 100 + j) % 12000}", *[f"{kind}x{rng.randrange(50)}"] * rng.choice([0, 0, 1, 4])])) for kind in "ab" for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    score = lambda **options: hmm.language_scores(docs, states=2, **options).agg(F.sum("score")).first()[0]
    # The 8000 tokens of the other 4000 words are about twice as likely where their kind is known.
    assert score() - score(emissions=20_000) > 0.4 * 8000 * math.log10(2)
    counts = spark.createDataFrame([(i, 1 + i % 3) for i in range(60000)], "word long, n long")
    vocabulary, _ = hmm._vocabulary(counts, 5, 1 << 20, 1 << 19)
    assert vocabulary.emissions == 40000 and vocabulary.weights().sum() == pytest.approx(120005 + 0.5 * 60002)


def test_language_scores_of_nothing(none):
    assert hmm.language_scores(none).count() == 0


def test_spans_digest():
    found = [("email", 0, 5), ("iban", 7, 9)]
    assert pii.base_digest(found) == hashlib.sha256(b"email:0:5").hexdigest()
