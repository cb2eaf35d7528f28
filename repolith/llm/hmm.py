"""A hidden Markov model of token sequences.

Tokens are ASCII lower-cased words, by hash, and an end. Words that occur twice or more have emissions of their own in
each state, the most frequent first as far as memory goes; all others share one symbol, whose emissions words that occur
once teach, and within it a word counts by its add-half share. Baum-Welch: each task runs the scaled forward-backward
recursion on its documents and sends expected counts of its words, which a shuffle sums. Scoring is the exact scaled
forward recursion over the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.llm import shared
from repolith.llm.text import Words, signed, texts


@dataclass
class Vocabulary:
    """The most frequent words, sorted by hash, with their counts and the symbols of those that have emissions; ``total``
    and ``distinct`` of all training tokens, of which ``ends`` are ends."""

    hashes: np.ndarray
    counts: np.ndarray
    symbol: np.ndarray
    emissions: int
    total: int
    distinct: int
    ends: int

    @property
    def rest(self) -> int:
        return self.emissions

    @property
    def end(self) -> int:
        return self.emissions + 1

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Places of words, -1 for those that are not held."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def weights(self) -> np.ndarray:
        """Add-half counts of the symbols; the rest holds all other words and one that was never seen."""
        own = self.symbol < self.emissions
        out = np.empty(self.emissions + 2)
        out[self.symbol[own]] = self.counts[own] + 0.5
        words = self.distinct - (self.ends > 0)
        out[self.rest] = self.total - self.ends - int(self.counts[own].sum()) + 0.5 * (words - self.emissions + 1)
        out[self.end] = self.ends + 0.5
        return out


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of each slice of a batch."""
    for batch in batches:
        for _, _, data, offsets in texts(batch.column("text")):
            word, n = np.unique(Words(data, offsets).hashes(lower=True), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(word)), pa.array(n)], ["word", "n"])


def _sequences(column: pa.Array, vocabulary: Vocabulary) -> Iterator[tuple[Words, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Slices: words, their hashes, their places in the vocabulary, and each text's symbols with the end."""
    symbol = np.append(vocabulary.symbol, vocabulary.rest)
    for _, _, data, offsets in texts(column, 1 << 20):
        words = Words(data, offsets)
        hashes = words.hashes(lower=True)
        places = vocabulary.places(hashes)
        symbols = symbol[places]
        yield words, hashes, places, [np.append(symbols[a:b], vocabulary.end).astype(np.int32) for a, b in zip(words.first[:-1], words.first[1:])]


def _chunks(sequences: list[np.ndarray], most: int = 300_000) -> Iterator[np.ndarray]:
    """Numbers of sequences of like length, up to ``most`` tokens or one sequence at a time: few steps for many tokens."""
    lengths = np.array([len(s) for s in sequences], np.int64)
    order = np.argsort(lengths, kind="stable")
    at = 0
    sums = np.concatenate([[0], np.cumsum(lengths[order])])
    while at < len(order):
        end = max(at + 1, int(np.searchsorted(sums, sums[at] + most, "right")) - 1)
        yield order[at:end]
        at = end


def _columns(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by falling length, how many texts are alive at each step, and all symbols step by step."""
    lengths = np.array([len(s) for s in sequences])
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    alive = len(lengths) - np.searchsorted(lengths[::-1], np.arange(1, lengths[0] + 1), "left")
    flat = np.concatenate([sequences[i] for i in order])
    step = np.concatenate([np.arange(n) for n in lengths])
    return order, alive, flat[np.argsort(step, kind="stable")]


def forward(model: Model, sequences: list[np.ndarray], keep: bool = False):
    """log10 likelihoods of the sequences; with ``keep`` also what the backward pass needs."""
    order, alive, symbols = _columns(sequences)
    emitted = np.ascontiguousarray(model.emit.T)[symbols]
    logs = np.zeros(len(sequences))
    scales = np.empty(len(symbols))
    states = np.empty_like(emitted) if keep else None
    at, now = 0, None
    for n in alive.tolist():
        now = model.start * emitted[at : at + n] if now is None else (now[:n] @ model.move) * emitted[at : at + n]
        scale = now.sum(1)
        now /= scale[:, None]
        scales[at : at + n] = scale
        if keep:
            states[at : at + n] = now
        at += n
    log = np.log10(scales)
    rank = np.concatenate([np.arange(n) for n in alive])
    logs[order] = np.bincount(rank, log, len(sequences))
    return (logs, alive, symbols, emitted, scales, states) if keep else logs


def expected(model: Model, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, moves and emissions of the sequences."""
    _, alive, symbols, emitted, scales, states = forward(model, sequences, keep=True)
    k = len(model.start)
    moves, posts = np.zeros((k, k)), np.empty_like(states)
    ends = np.cumsum(alive)
    back = np.ones((0, k))
    for t in range(len(alive) - 1, -1, -1):
        a, b = ends[t] - alive[t], ends[t]
        if len(back) < alive[t]:
            back = np.concatenate([back, np.ones((alive[t] - len(back), k))])
        posts[a:b] = states[a:b] * back
        if t:
            weighted = emitted[a:b] * back / scales[a:b, None]
            before = ends[t - 1] - alive[t - 1]
            moves += states[before : before + alive[t]].T @ weighted
            back = weighted @ model.move.T
    emits = np.stack([np.bincount(symbols, posts[:, s], model.emit.shape[1]) for s in range(k)])
    return posts[: alive[0]].sum(0), moves * model.move, emits


def _maximised(starts: np.ndarray, moves: np.ndarray, emits: np.ndarray, prior: np.ndarray, weight: float = 50.0) -> Model:
    """The model of these counts. Each state's emissions are drawn towards ``prior`` as if by ``weight`` more tokens."""
    emit = emits + weight * prior
    emit /= emit.sum(1, keepdims=True)
    return Model((starts + 0.1) / (starts + 0.1).sum(), (moves + 0.1) / (moves + 0.1).sum(1, keepdims=True), emit)


def _compact(model: Model, sequences: list[np.ndarray]) -> tuple[np.ndarray, Model, list[np.ndarray]]:
    """The symbols of the sequences, the model with their emissions alone, and the sequences by places among them."""
    symbols, flat = np.unique(np.concatenate(sequences), return_inverse=True)
    return symbols, Model(model.start, model.move, model.emit[:, symbols].astype(float)), np.split(flat, np.cumsum([len(s) for s in sequences])[:-1])


def _counted(vocabulary: Vocabulary, model: Model):
    """The sum of a task's expected counts, as rows (symbol, a value for each state): those of its symbols, of starts as
    symbol -1 and of moves from the first, second... state as -2, -3..."""
    k = len(model.start)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, other = np.zeros((vocabulary.end + 1, k)), np.zeros((k + 1, k))
        for batch in batches:
            sequences = [s for *_, some in _sequences(batch.column("text"), vocabulary) for s in some]
            for chunk in _chunks(sequences):
                symbols, part, some = _compact(model, [sequences[i] for i in chunk])
                starts, moves, emits = expected(part, some)
                total[symbols] += emits.T
                other += np.vstack([starts, moves])
        met = np.flatnonzero(total[:, 0] > 0)
        for at in [-1, *range(0, len(met), 1 << 16)]:
            symbols = met[at : at + (1 << 16)] if at >= 0 else -1 - np.arange(k + 1)
            values = total[symbols] if at >= 0 else other
            yield pa.RecordBatch.from_arrays([pa.array(symbols, pa.int32()), *[pa.array(values[:, i].astype(np.float32)) for i in range(k)]], ["symbol", *[f"v{i}" for i in range(k)]])

    return emit


def _summed(texts: DataFrame, vocabulary: Vocabulary, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, moves and emissions of all ``texts``. A task has few rows of one symbol: they meet in one shuffle, unsummed."""
    k = len(model.start)
    values = [f"v{i}" for i in range(k)]
    rows = texts.mapInArrow(_counted(vocabulary, model), ", ".join(["symbol int", *[f"{v} float" for v in values]])).repartition("symbol")
    table = rows.groupBy("symbol").agg(*[F.sum(v).alias(v) for v in values]).toArrow()
    symbols, sums = table["symbol"].to_numpy(), np.stack([table[v].to_numpy() for v in values])
    emits, other = np.zeros((k, vocabulary.end + 1)), np.zeros((k + 1, k))
    emits[:, symbols[symbols >= 0]] = sums[:, symbols >= 0]
    other[-1 - symbols[symbols < 0]] = sums[:, symbols < 0].T
    return other[0], other[1:], emits


def _guess(sample: list[np.ndarray], prior: np.ndarray, states: int, rounds: int) -> Model:
    """A first model: Baum-Welch on a sample from a random split of its documents among the states. Symbols that the
    sample doesn't hold are one in it; they share its emissions by ``prior``."""
    rng = np.random.default_rng(11)
    k = states
    symbols, flat = np.unique(np.concatenate(sample), return_inverse=True)
    sample = np.split(flat, np.cumsum([len(s) for s in sample])[:-1])
    others = max(1.0 - prior[symbols].sum(), 1e-300)
    part = np.append(prior[symbols], others)
    m = len(part)
    emits = np.stack([np.bincount(np.concatenate([s for s, g in zip(sample, rng.integers(0, k, len(sample))) if g == i] or [np.zeros(0, np.int64)]), minlength=m) for i in range(k)]).astype(float)
    model = _maximised(np.ones(k), np.full((k, k), 1.0) + np.eye(k) * 50 * k, emits, part)
    for _ in range(rounds):
        parts = [expected(model, [sample[i] for i in chunk]) for chunk in _chunks(sample)]
        model = _maximised(*[sum(p) for p in zip(*parts)], part)
    emit = np.outer(model.emit[:, -1] / others, prior)
    emit[:, symbols] = model.emit[:, :-1]
    return Model(model.start, model.move, emit)


def is_held_out(doc_id):
    """crc32 of the id as text, mod 5, is 1; null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 1, F.lit(False))


def _scored(vocabulary: Vocabulary, model: Model):
    """n_tokens, known tokens, base score and forward score, all but for the words that the vocabulary doesn't hold; and
    those words with their counts."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = np.log10(vocabulary.total + 0.5 * (vocabulary.distinct + 1))
        outside = np.log10(vocabulary.weights()[vocabulary.rest])
        logs = np.append(np.log10(vocabulary.counts + 0.5), 0.0)
        end = np.log10(vocabulary.ends + 0.5)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            every: list[np.ndarray] = []
            for words, hashes, places, sequences in _sequences(batch.column("text"), vocabulary):
                own = logs[places]
                every += sequences
                for i, s in enumerate(sequences):
                    part = slice(words.first[i], words.first[i + 1])
                    missing = places[part] < 0
                    word, n = np.unique(hashes[part][missing], return_counts=True)
                    rest = s[:-1] == vocabulary.rest
                    out[0].append(len(s))
                    out[1].append(int(len(s) - 1 - missing.sum() + (vocabulary.ends > 0)))
                    out[2].append(float(own[part].sum() + end - len(s) * unit))
                    out[3].append(float(own[part][rest].sum() - rest.sum() * outside))
                    out[4].append(signed(word))
                    out[5].append(n.astype(np.int32))
            score = np.array(out[3])
            for chunk in _chunks(every):
                score[chunk] += forward(*_compact(model, [every[i] for i in chunk])[1:])
            out[3] = score.tolist()
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), batch.column("held_out"), *[pa.array(c, t) for c, t in zip(out, kinds)]],
                ["doc_id", "row", "held_out", "n_tokens", "n_known", "base_score", "score", "words", "counts"],
            )

    return emit


def _vocabulary(counts: DataFrame, ends: int, held: int, emissions: int) -> tuple[Vocabulary, int]:
    """The words of the least count at which no more than ``held`` qualify, and that count. Those that occur twice or
    more, up to ``emissions``, have symbols of their own."""
    by_count = np.array([tuple(r) for r in counts.groupBy("n").agg(F.count("*").alias("k")).collect()], np.int64).reshape(-1, 2)
    by_count = by_count[np.argsort(-by_count[:, 0])]
    fits = np.cumsum(by_count[:, 1]) <= held
    least = int(by_count[fits][-1, 0]) if fits.any() else (1 << 62)
    table = counts.filter(F.col("n") >= least).toArrow()
    hashes, n = table["word"].to_numpy().view(np.uint64), table["n"].to_numpy()
    order = np.argsort(hashes)
    hashes, n = hashes[order], n[order]
    emissions = min(emissions, int((n >= 2).sum()))
    symbol = np.full(len(n), emissions)
    symbol[np.sort(np.lexsort((hashes, -n))[:emissions])] = np.arange(emissions)
    total, distinct = int((by_count[:, 0] * by_count[:, 1]).sum()), int(by_count[:, 1].sum())
    return Vocabulary(hashes, n, symbol, emissions, total + ends, distinct + (ends > 0), ends), least


def language_scores(docs: DataFrame, states: int = 8, emissions: int = 1 << 19, held: int = 1 << 20, passes: int = 2, sample_rows: int = 1500) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from documents that :func:`is_held_out` leaves. ``base_score`` is the add-half unigram score, ``score`` the
    model's log10 likelihood. ``passes`` full Baum-Welch passes run over all of them, from a guess fitted to
    ``sample_rows`` of them. Driver and tasks hold ``held`` words with counts (16 MB) and up to ``emissions`` of them in
    each state (16 MB, and 32 MB of expected counts); rarer words meet their counts in a shuffle. Null texts are the end alone; repeated rows
    each get a row; an empty table gives an empty table.
    """
    shared.small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), is_held_out(F.col("doc_id")).alias("held_out"))
    train = rows.filter("not held_out").select("doc_id", "text")
    counts = train.select("text").mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = shared.written(counts, "word-counts")
    ends = train.count()
    vocabulary, least = _vocabulary(counts, ends, held, emissions)
    prior = vocabulary.weights() / vocabulary.weights().sum()
    model = Model(np.full(states, 1 / states), np.full((states, states), 1 / states), np.tile(prior, (states, 1)))
    if ends:
        # The least hashes of the ids; a threshold leaves some four times as many rows as are needed to be compared.
        hashed = train.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)).alias("h")).filter(F.col("h") <= int(4 * sample_rows / ends * (1 << 40)))
        chosen = hashed.orderBy("h", "doc_id").limit(sample_rows).select("doc_id").distinct()
        picked = train.join(F.broadcast(chosen), "doc_id").limit(sample_rows).select("text").toArrow()["text"].combine_chunks()
        sample = [s for *_, sequences in _sequences(picked, vocabulary) for s in sequences]
        model = _guess(sorted(sample, key=lambda s: (len(s), s.tobytes())), prior, states, 12) if sample else model
    for _ in range(passes if ends else 0):
        model.emit = model.emit.astype(np.float32)
        model = _maximised(*_summed(train.select("text"), vocabulary, model), prior)
    model.emit = model.emit.astype(np.float32)

    columns = f"doc_id {kind}, row long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    scored = rows.withColumn("row", F.xxhash64("doc_id", "text")).mapInArrow(_scored(vocabulary, model), f"{columns}, words array<long>, counts array<int>")
    scored = shared.written(scored, "scores")
    pair = F.explode(F.arrays_zip("words", "counts")).alias("pair")
    rare = scored.filter(F.size("words") > 0).dropDuplicates(["doc_id", "row"]).select("doc_id", "row", pair).select("doc_id", "row", F.col("pair.words").alias("word"), F.col("pair.counts").alias("times"))
    c = F.coalesce("n", F.lit(0))
    rare = rare.join(counts.filter(F.col("n") < least), "word", "left").groupBy("doc_id", "row").agg(
        F.sum(F.col("times") * F.log10(c + 0.5)).alias("more"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known")
    )
    rare = rare.withColumnRenamed("doc_id", "id").withColumnRenamed("row", "id_row")
    out = scored.drop("words", "counts").join(rare, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("row") == F.col("id_row")), "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"), (F.col("base_score") + more).alias("base_score"), (F.col("score") + more).alias("score"),
    )
