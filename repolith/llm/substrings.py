"""Removal of word sequences that occur earlier in the corpus, by suffix automata of reference shards.

Any two equal 20-word windows choose the same anchor, the 8-gram of least hash in them, so only windows whose anchor
occurs twice can match. Consecutive windows with one anchor are a piece. Pieces are dealt by anchor: the distinct
pieces that share an anchor are the reference shard for all texts that hold it. Its suffix automaton (one bounded
group of anchors at a time) gives each window's first occurrence. Shards of a corpus against itself can't be sent to
every document, so the anchor decides which shard a piece is streamed through.

Anchors of more than ``hot`` windows are dealt by the whole window instead; equal ones merge before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.llm import bloom, shared
from repolith.llm.text import Words, mix, ngrams, signed, texts

GRAM = 8
LAST = (1 << 63) - 1


def _runs(words: Words, window: int) -> tuple[np.ndarray, ...]:
    """Of each run of consecutive windows with one anchor: text, first window, windows, the anchor's hash; and all word hashes."""
    hashes = words.hashes(lower=False)
    grams, span = ngrams(hashes, GRAM), window - GRAM + 1
    n = len(hashes) - window + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return empty, empty, empty, np.zeros(0, np.uint64), hashes
    least = grams[:n].copy()
    for k in range(1, span):
        np.minimum(least, grams[k : n + k], out=least)
    at = np.zeros(n, np.int64)
    for k in range(span - 1, -1, -1):
        at[grams[k : n + k] == least] = k
    at += np.arange(n)
    text = words.text_of()[:n]
    valid = np.flatnonzero(np.arange(n) + window <= words.first[text + 1])
    if not len(valid):
        return empty, empty, empty, np.zeros(0, np.uint64), hashes
    new = np.ones(len(valid), bool)
    new[1:] = (np.diff(valid) != 1) | (np.diff(at[valid]) != 0)
    heads = np.flatnonzero(new)
    starts = valid[heads]
    return text[starts], starts, np.diff(np.append(heads, len(valid))), least[starts], hashes


def _anchors(window: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in texts(batch.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(signed(_runs(Words(data, offsets), window)[3]))], ["anchor"])

    return emit


def _bits_of(filter_rows: DataFrame, bits: int) -> np.ndarray:
    """A filter's bits as an array of bytes; its size is that of the filter, ``bits / 8``."""
    table = filter_rows.toArrow()
    array = np.zeros(bits // 64, np.int64)
    array[table["word"].to_numpy()] = table["mask"].to_numpy()
    return array.view(np.uint8)


def _holds(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = (keys & np.uint64(len(bitmap) * 8 - 1)).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _pieces(window: int, repeated, hot, with_words: bool):
    """Rows (key, doc, rid, start, n, hash and maybe words) of pieces whose anchor may be repeated."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, rids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "rid"))
            for row, _, data, offsets in texts(batch.column("text")):
                words = Words(data, offsets)
                text, start, n, key, hashes = _runs(words, window)
                keep = _holds(repeated.value, key)
                text, start, n, key = text[keep], start[keep], n[keep], key[keep]
                split = _holds(hot.value, key)
                if split.any():
                    whole = ngrams(hashes, window)
                    one = np.repeat(start[split], n[split]) + _count_up(n[split])
                    text = np.concatenate([text[~split], np.repeat(text[split], n[split])])
                    key = np.concatenate([key[~split], mix(whole[one])])
                    start = np.concatenate([start[~split], one])
                    n = np.concatenate([n[~split], np.ones(len(one), n.dtype)])
                # The hash of a piece: its words by place, so equal pieces have equal hashes.
                sizes = n + window - 1
                inside = _count_up(sizes)
                flat = hashes[np.repeat(start, sizes) + inside]
                ends = np.cumsum(sizes)
                marks = np.concatenate([[np.uint64(0)], np.cumsum(mix(flat + np.uint64(0x9E3779B97F4A7C15) * (inside + 1).astype(np.uint64)))])
                digest = mix(marks[ends] - marks[ends - sizes] + sizes.astype(np.uint64))
                columns = {
                    "key": signed(key), "hash": signed(digest), "doc": docs[row + text], "rid": rids[row + text],
                    "start": (start - words.first[text]).astype(np.int32), "n": n.astype(np.int32),
                }
                arrays = [pa.array(c) for c in columns.values()]
                if with_words:
                    places = np.concatenate([[0], ends]).astype(np.int64) * 8
                    binary = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(places.tobytes()), pa.py_buffer(flat.tobytes())])
                    arrays.append(binary.cast(pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, [*columns, *["words"] * with_words])

    return emit


def _count_up(sizes: np.ndarray) -> np.ndarray:
    """0 to size - 1 for each size, end to end."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


class SuffixAutomaton:
    """Of a sequence: states with longest length, suffix link, transitions and the first place at which they end."""

    def __init__(self):
        self.length, self.link, self.next, self.first_end = [0], [-1], [{}], [-1]
        self.last = self.size = 0

    def add(self, symbol) -> None:
        length, link, follow, first_end = self.length, self.link, self.next, self.first_end
        state, current = self.last, len(length)
        length.append(length[state] + 1)
        follow.append({})
        first_end.append(self.size)
        link.append(0)
        while state != -1 and symbol not in follow[state]:
            follow[state][symbol] = current
            state = link[state]
        if state != -1:
            other = follow[state][symbol]
            if length[state] + 1 == length[other]:
                link[current] = other
            else:
                copy = len(length)
                length.append(length[state] + 1)
                follow.append(dict(follow[other]))
                link.append(link[other])
                first_end.append(first_end[other])
                while state != -1 and follow[state].get(symbol) == other:
                    follow[state][symbol] = copy
                    state = link[state]
                link[other] = link[current] = copy
        self.last, self.size = current, self.size + 1

    def matches(self, symbols, least: int) -> Iterator[tuple[int, int]]:
        """(end, first end in the reference) of each ``least`` symbols of ``symbols`` that the reference holds."""
        state = matched = 0
        for end, symbol in enumerate(symbols):
            while state and symbol not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if symbol in self.next[state]:
                state, matched = self.next[state][symbol], matched + 1
            if matched >= least:
                at = state
                while self.length[self.link[at]] >= least:
                    at = self.link[at]
                yield end, self.first_end[at]


def _firsts(pieces: list[tuple], window: int) -> list[list[tuple[int, int]]]:
    """For each of one shard's pieces (hash, doc, start, words) in order of (doc, start): each window's first (doc, start)."""
    automaton, origin = SuffixAutomaton(), []
    for i, (_, doc, start, words) in enumerate(pieces):
        for k, symbol in enumerate(words):
            automaton.add(symbol)
            origin.append((doc, start + k - window + 1))
        automaton.add(("border", i))
        origin.append(None)
    return [[origin[first] for _, first in automaton.matches(words, window)] for *_, words in pieces]


def _shards(window: int, most_words: int):
    """Streams distinct pieces, sorted by key and place, through the automata of shards of up to ``most_words`` or one key."""

    def answer(group: list[tuple]) -> Iterator[tuple]:
        """group: (key, hash, doc, start, rows, words)."""
        shard, size = [], 0
        at = 0
        while at < len(group):
            end = at + 1
            while end < len(group) and group[end][0] == group[at][0]:
                end += 1
            own = group[at:end]
            at = end
            if len(own) == 1 and len(set(own[0][5])) == len(own[0][5]):
                key, piece, doc, start, rows, words = own[0]
                if rows > 1:
                    yield key, piece, [{"doc": doc, "start": start + k} for k in range(len(words) - window + 1)]
            else:
                shard += own
                size += sum(len(p[5]) for p in own)
            if shard and (size >= most_words or at == len(group)):
                for (key, piece, doc, start, rows, _), found in zip(shard, _firsts([(p[1], p[2], p[3], p[5]) for p in shard], window)):
                    if rows > 1 or any(f != (doc, start + k) for k, f in enumerate(found)):
                        yield key, piece, [{"doc": d, "start": s} for d, s in found]
                shard, size = [], 0

    kind = pa.list_(pa.struct([("doc", pa.int64()), ("start", pa.int32())]))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[tuple] = []

        def out(group):
            rows = list(answer(group))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], kind)], ["key", "hash", "firsts"])

        for batch in batches:
            words = [np.frombuffer(w.as_buffer(), np.int64).tolist() for w in batch.column("words")]
            rest += zip(*(batch.column(c).to_pylist() for c in ("key", "hash", "doc", "start", "rows")), words)
            last = rest[-1][0] if rest else None
            done = len(rest)
            while done and rest[done - 1][0] == last:
                done -= 1
            yield from out(rest[:done])
            rest = rest[done:]
        yield from out(rest)

    return stream


def _cleaned(window: int):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, starts in zip(batch.column("text"), batch.column("starts")):
                words = (text.as_py() or "").encode().split()
                n = len(words)
                at = np.array(starts.as_py() or [], np.int64)
                if len(at):
                    edges = np.zeros(n + 1, np.int64)
                    np.add.at(edges, at, 1)
                    np.add.at(edges, at + window, -1)
                    stay = np.cumsum(edges)[:n] == 0
                    words = list(compress(words, stay.tolist()))
                n_words.append(n)
                n_removed.append(n - len(words))
                kept.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), batch.column("rows")], ["doc_id", "n_words", "n_removed", "kept_sha256", "rows"])

    return clean


def remove_repeats(docs: DataFrame, window: int = 20, hot: int = 1000, bits: int = 1 << 26, shard_words: int = 20_000) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_sha256.

    A word goes if a window of ``window`` words over it also starts earlier: at a smaller doc_id or earlier in the
    same document. Null ids come last and count as one document, as do rows that repeat an id. Null and short texts
    keep their words. ``bits`` bounds the two filters of anchors (8 MB each) that go to all tasks; a full filter
    costs time only.
    """
    spark = docs.sparkSession
    shared.small_batches(spark)
    id_kind = docs.schema["doc_id"].dataType
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).cast("long").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("rid", F.xxhash64("doc", "text"))
    # Equal texts: only the first goes on; of the later ones all words go, if they have a window at all.
    text_bits = bloom.filter_bits(docs.count())
    equal = bloom.repeated_filter(rows.select(F.xxhash64("text").alias("h")), "h", text_bits)
    split = bloom.flagged(rows, F.xxhash64("text"), equal, text_bits, "maybe")
    counted = split.filter("maybe").groupBy(F.unhex(F.sha2("text", 256)).alias("digest"), "doc", "doc_id").agg(F.count("*").alias("rows"))
    counted = shared.written(counted, "copies")
    # Written, so that the joins with it deal their sides themselves and can split a large group.
    leads = shared.written(counted.groupBy("digest").agg(F.min("doc").alias("lead")), "leads")
    by_digest = split.filter("maybe").withColumn("digest", F.unhex(F.sha2("text", 256))).groupBy("digest").agg(F.first("text").alias("text"))
    first_rows = counted.join(leads, "digest").filter("doc = lead").select("digest", "doc", "doc_id", "rows")
    firsts = shared.written(first_rows.join(by_digest, "digest").select("doc_id", "doc", "text", F.xxhash64("doc", "text").alias("rid"), "rows"), "first-texts")
    single = split.filter("not maybe").select("doc_id", "doc", "text", "rid", F.lit(1).cast("long").alias("rows"))
    contents = single.unionByName(firsts)

    anchors = contents.select("text").mapInArrow(_anchors(window), "anchor long").groupBy("anchor").count().filter("count > 1")
    anchors = shared.written(anchors, "anchors")
    in_filter = lambda df: bloom.packed(df.select(bloom.position(F.col("anchor"), bits).alias("position")).distinct())
    repeated = spark.sparkContext.broadcast(_bits_of(in_filter(anchors), bits))
    split_up = spark.sparkContext.broadcast(_bits_of(in_filter(anchors.filter(F.col("count") > hot)), bits))
    columns = "key long, hash long, doc long, rid long, start int, n int"
    source = contents.select("doc", "rid", "text")
    pieces = source.mapInArrow(_pieces(window, repeated, split_up, True), f"{columns}, words binary")
    place = F.struct("doc", "start")
    distinct = pieces.groupBy("key", "hash").agg(F.min(place).alias("place"), F.count("*").alias("rows"), F.first("words").alias("words"))
    # An aggregate is dealt by (key, hash); shards need all pieces of a key together, in order.
    shards = distinct.select("key", "hash", "place.doc", "place.start", "rows", "words")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = shards.repartition(n, "key").sortWithinPartitions("key", "doc", "start", "hash")
    answers = shards.mapInArrow(_shards(window, shard_words), "key long, hash long, firsts array<struct<doc: long, start: int>>")
    occurrences = source.mapInArrow(_pieces(window, repeated, split_up, False), columns)
    earlier = F.filter(
        F.transform("firsts", lambda f, k: F.struct(((f["doc"] < F.col("doc")) | ((f["doc"] == F.col("doc")) & (f["start"] < F.col("start") + k))).alias("gone"), (F.col("start") + k).alias("at"))),
        lambda x: x["gone"],
    )
    gone = occurrences.join(answers, ["key", "hash"]).select("doc", "rid", F.transform(earlier, lambda x: x["at"]).alias("at")).filter(F.size("at") > 0)
    gone = shared.written(gone.groupBy("doc", "rid").agg(F.flatten(F.collect_list("at")).alias("starts")), "repeats")

    has = bloom.member_filter(gone, "rid", text_bits)
    marked = bloom.flagged(contents, F.xxhash64("rid"), has, text_bits, "has")
    untouched = marked.filter("not has").select("doc_id", "text", "rows", F.lit(None).cast("array<int>").alias("starts"))
    touched = marked.filter("has").join(gone, ["doc", "rid"], "left").select("doc_id", "text", "rows", "starts")
    clean = lambda df: df.mapInArrow(_cleaned(window), f"doc_id {id_kind.simpleString()}, n_words long, n_removed long, kept_sha256 string, rows long")
    results = clean(untouched).unionByName(clean(touched))
    results = results.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).drop("copy", "rows")
    # Later copies of a text: their words are counted where they are read.
    later = split.filter("maybe").select("doc_id", "doc", "text").withColumn("digest", F.unhex(F.sha2("text", 256)))
    n_words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    joined = F.array_join(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""), " ")
    later = later.select("doc_id", "doc", "digest", n_words.alias("n_words"), F.sha2(joined, 256).alias("whole"))
    later = later.join(leads.withColumnRenamed("digest", "d"), F.col("digest") == F.col("d")).filter("doc > lead")
    long_enough = F.col("n_words") >= window
    copies = later.select(
        "doc_id", "n_words", F.when(long_enough, F.col("n_words")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(long_enough, F.sha2(F.lit(""), 256)).otherwise(F.col("whole")).alias("kept_sha256"),
    )
    return results.unionByName(copies)
