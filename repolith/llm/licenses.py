"""Licences in texts by ordered signature rules.

Texts become lower-case words joined by single spaces. Aho-Corasick finds the keywords that rules start with; only those
rules are tried, and only where their keyword stands, so time follows the length of a text and its keywords. A detection
inside one of an earlier tier, or inside a longer one of its own tier, is suppressed.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from repolith.llm import license_rules, shared

#: Phrases that count wherever they stand, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

_WORDS = {c: " " for c in range(128) if chr(c) not in string.ascii_lowercase + string.digits} | {ord(u): u.lower() for u in string.ascii_uppercase}
_SPACES = re.compile(" {2,}")
_BASE_KIND = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_SPAN_KIND = pa.list_(pa.struct([("label", pa.string()), ("form", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


class Detection(NamedTuple):
    """Places of letters, ends exclusive."""

    start: int
    end: int
    tier: int
    order: int
    label: str
    weight: float


def words_of(text: str) -> str:
    """Words of a text, lower-case and joined by single spaces: runs of a-z, 0-9 and all that is not ASCII."""
    return _SPACES.sub(" ", text.translate(_WORDS)).strip(" ")


@lru_cache(maxsize=1)
def _rules() -> tuple[ahocorasick.Automaton, dict[str, list[license_rules.Rule]]]:
    """(keywords behind a space, names by their first two letters)."""
    alone, names = license_rules.rules()
    by_keyword: dict[str, list] = {}
    for rule in alone:
        by_keyword.setdefault(rule.keyword, []).append(rule)
    for phrase in BASE:
        by_keyword.setdefault(phrase, []).append(phrase)
    automaton, by_head = ahocorasick.Automaton(), {}
    for keyword, found in by_keyword.items():
        automaton.add_word(f" {keyword}", (len(keyword), found))
    automaton.make_automaton()
    for rule in names:
        by_head.setdefault(rule.keyword[:2], []).append(rule)
    return automaton, by_head


def detections(words: str) -> tuple[list[tuple[int, int, str]], list[Detection]]:
    """(base phrases with their places, every rule's detections) of a text of words, before suppression."""
    automaton, by_head = _rules()
    text = words.replace("licence", "license")
    base, found = [], []
    for end, (length, rules) in automaton.iter(f" {text}"):
        # The place in ``words``: one less for the space before them.
        at = end - length
        for rule in rules:
            if isinstance(rule, str):
                stop = at + len(rule)
                if words.startswith(rule, at) and words[stop : stop + 1] in ("", " "):
                    base.append((at, stop, BASE[rule]))
                continue
            m = rule.pattern.match(text, at)
            if not m:
                continue
            tier = license_rules.TIERS.index(rule.tier)
            if rule.label is not None:
                found.append(Detection(at, m.end(), tier, rule.order, license_rules.label_of(rule.label, m), rule.weight))
                continue
            for name in by_head.get(text[m.end() : m.end() + 2], ()):
                if n := name.pattern.match(text, m.end()):
                    found.append(Detection(at, n.end(), tier, name.order, license_rules.label_of(name.label, n), rule.weight))
    return base, found


def unsuppressed(found: list[Detection]) -> list[Detection]:
    """Those that lie in no other one of an earlier tier, nor of their own tier if that is longer or, for the same place,
    comes earlier in the order of rules. By start; one sweep with the furthest end of each tier."""
    furthest = [-1] * len(license_rules.TIERS)
    out = []
    for d in sorted(set(found), key=lambda d: (d.start, -d.end, d.tier, d.order)):
        if all(end < d.end for end in furthest[: d.tier + 1]):
            out.append(d)
        furthest[d.tier] = max(furthest[d.tier], d.end)
    return out


def _placed(words: str, places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Numbers of words, ends exclusive, of places of letters that are sorted by start."""
    out, at, number = [], 0, 0
    for start, end in places:
        number += words.count(" ", at, start)
        at = start
        out.append((number, number + words.count(" ", start, end) + 1))
    return out


def _found(text: str) -> tuple[int, list[dict], list[dict], float]:
    """(words, base phrases, spans, score)."""
    words = words_of(text)
    base, every = detections(words)
    base, kept = sorted(base), unsuppressed(every)
    best: dict[str, float] = {label: license_rules.WEIGHTS["base"] for *_, label in base}
    for d in kept:
        best[d.label] = max(best.get(d.label, 0.0), d.weight)
    doubt = 1.0
    for label in sorted(best):
        doubt *= 1 - best[label]
    bases = [{"label": label, "start": s, "end": e} for (*_, label), (s, e) in zip(base, _placed(words, [b[:2] for b in base]))]
    spans = [{"label": d.label, "form": license_rules.TIERS[d.tier], "start": s, "end": e} for d, (s, e) in zip(kept, _placed(words, [d[:2] for d in kept]))]
    return words.count(" ") + bool(words), bases, spans, 1 - doubt


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_found(x.as_py() or "") for x in batch.column("text")]
        kinds = (pa.int64(), _BASE_KIND, _SPAN_KIND, pa.float64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], ["doc_id", "n_words", "base", "spans", "score"])


def find_licenses(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_words, base (label, start, end), spans (label, form, start, end), score.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased; starts and ends (exclusive) count them from 0. ``base``
    lists every place of a phrase of :data:`BASE`, ``spans`` the rules' detections that no other one suppresses; ``score`` is
    1 less the product of the doubts of all distinct labels. Null and empty texts have no words, spans or score; rows that
    repeat and null ids stay; an empty table gives an empty table; other columns are ignored. A text is held several times
    over in its task, whatever its length.
    """
    shared.small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, base array<struct<label:string,start:long,end:long>>, spans array<struct<label:string,form:string,start:long,end:long>>, score double"
    return docs.select("doc_id", "text").mapInArrow(_scan, schema)
