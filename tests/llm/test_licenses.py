"""Licences: base phrases against a plain scan, detections against all rules tried at every word."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from repolith.llm import license_rules, licenses, queries
from tests.llm.conftest import odd_rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
LINES = [
    "Licensed under the Apache License, Version 2.0.", "This is under the MIT License.", "Licensed under CC BY-NC 4.0.", "licensed under the GNU General Public License, version 3.", "All rights reserved.",
    "SPDX-License-Identifier: GPL-2.0-or-later", "GNU Lesser General Public Licence v2.1 or later", "https://creativecommons.org/licenses/by-sa/4.0/", "dual licensed under the 3-clause BSD",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "cc\x7fby", "CC BY", "cc by cc by-nd", "all rights reserved all rights reserved",
]


def plain(text):
    """Words and the places of base phrases."""
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [(i, label) for i in range(len(words)) for phrase, label in PHRASES.items() if tuple(words[i : i + len(phrase)]) == phrase]


def everywhere(words):
    """Detections of every rule at every word, without keywords, and those that no other one suppresses, by all pairs."""
    text = " ".join(words).replace("licence", "license")
    alone, names = license_rules.rules()
    starts, found = [0] + [m.end() for m in re.finditer(" ", text)], set()
    for at in starts:
        for rule in alone:
            m = rule.pattern.match(text, at)
            tier = license_rules.TIERS.index(rule.tier)
            for name in (names if rule.label is None else [rule]) if m else []:
                n = m if name is rule else name.pattern.match(text, m.end())
                if n:
                    found.add((at, n.end(), tier, name.order, license_rules.label_of(name.label, n), rule.weight))
    inside = lambda a, b: b[0] <= a[0] and a[1] <= b[1] and a != b and (b[2] < a[2] or b[2] == a[2] and ((b[0], b[1]) != (a[0], a[1]) or b[3] < a[3]))
    return sorted(d for d in found if not any(inside(d, o) for o in found))


def odd_texts():
    rng = random.Random(8)
    rows = [(i, t) for i, t, *_ in odd_rows()]
    for i in range(200, 260):
        words = [rng.choice(["the", "of", "der", "mit", "x", "license", "gnu", "und"]) for _ in range(40)]
        for _ in range(rng.randint(0, 4)):
            words.insert(rng.randrange(len(words)), rng.choice(LINES))
        rows.append((i, " ".join(words)))
    return rows + [(300 + i, line) for i, line in enumerate(LINES)] + [(400, "filler words " * 100_000 + LINES[0] + " more" * 100_000)]


def test_query_against_plain_scan(spark, tmp_path):
    rows = odd_texts()
    spark.createDataFrame([(i, t, 1, "b") for i, t in rows], "doc_id long, text string, n_words int, base string").repartition(4).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = queries.op12_license_scan(spark, f"file://{tmp_path}").collect()
    expected = []
    for i, text in rows:
        words, base = plain(text)
        kept = everywhere(words) if len(words) < 10_000 else None
        labels = {label for _, label in base} | ({d[4] for d in kept} if kept is not None else {"apache-2.0"})
        places = [p for p, _ in base]
        expected.append((i, len(words), len(base), min(places, default=None), max(places, default=None), ",".join(sorted({b for _, b in base})), ",".join(sorted(labels))))
    key = lambda r: [(x is None, str(x)) for x in r]
    assert sorted(map(tuple, [r[:7] for r in got]), key=key) == sorted(expected, key=key)
    assert all(0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) for r in got)
    assert next(r.spans for r in got if r.doc_id == 400) == "apache-2.0:notice:200000:200008"


def test_suppression_against_all_pairs():
    rng = random.Random(2)
    for _ in range(300):
        words = WORD.findall(" ".join(rng.choice([*LINES, "x", "the", "license"]) for _ in range(6)).lower())
        _, found = licenses.detections(" ".join(words))
        assert sorted(map(tuple, licenses.unsuppressed(found))) == everywhere(words)


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Licensed under CC BY-NC 4.0.", {"cc-by-nc-4.0"}), ("GNU LGPL v3", {"lgpl-3.0"}), ("unter der Lizenz, mit allem", set()), ("Apache-2.0 or MIT license", {"apache-2.0", "mit"}),
        ("GPLv2+", {"gpl-2.0"}), ("gpl 2.0 or any later version", {"gpl-2.0-or-later"}), ("gpl 3 only", {"gpl-3.0"}), ("BSD 2-Clause", {"bsd-2-clause"}), ("public domain", set()), ("released into the public domain", {"public-domain"}),
    ],
)
def test_labels(text, labels):
    assert {d.label for d in licenses.unsuppressed(licenses.detections(licenses.words_of(text))[1])} == labels


def test_every_rule_has_a_keyword_and_versions_are_bounded():
    alone, names = license_rules.rules()
    assert len(alone) > 250 and all(len(r.keyword) >= 2 for r in [*alone, *names])


@pytest.mark.parametrize("unit", ["license ", "licensed under the ", "under the terms of ", "cc by ", "may not be reproduced or ", "gpl v2 or later ", "x" * 100, "a, b. "])
def test_time_is_linear(unit):
    began = time.perf_counter()
    licenses._found(unit * (1_000_000 // len(unit)))
    assert time.perf_counter() - began < 20


def test_empty_table_and_other_ids(spark, none):
    assert licenses.find_licenses(none).count() == 0
    got = licenses.find_licenses(spark.createDataFrame([("a", "MIT License"), (None, None)], "doc_id string, text string")).select("doc_id", F.size("spans")).collect()
    assert sorted(map(tuple, got), key=str) == [("a", 1), (None, 0)]
