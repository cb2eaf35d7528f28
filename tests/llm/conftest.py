import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, maybe string, `word` int, `row` string, rid long, tokens int, probability double, `__word` int, `__text` string, `a.b` int"


def odd_rows():
    """Nulls in any column, empty and very long texts, ties and repeated rows, other letters; columns with clashing names."""
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("al", "be", "Ga", "dé", "ß") for b in range(12)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = text(150)
    rows = [(i, text(rng.randint(0, 60))) for i in range(40)]
    for i in range(40, 90):
        near = base.split()
        for _ in range(rng.randint(0, 4)):
            near[rng.randrange(len(near))] = rng.choice(words)
        rows.append((i, " ".join(near)))
    rows += [(90, text(6000)), (91, "x " * 3000), (92, base.upper()), (93, base.lower()), (94, base), (95, base), (96, ""), (97, None), (98, " \t\n "), (None, base), (None, None), (None, "alone")]
    rows += [(99, "same id, one"), (99, "same id, two"), (40, rows[40][1]), (94, base), (100, "line a\nline a\n\nline b"), (101, "a@b.co, call +1 (555) 123-4567 or 10.0.0.300 and 4111 1111 1111 1111\nü 192.168.1.1 é"), (102, "<|endoftext|> a  b\t\t c <|endoftext|>")]
    return [(i, t, rng.choice(["en", None, "xx"]), rng.choice(["src0", None, "new", "src1"]), None if t is None else len(t), "m", 1, "r", None, 2, 0.5, 3, "t", 4) for i, t in rows]


@pytest.fixture(scope="session")
def odd(spark):
    rows = odd_rows()
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def same(df, expected):
    got = [tuple(r) for r in df.collect()]
    key = lambda r: [(x is None, str(x)) for x in r]
    assert sorted(got, key=key) == sorted(expected, key=key)
