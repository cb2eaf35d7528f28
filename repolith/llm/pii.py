"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, schemes, digits, plus signs and identifier cues. A deterministic parser
expands each anchor to its borders and validates it. Cues of secrets ("token", "password") take a value of 16 characters
or more with letters, digits and eight different characters. No shuffle; each text is looked at on its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from repolith.llm import shared

#: Kinds in the order in which equal starts are listed; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "account", "userinfo", "secret")
BASE = frozenset(KINDS[:4])
_ORDER = {kind: i for i, kind in enumerate(KINDS)}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: All that the numeric kinds consist of: a match lies within one run of these characters.
_RUN = re.compile(r"[0-9+().\x20-]+")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_IBAN = re.compile(r"[:#=\x20]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{1,4}){3,8})(?![A-Za-z0-9])")
_SSN = re.compile(r"[:#=\x20]{0,3}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")
_ACCOUNT = re.compile(r"(?:\x20(?:number|no\.?|nr\.?))?[:#=\x20]{1,3}([0-9](?:[0-9-]{4,22})[0-9])(?![0-9-])")
_USERINFO = re.compile(r"([A-Za-z0-9._%+-]+:[^\x20\x09-\x0D/@]+)@")
_SECRET = re.compile(r"(?:[_-]?(?:key|id|value))?[\"']?[\x20\x09]{0,2}[:=][\x20\x09]{0,2}[\"']?([A-Za-z0-9_+/=.~-]{16,})")
_SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "api-key", "apikey", "access_key", "private_key")
_CUES = {"iban": _IBAN, "ssn": _SSN, "account": _ACCOUNT, "acct": _ACCOUNT, "passport": _ACCOUNT} | dict.fromkeys(_SECRET_CUES, _SECRET)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _iban_valid(text: str) -> bool:
    text = text.replace(" ", "")
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _secret_valid(text: str) -> bool:
    letters = set(text)
    return len(letters) >= 8 and any(c.isdigit() for c in letters) and any(c.isalpha() for c in letters)


@lru_cache(maxsize=1)
def _anchors():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for c in "0123456789+":
        automaton.add_word(c, "number")
    automaton.add_word("@", "at")
    automaton.add_word("://", "scheme")
    for cue in _CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            automaton.add_word(form, cue)
    automaton.make_automaton()
    return automaton


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """Grows left over the local part, not beyond ``floor``, and right over the domain."""
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    domain = _DOMAIN.match(text, at + 1) if start < at else None
    return (start, domain.end()) if domain else None


def _numbers(text: str, start: int, end: int) -> Iterator[tuple[str, int, int]]:
    """The valid addresses, cards and phones of a run of their characters."""
    # Four groups of digits with one dot between each; a failing address is used up as a valid one is.
    chain: list[re.Match] = []
    for group in _DIGITS.finditer(text, start, end):
        if chain and not (group.start() == chain[-1].end() + 1 and text[chain[-1].end()] == "."):
            chain = []
        chain.append(group)
        if len(chain) == 4:
            if all(len(part := g[0].lstrip("0")) <= 3 and int(part or "0") <= 255 for g in chain):
                yield "ip", chain[0].start(), group.end()
            chain = []
    for m in _CARD.finditer(text, start, end):
        digits = _NOT_DIGIT.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()
    for m in _PHONE.finditer(text, start, end):
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            yield "phone", m.start(), m.end()


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by start and then kind. Spans of one kind don't overlap."""
    found: list[tuple[str, int, int]] = []
    email_end = run_end = 0
    ends = dict.fromkeys(KINDS, 0)
    for last, kind in _anchors().iter(text):
        if kind == "number":
            if last >= run_end:
                run_end = _RUN.match(text, last).end()
                found.extend(_numbers(text, last, run_end))
        elif kind == "at":
            if span := _email(text, last, email_end):
                email_end = span[1]
                found.append(("email", *span))
        elif kind == "scheme":
            if (m := _USERINFO.match(text, last + 1)) and m.start(1) >= ends["userinfo"]:
                ends["userinfo"] = m.end(1)
                found.append(("userinfo", *m.span(1)))
        elif kind in _SECRET_CUES:
            # A failing value is used up as a valid one is, so no text is read twice.
            if last >= ends["secret"] and (m := _SECRET.match(text, last + 1)):
                ends["secret"] = m.end(1)
                if _secret_valid(m[1]):
                    found.append(("secret", *m.span(1)))
        elif (m := _CUES[kind].match(text, last + 1)) and (kind != "iban" or _iban_valid(m[1])):
            kind = kind if kind in _ORDER else "account"
            if m.start(1) >= ends[kind]:
                ends[kind] = m.end(1)
                found.append((kind, *m.span(1)))
    return sorted(found, key=lambda s: (s[1], _ORDER[s[0]], s[2]))


def find_spans(docs: DataFrame) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id and ``spans`` array<struct<kind, start, end>>.

    Null and empty texts have none; repeated rows each get a row; an empty table gives an empty table; other columns are
    ignored. The time is linear in a text's length.
    """
    shared.small_batches(docs.sparkSession)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[dict(zip(("kind", "start", "end"), s)) for s in spans(text.as_py() or "")] for text in batch.column("text")]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(find, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in found)


def base_digest(found: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(joined([s for s in found if s[0] in BASE]).encode()).hexdigest()
