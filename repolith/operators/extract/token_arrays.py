"""Tokens of a task's files as arrays of numbers, and what tokens say of each other.

Files are whole in a task, so what would be some thirty windows over wide rows is index arithmetic here. Texts are numbers in a
dictionary of the batch. Columns lie in the order of siblings (by level and place in the text), so that a token's neighbours within its bracket are
shifts of an array; they count only if they are of the same file and bracket. Rules read as over Columns: arrays have their
operators and their logic of nulls.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from repolith.operators.extract.token_table import Words, dealt

#: Characters of the files whose tokens are looked at together; a larger file is alone.
BATCH_CHARS = 300_000
#: Rows of one kind and the types of their columns, as far as these analyzers fill them.
COMPONENT = {
    "id": pa.string(), "name": pa.string(), "component_type": pa.string(), "start_line": pa.int32(), "end_line": pa.int32(), "docstring": pa.string(), "parameters": pa.list_(pa.string()),
    "base_classes": pa.list_(pa.string()), "source_code": pa.string(),
}
EDGE = {"caller": pa.string(), "callee": pa.string(), "call_line": pa.int32(), "is_resolved": pa.bool_()}
FIELDS = {"component": COMPONENT, "edge": EDGE}


class Col:
    """An array with a Column's operators. ``ok`` says where it isn't null (None: everywhere); truth values that are null hold False.
    ``words``: the dictionary that texts are numbers in."""

    __slots__ = ("x", "ok", "words")

    def __init__(self, x, ok=None, words: Words | None = None):
        self.x, self.ok, self.words = x, ok, words

    @property
    def array(self) -> pa.Array:
        null = None if self.ok is None else ~self.ok
        return pa.array(self.x, mask=null) if self.words is None else self.words.spelled(self.x, null)

    def _compared(self, operator, other) -> Col:
        x, ok = _operand(other, self.words)
        found, ok = operator(self.x, x), _both(self.ok, ok)
        return Col(found if ok is None else found & ok, ok)

    def __eq__(self, other):
        return self._compared(np.equal, other)

    def __ne__(self, other):
        return self._compared(np.not_equal, other)

    def __gt__(self, other):
        return self._compared(np.greater, other)

    def __lt__(self, other):
        return self._compared(np.less, other)

    def __ge__(self, other):
        return self._compared(np.greater_equal, other)

    def __add__(self, other):
        x, ok = _operand(other, None)
        return Col(self.x + x, _both(self.ok, ok))

    def __sub__(self, other):
        x, ok = _operand(other, None)
        return Col(self.x - x, _both(self.ok, ok))

    def __and__(self, other):
        if self.ok is None and other.ok is None:
            return Col(self.x & other.x)
        # False with a null is False.
        no = [~c.x if c.ok is None else ~c.x & c.ok for c in (self, other)]
        both = _both(self.ok, other.ok)
        return Col(self.x & other.x, both | no[0] | no[1])

    def __or__(self, other):
        found = self.x | other.x
        return Col(found, None if self.ok is None and other.ok is None else _both(self.ok, other.ok) | found)

    def __invert__(self):
        return Col(~self.x if self.ok is None else ~self.x & self.ok, self.ok)

    def _looked_up(self, table: np.ndarray) -> Col:
        found = table.take(self.x)
        return Col(found if self.ok is None else found & self.ok, self.ok)

    def isin(self, *values: str):
        table = np.zeros(len(self.words), bool)
        table[[self.words[v] for v in values if v in self.words]] = True
        return self._looked_up(table)

    def startswith(self, prefix: str):
        return self._looked_up(np.array([w.startswith(prefix) for w in self.words.list], bool))

    def isNull(self):
        return Col(np.zeros(np.shape(self.x), bool) if self.ok is None else ~self.ok)

    def isNotNull(self):
        return Col(np.ones(np.shape(self.x), bool) if self.ok is None else self.ok)

    def take(self, at: np.ndarray) -> Col:
        """The elements at these places; null below 0."""
        there = at >= 0
        there = there if self.ok is None else there & self.ok.take(at)
        x = self.x.take(at)
        return Col(x & there if x.dtype == bool else x, there, self.words)

    def true(self) -> np.ndarray:
        return self.x

    def filled(self, value) -> np.ndarray:
        return self.x if self.ok is None else np.where(self.ok, self.x, value)


class Struct:
    """Named arrays that are null together, each computed when it is asked for; ``_`` says where there is one."""

    def __init__(self, names: Iterable[str], of: Callable[[str], Col], places: np.ndarray | None = None):
        self.names, self.of, self.places, self.known = tuple(names), of, places, {}

    def __getitem__(self, name: str) -> Col:
        if name not in self.known:
            self.known[name] = self.of(name) if self.places is None else self.of(name).take(self.places)
        return self.known[name]

    def isNotNull(self):
        return self["_"].isNotNull()

    def isNull(self):
        return self["_"].isNull()

    def take(self, at: np.ndarray) -> Struct:
        if self.places is None:
            return Struct(self.names, self.__getitem__, at)
        return Struct(self.names, self.of, np.where(at >= 0, self.places.take(at), -1))


def _both(a, b):
    return a if b is None else b if a is None else a & b


def _operand(other, words: Words | None):
    """(values, where they aren't null) of a column or plain value; a text that no token has is -1."""
    other = other.value if isinstance(other, When) else other
    if isinstance(other, Col):
        return other.x, other.ok
    return (words.get(other, -1) if isinstance(other, str) else other), None


def _pick(condition: Col, yes, no):
    """``yes`` where the condition holds, ``no`` where it doesn't or is null; None is null."""
    yes, no = (x.value if isinstance(x, When) else x for x in (yes, no))
    if isinstance(yes, Struct) or isinstance(no, Struct):
        return Struct((yes if isinstance(yes, Struct) else no).names, lambda n: _pick(condition, None if yes is None else yes[n], None if no is None else no[n]))
    held = condition.x
    words = next((x.words for x in (yes, no) if isinstance(x, Col) and x.words is not None), None)
    (a, a_ok), (b, b_ok) = ((None, False) if x is None else (words[x], None) if isinstance(x, str) else _operand(x, words) for x in (yes, no))
    if a is None or b is None:
        there = held if b is None else ~held
        value, ok = (b, b_ok) if a is None else (a, a_ok)
        value = np.broadcast_to(value, np.shape(held))
        ok = there if ok is None else there & ok
        return Col(value & ok if value.dtype == bool else value, ok, words)
    ok = None if a_ok is None and b_ok is None else _chosen(held, True if a_ok is None else a_ok, True if b_ok is None else b_ok)
    return Col(_chosen(held, a, b), ok, words)


def _chosen(held: np.ndarray, a, b) -> np.ndarray:
    if isinstance(a, bool) or getattr(a, "dtype", None) == bool:
        return (held & a) | (~held & b)
    return np.where(held, a, b)


class When:
    """``when(a, x).when(b, y).otherwise(z)``; ``value`` is null where none holds."""

    def __init__(self, condition: Col, value, branches=()):
        self.branches = (*branches, (condition, value))

    def when(self, condition: Col, value) -> When:
        return When(condition, value, self.branches)

    def otherwise(self, value):
        return reduce(lambda out, b: _pick(b[0], b[1], out), reversed(self.branches), value)

    @property
    def value(self):
        return self.otherwise(None)


when = When


def coalesce(*values):
    """Of numbers and texts; a plain value last."""
    first, *rest = (v.value if isinstance(v, When) else v for v in values)
    return first if first.ok is None or not rest else _pick(Col(first.ok), first, coalesce(*rest) if isinstance(rest[0], Col) else rest[0])


def lower(x: Col) -> Col:
    table = np.array([x.words[w.lower()] for w in list(x.words.list)], np.int32)
    return Col(table.take(x.x), x.ok, x.words)


def any_of(*conditions: Col) -> Col:
    return Col(reduce(np.bitwise_or, (c.x for c in conditions)))


def _changes(*keys: np.ndarray) -> np.ndarray:
    """The number of the group of equal neighbours that each place is in."""
    new = np.zeros(len(keys[0]), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


def _stable(keys: np.ndarray) -> np.ndarray:
    """The stable order of numbers that are small for most files: counted then, sorted otherwise."""
    small = len(keys) and -32768 <= keys.min() and keys.max() <= 32767
    return np.argsort(keys.astype(np.int16) if small else keys, kind="stable")


def within(group: np.ndarray, first: np.ndarray, after: np.ndarray) -> np.ndarray:
    """For each row the number of the innermost interval around it; -1 outside all. Interval k goes from row ``first[k]`` (rising) to the row before ``after[k]``; it
    lies within the rows of one ``group`` and is nested in others."""
    size = len(group)
    # From one row where an interval begins or has ended to the next nothing changes.
    rows = np.unique(np.concatenate([first, after[after < size]]))
    nesting = np.searchsorted(first, rows, side="right") - np.searchsorted(np.sort(after), rows, side="right")
    number = np.full(len(rows), -1)
    number[np.searchsorted(rows, first)] = np.arange(len(first))
    # The intervals of a nesting come one after the other, so the last one that began holds the row.
    order = _stable(nesting)
    found = _last_true(number[order] >= 0)
    start = order.take(found)
    held = (found >= 0) & (nesting[order] > 0) & (nesting[start] == nesting[order]) & (group[rows[start]] == group[rows[order]])
    out = np.full(len(rows), -1)
    out[order[held]] = number[start[held]]
    return np.repeat(np.concatenate([[-1], out]), np.diff(np.concatenate([[0], rows, [size]])))


def _last_true(held: np.ndarray, after: int = 0) -> np.ndarray:
    """For each place the last one up to it (with ``after``: before it) that is true; -1 for none."""
    at = np.flatnonzero(held)
    return np.repeat(np.concatenate([[-1], at]), np.diff(np.concatenate([[0], np.minimum(at + after, len(held)), [len(held)]])))


def _next_true(held: np.ndarray) -> np.ndarray:
    """For each place the first one after it that is true; -1 for none."""
    at = np.flatnonzero(held)
    return np.repeat(np.concatenate([at, [-1]]), np.diff(np.concatenate([[0], at, [len(held)]])))


class Rows:
    """Columns of one length."""

    size: int
    words: Words

    def every(self, value) -> Col:
        text = isinstance(value, str)
        return Col(np.broadcast_to(np.int32(self.words[value]) if text else np.array(value), self.size), words=self.words if text else None)

    def none(self) -> Col:
        """Numbers that are null."""
        return Col(np.broadcast_to(np.int32(0), self.size), np.zeros(self.size, bool))

    def struct(self, **fields) -> Struct:
        fields["_"] = Col(np.broadcast_to(True, self.size))
        return Struct(fields, fields.__getitem__)


class View(Rows):
    """Some tokens: what only they can be is looked at in columns of theirs."""

    def __init__(self, tokens: Tokens, held: Col):
        self.tokens, self.words, self.at, self.known = tokens, tokens.words, np.flatnonzero(held.true()), {}
        self.size = len(self.at)

    def col(self, name: str):
        if name not in self.known:
            self.known[name] = self.tokens.col(name).take(self.at)
        return self.known[name]

    def of(self, value):
        return value.take(self.at)

    def spread(self, value):
        """As a column of all tokens, null for the others."""
        if isinstance(value, Struct):
            return Struct(value.names, lambda n: self.spread(value[n]))
        x, ok = np.zeros(self.tokens.size, value.x.dtype), np.zeros(self.tokens.size, bool)
        x[self.at], ok[self.at] = value.x, True if value.ok is None else value.ok
        return Col(x, ok, value.words)


class Tokens(Rows):
    """The tokens of files, in the order of siblings. ``file`` counts the files of the batch; numbers such as ``i`` and ``up`` count a file's tokens."""

    def __init__(self, contents: list[str], scripts: bool):
        words = self.words = Words(scripts)
        lists = [words.cut(content) for content in contents]
        lengths = np.array([len(x) for x in lists], np.int64)
        codes = np.concatenate([np.zeros(0, np.int32), *lists])
        kind, text, breaks = (np.array(x, np.int32) for x in (words.kinds, words.texts, words.breaks))
        ends = np.cumsum(lengths)
        keep = (kind >= 0).take(codes)
        kept, broken = (np.concatenate([[0], np.cumsum(x)]) for x in (keep, breaks.take(codes)))
        codes, sizes = codes[keep], kept[ends] - kept[ends - lengths]
        size, starts = len(codes), np.cumsum(sizes) - sizes
        self.size = size
        file = self.file = np.repeat(np.arange(len(sizes)), sizes)
        start = np.repeat(starts, sizes)
        lines = broken[:-1][keep] - np.repeat(broken[ends - lengths], sizes) + 1
        kind, text = kind.take(codes), text.take(codes)
        is_open, is_close = kind == words["o"], kind == words["c"]
        balance = np.concatenate([[0], np.cumsum(is_open.astype(np.int8) - is_close, dtype=np.int64)])
        balance = balance[1:] - np.repeat(balance[starts], sizes)
        if (balance < 0).any():
            # Closing brackets without a partner are where a file's balance is lower than ever before.
            base = file * -(size + 1)
            lowest = np.minimum.accumulate(np.minimum(balance, 0) + base)
            alone = is_close & (lowest < np.where(np.arange(size) == start, base, np.roll(lowest, 1)))
            kind[alone], is_close = words["p"], is_close & ~alone
            balance -= lowest - base
        level = balance - is_open
        # A level's brackets come one after the other; the first token in one follows what opens it, and next to that at its level is what closes it.
        order = _stable(level)
        ordered, before = file.take(order), order - 1
        opened = np.where(is_open.take(before) & (order > start.take(order)) & (level.take(before) < level.take(order)), before, -1) if size else order
        new = (opened >= 0) | (np.diff(ordered, prepend=-1) != 0) | (np.diff(level.take(order), prepend=-1) != 0)
        around = np.empty(size, np.int64)
        around[order] = opened.take(_last_true(new))
        ends = starts + sizes - 1
        at = np.flatnonzero(is_open.take(order))
        opener, after = order[at], order[np.minimum(at + 1, size - 1)]
        closed = (at + 1 < size) & is_close[after] & (around[after] == around[opener]) & (file[after] == file[opener])
        ending = np.where(closed, after, ends[file[opener]])
        close, last = np.zeros(size, np.int64), np.zeros(size, np.int64)
        close[opener], last[opener] = ending, lines[ending - closed]
        noted = kind == words["d"]
        if noted.any():
            # Comments that name types are siblings of nothing.
            order = _stable(np.where(noted, level.max() + 1, level))
        #: Tokens in the order of siblings, and the place of each.
        self.order, self.place = order, np.empty(size, np.int64)
        self.place[order] = np.arange(size)
        self.token_file, self.starts, self.ends = file, starts, ends
        self.file, self.start = file.take(order), start.take(order)
        self.group = _changes(self.file, (np.where(noted, size + np.arange(size), around) if noted.any() else around).take(order))
        self.first = np.searchsorted(self.group, self.group)
        around = around.take(order)
        self.around = np.where(around >= 0, self.place.take(around), -1) if size else around
        numbers = lambda x, ok=None: Col((x - self.start).astype(np.int32), ok)
        opens = is_open.take(order)
        self.columns: dict[str, Col | Struct] = {
            "i": numbers(order), "text": Col(text.take(order), words=words), "kind": Col(kind.take(order), words=words), "line": Col(lines.take(order).astype(np.int32)), "close": numbers(close.take(order), opens),
            "last": Col(last.take(order).astype(np.int32), opens), "up": Col(np.where(around >= 0, around - self.start, -1).astype(np.int32)),
        }
        self.codes = codes[order]
        self.within_shift: dict[int, np.ndarray] = {}
        self.columns["around"] = self.struct(**{n: self.columns[n] for n in ("text", "close", "line", "last")}).take(self.around)
        self.levels: tuple[np.ndarray, np.ndarray] | None = None

    def col(self, name: str):
        head, _, rest = name.partition(".")
        return self.columns[head][rest] if rest else self.columns[head]

    def view(self, held: Col) -> View:
        return View(self, held)

    def put(self, columns: dict) -> None:
        """Plain values are those of every token."""
        columns = {k: v.value if isinstance(v, When) else v for k, v in columns.items()}
        self.columns |= {k: v if isinstance(v, (Col, Struct)) else self.every(v) for k, v in columns.items()}

    def shifted(self, column: str, k: int, fill: int | None = None):
        """``column`` of the k-th sibling after (below 0: before); ``fill`` (else null) where there is none."""
        v = self.columns[column]
        if isinstance(v, Struct):
            raise TypeError(f"{column}: fields are shifted one by one")
        here, there = (slice(k, None), slice(None, -k)) if k > 0 else (slice(None, k), slice(-k, None))
        if k not in self.within_shift:
            inside = self.within_shift[k] = np.zeros(self.size, bool)
            inside[there] = self.group[here] == self.group[there]
        inside = self.within_shift[k]

        def moved(x):
            out = np.zeros(x.shape, x.dtype)
            out[there] = x[here]
            return out

        if fill is not None:
            return Col(np.where(inside, moved(v.x), np.int32(fill)), None, v.words)
        ok = inside if v.ok is None else inside & moved(v.ok)
        return Col(moved(v.x) & ok if v.x.dtype == bool else moved(v.x), ok, v.words)

    def back(self, column: str, k: int = 1):
        """``column`` of the k-th sibling before."""
        return self.shifted(column, -k)

    def ahead(self, column: str, k: int = 1):
        return self.shifted(column, k)

    def _last(self, condition: Col, value, after: int):
        found = _last_true(condition.true(), after)
        return value.take(np.where(found >= self.first, found, -1))

    def last_so_far(self, condition: Col, value):
        """``value`` of the last sibling up to this one where the condition holds."""
        return self._last(condition, value, 0)

    def last_before(self, condition: Col, value):
        return self._last(condition, value, 1)

    def first_after(self, condition: Col, value):
        """Of the siblings after this one."""
        return value.take(self._next(condition.true(), self.group))

    def _next(self, held: np.ndarray, group: np.ndarray) -> np.ndarray:
        found = _next_true(held)
        return np.where(group.take(found) == group, found, -1) if self.size else found

    def first_after_at_level(self, condition: Col, value):
        """Of the siblings after this one with the same ``angle``."""
        if self.levels is None:
            angle = self.columns["angle"].x
            order = _stable(angle)
            self.levels = order, _changes(angle[order], self.group[order])
        order, group = self.levels
        found = self._next(condition.true().take(order), group)
        out = np.empty(self.size, np.int64)
        out[order] = np.where(found >= 0, order[found], -1)
        return value.take(out)

    def enclosing(self, info):
        """``info`` of the bracket that each token stands in; null outside all brackets."""
        return info.take(self.around)

    def last_of_file(self, column: str) -> Col:
        return self.columns[column].take(self.place[self.ends[self.file]])

    def following(self, column: str) -> Col:
        """Of the next token of the file."""
        after = self.order + 1
        inside = after <= self.ends[self.file]
        return self.columns[column].take(np.where(inside, self.place[np.where(inside, after, 0)], -1))

    def open_before(self, changes: Col) -> Col:
        """Whether the sum of ``changes`` over the file's tokens before this one is above 0."""
        values = changes.x[self.place]
        total = np.cumsum(values) - values
        return Col((total - total[self.starts[self.token_file]] > 0)[self.order] if self.size else total > 0)

    def neighbours(self, before: int, after: int) -> None:
        """Siblings' texts p1, p2, ... and n1, n2, ..., empty beyond the bracket; pk1, nk1 kinds, pi1, ni1 numbers, pl1, nl1, nl2, nl4 lines,
        nc1 to nc4 where they close; ``angle``: how many angle brackets are open among the siblings so far."""
        none = self.words[""]
        self.put({f"p{k}": self.shifted("text", -k, none) for k in range(1, before + 1)} | {f"n{k}": self.shifted("text", k, none) for k in range(1, after + 1)})
        self.put({"pk1": self.back("kind"), "nk1": self.ahead("kind"), "pi1": self.back("i"), "pi2": self.back("i", 2), "ni1": self.ahead("i"), "pl1": self.back("line"), "pl2": self.back("line", 2)})
        self.put({f"nl{k}": self.ahead("line", k) for k in (1, 2, 4)} | {f"nc{k}": self.ahead("close", k) for k in range(1, 5)})
        text = self.columns["text"]
        delta = (text == "<").x.astype(np.int32) - (text == ">").x
        total = np.cumsum(delta)
        self.put({"angle": Col((total - (total - delta)[self.first]).astype(np.int32))})

    def placed(self, number: Col) -> np.ndarray:
        """The places of tokens of these numbers, in the files of the tokens; -1 for those below 0 and nulls."""
        numbers = number.filled(-1)
        return np.where(numbers >= 0, self.place[self.start + np.maximum(numbers, 0)], -1)

    def same_name(self, held: Col, name: Col) -> tuple[np.ndarray, np.ndarray]:
        """The places of the first and the last token of the file that hold the same name, by token; -1 where none is held."""
        at = np.flatnonzero(held.true())
        first, last = np.full(self.size, -1), np.full(self.size, -1)
        order = np.lexsort((self.order[at], name.x[at], self.file[at]))
        group = _changes(self.file[at][order], name.x[at][order]) if len(at) else order
        first[at[order]] = at[order][np.searchsorted(group, group)]
        last[at[order]] = at[order][np.searchsorted(group, group, side="right") - 1]
        return first, last

    def spelled(self, held: Col, start: Col, most: int = 64) -> Col:
        """Texts of the siblings from number ``start`` to this one, joined, where it is held; of longer chains the last ones."""
        at = np.flatnonzero(held.true())
        first = self.place[self.start[at] + start.x[at]]
        text = self.columns["text"].x
        out, ok = text.copy(), held.true()
        more = first < at
        for z, a in zip(at[more].tolist(), first[more].tolist()):
            out[z] = self.words["".join([self.words.list[k] for k in text[max(a, z - most + 1) : z + 1].tolist()])]
        return Col(out, ok, self.words)

    def innermost(self, start: Col, end: Col, info):
        """``info`` of the innermost interval around each token, of those from tokens where ``start`` holds to the token number ``end``;
        null outside all. Intervals must be nested; a start is within its own."""
        at = np.flatnonzero((start & end.isNotNull()).true())
        at = at[np.argsort(self.order[at])]
        found = within(self.token_file, self.order[at], self.start[at] + end.x[at] + 1)
        return info.take(np.concatenate([at, [-1]]).take(found.take(self.order)))


def joined(t: Tokens, a: Col, b: Col, separator: str, where: Col) -> Col:
    """Both texts where it holds and neither is null."""
    held = where.true() & a.isNotNull().x & b.isNotNull().x
    out, spelled = np.zeros(t.size, np.int32), t.words.list
    at = np.flatnonzero(held)
    out[at] = [t.words[f"{spelled[x]}{separator}{spelled[y]}"] for x, y in zip(a.x[at].tolist(), b.x[at].tolist())]
    return Col(out, held, t.words)


def stacked(t: Tokens, rows: list[tuple[Col, dict]]) -> dict[str, np.ndarray]:
    """The fields of the tokens where each condition holds, one after the other; nulls are -1, ``at`` is the place and ``file`` its file."""
    places = [np.flatnonzero(any_of(held).true()) for held, _ in rows]
    out = {"at": np.concatenate(places)}
    for n in rows[0][1]:
        values = [(fields[n], at) for (_, fields), at in zip(rows, places)]
        out[n] = np.concatenate([v.take(at).filled(-1) if isinstance(v, Col) else np.full(len(at), v) for v, at in values]).astype(np.int64)
    return out | {"file": t.file[out["at"]]}


def first_edges(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Of the rows of one file, caller, callee and line the one with the least ``emit``; resolved if one of them is."""
    order = np.lexsort([rows[n] for n in ("emit", "line", "callee", "caller", "file")])
    rows = {n: v[order] for n, v in rows.items()}
    first = np.flatnonzero(np.diff(_changes(*(rows[n] for n in ("file", "caller", "callee", "line"))), prepend=-1)) if len(order) else order
    resolved = np.maximum.reduceat(rows["resolved"], first) if len(first) else first
    return {n: v[first] for n, v in rows.items()} | {"resolved": resolved.astype(bool)}


def listed(t: Tokens, held: Col, of: np.ndarray, wanted: np.ndarray, null: Callable[[np.ndarray], np.ndarray]) -> pa.Array:
    """For each of the places ``wanted`` the texts of the tokens where ``held`` is true that belong to it (``of``: their place), in order; ``null`` says of the
    numbers of texts where there is no list."""
    at = np.flatnonzero(held.true())
    at = at[np.argsort(of[at], kind="stable")]
    low, high = (np.searchsorted(of[at], wanted, side=side) for side in ("left", "right"))
    sizes = high - low
    ends = np.cumsum(sizes)
    rows = np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - (ends - sizes), sizes)
    offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
    return pa.ListArray.from_arrays(offsets, t.words.spelled(t.columns["text"].x[at[rows]], None), mask=pa.array(null(sizes), pa.bool_()))


def spelled(t: Tokens, numbers: np.ndarray) -> pa.Array:
    return t.words.spelled(np.maximum(numbers, 0), numbers < 0)


def lines(numbers: np.ndarray) -> pa.Array:
    return pa.array(numbers, mask=numbers < 0)


#: The tokens of a batch and the kinds of rows wanted, to columns of each kind; names are without their module.
Find = Callable[[Tokens, tuple[str, ...]], dict[str, dict]]


def rows(files: DataFrame, scripts: bool, find: Find, kinds: tuple[str, ...]) -> DataFrame:
    """What ``find`` sees in the tokens of ``files`` (file_ord, path, module, content), as rows of ``kinds``. The columns ``id``, ``caller`` and ``callee`` of ``find``
    get the module of the file before them, ``plain`` callees don't."""
    fields = {"file_ord": pa.int64(), "emit_ord": pa.int64(), "kind": pa.string(), "file_path": pa.string()} | {n: k for kind in kinds for n, k in FIELDS[kind].items()}

    def found(batch: list[tuple]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens([c for *_, c in batch], scripts)
        if not tokens.size:
            return
        ords, paths, modules = (pa.array(list(x), k) for x, k in zip(list(zip(*batch))[:3], (pa.int64(), pa.string(), pa.string())))
        for kind, columns in find(tokens, kinds).items():
            file, size = columns.pop("file"), len(columns["emit_ord"])
            at = pa.array(file)
            module = modules.take(at)
            named = lambda x: pc.binary_join_element_wise(module, x, ".", null_handling="skip")
            if kind == "component":
                columns |= {"id": named(columns["name"]), "source_code": _code(batch, file, columns["start_line"], columns["end_line"]), "docstring": pa.repeat("", size)}
            else:
                plain = columns.pop("plain", None)
                whole = named(columns["callee"])
                columns |= {"caller": named(columns["caller"]), "callee": whole if plain is None else pc.if_else(pa.array(plain), columns["callee"], whole)}
            columns |= {"file_ord": ords.take(at), "file_path": paths.take(at), "kind": pa.repeat(kind, size)}
            out = [columns[n] if n in columns else pa.nulls(size, k) for n, k in fields.items()]
            yield pa.RecordBatch.from_arrays([(x if isinstance(x, pa.Array) else pa.array(x)).cast(k) for x, k in zip(out, fields.values())], list(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chars = [], 0
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                held.append((*row[:3], row[3] or ""))
                chars += len(held[-1][3])
                if chars >= BATCH_CHARS:
                    yield from found(held)
                    held, chars = [], 0
        yield from found(held)

    names = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.bool_(): "boolean", pa.list_(pa.string()): "array<string>"}
    return dealt(files.select("file_ord", "path", "module", "content")).mapInArrow(run, ", ".join(f"{n} {names[k]}" for n, k in fields.items()))


def _code(batch: list[tuple], file: np.ndarray, first: pa.Array, last: pa.Array) -> pa.Array:
    lines = {f: batch[f][3].split("\n") for f in set(file.tolist())}
    return pa.array(["\n".join(lines[f][a - 1 : z]) for f, a, z in zip(file.tolist(), first.to_pylist(), last.to_pylist())], pa.string())
