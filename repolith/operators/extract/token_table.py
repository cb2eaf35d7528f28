"""Source files as tables of tokens, and what tokens say of each other, by windows.

A token row knows the bracket that it stands in (``up``), its ``level`` and, if it opens one, where that closes. Tokens with
the same ``up`` are siblings: in their order a whole bracket is two neighbours, so a rule such as "a name, parentheses,
a brace" looks at a fixed number of rows, however much the brackets hold. Nested intervals need no search: a running count
of starts less ends is a row's nesting, and the last start at that nesting is the innermost interval around it. All windows are
by file, so files are dealt to tasks once; time is that of sorting tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolith.operators.extract.braces import doc_types

TOKEN = "struct<i:int,text:string,kind:string,line:int,at:int,ends:int,up:int,level:int,close:int,types:array<string>,around:struct<text:string,close:int,line:int,last:int>>"
_KIND = pa.list_(pa.struct([
    ("i", pa.int32()), ("text", pa.string()), ("kind", pa.string()), ("line", pa.int32()), ("at", pa.int32()), ("ends", pa.int32()), ("up", pa.int32()), ("level", pa.int32()),
    ("close", pa.int32()), ("types", pa.list_(pa.string())),
    ("around", pa.struct([("text", pa.string()), ("close", pa.int32()), ("line", pa.int32()), ("last", pa.int32())])),
]))

#: Every alternative is decided by its first letters and none looks back, so time is linear in the text.
_LEX = re.compile(
    r"(?P<space>\s+)|(?P<comment>//[^\n]*|/\*(?:[^*]|\*(?!/))*+(?:\*/|\Z))|(?P<string>\"\"\"[\s\S]*?(?:\"\"\"|\Z)|\"(?:\\[\s\S]|[^\"\\\n])*+\"?|'(?:\\[\s\S]|[^'\\\n])*+'?)"
    r"|(?P<word>[^\W\d][\w$]*|[$#][\w$]*)|(?P<number>\d[\w.]*)|(?P<sign>=>|->|\?\.|\.\.\.|::|[\s\S])"
)
_TEMPLATE = re.compile(r"(?:\\[\s\S]?|\$(?!\{)|[^`\\$])*+(?:`|\$\{|\Z)")
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*+\]?|[^/\\\[\n])++/?\w*")
_VALUE_WORDS = frozenset("return typeof case in of delete void throw new else do await yield instanceof".split())
_OPEN, _CLOSE = "([{", ")]}"


def lexed_columns(content: str, scripts: bool) -> dict[str, list]:
    """Tokens without comments but for those that name types (``types``, kind d), as lists: text, kind, at, ends, up, and for brackets close. Kinds are
    w (word), n and s (literals, spelled 0 and "), p (sign), o and c (brackets). ``scripts``: templates, whose substitutions are code in
    braces, and regular expressions. Brackets that don't close end with the text; closing ones without a partner are signs."""
    texts, kinds, starts, ends, ups, closes, types = [], [], [], [], [], [], {}
    stack: list[int] = []
    templates: set[int] = set()
    at, size, up, value = 0, len(content), -1, False
    match = _LEX.match

    def put(kind: str, text: str, start: int, end: int) -> None:
        texts.append(text)
        kinds.append(kind)
        starts.append(start)
        ends.append(end)
        ups.append(up)
        closes.append(None)

    def template(start: int, shown: int) -> int:
        """The rest of a template from ``start``; a substitution opens a brace."""
        nonlocal up, value
        end = _TEMPLATE.match(content, start).end()
        opens = content.startswith("${", end - 2) and end - 2 >= start
        put("s", "`", shown, end - 2 * opens)
        value = not opens
        if opens:
            put("o", "{", end - 2, end)
            up = len(texts) - 1
            stack.append(up)
            templates.add(up)
        return end

    while at < size:
        if scripts:
            # ``value``: what stands before ends a value, so that a slash divides.
            first = content[at]
            if first == "/" and not value and content[at + 1 : at + 2] not in ("/", "*"):
                m = _REGEX.match(content, at)
                end = m.end() if m else at + 1
                put("s" if m else "p", '"' if m else "/", at, end)
                at, value = end, bool(m)
                continue
            if first == "`":
                at = template(at + 1, at)
                continue
        m = match(content, at)
        end, kind = m.end(), m.lastgroup
        if kind == "word":
            text = m[0]
            put("w", text, at, end)
            value = text not in _VALUE_WORDS
        elif kind == "sign":
            text = m[0]
            if text in _OPEN:
                put("o", text, at, end)
                up = len(texts) - 1
                stack.append(up)
                value = False
            elif text in _CLOSE and stack:
                opener = stack.pop()
                closes[opener] = len(texts)
                up = stack[-1] if stack else -1
                put("c", text, at, end)
                value = True
                if opener in templates:
                    at = template(end, end)
                    continue
            else:
                put("p", text, at, end)
                value = False
        elif kind == "comment":
            if scripts and (named := doc_types(m[0])):
                types[len(texts)] = named
                put("d", "", at, end)
        elif kind != "space":
            put("n" if kind == "number" else "s", "0" if kind == "number" else '"', at, end)
            value = True
        at = end
    for opener in stack:
        closes[opener] = len(texts) - 1
    return {"text": texts, "kind": kinds, "at": starts, "ends": ends, "up": ups, "close": closes, "types": [types.get(i) for i in range(len(texts))] if types else [None] * len(texts)}


# Tokens as pieces: a file is cut by one expression, in which a value takes the slash that divides it with it, so that no state is needed
# outside templates; what a piece is, is looked up once for each spelling.
def _piece(scripts: bool, plain: bool, end: str = "") -> re.Pattern:
    """``plain``: the same for ASCII, spelled so that letters are looked up in a table. ``end``: what a backslash may stand before, besides a character."""
    first, word, space, digit = ("[A-Za-z_]", "A-Za-z0-9_", r" \t-\r\x1c-\x1f", "0-9") if plain else (r"[^\W\d]", r"\w", r"\s", r"\d")
    comment = r"//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+(?:\*/|\Z)"
    string = rf"\"\"\"[\s\S]*?(?:\"\"\"|\Z)|\"(?:[^\"\\\n]++|\\(?:[\s\S]{end}))*+\"?|'(?:[^'\\\n]++|\\(?:[\s\S]{end}))*+'?"
    signs = r"=>|->|\?\.|\.\.\.|::|[\s\S]"
    if not scripts:
        return re.compile(rf"[{space}]++|{first}[{word}$]*+|[()\[\]{{}};,<>!&|+*%^~@]|[$#][{word}$]*+|[{digit}][{word}.]*+|{comment}|{string}|{signs}")
    divided = rf"(?:(?=[{space}]*+/)(?:[{space}]++|{comment})*+/(?![/*])|)"
    values, regex = "|".join(sorted(_VALUE_WORDS)), rf"/(?:[^/\\\[\n]++|\\(?:.{end})|\[(?:[^\]\\\n]++|\\(?:.{end}))*+\]?)++/?\w*"
    return re.compile(
        rf"[{space}]++|[(\[{{;,<>!&|+*%^~@]|(?:{values})(?![{word}$])|{first}[{word}$]*+{divided}|[)\]}}]{divided}|[$#][{word}$]*+{divided}|[{digit}][{word}.]*+{divided}|{comment}"
        rf"|(?:{string}){divided}|(?:{regex}){divided}|{signs}"
    )


# Before a backtick that may stand in a string, and to the end of the text.
_SCRIPT_PART, _SCRIPT, _PIECE = ([_piece(scripts, plain, end) for plain in (False, True)] for scripts, end in ((True, r"|\Z"), (True, ""), (False, "")))
_VALUE = re.compile(rf"\"\"\"[\s\S]*?(?:\"\"\"|\Z)|\"(?:\\[\s\S]|[^\"\\\n])*+\"?|'(?:\\[\s\S]|[^'\\\n])*+'?|{_REGEX.pattern}|[$#\w][\w$.]*|[\s\S]")
_GAP = re.compile(r"(?:\s++|//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+(?:\*/|\Z))*+")
_AFTER_VALUE = re.compile(rf"({_GAP.pattern})/(?![/*])")


class Words(dict):
    """Numbers of pieces, and for each the number of its kind (-1: not a token; else as in :func:`lexed_columns`), that of the token's text, and its line breaks."""

    def __init__(self, scripts: bool):
        self.scripts = scripts
        self.list, self.kinds, self.texts, self.breaks, self.types = [], [], [], [], {}
        self.divided: set[int] = set()

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self.list)
        self.list.append(piece)
        self.texts.append(number)
        if piece.isidentifier():
            self.breaks.append(0)
            self.kinds.append(-1)
            self.kinds[number] = self["w"]
            return number
        self.kinds.append(-1)
        self.breaks.append(piece.count("\n"))
        kind, text = self._class(piece, number)
        if kind:
            self.kinds[number] = self[kind]
        if text is not None:
            self.texts[number] = self[text]
        return number

    def _class(self, piece: str, number: int) -> tuple[str | None, str | None]:
        first = piece[:1]
        if first.isspace() or not piece:
            return None, None
        comment = piece.startswith(("//", "/*"))
        if self.scripts and piece[-1] == "/" and not comment and first != "`" and _VALUE.match(piece)[0] != piece:
            self.divided.add(number)
        if comment:
            if self.scripts and (named := doc_types(piece)):
                self.types[number] = named
                return "d", ""
            return None, None
        if first in _OPEN or piece == "${":
            return "o", first if first in _OPEN else "{"
        if first in _CLOSE:
            return "c", first
        if first in "\"'" or (self.scripts and first == "/" and len(piece) > 1):
            return "s", '"'
        if self.scripts and first == "`":
            return "s", "`"
        if first in "$#" or ((first.isalnum() or first == "_") and not first.isdecimal()):
            return "w", None
        return ("n", "0") if first.isdecimal() else ("p", None)

    def cut(self, content: str) -> np.ndarray:
        """``content`` as numbers of pieces: the tokens of :func:`lexed_columns`, some times as fast, and what stands between them. Of a template, text begins
        with a backtick and substitutions are code between ``${`` and a closing bracket."""
        cut = _script_pieces(content) if self.scripts else _PIECE[content.isascii()].findall(content)
        found = np.fromiter(map(self.__getitem__, cut), np.int32, len(cut))
        if self.divided and not self.divided.isdisjoint(found.tolist()):
            cut = self._divided(content, found.tolist())
            found = np.fromiter(map(self.__getitem__, cut), np.int32, len(cut))
        return found

    def _divided(self, content: str, found: list[int]) -> list[str]:
        out, balance = [], 0
        for number in found:
            piece = self.list[number]
            token = _VALUE.match(piece)[0] if number in self.divided else piece
            out += [token] if token == piece else [token, *_PIECE[0].findall(piece[len(token) : -1]), "/"]
            balance += (token in ("(", "[", "{", "${")) - (token in (")", "]", "}"))
            if balance < 0:
                # A closing bracket without a partner is no value, so that a slash may begin an expression.
                return _step_by_step(content)
        return out

    def spelled(self, numbers: np.ndarray, null: np.ndarray | None) -> pa.Array:
        at = pa.array(numbers, pa.int32(), mask=null)
        return pa.DictionaryArray.from_arrays(at, pa.array(self.list, pa.string())).cast(pa.string())


def _script_pieces(content: str) -> list[str]:
    out: list[str] = []
    at, size, plain = 0, len(content), content.isascii()
    whole, part = _SCRIPT[plain], _SCRIPT_PART[plain]
    #: Brackets that are open in each open substitution.
    depths: list[int] = []
    while at < size:
        if not depths:
            tick = content.find("`", at)
            if tick < 0:
                out += whole.findall(content, at)
                break
            found = part.findall(content, at, tick)
            if found:
                last = whole.match(content, tick - len(found[-1]))
                found[-1], at = last[0], last.end()
                out += found
                if at > tick:
                    if found[-1].startswith(("//", "/*")):
                        gap = _GAP.match(content, at)[0]
                        out += _PIECE[0].findall(gap)
                        at += len(gap)
                        if content.startswith("/", at):
                            # Whether it divides is for what stands before the comment to say.
                            return _step_by_step(content)
                    continue
            at = tick + 1
        elif content[at] == "`":
            at += 1
        else:
            piece = whole.match(content, at)[0]
            if piece[0] in _CLOSE and not depths[-1]:
                depths.pop()
                out.append(piece[0])
                at += 1
            else:
                depths[-1] += (piece[0] in _OPEN) - (piece[0] in _CLOSE)
                out.append(piece)
                at += len(piece)
                continue
        # The rest of a template.
        end = _TEMPLATE.match(content, at).end()
        opens = content.startswith("${", end - 2) and end - 2 >= at
        out.append("`" + content[at : end - 2 * opens])
        at = end
        if opens:
            out.append("${")
            depths.append(0)
        elif m := _AFTER_VALUE.match(content, end):
            out += [*_PIECE[0].findall(m[1]), "/"]
            at = m.end()
    return out


def _step_by_step(content: str) -> list[str]:
    columns, out, at = lexed_columns(content, True), [], 0
    for text, kind, start, end in zip(*(columns[n] for n in ("text", "kind", "at", "ends"))):
        # Breaks within a comment are counted with it.
        out.append("\n" * content.count("\n", at, start))
        out.append({"s": '""', "d": content[start:end]}.get(kind, text) if text != "`" else text)
        at = max(at, end if kind == "d" else start)
    return out

def lines_of(content: str, columns: dict[str, list]) -> tuple[list[int], list[int | None]]:
    """(line of each token, for opening brackets that of the last token before they close)."""
    breaks = np.array([m.start() for m in re.finditer("\n", content)], np.int64)
    line = (np.searchsorted(breaks, np.array(columns["at"], np.int64)) + 1).tolist()
    return line, [None if z is None else line[z - (columns["kind"][z] == "c" and columns["up"][z] == columns["up"][i] and z > i)] for i, z in enumerate(columns["close"])]


def lexed(content: str, scripts: bool) -> list[dict]:
    """The tokens of :func:`lexed_columns` as rows of a token table."""
    columns = lexed_columns(content, scripts)
    line, last = lines_of(content, columns)
    out, levels = [], []
    for i, up in enumerate(columns["up"]):
        levels.append(levels[up] + 1 if up >= 0 else 0)
        out.append({"i": i, "line": line[i], "level": levels[i], "last": last[i]} | {k: v[i] for k, v in columns.items()})
    for token in out:
        if token["up"] >= 0:
            token["around"] = {k: out[token["up"]][k] for k in ("text", "close", "line", "last")}
    return out


def dealt(files: DataFrame) -> DataFrame:
    """``files`` dealt by file to as many tasks as the session shuffles to. A fixed number: AQE sees small rows, not the work in them."""
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file_ord")


def token_table(files: DataFrame, scripts: bool) -> DataFrame:
    """``files`` (file_ord, content) as rows (file_ord, i, text, kind, line, at, ends, up, level, close, types, around), dealt by file. ``close``: where
    an opening bracket closes; ``around``: text, close, line and last line of the bracket that a token stands in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, c in zip(batch.column("file_ord").to_pylist(), batch.column("content").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array([f], pa.int64()), pa.array([lexed(c or "", scripts)], _KIND)], ["file_ord", "tokens"])

    lists = files.select("file_ord", "content").mapInArrow(run, f"file_ord long, tokens array<{TOKEN}>")
    # A fixed number: rows of tokens are many times what AQE sees of these lists when it joins small partitions.
    return lists.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file_ord").select("file_ord", F.inline("tokens"))


def siblings(backwards: bool = False) -> Window:
    """All tokens of a file, by bracket and number. Brackets are many and small, so they share a window, and what is taken from
    other rows counts only if it is of the same bracket."""
    return Window.partitionBy("file_ord").orderBy(*[F.desc(x) if backwards else x for x in ("up", "i")])


def back(column: str, k: int = 1) -> Column:
    """``column`` of the k-th sibling before."""
    return F.when(F.lag("up", k).over(siblings()) == F.col("up"), F.lag(column, k).over(siblings()))


def ahead(column: str, k: int = 1) -> Column:
    return F.when(F.lead("up", k).over(siblings()) == F.col("up"), F.lead(column, k).over(siblings()))


def _last(condition: Column, value: Column, window: Window, *same: str) -> Column:
    """``value`` of the last row of the window where the condition holds, if it agrees with this one in ``same``."""
    found = F.last(F.when(condition, F.struct(F.struct(*same).alias("of"), value.alias("x"))), ignorenulls=True).over(window)
    return F.when(found["of"] == F.struct(*same), found["x"])


def last_so_far(condition: Column, value: Column) -> Column:
    """Of the siblings up to this one."""
    return _last(condition, value, siblings().rowsBetween(Window.unboundedPreceding, Window.currentRow), "up")


def last_before(condition: Column, value: Column) -> Column:
    return _last(condition, value, siblings().rowsBetween(Window.unboundedPreceding, -1), "up")


def first_after(condition: Column, value: Column) -> Column:
    """Of the siblings after this one, in a window of the reverse order, so that its frame only grows."""
    return _last(condition, value, siblings(backwards=True).rowsBetween(Window.unboundedPreceding, -1), "up")


def first_after_at_level(condition: Column, value: Column) -> Column:
    """Of the siblings after this one with the same ``angle``."""
    window = Window.partitionBy("file_ord").orderBy(F.desc("up"), F.desc("angle"), F.desc("i")).rowsBetween(Window.unboundedPreceding, -1)
    return _last(condition, value, window, "up", "angle")


def with_neighbours(tokens: DataFrame, before: int, after: int) -> DataFrame:
    """Siblings' texts p1, p2, ... and n1, n2, ..., empty beyond the bracket; pk1, nk1 kinds, pi1, ni1 numbers, pl1, nl1, nl2, nl4 lines,
    nc1 to nc4 where they close; ``angle``: how many angle brackets are open among the siblings so far."""
    texts = {f"p{k}": F.coalesce(back("text", k), F.lit("")) for k in range(1, before + 1)} | {f"n{k}": F.coalesce(ahead("text", k), F.lit("")) for k in range(1, after + 1)}
    more = {"pk1": back("kind"), "nk1": ahead("kind"), "pi1": back("i"), "pi2": back("i", 2), "ni1": ahead("i"), "pl1": back("line"), "pl2": back("line", 2)} | {f"nl{k}": ahead("line", k) for k in (1, 2, 4)}
    so_far = siblings().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    delta = F.when(F.col("text") == "<", 1).when(F.col("text") == ">", -1).otherwise(0)
    rows = tokens.withColumns(texts | more | {f"nc{k}": ahead("close", k) for k in range(1, 5)} | {"angles": F.sum(delta).over(so_far)})
    return rows.withColumn("angle", F.col("angles") - F.last(F.when(F.col("p1") == "", F.col("angles") - delta), ignorenulls=True).over(so_far)).drop("angles")


def with_enclosing(tokens: DataFrame, info: Column, name: str) -> DataFrame:
    """``info`` of the bracket that each token stands in, as column ``name``; null outside all brackets. An opening bracket takes part
    twice: as a token of its level, and on the level of what it holds."""
    rows = tokens.withColumn("role", F.explode(F.when(F.col("kind") == "o", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    rows = rows.withColumn("of_level", F.col("level") + F.col("role"))
    by = Window.partitionBy("file_ord").orderBy("of_level", "i", "role").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The brackets of a level come one after the other, so the last one that opened holds the token.
    return rows.withColumn(name, F.when(F.col("level") > 0, _last(F.col("role") == 1, info, by, "of_level"))).filter("role = 0").drop("role", "of_level")


def with_innermost(tokens: DataFrame, start: Column, end: Column, info: Column, name: str, among: tuple[str, ...] = ()) -> DataFrame:
    """``info`` of the innermost interval around each token, of those from tokens where ``start`` holds to the token number ``end``;
    null outside all. Intervals must be nested; a start is within its own. ``among``: columns in which token and start must agree."""
    begins = F.coalesce(start & end.isNotNull(), F.lit(False))
    rows = tokens.withColumns({"begins": begins, "until": end}).withColumn("role", F.explode(F.when(F.col("begins"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    rows = rows.withColumn("place", F.when(F.col("role") == 2, F.col("until")).otherwise(F.col("i")))
    delta = F.when(F.col("role") == 2, -1).when(F.col("begins"), 1).otherwise(0)
    whole = Window.partitionBy("file_ord", *among).orderBy("place", "role", F.desc("i")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("nesting", F.sum(delta).over(whole))
    by = Window.partitionBy("file_ord", *among).orderBy("nesting", "place", "role", F.desc("i")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = _last((F.col("role") == 1) & F.col("begins"), info, by, "nesting")
    return rows.withColumn(name, F.when(F.col("nesting") > 0, held)).filter("role = 1").drop("role", "begins", "until", "place", "nesting")
