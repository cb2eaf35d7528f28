"""Scalar functions on text, times and identifiers, as Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the length at which editor output is cut.
MOST_CHARS = 16_000
#: What follows a cut.
CUT_NOTICE = "<response clipped><NOTE>Only part of this file is shown.</NOTE>"


def truncated(content: Column, most: int = MOST_CHARS, notice: str = CUT_NOTICE) -> Column:
    return F.when(F.length(content) > most, F.concat(F.left(content, F.lit(most)), F.lit(notice))).otherwise(content)


def tabs_expanded(content: Column, width: int = 8) -> Column:
    """Tabs as spaces up to the next stop; each tab ends at one, so what precedes the next tab starts at column 0 of a stop."""

    def filled(parts: Column) -> Column:
        to_stop = lambda p: F.rpad(p, (F.floor(F.length(p) / width) + 1).cast("int") * width, " ")
        return F.array_join(F.transform(parts, lambda p, i: F.when(i < F.size(parts) - 1, to_stop(p)).otherwise(p)), "")

    lines = F.transform(F.split(content, r"(?<=[\n\r])"), lambda line: filled(F.split(line, "\t")))
    return F.when(F.contains(content, F.lit("\t")), F.array_join(lines, "")).otherwise(content)


def numbered_lines(content: Column, first: int = 1) -> Column:
    """Lines behind six-wide numbers and a tab."""
    lines = F.split(content, "\n")
    return F.array_join(F.transform(lines, lambda line, i: F.concat(F.repeat(F.lit(" "), 6 - F.length((i + first).cast("string"))), (i + first).cast("string"), F.lit("\t"), line)), "\n")


def editor_output(content: Column, first: int = 1) -> Column:
    """What an editor shows of a text: cut, then without tabs, then numbered."""
    return numbered_lines(tabs_expanded(truncated(content)), first)


def line_range(content: Column, first: Column, last: Column) -> Column:
    """Lines ``first`` to ``last`` (-1: to the end); null where the range is not within the text."""
    lines = F.split(content, "\n")
    end = F.when(last == -1, F.size(lines)).otherwise(last)
    good = (first >= 1) & (first <= F.size(lines)) & (end >= first) & (end <= F.size(lines))
    return F.when(good, F.array_join(F.slice(lines, F.when(good, first).otherwise(1), F.when(good, end - first + 1).otherwise(0)), "\n"))


#: Fixed value: what starts a definition in Python.
_DEFINITION = r"(?U)^\s*(?:def\s+|class\s+|@)"


def _held(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it stands in there: nothing shares what lambdas compute."""
    return F.transform(F.array(value), use)[0]


def _breakpoint(lines: Column, n: Column, current: Column, step: int, most: int | Column, python: Column) -> Column:
    """The line at which to end a view that ends at ``current``, of ``n``: of the lines up to ``most`` further on (``step`` 1: down, -1: up), the
    best one, and of equals the nearest. In Python files the start of a definition counts 3, a blank line before another one
    2, a blank line 1, the first and the last line 3. Down, a view ends before the line, unless it is the text's last or first."""
    if step > 0:
        ahead = F.slice(lines, current, F.least(F.lit(most), n - current) + 1)
    else:
        top = F.greatest(current - most, F.lit(1))
        ahead = F.reverse(F.slice(lines, top, current - top + 1))

    def scored(line: Column, following: Column) -> Column:
        # The one look at a line's text; a definition is looked for only in Python files.
        blank = F.when(line != "", 0).when(following == "", 2).otherwise(1)
        return F.when(python & line.rlike(_DEFINITION), 3).otherwise(blank)

    def rated(score: Column, k: Column) -> Column:
        at = current + step * k
        border = (score < 3) & ((at == 1) | (at == n))
        end = F.when(border | (k == 0), at).otherwise(at - 1 if step > 0 else at)
        return F.struct(F.when(border, 3).otherwise(score).alias("score"), (-k).alias("nearness"), end.alias("end"))

    scores = _held(ahead, lambda x: F.zip_with(x, F.slice(x, F.lit(2), F.size(x)), scored))
    found = _held(F.array_max(F.transform(scores, rated)), lambda best: F.when(best["score"] > 0, best["end"]).otherwise(current))
    end = n if step > 0 else F.lit(1)
    return F.when(current == end, current).otherwise(F.greatest(found, current) if step > 0 else F.least(found, current))


def expanded_view(content: Column, first: Column, last: Column, most: Column, python: Column) -> Column:
    """A struct of ``first`` and ``last``: a view of lines (from 1) with up to ``most`` more on either side, so that it begins and ends where
    the text has a break (``_breakpoint``). Null where the view is not within the text."""
    first, last, most = (x.cast("int") for x in (first, last, most))

    def view(asked: Column) -> Column:
        lines, n, start, stop, room = (asked[x] for x in ("lines", "n", "first", "last", "most"))
        good = (start >= 1) & (start <= stop) & (stop <= n)
        ends = lambda step, at: _breakpoint(lines, n, F.when(good, at).otherwise(1), step, F.greatest(room, F.lit(0)), asked["python"])
        whole = F.when(room <= 0, F.struct(start.alias("first"), stop.alias("last"))).otherwise(F.struct(ends(-1, start).alias("first"), ends(1, stop).alias("last")))
        return F.when(good, whole)

    # The text is split once, and what is asked is computed once.
    split = F.split(content, "\n")
    asked = lambda lines: F.struct(lines.alias("lines"), F.size(lines).alias("n"), first.alias("first"), last.alias("last"), most.alias("most"), python.alias("python"))
    return _held(_held(split, asked), view)


def occurrences(content: Column, part: Column) -> Column:
    return F.when(part == "", 0).otherwise(((F.length(content) - F.length(F.replace(content, part, F.lit("")))) / F.length(part)).cast("long"))


def replace_once(content: Column, old: Column, new: Column) -> Column:
    """A struct of ``ok``, ``text``, ``message`` and ``lines``: replaced only where ``old`` occurs exactly once and differs from
    ``new``, all three without tabs; ``lines`` lists the lines of an ``old`` that occurs more often."""
    plain, old, new = tabs_expanded(content), tabs_expanded(old), tabs_expanded(new)
    n = occurrences(plain, old)
    ok = (n == 1) & (old != new)
    numbered = F.transform(F.split(plain, "\n"), lambda line, i: F.struct((i + 1).alias("i"), F.contains(line, old).alias("hit")))
    lines = F.when(n > 1, F.transform(F.filter(numbered, lambda x: x["hit"]), lambda x: x["i"]))
    message = F.when(n == 0, "not found").when(n > 1, F.concat(F.lit("found "), n.cast("string"), F.lit(" times"))).when(old == new, "same text").otherwise("replaced")
    return F.struct(ok.alias("ok"), F.when(ok, F.replace(plain, old, new)).otherwise(content).alias("text"), message.alias("message"), lines.alias("lines"))


def insert_after(content: Column, line: Column, new: Column) -> Column:
    """``new`` behind line ``line`` (0: at the start); null out of range."""
    lines = F.split(content, "\n")
    good = (line >= 0) & (line <= F.size(lines))
    at = F.when(good, line).otherwise(0)
    parts = F.concat(F.slice(lines, F.lit(1), at), F.split(new, "\n"), F.slice(lines, at + 1, F.size(lines)))
    return F.when(good, F.array_join(parts, "\n"))


def title(body: Column, name: Column) -> Column:
    """The first line's heading, else the file name in title case."""
    first = F.split(body, "\n")[0]
    stem = F.regexp_replace(name, r"\.md$", "")
    return F.when(first.startswith("# "), F.trim(F.substring(first, 3, 1 << 30))).otherwise(F.initcap(F.replace(F.replace(stem, F.lit("_"), F.lit(" ")), F.lit("-"), F.lit(" "))))


def html_escaped(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def html_unescaped(text: Column) -> Column:
    for plain, entity in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


#: How rendered pages open and close a diagram's code, and the element that shows it.
DIAGRAM_OPEN, DIAGRAM_CLOSE, DIAGRAM_DIV = '<pre><code class="language-mermaid">', "</code></pre>", '<div class="mermaid">'


def diagram_divs(html: Column) -> Column:
    """Code blocks of diagrams as elements that show them, their entities resolved; a block that never closes stays."""

    def shown(part: Column) -> Column:
        end = F.locate(DIAGRAM_CLOSE, part)
        body = html_unescaped(F.left(part, end - 1))
        return F.when(end > 0, F.concat(F.lit(DIAGRAM_DIV), body, F.lit("</div>"), F.substr(part, end + len(DIAGRAM_CLOSE)))).otherwise(F.concat(F.lit(DIAGRAM_OPEN), part))

    parts = F.split(html, DIAGRAM_OPEN)
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(shown(p))), "")


def mermaid_blocks(text: Column) -> Column:
    """array<struct<line, body>> of fenced diagrams: the fence's 1-based line and what is inside; those without a line are
    left out, an open one runs to the end. Only fences pass through the running state, as line numbers."""
    lines = F.split(text, "\n")
    fence = lambda s, i: F.struct((i + 1).alias("i"), s.rlike(r"^\s*```mermaid").alias("opens"), s.rlike(r"^\s*```\s*$").alias("closes"))
    fences = F.filter(F.transform(lines, fence), lambda f: f["opens"] | f["closes"])
    state = lambda spans, at: F.struct(spans.alias("spans"), at.alias("at"))
    closed = lambda s, i: F.concat(s["spans"], F.array(F.struct(s["at"].alias("line"), i.alias("end"))))

    def step(s: Column, f: Column) -> Column:
        inside = s["at"] > 0
        return F.when(inside & f["closes"], state(closed(s, f["i"]), F.lit(0))).when(~inside & f["opens"], state(s["spans"], f["i"])).otherwise(s)

    none = state(F.array().cast("array<struct<line: int, end: int>>"), F.lit(0))
    spans = F.aggregate(fences, none, step, lambda s: F.when(s["at"] > 0, closed(s, F.size(lines) + 1)).otherwise(s["spans"]))
    inside = F.filter(spans, lambda b: b["end"] - b["line"] > 1)
    return F.transform(inside, lambda b: F.struct(b["line"].alias("line"), F.array_join(F.slice(lines, b["line"] + 1, b["end"] - b["line"] - 1), "\n").alias("body")))


def diagram_error(number: Column, fence_line: Column, error: Column) -> Column:
    """A validator's error on a diagram with its line counted in the file; null without an error."""
    line = F.regexp_extract(error, r"line (\d+)", 1)
    rest = F.array_join(F.slice(F.split(error, "\n"), F.lit(2), F.size(F.split(error, "\n"))), "\n")
    placed = F.concat(F.lit("Parse error on line "), (fence_line + F.try_to_number(line, F.lit("999999999")).cast("int")).cast("string"), F.lit(":\n"), rest)
    return F.when(error != "", F.concat(F.lit("Diagram "), number.cast("string"), F.lit(": "), F.when(line != "", placed).otherwise(error)))


def lint_error(line: Column) -> Column:
    """A struct of filename, line, col and problem from ``file:line:col: problem``; null where the line is none."""
    at = F.locate(": ", line)
    parts = F.split(F.when(at > 0, F.left(line, at - 1)).otherwise(line), ":")
    number = lambda i: F.trim(F.get(parts, F.lit(i))).try_cast("int")
    good = (F.size(parts) == 3) & number(1).isNotNull() & number(2).isNotNull()
    problem = F.when(at > 0, F.substr(line, at + 2)).otherwise("")
    return F.when(good, F.struct(F.get(parts, F.lit(0)).alias("filename"), number(1).alias("line"), number(2).alias("col"), problem.alias("problem")))


def titled(name: Column) -> Column:
    """Underscores as spaces, each run of letters with a capital first."""
    runs = F.split(F.lower(F.replace(name, F.lit("_"), F.lit(" "))), r"(?<=\P{L})")
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.substring(r, 2, 1 << 30))), "")


def masked_key(key: Column, shown: int = 4) -> Column:
    return (
        F.when(F.coalesce(key, F.lit("")) == "", "Not set")
        .when(F.length(key) <= 2 * shown, F.concat(F.left(key, F.lit(2)), F.lit("..."), F.right(key, F.lit(2))))
        .otherwise(F.concat(F.left(key, F.lit(shown)), F.lit("..."), F.right(key, F.lit(shown))))
    )


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^\p{L}\p{N}]", "_")


def iso_time(t: Column) -> Column:
    """ISO 8601 with microseconds, which are left out where they are 0."""
    whole = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(t, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


def from_iso(text: Column) -> Column:
    return F.try_to_timestamp(text)


def elapsed(seconds: Column) -> Column:
    s = seconds.cast("long")
    return F.format_string("%02d:%02d", F.floor(s / 60), s % 60)


def eta(seconds: Column, progress: Column) -> Column:
    """The time that is left at the pace so far; null before any progress."""
    left = seconds / progress - seconds
    minutes, rest = F.floor(left / 60), F.floor(left) % 60
    shown = (
        F.when(left < 0, "< 1 min").when(minutes > 60, F.format_string("%dh %dm", F.floor(minutes / 60), minutes % 60))
        .when(minutes > 0, F.format_string("%dm %ds", minutes, rest)).otherwise(F.format_string("%ds", rest))
    )
    return F.when(progress > 0, shown)


def first_items(items: Column, n: int = 3) -> Column:
    """The first n and how many more there are."""
    more = F.size(items) - n
    return F.concat(F.array_join(F.slice(items, 1, n), ", "), F.when(more > 0, F.concat(F.lit(" ... and "), more.cast("string"), F.lit(" more"))).otherwise(""))


def error_class(message: Column) -> Column:
    low = F.lower(message)
    return (
        F.when(low.rlike("429|rate limit"), "rate_limit").when(low.rlike("401|unauthori[sz]ed|api key"), "authentication")
        .when(low.rlike("timeout|timed out"), "timeout").when(low.rlike("network|connection"), "network").otherwise("other")
    )


def docs_file_allowed(name: Column) -> Column:
    return name.endswith(".md") & ~name.startswith("/") & ~F.array_contains(F.split(name, "/"), "..")


#: The language of a fence by file extension.
FENCES = {
    ".py": "python", ".md": "markdown", ".sh": "bash", ".json": "json", ".yaml": "yaml", ".java": "java", ".js": "javascript", ".ts": "typescript",
    ".cpp": "cpp", ".c": "c", ".h": "c", ".hpp": "cpp", ".tsx": "typescript", ".cc": "cpp", ".cxx": "cpp", ".jsx": "javascript", ".mjs": "javascript",
    ".cjs": "javascript", ".cs": "csharp",
}


def fence_language(ext: Column) -> Column:
    """Empty for other extensions."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in FENCES.items() for x in kv]), ext), F.lit(""))


def branch_name(t: Column, prefix: str = "docs/repolith") -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.date_format(t, "yyyyMMdd-HHmmss"))


def unused_name(name: Column, taken: Column) -> Column:
    """``name``, or with the least counter from 1 under which it isn't among ``taken``."""
    counters = F.transform(F.sequence(F.lit(1), F.size(taken) + 1), lambda i: F.concat(name, F.lit("-"), i.cast("string")))
    free = F.get(F.filter(counters, lambda c: ~F.array_contains(taken, c)), F.lit(0))
    return F.when(F.array_contains(taken, name), free).otherwise(name)


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8, or else Latin-1; line ends become line feeds."""
    whole = F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(whole, "\\r\\n?", "\n")


def info_panel(model: Column, t: Column, commit: Column, components: Column, depth: Column) -> Column:
    return F.concat_ws(
        " | ", model, F.date_format(t, "yyyy-MM-dd HH:mm"), F.left(commit, F.lit(8)),
        F.concat(F.format_number(components, 0), F.lit(" components")), F.concat(F.lit("depth "), depth.cast("string")),
    )
