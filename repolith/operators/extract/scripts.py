"""Components and edges of TypeScript and JavaScript, by rules over sibling tokens (:mod:`token_arrays`).

Each rule looks at a fixed number of siblings, or at the last or next one of a kind. Names are resolved within a file:
of candidates with one name the last counts, so a variable hides a function of its name.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.operators.extract.token_arrays import Col, Struct, Tokens, any_of, coalesce, first_edges, lines, listed, lower, rows, spelled, stacked, when

#: Words that no call, method or type starts with.
CONTROL = ("if", "for", "while", "switch", "catch", "with")
WORDS = (*CONTROL, "function", "return", "typeof", "await", "new", "throw", "super", "import", "do", "else", "in", "of", "void", "delete", "yield", "case", "class", "instanceof", "async")
#: Before a function or class that is an expression.
OPERATORS = ("=", "(", ",", ":", "return", "=>", "?", "!", "&", "|", "[", "new", "await", "yield", "+", "-", "*", "/", "...", "typeof", "void", "in", "of", "throw", "<", ">", "%", "^", "~")
#: A line that ends or starts with one of these goes on.
JOINS = ("=", ",", ":", "=>", "?", "!", "&", "|", "+", "-", "*", "/", ".", "?.", "<", ">", "%", "^", "(", "[", "extends", "implements", "return", "new", "const", "let", "var", "type", "export", "default", "async", "function")
GOES_ON = ("=", ",", ":", "=>", "?", "&", "|", "+", "*", "/", ".", "?.", "<", ">", "%", "^", "(", "[", ")", "]", "}", "extends", "implements", "in", "of", "instanceof", "as")
TYPE_WORDS = (
    "string", "number", "boolean", "object", "undefined", "null", "void", "never", "any", "unknown", "symbol", "bigint", "readonly", "keyof", "typeof", "infer", "extends", "is", "in", "new",
    "asserts", "unique", "this", "true", "false", "abstract", "import",
)
MODIFIERS = ("public", "private", "protected", "readonly", "override")
#: Names that make no component.
NO_COMPONENT = ("constructor", "__proto__", "prototype")

def _marked(t: Tokens, typed: bool) -> None:
    """What tokens declare and open: flags, and for braces ``opens`` (body, class, interface, enum, type or block)."""
    c = t.col
    # Comments that name types are siblings of nothing.
    t.put({"up": when(c("kind") == "d", -2).otherwise(c("up")), "next_line": t.following("line")})
    t.neighbours(4, 4)
    t.put({"last_line": coalesce(c("around.last"), t.last_of_file("line"))})
    word = c("kind") == "w"
    free = word & ~c("p1").isin(".", "?.")
    context = when(c("p1").isin("async", "abstract"), c("p2")).otherwise(c("p1"))
    expression = context.isin(*OPERATORS) | ((context == "") & c("around.text").isin("(", "["))
    t.put({
        "breaks": any_of(c("text") == ";", (c("line") > c("pl1")) & ~c("p1").isin(*JOINS) & ~c("text").isin(*GOES_ON)),
        "function": any_of(free & (c("text") == "function") & ~c("n1").isin(":", ",", "=")),
        "expression": any_of(expression),
        "class": any_of(free & (c("text") == "class") & (c("nk1") == "w") & ~c("n1").isin("extends", "implements")),
        "nameless": any_of(free & (c("text") == "class") & c("n1").isin("{", "extends", "implements")),
        "interface": any_of(free & (c("text") == "interface") & (c("nk1") == "w") & c("n2").isin("{", "extends", "<")) if typed else False,
        "enum": any_of(free & (c("text") == "enum") & (c("nk1") == "w") & (c("n2") == "{")) if typed else False,
        "alias": any_of(free & (c("text") == "type") & (c("nk1") == "w") & c("n2").isin("=", "<")) if typed else False,
        "declares": any_of(free & c("text").isin("const", "let", "var") & (c("n1") != "enum")),
    })
    at = lambda condition: coalesce(t.last_before(condition, c("i")), -1)
    t.put({
        "brace_at": at(c("text").isin("{", ";")), "class_at": at(c("class") | c("nameless")), "class_angle": coalesce(t.last_before(c("class") | c("nameless"), c("angle")), 0), "interface_at": at(c("interface")), "enum_at": at(c("enum")), "alias_at": at(c("alias")),
        "returns_at": at((c("text") == ")") & (c("n1") == ":")), "broken_at": coalesce(t.last_so_far(c("breaks"), c("i")), -1), "declares_at": at(c("declares")),
    })
    body = (c("p1") == "=>") | ((c("p1") == ")") & ~c("p3").isin(*CONTROL)) | ((c("returns_at") > c("brace_at")) & ~c("p1").isin(":", "|", "&", "<", ","))
    opens = when(c("text") != "{", None)
    for kind in ("class", "interface", "enum"):
        opens = opens.when(c(f"{kind}_at") > c("brace_at"), t.every(kind))
    opens = opens.when(any_of(body), t.every("body")).when((c("alias_at") > c("brace_at")) & c("p1").isin("=", "&", "|"), t.every("type")).otherwise(t.every("block"))
    t.put({"opens": when(c("kind") == "o", opens)})
    declared = word & (c("p1").isin("const", "let", "var") | ((c("p1") == ",") & (c("declares_at") >= c("broken_at")) & (c("declares_at") >= 0) & (c("angle") >= 0)))
    t.put({"inside": t.enclosing(c("opens"))})
    t.put({
        "declarator": any_of(declared & ~c("text").isin(*WORDS, "{", "[")),
        "method": any_of(
            word & (c("n1") == "(") & (c("n2") == ")") & (c("n3") == "{") & ~c("p1").isin("function", ".", "?.", "new", "*", "=>") & ~c("text").isin(*WORDS),
            word & (c("n1") == "(") & (c("n2") == ")") & (c("n3") == "{") & (c("p1") == "*") & ~c("p2").isin("function"),
            word & (c("n1") == "(") & (c("n2") == ")") & (c("n3") == ":") & (c("inside") == "class") & ~c("p1").isin(".", "?.") & (t.first_after(c("text").isin("{", ";"), c("text")) == "{"),
        ),
    })
    change = lambda kind: Col((c("opens") == kind).true().astype(np.int64) - ((c("kind") == "c") & (t.back("opens") == kind)).true())
    t.put({"in_body": t.open_before(change("body")), "in_class": t.open_before(change("class"))})


def _candidates(t: Tokens, typed: bool) -> None:
    """``found``: what a token declares (name, kind, start_line, end, end_line, paren); null for most."""
    c = t.col
    t.put({"owner_name": t.last_before(c("declarator"), t.struct(text=c("text"), i=c("i"), line=c("line"))), "statement": t.last_so_far(c("declares"), t.struct(text=c("text"), i=c("i"), p1=c("p1")))})
    some = c("function") | c("class") | c("declarator") | (c("text") == "=>")
    if typed:
        some = some | c("interface") | c("enum") | c("alias") | c("method") | (c("text") == "export")
    v = t.view(any_of(some))
    block = v.of(t.first_after(c("text") == "{", t.struct(close=c("close"), line=c("nl1"))))
    signature = v.of(t.first_after(c("text").isin("{", ";"), t.struct(text=c("text"), close=c("close"), line=c("nl1"))))
    stop = v.of(t.first_after((c("text") == ",") | c("breaks"), t.struct(i=c("pi1"), line=c("pl1"))))
    paren = v.of(t.first_after(c("text") == "(", c("i")))
    # An arrow's parameters: in parentheses, one name, or parentheses before a result type.
    before = lambda k: when(c(f"p{k}") == "async", c(f"p{k + 1}")).otherwise(c(f"p{k}"))
    typed_result = v.of(t.last_before((c("text") == ")") & (c("n1") == ":"), t.struct(paren=c("pi1"), before=before(2), line=c("line"))))
    ended = c("text") == ";"
    statement_end = v.of(t.first_after(c("breaks"), t.struct(i=when(ended, c("i")).otherwise(c("pi1")), line=when(ended, c("line")).otherwise(c("pl1"))))) if typed else None
    file_end = v.of(t.last_of_file("i"))
    c = v.col
    inner_end = coalesce(c("around.close") - 1, file_end)
    arrow = when(c("text") != "=>", None).when(c("p1") == ")", v.struct(paren=c("pi2"), before=before(3), line=c("pl2")))
    arrow = arrow.when((c("pk1") == "w") & c("p2").isin("=", "async", "(", ",", "=>"), v.struct(paren=v.none(), before=before(2), line=c("pl1"))).otherwise(typed_result)

    def make(name, kind, start_line, end, end_line, paren=v.none()) -> Struct:
        return v.struct(name=name, kind=v.every(kind), start_line=start_line, end=end, end_line=end_line, paren=paren)

    own_line = when(c("p1").isin("async", "abstract"), c("pl1")).otherwise(c("line"))
    function_name = when(c("n1") == "*", c("n2")).otherwise(c("n1"))
    by_arrow = (c("text") == "=>") & (arrow["before"] == "=") & (c("owner_name.i") > c("broken_at") - 1) & (c("n1") != "")
    arrow_end, arrow_line = when(c("n1") == "{", c("nc1")).otherwise(coalesce(stop["i"], inner_end)), when(c("n1") == "{", c("nl2")).otherwise(coalesce(stop["line"], c("last_line")))
    found = when(c("function") & ~c("expression") & (function_name != "(") & (signature["text"] == "{"), make(function_name, "function", own_line, signature["close"], signature["line"], paren))
    found = found.when(c("class") & ~c("expression"), make(c("n1"), "class", own_line, block["close"], block["line"]))
    if typed:
        found = found.when(c("interface"), make(c("n1"), "interface", c("line"), block["close"], block["line"])).when(c("enum"), make(c("n1"), "enum", c("line"), block["close"], block["line"]))
        found = found.when(c("alias"), make(c("n1"), "type", c("line"), coalesce(statement_end["i"], inner_end), coalesce(statement_end["line"], c("last_line"))))
        found = found.when(c("method") & ~c("text").startswith("#"), make(c("text"), "function", c("line"), block["close"], block["line"], c("ni1")))
        found = found.when((c("text") == "export") & (c("n1") == "default") & (c("n3") == "(") & ~c("n2").isin("function", "async", "class"), make(c("n2"), "function", c("line"), c("nc3"), c("nl4")))
        found = found.when(c("declarator"), make(c("text"), "variable", c("line"), c("i"), c("line")))
    found = found.when(any_of(by_arrow), make(c("owner_name.text"), "function", coalesce(arrow["line"], c("line")), arrow_end, arrow_line, arrow["paren"]))
    if not typed:
        by_function = c("function") & (when(c("p1") == "async", c("p2")).otherwise(c("p1")) == "=") & c("owner_name.text").isNotNull() & (signature["text"] == "{")
        found = found.when(any_of(by_function), make(c("owner_name.text"), "function", own_line, signature["close"], signature["line"], paren))
    t.put({"found": v.spread(found.value)})


def _chained(t: Tokens) -> None:
    """``chain`` (start, line, what stands before) of the dotted names that a token belongs to."""
    c = t.col
    starts = (c("kind") == "w") & ~c("p1").isin(".", "?.")
    t.put({"chain": t.last_so_far(starts, t.struct(i=c("i"), line=c("line"), before=c("p1"), head=c("text")))})


def _annotated(t: Tokens) -> None:
    """``type_line``: the line of the type annotation that a token is part of, null in code."""
    c = t.col
    holder = coalesce(c("inside"), "").isin("class", "interface", "type")
    function_like = (c("n1") == ")") & (c("n2").isin("{", "=>") | ((c("n2") == ":") & (c("p1") != "?"))) & ~c("p1").isin(*CONTROL)
    t.put({"in_parameters": t.enclosing(any_of((c("text") == "(") & (function_like | (holder & (c("pk1") == "w") & (c("n2") == ":")))))})
    named = any_of(c("pk1").isin("w", "s"), c("p1").isin("?", "!", "]", "}"))
    result_end = t.first_after(c("text").isin("{", "=>", ";", "?"), c("text")).isin("{", "=>", ";")
    returns = (c("p1") == ")") & ~c("p3").isin("case", "?") & when(result_end.isNotNull(), result_end).otherwise(holder)
    mark = (c("text") == ":") & (
        (holder & (named | (c("p1") == ")"))) | (c("in_parameters") & named) | t.back("declarator") | (returns & (c("around.text").isNull() | (c("around.text") == "{")) & (coalesce(c("inside"), "") != "block"))
    )
    v = t.view(any_of(mark))
    plain = v.of(t.first_after_at_level(c("text").isin(",", ";", "=") | c("breaks"), c("i")))
    after_result = v.of(t.first_after_at_level(c("text").isin(";", "=>") | ((c("text") == "{") & ~c("p1").isin(":", "|", "&", "<", ",")), c("i")))
    nearer = when(after_result < plain, after_result).otherwise(coalesce(plain, after_result))
    end = coalesce(when(v.col("p1") == ")", nearer).otherwise(plain), v.col("around.close"), v.of(t.last_of_file("i")) + 1) - 1
    t.put({"type_line": t.innermost(any_of(mark), v.spread(end), c("line"))})


def _owned(t: Tokens, typed: bool, owners: bool) -> None:
    """``owner``: the name that a token's uses belong to, if ``owners`` are asked for; ``top`` and ``kept``: what counts as a component."""
    c = t.col
    found = c("found").isNotNull()
    if typed:
        component = (c("found.kind") != "variable") & ~lower(c("found.name")).isin(*NO_COMPONENT) & ~c("in_body")
        # The last candidate of a name counts; the first one gives its place.
        first, last = t.same_name(found, c("found.name"))
        t.put({"first_at": c("i").take(first), "top": any_of(found & component.take(last))})
        t.put({"kept": c("top") & (c("i").take(last) == c("i"))})
        if not owners:
            return
        opens = c("top") & (c("function") | c("class") | c("interface") | c("enum") | c("alias") | (c("text") == "export"))
        t.put({"owner1": t.innermost(opens, c("found.end"), c("found.name"))})
        held = c("declarator") & c("p1").isin("const", "let", "var") & c("top") & (c("owner1").isNull() | (c("p2") == "export"))
        end = coalesce(t.first_after(c("breaks"), when(c("text") == ";", c("i")).otherwise(c("pi1"))), c("around.close") - 1, t.last_of_file("i"))
        t.put({"owner": coalesce(c("owner1"), t.innermost(held, end, c("text")))})
    else:
        valued = found & ((c("text") == "=>") | (c("function") & c("expression")))
        first = coalesce(t.last_before(valued, c("statement.i")), -1) != c("statement.i")
        valued_ok = valued & c("statement.text").isin("const", "let") & first
        kept = any_of(found & when(c("class"), True).when(valued, valued_ok & ~c("in_class")).otherwise(~c("in_class")))
        t.put({"kept": kept, "top": kept, "first_at": c("i")})
        if owners:
            t.put({"owner": t.innermost(any_of(found & when(valued, valued_ok).otherwise(True)), c("found.end"), c("found.name"))})


def _heritage(t: Tokens) -> None:
    """``is_base``: names in the heads of classes; of generic ones only the extended class counts where types are known."""
    c = t.col
    in_head = (c("class_at") >= 0) & (c("class_at") > c("brace_at")) & (c("kind") == "w") & ~c("text").isin("extends", "implements")
    level = c("angle") == c("class_angle")
    t.put({"clause": t.last_before(c("text").isin("extends", "implements") & level, t.struct(i=c("i"), text=c("text"), line=c("line")))})
    direct = level & ((c("p1") == "extends") | ((c("clause.text") == "implements") & c("p1").isin("implements", ",")))
    plain = ~c("n1").isin(".", "?.", "(") & ((c("p1") == "extends") | (c("n1") != "<"))
    t.put({"is_base": any_of(in_head & (c("clause.i") > c("class_at")) & direct & plain)})


def _components(t: Tokens, typed: bool) -> dict:
    c = t.col
    start = c("p1").isin("", ",", *(MODIFIERS if typed else ()))
    stops = c("n1").isin("", ",", ":", "?", "=") if typed else c("n1").isin("", ",")
    parameter = (c("kind") == "w") & (c("around.text") == "(") & start & stops & ~c("text").isin(*MODIFIERS, "this")
    at = np.flatnonzero(c("kept").true())
    paren = c("found.paren").take(at).filled(-1)
    function = (c("found.kind").take(at) == "function").true()
    return {
        "file": t.file[at], "emit_ord": c("first_at").x[at].astype(np.int64) * 8, "name": c("found.name").take(at).array, "component_type": c("found.kind").take(at).array,
        "start_line": c("found.start_line").take(at).array, "end_line": c("found.end_line").take(at).array,
        "parameters": listed(t, parameter, t.around, np.where(paren >= 0, t.place[t.start[at] + paren], -2), lambda sizes: ~function),
        "base_classes": listed(t, c("is_base"), t.placed(c("class_at")), at, lambda sizes: sizes == 0),
    }


def _edges(t: Tokens, typed: bool) -> dict:
    """Uses within an owner, one for each caller, callee and line: the first. A name of the file that is no component of its own is no
    target; ``known`` ones must be components."""
    c = t.col
    ends = (c("kind") == "w") & ~c("n1").isin(".", "?.") & ~c("text").isin(*WORDS)
    member = ((c("inside") == "class") & c("p1").isin("", ";", "}", "abstract", "static", "async", "get", "set", "declare", *MODIFIERS)) | c("inside").isin("interface", "type")
    defines = any_of(c("method"), member, c("chain.before").isin("function", "class", "interface", "enum", "type"), (c("chain.before") == "*") & (c("p2") == "function"))
    code, property_ = ~defines, c("p1").isin(".", "?.")
    if typed:
        code = code & c("type_line").isNull()
    made, called = code & ends & (c("chain.before") == "new"), code & ends & (c("n1") == "(") & (c("chain.before") != "new")
    use = lambda held, key, order, line, known=0, call=0, own=0: (held & c("owner").isNotNull(), {"key": key, "order": order, "line": line, "known": known, "call": call, "own": own, "owner": c("owner"), "i": c("i")})
    if typed:
        chained = t.spelled(any_of(made, called), c("chain.i"))
        type_name = (c("kind") == "w") & c("type_line").isNotNull() & ~c("n1").isin(":", ".") & ~((c("n1") == "?") & (c("n2") == ":")) & ~c("text").isin(*TYPE_WORDS)
        argument = (c("kind") == "w") & c("p1").isin("<", ",") & c("n1").isin(">", ",") & ((c("p1") == "<") | (c("n1") == ">")) & ~c("text").isin(*TYPE_WORDS)
        uses = [
            use(called & (c("chain.head") != "super"), chained, 0, c("chain.line")), use(made, chained, 1, c("chain.line")), use(code & property_ & (c("kind") == "w"), c("text"), 2, c("chain.line")),
            use(type_name, c("text"), 3, c("type_line")), use(argument, c("text"), 4, c("line"), known=1), use(c("is_base"), c("text"), 5, c("clause.line"), known=1),
        ]
    else:
        own = Col(c("chain.head").isin("this", "super").true().astype(np.int8))
        uses = [
            use(called & ((c("chain.i") == c("i")) | property_), c("text"), 0, c("chain.line"), call=1, own=own), use(made, c("text"), 1, c("chain.line")),
            use(c("is_base"), c("text"), 5, t.last_before(c("class"), c("line"))), *[use(*x) for x in _documented(t)],
        ]
    found = stacked(t, uses)
    size = len(t.words)
    names, target = np.flatnonzero(c("found").isNotNull().true()), found["file"] * size + found["key"]
    of_names = t.file[names] * size + c("found.name").x[names]
    is_name, is_top = np.isin(target, of_names), np.isin(target, of_names[c("top").true()[names]])
    if typed:
        keep = is_top | ((found["known"] == 0) & ~is_name)
    else:
        fields = (c("inside") == "class") & (c("kind") == "w") & (c("n1") == "=") & (c("n2").isin("(", "async") | (c("n3") == "=>"))
        methods = stacked(t, [(any_of(c("method"), fields), {"key": c("text"), "owner": c("owner")})])
        triple = lambda x: (x["file"] * size + x["owner"] + 1) * size + x["key"]
        keep = ~((found["own"] == 1) & np.isin(triple(found), triple(methods)))
    found = {n: v[keep] for n, v in (found | {"resolved": (found["call"] == 1) & is_top}).items()}
    edges = first_edges({"file": found["file"], "caller": found["owner"], "callee": found["key"], "line": found["line"], "emit": found["i"] * 8 + found["order"], "resolved": found["resolved"]})
    return {
        "file": edges["file"], "emit_ord": edges["emit"], "caller": spelled(t, edges["caller"]), "callee": spelled(t, edges["callee"]), "call_line": lines(edges["line"]), "is_resolved": edges["resolved"],
    }


def _documented(t: Tokens) -> list[tuple]:
    """Uses of the types of doc comments: at the line of the block that holds the comment, and at that of what follows it."""
    c = t.col
    at = np.flatnonzero((c("kind") == "d").true())
    types, out = [t.words.types[k] for k in t.codes[at].tolist()], []
    for k in range(max((len(x) for x in types), default=0)):
        key, held = np.zeros(t.size, np.int32), np.zeros(t.size, bool)
        here = [len(x) > k for x in types]
        held[at[here]] = True
        key[at[here]] = [t.words[x[k]] for x in types if len(x) > k]
        out += [(Col(held) & line.isNotNull(), Col(key, words=t.words), order, line) for order, line in ((6, c("around.line")), (7, c("next_line")))]
    return out


def _found(t: Tokens, kinds: tuple[str, ...], typed: bool) -> dict[str, dict]:
    _marked(t, typed)
    _candidates(t, typed)
    _heritage(t)
    _owned(t, typed, "edge" in kinds)
    out = {"component": _components(t, typed)} if "component" in kinds else {}
    if "edge" in kinds:
        _chained(t)
        if typed:
            _annotated(t)
        out["edge"] = _edges(t, typed)
    return out


def with_module(files: DataFrame) -> DataFrame:
    """``module``: ``path`` as a dotted id without its extension."""
    bare = F.regexp_replace("path", r"\.(tsx?|jsx?|mjs|cjs|java)$", "")
    return files.withColumn("module", F.regexp_replace(bare, r"[/\\]", "."))


def analyzed(files: DataFrame, kinds: tuple[str, ...], typed: bool) -> DataFrame:
    """Rows of ``kinds`` from ``files`` (file_ord, path, content); ``typed``: TypeScript."""
    return rows(with_module(files), True, partial(_found, typed=typed), kinds)
