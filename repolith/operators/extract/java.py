"""Components and edges of Java, by rules over sibling tokens (:mod:`token_arrays`).

Variables have scopes: a declaration is an interval from its name to the end of its block (of what follows, for variables of a
loop, resources and lambda parameters), and a use takes the innermost interval of its name around it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from repolith.operators.extract.scripts import with_module
from repolith.operators.extract.token_arrays import Tokens, any_of, coalesce, first_edges, joined, lines, listed, rows, spelled, stacked, when, within

MODIFIERS = ("public", "private", "protected", "static", "final", "abstract", "native", "synchronized", "transient", "volatile", "strictfp", "default", "sealed")
#: Words that start no type.
WORDS = (
    "return", "throw", "new", "else", "case", "package", "import", "assert", "break", "continue", "if", "for", "while", "do", "switch", "try", "catch", "finally", "class", "interface", "enum", "this", "super",
    "yield", "instanceof", "extends", "implements", "throws", "goto",
)
#: Types that are no dependencies.
NO_DEPENDENCY = (
    "boolean", "byte", "char", "double", "float", "int", "long", "short", "Boolean", "Byte", "Character", "Double", "Float", "Integer", "Long", "Short",
    "String", "Object", "List", "Set", "Map", "Collection", "Optional", "void", "Void",
)


def _marked(t: Tokens) -> None:
    c = t.col
    t.neighbours(4, 4)
    t.put({"starts": any_of(c("p1").isin("", ";", "}"), (c("p1") == ",") & (c("around.text") == "("))})
    word, named = c("kind") == "w", (c("kind") == "w") & (c("nk1") == "w") & (c("p1") != ".")
    type_kind = when(named & (c("text") == "class"), t.every("class")).when(named & (c("text") == "interface"), when(c("p1") == "@", t.every("annotation")).otherwise(t.every("interface")))
    type_kind = type_kind.when(named & (c("text") == "enum") & c("n2").isin("{", "implements"), t.every("enum")).when(named & (c("text") == "record") & c("n2").isin("(", "<") & (c("starts") | c("p1").isin(*MODIFIERS)), t.every("record"))
    head = word & ~c("text").isin(*MODIFIERS, *WORDS) & (c("starts") | c("p1").isin(*MODIFIERS) | (c("p2") == "@") | ((c("p1") == ")") & (c("p4") == "@")))
    t.put({"declares": type_kind, "type_head": any_of(head)})
    at = lambda condition: coalesce(t.last_before(condition, c("i")), -1)
    t.put({"statement": t.last_so_far(c("starts"), t.struct(i=c("i"), line=c("line")))})
    t.put({
        "brace_at": at(c("text").isin("{", ";")), "new_at": at(c("text") == "new"), "type_of": t.last_so_far(c("type_head"), t.struct(i=c("i"), text=c("text"), next=c("n1"))),
        "declared": t.last_before(c("declares").isNotNull(), t.struct(i=c("i"), line=c("statement.line"), angle=c("angle"), kind=c("declares"), name=c("n1"))), "abstract_at": at(c("text") == "abstract"),
        "block": t.first_after(c("text") == "{", t.struct(close=c("close"), line=c("nl1"))), "signature": t.first_after(c("text").isin("{", ";"), t.struct(text=c("text"), i=c("i"), line=c("line"), close=c("close"), end_line=c("nl1"))),
    })
    opens = when(c("text") != "{", None).when(c("declared.i") > c("brace_at"), c("declared.kind")).when((c("p1") == ")") & (c("new_at") > c("brace_at")), t.every("anonymous")).otherwise(t.every("block"))
    t.put({"clause": t.last_before(c("text").isin("extends", "implements") & (c("angle") == c("declared.angle")), c("text"))})
    t.put({"inside": t.enclosing(opens)})
    t.put({"in_type": coalesce(c("inside"), "").isin("class", "interface", "enum", "record", "anonymous")})
    result = ((c("pk1") == "w") & ~c("p1").isin(*MODIFIERS, *WORDS)) | c("p1").isin(">", "]")
    method = word & c("in_type") & (c("n1") == "(") & (c("n2") == ")") & c("n3").isin("{", ";", "throws", "[", "default") & result & ~c("text").isin(*WORDS) & ~c("p1").isin(".", "@") & (c("p2") != "@")
    t.put({"method": any_of(method)})


def _variables(t: Tokens) -> None:
    """``variable``: names that are declared, of the type ``type_of`` and known up to ``scope``."""
    c = t.col
    # Where the variables of a parenthesis are known: in what follows it.
    last = t.first_after((c("text") == ";") | ((c("n1") == "") & (c("kind") != "o")), c("i"))
    follows = when(c("n2") == "{", c("nc2")).when((c("n2") == "->") & (c("n3") == "{"), c("nc3")).otherwise(coalesce(last, c("close")))
    scope = when(c("text") == "(", when(c("p1").isin("for", "try") | ((c("n1") == ")") & (c("n2") == "->")), follows)).when(c("text") == "{", c("close")).value
    t.put({"scope": t.enclosing(scope)})
    first = ((c("pi1") == c("type_of.i")) & (c("type_of.next") == c("text"))) | ((c("p1") == ">") & (c("type_of.next") == "<") & (c("angle") == 0))
    variable = (c("kind") == "w") & ~c("type_head") & (c("type_of.i") >= c("statement.i")) & (first | ((c("p1") == ",") & (c("around.text") == "{") & (c("type_of.next") != ".") & (c("angle") == 0))) & c("n1").isin("=", ";", ",", ":", "")
    t.put({"first_variable": any_of(first), "variable": any_of(variable & c("scope").isNotNull() & ~(c("in_type") & ~c("n1").isin("=", ";", ",")))})


def _owned(t: Tokens, edges: bool) -> None:
    """``owner``: the type that a token stands in; for ``edges`` also its method and class."""
    c = t.col
    t.put({"owner": t.innermost(c("declares").isNotNull(), c("block.close"), t.struct(i=c("i"), kind=c("declares"), name=c("n1")))})
    t.put({"method": any_of(c("method") & (c("text") != coalesce(c("owner.name"), "")))})
    t.put({"method_end": when(c("signature.text") == "{", c("signature.close")).otherwise(c("signature.i")), "method_name": when(c("owner.name").isNull(), c("text")).otherwise(joined(t, c("owner.name"), c("text"), ".", c("method")))})
    if edges:
        t.put({"in_method": t.innermost(c("method"), c("method_end"), c("method_name")), "own_class": t.innermost(c("declares") == "class", c("block.close"), c("i"))})


def _heritage(t: Tokens) -> None:
    """``base``: names in the heads of types; ``is_base``: those that classes, enums and records depend on."""
    c = t.col
    level = (c("angle") == c("declared.angle")) & (c("declared.i") > c("brace_at")) & (c("kind") == "w")
    base = level & ((c("p1") == "extends") | ((c("clause") == "implements") & c("p1").isin("implements", ","))) & (c("n1") != ".") & ~c("text").isin("extends", "implements")
    extended = base & (c("p1") == "extends") & (c("n1") != "<") & (c("declared.kind") == "class")
    implemented = base & (c("clause") == "implements") & c("declared.kind").isin("class", "enum", "record")
    t.put({"base": any_of(base), "is_base": any_of(extended, implemented)})


def _components(t: Tokens) -> dict:
    c = t.col
    type_, method = c("declares").isNotNull(), c("method") & c("declares").isNull()
    kind = when((c("declares") == "class") & (c("abstract_at") >= c("statement.i")), t.every("abstract class")).otherwise(c("declares"))
    closed = when(c("signature.text") == "{", c("signature.end_line")).value
    parameter = (c("kind") == "w") & (c("around.text") == "(") & c("n1").isin("", ",") & ((c("pk1") == "w") | c("p1").isin(">", "]", "...")) & (c("angle") == 0)
    at = np.flatnonzero(any_of(type_, method).true())
    is_method = method.true()[at]
    paren = t.placed(when(method, c("ni1")).value)[at]
    here = lambda of_type, of_method: when(method.take(at), of_method.take(at)).otherwise(of_type.take(at)).array
    return {
        "file": t.file[at], "emit_ord": c("i").x[at].astype(np.int64) * 8, "name": here(c("n1"), c("method_name")), "component_type": here(kind, t.every("method")), "start_line": c("statement.line").take(at).array,
        "end_line": here(c("block.line"), coalesce(closed, c("signature.line"))), "parameters": listed(t, parameter, t.around, np.where(paren >= 0, paren, -2), lambda sizes: ~is_method),
        "base_classes": listed(t, c("base"), t.placed(c("declared.i")), at, lambda sizes: sizes == 0),
    }


def _call_types(t: Tokens, calls: dict[str, np.ndarray]) -> np.ndarray:
    """The type of what a method is called on: a type of this file, the innermost local variable within a method, or a field of the class; -1 for none."""
    c, size = t.col, len(t.words)
    known = any_of((c("type_of.next") == "<") | (c("type_of.next") == c("text")) | (c("p1") == ","))
    fields = {"key": c("text"), "i": c("i"), "kind": c("type_of.text"), "scope": c("scope"), "method": c("in_method"), "own": c("inside"), "own_class": c("own_class")}
    variables = stacked(t, [(c("variable") & known, fields)])
    types = stacked(t, [(c("declares").isNotNull(), {"key": c("n1")})])
    own, name = variables["own"] == t.words["class"], lambda x: x["file"] * size + x["key"]
    # Fields: the first of a class and name.
    of_class = lambda x: (x["file"] * size + x["key"]) * (t.size + 1) + x["own_class"] + 1
    order = np.lexsort((variables["i"], of_class(variables)))
    order = order[own[order]]
    classes, first = np.unique(of_class(variables)[order], return_index=True)
    place = np.minimum(np.searchsorted(classes, of_class(calls)), max(len(classes) - 1, 0))
    field = np.where(classes[place] == of_class(calls), variables["kind"][order[first[place]]], -1) if len(classes) else np.full(len(calls["i"]), -1)
    # Local variables: the calls and the declarations of a name in the order of the text.
    local = ~own & (variables["method"] >= 0) & (variables["scope"] >= 0)
    names, number = np.concatenate([name(calls), name(variables)[local]]), np.concatenate([calls["i"], variables["i"][local]])
    order = np.lexsort((number, names))
    names, number, declared = names[order], number[order], order - len(calls["i"])
    first = np.flatnonzero(declared >= 0)
    # An interval ends before the first row of its name behind the scope.
    until, kinds = (variables[n][local][declared[first]] for n in ("scope", "kind"))
    after = np.searchsorted(names * (t.size + 1) + number, names[first] * (t.size + 1) + until, side="right")
    around = within(names, first, after)
    found = np.full(len(order), -1)
    found[order] = np.concatenate([kinds, [-1]])[around]
    found = np.where(calls["method"] >= 0, found[: len(calls["i"])], -1)
    return np.where(np.isin(name(calls), name(types)), calls["key"], np.where(found >= 0, found, field))


def _edges(t: Tokens) -> dict:
    c = t.col
    field = c("variable") & c("first_variable") & c("inside").isin("class", "enum", "record") & ((c("type_of.next") == "<") | (c("type_of.next") == c("text")))
    called = (c("kind") == "w") & (c("n1") == ".") & (c("nk1") == "p") & (c("n3") == "(") & ~c("p1").isin(".", "::", "new", "@") & ~c("text").isin("this", "super")
    made = (c("text") == "new") & (c("nk1") == "w") & c("n2").isin("(", "<")
    use = lambda held, key, order, line, owner=c("owner.name"): (held & owner.isNotNull(), {"key": key, "order": order, "line": line, "owner": owner, "method": c("in_method"), "own_class": c("own_class"), "i": c("i")})
    found = stacked(t, [
        use(c("is_base"), c("text"), 0, c("declared.line"), c("declared.name")), use(field, c("type_of.text"), 1, c("statement.line")), use(made, c("n1"), 2, c("line")), use(called, c("text"), 3, c("line")),
    ])
    call = found["order"] == 3
    found["key"][call] = _call_types(t, {n: v[call] for n, v in found.items()})
    found["owner"] = np.where(call & (found["method"] >= 0), found["method"], found["owner"])
    keep = (found["key"] >= 0) & ~np.isin(found["key"], [t.words[n] for n in NO_DEPENDENCY])
    # A base is a name of this module, another type is as it is spelled: two callees, whatever the names.
    callee = found["key"] * 2 + (found["order"] > 0)
    edges = first_edges({n: v[keep] for n, v in {"file": found["file"], "caller": found["owner"], "callee": callee, "line": found["line"], "emit": found["i"] * 8 + found["order"], "resolved": np.zeros(len(callee), bool)}.items()})
    return {
        "file": edges["file"], "emit_ord": edges["emit"], "caller": spelled(t, edges["caller"]), "callee": spelled(t, edges["callee"] // 2), "plain": edges["callee"] % 2 == 1, "call_line": lines(edges["line"]),
        "is_resolved": edges["resolved"],
    }


def _found(t: Tokens, kinds: tuple[str, ...]) -> dict[str, dict]:
    _marked(t)
    _owned(t, "edge" in kinds)
    _heritage(t)
    if "edge" in kinds:
        _variables(t)
    find = {"component": _components, "edge": _edges}
    return {kind: find[kind](t) for kind in kinds}


def analyzed(files: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Rows of ``kinds`` from ``files`` (file_ord, path, content)."""
    return rows(with_module(files), False, _found, kinds)
