"""Components and edges of languages with braces: one scanner blanks comments and strings and finds blocks, and a small
table for each language says what opens a component and what counts as an edge."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache

from repolith.operators.extract.python_source import module_of

_BLANK = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_NAME = r"[A-Za-z_$][\w$]*"
_CALL = re.compile(rf"(?<![\w$.])(?P<new>new\s+)?(?P<name>{_NAME}(?:(?:\.|->|::){_NAME})*)\s*(?:<[\w\s,<>\[\]?]*>)?\s*\(")
_KEYWORDS = frozenset("if for while switch catch return function sizeof typeof await do else new throw super this constructor using lock foreach void defined".split())


@dataclass
class Language:
    """``types``: patterns (component type, regular expression with name and maybe bases and args).

    ``calls`` says what a call points to: ``bare`` (the name as it is), ``owner`` (a class or function of this file) or nothing.
    ``bases``: ``bare`` or ``known`` (only bases of this file). ``uses``: patterns of type names that are dependencies wherever
    they stand. ``stops`` are never dependencies. ``globals``: how uses of this file's global variables are spelled,
    ``module`` (and resolved) or ``bare``; empty: they make no edges.
    """

    types: list[tuple[str, str]]
    calls: str = ""
    bases: str = "bare"
    uses: list[str] = field(default_factory=list)
    stops: frozenset[str] = field(default_factory=frozenset)
    globals: str = ""


_CS = [(t, rf"\b{t}\s+(?P<name>{_NAME})(?:<[^{{]*?>)?(?:\s*\([^)]*\))?(?:\s*:\s*(?P<more>[\w\s,.<>]+?))?\s*(?:where[^{{]*)?\{{") for t in ("class", "interface", "struct", "enum", "record")]
_MODIFIERS = r"(?:(?:public|private|protected|internal|sealed|partial|new|unsafe)\s+)*"
_CS = [
    *((f"{kind} class", rf"\b{kind}\s+{_MODIFIERS}{_CS[0][1][2:]}") for kind in ("static", "abstract")), *_CS,
    ("delegate", rf"\bdelegate\s+[\w.<>\[\],?]+\s+(?P<name>{_NAME})\s*(?:<[^(]*>)?\([^)]*\)[^;{{]*;"),
]
_C = [("function", rf"(?:^|[\n;}}])[ \t]*(?!else\b|return\b|typedef\b|#)[\w*][\w\s*]*?[\s*](?P<name>{_NAME})\s*\((?P<args>[^;{{}}]*)\)\s*\{{")]
_CPP = [*[(t, rf"\b{t}\s+(?P<name>{_NAME})(?:\s+final)?(?:\s*:\s*(?P<more>[\w\s,:<>]+?))?\s*\{{") for t in ("class", "struct")], ("function", _C[0][1].replace("[\\w*][\\w\\s*]*?", "[\\w*][\\w\\s*:<>&,]*?").replace("[\\s*](", "[\\s*&](").replace(r"\)\s*\{", r"\)\s*(?:const\s*)?\{"))]
_PRIMITIVES = frozenset("int long short byte char float double boolean bool void String string object decimal var".split())
#: Calls that are never dependencies, in C and in C++.
_SYSTEM = frozenset((
    "printf", "scanf", "malloc", "free", "strlen", "strcpy", "strcmp", "memcpy", "memset", "exit", "abort", "fopen", "fclose", "fread", "fwrite",
    "SDL_Init", "SDL_CreateWindow", "SDL_Log", "SDL_GetError", "SDL_Quit",
))
_CPP_SYSTEM = frozenset(("printf", "scanf", "malloc", "free", "strlen", "strcpy", "strcmp", "cout", "cin", "endl", "std", "new", "delete"))
#: Types in doc comments that are no dependencies.
_DOC_BUILTINS = frozenset((
    "string", "number", "boolean", "object", "undefined", "null", "void", "any", "Array", "Promise", "Date", "RegExp", "Error", "Map", "Set", "WeakMap",
    "WeakSet", "Function", "Object", "String", "Number", "Boolean", "Symbol", "BigInt", "Element", "HTMLElement", "Document", "Window", "Event",
    "EventTarget", "Node", "Response", "Request", "Headers", "URL", "URLSearchParams", "FormData", "Blob", "File", "T", "U", "V", "K", "P", "R", "E",
))
#: The tags of doc comments that name types; a type has 1000 letters at most, so that time is linear.
_DOC_TAGS = (r"@param\s*\{([^}]{1,1000})\}", r"@returns?\s*\{([^}]{1,1000})\}", r"@type\s*\{([^}]{1,1000})\}", r"@typedef\s*\{[^}]{0,1000}\}\s*(\w+)", r"@interface\s+(\w+)")
_GLOBAL = re.compile(rf"(?:^|[;{{}}])\s*(?P<type>(?:[A-Za-z_][\w:]*(?:<[^;=(){{}}]*>)?\s+)+)(?P<star>\*?)\s*(?P<name>{_NAME})\s*(?P<end>[=;,])")
_NO_GLOBAL = frozenset("typedef return using goto friend template namespace delete throw".split())
_NEW = re.compile(rf"\bnew\s+(?P<name>{_NAME})")
_FIELD = rf"(?:^|[;{{}}\n])\s*(?:(?:public|private|protected|internal|static|final|readonly|virtual|override)\s+)+(?P<type>{_NAME})(?:<[^;=(){{}}]*>)?(?:\[\])?\s+{_NAME}\s*[;={{]"

_PARAMETER = rf"[(,]\s*(?:(?:ref|out|in|params|this|final)\s+)?(?P<type>{_NAME})(?:<[^,(){{}}]*>)?(?:\[\])?\s+{_NAME}\s*(?=[,)=])"

LANGUAGES: dict[str, Language] = {
    "csharp": Language(_CS, bases="known", uses=[_FIELD, _PARAMETER], stops=_PRIMITIVES),
    "c": Language(_C, calls="bare", stops=_SYSTEM, globals="module"),
    "cpp": Language(_CPP, calls="owner", bases="bare", stops=_CPP_SYSTEM, globals="bare"),
}


def blanked(content: str) -> str:
    """Comments and strings as spaces of their length; line breaks stay."""
    return _BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), content)


def _ends(code: str) -> dict[int, int]:
    """Where each opening brace closes."""
    stack, out = [], {}
    for m in re.finditer(r"[{}]", code):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            out[stack.pop()] = m.start()
    return out | dict.fromkeys(stack, len(code))


def doc_types(comment: str) -> list[str]:
    """The types that a doc comment names: the first word of each, those in angle brackets, and the members of unions."""
    out = []
    for spelled in (m.strip() for tag in _DOC_TAGS for m in re.findall(tag, comment)):
        inner = [w for generic in re.findall(r"<([^<>]+)>", spelled) for w in re.findall(r"\w+", generic)]
        members = [m[0] for part in spelled.split("|") if (m := re.match(r"\w+", part.strip()))]
        out += members[:1] * bool(re.match(r"\w", spelled)) + inner + members * ("|" in spelled)
    return [t for t in dict.fromkeys(out) if t not in _DOC_BUILTINS]


def global_variables(code: str, pointers: bool) -> set[str]:
    """Variables declared outside all blocks but namespaces and linkage blocks; ``pointers`` counts initialised pointers too.
    Of a declaration of several, the first one that has a name of its own counts."""
    code = re.sub(r"(?m)^[ \t]*#(?:\\\n|[^\n])*", lambda m: re.sub(r"[^\n]", " ", m[0]), code)
    outer, end = [], 0
    for brace, close in sorted(_ends(code).items()):
        if brace >= end and not re.search(rf"(?:\bnamespace(?:\s+[\w:]+)?|\bextern)\s*\Z", code[max(0, brace - 200) : brace]):
            outer += [code[end : brace + 1], " " * (close - brace - 1)]
            end = close
    code = "".join(outer) + code[end:]
    found = set()
    for m in _GLOBAL.finditer(re.sub(r"[;}]", lambda x: x[0] + "\n", code)):
        words = m["type"].split()
        tag_only = len(words) == 1 and words[0] in ("struct", "class", "enum", "union", "else", "public", "private")
        if not tag_only and not _NO_GLOBAL & set(words) and (not m["star"] or (pointers and m["end"] == "=")):
            found.add(m["name"])
    return found


def analyzer(name: str) -> Callable[[str, str], Iterator[dict]]:
    language = LANGUAGES[name]
    patterns = [(kind, re.compile(p, re.M)) for kind, p in language.types]

    def analyze(path: str, content: str) -> Iterator[dict]:
        module, code, lines = module_of(path), blanked(content), content.split("\n")
        breaks = [i for i, c in enumerate(code) if c == "\n"]
        line_of = lambda at: bisect_right(breaks, at - 1) + 1
        ends = _ends(code)
        found = []
        for kind, pattern in patterns:
            for m in pattern.finditer(code):
                if m["name"] not in _KEYWORDS:
                    found.append((m.start("name"), m.end() - 1, ends.get(m.end() - 1, len(code)), kind, m))
        # Of patterns that find the same name, the first one counts.
        found = sorted({f[0]: f for f in reversed(found)}.values(), key=lambda f: f[0])
        # Scopes by start, and the number of the one around each; ``inner`` holds those that are open.
        scopes: list[tuple[int, int, str, str]] = []
        parents: list[int] = []
        inner: list[int] = []
        rows, names = [], {m["name"] for *_, m in found}
        for start, brace, end, kind, m in found:
            while inner and scopes[inner[-1]][1] <= start:
                inner.pop()
            if kind == "function" and inner:
                continue
            label = m["name"]
            if kind == "delegate":
                end = brace
            parents.append(inner[-1] if inner else -1)
            inner.append(len(scopes))
            scopes.append((brace, end, label, kind))
            groups = m.groupdict()
            bases = [b.strip().split("<")[0].split(" ")[-1] for b in ",".join(filter(None, (groups.get("base"), groups.get("more")))).split(",") if b.strip()]
            args = [a.strip().split("=")[0].split(":")[0].strip().split(" ")[-1].lstrip("*&") for a in (groups.get("args") or "").split(",") if a.strip()]
            first, last = line_of(start), line_of(end)
            rows.append({"kind": "component", "id": f"{module}.{label}", "name": label, "component_type": kind, "start_line": first, "end_line": last, "docstring": "", "parameters": args if kind == "function" else None, "base_classes": bases or None, "source_code": "\n".join(lines[first - 1 : last])})
            for base in bases:
                if language.bases != "known" or base in names:
                    rows.append({"kind": "edge", "caller": f"{module}.{label}", "callee": base if language.bases == "bare" else f"{module}.{base}", "call_line": first, "is_resolved": language.bases == "known"})
        heads = {start for start, *_ in found}
        variables = global_variables(code, language.globals == "module") if language.globals else set()
        kinds = [(r["name"], r["source_code"].split("\n")) for r in rows if r["kind"] == "component" and r["component_type"] in ("class", "struct")]

        @cache
        def owner_of(called: str) -> str | None:
            """The first class or struct with a line that spells the call and a result type or the class itself."""
            for cls, source in kinds:
                if any(f"{called}(" in line and any(w in line for w in ("void", "int", "bool", cls)) for line in source):
                    return cls
            return called if called in names or called in variables else None

        starts = [s[0] for s in scopes]

        def at(place: int) -> tuple[int, int, str, str] | None:
            """The innermost scope around a place: up from the last one that starts before it."""
            i = bisect_left(starts, place) - 1
            while i >= 0 and scopes[i][1] <= place:
                i = parents[i]
            return scopes[i] if i >= 0 else None

        def target(spelled: str, new: bool) -> tuple[str | None, bool]:
            parts = re.split(r"\.|->|::", spelled)
            short = parts[-1]
            if short in _KEYWORDS or short in language.stops:
                return None, False
            if language.calls == "owner":
                # Qualified names and objects that are made are no calls of their own here.
                own = None if new or "::" in spelled else owner_of(short)
                return own and f"{module}.{own}", False
            return (short if len(parts) == 1 else None), False

        uses = []
        if language.calls:
            for m in _CALL.finditer(code):
                if m.start("name") not in heads:
                    uses.append((m.start("name"), *target(m["name"], bool(m["new"]))))
        for pattern in language.uses:
            for m in re.finditer(pattern, code):
                kind = m["type"]
                if kind not in language.stops and kind not in _KEYWORDS:
                    uses.append((m.start("type"), kind, False))
        if variables:
            for m in re.finditer(rf"(?<![\w.>])(?:{'|'.join(sorted(variables))})\b", code):
                declared_here = re.search(rf"({_NAME})[\s*&]+\Z", code[max(0, m.start() - 200) : m.start()])
                local = language.globals == "bare" and declared_here and declared_here[1] not in _KEYWORDS | {"case", "else"} and re.match(r"\s*[;,]", code[m.end() :])
                if not local:
                    uses.append((m.start(), m[0] if language.globals == "bare" else f"{module}.{m[0]}", language.globals == "module"))
        if language.calls == "owner":
            uses += [(m.start("name"), f"{module}.{m['name']}", False) for m in _NEW.finditer(code) if m["name"] in names | variables]
        seen = set()
        for place, callee, known in sorted(uses, key=lambda u: u[0]):
            scope = at(place) or at(place + 1)
            if scope and language.calls == "owner" and scope[3] != "function":
                continue
            key = (scope and scope[2], callee, line_of(place))
            if callee and scope and key not in seen and callee != f"{module}.{scope[2]}":
                seen.add(key)
                rows.append({"kind": "edge", "caller": f"{module}.{scope[2]}", "callee": callee, "call_line": key[2], "is_resolved": known})
        yield from rows

    return analyze
