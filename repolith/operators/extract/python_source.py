"""Components and edges of Python files, from the standard parser."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

#: Names that are never dependencies.
BUILTINS = frozenset((
    "print", "len", "str", "int", "float", "bool", "list", "dict", "tuple", "set", "range", "enumerate", "zip", "isinstance", "hasattr", "getattr", "setattr",
    "open", "super", "__import__", "type", "object", "Exception", "ValueError", "TypeError", "KeyError", "IndexError", "AttributeError", "ImportError",
    "max", "min", "sum", "abs", "round", "sorted", "reversed", "filter", "map", "any", "all", "next", "iter", "callable", "repr", "format", "exec", "eval",
))


def module_of(path: str) -> str:
    """A relative path as a dotted module id, without its extension."""
    return re.sub(r"[/\\]", ".", re.sub(r"\.(py|pyx|pyi|jsx?|tsx?|mjs|cjs|java|cs|c|h|cpp|cc|cxx|hpp|hxx|c\+\+|h\+\+)$", "", path))


def _dotted(node: ast.expr) -> str | None:
    """``f``, ``a.b`` or ``a.b.c``; of longer or other bases the last attribute."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        base = _dotted(node.value) if isinstance(node.value, (ast.Name, ast.Attribute)) else None
        return f"{base}.{node.attr}" if base and base.count(".") < 2 else node.attr
    return None


def _called(node: ast.expr) -> str | None:
    """The dotted name that a call names, from its first name on if that is what it starts with. None for builtins and for
    what is called on one; where that is deeper down, the attributes after the first remain."""
    names = []
    while isinstance(node, ast.Attribute):
        names.append(node.attr)
        node = node.value
    if not isinstance(node, ast.Name):
        return ".".join(reversed(names)) or None
    if node.id not in BUILTINS:
        return ".".join([node.id, *reversed(names)])
    return ".".join(reversed(names[:-1])) or None


class _Visitor(ast.NodeVisitor):
    """Emits in source order. ``scoped``: leaving a nested scope returns to the outer one; without it the scope is lost."""

    def __init__(self, path: str, content: str, scoped: bool):
        self.module, self.lines, self.scoped = module_of(path), content.split("\n"), scoped
        self.seen: set[str] = set()
        self.rows: list[dict] = []
        self.cls: str | None = None
        self.function: str | None = None

    def _component(self, node, kind: str, **more) -> None:
        self.seen.add(node.name)
        self.rows.append(
            {
                "kind": "component", "id": f"{self.module}.{node.name}", "name": node.name, "component_type": kind, "start_line": node.lineno, "end_line": node.end_lineno,
                "docstring": ast.get_docstring(node) or "", "source_code": "\n".join(self.lines[node.lineno - 1 : node.end_lineno]),
            }
            | more
        )

    def _edge(self, caller: str, callee: str, line: int) -> None:
        known = callee in self.seen
        self.rows.append({"kind": "edge", "caller": f"{self.module}.{caller}", "callee": f"{self.module}.{callee}" if known else callee, "call_line": line, "is_resolved": known})

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        bases = [b for b in map(_dotted, node.bases) if b]
        self._component(node, "class", base_classes=bases or None)
        for base in bases:
            if base in self.seen:
                self._edge(node.name, base, node.lineno)
        outer, self.cls = self.cls, node.name
        self.generic_visit(node)
        self.cls = outer if self.scoped else None

    def _function(self, node) -> None:
        top = self.cls is None
        outer = self.function
        if top:
            self.function = node.name
            if not node.name.startswith("_test_"):
                self._component(node, "function", parameters=[a.arg for a in node.args.args])
            else:
                self.seen.discard(node.name)
        self.generic_visit(node)
        if top:
            self.function = outer if self.scoped else None

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def visit_Call(self, node: ast.Call) -> None:
        caller, callee = self.cls or self.function, _called(node.func)
        if caller and callee:
            self._edge(caller, callee, node.lineno)
        self.generic_visit(node)


def analyze(path: str, content: str, scoped: bool = False) -> Iterator[dict]:
    visitor = _Visitor(path, content, scoped)
    visitor.visit(ast.parse(content))
    yield from visitor.rows
