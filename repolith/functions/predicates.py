"""Filters as Column predicates: path patterns, stop lists, component and model rules."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from repolith.functions.patterns import (
    CONNECTED_WORDS, CRITICAL_NAMES, DEFINITIONS, ENTRY_EXTENSIONS, ENTRY_FILES, ENTRY_PATHS, ENTRY_WORDS, EXCLUDES, EXPORTS, INCLUDES, SOURCE_DIRS,
)

#: Language of each file extension.
EXTENSION_LANGUAGE = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".cs": "csharp",
    ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".c++": "cpp", ".hpp": "cpp", ".hxx": "cpp", ".h++": "cpp",
    ".rs": "rust", ".go": "go", ".php": "php", ".rb": "ruby", ".swift": "swift", ".kt": "kotlin", ".scala": "scala",
}
#: Languages that pass the language filter.
SUPPORTED = ("python", "javascript", "typescript", "java", "csharp", "c", "cpp", "go", "rust")
#: Component types that can be leaves, and id parts that rule a leaf out.
LEAF_TYPES = ("class", "interface", "struct")
LEAF_STOPS = ("error", "exception", "failed", "invalid")

def glob_regex(pattern: str) -> str:
    """A shell pattern as an anchored regular expression; ``*`` crosses ``/``, classes stay, case counts."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        # A class ends at the first bracket that is not its first sign.
        first = i + 1 + (pattern[i + 1 : i + 2] == "!")
        close = pattern.find("]", first + 1) if c == "[" else -1
        if c in "*?":
            out += ".*" if c == "*" else "."
        elif close > 0:
            inner = re.sub(r"([\\\[\]&^])", r"\\\1", pattern[first:close])
            out += f"[^{inner}]" if first > i + 1 else f"[{inner}]"
            i = close
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def _any(column: Column, patterns: list[str]) -> Column:
    inner = "|".join(f"(?:{glob_regex(p)[5:-1]})" for p in patterns)
    return column.rlike(f"(?s)^(?:{inner})\\z") if patterns else F.lit(False)


def excluded(path: Column, name: Column, patterns: tuple[str, ...] = EXCLUDES) -> Column:
    """A pattern matches the path or name as a glob, is a prefix ending in ``/`` (without the slash), a whole leading
    folder, the path itself, or one of its segments."""
    either = lambda texts: "(?:" + "|".join(re.escape(t) for t in dict.fromkeys(texts)) + ")"
    plain = [p.rstrip("/") for p in patterns]
    rules = [f"(?:{glob_regex(p)[5:-1]})\\z" for p in patterns]
    rules += [re.escape(p[:-1]) for p in patterns if p.endswith("/")]
    rules += [f"{either(plain)}/", f"(?:.*/)?{either(p for p in plain if '/' not in p)}(?:/|\\z)"] if plain else []
    # One expression for all: as many conditions are too much for one generated method.
    return F.coalesce(path.rlike(f"(?s)^(?:{'|'.join(rules)})"), F.lit(False)) | F.coalesce(_any(name, list(patterns)), F.lit(False)) if rules else F.lit(False)


def included(path: Column, name: Column, patterns: tuple[str, ...] = INCLUDES) -> Column:
    """No patterns take everything."""
    return (_any(path, list(patterns)) | _any(name, list(patterns))) if patterns else F.lit(True)


def pattern_sets(include: list[str] | None, exclude: list[str] | None) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """User includes replace the defaults; user excludes are added to them."""
    return tuple(include) if include else INCLUDES, tuple(dict.fromkeys([*EXCLUDES, *(exclude or [])]))


def extension(name: Column) -> Column:
    """Lower-cased extension with its dot; empty without one. A leading dot alone makes none."""
    return F.lower(F.regexp_extract(name, r"(?s)^.*[^.].*?(\.[^./]*)$", 1))


def language(ext: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in EXTENSION_LANGUAGE.items() for x in kv]), ext)


def supported(lang: Column) -> Column:
    return lang.isin(*SUPPORTED)


def valid_leaf(component_id: Column, component_type: Column, types: tuple[str, ...] = LEAF_TYPES, stops: tuple[str, ...] = LEAF_STOPS) -> Column:
    """Not blank, of a leaf type, and free of the stop words in any case."""
    return (F.trim(component_id) != "") & ~F.lower(component_id).rlike("|".join(stops)) & component_type.isin(*types)


def python_function_included(name: Column) -> Column:
    return ~name.startswith("_test_")


def typescript_node_included(name: Column, kind: Column) -> Column:
    return (kind != "variable") & ~F.lower(name).isin("constructor", "__proto__", "prototype")


def has_any(column: Column, parts: tuple[str, ...]) -> Column:
    """Whether any of the parts occurs."""
    return column.rlike("|".join(re.escape(p) for p in parts))


def entry_point_file(name: Column) -> Column:
    low = F.lower(name)
    return low.isin(*ENTRY_FILES) | (has_any(low, ENTRY_WORDS) & has_any(low, ENTRY_EXTENSIONS))


def entry_point_path(path: Column) -> Column:
    return has_any(F.lower(path), ENTRY_PATHS)


def well_connected(name: Column, path: Column) -> Column:
    return has_any(F.lower(name), CONNECTED_WORDS) | has_any(F.lower(path), CONNECTED_WORDS) | has_any(F.lower(path), SOURCE_DIRS)


def critical_function(name: Column, snippet: Column) -> Column:
    return F.lower(name).isin(*CRITICAL_NAMES) | F.coalesce(has_any(F.lower(snippet), EXPORTS), F.lit(False))


def definition_patterns(lang: Column) -> Column:
    """Definition templates of a language, else the general ones."""
    table = F.create_map(*[x for k, v in DEFINITIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.element_at(table, F.lower(lang)), F.element_at(table, F.lit("general")))


#: Node types that are component types of their own.
NODE_TYPES = ("class", "interface", "struct", "enum", "record", "abstract class", "annotation", "delegate")


def component_type(is_method: Column, node_type: Column, default: str = "function") -> Column:
    return F.when(is_method, "method").when(node_type.isin(*NODE_TYPES), node_type).otherwise(default)


def top_tier_model(model: Column, tiers: tuple[str, ...] = ("opus", "sonnet", "gpt-4", "gpt-5", "gemini-2.5")) -> Column:
    low = F.lower(model)
    return F.exists(F.array(*map(F.lit, tiers)), lambda t: F.contains(low, t))


def valid_url(url: Column) -> Column:
    """https, or http on the local machine."""
    host = F.try_parse_url(url, F.lit("HOST"))
    scheme = F.try_parse_url(url, F.lit("PROTOCOL"))
    local = host.isin("localhost", "127.0.0.1")
    return F.coalesce((scheme == "https") | ((scheme == "http") & local), F.lit(False)) & F.coalesce(host != "", F.lit(False))


def repository_url(url: Column, hosts: tuple[str, ...] = ("github.com", "www.github.com")) -> Column:
    """On a known host, with owner and repository."""
    parts = F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/"), lambda x: x != "")
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))).isin(*hosts), F.lit(False)) & (F.size(parts) >= 2)


def valid_api_key(key: Column) -> Column:
    return F.coalesce(F.length(F.trim(key)) >= 10, F.lit(False))


def valid_model_name(model: Column) -> Column:
    return F.coalesce(F.trim(model) != "", F.lit(False))
