"""Components and call edges of source files, as rows. TypeScript, JavaScript and Java are analysed as arrays of tokens; another
language's analyzer is a function of (path, content)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.operators.extract import braces, java, python_source, scripts
from repolith.operators.extract.token_table import dealt

ROWS = (
    "file_ord long, emit_ord long, kind string, id string, name string, component_type string, file_path string, start_line int, end_line int, "
    "docstring string, parameters array<string>, base_classes array<string>, source_code string, caller string, callee string, call_line int, is_resolved boolean, error string"
)
_FIELDS = [f.split(" ", 1) for f in ROWS.split(", ")]
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}

#: Rows and characters of code after which a task passes on what it found.
BATCH_ROWS, BATCH_CHARS = 2000, 4_000_000

Analyzer = Callable[[str, str], Iterator[dict]]
ANALYZERS: dict[str, Analyzer] = {"python": python_source.analyze} | {lang: braces.analyzer(lang) for lang in braces.LANGUAGES}


#: Rows of the kinds asked for, from a table of files.
TABLES: dict[str, Callable[[DataFrame, tuple[str, ...]], DataFrame]] = {
    "typescript": partial(scripts.analyzed, typed=True), "javascript": partial(scripts.analyzed, typed=False), "java": java.analyzed,
}


def register_analyzer(language: str, analyzer: Analyzer) -> None:
    """An analyzer yields rows of kind ``component`` or ``edge``; it replaces the one there is."""
    ANALYZERS[language] = analyzer
    TABLES.pop(language, None)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x.get(n) for x in rows], _KINDS[k]) for n, k in _FIELDS], [n for n, _ in _FIELDS])


def extract(files: DataFrame, kinds: tuple[str, ...] = ("component", "edge")) -> DataFrame:
    """Rows of kind component, edge or error from ``files`` (file_ord, path, language, content). A file that can't be
    analyzed gives one error row. (file_ord, emit_ord) orders everything. With fewer ``kinds``, tables of tokens aren't asked for the others."""
    analyzers, tables = {k: v for k, v in ANALYZERS.items() if k not in TABLES}, dict(TABLES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for file_ord, path, language, content in zip(*(column.to_pylist() for column in batch.columns)):
                analyzer = analyzers.get(language)
                try:
                    found = list(analyzer(path, content or "")) if analyzer else []
                except (SyntaxError, ValueError, RecursionError) as e:
                    found = [{"kind": "error", "error": f"{type(e).__name__}: {e}"}]
                rows += [{"file_ord": file_ord, "emit_ord": i, "file_path": path} | x for i, x in enumerate(found)]
                held += sum(len(x.get("source_code") or "") for x in found)
                if len(rows) >= BATCH_ROWS or held >= BATCH_CHARS:
                    yield _batch(rows)
                    rows, held = [], 0
        yield _batch(rows)

    # A few megabytes of a table can hold much work, so files are dealt by number, not by what a reader takes for a partition.
    plain = dealt(files.filter(~F.col("language").isin(*tables)).select("file_ord", "path", "language", "content"))
    out = plain.mapInArrow(run, ROWS)
    # What there is, so that no table of tokens is made for a language without files.
    present = {r[0] for r in files.select("language").distinct().filter(F.col("language").isin(*tables)).collect()}
    for language, table in ((k, v) for k, v in tables.items() if k in present):
        rows = table(files.filter(F.col("language") == language), kinds)
        out = out.unionByName(rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(k).alias(n) for n, k in _FIELDS]))
    return out


def components_of(rows: DataFrame) -> DataFrame:
    names = ("id", "name", "component_type", "file_path", "start_line", "end_line", "docstring", "parameters", "base_classes", "source_code")
    return rows.filter("kind = 'component'").select(F.struct("file_ord", "emit_ord").alias("seq"), *names)


def edges_of(rows: DataFrame) -> DataFrame:
    return rows.filter("kind = 'edge'").select(F.struct("file_ord", "emit_ord").alias("seq"), "caller", "callee", "call_line", "is_resolved")
