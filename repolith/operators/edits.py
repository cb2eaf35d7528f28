"""Editing commands on files, and diagrams in documents, as joins and aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolith.functions import text

#: The editor's commands.
COMMANDS = ("view", "create", "str_replace", "insert", "undo_edit")
#: The first word of a diagram.
DIAGRAMS = (
    "graph", "flowchart", "sequenceDiagram", "classDiagram", "stateDiagram", "stateDiagram-v2", "erDiagram", "journey", "gantt", "pie", "mindmap",
    "timeline", "gitGraph", "quadrantChart", "requirementDiagram", "C4Context", "block-beta", "xychart-beta", "sankey-beta",
)


def checked(commands: DataFrame, files: DataFrame) -> DataFrame:
    """``commands`` (working_dir, command, path, file_text, old_str, new_str, insert_line) with ``refusal``: why one can't run,
    null where it can. ``files`` (path, is_dir) are those there are, one row for each path.

    Only views are allowed in the repository; then the path must be absolute, must exist (but for ``create``, where it
    mustn't), and folders can only be viewed; last come the parameters.
    """
    rows = commands.join(files.select("path", F.col("is_dir").alias("__is_dir")), "path", "left")
    command, there = F.col("command"), F.col("__is_dir").isNotNull()
    required = (("create", "file_text"), ("str_replace", "old_str"), ("insert", "insert_line"), ("insert", "new_str"))
    rules = [
        ((F.col("working_dir") == "repo") & (command != "view"), "only view is allowed in the repository"),
        (~F.col("path").startswith("/"), "not an absolute path"),
        (~there & (command != "create"), "does not exist"),
        (there & (command == "create"), "already exists"),
        (F.col("__is_dir") & (command != "view"), "is a folder"),
        *(((command == c) & F.col(name).isNull(), f"{name} is required for {c}") for c, name in required),
        (~command.isin(*COMMANDS), "no such command"),
    ]
    refusal = F.lit(None).cast("string")
    for bad, why in reversed(rules):
        refusal = F.when(F.coalesce(bad, F.lit(False)), why).otherwise(refusal)
    return rows.withColumn("refusal", refusal).drop("__is_dir")


def header_error(body: Column) -> Column:
    """The error of a diagram that starts with none of the known words, as a validator spells it; null otherwise."""
    lines = F.transform(F.split(body, "\n"), lambda s, i: F.struct((i + 1).alias("i"), F.trim(s).alias("s")))
    first = F.get(F.filter(lines, lambda x: (x["s"] != "") & ~x["s"].startswith("%%")), F.lit(0))
    word = F.regexp_extract(first["s"], r"^([\w-]+)", 1)
    line, said = F.coalesce(first["i"], F.lit(1)).cast("string"), F.coalesce(first["s"], F.lit(""))
    message = F.concat(F.lit("Error: Parse error on line "), line, F.lit(":\nno diagram starts with "), said)
    return F.when(F.coalesce(~word.isin(*DIAGRAMS), F.lit(True)), message)


def diagram_reports(docs: DataFrame, validate: Callable[[Column], Column] = header_error) -> DataFrame:
    """(path, diagrams, report) of ``docs`` (path, content): that there are no diagrams, that all are right, or the errors with
    their lines in the file, in order. ``validate`` maps a diagram to its error or null; each row is checked by itself."""
    blocks = text.mermaid_blocks(F.coalesce("content", F.lit("")))
    errors = F.filter(F.transform(blocks, lambda b, i: text.diagram_error(i + 1, b["line"], validate(b["body"]))), lambda e: e.isNotNull())
    found = F.concat(F.lit("Mermaid syntax errors found in file: "), "path", F.lit("\n"), F.array_join(F.transform(errors, lambda e: F.concat(F.lit("\n\n"), e)), "\n"))
    right = F.concat(F.lit("All mermaid diagrams in file: "), "path", F.lit(" are syntax correct"))
    report = F.when(F.size(blocks) == 0, "No mermaid diagrams found in the file").when(F.size(errors) > 0, found).otherwise(right)
    return docs.select("path", F.size(blocks).alias("diagrams"), report.alias("report"))
