"""Calls to models behind small interfaces, with deterministic stand-ins that need no network.

A client is a function from a prompt to a reply; it runs in tasks, over Arrow batches, and must be picklable.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolith.functions import text

Client = Callable[[str], str]


def completions(prompts: DataFrame, clients: Sequence[Client]) -> DataFrame:
    """``prompts`` (path, prompt) with the reply of the first client that gives one, and else the last one's error."""
    clients = list(clients)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            replies, errors = [], []
            for prompt in batch.column("prompt").to_pylist():
                reply = error = None
                for client in clients:
                    try:
                        reply, error = client(prompt or ""), None
                        break
                    except Exception as e:  # noqa: BLE001  any failure of a client leads to the next one
                        error = f"{type(e).__name__}: {e}"
                replies.append(reply)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(replies, pa.string()), pa.array(errors, pa.string())], ["path", "reply", "error"])

    return prompts.select("path", "prompt").mapInArrow(run, "path array<string>, reply string, error string")


def approximate_tokens(text: Column) -> Column:
    """Word pieces: runs of word characters, and single other signs."""
    return F.regexp_count(text, F.lit(r"\w+|[^\w\s]")).cast("long")


def cluster_prompts(members: DataFrame, components: DataFrame) -> DataFrame:
    """(path, prompt): the components of each group, by file, in id order."""
    known = members.join(components.select("id", "file_path"), "id")
    by_file = known.groupBy("path", "file_path").agg(F.array_join(F.array_sort(F.collect_list("id")), "\n\t").alias("ids"))
    part = F.concat("file_path", F.lit("\n\t"), "ids")
    text = F.array_join(F.array_sort(F.collect_list(part)), "\n")
    scope = F.when(F.size("path") == 0, "the repository").otherwise(F.concat(F.lit("module "), F.element_at("path", -1)))
    return by_file.groupBy("path").agg(text.alias("listing")).select("path", F.concat(F.lit("Group the components of "), scope, F.lit(" between <GROUPED_COMPONENTS> tags.\n"), "listing").alias("prompt"))


def overview_prompts(modules: DataFrame) -> DataFrame:
    """(path, prompt) from (path, name, children array<struct<name, body>>)."""
    line = lambda c: F.concat(F.lit("## "), c["name"], F.lit("\n"), c["body"])
    return modules.select("path", F.concat(F.lit("Write an overview of "), "name", F.lit(" between <OVERVIEW> tags.\n"), F.array_join(F.transform("children", line), "\n")).alias("prompt"))


def group_by_folder(prompt: str) -> str:
    """A stand-in that groups listed components by their file's first folder, or by file where there is one folder."""
    import json

    groups: dict[str, list[str]] = {}
    files: dict[str, list[str]] = {}
    path = ""
    for line in prompt.split("\n")[1:]:
        if line.startswith("\t"):
            groups.setdefault(path.split("/")[0], []).append(line.strip())
            files.setdefault(path, []).append(line.strip())
        else:
            path = line
    chosen = groups if len(groups) > 1 else files
    return f"<GROUPED_COMPONENTS>{json.dumps({k: {'path': k, 'components': v} for k, v in chosen.items()})}</GROUPED_COMPONENTS>"


def list_children(prompt: str) -> str:
    """A stand-in that keeps the headings."""
    return "<OVERVIEW>" + "\n".join(x for x in prompt.split("\n") if x.startswith("#")) + "</OVERVIEW>"


def source_prompts(members: DataFrame, components: DataFrame, files: DataFrame) -> DataFrame:
    """(path, sources): the texts of a module's files in the order in which ``members`` (path, ord, id) first name them, each
    under its name and the ids in it. Unknown ids are left out; a file that can't be read says so. ``components`` has (id,
    file_path), ``files`` (path, content)."""
    named = members.join(components.select("id", "file_path"), "id")
    by_file = named.groupBy("path", "file_path").agg(F.min("ord").alias("first"), F.array_sort(F.collect_list(F.struct("ord", "id"))).alias("ids"))
    texts = files.select(F.col("path").alias("file_path"), "content")
    ext = F.concat(F.lit("."), F.element_at(F.split("file_path", r"\."), -1))
    block = F.concat(
        F.lit("# File: "), "file_path", F.lit("\n\n## Core Components in this file:\n"), F.array_join(F.transform("ids", lambda x: F.concat(F.lit("- "), x["id"], F.lit("\n"))), ""),
        F.lit("\n## File Content:\n```"), text.fence_language(ext), F.lit("\n"), F.coalesce("content", F.lit("# Error reading file\n")), F.lit("```\n\n"),
    )
    blocks = by_file.join(texts, "file_path", "left").select("path", F.struct("first", block.alias("block")).alias("part"))
    return blocks.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["block"]), "").alias("sources"))
