"""Module trees as adjacency tables: (path array<string>, name, parent array<string>, depth, ord, components array<string>)."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolith.functions import text
from repolith.operators import graph
from repolith.operators import tokens as token_counts

#: Token thresholds of grouping and delegation, and the deepest delegation.
GROUP_TOKENS, DELEGATE_TOKENS, MOST_DEPTH = 36_369, 16_000, 2


def leaf_modules(modules: DataFrame) -> DataFrame:
    return modules.join(modules.select(F.col("parent").alias("path")).distinct(), "path", "left_anti")


def is_complex(modules: DataFrame, components: DataFrame) -> DataFrame:
    """(path, files, complex): whether the module's components lie in more than one file."""
    ids = modules.select("path", F.explode("components").alias("id"))
    return ids.join(components.select("id", "file_path"), "id").groupBy("path").agg(F.count_distinct("file_path").alias("files")).withColumn("complex", F.col("files") > 1)


def order_key(ords: Column) -> Column:
    """A key of the ordinals from the root down, as wide as any; in post-order a parent's key is longer by a last high mark."""
    return F.array_join(F.transform(ords, lambda o: F.lpad(o.cast("string"), 19, "0")), "/")


def with_ordinals(modules: DataFrame) -> DataFrame:
    """``modules`` with ``ords``, the ordinals from the root down, one join for each level."""
    out = level = modules.filter("depth = 0").withColumn("ords", F.array("ord"))
    for depth in range(1, (modules.agg(F.max("depth")).first()[0] or 0) + 1):
        above = level.select(F.col("path").alias("parent"), F.col("ords").alias("above"))
        level = graph.saved(modules.filter(F.col("depth") == depth).join(above, "parent").withColumn("ords", F.concat("above", F.array("ord"))).drop("above").select(out.columns))
        out = out.unionByName(level)
    return out


def post_order(modules: DataFrame) -> DataFrame:
    """``modules`` with ``place``: children before parents, siblings by ord."""
    keyed = with_ordinals(modules).withColumn("key", F.concat(order_key(F.col("ords")), F.lit("/~")))
    return graph.numbered(keyed, ["key"], "place").drop("key")


def rendered(modules: DataFrame, current: list[str] | None = None) -> DataFrame:
    """(place, line): the tree in pre-order, indented by depth; the current module is marked."""
    here = F.col("path") == F.array(*map(F.lit, current)) if current else F.lit(False)
    line = F.concat(F.expr("repeat('  ', depth)"), "name", F.when(here, " (current module)").otherwise(""))
    return graph.numbered(with_ordinals(modules).select(order_key(F.col("ords")).alias("key"), line.alias("line")), ["key"], "place").select("place", "line")


#: A level of a tree in JSON; what is below stays text until its turn.
_LEVEL = "map<string, struct<components: array<string>, children: string>>"


def flattened(trees: DataFrame) -> DataFrame:
    """The modules of one nested tree in JSON (tree), level by level, as a table with paths; null is a tree without modules.
    Siblings keep the order of the text."""
    none = F.array().cast("array<string>")
    out, level = None, trees.select(none.alias("parent"), F.from_json("tree", _LEVEL).alias("modules"))
    for depth in itertools.count():
        rows = level.select("parent", F.posexplode("modules").alias("ord", "name", "module"))
        rows = graph.saved(rows.select(
            F.concat("parent", F.array("name")).alias("path"), "name", "parent", F.lit(depth).alias("depth"), "ord",
            F.coalesce("module.components", none).alias("components"), F.col("module.children").alias("children"),
        ))
        out = rows.drop("children") if out is None else out.unionByName(rows.drop("children"))
        if rows.isEmpty():
            return out
        level = rows.select(F.col("path").alias("parent"), F.from_json("children", _LEVEL).alias("modules"))


def outlined(modules: DataFrame, current: list[str] | None = None) -> DataFrame:
    """(place, line): the tree in pre-order with each module's components, two levels of indent for each depth; the line
    that announces children stands before them. The current module is marked."""
    parents = modules.select(F.col("parent").alias("path")).distinct().withColumn("has_children", F.lit(True))
    here = F.col("path") == F.array(*map(F.lit, current)) if current else F.lit(False)
    pad = lambda more: F.expr(f"repeat('  ', 2 * depth + {more})")
    lines = F.array(
        F.concat(pad(0), "name", F.when(here, " (current module)").otherwise("")),
        F.concat(pad(1), F.lit(" Core components: "), F.array_join("components", ", ")),
        F.when(F.col("has_children"), F.concat(pad(1), F.lit(" Children:"))),
    )
    rows = with_ordinals(modules).join(parents, "path", "left").select(order_key(F.col("ords")).alias("key"), F.posexplode(lines).alias("part", "line"))
    return graph.numbered(rows.filter("line is not null"), ["key", "part"], "place").select("place", "line")


def navigation(modules: DataFrame, page: str = "") -> DataFrame:
    """Links of the two upper levels (section, title, href, level, active, place): a section without components has a title
    but no link."""
    href = F.when((F.col("depth") > 0) | (F.size("components") > 0), F.concat(F.lit("/"), "name", F.lit(".md")))
    section = F.when(F.col("depth") == 0, F.col("name")).otherwise(F.get("parent", F.lit(0)))
    rows = with_ordinals(modules.filter("depth < 2")).select(
        section.alias("section"), text.titled(F.col("name")).alias("title"), href.alias("href"), (F.col("depth") + 1).alias("level"),
        F.coalesce(href == F.lit(f"/{page}"), F.lit(False)).alias("active"), order_key(F.col("ords")).alias("key"),
    )
    return graph.numbered(rows, ["key"], "place").drop("key")


def child_documents(modules: DataFrame, docs: DataFrame, target: list[str]) -> DataFrame:
    """Children of the target with their documents' text, empty where there is none."""
    children = modules.filter(F.col("parent") == F.array(*map(F.lit, target)))
    return children.join(docs.select("path", "body"), "path", "left").select("path", "name", "ord", F.coalesce("body", F.lit("")).alias("body"))


def parsed_groups(reply: Column, tag: str = "GROUPED_COMPONENTS") -> Column:
    """map<name, struct<path, components>> between the reply's tags; null where it is no such JSON. Never evaluated."""
    inner = F.regexp_extract(reply, rf"(?s)<{tag}>(.*?)</{tag}>", 1)
    return F.from_json(inner, "map<string, struct<path: string, components: array<string>>>")


def tagged(reply: Column, tag: str = "OVERVIEW") -> Column:
    return F.trim(F.regexp_extract(reply, rf"(?s)<{tag}>(.*?)</{tag}>", 1))


def cluster(leaves: DataFrame, tokens: Callable[[Column], Column], group: Callable[[DataFrame], DataFrame], threshold: int = GROUP_TOKENS, most_depth: int | None = None) -> DataFrame:
    """Splits groups of ``leaves`` (id, text) level by level until the tokens of their texts, one after the other by id, fit ``threshold``.

    ``group`` maps (path, id) to (path, id, name): the sub-group of each component. A group that doesn't shrink, or
    gives one sub-group, ends, so every level has smaller groups and the last one comes. Returns the tree; each level is
    one job, however many groups it has. ``most_depth`` is a limit that the caller asks for.
    """
    members = graph.saved(token_counts.parts(leaves.select(F.array().cast("array<string>").alias("path"), "id", "text"), tokens))
    out = None
    for depth in itertools.count() if most_depth is None else range(most_depth):
        size = token_counts.totals(members, "path", ["id"], tokens).filter(F.col("total") > threshold)
        named = group(members.join(size.select("path"), "path", "left_semi").select("path", "id"))
        named = named.join(named.groupBy("path").agg(F.count_distinct("name").alias("names")).filter("names > 1").select("path"), "path", "left_semi")
        members = graph.saved(named.join(members, ["path", "id"]).select(F.concat("path", F.array("name")).alias("path"), *members.drop("path").columns))
        if members.isEmpty():
            break
        level = members.groupBy("path").agg(F.array_sort(F.collect_list("id")).alias("components")).select(
            "path", F.element_at("path", -1).alias("name"), F.slice("path", 1, depth).alias("parent"), F.lit(depth).alias("depth"),
            F.row_number().over(Window.partitionBy(F.slice("path", 1, depth)).orderBy("path")).alias("ord"), "components",
        )
        out = level if out is None else out.unionByName(level)
    return out if out is not None else leaves.limit(0).select(F.array("id").alias("path"), F.col("id").alias("name"), F.array("id").alias("parent"), F.lit(0).alias("depth"), F.lit(0).alias("ord"), F.array("id").alias("components"))


def generate(modules: DataFrame, existing: DataFrame, leaf_text: Callable[[DataFrame], DataFrame], parent_text: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Documents (path, body) bottom-up, one wave for each depth. Modules that have a document are skipped.

    ``leaf_text`` maps modules to (path, body); ``parent_text`` maps (path, name, children array<struct<name, body>>) to the same.
    """
    docs = graph.saved(existing.select("path", "body"))
    deepest = modules.agg(F.max("depth")).first()[0]
    leaf = leaf_modules(modules)
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        todo = modules.filter(F.col("depth") == depth).join(docs.select("path"), "path", "left_anti")
        children = modules.join(docs, "path").select(F.col("parent").alias("path"), F.struct("ord", "name", "body").alias("child"))
        grouped = todo.join(leaf.select("path"), "path", "left_anti").join(children, "path").groupBy("path", "name").agg(F.array_sort(F.collect_list("child")).alias("children"))
        wave = leaf_text(todo.join(leaf.select("path"), "path", "left_semi")).unionByName(parent_text(grouped))
        docs = graph.saved(docs.unionByName(wave.select("path", "body")))
    return docs


def delegated(modules: DataFrame, most_depth: int = MOST_DEPTH, least_tokens: int = DELEGATE_TOKENS) -> DataFrame:
    """``modules`` (complex, depth, tokens) with whether they are handed to a sub-module run."""
    return modules.withColumn("delegated", F.col("complex") & (F.col("depth") < most_depth) & (F.col("tokens") >= least_tokens))
