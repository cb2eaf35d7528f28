"""Call edges: resolving callee names to components, deduplication and materialisation as ordered equi-joins.

Order is always a column: ``seq`` of rows as extracted. Nothing depends on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolith.operators.graph import saved


def last_segment(name: Column, separator: str = ".") -> Column:
    return F.substring_index(name, separator, -1)


def latest_components(components: DataFrame, seq: str = "seq") -> DataFrame:
    """One row per id: the last row's values, and ``pos``, the first row's place. One aggregate; no window, so a
    repeated id is summed before the shuffle."""
    rest = [c for c in components.columns if c != "id"]
    return (
        components.groupBy("id")
        .agg(F.max_by(F.struct(*rest), seq).alias("last"), F.min(seq).alias("pos"))
        .select("id", *[F.col(f"last.{c}").alias(c) for c in rest if c != seq], "pos")
    )


def name_index(components: DataFrame) -> DataFrame:
    """(key, id): which component a spelled callee means. Ids, names and component ids overwrite, so the last such
    component in place order has the key; last segments only fill keys that nothing else has, first come."""
    columns = set(components.columns)
    strong = [F.col("id"), F.col("name"), *([F.col("component_id")] if "component_id" in columns else [])]
    keys = F.array(*[F.struct(k.alias("key"), F.lit(i).alias("kind")) for i, k in enumerate(strong)], F.struct(last_segment(F.col("id")).alias("key"), F.lit(9).alias("kind")))
    rows = components.select("id", "pos", F.inline(keys)).filter(F.col("key").isNotNull())
    strong_id = F.max_by(F.when(F.col("kind") < 9, F.col("id")), F.when(F.col("kind") < 9, F.struct("pos", "kind")))
    weak_id = F.min_by(F.when(F.col("kind") == 9, F.col("id")), F.when(F.col("kind") == 9, F.col("pos")))
    return rows.groupBy("key").agg(F.coalesce(strong_id, weak_id).alias("id"))


def resolve_calls(edges: DataFrame, components: DataFrame) -> DataFrame:
    """``edges`` (seq, caller, callee, call_line, is_resolved) with the callee's id where its spelling or its last
    segment is known; others stay as they are. The index is joined twice; Spark broadcasts it where it is small."""
    index = name_index(components)
    exact = index.select(F.col("key").alias("callee"), F.col("id").alias("exact_id"))
    short = index.select(F.col("key").alias("short"), F.col("id").alias("short_id"))
    out = edges.withColumn("short", last_segment(F.col("callee"))).join(exact, "callee", "left").join(short, "short", "left")
    found = F.coalesce("exact_id", "short_id")
    return out.select(
        "seq", "caller", F.when(F.col("is_resolved"), F.col("callee")).otherwise(F.coalesce(found, F.col("callee"))).alias("callee"), "call_line",
        (F.col("is_resolved") | found.isNotNull()).alias("is_resolved"),
    )


def first_edges(edges: DataFrame) -> DataFrame:
    """One edge per (caller, callee): the first."""
    rest = [c for c in edges.columns if c not in ("caller", "callee")]
    return edges.groupBy("caller", "callee").agg(F.min_by(F.struct(*rest), "seq").alias("first")).select("caller", "callee", *[f"first.{c}" for c in rest])


def dependencies(edges: DataFrame, components: DataFrame, drop_self_loops: bool = False) -> DataFrame:
    """Distinct (src, dst): callers by id or legacy id, callees by id, legacy id or else the first component of that name.
    Edges whose caller or callee is unknown are dropped."""
    legacy = F.concat_ws(":", "file_path", "name") if "file_path" in components.columns else F.lit(None).cast("string")
    known = components.select("id", "name", "pos", legacy.alias("legacy"))
    by_id = known.select(F.col("id").alias("key"), "id", F.lit(0).alias("rank"), "pos").unionByName(known.filter("legacy is not null").select(F.col("legacy").alias("key"), "id", F.lit(1).alias("rank"), "pos"))
    by_name = known.select(F.col("name").alias("key"), "id", F.lit(2).alias("rank"), "pos")
    best = lambda df: df.groupBy("key").agg(F.min_by("id", F.struct("rank", "pos")).alias("found"))
    callers = best(by_id).select(F.col("key").alias("caller"), F.col("found").alias("src"))
    callees = best(by_id.unionByName(by_name)).select(F.col("key").alias("callee"), F.col("found").alias("dst"))
    out = edges.select("caller", "callee").distinct().join(callers, "caller").join(callees, "callee").select("src", "dst").distinct()
    return out.filter("src <> dst") if drop_self_loops else out


def module_paths(components: DataFrame) -> DataFrame:
    """Distinct dotted prefixes of ids without their last segment."""
    parts = F.split("id", r"\.")
    return components.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))).alias("module")).distinct()


def adjacency(deps: DataFrame) -> DataFrame:
    """(src, depends_on): sorted distinct dst of each src."""
    return deps.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("depends_on"))


def known_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges both of whose ends are nodes."""
    return edges.select("src", "dst").distinct().join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").join(nodes.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst")


def code_of(wanted: DataFrame, components: DataFrame) -> DataFrame:
    """``wanted`` (ord, id) with the source code, or a note where the component is unknown."""
    code = components.select("id", "source_code")
    return wanted.join(code, "id", "left").select("ord", "id", F.coalesce("source_code", F.concat(F.lit("# Component "), "id", F.lit(" not found"))).alias("source_code"))


#: Letters by which ends of ids and names meet first.
TAIL = 4


def _ends_with(edges: DataFrame, side: str, names: DataFrame) -> DataFrame:
    """Pairs of ``edges`` and ``names`` (name) in which the edge's ``side`` ends with the name. Ids and names meet by their last
    ``TAIL`` letters (shorter names whole); only then are ids cut to the lengths of the names met, so rows follow matches."""
    length = F.least(F.length("name"), F.lit(TAIL))
    tails = names.filter(F.length("name") > 0).groupBy(F.right("name", length).alias("tail"), (F.length("name") >= TAIL).alias("long")).agg(F.collect_set(F.length("name")).alias("lengths"))
    ids = edges.select(side).distinct()
    own = F.transform(F.sequence(F.lit(1), F.lit(TAIL)), lambda k: F.struct(F.right(F.col(side), k).alias("tail"), (k == TAIL).alias("long")))
    met = ids.filter(F.length(side) > 0).select(side, F.inline(F.array_distinct(own))).join(tails, ["tail", "long"])
    cut = met.select(side, F.explode("lengths").alias("n")).filter(F.col("n") <= F.length(side)).select(side, F.expr(f"right({side}, n)").alias("name"))
    return edges.join(cut.join(names, "name").distinct(), side)


def call_relations(components: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (name, relation, other, seq): what the functions of each name call (``calls``) and what calls them
    (``called_by``), from resolved ``edges`` whose caller or callee ends with the name; others lose what precedes a colon."""
    names, known = components.select("name").distinct(), edges.filter("is_resolved").select("caller", "callee", "seq")
    side = lambda at, other, relation: _ends_with(known, at, names).select("name", F.lit(relation).alias("relation"), F.substring_index(other, ":", -1).alias("other"), "seq")
    return side("caller", "callee", "calls").unionByName(side("callee", "caller", "called_by"))


def call_lists(components: DataFrame, edges: DataFrame) -> DataFrame:
    """Per component: file name, first docstring line, parameters if there are any, what it calls and what calls it, in
    order of edges, and whether an edge from an id that ends with its name calls that very name."""
    # Read by both sides and by the recursive ones, so what made the edges runs once.
    edges = saved(edges.select("caller", "callee", "seq", "is_resolved"))
    related = call_relations(components, edges)
    # sort_array compares rows as they are; array_sort would call a lambda for each pair.
    listed = lambda relation: F.transform(F.sort_array(F.collect_list(F.when(F.col("relation") == relation, F.struct("seq", "other")))), lambda x: x["other"]).alias(relation)
    lists = related.groupBy("name").agg(listed("calls"), listed("called_by"))
    own = _ends_with(edges.select("caller", "callee"), "caller", components.select("name").distinct()).filter("callee = name").select("name").distinct()
    none = F.array().cast("array<string>")
    out = components.join(lists, "name", "left").join(own.withColumn("own", F.lit(True)), "name", "left")
    return out.select(
        "id", "name", F.substring_index("file_path", "/", -1).alias("file"), F.split("docstring", "\n")[0].alias("summary"),
        (F.col("parameters") if "parameters" in components.columns else F.lit(None).cast("array<string>")).alias("parameters"),
        F.coalesce("calls", none).alias("calls"), F.coalesce("called_by", none).alias("called_by"), F.coalesce("own", F.lit(False)).alias("is_recursive"),
    )


def files_with_leaves(leaves: DataFrame, components: DataFrame, with_source: bool = False) -> DataFrame:
    """(file_path, listing): the known leaves of each file, in id order, as text."""
    line = F.concat(F.lit("\t"), F.col("id"), F.concat(F.lit("\n"), F.col("source_code")) if with_source else F.lit(""))
    known = leaves.select("id").join(components, "id").select("file_path", "id", line.alias("line"))
    return known.groupBy("file_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "line"))), lambda x: x["line"]), "\n").alias("listing"))
