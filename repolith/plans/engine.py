"""From a source tree to dependencies, leaves, a module tree and documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.functions import predicates
from repolith.operators import external, extract, graph, resolve, tree
from repolith.sources import repo, state


@dataclass
class Analysis:
    """Tables of one tree, each computed once and kept in the shared folder."""

    files: DataFrame
    code_files: DataFrame
    components: DataFrame
    edges: DataFrame
    dependencies: DataFrame
    leaves: DataFrame
    errors: DataFrame

    def summary(self) -> DataFrame:
        """One row: files and their size, code files, components, resolved and unresolved edges, languages."""
        one = lambda df, *columns: df.agg(*columns).withColumn("one", F.lit(1))
        out = one(self.files, F.count("*").alias("total_files"), (F.sum("size_bytes") / 1024).alias("total_kb"))
        out = out.join(one(self.code_files, F.count("*").alias("files_analyzed"), F.array_sort(F.collect_set("language")).alias("languages")), "one")
        out = out.join(one(self.components, F.count("*").alias("components")), "one")
        return out.join(one(self.edges, F.count_if("is_resolved").alias("edges"), F.count_if(~F.col("is_resolved")).alias("unresolved")), "one").drop("one")


def analyze(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, languages: list[str] | None = None, max_files: int | None = None) -> Analysis:
    """``max_files`` is a limit that the caller asks for, in path order."""
    includes, excludes = predicates.pattern_sets(include, exclude)
    path, name = F.col("path"), F.col("name")
    files = repo.read_tree(spark, root, excludes).filter(predicates.included(path, name, includes) & ~predicates.excluded(path, name, excludes))
    code = files.withColumn("language", predicates.language(F.col("extension"))).filter(predicates.supported(F.col("language")))
    code = code.filter(F.col("language").isin(*languages)) if languages else code
    code = code.orderBy("path").limit(max_files) if max_files else code
    rows = graph.saved(extract.extract(code))
    components = graph.saved(resolve.latest_components(extract.components_of(rows)))
    edges = graph.saved(resolve.first_edges(resolve.resolve_calls(extract.edges_of(rows), components)))
    deps = graph.saved(resolve.dependencies(edges, components))
    valid = components.filter(predicates.valid_leaf(F.col("id"), F.col("component_type")))
    leaves = graph.saved(graph.leaves(valid.select("id"), graph.without_cycles(deps)[0]))
    return Analysis(files.drop("content"), code.drop("content"), components, edges, deps, leaves, rows.filter("kind = 'error'").select("file_path", "error"))


def module_tree(analysis: Analysis, clients=(external.group_by_folder,), threshold: int = tree.GROUP_TOKENS) -> DataFrame:
    """The leaves' modules, grouped by the clients' replies; replies that are no such JSON end a branch."""
    texts = analysis.leaves.join(analysis.components.select("id", F.coalesce("source_code", F.lit("")).alias("text")), "id")

    def group(members: DataFrame) -> DataFrame:
        replies = external.completions(external.cluster_prompts(members, analysis.components), clients).filter("reply is not null")
        groups = replies.select("path", F.explode(tree.parsed_groups(F.col("reply"))).alias("name", "module"))
        listed = groups.select("path", "name", F.explode("module.components").alias("id"))
        # A component that a reply lists twice stays in the first group by name; ids that it makes up are dropped.
        return listed.groupBy("path", "id").agg(F.min("name").alias("name")).join(members, ["path", "id"], "left_semi")

    return tree.cluster(texts, external.approximate_tokens, group, threshold)


def documents(modules: DataFrame, analysis: Analysis, existing: DataFrame | None = None, clients=(external.list_children,)) -> DataFrame:
    """(path, body) bottom-up; leaf modules list their components, parents get the clients' overviews."""
    source = analysis.components.select("id", "component_type")

    def leaf(m: DataFrame) -> DataFrame:
        ids = m.select("path", "name", F.explode("components").alias("id")).join(source, "id")
        line = F.concat(F.lit("- "), "id", F.lit(" ("), "component_type", F.lit(")"))
        return ids.groupBy("path", "name").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines")).select("path", F.concat(F.lit("# "), "name", F.lit("\n"), "lines").alias("body"))

    def parent(m: DataFrame) -> DataFrame:
        replies = external.completions(external.overview_prompts(m), clients)
        return m.select("path", "name").join(replies, "path").select("path", F.concat(F.lit("# "), "name", F.lit("\n"), F.coalesce(tree.tagged(F.col("reply")), F.lit(""))).alias("body"))

    none = modules.select("path", F.col("name").alias("body")).limit(0)
    return tree.generate(modules, none if existing is None else existing, leaf, parent)


def stored_tree(spark: SparkSession, out: str) -> DataFrame | None:
    """The module tree that a run left below ``out``; None if none was committed."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/module_tree/_SUCCESS")
    if not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
        return None
    return spark.read.schema("path array<string>, name string, parent array<string>, depth int, ord int, components array<string>").json(f"{out}/module_tree")


def run(spark: SparkSession, root: str, out: str, threshold: int = tree.GROUP_TOKENS, reuse: bool = True, **options) -> Analysis:
    """Analysis, module tree and documents of a tree, written as tables below ``out``. With ``reuse``, a module tree that an earlier
    run left there is taken as it is and no group is split again."""
    analysis = analyze(spark, root, **options)
    stored = stored_tree(spark, out) if reuse else None
    # Saved first, as the stored one is written over.
    modules = graph.saved(module_tree(analysis, threshold=threshold) if stored is None else stored)
    docs = documents(modules, analysis)
    state.write_json(state.dependency_graph(analysis.components.drop("pos"), analysis.dependencies), f"{out}/dependency_graph")
    state.write_json(modules, f"{out}/module_tree")
    state.write_json(docs, f"{out}/documents")
    named = docs.select(F.concat(F.array_join("path", "."), F.lit(".md")).alias("filename"))
    state.write_json(state.metadata(analysis.components, analysis.leaves, modules, named, {"repo_path": root}), f"{out}/metadata")
    return analysis


