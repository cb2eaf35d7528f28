"""Operators on the driver's tables: adapters to this package's schemas, one query for each operator, and SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.functions import patterns, predicates, text, urls
from repolith.operators import graph, jobs, ranking, resolve, tree

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Files: documents with made-up paths.
DIRS = ("src", "tests", "bin_utils", "lib", "examples")
EXTS = (".py", ".js", ".ts", ".java", ".cs", ".c", ".cpp", ".hpp", ".md", ".ini", ".min.js", ".TSX")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))
    name = F.concat(F.lit("doc_"), "doc_id", pick(EXTS, F.col("doc_id") % 12))
    path = F.concat(pick(DIRS, F.col("doc_id") % 5), F.lit("/"), name)
    docs = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), name.alias("name"), F.col("n_chars").alias("size_bytes"))
    return docs.withColumn("extension", predicates.extension(F.col("name")))


def _pick(values: tuple[str, ...], n: str) -> str:
    return f"list_extract([{', '.join(repr(v) for v in values)}], CAST({n} + 1 AS INT))"


FILES = f"""f0 AS (SELECT doc_id, n_chars AS size_bytes, 'doc_' || doc_id || {_pick(EXTS, 'doc_id % 12')} AS name FROM documents),
files AS (SELECT doc_id, size_bytes, name, {_pick(DIRS, 'doc_id % 5')} || '/' || name AS path, lower(regexp_extract(name, '(\\.[^.]*)$', 1)) AS extension FROM f0)"""
LANG = "CASE extension " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in predicates.EXTENSION_LANGUAGE.items()) + " END"
#: What the default patterns leave out of these paths.
EXCLUDED = "(path LIKE 'tests/%' OR path LIKE 'examples/%' OR path LIKE 'bin%' OR path LIKE '%.min.js' OR path LIKE '%.ini')"
INCLUDED = "regexp_matches(name, '\\.(" + "|".join(x[2:] for x in patterns.INCLUDES) + ")$')"


@query(f"WITH {FILES} SELECT doc_id, path, {EXCLUDED} AS is_excluded, {INCLUDED} AS is_included FROM files")
def f1_f2_path_filters(spark, sf_dir):
    f = files(spark, sf_dir)
    return f.select("doc_id", "path", predicates.excluded(F.col("path"), F.col("name")).alias("is_excluded"), predicates.included(F.col("path"), F.col("name")).alias("is_included"))


@query(f"WITH {FILES} SELECT path, name, extension, {LANG} AS language FROM files WHERE {LANG} IS NOT NULL")
def f5_code_files(spark, sf_dir):
    return files(spark, sf_dir).select("path", "name", "extension", predicates.language(F.col("extension")).alias("language")).filter("language is not null")


@query(f"WITH {FILES} SELECT path, {LANG} AS language FROM files WHERE {LANG} IN ('python', 'java') ORDER BY path LIMIT 100")
def f8_language_limit(spark, sf_dir):
    f = files(spark, sf_dir).select("path", predicates.language(F.col("extension")).alias("language"))
    return f.filter(F.col("language").isin("python", "java")).orderBy("path").limit(100)


@query(f"WITH {FILES} SELECT count(*)::BIGINT AS total_files, round(sum(size_bytes) / 1024.0::DOUBLE, 6) AS total_kb, count(*) FILTER ({LANG} IS NOT NULL)::BIGINT AS code_files, count(*) FILTER ({LANG} NOT IN {predicates.SUPPORTED})::BIGINT AS unsupported FROM files WHERE NOT {EXCLUDED} AND {INCLUDED}")
def a3_a4_f24_structure_summary(spark, sf_dir):
    f = files(spark, sf_dir).filter(~predicates.excluded(F.col("path"), F.col("name")) & predicates.included(F.col("path"), F.col("name")))
    lang = predicates.language(F.col("extension"))
    return f.agg(
        F.count("*").alias("total_files"), F.round(F.sum("size_bytes") / 1024, 6).alias("total_kb"), F.count_if(lang.isNotNull()).alias("code_files"),
        F.count_if(lang.isNotNull() & ~predicates.supported(lang)).alias("unsupported"),
    )


@query(f"WITH {FILES} SELECT split_part(path, '/', 1) AS dir, count(*)::BIGINT AS files, sum(size_bytes)::BIGINT AS bytes FROM files GROUP BY ROLLUP (split_part(path, '/', 1))")
def a3_directory_rollup(spark, sf_dir):
    f = files(spark, sf_dir).withColumn("dir", F.split("path", "/")[0])
    return f.rollup("dir").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


@query(f"WITH {FILES} SELECT {LANG} AS language, count(*)::BIGINT AS files FROM files WHERE {LANG} IS NOT NULL GROUP BY 1")
def a8_language_counts(spark, sf_dir):
    f = files(spark, sf_dir).select(predicates.language(F.col("extension")).alias("language"))
    return f.filter("language is not null").groupBy("language").agg(F.count("*").alias("files"))


@query(f"WITH {FILES} SELECT count(*)::BIGINT AS code_files FROM files WHERE extension IN ('.py', '.js', '.ts', '.java', '.c')")
def a9_code_file_count(spark, sf_dir):
    return files(spark, sf_dir).filter(F.col("extension").isin(".py", ".js", ".ts", ".java", ".c")).agg(F.count("*").alias("code_files"))


# Components: parts, spelled so that ids and names repeat.
TYPES = {"STANDARD": "class", "SMALL": "function", "MEDIUM": "interface", "LARGE": "struct", "ECONOMY": "method", "PROMO": "enum"}


def raw_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    module = F.concat(F.lit("mod"), F.col("p_partkey") % 50)
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv]), F.split("p_type", " ")[0]), F.lit("class"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("seq"), F.concat(module, F.lit("."), name).alias("id"), name.alias("name"), kind.alias("component_type"),
        F.concat(module, F.lit(".py")).alias("file_path"), F.col("p_brand").alias("source_code"), F.col("p_size").alias("start_line"),
    )


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.latest_components(raw_components(spark, sf_dir))


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls among parts by line item: spelled as id, name, attribute or something unknown."""
    n = table(spark, sf_dir, "part").count()
    raw = raw_components(spark, sf_dir).select("seq", "id", "name")
    items = table(spark, sf_dir, "lineitem").select(
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("seq"), F.col("l_partkey").alias("a"),
        ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % n).alias("b"), F.col("l_linenumber").alias("call_line"),
    )
    source = raw.select(F.col("seq").alias("a"), F.col("id").alias("caller"))
    target = raw.select(F.col("seq").alias("b"), F.col("id").alias("to_id"), F.col("name").alias("to_name"))
    spelled = F.when(F.col("call_line") % 4 == 0, F.col("to_id")).when(F.col("call_line") % 4 == 1, F.col("to_name")).when(F.col("call_line") % 4 == 2, F.concat(F.lit("obj."), "to_name")).otherwise(F.concat(F.lit("unknown_"), "to_name"))
    return items.join(source, "a").join(target, "b").select("seq", "caller", spelled.alias("callee"), "call_line", F.lit(False).alias("is_resolved"))


COMPONENTS = (
    "rawc AS (SELECT p_partkey AS seq, 'mod' || (p_partkey % 50) || '.' || replace(p_name, ' ', '_') AS id, replace(p_name, ' ', '_') AS name, CASE split_part(p_type, ' ', 1) "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPES.items())
    + """ ELSE 'class' END AS component_type, 'mod' || (p_partkey % 50) || '.py' AS file_path, p_brand AS source_code, p_size AS start_line FROM part),
comp AS (SELECT id, arg_max(name, seq) AS name, arg_max(component_type, seq) AS component_type, arg_max(file_path, seq) AS file_path, arg_max(source_code, seq) AS source_code, arg_max(start_line, seq) AS start_line, min(seq) AS pos FROM rawc GROUP BY id)"""
)
EDGES = """edges AS (SELECT (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS seq, a.id AS caller,
  CASE l_linenumber % 4 WHEN 0 THEN b.id WHEN 1 THEN b.name WHEN 2 THEN 'obj.' || b.name ELSE 'unknown_' || b.name END AS callee, l_linenumber AS call_line
  FROM lineitem JOIN rawc a ON a.seq = l_partkey JOIN rawc b ON b.seq = (l_partkey * 7 + l_suppkey) % (SELECT count(*) FROM part)),
keys AS (SELECT id AS key, id, pos, 0 AS kind FROM comp UNION ALL SELECT name, id, pos, 1 FROM comp UNION ALL SELECT split_part(id, '.', -1), id, pos, 9 FROM comp),
idx AS (SELECT key, coalesce(arg_max(id, pos * 10 + kind) FILTER (kind < 9), arg_min(id, pos) FILTER (kind = 9)) AS id FROM keys GROUP BY key),
resolved AS (SELECT seq, caller, coalesce(x.id, s.id, callee) AS callee, call_line, coalesce(x.id, s.id) IS NOT NULL AS is_resolved
  FROM edges LEFT JOIN idx x ON x.key = callee LEFT JOIN idx s ON s.key = split_part(callee, '.', -1)),
deduped AS (SELECT * FROM resolved QUALIFY row_number() OVER (PARTITION BY caller, callee ORDER BY seq, call_line) = 1),
names AS (SELECT key, arg_min(id, rank * 1000000000 + pos) AS id FROM (SELECT id AS key, id, 0 AS rank, pos FROM comp UNION ALL SELECT file_path || ':' || name, id, 1, pos FROM comp UNION ALL SELECT name, id, 2, pos FROM comp) GROUP BY key),
ids AS (SELECT key, arg_min(id, rank * 1000000000 + pos) AS id FROM (SELECT id AS key, id, 0 AS rank, pos FROM comp UNION ALL SELECT file_path || ':' || name, id, 1, pos FROM comp) GROUP BY key),
deps AS (SELECT DISTINCT c.id AS src, d.id AS dst FROM deduped JOIN ids c ON c.key = caller JOIN names d ON d.key = callee)"""


def resolved(spark, sf_dir) -> DataFrame:
    return resolve.resolve_calls(raw_edges(spark, sf_dir), components(spark, sf_dir))


def deps(spark, sf_dir) -> DataFrame:
    return resolve.dependencies(resolve.first_edges(resolved(spark, sf_dir)), components(spark, sf_dir))


@query(f"WITH {COMPONENTS} SELECT id, name, component_type, start_line, pos FROM comp")
def a2_last_component_wins(spark, sf_dir):
    return components(spark, sf_dir).select("id", "name", "component_type", "start_line", "pos")


@query(f"WITH {COMPONENTS}, {EDGES} SELECT caller, callee, is_resolved, count(*)::BIGINT AS n FROM resolved GROUP BY ALL")
def j1_resolved_calls(spark, sf_dir):
    return resolved(spark, sf_dir).groupBy("caller", "callee", "is_resolved").agg(F.count("*").alias("n"))


@query(f"WITH {COMPONENTS}, {EDGES} SELECT caller, callee, call_line, is_resolved FROM deduped")
def a1_first_edge_wins(spark, sf_dir):
    return resolve.first_edges(resolved(spark, sf_dir)).select("caller", "callee", "call_line", "is_resolved")


@query(f"WITH {COMPONENTS}, {EDGES} SELECT src, dst FROM deps")
def j2_dependencies(spark, sf_dir):
    return deps(spark, sf_dir)


@query(f"WITH {COMPONENTS}, {EDGES} SELECT src, array_to_string(list_sort(list(dst)), ',') AS depends_on FROM deps GROUP BY src")
def a10_dependency_adjacency(spark, sf_dir):
    return resolve.adjacency(deps(spark, sf_dir)).select("src", F.array_join("depends_on", ",").alias("depends_on"))


@query(f"WITH {COMPONENTS}, {EDGES} SELECT src, dst FROM deps WHERE src IN (SELECT id FROM comp WHERE component_type = 'class') AND dst IN (SELECT id FROM comp WHERE component_type = 'class')")
def j3_j7_edges_between_known(spark, sf_dir):
    return resolve.known_edges(deps(spark, sf_dir), components(spark, sf_dir).filter("component_type = 'class'"))


@query(f"WITH {COMPONENTS}, {EDGES} SELECT (SELECT count(*) FROM comp)::BIGINT AS nodes, count(*) FILTER (is_resolved)::BIGINT AS edges, count(*) FILTER (NOT is_resolved)::BIGINT AS unresolved FROM deduped")
def a6_call_graph_summary(spark, sf_dir):
    edges = resolve.first_edges(resolved(spark, sf_dir))
    counts = edges.agg(F.count_if("is_resolved").alias("edges"), F.count_if(~F.col("is_resolved")).alias("unresolved")).withColumn("one", F.lit(1))
    nodes = components(spark, sf_dir).agg(F.count("*").alias("nodes")).withColumn("one", F.lit(1))
    return nodes.join(counts, "one").drop("one")


@query(f"WITH {FILES} SELECT count(*)::BIGINT AS files_analyzed, array_to_string(list_sort(list(DISTINCT {LANG})), ',') AS languages FROM files WHERE {LANG} IN {predicates.SUPPORTED}")
def a5_analysis_summary(spark, sf_dir):
    lang = files(spark, sf_dir).select(predicates.language(F.col("extension")).alias("l")).filter(predicates.supported(F.col("l")))
    return lang.agg(F.count("*").alias("files_analyzed"), F.array_join(F.array_sort(F.collect_set("l")), ",").alias("languages"))


@query(f"WITH {COMPONENTS} SELECT id FROM comp WHERE component_type IN ('class', 'interface', 'struct') AND NOT regexp_matches(lower(id), 'error|exception|failed|invalid')")
def f13_leaf_candidates(spark, sf_dir):
    return components(spark, sf_dir).filter(predicates.valid_leaf(F.col("id"), F.col("component_type"))).select("id")


@query(f"WITH {COMPONENTS} SELECT file_path, string_agg(chr(9) || id, chr(10) ORDER BY id) AS listing FROM comp WHERE component_type = 'class' GROUP BY file_path")
def a11_j4_leaves_by_file(spark, sf_dir):
    comps = components(spark, sf_dir)
    return resolve.files_with_leaves(comps.filter("component_type = 'class'").select("id"), comps)


@query(f"WITH {COMPONENTS}, {EDGES}, d AS (SELECT src, dst FROM deps UNION SELECT dst, src FROM deps), n AS (SELECT id, pos, coalesce(k, 0)::BIGINT AS degree FROM comp LEFT JOIN (SELECT src, count(*) AS k FROM d GROUP BY src) ON src = id) SELECT id, pos AS ord, degree FROM n ORDER BY degree DESC, pos LIMIT 25")
def a13_most_connected(spark, sf_dir):
    return graph.most_connected(components(spark, sf_dir).select("id", F.col("pos").alias("ord")), deps(spark, sf_dir), 25)


@query(f"""WITH {COMPONENTS}, {EDGES}, d AS (SELECT src, dst FROM deps UNION SELECT dst, src FROM deps), n AS (SELECT id, pos, coalesce(k, 0)::BIGINT AS degree FROM comp LEFT JOIN (SELECT src, count(*) AS k FROM d GROUP BY src) ON src = id),
kept AS (SELECT id FROM n ORDER BY degree DESC, pos LIMIT 60) SELECT src, dst FROM deps WHERE src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept)""")
def a13_subgraph_edges(spark, sf_dir):
    return graph.most_connected_subgraph(components(spark, sf_dir).select("id", F.col("pos").alias("ord")), deps(spark, sf_dir), 60)[1].select("src", "dst")


@query(f"WITH {COMPONENTS} SELECT DISTINCT array_to_string(list_slice(string_split(id, '.'), 1, i), '.') AS module FROM comp, unnest(range(1, greatest(len(string_split(id, '.')), 2))) t(i)")
def g10_module_paths(spark, sf_dir):
    return resolve.module_paths(components(spark, sf_dir))


@query(f"""WITH {COMPONENTS}, {EDGES}, n AS (SELECT DISTINCT name FROM comp),
c AS (SELECT name, string_agg(split_part(callee, ':', -1), ',' ORDER BY seq) AS calls FROM n JOIN deduped ON ends_with(caller, name) WHERE is_resolved GROUP BY name),
d AS (SELECT name, string_agg(split_part(caller, ':', -1), ',' ORDER BY seq) AS called_by FROM n JOIN deduped ON ends_with(callee, name) WHERE is_resolved GROUP BY name),
o AS (SELECT DISTINCT name FROM n JOIN deduped ON ends_with(caller, name) AND callee = name)
SELECT id, coalesce(calls, '') AS calls, coalesce(called_by, '') AS called_by, o.name IS NOT NULL AS is_recursive
FROM comp LEFT JOIN c ON c.name = comp.name LEFT JOIN d ON d.name = comp.name LEFT JOIN o ON o.name = comp.name""")
def j8_g9_call_lists(spark, sf_dir):
    comps = components(spark, sf_dir).withColumn("docstring", F.col("source_code"))
    out = resolve.call_lists(comps, resolve.first_edges(resolved(spark, sf_dir)))
    return out.select("id", F.array_join("calls", ",").alias("calls"), F.array_join("called_by", ",").alias("called_by"), "is_recursive")


@query(f"WITH {COMPONENTS}, {EDGES} SELECT 'node' AS kind, count(*)::BIGINT AS n FROM comp UNION ALL SELECT 'edge', count(*) FROM deduped WHERE is_resolved")
def g8_view_elements(spark, sf_dir):
    out = graph.elements(components(spark, sf_dir), resolve.first_edges(resolved(spark, sf_dir)))
    return out.groupBy(F.when(F.get_json_object("element", "$.classes") == "edge-call", "edge").otherwise("node").alias("kind")).agg(F.count("*").alias("n"))


@query(f"WITH {COMPONENTS}, w AS (SELECT o_orderkey AS ord, 'mod' || (o_orderkey % 50) || '.' || replace(p_name, ' ', '_') AS id FROM orders JOIN part ON p_partkey = o_custkey % (SELECT count(*) FROM part)) SELECT ord, w.id, coalesce(source_code, '# Component ' || w.id || ' not found') AS source_code FROM w LEFT JOIN comp ON comp.id = w.id")
def j6_component_code(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    named = part.select(F.col("p_partkey").alias("k"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), (F.col("o_custkey") % part.count()).alias("k"))
    wanted = orders.join(named, "k").select("ord", F.concat(F.lit("mod"), F.col("ord") % 50, F.lit("."), "name").alias("id"))
    return resolve.code_of(wanted, components(spark, sf_dir))


# A graph of suppliers: k depends on (k * k + k + 3) mod n.
def supplier_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = table(spark, sf_dir, "supplier")
    n, k = s.count(), F.col("s_suppkey")
    return s.select(k.alias("id")), s.select(k.alias("src"), ((k * k + k + 3) % n).alias("dst"))


#: Each node has one edge, so a component is one cycle and loses the edge into its least id.
GRAPH = """RECURSIVE g AS (SELECT s_suppkey AS src, (s_suppkey * s_suppkey + s_suppkey + 3) % (SELECT count(*) FROM supplier) AS dst FROM supplier),
closure AS (SELECT src, dst FROM g UNION SELECT c.src, g.dst FROM closure c JOIN g ON g.src = c.dst),
scc AS (SELECT a.src AS id, min(a.dst) AS scc FROM closure a JOIN closure b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src HAVING count(*) > 1)"""


@query(f"WITH {GRAPH} SELECT src, dst FROM closure")
def g_reachable_pairs(spark, sf_dir):
    return graph.reachable(supplier_graph(spark, sf_dir)[1]).select("src", "dst")


@query(f"WITH {GRAPH} SELECT id, scc FROM scc")
def g1_cycles(spark, sf_dir):
    return graph.cycles(supplier_graph(spark, sf_dir)[1])


@query(f"WITH {GRAPH} SELECT g.src, g.dst FROM g LEFT JOIN scc a ON a.id = g.src LEFT JOIN scc b ON b.id = g.dst WHERE (a.scc = b.scc AND g.dst = b.scc) OR g.src = g.dst")
def g2_removed_cycle_edges(spark, sf_dir):
    return graph.without_cycles(supplier_graph(spark, sf_dir)[1])[1]


ACYCLIC = GRAPH + """,
dag AS (SELECT g.src, g.dst FROM g LEFT JOIN scc a ON a.id = g.src LEFT JOIN scc b ON b.id = g.dst WHERE NOT coalesce((a.scc = b.scc AND g.dst = b.scc) OR g.src = g.dst, false)),
walk AS (SELECT s_suppkey AS id, 0 AS level FROM supplier UNION ALL SELECT dag.src, walk.level + 1 FROM walk JOIN dag ON dag.dst = walk.id)"""


@query(f"WITH {ACYCLIC} SELECT id, max(level) AS level FROM walk GROUP BY id")
def g3_dependency_levels(spark, sf_dir):
    nodes, edges = supplier_graph(spark, sf_dir)
    return graph.dependency_levels(nodes, graph.without_cycles(edges)[0])


@query(f"WITH {ACYCLIC}, l AS (SELECT id, max(level) AS level FROM walk GROUP BY id) SELECT id, row_number() OVER (ORDER BY level, id)::BIGINT AS ord FROM l")
def g4_dependency_order(spark, sf_dir):
    nodes, edges = supplier_graph(spark, sf_dir)
    return graph.post_order(nodes, graph.without_cycles(edges)[0])


@query(f"WITH {ACYCLIC} SELECT s_suppkey AS id FROM supplier WHERE s_suppkey NOT IN (SELECT dst FROM dag)")
def g5_g6_roots(spark, sf_dir):
    nodes, edges = supplier_graph(spark, sf_dir)
    return graph.leaves(nodes, graph.without_cycles(edges)[0], threshold=1)


# A module tree of regions, nations and segments.
def module_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    none = F.array().cast("array<string>")
    top = region.select(F.array("r_name").alias("path"), F.col("r_name").alias("name"), none.alias("parent"), F.lit(0).alias("depth"), F.col("r_regionkey").alias("ord"))
    mid = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.array("r_name", "n_name").alias("path"), F.col("n_name").alias("name"), F.array("r_name").alias("parent"), F.lit(1).alias("depth"), F.col("n_nationkey").alias("ord"))
    return top.unionByName(mid)


TREE = """tree AS (SELECT r_name AS p, r_name AS name, '' AS parent, 0 AS depth, lpad(r_regionkey::VARCHAR, 8, '0') AS k FROM region
UNION ALL SELECT r_name || '/' || n_name, n_name, r_name, 1, lpad(r_regionkey::VARCHAR, 8, '0') || '/' || lpad(n_nationkey::VARCHAR, 8, '0') FROM nation JOIN region ON n_regionkey = r_regionkey)"""


@query(f"WITH {TREE} SELECT p AS path, row_number() OVER (ORDER BY k || '/~')::BIGINT AS place FROM tree")
def t5_post_order(spark, sf_dir):
    return tree.post_order(module_tree(spark, sf_dir)).select(F.array_join("path", "/").alias("path"), "place")


@query(f"WITH {TREE} SELECT row_number() OVER (ORDER BY k)::BIGINT AS place, repeat('  ', depth) || name || CASE WHEN p = 'ASIA' THEN ' (current module)' ELSE '' END AS line FROM tree")
def t6_rendered_tree(spark, sf_dir):
    return tree.rendered(module_tree(spark, sf_dir), ["ASIA"])


@query(f"WITH {TREE} SELECT p AS path FROM tree WHERE p NOT IN (SELECT parent FROM tree)")
def f23_leaf_modules(spark, sf_dir):
    return tree.leaf_modules(module_tree(spark, sf_dir)).select(F.array_join("path", "/").alias("path"))


@query(f"WITH {COMPONENTS}, m AS (SELECT DISTINCT n_name AS path, id, file_path FROM nation JOIN comp ON pos % 25 = n_nationkey) SELECT path, count(DISTINCT file_path)::BIGINT AS files, count(DISTINCT file_path) > 1 AS complex FROM m GROUP BY path")
def f22_complex_modules(spark, sf_dir):
    comps = components(spark, sf_dir)
    nation = table(spark, sf_dir, "nation").select(F.col("n_name").alias("path"), F.col("n_nationkey").alias("k"))
    modules = comps.withColumn("k", F.col("pos") % 25).join(nation, "k").groupBy("path").agg(F.collect_list("id").alias("components"))
    return tree.is_complex(modules, comps)


@query(f"WITH {TREE} SELECT name, CASE WHEN name < 'J' THEN 'doc of ' || name ELSE '' END AS body FROM tree WHERE parent = 'ASIA'")
def j9_child_documents(spark, sf_dir):
    modules = module_tree(spark, sf_dir)
    docs = modules.filter("depth = 1 and name < 'J'").select("path", F.concat(F.lit("doc of "), "name").alias("body"))
    return tree.child_documents(modules, docs, ["ASIA"]).select("name", "body")


@query(f"WITH {TREE} SELECT p AS path, CASE depth WHEN 1 THEN name ELSE (SELECT string_agg(c.name, '+' ORDER BY c.k) FROM tree c WHERE c.parent = tree.name) END AS body FROM tree")
def t7_bottom_up_documents(spark, sf_dir):
    modules = module_tree(spark, sf_dir)
    leaf = lambda m: m.select("path", F.col("name").alias("body"))
    parent = lambda m: m.select("path", F.array_join(F.transform("children", lambda c: c["body"]), "+").alias("body"))
    none = modules.select("path", F.col("name").alias("body")).limit(0)
    return tree.generate(modules, none, leaf, parent).select(F.array_join("path", "/").alias("path"), "body")


@query("SELECT c_mktsegment AS path, count(*)::BIGINT AS components FROM customer GROUP BY 1")
def t1_t3_t4_grouped_modules(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("id"), F.col("c_name").alias("text"), "c_mktsegment")
    names = customers.select("id", F.col("c_mktsegment").alias("name"))
    out = tree.cluster(customers.select("id", "text"), lambda t: F.length(t), lambda members: members.join(names, "id"), threshold=1, most_depth=1)
    return out.select(F.array_join("path", "/").alias("path"), F.size("components").cast("long").alias("components"))


# Jobs: events by user.
STATUS = {"signup": "queued", "view": "processing", "purchase": "completed", "error": "failed"}


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv]), F.col("event_type"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("ord"), status.alias("status")).filter("status is not null")


JOBS = "ev AS (SELECT user_id AS job_id, ts, event_id AS ord, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS.items()) + " END AS status FROM events), e AS (SELECT * FROM ev WHERE status IS NOT NULL)"
ISO = lambda c: f"strftime({c}, '%Y-%m-%dT%H:%M:%S.%f')"


def _iso(column: str):
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(column)


@query(f"WITH {JOBS} SELECT job_id, arg_max(status, (ts, ord)) AS status, {ISO('min(ts) FILTER (status = ' + chr(39) + 'queued' + chr(39) + ')')} AS created_at, {ISO('max(ts) FILTER (status IN (' + chr(39) + 'completed' + chr(39) + ', ' + chr(39) + 'failed' + chr(39) + '))')} AS completed_at FROM e GROUP BY job_id")
def w2_w4_job_states(spark, sf_dir):
    return jobs.latest_states(job_events(spark, sf_dir)).select("job_id", "status", _iso("created_at"), _iso("completed_at"))


@query(f"""WITH RECURSIVE {JOBS}, p AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, ord) AS i FROM e),
step AS (SELECT job_id, ord, i, status AS event, status AS now, ts AS created, 'admitted' AS decision FROM p WHERE i = 1
UNION ALL SELECT p.job_id, p.ord, p.i, p.status,
  CASE WHEN p.status <> 'queued' THEN p.status WHEN s.now = 'failed' AND p.ts < s.created + INTERVAL 3 MINUTE THEN s.now WHEN s.now IN ('queued', 'processing') THEN s.now ELSE 'queued' END,
  CASE WHEN p.status <> 'queued' OR s.now IN ('queued', 'processing') OR (s.now = 'failed' AND p.ts < s.created + INTERVAL 3 MINUTE) THEN s.created ELSE p.ts END,
  CASE WHEN s.now IN ('queued', 'processing') THEN 'running' WHEN s.now = 'failed' AND p.ts < s.created + INTERVAL 3 MINUTE THEN 'cooling' ELSE 'admitted' END
  FROM step s JOIN p ON p.job_id = s.job_id AND p.i = s.i + 1)
SELECT job_id, ord, decision FROM step WHERE event = 'queued'""")
def w3_admissions(spark, sf_dir):
    return jobs.admitted(job_events(spark, sf_dir)).select("job_id", "ord", "decision")


@query(f"""WITH RECURSIVE {JOBS}, stored AS (SELECT job_id, max(ts) - INTERVAL 20 DAY AS stored_at FROM e WHERE status = 'completed' AND job_id % 2 = 0 GROUP BY job_id),
p AS (SELECT e.*, coalesce(ts >= stored_at AND ts < stored_at + INTERVAL 10 DAY, false) AS cached, row_number() OVER (PARTITION BY e.job_id ORDER BY ts, ord) AS i FROM e LEFT JOIN stored USING (job_id)),
step AS (SELECT job_id, ord, i, CASE WHEN status = 'queued' AND cached THEN 'completed' ELSE status END AS now, ts AS created, CASE WHEN status <> 'queued' THEN NULL WHEN cached THEN 'cached' ELSE 'admitted' END AS decision FROM p WHERE i = 1
UNION ALL SELECT job_id, ord, i, CASE WHEN d IS NULL THEN status WHEN d IN ('running', 'cooling') THEN was WHEN d = 'cached' THEN 'completed' ELSE 'queued' END, CASE WHEN d IN ('cached', 'admitted') THEN ts ELSE created END, d
  FROM (SELECT p.*, s.now AS was, s.created, CASE WHEN p.status <> 'queued' THEN NULL WHEN s.now IN ('queued', 'processing') THEN 'running'
    WHEN s.now = 'failed' AND p.ts < s.created + INTERVAL 3 MINUTE THEN 'cooling' WHEN p.cached THEN 'cached' ELSE 'admitted' END AS d FROM step s JOIN p ON p.job_id = s.job_id AND p.i = s.i + 1))
SELECT job_id, ord, decision FROM step WHERE decision IS NOT NULL""")
def w3_cached_admissions(spark, sf_dir):
    events = job_events(spark, sf_dir)
    cache = events.filter("status = 'completed' and job_id % 2 = 0").groupBy("job_id").agg((F.max("ts") - F.expr("interval 20 days")).alias("created_at"))
    return jobs.admitted(jobs.with_cache(events, cache, days=10)).select("job_id", "ord", "decision")


def states_at(spark, sf_dir) -> DataFrame:
    return jobs.latest_states(job_events(spark, sf_dir)).withColumn("created_at", F.coalesce("created_at", "started_at", "completed_at"))


STATES = f"{JOBS}, s AS (SELECT job_id, arg_max(status, (ts, ord)) AS status, coalesce(min(ts) FILTER (status = 'queued'), min(ts) FILTER (status = 'processing'), max(ts) FILTER (status IN ('completed', 'failed'))) AS created_at FROM e GROUP BY job_id)"


@query(f"WITH {STATES} SELECT job_id, status FROM s ORDER BY created_at DESC, job_id LIMIT 100")
def a14_recent_jobs(spark, sf_dir):
    return jobs.recent(states_at(spark, sf_dir)).select("job_id", "status")


@query(f"WITH {STATES} SELECT job_id, status FROM s WHERE NOT coalesce(created_at < (SELECT max(ts) FROM e) - INTERVAL 240 HOUR AND status IN ('completed', 'failed'), false)")
def a15_retained_jobs(spark, sf_dir):
    now = F.lit(job_events(spark, sf_dir).agg(F.max("ts")).first()[0])
    return jobs.retained(states_at(spark, sf_dir), now, hours=240).select("job_id", "status")


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("https://github.com/org"), F.col("o_custkey") % 7, F.lit("/repo"), "o_custkey")
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").cast("timestamp").alias("created_at"))
    return last.select(urls.cache_key(url).alias("url_hash"), url.alias("repo_url"), F.concat(F.lit("/docs/"), "o_custkey").alias("docs_path"), "created_at")


CACHE = "c AS (SELECT substr(sha256('https://github.com/org' || (o_custkey % 7) || '/repo' || o_custkey), 1, 16) AS url_hash, '/docs/' || o_custkey AS docs_path, max(o_orderdate) AS created_at FROM orders GROUP BY o_custkey), n AS (SELECT max(o_orderdate) AS now FROM orders)"


@query(f"WITH {CACHE} SELECT c_custkey, docs_path FROM customer LEFT JOIN (SELECT * FROM c, n WHERE now < created_at + INTERVAL 365 DAY) x ON x.url_hash = substr(sha256('https://github.com/org' || (c_custkey % 7) || '/repo' || c_custkey), 1, 16)")
def j10_e6_cache_probe(spark, sf_dir):
    now = F.lit(table(spark, sf_dir, "orders").agg(F.max(F.col("o_orderdate").cast("timestamp"))).first()[0])
    url = F.concat(F.lit("https://github.com/org"), F.col("c_custkey") % 7, F.lit("/repo"), "c_custkey")
    return jobs.cached_documents(table(spark, sf_dir, "customer").select("c_custkey", urls.cache_key(url).alias("url_hash")), cache(spark, sf_dir), now).select("c_custkey", "docs_path")


@query(f"WITH {CACHE} SELECT url_hash, docs_path FROM c, n WHERE created_at >= now - INTERVAL 365 DAY")
def a16_cache_cleanup(spark, sf_dir):
    now = F.lit(table(spark, sf_dir, "orders").agg(F.max(F.col("o_orderdate").cast("timestamp"))).first()[0])
    return jobs.after_cleanup(cache(spark, sf_dir), now).select("url_hash", "docs_path")


@query(f"WITH {CACHE} SELECT url_hash, CASE WHEN url_hash < '8' THEN '/new' ELSE docs_path END AS docs_path FROM c")
def a17_cache_upsert(spark, sf_dir):
    entries = cache(spark, sf_dir).select("url_hash", "docs_path")
    return jobs.upsert(entries, entries.filter("url_hash < '8'").withColumn("docs_path", F.lit("/new")), "url_hash")


@query(f"WITH {STATES}, k AS (SELECT c_custkey AS job_id, 'completed' AS status FROM customer) SELECT job_id, status FROM s UNION ALL SELECT job_id, status FROM k WHERE job_id NOT IN (SELECT job_id FROM s)")
def j11_jobs_from_cache(spark, sf_dir):
    cached = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_id"), F.lit("completed").alias("status"))
    return jobs.rebuilt_from_cache(states_at(spark, sf_dir).select("job_id", "status"), cached)


@query("SELECT l_orderkey, l_linenumber, round(coalesce(sum(l_tax) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + l_tax * l_discount, 6) AS overall FROM lineitem")
def a21_progress(spark, sf_dir):
    stages = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("ord"), F.col("l_tax").alias("weight"), F.col("l_discount").alias("done"))
    return jobs.progress(stages).select(F.col("job_id").alias("l_orderkey"), F.col("ord.l_linenumber").alias("l_linenumber"), F.round("overall", 6).alias("overall"))


# Texts.
@query("SELECT doc_id, CASE WHEN length(text) > 16000 THEN left(text, 16000) || '" + text.CUT_NOTICE + "' ELSE text END AS text FROM documents")
def e10_truncated(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.truncated(F.col("text")).alias("text"))


@query("SELECT doc_id, list_aggregate(list_transform(range(1, len(string_split(text, chr(10))) + 1), lambda i: lpad(i::VARCHAR, 6, ' ') || chr(9) || string_split(text, chr(10))[i]), 'string_agg', chr(10)) AS lines FROM documents")
def e11_numbered_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.numbered_lines(F.col("text")).alias("lines"))


@query("WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) SELECT doc_id, CASE WHEN len(l) >= 2 THEN array_to_string(l[2:least(len(l), 4)], chr(10)) END AS part FROM d")
def e12_x10_line_range(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    last = F.least(F.size(F.split("text", "\n")), F.lit(4))
    return docs.select("doc_id", text.line_range(F.col("text"), F.lit(2), last).alias("part"))


@query("WITH d AS (SELECT doc_id, text, (length(text) - length(replace(text, ' the ', ''))) // 5 AS n FROM documents) SELECT doc_id, n = 1 AS ok, md5(CASE WHEN n = 1 THEN replace(text, ' the ', ' THE ') ELSE text END) AS digest FROM d")
def e13_replace_once(spark, sf_dir):
    r = text.replace_once(F.col("text"), F.lit(" the "), F.lit(" THE "))
    return table(spark, sf_dir, "documents").select("doc_id", r["ok"].alias("ok"), F.md5(r["text"]).alias("digest"))


@query("WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) SELECT doc_id, CASE WHEN len(l) >= 1 THEN md5(array_to_string(list_concat(l[1:1], ['// new'], l[2:]), chr(10))) END AS digest FROM d")
def e14_insert_after(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.insert_after(F.col("text"), F.lit(1), F.lit("// new"))).alias("digest"))


@query("SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS digest FROM pages")
def k10_html_escaped(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.html_escaped(F.col("html"))).alias("digest"))


@query("SELECT c_custkey, left(c_name, 4) || '...' || right(c_name, 4) AS masked FROM customer")
def e8_masked_keys(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.masked_key(F.col("c_name")).alias("masked"))


@query("SELECT p_partkey, regexp_replace(p_name, '[^\\p{L}\\p{N}]', '_', 'g') AS safe FROM part")
def e9_safe_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.safe_name(F.col("p_name")).alias("safe"))


@query("SELECT event_id, CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS iso FROM events")
def e25_iso_times(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.iso_time(F.col("ts").cast("timestamp")).alias("iso"))


@query("SELECT event_id, printf('%02d:%02d', (event_id // 60)::INT, (event_id % 60)::INT) AS elapsed FROM events")
def e26_elapsed(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.elapsed(F.col("event_id")).alias("elapsed"))


@query("SELECT page_id, count(*)::BIGINT AS links FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY page_id")
def x3d_extracted_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))).groupBy("page_id").agg(F.count("*").alias("links"))


@query("WITH d AS (SELECT doc_id, replace(text, chr(10), ' ') AS body FROM documents) SELECT doc_id, 2 AS line, md5(body) AS body FROM d WHERE trim(body) <> ''")
def x11_mermaid_blocks(spark, sf_dir):
    md = F.concat(F.lit("intro\n```mermaid\n"), F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\n```"))
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(text.mermaid_blocks(md))).select("doc_id", "line", F.md5("body").alias("body"))


@query("SELECT s_suppkey, 'https://github.com/o' || s_suppkey || '/' || replace(s_name, '#', '-') AS url, 'o' || s_suppkey || '--' || replace(s_name, '#', '-') AS job_id FROM supplier")
def e1_e5_urls(spark, sf_dir):
    raw = F.concat(F.lit("www.github.com/o"), "s_suppkey", F.lit("/"), F.replace("s_name", F.lit("#"), F.lit("-")), F.lit(".git/tree/x"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", urls.sanitized(raw).alias("url"))
    return s.select("s_suppkey", "url", urls.job_id(urls.repo_info(F.col("url"))["full_name"]).alias("job_id"))


@query(r"""WITH u AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://github.com/O' || page_id || '/Repo.git' ELSE url END AS url FROM pages),
p AS (SELECT *, string_split(trim(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/'), '/') AS parts FROM u)
SELECT page_id, page_id % 2 = 0 AS on_host, CASE WHEN len(parts) > 1 THEN 'https://github.com/' || parts[1] || '/' || regexp_replace(parts[2], '\.git$', '') ELSE lower(rtrim(url, '/')) END AS normal FROM p""")
def e4_f27_foreign_urls(spark, sf_dir):
    """Addresses of repositories among those of other hosts, which are taken for repositories where their paths have two parts."""
    url = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://github.com/O"), "page_id", F.lit("/Repo.git"))).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", urls.normalized(url).alias("normal"), predicates.repository_url(url).alias("on_host"))


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def s9_json_properties(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def _matches(column: str, parts: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{p}')" for p in parts) + ")"


@query(f"WITH {FILES} SELECT path, name IN {patterns.ENTRY_FILES} OR ({_matches('lower(name)', patterns.ENTRY_WORDS)} AND {_matches('lower(name)', patterns.ENTRY_EXTENSIONS)}) AS entry, {_matches('lower(path)', patterns.ENTRY_PATHS)} AS entry_path, {_matches('lower(path)', patterns.CONNECTED_WORDS)} OR {_matches('lower(path)', patterns.SOURCE_DIRS)} AS connected FROM files")
def f15_f16_f17_file_marks(spark, sf_dir):
    name, path = F.col("name"), F.col("path")
    return files(spark, sf_dir).select("path", predicates.entry_point_file(name).alias("entry"), predicates.entry_point_path(path).alias("entry_path"), predicates.well_connected(name, path).alias("connected"))


@query(f"SELECT p_partkey, lower(split_part(p_name, ' ', 1)) IN {patterns.CRITICAL_NAMES} OR contains(lower(p_type), 'exports.') AS critical FROM part")
def f18_critical_functions(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", predicates.critical_function(F.split("p_name", " ")[0], F.col("p_type")).alias("critical"))


@query(f"""WITH {FILES}, c AS (SELECT doc_id AS ord, path, name, {_matches('lower(name)', patterns.FALLBACK_WORDS)} OR {_matches('lower(path)', patterns.ENTRY_PATHS)} AS hit FROM files),
t AS (SELECT *, CASE WHEN hit THEN 0 ELSE 1 END AS tier FROM c)
SELECT ord, path, name, (-(length(path) - length(replace(path, '/', ''))) - CASE WHEN {_matches('lower(name)', ('main', 'app', 'index'))} THEN 10 ELSE 0 END - CASE WHEN {_matches('lower(name)', ('.py', '.js', '.go', '.rs'))} THEN 5 ELSE 0 END)::BIGINT AS score
FROM t WHERE tier = (SELECT min(tier) FROM t) ORDER BY score, ord LIMIT 5""")
def f19_fallback_entry_points(spark, sf_dir):
    return ranking.fallback_entry_points(files(spark, sf_dir).withColumnRenamed("doc_id", "ord"))


@query(f"""WITH {FILES}, t AS (SELECT doc_id AS ord, path, name, CASE WHEN {_matches('lower(path)', patterns.FALLBACK_DIRS)} THEN 0 WHEN {_matches('lower(name)', patterns.ENTRY_EXTENSIONS)} AND NOT {_matches('lower(name)', ('test', 'spec', '_test'))} THEN 1 END AS tier FROM files)
SELECT ord, path, name, tier FROM t WHERE tier IS NOT NULL ORDER BY tier, ord LIMIT 10""")
def f20_fallback_connected_files(spark, sf_dir):
    return ranking.fallback_connected_files(files(spark, sf_dir).withColumnRenamed("doc_id", "ord"))


@query(f"WITH {FILES} SELECT path, CASE {LANG} WHEN 'python' THEN 'def {{name}}' WHEN 'c' THEN 'void {{name}}|int {{name}}|{{name}}(' WHEN 'cpp' THEN 'void {{name}}|int {{name}}|{{name}}(' WHEN 'javascript' THEN 'function {{name}}|const {{name}}|export {{name}}' WHEN 'typescript' THEN 'function {{name}}|const {{name}}|export {{name}}' ELSE '{{name}}(' END AS templates FROM files")
def f21_definition_templates(spark, sf_dir):
    lang = predicates.language(F.col("extension"))
    return files(spark, sf_dir).select("path", F.array_join(predicates.definition_patterns(lang), "|").alias("templates"))


@query("SELECT n_nationkey, contains(lower(n_name), 'an') OR contains(lower(n_name), 'in') AS top FROM nation")
def f29_model_tiers(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", predicates.top_tier_model(F.col("n_name"), ("an", "in")).alias("top"))


@query(f"WITH {COMPONENTS}, {FILES}, c AS (SELECT count(*)::BIGINT AS components FROM comp), f AS (SELECT count(*)::BIGINT AS files, count(DISTINCT extension)::BIGINT AS extensions FROM files) SELECT * FROM c, f")
def a7_merged_summary(spark, sf_dir):
    c = components(spark, sf_dir).agg(F.count("*").alias("components")).withColumn("one", F.lit(1))
    f = files(spark, sf_dir).agg(F.count("*").alias("files"), F.count_distinct("extension").alias("extensions")).withColumn("one", F.lit(1))
    return c.join(f, "one").drop("one")


@query(f"WITH {COMPONENTS} SELECT file_path, string_agg(id, ',' ORDER BY start_line, id) AS ids, count(*)::BIGINT AS n FROM comp GROUP BY file_path")
def a12_a18_components_by_line(spark, sf_dir):
    by_line = F.array_sort(F.collect_list(F.struct("start_line", "id")))
    return components(spark, sf_dir).groupBy("file_path").agg(F.array_join(F.transform(by_line, lambda x: x["id"]), ",").alias("ids"), F.count("*").alias("n"))


@query(f"WITH {COMPONENTS}, m AS (SELECT p_size AS module, 'mod' || (p_partkey % 60) || '.' || replace(p_name, ' ', '_') AS id FROM part) SELECT module, count(*)::BIGINT AS known FROM m WHERE id IN (SELECT id FROM comp) GROUP BY module")
def j5_known_module_components(spark, sf_dir):
    name = F.concat(F.lit("mod"), F.col("p_partkey") % 60, F.lit("."), F.replace("p_name", F.lit(" "), F.lit("_")))
    modules = table(spark, sf_dir, "part").select(F.col("p_size").alias("module"), name.alias("id"))
    return modules.join(components(spark, sf_dir).select("id"), "id", "left_semi").groupBy("module").agg(F.count("*").alias("known"))


@query("SELECT s_suppkey, 'o' || (s_suppkey % 9) AS owner, 'r' || s_suppkey || 'hub.io' AS name, 'https://o' || (s_suppkey % 9) || '.github.io/r' || s_suppkey || '.github.io/' AS pages FROM supplier")
def e2_e3_e7_url_parts(spark, sf_dir):
    url = F.concat(F.lit("https://github.com/o"), F.col("s_suppkey") % 9, F.lit("/r"), "s_suppkey", F.lit(".github.io/"))
    parts = urls.owner_and_name(url)
    return table(spark, sf_dir, "supplier").select("s_suppkey", parts["owner"].alias("owner"), parts["name"].alias("name"), urls.pages_url(url).alias("pages"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'rate_limit' WHEN 1 THEN 'authentication' WHEN 2 THEN 'timeout' ELSE 'other' END AS kind FROM events")
def e28_error_classes(spark, sf_dir):
    said = F.element_at(F.array(*map(F.lit, ("HTTP 429: rate limit", "401 Unauthorized", "request timed out", "odd"))), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", text.error_class(said).alias("kind"))


@query(f"WITH {FILES} SELECT path, name LIKE '%.md' AS served FROM files")
def e30_served_documents(spark, sf_dir):
    return files(spark, sf_dir).select("path", text.docs_file_allowed(F.col("path")).alias("served"))


@query("WITH x AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS l FROM orders GROUP BY o_custkey) SELECT o_custkey, array_to_string(l[1:3], ', ') || CASE WHEN len(l) > 3 THEN ' ... and ' || (len(l) - 3) || ' more' ELSE '' END AS shown FROM x")
def e31_first_items(spark, sf_dir):
    lists = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).cast("array<string>").alias("l"))
    return lists.select("o_custkey", text.first_items(F.col("l")).alias("shown"))


@query("SELECT o_orderkey, 'docs/repolith-' || strftime(o_orderdate, '%Y%m%d-%H%M%S') AS branch FROM orders")
def e32_branch_names(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", text.branch_name(F.col("o_orderdate").cast("timestamp")).alias("branch"))


@query("SELECT o_orderkey, o_orderpriority || ' | ' || strftime(o_orderdate, '%Y-%m-%d %H:%M') || ' | ' || left(md5(o_orderkey::VARCHAR), 8) || ' | ' || format('{:,}', o_custkey) || ' components | depth 2' AS panel FROM orders")
def k9_e27_info_panels(spark, sf_dir):
    panel = text.info_panel(F.col("o_orderpriority"), F.col("o_orderdate").cast("timestamp"), F.md5(F.col("o_orderkey").cast("string")), F.col("o_custkey"), F.lit(2))
    return table(spark, sf_dir, "orders").select("o_orderkey", panel.alias("panel"))


@query("SELECT doc_id, CASE WHEN starts_with(text, '# ') THEN trim(string_split(text, chr(10))[1][3:]) ELSE 'Doc ' || doc_id END AS title FROM documents")
def e22_titles(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.title(F.col("text"), F.concat(F.lit("doc_"), "doc_id", F.lit(".md"))).alias("title"))


@query("SELECT c_custkey, c_acctbal >= 2000 AND c_nationkey % 2 = 0 AND c_custkey % 4 < 2 AS delegated FROM customer")
def t10_delegation(spark, sf_dir):
    modules = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") % 2 == 0).alias("complex"), (F.col("c_custkey") % 4).alias("depth"), F.col("c_acctbal").alias("tokens"))
    return tree.delegated(modules, least_tokens=2000).select("c_custkey", "delegated")


@query(f"WITH {STATES} SELECT job_id, status, docs_path FROM s LEFT JOIN (SELECT o_custkey, '/docs/' || o_custkey AS docs_path FROM orders GROUP BY o_custkey) ON o_custkey = job_id")
def w6_status_lookup(spark, sf_dir):
    docs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id")).distinct().withColumn("docs_path", F.concat(F.lit("/docs/"), "job_id"))
    return states_at(spark, sf_dir).join(docs, "job_id", "left").select("job_id", "status", "docs_path")


@query(f"WITH {STATES} SELECT job_id, status FROM s")
def w5_json_round_trip(spark, sf_dir):
    rows = states_at(spark, sf_dir).select("job_id", "status")
    return rows.select(F.from_json(F.to_json(F.struct("*")), rows.schema).alias("r")).select("r.*")


@query("SELECT region.r_name AS path FROM region LEFT JOIN (SELECT r_name FROM region WHERE r_regionkey < 2) d ON d.r_name = region.r_name WHERE d.r_name IS NULL")
def w8_e15_only_missing(spark, sf_dir):
    region = table(spark, sf_dir, "region")
    return region.select(F.col("r_name").alias("path")).join(region.filter("r_regionkey < 2").select(F.col("r_name").alias("path")), "path", "left_anti")


@query("WITH o AS (SELECT o_orderkey % 40 AS line, o_custkey % 80 AS col, o_orderstatus AS problem FROM orders), m AS (SELECT CASE WHEN line > 20 THEN line + 2 ELSE line END AS line, col, problem FROM o WHERE line < 10 OR line > 20) SELECT DISTINCT line, col, problem FROM o WHERE (line, col, problem) NOT IN (SELECT line, col, problem FROM m)")
def j12_new_lint_errors(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 40).alias("line"), (F.col("o_custkey") % 80).alias("col"), F.col("o_orderstatus").alias("problem"))
    return jobs.new_lint_errors(rows, rows, 10, 20, 2).distinct()


@query("SELECT o_custkey AS path, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS content, list(o_totalprice ORDER BY o_orderdate DESC, o_orderkey DESC)[2] AS previous FROM orders GROUP BY o_custkey")
def w7_edit_history(spark, sf_dir):
    edits = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"), F.struct("o_orderdate", "o_orderkey").alias("version"), F.col("o_totalprice").alias("content"))
    return jobs.edit_history(edits).select("path", "content", "previous")


@query("""WITH RECURSIVE p AS (SELECT o_custkey AS path, o_orderkey, o_totalprice, o_orderkey % 5 < 2 AS undo, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders),
s AS (SELECT path, o_orderkey, i, CASE WHEN undo THEN [] ELSE [o_totalprice] END AS stack FROM p WHERE i = 1
  UNION ALL SELECT p.path, p.o_orderkey, p.i, CASE WHEN undo THEN stack[:len(stack) - 1] ELSE list_append(stack, o_totalprice) END FROM s JOIN p ON p.path = s.path AND p.i = s.i + 1)
SELECT path, o_orderkey, len(stack) AS depth, stack[len(stack)] AS shown FROM s""")
def w7_undo_stack(spark, sf_dir):
    kind = F.when(F.col("o_orderkey") % 5 < 2, "undo").otherwise("edit")
    steps = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"), F.struct("o_orderdate", "o_orderkey").alias("version"), kind.alias("kind"), F.col("o_totalprice").alias("content"), "o_orderkey")
    return jobs.undone(steps).select("path", "o_orderkey", F.col("depth").cast("long").alias("depth"), "shown")
