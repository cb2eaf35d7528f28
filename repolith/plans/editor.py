"""Queries on editing, diagrams, names, queues and navigation, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from repolith.functions import predicates, text, urls
from repolith.operators import edits, external, graph, jobs, resolve, tokens, tree
from repolith.plans.witness import COMPONENTS, EDGES, EXTS, FILES, TREE, _pick, components, files, module_tree, query, resolved, table
from repolith.sources import repo


@query(f"""WITH t AS (SELECT doc_id, replace(text, '. ', chr(9)) AS whole FROM documents),
c AS (SELECT doc_id, CASE WHEN length(whole) > {text.MOST_CHARS} THEN left(whole, {text.MOST_CHARS}) || '{text.CUT_NOTICE}' ELSE whole END AS cut FROM t),
l AS (SELECT doc_id, unnest(string_split(cut, chr(10))) AS line, generate_subscripts(string_split(cut, chr(10)), 1) AS i FROM c),
p AS (SELECT doc_id, i, string_split(line, chr(9)) AS p FROM l),
x AS (SELECT doc_id, i, array_to_string(list_transform(range(1, len(p) + 1), lambda k: CASE WHEN k < len(p) THEN p[k] || repeat(' ', 8 - length(p[k]) % 8) ELSE p[k] END), '') AS line FROM p)
SELECT doc_id, md5(string_agg(lpad(i::VARCHAR, 6, ' ') || chr(9) || line, chr(10) ORDER BY i)) AS digest FROM x GROUP BY doc_id""")
def e11_editor_output(spark, sf_dir):
    tabbed = F.replace("text", F.lit(". "), F.lit("\t"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.editor_output(tabbed)).alias("digest"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
SELECT doc_id, string_agg(i::VARCHAR, ',' ORDER BY i) AS lines FROM l JOIN documents d USING (doc_id) WHERE contains(line, 'e') AND length(d.text) - length(replace(d.text, 'e', '')) > 1 GROUP BY doc_id""")
def e13_repeated_lines(spark, sf_dir):
    found = text.replace_once(F.col("text"), F.lit("e"), F.lit("f"))["lines"]
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(found, ",").alias("lines")).filter("lines is not null")


@query("SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN 'src/' || event_type || '.py' END AS filename, CASE WHEN event_id % 5 <> 0 THEN (event_id % 400)::INT END AS line, CASE WHEN event_id % 5 <> 0 THEN (user_id % 80)::INT END AS col, CASE WHEN event_id % 5 <> 0 THEN 'E' || (event_id % 9) || ' a: b' END AS problem FROM events")
def x12_lint_lines(spark, sf_dir):
    file = F.concat(F.lit("src/"), "event_type", F.when(F.col("event_id") % 5 == 0, "").otherwise(".py:"))
    line = F.concat(file, F.col("event_id") % 400, F.lit(":"), F.col("user_id") % 80, F.lit(": E"), F.col("event_id") % 9, F.lit(" a: b"))
    return table(spark, sf_dir, "events").select("event_id", text.lint_error(line).alias("e")).select("event_id", "e.*")


@query("""WITH c AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'repo' ELSE 'docs' END AS working_dir, list_extract(['view', 'create', 'str_replace', 'insert', 'undo_edit', 'delete'], (o_orderkey % 6 + 1)::INT) AS command,
CASE WHEN o_custkey % 10 = 0 THEN 'f' ELSE '/f' END || o_custkey AS path, CASE WHEN o_custkey % 2 = 0 THEN 'x' END AS given FROM orders),
f AS (SELECT '/f' || c_custkey AS path, c_nationkey = 0 AS is_dir FROM customer WHERE c_custkey % 4 < 3)
SELECT o_orderkey, CASE WHEN working_dir = 'repo' AND command <> 'view' THEN 'only view is allowed in the repository' WHEN NOT starts_with(c.path, '/') THEN 'not an absolute path'
WHEN is_dir IS NULL AND command <> 'create' THEN 'does not exist' WHEN is_dir IS NOT NULL AND command = 'create' THEN 'already exists' WHEN is_dir AND command <> 'view' THEN 'is a folder'
WHEN command = 'create' AND given IS NULL THEN 'file_text is required for create' WHEN command = 'str_replace' AND given IS NULL THEN 'old_str is required for str_replace'
WHEN command = 'insert' AND given IS NULL THEN 'new_str is required for insert' WHEN command = 'delete' THEN 'no such command' END AS refusal FROM c LEFT JOIN f ON f.path = c.path""")
def e16_checked_commands(spark, sf_dir):
    command = F.element_at(F.array(*map(F.lit, (*edits.COMMANDS, "delete"))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    given = F.when(F.col("o_custkey") % 2 == 0, "x")
    commands = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "repo").otherwise("docs").alias("working_dir"), command.alias("command"),
        F.concat(F.when(F.col("o_custkey") % 10 == 0, "f").otherwise("/f"), "o_custkey").alias("path"),
        given.alias("file_text"), given.alias("old_str"), given.alias("new_str"), F.lit(1).alias("insert_line"),
    )
    there = table(spark, sf_dir, "customer").filter("c_custkey % 4 < 3").select(F.concat(F.lit("/f"), "c_custkey").alias("path"), (F.col("c_nationkey") == 0).alias("is_dir"))
    return edits.checked(commands, there).select("o_orderkey", "refusal")


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'No mermaid diagrams found in the file' WHEN 1 THEN 'All mermaid diagrams in file: ' || p_partkey || '.md are syntax correct'
ELSE 'Mermaid syntax errors found in file: ' || p_partkey || '.md' || repeat(chr(10), 3) || 'Diagram 2: Parse error on line ' || (8 + p_size) || ':' || chr(10) || 'no diagram starts with ' || p_name END AS report FROM part""")
def e20_diagram_reports(spark, sf_dir):
    lead = F.concat(F.lit("# T\n"), F.repeat(F.lit("x\n"), F.col("p_size").cast("int")))
    fence = lambda body: F.concat(F.lit("```mermaid\n"), body, F.lit("\n```\n"))
    good = F.when(F.col("p_partkey") % 3 > 0, fence(F.lit("graph TD\nA-->B"))).otherwise("")
    bad = F.when(F.col("p_partkey") % 3 == 2, fence(F.concat(F.lit("\n"), "p_name"))).otherwise("")
    docs = table(spark, sf_dir, "part").select(F.concat("p_partkey", F.lit(".md")).alias("path"), F.concat(lead, good, bad).alias("content"))
    return edits.diagram_reports(docs).select(F.regexp_extract("path", r"^(\d+)", 1).cast("long").alias("p_partkey"), "report")


@query("SELECT p_partkey, '<p>a</p><div class=\"mermaid\">A --> \"' || p_name || '\" & <b></div><p>' || p_type || '</p>' AS html FROM part")
def e21_diagram_divs(spark, sf_dir):
    html = F.concat(F.lit('<p>a</p><pre><code class="language-mermaid">A --&gt; &quot;'), "p_name", F.lit("&quot; &amp; &lt;b&gt;</code></pre><p>"), "p_type", F.lit("</p>"))
    return table(spark, sf_dir, "part").select("p_partkey", text.diagram_divs(html).alias("html"))


@query("""WITH x AS (SELECT o_orderkey, (o_custkey * 7)::DOUBLE AS e, (o_orderkey % 11)::DOUBLE / 10 AS p FROM orders), r AS (SELECT *, e / p - e AS l FROM x WHERE p > 0)
SELECT x.o_orderkey, CASE WHEN l < 0 THEN '< 1 min' WHEN floor(l / 60) > 60 THEN floor(l / 3600)::BIGINT || 'h ' || (floor(l / 60)::BIGINT % 60) || 'm' WHEN floor(l / 60) > 0 THEN floor(l / 60)::BIGINT || 'm ' || (floor(l)::BIGINT % 60) || 's' ELSE floor(l)::BIGINT || 's' END AS eta
FROM x LEFT JOIN r ON r.o_orderkey = x.o_orderkey""")
def a21_e26_eta(spark, sf_dir):
    seconds, progress = (F.col("o_custkey") * 7).cast("double"), (F.col("o_orderkey") % 11).cast("double") / 10
    return table(spark, sf_dir, "orders").select("o_orderkey", text.eta(seconds, progress).alias("eta"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts)::DOUBLE / 1000000 AS a, (event_id % 900 + 1)::BIGINT AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
q AS (SELECT user_id, event_id, i, a, a AS started, a + s AS finished FROM e WHERE i = 1
UNION ALL SELECT e.user_id, e.event_id, e.i, e.a, greatest(e.a, q.finished), greatest(e.a, q.finished) + e.s FROM q JOIN e ON e.user_id = q.user_id AND e.i = q.i + 1)
SELECT event_id, round((greatest(a, lag(started, 3) OVER (PARTITION BY user_id ORDER BY i)) * 1000))::BIGINT AS entered, round(started * 1000)::BIGINT AS started, round(finished * 1000)::BIGINT AS finished FROM q""")
def w1_queued_runs(spark, sf_dir):
    requests = table(spark, sf_dir, "events").select(F.col("user_id").alias("queue"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("ord"), (F.col("event_id") % 900 + 1).alias("seconds"))
    out = jobs.queued_runs(requests, capacity=3)
    return out.select(F.col("ord").alias("event_id"), *(F.round(F.col(c) * 1000).cast("long").alias(c) for c in ("entered", "started", "finished")))


def listed_tree(spark, sf_dir):
    """The module tree with components: of a nation its suppliers, of every other region the region itself."""
    none = F.array().cast("array<string>")
    names = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list("s_name")).alias("names"))
    modules = module_tree(spark, sf_dir).join(names, (F.col("depth") == 1) & (F.col("ord") == F.col("s_nationkey")), "left")
    own = F.when((F.col("depth") == 0) & (F.col("ord") % 2 == 0), F.array("name"))
    return modules.withColumn("components", F.coalesce("names", own, none)).drop("s_nationkey", "names")


@query(f"""WITH {TREE}, s AS (SELECT n_name, string_agg(s_name, ', ' ORDER BY s_name) AS names FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name),
r AS (SELECT tree.*, CASE WHEN depth = 1 THEN coalesce(names, '') WHEN k::BIGINT % 2 = 0 THEN name ELSE '' END AS listed FROM tree LEFT JOIN s ON n_name = name AND depth = 1),
l AS (SELECT k, 0 AS part, repeat('  ', 2 * depth) || name || CASE WHEN p = 'ASIA' THEN ' (current module)' ELSE '' END AS line FROM r
UNION ALL SELECT k, 1, repeat('  ', 2 * depth + 1) || ' Core components: ' || listed FROM r UNION ALL SELECT k, 2, repeat('  ', 2 * depth + 1) || ' Children:' FROM r WHERE p IN (SELECT parent FROM tree))
SELECT row_number() OVER (ORDER BY k, part)::BIGINT AS place, line FROM l""")
def t2_outlined_tree(spark, sf_dir):
    return tree.outlined(listed_tree(spark, sf_dir), ["ASIA"])


@query("""WITH n AS (SELECT r_name AS section, r_name AS name, 1 AS level, r_regionkey AS a, -1 AS b, r_regionkey % 2 = 0 AS linked FROM region
UNION ALL SELECT r_name, n_name, 2, r_regionkey, n_nationkey, true FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT section, array_to_string(list_transform(string_split(replace(lower(name), '_', ' '), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title, CASE WHEN linked THEN '/' || name || '.md' END AS href, level, name = 'NATION_8' AS active, row_number() OVER (ORDER BY a, b)::BIGINT AS place FROM n""")
def t15_navigation(spark, sf_dir):
    return tree.navigation(listed_tree(spark, sf_dir), "NATION_8.md")


@query("""SELECT c_mktsegment AS path, count(*)::BIGINT AS components FROM customer GROUP BY 1
UNION ALL SELECT c_mktsegment || '/' || (c_custkey % 2), count(*) FROM customer GROUP BY 1
UNION ALL SELECT c_mktsegment || '/' || (c_custkey % 2) || '/' || (c_custkey % 4), count(*) FROM customer GROUP BY 1""")
def t1_nested_groups(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("id"), "c_mktsegment")
    names = customers.select("id", F.array("c_mktsegment", (F.col("c_custkey") % 2).cast("string"), (F.col("c_custkey") % 4).cast("string")).alias("names"))
    # Below the third level every group has one name left, so that each branch ends by itself.
    group = lambda members: members.join(names, "id").select("path", "id", F.element_at("names", F.least(F.size("path") + 1, F.lit(3))).alias("name"))
    out = tree.cluster(customers.select("id", F.col("id").alias("text")), lambda t: F.length(t), group, threshold=0)
    return out.select(F.array_join("path", "/").alias("path"), F.size("components").cast("long").alias("components"))


@query(f"WITH {FILES} SELECT path FROM files WHERE regexp_extract(name, '(\\.[^.]*)$', 1) IN ('.py', '.js', '.TSX') AND path LIKE 'src/%'")
def s8_listed_files(spark, sf_dir):
    return repo.with_extensions(files(spark, sf_dir), (".py", ".js", ".TSX"), "src").select("path")


@query(r"""SELECT source, sum(length(text))::BIGINT AS n_chars, len(regexp_extract_all(string_agg(text, '' ORDER BY doc_id), '\w+|[^\w\s]'))::BIGINT AS n_tokens
FROM documents GROUP BY source""")
def t12_tokens_of_joined_texts(spark, sf_dir):
    """The tokens of each source's documents, joined by id: no task holds a source."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    counts = tokens.totals(tokens.parts(docs, external.approximate_tokens), "source", ["doc_id"], external.approximate_tokens)
    chars = docs.groupBy("source").agg(F.sum(F.length("text")).alias("n_chars"))
    return counts.join(chars, F.equal_null(counts["source"], chars["source"])).select(counts["source"], "n_chars", F.col("total").alias("n_tokens"))


@query("SELECT 'b=' || (p_partkey % 20) || '/s=' || (p_size % 10) AS folder, count(*) AS n_parts, sum(length(p_name))::BIGINT AS n_chars FROM part WHERE (p_partkey % 20)::VARCHAR LIKE '1%' GROUP BY 1")
def s1_s8_tree_of_parts(spark, sf_dir):
    """Parts written as a tree of texts, then read as one: no task lists folders of other numbers, and sums of blocks aren't opened."""
    root = graph.new_path(spark)
    parts = table(spark, sf_dir, "part").select(F.col("p_name").alias("value"), (F.col("p_partkey") % 20).alias("b"), (F.col("p_size") % 10).alias("s"))
    parts.repartition("b", "s").write.partitionBy("b", "s").text(root)
    listed = repo.with_extensions(repo.read_tree(spark, root.removeprefix("file:").replace("///", "/"), driver_folders=8), (".txt",)).filter(F.col("path").startswith("b=1"))
    lines = listed.select(F.regexp_extract("path", "^(.*)/", 1).alias("folder"), F.explode(F.split(F.rtrim("content", F.lit("\n")), "\n")).alias("line"))
    return lines.groupBy("folder").agg(F.count("*").alias("n_parts"), F.sum(F.length("line")).alias("n_chars"))


@query(r"""WITH d AS (SELECT doc_id, string_split(replace(replace(text, ' a', chr(10) || chr(10)), ' t', chr(10) || '@t'), chr(10)) AS p FROM documents),
w AS (SELECT doc_id, p, len(p) AS n, doc_id % len(p) + 1 AS a, least(len(p), doc_id % len(p) + 6) AS z, doc_id % 40 AS most, doc_id % 2 = 0 AS py FROM d),
s AS (SELECT *, -1 AS dir, a AS cur, least(most, a - 1) AS room FROM w UNION ALL SELECT *, 1, z, least(most, n - z) FROM w),
k AS (SELECT *, unnest(generate_series(0, room)) AS k FROM s),
l AS (SELECT *, cur + dir * k AS i, p[cur + dir * k] AS line, CASE WHEN k < room THEN p[cur + dir * (k + 1)] END AS following FROM k),
r AS (SELECT *, CASE WHEN py AND regexp_matches(line, '^\s*(def\s+|class\s+|@)') THEN 3 WHEN line <> '' THEN 0 WHEN following = '' THEN 2 ELSE 1 END AS score FROM l),
e AS (SELECT *, CASE WHEN i IN (1, n) THEN 3 ELSE score END AS best, CASE WHEN dir = 1 AND k > 0 AND NOT (score < 3 AND i IN (1, n)) THEN i - 1 ELSE i END AS stop FROM r),
q AS (SELECT doc_id, dir, cur, best, stop, row_number() OVER (PARTITION BY doc_id, dir ORDER BY best DESC, k) AS place FROM e),
t AS (SELECT doc_id, dir, CASE WHEN best = 0 THEN cur WHEN dir = 1 THEN greatest(stop, cur) ELSE least(stop, cur) END AS stop FROM q WHERE place = 1)
SELECT d.doc_id, u.stop::INT AS first_line, v.stop::INT AS last_line FROM documents d LEFT JOIN t u ON u.doc_id = d.doc_id AND u.dir = -1 LEFT JOIN t v ON v.doc_id = d.doc_id AND v.dir = 1""")
def e17_expanded_views(spark, sf_dir):
    lines = F.replace(F.replace("text", F.lit(" a"), F.lit("\n\n")), F.lit(" t"), F.lit("\n@t"))
    n = F.size(F.split("lines", "\n"))
    docs = table(spark, sf_dir, "documents").select("doc_id", lines.alias("lines")).withColumn("n", n).withColumn("a", F.col("doc_id") % F.col("n") + 1)
    view = text.expanded_view(F.col("lines"), F.col("a"), F.least("n", F.col("a") + 5), F.col("doc_id") % 40, F.col("doc_id") % 2 == 0)
    return docs.select("doc_id", view.alias("view")).select("doc_id", F.col("view.first").alias("first_line"), F.col("view.last").alias("last_line"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 THEN 'caf' || chr(195) || chr(169) || chr(255) || p_name ELSE 'caf' || chr(233) || chr(10) || p_name END AS content FROM part")
def s12_decoded_files(spark, sf_dir):
    starts = {0: "636166C3A90D0A", 1: "636166C3A9FF", 2: "636166E90D"}  # UTF-8; neither; Latin-1
    raw = [F.when(F.col("p_partkey") % 3 == k, F.concat(F.unhex(F.lit(v)), F.col("p_name").cast("binary"))) for k, v in starts.items()]
    return table(spark, sf_dir, "part").select("p_partkey", text.decoded(F.coalesce(*raw)).alias("content"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'method' WHEN p_partkey % 3 = 0 THEN 'abstract class' WHEN p_partkey % 3 = 1 THEN 'delegate' ELSE 'function' END AS kind FROM part")
def f25_component_types(spark, sf_dir):
    node = F.element_at(F.array(*map(F.lit, ("abstract class", "delegate", "variable"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", predicates.component_type(F.col("p_size") % 2 == 0, node).alias("kind"))


@query(f"SELECT doc_id, coalesce(list_extract(['python', 'javascript', 'typescript', 'java', 'csharp', 'c', 'cpp', 'cpp', 'markdown'], (doc_id % 12 + 1)::INT), '') AS fence, {_pick(EXTS, 'doc_id % 12')} AS ext FROM documents")
def e29_fence_languages(spark, sf_dir):
    ext = F.element_at(F.array(*map(F.lit, EXTS)), (F.col("doc_id") % 12 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", text.fence_language(ext).alias("fence"), ext.alias("ext"))


@query("""WITH o AS (SELECT o_custkey, 'b' || (o_custkey % 5) AS name, list(CASE WHEN o_orderkey % 2 = 0 THEN 'b' || (o_custkey % 5) ELSE 'b' || (o_custkey % 5) || '-' || (o_orderkey % 4) END) AS taken FROM orders GROUP BY o_custkey)
SELECT o_custkey, CASE WHEN NOT list_contains(taken, name) THEN name ELSE name || '-' || list_min(list_filter(range(1, 9), lambda i: NOT list_contains(taken, name || '-' || i))) END AS branch FROM o""")
def e32_unused_names(spark, sf_dir):
    name = F.concat(F.lit("b"), F.col("o_custkey") % 5)
    taken = F.when(F.col("o_orderkey") % 2 == 0, name).otherwise(F.concat(name, F.lit("-"), F.col("o_orderkey") % 4))
    rows = table(spark, sf_dir, "orders").select("o_custkey", name.alias("name"), taken.alias("taken")).groupBy("o_custkey", "name").agg(F.collect_set("taken").alias("taken"))
    return rows.select("o_custkey", text.unused_name(F.col("name"), F.col("taken")).alias("branch"))


@query(f"WITH {TREE} SELECT p AS path, depth, (row_number() OVER (PARTITION BY parent, depth ORDER BY k) - 1)::INT AS ord, CASE WHEN depth = 1 THEN name ELSE '' END AS components FROM tree")
def s13_flattened_tree(spark, sf_dir):
    """A nested tree in one JSON text: regions with their nations, each the one component of itself."""
    none = F.array().cast("array<string>")
    leaf = F.struct(F.array("name").alias("components"), F.lit("{}").alias("children"))
    children = module_tree(spark, sf_dir).filter("depth = 1").groupBy(F.get("parent", F.lit(0)).alias("name")).agg(F.array_sort(F.collect_list(F.struct("ord", "name", leaf.alias("leaf")))).alias("all"))
    quoted = lambda parts: F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}"))
    below = quoted(F.transform("all", lambda x: F.concat(F.lit('"'), x["name"], F.lit('": {"components": ["'), x["name"], F.lit('"]}'))))
    top = module_tree(spark, sf_dir).filter("depth = 0").join(children, "name", "left")
    line = F.concat(F.lit('"'), "name", F.lit('": {"description": "x", "children": '), F.coalesce(below, F.lit("{}")), F.lit("}"))
    trees = top.agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("lines")).select(quoted(F.transform("lines", lambda x: x["line"])).alias("tree"))
    return tree.flattened(trees).select(F.array_join("path", "/").alias("path"), "depth", "ord", F.array_join(F.coalesce("components", none), ",").alias("components"))


@query(f"""WITH {COMPONENTS}, m AS (SELECT p_size AS module, p_partkey AS ord, 'mod' || (p_partkey % 60) || '.' || replace(p_name, ' ', '_') AS id FROM part),
n AS (SELECT module, ord, m.id, file_path FROM m JOIN comp ON comp.id = m.id),
b AS (SELECT module, file_path, min(ord) AS first, '# File: ' || file_path || chr(10) || chr(10) || '## Core Components in this file:' || chr(10) || string_agg('- ' || id || chr(10), '' ORDER BY ord) || chr(10) || '## File Content:' || chr(10) || '```python' || chr(10)
|| CASE WHEN file_path LIKE '%3.py' THEN '# Error reading file' || chr(10) ELSE 'x of ' || file_path END || '```' || chr(10) || chr(10) AS block FROM n GROUP BY module, file_path)
SELECT module, md5(string_agg(block, '' ORDER BY first)) AS digest FROM b GROUP BY module""")
def a12_source_prompts(spark, sf_dir):
    name = F.concat(F.lit("mod"), F.col("p_partkey") % 60, F.lit("."), F.replace("p_name", F.lit(" "), F.lit("_")))
    members = table(spark, sf_dir, "part").select(F.col("p_size").alias("path"), F.col("p_partkey").alias("ord"), name.alias("id"))
    known = components(spark, sf_dir)
    texts = known.select(F.col("file_path").alias("path")).distinct().filter("path not like '%3.py'").withColumn("content", F.concat(F.lit("x of "), "path"))
    return external.source_prompts(members, known, texts).select(F.col("path").alias("module"), F.md5("sources").alias("digest"))


@query(f"""WITH {COMPONENTS}, {EDGES} SELECT '{{"data":{{"id":"' || id || '","label":"' || name || '"}},"classes":"' || CASE component_type WHEN 'method' THEN 'node-method' ELSE 'node-function' END || ' lang-python"}}' AS element FROM comp
UNION ALL SELECT '{{"data":{{"id":"' || caller || '->' || callee || '","source":"' || caller || '","target":"' || callee || '"}},"classes":"edge-call"}}' FROM deduped WHERE is_resolved""")
def g8_view_json(spark, sf_dir):
    return graph.elements(components(spark, sf_dir), resolve.first_edges(resolved(spark, sf_dir)))


@query("""SELECT p_partkey, p_partkey % 5 < 2 AS url_ok, p_size >= 10 AS key_ok, p_size % 2 = 1 AS model_ok, p_partkey % 3 <> 0 AND p_size % 4 <> 0 AS kept, NOT p_partkey % 3 = 1 AS counted FROM part""")
def f10_f12_f27_checks(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size").cast("int")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))
    url = pick(("https://host.example/v1", "http://localhost:4000/", "http://host.example/", "ftp://localhost/", "https:///v1"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", predicates.valid_url(url).alias("url_ok"), predicates.valid_api_key(F.concat(F.lit(" "), F.repeat(F.lit("k"), size))).alias("key_ok"),
        predicates.valid_model_name(F.when(size % 2 == 1, "m").otherwise("  ")).alias("model_ok"),
        predicates.typescript_node_included(pick(("Constructor", "go", "run")), F.when(size % 4 == 0, "variable").otherwise("function")).alias("kept"),
        predicates.python_function_included(pick(("run", "_test_run", "test_run"))).alias("counted"),
    )


@query("SELECT s_suppkey, 'https://github.com/o' || s_suppkey || '/r/compare/docs-' || s_nationkey || '?expand=1' AS url, 'o' || s_suppkey || '/r' AS full_name FROM supplier")
def e5_e7_compare_urls(spark, sf_dir):
    url = F.concat(F.lit("https://github.com/o"), "s_suppkey", F.lit("/r.git"))
    job = urls.job_id(urls.repo_info(url)["full_name"])
    return table(spark, sf_dir, "supplier").select("s_suppkey", urls.compare_url(url, F.concat(F.lit("docs-"), "s_nationkey")).alias("url"), urls.full_name(job).alias("full_name"))
