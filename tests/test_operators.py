"""Graphs, trees, jobs, texts and the queries on the driver's tables."""

import os
import random
import re
from datetime import datetime, timedelta, timezone

import duckdb
import pandas as pd
import pytest
import tokenizers
from pyspark.sql import functions as F

from repolith.functions import text, urls
from repolith.operators import external, graph, jobs, resolve, tokens, tree
from repolith.plans import catalog, witness

EDGES = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "e"), ("f", "ghost")]


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame([(x, i) for i, x in enumerate("abcdef")], "id string, ord int"), spark.createDataFrame(EDGES, "src string, dst string")


def test_graph(small):
    nodes, edges = small
    known = edges.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")
    assert {tuple(r) for r in graph.cycles(known).collect()} == {("a", "a"), ("b", "a"), ("c", "a")}
    assert graph.reachable(known).count() == 13
    assert {r.id for r in graph.roots(nodes, known).collect()} == {"f"}
    assert {r.id: r.degree for r in graph.degrees(nodes, known).collect()} == {"a": 2, "b": 2, "c": 3, "d": 1, "e": 1, "f": 0}
    assert [r.id for r in graph.most_connected(nodes, edges, 2).collect()] == ["c", "a"]
    few, between = graph.most_connected_subgraph(nodes, edges, 2)
    assert {r.id for r in few.collect()} == {"a", "c"} and [tuple(r) for r in between.collect()] == [("c", "a")]
    assert graph.most_connected_subgraph(nodes, edges, 9)[1].count() == 5 and [r.id for r in graph.most_connected_subgraph(nodes, edges.limit(0), 2)[0].orderBy("ord").collect()] == ["a", "b"]
    kept, removed = graph.without_cycles(known)
    assert {tuple(r) for r in removed.collect()} == {("c", "a"), ("e", "e")}
    assert {r.id: r.level for r in graph.dependency_levels(nodes, kept).collect()} == {"a": 2, "b": 1, "d": 0, "e": 0, "f": 0, "c": 0} | ({"c": 1, "b": 2, "a": 3} if ("c", "d") in EDGES else {})


def test_reachable_pairs_are_met_once(spark):
    """Hops against a search from each node; on a chain and a cycle a round meets each of its pairs once, not once for every node between."""
    rng = random.Random(3)
    pairs = {(rng.randrange(40), rng.randrange(40)) for _ in range(55)} | {(k, k + 1) for k in range(50, 90)}
    expected = {}
    for start in {a for a, _ in pairs}:
        wave, hops = {b for a, b in pairs if a == start}, 1
        while wave:
            expected |= {(start, x): hops for x in wave}
            wave, hops = {b for a, b in pairs if a in wave} - {b for a, b in expected if a == start}, hops + 1
    got = graph.reachable(spark.createDataFrame(sorted(pairs), "src long, dst long")).collect()
    assert len(got) == len(expected) and {(r.src, r.dst): r.hops for r in got} == expected
    chain = spark.range(100).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(8), 100 - F.col("id")))).alias("hops")).withColumn("dst", F.col("src") + F.col("hops"))
    longer = graph.prolonged(chain, 8)
    assert longer.count() == longer.select("src", "dst").distinct().count() == sum(max(0, min(16, 100 - k) - 8) for k in range(100))


def test_a_single_back_edge_goes_alone(spark):
    """One edge back in a graph of edges that all lead up; a group of nodes without others keeps a leaf."""
    edges = spark.createDataFrame([(a, b) for a in range(6) for b in range(a + 1, 6)] + [(5, 0)], "src long, dst long")
    assert [tuple(r) for r in graph.without_cycles(edges)[1].collect()] == [(5, 0)]
    pair = spark.createDataFrame([("A", "B"), ("B", "A")], "src string, dst string")
    nodes = spark.createDataFrame([("A",), ("B",)], "id string")
    assert [r.id for r in graph.leaves(nodes, graph.without_cycles(pair)[0], threshold=2).collect()] == ["A"]


def test_rings_and_chains(spark):
    """A ring of 30 that leads to one of 7, a chain behind both, and a group whose least id isn't reached first."""
    ring = lambda ids: list(zip(ids, ids[1:] + ids[:1]))
    pairs = ring(list(range(100, 130))) + ring(list(range(7))) + [(110, 3), (5, 200), (5, 5)] + [(i, i + 1) for i in range(200, 212)] + [(300, 301), (301, 300), (301, 1)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    got = {r.id: (r.scc, r.hops) for r in graph.strong_components(edges).collect()}
    assert got == {100 + i: (100, i) for i in range(30)} | {i: (0, i) for i in range(7)} | {300: (300, 0), 301: (300, 1)}
    kept, removed = graph.without_cycles(edges)
    assert {tuple(r) for r in removed.collect()} == {(129, 100), (6, 0), (5, 5), (301, 300)}
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst"))
    level = {r.id: r.level for r in graph.dependency_levels(nodes, kept).collect()}
    assert level[212] == 0 and level[200] == 12 and level[5] == 13 and level[0] == 18 and level[300] == level[301] + 1 == 19
    with pytest.raises(ValueError):
        graph.dependency_levels(nodes, edges)
    none = edges.limit(0)
    assert graph.cycles(none).count() == 0 and graph.dependency_levels(none.select(F.col("src").alias("id")), none).count() == 0


@pytest.mark.parametrize("sizes", [{"most_nodes": 4, "most_edges": 3}, {"most_nodes": 1000, "most_edges": 5}])
def test_blocks_of_a_graph(spark, sizes):
    """Random graphs cut into small blocks, and into one whose edges stand mostly among the others, against plain searches."""
    rng = random.Random(3)
    n = 14
    pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(12)} | {(i, i + 1) for i in range(5)} | {(5, 0), (13, 11), (11, 12), (12, 13)}
    edges = spark.createDataFrame(sorted(pairs), "src long, dst long")
    hops = {a: {a: 0} for a in range(n)}
    for a, seen in hops.items():
        wave = [a]
        while wave:
            wave = list(dict.fromkeys(y for x in wave for p, y in pairs if p == x and y not in seen and not seen.update({y: seen[x] + 1})))
    least = {b: min((a, hops[a][b]) for a in range(n) if b in hops[a]) for b in {x for p in pairs for x in p}}
    assert {r.id: (r.root, r.hops) for r in graph.least_sources(edges, **sizes).collect()} == least
    same = {a: {b for b in range(n) if b in hops[a] and a in hops[b]} for a in range(n)}
    want = {a: (min(x), hops[min(x)][a]) for a, x in same.items() if len(x) > 1}
    assert {r.id: (r.scc, r.hops) for r in graph.strong_components(edges, **sizes).collect()} == want
    acyclic = sorted((a, b) for a, b in pairs if b not in same[a])
    level = dict.fromkeys(range(n), 0)
    for _ in range(n):
        for a, b in acyclic:
            level[a] = max(level[a], level[b] + 1)
    got = graph.dependency_levels(spark.range(n), spark.createDataFrame(acyclic, "src long, dst long"), **sizes)
    assert {r.id: r.level for r in got.collect()} == level
    with pytest.raises(ValueError):
        graph.dependency_levels(spark.range(n), edges, **sizes)


def test_a_long_chain_takes_few_jobs(spark):
    chain = spark.range(9999).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    spark.sparkContext.setJobGroup("chain", "chain")
    assert graph.dependency_levels(spark.range(10_000), chain).agg(F.max("level")).first()[0] == 9999
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain")) < 20
    spark.sparkContext.setJobGroup("ring", "ring")
    ring = chain.union(spark.createDataFrame([(9999, 0)], "src long, dst long"))
    assert graph.strong_components(ring).agg(F.max("hops"), F.count("*")).first() == (9999, 10_000)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("ring")) < 30
    spark.sparkContext.setJobGroup("rest", "rest")


@pytest.mark.parametrize("name", ["words", "bytes"])
def test_tokens_of_joined_texts(spark, name):
    """Counts from parts against the tokenizer on the whole text: words cut anywhere, parts without letters or spaces, empty ones."""
    count, plain = external.approximate_tokens, lambda x: len(re.findall(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]", x))
    if name == "bytes":
        public_tokenizers = pytest.importorskip("public_tokenizers")
        path = public_tokenizers.path("byte_bpe_50k.json")
        plain = lambda x: len(tokenizers.Tokenizer.from_file(path).encode(x, add_special_tokens=False).ids)

        @F.pandas_udf("long")
        def count(texts: pd.Series) -> pd.Series:
            return pd.Series([len(x.ids) for x in tokenizers.Tokenizer.from_file(path).encode_batch(texts.tolist(), add_special_tokens=False)])

    rng = random.Random(8)
    rows = []
    for group in range(6):
        for i in range(40 if group else 1):
            rows.append((group, i, "".join(rng.choice(["word", "don't ", " it's", "  ", "12", "3,", " ", "é ", "\n", "a", "...", " b"] if i % 3 else ["1", " ", "7", ". "]) for _ in range(rng.randrange(9)))))
    table = spark.createDataFrame([*rows, (7, 0, None)], "g int, i int, text string")
    got = {r.g: r.total for r in tokens.totals(tokens.parts(table.repartition(5), count), "g", ["i"], count).collect()}
    assert got == {g: plain("".join(t for x, _, t in rows if x == g)) for g in range(6)} | {7: 0}


def nearest_break(lines, at, step, most, python):
    """The last line of a view that ends at ``at``, by a walk."""
    end = len(lines) if step > 0 else 1
    if at == end:
        return at
    walk = list(range(at, at + step * min(most, abs(end - at)) + step, step))
    options = []
    for k, i in enumerate(walk):
        line, beyond = lines[i - 1], lines[walk[k + 1] - 1] if k + 1 < len(walk) else None
        if python and line.lstrip().startswith(("def ", "class ", "@")):
            options.append((3, i - 1 if step > 0 and k else i))
        elif line == "":
            options.append((2 if beyond == "" else 1, i - 1 if step > 0 and k else i))
        if i in (1, len(lines)):
            options.append((3, i))
    # ``max`` takes the first of equals.
    found = max(options, key=lambda x: x[0])[1] if options else at
    return max(found, at) if step > 0 else min(found, at)


def test_views_end_at_breaks(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        lines = [rng.choice(["", "", "x = 1", "def f():", "  class A:", "@a", "undefined"] if i % 3 else ["x", "y", ""]) for _ in range(rng.randrange(1, 30))]
        first = rng.randrange(1, len(lines) + 1)
        rows.append((i, "\n".join(lines), first, rng.randrange(first, len(lines) + 1), rng.randrange(-1, 12), bool(i % 2)))
    outside = [(400, "a\nb", 0, 1, 3, True), (401, "a\nb", 1, 3, 3, True), (402, "a\nb", 2, 1, 3, True), (403, None, 1, 1, 3, True), (404, "", 1, 1, 3, True)]
    table = spark.createDataFrame(rows + outside, "i int, t string, a int, z int, most int, py boolean")
    view = text.expanded_view(F.col("t"), F.col("a"), F.col("z"), F.col("most"), F.col("py"))
    got = {r.i: r.view and tuple(r.view) for r in table.select("i", view.alias("view")).collect()}
    want = {i: (nearest_break(t.split("\n"), a, -1, m, py), nearest_break(t.split("\n"), z, 1, m, py)) if m > 0 else (a, z) for i, t, a, z, m, py in rows}
    assert got == want | {400: None, 401: None, 402: None, 403: None, 404: (1, 1)}


def test_views_look_at_a_line_once(spark):
    """What the lambdas share is spelled once, as nothing else would compute it once: a line is looked at once in each direction."""
    table = spark.createDataFrame([("a\n\nb", 1, 2, 3, True)], "t string, a int, z int, most int, py boolean")
    view = table.select(text.expanded_view(F.col("t"), F.col("a"), F.col("z"), F.col("most"), F.col("py")).alias("view"))
    assert view._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") == 2


def test_refused_requests_leave_the_job(spark):
    t = datetime(2024, 1, 1)
    at = lambda minutes: t + timedelta(minutes=minutes)
    rows = [(1, at(0), 0, "queued"), (1, at(1), 1, "failed"), (1, at(2), 2, "queued"), (1, at(2.5), 3, "queued"), (1, at(3), 4, "queued"), (1, at(4), 5, "queued"), (1, at(9), 6, "completed"), (1, at(9), 7, "queued")]
    events = spark.createDataFrame(rows, "job_id long, ts timestamp, ord long, status string")
    assert [r.decision for r in jobs.admitted(events).orderBy("ord").collect()] == ["admitted", "cooling", "cooling", "admitted", "running", "admitted"]


def test_call_lists(spark):
    comps = spark.createDataFrame([("m.foo", "foo", "d/m.py", "Does.\nMore"), ("m.xfoo", "xfoo", "d/m.py", ""), ("n.bar", "bar", "n.py", None)], "id string, name string, file_path string, docstring string")
    edges = spark.createDataFrame([(0, "m.xfoo", "n.bar", True), (1, "m.foo", "foo", False), (2, "n.bar", "d/m.py:foo", True), (3, "m.foo", "lost", False)], "seq long, caller string, callee string, is_resolved boolean")
    got = {r.name: (r.file, r.summary, r.calls, r.called_by, r.is_recursive) for r in resolve.call_lists(comps, edges).collect()}
    assert got == {"foo": ("m.py", "Does.", ["n.bar"], ["n.bar"], True), "xfoo": ("m.py", "", ["n.bar"], [], False), "bar": ("n.py", None, ["foo"], ["m.xfoo"], False)}


def test_call_lists_make_their_edges_once(spark):
    """However often the lists read the edges, what made them runs once for each edge."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    comps = spark.createDataFrame([("m.foo", "foo", "m.py", ""), ("n.bar", "bar", "n.py", "")], "id string, name string, file_path string, docstring string")
    edges = spark.createDataFrame([(i, "m.foo", f"x{i}.bar", True) for i in range(20, 0, -1)], "seq long, caller string, callee string, is_resolved boolean")
    got = {r.name: r.calls for r in resolve.call_lists(comps, edges.mapInArrow(counted, edges.schema)).collect()}
    assert got["foo"] == [f"x{i}.bar" for i in range(1, 21)] and seen.value == 20


def test_calls_on_builtins():
    from repolith.operators.extract import python_source

    code = "def f():\n id(1); len(2); str.join(a); str.x.y(); str.x.y.z(); a.b.c.d.e(); g().h.i(); hash(3)\n"
    assert [r["callee"] for r in python_source.analyze("m.py", code) if r["kind"] == "edge"] == ["id", "y", "y.z", "a.b.c.d.e", "h.i", "g", "hash"]


def test_excluded_paths(spark):
    from repolith.functions import predicates

    paths = ["bin/a", "a/bin/b", "binary/x", "x/y.tmp", "y.tmp", "a/b\nc/bin", "keep/z", "deep/er/z", "deep/er", "bin\n"]
    df = spark.createDataFrame([(p, p.split("/")[-1]) for p in paths], "path string, name string")
    hit = [r[0] for r in df.select(predicates.excluded(F.col("path"), F.col("name"), ("bin", "*.tmp", "deep/er/"))).collect()]
    assert hit == [True, True, False, True, True, True, False, True, True, False]


def test_numbers_of_long_texts(spark):
    lines = spark.range(1).select(text.numbered_lines(F.lit("a\nb"), 999_999).alias("t")).first().t
    assert lines == "999999\ta\n1000000\tb"


def test_random_graphs_become_acyclic(spark):
    rng = random.Random(1)
    for n in (5, 20):
        pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(2 * n)}
        nodes, edges = spark.range(n), spark.createDataFrame(list(pairs), "src long, dst long")
        level = {r.id: r.level for r in graph.dependency_levels(nodes, graph.without_cycles(edges)[0]).collect()}
        assert len(level) == n
        reach = {a: {b for x, b in pairs if x == a} for a in range(n)}
        for _ in range(n):
            for a in reach:
                reach[a] |= {c for b in reach[a] for c in reach[b]}
        same = lambda a, b: a == b or (b in reach[a] and a in reach[b])
        assert {tuple(r) for r in graph.cycles(edges).collect()} == {(a, min(b for b in range(n) if same(a, b))) for a in range(n) if any(b != a and same(a, b) for b in range(n))}
        assert all(level[a] > level[b] for a, b in pairs if not same(a, b))


def test_tree_order(spark):
    rows = [(["A"], "A", [], 0, 1), (["B"], "B", [], 0, 2), (["A", "A1"], "A1", ["A"], 1, 1), (["A", "A2"], "A2", ["A"], 1, 2)]
    modules = spark.createDataFrame(rows, "path array<string>, name string, parent array<string>, depth int, ord int")
    assert ["/".join(r.path) for r in tree.post_order(modules).orderBy("place").collect()] == ["A/A1", "A/A2", "A", "B"]
    assert [r.line for r in tree.rendered(modules, ["A"]).orderBy("place").collect()] == ["A (current module)", "  A1", "  A2", "B"]
    none = modules.select("path", F.col("name").alias("body")).limit(0)
    leaf = lambda m: m.select("path", F.col("name").alias("body"))
    parent = lambda m: m.select("path", F.array_join(F.transform("children", lambda c: c["body"]), ",").alias("body"))
    assert {"/".join(r.path): r.body for r in tree.generate(modules, none, leaf, parent).collect()} == {"A": "A1,A2", "B": "B", "A/A1": "A1", "A/A2": "A2"}


def test_replies_are_parsed_not_run(spark):
    rows = [('x<GROUPED_COMPONENTS>{"m": {"path": "p", "components": ["a"]}}</GROUPED_COMPONENTS>',), ("<GROUPED_COMPONENTS>__import__('os')</GROUPED_COMPONENTS>",), ("none",)]
    got = [r[0] for r in spark.createDataFrame(rows, "r string").select(tree.parsed_groups(F.col("r"))).collect()]
    assert got[0]["m"].components == ["a"] and not got[1] and not got[2]


def test_cooldown_and_expiry(spark):
    t = datetime(2024, 1, 1)
    rows = [(1, t, 0, "failed"), (1, t + timedelta(minutes=2, seconds=59), 1, "queued"), (2, t, 0, "failed"), (2, t + timedelta(minutes=3), 1, "queued"), (3, t, 0, "processing"), (3, t + timedelta(days=9), 1, "queued"), (4, t, 0, "queued")]
    events = spark.createDataFrame(rows, "job_id long, ts timestamp, ord long, status string")
    assert {r.job_id: r.decision for r in jobs.admitted(events).collect()} == {1: "cooling", 2: "admitted", 3: "running", 4: "admitted"}
    cache = spark.createDataFrame([("h", t)], "url_hash string, created_at timestamp")
    now = F.lit(t + timedelta(days=365))
    assert jobs.valid_entries(cache, now).count() == 0 and jobs.after_cleanup(cache, now).count() == 1


def test_streamed_admissions_equal_the_batch(spark, tmp_path):
    from repolith.streaming.jobs import admissions

    events = witness.job_events(spark, "/root/testdata/sf0.001")
    events.orderBy("ts").coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/in")
    query = admissions(stream).writeStream.format("memory").queryName("decided").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/check").start()
    query.processAllAvailable()
    query.stop()
    got = {(r.job_id, r.ord, r.decision) for r in spark.table("decided").collect()}
    assert got == {(r.job_id, r.ord, r.decision) for r in jobs.admitted(events).collect()}


def test_state_of_ended_jobs_expires(spark, tmp_path):
    from repolith.streaming.jobs import admissions

    t = datetime(2026, 1, 1)
    batches = [[(1, t, 0, "queued"), (1, t, 1, "failed"), (2, t, 2, "queued")], [(3, t + timedelta(hours=9), 3, "queued")], [(1, t + timedelta(hours=10), 4, "queued"), (2, t + timedelta(hours=10), 5, "queued")]]
    schema, rows = "job_id long, ts timestamp, ord long, status string", []
    os.makedirs(tmp_path / "in")
    query = admissions(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in"), keep_hours=2).writeStream.format("memory").queryName("expiring").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/check").start()
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        query.processAllAvailable()
        rows.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    query.stop()
    # The failed job is gone after the second batch and comes anew with the third; the one that never ended stays.
    assert rows == [2, 2, 3]
    assert {(r.ord, r.decision) for r in spark.table("expiring").collect()} == {(0, "admitted"), (2, "admitted"), (3, "admitted"), (4, "admitted"), (5, "running")}


def test_cached_requests(spark):
    t = datetime(2026, 1, 1)
    rows = [(1, t, 0, "queued"), (1, t + timedelta(days=1), 1, "queued"), (1, t + timedelta(days=366), 2, "queued"), (2, t, 3, "queued"), (2, t + timedelta(days=2), 4, "queued")]
    requests = spark.createDataFrame(rows, "job_id long, ts timestamp, ord long, status string")
    cache = spark.createDataFrame([(1, t), (1, t - timedelta(days=400)), (2, t + timedelta(days=1))], "job_id long, created_at timestamp")
    got = jobs.admitted(jobs.with_cache(requests, cache)).orderBy("ord").collect()
    assert [r.decision for r in got] == ["cached", "cached", "admitted", "admitted", "running"]


def test_texts(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    for key, shown in {"": "Not set", "abcdefgh": "ab...gh", "abcdefghi": "abcd...fghi"}.items():
        assert one(text.masked_key(F.lit(key))) == shown
    for url, clean in {"www.github.com/o/r.git/tree/x": "https://github.com/o/r", "o/r": "https://github.com/o/r", "name": "name", "http://github.com/o/r": "http://github.com/o/r"}.items():
        assert one(urls.sanitized(F.lit(url))) == clean
    assert one(urls.owner_and_name(F.lit("https://github.com/o/my.github.io"))).name == "myhub.io"
    md = "a\nb\n```mermaid\ngraph\n```\n```mermaid\n\n```\n```mermaid\nopen\nend"
    assert [tuple(b) for b in one(text.mermaid_blocks(F.lit(md)))] == [(3, "graph"), (6, ""), (9, "open\nend")]
    assert one(text.replace_once(F.lit("a b a"), F.lit("a"), F.lit("c"))).message == "found 2 times"
    assert one(text.title(F.lit("# Hello\nx"), F.lit("a.md"))) == "Hello" and one(text.title(F.lit("x"), F.lit("my_file.md"))) == "My File"
    assert one(text.first_items(F.array(*map(F.lit, "abcde")))) == "a, b, c ... and 2 more"


def test_editor_texts(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    for raw in ("", "\t", "a\tb", "12345678\tx\t", "a\r\tb\n\t\tc", "no tab\n"):
        assert one(text.tabs_expanded(F.lit(raw))) == raw.expandtabs()
    assert one(text.replace_once(F.lit("a\tb\na b"), F.lit("a"), F.lit("c"))["lines"]) == [1, 2]
    assert one(text.replace_once(F.lit("a\tb"), F.lit("a\tb"), F.lit("c"))["text"]) == "c"
    for line, found in {"x.py:3:4: E1 a: b": ("x.py", 3, 4, "E1 a: b"), "x.py:3:4": ("x.py", 3, 4, ""), "x.py:3: E1": None, "x.py:a:4: E1": None, "": None}.items():
        assert (got := one(text.lint_error(F.lit(line)))) == found or tuple(got) == found
    for seconds, progress, left in ((10, 0, None), (10, 0.5, "10s"), (100, 0.5, "1m 40s"), (3660, 0.5, "1h 1m"), (10, 2.0, "< 1 min"), (3600, 0.5, "60m 0s")):
        assert one(text.eta(F.lit(float(seconds)), F.lit(float(progress)))) == left
    taken = F.array(*map(F.lit, ("b", "b-1", "b-3")))
    assert one(text.unused_name(F.lit("b"), taken)) == "b-2" and one(text.unused_name(F.lit("c"), taken)) == "c"
    assert one(text.unused_name(F.lit("b"), F.array().cast("array<string>"))) == "b"
    for name in ("my_module", "it's 3d_x", "ÉTÉ", ""):
        assert one(text.titled(F.lit(name))) == name.replace("_", " ").title()
    assert one(text.diagram_error(F.lit(2), F.lit(5), F.lit("Error: Parse error on line 3:\nx\ny"))) == "Diagram 2: Parse error on line 8:\nx\ny"
    assert one(text.diagram_error(F.lit(1), F.lit(5), F.lit("odd"))) == "Diagram 1: odd" and one(text.diagram_error(F.lit(1), F.lit(5), F.lit(None).cast("string"))) is None
    page = '<pre><code class="language-mermaid">a &amp;lt; b</code></pre><pre><code class="language-mermaid">open'
    assert one(text.diagram_divs(F.lit(page))) == '<div class="mermaid">a &lt; b</div><pre><code class="language-mermaid">open'


def test_queues_equal_a_sequential_consumer(spark):
    rng = random.Random(3)
    rows = [("q", datetime(2026, 1, 1) + timedelta(seconds=rng.randrange(200)), i, rng.randrange(1, 20)) for i in range(60)]
    requests = spark.createDataFrame(rows, "queue string, ts timestamp, ord long, seconds long")
    free, starts, expected = 0.0, [], {}
    for _, ts, ord_, seconds in sorted(rows, key=lambda r: (r[1], r[2])):
        arrived = ts.replace(tzinfo=timezone.utc).timestamp()
        entered = max(arrived, starts[-4]) if len(starts) >= 4 else arrived
        started = max(arrived, free)
        starts.append(started)
        free = started + seconds
        expected[ord_] = (entered - started, started)
    # One queue in one range, and in many.
    for ranges in (None, 1, 17):
        assert {r.ord: (round(r.entered - r.started, 3), round(r.started, 3)) for r in jobs.queued_runs(requests, 4, ranges).collect()} == expected


def test_undo_equals_a_stack(spark):
    rng = random.Random(6)
    steps = [(path, i, rng.choice(["edit", "undo"]), rng.choice([None, f"c{i}"])) for path in "ab" for i in range(150)]
    got = {(r.path, r.version): (r.depth, r.shown) for r in jobs.undone(spark.createDataFrame(steps, "path string, version int, kind string, content string").repartition(3)).collect()}
    stacks = {"a": [], "b": []}
    for path, version, kind, content in steps:
        stack = stacks[path]
        if kind == "edit":
            stack.append(content)
        elif stack:
            stack.pop()
        assert got[path, version] == (len(stack), stack[-1] if stack else None)


def test_ends_of_ids_against_all_pairs(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("ab.") for _ in range(n))
    ids, names = [word(rng.randint(0, 9)) for _ in range(80)], {word(rng.randint(0, 7)) for _ in range(60)}
    edges = spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "caller string, seq long")
    got = resolve._ends_with(edges, "caller", spark.createDataFrame([(n,) for n in names], "name string")).select("seq", "name").collect()
    assert sorted(map(tuple, got)) == sorted((i, n) for i, x in enumerate(ids) for n in names if n and x.endswith(n))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_queries_equal_their_sql(spark, name):
    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages".split():
        con.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    df = catalog.QUERIES[name](spark, sf_dir)
    expected = con.sql(catalog.SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    flat = lambda rows: sorted((tuple(str(x) for x in r) for r in rows))
    assert flat(tuple(r[c] for c in columns) for r in df.collect()) == flat(tuple(dict(zip(expected.columns, r))[c] for c in columns) for r in expected.fetchall())
