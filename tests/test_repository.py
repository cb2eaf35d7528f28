"""Source trees: reading, filters, extraction, resolution, against hand-traced results."""

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from repolith.functions import patterns, predicates
from repolith.operators import extract, resolve
from repolith.operators import tree as tree_operators
from repolith.operators.extract import braces, python_source
from repolith.sources import repo, state
from repolith.sources import settings as run_settings

A = '''class Base:
    def run(self):
        return helper(1)

class Child(Base):
    def go(self):
        self.run()
        other.work()

def helper(x, *, y=0):
    """Help."""
    return len(str(x))

def _test_skip():
    helper(2)
'''
B = """class Outer:
    class Inner:
        pass
    def late(self):
        def nested():
            pass
        tail()
"""


def parts(path, content, **options):
    rows = list(python_source.analyze(path, content, **options))
    return [r for r in rows if r["kind"] == "component"], [(r["caller"], r["callee"], r["call_line"], r["is_resolved"]) for r in rows if r["kind"] == "edge"]


def test_python_file():
    components, edges = parts("pkg/a.py", A)
    assert [(c["id"], c["component_type"], c["start_line"], c["end_line"], c.get("parameters"), c["docstring"], c.get("base_classes")) for c in components] == [
        ("pkg.a.Base", "class", 1, 3, None, "", None), ("pkg.a.Child", "class", 5, 8, None, "", ["Base"]), ("pkg.a.helper", "function", 10, 12, ["x"], "Help.", None),
    ]
    assert edges == [
        ("pkg.a.Base", "helper", 3, False), ("pkg.a.Child", "pkg.a.Base", 5, True), ("pkg.a.Child", "self.run", 7, False),
        ("pkg.a.Child", "other.work", 8, False), ("pkg.a._test_skip", "pkg.a.helper", 15, True),
    ]


def test_nested_scopes():
    components, edges = parts("pkg/b.py", B)
    assert [c["id"] for c in components] == ["pkg.b.Outer", "pkg.b.Inner", "pkg.b.late", "pkg.b.nested"] and not edges
    components, edges = parts("pkg/b.py", B, scoped=True)
    assert [c["id"] for c in components] == ["pkg.b.Outer", "pkg.b.Inner"] and edges == [("pkg.b.Outer", "tail", 7, False)]


@pytest.mark.parametrize(
    "language, path, code, ids, edge",
    [
        ("csharp", "p/a.cs", "class B { }\nclass A : B { private Foo f; }", ["p.a.B", "p.a.A"], ("p.a.A", "p.a.B")),
        ("c", "p/a.c", "static int add(int a) {\n  printf(\"x\"); return mul(a);\n}\n", ["p.a.add"], ("p.a.add", "mul")),
        ("cpp", "p/a.cpp", "class S : public T { };\nint twice(int a) { return a; }\nint add(int a) { return twice(a); }", ["p.a.S", "p.a.twice", "p.a.add"], ("p.a.add", "p.a.twice")),
    ],
)
def test_languages_with_braces(language, path, code, ids, edge):
    rows = list(braces.analyzer(language)(path, code))
    assert [r["id"] for r in rows if r["kind"] == "component"] == ids
    assert edge in [(r["caller"], r["callee"]) for r in rows if r["kind"] == "edge"]


def test_global_variables():
    code = "#define Z int q;\nstatic int total = 0;\nint plain, second;\nchar *name = 0;\nchar *gone;\nstruct S { int inner; };\nstruct S origin;\nint proto(int a);\ntypedef int T;\nint f() { int local; return local; }\nnamespace n { int deep; class A { int field; }; }\n"
    assert braces.global_variables(code, True) == {"total", "plain", "name", "origin", "deep"}
    assert braces.global_variables(code, False) == {"total", "plain", "origin", "deep"} and braces.global_variables("", True) == set()


def test_doc_types():
    for comment, types in {
        "/** @param {Foo|string} a @returns {Promise<Bar, Map>} */": ["Foo", "Bar"], "/** @type {?Odd} */": [], "/** @type {A<B>|C} */": ["A", "B", "C"],
        "/** @typedef {Object} Mine */": ["Mine"], "// @interface Face": ["Face"], "/* none */": [],
    }.items():
        assert braces.doc_types(comment) == types


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, body in {"pkg/a.py": A, "pkg/b.py": B, "pkg/__init__.py": "", "tests/x.py": "x = 1", "README.md": "# Hi", "bad.py": "def (", "bin/x.py": "", "_p/q.py": "def q(): helper(1)"}.items():
        os.makedirs(root / os.path.dirname(path), exist_ok=True)
        (root / path).write_text(body)
    (root / "pkg/raw.py").write_bytes(b"# \xff\n")
    os.symlink(root / "pkg/a.py", root / "link.py")
    os.symlink("/etc", root / "outside")
    return str(root)


def test_tree_is_read_whole(spark, tree):
    files = {r.path: r for r in repo.read_tree(spark, tree).collect()}
    assert set(files) == {"README.md", "_p/q.py", "bad.py", "bin/x.py", "pkg/__init__.py", "pkg/a.py", "pkg/b.py", "pkg/raw.py", "tests/x.py"}
    assert files["pkg/raw.py"].content == "# �\n" and [files[p].file_ord for p in sorted(files)] == list(range(9))
    assert {r.path for r in repo.read_tree(spark, tree, patterns.EXCLUDES).collect()} == set(files) - {"tests/x.py", "bin/x.py"}
    assert repo.readme(repo.read_tree(spark, tree)).first()[0] == "# Hi"


def test_filters_reach_the_source(spark, tree, monkeypatch):
    """The same files with and without filters, listed on the driver or in tasks; a file that is left out is not opened."""
    whole = repo.read_tree(spark, tree).cache()
    for few in (1, 2, 1000):
        files = repo.read_tree(spark, tree, driver_folders=few)
        assert [r.path for r in files.orderBy("file_ord").collect()] == [r.path for r in whole.orderBy("file_ord").collect()]
        for test in (
            F.col("path").startswith("pkg/"), F.col("extension") == ".py", F.col("name").isin("a.py", "q.py"), F.col("path").isin("pkg/a.py", "none"), F.col("size_bytes") > 20,
            ~F.col("path").startswith("pkg/") & F.col("path").contains("/"), F.col("name").endswith("x.py") & (F.col("size_bytes") <= 5), F.col("content").startswith("#"), F.col("path").isNull(),
        ):
            assert {tuple(r) for r in files.filter(test).drop("file_ord").collect()} == {tuple(r) for r in whole.filter(test).drop("file_ord").collect()}
    plan = files.filter(F.col("path").startswith("pkg/"))._jdf.queryExecution().executedPlan().toString()
    assert "StartsWith(path, pkg/)" not in plan.split("BatchScan")[0]
    reader = repo._Reader({"path": tree, "driverFolders": "1"})
    left = list(reader.pushFilters([repo.StringStartsWith(("path",), "pkg/"), repo.EqualTo(("extension",), ".py"), repo.EqualTo(("content",), "x")]))
    assert left == [repo.EqualTo(("content",), "x")]
    seen, plain, scan = [], os.open, os.scandir
    monkeypatch.setattr(os, "open", lambda p, *a, **k: seen.append(os.path.relpath(p, tree)) or plain(p, *a, **k))
    monkeypatch.setattr(os, "scandir", lambda p: seen.append(os.path.relpath(p, tree)) or scan(p))
    assert [r[1] for part in reader.partitions() for r in reader.read(part)] == ["pkg/__init__.py", "pkg/a.py", "pkg/b.py", "pkg/raw.py"]
    assert sorted(seen) == [".", "pkg", "pkg/__init__.py", "pkg/a.py", "pkg/b.py", "pkg/raw.py"]


def test_tree_to_dependencies(spark, tree):
    files = repo.read_tree(spark, tree, patterns.EXCLUDES).withColumn("language", predicates.language(F.col("extension"))).filter("language is not null")
    rows = extract.extract(files.repartition(3))
    assert [r.file_path for r in rows.filter("kind = 'error'").collect()] == ["bad.py"]
    components = resolve.latest_components(extract.components_of(rows))
    edges = resolve.first_edges(resolve.resolve_calls(extract.edges_of(rows), components))
    deps = {tuple(r) for r in resolve.dependencies(edges, components).collect()}
    assert deps == {("pkg.a.Base", "pkg.a.helper"), ("pkg.a.Child", "pkg.a.Base"), ("_p.q.q", "pkg.a.helper")}
    graph = {r.id: r.component for r in state.dependency_graph(components.drop("pos"), resolve.dependencies(edges, components)).collect()}
    assert '"depends_on":["pkg.a.helper"]' in graph["pkg.a.Base"]


PATHS = {
    "src/a.py": (True, "python"), "src/testing/a.py": (True, "python"), "tests/a.py": (False, None), "src/env/x.py": (False, None), "bin_utils.py": (False, None),
    "binary/x.py": (False, None), "x.min.js": (False, None), "setup.ini": (False, None), "lib/core.cc": (False, None), "lib/core.hpp": (False, None),
    "node_modules/m/i.js": (True, "javascript"), "README.md": (True, None), "Makefile": (False, None), "pkg/__init__.py": (True, "python"),
}


def test_default_path_filters(spark):
    df = spark.createDataFrame([(p, p.rpartition("/")[2]) for p in PATHS], "path string, name string")
    path, name = F.col("path"), F.col("name")
    got = df.select("path", (predicates.included(path, name) & ~predicates.excluded(path, name)).alias("taken"), predicates.language(predicates.extension(name)).alias("language"))
    for r in got.collect():
        taken, language = PATHS[r.path]
        assert r.taken == taken and (not taken or r.language == language), r


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab*?[]!./", max_size=8), st.text(alphabet="ab./", max_size=8))
def test_globs(pattern, path):
    import re
    from fnmatch import fnmatchcase

    assert bool(re.match(predicates.glob_regex(pattern), path)) == fnmatchcase(path, pattern)


def resolve_model(components, edges):
    """Sequential: the last row of an id in the first one's place; keys overwrite, last segments only fill."""
    latest = {}
    for _, id_, name in components:
        latest[id_] = name
    index = {}
    for id_, name in latest.items():
        index[id_] = id_
        index[name] = id_
        index.setdefault(id_.split(".")[-1], id_)
    out = []
    for caller, callee in edges:
        to = index.get(callee) or index.get(callee.split(".")[-1])
        out.append((caller, to or callee, to is not None))
    return out


def test_resolution_equals_the_sequential_rule(spark):
    rng = random.Random(4)
    word = lambda: rng.choice("abcd")
    for _ in range(4):
        components = [(i, f"{word()}.{word()}", rng.choice([word(), f"{word()}.{word()}"])) for i in range(14)]
        edges = [(word(), rng.choice([word(), f"{word()}.{word()}", f"x.{word()}", "zz"])) for _ in range(30)]
        c = resolve.latest_components(spark.createDataFrame(components, "seq long, id string, name string").repartition(3))
        e = spark.createDataFrame([(i, a, b, 1, False) for i, (a, b) in enumerate(edges)], "seq long, caller string, callee string, call_line int, is_resolved boolean").repartition(3)
        got = [(r.caller, r.callee, r.is_resolved) for r in resolve.resolve_calls(e, c).orderBy("seq").collect()]
        assert got == resolve_model(components, edges)


def test_json_tables(spark, tmp_path):
    path = f"file://{tmp_path}/jobs"
    assert state.completed_jobs(spark, path).count() == 0
    state.write_json(spark.createDataFrame([("a", "completed"), ("b", "failed")], "job_id string, status string"), path)
    assert [r.job_id for r in state.completed_jobs(spark, path).collect()] == ["a"]
    filled = state.filled(spark.createDataFrame([("<{{A}}|{{B}}>",)], "content string"), {"A": "{{B}}", "B": "x"})
    assert filled.first()[0] == "<x|x>"


def test_whole_run(spark, tree, tmp_path):
    from repolith.plans import engine

    out = f"file://{tmp_path}/out"
    analysis = engine.run(spark, tree, out, threshold=1)
    assert {r.id for r in analysis.leaves.collect()} == {"pkg.a.Base", "pkg.a.Child", "pkg.b.Outer", "pkg.b.Inner"}
    s = analysis.summary().first()
    assert (s.files_analyzed, s.components, s.languages) == (6, 8, ["python"])
    docs = {".".join(r.path): r.body for r in spark.read.json(f"{out}/documents").collect()}
    assert docs["pkg/a.py"] == "# pkg/a.py\n- pkg.a.Base (class)\n- pkg.a.Child (class)"
    meta = state.read_metadata(spark, f"{out}/metadata").first()
    assert meta.statistics.total_components == 8 and meta.statistics.leaf_nodes == 4 and "pkg/a.py.md" in meta.files_generated
    before = {tuple(r.path) for r in engine.stored_tree(spark, out).collect()}
    engine.run(spark, tree, out, threshold=10**6)
    assert {tuple(r.path) for r in engine.stored_tree(spark, out).collect()} == before and before
    engine.run(spark, tree, out, threshold=10**6, reuse=False)
    assert engine.stored_tree(spark, out).isEmpty() and engine.stored_tree(spark, f"{out}/none") is None


def test_clients_fall_back(spark):
    from repolith.operators import external

    def broken(prompt):
        raise TimeoutError("late")

    df = spark.createDataFrame([(["a"], "x")], "path array<string>, prompt string")
    assert external.completions(df, [broken, str.upper]).first().reply == "X"
    assert external.completions(df, [broken]).first().error == "TimeoutError: late"


def test_module_tree_texts(spark, tmp_path):
    missing = str(tmp_path / "none.json")
    assert [(r.path, r.components) for r in tree_operators.flattened(state.read_module_tree(spark, missing)).collect()] == [(["Overview"], [])]
    assert state.read_module_tree(spark, missing, overview=False).first().tree is None
    assert tree_operators.flattened(state.read_module_tree(spark, missing, overview=False)).isEmpty()
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text('{"b": {"components": ["x", "y"], "children": {"c": {"components": [], "children": {"d": {"components": ["z"]}}}}}, "a": {}}')
    bad.write_text("{oops")
    rows = tree_operators.flattened(state.read_module_tree(spark, str(good))).collect()
    assert sorted((r.depth, r.name, tuple(r.parent), tuple(r.components)) for r in rows) == [(0, "a", (), ()), (0, "b", (), ("x", "y")), (1, "c", ("b",), ()), (2, "d", ("b", "c"), ("z",))]
    assert state.read_module_tree(spark, str(bad), overview=False).first().tree is None
    with pytest.raises(Exception, match="MALFORMED|oops"):
        state.read_module_tree(spark, str(bad)).collect()


def test_settings():
    env = {"MAIN_MODEL": "m", "LLM_API_KEY": "k"}
    s = run_settings.from_environment("/x/my-repo/", environment=env)
    assert (s.docs_dir, s.graph_dir, s.main_model, s.cluster_model, s.fallback_model, s.api_key) == ("output/docs/my_repo-docs", "output/dependency_graphs", "m", "m", None, "k")
    assert run_settings.given("/x/r", "out", "m", "c").graph_dir == "out/temp/dependency_graphs"


def test_listed_files(spark):
    rows = spark.createDataFrame([("a/x.py", "x.py"), ("a/b/y.PY", "y.PY"), ("a/b/z.py", "z.py"), ("a/.py", ".py"), ("ab/w.py", "w.py")], "path string, name string")
    paths = lambda **options: sorted(r.path for r in repo.with_extensions(rows, **options).collect())
    assert paths(extensions=(".py",)) == ["a/b/z.py", "a/x.py", "ab/w.py"] and paths(extensions=(".py",), folder="a") == ["a/b/z.py", "a/x.py"]
    assert paths(folder="a", recursive=False) == ["a/.py", "a/x.py"] and len(paths()) == 5


def test_jobs_and_caches_as_tables(spark, tmp_path):
    jobs_path, cache_path = str(tmp_path / "jobs"), str(tmp_path / "cache")
    row = spark.range(2).selectExpr("concat('j', id) as job_id", "'u' as repo_url", "if(id = 0, 'completed', 'failed') as status", "timestamp'2026-01-01 00:00:00' as created_at", "cast(null as string) as error_message")
    state.write_json(row, jobs_path)
    assert [(r.job_id, str(r.created_at), r.docs_path) for r in state.completed_jobs(spark, jobs_path).collect()] == [("j0", "2026-01-01 00:00:00", None)]
    entry = spark.range(1).selectExpr("'u' as repo_url", "'h' as repo_url_hash", "'/d' as docs_path", "timestamp'2026-01-01 00:00:00' as created_at", "timestamp'2026-01-02 00:00:00' as last_accessed")
    state.write_json(entry, cache_path)
    assert state.read_cache(spark, cache_path).collect() == entry.collect()
    state.write_texts(spark.createDataFrame([("a.md", "# A\nx"), ("b.md", "")], "name string, content string"), str(tmp_path / "texts"))
    assert {r.content.rstrip("\n") for r in state.read_texts(spark, str(tmp_path / "texts/*/*.txt")).collect()} == {"# A\nx", ""}
