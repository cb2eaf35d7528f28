"""Tables of tokens: nesting against stacks, scopes of variables against a sequential symbol table, languages against hand-traced results."""

import random
import time

import pytest
from pyspark.sql import functions as F

from repolith.operators import extract
from repolith.operators.extract import java, scripts
from repolith.operators.extract.token_arrays import Tokens
from repolith.operators.extract.token_table import back as token_table_back
from repolith.operators.extract.token_table import first_after as token_table_first_after
from repolith.operators.extract.token_table import lexed, token_table, with_enclosing, with_innermost


def files(spark, language, *contents):
    return spark.createDataFrame([(i, f"src/f{i}.x", language, c) for i, c in enumerate(contents)], "file_ord long, path string, language string, content string")


def found(spark, language, code):
    """(components, edges) of one file, without its module."""
    rows = extract.extract(files(spark, language, code)).withColumn("path", F.lit("")).collect()
    bare = lambda x: x.removeprefix("src.f0.x.")
    return {(bare(r.id), r.component_type) for r in rows if r.kind == "component"}, {(bare(r.caller), bare(r.callee)) for r in rows if r.kind == "edge"}


def test_nesting_against_stacks(spark):
    rng = random.Random(4)
    code = "".join(rng.choice("([{)]}ab;") + " " for _ in range(1500))
    tokens = token_table(files(spark, "x", code, "", "a", "}{"), scripts=False)
    marked = with_innermost(with_enclosing(tokens, F.col("at"), "opener"), F.col("text") == "{", F.col("close"), F.col("i"), "brace")
    got = {r.i: (r.opener, r.brace) for r in marked.filter("file_ord = 0").collect()}
    stack, braces, expected = [], [], {}
    rows = lexed(code, False)
    for t in rows:
        while braces and rows[braces[-1]]["close"] < t["i"]:
            braces.pop()
        if t["kind"] == "c":
            stack.pop()
        if t["text"] == "{":
            braces.append(t["i"])
        expected[t["i"]] = (rows[stack[-1]]["at"] if stack else None, braces[-1] if braces else None)
        if t["kind"] == "o":
            stack.append(t["i"])
    assert got == expected and tokens.filter("file_ord = 1").count() == 0


def java_program(rng):
    """Nested blocks that declare and use few names, and the edges by a stack of scopes."""
    lines, expected, scopes, kinds = ["class A { F0 x; F1 y;", "void run() {"], set(), [{"x": "F0", "y": "F1"}, {}], iter(range(10_000))
    for _ in range(120):
        what = rng.randrange(5)
        name = rng.choice("xyz")
        if what == 0 and len(scopes) < 8:
            lines.append(rng.choice(["{", "if (a) {", "while (b < c) {"]))
            scopes.append({})
        elif what == 1 and len(scopes) < 8:
            kind = f"T{next(kinds)}"
            lines.append(f"for ({kind} {name} : all()) {{")
            scopes.append({name: kind})
        elif what == 2 and len(scopes) > 2:
            lines.append("}")
            scopes.pop()
        elif what == 3 and name not in scopes[-1]:
            kind = f"T{next(kinds)}"
            lines.append(f"{kind} {name} = null;" if rng.random() < 0.7 else f"{kind}<String> {name};")
            scopes[-1][name] = kind
        else:
            lines.append(f"{name}.use();")
            kind = next((s[name] for s in reversed(scopes) if name in s), None)
            if kind:
                expected.add((len(lines), kind))
    return "\n".join(lines) + "}" * len(scopes), expected


def test_variables_against_a_symbol_table(spark):
    rng = random.Random(9)
    programs = [java_program(rng) for _ in range(12)]
    rows = extract.edges_of(extract.extract(files(spark, "java", *[p for p, _ in programs]))).filter(F.col("caller").endswith(".A.run")).select("seq.file_ord", "call_line", "callee").collect()
    assert {tuple(r) for r in rows} == {(i, line, kind) for i, (_, expected) in enumerate(programs) for line, kind in expected}


@pytest.mark.parametrize(
    ("language", "code", "components", "edges"),
    [
        ("java", "class A extends B {\n  private Foo foo;\n  int run(int a) { return foo.help(a); }\n}", {("A", "class"), ("A.run", "method")}, {("A", "B"), ("A", "Foo"), ("A.run", "Foo")}),
        ("java", "class A { List<B> b; Map<K, V> m; void go() { new C(); m.get(); String s = b.x(); } }", {("A", "class"), ("A.go", "method")}, {("A", "C")}),
        ("javascript", "// class X {}\nclass A extends B { m() { foo(); } }\nfunction f(a) { g('h()'); }", {("A", "class"), ("f", "function")}, {("A", "B"), ("A", "foo"), ("f", "g")}),
        ("javascript", "/** @type {Before} */\nclass A {\n  /** @param {Foo} a */\n  go(a) { this.go(); return this.stay(a); }\n}\n", {("A", "class")}, {("A", "Foo"), ("A", "stay")}),
        ("javascript", "const f = async x => { g(x) }\nexport default function () { h() }\nvar v = () => 1", {("f", "function")}, {("f", "g")}),
        ("typescript", "interface I { x: string }\nexport class A implements I, J { m() { new C(); } }", {("I", "interface"), ("A", "class"), ("m", "function")}, {("A", "I"), ("A", "C")}),
        ("typescript", "function f() { class Inner { a() {} }\n function g() {}\n type T = U; }", {("f", "function")}, set()),
        ("typescript", "function twice() {}\nfunction f() { const twice = 1; other(twice) }", {("f", "function")}, {("f", "other")}),
        ("typescript", "let x = `a${call(`b`)}`; const f = (a: A): B<C> => a.b.c(`${d()}`)", {("f", "function")}, {("f", "A"), ("f", "B"), ("f", "C"), ("f", "a.b.c"), ("f", "b"), ("f", "c"), ("f", "d")}),
    ],
)
def test_languages(spark, language, code, components, edges):
    assert found(spark, language, code) == (components, edges)


def test_many_functions_in_one_file(spark):
    """20,000 functions, each with a class in its body, which is no component."""
    code = "\n".join(f"function f{i}() {{ class C{i} {{}} g{i}(); }}" for i in range(20_000))
    rows = extract.extract(files(spark, "typescript", code))
    assert rows.groupBy("kind").count().orderBy("kind").collect() == [("component", 20_000), ("edge", 20_000)]


@pytest.mark.parametrize("unit", ['"' + "a" * 1000, "a < ", "/*", "*/", "{", "}", "`${", "/[a", "'\\", "a.", "(a: ", "/** @type {"])
def test_lexing_is_linear(unit):
    began = time.perf_counter()
    tokens = lexed(unit * (300_000 // len(unit)), True)
    assert time.perf_counter() - began < 30 and all(t["close"] is not None for t in tokens if t["kind"] == "o")


def test_own_analyzers_replace_tables(spark, monkeypatch):
    monkeypatch.setattr(extract, "TABLES", dict(extract.TABLES))
    monkeypatch.setattr(extract, "ANALYZERS", dict(extract.ANALYZERS))
    extract.register_analyzer("java", lambda path, content: iter([{"kind": "component", "id": "own", "name": "own"}]))
    assert [r.id for r in extract.extract(files(spark, "java", "class A {}")).collect()] == ["own"]


def test_files_are_dealt_to_tasks(spark):
    """Files of one partition are many tasks' work, and a task passes on many files' rows at a time."""
    one = spark.createDataFrame([(i, f"src/f{i}.c", "c", f"int f{i}(int a) {{ return g(a); }}") for i in range(400)], "file_ord long, path string, language string, content string").coalesce(1)
    rows = extract.extract(one)
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert {(r.id, r.emit_ord) for r in extract.components_of(rows).select("id", "seq.emit_ord").collect()} == {(f"src.f{i}.f{i}", 0) for i in range(400)}
    assert extract.edges_of(rows).count() == 400


@pytest.mark.parametrize("code", ["let x = `\\", "`a${`b\\"])
def test_templates_that_end_in_a_backslash(code):
    assert lexed(code, True)[-1]["kind"] == "s"


def test_arrays_against_windows(spark):
    """Brackets and intervals from arrays of several files at once are those that windows over the token table find."""
    rng = random.Random(8)
    codes = ["".join(rng.choice("([{)]}ab;") + " " for _ in range(200)) for _ in range(6)] + ["", "}"]
    t = Tokens(codes, False)
    c = t.col
    t.put({"opener": t.enclosing(c("i")), "brace": t.innermost(c("text") == "{", c("close"), c("i")), "before": t.back("text"), "semicolon": t.first_after(c("text") == ";", c("i"))})
    columns = ("i", "opener", "brace", "before", "semicolon")
    got = sorted(zip(t.file.tolist(), *(c(n).array.to_pylist() for n in columns)))
    rows = with_innermost(with_enclosing(token_table(files(spark, "x", *codes), scripts=False), F.col("i"), "opener"), F.col("text") == "{", F.col("close"), F.col("i"), "brace")
    rows = rows.withColumns({"before": token_table_back("text"), "semicolon": token_table_first_after(F.col("text") == ";", F.col("i"))})
    assert got == sorted(tuple(r) for r in rows.select("file_ord", *columns).collect())


def test_files_of_tokens_are_one_tables_work(spark):
    """Many files share a task's arrays; their rows don't mix, and code comes with its component."""
    code = "class A {\n  go() { return f(1); }\n}\n/* open"
    rows = extract.extract(files(spark, "javascript", *[f"{code}{i}" if i % 3 else "" for i in range(90)])).filter("kind = 'component'").select("file_ord", "id", "source_code", "file_path").collect()
    assert {tuple(r) for r in rows} == {(i, f"src.f{i}.x.A", code.removesuffix("\n/* open"), f"src/f{i}.x") for i in range(90) if i % 3}
    plan = extract.extract(files(spark, "java", "class A { B b; }"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") <= 8


def plan_of(spark, language, kind, code):
    return extract.extract(files(spark, language, code), (kind,))._jdf.queryExecution().optimizedPlan().toString()


BITS = "` ${ } / /* */ // ' \" \\ ( ) [ ] { } \n => < > : ; , . class function return const /re/g a b1 1.5 é `a${b}c` 'a`' /**@type{Foo}*/ in of ?. ... x/2 )/a".split(" ")


@pytest.mark.parametrize("scripts", [True, False])
def test_pieces_are_the_tokens(scripts):
    """One expression over a text finds the tokens that steps through it find, and levels the brackets that a stack finds."""
    rng = random.Random(3)
    codes = ["".join(rng.choice(BITS) + rng.choice(["", " "]) for _ in range(rng.randrange(40))) for _ in range(3000)] + ["", "}", "`${`${x}`}`/2", "a /* `x` */ / 2", "a /* ` */ / b/c"]
    t = Tokens(codes, scripts)
    names = ("i", "text", "kind", "line", "up", "close", "last")
    got = sorted(zip(t.file.tolist(), *(t.col(n).array.to_pylist() for n in names)))
    assert got == sorted((f, *(x[n] for n in names)) for f, code in enumerate(codes) for x in lexed(code, scripts))


@pytest.mark.parametrize("unit", ['"' + "a" * 1000, "a < ", "/*", "{", "}", "`${", "/[a", "'\\", "/*`*/ ", "a /*c*/ ", "//`\n", "}/", "a/b ", "`a`/", "class A {"])
def test_rules_are_linear(unit):
    began = time.perf_counter()
    for typed in (True, False):
        scripts._found(Tokens([unit * (300_000 // len(unit))], True), ("component", "edge"), typed)
    assert time.perf_counter() - began < 30


def test_uses_of_typescript_are_one_pass(spark):
    """Names of a file are resolved where the file is: no window, no table of what tokens contribute."""
    code = "function a() { b(); b(); c.d(); const e = 1; e(); }\nfunction b() {}"
    plan = plan_of(spark, "typescript", "edge", code)
    # One dealing of the files here, one of those of languages without tables.
    assert not any(x in plan for x in ("Window", "Aggregate", "Join", "parquet")) and plan.count("Repartition") <= 2
    rows = extract.extract(files(spark, "typescript", code, code), ("edge",)).select("file_ord", "kind", "caller", "callee", "call_line").collect()
    assert sorted(map(tuple, rows)) == sorted((i, "edge", f"src.f{i}.x.a", f"src.f{i}.x.{x}", 1) for i in range(2) for x in ("b", "c.d", "d"))


def test_components_of_typescript_without_edges(spark, monkeypatch):
    """Rules of uses aren't looked at for components alone, and the rows are those of both kinds together."""
    code = "export class A<T> extends B implements C { go(x: D, y?) { return x.f(); } }\nconst f = async (p, q = 2) => { f(p); };\n/** a */ enum E { F }"
    both = extract.extract(files(spark, "typescript", code))
    alone = extract.extract(files(spark, "typescript", code), ("component",))
    assert sorted(map(str, alone.collect())) == sorted(map(str, both.filter("kind = 'component'").collect())) and alone.count() == 4
    monkeypatch.delattr(scripts, "_edges")
    assert list(scripts._found(Tokens([code], True), ("component",), True)) == ["component"]



def test_scopes_of_java_are_found_where_the_file_is(spark):
    """Of fields the first of its name and class counts, variables of one method are none of another, and no row is shuffled after the files are dealt."""
    code = "class A { F x; void a() { T x; x.u(); }\nvoid b() { x.u(); }\nclass G { H x; void c() { x.u(); { K x; x.u(); } x.u(); } }\nvoid d() { A.s(); y.u(); } }\nclass L { void e() { x.u(); } }"
    plan = plan_of(spark, "java", "edge", code)
    assert not any(x in plan for x in ("Window", "Aggregate", "Join", "parquet")) and plan.count("Repartition") <= 2
    rows = extract.extract(files(spark, "java", code, code), ("edge",)).select("file_ord", "caller", "callee", "call_line").collect()
    uses = {("A", "F", 1), ("A.a", "T", 1), ("A.b", "F", 2), ("G", "H", 3), ("G.c", "H", 3), ("G.c", "K", 3), ("A.d", "A", 4)}
    assert sorted(map(tuple, rows)) == sorted((i, f"src.f{i}.x.{caller}", callee, line) for i in range(2) for caller, callee, line in uses)



def test_components_of_java_without_edges(spark, monkeypatch):
    code = "abstract class A<T> extends B implements C, D {\n  int go(int a, List<E> b) { return x.f(); }\n  abstract void stop();\n}\nrecord R(int a) { }"
    both = extract.extract(files(spark, "java", code))
    alone = extract.extract(files(spark, "java", code), ("component",))
    assert sorted(map(str, alone.collect())) == sorted(map(str, both.filter("kind = 'component'").collect())) and alone.count() == 4
    plan = plan_of(spark, "java", "component", code)
    assert not any(x in plan for x in ("Window", "Aggregate", "Join", "parquet")) and plan.count("Repartition") <= 2
    monkeypatch.delattr(java, "_variables")
    assert list(java._found(Tokens([code], False), ("component",))) == ["component"]
