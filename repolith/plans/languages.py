"""Queries on the language analyzers: one source file for each part, spelled from its columns, and its edges and components in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.operators import extract
from repolith.plans.witness import query, table

C = """#include <stdio.h>
static int total_{k} = {n};
int plain_{k};
char *gone_{k};
struct S { int inner; };
int add_{k}(int a) {
  printf("plain_{k}");
  p->total_{k} = a + total_{k};
  return helper_{n}(plain_{k});
}
"""
CPP = """namespace n {
int counter_{k} = 0;
}
class Shape_{k} {
public:
  void draw_{k}(int a) { helper_{k}(); }
};
struct Box_{k} : public Shape_{k} { };
void helper_{k}() { counter_{k} = {n}; }
int run_{k}() {
  Shape_{k}* s = new Shape_{k}();
  s->draw_{k}(1);
  helper_{k}();
  std::sort(s);
  return counter_{k};
}
"""
JS = """// class No_{k} {}
class A_{k} extends B_{n} {
  /** @param {Foo_{n}|string} a
   * @returns {Promise<Bar_{k}, Map>} */
  go() { return 1; }
}
/** @type {Skipped} */
function f_{k}(x, y) {
  return g_{n}('h()');
}
"""
TS = """interface I_{k} { x: string }
enum E_{k} { A, B }
export class A_{k} implements I_{k} {
  m(b: Foo_{n}) { new C_{k}(); }
}
"""
JAVA = """package p;
public abstract class A_{k} extends B_{n} {
  private Foo_{n} foo;
  int run(int a) {
    return foo.help(a);
  }
}
record R_{k}(int a) implements I_{k} { }
"""
CS = """public static class Util_{k} { }
public abstract class Base_{k} { }
public delegate void Handler_{k}(object sender);
class A_{k} : Base_{k} { private Foo_{n} f; }
"""
PY = """class Base_{k}:
    def run(self):
        return helper_{k}(len("x"))

class Child_{k}(Base_{k}):
    def go(self):
        other_{n}.work()

def helper_{k}(x, *, y=0):
    return str(x)
"""


def found(spark, sf_dir, language: str, ext: str, template: str, *kinds: str) -> DataFrame:
    """What the analyzer finds in one file for each part; rows of these ``kinds``, if any are named."""
    content = F.lit(template)
    for name, column in (("{k}", "p_partkey"), ("{n}", "p_size")):
        content = F.replace(content, F.lit(name), F.col(column).cast("string"))
    files = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("file_ord"), F.concat(F.lit("src/p"), "p_partkey", F.lit(ext)).alias("path"), F.lit(language).alias("language"), content.alias("content"),
    )
    return extract.extract(files, kinds) if kinds else extract.extract(files)


def edges(rows: DataFrame) -> DataFrame:
    return extract.edges_of(rows).select("caller", "callee", "call_line", "is_resolved")


def components(rows: DataFrame) -> DataFrame:
    return extract.components_of(rows).select("id", "component_type", "start_line", "end_line", F.array_join("parameters", ",").alias("parameters"), F.array_join("base_classes", ",").alias("bases"))


def _sql(rows: list[tuple], names: str) -> str:
    """Rows of a file as SQL on ``part``: texts hold {k} and {n}, and {m} is the file's module."""
    values = ", ".join("(" + ", ".join("NULL" if v is None else repr(v) if isinstance(v, (str, bool)) else f"{v}::INT" for v in row) + ")" for row in rows)
    columns = [n.strip() for n in names.split(",")]
    spelled = [i for i, _ in enumerate(columns) if any(isinstance(r[i], str) for r in rows)]
    shown = [f"replace(replace(replace({c}, '{{m}}', 'src.p' || p_partkey), '{{k}}', p_partkey::VARCHAR), '{{n}}', p_size::VARCHAR) AS {c}" if i in spelled else c for i, c in enumerate(columns)]
    return f"SELECT {', '.join(shown)} FROM part, (VALUES {values}) v({names})"


EDGES, COMPONENTS = "caller, callee, call_line, is_resolved", "id, component_type, start_line, end_line, parameters, bases"


@query(_sql([("{m}.add_{k}", "{m}.total_{k}", 8, True), ("{m}.add_{k}", "helper_{n}", 9, False), ("{m}.add_{k}", "{m}.plain_{k}", 9, True)], EDGES))
def x7a_c_edges(spark, sf_dir):
    return edges(found(spark, sf_dir, "c", ".c", C))


@query(_sql([("{m}.add_{k}", "function", 6, 10, "a", None)], COMPONENTS))
def x7_c_functions(spark, sf_dir):
    return components(found(spark, sf_dir, "c", ".c", C))


@query(_sql([
    ("{m}.Box_{k}", "Shape_{k}", 8, False), ("{m}.helper_{k}", "counter_{k}", 9, False), ("{m}.run_{k}", "{m}.Shape_{k}", 11, False),
    ("{m}.run_{k}", "{m}.Shape_{k}", 12, False), ("{m}.run_{k}", "{m}.Shape_{k}", 13, False), ("{m}.run_{k}", "counter_{k}", 15, False),
], EDGES))
# A line of the class spells helper with a result type, so that the class counts as its owner.
def x8a_x8b_cpp_edges(spark, sf_dir):
    return edges(found(spark, sf_dir, "cpp", ".cpp", CPP))


@query(_sql([("{m}.Shape_{k}", "class", 4, 7, None, None), ("{m}.Box_{k}", "struct", 8, 8, None, "Shape_{k}"), ("{m}.helper_{k}", "function", 9, 9, "", None), ("{m}.run_{k}", "function", 10, 16, "", None)], COMPONENTS))
def x8_cpp_components(spark, sf_dir):
    return components(found(spark, sf_dir, "cpp", ".cpp", CPP))


@query(_sql([
    ("{m}.A_{k}", "{m}.B_{n}", 2, False), ("{m}.A_{k}", "{m}.Foo_{n}", 2, False), ("{m}.A_{k}", "{m}.Bar_{k}", 2, False),
    ("{m}.A_{k}", "{m}.Foo_{n}", 5, False), ("{m}.A_{k}", "{m}.Bar_{k}", 5, False), ("{m}.f_{k}", "{m}.g_{n}", 9, False),
], EDGES))
def x3d_javascript_edges(spark, sf_dir):
    return edges(found(spark, sf_dir, "javascript", ".js", JS, "edge"))


@query(_sql([("{m}.A_{k}", "class", 2, 6, None, "B_{n}"), ("{m}.f_{k}", "function", 8, 10, "x,y", None)], COMPONENTS))
def x3_javascript_components(spark, sf_dir):
    return components(found(spark, sf_dir, "javascript", ".js", JS, "component"))


@query(_sql([("{m}.I_{k}", "interface", 1, 1, None, None), ("{m}.E_{k}", "enum", 2, 2, None, None), ("{m}.A_{k}", "class", 3, 5, None, "I_{k}"), ("{m}.m", "function", 4, 4, "b", None)], COMPONENTS))
# A method is a component of its bare name, as it stands in no function's body.
def x4_x4d_typescript_components(spark, sf_dir):
    return components(found(spark, sf_dir, "typescript", ".ts", TS, "component"))


@query(_sql([("{m}.A_{k}", "{m}.I_{k}", 3, False), ("{m}.A_{k}", "{m}.Foo_{n}", 4, False), ("{m}.A_{k}", "{m}.C_{k}", 4, False)], EDGES))
def x4b_typescript_edges(spark, sf_dir):
    return edges(found(spark, sf_dir, "typescript", ".ts", TS, "edge"))


@query(_sql([("{m}.A_{k}", "abstract class", 2, 7, None, "B_{n}"), ("{m}.A_{k}.run", "method", 4, 6, "a", None), ("{m}.R_{k}", "record", 8, 8, None, "I_{k}")], COMPONENTS))
def x5_java_components(spark, sf_dir):
    return components(found(spark, sf_dir, "java", ".java", JAVA, "component"))


@query(_sql([("{m}.A_{k}", "{m}.B_{n}", 2, False), ("{m}.R_{k}", "{m}.I_{k}", 8, False), ("{m}.A_{k}", "Foo_{n}", 3, False), ("{m}.A_{k}.run", "Foo_{n}", 5, False)], EDGES))
def x5a_x5b_java_edges(spark, sf_dir):
    return edges(found(spark, sf_dir, "java", ".java", JAVA, "edge"))


@query(_sql([("{m}.Util_{k}", "static class", 1, 1, None, None), ("{m}.Base_{k}", "abstract class", 2, 2, None, None), ("{m}.Handler_{k}", "delegate", 3, 3, None, None), ("{m}.A_{k}", "class", 4, 4, None, "Base_{k}")], COMPONENTS))
def x6_csharp_components(spark, sf_dir):
    return components(found(spark, sf_dir, "csharp", ".cs", CS))


@query(_sql([("{m}.A_{k}", "{m}.Base_{k}", 4, True), ("{m}.A_{k}", "Foo_{n}", 4, False)], EDGES))
def x6a_csharp_edges(spark, sf_dir):
    return edges(found(spark, sf_dir, "csharp", ".cs", CS))


@query(_sql([("{m}.Base_{k}", "class", 1, 3, None, None), ("{m}.Child_{k}", "class", 5, 7, None, "Base_{k}"), ("{m}.helper_{k}", "function", 9, 10, "x", None)], COMPONENTS))
def x2_python_components(spark, sf_dir):
    return components(found(spark, sf_dir, "python", ".py", PY))


@query(_sql([("{m}.Base_{k}", "helper_{k}", 3, False), ("{m}.Child_{k}", "{m}.Base_{k}", 5, True), ("{m}.Child_{k}", "other_{n}.work", 7, False)], EDGES))
def x2c_python_edges(spark, sf_dir):
    return edges(found(spark, sf_dir, "python", ".py", PY))

# Each construct once. These rows were taken from what the analyzers found and then read against the rules, line by line; they pin
# what is found and are no independent derivation.
TS_ALL = """import { Foo_{n} } from "./foo";
export interface Shape extends Base<Foo_{n}> { area(): number; owner: Owner; list?: Array<Item> }
export enum Color { Red = 1, Green }
type Pair<T> = { left: T; right: Foo_{n} };
type Alias = Foo_{n} | Shape
export abstract class Animal_{k}<T extends Foo_{n}> extends Thing implements Shape, Gen<T> {
  private name: Name = makeName();
  constructor(private readonly dep: Dep, b?: string) { super(); this.init(dep); }
  async speak(a: A, cb: (x: X) => void): Promise<Result<Foo_{n}>> {
    const local = new Helper_{k}.Inner<Foo_{n}>();
    function nested() { return Color.Red; }
    class Hidden { run() {} }
    console.log(`t ${fmt(a)}`);
    return local.value;
  }
  abstract later(): void;
  get size(): number { return this.count }
}
export function outer_{k}(x: number, { y }: Opts, ...rest: Rest[]): Out {
  const inner = (z: Z) => z.go();
  return inner(nested2(x));
}
function* gen() { yield outer_{k}(1) }
const arrow = async (p: P, q = 2): Promise<Q> => { await outer_{k}(p); };
const short = v => v.map(w => w.id)
const plain = 5, other = function named() {};
let hidden = arrow;
export default register(plain);
declare module "x" { export function amb(a: Amb): void; }
namespace NS { export const deep = () => outer_{k}(2); export class Kept {} }
"""
JS_ALL = """/** top */
export class A extends B {
  /** @param {Foo_{n}|string} a */
  go(a) { this.run(); this.other(); helper(); return new Z(); }
  run() {}
  field = () => { inField(); };
}
export default function main_{k}(x, y = 2, ...z) {
  const inner = async k => { await load(k); };
  function sub() { inner(1); }
  return main_{k}.call(this, sub());
}
function* gen() { yield* main_{k}(); }
const one = x => x + 1, two = () => 2;
var three = () => 3;
let four = function (a, b) { return one(a) };
const obj = { m() { four(); }, n: () => 1 };
if (one(2)) { two(); }
"""
JAVA_ALL = """package p;
import java.util.List;

@Service(name = "x")
public abstract class Animal_{k}<T extends Foo_{n}> extends Thing implements Shape, Gen<T> {
  private final Name name = new Name();
  private List<Item> items;
  Map<String, Foo_{n}> map, other;
  int count;
  Foo_{n}[] array;
  Outer.Inner scoped;
  public Animal_{k}(Dep dep) { dep.use(); Local l = new Local(); l.go(); }
  @Override
  public <R> Result<R> speak(A a, List<B> b) throws Err {
    Worker w = pool.take();
    w.run();
    {
      Other w = make();
      w.stop();
    }
    w.end();
    for (Row row : rows) { row.read(); }
    row.gone();
    for (It it = x(); it.ok(); it.next()) it.use();
    try (Res res = open()) { res.use(); }
    handlers.each((Event e, Ctx k) -> e.fire(k));
    list.each((Event2 e) -> { e.fire2(); });
    name.print();
    Helper_{k}.help();
    a.param();
    String str = "x"; str.trim();
    if (a < b && c > d) { new Box<Foo_{n}>(); }
    Runnable r = new Runnable() { public void run() { name.inner(); w.late(); } };
    return null;
  }
  abstract void later(int z);
  static class Helper_{k} { Name name2; void help() { name2.a(); name.b(); } }
}
interface Shape extends Base { double area(); Name CONST = null; }
enum Color implements Shape { RED(1), GREEN(2) { void x() {} }; private Paint paint; Color(int i) { } void mix() { paint.mix(); } }
record Point(int x, int y) implements Shape { Point { } int sum() { return x; } }
@interface Marker { String value() default ""; }
class Generic extends Base<Foo_{n}> { }
"""


@query(_sql([
    ('{m}.Shape', 'interface', 2, 2, None, None), ('{m}.Color', 'enum', 3, 3, None, None), ('{m}.Pair', 'type', 4, 4, None, None),
    ('{m}.Alias', 'type', 5, 5, None, None), ('{m}.Animal_{k}', 'class', 6, 18, None, 'Thing,Shape'), ('{m}.speak', 'function', 9, 15, 'a,cb', None),
    ('{m}.size', 'function', 17, 17, '', None), ('{m}.outer_{k}', 'function', 19, 22, 'x', None), ('{m}.gen', 'function', 23, 23, '', None),
    ('{m}.arrow', 'function', 24, 24, 'p,q', None), ('{m}.short', 'function', 25, 25, '', None), ('{m}.register', 'function', 28, 28, '', None),
    ('{m}.deep', 'function', 30, 30, '', None), ('{m}.Kept', 'class', 30, 30, None, None),
], COMPONENTS))
def x4_x4a_typescript_constructs(spark, sf_dir):
    return components(found(spark, sf_dir, "typescript", ".ts", TS_ALL, "component"))


@query(_sql([
    ('{m}.Shape', '{m}.Owner', 2, False), ('{m}.Shape', '{m}.Array', 2, False), ('{m}.Shape', '{m}.Item', 2, False), ('{m}.Pair', '{m}.T', 4, False),
    ('{m}.Pair', '{m}.Foo_{n}', 4, False), ('{m}.Animal_{k}', '{m}.Shape', 6, False), ('{m}.Animal_{k}', '{m}.Name', 7, False),
    ('{m}.Animal_{k}', '{m}.makeName', 7, False), ('{m}.Animal_{k}', '{m}.Dep', 8, False), ('{m}.Animal_{k}', '{m}.this.init', 8, False),
    ('{m}.Animal_{k}', '{m}.init', 8, False), ('{m}.Animal_{k}', '{m}.A', 9, False), ('{m}.Animal_{k}', '{m}.X', 9, False),
    ('{m}.Animal_{k}', '{m}.Promise', 9, False), ('{m}.Animal_{k}', '{m}.Result', 9, False), ('{m}.Animal_{k}', '{m}.Foo_{n}', 9, False),
    ('{m}.Animal_{k}', '{m}.Helper_{k}.Inner', 10, False), ('{m}.Animal_{k}', '{m}.Inner', 10, False), ('{m}.Animal_{k}', '{m}.Red', 11, False),
    ('{m}.Animal_{k}', '{m}.console.log', 13, False), ('{m}.Animal_{k}', '{m}.log', 13, False), ('{m}.Animal_{k}', '{m}.fmt', 13, False),
    ('{m}.Animal_{k}', '{m}.value', 14, False), ('{m}.Animal_{k}', '{m}.count', 17, False), ('{m}.outer_{k}', '{m}.Opts', 19, False),
    ('{m}.outer_{k}', '{m}.Rest', 19, False), ('{m}.outer_{k}', '{m}.Out', 19, False), ('{m}.outer_{k}', '{m}.Z', 20, False),
    ('{m}.outer_{k}', '{m}.z.go', 20, False), ('{m}.outer_{k}', '{m}.go', 20, False), ('{m}.outer_{k}', '{m}.nested2', 21, False),
    ('{m}.gen', '{m}.outer_{k}', 23, False), ('{m}.arrow', '{m}.P', 24, False), ('{m}.arrow', '{m}.Promise', 24, False),
    ('{m}.arrow', '{m}.Q', 24, False), ('{m}.arrow', '{m}.outer_{k}', 24, False), ('{m}.short', '{m}.v.map', 25, False),
    ('{m}.short', '{m}.map', 25, False), ('{m}.short', '{m}.id', 25, False), ('{m}.register', '{m}.register', 28, False),
    ('{m}.deep', '{m}.outer_{k}', 30, False),
], EDGES))
def x4b_typescript_uses(spark, sf_dir):
    return edges(found(spark, sf_dir, "typescript", ".ts", TS_ALL, "edge"))


@query(_sql([
    ('{m}.A', 'class', 2, 7, None, 'B'), ('{m}.main_{k}', 'function', 8, 12, 'x', None), ('{m}.inner', 'function', 9, 9, '', None),
    ('{m}.sub', 'function', 10, 10, '', None), ('{m}.gen', 'function', 13, 13, '', None), ('{m}.one', 'function', 14, 14, '', None),
    ('{m}.four', 'function', 16, 16, 'a,b', None),
], COMPONENTS))
def x3_javascript_constructs(spark, sf_dir):
    return components(found(spark, sf_dir, "javascript", ".js", JS_ALL, "component"))


@query(_sql([
    ('{m}.A', '{m}.B', 2, False), ('{m}.A', '{m}.Foo_{n}', 2, False), ('{m}.A', '{m}.Foo_{n}', 4, False), ('{m}.A', '{m}.other', 4, False),
    ('{m}.A', '{m}.helper', 4, False), ('{m}.A', '{m}.Z', 4, False), ('{m}.A', '{m}.inField', 6, False), ('{m}.inner', '{m}.load', 9, False),
    ('{m}.sub', '{m}.inner', 10, True), ('{m}.main_{k}', '{m}.call', 11, False), ('{m}.main_{k}', '{m}.sub', 11, True),
    ('{m}.gen', '{m}.main_{k}', 13, True), ('{m}.four', '{m}.one', 16, True),
], EDGES))
def x3a_x3b_javascript_uses(spark, sf_dir):
    return edges(found(spark, sf_dir, "javascript", ".js", JS_ALL, "edge"))


@query(_sql([
    ('{m}.Animal_{k}', 'abstract class', 4, 38, None, 'Thing,Shape,Gen'), ('{m}.Animal_{k}.speak', 'method', 13, 35, 'a,b', None),
    ('{m}.Animal_{k}.run', 'method', 33, 33, '', None), ('{m}.Animal_{k}.later', 'method', 36, 36, 'z', None),
    ('{m}.Helper_{k}', 'class', 37, 37, None, None), ('{m}.Helper_{k}.help', 'method', 37, 37, '', None),
    ('{m}.Shape', 'interface', 39, 39, None, 'Base'), ('{m}.Shape.area', 'method', 39, 39, '', None), ('{m}.Color', 'enum', 40, 40, None, 'Shape'),
    ('{m}.Color.mix', 'method', 40, 40, '', None), ('{m}.Point', 'record', 41, 41, None, 'Shape'), ('{m}.Point.sum', 'method', 41, 41, '', None),
    ('{m}.Marker', 'annotation', 42, 42, None, None), ('{m}.Generic', 'class', 43, 43, None, 'Base'),
], COMPONENTS))
def x5_java_constructs(spark, sf_dir):
    return components(found(spark, sf_dir, "java", ".java", JAVA_ALL, "component"))


@query(_sql([
    ('{m}.Animal_{k}', '{m}.Thing', 4, False), ('{m}.Animal_{k}', '{m}.Shape', 4, False), ('{m}.Animal_{k}', '{m}.Gen', 4, False),
    ('{m}.Animal_{k}', 'Name', 6, False), ('{m}.Animal_{k}', 'Local', 12, False), ('{m}.Animal_{k}.speak', 'Worker', 16, False),
    ('{m}.Animal_{k}.speak', 'Other', 19, False), ('{m}.Animal_{k}.speak', 'Worker', 21, False), ('{m}.Animal_{k}.speak', 'Row', 22, False),
    ('{m}.Animal_{k}.speak', 'It', 24, False), ('{m}.Animal_{k}.speak', 'Res', 25, False), ('{m}.Animal_{k}.speak', 'Event', 26, False),
    ('{m}.Animal_{k}.speak', 'Event2', 27, False), ('{m}.Animal_{k}.speak', 'Name', 28, False), ('{m}.Animal_{k}.speak', 'Helper_{k}', 29, False),
    ('{m}.Animal_{k}', 'Box', 32, False), ('{m}.Animal_{k}', 'Runnable', 33, False), ('{m}.Animal_{k}.run', 'Name', 33, False),
    ('{m}.Animal_{k}.run', 'Worker', 33, False), ('{m}.Helper_{k}', 'Name', 37, False), ('{m}.Helper_{k}.help', 'Name', 37, False),
    ('{m}.Color', '{m}.Shape', 40, False), ('{m}.Color', 'Paint', 40, False), ('{m}.Point', '{m}.Shape', 41, False),
], EDGES))
def x5a_x5b_java_scopes(spark, sf_dir):
    return edges(found(spark, sf_dir, "java", ".java", JAVA_ALL, "edge"))
