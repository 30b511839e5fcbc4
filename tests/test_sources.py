"""Sources and the incremental index."""

import json

import pytest
from pyspark.sql import functions as F

from lodegraph.sources import artifacts, python_source
from lodegraph.streaming import incremental

SOURCE = '''import os
from a.b import c

class Base(Thing):
    """doc"""
    @staticmethod
    def run(x, y=1) -> int:
        """run it"""
        return helper(x)

    async def go(self):
        self.run(1)
        def inner():
            return os.getcwd()
        return inner

def top():
    for i in range(3):
        Base().go()
'''


def test_parse_python(spark):
    files = spark.createDataFrame([("/p/pkg/mod.py", SOURCE), ("/p/bad.py", "def ("), ("/p/gone.py", None)], "path string, content string")
    nodes, edges = python_source.split_rows(python_source.parse_sources(files, "/p"))
    got = {r.id: r for r in nodes.collect()}
    assert sorted(got) == ["pkg.mod.Base", "pkg.mod.Base.go", "pkg.mod.Base.go.<locals>.inner", "pkg.mod.Base.run", "pkg.mod.top"]
    assert got["pkg.mod.Base.run"].decorators == ["staticmethod"] and got["pkg.mod.Base.run"].signature == "def run(x, y=1) -> int" and got["pkg.mod.Base.run"].name == "Base.run"
    assert got["pkg.mod.Base.go"].is_async == 1 and got["pkg.mod.Base.run"].docstring == "run it"
    pairs = {(r.caller_id, r.callee_id, r.edge_type) for r in edges.collect()}
    assert {("pkg.mod.Base.run", "helper", "calls"), ("pkg.mod.Base.go", "run", "calls"), ("pkg.mod.Base", "Thing", "inherits"), ("pkg.mod", "os", "imports"), ("pkg.mod", "a.b.c", "imports"), ("pkg.mod.Base.go.<locals>.inner", "os.getcwd", "calls")} <= pairs


def test_parse_scoped(spark):
    files = spark.createDataFrame([("/x.go", "type A struct\nfunc One(a int) {\n  two(a)\n  if (x) {}\n}\nfunc two() {}\n")], "path string, content string")
    nodes, edges = python_source.split_rows(python_source.parse_sources(files))
    assert sorted(r.id for r in nodes.collect()) == ["x.One", "x.two"]
    assert [(r.caller_id, r.callee_id) for r in edges.collect()] == [("x.One", "two")]


def test_language_and_estimate(spark):
    files = spark.createDataFrame([("/a.go", "func a() {}"), ("/b.go", ""), ("/c.py", "def f():\n  pass\ndef g(): pass")], "path string, content string")
    assert python_source.dominant_language(files).first()[0] == "python"
    assert tuple(python_source.estimate(files).first()) == (3, 3, 0, 5, 5)


def test_read_sources(spark, tmp_path):
    for name in ("a.py", "node_modules/x.js", "b.txt", "sub/c.ts"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    got = python_source.read_sources(spark, str(tmp_path)).select(F.substring_index("path", "/", -1)).collect()
    assert sorted(r[0] for r in got) == ["a.py", "c.ts"]


def test_lockfiles(spark, tmp_path):
    lines = spark.createDataFrame([("Foo_Bar==1.2 # x",), ("baz[extra]==2.0;python_version>'3'",), ("# no",), ("open>=1",)], "value string")
    assert sorted(map(tuple, artifacts.read_requirements(lines).collect())) == [("baz", "2.0"), ("foo-bar", "1.2")]
    toml = spark.createDataFrame([('[[package]]\nname = "A.b"\nversion = "3"\n[[package]]\nname = "c"\nversion = "4"\n',)], "value string")
    assert sorted(map(tuple, artifacts.read_toml_lock(toml).collect())) == [("a-b", "3"), ("c", "4")]
    (tmp_path / "p.json").write_text(json.dumps({"packages": {"": {"version": "0"}, "node_modules/x": {"version": "1"}, "node_modules/x/node_modules/@s/y": {"version": "2"}}}))
    assert sorted(map(tuple, artifacts.read_package_lock(spark, str(tmp_path / "p.json")).collect())) == [("@s/y", "2"), ("x", "1")]
    empty = spark.createDataFrame([], "library string, version string")
    assert artifacts.first_source([empty, artifacts.read_toml_lock(toml), artifacts.read_requirements(lines)]).count() == 2


def test_symbols_and_log(spark, tmp_path):
    doc = {"documents": [{"relativePath": "a.py", "symbols": [{"symbol": "scip-python python numpy 1.23.5 numpy/`array`().", "documentation": ["d"], "relationships": []}]}]}
    (tmp_path / "s.json").write_text(json.dumps(doc))
    row = artifacts.read_symbols(spark, str(tmp_path / "s.json")).first()
    assert (row.file, row.library, row.name) == ("a.py", "numpy", "numpy.array")
    (tmp_path / "log").write_text("\x1e".join(["h1\x1fp\x1f2024\x1ffix a\x1f\na.py\nb.py\n", "h2\x1fp q\x1f2024\x1fmerge\x1f\nc.py\n", "h3\x1f\x1f2024\x1fadd\x1f\nd.py"]))
    assert sorted((r.commit_hash, r.file) for r in artifacts.read_git_log(spark, str(tmp_path / "log")).collect()) == [("h1", "a.py"), ("h1", "b.py"), ("h3", "d.py")]


def test_stream_equals_batch(spark, tmp_path):
    schema = "path string, content string"
    one = [("/m.py", "def a():\n    b()\n\ndef b():\n    pass\n"), ("/n.py", "def c():\n    pass\n")]
    two = [("/m.py", "def a():\n    b()\n\ndef b():\n    return 1\n"), ("/n.py", None)]
    nodes, edges = python_source.split_rows(python_source.parse_sources(spark.createDataFrame(one, schema)))
    nodes = nodes.withColumn("summary", F.concat(F.lit("about "), "name"))
    after, calls, delta = incremental.apply_changes(nodes, edges, spark.createDataFrame(two, schema))
    assert sorted((r.id, r.summary) for r in after.collect()) == [("m.a", "about a"), ("m.b", None)]
    assert {r.id: r.status for r in delta.collect()} == {"m.a": "unchanged", "m.b": "changed", "n.c": "removed"}
    store = incremental.Store(spark, str(tmp_path / "store"), nodes, edges)
    source = str(tmp_path / "in")
    for k, rows in enumerate((one, two)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        incremental.run_stream(stream, store, str(tmp_path / "cp")).awaitTermination(120)
        assert store.version == k + 1
    final, links = store.read()
    assert sorted(r.id for r in final.collect()) == ["m.a", "m.b"]
    assert sorted((r.caller_id, r.callee_id) for r in links.collect()) == sorted((r.caller_id, r.callee_id) for r in calls.collect())
    again = incremental.Store(spark, str(tmp_path / "store"), nodes, edges)  # another process goes on from there
    assert again.version == 2 and sorted(r.id for r in again.read()[0].collect()) == ["m.a", "m.b"]
    broken = spark.createDataFrame([("/m.py", "def a(:"), ("/k.py", "def k():\n    pass\n")], schema)
    assert sorted(r.id for r in incremental.apply_changes(*again.read(), broken)[0].collect()) == ["k.k", "m.a", "m.b"]


def test_full_index(spark):
    files = spark.createDataFrame([("/m.py", "def a():\n    b()\n\ndef b():\n    go()\n"), ("/n.ts", "export function go() { b(); }"), ("/bad.py", "def ("), ("/gone.py", None)], "path string, content string")
    nodes, edges, failed = incremental.full_index(files)
    assert sorted(r.id for r in nodes.collect()) == ["m.a", "m.b", "n.go"]
    assert sorted((r.caller_id, r.callee_id) for r in edges.collect()) == [("m.a", "m.b"), ("m.b", "n.go"), ("n.go", "m.b")]
    assert [r.file for r in failed.collect()] == ["/bad.py"]


def test_stream_takes_the_newest_row_of_a_path(spark, tmp_path):
    schema = "path string, content string, at int"
    nodes, edges = python_source.split_rows(python_source.parse_sources(spark.createDataFrame([], "path string, content string")))
    store = incremental.Store(spark, str(tmp_path / "store"), nodes.withColumn("summary", F.lit(None).cast("string")), edges)
    source = str(tmp_path / "in")
    spark.createDataFrame([("/a.py", "def z():\n    pass\n", 1), ("/a.py", "def b():\n    pass\n", 2), ("/d.py", "def d():\n    pass\n", 1), ("/d.py", None, 2)], schema).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    incremental.run_stream(stream, store, str(tmp_path / "cp"), order="at").awaitTermination(120)
    assert [r.id for r in store.read()[0].collect()] == ["a.b"]


def _message(*fields):
    """A message of (field, number or bytes)."""

    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    return b"".join(number(f << 3) + number(v) if isinstance(v, int) else number(f << 3 | 2) + number(len(v)) + v for f, v in fields)


def test_binary_symbols(spark, tmp_path):
    hit = lambda line, symbol, roles: (2, _message((1, bytes([line, 0, 5])), (2, symbol.encode()), (3, roles)))
    document = _message((1, b"a.py"), hit(1, "f().", 1), hit(3, "lib g().", 8), hit(200 & 127, "h().", 1), hit(100, "f().", 8), hit(101, "f().", 8))
    (tmp_path / "i.scip").write_bytes(_message((1, b"meta"), (2, document)))
    found = artifacts.read_binary_symbols(spark, str(tmp_path / "i.scip"))
    assert found.count() == 5
    assert sorted(map(tuple, artifacts.attribute_reads(found).collect())) == [("f().", "lib g()."), ("h().", "f().")]


def test_split_symbols(spark):
    rows = [("a.py", "s m p 1 a/f().", "", "p", "a.f", [("s m numpy 1 numpy/array().", True), ("s m p 1 a/g().", True), ("s m p 1 x/y#", False)]), ("a.py", "s m p 1 a/g().", "", "p", "a.g", [])]
    symbols = spark.createDataFrame(rows, "file string, symbol string, docs string, library string, name string, relationships array<struct<symbol: string, isReference: boolean>>")
    nodes, edges = artifacts.split_symbols(symbols)
    assert sorted((r.id, r.is_external) for r in nodes.collect()) == [("a.f", 0), ("a.g", 0), ("external.numpy.numpy.array", 1)]
    assert sorted(map(tuple, edges.collect())) == [("a.f", "a.g"), ("a.f", "external.numpy.numpy.array")]


def test_pipfile(spark, tmp_path):
    (tmp_path / "Pipfile.lock").write_text(json.dumps({"default": {"Foo_x": {"version": "==1.0"}, "bar": {"version": "==2"}}, "develop": {"bar": {"version": "==3"}}}))
    assert sorted(map(tuple, artifacts.read_pipfile_lock(spark, str(tmp_path / "Pipfile.lock")).collect())) == [("bar", "3"), ("foo-x", "1.0")]


LANGUAGES = {
    "a.ts": (
        "import { x } from './lib';\nconst y = require('dep');\n/** Says hi. */\nexport class Foo<T> extends Base implements I, J {\n  async go(a: string, b = 2): Promise<void> { if (a) { run(a); } const f = (z) => { inner(z); }; }\n  get v() { return this.w(); }\n}\nexport const arrow = async (q) => { call(q); };\nfunction plain(s /* } */) { return '}' + other(s); }\n",
        {"a.Foo": "class", "a.Foo.go": "method", "a.Foo.go.<locals>.f": "function", "a.Foo.v": "method", "a.arrow": "function", "a.plain": "function"},
        {("a", "./lib"), ("a", "dep"), ("a.Foo", "Base"), ("a.Foo", "I"), ("a.Foo", "J"), ("a.Foo.go", "run"), ("a.Foo.go.<locals>.f", "inner"), ("a.Foo.v", "w"), ("a.arrow", "call"), ("a.plain", "other")},
    ),
    "b.java": (
        "import java.util.List;\npublic class B extends A {\n  @Override\n  public List<String> get(int n, Map<K, V> m) throws E { for (int i = 0; i < n; i++) { use(i); } return make(); }\n  B() { super(); init(); }\n  interface In { void f(); }\n}\n",
        {"b.B": "class", "b.B.get": "method", "b.B.B": "method", "b.B.In": "class"},
        {("b", "java.util.List"), ("b.B", "A"), ("b.B.get", "use"), ("b.B.get", "make"), ("b.B.B", "init")},
    ),
    "c.rs": (
        "use std::fmt;\npub struct S { a: i32 }\nimpl fmt::Display for S {\n    pub async fn show(&self, f: &mut F) -> R { write(f) }\n}\nfn main() { let s = S { a: 1 }; go(s); }\n",
        {"c.S": "class", "c.S.show": "method", "c.main": "function"},
        {("c", "std::fmt"), ("c.S", "fmt::Display"), ("c.S.show", "write"), ("c.main", "go")},
    ),
    "d.go": (
        'import (\n  "fmt"\n  x "a/b"\n)\ntype T struct { n int }\nfunc (t *T) Do(a int, b string) error { return fmt.Errorf("}") }\nfunc main() { go t.Do(1, "a") }\n',
        {"d.T.Do": "method", "d.main": "function"},
        {("d", "fmt"), ("d", "a/b"), ("d.T.Do", "Errorf"), ("d.main", "Do")},
    ),
    "e.cpp": (
        "#include <vector>\nnamespace n {\nclass C : public D {\n public:\n  int f(const char* s) const { return g(s); }\n};\n}\nvoid C::h(int k) { while (k) { f(k); } }\n",
        {"e.C": "class", "e.C.f": "method", "e.C.h": "method"},
        {("e", "vector"), ("e.C", "D"), ("e.C.f", "g"), ("e.C.h", "f")},
    ),
    "f.rb": (
        "require 'set'\nclass Foo < Bar\n  # Says so.\n  def hi(a, b = 1)\n    talk(a)\n  end\n\n  def self.make\n    new_one()\n  end\nend\n",
        {"f.Foo": "class", "f.Foo.hi": "method", "f.Foo.make": "method"},
        {("f", "set"), ("f.Foo", "Bar"), ("f.Foo.hi", "talk"), ("f.Foo.make", "new_one")},
    ),
    "g.kt": ("import a.b.C\nclass K(val x: Int) : Base(x), I {\n  suspend fun go(a: Int): String { return run(a) }\n}\nfun top(s: String) { go(s) }\n", {"g.K": "class", "g.K.go": "method", "g.top": "function"}, {("g", "a.b.C"), ("g.K", "Base"), ("g.K", "I"), ("g.K.go", "run"), ("g.top", "go")}),
    "h.php": ("<?php\nuse App\\Models\\User;\nclass P extends Q {\n  public function f($a, int $b = 2) { # }\n    return $this->g($a); }\n}\nfunction top() { run(); }\n", {"h.P": "class", "h.P.f": "method", "h.top": "function"}, {("h", "App\\Models\\User"), ("h.P", "Q"), ("h.P.f", "g"), ("h.top", "run")}),
    "i.cs": ("using System;\nnamespace N {\n  public class C : B, I {\n    public async Task<int> Get(string s, int n) { foreach (var x in s) { Use(x); } return 1; }\n  }\n}\n", {"i.C": "class", "i.C.Get": "method"}, {("i", "System"), ("i.C", "B"), ("i.C", "I"), ("i.C.Get", "Use")}),
    "j.swift": ("import UIKit\nclass V: Base, P {\n  func go(_ a: Int, with b: String) async -> Int { return run(a) }\n}\nfunc top() { go() }\n", {"j.V": "class", "j.V.go": "method", "j.top": "function"}, {("j", "UIKit"), ("j.V", "Base"), ("j.V", "P"), ("j.V.go", "run"), ("j.top", "go")}),
}


@pytest.mark.parametrize("path", LANGUAGES)
def test_languages(path):
    content, nodes, edges = LANGUAGES[path]
    rows = python_source.parse_scoped(path, content)
    assert {r["id"]: r["type"] for r in rows if r["kind"] == "node"} == nodes
    assert {(r["id"], r["callee_id"]) for r in rows if r["kind"] == "edge"} == edges


def test_scoped_details():
    rows = {r["id"]: r for r in python_source.parse_scoped("a.ts", LANGUAGES["a.ts"][0]) if r["kind"] == "node"}
    go = rows["a.Foo.go"]
    assert (go["parameter_names"], go["is_async"], go["enclosing_class"], go["start_line"], rows["a.Foo"]["docstring"]) == (["a", "b"], 1, "Foo", 5, "Says hi.")
    assert rows["a.plain"]["body"].endswith("other(s); }")
    ruby = {r["id"]: r for r in python_source.parse_scoped("f.rb", LANGUAGES["f.rb"][0]) if r["kind"] == "node"}
    assert ruby["f.Foo.hi"]["docstring"] == "Says so." and ruby["f.Foo.hi"]["parameter_names"] == ["a", "b"]
    for junk in ("", "}}}", "{" * 500, "class", "fn (", "((("):
        python_source.parse_scoped("x.rs", junk)
