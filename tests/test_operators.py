"""Rules of the operators on small tables."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodegraph.functions import names
from lodegraph.operators import architecture, changes, detectors, diffs, graph, health, patterns, rules, validation


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def nodes(spark):
    ids = ["a.b.fn", "a.b.g", "c.d.fn", "fn", "x.only"]
    return spark.createDataFrame([(i, i.split(".")[-1], ".".join(i.split(".")[:2]), 0, "function", "") for i in ids], "id string, name string, module string, is_external int, type string, docstring string")


def test_names(spark):
    df = spark.createDataFrame([("a.b.c",), ("top",), (None,)], "id string")
    got = [tuple(r) for r in df.select(names.suffixes("id"), names.ancestors("id"), names.parent("id"), names.last_segment("id")).collect()]
    assert got[0] == (["b.c", "c"], ["a", "a.b"], "a.b", "c")
    assert got[1] == ([], [], None, "top")
    paths = spark.createDataFrame([("/p/a/b/__init__.py",), ("/p/a/c.py",)], "f string")
    assert [r[0] for r in paths.select(names.module_of("f", "/p")).collect()] == ["a.b", "a.c"]
    tests = spark.createDataFrame([("tests/x.py",), ("a/test_x.py",), ("a/x_test.py",), ("a/contest.py",)], "f string")
    assert [r[0] for r in tests.select(names.is_test_file("f")).collect()] == [True, True, True, False]


def test_resolve_names(spark, nodes):
    wanted = spark.createDataFrame([("fn",), ("b.fn",), ("a.b.fn",), ("f",), ("FN",), ("%",)], "query string")
    assert rows(graph.resolve_names(nodes, wanted)) == [("a.b.fn", "a.b.fn", 0), ("b.fn", "a.b.fn", 1), ("fn", "a.b.fn", 0), ("fn", "c.d.fn", 0), ("fn", "fn", 0)]


def test_resolve_callees(spark, nodes):
    edges = spark.createDataFrame([("q", "b.fn"), ("q", "only"), ("q", "nowhere"), ("q", "a.b.g"), ("q", "fn")], "caller_id string, callee_id string")
    assert [r[1] for r in rows(graph.resolve_callees(edges, nodes).select("caller_id", "callee_id"))] == ["a.b.fn", "a.b.g", "fn", "nowhere", "x.only"]


def test_impact_radius(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("m", "a"), ("z", "m")], "caller_id string, callee_id string")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("z",)], "id string")
    target = spark.createDataFrame([("a",)], "target string")
    assert rows(graph.impact_radius(edges, target, 1, nodes)) == [("a", "a", 0), ("a", "b", 1)]
    assert rows(graph.impact_radius(edges, target, 5, nodes)) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("a", "z", 2)]  # m is gone through
    assert rows(graph.impact_radius(edges, target, 1, forward=True)) == [("a", "a", 0), ("a", "c", 1)]


def test_counts_and_orphans(spark, nodes):
    edges = spark.createDataFrame([("a.b.fn", "fn"), ("a.b.fn", "fn"), ("c.d.fn", "fn")], "caller_id string, callee_id string")
    assert rows(graph.caller_counts(edges)) == [("fn", 2, 3)]
    assert rows(graph.orphans(nodes, edges).select("id")) == [("a.b.g",), ("x.only",)]
    assert rows(graph.chokepoints(nodes, edges).select("id", "callers")) == [("fn", 2)]


def test_subsystems(spark):
    n = spark.createDataFrame([(f"a.b.c{i % 2}.f{i}", 0, "function") for i in range(6)] + [("q.r.s", 0, "class"), ("q.r.t", 1, "function"), ("one", 0, "function")], "id string, is_external int, type string")
    assert rows(architecture.subsystem_map(n, 5).groupBy("subsystem").count()) == [("a.b.c0", 3), ("a.b.c1", 3), ("one", 1), ("q.r", 1)]
    assert rows(architecture.subsystem_map(n, 6).groupBy("subsystem").count()) == [("a.b", 6), ("one", 1), ("q.r", 1)]


def test_reconcile(spark):
    old = spark.createDataFrame([("gone", "1"), ("same", "2"), ("diff", "3"), ("nil", None)], "id string, hash string")
    new = spark.createDataFrame([("same", "2"), ("diff", "4"), ("new", "5"), ("nil", None)], "id string, hash string")
    got = {r.id: (r.status, r.to_embed, r.to_delete) for r in diffs.reconcile(old, new).collect()}
    assert got == {"gone": ("removed", False, True), "same": ("unchanged", False, False), "diff": ("changed", True, True), "new": ("added", True, False), "nil": ("unchanged", False, False)}


def test_writes(spark):
    old = spark.createDataFrame([(1, "a", "s"), (2, "b", None)], "id int, body string, summary string")
    new = spark.createDataFrame([(2, "B", "n"), (1, "A", "n"), (3, "c", "n")], "id int, body string, summary string")
    assert rows(diffs.upsert(old, new, ["id"], keep=("summary",))) == [(1, "A", "s"), (2, "B", "n"), (3, "c", "n")]
    assert rows(diffs.delete_where(old, "summary = 's'").select("id")) == [(2,)]
    with pytest.raises(ValueError):
        diffs.delete_where(old, " ")


def test_changes(spark):
    log = spark.createDataFrame([(c, f) for c in range(3) for f in ("a", "b")] + [(9, "a"), (9, "c"), (0, "a")], "commit_hash int, function_id string")
    assert rows(changes.co_occurrence(log, "commit_hash")) == [("a", "b", 3), ("b", "a", 3)]
    touches = spark.createDataFrame([("me", "f", 1, 1), ("main", "f", 2, 2), ("x", "f", 3, 3), ("x", "g", 4, 4), ("me", "f", 7, 5)], "branch string, function_id string, head_commit int, modified_at int")
    assert rows(changes.branch_conflicts(touches, "me")) == [("f", "main,x", 2, True)]
    assert rows(changes.latest(touches, ["branch", "function_id"], "modified_at", "head_commit"))[1][:3] == ("me", "f", 7)
    files = spark.createDataFrame([("/r/src/a/x.py",), ("/r/src/b/x.py",)], "file string")
    paths = spark.createDataFrame([("old/b/x.py",), ("x.py",), ("nope.py",)], "path string")
    assert rows(changes.match_paths(files, paths)) == [("old/b/x.py", "/r/src/b/x.py", 2), ("x.py", "/r/src/a/x.py", 1)]


def test_contract_rule(spark):
    contracts = spark.createDataFrame([("c", "log", "db.safe", ["skip"]), ("g", "net.*", None, [])], "contract_id string, pattern string, required string, exclusions array<string>")
    reach = spark.createDataFrame([("f1", "m.log"), ("f2", "m.log_it"), ("f3", "m.my_log"), ("f4", "m.catalog"), ("f5", "m.log"), ("f5", "db.safe"), ("skip.f", "m.log"), ("f6", "net.x.y"), ("f6", "network.z")], "id string, callee string")
    assert rows(rules.contract_violations(contracts, reach)) == [("c", "f1", "m.log"), ("c", "f2", "m.log_it"), ("c", "f3", "m.my_log"), ("g", "f6", "net.x.y")]


def test_health(spark):
    counts = spark.createDataFrame([(3, 2, 1), (3, 3, 1), (3, 3, 0)], "expected int, actual int, degraded int")
    assert [r.status for r in health.index_status(counts).collect()] == ["partial", "degraded", "ok"]
    requests = spark.createDataFrame([("u", "p"), ("u", "demo"), ("v", "p"), ("w", "p")], "user_id string, project_id string")
    grants = spark.createDataFrame([("u", "p", "owner"), ("v", "p", "viewer")], "user_id string, project_id string, role string")
    demos = spark.createDataFrame([("demo",)], "project_id string")
    assert rows(health.access(requests, grants, demos)) == [("u", "demo", True, False), ("u", "p", True, True), ("v", "p", True, False), ("w", "p", False, False)]


def test_concentration(spark):
    results = spark.createDataFrame([(1, "m")] * 6 + [(1, "n")] * 2 + [(2, "m")] * 5 + [(2, "n")] * 5 + [(3, "k")], "query_id int, module string")
    assert rows(architecture.concentration(results).select("query_id", "fires")) == [(1, True), (2, False), (3, True)]
    assert architecture.concentration(results.filter(F.lit(False))).count() == 0


def test_reach_counts(spark, monkeypatch):
    """Counts of the pairs, by few tasks that make none of them and, for larger graphs, by levels."""
    rng = random.Random(4)
    nodes = graph.numbered(spark.range(700).selectExpr("concat('n', id) as id").repartition(3))
    number = {r.id: r.k for r in nodes.collect()}
    pairs = [(f"n{rng.randrange(650)}", f"n{rng.randrange(650) // rng.choice([1, 1, 50])}") for _ in range(1500)] + [("n3", "n3"), ("n3", "n4"), ("n3", "n4")]
    by_name = spark.createDataFrame(pairs, "caller_id string, callee_id string")
    want = rows(graph.impact_radius(by_name, nodes.select(F.col("id").alias("target")), 3).groupBy("target", "depth").count())
    edges = spark.createDataFrame([(number[a], number[b]) for a, b in pairs], "caller_id int, callee_id int")
    assert rows(graph.reach_counts(nodes, edges, 3, most=10)) == want
    monkeypatch.setattr(graph, "impact_radius", None)  # its pairs can be the square of the nodes
    assert rows(graph.reach_counts(nodes, edges, 3)) == want
    assert rows(graph.reach_counts(nodes, edges.limit(0), 3)) == sorted((x, 0, 1) for x in number)


def test_reach(spark, monkeypatch):
    """Every pair, by few tasks and, for larger graphs, by levels; batches end inside levels."""
    rng = random.Random(5)
    nodes = graph.numbered(spark.range(600).selectExpr("concat('n', id) as id").repartition(3))
    number = {r.id: r.k for r in nodes.collect()}
    pairs = [(f"n{rng.randrange(550)}", f"n{rng.randrange(550) // rng.choice([1, 1, 50])}") for _ in range(1300)] + [("n3", "n3"), ("n3", "n4"), ("n3", "n4")]
    callers, want = {}, []
    for a, b in pairs:
        callers.setdefault(b, set()).add(a)
    for target in number:
        seen, front = {target}, {target}
        for depth in range(4):
            want += [(target, x, depth) for x in front]
            front = {a for b in front for a in callers.get(b, ())} - seen
            seen |= front
    edges = spark.createDataFrame([(number[a], number[b]) for a, b in pairs], "caller_id int, callee_id int")
    assert rows(graph.reach(nodes, edges, 3, most=10)) == sorted(want)
    monkeypatch.setattr(graph, "impact_radius", None)  # its pairs are saved
    assert rows(graph.reach(nodes, edges, 3)) == sorted(want)
    assert rows(graph.reach(nodes, edges.limit(0), 3)) == sorted((x, x, 0) for x in number)
    assert rows(graph.reach(nodes.limit(0), edges.limit(0), 3)) == []
    runs, fronts = [(7, 0, 1), (7, 1, graph.BATCH), (9, 0, 1)], [np.array([7]), np.arange(graph.BATCH), np.array([9])]
    made = list(graph._batches(pa.array([f"n{x}" for x in range(graph.BATCH)], pa.large_string()), runs, fronts))
    assert [b.num_rows for b in made] == [graph.BATCH, 2]
    assert made[1].to_pylist() == [{"target": "n7", "id": f"n{graph.BATCH - 1}", "depth": 1}, {"target": "n9", "id": "n9", "depth": 0}]


def test_contracts_follow_only_what_a_rule_names(spark, monkeypatch):
    """The violations of all pairs, without making the pairs: what is saved holds pairs with a callee of a rule only."""
    rng = random.Random(3)
    ids = [f"{rng.choice(['a', 'b', 'Net'])}.m{i % 7}.f{i}" for i in range(60)]
    nodes = graph.numbered(spark.createDataFrame([(x,) for x in ids], "id string").repartition(3))
    number = {r.id: r.k for r in nodes.collect()}
    assert sorted(number.values()) == list(range(60))
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(150)]
    contracts = spark.createDataFrame([("c", "f7", None, ["b."]), ("c", "a.m3.*", None, ["net"]), ("d", ids[9], ids[5], []), ("e", "b.*", ids[8], ["A."]), ("f", "none", None, None)], "contract_id string, pattern string, required string, exclusions array<string>")
    by_name = spark.createDataFrame(pairs, "caller_id string, callee_id string")
    reach = graph.impact_radius(by_name, spark.createDataFrame([(x,) for x in ids], "target string"), 2, forward=True).filter("depth > 0").selectExpr("target as id", "id as callee")
    want, made = rows(rules.contract_violations(contracts, reach)), []
    plain = rules.saved
    monkeypatch.setattr(rules, "saved", lambda df: made.append(out := plain(df)) or out)
    edges = spark.createDataFrame([(number[a], number[b]) for a, b in pairs], "caller_id int, callee_id int")
    assert want and rows(rules.contract_violations_within(contracts, nodes, edges, 2)) == want
    named = {r.target for df in made[:2] for r in df.collect()}
    assert {r.target for r in made[2].collect()} <= named and len(named) < 60


def test_patterns_are_not_one_plan(spark):
    """What a pattern finds is saved as it is found, so the driver never holds the joins of all patterns; asked for one, no other is looked for."""
    methods = spark.createDataFrame([("m.B.run", "m.B", "run", "raise NotImplementedError", []), ("m.S.run", "m.S", "run", "x", []), ("m.B.accept", "m.B", "accept", "x", [])], "id string, class_id string, method string, body string, decorators array<string>")
    inherits, calls = spark.createDataFrame([("m.S", "m.B")], "sub string, base string"), spark.createDataFrame([("m.S.run", "m.B.run")], "caller_id string, callee_id string")
    fields = spark.createDataFrame([], "id string")
    found = patterns.detect(methods, inherits, calls, fields)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    for pattern in ("strategy", "visitor", "decorator_or_proxy"):
        want = rows(found.filter(F.col("pattern") == pattern))
        assert want and rows(patterns.detect(methods, inherits, calls, fields, (pattern,))) == want


def test_design_patterns(spark):
    nie, no = "def m(self):\n    raise NotImplementedError", "def m(self):\n    pass"
    methods = spark.createDataFrame(
        [("x.T", "run", "self.step()", []), ("x.T", "step", nie, []), ("x.U", "step", "return 1", []), ("x.V", "other", "x", []), ("x.F", "create_a", nie, []), ("x.F", "make_b", "y", ["abstractmethod"]), ("x.G", "create_a", "x", []), ("x.O", "attach", "x", []), ("x.O", "notify", "x", []), ("x.P", "hook", no, []), ("x.P", "go", "self.hook()", [])],
        "class_id string, method string, body string, decorators array<string>",
    ).withColumn("id", F.concat_ws(".", "class_id", "method"))
    inherits = spark.createDataFrame([("x.U", "x.T"), ("x.V", "x.T"), ("x.G", "x.F")], "sub string, base string")
    calls = spark.createDataFrame([("x.T.run", "x.T.step"), ("x.P.go", "hook"), ("x.U.step", "x.T.step"), ("x.V.other", "self._next.other")], "caller_id string, callee_id string")
    got = {(r.id, r.pattern, r.role, r.confidence, r.missing) for r in patterns.detect(methods, inherits, calls, spark.createDataFrame([], "id string")).collect()}
    assert got == {
        ("x.T.run", "template_method", "template_method", 0.88, "V"), ("x.T.step", "template_method", "abstract_hook", 0.85, "V"), ("x.F.create_a", "template_method", "abstract_hook", 0.85, ""), ("x.F.make_b", "template_method", "abstract_hook", 0.85, "G"),
        ("x.F.create_a", "factory_method", "abstract_creator", 0.90, ""), ("x.F.make_b", "factory_method", "abstract_creator", 0.90, "G"), ("x.G.create_a", "factory_method", "concrete_creator", 0.88, ""), ("x.P.hook", "template_method", "abstract_hook", 0.75, ""),
        ("x.F.create_a", "abstract_factory", "abstract_factory", 0.88, "G"), ("x.F.make_b", "abstract_factory", "abstract_factory", 0.88, "G"), ("x.G.create_a", "abstract_factory", "concrete_factory", 0.85, ""), ("x.O.attach", "observer", "subject", 0.91, "detach"),
        ("x.O.notify", "observer", "subject", 0.91, "detach"), ("x.V.other", "chain_of_responsibility", "handler", 0.85, ""), ("x.U.step", "decorator_or_proxy", "proxy", 0.65, ""),
    }
    elements = spark.createDataFrame([("a",), ("b",), ("c",)], "element string")
    assert rows(rules.missing_visits(spark.createDataFrame([("V", "visit_a"), ("V", "visit_b")], "class_id string, method string"), elements)) == [("V", "c")]


def test_pass_only(spark):
    bodies = {"def f(self):\n    pass": True, "def f(self):\n    ...": True, 'def f(self):\n    """a\n    b"""\n    # c\n    pass': True, "async def f(\n    self,\n):\n    pass": True, "def f(self):\n    return 1": False, "": False, "def f(self):\n    pass\n    x()": False}
    df = spark.createDataFrame(list(bodies.items()), "body string, want boolean")
    assert df.filter(patterns.is_pass_only() != F.col("want")).count() == 0


def test_detectors_on_long_texts(spark):
    long = "x [ 'a' \" for in " * 20_000
    df = spark.createDataFrame([("a", "a", 0, 1, long), ("b", "b", 0, 1, None), ("c", "c", 0, 1, "for x in y:\n  conn.execute(1)"), ("d", "d", 1, 0, "")], "id string, name string, is_external int, is_async int, body string")
    calls = spark.createDataFrame([("c", "c"), ("c", "d"), ("c", "d")], "caller_id string, callee_id string")
    none = spark.createDataFrame([], "id string, reason string")
    assert rows(detectors.performance(df, calls, none).select("id", "pattern", "severity")) == [("c", "external_call_in_loop", "medium"), ("c", "n_plus_one", "medium")]


def test_hot_key(spark, monkeypatch):
    monkeypatch.setattr(changes, "BLOCK", 4)
    log = spark.createDataFrame([(k, i) for k in range(2) for i in range(30)] + [(5, 1), (5, 2)], "commit_hash int, function_id int")
    got = rows(changes.co_occurrence(log, "commit_hash", least=2))
    assert got == sorted((a, b, 3 if {a, b} == {1, 2} else 2) for a in range(30) for b in range(30) if a != b)


def test_conformance(spark):
    existing = spark.createDataFrame([("m", f"get_{i}", 1, "precise") for i in range(8)] + [("m", "put_x", 1, "precise"), ("g", "a_b", 0, "generic")], "module string, name string, is_async int, structural_layer string")
    drafts = spark.createDataFrame(
        [(1, "m", "get_ok", 1, "pass"), (2, "m", "fetch_it", 0, "    for x in y:\n        conn.fetch(x)"), (3, "g", "anything", 1, "    a = await f()\n    b = await g()"), (4, "new", "z", 0, "")], "draft_id int, module string, name string, is_async int, body string"
    )
    assert rows(validation.conformance(drafts, existing)) == [(1, 0, 1.0), (2, 3, 0.35), (3, 2, 0.6), (4, 0, 1.0)]
