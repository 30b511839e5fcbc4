"""What to look at next: signals over results, hints on what changes together, health of an index and of its dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from .bounds import small

# Thresholds of the signals and of the health report, pairs of methods that belong together.
CHOKEPOINT, CONCENTRATED, NAMED, ASYNC_FIRST, ASYNC_RARE, WIDE = 15, 0.75, 0.6, 0.8, 0.2, 5
MOSTLY_SYNC, HIGH_SURFACE = 0.3, 3
PAIRS = (("__eq__", "__hash__"), ("__hash__", "__eq__"), ("__lt__", "__eq__"), ("__enter__", "__exit__"), ("__exit__", "__enter__"))
FALLBACK, FALLBACK_PERCENT, ORPHAN_PERCENT, SUMMARY_PERCENT = "text-embedding-3-large", 20, 30, 50
READY_VECTORS, READY_SUMMARIES, PARTIAL_VECTORS = 80, 50, 40
CLUSTER_TOP, CLUSTER_SIMILARITY, CLUSTER_FILES = 12, 0.72, 3


def _dominant(results: DataFrame, column: str) -> DataFrame:
    """query_id, value, n, total: the commonest value that is not null, ties to the lesser, and all rows."""
    by = results.groupBy("query_id", column).agg(F.count(F.lit(1)).alias("n"))
    top = by.groupBy("query_id").agg(F.sum("n").alias("total"), F.min(F.when(F.col(column).isNotNull(), F.struct((-F.col("n")).alias("k"), F.col(column).alias("v")))).alias("m"))
    return top.select("query_id", F.col("m.v").alias("value"), (-F.col("m.k")).alias("n"), "total")


def signals(results: DataFrame, counts: DataFrame, decided: DataFrame) -> DataFrame:
    """query_id, signal, subject, n: what the results of each query show.  results: query_id, id, name, module, is_async; counts: callee_id,
    callers; decided: function_id.  concentration, naming, async_first / async_rare / async_mixed, chokepoint, decision_gap."""
    share = F.col("n") / F.col("total")
    modules = _dominant(results, "module").filter(share >= CONCENTRATED).select("query_id", F.lit("concentration").alias("signal"), F.col("value").alias("subject"), "n")
    verbs = results.withColumn("verb", F.nullif(F.regexp_extract(names.last_segment("name"), "^([a-z]+)_", 1), F.lit("")))
    naming = _dominant(verbs, "verb").filter(share >= NAMED).select("query_id", F.lit("naming").alias("signal"), F.col("value").alias("subject"), "n")
    by = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("is_async") == 1).alias("n")).filter("n > 0")
    kind = F.when(share >= ASYNC_FIRST, "async_first").when(share <= ASYNC_RARE, "async_rare").otherwise("async_mixed")
    tempo = by.select("query_id", kind.alias("signal"), F.lit("").alias("subject"), "n")
    called = results.select("query_id", "id").distinct().join(counts.filter(F.col("callers") >= CHOKEPOINT).select(F.col("callee_id").alias("id"), "callers"), "id")
    points = called.select("query_id", F.lit("chokepoint").alias("signal"), F.col("id").alias("subject"), F.col("callers").alias("n"))
    gaps = called.join(decided.select(F.col("function_id").alias("id")).distinct(), "id", "left_anti").select("query_id", F.lit("decision_gap").alias("signal"), F.col("id").alias("subject"), F.col("callers").alias("n"))
    return modules.unionByName(naming).unionByName(tempo).unionByName(points).unionByName(gaps)


def caller_guidance(calls: DataFrame) -> DataFrame:
    """query_id, n_callers, n_modules, dominant, concentrated, wide, chokepoint, tempo of each function's callers.  calls: query_id, id,
    module, is_async; a row a caller."""
    top = _dominant(calls, "module")
    by = calls.groupBy("query_id").agg(F.count_distinct("module").alias("n_modules"), F.count_if(F.col("is_async") == 1).alias("a"))
    share, concentrated = F.col("a") / F.col("total"), F.col("n") / F.col("total") >= CONCENTRATED
    tempo = F.when(F.col("a") == F.col("total"), "async").when((F.col("a") > 0) & (share < MOSTLY_SYNC), "mostly_sync").otherwise("")
    return top.join(by, "query_id").select(
        "query_id", F.col("total").alias("n_callers"), "n_modules", F.col("value").alias("dominant"), concentrated.alias("concentrated"), (~concentrated & (F.col("n_modules") >= WIDE)).alias("wide"), (F.col("total") >= CHOKEPOINT).alias("chokepoint"), tempo.alias("tempo"),
    )


def callee_guidance(calls: DataFrame) -> DataFrame:
    """query_id, n_external, libraries (the first four), high_surface, dominant (null if the internal callees have none) of each
    function's callees.  calls: query_id, id, module, is_external."""
    by = calls.groupBy("query_id").agg(F.count_if(F.col("is_external") == 1).alias("n_external"), F.array_join(F.slice(F.sort_array(F.collect_set(F.when(F.col("is_external") == 1, F.col("module")))), 1, 4), ",").alias("libraries"))
    inside = _dominant(calls.filter("is_external = 0"), "module").filter((F.col("n") / F.col("total") >= CONCENTRATED) & (F.col("total") > 2)).select("query_id", F.col("value").alias("dominant"))
    return by.join(inside, "query_id", "left").select("query_id", "n_external", "libraries", (F.col("n_external") >= HIGH_SURFACE).alias("high_surface"), "dominant")


def change_hints(targets: DataFrame, nodes: DataFrame, impact: DataFrame, similar: DataFrame, changed: DataFrame, least: int = 3, most: int = 5, siblings: int = 3) -> DataFrame:
    """target, type, id, action: what may have to change with each target and is not in its impact set.  targets: target (a node);
    nodes: id, name; impact: target, id; similar: target, id, rank; changed: a, b, n.  protocol: the other method of a pair, to add
    or to review; semantic: the nearest few; co_change: what changed together `least` times, the `most` often first."""
    pairs = small(targets.sparkSession.createDataFrame(PAIRS, "method string, other string"))
    own = targets.select("target", names.last_segment("target").alias("method"), names.parent("target").alias("class_id")).join(pairs, "method")
    wanted = own.select("target", F.concat("class_id", F.lit("."), "other").alias("id"))
    there = wanted.join(nodes.select("id").distinct().withColumn("there", F.lit(True)), "id", "left")
    seen = impact.select("target", "id").distinct()
    review = there.filter("there").join(seen, ["target", "id"], "left_anti").select("target", F.lit("protocol").alias("type"), "id", F.lit("review").alias("action"))
    add = there.filter("there is null").select("target", F.lit("protocol").alias("type"), "id", F.lit("add").alias("action"))

    def first(rows: DataFrame, order, n: int, kind: str) -> DataFrame:
        left = rows.filter("target <> id").join(seen, ["target", "id"], "left_anti")
        ranked = left.withColumn("k", F.row_number().over(Window.partitionBy("target").orderBy(*order))).filter(F.col("k") <= n)
        return ranked.select("target", F.lit(kind).alias("type"), "id", F.lit("review").alias("action"))

    near = similar.join(targets.select("target"), "target", "left_semi")
    often = changed.filter(F.col("n") >= least).select(F.col("a").alias("target"), F.col("b").alias("id"), "n").join(targets.select("target"), "target", "left_semi")
    often = often.withColumn("k", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("n"), "id"))).filter(F.col("k") <= most).drop("k")
    return review.unionByName(add).unionByName(first(near, ["rank", "id"], siblings, "semantic")).unionByName(first(often, [F.desc("n"), "id"], most, "co_change"))


def health_report(nodes: DataFrame, edges: DataFrame, changes: DataFrame, decisions: DataFrame, links: DataFrame, vectors: DataFrame, anchors: DataFrame) -> DataFrame:
    """One row a project: counts and percentages of nine dimensions, the actions that follow, by priority and name, and the verdict of them.
    nodes: project_id, id, is_external, summary, embedding_model; edges: project_id, caller_id; changes: project_id, commit_hash;
    decisions: project_id, decision_id; links: decision_id, function_id; vectors: decision_id; anchors: project_id, subsystem, summary."""
    count = lambda c: F.count_if(c)
    inside, has = F.col("is_external") == 0, F.coalesce(F.col("summary"), F.lit("")) != ""
    a = nodes.groupBy("project_id").agg(F.count(F.lit(1)).alias("total"), count(inside).alias("internal"), count(~inside).alias("external"), count(inside & has).alias("summaries"), count(inside & (F.col("embedding_model") == FALLBACK)).alias("fallback"))
    e = edges.groupBy("project_id").agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("caller_id").alias("callers"))
    c = changes.groupBy("project_id").agg(F.count(F.lit(1)).alias("changes"), F.count_distinct("commit_hash").alias("commits"))
    known = decisions.join(vectors.select("decision_id").distinct().withColumn("v", F.col("decision_id")), "decision_id", "left").join(links, "decision_id", "left")
    m = known.groupBy("project_id").agg(F.count_distinct("decision_id").alias("decisions"), F.count_distinct("v").alias("decision_vectors"), F.count_distinct("function_id").alias("linked"))
    s = anchors.groupBy("project_id").agg(F.count(F.lit(1)).alias("subsystems"), count(F.trim(F.coalesce("summary", F.lit(""))) != "").alias("anchored"))
    out = a
    for x in (e, c, m, s):
        out = out.join(x, "project_id", "left")
    out = out.fillna(0, [x for x in out.columns if x != "project_id"])
    percent = lambda n, of: F.when(F.col(of) > 0, F.rint(F.col(n) / F.col(of) * 100)).otherwise(0).cast("long")
    out = out.withColumns({"summary_percent": percent("summaries", "internal"), "fallback_percent": percent("fallback", "internal"), "orphans": F.col("internal") - F.col("callers")})
    out = out.withColumns({"orphan_percent": percent("orphans", "internal"), "anchor_percent": percent("anchored", "subsystems")})
    action = lambda when, priority, name: F.when(when, F.concat(F.lit(priority + ":"), F.lit(name)))
    actions = F.array_compact(F.array(
        action(F.col("internal") > F.col("summaries"), "high", "enrich_summaries"),
        action(F.col("decisions") == 0, "high", "backfill_decisions"),
        action((F.col("changes") == 0) & (F.col("decisions") == 0), "medium", "push_cochange_history"),
        action((F.col("changes") > 0) & (F.col("changes") < 2 * F.col("internal")), "low", "push_cochange_history"),
        action(F.col("fallback_percent") > FALLBACK_PERCENT, "medium", "enrich_fallback"),
        action(F.col("orphan_percent") > ORPHAN_PERCENT, "medium", "re-index"),
    ))
    high = F.size(F.filter("actions", lambda x: F.startswith(x, F.lit("high:"))))
    verdict = F.when(F.col("total") == 0, "empty").when(high >= 2, "degraded").when((high == 1) | (F.col("summary_percent") < SUMMARY_PERCENT), "partial").otherwise("healthy")
    return out.withColumn("actions", actions).withColumn("verdict", verdict).withColumn("actions", F.array_join("actions", ","))


def readiness(coverage: DataFrame) -> DataFrame:
    """project_id, verdict of internal, vectors, summaries: ready, partial, not_ready."""
    of = lambda c: F.when(F.col("internal") > 0, 100 * F.col(c) / F.col("internal")).otherwise(0)
    return coverage.select("project_id", F.when((of("vectors") >= READY_VECTORS) & (of("summaries") >= READY_SUMMARIES), "ready").when(of("vectors") >= PARTIAL_VECTORS, "partial").otherwise("not_ready").alias("verdict"))


def fingerprint_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """kind, library, subject, before, after between two snapshots (id, library, signature, version): removed, added and changed symbols, and
    versions of a library that changed where both are known."""
    o, n = old.select("id", F.col("library").alias("l0"), F.col("signature").alias("s0")), new.select("id", F.col("library").alias("l1"), F.col("signature").alias("s1"))
    kind = F.when(F.col("l1").isNull(), "removed").when(F.col("l0").isNull(), "added").when(~F.col("s0").eqNullSafe(F.col("s1")), "changed")
    symbols = o.join(n, "id", "full_outer").select(kind.alias("kind"), F.coalesce("l0", "l1").alias("library"), F.col("id").alias("subject"), F.col("s0").alias("before"), F.col("s1").alias("after")).filter("kind is not null")
    version = lambda df, name: df.groupBy("library").agg(F.min("version").alias(name))
    versions = version(old, "before").join(version(new, "after"), "library").filter("before <> after and before <> 'unknown' and after <> 'unknown'")
    return symbols.unionByName(versions.select(F.lit("version").alias("kind"), "library", F.col("library").alias("subject"), "before", "after"))


def dependency_health(snapshot: DataFrame, diff: DataFrame, dependents: DataFrame) -> DataFrame:
    """library, version, n_symbols, n_dependents, n_removed, n_added, n_changed, n_versions: a row a library, from its newest snapshot (id, library,
    version), what changed since the one before, and who depends on it (library, id)."""
    own = snapshot.groupBy("library").agg(F.min("version").alias("version"), F.count_distinct("id").alias("n_symbols"))
    by = diff.groupBy("library").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{name}") for k, name in (("removed", "removed"), ("added", "added"), ("changed", "changed"), ("version", "versions"))])
    used = dependents.groupBy("library").agg(F.count_distinct("id").alias("n_dependents"))
    every = own.select("library").unionByName(by.select("library")).unionByName(used.select("library")).distinct()
    out = every.join(own, "library", "left").join(used, "library", "left").join(by, "library", "left")
    counts = ("n_symbols", "n_dependents", "n_removed", "n_added", "n_changed", "n_versions")
    return out.select("library", F.coalesce("version", F.lit("unknown")).alias("version"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts])


def duplication_clusters(hits: DataFrame, top: int = CLUSTER_TOP, least: float = CLUSTER_SIMILARITY, files: int = CLUSTER_FILES) -> DataFrame:
    """query_id, n_members, n_files, members: what is near each seed, where it spreads over several files.  hits: query_id, id, file, rank, similarity."""
    near = hits.filter((F.col("rank") <= top) & (F.col("similarity") >= least))
    by = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_members"), F.count_distinct("file").alias("n_files"), F.array_join(F.sort_array(F.collect_list("id")), ",").alias("members"))
    return by.filter(F.col("n_files") >= files)
