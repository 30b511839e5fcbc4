"""Rules over the graph: responsibilities, contracts, naming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..tables import saved
from . import graph
from .bounds import small

# Thresholds.
SRP = {"medium": 3, "high": 4}


def single_responsibility(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """id, n_subsystems, severity: functions that call into at least three other subsystems (four: high)."""
    a = mapping.select(F.col("id").alias("caller_id"), F.col("subsystem").alias("own"))
    b = mapping.select(F.col("id").alias("callee_id"), F.col("subsystem").alias("other"))
    calls = edges.select("caller_id", "callee_id").distinct().join(a, "caller_id").join(b, "callee_id").filter("own <> other")
    out = calls.groupBy(F.col("caller_id").alias("id")).agg(F.count_distinct("other").alias("n_subsystems")).filter(F.col("n_subsystems") >= SRP["medium"])
    return out.withColumn("severity", F.when(F.col("n_subsystems") >= SRP["high"], "high").otherwise("medium"))


def contract_violations(contracts: DataFrame, reach: DataFrame) -> DataFrame:
    """contract_id, id, callee: what a function reaches against a rule.  contracts: contract_id, pattern, required,
    exclusions (array of prefixes); reach: id, callee.  A pattern x.* takes ids below x, a dotted one the id itself, a bare one
    last segments equal to it, starting with it and _ or ending with _ and it; a reached required callee clears."""
    excluded = F.exists("exclusions", lambda p: F.startswith(F.lower("id"), F.lower(p)))
    rules = small(contracts)
    hits = reach.join(rules, _hit() & ~excluded).select("contract_id", "id", "callee")
    cleared = reach.join(rules.filter("required is not null"), F.col("callee") == F.col("required")).select("contract_id", "id").distinct()
    return hits.distinct().join(cleared, ["contract_id", "id"], "left_anti")


def _hit() -> Column:
    """Whether a pattern takes a callee."""
    last = names.last_segment("callee")
    glob = F.col("pattern").endswith(".*")
    stem = F.regexp_replace("pattern", r"\.\*$", "")
    return F.when(glob, F.startswith("callee", F.concat(stem, F.lit(".")))).when(F.contains(F.col("pattern"), F.lit(".")), F.col("callee") == F.col("pattern")).otherwise(
        (last == F.col("pattern")) | F.startswith(last, F.concat(F.col("pattern"), F.lit("_"))) | F.endswith(last, F.concat(F.lit("_"), F.col("pattern")))
    )


def contract_violations_within(contracts: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """contract_violations of what each node reaches in at most `depth` steps.  nodes: k, id; edges: caller_id, callee_id, numbers k.
    A violation needs a callee that a pattern takes or a rule requires, so the steps go backwards from those, and pairs that no
    rule asks for are never made.  Names come in last: until then a pair is two ints."""
    rules, callees = small(contracts), nodes.select(F.col("k").alias("target"), F.col("id").alias("callee"))
    hit = saved(callees.join(rules, _hit()).groupBy("contract_id", "target", "callee").agg(F.collect_set("exclusions").alias("kinds")))
    needed = saved(callees.join(rules.filter("required is not null"), F.col("callee") == F.col("required")).select("contract_id", "target").distinct())
    reach = graph.impact_radius(edges, hit.select("target").unionByName(needed.select("target")).distinct(), depth).filter("depth > 0")
    reach = saved(reach.select("target", F.col("id").alias("k")))
    cleared = reach.join(small(needed), "target").select("contract_id", "k").distinct()
    kept = F.exists("kinds", lambda kind: ~F.exists(kind, lambda p: F.startswith(F.lower("id"), F.lower(p))))
    hits = reach.join(small(nodes.select("k", "id")), "k").join(small(hit), "target").filter(kept)
    return hits.join(small(cleared), ["contract_id", "k"], "left_anti").select("contract_id", "id", "callee")


def naming(results: DataFrame) -> DataFrame:
    """query_id, verb, share: the commonest leading word of the names of a query's results, from a share of 0.6."""
    own = results.withColumn("verb", F.regexp_extract(F.lower(names.last_segment("name")), "^_*([a-z]+)", 1))
    by = own.groupBy("query_id", "verb").agg(F.count(F.lit(1)).alias("n"))
    top = by.groupBy("query_id").agg(F.sum("n").alias("total"), F.min(F.when(F.col("verb") != "", F.struct((-F.col("n")).alias("k"), "verb"))).alias("m"))
    return top.select("query_id", F.col("m.verb").alias("verb"), F.round(-F.col("m.k") / F.col("total"), 4).alias("share")).filter("share >= 0.6")


def missing_visits(methods: DataFrame, elements: DataFrame) -> DataFrame:
    """class_id, element: what a visitor does not visit.  elements: element, a bounded set of names; methods: class_id, method."""
    visitors = methods.filter(F.col("method").rlike("^visit_")).select("class_id").distinct()
    wanted = visitors.crossJoin(small(elements.select("element").distinct()))
    done = methods.select("class_id", F.regexp_extract("method", "^visit_(.+)$", 1).alias("element")).distinct()
    return wanted.join(done, ["class_id", "element"], "left_anti")
