"""Coverage, health and decision reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bounds import small


def coverage(nodes: DataFrame, vectors: DataFrame, by: str) -> DataFrame:
    """by, expected, actual, missing, percent: how many nodes of a group have a vector."""
    own = nodes.select("id", by).join(vectors.select("id").distinct().withColumn("has", F.lit(1)), "id", "left")
    out = own.groupBy(by).agg(F.count(F.lit(1)).alias("expected"), F.count("has").alias("actual"))
    return out.withColumn("missing", F.col("expected") - F.col("actual")).withColumn("percent", F.round(100.0 * F.col("actual") / F.col("expected"), 1))


def index_status(counts: DataFrame) -> DataFrame:
    """counts with a status: partial before degraded before ok."""
    return counts.withColumn("status", F.when(F.col("actual") < F.col("expected"), "partial").when(F.col("degraded") > 0, "degraded").otherwise("ok"))


def health(nodes: DataFrame, vectors: DataFrame, edges: DataFrame) -> DataFrame:
    """One row a project: totals, shares and a verdict, each side aggregated before it is joined."""
    own = nodes.join(vectors.select("id").distinct().withColumn("has", F.lit(1)), "id", "left")
    a = own.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("n_nodes"), F.count_if(F.col("is_external") == 0).alias("n_internal"), F.count("has").alias("n_vectors"), F.count_if(F.col("docstring") != "").alias("n_documented")
    )
    out = edges.select(F.col("caller_id").alias("id")).distinct().join(nodes.select("id", "project_id"), "id").groupBy("project_id").agg(F.count(F.lit(1)).alias("n_callers"))
    both = a.join(out, "project_id", "left").withColumn("n_callers", F.coalesce("n_callers", F.lit(0)))
    share = F.round(100.0 * F.col("n_vectors") / F.col("n_nodes"), 1)
    return both.withColumn("vector_percent", share).withColumn("verdict", F.when(F.col("n_nodes") == 0, "empty").when(F.col("vector_percent") >= 80, "healthy").when(F.col("vector_percent") >= 30, "partial").otherwise("degraded"))


def recent_decisions(decisions: DataFrame, links: DataFrame, n: int = 5) -> DataFrame:
    """The newest n decisions with their functions; the top n is taken before the join."""
    top = decisions.orderBy(F.desc("created_at"), F.desc("decision_id")).limit(n)
    own = links.join(small(top.select("decision_id")), "decision_id", "left_semi")
    out = top.join(own, "decision_id", "left")
    return out.groupBy("decision_id", "type", "created_at").agg(F.array_join(F.sort_array(F.collect_list("function_id")), ",").alias("functions"), F.count("function_id").alias("n_functions"))


def churn(decisions: DataFrame, links: DataFrame) -> DataFrame:
    """function_id, n_decisions, last_decided."""
    return links.join(decisions, "decision_id").groupBy("function_id").agg(F.count(F.lit(1)).alias("n_decisions"), F.max("created_at").alias("last_decided"))


def decision_coverage(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """n_nodes, n_decided, n_decisions."""
    return nodes.join(links, F.col("id") == F.col("function_id"), "left").agg(F.count_distinct("id").alias("n_nodes"), F.count_distinct("function_id").alias("n_decided"), F.count_distinct("decision_id").alias("n_decisions"))


def access(requests: DataFrame, grants: DataFrame, demos: DataFrame) -> DataFrame:
    """requests (user_id, project_id) with can_read, can_write: demos are read by all, owners write, viewers read."""
    out = requests.join(grants.select("user_id", "project_id", "role"), ["user_id", "project_id"], "left").join(demos.select("project_id").distinct().withColumn("demo", F.lit(True)), "project_id", "left")
    return out.select("user_id", "project_id", (F.coalesce("demo", F.lit(False)) | F.col("role").isNotNull()).alias("can_read"), F.coalesce(F.col("role") == "owner", F.lit(False)).alias("can_write"))


def session_seen(events: DataFrame) -> DataFrame:
    """session_id, kind, n_seen: distinct items each session saw by kind."""
    return events.groupBy("session_id", "kind").agg(F.count_distinct("item").alias("n_seen"))
