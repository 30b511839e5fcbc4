"""Drafts against the conventions of the module they go to, for all drafts at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from . import detectors as D

# What a deviation costs, and when a module counts as async or sync first.
COST = {"high": 0.25, "medium": 0.15, "low": 0.05}
ASYNC_FIRST, SYNC_FIRST, NAMING = 0.7, 0.3, 0.6


def _verb(col):
    return F.regexp_extract(F.lower(names.last_segment(col)), "^_*([a-z]+)", 1)


def conventions(existing: DataFrame) -> DataFrame:
    """module, verb (null without one), async_share (null where all nodes are parsed by pattern)."""
    by = existing.groupBy("module", _verb("name").alias("verb")).agg(F.count(F.lit(1)).alias("n"), F.sum("is_async").alias("a"), F.max((F.col("structural_layer") != "generic").cast("int")).alias("precise"))
    top = F.min(F.when(F.col("verb") != "", F.struct((-F.col("n")).alias("k"), "verb")))
    out = by.groupBy("module").agg(F.sum("n").alias("n"), F.sum("a").alias("a"), F.max("precise").alias("precise"), top.alias("t"))
    return out.select("module", F.when(-F.col("t.k") / F.col("n") >= NAMING, F.col("t.verb")).alias("verb"), F.when(F.col("precise") == 1, F.col("a") / F.col("n")).alias("async_share"))


def deviations(drafts: DataFrame, existing: DataFrame) -> DataFrame:
    """draft_id, check, severity: one row a check that a draft fails.  drafts: draft_id, module, name, is_async, body; one row a
    function.  Modules are joined by name, so a draft for a new module is only judged by its bodies."""
    own = drafts.join(conventions(existing), "module", "left")
    awaits = D.sequential_awaits(drafts.filter("is_async = 1").select(F.struct("draft_id", "name").alias("id"), "body")).select(F.col("id.draft_id").alias("draft_id"))
    found = [
        own.filter(F.col("verb").isNotNull() & (_verb("name") != F.col("verb"))).select("draft_id", F.lit("naming").alias("check"), F.lit("medium").alias("severity")),
        own.filter((F.col("async_share") > ASYNC_FIRST) & (F.col("is_async") == 0)).select("draft_id", F.lit("async").alias("check"), F.lit("high").alias("severity")),
        own.filter((F.col("async_share") < SYNC_FIRST) & (F.col("is_async") == 1)).select("draft_id", F.lit("async").alias("check"), F.lit("medium").alias("severity")),
        awaits.select("draft_id", F.lit("sequential_awaits").alias("check"), F.lit("high").alias("severity")),
        drafts.filter(D.has_loop() & F.col("body").rlike(D.DB_SINK)).select("draft_id", F.lit("n_plus_one").alias("check"), F.lit("high").alias("severity")),
    ]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.distinct()


def conformance(drafts: DataFrame, existing: DataFrame) -> DataFrame:
    """draft_id, n_deviations, score: 1 less what the deviations cost, 0 at least."""
    cost = F.coalesce(*[F.when(F.col("severity") == s, F.lit(c)) for s, c in COST.items()], F.lit(0.0))
    by = deviations(drafts, existing).groupBy("draft_id").agg(F.count(F.lit(1)).alias("n_deviations"), F.sum(cost).alias("cost"))
    out = drafts.select("draft_id").distinct().join(by, "draft_id", "left")
    return out.select("draft_id", F.coalesce("n_deviations", F.lit(0)).alias("n_deviations"), F.round(F.greatest(F.lit(0.0), 1 - F.coalesce("cost", F.lit(0.0))), 4).alias("score"))


def preflight(hot: DataFrame, spread: DataFrame, findings: DataFrame) -> DataFrame:
    """kind, subject, score: what to look at before a change: hotspots (id, score), libraries called from several files (library, caller_files,
    scattered), patterns with findings (pattern, n); each table is short by its own limit."""
    return (
        hot.select(F.lit("hotspot").alias("kind"), F.col("id").alias("subject"), F.col("score").cast("double").alias("score"))
        .unionByName(spread.filter("scattered").select(F.lit("scatter").alias("kind"), F.col("library").alias("subject"), F.col("caller_files").cast("double").alias("score")))
        .unionByName(findings.select(F.lit("finding").alias("kind"), F.col("pattern").alias("subject"), F.col("n").cast("double").alias("score")))
    )
