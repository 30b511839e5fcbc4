"""Subsystems and what connects them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names


def subsystem_map(nodes: DataFrame, most: int = 300) -> DataFrame:
    """id, subsystem: the first two segments, or three where more than `most` internal nodes share two.  Sizes come from an
    aggregate that joins back, so a huge subsystem is never one task's window."""
    own = nodes.filter("is_external = 0").select("id", names.prefix("id", 2).alias("two"), names.prefix("id", 3).alias("three"))
    sizes = own.groupBy("two").agg(F.count(F.lit(1)).alias("n"))
    return own.join(sizes, "two").select("id", F.when(F.col("n") > most, F.col("three")).otherwise(F.col("two")).alias("subsystem"))


def subsystem_anchors(nodes: DataFrame, counts: DataFrame, mapping: DataFrame) -> DataFrame:
    """subsystem, n_members, anchor: the most called class, else the most called node; ties to the lesser id."""
    own = mapping.join(nodes.select("id", "type"), "id").join(counts.select(F.col("callee_id").alias("id"), "callers"), "id", "left").withColumn("callers", F.coalesce("callers", F.lit(0)))
    best = F.struct((F.col("type") != "class").cast("int").alias("k"), (-F.col("callers")).alias("c"), "id")
    return own.groupBy("subsystem").agg(F.count(F.lit(1)).alias("n_members"), F.min(best).alias("b")).select("subsystem", "n_members", F.col("b.id").alias("anchor"))


def connections(edges: DataFrame, mapping: DataFrame, least: int = 2, top: int | None = 30) -> DataFrame:
    """from_subsystem, to_subsystem, n: calls between subsystems, both ends internal."""
    a = mapping.select(F.col("id").alias("caller_id"), F.col("subsystem").alias("from_subsystem"))
    b = mapping.select(F.col("id").alias("callee_id"), F.col("subsystem").alias("to_subsystem"))
    calls = edges.groupBy("caller_id", "callee_id").agg(F.count(F.lit(1)).alias("k"))
    out = calls.join(a, "caller_id").join(b, "callee_id").filter("from_subsystem <> to_subsystem").groupBy("from_subsystem", "to_subsystem").agg(F.sum("k").alias("n")).filter(F.col("n") >= least)
    return out.orderBy(F.desc("n"), "from_subsystem", "to_subsystem").limit(top) if top else out


def top_members(mapping: DataFrame, counts: DataFrame, n: int = 3) -> DataFrame:
    """subsystem, rank, id, callers: the n most called members of each."""
    own = mapping.join(counts.select(F.col("callee_id").alias("id"), "callers"), "id")
    w = Window.partitionBy("subsystem").orderBy(F.desc("callers"), "id")
    return own.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= n).select("subsystem", "rank", "id", "callers")


def hotspots(edges: DataFrame, least: int = 4, top: int = 8) -> DataFrame:
    """id, fan_in, fan_out, score: the nodes of the largest product of incoming and outgoing edges."""
    into = edges.groupBy(F.col("callee_id").alias("id")).agg(F.count(F.lit(1)).alias("fan_in"))
    out = edges.groupBy(F.col("caller_id").alias("id")).agg(F.count(F.lit(1)).alias("fan_out"))
    both = into.join(out, "id", "full_outer").select("id", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out")).withColumn("score", F.col("fan_in") * F.col("fan_out"))
    return both.filter(F.col("score") >= least).orderBy(F.desc("score"), "id").limit(top)


def scatter(edges: DataFrame, library, least: int = 3) -> DataFrame:
    """library, caller_files, call_sites, scattered: how widely each library is called."""
    own = edges.withColumn("library", library)
    return own.groupBy("library").agg(F.count_distinct("file").alias("caller_files"), F.count(F.lit(1)).alias("call_sites")).withColumn("scattered", F.col("caller_files") >= least)


def external_dependencies(nodes: DataFrame, edges: DataFrame, library) -> DataFrame:
    """library, n_symbols, n_callers: external nodes by library with their distinct callers, none included."""
    ext = nodes.filter("is_external = 1").select(F.col("id").alias("callee_id"), library.alias("library"))
    calls = edges.select("callee_id", "caller_id").distinct()
    return ext.join(calls, "callee_id", "left").groupBy("library").agg(F.count_distinct("callee_id").alias("n_symbols"), F.count_distinct("caller_id").alias("n_callers"))


def concentration(results: DataFrame, least: float = 0.75) -> DataFrame:
    """query_id, module, share, fires: the commonest module of each query's results, ties to the lesser name."""
    by = results.groupBy("query_id", "module").agg(F.count(F.lit(1)).alias("n"))
    top = by.groupBy("query_id").agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("k"), "module")).alias("m"))
    share = F.round(-F.col("m.k") / F.col("total"), 4)
    return top.select("query_id", F.col("m.module").alias("module"), share.alias("share"), (share >= least).alias("fires"))
