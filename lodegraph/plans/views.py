"""The test tables seen as a code graph, once as DataFrames and once as SQL, shared by all queries.

Customers and suppliers are nodes (function and class) named region.nation.name; each line of an order is a call from its
customer to its supplier.  Parts are nodes too, with an edge from a part to the next one of the same order, which gives a
graph with cycles.  Orders are decisions and commits, their parts the functions they touch; events are branch touches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph as G


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """project_id, id, name, module, file, type, is_external, body, docstring."""
    place = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    place = place.select("n_nationkey", "r_name", "n_name")

    def side(name: str, p: str, kind: str, external) -> DataFrame:
        own = table(spark, d, name).join(F.broadcast(place), F.col(f"{p}_nationkey") == F.col("n_nationkey"))
        label = F.col(f"{p}_name")
        return own.select(
            F.col("r_name").alias("project_id"), F.concat_ws(".", "r_name", "n_name", label).alias("id"), label.alias("name"), F.concat_ws(".", "r_name", "n_name").alias("module"),
            F.concat(F.lit("/"), F.col("r_name"), F.lit("/"), F.col("n_name"), F.lit(".py")).alias("file"), F.lit(kind).alias("type"), external.cast("int").alias("is_external"),
            F.col(f"{p}_acctbal").alias("weight"), F.when(F.col(f"{p}_acctbal") > 5000, label).otherwise("").alias("docstring"),
        )

    return side("customer", "c", "function", F.lit(0)).unionByName(side("supplier", "s", "class", F.col("s_acctbal") < 0))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """caller_id, callee_id, edge_type, file: a multiset, one row a call site."""
    n = nodes(spark, d)
    who = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name")).join(n.select("name", "id", "file"), "name").select("c_custkey", F.col("id").alias("caller_id"), "file")
    what = table(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("name")).join(n.select("name", F.col("id").alias("callee_id")), "name").select("s_suppkey", "callee_id")
    calls = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    calls = calls.join(who, F.col("o_custkey") == F.col("c_custkey")).join(what, F.col("l_suppkey") == F.col("s_suppkey"))
    return calls.select("caller_id", "callee_id", F.lit("calls").alias("edge_type"), "file")


def part_nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.concat_ws(".", F.translate("p_brand", "#", ""), "p_type", F.concat(F.lit("p"), F.col("p_partkey").cast("string"))).alias("id"), "p_partkey", F.col("p_name").alias("name"), "p_size", "p_retailprice")


def _part_steps(spark: SparkSession, d: str) -> DataFrame:
    """l_partkey, nxt: the steps from a part to the next one of the same order, one a pair of lines."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").withColumn("nxt", F.lead("l_partkey").over(w)).filter("nxt is not null and nxt <> l_partkey").select("l_partkey", "nxt")


def part_edges(spark: SparkSession, d: str) -> DataFrame:
    """caller_id, callee_id: distinct steps from a part to the next one of the same order."""
    ids = part_nodes(spark, d).select("p_partkey", "id")
    return _between(_part_steps(spark, d).distinct(), ids)


def _between(steps: DataFrame, ids: DataFrame) -> DataFrame:
    steps = steps.join(ids.select(F.col("p_partkey").alias("l_partkey"), F.col("id").alias("caller_id")), "l_partkey").join(ids.select(F.col("p_partkey").alias("nxt"), F.col("id").alias("callee_id")), "nxt")
    return steps.select("caller_id", "callee_id")


def numbered_parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """nodes: k, id; edges: caller_id, callee_id as numbers k, which may repeat.  The graph of part_nodes and part_edges in ints."""
    ids = G.numbered(part_nodes(spark, d).select("id", "p_partkey").distinct())
    return ids.select("k", "id"), _between(_part_steps(spark, d), ids.select("p_partkey", F.col("k").alias("id")))


def commit_changes(spark: SparkSession, d: str) -> DataFrame:
    """commit_hash, function_id: distinct touches."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit_hash"), F.col("l_partkey").alias("function_id")).distinct()


def branch_touches(spark: SparkSession, d: str) -> DataFrame:
    """branch, function_id, head_commit, modified_at: an append-only log."""
    return table(spark, d, "events").select(F.col("event_type").alias("branch"), F.col("user_id").alias("function_id"), F.col("event_id").alias("head_commit"), F.col("ts").alias("modified_at"))


def decisions(spark: SparkSession, d: str) -> DataFrame:
    """decision_id, type, created_at."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("decision_id"), F.col("o_orderpriority").alias("type"), F.col("o_orderdate").alias("created_at"))


def decision_links(spark: SparkSession, d: str) -> DataFrame:
    """decision_id, function_id."""
    return commit_changes(spark, d).withColumnRenamed("commit_hash", "decision_id")


SQL = """
place as (select n_nationkey, r_name, n_name from nation join region on n_regionkey = r_regionkey),
nodes as (
  select r_name as project_id, r_name || '.' || n_name || '.' || c_name as id, c_name as name, r_name || '.' || n_name as module, '/' || r_name || '/' || n_name || '.py' as file,
    'function' as type, cast(0 as int) as is_external, c_acctbal as weight, case when c_acctbal > 5000 then c_name else '' end as docstring
  from customer join place on c_nationkey = n_nationkey
  union all
  select r_name, r_name || '.' || n_name || '.' || s_name, s_name, r_name || '.' || n_name, '/' || r_name || '/' || n_name || '.py', 'class', cast(s_acctbal < 0 as int), s_acctbal,
    case when s_acctbal > 5000 then s_name else '' end
  from supplier join place on s_nationkey = n_nationkey
),
edges as (
  select a.id as caller_id, b.id as callee_id, 'calls' as edge_type, a.file as file
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey
    join nodes a on a.name = c_name join nodes b on b.name = s_name
),
part_nodes as (select replace(p_brand, '#', '') || '.' || p_type || '.p' || p_partkey as id, p_partkey, p_name as name, p_size, p_retailprice from part),
part_edges as (
  select distinct a.id as caller_id, b.id as callee_id
  from (select l_partkey, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey) as nxt from lineitem) t
    join part_nodes a on a.p_partkey = l_partkey join part_nodes b on b.p_partkey = nxt where nxt <> l_partkey
),
commit_changes as (select distinct l_orderkey as commit_hash, l_partkey as function_id from lineitem),
branch_touches as (select event_type as branch, user_id as function_id, event_id as head_commit, ts as modified_at from events),
decisions as (select o_orderkey as decision_id, o_orderpriority as type, o_orderdate as created_at from orders),
decision_links as (select commit_hash as decision_id, function_id from commit_changes)
"""


def with_views(sql: str, recursive: bool = False) -> str:
    """sql (which may begin with more named queries, each ending in a comma but the last) over the views."""
    return f"with {'recursive ' if recursive else ''}{SQL}{sql}"
