"""Queries on rules, detectors and health."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..operators import changes as C
from ..operators import health as H
from ..operators import rules as R
from . import views as V

CONTRACTS = (("c1", "nterti", None, ["zz"]), ("c2", "Brand1.*", "Brand2.LARGE.p1", ["brand3"]), ("c3", "p7", None, ["brand1."]))


def _contracts(s, d):
    rules = s.createDataFrame(CONTRACTS, "contract_id string, pattern string, required string, exclusions array<string>")
    return R.contract_violations_within(rules, *V.numbered_parts(s, d), 2)


_SUBJECTS = ("Fix a", "add b", "Refactor c", "architecture of d", "misc", "Revert e", "newer f", "drop g")


def _commits(s, d):
    subject = F.concat_ws(" ", F.element_at(F.array(*map(F.lit, _SUBJECTS)), (F.col("p_partkey") % len(_SUBJECTS) + 1).cast("int")), "p_name")
    return C.classify_commits(V.table(s, d, "part").select(F.col("p_partkey").alias("commit_hash"), subject.alias("subject"))).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def _vectors_of_customers(s, d):
    n = V.nodes(s, d)
    keyed = n.withColumn("k", F.substring("name", -9, 9).cast("long"))
    return keyed.join(V.table(s, d, "embeddings").select(F.col("vec_id").alias("k")), "k", "left_semi").select("id")


_HAS = """, vec as (select id from nodes where cast(right(name, 9) as bigint) in (select vec_id from embeddings))"""

QUERIES = {
    "solid_srp": (
        lambda s, d: R.single_responsibility(V.part_edges(s, d), V.part_nodes(s, d).select("id", names.prefix("id", 2).alias("subsystem"))),
        V.with_views("""select caller_id as id, count(distinct b) as n_subsystems, case when count(distinct b) >= 4 then 'high' else 'medium' end as severity from (
  select caller_id, split_part(caller_id, '.', 1) || '.' || split_part(caller_id, '.', 2) as a, split_part(callee_id, '.', 1) || '.' || split_part(callee_id, '.', 2) as b from part_edges) where a <> b group by 1 having count(distinct b) >= 3"""),
    ),
    "contract_check": (
        _contracts,
        V.with_views(
            """, reach(target, id, depth) as (select id, id, 0 from part_nodes union select r.target, e.callee_id, r.depth + 1 from reach r join part_edges e on e.caller_id = r.id where depth < 2),
r as (select distinct target as id, id as callee from reach where id <> target)
select 'c2' as contract_id, id, callee from r where starts_with(callee, 'Brand1.') and not starts_with(lower(id), 'brand3') and id not in (select id from r where callee = 'Brand2.LARGE.p1')
union all select 'c3', id, callee from r where split_part(callee, '.', 3) = 'p7' and not starts_with(lower(id), 'brand1.')""",
            True,
        ),
    ),
    "naming_signal": (
        lambda s, d: R.naming(V.table(s, d, "part").select(F.expr("p_partkey div 3").alias("query_id"), F.translate("p_name", " ", "_").alias("name"))),
        """with c as (select p_partkey // 3 as query_id, regexp_extract(lower(p_name), '^_*([a-z]+)', 1) as verb, count(*) as n from part group by all)
select query_id, verb, share from (select query_id, verb, round(n / sum(n) over (partition by query_id), 4) as share, row_number() over (partition by query_id order by n desc, verb) as k from c) where k = 1 and share >= 0.6""",
    ),
    "commit_types": (
        _commits,
        f"""select case when regexp_matches(s, '^(fix|bug|patch|hotfix|revert)') then 'Patch' when regexp_matches(s, '^(add|feat|impl|build|create|new|support)') then 'Implementation'
  when regexp_matches(s, '^(refactor|redesign|move|extract|restructure|rename|clean|drop|remove)') then 'Design' when starts_with(s, 'arch') then 'Architectural' else 'Patch' end as type, count(*) as n
from (select lower(({list(_SUBJECTS)})[p_partkey % {len(_SUBJECTS)} + 1] || ' ' || p_name) as s from part) group by 1""",
    ),
    "path_modules": (
        lambda s, d: V.nodes(s, d).select(names.module_of("file").alias("module")).groupBy("module").agg(F.count(F.lit(1)).alias("n")),
        V.with_views("select module, count(*) as n from nodes group by 1"),
    ),
    "embedding_coverage": (
        lambda s, d: H.coverage(V.nodes(s, d), _vectors_of_customers(s, d), "project_id"),
        V.with_views(_HAS + """ select project_id, count(*) as expected, count(v.id) as actual, count(*) - count(v.id) as missing, round(100.0 * count(v.id) / count(*), 1) as percent from nodes n left join vec v on v.id = n.id group by 1"""),
    ),
    "index_status": (
        lambda s, d: H.index_status(H.coverage(V.nodes(s, d), _vectors_of_customers(s, d), "module").join(V.nodes(s, d).groupBy("module").agg(F.count_if(F.col("weight") < 0).alias("degraded")), "module")).select("module", "expected", "actual", "degraded", "status"),
        V.with_views(_HAS + """ select module, expected, actual, degraded, case when actual < expected then 'partial' when degraded > 0 then 'degraded' else 'ok' end as status from (
  select module, count(*) as expected, count(v.id) as actual, count(*) filter (where weight < 0) as degraded from nodes n left join vec v on v.id = n.id group by 1)"""),
    ),
    "index_health": (
        lambda s, d: H.health(V.nodes(s, d), _vectors_of_customers(s, d), V.edges(s, d)),
        V.with_views(
            _HAS
            + """, a as (select project_id, count(*) as n_nodes, count(*) filter (where is_external = 0) as n_internal, count(v.id) as n_vectors, count(*) filter (where docstring <> '') as n_documented from nodes n left join vec v on v.id = n.id group by 1),
b as (select project_id, count(distinct caller_id) as n_callers from edges join nodes on id = caller_id group by 1)
select project_id, n_nodes, n_internal, n_vectors, n_documented, coalesce(n_callers, 0) as n_callers, round(100.0 * n_vectors / n_nodes, 1) as vector_percent,
  case when n_nodes = 0 then 'empty' when round(100.0 * n_vectors / n_nodes, 1) >= 80 then 'healthy' when round(100.0 * n_vectors / n_nodes, 1) >= 30 then 'partial' else 'degraded' end as verdict from a left join b using (project_id)"""
        ),
    ),
    "decision_coverage": (
        lambda s, d: H.decision_coverage(V.table(s, d, "part").select(F.col("p_partkey").alias("id")), V.decision_links(s, d).filter("decision_id % 3 = 0")),
        V.with_views("select count(distinct p_partkey) as n_nodes, count(distinct function_id) as n_decided, count(distinct decision_id) as n_decisions from part left join (select * from decision_links where decision_id % 3 = 0) on function_id = p_partkey"),
    ),
    "access_check": (
        lambda s, d: H.access(
            V.table(s, d, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 30).alias("project_id")),
            V.table(s, d, "customer").filter("c_custkey % 4 < 2").select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 30).alias("project_id"), F.when(F.col("c_custkey") % 4 == 0, "owner").otherwise("viewer").alias("role")),
            V.table(s, d, "nation").filter("n_nationkey % 6 = 0").select(F.col("n_nationkey").cast("long").alias("project_id")),
        ),
        """select c_custkey as user_id, c_custkey % 30 as project_id, c_custkey % 4 < 2 or c_custkey % 30 in (select n_nationkey from nation where n_nationkey % 6 = 0) as can_read, c_custkey % 4 = 0 as can_write from customer""",
    ),
    "session_guidance": (
        lambda s, d: H.session_seen(V.table(s, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("role").alias("kind"), F.col("turn").alias("item"))),
        "select conv_id as session_id, role as kind, count(distinct turn) as n_seen from conversations group by all",
    ),
    "recent_violations": (
        lambda s, d: V.table(s, d, "events").filter("event_type = 'error' and ts > timestamp_ntz '2024-01-30 00:00:00' - interval 7 days").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")),
        "select user_id, count(*) as n from events where event_type = 'error' and ts > timestamp '2024-01-30 00:00:00' - interval 7 day group by 1",
    ),
    "label_coverage": (
        lambda s, d: V.table(s, d, "documents").join(V.table(s, d, "labels"), "doc_id", "left").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count("toxic").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good")),
        "select lang, count(*) as n, count(toxic) as labelled, count(*) filter (where quality = 1) as good from documents left join labels using (doc_id) group by 1",
    ),
}
