"""Queries: what writes leave behind, over the orders as decisions, the nations as projects, and the documents as functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes as CH
from ..operators import lookups as L
from ..operators import memory as M
from ..operators import projects as P
from ..operators import validation as W
from ..operators import vectors as S
from . import code as C
from . import queries_code as K
from . import queries_lookup as Q
from . import views as V

TERMS = ((0, "get"), (0, "the"), (1, "of"), (2, "f7"))


def _projects(s, d):
    n = V.table(s, d, "nation")
    old = n.filter("n_nationkey < 18").select(F.col("n_name").alias("id"), F.lit("2024").alias("created_at"), F.lit("main").alias("branch"), F.col("n_nationkey").cast("int").alias("node_count"), F.col("n_regionkey").cast("int").alias("edge_count"))
    new = n.filter("n_nationkey > 9").select(F.col("n_name").alias("id"), F.lit("2025").alias("created_at"), F.lit("dev").alias("branch"), F.lit(5).alias("node_count"), F.when(F.col("n_nationkey") % 2 == 0, 6).alias("edge_count"))
    return old, new


def _tables(s, d):
    return {"nodes": V.nodes(s, d).select("project_id", "id"), "edges": V.edges(s, d).select(F.substring_index("caller_id", ".", 1).alias("project_id"), F.col("caller_id").alias("id")), "decisions": V.table(s, d, "region").select(F.col("r_name").alias("project_id"), F.col("r_name").alias("id"))}


_TABLES = V.with_views(", t as (select 'nodes' as tb, project_id, id from nodes union all select 'edges', split_part(caller_id, '.', 1), caller_id from edges union all select 'decisions', r_name, r_name from region)")


def _union(tables):
    out = None
    for name, table in sorted(tables.items()):
        own = table.select(F.lit(name).alias("tb"), "project_id", "id")
        out = own if out is None else out.unionByName(own)
    return out


def _counted(df):
    return df.groupBy("tb", "project_id").agg(F.count(F.lit(1)).alias("n"))


def _forked(s, d):
    return _counted(_union(P.fork_tables(_tables(s, d), "ASIA", P.fork_name("ASIA", "0123456789"))))


def _examples(s, d):
    return V.table(s, d, "events").select((F.col("user_id") % 20).alias("contract_id"), F.col("event_type").alias("kind"), F.col("event_id").alias("example"))


def _violations(s, d):
    e = V.table(s, d, "events").filter("event_type = 'error'")
    return e.select(F.col("user_id").cast("string").alias("contract_id"), F.col("event_id").cast("string").alias("function_id"), F.lit("structural").alias("violation_type"))


def _log(s, d):
    found = _violations(s, d)
    empty = s.createDataFrame([], "violation_id string, contract_id string, function_id string, violation_type string")
    once = M.log_violations(empty, found.filter("contract_id % 2 = 0"), "run 1")
    again = M.log_violations(once, found.filter("contract_id % 3 = 0"), "run 2")
    return M.log_violations(again, found.filter("contract_id % 2 = 0"), "run 1")


def _drafts(s, d):
    f = C.functions(s, d)
    return f.filter("n % 4 = 1").select(F.col("n").alias("draft_id"), "module", F.concat(F.when(F.col("n") % 3 == 0, "get_").otherwise("put_"), "name").alias("name"), "is_async", "body"), f.filter("n % 4 <> 1 and is_external = 0").select("module", F.concat(F.when(F.col("n") % 10 < 8, "get_").otherwise("put_"), "name").alias("name"), "is_async", F.lit("precise").alias("structural_layer"))


_FIELDS = {"name": 1.0, "docstring": 0.4, "signature": 0.2}
_WEIGHTED = """, terms(query_id, term) as (values {terms}),
words as ({words}),
hit as (select id, term, sum(w) as w from words where term in (select term from terms) group by all),
many as (select query_id, count(*) as m from terms group by 1),
got as (select query_id, id, round(sum(w), 6) as score from hit join terms using (term) join many using (query_id) group by query_id, id, m having count(*) = m)
select query_id, id, rank, score from (select *, row_number() over (partition by query_id order by score desc, id) as rank from got) where rank <= 20""".format(
    terms=", ".join(map(repr, TERMS)), words=" union all ".join(f"select id, unnest(regexp_split_to_array(lower({field}), '[^a-z0-9]+')) as term, cast({w} as double) as w from functions" for field, w in _FIELDS.items())
)

QUERIES = {
    "upsert_projects": (
        lambda s, d: P.upsert_projects(*_projects(s, d)).fillna(-1, ["node_count", "edge_count"]),
        """with o as (select n_name as id, '2024' as created_at, 'main' as branch, cast(n_nationkey as int) as nc, cast(n_regionkey as int) as ec from nation where n_nationkey < 18), n as (select n_name as id, n_nationkey as k from nation where n_nationkey > 9)
select coalesce(o.id, n.id) as id, coalesce(created_at, '2025') as created_at, case when n.id is null then branch else 'dev' end as branch, cast(coalesce(case when n.id is not null and k % 2 = 0 then 5 else nc end, -1) as int) as node_count, cast(coalesce(case when n.id is not null and k % 2 = 0 then 6 else ec end, -1) as int) as edge_count from o full join n on o.id = n.id""",
    ),
    "delete_project": (lambda s, d: P.delete_project(_tables(s, d), Q._contracts(s, d).withColumnRenamed("function_ids", "project_ids"), "ASIA")[2], _TABLES + ' select tb as "table", count(*) filter (where project_id = \'ASIA\') as n from t group by 1'),
    "projects_after_delete": (lambda s, d: _counted(_union(P.delete_project(_tables(s, d), Q._contracts(s, d).withColumnRenamed("function_ids", "project_ids"), "ASIA")[0])), _TABLES + " select tb, project_id, count(*) as n from t where project_id <> 'ASIA' group by all"),
    "fork_tables": (_forked, _TABLES + " select tb, project_id, count(*) as n from (select tb, project_id from t union all select tb, 'ASIA_fork_0123456' from t where project_id = 'ASIA' and tb <> 'decisions') group by all"),
    "rename_project": (lambda s, d: _counted(_union({n: P.rename_project(t, "ASIA", "EAST") for n, t in _tables(s, d).items()})), _TABLES + " select tb, case when project_id = 'ASIA' then 'EAST' else project_id end as project_id, count(*) as n from t group by all"),
    "delete_file_data": (
        lambda s, d: V.nodes(s, d).join(V.nodes(s, d).filter("project_id = 'ASIA'").select("file").distinct(), "file", "left_anti").groupBy("file").agg(F.count(F.lit(1)).alias("n")),
        V.with_views("select file, count(*) as n from nodes where file not in (select file from nodes where project_id = 'ASIA') group by 1"),
    ),
    "replace_examples": (
        lambda s, d: M.replace_examples(_examples(s, d), _examples(s, d).filter("contract_id % 5 = 0 and example % 100 = 0")).groupBy("contract_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("example").alias("newest")),
        "with e as (select user_id % 20 as contract_id, event_type as kind, event_id as example from events) select contract_id, kind, count(*) as n, max(example) as newest from e where contract_id not in (select contract_id from e where contract_id % 5 = 0 and example % 100 = 0) or (contract_id % 5 = 0 and example % 100 = 0) group by all",
    ),
    "update_summaries": (
        lambda s, d: M.set_fields(Q._nodes(s, d).select("id", "summary", "embedding_model"), C.functions(s, d).filter("n % 7 = 0").select("id", F.lit("new").alias("summary"), F.when(F.col("n") % 2 == 0, "small").alias("embedding_model")), "id"),
        C.with_code("," + Q._NODES + " select id, case when n % 7 = 0 then 'new' else summary end as summary, case when n % 14 = 0 then 'small' else embedding_model end as embedding_model from idx"),
    ),
    "log_violations": (
        lambda s, d: _log(s, d).select("violation_id", "contract_id", "function_id", "violation_type"),
        """with f as (select user_id, cast(user_id as varchar) as contract_id, cast(event_id as varchar) as function_id, 'structural' as violation_type from events where event_type = 'error')
select sha256(run || '|' || contract_id || '|' || function_id || '|structural') as violation_id, contract_id, function_id, violation_type from (select 'run 1' as run, * from f where user_id % 2 = 0 union all select 'run 2', * from f where user_id % 3 = 0)""",
    ),
    "top_commits": (lambda s, d: CH.top_commits(V.commit_changes(s, d)), V.with_views("select commit_hash, count(distinct function_id) as n_functions from commit_changes group by 1 order by n_functions desc, commit_hash limit 5")),
    "weighted_keywords": (lambda s, d: S.weighted_keywords(C.functions(s, d), s.createDataFrame(TERMS, "query_id long, term string"), 20, _FIELDS), C.with_code(_WEIGHTED)),
    "project_search": (
        lambda s, d: S.scoped_search(S.knn_blocks(V.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), V.table(s, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("id"), "embedding"), 12), C.functions(s, d).select(F.col("n").alias("id"), F.substring_index("module", ".", 1).alias("project_id")), "app", 3),
        C.with_code("," + Q._KNN + " select query_id, rank, id, similarity from (select query_id, knn.id, similarity, row_number() over (partition by query_id order by rank) as rank from knn join functions f on f.n = knn.id where split_part(module, '.', 1) = 'app') where rank <= 3"),
    ),
    "vector_cache": (
        lambda s, d: S.cache_vectors(C.functions(s, d).filter("n % 3 = 0").select("id"), C.functions(s, d).filter("n % 2 = 0").select(F.sha2("body", 256).alias("body_hash"), F.lit(1).alias("embedding")), C.functions(s, d).select("id", F.sha2("body", 256).alias("body_hash")))[0].select("id"),
        C.with_code("select id from functions where n % 3 <> 0 and sha256(body) not in (select sha256(body) from functions where n % 2 = 0)"),
    ),
    "vector_routes": (lambda s, d: S.route(Q._nodes(s, d)).groupBy("model").agg(F.count(F.lit(1)).alias("n")), C.with_code("," + Q._NODES + " select case when coalesce(docstring, '') <> '' or coalesce(summary, '') <> '' then 'small' else 'fallback' end as model, count(*) as n from idx group by 1")),
    "slim_results": (
        lambda s, d: L.slim(S.knn_blocks(V.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), V.table(s, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("id"), "embedding"), 12).join(C.functions(s, d).select(F.col("n").alias("id"), F.col("file").alias("detail")), "id")),
        C.with_code("," + Q._KNN + " select query_id, rank, knn.id, case when rank <= 3 then file end as detail from knn join functions f on f.n = knn.id"),
    ),
    "key_owners": (
        lambda s, d: P.key_owners(V.table(s, d, "orders").select(F.col("o_orderkey").alias("key_id"), F.col("o_custkey").alias("user_id")), V.table(s, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("email")), V.table(s, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("org_id"))).fillna(-1, ["org_id"]),
        "select o_orderkey as key_id, c_custkey as user_id, c_name as email, case when c_custkey % 3 = 0 then c_nationkey else -1 end as org_id from orders join customer on o_custkey = c_custkey",
    ),
    "violations_listed": (
        lambda s, d: L.filtered(V.table(s, d, "events").select("event_id", "user_id", "event_type"), [F.desc("event_id")], 100, event_type=["error", "click"], user_id=None),
        "select event_id, user_id, event_type from events where event_type in ('error', 'click') order by event_id desc limit 100",
    ),
    "draft_conformance": (
        lambda s, d: W.conformance(*_drafts(s, d)).select("draft_id", "n_deviations", "score"),
        C.with_code(f""", dr as (select n as draft_id, module, case when n % 3 = 0 then 'get' else 'put' end as verb, is_async, id, body from functions where n % 4 = 1),
ex as (select module, case when n % 10 < 8 then 'get' else 'put' end as verb, is_async from functions where n % 4 <> 1 and is_external = 0),
m as (select module, count(*) as n, sum(is_async) as a from ex group by 1), v as (select module, verb, count(*) as k, row_number() over (partition by module order by count(*) desc, verb) as r from ex group by module, verb),
cv as (select m.module, case when k / n >= 0.6 then verb end as verb, a / n as share from m join v using (module) where r = 1),{K._AWAITS},
dv as (
  select draft_id, 'naming' as c, 'medium' as s from dr join cv using (module) where cv.verb is not null and dr.verb <> cv.verb
  union select draft_id, 'async', 'high' from dr join cv using (module) where share > 0.7 and is_async = 0 union select draft_id, 'async', 'medium' from dr join cv using (module) where share < 0.3 and is_async = 1
  union select draft_id, 'awaits', 'high' from dr join awaits using (id) where dr.is_async = 1
  union select draft_id, 'n1', 'high' from dr where {K._LOOPS} and regexp_matches(body, {C.text(K.D.DB_SINK)})
)
select draft_id, count(c) as n_deviations, round(greatest(cast(0 as double), 1 - sum(case s when 'high' then 0.25 when 'medium' then 0.15 when 'low' then 0.05 else 0 end)), 4) as score from dr left join dv using (draft_id) group by 1"""),
    ),
}
