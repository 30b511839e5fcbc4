"""Queries on change logs, decisions, snapshots and writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..operators import changes as C
from ..operators import diffs as D
from ..operators import health as H
from . import views as V

_CO = """, co as (select a.function_id as a, b.function_id as b, count(*) as n from commit_changes a join commit_changes b using (commit_hash) where a.function_id <> b.function_id group by all having count(*) >= {least})"""


def _paths(s, d):
    n = V.nodes(s, d)
    files = n.select("file").distinct()
    return C.match_paths(files, files.select(F.concat(F.lit("home/x"), "file").alias("path")).unionByName(files.select(F.concat(F.lit("b/"), F.substring_index("file", "/", -1)).alias("path"))))


def _snapshots(s, d):
    docs = V.table(s, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "doc_id", names.short_hash("text").alias("hash"))
    old = docs.filter("doc_id % 7 <> 0").select("id", "hash")
    new = docs.filter("doc_id % 11 <> 0").select("id", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("x"), "hash")).otherwise(F.col("hash")).alias("hash"))
    return D.reconcile(old, new)


_SNAP = """with docs as (select cast(doc_id as varchar) as id, doc_id, substr(sha256(text), 1, 16) as hash from documents),
o as (select id, hash from docs where doc_id % 7 <> 0), n as (select id, case when doc_id % 5 = 0 then 'x' || hash else hash end as hash from docs where doc_id % 11 <> 0),
b as (select coalesce(o.id, n.id) as id, o.hash as old, n.hash as new, case when o.id is null then 'added' when n.id is null then 'removed' when o.hash = n.hash then 'unchanged' else 'changed' end as status from o full join n on o.id = n.id)
"""


def _upsert(s, d):
    c = V.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("body"), F.when(F.col("c_acctbal") > 0, "kept").alias("summary"))
    new = c.filter("id % 3 = 0").select("id", F.concat("body", F.lit("!")).alias("body"), F.lit("new").alias("summary")).unionByName(c.filter("id < 20").select((F.col("id") + 1000000).alias("id"), "body", F.lit("new").alias("summary")))
    return D.upsert(c, new, ["id"], keep=("summary",))


QUERIES = {
    "co_change": (lambda s, d: C.co_occurrence(V.commit_changes(s, d), "commit_hash"), V.with_views(_CO.format(least=3) + " select a, b, n from co")),
    "decision_co_links": (lambda s, d: C.co_occurrence(V.decision_links(s, d), "decision_id", least=2), V.with_views(_CO.format(least=2) + " select a, b, n from co")),
    "co_change_merged": (
        lambda s, d: C.merge_evidence(C.co_occurrence(V.commit_changes(s, d), "commit_hash", least=3), C.co_occurrence(V.decision_links(s, d), "decision_id", least=2)),
        V.with_views(_CO.format(least=2) + " select a, b, n, case when n >= 3 then 'git' else 'decision' end as source from co"),
    ),
    "branch_latest": (
        lambda s, d: C.latest(V.branch_touches(s, d), ["branch", "function_id"], "modified_at", "head_commit").select("branch", "function_id", "head_commit"),
        V.with_views("select branch, function_id, head_commit from (select *, row_number() over (partition by branch, function_id order by modified_at desc, head_commit desc) as k from branch_touches) where k = 1"),
    ),
    "branch_conflicts": (
        lambda s, d: C.branch_conflicts(V.branch_touches(s, d), "click", ("purchase",)),
        V.with_views("""select function_id, string_agg(distinct branch, ',' order by branch) as branches, count(distinct branch) as n_branches, bool_or(branch = 'purchase') as drift from branch_touches
where branch <> 'click' and function_id in (select function_id from branch_touches where branch = 'click') group by function_id"""),
    ),
    "commit_summary": (lambda s, d: C.commit_summary(V.commit_changes(s, d)), V.with_views("select count(*) as n_rows, count(distinct commit_hash) as n_commits, count(distinct function_id) as n_functions from commit_changes")),
    "commit_append": (
        lambda s, d: C.append_absent(V.commit_changes(s, d).filter("commit_hash % 2 = 0"), V.commit_changes(s, d), ["commit_hash", "function_id"]).groupBy("function_id").agg(F.count(F.lit(1)).alias("n")),
        V.with_views("select function_id, count(*) as n from commit_changes group by 1"),
    ),
    "path_match": (
        _paths,
        V.with_views(""", f as (select distinct file from nodes), p as (select 'home/x' || file as path from f union select 'b/' || split_part(file, '/', 3) from f),
k as (select file, 1 as n, split_part(file, '/', 3) as key from f union all select file, 2, split_part(file, '/', 2) || '/' || split_part(file, '/', 3) from f),
q as (select path, i as n, array_to_string(list_slice(string_split(path, '/'), len(string_split(path, '/')) - i + 1, 99), '/') as key from p, (values (1), (2)) t(i))
select path, file, cast(n as int) as n from (select path, file, q.n, row_number() over (partition by path order by q.n desc, file) as r from q join k on k.n = q.n and k.key = q.key) where r = 1"""),
    ),
    "reconcile": (_snapshots, _SNAP + "select id, status, old, new, status in ('added', 'changed') as to_embed, status in ('removed', 'changed') as to_delete from b"),
    "reconcile_counts": (lambda s, d: _snapshots(s, d).groupBy("status").agg(F.count(F.lit(1)).alias("n")), _SNAP + "select status, count(*) as n from b group by 1"),
    "compare_projects": (
        lambda s, d: D.reconcile(
            V.nodes(s, d).filter("project_id = 'ASIA' and is_external = 0").select(F.substring("name", -3, 3).alias("id"), "type", "weight").groupBy("id").agg(F.max("type").alias("hash")),
            V.nodes(s, d).filter("project_id = 'EUROPE' and is_external = 0").select(F.substring("name", -3, 3).alias("id"), "type").groupBy("id").agg(F.max("type").alias("hash")),
        ).filter("status <> 'unchanged'").select("id", "status", "old", "new"),
        V.with_views(""", a as (select right(name, 3) as id, max(type) as h from nodes where project_id = 'ASIA' and is_external = 0 group by 1), b as (select right(name, 3) as id, max(type) as h from nodes where project_id = 'EUROPE' and is_external = 0 group by 1)
select coalesce(a.id, b.id) as id, case when a.id is null then 'added' when b.id is null then 'removed' else 'changed' end as status, a.h as old, b.h as new from a full join b on a.id = b.id where a.h is distinct from b.h"""),
    ),
    "fingerprint_hash": (
        lambda s, d: D.fingerprint(V.nodes(s, d).filter("is_external = 1"), "module", ["id", "type"]),
        V.with_views("select module, count(*) as n_symbols, substr(sha256(string_agg(substr(sha256(id || '|' || type), 1, 16), chr(10) order by substr(sha256(id || '|' || type), 1, 16))), 1, 16) as hash from nodes where is_external = 1 group by module"),
    ),
    "fingerprint_diff": (
        lambda s, d: D.reconcile(
            D.fingerprint(V.nodes(s, d).filter("is_external = 1"), "module", ["id"]), D.fingerprint(V.nodes(s, d).filter("is_external = 1 and weight < -100"), "module", ["id"]), "module", "hash"
        ).select("id", "status"),
        V.with_views(""", a as (select module, string_agg(id, chr(10) order by id) as h from nodes where is_external = 1 group by 1), b as (select module, string_agg(id, chr(10) order by id) as h from nodes where is_external = 1 and weight < -100 group by 1)
select a.module as id, case when b.module is null then 'removed' when a.h = b.h then 'unchanged' else 'changed' end as status from a left join b using (module)"""),
    ),
    "upsert_nodes": (
        _upsert,
        """with c as (select c_custkey as id, c_name as body, case when c_acctbal > 0 then 'kept' end as summary from customer)
select id, case when id % 3 = 0 then body || '!' else body end as body, case when id % 3 = 0 then coalesce(summary, 'new') else summary end as summary from c union all select id + 1000000, body, 'new' from c where id < 20""",
    ),
    "fork_project": (
        lambda s, d: D.fork(V.nodes(s, d), "ASIA", "ASIA_fork").select("project_id", "id", "type"),
        V.with_views("select 'ASIA_fork' as project_id, id, type from nodes where project_id = 'ASIA'"),
    ),
    "delete_guarded": (
        lambda s, d: D.delete_where(V.nodes(s, d), "file = '/ASIA/NATION_2.py' or is_external = 1").groupBy("project_id").agg(F.count(F.lit(1)).alias("n")),
        V.with_views("select project_id, count(*) as n from nodes where not (file = '/ASIA/NATION_2.py' or is_external = 1) group by 1"),
    ),
    "retention_trim": (
        lambda s, d: D.newest(V.table(s, d, "events"), "ts", "event_id", 5000).select("event_id"),
        "select event_id from events order by ts desc, event_id desc limit 5000",
    ),
    "recent_decisions": (
        lambda s, d: H.recent_decisions(V.decisions(s, d), V.decision_links(s, d)),
        V.with_views("""select decision_id, type, created_at, coalesce(string_agg(cast(function_id as varchar), ',' order by function_id), '') as functions, count(function_id) as n_functions
from (select * from decisions order by created_at desc, decision_id desc limit 5) left join decision_links using (decision_id) group by all"""),
    ),
    "decision_churn": (
        lambda s, d: H.churn(V.decisions(s, d), V.decision_links(s, d)),
        V.with_views("select function_id, count(*) as n_decisions, max(created_at) as last_decided from decision_links join decisions using (decision_id) group by 1"),
    ),
    "latest_per_function": (
        lambda s, d: C.latest(V.decision_links(s, d).join(V.decisions(s, d), "decision_id"), ["function_id"], "created_at", "decision_id").select("function_id", "decision_id", "type"),
        V.with_views("select function_id, decision_id, type from (select *, row_number() over (partition by function_id order by created_at desc, decision_id desc) as k from decision_links join decisions using (decision_id)) where k = 1"),
    ),
    "fingerprint_history": (
        lambda s, d: V.table(s, d, "events").select("user_id", "event_id", "ts", F.from_json("props", "k int")["k"].alias("k")).withColumn("before", F.expr("lag(k) over (partition by user_id order by ts, event_id)")).filter("before is not null and before <> k").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_changes")),
        "select user_id, count(*) as n_changes from (select user_id, k, lag(k) over (partition by user_id order by ts, event_id) as b from (select *, cast(json_extract(props, '$.k') as int) as k from events)) where b is not null and b <> k group by 1",
    ),
    "last_definition": (
        lambda s, d: V.table(s, d, "events").withColumn("definition", F.expr("last(case when event_type = 'signup' then event_id end, true) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row)")).filter("event_type = 'purchase' and definition is not null").select("event_id", "definition"),
        "select event_id, definition from (select event_id, event_type, last_value(case when event_type = 'signup' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as definition from events) where event_type = 'purchase' and definition is not null",
    ),
}
QUERIES["since_last_session"] = (
    lambda s, d: _snapshots(s, d).filter("status <> 'unchanged'").orderBy("status", F.col("id").cast("long")).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("id").cast("long")).alias("first_id")),
    _SNAP + "select status, count(*) as n, min(cast(id as bigint)) as first_id from b where status <> 'unchanged' group by status",
)
