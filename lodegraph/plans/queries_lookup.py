"""Queries: look-ups, decisions, contracts, projects, guidance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..operators import changes as CH
from ..operators import graph as G
from ..operators import guidance as U
from ..operators import lookups as L
from ..operators import memory as M
from ..operators import projects as P
from ..operators import vectors as S
from . import code as C
from . import views as V

_lit = C.text


def _nodes(s, d):
    """Functions with what an index knows of them."""
    n = F.col("n")
    model = F.when(n % 4 == 0, L.FALLBACK).when(n % 4 == 1, "small").when(n % 4 == 2, "")
    return C.functions(s, d).withColumns({"embedding_model": model, "summary": F.when(n % 5 == 0, "sums up").when(n % 5 == 1, None).otherwise(""), "project_id": F.substring_index("module", ".", 1)})


_NODES = f"""
idx as (select *, case n % 4 when 0 then {_lit(L.FALLBACK)} when 1 then 'small' when 2 then '' end as embedding_model, case n % 5 when 0 then 'sums up' when 1 then null else '' end as summary, split_part(module, '.', 1) as project_id from functions)"""


def _with_modules(s, d):
    n = V.nodes(s, d).select("id")
    return n.unionByName(V.nodes(s, d).select(F.col("module").alias("id")).distinct())


def _named(s, d):
    return V.table(s, d, "part").select(F.concat(F.lit("m.f"), F.col("p_partkey").cast("string")).alias("id"), F.concat(F.lit("_"), F.translate("p_name", " ", "_")).alias("name"), F.when(F.col("p_partkey") % 7 == 0, 1).otherwise(0).alias("is_external"))


_NAMED = "with p as (select 'm.f' || p_partkey as id, '_' || replace(p_name, ' ', '_') as name, case when p_partkey % 7 = 0 then 1 else 0 end as is_external from part)"


def _verbs(s, d):
    return V.table(s, d, "part").filter("p_size < 20").select(F.substring_index("p_name", " ", 1).alias("verb"))


def _contracts(s, d):
    rows = [("k1", []), ("k2", ["app.web.*"]), ("k3", ["external.httpx.f0", "lib.cache.m3.*"]), ("k4", ["nowhere"])]
    return s.createDataFrame(rows, "contract_id string, function_ids array<string>")


_APPLICABLE = """
app as (select 'k1' as contract_id, id from functions union all select 'k2', id from functions where starts_with(id, 'app.web.') union all select 'k3', id from functions where id = 'external.httpx.f0' or starts_with(id, 'lib.cache.m3.'))"""


def _rules(s, d):
    rows = [("k1", "active", None, None, ["lib."], "docstring"), ("k2", "active", "external.httpx.*", None, [], None), ("k3", "draft", "f3", None, [], None), ("k4", "active", "f7", None, [], None)]
    return s.createDataFrame(rows, "contract_id string, status string, pattern string, required string, exclusions array<string>, presence string")


def _reach(s, d):
    c = C.calls(s, d).distinct()
    two = c.join(c.select(F.col("caller_id").alias("callee_id"), F.col("callee_id").alias("far")), "callee_id").select("caller_id", F.col("far").alias("callee_id"))
    return c.unionByName(two).distinct().select(F.col("caller_id").alias("id"), F.col("callee_id").alias("callee")).filter("id <> callee")


def _decisions(s, d):
    return C.choices(s, d).withColumn("parent_decision_id", F.when(F.col("decision_id") % 3 == 0, F.expr("decision_id div 3")).cast("long")).filter("parent_decision_id is null or parent_decision_id <> decision_id")


def _links(s, d):
    return C.choices(s, d).join(C.functions(s, d).select("n", F.col("id").alias("function_id")), "n").select("decision_id", "function_id")


def _results(s, d):
    """What queries found: the functions of a language by the first letter of their modules."""
    n = _nodes(s, d)
    return n.select(F.concat_ws("/", F.lit("q"), (F.col("n") % 12).cast("string")).alias("query_id"), "id", F.concat(F.when(F.col("n") % 3 < 2, "get_").otherwise("set_"), "name").alias("name"), "module", F.when(F.col("n") % 12 < 4, F.col("is_async")).otherwise(0).alias("is_async"))


def _counts(s, d):
    return V.table(s, d, "lineitem").join(C.functions(s, d).select("n", "id"), F.col("l_suppkey") * 3 == F.col("n")).groupBy(F.col("id").alias("callee_id")).agg(F.count_distinct("l_linenumber").alias("k"), F.count(F.lit(1)).alias("callers")).select("callee_id", "callers")


_COUNTS = "counts as (select id as callee_id, count(*) as callers from lineitem join functions on n = l_suppkey * 3 group by 1)"
_RESULTS = "results as (select 'q/' || n % 12 as query_id, id, case when n % 3 < 2 then 'get_' else 'set_' end || name as name, module, case when n % 12 < 4 then is_async else 0 end as is_async from functions)"


def _calls_of(s, d, by: str, other: str):
    f = C.functions(s, d).select(F.col("id"), "module", "is_async", "is_external")
    return C.calls(s, d).select(F.col(by).alias("query_id"), F.col(other).alias("id")).distinct().join(f, "id")


def _snapshot(s, d, new: bool):
    p = V.table(s, d, "part").filter("p_partkey % 5 <> 0" if new else "p_partkey % 7 <> 0")
    version = F.when(F.lit(new) & (F.length("p_type") % 2 == 0), "2.0").when(F.length("p_type") == 8, "unknown").otherwise("1.0")
    return p.select(F.concat(F.lit("external."), "p_type", F.lit(".s"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_type").alias("library"), F.concat_ws(" ", "p_name", F.when(F.lit(new) & (F.col("p_size") == 9), F.lit("v2"))).alias("signature"), version.alias("version"))


_SNAP = """
v0 as (select 'external.' || p_type || '.s' || p_partkey as id, p_type as library, p_name as signature, case when length(p_type) = 8 then 'unknown' else '1.0' end as version from part where p_partkey % 7 <> 0),
v1 as (select 'external.' || p_type || '.s' || p_partkey as id, p_type as library, p_name || case when p_size = 9 then ' v2' else '' end as signature, case when length(p_type) % 2 = 0 then '2.0' when length(p_type) = 8 then 'unknown' else '1.0' end as version from part where p_partkey % 5 <> 0),
df as (
  select case when v1.id is null then 'removed' when v0.id is null then 'added' else 'changed' end as kind, coalesce(v0.library, v1.library) as library, coalesce(v0.id, v1.id) as subject, v0.signature as before, v1.signature as after
  from v0 full join v1 on v0.id = v1.id where v0.signature is distinct from v1.signature
  union all
  select 'version', library, library, a.version, b.version from (select library, min(version) as version from v0 group by 1) a join (select library, min(version) as version from v1 group by 1) b using (library) where a.version <> b.version and a.version <> 'unknown' and b.version <> 'unknown'
)"""


def _diff(s, d):
    return U.fingerprint_diff(_snapshot(s, d, False), _snapshot(s, d, True))


def _dependents(s, d):
    return V.table(s, d, "lineitem").join(V.table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_type").alias("library"), F.col("l_suppkey").cast("string").alias("id"))


def _hits(s, d):
    v = V.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    near = S.knn_blocks(v, v.filter("id % 20 = 0"), 12)
    files = C.functions(s, d).select(F.col("n").alias("id"), "file", F.col("id").alias("fid"))
    return near.join(files, "id").select("query_id", F.col("fid").alias("id"), "file", "rank", "similarity")


_KNN = """
vv as (select vec_id as id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
cs as (select a.id as query_id, b.id, list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(a.e, lambda x: x * x))) * sqrt(list_sum(list_transform(b.e, lambda x: x * x)))) as c from vv a, vv b where a.id % 20 = 0 and a.id <> b.id),
knn as (select * from (select query_id, id, round(1 - (1 - c) / 2, 4) as similarity, row_number() over (partition by query_id order by round(c, 9) desc, id) as rank from cs) where rank <= 12)"""


def _health(s, d):
    n = _nodes(s, d)
    own = n.select("id", "project_id")
    e = C.calls(s, d).join(own.withColumnRenamed("id", "caller_id"), "caller_id")
    f = own.join(C.functions(s, d).select("id", "n"), "id")
    ch = V.table(s, d, "lineitem").select(F.col("l_orderkey").alias("commit_hash"), F.col("l_partkey").alias("n")).join(f, "n").filter("project_id <> 'lib'").select("project_id", "commit_hash")
    dec = C.choices(s, d).join(f, "n").filter("project_id = 'app'").select("project_id", "decision_id")
    anchors = n.groupBy("project_id", F.col("module").alias("subsystem")).agg(F.max("summary").alias("summary"))
    return U.health_report(n, e, ch, dec, _links(s, d), C.choices(s, d).filter("decision_id % 2 = 0").select("decision_id"), anchors)


_HEALTH = """
a as (select project_id, count(*) as total, count(*) filter (where is_external = 0) as internal, count(*) filter (where is_external <> 0) as external, count(*) filter (where is_external = 0 and coalesce(summary, '') <> '') as summaries,
  count(*) filter (where is_external = 0 and embedding_model = 'text-embedding-3-large') as fallback from idx group by 1),
e as (select project_id, count(*) as edges, count(distinct caller_id) as callers from calls join idx on id = caller_id group by 1),
c as (select project_id, count(*) as changes, count(distinct l_orderkey) as commits from lineitem join idx on n = l_partkey where project_id <> 'lib' group by 1),
m as (select project_id, count(distinct decision_id) as decisions, count(distinct case when decision_id % 2 = 0 then decision_id end) as decision_vectors, count(distinct id) as linked from choices join idx using (n) where project_id = 'app' group by 1),
s as (select project_id, count(*) as subsystems, count(*) filter (where trim(coalesce(x, '')) <> '') as anchored from (select project_id, module, max(summary) as x from idx group by all) group by 1),
j as (select a.*, coalesce(edges, 0) as edges, coalesce(callers, 0) as callers, coalesce(changes, 0) as changes, coalesce(commits, 0) as commits, coalesce(decisions, 0) as decisions, coalesce(decision_vectors, 0) as decision_vectors, coalesce(linked, 0) as linked,
  coalesce(subsystems, 0) as subsystems, coalesce(anchored, 0) as anchored, internal - coalesce(callers, 0) as orphans from a left join e using (project_id) left join c using (project_id) left join m using (project_id) left join s using (project_id)),
p as (select *, case when internal > 0 then cast(round_even(summaries / internal * 100, 0) as bigint) else 0 end as summary_percent, case when internal > 0 then cast(round_even(fallback / internal * 100, 0) as bigint) else 0 end as fallback_percent,
  case when internal > 0 then cast(round_even(orphans / internal * 100, 0) as bigint) else 0 end as orphan_percent, case when subsystems > 0 then cast(round_even(anchored / subsystems * 100, 0) as bigint) else 0 end as anchor_percent from j),
q as (select *, list_filter([case when internal > summaries then 'high:enrich_summaries' end, case when decisions = 0 then 'high:backfill_decisions' end, case when changes = 0 and decisions = 0 then 'medium:push_cochange_history' end,
  case when changes > 0 and changes < 2 * internal then 'low:push_cochange_history' end, case when fallback_percent > 20 then 'medium:enrich_fallback' end, case when orphan_percent > 30 then 'medium:re-index' end], lambda x: x is not null) as acts from p)
select * exclude (acts), array_to_string(acts, ',') as actions, case when total = 0 then 'empty' when len(list_filter(acts, lambda x: starts_with(x, 'high:'))) >= 2 then 'degraded'
  when len(list_filter(acts, lambda x: starts_with(x, 'high:'))) = 1 or summary_percent < 50 then 'partial' else 'healthy' end as verdict from q"""


def _hints(s, d):
    """Hints for the methods of classes: calls as impact, the commits of the parts as changes."""
    m = C.methods(s, d).select("k", F.concat("class_id", F.lit("."), F.element_at(F.array(*map(F.lit, ("__eq__", "__hash__", "__lt__", "__enter__", "run"))), (F.col("k") % 5 + 1).cast("int"))).alias("id"))
    ids = m.groupBy("id").agg(F.min("k").alias("k"))
    impact = C.method_calls(s, d).join(C.methods(s, d).select(F.col("id").alias("caller_id"), "k"), "caller_id").join(ids.withColumnRenamed("id", "target"), "k").select("target", F.col("callee_id").alias("id"))
    changed = CH.co_occurrence(V.commit_changes(s, d), "commit_hash", least=2)
    changed = changed.join(ids.select(F.col("k").alias("a"), F.col("id").alias("x")), "a").join(ids.select(F.col("k").alias("b"), F.col("id").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"), "n")
    similar = ids.join(ids.select((F.col("k") - 7).alias("k"), F.col("id").alias("y")), "k").select(F.col("id").alias("target"), F.col("y").alias("id"), F.lit(1).alias("rank"))
    return U.change_hints(ids.select(F.col("id").alias("target")), ids.withColumn("name", names.last_segment("id")), impact, similar, changed, least=2)


_HINTS = f"""
ids as (select class_id || '.' || (['__eq__', '__hash__', '__lt__', '__enter__', 'run'])[k % 5 + 1] as id, min(k) as k from methods group by 1),
pairs(method, other) as (values {', '.join(f"({_lit(a)}, {_lit(b)})" for a, b in U.PAIRS)}),
impact as (select i.id as target, pc.callee_id as id from pc join methods m on m.id = pc.caller_id join ids i on i.k = m.k),
wanted as (select i.id as target, split_part(i.id, '.', 1) || '.' || split_part(i.id, '.', 2) || '.' || split_part(i.id, '.', 3) || '.' || other as id from ids i join pairs on method = split_part(i.id, '.', 4)),
cc as (select distinct l_orderkey as o, l_partkey as k from lineitem),
ch as (select x.id as target, y.id as id, n from (select a.k as a, b.k as b, count(*) as n from cc a join cc b on a.o = b.o and a.k <> b.k group by all having count(*) >= 2) p join ids x on x.k = p.a join ids y on y.k = p.b),
top as (select * from (select *, row_number() over (partition by target order by n desc, id) as r from ch) where r <= 5)
select target, 'protocol' as type, id, case when id in (select id from ids) then 'review' else 'add' end as action from wanted w where not (id in (select id from ids) and exists (select 1 from impact i where i.target = w.target and i.id = w.id))
union all select a.id, 'semantic', b.id, 'review' from ids a join ids b on b.k = a.k + 7 where a.id <> b.id and not exists (select 1 from impact i where i.target = a.id and i.id = b.id)
union all select target, 'co_change', id, 'review' from top t where not exists (select 1 from impact i where i.target = t.target and i.id = t.id)"""


QUERIES = {
    "node_lookup": (
        lambda s, d: L.by_key(C.functions(s, d), C.functions(s, d).filter("n % 50 = 0").select("file"), "file").select("id", "file", F.sha2("body", 256).alias("body_hash")),
        C.with_code("select id, file, sha256(body) as body_hash from functions where file in (select file from functions where n % 50 = 0)"),
    ),
    "class_siblings": (
        lambda s, d: L.sibling_counts(_with_modules(s, d)),
        V.with_views(""", k as (select id from nodes union select module from nodes), p as (select id, regexp_replace(id, '\\.[^.]*$', '') as parent from k where contains(id, '.'))
select p.id, count(*) as n_siblings from p join k on starts_with(k.id, p.parent || '.') and k.id <> p.id group by p.id"""),
    ),
    "class_members": (
        lambda s, d: L.class_members(C.functions(s, d), C.functions(s, d).select(F.col("module").alias("id"))),
        C.with_code("select distinct m.module as ancestor, f.id from functions f join (select distinct module from functions) m on starts_with(f.id, m.module || '.') where f.is_external = 0 and body <> ''"),
    ),
    "same_name": (
        lambda s, d: L.same_name(_named(s, d)),
        _NAMED + " select id, other, cast(rank as int) as rank from (select a.id, b.id as other, row_number() over (partition by a.id order by b.id) as rank from p a join p b on a.name = b.name and a.id <> b.id where b.is_external = 0) where rank <= 10",
    ),
    "dispatch_handlers": (
        lambda s, d: L.dispatch_handlers(_named(s, d), _verbs(s, d)),
        _NAMED + ", v as (select distinct split_part(p_name, ' ', 1) as verb from part where p_size < 20) select verb, id from p join v on starts_with(name, '_' || verb || '_') where is_external = 0",
    ),
    "embedded_from_nothing": (lambda s, d: L.embedded_from_nothing(_nodes(s, d)).select("id"), C.with_code("," + _NODES + " select id from idx where is_external = 0 and embedding_model <> '' and summary = '' and docstring = ''")),
    "needs_enrichment": (
        lambda s, d: L.needs_enrichment(_nodes(s, d), 100).select("id"),
        C.with_code("," + _NODES + f" select id from idx where is_external = 0 and (embedding_model is null or embedding_model = {_lit(L.FALLBACK)}) and coalesce(summary, '') = '' order by id limit 100"),
    ),
    "edge_ends": (lambda s, d: L.callers_and_callees(C.calls(s, d)), C.with_code("select distinct caller_id as id, 'caller' as role from calls union all select distinct callee_id, 'callee' from calls")),
    "orphans": (
        lambda s, d: G.orphans(C.functions(s, d), C.calls(s, d).join(C.functions(s, d).filter("n % 5 = 0").select(F.col("id").alias("caller_id")), "caller_id", "left_semi")).select("id"),
        C.with_code(", few as (select c.* from calls c join functions f on f.id = c.caller_id where n % 5 = 0) select id from functions where is_external = 0 and id not in (select caller_id from few) and id not in (select callee_id from few)"),
    ),
    "contracts_applicable": (lambda s, d: L.applicable(_contracts(s, d), C.functions(s, d)), C.with_code("," + _APPLICABLE + " select distinct contract_id, id from app")),
    "inheritance": (
        lambda s, d: L.inheritance(C.inherits(s, d).select(F.col("sub").alias("caller_id"), F.when(F.length("sub") % 2 == 0, names.last_segment("base")).otherwise(F.col("base")).alias("callee_id"), F.lit("inherits").alias("edge_type")), C.methods(s, d).select(F.col("class_id").alias("id"), names.last_segment("class_id").alias("name")).distinct()),
        f"with {C.METHODS_SQL} select sub as id, base as relative, 'base' as relation from inh union all select base, sub, 'subclass' from inh",
    ),
    "sibling_callers": (
        lambda s, d: L.sibling_callers(C.methods(s, d), C.method_calls(s, d)),
        f"with {C.METHODS_SQL} select distinct m.id, pc.caller_id as caller from methods m join pc on pc.caller_class = m.class_id and pc.callee_id in (m.id, m.method) and pc.caller_id <> m.id",
    ),
    "self_delegating": (
        lambda s, d: L.self_delegating(C.methods(s, d), C.method_calls(s, d)),
        f"with {C.METHODS_SQL} select distinct caller_id as id, callee_id from pc where ends_with(callee_id, '.' || caller)",
    ),
    "library_callers": (
        lambda s, d: L.library_dependents(C.functions(s, d), C.calls(s, d), C.functions(s, d).filter("is_external = 1").select(F.col("module").alias("library"))),
        C.with_code("select split_part(callee_id, '.', 2) as library, f.id, f.name, count(*) as call_count from calls join functions f on f.id = caller_id where starts_with(callee_id, 'external.') group by all"),
    ),
    "decision_history": (
        lambda s, d: M.decision_history(C.choices(s, d), _links(s, d)),
        C.with_code("select id as function_id, decision_id, description, created_at, cast(row_number() over (partition by id order by created_at, decision_id) as int) as position from choices join functions using (n)"),
    ),
    "decision_lineage": (
        lambda s, d: M.lineage(_decisions(s, d), 4),
        C.with_code(""", p as (select decision_id, decision_id // 3 as parent from choices where decision_id % 3 = 0 and decision_id // 3 <> decision_id),
r(decision_id, ancestor, depth) as (select decision_id, parent, 1 from p union all select r.decision_id, p.parent, depth + 1 from r join p on p.decision_id = r.ancestor where depth < 4)
select decision_id, ancestor, cast(min(depth) as int) as depth from r group by all""", True),
    ),
    "reasoning_text": (
        lambda s, d: M.reasoning_text(C.choices(s, d).withColumns({"rejected_alternatives": F.when(F.col("decision_id") % 2 == 0, "none"), "trigger": F.lit("")})),
        C.with_code("select decision_id, 'Type: ' || type || chr(10) || 'Decision: ' || description || case when decision_id % 2 = 0 then chr(10) || 'Rejected: none' else '' end as text from choices"),
    ),
    "insert_decisions": (
        lambda s, d: M.insert_decisions(C.choices(s, d).filter("decision_id % 3 > 0").withColumn("rejected_alternatives", F.lit(None).cast("string")), C.choices(s, d).filter("decision_id % 3 < 2").select("decision_id", F.lit("new").alias("type"), F.upper("description").alias("description"), F.current_timestamp().alias("created_at"), "n", F.lit("x").alias("rejected_alternatives")).withColumn("created_at", F.lit("2020-01-01").cast("timestamp_ntz"))).select("decision_id", "type", "description", "created_at", "rejected_alternatives"),
        C.with_code("select decision_id, case when decision_id % 3 < 2 then 'new' else type end as type, case when decision_id % 3 < 2 then upper(description) else description end as description, case when decision_id % 3 = 0 then timestamp '2020-01-01' else created_at end as created_at, case when decision_id % 3 < 2 then 'x' end as rejected_alternatives from choices"),
    ),
    "check_contracts": (
        lambda s, d: M.check_contracts(_rules(s, d), C.functions(s, d), _reach(s, d), L.applicable(_contracts(s, d).filter("contract_id <> 'k4'").unionByName(s.createDataFrame([("k4", [])], "contract_id string, function_ids array<string>")), C.functions(s, d))),
        C.with_code(f",{_APPLICABLE}, scope as (select distinct * from app union all select 'k4', id from functions), c as (select distinct * from calls), re as (select * from c union select a.caller_id, b.callee_id from c a join c b on b.caller_id = a.callee_id)" + """
select distinct 'k2' as contract_id, caller_id as function_id, 'structural' as violation_type from re where starts_with(callee_id, 'external.httpx.') and caller_id <> callee_id and caller_id in (select id from scope where contract_id = 'k2')
union all select distinct 'k4', caller_id, 'structural' from re where caller_id <> callee_id and (regexp_extract(callee_id, '[^.]*$') = 'f7' or starts_with(regexp_extract(callee_id, '[^.]*$'), 'f7_'))
union all select 'k1', id, 'presence' from functions where is_external = 0 and coalesce(docstring, '') = '' and not starts_with(id, 'lib.')"""),
    ),
    "contract_violations_recent": (
        lambda s, d: M.recent_violations(V.table(s, d, "events").select(F.col("event_type").alias("contract_id"), F.col("ts").alias("detected_at")), V.table(s, d, "events").select(F.col("event_type").alias("contract_id"), F.upper("event_type").alias("title")).distinct(), F.lit("2024-01-30").cast("timestamp_ntz")),
        "select event_type as contract_id, upper(event_type) as title, count(*) as n, count(*) filter (where ts > timestamp '2024-01-30' - interval 7 day) as n_recent from events group by 1",
    ),
    "semantic_snippets": (
        lambda s, d: M.snippet(C.functions(s, d)).select("id", F.sha2("text", 256).alias("text_hash")),
        C.with_code("select id, sha256(signature || chr(10) || case when docstring <> '' then docstring || chr(10) else '' end || substr(body, 1, 600)) as text_hash from functions where is_external = 0"),
    ),
    "schema_objects": (
        lambda s, d: M.schema_objects(C.methods(s, d).select("id", F.col("method").alias("name"), F.lit("method").alias("type")).unionByName(C.methods(s, d).select(F.col("class_id").alias("id"), names.last_segment("class_id").alias("name"), F.lit("class").alias("type")).distinct()), s.createDataFrame([("C1", "HIGH"), ("C2", "LOW")], "name string, cardinality string")),
        f"with {C.METHODS_SQL} select 'C' || c as name, class_id as id, case c when 1 then 'HIGH' when 2 then 'LOW' else 'MEDIUM' end as cardinality, string_agg(method, ',' order by method) as methods from methods group by c, class_id",
    ),
    "fork_delta": (
        lambda s, d: P.fork_delta(*_fork_sides(s, d))[1],
        C.with_code(""", o as (select id, file, sha256(body) as h from functions), n as (select id, file, case when n % 5 = 0 then 'changed' else sha256(body) end as h from functions where n % 7 <> 0 and n % 40 < 20)
select coalesce(o.id, n.id) as id, case when n.id is null then 'deleted' when o.h = n.h then 'unchanged' else 'updated' end as status from (select * from o where file in (select file from functions where n % 40 < 20)) o full join n on o.id = n.id"""),
    ),
    "folder_names": (
        lambda s, d: V.table(s, d, "part").select("p_partkey", P.folder_name(F.concat("p_partkey", F.lit("-"), "p_name")).alias("folder")),
        "select p_partkey, substr('p' || regexp_replace(lower(p_partkey || '-' || p_name), '[^a-z0-9]', '_', 'g'), 1, 63) as folder from part",
    ),
    "user_projects": (
        lambda s, d: P.user_projects(V.table(s, d, "nation").select(F.col("n_name").alias("id")), V.table(s, d, "customer").select(F.col("c_custkey").alias("user_id"), F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("project_id"), F.lit("owner").alias("role")), V.table(s, d, "nation").filter("n_nationkey < 3").select(F.col("n_name").alias("project_id"))),
        "select c_custkey as user_id, n_name as id, 'owner' as role from customer join nation on n_name = 'NATION_' || c_nationkey union all select c_custkey, n_name, 'demo' from customer, nation where n_nationkey < 3",
    ),
    "result_signals": (
        lambda s, d: U.signals(_results(s, d), _counts(s, d), _links(s, d).filter("decision_id % 5 = 0")),
        C.with_code(f""", {_RESULTS}, {_COUNTS}, t as (select query_id, count(*) as total, count(*) filter (where is_async = 1) as a from results group by 1),
mo as (select query_id, module as v, count(*) as n from results group by all), ve as (select query_id, nullif(regexp_extract(name, '^([a-z]+)_', 1), '') as v, count(*) as n from results group by all),
ca as (select query_id, id, callers from results join counts on callee_id = id where callers >= 15)
select query_id, 'concentration' as signal, v as subject, n from (select *, row_number() over (partition by query_id order by n desc, v) as k from mo) join t using (query_id) where k = 1 and n / total >= 0.75
union all select query_id, 'naming', v, n from (select *, row_number() over (partition by query_id order by n desc, v) as k from ve where v is not null) join t using (query_id) where k = 1 and n / total >= 0.6
union all select query_id, case when a / total >= 0.8 then 'async_first' when a / total <= 0.2 then 'async_rare' else 'async_mixed' end, '', a from t where a > 0
union all select query_id, 'chokepoint', id, callers from ca
union all select query_id, 'decision_gap', id, callers from ca where id not in (select id from choices join functions using (n) where decision_id % 5 = 0)"""),
    ),
    "caller_guidance": (
        lambda s, d: U.caller_guidance(_calls_of(s, d, "callee_id", "caller_id")),
        C.with_code(""", r as (select distinct callee_id as query_id, f.id, f.module, f.is_async from calls join functions f on f.id = caller_id), t as (select query_id, count(*) as total, count(distinct module) as n_modules, count(*) filter (where is_async = 1) as a from r group by 1),
m as (select query_id, module, count(*) as n, row_number() over (partition by query_id order by count(*) desc, module) as k from r group by query_id, module)
select query_id, total as n_callers, n_modules, module as dominant, n / total >= 0.75 as concentrated, n / total < 0.75 and n_modules >= 5 as wide, total >= 15 as chokepoint, case when a = total then 'async' when a > 0 and a / total < 0.3 then 'mostly_sync' else '' end as tempo from t join m using (query_id) where k = 1"""),
    ),
    "callee_guidance": (
        lambda s, d: U.callee_guidance(_calls_of(s, d, "caller_id", "callee_id")),
        C.with_code(""", r as (select distinct caller_id as query_id, f.id, f.module, f.is_external from calls join functions f on f.id = callee_id), x as (select query_id, count(*) filter (where is_external = 1) as n_external, list_sort(list_distinct(list(module) filter (where is_external = 1))) as l from r group by 1),
m as (select query_id, module, count(*) as n, sum(count(*)) over (partition by query_id) as total, row_number() over (partition by query_id order by count(*) desc, module) as k from r where is_external = 0 group by query_id, module)
select query_id, n_external, coalesce(array_to_string(l[1:4], ','), '') as libraries, n_external >= 3 as high_surface, module as dominant from x left join (select * from m where k = 1 and n / total >= 0.75 and total > 2) using (query_id)"""),
    ),
    "change_hints": (_hints, f"with {C.METHODS_SQL}, {_HINTS}"),
    "health_report": (_health, C.with_code("," + _NODES + "," + _HEALTH)),
    "benchmark_readiness": (
        lambda s, d: U.readiness(_nodes(s, d).filter("is_external = 0").groupBy(F.concat_ws("/", "project_id", (F.col("n") % 3).cast("string")).alias("project_id")).agg(F.count(F.lit(1)).alias("internal"), F.count_if(F.col("n") % 9 != 1).alias("vectors"), F.count_if(F.col("n") % 3 == 0).alias("summaries"))),
        C.with_code("," + _NODES + " select project_id || '/' || n % 3 as project_id, case when 100 * count(*) filter (where n % 9 <> 1) / count(*) >= 80 and 100 * count(*) filter (where n % 3 = 0) / count(*) >= 50 then 'ready' when 100 * count(*) filter (where n % 9 <> 1) / count(*) >= 40 then 'partial' else 'not_ready' end as verdict from idx where is_external = 0 group by 1, n % 3"),
    ),
    "fingerprint_symbols": (_diff, "with " + _SNAP + " select kind, library, subject, before, after from df"),
    "dependency_health": (
        lambda s, d: U.dependency_health(_snapshot(s, d, True), _diff(s, d), _dependents(s, d)),
        "with " + _SNAP + """, l as (select distinct p_type as library from part)
select library, coalesce((select min(version) from v1 where v1.library = l.library), 'unknown') as version, (select count(distinct id) from v1 where v1.library = l.library) as n_symbols, (select count(distinct l_suppkey) from lineitem join part on p_partkey = l_partkey where p_type = l.library) as n_dependents,
  (select count(*) from df where kind = 'removed' and df.library = l.library) as n_removed, (select count(*) from df where kind = 'added' and df.library = l.library) as n_added, (select count(*) from df where kind = 'changed' and df.library = l.library) as n_changed, (select count(*) from df where kind = 'version' and df.library = l.library) as n_versions from l""",
    ),
    "duplication_clusters": (
        lambda s, d: U.duplication_clusters(_hits(s, d), least=0.6),
        C.with_code("," + _KNN + " select query_id, count(*) as n_members, count(distinct file) as n_files, string_agg(f.id, ',' order by f.id) as members from knn join functions f on f.n = knn.id where similarity >= 0.6 group by 1 having count(distinct file) >= 3"),
    ),
    "top_with_overflow": (
        lambda s, d: L.with_overflow(G.caller_counts(C.calls(s, d)), [F.desc("callers"), "callee_id"]),
        C.with_code("select callee_id, callers, call_sites, greatest(total - 30, 0) as overflow from (select callee_id, count(distinct caller_id) as callers, count(*) as call_sites, count(*) over () as total from calls group by 1) order by callers desc, callee_id limit 30"),
    ),
}


def _fork_sides(s, d):
    hashed = C.functions(s, d).select("n", "id", "file", F.sha2("body", 256).alias("body_hash"))
    parsed = hashed.filter("n % 7 <> 0 and n % 40 < 20").withColumn("body_hash", F.when(F.col("n") % 5 == 0, "changed").otherwise(F.col("body_hash")))
    return hashed.drop("n"), parsed.drop("n"), hashed.filter("n % 40 < 20").select("file")
