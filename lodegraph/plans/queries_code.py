"""Queries over the documents as functions: detectors, look-ups, guidance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..operators import detectors as D
from . import code as C
from . import views as V

_T = C.text
#: The same patterns without look-behind and possessive loops, which DuckDB has not.
_COMPREHENSION = r"(?s)(^|\W)\[.+?\bfor\b.+?\bin\b"
_LITERAL = r'(?s)"""(?:.*?)"""|' + r"'''(?:.*?)'''|" + r'"(?:[^"\\]|\\.)*"|' + r"'(?:[^'\\]|\\.)*'"
_LOOPS = f"(regexp_matches(body, {_T(D.LOOP)}) or regexp_matches(body, {_T(_COMPREHENSION)}))"

_CORRELATED = f"""
lit as (select id, unnest(regexp_extract_all(body, {_T(_LITERAL)})) as q from functions),
ons as (select id, regexp_extract_all(q, {_T(D.SQL_JOIN)}, 2) as ons from lit where len(regexp_extract_all(q, {_T(D.SQL_WORDS)})) >= 2 and regexp_matches(q, {_T(D.SQL_GROUP)}) and regexp_matches(q, {_T(D.SQL_DISTINCT)})),
cols as (select id, flatten(list_transform(ons, lambda o: list_distinct(flatten(list_transform(list_filter(string_split(o, 'AND'), lambda p: regexp_matches(p, {_T(D.SQL_EQUAL)})),
  lambda p: [lower(regexp_extract(p, {_T(D.SQL_EQUAL)}, 1)), lower(regexp_extract(p, {_T(D.SQL_EQUAL)}, 2))]))))) as c from ons where len(ons) >= 2),
correlated as (select id, case when len(c) > len(list_distinct(c)) then 'high' else 'medium' end as severity from cols)"""
_N1 = f"""
step as (select distinct caller_id, callee_id from calls),
sinks as (select id from functions where regexp_matches(body, {_T(D.DB_SINK)})),
near as (select id from sinks union select caller_id from step where callee_id in (select id from sinks)),
hit as (select id, body from functions where {_LOOPS} and id in (select caller_id from step where callee_id in (select id from near))),
weights as (select lower(name) as object, case cardinality when 'UNBOUNDED' then 4 when 'HIGH' then 3 when 'MEDIUM' then 2 when 'LOW' then 1 else 0 end as weight from objects),
matched as (
  select s.caller_id as id, w.weight from step s join hit h on h.id = s.caller_id join functions f on f.id = s.callee_id join weights w on contains(lower(f.name), w.object) or contains(w.object, lower(f.name))
  union all select h.id, w.weight from hit h join weights w on contains(lower(h.body), w.object)
),
n1 as (select h.id, case when regexp_matches(any_value(body), {_T(D.BATCH)}) then 'low' when max(weight) >= 3 then 'high' when max(weight) <= 1 then 'low' else 'medium' end as severity from hit h left join matched m on m.id = h.id group by h.id)"""
_EXTERNAL = f"""
external_in_loop as (
  select distinct s.caller_id as id, e.name as callee, case when regexp_matches(e.name, {_T(D.HIGH_LATENCY)}) or regexp_matches(e.id, {_T(D.HIGH_LATENCY)}) then 'high' else 'medium' end as severity
  from calls s join functions a on a.id = s.caller_id join functions e on e.id = s.callee_id where a.is_external = 0 and e.is_external <> 0 and {_LOOPS.replace('body', 'a.body')})"""
_AWAITS = f"""
aw as (select id, is_async, is_external, regexp_extract_all(body, {_T(D.AWAIT)}) as f, regexp_extract_all(body, {_T(D.AWAIT)}, 1) as v, string_split_regex(body, {_T(D.AWAIT)}) as b from functions where regexp_matches(body, {_T(D.AWAIT)}) and not regexp_matches(body, {_T(D.CONCURRENT)})),
pr as (select id, is_async, is_external, v, unnest(range(1, len(f))) as i, f, b from aw where len(f) >= 2),
re as (select *, array_to_string(list_transform(range(i + 2, len(f) + 2), lambda k: b[k] || coalesce(f[k], '')), '') as r from pr),
cl as (select *, coalesce(list_min(list_filter(range(1, len(r) + 1), lambda k: 1 + (k - len(replace(r[1:k], '(', ''))) - (k - len(replace(r[1:k], ')', ''))) = 0)), len(r)) as e from re),
awaits as (select id, any_value(is_async) as is_async, any_value(is_external) as is_external, count(*) as n_pairs from cl where v[i] <> 'self' and not regexp_matches(b[i + 1] || f[i + 1] || r[1:e], '\\b' || v[i] || '\\b') group by id)"""
_OCP = f"""
ty as (select id, is_external, list_filter(list_distinct(regexp_extract_all(body, {_T(D.ISINSTANCE)}, 1) || regexp_extract_all(body, {_T(D.TYPE_IS)}, 1) || flatten(list_transform(regexp_extract_all(body, {_T(D.ISINSTANCE_TUPLE)}, 1), lambda t: list_filter(string_split_regex(t, '[\\s,]+'), lambda x: x <> '')))),
  lambda x: not list_contains([{', '.join(map(_T, D.VALIDATION_TYPES))}], x)) as t from functions),
ocp as (select id, is_external, cast(len(t) as bigint) as n_types, case when len(t) >= 5 then 'high' else 'medium' end as severity from ty where len(t) >= 3)"""
_DIP = f"""
dip as (select id, is_external, n_accesses, case when n_accesses >= 2 then 'high' else 'medium' end as severity from (
  select id, is_external, cast(len(list_distinct(regexp_extract_all(body, {_T(D.RAW_ACCESS)}))) as bigint) as n_accesses from functions where not regexp_matches(id, {_T(D.INFRASTRUCTURE)})) where n_accesses >= 1)"""
_ACK = """
ack as (select id, arg_max(description, (created_at, decision_id)) as reason from choices join functions using (n) where choices.type = '1-URGENT' group by id)"""
_HITS = """
v as (select vec_id as n, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
hits as (select kind, n, round(1 - (1 - list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(a.e, lambda x: x * x))) * sqrt(list_sum(list_transform(b.e, lambda x: x * x))))) / 2, 4) as similarity
  from v b, (select case n when 1 then 'expand' when 2 then 'pairwise' else 'reduce' end as kind, n as seed, e from v where n in (1, 2, 3)) a where b.n <> a.seed),
expand as (select id from hits join functions using (n) where similarity >= 0.55 group by id having bool_or(kind <> 'reduce') and not bool_or(kind = 'reduce'))"""
_QUAD = f"""
quad as (select distinct f.id, case when f.id in (select id from expand) then 'high' when {_LOOPS.replace('body', 'f.body')} then 'medium' else 'low' end as severity
  from calls c join functions f on f.id = c.caller_id where c.caller_id <> c.callee_id and c.callee_id in (select id from expand))"""
_RANK = "select id, pattern, severity, reason is not null or ({low}) as suppressed, coalesce(reason, case when {low} then 'auto' end, '') as reason, cast(case when reason is not null or ({low}) then 10 else 0 end + case severity when 'high' then 0 when 'medium' then 1 else 2 end as int) as rank from found left join ack using (id)"


def _acks(s, d):
    links = C.choices(s, d).join(C.functions(s, d).select("n", F.col("id").alias("function_id")), "n").select("decision_id", "function_id")
    return D.acknowledged(C.choices(s, d), links, "1-URGENT")


def _expand(s, d):
    v = V.table(s, d, "embeddings").select(F.col("vec_id").alias("n"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    kind = F.when(F.col("n") == 1, "expand").when(F.col("n") == 2, "pairwise").otherwise("reduce")
    seeds = F.broadcast(v.filter("n in (1, 2, 3)").select(kind.alias("kind"), F.col("n").alias("seed"), F.col("e").alias("q")))  # three rows
    cosine = names.dot("e", "q") / (names.norm("e") * names.norm("q"))
    hits = v.join(seeds, F.col("n") != F.col("seed")).select("kind", "n", names.similarity(cosine).alias("similarity"))
    return D.expansion_class(hits.join(C.functions(s, d).select("n", "id"), "n"), 0.55)


def _both(s, d):
    return C.functions(s, d), C.calls(s, d)


def _srp(s, d):
    from ..operators import rules as R

    f = C.functions(s, d).filter("is_external = 0").select("id", names.prefix("id", 2).alias("subsystem"))
    return R.single_responsibility(C.calls(s, d), f)


_SRP = """
srp as (select a.id, count(distinct b.s) as n_subsystems, case when count(distinct b.s) >= 4 then 'high' else 'medium' end as severity from calls c
  join (select id, split_part(id, '.', 1) || '.' || split_part(id, '.', 2) as s from functions where is_external = 0) a on a.id = c.caller_id
  join (select id, split_part(id, '.', 1) || '.' || split_part(id, '.', 2) as s from functions where is_external = 0) b on b.id = c.callee_id where a.s <> b.s group by a.id having count(distinct b.s) >= 3)"""

_PERFORMANCE = f""",{_CORRELATED}, {_N1}, {_EXTERNAL}, {_AWAITS}, {_HITS}, {_QUAD}, {_ACK},
found as (
  select id, 'correlated_join_aggregate' as pattern, severity from correlated union all select id, 'n_plus_one', severity from n1 union all select id, 'external_call_in_loop', severity from external_in_loop
  union all select id, 'sequential_awaits', 'medium' from awaits where is_async = 1 and is_external = 0 union all select id, 'quadratic_expansion', severity from quad)
""" + _RANK.format(low="pattern in ('n_plus_one', 'quadratic_expansion') and severity = 'low'")


def _performance(s, d):
    f, c = _both(s, d)
    return D.performance(f, c, _acks(s, d), C.objects(s, d), _expand(s, d), None)


QUERIES = {
    "correlated_sql": (lambda s, d: D.correlated_sql(C.functions(s, d)), C.with_code("," + _CORRELATED + " select id, severity from correlated")),
    "n_plus_one": (lambda s, d: D.n_plus_one(*_both(s, d), C.objects(s, d)), C.with_code("," + _N1 + " select id, severity from n1")),
    "external_call_in_loop": (lambda s, d: D.external_in_loop(*_both(s, d)), C.with_code("," + _EXTERNAL + " select id, callee, severity from external_in_loop")),
    "sequential_awaits": (lambda s, d: D.sequential_awaits(C.functions(s, d)), C.with_code("," + _AWAITS + " select id, n_pairs from awaits")),
    "expansion_class": (_expand, C.with_code("," + _HITS + " select id from expand")),
    "quadratic_expansion": (lambda s, d: D.quadratic(*_both(s, d), _expand(s, d)), C.with_code("," + _HITS + "," + _QUAD + " select id, severity from quad")),
    "solid_ocp": (lambda s, d: D.open_closed(C.functions(s, d)), C.with_code("," + _OCP + " select id, n_types, severity from ocp")),
    "solid_dip": (lambda s, d: D.dependency_inversion(C.functions(s, d)), C.with_code("," + _DIP + " select id, n_accesses, severity from dip")),
    "acknowledged": (_acks, C.with_code("," + _ACK + " select id, reason from ack")),
    "check_performance": (_performance, C.with_code(_PERFORMANCE)),
    "check_principles": (
        lambda s, d: D.principles(C.functions(s, d), _srp(s, d), _acks(s, d)),
        C.with_code(f",{_SRP}, {_OCP}, {_DIP}, {_ACK}, found as (select id, 'srp' as pattern, severity from srp union all select id, 'ocp', severity from ocp where is_external = 0 union all select id, 'dip', severity from dip where is_external = 0) " + _RANK.format(low="false")),
    ),
    "findings_by_pattern": (
        lambda s, d: _performance(s, d).join(C.functions(s, d).select("id", "file"), "id").groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set("file")), ",").alias("files")),
        C.with_code(_PERFORMANCE.replace(_RANK.format(low="pattern in ('n_plus_one', 'quadratic_expansion') and severity = 'low'"), "") + " select pattern, count(*) as n, string_agg(distinct file, ',' order by file) as files from found join functions using (id) group by 1"),
    ),
}
