"""Design patterns over the parts as methods of classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import patterns as P
from . import code as C


def _in(column: str, words) -> str:
    return f"{column} in ({', '.join(map(C.text, words))})"


def _gap(done: str = "true", method: str = "m.method") -> str:
    """The subclasses of m's class without the method (that is done)."""
    return f"(select coalesce(string_agg(distinct split_part(i.sub, '.', 3), ',' order by split_part(i.sub, '.', 3)), '') from inh i where i.base = m.class_id and not exists (select 1 from methods t where t.class_id = i.sub and t.method = {method} and {done}))"


_BASE = "exists (select 1 from inh i join methods b on b.class_id = i.base where i.sub = m.class_id and b.method = m.method and b.abs)"
_VERB = f"regexp_extract(method, {C.text(P.DISPATCH)}, 1)"
_ELEMENT = f"regexp_extract(method, {C.text(P.DISPATCH)}, 2)"
_VISIT = f"regexp_extract(m.method, {C.text(P.VISIT)}, 1)"
_THROUGH = "exists (select 1 from pc where pc.caller_id = m.id and ends_with(callee_id, '.' || m.method) and list_has_any(string_split(replace(callee_id, 'self.', ''), '.'), [{words}]))"
_SOFT = "m.pas and not m.abs and exists (select 1 from pc where caller_class = m.class_id and caller_id <> m.id and callee_id in (m.id, m.method))"
_MAKER = f"regexp_matches(m.method, {C.text(P.FACTORY)})"
_MANY = f"(select count(*) from methods x where x.class_id = {{c}} and x.abs and regexp_matches(x.method, {C.text(P.FACTORY)})) >= 2"
_PART = f"case when {_in('method', P.NOTIFY)} then 'notify' when {_in('method', P.ATTACH)} then 'attach' when {_in('method', P.DETACH)} then 'detach' end"
_words = lambda words: ", ".join(map(C.text, words))

_SQL = {
    "visitor": f"""
  select m.id, m.class_id, 'concrete_visitor' as role, 0.92 as confidence, (select coalesce(string_agg(distinct '_' || h.verb || '_' || h.element, ',' order by '_' || h.verb || '_' || h.element), '') from handlers h where h.verb = m.verb
      and not exists (select 1 from handlers o where o.verb = h.verb and o.element = h.element and o.class_id = m.class_id)) as missing
  from (select *, {_VERB} as verb from methods) m where {_in('verb', P.VISITOR_VERBS)} and (select count(distinct class_id) from handlers h where h.verb = m.verb) >= 2 and exists (select 1 from handlers h where h.verb = m.verb and h.class_id = m.class_id)
  union all
  select id, class_id, case when abs then 'abstract_visitor' else 'concrete_visitor' end, 0.90,
    (select coalesce(string_agg(distinct w.method, ',' order by w.method), '') from methods w where w.class_id = m.base and w.abs and starts_with(w.method, 'visit_') and not exists (select 1 from methods o where o.class_id = m.class_id and o.method = w.method and not o.abs))
  from (select m.*, (select min(i.base) from inh i join methods b on b.class_id = i.base where i.sub = m.class_id and b.abs and starts_with(b.method, 'visit_')) as base from methods m where {_VISIT} <> '') m where base is not null
  union all
  select id, class_id, case when abs then 'abstract_element' else 'concrete_element' end, 0.75, case when abs then {_gap()} else '' end from methods m where method = 'accept'""",
    "template_method": f"""
  select id, class_id, 'abstract_hook' as role, 0.85 as confidence, {_gap('not t.abs')} as missing from methods m where abs
  union all
  select id, class_id, 'abstract_hook', 0.75, {_gap('not t.pas')} from methods m where {_SOFT}
  union all
  select id, class_id, 'template_method', 0.88, (select coalesce(string_agg(distinct split_part(i.sub, '.', 3), ',' order by split_part(i.sub, '.', 3)), '') from inh i, uses u where u.id = m.id and i.base = m.class_id
    and not exists (select 1 from methods t where t.class_id = i.sub and t.method = u.hook))
  from methods m where not abs and not ({_SOFT}) and id in (select id from uses)""",
    "factory_method": f"""
  select id, class_id, 'abstract_creator' as role, 0.90 as confidence, {_gap('not t.abs')} as missing from methods m where abs and {_MAKER}
  union all
  select id, class_id, 'concrete_creator', 0.88, '' from methods m where not abs and {_MAKER} and {_BASE}
  union all
  select id, class_id, 'creator', 0.72, {_gap()} from methods m where not abs and {_MAKER} and not {_BASE} and exists (select 1 from inh i join methods t on t.class_id = i.sub where i.base = m.class_id and t.method = m.method)""",
    "abstract_factory": f"""
  select id, class_id, 'abstract_factory' as role, 0.88 as confidence, (select coalesce(string_agg(distinct split_part(i.sub, '.', 3), ',' order by split_part(i.sub, '.', 3)), '') from inh i, methods x where i.base = m.class_id and x.class_id = m.class_id and x.abs
    and regexp_matches(x.method, {C.text(P.FACTORY)}) and not exists (select 1 from methods t where t.class_id = i.sub and t.method = x.method)) as missing from methods m where abs and {_MAKER} and {_MANY.format(c='m.class_id')}
  union all
  select id, class_id, 'concrete_factory', 0.85, '' from methods m where not abs and {_MAKER} and exists (select 1 from inh i where i.sub = m.class_id and {_MANY.format(c='i.base')})""",
    "observer": f"""
  select id, class_id, 'subject' as role, round(0.75 + 0.08 * len(has), 2) as confidence, array_to_string(list_filter(['attach', 'detach', 'notify'], lambda x: not list_contains(has, x)), ',') as missing
  from methods join (select class_id, list_distinct(list({_PART})) as has from methods where {_PART} is not null group by 1) using (class_id) where {_PART} is not null and len(has) >= 2
  union all
  select id, class_id, 'observer', 0.65, '' from methods where {_in('method', P.UPDATE)}""",
    "singleton": f"""
  select id, class_id, case when {_in('method', P.ACCESS)} then 'accessor' else 'guard' end as role, 0.80 as confidence, case when c % 2 = 0 then '' else 'field' end as missing
  from methods where {_in('method', P.ACCESS + P.GUARDS)} and class_id in (select class_id from methods where {_in('method', P.ACCESS)})""",
    "strategy": f"""
  select id, class_id, 'abstract_strategy' as role, 0.78 as confidence, {_gap()} as missing from methods m where abs and {_in('method', P.STRATEGY)} and (select count(*) from methods x where x.class_id = m.class_id and x.abs) <= 3
  union all
  select id, class_id, 'concrete_strategy', 0.82, '' from methods m where not abs and {_in('method', P.STRATEGY)} and {_BASE}""",
    "chain_of_responsibility": f"""
  select id, class_id, case when abs or pas or c > 0 then 'handler' else 'concrete_handler' end as role, 0.85 as confidence, '' as missing from methods m where {_THROUGH.format(words=_words(P.SUCCESSORS))}""",
    "composite": f"select id, class_id, 'composite' as role, 0.80 as confidence, '' as missing from methods m where {_THROUGH.format(words=_words(P.CHILDREN))}",
    "decorator_or_proxy": """
  select id, class_id, case when bool_or(shared) then 'decorator' else 'proxy' end as role, case when bool_or(shared) then 0.82 else 0.65 end as confidence, '' as missing
  from (select m.id, m.class_id, exists (select 1 from inh a join inh b on a.base = b.base where a.sub = m.class_id and b.sub = o.class_id) as shared
    from methods m join pc on pc.caller_id = m.id join methods o on o.id = pc.callee_id and o.method = m.method and o.class_id <> m.class_id) group by all""",
}
_WITH = f"""with {C.METHODS_SQL},
handlers as (select distinct {_VERB} as verb, {_ELEMENT} as element, class_id from methods where starts_with(method, '_') and {_VERB} <> ''),
uses as (select distinct pc.caller_id as id, h.method as hook from pc join methods h on h.id = pc.callee_id and h.class_id = pc.caller_class and (h.abs or h.pas))
"""


def _found(s, d, *only):
    return P.detect(C.methods(s, d), C.inherits(s, d), C.method_calls(s, d), C.fields(s, d), only or None)


def _query(name: str):
    return lambda s, d: _found(s, d, name).select("id", "class_id", "role", "confidence", "missing")


QUERIES = {f"pattern_{name}": (_query(name), _WITH + f"select id, class_id, role, cast(confidence as double) as confidence, missing from ({sql})") for name, sql in _SQL.items()}
QUERIES["design_patterns"] = (
    lambda s, d: _found(s, d).groupBy("pattern", "role").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("confidence")),
    _WITH + "select pattern, role, count(*) as n, max(confidence) as confidence from (" + " union all ".join(f"select '{name}' as pattern, role, cast(confidence as double) as confidence from ({sql})" for name, sql in _SQL.items()) + ") group by all",
)
