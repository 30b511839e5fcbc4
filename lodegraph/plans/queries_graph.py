"""Queries on the graph and its subsystems."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..operators import architecture as A
from ..operators import graph as G
from . import views as V

_IMPACT = """, seeds as (select id as target from part_nodes),
reach(target, id, depth) as (
  select target, target, 0 from seeds
  union
  select r.target, e.{to}, r.depth + 1 from reach r join part_edges e on e.{by} = r.id where r.depth < {depth}
)
select target, id, cast(min(depth) as int) as depth from reach where id in (select id from part_nodes) group by target, id"""


def _seeds(s, d):
    return V.part_nodes(s, d).select(F.col("id").alias("target"))


def _resolution(s, d):
    n = V.nodes(s, d)
    wanted = n.select(F.concat_ws(".", names.last_segment("module"), "name").alias("query")).unionByName(n.select(F.col("id").alias("query"))).unionByName(n.select(F.col("name").alias("query")))
    return G.resolve_names(n, wanted.distinct())


def _callees(s, d):
    e = V.edges(s, d).withColumn("callee_id", F.when(F.pmod(F.length("caller_id"), F.lit(2)) == 0, names.last_segment("callee_id")).otherwise(F.lit("NATION_0.nowhere")))
    return G.resolve_callees(e, V.nodes(s, d)).groupBy("callee_id").agg(F.count(F.lit(1)).alias("n"))


def _mapping(s, d):
    return A.subsystem_map(V.nodes(s, d), 30)


_MAP = """, sizes as (select module, count(*) as n from nodes where is_external = 0 group by module),
mapping as (select id, case when n > 30 then id else module end as subsystem from nodes join sizes using (module) where is_external = 0)"""
_COUNTS = ", counts as (select callee_id, count(distinct caller_id) as callers, count(*) as call_sites from edges group by callee_id)"


def _library():
    return names.prefix("callee_id", 2)


QUERIES = {
    "nodes_view": (lambda s, d: V.nodes(s, d).groupBy("project_id", "type", "is_external").agg(F.count(F.lit(1)).alias("n")), V.with_views("select project_id, type, is_external, count(*) as n from nodes group by all")),
    "edges_view": (lambda s, d: V.edges(s, d).groupBy("caller_id", "callee_id", "edge_type").agg(F.count(F.lit(1)).alias("n")), V.with_views("select caller_id, callee_id, edge_type, count(*) as n from edges group by all")),
    "callers": (lambda s, d: G.callers(V.nodes(s, d), V.edges(s, d)), V.with_views("select distinct callee_id, caller_id, name as caller_name, module, is_external from edges join nodes on id = caller_id")),
    "callees": (lambda s, d: G.callees(V.nodes(s, d), V.edges(s, d)), V.with_views("select distinct caller_id, callee_id, name as callee_name from edges join nodes on id = callee_id where is_external = 0")),
    "caller_counts": (lambda s, d: G.caller_counts(V.edges(s, d)), V.with_views("select callee_id, count(distinct caller_id) as callers, count(*) as call_sites from edges group by callee_id")),
    "chokepoints": (
        lambda s, d: G.chokepoints(V.nodes(s, d), V.edges(s, d)),
        V.with_views("select id, name, module, count(distinct caller_id) as callers from edges join nodes on id = callee_id where is_external = 0 group by all order by callers desc, id limit 5"),
    ),
    "name_resolution": (
        _resolution,
        V.with_views(
            """, wanted as (select split_part(module, '.', 2) || '.' || name as query from nodes union select id from nodes union select name from nodes)
select query, id, cast(min(case when id = query or name = query then 0 else 1 end) as int) as match from wanted join (
  select id, name, id as key from nodes union select id, name, name from nodes union
  select id, name, array_to_string(list_slice(string_split(id, '.'), i, 99), '.') from nodes, (values (2), (3)) t(i)) k on k.key = query group by query, id"""
        ),
    ),
    "callee_resolution": (
        _callees,
        V.with_views(
            """, bare as (select case when length(caller_id) % 2 = 0 then split_part(callee_id, '.', 3) else 'NATION_0.nowhere' end as callee from edges),
sfx as (select array_to_string(list_slice(string_split(id, '.'), i, 99), '.') as suffix, min(id) as only from nodes, (values (2), (3)) t(i) group by 1 having count(distinct id) = 1)
select coalesce(n.id, s.only, callee) as callee_id, count(*) as n from bare left join nodes n on n.id = callee left join sfx s on s.suffix = callee group by 1"""
        ),
    ),
    "missing_docstring": (
        lambda s, d: G.missing_docstring(V.nodes(s, d), ["customer#000000001"]).select("id"),
        V.with_views("select id from nodes where type <> 'class' and is_external = 0 and docstring = '' and lower(name) <> 'customer#000000001'"),
    ),
    "impact_radius": (lambda s, d: G.impact_radius(V.part_edges(s, d), _seeds(s, d), 2, V.part_nodes(s, d)), V.with_views(_IMPACT.format(to="caller_id", by="callee_id", depth=2), True)),
    "find_dependents": (lambda s, d: G.reach(*V.numbered_parts(s, d), 3), V.with_views(_IMPACT.format(to="caller_id", by="callee_id", depth=3), True)),
    "forward_reach": (lambda s, d: G.impact_radius(V.part_edges(s, d), _seeds(s, d), 2, V.part_nodes(s, d), forward=True), V.with_views(_IMPACT.format(to="callee_id", by="caller_id", depth=2), True)),
    "subsystems": (lambda s, d: _mapping(s, d).groupBy("subsystem").agg(F.count(F.lit(1)).alias("n")), V.with_views(_MAP + " select subsystem, count(*) as n from mapping group by subsystem")),
    "subsystem_anchors": (
        lambda s, d: A.subsystem_anchors(V.nodes(s, d), G.caller_counts(V.edges(s, d)), A.subsystem_map(V.nodes(s, d), 10**6)),
        V.with_views(
            _COUNTS
            + """ select subsystem, n_members, anchor from (select module as subsystem, count(*) over (partition by module) as n_members, id as anchor,
  row_number() over (partition by module order by case when type = 'class' then 0 else 1 end, coalesce(callers, 0) desc, id) as k from nodes left join counts on callee_id = id where is_external = 0) where k = 1"""
        ),
    ),
    "connections": (
        lambda s, d: A.connections(V.edges(s, d), A.subsystem_map(V.nodes(s, d), 10**6)),
        V.with_views("""select a.module as from_subsystem, b.module as to_subsystem, cast(count(*) as bigint) as n from edges join nodes a on a.id = caller_id join nodes b on b.id = callee_id
where a.is_external = 0 and b.is_external = 0 and a.module <> b.module group by all having count(*) >= 2 order by n desc, 1, 2 limit 30"""),
    ),
    "top_members": (
        lambda s, d: A.top_members(A.subsystem_map(V.nodes(s, d), 10**6), G.caller_counts(V.edges(s, d))),
        V.with_views(_COUNTS + " select subsystem, rank, id, callers from (select module as subsystem, id, callers, row_number() over (partition by module order by callers desc, id) as rank from nodes join counts on callee_id = id where is_external = 0) where rank <= 3"),
    ),
    "hotspots": (
        lambda s, d: A.hotspots(V.part_edges(s, d)),
        V.with_views("""select id, fan_in, fan_out, fan_in * fan_out as score from (select coalesce(a.id, b.id) as id, coalesce(fan_in, 0) as fan_in, coalesce(fan_out, 0) as fan_out
from (select callee_id as id, count(*) as fan_in from part_edges group by 1) a full join (select caller_id as id, count(*) as fan_out from part_edges group by 1) b on a.id = b.id)
where fan_in * fan_out >= 4 order by score desc, id limit 8"""),
    ),
    "external_scatter": (
        lambda s, d: A.scatter(V.edges(s, d), _library()),
        V.with_views("select split_part(callee_id, '.', 1) || '.' || split_part(callee_id, '.', 2) as library, count(distinct file) as caller_files, count(*) as call_sites, count(distinct file) >= 3 as scattered from edges group by 1"),
    ),
    "external_dependencies": (
        lambda s, d: A.external_dependencies(V.nodes(s, d), V.edges(s, d), F.col("module")),
        V.with_views("select module as library, count(distinct id) as n_symbols, count(distinct caller_id) as n_callers from nodes left join edges on callee_id = id where is_external = 1 group by module"),
    ),
    "library_dependents": (
        lambda s, d: V.edges(s, d).filter(F.startswith("callee_id", F.lit("ASIA."))).join(V.nodes(s, d).select(F.col("id").alias("caller_id"), "name"), "caller_id").groupBy("caller_id", "name").agg(F.count(F.lit(1)).alias("call_count")),
        V.with_views("select caller_id, name, count(*) as call_count from edges join nodes on id = caller_id where starts_with(callee_id, 'ASIA.') group by all"),
    ),
    "external_callee_counts": (
        lambda s, d: V.edges(s, d).filter(names.prefix("caller_id", 2) != names.prefix("callee_id", 2)).groupBy("callee_id").agg(F.count(F.lit(1)).alias("n")),
        V.with_views("select callee_id, count(*) as n from edges where split_part(caller_id, '.', 1) || split_part(caller_id, '.', 2) <> split_part(callee_id, '.', 1) || split_part(callee_id, '.', 2) group by 1"),
    ),
    "project_inventory": (
        lambda s, d: V.nodes(s, d).groupBy("project_id").agg(F.count(F.lit(1)).alias("n_nodes")).join(
            V.edges(s, d).groupBy(names.prefix("caller_id", 1).alias("project_id")).agg(F.count(F.lit(1)).alias("n_edges")), "project_id", "left"
        ).select("project_id", "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), F.col("n_edges").isNotNull().alias("has_edges")),
        V.with_views("""select project_id, n_nodes, coalesce(n_edges, 0) as n_edges, n_edges is not null as has_edges from (select project_id, count(*) as n_nodes from nodes group by 1) a
left join (select split_part(caller_id, '.', 1) as project_id, count(*) as n_edges from edges group by 1) b using (project_id)"""),
    ),
    "adjacency": (
        lambda s, d: V.part_edges(s, d).groupBy("caller_id").agg(F.array_join(F.sort_array(F.collect_set("callee_id")), ",").alias("callees")),
        V.with_views("select caller_id, string_agg(callee_id, ',' order by callee_id) as callees from part_edges group by 1"),
    ),
}
