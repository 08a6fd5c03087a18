"""W queries: workflows and verdicts."""

from pyspark.sql import functions as F

from loomgraph.catalog.registry import query
from loomgraph.catalog.shared import flow, graph
from loomgraph.functions.scale import cut_together
from loomgraph.operators import flow as fl


def joined(*names):
    return [F.array_join(F.array_sort(n), ",").alias(n) for n in names]


@query("W1_index_degrees", "subject:s kind:s n_from:i n_to:i max_out:i", """
select subject, kind, count(distinct from_id) as n_from, count(distinct to_id) as n_to, max(c) as max_out from (
  select subject, kind, from_id, to_id, count(*) over (partition by subject, kind, from_id) as c from v_edge) group by all""")
def index(t):
    """Size of the lookups by kind and source: two-step counts instead of gathered lists."""
    e = graph(t).edges
    out = e.groupBy("subject", "kind", "from_id").agg(F.count(F.lit(1)).alias("c")).groupBy("subject", "kind").agg(
        F.count(F.lit(1)).alias("n_from"), F.max("c").alias("max_out"))
    into = e.select("subject", "kind", "to_id").distinct().groupBy("subject", "kind").agg(F.count("to_id").alias("n_to"))
    return out.join(into, ["subject", "kind"])


@query("W2_bootstrap_components", "subject:s comp_id:s", "select * from v_bootstrap")
def bootstrap(t):
    return flow(t).bootstrap


@query("W3_active_components", "subject:s start_route:s comp_id:s", "select * from v_active")
def active(t):
    return flow(t).active_places


@query("W4_triggers_per_component", "subject:s comp_id:s kind:s n_triggers:i n_starts:i", """
select t.subject, t.comp_id, t.kind, count(*) as n_triggers, min(c.n_starts) as n_starts from v_trigger t join v_cstart c on c.subject = t.subject and c.comp_id = t.comp_id group by all""")
def triggers(t):
    f = flow(t)
    return f.trigger_places.join(f.component_starts, ["subject", "comp_id"])


@query("W5_redirect_closure", "subject:s route_id:s final_route:s state:s edges:s params:s guards:s", """
select subject, route_id, current as final_route, state, array_to_string(edge_ids, ' ') as edges, array_to_string(list_sort(list_distinct(params)), ',') as params,
  array_to_string(list_sort(list_distinct(guards)), ',') as guards from v_closure""")
def closure(t):
    return flow(t).closure.select("subject", "route_id", "final_route", "state", F.array_join("edge_ids", " ").alias("edges"), *joined("params", "guards"))


@query("W6_effect_closure", "subject:s effect_group:s n_calls:i calls:s nav_id:s calls_router:i", """
select subject, effect_group, n_calls, array_to_string(call_ids, ' ') as calls, nav_id, calls_router from v_effect""")
def effects(t):
    return flow(t).effects.select(
        "subject", "effect_group", F.size("calls").alias("n_calls"), F.array_join(F.transform("calls", lambda c: c["edge_id"]), " ").alias("calls"),
        F.col("nav.edge_id").alias("nav_id"), "calls_router")


@query("W7_terminals", "subject:s workflow_id:s trigger_kind:s terminal_id:s", "select * from v_workflow")
def terminals(t):
    return flow(t).workflows_with("subject", "workflow_id", "trigger_kind", "terminal_id")


@query("W8_ordered_steps", "subject:s workflow_id:s pos:i edge_id:s kind:s", """
select subject, workflow_id, i - 1 as pos, step_ids[i] as edge_id, step_kinds[i] as kind from (
  select subject, workflow_id, step_ids, step_kinds, unnest(range(1, n_steps + 1)) as i from v_workflow)""")
def steps(t):
    return flow(t).workflows_with("subject", "workflow_id", "steps").select("subject", "workflow_id", F.posexplode("steps").alias("pos", "s")).select(
        "subject", "workflow_id", "pos", "s.edge_id", "s.kind")


@query("W9_workflows", "subject:s workflow_id:s first_route:s n_starts:i active_route:s n_steps:i", "select * from v_workflow")
def workflows(t):
    return flow(t).workflows_with("subject", "workflow_id", "first_route", "n_starts", "active_route", F.size("steps").alias("n_steps"))


@query("W9_start_routes", "subject:s comp_id:s start_route:s n_workflows:i", """
select t.subject, t.comp_id, a.start_route, count(*) as n_workflows from v_trigger t join v_active a on a.subject = t.subject and a.comp_id = t.comp_id group by all""")
def start_routes(t):
    """Start routes stay per component; their workflows are counted before the join."""
    f = flow(t)
    counts = f.trigger_counts
    return counts.join(f.active_places, ["subject", "comp_id"])


@query("W10_merged_constraints", "subject:s workflow_id:s params:s guards:s roles:s n_evidence:i n_atoms:i", """
select subject, workflow_id, array_to_string(params, ',') as params, array_to_string(guards, ',') as guards, array_to_string(roles, ',') as roles,
  n_refs as n_evidence, n_atoms from v_workflow""")
def merged(t):
    return flow(t).workflows_with("subject", "workflow_id", *joined("params", "guards", "roles"),
                                  F.size("refs").alias("n_evidence"), F.size("atoms").alias("n_atoms"))


@query("W11_verdicts", "subject:s workflow_id:s verdict:s n_unresolved:i loop_route:s stabilized:i n_gates:i form_valid:i contradiction:s", """
select subject, workflow_id, verdict, n_unresolved, loop_route, stabilized, case when verdict = 'PRUNED' then -1 else n_gates end as n_gates,
  verdict <> 'PRUNED' and form_valid as form_valid,
  case when impossible then (select arg_min(a.kind, a.pos) from v_atom a where a.edge_id = workflow_id and a.kind in ('WidgetVisible', 'WidgetEnabled') and a.a2 = 'false') end as contradiction
from v_workflow""")
def verdicts(t):
    return flow(t).workflows_with(
        "subject", "workflow_id", "verdict", F.size("unresolved").alias("n_unresolved"), "loop_route", "stabilized",
        F.size("ui_gates").alias("n_gates"), F.col("requires_form_valid").alias("form_valid"), F.col("contradiction.kind").alias("contradiction"))


@query("W12_strict_verdicts", "subject:s verdict:s empty_length:i empty_range:i n:i", """
select w.subject, case when coalesce(c.empty_length, false) or coalesce(c.empty_range, false) then 'PRUNED' else w.verdict end as verdict,
  coalesce(c.empty_length, false) as empty_length, coalesce(c.empty_range, false) as empty_range, count(*) as n
from v_workflow w left join (
  select edge_id, coalesce(max(try_cast(a3 as double)) filter (a2 = 'minLength') > min(try_cast(a3 as double)) filter (a2 = 'maxLength'), false) as empty_length,
    coalesce(max(try_cast(a3 as double)) filter (a2 = 'min') > min(try_cast(a3 as double)) filter (a2 = 'max'), false) as empty_range
  from v_atom where kind = 'InputConstraint' group by all) c on c.edge_id = w.workflow_id group by all""")
def strict(t):
    return fl.strict_verdict(flow(t).workflows_with("subject", "verdict", "atoms")).groupBy("subject", "verdict", "empty_length", "empty_range").agg(F.count(F.lit(1)).alias("n"))


@query("W13_verdict_stats", "subject:s n:i feasible:i conditional:i pruned:i n_routes:i", """
select w.*, r.n_routes from (select subject, count(*) as n, count(*) filter (verdict = 'FEASIBLE') as feasible, count(*) filter (verdict = 'CONDITIONAL') as conditional,
  count(*) filter (verdict = 'PRUNED') as pruned from v_workflow group by all) w
join (select subject, count(distinct from_id) as n_routes from v_edge where kind = 'ROUTE_ACTIVATES_COMPONENT' group by all) r using (subject)""")
def stats(t):
    f = flow(t)
    routes = f.activates.select("subject", "from_id").distinct().groupBy("subject").agg(F.count(F.lit(1)).alias("n_routes"))
    return fl.verdict_stats(f.workflows_with("subject", "verdict")).join(routes, "subject")


@query("W14_graph_fingerprint", "subject:s graph_hash:s", """
select subject, sha256(array_to_string(list_transform([0, 1, 2, 3], lambda i: cast(list_sum(list_transform(digests, lambda d: cast(('0x' || d[1 + 12 * i:12 + 12 * i]) as bigint))) as varchar)), '-')) as graph_hash
from (select subject, list(sha256(edge_id || '|' || kind || '|' || from_id || '|' || coalesce(to_id, '-') || '|' || coalesce(target_text, '-'))) as digests from v_edge group by subject)""")
def fingerprint(t):
    return fl.graph_fingerprint(graph(t).edges)


@query("W15_statically_enabled", "subject:s kind:s n:i", """
select e.subject, e.kind, count(*) as n from v_trigger e left join v_atom_list a on a.edge_id = e.edge_id where not coalesce(a.impossible, false) group by all""")
def enabled(t):
    return fl.statically_enabled(cut_together(graph(t).trigger_edges.select("subject", "kind", "atoms"))).groupBy("subject", "kind").agg(F.count(F.lit(1)).alias("n"))

