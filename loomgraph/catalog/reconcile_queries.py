"""T and V queries: reconciliation and viewer tables."""

from pyspark.sql import functions as F

from loomgraph.catalog.evidence_queries import READY, ready_results
from loomgraph.catalog.oracle_views import sub
from loomgraph.catalog.registry import query
from loomgraph.catalog.shared import flow, graph, intents, plans
from loomgraph.functions.scalar import path_params
from loomgraph.functions.scale import Pages, cut_together
from loomgraph.operators import evidence as ev
from loomgraph.operators import reconcile as rc
from loomgraph.operators import viewer as vw



def n():
    return F.count(F.lit(1)).alias("n")


def part():
    return F.element_at(F.split("widget_id", r"\|"), -1).cast("bigint")


# reference entries: derived rows with some fields left out and some wrong, by part number p
EXPECTED = {
    "x_kind": "case when p % 11 = 0 then 'WTH' when p % 2 = 0 then trigger_kind else case trigger_kind when 'WIDGET_TRIGGERS_HANDLER' then 'WTH' when 'WIDGET_SUBMITS_FORM' then 'WSF' when 'WIDGET_NAVIGATES_ROUTE' then 'WNR' else 'WNE' end end",
    "x_event": "case when p % 3 = 0 then null when p % 7 = 1 then 'input' else coalesce(trigger_event, 'click') end",
    "x_tag": "case when p % 4 = 0 then null when p % 13 = 2 then 'span' else tag_name end",
    "x_widget_kind": "case when p % 5 = 0 then null when widget_kind = 'OtherInteractive' then 'Unknown' when widget_kind = 'TextArea' then 'Textarea' else widget_kind end",
    "x_selector": "case when p % 6 = 0 then null when p % 37 = 1 then 'app-other' else selector end",
    "x_auth": "p % 2 = 0", "x_params": "requires_params <> (p % 17 = 0)", "x_form": "(trigger_kind = 'WIDGET_SUBMITS_FORM') <> (p % 19 = 0)",
    "x_terminal": "case when p % 3 = 1 then null else coalesce(terminal_path, '') || case when p % 23 = 0 then 'x' else '' end end",
    "x_url": "case when external_url is null then null when p % 29 = 0 then 'http://x' when p % 2 = 0 then external_url end",
    "x_fields": "case when trigger_kind = 'WIDGET_SUBMITS_FORM' and p % 3 = 0 then cast(2 as bigint) end",
}


def expected(t):
    return intents(t).intents.withColumn("p", part()).selectExpr("subject", "workflow_id", *[f"{e} as {c}" for c, e in EXPECTED.items()])


def expected_paths(t):
    i = intents(t)
    some = i.intents.withColumn("p", part()).where("p % 40 = 2").select("subject", "workflow_id", "comp_id", "p", "first_route")
    return some.join(i.start_records.select("subject", "comp_id", "start_route", "full_path"), ["subject", "comp_id"]).where("p % 80 = 2 or start_route = first_route").select("subject", "workflow_id", "full_path")


XENTRY = f"(select *, {', '.join(f'{e} as {c}' for c, e in EXPECTED.items())} from v_intent)"
COMP_AUTH = """(select a.subject, a.comp_id, bool_and(exists (select 1 from v_route_guard g where g.subject = a.subject and g.route_id = a.start_route and not contains(lower(g.guard), 'noauth'))) as all_auth from v_active a group by all)"""
FULL = "case {0} when 'WTH' then 'WIDGET_TRIGGERS_HANDLER' when 'WSF' then 'WIDGET_SUBMITS_FORM' when 'WNR' then 'WIDGET_NAVIGATES_ROUTE' when 'WNE' then 'WIDGET_NAVIGATES_EXTERNAL' else {0} end"
MISMATCH = f"""
select subject, workflow_id, f.field, coalesce(f.expected, '') as expected, coalesce(f.actual, '') as actual from (
  select e.*, c.all_auth, case when e.trigger_kind = 'WIDGET_SUBMITS_FORM' then coalesce(k.c, 0) else 0 end as n_fields from {XENTRY} e left join {COMP_AUTH} c on c.subject = e.subject and c.comp_id = e.comp_id
  left join (select form_id, count(*) as c from v_field group by all) k on k.form_id = e.widget_id) x, lateral (values
  ('triggerKind', {FULL.format('x_kind')}, trigger_kind, true), ('triggerEvent', x_event, coalesce(trigger_event, 'click'), x_event is not null), ('triggerWidgetTag', x_tag, coalesce(tag_name, ''), x_tag is not null),
  ('triggerWidgetKind', case x_widget_kind when 'Unknown' then 'OtherInteractive' when 'Textarea' then 'TextArea' else x_widget_kind end, widget_kind, x_widget_kind is not null),
  ('componentSelector', x_selector, coalesce(selector, ''), x_selector is not null), ('requiresAuth', x_auth || '', coalesce(all_auth, false) || '', true), ('requiresParams', x_params || '', requires_params || '', true),
  ('hasFormSchema', x_form || '', (trigger_kind = 'WIDGET_SUBMITS_FORM') || '', true), ('terminalRoutePath', x_terminal, coalesce(terminal_path, ''), x_terminal is not null),
  ('terminalExternalUrl', x_url, external_url, x_url is not null), ('formFieldCount', x_fields || '', n_fields || '', x_fields is not null)) f(field, expected, actual, used)
where used and f.expected is distinct from f.actual
union all select i.subject, i.workflow_id, 'startRouteFullPaths', '1', (select count(*) from v_active a where a.subject = i.subject and a.comp_id = i.comp_id) || ''
from v_intent i where p % 80 = 42 and (select count(*) from v_active a where a.subject = i.subject and a.comp_id = i.comp_id) <> 1"""


@query("T1_normal_labels", "x_kind:s kind:s x_widget_kind:s widget_kind:s n:i", f"""
select x_kind, {FULL.format('x_kind')} as kind, x_widget_kind, case x_widget_kind when 'Unknown' then 'OtherInteractive' when 'Textarea' then 'TextArea' else x_widget_kind end as widget_kind, count(*) as n from {XENTRY} group by all""")
def labels(t):
    d = intents(t).intents_with("widget_id", "trigger_kind", "widget_kind").withColumn("p", part())
    return d.selectExpr(*[f"{EXPECTED[c]} as {c}" for c in ("x_kind", "x_widget_kind")]).groupBy("x_kind", rc.normal_kind("x_kind").alias("kind"), "x_widget_kind", rc.normal_widget_kind("x_widget_kind").alias("widget_kind")).agg(n())


def mismatches(t):
    return rc.intent_mismatches(intents(t), expected(t), expected_paths(t))


@query("T2_intent_mismatches", "workflow_id:s field:s expected:s actual:s", MISMATCH)
def intent_mismatches(t):
    return mismatches(t)


# reference plans
PLAN_FACTS = ["subject", "workflow_id", "widget_id", "trigger_kind", "route_params", "start_path", "terminal_path", "external_url", "has_account", "has_auth", "start_url", "n_dialogs", "n_steps", "waits", "post_type", "post_expected"]


def expected_plans(made):
    p = made.withColumn("p", part())
    keys = F.array_join(F.array_sort(F.map_keys("route_params")), ",")
    submits = F.col("trigger_kind") == "WIDGET_SUBMITS_FORM"
    fill = F.array(F.struct(F.lit("fill-form").alias("type"), F.lit(3).alias("n_fields")), F.struct(F.lit("submit").alias("type"), F.lit(0).alias("n_fields")))
    return p.select(
        "subject", "workflow_id", (F.col("has_account") != (F.col("p") % 9 == 0)).alias("x_account"), F.when(F.col("p") % 7 == 0, "").otherwise(keys).alias("x_param_keys"),
        F.when(F.col("p") % 4 == 0, F.concat("start_path", F.lit("/z"))).otherwise(F.col("start_path")).alias("x_url"),
        F.expr("case p % 3 when 0 then array('authenticate', 'precondition') when 1 then array('trigger-dialog') else array('ensure-logged-out', 'navigate-to-route') end").alias("x_preconditions"),
        F.when(submits, fill).otherwise(F.array(F.struct(F.lit("click").alias("type"), F.lit(0).alias("n_fields")))).alias("x_steps"),
        F.when(F.col("p") % 5 == 0, F.lit("/zzz")).otherwise(F.coalesce("terminal_path", "external_url")).alias("x_terminal_url"))


@query("T3_plan_mismatches", "workflow_id:s field:s expected:s actual:s", f"""
select workflow_id, f.field, coalesce(f.expected, '') as expected, coalesce(f.actual, '') as actual from (
  select *, username is not null as has_account, (username is not null) <> (p % 9 = 0) as x_account, concat_ws(',', case when v_id is not null then 'id' end, case when v_tab is not null then 'tab' end) as keys,
    case when p % 4 = 0 then start_path || '/z' else start_path end as x_url, case when p % 5 = 0 then '/zzz' else coalesce(terminal_path, external_url) end as x_terminal_url,
    case when post_type = 'assert-no-crash' then null when trigger_kind = 'WIDGET_NAVIGATES_EXTERNAL' then external_url else expected_path end as post_expected from v_plan) x, lateral (values
  ('account', x_account || '', has_account || '', true), ('routeParams', case when p % 7 = 0 then '' else keys end, keys, true), ('navigateUrl', {sub('x_url')}, start_url, x_url is not null and start_url is not null),
  ('authSetup', (p % 3 = 0) || '', has_auth || '', x_account <> has_account), ('dialogOpen', (p % 3 = 1) || '', (n_dialogs > 0) || '', true),
  ('stepCount', case when trigger_kind = 'WIDGET_SUBMITS_FORM' then '4' else '1' end, (n_fields + 1) || '', true),
  ('terminalUrl', {sub('x_terminal_url')}, post_expected, post_type = 'assert-url-matches' and x_terminal_url is not null and x_terminal_url is distinct from post_expected)) f(field, expected, actual, used)
where used and f.expected is distinct from f.actual""")
def plan_mismatches(t):
    made = plans(t).plans_with(*PLAN_FACTS)
    return rc.plan_mismatches(made, expected_plans(made))


@query("T4_reconciliation_summary", "subject:s is_total:i total:i missing:i mismatched:i matched:i", f"""
select subject, grouping(subject) as is_total, count(*) as total, count(*) filter (gone) as missing, count(*) filter (not gone and bad) as mismatched, count(*) filter (not gone and not bad) as matched from (
  select e.subject, e.workflow_id, false as gone, exists (select 1 from ({MISMATCH}) m where m.workflow_id = e.workflow_id) as bad from {XENTRY} e
  union all select subject, workflow_id || '#gone', true, false from {XENTRY} where p % 31 = 0) group by rollup (subject)""")
def summary(t):
    e = expected(t).select("subject", "workflow_id")
    gone = intents(t).intents.withColumn("p", part()).where("p % 31 = 0").select("subject", F.concat("workflow_id", F.lit("#gone")).alias("workflow_id"))
    return rc.reconciliation_summary(e.unionByName(gone), intents(t).intents, mismatches(t))


def blocks(t):
    """Entries: events of buttons, links and forms, some under a former handler or tag, and inner links; candidates: workflows with effects of the same component and kind.

    Inner links are entries without such a workflow; workflows of other widgets have no entry.
    """
    number = lambda *c: F.conv(F.substring(F.md5(F.concat_ws("~", *c)), 1, 10), 16, 10).cast("long")
    w = flow(t).workflows_with("workflow_id", "widget_id", "comp_id", "trigger_kind", "effect_group").where("effect_group is not null")
    cands = w.select(F.concat_ws("|", "comp_id", "trigger_kind").alias("block"), number("workflow_id").alias("cand"),
                     F.split_part("effect_group", F.lit("::"), F.lit(-1)).alias("handler"), F.split_part("widget_id", F.lit("|"), F.lit(3)).alias("tag"))
    kind = (F.when(F.col("event_type") == "link", "WIDGET_NAVIGATES_ROUTE").when((F.col("event_type") == "submit") & (F.col("kind") == "Form"), "WIDGET_SUBMITS_FORM")
            .otherwise("WIDGET_TRIGGERS_HANDLER"))
    links = t.bindings.where("name = 'routerLink'").selectExpr("comp_id", "widget_id", "'routerLink' as handler", "seq", "split_part(widget_id, '|', 3) as kind", "'link' as event_type").where("kind = 'Link'")
    listed = t.events.where("kind in ('Button', 'Link', 'Form')").select(*links.columns)
    e = listed.unionByName(links).withColumn("h", number("widget_id", "handler", "seq"))
    entries = e.select(F.concat_ws("|", "comp_id", kind).alias("block"), number(F.lit("entry"), "widget_id", "handler", "seq").alias("entry"),
                       F.when(F.col("h") % 101 == 0, "other").otherwise(F.col("handler")).alias("handler"), F.when(F.col("h") % 53 == 0, "Link").otherwise(F.col("kind")).alias("tag"))
    return entries, cands


@query("T5_greedy_match", "block:s entry:i cand:i", "select block, entry, cand from v_turn where cand is not null")
def greedy(t):
    return rc.greedy_match(*blocks(t))


@query("T6_missing_and_spurious", "block:s what:s item:i", """
select block, 'missing' as what, entry as item from v_rentry e where not exists (select 1 from v_turn t where t.block = e.block and t.entry = e.entry and t.cand is not null)
union all select block, 'spurious', cand from v_rcand c where not exists (select 1 from v_turn t where t.block = c.block and t.cand = c.cand)""")
def missing(t):
    e, c = blocks(t)
    return rc.missing_and_spurious(e, c, rc.greedy_match(e, c))


@query("T7_agreement", "workflow_id:s class:s", """
select workflow_id, case when not (len(list_filter(x_calls, lambda x: not list_contains(calls, x))) = 0 and len(list_filter(calls, lambda x: not list_contains(x_calls, x))) = 0 and (not x_navigates or has_nav)) then 'WRONG_CLOSURE'
  when x_verdict <> verdict then 'WRONG_CONSTRAINT' else 'MATCHED' end as class
from (select *, case when p % 6 = 1 then list_concat(calls, ['Extra']) else list_distinct(calls) end as x_calls, p % 4 = 0 as x_navigates, case when p % 5 = 2 then 'FEASIBLE' else verdict end as x_verdict
  from (select w.workflow_id, w.has_nav, w.verdict, cast(split_part(w.widget_id, '|', 4) as bigint) as p, list_distinct(list_transform(list_filter(w.step_ids, lambda s: contains(s, '::COMPONENT_CALLS_SERVICE::')), lambda s: split_part(split_part(s, '::', 3), '#', 2))) as calls
    from v_workflow w where w.effect_group is not null))""")
def agreement(t):
    calls = F.array_distinct(F.transform(F.filter("steps", lambda s: s["kind"] == "COMPONENT_CALLS_SERVICE"),
                                         lambda s: F.split_part(F.split_part(s["edge_id"], F.lit("::"), F.lit(3)), F.lit("#"), F.lit(2))))
    w = flow(t).workflows_with("workflow_id", "widget_id", "effect_group", "has_nav", "verdict", calls.alias("calls")).where("effect_group is not null").withColumn("p", part())
    return rc.agreement(w.withColumns({
        "x_calls": F.when(F.col("p") % 6 == 1, F.array_append("calls", F.lit("Extra"))).otherwise(F.col("calls")), "x_navigates": F.col("p") % 4 == 0, "navigates": F.col("has_nav"),
        "x_verdict": F.when(F.col("p") % 5 == 2, "FEASIBLE").otherwise(F.col("verdict"))}))


@query("T8_idle_triggers", "subject:s kind:s n:i", """
select e.subject, e.kind, count(*) as n from v_trigger e where not exists (select 1 from v_cstart c where c.subject = e.subject and c.comp_id = e.comp_id) group by all""")
def idle(t):
    return rc.idle_triggers(flow(t).triggers, flow(t).workflows_with("subject", "workflow_id")).groupBy("subject", "kind").agg(n())


@query("T9_subject_profile", "subject:s metric:s key:s value:d", """
select subject, 'nodes' as metric, kind as key, cast(count(*) as double) as value from v_node group by all union all select subject, 'edges', kind, count(*) from v_edge group by all
union all select subject, 'entry_routes', 'all', count(*) from v_entry group by all
union all select e.subject, 'idle_entry_routes', 'all', count(*) from v_entry e where not exists (select 1 from v_edge x where x.kind = 'ROUTE_ACTIVATES_COMPONENT' and x.subject = e.subject and x.from_id = e.route_id) group by all
union all select subject, 'triggers', kind, count(*) from v_trigger group by all union all select subject, 'trigger_widgets', kind, count(distinct from_id) from v_trigger group by all
union all select subject, 'verdicts', verdict, count(*) from v_workflow group by all union all select subject, 'step_counts', n_steps || '', count(*) from v_workflow group by all
union all select subject, 'starts_with_redirect', 'all', count(*) from v_workflow where step_kinds[1] = 'ROUTE_REDIRECTS_TO_ROUTE' group by all
union all select k.subject, 'kind_participation', k.kind, round(1e2 * k.c / w.c, 1) from (select subject, kind, count(*) as c from (select subject, workflow_id, unnest(list_distinct(step_kinds)) as kind from v_workflow) group by all) k
  join (select subject, count(*) as c from v_workflow group by all) w using (subject)""")
def profile(t):
    f = flow(t)
    return rc.subject_profile(f, f.g.nodes, f.g.edges)


@query("T9_top_groups", "subject:s comp_id:s signature:s size:i", """
select subject, comp_id, array_to_string(step_kinds, '>') as signature, count(*) as size from v_workflow group by all order by size desc, comp_id, signature limit 10""")
def top_groups(t):
    return rc.top_groups(flow(t).workflows_with("subject", "comp_id", "steps"))


@query("T9_dedup_ratio", "subject:s n:i groups:i dedup_ratio:d", """
select subject, count(*) as n, count(distinct comp_id || '>' || array_to_string(step_kinds, '>')) as groups, round(count(*) / count(distinct comp_id || '>' || array_to_string(step_kinds, '>')), 1) as dedup_ratio from v_workflow group by all""")
def dedup(t):
    return rc.dedup_ratio(flow(t).workflows_with("subject", "comp_id", "steps"))


@query("T10_reachable_triggers", "subject:s comp_id:s total:i reachable:i", """
select t.subject, t.comp_id, count(*) as total, case when exists (select 1 from v_entry e join v_edge a on a.kind = 'ROUTE_ACTIVATES_COMPONENT' and a.subject = e.subject and a.from_id = e.route_id
  join v_reach r on r.subject = a.subject and r.root = a.to_id where r.subject = t.subject and r.comp_id = t.comp_id) then count(*) else 0 end as reachable from v_trigger t group by t.subject, t.comp_id""")
def reachable(t):
    return rc.reachable_triggers(flow(t))


@query("T11_workflow_listing", "workflow_id:s class_name:s place:s widget_kind:s edge_kind:s terminal:s n_effects:i verdict:s", """
select workflow_id, regexp_extract(workflow_id, '#([^|]*)[|]', 1) as class_name, split_part(widget_id, '|', 2) as place, split_part(widget_id, '|', 3) as widget_kind, trigger_kind as edge_kind,
  case when starts_with(terminal_id, '__ext__') then 'EXTERNAL' else split_part(terminal_id, '@', 1) end as terminal, len(list_filter(step_kinds, lambda k: starts_with(k, 'COMPONENT_'))) as n_effects, verdict from v_workflow""")
def listing(t):
    return rc.workflow_listing(flow(t).workflows_with("subject", "workflow_id", "steps", "terminal_id", "verdict"))


@query("T12_run_differences", "test_id:s difference:s", """
select test_id, case when b.test_id is null then 'only in a' when a.test_id is null then 'only in b' when a.attempts <> b.attempts then 'attempts' when a.duration_ms <> b.duration_ms then 'duration_ms' when a.outcome <> b.outcome then 'outcome' end as difference
from (select f.* from v_fold f join v_test using (test_id) where log_exists) a full join (select test_id, count(*) as attempts, sum(duration_ms) as duration_ms, arg_max(outcome, attempt) as outcome from (
  select *, min(case when outcome in ('PASS', 'FAIL_APP_NOT_READY') then attempt end) over (partition by test_id) as stop from v_attempt where attempt <= 2) where stop is null or attempt <= stop group by all) b using (test_id)
where a.test_id is null or b.test_id is null or a.attempts <> b.attempts or a.duration_ms <> b.duration_ms or a.outcome <> b.outcome""")
def differences(t):
    a = ev.fold_attempts(t.attempts).join(t.tests.where("log_exists").select("test_id"), "test_id", "left_semi").drop("subject", "user_id")
    b = ev.fold_attempts(t.attempts, max_attempts=2).drop("subject", "user_id")
    return rc.compare_runs(a, b, "test_id")


@query("T13_difficulty", "subject:s difficulty:s n:i", """
select subject, case when trigger_kind = 'WIDGET_NAVIGATES_EXTERNAL' then 'D7' when contains(selector, 'dialog') then 'D6' when gated and (guarded or parameterised or form) then 'D5' when form then 'D2' when guarded then 'D3' when parameterised then 'D4'
  when gated then 'D5' else 'D1' end as difficulty, count(*) as n from (select *, len(gates) > 0 as gated, len(guards) > 0 as guarded, len(params) > 0 as parameterised, trigger_kind = 'WIDGET_SUBMITS_FORM' as form from v_intent) group by all""")
def difficulty(t):
    cols = {"external": F.col("trigger_kind") == "WIDGET_NAVIGATES_EXTERNAL", "dialog": F.contains("selector", F.lit("dialog")), "gated": F.size("gates") > 0,
            "guarded": F.size("guards") > 0, "parameterised": F.size("params") > 0, "form": F.col("trigger_kind") == "WIDGET_SUBMITS_FORM"}
    return intents(t).intents_with("subject", rc.difficulty(cols).alias("difficulty")).groupBy("subject", "difficulty").agg(n())


# ---- viewer tables --------------------------------------------------------------------------

LABEL = ("coalesce(nullif(a_id, ''), nullif(a_name, ''), nullif(a_aria_label, ''), nullif(a_placeholder, ''), nullif(a_title, ''), case when a_type is null then tag_name else tag_name || ':' || a_type end)")


@query("V1_display_labels", "node_id:s label:s subtype:s", f"select widget_id as node_id, {LABEL} as label, case when a_type is null then tag_name else tag_name || ':' || a_type end as subtype from v_widget")
def display_labels(t):
    return vw.widget_view(t.widgets)


@query("V2_route_view", "subject:s node_id:s label:s params:s auth_required:i is_entry:i", """
select r.subject, r.route_id as node_id, r.full_path as label, array_to_string(r.params, ',') as params, len(list_filter(r.guards, lambda g: contains(g, 'Auth'))) > 0 as auth_required, e.route_id is not null as is_entry
from v_route r left join v_entry e on e.subject = r.subject and e.route_id = r.route_id""")
def route_view(t):
    return vw.route_view(t.routes, graph(t).entry_routes, F.array_join(path_params("full_path"), ","))


@query("V3_edge_view", "edge_id:s n_conditions:i conditions:s", """
select e.edge_id, count(a.kind) as n_conditions, coalesce(string_agg(a.kind || ': ' || e.wid || case when a.a2 <> '' then ', ' || a.a2 else '' end || case when a.a3 <> '' then ', ' || a.a3 else '' end, ' ; ' order by a.pos), '') as conditions
from v_edge e left join v_atom a on a.edge_id = e.edge_id where e.kind = 'WIDGET_NAVIGATES_ROUTE' group by e.edge_id""")
def edge_view(t):
    return cut_together(vw.edge_view(graph(t).of_kind("WIDGET_NAVIGATES_ROUTE")).select("edge_id", "n_conditions", F.array_join("conditions", " ; ").alias("conditions")))


@query("V4_kind_counts", "subject:s what:s kind:s n:i", "select subject, 'node' as what, kind, count(*) as n from v_node group by all union all select subject, 'edge', kind, count(*) from v_edge group by all")
def kind_counts(t):
    return vw.kind_counts(graph(t).nodes, graph(t).edges)


@query("V5_neighbourhood", "subject:s node_id:s hop:i", """
select subject, node_id, min(hop) as hop from v_near group by all""")
def near(t):
    seeds = t.components.where("r = 7").select("subject", F.col("comp_id").alias("node_id"))
    g = graph(t)
    return vw.neighbourhood(g.of_kind("COMPONENT_COMPOSES_COMPONENT", "ROUTE_ACTIVATES_COMPONENT", "MODULE_DECLARES_COMPONENT"), seeds, 2)


@query("V6_induced_subgraph", "subject:s kind:s n:i", """
select e.subject, e.kind, count(*) as n from v_edge e where e.to_id is not null and exists (select 1 from v_node n where n.subject = e.subject and n.node_id = e.from_id and n.kind in ('Component', 'Route', 'Module') and (contains(lower(n.node_id), 's1') or contains(lower(n.label), 's1')))
  and exists (select 1 from v_node n where n.subject = e.subject and n.node_id = e.to_id and n.kind in ('Component', 'Route', 'Module') and (contains(lower(n.node_id), 's1') or contains(lower(n.label), 's1'))) group by all""")
def induced(t):
    _, edges = vw.induced_subgraph(graph(t).nodes, graph(t).edges, ["Component", "Route", "Module"], "S1")
    return edges.groupBy("subject", "kind").agg(n())


@query("V7_workflow_search", "subject:s workflow_id:s verdict:s", """
select subject, workflow_id, verdict from v_workflow w where verdict = 'CONDITIONAL' and n_unresolved > 0 and (contains(lower(workflow_id || ' ' || terminal_id || ' ' || coalesce(effect_group, '') || ' ' || array_to_string(step_ids, ' ')), 'n13')
  or exists (select 1 from v_active a where a.subject = w.subject and a.comp_id = w.comp_id and contains(lower(a.start_route), 'n13')))""")
def search(t):
    starts = intents(t).start_records.select("subject", "comp_id", "start_route")
    asked = ["subject", "workflow_id", "comp_id", "verdict", "unresolved", "terminal_id", "effect_group", "steps"]
    return vw.search_workflows(flow(t).workflows_with(*asked), "N13", verdict="CONDITIONAL", unresolved=True, start_paths=starts)


SIGNED = "(select w.*, array_to_string(step_kinds, ' > ') || ' > ' || coalesce(n.kind, '?') as signature from v_workflow w left join v_node n on n.subject = w.subject and n.node_id = w.terminal_id)"


@query("V8_signature_groups", "signature:s size:i", f"""
with g as (select signature, count(*) as size from {SIGNED} group by all), t as (select * from g order by size desc, signature limit 10)
select * from t union all select '(others)', coalesce(sum(size), 0) from g where signature not in (select signature from t)""")
def signatures(t):
    # a workflow ends at a route or outside; equal steps with equal ends are counted before they ask for its kind
    steps = F.transform("steps", lambda s: F.struct(s["kind"].alias("kind"))).alias("steps")
    counted = flow(t).workflows_with("subject", "terminal_id", steps).groupBy("subject", "terminal_id", "steps").agg(n())
    return vw.signature_groups(vw.step_signatures(counted, graph(t).nodes.where("kind in ('Route', 'External')")))


@query("V9_termination_causes", "subject:s cause:s n:i", """
select subject, case when loop_route is not null then 'redirect loop' when n_unresolved > 0 then 'unresolved nav' when starts_with(terminal_id, '__ext__') then 'external navigation' when n_steps = 1 then 'trigger only (no effects)'
  else 'effect closure complete' end as cause, count(*) as n from v_workflow group by all""")
def causes(t):
    return flow(t).workflows_with("subject", vw.termination_cause().alias("cause")).groupBy("subject", "cause").agg(n())


@query("V10_failure_distribution", "kind:s n:i", f"""
select coalesce(l.failure_kind, f.outcome) as kind, count(*) as n from v_test t join {READY} f using (test_id) left join v_log l on l.test_id = t.user_id || '' where f.outcome <> 'PASS' group by all""")
def failures(t):
    logs = t.tests.select("test_id", F.col("user_id").cast("string").alias("log_id")).join(t.logs.select(F.col("test_id").alias("log_id"), "failure_kind"), "log_id")
    return vw.failure_distribution(t.tests.select("test_id"), ready_results(t), logs)


@query("V10_result_filter", "test_id:s state:s", f"select t.test_id, f.outcome as state from v_test t join {READY} f using (test_id) where f.outcome <> 'PASS' and t.log_exists")
def result_filter(t):
    return vw.filter_results(t.tests.select("test_id"), ready_results(t).join(t.tests.where("log_exists").select("test_id"), "test_id", "left_semi"), "FAIL")


@query("V11_result_page", "test_id:s outcome:s duration_ms:i", f"select test_id, outcome, duration_ms from {READY} order by duration_ms desc, test_id limit 25 offset 50")
def result_page(t):
    return vw.result_page(Pages(ready_results(t), [F.desc("duration_ms"), F.asc("test_id")]), 2, 25)



