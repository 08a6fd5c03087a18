"""I, F and M queries: intents, plans and manifests."""

from pyspark.sql import functions as F

from loomgraph.catalog.oracle_views import MANIFESTS, sub
from loomgraph.catalog.registry import query
from loomgraph.catalog.shared import flow, intents, plans
from loomgraph.functions.scalar import substitute_params, template_params
from loomgraph.operators import checks as ck
from loomgraph.operators import intents as it
from loomgraph.plans import binding as bd
from loomgraph.sources import fixture as fx


def n():
    return F.count(F.lit(1)).alias("n")


def text_of(col):
    return F.array_join(col, ",").alias(col if isinstance(col, str) else "text")


# ---- intents -------------------------------------------------------------------------------


@query("I1_trigger_event", "subject:s trigger_kind:s trigger_event:s n:i", "select subject, trigger_kind, trigger_event, count(*) as n from v_intent group by all")
def trigger_event(t):
    return intents(t).intents_with("subject", "trigger_kind", "trigger_event").groupBy("subject", "trigger_kind", "trigger_event").agg(n())


@query("I2_guard_names", "workflow_id:s guard_names:s", "select workflow_id, array_to_string(guard_names, ',') as guard_names from v_intent")
def guard_names(t):
    return intents(t).intents_with("workflow_id", text_of("guard_names"))


@query("I3_start_records", "subject:s comp_id:s start_route:s full_path:s params:s", """
select a.subject, a.comp_id, a.start_route, case when a.start_route = '*' then '*' else coalesce(r.full_path, '(unknown)') end as full_path, array_to_string(r.params, ',') as params from v_place a left join v_route r on r.subject = a.subject and r.route_id = a.start_route""")
def start_records(t):
    return intents(t).place_records.select("subject", "comp_id", "start_route", "full_path", text_of("params"))


@query("I4_trigger_widgets", "workflow_id:s selector:s tag_name:s widget_kind:s form_around:s gates:s router_link:s css_hidden:i", """
select workflow_id, selector, tag_name, widget_kind, form_around, array_to_string(gates, ',') as gates, router_link, css_hidden from v_intent""")
def trigger_widgets(t):
    return intents(t).intents_with("workflow_id", "selector", "tag_name", "widget_kind", "form_around", text_of("gates"), "router_link", "css_hidden")


@query("I5_form_fields", "form_id:s field_id:s kind:s key:s input_type:s required:i min_length:i max_length:i date_format:s first_option:s id_attr:s", "select * from v_field")
def form_fields(t):
    return intents(t).fields


@query("I6_terminals", "workflow_id:s terminal_path:s external_url:s", "select * from v_intent")
def terminals(t):
    return intents(t).intents_with("workflow_id", "terminal_path", "external_url")


@query("I7_flags", "subject:s verdict:s requires_params:i has_unresolved:i n:i", """
select subject, verdict, requires_params, n_unresolved > 0 as has_unresolved, count(*) as n from v_intent group by all""")
def flags(t):
    flags = ["subject", "verdict", "requires_params", "has_unresolved"]
    return intents(t).intents_with(*flags).groupBy(*flags).agg(n())


@query("I7_stats", "subject:s total:i feasible:i conditional:i pruned:i", """
select subject, count(*) as total, count(*) filter (verdict = 'FEASIBLE') as feasible, count(*) filter (verdict = 'CONDITIONAL') as conditional, count(*) filter (verdict = 'PRUNED') as pruned from v_workflow group by all""")
def stats(t):
    return it.intent_stats(flow(t).workflows_with("subject", "verdict"))


# ---- plans ---------------------------------------------------------------------------------


@query("F1_account_choice", "subject:s guards:s username:s", "select subject, array_to_string(start_guards, ',') as guards, username from v_acct")
def account(t):
    needs = plans(t).start_choice.select("subject", F.col("start_guards").alias("guards"))
    return bd.choose_account(needs, t.accounts).select("subject", text_of("guards"), "username")


@query("F2_parameter_binding", "subject:s start_path:s terminal_path:s param:s value:s", "select * from v_bound")
def params(t):
    d = plans(t).assigned.select("subject", "start_path", "terminal_path")
    return bd.bind_params(d, t.param_values).select("subject", "start_path", "terminal_path", F.explode("route_params").alias("param", "value"))


@query("F3_default_values", "workflow_id:s field_id:s value:s", """
select workflow_id, field_id, value from v_form_value where given is null and not coalesce(start_path = login_route and form_control_name in ('username', 'password'), false)""")
def default_values(t):
    d = plans(t).form_data
    login = (F.col("start_path") == F.col("login_route")) & F.col("form_control_name").isin("username", "password")
    return d.where(F.col("given").isNull() & ~F.coalesce(login, F.lit(False))).withColumn("value", bd.default_value(F.col("workflow_id")))


@query("F4_form_data", "workflow_id:s key:s value:s", "select * from v_form_value")
def form_data(t):
    return plans(t).form_data


@query("F5_composed_within_four", "subject:s from_id:s to_id:s", "select distinct subject, from_id, to_id from v_within")
def within(t):
    return bd.composed_within(flow(t).composes)


@query("F6_start_choice", "subject:s comp_id:s needs_auth:i start_id:s start_path:s", "select * from v_choice")
def start_choice(t):
    return plans(t).start_choice


@query("F7_substituted_paths", "subject:s start_path:s terminal_path:s names:s url:s", f"""
select subject, start_path, terminal_path, array_to_string(regexp_extract_all(start_path, ':([a-zA-Z_][a-zA-Z0-9_]*)', 1), ',') as names, {sub('start_path')} as url
from (select distinct subject, start_path, terminal_path, v_id, v_tab from v_plan_base)""")
def substituted(t):
    d = plans(t).assigned.select("subject", "start_path", "terminal_path")
    return bd.bind_params(d, t.param_values).select(
        "subject", "start_path", "terminal_path", F.array_join(template_params("start_path"), ",").alias("names"), substitute_params("start_path", "route_params").alias("url"))


@query("F8_widget_locators", "workflow_id:s strategy:s value:s", "select workflow_id, strategy, value from v_locator where workflow_id in (select workflow_id from v_assigned)")
def locators(t):
    return plans(t).plans_with("workflow_id", "locator").select("workflow_id", "locator.*")


FIELD_LOC = ("case when coalesce(form_control_name, '') <> '' then 'formcontrolname' when coalesce(name_attr, '') <> '' then 'name' when coalesce(id_attr, '') <> '' then 'id' else 'tag-position' end")
FIELD_VAL = ("case when coalesce(form_control_name, '') <> '' then form_control_name when coalesce(name_attr, '') <> '' then name_attr when coalesce(id_attr, '') <> '' then id_attr else tag_name end")


@query("F9_field_locators", "form_id:s field_id:s strategy:s value:s", f"select form_id, field_id, {FIELD_LOC} as strategy, {FIELD_VAL} as value from v_field")
def field_locators(t):
    return intents(t).fields.withColumn("l", bd.field_locator()).select("form_id", "field_id", "l.*")


@query("F10_selector_text", "strategy:s selector:s n:i", """
select strategy, case when strategy = 'id' then 'id=' || value when strategy = 'name' then 'name=' || value when strategy = 'linktext' then 'link=' || value
  when strategy in ('formcontrolname', 'aria-label', 'routerlink', 'href', 'placeholder', 'data-testid') then 'css=[' || strategy || '="' || value || '"]'
  when strategy = 'tag-position' then 'css=' || split_part(value, ':', 1) || ':nth-of-type(' || split_part(value, ':', 2) || ')' else 'css=' || value end as selector, count(*) as n
from v_locator where workflow_id in (select workflow_id from v_assigned) group by all""")
def selector_text(t):
    d = plans(t).plans_with("locator").select("locator.*")
    return d.withColumn("selector", bd.selector_text(F.col("strategy"), F.col("value"))).groupBy("strategy", "selector").agg(n())


@query("F11_preconditions", "workflow_id:s has_auth:i start_url:s n_dialogs:i dialog_selector:s dialog_opener:s", "select * from v_plan")
def preconditions(t):
    return plans(t).plans_with("workflow_id", "has_auth", "start_url", "n_dialogs", "dialog_selector", "dialog_opener")


@query("F11_precondition_rows", "workflow_id:s pos:i type:s selector:s value:s", """
select workflow_id, i - 1 as pos, r[i].type as type, r[i].selector as selector, r[i].value as value from (
  select workflow_id, list_concat(list_concat(
    case when has_auth then [{'type': 'auth-setup', 'selector': cast(null as varchar), 'value': login_route}] else [] end,
    case when start_url is not null then [{'type': 'navigate-to-route', 'selector': cast(null as varchar), 'value': start_url}] else [] end),
    list_transform(dialogs, lambda x: {'type': 'trigger-dialog-open', 'selector': x.selector, 'value': x.opener})) as r from v_plan), unnest(range(1, len(r) + 1)) u(i)""")
def precondition_rows(t):
    return plans(t).precondition_rows


@query("F12_action_steps", "workflow_id:s item:s type:s strategy:s locator:s value:s scope:s", f"""
select p.workflow_id, '' as item, 'wait-for-element' as type, l.strategy, l.value as locator, '' as value, p.selector as scope from v_plan p join v_locator l on l.workflow_id = p.workflow_id where p.waits = 1
union all select workflow_id, field_id, case when tag_name = 'select' then 'select-option' when kind in ('Checkbox', 'Radio') then 'click' when input_type = 'file' or date_format is not null then 'type' else 'clear-and-type' end,
  {FIELD_LOC}, {FIELD_VAL}, case when tag_name <> 'select' and kind in ('Checkbox', 'Radio') then '' else value end, case when is_template = 1 then 'ngb-modal-window' else selector end from v_form_value
union all select p.workflow_id, '~', case when p.trigger_kind = 'WIDGET_SUBMITS_FORM' then 'submit' else 'click' end, l.strategy, l.value, '', case when p.is_template = 1 then 'ngb-modal-window' else p.selector end
from v_plan p join v_locator l on l.workflow_id = p.workflow_id""")
def action_steps(t):
    return plans(t).steps


@query("F13_postconditions", "workflow_id:s post_type:s post_expected:s post_fallback:s", f"""
select workflow_id, post_type, case when post_type = 'assert-no-crash' then null when trigger_kind = 'WIDGET_NAVIGATES_EXTERNAL' then external_url else expected_path end as post_expected,
  case when post_type = 'assert-url-matches-or-unchanged' then {sub('start_path')} end as post_fallback from v_plan""")
def postconditions(t):
    return plans(t).plans_with("workflow_id", "post_type", "post_expected", "post_fallback")


@query("F14_plan_stats", "subject:s planned:i skipped:i with_context:i", """
select i.subject, count(p.workflow_id) as planned, count(*) - count(p.workflow_id) as skipped, count(*) filter (p.workflow_id is not null) as with_context
from v_intent i left join v_assigned p on p.workflow_id = i.workflow_id group by all""")
def plan_stats(t):
    p = plans(t)
    context = (F.size("gates") > 0) | F.col("inside_ng_for").isNotNull() | F.col("selector").isNotNull()
    made = p.assigned_with("subject", context.alias("context")).groupBy("subject").agg(F.count(F.lit(1)).alias("planned"), F.count_if("context").alias("with_context"))
    return p.i.intents_with("subject").groupBy("subject").agg(F.count(F.lit(1)).alias("all_n")).join(made, "subject").withColumn("skipped", F.col("all_n") - F.col("planned"))


@query("F15_time_budget", "workflow_id:s n_steps:i n_pre:i budget_ms:i", """
select workflow_id, waits + n_fields + 1 as n_steps, has_auth::int + (start_path is not null)::int + n_dialogs as n_pre,
  (case when has_auth then 15000 else 0 end) + (waits + n_fields + 1) * 5000 + (has_auth::int + (start_path is not null)::int + n_dialogs + 1) * 10000 + 15000 as budget_ms from v_plan""")
def budget(t):
    return plans(t).plans_with("workflow_id", "n_steps", "n_pre", "budget_ms")


@query("F16_wait_reason", "subject:s wait_reason:s n:i", """
select subject, case when has_auth and len(list_filter(gates, lambda g: regexp_matches(trim(g), '^!is(LoggedIn|Authenticated)', 'i'))) > 0 then null
  when len(list_filter(gates, lambda g: regexp_matches(g, 'async|can:', 'i'))) > 0 then 'async/permission gate' when inside_ng_for is not null then 'repeater data readiness'
  when len(gates) > 0 then 'visibility gate' end as wait_reason, count(*) as n from v_plan group by all""")
def wait_reason(t):
    return plans(t).plans_with("subject", "wait_reason").groupBy("subject", "wait_reason").agg(n())


@query("F17_generation_rates", "subject:s is_total:i n_eligible:i n_plans:i n_tests:i per_plan:d per_eligible:d", """
select subject, grouping(subject) as is_total, sum(e) as n_eligible, sum(p) as n_plans, sum(x) as n_tests, sum(x) / sum(p) as per_plan, sum(x) / sum(e) as per_eligible from (
  select i.subject, count(*) as e, count(a.workflow_id) as p, count(*) filter (a.workflow_id is not null and i.p % 10 <> 3) as x
  from v_intent i left join v_assigned a on a.workflow_id = i.workflow_id group by all) group by rollup (subject)""")
def rates(t):
    p = plans(t)
    made = p.assigned_with("subject", "widget_id")
    tests = made.where(F.element_at(F.split("widget_id", r"\|"), -1).cast("bigint") % 10 != 3)
    return bd.generation_rates(made, tests, p.i.intents_with("subject"))


# ---- manifests --------------------------------------------------------------------------------


def sql_type(path, wanted):
    k = f"json_type(j, '$.{path}')"
    text = f"json_extract_string(j, '$.{path}')"
    return {"text": f"({k} = 'VARCHAR' and length({text}) > 0)", "string": f"{k} = 'VARCHAR'", "array": f"{k} = 'ARRAY'", "object": f"{k} = 'OBJECT'", "boolean": f"{k} = 'BOOLEAN'",
            "number": f"{k} in ('BIGINT', 'UBIGINT', 'DOUBLE')", "positive": f"({k} in ('BIGINT', 'UBIGINT', 'DOUBLE') and cast({text} as double) > 0)",
            "status": f"({k} = 'VARCHAR' and {text} in ('pre-seeded', 'needs-command', 'none'))"}[wanted]


def _rule_sql():
    out = ["select manifest_id, 'LOAD_ERROR' as field from m where j is null"]
    for path, wanted, required in ck.RULES:
        present = "" if required else f"json_type(j, '$.{path}') is not null and "
        out.append(f"select manifest_id, '{path}' from m where j is not null and {present}not coalesce({sql_type(path, wanted)}, false)")
    for parent, parts in ck.WHEN_PRESENT.items():
        for part, wanted in parts:
            out.append(f"select manifest_id, '{parent}.{part}' from m where json_type(j, '$.{parent}') = 'OBJECT' and not coalesce({sql_type(parent + '.' + part, wanted)}, false)")
    for f, wanted in ck.ACCOUNT_RULES:
        out.append(f"select manifest_id, 'accounts[0].{f}' from m where json_array_length(j, '$.accounts') > 0 and json_type(j, '$.accounts') = 'ARRAY' and not coalesce({sql_type('accounts[0].' + f, wanted)}, false)")
    out.append("select manifest_id, 'subjectName:folder' from m where json_type(j, '$.subjectName') = 'VARCHAR' and json_extract_string(j, '$.subjectName') not in ('', folder)")
    return " union all ".join(out)


ISSUES = f"(with m as (select * from {MANIFESTS}) {_rule_sql()})"


@query("M1_structural_issues", "manifest_id:i severity:s field:s", f"select manifest_id, 'error' as severity, field from {ISSUES}")
def structural(t):
    return ck.manifest_issues(t.manifest_texts)


@query("M2_declared_supply", "manifest_id:i warning:s name:s", f"""
select manifest_id, 'guard' as warning, 'AuthGuard' as name from {MANIFESTS} where contains(json_extract_string(j, '$.seedRequirements.authGuards') || '', 'AuthGuard')
  and not coalesce(json_type(j, '$.accounts') = 'ARRAY' and contains(json_extract_string(j, '$.accounts[0].guardSatisfies') || '', 'AuthGuard'), false)
union all select manifest_id, 'param', p from (select *, unnest(['id', 'tab']) as p from {MANIFESTS}) where json_type(j, '$.seedRequirements') is not null and json_type(j, '$.routeParamValues.' || p) is null
union all select manifest_id, 'seed', 'seedCommand' from {MANIFESTS} where json_extract_string(j, '$.seedRequirements.seedStatus') = 'needs-command' and coalesce(json_extract_string(j, '$.executionConfig.seedCommand'), '') = ''""")
def supply(t):
    return ck.declared_supply(t.manifest_texts)


@query("M3_unmet_guards", "subject:s name:s", """
select distinct w.subject, g as name from (select subject, unnest(guards) as g from v_workflow) w where not contains(lower(g), 'noauth') and not contains(lower(g), 'unauth')
  and not exists (select 1 from v_account a where a.subject = w.subject and list_contains(a.guards, w.g))""")
def unmet(t):
    return ck.unmet_guards(flow(t).workflows_with("subject", "guards"), t.accounts)


@query("M4_unbound_params", "subject:s name:s", """
select distinct w.subject, p as name from (select subject, unnest(params) as p from v_workflow) w where not exists (select 1 from v_param_value v where v.subject = w.subject and v.param = w.p)""")
def unbound(t):
    return ck.unbound_params(flow(t).workflows_with("subject", "params"), t.param_values)


@query("M5_unknown_workflows", "subject:s workflow_id:s", """
select distinct subject, workflow_id from v_form_override o where not exists (select 1 from v_workflow w where w.subject = o.subject and w.workflow_id = o.workflow_id)""")
def unknown(t):
    return ck.unknown_workflows(t.form_overrides, flow(t).workflows_with("subject", "workflow_id"))


SUPPLY = f"""select manifest_id, 'guard' as warning, 'AuthGuard' as name from {MANIFESTS} where contains(json_extract_string(j, '$.seedRequirements.authGuards') || '', 'AuthGuard')
  and not coalesce(json_type(j, '$.accounts') = 'ARRAY' and contains(json_extract_string(j, '$.accounts[0].guardSatisfies') || '', 'AuthGuard'), false)
union all select manifest_id, 'param', p from (select *, unnest(['id', 'tab']) as p from {MANIFESTS}) where json_type(j, '$.seedRequirements') is not null and json_type(j, '$.routeParamValues.' || p) is null
union all select manifest_id, 'seed', 'seedCommand' from {MANIFESTS} where json_extract_string(j, '$.seedRequirements.seedStatus') = 'needs-command' and coalesce(json_extract_string(j, '$.executionConfig.seedCommand'), '') = ''"""
CROSS = f"""
with facts as (select manifest_id, subject, case when json_type(j, '$.accounts') = 'ARRAY' then json_extract_string(j, '$.accounts[0].guardSatisfies') end as held, json_type(j, '$.authSetup') is null as no_login, j
  from {MANIFESTS} where j is not null and manifest_id in (select o_custkey from orders)),
guard as (select distinct subject, unnest(guards) as name from v_route), param as (select distinct subject, unnest(params) as name from v_route)
select manifest_id, 'guard:' || g.name as field from facts join guard g using (subject) where held is not null and not contains(lower(g.name), 'noauth') and not contains(lower(g.name), 'unauth') and not contains(held, '"' || g.name || '"')
union all select manifest_id, 'param:' || p.name from facts join param p using (subject) where json_type(j, '$.routeParamValues') = 'OBJECT' and json_type(j, '$.routeParamValues.' || p.name) is null
union all select manifest_id, 'authSetup' from facts where held is not null and no_login and subject in (select subject from guard)"""


@query("M6_cross_check", "manifest_id:i field:s", CROSS)
def crossed(t):
    return cross_checks(t).select("manifest_id", "field")


def cross_checks(t):
    """Checked are manifests whose application has been analysed: those of customers with orders."""
    m = t.manifest_texts.join(analysed(t), "manifest_id", "left_semi")
    asked = [t.routes.select("subject", F.lit("guard").alias("what"), F.explode("guards").alias("name")),
             t.routes.select("subject", F.lit("param").alias("what"), F.explode(template_params("full_path")).alias("name"))]
    return ck.cross_check(m, asked[0].unionByName(asked[1]))


def analysed(t):
    return t("orders").select(F.col("o_custkey").alias("manifest_id")).distinct()


@query("M6_manifest_status", "manifest_id:i status:s errors:i warnings:i", f"""
select m.manifest_id, case when j is null then 'LOAD_ERROR' when m.manifest_id not in (select o_custkey from orders) then 'MISSING_A2' when coalesce(i.n, 0) > 0 then 'INVALID' else 'VALID' end as status, coalesce(i.n, 0) as errors,
  coalesce(s.n, 0) + coalesce(c.n, 0) as warnings
from {MANIFESTS} m left join (select manifest_id, count(*) as n from {ISSUES} group by all) i on i.manifest_id = m.manifest_id
left join (select manifest_id, count(*) as n from ({SUPPLY}) group by all) s on s.manifest_id = m.manifest_id left join (select manifest_id, count(*) as n from ({CROSS}) group by all) c on c.manifest_id = m.manifest_id""")
def status(t):
    m = t.manifest_texts
    declared = ck.declared_supply(m).select("manifest_id", F.lit("warning").alias("severity"), F.concat_ws(":", "warning", "name").alias("field"))
    issues = ck.manifest_issues(m).unionByName(declared).unionByName(cross_checks(t))
    return ck.manifest_status(m, issues, analysed(t))


@query("M7_guard_context", "subject:s name:s n_workflows:i", """
select subject, g as name, count(*) as n_workflows from (select subject, unnest(guards) as g from v_workflow where verdict <> 'PRUNED') group by all""")
def guard_context(t):
    return ck.requirement_context(flow(t).workflows_with("subject", "verdict", "guards"), "guards")


@query("M7_param_context", "subject:s name:s place:s full_path:s", """
select distinct w.subject, w.name, 'start' as place, r.full_path from (select subject, comp_id, unnest(params) as name from v_workflow where verdict <> 'PRUNED') w
  join v_active a on a.subject = w.subject and a.comp_id = w.comp_id join v_route r on r.subject = a.subject and r.route_id = a.start_route where contains(r.full_path, ':' || w.name)
union select distinct w.subject, w.name, 'terminal', r.full_path from (select subject, terminal_id, unnest(params) as name from v_workflow where verdict <> 'PRUNED') w
  join v_route r on r.subject = w.subject and r.route_id = w.terminal_id where contains(r.full_path, ':' || w.name)""")
def param_context(t):
    f = flow(t)
    starts = intents(t).start_records.select("subject", "comp_id", "start_route")
    return ck.requirement_templates(f.workflows_with("subject", "comp_id", "terminal_id", "verdict", "params"), starts, t.routes, "params", True)


@query("M7_first_workflows", "subject:s name:s nth:i workflow_id:s trigger_kind:s", """
select * from (select subject, g as name, workflow_id, trigger_kind, row_number() over (partition by subject, g order by workflow_id) as nth
from (select *, unnest(guards) as g from v_workflow where verdict <> 'PRUNED')) where nth <= 10""")
def first_workflows(t):
    return ck.first_workflows(flow(t).workflows_with("subject", "workflow_id", "verdict", "trigger_kind", "guards"), "guards")


@query("M8_login_forms", "subject:s login_route:s route_confidence:s password_field:s username_field:s username_confidence:s submit_button:s", """
with m as (select e.subject, e.from_id as route_id, w.widget_id, coalesce(w.a_type, '') as t, coalesce(w.form_control_name, '') as fcn, coalesce(w.a_name, '') as nm, w.tag_name,
    regexp_matches(lower(coalesce(w.form_control_name, '')), 'email|username|login|user|emailid') as word
  from v_edge e join v_widget w on w.comp_id = e.to_id where e.kind = 'ROUTE_ACTIVATES_COMPONENT'),
x as (select *, t = 'password' or fcn = 'password' as pw, t = 'email' or word or (tag_name = 'input' and t not in ('password', 'checkbox', 'submit', 'radio')) as un,
  case when tag_name = 'input' and t not in ('password', 'checkbox', 'submit') and word then 1 when tag_name = 'input' and t in ('email', 'text') then 2 when tag_name = 'input' and t not in ('password', 'checkbox', 'submit') then 3 end as tier from m),
g as (select x.subject, x.route_id, r.full_path, len(list_filter(r.guards, lambda g: contains(lower(g), 'noauth'))) > 0 as open, bool_or(pw) as hp, bool_or(un) as hu, bool_or(tag_name = 'button' and t = 'submit') as hs,
  arg_min(fcn, widget_id) filter (pw) as pf, arg_min(fcn, (tier, widget_id)) filter (tier is not null) as uf, arg_min(nm, (tier, widget_id)) filter (tier is not null) as un_, arg_min(t, (tier, widget_id)) filter (tier is not null) as ut
  from x join v_route r on r.subject = x.subject and r.route_id = x.route_id group by all)
select subject, full_path as login_route, case when contains(full_path, 'login') then 'HIGH' else 'MEDIUM' end as route_confidence, case when pf <> '' then 'input[formcontrolname=''' || pf || ''']' else 'input[type=''password'']' end as password_field,
  case when uf <> '' then 'input[formcontrolname=''' || uf || ''']' when un_ <> '' then 'input[name=''' || un_ || ''']' when ut = 'email' then 'input[type=''email'']' else '' end as username_field,
  case when uf <> '' or un_ <> '' then 'HIGH' when ut = 'email' then 'MEDIUM' else 'UNRESOLVED' end as username_confidence, case when hs then 'button[type=''submit'']' else '' end as submit_button
from g where hp and hu qualify row_number() over (partition by subject order by not open, not contains(lower(full_path), 'login'), full_path) = 1""")
def login_forms(t):
    return ck.login_forms(t.routes, flow(t).activates, t.widgets)


@query("M9_param_families", "subject:s name:s family:s n_templates:i representative:s is_multi_family:i", """
select subject, name, family, n_templates, representative, count(*) over (partition by subject, name) > 1 as is_multi_family from (
  select subject, name, case when string_split(full_path, '/')[2] = ':' || name then ':' || name else list_extract(string_split(full_path, '/'), cast(list_position(string_split(full_path, '/'), ':' || name) as int) - 1) end as family,
    count(*) as n_templates, arg_min(full_path, (length(full_path), full_path)) as representative
  from (select distinct subject, full_path, unnest(params) as name from v_route) group by all)""")
def param_families(t):
    rows = t.routes.select("subject", "full_path", F.explode(F.array_distinct(template_params("full_path"))).alias("name"))
    return ck.param_families(rows)


@query("M10_skeleton", "subject:s item:s name:s", """
select distinct subject, 'account' as item, unnest(guards) as name from v_workflow union all select distinct subject, 'param', unnest(params) from v_workflow
union all select distinct subject, 'auth_setup', '/login' from v_workflow where len(list_filter(guards, lambda g: not contains(lower(g), 'noauth'))) > 0""")
def skeleton(t):
    return ck.manifest_skeleton(flow(t).workflows_with("subject", "guards", "params"))


@query("M10_skeleton_stats", "subject:s guards:i params:i auth_required:i", """
select subject, len(list_distinct(flatten(list(guards)))) as guards, len(list_distinct(flatten(list(params)))) as params, bool_or(len(list_filter(guards, lambda g: not contains(lower(g), 'noauth'))) > 0) as auth_required from v_workflow group by all""")
def skeleton_stats(t):
    return ck.skeleton_stats(ck.manifest_skeleton(flow(t).workflows_with("subject", "guards", "params")))


@query("M11_seed_requirements", "subject:s auth_guards:s negative_guards:s route_params:s has_form_workflows:i", """
select subject, (select string_agg(distinct g, ',' order by g) from (select unnest(guards) as g, subject as s, verdict as v from v_workflow) where s = w.subject and v <> 'PRUNED' and not contains(lower(g), 'noauth')) as auth_guards,
  (select string_agg(distinct g, ',' order by g) from (select unnest(guards) as g, subject as s, verdict as v from v_workflow) where s = w.subject and v <> 'PRUNED' and contains(lower(g), 'noauth')) as negative_guards,
  (select string_agg(distinct g, ',' order by g) from (select unnest(params) as g, subject as s, verdict as v from v_workflow) where s = w.subject and v <> 'PRUNED') as route_params,
  bool_or(trigger_kind = 'WIDGET_SUBMITS_FORM') as has_form_workflows from v_workflow w group by subject""")
def seed(t):
    return ck.seed_requirements(flow(t).workflows_with("subject", "verdict", "trigger_kind", "guards", "params")).select("subject", text_of("auth_guards"), text_of("negative_guards"), text_of("route_params"), "has_form_workflows")

