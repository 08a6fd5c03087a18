"""X queries: markup, handlers, routes and modules."""

from pyspark.sql import functions as F

from loomgraph.catalog.oracle_views import CSS
from loomgraph.catalog.registry import query

from loomgraph.functions import fixed
from loomgraph.functions.scale import cut_lineage
from loomgraph.operators import extract as ex
from loomgraph.operators import handlers as hd
from loomgraph.operators import resolve
from loomgraph.operators import routes as rt
from loomgraph.sources import fixture as fx


def n():
    return F.count(F.lit(1)).alias("n")


@query("X1_page_tokens", "page_id:i pos:i token:s name:s start:i stop:i", "select page_id, pos, token, case when token in ('open', 'close', 'single') then nm else '' end as name, start, stop from v_ptok")
def page_tokens(t):
    return ex.tokens(t("pages"))


@query("X1_template_tokens", "token:s name:s n:i last_stop:i", """
select token, case when token in ('open', 'close', 'single') then nm else '' end as name, count(*) as n, max(stop) as last_stop from v_ttok group by all""")
def template_tokens(t):
    return ex.tokens(t.templates).groupBy("token", "name").agg(n(), F.max("stop").alias("last_stop"))


@query("X2_page_widget_kinds", "page_id:i pos:i name:s kind:s", "select * from v_pwid")
def page_kinds(t):
    return ex.widgets(t("pages"))


@query("X2_widget_kinds", "name:s kind:s n:i", "select name, kind, count(*) as n from v_twid group by all")
def kinds(t):
    return ex.widgets(t.templates).groupBy("name", "kind").agg(n())


@query("X3_kept_attributes", "page_id:i pos:i attribute:s value:s", f"""
select w.page_id, w.pos, a.attr as attribute, a.value[1:200] as value from v_twid w join (select page_id, pos, attr, trim(arg_max(value, i)) as value from v_tattr
  where binding in ('attr', 'boundAttr') and attr in ({', '.join(f"'{x}'" for x in fixed.KEPT_ATTRIBUTES)}) and trim(value) <> '' group by all) a on a.page_id = w.page_id and a.pos = w.pos""")
def kept(t):
    return ex.widgets(t.templates).select("page_id", "pos", F.explode_outer("attributes").alias("attribute", "value")).where("attribute is not null")


@query("X4_page_labels", "page_id:i widget_id:s label:s", """
select w.page_id, w.widget_id, regexp_replace(t.tok, '^\\s+|\\s+$', '', 'g')[1:200] as label from v_pwid w join v_ptok t on t.page_id = w.page_id and t.pos = w.pos + 1 and t.token = 'text' where trim(t.tok) <> ''""")
def page_labels(t):
    return ex.labels(t("pages"))


@query("X4_labels", "page_id:i widget_id:s label:s", """
select w.page_id, w.widget_id, regexp_replace(t.tok, '^\\s+|\\s+$', '', 'g')[1:200] as label from v_twid w join v_ttok t on t.page_id = w.page_id and t.pos = w.pos + 1 and t.token = 'text'
where w.token = 'open' and trim(t.tok, ' ') <> '' and w.name <> 'form'""")
def labels(t):
    return ex.labels(t.templates)


@query("X5_widget_ids", "page_id:i pos:i idx:i line:i col:i widget_id:s", "select * from v_twid")
def widget_ids(t):
    return ex.widgets(t.templates)


@query("X6_parent_widgets", "page_id:i widget_id:s parent_id:s", """
select w.page_id, w.widget_id, arg_max(p.widget_id, p.pos) as parent_id from v_twid w left join (select x.*, r.close_pos from v_twid x join v_tregion r on r.page_id = x.page_id and r.pos = x.pos) p
  on p.page_id = w.page_id and p.pos < w.pos and w.pos < p.close_pos group by all""")
def parents(t):
    return ex.parents(t.templates)


BINDING_SQL = """select w.page_id, w.widget_id, a.binding, a.attr as name, trim(a.value)[1:200] as value from v_{x}wid w join v_{x}attr a on a.page_id = w.page_id and a.pos = w.pos
where a.binding = 'event' or (a.binding in ('attr', 'boundAttr') and a.attr in ('routerlink', 'href', 'formcontrolname', 'formgroupname', 'ngmodel'))"""


@query("X7_page_bindings", "page_id:i widget_id:s binding:s name:s value:s", BINDING_SQL.format(x="p"))
def page_bindings(t):
    return ex.bindings(t("pages"))


@query("X7_bindings", "page_id:i widget_id:s binding:s name:s value:s", BINDING_SQL.format(x="t"))
def bindings(t):
    return ex.bindings(t.templates)


@query("X8_validators", "page_id:i pos:i required:i min_length:i max_length:i pattern:s", """
select w.page_id, w.pos, bool_or(coalesce(attr = 'required' and binding = 'attr', false)) as required, max(case when attr = 'minlength' then nullif(cast(value as int), 0) end) as min_length,
  max(case when attr = 'maxlength' then nullif(cast(value as int), 0) end) as max_length, max(case when attr = 'pattern' then value end) as pattern
from v_twid w left join v_tattr a on a.page_id = w.page_id and a.pos = w.pos where w.kind in ('Input', 'Textarea') group by all""")
def validators(t):
    return ex.widgets(t.templates).where("kind in ('Input', 'Textarea')").withColumn("v", ex.validators()).select("page_id", "pos", "v.*")


@query("X9_repeaters", "page_id:i widget_id:s repeater:s ordinal:i", """
select page_id, widget_id, repeater, row_number() over (partition by page_id, case when kind = 'Unknown' then name else kind end, repeater order by pos) - 1 as ordinal from (
  select w.page_id, w.pos, w.kind, w.name, w.widget_id, arg_max(r.expr, r.pos) as repeater from v_twid w join (
    select g.*, a.value as expr from v_tregion g join v_tattr a on a.page_id = g.page_id and a.pos = g.pos and a.binding = 'structural' and a.attr = 'ngfor') r
    on r.page_id = w.page_id and r.pos <= w.pos and w.pos < r.close_pos group by all)""")
def repeaters(t):
    return ex.repeaters(t.templates)


@query("X10_attached_predicates", "page_id:i widget_id:s pred_pos:i predicate:s rules:s expr:s", "select * from v_tattach")
def attached(t):
    return ex.attach_predicates(t.templates)


@query("X11_references", "expr:s refs:s n:i", """
select expr, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(expr, '\\b([A-Za-z_$][A-Za-z0-9_$.]*)\\b', 1),
  lambda x: x not in ('true', 'false', 'null', 'undefined', 'typeof', 'instanceof', 'let', 'const', 'var', 'if', 'else', 'return', 'of', 'as')))), ',') as refs, count(*) as n from v_tpred group by expr""")
def refs(t):
    return (ex.predicates(t.templates).groupBy("expr").agg(n()).withColumn("refs", F.array_join(ex.references("expr"), ",")))


@query("X12_custom_elements", "name:s n_pages:i", f"""
select name, count(distinct page_id) as n_pages from v_ttag where name not in ({', '.join(f"'{x}'" for x in fixed.HTML_ELEMENTS)}) group by all""")
def custom(t):
    return ex.custom_elements(t.templates).groupBy("name").agg(F.count(F.lit(1)).alias("n_pages"))


@query("X13_composition_context", "page_id:i name:s inside_template:i inside_ng_if:s inside_ng_for:s", f"""
select page_id, name, arg_max(tm, pos) as inside_template, arg_max(coalesce(f, ''), pos) as inside_ng_if, arg_max(coalesce(r, ''), pos) as inside_ng_for from (
  select c.page_id, c.pos, c.name, (select max(true) from v_tregion g where g.page_id = c.page_id and g.name = 'ng-template' and g.pos < c.pos and c.pos < g.close_pos) as tm,
    (select arg_max(a.value, g.pos) from v_tregion g join v_tattr a on a.page_id = g.page_id and a.pos = g.pos and a.binding = 'structural' and a.attr = 'ngif' where g.page_id = c.page_id and g.pos <= c.pos and c.pos < g.close_pos) as f,
    (select arg_max(a.value, g.pos) from v_tregion g join v_tattr a on a.page_id = g.page_id and a.pos = g.pos and a.binding = 'structural' and a.attr = 'ngfor' where g.page_id = c.page_id and g.pos <= c.pos and c.pos < g.close_pos) as r
  from v_ttag c where c.name not in ({', '.join(f"'{x}'" for x in fixed.HTML_ELEMENTS)})) where tm or f is not null or r is not null group by all""")
def context(t):
    return ex.composition_context(t.templates)


@query("X14_line_and_column", "doc_id:i line:i col:i", """
select doc_id, length(h) - length(replace(h, chr(10), '')) + 1 as line, length(regexp_extract(h, '[^\\n]*$')) + 1 as col from (select doc_id, text[1:length(text) // 2] as h from documents)""")
def line_col(t):
    d = t("documents").withColumn("half", F.floor(F.length("text") / 2))
    return d.select("doc_id", ex.line_and_column("text", "half").alias("x")).select("doc_id", "x.*")


@query("X15_ui_properties", "page_id:i widget_id:s never_visible:i visible_expr:s never_enabled:i enabled_expr:s css_hidden:i", f"""
select w.page_id, w.widget_id, coalesce(p.never, false) or coalesce(a.hid, false) as never_visible, p.visible_expr, coalesce(p.off, false) or coalesce(a.dis, false) as never_enabled, p.enabled_expr,
  coalesce(regexp_matches(a.cls, {CSS}), false) as css_hidden from v_twid w
left join (select page_id, widget_id, bool_or((predicate = 'ngIf' and trim(expr) = 'false') or (predicate = 'hidden' and trim(expr) = 'true')) as never,
  arg_min(expr, pred_pos) filter (rules = 'visible' and trim(expr) <> '' and not (predicate in ('ngIf', 'hidden') and trim(expr) in ('true', 'false'))) as visible_expr,
  bool_or(predicate = 'disabled' and trim(expr) = 'true') as off, arg_min(expr, pred_pos) filter (rules = 'enabled' and trim(expr) <> '' and trim(expr) not in ('true', 'false')) as enabled_expr
  from v_tattach group by all) p on p.page_id = w.page_id and p.widget_id = w.widget_id
left join (select page_id, pos, bool_or(attr = 'hidden' and binding = 'attr' and value in ('', 'true', 'hidden')) as hid, bool_or(attr = 'disabled' and binding = 'attr') as dis,
  max(case when attr = 'class' and binding in ('attr', 'boundAttr') then value end) as cls from v_tattr group by all) a on a.page_id = w.page_id and a.pos = w.pos""")
def ui(t):
    return ex.ui_properties(t.templates)


@query("X16_event_and_handler", "name:s event_type:s handler:s n:i", """
select name, case name when 'click' then 'click' when 'ngsubmit' then 'submit' else 'unknown' end as event_type,
  nullif(regexp_extract(trim(value), '^(?:this\\.)?([A-Za-z_$][A-Za-z0-9_$]*)\\s*\\(', 1), '') as handler, count(*) as n
from (select a.attr as name, a.value from v_twid w join v_tattr a on a.page_id = w.page_id and a.pos = w.pos where a.binding = 'event') group by all""")
def events(t):
    e = ex.bindings(t.templates).where("binding = 'event'")
    return e.groupBy("name", hd.event_type("name").alias("event_type"), hd.handler_name("value").alias("handler")).agg(n())


@query("X17_user_events", "page_id:i widget_id:s name:s value:s", f"""
select page_id, widget_id, name, value from ({BINDING_SQL.format(x='t')}) where name not in ('routerlink', 'href') and not (binding = 'event' and name in ('ngmodelchange', 'valuechange'))""")
def user_events(t):
    return hd.user_events(ex.bindings(t.templates))


@query("X18_call_contexts", "subject:s comp_id:s handler:s ord:i shape:s target:s call_ordinal:i", "select * from v_context")
def contexts(t):
    return hd.call_contexts(t.calls)


@query("X19_flat_routes", "subject:s id:s parent:s full_path:s redirect_path:s params:s route_type:s", """
select subject, id, parent, full_path, case when redirect is not null then '/' || regexp_replace(redirect, '/+$', '') end as redirect_path,
  array_to_string(list_sort(list_transform(list_filter(string_split(full_path, '/'), lambda x: starts_with(x, ':')), lambda x: x[2:])), ',') as params,
  case when redirect is not null then 'RedirectRoute' when segment = '**' then 'WildcardRoute' else 'ComponentRoute' end as route_type from v_page_flat""")
def flat_routes(t):
    return rt.flatten_routes(t.page_records).withColumn("params", F.array_join("params", ",")).withColumn("redirect_path", F.regexp_replace("redirect_path", "/+$", ""))


SCORE = ("case when route_type = 'ComponentRoute' then case when comp_id is null or comp_id = '__unknown__' then 1 when starts_with(comp_id, '__unresolved__') then 2 else 3 end "
         "when route_type = 'WildcardRoute' and comp_id is not null then 3 else 0 end")


@query("X20_canonical_routes", "subject:s full_path:s id:s comp_id:s route_type:s redirect:s guards:s n_members:i n_children:i", f"""
select subject, full_path, arg_min(id, (-s, id, page_id)) as id, arg_min(coalesce(comp_id, ''), (-s, id, page_id)) as comp_id, arg_min(route_type, (-s, id, page_id)) as route_type, arg_min(redirect, (-s, id, page_id)) filter (redirect is not null) as redirect,
  array_to_string(list_sort(list_distinct(flatten(list(guards)))), ',') as guards, count(*) as n_members, count(distinct child) as n_children from (select *, {SCORE} as s from v_page_candidate) group by all""")
def canonical(t):
    return rt.canonical_routes(t.page_candidates).withColumn("guards", F.array_join("guards", ","))


@query("X21_mount_guards", "subject:s full_path:s guards:s", """
select c.subject, c.full_path || '/' || c.child as full_path, array_to_string(list_sort(list_distinct(list_concat(case when c.child like '%1' then ['ChildGuard'] else [] end, coalesce(m.guards, [])))), ',') as guards
from (select distinct subject, full_path, child from v_page_candidate) c left join (select subject, full_path, list_distinct(flatten(list(guards))) as guards from v_page_candidate group by all) m
  on m.subject = c.subject and m.full_path = c.full_path""")
def mount_guards(t):
    mounts = rt.canonical_routes(t.page_candidates).select("subject", F.col("full_path").alias("mount"), "guards")
    kids = t.page_candidates.select("subject", F.col("full_path").alias("mount"), "child").distinct().select(
        "subject", "mount", F.concat_ws("/", "mount", "child").alias("full_path"),
        F.when(F.col("child").endswith("1"), F.array(F.lit("ChildGuard"))).otherwise(F.array().cast("array<string>")).alias("guards"))
    return rt.inherit_mount_guards(kids, mounts).withColumn("guards", F.array_join("guards", ","))


@query("X22_component_usage", "subject:s comp_id:s n_routes:i first_path:s last_path:s", """
select subject, comp_id, count(*) as n_routes, min(full_path) as first_path, max(full_path) as last_path from v_route where route_type = 'ComponentRoute' group by all""")
def usage(t):
    return rt.component_usage(t.routes)


@query("X23_module_roles", "subject:s module_id:s name:s role:s", """
select m.subject, m.module_id, m.name, case when lower(m.name) in ('appmodule', 'approotmodule') then 'Root' when lower(m.name) in ('sharedmodule', 'coremodule', 'commonmodule', 'globalmodule') then 'GlobalShared'
  when g = 4 then 'LazyFeature' when not exists (select 1 from v_module_link l where l.subject = m.subject and l.link = 'import' and l.name = m.name) and exists (select 1 from v_declaration d where d.module_id = m.module_id) then 'DeadOrUnreachable'
  when exists (select 1 from v_declaration d where d.module_id = m.module_id) then 'Feature' else 'Unknown' end as role from v_module m""")
def roles(t):
    return rt.module_roles(t.modules, t.module_links, t.declarations, t.modules.where("g = 4"))


def _has(words):
    return "(" + " or ".join(f"contains(b, '{w}')" for w in words) + ")"


LITERALS = """list_transform(regexp_extract_all(b, '''[^'']*''|"[^"]*"'), lambda s: s[2:-2])"""
CUT = f"list_transform({LITERALS}, lambda s: case when length(s) > 200 then s[1:199] || '…' else s end)"
SUMMARY = f"""
select doc_id, source, {_has(fixed.AUTH_WORDS)} as auth_required,
  case when {_has(fixed.ROLE_WORDS)} then list_sort(list_distinct(list_filter({CUT}, lambda s: regexp_matches(s, '^[A-Za-z][A-Za-z0-9_-]*$')))) else [] end as roles,
  case when {_has(fixed.FEATURE_WORDS)} then list_sort(list_distinct(list_filter({CUT}, lambda s: s <> ''))) else [] end as flags,
  list_sort(list_distinct(list_filter([{', '.join(f"case when contains(b, '{w}') then '{s}' end" for w, s in fixed.ENTITY_WORDS.items())}], lambda s: s is not null))) as states
from (select doc_id, source, text || ' ' || {fx.GUARD_CODE} as b from documents)"""


def summaries(t):
    return rt.guard_summary(t("documents").selectExpr("doc_id", "source", f"text || ' ' || {fx.GUARD_CODE} as body"))


@query("X24_guard_summaries", "doc_id:i auth_required:i roles:s flags:s states:s", f"""
select doc_id, auth_required, array_to_string(roles, '|') as roles, array_to_string(flags, '|') as flags, array_to_string(states, '|') as states from ({SUMMARY})""")
def guard_summaries(t):
    return summaries(t).select("doc_id", "auth_required", *[F.array_join(c, "|").alias(c) for c in ("roles", "flags", "states")])


@query("X24_merged_summaries", "source:s auth_required:i roles:s flags:s states:s", f"""
select source, bool_or(auth_required) as auth_required, array_to_string(list_sort(list_distinct(flatten(list(roles)))), '|') as roles, array_to_string(list_sort(list_distinct(flatten(list(flags)))), '|') as flags,
  array_to_string(list_sort(list_distinct(flatten(list(states)))), '|') as states from ({SUMMARY}) group by source""")
def merged(t):
    return rt.merge_summaries(summaries(t), "source").select("source", "auth_required", *[F.array_join(c, "|").alias(c) for c in ("roles", "flags", "states")])


# ---- flagship: what the links of a page corpus lead to -----------------------------------------

PAGE_ROUTE = """
(select distinct subject, '/' as full_path, '/@' || subject as route_id from v_page_place where seg1 <> '' union select distinct subject, '/' || seg1, '/' || seg1 || '@' || subject from v_page_place where seg1 <> ''
union select distinct subject, '/' || seg1 || '/:id', '/' || seg1 || '/:id@' || subject from v_page_place where seg1 <> '')"""
PAGE_LINK = f"""
select l.subject, l.host, case when l.external then 'external' when r.full_path like '%:%' then 'parameterised' when r.full_path is not null then 'resolved' else 'unresolved' end as outcome
from (select p.subject, p.host, a.value, false as external from v_page_place p join v_pattr a on a.page_id = p.page_id join v_pwid w on w.page_id = a.page_id and w.pos = a.pos where a.attr = 'href' and not regexp_matches(a.value, '^(https?:)?//')
  union all select subject, host, url, true from v_page_place) l
left join {PAGE_ROUTE} r on not l.external and r.subject = l.subject and regexp_matches(case when starts_with(l.value, '/') then l.value else '/' || l.value end, '^' || regexp_replace(r.full_path, ':id', '[^/:{{}}]+') || '$') and r.full_path not like '%:%'"""


def page_verdicts(t):
    """Per host: how many links lead to a known route, need a parameter, leave the site or lead nowhere."""
    flat = rt.flatten_routes(t.page_records.where("id not in ('any', 'home')"))
    routes = flat.select("subject", "full_path", F.concat_ws("@", "full_path", "subject").alias("route_id"), F.col("id").alias("comp_id"), "route_type", "params")
    places = t.page_places.select("page_id", "subject", "host", F.col("seg1").alias("comp_id"))
    # several branches read the links: written once, the pages are taken apart once
    links = cut_lineage(ex.bindings(t("pages")).where("name = 'href'").join(places, "page_id").select("subject", "host", "comp_id", "value"))
    inner = links.where(~resolve.is_external("value"))
    found = inner.join(resolve.resolve_links(inner, routes), ["subject", "comp_id", "value"], "left").join(
        routes.select("subject", F.col("route_id").alias("target_route_id"), F.size("params").alias("n_params")), ["subject", "target_route_id"], "left")
    outcome = F.when(F.col("target_route_id").isNull(), "unresolved").when(F.col("n_params") > 0, "parameterised").otherwise("resolved")
    outer = t.page_places.select("subject", "host", F.lit("external").alias("outcome"))
    rows = found.select("subject", "host", outcome.alias("outcome")).unionByName(outer)
    verdict = F.when(F.col("outcome").isin("external", "resolved"), "FEASIBLE").otherwise("CONDITIONAL")
    return rows.groupBy("subject", "host", "outcome").agg(n()).withColumn("verdict", verdict)


@query("flagship_page_verdicts", "subject:s host:s outcome:s verdict:s n:i", f"""
select subject, host, outcome, case when outcome in ('external', 'resolved') then 'FEASIBLE' else 'CONDITIONAL' end as verdict, count(*) as n from ({PAGE_LINK}) group by all""")
def flagship(t):
    return page_verdicts(t)



