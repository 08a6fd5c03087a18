"""Views the check SQL is written over, in DuckDB's dialect, in definition order.

The registry views describe the same input rows as the Spark views. Everything behind
them is written a second time and in another way: plain windows, recursive queries and
theta joins, with no regard to size.
"""

from loomgraph.functions import fixed
from loomgraph.sources import fixture as fx

VIEWS: dict[str, str] = {}


def cols(table: dict, *names: str) -> str:
    return ", ".join(f"{table[c]} as {c}" for c in (names or table))


def strings(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


MANIFESTS = (f"(select c_custkey as manifest_id, 'app' || {fx.APP_OF_CUSTOMER} as subject, {fx.MANIFEST_FOLDER} as folder, "
             f"case when json_valid({fx.MANIFEST}) then json({fx.MANIFEST}) end as j from customer)")

# ---- registries --------------------------------------------------------------------------

VIEWS["v_supp"] = (f"select s_suppkey as k, {fx.APP_OF_SUPPLIER} as app, s_suppkey % 20 + 1 as r, s_nationkey as n, "
                   "s_nationkey % 5 as g from supplier")
VIEWS["v_component"] = f"select *, {cols(fx.COMPONENT)} from v_supp"
VIEWS["v_use"] = " union all ".join(
    f"select *, {cols(fx.USE_CONTEXT)} from (select subject, comp_id, k, r, k * 8 + {p} as seq, {p} as pos, {ref} as used_ref "
    f"from v_component where {cond})" for p, cond, ref in fx.USES)
VIEWS["v_service"] = (f"select 'app' || app as subject, j, {cols(fx.SERVICE)} "
                      "from (select distinct app, k % 10 as j from v_supp) where j <> 9")
VIEWS["v_nation"] = (
    "select *, min(n) over (partition by app, g) as root_n, "
    "coalesce(lead(n) over (partition by app, g order by n), min(n) over (partition by app, g)) as next_n "
    f"from (select distinct {fx.APP_OF_CUSTOMER} as app, c_nationkey as n, c_nationkey % 5 as g from customer)")
VIEWS["v_route"] = f"""
select subject, app, n, g, module_id, full_path, path, parent_path, redirect_to, full_path || '@' || module_id as route_id,
  parent_path || '@' || module_id as parent_id, coalesce(comp, '__unknown__') as comp_id,
  case when path = '**' then 'WildcardRoute' when redirect_to is not null and comp is null then 'RedirectRoute' else 'ComponentRoute' end as route_type,
  list_filter([guard_1, guard_2], lambda x: x is not null) as guards, list_filter([role], lambda x: x is not null) as roles,
  list_sort(list_distinct(list_transform(list_filter(string_split(full_path, '/'), lambda x: starts_with(x, ':')), lambda x: x[2:]))) as params
from (select *, 'app' || app as subject, {fx.MODULE_ID} as module_id, {fx.PARENT_PATH} as parent_path, {cols(fx.ROUTE)}
  from v_nation left join (select app, n, {fx.COMPONENT['comp_id']} as comp from (select app, n, min(k) as k from v_supp where k % 2 = 0 and r > 1 group by app, n)) using (app, n))"""
VIEWS["v_module"] = (f"select distinct 'app' || app as subject, app, g, {fx.MODULE_ID} as module_id, {fx.MODULE_NAME} as name from v_nation")
VIEWS["v_declaration"] = (
    "select m.subject, m.module_id, c.class_name from v_module m join v_component c using (app, g) "
    "union all select subject, module_id, 'GhostComponent' from v_module where g = 1")
VIEWS["v_module_link"] = (
    "select m.subject, m.module_id, x.link, x.seq, x.name from v_module m join (values (0,'import',1,'R1Module'),(0,'import',2,'R2Module'),"
    "(1,'import',1,'R2Module'),(1,'import',2,'R2Module'),(2,'export',1,'R3Module'),(3,'export',1,'MissingModule')) x(g,link,seq,name) on m.g = x.g")
VIEWS["v_provider"] = ("select subject, module_id, 'Svc' || g || 'Service' as provider from v_module union all "
                       "select subject, module_id, 'Svc' || (g + 5) || 'Service' from v_module")
_w = ", ".join(f"{fx.COMPONENT[c]} as {c}" for c in ("subject", "comp_id", "selector"))
VIEWS["v_wbase"] = f"""
select *, {fx.WIDGET_KIND} as kind, {fx.WIDGET_TAG} as tag_name, {fx.WIDGET_ID} as widget_id, {_w} from (
  select distinct l_suppkey as k, l_partkey as p, p_size as z, {fx.APP_OF_LINE} as app, l_partkey - l_partkey % 100 as bucket
  from lineitem join part on l_partkey = p_partkey)"""
VIEWS["v_widget"] = f"""
select w.*, case when kind in {fx.FIELD_KINDS} then f.widget_id when kind = 'Option' then s.widget_id end as parent_id, {cols(fx.WIDGET_ATTRS)}, {cols(fx.WIDGET_UI)}
from v_wbase w
left join (select k, bucket, arg_min(widget_id, p) as widget_id from v_wbase where kind = 'Form' group by all) f on w.k = f.k and w.bucket = f.bucket
left join (select k, bucket, arg_min(widget_id, p) as widget_id from v_wbase where kind = 'Select' group by all) s on w.k = s.k and w.bucket = s.bucket"""
VIEWS["v_line"] = f"""
select *, {fx.WIDGET_ID} as widget_id, {fx.WIDGET_KIND} as kind, {", ".join(f"{fx.COMPONENT[c]} as {c}" for c in ("subject", "comp_id", "file"))}, {cols(fx.LINE)}
from (select *, {fx.APP_OF_LINE} as app, l_suppkey as k, l_partkey as p, p_size as z from lineitem join part on l_partkey = p_partkey)"""
VIEWS["v_binding"] = f"""
select subject, comp_id, widget_id, file, seq, case when l_returnflag = 'R' then 'routerLink' else 'href' end as name,
  case when l_returnflag = 'R' then {fx.LINK_TEXT} else {fx.LINK_URL} end as value
from v_line where l_returnflag = 'R' or (l_returnflag = 'N' and l_linestatus = 'F')"""
VIEWS["v_event"] = """
select subject, comp_id, widget_id, kind, file, seq, handler, case when l_returnflag = 'A' then 'click' else 'submit' end as event_type
from v_line where l_returnflag = 'A' or (l_returnflag = 'N' and l_linestatus = 'O')"""
VIEWS["v_call"] = f"select subject, comp_id, handler, file, seq, k, {fx.CALL_EXPR} as expr, {fx.CALL_ARG} as arg from v_line where {fx.IS_CALL}"
VIEWS["v_template"] = f"""
select l_orderkey as page_id, string_agg(s, chr(10) order by l_linenumber, l_partkey, l_suppkey, s) as html
from (select l_orderkey, l_linenumber, l_partkey, l_suppkey, {fx.SNIPPET} as s from lineitem) group by l_orderkey"""
VIEWS["v_account"] = f"""
select 'app' || {fx.APP_OF_CUSTOMER} as subject, c_custkey as pos, c_name as username, case when c_acctbal < 0 then '' else 'pw' || c_custkey end as password,
  list_concat(case when c_mktsegment in ('MACHINERY', 'BUILDING') then ['AuthGuard'] else [] end, case when c_mktsegment in ('BUILDING', 'FURNITURE') and c_acctbal > 9900 then ['RoleGuard'] else [] end) as guards,
  case when c_mktsegment = 'BUILDING' then ['admin'] else [] end as roles from customer"""
VIEWS["v_param_value"] = ("select subject, full_path as template, 'id' as param, 'v' || n as value from v_route where n % 6 = 3 "
                          "union all select subject, null, 'id', '1' from v_module where g = 0")
VIEWS["v_pipeline_event"] = """
select event_id, ts, case event_type when 'view' then 'A1' when 'click' then 'A2' when 'signup' then 'B1' when 'purchase' then 'B2' else 'B3' end as phase,
  case when event_type = 'error' then 'error' when value < 5 then 'debug' when value > 50 then 'warn' else 'info' end as severity,
  case event_type when 'purchase' then 'PASS' when 'error' then 'FAIL' else '' end as outcome from events"""
VIEWS["v_attempt"] = """
select *, 'u' || (user_id % 10) as subject,
  case event_type when 'purchase' then 'PASS' when 'signup' then 'FAIL_AUTH' when 'error' then 'FAIL_ELEMENT_NOT_FOUND' when 'click' then 'FAIL_TIMEOUT' else 'FAIL_ASSERTION' end as outcome,
  200 + 100 * (k % 4) as status, case k % 3 when 0 then 'GET' when 1 then 'POST' else 'PUT' end as method
from (select event_id, user_id || '/' || cast(ts as date) as test_id, user_id, ts, event_type, cast(round(value * 100) as bigint) as duration_ms,
    cast(json_extract(props, '$.k') as bigint) as k,
    row_number() over (partition by user_id, cast(ts as date) order by ts, event_id) as attempt from events)"""
VIEWS["v_step"] = """
select conv_id || '' as test_id, 'c' || (conv_id % 7) as subject, turn as pos, role, text,
  case when turn = 0 then 'pre-0' when turn % 3 = 2 then 'post-' || turn else 'step-' || turn end as step_id,
  timestamp '2024-01-01 00:00:00' + (conv_id % 1000 + turn * 2) * interval 1 minute as ts_start,
  timestamp '2024-01-01 00:00:00' + (conv_id % 1000 + turn * 2 + turn % 3) * interval 1 minute as ts_end from conversations"""

VIEWS["v_request"] = f"""
select test_id, pos as req, ts_start + (length(text) % 4) * interval 1 minute as ts, case length(text) % 3 when 0 then 'GET' when 1 then 'POST' else 'PUT' end as method,
  {fx.STATUSES}[length(text) % {len(fx.STATUSES)} + 1] as status from v_step"""
VIEWS["v_log"] = """
select test_id, subject, step_id as failed_step_id, case length(text) % 5 when 0 then 'interaction-failed' when 1 then 'locator-not-found' when 2 then 'timeout'
  when 3 then 'assertion-failed' else 'unknown' end as failure_kind
from v_step qualify row_number() over (partition by test_id order by length(text) desc, pos) = 1"""
VIEWS["v_health"] = """
select 'c' || (user_id % 7) as subject, ts, case when event_type = 'error' then case when value < 10 then 'port' else 'identity' end end as problem from events"""
VIEWS["v_test"] = """
select *, case when user_id % 9 = 0 then 'PRUNED' when user_id % 4 = 0 then 'FEASIBLE' else 'CONDITIONAL' end as verdict,
  user_id % 9 <> 0 and user_id % 7 <> 0 as has_plan, user_id % 9 <> 0 and user_id % 7 <> 0 and user_id % 5 <> 0 as has_code, user_id % 20 = 3 as skipped, k % 11 <> 0 as log_exists
from (select test_id, user_id, subject, min(k) as k, min(ts) as first_ts from v_attempt group by all)"""
VIEWS["v_fold"] = """
select test_id, subject, user_id, count(*) as attempts, sum(duration_ms) as duration_ms, arg_max(outcome, attempt) as outcome from (
  select *, min(case when outcome in ('PASS', 'FAIL_APP_NOT_READY') then attempt end) over (partition by test_id) as stop from v_attempt where attempt <= 3)
where stop is null or attempt <= stop group by all"""

# ---- navigation ----------------------------------------------------------------------------

_strip = """regexp_replace({0}, '^[''"]|[''"]$', '', 'g')"""
_inner = "regexp_replace({0}, '^\\[|\\]$', '', 'g')"
_segs = "list_filter(string_split({0}, '/'), lambda x: x <> '')"


def strip(x):
    return _strip.format(x)


def inner(x):
    return _inner.format(x)


def segs(x):
    return _segs.format(x)


def array_parts(x):
    raw = f"list_filter(list_transform(string_split({inner(x)}, ','), lambda p: trim(p)), lambda p: p <> '')"
    return (f"case when starts_with({x}, '[') then flatten(list_transform({raw}, lambda p: case when {strip('p')} in ('', '/') then [] "
            f"""when regexp_matches(p, '^[''"]') then {segs(strip('p'))} else [chr(1)] end)) end""")


def inter_parts(x):
    clean = f"trim({strip(x)})"
    path = f"regexp_replace({clean}, '[?#].*$', '')"
    return (f"case when starts_with({clean}, '/') and contains({clean}, '{{{{') then list_transform({segs(path)}, "
            "lambda s: case when contains(s, '{{') then chr(1) else s end) end")


def exact_link(x):
    raw = f"list_filter(list_transform(string_split({inner(x)}, ','), lambda p: trim(p)), lambda p: p <> '')"
    return (f"case when starts_with({x}, '[') then case when len(list_filter({raw}, lambda p: not regexp_matches(p, '^[''\"]'))) = 0 "
            f"then '/' || regexp_replace(array_to_string(list_filter(list_transform({raw}, lambda p: {strip('p')}), lambda p: p <> ''), '/'), '^/', '') end "
            f"when starts_with({strip(x)}, '/') then {strip(x)} when starts_with({strip(x)}, './') or starts_with({strip(x)}, '../') then null else '/' || {strip(x)} end")


def relative_link(x):
    plain = f"trim({strip(x)})"
    head = f"case when starts_with({plain}, '[') then {strip('trim(string_split(' + inner(plain) + ', chr(44))[1])')} else {plain} end"
    return head


FITS = ("len(list_filter(range(1, len(rs) + 1), lambda i: not (starts_with(rs[i], ':') or rs[i] = ps[i]))) = 0")

VIEWS["v_link"] = "select * from v_binding where lower(name) = 'routerlink'"
VIEWS["v_link_text"] = f"""
select *, case when starts_with(head, '/') or head = '' or contains(head, '{{{{') or starts_with(tail, '../') then null else tail end as rel
from (select *, case when starts_with(head, './') then head[3:] else head end as tail from (
  select distinct subject, comp_id, value, {exact_link('value')} as exact, {array_parts('value')} as arr, {inter_parts('value')} as inter, {relative_link('value')} as head from v_link))"""
VIEWS["v_rseg"] = f"select subject, route_id, full_path, comp_id, route_type, {segs('full_path')} as rs from v_route"
VIEWS["v_rel_base"] = f"""
select *, {segs('resolved')} as ps from (select t.subject, t.comp_id, t.value, case when r.full_path = '/' then '/' || rel else r.full_path || '/' || rel end as resolved
  from v_link_text t join v_route r on t.subject = r.subject and t.comp_id = r.comp_id and r.route_type in ('ComponentRoute', 'WildcardRoute') where rel is not null)"""
VIEWS["v_candidate"] = f"""
select t.subject, t.comp_id, t.value, 1 as stage, 0 as rank, r.full_path, r.route_id from v_link_text t join v_route r on t.subject = r.subject and t.exact = r.full_path
union all select t.subject, t.comp_id, t.value, 2, len(string_split(r.full_path, '/')), r.full_path, r.route_id from v_rel_base t join v_route r on t.subject = r.subject and t.resolved = r.full_path
union all select t.subject, t.comp_id, t.value, 2, len(string_split(r.full_path, '/')), r.full_path, r.route_id from v_rel_base t join v_rseg r on t.subject = r.subject and len(ps) = len(rs)
  where {FITS} and not exists (select 1 from v_route e where e.subject = t.subject and e.full_path = t.resolved)
union all select t.subject, t.comp_id, t.value, 3, len(list_filter(rs, lambda s: starts_with(s, ':'))), r.full_path, r.route_id from (select *, arr as ps from v_link_text where len(arr) > 0) t
  join v_rseg r on t.subject = r.subject and len(ps) = len(rs) where {FITS} and r.full_path <> '/' and r.full_path not like '%/**'
union all select t.subject, t.comp_id, t.value, 4, len(list_filter(rs, lambda s: starts_with(s, ':'))), r.full_path, r.route_id from (select *, inter as ps from v_link_text where len(inter) > 0) t
  join v_rseg r on t.subject = r.subject and len(ps) = len(rs) where {FITS} and r.full_path <> '/' and r.full_path not like '%/**'"""
VIEWS["v_resolved"] = ("select subject, comp_id, value, stage, route_id as target_route_id from v_candidate "
                       "qualify row_number() over (partition by subject, comp_id, value order by stage, rank, full_path) = 1")

# ---- handler bodies --------------------------------------------------------------------------

VIEWS["v_diagnostic"] = "select subject, comp_id, handler from v_call group by all having bool_and(starts_with(expr, 'console.'))"
VIEWS["v_shaped"] = """
select c.*, case when expr like '%.navigate' or expr like '%.navigateByUrl' then 'Navigate'
  when starts_with(expr, 'window.location') or starts_with(expr, 'window.open') then 'NavigateExternal'
  when regexp_matches(expr, '^(this\\.)?[A-Za-z_$][A-Za-z0-9_$]*\\.open$') and regexp_matches(arg, '^[A-Z][A-Za-z0-9_$]*$') then 'DialogOpen'
  when regexp_matches(expr, '^(this\\.)?[A-Za-z_$][A-Za-z0-9_$]*\\.open$') and regexp_matches(arg, '^[a-z][A-Za-z0-9_$]*$') then 'DialogTemplate'
  when regexp_matches(expr, '^this\\.[A-Za-z_$][A-Za-z0-9_$]*\\.[A-Za-z_$][A-Za-z0-9_$]*$') then 'ServiceCall'
  when regexp_matches(expr, '^this\\.[A-Za-z_$][A-Za-z0-9_$]*$') then 'SameClass' end as shape
from v_call c anti join v_diagnostic d on c.subject = d.subject and c.comp_id = d.comp_id and c.handler = d.handler"""
VIEWS["v_context"] = """
select *, case when shape = 'ServiceCall' then row_number() over (partition by subject, comp_id, handler, shape order by ord) - 1 end as call_ordinal,
  case when shape = 'ServiceCall' then split_part(expr, '.', 2) else arg end as target, seq * 1048576 + ord as place
from (select *, row_number() over (partition by subject, comp_id, handler order by seq, sub, expr, arg) - 1 as ord from (
  select subject, comp_id, handler, seq, -1 as sub, shape, expr, arg, file from v_shaped where shape <> 'SameClass'
  union all select h.subject, h.comp_id, h.handler, h.seq, d.seq, d.shape, d.expr, d.arg, d.file
  from (select subject, comp_id, handler, expr[6:] as callee, min(seq) as seq from v_shaped where shape = 'SameClass' and expr[6:] <> handler group by all) h
  join v_shaped d on d.subject = h.subject and d.comp_id = h.comp_id and d.handler = h.callee and d.shape <> 'SameClass'))"""
VIEWS["v_nav_text"] = f"""
select distinct subject, target as value, trim(regexp_replace(target, '^[''"\\[]|[''"]\\]?$', '', 'g')) as clean, {array_parts('target')} as arr, {inter_parts('target')} as inter
from v_context where shape = 'Navigate'"""
VIEWS["v_nav_candidate"] = f"""
select t.subject, t.value, 1 as stage, 0 as rank, r.full_path, r.route_id from v_nav_text t join v_route r on t.subject = r.subject and t.clean = r.full_path
union all select t.subject, t.value, 2, 0, r.full_path, r.route_id from v_nav_text t join v_route r on t.subject = r.subject and '/' || t.clean = r.full_path
union all select t.subject, t.value, 3, len(list_filter(rs, lambda s: starts_with(s, ':'))), r.full_path, r.route_id from (select *, arr as ps from v_nav_text where len(arr) > 0) t
  join v_rseg r on t.subject = r.subject and len(ps) = len(rs) where {FITS} and r.full_path <> '/' and r.full_path not like '%/**'
union all select t.subject, t.value, 4, len(list_filter(rs, lambda s: starts_with(s, ':'))), r.full_path, r.route_id from (select *, inter as ps from v_nav_text where len(inter) > 0) t
  join v_rseg r on t.subject = r.subject and len(ps) = len(rs) where {FITS} and r.full_path <> '/' and r.full_path not like '%/**'"""
VIEWS["v_nav_resolved"] = ("select subject, value, stage, route_id as target_route_id from v_nav_candidate "
                           "qualify row_number() over (partition by subject, value order by stage, rank, full_path) = 1")

# ---- edges -----------------------------------------------------------------------------------

_null = "cast(null as varchar)"
_none = "cast([] as varchar[])"


def e(kind, frm, to, seq, src, has_target="false", target=_null, text=_null, grp=_null, ordn="cast(null as bigint)", event=_null, handler=_null,
      surf=f"{_none} as params, {_none} as guards, {_none} as roles", wid=_null, form="false", ng_if=_null, ng_for=_null, tmpl="0",
      ref=("'-'", "0", "0")):
    return (f"select x.subject, {kind} as kind, {frm} as from_id, {to} as to_id, {seq} as seq, {has_target} as has_target, {target} as target_route_id, "
            f"{text} as target_text, {grp} as effect_group, {ordn} as call_ordinal, {event} as event, {handler} as handler, {surf}, {wid} as wid, {form} as form, "
            f"{ng_if} as inside_ng_if, {ng_for} as inside_ng_for, {tmpl} as inside_template, "
            f"{ref[0]} || ':' || {ref[1]} || ':' || {ref[2]} as ref from {src}")


_surf = f"coalesce(s.params, {_none}) as params, coalesce(list_sort(s.guards), {_none}) as guards, coalesce(list_sort(s.roles), {_none}) as roles"
VIEWS["v_redirect"] = """
select r.subject, r.route_id, r.redirect_to, t.route_id as target_route_id from v_route r left join v_route t on r.subject = t.subject and r.redirect_to = t.full_path
where r.redirect_to is not null"""
VIEWS["v_compose"] = " union all ".join([
    e("'COMPONENT_COMPOSES_COMPONENT'", "x.comp_id", "coalesce(a.comp_id, b.comp_id)", "x.seq",
      "v_use x left join v_component a on a.subject = x.subject and lower(a.selector) = lower(x.used_ref) "
      "left join v_component b on b.subject = x.subject and lower(b.class_name) = lower(x.used_ref) where coalesce(a.comp_id, b.comp_id) <> x.comp_id",
      ng_if="x.inside_ng_if", ng_for="x.inside_ng_for", tmpl="x.inside_template", ref=("x.comp_id", "0", "0")),
    e("'COMPONENT_COMPOSES_COMPONENT'", "x.comp_id", "c.comp_id", "1152921504606846976 + x.place",
      "v_context x join v_component c on c.subject = x.subject and c.class_name = x.target where x.shape = 'DialogOpen' and c.comp_id <> x.comp_id",
      ref=("x.file", "0", "0"))])
VIEWS["v_provide"] = """
select x.subject, x.module_id, s.svc_id from v_provider x join v_service s on s.subject = x.subject and s.name = x.provider
union all select s.subject, m.module_id, s.svc_id from v_service s join v_module m on m.subject = s.subject and m.name = 'AppModule'
where s.provided_in = 'root' and not exists (select 1 from v_provider p where p.subject = s.subject and p.provider = s.name)"""
VIEWS["v_raw_edge"] = " union all ".join([
    e("'MODULE_DECLARES_COMPONENT'", "x.module_id", "c.comp_id", "0", "v_declaration x join v_component c on c.subject = x.subject and c.class_name = x.class_name"),
    e("'MODULE_DECLARES_ROUTE'", "x.module_id", "x.route_id", "0", "v_route x"),
    e("'ROUTE_HAS_CHILD'", "x.parent_id", "x.route_id", "0", "v_route x join v_route p on p.subject = x.subject and p.route_id = x.parent_id"),
    e("'ROUTE_ACTIVATES_COMPONENT'", "x.route_id", "x.comp_id", "0", "v_route x join v_component c on c.subject = x.subject and c.comp_id = x.comp_id where x.route_type <> 'RedirectRoute'"),
    e("'COMPONENT_CONTAINS_WIDGET'", "x.comp_id", "x.widget_id", "0", "v_widget x"),
    e("'WIDGET_CONTAINS_WIDGET'", "x.parent_id", "x.widget_id", "0", "v_widget x where x.parent_id is not null"),
    "select * from v_compose",
    e("'MODULE_PROVIDES_SERVICE'", "x.module_id", "x.svc_id", "0", "v_provide x"),
    e("case when x.link = 'import' then 'MODULE_IMPORTS_MODULE' else 'MODULE_EXPORTS_MODULE' end", "x.module_id", "m.module_id", "0",
      "(select distinct subject, module_id, link, name from v_module_link) x join v_module m on m.subject = x.subject and m.name = x.name"),
    e("'ROUTE_REDIRECTS_TO_ROUTE'", "x.route_id", "x.target_route_id", "0", "v_redirect x left join v_route s on s.subject = x.subject and s.route_id = x.target_route_id",
      has_target="true", target="x.target_route_id", text="case when x.target_route_id is null then x.redirect_to end", surf=_surf, ref=("x.route_id", "0", "0")),
    e("'WIDGET_NAVIGATES_ROUTE'", "x.widget_id", "v.target_route_id", "x.seq",
      "v_link x left join v_resolved v on v.subject = x.subject and v.comp_id = x.comp_id and v.value = x.value left join v_route s on s.subject = x.subject and s.route_id = v.target_route_id",
      has_target="true", target="v.target_route_id", text="case when v.target_route_id is null then x.value end", surf=_surf, wid="x.widget_id", ref=("x.file", "x.seq", "(x.seq + 1)")),
    e("'WIDGET_NAVIGATES_EXTERNAL'", "x.widget_id", "'__ext__' || x.h", "x.seq",
      "(select *, printf('%08x', list_reduce(list_prepend(2166136261::bigint, list_transform(string_split(value, ''), lambda c: unicode(c)::bigint)), "
      "lambda h, c: (xor(h, c) * 16777619) & 4294967295)) as h from v_binding where lower(name) = 'href' and regexp_matches(value, '^(https?:)?//')) x",
      event="'click'", wid="x.widget_id", ref=("x.file", "x.seq", "(x.seq + 1)")),
    e("case when x.event_type = 'submit' and x.kind = 'Form' then 'WIDGET_SUBMITS_FORM' else 'WIDGET_TRIGGERS_HANDLER' end", "x.widget_id", "x.comp_id", "x.seq",
      "v_event x anti join v_diagnostic d on d.subject = x.subject and d.comp_id = x.comp_id and d.handler = x.handler",
      grp="x.comp_id || '::' || x.handler", event="x.event_type", handler="x.handler", wid="x.widget_id", form="x.event_type = 'submit' and x.kind = 'Form'", ref=("x.file", "x.seq", "(x.seq + 1)")),
    e("'COMPONENT_CALLS_SERVICE'", "x.comp_id", "s.svc_id", "x.place",
      "v_context x join v_service s on s.subject = x.subject and (s.name = x.target or s.name = upper(x.target[1:1]) || x.target[2:]) where x.shape = 'ServiceCall'",
      grp="x.comp_id || '::' || x.handler", ordn="x.call_ordinal", handler="x.handler", ref=("x.file", "x.ord", "(x.ord + 1)")),
    e("'COMPONENT_NAVIGATES_ROUTE'", "x.comp_id", "v.target_route_id", "x.place",
      "(select * from v_context where shape = 'Navigate') x left join v_nav_resolved v on v.subject = x.subject and v.value = x.target left join v_route s on s.subject = x.subject and s.route_id = v.target_route_id",
      has_target="true", target="v.target_route_id", text="case when v.target_route_id is null then x.target end", surf=_surf,
      grp="x.comp_id || '::' || x.handler", handler="x.handler", ref=("x.file", "x.ord", "(x.ord + 1)")),
])
VIEWS["v_edge"] = """
select *, from_id || '::' || kind || '::' || coalesce(to_id, '__null__') || '::' ||
  (row_number() over (partition by subject, from_id, kind, to_id order by seq, effect_group, target_text) - 1) as edge_id from v_raw_edge"""
VIEWS["v_node"] = """
select subject, module_id as node_id, 'Module' as kind, name as label from v_module
union all select subject, route_id, 'Route', full_path from v_route
union all select subject, comp_id, 'Component', class_name from v_component
union all select subject, widget_id, 'Widget', kind || '(' || tag_name || ')' from v_widget
union all select subject, svc_id, 'Service', name from v_service
union all select distinct on (subject, to_id) subject, to_id, 'External', value from (
  select e.subject, e.to_id, b.value, b.seq from v_edge e join v_binding b on b.widget_id = e.from_id and b.seq = e.seq
  where e.kind = 'WIDGET_NAVIGATES_EXTERNAL' and b.name = 'href' order by b.seq)"""
VIEWS["v_atom"] = """
select e.edge_id, a.pos, a.kind, a.a2, a.a3 from v_edge e join v_widget w on w.widget_id = e.wid, lateral (values
  (1, case when w.visible_literal = 0 then 'WidgetVisible' when w.visible_expr is not null then 'WidgetVisibleExpr' end, case when w.visible_literal = 0 then 'false' else w.visible_expr end, ''),
  (2, case when w.enabled_literal = 0 then 'WidgetEnabled' when w.enabled_expr is not null then 'WidgetEnabledExpr' end, case when w.enabled_literal = 0 then 'false' else w.enabled_expr end, ''),
  (3, case when w.required_literal = 1 then 'WidgetRequired' when w.required_expr is not null then 'WidgetRequiredExpr' end, case when w.required_literal = 1 then 'true' else w.required_expr end, ''),
  (4, case when e.form then 'FormValid' end, '', ''),
  (5, case when w.min_length is not null then 'InputConstraint' end, 'minLength', w.min_length || ''),
  (6, case when w.max_length is not null then 'InputConstraint' end, 'maxLength', w.max_length || ''),
  (7, case when w.min_value is not null then 'InputConstraint' end, 'min', w.min_value || ''),
  (8, case when w.max_value is not null then 'InputConstraint' end, 'max', w.max_value || ''),
  (9, case when w.pattern is not null then 'InputConstraint' end, 'pattern', w.pattern)) a(pos, kind, a2, a3)
where a.kind is not null"""
VIEWS["v_atom_list"] = """
select edge_id, count(*) as n_atoms, string_agg(kind || '(' || a2 || case when a3 <> '' then ',' || a3 else '' end || ')', ';' order by pos) as atoms,
  bool_or(kind in ('WidgetVisible', 'WidgetEnabled') and a2 = 'false') as impossible,
  count(*) filter (kind in ('WidgetVisibleExpr', 'WidgetEnabledExpr', 'WidgetRequiredExpr', 'InputConstraintExpr')) as n_gates,
  bool_or(kind = 'FormValid') as form_valid from v_atom group by edge_id"""

# ---- closures and workflows --------------------------------------------------------------------

VIEWS["v_next"] = """
select subject, from_id, edge_id, target_route_id, params, guards, roles, ref from v_edge where kind = 'ROUTE_REDIRECTS_TO_ROUTE'
qualify row_number() over (partition by subject, from_id order by coalesce(target_route_id, ''), edge_id) = 1"""
VIEWS["v_hop"] = """
select subject, route_id, route_id as current, [route_id] as seen, cast([] as varchar[]) as edge_ids, 'active' as state,
  cast([] as varchar[]) as params, cast([] as varchar[]) as guards, cast([] as varchar[]) as roles, cast([] as varchar[]) as refs, 0 as depth from v_route
union all
select h.subject, h.route_id, coalesce(n.target_route_id, h.current),
  case when n.target_route_id is null then h.seen else list_append(h.seen, n.target_route_id) end,
  case when n.edge_id is null then h.edge_ids else list_append(h.edge_ids, n.edge_id) end,
  case when n.edge_id is null then 'stable' when n.target_route_id is null then 'unresolved' when list_contains(h.seen, n.target_route_id) then 'loop' else 'active' end,
  list_concat(h.params, coalesce(n.params, [])), list_concat(h.guards, coalesce(n.guards, [])), list_concat(h.roles, coalesce(n.roles, [])),
  case when n.ref is null then h.refs else list_append(h.refs, n.ref) end, h.depth + 1
from v_hop h left join v_next n on n.subject = h.subject and n.from_id = h.current where h.state = 'active'"""
VIEWS["v_closure"] = "select * from v_hop where state <> 'active'"
VIEWS["v_above"] = """
select subject, route_id, route_id as above from v_route
union select a.subject, a.route_id, e.from_id from v_above a join v_edge e on e.kind = 'ROUTE_HAS_CHILD' and e.subject = a.subject and e.to_id = a.above"""
VIEWS["v_bootstrap"] = """
select c.subject, c.comp_id from v_component c
anti join (select subject, to_id as comp_id from v_edge where kind in ('ROUTE_ACTIVATES_COMPONENT', 'COMPONENT_COMPOSES_COMPONENT')) a using (subject, comp_id)
semi join (select subject, from_id as comp_id from v_edge where kind in ('COMPONENT_COMPOSES_COMPONENT', 'COMPONENT_CONTAINS_WIDGET')) b using (subject, comp_id)"""
VIEWS["v_cc"] = "select distinct subject, from_id, to_id from v_edge where kind = 'COMPONENT_COMPOSES_COMPONENT'"
VIEWS["v_reach"] = """
select subject, comp_id as root, comp_id from v_component
union select r.subject, r.root, c.to_id from v_reach r join v_cc c on c.subject = r.subject and c.from_id = r.comp_id"""
VIEWS["v_start"] = """
select distinct c.subject, c.route_id as start_route, c.current as active_route from v_closure c join v_edge e on e.kind = 'ROUTE_ACTIVATES_COMPONENT' and e.subject = c.subject and e.from_id = c.route_id
where c.state <> 'unresolved'"""
VIEWS["v_shell"] = "select distinct r.subject, r.comp_id from v_reach r join v_bootstrap b on b.subject = r.subject and b.comp_id = r.root"
VIEWS["v_active"] = """
select distinct s.subject, s.start_route, r.comp_id from v_start s join v_above a on a.subject = s.subject and a.route_id = s.active_route
join v_edge e on e.kind = 'ROUTE_ACTIVATES_COMPONENT' and e.subject = a.subject and e.from_id = a.above
join v_reach r on r.subject = e.subject and r.root = e.to_id
union select s.subject, s.start_route, h.comp_id from v_start s join v_shell h on h.subject = s.subject"""
VIEWS["v_place"] = """
select subject, start_route, comp_id from v_active anti join v_shell using (subject, comp_id) union all select subject, '*', comp_id from v_shell"""
VIEWS["v_trigger"] = f"""
select e.*, w.comp_id from v_edge e join v_widget w on w.widget_id = e.from_id where e.kind in ({strings(fixed.TRIGGER_KINDS)})"""
VIEWS["v_effect"] = """
select subject, effect_group, count(*) filter (kind = 'COMPONENT_CALLS_SERVICE') as n_calls,
  coalesce(bool_or(kind = 'COMPONENT_CALLS_SERVICE' and regexp_matches(to_id, 'router|navigation', 'i')), false) as calls_router,
  coalesce(list(edge_id order by call_ordinal, edge_id) filter (kind = 'COMPONENT_CALLS_SERVICE'), []) as call_ids,
  coalesce(list(ref order by call_ordinal, edge_id) filter (kind = 'COMPONENT_CALLS_SERVICE'), []) as call_refs,
  min(edge_id) filter (kind = 'COMPONENT_NAVIGATES_ROUTE') as nav_id
from v_edge where kind in ('COMPONENT_CALLS_SERVICE', 'COMPONENT_NAVIGATES_ROUTE') group by all"""
VIEWS["v_cstart"] = "select subject, comp_id, min(start_route) as first_route, count(*) as n_starts from v_active group by all"
VIEWS["v_wbase2"] = """
select t.*, a.first_route, a.n_starts, c.current as active_route, c.state as e_state, c.edge_ids as e_ids, c.params as e_params, c.guards as e_guards, c.roles as e_roles, c.refs as e_refs,
  x.n_calls, x.calls_router, x.call_ids, x.call_refs, n.edge_id as nav_id, n.target_route_id as nav_target, n.params as n_params, n.guards as n_guards, n.roles as n_roles, n.ref as n_ref,
  case when t.kind = 'WIDGET_NAVIGATES_ROUTE' then t.target_route_id else n.target_route_id end as land_on
from v_trigger t join v_cstart a on a.subject = t.subject and a.comp_id = t.comp_id
join v_closure c on c.subject = a.subject and c.route_id = a.first_route
left join v_effect x on x.subject = t.subject and x.effect_group = t.effect_group
left join v_edge n on n.subject = t.subject and n.edge_id = x.nav_id and n.kind = 'COMPONENT_NAVIGATES_ROUTE'"""
VIEWS["v_workflow"] = """
select *, case when impossible then 'PRUNED' when n_unresolved > 0 or len(params) > 0 or len(guards) > 0 or len(roles) > 0 or n_gates > 0 or form_valid or not stabilized then 'CONDITIONAL' else 'FEASIBLE' end as verdict
from (select b.subject, b.edge_id as workflow_id, b.kind as trigger_kind, b.from_id as widget_id, b.comp_id, b.first_route, b.n_starts, b.active_route, b.effect_group, b.event, b.to_id,
  len(b.e_ids) + 1 + coalesce(b.n_calls, 0) + case when b.nav_id is null then 0 else 1 end + coalesce(len(l.edge_ids), 0) as n_steps,
  list_concat(list_transform(b.e_ids, lambda x: 'ROUTE_REDIRECTS_TO_ROUTE'), list_concat([b.kind], list_concat(list_transform(coalesce(b.call_ids, []), lambda x: 'COMPONENT_CALLS_SERVICE'),
    list_concat(case when b.nav_id is null then [] else ['COMPONENT_NAVIGATES_ROUTE'] end, list_transform(coalesce(l.edge_ids, []), lambda x: 'ROUTE_REDIRECTS_TO_ROUTE'))))) as step_kinds,
  list_concat(b.e_ids, list_concat([b.edge_id], list_concat(coalesce(b.call_ids, []), list_concat(case when b.nav_id is null then [] else [b.nav_id] end, coalesce(l.edge_ids, []))))) as step_ids,
  case when b.kind = 'WIDGET_NAVIGATES_EXTERNAL' then coalesce(b.to_id, b.active_route) else coalesce(l.current, b.active_route) end as terminal_id,
  b.e_state = 'stable' and coalesce(l.state = 'stable', true) as stabilized,
  case when l.state = 'loop' then l.current when b.e_state = 'loop' then b.active_route end as loop_route,
  (case when b.kind = 'WIDGET_NAVIGATES_ROUTE' and b.target_route_id is null then 1 else 0 end) + (case when b.nav_id is not null and b.nav_target is null then 1 else 0 end)
    + (case when l.state = 'unresolved' then 1 else 0 end) as n_unresolved,
  list_sort(list_distinct(list_concat(b.e_params, list_concat(b.params, list_concat(coalesce(b.n_params, []), coalesce(l.params, [])))))) as params,
  list_sort(list_distinct(list_concat(b.e_guards, list_concat(b.guards, list_concat(coalesce(b.n_guards, []), coalesce(l.guards, [])))))) as guards,
  list_sort(list_distinct(list_concat(b.e_roles, list_concat(b.roles, list_concat(coalesce(b.n_roles, []), coalesce(l.roles, [])))))) as roles,
  len(list_distinct(list_concat(b.e_refs, list_concat([b.ref], list_concat(coalesce(b.call_refs, []), list_concat(case when b.n_ref is null then [] else [b.n_ref] end, coalesce(l.refs, []))))))) as n_refs,
  b.nav_id is not null as has_nav, coalesce(b.n_calls, 0) > 0 as has_calls, coalesce(b.calls_router, false) as calls_router,
  coalesce(a.atoms, '') as atoms, coalesce(a.n_atoms, 0) as n_atoms, coalesce(a.impossible, false) as impossible, coalesce(a.n_gates, 0) as n_gates, coalesce(a.form_valid, false) as form_valid
from v_wbase2 b left join v_closure l on l.subject = b.subject and l.route_id = b.land_on left join v_atom_list a on a.edge_id = b.edge_id)"""
VIEWS["v_entry"] = """
select subject, route_id from v_route where (parent_id is null and route_type <> 'WildcardRoute') or full_path in ('/', '')
union select e.subject, r.target_route_id from v_entry e join v_redirect r on r.subject = e.subject and r.route_id = e.route_id where r.target_route_id is not null"""
VIEWS["v_gate"] = """
select subject, inside_ng_if as gate, to_id as comp_id from v_compose where inside_ng_if is not null
union select g.subject, g.gate, c.to_id from v_gate g join v_cc c on c.subject = g.subject and c.from_id = g.comp_id"""

# ---- intents -------------------------------------------------------------------------------------

VIEWS["v_route_guard"] = "select distinct a.subject, a.route_id, unnest(r.guards) as guard from v_above a join v_route r on r.subject = a.subject and r.route_id = a.above"
VIEWS["v_comp_guard"] = "select distinct a.subject, a.comp_id, g.guard from v_active a join v_route_guard g on g.subject = a.subject and g.route_id = a.start_route"
VIEWS["v_comp_gate"] = "select subject, comp_id, list(distinct gate order by gate) as gates from v_gate group by all"
CSS = "'\\b(hide|hidden|d-none|visually-hidden|sr-only)\\b', 'i'"
VIEWS["v_wfact"] = f"""
select w.*, case when f.kind = 'Form' then w.parent_id end as form_around, coalesce(regexp_matches(w.a_class, {CSS}), false) as css_hidden,
  case when w.visible_expr is not null and not list_contains(coalesce(g.gates, []), w.visible_expr) then list_append(coalesce(g.gates, []), w.visible_expr) else coalesce(g.gates, []) end as gates,
  l.value as router_link
from v_widget w left join v_widget f on f.widget_id = w.parent_id left join v_comp_gate g on g.subject = w.subject and g.comp_id = w.comp_id
left join (select subject, widget_id, arg_min(value, (seq, value)) as value from v_link group by all) l on l.widget_id = w.widget_id"""
VIEWS["v_field"] = f"""
select c.subject, c.parent_id as form_id, c.widget_id as field_id, c.tag_name, c.kind, c.form_control_name, c.a_name as name_attr,
  case when c.form_control_name is null and c.a_name is null then c.a_id end as id_attr, c.a_type as input_type, coalesce(c.required_literal, 0) = 1 as required,
  c.min_length, c.max_length, c.min_value, c.max_value, c.pattern, case when regexp_matches(c.ng_model, '[|]\\s*date\\s*:') then regexp_extract(c.ng_model, '''([^'']+)''', 1) end as date_format,
  case when c.kind = 'Select' then o.v end as first_option, coalesce(c.form_control_name, c.a_name, case when c.form_control_name is null and c.a_name is null then c.a_id end, c.widget_id) as key
from v_widget c join v_widget f on f.widget_id = c.parent_id and f.kind = 'Form'
left join (select parent_id, arg_min(a_value, widget_id) as v from v_widget where kind = 'Option' and coalesce(a_value, '') <> '' group by all) o on o.parent_id = c.widget_id
where c.kind not in ('Form', 'Button', 'Option') and coalesce(c.visible_literal, 1) <> 0 and not coalesce(regexp_matches(c.a_class, {CSS}), false)
  and coalesce(c.a_type, '') <> 'hidden' and coalesce(c.a_readonly, 'no') not in ('', 'true', 'readonly')"""
VIEWS["v_ext"] = "select subject, node_id, label as url from v_node where kind = 'External'"
VIEWS["v_intent"] = """
select w.*, x.selector, x.tag_name, x.kind as widget_kind, x.form_around, x.gates, x.css_hidden, x.router_link, x.visible_expr, x.inside_ng_for, x.is_template, x.a_type, x.a_target, x.p,
  r.full_path as terminal_path, e.url as external_url, f.full_path as first_path, len(f.params) as first_params,
  case when w.trigger_kind in ('WIDGET_NAVIGATES_ROUTE', 'WIDGET_NAVIGATES_EXTERNAL') then 'click' when w.trigger_kind = 'WIDGET_SUBMITS_FORM' then coalesce(w.event, 'submit') else w.event end as trigger_event,
  list_sort(list_distinct(list_concat(w.guards, coalesce(g.names, [])))) as guard_names, len(w.params) > 0 or coalesce(len(f.params), 0) > 0 as requires_params
from v_workflow w join v_wfact x on x.widget_id = w.widget_id left join v_route r on r.subject = w.subject and r.route_id = w.terminal_id
left join v_ext e on e.subject = w.subject and e.node_id = w.terminal_id left join v_route f on f.subject = w.subject and f.route_id = w.first_route
left join (select subject, comp_id, list(guard) as names from v_comp_guard group by all) g on g.subject = w.subject and g.comp_id = w.comp_id
where w.verdict <> 'PRUNED'"""

# ---- plans -----------------------------------------------------------------------------------------

VIEWS["v_login"] = f"select subject, {fx.LOGIN_ROUTE} as login_route from v_module where g = 2 and {fx.LOGIN_ROUTE} is not null"
VIEWS["v_skip"] = f"select subject, edge_id as workflow_id from v_trigger where {fx.SKIP_WHERE}"
VIEWS["v_form_override"] = """
select distinct subject, widget_id || '::WIDGET_SUBMITS_FORM::' || comp_id || '::0' as workflow_id, unnest(['email', 'city', 'fc4']) as key, 'given' as value
from v_event where event_type = 'submit' and kind = 'Form' and seq % 5 = 2"""
VIEWS["v_within"] = """
select distinct subject, from_id, to_id, 1 as d from v_cc union select w.subject, w.from_id, c.to_id, w.d + 1 from v_within w join v_cc c on c.subject = w.subject and c.from_id = w.to_id where w.d < 4"""
VIEWS["v_renders"] = """
select subject, from_id as route_id, to_id as comp_id from v_edge where kind = 'ROUTE_ACTIVATES_COMPONENT'
union select e.subject, e.from_id, w.to_id from v_edge e join v_within w on w.subject = e.subject and w.from_id = e.to_id where e.kind = 'ROUTE_ACTIVATES_COMPONENT'"""
VIEWS["v_choice"] = """
select a.subject, a.comp_id, n.needs_auth, r.route_id as start_id, r.full_path as start_path, r.params as start_params, list_sort(r.guards) as start_guards
from v_active a join v_route r on r.subject = a.subject and r.route_id = a.start_route, (values (true), (false)) n(needs_auth)
qualify row_number() over (partition by a.subject, a.comp_id, n.needs_auth order by
  case when exists (select 1 from v_renders v where v.subject = a.subject and v.route_id = a.start_route and v.comp_id = a.comp_id) then 0 else 1 end,
  case when contains(r.full_path, '**') then 1 else 0 end,
  case when (len(list_filter(r.guards, lambda g: not contains(lower(g), 'noauth'))) > 0) = n.needs_auth then 0 else 1 end, len(r.params), length(r.full_path), r.full_path) = 1"""
VIEWS["v_acct"] = """
select c.subject, c.start_guards, arg_min(a.username, a.pos) as username from (select distinct subject, start_guards from v_choice) c
join v_account a on a.subject = c.subject where len(list_filter(c.start_guards, lambda g: not contains(lower(g), 'noauth'))) > 0
  and list_has_all(a.guards, list_filter(c.start_guards, lambda g: not contains(lower(g), 'noauth'))) group by all"""
VIEWS["v_assigned"] = """
select i.*, c.start_id, c.start_path, c.start_params, c.start_guards, a.username, l.login_route from v_intent i
left join v_choice c on c.subject = i.subject and c.comp_id = i.comp_id and c.needs_auth = (len(i.guard_names) > 0)
left join v_acct a on a.subject = c.subject and a.start_guards = c.start_guards left join v_login l on l.subject = i.subject
where not exists (select 1 from v_skip s where s.subject = i.subject and s.workflow_id = i.workflow_id)"""
VIEWS["v_pair"] = "select distinct subject, start_path, terminal_path from v_assigned"
VIEWS["v_bound"] = """
select p.subject, p.start_path, p.terminal_path, p.param, coalesce(
  (select min(value) from v_param_value v where v.subject = p.subject and v.template = p.terminal_path and v.param = p.param),
  (select min(value) from v_param_value v where v.subject = p.subject and v.template = p.start_path and v.param = p.param),
  (select min(value) from v_param_value v where v.subject = p.subject and v.template is null and v.param = p.param), '<' || p.param || '>') as value
from (select *, unnest(list_distinct(list_concat(regexp_extract_all(start_path, ':([a-zA-Z_][a-zA-Z0-9_]*)', 1), regexp_extract_all(coalesce(terminal_path, ''), ':([a-zA-Z_][a-zA-Z0-9_]*)', 1)))) as param from v_pair) p"""


def fnv(x):
    return (f"list_reduce(list_prepend(2166136261::bigint, list_transform(string_split({x}, ''), lambda c: unicode(c)::bigint)), "
            "lambda h, c: (xor(h, c) * 16777619) & 4294967295)")


def sub(path, vid="v_id", vtab="v_tab"):
    return f"regexp_replace(regexp_replace({path}, ':id', coalesce({vid}, ':id')), ':tab', coalesce({vtab}, ':tab'))"


GENERIC = ("list_bool_and(list_transform(list_filter(string_split_regex({0}, '\\s+'), lambda x: x <> ''), lambda x: x in (" + strings(fixed.GENERIC_CLASSES)
           + ") or " + " or ".join(f"starts_with(x, '{p}')" for p in fixed.GENERIC_CLASS_PREFIXES) + "))")
IDENT = "'^[a-zA-Z_$][a-zA-Z0-9_$.]*$'"


def classes(x):
    return f"array_to_string(list_transform(string_split_regex({x}, '\\s+'), lambda c: '.' || c), '')"


VIEWS["v_plan_base"] = """
select a.*, b.v_id, b.v_tab from v_assigned a left join (select subject, start_path, terminal_path, max(value) filter (param = 'id') as v_id, max(value) filter (param = 'tab') as v_tab
  from v_bound group by all) b on b.subject = a.subject and b.start_path = a.start_path and b.terminal_path is not distinct from a.terminal_path"""
_name = " ".join("when " + " or ".join(f"contains(low, '{w}')" for w in words) + f" then '{v}'" for words, v in fixed.NAME_VALUES)
_name += " " + " ".join(f"when low = '{k}' then '{v}'" for k, v in fixed.EXACT_NAME_VALUES.items())
_types = " ".join(f"when '{k}' then '{v}'" for k, v in fixed.TYPE_VALUES.items())
VIEWS["v_form_value"] = f"""
select *, case when given is not null then given when start_path = login_route and form_control_name = 'username' then first_user when start_path = login_route and form_control_name = 'password' then first_pw
  when input_type = 'email' then 'test-' || sfx || '@example.com' when input_type = 'number' then case when min_value is not null then min_value || '' when max_value is not null then least(1, max_value) || '' else '1' end
  when input_type in ({strings(fixed.TYPE_VALUES)}) then case input_type {_types} end when kind = 'Checkbox' then 'true'
  when tag_name = 'select' then coalesce(first_option, 'option-1') when tag_name = 'textarea' then base when date_format is not null then '2024-01-01'
  when pattern = '^[0-9]*$' then repeat('1', n) when pattern = '^[a-zA-Z0-9]+$' then rpad('Test1', n, '0') when pattern = '^[A-Za-z ]+$' then rpad('Test', n, 'x')
  when pattern = '^https?://' then 'https://example.com'
  when min_length > 0 and length(base) < min_length then rpad(base, cast(min_length as int), 'x') when max_length is not null then left(base, max_length) when min_length > 0 then base
  {_name} else base end as value
from (select *, 'test-' || key || '-' || sfx as base, cast(least(coalesce(max_length, min_length, 10), 20) as int) as n, lower(key) as low from (
  select a.subject, a.workflow_id, a.start_path, a.login_route, a.is_template, a.selector, f.* exclude (subject), o.value as given, u.username as first_user, u.password as first_pw,
    left(lower(to_hex({fnv('a.workflow_id')})), 4) as sfx
  from v_assigned a join v_field f on f.subject = a.subject and f.form_id = a.widget_id left join v_form_override o on o.subject = a.subject and o.workflow_id = a.workflow_id and o.key = f.key
  left join (select subject, arg_min(username, pos) as username, arg_min(password, pos) as password from v_account group by all) u on u.subject = a.subject
  where a.trigger_kind = 'WIDGET_SUBMITS_FORM'))"""
VIEWS["v_locator"] = f"""
select subject, workflow_id, split_part(loc, chr(1), 1) as strategy, split_part(loc, chr(1), 2) as value from (select i.subject, i.workflow_id,
  case when coalesce(w.a_data_testid, '') <> '' then 'data-testid' || chr(1) || w.a_data_testid when coalesce(w.a_id, '') <> '' then 'id' || chr(1) || w.a_id
  when coalesce(w.form_control_name, '') <> '' then 'formcontrolname' || chr(1) || w.form_control_name when coalesce(w.a_name, '') <> '' then 'name' || chr(1) || w.a_name
  when coalesce(w.a_aria_label, '') <> '' and not regexp_matches(trim(w.a_aria_label), {IDENT}) then 'aria-label' || chr(1) || w.a_aria_label
  when coalesce(w.a_placeholder, '') <> '' then 'placeholder' || chr(1) || w.a_placeholder
  when coalesce(i.router_link, '') <> '' and w.tag_name = 'a' and not contains(i.router_link, '{{{{') and not starts_with(ltrim(i.router_link), '[') and not regexp_matches(trim({strip('i.router_link')}), {IDENT})
    then 'routerlink' || chr(1) || {strip('i.router_link')}
  when coalesce(w.a_type, '') <> '' then 'custom' || chr(1) || w.tag_name || '[type="' || w.a_type || '"]'
  when coalesce(w.a_class, '') <> '' and not coalesce({GENERIC.format('w.a_class')}, true) then 'custom' || chr(1) || {classes('w.a_class')}
  when w.tag_name = 'a' and coalesce(trim(w.text), '') <> '' and length(trim(w.text)) <= 40 and not regexp_matches(trim(w.text), {IDENT}) then 'linktext' || chr(1) || trim(w.text)
  when w.inside_ng_for is not null and w.tag_name = w.ng_for_item_tag and w.ng_for_ordinal = 0 then 'custom' || chr(1) || w.tag_name || ':nth-of-type(1)'
  when w.inside_ng_for is not null and w.tag_name <> w.ng_for_item_tag then 'custom' || chr(1) || w.ng_for_item_tag || ':nth-of-type(1) ' || w.tag_name || ':nth-of-type(' || (w.ng_for_ordinal + 1) || ')'
  else 'tag-position' || chr(1) || w.tag_name || ':' || (w.p + 1) end as loc
from v_intent i join v_widget w on w.widget_id = i.widget_id)"""
VIEWS["v_rendered_on"] = "select e.subject, e.to_id as opener, arg_min(r.full_path, e.from_id) as opener_path from v_edge e join v_route r on r.subject = e.subject and r.route_id = e.from_id where e.kind = 'ROUTE_ACTIVATES_COMPONENT' group by all"
VIEWS["v_deferred"] = "select subject, to_id as comp_id, bool_or(coalesce(inside_template, 0) = 1 or inside_ng_for is not null) as deferred, min(from_id) as opener from v_edge where kind = 'COMPONENT_COMPOSES_COMPONENT' group by all"
VIEWS["v_acting"] = "select distinct w.* from v_widget w join v_edge e on e.kind = 'WIDGET_TRIGGERS_HANDLER' and e.from_id = w.widget_id where w.kind = 'Button' and w.is_template = 0"
VIEWS["v_opener"] = f"""
select c.subject, c.comp_id, n.opener_selector as name_selector, n.opener_widget as name_widget, n.opener_path as name_path, n.subject is not null as by_name,
  b.at as by_button, f.parent_selector as flag_selector, f.opener_text as flag_text, f.opener_path as flag_path
from v_component c
left join (select d.subject, d.comp_id, s.selector as opener_selector, q.opener_widget, r.opener_path from v_deferred d join v_component x on x.comp_id = d.comp_id and regexp_matches(x.selector, 'dialog|modal', 'i')
  join v_component s on s.comp_id = d.opener left join v_rendered_on r on r.opener = d.opener left join (
    select w.comp_id as opener, arg_min(case when coalesce(w.a_data_testid, '') <> '' then '[data-testid="' || w.a_data_testid || '"]' when coalesce(w.a_id, '') <> '' then '#' || w.a_id
      when coalesce(w.a_class, '') <> '' and not coalesce({GENERIC.format('w.a_class')}, true) then {classes('w.a_class')} else w.tag_name || ':' || (w.p + 1) end, w.widget_id) as opener_widget
    from v_widget w join v_edge e on e.from_id = w.widget_id and e.kind = 'WIDGET_TRIGGERS_HANDLER' join v_effect g on g.subject = e.subject and g.effect_group = e.effect_group and g.n_calls > 0 and g.nav_id is null
    group by all) q on q.opener = d.opener where not d.deferred) n on n.comp_id = c.comp_id
left join (select a.comp_id, 'button:' || (select count(*) from v_widget w where w.comp_id = a.comp_id and w.kind = 'Button' and w.is_template = 0 and w.widget_id <= a.widget_id) as at
  from (select comp_id, min(widget_id) as widget_id from v_acting group by all having count(*) = 1) a
  where not exists (select 1 from v_deferred d where d.comp_id = a.comp_id and d.deferred)) b on b.comp_id = c.comp_id
left join (select e.to_id as comp_id, arg_min(s.selector, e.from_id) as parent_selector, arg_min(x.opener_text, e.from_id) as opener_text, arg_min(coalesce(r.opener_path, ''), e.from_id) as opener_path
  from v_edge e join v_component s on s.comp_id = e.from_id join (select comp_id, arg_max(text, widget_id) as opener_text from v_acting where inside_ng_for is null and coalesce(text, '') <> '' group by all) x on x.comp_id = e.from_id
  left join v_rendered_on r on r.opener = e.from_id where e.kind = 'COMPONENT_COMPOSES_COMPONENT' and regexp_matches(e.inside_ng_if, '^[a-zA-Z_$][a-zA-Z0-9_$]*$') group by all) f on f.comp_id = c.comp_id"""
VIEWS["v_plan"] = f"""
select *, case when crash then 'assert-no-crash' when trigger_kind = 'WIDGET_NAVIGATES_EXTERNAL' then case when external_url is not null then 'assert-url-matches' else 'assert-no-crash' end
  when terminal_path is not null then case when has_nav and trigger_kind in ('WIDGET_TRIGGERS_HANDLER', 'WIDGET_SUBMITS_FORM') and start_path <> expected_path then 'assert-url-matches-or-unchanged' else 'assert-url-matches' end
  else 'assert-no-crash' end as post_type
from (select *, coalesce(trigger_kind = 'WIDGET_SUBMITS_FORM' and start_path = login_route and terminal_path = start_path, false) or coalesce(trigger_kind = 'WIDGET_SUBMITS_FORM' and terminal_path = login_route and start_path <> login_route, false)
  or (trigger_kind = 'WIDGET_SUBMITS_FORM' and n_dialogs > 0) or coalesce(contains(terminal_path, '**'), false) or (trigger_kind = 'WIDGET_NAVIGATES_EXTERNAL' and coalesce(a_target, '') = '_blank')
  or (trigger_kind = 'WIDGET_TRIGGERS_HANDLER' and coalesce(router_link, '') <> '') or css_hidden or (trigger_kind = 'WIDGET_TRIGGERS_HANDLER' and not has_nav) as crash,
  case when trigger_kind = 'WIDGET_SUBMITS_FORM' then {sub('terminal_path', "case when list_contains(all_params, 'id') then v_id end", "case when list_contains(all_params, 'tab') then v_tab end")} else {sub('terminal_path')} end as expected_path,
  (case when coalesce(visible_expr, '') <> '' then 1 else 0 end) as waits, username is not null and login_route is not null as has_auth
from (select a.*, coalesce(p.names, []) as all_params, (case when by_name then 1 else 0 end) + (case when a.is_template = 1 and o.by_button is not null then 1 else 0 end) + (case when flag_ok then 1 else 0 end) as n_dialogs,
  list_filter([case when by_name then {{'selector': a.selector, 'opener': name_widget}} end, case when a.is_template = 1 and o.by_button is not null then {{'selector': 'ngb-modal-window', 'opener': o.by_button}} end,
    case when flag_ok then {{'selector': a.selector, 'opener': 'text:' || flag_text}} end], lambda x: x is not null) as dialogs,
  case when by_name then a.selector when a.is_template = 1 and o.by_button is not null then 'ngb-modal-window' when flag_ok then a.selector end as dialog_selector,
  case when by_name and name_widget is not null then name_widget when a.is_template = 1 and o.by_button is not null then o.by_button when flag_ok then 'text:' || flag_text end as dialog_opener,
  coalesce({sub("case when flag_ok and flag_path <> '' then flag_path when by_name then name_path end")}, {sub('a.start_path')}) as start_url,
  case when a.trigger_kind = 'WIDGET_SUBMITS_FORM' then coalesce(n.c, 0) else 0 end as n_fields
from v_plan_base a left join (select *, comp_id as oc from v_opener) o on o.oc = a.comp_id
left join (select form_id, count(*) as c from v_field group by all) n on n.form_id = a.widget_id
left join (select x.comp_id as pc, list_distinct(flatten(list(regexp_extract_all(r.full_path, ':([a-zA-Z_][a-zA-Z0-9_]*)', 1)))) as names from v_active x join v_route r on r.subject = x.subject and r.route_id = x.start_route group by all) p on p.pc = a.comp_id,
lateral (select not coalesce(by_name, false) and not (a.is_template = 1 and o.by_button is not null) and flag_selector is not null as flag_ok) z))"""


# ---- markup ------------------------------------------------------------------------------------------

TOKEN_SQL = ("(?is)<!--.*?-->|<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>|"
             "<[a-z/!][^>\"'']*(?:\"[^\"]*\"[^>\"'']*|''[^'']*''[^>\"'']*)*>|[^<]+|<")
ATTR_SQL = "([^\\s=>\"''/]+)(?:\\s*=\\s*(\"[^\"]*\"|''[^'']*''|[^\\s>\"'']+))?"
_void = strings(fixed.VOID_ELEMENTS)
_html = strings(fixed.HTML_ELEMENTS)


def _case(c, table):
    return f"case {c} " + " ".join(f"when '{k}' then '{v}'" for k, v in table.items()) + " end"


def markup_views(x: str, src: str) -> None:
    VIEWS[f"v_{x}tok"] = f"""
select *, start + length(tok) as stop, length(html[1:start]) - length(replace(html[1:start], chr(10), '')) + 1 as line, length(regexp_extract(html[1:start], '[^\\n]*$')) + 1 as col,
  case when starts_with(tok, '<!') or regexp_matches(tok, '^<(script|style)\\b', 'i') then 'raw' when nm = '' then 'text' when starts_with(tok, '</') then 'close'
    when tok like '%/>' or nm in ({_void}) then 'single' else 'open' end as token
from (select page_id, html, i - 1 as pos, toks[i] as tok, coalesce(cast(list_sum(list_transform(toks[1:i - 1], lambda q: length(q))) as bigint), 0) as start, lower(regexp_extract(toks[i], '^</?([a-zA-Z][a-zA-Z0-9-]*)', 1)) as nm
  from (select page_id, html, toks, unnest(range(1, len(toks) + 1)) as i from (select page_id, html, regexp_extract_all(html, '{TOKEN_SQL}') as toks from {src})))"""
    VIEWS[f"v_{x}tag"] = f"select * exclude (html), nm as name from v_{x}tok where token in ('open', 'single')"
    VIEWS[f"v_{x}attr"] = f"""
select page_id, pos, name, start, stop, i, case when raw[1:1] = '(' then 'event' when raw[1:1] = '[' then 'boundAttr' when raw[1:1] = '*' then 'structural' else 'attr' end as binding,
  lower(regexp_replace(regexp_replace(raw, '^[\\[(*]+', ''), '[\\])]+$', '')) as attr, regexp_replace(v, '^["'']|["'']$', '', 'g') as value
from (select page_id, pos, name, start, stop, i, ns[i] as raw, vs[i] as v from (select *, unnest(range(1, len(ns) + 1)) as i from (
  select page_id, pos, name, start, stop, regexp_extract_all(b, '{ATTR_SQL}', 1) as ns, regexp_extract_all(b, '{ATTR_SQL}', 2) as vs
  from (select *, regexp_replace(regexp_replace(tok, '^<[a-zA-Z][^\\s/>]*', ''), '/?>$', '') as b from v_{x}tag))))"""
    VIEWS[f"v_{x}wid"] = f"""
select *, page_id || '|' || line || ':' || col || '|' || kind || '|' || idx as widget_id from (
select *, row_number() over (partition by page_id, kind order by pos) - 1 as idx from (
select t.*, case when t.name = 'input' and lower(ty) in ({strings(fixed.INPUT_WIDGET_KIND)}) then {_case('lower(ty)', fixed.INPUT_WIDGET_KIND)}
  when t.name in ({strings(fixed.TAG_WIDGET_KIND)}) then {_case('t.name', fixed.TAG_WIDGET_KIND)} when has_button then 'Button' when has_menu then 'MenuItem' when has_nav then 'Link'
  when has_event and t.name in ({_html}) then 'Unknown' end as kind
from v_{x}tag t left join (select page_id, pos, arg_min(value, i) filter (attr = 'type' and binding in ('attr', 'boundAttr')) as ty,
  bool_or(attr in ({strings(fixed.BUTTON_DIRECTIVES)}) and binding in ('attr', 'boundAttr')) as has_button, bool_or(attr = 'mat-menu-item') as has_menu,
  bool_or(attr in ('routerlink', 'href') and binding in ('attr', 'boundAttr')) as has_nav, bool_or(binding = 'event') as has_event from v_{x}attr group by all) a using (page_id, pos))
where kind is not null)"""
    VIEWS[f"v_{x}region"] = f"""
select o.page_id, o.pos, o.nm as name, o.start, min(c.pos) as close_pos, min(c.stop) as region_stop from (select *, sum(case token when 'open' then 1 when 'close' then -1 else 0 end) over (partition by page_id, nm order by pos) as r from v_{x}tok where nm <> '') o
join (select *, sum(case token when 'open' then 1 when 'close' then -1 else 0 end) over (partition by page_id, nm order by pos) as r from v_{x}tok where nm <> '') c
  on c.page_id = o.page_id and c.nm = o.nm and c.token = 'close' and c.pos > o.pos and c.r = o.r - 1 where o.token = 'open' group by all"""


markup_views("p", "pages")
markup_views("t", "v_template")
VIEWS["v_tpred"] = """
select a.page_id, a.pos as pred_pos, case when binding = 'structural' and attr = 'ngif' then 'ngIf' when binding = 'structural' and attr = 'ngswitchcase' then 'ngSwitchCase' when binding = 'structural' then 'customDirective' when attr in ('hidden', 'disabled') then attr else 'permissionDirective' end as predicate,
  case when binding = 'boundAttr' and attr = 'disabled' then 'enabled' else 'visible' end as rules,
  a.value as expr, a.start as from_at, case when binding = 'structural' then coalesce(r.region_stop, a.stop) else a.stop end as to_at
from v_tattr a left join v_tregion r on r.page_id = a.page_id and r.pos = a.pos
where (binding = 'structural' and attr not in ('ngfor', 'ngforof')) or (binding = 'boundAttr' and attr in ('hidden', 'disabled', 'showfor'))"""
VIEWS["v_tattach"] = "select w.page_id, w.widget_id, p.* exclude (page_id) from v_twid w join v_tpred p on p.page_id = w.page_id and w.start between p.from_at and p.to_at"
VIEWS["v_page_place"] = f"""
select *, split_part(host, '.', -1) as subject, split_part(path, '/', 2) as seg1, split_part(path, '/', 3) as seg2 from (select page_id, html, url, {fx.PAGE_HOST} as host, {fx.PAGE_PATH} as path from pages)"""
VIEWS["v_page_record"] = """
select distinct subject, 'root' as id, null as parent, '' as segment, null as redirect from v_page_place where seg1 <> '' union all select distinct subject, 'any', 'root', '**', null from v_page_place where seg1 <> ''
union all select subject, 'home', 'root', 'home', min(seg1) || '/' from v_page_place where seg1 <> '' group by all union all select distinct subject, seg1, 'root', seg1, null from v_page_place where seg1 <> ''
union all select distinct subject, seg1 || '-id', seg1, ':id', null from v_page_place where seg1 <> ''"""
VIEWS["v_page_flat"] = """
select subject, id, cast(null as varchar) as parent, case when segment = '' then '/' else '/' || segment end as full_path, '/' as base, segment, redirect from v_page_record where parent is null
union all select r.subject, r.id, f.id, case when f.full_path = '/' then '' else f.full_path end || '/' || r.segment, f.full_path, r.segment, r.redirect from v_page_flat f join v_page_record r on r.subject = f.subject and r.parent = f.id"""
VIEWS["v_page_candidate"] = """
select subject, page_id, '/' || seg1 as full_path, '/' || seg1 || '@' || host as id, seg2 as child, case when page_id % 7 = 0 then 'RedirectRoute' else 'ComponentRoute' end as route_type,
  case when page_id % 7 = 0 then '/' || (page_id % 3) end as redirect, case when page_id % 7 = 0 then null when url like 'https:%' then seg1 when page_id % 5 = 0 then '__unresolved__' || seg1 else '__unknown__' end as comp_id,
  list_filter([case when url like '%?%' then 'QueryGuard' end, case when url like '%#%' then 'HashGuard' end], lambda g: g is not null) as guards from v_page_place where seg1 <> ''"""

VIEWS["v_near_edge"] = """
select subject, from_id, to_id from v_edge where kind in ('COMPONENT_COMPOSES_COMPONENT', 'ROUTE_ACTIVATES_COMPONENT', 'MODULE_DECLARES_COMPONENT') union select subject, to_id, from_id from v_edge
where kind in ('COMPONENT_COMPOSES_COMPONENT', 'ROUTE_ACTIVATES_COMPONENT', 'MODULE_DECLARES_COMPONENT')"""
VIEWS["v_near"] = """
select subject, comp_id as node_id, 0 as hop from v_component where r = 7 union select n.subject, e.to_id, n.hop + 1 from v_near n join v_near_edge e on e.subject = n.subject and e.from_id = n.node_id where n.hop < 2"""

# ---- matching by turns ---------------------------------------------------------------------------

NUMBER = "('0x' || md5({})[1:10])::bigint"
VIEWS["v_rcand"] = f"""
select comp_id || '|' || trigger_kind as block, {NUMBER.format('workflow_id')} as cand, split_part(effect_group, '::', -1) as handler, split_part(widget_id, '|', 3) as tag
from v_workflow where effect_group is not null"""
VIEWS["v_rentry"] = f"""
select block, entry, case when h % 101 = 0 then 'other' else handler end as handler, case when h % 53 = 0 then 'Link' else kind end as tag, row_number() over (partition by block order by entry) as n from (
  select *, comp_id || '|' || case when event_type = 'link' then 'WIDGET_NAVIGATES_ROUTE' when event_type = 'submit' and kind = 'Form' then 'WIDGET_SUBMITS_FORM' else 'WIDGET_TRIGGERS_HANDLER' end as block,
    {NUMBER.format("widget_id || '~' || handler || '~' || seq")} as h, {NUMBER.format("'entry~' || widget_id || '~' || handler || '~' || seq")} as entry
  from (select comp_id, widget_id, handler, seq, kind, event_type from v_event where kind in ('Button', 'Link', 'Form')
    union all select comp_id, widget_id, 'routerLink', seq, 'Link', 'link' from v_binding where name = 'routerLink' and split_part(widget_id, '|', 3) = 'Link'))"""
# one turn of every block per step; the row carries the candidates that are still free
VIEWS["v_turn"] = """
select block, 0::bigint as n, null::bigint as entry, null::bigint as cand, free from (select distinct block from v_rentry)
  left join (select block, list({'cand': cand, 'handler': handler, 'tag': tag}) as free from v_rcand group by block) using (block)
union all
select block, n, entry, best % 2199023255552, list_filter(free, lambda x: best is null or x.cand <> best % 2199023255552) from (
  select t.block, e.n, e.entry, t.free, list_min(list_transform(t.free, lambda x: x.cand
    + case when x.handler = e.handler and x.tag = e.tag then 0 when x.handler = e.handler then 1 when x.tag = e.tag then 2 else 3 end * 2199023255552)) as best
  from v_turn t join v_rentry e on e.block = t.block and e.n = t.n + 1)"""
