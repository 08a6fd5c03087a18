"""S, K and Z queries: artifacts, streams and scalar functions."""

import uuid

from pyspark.sql import functions as F

from loomgraph.catalog.oracle_views import GENERIC, MANIFESTS, fnv
from loomgraph.catalog.registry import query
from loomgraph.catalog.shared import flow, graph
from loomgraph.functions import scalar as sc
from loomgraph.functions.scale import session_conf, shared_folder
from loomgraph.operators import evidence as ev
from loomgraph.operators.graph import canonical_order
from loomgraph.sources import bundles as bu
from loomgraph.streaming import jobs as kj


def n():
    return F.count(F.lit(1)).alias("n")


def folder(t, name):
    return f"{shared_folder(t.spark)}/artifact-{name}-{uuid.uuid4().hex}"


def put_lines(t, df, name):
    path = folder(t, name)
    with session_conf(t.spark, spark__sql__requireAllClusterKeysForCoPartition="false"):  # rows of a phase that isn't written stay where they are
        df.write.option("compression", "gzip").json(path)
    return path


# ---- artifacts: written as one document per line, then read back ------------------------------


@query("S1_graph_bundles", "subject:s node_id:s n_edges:i n_gated:i", """
select c.subject, c.comp_id as node_id, count(e.edge_id) as n_edges, count(e.inside_ng_if) as n_gated from v_component c left join v_edge e on e.kind = 'COMPONENT_COMPOSES_COMPONENT' and e.from_id = c.comp_id group by all""")
def graph_bundles(t):
    e = flow(t).composes.select("subject", F.col("from_id").alias("comp_id"), F.struct(
        F.col("edge_id").alias("id"), "kind", F.col("from_id").alias("from"), F.col("to_id").alias("to"),
        F.struct(F.col("inside_ng_if").alias("insideNgIf")).alias("compositionContext")).alias("e"))
    per = e.groupBy("subject", "comp_id").agg(F.collect_list("e").alias("edges"))  # a component has few references
    docs = t.components.join(per, ["subject", "comp_id"], "left").select("subject", F.struct(
        F.array(F.struct(F.col("comp_id").alias("id"), F.lit("Component").alias("kind"), F.col("class_name").alias("label"))).alias("nodes"),
        F.coalesce("edges", F.array().cast(per.schema["edges"].dataType)).alias("edges")).alias("multigraph"))
    nodes, edges = bu.read_graph(t.spark, put_lines(t, docs, "graph"), lines=True)
    counts = edges.groupBy("subject", F.col("from").alias("id")).agg(F.count(F.lit(1)).alias("n_edges"), F.count("compositionContext.insideNgIf").alias("n_gated"))
    return nodes.join(counts, ["subject", "id"], "left").select("subject", F.col("id").alias("node_id"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"), F.coalesce("n_gated", F.lit(0)).alias("n_gated"))


@query("S2_workflow_sets", "subject:s verdict:s n:i n_steps:i n_params:i", """
select subject, verdict, count(*) as n, sum(n_steps) as n_steps, sum(len(params)) as n_params from v_workflow group by all""")
def workflow_sets(t):
    docs = flow(t).workflow_rows.select("subject", F.array(F.struct(
        F.col("workflow_id").alias("id"), F.transform("steps", lambda s: F.struct(s["edge_id"].alias("edgeId"), s["kind"].alias("kind"))).alias("steps"),
        F.col("terminal_id").alias("terminalNodeId"), F.struct(F.col("params").alias("requiredParams"), "guards", "roles").alias("cw"), "verdict")).alias("workflows"))
    w = bu.read_workflows(t.spark, put_lines(t, docs, "workflows"), lines=True)
    return w.groupBy("subject", "verdict").agg(n(), F.sum(F.size("steps")).alias("n_steps"), F.sum(F.size("cw.requiredParams")).alias("n_params"))


@query("S3_optional_stages", "subject:s n_results:i n_plans:i duration_ms:i", """
select subject, count(*) as n_results, 0 as n_plans, sum(duration_ms) as duration_ms from v_fold group by all""")
def stages(t):
    r = ev.fold_attempts(t.attempts)
    docs = r.select("subject", F.array(F.struct(F.col("test_id").alias("workflowId"), "outcome", F.col("attempts").cast("bigint").alias("attempts"), F.col("duration_ms").alias("durationMs"))).alias("results"))
    results = bu.read_stage(t.spark, put_lines(t, docs, "results"), "results", lines=True)
    plans = bu.read_stage(t.spark, folder(t, "absent"), "plans", lines=True)
    p = plans.groupBy("subject").agg(F.count(F.lit(1)).alias("n_plans"))
    return results.groupBy("subject").agg(F.count(F.lit(1)).alias("n_results"), F.sum("durationMs").alias("duration_ms")).join(p, "subject", "left").na.fill(0)


@query("S4_test_logs", "test_id:s n_steps:i n_requests:i first_status:i", """
select test_id, count(*) as n_steps, count(*) filter (length(text) % 2 = 0) as n_requests, coalesce(arg_min(200 + length(text) % 4, pos) filter (length(text) % 2 = 0), -1) as first_status from v_step group by all""")
def logs(t):
    request = F.array(F.struct(F.lit("/x").alias("url"), F.lit("GET").alias("method"), (200 + F.length("text") % 4).cast("bigint").alias("status")))
    s = t.steps.select("subject", "test_id", F.struct("pos", F.col("step_id").alias("stepId"), F.col("ts_start").alias("timestampStart"), F.col("ts_end").alias("timestampEnd"),
                                                      F.when(F.length("text") % 2 == 0, request).alias("networkEvidence")).alias("s"))
    docs = s.groupBy("subject", "test_id").agg(F.array_sort(F.collect_list("s")).alias("steps"))  # the steps of one test
    docs = docs.select("subject", F.col("test_id").alias("workflowId"), F.col("test_id").alias("testFile"), F.lit("FAIL").alias("outcome"), "steps")
    found, steps, requests = bu.read_logs(t.spark, put_lines(t, docs, "logs"), lines=True)
    r = requests.groupBy("testFile").agg(F.count(F.lit(1)).alias("n_requests"), F.min_by("status", "pos").alias("first_status"))
    return (found.select(F.col("testFile").alias("test_id")).join(steps.groupBy(F.col("testFile").alias("test_id")).agg(F.count(F.lit(1)).alias("n_steps")), "test_id")
            .join(r.withColumnRenamed("testFile", "test_id"), "test_id", "left").na.fill({"n_requests": 0}))


@query("S5_manifests", "load_error:i n:i n_accounts:i n_text_passwords:i n_named:i n_params:i n_skip_lists:i n_logins:i login_fields:i n_run_settings:i n_seeds:i n_wrong:i", f"""
select j is null as load_error, count(*) as n, coalesce(sum(case when json_type(j, '$.accounts') = 'ARRAY' then json_array_length(j, '$.accounts') end), 0) as n_accounts,
  count(*) filter (json_type(j, '$.accounts') = 'ARRAY' and json_type(j, '$.accounts[0].password') = 'VARCHAR') as n_text_passwords, count(*) filter (json_type(j, '$.subjectName') = 'VARCHAR') as n_named,
  count(*) filter (json_type(j, '$.routeParamValues') = 'OBJECT') as n_params, count(*) filter (json_type(j, '$.skipWorkflows') = 'ARRAY') as n_skip_lists,
  count(*) filter (json_type(j, '$.authSetup') = 'OBJECT') as n_logins, coalesce(sum(case when json_type(j, '$.authSetup') = 'OBJECT' then len(json_keys(j, '$.authSetup')) end), 0) as login_fields,
  count(*) filter (json_type(j, '$.executionConfig') = 'OBJECT') as n_run_settings, count(*) filter (json_type(j, '$.seedRequirements') = 'OBJECT') as n_seeds,
  count(*) filter (json_type(j, '$.subjectName') <> 'VARCHAR') + count(*) filter (json_type(j, '$.accounts') <> 'ARRAY') + count(*) filter (json_type(j, '$.skipWorkflows') <> 'ARRAY') as n_wrong
from {MANIFESTS} group by all""")
def manifests(t):
    path = folder(t, "manifests")
    t.manifest_texts.select(F.col("text").alias("value")).write.text(path)
    m = bu.read_manifests(t.spark, path, lines=True)
    text_password = F.exists("accounts", lambda a: sc.is_variant(F.try_variant_get(a, "$.password", "variant"), "string"))
    size = lambda c: F.sum(F.when(F.col(c).isNull(), 0).otherwise(F.size(c)))
    return m.groupBy("load_error").agg(
        n(), size("accounts").alias("n_accounts"), F.count_if(text_password).alias("n_text_passwords"), F.count("subject_name").alias("n_named"), F.count("route_param_values").alias("n_params"),
        F.count("skip_workflows").alias("n_skip_lists"), F.count("auth_setup").alias("n_logins"), size("auth_setup").alias("login_fields"), F.count("execution_config").alias("n_run_settings"),
        F.count("seed_requirements").alias("n_seeds"), size("wrong_fields").alias("n_wrong"))


@query("S6_reference_entries", "subject:s cls:s n:i n_auth:i", """
select d.source as subject, 'D' || (l.doc_id % 7 + 1) as cls, count(*) as n, count(*) filter (l.quality = 1) as n_auth from labels l join documents d using (doc_id) group by all""")
def truth(t):
    docs = t("labels").join(t("documents").select("doc_id", "source"), "doc_id").select(F.col("source").alias("subject"), F.array(F.struct(
        F.concat(F.lit("GT-"), F.col("doc_id").cast("string")).alias("gtId"), F.concat(F.lit("D"), (F.col("doc_id") % 7 + 1).cast("string")).alias("difficultyClass"),
        F.struct((F.col("quality") == 1).alias("requiresAuth")).alias("expectedIntent"))).alias("entries"))
    e = bu.read_truth(t.spark, put_lines(t, docs, "truth"), lines=True)
    return e.groupBy("subject", F.col("difficultyClass").alias("cls")).agg(n(), F.count_if("expectedIntent.requiresAuth").alias("n_auth"))


@query("S7_registries", "subject:s name:s n_declared:i", """
select m.subject, m.name, count(d.class_name) as n_declared from v_module m left join v_declaration d on d.module_id = m.module_id group by all""")
def registries(t):
    # modules name a bounded set of classes: the components of one application
    d = t.declarations.groupBy("subject", "module_id").agg(F.collect_list("class_name").alias("declarations"))
    docs = t.modules.join(d, ["subject", "module_id"], "left").select("subject", F.array(F.struct(F.col("module_id").alias("id"), "name", "declarations")).alias("modules"))
    m = bu.read_registry(t.spark, put_lines(t, docs, "modules"), "modules", lines=True)
    return m.select("subject", "name", F.coalesce(F.size("declarations"), F.lit(0)).alias("n_declared")).withColumn("n_declared", F.greatest("n_declared", F.lit(0)))


@query("S8_complete_subjects", "subject:s", """
select distinct subject from v_module where g = 0 and exists (select 1 from v_component c where c.subject = v_module.subject and c.r = 20)""")
def complete(t):
    named = t.modules.where("g = 0").selectExpr("subject", "'a1-multigraph.json' as name").unionByName(
        t.components.where("r = 20").selectExpr("subject", "'a2-workflows.json' as name")).unionByName(t.components.selectExpr("subject", "'notes.json' as name"))
    return bu.complete_subjects(named)


@query("S9_append_events", "event_type:s n:i", "select event_type, 2 * count(*) as n from events group by all")
def append(t):
    path = folder(t, "events")
    e = t("events").select(F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_type").alias("event"), F.lit("run").alias("phase"))
    bu.append_events(e, path)
    bu.append_events(e, path)
    return t.spark.read.schema(bu.EVENT_SCHEMA).json(path).groupBy(F.col("event").alias("event_type")).agg(n())


@query("S10_canonical_text", "value:s", """
select '{"full_path":"' || full_path || '","n":' || n || ',"route_id":"' || route_id || '","subject":"' || subject || '"}' as value from v_route""")
def canonical(t):
    path = folder(t, "canonical")
    bu.write_canonical(t.routes.select("subject", "route_id", "full_path", "n"), ["subject", "route_id"], path)
    return t.spark.read.text(path)


@query("S11_artifact_tables", "subject:s kind:s n:i", "select subject, kind, count(*) as n from v_edge where kind in ('ROUTE_HAS_CHILD', 'ROUTE_REDIRECTS_TO_ROUTE', 'COMPONENT_COMPOSES_COMPONENT') group by all")
def artifacts(t):
    path = folder(t, "edges")
    e = graph(t).of_kind("ROUTE_HAS_CHILD", "ROUTE_REDIRECTS_TO_ROUTE").unionByName(flow(t).composes)
    bu.write_artifact(canonical_order(e), path, files_per_subject=2)
    return t.spark.read.parquet(path).groupBy("subject", "kind").agg(n())


@query("S12_report_tables", "what:s n:i", "select 'outcome' as what, count(distinct outcome) as n from v_fold where outcome <> 'PASS' union all select 'tests', count(*) from v_fold")
def reports(t):
    path = folder(t, "report")
    r = ev.fold_attempts(t.attempts)
    bu.write_reports({"per_test": r, "by_outcome": ev.failure_counts(r, t.logs)}, path)
    per, by = t.spark.read.parquet(f"{path}/per_test"), t.spark.read.parquet(f"{path}/by_outcome")
    return by.where("what = 'outcome'").groupBy("what").agg(n()).unionByName(per.groupBy(F.lit("tests").alias("what")).agg(n()))


@query("S13_viewer_export", "what:s kind:s n:i", """
select 'node' as what, kind, count(*) as n from v_node where kind in ('Route', 'Component') group by all union all select 'edge', kind, count(*) from v_edge where kind = 'COMPONENT_COMPOSES_COMPONENT' group by all""")
def export(t):
    path = folder(t, "viewer")
    bu.export_graph(graph(t).nodes.where("kind in ('Route', 'Component')"), flow(t).composes.select("subject", "edge_id", "from_id", "to_id", "kind"), path)
    def counted(part, what):
        return t.spark.read.schema("kind string").json(f"{path}/{part}").groupBy("kind").agg(n()).withColumn("what", F.lit(what))
    return counted("nodes", "node").unionByName(counted("edges", "edge"))


# ---- streams ------------------------------------------------------------------------------------

CLOSED = "(select max(ts) - interval 10 minutes from events)"


# The events arrive as JSON lines in slices of equal time; a job reads one slice per batch.
SLICES = 3


def arriving(t, rows=None):
    return kj.replayed(t.pipeline_events if rows is None else rows, "ts", SLICES)


@query("K1_event_ingest", "event_type:s n:i first_id:i last_id:i", "select event_type, count(*) as n, min(event_id) as first_id, max(event_id) as last_id from events group by all")
def ingest(t):
    table = kj.run(arriving(t))
    return table.groupBy("event_type").agg(n(), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("K2_windowed_counts", "start:s phase:s severity:s outcome:s n:i", f"""
select strftime(w, '%Y-%m-%d %H:%M') as start, phase, severity, outcome, count(*) as n from (select *, time_bucket(interval 1 hour, ts) as w from v_pipeline_event)
where w + interval 1 hour <= {CLOSED} group by all""")
def windows(t):
    table = kj.run(kj.windowed_counts(arriving(t), ["phase", "severity", "outcome"]))
    return table.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


@query("K3_run_sessions", "user_id:i start:s n:i", f"""
with gaps as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as fresh from events),
islands as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as island from gaps)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from islands group by user_id, island having max(ts) + interval 30 minutes <= {CLOSED}""")
def sessions(t):
    return kj.run(kj.run_sessions(arriving(t))).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


def attempt_stream(t):
    return arriving(t, t.attempt_events)


@query("K4_completed_once", "n:i n_tests:i", "select count(distinct (user_id, cast(ts as date), event_id % 3)) as n, count(distinct (user_id, cast(ts as date))) as n_tests from events")
def once(t):
    table = kj.run(kj.completed_once(attempt_stream(t)))
    return table.groupBy("test_id").agg(F.count(F.lit(1)).alias("c")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_tests"))


@query("K5_live_attempt_fold", "test_id:s attempts:i duration_ms:i outcome:s", "select test_id, attempts, duration_ms, outcome from v_fold")
def live(t):
    return kj.run(kj.live_results(attempt_stream(t)), mode="update", keys=["test_id"])


@query("K6_stale_evidence", "stale:i n:i", "select ts < date_trunc('day', ts) + (event_id % 24) * interval 1 hour - interval 5 seconds as stale, count(*) as n from events group by all")
def stale(t):
    e = arriving(t).withColumn("run_start", F.expr("date_trunc('day', ts) + make_interval(0, 0, 0, 0, cast(event_id % 24 as int))"))
    fresh, old = kj.route_stale(e, "run_start")
    return fresh.unionByName(old).groupBy("stale").agg(n())


# the attempts that came in up to the end of a step, folded
STEPS = f"""
span as (select min(epoch_us(ts)) as low, max(epoch_us(ts)) as high from events),
edge as (select step, low + (high - low) * (step + 1) // {SLICES} as upto from span, (select unnest(range({SLICES})) as step)),
seen as (select step, a.* from edge, v_attempt a where epoch_us(a.ts) <= upto and attempt <= 3),
cut as (select *, min(case when outcome in ('PASS', 'FAIL_APP_NOT_READY') then attempt end) over (partition by step, test_id) as stop from seen),
result as (select step, test_id, arg_max(outcome, attempt) as outcome from cut where stop is null or attempt <= stop group by all)"""


@query("K7_running_coverage", "step:i subject:s total:i pruned:i executed:i passed:i failed:i not_ready:i skipped:i c1:d c2:d c3:d", f"""
with {STEPS},
state as (select step, t.*, outcome is not null as ran, case when verdict = 'PRUNED' then 'PRUNED' when outcome = 'FAIL_APP_NOT_READY' then 'NOT_READY' when skipped then 'SKIPPED'
  when outcome = 'PASS' then 'PASS' when outcome is not null then 'FAIL' end as state from v_test t cross join (select step from edge) left join result using (step, test_id)),
figures as (select step, subject, count(*) as total, count(*) filter (state = 'PRUNED') as pruned, count(*) filter (ran) as executed, count(*) filter (state = 'PASS') as passed,
  count(*) filter (state = 'FAIL') as failed, count(*) filter (state = 'NOT_READY') as not_ready, count(*) filter (state = 'SKIPPED') as skipped,
  count(*) filter (verdict <> 'PRUNED' and has_plan) as p, count(*) filter (verdict <> 'PRUNED' and has_code) as c from state group by all)
select * exclude (p, c), case when total > pruned then p / (total - pruned) else 0 end as c1, case when total > pruned then c / (total - pruned) else 0 end as c2,
  case when total - pruned - not_ready - skipped > 0 then passed / (total - pruned - not_ready - skipped) else 0 end as c3 from figures""")
def coverage(t):
    rows, folder = t.attempt_events, kj.new_folder(t.spark)
    edges = kj.slice_edges(rows, "ts", SLICES)
    job = None
    for after, upto in zip(edges, edges[1:]):
        kj.deliver(rows, "ts", folder, after, upto)
        job = job or kj.RunningCoverage(kj.json_event_stream(t.spark, folder, rows.schema), t.tests)
        job.step()
    return job.tiers()


@query("K7_live_attribution", "test_id:s req:i pos:i status:i", "select r.test_id, r.req, s.pos, r.status from v_request r join v_step s on s.test_id = r.test_id and r.ts between s.ts_start and s.ts_end")
def live_attribution(t):
    requests = kj.replayed(t.requests.select("test_id", "req", "ts", "status"), "ts", SLICES)
    steps = kj.replayed(t.steps.select("test_id", "pos", "ts_start", "ts_end"), "ts_start", SLICES)
    return kj.run(kj.live_attribution(requests, steps, longest="2 minutes"))


@query("K8_pass_rate", "start:s n:i passed:i rate:d", f"""
select strftime(w, '%Y-%m-%d %H:%M') as start, count(*) as n, count(*) filter (event_type = 'purchase') as passed, count(*) filter (event_type = 'purchase') / count(*) as rate
from (select *, time_bucket(interval 15 minutes, ts) - i * interval 15 minutes as w from events, (values (0), (1), (2), (3)) x(i)) where w + interval 1 hour <= {CLOSED} group by all""")
def pass_rate(t):
    return kj.run(kj.pass_rate(attempt_stream(t))).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


# ---- scalar functions -----------------------------------------------------------------------------


@query("Z1_fnv_hash", "url:s padded:s suffix:s", f"select url, printf('%08x', {fnv('url')}) as padded, left(lower(to_hex({fnv('url')})), 4) as suffix from (select distinct url from pages)")
def fnv_hash(t):
    return t("pages").select("url").distinct().select("url", sc.fnv1a32_hex("url").alias("padded"), sc.fnv1a32_suffix("url").alias("suffix"))


@query("Z2_truncated", "doc_id:i text:s", "select doc_id, case when length(text) > 200 then text[1:199] || '…' else text end as text from documents")
def truncated(t):
    return t("documents").select("doc_id", sc.truncate("text", 200).alias("text"))


@query("Z3_paths", "page_id:i joined:s redirect:s params:s", """
select page_id, case when seg1 = '' then '/' else '/' || seg1 end || '/' || ':p' || (page_id % 3) || '/:a' as joined, case when page_id % 2 = 0 then '/' || seg2 else case when seg1 = '' then '' else '/' || seg1 end || case when seg2 = '' then '' else '/' || seg2 end end as redirect,
  array_to_string(list_sort(['p' || (page_id % 3), 'a']), ',') as params from v_page_place where seg1 <> '' and seg2 <> ''""")
def paths(t):
    p = t.page_places.where("seg1 <> '' and seg2 <> ''").withColumn("base", F.concat(F.lit("/"), "seg1"))
    joined = sc.join_path("base", F.concat(F.lit(":p"), (F.col("page_id") % 3).cast("string"), F.lit("/:a")))
    target = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/"), "seg2", F.lit("//"))).otherwise(F.col("seg2"))
    return p.select("page_id", joined.alias("joined"), sc.redirect_path(target, "base").alias("redirect"), F.array_join(sc.path_params(joined), ",").alias("params"))


@query("Z4_capitalised", "c_custkey:i name:s", "select c_custkey, upper(x[1:1]) || x[2:] as name from (select c_custkey, lower(c_mktsegment) || 'Svc' as x from customer)")
def capitalised(t):
    return t("customer").select("c_custkey", sc.capitalise(F.concat(F.lower("c_mktsegment"), F.lit("Svc"))).alias("name"))


EXPR = "case doc_id % 6 when 0 then ' true' when 1 then 'false ' when 2 then 'item.name' when 3 then 'a b' when 4 then '$x' else text end"


@query("Z5_literal_boolean", "doc_id:i value:s", f"select doc_id, case when trim({EXPR}) in ('true', 'false') then trim({EXPR}) end as value from documents")
def literal_boolean(t):
    return t("documents").select("doc_id", sc.literal_boolean(F.expr(EXPR)).alias("value"))


@query("Z6_binding_expression", "doc_id:i value:i", f"select doc_id, regexp_matches(trim({EXPR}), '^[a-zA-Z_$][a-zA-Z0-9_$.]*$') as value from documents")
def binding_expression(t):
    return t("documents").select("doc_id", sc.is_binding_expression(F.expr(EXPR)).alias("value"))


@query("Z7_tag_position", "widget_id:s value:s", "select widget_id, tag_name || ':' || (p + 1) as value from v_widget")
def tag_position(t):
    return t.widgets.select("widget_id", sc.tag_position("widget_id", "tag_name").alias("value"))


@query("Z8_entity_family", "subject:s full_path:s family:s", """
select subject, full_path, case when list_position(s, ':id') is null or list_position(s, ':id') <= 1 then coalesce(s[1], 'root') else s[cast(list_position(s, ':id') as int) - 1] end as family from (select *, list_filter(string_split(full_path, '/'), lambda x: x <> '') as s from v_route)""")
def family(t):
    return t.routes.select("subject", "full_path", sc.entity_family("full_path", F.lit("id")).alias("family"))


@query("Z9_negative_guards", "guard:s narrow:i wide:i n:i", """
select guard, contains(lower(guard), 'noauth') as narrow, contains(lower(guard), 'noauth') or contains(lower(guard), 'unauth') as wide, count(*) as n
from (select case c_custkey % 4 when 0 then 'NoAuthGuard' when 1 then 'UnAuthGuard' when 2 then 'AuthGuard' else c_mktsegment end as guard from customer) group by all""")
def negative_guards(t):
    g = t("customer").selectExpr("case c_custkey % 4 when 0 then 'NoAuthGuard' when 1 then 'UnAuthGuard' when 2 then 'AuthGuard' else c_mktsegment end as guard")
    return g.groupBy("guard", sc.is_negative_guard("guard").alias("narrow"), sc.is_negative_guard("guard", wide=True).alias("wide")).agg(n())


@query("Z10_sorted_unique", "doc_id:i words:s", "select doc_id, array_to_string(list_sort(list_distinct(string_split(text, ' '))), ' ') as words from documents")
def sorted_unique(t):
    return t("documents").select("doc_id", F.array_join(sc.sorted_unique(F.split("text", " ")), " ").alias("words"))


@query("Z11_short_names", "workflow_id:s name:s", """
select edge_id as workflow_id, printf('%08x', list_reduce(list_prepend(0::bigint, list_transform(string_split(edge_id, ''), lambda c: unicode(c)::bigint)), lambda h, c: (h * 31 + c) & 4294967295)) || '_' || regexp_extract(edge_id, '#([^|]*)[|]', 1) || '_' ||
  case kind when 'WIDGET_TRIGGERS_HANDLER' then 'WTH' when 'WIDGET_SUBMITS_FORM' then 'WSF' when 'WIDGET_NAVIGATES_ROUTE' then 'WNR' else 'WNE' end as name from v_trigger""")
def short_names(t):
    return flow(t).triggers.select(F.col("edge_id").alias("workflow_id"), sc.short_test_name("edge_id").alias("name"))


@query("Z12_id_parts", "class_name:s widget_kind:s edge_kind:s n:i", """
select regexp_extract(from_id, '#([^|]*)[|]', 1) as class_name, split_part(from_id, '|', 3) as widget_kind, kind as edge_kind, count(*) as n from v_trigger group by all""")
def id_parts(t):
    return flow(t).triggers.select(sc.id_parts("edge_id").alias("p")).select("p.*").groupBy("class_name", "widget_kind", "edge_kind").agg(n())


@query("Z13_percent", "subject:s share:d", "select subject, round(1e2 * count(*) filter (outcome = 'PASS') / count(*), 1) as share from v_fold group by all")
def percent(t):
    r = ev.fold_attempts(t.attempts)
    c = r.groupBy("subject").agg(F.count_if(F.col("outcome") == "PASS").alias("p"), F.count(F.lit(1)).alias("c"))
    return c.select("subject", sc.percent1("p", "c").alias("share"))


@query("Z14_generic_classes", "a_class:s generic:i n:i", f"select a_class, {GENERIC.format('a_class')} as generic, count(*) as n from v_widget where a_class is not null group by all")
def generic(t):
    c = t.widgets.select(F.try_element_at("attributes", F.lit("class")).alias("a_class")).where("a_class is not null")
    return c.groupBy("a_class").agg(n()).withColumn("generic", sc.all_classes_generic("a_class"))
