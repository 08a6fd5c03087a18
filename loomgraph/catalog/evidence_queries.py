"""E queries: evidence and coverage."""

from pyspark.sql import functions as F

from loomgraph.catalog.registry import query
from loomgraph.operators import evidence as ev

HAS = "contains(x, '{}')"


def has(*words):
    return "(" + " or ".join(HAS.format(w) for w in words) + ")"


# error texts: passages of documents with an error word put in by document number
ERROR_WORD = ("case doc_id % 12 when 0 then 'NoSuchElementError' when 1 then 'AssertionError' when 2 then 'assert Expected URL' when 3 then 'timed out' "
              "when 4 then 'auth-setup' when 5 then 'Waiting for' when 6 then 'invalid element state' when 7 then 'auth-setup timed out' when 8 then 'net::ERR_' "
              "when 9 then 'element not interactable' when 10 then 'Unable to locate element' else '' end")


@query("E1_outcome_of_error", "doc_id:i outcome:s auth_context:i", f"""
select doc_id, case when {has('NoSuchElementError', 'StaleElementReferenceError', 'InvalidArgumentError', 'ElementNotInteractableError', 'invalid element state')} then 'FAIL_ELEMENT_NOT_FOUND'
  when {has('AssertionError')} or ({has('assert')} and {has('Expected URL')}) then 'FAIL_ASSERTION' when {has('TimeoutError', 'Waiting for', 'timed out', 'ETIMEDOUT')} then 'FAIL_TIMEOUT'
  when {has('auth-setup', 'Auth setup')} then 'FAIL_AUTH' else 'FAIL_UNKNOWN' end as outcome, {has('auth-setup', 'Auth setup', '/login')} as auth_context
from (select doc_id, text || chr(10) || {ERROR_WORD} as x from documents)""")
def outcomes(t):
    d = t("documents").selectExpr("doc_id", "text", f"{ERROR_WORD} as word")
    return d.select("doc_id", ev.outcome_of_error(F.col("text"), F.col("word")).alias("outcome"),
                    ev.auth_context(F.col("text"), F.col("word")).alias("auth_context"))


@query("E2_step_failure", "doc_id:i failure_kind:s element_found:i", f"""
select doc_id, k as failure_kind, k in ('interaction-failed', 'assertion-failed') as element_found from (
  select doc_id, case when doc_id % 5 = 4 or {has('no such element', 'Unable to locate element')} then 'locator-not-found' when {has('not interactable')} then 'interaction-failed'
    when {has('Wait timed out', 'Timed out')} then 'timeout' when {has('assert', 'AssertionError')} then 'assertion-failed' when {has('navigation', 'net::ERR_')} then 'navigation-failed' else 'unknown' end as k
  from (select doc_id, text || ' ' || {ERROR_WORD} as x from documents))""")
def step_failures(t):
    d = t("documents").selectExpr("doc_id", "case when doc_id % 5 = 4 then 'NoSuchElementError' end as name", f"text || ' ' || {ERROR_WORD} as message")
    return d.select("doc_id", ev.step_failure(F.col("name"), F.col("message")).alias("f")).select("doc_id", "f.*")


@query("E3_attempt_fold", "test_id:s subject:s attempts:i duration_ms:i outcome:s", "select * from v_fold")
def fold(t):
    return ev.fold_attempts(t.attempts)


def readiness(t):
    return t.tests.select("subject").distinct().withColumn("passed", F.col("subject") != "u4")


def ready_results(t):
    return ev.not_ready(ev.fold_attempts(t.attempts), readiness(t))


def logs(t):
    return t.tests.select("test_id", "run_start", "log_exists", "log_time", "log_outcome", "log_steps", "log_broken")


def verified(t):
    return ev.verify_integrity(ready_results(t), logs(t))


READY = ("(select test_id, subject, user_id, case when subject = 'u4' then 'FAIL_APP_NOT_READY' else outcome end as outcome, case when subject = 'u4' then 0 else attempts end as attempts, "
         "case when subject = 'u4' then 0 else duration_ms end as duration_ms from v_fold)")
REASON = ("case when f.outcome <> 'PASS' then null when t.k % 11 = 0 then 'missing' when t.k % 13 = 0 then 'stale' when t.k % 17 = 0 then 'broken' when t.k % 7 = 0 then 'disagrees' "
          "when t.k % 5 = 0 then 'no_steps' end")
VERIFIED = f"(select *, case when reason is null then outcome0 else 'FAIL_INTEGRITY' end as outcome from (select f.* exclude (outcome), f.outcome as outcome0, t.k, {REASON} as reason from {READY} f join v_test t using (test_id)))"


@query("E4_not_ready", "subject:s outcome:s n:i attempts:i", f"select subject, outcome, count(*) as n, sum(attempts) as attempts from {READY} group by all")
def not_ready(t):
    return ready_results(t).groupBy("subject", "outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("attempts").alias("attempts"))


@query("E5_integrity", "test_id:s outcome:s reason:s", f"select * from {VERIFIED}")
def integrity(t):
    return verified(t)


@query("E6_run_selection", "test_id:s action:s", """
select test_id, 'run' as action from v_test join v_fold f using (test_id) where not skipped and v_test.user_id % 3 <> 0 and f.outcome <> 'PASS' and k % 10 <> 1
union all select test_id, 'carry' from v_test join v_fold f using (test_id) where f.outcome = 'PASS' or k % 10 = 1""")
def selection(t):
    results = ev.fold_attempts(t.attempts)
    done = t.tests.where("k % 10 = 1")
    return ev.select_tests(t.tests, skip=t.tests.where("skipped"), only=t.tests.where("user_id % 3 <> 0"), prior=results, completed=done)


@query("E7_run_stats", "subject:s total:i skipped:i passed:i failed:i not_ready:i duration_ms:i", f"""
select t.subject, count(*) as total, count(*) filter (skipped) as skipped, count(*) filter (f.outcome = 'PASS') as passed,
  count(*) filter (f.outcome not in ('PASS', 'FAIL_APP_NOT_READY')) as failed, count(*) filter (f.outcome = 'FAIL_APP_NOT_READY') as not_ready, sum(duration_ms) as duration_ms
from v_test t join {READY} f using (test_id) group by all""")
def run_stats(t):
    return ev.run_stats(ready_results(t), t.tests)


ATTRIBUTED = """(select r.test_id, r.req, s.pos, r.method, r.status, true as inside from v_request r join v_step s on s.test_id = r.test_id and r.ts between s.ts_start and s.ts_end
union all select r.test_id, r.req, (select max(pos) from v_step s where s.test_id = r.test_id), r.method, r.status, false from v_request r
where not exists (select 1 from v_step s where s.test_id = r.test_id and r.ts between s.ts_start and s.ts_end))"""


@query("E8_request_attribution", "test_id:s req:i pos:i method:s status:i inside:i", f"select * from {ATTRIBUTED}")
def attribution(t):
    return ev.attribute_requests(t.requests, t.steps)


@query("E9_request_histogram", "what:s value:s n:i", """
select 'method' as what, method as value, count(*) as n from v_attempt group by all union all select 'status', status || '', count(*) from v_attempt group by all""")
def histogram(t):
    return ev.request_histogram(t.attempts)


@query("E9_status_text", "test_id:s n_requests:i statuses:s", """
select test_id, sum(n) as n_requests, string_agg(status || '×' || n, ' ' order by status) as statuses from (select test_id, status, count(*) as n from v_attempt group by all) group by all""")
def status_text(t):
    return ev.status_text(t.attempts)


def entries(t):
    wf = t.tests.select("subject", F.col("test_id").alias("workflow_id"), "verdict", "skipped", F.col("has_plan").alias("p0"), F.col("has_code").alias("c0"))
    results = ready_results(t).withColumnRenamed("test_id", "workflow_id").join(wf.where("c0").select("workflow_id"), "workflow_id", "left_semi")
    return ev.coverage_entries(wf.drop("p0", "c0"), wf.where("p0"), wf.where("c0"), results)


ENTRY = f"(select t.subject, t.test_id as workflow_id, t.verdict, t.skipped, t.has_plan, t.has_code, case when t.has_code then f.outcome end as outcome from v_test t join {READY} f using (test_id))"
COVER = f"""
select subject, is_total, total, pruned, not_ready, skipped, with_plan, with_code, passed,
  case when total - pruned > 0 then with_plan / (total - pruned) else 0 end as c1, case when total - pruned > 0 then with_code / (total - pruned) else 0 end as c2,
  case when total - pruned - not_ready - skipped > 0 then passed / (total - pruned - not_ready - skipped) else 0 end as c3
from (select subject, grouping(subject) as is_total, count(*) as total, count(*) filter (state = 'PRUNED') as pruned, count(*) filter (state = 'NOT_READY') as not_ready,
  count(*) filter (state = 'SKIPPED') as skipped, count(*) filter (state <> 'PRUNED' and has_plan) as with_plan, count(*) filter (state <> 'PRUNED' and has_code) as with_code, count(*) filter (state = 'PASS') as passed
  from (select *, case when verdict = 'PRUNED' then 'PRUNED' when outcome = 'FAIL_APP_NOT_READY' then 'NOT_READY' when e.skipped then 'SKIPPED' when outcome = 'PASS' then 'PASS' else 'OTHER' end as state from {ENTRY} e)
  group by rollup (subject))"""


@query("E10_coverage_entries", "workflow_id:s verdict:s has_plan:i has_code:i outcome:s", f"select * from {ENTRY}")
def coverage_entries(t):
    return entries(t)


@query("E11_coverage_tiers", "subject:s is_total:i total:i pruned:i not_ready:i skipped:i with_plan:i with_code:i passed:i c1:d c2:d c3:d", COVER)
def tiers(t):
    return ev.coverage(entries(t))


@query("E11_median_execution", "median_c3:d total_c3:d n_subjects:i", f"""
select median(c3) filter (is_total = 0) as median_c3, max(c3) filter (is_total = 1) as total_c3, count(*) filter (is_total = 0) as n_subjects from ({COVER})""")
def median_tier(t):
    return ev.median_execution(ev.coverage(entries(t)))


@query("E12_failure_counts", "what:s value:s n:i", f"""
select 'outcome' as what, outcome as value, count(*) as n from {VERIFIED} where outcome <> 'PASS' group by all
union all select 'failure_kind', failure_kind, count(*) from v_log group by all""")
def failure_counts(t):
    return ev.failure_counts(verified(t), t.logs)


FAMILY = f"""
select l.test_id, l.subject, l.failed_step_id, case when starts_with(l.failed_step_id, 'post-') then case when a.rejected then 'backend-rejection' when a.accepted then 'postcondition-oracle' else 'postcondition-timeout' end
  when starts_with(l.failed_step_id, 'pre-') then 'precondition-failure' when failure_kind = 'interaction-failed' then 'interaction-blocked' when failure_kind = 'locator-not-found' then 'element-not-found'
  when failure_kind = 'timeout' then 'wait-timeout' when failure_kind = 'assertion-failed' then 'assertion-failed' else 'unknown' end as family
from v_log l join v_step s on s.test_id = l.test_id and s.step_id = l.failed_step_id
left join (select test_id, pos, bool_or(status >= 400) as rejected, bool_or(status between 200 and 299) as accepted from {ATTRIBUTED} group by all) a on a.test_id = l.test_id and a.pos = s.pos"""


def families(t):
    return ev.failure_families(t.logs, t.steps, ev.attribute_requests(t.requests, t.steps))


@query("E13_failure_families", "test_id:s failed_step_id:s family:s", FAMILY)
def failure_families(t):
    return families(t)


@query("E14_families_by_count", "family:s n:i share:d", f"""
select family, n, round(100.0 * n / (select count(*) from ({FAMILY})), 1) as share from (select family, count(*) as n from ({FAMILY}) group by all) order by n desc, family""")
def by_count(t):
    return ev.family_shares(families(t)).orderBy(F.desc("n"), "family")


@query("E14_per_test_table", "subject:s test_id:s outcome:s attempts:i duration_ms:i failure_kind:s error:s", f"""
select f.subject, f.test_id, f.outcome, f.attempts, f.duration_ms, coalesce(l.failure_kind, '') as failure_kind, coalesce(replace(replace(s.text[1:60], '|', '\\|'), chr(10), ' '), '') as error
from {VERIFIED} f left join v_log l on l.test_id = f.user_id || '' left join v_step s on s.test_id = l.test_id and s.step_id = l.failed_step_id""")
def per_test(t):
    r = verified(t).withColumn("log_id", F.col("user_id").cast("string"))
    failing = t.failures.select("test_id", "pos").join(t.steps.select("test_id", "pos", "text"), ["test_id", "pos"])
    errors = r.join(failing.select(F.col("test_id").alias("log_id"), F.col("text").alias("error")), "log_id").select("test_id", "error")
    kinds = r.join(t.logs.select(F.col("test_id").alias("log_id"), "failure_kind"), "log_id").select("test_id", "failure_kind")
    return ev.report_rows(r, errors, kinds)


@query("E14_retry_history", "test_id:s attempt:i outcome:s duration_ms:i", """
select a.test_id, a.attempt, a.outcome, a.duration_ms from v_attempt a join v_fold f using (test_id) where f.attempts > 1 and a.attempt <= f.attempts""")
def retries(t):
    return ev.retry_history(ev.fold_attempts(t.attempts), t.attempts)


@query("E14_passed_tests", "test_id:s duration_ms:i", f"select test_id, duration_ms from {VERIFIED} where outcome = 'PASS'")
def passed(t):
    return verified(t).where("outcome = 'PASS'")


RESIDUAL = """
select test_id, subject, family, case when has_requests then 'HIGH' else 'MEDIUM' end as confidence from (
select *, case when problem = 'port' then 'ENV:port-contamination' when problem = 'identity' then 'ENV:app-identity-mismatch' when phase = 'pre' and has_login and status = 429 then 'ENV:auth-rate-limit'
  when status = 404 then 'ENV:seed-data-absent' when param_unbound then 'L4:missing-route-params' when status in (401, 403) then 'L4:backend-auth-rejection' when status = 400 then 'L4:backend-validation'
  when phase = 'post' and external then 'L2:external-redirect' when phase = 'post' and not coalesce(navigates, false) then 'L2:non-navigating-handler' when phase = 'post' and has_param then 'L2:parameterized-postcondition'
  when phase = 'post' then 'L2:postcondition-url-mismatch' when refused then 'STRUCT:multi-step-precondition' when unrouted or (widget_id is null and phase = 'step') then 'STRUCT:composition-gap'
  when dialog then 'L3:dialog-precondition' when visible_expr like '%:%' then 'L3:async-permission-gate' when inside_ng_for is not null then 'L3:repeater-data-readiness'
  when tag_name in ('mat-sidenav', 'mat-drawer') then 'L3:material-sidenav' when visible_expr is not null or enabled_expr is not null then 'L3:user-action-precondition'
  when kind = 'interaction-failed' then 'L3:element-not-interactable' else 'L3:locator-mismatch' end as family
from (select f.*, w.widget_id, w.tag_name, w.visible_expr, w.enabled_expr, w.inside_ng_for,
  l.l_returnflag = 'N' and l.l_linestatus = 'F' as external, l.l_returnflag = 'R' or (l.l_returnflag = 'N' and l.l_linestatus = 'F')
    or exists (select 1 from v_call c where c.comp_id = l.comp_id and c.handler = l.handler and c.expr = 'this.router.navigate') as navigates,
  exists (select 1 from v_call c where c.comp_id = l.comp_id and c.handler = l.handler and c.expr = 'this.dialog.open') or w.selector like '%-dialog' as dialog,
  exists (select 1 from v_route r where r.comp_id = l.comp_id and contains(r.full_path, ':')) as has_param,
  exists (select 1 from v_route r, unnest(r.params) x(p) where r.comp_id = l.comp_id
    and not exists (select 1 from v_param_value v where v.subject = r.subject and v.param = x.p and (v.template is null or v.template = r.full_path))) as param_unbound,
  w.widget_id is not null and not exists (select 1 from v_route r where r.comp_id = l.comp_id) and not exists (select 1 from v_use u where u.subject = l.subject and lower(u.used_ref) = w.selector) as unrouted,
  exists (select 1 from (select l_orderkey, arg_min(subject, (l_linenumber, p, k)) as subject from v_line group by all) a join v_module m on m.subject = a.subject and m.g = 2
    where a.l_orderkey || '' = f.test_id and m.app % 3 <> 2) as has_login,
  exists (select 1 from v_request q where q.test_id = f.test_id and q.status >= 400 and q.ts < f.ts_start) as refused,
  exists (select 1 from v_request q where q.test_id = f.test_id and q.ts between f.ts_start and f.ts_end) as has_requests,
  (select arg_max(q.status, (q.ts, q.req)) from v_request q where q.test_id = f.test_id and q.ts <= f.ts_end) as status,
  (select arg_max(coalesce(h.problem, ''), (h.ts, coalesce(h.problem, ''))) from v_health h where h.subject = f.subject and h.ts <= f.ts_start) as problem
  from (select g.test_id, g.subject, s.pos, s.ts_start, s.ts_end, split_part(failed_step_id, '-', 1) as phase, failure_kind as kind from v_log g join v_step s on s.test_id = g.test_id and s.step_id = g.failed_step_id) f
  left join (from v_line qualify row_number() over (partition by l_orderkey, l_linenumber order by p, k, l_returnflag, l_linestatus) = 1) l on l.l_orderkey || '' = f.test_id and l.l_linenumber = f.pos left join v_widget w on w.widget_id = l.widget_id))"""


def residuals(t):
    return ev.residual_families(ev.residual_evidence(t.failures, t.steps, t.requests, t.health, t.step_targets(t.failures)))


@query("E15_residual_families", "test_id:s family:s confidence:s", RESIDUAL)
def residual(t):
    return residuals(t)


@query("E16_family_catalogue", "family:s subject:s n:i total:i rank:i", f"""
select family, subject, n, total, dense_rank() over (order by total desc, family) as rank from (
  select *, sum(n) over (partition by family) as total from (select family, subject, count(*) as n from ({RESIDUAL}) group by all))""")
def catalogue(t):
    return ev.family_catalogue(residuals(t))


@query("E16_top_families", "family:s total:i", f"select family, count(*) as total from ({RESIDUAL}) group by all order by total desc, family limit 3")
def top_families(t):
    return residuals(t).groupBy("family").agg(F.count(F.lit(1)).alias("total")).orderBy(F.desc("total"), "family").limit(3)


@query("E17_benchmark_validity", "subject:s valid:i reasons:s", f"""
select subject, len(r) = 0 as valid, array_to_string(r, ';') as reasons from (select subject, list_filter([case when not logs then 'log missing' end, case when not fresh then 'log stale' end, case when not agree then 'log disagrees' end,
  case when not sound then 'integrity failure' end, case when subject = 'u7' then 'not a full run' end], lambda x: x is not null) as r
from (select v.subject, bool_and(k % 11 <> 0) as logs, bool_and(k % 13 <> 0) as fresh, bool_and(coalesce((case when k % 17 = 0 then null when k % 7 = 0 then 'FAIL' else 'PASS' end = 'PASS') = (outcome = 'PASS'), false)) as agree,
  bool_and(outcome <> 'FAIL_INTEGRITY') as sound from {VERIFIED} v group by all))""")
def validity(t):
    runs = t.tests.select("subject").distinct().withColumn("mode", F.when(F.col("subject") == "u7", "resume").otherwise("full"))
    return ev.benchmark_valid(verified(t).select("subject", "test_id", "outcome"), logs(t), runs).withColumn("reasons", F.array_join("reasons", ";"))


@query("E18_canonical_tests", "subject:s total:i executed:i passed:i failed:i not_executed:i", f"""
select t.subject, count(*) as total, count(f.outcome) as executed, count(*) filter (f.outcome = 'PASS') as passed, count(*) filter (f.outcome <> 'PASS') as failed, count(*) filter (f.outcome is null) as not_executed
from v_test t left join (select * from {READY} semi join (select test_id from v_test where log_exists) using (test_id)) f using (test_id) where t.has_code group by all""")
def canonical(t):
    return ev.canonical_tests(t.tests.where("has_code"), ready_results(t).join(t.tests.where("log_exists").select("test_id"), "test_id", "left_semi"))
