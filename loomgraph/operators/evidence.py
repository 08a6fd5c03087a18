"""Attempts, logs and network evidence to results, families and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loomgraph.functions.scalar import any_contains, percent1, ratio
from loomgraph.functions.scale import cut_lineage, last_before, span_join
from loomgraph.sources.views import union_all


def outcome_of_error(stderr, stdout) -> Column:
    """Outcome of a failed run from its output; the first rule that fits."""
    text = F.concat_ws("\n", stderr, stdout)
    def has(*words):
        return any_contains(text, words)
    return (F.when(has("NoSuchElementError", "StaleElementReferenceError", "InvalidArgumentError",
                       "ElementNotInteractableError", "invalid element state"), "FAIL_ELEMENT_NOT_FOUND")
            .when(has("AssertionError") | (has("assert") & has("Expected URL")), "FAIL_ASSERTION")
            .when(has("TimeoutError", "Waiting for", "timed out", "ETIMEDOUT"), "FAIL_TIMEOUT")
            .when(has("auth-setup", "Auth setup"), "FAIL_AUTH")
            .otherwise("FAIL_UNKNOWN"))


def auth_context(stderr, stdout) -> Column:
    """Whether the output speaks of the login step, whatever the outcome."""
    return any_contains(F.concat_ws("\n", stderr, stdout), ["auth-setup", "Auth setup", "/login"])


def step_failure(name, message) -> Column:
    """Kind of a step failure and whether its element was there."""
    n, m = F.coalesce(name, F.lit("")), F.coalesce(message, F.lit(""))
    kind = (F.when((n == "NoSuchElementError") | any_contains(m, ["no such element", "Unable to locate element"]), "locator-not-found")
            .when(n.isin("ElementNotInteractableError", "ElementClickInterceptedError") | m.contains("not interactable"), "interaction-failed")
            .when((n == "TimeoutError") | any_contains(m, ["Wait timed out", "Timed out"]), "timeout")
            .when(n.isin("AssertionError", "AssertionError [ERR_ASSERTION]") | m.contains("assert") | m.contains("AssertionError"), "assertion-failed")
            .when(any_contains(m, ["navigation", "net::ERR_"]), "navigation-failed").otherwise("unknown"))
    return F.struct(kind.alias("failure_kind"), kind.isin("interaction-failed", "assertion-failed").alias("element_found"))


def fold_attempts(attempts: DataFrame, max_attempts: int = 3) -> DataFrame:
    """One result per test: attempts end at the first pass or not-ready.

    Only the first `max_attempts` of a test exist by definition, so the sorted list is short.
    """
    rows = (attempts.where(F.col("attempt") <= max_attempts).groupBy("test_id", "subject", "user_id")
            .agg(F.array_sort(F.collect_list(F.struct("attempt", "outcome", "duration_ms"))).alias("a")))
    ends = F.array_position(F.transform("a", lambda x: x["outcome"].isin("PASS", "FAIL_APP_NOT_READY")), True)
    used = F.when(ends > 0, F.slice("a", 1, F.col("ends").cast("int"))).otherwise(F.col("a"))
    return (rows.withColumn("ends", ends).withColumn("used", used).select(
        "test_id", "subject", "user_id", F.size("used").alias("attempts"),
        F.aggregate("used", F.lit(0).cast("long"), lambda s, x: s + x["duration_ms"]).alias("duration_ms"),
        F.element_at("used", -1)["outcome"].alias("outcome")))


def not_ready(results: DataFrame, readiness: DataFrame) -> DataFrame:
    """Results of applications that never came up."""
    down = readiness.select("subject", "passed")
    j = results.join(down, "subject", "left")
    failed = ~F.coalesce("passed", F.lit(True))
    return j.withColumns({
        "outcome": F.when(failed, "FAIL_APP_NOT_READY").otherwise(F.col("outcome")),
        "attempts": F.when(failed, 0).otherwise(F.col("attempts")),
        "duration_ms": F.when(failed, 0).otherwise(F.col("duration_ms"))}).drop("passed")


def verify_integrity(results: DataFrame, logs: DataFrame) -> DataFrame:
    """Passes whose log is missing, stale, broken, disagreeing or empty become FAIL_INTEGRITY (E5)."""
    j = results.join(logs, "test_id", "left")
    reason = (F.when(~F.coalesce("log_exists", F.lit(False)), "missing")
              .when(F.col("log_time") < F.col("run_start") - F.expr("interval 5 seconds"), "stale")
              .when(F.col("log_broken"), "broken")
              .when(~F.coalesce(F.col("log_outcome") == "PASS", F.lit(False)), "disagrees")
              .when(F.coalesce("log_steps", F.lit(0)) == 0, "no_steps"))
    return (j.withColumn("reason", F.when(F.col("outcome") == "PASS", reason))
            .withColumn("outcome", F.when(F.col("reason").isNotNull(), "FAIL_INTEGRITY").otherwise(F.col("outcome"))))


def select_tests(tests: DataFrame, skip: DataFrame | None = None, only: DataFrame | None = None,
                 prior: DataFrame | None = None, completed: DataFrame | None = None) -> DataFrame:
    """What to run and what to carry over (E6): rows (test_id, action).

    `prior` holds results of an earlier run: passes are carried, failures run again.
    `completed` holds results of this run: they are carried. One row per test.
    """
    run = tests.select("test_id")
    if skip is not None:
        run = run.join(skip.select("test_id"), "test_id", "left_anti")
    if only is not None:
        run = run.join(only.select("test_id"), "test_id", "left_semi")
    carried = []
    if prior is not None:
        run = run.join(prior.where("outcome <> 'PASS'").select("test_id"), "test_id", "left_semi")
        carried.append(prior.where("outcome = 'PASS'").select("test_id"))
    if completed is not None:
        run = run.join(completed.select("test_id"), "test_id", "left_anti")
        carried.append(completed.select("test_id"))
    rows = run.withColumn("action", F.lit("run"))
    if carried:
        rows = rows.unionByName(union_all(carried).distinct().withColumn("action", F.lit("carry")))
    return rows


def run_stats(results: DataFrame, tests: DataFrame) -> DataFrame:
    """Totals of a run per application."""
    t = tests.groupBy("subject").agg(F.count(F.lit(1)).alias("total"), F.count_if("skipped").alias("skipped"))
    r = results.groupBy("subject").agg(
        F.count_if(F.col("outcome") == "PASS").alias("passed"), F.count_if(F.col("outcome") == "FAIL_APP_NOT_READY").alias("not_ready"),
        F.count_if(~F.col("outcome").isin("PASS", "FAIL_APP_NOT_READY")).alias("failed"), F.sum("duration_ms").alias("duration_ms"))
    return t.join(r, "subject", "left").na.fill(0)


def attribute_requests(requests: DataFrame, steps: DataFrame, minutes: int = 64) -> DataFrame:
    """Requests to the steps whose time they fall in; the rest to the last step.

    A request inside two overlapping steps counts for both.
    """
    s = steps.select("test_id", "pos", F.unix_micros("ts_start").alias("__from"), F.unix_micros("ts_end").alias("__to"))
    r = requests.withColumn("__at", F.unix_micros("ts"))
    inside = span_join(r, s, ["test_id"], "__at", "__from", "__to", minutes * 60_000_000)
    last = steps.groupBy("test_id").agg(F.max("pos").alias("pos"))
    left = r.join(inside.select("test_id", "req").distinct(), ["test_id", "req"], "left_anti").join(last, "test_id")
    cols = ["test_id", "req", "pos", "method", "status"]
    return inside.select(*cols, F.lit(True).alias("inside")).unionByName(left.select(*cols, F.lit(False).alias("inside")))


def request_histogram(requests: DataFrame) -> DataFrame:
    """Requests by method and by status."""
    m = requests.groupBy(F.col("method").alias("value")).agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("method"))
    s = requests.groupBy(F.col("status").cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("status"))
    return m.unionByName(s)


def status_text(requests: DataFrame) -> DataFrame:
    """`200×3 404×1` per test; counted before it is gathered, so a list has one entry per status code."""
    c = requests.groupBy("test_id", "status").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("test_id").agg(F.sum("n").alias("n_requests"), F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("status", "n"))), lambda x: F.concat(x["status"].cast("string"), F.lit("×"), x["n"].cast("string"))), " ").alias("statuses"))


def coverage_entries(workflows: DataFrame, plans: DataFrame, tests: DataFrame, results: DataFrame) -> DataFrame:
    """One row per workflow with plan, code and outcome (E10). Missing stages are empty tables."""
    def flag(df, name):
        return df.select("workflow_id").distinct().withColumn(name, F.lit(True))
    return (workflows.join(flag(plans, "p"), "workflow_id", "left").join(flag(tests, "c"), "workflow_id", "left")
            .join(results.select("workflow_id", "outcome", "attempts", "duration_ms"), "workflow_id", "left")
            .withColumn("has_plan", F.coalesce("p", F.lit(False))).withColumn("has_code", F.coalesce("c", F.lit(False))).drop("p", "c"))


def coverage(entries: DataFrame) -> DataFrame:
    """Coverage tiers per application and in total.

    Not-ready comes before skipped, skipped before passed. The total row (subject NULL) is
    the micro average, computed by the same rollup.
    """
    live = F.col("verdict") != "PRUNED"
    not_up = live & F.coalesce(F.col("outcome") == "FAIL_APP_NOT_READY", F.lit(False))
    skipped = live & ~not_up & F.col("skipped")
    passed = live & ~not_up & ~skipped & F.coalesce(F.col("outcome") == "PASS", F.lit(False))
    c = entries.rollup("subject").agg(
        F.grouping("subject").alias("is_total"), F.count(F.lit(1)).alias("total"), F.count_if(~live).alias("pruned"),
        F.count_if(not_up).alias("not_ready"), F.count_if(skipped).alias("skipped"), F.count_if(live & F.col("has_plan")).alias("with_plan"),
        F.count_if(live & F.col("has_code")).alias("with_code"), F.count_if(passed).alias("passed"))
    live_n = F.col("total") - F.col("pruned")
    return c.withColumns({"c1": ratio("with_plan", live_n), "c2": ratio("with_code", live_n),
                          "c3": ratio("passed", live_n - F.col("not_ready") - F.col("skipped"))})


def median_execution(cov: DataFrame) -> DataFrame:
    """Median of the execution tier over applications, beside the micro average."""
    return cov.agg(F.median(F.when(F.col("is_total") == 0, F.col("c3"))).alias("median_c3"),
                   F.max(F.when(F.col("is_total") == 1, F.col("c3"))).alias("total_c3"), F.count_if(F.col("is_total") == 0).alias("n_subjects"))


def failure_counts(results: DataFrame, logs: DataFrame) -> DataFrame:
    """Failures by outcome, and failed logs by failure kind."""
    o = results.where("outcome <> 'PASS'").groupBy(F.col("outcome").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    k = logs.where("failure_kind is not null").groupBy(F.col("failure_kind").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return o.withColumn("what", F.lit("outcome")).unionByName(k.withColumn("what", F.lit("failure_kind")))


def failure_family(step_id: Column, kind: Column, rejected: Column, accepted: Column) -> Column:
    post = step_id.startswith("post-")
    return (F.when(post & rejected, "backend-rejection").when(post & accepted, "postcondition-oracle").when(post, "postcondition-timeout")
            .when(step_id.startswith("pre-"), "precondition-failure").when(kind == "interaction-failed", "interaction-blocked")
            .when(kind == "locator-not-found", "element-not-found").when(kind == "timeout", "wait-timeout")
            .when(kind == "assertion-failed", "assertion-failed").otherwise("unknown"))


def failure_families(logs: DataFrame, steps: DataFrame, attributed: DataFrame) -> DataFrame:
    """Family of every failed test from its failing step and that step's requests."""
    failing = logs.join(steps.select("test_id", F.col("step_id").alias("failed_step_id"), "pos"), ["test_id", "failed_step_id"], "left")
    seen = attributed.groupBy("test_id", "pos").agg(
        F.bool_or(F.col("status") >= 400).alias("rejected"), F.bool_or(F.col("status").between(200, 299)).alias("accepted"))
    j = failing.join(seen, ["test_id", "pos"], "left")
    no = F.lit(False)
    return j.withColumn("family", failure_family(
        F.coalesce("failed_step_id", F.lit("")), F.coalesce("failure_kind", F.lit("")), F.coalesce("rejected", no), F.coalesce("accepted", no)))


def report_rows(results: DataFrame, errors: DataFrame, kinds: DataFrame) -> DataFrame:
    """Per-test table: file, outcome, time, failure kind, start of the error on one line."""
    short = F.replace(F.replace(F.left("error", F.lit(60)), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    return (results.join(errors, "test_id", "left").join(kinds, "test_id", "left")
            .select("subject", "test_id", "outcome", "attempts", "duration_ms", F.coalesce("failure_kind", F.lit("")).alias("failure_kind"),
                    F.coalesce(short, F.lit("")).alias("error")))


def retry_history(results: DataFrame, attempts: DataFrame) -> DataFrame:
    """Attempts of tests that needed more than one."""
    more = results.where("attempts > 1").select("test_id", F.col("attempts").alias("used"))
    return attempts.join(more, "test_id").where("attempt <= used").select("test_id", "attempt", "outcome", "duration_ms")


def residual_evidence(failures: DataFrame, steps: DataFrame, requests: DataFrame, health: DataFrame, targets: DataFrame, hour: int = 3_600_000_000) -> DataFrame:
    """What is known about each failure, gathered from the other layers.

    `failures`: test_id, subject, pos, phase, kind of the failing step. Joined to it are
    - the last response up to the end of that step (as-of) and whether the step had requests of its own (interval),
    - whether a request before the step was rejected: the state the workflow needs was not made,
    - the last health check of the application before the step (as-of); `health`: subject, ts, problem or NULL,
    - what plan, intent and graph say of the step's widget; `targets`: test_id, pos and flags, no row where
      the graph knows no widget for the step.
    A flag without a source is false.
    """
    timed = cut_lineage(failures.join(steps.select("test_id", "pos", F.unix_micros("ts_start").alias("__from"), F.unix_micros("ts_end").alias("__to")), ["test_id", "pos"]))
    asked = requests.select("test_id", "req", "status", F.unix_micros("ts").alias("__ts"))
    checks = health.select("subject", "problem", F.unix_micros("ts").alias("__ts"))
    e = cut_lineage(last_before(timed, asked, ["test_id"], "__to", "__ts", ["req", "status"], "__response", hour))
    e = cut_lineage(last_before(e, checks, ["subject"], "__from", "__ts", ["problem"], "__check", hour))
    own = attribute_requests(requests, steps).where("inside").select("test_id", "pos").distinct().withColumn("has_requests", F.lit(True))
    refused = asked.where("status >= 400").groupBy("test_id").agg(F.min("__ts").alias("__refused"))
    known = targets.withColumn("__known", F.lit(True))
    e = e.join(own, ["test_id", "pos"], "left").join(refused, "test_id", "left").join(known, ["test_id", "pos"], "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    no_widget = F.col("__known").isNull() & (F.col("phase") == "step")
    facts = {c: flag(F.col(c)) for c in ("has_login", "param_unbound", "external", "navigates", "has_param", "dialog", "async_gate", "repeater", "sidenav", "gated")}
    return e.withColumns(facts | {
        "status": F.col("__response")["status"], "port_busy": flag(F.col("__check")["problem"] == "port"), "wrong_app": flag(F.col("__check")["problem"] == "identity"),
        "at_login": flag(F.col("has_login")) & (F.col("phase") == "pre"), "needs_other_workflow": flag(F.col("__refused") < F.col("__from")),
        "unmodelled_owner": flag(F.col("unrouted")) | no_widget, "has_log": F.lit(True), "has_requests": flag(F.col("has_requests"))}).drop("__from", "__to", "__response", "__check", "__refused", "__known")


def residual_families(evidence: DataFrame) -> DataFrame:
    """Family and confidence of every failure."""
    cols = {c: F.col(c) for c in evidence.columns}
    return evidence.select("test_id", "subject", residual_family(cols).alias("family"), confidence(F.col("has_log"), F.col("has_requests")).alias("confidence"))


def residual_family(e: dict[str, Column]) -> Column:
    """Diagnostic family of a failure from its joined evidence; the first rule that fits."""
    s = e["status"]
    return (F.when(e["port_busy"], "ENV:port-contamination").when(e["wrong_app"], "ENV:app-identity-mismatch")
            .when(e["at_login"] & (s == 429), "ENV:auth-rate-limit").when(s == 404, "ENV:seed-data-absent")
            .when(e["param_unbound"], "L4:missing-route-params").when(s.isin(401, 403), "L4:backend-auth-rejection")
            .when(s == 400, "L4:backend-validation")
            .when((e["phase"] == "post") & e["external"], "L2:external-redirect")
            .when((e["phase"] == "post") & ~e["navigates"], "L2:non-navigating-handler")
            .when((e["phase"] == "post") & e["has_param"], "L2:parameterized-postcondition")
            .when(e["phase"] == "post", "L2:postcondition-url-mismatch")
            .when(e["needs_other_workflow"], "STRUCT:multi-step-precondition").when(e["unmodelled_owner"], "STRUCT:composition-gap")
            .when(e["dialog"], "L3:dialog-precondition").when(e["async_gate"], "L3:async-permission-gate")
            .when(e["repeater"], "L3:repeater-data-readiness").when(e["sidenav"], "L3:material-sidenav")
            .when(e["gated"], "L3:user-action-precondition").when(e["kind"] == "interaction-failed", "L3:element-not-interactable")
            .otherwise("L3:locator-mismatch"))


def confidence(has_log: Column, has_requests: Column) -> Column:
    return F.when(has_log & has_requests, "HIGH").when(has_log, "MEDIUM").otherwise("LOW")


def family_shares(rows: DataFrame) -> DataFrame:
    """Count and share of every family (E14). The window runs over the counted rows, one per family."""
    n = rows.groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", percent1("n", F.sum("n").over(W.partitionBy(F.lit(0)))))


def family_catalogue(rows: DataFrame) -> DataFrame:
    """Count per family and application, with the rank of the family overall.

    The rank is a window over the totals, one row per family of a fixed short list.
    """
    per = rows.groupBy("subject", "family").agg(F.count(F.lit(1)).alias("n"))
    total = per.groupBy("family").agg(F.sum("n").alias("total"))
    rank = total.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("total"), "family")))
    return per.join(F.broadcast(rank), "family")


def benchmark_valid(results: DataFrame, logs: DataFrame, runs: DataFrame) -> DataFrame:
    """Whether the run of an application may be cited, with the reasons against it."""
    j = results.join(logs, "test_id", "left")
    checks = j.groupBy("subject").agg(
        F.bool_and(F.coalesce("log_exists", F.lit(False))).alias("logs"),
        F.bool_and(F.coalesce(F.col("log_time") >= F.col("run_start") - F.expr("interval 5 seconds"), F.lit(False))).alias("fresh"),
        F.bool_and(F.coalesce((F.col("log_outcome") == "PASS") == (F.col("outcome") == "PASS"), F.lit(False))).alias("agree"),
        F.bool_and(F.col("outcome") != "FAIL_INTEGRITY").alias("sound")).join(runs, "subject")
    reasons = F.array_compact(F.array(*[F.when(~F.col(c), F.lit(t)) for c, t in (
        ("logs", "log missing"), ("fresh", "log stale"), ("agree", "log disagrees"), ("sound", "integrity failure"))],
        F.when(F.col("mode") != "full", "not a full run")))
    return checks.select("subject", reasons.alias("reasons")).withColumn("valid", F.size("reasons") == 0)


def canonical_tests(tests: DataFrame, results: DataFrame) -> DataFrame:
    """Every generated test with its state."""
    j = tests.join(results.select("test_id", "outcome"), "test_id", "left")
    return j.groupBy("subject").agg(
        F.count(F.lit(1)).alias("total"), F.count("outcome").alias("executed"), F.count_if(F.col("outcome") == "PASS").alias("passed"),
        F.count_if(F.col("outcome").isNotNull() & (F.col("outcome") != "PASS")).alias("failed"), F.count_if(F.col("outcome").isNull()).alias("not_executed"))
