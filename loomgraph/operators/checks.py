"""Manifests: structural rules, cross checks and what can be mined for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loomgraph.functions.scalar import entity_family, is_negative_guard, is_variant, non_empty
from loomgraph.sources.views import union_all

# (path, wanted type, required)
RULES = [
    ("subjectName", "text", True), ("baseUrl", "text", True), ("accounts", "array", True), ("routeParamValues", "object", True),
    ("routeParamOverrides", "object", False), ("skipWorkflows", "array", False), ("formDataOverrides", "object", False),
    ("executionConfig", "object", False), ("executionConfig.readinessEndpoint", "text", False),
    ("executionConfig.readinessTimeoutMs", "positive", False), ("executionConfig.seedDataNotes", "array", False),
    ("executionConfig.seedCommand", "string", False), ("executionConfig.preAttemptCommand", "string", False),
    ("executionConfig.batchResetCommand", "string", False), ("executionConfig.enableNetworkEvidence", "boolean", False),
    ("executionConfig.timeoutProfile", "object", False), ("executionConfig.timeoutProfile.implicitWait", "number", False),
    ("executionConfig.timeoutProfile.navigationWait", "number", False), ("executionConfig.timeoutProfile.authWait", "number", False),
    ("seedRequirements", "object", False), ("authSetup", "object", False),
]
# rules for the parts of an optional object, checked only when the object is there
WHEN_PRESENT = {
    "seedRequirements": [("authGuards", "array"), ("negativeGuards", "array"), ("routeParams", "array"), ("hasFormWorkflows", "boolean"), ("seedStatus", "status")],
    "authSetup": [(f, "text") for f in ("loginRoute", "usernameField", "passwordField", "submitButton", "authSuccessSelector")],
}
ACCOUNT_RULES = [("username", "text"), ("password", "string"), ("roles", "array"), ("guardSatisfies", "array")]
SEED_STATUS = ["pre-seeded", "needs-command", "none"]


def _typed(value: Column, wanted: str) -> Column:
    """Whether a variant has the wanted type; NULL counts as not."""
    text, number = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double")
    if wanted == "text":
        return is_variant(value, "string") & (F.length(text) > 0)
    if wanted == "positive":
        return is_variant(value, "number") & (number > 0)
    if wanted == "status":
        return is_variant(value, "string") & text.isin(SEED_STATUS)
    return is_variant(value, wanted)


ISSUES = "array<struct<severity:string,field:string>>"


def _issue(broken: Column, field: Column | str, severity: str = "error") -> Column:
    name = F.lit(field) if isinstance(field, str) else field
    return F.when(broken, F.struct(F.lit(severity).alias("severity"), name.alias("field")))


def manifest_issues(manifests: DataFrame) -> DataFrame:
    """Structural issues of manifest texts (M1): rows (manifest_id, severity, field).

    A text that cannot be read is one issue, LOAD_ERROR. `folder`, where the table has it, is the name the
    manifest's own subjectName must equal.
    """
    m = manifests.withColumn("v", F.try_parse_json("text"))
    issues = [_issue(F.col("v").isNull(), "LOAD_ERROR")]
    def at(path):
        return F.try_variant_get(F.col("v"), f"$.{path}", "variant")
    there = F.col("v").isNotNull()
    for path, wanted, required in RULES:
        broken = ~_typed(at(path), wanted)
        issues.append(_issue(there & (broken if required else at(path).isNotNull() & broken), path))
    for parent, parts in WHEN_PRESENT.items():
        for part, wanted in parts:
            issues.append(_issue(at(parent).isNotNull() & _typed(at(parent), "object") & ~_typed(at(f"{parent}.{part}"), wanted), f"{parent}.{part}"))
    if "folder" in manifests.columns:
        named = F.try_variant_get(F.col("v"), "$.subjectName", "string")
        issues.append(_issue(_typed(at("subjectName"), "text") & (named != F.col("folder")), "subjectName:folder"))
    overrides = F.map_entries(F.when(_typed(at("routeParamOverrides"), "object"), F.try_variant_get(F.col("v"), "$.routeParamOverrides", "map<string,variant>")))
    per_template = F.flatten(F.transform(overrides, lambda o: F.concat(
        F.array(_issue(~_typed(o["value"], "object"), F.concat(F.lit("routeParamOverrides."), o["key"]))),
        F.coalesce(F.transform(F.map_entries(F.when(_typed(o["value"], "object"), F.try_variant_get(o["value"], "$", "map<string,variant>"))), lambda p: _issue(
            ~_typed(p["value"], "string"), F.concat(F.lit("routeParamOverrides."), o["key"], F.lit("."), p["key"]))), F.array().cast(ISSUES)))))
    accounts = F.when(_typed(at("accounts"), "array"), F.try_variant_get(F.col("v"), "$.accounts", "array<variant>"))
    per_account = F.flatten(F.transform(accounts, lambda a, i: F.array(*[
        _issue(~_typed(F.try_variant_get(a, f"$.{f}", "variant"), wanted), F.concat(F.lit("accounts["), i.cast("string"), F.lit(f"].{f}"))) for f, wanted in ACCOUNT_RULES])))
    rows = F.array_compact(F.concat(F.array(*issues), *[F.coalesce(x, F.array().cast(ISSUES)) for x in (per_account, per_template)]))
    return m.select("manifest_id", F.inline(rows))


def declared_supply(manifests: DataFrame) -> DataFrame:
    """Warnings where a manifest declares a need it does not meet itself (M2)."""
    m = manifests.withColumn("v", F.try_parse_json("text")).where("v is not null")
    def names(path):
        return F.explode(F.try_variant_get(F.col("v"), path, "array<string>"))
    guards = m.select("manifest_id", names("$.seedRequirements.authGuards").alias("name")).distinct()
    held = m.select("manifest_id", F.explode(F.try_variant_get(F.col("v"), "$.accounts", "array<variant>")).alias("a")).select(
        "manifest_id", F.explode(F.try_variant_get("a", "$.guardSatisfies", "array<string>")).alias("name"))
    params = m.select("manifest_id", names("$.seedRequirements.routeParams").alias("name")).distinct()
    given = m.select("manifest_id", F.explode(F.map_keys(F.try_variant_get(F.col("v"), "$.routeParamValues", "map<string,string>"))).alias("name"))
    seed = m.where((F.try_variant_get(F.col("v"), "$.seedRequirements.seedStatus", "string") == "needs-command")
                   & ~F.coalesce(non_empty(F.try_variant_get(F.col("v"), "$.executionConfig.seedCommand", "string")), F.lit(False)))
    def warn(df, what):
        return df.select("manifest_id", F.lit(what).alias("warning"), "name")
    return union_all([warn(guards.join(held, ["manifest_id", "name"], "left_anti"), "guard"),
                      warn(params.join(given, ["manifest_id", "name"], "left_anti"), "param"),
                      warn(seed.withColumn("name", F.lit("seedCommand")), "seed")])


def needed(workflows: DataFrame, column: str) -> DataFrame:
    """Distinct (subject, name) of an array column. Names are reduced before the shuffle."""
    return workflows.select("subject", F.explode(column).alias("name")).distinct()


def unmet_guards(workflows: DataFrame, accounts: DataFrame) -> DataFrame:
    """Guards workflows ask for that no account satisfies (M3)."""
    want = needed(workflows, "guards").where(~is_negative_guard("name", wide=True))
    return want.join(accounts.select("subject", F.explode("guards").alias("name")).distinct(), ["subject", "name"], "left_anti")


def unbound_params(workflows: DataFrame, values: DataFrame) -> DataFrame:
    """Parameters bound neither globally nor for any template (M4)."""
    return needed(workflows, "params").join(values.select("subject", F.col("param").alias("name")).distinct(), ["subject", "name"], "left_anti")


def unknown_workflows(named: DataFrame, workflows: DataFrame) -> DataFrame:
    """Workflow ids a manifest names that do not exist (M5)."""
    return named.select("subject", "workflow_id").distinct().join(workflows.select("subject", "workflow_id"), ["subject", "workflow_id"], "left_anti")


def cross_check(manifests: DataFrame, required: DataFrame) -> DataFrame:
    """Warnings where the workflows of an application ask for what its manifest lacks: rows (manifest_id, severity, field).

    `manifests`: manifest_id, subject, text; `required`: subject, what ('guard' or 'param'), name.
    Negative guards need no account; accounts that satisfy guards need a login (authSetup).
    """
    m = manifests.withColumn("v", F.try_parse_json("text")).where("v is not null")
    def at(path):
        return F.try_variant_get(F.col("v"), f"$.{path}", "variant")
    accounts = F.when(_typed(at("accounts"), "array"), F.try_variant_get(F.col("v"), "$.accounts", "array<variant>"))
    held = F.array_distinct(F.flatten(F.transform(accounts, lambda a: F.coalesce(F.try_variant_get(a, "$.guardSatisfies", "array<string>"), F.array().cast("array<string>")))))
    given = F.map_keys(F.when(_typed(at("routeParamValues"), "object"), F.try_variant_get(F.col("v"), "$.routeParamValues", "map<string,variant>")))
    local = F.flatten(F.transform(F.map_values(F.when(_typed(at("routeParamOverrides"), "object"), F.try_variant_get(F.col("v"), "$.routeParamOverrides", "map<string,variant>"))),
                                  lambda o: F.coalesce(F.map_keys(F.try_variant_get(o, "$", "map<string,variant>")), F.array().cast("array<string>"))))
    bound = F.concat(given, F.coalesce(local, F.array().cast("array<string>")))
    facts = m.select("manifest_id", "subject", held.alias("held"), bound.alias("bound"), at("authSetup").isNull().alias("no_login"))
    need = required.distinct().groupBy("subject").agg(  # a handful of names per application
        F.collect_set(F.when(F.col("what") == "guard", F.col("name"))).alias("guards"), F.collect_set(F.when(F.col("what") == "param", F.col("name"))).alias("params"))
    j = facts.join(need, "subject")
    warn = lambda names, prefix: F.transform(names, lambda x: F.struct(F.lit("warning").alias("severity"), F.concat(F.lit(prefix), x).alias("field")))
    none = F.array().cast(ISSUES)
    unmet = F.filter("guards", lambda g: ~is_negative_guard(g, wide=True) & ~F.array_contains("held", g))
    login = F.when((F.size("guards") > 0) & (F.size("held") > 0) & F.col("no_login"), F.array(_issue(F.lit(True), "authSetup", "warning")))
    rows = F.concat(*[F.coalesce(x, none) for x in (warn(unmet, "guard:"), warn(F.array_except("params", "bound"), "param:"), login)])
    return j.select("manifest_id", F.inline(rows))


def manifest_status(manifests: DataFrame, issues: DataFrame, with_workflows: DataFrame) -> DataFrame:
    """Status and issue counts per manifest (M6). `issues` are structural ones and cross checks together.

    A manifest that can't be read, or whose application has no workflows yet, has no cross checks.
    """
    known = with_workflows.select("manifest_id").distinct().withColumn("known", F.lit(True))
    c = issues.groupBy("manifest_id").agg(
        F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"),
        F.bool_or(F.col("field") == "LOAD_ERROR").alias("unreadable"))
    j = manifests.select("manifest_id").join(c, "manifest_id", "left").join(known, "manifest_id", "left")
    status = (F.when(F.coalesce("unreadable", F.lit(False)), "LOAD_ERROR").when(F.col("known").isNull(), "MISSING_A2")
              .when(F.coalesce("errors", F.lit(0)) > 0, "INVALID").otherwise("VALID"))
    return j.select("manifest_id", status.alias("status"), F.coalesce("errors", F.lit(0)).alias("errors"), F.coalesce("warnings", F.lit(0)).alias("warnings"))


def requirement_context(workflows: DataFrame, column: str) -> DataFrame:
    """How many live workflows ask for a name, per application (M7)."""
    live = workflows.where("verdict <> 'PRUNED'")
    return live.select("subject", F.explode(column).alias("name")).groupBy("subject", "name").agg(F.count(F.lit(1)).alias("n_workflows"))


def first_workflows(workflows: DataFrame, column: str, n: int = 10) -> DataFrame:
    """First n workflows by id for every name (M7). The group limit runs before the shuffle."""
    rows = workflows.where("verdict <> 'PRUNED'").select("subject", F.explode(column).alias("name"), "workflow_id", "verdict", "trigger_kind")
    nth = F.row_number().over(W.partitionBy("subject", "name").orderBy("workflow_id"))
    return rows.withColumn("nth", nth).where(F.col("nth") <= n)


def requirement_templates(workflows: DataFrame, starts: DataFrame, routes: DataFrame, column: str, with_param: bool) -> DataFrame:
    """Start and terminal templates of the workflows that ask for a name (M7), distinct rows.

    Start routes hang on components, so (name, component) pairs are reduced first.
    """
    live = workflows.where("verdict <> 'PRUNED'").select("subject", "comp_id", "terminal_id", F.explode(column).alias("name"))
    paths = routes.select("subject", F.col("route_id").alias("start_route"), "full_path")
    s = live.select("subject", "comp_id", "name").distinct().join(starts, ["subject", "comp_id"]).join(paths, ["subject", "start_route"])
    e = live.select("subject", "terminal_id", "name").distinct().join(paths.withColumnRenamed("start_route", "terminal_id"), ["subject", "terminal_id"])
    rows = s.select("subject", "name", "full_path", F.lit("start").alias("place")).unionByName(e.select("subject", "name", "full_path", F.lit("terminal").alias("place"))).distinct()
    return rows.where(F.contains("full_path", F.concat(F.lit(":"), "name"))) if with_param else rows


USER_WORDS = ["email", "username", "login", "user", "emailid"]


def login_forms(routes: DataFrame, activates: DataFrame, widgets: DataFrame) -> DataFrame:
    """Best login page of an application and selectors of its fields (M8), one row per application."""
    a = F.col("attributes")
    kind = F.coalesce(F.try_element_at(a, F.lit("type")), F.lit(""))
    fcn = F.coalesce("form_control_name", F.lit(""))
    w = widgets.withColumns({"t": kind, "fcn": fcn, "nm": F.coalesce(F.try_element_at(a, F.lit("name")), F.lit(""))})
    user_word = F.exists(F.array(*[F.lit(x) for x in USER_WORDS]), lambda x: F.contains(F.lower("fcn"), x))
    is_input = F.col("tag_name") == "input"
    is_pw = (F.col("t") == "password") | (F.col("fcn") == "password")
    plain = is_input & ~F.col("t").isin("password", "checkbox", "submit")
    is_user = (F.col("t") == "email") | user_word | (plain & (F.col("t") != "radio"))
    tier = F.when(plain & user_word, 1).when(is_input & F.col("t").isin("email", "text"), 2).when(plain, 3)
    is_submit = (F.col("tag_name") == "button") & (F.col("t") == "submit")
    marked = w.select("subject", "comp_id", "widget_id", "fcn", "nm", "t", is_pw.alias("pw"), is_user.alias("un"), tier.alias("tier"), is_submit.alias("sb")).where("pw or un or tier is not null or sb")
    owner = activates.select("subject", F.col("from_id").alias("route_id"), F.col("to_id").alias("comp_id"))
    facts = F.struct("fcn", "nm", "t")
    per_route = owner.join(marked, ["subject", "comp_id"]).groupBy("subject", "route_id").agg(
        F.bool_or("pw").alias("has_pw"), F.bool_or("un").alias("has_un"), F.bool_or("sb").alias("has_submit"),
        F.min_by(facts, F.when(F.col("pw"), F.col("widget_id"))).alias("p"),
        F.min_by(facts, F.when(F.col("tier").isNotNull(), F.struct("tier", "widget_id"))).alias("u")).where("has_pw and has_un")
    r = routes.select("subject", "route_id", "full_path", F.exists("guards", lambda g: is_negative_guard(g)).alias("open"))
    rank = F.struct(~F.col("open"), ~F.contains(F.lower("full_path"), F.lit("login")), F.col("full_path"))
    best = per_route.join(r, ["subject", "route_id"]).groupBy("subject").agg(F.min_by(F.struct("full_path", "p", "u", "has_submit"), rank).alias("b"))
    def by_name(c):
        return F.concat(F.lit("input[formcontrolname='"), c, F.lit("']"))
    p, u = F.col("b.p"), F.col("b.u")
    return best.select(
        "subject", F.col("b.full_path").alias("login_route"), F.when(F.contains("b.full_path", F.lit("login")), "HIGH").otherwise("MEDIUM").alias("route_confidence"),
        F.when(p["fcn"] != "", by_name(p["fcn"])).otherwise("input[type='password']").alias("password_field"),
        F.when(u["fcn"] != "", by_name(u["fcn"])).when(u["nm"] != "", F.concat(F.lit("input[name='"), u["nm"], F.lit("']")))
        .when(u["t"] == "email", "input[type='email']").otherwise("").alias("username_field"),
        F.when((u["fcn"] != "") | (u["nm"] != ""), "HIGH").when(u["t"] == "email", "MEDIUM").otherwise("UNRESOLVED").alias("username_confidence"),
        F.when(F.col("b.has_submit"), "button[type='submit']").otherwise("").alias("submit_button"))


def param_families(templates: DataFrame) -> DataFrame:
    """Entity families of parameters (M9) from (subject, name, full_path) rows.

    The representative is the shortest template, the smaller one among equals.
    """
    f = templates.select("subject", "name", "full_path").distinct().withColumn("family", entity_family("full_path", F.col("name")))
    per = f.groupBy("subject", "name", "family").agg(
        F.count(F.lit(1)).alias("n_templates"), F.min_by("full_path", F.struct(F.length("full_path"), "full_path")).alias("representative"))
    many = per.groupBy("subject", "name").agg((F.count(F.lit(1)) > 1).alias("is_multi_family"))
    return per.join(many, ["subject", "name"])


def manifest_skeleton(workflows: DataFrame) -> DataFrame:
    """Rows of an empty manifest (M10): an account per guard, a value per parameter, a login when a guard needs one."""
    guards, params = needed(workflows, "guards"), needed(workflows, "params")
    positive = guards.where(~is_negative_guard("name"))
    return union_all([
        guards.select("subject", F.lit("account").alias("item"), "name"), params.select("subject", F.lit("param").alias("item"), "name"),
        positive.select("subject").distinct().select("subject", F.lit("auth_setup").alias("item"), F.lit("/login").alias("name"))])


def skeleton_stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy("subject").agg(
        F.count_if(F.col("item") == "account").alias("guards"), F.count_if(F.col("item") == "param").alias("params"),
        F.bool_or(F.col("item") == "auth_setup").alias("auth_required"))


def seed_requirements(workflows: DataFrame) -> DataFrame:
    """What a backend must hold before a run (M11). Distinct names are few, so they are gathered last."""
    live = workflows.where("verdict <> 'PRUNED'")
    g, p = needed(live, "guards"), needed(live, "params")
    negative = is_negative_guard("name")
    guards = g.groupBy("subject").agg(F.array_sort(F.collect_set(F.when(~negative, F.col("name")))).alias("auth_guards"),
                                      F.array_sort(F.collect_set(F.when(negative, F.col("name")))).alias("negative_guards"))
    params = p.groupBy("subject").agg(F.array_sort(F.collect_set("name")).alias("route_params"))
    forms = workflows.groupBy("subject").agg(F.bool_or(F.col("trigger_kind") == "WIDGET_SUBMITS_FORM").alias("has_form_workflows"))
    return forms.join(guards, "subject", "left").join(params, "subject", "left")
