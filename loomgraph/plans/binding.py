"""Plans: accounts, parameters, values and locators bound to intents."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, functions as F

from loomgraph.functions import fixed
from loomgraph.functions.scalar import (
    all_classes_generic, any_contains, fnv1a32_suffix, is_binding_expression, lookup, non_empty, positive_guards, ratio,
    strip_quotes, substitute_params, tag_position, template_params)
from loomgraph.functions.scale import cut_lineage, cut_together, per_component
from loomgraph.operators.intents import Intents

STRINGS = "array<string>"
# columns of plans that rest on how dialogs are opened, and on the number of fields
OF_DIALOGS = {"by_name", "by_button", "by_flag", "start_url", "n_dialogs", "dialog_selector", "dialog_opener", "dialogs", "n_pre", "budget_ms", "post_type", "post_expected", "post_fallback"}
OF_FIELDS = {"form_fields", "n_fields", "n_steps", "budget_ms"}
OPENERS = {"by_name": "struct<opener_selector:string,opener_widget:string,opener_path:string>", "by_button": "string",
           "by_flag": "struct<parent_selector:string,opener_text:string,opener_path:string>"}
STEP_COLUMNS = ["subject", "comp_id", "workflow_id", "trigger_kind", "widget_id", "selector", "is_template", "start_path", "login_route", "login", "waits", "locator", "scope"]


def choose_account(needs: DataFrame, accounts: DataFrame) -> DataFrame:
    """First account whose guards cover the needed ones (F1), per distinct (subject, guards).

    Accounts are first reduced to one per distinct guard set, so the division joins a
    few sets with a few sets. Guards that want nobody logged in need no account.
    """
    sets = accounts.select("subject", "pos", "username", "password", F.array_sort("guards").alias("has")).groupBy("subject", "has").agg(
        F.min_by(F.struct("pos", "username", "password"), "pos").alias("acct"))
    need = needs.select("subject", "guards").distinct().withColumn("auth", positive_guards("guards"))
    fit = need.where(F.size("auth") > 0).join(sets, "subject").where(F.size(F.array_except("auth", "has")) == 0)
    return fit.groupBy("subject", "guards").agg(F.min_by("acct", "acct.pos").alias("a")).select(
        "subject", "guards", F.col("a.username").alias("username"), F.col("a.password").alias("password"))


def bind_params(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """Parameter values of distinct (subject, start_path, terminal_path) pairs (F2).

    Value for the terminal template, then for the start template, then the global one,
    then a placeholder.
    """
    keys = ["subject", "start_path", "terminal_path"]
    names = F.array_union(template_params("start_path"), template_params(F.coalesce("terminal_path", F.lit(""))))
    p = pairs.select(*keys).distinct().withColumn("param", F.explode_outer(F.array_sort(names)))
    def named(col, alias, extra=None):
        v = values.where("template is null") if extra is None else values.where("template is not null")
        cols = ["subject", "param", F.col("value").alias(alias)]
        return v.select(*cols) if extra is None else v.select(*cols, F.col("template").alias(extra))
    j = (p.join(named("value", "v_term", "terminal_path"), ["subject", "param", "terminal_path"], "left")
         .join(named("value", "v_start", "start_path"), ["subject", "param", "start_path"], "left")
         .join(named("value", "v_all"), ["subject", "param"], "left"))
    bound = F.coalesce("v_term", "v_start", "v_all", F.concat(F.lit("<"), "param", F.lit(">")))
    entries = F.collect_list(F.when(F.col("param").isNotNull(), F.struct("param", bound.alias("value"))))
    return j.groupBy(*keys).agg(F.map_from_entries(F.array_sort(entries)).alias("route_params"))


def _by_pattern() -> Column:
    p = F.col("pattern")
    n = F.least(F.coalesce("max_length", "min_length", F.lit(10)), F.lit(20)).cast("int")
    def filled(word, pad):
        return F.left(F.rpad(F.lit(word), n, pad), n)
    digits = p.rlike(r"^(\^?\[?0-9\]?[*+]?\$?$|\^?\\d[*+]?\$?$|\^?\[0-9\]\{|\^?\\d\{)")
    letters = p.rlike(r"^(\^?\[a-zA-Z\\s?\][*+]?\$?$|\^?\[A-Za-z)")
    return (F.when(digits, F.repeat(F.lit("1"), n)).when(letters, filled("Test", "x"))
            .when(p.rlike(r"^\^?\[a-zA-Z0-9\][*+]?\$?$"), filled("Test1", "0"))
            .when(p.rlike(r"(?i)phone|tel") | p.rlike(r"^\^?\+?\[?0-9\\-\\s()\]"), F.left(F.lit("1234567890"), n))
            .when(p.rlike("(?i)email|@"), None)
            .when(p.rlike("(?i)^https?|url"), "https://example.com"))


def default_value(workflow_id: Column) -> Column:
    """Value of a form field from all that is known about it.

    Type first, then kind of widget, options, date format, pattern, length, name, and a
    plain text last. The suffix from the workflow id keeps values of workflows apart.
    """
    t = F.lower("input_type")
    suffix = fnv1a32_suffix(workflow_id)
    base = F.concat(F.lit("test-"), "key", F.lit("-"), suffix)
    low = F.lower("key")
    def number(c):
        return F.when(c == F.floor(c), c.cast("bigint").cast("string")).otherwise(c.cast("string"))
    numeric = (F.when(F.col("min_value").isNotNull(), number(F.col("min_value")))
               .when(F.col("max_value").isNotNull(), number(F.least(F.lit(1), F.col("max_value")))).otherwise("1"))
    by_name = reduce(lambda acc, nv: acc.when(any_contains(low, nv[0]), nv[1]), fixed.NAME_VALUES[1:],
                     F.when(any_contains(low, fixed.NAME_VALUES[0][0]), fixed.NAME_VALUES[0][1])).otherwise(lookup(low, fixed.EXACT_NAME_VALUES))
    has_min = F.coalesce(F.col("min_length") > 0, F.lit(False))
    fit = F.when(F.col("max_length").isNotNull(), F.left(base, F.col("max_length").cast("int"))).otherwise(base)
    by_length = (F.when(has_min, F.when(F.length(base) < F.col("min_length"), F.rpad(base, F.col("min_length").cast("int"), "x")).otherwise(fit))
                 .when(F.col("max_length").isNotNull(), fit))
    return (F.when(t == "email", F.concat(F.lit("test-"), suffix, F.lit("@example.com")))
            .when(t == "number", numeric).when(t.isin(*fixed.TYPE_VALUES), lookup(t, fixed.TYPE_VALUES))
            .when(F.col("kind") == "Checkbox", "true").when(F.col("kind").isin("RadioGroup", "Radio"), "selected")
            .when(F.col("tag_name").isin("select", "mat-select"), F.coalesce("first_option", F.lit("option-1")))
            .when(F.col("tag_name") == "textarea", base).when(F.col("date_format").isNotNull(), "2024-01-01")
            .otherwise(F.coalesce(_by_pattern(), by_length, by_name, base)))


def composed_within(composes: DataFrame, hops: int = 4) -> DataFrame:
    """(from, to) pairs of components joined by at most `hops` compositions."""
    step = cut_lineage(composes.select("subject", "from_id", "to_id").distinct())
    frontier = seen = step
    nxt = step.select("subject", F.col("from_id").alias("mid"), F.col("to_id").alias("far"))
    for _ in range(hops - 1):
        found = (frontier.withColumnRenamed("to_id", "mid").join(nxt, ["subject", "mid"])
                 .select("subject", "from_id", F.col("far").alias("to_id")).distinct())
        frontier = cut_lineage(found.join(seen, ["subject", "from_id", "to_id"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def attr(name: str) -> Column:
    return F.try_element_at("attributes", F.lit(name))


def _class_selector(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, r"\s+"), lambda x: F.concat(F.lit("."), x)), "")


def _with_type(c: Column, name: str) -> Column:
    return F.concat("tag_name", F.lit(f'[{name}="'), c, F.lit('"]'))


def widget_locator() -> Column:
    """Strategy and value that find a trigger widget; eleven ways in fixed order (F8)."""
    def loc(strategy, value):
        return F.struct(F.lit(strategy).alias("strategy"), value.cast("string").alias("value"))
    link, text, tag = F.col("router_link"), F.trim("text"), F.coalesce("tag_name", F.lit("element"))
    plain = strip_quotes(link)
    link_ok = (non_empty("router_link") & (F.col("tag_name") == "a") & ~link.contains("{{")
               & ~F.ltrim(link).startswith("[") & ~is_binding_expression(plain))
    by_type = (F.when(non_empty(attr("type")), _with_type(attr("type"), "type")).when(non_empty(attr("role")), _with_type(attr("role"), "role")))
    position = tag_position("widget_id", "tag_name")
    repeated = F.col("inside_ng_for").isNotNull() & F.col("ng_for_item_tag").isNotNull() & F.col("ng_for_ordinal").isNotNull()
    is_item = tag == F.col("ng_for_item_tag")
    nested = F.concat("ng_for_item_tag", F.lit(":nth-of-type(1) "), tag, F.lit(":nth-of-type("), (F.col("ng_for_ordinal") + 1).cast("string"), F.lit(")"))
    return (F.when(non_empty(attr("data-testid")), loc("data-testid", attr("data-testid")))
            .when(non_empty(attr("id")), loc("id", attr("id")))
            .when(non_empty("form_control_name"), loc("formcontrolname", F.col("form_control_name")))
            .when(non_empty(attr("name")), loc("name", attr("name")))
            .when(non_empty(attr("aria-label")) & ~is_binding_expression(attr("aria-label")), loc("aria-label", attr("aria-label")))
            .when(non_empty(attr("placeholder")), loc("placeholder", attr("placeholder")))
            .when(link_ok, loc("routerlink", plain)).when(non_empty(attr("href")), loc("href", attr("href")))
            .when(F.col("tag_name").isNotNull() & by_type.isNotNull(), loc("custom", by_type))
            .when(non_empty(attr("class")) & ~all_classes_generic(attr("class")), loc("custom", _class_selector(attr("class"))))
            .when((F.col("tag_name") == "a") & non_empty(text) & (F.length(text) <= 40) & ~is_binding_expression(F.col("text")), loc("linktext", text))
            .when(repeated & is_item & (F.col("ng_for_ordinal") == 0), loc("custom", F.concat(tag, F.lit(":nth-of-type(1)"))))
            .when(repeated & is_item, loc("tag-position", position)).when(repeated, loc("custom", nested))
            .otherwise(loc("tag-position", position)))


def field_locator() -> Column:
    """Strategy and value that find a form field."""
    def loc(strategy, value):
        return F.struct(F.lit(strategy).alias("strategy"), value.alias("value"))
    return (F.when(non_empty("form_control_name"), loc("formcontrolname", F.col("form_control_name")))
            .when(non_empty("name_attr"), loc("name", F.col("name_attr"))).when(non_empty("id_attr"), loc("id", F.col("id_attr")))
            .otherwise(loc("tag-position", F.coalesce("tag_name", F.lit("input")))))


def selector_text(strategy: Column, value: Column) -> Column:
    """Locator as selector text."""
    by_attribute = ["formcontrolname", "aria-label", "routerlink", "href", "placeholder", "data-testid"]
    tag, nth = F.regexp_extract(value, r"^(.*?)(?::(\d+))?$", 1), F.regexp_extract(value, r":(\d+)$", 1)
    return (F.when(strategy == "id", F.concat(F.lit("id="), value)).when(strategy == "name", F.concat(F.lit("name="), value))
            .when(strategy == "linktext", F.concat(F.lit("link="), value))
            .when(strategy.isin(by_attribute), F.concat(F.lit("css=["), strategy, F.lit('="'), value, F.lit('"]')))
            .when(strategy == "tag-position", F.concat(F.lit("css="), tag, F.lit(":nth-of-type("), F.when(nth == "", "1").otherwise(nth), F.lit(")")))
            .otherwise(F.concat(F.lit("css="), value)))


def time_budget(has_auth: Column, n_steps: Column, n_conditions: Column) -> Column:
    """Milliseconds a test may take."""
    b = fixed.BUDGET_MS
    return F.when(has_auth, b["auth"]).otherwise(0) + n_steps * b["step"] + n_conditions * b["navigation"] + b["buffer"]


def wait_reason(gates: Column, inside_ng_for: Column, has_auth: Column) -> Column:
    """Why a test waits before its first step, NULL when it does not (F16)."""
    asynchronous = F.exists(gates, lambda g: g.rlike("(?i)async|can:"))
    contradictory = has_auth & F.exists(gates, lambda g: F.trim(g).rlike("(?i)^!is(LoggedIn|Authenticated)"))
    return F.when(~contradictory, F.when(asynchronous, "async/permission gate").when(inside_ng_for.isNotNull(), "repeater data readiness")
                  .when(F.size(gates) > 0, "visibility gate"))


def step_type() -> Column:
    """Kind of action that fills a field."""
    return (F.when(F.col("tag_name").isin("select", "mat-select"), "select-option").when(F.col("kind").isin("RadioGroup", "Checkbox", "Radio"), "click")
            .when((F.col("input_type") == "file") | F.col("date_format").isNotNull(), "type").otherwise("clear-and-type"))


@dataclass
class Plans:
    """Plans for the intents of all applications.

    `auth` holds (subject, login_route) of applications with a login; `skip` (asked when
    plans are made) and `form_overrides` are the manifests' lists as rows.
    """

    i: Intents
    accounts: DataFrame
    param_values: DataFrame
    auth: DataFrame
    skip: Callable[[], DataFrame]
    form_overrides: DataFrame

    @cached_property
    def start_choice(self) -> DataFrame:
        """Best start route per (component, need for a login).

        A route that renders the component comes first, then the others. The rank is one
        struct, so the choice is a minimum and not a sort.
        """
        f = self.i.f
        near = composed_within(f.composes)
        act = f.activates.select("subject", F.col("from_id").alias("start_route"), F.col("to_id").alias("owner"))
        renders = act.select("subject", "start_route", F.col("owner").alias("comp_id")).unionByName(
            act.join(near.withColumnRenamed("from_id", "owner"), ["subject", "owner"]).select("subject", "start_route", F.col("to_id").alias("comp_id"))).distinct()
        records = self.i.start_records.join(renders.withColumn("renders", F.lit(True)), ["subject", "start_route", "comp_id"], "left")
        guarded = F.size(positive_guards(F.coalesce("guards", F.array().cast(STRINGS)))) > 0
        def best(needs):
            rank = F.struct(F.coalesce(~F.col("renders"), F.lit(True)), F.col("full_path").contains("**"),
                            (~guarded if needs else guarded), F.size("params"), F.length("full_path"), F.col("full_path"))
            return F.min_by(F.struct("start_route", "full_path", "params", "guards"), rank)
        both = records.groupBy("subject", "comp_id").agg(best(True).alias("with_auth"), best(False).alias("without"))
        return both.select("subject", "comp_id", F.explode(F.map_from_arrays(F.array(F.lit(True), F.lit(False)), F.array("with_auth", "without"))).alias("needs_auth", "s")).select(
            "subject", "comp_id", "needs_auth", F.col("s.start_route").alias("start_id"), F.col("s.full_path").alias("start_path"),
            F.array_sort("s.guards").alias("start_guards"))

    @cached_property
    def assigned(self) -> DataFrame:
        """What is needed of the assigned intents before their plans are made; where plans are written it is taken from them."""
        needed = ["subject", "comp_id", "workflow_id", "trigger_kind", "widget_id", "selector", "is_template", "gates", "inside_ng_for", "start_path", "terminal_path", "login_route", "login"]
        return self.plans.select(*needed) if "plans" in self.__dict__ else cut_together(self._assigned.select(*needed))

    def assigned_with(self, *cols: Column | str) -> DataFrame:
        """Assigned intents with these columns only, of those that `assigned` has; the others are neither made nor written."""
        return self.assigned.select(*cols) if {"plans", "assigned"} & set(self.__dict__) else cut_together(self._assigned.select(*cols))

    @cached_property
    def _assigned(self) -> DataFrame:
        """Intents with start route, account and parameter values, dealt by component number; for `cut_together`.

        Intents are not written for it: they are made once more where their plans are, which moves numbers only.
        """
        place = ["subject", "comp_id"]
        numbers = self.i.f.g.t.components.select("k", *place)
        def dealt(df):
            return per_component(df.join(numbers, place).drop(*place))
        left_out = dealt(self.skip().select(*place, "workflow_id"))
        needs = (F.size("guard_names") > 0).alias("needs_auth")
        tp = F.coalesce("terminal_path", F.lit("")).alias("tp")
        who = choose_account(self.start_choice.select("subject", F.col("start_guards").alias("guards")), self.accounts).withColumnRenamed("guards", "start_guards")
        first = self.accounts.groupBy("subject").agg(F.min_by(F.struct("username", "password"), "pos").alias("login"))
        # start, account and login belong to a component; so do values once the terminal is known
        starts = cut_lineage(self.start_choice.join(who, ["subject", "start_guards"], "left").join(self.auth, "subject", "left")
                             .join(first, "subject", "left"))
        ends = self._intent_ends.select(*place, "needs_auth", "terminal_path", "tp").join(starts.select(*place, "needs_auth", "start_path"), [*place, "needs_auth"], "left")
        ends = cut_lineage(ends)
        values = bind_params(ends, self.param_values).select("subject", "start_path", F.coalesce("terminal_path", F.lit("")).alias("tp"), "route_params")
        bound = cut_lineage(ends.join(values, ["subject", "start_path", "tp"], "left").select(*place, "needs_auth", "tp", "route_params"))
        d = self.i.unwritten.withColumn("needs_auth", needs).withColumn("tp", tp)
        d = d.join(left_out, ["k", "workflow_id"], "left_anti").join(dealt(starts), ["k", "needs_auth"], "left")
        return d.join(dealt(bound), ["k", "needs_auth", "tp"], "left").drop("tp")

    @cached_property
    def _intent_ends(self) -> DataFrame:
        """Distinct (component, need for a login, terminal) that intents of a component may have.

        An intent ends nowhere in the application, where a hook of its component lands or where its first start leads. These
        few rows are a superset of what the intents have, and no intent is made for them.
        """
        f = self.i.f
        place = ["k", "subject", "comp_id"]
        landings = f.hooks.where("landing.final_route is not null").select("k", F.col("landing.path").alias("terminal_path"))
        entries = f._starts_by_component.select("k", F.col("entry.path").alias("terminal_path"))
        nowhere = f._starts_by_component.select("k", F.lit(None).cast("string").alias("terminal_path"))
        ends = landings.unionByName(entries).unionByName(nowhere).distinct().join(f.g.t.components.select(*place), "k")
        both = ends.withColumn("needs_auth", F.explode(F.array(F.lit(True), F.lit(False))))
        return cut_lineage(both.select(*place, "needs_auth", "terminal_path", F.coalesce("terminal_path", F.lit("")).alias("tp")))

    @cached_property
    def form_data(self) -> DataFrame:
        """Values of form fields per workflow (F4): override, login credential, synthesised."""
        return self._form_data(self.assigned)

    def _form_data(self, assigned: DataFrame) -> DataFrame:
        w = assigned.where("trigger_kind = 'WIDGET_SUBMITS_FORM'").select(
            "subject", "comp_id", "workflow_id", F.col("widget_id").alias("form_id"), "start_path", "login_route", "login", "selector", "is_template").repartition("subject", "comp_id")
        credential = F.when(F.col("login").isNotNull() & (F.col("start_path") == F.col("login_route")),
                            F.when(F.col("form_control_name") == "username", F.col("login.username")).when(F.col("form_control_name") == "password", F.col("login.password")))
        place = ["subject", "comp_id"]
        given = self.form_overrides.select(*place, "workflow_id", "key", F.col("value").alias("given")).repartition(*place)
        return cut_together(w.join(self.i.fields.repartition(*place), [*place, "form_id"]).join(given, [*place, "workflow_id", "key"], "left")
                            .withColumn("value", F.coalesce("given", credential, default_value(F.col("workflow_id")))))

    # ---- dialogs: facts per component -----------------------------------------------

    @cached_property
    def _inbound(self) -> DataFrame:
        c = self.i.f.g.t.components.select("subject", F.col("comp_id").alias("from_id"), F.col("selector").alias("parent_selector"))
        return self.i.f.composes.select("subject", "from_id", F.col("to_id").alias("comp_id"), "inside_ng_if", "inside_ng_for", "inside_template").join(c, ["subject", "from_id"])

    @cached_property
    def _rendered_on(self) -> DataFrame:
        """First route that activates a component."""
        r = self.i.f.g.t.routes.select("subject", F.col("route_id").alias("from_id"), "full_path")
        a = self.i.f.activates.select("subject", "from_id", F.col("to_id").alias("opener"))
        return a.join(r, ["subject", "from_id"]).groupBy("subject", "opener").agg(F.min_by("full_path", "from_id").alias("opener_path"))

    @cached_property
    def openers(self) -> DataFrame:
        """How the dialog around a component is opened, by three rules (F11), one row per component."""
        f, t = self.i.f, self.i.f.g.t
        keys = ["subject", "comp_id"]
        deferred = self._inbound.groupBy(*keys).agg(
            F.bool_or(F.coalesce("inside_template", F.lit(False)) | F.col("inside_ng_for").isNotNull()).alias("deferred"), F.min("from_id").alias("opener"))
        clicks = f.triggers.where("kind = 'WIDGET_TRIGGERS_HANDLER'").select("k", "subject", "from_id", "comp_id", "effect_group", "edge_id")
        # rule 1: a component named dialog or modal, opened by a handler of the component composing it
        groups = f.effects.select("subject", "effect_group", (F.size("calls") > 0).alias("c"), F.col("nav").isNotNull().alias("n"))
        quiet = clicks.join(groups.where("c and not n"), ["subject", "effect_group"]).groupBy("k", "subject", F.col("comp_id").alias("opener")).agg(F.min("from_id").alias("widget_id")).repartition("k")
        widgets = t.widgets.select("k", "subject", "comp_id", "widget_id", "tag_name", "attributes", "kind", "is_template", "inside_ng_for", "text")
        how = (F.when(non_empty(attr("data-testid")), F.concat(F.lit('[data-testid="'), attr("data-testid"), F.lit('"]')))
               .when(non_empty(attr("id")), F.concat(F.lit("#"), attr("id")))
               .when(non_empty(attr("class")) & ~all_classes_generic(attr("class")), _class_selector(attr("class")))
               .otherwise(tag_position("widget_id", "tag_name")))
        opens = quiet.join(widgets.drop("subject"), ["k", "widget_id"]).select("subject", "opener", how.alias("opener_widget"))
        selectors = t.components.select("subject", F.col("comp_id").alias("opener"), F.col("selector").alias("opener_selector"))
        named = (t.components.where(F.col("selector").rlike("(?i)dialog|modal")).select(*keys)
                 .join(deferred.where("not deferred"), keys).join(selectors, ["subject", "opener"])
                 .join(opens, ["subject", "opener"], "left").join(self._rendered_on, ["subject", "opener"], "left")
                 .select(*keys, F.struct("opener_selector", "opener_widget", "opener_path").alias("by_name")))
        # rule 2: the only plain button of the same component with a handler opens its own template
        buttons = widgets.where("kind = 'Button' and is_template = 0")
        acting = buttons.join(clicks.select("k", F.col("from_id").alias("widget_id")).repartition("k").distinct(), ["k", "widget_id"], "left_semi")
        only = acting.groupBy("k", *keys).agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("widget_id", "tag_name"), "widget_id").alias("b")).where("n = 1")
        place = (buttons.select("k", "widget_id").join(only, "k").where(F.col("widget_id") <= F.col("b.widget_id"))
                 .groupBy("k", *keys, "b").agg(F.count(F.lit(1)).alias("at")))
        own = place.select(*keys, F.concat(F.coalesce("b.tag_name", F.lit("button")), F.lit(":"), "at").alias("by_button")).join(
            deferred.where("deferred").select(*keys), keys, "left_anti")
        # rule 3: a button with text in a component that shows this one under a plain flag
        texts = (acting.where("inside_ng_for is null and coalesce(text, '') <> ''").groupBy("subject", F.col("comp_id").alias("from_id"))
                 .agg(F.max_by("text", "widget_id").alias("opener_text")))
        flagged = (self._inbound.where(F.col("inside_ng_if").rlike(r"^[a-zA-Z_$][a-zA-Z0-9_$]*$")).join(texts, ["subject", "from_id"])
                   .withColumn("opener", F.col("from_id")).join(self._rendered_on, ["subject", "opener"], "left")
                   .groupBy(*keys).agg(F.min_by(F.struct("parent_selector", "opener_text", "opener_path"), "from_id").alias("by_flag")))
        return named.join(own, keys, "full_outer").join(flagged, keys, "full_outer")

    @cached_property
    def _openers_by_component(self) -> DataFrame:
        numbers = self.i.f.g.t.components.select("k", "subject", "comp_id")
        return cut_together(self.openers.join(numbers, ["subject", "comp_id"]).drop("subject", "comp_id"))

    @cached_property
    def plans(self) -> DataFrame:
        """One row per plan: account, start, parameters, conditions, locator, counts."""
        return cut_together(self._planned())

    def plans_with(self, *cols: str) -> DataFrame:
        """Plans with these columns only: unless all columns are written already, the others are neither made nor written.

        Dialogs and field counts, which take tables of their own, are looked up only for columns that rest on them.
        """
        if "plans" in self.__dict__:
            return self.plans.select(*cols)
        return cut_together(self._planned(bool(OF_DIALOGS & set(cols)), bool(OF_FIELDS & set(cols))).select(*cols))

    def _planned(self, dialogs: bool = True, fields: bool = True) -> DataFrame:
        """Plans for `cut_together`; without `dialogs` or `fields` the columns that rest on these (OF_DIALOGS, OF_FIELDS) have no meaning."""
        if dialogs:
            d = self._assigned.join(per_component(self._openers_by_component), "k", "left")
        else:
            d = self._assigned.withColumns({c: F.lit(None).cast(t) for c, t in OPENERS.items()})
        template = F.col("is_template") == 1
        by_button = F.when(template, F.col("by_button"))
        by_flag = F.when(F.col("by_name").isNull() & by_button.isNull(), F.col("by_flag"))
        d = d.withColumns({"by_button": by_button, "by_flag": by_flag})
        base = substitute_params("start_path", "route_params")
        moved = F.coalesce("by_flag.opener_path", "by_name.opener_path")
        submits = F.col("trigger_kind") == "WIDGET_SUBMITS_FORM"
        if fields:
            n_fields = (self.i.fields.select("k", F.col("form_id").alias("widget_id")).repartition("k")
                        .groupBy("k", "widget_id").agg(F.count(F.lit(1)).alias("form_fields")))
            d = d.join(n_fields, ["k", "widget_id"], "left")
        else:
            d = d.withColumn("form_fields", F.lit(None).cast("bigint"))
        d = (d.withColumns({
            "has_account": F.col("username").isNotNull(),
            "has_auth": F.col("username").isNotNull() & F.col("login_route").isNotNull(),
            "start_url": F.coalesce(substitute_params(moved, "route_params"), base),
            "n_dialogs": F.col("by_name").isNotNull().cast("int") + F.col("by_button").isNotNull().cast("int") + F.col("by_flag").isNotNull().cast("int"),
            "dialog_selector": F.coalesce(F.when(F.col("by_name").isNotNull(), F.col("selector")), F.when(F.col("by_button").isNotNull(), F.lit("ngb-modal-window")),
                                          F.when(F.col("by_flag").isNotNull(), F.col("selector"))),
            "dialog_opener": F.coalesce("by_name.opener_widget", "by_button", F.concat(F.lit("text:"), "by_flag.opener_text")),
            "dialogs": F.filter(F.array(
                F.when(F.col("by_name").isNotNull(), F.struct(F.col("selector").alias("selector"), F.col("by_name.opener_widget").alias("opener"))),
                F.when(F.col("by_button").isNotNull(), F.struct(F.lit("ngb-modal-window").alias("selector"), F.col("by_button").alias("opener"))),
                F.when(F.col("by_flag").isNotNull(), F.struct(F.col("selector").alias("selector"), F.concat(F.lit("text:"), "by_flag.opener_text").alias("opener")))),
                lambda x: x.isNotNull()),
            "n_fields": F.when(submits, F.coalesce("form_fields", F.lit(0))).otherwise(0),
            "waits": non_empty("visible_expr").cast("int"),
            "locator": widget_locator(),
            "scope": F.when(template, "ngb-modal-window").otherwise(F.col("selector"))}))
        d = d.withColumns({
            "n_steps": F.col("waits") + F.col("n_fields") + 1,
            "n_pre": F.col("has_auth").cast("int") + F.col("start_path").isNotNull().cast("int") + F.col("n_dialogs")})
        return self._postcondition(d).withColumns({
            "budget_ms": time_budget(F.col("has_auth"), F.col("n_steps"), F.col("n_pre") + 1),
            "wait_reason": wait_reason(F.col("gates"), F.col("inside_ng_for"), F.col("has_auth"))})

    @cached_property
    def precondition_rows(self) -> DataFrame:
        """What must be done before the steps of a plan, in order, one row each (F11): login, navigation, every dialog opener."""
        def entry(kind, selector, value):
            return F.struct(F.lit(kind).alias("type"), selector.cast("string").alias("selector"), value.alias("value"))
        none, no_rows = F.lit(None), F.array().cast("array<struct<type:string,selector:string,value:string>>")
        rows = F.concat(
            F.when(F.col("has_auth"), F.array(entry("auth-setup", none, F.col("login_route")))).otherwise(no_rows),
            F.when(F.col("start_url").isNotNull(), F.array(entry("navigate-to-route", none, F.col("start_url")))).otherwise(no_rows),
            F.transform("dialogs", lambda x: entry("trigger-dialog-open", x["selector"], x["opener"])))
        d = self.plans_with("workflow_id", "has_auth", "login_route", "start_url", "dialogs")
        return d.select("workflow_id", F.posexplode(rows).alias("pos", "row")).select("workflow_id", "pos", "row.*")

    @staticmethod
    def _postcondition(d: DataFrame) -> DataFrame:
        """What must hold afterwards; the first rule that fits."""
        kind, term, login, start = F.col("trigger_kind"), F.col("terminal_path"), F.col("login_route"), F.col("start_path")
        submits, clicks, leaves = kind == "WIDGET_SUBMITS_FORM", kind == "WIDGET_TRIGGERS_HANDLER", kind == "WIDGET_NAVIGATES_EXTERNAL"
        def sure(c):
            return F.coalesce(c, F.lit(False))
        crash = (sure(submits & (start == login) & (term == start)) | sure(submits & (term == login) & (start != login))
                 | sure(submits & (F.col("n_dialogs") > 0)) | sure(term.contains("**")) | sure(leaves & (attr("target") == "_blank"))
                 | sure(clicks & non_empty("router_link")) | F.col("css_hidden") | (clicks & ~F.col("has_nav")))
        kept = F.map_filter("route_params", lambda k, _: F.array_contains(F.coalesce("start_params", F.array().cast(STRINGS)), k))
        expected = substitute_params(term, F.when(submits, kept).otherwise(F.col("route_params")))
        d = d.withColumn("expected_path", expected)
        either = F.col("has_nav") & (clicks | submits) & sure(start != F.col("expected_path"))
        return d.withColumn("post_type", F.when(crash, "assert-no-crash")
                            .when(leaves, F.when(F.col("external_url").isNotNull(), "assert-url-matches").otherwise("assert-no-crash"))
                            .when(term.isNotNull(), F.when(either, "assert-url-matches-or-unchanged").otherwise("assert-url-matches"))
                            .otherwise("assert-no-crash")).withColumn(
            "post_expected", F.when(F.col("post_type") != "assert-no-crash", F.when(leaves, F.col("external_url")).otherwise(F.col("expected_path")))).withColumn(
            "post_fallback", F.when(F.col("post_type") == "assert-url-matches-or-unchanged", substitute_params("start_path", "route_params")))

    @cached_property
    def steps(self) -> DataFrame:
        """Action steps of plans, one row each (F12). `pos` follows the order of field ids."""
        plans = self.plans_with(*STEP_COLUMNS)  # filled forms are taken from the same table
        wait = plans.where("waits = 1").select("subject", "workflow_id", F.lit("").alias("item"), F.lit(0).alias("part"), F.lit("wait-for-element").alias("type"),
                                                     F.col("locator.strategy").alias("strategy"), F.col("locator.value").alias("locator"), F.lit("").alias("value"), F.col("selector").alias("scope"))
        loc = field_locator()
        radio = F.col("kind") == "RadioGroup"
        filled = self.form_data if "form_data" in self.__dict__ else self._form_data(plans)
        fills = filled.select(
            "subject", "workflow_id", F.col("field_id").alias("item"), F.lit(1).alias("part"), step_type().alias("type"),
            F.when(radio, "custom").otherwise(loc["strategy"]).alias("strategy"),
            F.when(radio, F.when(F.col("form_control_name").isNotNull(), F.concat(F.lit("[formcontrolname='"), "form_control_name", F.lit("'] mat-radio-button")))
                   .otherwise(F.concat("tag_name", F.lit(" mat-radio-button")))).otherwise(loc["value"]).alias("locator"),
            F.when(step_type() == "click", "").otherwise(F.col("value")).alias("value"),
            F.when(F.col("is_template") == 1, "ngb-modal-window").otherwise(F.col("selector")).alias("scope"))
        act = plans.select("subject", "workflow_id", F.lit("~").alias("item"), F.lit(2).alias("part"),
                                F.when(F.col("trigger_kind") == "WIDGET_SUBMITS_FORM", "submit").otherwise("click").alias("type"),
                                F.col("locator.strategy").alias("strategy"), F.col("locator.value").alias("locator"), F.lit("").alias("value"), "scope")
        return wait.unionByName(fills).unionByName(act)


def generation_rates(plans: DataFrame, tests: DataFrame, eligible: DataFrame) -> DataFrame:
    """Tests per plan and per eligible workflow, per application and in total."""
    def count(df, name):
        return df.groupBy("subject").agg(F.count(F.lit(1)).alias(name))
    j = count(eligible, "n_eligible").join(count(plans, "n_plans"), "subject", "left").join(count(tests, "n_tests"), "subject", "left").na.fill(0)
    r = j.rollup("subject").agg(F.grouping("subject").alias("is_total"), *[F.sum(c).alias(c) for c in ("n_eligible", "n_plans", "n_tests")])
    return r.withColumns({"per_plan": ratio("n_tests", "n_plans"), "per_eligible": ratio("n_tests", "n_eligible")})
