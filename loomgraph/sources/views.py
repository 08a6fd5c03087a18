"""Registry tables read from the driver's parquet files."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from loomgraph.functions import fixed
from loomgraph.functions.scale import cut_lineage, first_by
from loomgraph.sources import fixture as fx


class Tables:
    """The parquet tables of one folder, and the registries seen in them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # ---- application registries -------------------------------------------------

    @cached_property
    def suppliers(self) -> DataFrame:
        return self("supplier").selectExpr(
            "s_suppkey as k", f"{fx.APP_OF_SUPPLIER} as app", "s_suppkey % 20 + 1 as r",
            "cast(s_nationkey as bigint) as n", "cast(s_nationkey % 5 as bigint) as g")

    @cached_property
    def components(self) -> DataFrame:
        return self.suppliers.selectExpr("*", *[f"{e} as {c}" for c, e in fx.COMPONENT.items()])

    @cached_property
    def uses(self) -> DataFrame:
        """One row per component reference in a template, with the place it stands in."""
        rows = ", ".join(
            f"case when {cond} then named_struct('pos', {pos}L, 'used_ref', {ref}) end" for pos, cond, ref in fx.USES)
        return (self.components.selectExpr("subject", "comp_id", "k", "r", f"inline(array_compact(array({rows})))")
                .selectExpr("subject", "comp_id", "k * 8 + pos as seq", "pos", "used_ref",
                            *[f"{e} as {c}" for c, e in fx.USE_CONTEXT.items()]))

    @cached_property
    def services(self) -> DataFrame:
        return (self.suppliers.selectExpr("app", "k % 10 as j").where("j <> 9").distinct()
                .selectExpr("'app' || app as subject", "j", *[f"{e} as {c}" for c, e in fx.SERVICE.items()]))

    @cached_property
    def _nations(self) -> DataFrame:
        base = (self("customer").selectExpr(f"{fx.APP_OF_CUSTOMER} as app", "cast(c_nationkey as bigint) as n",
                                            "cast(c_nationkey % 5 as bigint) as g").distinct())
        w = W.partitionBy("app", "g")  # at most five nations: the rows are already distinct
        return (base.withColumn("root_n", F.min("n").over(w))
                .withColumn("next_n", F.coalesce(F.lead("n").over(w.orderBy("n")), F.col("root_n"))))

    @cached_property
    def routes(self) -> DataFrame:
        active = (self.suppliers.where("k % 2 = 0 and r > 1").groupBy("app", "n").agg(F.min("k").alias("k"))
                  .selectExpr("app", "n", "k", f"{fx.COMPONENT['comp_id']} as comp"))
        return (
            self._nations.join(active, ["app", "n"], "left")
            .selectExpr("*", "'app' || app as subject", f"{fx.MODULE_ID} as module_id", f"{fx.PARENT_PATH} as parent_path",
                        *[f"{e} as {c}" for c, e in fx.ROUTE.items()])
            .select(
                "subject", "app", "n", "g", "module_id", "full_path", "path", "parent_path", "redirect_to",
                F.concat_ws("@", "full_path", "module_id").alias("route_id"),
                F.when(F.col("parent_path").isNotNull(), F.concat_ws("@", "parent_path", "module_id")).alias("parent_id"),
                F.when(F.col("path") == "**", "WildcardRoute")
                .when(F.col("redirect_to").isNotNull() & F.col("comp").isNull(), "RedirectRoute")
                .otherwise("ComponentRoute").alias("route_type"),
                F.coalesce("comp", F.lit("__unknown__")).alias("comp_id"),
                F.array_compact(F.array("guard_1", "guard_2")).alias("guards"),
                F.array_compact(F.array("role")).alias("roles")))

    @cached_property
    def modules(self) -> DataFrame:
        return (self._nations.select("app", "g").distinct()
                .selectExpr("'app' || app as subject", "app", "g", f"{fx.MODULE_ID} as module_id", f"{fx.MODULE_NAME} as name"))

    @cached_property
    def declarations(self) -> DataFrame:
        named = self.components.select("app", "g", "class_name", F.col("k").alias("seq"))
        real = self.modules.join(named, ["app", "g"]).select("subject", "module_id", "seq", "class_name")
        ghost = self.modules.where("g = 1").selectExpr("subject", "module_id", "-1L as seq", "'GhostComponent' as class_name")
        return real.unionByName(ghost)

    @cached_property
    def module_links(self) -> DataFrame:
        """Imports and exports by name, in source order."""
        rows = ("array_compact(array("
                "case when g = 0 then named_struct('link','import','seq',1L,'name','R1Module') end,"
                "case when g = 0 then named_struct('link','import','seq',2L,'name','R2Module') end,"
                "case when g = 1 then named_struct('link','import','seq',1L,'name','R2Module') end,"
                "case when g = 1 then named_struct('link','import','seq',2L,'name','R2Module') end,"
                "case when g = 2 then named_struct('link','export','seq',1L,'name','R3Module') end,"
                "case when g = 3 then named_struct('link','export','seq',1L,'name','MissingModule') end))")
        return self.modules.selectExpr("subject", "module_id", f"inline({rows})")

    @cached_property
    def providers(self) -> DataFrame:
        return self.modules.selectExpr(
            "subject", "module_id", "explode(array('Svc' || g || 'Service', 'Svc' || (g + 5) || 'Service')) as provider")

    # ---- widgets, bindings, events, handler bodies ----------------------------------

    @cached_property
    def widgets(self) -> DataFrame:
        # keys travel as numbers, once, to their component, and texts are written from them there; a supplier has at most a hundred parts of a bucket
        base = (self("lineitem").join(self("part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
                .selectExpr("l_suppkey as k", "l_partkey as p", "p_size").repartition("k").distinct()
                .selectExpr("k", "p", "cast(p_size as bigint) as z", "p - p % 100 as bucket"))
        owned = W.partitionBy("k", "bucket")
        def first(kind):
            return F.min(F.expr(f"case when {fx.WIDGET_KIND} = '{kind}' then struct(p, z) end")).over(owned)
        base = (base.withColumns({"form": first("Form"), "select": first("Select")})
                .selectExpr("*", f"{fx.APP_OF_PAIR} as app").selectExpr("*", f"{fx.WIDGET_KIND} as kind", f"{fx.WIDGET_TAG} as tag_name", f"{fx.WIDGET_ID} as widget_id",
                            f"case when form is not null then {fx.widget_id_of('form')} end as form_id", f"case when `select` is not null then {fx.widget_id_of('`select`')} end as select_id",
                            *[f"{fx.COMPONENT[c]} as {c}" for c in ("subject", "comp_id", "selector")]))
        attrs = [f"{e} as {c}" for c, e in fx.WIDGET_ATTRS.items()]
        ui = [f"cast({e} as bigint) as {c}" if c in self._ui_numbers else f"{e} as {c}" for c, e in fx.WIDGET_UI.items()]
        names = {c: c[2:].replace("_", "-") for c in fx.WIDGET_ATTRS}
        pairs = [x for c, a in names.items() for x in (F.lit(a), F.col(c))]
        return (
            base.selectExpr("subject", "comp_id", "selector", "widget_id", "kind", "tag_name", "k", "p", "z",
                        f"case when kind in {fx.FIELD_KINDS} then form_id when kind = 'Option' then select_id end as parent_id",
                        *attrs, *ui)
            .withColumn("attributes", F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()))
            .drop(*names))

    _ui_numbers = {"visible_literal", "enabled_literal", "required_literal", "min_length", "max_length", "min_value",
                   "max_value", "ng_for_ordinal", "is_template"}

    @cached_property
    def lines(self) -> DataFrame:
        """Lineitems with the widget they belong to."""
        return self._lines(dealt=False)

    @cached_property
    def component_lines(self) -> DataFrame:
        """The same dealt by `k`, the number of the component: numbers travel and texts are written where they arrive.

        Joins and groups on `k` and more keys then need no other exchange (`cut_together`).
        """
        return self._lines(dealt=True)

    def _lines(self, dealt: bool) -> DataFrame:
        rows = self("lineitem").join(self("part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
        return ((rows.repartition("l_suppkey") if dealt else rows)
                .selectExpr("*", f"{fx.APP_OF_LINE} as app", "l_suppkey as k", "l_partkey as p", "cast(p_size as bigint) as z")
                .selectExpr("*", f"{fx.WIDGET_ID} as widget_id", f"{fx.WIDGET_KIND} as kind",
                            *[f"{fx.COMPONENT[c]} as {c}" for c in ("subject", "comp_id", "file")],
                            *[f"{e} as {c}" for c, e in fx.LINE.items()]))

    @cached_property
    def bindings(self) -> DataFrame:
        """Links: inner ones by route text, outer ones by url."""
        return (self.lines.where("l_returnflag = 'R' or (l_returnflag = 'N' and l_linestatus = 'F')")
                .selectExpr("subject", "comp_id", "widget_id", "file", "seq",
                            "case when l_returnflag = 'R' then 'routerLink' else 'href' end as name",
                            f"case when l_returnflag = 'R' then {fx.LINK_TEXT} else {fx.LINK_URL} end as value"))

    @cached_property
    def events(self) -> DataFrame:
        """Event bindings of widgets with the handler they name."""
        return (self.lines.where("l_returnflag = 'A' or (l_returnflag = 'N' and l_linestatus = 'O')")
                .selectExpr("subject", "comp_id", "widget_id", "kind", "file", "seq", "handler",
                            "case when l_returnflag = 'A' then 'click' else 'submit' end as event_type"))

    @cached_property
    def attachments(self) -> DataFrame:
        """`bindings` and `events` in one table, dealt by `k`: a link has `name` and `value`, an event `event_type` and `handler`."""
        link, event = "(l_returnflag = 'R' or (l_returnflag = 'N' and l_linestatus = 'F'))", "(l_returnflag = 'A' or (l_returnflag = 'N' and l_linestatus = 'O'))"
        return (self.component_lines.where(f"{link} or {event}")
                .selectExpr("k", "p", "subject", "comp_id", "widget_id", "kind", "file", "seq",
                            f"case when {link} then case when l_returnflag = 'R' then 'routerLink' else 'href' end end as name",
                            f"case when {link} then case when l_returnflag = 'R' then {fx.LINK_TEXT} else {fx.LINK_URL} end end as value",
                            f"case when {event} then case when l_returnflag = 'A' then 'click' else 'submit' end end as event_type",
                            f"case when {event} then handler end as handler"))

    @cached_property
    def calls(self) -> DataFrame:
        """Call expressions of handler bodies."""
        return self._calls(self.lines)

    @cached_property
    def component_calls(self) -> DataFrame:
        """The same dealt by `k`."""
        return self._calls(self.component_lines)

    @staticmethod
    def _calls(lines: DataFrame) -> DataFrame:
        return (lines.where(fx.IS_CALL)
                .selectExpr("subject", "comp_id", "handler", "file", "seq", "k", f"{fx.CALL_EXPR} as expr", f"{fx.CALL_ARG} as arg"))

    @cached_property
    def templates(self) -> DataFrame:
        """One template per order, its lineitems in line order (an order has few lines).

        Keys are gathered and the markup is written from them afterwards, so no text is shuffled or sorted.
        """
        snippet = fx.SNIPPET.replace("l_partkey", "x.l_partkey").replace("l_suppkey", "x.l_suppkey").replace("l_orderkey", "page_id")
        return (self("lineitem").groupBy(F.col("l_orderkey").alias("page_id"))
                .agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("parts"))
                .selectExpr("page_id", f"array_join(transform(parts, x -> {snippet}), '\n') as html"))

    # ---- pages ------------------------------------------------------------------------

    @cached_property
    def page_places(self) -> DataFrame:
        """Pages with host and path parts; the subject is the last label of the host."""
        return self("pages").selectExpr("page_id", "html", "url", f"{fx.PAGE_HOST} as host", f"{fx.PAGE_PATH} as path").selectExpr(
            "*", "split_part(host, '.', -1) as subject", "split_part(path, '/', 2) as seg1", "split_part(path, '/', 3) as seg2")

    @cached_property
    def page_records(self) -> DataFrame:
        """Nested route records as the paths of the pages suggest them."""
        p = self.page_places.where("seg1 <> ''").select("subject", "seg1").distinct()
        tops = p.groupBy("subject").agg(F.min("seg1").alias("low"))
        return union_all([
            tops.selectExpr("subject", "'root' as id", "cast(null as string) as parent", "'' as segment", "cast(null as string) as redirect"),
            tops.selectExpr("subject", "'any' as id", "'root' as parent", "'**' as segment", "cast(null as string) as redirect"),
            tops.selectExpr("subject", "'home' as id", "'root' as parent", "'home' as segment", "low || '/' as redirect"),
            p.selectExpr("subject", "seg1 as id", "'root' as parent", "seg1 as segment", "cast(null as string) as redirect"),
            p.selectExpr("subject", "seg1 || '-id' as id", "seg1 as parent", "':id' as segment", "cast(null as string) as redirect")])

    @cached_property
    def page_candidates(self) -> DataFrame:
        """One route candidate per page: pages of one path compete."""
        return self.page_places.where("seg1 <> ''").selectExpr(
            "subject", "page_id", "'/' || seg1 as full_path", "'/' || seg1 || '@' || host as id", "seg2 as child",
            "case when page_id % 7 = 0 then 'RedirectRoute' else 'ComponentRoute' end as route_type",
            "case when page_id % 7 = 0 then '/' || (page_id % 3) end as redirect",
            "case when page_id % 7 = 0 then null when url like 'https:%' then seg1 when page_id % 5 = 0 then '__unresolved__' || seg1 else '__unknown__' end as comp_id",
            "array_compact(array(case when url like '%?%' then 'QueryGuard' end, case when url like '%#%' then 'HashGuard' end)) as guards")

    # ---- manifests ------------------------------------------------------------------

    @cached_property
    def accounts(self) -> DataFrame:
        """Customers as test accounts, in key order, with the guards they satisfy."""
        return self("customer").selectExpr(
            f"'app' || {fx.APP_OF_CUSTOMER} as subject", "c_custkey as pos", "c_name as username",
            "case when c_acctbal < 0 then '' else 'pw' || c_custkey end as password",
            "array_compact(array(case when c_mktsegment in ('MACHINERY', 'BUILDING') then 'AuthGuard' end, "
            "case when c_mktsegment in ('BUILDING', 'FURNITURE') and c_acctbal > 9900 then 'RoleGuard' end)) as guards",
            "case when c_mktsegment = 'BUILDING' then array('admin') else cast(array() as array<string>) end as roles")

    @cached_property
    def param_values(self) -> DataFrame:
        """Global values (template NULL) and values for one route template."""
        from_routes = self.routes.where("n % 6 = 3").selectExpr(
            "subject", "full_path as template", "'id' as param", "'v' || n as value")
        apps = self.modules.where("g = 0").selectExpr(
            "subject", "cast(null as string) as template", "'id' as param", "'1' as value")
        return from_routes.unionByName(apps)

    @cached_property
    def logins(self) -> DataFrame:
        """Applications with a login page."""
        return (self.modules.where("g = 2").selectExpr("subject", f"{fx.LOGIN_ROUTE} as login_route").where("login_route is not null"))

    @cached_property
    def form_overrides(self) -> DataFrame:
        """Values the manifest gives to a field of one workflow: (widget, event place) names the workflow."""
        return self.events.where("event_type = 'submit' and kind = 'Form' and seq % 5 = 2").selectExpr(
            "subject", "comp_id", "widget_id || '::WIDGET_SUBMITS_FORM::' || comp_id || '::0' as workflow_id", "explode(array('email', 'city', 'fc4')) as key", "'given' as value").distinct()

    @cached_property
    def manifest_texts(self) -> DataFrame:
        return self("customer").selectExpr("c_custkey as manifest_id", f"'app' || {fx.APP_OF_CUSTOMER} as subject", f"{fx.MANIFEST_FOLDER} as folder", f"{fx.MANIFEST} as text")

    # ---- evidence -------------------------------------------------------------------

    @cached_property
    def attempts(self) -> DataFrame:
        """Events as test attempts: a test is one user on one day."""
        e = self("events").selectExpr(
            "event_id", "cast(user_id as string) || '/' || cast(cast(ts as date) as string) as test_id",
            "user_id", "cast(ts as timestamp) as ts", "event_type", "cast(round(value * 100) as bigint) as duration_ms",
            "cast(get_json_object(props, '$.k') as bigint) as k")
        n = F.row_number().over(W.partitionBy("test_id").orderBy("ts", "event_id"))
        return (e.withColumn("attempt", n.cast("long"))
                .selectExpr(
                    "*", "'u' || (user_id % 10) as subject",
                    "case event_type when 'purchase' then 'PASS' when 'signup' then 'FAIL_AUTH' "
                    "when 'error' then 'FAIL_ELEMENT_NOT_FOUND' when 'click' then 'FAIL_TIMEOUT' else 'FAIL_ASSERTION' end as outcome",
                    "200 + 100 * (k % 4) as status",
                    "case k % 3 when 0 then 'GET' when 1 then 'POST' else 'PUT' end as method"))

    @cached_property
    def pipeline_events(self) -> DataFrame:
        """Events as lines of a pipeline log: phase, severity and outcome beside the event."""
        return self("events").selectExpr(
            "event_id", "cast(ts as timestamp) as ts", "user_id", "event_type", "'u' || (user_id % 10) as subject",
            "case event_type when 'view' then 'A1' when 'click' then 'A2' when 'signup' then 'B1' when 'purchase' then 'B2' else 'B3' end as phase",
            "case when event_type = 'error' then 'error' when value < 5 then 'debug' when value > 50 then 'warn' else 'info' end as severity",
            "case event_type when 'purchase' then 'PASS' when 'error' then 'FAIL' else '' end as outcome")

    @cached_property
    def attempt_events(self) -> DataFrame:
        """Test attempts as they are reported, before any fold."""
        return self.attempts.selectExpr("event_id", "test_id", "cast(event_id % 3 as string) as run_id", "user_id", "ts", "unix_micros(ts) as at", "duration_ms", "outcome")

    @cached_property
    def steps(self) -> DataFrame:
        """Conversation turns as the steps of a test log."""
        return self("conversations").selectExpr(
            "cast(conv_id as string) as test_id", "'c' || (conv_id % 7) as subject", "turn as pos", "role", "text",
            "case when turn = 0 then 'pre-0' when turn % 3 = 2 then 'post-' || turn else 'step-' || turn end as step_id",
            "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(conv_id % 1000 + turn * 2 as int)) as ts_start",
            "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(conv_id % 1000 + turn * 2 + turn % 3 as int)) as ts_end")

    @cached_property
    def requests(self) -> DataFrame:
        """Network evidence of test logs: one request per turn, not always inside its step."""
        return self.steps.selectExpr(
            "test_id", "pos as req", "ts_start + make_interval(0, 0, 0, 0, 0, cast(length(text) % 4 as int)) as ts",
            "case length(text) % 3 when 0 then 'GET' when 1 then 'POST' else 'PUT' end as method",
            f"cast(element_at(array({', '.join(map(str, fx.STATUSES))}), cast(length(text) % {len(fx.STATUSES)} as int) + 1) as bigint) as status")

    @cached_property
    def logs(self) -> DataFrame:
        """Test logs of conversations: a test fails at its longest turn, the first of them."""
        longest = self.steps.groupBy("test_id", "subject").agg(F.max_by(F.struct("step_id", "text"), F.struct(F.length("text"), -F.col("pos"))).alias("s"))
        return longest.selectExpr(
            "test_id", "subject", "s.step_id as failed_step_id",
            "case length(s.text) % 5 when 0 then 'interaction-failed' when 1 then 'locator-not-found' when 2 then 'timeout' "
            "when 3 then 'assertion-failed' else 'unknown' end as failure_kind")

    @cached_property
    def failures(self) -> DataFrame:
        """The failing step of every test log."""
        steps = self.steps.select("test_id", "pos", F.col("step_id").alias("failed_step_id"))
        return self.logs.join(steps, ["test_id", "failed_step_id"]).selectExpr(
            "test_id", "subject", "pos", "split_part(failed_step_id, '-', 1) as phase", "failure_kind as kind")

    @cached_property
    def health(self) -> DataFrame:
        """Events as health checks of the applications under test; an error is a failed one."""
        return self("events").selectExpr(
            "'c' || (user_id % 7) as subject", "cast(ts as timestamp) as ts",
            "case when event_type = 'error' then case when value < 10 then 'port' else 'identity' end end as problem")

    def step_targets(self, steps: DataFrame) -> DataFrame:
        """What the registries say of the widgets some steps (test_id, pos) act on: turn n of conversation c acts on line n of order c."""
        tests = steps.select("test_id").distinct()
        lines = self.lines.withColumn("test_id", F.col("l_orderkey").cast("string")).join(tests, "test_id", "left_semi")
        every = cut_lineage(lines.selectExpr("test_id", "cast(l_linenumber as bigint) as pos", "subject as app", "comp_id", "widget_id", "handler", "l_returnflag", "l_linestatus", "p", "k"))
        line = first_by(every.join(steps.select("test_id", "pos").distinct(), ["test_id", "pos"], "left_semi"), ["test_id", "pos"], ["p", "k", "l_returnflag", "l_linestatus"], ["app", "comp_id", "widget_id", "handler", "l_returnflag", "l_linestatus"])
        calls = self.calls.join(line.select("comp_id", "handler").distinct(), ["comp_id", "handler"], "left_semi").groupBy("comp_id", "handler").agg(F.bool_or(F.col("expr") == "this.router.navigate").alias("goes"), F.bool_or(F.col("expr") == "this.dialog.open").alias("opens"))
        ui = self.widgets.join(line.select("widget_id").distinct(), "widget_id", "left_semi").selectExpr("widget_id", "selector", "tag_name", "visible_expr", "enabled_expr", "inside_ng_for", "attributes['class'] as class")
        ui = cut_lineage(ui)
        bound = self.param_values.selectExpr("subject", "template", "param")
        asked = self.routes.where("comp_id <> '__unknown__'").selectExpr("subject", "full_path", "comp_id", "explode_outer(filter(split(full_path, '/'), x -> x like ':%')) as part").selectExpr("subject", "full_path", "comp_id", "substr(part, 2) as param")
        given = asked.join(bound.where("template is null").select("subject", "param").distinct().withColumn("g", F.lit(True)), ["subject", "param"], "left").join(
            bound.where("template is not null").selectExpr("subject", "template as full_path", "param").distinct().withColumn("l", F.lit(True)), ["subject", "full_path", "param"], "left")
        routed = given.groupBy("comp_id").agg(F.bool_or(F.col("param").isNotNull()).alias("has_param"), F.bool_or(F.col("param").isNotNull() & F.col("g").isNull() & F.col("l").isNull()).alias("param_unbound"))
        composed = self.uses.selectExpr("subject", "lower(used_ref) as selector").distinct().withColumn("used", F.lit(True))
        facts = (line.join(ui, "widget_id").join(calls, ["comp_id", "handler"], "left").join(routed, "comp_id", "left")
                 .join(composed.withColumnRenamed("subject", "app"), ["app", "selector"], "left"))
        href = "(l_returnflag = 'N' and l_linestatus = 'F')"
        logged_in = self.logins.select(F.col("subject").alias("app")).distinct().withColumn("has_login", F.lit(True))
        apps = every.groupBy("test_id").agg(F.min_by("app", F.struct("pos", "p", "k")).alias("app")).join(logged_in, "app", "left").select("test_id", F.lit(0).cast("bigint").alias("pos"), "has_login")
        return facts.selectExpr(
            "test_id", "pos", "cast(null as boolean) as has_login", "param_unbound", f"{href} as external", f"l_returnflag = 'R' or {href} or coalesce(goes, false) as navigates", "has_param",
            "opens or selector like '%-dialog' as dialog", "visible_expr like '%:%' as async_gate", "inside_ng_for is not null as repeater",
            "tag_name in ('mat-sidenav', 'mat-drawer') or class like '%sidenav%' as sidenav", "visible_expr is not null or enabled_expr is not null as gated",
            "has_param is null and used is null as unrouted").unionByName(apps, allowMissingColumns=True)

    @cached_property
    def tests(self) -> DataFrame:
        """Tests seen in the events, with what earlier stages know about them."""
        return (self.attempts.groupBy("test_id", "user_id", "subject").agg(F.min("k").alias("k"), F.min("ts").alias("first_ts"))
                .selectExpr(
                    "test_id", "user_id", "subject", "k", "date_trunc('day', first_ts) as run_start",
                    "case when user_id % 9 = 0 then 'PRUNED' when user_id % 4 = 0 then 'FEASIBLE' else 'CONDITIONAL' end as verdict",
                    "user_id % 9 <> 0 and user_id % 7 <> 0 as has_plan", "user_id % 9 <> 0 and user_id % 7 <> 0 and user_id % 5 <> 0 as has_code",
                    "user_id % 20 = 3 as skipped",
                    # the log a test left behind
                    "k % 11 <> 0 as log_exists", "date_trunc('day', first_ts) - make_interval(0, 0, 0, 0, 0, 0, case when k % 13 = 0 then 6 else 4 end) as log_time",
                    "case when k % 17 = 0 then null when k % 7 = 0 then 'FAIL' else 'PASS' end as log_outcome", "k % 5 as log_steps", "k % 17 = 0 as log_broken"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def kind_values(spark: SparkSession) -> DataFrame:
    """Edge kinds with what they mean. A fixed table of a few rows."""
    kinds = fixed.STRUCTURAL_KINDS + fixed.TRIGGER_KINDS + fixed.EFFECT_KINDS + ["ROUTE_REDIRECTS_TO_ROUTE"]
    return spark.createDataFrame(
        [(k, k in fixed.STRUCTURAL_KINDS, k in fixed.TRIGGER_KINDS, k in fixed.EFFECT_KINDS) for k in kinds],
        "kind string, structural boolean, trigger boolean, effect boolean")
