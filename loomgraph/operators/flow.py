"""Workflow enumeration and verdicts.

The nested loops "route, widget, trigger" become joins. Start routes and closures are
computed once per component, route and handler, and a trigger picks them up by key, so
the number of (route, trigger) pairs never has to exist.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from loomgraph.functions.scale import cut_lineage, cut_together, per_component, reach
from loomgraph.operators.graph import REFS, STRINGS, Graph
from loomgraph.sources.views import union_all

EXPRESSION_ATOMS = ["WidgetVisibleExpr", "WidgetEnabledExpr", "WidgetRequiredExpr", "InputConstraintExpr"]
STEPS = "array<struct<edge_id:string,kind:string>>"
MERGED = ["params", "guards", "roles", "refs"]
NOTHING = {"params": STRINGS, "guards": STRINGS, "roles": STRINGS, "refs": REFS}


def _empty(kind: str):
    return F.array().cast(kind)


def redirect_closure(redirect_edges: DataFrame, routes: DataFrame) -> DataFrame:
    """Where a route ends when its redirects are followed (W5), one row per route.

    A route follows one edge, the smallest by (target, id). Only routes that redirect
    take part in the rounds; all chains advance together, one hop per round.
    """
    nxt = cut_lineage(redirect_edges.groupBy("subject", F.col("from_id").alias("current")).agg(
        F.min_by(F.struct("edge_id", "target_route_id", *MERGED),
                 F.struct(F.coalesce("target_route_id", F.lit("")), "edge_id")).alias("e")))
    active = nxt.select(
        "subject", F.col("current").alias("route_id"), "current", F.array("current").alias("seen"),
        _empty(STRINGS).alias("edge_ids"), *[_empty(k).alias(c) for c, k in NOTHING.items()],
        F.lit("active").alias("state"))
    done = []
    while True:
        moved = active.join(nxt, ["subject", "current"], "left")
        target = F.col("e.target_route_id")
        hop = F.col("e").isNotNull()
        stepped = moved.select(
            "subject", "route_id",
            F.when(hop & target.isNotNull(), target).otherwise(F.col("current")).alias("current"),
            F.when(hop & target.isNotNull(), F.array_append("seen", target)).otherwise(F.col("seen")).alias("seen"),
            F.when(hop, F.array_append("edge_ids", F.col("e.edge_id"))).otherwise(F.col("edge_ids")).alias("edge_ids"),
            *[F.when(hop, F.array_union(c, F.col(f"e.{c}"))).otherwise(F.col(c)).alias(c) for c in MERGED],
            F.when(~hop, "stable").when(target.isNull(), "unresolved")
            .when(F.array_contains("seen", target), "loop").otherwise("active").alias("state"))
        stepped = cut_lineage(stepped)
        done.append(stepped.where("state <> 'active'"))
        active = stepped.where("state = 'active'")
        if active.isEmpty():  # a loop is recognised at its second pass, so every chain ends
            break
    ended = union_all(done).select(
        "subject", "route_id", F.col("current").alias("final_route"), "edge_ids", "state", *MERGED)
    still = routes.select("subject", "route_id").join(nxt.select("subject", F.col("current").alias("route_id")),
                                                      ["subject", "route_id"], "left_anti")
    return ended.unionByName(still.select(
        "subject", "route_id", F.col("route_id").alias("final_route"), _empty(STRINGS).alias("edge_ids"),
        F.lit("stable").alias("state"), *[_empty(k).alias(c) for c, k in NOTHING.items()]))


def bootstrap_components(components: DataFrame, activates: DataFrame, composes: DataFrame, contains: DataFrame) -> DataFrame:
    """Shell components: nobody activates or composes them, yet they own something."""
    def ids(df, col):
        return df.select("subject", F.col(col).alias("comp_id")).distinct()
    return (components.select("subject", "comp_id")
            .join(ids(activates, "to_id"), ["subject", "comp_id"], "left_anti")
            .join(ids(composes, "to_id"), ["subject", "comp_id"], "left_anti")
            .join(ids(composes, "from_id").unionByName(ids(contains, "from_id")).distinct(), ["subject", "comp_id"], "left_semi"))


def ancestors(has_child: DataFrame, routes: DataFrame) -> DataFrame:
    """Every route with itself and the routes above it."""
    return reach(routes.select("subject", "route_id", F.col("route_id").alias("above")), has_child,
                 ["subject", "route_id"], "to_id", "from_id", "above")


EVERY_ROUTE = "*"
LINK_TARGET = "case when kind = 'WIDGET_NAVIGATES_ROUTE' then to_id end"


@dataclass
class Flow:
    """Workflows of all applications of a graph."""

    g: Graph

    @cached_property
    def activates(self) -> DataFrame:
        return cut_lineage(self.g.activates)

    @cached_property
    def composes(self) -> DataFrame:
        return cut_lineage(self.g.composes)

    @cached_property
    def closure(self) -> DataFrame:
        return redirect_closure(self.g.redirect_edges, self.g.t.routes)

    @cached_property
    def ancestors(self) -> DataFrame:
        return ancestors(self.g.has_child, self.g.t.routes)

    @cached_property
    def starts(self) -> DataFrame:
        """Routes that activate a component, with the route their entry redirects lead to."""
        bearing = self.activates.select("subject", F.col("from_id").alias("route_id")).distinct()
        return (bearing.join(self.closure.where("state <> 'unresolved'"), ["subject", "route_id"])
                .select("subject", F.col("route_id").alias("start_route"), F.col("final_route").alias("active_route")))

    @cached_property
    def bootstrap(self) -> DataFrame:
        return bootstrap_components(self.g.t.components, self.activates, self.composes, self.g.contains_widget)

    @cached_property
    def shell(self) -> DataFrame:
        """Bootstrap components with all they compose; active on every route."""
        return reach(self.bootstrap, self.composes, ["subject"], "from_id", "to_id", "comp_id")

    @cached_property
    def component_closure(self) -> DataFrame:
        """(root, component): what a routed component composes, directly or through others. Routes share it."""
        roots = self.activates.select("subject", F.col("to_id").alias("root")).distinct()
        return reach(roots.withColumn("comp_id", F.col("root")), self.composes, ["subject", "root"], "from_id", "to_id", "comp_id")

    @cached_property
    def active(self) -> DataFrame:
        """(active route, component): own and ancestors' components with their closures."""
        wanted = self.starts.select("subject", F.col("active_route").alias("route_id")).distinct()
        over = self.ancestors.join(wanted, ["subject", "route_id"], "left_semi")
        act = self.activates.select("subject", F.col("from_id").alias("above"), F.col("to_id").alias("root"))
        rooted = over.join(act, ["subject", "above"]).select("subject", F.col("route_id").alias("active_route"), "root").distinct()
        return rooted.join(self.component_closure, ["subject", "root"]).select("subject", "active_route", "comp_id").distinct()

    @cached_property
    def start_places(self) -> DataFrame:
        """(component, start route); a component of the shell has one row, EVERY_ROUTE, for all routes of its application."""
        return self.component_routes.unionByName(self.shell.select("subject", "comp_id", F.lit(EVERY_ROUTE).alias("start_route")))

    @cached_property
    def active_places(self) -> DataFrame:
        """(component, start route), every row of it: a component of the shell is active on all start routes of its application."""
        shell = self.shell.join(self.starts.select("subject", "start_route"), "subject")
        return self.component_routes.unionByName(shell.select("subject", "comp_id", "start_route"))

    @cached_property
    def component_routes(self) -> DataFrame:
        """(component, start route) outside the shell."""
        return (self.active.join(self.shell, ["subject", "comp_id"], "left_anti")
                .join(self.starts, ["subject", "active_route"]).select("subject", "comp_id", "start_route").distinct())

    @cached_property
    def component_starts(self) -> DataFrame:
        """First start route and number of start routes per component.

        The shell takes the figures of its application instead of a row per route.
        """
        own = self.component_routes.groupBy("subject", "comp_id").agg(
            F.min("start_route").alias("first_route"), F.count(F.lit(1)).alias("n_starts"))
        all_routes = self.starts.groupBy("subject").agg(F.min("start_route").alias("first_route"), F.count(F.lit(1)).alias("n_starts"))
        return own.withColumn("in_shell", F.lit(False)).unionByName(
            self.shell.join(all_routes, "subject").withColumn("in_shell", F.lit(True)))

    @cached_property
    def effect_edges(self) -> DataFrame:
        return cut_lineage(self.g.effect_edges)

    @cached_property
    def effects(self) -> DataFrame:
        """What a handler does: calls in order, then the smallest navigation, one row per handler.

        The array holds the calls of one handler body.
        """
        calls = self.effect_edges.where("kind = 'COMPONENT_CALLS_SERVICE'").groupBy("subject", "effect_group").agg(
            F.array_sort(F.collect_list(F.struct(F.coalesce("call_ordinal", F.lit(0)).alias("o"), "edge_id", "kind", "refs"))).alias("c"),
            F.bool_or(F.col("to_id").rlike("(?i)router|navigation")).alias("calls_router"))
        nav = self.effect_edges.where("kind = 'COMPONENT_NAVIGATES_ROUTE'").groupBy("subject", "effect_group").agg(
            F.min_by(F.struct("edge_id", "kind", "target_route_id", "params", "guards", "roles", "refs"), "edge_id").alias("nav"))
        return calls.join(nav, ["subject", "effect_group"], "full_outer").select(
            "subject", "effect_group", F.coalesce("calls_router", F.lit(False)).alias("calls_router"),
            F.coalesce(F.transform("c", lambda x: F.struct(x["edge_id"].alias("edge_id"), x["kind"].alias("kind"))), _empty(STEPS)).alias("calls"),
            F.coalesce(F.flatten(F.transform("c", lambda x: x["refs"])), _empty(REFS)).alias("call_refs"), "nav")

    @cached_property
    def trigger_places(self) -> DataFrame:
        """Number of triggers per component and kind: no ids, conditions or evidence are made."""
        return cut_together(self.g.owned_triggers.groupBy("k", "subject", "comp_id", "kind").agg(F.count(F.lit(1)).alias("n_triggers")).drop("k"))

    @property
    def trigger_counts(self) -> DataFrame:
        """Number of triggers per component, from the triggers if they are written already."""
        if "triggers" in self.__dict__:
            return self.triggers.groupBy("subject", "comp_id").agg(F.count(F.lit(1)).alias("n_workflows"))
        return self.trigger_places.groupBy("subject", "comp_id").agg(F.sum("n_triggers").alias("n_workflows"))

    @cached_property
    def triggers(self) -> DataFrame:
        """Trigger edges with their component (W4), without conditions and evidence."""
        return cut_together(self.g.owned_triggers.select("k", "subject", "comp_id", "from_id", "kind", "to_id", "seq", "effect_group", "event", "edge_id"))

    @cached_property
    def hooks(self) -> DataFrame:
        """What triggers of a component with the same handler or the same target share: effects and landing.

        One row per (component, effect group, target), so the joins run on these few rows and triggers take them by one key.
        """
        landing = self._closed.select("subject", F.col("route_id").alias("land_on"), "ended").withColumnRenamed("ended", "landing")
        by_handler = F.when(F.col("handler").isNotNull(), F.concat_ws("::", "to_id", "handler"))
        kinds = self.g.narrow_triggers.select("k", "subject", by_handler.alias("effect_group"), F.expr(LINK_TARGET).alias("link_target")).distinct()
        return (cut_together(kinds).join(self.effects, ["subject", "effect_group"], "left")
                .withColumn("land_on", F.coalesce("link_target", "nav.target_route_id"))
                .join(landing, ["subject", "land_on"], "left").drop("subject"))

    @cached_property
    def _closed(self) -> DataFrame:
        """Where a route ends, with the path of the end, as the struct `ended`."""
        paths = self.g.t.routes.select("subject", F.col("route_id").alias("final_route"), F.col("full_path").alias("path"))
        closed = self.closure.join(paths, ["subject", "final_route"], "left")
        return cut_lineage(closed.select("subject", "route_id", F.struct("final_route", "edge_ids", "state", *MERGED, "path").alias("ended")))

    @cached_property
    def _starts_by_component(self) -> DataFrame:
        """First start of a component with its number `k` and where it ends."""
        entry = self._closed.select("subject", F.col("route_id").alias("first_route"), F.col("ended").alias("entry"))
        numbers = self.g.t.components.select("subject", "comp_id", "k")
        return (self.component_starts.join(entry, ["subject", "first_route"]).join(numbers, ["subject", "comp_id"])
                .select("k", "first_route", "n_starts", "in_shell", "entry"))

    @cached_property
    def workflows(self) -> DataFrame:
        """One workflow per trigger of a component with a start route, written with all that is known of it."""
        return cut_together(self.started)

    def workflows_with(self, *cols: Column | str) -> DataFrame:
        """Workflows with these columns only: unless all columns are written already, the others are neither made nor written."""
        if "workflows" in self.__dict__:
            return self.workflows.select(*cols)
        return cut_together(self.started.select(*cols))

    @property
    def workflow_rows(self) -> DataFrame:
        """Workflows as they are: written, or yet to be written by the one who asks."""
        return self.workflows if "workflows" in self.__dict__ else self.started

    @property
    def started(self) -> DataFrame:
        """Workflows dealt by component number and not yet written, for `cut_together`."""
        return self.traced.where("first_route is not null").drop("seq")

    @cached_property
    def traced(self) -> DataFrame:
        """Every trigger with its workflow: start, steps, terminal, merged constraints, verdict.

        Triggers of components without a start route have no `first_route`. All that meets here is dealt by the number of
        the component, `k`, and not written, so a phase that goes on from here moves nothing again.
        """
        redirect = F.lit("ROUTE_REDIRECTS_TO_ROUTE")
        is_link = F.col("kind") == "WIDGET_NAVIGATES_ROUTE"
        h = self.hooks.withColumnsRenamed({"k": "__k", "effect_group": "__e"}).repartition("__k")
        base = self.g.owned_triggers.withColumn("__l", F.expr(LINK_TARGET)).join(h, (
            F.col("k") == F.col("__k")) & F.col("effect_group").eqNullSafe(F.col("__e")) & F.col("__l").eqNullSafe(F.col("link_target")), "left")
        base = base.join(per_component(self._starts_by_component), "k", "left")
        trigger_step = F.array(F.struct("edge_id", "kind"))
        def hops(ids):
            return F.coalesce(F.transform(ids, lambda i: F.struct(i.alias("edge_id"), redirect.alias("kind"))), _empty(STEPS))
        steps = F.concat(
            hops(F.col("entry.edge_ids")), trigger_step, F.coalesce("calls", _empty(STEPS)),
            F.when(F.col("nav").isNotNull(), F.array(F.struct(F.col("nav.edge_id").alias("edge_id"), F.col("nav.kind").alias("kind")))).otherwise(_empty(STEPS)),
            hops(F.col("landing.edge_ids")))
        def merged(c):
            kind = NOTHING[c]
            parts = [F.coalesce(F.col(f"entry.{c}"), _empty(kind)), F.col(c)]
            if c == "refs":
                parts.append(F.coalesce("call_refs", _empty(kind)))
            parts += [F.coalesce(F.col(f"nav.{c}"), _empty(kind)), F.coalesce(F.col(f"landing.{c}"), _empty(kind))]
            return F.array_distinct(F.concat(*parts))
        active_route = F.col("entry.final_route")
        unresolved = F.array_compact(F.array(
            F.when(is_link & F.col("target_route_id").isNull(), F.col("edge_id")),
            F.when(F.col("nav").isNotNull() & F.col("nav.target_route_id").isNull(), F.col("nav.edge_id")),
            F.when(F.col("landing.state") == "unresolved", F.element_at("landing.edge_ids", -1))))
        shaped = base.select(
            "k", "subject", F.col("edge_id").alias("workflow_id"), F.col("kind").alias("trigger_kind"), F.col("from_id").alias("widget_id"),
            "comp_id", "first_route", "n_starts", "in_shell", "effect_group", "event", "seq", active_route.alias("active_route"), "to_id",
            steps.alias("steps"),
            F.when(F.col("kind") == "WIDGET_NAVIGATES_EXTERNAL", F.coalesce("to_id", active_route))
            .otherwise(F.coalesce("landing.final_route", active_route)).alias("terminal_id"),
            F.when((F.col("kind") == "WIDGET_NAVIGATES_EXTERNAL") & F.col("to_id").isNotNull(), None)
            .when((F.col("kind") != "WIDGET_NAVIGATES_EXTERNAL") & F.col("landing.final_route").isNotNull(), F.col("landing.path"))
            .otherwise(F.col("entry.path")).alias("terminal_path"),
            ((F.col("entry.state") == "stable") & F.coalesce(F.col("landing.state") == "stable", F.lit(True))).alias("stabilized"),
            F.when(F.col("landing.state") == "loop", F.col("landing.final_route"))
            .when(F.col("entry.state") == "loop", active_route).alias("loop_route"),
            unresolved.alias("unresolved"), "atoms", *[merged(c).alias(c) for c in MERGED],
            F.col("nav").isNotNull().alias("has_nav"), (F.size(F.coalesce("calls", _empty(STEPS))) > 0).alias("has_calls"),
            F.coalesce("calls_router", F.lit(False)).alias("calls_router"))
        return classify(shaped)

    @cached_property
    def start_routes(self) -> DataFrame:
        """(workflow, start route), long form. The shell part is an equi join on the application."""
        workflows = self.workflows_with("subject", "workflow_id", "comp_id", "in_shell")
        own = workflows.where("not in_shell").select("subject", "workflow_id", "comp_id")
        shell = workflows.where("in_shell").select("subject", "workflow_id")
        return (own.join(self.component_routes, ["subject", "comp_id"]).select("subject", "workflow_id", "start_route")
                .unionByName(shell.join(self.starts.select("subject", "start_route"), "subject")))


def is_impossible(atoms="atoms"):
    return F.exists(atoms, lambda a: a["kind"].isin("WidgetVisible", "WidgetEnabled") & (a["args"][1] == "false"))


def classify(wf: DataFrame) -> DataFrame:
    """Verdict and explanation of merged workflows."""
    user_steps = F.filter("steps", lambda s: s["kind"] != "ROUTE_REDIRECTS_TO_ROUTE")
    deadlock = ~F.col("stabilized") & (F.size(user_steps) == 0)
    gates = F.filter("atoms", lambda a: a["kind"].isin(EXPRESSION_ATOMS))
    form_valid = F.exists("atoms", lambda a: a["kind"] == "FormValid")
    conditional = ((F.size("unresolved") > 0) | (F.size("params") > 0) | (F.size("guards") > 0) | (F.size("roles") > 0)
                   | (F.size(gates) > 0) | form_valid | ~F.col("stabilized"))
    pruned = deadlock | is_impossible()
    kept = ~pruned
    return wf.withColumns({
        "verdict": F.when(pruned, "PRUNED").when(conditional, "CONDITIONAL").otherwise("FEASIBLE"),
        "contradiction": F.when(~deadlock, F.try_element_at(F.filter(
            "atoms", lambda a: a["kind"].isin("WidgetVisible", "WidgetEnabled") & (a["args"][1] == "false")), F.lit(1))),
        "missing_params": F.when(kept, F.col("params")), "required_guards": F.when(kept, F.col("guards")),
        "required_roles": F.when(kept, F.col("roles")), "ui_gates": F.when(kept, gates),
        "requires_form_valid": kept & form_valid})


def merge_steps(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """Merged constraints from a long step table (W10): `steps(subject, workflow_id, pos, edge_id)`.

    Sets keep the order in which steps bring their members, atoms are concatenated.
    """
    joined = steps.join(edges.select("subject", "edge_id", "params", "guards", "roles", "atoms", "refs"), ["subject", "edge_id"])
    ordered = joined.groupBy("subject", "workflow_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "params", "guards", "roles", "atoms", "refs"))).alias("s"))
    def flat(c):
        return F.flatten(F.transform("s", lambda x: x[c]))
    return ordered.select("subject", "workflow_id", *[F.array_distinct(flat(c)).alias(c) for c in MERGED], flat("atoms").alias("atoms"))


def contradictory(wf: DataFrame) -> DataFrame:
    """Written-down rules the default verdict leaves out (W12): mutex, exclusive roles, empty ranges."""
    def other(tag):
        return F.filter("atoms", lambda a: (a["kind"] == "Other") & (a["args"][0] == tag))
    def clash(tag):
        pairs = F.array_distinct(F.transform(other(tag), lambda a: F.struct(a["args"][1].alias("k"), a["args"][2].alias("v"))))
        return F.size(pairs) > F.size(F.array_distinct(F.transform(pairs, lambda p: p["k"])))
    def bounds(name):
        return F.filter("atoms", lambda a: (a["kind"] == "InputConstraint") & (a["args"][1] == name))
    def inverted(low, high):
        return F.exists(bounds(low), lambda a: F.exists(bounds(high), lambda b: (a["args"][0] == b["args"][0]) & (
            a["args"][2].try_cast("double") > b["args"][2].try_cast("double"))))
    return wf.withColumns({"mutex": clash("Mutex"), "exclusive_role": clash("ExclusiveRoleGroup"),
                           "empty_length": inverted("minLength", "maxLength"), "empty_range": inverted("min", "max")})


def strict_verdict(wf: DataFrame) -> DataFrame:
    return contradictory(wf).withColumn("verdict", F.when(
        F.col("mutex") | F.col("exclusive_role") | F.col("empty_length") | F.col("empty_range"), "PRUNED").otherwise(F.col("verdict")))


def verdict_stats(wf: DataFrame) -> DataFrame:
    """Counts per application (W13); the members of a part are the rows with that verdict."""
    return wf.groupBy("subject").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "FEASIBLE").alias("feasible"),
        F.count_if(F.col("verdict") == "CONDITIONAL").alias("conditional"), F.count_if(F.col("verdict") == "PRUNED").alias("pruned"))


def graph_fingerprint(edges: DataFrame) -> DataFrame:
    """Hash of an application's edges that does not depend on row order.

    Rows are hashed on their own and the hashes are summed, so nothing is gathered.
    """
    text = F.concat_ws("|", "edge_id", "kind", "from_id", F.coalesce("to_id", F.lit("-")), F.coalesce("target_text", F.lit("-")))
    digest = F.sha2(text, 256)
    def piece(i):
        return F.sum(F.conv(F.substring(digest, 1 + 12 * i, 12), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)").cast("string")
    return edges.groupBy("subject").agg(F.concat_ws("-", piece(0), piece(1), piece(2), piece(3)).alias("p")).select(
        "subject", F.sha2("p", 256).alias("graph_hash"))


def statically_enabled(triggers: DataFrame) -> DataFrame:
    """Triggers whose widget is neither hidden nor disabled by a literal."""
    return triggers.where(~is_impossible())
