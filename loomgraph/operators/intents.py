"""Intents: what each workflow that is not pruned wants to do.

Facts that depend only on the component, the route or the form are computed there once
and joined, so no list is built again for every workflow.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from loomgraph.functions.scalar import non_empty, path_params, template_params
from loomgraph.functions.scale import cut_together, per_component
from loomgraph.operators.flow import EVERY_ROUTE, Flow

CSS_HIDDEN = r"(?i)\b(hide|hidden|d-none|visually-hidden|sr-only)\b"
STRINGS = "array<string>"
# what no later phase asks of an intent; it stays with its workflow
LEFT_BEHIND = ["steps", "refs", "atoms", "ui_gates", "unresolved", "loop_route", "contradiction", "missing_params", "required_guards", "required_roles"]


def trigger_event(kind: Column, event: Column) -> Column:
    """Event that fires the trigger."""
    return (F.when(kind.isin("WIDGET_NAVIGATES_ROUTE", "WIDGET_NAVIGATES_EXTERNAL"), "click")
            .when(kind == "WIDGET_SUBMITS_FORM", F.coalesce(event, F.lit("submit")))
            .when(kind == "WIDGET_TRIGGERS_HANDLER", event))


def date_format(ng_model: Column) -> Column:
    found = F.regexp_extract(ng_model, r"\|\s*date\s*:\s*'([^']+)'", 1)
    return F.when(found != "", found)


def form_fields(widgets: DataFrame) -> DataFrame:
    """Fields to fill in, one row per (form, field).

    Nested forms, buttons, options, hidden and read-only fields are left out. A template holds its forms whole, so forms,
    fields and options meet where the widgets of a component (`k`) are.
    """
    widgets = widgets.select("k", "subject", "comp_id", "widget_id", "parent_id", "kind", "tag_name", "attributes", "visible_literal", "required_literal",
                             "form_control_name", "min_length", "max_length", "min_value", "max_value", "pattern", "ng_model")
    forms = widgets.where("kind = 'Form'").select("k", F.col("widget_id").alias("form_id"))
    a = F.col("attributes")
    options = (widgets.where("kind = 'Option' and parent_id is not null").where(non_empty(F.try_element_at(a, F.lit("value"))))
               .select("k", F.col("parent_id").alias("of"), "widget_id", F.try_element_at(a, F.lit("value")).alias("value"))
               .groupBy("k", F.col("of").alias("widget_id")).agg(F.min_by("value", "widget_id").alias("first_option")))
    child = widgets.where("parent_id is not null and kind not in ('Form', 'Button', 'Option') and coalesce(visible_literal, 1) <> 0")
    child = child.where(~F.coalesce(F.try_element_at(a, F.lit("class")).rlike(CSS_HIDDEN), F.lit(False))
                        & ~F.coalesce(F.try_element_at(a, F.lit("type")) == "hidden", F.lit(False))
                        & ~F.coalesce(F.try_element_at(a, F.lit("readonly")).isin("", "true", "readonly"), F.lit(False)))
    name, fcn = F.try_element_at(a, F.lit("name")), F.col("form_control_name")
    picked = F.col("kind").eqNullSafe("Select") | F.col("tag_name").isin("select", "mat-select")
    read = child.select(
        "k", "subject", "comp_id", F.col("parent_id").alias("form_id"), "widget_id", "kind", "tag_name", "form_control_name", name.alias("name_attr"),
        F.when(fcn.isNull() & name.isNull(), F.try_element_at(a, F.lit("id"))).alias("id_attr"), F.try_element_at(a, F.lit("type")).alias("input_type"),
        "required_literal", "min_length", "max_length", "min_value", "max_value", "pattern", "ng_model")
    return (read.join(forms, ["k", "form_id"], "left_semi")
            .join(options, ["k", "widget_id"], "left")
            .select("k", "subject", "comp_id", "form_id", F.col("widget_id").alias("field_id"), F.coalesce("tag_name", F.lit("input")).alias("tag_name"), "kind",
                    "form_control_name", "name_attr", "id_attr", "input_type", (F.coalesce("required_literal", F.lit(0)) == 1).alias("required"),
                    "min_length", "max_length", "min_value", "max_value", "pattern", date_format(F.col("ng_model")).alias("date_format"),
                    F.when(picked, F.col("first_option")).alias("first_option"))
            .withColumn("key", F.coalesce("form_control_name", "name_attr", "id_attr", "field_id")))


@dataclass
class Intents:
    f: Flow

    @cached_property
    def route_guards(self) -> DataFrame:
        """Guards of a route and of the routes above it."""
        guards = self.f.g.t.routes.select("subject", F.col("route_id").alias("above"), F.explode("guards").alias("guard"))
        return self.f.ancestors.join(guards, ["subject", "above"]).select("subject", "route_id", "guard").distinct()

    @cached_property
    def component_guards(self) -> DataFrame:
        """Guard names met on the start routes of a component.

        Distinct (component, guard) pairs first; the array then has one entry per guard name.
        """
        f = self.f
        per_route = self.route_guards.withColumnRenamed("route_id", "start_route")
        own = f.component_routes.join(per_route, ["subject", "start_route"]).select("subject", "comp_id", "guard")
        everywhere = f.starts.join(per_route, ["subject", "start_route"]).select("subject", "guard").distinct()
        shell = f.shell.join(everywhere, "subject").select("subject", "comp_id", "guard")
        return own.unionByName(shell).groupBy("subject", "comp_id").agg(F.collect_set("guard").alias("start_guards"))

    @cached_property
    def route_records(self) -> DataFrame:
        return self.f.g.t.routes.select("subject", F.col("route_id").alias("start_route"), "full_path", path_params("full_path").alias("params"), "guards", "route_type")

    @cached_property
    def place_records(self) -> DataFrame:
        """Start routes of a component with path and sorted parameters (I3); the shell is one row per component, for every route."""
        own = self.f.start_places.join(self.route_records, ["subject", "start_route"], "left")
        return own.withColumn("full_path", F.coalesce("full_path", F.when(F.col("start_route") == EVERY_ROUTE, F.lit(EVERY_ROUTE)), F.lit("(unknown)")))

    @cached_property
    def start_records(self) -> DataFrame:
        """The same with the shell spelled out, for those who ask for single routes of it."""
        f = self.f
        pairs = f.component_routes.unionByName(f.shell.join(f.starts.select("subject", "start_route"), "subject").select("subject", "comp_id", "start_route"))
        return pairs.join(self.route_records, ["subject", "start_route"], "left").withColumn("full_path", F.coalesce("full_path", F.lit("(unknown)")))

    @cached_property
    def component_params(self) -> DataFrame:
        """Parameter names on any start route of a component; those of the shell are found once per application."""
        f = self.f
        named = self.place_records.select("subject", "comp_id", F.explode(template_params("full_path")).alias("p")).distinct()
        anywhere = f.starts.select("subject", "start_route").join(self.route_records, ["subject", "start_route"]).select("subject", F.explode(template_params("full_path")).alias("p")).distinct()
        both = named.unionByName(f.shell.join(anywhere, "subject").select("subject", "comp_id", "p"))
        return both.groupBy("subject", "comp_id").agg(F.collect_set("p").alias("start_params"))

    @cached_property
    def component_gates(self) -> DataFrame:
        return self.f.g.gates.groupBy("subject", "comp_id").agg(F.array_sort(F.collect_set("gate")).alias("comp_gates"))

    @cached_property
    def widget_facts(self) -> DataFrame:
        """Trigger widgets with the form around them and the conditions of their place (I4), dealt by component number."""
        w = self.f.g.t.widgets
        forms = w.where("kind = 'Form'").select("k", F.col("widget_id").alias("parent_id"), F.col("widget_id").alias("form_around"))
        numbered = self.component_gates.join(self.f.g.t.components.select("subject", "comp_id", "k"), ["subject", "comp_id"]).select("k", "comp_gates")
        own = F.col("visible_expr")
        gates = F.coalesce("comp_gates", F.array().cast(STRINGS))
        seen = w.select("k", "widget_id", "parent_id", "selector", "tag_name", F.col("kind").alias("widget_kind"), "attributes", "form_control_name", "text",
                        "inside_ng_for", "ng_for_item_tag", "ng_for_ordinal", "is_template", "visible_expr")
        return (seen.join(forms, ["k", "parent_id"], "left").join(per_component(numbered), "k", "left")
                .select("k", "widget_id", "selector", "tag_name", "widget_kind", "attributes", "form_control_name", "text",
                        "form_around", "inside_ng_for", "ng_for_item_tag", "ng_for_ordinal", "is_template", "visible_expr",
                        F.when(non_empty(own) & ~F.array_contains(gates, F.coalesce(own, F.lit(""))), F.array_append(gates, own)).otherwise(gates).alias("gates"),
                        F.coalesce(F.try_element_at("attributes", F.lit("class")).rlike(CSS_HIDDEN), F.lit(False)).alias("css_hidden")))

    @cached_property
    def router_links(self) -> DataFrame:
        """First router link text of a widget, dealt by component number."""
        inner = self.f.g.t.attachments.where("lower(name) = 'routerlink'").select("k", "widget_id", "seq", "value")
        return (inner.groupBy("k", "widget_id")
                .agg(F.min_by("value", F.struct("seq", "value")).alias("router_link")))

    @cached_property
    def component_facts(self) -> DataFrame:
        """What the intents of a component share: guards and parameters of its start routes, and how many the first one has."""
        first = self.f.g.t.routes.select("subject", F.col("route_id").alias("first_route"), F.size(path_params("full_path")).alias("first_params"))
        return (self.f.component_starts.select("subject", "comp_id", "first_route").join(first, ["subject", "first_route"], "left").drop("first_route")
                .join(self.component_guards, ["subject", "comp_id"], "left").join(self.component_params, ["subject", "comp_id"], "left")
                .join(self.f.g.t.components.select("subject", "comp_id", "k"), ["subject", "comp_id"]).drop("subject", "comp_id"))

    @cached_property
    def outer_urls(self) -> DataFrame:
        """Urls of the outer nodes the links of a component lead to."""
        urls = self.f.g.externals.select("subject", F.col("node_id").alias("terminal_id"), F.col("url").alias("external_url"))
        ends = self.f.g.narrow_triggers.where("kind = 'WIDGET_NAVIGATES_EXTERNAL'").select("k", "subject", F.col("to_id").alias("terminal_id")).distinct()
        return cut_together(ends).join(urls, ["subject", "terminal_id"]).drop("subject")

    @cached_property
    def intents(self) -> DataFrame:
        """Workflows that are not pruned with what they want, written."""
        return cut_together(self.unwritten)

    def intents_with(self, *cols: Column | str) -> DataFrame:
        """Intents with these columns only: unless all columns are written already, the others are neither made nor written."""
        if "intents" in self.__dict__:
            return self.intents.select(*cols)
        return cut_together(self.unwritten.select(*cols))

    @property
    def unwritten(self) -> DataFrame:
        """Intents for `cut_together`; all that is joined to their workflows is dealt by component number."""
        empty = F.array().cast(STRINGS)
        kept = self.f.started.where("verdict <> 'PRUNED'").withColumn("has_unresolved", F.size("unresolved") > 0).drop(*LEFT_BEHIND)
        d = (kept.join(self.widget_facts, ["k", "widget_id"]).join(self.router_links, ["k", "widget_id"], "left")
             .join(per_component(self.outer_urls), ["k", "terminal_id"], "left").join(per_component(self.component_facts), "k", "left"))
        guards = F.array_sort(F.array_union("guards", F.coalesce("start_guards", empty)))
        return d.withColumns({
            "guard_names": guards, "trigger_event": trigger_event(F.col("trigger_kind"), F.col("event")),
            "requires_params": (F.size("params") > 0) | (F.coalesce("first_params", F.lit(0)) > 0)}).drop("start_guards")

    @cached_property
    def fields(self) -> DataFrame:
        return cut_together(form_fields(self.f.g.t.widgets))


def intent_stats(workflows: DataFrame) -> DataFrame:
    return workflows.groupBy("subject").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("verdict") == "FEASIBLE").alias("feasible"),
        F.count_if(F.col("verdict") == "CONDITIONAL").alias("conditional"), F.count_if(F.col("verdict") == "PRUNED").alias("pruned"))
