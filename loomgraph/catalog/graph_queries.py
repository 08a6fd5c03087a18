"""G queries: registries to graph."""

from pyspark.sql import functions as F

from loomgraph.catalog.registry import query
from loomgraph.catalog.shared import graph
from loomgraph.functions import fixed
from loomgraph.functions.scalar import path_matches, segments
from loomgraph.functions.scale import cut_lineage, cut_together
from loomgraph.operators import graph as gr
from loomgraph.operators import resolve
from loomgraph.sources.views import union_all

EDGE = "subject:s edge_id:s kind:s from_id:s to_id:s"
STRUCTURAL = ", ".join(f"'{k}'" for k in fixed.STRUCTURAL_KINDS)


def atom_text(col="atoms"):
    return F.array_join(F.transform(col, lambda a: F.concat(
        a["kind"], F.lit("("), F.array_join(F.slice(a["args"], F.lit(2), F.greatest(F.size(a["args"]) - 1, F.lit(0))), ","), F.lit(")"))), ";")


def edges_of(name, piece, *kinds):
    """A query for the edges of some kinds, checked against the same kinds of the whole edge view."""
    listed = ", ".join(f"'{k}'" for k in kinds)

    @query(name, EDGE, f"select * from v_edge where kind in ({listed})")
    def run(t):
        return getattr(graph(t), piece)
    return run


@query("G1_nodes", "subject:s node_id:s kind:s label:s", "select * from v_node")
def nodes(t):
    return graph(t).nodes


def facts(*pairs):
    return "array_to_string(list_sort(list_filter([" + ", ".join(f"'{k}=' || {v}" for k, v in pairs) + "], lambda x: x is not null)), ';')"


@query("G1_node_facts", "subject:s node_id:s file:s facts:s", f"""
select subject, module_id as node_id, split_part(module_id, '#', 1) as file, {facts(('name', 'name'), ('isStandaloneRoot', "'false'"))} as facts from v_module
union all select r.subject, r.route_id, split_part(r.module_id, '#', 1), {facts(('fullPath', 'full_path'), ('path', 'path'), ('isTopLevel', '(parent_id is null)'), ('isEntry', '(e.route_id is not null)'),
  ('isWildcard', "(route_type = 'WildcardRoute')"), ('params', "array_to_string(params, ',')"), ('guards', "array_to_string(guards, ',')"), ('roles', "array_to_string(roles, ',')"), ('redirectTo', 'redirect_to'), ('routeType', 'route_type'))}
  from v_route r left join v_entry e on e.subject = r.subject and e.route_id = r.route_id
union all select subject, comp_id, split_part(comp_id, '#', 1), {facts(('name', 'class_name'), ('selector', 'selector'))} from v_component
union all select subject, widget_id, split_part(comp_id, '#', 1), {facts(('widgetKind', 'kind'), ('tagName', 'tag_name'), ('componentId', 'comp_id'), ('parentId', 'parent_id'), ('text', 'text'))} from v_widget
union all select subject, svc_id, file, {facts(('name', 'name'), ('providedIn', 'provided_in'))} from v_service
union all select e.subject, e.to_id, arg_min(b.file, b.seq), 'url=' || arg_min(b.value, b.seq) from v_edge e join v_binding b on b.widget_id = e.from_id and b.seq = e.seq
  where e.kind = 'WIDGET_NAVIGATES_EXTERNAL' and b.name = 'href' group by e.subject, e.to_id""")
def node_facts(t):
    pairs = F.array_sort(F.transform(F.map_entries("meta"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return graph(t).nodes.select("subject", "node_id", F.col("refs")[0]["file"].alias("file"), F.array_join(pairs, ";").alias("facts"))


@query("G2_external_nodes", "subject:s node_id:s url:s", "select subject, node_id, label as url from v_node where kind = 'External'")
def externals(t):
    return graph(t).externals


@query("G3_entry_routes", "subject:s route_id:s", """
select * from v_entry""")
def entry(t):
    return graph(t).entry_routes


@query("G4_edge_guard", "subject:s kind:s from_id:s to_id:s", """
select x.subject, 'COMPONENT_COMPOSES_COMPONENT' as kind, x.comp_id as from_id, c.comp_id as to_id
from v_use x join v_component c on c.subject = x.subject and x.used_ref = c.selector""")
def guard(t):
    g = graph(t)
    paths = t.components.select("subject", "selector", F.regexp_replace("comp_id", r"[^/]*$", "").alias("folder"))
    made = t.uses.where("used_ref like 'app-%'").join(paths.select("subject", "folder").distinct(), "subject")
    number = F.regexp_extract("used_ref", r"^app-[a-z](\d+)", 1)
    known = F.when(F.col("used_ref").startswith("app-s"), "s").otherwise("x")
    made = made.withColumn("to", F.concat("folder", known, number, F.lit(".ts#S"), number, F.lit("Component")))
    return gr.edge_guard(gr.edge(made, "COMPONENT_COMPOSES_COMPONENT", "comp_id", "to", "seq"), g.nodes.where("kind = 'Component'"))


@query("G5_parallel_edges", "subject:s from_id:s to_id:s n:i last_id:s", """
select subject, from_id, to_id, count(*) as n, max(edge_id) as last_id from v_edge
where kind in ('COMPONENT_CALLS_SERVICE', 'WIDGET_TRIGGERS_HANDLER') group by all having count(*) > 1""")
def parallel(t):
    g = graph(t)
    return (g.of_kind("COMPONENT_CALLS_SERVICE", "WIDGET_TRIGGERS_HANDLER")
            .groupBy("subject", "from_id", "to_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("edge_id").alias("last_id")).where("n > 1"))


edges_of("G6_module_declares_component", "declares_component", "MODULE_DECLARES_COMPONENT")
edges_of("G7_module_declares_route", "declares_route", "MODULE_DECLARES_ROUTE")
edges_of("G8_route_has_child", "has_child", "ROUTE_HAS_CHILD")
edges_of("G9_route_activates_component", "activates", "ROUTE_ACTIVATES_COMPONENT")
edges_of("G11_component_composes_component", "composes", "COMPONENT_COMPOSES_COMPONENT")
edges_of("G12_module_provides_service", "provides", "MODULE_PROVIDES_SERVICE")
edges_of("G13_module_imports_exports", "module_links", "MODULE_IMPORTS_MODULE", "MODULE_EXPORTS_MODULE")
edges_of("G14_route_redirects", "redirect_edges", "ROUTE_REDIRECTS_TO_ROUTE")


@query("G17_widget_navigates_external", EDGE, "select * from v_edge where kind = 'WIDGET_NAVIGATES_EXTERNAL'")
def external_links(t):
    return graph(t).of_kind("WIDGET_NAVIGATES_EXTERNAL")


@query("G10_widget_containment", EDGE, "select * from v_edge where kind in ('COMPONENT_CONTAINS_WIDGET', 'WIDGET_CONTAINS_WIDGET')")
def containment(t):
    g = graph(t)
    return g.contains_widget.unionByName(g.widget_contains)


@query("G11_composition_context", "subject:s from_id:s to_id:s inside_ng_if:s inside_ng_for:s inside_template:i",
       "select subject, from_id, to_id, inside_ng_if, inside_ng_for, case when seq > 1152921504606846975 then null else inside_template end as inside_template from v_compose")
def context(t):
    return graph(t).composes


@query("G15_widget_navigates_route", "subject:s edge_id:s to_id:s target_text:s params:s guards:s roles:s", """
select subject, edge_id, to_id, target_text, array_to_string(params, ',') as params, array_to_string(guards, ',') as guards, array_to_string(roles, ',') as roles
from v_edge where kind = 'WIDGET_NAVIGATES_ROUTE'""")
def navigates(t):
    return graph(t).of_kind("WIDGET_NAVIGATES_ROUTE").select(
        "subject", "edge_id", "to_id", "target_text", *[F.array_join(c, ",").alias(c) for c in ("params", "guards", "roles")])


@query("G16_resolution_by_stage", "subject:s stage:i n_texts:i n_links:i", """
select l.subject, coalesce(v.stage, 0) as stage, count(distinct (l.comp_id, l.value)) as n_texts, count(*) as n_links
from v_link l left join v_resolved v on v.subject = l.subject and v.comp_id = l.comp_id and v.value = l.value group by all""")
def stages(t):
    links = graph(t).links.withColumn("stage", F.coalesce("stage", F.lit(0)))
    per_text = links.groupBy("subject", "stage", "comp_id", "value").agg(F.count(F.lit(1)).alias("c"))
    return per_text.groupBy("subject", "stage").agg(F.count(F.lit(1)).alias("n_texts"), F.sum("c").alias("n_links"))


def stage_query(name, stage):
    @query(name, "subject:s comp_id:s value:s target_route_id:s",
           f"select subject, comp_id, value, target_route_id from v_resolved where stage = {stage}")
    def run(t):
        links = t.bindings.where("lower(name) = 'routerlink'")
        return resolve.resolve_links(links, t.routes).where(F.col("stage") == stage)


stage_query("G16a_exact_path", 1)
stage_query("G16b_relative_path", 2)
stage_query("G16c_array_path", 3)
stage_query("G16d_interpolated_path", 4)


@query("G16e_programmatic_path", "subject:s value:s stage:i target_route_id:s", "select * from v_nav_resolved")
def programmatic(t):
    nav = graph(t).contexts.where("shape = 'Navigate'").withColumn("value", F.col("target"))
    return resolve.resolve_programmatic(nav, t.routes)


@query("G16f_path_matches_template", "subject:s path:s full_path:s", """
select distinct t.subject, t.path, r.full_path from (select distinct subject, '/r' || (l_orderkey % 5) || '/n' || (l_orderkey % 25) || '/7' as path from v_line) t
join v_route r on r.subject = t.subject and regexp_matches(t.path, '^' || regexp_replace(replace(r.full_path, '*', '[*]'), ':[a-z]+', '[^/]+', 'g') || '$')""")
def matches(t):
    paths = t.lines.selectExpr("subject", "'/r' || (l_orderkey % 5) || '/n' || (l_orderkey % 25) || '/7' as path").distinct()
    keyed = paths.withColumn("segs", segments("path"))
    found = resolve.match_templates(keyed, "segs", t.routes)
    return found.where(path_matches(F.col("segs"), segments("full_path")))


@query("G18_handler_and_form_edges", "subject:s edge_id:s kind:s event:s effect_group:s", """
select * from v_edge where kind in ('WIDGET_TRIGGERS_HANDLER', 'WIDGET_SUBMITS_FORM')""")
def triggers(t):
    return graph(t).of_kind("WIDGET_TRIGGERS_HANDLER", "WIDGET_SUBMITS_FORM")


@query("G19_component_effects", "subject:s edge_id:s kind:s to_id:s effect_group:s call_ordinal:i target_text:s", """
select * from v_edge where kind in ('COMPONENT_CALLS_SERVICE', 'COMPONENT_NAVIGATES_ROUTE')""")
def effects(t):
    return graph(t).effect_edges


@query("G20_gate_propagation", "subject:s widget_id:s gates:s", """
select w.subject, w.widget_id, string_agg(distinct g.gate, ',' order by g.gate) as gates from v_widget w join v_gate g on g.subject = w.subject and g.comp_id = w.comp_id group by all""")
def gates(t):
    g = graph(t)
    # distinct gate names of one component come from its composition sites, a short list
    per_component = g.gates.groupBy("subject", "comp_id").agg(F.array_join(F.array_sort(F.collect_set("gate")), ",").alias("gates"))
    return t.widgets.select("subject", "comp_id", "widget_id").join(per_component, ["subject", "comp_id"])


@query("G21_graph_stats", "subject:s n_nodes:i n_edges:i n_structural:i n_executable:i n_atoms:i n_edges_with_atoms:i n_unresolved:i", f"""
select n.subject, n.n_nodes, e.n_edges, e.n_structural, e.n_executable, e.n_atoms, e.n_edges_with_atoms, e.n_unresolved
from (select subject, count(*) as n_nodes from v_node group by all) n join (
  select e.subject, count(*) as n_edges, count(*) filter (e.kind in ({STRUCTURAL})) as n_structural, count(*) filter (e.kind not in ({STRUCTURAL})) as n_executable,
    sum(coalesce(a.n_atoms, 0)) as n_atoms, count(a.n_atoms) as n_edges_with_atoms, count(*) filter (e.has_target and e.target_route_id is null) as n_unresolved
  from v_edge e left join v_atom_list a on a.edge_id = e.edge_id group by all) e using (subject)""")
def stats(t):
    g = graph(t)
    return gr.graph_stats(g.nodes, g.edge_counts)


@query("G21_kind_histogram", "subject:s kind:s n:i", "select subject, kind, count(*) as n from v_edge group by all")
def histogram(t):
    return graph(t).edge_counts.groupBy("subject", "kind").agg(F.sum("n").alias("n"))


@query("G22_canonical_order", "subject:s kind:s from_id:s edge_id:s", """
select * from v_edge where kind in ('ROUTE_HAS_CHILD', 'ROUTE_REDIRECTS_TO_ROUTE', 'COMPONENT_COMPOSES_COMPONENT') order by subject, from_id, kind, coalesce(to_id, ''), edge_id""")
def ordered(t):
    g = graph(t)
    return gr.canonical_order(union_all([g.has_child, g.redirect_edges, g.composes]))


@query("G23_navigation_surface", "subject:s route_id:s params:s guards:s roles:s", """
select subject, route_id, array_to_string(params, ',') as params, array_to_string(list_sort(guards), ',') as guards, array_to_string(list_sort(roles), ',') as roles from v_route""")
def surface(t):
    return graph(t).surfaces.select("subject", F.col("target_route_id").alias("route_id"),
                                    *[F.array_join(c, ",").alias(c) for c in ("params", "guards", "roles")])


@query("G24_interface_atoms", "edge_id:s n:i atoms:s", """
select e.edge_id, coalesce(a.n_atoms, 0) as n, coalesce(regexp_replace(a.atoms, '\\(,*\\)', '()', 'g'), '') as atoms
from v_edge e left join v_atom_list a on a.edge_id = e.edge_id where e.kind in ('WIDGET_TRIGGERS_HANDLER', 'WIDGET_SUBMITS_FORM')""")
def atoms(t):
    return cut_together(graph(t).of_kind("WIDGET_TRIGGERS_HANDLER", "WIDGET_SUBMITS_FORM").select("edge_id", F.size("atoms").alias("n"), atom_text().alias("atoms")))


@query("G25_violations", "subject:s rule:s n:i", """
select subject, 'missing_target' as rule, count(*) as n from v_binding where name = 'href' group by all
union all select subject, 'duplicate_node', count(*) from v_component group by all union all select subject, 'node_without_refs', count(*) from v_service group by all
union all select subject, 'edge_without_refs', count(*) from v_edge where kind = 'ROUTE_HAS_CHILD' group by all""")
def violations(t):
    """A damaged graph: outer nodes are left out, components are listed twice, services and child routes lose their evidence."""
    g = graph(t)
    some = g.nodes.withColumn("n_refs", F.when(F.col("kind") == "Service", 0).otherwise(F.col("n_refs")))
    damaged = union_all([some.where("kind <> 'External'"), some.where("kind = 'Component'")])
    edges = g.of_kind("WIDGET_NAVIGATES_EXTERNAL", "ROUTE_HAS_CHILD", "ROUTE_REDIRECTS_TO_ROUTE")
    edges = edges.withColumn("refs", F.when(F.col("kind") == "ROUTE_HAS_CHILD", F.array().cast(edges.schema["refs"].dataType)).otherwise(F.col("refs")))
    return gr.violations(damaged, cut_lineage(edges.select("subject", "edge_id", "from_id", "to_id", "refs", "has_target", "target_route_id"))).groupBy("subject", "rule").agg(F.count(F.lit(1)).alias("n"))


@query("G25_sound_graph", "subject:s n_edges:i n_violations:i", "select subject, count(*) as n_edges, 0 as n_violations from v_edge group by all")
def sound(t):
    g = graph(t)
    bad = gr.violations(g.nodes, g.edges).groupBy("subject").agg(F.count(F.lit(1)).alias("n_violations"))
    return g.edges.groupBy("subject").agg(F.count(F.lit(1)).alias("n_edges")).join(bad, "subject", "left").na.fill(0)


@query("G26_effect_group_rules", "subject:s rule:s n:i", """
select subject, 'handler_without_group' as rule, count(*) as n from v_edge where kind in ('WIDGET_TRIGGERS_HANDLER', 'WIDGET_SUBMITS_FORM') and event = 'click' group by all
union all select subject, 'call_without_ordinal', count(*) from v_edge where kind = 'COMPONENT_CALLS_SERVICE' and call_ordinal = 0 group by all""")
def effect_rules(t):
    """Groups of click edges and first ordinals are removed to see them reported."""
    g = graph(t)
    e = g.of_kind("WIDGET_TRIGGERS_HANDLER", "WIDGET_SUBMITS_FORM", "COMPONENT_CALLS_SERVICE", "COMPONENT_NAVIGATES_ROUTE")
    damaged = e.withColumn("effect_group", F.when(F.coalesce(F.col("event"), F.lit("")) == "click", None).otherwise(F.col("effect_group"))
                           ).withColumn("call_ordinal", F.when(F.col("call_ordinal") != 0, F.col("call_ordinal")))
    return gr.effect_violations(damaged).groupBy("subject", "rule").agg(F.count(F.lit(1)).alias("n"))
