"""Flat tables for viewers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomgraph.functions.scale import Pages, cut_lineage

LABEL_ORDER = ["id", "name", "formcontrolname", "aria-label", "placeholder", "title"]


def subtype() -> Column:
    """`tag:type` of a widget, the tag alone, or its kind."""
    t = F.try_element_at("attributes", F.lit("type"))
    return (F.when(F.col("tag_name").isNotNull() & t.isNotNull(), F.concat_ws(":", "tag_name", t))
            .otherwise(F.coalesce("tag_name", F.lower("kind"))))


def display_label() -> Column:
    """First non-empty naming attribute, else the subtype (V1)."""
    return F.coalesce(*[F.nullif(F.try_element_at("attributes", F.lit(k)), F.lit("")) for k in LABEL_ORDER], subtype())


def route_view(routes: DataFrame, entry: DataFrame, params: Column) -> DataFrame:
    """Routes with parameters, login flag and entry flag (V2)."""
    e = entry.select("subject", "route_id").withColumn("is_entry", F.lit(True))
    return routes.join(e, ["subject", "route_id"], "left").select(
        "subject", F.col("route_id").alias("node_id"), F.col("full_path").alias("label"), params.alias("params"),
        F.exists("guards", lambda g: F.contains(g, F.lit("Auth"))).alias("auth_required"), F.coalesce("is_entry", F.lit(False)).alias("is_entry"))


def widget_view(widgets: DataFrame) -> DataFrame:
    return widgets.select("subject", F.col("widget_id").alias("node_id"), display_label().alias("label"), "kind", subtype().alias("subtype"), "comp_id")


def edge_view(edges: DataFrame) -> DataFrame:
    """Edges with the number and text of their conditions (V3)."""
    text = F.transform("atoms", lambda a: F.concat(a["kind"], F.lit(": "), F.array_join(a["args"], ", ")))
    return edges.select("subject", "edge_id", "from_id", "to_id", "kind", F.size("atoms").alias("n_conditions"), text.alias("conditions"), "event", "handler", "target_text", "effect_group")


def kind_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts for the legend (V4); entry ids stay rows of the route view."""
    def c(df, what):
        return df.groupBy("subject", "kind").agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit(what))
    return c(nodes, "node").unionByName(c(edges, "edge"))


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """Nodes within some hops of the seeds, in either direction, with their distance (V5)."""
    e = edges.where("to_id is not null").select("subject", "from_id", "to_id")
    both = cut_lineage(e.select("subject", F.col("from_id").alias("node_id"), F.col("to_id").alias("nxt")).unionByName(
        e.select("subject", F.col("to_id").alias("node_id"), F.col("from_id").alias("nxt"))).distinct())
    frontier = cut_lineage(seeds.select("subject", "node_id").distinct().withColumn("hop", F.lit(0)))
    seen = frontier
    for h in range(1, hops + 1):
        found = frontier.select("subject", "node_id").join(both, ["subject", "node_id"]).select("subject", F.col("nxt").alias("node_id")).distinct()
        frontier = cut_lineage(found.join(seen, ["subject", "node_id"], "left_anti").withColumn("hop", F.lit(h)))
        seen = seen.unionByName(frontier)
    return seen


def induced_subgraph(nodes: DataFrame, edges: DataFrame, kinds: list[str], text: str) -> tuple[DataFrame, DataFrame]:
    """Nodes of some kinds whose id or label holds a text, and the edges between them (V6)."""
    low = text.lower()
    kept = nodes.where(F.col("kind").isin(kinds) & (F.contains(F.lower("node_id"), F.lit(low)) | F.contains(F.lower("label"), F.lit(low))))
    ids = kept.select("subject", "node_id").distinct()
    inner = (edges.where("to_id is not null").join(ids.withColumnRenamed("node_id", "from_id"), ["subject", "from_id"], "left_semi")
             .join(ids.withColumnRenamed("node_id", "to_id"), ["subject", "to_id"], "left_semi"))
    return kept, inner


def search_workflows(workflows: DataFrame, text: str = "", verdict: str | None = None, unresolved: bool = False, loop: bool = False,
                     start_paths: DataFrame | None = None) -> DataFrame:
    """Workflows by facet and by text in id, terminal, group, steps or start routes (V7)."""
    w = workflows
    if verdict is not None:
        w = w.where(F.col("verdict") == verdict)
    if unresolved:
        w = w.where("size(unresolved) > 0")
    if loop:
        w = w.where("loop_route is not null")
    if not text:
        return w
    low = F.lit(text.lower())
    steps = F.array_join(F.transform("steps", lambda s: F.concat_ws(" ", s["edge_id"], s["kind"])), " ")
    hit = F.contains(F.lower(F.concat_ws(" ", "workflow_id", "terminal_id", F.coalesce("effect_group", F.lit("")), steps)), low)
    if start_paths is not None:
        # start routes hang on components: a component hit covers its workflows
        by_route = start_paths.where(F.contains(F.lower("start_route"), low)).select("subject", "comp_id").distinct().withColumn("route_hit", F.lit(True))
        w = w.join(by_route, ["subject", "comp_id"], "left").where(hit | F.coalesce("route_hit", F.lit(False))).drop("route_hit")
        return w
    return w.where(hit)


def step_signatures(workflows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Workflows with the pattern of their steps and the kind of their terminal (V8)."""
    kinds = nodes.select("subject", F.col("node_id").alias("terminal_id"), F.col("kind").alias("terminal_kind"))
    j = workflows.join(kinds, ["subject", "terminal_id"], "left")
    return j.withColumn("signature", F.concat_ws(" > ", F.transform("steps", lambda s: s["kind"]), F.coalesce("terminal_kind", F.lit("?"))))


def signature_groups(signed: DataFrame, n: int = 10) -> DataFrame:
    """Largest patterns, and one row for all the others (V8); rows that stand for several workflows have their number in `n`."""
    g = signed.groupBy("signature").agg((F.sum("n") if "n" in signed.columns else F.count(F.lit(1))).alias("size"))
    top = g.orderBy(F.desc("size"), "signature").limit(n)
    rest = g.join(F.broadcast(top.select("signature")), "signature", "left_anti")
    return top.unionByName(rest.agg(F.lit("(others)").alias("signature"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")))


def termination_cause() -> Column:
    """Why a workflow ends (V9)."""
    return (F.when(F.col("loop_route").isNotNull(), "redirect loop").when(F.size("unresolved") > 0, "unresolved nav")
            .when(F.col("terminal_id").startswith("__ext__"), "external navigation")
            .when(F.size("steps") == 1, "trigger only (no effects)").otherwise("effect closure complete"))


def failure_distribution(tests: DataFrame, results: DataFrame, logs: DataFrame) -> DataFrame:
    """Failures by kind, by outcome where a log names none."""
    j = tests.join(results.where("outcome <> 'PASS'").select("test_id", "outcome"), "test_id").join(logs.select("test_id", "failure_kind"), "test_id", "left")
    return j.groupBy(F.coalesce(F.nullif("failure_kind", F.lit("")), "outcome").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def filter_results(tests: DataFrame, results: DataFrame, wanted: str) -> DataFrame:
    """Tests by result: an outcome, FAIL for any failure, NOT_EXECUTED, or all."""
    j = tests.join(results.select("test_id", "outcome"), "test_id", "left").withColumn("state", F.coalesce("outcome", F.lit("NOT_EXECUTED")))
    if wanted == "all":
        return j
    if wanted == "FAIL":
        return j.where("state not in ('PASS', 'NOT_EXECUTED')")
    return j.where(F.col("state") == wanted)


def result_page(pages: Pages, number: int, size: int) -> DataFrame:
    """One page of results that were written in reading order."""
    return pages.page(number, size).orderBy("__place").drop("__place")
