"""Route records, module roles and guard summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomgraph.functions import fixed
from loomgraph.functions.scalar import any_contains, join_path, path_params, redirect_path, sorted_unique, truncate
from loomgraph.functions.scale import cut_lineage
from loomgraph.sources.views import union_all


def flatten_routes(records: DataFrame) -> DataFrame:
    """Route tree to rows with full paths (X19): one join per level of the tree.

    `records` has (subject, id, parent, segment, redirect). Relative redirects hang below
    the parent's path.
    """
    kids = cut_lineage(records.where("parent is not null")).select("subject", F.col("parent").alias("up"), "id", "segment", "redirect")
    level = records.where("parent is null").select("subject", "id", F.lit(None).cast("string").alias("parent"), F.lit("/").alias("base"), "segment", "redirect")
    found = []
    while True:  # rows without a way to a root are never reached, so the levels end
        rows = cut_lineage(level.withColumn("full_path", join_path("base", "segment")))
        if rows.isEmpty():
            break
        found.append(rows)
        up = rows.select("subject", F.col("id").alias("up"), F.col("full_path").alias("base"))
        level = kids.join(up, ["subject", "up"]).select("subject", "id", F.col("up").alias("parent"), "base", "segment", "redirect")
    return union_all(found).select(
        "subject", "id", "parent", "full_path", F.when(F.col("redirect").isNotNull(), redirect_path("redirect", "base")).alias("redirect_path"),
        path_params("full_path").alias("params"),
        F.when(F.col("redirect").isNotNull(), "RedirectRoute").when(F.col("segment") == "**", "WildcardRoute").otherwise("ComponentRoute").alias("route_type"))


def component_score() -> Column:
    known = F.coalesce(F.col("comp_id"), F.lit("__unknown__"))
    return (F.when((F.col("route_type") == "ComponentRoute") & (known != "__unknown__") & ~known.startswith("__unresolved__"), 3)
            .when((F.col("route_type") == "ComponentRoute") & (known != "__unknown__"), 2).when(F.col("route_type") == "ComponentRoute", 1)
            .when((F.col("route_type") == "WildcardRoute") & F.col("comp_id").isNotNull(), 3).otherwise(0))


def canonical_routes(candidates: DataFrame) -> DataFrame:
    """One route per full path (X20): the best known component wins, then the smaller id.

    Guards of the losers are added, a redirect of any of them is kept. Candidates of one
    path are reduced by aggregates, never gathered; child ids stay a table.
    """
    rank = F.struct((-component_score()).alias("r"), "id", "page_id")
    best = candidates.groupBy("subject", "full_path").agg(
        F.min_by(F.struct("id", "comp_id", "route_type"), rank).alias("b"), F.min_by("redirect", F.when(F.col("redirect").isNotNull(), rank)).alias("redirect"),
        F.count(F.lit(1)).alias("n_members"))
    guards = (candidates.select("subject", "full_path", F.explode("guards").alias("g")).distinct()
              .groupBy("subject", "full_path").agg(F.array_sort(F.collect_set("g")).alias("guards")))
    children = candidates.select("subject", "full_path", "child").distinct().groupBy("subject", "full_path").agg(F.count("child").alias("n_children"))
    return (best.join(guards, ["subject", "full_path"], "left").join(children, ["subject", "full_path"], "left")
            .select("subject", "full_path", "b.*", "redirect", "n_members", F.coalesce("guards", F.array().cast("array<string>")).alias("guards"), "n_children"))


def inherit_mount_guards(children: DataFrame, mounts: DataFrame) -> DataFrame:
    """Guards of a lazy mount point on every mounted route."""
    m = mounts.select("subject", "mount", F.col("guards").alias("mount_guards"))
    return children.join(m, ["subject", "mount"], "left").withColumn(
        "guards", F.array_sort(F.array_union("guards", F.coalesce("mount_guards", F.array().cast("array<string>"))))).drop("mount_guards")


def component_usage(routes: DataFrame) -> DataFrame:
    """Routes per component (X22); the routes themselves are the rows with that component."""
    return routes.where("route_type = 'ComponentRoute'").groupBy("subject", "comp_id").agg(
        F.count(F.lit(1)).alias("n_routes"), F.min("full_path").alias("first_path"), F.max("full_path").alias("last_path"))


def module_roles(modules: DataFrame, links: DataFrame, declarations: DataFrame, lazy: DataFrame) -> DataFrame:
    """Role of a module (X23): root, shared, lazy, dead, feature, unknown, in that order."""
    imported = links.where("link = 'import'").select("subject", "name").distinct().withColumn("imported", F.lit(True))
    owns = declarations.select("subject", "module_id").distinct().withColumn("declares", F.lit(True))
    late = lazy.select("subject", "module_id").distinct().withColumn("lazy", F.lit(True))
    j = (modules.join(imported, ["subject", "name"], "left").join(owns, ["subject", "module_id"], "left").join(late, ["subject", "module_id"], "left"))
    no = F.lit(False)
    role = (F.when(F.col("name").rlike("(?i)^App(Root)?Module$"), "Root").when(F.col("name").rlike("(?i)^(Shared|Core|Common|Global)Module$"), "GlobalShared")
            .when(F.coalesce("lazy", no), "LazyFeature").when(~F.coalesce("imported", no) & F.coalesce("declares", no), "DeadOrUnreachable")
            .when(F.coalesce("declares", no), "Feature").otherwise("Unknown"))
    return j.select("subject", "module_id", "name", role.alias("role"))


def string_literals(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit("""'[^']*'|"[^"]*\""""), 0), lambda s: F.substring(s, F.lit(2), F.length(s) - 2))


def guard_summary(guards: DataFrame) -> DataFrame:
    """What the body of a guard checks for, by its words."""
    t = F.col("body")
    literals = F.transform(string_literals(t), lambda s: truncate(s, 200))
    none = F.array().cast("array<string>")
    roles = F.when(any_contains(t, fixed.ROLE_WORDS), sorted_unique(F.filter(literals, lambda s: s.rlike("^[A-Za-z][A-Za-z0-9_-]*$")))).otherwise(none)
    flags = F.when(any_contains(t, fixed.FEATURE_WORDS), sorted_unique(F.filter(literals, lambda s: s != ""))).otherwise(none)
    states = sorted_unique(F.array_compact(F.array(*[F.when(F.contains(t, F.lit(w)), F.lit(s)) for w, s in fixed.ENTITY_WORDS.items()])))
    return guards.withColumns({"auth_required": any_contains(t, fixed.AUTH_WORDS), "roles": roles, "flags": flags, "states": states})


def merge_summaries(summaries: DataFrame, key: str) -> DataFrame:
    """Summaries per key: any login check, all names. Distinct names are reduced before they are gathered."""
    def names(col):
        d = summaries.select(key, F.explode(col).alias("n")).distinct()
        return d.groupBy(key).agg(F.array_sort(F.collect_set("n")).alias(col))
    base = summaries.groupBy(key).agg(F.bool_or("auth_required").alias("auth_required"))
    for c in ("roles", "flags", "states"):
        base = base.join(names(c), key, "left")
    return base
