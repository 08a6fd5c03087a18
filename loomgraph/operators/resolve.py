"""From navigation text to route (G15, G16): exact, relative, array and interpolated forms.

Matching a text against route templates needs no comparison of all pairs: a template is
keyed by its static parts with `:` at its parameter places, a text takes the same key for
every mask of parameter places used in its application, and the match is an equi join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomgraph.functions.scalar import let, segments, strip_quotes

HOLE = "\u0001"  # stands for a dynamic part, equal to no static part


def _array_parts(text: Column) -> Column:
    inner = F.regexp_replace(text, r"^\[|\]$", "")
    return F.filter(F.transform(F.split(inner, ","), lambda p: F.trim(p)), lambda p: p != "")


def array_segments(text: Column) -> Column:
    """Parts of `['/users', id]`: static parts as they are, dynamic ones as HOLE."""
    def spread(p):
        return let(strip_quotes(p), lambda s: F.when(s.isin("", "/"), F.array().cast("array<string>"))
                   .when(p.rlike("""^['"]"""), segments(s)).otherwise(F.array(F.lit(HOLE))))
    return F.when(text.startswith("["), F.flatten(F.transform(_array_parts(text), spread)))


def interpolated_segments(text: Column) -> Column:
    def parts(clean):
        named = F.transform(segments(F.regexp_replace(clean, r"[?#].*$", "")),
                            lambda s: F.when(s.contains("{{"), HOLE).otherwise(s))
        return F.when(clean.startswith("/") & clean.contains("{{"), named)
    return let(F.trim(strip_quotes(text)), parts)


def normalised_link(text: Column) -> Column:
    """Absolute path of a literal link; NULL for dynamic arrays and dotted relative paths."""
    def of_array(raw):
        static = F.forall(raw, lambda p: p.rlike("""^['"]"""))
        joined = F.array_join(F.filter(F.transform(raw, lambda p: strip_quotes(p)), lambda p: p != ""), "/")
        return F.when(static, F.concat(F.lit("/"), F.regexp_replace(joined, "^/", "")))

    def of_text(plain):
        return (F.when(plain.startswith("/"), plain)
                .when(~plain.startswith("./") & ~plain.startswith("../"), F.concat(F.lit("/"), plain)))
    return F.when(text.startswith("["), let(_array_parts(text), of_array)).otherwise(let(strip_quotes(text), of_text))


def relative_part(text: Column) -> Column:
    """The part to hang below an activating route; NULL when the text is not relative."""
    def head(plain):
        first = F.trim(F.split(F.regexp_replace(plain, r"^\[|\]$", ""), ",")[0])
        return F.when(plain.startswith("["), strip_quotes(first)).otherwise(plain)

    def below(h):
        bad = h.startswith("/") | (h == "") | h.contains("{{")
        return F.when(~bad, let(F.when(h.startswith("./"), F.substr(h, F.lit(3))).otherwise(h),
                                lambda t: F.when(~t.startswith("../"), t)))
    return let(let(F.trim(strip_quotes(text)), head), below)


def is_external(url) -> Column:
    return (F.col(url) if isinstance(url, str) else url).rlike("^(https?:)?//")


def _templates(routes: DataFrame) -> DataFrame:
    segs = segments("full_path")
    return routes.select(
        "subject", "route_id", "full_path", F.size(segs).alias("n_segs"),
        F.array_join(F.transform(segs, lambda s: F.when(s.startswith(":"), "1").otherwise("0")), "").alias("mask"),
        F.array_join(F.transform(segs, lambda s: F.when(s.startswith(":"), ":").otherwise(s)), "/").alias("key"),
        F.size(F.filter(segs, lambda s: s.startswith(":"))).alias("n_params"))


def match_templates(texts: DataFrame, segs: str, routes: DataFrame) -> DataFrame:
    """Rows of `texts` with every route template their segments fit."""
    templates = _templates(routes)
    masks = templates.select("subject", "n_segs", "mask").distinct()
    keyed = (texts.where(F.size(segs) > 0).withColumn("n_segs", F.size(segs)).join(masks, ["subject", "n_segs"])
             .withColumn("key", F.array_join(F.zip_with(
                 F.col(segs), F.split("mask", ""), lambda s, m: F.when(m == "1", ":").otherwise(s)), "/")))
    return keyed.join(templates, ["subject", "n_segs", "mask", "key"])


def _candidates_exact(texts, routes, stage):
    paths = routes.select("subject", F.col("full_path").alias("exact"), "route_id", "full_path")
    return texts.where("exact is not null").join(paths, ["subject", "exact"]).select(
        *texts.columns, F.lit(stage).alias("stage"), F.lit(0).alias("rank"), "full_path", "route_id")


def _candidates_matched(texts, segs, routes, stage, rank="n_params"):
    usable = routes.where((F.col("full_path") != "/") & ~F.col("full_path").endswith("/**"))
    return match_templates(texts, segs, usable).select(
        *texts.columns, F.lit(stage).alias("stage"), F.col(rank).alias("rank"), "full_path", "route_id")


def _best(candidates: DataFrame, keys: list[str]) -> DataFrame:
    return candidates.groupBy(*keys).agg(
        F.min_by(F.struct("route_id", "stage"), F.struct("stage", "rank", "full_path")).alias("best")
    ).select(*keys, F.col("best.route_id").alias("target_route_id"), F.col("best.stage").alias("stage"))


def resolve_links(links: DataFrame, routes: DataFrame) -> DataFrame:
    """Target route of every distinct (subject, comp_id, value).

    Stage 1 exact path, 2 relative to an activating route, 3 array with dynamic parts,
    4 interpolated path. The lowest stage wins; inside a stage the ties are fewest
    segments (2) or fewest parameters (3, 4), then the smaller path.
    """
    keys = ["subject", "comp_id", "value"]
    return resolve_texts(links.select(*keys).distinct(), routes, keys)


def resolve_texts(texts: DataFrame, routes: DataFrame, keys: list[str]) -> DataFrame:
    """The same for texts that are distinct by `keys`: subject, comp_id, value and what these decide."""
    v = F.col("value")
    texts = texts.select(*keys).withColumns({
        "exact": normalised_link(v), "arr": array_segments(v), "inter": interpolated_segments(v), "rel": relative_part(v)})
    activating = routes.where("route_type in ('ComponentRoute', 'WildcardRoute')").select(
        "subject", "comp_id", F.col("full_path").alias("base"))
    below = (texts.where("rel is not null").join(activating, ["subject", "comp_id"])
             .withColumn("exact", F.when(F.col("base") == "/", F.concat(F.lit("/"), "rel"))
                         .otherwise(F.concat_ws("/", "base", "rel")))
             .withColumn("concrete", segments("exact")))
    direct = _candidates_exact(below, routes, 2)
    fitted = below.join(routes.select("subject", F.col("full_path").alias("exact")), ["subject", "exact"], "left_anti")
    fitted = match_templates(fitted, "concrete", routes).select(
        *keys, F.lit(2).alias("stage"), F.size(F.split("full_path", "/")).alias("rank"), "full_path", "route_id")
    direct = direct.withColumn("rank", F.size(F.split("full_path", "/")))
    cols = [*keys, "stage", "rank", "full_path", "route_id"]
    found = (_candidates_exact(texts, routes, 1).select(*cols)
             .unionByName(direct.select(*cols)).unionByName(fitted.select(*cols))
             .unionByName(_candidates_matched(texts, "arr", routes, 3).select(*cols))
             .unionByName(_candidates_matched(texts, "inter", routes, 4).select(*cols)))
    return _best(found, keys)


def resolve_programmatic(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """Target route of every distinct (subject, value) handed to a router call."""
    keys = ["subject", "value"]
    v = F.col("value")
    clean = F.trim(F.regexp_replace(v, r"""^['"\[]|['"]\]?$""", ""))
    texts = calls.select(*keys).distinct().withColumns({
        "clean": clean, "arr": array_segments(v), "inter": interpolated_segments(v)})
    cols = [*keys, "stage", "rank", "full_path", "route_id"]
    found = (_candidates_exact(texts.withColumn("exact", F.col("clean")), routes, 1).select(*cols)
             .unionByName(_candidates_exact(texts.withColumn("exact", F.concat(F.lit("/"), "clean")), routes, 2).select(*cols))
             .unionByName(_candidates_matched(texts, "arr", routes, 3).select(*cols))
             .unionByName(_candidates_matched(texts, "inter", routes, 4).select(*cols)))
    return _best(found, keys)
