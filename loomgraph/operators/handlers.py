"""Event names, handler names and the calls inside handler bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loomgraph.functions import fixed
from loomgraph.functions.scalar import lookup


def event_type(raw) -> Column:
    """User event of a raw event name; unknown names map to 'unknown'."""
    return lookup(F.lower(F.regexp_replace(F.col(raw) if isinstance(raw, str) else raw, "[()]", "")),
                  fixed.EVENT_TYPES, F.lit("unknown"))


def handler_name(expr) -> Column:
    """Bare method name of a handler expression, NULL when there is none."""
    c = F.trim(F.col(expr) if isinstance(expr, str) else expr)
    name = F.regexp_extract(c, r"^(?:this\.)?([A-Za-z_$][A-Za-z0-9_$]*)\s*\(", 1)
    return F.when(name != "", name)


def user_events(bindings: DataFrame) -> DataFrame:
    """Event bindings a user can cause: framework events and navigation bindings are dropped."""
    low = F.lower("name")
    return bindings.where(~low.isin("routerlink", "href")
                          & ~((F.col("binding") == "event") & low.isin(fixed.INTERNAL_EVENTS)))


def _shape(expr: Column, arg: Column) -> Column:
    service = F.regexp_extract(expr, r"^this\.([A-Za-z_$][A-Za-z0-9_$]*)\.([A-Za-z_$][A-Za-z0-9_$]*)$", 1)
    return (F.when(expr.endswith(".navigate") | expr.endswith(".navigateByUrl"), "Navigate")
            .when(expr.startswith("window.location") | expr.startswith("window.open"), "NavigateExternal")
            .when(expr.rlike(r"^(this\.)?[A-Za-z_$][A-Za-z0-9_$]*\.open$") & arg.rlike(r"^[A-Z][A-Za-z0-9_$]*$"), "DialogOpen")
            .when(expr.rlike(r"^(this\.)?[A-Za-z_$][A-Za-z0-9_$]*\.open$") & arg.rlike(r"^[a-z][A-Za-z0-9_$]*$"), "DialogTemplate")
            .when(service != "", "ServiceCall")
            .when(expr.rlike(r"^this\.[A-Za-z_$][A-Za-z0-9_$]*$"), "SameClass"))


HANDLER = ["subject", "comp_id", "handler"]


def diagnostic_handlers(calls: DataFrame, dealt: tuple[str, ...] = ()) -> DataFrame:
    """Handlers that only write to the console. `dealt` are columns the component decides, by which calls are dealt."""
    return (calls.groupBy(*dealt, *HANDLER).agg(F.bool_and(F.col("expr").startswith("console.")).alias("d"))
            .where("d").drop("d"))


def call_contexts(calls: DataFrame, first: int | None = None, dealt: tuple[str, ...] = ()) -> DataFrame:
    """Classified calls of every handler, in order; with `first`, only so many of each.

    A call of a method of the same class is replaced by that method's own calls, one
    level deep and once per method; it is a self join on (class, method). With `dealt`
    (see `diagnostic_handlers`) rows that were dealt by these columns stay where they are.
    """
    place = [*dealt, *HANDLER]
    calls = calls.join(diagnostic_handlers(calls, dealt), place, "left_anti")
    shaped = calls.withColumn("shape", _shape(F.col("expr"), F.col("arg")))
    direct = shaped.where("shape <> 'SameClass'").withColumn("sub", F.lit(-1).cast("long"))
    hops = (shaped.where("shape = 'SameClass'")
            .withColumn("callee", F.substr(F.col("expr"), F.lit(6))).where("callee <> handler")
            .groupBy(*place, "callee").agg(F.min("seq").alias("seq")))
    inner = direct.select(*dealt, "subject", "comp_id", F.col("handler").alias("callee"), "shape", "expr", "arg", "file",
                          F.col("seq").alias("sub"))
    followed = hops.join(inner, [*dealt, "subject", "comp_id", "callee"])
    cols = [*place, "seq", "sub", "shape", "expr", "arg", "file"]
    rows = direct.select(*cols).unionByName(followed.select(*cols))
    order = W.partitionBy(*place).orderBy("seq", "sub", "expr", "arg")
    ranked = rows.withColumn("__n", F.row_number().over(order))
    if first is not None:
        ranked = ranked.where(F.col("__n") <= first)  # on the raw rank, so that the group limit runs before the shuffle
    kept = ranked.withColumn("ord", F.col("__n").cast("long") - 1)
    member = F.regexp_extract("expr", r"^this\.([A-Za-z_$][A-Za-z0-9_$]*)\.", 1)
    nth = F.row_number().over(W.partitionBy(*place, "shape").orderBy("ord")).cast("long") - 1
    return kept.select(
        *HANDLER, (F.col("seq") * (1 << 20) + F.col("ord")).alias("place"), "ord", "file", "shape", "arg",
        F.when(F.col("shape") == "ServiceCall", member).otherwise(F.col("arg")).alias("target"),
        F.when(F.col("shape") == "ServiceCall", nth).alias("call_ordinal"))
