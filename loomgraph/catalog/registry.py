"""Named queries with their check SQL.

A query names its output columns with a kind: `s` text, `i` whole number, `d` decimal.
The same casts are put around the Spark result and the check SQL, so both sides have
the same schema; missing text is '' and a missing number is -1.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomgraph.catalog.oracle_views import VIEWS
from loomgraph.sources.views import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

SPARK_CAST = {
    "s": lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")),
    "i": lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(-1).cast("bigint")),
    "d": lambda c: F.coalesce(F.col(c).cast("double"), F.lit(-1.0)),
}
SQL_CAST = {
    "s": "coalesce(cast({0} as varchar), '') as {0}",
    "i": "coalesce(cast({0} as bigint), -1) as {0}",
    "d": "coalesce(cast({0} as double), -1.0) as {0}",
}


READ_OFTEN = ("v_edge", "v_atom", "v_rentry", "v_rcand")


def needed_views(sql: str) -> list[str]:
    """Views a statement uses, directly or through other views, in definition order."""
    used: set[str] = set()
    todo = [sql]
    while todo:
        for name in set(re.findall(r"\bv_\w+", todo.pop())) & VIEWS.keys():
            if name not in used:
                used.add(name)
                todo.append(VIEWS[name])
    return [v for v in VIEWS if v in used]


def compose(sql: str, cols: list[list[str]]) -> str:
    casts = ", ".join(SQL_CAST[k].format(c) for c, k in cols)
    views = [f"{v} as {'materialized ' if v in READ_OFTEN else ''}({VIEWS[v]})" for v in needed_views(sql)]
    return f"with recursive {', '.join(views + [f'answer as ({sql})'])} select {casts} from answer"


def query(name: str, columns: str, sql: str | None = None):
    cols = [c.split(":") for c in columns.split()]

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(spark, folder)).select(*[SPARK_CAST[k](c).alias(c) for c, k in cols])
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = compose(sql, cols)
        return fn
    return register
