"""Small helpers of the corpus operators."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, col: str = "text") -> DataFrame:
    """(doc_id, text) alone, so other columns and their names never matter; NULL text is ''."""
    return docs.select("doc_id", F.coalesce(F.col(col), F.lit("")).alias("text"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over a value that is computed once per row.

    Catalyst may inline a projected expression into the lambda of a higher-order function,
    where it would run again for every element. A lambda variable is bound, never inlined.
    """
    return F.transform(F.array(value), body)[0]


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Inclusive prefix sums or maxima of a long array of numbers >= 0, in blocks so that long arrays stay cheap."""
    block = 128
    empty, zero = F.array().cast("array<bigint>"), F.lit(0).cast("long")

    def inside(a: Column) -> Column:
        return F.aggregate(a, empty, lambda acc, x: F.concat(acc, F.array(combine(F.coalesce(F.get(acc, F.size(acc) - 1), zero), x))))

    def blocked(a: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / block).cast("int"))
        parts = F.transform(starts, lambda b: F.slice(a, b * block + 1, F.lit(block)))

        def shifted(ps: Column) -> Column:
            ends = inside(F.transform(ps, lambda p: F.aggregate(p, zero, combine)))
            return let(ends, lambda es: F.flatten(F.transform(
                ps, lambda p, k: let(F.coalesce(F.get(es, k - 1), zero), lambda before: F.transform(inside(p), lambda x: combine(before, x))))))

        return let(parts, shifted)

    return F.when(F.size(values) == 0, empty).otherwise(let(values, blocked))


def spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, stop, hit>>, in code points, end exclusive.

    Spark gives matches without places: the pieces between them, from `split`, add up to the places.
    """
    def placed(t: Column, hits: Column) -> Column:
        gaps = F.split(t, pattern, -1)

        def with_gaps(gs: Column) -> Column:
            steps = F.transform(hits, lambda h, i: (F.length(F.get(gs, i)) + F.length(h)).cast("long"))
            return let(running(steps, lambda a, b: a + b), lambda ends: F.transform(hits, lambda h, i: F.struct(
                (F.get(ends, i) - F.length(h)).alias("start"), F.get(ends, i).alias("stop"), h.alias("hit"))))

        return let(gaps, with_gaps)

    none = F.array().cast("array<struct<start:bigint,stop:bigint,hit:string>>")
    return let(text, lambda t: let(
        F.regexp_extract_all(t, F.lit(pattern), F.lit(0)),
        lambda hits: F.when(F.size(hits) == 0, none).otherwise(placed(t, hits))))


def labelled(kind: str, found: Column) -> Column:
    """Spans as text kind:start:end."""
    return F.transform(found, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["stop"].cast("string")))


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def with_package(df: DataFrame) -> DataFrame:
    """The rows, after Python workers were told where this package is.

    Workers started by a session whose own search path was set at run time would not find it. On a
    cluster the package is installed or sent with `--py-files`; a path that does not exist there is harmless.
    """
    environment = df.sparkSession.sparkContext.environment
    root = str(Path(__file__).resolve().parents[2])
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
    return df
