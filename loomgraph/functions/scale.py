"""Helpers that keep a job safe when one key holds a large share of the rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

BLOCK = 1 << 20
PLAN_TEXT = 1 << 16


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors share, as the session names it in `spark.checkpoint.dir`.

    Only a local session without that setting falls back to a temporary folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows as a written table in the shared folder.

    A table is computed once, survives lost executors, keeps column pruning and pushed
    filters for its readers, and tells the planner its size. The driver keeps a description of every plan it has run and
    replanned, which for a plan of thousands of expressions takes megabytes: it is cut short, the plan itself is not.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with session_conf(df.sparkSession, spark__sql__maxPlanStringLength=PLAN_TEXT):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def session_conf(spark: SparkSession, **confs) -> Iterator[None]:
    """Settings (dots as `__`) for what runs inside; those of the session come back afterwards."""
    names = {k.replace("__", "."): str(v) for k, v in confs.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def per_component(df: DataFrame) -> DataFrame:
    """A table of a few rows per component, for a join where the rows of components are (`cut_together`).

    Its share of a partition is held as a hash table, so the wide rows on the other side are not sorted again for its key.
    """
    return df.repartition("k").hint("shuffle_hash")


def cut_together(df: DataFrame) -> DataFrame:
    """`cut_lineage` of joins whose sides were all dealt by the first few of their keys (`repartition`).

    Joins and windows on these and more keys then run where the rows are, so wide rows travel once, not once per join.
    """
    with session_conf(df.sparkSession, spark__sql__requireAllClusterKeysForCoPartition="false"):
        return cut_lineage(df)


def ordinal(df: DataFrame, keys: list[str], seq: str, out: str, ties: list[str] = (), block: int = BLOCK) -> DataFrame:
    """Zero-based rank of a row among the rows of its key, by the integer column `seq`, then `ties`.

    A key is split into blocks of `seq`, ranks run inside a block, and the sizes of the
    earlier blocks are added. No task holds more than one block of one key, so a key with
    most of the rows still spreads over the cluster. Block sizes are pre-aggregated, and
    only keys with several blocks are joined back, on the partitioning the ranks already
    have. Key columns must not be NULL.
    """
    blocked = df.withColumn("__b", F.floor(F.col(seq) / F.lit(block)))
    part = keys + ["__b"]
    sizes = blocked.groupBy(*part).agg(F.count(F.lit(1)).alias("__n"))
    earlier = W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.withColumn("__before", F.sum("__n").over(earlier)).where("__before is not null").drop("__n")
    ranked = blocked.withColumn("__r", F.row_number().over(W.partitionBy(*part).orderBy(seq, *ties)))
    return (ranked.join(before, part, "left")
            .withColumn(out, (F.coalesce("__before", F.lit(0)) + F.col("__r") - 1).cast("long"))
            .drop("__b", "__r", "__before"))


def may_crowd(df: DataFrame, keys: list[str], limit: int = BLOCK) -> bool:
    """Whether a key may have more than `limit` rows.

    Rows are counted per hash bucket of the keys, so a few thousand numbers travel; no key has more rows than its bucket.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(1 << 16))
    most = df.groupBy(bucket.alias("__bucket")).agg(F.count(F.lit(1)).alias("__n")).agg(F.max("__n")).first()[0]
    return (most or 0) > limit


def first_by(df: DataFrame, keys: list[str], order: list[Column | str], cols: list[str]) -> DataFrame:
    """The first row per key. An aggregate, so every map task already reduces its share."""
    rank = F.struct(*order)
    row = F.struct(*cols)
    return df.groupBy(*keys).agg(F.min_by(row, rank).alias("__row")).select(*keys, "__row.*")


def reach(seeds: DataFrame, edges: DataFrame, key: list[str], src: str, dst: str, node: str) -> DataFrame:
    """Rows of `seeds` (key columns, `node`) closed over `edges` (subject, src, dst).

    Semi-naive: only pairs found in the last round are joined again, and known pairs
    are removed by an anti join, so cycles end. The subject is always the first key.
    """
    subject = key[0]
    step = cut_lineage(edges.select(subject, F.col(src).alias(node), F.col(dst).alias("__dst")).distinct())
    frontier = seen = cut_lineage(seeds.select(*key, node).distinct())
    while True:
        found = frontier.join(step, [subject, node]).select(*key, F.col("__dst").alias(node)).distinct()
        frontier = cut_lineage(found.join(seen, key + [node], "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)  # every part is already written, nothing is recomputed


FAN, LEVELS = 4, 8


def cover(first: Column, last: Column) -> Column:
    """The fewest nodes of a tree over bins that make up the bins first..last, as array<struct<level, node>>.

    A node of level k stands for FAN**k bins. A level needs at most 2 (FAN - 1) nodes, the highest one takes the rest.
    """
    low = [F.ceil(first / F.lit(FAN ** k)) for k in range(LEVELS + 1)]
    high = [F.floor((last + 1) / F.lit(FAN ** k)) - 1 for k in range(LEVELS + 1)]
    nodes = lambda k, a, b: F.when(a <= b, F.transform(F.sequence(a, b), lambda x: F.struct(F.lit(k).alias("level"), x.cast("long").alias("node")))).otherwise(
        F.array().cast("array<struct<level:int,node:bigint>>"))
    parts = []
    for k in range(LEVELS):
        inner_low, inner_high = low[k + 1] * FAN, (high[k + 1] + 1) * FAN - 1  # what the next level covers
        whole = low[k + 1] <= high[k + 1]
        parts += [F.when(whole, nodes(k, low[k], inner_low - 1)).otherwise(nodes(k, low[k], high[k])), F.when(whole, nodes(k, inner_high + 1, high[k]))]
        parts[-2:] = [F.when(low[k] <= high[k], p) for p in parts[-2:]]
    parts.append(nodes(LEVELS, low[LEVELS], high[LEVELS]))
    return F.flatten(F.array_compact(F.array(*parts)))


def span_join(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, stop: str, width: int) -> DataFrame:
    """Points inside spans of the same key, both ends included, by integer position.

    Positions are cut into bins of `width` and bins are leaves of a tree. A span is listed under the few nodes that
    make it up, so a long span has a handful of rows and not one per bin; a point is listed under its bin and those
    ancestors whose level any span uses (looked up first: with short spans it is the bin alone). The join stays an
    equi join, and a key with very many rows spreads over its nodes.
    """
    binned = spans.withColumn("__n", F.explode(cover(F.floor(F.col(start) / width), F.floor(F.col(stop) / width))))
    levels = sorted(r[0] for r in binned.select("__n.level").distinct().collect()) or [0]  # LEVELS + 1 numbers at most
    bin_ = F.floor(F.col(at) / width)
    above = F.array(*[F.struct(F.lit(k).alias("level"), F.floor(bin_ / F.lit(FAN ** k)).cast("long").alias("node")) for k in levels])
    placed = points.withColumn("__n", F.explode(above))
    return (placed.join(binned, keys + ["__n"])
            .where((F.col(start) <= F.col(at)) & (F.col(at) <= F.col(stop))).drop("__n"))


def last_before(points: DataFrame, events: DataFrame, keys: list[str], at: str, when: str, cols: list[str], out: str, width: int) -> DataFrame:
    """Points with the struct `out` of `cols` of their key's last event at or before them, NULL if there is none (an as-of join).

    `at` and `when` are integer positions; events of one position are ordered by `cols`. Positions are cut into
    bins of `width`: a window holds one bin of one key, and a point without an event in its bin takes what the
    last bin before it ended with. Those ends are one row per key and bin, so long keys stay spread.
    """
    place = lambda c: F.floor(F.col(c) / F.lit(width))
    value = F.struct(*cols)
    e = events.select(*keys, place(when).alias("__bin"), F.col(when).cast("long").alias("__at"), value.alias("__value"))
    p = points.select(*keys, place(at).alias("__bin"), F.col(at).cast("long").alias("__at"), F.struct(*points.columns).alias("__point"))
    seen = F.last("__value", ignorenulls=True).over(W.partitionBy(*keys, "__bin").orderBy("__at", F.col("__point").isNotNull(), "__value").rowsBetween(W.unboundedPreceding, 0))
    placed = e.unionByName(p, allowMissingColumns=True).withColumn("__seen", seen).where("__point is not null")
    ends = e.groupBy(*keys, "__bin").agg(F.max(F.struct("__at", "__value")).alias("__end"))
    bins = ends.unionByName(p.select(*keys, "__bin").distinct(), allowMissingColumns=True).groupBy(*keys, "__bin").agg(F.max("__end").alias("__end"))
    carried = F.last("__end", ignorenulls=True).over(W.partitionBy(*keys).orderBy("__bin").rowsBetween(W.unboundedPreceding, -1))
    before = bins.select(*keys, "__bin", carried.alias("__carried")).where("__carried is not null")
    return (placed.join(before, [*keys, "__bin"], "left")
            .select("__point.*", F.coalesce("__seen", F.col("__carried")["__value"]).alias(out)))


class Pages:
    """Rows written once in one order, dealt by range, with an index of how many rows stand before each range.

    Any page costs the same: the index (one row per range) names the ranges it lies in, and only their files are read.
    """

    def __init__(self, df: DataFrame, order: list[Column]):
        self.spark = df.sparkSession
        self.folder = f"{shared_folder(self.spark)}/pages-{uuid.uuid4().hex}"
        self.schema = T.StructType([*df.schema.fields, T.StructField("__at", T.LongType()), T.StructField("__range", T.LongType())])
        at = F.monotonically_increasing_id()
        (df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", at)
         .withColumns({"__range": F.shiftright("__at", 33), "__at": F.col("__at").bitwiseAND((1 << 33) - 1)})
         .write.partitionBy("__range").parquet(f"{self.folder}/rows"))
        before = F.sum("n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1))
        self.index = cut_lineage(self.rows().groupBy("__range").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(before, F.lit(0))))

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/rows")

    def page(self, number: int, size: int) -> DataFrame:
        """Rows number * size and following, with their place in `__place`."""
        start, stop = number * size, (number + 1) * size
        hit = self.index.where((F.col("before") < stop) & (F.col("before") + F.col("n") > start)).collect()
        place = F.coalesce(*[F.when(F.col("__range") == r["__range"], F.lit(r.before)) for r in hit], F.lit(None).cast("long")) + F.col("__at")
        rows = self.rows().where(F.col("__range").isin([r["__range"] for r in hit]) if hit else F.lit(False))
        return rows.withColumn("__place", place).where((F.col("__place") >= start) & (F.col("__place") < stop)).drop("__range", "__at")
