"""Sharding by extendible hashing.

Rows fall into buckets by the leading bits of a hash of their key. A bucket over the byte limit splits on its next
bit, all others stay, until every shard fits. The outcome does not depend on the order of insertion: a shard is
the shortest prefix whose rows fit, so the directory comes from sizes pre-aggregated per prefix, a level of LEVEL
bits at a time; only prefixes still too large go one level deeper. Rows meet the directory in an equi join on
their prefix.

Bits run out only for rows of one key whose bytes exceed the limit. They go to overflow pages: a page takes rows of
the key in their written order up to the limit, within each written part, so no task holds more of a hot key than
one part. A single row over the limit is a shard of its own. NULL keys are one key, ''; NULL texts have no bytes;
an empty table gives no shards. Columns of the table keep their names; where one of the added names is among them,
`assigned` refuses, while `write_shards` keeps rows in a struct and takes any names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from loomgraph.functions.scale import cut_lineage, shared_folder

LIMIT_BYTES = 16 << 20
KEY_BITS = 60
SLACK_BITS = 4
LEVEL = 8
MAX_BROADCAST_SLOTS = 1 << 20


def key_hash(key: list[str]) -> Column:
    """60 bits of the key's digest."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def prefix(h: Column, depth: int) -> Column:
    return F.shiftright(h, KEY_BITS - depth)


def directory_level(sizes: DataFrame, low: int, depth: int, limit: int) -> DataFrame:
    """(slot, depth, shard_bytes, shard_rows) for prefixes of `depth` bits; depth is NULL where all are too large.

    `sizes` has (slot, bytes, rows); ancestors with `low` bits or fewer are known to be too large.
    """
    ancestors = sizes.select("slot", "bytes", "rows", F.explode(F.sequence(F.lit(low + 1 if low else 0), F.lit(depth))).alias("d"))
    sums = ancestors.withColumn("p", F.expr(f"shiftright(slot, {depth} - d)")).groupBy("d", "p").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    fits = sums.where(F.col("bytes") <= limit)
    own = sizes.select("slot", F.explode(F.sequence(F.lit(low + 1 if low else 0), F.lit(depth))).alias("d")).withColumn("p", F.expr(f"shiftright(slot, {depth} - d)"))
    leaf = own.join(fits, ["d", "p"]).groupBy("slot").agg(F.min_by(F.struct("d", "bytes", "rows"), "d").alias("l"))
    return sizes.select("slot").join(leaf, "slot", "left").select("slot", F.col("l.d").alias("depth"), F.col("l.bytes").alias("shard_bytes"), F.col("l.rows").alias("shard_rows"))


def assigned(df: DataFrame, key: list[str], size: Column, limit: int = LIMIT_BYTES) -> DataFrame:
    """The rows with n_bytes, shard (its bits, and a page where bits ran out), depth, shard_bytes and shard_rows."""
    own = df.columns
    if taken := {"n_bytes", "shard", "depth", "shard_bytes", "shard_rows", "__h"} & {c.lower() for c in own}:
        raise ValueError(f"columns {sorted(taken)} are added by sharding: put the row into a struct, as write_shards does")
    rows = df.withColumns({"n_bytes": F.coalesce(size, F.lit(0)).cast("long"), "__h": key_hash(key)})
    small = F.col("n_bytes") <= limit
    total = rows.where(small).agg(F.sum("n_bytes")).first()[0] or 0
    depth, low = min(KEY_BITS, max(0, -(-total // limit) - 1).bit_length() + SLACK_BITS), 0
    placed = rows.withColumns({c: F.lit(None).cast("long") for c in ("depth", "shard_bytes", "shard_rows")})
    open_ = rows.where(small).select("__h", "n_bytes")
    while True:
        sizes = open_.groupBy(prefix(F.col("__h"), depth).alias("slot")).agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        level = cut_lineage(directory_level(sizes, low, depth, limit))
        found, left = level.where("depth is not null"), level.where("depth is null").select("slot")
        n_found, n_left = found.count(), left.count()
        if n_found:
            here = found.select(F.col("slot").alias("__slot"), *[F.col(c).alias(f"__{c}") for c in ("depth", "shard_bytes", "shard_rows")])
            placed = placed.withColumn("__slot", F.when(small & F.col("depth").isNull(), prefix(F.col("__h"), depth)))
            placed = placed.join(F.broadcast(here) if n_found <= MAX_BROADCAST_SLOTS else here, "__slot", "left")
            placed = placed.withColumns({c: F.coalesce(c, F.col(f"__{c}").cast("long")) for c in ("depth", "shard_bytes", "shard_rows")})
            placed = placed.select(*own, "n_bytes", "__h", "depth", "shard_bytes", "shard_rows")
        if not n_left or depth == KEY_BITS:
            break
        open_ = open_.join(left.withColumnRenamed("slot", "__slot"), prefix(F.col("__h"), depth) == F.col("__slot"), "left_semi")
        low, depth = depth, min(KEY_BITS, depth + LEVEL)
    bits = F.substring(F.lpad(F.bin("__h"), KEY_BITS, "0"), F.lit(1), F.col("depth").cast("int"))
    inside = placed.where("depth is not null").withColumn("shard", bits)
    columns = [*own, "n_bytes", "shard", "depth", "shard_bytes", "shard_rows"]
    over = rows.where(~small)
    if n_left:
        over = over.unionByName(placed.where(small & F.col("depth").isNull()).select(*own, "n_bytes", "__h"))
    elif over.isEmpty():
        return inside.select(*columns)
    return inside.select(*columns).unionByName(pages(over, own, limit).select(*columns))


def pages(over: DataFrame, own: list[str], limit: int) -> DataFrame:
    """Rows that no prefix can hold: pages of rows of one key, and rows that are too large by themselves.

    A page starts where the running size passes a multiple of half the limit, and rows above half the limit have
    pages of their own, so a page never exceeds the limit unless it is one row.
    """
    numbered = cut_lineage(over.withColumn("__m", F.monotonically_increasing_id()))
    alone = F.col("n_bytes") * 2 > limit
    dealt = numbered.withColumns({"__alone": alone, "__part": F.shiftright("__m", 33)})
    # Running size of small rows inside each written part of a key: a part is one former task, of bounded size.
    window = W.partitionBy("__h", "__alone", "__part").orderBy("__m")
    run = dealt.withColumn("__page", F.when(alone, F.row_number().over(window)).otherwise(
        F.floor((F.sum("n_bytes").over(window) - F.col("n_bytes")) / F.lit(max(limit // 2, 1)))).cast("long"))
    label = F.concat(F.lpad(F.bin("__h"), KEY_BITS, "0"), F.when(alone, "+").otherwise("."), F.col("__part"), F.lit("."), F.col("__page"))
    named = run.withColumn("shard", label).drop("__m")
    sizes = named.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"), F.count(F.lit(1)).alias("shard_rows"))
    return named.withColumn("depth", F.lit(KEY_BITS).cast("long")).join(sizes, "shard")


def write_shards(df: DataFrame, path: str, key: list[str], size: Column, limit: int = LIMIT_BYTES) -> None:
    """Whole rows into one folder per shard under `path`, in one shuffle.

    A row stands in the struct `row`, beside n_bytes and depth, so its column names are free. A folder is named by
    the letter s and the shard's bits, so no reader takes the bits for a number; a task writes whole shards.
    """
    keys = [f"__key{k}" for k in range(len(key))]
    rows = df.select(F.struct(*df.columns).alias("row"), size.alias("__size"), *[F.col(c).alias(k) for c, k in zip(key, keys)])
    placed = assigned(rows, keys, F.col("__size"), limit)
    (placed.select("row", "n_bytes", F.col("depth").cast("long").alias("depth"), F.concat(F.lit("s"), "shard").alias("folder"))
     .repartition("folder").write.partitionBy("folder").parquet(path))


def read_shards(spark: SparkSession, path: str, row: T.StructType) -> DataFrame:
    """What `write_shards` wrote of rows of this type: row, n_bytes, depth, shard."""
    schema = T.StructType([T.StructField("row", row), T.StructField("n_bytes", T.LongType()), T.StructField("depth", T.LongType()), T.StructField("folder", T.StringType())])
    return spark.read.schema(schema).parquet(path).select("row", "n_bytes", "depth", F.expr("substr(folder, 2)").alias("shard"))


def report(docs: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """Shards of whole documents, written and read back: sizes and rows of a shard are those of what was written."""
    path = f"{shared_folder(docs.sparkSession)}/shards-{uuid.uuid4().hex}"
    write_shards(docs, path, ["doc_id"], F.octet_length("text"), limit)
    held = read_shards(docs.sparkSession, path, docs.schema).select("row.doc_id", F.coalesce(F.octet_length("row.text"), F.lit(0)).cast("long").alias("n_bytes"), "shard", "depth")
    sizes = held.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"), F.count(F.lit(1)).alias("shard_rows"))
    return held.join(sizes, "shard").select("doc_id", "n_bytes", "shard", "depth", "shard_bytes", "shard_rows")
