"""Structured Streaming jobs over pipeline events and test attempts (K1-K8).

A job takes a streaming frame and gives a streaming frame; `run` writes it with a
checkpoint in the shared folder. A run that is given the folder of an earlier one goes
on where that one stopped: files it has read are not read again, state is taken up, and
a batch that was cut off overwrites itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from loomgraph.functions.scalar import ratio
from loomgraph.functions.scale import cut_lineage, shared_folder

LATENESS = "10 minutes"
LATENESS_MS = 10 * 60 * 1000
# A test is one user on one day: what repeats its keys, or belongs to its fold, comes within that time.
TEST_SPAN = "1 day"
TEST_SPAN_MS = 24 * 3600 * 1000
ATTEMPTS = 3
ENDS = ("PASS", "FAIL_APP_NOT_READY")
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def slice_edges(rows: DataFrame, at: str, slices: int) -> list[int]:
    """Ends, in whole microseconds, of equal slices of the time that rows span; the first entry is before all rows."""
    low, high = rows.agg(F.min(F.unix_micros(at)), F.max(F.unix_micros(at))).first()
    return [] if low is None else [low - 1, *[low + (high - low) * k // slices for k in range(1, slices + 1)]]


def deliver(rows: DataFrame, at: str, folder: str, after: int, upto: int, files: int = 1) -> None:
    """Append rows of the times (after, upto] to a folder of JSON lines, as a logger does that flushes now and then."""
    part = rows.where(f"unix_micros({at}) > {after} and unix_micros({at}) <= {upto}")
    part.coalesce(files).write.mode("append").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(folder)


def json_event_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    """Append-only JSON lines as a stream, a bounded number of files per batch, older files first (K1)."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
            .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(folder))


def replayed(rows: DataFrame, at: str, slices: int) -> DataFrame:
    """Rows of a table as a stream that brings them slice by slice in order of time."""
    spark, folder = rows.sparkSession, new_folder(rows.sparkSession)
    edges = slice_edges(rows, at, slices)
    for after, upto in zip(edges, edges[1:]):
        deliver(rows, at, folder, after, upto)
    if not edges:
        rows.write.json(folder)
    return json_event_stream(spark, folder, rows.schema)


@dataclass(frozen=True)
class Fold:
    """A stream, and what a batch of it changes beside a state table: `change(rows, number, base)` gives the changed rows."""

    stream: DataFrame
    columns: list[str]
    schema: T.StructType
    change: Callable[[DataFrame, int, str], DataFrame]

    @property
    def sparkSession(self) -> SparkSession:
        return self.stream.sparkSession


def run(df: DataFrame | Fold, mode: str = "append", keys: list[str] | None = None, base: str | None = None,
        shrink: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> DataFrame:
    """Process what is there, write it to a table in the shared folder and read it back.

    In update mode every batch is written under its number, after `shrink`, and of the rows of a
    key the one from the last batch counts. State is held by RocksDB: on disk, not in the heap.
    """
    spark = df.sparkSession
    base = base or new_folder(spark)
    folds = isinstance(df, Fold)
    writer = (df.stream if folds else df).writeStream.outputMode("append" if folds else mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, ROCKS)
    try:
        if mode == "append":
            query = writer.format("parquet").option("path", f"{base}/table").start()
        else:
            def keep(batch: DataFrame, number: int) -> None:
                # the batch number in the path makes a repeated batch overwrite itself
                shrink(df.change(batch, number, base) if folds else batch).write.mode("overwrite").parquet(f"{base}/table/batch={number}")
            query = writer.foreachBatch(keep).start()
        query.awaitTermination()
    finally:
        spark.conf.set(provider, before)
    schema = df.schema if mode == "append" else T.StructType(df.schema.fields + [T.StructField("batch", T.LongType())])
    out = spark.read.schema(schema).parquet(f"{base}/table")
    if keys:
        cols = [c for c in df.columns if c not in keys]
        out = out.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch").alias("r")).select(*keys, "r.*")
    return out


def windowed_counts(events: DataFrame, by: list[str], width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events per value of some columns (phase, severity, outcome) in tumbling or sliding windows (K2)."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return (events.withWatermark("ts", LATENESS).groupBy(w.alias("w"), *by)
            .agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n"))


def run_sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Runs of a subject: bursts of events with no longer gap (K3)."""
    return (events.withWatermark("ts", LATENESS).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
            .agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n"))


def completed_once(attempts: DataFrame, horizon: str = TEST_SPAN) -> DataFrame:
    """Each completion once, however often it is delivered within the horizon, in one batch or in several (K4)."""
    return attempts.withWatermark("ts", horizon).dropDuplicatesWithinWatermark(["test_id", "run_id"])


SLOT = ["at", "event_id", "outcome", "duration_ms"]
SLOTS = T.ArrayType(T.StructType().add("at", "long").add("event_id", "long").add("outcome", "string").add("duration_ms", "long"))
RESULT = T.StructType().add("test_id", "string").add("attempts", "long").add("duration_ms", "long").add("outcome", "string").add("was", "string")
STATE = T.StructType().add("test_id", "string").add("slots", SLOTS).add("until", "long").add("attempts", "long").add("duration_ms", "long").add("outcome", "string")
CLOCK = T.StructType().add("latest", "long")


def fold_batch(rows: DataFrame, number: int, base: str, spark: SparkSession) -> DataFrame:
    """Results that a batch of attempts changes, from and to a state of one row per test.

    A row holds the first ATTEMPTS attempts, whatever arrives, and the result shown last. It leaves TEST_SPAN after the last
    attempt kept, on the clock of the stream: the latest time of the batches before, less LATENESS. Batches write in two
    folders by turns, so one that is repeated finds the state before it.
    """
    def written(df: DataFrame, what: str) -> DataFrame:
        path = f"{base}/{what}/{number % 2}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def before(what: str, schema: T.StructType) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{base}/{what}/{(number - 1) % 2}") if number else spark.createDataFrame([], schema)

    came = written(rows.select("test_id", "ts", *SLOT), "came")
    clock = before("clock", CLOCK)
    watermark = clock.select(F.max("latest")).first()[0]
    watermark = 0 if watermark is None else watermark - LATENESS_MS
    written(came.select(F.unix_millis("ts").alias("latest")).unionByName(clock).agg(F.max("latest").alias("latest")), "clock")
    place = F.row_number().over(W.partitionBy("test_id").orderBy(*SLOT))
    new = (came.select("test_id", *SLOT).withColumn("place", place).where(F.col("place") <= ATTEMPTS)
           .groupBy("test_id").agg(F.collect_list(F.struct(*SLOT)).alias("new")))
    old = before("state", STATE).select("test_id", F.col("slots").alias("old"), "until", F.struct("outcome", "attempts", "duration_ms").alias("shown"))
    nothing = F.array().cast(SLOTS)
    slots = F.slice(F.array_sort(F.array_distinct(F.concat(F.coalesce("old", nothing), F.coalesce("new", nothing)))), 1, ATTEMPTS)
    end = F.array_position(F.transform("slots", lambda x: x["outcome"].isin(*ENDS)), F.lit(True))
    used = F.slice("slots", 1, F.when(end > 0, end).otherwise(F.size("slots")).cast("int"))
    kept = (old.join(new, "test_id", "full_outer").where(F.col("new").isNotNull() | (F.col("until") >= watermark))
            .withColumn("slots", slots).withColumn("used", used)
            .select("test_id", "slots", "new", "until", "shown", F.element_at("used", -1)["outcome"].alias("outcome"), F.size("used").cast("bigint").alias("attempts"),
                    F.aggregate("used", F.lit(0).cast("bigint"), lambda sum_, x: sum_ + x["duration_ms"]).alias("duration_ms")))
    leaves = F.greatest(F.floor(F.element_at("slots", -1)["at"] / 1000).cast("bigint"), F.lit(watermark)) + TEST_SPAN_MS
    changed = F.col("new").isNotNull() & ~F.struct("outcome", "attempts", "duration_ms").eqNullSafe(F.col("shown"))
    kept = kept.select("test_id", "slots", F.when(F.col("new").isNotNull(), leaves).otherwise(F.col("until")).alias("until"), changed.alias("changed"),
                       "attempts", "duration_ms", "outcome", F.col("shown.outcome").alias("was"))
    return written(kept, "state").where("changed").select(*RESULT.fieldNames())


def live_results(attempts: DataFrame) -> Fold:
    """Running result per test, and the one before (K5). Rows of a test: ts, at, event_id, outcome, duration_ms.

    The stream drops attempts behind the watermark and repeated deliveries, which takes a state of LATENESS only. A batch then
    folds all its tests at once, by joins with a state of fixed size per test.
    """
    fresh = attempts.select("test_id", "ts", *SLOT).withWatermark("ts", LATENESS).dropDuplicatesWithinWatermark(["test_id", *SLOT])
    spark = attempts.sparkSession
    return Fold(fresh, RESULT.fieldNames(), RESULT, lambda rows, number, base: fold_batch(rows, number, base, spark))


def split_stale(evidence: DataFrame, run_start: str, slack: str = "5 seconds") -> DataFrame:
    """Evidence with a mark for what is older than its run (K6)."""
    return evidence.withColumn("stale", F.col("ts") < F.expr(f"{run_start} - interval {slack}"))


def route_stale(evidence: DataFrame, run_start: str) -> tuple[DataFrame, DataFrame]:
    """Write fresh and stale evidence to two tables in one pass over the stream (K6)."""
    spark = evidence.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("stale").parquet(f"{base}/table/batch={number}")
    marked = split_stale(evidence, run_start)
    marked.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    table = spark.read.schema(T.StructType(marked.schema.fields + [T.StructField("batch", T.LongType())])).parquet(f"{base}/table")
    return table.where("not stale"), table.where("stale")


def coverage_changes(results: DataFrame, workflows: DataFrame) -> DataFrame:
    """What changed results do to the figures of an application (K7): changes with a table of workflows.

    Rows of `workflows`: test_id, subject, verdict, skipped. A result that replaces another takes its share back.
    """
    def state(outcome: str):
        o = F.col(outcome)
        return (F.when(o.isNull(), "none").when(F.col("verdict") == "PRUNED", "pruned").when(o == "FAIL_APP_NOT_READY", "not_ready")
                .when(F.col("skipped"), "skipped").when(o == "PASS", "passed").otherwise("failed"))

    j = results.join(workflows.select("test_id", "subject", "verdict", "skipped"), "test_id")
    step = j.select("subject", "skipped", state("outcome").alias("now"), state("was").alias("before"))
    share = lambda s: (F.col("now") == s).cast("int") - (F.col("before") == s).cast("int")
    counts = {s: share(s) for s in ("passed", "not_ready", "failed")} | {"executed": (F.col("before") == "none").cast("int")}
    counts["not_skipped"] = F.when(F.col("skipped"), share("not_ready")).otherwise(0)  # not ready comes before skipped
    return step.select("subject", *[c.cast("long").alias(k) for k, c in counts.items()])


class RunningCoverage:
    """Coverage tiers of every application, kept up to date as attempts come in (K7).

    A step takes in what has arrived since the last one, from the stream's checkpoint, and numbers the sums of its
    changes; the tiers after any step are those sums up to it over the denominators of the workflow table.
    """

    def __init__(self, attempts: DataFrame, workflows: DataFrame):
        self.base = new_folder(attempts.sparkSession)
        self.spark = attempts.sparkSession
        self.workflows = cut_lineage(workflows.select("test_id", "subject", "verdict", "skipped", "has_plan", "has_code"))
        self.results = live_results(attempts)
        self.steps = 0

    def step(self) -> None:
        def summed(rows: DataFrame) -> DataFrame:
            figures = [c for c in rows.columns if c != "subject" and c != "batch"]
            return rows.groupBy("subject").agg(*[F.sum(c).alias(c) for c in figures])

        # a batch leaves one row per application
        run(self.results, mode="update", base=self.base, shrink=lambda changed: summed(coverage_changes(changed, self.workflows)))
        summed(self.spark.read.parquet(f"{self.base}/table")).write.mode("overwrite").parquet(f"{self.base}/after/step={self.steps}")
        self.steps += 1

    def tiers(self) -> DataFrame:
        """One row per step made and application, also for applications without a result so far."""
        live = F.col("verdict") != "PRUNED"
        known = self.workflows.groupBy("subject").agg(
            F.count(F.lit(1)).alias("total"), F.count_if(~live).alias("pruned"), F.count_if(live & F.col("skipped")).alias("to_skip"),
            F.count_if(live & F.col("has_plan")).alias("with_plan"), F.count_if(live & F.col("has_code")).alias("with_code"))
        rows = known.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(self.steps - 1))))
        done = self.spark.read.parquet(f"{self.base}/after").withColumn("step", F.col("step").cast("int"))
        j = rows.join(done, ["subject", "step"], "left").na.fill(0).withColumn("skipped", F.col("to_skip") - F.col("not_skipped"))
        denominator = F.col("total") - F.col("pruned")
        return j.withColumns({"c1": ratio("with_plan", denominator), "c2": ratio("with_code", denominator),
                              "c3": ratio("passed", denominator - F.col("not_ready") - F.col("skipped"))}).drop("to_skip", "not_skipped")


def live_attribution(requests: DataFrame, steps: DataFrame, longest: str | None = None) -> DataFrame:
    """Requests joined to the steps they fall into, stream to stream (K7, the live form of E8).

    Both sides have a watermark. A caller who knows that no step lasts longer than `longest` (an interval)
    lets old steps leave the state; without it only requests do.
    """
    r = requests.withWatermark("ts", LATENESS).alias("r")
    s = steps.withWatermark("ts_start", LATENESS).alias("s")
    bound = f" and r.ts <= s.ts_start + interval {longest}" if longest else ""
    return r.join(s, F.expr(f"r.test_id = s.test_id and r.ts >= s.ts_start and r.ts <= s.ts_end{bound}")).select(
        "r.test_id", "r.req", "s.pos", "r.status")


def pass_rate(attempts: DataFrame, width: str = "1 hour", slide: str = "15 minutes") -> DataFrame:
    """Share of passes in sliding windows (K8)."""
    return (attempts.withWatermark("ts", LATENESS).groupBy(F.window("ts", width, slide).alias("w"))
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == "PASS").alias("passed"))
            .select(F.col("w.start").alias("start"), "n", "passed", (F.col("passed") / F.col("n")).alias("rate")))
