"""Streams that come in several batches, late, twice, and with a restart in between."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loomgraph.catalog import QUERIES
from loomgraph.operators.reconcile import same_rows
from loomgraph.sources.views import Tables
from loomgraph.streaming import jobs as kj

FOLDER = "/root/testdata/sf0.001"
DAY = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
ATTEMPT = "event_id bigint, test_id string, run_id string, ts timestamp, at bigint, outcome string, duration_ms bigint"


def attempt(event_id, test, minute, outcome, run="r"):
    ts = DAY + dt.timedelta(minutes=minute)
    return event_id, test, f"{run}{event_id}", ts, int(ts.timestamp() * 1_000_000), outcome, 10


class Feed:
    """A folder of JSON lines to which batches are added by hand."""

    def __init__(self, spark, schema=ATTEMPT):
        self.spark, self.folder, self.base, self.schema = spark, kj.new_folder(spark), kj.new_folder(spark), schema
        self.stream = None

    def add(self, *rows):
        frame = self.spark.createDataFrame(list(rows), self.schema)
        kj.deliver(frame, "ts", self.folder, -1, 1 << 62)
        self.stream = self.stream or kj.json_event_stream(self.spark, self.folder, frame.schema)
        return self.stream


def jobs(t, stream):
    return {
        "ingest": lambda base: kj.run(stream(t.pipeline_events), base=base),
        "windows": lambda base: kj.run(kj.windowed_counts(stream(t.pipeline_events), ["phase", "severity", "outcome"]), base=base),
        "sessions": lambda base: kj.run(kj.run_sessions(stream(t.pipeline_events)), base=base),
        "once": lambda base: kj.run(kj.completed_once(stream(t.attempt_events)), base=base).groupBy("test_id").count(),
        "fold": lambda base: kj.run(kj.live_results(stream(t.attempt_events)), mode="update", keys=["test_id"], base=base).drop("was"),
    }


@pytest.mark.parametrize("name", ["ingest", "windows", "sessions", "once", "fold"])
def test_same_result_in_one_batch_in_five_and_with_restarts(spark, name):
    t = Tables(spark, FOLDER)
    one = jobs(t, lambda rows: kj.replayed(rows, "ts", 1))[name](None)
    five = jobs(t, lambda rows: kj.replayed(rows, "ts", 5))[name](None)
    rows = {"once": t.attempt_events, "fold": t.attempt_events}.get(name, t.pipeline_events)
    folder, base = kj.new_folder(spark), kj.new_folder(spark)
    edges = kj.slice_edges(rows, "ts", 5)
    for after, upto in zip(edges, edges[1:]):  # every run ends and the next one starts from its checkpoint
        kj.deliver(rows, "ts", folder, after, upto)
        restarted = jobs(t, lambda _: kj.json_event_stream(spark, folder, rows.schema))[name](base)
    assert one.count() > 0 and same_rows(one, five) and same_rows(one, restarted)


def fold(feed):
    out = kj.run(kj.live_results(feed.stream), mode="update", keys=["test_id"], base=feed.base)
    return {r.test_id: (r.attempts, r.duration_ms, r.outcome) for r in out.collect()}


def test_fold_over_batches_with_late_and_repeated_attempts(spark):
    feed = Feed(spark)
    feed.add(attempt(2, "a", 60, "FAIL_TIMEOUT"), attempt(1, "a", 55, "FAIL_AUTH"), attempt(5, "b", 60, "FAIL_AUTH"))
    assert fold(feed) == {"a": (2, 20, "FAIL_TIMEOUT"), "b": (1, 10, "FAIL_AUTH")}
    feed.add(attempt(3, "a", 58, "FAIL_ASSERTION"), attempt(2, "a", 60, "FAIL_TIMEOUT"), attempt(6, "b", 61, "PASS"), attempt(7, "b", 62, "FAIL_AUTH"))
    assert fold(feed) == {"a": (3, 30, "FAIL_TIMEOUT"), "b": (2, 20, "PASS")}  # 3 fits in between, 2 came twice, 7 is behind a pass
    feed.add(attempt(8, "a", 61, "PASS"), attempt(9, "c", 300, "PASS"))
    assert fold(feed)["a"] == (3, 30, "FAIL_TIMEOUT")  # a fourth attempt doesn't count
    feed.add(attempt(10, "b", 59, "FAIL_APP_NOT_READY"))
    assert fold(feed)["b"] == (2, 20, "PASS")  # behind the watermark


def state_rows(spark, feed):
    return {r.key.test_id: r.value for r in spark.read.format("statestore").load(f"{feed.base}/checkpoint").collect()}


def test_state_does_not_grow_with_attempts_and_expires(spark):
    feed = Feed(spark)
    feed.add(*[attempt(k, "hot", k / 100, "FAIL_AUTH") for k in range(2000)], attempt(9000, "cold", 1, "FAIL_AUTH"))
    assert fold(feed)["hot"] == (3, 30, "FAIL_AUTH")
    held = state_rows(spark, feed)
    assert set(held) == {"hot", "cold"} and len(str(held["hot"])) < 1000
    feed.add(*[attempt(3000 + k, "hot", 21 + k / 100, "FAIL_AUTH") for k in range(500)])
    fold(feed)
    assert len(str(state_rows(spark, feed)["hot"])) < 1000
    feed.add(attempt(9001, "new", 3 * 24 * 60, "PASS"))
    fold(feed)
    feed.add(attempt(9002, "new", 3 * 24 * 60 + 1, "PASS"))
    assert fold(feed)["new"] == (1, 10, "PASS")
    assert set(state_rows(spark, feed)) == {"new"}


def test_fold_keeps_one_row_per_test_and_needs_no_python_worker(spark):
    feed = Feed(spark)
    feed.add(*[attempt(k, "hot", k / 100, "FAIL_AUTH") for k in range(500)], attempt(9000, "cold", 1, "FAIL_AUTH"))
    assert "Python" not in (plan := str(kj.live_results(feed.stream).stream._jdf.queryExecution().logical())) and "Pandas" not in plan
    fold(feed)
    feed.add(attempt(9001, "hot", 1, "PASS"), attempt(9002, "new", 3 * 24 * 60, "PASS"))  # hot is late by less than the watermark
    assert fold(feed)["hot"] == (3, 30, "FAIL_AUTH")
    states = [[r for r in spark.read.schema(kj.STATE).parquet(f"{feed.base}/state/{k}").collect()] for k in (0, 1)]
    held = min(states, key=len)  # the last batch of the second run moved the clock by three days
    assert [r.test_id for r in held] == ["new"] and all(len(r.slots) <= kj.ATTEMPTS for rows in states for r in rows)


def test_completions_are_not_repeated_across_batches(spark):
    feed = Feed(spark)
    done = lambda: kj.run(kj.completed_once(feed.stream), base=feed.base).groupBy("test_id").count().collect()
    feed.add(attempt(1, "a", 0, "PASS"), attempt(1, "a", 3, "PASS"))
    assert [r["count"] for r in done()] == [1]
    feed.add(attempt(1, "a", 600, "PASS"), attempt(2, "a", 600, "PASS"))
    assert [r["count"] for r in done()] == [2]


def test_coverage_takes_replaced_results_back(spark):
    workflows = spark.createDataFrame([("a", "s", "FEASIBLE", False, True, True), ("b", "s", "FEASIBLE", True, True, False), ("c", "s", "PRUNED", False, False, False), ("d", "t", "CONDITIONAL", False, False, False)],
                                      "test_id string, subject string, verdict string, skipped boolean, has_plan boolean, has_code boolean")
    feed = Feed(spark)
    feed.add(attempt(2, "a", 5, "PASS"), attempt(3, "c", 5, "PASS"), attempt(9, "unknown", 5, "PASS"))
    job = kj.RunningCoverage(feed.stream, workflows)
    job.step()
    feed.add(attempt(1, "a", 4, "FAIL_APP_NOT_READY"), attempt(4, "b", 6, "FAIL_APP_NOT_READY"))  # an earlier attempt ends the fold of a before it passed
    job.step()
    feed.add(attempt(5, "d", 7, "PASS"))
    job.step()
    got = {(r.step, r.subject): (r.total, r.pruned, r.executed, r.passed, r.failed, r.not_ready, r.skipped, r.c1, r.c3) for r in job.tiers().collect()}
    assert got == {(0, "s"): (3, 1, 2, 1, 0, 0, 1, 1.0, 1.0), (0, "t"): (1, 0, 0, 0, 0, 0, 0, 0.0, 0.0), (1, "s"): (3, 1, 3, 0, 0, 2, 0, 1.0, 0.0), (1, "t"): (1, 0, 0, 0, 0, 0, 0, 0.0, 0.0),
                   (2, "s"): (3, 1, 3, 0, 0, 2, 0, 1.0, 0.0), (2, "t"): (1, 0, 1, 1, 0, 0, 0, 0.0, 1.0)}


def test_live_attribution_equals_the_inside_part_of_the_batch_form(spark):
    live = QUERIES["K7_live_attribution"](spark, FOLDER)
    batch = QUERIES["E8_request_attribution"](spark, FOLDER).where(F.col("inside") == 1).select(*live.columns)
    assert live.count() > 0 and same_rows(live, batch)
