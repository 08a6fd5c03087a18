import random
import re

from pyspark.sql import Window as W, functions as F

from loomgraph.functions.scale import FAN, Pages, cover, cut_together, may_crowd, ordinal, reach, session_conf, span_join
from loomgraph.operators.reconcile import greedy_match


def test_ordinal_in_blocks_equals_one_window(spark):
    random.seed(1)
    rows = [("hot" if random.random() < 0.6 else f"k{i % 5}", i * 3) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, seq long")
    a = ordinal(df, ["k"], "seq", "n", block=64)
    b = df.withColumn("n", F.row_number().over(W.partitionBy("k").orderBy("seq")).cast("long") - 1)
    assert a.exceptAll(b).isEmpty() and a.count() == 2000


def test_reach_ends_on_cycles(spark):
    random.seed(2)
    edges = {(random.randrange(12), random.randrange(12)) for _ in range(18)}
    want = {(s, s) for s in range(12)}
    while True:
        more = {(s, d) for s, m in want for f, d in edges if f == m} - want
        if not more:
            break
        want |= more
    e = spark.createDataFrame([("a", str(x), str(y)) for x, y in edges], "subject string, f string, t string")
    seeds = spark.createDataFrame([("a", str(s), str(s)) for s in range(12)], "subject string, root string, node string")
    got = {(int(r["root"]), int(r["node"])) for r in reach(seeds, e, ["subject", "root"], "f", "t", "node").collect()}
    assert got == want


def test_span_join_equals_comparing_all_pairs(spark):
    random.seed(3)
    points = [(random.randrange(3), random.randrange(500), i) for i in range(200)]
    spans = [(random.randrange(3), s, s + random.randrange(120), i) for i, s in enumerate(random.sample(range(500), 60))]
    got = span_join(spark.createDataFrame(points, "k int, at long, p int"), spark.createDataFrame(spans, "k int, lo long, hi long, s int"), ["k"], "at", "lo", "hi", 32)
    want = sorted((p[2], s[3]) for p in points for s in spans if p[0] == s[0] and s[1] <= p[1] <= s[2])
    assert sorted((r["p"], r["s"]) for r in got.collect()) == want


def taking_turns(entries, cands):
    out, used = {}, set()
    for block, entry, handler, tag in sorted(entries, key=lambda e: e[1]):
        free = sorted((c for c in cands if c[0] == block and c[1] not in used), key=lambda c: c[1])
        free = [c for c in free if c[2] == handler] or free
        free = [c for c in free if c[3] == tag] or free
        if free:
            out[entry] = free[0][1]
            used.add(free[0][1])
    return out


def test_greedy_match_equals_taking_turns(spark):
    random.seed(4)
    cands = [(f"b{random.randrange(2)}", i, random.choice("hij"), random.choice("xy")) for i in range(30)]
    entries = [(f"b{random.randrange(3)}", i, random.choice("hijk"), random.choice("xyz")) for i in range(34)]
    schema = "block string, {} long, handler string, tag string"
    got = greedy_match(spark.createDataFrame(entries, schema.format("entry")), spark.createDataFrame(cands, schema.format("cand")))
    assert {r["entry"]: r["cand"] for r in got.collect()} == taking_turns(entries, cands)


def test_cover_is_exact_and_short(spark):
    random.seed(4)
    spans = [(a, a + random.choice([0, 1, 5, 70, 5000, 9_000_000])) for a in (random.randrange(10**6) for _ in range(200))]
    for r in spark.createDataFrame(spans, "a long, b long").withColumn("c", cover(F.col("a"), F.col("b"))).collect():
        bins = sorted((n.node * FAN ** n.level, (n.node + 1) * FAN ** n.level) for n in r.c)
        assert bins[0][0] == r.a and bins[-1][1] == r.b + 1 and all(x[1] == y[0] for x, y in zip(bins, bins[1:]))
        assert r.b - r.a > 10**6 or len(bins) < 50


def test_span_join_with_long_and_short_spans(spark):
    random.seed(5)
    points = [(random.randrange(2), random.randrange(-200, 100_000), i) for i in range(300)]
    spans = [(random.randrange(2), s, s + random.choice([0, 3, 40, 900, 60_000]), i) for i, s in enumerate(random.sample(range(-300, 90_000), 60))]
    got = span_join(spark.createDataFrame(points, "k int, at long, p int"), spark.createDataFrame(spans, "k int, lo long, hi long, s int"), ["k"], "at", "lo", "hi", 8)
    want = sorted((p[2], s[3]) for p in points for s in spans if p[0] == s[0] and s[1] <= p[1] <= s[2])
    assert sorted((r["p"], r["s"]) for r in got.collect()) == want


def test_pages_read_their_ranges_only(spark):
    random.seed(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges stay apart
    rows = [(random.randrange(50), f"t{i}") for i in range(3000)]
    pages = Pages(spark.createDataFrame(rows, "n int, t string").repartition(4), [F.desc("n"), F.asc("t")])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = sorted(rows, key=lambda r: (-r[0], r[1]))
    for number, size in ((0, 25), (2, 25), (119, 25), (1, 1000), (0, 5000), (120, 25), (500, 25)):
        page = pages.page(number, size)
        assert [(r.n, r.t) for r in page.orderBy("__place").collect()] == want[number * size:(number + 1) * size]
    plan = pages.page(60, 25)._jdf.queryExecution().executedPlan().toString()
    assert pages.index.count() > 2 and re.search(r"PartitionFilters: \[[^\]]*__range", plan)
    assert Pages(spark.createDataFrame([], "n int, t string"), [F.asc("n")]).page(0, 10).count() == 0


def test_crowded_keys_are_seen(spark):
    df = spark.createDataFrame([("hot",)] * 50 + [(f"k{i}",) for i in range(50)], "k string")
    assert may_crowd(df, ["k"], limit=49) and not may_crowd(df, ["k"], limit=60) and not may_crowd(df.where("false"), ["k"])


def test_cut_together_moves_rows_once(spark):
    """Sides dealt by one key meet on that and more keys without another exchange, and the setting comes back."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = spark.range(200).selectExpr("id % 7 as a", "id as b", "id * 2 as x").repartition("a")
        right = spark.range(100).selectExpr("id % 7 as a", "id as b", "id * 3 as y").repartition("a")
        joined = left.join(right, ["a", "b"], "left")
        with session_conf(spark, spark__sql__requireAllClusterKeysForCoPartition="false"):
            plan = joined.select("*")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 2
        got = {(r.a, r.b, r.x, r.y) for r in cut_together(joined).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {(i % 7, i, 2 * i, 3 * i if i < 100 else None) for i in range(200)}
    assert spark.conf.get(name) == before
