"""A part of the named queries next to their check SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from loomgraph.catalog import reconcile_queries
from loomgraph.operators import checks, evidence as ev
from loomgraph.operators.reconcile import same_rows
from loomgraph.sources.views import Tables

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ["flagship_page_verdicts", "X2_page_widget_kinds", "X6_parent_widgets", "X20_canonical_routes", "E5_integrity", "E8_request_attribution", "E13_failure_families", "E15_residual_families", "E16_family_catalogue", "E11_coverage_tiers",
           "G8_route_has_child", "G16c_array_path", "M1_structural_issues", "K2_windowed_counts", "K3_run_sessions", "K5_live_attempt_fold", "K7_running_coverage", "K7_live_attribution", "M3_unmet_guards", "M6_manifest_status", "S5_manifests", "W2_bootstrap_components", "G24_interface_atoms", "Z1_fnv_hash", "S4_test_logs"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_check_sql(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted(tuple(r) for r in df.select(*cols).collect())
    assert got == sorted(con.execute(f"select {', '.join(cols)} from ({entry.oracle_sql()[name]})").fetchall())


def test_result_does_not_depend_on_partitioning(spark):
    t = Tables(spark, FOLDER)
    a = ev.fold_attempts(t.attempts)
    b = ev.fold_attempts(t.attempts.repartition(37, "k"))
    assert same_rows(a, b)


def test_unmet_guards_ask_all_accounts(spark):
    """A guard that any account satisfies is met, one that only accounts of another application satisfy is not."""
    w = spark.createDataFrame([("a", ["AuthGuard", "RoleGuard", "NoAuthGuard"]), ("b", ["RoleGuard", "UnauthGuard"])], "subject string, guards array<string>")
    accounts = spark.createDataFrame([("a", ["AuthGuard"])] + [("a", [])] * 50 + [("b", []), ("b", ["RoleGuard"])], "subject string, guards array<string>")
    assert sorted(map(tuple, checks.unmet_guards(w, accounts).collect())) == [("a", "RoleGuard")]


def test_missing_and_spurious_both_occur(spark):
    """Entries come from the events, so what only logs is missing and what no reader lists is spurious."""
    t = Tables(spark, FOLDER)
    entries, cands = (df.cache() for df in reconcile_queries.blocks(t))
    got = {}
    for r in entry.queries()["T6_missing_and_spurious"](spark, FOLDER).collect():
        got.setdefault(r.what, set()).add((r.block, r["item"]))
    assert len(got["missing"]) > 10 and len(got["spurious"]) > 10
    matched = entries.count() - len(got["missing"])
    assert matched == cands.count() - len(got["spurious"]) > 0
    per_block = {r.block: (r.n, r.m) for r in entries.groupBy("block").count().withColumnRenamed("count", "n").join(cands.groupBy("block").count().withColumnRenamed("count", "m"), "block", "full").na.fill(0).collect()}
    for block, (n, m) in per_block.items():  # a block is matched as far as its smaller side goes
        assert sum(b == block for b, _ in got["missing"]) == max(n - m, 0) and sum(b == block for b, _ in got["spurious"]) == max(m - n, 0)
