import json

import pytest
from pyspark.sql import functions as F

from loomgraph.catalog import flow_queries
from loomgraph.operators import evidence as ev
from loomgraph.operators import extract as ex
from loomgraph.operators import flow as fl
from loomgraph.operators import resolve as rs
from loomgraph.sources import bundles as bu


def routes(spark, *paths):
    return spark.createDataFrame([("a", p, f"{p}@m", "c0" if p == "/owners" else "c1", "ComponentRoute") for p in paths],
                                 "subject string, full_path string, route_id string, comp_id string, route_type string")


@pytest.mark.parametrize("value,want", [
    ("'/owners'", "/owners@m"), ("owners", "/owners@m"), ("['/owners', owner.id]", "/owners/:id@m"), ("/owners/{{o.id}}?x=1", "/owners/:id@m"),
    ("['/owners', 'add']", "/owners/add@m"), ("/missing", None), ("../up", None)])
def test_link_resolution(spark, value, want):
    links = spark.createDataFrame([("a", "c0", value)], "subject string, comp_id string, value string")
    got = rs.resolve_links(links, routes(spark, "/owners", "/owners/add", "/owners/:id", "/:any/:id", "/owners/:id/edit")).collect()
    assert (got[0]["target_route_id"] if got else None) == want


def test_relative_link_hangs_below_the_activating_route(spark):
    links = spark.createDataFrame([("a", "c0", "./7")], "subject string, comp_id string, value string")
    got = rs.resolve_links(links, routes(spark, "/owners", "/owners/:id")).first()
    assert (got["target_route_id"], got["stage"]) == ("/owners/:id@m", 2)


def redirect_edges(spark, pairs):
    rows = [("a", f, t, f"{f}>{t}", [], [], [], []) for f, t in pairs]
    return spark.createDataFrame(rows, "subject string, from_id string, target_route_id string, edge_id string, params array<string>, guards array<string>, "
                                       "roles array<string>, refs array<struct<file:string,start:bigint,stop:bigint>>")


def test_redirects_follow_loop_and_stop(spark):
    nodes = spark.createDataFrame([("a", r) for r in "xyzpqu"], "subject string, route_id string")
    got = {r["route_id"]: r for r in fl.redirect_closure(redirect_edges(spark, [("x", "y"), ("y", "z"), ("p", "q"), ("q", "p"), ("u", None)]), nodes).collect()}
    assert (got["x"]["final_route"], got["x"]["state"], got["x"]["edge_ids"]) == ("z", "stable", ["x>y", "y>z"])
    assert (got["p"]["final_route"], got["p"]["state"], got["p"]["edge_ids"]) == ("p", "loop", ["p>q", "q>p"])
    assert (got["u"]["final_route"], got["u"]["state"]) == ("u", "unresolved")
    assert (got["z"]["final_route"], got["z"]["edge_ids"]) == ("z", [])


def test_merge_keeps_first_seen_order(spark):
    ref = "refs array<struct<file:string,start:bigint,stop:bigint>>"
    edges = spark.createDataFrame([("a", "e1", ["b", "a"], [], [], [("k", ["w"])], [("f", 1, 2)]), ("a", "e2", ["c", "b"], [], [], [("l", ["w"])], [("f", 1, 2)])],
                                  f"subject string, edge_id string, params array<string>, guards array<string>, roles array<string>, atoms array<struct<kind:string,args:array<string>>>, {ref}")
    steps = spark.createDataFrame([("a", "w", 0, "e2"), ("a", "w", 1, "e1")], "subject string, workflow_id string, pos int, edge_id string")
    got = fl.merge_steps(steps, edges).first()
    assert got["params"] == ["c", "b", "a"] and [a["kind"] for a in got["atoms"]] == ["l", "k"] and len(got["refs"]) == 1


def test_tokens_cover_the_page_and_ignore_scripts(spark):
    html = '<div class="a>b">\n<script>var t="</p><a href=\'x\'>"</script><!-- <a> --><a href="/x" hidden>Go\n<b>1</b></a><br><p>z'
    toks = ex.tokens(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("pos").collect()
    assert "".join(t["tok"] for t in toks) == html
    assert [t["name"] for t in toks if t["token"] == "open"] == ["div", "a", "b", "p"]
    link = next(t for t in toks if t["name"] == "a")
    before = html[:link["start"]]
    assert link["line"] == before.count("\n") + 1 and link["col"] == len(before) - before.rfind("\n")


def test_broken_markup_is_no_error(spark):
    pages = spark.createDataFrame([(1, '<a href="x <p'), (2, ""), (3, "plain < text")], "page_id long, html string")
    assert ex.widgets(pages).count() == 0


def test_parents_predicates_and_ui(spark):
    html = ('<form (ngSubmit)="s()"><div *ngIf="open"><input type="email" formControlName="m" [disabled]="true"></div>'
            '<select><option value="1">One</option></select></form><button [hidden]="x">B</button>')
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    parent = {r["kind"]: r["parent_id"] for r in ex.parents(pages).collect()}
    assert parent["Form"] is None and "|Form|" in parent["Input"] and "|Select|" in parent["Option"] and parent["Button"] is None
    ui = {r["widget_id"].split("|")[2]: r for r in ex.ui_properties(pages).collect()}
    assert ui["Input"]["visible_expr"] == "open" and ui["Input"]["never_enabled"] and ui["Button"]["visible_expr"] == "x" and ui["Form"]["visible_expr"] is None
    assert {r["label"] for r in ex.labels(pages).collect()} == {"One", "B"}


def test_attempts_end_at_the_first_pass(spark):
    rows = [("t", "s", 1, 1, "FAIL_TIMEOUT", 5), ("t", "s", 1, 2, "PASS", 7), ("t", "s", 1, 3, "FAIL_TIMEOUT", 9), ("u", "s", 2, 1, "FAIL_TIMEOUT", 1), ("u", "s", 2, 2, "FAIL_AUTH", 2)]
    df = spark.createDataFrame(rows, "test_id string, subject string, user_id long, attempt long, outcome string, duration_ms long")
    got = {r["test_id"]: (r["outcome"], r["attempts"], r["duration_ms"]) for r in ev.fold_attempts(df).collect()}
    assert got == {"t": ("PASS", 2, 12), "u": ("FAIL_AUTH", 2, 3)}


def test_not_ready_comes_before_skipped_and_passed(spark):
    rows = [("s", "FEASIBLE", True, True, True, "FAIL_APP_NOT_READY"), ("s", "FEASIBLE", True, True, True, "PASS"), ("s", "FEASIBLE", False, True, True, "PASS"), ("s", "PRUNED", False, False, False, None)]
    df = spark.createDataFrame(rows, "subject string, verdict string, skipped boolean, has_plan boolean, has_code boolean, outcome string")
    got = ev.coverage(df).where("is_total = 0").first()
    assert (got["not_ready"], got["skipped"], got["passed"], got["c3"]) == (1, 1, 1, 1.0)


def test_artifacts_of_several_applications(spark, tmp_path):
    for name in ("one", "two"):
        d = tmp_path / name / "json"
        d.mkdir(parents=True)
        (d / "a1-multigraph.json").write_text(json.dumps({"multigraph": {"nodes": [{"id": f"{name}-r", "kind": "Route", "label": "/", "refs": [], "meta": {"isEntry": True}}],
                                                                         "edges": [{"id": "e", "kind": "ROUTE_HAS_CHILD", "from": "x", "to": None, "refs": []}]}}, indent=1))
    (tmp_path / "one" / "json" / "a2-workflows.json").write_text(json.dumps({"workflows": [{"id": "w", "verdict": "FEASIBLE", "steps": []}]}))
    (tmp_path / "one" / "logs").mkdir()
    (tmp_path / "one" / "logs" / "t.log.json").write_text(json.dumps({"workflowId": "w", "testFile": "t.test.ts", "outcome": "PASS", "steps": [{"stepId": "pre-0", "networkEvidence": [{"url": "/", "method": "GET", "status": 200, "timing": 1.5}]}]}, indent=1))
    (tmp_path / "one" / "logs" / "u.log.json").write_text("{ broken")
    (tmp_path / "two" / "subject-manifest.json").write_text("{ broken")
    (tmp_path / "one" / "subject-manifest.json").write_text(json.dumps({"subjectName": "one", "accounts": []}))
    root = str(tmp_path)
    nodes, edges = bu.read_graph(spark, root)
    assert {(r["subject"], r["id"]) for r in nodes.collect()} == {("one", "one-r"), ("two", "two-r")} and edges.where("to is null").count() == 2
    assert bu.read_workflows(spark, root).select("subject", "id").collect() == [("one", "w")]
    assert bu.read_stage(spark, root, "plans").count() == 0
    logs, steps, requests = bu.read_logs(spark, root)
    assert logs.count() == 1 and steps.count() == 1 and requests.first()["status"] == 200
    assert {(r["subject"], r["load_error"]) for r in bu.read_manifests(spark, root).collect()} == {("one", False), ("two", True)}
    assert [r["subject"] for r in bu.complete_subjects(bu.listing(spark, root)).collect()] == ["one"]


def test_error_rules_in_order(spark):
    df = spark.createDataFrame([("NoSuchElementError at auth-setup", "FAIL_ELEMENT_NOT_FOUND"), ("auth-setup timed out", "FAIL_TIMEOUT"), ("auth-setup", "FAIL_AUTH"), ("x", "FAIL_UNKNOWN")], "e string, want string")
    assert df.where(ev.outcome_of_error(F.col("e"), F.lit("")) != F.col("want")).isEmpty()


def test_tags_are_read_once(spark):
    """A condition on the kind must not read a tag's attributes anew for every name in it."""
    pages = spark.createDataFrame([(1, '<input type="checkbox" id="a" id="b"><ScRipt>x < y</ScRipt><script-x></script-x><a href="/x">t</a>')], "page_id long, html string")
    widgets = ex.widgets(pages).select("page_id", "pos", "kind", "attributes")
    plan = widgets._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") <= 4
    assert [(r.kind, r.attributes.get("id")) for r in widgets.orderBy("pos").collect()] == [("Checkbox", "b"), ("Link", None)]


def test_shell_components_have_a_row_for_every_route(spark, monkeypatch):
    f = fl.Flow(None)
    f.__dict__.update(
        shell=spark.createDataFrame([("s", "shell")], "subject string, comp_id string"),
        starts=spark.createDataFrame([("s", "/a", "/a"), ("s", "/b", "/b"), ("t", "/c", "/c")], "subject string, start_route string, active_route string"),
        component_routes=spark.createDataFrame([("s", "own", "/a")], "subject string, comp_id string, start_route string"),
        triggers=spark.createDataFrame([("s", "shell"), ("s", "shell"), ("s", "own")], "subject string, comp_id string"))
    monkeypatch.setattr(flow_queries, "flow", lambda t: f)
    places = [("own", "/a"), ("shell", "/a"), ("shell", "/b")]
    assert sorted(map(tuple, flow_queries.active(None).select("comp_id", "start_route").collect())) == places
    counted = flow_queries.start_routes(None).select("comp_id", "start_route", "n_workflows").collect()
    assert sorted(map(tuple, counted)) == [(c, r, 2 if c == "shell" else 1) for c, r in places]
