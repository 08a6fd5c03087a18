"""Manifests as text: what is unreadable, what has a wrong type, what the workflows miss in them."""

import json

from loomgraph.operators import checks as ck
from loomgraph.sources import bundles as bu

GOOD = {"subjectName": "a", "baseUrl": "http://a", "accounts": [{"username": "u", "password": "p", "roles": [], "guardSatisfies": ["AuthGuard"]}], "routeParamValues": {"id": "1"},
        "routeParamOverrides": {"/x/:tab": {"tab": "t"}}, "skipWorkflows": [], "authSetup": {"loginRoute": "/login", "usernameField": "u", "passwordField": "p", "submitButton": "b", "authSuccessSelector": "s"}}


def texts(spark, **manifests):
    rows = [(k, k, "s", v if isinstance(v, str) else json.dumps(v)) for k, v in manifests.items()]
    return spark.createDataFrame(rows, "manifest_id string, folder string, subject string, text string")


def issues(spark, **manifests):
    return sorted((r.manifest_id, r.field) for r in ck.manifest_issues(texts(spark, **manifests)).collect())


def test_reader_keeps_neighbours_of_wrong_fields(spark, tmp_path):
    for name, text in {"good": json.dumps(GOOD), "wrong": json.dumps(GOOD | {"subjectName": 7, "accounts": {}, "skipWorkflows": "all", "authSetup": None}), "broken": "{", "bare": "[]"}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "subject-manifest.json").write_text(text)
    got = {r.subject: r for r in bu.read_manifests(spark, str(tmp_path)).select(
        "subject", "load_error", "subject_name", "base_url", "wrong_fields", "route_param_values", "auth_setup", "accounts").collect()}
    assert (got["good"].subject_name, got["good"].wrong_fields, len(got["good"].accounts), len(got["good"].auth_setup)) == ("a", [], 1, 5)
    wrong = got["wrong"]
    assert (wrong.load_error, wrong.subject_name, wrong.base_url, wrong.accounts) == (False, None, "http://a", None) and set(wrong.route_param_values) == {"id"}
    assert wrong.wrong_fields == ["subjectName", "accounts", "skipWorkflows", "authSetup"]
    assert got["broken"].load_error and not got["bare"].load_error and got["bare"].base_url is None
    assert bu.read_manifests(spark, str(tmp_path / "nothing")).count() == 0


def test_structural_issues(spark):
    assert issues(spark, a=GOOD) == []
    assert issues(spark, b=GOOD) == [("b", "subjectName:folder")]
    assert issues(spark, a=GOOD | {"subjectName": ""}) == [("a", "subjectName")]
    assert issues(spark, a="{") == [("a", "LOAD_ERROR")]
    assert issues(spark, a=GOOD | {"routeParamOverrides": {"/x": "1", "/y": {"id": 1, "tab": "t"}}}) == [("a", "routeParamOverrides./x"), ("a", "routeParamOverrides./y.id")]
    assert issues(spark, a={k: v for k, v in GOOD.items() if k != "accounts"}) == [("a", "accounts")]


def test_cross_checks_and_status(spark):
    bare = {k: v for k, v in GOOD.items() if k not in ("authSetup", "routeParamOverrides")}
    m = texts(spark, a=GOOD, b=GOOD | {"subjectName": "b", "accounts": []}, c=bare | {"subjectName": "c"}, d="{", e=GOOD | {"subjectName": "e", "baseUrl": ""})
    required = spark.createDataFrame([("s", "guard", "AuthGuard"), ("s", "guard", "NoAuthGuard"), ("s", "param", "id"), ("s", "param", "tab"), ("s", "param", "tab"), ("t", "guard", "Other")], "subject string, what string, name string")
    cross = ck.cross_check(m, required)
    assert sorted((r.manifest_id, r.field) for r in cross.collect()) == [("b", "guard:AuthGuard"), ("c", "authSetup"), ("c", "param:tab")]
    known = m.where("manifest_id <> 'a'")
    got = {r.manifest_id: (r.status, r.errors, r.warnings) for r in ck.manifest_status(m, ck.manifest_issues(m).unionByName(cross), known).collect()}
    assert got == {"a": ("MISSING_A2", 0, 0), "b": ("VALID", 0, 1), "c": ("VALID", 0, 2), "d": ("LOAD_ERROR", 1, 0), "e": ("INVALID", 1, 0)}
