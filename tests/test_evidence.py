"""Evidence of failures: as-of joins, what each layer says, and every family of the catalogue."""

import datetime as dt
import random

import pytest

from loomgraph.functions.scale import last_before
from loomgraph.operators import evidence as ev

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_last_before_equals_a_scan(spark, width):
    rng = random.Random(width)
    points = [(k, rng.choice("ab"), rng.randint(0, 60)) for k in range(80)] + [(100, "none", 5), (101, "a", -3)]
    events = [(rng.choice("abc"), rng.randint(0, 60), rng.randint(0, 3), rng.choice(["x", None])) for _ in range(60)]
    got = last_before(spark.createDataFrame(points, "id int, key string, at int"), spark.createDataFrame(events, "key string, when int, n int, v string"), ["key"], "at", "when", ["n", "v"], "hit", width)
    for r in got.collect():
        known = [(w, n, v or "", v) for k, w, n, v in events if k == r.key and w <= r["at"]]
        assert (r.hit and (r.hit.n, r.hit.v)) == (max(known)[1::2] if known else None)
    assert got.count() == len(points)


# family: (phase, kind, statuses by minute before the failing step and in it, health problem, flags of the step's widget or None)
CASES = {
    "ENV:port-contamination": ("step", "timeout", {}, "port", {}),
    "ENV:app-identity-mismatch": ("step", "timeout", {}, "identity", {}),
    "ENV:auth-rate-limit": ("pre", "timeout", {60: 429}, None, {"has_login": True}),
    "ENV:seed-data-absent": ("step", "timeout", {60: 404}, None, {}),
    "L4:missing-route-params": ("step", "timeout", {60: 401}, None, {"param_unbound": True}),
    "L4:backend-auth-rejection": ("step", "timeout", {60: 403}, None, {}),
    "L4:backend-validation": ("step", "timeout", {60: 400}, None, {}),
    "L2:external-redirect": ("post", "timeout", {60: 200}, None, {"external": True}),
    "L2:non-navigating-handler": ("post", "timeout", {}, None, {"has_param": True}),
    "L2:parameterized-postcondition": ("post", "timeout", {}, None, {"navigates": True, "has_param": True}),
    "L2:postcondition-url-mismatch": ("post", "timeout", {}, None, {"navigates": True}),
    "STRUCT:multi-step-precondition": ("step", "timeout", {10: 500, 60: 200}, None, {}),
    "STRUCT:composition-gap": ("step", "timeout", {}, None, None),
    "L3:dialog-precondition": ("step", "timeout", {}, None, {"dialog": True, "repeater": True}),
    "L3:async-permission-gate": ("step", "timeout", {}, None, {"async_gate": True, "gated": True}),
    "L3:repeater-data-readiness": ("step", "timeout", {}, None, {"repeater": True, "gated": True}),
    "L3:material-sidenav": ("step", "timeout", {}, None, {"sidenav": True}),
    "L3:user-action-precondition": ("step", "interaction-failed", {}, None, {"gated": True}),
    "L3:element-not-interactable": ("step", "interaction-failed", {}, None, {}),
    "L3:locator-mismatch": ("step", "locator-not-found", {}, None, {}),
}
FLAGS = ["has_login", "param_unbound", "external", "navigates", "has_param", "dialog", "async_gate", "repeater", "sidenav", "gated", "unrouted"]


def test_every_family_from_joined_evidence(spark):
    minute = lambda m: START + dt.timedelta(minutes=m)
    failures, steps, requests, health, targets = [], [], [], [], []
    for k, (family, (phase, kind, statuses, problem, flags)) in enumerate(CASES.items()):
        failures.append((family, f"s{k}", 3, phase, kind))
        steps += [(family, 0, minute(0), minute(5)), (family, 3, minute(58), minute(62)), (family, 4, minute(70), minute(75))]
        requests += [(family, m, minute(m), s) for m, s in statuses.items()] + [(family, 90, minute(90), 404)]  # the last is after the failure
        health += [(f"s{k}", minute(-500), "port"), (f"s{k}", minute(50), problem), (f"s{k}", minute(59), "identity")]  # during the step: too late
        if flags is not None:
            targets.append((family, 3, *[flags.get(f) for f in FLAGS]))
    evidence = ev.residual_evidence(
        spark.createDataFrame(failures, "test_id string, subject string, pos int, phase string, kind string"), spark.createDataFrame(steps, "test_id string, pos int, ts_start timestamp, ts_end timestamp"),
        spark.createDataFrame(requests, "test_id string, req int, ts timestamp, status int").selectExpr("*", "'GET' as method"),
        spark.createDataFrame(health, "subject string, ts timestamp, problem string"), spark.createDataFrame(targets, "test_id string, pos int, " + ", ".join(f"{f} boolean" for f in FLAGS)))
    got = {r.test_id: (r.family, r.confidence) for r in ev.residual_families(evidence).collect()}
    assert got == {f: (f, "HIGH" if 60 in CASES[f][2] else "MEDIUM") for f in CASES}


def test_unrouted_components_are_a_gap_and_empty_layers_say_nothing(spark):
    failures = spark.createDataFrame([("a", "s", 1, "step", "timeout"), ("b", "s", 1, "step", "timeout")], "test_id string, subject string, pos int, phase string, kind string")
    steps = spark.createDataFrame([(t, 1, START, START) for t in "ab"], "test_id string, pos int, ts_start timestamp, ts_end timestamp")
    requests = spark.createDataFrame([], "test_id string, req int, ts timestamp, status int, method string")
    health = spark.createDataFrame([], "subject string, ts timestamp, problem string")
    targets = spark.createDataFrame([("a", 1, *[None] * 10, True), ("b", 1, *[None] * 11)], "test_id string, pos int, " + ", ".join(f"{f} boolean" for f in FLAGS))
    got = {r.test_id: (r.family, r.confidence) for r in ev.residual_families(ev.residual_evidence(failures, steps, requests, health, targets)).collect()}
    assert got == {"a": ("STRUCT:composition-gap", "MEDIUM"), "b": ("L3:locator-mismatch", "MEDIUM")}
