"""Phases that several queries read.

A phase writes its tables once per session and folder; the next queries start from
those tables, as one run of the stages would.
"""

from __future__ import annotations

from loomgraph.operators.flow import Flow
from loomgraph.operators.graph import Graph
from loomgraph.operators.intents import Intents
from loomgraph.plans.binding import Plans
from loomgraph.sources import fixture as fx
from loomgraph.sources.views import Tables

_FLOWS: dict[tuple[str, str], Flow] = {}
_PLANS: dict[tuple[str, str], Plans] = {}


def flow(t: Tables) -> Flow:
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _FLOWS:
        _FLOWS[key] = Flow(Graph(t))
    return _FLOWS[key]


def graph(t: Tables) -> Graph:
    return flow(t).g


def make_plans(f: Flow) -> Plans:
    t = f.g.t
    skip = lambda: f.triggers.where(fx.SKIP_WHERE).selectExpr("subject", "comp_id", "edge_id as workflow_id")
    return Plans(Intents(f), t.accounts, t.param_values, t.logins, skip, t.form_overrides)


def plans(t: Tables) -> Plans:
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _PLANS:
        _PLANS[key] = make_plans(flow(t))
    return _PLANS[key]


def intents(t: Tables) -> Intents:
    return plans(t).i
