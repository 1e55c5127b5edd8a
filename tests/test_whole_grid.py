"""Queries over every pixel, beside their SQL, against brute force on the smallest tables."""

import numpy as np
import pandas as pd
import pytest

from gridloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def px():
    e = pd.read_parquet(f"{SF}/events.parquet").sort_values("event_id")
    y, x = e.event_id // 100, e.event_id % 100
    return pd.DataFrame({"id": e.event_id, "y": y, "x": x, "label": y // 5 * 20 + x // 5, "other": e.user_id % 7, "value": e.value}).reset_index(drop=True)


def test_point_nms(spark, px):
    yx, radius, ids = px[["y", "x"]].to_numpy(), px.value.to_numpy() / 40, px.id.to_numpy()
    want = set()
    for k in range(len(px)):
        near = np.flatnonzero(np.sqrt(((yx - yx[k]) ** 2).sum(axis=1)).astype(np.float32) <= np.float32(radius[k]))
        want |= {ids[min(near, key=lambda j: (-radius[j], ids[j]))]} if len(near) else set()
    got = [r["point_id"] for r in registry.QUERIES["point_nms"](spark, SF).collect()]
    assert sorted(got) == sorted(want)


def test_point_nms_broadcasts_no_points(spark):
    """Only the scales, a row each, are sent to all tasks, by the driver."""
    plan = registry.QUERIES["point_nms"](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_draw_instances(spark, px):
    h = int(px.y.max()) + 1
    drawn = {}
    for r in px.itertuples():  # by id: the last one stands
        for dy, dx in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)):
            if 0 <= r.y + dy < h and 0 <= r.x + dx < 100:
                drawn[(r.y + dy) * 100 + r.x + dx] = r.other + 1
    assert {r["node_id"]: r["label"] for r in registry.QUERIES["draw_instances"](spark, SF).collect()} == drawn


def test_lifted_objective(spark, px):
    at = {(r.y, r.x): r for r in px.itertuples()}
    border, cost, lifted = {}, {}, {}
    for (y, x), a in at.items():
        for b in (at.get((y + 1, x)), at.get((y, x + 1))):
            if b is not None and a.label != b.label:
                border.setdefault((min(a.label, b.label), max(a.label, b.label)), []).append((a.value + b.value) / 2)
    for e, v in border.items():
        cost[e], lifted[e] = 50 - sum(v) / len(v), False
    labels = set(px.label)
    for r in px.itertuples():
        e = (r.label, r.label + 1 + r.id % 3)
        if e[1] in labels:
            cost[e], lifted[e] = cost.get(e, 0.0) + r.value / 8, lifted.get(e, True)
    got = {(r["u"], r["v"]): (r["cost"], r["is_lifted"]) for r in registry.QUERIES["lifted_objective"](spark, SF).collect()}
    assert {e: v[1] for e, v in got.items()} == lifted
    assert max(abs(got[e][0] - c) for e, c in cost.items()) < 2e-6
