"""Queries that read whole tables, against brute force."""

import numpy as np
import pytest
from compare import SF_DIR

from tessella import plans
from tessella.operators import series
from tessella.plans import matching_queries as Q
from tessella.plans.fixtures import patches, table
from tessella.registry import RUNS

plans.load()


@pytest.fixture(scope="module")
def blocks(spark):
    """Per pair: similarities and log-probabilities, from all rows of embeddings."""
    rows = patches(spark, SF_DIR).select("vec_id", "f").collect()
    out = {}
    for pair in sorted({r.vec_id // 50 for r in rows}):
        side = [np.array([r.f for r in sorted(rows) if r.vec_id // 50 == pair and r.vec_id % 2 == s]) for s in (0, 1)]
        sim = side[0] @ side[1].T * 10
        out[pair] = sim, 2 * sim - np.log(np.exp(sim).sum(1, keepdims=True)) - np.log(np.exp(sim).sum(0, keepdims=True))
    assert len(out) * 50 == len(rows) > 100
    return out


def test_matching_reads_every_row(spark, blocks):
    cells = {(p, i, j): (sim[i, j], logp[i, j]) for p, (sim, logp) in blocks.items() for i in range(25) for j in range(25)}
    for name, at, column in (("similarity_cross", 0, "sim"), ("dual_softmax", 1, "logp")):
        got = {(r.pair, r.i, r.j): r[column] for r in RUNS[name](spark, SF_DIR).collect()}
        assert got.keys() == cells.keys() and all(abs(got[k] - cells[k][at]) < 2e-6 for k in cells)
    mutual = {(p, i, j) for p, (_, t) in blocks.items() for i in range(25) for j in [int(t[i].argmax())] if t[:, j].argmax() == i and t[i, j] > np.log(0.01)}
    assert {(r.pair, r.i, r.j) for r in RUNS["mutual_nn"](spark, SF_DIR).collect()} == mutual
    inner = {m for m in mutual if 1 <= m[1] % 5 <= 3 and 1 <= m[1] // 5 <= 3}
    assert {(r.pair, r.i, r.j) for r in RUNS["border_filter"](spark, SF_DIR).collect()} == inner
    acc = {r.pair: r.acc for r in RUNS["top1_acc"](spark, SF_DIR).collect()}
    loss = {r.pair: r.matching_loss for r in RUNS["losses"](spark, SF_DIR).collect()}
    assert acc.keys() == loss.keys() == blocks.keys()
    for p, (_, t) in blocks.items():
        assert abs(acc[p] - (t.argmax(1) == np.arange(25)).mean()) < 2e-6 and abs(loss[p] + np.diag(t).mean()) < 2e-6


def test_kan_layer_reads_every_row(spark):
    got = {(r.vec_id, r.o): r.y for r in RUNS["kan_layer"](spark, SF_DIR).collect()}
    ids = {r.vec_id for r in patches(spark, SF_DIR).select("vec_id").collect()}
    assert got.keys() == {(i, o) for i in ids for o in (0, 1)}
    base, spline = ({tuple(r)[:-1]: r.w for r in t.collect()} for t in Q._weights(spark))
    knots = [-3 + 1.2 * i for i in range(-3, 9)]
    for r in patches(spark, SF_DIR).where("vec_id >= 60").orderBy("vec_id").limit(5).collect():
        want = np.zeros(2)
        for i, x in enumerate(np.array(r.f) * 10):
            b = [float(p <= x < q) for p, q in zip(knots, knots[1:], strict=False)]
            for k in (1, 2, 3):
                b = [(x - knots[m]) / (1.2 * k) * b[m] + (knots[m + k + 1] - x) / (1.2 * k) * b[m + 1] for m in range(len(b) - 1)]
            for o in (0, 1):
                want[o] += base[o, i] * x / (1 + np.exp(-x)) + sum(spline[o, i, k] * v for k, v in enumerate(b))
        assert all(abs(got[r.vec_id, o] - want[o]) < 1e-4 for o in (0, 1))


def test_nearest_inside_gaps(spark):
    records = [(4, 900.0), (0, 1.0), (1, 3.0), (7, 3.0), (2, 5000.0), (3, 5000.0)]
    targets = [400.0, 451.5, 451.6, 2950.0, 2000.0, 4000.0, 9000.0, -800.0, 3.0]
    want = {t: min(records, key=lambda r: (abs(r[1] - t), r[0])) for t in targets}
    args = spark.createDataFrame([(t,) for t in targets], "t double"), spark.createDataFrame(records, "i int, v double"), "t", "v", "i"
    assert {r.t: (r.i, r.v) for r in series.nearest(*args).collect()} == want
    rng = np.random.default_rng(6)
    values = np.concatenate([rng.uniform(0, 1, 300), rng.uniform(1e6, 1e7, 300), 10 ** rng.uniform(3, 9, 300)]).tolist()
    wanted = np.concatenate([10 ** rng.uniform(0, 10, 400), -(10 ** rng.uniform(0, 5, 50))]).tolist()
    got = series.nearest(spark.createDataFrame([(t,) for t in wanted], "t double"), spark.createDataFrame(list(enumerate(values)), "i int, v double"), "t", "v", "i")
    assert {r.t: r.i for r in got.collect()} == {t: min(range(900), key=lambda i: (abs(values[i] - t), i)) for t in wanted}


def test_nearest_goes_through_a_range_once(spark):
    values, targets = [float(v) for v in range(0, 3000, 3)], [v / 2 for v in range(-9, 6100)]
    got = series.nearest(spark.createDataFrame([(t,) for t in targets], "t double"), spark.createDataFrame(list(enumerate(values)), "i int, v double"), "t", "v", "i")
    assert {r.t: r.i for r in got.collect()} == {t: min(range(1000), key=lambda i: (abs(values[i] - t), i)) for t in targets}
    # A frame from the current row to the end costs the square of a range; only the one over a row a range may have it.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("currentrow$(), unboundedfollowing$()") == 0


def test_every_order_has_its_nearest_record(spark):
    events = table(spark, SF_DIR, "events").select("event_id", "value").collect()
    ids, values = np.array([r.event_id for r in events]), np.array([r.value for r in events], float)
    order = np.argsort(ids, kind="stable")
    ids, values = ids[order], values[order]
    orders = table(spark, SF_DIR, "orders").select("o_orderkey", "o_totalprice").collect()
    want = {r.o_orderkey: int(ids[np.argmin(abs(values - float(r.o_totalprice) / 1000))]) for r in orders}
    assert {r.o_orderkey: r.event_id for r in RUNS["nearest_lat"](spark, SF_DIR).collect()} == want
