"""Block, quantile and fold plans against plain sequential answers, with one key holding most rows."""

import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxmill.functions import rules as R
from voxmill.operators import manifest as D
from voxmill.operators import series as S
from voxmill.plans import blocks as B
from voxmill.plans import bricks
from voxmill.plans.fold import fold_blocks
from voxmill.plans.quantiles import column_quantiles, exact_quantiles, lattice_quantiles


@pytest.fixture(scope="module")
def ordered(spark):
    rng = random.Random(3)
    rows, t = [], 0
    for key, n in (("hot", 900), ("a", 40), ("b", 1)):
        t = rng.randrange(50)
        for _ in range(n):
            rows.append((key, t, rng.randrange(-20, 100)))
            t += rng.choice((1, 1, 2, 3, 40))
    return spark.createDataFrame(rows, "k string, t long, v long"), pd.DataFrame(rows, columns=["k", "t", "v"])


def test_row_index_and_running(ordered):
    df, pdf = ordered
    i = B.row_index(df, ["k"], "t", 16)
    got = {(r.k, r.t): r.rn for r in i.collect()}
    pdf = pdf.sort_values(["k", "t"])
    assert got == {(k, t): n for k, t, n in zip(pdf.k, pdf.t, pdf.groupby("k").cumcount())}
    total = {(r.k, r.t): r.s for r in B.running(i, ["k"], "rn", F.col("v"), "s", width=7).collect()}
    assert total == {(k, t): s for k, t, s in zip(pdf.k, pdf.t, pdf.groupby("k").v.cumsum())}
    top = {(r.k, r.t): r.s for r in B.running(i, ["k"], "rn", F.col("v"), "s", width=7, how=F.max, inclusive=False).collect()}
    before = pdf.groupby("k").v.transform(lambda s: s.cummax().shift(1))
    assert {k: v for k, v in top.items() if v is not None} == {(k, t): s for k, t, s in zip(pdf.k, pdf.t, before) if s == s}


def test_block_prefix_spans_super_blocks(spark, monkeypatch):
    monkeypatch.setattr(B, "FAN", 4)
    df = spark.createDataFrame([("k", b, 1) for b in range(0, 60, 3)], "k string, b long, n long")
    got = {r.b: r.p for r in B.block_prefix(df, ["k"], "b", "n", "p").collect()}
    assert got == {b: i for i, b in enumerate(range(0, 60, 3))}


def test_near_window_crosses_blocks(ordered):
    df, _ = ordered
    i = B.row_index(df, ["k"], "t", 16)
    cols = {"lag": lambda w: F.lag("v", 2).over(w), "ahead": lambda w: F.sum("v").over(w.rowsBetween(0, 5))}
    near = {(r.k, r.t): (r.lag, r.ahead) for r in B.near_window(i, ["k"], "rn", 2, 5, cols, width=6).collect()}
    w = W.partitionBy("k").orderBy("t")
    plain = {(r.k, r.t): (r.lag, r.ahead) for r in df.select("k", "t", *[f(w).alias(n) for n, f in cols.items()]).collect()}
    assert near == plain


def test_global_index(spark):
    names = [f"scene{i * 37 % 1000:04d}" for i in range(500)]
    got = B.global_index(spark.createDataFrame([(n,) for n in names], "s string"), ["s"]).collect()
    assert {r.s: r.rn for r in got} == {n: i for i, n in enumerate(sorted(set(names)))}


def test_quantiles_match_linear_interpolation(spark):
    rng = np.random.default_rng(1)
    rows = [("hot", float(x)) for x in rng.lognormal(0, 3, 1500)] + [("flat", 2.0)] * 7 + [("two", 1.0), ("two", 4.0)] + [("hot", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"lo": 0.05, "mid": 0.5, "hi": 0.9}
    for r in exact_quantiles(df, ["k"], "v", probs, buckets=16).collect():
        v = [x for k, x in rows if k == r.k and x is not None]
        assert np.allclose([r.lo, r.mid, r.hi], np.quantile(v, list(probs.values())))
    for r in lattice_quantiles(df, ["k"], "v", probs).collect():
        v = [x for k, x in rows if k == r.k and x is not None]
        assert np.allclose([r.lo, r.mid, r.hi], np.quantile(v, list(probs.values())))
    at = exact_quantiles(df.filter("k = 'hot'"), [], "v", {"third": lambda n: F.lit(2)}).first()
    assert at.third == sorted(x for k, x in rows if k == "hot" and x is not None)[2]
    wide = column_quantiles(df.filter("k = 'two'").withColumn("w", F.col("v") * 2), ["k"], ["v", "w"], {"mid": 0.5}).collect()
    assert {r.name: r.mid for r in wide} == {"v": 2.5, "w": 5.0}


def test_an_outlier_crowds_no_bucket(spark):
    from voxmill.plans.quantiles import bucketed
    df = spark.range(50_000).select(F.lit("k").alias("k"), F.when(F.col("id") == 0, 1e12).otherwise(F.pow(1.001, F.col("id") % 20_000)).alias("v"))
    counted = df.groupBy("k", F.col("v").alias("v_")).agg(F.count(F.lit(1)).alias("n_"))
    sizes = bucketed(counted, ["k"]).groupBy("b_").agg(F.count(F.lit(1)).alias("rows"), F.min("v_").alias("lo"), F.max("v_").alias("hi")).orderBy("b_").collect()
    assert max(r.rows for r in sizes) <= 4 * 20_000 / 1024 and len(sizes) > 900
    assert all(a.hi < b.lo for a, b in zip(sizes, sizes[1:]))
    v = sorted(1e12 if i == 0 else 1.001 ** (i % 20_000) for i in range(50_000))
    got = exact_quantiles(df, ["k"], "v", {"mid": 0.5, "top": 1.0}).first()
    assert got.top == 1e12 and abs(got.mid / np.quantile(v, 0.5) - 1) < 1e-12


def sequential(rows, start, step):
    s = start()
    return [step(s, r) for r in rows]


@pytest.mark.parametrize("width", [64, 300])
def test_belief_fold_is_sequential(spark, width):
    rng = random.Random(5)
    rows = []
    for cap, n in (("hot", 700), ("b", 30)):
        bad = 0
        for f in range(n):
            bad = bad - 1 if bad > 0 else (rng.choice((3, 9, 20, 40)) if rng.random() < 0.04 else 0)
            rows.append((cap, f * 2, rng.choice((0.05, 0.2, 0.4)) if bad else rng.uniform(0.5, 0.95),
                         None if rng.random() < 0.05 else (0.9 if rng.random() < 0.03 else 0.02), 1.0))
    df = spark.createDataFrame(rows, "capture string, frame long, fitness double, step_m double, turn_deg double")
    got = {(r.capture, r.frame): (r.verb, r.why, r.lost, r.reacquired) for r in S.belief(df, width=width).collect()}
    assert len(got) == len(rows)
    for cap in ("hot", "b"):
        recs = [dict(frame=r[1], fitness=r[2], step_m=r[3], turn_deg=r[4]) for r in rows if r[0] == cap]
        for rec, want in zip(recs, sequential(recs, R.belief_start, R.belief_step())):
            assert got[(cap, rec["frame"])] == (want["verb"], want["why"], want["lost"], want["reacquired"])
    assert {"integrate", "confirm", "drop"} == {v[0] for v in got.values()}


def test_missing_measurements_drop(spark):
    rows = [("a", 0, None, 0.9), ("a", 1, None, None), ("a", 2, None, float("nan")), ("a", 3, "no depth", 0.9), ("a", 4, None, 0.9)]
    df = spark.createDataFrame([(*r, None, None) for r in rows], "capture string, frame long, error string, fitness double, step_m double, turn_deg double")
    want = [None, "no fitness", "no fitness", "error", None]
    assert [r.why for r in S.belief(df).orderBy("frame").collect()] == want
    assert [r.why for r in S.step_gate(df).orderBy("frame").collect()] == want


def test_a_lost_capture_is_probed(spark):
    fits = [0.9] * 6 + [0.05] * 15 + [0.9, 0.05, 0.9, 0.9, 0.9, 0.9]
    jump = {21: 5.0, 23: 5.0}
    out = sequential([dict(fitness=f, step_m=jump.get(i), turn_deg=None) for i, f in enumerate(fits)], R.belief_start, R.belief_step())
    assert [o["verb"] for o in out[21:]] == ["confirm", "drop", "confirm", "confirm", "integrate", "integrate"]
    assert [o["lost"] for o in out[19:27]] == [False, True, True, True, True, True, False, False] and sum(o["reacquired"] for o in out) == 1


@pytest.mark.parametrize("case", ["outlier", "lost"])
def test_rounds_are_few(spark, case):
    """A gate locked by its first sample, and a capture lost throughout, over 64 blocks."""
    n, width, rounds = 64 * 16, 16, []
    if case == "outlier":
        rows = [("k", i, 0.0, -60.0 if i == 0 else -9.8, 0.01 * (i % 7)) for i in range(n)]
        df = spark.createDataFrame(rows, "k string, rn long, x double, y double, z double")
        got = fold_blocks(df, ["k"], "rn", ["x", "y", "z"], R.gravity_start, R.gravity_step(), R.GRAVITY_OUT, width, rounds).collect()
        want = sequential([dict(x=r[2], y=r[3], z=r[4]) for r in rows], R.gravity_start, R.gravity_step())
        assert {r.rn: (r.uy, r.used) for r in got} == {i: (w["uy"], w["used"]) for i, w in enumerate(want)}
    else:
        rows = [("k", i, 0.9 if i < 10 else 0.01, None, None) for i in range(n)]
        df = spark.createDataFrame(rows, "capture string, frame long, fitness double, step_m double, turn_deg double")
        got = S.belief(df, width=width, rounds=rounds).collect()
        want = sequential([dict(fitness=r[2], step_m=None, turn_deg=None) for r in rows], R.belief_start, R.belief_step())
        assert {r.frame: (r.verb, r.lost) for r in got} == {i: (w["verb"], w["lost"]) for i, w in enumerate(want)}
    assert len(got) == n and 1 < len(rounds) <= 7


def test_rows_without_order_are_refused(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("a", 3)], "k string, t long")
    with pytest.raises(Exception, match="order of its series"):
        B.row_index(df, ["k"], "t", 16).count()
        B.row_index(df, ["k"], "t", 16).collect()


def test_gravity_fold_is_sequential(spark):
    rng = random.Random(8)
    rows = [(0, i, rng.gauss(0, .1), -9.8 + rng.gauss(0, .1) * (30 if i % 17 == 0 else 1), rng.gauss(0, .1)) for i in range(400)]
    df = spark.createDataFrame(rows, "capture int, idx long, x double, y double, z double")
    rn = B.row_index(df, ["capture"], "idx", 64)
    got = {r.rn: (r.ux, r.uy, r.used) for r in fold_blocks(rn, ["capture"], "rn", ["x", "y", "z"], R.gravity_start, R.gravity_step(), R.GRAVITY_OUT, 32).collect()}
    want = sequential([dict(x=r[2], y=r[3], z=r[4]) for r in rows], R.gravity_start, R.gravity_step())
    assert all(got[i] == (w["ux"], w["uy"], w["used"]) for i, w in enumerate(want))


def test_fold_settles_when_state_never_forgets(spark):
    """A counter never forgets, so every block has to wait for the one before: still exact."""
    df = spark.createDataFrame([("k", i, 1) for i in range(60)], "k string, rn long, v long")

    def step(s, r):
        s["n"] += r["v"]
        return {"n": s["n"]}
    got = fold_blocks(df, ["k"], "rn", ["v"], lambda: {"n": 0}, step, "n long", 16).collect()
    assert {r.rn: r.n for r in got} == {i: i + 1 for i in range(60)}


def test_fold_keeps_runs_whole_when_joins_turn_into_broadcasts(spark):
    def step(s, r):
        s["v"], last = r["v"], s["v"]
        return {"was": last}
    df = spark.range(4000).select(F.lit("a").alias("k"), F.col("id").alias("rn"), (F.col("id") + 1).alias("v")).repartition(8)
    late = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m",
            "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k, None) for k in late}
    for k, v in late.items():
        spark.conf.set(k, v)
    try:
        got = fold_blocks(df, ["k"], "rn", ["v"], lambda: {"v": 0}, step, "was long", 256).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sorted((r.rn, r.was) for r in got) == [(i, i) for i in range(4000)]


def test_best_height_is_sequential(spark):
    rng = random.Random(2)
    rows = [("a", i, round(rng.uniform(0.4, 1.1) + i / 400, 4) if i % 5 else None) for i in range(300)]
    rows += [("a", 300 + i, h) for i, h in enumerate([1.0, 2.6, 2.61, 3.1, float("nan"), 3.10004, 3.2])]
    df = spark.createDataFrame(rows, "capture string, frame long, height double")
    got = [(r.frame, r.value) for r in S.best_height(df, width=4).orderBy("frame").collect()]
    assert got[-1] == (306, 3.2) and any(v == 2.6 for _, v in got)
    out = sequential([dict(height=r[2]) for r in rows], R.height_start, R.height_step())
    assert got == [(r[1], o["value"]) for r, o in zip(rows, out) if o["took"]]


def test_colour_settles_as_the_step_rule(spark):
    rng = random.Random(4)
    rows = []
    for cap in range(4):
        for f in range(40 + 60 * cap):
            drift = 40 / (1 + f) if cap != 2 else rng.uniform(0, 30)
            rows.append((cap, f, 0.0 if f == 5 else 137 - drift, 0.0 if f == 5 else 120.0, 0.0 if f == 5 else 147 + drift))
    df = spark.createDataFrame(rows, "capture int, frame long, r double, g double, b double")
    for r in S.colour_settled(df, cap=60).collect():
        out = sequential([dict(r=x[2], g=x[3], b=x[4]) for x in rows if x[0] == r.capture], R.settle_start, R.settle_step(cap=60))
        first = next((i + 1 for i, o in enumerate(out) if o["settled"]), None)
        assert r.settled_at == first
        assert r.capped == (out[first - 1]["capped"] if first else False)


def test_greedy_batches_match_a_plain_loop(spark):
    rng = random.Random(6)
    files = [(f"f{i:04d}", rng.choice((0, 1, 5, 90, 400, 1500))) for i in range(300)]
    want, batch, n, size = {}, 0, 0, 0
    for p, s in files:
        if n and (n >= 7 or size + s > 1000):
            batch, n, size = batch + 1, 0, 0
        want[p] = batch
        n, size = n + 1, size + s
    got = D.greedy_batches(spark.createDataFrame(files, "path string, size long"), 7, 1000)
    assert {r.path: r.batch for r in got.collect()} == want


def test_states_are_json():
    for start in (R.belief_start, R.gravity_start, R.height_start, R.settle_start):
        assert json.loads(json.dumps(start())) == start()


def test_bricks_hold_sets_and_their_neighbours(spark):
    rng = random.Random(12)
    cells = {(k, *(rng.randrange(-7, 6) for _ in range(3))) for k in range(2) for _ in range(400)}
    df = spark.createDataFrame(sorted(cells) * 2, "room int, ix int, iy int, iz int")
    made = bricks.bricks(df, ["room"])
    assert made.count() < len(cells) / 5
    rows = lambda d: sorted(tuple(r) for r in d.select("room", "ix", "iy", "iz").collect())
    assert rows(bricks.cells(made, "bits", ["room"])) == sorted(cells)
    step = lambda c, a, d: (*c[:1 + a], c[1 + a] + d, *c[2 + a:])
    around = bricks.neighbours(made, ["room"])
    for a in range(3):
        for way, d in (("up", 1), ("down", -1)):
            assert rows(bricks.cells(around, f"{way}{a}", ["room"])) == sorted(step(c, a, -d) for c in cells)
    want = cells | {step(c, a, d) for c in cells for a in range(3) for d in (1, -1)}
    assert rows(bricks.cells(bricks.grown(made, ["room"]), "bits", ["room"])) == sorted(want)
    none = bricks.bricks(df.limit(0), ["room"])
    assert none.count() == bricks.grown(none, ["room"]).count() == 0


def test_least_direction_is_the_eigenvector(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for i in range(300):
        a = rng.standard_normal((3, 3))
        size = [[1, 1, 1], [1, 1, 1e-3], [5, 1e-4, 2], [1e3, 1e3, 0]][i % 4]
        q = np.linalg.qr(a)[0]
        m = q @ np.diag(np.array(size) * (1 + rng.random(3))) @ q.T
        m = (m + m.T) / 2
        rows.append((i, *[float(m[x, y]) for x in range(3) for y in range(x, 3)]))
        want[i] = np.linalg.eigh(m)[1][:, 0]
    names = [f"q{x}{y}" for x in range(3) for y in range(x, 3)]
    df = spark.createDataFrame(rows + [(999, 2.0, 0.0, 0.0, 2.0, 0.0, 2.0)], "id int, " + ", ".join(f"{n} double" for n in names))
    got = {r.id: r for r in S.least_direction(df, ["id"], {n: F.col(n) for n in names}).collect()}
    assert got[999].e0 is None
    assert all(abs(abs(want[i] @ [got[i].e0, got[i].e1, got[i].e2]) - 1) < 1e-9 for i in want)
