"""Operators on small hand-made cases and against brute force, hot groups included."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import FOLDER
from voxmill.functions import geometry as G
from voxmill.functions.geometry import Grid
from voxmill.operators import evidence as E
from voxmill.operators import joins as J
from voxmill.operators import score as SC
from voxmill.operators import series as S
from voxmill.operators import surface as M
from voxmill.operators import voxelize as V
from voxmill.sources import meta, text, volumes
from voxmill.sources.mapstore import MapStore

CAM = dict(zip(G.POSE, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0]))


def frames_df(spark, poses, fx=100.0, c=50.0):
    rows = [(i, fx, fx, c, c, *[p[k] for k in G.POSE]) for i, p in enumerate(poses)]
    return spark.createDataFrame(rows, "frame int, fx double, fy double, cx double, cy double, " + ", ".join(f"{k} double" for k in G.POSE))


# ---- nearest --------------------------------------------------------------------

@pytest.mark.parametrize("limit", [0.3, None])
def test_nearest_in_a_crowd(spark, limit):
    """A third of both sides sits in one tiny spot, and some points coincide."""
    rng = random.Random(1)
    spot = lambda: (0.5 + rng.random() * 1e-4, 0.5 + rng.random() * 1e-4, 0.5)
    wide = lambda: tuple(rng.uniform(-3, 3) for _ in range(3))
    q = [(i, *(spot() if i % 3 == 0 else wide())) for i in range(300)]
    f = [(i, *(spot() if i % 3 == 0 else wide())) for i in range(450)] + [(1000 + i, 1.0, 1.0, 1.0) for i in range(90)]
    qd, fd = spark.createDataFrame(q, "id long, x double, y double, z double"), spark.createDataFrame(f, "ref_id long, x double, y double, z double")
    got = J.nearest(qd, fd, limit) if limit else J.nearest_any(qd, fd, 0.3)
    got = {r.id: (r.ref_id, r.d2) for r in got.collect()}
    a, b = np.array([x[1:] for x in q]), np.array([x[1:] for x in f])
    d2 = ((a[:, None] - b[None]) ** 2)
    d2 = d2[..., 0] + d2[..., 1] + d2[..., 2]
    for i, row in enumerate(d2):
        best = row.min()
        if limit and best > limit * limit:
            assert i not in got
        else:
            assert got[i][1] == best and got[i][0] == min(f[j][0] for j in np.nonzero(row == best)[0])


def test_nearest_broadcasts_nothing_that_grows(spark):
    """Cells and points of the references go through a shuffle, however small they look."""
    p = spark.range(50).select(F.col("id"), *[(F.col("id") * k % 7 / 10).alias(a) for k, a in ((3, "x"), (5, "y"), (2, "z"))])
    plan = J.nearest(p, p.withColumnRenamed("id", "ref_id"), 0.3)._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_nearest_sends_a_query_once(spark):
    """A query meets the occupied cells around it in one row, and not as a row for each cell there may be."""
    p = spark.createDataFrame([(i, i * 0.1, 0.0, 0.0) for i in range(20)], "id long, x double, y double, z double")
    plan = J.nearest(p, p.withColumnRenamed("id", "ref_id"), 0.3, levels=3)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode([-1,0,1])" not in plan and "explode([0,1])" not in plan


def test_nearest_keeps_keys_apart(spark):
    q = spark.createDataFrame([(1, "a", 0.0, 0.0, 0.0), (2, "c", 0.0, 0.0, 0.0)], "id long, k string, x double, y double, z double")
    f = spark.createDataFrame([(7, "b", 0.0, 0.0, 0.0), (8, "a", 40.0, 0.0, 0.0)], "ref_id long, k string, x double, y double, z double")
    assert [(r.id, r.ref_id) for r in J.nearest_any(q, f, 0.5, keys=["k"]).collect()] == [(1, 8)]


@pytest.mark.parametrize("limit", [0.11, 0.5, None])
def test_nearest_over_many_tiles(spark, monkeypatch, limit):
    """Lattice points with ties, a crowd on either side, an outlier, a key of few points, keys on one side alone and rows without a place."""
    monkeypatch.setattr(J, "TILE", 300)
    monkeypatch.setattr(J, "CROWD", 200)
    rng = random.Random(7)
    some = lambda: tuple(rng.randrange(40) / 20 for _ in range(3)) if rng.random() < 0.7 else tuple(1 + rng.random() * 1e-3 for _ in range(3))
    key = lambda: rng.choice(["a", "a", "a", "b"])
    f = [(i, key(), *some()) for i in range(4000)] + [(9000 + i, "c", *some()) for i in range(5)] + [(9100, "a", 1e9, 0.0, 0.0), (9101, "e", 1.0, 1.0, 1.0)]
    q = [(i, key(), *(x + rng.choice([0.0, 0.025]) for x in some())) for i in range(1500)] + [(5000 + i, rng.choice("cd"), *some()) for i in range(400)]
    odd = [(7000, None, 1.0, 1.0, 1.0), (7001, "a", None, 1.0, 1.0), (7002, "a", float("nan"), 1.0, 1.0)]
    again = [(0, "a", 0.5, 0.5, 0.5)]                                        # an id that comes twice has the better answer
    names = "long, k string, x double, y double, z double"
    got = J.nearest(spark.createDataFrame(q + odd + again, "id " + names), spark.createDataFrame(f + odd, "ref_id " + names), limit, keys=["k"])
    got = sorted((r.id, r.ref_id, r.d2) for r in got.collect())
    want = {}
    for i, k, *p in q + again:
        refs = [(r[0], r[2:]) for r in f if r[1] == k]
        d2 = ((np.array(p)[None] - np.array([r[1] for r in refs] or np.zeros((0, 3)))) ** 2)
        d2 = d2[:, 0] + d2[:, 1] + d2[:, 2]
        if len(refs) and (limit is None or d2.min() <= limit * limit):
            want[i] = min(want.get(i, (np.inf, 0)), min((d, r[0]) for d, r in zip(d2.tolist(), refs)))
    assert got == sorted((i, r, d) for i, (d, r) in want.items())


def test_nearest_shuffles_a_query_no_oftener_in_a_crowd(spark):
    """References a millionth of the limit apart: no join a level, and no window over a query's candidates."""
    p = spark.range(300).select("id", (F.col("id") * 1e-6).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    plan = J.nearest(p, p.withColumnRenamed("id", "ref_id"), 1.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1 and "Window" not in plan


def test_fill_hidden_makes_its_voxels_once(spark):
    """They are read by each step from one copy."""
    v = spark.range(60).select("id", F.lit(1).alias("room"), *[(F.col("id") % n).cast("int").alias(c) for n, c in ((3, "ix"), (4, "iy"), (5, "iz"))],
                               (1 + F.col("id") % 2).cast("int").alias("cls"), (F.col("id") % 3 == 0).alias("seen"), *[F.col("id").cast("int").alias(c) for c in "rgb"])
    f = E.fill_hidden(v, ["room"])
    assert "Range (" not in f._jdf.queryExecution().executedPlan().toString()
    rows, want = {r.id: r for r in v.collect()}, {}
    for r in rows.values():
        if not r.seen:
            want[r.id] = min(((r.ix - s.ix) ** 2 + (r.iy - s.iy) ** 2 + (r.iz - s.iz) ** 2, s.id) for s in rows.values() if s.seen and s.cls == r.cls)
    assert {r.id: (r.d2, r.r) for r in f.collect() if r.borrowed} == want


def test_asof_takes_next_then_last(spark):
    s = spark.createDataFrame([("a", i, t) for i, t in enumerate((0.0, 0.55, 0.61, 3.0, 9.95, 10.08, 10.2))], "capture string, idx long, t double")
    f = spark.createDataFrame([("a", 1, 0.05), ("a", 2, 0.6), ("a", 3, 0.69), ("a", 4, 10.0)], "capture string, frame long, t double")
    got = {r.idx: r.frame for r in J.asof_next(s, f, "capture", 0.1, ["frame"]).collect()}
    assert got == {0: 1, 1: 2, 2: 3, 4: 4, 5: 4}


# ---- evidence -------------------------------------------------------------------

def test_flat_wall(spark):
    """A wall at 2.02 m seen by a camera at the origin: hit in its own cell layer, free before it."""
    f = frames_df(spark, [CAM])
    d = spark.range(10000).select(F.lit(0).alias("frame"), (F.col("id") % 100).cast("int").alias("u"), F.floor(F.col("id") / 100).cast("int").alias("v"),
                                  F.lit(2020).alias("depth_mm"), *[F.lit(9).alias(c) for c in "rgb"])
    grid = Grid(-1.0, -1.0, 0.0, 0.08, 25, 25, 50)
    o = E.observe(d, f, grid, 100, 100)
    layers = {(r.kind, r.iz) for r in o.select("kind", "iz").distinct().collect()}
    assert {z for k, z in layers if k == "hit"} == {24, 25} or {z for k, z in layers if k == "hit"} == {25}
    assert ("pass", 12) in layers and not any(z >= 26 for _, z in layers)
    assert E.observe(d.withColumn("depth_mm", F.lit(0)), f, grid, 100, 100).isEmpty()
    assert E.observe(d, f, grid, 100, 100, max_range=1.0).isEmpty()


def ev(spark, rows):
    return spark.createDataFrame([(0, *r) for r in rows], "room int, frame int, ix int, iy int, iz int, kind string")


def cl(spark, rows):
    return spark.createDataFrame([(0, *r) for r in rows], "room int, frame int, ix int, iy int, iz int, cls int")


def test_counts_are_frames_and_hits_cancel_passes(spark):
    e = ev(spark, [(0, 1, 1, 1, "hit"), (0, 1, 1, 1, "hit"), (0, 1, 1, 1, "pass"), (1, 1, 1, 1, "pass"), (2, 1, 1, 1, "pass"), (3, 1, 1, 1, "hit"), (4, 2, 2, 2, "unknown")])
    r = E.evidence_counts(e).collect()
    assert [(x.n_hit, x.n_pass, x.first_touch) for x in r] == [(2, 2, 0)]
    assert E.settled_frames(e).first().first_meas == 2


def test_claims_need_agreement(spark):
    rows = [(f, 0, 0, 0, c) for f, c in enumerate((3, 3, 2, 2, 0))] + [(f, 1, 0, 0, c) for f, c in enumerate((5, 5, 5, 0, 0))] + [(f, 2, 0, 0, 4) for f in range(2)]
    got = {r.ix: (r.predicted, r.cls, r.n_seen) for r in E.with_class(E.vote_counts(cl(spark, rows))).collect()}
    assert got == {0: (True, 2, 5), 1: (False, 0, 5), 2: (False, 0, 2)}


def verdict_case(spark):
    c = [(f, x, 0, 0, 3) for x in (0, 1, 2, 4, 5, 8) for f in (5, 6, 7)]
    e = ([(f, 0, 0, 0, "hit") for f in (8, 9)] + [(f, 1, 0, 0, "pass") for f in (8, 9)] + [(f, 3, 5, 0, "hit") for f in (1, 2)]
         + [(f, 4, 0, 0, "pass") for f in (1, 2)] + [(f, 5, 1, 0, "hit") for f in (1, 2)] + [(f, 5, 0, 0, "pass") for f in (8, 9)] + [(5, 8, 0, 0, "hit"), (9, 8, 0, 0, "hit")])
    return ev(spark, e), cl(spark, c)


def test_verdicts(spark):
    e, c = verdict_case(spark)
    v = {(r.ix, r.iy): r for r in E.with_disproved(E.verdicts(E.world_map(e, c))).collect()}
    assert v[0, 0].confirmed and v[1, 0].contradicted and v[2, 0].untested and v[3, 5].missed
    assert v[4, 0].in_free and not v[4, 0].contradicted          # seen before it was claimed
    assert v[4, 0].disproved and not v[5, 0].disproved            # the skin of a surface is spared
    assert not v[8, 0].blind and not v[8, 0].confirmed            # measured in the frame that claimed it


def test_colour_leans_to_the_latest_look(spark):
    rows = [(0, f, 1, 1, 1, "hit", r, 0, 0) for f, r in ((0, 10), (0, 30), (3, 100), (7, 200))]
    e = spark.createDataFrame(rows, "room int, frame int, ix int, iy int, iz int, kind string, r int, g int, b int")
    for width in (1, 4, 1024):
        got = E.latest_colour(e, width=width).first()
        assert got.colour_n == 3 and math.isclose(got.r, ((20 * .5 + 100 * .5) * .5 + 200 * .5))


KEEP = ["ix", "iy", "n_hit", "n_pass", "predicted", "cls", "blind", "confirmed", "contradicted", "untested", "missed", "in_free"]


def test_map_store_is_the_batch_map(spark, tmp_path):
    e, c = verdict_case(spark)
    store = MapStore(spark, str(tmp_path / "map")).create()
    for b, (lo, hi) in enumerate(((0, 5), (6, 8), (9, 20))):
        store.merge(e.filter(F.col("frame").between(lo, hi)), c.filter(F.col("frame").between(lo, hi)), b)
    store.merge(e.filter("frame >= 9"), c.filter("frame >= 9"), 2)           # the same batch again
    store.merge(e.filter("frame = 8"), c.filter("frame = 8"), 0, "other")    # a frame another stream brought
    rows = lambda d: sorted(tuple(r) for r in d.select(KEEP).collect())
    want = rows(E.verdicts(E.world_map(e, c)))
    assert rows(store.world()) == want
    assert [(r.frame, r.stream, r.batch) for r in store.late().collect()] == [(8, "other", 0)]
    for upto in (5, 7, 20):
        small = store.compact(str(tmp_path / f"small{upto}"), upto)
        assert rows(small.world()) == want
    small.merge(e.filter("frame = 8"), c.filter("frame = 8"), 9)             # a frame that is closed
    assert rows(small.world()) == want and [(r.frame, r.batch) for r in small.late().collect()] == [(8, 9)]


def test_a_frame_split_over_batches_counts_once_and_whole(spark, tmp_path):
    e, c = verdict_case(spark)
    store = MapStore(spark, str(tmp_path / "map")).create()
    for b in range(3):
        store.merge(e.filter(F.col("ix") % 3 == b), c.limit(0), b)
        store.merge(e.limit(0), c.filter(F.col("ix") % 3 == b), 3 + b)
    rows = lambda d: sorted(tuple(r) for r in d.select(KEEP).collect())
    assert rows(store.world()) == rows(E.verdicts(E.world_map(e, c))) and store.late().count() == 0


def test_a_stream_without_its_checkpoint_overwrites_nothing(spark, tmp_path):
    from voxmill.streaming import maps
    e, c = verdict_case(spark)
    rgb = [F.lit(7).alias(x) for x in "rgb"]
    mixed = maps.mixed_rows(e.select("*", *rgb), c)
    for i, (lo, hi) in enumerate(((0, 6), (0, 20))):                        # the second run sees old and new files
        mixed.filter(F.col("frame").between(7 * i, hi)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if i == 0:
            store = MapStore(spark, str(tmp_path / "map")).create()
        stream = spark.readStream.schema(mixed.schema).parquet(str(tmp_path / "in"))
        maps.map_stream(stream, store, str(tmp_path / f"ck{i}")).awaitTermination()
    rows = lambda d: sorted(tuple(r) for r in d.select(KEEP).collect())
    assert rows(store.world()) == rows(E.verdicts(E.world_map(e, c))) and store.late().count() > 0
    assert store.world().filter("colour_n > 0 AND r <> 7").count() == 0


def test_a_frame_delivered_again_is_whole(spark, tmp_path):
    """A stream dies in the middle of frame 1; another, of a later or an earlier name, brings the frame whole."""
    e = lambda rows: spark.createDataFrame([(0, f, x, 0, 0, k, 5, 5, 5) for f, x, k in rows], "room int, frame int, ix int, iy int, iz int, kind string, r int, g int, b int")
    c = lambda rows: spark.createDataFrame([(0, f, x, 0, 0, k) for f, x, k in rows], "room int, frame int, ix int, iy int, iz int, cls int")
    whole = e([(1, 0, "hit"), (1, 1, "pass"), (1, 2, "hit"), (2, 1, "hit")]), c([(1, 0, 3), (1, 2, 4)])
    for first, second in (("a", "b"), ("b", "a")):
        store = MapStore(spark, str(tmp_path / f"map-{first}")).create()
        store.merge(e([(1, 0, "hit"), (1, 9, "hit")]), c([(1, 0, 3)]), 0, first)    # voxel 9 came with the first alone
        store.merge(*whole, 0, second)
        got = {r.ix: (r.n_hit, r.n_pass, r.n_seen, r.v3, r.v4, r.colour_n) for r in store.totals().collect()}
        assert got == {0: (1, 0, 1, 1, 0, 1), 1: (1, 1, 0, 0, 0, 1), 2: (1, 0, 1, 0, 1, 1), 9: (1, 0, 0, 0, 0, 1)}
        assert {(r.frame, r.stream) for r in store.late().collect()} == {(1, first)}
        small = store.compact(str(tmp_path / f"small-{first}"), 1)
        assert {r.ix: (r.n_hit, r.n_pass, r.n_seen) for r in small.totals().collect()} == {x: v[:3] for x, v in got.items()}


def test_gather_matches_brute_force(spark):
    local, world = Grid(-1.0, -1.0, 0.0, 0.25, 8, 8, 6), Grid(-2.0, -2.0, -0.5, 0.25, 16, 16, 12)
    rng = random.Random(3)
    rots = []
    for yaw, pitch in ((0.3, 0.2), (2.0, -0.4)):
        c, s, cp, sp = math.cos(yaw), math.sin(yaw), math.cos(pitch), math.sin(pitch)
        rots.append(np.array([[c, s * sp, -s * cp], [s, -c * sp, c * cp], [0, -cp, -sp]]))
    T = [(r, np.array([0.1 * i, -0.2, 1.1])) for i, r in enumerate(rots)]
    L = [(rots[0] @ np.array([[1, 0, 0], [0, math.cos(.1), -math.sin(.1)], [0, math.sin(.1), math.cos(.1)]]), np.array([0, 0, 1.0]))] * 2
    claims = [(f, i, j, k, rng.randrange(12)) for f in range(2) for i in range(8) for j in range(8) for k in range(6) if rng.random() < 0.6]
    want = set()
    cls = {x[:4]: x[4] for x in claims}
    for f in range(2):
        for i, j, k in np.ndindex(16, 16, 12):
            p = np.array([-2.0, -2.0, -0.5]) + (np.array([i, j, k]) + 0.5) * 0.25
            q = L[f][0] @ (T[f][0].T @ (p - T[f][1])) + L[f][1]
            n = tuple(np.floor((q - np.array([-1.0, -1.0, 0.0])) / 0.25).astype(int))
            if (f, *n) in cls:
                want.add((f, i, j, k, cls[(f, *n)]))
    flat = lambda m: [*m[0].reshape(-1).tolist(), *m[1].tolist()]
    fr = spark.createDataFrame([(f, *flat(T[f]), *flat(L[f])) for f in range(2)], "frame int, " + ", ".join(f"{c} double" for c in G.POSE + ["l_" + c for c in G.POSE]))
    got = E.gather_prediction(spark.createDataFrame(claims, "frame int, ix int, iy int, iz int, cls int"), fr, local, world)
    assert {tuple(r) for r in got.collect()} == want and want


# ---- voxels, solids, surfaces ---------------------------------------------------

def test_one_voxel_boxes_fill_their_own_cell(spark):
    g = Grid(-1.0, -1.0, 0.0, 0.1, 20, 20, 20)
    rows = [(i, 0, 1 + i % 11, "box", -1.0 + (i % 20 + .5) * .1, -1.0 + (i * 7 % 20 + .5) * .1, (i * 3 % 20 + .5) * .1, .098, .098, .098, 1., 0., 0., 0., 1., 0., 0., 0., 1.) for i in range(200)]
    s = spark.createDataFrame(rows, "room int, seq int, cls int, shape string, " + ", ".join(f"{c} double" for c in ["cx", "cy", "cz", "sx", "sy", "sz", *G.ROT]))
    got = {(r.room, r.ix, r.iy, r.iz, r.label) for r in V.paint_solids(s, g).collect()}
    assert got == {(i, i % 20, i * 7 % 20, i * 3 % 20, 1 + i % 11) for i in range(200)}


def _turned(rng, yaw_only):
    a = rng.uniform(-np.pi, np.pi, 3) * (0 if yaw_only else 1)
    c, s = np.cos(a), np.sin(a)
    y = rng.uniform(-np.pi, np.pi)
    rz = np.array([[np.cos(y), -np.sin(y), 0], [np.sin(y), np.cos(y), 0], [0, 0, 1]])
    return rz @ np.array([[1, 0, 0], [0, c[0], -s[0]], [0, s[0], c[0]]]) @ np.array([[c[1], 0, s[1]], [0, 1, 0], [-s[1], 0, c[1]]])


@pytest.mark.parametrize("yaw_only,most", [(True, 512), (False, 512), (False, 7)])
def test_runs_hold_the_cells_inside_each_solid(spark, yaw_only, most):
    """Turned boxes, wedges and cylinders in closed form beside a test of every cell; later solids overwrite."""
    rng = np.random.default_rng(5 + yaw_only)
    g = Grid(-1.0, -2.0, 0.5, 0.25, 20, 18, 24)
    rows, want = [], {}
    for room in range(4):
        for seq in range(12):
            rot, size, centre = _turned(rng, yaw_only), rng.uniform(0.3, 4, 3), rng.uniform([-1, -2, 0.5], [4, 2.5, 6.5])
            shape, cls = ["box", "wedge", "cylinder", "cone"][int(rng.integers(4))], int(rng.integers(1, 12))
            rows.append((room, seq, cls, shape, *map(float, centre), *map(float, size), *map(float, rot.ravel())))
            for ijk in np.ndindex(*g.dims):
                p = rot.T @ (np.array([g.ox, g.oy, g.oz]) + (np.array(ijk) + 0.5) * g.unit - centre) / (size / 2)
                inside = {"box": abs(p).max() <= 1, "wedge": abs(p).max() <= 1 and p[0] + p[2] <= 0,
                          "cylinder": p[0] ** 2 + p[1] ** 2 <= 1 and abs(p[2]) <= 1, "cone": False}[shape]
                if inside:
                    want[room, *ijk] = cls
    s = spark.createDataFrame(rows, "room int, seq int, cls int, shape string, " + ", ".join(f"{c} double" for c in ["cx", "cy", "cz", "sx", "sy", "sz", *G.ROT]))
    runs = V.painted_runs(s, g, most=most)
    cells = [(r.room, r.ix, r.iy, r.iz, r.label) for r in V.cells_of(runs).collect()]
    assert len(cells) == len(want) and {c[:4]: c[4] for c in cells} == want
    down = {tuple(r) for r in V.downsample_runs(runs, "room").collect()}
    assert down == {tuple(r) for r in V.downsample_labels(V.cells_of(runs), "room").collect()}
    assert {tuple(r) for r in V.downsample_runs(runs, "room", 3, 0).collect()} == {tuple(r) for r in V.downsample_labels(V.cells_of(runs), "room", 3, 0).collect()}


def test_painting_is_compiled(spark, capsys):
    """The JVM leaves methods above 8,000 bytes to the interpreter."""
    from voxmill.catalog import voxels
    from voxmill.derived import Tables
    t = Tables(spark, FOLDER)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for df in (V.painted_runs(voxels.solids(t), voxels.LATTICE), voxels.volume(t), V.downsample_runs(voxels.volume(t), "room")):
            df.explain("codegen")
            sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
            assert sizes and max(sizes) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_block_vote_rules(spark):
    rows = [("a", i % 4, i // 4 % 4, 0, 3) for i in range(4)] + [("b", i % 4, i // 4, 0, 5) for i in range(3)] + [("c", 0, 0, z, 7 - z % 2) for z in range(4)]
    d = spark.createDataFrame(rows, "room string, ix int, iy int, iz int, label int")
    got = {r.room: r.label for r in V.downsample_labels(d, "room", default=0).collect()}
    assert got == {"a": 3, "b": 0, "c": 6}       # 4 of 64 occupied already win, 3 do not, ties go low


@pytest.mark.parametrize("seed,n,cap", [(2, 12, 5), (3, 1, 12), (4, 60, 12), (5, 400, 3), (6, 12, 1), (7, 5, 40)])
def test_distance_is_exact_below_the_cap(spark, seed, n, cap):
    rng = random.Random(seed)
    pts = {(rng.randrange(14), rng.randrange(12), rng.randrange(10)) for _ in range(n)}
    rows = [(f, *p) for p in pts for f in ([0, 1] if p[0] % 2 else [0])]
    d = V.squared_distance(spark.createDataFrame(rows, "frame int, ix int, iy int, iz int"), Grid(0, 0, 0, 1, 14, 12, 10), cap, ["frame"]).collect()
    got = {(r.frame, r.ix, r.iy, r.iz): r.d2 for r in d}
    assert len(got) == len(d) and (not d or max(got.values()) < cap * cap)
    for frame in (0, 1):
        mine = [r[1:] for r in rows if r[0] == frame]
        for c in np.ndindex(14, 12, 10):
            best = min((sum((a - b) ** 2 for a, b in zip(c, p)) for p in mine), default=cap * cap)
            assert got.get((frame, *c), cap * cap) == min(best, cap * cap)


@pytest.mark.parametrize("cells", [[(0, 0, 0)], [(0, 0, 0), (1, 0, 0)], [(x, y, 0) for x in range(4) for y in range(3)]])
def test_surface_is_closed_and_faces_out(spark, cells):
    d = spark.createDataFrame([(0, *c) for c in cells], "room int, ix int, iy int, iz int")
    v = {(r.cix, r.ciy, r.ciz): np.array([r.x, r.y, r.z]) for r in M.surface_vertices(d, ["room"]).collect()}
    tri = M.quad_triangles(M.surface_quads(d, ["room"]), ["room"])
    assert {r.n for r in M.edge_counts(tri, ["room"]).collect()} == {2}
    vol = sum(np.dot(v[tuple(t.a)], np.cross(v[tuple(t.b)], v[tuple(t.c)])) for t in tri.collect()) / 6
    assert vol > 0
    owners = {(r.ix, r.iy, r.iz) for r in M.surface_vertices(d, ["room"]).collect()}
    assert owners <= set(cells)


def test_empty_and_touching_faces(spark):
    d = spark.createDataFrame([(0, 0, 0, 0), (0, 1, 0, 0), (1, 5, 5, 5)], "room int, ix int, iy int, iz int")
    got = {r.room: r["count"] for r in M.exposed_faces(d, ["room"]).groupBy("room").count().collect()}
    assert got == {0: 10, 1: 6}
    assert M.exposed_faces(d.filter("room > 5"), ["room"]).isEmpty()


# ---- series ---------------------------------------------------------------------

def test_floor_is_found_under_a_bed(spark):
    rng = np.random.default_rng(0)
    up = np.array([0.0, -math.cos(0.1), -math.sin(0.1)])
    a = np.cross(up, [1.0, 0, 0]); a /= np.linalg.norm(a)
    flat = lambda n, h: (-h * up)[None] + rng.uniform(-1, 1, (n, 1)) * np.array([1.0, 0, 0]) + rng.uniform(-1, 1, (n, 1)) * a + rng.normal(0, .002, (n, 1)) * up
    pts = np.vstack([flat(3000, 0.55), flat(1200, 1.11)])
    d = spark.createDataFrame([(0, *map(float, p), *map(float, up)) for p in pts], "frame int, p0 double, p1 double, p2 double, up0 double, up1 double, up2 double")
    low = S.fit_floor(d, ["frame"], min_inliers=500).first()
    assert abs(low.height - 1.11) < 0.005 and low.tilt_deg < 1.0 and low.inliers > 1100
    assert abs(S.fit_floor(d, ["frame"], prefer="largest", min_inliers=500).first().height - 0.55) < 0.005
    assert S.floor_gate(S.fit_floor(d, ["frame"], min_inliers=500)).first().error == "few points"


def test_bias_is_recovered_only_from_varied_directions(spark):
    rng = np.random.default_rng(4)
    u = rng.normal(size=(400, 3)); u /= np.linalg.norm(u, axis=1)[:, None]
    bias, scale = np.array([.2, -.1, .05]), np.array([1.02, .97, 1.0])
    rows = [(0, *map(float, x)) for x in u * S.GRAVITY * scale + bias] + [(1, 0.01 * (i % 3), -9.8, 0.0) for i in range(100)]
    got = {r.capture: r for r in S.fit_bias(spark.createDataFrame(rows, "capture int, x double, y double, z double")).collect()}
    assert np.allclose([got[0].bx, got[0].by, got[0].bz], bias, atol=1e-6)
    assert np.allclose([got[0].sx, got[0].sy, got[0].sz], scale, atol=1e-6)
    assert got[1].bx is None


# ---- scoring and sources ----------------------------------------------------------

def test_mean_iou_rules_differ_on_absent_classes(spark):
    conf = spark.createDataFrame([(1, 1, 8), (1, 2, 2), (0, 0, 50)], "label int, pred int, n long")
    got = {r.rule: r.value for r in SC.mean_iou_rules(conf).collect()}
    assert math.isclose(got["zero"], 0.8 / 11) and math.isclose(got["union_nan"], 0.4) and math.isclose(got["gt_present"], 0.8)


def test_points_round_trip_through_files(spark, tmp_path):
    v = spark.createDataFrame([(f, i, i % 60, 0, i // 60, 1 + i % 11) for f in (1, 2) for i in range(90)], "frame int, flat int, gz int, gy int, gx int, pred int")
    text.write_points(text.voxel_lines(v, "frame", F.lit(True)), str(tmp_path / "ply"), "frame")
    lines = spark.read.text(str(tmp_path / "ply"))
    back = text.parse_points(lines, "frame")
    assert {(r.frame, r.ix, r.iy, r.iz, r.cls) for r in back.collect()} == {(r.frame, r.gz, r.gy, r.gx, r.pred) for r in v.collect()}
    one = [r.value for r in spark.read.text(str(tmp_path / "ply" / "frame=1")).collect()]
    assert one[0] == "ply" and one[2] == "element vertex 90" and one[9] == "end_header"


def test_scores_round_trip_keeps_ids_and_gaps(spark, tmp_path):
    s = spark.createDataFrame([("0007", 1.25, None), ("12", None, 3)], "frame string, cam_z double, classes int")
    text.write_scores(s, str(tmp_path / "csv"))
    assert sorted(map(tuple, text.read_scores(spark, str(tmp_path / "csv"), s.schema).collect())) == [("0007", 1.25, None), ("12", None, 3)]


def test_label_run_files(spark, tmp_path):
    import struct
    (tmp_path / "bin").mkdir()
    body = struct.pack("3f", 1, 2, 3) + struct.pack("16f", *range(16)) + np.array([2, 5, 255, 3, 5, 4], np.uint32).tobytes()
    (tmp_path / "bin" / "a.bin").write_bytes(body)
    head, runs = volumes.label_runs(volumes.read_binary(spark, str(tmp_path / "bin")))
    assert head.first().vox_origin == [1.0, 2.0, 3.0]
    assert [r.label for r in volumes.expand_runs(runs).orderBy("flat").collect()] == [2] * 5 + [255] * 3 + [11] * 4


def test_solids_from_files_reject_bad_rows(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"solids": [{"class": "bed", "center": [0,0,1], "size": [1,1,1], "yaw_deg": 90},'
                                     '{"class": 12, "center": [0,0,1], "size": [1,1,1]}, {"class": 4, "shape": "cone", "center": [0,0,1], "size": [1,1,1]},'
                                     '{"class": 4, "center": [0,0,1], "size": [1,1,1], "rotation": [[2,0,0],[0,1,0],[0,0,1]]}]}')
    good, bad = meta.solids(meta.read_documents(spark, str(tmp_path / "s.json")), "file")
    g = good.collect()
    assert [(r.seq, r.cls, r.shape) for r in g] == [(0, 6, "box")] and math.isclose(g[0].r10, 1.0)
    assert {r.seq: r.why for r in bad.collect()} == {1: "class", 2: "shape", 3: "rotation"}


def most_made(df):
    """Rows of the plan's largest Generate, once the rows were taken."""
    df.collect()

    def walk(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec" or kind.endswith("QueryStageExec"):
            yield from walk(plan.executedPlan() if kind == "AdaptiveSparkPlanExec" else plan.plan())
            return
        if kind == "GenerateExec":
            yield plan.metrics().get("numOutputRows").get().value()
        for i in range(plan.children().size()):
            yield from walk(plan.children().apply(i))
    return max(walk(df._jdf.queryExecution().executedPlan()))


def test_vertices_are_made_at_the_surface_only(spark):
    rng = random.Random(7)
    block = [(0, x, y, z) for x in range(12) for y in range(12) for z in range(12)]
    assert most_made(M.surface_vertices(spark.createDataFrame(block, "room int, ix int, iy int, iz int"), ["room"])) < len(block)
    rows = [(r, x, y, z) for r in (0, 1) for x in range(-3, 7) for y in range(-5, 4) for z in range(9) if rng.random() < 0.4]
    rows += [(1, None, 2, 3), (1, None, 2, 4), (None, 0, 0, 0)]
    masks = {}
    for key, *p in rows:
        for b, c in enumerate((i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1)):
            at = (key, *[None if x is None else x - o for x, o in zip(p, c)])
            masks[at] = masks.get(at, 0) | 1 << b
    want = sorted(((str(at), *[None if x is None else x + o for x, o in zip(at[1:], M._vertex_of(m))]) for at, m in masks.items() if m < 255), key=str)
    got = M.surface_vertices(spark.createDataFrame(rows + rows[:20], "room int, ix int, iy int, iz int"), ["room"]).collect()
    assert sorted(((str((r.room, r.cix, r.ciy, r.ciz)), r.x, r.y, r.z) for r in got), key=str) == want


def test_depth_triangles_make_no_row_a_corner(spark):
    image = [(0, u, v, 1000) for u in range(40) for v in range(30)]
    assert most_made(M.triangulate_depth(spark.createDataFrame(image, "frame int, u int, v int, depth_mm int"), 40)) <= 2 * len(image)
    rng = random.Random(3)
    rows = [(f, u, v, rng.choice([0, 900, 950, 1000, 1100])) for f in [*range(60), None] for u in [*range(25), None] for v in [*range(14), None] if rng.random() < 0.9]
    rows += rng.sample(rows, 500)
    seen = {}
    for f, u, v, mm in rows:
        for du, dv in ((0, 0), (0, 1), (1, 0), (1, 1)):
            if mm:
                seen.setdefault((f, None if u is None else u - du, None if v is None else v - dv), []).append(mm)
    want = []
    for (f, u, v), mm in seen.items():
        if len(mm) == 4 and max(mm) - min(mm) <= 120:
            at = lambda du, dv: None if u is None or v is None else (v + dv) * 25 + u + du
            want += [(f, 0, at(0, 0), at(0, 1), at(1, 0)), (f, 1, at(1, 0), at(0, 1), at(1, 1))]
    got = M.triangulate_depth(spark.createDataFrame(rows, "frame int, u int, v int, depth_mm int"), 25).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
