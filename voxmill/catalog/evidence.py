"""Queries over evidence, claims and verdicts."""

from pyspark.sql import functions as F

from voxmill.catalog.registry import query
from voxmill.catalog.voxels import CLAIMS, COARSE, H, HALF, W, claims
from voxmill.functions import geometry as G
from voxmill.operators import evidence as E

VOX = "room, ix, iy, iz"


def _observe_sql():
    g = COARSE
    d = [f"{a}0 - {t}" for a, t in zip("xyz", ("tx", "ty", "tz"))]
    cam = ", ".join(f"({d[0]})*r0{j} + ({d[1]})*r1{j} + ({d[2]})*r2{j} AS c{j}" for j in range(3))
    return f"""WITH vox AS (SELECT ix, iy, iz, {g.ox}e0 + (ix + 0.5e0) * {g.unit}e0 AS x0, {g.oy}e0 + (iy + 0.5e0) * {g.unit}e0 AS y0, {g.oz}e0 + (iz + 0.5e0) * {g.unit}e0 AS z0
  FROM (SELECT CAST(UNNEST(range({g.nx})) AS INT) AS ix) a, (SELECT CAST(UNNEST(range({g.ny})) AS INT) AS iy) b, (SELECT CAST(UNNEST(range({g.nz})) AS INT) AS iz) c),
cam AS (SELECT frame, ix, iy, iz, fx, fy, cx, cy, {cam} FROM fx_frames CROSS JOIN vox),
pix AS (SELECT *, CAST(ROUND_EVEN(fx * c0 / c2 + cx, 0) AS BIGINT) AS u, CAST(ROUND_EVEN(fy * c1 / c2 + cy, 0) AS BIGINT) AS v FROM cam WHERE c2 > 0.15 AND c2 <= 3.5),
obs AS (SELECT pix.frame, ix, iy, iz, CASE WHEN ABS(depth_mm / 1000e0 - c2) <= 0.08 THEN 'hit' WHEN depth_mm / 1000e0 - c2 > 0.08 THEN 'pass' END AS kind
  FROM pix JOIN fx_depth d ON d.frame = pix.frame AND d.u = pix.u AND d.v = pix.v WHERE depth_mm > 0 AND depth_mm <= 3500)"""


@query("observe_frames", "W01 J07", _observe_sql() + """
SELECT frame, kind, COUNT(*) AS n, SUM((ix * 32 + iy) * 20 + iz)::BIGINT AS keys FROM obs WHERE kind IS NOT NULL GROUP BY ALL""")
def observe_frames(t):
    o = E.observe(t.fx_depth, t.fx_frames, COARSE, W, H)
    key = (F.col("ix") * 32 + F.col("iy")) * 20 + F.col("iz")
    return o.groupBy("frame", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(key).alias("keys"))


@query("sweep_map", "W01 W02 W03", _observe_sql() + """,
f AS (SELECT FLOOR(frame / 20)::INT AS room, frame, ix, iy, iz, MAX((kind = 'hit')::INT) AS hit FROM obs WHERE kind IS NOT NULL GROUP BY ALL),
c AS (SELECT room, ix, iy, iz, SUM(hit) AS h, SUM(1 - hit) AS p FROM f GROUP BY ALL)
SELECT room, CASE WHEN h >= 2 THEN 2 WHEN p >= 2 THEN 1 ELSE 0 END AS state, COUNT(*) AS n, SUM(h)::BIGINT AS hits, SUM(p)::BIGINT AS passes FROM c GROUP BY ALL""")
def sweep_map(t):
    o = E.observe(t.fx_depth, t.fx_frames, COARSE, W, H)
    c = E.evidence_counts(o.withColumn("room", F.floor(F.col("frame") / 20).cast("int")))
    c = c.withColumn("state", E.measured_state(F.col("n_hit"), F.col("n_pass")))
    return c.groupBy("room", "state").agg(F.count(F.lit(1)).alias("n"), F.sum("n_hit").alias("hits"), F.sum("n_pass").alias("passes"))


EV = f"""WITH f AS (SELECT {VOX}, frame, MAX((kind = 'hit')::INT) AS hit FROM fx_evidence WHERE kind <> 'unknown' GROUP BY ALL),
e AS (SELECT {VOX}, SUM(hit)::BIGINT AS n_hit, SUM(1 - hit)::BIGINT AS n_pass, MIN(frame) AS first_touch FROM f GROUP BY ALL)"""


@query("evidence_counts", "W02 W03", EV + f"""
SELECT {VOX}, n_hit, n_pass, first_touch, CASE WHEN n_hit >= 2 THEN 2 WHEN n_pass >= 2 THEN 1 ELSE 0 END AS state FROM e""")
def evidence_counts(t):
    c = E.evidence_counts(t.fx_evidence)
    return c.withColumn("state", E.measured_state(F.col("n_hit"), F.col("n_pass")))


@query("settled_frames", "W04", EV + f""",
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY {VOX}, hit ORDER BY frame) AS rk FROM f)
SELECT {VOX}, MIN(frame) AS first_meas FROM r WHERE rk = 2 GROUP BY ALL""")
def settled_frames(t):
    return E.settled_frames(t.fx_evidence)


COLOUR = f"""
WITH m AS (SELECT {VOX}, frame, AVG(r) AS r, AVG(g) AS g, AVG(b) AS b FROM fx_evidence WHERE kind = 'hit' GROUP BY ALL),
k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY {VOX} ORDER BY frame DESC) - 1 AS age, COUNT(*) OVER (PARTITION BY {VOX}) AS n FROM m),
w AS (SELECT *, CASE WHEN age = n - 1 THEN POW(0.5e0, age) ELSE 0.5e0 * POW(0.5e0, age) END AS wt FROM k)
SELECT {VOX}, COUNT(*) AS colour_n, ROUND(SUM(wt * r), 6) AS r, ROUND(SUM(wt * g), 6) AS g, ROUND(SUM(wt * b), 6) AS b FROM w GROUP BY ALL"""


@query("latest_colour", "W05", COLOUR)
def latest_colour(t):
    c = E.latest_colour(t.fx_evidence, width=8)
    return c.select("room", "ix", "iy", "iz", "colour_n", *[F.round(x, 6).alias(x) for x in "rgb"])


def local_frames(t):
    """Frames with their world pose and the gravity-aligned pose of their own grid."""
    p = G.live_pose(F.col("tz"), F.lit(0.0), F.col("r20"), F.col("r21"), F.col("r22"))
    return t.fx_frames.select("frame", *G.POSE, *[p[c].alias("l_" + c) for c in G.POSE])


@query("gather_prediction", "W06")
def gather_prediction(t):
    """Rows-only: the local pose involves square roots, so cell ownership at exact borders is
    checked against brute force in the tests instead."""
    g = E.gather_prediction(claims(t), local_frames(t), HALF, HALF)
    return g.groupBy("frame", "cls").agg(F.count(F.lit(1)).alias("n"))


DYADIC = G.Grid(-2.0, -2.0, -0.5, 0.25, 16, 16, 10)
# Quarter turns and eighths of a metre: every product and sum is exact, also where a centre lies on a border.
TURNS = {name: f"CASE {q} {' '.join(f'WHEN {i} THEN {v}e0' for i, v in enumerate(vals))} END"
         for q, names in (("frame % 4", ("c", "s")), ("frame // 4 % 4", ("lc", "ls"))) for name, vals in zip(names, ((1, 0, -1, 0), (0, 1, 0, -1)))}


def turned_frames(t):
    f = t.fx_frames.select("frame")
    q = {"": F.col("frame") % 4, "l_": F.floor(F.col("frame") / 4) % 4}
    pick = lambda k, vals: F.element_at(F.array(*[F.lit(float(v)) for v in vals]), (k + 1).cast("int"))
    out = []
    for pre, k in q.items():
        c, s, z, o = pick(k, (1, 0, -1, 0)), pick(k, (0, 1, 0, -1)), F.lit(0.0), F.lit(1.0)
        out += [x.alias(pre + n) for x, n in zip([c, -s, z, s, c, z, z, z, o], G.ROT)]
    at = {"tx": F.col("frame") % 7 - 3, "ty": F.col("frame") % 5 - 2, "tz": F.col("frame") % 3, "l_tx": F.col("frame") % 4, "l_ty": F.lit(1), "l_tz": F.col("frame") % 2}
    return f.select("frame", *out, *[(x / 8.0).alias(n) for n, x in at.items()])


@query("gathered_cells", "W06", f"""WITH {CLAIMS}, f AS (SELECT frame, {", ".join(f"{x} AS {n}" for n, x in TURNS.items())}, (frame % 7 - 3) / 8e0 AS tx, (frame % 5 - 2) / 8e0 AS ty,
  (frame % 3) / 8e0 AS tz, (frame % 4) / 8e0 AS lx, 1 / 8e0 AS ly, (frame % 2) / 8e0 AS lz FROM fx_frames),
w AS (SELECT CAST(i // 160 AS INT) AS ix, CAST(i // 10 % 16 AS INT) AS iy, CAST(i % 10 AS INT) AS iz FROM range(2560) r(i)),
d AS (SELECT f.*, ix, iy, iz, -2e0 + (ix + 0.5e0) * 0.25e0 - tx AS dx, -2e0 + (iy + 0.5e0) * 0.25e0 - ty AS dy, -0.5e0 + (iz + 0.5e0) * 0.25e0 - tz AS dz FROM f CROSS JOIN w),
cam AS (SELECT *, c * dx + s * dy AS cx, -s * dx + c * dy AS cy FROM d),
l AS (SELECT frame, ix, iy, iz, FLOOR((lc * cx - ls * cy + lx + 2) / 0.25e0)::INT AS jx, FLOOR((ls * cx + lc * cy + ly + 2) / 0.25e0)::INT AS jy, FLOOR((dz + lz + 0.5e0) / 0.25e0)::INT AS jz FROM cam)
SELECT l.frame, l.ix, l.iy, l.iz, cls FROM l JOIN claims q ON q.frame = l.frame AND q.ix = jx AND q.iy = jy AND q.iz = jz""")
def gathered_cells(t):
    """Every world cell that takes a class, under poses without rounding: ownership at borders included."""
    return E.gather_prediction(claims(t), turned_frames(t), DYADIC, DYADIC)


CL = f"""cl AS (SELECT {VOX}, cls, frame FROM fx_claims),
vs AS (SELECT {VOX}, cls, COUNT(*) AS n FROM cl WHERE cls > 0 GROUP BY ALL),
best AS (SELECT {VOX}, cls, ROW_NUMBER() OVER (PARTITION BY {VOX} ORDER BY n DESC, cls) AS rk, SUM(n) OVER (PARTITION BY {VOX}) AS total FROM vs),
sn AS (SELECT {VOX}, COUNT(DISTINCT frame) AS n_seen, MIN(CASE WHEN cls > 0 THEN frame END) AS first_pred FROM cl GROUP BY ALL),
p AS (SELECT sn.*, COALESCE(n_seen >= 3 AND total > 0.6 * n_seen, FALSE) AS predicted, COALESCE(CASE WHEN n_seen >= 3 AND total > 0.6 * n_seen THEN cls END, 0) AS cls
  FROM sn LEFT JOIN best b ON sn.room = b.room AND sn.ix = b.ix AND sn.iy = b.iy AND sn.iz = b.iz AND rk = 1)"""


@query("predicted_voxels", "W07 W09", f"WITH {CL} SELECT {VOX}, n_seen, first_pred, predicted, cls FROM p")
def predicted_voxels(t):
    return E.with_class(E.vote_counts(t.fx_claims))


WORLD = EV + f""", {CL}, w AS (SELECT COALESCE(e.room, p.room) AS room, COALESCE(e.ix, p.ix) AS ix, COALESCE(e.iy, p.iy) AS iy, COALESCE(e.iz, p.iz) AS iz,
  COALESCE(n_hit, 0) AS n_hit, COALESCE(n_pass, 0) AS n_pass, COALESCE(predicted, FALSE) AS predicted, COALESCE(cls, 0) AS cls, first_touch, first_pred,
  first_pred IS NOT NULL AND COALESCE(first_touch > first_pred, TRUE) AS blind
  FROM e FULL OUTER JOIN p ON e.room = p.room AND e.ix = p.ix AND e.iy = p.iy AND e.iz = p.iz),
s AS (SELECT *, CASE WHEN n_hit >= 2 THEN 2 WHEN n_pass >= 2 THEN 1 ELSE 0 END AS st FROM w),
v AS (SELECT *, st = 2 AS measured, predicted AND blind AND st = 2 AS confirmed, predicted AND blind AND st = 1 AS contradicted,
  predicted AND blind AND st = 0 AS untested, st = 2 AND NOT predicted AS missed, predicted AND st = 1 AS in_free FROM s),
dp AS (SELECT *, in_free AND NOT EXISTS (SELECT 1 FROM v m WHERE m.measured AND m.room = v.room AND ABS(m.ix - v.ix) + ABS(m.iy - v.iy) + ABS(m.iz - v.iz) <= 1) AS disproved FROM v)"""


def world(t):
    return E.verdicts(E.world_map(t.fx_evidence, t.fx_claims))


@query("voxel_verdicts", "W08 W10 J03", WORLD + f" SELECT {VOX}, n_hit, n_pass, predicted, cls, blind, measured, confirmed, contradicted, untested, missed, in_free FROM v")
def voxel_verdicts(t):
    return world(t).select("room", "ix", "iy", "iz", "n_hit", "n_pass", "predicted", "cls", "blind", *[c for c in E.VERDICTS if c != "predicted"])


@query("verdict_counts", "W10 W11 W12", WORLD + """
SELECT room, SUM(measured::INT)::BIGINT AS measured, SUM(predicted::INT)::BIGINT AS predicted, SUM(confirmed::INT)::BIGINT AS confirmed,
  SUM(contradicted::INT)::BIGINT AS contradicted, SUM(untested::INT)::BIGINT AS untested, SUM(missed::INT)::BIGINT AS missed,
  SUM(in_free::INT)::BIGINT AS in_free, SUM(disproved::INT)::BIGINT AS disproved,
  ROUND(100.0 * SUM(confirmed::INT) / NULLIF(SUM(confirmed::INT) + SUM(contradicted::INT), 0), 9) AS proved_pct FROM dp GROUP BY room""")
def verdict_counts(t):
    return E.verdict_counts(E.with_disproved(world(t)), "room").withColumn("proved_pct", F.round("proved_pct", 9))


@query("verdict_identity", "W10", WORLD + f" SELECT {VOX} FROM v WHERE (confirmed::INT + contradicted::INT + untested::INT) <> (predicted AND blind)::INT")
def verdict_identity(t):
    return E.verdict_identity(world(t))


@query("map_agreement", "W13", WORLD + f""", m AS (SELECT {VOX} FROM v WHERE measured),
d AS (SELECT m.*, (SELECT MIN(ABS(o.ix - m.ix) + ABS(o.iy - m.iy) + ABS(o.iz - m.iz)) FROM fx_occupied o WHERE o.room = m.room) AS r FROM m)
SELECT CAST(q.k AS INT) AS within, COUNT(*) AS n, SUM(COALESCE(r <= q.k, FALSE)::INT)::BIGINT AS hits, ROUND(SUM(COALESCE(r <= q.k, FALSE)::INT) * 1.0 / COUNT(*), 9) AS share
FROM d CROSS JOIN (SELECT UNNEST([0, 1, 2]) AS k) q GROUP BY q.k""")
def map_agreement(t):
    return E.agreement_within(world(t).filter("measured"), t.fx_occupied, 2, ["room"]).filter("n > 0").withColumn("share", F.round("share", 9))


@query("carved_claims", "W14", """
SELECT frame, COUNT(*) AS n, SUM((tsdf > 0 AND pred > 0)::INT)::BIGINT AS carved, SUM((tsdf <= 0 AND pred > 0)::INT)::BIGINT AS kept FROM fx_voxels GROUP BY frame""")
def carved_claims(t):
    v = t.fx_voxels.withColumn("was", F.col("pred"))
    c = E.carve_free(v)
    return c.groupBy("frame").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("was") > 0) & (F.col("pred") == 0)).alias("carved"),
                                  F.count_if(F.col("pred") > 0).alias("kept"))


@query("visibility_masks", "W15", """
WITH q AS (SELECT frame, tsdf, CASE WHEN frame % 4 = 0 THEN NULL ELSE label_weight END AS lw, (tsdf <> 0)::INT AS ob FROM fx_voxels)
SELECT frame, SUM((COALESCE(lw, 0) > 0)::INT)::BIGINT AS label_weight, SUM((tsdf < -0.5)::INT)::BIGINT AS occluded,
  SUM((tsdf < -0.5 OR (ob > 0 AND ABS(tsdf) < 0.25))::INT)::BIGINT AS surface, SUM(ob)::BIGINT AS frustum,
  SUM(COALESCE(lw > 0, tsdf < -0.5 OR (ob > 0 AND ABS(tsdf) < 0.25))::INT)::BIGINT AS auto FROM q GROUP BY frame""")
def visibility_masks(t):
    v = t.fx_voxels.withColumns({"observed": (F.col("tsdf") != 0).cast("int"),
                                 "label_weight": F.when(F.col("frame") % 4 != 0, F.col("label_weight"))})
    return v.groupBy("frame").agg(*[F.count_if(E.visibility_mask(m)).alias(m) for m in ("label_weight", "occluded", "surface", "frustum", "auto")])


@query("fill_hidden", "W18", f"""
WITH o AS (SELECT *, ((room * 12 + ix) * 11 + iy) * 9 + iz AS id, (ix + 2 * iy + 3 * iz) % 4 = 0 AS seen, ix * 20 AS r, iy * 20 AS g, iz * 20 AS b FROM fx_occupied),
n AS (SELECT h.id, s.id AS ref, POW(h.ix - s.ix, 2) + POW(h.iy - s.iy, 2) + POW(h.iz - s.iz, 2) AS d2, s.r AS nr, s.g AS ng, s.b AS nb,
  ROW_NUMBER() OVER (PARTITION BY h.id ORDER BY POW(h.ix - s.ix, 2) + POW(h.iy - s.iy, 2) + POW(h.iz - s.iz, 2), s.id) AS rk
  FROM o h JOIN o s ON h.room = s.room AND h.cls = s.cls AND NOT h.seen AND s.seen)
SELECT o.id, o.room, o.cls, NOT seen AND n.id IS NOT NULL AS borrowed, n.d2, CASE WHEN seen THEN o.r ELSE COALESCE(nr, -1) END AS r,
  CASE WHEN seen THEN o.g ELSE COALESCE(ng, -1) END AS g, CASE WHEN seen THEN o.b ELSE COALESCE(nb, -1) END AS b
FROM o LEFT JOIN n ON o.id = n.id AND rk = 1""")
def fill_hidden(t):
    o = t.fx_occupied.select("*", (((F.col("room") * 12 + F.col("ix")) * 11 + F.col("iy")) * 9 + F.col("iz")).alias("id"),
                             ((F.col("ix") + 2 * F.col("iy") + 3 * F.col("iz")) % 4 == 0).alias("seen"),
                             *[(F.col(n) * 20).alias(c) for n, c in zip(("ix", "iy", "iz"), "rgb")])
    f = E.fill_hidden(o, ["room"])
    lost = ~F.col("borrowed") & F.col("d2").isNull() & ((F.col("r") % 20 != 0) | (F.col("g") % 20 != 0) | (F.col("b") % 20 != 0))
    return f.select("id", "room", "cls", "borrowed", "d2", *[F.when(lost, -1).otherwise(F.col(c)).alias(c) for c in "rgb"])


@query("describe_classes", "W19", """
SELECT room, cls, COUNT(*) AS n, MIN(ix) AS lo_ix, MAX(ix) AS hi_ix, MIN(iy) AS lo_iy, MAX(iy) AS hi_iy, MIN(iz) AS lo_iz, MAX(iz) AS hi_iz,
  ROUND(100.0 * COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY room), 9) AS share FROM fx_occupied GROUP BY room, cls""")
def describe_classes(t):
    return E.describe_classes(t.fx_occupied, "room").withColumn("share", F.round("share", 9))


@query("draw_set", "W20", WORLD + f""", r AS (SELECT {VOX} FROM v WHERE measured OR (predicted AND NOT in_free))
SELECT COALESCE(r.room, o.room) AS room, COALESCE(r.ix, o.ix) AS ix, COALESCE(r.iy, o.iy) AS iy, COALESCE(r.iz, o.iz) AS iz,
  r.room IS NOT NULL AS drawn_by_room, o.room IS NOT NULL AS covered, r.room IS NULL AS sensor_only
FROM r FULL OUTER JOIN fx_occupied o ON r.room = o.room AND r.ix = o.ix AND r.iy = o.iy AND r.iz = o.iz""")
def draw_set(t):
    return E.draw_set(world(t), t.fx_occupied)
