"""Queries over camera, grid and depth arithmetic."""

from pyspark.sql import functions as F

from voxmill.catalog.registry import query
from voxmill.functions import geometry as G
from voxmill.operators import voxelize as V

WORLD = ", ".join(f"r{i}0*((u-cx)*z/fx) + r{i}1*((v-cy)*z/fy) + r{i}2*z + {t} AS w{a}"
                  for i, (t, a) in enumerate(zip(("tx", "ty", "tz"), "xyz")))
PTS = f"""pts AS (SELECT d.frame, u, v, z, depth_mm, r, g, b, tx, ty, tz, scene, {WORLD}
  FROM (SELECT *, depth_mm / 1000e0 AS z FROM fx_depth WHERE depth_mm > 0) d JOIN fx_frames f ON d.frame = f.frame)"""


def r9(df, *keep):
    return df.select(*keep, *[F.round(c, 9).alias(c) for c in df.columns if c not in keep])


@query("depth_codec", "G01", """
WITH d AS (SELECT frame, depth_mm AS mm, ((depth_mm << 3) | (depth_mm >> 13)) & 65535 AS raw,
  CASE WHEN depth_mm = 0 THEN 'nan'::DOUBLE WHEN u = 0 THEN 'inf'::DOUBLE ELSE depth_mm / 40e0 END AS m FROM fx_depth)
SELECT frame, SUM(raw)::BIGINT AS raw_sum, SUM((((raw << 13) | (raw >> 3)) & 65535))::BIGINT AS mm_sum,
  SUM(CASE WHEN isfinite(m) AND ROUND_EVEN(m * 1000, 0) <= 65535 THEN ROUND_EVEN(m * 1000, 0) ELSE 0 END)::BIGINT AS clamped_sum,
  SUM(CASE WHEN isfinite(m) AND ROUND_EVEN(m * 1000, 0) <= 30000 THEN ROUND_EVEN(m * 1000, 0) ELSE 0 END)::BIGINT AS near_sum
FROM d GROUP BY frame""")
def depth_codec(t):
    mm = F.col("depth_mm")
    m = F.when(mm == 0, float("nan")).when(F.col("u") == 0, float("inf")).otherwise(mm / 40.0)
    raw = G.encode_depth(mm)
    return t.fx_depth.groupBy("frame").agg(
        F.sum(raw).alias("raw_sum"), F.sum(G.decode_depth(raw)).alias("mm_sum"),
        F.sum(G.metres_to_mm(m)).alias("clamped_sum"), F.sum(G.metres_to_mm(m, 30.0)).alias("near_sum"))


@query("world_points", "G02 J01", f"""WITH {PTS}
SELECT frame, COUNT(*) AS n, ROUND(MIN(wx), 9) AS min_x, ROUND(MAX(wx), 9) AS max_x, ROUND(MIN(wy), 9) AS min_y,
  ROUND(MAX(wy), 9) AS max_y, ROUND(MIN(wz), 9) AS min_z, ROUND(MAX(wz), 9) AS max_z, ROUND(AVG(wz), 9) AS mean_z FROM pts GROUP BY frame""")
def world_points(t):
    p = V.world_points(t.fx_depth, t.fx_frames)
    return r9(p.groupBy("frame").agg(
        F.count(F.lit(1)).alias("n"), *[f(f"w{a}").alias(f"{k}_{a}") for a in "xyz" for k, f in (("min", F.min), ("max", F.max))],
        F.avg("wz").alias("mean_z")), "frame", "n")


@query("grid_conventions", "G03 G04", """
SELECT id, CAST(FLOOR((x + 2.4) / 0.08e0) AS INT) AS ix, CAST(FLOOR((y + 2.4) / 0.08e0) AS INT) AS iy,
  CAST(FLOOR((z + 0.05) / 0.08e0) AS INT) AS iz,
  (CAST(FLOOR((x + 2.4) / 0.08e0) AS INT) * 36 + CAST(FLOOR((z + 0.05) / 0.08e0) AS INT)) * 60 + CAST(FLOOR((y + 2.4) / 0.08e0) AS INT) AS flat,
  ROUND(-2.4e0 + (FLOOR((x + 2.4) / 0.08e0) + 0.5) * 0.08e0, 9) AS centre_x, ROUND(-2.4e0 + FLOOR((x + 2.4) / 0.08e0) * 0.08e0, 9) AS corner_x,
  ROUND((x + 2.4) / 0.08e0 - 0.5, 9) AS view_x,
  FLOOR((x + 2.4) / 0.08e0) BETWEEN 0 AND 59 AND FLOOR((y + 2.4) / 0.08e0) BETWEEN 0 AND 59 AND FLOOR((z + 0.05) / 0.08e0) BETWEEN 0 AND 35 AS inside
FROM fx_points""")
def grid_conventions(t):
    g = G.LOW
    p = t.fx_points
    i = g.index(F.col("x"), F.col("y"), F.col("z"))
    p = p.select("id", "x", "y", "z", *[c.alias(n) for c, n in zip(i, V.CELL)])
    c = [F.col(n) for n in V.CELL]
    return p.select("id", *V.CELL, g.flat(*c).alias("flat"), F.round(g.centre(*c)[0], 9).alias("centre_x"),
                    F.round(g.corner(*c)[0], 9).alias("corner_x"),
                    F.round(g.fractional(F.col("x"), F.col("y"), F.col("z"))[0], 9).alias("view_x"), g.inside(*c).alias("inside"))


CAM = ", ".join(f"dx*r0{j} + dy*r1{j} + dz*r2{j} AS c{j}" for j in range(3))
FRUSTUM = f"""WITH q AS (SELECT v.frame, label, gz, gy, gx, -2.4e0 + (gz + 0.5) * 0.08e0 - tx AS dx, -2.4e0 + (gx + 0.5) * 0.08e0 - ty AS dy,
  -0.05e0 + (gy + 0.5) * 0.08e0 - tz AS dz, f.* EXCLUDE (frame) FROM fx_voxels v JOIN fx_frames f ON v.frame = f.frame),
c AS (SELECT *, {CAM} FROM q),
p AS (SELECT *, CASE WHEN c2 > 1e-6 THEN fx * c0 / c2 + cx END AS u, CASE WHEN c2 > 1e-6 THEN fy * c1 / c2 + cy END AS w FROM c)
"""


@query("frustum_labels", "G05 V11", FRUSTUM + """
SELECT frame, SUM(COALESCE(u >= 0 AND u < 64 AND w >= 0 AND w < 48, FALSE)::INT)::BIGINT AS in_view,
  SUM((CASE WHEN COALESCE(u >= 0 AND u < 64 AND w >= 0 AND w < 48, FALSE) THEN label ELSE 255 END = 255)::INT)::BIGINT AS ignored FROM p GROUP BY frame""")
def frustum_labels(t):
    v = V.frustum_labels(t.fx_voxels, t.fx_frames, G.LOW, 64, 48)
    return v.groupBy("frame").agg(F.count_if("in_view").alias("in_view"), F.count_if(F.col("label_fov") == 255).alias("ignored"))


@query("rigid_algebra", "G06", """
WITH a AS (SELECT f.*, g.r00 AS s00, g.r01 AS s01, g.r02 AS s02, g.r10 AS s10, g.r11 AS s11, g.r12 AS s12, g.r20 AS s20, g.r21 AS s21,
  g.r22 AS s22, g.tx AS sx, g.ty AS sy, g.tz AS sz FROM fx_frames f JOIN fx_frames g ON g.frame = f.frame + 1),
b AS (SELECT *, r00*s00 + r10*s10 + r20*s20 AS d0, r01*s01 + r11*s11 + r21*s21 AS d1, r02*s02 + r12*s12 + r22*s22 AS d2,
  sqrt((sx-tx)*(sx-tx) + (sy-ty)*(sy-ty) + (sz-tz)*(sz-tz)) AS step,
  degrees(atan2(r12, r02)) AS az FROM a),
c AS (SELECT *, az - 90 * floor(az / 90) AS m FROM b)
SELECT frame, ROUND(degrees(acos(LEAST(1, GREATEST(-1, (d0 + d1 + d2 - 1) / 2)))), 5) AS turn_deg, ROUND(step, 6) AS step_m,
  ROUND(degrees(acos(LEAST(1, cp))), 5) AS tilt, ROUND(degrees(asin(r22)), 6) AS pitch_axis,
  ROUND(CASE WHEN sqrt(r02*r02 + r12*r12) >= 0.3 THEN LEAST(m, 90 - m) END, 5) AS heading_axis
FROM (SELECT *, -r21 / sqrt(r20*r20 + r21*r21 + r22*r22) AS cp FROM c) q""")
def rigid_algebra(t):
    f = t.fx_frames
    nxt = f.select((F.col("frame") - 1).alias("frame"), *[F.col(c).alias("n_" + c) for c in G.POSE])
    j = f.join(nxt, "frame")
    rel = G.compose(G.inverse(G.pose()), G.pose("n_"))
    return j.select("frame", F.round(G.rotation_deg(rel), 5).alias("turn_deg"),
                    F.round(G.norm3(rel["tx"], rel["ty"], rel["tz"]), 6).alias("step_m"),
                    F.round(G.tilt_deg(G.pose()), 5).alias("tilt"), F.round(G.pitch_deg(G.pose()), 6).alias("pitch_axis"),
                    F.round(G.heading_deg(G.pose()), 5).alias("heading_axis"))


@query("live_pose", "G07", """
WITH a AS (SELECT frame, tz, r20 AS a0, r21 AS a1, r22 AS a2, frame % 5 / 10e0 AS yaw,
  sqrt(r20*r20 + r21*r21 + r22*r22) AS n FROM fx_frames),
b AS (SELECT frame, tz, yaw, a0/n AS u0, a1/n AS u1, a2/n AS u2 FROM a),
e AS (SELECT *, -u2*u0 AS y0, -u2*u1 AS y1, 1 - u2*u2 AS y2 FROM b),
s AS (SELECT *, sqrt(y0*y0 + y1*y1 + y2*y2) < 1e-6 AS steep FROM e),
y AS (SELECT *, CASE WHEN steep THEN u1*u0 ELSE y0 END AS e0, CASE WHEN steep THEN -1 + u1*u1 ELSE y1 END AS e1,
  CASE WHEN steep THEN u1*u2 ELSE y2 END AS e2 FROM s),
z AS (SELECT *, e0/sqrt(e0*e0+e1*e1+e2*e2) AS f0, e1/sqrt(e0*e0+e1*e1+e2*e2) AS f1, e2/sqrt(e0*e0+e1*e1+e2*e2) AS f2 FROM y),
x AS (SELECT *, f1*u2 - f2*u1 AS g0, f2*u0 - f0*u2 AS g1, f0*u1 - f1*u0 AS g2 FROM z)
SELECT frame, ROUND(cos(yaw)*g0 - sin(yaw)*f0, 9) + 0 AS r00, ROUND(cos(yaw)*g1 - sin(yaw)*f1, 9) + 0 AS r01, ROUND(cos(yaw)*g2 - sin(yaw)*f2, 9) + 0 AS r02,
  ROUND(sin(yaw)*g0 + cos(yaw)*f0, 9) + 0 AS r10, ROUND(sin(yaw)*g1 + cos(yaw)*f1, 9) + 0 AS r11, ROUND(sin(yaw)*g2 + cos(yaw)*f2, 9) + 0 AS r12,
  ROUND(u0, 9) + 0 AS r20, ROUND(u1, 9) + 0 AS r21, ROUND(u2, 9) + 0 AS r22, tz FROM x""")
def live_pose(t):
    f = t.fx_frames
    p = G.live_pose(F.col("tz"), (F.col("frame") % 5) / 10.0, F.col("r20"), F.col("r21"), F.col("r22"))
    return f.select("frame", *[(F.round(p[c], 9) + 0.0).alias(c) for c in G.ROT], p["tz"].alias("tz"))


@query("moved_solids", "G08", """
SELECT s.room, seq, cls, shape, ROUND(r00*s.cx + r01*s.cy + r02*s.cz + tx, 6) + 0 AS cx, ROUND(r10*s.cx + r11*s.cy + r12*s.cz + ty, 6) + 0 AS cy,
  ROUND(r20*s.cx + r21*s.cy + r22*s.cz + tz, 6) + 0 AS cz, ROUND(r00*c + r01*s.s, 6) + 0 AS r00, ROUND(-r00*s.s + r01*c, 6) + 0 AS r01, ROUND(r02, 6) + 0 AS r02,
  ROUND(r20*c + r21*s.s, 6) + 0 AS r20, ROUND(r22, 6) + 0 AS r22
FROM fx_solids s JOIN fx_frames f ON f.frame = s.room""")
def moved_solids(t):
    s = t.fx_solids
    s = s.select("room", "seq", "cls", "shape", "cx", "cy", "cz", *V.yaw_rotation(F.col("c"), F.col("s")))
    m = V.move_solids(s, t.fx_frames.withColumnRenamed("frame", "room"))
    return m.select("room", "seq", "cls", "shape", *[(F.round(c, 6) + 0.0).alias(c) for c in ("cx", "cy", "cz", "r00", "r01", "r02", "r20", "r22")])


@query("depth_curve", "G12", """
WITH c AS (SELECT frame, depth_mm, COUNT(*) AS n FROM fx_depth WHERE depth_mm > 0 GROUP BY ALL)
SELECT frame, depth_mm, n, CAST(SUM(n) OVER (PARTITION BY frame ORDER BY depth_mm) AS BIGINT) AS cum,
  CAST(SUM(n) OVER (PARTITION BY frame) AS BIGINT) AS total FROM c""")
def depth_curve(t):
    return V.depth_curve(t.fx_depth, ["frame"])


@query("sequence_depth_at", "G12", """
WITH c AS (SELECT scene, depth_mm, COUNT(*) AS n FROM fx_depth d JOIN fx_frames f ON d.frame = f.frame WHERE depth_mm > 0 GROUP BY ALL),
k AS (SELECT scene, depth_mm, SUM(n) OVER (PARTITION BY scene ORDER BY depth_mm) AS cum, SUM(n) OVER (PARTITION BY scene) AS total FROM c)
SELECT scene, f, COALESCE(MIN(CASE WHEN cum > f * total THEN depth_mm END), MAX(depth_mm)) / 1000e0 AS metres
FROM k CROSS JOIN (SELECT UNNEST([0e0, 0.25e0, 0.5e0, 0.9e0, 1e0]) AS f) q GROUP BY scene, f""")
def sequence_depth_at(t):
    d = t.fx_depth.join(t.fx_frames.select("frame", "scene"), "frame")
    return V.depth_at(V.depth_curve(d, ["scene"]), ["scene"], [0.0, 0.25, 0.5, 0.9, 1.0])
