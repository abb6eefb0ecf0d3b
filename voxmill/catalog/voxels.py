"""Queries over voxelisation, truncated distance, solids and per-frame statistics."""

from pyspark.sql import functions as F

from voxmill.catalog.geometry import PTS, r9
from voxmill.catalog.registry import query
from voxmill.functions import geometry as G
from voxmill.functions.geometry import Grid
from voxmill.operators import voxelize as V

W, H = 64, 48
COARSE = Grid(-2.56, -2.56, -0.16, 0.16, 32, 32, 20)
SMALL = Grid(-2.4, -2.4, 0.0, 0.24, 20, 20, 12)
LATTICE = Grid(0.0, 0.0, 0.0, 1.0, 40, 40, 24)


def idx(g, names=("wx", "wy", "wz")):
    o = dict(zip(names, g.origin))
    return ", ".join(f"CAST(FLOOR(({n} - ({o[n]}e0)) / {g.unit}e0) AS INT) AS {c}" for n, c in zip(names, ("ix", "iy", "iz")))


def inside(g):
    return f"ix BETWEEN 0 AND {g.nx - 1} AND iy BETWEEN 0 AND {g.ny - 1} AND iz BETWEEN 0 AND {g.nz - 1}"


def cells(g, src="pts"):
    return f"cells AS (SELECT * FROM (SELECT *, {idx(g)} FROM {src}) q WHERE {inside(g)})"


MAP = f"map AS (SELECT frame, (ix * 36 + iz) * 60 + iy AS flat, CAST(MAX(v * 64 + u) AS INT) AS pixel_id FROM cells GROUP BY ALL)"


@query("voxel_to_pixel", "V01", f"WITH {PTS}, {cells(G.LOW)}, {MAP} SELECT frame, flat, pixel_id FROM map")
def voxel_to_pixel(t):
    return V.voxel_to_pixel(t.fx_depth, t.fx_frames, G.LOW, W, drop_invalid=True)


@query("voxel_to_pixel_all_depths", "V01", f"""WITH {PTS.replace('WHERE depth_mm > 0', '')}, {cells(G.LOW)}, {MAP}
SELECT frame, COUNT(*) AS voxels, SUM(pixel_id)::BIGINT AS ids FROM map GROUP BY frame""")
def voxel_to_pixel_all_depths(t):
    m = V.voxel_to_pixel(t.fx_depth, t.fx_frames, G.LOW, W, drop_invalid=False)
    return m.groupBy("frame").agg(F.count(F.lit(1)).alias("voxels"), F.sum("pixel_id").alias("ids"))


@query("pixel_to_voxel", "V02", f"WITH {PTS}, {cells(G.LOW)}, {MAP} SELECT frame, pixel_id, flat FROM map")
def pixel_to_voxel(t):
    return V.pixel_to_voxel(V.voxel_to_pixel(t.fx_depth, t.fx_frames, G.LOW, W, drop_invalid=True))


@query("two_camera_map", "V03", f"""WITH {PTS}, {cells(G.LOW)}, {MAP},
d AS (SELECT d.frame, v * 64 + u AS pixel_id, (u - cx) * (depth_mm / 1000e0) / fx + 0.059e0 AS x, (v - cy) * (depth_mm / 1000e0) / fy + 0e0 AS y,
  depth_mm / 1000e0 + 0e0 AS z FROM fx_depth d JOIN fx_frames f ON d.frame = f.frame WHERE depth_mm > 0),
p AS (SELECT frame, pixel_id, z, ROUND_EVEN(60e0 * x / z + 32e0, 0) AS cu, ROUND_EVEN(60e0 * y / z + 24e0, 0) AS cv FROM d),
k AS (SELECT p.frame, CAST(cv * 64 + cu AS INT) AS colour_pixel, flat,
  ROW_NUMBER() OVER (PARTITION BY p.frame, cv * 64 + cu ORDER BY z, p.pixel_id DESC) AS rk
  FROM p JOIN map m ON m.frame = p.frame AND m.pixel_id = p.pixel_id WHERE cu >= 0 AND cu < 64 AND cv >= 0 AND cv < 48)
SELECT frame, colour_pixel, flat FROM k WHERE rk = 1""")
def two_camera_map(t):
    m = V.voxel_to_pixel(t.fx_depth, t.fx_frames, G.LOW, W, drop_invalid=True)
    return V.two_camera_map(t.fx_depth, t.fx_frames, m, (0.059, 0.0, 0.0), dict(fx=60.0, fy=60.0, cx=32.0, cy=24.0), W, H)


@query("surface_cells", "V04", f"WITH {PTS}, {cells(G.LOW)} SELECT DISTINCT frame, ix, iy, iz FROM cells")
def surface_cells(t):
    return V.surface_cells(t.fx_depth, t.fx_frames, G.LOW)


def sight_sql(g):
    d = [f"{a}0 - {t}" for a, t in zip("xyz", ("tx", "ty", "tz"))]
    cam = ", ".join(f"({d[0]})*r0{j} + ({d[1]})*r1{j} + ({d[2]})*r2{j} AS c{j}" for j in range(3))
    return f"""vox AS (SELECT ix, iy, iz, {g.ox}e0 + ix * {g.unit}e0 AS x0, {g.oy}e0 + iy * {g.unit}e0 AS y0, {g.oz}e0 + iz * {g.unit}e0 AS z0
  FROM (SELECT CAST(UNNEST(range({g.nx})) AS INT) AS ix) a, (SELECT CAST(UNNEST(range({g.ny})) AS INT) AS iy) b, (SELECT CAST(UNNEST(range({g.nz})) AS INT) AS iz) c),
cam AS (SELECT frame, ix, iy, iz, fx, fy, cx, cy, {cam} FROM fx_frames CROSS JOIN vox),
pix AS (SELECT *, CAST(ROUND_EVEN(fx * c0 / c2 + cx, 0) AS BIGINT) AS u, CAST(ROUND_EVEN(fy * c1 / c2 + cy, 0) AS BIGINT) AS v FROM cam WHERE c2 > 1e-6
  AND fx * c0 / c2 + cx BETWEEN -5 AND 70 AND fy * c1 / c2 + cy BETWEEN -5 AND 60),
sight AS (SELECT pix.frame, ix, iy, iz, CASE WHEN ABS(depth_mm / 1000e0 - c2) < 1e-4 THEN 1e0 ELSE SIGN(depth_mm / 1000e0 - c2)::DOUBLE END AS sign
  FROM pix JOIN fx_depth d ON d.frame = pix.frame AND d.u = pix.u AND d.v = pix.v WHERE depth_mm BETWEEN 500 AND 8000)"""


@query("sight_test", "V05 J07", f"WITH {sight_sql(COARSE)} SELECT frame, sign, COUNT(*) AS n, SUM((ix * 32 + iy) * 20 + iz)::BIGINT AS keys FROM sight GROUP BY ALL")
def sight_test(t):
    s = V.sight_test(t.fx_depth, t.fx_frames, COARSE, W, H)
    key = (F.col("ix") * 32 + F.col("iy")) * 20 + F.col("iz")
    return s.groupBy("frame", "sign").agg(F.count(F.lit(1)).alias("n"), F.sum(key).alias("keys"))


def dist_sql(g, cap):
    return f"""surf AS (SELECT DISTINCT frame, ix, iy, iz FROM cells),
lattice AS (SELECT CAST(i // {g.ny * g.nz} AS INT) AS x, CAST(i // {g.nz} % {g.ny} AS INT) AS y, CAST(i % {g.nz} AS INT) AS z FROM range({g.nx * g.ny * g.nz}) r(i)),
dist AS (SELECT frame, x AS ix, y AS iy, z AS iz, MIN((x - ix) * (x - ix) + (y - iy) * (y - iy) + (z - iz) * (z - iz)) AS d2
  FROM surf JOIN lattice ON x BETWEEN ix - {cap} AND ix + {cap} GROUP BY ALL HAVING MIN((x - ix) * (x - ix) + (y - iy) * (y - iy) + (z - iz) * (z - iz)) < {cap * cap})"""


CAP = 12


@query("surface_distance", "V06", f"WITH {PTS}, {cells(SMALL)}, {dist_sql(SMALL, CAP)} SELECT frame, CAST(d2 AS INT) AS d2, COUNT(*) AS n, SUM((ix * 20 + iy) * 12 + iz)::BIGINT AS keys FROM dist GROUP BY ALL")
def surface_distance(t):
    d = V.squared_distance(V.surface_cells(t.fx_depth, t.fx_frames, SMALL), SMALL, CAP, ["frame"])
    key = (F.col("ix") * 20 + F.col("iy")) * 12 + F.col("iz")
    return d.groupBy("frame", "d2").agg(F.count(F.lit(1)).alias("n"), F.sum(key).alias("keys"))


def _tsdf(t):
    sight = V.sight_test(t.fx_depth, t.fx_frames, SMALL, W, H)
    dist = V.squared_distance(V.surface_cells(t.fx_depth, t.fx_frames, SMALL), SMALL, CAP, ["frame"])
    return V.truncated_distance(sight, dist, CAP)


@query("tsdf_blocks", "V07 V08", f"""WITH {PTS}, {cells(SMALL)}, {dist_sql(SMALL, CAP)}, {sight_sql(SMALL)},
q AS (SELECT s.frame, s.ix, s.iy, s.iz, sign, LEAST(SQRT(CAST(COALESCE(d2, {CAP * CAP}) AS DOUBLE)) / {CAP}, 1e0) AS r FROM sight s
  LEFT JOIN dist d ON d.frame = s.frame AND d.ix = s.ix AND d.iy = s.iy AND d.iz = s.iz),
f AS (SELECT *, CASE WHEN r < ABS(sign) THEN r * sign ELSE sign END AS tsdf FROM q)
SELECT frame, ix // 4 AS ix, iy // 4 AS iy, iz // 4 AS iz, ROUND(SUM(tsdf) / 64, 9) + 0 AS tsdf, CAST(COUNT(*) / 64.0 >= 0.5 AS INT) AS weight
FROM f GROUP BY frame, ix // 4, iy // 4, iz // 4""")
def tsdf_blocks(t):
    return V.block_mean(_tsdf(t)).withColumn("tsdf", F.round("tsdf", 9) + 0.0)


def solids(t):
    return t.fx_solids.select("room", "seq", "cls", "shape", "cx", "cy", "cz", "sx", "sy", "sz",
                              *V.yaw_rotation(F.col("c"), F.col("s")))


def rooms(t):
    return t.fx_rooms.select("room", "cx", "cy", "cz", "sx", "sy", "sz", "thickness", "ceiling",
                             *V.yaw_rotation(F.col("c"), F.col("s")))


def paint_sql(src, name):
    lx = "((ix + 0.5e0 - cx) * c + (iy + 0.5e0 - cy) * s)"
    ly = "((ix + 0.5e0 - cx) * -s + (iy + 0.5e0 - cy) * c)"
    lz = "(iz + 0.5e0 - cz)"
    return f"""{name}_cells AS (SELECT b.*, {lx} AS lx, {ly} AS ly, {lz} AS lz FROM (
  SELECT q.*, CAST(ix AS INT) AS ix, CAST(iy AS INT) AS iy, CAST(iz AS INT) AS iz FROM (
    SELECT *, ABS(c) * sx / 2 + ABS(s) * sy / 2 AS ex, ABS(s) * sx / 2 + ABS(c) * sy / 2 AS ey FROM {src}) q,
    UNNEST(range(GREATEST(0, FLOOR(cx - ex)::INT), LEAST(39, FLOOR(cx + ex)::INT) + 1)) a(ix),
    UNNEST(range(GREATEST(0, FLOOR(cy - ey)::INT), LEAST(39, FLOOR(cy + ey)::INT) + 1)) bb(iy),
    UNNEST(range(GREATEST(0, FLOOR(cz - sz / 2)::INT), LEAST(23, FLOOR(cz + sz / 2)::INT) + 1)) cc(iz)) b),
{name} AS (SELECT room, ix, iy, iz, ARG_MAX(cls, seq) AS label FROM {name}_cells WHERE CASE shape
  WHEN 'box' THEN ABS(lx) <= sx/2 + 1e-9 AND ABS(ly) <= sy/2 + 1e-9 AND ABS(lz) <= sz/2 + 1e-9
  WHEN 'cylinder' THEN (lx/(sx/2))*(lx/(sx/2)) + (ly/(sy/2))*(ly/(sy/2)) <= 1 AND ABS(lz) <= sz/2 + 1e-9
  ELSE ABS(lx) <= sx/2 + 1e-9 AND ABS(ly) <= sy/2 + 1e-9 AND lz >= -sz/2 - 1e-9
    AND lz <= sz/2 - 2.0e0 * (sz/2) * ((lx + sx/2) / (2.0e0 * (sx/2))) + 1e-9 END GROUP BY ALL)"""


def run_sums():
    """Cells of runs, and the sum of their keys, without making them."""
    n = F.col("k1") - F.col("k0") + 1
    keys = (F.col("ix") * 40 + F.col("iy")) * 24 * n + (F.col("k0") + F.col("k1")) * n / 2
    return F.sum(n).alias("n"), F.sum(keys.cast("long")).alias("keys")


@query("painted_solids", "V12 J06 U03", f"""WITH {paint_sql('fx_solids', 'vol')}
SELECT room, label, COUNT(*) AS n, SUM((ix * 40 + iy) * 24 + iz)::BIGINT AS keys FROM vol GROUP BY ALL""")
def painted_solids(t):
    return V.painted_runs(solids(t), LATTICE).groupBy("room", "label").agg(*run_sums())


SHELL = """rm AS (SELECT room, cx, cy, CASE WHEN ceiling THEN cz ELSE (cz - sz/2 + 24) / 2 END AS cz, sx, sy,
  CASE WHEN ceiling THEN sz ELSE 24 - (cz - sz/2) END AS sz, thickness AS th, ceiling, c, s FROM fx_rooms),
allsolids AS (
  SELECT room, -7 AS seq, 0 AS cls, 'box' AS shape, cx, cy, cz, sx, sy, sz, c, s FROM rm
  UNION ALL SELECT room, -6, 2, 'box', cx, cy, cz - sz/2, sx, sy, th, c, s FROM rm
  UNION ALL SELECT room, -5, 1, 'box', cx, cy, cz + sz/2, sx, sy, th, c, s FROM rm WHERE ceiling
  UNION ALL SELECT room, -4, 3, 'box', cx - c*sx/2, cy - s*sx/2, cz, th, sy, sz, c, s FROM rm
  UNION ALL SELECT room, -3, 3, 'box', cx + c*sx/2, cy + s*sx/2, cz, th, sy, sz, c, s FROM rm
  UNION ALL SELECT room, -2, 3, 'box', cx + s*sy/2, cy - c*sy/2, cz, sx, th, sz, c, s FROM rm
  UNION ALL SELECT room, -1, 3, 'box', cx - s*sy/2, cy + c*sy/2, cz, sx, th, sz, c, s FROM rm
  UNION ALL SELECT room, seq, cls, shape, cx, cy, cz, sx, sy, sz, c, s FROM fx_solids)"""


def volume(t):
    return V.label_runs(rooms(t), solids(t), LATTICE)


@query("label_volume", "V13", f"""WITH {SHELL}, {paint_sql('allsolids', 'vol')}
SELECT room, label, COUNT(*) AS n, SUM((ix * 40 + iy) * 24 + iz)::BIGINT AS keys FROM vol GROUP BY ALL
UNION ALL SELECT room, 255, 38400 - COUNT(*), NULL FROM vol GROUP BY room""")
def label_volume(t):
    per = volume(t).groupBy("room", "label").agg(*run_sums())
    rest = per.groupBy("room").agg((40 * 40 * 24 - F.sum("n")).alias("n"))
    return per.unionByName(rest.select("room", F.lit(255).alias("label"), "n", F.lit(None).cast("long").alias("keys")))


DOWN = f"""{SHELL}, {paint_sql('allsolids', 'vol')},
bl AS (SELECT room, ix // 4 AS ix, iy // 4 AS iy, iz // 4 AS iz, label, COUNT(*) AS n FROM vol GROUP BY ALL),
tot AS (SELECT room, ix, iy, iz, SUM(n) AS listed, COALESCE(SUM(CASE WHEN label = 0 THEN n END), 0) AS n0 FROM bl GROUP BY ALL),
cand AS (SELECT room, ix, iy, iz, label, n FROM bl UNION ALL SELECT room, ix, iy, iz, 12, 64 - listed FROM tot),
pick AS (SELECT c.room, c.ix, c.iy, c.iz, c.label, ROW_NUMBER() OVER (PARTITION BY c.room, c.ix, c.iy, c.iz ORDER BY c.n DESC, c.label) AS rk
  FROM cand c JOIN tot t ON c.room = t.room AND c.ix = t.ix AND c.iy = t.iy AND c.iz = t.iz
  WHERE n0 + 64 - listed > 60.8 OR c.label BETWEEN 1 AND 11)"""


@query("downsampled_labels", "V09", f"WITH {DOWN} SELECT room, ix, iy, iz, CASE WHEN label = 12 THEN 255 ELSE label END AS label FROM pick WHERE rk = 1")
def downsampled_labels(t):
    return V.downsample_runs(volume(t), "room")


@query("scoring_weight", "V10", """
SELECT frame, SUM((label BETWEEN 1 AND 253 OR tsdf < -0.5)::INT)::BIGINT AS weighted, COUNT(*) AS n FROM fx_voxels GROUP BY frame""")
def scoring_weight(t):
    v = t.fx_voxels.withColumn("w", V.label_weight(F.col("label"), F.col("tsdf")))
    return v.groupBy("frame").agg(F.sum("w").alias("weighted"), F.count(F.lit(1)).alias("n"))


POINT_GRID = Grid(0.0, 0.0, 0.0, 0.16, 20, 25, 12)


@query("voxelised_points", "V15", f"""WITH q AS (SELECT cloud, r, g, b, {idx(POINT_GRID, ('x', 'y', 'z'))} FROM fx_points)
SELECT cloud, ix, iy, iz, COUNT(*) AS n, ROUND(AVG(r), 9) AS r, ROUND(AVG(g), 9) AS g, ROUND(AVG(b), 9) AS b FROM q WHERE {inside(POINT_GRID)} GROUP BY ALL""")
def voxelised_points(t):
    return r9(V.voxelise_points(t.fx_points, POINT_GRID, ["cloud"], ["r", "g", "b"]), "cloud", "ix", "iy", "iz", "n")


@query("voxel_downsample", "V16", """
SELECT cloud, CAST(FLOOR(x / 0.3e0) AS BIGINT) AS cx, CAST(FLOOR(y / 0.3e0) AS BIGINT) AS cy, CAST(FLOOR(z / 0.3e0) AS BIGINT) AS cz, COUNT(*) AS n,
  ROUND(AVG(x), 8) AS x, ROUND(AVG(y), 8) AS y, ROUND(AVG(z), 8) AS z FROM fx_points GROUP BY ALL""")
def voxel_downsample(t):
    d = V.voxel_downsample(t.fx_points, 0.3, ["cloud"])
    return d.select("cloud", "cx", "cy", "cz", "n", *[F.round(c, 8).alias(c) for c in "xyz"])


@query("points_in_cubes", "V17", """
WITH p AS (SELECT cloud AS room, x * 2.5e0 AS x, y * 2.5e0 AS y, z * 2.5e0 AS z, r, g, b FROM fx_points)
SELECT o.room, ix, iy, iz, radius, COUNT(*) AS n, SUM(r)::BIGINT AS r, SUM(g)::BIGINT AS g, SUM(b)::BIGINT AS b
FROM fx_occupied o JOIN p ON p.room = o.room CROSS JOIN (SELECT UNNEST([0.5e0, 0.75e0]) AS radius) q
WHERE ix >= CEIL(p.x - radius) AND ix <= FLOOR(p.x + radius) AND iy >= CEIL(p.y - radius) AND iy <= FLOOR(p.y + radius)
  AND iz >= CEIL(p.z - radius) AND iz <= FLOOR(p.z + radius) GROUP BY ALL""")
def points_in_cubes(t):
    p = t.fx_points.select(F.col("cloud").alias("room"), *[(F.col(a) * 2.5).alias(a) for a in "xyz"], "r", "g", "b")
    return V.points_in_cubes(p, t.fx_occupied, [0.5, 0.75], ["room"])


CLAIMS = """claims AS (SELECT frame, gz % 16 AS ix, gx % 16 AS iy, gy % 10 AS iz, MAX(pred) AS cls FROM fx_voxels WHERE pred > 0 GROUP BY ALL)"""
HALF = Grid(-2.56, -2.56, -0.16, 0.32, 16, 16, 10)


def claims(t):
    return (t.fx_voxels.filter("pred > 0").groupBy("frame", (F.col("gz") % 16).alias("ix"), (F.col("gx") % 16).alias("iy"), (F.col("gy") % 10).alias("iz"))
            .agg(F.max("pred").alias("cls")))


@query("cell_state", "V18", f"""WITH {PTS}, {cells(HALF)}, {CLAIMS}, m AS (SELECT frame, ix, iy, iz, AVG(z) AS measured FROM cells GROUP BY ALL)
SELECT COALESCE(m.frame, c.frame) AS frame, COALESCE(m.ix, c.ix) AS ix, COALESCE(m.iy, c.iy) AS iy, COALESCE(m.iz, c.iz) AS iz,
  ROUND(measured, 8) AS measured, c.cls AS predicted FROM m FULL OUTER JOIN claims c ON m.frame = c.frame AND m.ix = c.ix AND m.iy = c.iy AND m.iz = c.iz""")
def cell_state(t):
    return V.cell_state(t.fx_depth, t.fx_frames, claims(t), HALF).withColumn("measured", F.round("measured", 8))


@query("surface_coverage", "V19", f"""WITH {PTS}, {cells(HALF)}, {CLAIMS}, s AS (SELECT DISTINCT frame, ix, iy, iz FROM cells),
j AS (SELECT s.frame, cls, COUNT(*) AS n FROM s LEFT JOIN claims c ON s.frame = c.frame AND s.ix = c.ix AND s.iy = c.iy AND s.iz = c.iz GROUP BY ALL)
SELECT frame, cls, n, ROUND(100.0 * n / SUM(n) OVER (PARTITION BY frame), 8) AS share FROM j""")
def surface_coverage(t):
    return V.surface_coverage(V.surface_cells(t.fx_depth, t.fx_frames, HALF), claims(t)).withColumn("share", F.round("share", 8))


@query("axis_control", "V23", f"""WITH {PTS}, {cells(HALF)}, s AS (SELECT DISTINCT frame, ix, iy, iz FROM cells),
l AS (SELECT frame, gz % 16 AS ix, gx % 16 AS iy, gy % 10 AS iz, MAX(label) AS label FROM fx_voxels GROUP BY ALL),
o AS (SELECT * FROM l WHERE label <> 255)
SELECT 'right' AS axes, COUNT(*) AS n, ROUND(AVG((label > 0)::INT), 9) AS hit_rate FROM s JOIN o USING (frame, ix, iy, iz)
UNION ALL SELECT 'swapped', COUNT(*), ROUND(AVG((label > 0)::INT), 9) FROM s JOIN o ON o.frame = s.frame AND o.ix = s.iy AND o.iy = s.ix AND o.iz = s.iz""")
def axis_control(t):
    lab = (t.fx_voxels.groupBy("frame", (F.col("gz") % 16).alias("ix"), (F.col("gx") % 16).alias("iy"), (F.col("gy") % 10).alias("iz"))
           .agg(F.max("label").alias("label")))
    return V.axis_control(V.surface_cells(t.fx_depth, t.fx_frames, HALF), lab, ["frame"]).withColumn("hit_rate", F.round("hit_rate", 9))


def scene_boxes(t):
    """One oriented room box per scene."""
    return (t.fx_rooms.select(F.col("room").alias("scene"), (F.col("cx") * 0 + 0.2).alias("cx"), (F.col("cx") * 0 - 0.1).alias("cy"),
                              (F.col("cx") * 0 + 1.2).alias("cz"), (F.col("sx") * 0.2).alias("sx"), (F.col("sy") * 0.2).alias("sy"),
                              (F.col("sz") * 0.2).alias("sz"), *V.yaw_rotation(F.col("c"), F.col("s"))))


VIEW_SQL = f"""{PTS}, bx AS (SELECT room AS scene, 0.2e0 AS bcx, -0.1e0 AS bcy, 1.2e0 AS bcz, sx*0.2e0/2 AS hx, sy*0.2e0/2 AS hy, sz*0.2e0/2 AS hz, c, s FROM fx_rooms),
rays AS (SELECT p.frame, p.z, p.wz, c*(wx-bcx) + s*(wy-bcy) AS px, -s*(wx-bcx) + c*(wy-bcy) AS py, wz-bcz AS pz,
  c*(tx-bcx) + s*(ty-bcy) AS ox, -s*(tx-bcx) + c*(ty-bcy) AS oy, tz-bcz AS oz, hx, hy, hz FROM pts p JOIN bx ON p.scene = bx.scene),
lens AS (SELECT *, sqrt((px-ox)*(px-ox) + (py-oy)*(py-oy) + (pz-oz)*(pz-oz)) AS len FROM rays),
ext AS (SELECT *, GREATEST(0, LEAST(CASE WHEN px <> ox THEN GREATEST((-hx-ox)/((px-ox)/len), (hx-ox)/((px-ox)/len)) END,
  CASE WHEN py <> oy THEN GREATEST((-hy-oy)/((py-oy)/len), (hy-oy)/((py-oy)/len)) END,
  CASE WHEN pz <> oz THEN GREATEST((-hz-oz)/((pz-oz)/len), (hz-oz)/((pz-oz)/len)) END) - len) AS hidden FROM lens)"""


@query("hidden_extent", "V20", f"WITH {VIEW_SQL} SELECT frame, ROUND(AVG(hidden), 6) AS free_mean FROM ext GROUP BY frame")
def hidden_extent(t):
    v = V.viewpoint_statistics(t.fx_depth, t.fx_frames, scene_boxes(t), W * H)
    return v.select("frame", F.round("free_mean", 6).alias("free_mean"))


@query("viewpoint_statistics", "V21", f"""WITH {VIEW_SQL},
s AS (SELECT frame, COUNT(*) AS valid, AVG((z < 1.5)::INT) * 100 AS near_pct, AVG((wz < 0.12)::INT) * 100 AS floor_pct, AVG(hidden) AS free_mean FROM ext GROUP BY frame),
m AS (SELECT frame, QUANTILE_CONT(depth_mm, 0.5) AS med FROM fx_depth WHERE depth_mm > 0 GROUP BY frame)
SELECT s.frame, tz AS cam_z, ROUND(DEGREES(ACOS(LEAST(1, -r21 / sqrt(r20*r20 + r21*r21 + r22*r22)))), 5) AS tilt_deg,
  ROUND(100.0 * valid / 3072, 7) AS valid_pct, ROUND(floor_pct, 7) AS floor_pct, ROUND(med / 1000, 7) AS depth_med,
  ROUND(near_pct, 7) AS near_pct, ROUND(free_mean, 6) AS free_mean FROM s JOIN m ON s.frame = m.frame JOIN fx_frames f ON f.frame = s.frame""")
def viewpoint_statistics(t):
    v = V.viewpoint_statistics(t.fx_depth, t.fx_frames, scene_boxes(t), W * H)
    return v.select("frame", "cam_z", F.round("tilt_deg", 5).alias("tilt_deg"), *[F.round(c, 7).alias(c) for c in (
        "valid_pct", "floor_pct", "depth_med", "near_pct")], F.round("free_mean", 6).alias("free_mean"))


@query("frame_quality", "V22", """
WITH o AS (SELECT *, depth_mm > 0 AND depth_mm <= 10000 AS ok FROM fx_depth),
s AS (SELECT frame, SUM(ok::INT)::BIGINT AS n, COALESCE(MIN(CASE WHEN ok THEN depth_mm END), 0) / 1000e0 AS lo, COALESCE(MAX(CASE WHEN ok THEN depth_mm END), 0) / 1000e0 AS hi,
  COALESCE(QUANTILE_CONT(CASE WHEN ok THEN depth_mm END, 0.5), 0) / 1000 AS med, 100e0 * SUM((ok AND depth_mm < 600)::INT) / NULLIF(SUM(ok::INT), 0) AS near,
  100e0 * (1024 - SUM((ok AND v >= 32)::INT)) / 1024 AS bottom_holes, 100e0 * SUM(ok::INT) / 3072 AS pct FROM o GROUP BY frame)
SELECT frame, n, ROUND(pct, 7) AS pct, lo, hi, med, ROUND(COALESCE(near, 0), 7) AS near, ROUND(bottom_holes, 7) AS bottom_holes,
  CASE WHEN pct < 20 THEN 'sparse' WHEN near > 2 THEN 'too_near' WHEN bottom_holes > 20 THEN 'holes' WHEN med > 0 AND med < 1 THEN 'close_scene' END AS alarm,
  pct < 20 OR COALESCE(near, 0) > 2 OR bottom_holes > 20 AS is_error FROM s""")
def frame_quality(t):
    q = V.frame_quality(t.fx_depth, W, H)
    return q.select("frame", "n", F.round("pct", 7).alias("pct"), "lo", "hi", "med", F.round("near", 7).alias("near"),
                    F.round("bottom_holes", 7).alias("bottom_holes"), "alarm", "is_error")
