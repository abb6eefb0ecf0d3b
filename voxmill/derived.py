"""Voxel, depth and sensor shaped views over the business tables.

Each view is one portable SQL text that Spark and DuckDB both run, so operators
and their check queries start from the same rows. Only integer arithmetic and
exactly representable doubles are used. Frames, rooms and series grow with the
tables; nothing is cut down to a subset.
"""

from pyspark.sql import DataFrame, SparkSession

BASE = ("region nation customer supplier part orders lineitem events documents "
        "embeddings pages benchmark labels conversations").split()

VIEWS: dict[str, str] = {}

# One frame per supplier; every lineitem is one voxel row of its supplier's frame.
VIEWS["fx_voxels"] = """
SELECT frame, scene, split, gz, gy, gx, (gz * 36 + gy) * 60 + gx AS flat, label, label_fov, pred,
       tsdf10 / 10e0 AS tsdf, pixel_id,
       CASE WHEN flip = 0 THEN 1 - w ELSE w END AS label_weight
FROM (
  SELECT frame, scene, split, gz, gy, gx, label, pred, tsdf10, pixel_id, flip,
         CASE WHEN ln = 5 THEN 255 ELSE label END AS label_fov,
         CASE WHEN label BETWEEN 1 AND 253 OR tsdf10 < -5 THEN 1 ELSE 0 END AS w
  FROM (
    SELECT CAST(l_suppkey AS INT) AS frame, CAST(FLOOR(l_suppkey / 20) AS INT) AS scene,
           CASE WHEN l_suppkey % 5 < 2 THEN 'test' ELSE 'train' END AS split,
           CAST(l_partkey % 60 AS INT) AS gz, CAST(l_orderkey % 36 AS INT) AS gy,
           CAST((l_partkey + 7 * l_linenumber) % 60 AS INT) AS gx,
           CASE WHEN CAST(l_quantity AS INT) % 13 = 12 THEN 255
                ELSE CAST(l_quantity AS INT) % 13 END AS label,
           CAST(CASE WHEN (l_orderkey + l_linenumber) % 3 <> 0
                     THEN LEAST(CAST(l_quantity AS INT) % 13, 11)
                     ELSE (l_partkey * 7 + l_linenumber) % 12 END AS INT) AS pred,
           2 * CAST(ROUND(l_discount * 100) AS INT) - 10 AS tsdf10,
           CASE WHEN CAST(ROUND(l_tax * 100) AS INT) >= 4 THEN NULL
                ELSE CAST(l_partkey AS INT) END AS pixel_id,
           l_orderkey % 97 AS flip, l_linenumber AS ln
    FROM {lineitem}) a) b
"""

# One camera per supplier: 3-4-5 headings and pitches, whole-centimetre offsets, world Z up.
VIEWS["fx_frames"] = """
SELECT frame, scene, c AS r00, s * sp AS r01, -s * cp AS r02, s AS r10, -c * sp AS r11, c * cp AS r12,
       0e0 AS r20, -cp AS r21, -sp AS r22, tx, ty, tz,
       64e0 AS fx, 64e0 AS fy, 32e0 AS cx, 24e0 AS cy, heading, pitch, split
FROM (
  SELECT CAST(s_suppkey AS INT) AS frame, CAST(FLOOR(s_suppkey / 20) AS INT) AS scene,
         CASE WHEN s_suppkey % 5 < 2 THEN 'test' ELSE 'train' END AS split,
         CASE s_suppkey % 4 WHEN 0 THEN 1e0 WHEN 1 THEN 0.6e0 WHEN 2 THEN 0e0 ELSE -0.6e0 END AS c,
         CASE s_suppkey % 4 WHEN 0 THEN 0e0 WHEN 1 THEN 0.8e0 WHEN 2 THEN 1e0 ELSE 0.8e0 END AS s,
         CASE s_suppkey % 3 WHEN 0 THEN 1e0 WHEN 1 THEN 0.96e0 ELSE 0.8e0 END AS cp,
         CASE s_suppkey % 3 WHEN 0 THEN 0e0 WHEN 1 THEN 0.28e0 ELSE 0.6e0 END AS sp,
         ((s_suppkey % 10) * 16 - 80) / 100e0 AS tx, ((s_suppkey % 7) * 16 - 48) / 100e0 AS ty,
         (100 + 2 * (s_nationkey % 20)) / 100e0 AS tz,
         CASE WHEN s_suppkey % 23 = 0 THEN NULL ELSE (s_suppkey * 7 % 451) / 10e0 END AS heading,
         (s_suppkey * 11 % 121 - 60) / 1e0 AS pitch
  FROM {supplier}) q
"""

# Depth pixels of a 64 x 48 image, one row per (frame, u, v).
VIEWS["fx_depth"] = """
SELECT frame, u, v, MAX(depth_mm) AS depth_mm, MAX(r) AS r, MAX(g) AS g, MAX(b) AS b
FROM (
  SELECT CAST(l_suppkey AS INT) AS frame,
         CAST((l_partkey * 13 + l_linenumber) % 64 AS INT) AS u,
         CAST((l_orderkey * 5 + l_linenumber * 11) % 48 AS INT) AS v,
         CASE WHEN (l_partkey + l_linenumber) % 17 = 0 THEN 0
              ELSE 500 + 60 * CAST(l_quantity AS INT) END AS depth_mm,
         CAST(l_partkey % 256 AS INT) AS r, CAST(l_orderkey % 256 AS INT) AS g,
         CAST((l_partkey + l_orderkey) % 256 AS INT) AS b
  FROM {lineitem}) q
GROUP BY frame, u, v
"""

VIEWS["fx_evidence"] = """
SELECT room, frame, ix, iy, iz, r, g, b, ts,
       CASE WHEN frame % 40 < 12 + uid % 27 THEN 'unknown'
            WHEN event_type IN ('purchase', 'signup') THEN 'hit' ELSE 'pass' END AS kind
FROM (
  SELECT CAST(FLOOR(user_id / 156) AS INT) AS room, CAST(FLOOR(event_id / 250) AS INT) AS frame,
         CAST(user_id % 12 AS INT) AS ix, CAST(FLOOR(user_id / 12) AS INT) % 13 AS iy,
         CAST(event_id % 7 AS INT) AS iz, CAST(FLOOR(value) AS INT) % 256 AS r,
         CAST((event_id * 31) % 256 AS INT) AS g, CAST((event_id * 17) % 256 AS INT) AS b,
         user_id AS uid, event_type, ts
  FROM {events}) q
"""

VIEWS["fx_claims"] = """
SELECT CAST(FLOOR(user_id / 156) AS INT) AS room, CAST(FLOOR(event_id / 250) AS INT) AS frame,
       CAST((user_id + 1) % 12 AS INT) AS ix, CAST(FLOOR(user_id / 12) AS INT) % 13 AS iy,
       CAST(event_id % 9 AS INT) AS iz,
       CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 + CAST(user_id % 4 AS INT) END AS cls
FROM {events}
"""

VIEWS["fx_imu"] = """
SELECT CAST(user_id % 5 AS INT) AS capture, event_id AS idx, event_id / 63e0 AS t,
       CASE WHEN CAST(FLOOR(event_id / 400) AS INT) % 2 = 0
            THEN (event_id * 37 % 11) - 5 ELSE (event_id * 37 % 1001) - 500 END / 1000e0 AS x,
       CASE WHEN CAST(FLOOR(event_id / 400) AS INT) % 2 = 0
            THEN -9800 + (event_id * 53 % 13) ELSE -9800 + (event_id * 53 % 1501) END / 1000e0 AS y,
       ((event_id * 29 % 17) - 8) / 1000e0 AS z
FROM {events}
"""

# Tracked frames with a time and a tracked up direction, for the as-of join.
VIEWS["fx_tracked"] = """
SELECT CAST(o_custkey % 5 AS INT) AS capture, o_orderkey AS frame, (o_orderkey + 0.5e0) / 94.5e0 AS t,
       (o_orderkey * 7 % 41 - 20) / 100e0 AS ux, -1e0 AS uy, (o_orderkey * 3 % 29 - 14) / 100e0 AS uz
FROM {orders}
"""

VIEWS["fx_tracking"] = """
SELECT CAST(user_id % 5 AS INT) AS capture, event_id AS frame,
       event_id + CAST(FLOOR(event_id / 23) AS BIGINT) AS seq_no,
       CASE WHEN event_id % 149 = 3 THEN 'no depth' END AS error,
       CASE WHEN event_id % 149 = 3 OR event_id % 173 = 5 THEN NULL
            WHEN event_id % 97 < 4 OR event_id % 3001 < 130 THEN 15 ELSE 70 + CAST(event_id % 25 AS INT) END / 100e0 AS fitness,
       CASE WHEN event_id % 211 = 0 THEN 900 ELSE 5 + CAST(event_id % 20 AS INT) END / 1000e0 AS step_m,
       CASE WHEN event_id % 307 = 0 THEN 70 ELSE CAST(event_id % 13 AS INT) END / 1e0 AS turn_deg
FROM {events}
"""

# Channel means per frame: a white balance that drifts in steps and then settles.
VIEWS["fx_white"] = """
SELECT CAST(user_id % 5 AS INT) AS capture, event_id AS frame,
       CASE WHEN event_id % 401 = 7 THEN 0e0 ELSE 137e0 - 40e0 / (1 + FLOOR(event_id / 40)) END AS r,
       CASE WHEN event_id % 401 = 7 THEN 0e0 ELSE 120e0 + (event_id * 7 % 5) / 100e0 END AS g,
       CASE WHEN event_id % 401 = 7 THEN 0e0 ELSE 147e0 + (40 + 5 * (user_id % 5)) / (1e0 + FLOOR(event_id / 40)) END AS b
FROM {events}
"""

# Forward and reverse runs of one trajectory per capture: 3-4-5 headings and cm offsets.
VIEWS["fx_runs"] = """
SELECT capture, run, frame, c AS r00, 0e0 AS r01, -s AS r02, s AS r10, 0e0 AS r11, c AS r12,
       0e0 AS r20, -1e0 AS r21, 0e0 AS r22, tx, ty, tz
FROM (
  SELECT CAST(o_custkey % 5 AS INT) AS capture, run, o_orderkey AS frame,
         CASE (o_orderkey + bump) % 4 WHEN 0 THEN 1e0 WHEN 1 THEN 0.6e0 WHEN 2 THEN 0e0 ELSE -0.6e0 END AS c,
         CASE (o_orderkey + bump) % 4 WHEN 0 THEN 0e0 WHEN 1 THEN 0.8e0 WHEN 2 THEN 1e0 ELSE 0.8e0 END AS s,
         (o_orderkey % 331 + off) / 100e0 AS tx, (o_orderkey * 3 % 257 + off) / 100e0 AS ty,
         (120 + o_orderkey % 11 + off) / 100e0 AS tz
  FROM (SELECT o_custkey, o_orderkey, 'forward' AS run, 0 AS bump, 0 AS off FROM {orders}
        UNION ALL
        SELECT o_custkey, o_orderkey, 'reverse' AS run,
               CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS bump,
               o_orderkey % 5 AS off
        FROM {orders} WHERE o_orderstatus <> 'P') a) q
"""

# Annotation solids on a 2 cm lattice, 20 per room; centres and sizes in whole cells.
VIEWS["fx_solids"] = """
SELECT CAST(FLOOR(p_partkey / 20) AS INT) AS room, CAST(p_partkey % 20 AS INT) AS seq,
       CAST(1 + p_size % 11 AS INT) AS cls,
       CASE p_partkey % 3 WHEN 0 THEN 'box' WHEN 1 THEN 'cylinder' ELSE 'wedge' END AS shape,
       CAST(8 + p_partkey * 7 % 24 AS INT) / 1e0 AS cx, CAST(8 + p_partkey * 11 % 24 AS INT) / 1e0 AS cy,
       CAST(5 + p_partkey * 5 % 14 AS INT) / 1e0 AS cz,
       CAST(3 + p_size % 6 AS INT) / 1e0 AS sx, CAST(3 + p_partkey % 6 AS INT) / 1e0 AS sy,
       CAST(3 + p_partkey % 5 AS INT) / 1e0 AS sz,
       CASE p_partkey % 4 WHEN 0 THEN 1e0 WHEN 1 THEN 0.6e0 WHEN 2 THEN 0e0 ELSE -0.6e0 END AS c,
       CASE p_partkey % 4 WHEN 0 THEN 0e0 WHEN 1 THEN 0.8e0 WHEN 2 THEN 1e0 ELSE 0.8e0 END AS s
FROM {part}
"""

# Room shells around the solids, one per 20 parts.
VIEWS["fx_rooms"] = """
SELECT room, 20e0 AS cx, 20e0 AS cy, 11e0 AS cz, CAST(28 + room % 7 AS INT) / 1e0 AS sx,
       CAST(27 + room % 5 AS INT) / 1e0 AS sy, CAST(15 + room % 4 AS INT) / 1e0 AS sz, 2e0 AS thickness,
       room % 3 <> 0 AS ceiling,
       CASE room % 4 WHEN 0 THEN 1e0 WHEN 1 THEN 0.6e0 WHEN 2 THEN 0e0 ELSE 0.8e0 END AS c,
       CASE room % 4 WHEN 0 THEN 0e0 WHEN 1 THEN 0.8e0 WHEN 2 THEN 1e0 ELSE 0.6e0 END AS s
FROM (SELECT DISTINCT CAST(FLOOR(p_partkey / 20) AS INT) AS room FROM {part}) q
"""

VIEWS["fx_manifest"] = """
SELECT CONCAT('data/', lang, '/', CAST(doc_id AS VARCHAR(20)), '.txt') AS path, doc_id, lang, text,
       n_chars AS size,
       CASE WHEN doc_id % 5 = 0 THEN NULL
            WHEN doc_id % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS remote_size
FROM {documents}
"""

# Coloured points, one per customer order, in metres on a 1 cm lattice.
VIEWS["fx_points"] = """
SELECT o_orderkey AS id, CAST(FLOOR(o_orderkey / 3000) AS INT) AS cloud,
       (o_custkey * 17 % 400) / 100e0 AS x, (o_orderkey * 13 % 400) / 100e0 AS y,
       (o_orderkey * 7 % 240) / 100e0 AS z,
       CAST(o_custkey % 256 AS INT) AS r, CAST(o_orderkey % 256 AS INT) AS g,
       CAST((o_custkey + o_orderkey) % 256 AS INT) AS b
FROM {orders}
"""

# Occupied voxels of each room, distinct cells, from parts.
VIEWS["fx_occupied"] = """
SELECT room, ix, iy, iz, MAX(cls) AS cls FROM (
  SELECT CAST(FLOOR(l_partkey / 100) AS INT) AS room, CAST(l_orderkey % 12 AS INT) AS ix,
         CAST(l_partkey % 11 AS INT) AS iy, CAST(l_suppkey % 9 AS INT) AS iz,
         CAST(1 + l_linenumber AS INT) AS cls
  FROM {lineitem}) q
GROUP BY room, ix, iy, iz
"""


def needs(view: str) -> list[str]:
    return [b for b in BASE + list(VIEWS) if "{" + b + "}" in VIEWS[view]]


class Tables:
    """Base tables and derived views of one data folder, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name in VIEWS:
            return self.spark.sql(VIEWS[name], **{b: getattr(self, b) for b in needs(name)})
        raise AttributeError(name)


def check_sql(body: str) -> str:
    """Prefix a DuckDB query with the derived views it names."""
    used: list[str] = []

    def visit(text: str) -> None:
        for v in VIEWS:
            if v in text and v not in used:
                visit(VIEWS[v])
                used.append(v)

    visit(body)
    ctes = [f"{v} AS ({VIEWS[v].format(**{b: b for b in BASE + list(VIEWS)})})" for v in used]
    body = body.strip()
    if not ctes:
        return body
    if body[:14].upper() == "WITH RECURSIVE":
        return "WITH RECURSIVE " + ", ".join(ctes) + ", " + body[14:]
    if body[:4].upper() == "WITH":
        return "WITH " + ", ".join(ctes) + ", " + body[4:]
    return "WITH " + ", ".join(ctes) + " " + body
