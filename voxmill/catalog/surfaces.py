"""Queries over surfaces, nearest-neighbour joins, sets and manifests."""

from pyspark.sql import functions as F

from voxmill.catalog.registry import query
from voxmill.operators import manifest as D
from voxmill.operators import surface as M
from voxmill.operators.joins import nearest, nearest_any, not_done, pair_keys

OCC = "room, ix, iy, iz"


@query("exposed_faces", "M01 J08", """
WITH d AS (SELECT * FROM (VALUES (1,0,0,0,1,0.86e0), (-1,0,0,0,-1,0.66e0), (0,1,0,1,1,1.0e0), (0,-1,0,1,-1,0.44e0), (0,0,1,2,1,0.92e0), (0,0,-1,2,-1,0.58e0)) t(dx,dy,dz,axis,dir,shade))
SELECT room, axis, dir, shade, COUNT(*) AS n, SUM((ix * 16 + iy) * 16 + iz)::BIGINT AS keys FROM fx_occupied o CROSS JOIN d
WHERE NOT EXISTS (SELECT 1 FROM fx_occupied p WHERE p.room = o.room AND p.ix = o.ix + dx AND p.iy = o.iy + dy AND p.iz = o.iz + dz) GROUP BY ALL""")
def exposed_faces(t):
    f = M.exposed_faces(t.fx_occupied, ["room"])
    key = (F.col("ix") * 16 + F.col("iy")) * 16 + F.col("iz")
    return f.groupBy("room", "axis", "dir", "shade").agg(F.count(F.lit(1)).alias("n"), F.sum(key).alias("keys"))


@query("surface_vertices", "M02", """
WITH occ AS (SELECT DISTINCT room, ix, iy, iz FROM fx_occupied), k AS (SELECT i % 2 AS dx, i // 2 % 2 AS dy, i // 4 AS dz FROM range(8) t(i)),
cell AS (SELECT DISTINCT room, ix - dx AS cix, iy - dy AS ciy, iz - dz AS ciz FROM occ CROSS JOIN k),
b AS (SELECT cell.*, dx, dy, dz, occ.room IS NOT NULL AS filled FROM cell CROSS JOIN k LEFT JOIN occ ON occ.room = cell.room AND occ.ix = cix + dx AND occ.iy = ciy + dy AND occ.iz = ciz + dz),
e AS (SELECT p.room, p.cix, p.ciy, p.ciz, (p.dx + q.dx) / 2e0 AS mx, (p.dy + q.dy) / 2e0 AS my, (p.dz + q.dz) / 2e0 AS mz
  FROM b p JOIN b q ON p.room = q.room AND p.cix = q.cix AND p.ciy = q.ciy AND p.ciz = q.ciz AND p.filled AND NOT q.filled
  WHERE ABS(p.dx - q.dx) + ABS(p.dy - q.dy) + ABS(p.dz - q.dz) = 1)
SELECT room, cix::INT AS cix, ciy::INT AS ciy, ciz::INT AS ciz, ROUND(cix + AVG(mx), 9) AS x, ROUND(ciy + AVG(my), 9) AS y, ROUND(ciz + AVG(mz), 9) AS z FROM e GROUP BY room, cix, ciy, ciz""")
def surface_vertices(t):
    """The owner of a vertex, free where two voxels are as near, is checked in the tests."""
    v = M.surface_vertices(t.fx_occupied, ["room"])
    return v.select("room", "cix", "ciy", "ciz", *[F.round(c, 9).alias(c) for c in "xyz"])


@query("surface_edges", "M02 M09", """
WITH d AS (SELECT * FROM (VALUES (1,0,0), (-1,0,0), (0,1,0), (0,-1,0), (0,0,1), (0,0,-1)) t(dx,dy,dz)),
f AS (SELECT room, COUNT(*) AS quads FROM fx_occupied o CROSS JOIN d
WHERE NOT EXISTS (SELECT 1 FROM fx_occupied p WHERE p.room = o.room AND p.ix = o.ix + dx AND p.iy = o.iy + dy AND p.iz = o.iz + dz) GROUP BY room)
SELECT room, CAST(2 * quads AS BIGINT) AS triangles, CAST(6 * quads AS BIGINT) AS sides, TRUE AS closed FROM f""")
def surface_edges(t):
    tri = M.quad_triangles(M.surface_quads(t.fx_occupied, ["room"]), ["room"])
    e = M.edge_counts(tri, ["room"])
    return e.groupBy("room").agg((F.sum("n") / 3).cast("long").alias("triangles"), F.sum("n").alias("sides"),
                                 (F.count_if(F.col("n") % 2 != 0) == 0).alias("closed"))


@query("depth_triangles", "M08", """
WITH p AS (SELECT frame, u, v, depth_mm FROM fx_depth WHERE depth_mm > 0),
q AS (SELECT a.frame, a.u, a.v FROM p a JOIN p b ON b.frame = a.frame AND b.u = a.u + 1 AND b.v = a.v JOIN p c ON c.frame = a.frame AND c.u = a.u AND c.v = a.v + 1
  JOIN p e ON e.frame = a.frame AND e.u = a.u + 1 AND e.v = a.v + 1 WHERE GREATEST(a.depth_mm, b.depth_mm, c.depth_mm, e.depth_mm) - LEAST(a.depth_mm, b.depth_mm, c.depth_mm, e.depth_mm) <= 1500)
SELECT frame, 0 AS part, v * 64 + u AS a, (v + 1) * 64 + u AS b, v * 64 + u + 1 AS c FROM q
UNION ALL SELECT frame, 1, v * 64 + u + 1, (v + 1) * 64 + u, (v + 1) * 64 + u + 1 FROM q""")
def depth_triangles(t):
    return M.triangulate_depth(t.fx_depth, 64, 1500)


NEAR = """q AS (SELECT vec_id AS id, embedding[13]::DOUBLE AS x, embedding[14]::DOUBLE AS y, embedding[15]::DOUBLE AS z FROM embeddings WHERE label < 5),
f AS (SELECT vec_id AS ref_id, embedding[13]::DOUBLE AS x, embedding[14]::DOUBLE AS y, embedding[15]::DOUBLE AS z FROM embeddings WHERE label >= 5),
d AS (SELECT q.id, f.ref_id, (q.x-f.x)*(q.x-f.x) + (q.y-f.y)*(q.y-f.y) + (q.z-f.z)*(q.z-f.z) AS d2 FROM q CROSS JOIN f),
n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY d2, ref_id) AS rk FROM d)"""


def clouds(t):
    e = t.embeddings.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(a) for i, a in zip((12, 13, 14), "xyz")])
    return (e.filter("label < 5").drop("label").withColumnRenamed("vec_id", "id"),
            e.filter("label >= 5").drop("label").withColumnRenamed("vec_id", "ref_id"))


@query("nearest_within", "J05", f"WITH {NEAR} SELECT id, ref_id, d2 FROM n WHERE rk = 1 AND d2 <= 0.0025")
def nearest_within(t):
    q, f = clouds(t)
    return nearest(q, f, 0.05)


@query("nearest_unlimited", "J05", f"WITH {NEAR} SELECT id, ref_id, d2 FROM n WHERE rk = 1")
def nearest_unlimited(t):
    q, f = clouds(t)
    return nearest_any(q, f, 0.05)


@query("nearest_colours", "M03", f"""WITH {NEAR}, m AS (SELECT id, ref_id, d2 FROM n WHERE rk = 1)
SELECT q.id, d2 <= lim * lim AS found, CASE WHEN d2 <= lim * lim THEN ref_id % 256 ELSE q.id % 7 END AS r, CASE WHEN d2 <= lim * lim THEN ref_id % 64 ELSE q.id % 11 END AS g, CASE WHEN d2 <= lim * lim THEN ref_id % 32 ELSE q.id % 13 END AS b
FROM (SELECT *, CASE WHEN id % 4 = 0 THEN 0.1e0 ELSE 0.05e0 END AS lim FROM q) q JOIN m ON q.id = m.id""")
def nearest_colours(t):
    q, f = clouds(t)
    q = q.select("*", *[(F.col("id") % k).alias(c) for k, c in zip((7, 11, 13), "rgb")], F.when(F.col("id") % 4 == 0, 0.1).otherwise(0.05).alias("max_dist"))
    f = f.select("*", *[(F.col("ref_id") % k).alias(c) for k, c in zip((256, 64, 32), "rgb")])
    return M.nearest_colours(q, f, 0.1)


@query("snapped_points", "M04", f"""WITH {NEAR}, m AS (SELECT id, ref_id, d2 FROM n WHERE rk = 1)
SELECT q.id, q.id % 3 <> 0 AND d2 <= 0.01 AS moved, CASE WHEN q.id % 3 <> 0 AND d2 <= 0.01 THEN f.x ELSE q.x END AS x, CASE WHEN q.id % 3 <> 0 AND d2 <= 0.01 THEN f.y ELSE q.y END AS y,
  CASE WHEN q.id % 3 <> 0 AND d2 <= 0.01 THEN f.z ELSE q.z END AS z FROM q JOIN m ON q.id = m.id JOIN f ON f.ref_id = m.ref_id""")
def snapped_points(t):
    q, f = clouds(t)
    return M.snap_points(q, f, 0.1, F.col("id") % 3 != 0)


@query("key_pairs", "J03", """
SELECT COALESCE(a.k, b.k) AS frame, CASE WHEN a.k IS NULL THEN 'right_only' WHEN b.k IS NULL THEN 'left_only' ELSE 'paired' END AS side
FROM (SELECT DISTINCT l_partkey AS k FROM lineitem) a FULL OUTER JOIN (SELECT DISTINCT p_partkey + p_size % 3 AS k FROM part) b ON a.k = b.k""")
def key_pairs(t):
    a = t.lineitem.select(F.col("l_partkey").alias("frame"))
    return pair_keys(a, t.part.select((F.col("p_partkey") + F.col("p_size") % 3).alias("frame")), "frame")


@query("not_done", "S13 J02", "SELECT path, size FROM fx_manifest WHERE remote_size IS NULL")
def resume(t):
    m = t.fx_manifest.select("path", "size", "remote_size")
    return not_done(m.select("path", "size"), m.filter("remote_size IS NOT NULL"), ["path"])


@query("key_sets", "D02", """
WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT c_custkey + c_nationkey % 2 AS k FROM customer)
SELECT 'both' AS which, k FROM (SELECT k FROM a INTERSECT SELECT k FROM b) q UNION ALL SELECT 'first_only', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b) q""")
def key_sets(t):
    a = t.orders.select(F.col("o_custkey").alias("k")).distinct()
    b = t.customer.select((F.col("c_custkey") + F.col("c_nationkey") % 2).alias("k"))
    return a.intersect(b).select(F.lit("both").alias("which"), "k").unionByName(a.exceptAll(b).select(F.lit("first_only").alias("which"), "k"))


@query("tagged_union", "D01", """
SELECT 'volume' AS dataset, frame::BIGINT AS frame, COUNT(*) AS n, NULL::DOUBLE AS near_pct FROM fx_voxels GROUP BY frame
UNION ALL SELECT 'depth', frame, NULL, ROUND(100.0 * AVG((depth_mm < 1500)::INT), 8) FROM fx_depth GROUP BY frame""")
def tagged_union(t):
    a = t.fx_voxels.groupBy(F.col("frame").cast("long").alias("frame")).agg(F.count(F.lit(1)).alias("n")).withColumn("dataset", F.lit("volume"))
    b = t.fx_depth.groupBy(F.col("frame").cast("long").alias("frame")).agg(F.round(100.0 * F.avg((F.col("depth_mm") < 1500).cast("int")), 8).alias("near_pct")).withColumn("dataset", F.lit("depth"))
    return a.unionByName(b, allowMissingColumns=True)


@query("seeded_sample", "D03", "SELECT frame FROM (SELECT DISTINCT frame FROM fx_frames) q ORDER BY md5('7/' || frame), frame LIMIT 40")
def seeded_sample(t):
    return D.seeded_sample(t.fx_frames.select("frame"), "frame", 40, 7)


@query("manifest_packs", "D04", """
WITH k AS (SELECT *, string_split(path, '/') AS p FROM fx_manifest WHERE path NOT LIKE 'data/%/%9.txt')
SELECT p[1] || '/' || p[2] AS pack, COUNT(*) AS files, SUM(size)::BIGINT AS bytes FROM k GROUP BY ALL""")
def manifest_packs(t):
    return D.pack_sizes(D.manifest(t.fx_manifest.select("path", "size"), ["data/*/*9.txt"]))


@query("scene_packs", "D05", """
SELECT scene, CAST((ROW_NUMBER() OVER (ORDER BY scene) - 1) // 50 AS INT) AS pack FROM (SELECT DISTINCT p_name AS scene FROM part) q""")
def scene_packs(t):
    return D.scene_packs(t.part.select(F.col("p_name").alias("scene")))


@query("changed_files", "D06", """
SELECT path, CASE WHEN remote_size IS NULL THEN 'new' WHEN remote_size <> size THEN 'size' WHEN doc_id % 11 = 0 THEN 'digest' END AS why FROM fx_manifest""")
def changed_files(t):
    m = t.fx_manifest
    # what the other side holds: two kinds of digest, some of an older text
    body = F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    big = F.col("doc_id") % 2 == 0
    remote = m.filter("remote_size IS NOT NULL").select("path", "remote_size", F.when(big, F.sha2(body.cast("binary"), 256)).alias("sha256"),
                                                        F.when(~big, D.blob_sha1(body)).alias("sha1"))
    return D.changed_files(m.select("path", "size", "text"), remote).select("path", "why")


@query("content_digests", "D06", "SELECT path, sha256(text) AS sha256 FROM fx_manifest")
def content_digests(t):
    return t.fx_manifest.select("path", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


@query("greedy_batches", "D07", """
WITH RECURSIVE f AS (SELECT path, size, ROW_NUMBER() OVER (ORDER BY path) AS rn FROM fx_manifest),
b(rn, path, size, batch, n, total) AS (SELECT rn, path, size, 0, 1, size FROM f WHERE rn = 1
  UNION ALL SELECT f.rn, f.path, f.size, CASE WHEN b.n >= 50 OR b.total + f.size > 40000 THEN b.batch + 1 ELSE b.batch END,
    CASE WHEN b.n >= 50 OR b.total + f.size > 40000 THEN 1 ELSE b.n + 1 END, CASE WHEN b.n >= 50 OR b.total + f.size > 40000 THEN f.size ELSE b.total + f.size END
  FROM b JOIN f ON f.rn = b.rn + 1)
SELECT path, size, batch FROM b""")
def greedy_batches(t):
    return D.greedy_batches(t.fx_manifest, 50, 40000)


@query("packs_to_do", "D08", """
WITH p AS (SELECT DISTINCT 'data/' || lang AS pack FROM documents)
SELECT pack FROM p WHERE pack NOT IN (SELECT 'data/' || lang FROM documents GROUP BY lang HAVING COUNT(*) > 200) OR pack LIKE 'data/f%'""")
def packs_to_do(t):
    p = t.documents.select(F.concat(F.lit("data/"), "lang").alias("pack")).distinct()
    held = t.documents.groupBy("lang").count().filter("count > 200").select(F.concat(F.lit("data/"), "lang").alias("pack"))
    return D.packs_to_do(p, held, ["data/f*"])


@query("packs_to_pull", "D08", """
SELECT DISTINCT 'data/' || lang AS pack FROM documents WHERE lang <> 'en' AND lang NOT IN (SELECT lang FROM documents WHERE source = 'src1' GROUP BY lang HAVING COUNT(*) > 30)""")
def packs_to_pull(t):
    name = F.concat(F.lit("data/"), "lang").alias("pack")
    done = t.documents.filter("source = 'src1'").groupBy("lang").count().filter("count > 30").select(name)
    return D.packs_to_pull(t.documents.select(name).distinct(), done, ["data/en"])
