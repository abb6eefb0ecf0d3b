"""Queries that compare frames, views and logits."""

from pyspark.sql import functions as F

from voxmill.catalog.registry import query
from voxmill.catalog.scoring import FRAME_SQL
from voxmill.catalog.voxels import VIEW_SQL, scene_boxes
from voxmill.operators import analysis as A
from voxmill.operators import score as S
from voxmill.operators import voxelize as V
from voxmill.session import cut


def r(df, digits, *cols):
    return df.withColumns({c: F.round(c, digits) for c in cols})


SC = FRAME_SQL.strip().rstrip(",") + f""", {VIEW_SQL},
vs AS (SELECT frame, AVG((z < 1.5)::INT) * 100 AS near_pct, AVG(hidden) AS free_mean FROM ext GROUP BY frame),
vm AS (SELECT frame, QUANTILE_CONT(depth_mm, 0.5) / 1000 AS depth_med FROM fx_depth WHERE depth_mm > 0 GROUP BY frame),
fr AS (SELECT frame, scene, tz AS cam_z, DEGREES(ACOS(LEAST(1, -r21 / sqrt(r20*r20 + r21*r21 + r22*r22)))) AS tilt_deg, heading, pitch FROM fx_frames),
sc AS (SELECT s.*, fr.scene, CASE WHEN s.frame % 5 < 2 THEN 'test' ELSE 'train' END AS dataset, cam_z, tilt_deg, depth_med, near_pct, free_mean
  FROM s JOIN fr ON fr.frame = s.frame JOIN vs ON vs.frame = s.frame JOIN vm ON vm.frame = s.frame)"""


def scores(t):
    """The per-frame score table: scores beside viewpoint properties. Stored once, since the
    summaries read it several times."""
    s = S.frame_scores(t.fx_voxels)
    v = V.viewpoint_statistics(t.fx_depth, t.fx_frames, scene_boxes(t), 64 * 48)
    f = t.fx_frames.select("frame", "scene", F.when(F.col("frame") % 5 < 2, "test").otherwise("train").alias("dataset"))
    return cut(s.join(v, "frame").join(f, "frame"))


CELLS = """cells AS (SELECT frame, label, pred FROM fx_voxels WHERE label <> 255), cls AS (SELECT UNNEST(range(1, 12)) AS cls)"""


def pooled_sql(key, src):
    return f"""pi AS (SELECT {key}, cls, SUM((label = cls AND pred = cls)::INT) * 1.0 / NULLIF(SUM((label = cls OR pred = cls)::INT), 0) AS iou FROM {src} CROSS JOIN cls GROUP BY {key}, cls),
pm AS (SELECT {key}, AVG(iou) AS miou FROM pi GROUP BY {key}),
pb AS (SELECT {key}, COUNT(*) AS sc_voxels, 100.0 * SUM((label > 0 AND pred > 0)::INT) / GREATEST(SUM((label > 0 OR pred > 0)::INT), 1) AS sc_iou, COUNT(DISTINCT frame) AS frames FROM {src} GROUP BY {key})"""


@query("reference_like_views", "E22", f"""WITH b AS (SELECT QUANTILE_CONT(pitch, 0.05) AS pl, QUANTILE_CONT(pitch, 0.95) AS ph, QUANTILE_CONT(tz, 0.05) AS zl, QUANTILE_CONT(tz, 0.95) AS zh
  FROM fx_frames WHERE split = 'train'), kept AS (SELECT f.frame FROM fx_frames f, b WHERE pitch BETWEEN pl AND ph AND tz BETWEEN zl AND zh), {CELLS},
src AS (SELECT 1 AS one, c.* FROM cells c JOIN kept k ON c.frame = k.frame), {pooled_sql('one', 'src')}
SELECT frames, sc_voxels, ROUND(sc_iou, 6) AS sc_iou, ROUND(100 * miou, 6) AS miou FROM pb JOIN pm ON pb.one = pm.one""")
def reference_like_views(t):
    f = t.fx_frames.select("frame", "pitch", "tz", "split")
    kept = A.reference_like(f, f.filter("split = 'train'"), ["pitch", "tz"])
    cells = S.frame_cells(t.fx_voxels).join(kept.select("frame"), "frame").withColumn("one", F.lit(1))
    n = cells.select("frame").distinct().agg(F.count(F.lit(1)).alias("frames"))
    return r(S.pooled_scores(cells, "one").drop("one").join(F.broadcast(n)), 6, "sc_iou", "miou").select("frames", "sc_voxels", "sc_iou", "miou")


def _bins(col, edges, clip):
    whens = " ".join(f"WHEN {col} >= {edges[i]} AND {col} < {edges[i + 1]} THEN {i}" for i in range(len(edges) - 1))
    ends = f"WHEN {col} < {edges[0]} THEN 0 WHEN {col} >= {edges[-1]} THEN {len(edges) - 2} " if clip else ""
    return f"""WITH {CELLS}, bb AS (SELECT frame, CASE {ends}{whens} END AS bin FROM fx_frames),
src AS (SELECT bin, c.* FROM cells c JOIN bb ON c.frame = bb.frame WHERE bin IS NOT NULL), {pooled_sql('bin', 'src')}
SELECT CAST(pb.bin AS INT) AS bin, frames, sc_voxels, ROUND(sc_iou, 6) AS sc_iou, ROUND(100 * miou, 6) AS miou FROM pb JOIN pm ON pb.bin = pm.bin"""


@query("heading_scores", "E23", _bins("heading", A.HEADING_BINS, False))
def heading_scores(t):
    return r(A.binned_scores(t.fx_voxels, t.fx_frames, "heading", A.HEADING_BINS, False), 6, "sc_iou", "miou")


@query("pitch_scores", "E23", _bins("pitch", A.PITCH_BINS, True))
def pitch_scores(t):
    return r(A.binned_scores(t.fx_voxels, t.fx_frames, "pitch", A.PITCH_BINS, True), 6, "sc_iou", "miou")


SCENES = f"""{CELLS}, src AS (SELECT scene, CASE WHEN heading <= 10 THEN 'aligned' ELSE 'diagonal' END AS side, c.* FROM cells c JOIN fx_frames f ON c.frame = f.frame
  WHERE heading <= 10 OR heading >= 35), {pooled_sql('scene, side', 'src')},
sd AS (SELECT pb.scene, pb.side, sc_iou, 100 * miou AS miou FROM pb JOIN pm ON pb.scene = pm.scene AND pb.side = pm.side WHERE frames >= 2),
pr AS (SELECT a.scene, a.sc_iou - d.sc_iou AS d_sc, a.miou - d.miou AS d_ssc FROM sd a JOIN sd d ON a.scene = d.scene AND a.side = 'aligned' AND d.side = 'diagonal')"""


@query("within_scene", "E24 J10", f"WITH {SCENES} SELECT scene, ROUND(d_sc, 6) AS d_sc, ROUND(d_ssc, 6) AS d_ssc FROM pr")
def within_scene(t):
    return r(A.scene_pairs(t.fx_voxels, t.fx_frames, 2), 6, "d_sc", "d_ssc")


@query("within_scene_summary", "E24", f"""WITH {SCENES} SELECT 'd_sc' AS name, ROUND(QUANTILE_CONT(d_sc, 0.5), 6) AS median, COUNT(*) AS scenes, AVG((d_sc > 0)::INT) AS win_share FROM pr HAVING COUNT(*) > 0
UNION ALL SELECT 'd_ssc', ROUND(QUANTILE_CONT(d_ssc, 0.5), 6), COUNT(*), AVG((d_ssc > 0)::INT) FROM pr HAVING COUNT(*) > 0""")
def within_scene_summary(t):
    return r(A.pair_summary(A.scene_pairs(t.fx_voxels, t.fx_frames, 2)), 6, "median")


@query("occupancy_bands", "E25", FRAME_SQL.strip() + """, d AS (SELECT *, CASE WHEN frame % 5 < 2 THEN 'test' ELSE 'train' END AS dataset, CASE WHEN occ_pct < 20 THEN 0 WHEN occ_pct < 35 THEN 1 WHEN occ_pct < 50 THEN 2
  WHEN occ_pct < 65 THEN 3 WHEN occ_pct < 80 THEN 4 WHEN occ_pct < 101 THEN 5 END AS band FROM s)
SELECT dataset, band, ROUND(QUANTILE_CONT(sc_iou, 0.5), 6) AS sc_iou, ROUND(QUANTILE_CONT(prec, 0.5), 6) AS prec, ROUND(QUANTILE_CONT(rec, 0.5), 6) AS rec, COUNT(*) AS n FROM d GROUP BY ALL""")
def occupancy_bands(t):
    s = S.frame_scores(t.fx_voxels).withColumn("dataset", F.when(F.col("frame") % 5 < 2, "test").otherwise("train"))
    return r(A.occupancy_bands(cut(s)), 6, "sc_iou", "prec", "rec")


@query("dataset_totals", "E25 D01", FRAME_SQL.strip() + """, d AS (SELECT *, CASE WHEN frame % 5 < 2 THEN 'test' ELSE 'train' END AS dataset FROM s)
SELECT dataset, ROUND(QUANTILE_CONT(sc_iou, 0.5), 6) AS sc_iou, ROUND(QUANTILE_CONT(prec, 0.5), 6) AS prec, ROUND(QUANTILE_CONT(rec, 0.5), 6) AS rec,
  ROUND(QUANTILE_CONT(occ_pct, 0.5), 6) AS occ_pct, QUANTILE_CONT(sc_voxels, 0.5)::DOUBLE AS sc_voxels, ROUND(QUANTILE_CONT(sc_voxels * occ_pct / 100, 0.5), 6) AS occupied FROM d GROUP BY dataset""")
def dataset_totals(t):
    s = S.frame_scores(t.fx_voxels).withColumn("dataset", F.when(F.col("frame") % 5 < 2, "test").otherwise("train"))
    return r(A.dataset_totals(cut(s)), 6, "sc_iou", "prec", "rec", "occ_pct", "occupied")


def _corr_sql():
    return " UNION ALL ".join(f"""SELECT '{p}' AS property, '{y}' AS score, ROUND(CORR({p}, {y}), 6) AS r, ROUND(POW(CORR({p}, {y}), 2), 6) AS explained,
  ROUND(REGR_SLOPE({y}, {p}) * {s}, 6) AS per_step, ROUND(STDDEV_POP({y}) * SQRT(1 - POW(CORR({p}, {y}), 2)), 6) AS residual_std FROM sc""" for p, s, _ in A.PROPERTIES for y in ("sc_iou", "ssc_miou"))


@query("viewpoint_correlations", "E26", SC + _corr_sql())
def viewpoint_correlations(t):
    return r(A.viewpoint_correlations(scores(t)), 6, "r", "explained", "per_step", "residual_std")


@query("property_spread", "E27", SC + " UNION ALL ".join(
    f"SELECT '{p}' AS property, ROUND(QUANTILE_CONT({p}, 0.9) - QUANTILE_CONT({p}, 0.1), 6) AS spread, QUANTILE_CONT({p}, 0.9) - QUANTILE_CONT({p}, 0.1) < {m} AS thin FROM sc" for p, _, m in A.PROPERTIES))
def property_spread(t):
    return r(A.property_spread(scores(t)), 6, "spread")


_N = [p for p, _, _ in A.PROPERTIES]


@query("property_matrix", "E27", SC + ", mx AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, CORR({a}, {b}) AS r FROM sc" for i, a in enumerate(_N) for b in _N[i + 1:])
       + ") SELECT a, b, ROUND(r, 6) AS r, CAST(ROW_NUMBER() OVER (ORDER BY ABS(r) DESC, a, b) AS INT) AS rk FROM mx")
def property_matrix(t):
    return r(A.property_matrix(scores(t)), 6, "r")


@query("hidden_bands", "E28", SC + """, q AS (SELECT QUANTILE_CONT(free_mean, 0.25) AS q1, QUANTILE_CONT(free_mean, 0.5) AS q2, QUANTILE_CONT(free_mean, 0.75) AS q3 FROM sc),
hb AS (SELECT sc.*, CASE WHEN free_mean <= q1 THEN 1 WHEN free_mean <= q2 THEN 2 WHEN free_mean <= q3 THEN 3 ELSE 4 END AS band FROM sc, q)
SELECT band, ROUND(QUANTILE_CONT(free_mean, 0.5), 6) AS free_mean, QUANTILE_CONT(sc_voxels, 0.5)::DOUBLE AS sc_voxels, ROUND(QUANTILE_CONT(occ_pct, 0.5), 6) AS occ_pct,
  ROUND(QUANTILE_CONT(sc_iou, 0.5), 6) AS sc_iou, ROUND(QUANTILE_CONT(ssc_miou, 0.5), 6) AS ssc_miou, COUNT(*) AS n FROM hb GROUP BY band""")
def hidden_bands(t):
    return r(A.hidden_bands(scores(t)), 6, "free_mean", "occ_pct", "sc_iou", "ssc_miou")


_E = ["cam_z", "depth_med", "free_mean", "sc_voxels", "occ_pct", "sc_iou", "ssc_miou"]


@query("best_worst_tenth", "E28", SC + """, o AS (SELECT margin, ROW_NUMBER() OVER (ORDER BY margin DESC) AS a, ROW_NUMBER() OVER (ORDER BY margin) AS z, COUNT(*) OVER () AS n FROM sc),
h AS (SELECT MAX(CASE WHEN a = GREATEST(1, n // 10) THEN margin END) AS hi, MAX(CASE WHEN z = GREATEST(1, n // 10) THEN margin END) AS lo FROM o)
""" + " UNION ALL ".join(f"""SELECT '{c}' AS name, ROUND((SELECT QUANTILE_CONT({c}, 0.5) FROM sc, h WHERE margin >= hi), 6)::DOUBLE AS best, ROUND((SELECT QUANTILE_CONT({c}, 0.5) FROM sc, h WHERE margin <= lo), 6)::DOUBLE AS worst,
  ROUND(ABS((SELECT QUANTILE_CONT({c}, 0.5) FROM sc, h WHERE margin >= hi) - (SELECT QUANTILE_CONT({c}, 0.5) FROM sc, h WHERE margin <= lo)) / (SELECT QUANTILE_CONT({c}, 0.9) - QUANTILE_CONT({c}, 0.1) FROM sc), 6)::DOUBLE AS difference""" for c in _E))
def best_worst_tenth(t):
    return r(A.best_worst_tenth(scores(t), _E), 6, "best", "worst", "difference")


@query("split_slopes", "E28", SC + """, md AS (SELECT QUANTILE_CONT(free_mean, 0.5) AS m FROM sc)
SELECT CASE WHEN free_mean <= m THEN 'low' ELSE 'high' END AS side, COUNT(*) AS n, ROUND(REGR_SLOPE(sc_iou, free_mean) * 0.1, 6) AS per_step FROM sc, md GROUP BY 1""")
def split_slopes(t):
    return r(A.split_slopes(scores(t), "free_mean", "sc_iou", 0.1), 6, "per_step")


@query("scene_ends", "E29", SC + """, e AS (SELECT * FROM sc WHERE scored >= 150 AND classes >= 5),
x AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY scene ORDER BY ssc_miou DESC, frame) AS b, ROW_NUMBER() OVER (PARTITION BY scene ORDER BY ssc_miou, frame) AS w FROM e)
SELECT scene, frame, ROUND(ssc_miou, 6) AS ssc_miou, CAST(b AS INT) AS rk, 'best' AS which FROM x WHERE b <= 2 UNION ALL SELECT scene, frame, ROUND(ssc_miou, 6), CAST(w AS INT), 'worst' FROM x WHERE w <= 2""")
def scene_ends(t):
    e = A.eligible_ends(scores(t), 2, 150, 5)
    return r(e.select("scene", "frame", "ssc_miou", "rk", "which"), 6, "ssc_miou")


@query("overall_ends", "E29", FRAME_SQL + """
SELECT frame, ROUND(margin, 6) AS margin, rk, which FROM (
 (SELECT frame, margin, CAST(ROW_NUMBER() OVER (ORDER BY margin DESC, frame) AS INT) AS rk, 'best' AS which FROM s)
 UNION ALL (SELECT frame, margin, CAST(ROW_NUMBER() OVER (ORDER BY margin, frame) AS INT), 'worst' FROM s)) q WHERE rk <= 5""")
def overall_ends(t):
    s = cut(S.frame_scores(t.fx_voxels))
    ends = [s.orderBy(o, "frame").limit(5).withColumn("which", F.lit(w)) for o, w in ((F.desc("margin"), "best"), (F.asc("margin"), "worst"))]
    from pyspark.sql import Window as W
    k = ends[0].unionByName(ends[1])  # ten rows
    sign = F.when(F.col("which") == "best", -F.col("margin")).otherwise(F.col("margin"))
    k = k.withColumn("rk", F.row_number().over(W.partitionBy("which").orderBy(sign, "frame")))
    return r(k.select("frame", "margin", "rk", "which"), 6, "margin")


@query("score_spread", "E30", FRAME_SQL + " UNION ALL ".join(
    f"SELECT '{c}' AS name, ROUND(QUANTILE_CONT({c}, 0.1), 6) AS p10, ROUND(QUANTILE_CONT({c}, 0.5), 6) AS p50, ROUND(QUANTILE_CONT({c}, 0.9), 6) AS p90 FROM s" for c in ("sc_iou", "ssc_miou", "margin")))
def score_spread(t):
    return r(A.score_spread(cut(S.frame_scores(t.fx_voxels)), ["sc_iou", "ssc_miou", "margin"]), 6, "p10", "p50", "p90")


@query("floor_tilt", "E32", """
WITH m AS (SELECT frame, COUNT(*) AS n, COVAR_POP(gz, gz) AS zz, COVAR_POP(gx, gx) AS xx, COVAR_POP(gz, gx) AS zx, COVAR_POP(gz, gy) AS zy, COVAR_POP(gx, gy) AS xy FROM fx_voxels WHERE label = 2 GROUP BY frame),
c AS (SELECT frame, n, (zy*xx - xy*zx) / NULLIF(zz*xx - zx*zx, 0) AS a, (xy*zz - zy*zx) / NULLIF(zz*xx - zx*zx, 0) AS b FROM m)
SELECT frame, n, ROUND(CASE WHEN n >= 40 THEN DEGREES(ACOS(1 / SQRT(a*a + b*b + 1))) END, 5) AS tilt_deg FROM c""")
def floor_tilt(t):
    return r(A.floor_tilt(t.fx_voxels, 40), 5, "tilt_deg")


def logits(t):
    d = lambda a, b: F.transform(F.slice("embedding", a, b - a + 1), lambda x: x.cast("double"))
    return t.embeddings.select("vec_id", F.floor(F.col("vec_id") / 250).alias("sample"), "label", d(1, 32).alias("student"), d(33, 64).alias("teacher"))


LOG = """l AS (SELECT vec_id, CAST(FLOOR(vec_id / 250) AS BIGINT) AS sample, label, CAST(embedding[1:32] AS DOUBLE[]) AS s, CAST(embedding[33:64] AS DOUBLE[]) AS t FROM embeddings)"""


@query("argmax_labels", "E34", f"WITH {LOG} SELECT vec_id, CAST(list_position(s, list_max(s)) - 1 AS INT) AS cls, list_position(s, list_max(s)) > 1 AS occupied FROM l")
def argmax_labels(t):
    a = logits(t).select("vec_id", A.argmax(F.col("student")).alias("cls"))
    return a.withColumn("occupied", F.col("cls") > 0)


@query("smoothed_cross_entropy", "E35", f"""WITH {LOG}, p AS (SELECT vec_id, label, UNNEST(range(32)) AS i, UNNEST(s) AS v, list_max(s) AS m, s FROM l WHERE label <> 0),
z AS (SELECT vec_id, LN(SUM(EXP(v - m))) + MAX(m) AS lse FROM p GROUP BY vec_id),
q AS (SELECT p.vec_id, SUM(-(v - lse) * CASE WHEN i = label THEN 0.8 ELSE 0.2 / 31 END) AS loss FROM p JOIN z ON p.vec_id = z.vec_id GROUP BY p.vec_id)
SELECT COUNT(*) AS n, ROUND(AVG(loss), 6) AS loss FROM q""")
def smoothed_cross_entropy(t):
    return r(A.smoothed_cross_entropy(logits(t).select(F.col("student").alias("logits"), "label", (F.col("label") != 0).alias("mask"))), 6, "loss")


@query("running_mean", "E35", FRAME_SQL + "SELECT SUM(scored)::BIGINT AS weight, ROUND(SUM(ssc_miou * scored) / SUM(scored), 6) AS mean FROM s")
def running_mean(t):
    s = S.frame_scores(t.fx_voxels).select(F.col("scored").alias("n"), F.col("ssc_miou").alias("value"))
    return r(A.running_mean(s), 6, "mean")


def _dot(a, b):
    return f"list_inner_product({a}, {b})"


@query("distillation", "E33", f"""WITH {LOG}, e AS (SELECT sample, label, UNNEST(range(32)) AS i, UNNEST(s) AS s, UNNEST(t) AS t FROM l WHERE label BETWEEN 1 AND 11),
c AS (SELECT sample, label, i, AVG(s) AS s, AVG(t) AS t FROM e GROUP BY ALL),
n AS (SELECT sample, label, LN(SUM(EXP(s))) AS ls, LN(SUM(EXP(t))) AS lt FROM c GROUP BY ALL),
k AS (SELECT c.sample, c.label, SUM(EXP(t - lt) * ((t - lt) - (s - ls))) AS kl FROM c JOIN n ON c.sample = n.sample AND c.label = n.label GROUP BY ALL),
a AS (SELECT sample, label, list(s ORDER BY i) AS cs, list(t ORDER BY i) AS ct FROM c GROUP BY ALL),
g AS (SELECT l.sample, {_dot('l.t', 'a.ct')} / SQRT({_dot('l.t', 'l.t')} * {_dot('a.ct', 'a.ct')}) - {_dot('l.s', 'a.cs')} / SQRT({_dot('l.s', 'l.s')} * {_dot('a.cs', 'a.cs')}) AS gap
  FROM l JOIN a ON a.sample = l.sample WHERE l.label BETWEEN 1 AND 11)
SELECT k.sample, ROUND(AVG(kl), 7) AS centre_loss, ROUND((SELECT AVG(gap * gap) FROM g WHERE g.sample = k.sample), 7) AS relation_loss FROM k GROUP BY k.sample""")
def distillation(t):
    return r(A.distillation(logits(t)), 7, "centre_loss", "relation_loss")


@query("feature_mse", "E33", f"WITH {LOG}, e AS (SELECT UNNEST(s) AS s, UNNEST(t) AS t FROM l) SELECT ROUND(AVG((s - t) * (s - t)), 8) AS mse FROM e")
def feature_mse(t):
    return r(A.feature_mse(logits(t)), 8, "mse")


@query("frame_candidates", "E36", f"""WITH {VIEW_SQL}, s AS (SELECT frame, AVG((wz < 0.12)::INT) * 100 AS floor_pct, AVG((z < 1.6)::INT) * 100 AS near_pct, AVG((z > 2.5)::INT) * 100 AS far_pct FROM pts GROUP BY frame)
SELECT frame, ROUND(floor_pct, 6) AS floor_pct, ROUND(near_pct, 6) AS near_pct, ROUND(far_pct, 6) AS far_pct, ROUND(floor_pct + LEAST(near_pct, far_pct), 6) AS score FROM s ORDER BY floor_pct + LEAST(near_pct, far_pct) DESC, frame LIMIT 20""")
def frame_candidates(t):
    p = V.world_points(t.fx_depth, t.fx_frames)
    s = p.groupBy("frame").agg(*[(100.0 * F.avg(c.cast("int"))).alias(n) for n, c in (
        ("floor_pct", F.col("wz") < 0.12), ("near_pct", F.col("z") < 1.6), ("far_pct", F.col("z") > 2.5))])
    return r(A.frame_candidates(s, 20), 6, "floor_pct", "near_pct", "far_pct", "score")
