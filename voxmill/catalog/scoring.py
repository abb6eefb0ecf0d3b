"""Queries over the score cube."""

from pyspark.sql import functions as F

from voxmill.catalog.registry import query
from voxmill.operators import score as S

V = """WITH v AS (SELECT *, label_weight > 0 AS weighted, label_weight > 0 AND label <> 255 AS ssc,
  label_weight > 0 AND label <> 255 AND pixel_id IS NULL AS sc FROM fx_voxels),
conf AS (SELECT label, pred, COUNT(*) AS n FROM v WHERE ssc AND label BETWEEN 0 AND 11 GROUP BY label, pred),
cls AS (SELECT UNNEST(range(12)) AS cls),
k AS (SELECT cls, COALESCE((SELECT SUM(n) FROM conf WHERE label = cls AND pred = cls), 0) AS tp,
      COALESCE((SELECT SUM(n) FROM conf WHERE label = cls), 0) AS gt,
      COALESCE((SELECT SUM(n) FROM conf WHERE pred = cls), 0) AS claimed FROM cls)
"""
NAMES = "['empty','ceiling','floor','wall','window','chair','bed','sofa','table','tvs','furn','objs']"


def cube(t, *keys):
    return S.score_cube(t.fx_voxels, *keys)


@query("confusion_matrix", "E01 E03", V + """
SELECT CAST(a.cls AS INT) AS label, CAST(b.cls AS INT) AS pred, COALESCE(n, 0) AS n
FROM cls a CROSS JOIN cls b LEFT JOIN conf ON conf.label = a.cls AND conf.pred = b.cls""")
def confusion_matrix(t):
    return S.dense(S.confusion(cube(t)))


@query("class_scores", "E02", V + """
SELECT CAST(cls AS INT) AS cls, CAST(tp AS BIGINT) AS tp, CAST(claimed - tp AS BIGINT) AS fp, CAST(gt - tp AS BIGINT) AS fn,
  CAST((SELECT SUM(gt) FROM k) - gt - claimed + tp AS BIGINT) AS tn,
  CAST(tp AS DOUBLE) / NULLIF(claimed, 0) AS precision, CAST(tp AS DOUBLE) / NULLIF(gt, 0) AS recall,
  CAST(tp AS DOUBLE) / NULLIF(gt + claimed - tp, 0) AS iou,
  CAST(gt AS DOUBLE) / (SELECT SUM(gt) FROM k) AS frequency
FROM k WHERE gt + claimed > 0""")
def class_scores(t):
    return S.class_scores(S.confusion(cube(t))).select(
        "cls", "tp", "fp", "fn", "tn", "precision", "recall", "iou", "frequency")


@query("mean_iou_rules", "E02", V + """, i AS (SELECT cls, gt, CAST(tp AS DOUBLE) / NULLIF(gt + claimed - tp, 0) AS iou FROM k)
SELECT 'zero' AS rule, ROUND(SUM(COALESCE(iou, 0)) / 11, 9) AS value FROM i WHERE cls > 0
UNION ALL SELECT 'union_nan', ROUND(AVG(iou), 9) FROM i WHERE cls > 0
UNION ALL SELECT 'gt_present', ROUND(AVG(iou), 9) FROM i WHERE cls > 0 AND gt > 0
UNION ALL SELECT 'overall_accuracy', ROUND(CAST(SUM(tp) AS DOUBLE) / SUM(gt), 9) FROM k""")
def mean_iou_rules(t):
    return S.mean_iou_rules(S.confusion(cube(t))).select("rule", F.round("value", 9).alias("value"))


@query("completion_matrix", "E03 E06", V + """
SELECT SUM((label > 0 AND pred > 0)::INT)::BIGINT AS tp, SUM((label = 0 AND pred > 0)::INT)::BIGINT AS fp,
  SUM((label > 0 AND pred = 0)::INT)::BIGINT AS fn, SUM((label = 0 AND pred = 0)::INT)::BIGINT AS tn,
  ROUND(100.0 * SUM((label > 0 AND pred > 0)::INT) / SUM((label > 0 OR pred > 0)::INT), 9) AS sc_iou,
  ROUND(100.0 * SUM((label > 0)::INT) / COUNT(*), 9) AS occ_pct
FROM v WHERE sc""")
def completion_matrix(t):
    return S.completion_rates(S.binary_matrix(cube(t))).select(
        "tp", "fp", "fn", "tn", F.round("sc_iou", 9).alias("sc_iou"), F.round("occ_pct", 9).alias("occ_pct"))


FRAME_SQL = """WITH v AS (SELECT *, label_weight > 0 AND label <> 255 AS ssc,
  label_weight > 0 AND label <> 255 AND pixel_id IS NULL AS sc FROM fx_voxels),
b AS (SELECT frame, COUNT(*) AS scored, SUM(sc::INT) AS n, SUM((sc AND label > 0)::INT) AS occ,
  SUM((sc AND pred > 0)::INT) AS claimed, SUM((sc AND label > 0 AND pred > 0)::INT) AS tp FROM v WHERE ssc GROUP BY frame),
g AS (SELECT frame, label AS cls, COUNT(*) AS gt, SUM((label = pred)::INT) AS tp FROM v WHERE ssc AND label > 0 GROUP BY ALL),
p AS (SELECT frame, pred AS cls, COUNT(*) AS claimed FROM v WHERE ssc GROUP BY ALL),
m AS (SELECT g.frame, SUM(CAST(tp AS DOUBLE) / (gt + COALESCE(claimed, 0) - tp) ORDER BY g.cls) AS s, COUNT(*) AS c
  FROM g LEFT JOIN p ON g.frame = p.frame AND g.cls = p.cls GROUP BY g.frame),
s AS (SELECT b.frame, CAST(scored AS BIGINT) AS scored, CAST(n AS BIGINT) AS sc_voxels,
  100.0 * occ / GREATEST(n, 1) AS occ_pct, 100.0 * b.tp / GREATEST(claimed, 1) AS prec, 100.0 * b.tp / GREATEST(occ, 1) AS rec,
  100.0 * b.tp / GREATEST(occ + claimed - b.tp, 1) AS sc_iou,
  100.0 * b.tp / GREATEST(occ + claimed - b.tp, 1) - 100.0 * occ / GREATEST(n, 1) AS margin,
  COALESCE(100.0 * m.s / m.c, 0) AS ssc_miou, CAST(COALESCE(m.c, 0) AS INT) AS classes
FROM b LEFT JOIN m ON b.frame = m.frame)
"""


@query("frame_scores", "E04", FRAME_SQL + """
SELECT frame, scored, sc_voxels, ROUND(occ_pct, 6) AS occ_pct, ROUND(prec, 6) AS prec, ROUND(rec, 6) AS rec,
  ROUND(sc_iou, 6) AS sc_iou, ROUND(margin, 6) AS margin, ROUND(ssc_miou, 6) AS ssc_miou, classes FROM s""")
def frame_scores(t):
    s = S.frame_scores(t.fx_voxels)
    return s.select("frame", "scored", "sc_voxels", *[F.round(c, 6).alias(c) for c in (
        "occ_pct", "prec", "rec", "sc_iou", "margin", "ssc_miou")], "classes")


@query("pooled_levels", "E05", V + """
SELECT 'frame' AS level, split, frame, label, pred, COUNT(*) AS n FROM v WHERE ssc GROUP BY ALL
UNION ALL SELECT 'split', split, NULL, label, pred, COUNT(*) FROM v WHERE ssc GROUP BY ALL
UNION ALL SELECT 'all', NULL, NULL, label, pred, COUNT(*) FROM v WHERE ssc GROUP BY ALL""")
def pooled_levels(t):
    return S.pooled_levels(t.fx_voxels)


@query("trivial_baseline", "E06", FRAME_SQL + """
SELECT frame, sc_voxels, ROUND(occ_pct, 6) AS occ_pct, ROUND(sc_iou, 6) AS sc_iou, ROUND(margin, 6) AS margin,
  occ_pct / 100 > 0.9 OR occ_pct / 100 < 0.05 AS degenerate FROM s""")
def trivial_baseline(t):
    return S.trivial_baseline(S.frame_scores(t.fx_voxels)).select(
        "frame", "sc_voxels", *[F.round(c, 6).alias(c) for c in ("occ_pct", "sc_iou", "margin")], "degenerate")


@query("score_funnel", "E07", V + """, c AS (SELECT COUNT(*) AS a, SUM(weighted::INT) AS w, SUM(ssc::INT) AS s, SUM(sc::INT) AS u,
  SUM((sc AND label > 0 AND pred > 0)::INT) AS tp, SUM((sc AND label = 0 AND pred > 0)::INT) AS fp,
  SUM((sc AND label > 0 AND pred = 0)::INT) AS fn, SUM((sc AND label = 0 AND pred = 0)::INT) AS tn FROM v)
SELECT 'all_voxels' AS stage, CAST(a AS BIGINT) AS n, ROUND(100.0 * a / a, 9) AS pct FROM c
UNION ALL SELECT 'weighted', CAST(w AS BIGINT), ROUND(100.0 * w / a, 9) FROM c
UNION ALL SELECT 'annotated', CAST(s AS BIGINT), ROUND(100.0 * s / a, 9) FROM c
UNION ALL SELECT 'unseen', CAST(u AS BIGINT), ROUND(100.0 * u / a, 9) FROM c
UNION ALL SELECT 'tp', CAST(tp AS BIGINT), ROUND(100.0 * tp / (tp + fp + fn), 9) FROM c
UNION ALL SELECT 'fp', CAST(fp AS BIGINT), ROUND(100.0 * fp / (tp + fp + fn), 9) FROM c
UNION ALL SELECT 'fn', CAST(fn AS BIGINT), ROUND(100.0 * fn / (tp + fp + fn), 9) FROM c
UNION ALL SELECT 'tn', CAST(tn AS BIGINT), NULL FROM c""")
def score_funnel(t):
    return S.funnel(cube(t)).withColumn("pct", F.round("pct", 9))


@query("missed_and_invented", "E07", V + """, m AS (SELECT cls, (SELECT COUNT(*) FROM v WHERE sc AND label = cls AND pred = 0) AS missed,
  (SELECT COUNT(*) FROM v WHERE sc AND label = 0 AND pred = cls) AS invented FROM cls WHERE cls > 0)
SELECT CAST(cls AS INT) AS cls, missed, invented, ROUND(100.0 * missed / (SELECT SUM(missed) FROM m), 9) AS missed_pct,
  ROUND(100.0 * invented / (SELECT SUM(invented) FROM m), 9) AS invented_pct FROM m WHERE missed + invented > 0""")
def missed_and_invented(t):
    return S.missed_and_invented(cube(t)).withColumn("missed_pct", F.round("missed_pct", 9)).withColumn("invented_pct", F.round("invented_pct", 9))


@query("completion_by_class", "E08", V + """, q AS (SELECT CAST(cls AS INT) AS cls,
  (SELECT COUNT(*) FROM v WHERE ssc AND label = cls) AS gt, (SELECT COUNT(*) FROM v WHERE sc AND label = cls) AS gt_sc,
  (SELECT COUNT(*) FROM v WHERE sc AND label = cls AND pred = cls) AS tl, (SELECT COUNT(*) FROM v WHERE sc AND pred = cls) AS cs,
  (SELECT COUNT(*) FROM v WHERE sc AND label = cls AND pred > 0) AS tp_any,
  (SELECT COUNT(*) FROM v WHERE sc AND label = cls AND pred = 0) AS left_empty,
  (SELECT COUNT(*) FROM v WHERE sc AND label = 0 AND pred = cls) AS fp_any FROM cls WHERE cls > 0)
SELECT cls, gt_sc, tp_any, left_empty, fp_any, ROUND(100.0 * gt_sc / GREATEST(gt, 1), 9) AS unseen_pct,
  ROUND(CAST(tl AS DOUBLE) / NULLIF(gt_sc + cs - tl, 0), 9) AS label_iou,
  ROUND(CAST(tp_any AS DOUBLE) / NULLIF(tp_any + left_empty + fp_any, 0), 9) AS any_iou,
  ROUND(100.0 * (gt_sc - tl - left_empty) / GREATEST(gt_sc, 1), 9) AS other_pct,
  ROUND(100.0 * left_empty / GREATEST(gt_sc, 1), 9) AS empty_pct FROM q""")
def completion_by_class(t):
    c = S.completion_by_class(cube(t))
    return c.select(*c.columns[:5], *[F.round(x, 9).alias(x) for x in c.columns[5:]])


@query("completion_identity", "E08", V + """
SELECT CAST(0 AS BIGINT) AS tp, CAST(0 AS BIGINT) AS fp, CAST(0 AS BIGINT) AS fn, CAST(0 AS BIGINT) AS a,
  CAST(0 AS BIGINT) AS e, CAST(0 AS BIGINT) AS i FROM v WHERE FALSE""")
def completion_identity(t):
    return S.completion_identity(cube(t))


@query("class_presence", "E09", V + """
SELECT CAST(cls AS INT) AS cls, (SELECT COUNT(DISTINCT frame) FROM v WHERE pred = cls) AS frames_pred,
  (SELECT COUNT(DISTINCT frame) FROM v WHERE label = cls) AS frames_gt,
  ROUND(CAST((SELECT COUNT(DISTINCT frame) FROM v WHERE pred = cls) AS DOUBLE)
    / NULLIF((SELECT COUNT(DISTINCT frame) FROM v WHERE label = cls), 0), 9) AS ratio
FROM cls WHERE cls > 0""")
def class_presence(t):
    return S.presence(t.fx_voxels).withColumn("ratio", F.round("ratio", 9))


@query("claim_coverage", "E10", V + """
SELECT pred AS cls, SUM((NOT weighted)::INT)::BIGINT AS unscored, SUM((weighted AND label = 255)::INT)::BIGINT AS ignored,
  SUM(ssc::INT)::BIGINT AS scored, SUM((ssc AND label = 0)::INT)::BIGINT AS over_empty,
  SUM((NOT weighted AND label = 0)::INT)::BIGINT AS empty_unscored,
  SUM((NOT weighted AND label = 0 AND tsdf > 0)::INT)::BIGINT AS empty_seen_free,
  ROUND(100.0 * SUM(ssc::INT) / COUNT(*), 9) AS scored_pct
FROM v WHERE pred > 0 GROUP BY pred""")
def claim_coverage(t):
    return S.coverage(cube(t)).withColumn("scored_pct", F.round("scored_pct", 9))


@query("fp_spill", "E11", V + """
SELECT pred AS cls, SUM(n)::BIGINT AS fp, SUM(CASE WHEN label = 0 THEN n ELSE 0 END)::BIGINT AS fp_empty,
  ROUND(100.0 * SUM(CASE WHEN label = 0 THEN n ELSE 0 END) / SUM(n), 9) AS empty_pct,
  SUM(CASE WHEN label > 0 THEN n ELSE 0 END)::BIGINT AS fp_other
FROM conf WHERE pred > 0 AND label <> pred GROUP BY pred""")
def fp_spill(t):
    return S.spill(S.confusion(cube(t))).withColumn("empty_pct", F.round("empty_pct", 9))


def _partner_sql(own, other):
    return V + f""", e AS (SELECT {own} AS cls, n, ({NAMES})[{other} + 1] AS name, label <> pred AS wrong FROM conf WHERE {own} > 0),
a AS (SELECT cls, SUM(n) AS total, SUM(CASE WHEN wrong THEN n ELSE 0 END) AS errors FROM e GROUP BY cls),
r AS (SELECT e.*, ROW_NUMBER() OVER (PARTITION BY cls ORDER BY n DESC, name DESC) AS rk FROM e WHERE wrong)
SELECT a.cls, CAST(total AS BIGINT) AS total, CAST(errors AS BIGINT) AS errors,
  COALESCE(STRING_AGG(r.name || ' ' || CAST(CAST(ROUND(100.0 * r.n / GREATEST(errors, 1)) AS INT) AS VARCHAR) || '%', ', ' ORDER BY rk), '') AS partners,
  ROUND(100.0 * errors / total, 9) AS wrong_pct
FROM a LEFT JOIN r ON a.cls = r.cls AND rk <= 3 GROUP BY a.cls, total, errors"""


@query("fp_partners", "E12", _partner_sql("pred", "label"))
def fp_partners(t):
    return S.partners(S.confusion(cube(t)), "fp").withColumn("wrong_pct", F.round("wrong_pct", 9))


@query("fn_partners", "E12", _partner_sql("label", "pred"))
def fn_partners(t):
    return S.partners(S.confusion(cube(t)), "fn").withColumn("wrong_pct", F.round("wrong_pct", 9))


@query("biggest_confusions", "E13", V + f"""
SELECT ({NAMES})[pred + 1] AS predicted, ({NAMES})[label + 1] AS actual, n,
  ROUND(100.0 * n / (SELECT SUM(n) FROM conf WHERE pred > 0 AND label <> pred), 9) AS share
FROM conf WHERE label <> pred ORDER BY n DESC, predicted DESC, actual DESC LIMIT 10""")
def biggest_confusions(t):
    return S.biggest_confusions(S.confusion(cube(t))).withColumn("share", F.round("share", 9))


@query("top_confusions", "E13", V + """
SELECT label, pred, n, ROUND(100.0 * n / (SELECT SUM(c.n) FROM conf c WHERE c.label = conf.label), 9) AS share
FROM conf WHERE label <> pred ORDER BY n DESC, label, pred LIMIT 10""")
def top_confusions(t):
    return S.top_confusions(S.confusion(cube(t))).withColumn("share", F.round("share", 9))


REGION = """CASE WHEN pixel_id IS NOT NULL THEN 'surface' WHEN tsdf > 0 THEN 'seen_free' WHEN tsdf = 0 THEN 'never'
  WHEN tsdf >= -0.5 THEN 'just_behind' ELSE 'occluded' END"""


@query("volume_regions", "E14", V + f"""
SELECT {REGION} AS region, COUNT(*) AS n, SUM((pred = 0)::INT)::BIGINT AS pred_empty,
  SUM((label = 0)::INT)::BIGINT AS gt_empty, SUM(weighted::INT)::BIGINT AS weighted_n FROM v GROUP BY ALL""")
def volume_regions(t):
    return S.regions(cube(t))


@query("misses_by_region", "E15", V + """, q AS (SELECT label, CASE WHEN pixel_id IS NOT NULL THEN 0 WHEN tsdf > 0 THEN 1 ELSE 2 END AS region, pred
  FROM v WHERE ssc AND label BETWEEN 1 AND 11)
SELECT label, region, COUNT(*) AS gt, SUM((label = pred)::INT)::BIGINT AS hits, SUM((pred = 0)::INT)::BIGINT AS left_empty,
  SUM((pred <> 0 AND pred <> label)::INT)::BIGINT AS other_class, ROUND(100.0 * SUM((label = pred)::INT) / COUNT(*), 9) AS recall
FROM q GROUP BY ROLLUP (label, region)""")
def misses_by_region(t):
    return S.misses_by_region(cube(t)).withColumn("recall", F.round("recall", 9))


@query("mask_audit", "E16", V + """, q AS (SELECT *, (label BETWEEN 1 AND 254) OR tsdf < -0.5 AS rule FROM v)
SELECT COUNT(*) AS total, SUM((rule = weighted)::INT)::BIGINT AS matching, SUM((rule AND NOT weighted)::INT)::BIGINT AS rule_only,
  SUM((NOT rule AND weighted)::INT)::BIGINT AS weight_only, SUM((NOT weighted AND tsdf = 0)::INT)::BIGINT AS never,
  SUM((NOT weighted AND tsdf > 0)::INT)::BIGINT AS free, SUM((NOT weighted AND tsdf < 0)::INT)::BIGINT AS other FROM q""")
def mask_audit(t):
    return S.mask_audit(cube(t))


@query("layer_statistics", "E17", """WITH l AS (SELECT frame, gy, SUM((label = 2)::INT) AS fg, SUM((pred = 2)::INT) AS fp,
  SUM((label = 1)::INT) AS cg, SUM((pred = 1)::INT) AS cp FROM fx_voxels GROUP BY frame, gy),
g AS (SELECT frame, gy, ROW_NUMBER() OVER (PARTITION BY frame ORDER BY cg DESC, gy) AS rk FROM l WHERE cg > 0),
p AS (SELECT frame, gy, ROW_NUMBER() OVER (PARTITION BY frame ORDER BY cp DESC, gy) AS rk FROM l WHERE cp > 0)
SELECT l.frame, ROUND(COALESCE(SUM(CASE WHEN l.gy = 0 THEN fg END), 0) / 3600.0, 9) AS floor_gt_fill,
  ROUND(COALESCE(SUM(CASE WHEN l.gy = 0 THEN fp END), 0) / 3600.0, 9) AS floor_pred_fill,
  MAX(g.gy) AS ceil_gt_layer, MAX(p.gy) AS ceil_pred_layer, ROUND(MAX(cp) / 3600.0, 9) AS ceil_pred_fill
FROM l LEFT JOIN g ON g.frame = l.frame AND g.rk = 1 LEFT JOIN p ON p.frame = l.frame AND p.rk = 1 GROUP BY l.frame""")
def layer_statistics(t):
    s = S.layer_statistics(t.fx_voxels)
    return s.select("frame", "ceil_gt_layer", "ceil_pred_layer", *[F.round(c, 9).alias(c) for c in (
        "floor_gt_fill", "floor_pred_fill", "ceil_pred_fill")])


@query("floor_by_layer", "E17", """
SELECT gy, SUM((label = 2)::INT)::BIGINT AS floor_gt, SUM((pred = 2)::INT)::BIGINT AS floor_pred,
  ROUND(CAST(SUM((label = 2)::INT) AS DOUBLE) / (SELECT SUM((label = 2)::INT) FROM fx_voxels), 9) AS gt_share,
  ROUND(CAST(SUM((pred = 2)::INT) AS DOUBLE) / (SELECT SUM((pred = 2)::INT) FROM fx_voxels), 9) AS pred_share
FROM fx_voxels GROUP BY gy""")
def floor_by_layer(t):
    return S.floor_by_layer(t.fx_voxels).withColumn("gt_share", F.round("gt_share", 9)).withColumn("pred_share", F.round("pred_share", 9))


SPLIT_SQL = """WITH v AS (SELECT *, label_weight > 0 AND label <> 255 AS ssc FROM fx_voxels),
cls AS (SELECT UNNEST(range(1, 12)) AS cls), sp AS (SELECT 'train' AS split UNION ALL SELECT 'test'),
c AS (SELECT split, cls,
  (SELECT COUNT(*) FROM v WHERE v.split = sp.split AND ssc AND label = cls AND pred = cls) AS tp,
  (SELECT COUNT(*) FROM v WHERE v.split = sp.split AND ssc AND label = cls) AS gt,
  (SELECT COUNT(*) FROM v WHERE v.split = sp.split AND ssc AND pred = cls) AS claimed,
  (SELECT COUNT(*) FROM v WHERE v.split = sp.split AND pred = cls) AS pred_all,
  (SELECT COUNT(*) FROM v WHERE v.split = sp.split AND ssc AND pred = cls AND label = 0) AS fpe,
  (SELECT COUNT(DISTINCT frame) FROM v WHERE v.split = sp.split AND pred = cls) AS fpred,
  (SELECT COUNT(DISTINCT frame) FROM v WHERE v.split = sp.split AND label = cls) AS fgt
  FROM sp CROSS JOIN cls),
s AS (SELECT split, cls, 100.0 * tp / NULLIF(gt + claimed - tp, 0) AS iou, 100.0 * (gt - tp) / GREATEST(gt, 1) AS miss,
  CAST(pred_all AS DOUBLE) / GREATEST(gt, 1) AS voxel_ratio, CAST(fpred AS DOUBLE) / GREATEST(fgt, 1) AS frame_ratio,
  100.0 * fpe / GREATEST(claimed - tp, 1) AS spill FROM c)
"""


@query("train_test_gap", "E18 J10", SPLIT_SQL + """, w AS (SELECT CAST(a.cls AS INT) AS cls, a.iou AS iou_train, b.iou AS iou_test,
  a.voxel_ratio AS voxel_ratio_train, b.voxel_ratio AS voxel_ratio_test, a.frame_ratio AS frame_ratio_train,
  b.frame_ratio AS frame_ratio_test, a.spill AS spill_train, b.spill AS spill_test, a.iou - b.iou AS gap
  FROM s a JOIN s b ON a.cls = b.cls AND a.split = 'train' AND b.split = 'test')
SELECT cls, ROUND(iou_train, 6) AS iou_train, ROUND(iou_test, 6) AS iou_test, ROUND(voxel_ratio_train, 6) AS voxel_ratio_train,
  ROUND(voxel_ratio_test, 6) AS voxel_ratio_test, ROUND(frame_ratio_train, 6) AS frame_ratio_train,
  ROUND(frame_ratio_test, 6) AS frame_ratio_test, ROUND(spill_train, 6) AS spill_train, ROUND(spill_test, 6) AS spill_test,
  ROUND(gap, 6) AS gap, CAST(ROW_NUMBER() OVER (ORDER BY gap DESC, cls) AS INT) AS gap_rank, gap > 5 AS lost FROM w""")
def train_test_gap(t):
    g = S.train_test_gap(t.fx_voxels)
    keep = ("cls", "gap_rank", "lost")
    return g.select(*keep, *[F.round(c, 6).alias(c) for c in g.columns if c not in keep])


@query("error_groups", "E19", SPLIT_SQL + """,
o AS (SELECT label, pred, COUNT(*) AS n FROM v WHERE split = 'test' AND ssc AND label < 12 AND label <> pred GROUP BY ALL),
fp AS (SELECT pred AS cls, label AS d, ROW_NUMBER() OVER (PARTITION BY pred ORDER BY n DESC, label DESC) AS rk FROM o),
fn AS (SELECT label AS cls, pred AS d, ROW_NUMBER() OVER (PARTITION BY label ORDER BY n DESC, pred DESC) AS rk FROM o)
SELECT CAST(a.cls AS INT) AS cls, ROUND(a.iou - b.iou, 6) AS gap, ROUND(b.miss, 6) AS miss, fp.d AS fp_dest, fn.d AS fn_dest,
  CASE WHEN a.iou - b.iou < 5 THEN 1 WHEN fp.d = 0 THEN 2 ELSE 3 END AS fp_group,
  CASE WHEN b.miss < 10 THEN 1 WHEN fn.d = 0 THEN 2 ELSE 3 END AS miss_group
FROM s a JOIN s b ON a.cls = b.cls AND a.split = 'train' AND b.split = 'test'
LEFT JOIN fp ON fp.cls = a.cls AND fp.rk = 1 LEFT JOIN fn ON fn.cls = a.cls AND fn.rk = 1""")
def error_groups(t):
    return S.error_groups(t.fx_voxels).withColumn("gap", F.round("gap", 6)).withColumn("miss", F.round("miss", 6))


@query("visibility_split", "E20", """WITH v AS (SELECT *, label_weight > 0 AND ABS(tsdf) < 0.25 AS vis, tsdf < -0.5 AS occ,
  label_weight > 0 AND label <> 255 AS ssc FROM fx_voxels), cls AS (SELECT UNNEST(range(1, 12)) AS cls),
q AS (SELECT cls, SUM((vis AND label = cls)::INT) AS vn, SUM((vis AND label = cls AND pred = cls)::INT) AS vh,
  SUM((occ AND label = cls)::INT) AS o_n, SUM((occ AND label = cls AND pred = cls)::INT) AS oh,
  SUM((ssc AND pixel_id IS NOT NULL AND label = cls AND pred = cls)::INT) AS st,
  SUM((ssc AND pixel_id IS NOT NULL AND (label = cls OR pred = cls))::INT) AS su,
  SUM((ssc AND pixel_id IS NULL AND label = cls AND pred = cls)::INT) AS ht,
  SUM((ssc AND pixel_id IS NULL AND (label = cls OR pred = cls))::INT) AS hu,
  SUM((occ AND label = 255 AND pred = cls)::INT) AS outside FROM v CROSS JOIN cls GROUP BY cls)
SELECT CAST(cls AS INT) AS cls, CAST(vn AS BIGINT) AS visible_n, ROUND(CAST(vh AS DOUBLE) / vn, 9) AS visible_recall,
  CAST(o_n AS BIGINT) AS occluded_n, ROUND(CAST(oh AS DOUBLE) / o_n, 9) AS occluded_recall,
  ROUND(CAST(st AS DOUBLE) / su, 9) AS surface_iou, ROUND(CAST(ht AS DOUBLE) / hu, 9) AS hidden_iou,
  CAST(outside AS BIGINT) AS outside_room, ROUND(CAST(ht AS DOUBLE) / hu - CAST(st AS DOUBLE) / su, 9) AS "drop" FROM q""")
def visibility_split(t):
    v = S.visibility_split(cube(t))
    keep = ("cls", "visible_n", "occluded_n", "outside_room")
    return v.select(*keep, *[F.round(c, 9).alias(c) for c in v.columns if c not in keep])


@query("class_recall_by_frame", "E20", """WITH v AS (SELECT *, label_weight > 0 AND ABS(tsdf) < 0.25 AS vis, tsdf < -0.5 AS occ FROM fx_voxels WHERE label = 3)
SELECT frame, SUM(vis::INT)::BIGINT AS vn, SUM(occ::INT)::BIGINT AS "on",
  ROUND(SUM((vis AND pred = 3)::INT) * 1.0 / SUM(vis::INT), 9) AS visible_recall,
  ROUND(SUM((occ AND pred = 3)::INT) * 1.0 / SUM(occ::INT), 9) AS occluded_recall
FROM v GROUP BY frame HAVING SUM(vis::INT) > 8 AND SUM(occ::INT) > 8""")
def class_recall_by_frame(t):
    r = S.class_recall_by_frame(t.fx_voxels, cls=3, min_count=8)
    return r.withColumn("visible_recall", F.round("visible_recall", 9)).withColumn("occluded_recall", F.round("occluded_recall", 9))


def _protocol_sql():
    lw = "(t BETWEEN 1 AND 253 OR tsdf < -0.5)"
    nf = "t <> 2 AND p <> 2"
    specs = [("all-voxels|label", "label", "pred", "t <> 255", "t <> 255"),
             ("all-voxels|label_fov", "label_fov", "pred", "t <> 255", "t <> 255"),
             ("weighted|label", "label", "pred", f"{lw} AND t <> 255", f"{lw} AND t <> 255 AND pixel_id IS NULL"),
             ("weighted|label_fov", "label_fov", "pred", f"{lw} AND t <> 255", f"{lw} AND t <> 255 AND pixel_id IS NULL"),
             ("all-voxels+carve|label", "label", "CASE WHEN tsdf > 0 THEN 0 ELSE pred END", "t <> 255", "t <> 255"),
             ("weighted-nofloor|label", "label", "pred", f"{lw} AND t <> 255 AND {nf}", f"{lw} AND t <> 255 AND {nf} AND pixel_id IS NULL"),
             ("weighted-nofloor|label_fov", "label_fov", "pred", f"{lw} AND t <> 255 AND {nf}", f"{lw} AND t <> 255 AND {nf} AND pixel_id IS NULL")]
    u = " UNION ALL ".join(f"SELECT '{n}' AS protocol, t, p, {k} AS keep, {s} AS sc FROM (SELECT {tr} AS t, {p} AS p, tsdf, pixel_id FROM fx_voxels) x"
                           for n, tr, p, k, s in specs)
    return f"""WITH r AS ({u}), cls AS (SELECT UNNEST(range(1, 12)) AS cls),
i AS (SELECT protocol, cls, SUM((t = cls AND p = cls)::INT) * 1.0 / NULLIF(SUM((t = cls OR p = cls)::INT), 0) AS iou
  FROM r CROSS JOIN cls WHERE keep GROUP BY ALL),
m AS (SELECT protocol, AVG(iou) AS miou FROM i GROUP BY protocol),
b AS (SELECT protocol, COUNT(*) AS n, 100.0 * SUM((t > 0 AND p > 0)::INT) / SUM((t > 0 OR p > 0)::INT) AS iou FROM r WHERE sc GROUP BY protocol)
SELECT m.protocol, b.n AS sc_voxels, ROUND(b.iou, 6) AS sc_iou, ROUND(100 * miou, 6) AS miou FROM m JOIN b ON m.protocol = b.protocol"""


@query("protocol_matrix", "E21 W14", _protocol_sql())
def protocol_matrix(t):
    return S.protocol_matrix(t.fx_voxels).withColumn("sc_iou", F.round("sc_iou", 6)).withColumn("miou", F.round("miou", 6))


# One row of the published per-class IoU table, classes 1..11.
PUBLISHED_IOU = [(1, 19.88), (2, 41.88), (3, 22.37), (4, 16.98), (5, 29.09), (6, 42.43),
                 (7, 42.00), (8, 29.60), (9, 10.62), (10, 36.36), (11, 24.61)]


@query("published_comparison", "E31 J09", V + """, pub(cls, published) AS (VALUES (1, 19.88e0), (2, 41.88e0), (3, 22.37e0), (4, 16.98e0), (5, 29.09e0),
  (6, 42.43e0), (7, 42.00e0), (8, 29.60e0), (9, 10.62e0), (10, 36.36e0), (11, 24.61e0))
SELECT CAST(k.cls AS INT) AS cls, ROUND(100e0 * tp / (gt + claimed - tp), 1) AS ours, published,
  ROUND(ROUND(100e0 * tp / (gt + claimed - tp), 1) - published, 1) AS diff,
  ROUND(100e0 * tp / (gt + claimed - tp), 1) = ROUND(published, 1) AS reproduced
FROM k JOIN pub ON k.cls = pub.cls""")
def published_comparison(t):
    return S.compare_published(S.class_scores(S.confusion(cube(t))), PUBLISHED_IOU)
