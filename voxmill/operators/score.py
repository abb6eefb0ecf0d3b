"""Scoring of labelled voxels against their annotation.

Everything is arithmetic on one aggregate, the score cube: voxel rows counted by
(keys, label, pred, seen, weighted, band). Spark combines it map-side, so a frame
or class that holds a third of the rows costs no more to shuffle than a small one,
and every table below is a small second aggregate over cube rows.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxmill.schema import CLASS_NAMES, FLOOR, IGNORE, N_CLASSES, case_of, classes

SSC = "weighted AND label <> 255"
SC = "weighted AND label <> 255 AND NOT seen"
REGION5 = ["surface", "seen_free", "just_behind", "occluded", "never"]
RULES = ("zero", "union_nan", "gt_present")


def band(tsdf: Column) -> Column:
    """Truncated distance as 6 bands: every mask cut (0, +-0.25, -0.5) is a band edge."""
    return (F.when(tsdf >= 0.25, 0).when(tsdf > 0, 1).when(tsdf == 0, 2)
            .when(tsdf > -0.25, 3).when(tsdf >= -0.5, 4).otherwise(5))


def score_cube(vox: DataFrame, *keys: str) -> DataFrame:
    return (vox.select(*keys, "label", "pred", F.col("pixel_id").isNotNull().alias("seen"),
                       (F.col("label_weight") > 0).alias("weighted"), band(F.col("tsdf")).alias("band"))
            .groupBy(*keys, "label", "pred", "seen", "weighted", "band")
            .agg(F.count(F.lit(1)).alias("n")))


def confusion(cube: DataFrame, *keys: str, where: str = SSC) -> DataFrame:
    """Long confusion matrix (keys, label, pred, n); truth outside 0..11 is dropped."""
    return (cube.filter(where).filter(F.col("label").between(0, N_CLASSES - 1))
            .groupBy(*keys, "label", "pred").agg(F.sum("n").alias("n")))


def dense(conf: DataFrame, n: int = N_CLASSES) -> DataFrame:
    """All n x n cells, zero where absent. ``conf`` has at most n*n rows."""
    cells = conf.sparkSession.range(n * n).selectExpr(
        f"cast(id div {n} as int) label", f"cast(id % {n} as int) pred")
    return (cells.join(F.broadcast(conf), ["label", "pred"], "left")
            .select("label", "pred", F.coalesce("n", F.lit(0)).alias("n")))


def class_counts(conf: DataFrame, *keys: str) -> DataFrame:
    """(keys, cls, tp, gt, claimed) from a long matrix, in one aggregate and no join."""
    sides = F.array(
        F.struct(F.col("label").alias("cls"), F.col("n").alias("gt"), F.lit(0).cast("long").alias("claimed"),
                 F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("pred").alias("cls"), F.lit(0).cast("long").alias("gt"), F.col("n").alias("claimed"),
                 F.lit(0).cast("long").alias("tp")))
    return (conf.select(*keys, F.inline(sides)).groupBy(*keys, "cls")
            .agg(F.sum("tp").alias("tp"), F.sum("gt").alias("gt"), F.sum("claimed").alias("claimed")))


def rates(counts: DataFrame) -> DataFrame:
    """fp, fn, precision, recall, iou; NULL where the denominator is zero."""
    return (counts.withColumn("fp", F.col("claimed") - F.col("tp")).withColumn("fn", F.col("gt") - F.col("tp"))
            .withColumn("precision", F.try_divide("tp", "claimed"))
            .withColumn("recall", F.try_divide("tp", "gt"))
            .withColumn("iou", F.try_divide("tp", F.col("gt") + F.col("claimed") - F.col("tp"))))


def class_scores(conf: DataFrame) -> DataFrame:
    """Per class tp/fp/fn/tn, precision, recall, iou and frequency of a pooled matrix."""
    c = rates(class_counts(conf))
    total = F.sum("gt").over(W.partitionBy())  # at most 12 rows
    return (c.withColumn("total", total)
            .withColumn("tn", F.col("total") - F.col("gt") - F.col("claimed") + F.col("tp"))
            .withColumn("frequency", F.try_divide("gt", "total")))


def mean_iou(counts: DataFrame, *keys: str, rule: str = "union_nan") -> DataFrame:
    """Mean IoU over classes 1..11. Rules: ``zero`` counts an absent class as 0,
    ``union_nan`` skips a class neither present nor claimed, ``gt_present`` needs truth."""
    c = rates(counts.filter("cls BETWEEN 1 AND 11"))
    agg = {"zero": F.coalesce(F.sum("iou"), F.lit(0.0)) / (N_CLASSES - 1),
           "union_nan": F.avg("iou"),
           "gt_present": F.coalesce(F.avg(F.when(F.col("gt") > 0, F.col("iou"))), F.lit(0.0))}[rule]
    return c.groupBy(*keys).agg(agg.alias("miou"))


def mean_iou_rules(conf: DataFrame) -> DataFrame:
    """The pooled mean under each averaging rule, plus the overall accuracy."""
    c = rates(class_counts(conf))
    body = F.col("cls") > 0
    one = c.agg(
        (F.sum(F.when(body, F.coalesce("iou", F.lit(0.0)))) / (N_CLASSES - 1)).alias("zero"),
        F.avg(F.when(body, F.col("iou"))).alias("union_nan"),
        F.avg(F.when(body & (F.col("gt") > 0), F.col("iou"))).alias("gt_present"),
        F.try_divide(F.sum("tp"), F.sum("gt")).alias("overall_accuracy"))
    return one.unpivot([], ["zero", "union_nan", "gt_present", "overall_accuracy"], "rule", "value")


def binary_matrix(cube: DataFrame, *keys: str, where: str = SC) -> DataFrame:
    """Occupied-vs-empty counts of the completion set, one row per key."""
    occ_t, occ_p = F.col("label") > 0, F.col("pred") > 0
    pick = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return cube.filter(where).groupBy(*keys).agg(
        pick(occ_t & occ_p).alias("tp"), pick(~occ_t & occ_p).alias("fp"),
        pick(occ_t & ~occ_p).alias("fn"), pick(~occ_t & ~occ_p).alias("tn"))


def completion_rates(b: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    total = tp + fp + fn + tn
    return (b.withColumn("sc_iou", 100.0 * tp / F.greatest(tp + fp + fn, F.lit(1)))
            .withColumn("prec", 100.0 * tp / F.greatest(tp + fp, F.lit(1)))
            .withColumn("rec", 100.0 * tp / F.greatest(tp + fn, F.lit(1)))
            .withColumn("occ_pct", 100.0 * (tp + fn) / F.greatest(total, F.lit(1)))
            .withColumn("sc_voxels", total))


def frame_scores(vox: DataFrame, *keys: str) -> DataFrame:
    """One score row per frame: scored, sc_voxels, occ_pct, prec, rec, sc_iou, margin, ssc_miou, classes.

    The cube collapses a frame to a few hundred rows; the second aggregate keeps
    three counters per class side by side, so nothing is joined back.
    """
    keys = keys or ("frame",)
    cube = score_cube(vox, *keys).filter(SSC)
    n = F.col("n")
    pick = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0))
    sc = ~F.col("seen")
    t, p = F.col("label") > 0, F.col("pred") > 0
    cols = [F.sum("n").alias("scored"), pick(sc & t & p).alias("tp"), pick(sc & ~t & p).alias("fp"),
            pick(sc & t & ~p).alias("fn"), pick(sc & ~t & ~p).alias("tn")]
    for c in range(1, N_CLASSES):
        cols += [pick(F.col("label") == c).alias(f"g{c}"), pick(F.col("pred") == c).alias(f"c{c}"),
                 pick((F.col("label") == c) & (F.col("pred") == c)).alias(f"t{c}")]
    w = completion_rates(cube.groupBy(*keys).agg(*cols))
    present = [(F.col(f"g{c}") > 0).cast("int") for c in range(1, N_CLASSES)]
    ious = [F.when(F.col(f"g{c}") > 0, F.col(f"t{c}") / F.greatest(
        F.col(f"g{c}") + F.col(f"c{c}") - F.col(f"t{c}"), F.lit(1))).otherwise(0.0) for c in range(1, N_CLASSES)]
    add = lambda xs: reduce(lambda a, b: a + b, xs)
    classes_n = add(present)
    return (w.withColumn("classes", classes_n)
            .withColumn("margin", F.col("sc_iou") - F.col("occ_pct"))
            .withColumn("ssc_miou", F.coalesce(F.try_divide(100.0 * add(ious), F.col("classes")), F.lit(0.0)))
            .select(*keys, "scored", "sc_voxels", "occ_pct", "prec", "rec", "sc_iou", "margin", "ssc_miou", "classes"))


def trivial_baseline(scores: DataFrame) -> DataFrame:
    """What "occupied everywhere" scores on the frame's own set, and whether the set can tell."""
    share = F.col("occ_pct") / 100
    return scores.select("frame", "sc_voxels", "occ_pct", "sc_iou", "margin",
                         ((share > 0.9) | (share < 0.05)).alias("degenerate"))


def pooled_levels(vox: DataFrame) -> DataFrame:
    """Confusion counts per frame, per split and overall, from one scan.

    Grouping sets multiply their input, so they run over the counted cells."""
    cells = (score_cube(vox, "split", "frame").filter(SSC)
             .groupBy("split", "frame", "label", "pred").agg(F.sum("n").alias("n")))
    s, f, l, p = (F.col(c) for c in ("split", "frame", "label", "pred"))
    return (cells.groupingSets([[s, f, l, p], [s, l, p], [l, p]], s, f, l, p)
            .agg(F.sum("n").alias("n"), F.grouping_id().alias("gid"))
            .select(F.when(F.col("gid") == 0, "frame").when(F.col("gid") == 4, "split").otherwise("all").alias("level"),
                    "split", "frame", "label", "pred", "n"))


def funnel(cube: DataFrame) -> DataFrame:
    """Voxels left after each scoring filter, then the completion outcome shares."""
    pick = lambda c: F.coalesce(F.sum(F.when(F.expr(c), F.col("n"))), F.lit(0))
    a = cube.agg(
        F.sum("n").alias("all_voxels"), pick("weighted").alias("weighted"), pick(SSC).alias("annotated"),
        pick(SC).alias("unseen"), pick(f"{SC} AND label > 0 AND pred > 0").alias("tp"),
        pick(f"{SC} AND label = 0 AND pred > 0").alias("fp"), pick(f"{SC} AND label > 0 AND pred = 0").alias("fn"),
        pick(f"{SC} AND label = 0 AND pred = 0").alias("tn"))
    union = F.col("tp") + F.col("fp") + F.col("fn")
    stages = ["all_voxels", "weighted", "annotated", "unseen"]
    return a.select(F.inline(F.array(
        *[F.struct(F.lit(s).alias("stage"), F.col(s).alias("n"),
                   (100.0 * F.col(s) / F.greatest("all_voxels", F.lit(1))).alias("pct")) for s in stages],
        *[F.struct(F.lit(s).alias("stage"), F.col(s).alias("n"),
                   (100.0 * F.col(s) / F.greatest(union, F.lit(1))).alias("pct")) for s in ("tp", "fp", "fn")],
        F.struct(F.lit("tn").alias("stage"), F.col("tn").alias("n"), F.lit(None).cast("double").alias("pct")))))


def missed_and_invented(cube: DataFrame) -> DataFrame:
    """Per class: truth left empty, and claims over empty, in the completion set."""
    c = confusion(cube, where=SC)
    side = c.filter("(pred = 0) <> (label = 0)").select(
        F.greatest("label", "pred").alias("cls"),
        F.when(F.col("pred") == 0, F.col("n")).otherwise(0).alias("missed"),
        F.when(F.col("label") == 0, F.col("n")).otherwise(0).alias("invented"))
    t = side.groupBy("cls").agg(F.sum("missed").alias("missed"), F.sum("invented").alias("invented"))
    every = W.partitionBy()  # eleven rows
    return t.select("cls", "missed", "invented",
                    (100.0 * F.col("missed") / F.greatest(F.sum("missed").over(every), F.lit(1))).alias("missed_pct"),
                    (100.0 * F.col("invented") / F.greatest(F.sum("invented").over(every), F.lit(1))).alias("invented_pct"))


def completion_by_class(cube: DataFrame) -> DataFrame:
    """Completion per class two ways: own label must match, or any class counts."""
    n = F.col("n")
    both = (cube.filter(SSC).filter("label < 12").select("label", "pred", "n", (~F.col("seen")).alias("sc"))
            .groupBy("label", "pred").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("sc"), n)), F.lit(0)).alias("n_sc")))
    s = lambda c, v: F.when(c, F.col(v)).otherwise(0)
    hit = F.col("label") == F.col("pred")
    side = both.select(F.inline(F.array(
        F.struct(F.col("label").alias("cls"), n.alias("gt"), F.col("n_sc").alias("gt_sc"),
                 s(hit, "n_sc").alias("tp_label"), F.lit(0).cast("long").alias("claim_sc"),
                 s(F.col("pred") > 0, "n_sc").alias("tp_any"), s(F.col("pred") == 0, "n_sc").alias("left_empty"),
                 F.lit(0).cast("long").alias("fp_any")),
        F.struct(F.col("pred").alias("cls"), F.lit(0).cast("long").alias("gt"), F.lit(0).cast("long").alias("gt_sc"),
                 F.lit(0).cast("long").alias("tp_label"), F.col("n_sc").alias("claim_sc"),
                 F.lit(0).cast("long").alias("tp_any"), F.lit(0).cast("long").alias("left_empty"),
                 s(F.col("label") == 0, "n_sc").alias("fp_any")))))
    a = side.filter("cls > 0").groupBy("cls").agg(*[F.sum(c).alias(c) for c in (
        "gt", "gt_sc", "tp_label", "claim_sc", "tp_any", "left_empty", "fp_any")])
    return a.select(
        "cls", "gt_sc", "tp_any", "left_empty", "fp_any",
        (100.0 * F.col("gt_sc") / F.greatest("gt", F.lit(1))).alias("unseen_pct"),
        F.try_divide("tp_label", F.col("gt_sc") + F.col("claim_sc") - F.col("tp_label")).alias("label_iou"),
        F.try_divide("tp_any", F.col("tp_any") + F.col("left_empty") + F.col("fp_any")).alias("any_iou"),
        (100.0 * (F.col("gt_sc") - F.col("tp_label") - F.col("left_empty")) / F.greatest("gt_sc", F.lit(1))).alias("other_pct"),
        (100.0 * F.col("left_empty") / F.greatest("gt_sc", F.lit(1))).alias("empty_pct"))


def completion_identity(cube: DataFrame) -> DataFrame:
    """Zero rows unless the per-class split stops adding up to the binary matrix."""
    b = binary_matrix(cube)
    s = completion_by_class(cube).agg(F.sum("tp_any").alias("a"), F.sum("left_empty").alias("e"), F.sum("fp_any").alias("i"))
    return b.join(F.broadcast(s)).filter("tp <> a OR fn <> e OR fp <> i").select("tp", "fp", "fn", "a", "e", "i")


def presence(vox: DataFrame) -> DataFrame:
    """Frames in which a class is claimed and annotated; distinct frames first, then counts."""
    pairs = (vox.select("frame", F.inline(F.array(
        F.struct(F.col("pred").alias("cls"), F.lit(1).alias("p"), F.lit(0).alias("g")),
        F.struct(F.when(F.col("label") != IGNORE, F.col("label")).alias("cls"), F.lit(0).alias("p"), F.lit(1).alias("g")))))
        .filter("cls IS NOT NULL").groupBy("frame", "cls").agg(F.max("p").alias("p"), F.max("g").alias("g")))
    return (pairs.filter("cls > 0").groupBy("cls").agg(F.sum("p").alias("frames_pred"), F.sum("g").alias("frames_gt"))
            .withColumn("ratio", F.try_divide("frames_pred", "frames_gt")))


def coverage(cube: DataFrame) -> DataFrame:
    """Where each class's claims fall relative to the scored set."""
    pick = lambda c: F.coalesce(F.sum(F.when(F.expr(c), F.col("n"))), F.lit(0))
    return (cube.filter("pred > 0").groupBy(F.col("pred").alias("cls")).agg(
        pick("NOT weighted").alias("unscored"), pick("weighted AND label = 255").alias("ignored"),
        pick(SSC).alias("scored"), pick(f"{SSC} AND label = 0").alias("over_empty"),
        pick("NOT weighted AND label = 0").alias("empty_unscored"),
        pick("NOT weighted AND label = 0 AND band < 2").alias("empty_seen_free"))
        .withColumn("scored_pct", 100.0 * F.col("scored") / (F.col("unscored") + F.col("ignored") + F.col("scored"))))


def spill(conf: DataFrame) -> DataFrame:
    """Share of a class's false positives that lie on empty."""
    fp = conf.filter("pred > 0 AND label <> pred")
    return (fp.groupBy(F.col("pred").alias("cls")).agg(
        F.sum("n").alias("fp"), F.coalesce(F.sum(F.when(F.col("label") == 0, F.col("n"))), F.lit(0)).alias("fp_empty"))
        .withColumn("empty_pct", 100.0 * F.col("fp_empty") / F.col("fp"))
        .withColumn("fp_other", F.col("fp") - F.col("fp_empty")))


def partners(conf: DataFrame, side: str, k: int = 3) -> DataFrame:
    """Per class: wrong share and its k largest partners. ``fp`` reads columns, ``fn`` rows."""
    own, other = ("pred", "label") if side == "fp" else ("label", "pred")
    names = case_of(CLASS_NAMES, F.col(other))
    c = conf.filter(F.col(own) > 0).select(F.col(own).alias("cls"), names.alias("name"),
                                           "n", (F.col("label") != F.col("pred")).alias("wrong"))
    totals = W.partitionBy("cls")  # at most 12 rows per class from here on
    ranked = (c.withColumn("total", F.sum("n").over(totals))
              .withColumn("errors", F.coalesce(F.sum(F.when(F.col("wrong"), F.col("n"))).over(totals), F.lit(0)))
              .withColumn("rk", F.row_number().over(totals.orderBy(F.col("wrong").desc(), F.desc("n"), F.desc("name")))))
    text = F.concat(F.col("name"), F.lit(" "), F.round(100.0 * F.col("n") / F.greatest("errors", F.lit(1)), 0).cast("int").cast("string"), F.lit("%"))
    return (ranked.groupBy("cls").agg(
        F.first("total").alias("total"), F.first("errors").alias("errors"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(
            F.col("wrong") & (F.col("rk") <= k) & (F.col("n") > 0), F.struct("rk", text.alias("text"))))),
            lambda x: x["text"]), ", ").alias("partners"))
        .withColumn("wrong_pct", 100.0 * F.col("errors") / F.greatest("total", F.lit(1))))


def biggest_confusions(conf: DataFrame, top: int = 10) -> DataFrame:
    """Largest (claimed, was) pairs and their share of all class false positives."""
    c = conf.select(case_of(CLASS_NAMES, F.col("pred")).alias("predicted"),
                    case_of(CLASS_NAMES, F.col("label")).alias("actual"), "n", "label", "pred").filter("label <> pred")
    fp = F.sum(F.when(F.col("pred") > 0, F.col("n")).otherwise(0)).over(W.partitionBy())  # <= 132 rows
    return (c.withColumn("fp_total", fp).orderBy(F.desc("n"), F.desc("predicted"), F.desc("actual")).limit(top)
            .select("predicted", "actual", "n", (100.0 * F.col("n") / F.greatest("fp_total", F.lit(1))).alias("share")))


def top_confusions(conf: DataFrame, top: int = 10) -> DataFrame:
    """Largest confusions as a share of their truth class."""
    total = F.sum("n").over(W.partitionBy("label"))
    return (conf.withColumn("total", total).filter("label <> pred").orderBy(F.desc("n"), "label", "pred").limit(top)
            .select("label", "pred", "n", (100.0 * F.col("n") / F.greatest("total", F.lit(1))).alias("share")))


def region5() -> Column:
    return (F.when(F.col("seen"), 0).when(F.col("band") < 2, 1).when(F.col("band") == 2, 4)
            .when(F.col("band") < 5, 2).otherwise(3))


def region3() -> Column:
    return F.when(F.col("seen"), 0).when(F.col("band") < 2, 1).otherwise(2)


def regions(cube: DataFrame) -> DataFrame:
    """Five-way partition of the volume with claimed-empty, truth-empty and weighted counts."""
    pick = lambda c: F.coalesce(F.sum(F.when(F.expr(c), F.col("n"))), F.lit(0))
    return (cube.groupBy(region5().alias("rid")).agg(
        F.sum("n").alias("n"), pick("pred = 0").alias("pred_empty"), pick("label = 0").alias("gt_empty"),
        pick("weighted").alias("weighted_n")).select(case_of(REGION5, F.col("rid")).alias("region"), "n", "pred_empty", "gt_empty", "weighted_n"))


def misses_by_region(cube: DataFrame) -> DataFrame:
    """Object voxels, hits and the two kinds of miss per class and region, with roll-ups."""
    c = (cube.filter(SSC).filter("label BETWEEN 1 AND 11")
         .groupBy("label", region3().alias("region"), (F.col("pred") == F.col("label")).alias("hit"),
                  (F.col("pred") == 0).alias("empty")).agg(F.sum("n").alias("n")))
    pick = lambda cnd: F.coalesce(F.sum(F.when(cnd, F.col("n"))), F.lit(0))
    return (c.rollup("label", "region").agg(
        F.sum("n").alias("gt"), pick(F.col("hit")).alias("hits"), pick(F.col("empty")).alias("left_empty"),
        pick(~F.col("hit") & ~F.col("empty")).alias("other_class"))
        .withColumn("recall", 100.0 * F.col("hits") / F.col("gt")))


def mask_audit(cube: DataFrame) -> DataFrame:
    """Does the stored weight equal (label 1..254 or tsdf < -0.5)? Plus the unweighted parts."""
    rule = "((label > 0 AND label <> 255) OR band = 5)"
    pick = lambda c: F.coalesce(F.sum(F.when(F.expr(c), F.col("n"))), F.lit(0))
    return cube.agg(F.sum("n").alias("total"), pick(f"{rule} = weighted").alias("matching"),
                    pick(f"{rule} AND NOT weighted").alias("rule_only"), pick(f"NOT {rule} AND weighted").alias("weight_only"),
                    pick("NOT weighted AND band = 2").alias("never"), pick("NOT weighted AND band < 2").alias("free"),
                    pick("NOT weighted AND band > 2").alias("other"))


def layer_counts(vox: DataFrame) -> DataFrame:
    """Floor and ceiling voxels per frame and height layer, truth and claim."""
    cnt = lambda c, v: F.count_if(F.col(c) == v)
    return (vox.groupBy("frame", "gy").agg(
        cnt("label", 2).alias("floor_gt"), cnt("pred", 2).alias("floor_pred"),
        cnt("label", 1).alias("ceil_gt"), cnt("pred", 1).alias("ceil_pred")))


def layer_statistics(vox: DataFrame, cells_per_layer: int = 3600) -> DataFrame:
    """Per frame: fill of floor layer 0 and the modal ceiling layer (first on ties)."""
    lay = layer_counts(vox)
    modal = lambda c: F.max_by(F.when(F.col(c) > 0, F.col("gy")), F.struct(F.col(c), -F.col("gy")))
    zero = lambda c: F.coalesce(F.sum(F.when(F.col("gy") == 0, F.col(c))), F.lit(0)) / cells_per_layer
    return lay.groupBy("frame").agg(
        zero("floor_gt").alias("floor_gt_fill"), zero("floor_pred").alias("floor_pred_fill"),
        modal("ceil_gt").alias("ceil_gt_layer"), modal("ceil_pred").alias("ceil_pred_layer"),
        (F.max("ceil_pred") / cells_per_layer).alias("ceil_pred_fill"))


def floor_by_layer(vox: DataFrame) -> DataFrame:
    """Share of all floor voxels in each height layer, truth against claim."""
    t = layer_counts(vox).groupBy("gy").agg(F.sum("floor_gt").alias("floor_gt"), F.sum("floor_pred").alias("floor_pred"))
    every = W.partitionBy()  # one row per layer: 36
    return (t.withColumn("gt_share", F.try_divide("floor_gt", F.sum("floor_gt").over(every)))
            .withColumn("pred_share", F.try_divide("floor_pred", F.sum("floor_pred").over(every))))


def split_class_stats(vox: DataFrame) -> DataFrame:
    """Per split and class: iou, claimed/annotated voxel and frame ratios, spill."""
    cube = score_cube(vox, "split", "frame")
    pick = lambda c: F.coalesce(F.sum(F.when(F.expr(c), F.col("n"))), F.lit(0))
    sides = cube.select("split", "frame", F.inline(F.array(
        F.struct(F.col("label").alias("cls"), F.lit("gt").alias("side"), F.col("pred").alias("o")),
        F.struct(F.col("pred").alias("cls"), F.lit("pred").alias("side"), F.col("label").alias("o")))),
        F.expr(SSC).alias("scored"), "n").filter("cls BETWEEN 1 AND 11")
    per_frame = sides.groupBy("split", "frame", "cls").agg(
        pick("side = 'gt' AND scored").alias("gt"), pick("side = 'pred' AND scored").alias("claimed"),
        pick("side = 'gt' AND scored AND o = cls").alias("tp"), pick("side = 'pred'").alias("pred_all"),
        pick("side = 'pred' AND scored AND o = 0").alias("fp_empty"),
        F.max((F.col("side") == "pred").cast("int")).alias("fp_"), F.max((F.col("side") == "gt").cast("int")).alias("fg_"))
    s = rates(per_frame.groupBy("split", "cls").agg(
        *[F.sum(c).alias(c) for c in ("gt", "claimed", "tp", "pred_all", "fp_empty")],
        F.sum("fp_").alias("frames_pred"), F.sum("fg_").alias("frames_gt")))
    one = F.lit(1)
    return s.select("split", "cls", (100 * F.col("iou")).alias("iou"),
                    (100.0 * F.col("fn") / F.greatest("gt", one)).alias("miss"),
                    (F.col("pred_all") / F.greatest("gt", one)).alias("voxel_ratio"),
                    (F.col("frames_pred") / F.greatest("frames_gt", one)).alias("frame_ratio"),
                    (100.0 * F.col("fp_empty") / F.greatest("fp", one)).alias("spill"))


def train_test_gap(vox: DataFrame, gap_bar: float = 5.0) -> DataFrame:
    """Train against test per class, with ordinal ranks of the gap."""
    a = split_class_stats(vox).groupBy("cls").agg(*[
        F.max(F.when(F.col("split") == s, F.col(c))).alias(f"{c}_{s}")
        for s in ("train", "test") for c in ("iou", "voxel_ratio", "frame_ratio", "spill")])
    a = a.withColumn("gap", F.col("iou_train") - F.col("iou_test"))
    return (a.withColumn("gap_rank", F.row_number().over(W.orderBy(F.desc("gap"), "cls")))  # eleven rows
            .withColumn("lost", F.col("gap") > gap_bar))


def error_groups(vox: DataFrame, gap_flat: float = 5.0, miss_flat: float = 10.0) -> DataFrame:
    """False-positive group 1-3 and miss group 1-3 of each class on the test split."""
    conf = confusion(score_cube(vox, "split"), "split")
    sc = rates(class_counts(conf, "split")).filter("cls > 0")
    per = sc.groupBy("cls").agg(
        F.max(F.when(F.col("split") == "train", 100 * F.col("iou"))).alias("tr"),
        F.max(F.when(F.col("split") == "test", 100 * F.col("iou"))).alias("te"),
        F.max(F.when(F.col("split") == "test", 100.0 * F.col("fn") / F.greatest("gt", F.lit(1)))).alias("miss"))
    off = conf.filter("split = 'test' AND label <> pred")
    fp = off.groupBy(F.col("pred").alias("cls")).agg(F.max_by("label", F.struct("n", "label")).alias("fp_dest"))
    fn = off.groupBy(F.col("label").alias("cls")).agg(F.max_by("pred", F.struct("n", "pred")).alias("fn_dest"))
    j = per.join(F.broadcast(fp), "cls", "left").join(F.broadcast(fn), "cls", "left")  # eleven rows a side
    return j.select("cls", (F.col("tr") - F.col("te")).alias("gap"), "miss", "fp_dest", "fn_dest",
                    F.when(F.col("tr") - F.col("te") < gap_flat, 1).when(F.col("fp_dest") == 0, 2).otherwise(3).alias("fp_group"),
                    F.when(F.col("miss") < miss_flat, 1).when(F.col("fn_dest") == 0, 2).otherwise(3).alias("miss_group"))


VISIBLE = "weighted AND band IN (1, 2, 3)"
OCCLUDED = "band = 5"


def visibility_split(cube: DataFrame) -> DataFrame:
    """Recall where the camera saw and where it could not, surface and hidden IoU, and
    claims in occluded space outside the room, all per class from one cube."""
    masks = [("visible", f"{VISIBLE} AND label <> 255"), ("occluded", f"{OCCLUDED} AND label <> 255"),
             ("surface", f"{SSC} AND seen"), ("hidden", SC)]
    rows = cube.select("label", "pred", "n", F.explode(F.array(*[
        F.when(F.expr(m), F.lit(k)) for k, m in masks])).alias("mask")).filter("mask IS NOT NULL")
    c = rates(class_counts(rows.groupBy("mask", "label", "pred").agg(F.sum("n").alias("n")), "mask")).filter("cls > 0")
    pv = lambda m, col: F.max(F.when(F.col("mask") == m, F.col(col)))
    out = c.groupBy("cls").agg(
        pv("visible", "gt").alias("visible_n"), pv("visible", "recall").alias("visible_recall"),
        pv("occluded", "gt").alias("occluded_n"), pv("occluded", "recall").alias("occluded_recall"),
        pv("surface", "iou").alias("surface_iou"), pv("hidden", "iou").alias("hidden_iou"))
    outside = (cube.filter(f"{OCCLUDED} AND label = 255").groupBy(F.col("pred").alias("cls"))
               .agg(F.sum("n").alias("outside_room")))
    return (out.join(F.broadcast(outside), "cls", "left").fillna(0, ["outside_room"])  # <= 12 rows
            .withColumn("drop", F.col("hidden_iou") - F.col("surface_iou")))


def class_recall_by_frame(vox: DataFrame, cls: int, min_count: int) -> DataFrame:
    """Visible and occluded recall of one class in every frame with enough voxels on both sides."""
    c = score_cube(vox, "frame").filter(F.col("label") == cls)
    pick = lambda m: F.coalesce(F.sum(F.when(F.expr(m), F.col("n"))), F.lit(0))
    a = c.groupBy("frame").agg(
        pick(VISIBLE).alias("vn"), pick(f"{VISIBLE} AND pred = {cls}").alias("vh"),
        pick(OCCLUDED).alias("on"), pick(f"{OCCLUDED} AND pred = {cls}").alias("oh"))
    return (a.filter((F.col("vn") > min_count) & (F.col("on") > min_count))
            .select("frame", "vn", "on", (F.col("vh") / F.col("vn")).alias("visible_recall"),
                    (F.col("oh") / F.col("on")).alias("occluded_recall")))


def protocols() -> list[tuple]:
    """(name, truth column, carve free space, keep rule, completion rule) per protocol."""
    known = lambda t: F.col(t) != IGNORE
    weighted = lambda t: known(t) & (F.col(t).between(1, 254) | (F.col("tsdf") < -0.5))
    no_floor = lambda t: weighted(t) & (F.col(t) != FLOOR) & (F.col("pred") != FLOOR)
    unseen = lambda rule: lambda t: rule(t) & F.col("pixel_id").isNull()
    return ([(f"all-voxels|{t}", t, False, known, known) for t in ("label", "label_fov")]
            + [("all-voxels+carve|label", "label", True, known, known)]
            + [(f"weighted|{t}", t, False, weighted, unseen(weighted)) for t in ("label", "label_fov")]
            + [(f"weighted-nofloor|{t}", t, False, no_floor, unseen(no_floor)) for t in ("label", "label_fov")])


def protocol_matrix(vox: DataFrame) -> DataFrame:
    """Completion IoU and mean IoU under every scoring protocol, from one scan.

    Rows are first counted by the columns the rules read; only those few thousand
    cells are multiplied by the seven protocols."""
    cells = (vox.select("label", "label_fov", "pred", F.when(band(F.col("tsdf")) < 2, 1.0).when(F.col("tsdf") < -0.5, -1.0)
                        .otherwise(0.0).alias("tsdf"), F.when(F.col("pixel_id").isNotNull(), 1).alias("pixel_id"))
             .groupBy("label", "label_fov", "pred", "tsdf", "pixel_id").agg(F.count(F.lit(1)).alias("n")))
    rows = cells.select("n", F.inline(F.array(*[F.struct(
        F.lit(name).alias("protocol"), F.col(truth).alias("label"),
        (F.when(F.col("tsdf") > 0, 0).otherwise(F.col("pred")) if carve else F.col("pred")).alias("pred"),
        keep(truth).alias("keep"), sc(truth).alias("sc"))
        for name, truth, carve, keep, sc in protocols()])))
    conf = rows.filter("keep").groupBy("protocol", "label", "pred").agg(F.sum("n").alias("n"))
    miou = mean_iou(class_counts(conf, "protocol"), "protocol")
    sc = completion_rates(binary_matrix(rows, "protocol", where="sc"))
    return miou.join(F.broadcast(sc), "protocol").select(  # seven rows
        "protocol", "sc_voxels", "sc_iou", (100 * F.col("miou")).alias("miou"))


def frame_cells(vox: DataFrame, *keys: str) -> DataFrame:
    """All-voxel rule cells per frame, the input of the binned scores."""
    return (vox.filter(F.col("label") != IGNORE).groupBy(*keys, "frame", "label", "pred")
            .agg(F.count(F.lit(1)).alias("n")))


def pooled_scores(cells: DataFrame, *keys: str) -> DataFrame:
    """SC IoU and mean IoU of pooled cells per key, and the frames pooled."""
    conf = cells.groupBy(*keys, "label", "pred").agg(F.sum("n").alias("n"))
    miou = mean_iou(class_counts(conf, *keys), *keys)
    sc = completion_rates(binary_matrix(conf, *keys, where="true"))
    k = list(keys)
    return miou.join(sc, k).select(*k, "sc_voxels", "sc_iou", (100 * F.col("miou")).alias("miou"))


def bin_of(x: Column, edges: list, clip: bool) -> Column:
    """Index of the half-open bin; clipped to the end bins, or NULL outside."""
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        out = F.when((x >= edges[i]) & (x < edges[i + 1]), i).otherwise(out)
    if clip:
        out = F.when(x < edges[0], 0).when(x >= edges[-1], len(edges) - 2).otherwise(out)
    return F.when(x.isNotNull(), out)


def within_scene(cells: DataFrame, min_frames: int = 3) -> DataFrame:
    """Per scene: aligned minus diagonal headings, scenes with enough frames of both."""
    side = F.when(F.col("heading") <= 10, "aligned").when(F.col("heading") >= 35, "diagonal")
    c = cells.withColumn("side", side).filter("side IS NOT NULL")
    frames = c.groupBy("scene", "side", "frame").agg(F.lit(1).alias("one")).groupBy("scene", "side").agg(F.sum("one").alias("frames"))
    s = pooled_scores(c, "scene", "side").join(frames, ["scene", "side"]).filter(F.col("frames") >= min_frames)
    pv = lambda d, col: F.max(F.when(F.col("side") == d, F.col(col)))
    return (s.groupBy("scene").agg((pv("aligned", "sc_iou") - pv("diagonal", "sc_iou")).alias("d_sc"),
                                   (pv("aligned", "miou") - pv("diagonal", "miou")).alias("d_ssc"))
            .filter("d_sc IS NOT NULL"))


def compare_published(scores: DataFrame, published: list[tuple[int, float]]) -> DataFrame:
    """Beside each class the published value and whether one-decimal rounding agrees."""
    dim = scores.sparkSession.createDataFrame(published, "cls int, published double")
    ours = F.round(100 * F.col("iou"), 1)
    return (scores.join(F.broadcast(dim), "cls").select(  # a short fixed list
        "cls", ours.alias("ours"), "published", (F.round(ours - F.col("published"), 1)).alias("diff"),
        (ours == F.round("published", 1)).alias("reproduced")))


def pick_ends(scores: DataFrame, group: list[str], by: str, k: int) -> DataFrame:
    """k best and k worst frames per group. The rank filters become group limits
    before the shuffle, so a hot scene sends k rows per task."""
    part = W.partitionBy(*group) if group else W.partitionBy()
    best = scores.withColumn("rk", F.row_number().over(part.orderBy(F.desc(by), "frame"))).filter(F.col("rk") <= k)
    worst = scores.withColumn("rk", F.row_number().over(part.orderBy(F.asc(by), "frame"))).filter(F.col("rk") <= k)
    return best.withColumn("which", F.lit("best")).unionByName(worst.withColumn("which", F.lit("worst")))


