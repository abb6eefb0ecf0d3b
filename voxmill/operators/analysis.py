"""What separates frames that score well from frames that do not, and logit measures."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxmill.operators.score import bin_of, frame_cells, pick_ends, pooled_scores, within_scene
from voxmill.plans.quantiles import column_quantiles, exact_quantiles
from voxmill.session import cut

# Property, step its slope is quoted over, least 10-90 spread worth a line.
PROPERTIES = [("cam_z", 0.10, 0.10), ("tilt_deg", 5.0, 3.0), ("depth_med", 0.10, 0.15), ("near_pct", 10.0, 10.0),
              ("free_mean", 0.10, 0.05), ("sc_voxels", 1000.0, 300.0), ("occ_pct", 10.0, 10.0)]
# Heading, pitch and occupancy bin edges.
HEADING_BINS = [0, 7.5, 15, 22.5, 30, 37.5, 45.01]
PITCH_BINS = [-90, -40, -25, -10, 10, 90]
OCCUPANCY_BANDS = [0, 20, 35, 50, 65, 80, 101]


def reference_like(frames: DataFrame, reference: DataFrame, columns: list[str], lo: float = 0.05, hi: float = 0.95) -> DataFrame:
    """Frames whose every column lies between two percentiles of a reference set (one row of bounds)."""
    q = column_quantiles(reference, [], columns, {"lo": lo, "hi": hi})
    bounds = q.agg(*[F.max(F.when(F.col("name") == c, F.col(e))).alias(f"{c}_{e}") for c in columns for e in ("lo", "hi")])
    keep = None
    for c in columns:
        k = F.col(c).between(F.col(f"{c}_lo"), F.col(f"{c}_hi"))
        keep = k if keep is None else keep & k
    return frames.join(F.broadcast(bounds)).filter(keep).select(frames.columns)


def binned_scores(vox: DataFrame, frames: DataFrame, column: str, edges: list, clip: bool) -> DataFrame:
    """Pooled scores per bin of a frame property, with the frames pooled."""
    b = frames.select("frame", bin_of(F.col(column), edges, clip).alias("bin")).filter("bin IS NOT NULL")
    cells = frame_cells(vox).join(b, "frame")
    n = cells.select("bin", "frame").distinct().groupBy("bin").agg(F.count(F.lit(1)).alias("frames"))
    return pooled_scores(cells, "bin").join(n, "bin").select("bin", "frames", "sc_voxels", "sc_iou", "miou")


def scene_pairs(vox: DataFrame, frames: DataFrame, min_frames: int) -> DataFrame:
    """Aligned minus diagonal headings within each scene."""
    cells = frame_cells(vox).join(frames.select("frame", "scene", "heading"), "frame")
    return within_scene(cells, min_frames)


def pair_summary(pairs: DataFrame) -> DataFrame:
    """Median difference and the share of scenes the aligned side wins."""
    p = cut(pairs)
    q = column_quantiles(p, [], ["d_sc", "d_ssc"], {"median": 0.5})
    wins = p.unpivot([], ["d_sc", "d_ssc"], "name", "v").groupBy("name").agg(
        F.count(F.lit(1)).alias("scenes"), F.avg((F.col("v") > 0).cast("int")).alias("win_share"))
    return q.join(wins, "name")


def occupancy_bands(scores: DataFrame) -> DataFrame:
    """Medians of the completion scores per dataset within occupancy bands."""
    b = scores.withColumn("band", bin_of(F.col("occ_pct"), OCCUPANCY_BANDS, False)).filter("band IS NOT NULL")
    q = column_quantiles(b.select("dataset", "band", "sc_iou", "prec", "rec"), ["dataset", "band"], ["sc_iou", "prec", "rec"], {"median": 0.5})
    n = b.groupBy("dataset", "band").agg(F.count(F.lit(1)).alias("n"))
    wide = q.groupBy("dataset", "band").agg(*[F.max(F.when(F.col("name") == c, F.col("median"))).alias(c) for c in ("sc_iou", "prec", "rec")])
    return wide.join(n, ["dataset", "band"])


def dataset_totals(scores: DataFrame) -> DataFrame:
    cols = ["sc_iou", "prec", "rec", "occ_pct", "sc_voxels", "occupied"]
    s = scores.select("dataset", *[F.col(c).cast("double").alias(c) for c in cols[:5]], (F.col("sc_voxels") * F.col("occ_pct") / 100).alias("occupied"))
    q = column_quantiles(s, ["dataset"], cols, {"median": 0.5})
    return q.groupBy("dataset").agg(*[F.max(F.when(F.col("name") == c, F.col("median"))).alias(c) for c in cols])


def pearson(a: Column, b: Column) -> Column:
    """Correlation that is NULL, not an error, when a side does not vary."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def viewpoint_correlations(scores: DataFrame, properties=PROPERTIES) -> DataFrame:
    """Each property against both scores: correlation, slope over its step, share explained and
    the scatter left around the line. One aggregate row, then unfolded."""
    d = lambda c: F.col(c).cast("double")
    aggs = []
    for p, step, _ in properties:
        for y in ("sc_iou", "ssc_miou"):
            r = pearson(d(p), d(y))
            aggs.append(F.struct(r.alias("r"), (F.regr_slope(d(y), d(p)) * step).alias("per_step"),
                                 (F.stddev_pop(d(y)) * F.sqrt(F.greatest(1 - r * r, F.lit(0.0)))).alias("residual_std")).alias(f"{p}|{y}"))
    one = scores.agg(*aggs)
    return one.select(F.inline(F.array(*[F.struct(F.lit(p).alias("property"), F.lit(y).alias("score"), F.col(f"{p}|{y}")["r"].alias("r"),
                                                  (F.col(f"{p}|{y}")["r"] * F.col(f"{p}|{y}")["r"]).alias("explained"), F.col(f"{p}|{y}")["per_step"].alias("per_step"),
                                                  F.col(f"{p}|{y}")["residual_std"].alias("residual_std"))
                                         for p, _, _ in properties for y in ("sc_iou", "ssc_miou")])))


def property_spread(scores: DataFrame, properties=PROPERTIES) -> DataFrame:
    """10-90 spread of each property and whether it is too thin to fit a line through."""
    names = [p for p, _, _ in properties]
    q = column_quantiles(scores.select(*[F.col(p).cast("double").alias(p) for p in names]), [], names, {"p10": 0.1, "p90": 0.9})
    least = F.create_map(*[x for p, _, m in properties for x in (F.lit(p), F.lit(m))])
    return q.select(F.col("name").alias("property"), (F.col("p90") - F.col("p10")).alias("spread"),
                    (F.col("p90") - F.col("p10") < least[F.col("name")]).alias("thin"))


def property_matrix(scores: DataFrame, properties=PROPERTIES) -> DataFrame:
    """Correlation of every pair of properties, tightest first by rank."""
    names = [p for p, _, _ in properties]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    d = lambda c: F.col(c).cast("double")
    one = scores.agg(*[pearson(d(a), d(b)).alias(f"{a}|{b}") for a, b in pairs])
    m = one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}|{b}").alias("r")) for a, b in pairs])))
    return m.withColumn("rk", F.row_number().over(W.orderBy(F.desc(F.abs("r")), "a", "b")))  # 21 rows


def hidden_bands(scores: DataFrame) -> DataFrame:
    """Frames in quarters of hidden room by value (ties stay together), with medians."""
    q = exact_quantiles(scores, [], "free_mean", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    b = scores.join(F.broadcast(q)).withColumn("band", F.when(F.col("free_mean") <= F.col("q1"), 1).when(
        F.col("free_mean") <= F.col("q2"), 2).when(F.col("free_mean") <= F.col("q3"), 3).otherwise(4))
    cols = ["free_mean", "sc_voxels", "occ_pct", "sc_iou", "ssc_miou"]
    long = column_quantiles(b.select("band", *[F.col(c).cast("double").alias(c) for c in cols]), ["band"], cols, {"median": 0.5})
    n = b.groupBy("band").agg(F.count(F.lit(1)).alias("n"))
    return long.groupBy("band").agg(*[F.max(F.when(F.col("name") == c, F.col("median"))).alias(c) for c in cols]).join(n, "band")


def best_worst_tenth(scores: DataFrame, columns: list[str], by: str = "margin") -> DataFrame:
    """Medians of the best and worst tenth by a score, and their difference over the 10-90 spread.

    The ends are cut at the exact value of the tenth's rank; frames equal to it count."""
    tenth = lambda n: F.greatest(F.lit(1), F.floor(n / 10))
    cuts = exact_quantiles(scores, [], by, {"hi_": lambda n: n - tenth(n), "lo_": lambda n: tenth(n) - 1})
    s = scores.join(F.broadcast(cuts)).withColumn("best", F.col(by) >= F.col("hi_")).withColumn("worst", F.col(by) <= F.col("lo_"))
    d = [F.col(c).cast("double").alias(c) for c in columns]
    ends = s.select(F.explode(F.array(F.when(F.col("best"), "best"), F.when(F.col("worst"), "worst"))).alias("end_"), *d).filter("end_ IS NOT NULL")
    q = column_quantiles(ends, ["end_"], columns, {"median": 0.5})
    wide = q.groupBy("name").agg(F.max(F.when(F.col("end_") == "best", F.col("median"))).alias("best"),
                                 F.max(F.when(F.col("end_") == "worst", F.col("median"))).alias("worst"))
    spread = column_quantiles(scores.select(*d), [], columns, {"p10": 0.1, "p90": 0.9})
    return wide.join(F.broadcast(spread), "name").select(  # one row per property
        "name", "best", "worst", F.try_divide(F.abs(F.col("best") - F.col("worst")), F.col("p90") - F.col("p10")).alias("difference"))


def split_slopes(scores: DataFrame, prop: str, score: str, step: float) -> DataFrame:
    """Slope of a score over a property on each side of the property's median."""
    m = exact_quantiles(scores, [], prop, {"m_": 0.5})
    s = scores.join(F.broadcast(m)).withColumn("side", F.when(F.col(prop) <= F.col("m_"), "low").otherwise("high"))
    return s.groupBy("side").agg(F.count(F.lit(1)).alias("n"), (F.regr_slope(F.col(score), F.col(prop).cast("double")) * step).alias("per_step"))


def eligible_ends(scores: DataFrame, k: int, min_scored: int, min_classes: int) -> DataFrame:
    """Best and worst frames of each scene among those with enough to score."""
    ok = scores.filter((F.col("scored") >= min_scored) & (F.col("classes") >= min_classes))
    return pick_ends(ok, ["scene"], "ssc_miou", k)


def score_spread(scores: DataFrame, columns: list[str]) -> DataFrame:
    return column_quantiles(scores.select(*[F.col(c).cast("double").alias(c) for c in columns]), [], columns,
                            {"p10": 0.1, "p50": 0.5, "p90": 0.9})


def floor_tilt(vox: DataFrame, min_n: int = 50) -> DataFrame:
    """Tilt of each frame's annotated floor: least squares gy ~ gz, gx from moment sums."""
    f = vox.filter("label = 2")
    z, x, y = (F.col(c).cast("double") for c in ("gz", "gx", "gy"))
    m = f.groupBy("frame").agg(F.count(F.lit(1)).alias("n"), F.covar_pop(z, z).alias("zz"), F.covar_pop(x, x).alias("xx"),
                               F.covar_pop(z, x).alias("zx"), F.covar_pop(z, y).alias("zy"), F.covar_pop(x, y).alias("xy"))
    det = F.col("zz") * F.col("xx") - F.col("zx") * F.col("zx")
    a = F.try_divide(F.col("zy") * F.col("xx") - F.col("xy") * F.col("zx"), det)
    b = F.try_divide(F.col("xy") * F.col("zz") - F.col("zy") * F.col("zx"), det)
    return m.select("frame", "n", F.when(F.col("n") >= min_n, F.degrees(F.acos(1.0 / F.sqrt(a * a + b * b + 1.0)))).alias("tilt_deg"))


# ---- logits -----------------------------------------------------------------

def argmax(logits: Column) -> Column:
    """Index of the largest entry, lowest on ties."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def log_softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    total = F.log(F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - top)))
    return F.transform(logits, lambda x: x - top - total)


def smoothed_cross_entropy(rows: DataFrame, smoothing: float = 0.2, ignore: int = 255) -> DataFrame:
    """Label-smoothed cross entropy averaged over the masked rows: (n, loss).

    ``rows(logits ARRAY<DOUBLE>, label INT, mask BOOLEAN)``."""
    k = F.size("logits")
    weight = lambda i: F.when(i == F.col("label"), 1.0 - smoothing).otherwise(smoothing / (k - 1))
    loss = F.aggregate(F.transform(log_softmax(F.col("logits")), lambda x, i: -x * weight(i)), F.lit(0.0), lambda a, x: a + x)
    return rows.filter(F.col("mask") & (F.col("label") != ignore)).agg(F.count(F.lit(1)).alias("n"), F.avg(loss).alias("loss"))


def running_mean(steps: DataFrame) -> DataFrame:
    """Weighted mean of per-step averages: (weight, mean)."""
    return steps.agg(F.sum("n").alias("weight"), F.try_divide(F.sum(F.col("value") * F.col("n")), F.sum("n")).alias("mean"))


def distillation(rows: DataFrame, temperature: float = 1.0) -> DataFrame:
    """Per sample: KL between the softmaxed class centres of two logit sets and the mean squared
    difference of each row's cosine relation to those centres.

    ``rows(sample, label, student ARRAY, teacher ARRAY)``. Centres are averaged per
    (sample, label, position); a sample has at most eleven, so they travel as one row."""
    r = rows.filter("label BETWEEN 1 AND 11")
    flat = r.select("sample", "label", F.posexplode(F.arrays_zip("student", "teacher")).alias("pos", "v"))
    mean = flat.groupBy("sample", "label", "pos").agg(F.avg("v.student").alias("s"), F.avg("v.teacher").alias("t"))
    centre = mean.groupBy("sample", "label").agg(F.array_sort(F.collect_list(F.struct("pos", "s", "t"))).alias("c")).select(
        "sample", "label", F.col("c.s").alias("cs"), F.col("c.t").alias("ct"))
    ls, lt = log_softmax(F.transform("cs", lambda x: x / temperature)), log_softmax(F.transform("ct", lambda x: x / temperature))
    kl = F.aggregate(F.zip_with(lt, ls, lambda t, s: F.exp(t) * (t - s)), F.lit(0.0), lambda a, x: a + x) * temperature ** 2
    centre_loss = centre.groupBy("sample").agg(F.avg(kl).alias("centre_loss"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    cos = lambda a, b: dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(1e-8))
    bundle = centre.groupBy("sample").agg(F.collect_list(F.struct("label", "cs", "ct")).alias("centres"))
    pairs = r.join(bundle, "sample").select("sample", "student", "teacher", F.inline("centres"))
    gap = cos(F.col("teacher"), F.col("ct")) - cos(F.col("student"), F.col("cs"))
    relation = pairs.groupBy("sample").agg(F.avg(gap * gap).alias("relation_loss"))
    return centre_loss.join(relation, "sample")


def feature_mse(rows: DataFrame) -> DataFrame:
    """Mean squared difference over every position of two feature arrays."""
    sq = F.aggregate(F.zip_with("student", "teacher", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return rows.agg((F.sum(sq) / F.sum(F.size("student"))).alias("mse"))


def frame_candidates(stats: DataFrame, k: int, rank: str = "both") -> DataFrame:
    """Frames worth exporting: by floor share, by the overlap of near and far halves, or both
    (the sum). Our own ranking; the score is the smaller of near and far for occlusion."""
    occlusion = F.least("near_pct", "far_pct")
    score = {"floor": F.col("floor_pct"), "occlusion": occlusion, "both": F.col("floor_pct") + occlusion}[rank]
    return stats.withColumn("score", score).orderBy(F.desc("score"), "frame").limit(k)
