"""Queries over sensor series, trajectories and tracking."""

from pyspark.sql import functions as F

from voxmill.catalog.registry import query
from voxmill.operators import series as S

K, TOL = 12, 0.05
MAG = "sqrt(x*x + y*y + z*z)"


def r(df, digits, *cols):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("hold_gravity", "T01", f"""
WITH h AS (SELECT i.* FROM fx_imu i JOIN (SELECT capture, MIN(t) AS t0 FROM fx_imu GROUP BY capture) m ON i.capture = m.capture WHERE t - t0 BETWEEN 0 AND 5),
a AS (SELECT capture, COUNT(*) AS samples, STDDEV_POP({MAG}) AS sd, AVG(x) AS x, AVG(y) AS y, AVG(z) AS z FROM h GROUP BY capture),
u AS (SELECT *, x/{MAG} AS ux, y/{MAG} AS uy, z/{MAG} AS uz FROM a), w AS (SELECT *, DEGREES(ACOS(LEAST(1, GREATEST(-1, -uy)))) AS tilt FROM u)
SELECT capture, samples, ROUND(sd, 7) AS mag_std, ROUND(tilt, 5) AS tilt_deg, ROUND(300 * TAN(RADIANS(tilt)), 4) AS offset_at_3m_cm,
  ROUND(DEGREES(ATAN2(-uz, -uy)), 5) AS pitch_down_deg, ROUND(DEGREES(ATAN2(ux, -uy)), 5) AS roll_deg,
  CASE WHEN samples < 20 THEN 'few samples' WHEN sd > 0.05 * 9.81 THEN 'moving' WHEN tilt > 45 THEN 'implausible' WHEN tilt > 2 THEN 'warn' ELSE 'ok' END AS status FROM w""")
def hold_gravity(t):
    g = S.hold_gravity(t.fx_imu)
    return r(r(r(g, 7, "mag_std"), 5, "tilt_deg", "pitch_down_deg", "roll_deg"), 4, "offset_at_3m_cm")


# The filter as a recursion over the samples of all captures at once.
GRAVITY = """WITH RECURSIVE f AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY capture ORDER BY idx) AS n, sqrt(x*x + y*y + z*z) AS m FROM fx_imu),
b(capture, n, idx, ux, uy, uz, mag, used) AS (
  SELECT DISTINCT capture, 0::BIGINT, NULL::BIGINT, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, FALSE FROM f
  UNION ALL
  SELECT capture, n, idx, CASE WHEN ok THEN CASE WHEN mag IS NULL THEN x ELSE 0.75e0 * ux + 0.25e0 * x END ELSE ux END, CASE WHEN ok THEN CASE WHEN mag IS NULL THEN y ELSE 0.75e0 * uy + 0.25e0 * y END ELSE uy END,
    CASE WHEN ok THEN CASE WHEN mag IS NULL THEN z ELSE 0.75e0 * uz + 0.25e0 * z END ELSE uz END, CASE WHEN ok THEN CASE WHEN mag IS NULL THEN m ELSE 0.98e0 * mag + 0.02e0 * m END ELSE mag END, ok
  FROM (SELECT b.capture, f.n, f.idx, b.ux, b.uy, b.uz, b.mag, f.x, f.y, f.z, f.m, f.m >= 1e-3 AND (b.mag IS NULL OR abs(f.m - b.mag) <= 0.08e0 * b.mag) AS ok
        FROM b JOIN f ON f.capture = b.capture AND f.n = b.n + 1) q) """


@query("smoothed_gravity", "T02", GRAVITY + "SELECT capture, n - 1 AS rn, ROUND(ux, 9) AS ux, ROUND(uy, 9) AS uy, ROUND(uz, 9) AS uz, used FROM b WHERE n > 0")
def smoothed_gravity(t):
    return r(S.smoothed_gravity(t.fx_imu), 9, "ux", "uy", "uz")


REST = f"""i AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY capture ORDER BY idx) - 1 AS rn, COUNT(*) OVER (PARTITION BY capture) AS n FROM fx_imu),
s AS (SELECT *, SQRT(VAR_POP(x) OVER w + VAR_POP(y) OVER w + VAR_POP(z) OVER w) AS wander FROM i
  WINDOW w AS (PARTITION BY capture ORDER BY rn ROWS BETWEEN CURRENT ROW AND {K - 1} FOLLOWING)),
c AS (SELECT *, MIN(CASE WHEN rn < n - {K} THEN wander END) OVER (PARTITION BY capture ORDER BY rn ROWS BETWEEN {K - 1} PRECEDING AND CURRENT ROW) AS calm FROM s),
rest AS (SELECT capture, idx, t, x, y, z, rn, n, COALESCE(calm < {TOL}, FALSE) AS rest FROM c)"""


def rest(t):
    return S.rest_mask(t.fx_imu, K, TOL, width=512).withColumn("rest", F.coalesce("rest", F.lit(False)))


@query("rest_mask", "T03", f"WITH {REST} SELECT capture, idx, rest FROM rest")
def rest_mask(t):
    return rest(t).select("capture", "idx", "rest")


@query("still_stretches", "T04", f"""WITH {REST},
b AS (SELECT *, SUM(CASE WHEN rest AND NOT COALESCE(pr, FALSE) THEN 1 ELSE 0 END) OVER (PARTITION BY capture ORDER BY rn) AS stretch
  FROM (SELECT *, LAG(rest) OVER (PARTITION BY capture ORDER BY rn) AS pr FROM rest) q),
u AS (SELECT capture, stretch, x/{MAG} AS ux, y/{MAG} AS uy, z/{MAG} AS uz FROM b WHERE rest),
m AS (SELECT capture, stretch, COUNT(*) AS len, AVG(ux) AS x, AVG(uy) AS y, AVG(uz) AS z FROM u GROUP BY ALL HAVING COUNT(*) >= 8)
SELECT u.capture, CAST(u.stretch AS BIGINT) AS stretch, len, ROUND(STDDEV_POP(DEGREES(ACOS(LEAST(1, GREATEST(-1, (ux*x + uy*y + uz*z)/{MAG}))))), 5) AS spread_deg
FROM u JOIN m ON u.capture = m.capture AND u.stretch = m.stretch GROUP BY u.capture, u.stretch, len""")
def still_stretches(t):
    return r(S.still_stretches(rest(t)), 5, "spread_deg")


@query("averaging_curve", "T05", f"""
WITH h AS (SELECT i.*, ROW_NUMBER() OVER (PARTITION BY i.capture ORDER BY idx) - 1 AS rn, COUNT(*) OVER (PARTITION BY i.capture) AS n FROM fx_imu i
  JOIN (SELECT capture, MIN(t) AS t0 FROM fx_imu GROUP BY capture) m ON i.capture = m.capture WHERE t < t0 + 20),
b AS (SELECT capture, k, rn // k AS block, AVG(x) AS x, AVG(y) AS y, AVG(z) AS z FROM h CROSS JOIN (SELECT UNNEST([1,2,4,8,16,32,64]) AS k) q
  WHERE n >= 64 AND n // k >= 4 AND rn // k < n // k GROUP BY ALL),
u AS (SELECT capture, k, x/{MAG} AS ux, y/{MAG} AS uy, z/{MAG} AS uz FROM b),
m AS (SELECT capture, k, AVG(ux) AS x, AVG(uy) AS y, AVG(uz) AS z FROM u GROUP BY ALL),
d AS (SELECT u.capture, u.k, STDDEV_POP(DEGREES(ACOS(LEAST(1, GREATEST(-1, (ux*x + uy*y + uz*z)/{MAG}))))) AS deg FROM u JOIN m ON u.capture = m.capture AND u.k = m.k GROUP BY ALL)
SELECT capture, k, ROUND(k / 63.0, 9) AS tau_s, ROUND(deg, 5) AS deg, ROUND(FIRST_VALUE(deg) OVER (PARTITION BY capture ORDER BY k) / SQRT(k), 5) AS white_noise FROM d""")
def averaging_curve(t):
    return r(r(S.averaging_curve(t.fx_imu, hold_s=20.0), 5, "deg", "white_noise"), 9, "tau_s")


@query("sensor_summary", "T06", f"""WITH {REST}, m AS (SELECT *, {MAG} AS mag FROM rest)
SELECT capture, COUNT(*) AS samples, ROUND(100.0 * AVG(rest::INT), 8) AS rest_pct, ROUND(AVG(CASE WHEN rest THEN mag END), 7) AS mag_rest,
  ROUND(100 * (AVG(CASE WHEN rest THEN mag END) - 9.80665) / 9.80665, 6) AS bias_pct, ROUND(STDDEV_POP(CASE WHEN rest THEN mag END), 7) AS mag_rest_std,
  ROUND(MAX(CASE WHEN NOT rest THEN mag END), 7) AS mag_moving_max FROM m GROUP BY capture""")
def sensor_summary(t):
    s = S.sensor_summary(rest(t))
    return r(r(r(s, 7, "mag_rest", "mag_rest_std", "mag_moving_max"), 8, "rest_pct"), 6, "bias_pct")


@query("rest_sweep", "T06", f"""WITH {REST} SELECT c.capture, tol, ROUND(100.0 * SUM(COALESCE(calm < tol, FALSE)::INT) / COUNT(*), 8) AS rest_pct
FROM c CROSS JOIN (SELECT UNNEST([0.02e0, 0.04e0, 0.06e0, 0.1e0, 0.2e0]) AS tol) q GROUP BY c.capture, tol""")
def rest_sweep(t):
    return r(S.rest_sweep(t.fx_imu, K, [0.02, 0.04, 0.06, 0.1, 0.2], width=512), 8, "rest_pct")


ASOF = f"""{REST}, last AS (SELECT capture, MAX(t) AS lt FROM fx_tracked GROUP BY capture),
h AS (SELECT r.*, COALESCE((SELECT MIN(f.t) FROM fx_tracked f WHERE f.capture = r.capture AND f.t >= r.t), l.lt) AS ft FROM rest r JOIN last l ON l.capture = r.capture),
j AS (SELECT h.capture, h.idx, h.t, h.rest, f.frame, h.x, h.y, h.z, f.ux, f.uy, f.uz FROM h JOIN fx_tracked f ON f.capture = h.capture AND f.t = h.ft WHERE ABS(h.ft - h.t) <= 0.1),
e AS (SELECT *, DEGREES(ACOS(LEAST(1, GREATEST(-1, (x*ux + y*uy + z*uz) / ({MAG} * sqrt(ux*ux + uy*uy + uz*uz)))))) AS err FROM j)"""


def errors(t):
    return S.pose_error(rest(t), t.fx_tracked)


@query("asof_pose_error", "J04 T07", f"WITH {ASOF} SELECT capture, idx, frame, rest, ROUND(err, 5) AS err FROM e")
def asof_pose_error(t):
    return errors(t).select("capture", "idx", "frame", "rest", F.round("err", 5).alias("err"))


@query("drift_slope", "T07", f"""WITH {ASOF}, d AS (SELECT capture, COUNT(*) AS n, MAX(t) - MIN(t) AS span_s, 60 * REGR_SLOPE(err, t) AS k FROM e WHERE rest GROUP BY capture)
SELECT capture, n, ROUND(span_s, 7) AS span_s, ROUND(CASE WHEN n > 30 AND span_s > 10 THEN k END, 5) AS deg_per_min FROM d""")
def drift_slope(t):
    return r(r(S.drift_slope(errors(t)), 7, "span_s"), 5, "deg_per_min")


@query("sensor_bias", "T08 U02")
def sensor_bias(t):
    """Rows-only: an eigenproblem per capture. Rotated copies of the resting vector give it directions."""
    s = rest(t).filter("rest")
    c, d = F.cos(F.col("idx") * 0.7), F.sin(F.col("idx") * 0.7)
    e, f = F.cos(F.col("idx") * 0.31), F.sin(F.col("idx") * 0.31)
    y2, z2 = F.col("y") * c - F.col("z") * d, F.col("y") * d + F.col("z") * c
    turned = s.select("capture", (F.col("x") * e - y2 * f + 0.2).alias("x"), ((F.col("x") * f + y2 * e) * 1.01 - 0.1).alias("y"), (z2 * 0.99).alias("z"))
    return S.fit_bias(turned)


RUNS = """a AS (SELECT * FROM fx_runs WHERE run = 'forward'), b AS (SELECT * FROM fx_runs WHERE run = 'reverse'),
k AS (SELECT a.capture, MAX(a.frame) AS anchor FROM a JOIN b ON a.capture = b.capture AND a.frame = b.frame GROUP BY a.capture HAVING COUNT(*) >= 10),
ra AS (SELECT a.capture, a.frame, r.* FROM a JOIN k ON k.capture = a.capture JOIN a AS o ON o.capture = k.capture AND o.frame = k.anchor, LATERAL (SELECT
  o.r00*a.r00 + o.r10*a.r10 + o.r20*a.r20 AS m00, o.r00*a.r01 + o.r10*a.r11 + o.r20*a.r21 AS m01, o.r00*a.r02 + o.r10*a.r12 + o.r20*a.r22 AS m02,
  o.r01*a.r00 + o.r11*a.r10 + o.r21*a.r20 AS m10, o.r01*a.r01 + o.r11*a.r11 + o.r21*a.r21 AS m11, o.r01*a.r02 + o.r11*a.r12 + o.r21*a.r22 AS m12,
  o.r02*a.r00 + o.r12*a.r10 + o.r22*a.r20 AS m20, o.r02*a.r01 + o.r12*a.r11 + o.r22*a.r21 AS m21, o.r02*a.r02 + o.r12*a.r12 + o.r22*a.r22 AS m22,
  o.r00*(a.tx-o.tx) + o.r10*(a.ty-o.ty) + o.r20*(a.tz-o.tz) AS px, o.r01*(a.tx-o.tx) + o.r11*(a.ty-o.ty) + o.r21*(a.tz-o.tz) AS py, o.r02*(a.tx-o.tx) + o.r12*(a.ty-o.ty) + o.r22*(a.tz-o.tz) AS pz) r),
rb AS (SELECT a.capture, a.frame, r.* FROM b AS a JOIN k ON k.capture = a.capture JOIN b AS o ON o.capture = k.capture AND o.frame = k.anchor, LATERAL (SELECT
  o.r00*a.r00 + o.r10*a.r10 + o.r20*a.r20 AS m00, o.r00*a.r01 + o.r10*a.r11 + o.r20*a.r21 AS m01, o.r00*a.r02 + o.r10*a.r12 + o.r20*a.r22 AS m02,
  o.r01*a.r00 + o.r11*a.r10 + o.r21*a.r20 AS m10, o.r01*a.r01 + o.r11*a.r11 + o.r21*a.r21 AS m11, o.r01*a.r02 + o.r11*a.r12 + o.r21*a.r22 AS m12,
  o.r02*a.r00 + o.r12*a.r10 + o.r22*a.r20 AS m20, o.r02*a.r01 + o.r12*a.r11 + o.r22*a.r21 AS m21, o.r02*a.r02 + o.r12*a.r12 + o.r22*a.r22 AS m22,
  o.r00*(a.tx-o.tx) + o.r10*(a.ty-o.ty) + o.r20*(a.tz-o.tz) AS px, o.r01*(a.tx-o.tx) + o.r11*(a.ty-o.ty) + o.r21*(a.tz-o.tz) AS py, o.r02*(a.tx-o.tx) + o.r12*(a.ty-o.ty) + o.r22*(a.tz-o.tz) AS pz) r),
d AS (SELECT ra.capture, ra.frame, SQRT((ra.px-rb.px)*(ra.px-rb.px) + (ra.py-rb.py)*(ra.py-rb.py) + (ra.pz-rb.pz)*(ra.pz-rb.pz)) AS metres,
  DEGREES(ACOS(LEAST(1, GREATEST(-1, (ra.m00*rb.m00 + ra.m10*rb.m10 + ra.m20*rb.m20 + ra.m01*rb.m01 + ra.m11*rb.m11 + ra.m21*rb.m21 + ra.m02*rb.m02 + ra.m12*rb.m12 + ra.m22*rb.m22 - 1) / 2)))) AS degrees
  FROM ra JOIN rb ON ra.capture = rb.capture AND ra.frame = rb.frame),
p AS (SELECT capture, COUNT(*) AS poses, SUM(step) AS path_m FROM (SELECT capture, SQRT(POW(tx - LAG(tx) OVER w, 2) + POW(ty - LAG(ty) OVER w, 2) + POW(tz - LAG(tz) OVER w, 2)) AS step
  FROM a WINDOW w AS (PARTITION BY capture ORDER BY frame)) q GROUP BY capture)"""


def diff(t):
    return S.run_differences(t.fx_runs)


@query("run_differences", "T09 J10", f"WITH {RUNS} SELECT capture, frame, ROUND(metres, 6) AS metres, ROUND(degrees, 4) AS degrees FROM d")
def run_differences(t):
    return r(r(diff(t), 6, "metres"), 4, "degrees")


@query("path_length", "T10", """
SELECT capture, run, COUNT(*) AS poses, ROUND(SUM(step), 5) AS path_m FROM (SELECT capture, run,
  SQRT(POW(tx - LAG(tx) OVER w, 2) + POW(ty - LAG(ty) OVER w, 2) + POW(tz - LAG(tz) OVER w, 2)) AS step FROM fx_runs WINDOW w AS (PARTITION BY capture, run ORDER BY frame)) q GROUP BY capture, run""")
def path_length(t):
    return r(S.path_length(t.fx_runs, ["capture", "run"]), 5, "path_m")


@query("drift_summary", "T09 T10", f"""WITH {RUNS}
SELECT d.capture, COUNT(*) AS n, ROUND(MAX(metres), 6) AS trans_max, ROUND(MAX(degrees), 4) AS rot_max, ROUND(ARG_MIN(metres, frame), 6) AS trans_far_end,
  ROUND(ARG_MIN(degrees, frame), 4) AS rot_far_end, ROUND(QUANTILE_CONT(metres, 0.5), 6) AS trans_median, ROUND(QUANTILE_CONT(degrees, 0.5), 4) AS rot_median,
  ROUND(path_m, 5) AS path_m, ROUND(100 * ARG_MIN(metres, frame) / path_m, 6) AS far_end_pct FROM d JOIN p ON d.capture = p.capture GROUP BY d.capture, path_m""")
def drift_summary(t):
    s = S.drift_summary(diff(t), S.path_length(t.fx_runs.filter("run = 'forward'"), ["capture"]))
    return r(r(r(s, 6, "trans_max", "trans_far_end", "trans_median", "far_end_pct"), 4, "rot_max", "rot_far_end", "rot_median"), 5, "path_m")


@query("trajectory_check", "T11 J05", """
WITH q AS (SELECT capture, tx, ty, tz FROM fx_runs WHERE run = 'reverse'), f AS (SELECT capture, tx, ty, tz FROM fx_runs WHERE run = 'forward'),
d AS (SELECT q.capture, (SELECT MIN(POW(q.tx - f.tx, 2) + POW(q.ty - f.ty, 2) + POW(q.tz - f.tz, 2)) FROM f WHERE f.capture = q.capture
  AND f.tx BETWEEN q.tx - 0.5 AND q.tx + 0.5) AS d2 FROM q)
SELECT capture, COUNT(*) AS matched, ROUND(MAX(SQRT(d2)), 6) AS max, ROUND(QUANTILE_CONT(SQRT(d2), 0.5), 6) AS median, ROUND(QUANTILE_CONT(SQRT(d2), 0.9), 6) AS p90,
  QUANTILE_CONT(SQRT(d2), 0.5) < 0.102 AS passed FROM d WHERE d2 <= 0.25 GROUP BY capture""")
def trajectory_check(t):
    p = t.fx_runs.select("capture", "run", F.col("frame").alias("id"), F.col("tx").alias("x"), F.col("ty").alias("y"), F.col("tz").alias("z"))
    return r(S.trajectory_check(p.filter("run = 'reverse'"), p.filter("run = 'forward'"), 0.5, 0.102), 6, "max", "median", "p90")


GATE = "CASE WHEN error IS NOT NULL THEN 'error' WHEN fitness IS NULL THEN 'no fitness' WHEN fitness < 0.1 THEN 'fitness' WHEN step_m > 1e0 * {dt} OR turn_deg > 120e0 * {dt} THEN 'jump' END"


@query("step_gate", "T12", f"SELECT capture, frame, {GATE.format(dt='0.5e0')} AS why FROM fx_tracking")
def step_gate(t):
    return S.step_gate(t.fx_tracking).select("capture", "frame", "why")


# The gate as a recursion over the frames of all captures at once.
BELIEF = """WITH RECURSIVE f AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY capture ORDER BY frame) AS n FROM fx_tracking),
b(capture, n, frame, phase, cnt, recent, verb, why, back) AS (
  SELECT DISTINCT capture, 0::BIGINT, NULL::BIGINT, 'tracking', 0, CAST([] AS DOUBLE[]), NULL::VARCHAR, NULL::VARCHAR, 0 FROM f
  UNION ALL
  SELECT capture, n, frame, CASE WHEN back = 1 THEN 'tracking' ELSE to_phase END, CASE WHEN back = 1 OR (phase = 'tracking' AND to_phase = 'lost') THEN 0 ELSE to_cnt END,
    CASE WHEN verb = 'integrate' THEN list_append(recent, fitness)[-30:] ELSE recent END, verb, why, back
  FROM (SELECT *, CASE WHEN why IS NOT NULL THEN 'drop' WHEN to_phase = 'tracking' OR back = 1 THEN 'integrate' ELSE 'confirm' END AS verb
    FROM (SELECT *, CASE WHEN phase <> 'tracking' AND to_cnt >= 3 THEN 1 ELSE 0 END AS back,
        CASE WHEN phase = 'tracking' THEN CASE WHEN to_cnt >= 15 THEN 'lost' ELSE 'tracking' END WHEN why IS NULL THEN 'probing' ELSE 'lost' END AS to_phase
      FROM (SELECT *, CASE WHEN phase = 'tracking' THEN CASE WHEN why IS NULL THEN 0 ELSE cnt + 1 END WHEN why IS NULL THEN cnt + 1 ELSE 0 END AS to_cnt
        FROM (SELECT b.capture, f.n, f.frame, b.phase, b.cnt, b.recent, f.fitness,
            CASE WHEN f.error IS NOT NULL THEN 'error' WHEN f.fitness IS NULL THEN 'no fitness'
                 WHEN f.fitness < CASE WHEN len(b.recent) < 5 THEN 0.1e0 ELSE LEAST(GREATEST(0.6e0 * list_aggregate(b.recent, 'median'), 0.1e0), 0.55e0) END THEN 'fitness'
                 WHEN b.phase <> 'lost' AND (f.step_m > 0.5e0 OR f.turn_deg > 60e0) THEN 'jump' END AS why
          FROM b JOIN f ON f.capture = b.capture AND f.n = b.n + 1) q1) q2) q3) q4),
g AS (SELECT capture, frame, verb, why, phase <> 'tracking' AS lost, back AS reacquired FROM b WHERE n > 0) """


@query("belief_gate", "T13 R01", BELIEF + "SELECT * FROM g")
def belief_gate(t):
    return S.belief(t.fx_tracking).drop("rn")


@query("belief_report", "T13 R07", BELIEF + """SELECT capture, COUNT(*) AS frames, COUNT_IF(verb = 'integrate')::BIGINT AS integrated, COUNT_IF(verb = 'drop')::BIGINT AS dropped,
  COUNT_IF(verb <> 'integrate')::BIGINT AS held, SUM(reacquired)::BIGINT AS reacquired FROM g GROUP BY capture""")
def belief_report(t):
    return S.belief_report(S.belief(t.fx_tracking))


@query("fused_until_lost", "T14", f"""
WITH g AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY capture ORDER BY frame) AS rn, {GATE.format(dt='(1.0e0 / 60.0e0)')} AS why FROM fx_tracking),
s AS (SELECT *, SUM((why IS NOT NULL)::INT) OVER (PARTITION BY capture ORDER BY rn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS run FROM g),
m AS (SELECT capture, MIN(rn) AS stop_rn, MIN(frame) AS stop_frame FROM s WHERE run >= 5 GROUP BY capture)
SELECT g.capture, SUM((why IS NULL)::INT)::BIGINT AS fused, SUM((why IS NOT NULL)::INT)::BIGINT AS dropped, MAX(stop_frame) AS stop_frame,
  MIN(CASE WHEN why IS NULL THEN fitness END) AS fitness_min, QUANTILE_CONT(CASE WHEN why IS NULL THEN fitness END, 0.5) AS fitness_median
FROM g LEFT JOIN m ON g.capture = m.capture WHERE stop_rn IS NULL OR rn <= stop_rn GROUP BY g.capture""")
def fused_until_lost(t):
    return S.fused_until_lost(t.fx_tracking, fps=60.0, lost_after=5)


@query("frame_rates", "T15", """
WITH c AS (SELECT capture, COUNT(*) AS seen, (MAX(frame) - MIN(frame)) / 75e0 AS dur FROM fx_tracking GROUP BY capture)
SELECT capture, seen, ROUND(CASE WHEN dur > 0 AND seen / dur < 0.8 * (15 + capture) THEN seen / dur ELSE 15 + capture END, 7) AS fps FROM c""")
def frame_rates(t):
    c = t.fx_tracking.groupBy("capture").agg(F.count(F.lit(1)).alias("seen"), ((F.max("frame") - F.min("frame")) / 75.0).alias("dur"))
    return c.select("capture", "seen", F.round(S.frame_rate(F.col("seen"), F.col("dur"), (15 + F.col("capture")).cast("double")), 7).alias("fps"))


@query("dropped_frames", "T16", """
SELECT capture, CAST(SUM(GREATEST(seq_no - p - 1, 0)) AS BIGINT) AS dropped, COUNT(*) AS frames
FROM (SELECT *, LAG(seq_no) OVER (PARTITION BY capture ORDER BY frame) AS p FROM fx_tracking) q GROUP BY capture""")
def dropped_frames(t):
    return S.dropped_frames(t.fx_tracking)


def plane_sql(name, of, key):
    """Least-squares planes of the points ``of`` (key, p0..p2, up0..up2), by the closed form for the least eigenvector."""
    return f"""{name}_m AS (SELECT {key}, COUNT(*) AS n, {", ".join(f"ANY_VALUE(up{i}) AS up{i}, SUM(p{i}) / COUNT(*) AS c{i}" for i in range(3))},
  {", ".join(f"SUM(p{i} * p{j}) / COUNT(*) AS r{i}{j}" for i in range(3) for j in range(i, 3))} FROM {of} GROUP BY {key}),
{name}_q AS (SELECT *, {", ".join(f"r{i}{j} - c{i} * c{j} AS q{i}{j}" for i in range(3) for j in range(i, 3))} FROM {name}_m),
{name}_a AS (SELECT *, (q00 + q11 + q22) / 3 AS mean FROM {name}_q),
{name}_b AS (SELECT *, q00 - mean AS a, q11 - mean AS b, q22 - mean AS c FROM {name}_a),
{name}_p AS (SELECT *, SQRT((a * a + b * b + c * c + 2 * (q01 * q01 + q02 * q02 + q12 * q12)) / 6) AS p,
  a * (b * c - q12 * q12) - q01 * (q01 * c - q12 * q02) + q02 * (q01 * q12 - b * q02) AS det FROM {name}_b),
{name}_l AS (SELECT *, CASE WHEN p > 0 THEN mean + 2 * p * COS(ACOS(GREATEST(-1, LEAST(1, det / (2 * p * p * p)))) / 3 + 2 * PI() / 3) END AS lam FROM {name}_p),
{name}_x AS (SELECT *, q01 * q12 - q02 * (q11 - lam) AS x0, q02 * q01 - (q00 - lam) * q12 AS x1, (q00 - lam) * (q11 - lam) - q01 * q01 AS x2,
  q01 * (q22 - lam) - q02 * q12 AS y0, q02 * q02 - (q00 - lam) * (q22 - lam) AS y1, (q00 - lam) * q12 - q01 * q02 AS y2,
  (q11 - lam) * (q22 - lam) - q12 * q12 AS z0, q12 * q02 - q01 * (q22 - lam) AS z1, q01 * q12 - (q11 - lam) * q02 AS z2 FROM {name}_l),
{name}_n AS (SELECT *, {", ".join(f"{v}0 * {v}0 + {v}1 * {v}1 + {v}2 * {v}2 AS {v}n" for v in "xyz")} FROM {name}_x),
{name}_e AS (SELECT *, {", ".join(f"CASE WHEN GREATEST(xn, yn, zn) > 0 THEN CASE WHEN xn >= yn AND xn >= zn THEN x{i} WHEN yn >= zn THEN y{i} ELSE z{i} END / SQRT(GREATEST(xn, yn, zn)) ELSE up{i} END AS e{i}" for i in range(3))} FROM {name}_n),
{name}_s AS (SELECT *, CASE WHEN e0 * up0 + e1 * up1 + e2 * up2 < 0 THEN -1 ELSE 1 END AS side FROM {name}_e),
{name} AS (SELECT {key}, side * e0 AS n0, side * e1 AS n1, side * e2 AS n2, -side * (e0 * c0 + e1 * c1 + e2 * c2) AS d FROM {name}_s)"""


@query("camera_floor", "T17 U02", f"""WITH pts AS (SELECT d.frame, (u - cx) * z / fx AS p0, (v - cy) * z / fy AS p1, z AS p2, r20 AS up0, r21 AS up1, r22 AS up2
  FROM (SELECT *, depth_mm / 1000e0 AS z FROM fx_depth WHERE depth_mm > 0) d JOIN fx_frames f ON d.frame = f.frame),
band AS (SELECT *, -(p0 * up0 + p1 * up1 + p2 * up2) AS h FROM pts WHERE -(p0 * up0 + p1 * up1 + p2 * up2) > 0.4e0 AND -(p0 * up0 + p1 * up1 + p2 * up2) < 2.5e0),
hist AS (SELECT frame, LEAST(FLOOR((h - 0.4e0) / 0.02e0)::INT, 104) AS bin, COUNT(*) AS c FROM band GROUP BY ALL),
tops AS (SELECT *, MAX(c) OVER (PARTITION BY frame) AS top, SUM(c) OVER (PARTITION BY frame) AS band_n FROM hist),
peaks AS (SELECT frame, 0.4e0 + 0.02e0 * MAX(bin) FILTER (c >= GREATEST(0.15e0 * top, 1e0)) AS peak, ANY_VALUE(band_n) AS band_n FROM tops WHERE band_n >= 20 GROUP BY frame),
b AS (SELECT band.*, peak, band_n FROM band JOIN peaks ON band.frame = peaks.frame), s1 AS (SELECT * FROM b WHERE ABS(h - (peak + 0.01e0)) < 0.06e0),
{plane_sql("f1", "s1", "frame")},
near1 AS (SELECT b.* FROM b JOIN f1 ON b.frame = f1.frame WHERE ABS(p0 * n0 + p1 * n1 + p2 * n2 + d) < 0.03e0),
s2 AS (SELECT * FROM near1 WHERE frame IN (SELECT frame FROM near1 GROUP BY frame HAVING COUNT(*) >= 10)),
{plane_sql("f2", "s2", "frame")},
near2 AS (SELECT b.frame, COUNT(*) AS inliers FROM b JOIN f2 ON b.frame = f2.frame WHERE ABS(p0 * n0 + p1 * n1 + p2 * n2 + d) < 0.03e0 GROUP BY b.frame),
planes AS (SELECT * FROM f2 UNION ALL SELECT * FROM f1 WHERE frame NOT IN (SELECT frame FROM f2)),
one AS (SELECT frame, ANY_VALUE(up0) AS up0, ANY_VALUE(up1) AS up1, ANY_VALUE(up2) AS up2, ANY_VALUE(peak) AS peak, ANY_VALUE(band_n) AS band_n FROM b GROUP BY frame),
res AS (SELECT p.frame, ABS(d) AS height, DEGREES(ACOS(LEAST(1, ABS(n0 * up0 + n1 * up1 + n2 * up2)))) AS tilt_deg, COALESCE(inliers, 0) AS inliers, peak, band_n
  FROM planes p JOIN one ON p.frame = one.frame LEFT JOIN near2 ON near2.frame = p.frame),
why AS (SELECT *, CASE WHEN tilt_deg > 3 THEN 'tilted' WHEN inliers < 10 THEN 'few points' END AS error FROM res)
SELECT frame, ROUND(height, 5) AS height, ROUND(tilt_deg, 3) AS tilt_deg, inliers::BIGINT AS inliers, ROUND(peak, 9) AS peak_below_lens, band_n::BIGINT AS points_in_band, error,
  CASE WHEN error IS NULL THEN ROUND(height, 5) END AS camera_height FROM why""")
def camera_floor(t):
    """Plane fits under each camera; the tests rebuild a known floor too."""
    f = S.fit_floor(S.camera_points(t.fx_depth, t.fx_frames), ["frame"], min_band=20, min_inliers=10)
    return S.floor_gate(f, min_inliers=10).withColumns({"height": F.round("height", 5), "camera_height": F.round("camera_height", 5), "tilt_deg": F.round("tilt_deg", 3),
                                                        "peak_below_lens": F.round("peak_below_lens", 9)})


@query("room_floor", "T18", f"""WITH lv AS (SELECT cloud, x, y, z, FLOOR(z / 0.02e0)::INT AS level, FLOOR(x / 0.2e0)::INT AS gx, FLOOR(y / 0.2e0)::INT AS gy FROM fx_points),
area AS (SELECT cloud, level FROM (SELECT DISTINCT cloud, level, gx, gy FROM lv) q GROUP BY ALL HAVING 0.04e0 * COUNT(*) >= 0.2e0),
low AS (SELECT cloud, MIN(level) AS low FROM area GROUP BY cloud),
s AS (SELECT lv.*, x AS p0, y AS p1, z AS p2, 0e0 AS up0, 0e0 AS up1, 1e0 AS up2 FROM lv JOIN low ON lv.cloud = low.cloud WHERE ABS(z - (low + 0.5e0) * 0.02e0) <= 0.03e0),
{plane_sql("pl", "s", "cloud")},
foot AS (SELECT cloud, 0.04e0 * COUNT(*) AS area_m2 FROM (SELECT DISTINCT cloud, gx, gy FROM s) q GROUP BY cloud),
zs AS (SELECT cloud, QUANTILE_CONT(ROUND(z, 4), 0.5) AS floor_z, COUNT(*) AS vertices FROM s GROUP BY cloud)
SELECT zs.cloud, ROUND(floor_z, 6) AS floor_z, vertices, ROUND(area_m2, 6) AS area_m2, ROUND(DEGREES(ACOS(LEAST(1, ABS(n2)))), 3) AS tilt_deg,
  CASE WHEN ABS(floor_z) > 0.04e0 OR DEGREES(ACOS(LEAST(1, ABS(n2)))) > 2 THEN 'warn' ELSE 'ok' END AS status
FROM zs JOIN foot ON foot.cloud = zs.cloud JOIN pl ON pl.cloud = zs.cloud""")
def room_floor(t):
    return S.room_floor(t.fx_points, "cloud", min_area=0.2).withColumns({"floor_z": F.round("floor_z", 6), "area_m2": F.round("area_m2", 6), "tilt_deg": F.round("tilt_deg", 3)})


HEIGHTS = "SELECT capture, frame, 0.5e0 + fitness * 1.5e0 + frame % 1009 / 300e0 AS height FROM fx_tracking"
# The rule as a recursion over each capture's records.
HEIGHT = f"""WITH RECURSIVE h AS ({HEIGHTS}),
m AS (SELECT *, MAX(height) OVER (PARTITION BY capture ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM h WHERE height IS NOT NULL),
f AS (SELECT capture, frame, height, ROW_NUMBER() OVER (PARTITION BY capture ORDER BY frame) AS n FROM m WHERE top IS NULL OR height > top),
b(capture, n, frame, value, took) AS (SELECT capture, n, frame, height, TRUE FROM f WHERE n = 1
  UNION ALL SELECT b.capture, f.n, f.frame, CASE WHEN f.height > b.value + 0.02e0 THEN f.height ELSE b.value END, f.height > b.value + 0.02e0
  FROM b JOIN f ON f.capture = b.capture AND f.n = b.n + 1) """


def heights(t):
    return t.fx_tracking.select("capture", "frame", (0.5 + F.col("fitness") * 1.5 + F.col("frame") % 1009 / 300.0).alias("height"))


@query("best_height", "T19", HEIGHT + "SELECT capture, frame, ROUND(value, 9) AS value FROM b WHERE took")
def best_height(t):
    return r(S.best_height(heights(t)), 9, "value")


SETTLED = """WITH o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY capture ORDER BY frame) AS offer, r + g + b AS tot FROM fx_white),
c AS (SELECT capture, offer, r/tot AS r, g/tot AS g, b/tot AS b FROM o WHERE tot > 0),
d AS (SELECT *, COALESCE(GREATEST(ABS(r - LAG(r) OVER w), ABS(g - LAG(g) OVER w), ABS(b - LAG(b) OVER w)) < 8e-4, FALSE)::INT AS calm,
  ROW_NUMBER() OVER w AS k, LAG(r) OVER w AS pr FROM c WINDOW w AS (PARTITION BY capture ORDER BY offer)),
s AS (SELECT *, SUM(CASE WHEN pr IS NULL THEN 0 ELSE calm END) OVER (PARTITION BY capture ORDER BY k ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS run FROM d),
a AS (SELECT capture, MIN(offer) AS st FROM s WHERE run >= 8 GROUP BY capture),
n AS (SELECT capture, MAX(offer) AS offered, MIN(CASE WHEN offer >= 150 AND tot > 0 THEN offer END) AS cap_at FROM o GROUP BY capture),
ended AS (SELECT n.capture, offered, CASE WHEN cap_at IS NOT NULL AND (st IS NULL OR st > cap_at) THEN cap_at ELSE st END AS settled_at,
  cap_at IS NOT NULL AND (st IS NULL OR st > cap_at) AS capped FROM n LEFT JOIN a ON n.capture = a.capture) """


@query("colour_settled", "T20", SETTLED + "SELECT * FROM ended")
def colour_settled(t):
    return S.colour_settled(t.fx_white)


@query("still_match", "T21", """
WITH p AS (SELECT d.frame, d.frame + 1 AS still, depth_mm, ROUND_EVEN(60e0 * ((u - cx) * (depth_mm / 1000e0) / fx) / (depth_mm / 1000e0) + 31e0, 0) AS u2,
  ROUND_EVEN(60e0 * ((v - cy) * (depth_mm / 1000e0) / fy) / (depth_mm / 1000e0) + 23e0, 0) AS v2 FROM fx_depth d JOIN fx_frames f ON d.frame = f.frame WHERE depth_mm > 0),
j AS (SELECT p.frame, still, ABS(p.depth_mm - s.depth_mm) AS a FROM p JOIN fx_depth s ON s.frame = p.still AND s.u = p.u2 AND s.v = p.v2
  WHERE u2 >= 16 AND u2 < 48 AND v2 >= 12 AND v2 < 36 AND s.depth_mm > 0)
SELECT frame, still, COUNT(*) AS pixels, QUANTILE_CONT(a, 0.5) / 1000 AS median_abs_m, CASE WHEN QUANTILE_CONT(a, 0.5) / 1000 > 0.05 THEN 'warn' ELSE 'ok' END AS status
FROM j GROUP BY frame, still HAVING COUNT(*) >= 15""")
def still_match(t):
    pairs = t.fx_frames.select("frame", (F.col("frame") + 1).alias("still"))
    return S.still_match(pairs, t.fx_depth, t.fx_frames, dict(fx=60.0, fy=60.0, cx=31.0, cy=23.0), 64, 48, min_n=15)


@query("cloud_residual", "T22 J05", """
WITH q AS (SELECT id, cloud, x, y, z FROM fx_points WHERE r < 128), f AS (SELECT id, cloud, x, y, z FROM fx_points WHERE r >= 128),
d AS (SELECT q.id, q.cloud, (SELECT MIN((q.x-f.x)*(q.x-f.x) + (q.y-f.y)*(q.y-f.y) + (q.z-f.z)*(q.z-f.z)) FROM f WHERE f.cloud = q.cloud
  AND f.x BETWEEN q.x - 0.25 AND q.x + 0.25 AND f.y BETWEEN q.y - 0.25 AND q.y + 0.25 AND f.z BETWEEN q.z - 0.25 AND q.z + 0.25) AS d2 FROM q),
c AS (SELECT id, cloud, CASE WHEN d2 <= 0.0625 THEN d2 END AS d2 FROM d)
SELECT cloud, COUNT(*) AS n, COUNT(d2) AS inliers, ROUND(COUNT(d2) * 1.0 / COUNT(*), 9) AS fitness, ROUND(SQRT(AVG(d2)), 7) AS rmse FROM c GROUP BY cloud""")
def cloud_residual(t):
    p = t.fx_points.select("id", "cloud", "x", "y", "z", "r")
    q = p.filter("r < 128")
    f = p.filter("r >= 128").withColumnRenamed("id", "ref_id")
    return r(r(S.residual(q, f, 0.25, ["cloud"]), 9, "fitness"), 7, "rmse")


@query("height_rules", "T23", """
WITH h AS (SELECT frame, tz AS tape, tz + (frame % 9 - 4) / 20e0 AS mesh, tz + (frame % 13 - 6) / 30e0 AS lens, (frame % 11 - 5) / 40e0 AS fz, frame % 5 / 1e0 AS tilt, 1500 + frame * 37 % 2000 AS vx FROM fx_frames)
SELECT frame, CASE WHEN LEAST(ABS(mesh - lens), ABS(tape - lens)) > 0.15 THEN 'inconclusive' WHEN ABS(mesh - lens) < ABS(tape - lens) THEN 'mesh' ELSE 'tape' END AS verdict,
  ROUND(tape - fz, 4) AS new_height, CASE WHEN tilt > 3 THEN 'tilted' WHEN vx < 2000 THEN 'few points' WHEN ABS(ROUND(tape - fz, 4) - tape) < 0.01 THEN 'within 1 cm'
  WHEN NOT ROUND(tape - fz, 4) BETWEEN 0.2 AND 3.0 THEN 'implausible' END AS why FROM h""")
def height_rules(t):
    f = F.col("frame")
    h = t.fx_frames.select("frame", F.col("tz").alias("tape"), (F.col("tz") + (f % 9 - 4) / 20.0).alias("mesh"), (F.col("tz") + (f % 13 - 6) / 30.0).alias("lens"),
                           ((f % 11 - 5) / 40.0).alias("fz"), (f % 5 / 1.0).alias("tilt"), (1500 + f * 37 % 2000).alias("vx"))
    new, why = S.refine_height(F.col("tape"), F.col("fz"), F.col("tilt"), F.col("vx"))
    return h.select("frame", S.arbitrate_height(F.col("lens"), F.col("mesh"), F.col("tape")).alias("verdict"), new.alias("new_height"), why.alias("why"))


@query("reader_mismatches", "T24", """
WITH a AS (SELECT frame, SUM(depth_mm)::BIGINT AS s, SUM((depth_mm > 0)::INT)::BIGINT AS n FROM fx_depth GROUP BY frame),
b AS (SELECT frame, SUM(CASE WHEN frame % 9 = 4 AND u = 3 THEN 0 ELSE depth_mm END)::BIGINT AS s, SUM((CASE WHEN frame % 9 = 4 AND u = 3 THEN 0 ELSE depth_mm END > 0)::INT)::BIGINT AS n FROM fx_depth GROUP BY frame)
SELECT a.frame, a.s AS a_sum, a.n AS a_valid, b.s AS b_sum, b.n AS b_valid FROM a JOIN b ON a.frame = b.frame WHERE a.s <> b.s OR a.n <> b.n""")
def reader_mismatches(t):
    d = t.fx_depth
    bad = d.withColumn("depth_mm", F.when((F.col("frame") % 9 == 4) & (F.col("u") == 3), 0).otherwise(F.col("depth_mm")))
    return S.reader_mismatches(d, bad).select("frame", "a_sum", "a_valid", "b_sum", "b_valid")
