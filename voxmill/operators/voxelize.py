"""Depth pixels, points and solids to voxels; per-frame depth statistics."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxmill.functions import geometry as G
from voxmill.functions.geometry import LENS, POSE, Grid, apply_pose, pose
from voxmill.operators.joins import convex_runs, explode_box, own_axes, reckoned, spread, view_cells
from voxmill.plans.quantiles import lattice_quantiles
from voxmill.schema import IGNORE

CELL = ["ix", "iy", "iz"]


def with_cameras(rows: DataFrame, frames: DataFrame) -> DataFrame:
    """Attach lens and pose by frame. Frames grow with the data, so the join is left to the optimizer."""
    return rows.join(frames.select("frame", *LENS, *POSE), "frame")


def world_points(depth: DataFrame, frames: DataFrame, drop_invalid: bool = True) -> DataFrame:
    """Depth pixels -> world points, keeping the pixel's columns and its range ``z``."""
    d = depth.filter("depth_mm > 0") if drop_invalid else depth
    d = with_cameras(d, frames).withColumn("z", F.col("depth_mm") / 1000.0)
    w = apply_pose(pose(), *G.unproject(F.col("u"), F.col("v"), F.col("z")))
    return d.select("*", *[c.alias(n) for c, n in zip(w, ("wx", "wy", "wz"))])


def point_cells(points: DataFrame, grid: Grid) -> DataFrame:
    """World points -> grid cells, points outside dropped."""
    i = grid.index(F.col("wx"), F.col("wy"), F.col("wz"))
    p = points.select("*", *[c.alias(n) for c, n in zip(i, CELL)])
    return p.filter(grid.inside(*[F.col(c) for c in CELL]))


def voxel_to_pixel(depth: DataFrame, frames: DataFrame, grid: Grid, width: int, drop_invalid: bool = False) -> DataFrame:
    """The last (highest) pixel id that lands in each voxel."""
    cells = point_cells(world_points(depth, frames, drop_invalid), grid)
    return (cells.groupBy("frame", grid.flat(*[F.col(c) for c in CELL]).alias("flat"))
            .agg(F.max(F.col("v") * width + F.col("u")).alias("pixel_id")))


def pixel_to_voxel(mapping: DataFrame) -> DataFrame:
    return mapping.select("frame", "pixel_id", "flat")


def two_camera_map(depth: DataFrame, frames: DataFrame, mapping: DataFrame, offset: tuple, lens: dict,
                   width: int, height: int) -> DataFrame:
    """Colour pixel -> voxel when the colour camera stands ``offset`` away: the nearest
    point wins a colour pixel, the higher pixel id on equal range."""
    d = with_cameras(depth.filter("depth_mm > 0"), frames).withColumn("z", F.col("depth_mm") / 1000.0)
    p = G.unproject(F.col("u"), F.col("v"), F.col("z"))
    x, y, z = (a + o for a, o in zip(p, offset))
    ok = z > 1e-6
    cu = F.rint(F.when(ok, lens["fx"] * x / z + lens["cx"]))
    cv = F.rint(F.when(ok, lens["fy"] * y / z + lens["cy"]))
    pts = (d.select("frame", (F.col("v") * width + F.col("u")).alias("pixel_id"), z.alias("cz"), cu.alias("cu"), cv.alias("cv"))
           .filter(G.in_image(F.col("cu"), F.col("cv"), width, height)))
    return (pts.join(mapping, ["frame", "pixel_id"])
            .groupBy("frame", (F.col("cv") * width + F.col("cu")).cast("int").alias("colour_pixel"))
            .agg(F.min_by("flat", F.struct("cz", -F.col("pixel_id"))).alias("flat")))


def surface_cells(depth: DataFrame, frames: DataFrame, grid: Grid, drop_invalid: bool = True) -> DataFrame:
    """Distinct cells some pixel landed in."""
    return point_cells(world_points(depth, frames, drop_invalid), grid).select("frame", *CELL).distinct()


def sight_test(depth: DataFrame, frames: DataFrame, grid: Grid, width: int, height: int,
               near: float = 0.5, far: float = 8.0) -> DataFrame:
    """Cells whose pixel has a trusted depth, with the sign of measured minus own range.

    Cells come from each frame's view box and are projected before the join, so only
    cells inside the image meet the depth table, on (frame, u, v). A cell without a
    trusted depth is unknown and is left out: its truncated distance is 0."""
    cells = view_cells(frames.select("frame", *LENS, *POSE), grid, 0.0, width, height, 0.0, G.farthest_corner(pose(), grid))
    z = F.col("l2")
    u, v = G.project(F.col("l0"), F.col("l1"), z)
    seen = (cells.select("frame", *CELL, z.alias("zc"), u.alias("u"), v.alias("v"))
            .filter(F.coalesce((F.col("zc") > 1e-6) & G.in_image(F.col("u"), F.col("v"), width, height), F.lit(False)))
            .select("frame", *CELL, "zc", F.col("u").cast("int").alias("u"), F.col("v").cast("int").alias("v")))
    known = depth.filter(F.col("depth_mm").between(near * 1000, far * 1000)).select("frame", "u", "v", "depth_mm").hint("shuffle_hash")
    diff = F.col("depth_mm") / 1000.0 - F.col("zc")
    sign = F.when(F.abs(diff) < 1e-4, 1.0).otherwise(F.signum(diff))
    return seen.join(known, ["frame", "u", "v"]).select("frame", *CELL, sign.alias("sign"))


def _envelope(sources: Column, n: int) -> Column:
    """The lower envelope of parabolas ``d2 + (x - at)^2`` over x = 0 .. n - 1, from ``sources`` (at, d2) sorted by ``at``:
    (at, d2, lo), each lowest from ``lo`` to where the next begins. The earlier one wins a tie."""
    high = lambda p, x: p["d2"] + (x - p["at"]) * (x - p["at"])

    def add(held, q):
        # where the new one lies below at the start of an older one, it does so everywhere behind
        kept = F.filter(held, lambda p: high(p, p["lo"]) <= high(q, p["lo"]))
        top = F.element_at(kept, -1)
        cross = F.floor((q["d2"] + q["at"] * q["at"] - top["d2"] - top["at"] * top["at"]) / (2 * (q["at"] - top["at"]))).cast("int") + 1
        lo = F.when(F.size(kept) == 0, 0).otherwise(cross)
        return F.concat(kept, F.filter(F.array(F.struct(q["at"].alias("at"), q["d2"].alias("d2"), lo.alias("lo"))), lambda p: p["lo"] < n))
    none = F.array().cast("array<struct<at:int,d2:int,lo:int>>")
    return F.aggregate(sources, none, add)


def squared_distance(surface: DataFrame, grid: Grid, cap: int, keys: list[str]) -> DataFrame:
    """Squared distance (in cells) to the nearest surface cell, only where it is below ``cap``.

    Exact and separable: along each axis a line of cells takes the lower envelope of the parabolas that
    the sources on it stand for, so each cell is made once, whatever the cap. The surface is spread by
    ``keys``, whose volume the grid bounds, and nothing moves after that. Everything not listed is at the cap."""
    out = spread(surface.select(*keys, *CELL, F.lit(0).alias("d2")), *keys)
    for axis, n in zip(reversed(CELL), reversed(grid.dims)):
        line = [*keys, *[c for c in CELL if c != axis]]
        held = out.groupBy(*line).agg(F.array_sort(F.collect_set(F.struct(F.col(axis).alias("at"), "d2"))).alias("sources"))
        held = held.select(*line, _envelope(F.col("sources"), n).alias("env"))
        reach = lambda d2: F.ceil(F.sqrt((cap * cap - d2).cast("double"))).cast("int") - 1  # the last step that stays below the cap
        runs = F.transform("env", lambda p, i: F.struct(p["at"].alias("at"), p["d2"].alias("d2"), F.greatest(p["lo"], p["at"] - reach(p["d2"])).alias("lo"),
                                                        F.least(F.coalesce(F.get("env", i + 1)["lo"], F.lit(n)) - 1, p["at"] + reach(p["d2"])).alias("hi")))
        held = held.select(*line, F.inline(F.filter(runs, lambda r: r["lo"] <= r["hi"])))
        step = F.col(axis) - F.col("at")
        out = held.withColumn(axis, F.explode(F.sequence("lo", "hi"))).select(*keys, *CELL, (F.col("d2") + step * step).alias("d2"))
    return out


def truncated_distance(sight: DataFrame, dist: DataFrame, cap: int) -> DataFrame:
    """Known cells' truncated signed distance; unknown cells (not listed) are 0."""
    j = sight.join(dist, ["frame"] + CELL, "left")
    r = F.least(F.sqrt(F.coalesce("d2", F.lit(cap * cap)).cast("double")) / cap, F.lit(1.0))
    return j.select("frame", *CELL, F.when(r < F.abs("sign"), r * F.col("sign")).otherwise(F.col("sign")).alias("tsdf"))


def block_mean(tsdf: DataFrame, r: int = 4) -> DataFrame:
    """Mean over r^3 blocks with the unlisted cells as 0, and the block weight (at least half known)."""
    n = float(r ** 3)
    return (tsdf.groupBy("frame", *[F.floor(F.col(c) / r).cast("int").alias(c) for c in CELL])
            .agg((F.sum("tsdf") / n).alias("tsdf"), F.when(F.count(F.lit(1)) / n >= 0.5, 1).otherwise(0).alias("weight")))


def _block_vote(parts: DataFrame, by: list[str], key: str, total: int, default: int) -> DataFrame:
    """Label of each block from ``parts`` (by.., bin, n): how many of its cells a class has."""
    per = parts.groupBy(*by, *CELL).agg(F.sum("n").alias("listed"), *[F.sum(F.when(F.col("bin") == b, F.col("n")).otherwise(0)).alias(f"b{b}") for b in range(13)])
    fill = 12 if default == IGNORE else default
    n = [(F.col(f"b{b}") + (total - F.col("listed") if b == fill else 0)) for b in range(13)]
    pick = lambda which: F.greatest(*[F.struct(n[b].alias("n"), F.lit(-b).alias("m")) for b in which])["m"] * -1
    void = (n[0] + n[12]) > 0.95 * total
    label = F.when(void, pick(range(13))).otherwise(pick(range(1, 12)))
    return per.select(key, *CELL, F.when(label == 12, IGNORE).otherwise(label).alias("label"))


def downsample_labels(cells: DataFrame, key: str, r: int = 4, default: int = IGNORE) -> DataFrame:
    """Block vote over a sparse label volume: all bins when empty plus ignore exceed 95 %,
    else the object classes only; ties go to the lowest class. Unlisted cells are ``default``."""
    parts = cells.select(key, *[F.floor(F.col(c) / r).cast("int").alias(c) for c in CELL],
                         F.when(F.col("label") == IGNORE, 12).otherwise(F.col("label")).alias("bin"), F.lit(1).alias("n"))
    return _block_vote(parts, [key], key, r ** 3, default)


def downsample_runs(runs: DataFrame, key: str, r: int = 4, default: int = IGNORE) -> DataFrame:
    """``downsample_labels`` of a painted volume kept as runs: each gives the blocks that it crosses a count.

    Blocks of 2, 4 or 8 cells stand within the slabs that the runs were made in, so nothing moves."""
    block = lambda c: F.floor(F.col(c) / r).cast("int")
    by = [key, "slab_"] if 8 % r == 0 else [key]
    parts = runs.select(*by, block("ix").alias("ix"), block("iy").alias("iy"), "k0", "k1", F.when(F.col("label") == IGNORE, 12).otherwise(F.col("label")).alias("bin"),
                        F.explode(F.sequence(block("k0"), block("k1"))).alias("iz"))
    inside = F.least(F.col("k1"), F.col("iz") * r + r - 1) - F.greatest(F.col("k0"), F.col("iz") * r) + 1
    return _block_vote(parts.select(*by, *CELL, "bin", inside.alias("n")), by, key, r ** 3, default)


def label_weight(label: Column, tsdf: Column) -> Column:
    """Scoring mask: annotated (1..253) or clearly behind a surface."""
    return (label.between(1, 253) | (tsdf < -0.5)).cast("int")


def frustum_labels(vox: DataFrame, frames: DataFrame, grid: Grid, width: int, height: int) -> DataFrame:
    """Ground truth with everything outside the camera's view set to ignore."""
    v = with_cameras(vox, frames)
    c = G.undo_pose(pose(), *grid.centre(F.col("gz"), F.col("gx"), F.col("gy")))
    u, w = G.project(*c, whole=False)
    inside = F.coalesce(G.in_image(u, w, width, height), F.lit(False))
    return v.withColumn("in_view", inside).withColumn("label_fov", F.when(F.col("in_view"), F.col("label")).otherwise(IGNORE)).drop(*LENS, *POSE)


# ---- solids --------------------------------------------------------------
# A painted volume is kept as columns: for each (ix, iy) disjoint runs of iz with their class.

EDGE = 1e-9  # cells whose centre lies on a face are inside
FACES_OF_BOX = [(tuple(s if i == j else 0 for j in range(3)), 1) for i in range(3) for s in (1, -1)]

#: shape name -> half spaces ``a . (p / h) <= b`` on a solid's own coordinates ``p`` and half sizes ``h``, and whether
#: it is also cut by the upright ellipse of its first two half sizes. A wedge is the box below its slope.
PAINTERS = {
    "box": (FACES_OF_BOX, False),
    "wedge": ([*FACES_OF_BOX, ((1, 0, 1), 0)], False),
    "cylinder": (FACES_OF_BOX[4:], True),
}


def _with_sides(solids: DataFrame) -> DataFrame:
    """Each solid with the half spaces of its shape in cell indices, ``sides_``, from its local coordinates by cell index.

    Multiplied through by the half sizes, so that a flat solid divides by nothing. All of it depends on the
    solid alone and is reckoned before its columns are made. Solids of an unknown shape go."""
    spark = solids.sparkSession
    kinds = [(shape, [(*map(float, a), float(b)) for a, b in planes], ellipse) for shape, (planes, ellipse) in PAINTERS.items()]
    known = spark.createDataFrame(kinds, "shape string, planes_ array<struct<a0 double, a1 double, a2 double, b double>>, round_ boolean")

    def side(p):
        take = [F.when(p[f"a{i}"] != 0, F.col(f"h{i}_")).otherwise(1.0) for i in range(3)]
        scale = [p[f"a{i}"] * take[(i + 1) % 3] * take[(i + 2) % 3] for i in range(3)]
        part = lambda x: sum((-scale[i] * F.col("own_")[i][x] for i in range(3)), F.lit(0.0))
        return F.struct((p["b"] * take[0] * take[1] * take[2] + EDGE + part(0)).alias("a"), *[part(x + 1).alias(n) for x, n in enumerate("xyz")])

    return (solids.join(F.broadcast(known), "shape")
            .withColumn("sides_", F.transform("planes_", side)).drop("planes_", "own_"))


def _round_runs(runs: DataFrame, keep: list[str], grid: Grid) -> DataFrame:
    """(keep.., k0, k1): runs, those of round solids cut to the ellipse of the first two half sizes, in closed form."""
    a, b = F.col("h1_") * F.col("h1_"), F.col("h0_") * F.col("h0_")
    at, step = own_axes(grid, 0.5, "cz", F.lit(0)), [grid.unit * F.col(f"r2{j}") for j in range(2)]
    runs = reckoned(runs, [*keep, "lo_", "hi_", "round_"], square=step[0] * step[0] * a + step[1] * step[1] * b,
                    mid=at[0] * step[0] * a + at[1] * step[1] * b, rest=at[0] * at[0] * a + at[1] * at[1] * b - b * a)
    upright = F.col("square") < 1e-18
    root = F.when(F.col("round_") & ~upright, F.col("mid") * F.col("mid") - F.col("square") * F.col("rest"))
    runs = reckoned(runs, [*keep, "lo_", "hi_", "square", "mid"], root=F.sqrt(root), out=F.col("round_") & F.when(upright, F.col("rest") > 0).otherwise(root < 0))
    runs = runs.filter("not out")
    end = lambda sign: (sign * F.col("root") - F.col("mid")) / F.col("square")
    cut = F.col("root").isNotNull()
    return runs.select(*keep, F.when(cut, F.greatest(F.col("lo_"), F.ceil(end(-1)).cast("int"))).otherwise(F.col("lo_")).alias("k0"),
                       F.when(cut, F.least(F.col("hi_"), F.floor(end(1)).cast("int"))).otherwise(F.col("hi_")).alias("k1")).filter("k0 <= k1")


def solid_runs(solids: DataFrame, grid: Grid, key: str = "room") -> DataFrame:
    """(key, slab_, ix, iy, seq, cls, k0, k1): the cells of each column that each solid contains, where its slab of the room was sent.

    ``solids(key, seq, cls, shape, cx, cy, cz, sx, sy, sz, r00..r22)``. The solids are shuffled, never columns
    or cells. A solid of an unknown shape contains nothing."""
    half = [F.col(f"s{a}") / 2.0 for a in "xyz"]
    box = []
    for i, a in enumerate("xyz"):
        reach = F.abs(F.col(f"r{i}0")) * half[0] + F.abs(F.col(f"r{i}1")) * half[1] + F.abs(F.col(f"r{i}2")) * half[2]
        idx = lambda w: F.floor((w - grid.origin[i]) / grid.unit).cast("int")
        box.append((F.greatest(F.lit(0), idx(F.col(f"c{a}") - reach)),
                    F.least(F.lit(grid.dims[i] - 1), idx(F.col(f"c{a}") + reach))))
    own = []
    for j in range(3):
        r = [F.col(f"r{i}{j}") for i in range(3)]
        at = sum(((o + 0.5 * grid.unit - F.col(f"c{a}")) * x for o, a, x in zip(grid.origin[1:], "yz", r[1:])),
                 (grid.ox + 0.5 * grid.unit - F.col("cx")) * r[0])
        own.append(F.array(at, *[grid.unit * x for x in r]))
    solids = _with_sides(solids.withColumns({"own_": F.array(*own)} | {f"h{i}_": h for i, h in enumerate(half)}))
    sides = [F.get("sides_", F.lit(m)) for m in range(max(len(planes) for planes, _ in PAINTERS.values()))]
    sides = [tuple(F.coalesce(s[x], F.lit(float(x == "a"))) for x in "axyz") for s in sides]  # what a shape lacks holds everywhere
    runs = convex_runs(solids, box, sides, (key,), grid, 0.5, ("cx", "cy", "cz"), [key, "seq", "cls", "round_", "h0_", "h1_"], slab=8)
    return _round_runs(runs.filter("lo_ <= hi_"), [key, "slab_", "ix", "iy", "seq", "cls"], grid)


def _swept(runs: DataFrame, by: list[str]) -> DataFrame:
    """(by.., k0, k1, top): the runs of each column cut where any begins or ends, with the greatest ``top`` there."""
    held = runs.groupBy(*by).agg(F.collect_list(F.struct("k0", "k1", "top")).alias("runs"))
    cuts = F.array_sort(F.array_distinct(F.flatten(F.transform("runs", lambda r: F.array(r["k0"], r["k1"] + 1)))))
    held = held.withColumn("cuts", cuts)
    over = lambda a: F.array_max(F.transform(F.filter("runs", lambda r: (r["k0"] <= a) & (r["k1"] >= a)), lambda r: r["top"]))
    pieces = F.transform(F.col("cuts"), lambda a, i: F.struct(a.alias("k0"), (F.get("cuts", i + 1) - 1).alias("k1"), over(a).alias("top")))
    return held.select(*by, F.inline(F.filter(pieces, lambda p: p["top"].isNotNull())))


def painted_runs(solids: DataFrame, grid: Grid, key: str = "room", most: int = 512) -> DataFrame:
    """(key, slab_, ix, iy, k0, k1, label): class of all that some solid contains, as runs; the later solid overwrites.

    Overlaps are settled by a sweep along each column where its runs were made, without a shuffle. In rooms
    of more than ``most`` solids every ``most`` of their order are swept first, which leaves no more runs than a column has cells."""
    # one whole number orders by seq and carries the class, the cheapest thing to aggregate
    top = (F.col("seq").cast("long") * 256 + F.col("cls")).alias("top")
    runs = solid_runs(solids, grid, key).select(key, "slab_", "ix", "iy", "seq", "k0", "k1", top)
    column = [key, "slab_", "ix", "iy"]
    if not solids.groupBy(key).count().filter(F.col("count") > most).isEmpty():
        runs = _swept(runs.withColumn("part_", F.floor(F.col("seq") / most)), [*column, "part_"])
    return _swept(runs, column).select(*column, "k0", "k1", F.pmod("top", F.lit(256)).cast("int").alias("label"))


def cells_of(runs: DataFrame, key: str = "room") -> DataFrame:
    """The cells of a painted volume, one row each."""
    return runs.select(key, "ix", "iy", F.explode(F.sequence("k0", "k1")).alias("iz"), "label")


def paint_solids(solids: DataFrame, grid: Grid, key: str = "room") -> DataFrame:
    """Class of every cell some solid contains; the later solid overwrites."""
    return cells_of(painted_runs(solids, grid, key), key)


def yaw_rotation(c: Column, s: Column) -> list[Column]:
    """Rotation about the vertical as the nine columns r00..r22."""
    z, o = F.lit(0.0), F.lit(1.0)
    return [x.alias(n) for x, n in zip([c, -s, z, s, c, z, z, z, o], G.ROT)]


def room_shell(rooms: DataFrame, grid: Grid) -> DataFrame:
    """Interior, floor, ceiling and four walls of each room as pseudo-solids painted before
    any annotation (negative ``seq``). Without a ceiling the interior runs to the grid top."""
    top = grid.oz + grid.nz * grid.unit
    bottom = F.col("cz") - F.col("sz") / 2.0
    sz = F.when(F.col("ceiling"), F.col("sz")).otherwise(top - bottom)
    cz = F.when(F.col("ceiling"), F.col("cz")).otherwise(bottom + sz / 2.0)
    r = rooms.withColumns({"sz": sz, "cz": cz})
    th = F.col("thickness")

    def slab(seq, cls, axis=None, sign=0):
        size = {a: F.col(f"s{a}") for a in "xyz"}
        shift = F.lit(0.0)
        if axis is not None:
            shift = sign * size["xyz"[axis]] / 2.0
            size["xyz"[axis]] = th
        centre = {a: F.col(f"c{a}") + (F.col(f"r{i}{axis}") * shift if axis is not None else 0.0) for i, a in enumerate("xyz")}
        return F.struct(F.lit(seq).alias("seq"), F.lit(cls).alias("cls"), F.lit("box").alias("shape"),
                        *[centre[a].alias(f"c{a}") for a in "xyz"], *[size[a].alias(f"s{a}") for a in "xyz"])

    faces = [slab(-7, 0), slab(-6, 2, 2, -1), F.when(F.col("ceiling"), slab(-5, 1, 2, +1)), slab(-4, 3, 0, -1),
             slab(-3, 3, 0, +1), slab(-2, 3, 1, -1), slab(-1, 3, 1, +1)]
    return (r.select("room", *G.ROT, F.explode(F.array(*faces)).alias("f_")).filter("f_ IS NOT NULL")
            .select("room", "f_.*", *G.ROT))


def label_runs(rooms: DataFrame, solids: DataFrame, grid: Grid) -> DataFrame:
    """Room shell, then solids in order, as runs of columns. Cells not listed are unannotated."""
    return painted_runs(room_shell(rooms, grid).unionByName(solids), grid)


def label_volume(rooms: DataFrame, solids: DataFrame, grid: Grid) -> DataFrame:
    """Room shell, then solids in order. Cells not listed are unannotated."""
    return cells_of(label_runs(rooms, solids, grid))


def move_solids(solids: DataFrame, moves: DataFrame, key: str = "room") -> DataFrame:
    """Solids carried into another world: centre and rotation under each key's pose."""
    j = solids.join(moves.select(key, *[F.col(c).alias("m_" + c) for c in POSE]), key)
    m = pose("m_")
    centre = apply_pose(m, *[F.col(f"c{a}") for a in "xyz"])
    rot = {f"r{i}{k}": m[f"r{i}0"] * F.col(f"r0{k}") + m[f"r{i}1"] * F.col(f"r1{k}") + m[f"r{i}2"] * F.col(f"r2{k}")
           for i in range(3) for k in range(3)}
    keep = [c for c in solids.columns if c not in G.ROT + ["cx", "cy", "cz"]]
    return j.select(*keep, *[c.alias(f"c{a}") for c, a in zip(centre, "xyz")], *[rot[n].alias(n) for n in G.ROT])


# ---- points --------------------------------------------------------------

def voxelise_points(points: DataFrame, grid: Grid, keys: list[str], values: list[str]) -> DataFrame:
    """Covered cells with the mean of each value; points outside are dropped."""
    i = grid.index(F.col("x"), F.col("y"), F.col("z"))
    p = points.select(*keys, *values, *[c.alias(n) for c, n in zip(i, CELL)]).filter(grid.inside(*[F.col(c) for c in CELL]))
    return p.groupBy(*keys, *CELL).agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(v) for v in values])


def voxel_downsample(points: DataFrame, size: float, keys: list[str]) -> DataFrame:
    """Centroid of the points of each cell."""
    return (points.groupBy(*keys, *[F.floor(F.col(a) / size).alias(f"c{a}") for a in "xyz"])
            .agg(F.count(F.lit(1)).alias("n"), *[F.avg(a).alias(a) for a in "xyz"]))


def points_in_cubes(points: DataFrame, voxels: DataFrame, radii: list[float], keys: list[str]) -> DataFrame:
    """Colour sum and point count within each Chebyshev radius of a voxel centre.

    ``points`` hold fractional indices. A point reaches only the lattice sites
    ceil(p-r)..floor(p+r) on each axis, so it makes a bounded number of rows, summed
    per site before the join with the voxels."""
    p = points.select(*keys, "x", "y", "z", "r", "g", "b", F.explode(F.array(*[F.lit(float(r)) for r in radii])).alias("radius"))
    box = [(F.ceil(F.col(a) - F.col("radius")).cast("int"), F.floor(F.col(a) + F.col("radius")).cast("int")) for a in "xyz"]
    sums = (explode_box(p, box).groupBy(*keys, "radius", *CELL)
            .agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in "rgb"]))
    return voxels.select(*keys, *CELL).join(sums, keys + CELL)


def cell_state(depth: DataFrame, frames: DataFrame, claims: DataFrame, grid: Grid) -> DataFrame:
    """Per cell the mean measured range and the claimed class, NULL where either is missing."""
    m = (point_cells(world_points(depth, frames), grid).groupBy("frame", *CELL)
         .agg(F.avg("z").alias("measured")))
    return m.join(claims.select("frame", *CELL, F.col("cls").alias("predicted")), ["frame"] + CELL, "full_outer")


def surface_coverage(surface: DataFrame, claims: DataFrame) -> DataFrame:
    """How many measured cells the prediction fills, and with what."""
    j = surface.join(claims, ["frame"] + CELL, "left")
    return j.groupBy("frame", "cls").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "share", 100.0 * F.col("n") / F.sum("n").over(W.partitionBy("frame")))  # <= 13 rows a frame


def axis_control(surface: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Share of observed surface the annotation calls solid, with right and with swapped axes.

    Only annotated cells count. The surface is read once and sent to both keys."""
    occ = labels.select(*keys, *CELL, (F.col("label") > 0).alias("solid")).filter(F.col("label") != IGNORE)
    both = surface.select(*keys, F.inline(F.array(
        F.struct(F.lit("right").alias("axes"), *[F.col(c) for c in CELL]),
        F.struct(F.lit("swapped").alias("axes"), F.col("iy").alias("ix"), F.col("ix").alias("iy"), F.col("iz").alias("iz")))))
    return (both.join(occ, keys + CELL).groupBy("axes")
            .agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("solid").cast("double")).alias("hit_rate")))


# ---- per-frame depth statistics -------------------------------------------

def hidden_extent(px, py, pz, ox, oy, oz, lo: list[Column], hi: list[Column]) -> Column:
    """Metres from a surface point to where its ray leaves the box; NULL when it never does."""
    d = [p - o for p, o in zip((px, py, pz), (ox, oy, oz))]
    n = F.greatest(G.norm3(*d), F.lit(1e-9))
    outs = []
    for k, o in enumerate((ox, oy, oz)):
        dk = d[k] / n
        outs.append(F.when(dk != 0, F.greatest((lo[k] - o) / dk, (hi[k] - o) / dk)))
    return F.greatest(F.least(*outs) - G.norm3(*d), F.lit(0.0))


def viewpoint_statistics(depth: DataFrame, frames: DataFrame, rooms: DataFrame | None, pixels: int) -> DataFrame:
    """What each frame saw and what it leaves hidden: median depth, shares near / on the floor /
    valid, mean hidden extent behind the surface, camera height, tilt.

    ``rooms(scene, cx, cy, cz, sx, sy, sz, r00..r22)`` is one box per scene."""
    p = world_points(depth, frames)
    hidden = F.lit(None).cast("double")
    if rooms is not None:
        scene = frames.select("frame", "scene").join(rooms.select("scene", *[F.col(c).alias("m_" + c) for c in (
            "cx", "cy", "cz", "sx", "sy", "sz", *G.ROT)]), "scene")
        p = p.join(scene.drop("scene"), "frame", "left")
        to_room = lambda x, y, z, shift: [sum(((F.col(f"m_r{i}{j}") * (q - F.col(f"m_c{a}") if shift else q))
                                                for i, (q, a) in enumerate(zip((x, y, z), "xyz"))), F.lit(0.0)) for j in range(3)]
        half = [F.col(f"m_s{a}") / 2.0 for a in "xyz"]
        hidden = hidden_extent(*to_room(F.col("wx"), F.col("wy"), F.col("wz"), True),
                               *to_room(F.col("tx"), F.col("ty"), F.col("tz"), True), [-h for h in half], half)
    stats = p.groupBy("frame").agg(
        F.count(F.lit(1)).alias("valid"), (100.0 * F.avg((F.col("z") < 1.5).cast("int"))).alias("near_pct"),
        (100.0 * F.avg((F.col("wz") < 0.12).cast("int"))).alias("floor_pct"), F.avg(hidden).alias("free_mean"))
    med = lattice_quantiles(depth.filter("depth_mm > 0"), ["frame"], "depth_mm", {"depth_med": 0.5})
    cam = frames.select("frame", F.col("tz").alias("cam_z"), G.tilt_deg(pose()).alias("tilt_deg"))
    return (cam.join(stats, "frame").join(med, "frame")
            .select("frame", "cam_z", "tilt_deg", (100.0 * F.col("valid") / pixels).alias("valid_pct"), "floor_pct",
                    (F.col("depth_med") / 1000.0).alias("depth_med"), "near_pct", "free_mean"))


def frame_quality(depth: DataFrame, width: int, height: int, depth_max_mm: int = 10000, near_mm: int = 600) -> DataFrame:
    """Valid share, range, median, too-near share, lower-third holes, and the first alarm that applies."""
    ok = (F.col("depth_mm") > 0) & (F.col("depth_mm") <= depth_max_mm)
    low = F.col("v") >= 2 * height // 3
    low_px = width * (height - 2 * height // 3)
    s = depth.groupBy("frame").agg(
        F.count_if(ok).alias("n"), F.min(F.when(ok, F.col("depth_mm"))).alias("lo"), F.max(F.when(ok, F.col("depth_mm"))).alias("hi"),
        F.count_if(ok & (F.col("depth_mm") < near_mm)).alias("near_n"), F.count_if(ok & low).alias("low_n"))
    med = lattice_quantiles(depth.filter(ok), ["frame"], "depth_mm", {"med": 0.5})
    pct = 100.0 * F.col("n") / (width * height)
    near = F.when(F.col("n") > 0, 100.0 * F.col("near_n") / F.col("n")).otherwise(0.0)
    holes = 100.0 * (low_px - F.col("low_n")) / low_px
    q = (s.join(med, "frame", "left").select(
        "frame", "n", pct.alias("pct"), F.coalesce(F.col("lo") / 1000.0, F.lit(0.0)).alias("lo"),
        F.coalesce(F.col("hi") / 1000.0, F.lit(0.0)).alias("hi"), F.coalesce(F.col("med") / 1000.0, F.lit(0.0)).alias("med"),
        near.alias("near"), holes.alias("bottom_holes")))
    alarm = (F.when(F.col("pct") < 20.0, "sparse").when(F.col("near") > 2.0, "too_near")
             .when(F.col("bottom_holes") > 20.0, "holes").when((F.col("med") > 0) & (F.col("med") < 1.0), "close_scene"))
    return q.withColumn("alarm", alarm).withColumn("is_error", F.coalesce(F.col("alarm") != "close_scene", F.lit(False)))


def depth_curve(depth: DataFrame, keys: list[str]) -> DataFrame:
    """Cumulative share of valid pixels up to each depth. A key has at most 65,535 levels,
    counted before the window."""
    c = depth.filter("depth_mm > 0").groupBy(*keys, "depth_mm").agg(F.count(F.lit(1)).alias("n"))
    part = W.partitionBy(*keys)
    upto = part.orderBy("depth_mm").rowsBetween(W.unboundedPreceding, W.currentRow)
    return c.select(*keys, "depth_mm", "n", F.sum("n").over(upto).alias("cum"), F.sum("n").over(part).alias("total"))


def depth_at(curve: DataFrame, keys: list[str], fractions: list[float]) -> DataFrame:
    """Metres at a fraction along the curve: the first depth whose count exceeds it, the far
    surface at the end."""
    f = curve.select(*keys, "depth_mm", "cum", "total", F.explode(F.array(*[F.lit(float(x)) for x in fractions])).alias("f"))
    return f.groupBy(*keys, "f").agg((F.coalesce(
        F.min(F.when(F.col("cum") > F.col("f") * F.col("total"), F.col("depth_mm"))), F.max("depth_mm")) / 1000.0).alias("metres"))
