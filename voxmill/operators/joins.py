"""Join shapes Spark has no single operator for."""

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from voxmill.functions.geometry import Grid, pose, span, view_box
from voxmill.plans import tiles
from voxmill.plans.blocks import growing
from voxmill.session import stored

#: References of a key that are one tile; queries of a tile that are one task's.
TILE, CROWD = 16384, 50_000


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Hash the rows over enough tasks before each becomes many (an explicit count is kept by AQE)."""
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *cols)


def explode_box(df: DataFrame, box: list[tuple[Column, Column]], names=("ix", "iy", "iz"),
                by: tuple[str, ...] = ()) -> DataFrame:
    """One row per integer cell of a per-row box. Bounds are columns first, so every
    row makes only its own clipped cells: never a cross join. With ``by`` the rows are
    spread over tasks once their bounds are known, before they become many."""
    keep = df.columns
    out = df.select("*", *[c.alias(f"{e}{i}_") for i, pair in enumerate(box) for e, c in zip("ab", pair)])
    if by:
        out = spread(out, *by)
    for i, n in enumerate(names):
        left = [f"{e}{j}_" for j in range(i + 1, len(names)) for e in "ab"]
        out = out.select(*keep, *names[:i], *left, F.explode(span(F.col(f"a{i}_"), F.col(f"b{i}_"))).alias(n))
    return out


def reckoned(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """``keep`` and ``columns``, each reckoned once per row. In a plain select the optimizer may write a
    column out again wherever a later filter or column uses it, until the JVM leaves the code to the interpreter."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


Plane = tuple[Column, Column, Column, Column]


def convex_runs(df: DataFrame, box: list[tuple[Column, Column]], planes: list[Plane], by: tuple[str, ...],
                grid: Grid, offset: float, pivot: tuple[str, str, str], keep: list[str],
                slab: int | None = None, wider: int = 0) -> DataFrame:
    """For each column (ix, iy) of a per-row box the run of iz inside a convex body:
    (keep.., ix, iy, lo_, hi_), and what gives a cell's place in the row's own axes (see ``own_axes``).

    The body is an intersection of half spaces ``a + bx*i + by*j + bz*k >= 0`` in cell
    indices, so each gives the run an end in closed form and no cell is made. ``wider`` adds so
    many cells at both ends, for callers that test each cell themselves. A run may be empty.

    Local coordinates are (point - pivot) turned by ``r00..r22``, ``offset`` being where in a
    cell it is sampled. The part that depends on i and j is summed once per column, which
    keeps the code per row short enough for the JVM to compile.

    With ``slab`` a row is first cut into slabs of that many cells along the first axis and
    the rows are spread by (by.., slab): rows move, columns do not, a crowded key splits into
    its slabs, and a later aggregate on (by.., slab_, column) needs no shuffle."""
    n = range(len(planes))
    named = df.select("*", *[c.alias(f"{e}{i}_") for i, pair in enumerate(box) for e, c in zip("ab", pair)],
                      *[c.alias(f"p{m}{x}_") for m, pl in enumerate(planes) for x, c in zip("axyz", pl)])
    if slab:
        named = named.select("*", F.explode(span(F.floor(F.col("a0_") / slab).cast("int"), F.floor(F.col("b0_") / slab).cast("int"))).alias("slab_"))
        named = named.withColumns({"a0_": F.greatest("a0_", F.col("slab_") * slab), "b0_": F.least("b0_", F.col("slab_") * slab + slab - 1)})
        keep, by = [*keep, "slab_"], (*by, "slab_")
    named = spread(named, *by)
    at = lambda axis, cell: grid.origin[axis] + (F.col(cell) + offset) * grid.unit - F.col(pivot[axis])
    out = named.select("*", F.explode(span(F.col("a0_"), F.col("b0_"))).alias("ix"))
    late = [*keep, "ix", pivot[2], "r20", "r21", "r22", "a2_", "b2_", *[f"p{m}z_" for m in n]]
    late = list(dict.fromkeys(late))
    out = out.select(*late, pivot[1], "r10", "r11", "r12", "a1_", "b1_", *[f"p{m}y_" for m in n],
                     *[(at(0, "ix") * F.col(f"r0{j}")).alias(f"t{j}_") for j in range(3)],
                     *[(F.col(f"p{m}a_") + F.col(f"p{m}x_") * F.col("ix")).alias(f"s{m}_") for m in n])
    out = out.select("*", F.explode(span(F.col("a1_"), F.col("b1_"))).alias("iy"))
    out = out.select(*late, "iy", *[(F.col(f"t{j}_") + at(1, "iy") * F.col(f"r1{j}")).alias(f"t{j}_") for j in range(3)],
                     *[(F.col(f"s{m}_") + F.col(f"p{m}y_") * F.col("iy")).alias(f"s{m}_") for m in n])
    lo, hi = [F.col("a2_").cast("double")], [F.col("b2_").cast("double")]
    for m in n:
        s, slope = F.col(f"s{m}_"), F.col(f"p{m}z_")
        if wider:
            lo.append(F.when(slope > 1e-9, F.floor(-s / slope) - wider))
            hi.append(F.when(slope < -1e-9, F.ceil(-s / slope) + wider).when((slope <= 1e-9) & (s < -1e-6), -1.0))
        else:
            lo.append(F.when(slope > 1e-12, -s / slope))
            hi.append(F.when(slope < -1e-12, -s / slope).when((slope <= 1e-12) & (s < 0), -1.0))
    ends = (F.greatest(*lo), F.least(*hi)) if wider else (F.ceil(F.least(F.greatest(*lo), F.col("b2_") + 1.0)), F.floor(F.greatest(F.least(*hi), F.lit(-1.0))))
    tail = list(dict.fromkeys([*keep, "ix", "iy", pivot[2], "r20", "r21", "r22"]))
    ends = {x: e.cast("int") for e, x in zip(ends, ("lo_", "hi_"))}
    tail += [f"t{j}_" for j in range(3)]
    return out.select(*tail, *[e.alias(x) for x, e in ends.items()]) if wider else reckoned(out, tail, **ends)


def own_axes(grid: Grid, offset: float, pivot: str, iz) -> list[Column]:
    """A cell's place in the axes of the row whose column it stands in, from what ``convex_runs`` gives."""
    z = grid.origin[2] + (iz + offset) * grid.unit - F.col(pivot)
    return [F.col(f"t{j}_") + z * F.col(f"r2{j}") for j in range(3)]


def explode_convex(df: DataFrame, box: list[tuple[Column, Column]], planes: list[Plane], by: tuple[str, ...],
                   grid: Grid, offset: float, pivot: tuple[str, str, str], keep: list[str],
                   slab: int | None = None) -> DataFrame:
    """Cells of a per-row box that may lie inside a convex body, with their coordinates in the
    row's own axes: (keep.., ix, iy, iz, l0, l1, l2).

    Runs of ``convex_runs``, a cell wider, so a thin slanted slab or a view cone does not make
    its whole bounding box. The caller's own exact test follows."""
    keep = [*keep, "slab_"] if slab else keep
    out = convex_runs(df, box, planes, by, grid, offset, pivot, [c for c in keep if c != "slab_"], slab, 1)
    out = out.select("*", F.explode(span(F.col("lo_"), F.col("hi_"))).alias("iz"))
    return out.select(*keep, "ix", "iy", "iz", *[c.alias(f"l{j}") for j, c in enumerate(own_axes(grid, offset, pivot[2], F.col("iz")))])


def view_planes(p: dict[str, Column], grid: Grid, offset: float, width: int, height: int, near, far) -> list[Plane]:
    """The sides of a camera's view as half spaces in cell indices; ``offset`` is where in a cell it is sampled."""
    base = [o + offset * grid.unit - p[t] for o, t in zip(grid.origin, ("tx", "ty", "tz"))]
    cam = []
    for k in range(3):
        r = [p[f"r{d}{k}"] for d in range(3)]
        cam.append((base[0] * r[0] + base[1] * r[1] + base[2] * r[2], *[grid.unit * x for x in r]))
    mix = lambda u, a, v, b, c=0.0: tuple(u * x + v * y + (c if i == 0 else 0.0) for i, (x, y) in enumerate(zip(cam[a], cam[b])))
    one = lambda s, c: tuple(s * x + (c if i == 0 else 0.0) for i, x in enumerate(cam[2]))
    fx, fy, cx, cy = (F.col(c) for c in ("fx", "fy", "cx", "cy"))
    return [one(1.0, -near), one(-1.0, far), mix(fx, 0, cx + 0.5, 2), mix(-fx, 0, width - 0.5 - cx, 2),
            mix(fy, 1, cy + 0.5, 2), mix(-fy, 1, height - 0.5 - cy, 2)]


def view_cells(frames: DataFrame, grid: Grid, offset: float, width: int, height: int, near, far) -> DataFrame:
    """frames x the cells in their view (index range join), at most a cell more on each side, with
    the cell in camera coordinates as l0, l1, l2."""
    return explode_convex(frames, view_box(pose(), grid, width, height, far),
                          view_planes(pose(), grid, offset, width, height, near, far), ("frame",),
                          grid, offset, ("tx", "ty", "tz"), ["frame", "fx", "fy", "cx", "cy"])


def asof_next(samples: DataFrame, frames: DataFrame, key: str, tol: float, payload: list[str],
              time: str = "t") -> DataFrame:
    """Each sample takes the first frame at or after it, or the last frame of its key when
    none follows, kept within ``tol``.

    Time is cut into blocks of 64 tolerances. A frame is copied into the block before
    its own when it lies within ``tol`` of the edge, so a block is windowed alone: no
    task sees a whole capture."""
    width = 64 * tol
    blk = lambda x: F.floor(x / width)
    ft = F.col(time)
    home = F.struct(blk(ft).alias("b_"))
    early = F.when(blk(ft - tol) < blk(ft), F.struct((blk(ft) - 1).alias("b_")))
    f = frames.select(key, time, *payload).select("*", F.inline(F.filter(F.array(home, early), lambda s: s.isNotNull())))
    hold = F.struct(F.col(time).alias("t"), *payload)
    f = f.select(key, "b_", F.col(time).alias("at_"), F.lit(0).alias("is_sample_"), hold.alias("hit_"),
                 *[F.lit(None).cast(samples.schema[c].dataType).alias(c) for c in samples.columns if c != key])
    s = samples.select(key, blk(ft).alias("b_"), ft.alias("at_"), F.lit(1).alias("is_sample_"),
                       F.lit(None).cast(f.schema["hit_"].dataType).alias("hit_"), *[c for c in samples.columns if c != key])
    # frames at the same instant sort after the sample, so they count as "at or after"
    after = (W.partitionBy(key, "b_").orderBy(F.asc("at_"), F.desc("is_sample_"))
             .rowsBetween(W.currentRow, W.unboundedFollowing))
    nxt = (s.unionByName(f).withColumn("next_", F.first("hit_", ignorenulls=True).over(after))
           .filter("is_sample_ = 1"))
    last = frames.groupBy(key).agg(F.max_by(hold, F.struct(time, *payload)).alias("last_"))
    hit = F.when(F.col("next_").isNotNull(), F.col("next_")).when(F.col(f"last_.t") < ft, F.col("last_"))
    out = nxt.join(last, key, "left").withColumn("m_", hit)
    return (out.filter(F.abs(F.col("m_.t") - ft) <= tol)
            .select(*samples.columns, F.col("m_.t").alias("frame_t"), *[F.col(f"m_.{p}") for p in payload]))


# ---- nearest --------------------------------------------------------------------

def _key_boxes(pts: DataFrame, keys: list[str], most: int) -> dict[tuple, tuple]:
    """The keys of more than ``most`` points (so few of them) and the corners of the box around each."""
    rows = pts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[f(a).alias(f"{e}{a}") for e, f in (("lo", F.min), ("hi", F.max)) for a in "xyz"]).filter(F.col("n") > most)
    return {tuple(r[k] for k in keys): ([r[f"lo{a}"] for a in "xyz"], [r[f"hi{a}"] for a in "xyz"]) for r in rows.collect()}


def _tiled(pts: DataFrame, keys: list[str], boxes: dict[tuple, tuple], most: int) -> tuple[DataFrame, tiles.Index]:
    """Points of the keys of ``boxes`` with ``tile``, in runs of ``most`` along their key's Morton curve, and where the tiles are."""
    spark = pts.sparkSession
    held = spark.sparkContext.broadcast(boxes)

    def placed(batches):
        for batch in batches:
            batch, begin, end = tiles.by_key(batch, keys)
            hi, lo, mine = (np.zeros(batch.num_rows, t) for t in (np.int64, np.int64, bool))
            points = tiles.xyz(batch)
            for a, b in zip(begin, end):
                if (box := held.value.get(tiles.key_of(batch, keys, a))) is not None:
                    mine[a:b] = True
                    hi[a:b], lo[a:b] = tiles.curve(points[a:b], *map(np.array, box))
            yield batch.append_column("hi", pa.array(hi)).append_column("lo", pa.array(lo)).filter(pa.array(mine))

    ddl = lambda df: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    along = stored(pts.mapInArrow(placed, f"{ddl(pts)}, hi long, lo long"))
    along = along.repartitionByRange(n, *keys, "hi", "lo").sortWithinPartitions(*keys, "hi", "lo")
    out = stored(along.mapInArrow(lambda batches: tiles.numbered(batches, keys, most, TaskContext.get().partitionId()), f"{ddl(along)}, tile long"))
    rows = out.groupBy(*keys, "tile").agg(F.min(F.struct("hi", "lo")).alias("begin"), *[f(a).alias(f"{e}{a}") for e, f in (("l", F.min), ("h", F.max)) for a in "xyz"]).collect()
    index = tiles.Index([(tuple(r[k] for k in keys), r.tile, r.begin.hi, r.begin.lo, [r[f"l{a}"] for a in "xyz"], [r[f"h{a}"] for a in "xyz"]) for r in rows], boxes)
    return out.drop("hi", "lo"), index


def _ask_tiles(asked: DataFrame, refs: DataFrame, keys: list[str], limit: float | None, index=None) -> DataFrame:
    """What ``tiles.answers`` gives of ``asked(id, keys.., x, y, z, d2, tile)`` among ``refs(ref_id, keys.., x, y, z, tile)``.

    A tile that many ask goes to several tasks; tiles nobody asks go no further."""
    spark, at = asked.sparkSession, [*keys, "tile"]
    counts = stored(asked.groupBy(*at).agg(F.count(F.lit(1)).alias("n")))
    crowd = max(CROWD, (counts.agg(F.sum("n")).first()[0] or 0) // 2000)
    salts = F.ceil(F.col("n") / crowd).cast("int")
    crowded = counts.filter(F.col("n") > crowd).select(*at, salts.alias("salts"))  # 2,000 rows at most
    if crowded.isEmpty():
        asked = asked.withColumn("salt", F.lit(0))
    else:
        asked = asked.join(F.broadcast(crowded), at, "left").withColumn("salt", F.pmod(F.xxhash64("id", "x", "y", "z"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    refs = refs.join(growing(counts), at).select(*at, "ref_id", "x", "y", "z", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    group = [*at, "salt"]
    null = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    rows = refs.select(*group, F.lit(0).alias("asks"), null(asked, "id"), "ref_id", "x", "y", "z", F.lit(None).cast("double").alias("d2"))
    rows = rows.unionByName(asked.select(*group, F.lit(1).alias("asks"), "id", null(refs, "ref_id"), "x", "y", "z", "d2"))
    rows = spread(rows.withColumn("part_", F.xxhash64(*group)), "part_").sortWithinPartitions(*group, "asks", "ref_id").drop("part_")
    fields = [*asked.select(*at, "id", "x", "y", "z", "d2").schema, refs.schema["ref_id"]]
    out = StructType([StructField(f.name, f.dataType) for f in fields])
    arrow, held = to_arrow_schema(out), None if index is None else spark.sparkContext.broadcast(index)
    limit2 = float("inf") if limit is None else limit * limit
    return rows.mapInArrow(lambda batches: tiles.answers(batches, keys, limit2, held and held.value, arrow), out)


def nearest(queries: DataFrame, refs: DataFrame, limit: float | None, levels: int | None = None,
            keys: list[str] | None = None) -> DataFrame:
    """Nearest reference of every query within ``limit`` (None for any): (id, ref_id, d2), lowest ref_id on ties.

    ``queries(id, keys.., x, y, z)``, ``refs(ref_id, keys.., x, y, z)``; only rows with
    equal keys meet. Equal references are merged first. The references of a key are a tile; those of a key
    with more than ``TILE`` are cut into tiles along a Morton curve, whose boxes (4,096 and a few, however many
    references) go to all tasks. A query asks the tile it falls in, then all tiles whose box
    is not farther than what it found there, so it is shuffled once and once more for each of those.
    A task holds one tile, and a tile that many ask is copied to several tasks: hot spots on either side never
    meet pair by pair, as a tile compares only blocks of 64 that may hold an answer. ``levels`` has no use any more.
    Rows without a key, or with a coordinate that is null or not finite, are near nothing.
    """
    keys = list(keys or [])
    known = [F.col(k).isNotNull() for k in keys]
    fit = lambda df: df.filter(reduce(lambda a, b: a & b, known + [F.abs(F.col(a)) < float("inf") for a in "xyz"]))
    doubles, whole = [F.col(a).cast("double").alias(a) for a in "xyz"], F.lit(-1).cast("long")
    pts = stored(fit(refs.select("ref_id", *keys, *doubles)).groupBy(*keys, "x", "y", "z").agg(F.min("ref_id").alias("ref_id"), F.min(whole).alias("tile")))
    most = max(TILE, -(-pts.count() // 4096))
    asked = fit(queries.select("id", *keys, *doubles)).withColumn("d2", F.lit(None).cast("double"))
    boxes = _key_boxes(pts, keys, most)
    least = lambda rows: rows.groupBy("id").agg(F.min(F.struct("d2", "ref_id")).alias("m_")).select("id", "m_.ref_id", "m_.d2")
    if not boxes:
        return least(_ask_tiles(asked.withColumn("tile", whole), pts, keys, limit))
    cut_up, index = _tiled(pts.drop("tile"), keys, boxes, most)
    held, big = asked.sparkSession.sparkContext.broadcast(index), cut_up.select(*keys).distinct()
    if keys:
        cut_up = cut_up.unionByName(pts.join(F.broadcast(big), keys, "left_anti"))
    schema = asked.withColumn("tile", whole).schema
    asked = stored(asked.mapInArrow(lambda batches: tiles.homes(batches, keys, held.value), schema))
    first = stored(_ask_tiles(asked, cut_up, keys, limit, index))
    more = _ask_tiles(first.filter("tile IS NOT NULL").drop("ref_id"), cut_up, keys, limit)
    found = ["id", "d2", "ref_id"]
    return least(first.filter("tile IS NULL").select(*found).unionByName(more.select(*found)))


def nearest_any(queries: DataFrame, refs: DataFrame, start: float, growth: float = 8.0,
                levels: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """Nearest reference with no limit, for every query whose key has a reference: ``nearest`` without one.

    Tiles are found by their boxes and not in rounds of growing limits, so ``start`` and ``growth`` have no use any more."""
    return nearest(queries, refs, None, levels, keys)


def pair_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer pairing of two key sets with each leftover marked."""
    l, r = left.select(key).distinct().withColumn("l_", F.lit(True)), right.select(key).distinct().withColumn("r_", F.lit(True))
    side = F.when(F.col("l_").isNull(), "right_only").when(F.col("r_").isNull(), "left_only").otherwise("paired")
    return l.join(r, key, "full_outer").select(key, side.alias("side"))


def not_done(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not in the output yet (resumable append)."""
    return todo.join(done.select(*keys), keys, "left_anti")
