"""Surfaces of voxel sets and meshes as tables of vertices, faces and edges."""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.operators.joins import nearest, nearest_any, spread
from voxmill.plans import bricks

CELL = ["ix", "iy", "iz"]
# Face directions and the shade each is drawn with.
FACES = [((1, 0, 0), 0.86), ((-1, 0, 0), 0.66), ((0, 1, 0), 1.00), ((0, -1, 0), 0.44), ((0, 0, 1), 0.92), ((0, 0, -1), 0.58)]


def exposed_faces(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Faces of a voxel set that do not lie between two occupied voxels.

    The set is bricks; a face is a bit whose neighbour along the axis is not set, and only those become rows."""
    around = bricks.neighbours(bricks.bricks(cells, keys), keys).filter("bits <> 0")
    sides = []
    for d, shade in FACES:
        axis = [abs(x) for x in d].index(1)
        beside = F.col(f"{'up' if sum(d) > 0 else 'down'}{axis}")
        sides.append(F.struct(F.col("bits").bitwiseAND(F.bitwise_not(beside)).alias("open"), F.lit(axis).alias("axis"), F.lit(sum(d)).alias("dir"), F.lit(shade).alias("shade")))
    faces = around.select(*keys, *bricks.BRICK, F.inline(F.array(*sides))).filter("open <> 0")
    return bricks.cells(faces, "open", [*keys, "axis", "dir", "shade"]).select(*keys, *CELL, "axis", "dir", "shade")


def _corner_masks(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., cix, ciy, ciz, mask): which corners of each lattice cell are occupied, of those with any and not all.

    Worked out brick by brick, so that rows and memory follow the bricks; only cells on the surface become rows."""
    corner = [F.col(f"c{b}") for b in range(8)]
    some, every = reduce(lambda a, b: a.bitwiseOR(b), corner), reduce(lambda a, b: a.bitwiseAND(b), corner)
    around = bricks.octants(bricks.bricks(cells, keys), keys)
    held = around.withColumn("open", some.bitwiseAND(F.bitwise_not(every))).filter("open <> 0")
    on = bricks.cells(held, "open", [*keys, *bricks.BRICK, *[f"c{b}" for b in range(8)]], "place_")
    mask = sum((F.getbit(f"c{b}", F.col("place_")).cast("int") * (1 << b) for b in range(1, 8)), F.getbit("c0", F.col("place_")).cast("int"))
    return on.select(*keys, *[F.col(n).cast(cells.schema[n].dataType).alias("c" + n) for n in CELL], mask.alias("mask"))


def _unplaced_masks(cells: DataFrame, keys: list[str]) -> DataFrame:
    """``_corner_masks`` of voxels that lack a coordinate, which stand in no brick: theirs is missing in the cell, too."""
    spots = [F.struct(*[(F.col(n) - o).alias("c" + n) for n, o in zip(CELL, c)], F.lit(1 << b).alias("bit")) for b, c in enumerate(bricks.CORNERS)]
    return (cells.select(*keys, *CELL).distinct().select(*keys, F.inline(F.array(*spots)))
            .groupBy(*keys, *["c" + n for n in CELL]).agg(F.bit_or("bit").alias("mask")).filter("mask < 255"))


def surface_vertices(cells: DataFrame, keys: list[str]) -> DataFrame:
    """One vertex per lattice cell that straddles the surface, at the mean of its crossing edges'
    midpoints, and the occupied voxel it belongs to.

    The eight corners of a cell are an 8-bit mask. The 256 answers are worked out once from the mask
    and joined as a 256-row table. Cell (i, j, k) spans voxels i..i+1, so vertices are in voxel index coordinates."""
    placed = F.col("ix").isNotNull() & F.col("iy").isNotNull() & F.col("iz").isNotNull()
    masks = _corner_masks(cells.filter(placed), keys).unionByName(_unplaced_masks(cells.filter(~placed), keys))
    table = cells.sparkSession.createDataFrame([(m, *_vertex_of(m)) for m in range(1, 255)],
                                               "mask int, vx double, vy double, vz double, ox int, oy int, oz int")
    j = masks.join(F.broadcast(table), "mask")  # 254 rows
    return j.select(*keys, *["c" + n for n in CELL], *[(F.col("c" + n) + F.col(v)).alias(p) for n, v, p in zip(CELL, ("vx", "vy", "vz"), "xyz")],
                    *[(F.col("c" + n) + F.col(o)).alias(n) for n, o in zip(CELL, ("ox", "oy", "oz"))])


def _vertex_of(mask: int) -> tuple:
    """Vertex offset in its cell and the nearest occupied corner, for one corner mask."""
    corners = bricks.CORNERS
    on = [bool(mask >> b & 1) for b in range(8)]
    mids = [[(p + q) / 2 for p, q in zip(a, b)] for i, a in enumerate(corners) for j, b in enumerate(corners)
            if j > i and sum(p != q for p, q in zip(a, b)) == 1 and on[i] != on[j]]
    v = [sum(m[k] for m in mids) / len(mids) for k in range(3)]
    own = min((c for c, o in zip(corners, on) if o), key=lambda c: sum((p - q) ** 2 for p, q in zip(c, v)))
    return (*v, *own)


def surface_quads(cells: DataFrame, keys: list[str]) -> DataFrame:
    """One quad per exposed face, naming the four cells whose vertices it joins, wound
    counter-clockwise seen from outside."""
    f = exposed_faces(cells, keys)
    axis = F.col("axis")
    # the face lies between low and low + 1 on its axis; its cells are low on that axis and one
    # back or level on the other two
    low = [F.col(n) - F.when((axis == i) & (F.col("dir") < 0), 1).otherwise(0) for i, n in enumerate(CELL)]
    ring = [(-1, -1), (0, -1), (0, 0), (-1, 0)]
    verts = []
    for du, dv in ring:
        at = []
        for i, n in enumerate(CELL):
            u, v = (axis + 1) % 3 == i, (axis + 2) % 3 == i
            at.append((low[i] + F.when(u, du).when(v, dv).otherwise(0)).alias("c" + n))
        verts.append(F.struct(*at))
    q = F.array(*verts)
    return f.select(*keys, *CELL, "axis", "dir", F.when(F.col("dir") > 0, q).otherwise(F.reverse(q)).alias("ring"))


def quad_triangles(quads: DataFrame, keys: list[str]) -> DataFrame:
    """Two triangles per quad; a vertex is named by its cell."""
    r = F.col("ring")
    tri = lambda a, b, c: F.struct(r[a].alias("a"), r[b].alias("b"), r[c].alias("c"))
    return quads.select(*keys, F.inline(F.array(tri(0, 1, 2), tri(0, 2, 3))))


def edge_counts(triangles: DataFrame, keys: list[str]) -> DataFrame:
    """Triangles on each undirected edge. On a closed surface every edge has two."""
    e = lambda p, q: F.struct(F.least(p, q).alias("p"), F.greatest(p, q).alias("q"))
    a, b, c = (F.col(x) for x in "abc")
    return (triangles.select(*keys, F.inline(F.array(e(a, b), e(b, c), e(c, a)))).groupBy(*keys, "p", "q")
            .agg(F.count(F.lit(1)).alias("n")))


def mesh_audit(edges: DataFrame, keys: list[str]) -> DataFrame:
    """How many edges carry how many triangles."""
    return edges.groupBy(*keys, "n").agg(F.count(F.lit(1)).alias("edges"))


def _quads(batches: Iterator[pa.RecordBatch], edge_mm: int) -> Iterator[pa.RecordBatch]:
    """(frame, u, v) of each quad of four pixels whose ranges agree, from (frame, u, v, depth_mm) that come frame by frame.

    A few thousand rows are held, or one frame if it has more."""
    def whole(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        frame, u, v, mm = (pa.concat_arrays([b.column(i) for b in held]) for i in range(4))
        at = frame.dictionary_encode("encode").indices.to_numpy()
        mm = mm.to_numpy(zero_copy_only=False)
        # a pixel is a corner of four quads; a place that is missing stays so
        lost = [c.is_null().to_numpy(zero_copy_only=False) for c in (u, v)]
        u0, v0 = (c.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (u, v))
        corner = [np.tile(np.arange(len(at)), 4), np.tile(at, 4), np.tile(lost[0], 4), np.concatenate([u0, u0, u0 - ~lost[0], u0 - ~lost[0]]),
                  np.tile(lost[1], 4), np.concatenate([v0, v0 - ~lost[1], v0, v0 - ~lost[1]])]
        order = np.lexsort(corner[:0:-1])
        row, *key = (c[order] for c in corner)
        new = np.ones(len(row), bool)
        new[1:] = np.any([k[1:] != k[:-1] for k in key], axis=0)
        first = np.flatnonzero(new)
        n = np.diff(first, append=len(row))
        span = np.maximum.reduceat(mm[row], first) - np.minimum.reduceat(mm[row], first)
        first = first[(n == 4) & (span <= edge_mm)]
        place = [pa.array(key[i + 1][first], mask=key[i][first]).cast(c.type) for i, c in ((1, u), (3, v))]
        return pa.RecordBatch.from_arrays([frame.take(pa.array(row[first])), *place], names=["frame", "u", "v"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.column(0).dictionary_encode("encode").indices.to_numpy()
        last = len(at) - int(np.argmax(at[::-1] != at[-1])) if (at != at[-1]).any() else 0  # where the last frame begins
        if held and (last or held[-1].column(0)[-1].as_py() != batch.column(0)[0].as_py()) or last:
            yield whole([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield whole(held)


def triangulate_depth(depth: DataFrame, width: int, edge_mm: int = 120) -> DataFrame:
    """Triangles over neighbouring valid pixels whose ranges agree; a depth jump is not bridged.

    Pixels are moved once, by frame, and looked at frame by frame, so that a task holds a sort of its pixels
    and no table of quads: no window over a frame and no self join."""
    d = spread(depth.filter("depth_mm > 0").select("frame", "u", "v", "depth_mm"), "frame").sortWithinPartitions("frame")
    q = d.mapInArrow(lambda batches: _quads(batches, edge_mm), d.select("frame", "u", "v").schema)
    at = lambda du, dv: (F.col("v") + dv) * width + F.col("u") + du
    tri = lambda i, x, y, z: F.struct(F.lit(i).alias("part"), x.alias("a"), y.alias("b"), z.alias("c"))
    a, b, e, f = at(0, 0), at(1, 0), at(0, 1), at(1, 1)
    return q.select("frame", F.inline(F.array(tri(0, a, e, b), tri(1, b, e, f))))


def nearest_colours(points: DataFrame, refs: DataFrame, limit: float | None, keys: list[str] | None = None) -> DataFrame:
    """Each point's colour from the nearest reference within its limit, else its own.

    ``limit`` None means no limit. A ``max_dist`` column narrows the limit per point."""
    keys = keys or []
    q, f = points.select("id", *keys, "x", "y", "z"), refs.select("ref_id", *keys, "x", "y", "z")
    near = nearest(q, f, limit, keys=keys) if limit is not None else nearest_any(q, f, 0.25, keys=keys)
    j = points.join(near, "id", "left").join(refs.select("ref_id", *[F.col(c).alias("n" + c) for c in "rgb"]), "ref_id", "left")
    ok = F.col("d2").isNotNull()
    if "max_dist" in points.columns:
        ok = ok & (F.col("d2") <= F.col("max_dist") * F.col("max_dist"))
    return j.select("id", *keys, ok.alias("found"), *[F.when(ok, F.col("n" + c)).otherwise(F.col(c)).alias(c) for c in "rgb"])


def snap_points(points: DataFrame, refs: DataFrame, limit: float, allowed: Column, keys: list[str] | None = None) -> DataFrame:
    """Move each allowed point onto its nearest reference within ``limit``."""
    keys = keys or []
    near = nearest(points.select("id", *keys, "x", "y", "z"), refs.select("ref_id", *keys, "x", "y", "z"), limit, keys=keys)
    j = points.withColumn("ok_", allowed).join(near, "id", "left").join(refs.select("ref_id", *[F.col(c).alias("n" + c) for c in "xyz"]), "ref_id", "left")
    go = F.col("ok_") & F.col("d2").isNotNull()
    return j.select("id", *keys, go.alias("moved"), *[F.when(go, F.col("n" + c)).otherwise(F.col(c)).alias(c) for c in "xyz"])
