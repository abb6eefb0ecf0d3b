"""Near duplicates among vectors by a forest of random projection trees with overlapping halves.

A node splits its vectors at the median of a random projection, and what lies within a margin of
the median goes to both sides, so a pair of near vectors is rarely parted. Vectors are compared
within leaves only, in tiles of bounded size, exactly and in double precision; a pair counts in the
least of the leaves that it shares, so trees may find it again. Crowds that no projection parts are
taken out as balls: vectors within half the angle of one leader are all linked with each other.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm.graph import components
from voxmill.llm.shared import join_copies, stored

#: Leaf ids are even; a leaf that projections don't part any further gets the odd id above it.
_PLACED = "c long, w long, id long, vec binary, ball long, leaves array<long>"
#: What a pair at cosine 0.95 survives a split with, for a margin of 0.2, and by how much a level of such splits grows.
SURVIVES, OVERLAP = 0.985, 0.16


def _leaf(*parts: int) -> int:
    h = xxhash.xxh3_64_intdigest(np.array(parts, np.int64).tobytes())
    return (h - (1 << 64) if h >= 1 << 63 else h) & ~1


def _units(vecs: list[bytes], kind: str) -> np.ndarray:
    """Rows of length one; the largest component is taken out first, so squares neither overflow nor vanish."""
    v = np.frombuffer(b"".join(vecs), kind).reshape(len(vecs), -1).astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _by_size(vecs: list[bytes]) -> Iterator[np.ndarray]:
    sizes = np.array([len(v) for v in vecs])
    for size in np.unique(sizes):
        yield np.flatnonzero(sizes == size)


def prepared(vectors: DataFrame, vec_id: str, vector: str) -> tuple[DataFrame, str]:
    """``key, id, vec`` with ``vec`` null where a vector can't be compared, and how its bytes are to be read."""
    single = vectors.schema[vector].dataType.elementType.typeName() == "float"
    kind, v = ("<f4" if single else "<f8"), F.col("vec")
    rows = vectors.select(F.monotonically_increasing_id().alias("key"), F.col(vec_id).cast("long").alias("id"),
                          F.col(vector).cast(f"array<{'float' if single else 'double'}>").alias("vec"))
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.withColumn("vec", F.when(~odd & F.exists(v, lambda x: x != 0), v))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat = (lists.flatten().to_numpy(zero_copy_only=False).astype(kind) + np.dtype(kind).type(0)).tobytes()
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())]) * int(kind[-1])
            vecs = [None if null else flat[a:b] for null, a, b in zip(lists.is_null().to_pylist(), ends.tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(vecs, pa.binary())], names=["key", "id", "vec"])

    return stored(rows.mapInArrow(pack, "key long, id long, vec binary"), "vectors"), kind


def trees_for(n: int, cap: int, missed: float) -> int:
    """Trees so that a pair at the least cosine shares no leaf with a chance of ``missed``, at the depth that ``n`` vectors need."""
    levels = max(0, math.ceil(math.log(max(1, n / cap)) / math.log(2 / (1 + OVERLAP))))
    return 1 if not levels else max(2, math.ceil(math.log(missed) / math.log(1 - SURVIVES ** levels)))


def _descend(units: np.ndarray, leaf: int, cuts: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """``row, path`` for each end of each row in the subtree of ``leaf``; nodes without a cut are ends."""
    levels = int(len(cuts)).bit_length() - 1
    seen = units @ _directions(leaf, levels, units.shape[1])
    row, path, ends = np.arange(len(units)), np.ones(len(units), np.int64), []
    for level in range(levels):
        cut = cuts[path]
        done = np.isnan(cut)
        ends.append((row[done], path[done]))
        row, path, cut = row[~done], path[~done], cut[~done]
        p = seen[row, level]
        left, right = p <= cut + margin, p >= cut - margin
        row, path = np.concatenate([row[left], row[right]]), np.concatenate([2 * path[left], 2 * path[right] + 1])
    ends.append((row, path))
    return np.concatenate([r for r, _ in ends]), np.concatenate([p for _, p in ends])


def _directions(leaf: int, levels: int, dims: int) -> np.ndarray:
    """One random direction for each level of the subtree of ``leaf``."""
    return np.random.default_rng([leaf & 0xFFFFFFFF, leaf >> 32 & 0xFFFFFFFF]).standard_normal((dims, levels))


def _fit(units: np.ndarray, leaf: int, size: int, cap: int, levels: int, margin: float) -> np.ndarray:
    """Cuts of the subtree of ``leaf`` from its sampled ``units``, by path; none if its first cut parts little."""
    seen = units @ _directions(leaf, levels, units.shape[1])
    cuts = np.full(2 ** levels, np.nan)
    nodes = {1: np.arange(len(units))}
    for level in range(levels):
        below = {}
        for path, rows in nodes.items():
            if len(rows) < 16 or len(rows) * size <= cap * len(units):
                continue
            p = seen[rows, level]
            cut = np.median(p)
            left, right = rows[p <= cut + margin], rows[p >= cut - margin]
            if len(left) + len(right) > 1.6 * len(rows):
                continue
            cuts[path] = cut
            below |= {2 * path: left, 2 * path + 1: right}
        nodes = below
    return cuts


def _leader(units: np.ndarray, near: float, least: int) -> int:
    """The row with the most others within ``near`` of it, or -1 if those are fewer than ``least``."""
    if len(units) < least:
        return -1
    counts = np.concatenate([(units[a:a + 512] @ units.T >= near).sum(axis=1) for a in range(0, len(units), 512)])
    return int(counts.argmax()) if counts.max() >= least else -1


def leaf_sizes(placed: DataFrame) -> DataFrame:
    """``leaf, n, main, main_n``: rows of each leaf, its largest ball and that ball's rows."""
    parts = placed.select(F.explode("leaves").alias("leaf"), "ball").groupBy("leaf", "ball").agg(F.count("*").alias("k"))
    own = F.when(F.col("ball").isNotNull(), F.col("k"))
    return parts.groupBy("leaf").agg(F.sum("k").alias("n"), F.max_by("ball", own).alias("main"), F.coalesce(F.max(own), F.lit(0)).alias("main_n"))


def grown(classes: DataFrame, kind: str, trees: int, near: float, cap: int, margin: float = 0.2, sample: int = 4096,
          levels: int = 8, at_once: int = 8192) -> DataFrame:
    """``classes`` (c, w, id, vec) with their ``ball`` and ``leaves``.

    A round fits a subtree to about ``sample`` rows of each leaf of more than ``cap`` rows outside its largest
    ball, ``at_once`` leaves at most, and sends all rows of those leaves down; only cuts go through the driver.
    """
    spark = classes.sparkSession

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = [[_leaf(t, s) for t in range(trees)] for s in map(len, batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(batch.num_rows, pa.int64()), pa.array(leaves, pa.list_(pa.int64()))],
                                             names=[*batch.schema.names, "ball", "leaves"])

    placed = stored(classes.select("c", "w", "id", "vec").mapInArrow(roots, _PLACED), "placed")
    outside = F.col("n") - F.col("main_n")
    while crowded := leaf_sizes(placed).filter((outside > cap) & (F.col("leaf") % 2 == 0)).orderBy(outside.desc(), "leaf").limit(at_once).collect():
        sizes = {r.leaf: r.n - r.main_n for r in crowded}
        told = spark.sparkContext.broadcast({r.leaf: (r.main, min(1.0, sample / (r.n - r.main_n))) for r in crowded})

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted = told.value
            for batch in batches:
                out = []
                for c, vec, ball, leaves in zip(*(batch.column(k).to_pylist() for k in range(4))):
                    for leaf in leaves:
                        if leaf in wanted:
                            main, rate = wanted[leaf]
                            if (ball is None or ball != main) and _leaf(c, leaf, 1) % (1 << 32) < rate * (1 << 32):
                                out.append((leaf, c, vec, ball))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.int64()))],
                                                 names=["leaf", "c", "vec", "ball"])

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("c")
            leaf, units = int(pdf["leaf"].iloc[0]), _units(list(pdf["vec"]), kind)
            size = sizes_of.value[leaf]
            cuts = _fit(units, leaf, size, cap, levels, margin)
            free = pdf["ball"].isna().to_numpy()
            best = _leader(units[free], near, max(2, len(pdf) // 8, math.ceil(cap * len(pdf) / (4 * size))))
            at = np.flatnonzero(free)[best] if best >= 0 else -1
            return pd.DataFrame({"leaf": [leaf], "cuts": [cuts.tolist() if not np.isnan(cuts[1]) else None], "size": [size],
                                 "ball": [int(pdf["c"].iloc[at]) if at >= 0 else None], "vec": [pdf["vec"].iloc[at] if at >= 0 else None]})

        sizes_of = spark.sparkContext.broadcast(sizes)
        picked = placed.select("c", "vec", "ball", "leaves").mapInArrow(pick, "leaf long, c long, vec binary, ball long")
        fits = stored(picked.groupBy("leaf").applyInPandas(fit, "leaf long, cuts array<double>, size long, ball long, vec binary"), "cuts")
        leaders = fits.filter("ball is not null").orderBy(F.desc("size"), "ball").limit(4096).select("ball", "vec").collect()
        found = spark.sparkContext.broadcast((
            {r.leaf: None if r.cuts is None else np.array(r.cuts, float) for r in fits.filter("cuts is not null or ball is null").select("leaf", "cuts").toLocalIterator()},
            [(r.ball, bytes(r.vec)) for r in leaders]))

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fitted, balls = found.value
            for batch in batches:
                vecs, held = batch.column(3).to_pylist(), batch.column(4).to_pylist()
                leaves = [set() for _ in vecs]
                for rows in _by_size(vecs):
                    units = _units([vecs[r] for r in rows], kind)
                    same = [(b, v) for b, v in balls if len(v) == len(vecs[rows[0]])]
                    if same:
                        close = units @ _units([v for _, v in same], kind).T >= near
                        for k in np.flatnonzero(close.any(axis=1)):
                            if held[rows[k]] is None:
                                held[rows[k]] = same[int(close[k].argmax())][0]
                    groups: dict[int, list[int]] = {}
                    lists = batch.column(5).take(pa.array(rows)).to_pylist()
                    for k, own in enumerate(lists):
                        for leaf in own:
                            if leaf not in fitted:
                                leaves[rows[k]].add(leaf)
                            elif fitted[leaf] is None:
                                leaves[rows[k]].add(leaf | 1)
                            else:
                                groups.setdefault(leaf, []).append(k)
                    for leaf, own in groups.items():
                        row, path = _descend(units[own], leaf, fitted[leaf], margin)
                        names = {p: _leaf(leaf, p, 2) for p in np.unique(path).tolist()}
                        for r, p in zip(row.tolist(), path.tolist()):
                            leaves[rows[own[r]]].add(names[p])
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(held, pa.int64()), pa.array([sorted(x) for x in leaves], pa.list_(pa.int64()))],
                                                 names=batch.schema.names)

        placed = stored(placed.mapInArrow(send, _PLACED), "placed")
    return placed


def _merged(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``labels`` with those of each i and j made one, the least."""
    while True:
        a, b = labels[i], labels[j]
        other = a != b
        if not other.any():
            return labels
        i, j, a, b = i[other], j[other], a[other], b[other]
        root = np.arange(len(labels))
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        labels = root[labels]


def _first_met(leaf: int, lists: list) -> np.ndarray:
    """Ids below ``leaf`` of each row's leaves, one row each, filled up with ``leaf``."""
    before = [np.array([x for x in own if x < leaf], np.int64) for own in lists]
    out = np.full((len(lists), max(1, *map(len, before))), leaf, np.int64)
    for k, own in enumerate(before):
        out[k, :len(own)] = own
    return out


def tiles(placed: DataFrame, cap: int) -> DataFrame:
    """``leaf, tile, side`` for each row of ``placed``: a leaf in one tile, or cut into tiles of pairs of its parts.

    A crowded leaf's largest ball is never compared with itself: its parts meet the parts of the rest, and
    those each other. Side 2 rows meet all of their tile, 0 and 1 each other.
    """
    sizes = leaf_sizes(placed).filter("n > 1")
    rows = placed.withColumn("leaf", F.explode("leaves"))
    large = stored(sizes.filter(F.col("n") > 2 * cap).select("leaf", "main", F.ceil((F.col("n") - F.col("main_n")) / cap).alias("rest"),
                                                             F.greatest(F.lit(0), F.ceil(F.col("main_n") / cap)).alias("balls")), "large")
    whole = F.col("rest").isNull()
    if large.isEmpty():
        return rows.withColumns({"tile": F.lit("0"), "side": F.lit(2)})
    rows = rows.join(large, "leaf", "left")
    inside = F.col("ball").eqNullSafe(F.col("main")) & F.col("main").isNotNull()
    part = F.pmod(F.xxhash64("c", "leaf"), F.when(inside, F.col("balls")).otherwise(F.greatest("rest", F.lit(1))))
    rows = rows.withColumn("part", F.when(~whole, part))

    def meets(name, this_first, count, side):
        others = F.sequence(F.lit(0).cast("long"), F.col(count) - 1)
        place = (lambda o: F.concat_ws("/", F.lit(name), F.col("part"), o)) if this_first else (lambda o: F.concat_ws("/", F.lit(name), o, F.col("part")))
        return F.when(F.col(count) > 0, F.transform(others, lambda o: F.struct(place(o).alias("tile"), F.lit(side).alias("side")))).otherwise(F.array())

    rest = F.transform(F.sequence(F.lit(0).cast("long"), F.col("rest") - 1), lambda o: F.struct(
        F.concat_ws("/", F.lit("r"), F.least("part", o), F.greatest("part", o)).alias("tile"),
        F.when(o == F.col("part"), 2).when(F.col("part") < o, 0).otherwise(1).alias("side")))
    spots = (F.when(whole, F.array(F.struct(F.lit("0").alias("tile"), F.lit(2).alias("side"))))
             .when(inside, meets("b", True, "rest", 0)).otherwise(F.concat(rest, meets("b", False, "balls", 1))))
    rows = rows.withColumn("spot", F.explode(spots))
    return rows.select(*[c for c in placed.columns], "leaf", "spot.tile", "spot.side")


def compared(placed: DataFrame, kind: str, least: float, cap: int) -> DataFrame:
    """``c, links, other``: for rows that are linked in a tile the weight linked there first, and the least row of their group in it."""
    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("c")
        c, w, side = (pdf[x].to_numpy(np.int64) for x in ("c", "w", "side"))
        ball, leaf = pdf["ball"].fillna(-1).to_numpy(np.int64), int(pdf["leaf"].iloc[0])
        units, links, labels, before = _units(list(pdf["vec"]), kind), np.zeros(len(c), np.int64), np.arange(len(c)), None
        for at in range(0, len(c), 512):
            i, j = np.nonzero(units[at:at + 512] @ units.T >= least)
            i += at
            pair = (i < j) & ((side[i] != side[j]) | (side[i] == 2)) & ((ball[i] < 0) | (ball[i] != ball[j]))
            i, j = i[pair], j[pair]
            labels = _merged(labels, i, j)
            if len(i) and before is None:
                before = _first_met(leaf, list(pdf["leaves"]))
            for k in range(0, len(i), 20_000):
                a, b = i[k:k + 20_000], j[k:k + 20_000]
                again = ((before[a][:, :, None] == before[b][:, None, :]) & (before[a] != leaf)[:, :, None]).any(axis=(1, 2))
                np.add.at(links, a[~again], w[b[~again]])
                np.add.at(links, b[~again], w[a[~again]])
        met = (np.bincount(labels, minlength=len(c)) > 1)[labels]
        return pd.DataFrame({"c": c[met], "links": links[met], "other": c[labels][met]})

    parts = tiles(placed, cap).select("leaf", "tile", "side", "c", "w", "vec", "ball", "leaves")
    return parts.groupBy("leaf", "tile").applyInPandas(compare, "c long, links long, other long")


def near_groups(vectors: DataFrame, vec_id="vec_id", vector="embedding", least: float = 0.95, missed: float = 1e-4, cap: int = 2048,
                trees: int | None = None, **growth) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row.

    Two vectors are linked if their cosine, in double precision, is ``least`` or more; ``n_links`` counts the
    other rows linked directly, ``component_id`` is the least id reachable and ``kept`` says that it is the
    row's own. Equal vectors are compared once and counted as often as they occur. ``trees`` follows from
    ``missed``, the chance that a pair just at ``least`` shares no leaf, unless it is given; no pair below ``least`` is linked.

    Vectors that are null, empty or zero or hold nulls or numbers that are not finite, link with nothing; those
    of different lengths don't link either. A null id is no component's least; its row is kept only if nothing
    is linked with it. Repeated rows link with each other. Other columns are not read.
    """
    rows, kind = prepared(vectors, vec_id, vector)
    classes = rows.filter("vec is not null").groupBy("vec").agg(F.min("key").alias("c"), F.count("*").alias("w"), F.min("id").alias("id"))
    classes = stored(classes.select("c", "w", "id", "vec"), "classes")
    half = math.sqrt((1 + least) / 2) + 1e-9
    placed = grown(classes, kind, trees or trees_for(classes.count(), cap, missed), half, cap, **growth)
    met = stored(compared(placed, kind, least, cap), "met")
    balls = placed.filter("ball is not null")
    edges = met.select(F.col("c").alias("a"), F.col("other").alias("b")).unionByName(balls.select(F.col("c").alias("a"), F.col("ball").alias("b")))
    labels = stored(components(edges), "labels")
    told = placed.select("c", "w", "id", "ball", F.unhex(F.sha2("vec", 256)).alias("digest"))
    told = told.join(met.groupBy("c").agg(F.sum("links").alias("links")), "c", "left").join(labels.withColumnRenamed("node", "c"), "c", "left")
    told = told.join(balls.groupBy("ball").agg(F.sum("w").alias("ball_w")), "ball", "left")
    told = stored(told.select("digest", "id", F.col("w").alias("copies"), F.coalesce("label", "c").alias("label"),
                              (F.coalesce("links", F.lit(0)) + F.coalesce("ball_w", "w") - 1).alias("n_links")), "told")
    firsts = told.groupBy("label").agg(F.min("id").alias("component_id"))
    told = stored(told.join(firsts, "label").select("digest", "copies", "n_links", "component_id"), "components")
    own = rows.select("key", "id", F.unhex(F.sha2("vec", 256)).alias("digest"))
    out = join_copies(own, told, ["n_links", "component_id"])
    single = F.col("n_links").isNull()
    out = out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                     F.when(single, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("n_links") == 0))
