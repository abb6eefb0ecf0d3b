"""Nearest points tile by tile: a task holds the references of one tile and streams the queries that ask there.

A key's references are one tile, or, if they are many, runs of them along a Morton curve. Rows of a tile come
as its references, by ``ref_id``, then its queries. Distances are those of the plain formula, so ties are exact.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

AXES = ("x", "y", "z")
#: References that are compared with a query at once; queries that look for their blocks, and for other tiles, together; pairs at a time.
BLOCK, CHUNK, TOGETHER, PAIRS = 64, 512, 128, 1 << 15
#: A hair that keeps rounding from dropping what holds the answer.
SLACK = 1 + 1e-9


def spread_bits(v: np.ndarray) -> np.ndarray:
    """21 bits, two apart."""
    v = v.astype(np.uint64)
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        v = (v | v << np.uint64(shift)) & np.uint64(mask)
    return v


def curve(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places along a Morton curve through a box, the first 21 bits an axis and the next 21."""
    size = np.where(high > low, high - low, 1.0)
    at = np.minimum(np.clip((points - low) / size, 0.0, 1.0) * float(1 << 42), float((1 << 42) - 1)).astype(np.int64)
    part = lambda v: sum((spread_bits(v[:, a]) << np.uint64(2 - a) for a in range(3)), np.zeros(len(v), np.uint64)).astype(np.int64)
    return part(at >> 21), part(at & (1 << 21) - 1)


def gaps(low: np.ndarray, high: np.ndarray, box_low: np.ndarray, box_high: np.ndarray) -> np.ndarray:
    """Least squared distance between boxes."""
    g = np.maximum(np.maximum(box_low - high, low - box_high), 0.0)
    return (g * g).sum(axis=-1)


def closest(points: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each point the least squared distance and the first of ``refs`` that has it."""
    d2, first = np.empty(len(points)), np.empty(len(points), np.int64)
    step = max(1, PAIRS // len(refs))
    for lo in range(0, len(points), step):
        p = points[lo:lo + step]
        total = None
        for a in range(3):
            d = p[:, a, None] - refs[None, :, a]
            d *= d
            total = d if total is None else np.add(total, d, out=total)
        at = total.argmin(axis=1)
        first[lo:lo + step], d2[lo:lo + step] = at, total[np.arange(len(p)), at]
    return d2, first


class Tile:
    """References in the order of their ids, and blocks of them that stand together."""

    def __init__(self, refs: np.ndarray):
        self.refs, self.blocks = refs, None
        if len(refs) > 4 * BLOCK:
            order = np.lexsort(curve(refs, refs.min(axis=0), refs.max(axis=0))[::-1])
            self.blocks = np.full((-(-len(refs) // BLOCK), BLOCK), len(refs))
            self.blocks.flat[:len(refs)] = order
            self.blocks.sort(axis=1)
            held = np.vstack([refs, np.full((1, 3), np.inf)])[self.blocks]
            self.at = [np.ascontiguousarray(held[:, :, a]) for a in range(3)]
            self.low, self.high = held.min(axis=1), np.where(np.isinf(held), -np.inf, held).max(axis=1)

    def find(self, points: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distance and place of the first nearest reference; what is farther than ``bound`` need not be found."""
        if self.blocks is None:
            return closest(points, self.refs)
        d2, first = np.full(len(points), np.inf), np.full(len(points), len(self.refs))
        for lo in range(0, len(points), CHUNK):
            self._visit(points[lo:lo + CHUNK], bound[lo:lo + CHUNK], d2[lo:lo + CHUNK], first[lo:lo + CHUNK])
        return d2, np.minimum(first, len(self.refs) - 1)

    def _visit(self, p: np.ndarray, bound: np.ndarray, d2: np.ndarray, first: np.ndarray) -> None:
        """Each point visits its blocks from the nearest on, until one is farther than what it has."""
        near = np.flatnonzero(gaps(p.min(axis=0), p.max(axis=0), self.low, self.high) <= bound.max() * SLACK)
        gap = np.zeros((len(p), len(near)))
        for a in range(3):
            g = np.maximum(self.low[near, a] - p[:, a, None], p[:, a, None] - self.high[near, a])
            np.maximum(g, 0.0, out=g)
            gap += g * g
        rows = np.arange(len(p)) if len(near) else np.zeros(0, np.int64)
        while len(rows):
            to = gap[rows].argmin(axis=1)
            go = gap[rows, to] <= np.minimum(d2[rows], bound[rows]) * SLACK
            rows, to = rows[go], to[go]
            gap[rows, to] = np.inf
            block, total = near[to], None
            for a in range(3):
                d = p[rows, a, None] - self.at[a][block]
                d *= d
                total = d if total is None else np.add(total, d, out=total)
            at = total.argmin(axis=1)
            got, place = total[np.arange(len(rows)), at], self.blocks[block, at]
            better = (got < d2[rows]) | (got == d2[rows]) & (place < first[rows])
            d2[rows[better]], first[rows[better]] = got[better], place[better]


def many_small(refs: np.ndarray, points: np.ndarray, ref_at: np.ndarray, ref_n: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``closest`` of each point among its own group's references (``of`` numbers the groups), for all at once."""
    n = ref_n[of]
    begin = np.cumsum(n) - n
    ref = np.repeat(ref_at[of] - begin, n) + np.arange(n.sum())
    d = np.repeat(points, n, axis=0) - refs[ref]
    d2 = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]
    best = np.minimum.reduceat(d2, begin)
    same = np.flatnonzero(d2 == np.repeat(best, n))
    return best, ref[same[np.searchsorted(same, begin)]]


class Index:
    """The tiles of the keys that have several: where each begins on its key's curve, and its box."""

    def __init__(self, rows: list[tuple], boxes: dict[tuple, tuple]):
        """``rows``: (key, tile, hi, lo, low corner, high corner)."""
        tiles: dict[tuple, list[tuple]] = {key: [] for key in boxes}
        for r in sorted(rows, key=lambda r: r[2:4]):
            tiles[r[0]].append(r[1:])
        self.of = {key: (*np.array(boxes[key], float), *(np.array([r[i] for r in mine], np.int64) for i in range(3)),
                         *(np.array([r[i] for r in mine], float) for i in (3, 4))) for key, mine in tiles.items()}

    def home(self, key: tuple, points: np.ndarray) -> np.ndarray:
        """The tile on whose part of the curve a point falls: a good first guess."""
        low, high, tile, begin, second, _, _ = self.of[key]
        hi, lo = curve(points, low, high)
        at = np.searchsorted(begin, hi, "right") - 1
        for i in np.unique(at[(at > 0) & (begin[at] == hi) & (begin[at - 1] == hi)]):  # tiles that begin in one cell
            first, rows = int(np.searchsorted(begin, begin[i])), np.flatnonzero((at == i) & (hi == begin[i]))
            at[rows] = np.maximum(first - 1, first + np.searchsorted(second[first:i + 1], lo[rows], "right") - 1)
        return tile[np.maximum(at, 0)]

    def others(self, key: tuple, home: int, points: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, tile) of all tiles but ``home`` that may hold something within the squared distance ``reach``."""
        _, _, tile, _, _, low, high = self.of[key]
        rows, tiles = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        hi, lo = curve(points, points.min(axis=0), points.max(axis=0))
        order = np.lexsort((lo, hi))
        for at in range(0, len(order), TOGETHER):
            some = order[at:at + TOGETHER]
            p, r = points[some], reach[some] * SLACK
            near = np.flatnonzero((gaps(p.min(axis=0), p.max(axis=0), low, high) <= r.max()) & (tile != home))
            if len(near):
                i, j = np.nonzero(gaps(p[:, None], p[:, None], low[None, near], high[None, near]) <= r[:, None])
                rows.append(some[i])
                tiles.append(tile[near[j]])
        return np.concatenate(rows), np.concatenate(tiles)


def xyz(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(a).to_numpy(zero_copy_only=False) for a in AXES])


def segments(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Where rows begin whose ``names`` differ from those of the row before; the first row counts."""
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for c in names:
        v = batch.column(c)
        new[1:] |= pc.not_equal(v.slice(1), v.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def key_of(batch: pa.RecordBatch, keys: list[str], row: int) -> tuple:
    return tuple(batch.column(k)[row].as_py() for k in keys)


def by_key(batch: pa.RecordBatch, keys: list[str]) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    """The rows ordered by key, and where each key begins and ends."""
    if keys and batch.num_rows:
        batch = batch.take(pc.sort_indices(pa.Table.from_batches([batch]), [(k, "ascending") for k in keys]))
    begin = segments(batch, keys)
    return batch, begin, np.append(begin[1:], batch.num_rows)


def homes(batches: Iterator[pa.RecordBatch], keys: list[str], index: Index) -> Iterator[pa.RecordBatch]:
    """The rows with ``tile``: where a query of a key of several tiles begins, -1 for the others."""
    for batch in batches:
        batch, begin, end = by_key(batch, keys)
        tile, points = np.full(batch.num_rows, -1, np.int64), xyz(batch)
        for a, b in zip(begin, end):
            if (key := key_of(batch, keys, a)) in index.of:
                tile[a:b] = index.home(key, points[a:b])
        yield batch.append_column("tile", pa.array(tile))


def numbered(batches: Iterator[pa.RecordBatch], keys: list[str], most: int, part: int) -> Iterator[pa.RecordBatch]:
    """Rows in the order of keys and curve with ``tile``, a new one after ``most`` rows or with the next key."""
    made, held, last = 0, 0, None
    for batch in batches:
        tile, begin = np.empty(batch.num_rows, np.int64), segments(batch, keys)
        for a, b in zip(begin, np.append(begin[1:], batch.num_rows)):
            key = key_of(batch, keys, a)
            if key != last:
                made, held, last = made + 1, 0, key
            place = held + np.arange(b - a)
            tile[a:b] = (part << 32) + made + place // most
            made, held = made + int(place[-1] // most), int(place[-1] % most) + 1
        yield batch.append_column("tile", pa.array(tile))


def answers(batches: Iterator[pa.RecordBatch], keys: list[str], limit2: float, index: Index | None, out: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(keys.., tile, id, x, y, z, d2, ref_id) from rows of tiles, references first: what a query found, ``tile`` null, and
    with ``index`` where else it has to ask, and within which ``d2``."""
    group, told = [*keys, "tile", "salt"], None
    refs, ids, tile = [], [], None

    def results(rows: pa.RecordBatch, d2: np.ndarray, ref_id: pa.Array) -> pa.RecordBatch:
        ok = pa.array(d2 <= limit2)
        n = rows.num_rows
        col = {"tile": pa.nulls(n, pa.int64()), "id": rows.column("id"), "d2": pa.array(d2), "ref_id": ref_id, **{a: pa.nulls(n, pa.float64()) for a in AXES}}
        return pa.RecordBatch.from_arrays([col.get(f.name, None) if f.name in col else pa.nulls(n, f.type) for f in out], schema=out).filter(ok)

    def ask(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        nonlocal refs, ids, tile
        if tile is None:
            ids = pa.concat_arrays(ids)
            tile = Tile(np.concatenate(refs))
            refs = []
        points = xyz(rows)
        bound = np.minimum(rows.column("d2").fill_null(np.inf).to_numpy(zero_copy_only=False), limit2)
        d2, first = tile.find(points, bound)
        d2 = np.where(d2 <= bound * SLACK, d2, np.inf)
        yield results(rows, d2, ids.take(pa.array(first)))
        home = rows.column("tile")[0].as_py()
        if index is not None and home >= 0:
            row, there = index.others(key_of(rows, keys, 0), home, points, np.minimum(d2, bound))
            if len(row):
                sent = rows.take(pa.array(row))
                col = {"tile": pa.array(there), "d2": pa.array(np.minimum(d2, bound)[row]), "ref_id": pa.nulls(len(row), out.field("ref_id").type)}
                yield pa.RecordBatch.from_arrays([col[f.name] if f.name in col else sent.column(f.name) for f in out], schema=out)

    for batch in batches:
        if not batch.num_rows:
            continue
        begin = segments(batch, group)
        end = np.append(begin[1:], batch.num_rows)
        is_ref = batch.column("asks").to_numpy(zero_copy_only=False) == 0
        n_ref = np.add.reduceat(is_ref.astype(np.int64), begin)
        n_ask = end - begin - n_ref
        # whole groups of few pairs, none of which may have rows in another batch
        few = (n_ref > 0) & (n_ask > 0) & (n_ref * n_ask <= 512)
        few[0] = few[-1] = False
        if index is not None:
            few &= batch.column("tile").to_numpy(zero_copy_only=False)[begin] < 0
        if few.any():
            of = np.repeat(np.arange(int(few.sum())), n_ask[few])
            at = np.repeat(begin[few] + n_ref[few], n_ask[few]) + np.arange(len(of)) - np.repeat(np.cumsum(n_ask[few]) - n_ask[few], n_ask[few])
            points = xyz(batch)
            rows = batch.take(pa.array(at))
            bound = np.minimum(rows.column("d2").fill_null(np.inf).to_numpy(zero_copy_only=False), limit2)
            d2, ref = many_small(points, points[at], begin[few], n_ref[few], of)
            yield results(rows, np.where(d2 <= bound * SLACK, d2, np.inf), batch.column("ref_id").take(pa.array(ref)))
        for i in np.flatnonzero(~few):
            a, b, m = int(begin[i]), int(end[i]), int(begin[i] + n_ref[i])
            if i or (here := key_of(batch, group, a)) != told:
                refs, ids, tile = [], [], None
            if m > a:
                part = batch.slice(a, m - a)
                refs.append(xyz(part))
                ids.append(part.column("ref_id"))
            if b > m and (tile is not None or refs):
                yield from ask(batch.slice(m, b - m))
        told = key_of(batch, group, batch.num_rows - 1)
