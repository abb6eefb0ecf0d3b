"""Benchmark decontamination: SimHash of item-sized windows, multi-index lookup, exact verification.

A window is as many consecutive words of a document as the item has. Only windows with a shingle of
the item can be similar at all, so only these get a fingerprint. Items within the Hamming radius are
found by blocks of bits: with few enough errors overall, one block has at most ``NEAR`` of them, and
the index holds every block value so near. Exact weighted-shingle similarity then decides.
"""

import itertools
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm.shared import Hashes, small, utf8

BITS, BLOCK, NEAR = 256, 8, 2
#: Most differing bits. At similarity 0.8 some 39 of 256 differ, with a deviation of 6. Up to 95, one of
#: the 32 blocks has at most NEAR of them, so the index misses nothing within the radius.
RADIUS = 72
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_FLIPS = np.array([0] + [sum(1 << b for b in c) for n in range(1, NEAR + 1) for c in itertools.combinations(range(BLOCK), n)], np.uint8)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of ``k`` consecutive words' hashes."""
    g = h[:max(0, len(h) - k + 1)].copy()
    for i in range(1, k):
        g = (g ^ (g >> np.uint64(29))) * _M1 + h[i:len(g) + i]
    return (g ^ (g >> np.uint64(32))) * _M2


def signs(g: np.ndarray) -> np.ndarray:
    """+1 or -1 for each shingle and bit."""
    out = np.empty((len(g), BITS // 64), np.uint64)
    x = g
    for i in range(BITS // 64):
        x = (x + _M1) * _M2
        x = (x ^ (x >> np.uint64(31))) * _M1
        out[:, i] = x ^ (x >> np.uint64(27))
    return np.unpackbits(out.view(np.uint8), axis=1).astype(np.float32) * 2 - 1


def similarity(a: np.ndarray, b: np.ndarray, weight) -> float:
    """Weighted Jaccard of two bags of shingles."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.bincount(at[:len(a)], minlength=len(names)), np.bincount(at[len(a):], minlength=len(names))
    w = weight(names)
    return float((np.minimum(x, y) * w).sum() / (np.maximum(x, y) * w).sum())


@dataclass
class Items:
    """A bounded block of items and its index."""

    ids: list
    sizes: np.ndarray
    bags: list[np.ndarray]
    names: dict[int, np.ndarray]       # shingle length -> sorted shingles
    owners: dict[int, list[np.ndarray]]  # and which items have each
    known: np.ndarray                  # all shingles, sorted
    weights: np.ndarray
    rare: float
    keys: np.ndarray                   # sorted (size, block, value) of the index
    values: np.ndarray                 # the item of each
    prints: np.ndarray

    def weight(self, g: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known, g), len(self.known) - 1)
        return np.where(self.known[at] == g, self.weights[at], self.rare)


def _prints(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=-1)


def _keys(size, prints: np.ndarray) -> np.ndarray:
    block = np.arange(BITS // BLOCK, dtype=np.int64)
    return (np.asarray(size, np.int64)[..., None] << 16) | (block << 8) | prints.astype(np.int64)


def prepare(items: list[tuple], n: int, total: int, df: dict[int, int]) -> Items:
    """``items`` are (id, shingle length, word count, shingles); ``df`` counts items by shingle among ``total``."""
    ids, ks, sizes = [i[0] for i in items], [i[1] for i in items], np.array([i[2] for i in items], np.int64)
    bags = [i[3] for i in items]
    known = np.unique(np.concatenate(bags))
    weights = np.array([1 + np.log(total / df[int(g)]) for g in known])
    names, owners = {}, {}
    for k in set(ks):
        own = defaultdict(set)
        for t, (kk, bag) in enumerate(zip(ks, bags)):
            if kk == k:
                for g in bag.tolist():
                    own[g].add(t)
        names[k] = np.array(sorted(own), np.uint64)
        owners[k] = [np.array(sorted(own[int(g)]), np.int64) for g in names[k]]
    out = Items(ids, sizes, bags, names, owners, known, weights, 1 + float(np.log(total)), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8))
    out.prints = np.array([_prints((signs(b) * out.weight(b)[:, None]).sum(0)) for b in bags])
    near = out.prints[:, :, None] ^ _FLIPS                            # item, block, value
    block = np.arange(BITS // BLOCK, dtype=np.int64)
    keys = (sizes[:, None, None] << 16) | (block[None, :, None] << 8) | near.astype(np.int64)
    values = np.broadcast_to(np.arange(len(bags))[:, None, None], keys.shape)
    order = np.argsort(keys, axis=None, kind="stable")
    out.keys, out.values = keys.reshape(-1)[order], values.reshape(-1)[order]
    return out


def leaks(words: list[bytes], items: Items, hashes: Hashes, least: float) -> list[tuple[int, float, int]]:
    """``item, similarity, first word`` of the best window (the first of equals) for items similar enough."""
    if not words:
        return []
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    found: dict[int, tuple[float, int]] = {}
    for k, names in items.names.items():
        g = shingles(h, k)
        at = np.searchsorted(names, g)
        hit = np.flatnonzero(names[np.minimum(at, len(names) - 1)] == g)
        if not len(hit):
            continue
        # starts of item-sized windows that hold a shingle of the item
        starts: dict[int, set] = defaultdict(set)
        for p in hit.tolist():
            for t in items.owners[k][at[p]].tolist():
                m = min(int(items.sizes[t]), len(words))
                starts[t].update(range(max(0, p + k - m), min(p, len(words) - m) + 1))
        by_size: dict[int, set] = defaultdict(set)
        for t, s in starts.items():
            by_size[int(items.sizes[t])] |= s
        for size, s in by_size.items():
            s = np.array(sorted(s), np.int64)
            m = min(size, len(words)) - k + 1
            for part in np.split(s, np.flatnonzero(np.diff(s) > m) + 1):       # one stretch of text
                for part in np.split(part, range(4096, len(part), 4096)):
                    lo, hi = int(part[0]), int(part[-1]) + m
                    x = signs(g[lo:hi]) * items.weight(g[lo:hi])[:, None].astype(np.float32)
                    sums = np.concatenate([np.zeros((1, BITS), np.float64), np.cumsum(x, 0, dtype=np.float64)])
                    prints = _prints(sums[part - lo + m] - sums[part - lo])
                    keys = _keys(np.full(len(part), size), prints)
                    a, b = np.searchsorted(items.keys, keys, "left"), np.searchsorted(items.keys, keys, "right")
                    for w in np.flatnonzero((b > a).any(1)).tolist():
                        near = set(itertools.chain.from_iterable(items.values[i:j].tolist() for i, j in zip(a[w], b[w]) if j > i))
                        for t in near:
                            if np.bitwise_count(items.prints[t] ^ prints[w]).sum() > RADIUS:
                                continue
                            start = int(part[w])
                            value = similarity(g[start:start + m], items.bags[t], items.weight)
                            if value >= least and (t not in found or (-value, start) < (-found[t][0], found[t][1])):
                                found[t] = value, start
    return [(t, *v) for t, v in sorted(found.items())]


def item_blocks(benchmark: DataFrame, n: int = 5, item_id="item_id", text="text", most: int = 2000) -> Iterator[Items]:
    """The items in blocks of at most ``most``, so that what each pass broadcasts is bounded.

    Words are runs of non-space, A-Z in lower case. An item of fewer than ``n`` words is one shingle;
    items without words, null or empty, can't leak and are left out.
    """
    hashes = Hashes()
    parsed = []
    for r in benchmark.select(F.col(item_id).alias("item"), F.col(text).alias("text")).toLocalIterator():
        words = (r.text or "").encode().lower().split()
        if words:
            k = min(n, len(words))
            parsed.append((r.item, k, len(words), shingles(np.array([hashes[w] for w in words], np.uint64), k)))
    df: dict[int, int] = defaultdict(int)
    for _, _, _, bag in parsed:
        for g in np.unique(bag).tolist():
            df[g] += 1
    for at in range(0, len(parsed), most):
        yield prepare(parsed[at:at + most], n, len(parsed), df)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, n: int = 5, doc_id="doc_id", text="text", **items) -> DataFrame:
    """``doc_id, item_id, similarity, start``: for each row and item it leaks, the best window.

    A text shorter than the item is one window. Null and empty texts leak nothing, repeated rows and
    repeated items are reported each. Nothing is shuffled: items go to the documents, in blocks.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("start", pa.int64())])
    out = None
    for block in item_blocks(benchmark, n, **items):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            hashes, it = Hashes(), shared.value
            for batch in small(batches):
                found = [(doc, it.ids[t], s, at) for doc, body in zip(batch.column(0).to_pylist(), utf8(batch.column(1)))
                         for t, s, at in leaks(body.lower().split(), it, hashes, least)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

        part = rows.mapInArrow(run, "doc_id long, item_id long, similarity double, start long")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], "doc_id long, item_id long, similarity double, start long") if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, n: int = 5, text="text", **items) -> DataFrame:
    """The rows of ``docs`` that leak no item, all columns as they are."""
    at = docs.columns.index(text)
    for block in item_blocks(benchmark, n, **items):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            hashes = Hashes()
            for batch in small(batches):
                bodies = [b or b"" for b in utf8(batch.column(at))]
                yield batch.filter(pa.array([not leaks(b.lower().split(), shared.value, hashes, least) for b in bodies], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
