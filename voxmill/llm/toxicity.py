"""Toxicity by a factorization machine over hashed terms.

A text is the set of its terms and their leading characters, hashed to 32 bits. The machine's
``bias + sum w + 1/2 (|sum v|^2 - sum |v|^2)`` adds a weight for each feature and a learnt one for
each pair that meets. It is fitted on a bounded sample of labelled rows; scoring reads every row.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.llm.shared import keyed

TERM = re.compile(r"[^\W\d_]+")
LEADING = (4, 5, 6)
_FEATURES = pa.schema([("label", pa.int32()), ("features", pa.list_(pa.int64()))])
_SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def hashed(term: str) -> list[int]:
    """A term's features: itself and, where it is longer, its first 4, 5 and 6 characters."""
    names = [term] + [f"{term[:n]}\x00{n}" for n in LEADING if len(term) >= n]
    return [xxhash.xxh32_intdigest(x.encode()) for x in names]


def terms(text: str | None) -> set[str]:
    return set(TERM.findall((text or "").lower()))


@dataclass
class Machine:
    """``features`` sorted hashes; ``w`` their weights, ``v`` their factors."""

    features: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def score(self, at: np.ndarray) -> float:
        s = self.v[at].sum(0)
        z = self.bias + self.w[at].sum() + 0.5 * (s @ s - (self.v[at] ** 2).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def sample(docs: DataFrame, labels: DataFrame, learn: Column, positives: int, negatives: int) -> DataFrame:
    """``label, features`` of at most so many labelled rows of each label, those with the least hash of the id.

    Rows without id or label are left out. Only the ids are ranked and sent to all tasks.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & learn).select("doc_id", F.col("toxic").cast("int").alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [known.filter(F.col("label") == y).distinct().orderBy(*order).limit(n) for y, n in ((1, positives), (0, negatives))]
    rows = keyed(docs).select("doc_id", "text").join(F.broadcast(chosen[0].unionAll(chosen[1])), "doc_id").select("label", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted({h for t in terms(x) for h in hashed(t)}) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], schema=_FEATURES)

    return rows.mapInArrow(features, "label int, features array<long>")


def informative(ones: np.ndarray, zeros: np.ndarray, n1: int, n0: int, least: float, most: int) -> np.ndarray:
    """Sorted ids whose likelihood ratio against the label is ``least`` or more, the ``most`` greatest.

    ``ones`` and ``zeros`` hold the ids of all rows of either label, each row's ids once.
    """
    found = [np.unique(x, return_counts=True) for x in (ones, zeros)]
    names = np.union1d(found[0][0], found[1][0])
    a, b = np.zeros(len(names)), np.zeros(len(names))
    for x, (ids, n) in zip((a, b), found):
        x[np.searchsorted(names, ids)] = n
    n1, n0 = max(n1, 1), max(n0, 1)
    q = (a + b) / (n1 + n0)

    def part(x, n):
        p = x / n
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log(p / q), 0) + np.where(x < n, (n - x) * np.log((1 - p) / (1 - q)), 0)

    g = 2 * (part(a, n1) + part(b, n0))
    best = np.lexsort((names, -g))[:most]
    return np.sort(names[best[g[best] >= least]])


def fit(rows: DataFrame, factors: int = 8, least: float = 11.0, most: int = 20_000, epochs: int = 80, rate: float = 0.2,
        penalty: float = 1e-5, seed: int = 7) -> Machine:
    """Fit on the sample's rows, a bounded number, with AdaGrad on the logistic loss."""
    label, ids, row = [], [], []
    for batch in rows.toArrow().to_batches(max_chunksize=256):
        lists = batch.column(1)
        row.append(np.repeat(np.arange(len(label), len(label) + batch.num_rows, dtype=np.int32), lists.value_lengths().to_numpy(zero_copy_only=False)))
        ids.append(lists.flatten().to_numpy().astype(np.uint32))
        label += batch.column(0).to_pylist()
    label = np.array(label, np.float64)
    ids, row = np.concatenate(ids or [np.zeros(0, np.uint32)]), np.concatenate(row or [np.zeros(0, np.int32)])
    one = label[row] > 0
    features = informative(ids[one], ids[~one], int(label.sum()), int((1 - label).sum()), least, most)
    at = np.searchsorted(features, ids)
    held = np.zeros(len(ids), bool)
    if len(features):
        held = features[np.minimum(at, len(features) - 1)] == ids
    ids, row = at[held], row[held]
    del at, held, one
    bounds = np.searchsorted(row, np.arange(len(label) + 1))
    rng = np.random.default_rng(seed)
    share = min(max(label.mean() if len(label) else 0.0, 1e-3), 1 - 1e-3)
    m = Machine(features, float(np.log(share / (1 - share))), np.zeros(len(features)), rng.normal(0, 0.01, (len(features), factors)))
    gw, gv, gb = np.full(len(features), 1e-6), np.full(m.v.shape, 1e-6), 1e-6
    for _ in range(epochs if len(features) else 0):
        order = rng.permutation(len(label))
        for part in np.array_split(order, max(1, len(order) // 256)):
            n = bounds[part + 1] - bounds[part]
            at = np.concatenate([ids[bounds[i]:bounds[i + 1]] for i in part])
            of = np.repeat(np.arange(len(part)), n)
            v = m.v[at]
            s = np.zeros((len(part), factors))
            np.add.at(s, of, v)
            z = m.bias + np.bincount(of, m.w[at], len(part)) + 0.5 * ((s ** 2).sum(1) - np.bincount(of, (v ** 2).sum(1), len(part)))
            e = 1 / (1 + np.exp(-np.clip(z, -60, 60))) - label[part]
            used, back = np.unique(at, return_inverse=True)
            dw = np.bincount(back, e[of], len(used)) / len(part) + penalty * m.w[used]
            dv = np.zeros((len(used), factors))
            np.add.at(dv, back, e[of, None] * (s[of] - v))
            dv = dv / len(part) + penalty * m.v[used]
            gw[used] += dw ** 2
            gv[used] += dv ** 2
            gb += e.mean() ** 2
            m.w[used] -= rate * dw / np.sqrt(gw[used])
            m.v[used] -= 0.2 * rate * dv / np.sqrt(gv[used])
            m.bias -= 0.2 * rate * e.mean() / np.sqrt(gb)
    return m


class Known(dict):
    """term -> positions of its features in the machine, for terms met lately."""

    def __init__(self, machine: Machine, most: int = 400_000):
        self.machine, self.most = machine, most

    def __missing__(self, term):
        if len(self) >= self.most:
            self.clear()
        f, h = self.machine.features, np.array(hashed(term), np.uint32)
        found = self[term] = [int(i) for i, x in zip(np.searchsorted(f, h), h) if i < len(f) and f[i] == x]
        return found

    def score(self, text: str | None) -> float:
        at = {i for found in map(self.__getitem__, terms(text)) for i in found}
        return self.machine.score(np.array(sorted(at), np.int64))


def score(docs: DataFrame, machine: Machine, doc_id="doc_id", text="text") -> DataFrame:
    """``doc_id, score`` of every row, from its text alone; null and empty texts score as the bias."""
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(model.value)
        for batch in batches:
            scores = [known.score(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], schema=_SCORED)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, machine: Machine, threshold: float = 0.7, text="text") -> DataFrame:
    """The rows of ``docs`` that score below the threshold, all their columns as they are."""
    model = docs.sparkSession.sparkContext.broadcast(machine)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(model.value)
        for batch in batches:
            yield batch.filter(pa.array([known.score(x) < threshold for x in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
