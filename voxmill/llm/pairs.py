"""N-gram Jaccard join by chosen paths.

Texts with the same words are one class. A class is the set of its 128 MinHash tokens; in a run,
every node of a tree picks tokens at random, about one over the threshold of them, and sends each
set to the children of its values. Small nodes are compared outright, crowded ones split again.
Runs repeat until a pair at the threshold is missed with at most the stated probability. What the
tokens leave possible is then verified on whole shingle sets: candidates that hang together meet
once, in tiles, and exact links and their number come from there.
"""

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm.graph import components
from voxmill.llm.leaks import shingles
from voxmill.llm.shared import Hashes, keyed, small, stored, utf8

TOKENS = 128
TILE = 512
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(1, 1 << 32, TOKENS, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, TOKENS, dtype=np.uint32)
_M = (1 << 64) - 1


def shingle_set(words: list[bytes], n: int, hashes: Hashes) -> np.ndarray:
    """Distinct hashes of ``n`` consecutive words; fewer words are one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(shingles(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)), min(n, len(words))))


def minhash(s: np.ndarray) -> np.ndarray:
    out = np.full(TOKENS, 0xFFFFFFFF, np.uint32)
    h = (s >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(h), 2048):
        out = np.minimum(out, (h[at:at + 2048, None] * _A + _B).min(0))
    return out


def _mix(x: int) -> int:
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _M
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _M
    return x ^ (x >> 31)


def children(path: int, tokens: list[int], least: float) -> list[int]:
    """The node's chosen places, the same for all sets there, and so the set's children."""
    out, bound = [], int(2 ** 64 / (least * TOKENS))
    # gaps between places chosen with equal chance
    state, place = _mix(path & _M), -1
    while True:
        state = _mix(state + 0x9E3779B97F4A7C15 & _M)
        place += 1 + int(math.log((state + 1) / 2.0 ** 64) / math.log(1 - bound / 2.0 ** 64))
        if place >= TOKENS:
            return out
        out.append(_mix(path * 31 + place * 0x9E3779B97F4A7C15 + tokens[place] & _M) - (1 << 63))


_CLASS = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("tokens", pa.binary())])
_BODY = pa.schema([("c1", pa.int64()), ("c2", pa.int64()), ("body", pa.binary())])
_PATH = pa.schema([("path", pa.int64()), ("c1", pa.int64())])
_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("path", pa.int64())])
_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def _words(text: bytes) -> list[bytes]:
    return text.lower().split()


def _class(words: list[bytes]) -> tuple[int, int]:
    d = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
    return int.from_bytes(d[:8], signed=True), int.from_bytes(d[8:], signed=True)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def _classes(rows: DataFrame, n: int) -> DataFrame:
    """``key, doc_id, c1, c2, tokens``; a text without words has no tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in small(batches):
            out = []
            for key, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2))):
                words = _words(text)
                out.append((key, doc, *_class(words), minhash(shingle_set(words, n, hashes)).tobytes() if words else None))
            yield _batch(out, _CLASS)

    return rows.select("key", "doc_id", "text").mapInArrow(run, "key long, doc_id long, c1 long, c2 long, tokens binary")


def _bodies(rows: DataFrame) -> DataFrame:
    """``c1, c2, body``: compressed words of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(3)
        for batch in small(batches):
            yield _batch([(*_class(w), z.compress(b" ".join(w))) for w in map(_words, utf8(batch.column(0))) if w], _BODY)

    return rows.select("text").mapInArrow(run, "c1 long, c2 long, body binary")


def _split(sets: DataFrame, least: float) -> DataFrame:
    """``path, c1`` a level deeper, from ``path, c1, tokens``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 4096):
            out = []
            for path, c, tokens in zip(*[x.to_pylist() for x in batch.columns]):
                t = np.frombuffer(tokens, np.uint32).tolist()
                out += [(p, c) for p in children(path, t, least)]
            yield _batch(out, _PATH)

    return sets.select("path", "c1", "tokens").mapInArrow(run, "path long, c1 long")


def _compare(buckets: DataFrame, maybe: float, sure: float, most: int | None = None) -> DataFrame:
    """A forest of edges ``a, b`` over the sets of each bucket, from ``path, c1, marks`` sorted by path.

    A set is compared with all leaders of its bucket, belongs with each that shares ``maybe`` of the
    tokens and leads itself unless one shares ``sure``: whatever is near it then belongs with that
    leader too. Only leaders are held, so a bucket of many close sets passes through, and only links
    that join what was apart come out, fewer than the bucket has sets. With ``most``, a bucket has so many
    leaders at most; sets that none of them is sure of come out as ``a, null, path`` and have yet to meet each other.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, names, marks, part = None, [], np.empty((64, TOKENS), np.uint8), np.zeros(64, np.int64)
        for batch in small(batches, 4096):
            out = []
            for p, c, m in zip(*[x.to_pylist() for x in batch.columns]):
                m = np.frombuffer(m, np.uint8)
                if p != path:
                    path, names = p, []
                    if len(marks) > 4096:
                        marks, part = np.empty((64, TOKENS), np.uint8), np.zeros(64, np.int64)
                count = len(names)
                share = (marks[:count] == m).sum(1)
                close = np.flatnonzero(share >= maybe * TOKENS)
                parts, at = np.unique(part[close], return_index=True)
                out += [(names[i], c, None) for i in close[at].tolist() if names[i] != c]
                if len(parts) > 1:
                    part[:count][np.isin(part[:count], parts)] = parts[0]
                if not count or share.max() < sure * TOKENS:
                    if count == most:
                        out.append((c, None, p))
                        continue
                    if count == len(marks):
                        marks, part = np.concatenate([marks, np.empty_like(marks)]), np.concatenate([part, np.zeros_like(part)])
                    marks[count], part[count] = m, parts[0] if len(parts) else count
                    names.append(c)
            if out:
                yield _batch(out, _EDGE)

    return buckets.select("path", "c1", "marks").mapInArrow(run, "a long, b long, path long")


def _runs(levels: int, missed: float) -> int:
    """Runs until a pair that is split so many levels deep is missed with at most this chance.

    A pair at the threshold lives on for a level as a branching process of mean 1 does: 0.63, 0.47
    for two levels, 0.37 for three, 0.31 for four.
    """
    alive = 1.0
    for _ in range(levels):
        alive = 1 - math.exp(-alive)
    return math.ceil(math.log(missed) / math.log(1 - alive))


def candidates(sets: DataFrame, least: float = 0.8, missed: float = 1e-4, crowd: int = 256, depth: int = 4) -> DataFrame:
    """Edges ``a, b`` from stored ``c1, tokens``: every pair at ``least`` hangs together but for the chance ``missed``.

    All sets take part in the runs that pairs split two levels deep at most need. In a crowded node sets meet
    a bounded number of leaders; those that a leader is sure of, and the leaders, have then met all that is near them
    there, and the others are split again. These take part in further runs, as many as the deepest level needs. A pair
    that was ever split so deep has both its sets there. Either way of missing a pair has half the chance.
    """
    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # beside a leader that shares 0.8 a partner at 0.8 shares 0.6 or more; both leave room for chance
    maybe, sure = 2 * least - 1 - 0.12, least + 0.08
    leaves, deeper, edges = [], [], []

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 4096):
            short = [np.frombuffer(t, np.uint8)[::4].tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(short, pa.binary())], names=["c1", "marks"])

    short = stored(sets.select("c1", "tokens").mapInArrow(marks, "c1 long, marks binary"), "marks")

    def meet(rows: DataFrame, most: int | None = None) -> DataFrame:
        rows = rows.select("path", "c1").join(short, "c1").repartition(n, "path").sortWithinPartitions("path", "c1")
        return _compare(rows, maybe, sure, most)

    def descend(some: DataFrame, runs: range) -> None:
        roots = F.explode(F.array(*[F.lit(_mix(r + 1) - (1 << 63)) for r in runs]))
        level = _split(some.select(roots.alias("path"), "c1", "tokens"), least)
        for deep in range(1, depth + 1):
            counts = level.groupBy("path").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
            level = stored(level.join(counts, "path"), "paths")
            crowded = level.filter(F.col("size") > crowd)
            if deep == depth or crowded.isEmpty():
                leaves.append(level.select("path", "c1"))
                break
            leaves.append(level.filter(F.col("size") <= crowd).select("path", "c1"))
            met = stored(meet(crowded, crowd), "met")
            edges.append(met.filter("b IS NOT NULL").select("a", "b"))
            apart = met.filter("b IS NULL").select("path", F.col("a").alias("c1"))
            if deep == 2:
                deeper.append(apart.select("c1"))
            level = _split(apart.join(sets, "c1"), least)

    first, last = _runs(min(depth, 2), missed / 2), _runs(depth, missed / 2)
    descend(sets, range(first))
    if deeper:
        descend(sets.join(stored(deeper[0].distinct(), "deeper"), "c1", "left_semi"), range(first, last))
    rows = leaves[0]
    for more in leaves[1:]:
        rows = rows.unionByName(more)
    found = meet(rows).select("a", "b")
    for more in edges:
        found = found.unionByName(more)
    return found


def _tiles(groups: DataFrame, n: int, least: float) -> DataFrame:
    """Exact links of each tile: ``a, null, links`` for every set with links and ``a, b, null`` for a forest of them.

    Rows ``label, i, j, c1, body`` come sorted by tile; a tile is two blocks of a component (or one twice).
    """
    def solve(i: int, j: int, rows: list) -> Iterator[tuple]:
        z, hashes = zstandard.ZstdDecompressor(), Hashes()
        sets = [shingle_set(z.decompress(body).split(), n, hashes) for _, _, body in rows]
        size = np.array([len(s) for s in sets])
        left = np.array([b == i for b, _, _ in rows])
        right = left if i == j else ~left
        x, y = np.flatnonzero(left), np.flatnonzero(right)
        where = np.repeat(np.arange(len(rows)), size)
        names, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = times[at] > 1
        names, at = np.unique(at[shared], return_inverse=True)
        where = where[shared]
        order = np.argsort(at, kind="stable")
        at, where = at[order], where[order]
        both = np.zeros((len(x), len(y)), np.float32)
        for lo in range(0, len(names), 4096):
            s, e = np.searchsorted(at, [lo, lo + 4096])
            m = np.zeros((len(rows), min(4096, len(names) - lo)), np.float32)
            m[where[s:e], at[s:e] - lo] = 1
            both += m[x] @ m[y].T
        union = size[x][:, None] + size[y][None, :] - both
        linked = both >= least * union - 1e-6
        if i == j:
            np.fill_diagonal(linked, False)
        total = np.zeros(len(rows), np.int64)
        np.add.at(total, x, linked.sum(1))
        if i != j:
            np.add.at(total, y, linked.sum(0))
        root = list(range(len(rows)))

        def find(u):
            while root[u] != u:
                root[u] = u = root[root[u]]
            return u

        for u, v in zip(*np.nonzero(linked)):
            a, b = find(int(x[u])), find(int(y[v]))
            if a != b:
                root[max(a, b)] = min(a, b)
                yield rows[x[u]][1], rows[y[v]][1], None
        for u in np.flatnonzero(total).tolist():
            yield rows[u][1], None, int(total[u])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, rows = None, []
        for batch in small(batches, 1024):
            out = []
            for label, i, j, block, c, body in zip(*[x.to_pylist() for x in batch.columns]):
                if (label, i, j) != tile:
                    if len(rows) > 1:
                        out += solve(*tile[1:], rows)
                    tile, rows = (label, i, j), []
                rows.append((block, c, body))
            if out:
                yield _batch(out, _LINK)
        if len(rows) > 1:
            yield _batch(list(solve(*tile[1:], rows)), _LINK)

    return groups.select("label", "i", "j", "block", "c1", "body").mapInArrow(run, "a long, b long, n long")


def _linked(rows: DataFrame, n: int, least: float, missed: float) -> tuple[DataFrame, DataFrame]:
    """Stored ``key, doc_id, c1, c2, label, links`` of every row, label null for sets without links."""
    spark = rows.sparkSession
    members = stored(_classes(rows, n), "members")
    sets = stored(members.filter("tokens is not null").groupBy("c1", "c2").agg(F.min("tokens").alias("tokens")).select("c1", "tokens"), "sets")
    labels = stored(components(candidates(sets, least, missed)).select(F.col("node").alias("c1"), "label"), "labels")
    crowds = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    # a component of more than a tile meets in all pairs of blocks; a block's rows go to each of its tiles
    blocks = F.ceil(F.col("size") / TILE).cast("int")
    block = F.pmod(F.xxhash64("c1"), F.col("blocks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j")))
    tiles = labels.join(crowds, "label").withColumn("blocks", blocks).withColumn("block", block).withColumn("t", F.explode(others))
    # grouped by what it is joined on, so the words move once
    bodies = _bodies(rows).groupBy("c1").agg(F.min("body").alias("body"))
    tiles = tiles.select("label", "t.i", "t.j", "block", "c1").join(bodies, "c1")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = stored(_tiles(tiles.repartition(parts, "label", "i", "j").sortWithinPartitions("label", "i", "j"), n, least), "links")
    links = found.filter("b is null").groupBy("a").agg(F.sum("n").alias("links"))
    groups = components(found.filter("b is not null").select("a", "b"))
    per_set = stored(groups.join(links.withColumnRenamed("a", "node"), "node").withColumnRenamed("node", "c1"), "groups")
    return members, per_set


def jaccard_groups(docs: DataFrame, least: float = 0.8, n: int = 5, missed: float = 1e-4, doc_id="doc_id", text="text") -> DataFrame:
    """``doc_id, class_id, n_links, group_id`` for every row.

    ``class_id`` is the least id with the same words (A-Z in lower case, any white space), ``n_links``
    how many other classes have a Jaccard similarity of ``least`` or more over distinct ``n``-word
    shingles, ``group_id`` the least id that links reach. Fewer than ``n`` words are one shingle; texts
    without words, null or empty, are one class without links. Null ids never are the least unless a
    class or group has no other.
    """
    rows = keyed(docs, doc_id, text).withColumn("doc_id", F.col("doc_id").cast("long"))
    members, per_set = _linked(rows, n, least, missed)
    classes = members.groupBy("c1", "c2").agg(F.min("doc_id").alias("class_id")).join(per_set, "c1", "left")
    classes = stored(classes, "classes")
    groups = classes.filter("label is not null").groupBy("label").agg(F.min("class_id").alias("least_id"))
    classes = classes.join(groups, "label", "left").select("c1", "c2", "class_id", F.coalesce("links", F.lit(0)).alias("n_links"),
                                                           F.when(F.col("label").isNull(), F.col("class_id")).otherwise(F.col("least_id")).alias("group_id"))
    return members.select("doc_id", "c1", "c2").join(classes, ["c1", "c2"]).select("doc_id", "class_id", "n_links", "group_id")


def keep_one(docs: DataFrame, least: float = 0.8, n: int = 5, missed: float = 1e-4, doc_id="doc_id", text="text") -> DataFrame:
    """The rows of ``docs``, all columns as they are and whatever their names, one of each group: that of the least id, then the first.

    Null, empty and blank texts have no words and are one group; a null id is least only among null ids. Repeated rows are one group."""
    rows = stored(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("key")), "rows")
    plain = rows.select("key", F.col("row")[doc_id].cast("long").alias("doc_id"), F.coalesce(F.col("row")[text], F.lit("")).alias("text"))
    members, per_set = _linked(plain, n, least, missed)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "key")).alias("first")
    classes = members.groupBy("c1", "c2").agg(first).join(per_set.select("c1", "label"), "c1", "left")
    kept = classes.groupBy(F.coalesce("label", F.xxhash64("c1", "c2")).alias("g"), F.col("label").isNull().alias("alone")).agg(F.min("first").alias("first"))
    rows = rows.join(kept.select(F.col("first.key").alias("key")), "key", "left_semi")
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns])
