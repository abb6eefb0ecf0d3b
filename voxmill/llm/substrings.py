"""Substring dedup: repeats of whole word windows, by suffix trees over partitions of the suffixes.

A suffix belongs to the partition of its anchor, the least gram hash in its first ``window`` words;
equal windows have equal anchors, so no repeat is split. A gram that anchors only once in the corpus
has no inner node at that depth and its suffixes go no further. The others are cut out with their
words, equal surroundings are combined before the shuffle, and each partition builds its subtree as
sorted suffixes with the lengths of their common prefixes: inner nodes of ``window`` words or more
are its repeats. Partitions too large for memory take longer prefixes, up to the whole window.
Texts are split and hashed once; what is needed later is stored beside them.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm.shared import Hashes, small, stored, utf8

GRAM = 6
BITS = 48
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(words: list[bytes], hashes: Hashes, k: int = GRAM) -> np.ndarray:
    """One hash for each ``k`` consecutive words."""
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    g = h[:len(h) - k + 1].copy()
    for i in range(1, k):
        g = (g ^ (g >> np.uint64(31))) * _MULTIPLIER + h[i:len(h) - k + 1 + i]
    g ^= g >> np.uint64(29)
    g *= _MULTIPLIER
    return g >> np.uint64(64 - BITS)


def anchors(words: list[bytes], hashes: Hashes, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``gram, position, first window, last window`` of every anchor; each window has one."""
    if len(words) < window:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    g = gram_hashes(words, hashes)
    views = np.lib.stride_tricks.sliding_window_view(g, window - GRAM + 1)
    at = np.arange(len(views)) + views.argmin(1)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.append(first[1:], len(at)) - 1
    return g[at[first]].astype(np.int64), at[first], first, last


def _pack(position: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Position, and 8 bits each of the words before it and of the windows after the first."""
    return (position << 16) | ((position - first) << 8) | (last - first)


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, mark, text``; mark is a hash of id and text, which tells rows of one id apart; a null id is the least."""
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.withColumn("mark", F.xxhash64("doc_id", "text"))


_READ = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("body", pa.binary()), ("grams", pa.binary()), ("packed", pa.binary())])
_READ_SCHEMA = "doc_id long, mark long, body binary, grams binary, packed binary"
_ANCHOR = pa.schema([("gram", pa.int64()), ("key", pa.int64()), ("packed", pa.int64())])
_COUNT = pa.schema([("gram", pa.int64()), ("n", pa.int64())])
_PIECE = pa.schema([("gram", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("key", pa.int64()), ("doc_id", pa.int64()), ("mark", pa.int64()),
                    ("packed", pa.int64()), ("n", pa.int64()), ("words", pa.binary())])
_PIECE_SCHEMA = "gram long, c1 long, c2 long, key long, doc_id long, mark long, packed long, n long, words binary"
_FOUND = pa.schema([("c1", pa.int64()), ("c2", pa.int64()), ("repeated", pa.int64()), ("own", pa.int64()), ("first_mark", pa.int64()), ("first_packed", pa.int64())])
_FOUND_SCHEMA = "c1 long, c2 long, repeated long, own long, first_mark long, first_packed long"


def read_texts(rows: DataFrame, window: int) -> DataFrame:
    """``doc_id, mark``, the text compressed, and the grams and places of its anchors as 64-bit numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, z = Hashes(), zstandard.ZstdCompressor(3)
        for batch in small(batches):
            bodies, grams, packed = [], [], []
            for text in utf8(batch.column(2)):
                gram, position, first, last = anchors(text.split(), hashes, window)
                bodies.append(z.compress(text))
                grams.append(gram.tobytes())
                packed.append(_pack(position, first, last).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, pa.binary()) for c in (bodies, grams, packed)]], schema=_READ)

    return rows.select("doc_id", "mark", "text").mapInArrow(run, _READ_SCHEMA)


def _anchor_rows(texts: DataFrame) -> DataFrame:
    """``gram, key, packed``: one row an anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            grams, packed = (batch.column(i).to_pylist() for i in (1, 2))
            n = np.array([len(g) // 8 for g in grams])
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(grams), np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), n)),
                                              pa.array(np.frombuffer(b"".join(packed), np.int64))], schema=_ANCHOR)

    return texts.select("key", "grams", "packed").mapInArrow(run, "gram long, key long, packed long")


def _gram_counts(texts: DataFrame, held: int = 1_000_000) -> DataFrame:
    """``gram, n`` anchors, combined in the task first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0

        def flush():
            gram, n = np.unique(np.frombuffer(b"".join(kept), np.int64), return_counts=True)
            for at in range(0, len(gram), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(gram[at:at + 100_000]), pa.array(n[at:at + 100_000])], schema=_COUNT)

        for batch in small(batches):
            kept += batch.column(0).to_pylist()
            size = sum(map(len, kept)) // 8
            if size > held:
                yield from flush()
                kept, size = [], 0
        if kept:
            yield from flush()

    return texts.select("grams").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _wanted(texts: DataFrame) -> DataFrame:
    """``key, places``: the anchors (gram, packed) of each row whose gram anchors again.

    Grams that are a thousandth of all anchors or more, so a thousand at most, are broadcast with a number, and
    their anchors are dealt out by their place instead."""
    counts = stored(_gram_counts(texts).filter("n > 1"), "grams")
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * 1000 >= total
    hot = stored(counts.filter(often).select("gram", F.monotonically_increasing_id().alias("hot")), "hot")
    rows = _anchor_rows(texts).join(F.broadcast(hot), "gram", "left")
    rows = rows.select("key", "packed", "hot", F.when(F.col("hot").isNotNull(), F.xxhash64("key", "packed")).otherwise(F.col("gram")).alias("by"))
    rare = counts.filter(~often).select(F.col("gram").alias("by"), F.lit(True).alias("again"))
    rows = rows.join(rare, "by", "left").filter("hot IS NOT NULL OR again")
    rows = rows.join(F.broadcast(hot), "hot", "left").select("key", F.coalesce("gram", "by").alias("gram"), "packed")
    return rows.groupBy("key").agg(F.collect_list(F.struct("gram", "packed")).alias("places"))


def _pieces(joined: DataFrame, window: int, held: int = 100_000) -> DataFrame:
    """Occurrences (``words`` null) and, combined in the task, their surroundings (of the first occurrence, ``n`` in all)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        seen: dict[tuple, list] = {}

        def flush():
            rows = [(*k, None, *v) for k, v in seen.items()]
            for at in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at:at + 10_000]), _PIECE)], schema=_PIECE)

        for batch in small(batches, 128):
            out = []
            places = batch.column(4)
            ends = np.concatenate([[0], np.cumsum(places.value_lengths().to_numpy())]).tolist()
            flat = places.flatten()
            grams, packs = (flat.field(i).to_pylist() for i in range(2))
            for key, doc, mark, body, lo, hi in zip(*[batch.column(i).to_pylist() for i in range(4)], ends, ends[1:]):
                words = z.decompress(body).split()
                for gram, p in zip(grams[lo:hi], packs[lo:hi]):
                    before, more = p >> 8 & 0xFF, p & 0xFF
                    first = (p >> 16) - before
                    piece = b" ".join(words[first:first + more + window])
                    d = hashlib.blake2b(piece + b"\0%d" % before, digest_size=16).digest()
                    c1, c2 = int.from_bytes(d[:8], signed=True), int.from_bytes(d[8:], signed=True)
                    out.append((None, c1, c2, key, None, mark, p, 1, None))
                    now = seen.get((gram, c1, c2))
                    if now is None:
                        seen[gram, c1, c2] = [doc, mark, p, 1, piece]
                    else:
                        now[3] += 1
                        if _order(doc, mark, p) < _order(*now[:3]):
                            now[:3] = doc, mark, p
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PIECE)], schema=_PIECE)
            if len(seen) > held:
                yield from flush()
                seen.clear()
        if seen:
            yield from flush()

    return joined.select("key", "doc_id", "mark", "body", "places").mapInArrow(run, _PIECE_SCHEMA)


def _order(doc: int, mark: int, packed: int) -> tuple:
    """Earlier is less: by id, then rows of one id by mark, then by position."""
    return doc, mark, packed >> 16


def common_words(a: bytes, b: bytes) -> int:
    """How many words two suffixes begin with alike; each word has a space behind it, the last one too."""
    if a == b:
        return a.count(b" ")
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:  # the longest common run of bytes
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    return a[:lo].count(b" ")


def inner_nodes(suffixes: list[tuple[bytes, int]], depth: int) -> Iterator[list[int]]:
    """The numbers of the suffixes below each topmost inner node of ``depth`` words or more; leaves stand alone.

    Sorted suffixes and the common prefixes of neighbours are the tree in its array form: where neighbours
    have fewer words in common, the path between them goes above that depth.
    """
    suffixes.sort()
    run: list[int] = []
    for i, (words, number) in enumerate(suffixes):
        if run and common_words(suffixes[i - 1][0], words) < depth:
            yield run
            run = []
        run.append(number)
    if run:
        yield run


def _subtrees(contexts: DataFrame, window: int) -> DataFrame:
    """For each surroundings, which of its windows repeat, which of them come first here, and its first occurrence.

    Rows come sorted by partition; a partition is held only while its rows pass.
    """
    def solve(rows: dict) -> Iterator[tuple]:
        """rows: (c1, c2) -> [doc, mark, packed, n, words]"""
        names = list(rows)
        suffixes, where = [], []
        for c, (_, _, packed, _, words) in rows.items():
            start = 0
            for j in range((packed & 0xFF) + 1):
                # suffixes of one partition that start at other distances from the anchor never match
                suffixes.append((b"%d %b " % ((packed >> 8 & 0xFF) - j, words[start:]), len(where)))
                where.append((c, j))
                start = words.find(b" ", start) + 1
        repeated, own = dict.fromkeys(names, 0), dict.fromkeys(names, 0)
        for node in inner_nodes(suffixes, window + 1):
            if len(node) == 1 and rows[where[node[0]][0]][3] == 1:
                continue
            c, j = where[min(node, key=lambda i: _order(*rows[where[i][0]][:3]))]
            own[c] |= 1 << j
            for i in node:
                repeated[where[i][0]] |= 1 << where[i][1]
        for c in names:
            if repeated[c]:
                yield *c, repeated[c], own[c], *rows[c][1:3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, rows, out = None, {}, []

        def batch_of(found):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), _FOUND)], schema=_FOUND)

        for batch in small(batches, 4096):
            for g, c1, c2, _, doc, mark, packed, n, words in zip(*[c.to_pylist() for c in batch.columns]):
                if g != gram:
                    out += solve(rows)
                    gram, rows = g, {}
                now = rows.get((c1, c2))
                if now is None:
                    rows[c1, c2] = [doc, mark, packed, n, words]
                else:
                    now[3] += n
                    if _order(doc, mark, packed) < _order(*now[:3]):
                        now[:3] = doc, mark, packed
            if len(out) >= 5000:
                yield batch_of(out)
                out = []
        out += solve(rows)
        if out:
            yield batch_of(out)

    return contexts.mapInArrow(run, _FOUND_SCHEMA)


def _crowded(contexts: DataFrame, window: int) -> DataFrame:
    """The same for partitions too large for memory: the prefix is the whole window, so a group is one node, combined before the shuffle."""
    n = F.col("packed").bitwiseAND(0xFF).cast("int")
    before = F.shiftright("packed", 8).bitwiseAND(0xFF).cast("int")
    place = [F.shiftright("packed", 16).alias("p"), "packed"]
    contexts = contexts.groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "mark", *place)).alias("f"), F.sum("n").alias("n"), F.min("words").alias("words"))
    contexts = contexts.select("c1", "c2", "n", "f.doc_id", "f.mark", "f.packed", F.split(F.decode("words", "UTF-8"), " ").alias("w"))
    each = contexts.withColumn("j", F.explode(F.sequence(F.lit(0), n)))
    text = F.array_join(F.slice("w", F.col("j") + 1, window), " ")
    each = each.withColumn("s", F.struct(F.xxhash64(before - F.col("j"), text).alias("a"), F.sha1(text.cast("binary")).alias("b"))).drop("w")
    node = each.groupBy("s").agg(F.sum("n").alias("all"), F.min(F.struct("doc_id", "mark", place[0], "c1", "c2")).alias("f")).filter(F.col("all") > 1)
    each = each.drop("n").join(node, "s")
    bit = F.expr("shiftleft(1L, j)")
    mine = (F.col("f.c1") == F.col("c1")) & (F.col("f.c2") == F.col("c2"))
    return each.groupBy("c1", "c2").agg(F.bit_or(bit).alias("repeated"), F.bit_or(F.when(mine, bit).otherwise(F.lit(0).cast("long"))).alias("own"),
                                        F.min("mark").alias("first_mark"), F.min("packed").alias("first_packed"))


def repeats(texts: DataFrame, window: int = 20, crowd_bytes: int = 16 << 20) -> DataFrame:
    """``key, hits``: from ``read_texts``, the starts of windows whose words also start earlier, by row.

    Earlier is a smaller id or an earlier start; rows of one id but other texts are ordered by a mark of
    both, rows that repeat both are one document, a null id (given as the least long) comes first.
    ``window`` may be up to 63 words. Partitions with more than ``crowd_bytes`` of words take the whole window as their prefix.
    """
    pieces = stored(_pieces(texts.select("key", "doc_id", "mark", "body").join(_wanted(texts), "key"), window), "pieces")
    contexts = pieces.filter("words is not null")
    size = F.sum(F.length("words").cast("long") * (F.col("packed").bitwiseAND(0xFF) + 1) + 200)
    heavy = stored(contexts.groupBy("gram").agg(size.alias("size")).filter(F.col("size") > crowd_bytes).select("gram"), "crowded")
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = _subtrees(contexts.join(heavy, "gram", "left_anti").repartition(n, "gram").sortWithinPartitions("gram"), window)
    found = found.unionByName(_crowded(contexts.join(heavy, "gram", "left_semi"), window))
    hits = pieces.filter("words is null").select("c1", "c2", "key", "mark", "packed").join(found, ["c1", "c2"])
    start = F.shiftright("packed", 16) - F.shiftright("packed", 8).bitwiseAND(0xFF)
    here = (F.col("mark") == F.col("first_mark")) & (F.shiftright("packed", 16) == F.shiftright("first_packed", 16))
    gone = F.col("repeated").bitwiseAND(F.when(here, F.bitwise_not("own")).otherwise(F.lit(-1).cast("long")))
    hits = hits.select("key", start.alias("start"), gone.alias("gone")).filter("gone <> 0")
    return hits.groupBy("key").agg(F.collect_list(F.struct("start", "gone")).alias("hits"))


def drop_repeats(docs: DataFrame, window: int = 20, doc_id="doc_id", text="text", **rule) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` for every row; kept words are joined by one space.

    Words covered by a window that also starts earlier go; windows are judged on the input. Null texts
    have no words, and texts of fewer words than a window keep them all. Rows that repeat id and text
    are one document and get the same.
    """
    texts = stored(read_texts(_rows(docs, doc_id, text), window).withColumn("key", F.monotonically_increasing_id()), "texts")
    rows = texts.select("key", "doc_id", "body").join(repeats(texts, window, **rule), "key", "left").select("doc_id", "body", "hits.start", "hits.gone")
    out_schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for batch in small(batches, 128):
            out = []
            for doc, body, starts, masks in zip(*[c.to_pylist() for c in batch.columns]):
                words = z.decompress(body).split()
                keep = np.ones(len(words), bool)
                for s, m in zip(starts or (), masks or ()):
                    for j in range(64):
                        if m >> j & 1:
                            keep[s + j:s + j + window] = False
                kept = [w for w, k in zip(words, keep.tolist()) if k] if starts else words
                out.append((None if doc == -(1 << 63) else doc, len(words), len(words) - len(kept), b" ".join(kept).decode()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), out_schema)] if out else
                                             [pa.array([], f.type) for f in out_schema], schema=out_schema)

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")
