"""A Merkle manifest of a table: blocks of aligned subtrees, each stored in van Emde Boas order.

A tree over ordered leaves is cut into subtrees of ``height`` levels. Each is one row of a block
table: its nodes laid out by halves, the top half of the levels first, then the bottom subtrees
from left to right, and so on within each. Node addresses are arithmetic, both where a block is
built and where siblings are read, and the roots of blocks are the leaves of the next tier. No
task holds more than one block; leaves are numbered from sizes of sorted partitions.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxmill.llm.shared import stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def address(levels: int, depth: int, index):
    """Place of node ``index`` at ``depth`` in a complete tree of so many levels; ``index`` may be an array."""
    place = 0
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
            continue
        depth, levels = depth - top, levels - top
        place = place + (2 ** top - 1) + (index >> depth) * (2 ** levels - 1)
        index = index & (2 ** depth - 1)
    return place


def combined(parts: list[bytes]) -> bytes:
    """The digest of a node above ``parts``, which go in as lower-case hexadecimal text."""
    return hashlib.sha256("".join(p.hex() for p in parts).encode()).digest()


def leaf_digest(values: dict[str, Column]) -> Column:
    """sha256 over the values, each ``-`` where null, else byte count, ``:``, value."""
    texts = [v.cast("string") for v in values.values()]
    parts = [F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def _levels(n: int, height: int) -> int:
    """Levels above the leaves of a block in a tier of ``n`` nodes."""
    return min(height, (n - 1).bit_length())


def _laid_out(leaves: list[bytes], up: int) -> bytes:
    """Nodes of one block in van Emde Boas order; places without a node are zeros."""
    nodes = np.zeros((2 ** (up + 1) - 1, 32), np.uint8)
    row = leaves
    for depth in range(up, -1, -1):
        nodes[address(up + 1, depth, np.arange(len(row)))] = np.frombuffer(b"".join(row), np.uint8).reshape(-1, 32)
        if depth:
            row = [combined(row[i:i + 2]) for i in range(0, len(row), 2)]
    return nodes.tobytes()


def _paths(nodes: bytes, count: int, upper: bytes) -> list[bytes]:
    """For each leaf of a block its siblings from below: 0 (none), or 1 (left) or 2 (right) and the digest."""
    levels = (len(nodes) // 32 + 1).bit_length() - 1
    found = [[] for _ in range(count)]
    for depth in range(levels - 1, 0, -1):
        down = levels - 1 - depth
        width = -(-count // 2 ** down)
        places = address(levels, depth, np.arange(width)) * 32
        row = [nodes[p:p + 32] for p in places.tolist()]
        for leaf, path in enumerate(found):
            other = (leaf >> down) ^ 1
            path.append(b"\0" if other >= width else (b"\1" if other & 1 == 0 else b"\2") + row[other])
    return [b"".join(p) + upper for p in found]


def siblings(path: bytes) -> Iterator[tuple[int, bytes]]:
    """``side, digest`` from the leaf up; side 0 has no digest."""
    at = 0
    while at < len(path):
        side = path[at]
        yield side, path[at + 1:at + 33] if side else b""
        at += 33 if side else 1


def proof_digest(path: bytes) -> str:
    """sha256 over the siblings' digests, level by level."""
    return hashlib.sha256("".join(d.hex() for side, d in siblings(path) if side).encode()).hexdigest()


def folded(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf leads to with these siblings."""
    for side, other in siblings(path):
        leaf = combined([other, leaf] if side == 1 else [leaf, other] if side == 2 else [leaf])
    return leaf


def ranked(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, the place within ``tree`` (never null) by ``order``, and ``n``, the tree's rows.

    Rows are range partitioned by tree, order and a last column that tells equal rows apart, so one
    tree may hold most of them. Places are counted in the task, and one row for each partition and tree in it
    is summed up to where the partition's rows begin.
    """
    at = rows.columns.index(tree)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            names = batch.column(at).dictionary_encode()
            codes = names.indices.to_numpy()
            cuts = np.flatnonzero(np.diff(codes)) + 1
            places = np.empty(len(codes), np.int64)
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(codes)]):
                if b > a:
                    name = names.dictionary[int(codes[a])].as_py()
                    seen = seen if name == last else 0
                    places[a:b] = np.arange(seen, seen + b - a)
                    last, seen = name, seen + b - a
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places)], names=[*batch.schema.names, "place"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    spread = rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
    placed = stored(spread.mapInArrow(number, f"{kinds}, place long").withColumn("part", F.spark_partition_id()), "places")
    sizes = placed.groupBy(tree, "part").agg(F.count("*").alias("size"))
    before = Window.partitionBy(tree).orderBy("part")
    starts = sizes.select(tree, "part", (F.sum("size").over(before) - F.col("size")).alias("start"),
                          F.sum("size").over(Window.partitionBy(tree)).alias("n"))
    return placed.join(starts, [tree, "part"]).withColumn("pos", F.col("start") + F.col("place")).drop("place", "start", "part")


def build(leaves: DataFrame, height: int = 12) -> list[DataFrame]:
    """Block tables, lowest tier first, of ``leaves`` (tree, pos, n, digest): ``tree, n, block, count, nodes``.

    A tier's blocks are the leaves of the next. The last tier has one block a tree, whose first node is the root.
    """
    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        n = int(pdf["n"].iloc[0])
        return pd.DataFrame({"tree": [pdf["tree"].iloc[0]], "n": [n], "block": [int(pdf["pos"].iloc[0]) >> height],
                             "count": [len(pdf)], "nodes": [_laid_out([bytes(d) for d in pdf["digest"]], _levels(n, height))]})

    tiers, most = [], leaves.agg(F.max("n")).first()[0] or 0
    while most:
        row = leaves.select("tree", "n", "pos", "digest")
        blocks = row.groupBy("tree", F.shiftright("pos", height)).applyInPandas(block, "tree string, n long, block long, count long, nodes binary")
        tiers.append(stored(blocks, "blocks"))
        if most <= 2 ** height:
            break
        most = -(-most // 2 ** height)
        leaves = tiers[-1].select("tree", F.expr(f"shiftright(n + {2 ** height - 1}, {height})").alias("n"),
                                  F.col("block").alias("pos"), F.col("nodes").substr(1, 32).alias("digest"))
    return tiers


def roots(tiers: list[DataFrame]) -> DataFrame:
    """``tree, digest``: the root of each tree."""
    return tiers[-1].select("tree", F.col("nodes").substr(1, 32).alias("digest"))


def block_paths(tiers: list[DataFrame], upper: DataFrame, height: int = 12) -> DataFrame:
    """The lowest tier's blocks with ``path``, the siblings above them; ``upper`` has those above each tree's root."""
    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                paths = _paths(r.nodes, r.count_, r.path)
                yield pd.DataFrame({"tree": r.tree, "block": (r.block << height) + np.arange(r.count_), "path": paths})

    above = upper.select("tree", F.lit(0).cast("long").alias("block"), "path")
    for blocks in reversed(tiers[1:]):
        known = blocks.join(above, ["tree", "block"]).select("tree", "block", F.col("count").alias("count_"), "nodes", "path")
        above = known.mapInPandas(leaves, "tree string, block long, path binary")
    return tiers[0].join(above, ["tree", "block"])


def manifest(docs: DataFrame, presented: dict[str, Column] | None = None, fields=FIELDS, tree: str = "lang",
             order: str = "doc_id", height: int = 12) -> DataFrame:
    """Every row's leaf, subroot and root, the digest of its proof, and whether what is presented verifies.

    A leaf is the digest of ``fields``; the leaves of each value of ``tree`` ascend by ``order``, nulls first,
    equal ones by digest; every two consecutive nodes (an odd last one alone) become one until one is left.
    Those subroots, by value of ``tree``, nulls first, bytewise, likewise give the root. ``presented`` replaces
    columns of the rows that are verified: ``folded_root`` is what such a leaf leads to with the manifest's
    siblings, ``verified`` whether that is the root.

    Nulls are values of their own; repeated rows are a leaf each, and equal leaves may change places. A
    table without rows has no leaves and gives no rows. Other columns are not read.
    """
    own = {c: F.col(c) for c in fields}
    shown = leaf_digest(own | (presented or {})) if presented else F.lit(None).cast("binary")
    name = F.col(tree).cast("string")
    leaves = stored(docs.select(F.monotonically_increasing_id().alias("key"), F.when(name.isNull(), "").otherwise(F.concat(F.lit("="), name)).alias("tree"),
                                F.col(order).alias("doc_id"), leaf_digest(own).alias("digest"), shown.alias("shown")), "leaves")
    placed = stored(ranked(leaves, "tree", ["doc_id", "digest", "key"]), "ranked")
    tiers = build(placed, height)
    if not tiers:
        return placed.select("doc_id", *[F.lit("").alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")],
                             F.lit(True).alias("verified"))
    tops = ranked(roots(tiers).select(F.lit("").alias("all"), F.col("tree").alias("name"), F.col("digest")), "all", ["name"])
    tops = stored(tops.select(F.col("all").alias("tree"), "n", "pos", "name", "digest"), "subroots")
    top_tiers = build(tops, height)
    root = roots(top_tiers).select("tree", F.col("digest").alias("root"))
    start = root.select("tree", F.lit(b"").alias("path"))
    above = block_paths(top_tiers, start, height).select("tree", "block", "nodes", "path")
    above = _proved(tops.select("tree", "pos", "name", "digest"), above, height)
    known = above.join(root, "tree").select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "root", "path")
    blocks = block_paths(tiers, known, height).join(known.select("tree", "subroot", "root"), "tree")

    def verify(rows: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        at = block.iloc[0]
        paths = _paths(at["nodes"], int(at["count"]), at["path"])
        out = {c: [] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")}
        for doc, pos, leaf, shown in zip(rows["doc_id"], rows["pos"], rows["digest"], rows["shown"]):
            path = paths[pos & (2 ** height - 1)]
            end = folded(bytes(leaf if shown is None else shown), path)
            for c, v in zip(out, (doc, bytes(leaf).hex(), at["subroot"].hex(), at["root"].hex(), proof_digest(path), end.hex(), end == at["root"])):
                out[c].append(v)
        return pd.DataFrame(out, dtype=object)

    kind = docs.schema[order].dataType.simpleString()
    left = placed.select("tree", F.shiftright("pos", height).alias("block"), "pos", F.col("doc_id"), "digest", "shown")
    return left.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInPandas(
        verify, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def _proved(rows: DataFrame, blocks: DataFrame, height: int) -> DataFrame:
    """``rows`` (tree, pos, name, digest) with ``path``, their siblings up to the root."""
    def prove(part: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        at = block.iloc[0]
        paths = _paths(at["nodes"], len(part), at["path"])
        return part.assign(path=[paths[p & (2 ** height - 1)] for p in part["pos"]])[["tree", "name", "digest", "path"]]

    left = rows.withColumn("block", F.shiftright("pos", height))
    return left.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInPandas(
        prove, "tree string, name string, digest binary, path binary")
