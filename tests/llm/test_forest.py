"""Vectors linked by the forest beside all pairs, and its parts."""

import math

import numpy as np
import pytest

from voxmill.llm import forest

NAN, INF = float("nan"), float("inf")


def cloud(seed, n, dims=24, groups=(), spread=0.02):
    """Random directions, and groups of vectors close to one of them."""
    rng = np.random.default_rng(seed)
    rows = [rng.standard_normal(dims) for _ in range(n)]
    for size in groups:
        middle = rng.standard_normal(dims)
        rows += [middle + spread * rng.standard_normal(dims) * math.sqrt(dims) * rng.random() for _ in range(size)]
    return [(i, [float(x) for x in v]) for i, v in enumerate(rows)]


def plain(rows, least=0.95):
    units = [None] * len(rows)
    for k, (_, v) in enumerate(rows):
        if v and None not in v and np.isfinite(v).all() and any(v):
            u = np.array(v) / np.abs(v).max()
            units[k] = u / math.sqrt(float(u @ u))
    near = {k: [j for j, o in enumerate(units) if j != k and o is not None and u is not None and len(o) == len(u) and float(o @ u) >= least] for k, u in enumerate(units)}
    seen, out = {}, []
    for k in near:
        if k not in seen:
            group, todo = {k}, [k]
            while todo:
                for j in near[todo.pop()]:
                    if j not in group:
                        group.add(j)
                        todo.append(j)
            first = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
            seen |= {j: first for j in group}
    for k, (i, _) in enumerate(rows):
        kept = i == seen[k] if i is not None and seen[k] is not None else not near[k]
        out.append((i, len(near[k]), seen[k], kept))
    return sorted(out, key=str)


def found(spark, rows, kind="double", **how):
    df = spark.createDataFrame([(i, v, 1, "x", "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, label int, leaf string, key string")
    return sorted((tuple(r) for r in forest.near_groups(df, **how).collect()), key=str)


AWKWARD = [(500, None), (501, []), (502, [0.0] * 24), (503, [1.0, None]), (504, [NAN, 1.0]), (505, [INF, 1.0]), (506, [3e200, 4e200]), (507, [3e-200, 4e-200]),
           (508, [3.0, 4.0]), (508, [3.0, 4.0]), (None, [3.0, 4.0]), (None, [1.0, 0.0, 0.0]), (None, [-5.0]), (None, [-5.0]), (509, [-0.0, 1.0]), (510, [0.0, 1.0])]


def test_one_leaf_is_exact(spark):
    rows = cloud(1, 150, groups=(40, 5)) + AWKWARD
    assert found(spark, rows) == plain(rows)


@pytest.mark.parametrize("seed,groups", [(2, (60, 30, 3, 2, 2)), (3, (200,))])
def test_many_leaves_balls_and_tiles(spark, seed, groups):
    """Small leaves: rounds of subtrees, crowds as balls, crowded leaves in tiles. Enough trees to miss nothing."""
    rows = cloud(seed, 400, groups=groups) + AWKWARD
    got = found(spark, rows, cap=24, trees=12, sample=200, levels=3, at_once=5)
    assert got == plain(rows)


def test_copies_and_single_precision(spark):
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in cloud(4, 60, groups=(20,))]
    rows += [(1000 + i, rows[3][1]) for i in range(200)] + [(2000 + i, rows[70][1]) for i in range(50)]
    assert found(spark, rows, kind="float") == plain(rows)
    assert found(spark, rows, kind="float", cap=16, trees=10, sample=60, levels=2) == plain(rows)


def test_empty_table(spark):
    assert found(spark, []) == [] and found(spark, [(3, None)]) == [(3, 0, 3, True)]


def test_overlap_keeps_near_pairs_together():
    """Pairs at cosine 0.95 survive a cut at the median as often as the number of trees assumes."""
    rng = np.random.default_rng(5)
    a = rng.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    other = rng.standard_normal(a.shape)
    other -= (other * a).sum(1, keepdims=True) * a
    b = 0.95 * a + math.sqrt(1 - 0.95 ** 2) * other / np.linalg.norm(other, axis=1, keepdims=True)
    kept = []
    for leaf in range(0, 40, 2):
        cuts = forest._fit(a, leaf, len(a), 2100, 1, 0.2)
        assert not np.isnan(cuts[1])
        ends = [[set() for _ in a] for _ in range(2)]
        for side, units in enumerate((a, b)):
            for r, p in zip(*forest._descend(units, leaf, cuts, 0.2)):
                ends[side][r].add(p)
        kept.append(np.mean([bool(x & y) for x, y in zip(*ends)]))
    assert np.mean(kept) >= forest.SURVIVES
    assert forest.trees_for(1000, 2048, 1e-4) == 1 and forest.trees_for(10 ** 9, 2048, 1e-4) > forest.trees_for(10 ** 5, 2048, 1e-4) >= 3
