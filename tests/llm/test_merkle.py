"""The Merkle manifest beside a plain one, over every awkward row and several block heights."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from voxmill.llm import merkle
from voxmill.llm.shared import remainder


def H(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row) -> str:
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(row: list[str]) -> list[list[str]]:
    out = [row]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][i:i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def way(tree, i):
    found = []
    for row in tree[:-1]:
        found.append((i ^ 1 < i, row[i ^ 1] if i ^ 1 < len(row) else ""))
        i //= 2
    return found


def plain(rows):
    """rows of (doc_id, source, lang, n_chars, text) -> sorted results."""
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for lang in langs:
        trees[lang].sort(key=lambda r: (cases.order(r[0]), leaf(r)))
    built = {lang: levels([leaf(r) for r in trees[lang]]) for lang in langs}
    top = levels([built[x][-1][0] for x in langs])
    out = []
    for k, lang in enumerate(langs):
        for i, r in enumerate(trees[lang]):
            up = way(built[lang], i) + way(top, k)
            given = r if r[0] is None or r[3] is None or cases.crc(r[0]) % 7 else r[:3] + (r[3] + 1,) + r[4:]
            end = leaf(given)
            for left, h in up:
                end = H(h + end if left else end + h)
            out.append((r[0], leaf(r), built[lang][-1][0], top[-1][0], H("".join(h for _, h in up)), end, end == top[-1][0]))
    return sorted(out, key=str)


def found(spark, rows, height):
    schema = "doc_id long, source string, lang string, n_chars long, text string, tree string, key long, pos string, n int, leaf string"
    docs = spark.createDataFrame([(*r, "clash", 7, "clash", 7, "clash") for r in rows], schema)
    tampered = F.when(F.col("doc_id").isNotNull() & (remainder("doc_id", 7) == 0), F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return sorted((tuple(r) for r in merkle.manifest(docs, {"n_chars": tampered}, height=height).collect()), key=str)


@pytest.mark.parametrize("height", [1, 2, 3, 12])
def test_against_plain(spark, height):
    rows = [(i, s, lang, None if t is None else len(t), t) for (i, t, s), lang in
            zip(cases.made(), ["en"] * 9 + ["fr", "", None, "é", "de", "en"] + ["en"] * 100)]
    rows += [(7_000 + i, None, "many", i, None) for i in range(33)]  # one row more than 2 ** 5
    assert found(spark, rows, height) == plain(rows)


def test_small_tables(spark):
    assert found(spark, [], 12) == []
    one = [(1, "s", None, 3, "abc")]
    (got,) = found(spark, one, 12)
    assert got[1] == got[2] == got[3] == leaf(one[0]) and got[4] == H("") and got == plain(one)[0]


def test_one_hot_row(spark):
    rows = [(5, "s", "en", 1, "x")] * 300 + [(i, "s", "en", 1, "x") for i in range(20)]
    assert found(spark, rows, 3) == plain(rows)


def test_any_change_is_seen(spark):
    rows = [(i, "s", f"l{i % 3}", 1, f"t{i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    for field in ("text", "source"):
        other = F.when(F.col("doc_id") == 11, F.lit("")).otherwise(F.col(field))
        got = merkle.manifest(docs, {field: other}, height=2).filter("not verified").collect()
        assert [r.doc_id for r in got] == [11]


@pytest.mark.parametrize("levels", range(1, 14))
def test_addresses_are_places(levels):
    places = np.concatenate([np.atleast_1d(merkle.address(levels, d, np.arange(2 ** d))) for d in range(levels)])
    assert sorted(places.tolist()) == list(range(2 ** levels - 1))


def test_subtrees_are_contiguous():
    """Of 8 levels the lower 4 of each node of depth 4 stand together: 15 places."""
    for sub in range(16):
        places = [int(merkle.address(8, 4 + d, (sub << d) + i)) for d in range(4) for i in range(2 ** d)]
        assert max(places) - min(places) == 14
