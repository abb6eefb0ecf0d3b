"""Registered queries beside their SQL, and the pipeline stage by stage, on the smallest tables."""

import os

import pytest

import corpus_pipeline
from tests.conftest import FOLDER
from tools.check_queries import rows_of
from voxmill.llm.catalog import CHECKS, QUERIES, table

duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, FOLDER)
    cols, got = rows_of(df.columns, df.collect())
    assert got or name == "op3_decontamination"
    if name not in CHECKS:
        return
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    cur = con.execute(CHECKS[name])
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert cols == want_cols and len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or isinstance(x, float) and abs(x - y) < 1e-6 for x, y in zip(a, b)), (a, b)


def test_pipeline(spark):
    from tests.llm import cases
    docs = table(spark, FOLDER, "documents")
    before = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "jaccard_join", "decontamination", "mixing"]
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER).cache()
        assert docs.columns == columns
        rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
        if name == "line_dedup":
            assert {r[0] for r in rows} == {r[0] for r in before} and all(len(r[1]) <= len(dict((a, b) for a, b, _ in before)[r[0]]) for r in rows)
        if name == "jaccard_join":
            assert sorted(r[0] for r in rows) == sorted({g for *_, g in cases.jaccard(before)})
        kept[name], before = len(rows), rows
    assert kept["jaccard_join"] < kept["line_dedup"] == kept["toxicity"]
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert {r.doc_id for r in mixed.collect()} <= {r[0] for r in before}
    assert corpus_pipeline.run(spark, FOLDER).count() > 0
