"""Every query with SQL gives the same rows in DuckDB."""

import pytest

from quire.plans.catalog import ORACLE, QUERIES
from tests.compare import connection, rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, name):
    got, want = QUERIES[name](spark, SF), connection(SF).sql(ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    """Queries without SQL: rows for known documents only; their rules are tested in test_golden."""
    rows = QUERIES[name](spark, SF).collect()
    known = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert rows and {r.doc_id for r in rows} <= known


def test_units_cover_the_texts(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    at = {}
    for r in sorted(QUERIES["progressive_units"](spark, SF).collect(), key=lambda r: (r.doc_id, r.unit_no)):
        assert r.char_start == at.get(r.doc_id, 0) < r.char_end
        at[r.doc_id] = r.char_end
    assert at == {i: len(t) for i, t in texts.items() if t}
