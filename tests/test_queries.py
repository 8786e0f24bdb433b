"""Every query with SQL against DuckDB on the smallest tables; the others run and have a schema."""

import os

import duckdb
import pytest

from millrace.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(repr, frame.where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, db, name):
    got = catalogue.queries()[name](spark, SF)
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert got.count() >= 0 and got.columns
    else:
        assert rows(got.toPandas()) == rows(db.sql(sql).df())


def test_filters_keep_a_row_for_every_text(spark, tmp_path):
    texts = [(1, None), (2, ""), (3, "a"), (4, "The quick brown fox jumps over the lazy dog, and it comes back.")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("filter_repetition", "quality_gate"):
        got = catalogue.queries()[name](spark, str(tmp_path)).collect()
        assert {r.doc_id: r.kept for r in got} == {1: False, 2: False, 3: False, 4: True}, name
