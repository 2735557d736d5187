"""The registry itself; ``checks/compare.py`` compares every query with its SQL twin."""

import duckdb
import pytest

import __spark_entry__ as entry
from checks.compare import TABLES, rows_of

SF = "/root/testdata/sf0.001"
SAMPLE = ["code_tokens", "chunk_files", "dense_topk", "merge_evidence", "pack_context", "score_all", "repo_status", "merge_scores_onto_traces", "static_report", "unique_slug"]


def test_names_match():
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and len(names) > 140


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = entry.queries()[name](spark, SF)
    cursor = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
