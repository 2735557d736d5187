from __future__ import annotations

from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import pytest

import corpus_pipeline
from groundwell.llm import common
from groundwell.session import scratch, settle, shared_folder
from tests.llm.test_pipeline import SCHEMA, corpus


def folders(spark):
    folder = Path(shared_folder(spark))
    return {p.name for p in folder.iterdir()} if folder.is_dir() else set()


def test_settled_tables_go_with_the_block_unless_lasting(spark):
    before = folders(spark)
    with scratch(spark):
        settle(spark.range(5), "outer")
        with pytest.raises(ValueError), scratch(spark):
            settle(spark.range(5), "inner")
            raise ValueError
        assert sorted(n.rpartition("-")[0] for n in folders(spark) - before) == ["outer"]
        kept = settle(spark.range(7), "kept", lasting=True)
    assert [n.rpartition("-")[0] for n in folders(spark) - before] == ["kept"]
    assert kept.count() == 7
    assert settle(spark.range(3), "plain").count() == 3
    assert len(folders(spark) - before) == 2


def test_stages_leave_only_what_their_results_rest_on(spark, tmp_path):
    rows, item = corpus(60)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(rows, SCHEMA)
    stages, want = dict(corpus_pipeline.STAGES), {"language": set(), "decontaminate": {"pipeline-dropped"}, "tokens": {"tokens"}}
    for name, lasting in want.items():
        before = folders(spark)
        got = stages[name](spark, docs, str(tmp_path))
        left = {n.rpartition("-")[0] for n in folders(spark) - before}
        assert {n for n in left if not n.startswith(("language-left-", "language-table-"))} == lasting
        assert got.count() > 0


def test_lean_tasks_drop_what_other_operators_kept(monkeypatch):
    monkeypatch.setattr(common, "_CACHES", [])
    one, two = (common.worker_cache(lru_cache(maxsize=1)(lambda path: [path])) for _ in range(2))
    mine, other = one("a"), two("a")

    def run(batches):
        assert one("a") is mine and two("a") is not other
        yield from batches

    batch = pa.RecordBatch.from_pydict({"x": [1]})
    assert list(common.lean(run, one)(iter([batch]))) == [batch]
