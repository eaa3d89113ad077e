"""Versioned tables: replays, killed writes, compaction."""

import os

import pytest

from docsift.sources.versions import VersionedTable

SCHEMA = "doc_id bigint, text string"


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def as_dict(frame):
    found = frame.collect()
    assert len({r.doc_id for r in found}) == len(found)
    return {r.doc_id: r.text for r in found}


def test_batches_replays_and_compaction(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), SCHEMA)
    assert table.version() == 0 and table.read().count() == 0
    assert table.upsert(rows(spark, (1, "a"), (2, "b"), (2, "c"), (None, "z")), "one")
    assert as_dict(table.read()) == {1: "a", 2: "c"}
    assert table.upsert(rows(spark, (2, "new"), (3, None)), "two")
    for _ in range(2):  # a batch that comes again changes nothing
        assert not table.upsert(rows(spark, (1, "wrong")), "one")
        assert as_dict(table.read()) == {1: "a", 2: "new", 3: None}
    assert as_dict(table.read(1)) == {1: "a", 2: "c"}
    table.compact()
    table.compact()
    assert table.version() == 3 and as_dict(table.read()) == {1: "a", 2: "new", 3: None}
    assert not table.upsert(rows(spark, (1, "wrong")), "two")
    assert table.upsert(rows(spark, (1, "later")), "three") and as_dict(table.read())[1] == "later"
    assert [(r.version, r.kind, r.n) for r in table.manifest().orderBy("version").collect()] == [(1, "batch", 2), (2, "batch", 2), (3, "base", 3), (4, "batch", 1)]
    assert len(table.vacuum()) == 2 and table.vacuum() == []
    assert as_dict(table.read()) == {1: "later", 2: "new", 3: None}


def test_a_killed_write_leaves_the_table(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), SCHEMA)
    table.upsert(rows(spark, (1, "a")), "one")
    broken = rows(spark, (1, "half"), (2, "half"))
    broken.write.parquet(f"{table.path}/v-killed")  # data without its entry in the manifest
    assert as_dict(table.read()) == {1: "a"}
    with pytest.raises(Exception):
        table.upsert(broken.selectExpr("doc_id", "raise_error('lost') as text"), "two")
    assert as_dict(table.read()) == {1: "a"} and table.version() == 1
    assert table.upsert(broken, "two") and as_dict(table.read()) == {1: "half", 2: "half"}
    assert "v-killed" in table.vacuum() and not os.path.exists(f"{table.path}/v-killed")
    assert as_dict(table.read()) == {1: "half", 2: "half"}


def test_order_decides_within_a_batch(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), SCHEMA)
    batch = spark.createDataFrame([(1, "z", 1), (1, "a", 2), (1, "b", None)], SCHEMA + ", at int")
    table.upsert(batch, "one", order="at")
    assert as_dict(table.read()) == {1: "a"}
