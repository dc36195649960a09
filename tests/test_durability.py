"""Snapshots, change log and streams: what is written comes back, and only committed work counts."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException

from docspark.functions import validation
from docspark.operators import records
from docspark.sources import snapshots
from docspark.streaming import changes

RECORD = "collection string, id string, doc string"


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_versions_load_expire_and_back_up(spark, tmp_path):
    path = str(tmp_path / "users")
    for n in (1, 2, 3):
        assert snapshots.save(spark.range(n).toDF("id"), path) == n
    assert [snapshots.load(spark, path, v).count() for v in (1, 2, 3)] == [1, 2, 3]
    assert snapshots.backup(spark, path, str(tmp_path / "copy")) == 1
    snapshots.expire(spark, path, keep=1)
    assert snapshots.versions(spark, path) == [3] and snapshots.load(spark, path).count() == 3
    assert snapshots.load(spark, str(tmp_path / "copy")).count() == 3
    with pytest.raises(ValueError):
        snapshots.load(spark, path, 1)


def test_an_unfinished_version_is_neither_read_nor_touched(spark, tmp_path):
    path = tmp_path / "users"
    snapshots.save(spark.range(1).toDF("id"), str(path))
    (path / "v=2").mkdir()
    (path / "v=2" / "half").write_text("of another writer")
    assert snapshots.versions(spark, str(path)) == [1]
    assert snapshots.save(spark.range(5).toDF("id"), str(path)) == 3
    assert (path / "v=2" / "half").read_text() == "of another writer"
    assert snapshots.load(spark, str(path)).count() == 5


FRAMES = [
    (1, "t1", "begin", None, None, None, None),
    (2, "t1", "operation", "put", "users", "a", "{}"),
    (3, "t2", "begin", None, None, None, None),
    (4, "t2", "operation", "delete", "users", "old", None),
    (5, "t1", "operation", "put", "users", "b", '{"n":1}'),
    (6, "t1", "commit", None, None, None, None),
    (7, "t3", "operation", "put", "users", "no begin", "{}"),
    (8, "t3", "commit", None, None, None, None),
]


def test_recovery_applies_committed_transactions_only_and_twice_is_once(spark, tmp_path):
    log, base = str(tmp_path / "log"), str(tmp_path / "base")
    snapshots.save(spark.createDataFrame([("users", "old", "{}"), ("users", "a", '{"was":1}')], RECORD), base)
    snapshots.append_log(spark.createDataFrame(FRAMES[:5], snapshots.LOG_SCHEMA), log)
    before = snapshots.recovered(snapshots.load(spark, base), snapshots.read_log(spark, log))
    assert found(before) == [("users", "a", '{"was":1}'), ("users", "old", "{}")]
    snapshots.append_log(spark.createDataFrame(FRAMES[5:], snapshots.LOG_SCHEMA), log)
    after = snapshots.recovered(snapshots.load(spark, base), snapshots.read_log(spark, log))
    expected = [("users", "a", "{}"), ("users", "b", '{"n":1}'), ("users", "old", "{}")]
    assert found(after) == expected
    snapshots.save(after, base)  # a checkpoint; the log may be replayed once more
    assert found(snapshots.recovered(snapshots.load(spark, base), snapshots.read_log(spark, log))) == expected


def test_database_stats(spark, tmp_path):
    paths = {name: str(tmp_path / name) for name in ("users", "logs", "none")}
    snapshots.save(spark.range(3).toDF("id"), paths["users"])
    snapshots.save(spark.range(4).toDF("id"), paths["users"])
    snapshots.save(spark.range(2).toDF("id"), paths["logs"])
    row = snapshots.database_stats(spark, paths).collect()[0]
    assert (row.collections, row.records, row.versions) == (3, 6, 3) and row.bytes > 0
    assert snapshots.database_stats(spark, {}).collect()[0].records == 0


def test_changes_stream_into_the_last_operation_of_each_record(spark, tmp_path):
    log, checkpoint = str(tmp_path / "log"), str(tmp_path / "checkpoint")
    frames = [f for f in FRAMES if f[2] == "operation"] + [(9, "t4", "operation", "delete", "users", "a", None)]
    for part in (frames[:2], frames[2:]):
        snapshots.append_log(spark.createDataFrame(part, snapshots.LOG_SCHEMA), log)
    stream = changes.latest(changes.changes(spark, log)).writeStream.format("memory").queryName("last_operations")
    stream = stream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    assert stream.awaitTermination(60) and stream.exception() is None
    rows = {r.id: (r.last.op, r.seq) for r in spark.table("last_operations").collect()}
    assert rows == {"a": ("delete", 9), "b": ("put", 5), "old": ("delete", 4), "no begin": ("put", 7)}


def test_ids_and_documents_are_checked(spark):
    rows = [("a-1", "{}"), ("-x", "{}"), ("b", "[1]"), ("c", "{"), (None, "{}"), ("d", None)]
    df = spark.createDataFrame(rows, "id string, doc string")
    got = {(r.id, r.doc): r.fault for r in validation.faults(df).collect()}
    bad = {("-x", "{}"): "invalid record id", (None, "{}"): "invalid record id"}
    assert got == bad | {(i, d): "not a JSON object" for i, d in (("b", "[1]"), ("c", "{"), ("d", None))}
    assert found(validation.checked(df.where("id = 'a-1'"))) == [("a-1", "{}")]
    with pytest.raises(PySparkException):
        validation.checked(df).collect()


def test_ids_are_generated_where_there_are_none(spark):
    rows = records.with_ids(spark.createDataFrame([("x",), (None,), (None,)], "id string")).collect()
    assert rows[0].id == "x" and len({r.id for r in rows}) == 3 and len(rows[1].id) == 36


def test_an_id_twice_in_a_batch_fails(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    with pytest.raises(PySparkException, match="twice"):
        records.put(base, spark.createDataFrame([("c", 3), ("c", 4)], "id string, n int")).collect()
    patch = spark.createDataFrame([("a", ["n"], 3), ("a", ["n"], 4)], "id string, present array<string>, n int")
    with pytest.raises(PySparkException, match="twice"):
        records.update(base, patch).collect()
    assert found(records.put(base, spark.createDataFrame([("b", 5), ("c", 3)], "id string, n int"))) == [("a", 1), ("b", 5), ("c", 3)]
