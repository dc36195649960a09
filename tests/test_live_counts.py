"""Live counts against the records that a replay leaves."""

from __future__ import annotations

from compare import of_spark, of_sql

from docspark import workloads


def test_live_counts_equal_the_replayed_records(spark, sf_dir):
    replayed = workloads.ORACLE_SQL["replay_last_write_wins"]
    sql = f"SELECT collection, count(*) AS live FROM ({replayed}) GROUP BY 1"
    assert of_spark(workloads.QUERIES["live_counts"](spark, sf_dir)) == of_sql(sql, sf_dir)


def test_live_counts_forget_deleted_and_dropped_records(spark, tmp_path):
    rows = [(1, 1, "view"), (2, 6, "view"), (3, 6, "error"), (4, 2, "view"), (5, 7, "error"), (6, 7, "click"), (90, 3, "view"), (97, 3, "signup"), (98, 8, "view")]
    events = spark.createDataFrame([(*r, "{}") for r in rows], "event_id long, user_id long, event_type string, props string")
    events.write.parquet(str(tmp_path / "events.parquet"))
    found = workloads.QUERIES["live_counts"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in found) == [("c1", 1), ("c2", 2), ("c3", 1)]
