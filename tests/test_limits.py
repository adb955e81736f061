"""Rows that a lower limit would lose."""

from __future__ import annotations

from datetime import datetime, timedelta

from eventloom.plans.joins import jn14


def test_greedy_match_takes_sixteen_candidates(spark, tmp_path):
    at = datetime(2024, 1, 1)
    views = [(i, 7, "view", at) for i in range(12)]
    clicks = [(100 + i, 7, "click", at + timedelta(seconds=60 * i)) for i in range(12)]
    spark.createDataFrame(views + clicks, "event_id long, user_id long, event_type string, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    got = [(r.lid, r.rid, r.cost) for r in jn14(spark, str(tmp_path)).collect()]
    assert sorted(got) == [(i, 100 + i, 60.0 * i) for i in range(12)]
