"""Requests that come after newer ones."""

from datetime import datetime, timedelta

from test_files_and_streams import stream_of

from tunetable.streaming import limits
from tunetable.streaming.runs import append_to_files


def test_late_requests_are_admitted_within_the_lateness(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(1, 7, t0, 0), (2, 7, t0 + timedelta(hours=1), 0), (3, 8, t0 + timedelta(hours=1, seconds=5), 1)]
    rows += [(4, 9, t0 + timedelta(minutes=20), 2)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, part int")
    seen = {}
    for lateness in ("10 minutes", "2 hours"):
        source = stream_of(spark, df, tmp_path / lateness[:2].strip(), 3)
        admitted = limits.first_hit_windows(source, "user_id", lateness=lateness)
        out = spark.read.schema(admitted.schema).parquet(append_to_files(admitted, "late"))
        seen[lateness] = {r.event_id for r in out.collect()}
    assert seen == {"10 minutes": {1, 2, 3}, "2 hours": {1, 2, 3, 4}}
