"""State that expires: what is said again after the horizon, and how many rows the state has."""

from __future__ import annotations

import datetime

import pyarrow as pa
import pyarrow.parquet as pq

from foliant.streaming import expiring

START = datetime.datetime(2024, 1, 1)


def played(spark, tmp_path, shape, days, mode):
    """The rows of a stream that reads one file a batch, and the largest and last number of rows of state."""
    for n, rows in enumerate(days):
        table = pa.table({"job": [r[0] for r in rows], "kind": [r[1] for r in rows], "ts": [START + datetime.timedelta(days=r[2]) for r in rows], "event_id": [r[3] for r in rows]}, schema=pa.schema([("job", pa.int64()), ("kind", pa.string()), ("ts", pa.timestamp("us", "UTC")), ("event_id", pa.int64())]))
        pq.write_table(table, tmp_path / f"{n:03}.parquet")
    own = expiring.expiring_session(spark)
    stream = own.readStream.schema("job long, kind string, ts timestamp, event_id long").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}")
    out, states = [], []
    query = shape(stream).writeStream.outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/_state").trigger(availableNow=True).foreachBatch(lambda df, n: out.extend(df.collect())).start()
    query.awaitTermination()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return out, states


def test_a_warning_is_said_again_after_its_horizon_and_leaves_the_state(spark, tmp_path):
    days = [[(1, "a", 0, 0), (1, "a", 0.5, 1), (2, "b", 0, 2)], [(1, "a", 2.9, 3), (3, "c", 3, 4)], [(1, "a", 3.1, 5), (1, "a", 3.2, 6)], *[[(100 + d, "x", d, d)] for d in range(4, 30)]]
    shape = lambda s: expiring.warnings_once(s.selectExpr("job AS item", "kind AS detail", "ts"), 3)
    out, states = played(spark, tmp_path, shape, days, "append")
    said = sorted((r.item, r.detail, (r.ts.replace(tzinfo=None) - START).total_seconds() / 86400) for r in out)
    assert [s for s in said if s[1] != "x"] == [(1, "a", 0.0), (1, "a", 3.1), (2, "b", 0.0), (3, "c", 3.0)] and len(said) == 4 + 26
    # Thirty warnings were said; those of the last days are held, with their timers.
    assert max(states) <= 24 and states[-1] <= 16


def test_silent_jobs_leave_the_state(spark, tmp_path):
    days = [[(1, "start", 0, 1), (2, "start", 0, 2)], [(1, "end", 1, 4), (1, "middle", 1, 3)], *[[(100 + d, "x", d, 10 + d)] for d in range(2, 25)], [(2, "again", 25, 99)]]
    shape = lambda s: expiring.newest_progress(s.selectExpr("job", "ts", "event_id", "kind AS stage", "event_id % 10 AS index", "8 AS count", "0.5D AS done"), 2)
    out, states = played(spark, tmp_path, shape, days, "update")
    newest = {r.job: (r.event_id, r.stage, r.overall) for r in out}
    assert newest[1] == (4, "end", 0.5625) and newest[2] == (99, "again", 1.0) and len(newest) == 25
    assert states[-1] <= 16


def test_python_is_called_for_buckets_and_not_for_keys(spark, tmp_path):
    days = [[(k, f'"{k % 3}\\', d * 1.75 + k / 86400, k) for k in range(2000)] + [(None, None, d * 1.75, 0)] for d in range(3)]
    shape = lambda s: expiring.warnings_once(s.selectExpr("job AS item", "kind AS detail", "ts"), 3)
    out, states = played(spark, tmp_path, shape, days, "append")
    said = sorted(((r.item is None, r.item, r.detail), (r.ts.replace(tzinfo=None) - START).total_seconds() / 86400) for r in out if r.item is not None)
    assert len(said) == 4000 and [round(d - k[1] / 86400, 6) for k, d in said] == [0, 3.5] * 2000 and all(k[2] == f'"{k[1] % 3}\\' for k, _ in said)
    assert sorted((r.detail, r.ts.replace(tzinfo=None) - START) for r in out if r.item is None) == [(None, datetime.timedelta(0)), (None, datetime.timedelta(days=3.5))]
    # Rows of state are those of buckets, with their timers.
    assert max(states) <= 3 * expiring.BUCKETS
