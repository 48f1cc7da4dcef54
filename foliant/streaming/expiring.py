"""Streams whose state leaves again: newest progress and warnings said once, each within a horizon of event time.

Keys are dealt to a fixed number of buckets by hash, and Python is called once for each bucket that a batch
meets, not for each key. The state of a bucket is one row with all its keys, and a timer at the time from
which the oldest no longer counts. When the watermark passes the timer such keys go, and an empty bucket
with them, so the state holds the keys of the last days and not of all time. A batch rewrites the keys of
its buckets. Needs the RocksDB state store (`expiring_session`).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def expiring_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep their state in RocksDB."""
    own = spark.newSession()
    for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return own


DAY = 86_400_000_000


def _timer(micros: int) -> int:
    """Milliseconds that are not before a time in microseconds."""
    return -(-micros // 1000)


#: Buckets of a stream. Fixed, as the state of a running stream is kept by them.
BUCKETS = 256
_FORMATS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


class _Bucket(StatefulProcessor):
    """Keys of a bucket by name, each with a list of values, of which the first is the time that it was kept at."""

    def __init__(self, horizon: int) -> None:
        self.horizon = horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bucket", "kept string, timer long")

    def load(self) -> tuple[dict[str, list], int | None]:
        kept, timer = self.state.get() if self.state.exists() else ("{}", None)
        return json.loads(kept), timer

    def store(self, kept: dict[str, list], timer: int | None) -> None:
        """Keep what there is; ``timer``: the one that is set."""
        oldest = _timer(min(v[0] for v in kept.values()) + self.horizon) if kept else None
        if timer is not None and timer != oldest:
            self.handle.deleteTimer(timer)
        if oldest is None:
            self.state.clear()
            return
        self.state.update((json.dumps(kept), oldest))
        if timer != oldest:
            self.handle.registerTimer(oldest)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        kept, timer = self.load()
        fired, now = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        # The timer that fires leaves by itself.
        self.store({k: v for k, v in kept.items() if _timer(v[0] + self.horizon) > max(fired, now)}, None if timer == fired else timer)
        return iter(())

    def close(self) -> None:
        pass


class _Once(_Bucket):
    """Says a warning if it was not said within the horizon before."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept, timer = self.load()
        own, names, times = pd.concat([r[["name", "at"]] for r in rows]).astype({"at": "int64"}).sort_values("at"), [], []
        for name, at in zip(own["name"].tolist(), own["at"].tolist()):
            last = kept.get(name)
            if last is None or at >= last[0] + self.horizon:
                names.append(name)
                times.append(at)
                kept[name] = [at]
        if names:
            self.store(kept, timer)
            yield pd.DataFrame({"name": names, "at": times})


class _Newest(_Bucket):
    """Keeps the newest event of a job until the job has been silent for the horizon."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept, timer = self.load()
        own = pd.concat(list(rows)).astype({"at": "int64", "event_id": "int64"}).sort_values(["at", "event_id"], kind="stable").drop_duplicates("name", keep="last")
        out = []
        for name, *new in zip(*(own[c].tolist() for c in ("name", "at", "event_id", "stage", "overall"))):
            if name not in kept or new[:2] > kept[name][:2]:
                kept[name] = new
                out.append((name, *new[1:]))
        if out:
            self.store(kept, timer)
            yield pd.DataFrame(out, columns=["name", "event_id", "stage", "overall"])


def _named(events: DataFrame, keys: list[str]) -> tuple[Column, Column, Column]:
    """The name of a key as text, its bucket, and the key again from the column ``name``."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    name = F.to_json(F.struct(*keys), _FORMATS)
    return name.alias("name"), F.pmod(F.xxhash64(name), F.lit(BUCKETS)).alias("bucket"), F.from_json("name", ", ".join(f"`{k}` {kinds[k]}" for k in keys), _FORMATS)


def warnings_once(events: DataFrame, horizon_days: float, delay: str = "1 hour") -> DataFrame:
    """item, detail, ts: each warning (item, detail, ts), but not again within ``horizon_days`` of when it was last said.

    ``delay``: how late events may come. A warning is forgotten when the watermark has passed its
    horizon; with events in order of time the result does not depend on how they are cut into batches.
    """
    when = F.col("ts").cast("timestamp")
    name, bucket, back = _named(events, ["item", "detail"])
    grouped = events.select(name, bucket, when.alias("ts"), F.unix_micros(when).alias("at")).withWatermark("ts", delay).groupBy("bucket")
    said = grouped.transformWithStateInPandas(_Once(int(horizon_days * DAY)), "name string, at long", "Append", "EventTime")
    return said.select(back.alias("key"), "at").select("key.item", "key.detail", F.timestamp_micros("at").alias("ts"))


def newest_progress(events: DataFrame, horizon_days: float, delay: str = "1 hour") -> DataFrame:
    """job, event_id, stage, overall: whenever it changes, the newest event of a job, as ``latest_progress`` shows it.

    ``events``: job, ts, event_id, stage, index, count, done. A job that has been silent for
    ``horizon_days`` is forgotten, and begins anew if it is heard of again.
    """
    overall = F.round(F.least((F.col("index") + F.col("done")) / F.col("count"), F.lit(1.0)), 6).cast("double")
    when = F.col("ts").cast("timestamp")
    name, bucket, back = _named(events, ["job"])
    shaped = events.select(name, bucket, when.alias("ts"), F.unix_micros(when).alias("at"), F.col("event_id").cast("long").alias("event_id"), F.col("stage").cast("string").alias("stage"), overall.alias("overall"))
    grouped = shaped.withWatermark("ts", delay).groupBy("bucket")
    newest = grouped.transformWithStateInPandas(_Newest(int(horizon_days * DAY)), "name string, event_id long, stage string, overall double", "Update", "EventTime")
    return newest.select(back.alias("key"), "event_id", "stage", "overall").select("key.job", "event_id", "stage", "overall")
