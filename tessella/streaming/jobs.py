"""Incremental operators on Structured Streaming: job status, job logs, ingestion."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..functions.constants import LOG_ENTRIES
from ..operators.store import Store


def _with_rocksdb(events: DataFrame) -> DataFrame:
    """Keyed state lives in RocksDB, which writes only what a batch changes; other stores have no map state."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return events


def latest_status(events: DataFrame, job: str = "job_id", ts: str = "updated_at") -> DataFrame:
    """The newest event of each job, for update or complete mode; the state is one row a job."""
    rest = [c for c in events.columns if c not in (job, ts)]
    return events.groupBy(job).agg(F.max_by(F.struct(*rest), ts).alias("status"), F.max(ts).alias(ts)).select(job, "status.*", ts)


class _MergeStatus(StatefulProcessor):
    """Map state of key to value and time; of each key the latest writer stays, whatever the order of arrival."""

    def init(self, handle) -> None:
        self.keys = handle.getMapState("keys", "key string", "value string, ts double, seq long")
        self.seen = handle.getValueState("seen", "ts double, seq long, reset_ts double, reset_seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last: tuple[float, int] = (float("-inf"), -1)
        reset = last
        if self.seen.exists():
            a, b, c, d = self.seen.get()
            last, reset = (a, b), (c, d)
        before = reset
        # What a batch says of a key is folded first: one read and one write of the state for each key.
        new: dict[str, tuple[tuple[float, int], str | None]] = {}
        for frame in rows:
            for ts, seq, begins, entries in zip(frame["ts"], frame["seq"], frame["begins"], frame["entries"]):
                at = (float(ts), int(seq))
                last = max(last, at)
                if begins:
                    reset = max(reset, at)
                for e in entries:
                    if e["key"] not in new or at >= new[e["key"]][0]:
                        new[e["key"]] = (at, e["value"])
        for k, (at, value) in new.items():
            if at >= reset:
                old = self.keys.getValue((k,)) if self.keys.containsKey((k,)) else None
                if old is None or at >= (old[1], old[2]):
                    self.keys.updateValue((k,), (value, *at))
        status = {k[0]: v for k, v in self.keys.iterator()}
        if reset > before:
            for k in [k for k, v in status.items() if (v[1], v[2]) < reset]:
                self.keys.removeKey((k,))
                del status[k]
        self.seen.update((*last, *reset))
        shown = {k: status[k][0] for k in sorted(status)}
        yield pd.DataFrame({"job": [key[0]], "status": [shown], "ts": [last[0]], "stage": [shown.get("stage")]})

    def close(self) -> None:
        pass


def merged_status(events: DataFrame, job: str = "job_id", ts: str = "updated_at", seq: str = "seq", extra: str = "extra", reset: str = "reset") -> DataFrame:
    """T-1. The stream's form of ``summaries.merged_status``: a row for each job that a batch changes, with all its keys.

    The latest writer of a key is the one of greatest (time, sequence), so that the
    last row of each job equals the batch result. State is a row for each job and key,
    and only the keys that a batch sets are written. An event older than the last
    reset sets nothing. For update mode.
    """
    events = _with_rocksdb(events)
    own = [F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in ("stage", "message")]
    of_extra = F.coalesce(F.map_entries(extra), F.array().cast("array<struct<key:string,value:string>>"))
    entries = F.concat(F.array(*own), of_extra)  # what stands later in an event wins
    narrow = events.select(F.col(job).cast("string").alias("job"), F.col(ts).cast("double").alias("ts"), F.col(seq).cast("long").alias("seq"), F.coalesce(reset, F.lit(False)).alias("begins"), entries.alias("entries"))
    return narrow.groupBy("job").transformWithStateInPandas(_MergeStatus(), "job string, status map<string,string>, ts double, stage string", "Update", "None").select(F.col("job").alias(job), "status", F.col("ts").alias(ts), "stage")


class _RingLog(StatefulProcessor):
    """Map state of slot to entry: a new entry overwrites the one that is ``cap`` entries older."""

    def __init__(self, cap: int) -> None:
        self.cap = cap

    def init(self, handle) -> None:
        self.ring = handle.getMapState("ring", "slot int", "ts double, level string, message string, data string")
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n = self.count.get()[0] if self.count.exists() else 0
        frame = pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable")
        before, n = n, n + len(frame)
        kept = frame.tail(self.cap)
        text = lambda v: None if pd.isna(v) else str(v)
        for at, row in enumerate(zip(kept["ts"], kept["level"], kept["message"], kept["data"]), n - len(kept)):
            self.ring.updateValue((at % self.cap,), (float(row[0]), *map(text, row[1:])))
        self.count.update((n,))
        first = self.ring.getValue((n % self.cap if n > self.cap else 0,))
        last = self.ring.getValue(((n - 1) % self.cap,))
        yield pd.DataFrame({"job": [key[0]], "appended": [n - before], "entries": [min(n, self.cap)], "first_ts": [first[0]], "last_message": [last[2]]})

    def close(self) -> None:
        pass


def capped_log(events: DataFrame, job: str, ts: str, message: str, cap: int = LOG_ENTRIES, level: str | None = None, data: str | None = None, seq: str | None = None) -> DataFrame:
    """T-2. The last ``cap`` entries of each job, in order of arrival, and of time within a batch.

    The state is a ring of ``cap`` slots in RocksDB: a batch writes its own entries
    and no others. The rows say what a batch did to each job; ``log_entries`` reads the entries. For
    update mode.
    """
    events = _with_rocksdb(events)
    given = lambda c, kind: (F.col(c) if c else F.lit(None)).cast(kind)
    narrow = events.select(
        F.col(job).cast("string").alias("job"), F.col(ts).cast("double").alias("ts"), F.coalesce(given(seq, "long"), F.lit(0)).alias("seq"), given(level, "string").alias("level"), F.col(message).cast("string").alias("message"), given(data, "string").alias("data")
    )
    return narrow.groupBy("job").transformWithStateInPandas(_RingLog(cap), "job string, appended long, entries long, first_ts double, last_message string", "Update", "None").withColumnRenamed("job", job)


def log_entries(spark: SparkSession, checkpoint: str, tail: int = 200, cap: int = LOG_ENTRIES, job: str = "job_id") -> DataFrame:
    """The last ``tail`` entries of each job with their place, oldest first, from the checkpoint of a query over ``capped_log``."""
    state = lambda name: spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    ring = state("ring").select(F.col("key.job").alias("job"), F.col("user_map_key.slot").alias("slot"), "user_map_value.*")
    count = state("count").select(F.col("key.job").alias("job"), F.col("value.n").alias("n"))
    # The newest entry is in slot (n - 1) % cap; counted back from there, each has an age.
    age = F.pmod(F.col("n") - 1 - F.col("slot"), F.lit(cap))
    found = ring.join(count, "job").withColumn("place", F.least(F.col("n"), F.lit(cap)) - age).where((age < tail) & (F.col("place") > 0))
    return found.select(F.col("job").alias(job), "place", "ts", "level", "message", "data")


def stage_counts(events: DataFrame, ts: str = "ts", stage: str = "stage", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """T-4, T-6. Progress events of each stage in windows of event time."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), stage).agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), stage, "events")


def ingest_stream(spark: SparkSession, folder: str, schema: str, store: Store, prepare, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """T-4, T-5, T-7. New files of a folder into the store; ids are hashes, so a batch that runs again changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        store.upsert_chunks(prepare(batch))

    stream = spark.readStream.schema(schema).parquet(folder)
    out = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=interval) if interval else out.trigger(availableNow=True)).start()
