"""Streams of trace events: logs, first sightings, sessions and running histories."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery


def event_stream(spark: SparkSession, path: str, schema, time: str = "ts", files_per_batch: int = 100) -> DataFrame:
    """Parquet files as they arrive; the time column becomes a timestamp, which watermarks need."""
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return read.withColumn(time, F.col(time).cast("timestamp"))


def appended(stream: DataFrame, path: str, checkpoint: str, fmt: str = "json", once: bool = True) -> StreamingQuery:
    """Appends to files, exactly once for each row; the checkpoint lets a later call go on where this one ended."""
    writer = stream.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def first_seen(stream: DataFrame, keys: list[str], time: str = "ts", delay: str = "1 day") -> DataFrame:
    """The first row of each key; keys are remembered for the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def sessions(stream: DataFrame, key: str, gap: str = "30 minutes", time: str = "ts", delay: str = "1 day") -> DataFrame:
    """(key, session_start, session_end, n): a session ends where nothing follows within the gap."""
    held = stream.withWatermark(time, delay).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return held.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def batch_sessions(events: DataFrame, key: str, gap_seconds: int = 1800, time: str = "ts") -> DataFrame:
    """The same over a table, by gaps and islands."""
    of = Window.partitionBy(key).orderBy(time)
    at = F.col(time).cast("timestamp")
    new = F.coalesce(F.unix_micros(at) - F.unix_micros(F.lag(at).over(of)) >= gap_seconds * 1_000_000, F.lit(True))
    numbered = events.select(key, time, new.cast("int").alias("_new")).withColumn("_session", F.sum("_new").over(of))
    return numbered.groupBy(key, "_session").agg(F.min(time).alias("session_start"), (F.max(time).cast("timestamp") + F.expr(f"make_dt_interval(0, 0, 0, {gap_seconds})")).cast("timestamp_ntz").alias("session_end"), F.count("*").alias("n")).drop("_session")


HISTORY = "run_id long, steps long, total_ms double, tools array<string>, latest array<string>, closed boolean"
#: Steps of a run that its history shows.
LATEST = 5


class RunHistory(StatefulProcessor):
    """What a run has done so far, in a value, a map and a list of state; a batch touches what it changes alone.

    The map counts each tool's steps, so it does not grow with the run, and only the tools of a batch are
    rewritten. With ``idle_ms`` a run closes once the watermark is so far behind its last event: its last row is
    marked and its state goes. With ``keep_ms`` tools and latest steps are forgotten so long after they were written.
    """

    def __init__(self, idle_ms: int | None = None, keep_ms: int | None = None) -> None:
        self.idle_ms, self.keep_ms = idle_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "steps long, total_ms double, last_ms long")
        self.tools = handle.getMapState("tools", "component string", "n long", self.keep_ms)
        self.latest = handle.getListState("latest", "component string", self.keep_ms)

    def _row(self, key: tuple, closed: bool) -> pd.DataFrame:
        steps, total, _ = self.totals.get()
        tools = sorted(name for (name,) in self.tools.keys())
        return pd.DataFrame({"run_id": [key[0]], "steps": [steps], "total_ms": [total], "tools": [tools], "latest": [[name for (name,) in self.latest.get()]], "closed": [closed]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        steps, total, last = self.totals.get() if self.totals.exists() else (0, 0.0, 0)
        latest = [name for (name,) in self.latest.get()] if self.latest.exists() else []
        for frame in rows:
            frame = frame.sort_values(["ts", "seq"])
            steps, total = steps + len(frame), total + float(frame["execution_time_ms"].sum())
            last = max(last, int(frame["ts"].max().timestamp() * 1000))
            latest = (latest + frame["component"].tolist())[-LATEST:]
            for name, n in frame["component"].value_counts().items():
                held = self.tools.getValue((name,))[0] if self.tools.containsKey((name,)) else 0
                self.tools.updateValue((name,), (int(held + n),))
        self.totals.update((steps, total, last))
        self.latest.put([(name,) for name in latest])
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(last + self.idle_ms)
        yield self._row(key, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._row(key, True)
        for state in (self.totals, self.tools, self.latest):
            state.clear()

    def close(self) -> None:
        pass


def running_history(stream: DataFrame, idle_ms: int | None = None, keep_ms: int | None = None, delay: str = "1 day") -> DataFrame:
    """(run_id, steps, total_ms, tools, latest, closed): after each batch, the history of every run that it touched or closed.

    stream: run_id, seq, ts, component, execution_time_ms; within a batch a run's steps come in order of ts and seq. The state lies in
    RocksDB: start the query by ``with_rocksdb``.
    """
    if idle_ms is not None and keep_ms is not None:
        raise ValueError("a run closes by event time or is forgotten by processing time, not both")
    rows = stream.select("run_id", "seq", "ts", "component", "execution_time_ms")
    if idle_ms is not None:
        rows = rows.withWatermark("ts", delay)
    mode = "EventTime" if idle_ms is not None else "ProcessingTime" if keep_ms is not None else "None"
    return rows.groupBy("run_id").transformWithStateInPandas(RunHistory(idle_ms, keep_ms), HISTORY, "Update", mode)


#: Settings of queries whose state lies in RocksDB; small write buffers, as each partition sets the space of one aside.
_ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
}


@contextmanager
def with_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB; the session's settings come back after it."""
    before = {key: spark.conf.get(key, None) for key in _ROCKSDB}
    for key, value in _ROCKSDB.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def state_of(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    """A state variable of a stopped query as a table: (key, value), a map's entries as (key, user_map_key, user_map_value), a list's as (key, list_element)."""
    with with_rocksdb(spark):
        state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", variable).load()
    return state.drop("partition_id")


def committed(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Writes each batch below ``path`` under its number and then enters it into a ledger; ``committed_rows`` reads what was entered.

    A batch that broke off before its entry is written anew under the same number when the query starts again
    from the checkpoint, so no row is lost or doubled, in whatever mode the query runs.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        entered(batch.sparkSession, path, number)

    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def entered(spark: SparkSession, path: str, number: int) -> None:
    """Enters a batch whose rows are written into the ledger."""
    spark.createDataFrame([(number,)], "number long").coalesce(1).write.mode("overwrite").json(f"{path}/ledger/entry={number}")


def committed_rows(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of the batches in the ledger, with the column batch."""
    rows = spark.read.schema(schema).parquet(f"{path}/rows") if "batch" not in schema.fieldNames() else spark.read.parquet(f"{path}/rows")
    ledger = spark.read.schema("number long").json(f"{path}/ledger")
    return rows.join(ledger.select("number").distinct(), F.col("batch") == F.col("number"), "left_semi")
