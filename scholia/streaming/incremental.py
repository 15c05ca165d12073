"""Incremental state as append-only events (I01-I08), in batch and as Structured Streaming.

A status table is only appended to; the state of a key is its latest event. Counters are queries, never stored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def latest_status(events: DataFrame, key: str, status: str, order: list[str]) -> DataFrame:
    """Each key's last status: a maximum with partial sums, so a key with many events is no hot group."""
    last = F.max(F.struct(*order, status)).alias("last")
    return events.groupBy(key).agg(last).select(key, F.col(f"last.{status}").alias(status))


def pending(keys: DataFrame, latest: DataFrame, key: str, status: str, done: tuple[str, ...] = ("completed", "low_score")) -> DataFrame:
    """Keys to work on: all but those whose last status is done (others are retried)."""
    return keys.join(latest.where(F.col(status).isin(*done)), key, "left_anti")


def append_new(stream: DataFrame, path: str, checkpoint: str, key: str, ts: str, late: str, work: Callable[[DataFrame], DataFrame]) -> None:
    """Rows whose keys are new are worked on and appended to the table at `path`. Keys seen are kept in the
    stream's state store for the time that a repetition may be late, so the table is never read; the sink's log makes each
    batch's rows appear once, and a restart resumes from the checkpoint. Runs until the available input is used up."""
    fresh = work(stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key]))
    q = fresh.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


#: What a key's state holds: its last status and when, failures so far, and whether a retry was asked for since.
_STATE = "status string, at timestamp, failures int, asked boolean"


def keyed_work(stream: DataFrame, key: str, ts: str, status: str, wait: str = "10 minutes", most: int = 3, late: str = "1 hour", done: tuple[str, ...] = ("completed", "low_score")) -> DataFrame:
    """A stream of what is to be done: (key, action, failures, at). A key's state lives in the state store:
    the first event of a key gives ``start``; a failure (any status that is neither done nor ``extracted``) gives ``retry``
    once event time has passed by `wait`, up to `most` failures, then ``give_up``; a key that is done gives ``done`` once
    and nothing after it. Events are taken in order of time within a batch, and an event older than the state is only
    counted if it is a failure."""
    seconds = int(pd.Timedelta(wait).total_seconds())
    kind = stream.schema[key].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, at, failures, asked = state.get if state.exists else (None, None, 0, True)
        told: list[tuple[str, int, pd.Timestamp]] = []
        if state.hasTimedOut:
            told.append(("retry", failures, at))
            state.update((now, at, failures, True))
        else:
            rows = pd.concat(list(batches)).sort_values([ts, status], kind="stable")
            for s, t in zip(rows[status], rows[ts], strict=True):
                if now is None:
                    told.append(("start", 0, t))
                if now in done:
                    continue
                failed = s not in done and s != "extracted"
                failures += failed
                if at is None or t >= at or s in done:
                    now, at = s, t if at is None else max(at, t)
                if s in done:
                    told.append(("done", failures, t))
                    asked = True
                elif failed:
                    asked = failures >= most
                    if failures == most:
                        told.append(("give_up", failures, t))
            state.update((now, at, failures, asked))
            if not asked:
                state.setTimeoutTimestamp(max(int(at.timestamp() * 1000) + 1000 * seconds, state.getCurrentWatermarkMs() + 1))
        if told:
            yield pd.DataFrame({key: [k[0]] * len(told), "action": [x[0] for x in told], "failures": [x[1] for x in told], "at": [x[2] for x in told]})

    rows = stream.select(key, ts, status).withWatermark(ts, late)
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, action string, failures int, at timestamp", _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """All available input through the stream into the table at `path`; a later call takes up where this one ended."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def event_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A stream of status events; event time as a timestamp with zone, for watermarks."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(stream: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Our extension: tumbling windows of status counts with a watermark."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"))


def upserted(state: DataFrame, events: DataFrame, key: str, order: str) -> DataFrame:
    """A table of states (key, order, other columns) with newer events taken in: the greatest order of a key counts."""
    rest = [c for c in state.columns if c not in (key, order)]
    last = F.max(F.struct(order, *rest)).alias("last")
    return state.unionByName(events.select(*state.columns)).groupBy(key).agg(last).select(key, f"last.{order}", *(f"last.{c}" for c in rest))


def counters(state: DataFrame, status: str) -> DataFrame:
    """How many keys are in each status, by query; no counter is stored that could go wrong."""
    return state.groupBy(status).agg(F.count("*").alias("n"))


def filled(checkpoint: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """A checkpoint of an older form: columns (name: SQL default) that are missing or null get their defaults."""
    have = set(checkpoint.columns)
    return checkpoint.withColumns({k: F.coalesce(F.col(k), F.expr(v)) if k in have else F.expr(v) for k, v in defaults.items()})


def save_state(state: DataFrame, path: str) -> str:
    """A new version of a state beside the older ones, complete or absent (Spark commits a folder as a whole); the
    path of the version. Versions are numbered; load_state() reads the last that was committed."""
    spark = state.sparkSession
    version = (_versions(spark, path) or [0])[-1] + 1
    state.write.parquet(f"{path}/v={version:08d}")
    return f"{path}/v={version:08d}"


def load_state(spark: SparkSession, path: str) -> DataFrame | None:
    """The last committed version; null if there is none."""
    found = _versions(spark, path)
    return spark.read.parquet(f"{path}/v={found[-1]:08d}") if found else None


def _versions(spark: SparkSession, path: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [x.getPath() for x in fs.listStatus(folder)]
    done = [p.getName() for p in names if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n[2:]) for n in done if n.startswith("v="))


def saved_in_batches(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Results appended after every few files of input (the source's maxFilesPerTrigger), one commit each."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
