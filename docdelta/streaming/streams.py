"""The same questions asked of streams. Each result equals its batch twin on the same rows, windows and sessions as far as the watermark has closed them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docdelta.operators import jobs as batch_jobs
from docdelta.sources.store import ResultStore


def drop_seen(uploads: DataFrame, ts: str = "ts", late: str = "1 day") -> DataFrame:
    return uploads.withWatermark(ts, late).dropDuplicatesWithinWatermark(["content_hash"])


def latest_state(events: DataFrame) -> DataFrame:
    return events.groupBy("job_id").agg(F.max_by("status", F.struct("ts", "status")).alias("status"), F.max("ts").alias("ts"))


def tumbling(metrics: DataFrame, late: str = "1 day", size: str = "1 day", slide: str | None = None) -> DataFrame:
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    last = F.element_at(F.split("operation_type", r"\."), -1)
    sums = metrics.withWatermark("ts", late).groupBy(window.alias("w"), last.alias("operation")).agg(F.count("*").alias("n"), F.round(F.sum("total_time_ms"), 3).alias("total_ms"))
    return sums.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "operation", "n", "total_ms")


def sessions(events: DataFrame, gap: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "job_id").agg(F.count("*").alias("n"))
    return s.select("job_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


#: A job in the state of its bucket: time of its last event in microseconds, whether that leaves it running, whether a result arrived.
JOB = np.dtype([("job_id", "i8"), ("us", "i8"), ("running", "?"), ("done", "?")])
#: Buckets of jobs. A bucket's state is read and written whole by a batch that has one of its jobs.
BUCKETS = 4096


def _newest(jobs: np.ndarray) -> np.ndarray:
    """One row for each job: its last event, of equal times the one that came last, and whether any had a result."""
    jobs = jobs[np.lexsort((jobs["us"], jobs["job_id"]))]
    first = np.flatnonzero(np.diff(jobs["job_id"], prepend=jobs["job_id"][:1] - 1))
    out = jobs[np.append(first[1:], len(jobs)) - 1]
    out["done"] = np.logical_or.reduceat(jobs["done"], first)
    return out


def _advance(keep: timedelta):
    """Fails running jobs that are silent for 15 minutes of event time, unless a result arrived; forgets any other job after `keep`."""
    silent, kept = (int(t / timedelta(microseconds=1)) for t in (timedelta(minutes=15), keep))

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = [np.frombuffer(bytes(state.get[0]), JOB)] if state.exists else []
        for pdf in () if state.hasTimedOut else batches:
            part = np.empty(len(pdf), JOB)
            for n in JOB.names:
                part[n] = pdf[n].to_numpy()
            parts.append(part)
        jobs = _newest(np.concatenate(parts))
        waits = jobs["running"] & ~jobs["done"]
        end = (jobs["us"] + np.where(waits, silent, kept)) // 1000
        over = end < state.getCurrentWatermarkMs()
        if over.all():
            state.remove()
        else:
            state.update((jobs[~over].tobytes(),))
            state.setTimeoutTimestamp(int(end[~over].min()))
        failed = jobs["job_id"][over & waits]
        yield pd.DataFrame({"job_id": failed, "status": ["FAILED"] * len(failed)})

    return run


def stuck(events: DataFrame, late: str = "0 seconds", keep: timedelta = timedelta(days=1), buckets: int = BUCKETS) -> DataFrame:
    """(job_id, FAILED) for each job found stuck. events: job_id, status, has_result, ts. State of other jobs lives `keep` past their last event.

    Jobs are dealt to buckets, whose next end is one timer: the work for a job is that of a row in an array. Events without an id or a time are of no job.
    """
    running, done = (F.coalesce(c, F.lit(False)) for c in (F.col("status").isin(*batch_jobs.RUNNING), F.col("has_result")))
    rows = events.where("job_id is not null and ts is not null").withWatermark("ts", late)
    rows = rows.select("ts", F.col("job_id").cast("long").alias("job_id"), F.unix_micros("ts").alias("us"), running.alias("running"), done.alias("done"), F.pmod(F.xxhash64("job_id"), F.lit(buckets)).alias("bucket"))
    return rows.groupBy("bucket").applyInPandasWithState(_advance(keep), "job_id bigint, status string", "jobs binary", "append", GroupStateTimeout.EventTimeTimeout)


def for_each_batch(stream: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Run `act` on every micro-batch and its number: once over all that is there, or with `every` (as "1 hour") on and on. Batches may repeat, so it must be idempotent."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(act)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def retention(stream: DataFrame, results: ResultStore, now: Column, checkpoint: str, every: str | None = "1 hour"):
    """Purge the results of each batch's expired jobs (job_id, status, updated_at), by default hourly."""

    def act(batch: DataFrame, number: int) -> None:
        results.purge(batch_jobs.expired(batch, now).select(F.col("job_id").alias(results.key)))

    return for_each_batch(stream, act, checkpoint, every)


def newest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The last state of each key, of what drain wrote in update mode."""
    rest = [c for c in updates.columns if c not in (*keys, "batch")]
    last = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last"))
    return last.select(*keys, *(F.col("last")[c].alias(c) for c in rest))


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process all that is there now into Parquet files: its rows (append), a folder for each batch's changes (update), the last full result (complete)."""
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    elif mode == "update":
        # A repeated batch replaces its own folder.
        query = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{path}/batch={i}")).trigger(availableNow=True).start()
    else:
        query = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(path)).trigger(availableNow=True).start()
    query.awaitTermination()
