"""The job log: status, progress, repair, retention, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUNNING = ("PROCESSING", "PENDING")
#: Percent that a running job has done when it enters a phase, and at the marks within one. Fixed values.
PHASES = {"Loading documents": 5, "Base document loaded": 10, "Documents loaded": 15, "Comparing documents": 20, "Comparison done": 85, "Saving results": 90, "Results saved": 95}


def seconds(a: Column, b: Column) -> Column:
    """Whole seconds from a to b."""
    return F.floor(F.unix_micros(b) / 1e6) - F.floor(F.unix_micros(a) / 1e6)


def silent_for(ts: Column, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(ts)) / 1e6


def create(requests: DataFrame, docs: DataFrame) -> DataFrame:
    known = docs.select(F.col("doc_id").alias("known"))
    for s in ("base", "compare"):
        requests = requests.join(known.select(F.col("known").alias(f"{s}_id"), F.lit(True).alias(f"has_{s}")), f"{s}_id", "left")
    reason = F.when(F.col("has_base").isNull(), "base document not found").when(F.col("has_compare").isNull(), "compare document not found")
    return requests.select("job_id", "base_id", "compare_id", reason.alias("reject_reason"), F.when(reason.isNull(), "PROCESSING").alias("status"))


def resolve_status(wanted: DataFrame, jobs: DataFrame) -> DataFrame:
    """COMPLETED where a result exists, whatever the row says; NOT_FOUND where there is no job."""
    j = jobs.select("job_id", "status", "has_result")
    return wanted.join(j, "job_id", "left").select("job_id", F.when(F.col("has_result"), "COMPLETED").otherwise(F.coalesce("status", F.lit("NOT_FOUND"))).alias("status"))


def progress(jobs: DataFrame, total: Column) -> DataFrame:
    """Percent of a job by its phase, and the operations that makes of its total. Waiting jobs have done nothing, finished ones all."""
    by_phase = F.create_map(*(F.lit(x) for kv in PHASES.items() for x in kv))[F.col("phase")]
    percent = F.when(F.col("status") == "COMPLETED", 100).when(F.col("status") == "PENDING", 0).otherwise(F.coalesce(by_phase, F.lit(0)))
    return jobs.select("job_id", "status", "phase", percent.alias("percent"), F.floor(percent * total / 100).alias("completed_operations"))


def in_progress(jobs: DataFrame) -> DataFrame:
    return jobs.where(~F.col("has_result") & F.col("status").isin(*RUNNING))


def elapsed(jobs: DataFrame, now: Column) -> DataFrame:
    s = seconds(F.col("created_at"), now)
    return jobs.select("job_id", s.alias("seconds"), (F.floor(s / 60) > 5).alias("maybe_stuck"))


def repair(jobs: DataFrame, now: Column, minutes: int = 15) -> DataFrame:
    running, stale = F.col("status").isin(*RUNNING), silent_for(F.col("updated_at"), now) > minutes * 60
    status = F.when(running & F.col("has_result"), "COMPLETED").when(running & stale, "FAILED").otherwise(F.col("status"))
    message = F.when(running & ~F.col("has_result") & stale, f"No progress for more than {minutes} minutes")
    return jobs.select("job_id", status.alias("status"), message.alias("message"))


def recent(jobs: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    age = silent_for(F.col("created_at"), now)
    return jobs.where((age >= 0) & (age <= hours * 3600)).select("job_id", "status", "has_result", F.floor(age / 60).alias("age_minutes"), "created_at")


def not_compared(wanted: DataFrame, jobs: DataFrame) -> DataFrame:
    return wanted.join(jobs.where("has_result").select("base_id", "compare_id").distinct(), ["base_id", "compare_id"], "left_anti")


def expired(jobs: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    return jobs.where(F.col("status").isin("COMPLETED", "FAILED") & (silent_for(F.col("updated_at"), now) > hours * 3600))


def by_operation(metrics: DataFrame) -> DataFrame:
    last = F.element_at(F.split("operation_type", r"\."), -1)
    return metrics.groupBy(last.alias("operation")).agg(F.round(F.sum("total_time_ms")).cast("long").alias("total_ms"), F.count("*").alias("n"))


def by_size(metrics: DataFrame) -> DataFrame:
    order = F.array_position(F.array(*map(F.lit, ("tiny", "small", "medium", "large", "very_large"))), F.col("size_category"))
    return metrics.groupBy("size_category").agg(F.round(F.sum("total_time_ms")).cast("long").alias("total_ms")).withColumn("place", order)


def summary(metrics: DataFrame) -> DataFrame:
    first = F.element_at(F.split("operation_type", r"\."), 1)
    slowest = F.max_by("event_id", F.struct("total_time_ms", "event_id"))
    return metrics.groupBy(first.alias("engine")).agg(F.count("*").alias("n"), F.round(F.sum("total_time_ms"), 3).alias("total_ms"), slowest.alias("slowest_event"))
