"""Work queues as task tables, and micro-batch ingestion.

A task has task_id, key, priority (urgent, normal, low), status, attempts, created_at,
updated_at.  Steps return new frames, for a table or for foreachBatch; nothing loops over
tasks on the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BATCH, RETRIES = 50, 3
STATUSES = ("pending", "processing", "completed", "failed", "cancelled")


def urgency(priority: Column) -> Column:
    return F.when(priority == "urgent", 0).when(priority == "normal", 1).otherwise(2)


def enqueue(tasks: DataFrame, new: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Rows of new (key, priority, created_at) to add: not done, not open already, a key once."""
    open_ = tasks.where(F.col("status").isin("pending", "processing")).select("key")
    fresh = new.join(open_, "key", "left_anti")
    if done is not None:
        fresh = fresh.join(done.select("key"), "key", "left_anti")
    first = F.row_number().over(Window.partitionBy("key").orderBy(urgency(F.col("priority")), "created_at"))
    rows = fresh.withColumn("_n", first).where("_n = 1")
    return rows.select(F.sha2(F.concat_ws("|", "key", "created_at"), 256).alias("task_id"), "key", "priority", F.lit("pending").alias("status"), F.lit(0).alias("attempts"), "created_at", F.col("created_at").alias("updated_at"))


def next_batch(tasks: DataFrame, size: int = BATCH, retries: int = RETRIES) -> DataFrame:
    """By urgency, then age; tasks tried often enough are left."""
    ready = tasks.where((F.col("status") == "pending") & (F.col("attempts") < retries))
    return ready.orderBy(urgency(F.col("priority")), "created_at", "task_id").limit(size)


def settle_batch(tasks: DataFrame, outcome: DataFrame, at: int, retries: int = RETRIES) -> DataFrame:
    """tasks after a batch; outcome (task_id, ok): failures go back until they have been tried ``retries`` times."""
    both = tasks.join(outcome, "task_id", "left")
    tried = F.col("attempts") + F.col("ok").isNotNull().cast("int")
    status = F.when(F.col("ok").isNull(), F.col("status")).when(F.col("ok"), "completed").when(tried >= retries, "failed").otherwise("pending")
    when = F.when(F.col("ok").isNull(), F.col("updated_at")).otherwise(F.lit(at))
    return both.select(*(tried.cast("int").alias(c) if c == "attempts" else status.alias(c) if c == "status" else when.alias(c) if c == "updated_at" else F.col(c) for c in tasks.columns))


def queue_stats(tasks: DataFrame, by: str = "status") -> DataFrame:
    return tasks.groupBy(by).agg(F.count("*").alias("tasks"), F.sum("attempts").alias("attempts"))


def cancel(tasks: DataFrame, ids: list[str]) -> DataFrame:
    return tasks.withColumn("status", F.when(F.col("task_id").isin(ids) & (F.col("status") == "pending"), "cancelled").otherwise(F.col("status")))


def clear(tasks: DataFrame, status: str = "completed", older_than: int | None = None) -> DataFrame:
    gone = F.col("status") == status
    return tasks.where(~(gone if older_than is None else gone & (F.col("updated_at") < older_than)))


def retry_failed(tasks: DataFrame) -> DataFrame:
    failed = F.col("status") == "failed"
    return tasks.withColumn("attempts", F.when(failed, 0).otherwise(F.col("attempts"))).withColumn("status", F.when(failed, "pending").otherwise(F.col("status")))


def watch_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """New files of a folder as a stream: path, mtime, value (whole text); dot files never come."""
    stream = spark.readStream.format("text").schema("value string").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return stream.select(F.col("_metadata.file_path").alias("path"), F.unix_millis("_metadata.file_modification_time").alias("mtime"), "value")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Events between two listings (path, mtime): add, change, unlink."""
    both = before.select("path", F.col("mtime").alias("_old")).join(after.select("path", F.col("mtime").alias("_new")), "path", "full_outer")
    event = F.when(F.col("_old").isNull(), "add").when(F.col("_new").isNull(), "unlink").when(F.col("_new") != F.col("_old"), "change")
    return both.select("path", event.alias("event")).where("event IS NOT NULL")


def ingest_stream(stream: DataFrame, table: str, checkpoint: str, key: str = "message_id") -> object:
    """Append new rows to a Parquet table, each key once even when a batch is repeated."""

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        try:
            known = spark.read.parquet(table).select(key)
        except Exception as missing:  # noqa: BLE001 - the table comes with the first batch
            if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER" not in str(missing):
                raise
        else:
            fresh = fresh.join(known, key, "left_anti")
        fresh.write.mode("append").parquet(table)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def process_stream(stream: DataFrame, work: Callable[[DataFrame], None], checkpoint: str) -> object:
    """Call ``work`` on each micro-batch, most urgent first."""

    def each(batch: DataFrame, _: int) -> None:
        work(batch.orderBy(urgency(F.col("priority")), "created_at"))

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, at: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window, with a watermark (an extension)."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(F.window(at, width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value")).select(F.col("w.start").alias("window_start"), "event_type", "events", "value")


Processor = Callable[[DataFrame], DataFrame]


class Processors:
    """Work by kind of source: each takes tasks and returns (task_id, ok); one batch settles as a whole."""

    def __init__(self, retries: int = RETRIES, whole: bool = False):
        self.made: dict[str, Processor] = {}
        self.retries, self.whole = retries, whole

    def register(self, kind: str, work: Processor) -> None:
        self.made[kind] = work

    def outcome(self, batch: DataFrame, by: str = "source_type") -> DataFrame:
        """(task_id, ok) of a batch: a kind without processor fails, and so does what its processor does not report; with ``whole``, one failure fails all."""
        found = None
        for kind, work in self.made.items():
            done = work(batch.where(F.col(by) == kind)).select("task_id", "ok")
            found = done if found is None else found.unionByName(done)
        out = batch.select("task_id")
        out = out.withColumn("ok", F.lit(False)) if found is None else out.join(found, "task_id", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
        return out.withColumn("ok", F.min("ok").over(Window.partitionBy(F.lit(1)))) if self.whole else out  # a batch is of bounded size

    def process(self, tasks: DataFrame, at: int, size: int = BATCH, by: str = "source_type") -> DataFrame:
        """tasks after the next batch."""
        return settle_batch(tasks, self.outcome(next_batch(tasks, size, self.retries), by), at, self.retries)

    def process_stream(self, stream: DataFrame, table: str, checkpoint: str, at: int, by: str = "source_type") -> object:
        """Each micro-batch of tasks is tried until every task has succeeded or failed for good; its end state is appended."""

        def each(batch: DataFrame, _: int) -> None:
            state = batch
            for _ in range(self.retries):
                state = self.process(state, at, 1 << 30, by)
            state.write.mode("append").parquet(table)

        return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status_of(tasks: DataFrame, task_id: str) -> DataFrame:
    return tasks.where(F.col("task_id") == task_id).select("task_id", "status", "attempts", "updated_at")


def recent(tasks: DataFrame, limit: int = 10, status: str | None = None) -> DataFrame:
    """The tasks that changed last."""
    rows = tasks if status is None else tasks.where(F.col("status") == status)
    return rows.orderBy(F.desc("updated_at"), "task_id").limit(limit)


def by_source(tasks: DataFrame, by: str = "source_type") -> DataFrame:
    """Tasks of each kind of source by status."""
    return tasks.groupBy(by).agg(*(F.count_if(F.col("status") == s).alias(s) for s in STATUSES), F.count("*").alias("tasks"))
