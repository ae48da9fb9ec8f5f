"""Event streams: windows, sessions, running reports, duplicates and the life of jobs."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.runtime import scratch_root


def read_events(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A stream over Parquet event files; ts becomes a timestamp with zone, which watermarks need."""
    schema = spark.read.parquet(path).schema
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile():
        # a file source watches folders; of this one only the file
        path, _, name = path.rpartition("/")
        reader = reader.option("pathGlobFilter", name)
    stream = reader.parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Counts and sums by window and type; the state of a window goes once the watermark has passed it."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("since"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Runs of a user's events with no pause of `gap` or more."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    by = marked.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return by.select("user_id", F.col("w.start").alias("since"), F.col("w.end").alias("until"), "n")


def unique(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each event id once, as long as copies come within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


STATE = "status string, progress int, n long, at timestamp, moved timestamp, tie long"
# What an event makes of a job, and how far it then is.
STEPS = {"created": ("pending", 0), "started": ("processing", 5), "converted": ("processing", 70), "scored": ("processing", 85), "finished": ("succeeded", 100), "failed": ("failed", 100)}


def lifecycle(log: DataFrame, timeout: str | None = "60 minutes", keep: str = "7 days", tie: str | None = None) -> DataFrame:
    """The status of jobs from their log (job_id, step, ts), kept as state: the latest event decides, in whatever order they
    come, a finished job stays as it is, and one that is silent for `timeout` of event time fails. Of events at the same
    time the one with the largest `tie`, a column of whole numbers, is the latest, or without it the one whose step is
    farthest on; those without a time come last. What has finished or failed is remembered for `keep` of event time, so that
    late events do not begin it anew, and then forgotten."""
    wait_ms = int(pd.Timedelta(timeout).total_seconds() * 1000) if timeout else None
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)

    places = {step: k for k, step in enumerate(STEPS)}
    never, first, final = pd.Timestamp(0), pd.Timestamp(1700, 1, 1), pd.Timestamp(2200, 1, 1)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, progress, n, at, *moved = state.get if state.exists else ("pending", 0, 0, never, first, -(1 << 63))
        if state.hasTimedOut:
            if status not in ("pending", "processing"):
                state.remove()
                return
            status, progress = "failed", 100
            state.update((status, progress, n, at, *moved))
            state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + keep_ms)
        else:
            at, moved, end, latest = pd.Timestamp(at), (pd.Timestamp(moved[0]), moved[1]), None, None
            # neither the pieces of a batch nor the rows of a piece have an order
            for rows in batches:
                for step, ts, number in rows[["step", "ts", "tie"]].itertuples(index=False):
                    n, at = n + 1, at if pd.isna(ts) else max(at, ts)
                    if step not in STEPS:
                        continue
                    here = (final if pd.isna(ts) else ts, places[step] if pd.isna(number) else int(number))
                    if STEPS[step][0] in ("succeeded", "failed"):
                        end = min(end or (here, step), (here, step))
                    elif here >= moved:
                        moved, latest = here, step
            if status not in ("succeeded", "failed") and (end or latest):
                status, progress = STEPS[end[1] if end else latest]
            state.update((status, progress, n, at.to_pydatetime(), moved[0].to_pydatetime(), moved[1]))
            if wait_ms:
                wait = keep_ms if status in ("succeeded", "failed") else wait_ms
                state.setTimeoutTimestamp(max(int(at.timestamp() * 1000) + wait, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "progress": [progress], "n": [n]})

    marked = log.select("job_id", "step", "ts", (F.col(tie) if tie else F.lit(None)).cast("long").alias("tie")).withWatermark("ts", "10 minutes")
    return marked.groupBy("job_id").applyInPandasWithState(fold, "job_id long, status string, progress int, n long", STATE, "update", "EventTimeTimeout" if timeout else "NoTimeout")


def admissions(requests: DataFrame, user_limit: int = 3, guest_limit: int = 1, forget: str = "1 day") -> DataFrame:
    """Which jobs may begin, from a stream of (requester, is_user, job_id, step, ts): the active jobs of a requester are
    state; `created` is admitted while they are fewer than the limit, `finished` and `failed` make room. Events of a batch go
    by time, then job, ends before beginnings. A requester that is silent for `forget` of event time starts with none."""
    forget_ms = int(pd.Timedelta(forget).total_seconds() * 1000)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        active = set(state.get[0]) if state.exists else set()
        rows = pd.concat(list(batches))
        rows = rows.assign(begins=rows.step == "created").sort_values(["ts", "begins", "job_id"])
        out = []
        for job, step, is_user in rows[["job_id", "step", "is_user"]].itertuples(index=False):
            if step in ("finished", "failed"):
                active.discard(int(job))
            elif step == "created" and int(job) not in active:
                admitted = len(active) < (user_limit if is_user else guest_limit)
                active |= {int(job)} if admitted else set()
                out.append((key[0], int(job), admitted))
        state.update((sorted(active),))
        state.setTimeoutTimestamp(max(int(rows.ts.max().timestamp() * 1000) + forget_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["requester", "job_id", "admitted"])

    marked = requests.withWatermark("ts", "10 minutes")
    return marked.groupBy("requester").applyInPandasWithState(fold, "requester string, job_id long, admitted boolean", "active array<long>", "append", "EventTimeTimeout")


def run_once(stream: DataFrame, mode: str, then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """All that a stream has now, as a table: it runs until its source is read, into the shared scratch folder."""
    spark = stream.sparkSession
    name = f"stream_{uuid.uuid4().hex}"
    root = f"{scratch_root(spark)}/{name}"
    if mode == "append":
        stream.writeStream.format("parquet").outputMode("append").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
        out = spark.read.schema(stream.schema).parquet(f"{root}/out")
    else:
        # complete and update modes rewrite rows: each batch is a folder, and the last one, or the last of a key, holds
        def keep(batch: DataFrame, number: int) -> None:
            batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/out/b={number}")

        stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
        every = spark.read.parquet(f"{root}/out").drop("b")
        out = every.join(F.broadcast(every.agg(F.max("batch").alias("batch"))), "batch").drop("batch") if mode == "complete" else every
    return then(out) if then else out
