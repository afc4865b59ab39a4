"""Decisions over the stream of review jobs, each with the batch form that must agree with it.

``events``: job_id, uid, ts TIMESTAMP, event (accepted, done, error), source_format.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from planlens.functions import vocabulary as V

HOUR = 3600
KEEP_HOURS = 24  # how long a decided job is remembered
DECISIONS = "uid bigint, ts timestamp, seq bigint, active int, recent int, admitted boolean"
STATE = "recent array<timestamp>, active int"


def pressure(events: DataFrame) -> DataFrame:
    """Each submission with the user's open jobs and submissions in the hour before it, had every
    one been let in: the report form of the limits, a window over each user's own events."""
    w = W.partitionBy("uid").orderBy("ts", "job_id")
    delta = F.when(F.col("event") == "accepted", 1).when(F.col("event").isin("done", "error"), -1).otherwise(0)
    running = F.coalesce(F.sum(delta).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    hour = W.partitionBy("uid").orderBy(F.col("ts").cast("timestamp").cast("double")).rangeBetween(-HOUR, 0)
    recent = F.count_if(F.col("event") == "accepted").over(hour) - 1
    return (events.withColumn("active", running).withColumn("recent", recent).where("event = 'accepted'")
            .withColumn("refused", (F.col("active") >= V.CONCURRENT_JOBS) | (F.col("recent") >= V.JOBS_PER_HOUR)))


def _admit(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Let in or refuse each submission of one user; only what was let in counts later.

    The state of a user is at most the hour's admitted times (ten) and a number of open jobs.
    """
    recent, active = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
    rows = []
    # a user's events of one trigger, in order; the trigger bounds how many there are
    for e in pd.concat(list(chunks)).sort_values(["ts", "seq"]).itertuples():
        if e.event in ("done", "error"):
            active = max(0, active - 1)
            continue
        recent = [t for t in recent if t > e.ts - pd.Timedelta(seconds=HOUR)]
        ok = active < V.CONCURRENT_JOBS and len(recent) < V.JOBS_PER_HOUR
        rows.append((key[0], e.ts, e.seq, active, len(recent), ok))
        if ok:
            recent.append(e.ts)
            active += 1
    state.update(([pd.Timestamp(t) for t in recent], int(active)))
    if not active:
        over = max((int(pd.Timestamp(t).timestamp() * 1000) for t in recent), default=0) + HOUR * 1000
        state.setTimeoutTimestamp(max(over, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame(rows, columns=["uid", "ts", "seq", "active", "recent", "admitted"])


def admission(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Streaming: a decision per submission, exact because refusals leave no trace in the state.

    A user's state goes when nothing is open and the hour has passed. Events later than ``delay``
    are dropped.
    """
    live = events.where("event in ('accepted', 'done', 'error')").withWatermark("ts", delay).select("uid", "ts", F.col("job_id").alias("seq"), "event")
    return live.groupBy("uid").applyInPandasWithState(_admit, DECISIONS, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def hourly_counts(events: DataFrame, delay: str = "10 minutes", slide: str = "5 minutes") -> DataFrame:
    """Submissions per user in sliding hours. On a stream, a window is final once the watermark
    passes it; on a batch every window is counted."""
    e = events.where("event = 'accepted'")
    if e.isStreaming:
        e = e.withWatermark("ts", delay)
    return e.groupBy(F.window("ts", "1 hour", slide).alias("w"), "uid").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), "uid", "n")


def stale_jobs(events: DataFrame, now: Column) -> DataFrame:
    """Jobs running past their limit at ``now``: started, never ended, old enough for their kind.

    ``now`` is a literal or a column of ``events`` holding the one time of asking.
    """
    started = events.where("event = 'accepted'").groupBy("job_id", "uid").agg(
        F.min("ts").alias("started"), F.max(F.coalesce("source_format", F.lit("pdf"))).alias("source_format"), F.max(now).alias("_now"))
    ended = events.where("event in ('done', 'error')").select("job_id")
    limit = F.when(F.col("source_format") != "pdf", V.STALE_DRAWING_MINUTES).otherwise(V.STALE_MINUTES)
    age = (F.col("_now").cast("timestamp").cast("double") - F.col("started").cast("timestamp").cast("double")) / 60
    return started.join(ended, "job_id", "left_anti").where(age > limit).drop("_now")


def _expire(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Report the jobs of one bucket, each once, when its time has run out before any end.

    The state holds for each job its first start, whether a drawing was sent, the first end (microseconds) and
    whether the job was told of. A job outlives its decision by ``KEEP_HOURS``, so the order and batching of
    events within the watermark's delay do not matter.
    """
    jobs = {job: said for job, *said in json.loads(state.get[0])} if state.exists else {}
    earliest = lambda a, b: b if a is None else min(a, b)
    for pdf in () if state.hasTimedOut else chunks:
        live = pdf[pdf["us"].notna()]
        for job, us, event, form in zip(*(live[c].tolist() for c in ("job_id", "us", "event", "source_format"))):
            said = jobs.setdefault(job, [None, False, None, False])
            if event == "accepted":
                said[0], said[1] = earliest(said[0], int(us)), said[1] or form != "pdf"
            else:
                said[2] = earliest(said[2], int(us))
    now, out, kept, wake = state.getCurrentWatermarkMs(), [], [], None
    for job, (start, drawing, end, told) in jobs.items():
        due = None if start is None else start + (V.STALE_DRAWING_MINUTES if drawing else V.STALE_MINUTES) * 60_000_000
        passed = due is not None and due // 1000 < now
        if passed and not told and (end is None or end > due):
            out.append(job)
        last = (end if due is None else due) // 1000 + KEEP_HOURS * HOUR * 1000
        if last >= now:
            kept.append((job, start, drawing, end, told or passed))
            wake = earliest(wake, last if due is None or passed else due // 1000)
    if kept:
        state.update((json.dumps(kept),))
        state.setTimeoutTimestamp(max(wake, now + 1))
    elif state.exists:
        state.remove()
    yield pd.DataFrame({"job_id": out, "reason": ["interrupted"] * len(out)}, dtype=object)


def expiring_jobs(events: DataFrame, delay: str = "1 minute", buckets: int = 1024) -> DataFrame:
    """Streaming: jobs whose limit passes in event time before an end.

    Jobs are dealt into ``buckets`` and a bucket is decided at once, so a job costs a row of a table and no call of its own.
    The number is part of the state: a stream that goes on from a checkpoint keeps it.
    """
    live = events.where("event in ('accepted', 'done', 'error')").withWatermark("ts", delay).select(
        "job_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event", F.coalesce("source_format", F.lit("pdf")).alias("source_format"),
        F.pmod(F.xxhash64("job_id"), F.lit(buckets)).alias("bucket"))
    return live.groupBy("bucket").applyInPandasWithState(
        _expire, "job_id string, reason string", "jobs string", "append", GroupStateTimeout.EventTimeTimeout)


def history(jobs: DataFrame, limit: int | None = None) -> DataFrame:
    """Every user's reviews, newest first, ``limit`` of them (None: all). The window keeps only each
    task's own first rows per user before anything is shuffled."""
    w = W.partitionBy("uid").orderBy(F.desc("created_at"), F.desc("job_id"))
    ranked = jobs.withColumn("n", F.row_number().over(w))
    return ranked if limit is None else ranked.where(F.col("n") <= limit)


def job_snapshot(events: DataFrame) -> DataFrame:
    """Latest state and elapsed seconds per job; on a stream run it in update mode."""
    state = F.when(F.col("event") == "accepted", "running").otherwise(F.col("event"))
    secs = F.max(F.col("ts").cast("timestamp").cast("double")) - F.min(F.col("ts").cast("timestamp").cast("double"))
    return events.groupBy("job_id").agg(F.max_by(state, F.struct("ts", "seq")).alias("state"), F.min("ts").alias("started"),
                                        F.round(secs, 3).alias("elapsed"))


def reusable(done: DataFrame) -> DataFrame:
    """Finished work worth replaying: no error that may not come back."""
    e = F.coalesce("error", F.lit(""))
    return done.where(~e.startswith("failed:") & ~e.contains("deadline"))


def unseen(work: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Work whose content key has no reusable result yet."""
    return work.join(reusable(done).select(*key).distinct(), key, "left_anti")


def unseen_stream(work: DataFrame, key: list[str], delay: str = "1 hour") -> DataFrame:
    """Streaming: the first arrival of each content key within the watermark."""
    return work.withWatermark("ts", delay).dropDuplicatesWithinWatermark(key)


def run_to_end(stream: DataFrame, path: str, mode: str = "append", **options: Any) -> DataFrame:
    """Drive a stream over what is there now into a folder and read the result back."""
    q = (stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/data")
         .option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start())
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/data")
