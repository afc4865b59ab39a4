"""Streams agree with their batch twins and survive a repeated batch."""
import datetime as dt
import os
import random

import pytest

from pyspark.sql import functions as F

from planlens.streaming import jobs as J
from planlens.streaming.review import review_stream, reviewed

EV = "job_id bigint, uid bigint, ts timestamp, event string, source_format string"


def some_events(n=400):
    rng, t, rows = random.Random(9), dt.datetime(2024, 1, 1), []
    for i in range(n):
        t += dt.timedelta(seconds=rng.randrange(1, 400))
        rows.append((i, rng.randrange(3), t, rng.choice(["accepted", "accepted", "done", "error"]), rng.choice(["pdf", "dwg"])))
    return rows


def write_parts(spark, rows, path, parts):
    step = len(rows) // parts
    for i in range(parts):
        spark.createDataFrame(rows[i * step:(i + 1) * step], EV).coalesce(1).write.mode("append").parquet(path)


def in_order(spark, rows, path, parts):
    """A stream over files whose names and times follow the events, one file a trigger."""
    step = -(-len(rows) // parts)
    for i in range(parts):
        made = f"{path}/made{i}"
        spark.createDataFrame(rows[i * step:(i + 1) * step], EV).coalesce(1).write.parquet(made)
        one = next(f for f in os.listdir(made) if f.endswith(".parquet"))
        os.makedirs(f"{path}/in", exist_ok=True)
        os.rename(f"{made}/{one}", f"{path}/in/{i:03d}.parquet")
        os.utime(f"{path}/in/{i:03d}.parquet", (1e9 + i, 1e9 + i))
    return spark.readStream.schema(EV).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


@pytest.mark.parametrize("parts", [1, 5])
def test_a_job_expires_once_however_its_events_are_batched(spark, tmp_path, parts):
    t = dt.datetime(2024, 1, 1)
    m = lambda k: t + dt.timedelta(minutes=k)
    rows = [("a", 1, m(2), "done", "pdf"), ("b", 1, m(2), "accepted", "pdf"), ("a", 1, m(1), "accepted", "pdf"), ("c", 1, m(2), "accepted", "dwg"), ("b", 1, m(30), "accepted", "pdf"),
            ("d", 1, m(31), "accepted", "pdf"), ("b", 1, m(40), "done", "pdf"), ("d", 1, m(41), "done", "pdf"), ("z", 2, m(100), "done", "pdf"), ("z", 2, m(200), "done", "pdf")]
    stream = in_order(spark, [(i, u, ts, e, f) for i, u, ts, e, f in [(ord(r[0]), *r[1:]) for r in rows]], str(tmp_path), parts)
    out = J.run_to_end(J.expiring_jobs(stream.withColumn("job_id", F.char("job_id"))), f"{tmp_path}/out")
    assert sorted(r.job_id for r in out.collect()) == ["b", "c"]


@pytest.mark.parametrize("parts", [1, 6])
def test_admission_is_the_sequential_decision(spark, tmp_path, parts):
    rows = some_events()
    out = J.run_to_end(J.admission(in_order(spark, rows, str(tmp_path), parts)), f"{tmp_path}/out")
    want, state = {}, {}
    for i, uid, t, ev, _ in rows:
        recent, active = state.setdefault(uid, ([], 0))
        if ev != "accepted":
            state[uid] = (recent, max(0, active - 1))
            continue
        recent = [x for x in recent if x > t - dt.timedelta(hours=1)]
        ok = active < 3 and len(recent) < 10
        want[i] = ok
        state[uid] = (recent + [t], active + 1) if ok else (recent, active)
    assert {r.seq: r.admitted for r in out.collect()} == want and not all(want.values())


def test_stream_of_sets_equals_one_batch(spark, tmp_path):
    write_parts(spark, some_events(), f"{tmp_path}/in", 4)
    review = lambda df: df.groupBy("job_id").agg(F.max("event").alias("event"))
    src = lambda: spark.readStream.schema(EV).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for _ in range(2):  # nothing new the second time
        review_stream(src(), review, f"{tmp_path}/out").awaitTermination()
    got = {(r.job_id, r.event) for r in reviewed(spark, f"{tmp_path}/out").collect()}
    assert got == {tuple(r) for r in review(spark.read.schema(EV).parquet(f"{tmp_path}/in")).collect()}
    assert reviewed(spark, f"{tmp_path}/out").count() == len(got)


def test_stale_and_snapshot(frame):
    t = dt.datetime(2024, 1, 1)
    m = lambda k: t + dt.timedelta(minutes=k)
    df = frame([(1, 1, m(0), "accepted", "pdf"), (2, 1, m(0), "accepted", "dwg"), (3, 1, m(0), "accepted", "pdf"), (3, 1, m(5), "done", "pdf"), (4, 1, m(25), "accepted", "pdf")], EV)
    assert [r.job_id for r in J.stale_jobs(df, F.lit(m(30))).collect()] == [1]
    snap = {r.job_id: (r.state, r.elapsed) for r in J.job_snapshot(df.withColumn("seq", F.col("job_id"))).collect()}
    assert snap[3] == ("done", 300.0) and snap[1] == ("running", 0.0)


def test_replay_skips_only_lasting_results(frame):
    done = frame([("a", "failed: api"), ("b", ""), ("c", "over the deadline"), ("d", "refused")], "key string, error string")
    work = frame([(k,) for k in "abcde"], "key string")
    assert sorted(r.key for r in J.unseen(work, done, ["key"]).collect()) == ["a", "c", "e"]


def test_expiring_jobs_share_a_state(spark, tmp_path):
    """Many jobs in one bucket are decided by one call each trigger, each by its own times; one told of is not told again."""
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = [(i, 1, at(i % 3), "accepted", "dwg" if i % 2 else "pdf") for i in range(300)]
    rows += [(i, 1, at(i % 3 + 10), "done", "pdf") for i in range(0, 300, 5)] + [(1, 1, at(50), "accepted", "pdf"), (900, 1, at(45), "done", "pdf"), (901, 1, at(400), "error", "pdf")]
    rows.sort(key=lambda r: r[2])
    for buckets in (1, 7):
        stream = in_order(spark, rows, f"{tmp_path}/{buckets}", 4)
        out = J.run_to_end(J.expiring_jobs(stream.withColumn("job_id", F.col("job_id").cast("string")), buckets=buckets), f"{tmp_path}/out{buckets}")
        assert sorted(int(r.job_id) for r in out.collect()) == [i for i in range(300) if i % 5]
