"""Reports of one job appear together; sets of a stream are reviewed when complete."""
import datetime as dt
import os

from pyspark.sql import functions as F

from planlens.sources.sinks import read_reports, write_reports
from planlens.streaming.sets import closing_sets, review_sets, set_reports, waiting_sets

ROWS = "set_id bigint, at timestamp, ended boolean, v int"


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def test_a_job_run_again_replaces_and_a_lost_attempt_is_not_seen(spark, frame, tmp_path):
    at = str(tmp_path)
    two = lambda *v: {"a": frame([(x,) for x in v], "x int"), "b": frame([(-x,) for x in v], "x int")}
    write_reports(two(1, 2), at, "first")
    write_reports(two(3), at, "second")
    early = read_reports(spark, at, ["a", "b"])
    write_reports(two(4), at, "first")
    write_reports({"a": frame([], "x int"), "b": frame([], "x int")}, at, "empty")
    two(9)["a"].write.parquet(f"{at}/reports/a/attempt=alost")
    late = read_reports(spark, at, ["a", "b"])
    seen = lambda got, k: sorted((r.job, r.x) for r in got[k].collect())
    assert seen(early, "a") == [("first", 1), ("first", 2), ("second", 3)] and seen(early, "b") == [("first", -2), ("first", -1), ("second", -3)]
    assert seen(late, "a") == [("first", 4), ("second", 3)] and seen(late, "b") == [("first", -4), ("second", -3)]


def test_closing_sets(frame):
    marks = frame([(1, 0, day(0), False), (2, 0, day(0), None), (2, 1, day(9), True), (3, 1, day(10), False), (4, 0, None, False), (5, 0, day(0), True), (6, 0, day(0), False),
                   (6, 1, day(1), False)], "set_id bigint, batch int, last timestamp, ended boolean")
    done = frame([(5, 0), (6, 0)], "set_id bigint, batch int")
    assert sorted(r.set_id for r in closing_sets(marks, done, "5 days").collect()) == [1, 2, 6]
    assert closing_sets(marks.where("false"), done, "5 days").count() == 0


def test_sets_of_a_stream(spark, frame, tmp_path):
    parts = [[(1, day(0), False, 1), (2, day(0), True, 2), (None, day(0), True, 9)],
             [(1, day(1), True, 3), (3, day(1), False, 4), (4, None, None, 5)],
             [(2, day(2), False, 6), (5, day(30), False, 7)],
             [(3, day(29), None, 8)]]
    os.makedirs(f"{tmp_path}/in")
    for i, rows in enumerate(parts):
        made = f"{tmp_path}/made{i}"
        frame(rows, ROWS).coalesce(1).write.parquet(made)
        one = next(f for f in os.listdir(made) if f.endswith(".parquet"))
        os.rename(f"{made}/{one}", f"{tmp_path}/in/{i}.parquet")
        os.utime(f"{tmp_path}/in/{i}.parquet", (1e9 + i, 1e9 + i))
    calls = []

    def reports(rows):
        out = rows.groupBy("set_id").agg(F.array_sort(F.collect_list("v")).alias("v"))
        calls.append({r.set_id: r.v for r in out.collect()})
        return {"values": out, "counts": rows.groupBy("set_id").count()}

    def run():
        arriving = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        review_sets(arriving, reports, f"{tmp_path}/out", "5 days").awaitTermination()
    run()
    assert calls == [{2: [2]}, {1: [1, 3]}, {2: [2, 6], 3: [4]}, {}]
    got = set_reports(spark, f"{tmp_path}/out", ["values", "counts"])
    assert {r.set_id: r.v for r in got["values"].collect()} == {1: [1, 3], 2: [2, 6], 3: [4]}
    assert {r.set_id: r["count"] for r in got["counts"].collect()} == {1: 2, 2: 2, 3: 1}
    assert sorted(r.set_id for r in waiting_sets(spark, f"{tmp_path}/out").collect()) == [3, 4, 5]  # more of 3 came later
    run()  # nothing new: nothing reviewed
    assert len(calls) == 4
