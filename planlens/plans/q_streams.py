"""Registered queries: the job stream and newly arriving sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from planlens.operators import claims as C, register as RG
from planlens.operators.helpers import attach
from planlens.plans.q_claims import claim_pairs, folder
from planlens.plans.registry import query, table
from planlens.sources.catalog import catalog
from planlens.streaming import jobs as J
from planlens.streaming.review import review_stream, reviewed
from planlens.streaming.sets import review_sets, set_reports, waiting_sets


def shaped(df):
    """The event table as job events: a signup is a submission, a purchase its end."""
    ev = (F.when(F.col("event_type") == "signup", "accepted").when(F.col("event_type") == "purchase", "done")
          .when(F.col("event_type") == "error", "error").otherwise("seen"))
    return df.select(F.col("event_id").alias("job_id"), F.col("user_id").alias("uid"), F.col("ts").cast("timestamp").alias("ts"), ev.alias("event"),
                     F.when(F.col("user_id") % 3 == 0, "dwg").otherwise("pdf").alias("source_format"))


def events(spark, d):
    return shaped(table(spark, d, "events"))


def event_stream(spark, d, name="events"):
    schema = table(spark, d, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


EV = """WITH e AS (SELECT event_id AS job_id, user_id AS uid, ts, CASE event_type WHEN 'signup' THEN 'accepted' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' ELSE 'seen' END AS event FROM events)
"""


@query("st_limits", EV + """,
r AS (SELECT *, coalesce(sum(CASE event WHEN 'accepted' THEN 1 WHEN 'done' THEN -1 WHEN 'error' THEN -1 ELSE 0 END) OVER (PARTITION BY uid ORDER BY ts, job_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS active,
        count(*) FILTER (WHERE event = 'accepted') OVER (PARTITION BY uid ORDER BY epoch(ts) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) - 1 AS recent FROM e)
SELECT job_id, CAST(active AS BIGINT) AS active, recent, active >= 3 OR recent >= 10 AS refused FROM r WHERE event = 'accepted'""")
def st_limits(spark, d):
    return J.pressure(events(spark, d)).select("job_id", "active", "recent", "refused")


@query("st_limits_stream", """WITH RECURSIVE e AS (SELECT event_id AS seq, user_id AS uid, ts, event_type = 'signup' AS asks FROM events WHERE event_type IN ('signup', 'purchase', 'error')),
s AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY ts, seq) AS n FROM e),
f AS (SELECT DISTINCT uid, 0::BIGINT AS n, NULL::BIGINT AS seq, false AS asks, []::TIMESTAMP[] AS recent, 0 AS open, 0 AS active, 0 AS had, false AS ok FROM s
  UNION ALL
  SELECT uid, n, seq, asks, CASE WHEN ok THEN list_append(r, ts) ELSE r END, CASE WHEN NOT asks THEN greatest(0, open - 1) WHEN ok THEN open + 1 ELSE open END, open, len(r)::INTEGER, ok
  FROM (SELECT *, asks AND open < 3 AND len(r) < 10 AS ok FROM (
    SELECT s.uid, s.n, s.seq, s.asks, s.ts, f.open, CASE WHEN s.asks THEN list_filter(f.recent, lambda t: t > s.ts - INTERVAL 1 HOUR) ELSE f.recent END AS r FROM f JOIN s ON s.uid = f.uid AND s.n = f.n + 1)))
SELECT seq, active, had AS recent, ok AS admitted FROM f WHERE asks""")
def st_limits_stream(spark, d):
    """The exact, stateful decision on each submission."""
    out = J.run_to_end(J.admission(shaped(event_stream(spark, d))), folder(spark, "limits"))
    return out.select("seq", "active", "recent", "admitted")


@query("st_hourly", EV + """,
m AS (SELECT max(ts) AS top FROM e WHERE event = 'accepted'),
w AS (SELECT uid, ts, unnest(generate_series(0, 11)) AS i, time_bucket(INTERVAL '5 minutes', ts, TIMESTAMP '1970-01-01') AS b FROM e WHERE event = 'accepted'),
x AS (SELECT uid, b - INTERVAL '5 minutes' * i AS start FROM w)
SELECT CAST(epoch(start) AS BIGINT) AS start, uid, count(*) AS n FROM x, m WHERE start + INTERVAL '1 hour' <= date_trunc('millisecond', m.top) - INTERVAL '10 minutes' GROUP BY start, uid""")
def st_hourly(spark, d):
    """The stream's closed windows."""
    out = J.run_to_end(J.hourly_counts(shaped(event_stream(spark, d))), folder(spark, "hourly"))
    return out.select(F.col("start").cast("bigint").alias("start"), "uid", "n")


def day_jobs(df):
    """A user's day as one job."""
    day = F.date_format("ts", "yyyy-MM-dd")
    return df.withColumn("seq", F.col("job_id")).withColumn("job_id", F.concat_ws("-", F.col("uid").cast("string"), day))


DAYS = EV + """, j AS (SELECT CAST(uid AS VARCHAR) || '-' || strftime(ts, '%Y-%m-%d') AS job_id, uid, ts, event, job_id AS seq FROM e)
"""


@query("st_stale", DAYS + """,
s AS (SELECT job_id, uid, min(ts) AS started FROM j WHERE event = 'accepted' GROUP BY job_id, uid)
SELECT job_id FROM s WHERE NOT EXISTS (SELECT 1 FROM j WHERE j.job_id = s.job_id AND event IN ('done', 'error'))
  AND epoch((SELECT max(ts) FROM e) - started) / 60 > CASE WHEN uid % 3 = 0 THEN 60 ELSE 15 END""")
def st_stale(spark, d):
    e = day_jobs(events(spark, d))
    now = e.agg(F.max("ts").alias("now"))  # one row: the time of asking
    return J.stale_jobs(attach(e, now), F.col("now")).select("job_id")


@query("st_expiring_stream", DAYS + """,
g AS (SELECT job_id, min(ts) FILTER (WHERE event = 'accepted') AS s, min(ts) FILTER (WHERE event IN ('done', 'error')) AS o, max(CASE WHEN uid % 3 = 0 THEN 60 ELSE 15 END) AS mins
      FROM j WHERE event <> 'seen' GROUP BY job_id)
SELECT job_id, 'interrupted' AS reason FROM g
WHERE epoch_ms(s) + mins * 60000 < (SELECT epoch_ms(max(ts)) FROM e WHERE event <> 'seen') - 60000 AND (o IS NULL OR o > s + to_minutes(mins))""")
def st_expiring_stream(spark, d):
    """Jobs whose time ran out as event time passed."""
    s = day_jobs(shaped(event_stream(spark, d)))
    return J.run_to_end(J.expiring_jobs(s), folder(spark, "expiring"))


@query("st_history", EV + """
SELECT uid, job_id, CAST(n AS INTEGER) AS n FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY ts DESC, job_id DESC) AS n FROM e WHERE event = 'accepted') WHERE n <= 5""")
def st_history(spark, d):
    jobs = events(spark, d).where("event = 'accepted'").withColumn("created_at", F.col("ts"))
    return J.history(jobs, 5).select("uid", "job_id", "n")


@query("st_job_snapshot", DAYS + """
SELECT job_id, arg_max(CASE event WHEN 'accepted' THEN 'running' ELSE event END, ROW(ts, seq)) AS state, round(epoch(max(ts)) - epoch(min(ts)), 3) AS elapsed FROM j GROUP BY job_id""")
def st_job_snapshot(spark, d):
    return J.job_snapshot(day_jobs(events(spark, d))).select("job_id", "state", "elapsed")


@query("st_replay", """
WITH w AS (SELECT event_id, user_id AS content, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'view'),
dn AS (SELECT DISTINCT user_id AS content, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'purchase' AND value >= 10)
SELECT event_id FROM w WHERE NOT EXISTS (SELECT 1 FROM dn WHERE dn.content = w.content AND dn.day = w.day)""")
def st_replay(spark, d):
    e = table(spark, d, "events").withColumn("day", F.to_date("ts")).withColumn("content", F.col("user_id"))
    err = F.when(F.col("value") < 5, "failed: timeout").when(F.col("value") < 10, "past the deadline").otherwise("")
    done = e.where("event_type = 'purchase'").withColumn("error", err)
    return J.unseen(e.where("event_type = 'view'"), done, ["content", "day"]).select("event_id")


@query("st_replay_stream", "SELECT DISTINCT user_id AS uid, event_type AS kind FROM events")
def st_replay_stream(spark, d):
    s = event_stream(spark, d).select(F.col("user_id").alias("uid"), F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("ts"))
    return J.run_to_end(J.unseen_stream(s, ["uid", "kind"], "400 days"), folder(spark, "replay")).select("uid", "kind")


@query("st_incremental", """
SELECT l_orderkey AS set_id, sum(CASE l_suppkey % 8 WHEN 0 THEN 1 WHEN 1 THEN CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END WHEN 2 THEN 2 WHEN 4 THEN CASE WHEN floor(l_quantity) >= 2 THEN 1 ELSE 0 END
   WHEN 5 THEN 1 ELSE 0 END)::BIGINT AS n FROM lineitem GROUP BY l_orderkey HAVING n > 0""")
def st_incremental(spark, d):
    """Order lines arrive as sets of pairs; the stream's claims must equal one batch run."""
    at = folder(spark, "incremental")
    cat = catalog(spark)

    def one(batch):
        return C.claims_from_pairs(claim_pairs_of(batch), cat).select("set_id", "field", "role", "value_num", "value_str")
    review_stream(event_stream(spark, d, "lineitem"), one, at).awaitTermination()
    return reviewed(spark, at).groupBy("set_id").agg(F.count(F.lit(1)).alias("n"))


def claim_pairs_of(batch):
    return claim_pairs(batch.sparkSession, None, batch)


@query("st_set_reviews", """
WITH s AS (SELECT l_orderkey AS set_id, max(l_shipdate) AS last, bool_or(l_returnflag = 'R') AS ended, count(*) AS findings_count,
  count(*) FILTER (WHERE l_quantity >= 40) AS n_critical, count(*) FILTER (WHERE l_linestatus = 'O') AS n_open, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY l_orderkey)
SELECT set_id, findings_count, n_critical, n_open, quantity FROM s WHERE ended OR last <= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 200 DAY""")
def st_set_reviews(spark, d):
    """Order lines arrive by date in four files; an order is complete at a returned line or 200 days after its last. What is reviewed equals one batch run."""
    at = folder(spark, "sets")
    lines = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("set_id"), F.col("l_shipdate").cast("timestamp").alias("at"), (F.col("l_returnflag") == "R").alias("ended"),
        F.when(F.col("l_linestatus") == "O", "OPEN").otherwise("PASS").alias("status"), F.when(F.col("l_quantity") >= 40, "CRITICAL").otherwise("LOW").alias("severity"), "l_quantity")
    lines.repartitionByRange(4, "at").write.parquet(f"{at}/in")

    def reports(rows):
        return {"findings": rows.select("set_id", "status", "severity", "l_quantity"), "summary": RG.summary(rows)}
    arriving = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    review_sets(arriving, reports, at, "200 days").awaitTermination()
    got, open_ = set_reports(spark, at, ["findings", "summary"]), waiting_sets(spark, at)
    total = got["findings"].groupBy("set_id").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return got["summary"].select("set_id", "findings_count", "n_critical", "n_open").join(total, "set_id").join(open_, "set_id", "left_anti")
