"""Queries that run the streaming jobs over a table until all of it is read, with the SQL of their batch twins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lostfound.streaming import jobs as H

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that all executors share. Only where driver and executors are one process may it be a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex[:12]}"


def source(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream of reports."""
    own = spark.readStream.schema(EVENTS).parquet(f"{d}/events*.parquet")
    return own.select(F.col("event_id").alias("case_id"), F.col("ts").cast("timestamp").alias("reported_at"), (F.col("user_id") % 10).alias("center"), F.col("event_type").alias("status"), "user_id")


PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def drained(stream: DataFrame, mode: str = "append", path: str | None = None) -> DataFrame:
    """Runs the stream over what there is, writes its rows as Parquet and reads them again. The same ``path`` goes on where an earlier run ended."""
    spark = stream.sparkSession
    path = path or shared_dir(spark)
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def h1_stream_reports(s, d):
    from lostfound.plans.inputs import report_files

    return drained(H.stream_reports(s, report_files(s, d))).select("case_id", "type", "name_normalized", "reporting_center", "status", F.col("reported_at").cast("timestamp_ntz").alias("reported_at"))


def h1_stream_table(s, d):
    return drained(H.stream_table(s, f"{d}/events*.parquet", EVENTS, "ts")).select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


def h2_dedup(s, d):
    twice = source(s, d)
    return drained(H.dedup_reports(twice.union(source(s, d)), "1 hour")).select("case_id")


def h3_windowed_counts(s, d):
    return drained(H.windowed_counts(source(s, d), "1 day", "center")).select(F.col("slot_start").cast("timestamp_ntz").alias("slot_start"), "center", "cases")


def h4_surge_alerts(s, d):
    from lostfound.plans import registered as R

    base = R.reports(s, d).groupBy("center", F.date_trunc("hour", "reported_at").alias("slot")).agg(F.count("*").alias("n")).groupBy("center", F.hour("slot").alias("hour")).agg(F.avg("n").alias("usual"))
    counts = H.windowed_counts(source(s, d), "1 hour", "center")
    return drained(H.surge_alerts(counts, base, 1.5, "center")).select(F.col("slot_start").cast("timestamp_ntz").alias("slot_start"), "center", "cases")


def h5_sessions(s, d):
    return drained(H.center_sessions(source(s, d), "20 minutes", "center")).select("center", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "cases")


def h6_stream_match(s, d):
    own = source(s, d)
    other = source(s, d)
    return drained(H.stream_match(own.filter("status = 'error'"), other.filter("status = 'signup'"), "12 hours", "user_id")).select("missing_id", "found_id")


def h3_sliding_counts(s, d):
    slid = H.windowed_counts(source(s, d), "2 days", "center", "1 day")
    return drained(slid).select(F.col("slot_start").cast("timestamp_ntz").alias("slot_start"), F.col("slot_end").cast("timestamp_ntz").alias("slot_end"), "center", "cases")


def h6_stream_match_outer(s, d):
    """Errors with no signup of the user within an hour are emitted alone, once no partner can come any more."""
    out = drained(H.stream_match(source(s, d).filter("status = 'error'"), source(s, d).filter("status = 'signup'"), "1 hours", "user_id", how="left_outer"))
    # those near the end wait for the watermark
    return out.filter("found_id is not null").select("missing_id", "found_id").unionByName(out.filter("found_id is null").join(t_last(s, d), F.col("missing_at") <= F.col("_last") - F.expr("interval 24 hours")).select("missing_id", "found_id"))


def t_last(s, d):
    return F.broadcast(source_table(s, d).agg(F.max("reported_at").alias("_last")))


def source_table(s, d):
    return s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("case_id"), F.col("ts").cast("timestamp").alias("reported_at"))


def h7_parts(s, d):
    """Three uploads: a third of the reports; of the next third those more than six hours older than the newest before; all others."""
    own = source_table(s, d).withColumn("updated_at", F.col("reported_at"))
    newest = F.broadcast(own.filter("case_id % 3 = 0").agg(F.max("reported_at").alias("_newest")))
    old = (F.col("case_id") % 3 == 1) & (F.unix_seconds("_newest") - F.unix_seconds("reported_at") > 6 * 3600)
    part = F.when(F.col("case_id") % 3 == 0, 0).when(old, 1).otherwise(2)
    return own.crossJoin(newest).withColumn("part", part).drop("_newest")


def h7_run(s, d):
    """The uploads come one after the other; (path of the rows on time, path of the late ones)."""
    path = shared_dir(s)
    put = lambda name: lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/{name}/{number}")
    split = H.late_reports(put("now"), put("late"), 6, f"{path}/marks")
    rows = h7_parts(s, d)
    for i in range(3):
        rows.filter(F.col("part") == i).drop("part").write.mode("append").parquet(f"{path}/in")
        own = s.readStream.schema("case_id long, reported_at timestamp, updated_at timestamp").parquet(f"{path}/in")
        own.writeStream.foreachBatch(split).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return f"{path}/now/*", f"{path}/late/*"


def h7_late_reports(s, d):
    """The late rows of three uploads are merged into the registry afterwards; the second upload is late as a whole."""
    now, late = h7_run(s, d)
    late = s.read.parquet(late)
    merged = H.merge_late(s.read.parquet(now), late)
    return merged.join(late.select("case_id", F.round("delay_hours", 6).alias("delay_hours")), "case_id", "left").select("case_id", "delay_hours")


def h7_delays(s, d):
    late = s.read.parquet(h7_run(s, d)[1]).withColumn("center", F.col("case_id") % 10)
    return H.delay_statistics(late, "center").withColumns({f"{c}_hours": F.round(f"{c}_hours", 6) for c in ("mean", "p50", "p90", "max")})


def h8_case_tracker(s, d):
    """Reports before and after the middle of the time come as two uploads; state goes on from the first to the second."""
    path = shared_dir(s)
    e = s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("case_id"), F.col("ts").cast("timestamp").alias("reported_at"), (F.col("event_id") % 10).alias("center"), F.col("event_type").alias("status"))
    span = F.broadcast(e.agg(F.timestamp_seconds(F.floor((F.unix_seconds(F.min("reported_at")) + F.unix_seconds(F.max("reported_at"))) / 2)).alias("_middle")))
    rows = e.crossJoin(span)
    out = None
    for half in (F.col("reported_at") < F.col("_middle"), F.col("reported_at") >= F.col("_middle")):
        rows.filter(half).drop("_middle").write.mode("append").parquet(f"{path}/in")
        own = s.readStream.schema("case_id long, reported_at timestamp, center long, status string").parquet(f"{path}/in")
        out = drained(H.case_tracker(own, 24), path=path)
    return out


STREAM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (h1_stream_reports, h1_stream_table, h2_dedup, h3_windowed_counts, h3_sliding_counts, h4_surge_alerts, h5_sessions, h6_stream_match, h6_stream_match_outer, h7_late_reports, h7_delays, h8_case_tracker)}

# reports of all uploads but the first are late if they are more than six hours behind its newest
H7 = "n AS (SELECT max(ts) AS newest FROM events WHERE event_id % 3 = 0), d AS (SELECT event_id AS case_id, (floor(epoch(newest)) - floor(epoch(ts))) / 3600.0::DOUBLE AS delay FROM events, n), l AS (SELECT *, case_id % 3 <> 0 AND delay > 6 AS late FROM d)"

STREAM_ORACLE = {
    "h1_stream_reports": "SELECT CASE WHEN event_type = 'signup' THEN 'FOUND-' || lpad(event_id::VARCHAR, 9, '0') ELSE 'KMP-2027-' || lpad(event_id::VARCHAR, 9, '0') END AS case_id, CASE WHEN event_type = 'signup' THEN 'found' ELSE 'missing' END AS type, CASE WHEN event_id % 7 <> 0 THEN 'laxmi v' || user_id % 13 END AS name_normalized, 'Center ' || user_id % 10 AS reporting_center, CASE WHEN event_id % 4 = 0 THEN 'Reunited' ELSE 'Active' END AS status, CASE WHEN event_id % 50 <> 0 THEN date_trunc('minute', ts) END AS reported_at FROM events",
    "h1_stream_table": "SELECT event_id, ts FROM events",
    # of windows that overlap by a day, an append stream keeps those that ended before the watermark
    "h3_sliding_counts": "WITH w AS (SELECT date_trunc('day', ts) - INTERVAL 1 DAY * k AS slot_start, user_id % 10 AS center FROM events, (SELECT unnest([0, 1]) AS k)) SELECT slot_start, slot_start + INTERVAL 2 DAY AS slot_end, center, count(*) AS cases FROM w GROUP BY 1, 2, 3 HAVING slot_start + INTERVAL 2 DAY <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events)",
    "h6_stream_match_outer": "SELECT m.event_id AS missing_id, f.event_id AS found_id FROM events m LEFT JOIN events f ON m.user_id = f.user_id AND f.event_type = 'signup' AND f.ts BETWEEN m.ts - INTERVAL 1 HOUR AND m.ts + INTERVAL 1 HOUR WHERE m.event_type = 'error' AND (f.event_id IS NOT NULL OR m.ts <= (SELECT max(ts) - INTERVAL 24 HOUR FROM events))",
    "h7_late_reports": f"WITH {H7} SELECT case_id, CASE WHEN late THEN round(delay, 6) END AS delay_hours FROM l",
    "h7_delays": f"WITH {H7} SELECT case_id % 10 AS center, count(*) AS reports, round(avg(delay), 6) AS mean_hours, round(quantile_cont(delay, 0.5), 6) AS p50_hours, round(quantile_cont(delay, 0.9), 6) AS p90_hours, round(max(delay), 6) AS max_hours FROM l WHERE late GROUP BY 1",
    # a case is overdue, and forgotten, once the watermark is a day past its first report; the watermark is an hour behind the newest report of an upload
    "h8_case_tracker": """WITH e AS (SELECT user_id AS u, event_id % 10 AS c, event_type AS s, ts FROM events), m AS (SELECT make_timestamp(((floor(epoch(min(ts))) + floor(epoch(max(ts)))) // 2)::BIGINT * 1000000) AS mid FROM e),
        a AS (SELECT e.* FROM e, m WHERE ts < mid), b AS (SELECT e.* FROM e, m WHERE ts >= mid), k AS (SELECT u, count(DISTINCT c) AS n, arg_max(s, ts) AS s, min(ts) AS f FROM a GROUP BY 1), w AS (SELECT max(ts) - INTERVAL 1 HOUR AS w FROM a),
        o AS (SELECT k.* FROM k, w WHERE f + INTERVAL 24 HOUR <= w.w), x AS (SELECT * FROM b UNION ALL SELECT a.* FROM a WHERE u NOT IN (SELECT u FROM o)), y AS (SELECT u, count(DISTINCT c) AS n, arg_max(s, ts) AS s, min(ts) AS f, bool_or(ts >= (SELECT mid FROM m)) AS again FROM x GROUP BY 1),
        r AS (SELECT u, n, s, false AS o FROM k UNION ALL SELECT u, n, s, true FROM o UNION ALL SELECT u, n, s, false FROM y WHERE again UNION ALL SELECT u, n, s, true FROM y WHERE f + INTERVAL 24 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events))
        SELECT u AS case_id, n::INT AS centers, s AS status, o AS overdue FROM r""",
    "h2_dedup": "SELECT event_id AS case_id FROM events",
    "h5_sessions": "WITH x AS (SELECT user_id % 10 AS center, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 20 MINUTE THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id % 10 ORDER BY ts)), y AS (SELECT *, sum(n) OVER (PARTITION BY center ORDER BY ts) AS g FROM x) SELECT center, min(ts) AS session_start, count(*) AS cases FROM y GROUP BY center, g HAVING max(ts) + INTERVAL 20 MINUTE <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events)",
    "h6_stream_match": "SELECT m.event_id AS missing_id, f.event_id AS found_id FROM events m JOIN events f ON m.user_id = f.user_id AND f.ts BETWEEN m.ts - INTERVAL 12 HOUR AND m.ts + INTERVAL 12 HOUR WHERE m.event_type = 'error' AND f.event_type = 'signup'",
    # an append stream keeps the windows that the watermark (the newest report less an hour) has not passed
    "h3_windowed_counts": "SELECT date_trunc('day', ts) AS slot_start, user_id % 10 AS center, count(*) AS cases FROM events GROUP BY 1, 2 HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events)",
    "h4_surge_alerts": "WITH c AS (SELECT user_id % 10 AS center, date_trunc('hour', ts) AS slot_start, count(*) AS cases FROM events GROUP BY 1, 2), b AS (SELECT center, hour(slot_start) AS h, avg(cases) AS usual FROM c GROUP BY 1, 2) SELECT slot_start, c.center, cases FROM c JOIN b ON c.center = b.center AND hour(slot_start) = h WHERE cases > 1.5 * usual AND slot_start + INTERVAL 1 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events)",
}
