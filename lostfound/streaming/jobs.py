"""Streams of reports: late and repeated uploads, windows, alerts, sessions, matches and tracking (H)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lostfound.operators.matching import merge_reports
from lostfound.sources.files import REPORT_SCHEMA, to_case


def stream_reports(spark: SparkSession, path: str, files_per_trigger: int = 1_000) -> DataFrame:
    """Report files that centers drop under ``path``, as canonical cases (H1)."""
    raw = spark.readStream.schema(REPORT_SCHEMA).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("maxFilesPerTrigger", files_per_trigger).csv(path)
    return to_case(raw)


def stream_table(spark: SparkSession, path: str, schema: str, at: str) -> DataFrame:
    """A folder of Parquet files as a stream with event time ``at`` as a timestamp."""
    return spark.readStream.schema(schema).parquet(path).withColumn(at, F.col(at).cast("timestamp"))


def dedup_reports(stream: DataFrame, delay: str, key: str = "case_id", at: str = "reported_at") -> DataFrame:
    """Resent uploads of one case within ``delay`` are dropped (H2)."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, size: str, by: str, slide: str | None = None, delay: str = "1 hour", at: str = "reported_at") -> DataFrame:
    """(slot_start, slot_end, by, cases) of tumbling or sliding windows (H3)."""
    slot = F.window(at, size, slide) if slide else F.window(at, size)
    counts = stream.withWatermark(at, delay).groupBy(slot.alias("_w"), by).agg(F.count("*").alias("cases"))
    return counts.select(F.col("_w.start").alias("slot_start"), F.col("_w.end").alias("slot_end"), by, "cases")


def surge_alerts(counts: DataFrame, baseline: DataFrame, factor: float, by: str) -> DataFrame:
    """Windows above ``factor`` x the static baseline of their group and hour of day (H4). ``baseline`` has (by, hour, usual)."""
    return counts.withColumn("hour", F.hour("slot_start")).join(baseline, [by, "hour"]).filter(F.col("cases") > factor * F.col("usual"))


def center_sessions(stream: DataFrame, gap: str, by: str, delay: str = "1 hour", at: str = "reported_at") -> DataFrame:
    """(by, session_start, session_end, cases): bursts that a silence of ``gap`` ends (H5)."""
    s = stream.withWatermark(at, delay).groupBy(F.session_window(at, gap).alias("_s"), by).agg(F.count("*").alias("cases"))
    return s.select(by, F.col("_s.start").alias("session_start"), F.col("_s.end").alias("session_end"), "cases")


def stream_match(missing: DataFrame, found: DataFrame, window: str, block: str, delay: str = "1 hour", how: str = "inner", id_: str = "case_id", at: str = "reported_at") -> DataFrame:
    """Missing and found cases of one block within ``window``, as they arrive; ``left_outer`` also emits the unmatched, late (H6)."""
    m = missing.select(F.col(id_).alias("missing_id"), F.col(at).alias("missing_at"), F.col(block).alias("_bm")).withWatermark("missing_at", delay)
    f = found.select(F.col(id_).alias("found_id"), F.col(at).alias("found_at"), F.col(block).alias("_bf")).withWatermark("found_at", delay)
    near = F.expr(f"_bm = _bf AND found_at BETWEEN missing_at - interval {window} AND missing_at + interval {window}")
    return m.join(f, near, how).select("missing_id", "found_id", "missing_at", "found_at")


def late_reports(merge: Callable[[DataFrame, int], None], late: Callable[[DataFrame, int], None], delay_hours: float, marks: str, at: str = "reported_at") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: rows more than ``delay_hours`` behind the newest report of all earlier batches, with ``delay_hours`` behind it, go to ``late``, the others to ``merge`` (H7).

    So a center's whole batch of old reports is late, as it is for the stream's own watermark. The newest time up to each batch is kept under ``marks``, a folder that
    belongs to the query as its checkpoint does; a batch that is run again after a failure reads the mark before it and is split alike. The first
    batch has no late rows; rows without a time are never late. A batch is computed once.
    """

    def split(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _mark(spark, f"{marks}/{number - 1}")
        held = batch.persist()
        try:
            newest = held.agg(F.max(F.col(at).cast("timestamp")).alias("newest"))
            known = newest if before is None else newest.unionByName(before)
            known.agg(F.max("newest").alias("newest")).coalesce(1).write.mode("overwrite").parquet(f"{marks}/{number}")
            if before is None:
                merge(held, number)
                return
            behind = (F.unix_seconds("_newest") - F.unix_seconds(F.col(at).cast("timestamp"))) / 3600.0
            marked = held.crossJoin(F.broadcast(before.withColumnRenamed("newest", "_newest"))).withColumn("delay_hours", behind).drop("_newest")
            is_late = F.coalesce(F.col("delay_hours") > delay_hours, F.lit(False))
            merge(marked.filter(~is_late).drop("delay_hours"), number)
            late(marked.filter(is_late), number)
        finally:
            held.unpersist()

    return split


def _mark(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest time up to a batch, one row; None before the first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema("newest timestamp").parquet(path)


def delay_statistics(late: DataFrame, by: str) -> DataFrame:
    """(by, reports, mean_hours, p50_hours, p90_hours, max_hours) of late reports (H7)."""
    h = F.col("delay_hours")
    return late.groupBy(by).agg(F.count("*").alias("reports"), F.avg(h).alias("mean_hours"), F.percentile(h, F.lit(0.5)).alias("p50_hours"), F.percentile(h, F.lit(0.9)).alias("p90_hours"), F.max(h).alias("max_hours"))


def merge_late(registry: DataFrame, late: DataFrame, key: str = "case_id", version: str = "updated_at") -> DataFrame:
    """Late rows merged into the registry, newest version first."""
    return merge_reports(registry, late.drop("delay_hours"), key, version)


class CaseTracker(StatefulProcessor):
    """First report, centers and last status of each case; a timer emits cases still open after ``hours`` and frees their state (H8).

    The centers of a case are a map in the state store, one entry each; the status is that of the newest report, in whatever order reports arrive.
    """

    def __init__(self, hours: float) -> None:
        self.hours = hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("case", "first_ms long, last_ms long, status string, n_centers int")
        self.centers = handle.getMapState("centers", "center string", "reports long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        old = self.state.get() if self.state.exists() else None
        first, last, status, n = old if old else (None, None, None, 0)
        for pdf in rows:
            at = [int(t.timestamp() * 1000) for t in pdf["reported_at"]]
            first = min([*at, *([first] if first is not None else [])])
            newest = max(range(len(at)), key=at.__getitem__)
            if last is None or at[newest] >= last:
                last, status = at[newest], str(pdf["status"].iloc[newest])
            for center, reports in pdf["center"].astype(str).value_counts().items():
                known = self.centers.getValue((center,))[0] if self.centers.containsKey((center,)) else 0
                n += not known
                self.centers.updateValue((center,), (known + int(reports),))
        if old is None:
            self.handle.registerTimer(first + int(self.hours * 3_600_000))
        self.state.update((first, last, status, n))
        yield pd.DataFrame({"case_id": [key[0]], "centers": [n], "status": [status], "overdue": [False]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.state.exists():
            return
        _, _, status, n = self.state.get()
        self.state.clear()  # a case that is reported again begins anew
        self.centers.clear()
        if status != "Reunited":
            yield pd.DataFrame({"case_id": [key[0]], "centers": [n], "status": [status], "overdue": [True]})

    def close(self) -> None:
        pass


def case_tracker(stream: DataFrame, hours: float, delay: str = "1 hour") -> DataFrame:
    """(case_id, centers, status, overdue) as reports come and as cases become overdue (H8). The stream has case_id, reported_at, center, status; state is kept in RocksDB."""
    out = "case_id long, centers int, status string, overdue boolean"
    return stream.withWatermark("reported_at", delay).groupBy("case_id").transformWithStateInPandas(CaseTracker(hours), out, "Append", "EventTime")
