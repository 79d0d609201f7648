"""Readers and writers: reports, places, map placemarks, media, the registry (A, B1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lostfound.functions.columns import age_bounds, blank_to_null, map_status, normalize_mobile, normalize_name, parse_reported_at

# The columns of the input files, in file order.
REPORT_COLUMNS = ("case_id", "reported_at", "missing_person_name", "gender", "age_band", "state", "district", "language", "last_seen_location", "reporting_center", "reporter_mobile", "physical_description", "status", "resolution_hours", "is_duplicate_report", "remarks")
PLACE_COLUMNS = {
    "camera": "camera_id string, longitude double, latitude double",
    "zone": "zone_name string, centroid_lat double, centroid_lng double, approx_boundary_points int",
    "station": "station_name string, longitude double, latitude double",
    "point": "location_name string, category string, longitude double, latitude double",
}
PLACE_NAMES = {"camera_id": "name", "zone_name": "name", "station_name": "name", "location_name": "name", "longitude": "lng", "latitude": "lat", "centroid_lat": "lat", "centroid_lng": "lng"}
REPORT_SCHEMA = ", ".join(f"{c} string" for c in REPORT_COLUMNS) + ", _corrupt_record string"


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """The report CSV as text columns; rows that do not fit keep their line in ``_corrupt_record`` (A1).

    A quoted description or remark may hold line breaks. So a file is read by one task, and files are the units to deal out: a center's upload is one.
    """
    return spark.read.schema(REPORT_SCHEMA).csv(path, header=True, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record", quote='"', escape='"')


def read_places(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Cameras, zones, stations or points with ``name, lat, lng`` and what else the layout has (A2)."""
    return spark.read.schema(PLACE_COLUMNS[kind]).csv(path, header=True, quote='"', escape='"').withColumnsRenamed(PLACE_NAMES)


def read_placemarks(spark: SparkSession, path: str) -> DataFrame:
    """Placemarks of a KML map: name, lat, lng and the attributes of the description (A3). Only the point counts, never the camera's position."""
    schema = "name string, description string, Point struct<coordinates: string>"
    raw = spark.read.format("xml").option("rowTag", "Placemark").schema(schema).load(path)
    at = F.split(F.trim("Point.coordinates"), ",")
    facts = F.str_to_map("description", F.lit(r" \| "), F.lit(": "))
    cols = {k: F.try_element_at("_m", F.lit(k.capitalize())) for k in ("category", "status", "risk", "source", "note")}
    return raw.withColumn("_m", facts).select(F.trim("name").alias("name"), at[1].try_cast("double").alias("lat"), at[0].try_cast("double").alias("lng"), *[c.alias(k) for k, c in cols.items()])


def list_media(spark: SparkSession, path: str, cases: DataFrame | None = None, column: str = "photo_path") -> DataFrame:
    """Files under the folder ``path`` by their path in it, ``file``, and length, contents unread; with ``cases``, the cases whose file is not there (A4).

    Cases name a file by its path below the folder, so equal names in two folders are two files; a leading ``/`` or ``./`` doesn't count.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toUri().getPath().rstrip("/")
    # paths come with or without the name of the store; what follows the folder's own path is the file's
    below = F.substr(F.col("path"), F.locate(root + "/", F.col("path")) + F.lit(len(root) + 1))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", below.alias("file"), "length", "modificationTime")
    if cases is None:
        return files
    named = F.regexp_replace(F.col(column), r"^(\./|/)+", "")
    return cases.filter(F.col(column).isNotNull()).withColumn("_f", named).join(files.select(F.col("file").alias("_f")).distinct(), "_f", "left_anti").drop("_f")


def to_case(reports: DataFrame) -> DataFrame:
    """Raw reports to canonical cases (B1)."""
    r = blank_to_null(reports.select(*REPORT_COLUMNS), list(REPORT_COLUMNS))
    text = lambda n: F.lit(None).cast("string").alias(n)
    return r.select(
        "case_id",
        F.when(F.col("case_id").startswith("FOUND-"), "found").otherwise("missing").alias("type"),
        F.col("missing_person_name").alias("name"),
        normalize_name(F.col("missing_person_name")).alias("name_normalized"),
        "gender", "age_band", age_bounds(F.col("age_band")).alias("age"), "language", "state", "district", "last_seen_location",
        F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng"), text("zone"), "reporting_center",
        normalize_mobile(F.col("reporter_mobile")).alias("reporter_mobile"),
        "physical_description", text("photo_path"), text("audio_path"), text("transcript"), text("transcript_en"),
        F.lit(None).cast("array<float>").alias("face_embedding"),
        map_status(F.col("status")).alias("status"),
        parse_reported_at(F.col("reported_at")).alias("reported_at"),
        "remarks",
        F.col("status").alias("source_status"),
        F.col("resolution_hours").try_cast("double").alias("resolution_hours"),
        F.col("is_duplicate_report").try_cast("boolean").alias("is_duplicate_report"),
    )


#: Cases of a date in a file of the registry, on average.
FILE_ROWS = 500_000


def write_registry(cases: DataFrame, path: str, rows: int = FILE_ROWS) -> None:
    """The registry by report date; only the dates of ``cases`` are replaced, so a rerun gives the same table (A5).

    A date is one file, a busy one, as that of the cases without a date, a file for each ``rows`` cases.
    """
    dated = cases.withColumn("report_date", F.to_date("reported_at"))
    day = F.coalesce(F.col("report_date").cast("string"), F.lit("none"))
    busy = dated.groupBy(day.alias("_day")).agg(F.ceil(F.count("*") / rows).cast("int").alias("_m")).filter("_m > 1")
    part = F.pmod(F.xxhash64("case_id"), F.coalesce(F.col("_m"), F.lit(1)))
    dealt = dated.withColumn("_day", day).join(F.broadcast(busy), "_day", "left").withColumn("_part", part)  # a row for each busy date
    dealt.repartition("_day", "_part").drop("_day", "_m", "_part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("report_date").parquet(path)
