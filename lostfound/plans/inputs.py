"""Queries of the readers, the writers and what they normalise (A, B), over report, place and map files that Spark writes from the tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lostfound.functions import columns as C
from lostfound.operators import geo as G
from lostfound.operators import matching as M
from lostfound.plans.streams import shared_dir
from lostfound.sources import files as S

# Age bands of the two kinds of records and the states of a case.
BANDS = ("0-12", "13-17", "18-40", "41-60", "61-70", "71-80", "80+")
OTHER_BANDS = ("0-12", "13-25", "26-40", "41-60", "61-70", "71-80", "80+")
STATES = ("Reunited", "Pending", "Transferred to hospital", "Unresolved")


def pick(values: tuple[str, ...], index):
    """The value at ``index`` (from 0)."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def picked(values: tuple[str, ...], index: str) -> str:
    """:func:`pick` in SQL."""
    return f"list_extract([{', '.join(repr(v) for v in values)}], ({index} + 1)::INT)"


def report_files(s: SparkSession, d: str) -> str:
    """Events as report files, with blank names and mobiles, bad times and found persons among them."""
    e = s.read.parquet(f"{d}/events.parquet")
    i, u = F.col("event_id"), F.col("user_id")
    rows = e.select(
        F.when(F.col("event_type") == "signup", F.concat(F.lit("FOUND-"), F.lpad(i.cast("string"), 9, "0"))).otherwise(F.concat(F.lit("KMP-2027-"), F.lpad(i.cast("string"), 9, "0"))).alias("case_id"),
        F.when(i % 50 == 0, F.lit("not known")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm")).alias("reported_at"),
        F.when(i % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("Lakshmi, W"), (u % 13).cast("string"))).alias("missing_person_name"),
        pick(("Male", "Female", "Unknown"), i % 3).alias("gender"),
        pick(BANDS, u % 7).alias("age_band"),
        F.lit("Maharashtra").alias("state"),
        F.concat(F.lit("District "), (u % 5).cast("string")).alias("district"),
        pick(("Marathi", "Hindi", "Gujarati"), u % 3).alias("language"),
        F.concat(F.lit('Ghat "'), (i % 11).cast("string"), F.lit('"')).alias("last_seen_location"),
        F.concat(F.lit("Center "), (u % 10).cast("string")).alias("reporting_center"),
        F.when(i % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("+91 98"), F.lpad(u.cast("string"), 8, "0"))).alias("reporter_mobile"),
        F.when(i % 4 == 1, F.lit('red saree,\n"old" bag')).otherwise(F.lit("red saree, old bag")).alias("physical_description"),
        pick(STATES, i % 4).alias("status"),
        F.when(i % 4 == 0, F.col("value")).alias("resolution_hours"),
        pick(("true", "false"), i % 2).alias("is_duplicate_report"),
        F.when(i % 6 == 0, F.concat(F.lit("seen\nnear gate "), (i % 9).cast("string"))).alias("remarks"),
    )
    path = f"{shared_dir(s)}/reports"
    rows.write.option("header", True).option("escape", '"').csv(path)
    return path


CASE_ID = "CASE WHEN event_type = 'signup' THEN 'FOUND-' || lpad(event_id::VARCHAR, 9, '0') ELSE 'KMP-2027-' || lpad(event_id::VARCHAR, 9, '0') END"
STATUS = picked(STATES, "event_id % 4")


def a1_read_cases(s, d):
    return S.read_cases(s, report_files(s, d)).select("case_id", "reported_at", "missing_person_name", "last_seen_location", "physical_description", "remarks", "status", F.col("_corrupt_record").isNull().alias("whole"))


def b1_to_case(s, d):
    case = S.to_case(S.read_cases(s, report_files(s, d)))
    hours = F.round("resolution_hours", 6).alias("resolution_hours")
    return case.select("case_id", "type", "name", "name_normalized", "gender", F.col("age.low").alias("low"), F.col("age.high").alias("high"), "language", "district", "reporting_center", "reporter_mobile", "status", F.col("reported_at").cast("timestamp_ntz").alias("reported_at"), "source_status", hours, "is_duplicate_report")


def b2_unify_registry(s, d):
    case = S.to_case(S.read_cases(s, report_files(s, d)))
    odd = F.regexp_extract("case_id", r"(\d+)$", 1).cast("long") % 2 == 1
    return M.unify_registry(case.filter(odd).select("case_id", "district", "status"), case.filter(~odd).select("status", "case_id"))


def b3_blank_to_null(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    kind = F.col("event_id") % 5
    text = F.when(kind == 0, F.lit(" \t ")).when(kind == 1, F.concat(F.lit(" \n"), F.col("event_type"), F.lit("\t "))).when(kind == 2, F.lit("\r\n")).when(kind == 3, F.lit("\u00a0\u3000")).otherwise(F.lit(""))
    return C.blank_to_null(e.select("event_id", text.alias("remarks")), ["remarks"])


def b8_ids(s, d):
    c = s.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.concat(F.lit("Z"), (F.col("c_custkey") % 32 + 1).cast("string"), F.lit("-C"), F.col("c_custkey").cast("string")).alias("camera"), F.when(F.col("c_custkey") % 9 == 0, "Sector 4").otherwise(F.concat(F.lit("Zone Area "), (F.col("c_custkey") % 32 + 1).cast("string"))).alias("area"))
    by_camera = C.parse_ids(c, None, camera_id="camera").withColumnRenamed("zone_no", "camera_zone")
    return C.parse_ids(by_camera, None, zone="area").select("c_custkey", "camera_zone", "camera_no", "zone_no")


def b9_place_aliases(s, d):
    c = s.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("Ghat "), F.col("c_custkey").cast("string"), F.lit(" / Old ghat / "), F.col("c_mktsegment"))).otherwise(F.col("c_name")).alias("name"))
    return G.place_aliases(c).select("c_custkey", "alias")


def a2_read_places(s, d):
    n, c = s.read.parquet(f"{d}/nation.parquet"), s.read.parquet(f"{d}/customer.parquet")
    base = shared_dir(s)
    lat, lng = (F.lit(19.5) + F.col("c_custkey") % 7).alias("latitude"), (F.lit(73.25) + F.col("c_custkey") % 5).alias("longitude")
    tables = {
        "camera": c.select(F.concat(F.lit("Z1-C"), F.col("c_custkey").cast("string")).alias("camera_id"), lng, lat),
        "zone": n.select(F.concat(F.lit("Zone Area "), F.col("n_nationkey").cast("string")).alias("zone_name"), (F.lit(20.0) + F.col("n_nationkey")).alias("centroid_lat"), (F.lit(73.0) + F.col("n_nationkey")).alias("centroid_lng"), F.lit(4).alias("approx_boundary_points")),
        "station": c.filter("c_custkey % 3 = 0").select(F.concat(F.col("c_name"), F.lit(", station")).alias("station_name"), lng, lat),
        "point": c.filter("c_custkey % 3 = 1").select(F.col("c_name").alias("location_name"), F.col("c_mktsegment").alias("category"), lng, lat),
    }
    out = None
    for kind, table in tables.items():
        table.write.option("header", True).option("escape", '"').csv(f"{base}/{kind}")
        own = S.read_places(s, f"{base}/{kind}", kind).select(F.lit(kind).alias("kind"), "name", "lat", "lng")
        out = own if out is None else out.unionByName(own)
    return out


def a3_read_placemarks(s, d):
    c = s.read.parquet(f"{d}/customer.parquet")
    k = F.col("c_custkey").cast("string")
    facts = F.concat(F.lit("Category: "), F.col("c_mktsegment"), F.when(F.col("c_custkey") % 2 == 0, F.lit(" | Status: open | Risk: high")).otherwise(F.lit(" | Note: narrow")))
    mark = F.concat(F.lit("<Placemark><name> "), F.col("c_name"), F.lit(" </name><description>"), facts, F.lit("</description><LookAt><longitude>1</longitude><latitude>2</latitude></LookAt><Point><coordinates>"), (F.lit(73.5) + F.col("c_custkey") % 4).cast("string"), F.lit(","), (F.lit(19.5) + F.col("c_custkey") % 8).cast("string"), F.lit(",0</coordinates></Point></Placemark>"))
    path = f"{shared_dir(s)}/map"
    # a map file is one document: a row, and so a file, for each part
    parts = c.select((F.col("c_custkey") % 16).alias("part"), mark.alias("m")).groupBy("part").agg(F.concat(F.lit("<kml><Document>"), F.array_join(F.collect_list("m"), "\n"), F.lit("</Document></kml>")).alias("value"))
    parts.write.partitionBy("part").text(path)
    return S.read_placemarks(s, f"{path}/*")


def a4_list_media(s, d):
    """Each center has a folder of files with the same names; every third report names its center's file in the folder of a center that has none."""
    e = s.read.parquet(f"{d}/events.parquet").select("event_id", (F.col("user_id") % 10).alias("center"))
    path = f"{shared_dir(s)}/media"
    e.select("center").distinct().select(F.lit("a picture").alias("value"), "center").coalesce(1).write.partitionBy("center").text(path)
    name = S.list_media(s, path).agg(F.min(F.element_at(F.split("file", "/"), -1)).alias("name"))
    folder = F.concat(F.lit("center="), (F.col("center") + F.when(F.col("event_id") % 3 == 0, 10).otherwise(0)).cast("string"))
    cases = e.crossJoin(F.broadcast(name)).select("event_id", F.when(F.col("event_id") % 7 != 0, F.concat(F.when(F.col("event_id") % 2 == 0, "/").otherwise(""), folder, F.lit("/"), F.col("name"))).alias("photo_path"))
    return S.list_media(s, path, cases).select("event_id", F.regexp_extract("photo_path", "(center=[0-9]+)", 1).alias("folder"))


def a5_write_registry(s, d):
    case = S.to_case(S.read_cases(s, report_files(s, d)))
    path = f"{shared_dir(s)}/registry-{uuid.uuid4().hex[:8]}"
    S.write_registry(case, path)
    S.write_registry(case.filter(F.dayofmonth("reported_at") <= 10), path)  # the days of a rerun are replaced, the others stay
    return s.read.parquet(path).select("case_id", "report_date", "status")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (a1_read_cases, a2_read_places, a3_read_placemarks, a4_list_media, a5_write_registry, b1_to_case, b2_unify_registry, b3_blank_to_null, b8_ids, b9_place_aliases)}

_NAME = "CASE WHEN event_id % 7 <> 0 THEN 'Lakshmi, W' || user_id % 13 END"
ORACLE = {
    "a1_read_cases": f"""SELECT {CASE_ID} AS case_id, CASE WHEN event_id % 50 = 0 THEN 'not known' ELSE strftime(ts, '%Y-%m-%d %H:%M') END AS reported_at, {_NAME} AS missing_person_name, 'Ghat "' || event_id % 11 || '"' AS last_seen_location, CASE WHEN event_id % 4 = 1 THEN 'red saree,' || chr(10) || '"old" bag' ELSE 'red saree, old bag' END AS physical_description, CASE WHEN event_id % 6 = 0 THEN 'seen' || chr(10) || 'near gate ' || event_id % 9 END AS remarks, {STATUS} AS status, true AS whole FROM events""",
    "b1_to_case": f"""SELECT {CASE_ID} AS case_id, CASE WHEN event_type = 'signup' THEN 'found' ELSE 'missing' END AS type, {_NAME} AS name, CASE WHEN event_id % 7 <> 0 THEN 'laxmi v' || user_id % 13 END AS name_normalized, {picked(("Male", "Female", "Unknown"), "event_id % 3")} AS gender,
        regexp_extract({picked(BANDS, "user_id % 7")}, '^\\d+')::INT AS low, nullif(regexp_extract({picked(BANDS, "user_id % 7")}, '-(\\d+)$', 1), '')::INT AS high, {picked(("Marathi", "Hindi", "Gujarati"), "user_id % 3")} AS language, 'District ' || user_id % 5 AS district, 'Center ' || user_id % 10 AS reporting_center,
        CASE WHEN event_id % 5 <> 0 THEN '98' || lpad(user_id::VARCHAR, 8, '0') END AS reporter_mobile, CASE WHEN event_id % 4 = 0 THEN 'Reunited' ELSE 'Active' END AS status, CASE WHEN event_id % 50 <> 0 THEN date_trunc('minute', ts) END AS reported_at, {STATUS} AS source_status,
        CASE WHEN event_id % 4 = 0 THEN round(value, 6) END AS resolution_hours, event_id % 2 = 0 AS is_duplicate_report FROM events""",
    "b2_unify_registry": f"SELECT {CASE_ID} AS case_id, CASE WHEN event_id % 2 = 1 THEN 'District ' || user_id % 5 END AS district, CASE WHEN event_id % 4 = 0 THEN 'Reunited' ELSE 'Active' END AS status FROM events",
    "b3_blank_to_null": "SELECT event_id, CASE WHEN event_id % 5 = 1 THEN event_type END AS remarks FROM events",
    "b8_ids": "SELECT c_custkey, (c_custkey % 32 + 1)::INT AS camera_zone, c_custkey::INT AS camera_no, CASE WHEN c_custkey % 9 <> 0 THEN (c_custkey % 32 + 1)::INT END AS zone_no FROM customer",
    "b9_place_aliases": "SELECT c_custkey, unnest(CASE WHEN c_custkey % 4 = 0 THEN ['Ghat ' || c_custkey, 'Old ghat', c_mktsegment] ELSE [c_name] END) AS alias FROM customer",
    "a2_read_places": """SELECT 'camera' AS kind, 'Z1-C' || c_custkey AS name, 19.5::DOUBLE + c_custkey % 7 AS lat, 73.25::DOUBLE + c_custkey % 5 AS lng FROM customer
        UNION ALL SELECT 'zone', 'Zone Area ' || n_nationkey, 20.0::DOUBLE + n_nationkey, 73.0::DOUBLE + n_nationkey FROM nation
        UNION ALL SELECT 'station', c_name || ', station', 19.5::DOUBLE + c_custkey % 7, 73.25::DOUBLE + c_custkey % 5 FROM customer WHERE c_custkey % 3 = 0
        UNION ALL SELECT 'point', c_name, 19.5::DOUBLE + c_custkey % 7, 73.25::DOUBLE + c_custkey % 5 FROM customer WHERE c_custkey % 3 = 1""",
    "a3_read_placemarks": """SELECT c_name AS name, 19.5::DOUBLE + c_custkey % 8 AS lat, 73.5::DOUBLE + c_custkey % 4 AS lng, c_mktsegment AS category, CASE WHEN c_custkey % 2 = 0 THEN 'open' END AS status, CASE WHEN c_custkey % 2 = 0 THEN 'high' END AS risk, NULL::VARCHAR AS source, CASE WHEN c_custkey % 2 = 1 THEN 'narrow' END AS note FROM customer""",
    "a4_list_media": "SELECT event_id, 'center=' || user_id % 10 + 10 AS folder FROM events WHERE event_id % 3 = 0 AND event_id % 7 <> 0",
    "a5_write_registry": f"SELECT {CASE_ID} AS case_id, CASE WHEN event_id % 50 <> 0 THEN ts::DATE END AS report_date, CASE WHEN event_id % 4 = 0 THEN 'Reunited' ELSE 'Active' END AS status FROM events",
}
