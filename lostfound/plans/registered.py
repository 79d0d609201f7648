"""All registered queries of the reunification library and their SQL twins.

The driver's tables stand in for the registry: events are reports, customers are mapped points, suppliers stations, nations
zones, documents descriptions, embeddings faces. Each query runs over whole tables; the SQL states the same result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lostfound.functions import columns as C
from lostfound.functions.scripts import transliterate
from lostfound.operators import analytics as A
from lostfound.operators import geo as G
from lostfound.operators import graph as N
from lostfound.operators import matching as M
from lostfound.operators import more_matching as MM
from lostfound.plans import inputs as I
from lostfound.plans.streams import STREAM_ORACLE, STREAM_QUERIES, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- stand-ins, as DataFrames and as SQL ---


def reports(s: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return t(s, d, "events").select(F.col("event_id").alias("case_id"), F.col("ts").alias("reported_at"), (F.col("user_id") % 10).alias("center"), "event_type", F.col("value").alias("resolution_hours"), (k % 32 + 1).alias("zone"), (F.col("user_id") % 7).alias("age"), "user_id")


R = "r AS (SELECT event_id AS case_id, ts AS reported_at, user_id % 10 AS center, event_type, value AS resolution_hours, json_extract_string(props, '$.k')::INT % 32 + 1 AS zone, user_id % 7 AS age, user_id FROM events)"
LNG, LAT = "73.60 + ({0} % 997) * 0.0003", "19.90 + ({0} % 499) * 0.0004"


def placed(df: DataFrame, key: str, name: str) -> DataFrame:
    k = F.col(key)
    return df.select(k.cast("long").alias(name), (F.lit(19.90) + (k % 499) * F.lit(0.0004)).alias("lat"), (F.lit(73.60) + (k % 997) * F.lit(0.0003)).alias("lng"))


def points(s, d):
    return placed(t(s, d, "customer"), "c_custkey", "point")


def stations(s, d):
    return placed(t(s, d, "supplier"), "s_suppkey", "station")


def zones(s, d):
    n = t(s, d, "nation").withColumn("_k", F.col("n_nationkey") * 37)
    return placed(n, "_k", "_z").join(F.broadcast(n.select(F.col("_k").cast("long").alias("_z"), F.col("n_nationkey").cast("long").alias("zone"))), "_z").select("zone", "lat", "lng")


def _placed_sql(view: str, table: str, key: str, name: str, expr: str | None = None) -> str:
    k = expr or key
    return f"{view} AS (SELECT {key}::BIGINT AS {name}, 19.90::DOUBLE + ({k} % 499) * 0.0004::DOUBLE AS lat, 73.60::DOUBLE + ({k} % 997) * 0.0003::DOUBLE AS lng FROM {table})"


P = _placed_sql("p", "customer", "c_custkey", "point")
S = _placed_sql("s", "supplier", "s_suppkey", "station")
Z = _placed_sql("z", "nation", "n_nationkey", "zone", "(n_nationkey * 37)")


def km(a: str, b: str) -> str:
    return f"round(2 * 6371.0088 * asin(sqrt(least(1.0, power(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * power(sin(radians({b}.lng - {a}.lng) / 2), 2)))), 6)"


def folded(x: str) -> str:
    """normalize_name in SQL."""
    out = f"translate(lower({x}), '{C.ACCENTED}', '{C.PLAIN}')"
    for pattern, to in (("[^a-z0-9 ]", " "), ("ksh", "x"), ("ph", "f"), ("w", "v"), ("ee", "i"), ("oo", "u"), (" +", " ")):
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return f"nullif(trim({out}), '')"


def skeleton(x: str) -> str:
    f = f"replace({folded(x)}, ' ', '')"
    return f"substr(substr({f}, 1, 1) || regexp_replace(substr({f}, 2), '[aeiouy]', '', 'g'), 1, 6)"


TOKENS = f"""(SELECT doc_id, source, list_sort(list_filter(list_distinct(string_split(trim(regexp_replace(translate(lower(text), '{C.ACCENTED}', '{C.PLAIN}'), '[^a-z0-9]+', ' ', 'g')), ' ')), lambda w: w NOT IN ('', {", ".join(repr(w) for w in C.STOP_WORDS)}))) AS tokens FROM documents)"""


def described(s, d):
    return t(s, d, "documents").select("doc_id", "source", C.describe_tokens(F.col("text")).alias("tokens"))


# --- the flagship, projections and scalars ---


@query(f"""WITH {R}, j AS (SELECT m.case_id AS missing_id, f.case_id AS found_id, abs(floor(epoch(m.reported_at)) - floor(epoch(f.reported_at))) / 3600.0 AS gap_hours
FROM r m JOIN r f ON m.zone = f.zone AND m.age = f.age WHERE m.event_type = 'error' AND f.event_type = 'signup'),
k AS (SELECT *, row_number() OVER (PARTITION BY missing_id ORDER BY gap_hours, found_id) AS rank FROM j WHERE gap_hours <= 48) SELECT missing_id, found_id, gap_hours, rank::INT AS rank FROM k WHERE rank <= 3""")
def flagship_match(s, d):
    r = reports(s, d)
    return M.match_found(r.filter("event_type = 'error'"), r.filter("event_type = 'signup'"), block=["zone", "age"], hours=48, k=3)


@query(f"SELECT p_partkey, {folded('p_name')} AS folded, {skeleton('p_name')} AS name_key FROM part")
def b_names(s, d):
    return t(s, d, "part").select("p_partkey", C.normalize_name(F.col("p_name")).alias("folded"), C.name_key(F.col("p_name")).alias("name_key"))


@query("""SELECT event_id, CASE WHEN user_id % 7 = 0 THEN 80 ELSE (user_id % 7)::INT * 10 END AS low, CASE WHEN user_id % 7 = 0 THEN NULL ELSE (user_id % 7)::INT * 10 + 9 END AS high,
CASE WHEN event_type = 'signup' THEN 'Reunited' ELSE 'Active' END AS status, 'KMP' AS case_prefix, 2027 AS case_year, event_id::INT AS case_number, '98' || lpad(user_id::VARCHAR, 8, '0') AS mobile FROM events""")
def b_fields(s, d):
    e = t(s, d, "events")
    band = F.when(F.col("user_id") % 7 == 0, "80+").otherwise(F.concat((F.col("user_id") % 7 * 10).cast("string"), F.lit("-"), (F.col("user_id") % 7 * 10 + 9).cast("string")))
    raw = e.withColumn("case_id", F.concat(F.lit("KMP-2027-"), F.lpad(F.col("event_id").cast("string"), 9, "0"))).withColumn("a", C.age_bounds(band))
    own = C.normalize_mobile(F.concat(F.lit("+91 98"), F.lpad(F.col("user_id").cast("string"), 8, "0")))
    status = C.map_status(F.when(F.col("event_type") == "signup", "Reunited").otherwise(F.col("event_type")))
    return C.parse_ids(raw).select("event_id", F.col("a.low").alias("low"), F.col("a.high").alias("high"), status.alias("status"), "case_prefix", "case_year", "case_number", own.alias("mobile"))


@query("SELECT c_custkey, 'C.' AS name, '********' || right(lpad(c_custkey::VARCHAR, 8, '0'), 2) AS mobile, sha256('lostfound:98' || lpad(c_custkey::VARCHAR, 8, '0')) AS mobile_key FROM customer")
def b_mask(s, d):
    own = t(s, d, "customer").select("c_custkey", F.col("c_name").alias("name"), F.concat(F.lit("98"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("mobile"))
    return C.mask_person(own, mobile="mobile")


@query(f"SELECT doc_id, len(tokens)::INT AS n, md5(array_to_string(tokens, ' ')) AS tokens FROM {TOKENS}")
def b_tokens(s, d):
    return described(s, d).select("doc_id", F.size("tokens").alias("n"), F.md5(F.array_join("tokens", " ").cast("binary")).alias("tokens"))


# ten consonants of the blocks of Devanagari, Gujarati and Tamil, and how they are written in Latin letters
LETTERS = (0x15, 0x17, 0x1C, 0x1F, 0x24, 0x28, 0x2A, 0x2E, 0x30, 0x38)
LATIN = ("k", "g", "j", "t", "t", "n", "p", "m", "r", "s")


@query(f"""SELECT c_custkey, c_name || ' ' || array_to_string(list_transform(string_split(c_custkey::VARCHAR, ''), lambda x: list_extract([{", ".join(map(repr, LATIN))}], x::INT + 1)), 'a') || 'ee' AS latin FROM customer""")
def i1_transliterate(s, d):
    key = F.col("c_custkey").cast("string")
    spelt = [F.concat(F.translate(key, "0123456789", "".join(chr(base + x) for x in LETTERS)), F.lit(chr(base + 0x40))) for base in (0x0900, 0x0A80, 0x0B80)]
    name = F.concat(F.col("c_name"), F.lit(" "), F.when(F.col("c_custkey") % 3 == 0, spelt[0]).when(F.col("c_custkey") % 3 == 1, spelt[1]).otherwise(spelt[2]))
    return t(s, d, "customer").select("c_custkey", transliterate(name).alias("latin"))


@query("SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE * 0.5 + l_discount::DOUBLE * 4 AS score FROM lineitem")
def i3_score_with(s, d):
    """A linear model stands in for the caller's own."""
    rows = t(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("q"), F.col("l_discount").cast("double").alias("p"))
    return M.score_with(rows, lambda pdf: pdf[["l_orderkey", "l_linenumber"]].assign(score=pdf["q"] * 0.5 + pdf["p"] * 4), f"l_orderkey {dict(rows.dtypes)['l_orderkey']}, l_linenumber {dict(rows.dtypes)['l_linenumber']}, score double")


# --- data quality ---


@query("""SELECT event_type, 'value' AS "column", count(*) AS n_rows, sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END)::BIGINT AS blanks, sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) / count(*)::DOUBLE AS blank_share FROM events GROUP BY 1
UNION ALL SELECT event_type, 'props', count(*), sum(CASE WHEN props IS NULL OR trim(props) = '' THEN 1 ELSE 0 END)::BIGINT, sum(CASE WHEN props IS NULL OR trim(props) = '' THEN 1 ELSE 0 END) / count(*)::DOUBLE FROM events GROUP BY 1""")
def c1_completeness(s, d):
    return A.completeness(t(s, d, "events"), ["value", "props"], ["event_type"])


@query("""SELECT 'event_type' AS "column", event_type AS value, count(*) AS n, event_type IN ('click', 'view', 'error') AS allowed FROM events GROUP BY 2""")
def c2_domain(s, d):
    return A.domain_check(t(s, d, "events"), {"event_type": ["click", "view", "error"]})


@query(f"WITH {P}, {Z}, j AS (SELECT point, zone, {km('p', 'z')} AS km FROM p, z), k AS (SELECT *, row_number() OVER (PARTITION BY point ORDER BY km, zone) AS n FROM j) SELECT point, zone, km FROM k WHERE n = 1 AND km > 2")
def c3_outliers(s, d):
    return G.coordinate_outliers(points(s, d), zones(s, d), 2.0, id_="point", zone="zone")


@query("WITH p AS (SELECT (c_custkey % 50)::DOUBLE AS lat, (c_custkey % 20)::DOUBLE AS lng, c_name AS name FROM customer) SELECT lat, lng, count(*) AS n, md5(array_to_string(list_sort(list(name)), ',')) AS names FROM p GROUP BY 1, 2 HAVING count(*) > 1")
def c3_shared_coordinates(s, d):
    own = t(s, d, "customer").select((F.col("c_custkey") % 50).cast("double").alias("lat"), (F.col("c_custkey") % 20).cast("double").alias("lng"), F.col("c_name").alias("name"))
    return G.shared_coordinates(own, "name").withColumn("names", F.md5(F.array_join("names", ",").cast("binary")))


@query("""SELECT coalesce(c_custkey, s_suppkey) AS key, CASE WHEN s_suppkey IS NULL THEN 'only_left' WHEN c_custkey IS NULL THEN 'only_right' WHEN abs(c_acctbal - s_acctbal) > 1e-6 THEN 'moved' ELSE 'equal' END AS state
FROM customer FULL OUTER JOIN supplier ON c_custkey = s_suppkey""")
def c4_reconcile(s, d):
    return A.reconcile(t(s, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("v")), t(s, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("v")), "key", "v")


@query("""SELECT coalesce(l.c_name, lower(r.c_name) || '.') AS name, CASE WHEN r.c_custkey IS NULL THEN 'only_left' WHEN l.c_custkey IS NULL THEN 'only_right' WHEN r.c_custkey % 7 = 0 THEN 'moved' ELSE 'equal' END AS state, r.c_mktsegment AS segment
FROM (SELECT * FROM customer WHERE c_custkey % 4 <> 0) l FULL OUTER JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) r ON l.c_custkey = r.c_custkey""")
def c4_reconcile_folded(s, d):
    c = t(s, d, "customer")
    left = c.filter("c_custkey % 4 <> 0").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("v"))
    right = c.filter("c_custkey % 3 <> 0").select(F.concat(F.lower("c_name"), F.lit(".")).alias("name"), (F.col("c_custkey") + F.when(F.col("c_custkey") % 7 == 0, 1).otherwise(0)).alias("v"), F.col("c_mktsegment").alias("segment"))
    return A.reconcile(left, right, "name", "v", fold=True, attributes=("segment",))


@query("SELECT event_id AS case_id, user_id AS key FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)")
def c5_unknown_keys(s, d):
    cases = t(s, d, "events").select(F.col("event_id").alias("case_id"), F.col("user_id").alias("key"))
    return A.unknown_keys(cases, t(s, d, "customer").filter("c_custkey % 3 <> 0"), "key", "c_custkey").select("case_id", "key")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def c5_duplicate_ids(s, d):
    return A.duplicate_ids(t(s, d, "orders"), "o_custkey")


# --- geography ---


@query(f"WITH {P}, {S}, j AS (SELECT point, station, {km('p', 's')} AS km FROM p, s), k AS (SELECT *, row_number() OVER (PARTITION BY point ORDER BY km, station) AS rank FROM j) SELECT point, station, km, rank::INT AS rank FROM k WHERE rank <= 2")
def d2_nearest(s, d):
    return G.nearest_k(points(s, d), stations(s, d), 2, id_="point", place="station")


@query(f"WITH {P}, {S}, j AS (SELECT point, station, {km('p', 's')} AS km FROM p, s) SELECT * FROM j WHERE km <= 0.75")
def d3_within_radius(s, d):
    return G.within_radius(points(s, d), stations(s, d), 0.75, id_="point", other="station")


_TEXT = "CASE c_custkey % 4 WHEN 0 THEN upper(n_name) WHEN 1 THEN substr(n_name, 1, length(n_name) - 1) WHEN 2 THEN n_name || 'qq' ELSE 'nowhere ' || c_custkey % 9 END"


@query(f"""WITH {Z}, a AS (SELECT n_name AS place, lat, lng, {folded('n_name')} AS n, {skeleton('n_name')} AS k FROM nation JOIN z ON n_nationkey = zone),
c AS (SELECT c_custkey, {_TEXT} AS txt FROM customer JOIN nation ON c_nationkey = n_nationkey), x AS (SELECT DISTINCT txt, {folded('txt')} AS n, {skeleton('txt')} AS k FROM c),
e AS (SELECT txt, min(place) AS place, 'exact' AS method, 1 AS o FROM x JOIN a ON x.n = a.n GROUP BY 1), q AS (SELECT txt, min(place) AS place, 'skeleton' AS method, 2 AS o FROM x JOIN a ON x.k = a.k GROUP BY 1),
l AS (SELECT txt, arg_min(a.place, (levenshtein(x.n, a.n), a.place)) AS place, 'edit' AS method, 3 AS o FROM x, a WHERE levenshtein(x.n, a.n) <= 2 GROUP BY 1),
b AS (SELECT * FROM e UNION ALL SELECT * FROM q UNION ALL SELECT * FROM l), f AS (SELECT txt, arg_min(place, o) AS place, arg_min(method, o) AS method FROM b GROUP BY 1)
SELECT c_custkey, c.txt AS last_seen_location, f.place, a.lat, a.lng, f.method FROM c LEFT JOIN f ON c.txt = f.txt LEFT JOIN a ON a.place = f.place""")
def d4_geocode(s, d):
    n = t(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("zone"), "n_name")
    places = zones(s, d).join(n, "zone").select(F.col("n_name").alias("name"), "lat", "lng")
    k, name = F.col("c_custkey") % 4, F.col("n_name")
    text = F.when(k == 0, F.upper(name)).when(k == 1, F.expr("substr(n_name, 1, length(n_name) - 1)")).when(k == 2, F.concat(name, F.lit("qq"))).otherwise(F.concat(F.lit("nowhere "), (F.col("c_custkey") % 9).cast("string")))
    cases = t(s, d, "customer").join(n, F.col("c_nationkey") == F.col("zone")).select("c_custkey", text.alias("last_seen_location"))
    return G.geocode(cases, places)


@query(f"""WITH {P}, {Z}, a AS (SELECT 'Ghat ' || point AS place, lat, lng FROM p), j AS (SELECT point, zone, {km('p', 'z')} AS km FROM p, z), o AS (SELECT *, row_number() OVER (PARTITION BY point ORDER BY km, zone) AS n FROM j)
SELECT event_id, 'GHAT ' || user_id AS last_seen_location, place, lat, lng, CASE WHEN place IS NOT NULL THEN 'exact' END AS method, o.zone FROM events LEFT JOIN a ON place = 'Ghat ' || user_id LEFT JOIN o ON o.point = user_id AND o.n = 1""")
def d4_geocode_zone(s, d):
    places = points(s, d).select(F.concat(F.lit("Ghat "), F.col("point").cast("string")).alias("name"), "lat", "lng")
    cases = t(s, d, "events").select("event_id", F.concat(F.lit("GHAT "), F.col("user_id").cast("string")).alias("last_seen_location"))
    return G.geocode(cases, places, zones(s, d))


@query(f"""WITH {P}, {S}, {Z}, j AS (SELECT point, zone, {km('p', 'z')} AS km FROM p, z), q AS (SELECT station, zone, {km('s', 'z')} AS km FROM s, z), o AS (SELECT *, row_number() OVER (PARTITION BY point ORDER BY km, zone) AS n FROM j)
SELECT z.zone, (SELECT count(*) FROM o WHERE n = 1 AND o.zone = z.zone) AS in_zone, (SELECT count(*) FROM j WHERE km <= 1 AND j.zone = z.zone) AS in_reach, (SELECT count(*) FROM p WHERE point % 32 + 1 = z.zone) AS by_id, (SELECT count(*) FROM q WHERE km <= 1 AND q.zone = z.zone) AS stations FROM z""")
def d5_zone_coverage_by_id(s, d):
    cameras = C.parse_ids(points(s, d).withColumn("camera", F.concat(F.lit("Z"), (F.col("point") % 32 + 1).cast("string"), F.lit("-C"), F.col("point").cast("string"))), None, camera_id="camera")
    return G.zone_coverage(zones(s, d), cameras, 1.0, stations(s, d), zone="zone", camera="point", camera_zone="zone_no")


@query(f"""WITH {P}, {Z}, j AS (SELECT point, zone, {km('p', 'z')} AS km FROM p, z), o AS (SELECT *, row_number() OVER (PARTITION BY point ORDER BY km, zone) AS n FROM j)
SELECT z.zone, coalesce((SELECT count(*) FROM o WHERE n = 1 AND o.zone = z.zone), 0) AS in_zone, coalesce((SELECT count(*) FROM j WHERE km <= 1 AND j.zone = z.zone), 0) AS in_reach FROM z""")
def d5_zone_coverage(s, d):
    return G.zone_coverage(zones(s, d), points(s, d), 1.0, zone="zone", camera="point")


@query(f"""WITH {P}, {S}, j AS (SELECT point, station, {km('p', 's')} AS km FROM p, s), k AS (SELECT *, row_number() OVER (PARTITION BY point ORDER BY km, station) AS n FROM j)
SELECT station, count(*) AS cases, round(avg(km), 5) AS mean_km, round(quantile_cont(km, 0.5), 5) AS p50_km, round(quantile_cont(km, 0.9), 5) AS p90_km, max(km) AS max_km, avg(CASE WHEN km <= 1 THEN 1.0 ELSE 0.0 END)::DOUBLE AS share_within FROM k WHERE n = 1 GROUP BY 1""")
def d6_response(s, d):
    out = G.response_coverage(points(s, d), stations(s, d), 1.0, id_="point", station="station")
    return out.withColumns({c: F.round(c, 5) for c in ("mean_km", "p50_km", "p90_km")})


def _greedy(k: int) -> str:
    """The greedy choice of ``k`` points, a step at a time."""
    out = ["c AS MATERIALIZED (SELECT point, station FROM (SELECT point, station, " + km("p", "s") + " AS km FROM p, s) WHERE km <= 0.75)", "l1 AS MATERIALIZED (SELECT * FROM c)"]
    for i in range(1, k + 1):
        out.append(f"b{i} AS MATERIALIZED (SELECT {i} AS step, station, count(DISTINCT point) AS covered FROM l{i} GROUP BY station ORDER BY covered DESC, station LIMIT 1)")
        out.append(f"l{i + 1} AS MATERIALIZED (SELECT * FROM l{i} WHERE point NOT IN (SELECT point FROM l{i} JOIN b{i} USING (station)))")
    return ", ".join(out) + " " + " UNION ALL ".join(f"SELECT step, station, covered FROM b{i}" for i in range(1, k + 1))


@query(f"WITH {P}, {S}, {_greedy(5)}")
def d7_help_points(s, d):
    return G.place_help_points(points(s, d), stations(s, d), 0.75, 5, id_="point", candidate="station")


# --- search, matching, duplicates ---


@query(f"""WITH {R}, u AS (SELECT *, CASE WHEN case_id % 4 <> 0 THEN zone END AS z FROM r), j AS (SELECT q.case_id AS query_id, c.case_id AS case_id, round((CASE WHEN q.center = c.center THEN 1.0 ELSE 0.0 END * 2 + greatest(0.0, 1 - abs(floor(epoch(q.reported_at)) - floor(epoch(c.reported_at))) / 172800.0) * 1) / 3, 9)::DOUBLE AS score
FROM u q JOIN r c ON (q.z = c.zone AND q.age = c.age) OR q.user_id = c.user_id WHERE q.event_type = 'error' AND c.event_type = 'signup'), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, case_id) AS rank FROM j WHERE score > 0) SELECT query_id, case_id, score, rank::INT AS rank FROM k WHERE rank <= 3""")
def e1_search(s, d):
    """By zone and age or by the reporter; every fourth query has no zone."""
    r = reports(s, d)
    keys = [F.concat(F.col("zone").cast("string"), F.lit("/"), F.col("age").cast("string")), F.col("user_id")]
    blocks = M.store_blocks(r.filter("event_type = 'signup'"), f"blocks_{uuid.uuid4().hex[:12]}", f"{shared_dir(s)}/blocks", keys, ["center", "reported_at"])
    asked = r.filter("event_type = 'error'").withColumnRenamed("case_id", "query_id").withColumn("zone", F.when(F.col("query_id") % 4 != 0, F.col("zone")))
    return M.search_registry(asked, blocks, keys=keys, fields=[("center", "equal", 2.0), ("reported_at", "hours", 1.0)], k=3)


@query(f"""WITH {R}, x AS (SELECT * FROM r WHERE event_type = 'error') SELECT DISTINCT a.case_id AS a, b.case_id AS b FROM x a JOIN x b ON a.case_id < b.case_id AND a.center <> b.center
AND ((a.zone = b.zone AND a.age = b.age AND date_trunc('day', a.reported_at) = date_trunc('day', b.reported_at)) OR a.user_id = b.user_id)""")
def e2_candidates(s, d):
    keys = [F.concat(F.col("zone").cast("string"), F.lit("/"), F.col("age").cast("string"), F.lit("/"), F.date_format("reported_at", "yyyy-MM-dd")), F.col("user_id")]
    return M.candidate_pairs(reports(s, d).filter("event_type = 'error'"), keys, id_="case_id", center="center")


@query(f"""WITH {R}, x AS (SELECT * FROM r WHERE event_type = 'error'), j AS (SELECT a.case_id AS missing_id, b.case_id AS found_id, abs(floor(epoch(a.reported_at)) - floor(epoch(b.reported_at))) / 3600.0 AS gap_hours FROM x a JOIN r b ON a.zone = b.zone AND a.age = b.age AND b.event_type = 'signup'),
k AS (SELECT *, row_number() OVER (PARTITION BY missing_id ORDER BY gap_hours, found_id) AS rank FROM j WHERE gap_hours <= 48), m AS (SELECT * FROM k WHERE rank <= 3),
o AS (SELECT *, row_number() OVER (PARTITION BY missing_id ORDER BY gap_hours, found_id) AS x, row_number() OVER (PARTITION BY found_id ORDER BY gap_hours, missing_id) AS y FROM m) SELECT missing_id, found_id, gap_hours, rank::INT AS rank FROM o WHERE x = 1 AND y = 1""")
def e5_one_to_one(s, d):
    return M.one_to_one(flagship_match(s, d))


# First and last year of each age band.
LOW, HIGH = (0, 13, 18, 41, 61, 71, 80), (12, 17, 40, 60, 70, 80, 200)
LOW2, HIGH2 = (0, 13, 26, 41, 61, 71, 80), (12, 25, 40, 60, 70, 80, 200)


@query(f"""WITH {R}, m AS (SELECT case_id, reported_at, zone, case_id % 3 AS g, {list(LOW)}[case_id % 7 + 1] AS lo, {list(HIGH)}[case_id % 7 + 1] AS hi FROM r WHERE event_type = 'error'), f AS (SELECT case_id, reported_at, zone, case_id % 3 AS g, {list(LOW2)}[case_id % 7 + 1] AS lo, {list(HIGH2)}[case_id % 7 + 1] AS hi FROM r WHERE event_type = 'signup'),
j AS (SELECT m.case_id AS missing_id, f.case_id AS found_id, abs(floor(epoch(m.reported_at)) - floor(epoch(f.reported_at))) / 3600.0 AS gap_hours FROM m JOIN f ON m.zone = f.zone AND (m.g = f.g OR m.g = 2 OR f.g = 2) AND m.lo <= f.hi AND f.lo <= m.hi),
k AS (SELECT *, row_number() OVER (PARTITION BY missing_id ORDER BY gap_hours, found_id) AS rank FROM j WHERE gap_hours <= 24) SELECT missing_id, found_id, gap_hours, rank::INT AS rank FROM k WHERE rank <= 3""")
def e4_match_agreeing(s, d):
    """The two sides name age bands differently."""
    r = reports(s, d).withColumn("gender", I.pick(("Male", "Female", "Unknown"), F.col("case_id") % 3))
    side = lambda kind, bands: r.filter(F.col("event_type") == kind).withColumn("age", C.age_bounds(I.pick(bands, F.col("case_id") % 7)))
    return M.match_found(side("error", I.BANDS), side("signup", I.OTHER_BANDS), block=["zone"], hours=24, k=3, agree=M.agreeing(), compare=("gender", "age"))


@query(f"""WITH {R}, x AS (SELECT * FROM r WHERE event_type = 'error'), p AS (SELECT DISTINCT a.case_id AS a, b.case_id AS b FROM x a JOIN x b ON a.case_id < b.case_id AND a.center <> b.center AND a.zone = b.zone AND a.age = b.age AND date_trunc('day', a.reported_at) = date_trunc('day', b.reported_at)),
w AS (SELECT case_id, {list(LOW)}[case_id % 7 + 1] AS lo, {list(HIGH)}[case_id % 7 + 1] AS hi, ['red', 'bag'] || ['t' || case_id % 5] AS ts FROM r)
SELECT a, b, round(((a.lo <= b.hi AND b.lo <= a.hi)::INT * 2 + len(list_intersect(a.ts, b.ts)) / len(list_distinct(a.ts || b.ts))::DOUBLE) / 3, 9)::DOUBLE AS score, 2 AS compared FROM p JOIN w a ON a.case_id = a JOIN w b ON b.case_id = b""")
def e3_score_pairs(s, d):
    """Ages and tokens of the pairs that meet in a block."""
    r = reports(s, d)
    key = F.concat(F.col("zone").cast("string"), F.lit("/"), F.col("age").cast("string"), F.lit("/"), F.date_format("reported_at", "yyyy-MM-dd"))
    errors = r.filter("event_type = 'error'")
    own = r.select("case_id").join(errors.select("case_id"), "case_id", "left_semi")
    own = own.select("case_id", C.age_bounds(I.pick(I.BANDS, F.col("case_id") % 7)).alias("age"), C.describe_tokens(F.concat(F.lit("A red bag, T"), (F.col("case_id") % 5).cast("string"))).alias("tokens"))
    return M.scored_candidates(errors, [key], own, [("age", "ages", 2.0), ("tokens", "tokens", 1.0)], id_="case_id", center="center")


@query(f"WITH {R}, k AS (SELECT '0:' || zone || '/' || age AS key FROM r) SELECT key, count(*) AS n FROM k GROUP BY 1 HAVING count(*) > 40")
def e2_block_sizes(s, d):
    return M.block_sizes(reports(s, d), [F.concat(F.col("zone").cast("string"), F.lit("/"), F.col("age").cast("string"))], 40)


def _equal_texts(s, d):
    x = t(s, d, "documents").select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("h"))
    first = x.groupBy("h").agg(F.min("doc_id").alias("a"))
    return x, x.join(first, "h").filter("doc_id <> a").select("a", F.col("doc_id").alias("b"))


@query("SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY text) AS cluster FROM documents QUALIFY count(*) OVER (PARTITION BY text) > 1")
def e6_clusters(s, d):
    return M.duplicate_clusters(_equal_texts(s, d)[1])


@query("""SELECT min(doc_id) AS cluster, min(doc_id) AS first_seen, count(*) AS reports, arg_min(lang, doc_id) AS lang, array_to_string(list_sort(list_distinct(list(source))), ',') AS centers, array_to_string(list_sort(list(doc_id)), ',') AS case_ids FROM documents GROUP BY text""")
def e7_merge(s, d):
    docs = t(s, d, "documents")
    out = M.merge_clusters(docs.withColumn("n_at", F.col("doc_id")), M.duplicate_clusters(_equal_texts(s, d)[1]), id_="doc_id", at="n_at", center="source", first=["lang"])
    return out.withColumns({"centers": F.array_join("centers", ","), "case_ids": F.array_join(F.transform("case_ids", lambda x: x.cast("string")), ",")})


@query("""WITH d AS (SELECT doc_id, text, n_chars, min(doc_id) OVER (PARTITION BY text) AS a FROM documents), l AS (SELECT n_chars, lang, min(doc_id) AS a FROM documents GROUP BY 1, 2), q AS (SELECT l.a, doc_id AS b, CASE WHEN documents.doc_id % 2 = 0 THEN 0.9 ELSE 0.7 END AS score FROM documents JOIN l USING (n_chars, lang) WHERE doc_id <> l.a),
u AS (SELECT a, doc_id AS b FROM d WHERE doc_id <> a), h AS (SELECT unnest([0.5, 0.8])::DOUBLE AS threshold), m AS (SELECT q.*, u.a IS NOT NULL AS ok FROM q LEFT JOIN u ON q.a = u.a AND q.b = u.b),
g AS (SELECT threshold, count(*) FILTER (score >= threshold) AS found, count(*) FILTER (score >= threshold AND ok) AS "right" FROM m, h GROUP BY 1)
SELECT threshold, found, "right", "right" / found::DOUBLE AS precision, "right" / (SELECT count(*) FROM u)::DOUBLE AS recall, 2 * ("right" / found::DOUBLE) * ("right" / (SELECT count(*) FROM u)::DOUBLE) / ("right" / found::DOUBLE + "right" / (SELECT count(*) FROM u)::DOUBLE) AS f1 FROM g""")
def e8_evaluate(s, d):
    docs = t(s, d, "documents")
    first = docs.groupBy("n_chars", "lang").agg(F.min("doc_id").alias("a"))
    pairs = docs.join(first, ["n_chars", "lang"]).filter("doc_id <> a").select("a", F.col("doc_id").alias("b"), F.when(F.col("doc_id") % 2 == 0, 0.9).otherwise(0.7).alias("score"))
    return M.evaluate_duplicates(pairs, _equal_texts(s, d)[1], [0.5, 0.8])


@query("""WITH l AS (SELECT n_chars, lang, min(doc_id) AS a FROM documents GROUP BY 1, 2), q AS (SELECT l.a, doc_id AS b, CASE WHEN documents.doc_id % 2 = 0 THEN 0.9 ELSE 0.7 END AS score FROM documents JOIN l USING (n_chars, lang) WHERE doc_id <> l.a),
m AS (SELECT id, max(score) AS s FROM (SELECT a AS id, score FROM q UNION ALL SELECT b, score FROM q) GROUP BY 1), f AS (SELECT doc_id, count(*) OVER (PARTITION BY text) > 1 AS flag, m.s FROM documents LEFT JOIN m ON id = doc_id), h AS (SELECT unnest([0.5, 0.8])::DOUBLE AS threshold),
g AS (SELECT threshold, count(*) FILTER (s >= threshold) AS found, count(*) FILTER (s >= threshold AND flag) AS "right", count(*) FILTER (flag) AS total FROM f, h GROUP BY 1)
SELECT threshold, found, "right", "right" / found::DOUBLE AS precision, "right" / total::DOUBLE AS recall, 2 * ("right" / found::DOUBLE) * ("right" / total::DOUBLE) / ("right" / found::DOUBLE + "right" / total::DOUBLE) AS f1 FROM g""")
def e8_evaluate_cases(s, d):
    docs = t(s, d, "documents")
    first = docs.groupBy("n_chars", "lang").agg(F.min("doc_id").alias("a"))
    pairs = docs.join(first, ["n_chars", "lang"]).filter("doc_id <> a").select("a", F.col("doc_id").alias("b"), F.when(F.col("doc_id") % 2 == 0, 0.9).otherwise(0.7).alias("score"))
    copies = docs.groupBy(F.xxhash64("text").alias("_h")).agg((F.count("*") > 1).alias("flag"))
    return M.evaluate_cases(pairs, docs.select("doc_id", F.xxhash64("text").alias("_h")).join(copies, "_h"), [0.5, 0.8], id_="doc_id", flag="flag")


_JACCARD = f"""WITH x AS {TOKENS}, o AS (SELECT doc_id, tokens, min(doc_id) OVER (PARTITION BY tokens) AS o FROM x WHERE len(tokens) > 0), w AS (SELECT doc_id, len(tokens) AS n, unnest(tokens) AS w FROM o WHERE doc_id = o), p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS m, count(*) AS k FROM w a JOIN w b ON a.w = b.w AND a.doc_id < b.doc_id GROUP BY 1, 2, 3)
SELECT a, b, round(k / (m - k)::DOUBLE, 9) AS jaccard FROM p WHERE k / (m - k)::DOUBLE >= 0.8 - 1e-9 UNION ALL SELECT o, doc_id, 1.0 FROM o WHERE doc_id <> o"""


@query(_JACCARD)
def e9_token_join(s, d):
    return M.token_join(described(s, d), id_="doc_id", tokens="tokens", least=0.8).withColumn("jaccard", F.round("jaccard", 9))


@query(_JACCARD)
def e10_minhash(s, d):
    """A pair at the threshold is missed with a probability of 2 in a million."""
    return MM.minhash_pairs(described(s, d), 25, 4, id_="doc_id", tokens="tokens", least=0.8).withColumn("jaccard", F.round("jaccard", 9))


@query(f"""WITH x AS {TOKENS}, b AS (SELECT item_id, list_filter(list_distinct(string_split(trim(regexp_replace(translate(lower(text), '{C.ACCENTED}', '{C.PLAIN}'), '[^a-z0-9]+', ' ', 'g')), ' ')), lambda w: w NOT IN ('', {", ".join(repr(w) for w in C.STOP_WORDS)})) AS tokens FROM benchmark),
w AS (SELECT doc_id, unnest(tokens) AS w FROM x), i AS (SELECT w, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)::DOUBLE) AS idf FROM w GROUP BY 1), n AS (SELECT doc_id, sqrt(sum(idf * idf)) AS cn FROM w JOIN i USING (w) GROUP BY 1),
q AS (SELECT item_id, w, idf FROM (SELECT item_id, unnest(tokens) AS w FROM b) JOIN i USING (w)), m AS (SELECT item_id, sqrt(sum(idf * idf)) AS qn FROM q GROUP BY 1), e AS (SELECT item_id, doc_id, sum(idf * idf) AS dot FROM q JOIN w USING (w) GROUP BY 1, 2),
r AS (SELECT item_id, doc_id, round(dot / (cn * qn), 6) AS score FROM e JOIN n USING (doc_id) JOIN m USING (item_id)), k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) SELECT item_id, doc_id, score, rank::INT AS rank FROM k WHERE rank <= 3""")
def e11_transcripts(s, d):
    asked = t(s, d, "benchmark").select("item_id", C.describe_tokens(F.col("text")).alias("tokens"))
    return M.transcript_candidates(asked, described(s, d), 3, query_id="item_id", case_id="doc_id")


_COS = "WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0), j AS (SELECT query_id, e.vec_id, round(list_cosine_similarity(q.v, e.embedding::DOUBLE[]), 6) AS score FROM q, embeddings e WHERE e.vec_id <> query_id), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM j) SELECT query_id, vec_id, score, rank::INT AS rank FROM k WHERE rank <= 3"


@query(_COS)
def e12_embedding_topk(s, d):
    e = t(s, d, "embeddings")
    return M.embedding_topk(e.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), e, 3, others=True)


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), u AS (SELECT vec_id, v FROM e UNION ALL SELECT vec_id + 1000000000, list_transform(v, lambda x, i: x + 0.25 * v[i % 64 + 1]) FROM e)
SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM u a JOIN u b ON a.vec_id < b.vec_id AND round(list_cosine_similarity(a.v, b.v), 6) >= 0.9""")
def e13_embedding_lsh(s, d):
    """The vectors and a turned copy of each, at a cosine of some 0.97: the vectors themselves have no near pairs."""
    e = t(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    turned = F.transform("embedding", lambda x, i: x + F.lit(0.25) * F.get(F.col("embedding"), (i + 1) % 64))
    return MM.embedding_lsh_pairs(e.unionByName(e.select((F.col("vec_id") + 1_000_000_000).alias("vec_id"), turned.alias("embedding"))), 14, None, 0.9)


@query("""WITH a AS (SELECT doc_id AS query_id, n_chars AS case_id, (doc_id % 10) / 10.0 AS score FROM documents), b AS (SELECT conv_id AS query_id, turn AS case_id, max((turn % 5) / 5.0) AS score FROM conversations GROUP BY 1, 2)
SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.case_id, b.case_id) AS case_id, CASE WHEN a.score IS NULL THEN b.score WHEN b.score IS NULL THEN a.score ELSE 0.7 * a.score + (1 - 0.7) * b.score END::DOUBLE AS score FROM a FULL OUTER JOIN b ON a.query_id = b.query_id AND a.case_id = b.case_id""")
def e14_fuse(s, d):
    a = t(s, d, "documents").select(F.col("doc_id").alias("query_id"), F.col("n_chars").alias("case_id"), (F.col("doc_id") % 10 / F.lit(10.0)).alias("score"))
    b = t(s, d, "conversations").groupBy(F.col("conv_id").alias("query_id"), F.col("turn").alias("case_id")).agg(F.max(F.col("turn") % 5 / F.lit(5.0)).alias("score"))
    return M.fuse_scores(a, b, 0.7)


@query(f"""WITH {P}, {S}, x AS ({_COS}), j AS (SELECT point, station, {km('p', 's')} AS km FROM p, s), o AS (SELECT *, row_number() OVER (PARTITION BY point ORDER BY km, station) AS n FROM j)
SELECT query_id, x.vec_id AS point, x.vec_id + 1 AS case_id, score, rank, p.lat, p.lng, o.station, o.km, c_name AS matched_name FROM x JOIN p ON p.point = x.vec_id JOIN o ON o.point = x.vec_id AND n = 1 LEFT JOIN customer ON c_custkey = x.vec_id + 1 AND c_custkey % 5 <> 0""")
def e15_route_matches(s, d):
    """A face was seen by the camera of its own number and belongs to the case after it; every fifth case has no name."""
    found = e12_embedding_topk(s, d).withColumnRenamed("vec_id", "point").withColumn("case_id", F.col("point") + 1)
    named = t(s, d, "customer").filter("c_custkey % 5 <> 0").select(F.col("c_custkey").cast("long").alias("case_id"), F.col("c_name").alias("name"))
    return MM.route_matches(found, points(s, d), stations(s, d), camera="point", station="station", cases=named)


@query(f"WITH {R}, e AS (SELECT max(reported_at) AS now FROM r) SELECT case_id, reported_at, zone FROM r, e WHERE floor(epoch(now)) - floor(epoch(reported_at)) > 72 * 3600 AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 100)")
def e16_open_cases(s, d):
    r = reports(s, d)
    now = r.agg(F.max("reported_at").alias("_now"))
    return M.open_cases(r.crossJoin(F.broadcast(now)), r.filter("event_type = 'signup' and resolution_hours > 100").select("user_id"), 72, F.col("_now"), id_="user_id").select("case_id", "reported_at", "zone")


@query("SELECT event_id AS case_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'signup')")
def e16_matched_cases(s, d):
    r = reports(s, d)
    return M.matched_cases(r, r.filter("event_type = 'signup'").select("user_id"), id_="user_id").select("case_id")


@query(f"""WITH {R}, u AS (SELECT case_id + 0 AS case_id, reported_at AS updated_at, 'old' AS version FROM r UNION ALL SELECT case_id, reported_at + INTERVAL 1 HOUR * (case_id % 3 - 1), 'new' FROM r WHERE event_type = 'error'),
k AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY updated_at DESC, CASE version WHEN 'new' THEN 1 ELSE 0 END DESC) AS n FROM u) SELECT case_id, updated_at, version FROM k WHERE n = 1""")
def a6_merge_reports(s, d):
    old = reports(s, d).select("case_id", F.col("reported_at").alias("updated_at"), F.lit("old").alias("version"), "event_type")
    new = old.filter("event_type = 'error'").withColumn("updated_at", F.expr("updated_at + make_dt_interval(0, cast(case_id % 3 - 1 as int))")).withColumn("version", F.lit("new"))
    return M.merge_reports(old.drop("event_type"), new.drop("event_type"))


# --- aggregations and windows ---


@query(f"""WITH {R}, c AS (SELECT center, date_trunc('day', reported_at) AS slot, count(*) AS cases FROM r GROUP BY 1, 2), b AS (SELECT center, min(slot) AS lo, max(slot) AS hi FROM c GROUP BY 1), g AS (SELECT center, unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY)) AS slot FROM b)
SELECT g.center, g.slot, coalesce(c.cases, 0) AS cases FROM g LEFT JOIN c ON g.center = c.center AND g.slot = c.slot""")
def f1_report_counts(s, d):
    return A.report_counts(reports(s, d), "day", "center").withColumn("slot", F.col("slot").cast("timestamp_ntz"))


@query(f"""WITH {R}, c AS (SELECT date_trunc('day', reported_at)::DATE AS day, count(*) AS cases FROM r GROUP BY 1), m AS (SELECT quantile_cont(cases, 0.5)::DOUBLE AS median FROM c), w AS (SELECT *, avg(cases) OVER (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS before FROM c)
SELECT day, cases, median, round(cases / before, 9) AS ratio FROM w, m WHERE cases >= 1.01 * median""")
def f2_spike_days(s, d):
    daily = reports(s, d).groupBy(F.to_date("reported_at").alias("day")).agg(F.count("*").alias("cases"))
    return A.spike_days(daily, 1.01).withColumn("ratio", F.round("ratio", 9))


@query(f"WITH {R}, c AS (SELECT center, age, count(*) AS n FROM r GROUP BY 1, 2) SELECT center, age, n, n / sum(n) OVER (PARTITION BY center)::DOUBLE AS share, (rank() OVER (PARTITION BY center ORDER BY n DESC))::INT AS rank FROM c")
def f3_distribution(s, d):
    return A.distribution(reports(s, d), "age", "center")


@query(f"""WITH {R} SELECT zone, count(*) AS cases, avg(CASE WHEN event_type = 'signup' THEN 1.0 ELSE 0.0 END)::DOUBLE AS resolved_share, round(avg(resolution_hours) FILTER (event_type = 'signup'), 6) AS mean_hours, round(quantile_cont(resolution_hours, 0.5) FILTER (event_type = 'signup'), 6) AS p50_hours, round(quantile_cont(resolution_hours, 0.9) FILTER (event_type = 'signup'), 6) AS p90_hours FROM r GROUP BY 1""")
def f4_resolution(s, d):
    out = A.resolution_summary(reports(s, d), "zone", status="event_type", hours="resolution_hours", resolved=("signup",))
    return out.withColumns({c: F.round(c, 6) for c in ("mean_hours", "p50_hours", "p90_hours")})


@query(f"""WITH {R}, w AS (SELECT * FROM r WHERE reported_at::DATE >= (SELECT min(reported_at)::DATE + 3 FROM r) AND reported_at::DATE < (SELECT min(reported_at)::DATE + 10 FROM r)) SELECT center, count(*) AS cases, avg((event_type = 'signup')::INT)::DOUBLE AS resolved_share, round(avg(resolution_hours) FILTER (event_type = 'signup'), 6) AS mean_hours, true AS near_p50, true AS near_p90, true AS near_persons FROM w GROUP BY 1""")
def f4_week_from_days(s, d):
    """A week from seven stored days: exact counts and mean, ranks of the percentiles within 5 % of the week's cases and persons within 5 % of those that reading all its reports gives."""
    r = reports(s, d).withColumn("day", F.to_date("reported_at"))
    start = F.broadcast(r.agg(F.date_add(F.min("day"), 3).alias("_from")))
    in_week = (F.col("day") >= F.col("_from")) & (F.col("day") < F.date_add("_from", 7))
    days = A.daily_sketches(r, "center", at="reported_at", status="event_type", hours="resolution_hours", person="user_id", resolved=("signup",)).checkpoint()
    week = A.summary_of_days(days.crossJoin(start).filter(in_week), "center")
    own = r.crossJoin(start).filter(in_week)
    signup = F.col("event_type") == "signup"
    below = lambda q: F.avg(F.when(signup, (F.col("resolution_hours") <= F.col(f"p{q}_hours")).cast("double")))
    upto = lambda q: F.avg(F.when(signup, (F.col("resolution_hours") < F.col(f"p{q}_hours")).cast("double")))
    held = own.join(week.select("center", "p50_hours", "p90_hours"), "center").groupBy("center").agg(below(50).alias("b50"), upto(50).alias("u50"), below(90).alias("b90"), upto(90).alias("u90"), F.countDistinct("user_id").alias("n"))
    near = lambda q: (F.col(f"u{q}") <= q / 100 + 0.05) & (F.col(f"b{q}") >= q / 100 - 0.05)
    return week.join(held, "center").select("center", "cases", "resolved_share", F.round("mean_hours", 6).alias("mean_hours"), near(50).alias("near_p50"), near(90).alias("near_p90"), (F.abs(F.col("persons") - F.col("n")) <= 0.05 * F.col("n") + 1).alias("near_persons"))


@query("WITH x AS (SELECT doc_id, source, min(doc_id) OVER (PARTITION BY text) AS a FROM documents), p AS (SELECT y.source AS s1, x.source AS s2 FROM x JOIN documents y ON y.doc_id = x.a WHERE x.doc_id <> x.a), b AS (SELECT s1 AS center, s2 AS other FROM p UNION ALL SELECT s2, s1 FROM p) SELECT center, other, count(*) AS shared FROM b GROUP BY 1, 2")
def f5_center_overlap(s, d):
    x, pairs = _equal_texts(s, d)
    own = x.select("doc_id", "source")
    named = pairs.join(own.select(F.col("doc_id").alias("a"), F.col("source").alias("center_a")), "a").join(own.select(F.col("doc_id").alias("b"), F.col("source").alias("center_b")), "b")
    return A.center_overlap(named)


_SOURCES = ["src0", "src1", "src2", "src3"]


@query("WITH x AS (SELECT doc_id, source, min(doc_id) OVER (PARTITION BY text) AS a FROM documents), p AS (SELECT y.source AS s1, x.source AS s2 FROM x JOIN documents y ON y.doc_id = x.a WHERE x.doc_id <> x.a), b AS (SELECT s1 AS center, s2 AS other FROM p UNION ALL SELECT s2, s1 FROM p) SELECT center, " + ", ".join(f"count(*) FILTER (other = '{x}') AS {x}" for x in _SOURCES) + " FROM b GROUP BY 1")
def f5_center_matrix(s, d):
    x, pairs = _equal_texts(s, d)
    own = x.select("doc_id", "source")
    named = pairs.join(own.select(F.col("doc_id").alias("a"), F.col("source").alias("center_a")), "a").join(own.select(F.col("doc_id").alias("b"), F.col("source").alias("center_b")), "b")
    return A.center_matrix(named, _SOURCES)


@query("WITH x AS (SELECT doc_id, source AS center, min(doc_id) OVER (PARTITION BY text) AS a FROM documents) SELECT center, count(*) AS cases, sum(CASE WHEN doc_id <> a THEN 1 ELSE 0 END)::BIGINT AS duplicates, round(avg(CASE WHEN doc_id <> a THEN 1.0 ELSE 0.0 END), 9)::DOUBLE AS share FROM x GROUP BY 1")
def f5_duplicate_share(s, d):
    clusters = M.duplicate_clusters(_equal_texts(s, d)[1])
    return MM.duplicate_share(t(s, d, "documents"), clusters, id_="doc_id", center="source").withColumn("share", F.round("share", 9))


@query("SELECT r_name AS state, n_name AS district, count(*) AS cases, grouping_id(r_name, n_name)::BIGINT AS level FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def f6_origin_rollup(s, d):
    n = t(s, d, "nation").join(t(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    cases = t(s, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("r_name").alias("state"), F.col("n_name").alias("district"))
    return A.origin_rollup(cases, ["state", "district"])


@query(f"WITH {R} SELECT zone, age, event_type, count(*) AS cases, grouping_id(zone, age, event_type)::BIGINT AS level FROM r GROUP BY CUBE (zone, age, event_type)")
def f6_cube(s, d):
    return A.cube_counts(reports(s, d), ["zone", "age", "event_type"])


@query(f"WITH {R} SELECT center, age, zone, count(*) AS cases, grouping_id(center, age, zone)::BIGINT AS level FROM r GROUP BY GROUPING SETS ((center), (age), (zone, center), ())")
def f6_grouping_sets(s, d):
    return A.grouping_counts(reports(s, d), ["center", "age", "zone"], [["center"], ["age"], ["zone", "center"], []])


@query(f"""WITH {R}, {P}, {Z}, l AS (SELECT zone - 1 AS zone, count(*) AS n FROM r GROUP BY 1), j AS (SELECT point, zone, {km('p', 'z')} AS km FROM p, z), w AS (SELECT zone, sum((point % 3 + 1)::DOUBLE) AS w FROM j WHERE km <= 1 GROUP BY 1),
x AS (SELECT z.zone, lat, lng, coalesce(n, 0) / sum(n) OVER () * (1 + coalesce(w, 0.0)) AS r FROM z LEFT JOIN l USING (zone) LEFT JOIN w USING (zone)), y AS (SELECT zone, lat, lng, round(r / max(r) OVER (), 9) AS risk FROM x)
SELECT *, (row_number() OVER (ORDER BY risk DESC, zone))::INT AS rank FROM y ORDER BY risk DESC, zone LIMIT 10""")
def f7_hotspots(s, d):
    cases = reports(s, d).select((F.col("zone") - 1).cast("long").alias("zone"))
    marked = points(s, d).withColumn("risk", (F.col("point") % 3 + 1).cast("double"))
    return G.zone_hotspots(cases, marked, zones(s, d), 1.0, 10, zone="zone", point="point", risk="risk")


@query(f"""WITH {R}, l AS (SELECT zone, date_trunc('hour', reported_at) AS slot, count(*) AS cases FROM r GROUP BY 1, 2), q AS (SELECT 'counsellor' AS resource, 2 AS cpu UNION ALL SELECT 'desk', 3), u AS (SELECT zone, slot, resource, ceil(cases / cpu::DOUBLE)::BIGINT AS units FROM l, q)
SELECT zone, resource, sum(units)::BIGINT AS units, max(units) AS peak_units, arg_min(slot, (-units, slot)) AS peak_slot FROM u GROUP BY 1, 2""")
def f8_resources(s, d):
    load = reports(s, d).groupBy("zone", F.date_trunc("hour", "reported_at").cast("timestamp_ntz").alias("slot")).agg(F.count("*").alias("cases"))
    rates = s.createDataFrame([("counsellor", 2), ("desk", 3)], "resource string, cases_per_unit int")
    return A.resource_needs(load, rates)


@query(f"""WITH {R}, p AS (SELECT zone, hour(reported_at) AS h, count(*) AS cases FROM r GROUP BY 1, 2), g AS (SELECT zone, unnest(range(0, 48)) AS hour FROM (SELECT DISTINCT zone FROM p))
SELECT g.zone, g.hour::INT AS hour, round(coalesce(p.cases, 0) * 1000000.0 * 0.001 / (SELECT sum(cases) FROM p), 6)::DOUBLE AS expected FROM g LEFT JOIN p ON g.zone = p.zone AND g.hour % 24 = p.h""")
def f9_project_load(s, d):
    profile = reports(s, d).groupBy("zone", F.hour("reported_at").alias("hour_of_day")).agg(F.count("*").alias("cases"))
    return A.project_load(profile, 1_000_000, 0.001, 48).withColumn("expected", F.round("expected", 6))


_STEPS = "CASE " + " ".join(f"WHEN u < {b!r} THEN {k}" for b, k in ((0.36787944117144233, 0), (0.7357588823428847, 1), (0.9196986029286058, 2), (0.9810118431238462, 3), (0.9963401531726563, 4), (0.9994058151824183, 5), (0.9999167588507119, 6), (0.9999897508033253, 7))) + " ELSE 8 END"


@query(f"""WITH {R}, g AS (SELECT zone, ('0x' || substr(md5('1:' || case_id || ':' || rep), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u, rep FROM r, (SELECT unnest(range(1, 21)) AS rep)),
n AS (SELECT zone, rep, sum({_STEPS}) AS n FROM g GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY n DESC, zone) <= 5 AS top FROM n) SELECT zone, round(quantile_cont(n, 0.05), 6)::DOUBLE AS p05, round(quantile_cont(n, 0.5), 6)::DOUBLE AS p50, round(quantile_cont(n, 0.95), 6)::DOUBLE AS p95, round(avg(top::INT), 6)::DOUBLE AS in_top FROM k GROUP BY 1""")
def f10_bootstrap(s, d):
    return A.bootstrap_hotspots(reports(s, d), "zone", 20, 5, key="case_id").withColumns({c: F.round(c, 6) for c in ("p05", "p50", "p95", "in_top")})


@query(f"""WITH {R}, e AS (SELECT center, reported_at AS "at", 1 AS d FROM r UNION ALL SELECT center, reported_at + INTERVAL 1 HOUR * (case_id % 48), -1 FROM r WHERE event_type = 'signup'), n AS (SELECT center, "at", sum(d)::BIGINT AS d FROM e GROUP BY 1, 2), o AS (SELECT center, "at", sum(d) OVER (PARTITION BY center ORDER BY "at")::BIGINT AS open FROM n)
SELECT center, "at", open, max(open) OVER (PARTITION BY center ORDER BY "at") AS peak FROM o""")
def f11_backlog(s, d):
    r = reports(s, d)
    closed = F.when(F.col("event_type") == "signup", F.expr("reported_at + make_dt_interval(0, cast(case_id % 48 as int))"))
    return A.open_backlog(r, "center", F.col("reported_at"), closed)


@query(f"WITH {R}, c AS (SELECT center, zone, count(*) AS n FROM r GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY center ORDER BY n DESC, zone) AS rank FROM c) SELECT center, zone, n, rank::INT AS rank FROM k WHERE rank <= 3")
def f12_top_locations(s, d):
    return A.top_locations(reports(s, d), "zone", "center", 3)


@query(f"WITH {R} SELECT zone, count(*) AS reports, count(DISTINCT user_id) AS persons, count(*) / count(DISTINCT user_id)::DOUBLE AS per_person FROM r GROUP BY 1")
def f13_persons(s, d):
    return A.distinct_persons(reports(s, d), "user_id", "zone").drop("approx_persons")


@query("WITH x AS (SELECT source, count(*) AS reports, count(DISTINCT text) AS persons FROM documents GROUP BY 1) SELECT source, reports, persons, reports / persons::DOUBLE AS per_person, true AS near FROM x")
def f13_persons_merged(s, d):
    """Equal texts are one person; the approximate count lies within a fifth of the exact one."""
    out = A.distinct_persons(t(s, d, "documents").select("doc_id", "source"), "doc_id", "source", M.duplicate_clusters(_equal_texts(s, d)[1]))
    return out.withColumn("near", F.abs(F.col("approx_persons") - F.col("persons")) <= 0.2 * F.col("persons")).drop("approx_persons")


@query("""WITH c AS (SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'es') AS es FROM documents GROUP BY 1) SELECT *, (en + fr + de + es) / sum(en + fr + de + es) OVER ()::DOUBLE AS share FROM c""")
def f14_language_need(s, d):
    return A.language_need(t(s, d, "documents").select("source", "lang"), "source", "lang", ["en", "fr", "de", "es"])


@query("WITH x AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seen, floor(epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) AS l FROM events) SELECT event_id, seen::INT AS seen, (floor(epoch(ts)) - l) / 3600.0 AS hours_since FROM x")
def f13_person_timeline(s, d):
    return MM.person_timeline(t(s, d, "events"), "user_id", "ts", "event_id").select("event_id", "seen", "hours_since")


# --- sets ---


@query("SELECT s_suppkey AS key, s_nationkey AS nation FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49.5)")
def j1_registry_gap(s, d):
    sent = t(s, d, "lineitem").filter("l_returnflag = 'R' and l_quantity > 49.5").select(F.col("l_suppkey").alias("key"))
    return A.registry_gap(t(s, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation")), sent, "key")


@query("SELECT c_nationkey AS nation, c_custkey % 7 AS k FROM customer EXCEPT ALL SELECT s_nationkey, s_suppkey % 7 FROM supplier")
def j1_changed_versions(s, d):
    return A.changed_versions(t(s, d, "customer").select(F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 7).alias("k")), t(s, d, "supplier").select(F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 7).alias("k")))


@query("SELECT c_nationkey AS nation, c_custkey % 7 AS k FROM customer INTERSECT SELECT s_nationkey, s_suppkey % 7 FROM supplier")
def j2_registry_shared(s, d):
    return A.registry_shared(t(s, d, "customer").select(F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 7).alias("k")), t(s, d, "supplier").select(F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 7).alias("k")))


# --- graph: stations and zones as nodes ---


def nodes(s, d):
    return N.graph_nodes(station=stations(s, d).withColumnRenamed("station", "name"), zone=zones(s, d).withColumnRenamed("zone", "name"))


V = f"{S}, {Z}, v AS (SELECT 'station:' || station AS id, 'station' AS kind, station::VARCHAR AS name, lat, lng FROM s UNION ALL SELECT 'zone:' || zone, 'zone', zone::VARCHAR, lat, lng FROM z)"
E = f"a AS (SELECT x.id, y.id AS dst, {km('x', 'y')} AS km FROM v x, v y), b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY km, dst) AS n FROM a), e AS (SELECT least(id, dst) AS src, greatest(id, dst) AS dst, min(km) AS km FROM b WHERE id <> dst AND (km <= 1 OR n <= 3) GROUP BY 1, 2)"


@query(f"WITH {V} SELECT * FROM v")
def g1_nodes(s, d):
    return nodes(s, d)


def _triples(s, d, cases=None):
    ids = lambda df, kind: df.select(F.concat(F.lit(kind + ":"), F.col(kind).cast("string")).alias("id"), "lat", "lng")
    return N.graph_triples(nodes(s, d), ids(zones(s, d), "zone"), ids(stations(s, d), "station"), 0.75, cases)


T = f"""a AS (SELECT x.id, y.id AS dst, y.kind, {km('x', 'y')} AS km FROM v x, v y), b AS (SELECT *, row_number() OVER (PARTITION BY id, kind ORDER BY km, dst) AS n FROM a),
t AS (SELECT id AS subject, CASE kind WHEN 'zone' THEN 'located_in' ELSE 'served_by' END AS predicate, dst AS object FROM b WHERE n = 1 UNION ALL SELECT id, 'near', dst FROM a WHERE km <= 0.75 AND id <> dst)"""


@query(f"WITH {V}, {T} SELECT * FROM t")
def g2_triples(s, d):
    return _triples(s, d)


@query(f"WITH {V}, {T}, {R} SELECT * FROM t UNION ALL SELECT 'case:' || case_id, 'reported_at', 'center:' || center FROM r UNION ALL SELECT 'case:' || case_id, 'last_seen_at', 'place:' || zone FROM r WHERE zone % 4 <> 0")
def g2_triples_of_cases(s, d):
    cases = reports(s, d).select(F.col("case_id").alias("id"), "center", F.when(F.col("zone") % 4 != 0, F.col("zone")).alias("place"))
    return _triples(s, d, cases)


@query(f"WITH {V}, {E}, b2 AS (SELECT src AS id, dst FROM e UNION ALL SELECT dst, src FROM e), n AS (SELECT id, count(DISTINCT dst) AS n FROM b2 GROUP BY 1) SELECT id, n, (rank() OVER (ORDER BY n DESC))::INT AS rank FROM n")
def g3_degree(s, d):
    return N.degree(N.proximity_edges(nodes(s, d), 1.0, 2))


@query(f"WITH {V}, {E} SELECT * FROM e")
def g3_edges(s, d):
    return N.proximity_edges(nodes(s, d), 1.0, 2)


@query(f"WITH {V}, {E} SELECT src, dst, km + 5.0 * ((src LIKE 'zone:%')::INT + (dst LIKE 'zone:%')::INT) AS km FROM e")
def g4_penalty(s, d):
    v = nodes(s, d)
    return N.avoid(N.proximity_edges(v, 1.0, 2), v.filter("kind = 'zone'"), 5.0)


@query(f"WITH {V}, {E} SELECT * FROM e WHERE src NOT LIKE 'zone:%' AND dst NOT LIKE 'zone:%'")
def g4_avoid(s, d):
    v = nodes(s, d)
    return N.avoid(N.proximity_edges(v, 1.0, 2), v.filter("kind = 'zone'"))


def _shortest(rounds: int, closed: str | None = None) -> str:
    """Distances from every zone, one round of relaxing at a time; nodes 4 km apart or less are joined, so paths are short. Those of the view ``closed`` are left by their own paths only."""
    leave = f" AND (node = source OR node NOT IN (SELECT id FROM {closed}))" if closed else ""
    raw = km("x", "y").removeprefix("round(").removesuffix(", 6)")
    near = f"a AS MATERIALIZED (SELECT x.id, y.id AS dst, {km('x', 'y')} AS km, {raw} AS raw FROM v x, v y), b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY km, dst) AS n FROM a), e AS MATERIALIZED (SELECT least(id, dst) AS src, greatest(id, dst) AS dst, min(raw) AS km FROM b WHERE id <> dst AND (km <= 4 OR n <= 3) GROUP BY 1, 2)"
    out = [near, "w AS MATERIALIZED (SELECT src, dst, km FROM e UNION ALL SELECT dst, src, km FROM e)", "d0 AS MATERIALIZED (SELECT id AS source, id AS node, 0.0::DOUBLE AS km FROM v WHERE kind = 'zone')"]
    for i in range(1, rounds + 1):
        out.append(f"d{i} AS MATERIALIZED (SELECT source, node, min(km) AS km FROM (SELECT * FROM d{i - 1} UNION ALL SELECT source, dst, d{i - 1}.km + w.km FROM d{i - 1} JOIN w ON src = node{leave}) GROUP BY 1, 2)")
    return ", ".join(out)


@query(f"WITH {V}, {_shortest(24)} SELECT source, node, round(km, 6) AS km FROM d24")
def g5_shortest(s, d):
    v = nodes(s, d)
    return N.shortest_paths(N.Nearby(v, 4.0, 2), v.filter("kind = 'zone'")).select("source", "node", F.round("km", 6).alias("km"))


#: Places that routes avoid: two thirds of the stations and every third zone.
_BLOCKED = "(kind = 'station' AND name::INT % 3 <> 0) OR (kind = 'zone' AND name::INT % 3 = 0)"


@query(f"WITH {V}, k AS (SELECT id FROM v WHERE {_BLOCKED}), {_shortest(24, 'k')}, g AS (SELECT unnest([min(id), max(id)]) AS goal FROM v WHERE kind = 'zone') SELECT id AS start, goal, round(d24.km, 6) AS distance_km, d24.km IS NOT NULL AS whole, d24.km IS NOT NULL AS clear FROM v, g LEFT JOIN d24 ON source = v.id AND node = goal WHERE kind = 'zone'")
def g6_routes(s, d):
    """From every zone to two of them, some of them blocked. A whole route begins at its start, ends at its goal, has a step for each place, and its ways add up; a clear one passes through no blocked place."""
    v = nodes(s, d)
    shut = v.filter("(kind = 'station' and cast(name as int) % 3 <> 0) or (kind = 'zone' and cast(name as int) % 3 = 0)")
    z = v.filter("kind = 'zone'")
    ends = z.agg(F.array(F.min("id"), F.max("id")).alias("_g")).select(F.explode("_g").alias("goal"))
    asked = z.select(F.col("id").alias("start")).crossJoin(F.broadcast(ends))
    found = N.best_routes(asked, v, N.Nearby(v, 4.0, 2), blocked=shut)
    name = lambda c: F.substring_index(c, ":", -1)
    far = F.aggregate(F.zip_with(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(1))), F.slice("path", 2, F.size("path")), lambda a, b: F.coalesce(C.haversine_km(a["lat"], a["lng"], b["lat"], b["lng"]), F.lit(0.0))), F.lit(0.0), lambda x, y: x + y)
    whole = (F.element_at("path", 1)["name"] == name(F.col("start"))) & (F.element_at("path", -1)["name"] == name(F.col("goal"))) & (F.size("steps") == F.size("path")) & (F.abs(far - F.col("distance_km")) < 1e-6)
    # places between the ends, by their coordinates, as stations and zones share names
    through = found.select("start", "goal", F.explode(F.slice("path", 2, F.greatest(F.size("path") - 2, F.lit(0)))).alias("_p"))
    met = through.join(shut.select("name", "lat", "lng"), (F.col("_p.name") == F.col("name")) & (F.col("_p.lat") == F.col("lat")) & (F.col("_p.lng") == F.col("lng"))).select("start", "goal").distinct().withColumn("_met", F.lit(True))
    return found.join(met, ["start", "goal"], "left").select("start", "goal", F.round("distance_km", 6).alias("distance_km"), F.coalesce(whole, F.lit(False)).alias("whole"), (F.col("distance_km").isNotNull() & F.col("_met").isNull()).alias("clear"))


@query(f"WITH {V}, {T} SELECT x.subject AS n0, x.object AS n1, y.object AS n2 FROM t x JOIN t y ON x.object = y.subject WHERE x.predicate = 'near' AND y.predicate = 'located_in'")
def g7_pattern(s, d):
    return N.match_pattern(_triples(s, d), ["near", "located_in"])


QUERIES |= I.QUERIES | STREAM_QUERIES
ORACLE |= I.ORACLE | STREAM_ORACLE
