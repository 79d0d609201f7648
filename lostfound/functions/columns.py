"""Column functions of the registry: names, mobiles, ages, ids, statuses, descriptions, distances (B, D1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
#: Accented letters and the plain ones that stand for them.
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
#: White space of any script at either end of a text.
OUTER_SPACE = r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$"
#: Words that say nothing in a description.
STOP_WORDS = ("a", "an", "and", "the", "of", "in", "is", "with", "was", "has", "had", "on", "at", "to", "for")


def blank_to_null(df: DataFrame, cols: list[str]) -> DataFrame:
    """Blank or white-space text is missing, and no text begins or ends with white space: blanks, tabs, line ends, those of other scripts."""
    return df.withColumns({c: F.nullif(strip(F.col(c)), F.lit("")) for c in cols})


def strip(text: Column) -> Column:
    """``text`` without white space at its ends."""
    return F.regexp_replace(text, OUTER_SPACE, "")


def normalize_name(name: Column) -> Column:
    """Lower case, accents folded, signs gone, one space between words, spelling variants folded (B4). Blank is null."""
    folded = F.translate(F.lower(name), ACCENTED, PLAIN)
    for pattern, to in (("[^a-z0-9 ]", " "), ("ksh", "x"), ("ph", "f"), ("w", "v"), ("ee", "i"), ("oo", "u"), (" +", " ")):
        folded = F.regexp_replace(folded, pattern, to)
    return F.nullif(F.trim(folded), F.lit(""))


def name_key(name: Column) -> Column:
    """Blocking key: first letter and the consonants after it, six at most."""
    folded = F.regexp_replace(normalize_name(name), " ", "")
    return F.substring(F.concat(F.substring(folded, 1, 1), F.regexp_replace(F.substring(folded, 2, 1_000_000), "[aeiouy]", "")), 1, 6)


def parse_reported_at(text: Column) -> Column:
    """``YYYY-MM-DD HH:MM`` to a timestamp; anything else is null."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm"))


def normalize_mobile(text: Column) -> Column:
    """The last ten digits; null if there are fewer."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.when(F.length(digits) >= 10, F.right(digits, F.lit(10)))


def age_bounds(band: Column) -> Column:
    """``61-70`` to (61, 70), ``80+`` to (80, null); other text to (null, null)."""
    low = F.regexp_extract(band, r"^\s*(\d{1,3})\s*(?:-\s*\d{1,3}|\+)\s*$", 1).try_cast("int")
    high = F.regexp_extract(band, r"^\s*\d{1,3}\s*-\s*(\d{1,3})\s*$", 1).try_cast("int")
    return F.struct(low.alias("low"), high.alias("high"))


def ages_overlap(a: Column, b: Column) -> Column:
    """Whether two age intervals meet; null where one is unknown."""
    top = lambda x: F.coalesce(x["high"], F.lit(200))
    return (a["low"] <= top(b)) & (b["low"] <= top(a))


def parse_ids(df: DataFrame, case_id: str | None = "case_id", camera_id: str | None = None, zone: str | None = None) -> DataFrame:
    """Case prefix, year and number; camera zone and number; zone number (B8). What does not parse is null."""
    number = lambda c, p, g: F.regexp_extract(F.col(c), p, g).try_cast("int")
    new = {}
    if case_id:
        new |= {"case_prefix": F.nullif(F.regexp_extract(case_id, r"^([A-Z]+)-", 1), F.lit("")), "case_year": number(case_id, r"^[A-Z]+-(\d{4})-\d+$", 1), "case_number": number(case_id, r"-(\d+)$", 1)}
    if camera_id:
        new |= {"zone_no": number(camera_id, r"^Z(\d+)-C\d+$", 1), "camera_no": number(camera_id, r"^Z\d+-C(\d+)$", 1)}
    if zone:
        new["zone_no"] = number(zone, r"^Zone Area (\d+)$", 1)
    return df.withColumns(new)


def map_status(source: Column) -> Column:
    """Source status to case status (B10): Reunited stays, any other known status is Active."""
    return F.when(source == "Reunited", "Reunited").when(source.isNotNull(), "Active")


def describe_tokens(text: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Distinct folded words of a description without stop words, sorted (B11); null for null."""
    words = F.split(F.trim(F.regexp_replace(F.translate(F.lower(text), ACCENTED, PLAIN), "[^a-z0-9]+", " ")), " ")
    return F.array_sort(F.array_except(F.array_distinct(words), F.array(*[F.lit(w) for w in ("", *stop_words)])))


def mask_person(df: DataFrame, *, name: str = "name", mobile: str = "reporter_mobile", salt: str = "lostfound") -> DataFrame:
    """Shareable view (B12): initials, last two digits, and a salted hash of the mobile to join by."""
    initials = F.array_join(F.transform(F.split(F.trim(F.col(name)), r"\s+"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lit("."))), " ")
    own = normalize_mobile(F.col(mobile))
    return df.withColumns({"mobile_key": F.sha2(F.concat(F.lit(salt + ":"), own), 256), name: initials, mobile: F.concat(F.lit("********"), F.right(own, F.lit(2)))})


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in km (D1); null where a coordinate is."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.when(a > 1, F.lit(1.0)).otherwise(a)))
