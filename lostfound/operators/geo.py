"""Nearest places, radius joins, geocoding and coverage (D, C3)."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lostfound.functions.columns import EARTH_KM, haversine_km, name_key, normalize_name

#: Places that may go to every task.
PLACE_ROWS = 200


def nearest_k(left: DataFrame, places: DataFrame, k: int, *, id_: str, place: str, rows: int = PLACE_ROWS) -> DataFrame:
    """(id, place, km, rank): the k nearest places of each row with lat, lng; ties by place (D2). All places, if there are fewer.

    Up to ``rows`` places, a number that is checked, go to all tasks, and each row looks at all of them. More places are searched in boxes
    that are halved level by level, and only those that may hold one of the k nearest go on, however places and rows are spread. The results are the same.
    """
    p = places.select(F.col(place).alias("p"), F.col("lat").alias("a"), F.col("lng").alias("o")).filter("a is not null and o is not null")
    own = left.select(id_, "lat", "lng").filter("lat is not null and lng is not null")
    n = p.limit(rows + 1).count()
    if n > rows:
        return _nearest_by_boxes(own, p, k, id_=id_, place=place)
    if not n:
        return own.select(id_, F.lit(None).cast(dict(places.dtypes)[place]).alias(place), F.lit(0.0).alias("km"), F.lit(1).alias("rank")).limit(0)
    every = p.agg(F.collect_list(F.struct("p", "a", "o")).alias("_all"))
    far = lambda x: F.round(haversine_km(F.col("lat"), F.col("lng"), x["a"], x["o"]), 6)
    near = F.transform("_all", lambda x: F.struct(far(x).alias("km"), x["p"].alias("p")))
    best = F.array(F.array_min(near)) if k == 1 else F.slice(F.array_sort(near), 1, k)
    # rows of a small file are one task; they are dealt first
    met = own.repartition(F.col(id_)).crossJoin(F.broadcast(every))
    return met.select(id_, F.posexplode(best).alias("_i", "_x")).select(id_, F.col("_x.p").alias(place), F.col("_x.km").alias("km"), (F.col("_i") + 1).cast("int").alias("rank"))


#: Kilometres of a degree of latitude.
DEGREE_KM = math.pi * EARTH_KM / 180


def grid(km: float) -> tuple[Callable[[Column], Column], Callable[[Column], Column], Callable[[Column, Column], Column]]:
    """(band of a latitude, columns of a band, column of a longitude): cells so wide that all within ``km`` of a place lie in its own or the next ones.

    Rows of the grid are bands of latitude; each has as many columns as the radius allows at its own latitude, and columns go around the earth.
    """
    reach = km * (1 + 1e-6) + 1e-6  # distances are rounded to 6 digits
    half = min(reach / (2 * EARTH_KM), math.pi / 2)
    step = max(math.degrees(2 * half), 1e-6)

    def columns(row: Column) -> Column:
        """Columns of a band: none is narrower than the radius at the latitude nearest to a pole of its own and the next bands."""
        far = F.least(F.lit(90.0), F.greatest(F.abs((row - 1) * step - 90), F.abs((row + 2) * step - 90)))
        width = F.degrees(2 * F.asin(F.least(F.lit(1.0), F.lit(math.sin(half)) / F.greatest(F.cos(F.radians(far)), F.lit(1e-9)))))
        return F.greatest(F.lit(1), F.floor(F.lit(360.0) / width))

    return lambda lat: F.floor((lat + 90) / F.lit(step)), columns, lambda lng, n: F.least(n - 1, F.floor(F.pmod(lng + 180, F.lit(360.0)) * n / 360.0))


def around(places: DataFrame, lat: str, lng: str, km: float) -> DataFrame:
    """``places`` once for each cell ``_r, _c`` of the grid that holds rows within ``km`` of it: its own and the eight next to it."""
    band, columns, column = grid(km)
    b = places.withColumn("_r", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: band(F.col(lat)) + i))).withColumn("_n", columns(F.col("_r")))
    at = column(F.col(lng), F.col("_n"))
    return b.withColumn("_c", F.explode(F.array_distinct(F.array(*[F.pmod(at + i, F.col("_n")) for i in (-1, 0, 1)])))).drop("_n")


#: Halvings of the cube around the earth (cells of 12 metres), places of a cell with which they end.
LEVELS, LEAF_ROWS = 20, 4


def _cell(level: int) -> Column:
    """The cell of a level, of the finest one's three numbers."""
    x, y, z = (F.shiftright(c, LEVELS - level).cast("long") for c in ("_ix", "_iy", "_iz"))
    return F.shiftleft(x, 42).bitwiseOR(F.shiftleft(y, 21)).bitwiseOR(z)


def _in_space(df: DataFrame) -> DataFrame:
    """``df`` with the place of lat, lng on the unit sphere and the numbers of its finest cell."""
    lat, lng = F.radians("lat"), F.radians("lng")
    at = df.withColumns({"_x": F.cos(lat) * F.cos(lng), "_y": F.cos(lat) * F.sin(lng), "_z": F.sin(lat)})
    return at.withColumns({f"_i{c}": F.floor((F.col(f"_{c}") + 1) * (1 << (LEVELS - 1))) for c in "xyz"})


def _boxes(df: DataFrame, level: int, name: str) -> DataFrame:
    """(cell of the level, cell above it, rows, least and largest coordinates): what lies in each cell."""
    sides = [f(f"_{c}").alias(f"{name}{c}{i}") for c in "xyz" for i, f in enumerate((F.min, F.max))]
    return df.groupBy(_cell(level).alias(name), _cell(level - 1).alias(f"{name}_up")).agg(F.count("*").alias(f"{name}_n"), *sides)


def _nearest_by_boxes(own: DataFrame, p: DataFrame, k: int, *, id_: str, place: str) -> DataFrame:
    """:func:`nearest_k` of places ``p, a, o``. Rows of one position are searched once; of the places of one position only the k smallest can be among the nearest.

    Cells of rows meet cells of places, level by level. At each level a cell of rows keeps the cells of places that begin before the one ends by which k places are
    sure; distances between cells are those of the smallest boxes around their members. What is left at the last level is measured.
    """
    here = F.row_number().over(Window.partitionBy("a", "o").orderBy("p"))
    p = _in_space(p.withColumn("_n", here).filter(F.col("_n") <= k).select("p", F.col("a").alias("lat"), F.col("o").alias("lng"))).checkpoint()
    spots = _in_space(own.select("lat", "lng").distinct()).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    held = p.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), _cell(i).alias("c")) for i in range(1, LEVELS + 1)])).alias("_v")).groupBy("_v").agg(F.count("*").alias("_n"))
    crowds = {r["i"]: (r["cells"], r["mean"]) for r in held.groupBy("_v.i").agg(F.count("*").alias("cells"), (F.sum(F.col("_n") * F.col("_n")) / F.sum("_n")).alias("mean")).collect()}
    last = min((i for i, (_, mean) in crowds.items() if mean <= LEAF_ROWS), default=LEVELS)
    first = min(last, max((i for i, (cells, _) in crowds.items() if cells <= 16), default=1))
    gap = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"_p{c}0") - F.col(f"_l{c}1"), F.col(f"_l{c}0") - F.col(f"_p{c}1")), F.lit(2)) for c in "xyz"), F.lit(0.0))
    span = sum((F.pow(F.greatest(F.col(f"_p{c}1") - F.col(f"_l{c}0"), F.col(f"_l{c}1") - F.col(f"_p{c}0")), F.lit(2)) for c in "xyz"), F.lit(0.0))
    w = Window.partitionBy("_l")
    pairs = None
    for level in range(first, last + 1):
        mine, theirs = _boxes(spots, level, "_l"), _boxes(p, level, "_p")
        if pairs is None:
            met = mine.crossJoin(F.broadcast(theirs))
        else:
            up = pairs.select(F.col("_l").alias("_l_up"), F.col("_p").alias("_p_up"))
            met = up.join(mine.hint("merge"), "_l_up").join(theirs.hint("merge"), "_p_up")
        met = met.select("_l", "_p", F.col("_p_n").alias("_n"), F.sqrt(gap).alias("_from"), F.sqrt(span).alias("_to"))
        sure = F.sum("_n").over(w.orderBy("_to", "_p").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        # a little more than what rounding to six digits of a kilometre may hide
        near = met.withColumn("_sure", sure).withColumn("_end", F.min(F.when(F.col("_sure") >= k, F.col("_to"))).over(w)).filter(F.col("_end").isNull() | (F.col("_from") <= F.col("_end") + 1e-9))
        pairs = near.select("_l", "_p").checkpoint()
    asked = pairs.join(p.select(_cell(last).alias("_p"), "p", F.col("lat").alias("a"), F.col("lng").alias("o")).hint("merge"), "_p").drop("_p")
    d = F.round(haversine_km(F.col("lat"), F.col("lng"), F.col("a"), F.col("o")), 6)
    far = spots.select(_cell(last).alias("_l"), "_at", "lat", "lng").join(asked.hint("merge"), "_l").select("_l", "_at", "lat", "lng", "p", d.alias("km"))
    # all of a position is where its cell is, so nothing more is shuffled
    best = far.withColumn("rank", F.row_number().over(Window.partitionBy("_l", "_at").orderBy("km", "p"))).filter(F.col("rank") <= k).select("lat", "lng", F.col("p").alias(place), "km", "rank")
    return own.join(best.hint("merge"), ["lat", "lng"]).select(id_, place, "km", "rank")


#: Pairs of rows that share a cell and are held against each other in one task.
PAIR_ROWS = 2_000_000


def within_radius(left: DataFrame, right: DataFrame, km: float, *, id_: str, other: str, exact: bool = False) -> DataFrame:
    """(id, other, km) of all pairs within ``km``, large x large (D3): cells of :func:`grid`, the right side dealt to its nine cells. Rows without a position match nothing.

    Cells are counted first, for as many tasks as there are pairs to hold against each other; a cell of more than ``PAIR_ROWS`` pairs is dealt to parts of both sides that
    meet in tasks of their own. So no task has more pairs because a table is a small file or a cell is crowded. Distances have six digits; with ``exact`` they are returned unrounded.
    """
    spark = left.sparkSession
    band, columns, column = grid(km)
    a = left.filter("lat is not null and lng is not null").select(id_, "lat", "lng", band(F.col("lat")).alias("_r"))
    a = a.withColumn("_c", column(F.col("lng"), columns(F.col("_r"))))
    b = right.select(F.col(other).alias("_o"), F.col("lat").alias("_lat"), F.col("lng").alias("_lng")).filter("_lat is not null and _lng is not null")
    b = around(b, "_lat", "_lng", km)
    cells = a.select("_r", "_c", F.lit(1).alias("_x"), F.lit(0).alias("_y")).unionAll(b.select("_r", "_c", F.lit(0), F.lit(1))).groupBy("_r", "_c").agg(F.sum("_x").alias("_x"), F.sum("_y").alias("_y"))
    # parts of a cell that has too many pairs, on either side
    side = math.isqrt(PAIR_ROWS)
    both = F.col("_x").cast("double") * F.col("_y")
    hot = cells.filter(both > PAIR_ROWS).select("_r", "_c", F.ceil(F.col("_x") / side).cast("int").alias("_mx"), F.ceil(F.col("_y") / side).cast("int").alias("_my"))
    size = cells.agg(F.sum(both).alias("pairs"), F.sum(F.col("_x") + F.col("_y")).alias("rows"), F.max(both).alias("most")).first()
    pairs, n_rows = size["pairs"] or 0.0, size["rows"] or 0
    n = max(math.ceil(pairs / PAIR_ROWS) + math.ceil(n_rows / PAIR_ROWS), min(spark.sparkContext.defaultParallelism, math.ceil(pairs / 50_000)), 1)
    keys = ["_r", "_c"]
    if (size["most"] or 0) > PAIR_ROWS:
        hot = hot.checkpoint()
        deal = lambda df, own, m, rest: df.join(F.broadcast(hot), ["_r", "_c"], "left").withColumn(f"_s{m}", F.pmod(F.xxhash64(own), F.coalesce(f"_m{m}", F.lit(1))).cast("int")).withColumn(f"_s{rest}", F.explode(F.sequence(F.lit(0), F.coalesce(f"_m{rest}", F.lit(1)) - 1))).drop("_mx", "_my")
        a, b, keys = deal(a, id_, "x", "y"), deal(b, "_o", "y", "x"), ["_r", "_c", "_sx", "_sy"]
    met = a.repartition(n, *keys).join(b.repartition(n, *keys).hint("merge"), keys)
    d = haversine_km(F.col("lat"), F.col("lng"), F.col("_lat"), F.col("_lng"))
    reach = km * (1 + 1e-6) + 1e-6  # rounding is dear, so it is left to those near enough
    near = met.filter((F.abs(F.col("lat") - F.col("_lat")) <= reach / DEGREE_KM) & (d <= reach)).filter(F.round(d, 6) <= km)
    return near.select(id_, F.col("_o").alias(other), (d if exact else F.round(d, 6)).alias("km"))


def place_aliases(places: DataFrame, name: str = "name") -> DataFrame:
    """One row per alternate name of a place, " / " between them."""
    return places.withColumn("alias", F.explode(F.split(F.col(name), " / "))).withColumn("alias", F.trim("alias"))


#: Characters of a name whose deletions are listed; hashes of texts that may go to all tasks.
NAME_CHARS, FEW_TEXTS = 48, 50_000


def shortened(text: Column, distance: int) -> Column:
    """Hashes of all texts that ``distance`` or fewer deletions make of the first ``NAME_CHARS`` characters.

    Two texts within that edit distance share one of them: what an edit changes is deleted on both sides, and of longer texts only the beginnings are held together.
    """
    less = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1)))
    now = F.array(F.substring(text, 1, NAME_CHARS))
    out = now
    for _ in range(distance):
        now = F.array_distinct(F.flatten(F.transform(F.filter(now, lambda s: F.length(s) > 0), less)))
        out = F.concat(out, now)
    return F.array_distinct(F.transform(out, lambda s: F.xxhash64(s)))


def close_names(texts: DataFrame, aliases: DataFrame, text: str, distance: int) -> DataFrame:
    """(text, _e): the alias (_a) with the smallest edit distance to the text (_n), ``distance`` at most, ties by place; an equi-join of deletions.

    One edit is tried first, and only texts without a hit go on to two, so dense names (numbers, say) don't meet all that differ in two places.
    """
    found, todo = None, texts.select(text, "_n")
    for d in range(1, distance + 1):
        lengths = aliases.select(F.explode(F.sequence(F.length("_a") - d, F.length("_a") + d)).alias("_l")).distinct()
        # long texts that no name is as long as aren't taken apart
        fit = todo.withColumn("_l", F.length("_n")).join(lengths, "_l", "left_semi")
        left = fit.select(text, "_n", F.explode(shortened(F.col("_n"), d)).alias("_h"))
        right = aliases.select("place", "lat", "lng", "_a", F.explode(shortened(F.col("_a"), d)).alias("_h"))
        # few texts go to the names, so the names' deletions aren't shuffled; many meet them in a shuffle, and names are never broadcast
        few = left.limit(FEW_TEXTS + 1).count() <= FEW_TEXTS
        near = (right.join(F.broadcast(left), "_h") if few else left.join(right.hint("merge"), "_h")).withColumn("_d", F.levenshtein("_n", "_a", d)).filter("_d >= 0")
        hit = near.groupBy(text).agg(F.min(F.struct("_d", "place", "lat", "lng")).alias("_e")).checkpoint()
        found = hit if found is None else found.unionByName(hit)
        if d < distance:
            todo = todo.join(hit.hint("merge"), text, "left_anti").checkpoint()
    return found


def geocode(cases: DataFrame, places: DataFrame, zones: DataFrame | None = None, *, text: str = "last_seen_location", name: str = "name", zone: str = "zone", distance: int = 2) -> DataFrame:
    """Cases with ``place, lat, lng, method`` and, with ``zones``, the nearest ``zone`` of the place (D4): by exact alias, then name skeleton, then edit distance; null where none fits.

    Only distinct texts are matched. The smallest place name wins a tie, so each text has one place at most. A gazetteer of any size will do.
    """
    aliases = place_aliases(places, name).select(F.col(name).alias("place"), "lat", "lng", normalize_name(F.col("alias")).alias("_n"), name_key(F.col("alias")).alias("_k"))
    texts = cases.select(text).distinct().filter(F.col(text).isNotNull()).withColumns({"_n": normalize_name(F.col(text)), "_k": name_key(F.col(text))})
    first = lambda df, key: df.groupBy(key).agg(F.min(F.struct("place", "lat", "lng")).alias("_" + key))
    exact, skeleton = first(aliases, "_n").hint("merge"), first(aliases, "_k").hint("merge")  # a large gazetteer never goes through the driver, however small its file is
    staged = texts.join(exact, "_n", "left").join(skeleton, "_k", "left").checkpoint()
    named = aliases.filter("_n is not null").groupBy(F.col("_n").alias("_a")).agg(F.min(F.struct("place", "lat", "lng")).alias("_p")).select("_p.*", "_a")
    close = close_names(staged.filter("__n is null and __k is null and _n is not null"), named, text, distance) if distance else staged.select(text, F.col("__n").alias("_e")).limit(0)
    found = staged.join(close.hint("merge"), text, "left")
    pick = lambda f: F.coalesce(F.col(f"__n.{f}"), F.col(f"__k.{f}"), F.col(f"_e.{f}"))
    method = F.when(F.col("__n").isNotNull(), "exact").when(F.col("__k").isNotNull(), "skeleton").when(F.col("_e").isNotNull(), "edit")
    out = found.select(text, pick("place").alias("place"), pick("lat").alias("lat"), pick("lng").alias("lng"), method.alias("method"))
    if zones is not None:
        near = nearest_k(places.groupBy(F.col(name).alias("place")).agg(F.min(F.struct("lat", "lng")).alias("_x")).select("place", "_x.*"), zones, 1, id_="place", place=zone)
        out = out.join(near.select("place", zone).hint("merge"), "place", "left")
    return cases.join(out.hint("merge"), text, "left")


def coordinate_outliers(points: DataFrame, zones: DataFrame, km: float, *, id_: str, zone: str) -> DataFrame:
    """Points farther than ``km`` from every zone."""
    return nearest_k(points, zones, 1, id_=id_, place=zone).filter(F.col("km") > km).select(id_, zone, "km")


def shared_coordinates(points: DataFrame, name: str) -> DataFrame:
    """(lat, lng, n, names) of coordinates that several names share."""
    return points.groupBy("lat", "lng").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(name)).alias("names")).filter("n > 1")


def zone_coverage(zones: DataFrame, cameras: DataFrame, km: float, stations: DataFrame | None = None, *, zone: str, camera: str, camera_zone: str | None = None, station: str = "station") -> DataFrame:
    """(zone, in_zone, in_reach): cameras whose nearest zone it is, and cameras within ``km``; 0 where none.

    With ``camera_zone``, the zone in a camera's id (see ``parse_ids``), ``by_id`` counts by it; with ``stations``, ``stations`` counts those within ``km``.
    """
    own = nearest_k(cameras, zones, 1, id_=camera, place=zone).groupBy(zone).agg(F.count("*").alias("in_zone"))
    reach = within_radius(cameras, zones, km, id_=camera, other=zone).groupBy(zone).agg(F.count("*").alias("in_reach"))
    out = zones.select(zone).join(own, zone, "left").join(reach, zone, "left")
    if camera_zone:
        out = out.join(cameras.groupBy(F.col(camera_zone).cast(dict(zones.dtypes)[zone]).alias(zone)).agg(F.count("*").alias("by_id")), zone, "left")
    if stations is not None:
        out = out.join(within_radius(stations, zones, km, id_=station, other=zone).groupBy(zone).agg(F.count("*").alias("stations")), zone, "left")
    return out.na.fill(0)


def response_coverage(cases: DataFrame, stations: DataFrame, km: float, *, id_: str, station: str) -> DataFrame:
    """Per station: cases nearest to it, mean, median, p90 and largest distance, share within ``km``."""
    near = nearest_k(cases, stations, 1, id_=id_, place=station)
    return near.groupBy(station).agg(F.count("*").alias("cases"), F.avg("km").alias("mean_km"), F.percentile("km", F.lit(0.5)).alias("p50_km"), F.percentile("km", F.lit(0.9)).alias("p90_km"), F.max("km").alias("max_km"), F.avg((F.col("km") <= km).cast("double")).alias("share_within"))


def place_help_points(demand: DataFrame, candidates: DataFrame, km: float, k: int, *, id_: str, candidate: str, top: int = 32) -> DataFrame:
    """(step, candidate, covered): k points chosen one by one, each covering most demand not yet covered; ties by candidate.

    What a candidate covers only shrinks, so counts of earlier steps are upper bounds. A step counts again the ``top`` candidates of the largest bounds; the best of
    them is chosen if no other bound can beat it, else the next ones are counted too. Covered demand and bounds are written every
    few steps, so the lineage doesn't grow with k. Ids that stand at the same positions are covered alike, so they are one row with a weight.
    """
    spark = demand.sparkSession
    kind = dict(candidates.dtypes)[candidate]
    at = demand.filter("lat is not null and lng is not null").groupBy(id_).agg(F.sort_array(F.collect_set(F.struct("lat", "lng"))).alias("_at"))
    units = at.groupBy("_at").agg(F.count("*").alias("_w")).withColumn("_u", F.monotonically_increasing_id()).checkpoint()
    spots = units.select(F.struct("_u", "_w").alias("_unit"), F.explode("_at").alias("_p")).select("_unit", "_p.lat", "_p.lng")
    pairs = within_radius(spots, candidates, km, id_="_unit", other=candidate).select("_unit._u", "_unit._w", candidate).distinct().checkpoint()
    bounds = pairs.groupBy(candidate).agg(F.sum("_w").alias("n")).checkpoint()
    pending: list[tuple] = []
    chosen: list[tuple] = []
    while len(chosen) < k:
        if len(pending) == top:
            pairs, bounds, pending = _uncovered(pairs, pairs, pending, candidate).checkpoint(), bounds.checkpoint(), []
        n, best = top, None
        while True:
            first = [(r[candidate], r["n"]) for r in bounds.orderBy(F.desc("n"), candidate).limit(n + 1).collect()]
            asked = spark.createDataFrame([(c,) for c, _ in first[:n]], f"{candidate} {kind}")
            now = {r[candidate]: r["n"] for r in _uncovered(pairs.join(F.broadcast(asked), candidate), pairs, pending, candidate).groupBy(candidate).agg(F.sum("_w").alias("n")).collect()}
            counted = [(now.get(c, 0), c) for c, _ in first[:n]]
            fresh = spark.createDataFrame([(c, m) for m, c in counted], f"{candidate} {kind}, _m long")
            bounds = bounds.join(F.broadcast(fresh), candidate, "left").select(candidate, F.coalesce("_m", "n").alias("n")).filter("n > 0").checkpoint()
            best = min(counted, key=lambda x: (-x[0], x[1]), default=None)
            rest = first[n] if len(first) > n else None
            # the next bound may only win by more, or by an equal count of a smaller candidate
            if rest is None or best[0] > rest[1] or (best[0] == rest[1] and best[1] < rest[0]):
                break
            n *= 2
        if not best or not best[0]:
            break
        chosen.append((len(chosen) + 1, best[1], best[0]))
        pending.append((best[1],))
    return spark.createDataFrame(chosen, f"step int, {candidate} {kind}, covered long")


def _uncovered(some: DataFrame, pairs: DataFrame, chosen: list[tuple], candidate: str) -> DataFrame:
    """``some`` of the ``pairs``, of demand that no chosen candidate covers."""
    if not chosen:
        return some
    done = pairs.join(F.broadcast(pairs.sparkSession.createDataFrame(chosen, f"{candidate} {dict(pairs.dtypes)[candidate]}")), candidate)
    return some.join(done.select("_u").distinct(), "_u", "left_anti")


def zone_hotspots(cases: DataFrame, points: DataFrame, zones: DataFrame, km: float, k: int, *, zone: str, point: str, risk: str) -> DataFrame:
    """(zone, lat, lng, risk, rank): case share x (1 + risk weight of points in reach), scaled to 0..1, the k largest."""
    load = cases.groupBy(zone).agg(F.count("*").alias("n"))
    reach = within_radius(points.select(point, "lat", "lng"), zones.select(zone, "lat", "lng"), km, id_=point, other=zone).join(points.select(point, risk), point)
    weight = reach.groupBy(zone).agg(F.sum(risk).alias("w"))
    everything = Window.partitionBy(F.lit(1))
    raw = zones.select(zone, "lat", "lng").join(load, zone, "left").join(weight, zone, "left")
    raw = raw.withColumn("_r", F.coalesce("n", F.lit(0)) / F.sum("n").over(everything) * (1 + F.coalesce("w", F.lit(0.0))))
    top = raw.withColumn("risk", F.round(F.col("_r") / F.max("_r").over(everything), 9)).orderBy(F.desc("risk"), zone).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("risk"), zone))).select(zone, "lat", "lng", "risk", "rank")
