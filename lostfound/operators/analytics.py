"""Data quality, counts, windows, top-k and set operations over cases (C, F, J)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lostfound.functions.columns import normalize_name, strip


def completeness(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """(by.., column, n_rows, blanks, blank_share), one pass over the rows (C1). White space of any kind is blank, as for ``blank_to_null``."""
    blank = lambda c: F.col(c).isNull() | (strip(F.col(c).cast("string")) == "")
    counts = df.groupBy(*(by or [])).agg(F.count("*").alias("n_rows"), *[F.sum(blank(c).cast("long")).alias(f"_{i}") for i, c in enumerate(cols)])
    pairs = ", ".join(f"'{c}', _{i}" for i, c in enumerate(cols))
    long = counts.select(*(by or []), "n_rows", F.expr(f"stack({len(cols)}, {pairs}) as (column, blanks)"))
    return long.withColumn("blank_share", F.col("blanks") / F.col("n_rows"))


def domain_check(df: DataFrame, allowed: dict[str, list[str]]) -> DataFrame:
    """(column, value, n, allowed) of every value of the listed columns."""
    stacked = ", ".join(f"'{c}', cast(`{c}` as string)" for c in allowed)
    long = df.select(F.expr(f"stack({len(allowed)}, {stacked}) as (column, value)")).groupBy("column", "value").agg(F.count("*").alias("n"))
    ok = F.lit(False)
    for c, values in allowed.items():
        ok = ok | ((F.col("column") == c) & F.col("value").isin(values))
    return long.withColumn("allowed", F.coalesce(ok, F.lit(False)))


def reconcile(left: DataFrame, right: DataFrame, key: str, value: str, tolerance: float = 1e-6, *, fold: bool = False, attributes: tuple[str, ...] = ()) -> DataFrame:
    """(key, state, attributes..) of two lists of the same things: only_left, only_right, moved or equal, with the right side's ``attributes`` (C4).

    With ``fold``, keys meet by :func:`normalize_name` and the left spelling is returned, or the right one where the left has none.
    """
    fit = (lambda c: normalize_name(F.col(c))) if fold else F.col
    a = left.select(fit(key).alias("_k"), F.col(key).alias("_lk"), F.col(value).alias("_a"), F.lit(1).alias("_l"))
    b = right.select(fit(key).alias("_k"), F.col(key).alias("_rk"), F.col(value).alias("_b"), F.lit(1).alias("_r"), *attributes)
    both = a.join(b, "_k", "full_outer")
    state = F.when(F.col("_r").isNull(), "only_left").when(F.col("_l").isNull(), "only_right").when(F.abs(F.col("_a") - F.col("_b")) > tolerance, "moved").otherwise("equal")
    return both.select(F.coalesce("_lk", "_rk").alias(key), state.alias("state"), *attributes)


def unknown_keys(cases: DataFrame, places: DataFrame, key: str, place_key: str) -> DataFrame:
    """Cases whose place is not among the known ones; a null place is unknown too."""
    return cases.join(places.select(F.col(place_key).alias(key)).distinct(), key, "left_anti")


def duplicate_ids(cases: DataFrame, key: str) -> DataFrame:
    """(key, n) of ids that occur more than once."""
    return cases.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def report_counts(cases: DataFrame, every: str, by: str, at: str = "reported_at") -> DataFrame:
    """(by, slot, cases) for every ``every`` between a group's first and last report, 0 where there was none (F1)."""
    counts = cases.groupBy(by, F.date_trunc(every, F.col(at)).alias("slot")).agg(F.count("*").alias("cases"))
    spans = counts.groupBy(by).agg(F.min("slot").alias("lo"), F.max("slot").alias("hi"))
    slots = spans.select(by, F.explode(F.sequence("lo", "hi", F.expr(f"interval 1 {every}"))).alias("slot"))
    return slots.join(counts, [by, "slot"], "left").withColumn("cases", F.coalesce("cases", F.lit(0)))


def spike_days(daily: DataFrame, factor: float, day: str = "day", n: str = "cases") -> DataFrame:
    """Days with at least ``factor`` x the median count, and their ratio to the mean of the seven days before (F2). ``daily`` has a row a day."""
    median = daily.agg(F.percentile(n, F.lit(0.5)).alias("median"))
    before = Window.orderBy(day).rowsBetween(-7, -1)
    return daily.withColumn("trailing", F.avg(n).over(before)).crossJoin(F.broadcast(median)).filter(F.col(n) >= factor * F.col("median")).select(day, n, "median", (F.col(n) / F.col("trailing")).alias("ratio"))


def distribution(cases: DataFrame, col: str, by: str) -> DataFrame:
    """(by, col, n, share, rank), largest first."""
    counts = cases.groupBy(by, col).agg(F.count("*").alias("n"))
    w = Window.partitionBy(by)
    return counts.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn("rank", F.rank().over(w.orderBy(F.desc("n"))))


def resolution_summary(cases: DataFrame, by: str, *, status: str, hours: str, resolved: tuple[str, ...] = ("Reunited",)) -> DataFrame:
    """Per group: cases, resolved share, mean, median and p90 hours of the resolved."""
    done = F.col(status).isin(*resolved)
    h = F.when(done, F.col(hours))
    return cases.groupBy(by).agg(F.count("*").alias("cases"), F.avg(done.cast("double")).alias("resolved_share"), F.avg(h).alias("mean_hours"), F.percentile(h, F.lit(0.5)).alias("p50_hours"), F.percentile(h, F.lit(0.9)).alias("p90_hours"))


#: Exponent of the sketches: KLL keeps some 2^k values (rank error about 1.7 / 2^k), HLL has 2^k registers (error about 1.04 / sqrt(2^k)).
SKETCH_K, REGISTERS_K = 200, 12


def daily_sketches(cases: DataFrame, by: str, *, at: str, status: str, hours: str, person: str, resolved: tuple[str, ...] = ("Reunited",)) -> DataFrame:
    """(by, day, cases, known (with a status), resolved, total_hours, hours_sketch, persons_sketch): what a day adds to :func:`resolution_summary` and :func:`distinct_persons`, to be stored and merged.

    Sketches have a bounded size whatever the day holds.
    """
    done = F.col(status).isin(*resolved)
    h = F.when(done, F.col(hours)).cast("double")
    per = [F.count("*").alias("cases"), F.count(status).alias("known"), F.sum(F.coalesce(done, F.lit(False)).cast("long")).alias("resolved"), F.sum(h).alias("total_hours"), F.kll_sketch_agg_double(h, SKETCH_K).alias("hours_sketch"), F.hll_sketch_agg(person, REGISTERS_K).alias("persons_sketch")]
    return cases.groupBy(by, F.to_date(at).alias("day")).agg(*per)


def summary_of_days(sketches: DataFrame, by: str) -> DataFrame:
    """(by, cases, resolved_share, mean_hours, p50_hours, p90_hours, persons) of any days of :func:`daily_sketches`, from their rows alone (F4, F13). Hours are null where no case is resolved."""
    out = sketches.groupBy(by).agg(F.sum("cases").alias("cases"), F.sum("known").alias("_known"), F.sum("resolved").alias("_done"), F.sum("total_hours").alias("_hours"), F.kll_merge_agg_double("hours_sketch").alias("_h"), F.hll_union_agg("persons_sketch").alias("_p"))
    at = lambda q: F.when(F.kll_sketch_get_n_double("_h") > 0, F.kll_sketch_get_quantile_double("_h", F.lit(q)))
    return out.select(by, "cases", F.try_divide(F.col("_done"), F.col("_known")).alias("resolved_share"), F.try_divide(F.col("_hours"), F.col("_done")).alias("mean_hours"), at(0.5).alias("p50_hours"), at(0.9).alias("p90_hours"), F.hll_sketch_estimate("_p").alias("persons"))


def center_overlap(pairs: DataFrame, a: str = "center_a", b: str = "center_b") -> DataFrame:
    """(center, other, shared): persons that two centers share, both directions."""
    both = pairs.select(F.col(a).alias("center"), F.col(b).alias("other")).unionAll(pairs.select(F.col(b).alias("center"), F.col(a).alias("other")))
    return both.groupBy("center", "other").agg(F.count("*").alias("shared"))


def center_matrix(pairs: DataFrame, centers: list[str], a: str = "center_a", b: str = "center_b") -> DataFrame:
    """A row per center and a column for each of ``centers``: persons that the two share, 0 where none."""
    wide = center_overlap(pairs, a, b).groupBy("center").pivot("other", centers).agg(F.sum("shared"))
    return wide.na.fill(0, centers)


def origin_rollup(cases: DataFrame, levels: list[str]) -> DataFrame:
    """Counts at every level of a hierarchy with its subtotals and ``level`` (grouping id)."""
    return cases.rollup(*levels).agg(F.count("*").alias("cases"), F.grouping_id().cast("long").alias("level"))


def cube_counts(cases: DataFrame, dims: list[str]) -> DataFrame:
    """Counts of all combinations of the dimensions."""
    return cases.cube(*dims).agg(F.count("*").alias("cases"), F.grouping_id().cast("long").alias("level"))


def grouping_counts(cases: DataFrame, dims: list[str], sets: list[list[str]]) -> DataFrame:
    """Counts of the given grouping sets only, with ``level`` (grouping id)."""
    return cases.groupingSets([[F.col(c) for c in x] for x in sets], *dims).agg(F.count("*").alias("cases"), F.grouping_id().cast("long").alias("level"))


def resource_needs(load: DataFrame, rates: DataFrame, n: str = "cases") -> DataFrame:
    """Units per slot and resource: ceil(load / rate), with each zone's peak (F8). ``rates`` is a small (resource, cases_per_unit) table."""
    if rates.limit(1_001).count() > 1_000:
        raise ValueError("more than 1,000 rates")
    units = load.crossJoin(F.broadcast(rates)).withColumn("units", F.ceil(F.col(n) / F.col("cases_per_unit")).cast("long"))
    return units.groupBy("zone", "resource").agg(F.sum("units").alias("units"), F.max("units").alias("peak_units"), F.min_by("slot", F.struct(-F.col("units"), F.col("slot"))).alias("peak_slot"))


def project_load(profile: DataFrame, pilgrims: int, rate: float, hours: int) -> DataFrame:
    """(zone, hour, expected) for ``hours`` ahead: pilgrims x rate x the zone's share of its hour of day (F9). ``profile`` has (zone, hour_of_day, cases)."""
    total = profile.agg(F.sum("cases").alias("_all"))
    ahead = F.explode(F.sequence(F.lit(0), F.lit(hours - 1))).alias("hour")
    zones = profile.select("zone").distinct().select("zone", ahead).withColumn("hour_of_day", F.col("hour") % 24)
    joined = zones.join(profile, ["zone", "hour_of_day"], "left").crossJoin(F.broadcast(total))
    return joined.select("zone", "hour", (F.coalesce("cases", F.lit(0)) * float(pilgrims) * rate / F.col("_all")).alias("expected"))


def bootstrap_hotspots(cases: DataFrame, zone: str, reps: int, k: int, seed: int = 1, key: str | None = None) -> DataFrame:
    """(zone, p05, p50, p95, in_top): case counts over ``reps`` resamples of the cases, and the share of resamples in which the zone is among the ``k`` largest, ties by zone.

    A resample gives each case a weight that is Poisson of mean 1, drawn from a hash of (seed, key, replicate). A case is read once and meets all replicates in its own task,
    which passes on a row for each zone and replicate. Without ``key`` cases are numbered as they are read, so another split of the rows draws other weights.
    """
    own = cases.select(F.col(zone), (F.monotonically_increasing_id() if key is None else F.col(key)).alias("_key"))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("_key"), F.col("rep"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    drawn = own.select(zone, "_key", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep")).select(zone, "rep", u.alias("_u"))
    total, term, weight = 0.0, 0.36787944117144233, F.lit(0).cast("long")
    for n in range(1, 9):
        total += term
        weight = weight + (F.col("_u") >= F.lit(total)).cast("long")
        term /= n
    drawn = drawn.groupBy(zone, "rep").agg(F.sum(weight).alias("n"))
    place = F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("n"), zone))
    ranked = drawn.withColumn("_top", (place <= k).cast("double"))
    return ranked.groupBy(zone).agg(*[F.percentile("n", F.lit(p)).alias(f"p{round(100 * p):02d}") for p in (0.05, 0.5, 0.95)], F.avg("_top").alias("in_top"))


def open_backlog(cases: DataFrame, by: str, opened: Column, closed: Column) -> DataFrame:
    """(by, at, open, peak): open cases after each change, and the most so far (F11). Changes at one time are netted first.

    Two levels: sums and peaks inside each day of a group, then a scan over its days, so a task holds a day of a group, or a row for each of its days.
    """
    changes = cases.select(by, opened.alias("at"), F.lit(1).alias("d")).unionAll(cases.filter(closed.isNotNull()).select(by, closed.alias("at"), F.lit(-1).alias("d")))
    net = changes.groupBy(by, "at").agg(F.sum("d").alias("d")).withColumn("_day", F.date_trunc("day", "at"))
    inside = Window.partitionBy(by, "_day").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = net.withColumn("_open", F.sum("d").over(inside)).withColumn("_peak", F.max("_open").over(inside))
    earlier = Window.partitionBy(by).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = own.groupBy(by, "_day").agg(F.sum("d").alias("_sum"), F.max("_open").alias("_top")).withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    days = days.select(F.col(by).alias("_g"), F.col("_day").alias("_on"), "_before", F.max(F.col("_before") + F.col("_top")).over(earlier).alias("_most"))
    out = own.join(days, F.col(by).eqNullSafe(F.col("_g")) & F.col("_day").eqNullSafe(F.col("_on")))
    return out.select(by, "at", (F.col("_before") + F.col("_open")).alias("open"), F.greatest(F.col("_before") + F.col("_peak"), "_most").alias("peak"))


def top_locations(cases: DataFrame, place: str, by: str, k: int) -> DataFrame:
    """The k most frequent places of each group, ties by place."""
    counts = cases.groupBy(by, place).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), place))).filter(F.col("rank") <= k)


def distinct_persons(cases: DataFrame, person: str, by: str, clusters: DataFrame | None = None) -> DataFrame:
    """Reports, persons, approximate persons and reports per person of each group (F13). With ``clusters`` (id, cluster), ``person`` is an id and members of a cluster are one person."""
    if clusters is not None:
        cases = cases.join(clusters.select(F.col("id").alias(person), "cluster"), person, "left").withColumn(person, F.coalesce("cluster", person))
    out = cases.groupBy(by).agg(F.count("*").alias("reports"), F.countDistinct(person).alias("persons"), F.approx_count_distinct(person).alias("approx_persons"))
    return out.withColumn("per_person", F.col("reports") / F.col("persons"))


def language_need(cases: DataFrame, by: str, lang: str, languages: list[str]) -> DataFrame:
    """Cases by language as columns, and each group's share of all."""
    wide = cases.groupBy(by).pivot(lang, languages).agg(F.count(F.lit(1))).na.fill(0, languages)
    total = sum((F.col(x) for x in languages), F.lit(0))
    return wide.withColumn("share", total / F.sum(total).over(Window.partitionBy(F.lit(1))))


def registry_gap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of A whose key B does not have."""
    return a.join(b.select(key).distinct(), key, "left_anti")


def changed_versions(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of snapshot A that B does not have as they are, counted one by one."""
    return a.exceptAll(b)


def registry_shared(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows known at both."""
    return a.intersect(b)
