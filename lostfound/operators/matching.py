"""Search, matching and duplicates (E), and the merge of registries."""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lostfound.functions.columns import ages_overlap

#: Vectors that a block of queries and a block of the gallery hold on average.
QUERY_BLOCK, GALLERY_BLOCK = 4_096, 32_768


def unify_registry(*centers: DataFrame) -> DataFrame:
    """One registry of all centers' records (B2)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), centers)


def merge_reports(registry: DataFrame, batch: DataFrame, key: str = "case_id", version: str = "updated_at") -> DataFrame:
    """Registry and late batch in one; of a case the newest version wins, the batch on a tie."""
    both = registry.withColumn("_b", F.lit(0)).unionByName(batch.withColumn("_b", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.desc(version), F.desc("_b"))
    return both.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_b")


#: Rows of a block that meet in one task.
BLOCK_ROWS = 1_000


def block_keys(keys: list[Column]) -> Column:
    """The block keys of a row as texts, told apart by their number; null ones are left out."""
    return F.array_compact(F.array(*[F.when(k.isNotNull(), F.concat(F.lit(f"{i}:"), k.cast("string"))) for i, k in enumerate(keys)]))


def dealt(long: DataFrame, keys: list[str], id_: str, rows: int = BLOCK_ROWS, lone: bool = True, told: bool = False) -> DataFrame:
    """``long`` with ``_m``, the parts of its block, and ``_s``, its own part: one for each ``rows`` rows of the block, by a hash of the id. Without ``lone``, rows alone in their block are left out.

    With ``told``, blocks of more than ``rows`` rows, one for each ``rows`` rows at most, go to all tasks, and ``long`` is not shuffled to learn of them.
    """
    sizes = long.groupBy(*keys).agg(F.count("*").alias("_n"))
    hot = sizes.filter(F.col("_n") > (rows if lone else 1)).select(*keys, F.ceil(F.col("_n") / rows).cast("int").alias("_m"))
    m = F.coalesce(F.col("_m"), F.lit(1))
    return long.join(F.broadcast(hot) if told else hot, keys, "left" if lone else "inner").withColumn("_m", m).withColumn("_s", F.pmod(F.xxhash64(id_), F.col("_m")).cast("int"))


def met_in_blocks(long: DataFrame, keys: list[str], rows: int = BLOCK_ROWS, lone: bool = True, told: bool = False) -> tuple[DataFrame, Column]:
    """(rows of blocks, the condition under which an aliased x and y of them meet, x._id < y._id): each pair of a block once.

    A block of more than ``rows`` rows is dealt to parts, and each pair of parts is a block of its own, so a hot key is many tasks. ``lone`` and ``told`` are those of :func:`dealt`.
    """
    own = dealt(long, keys, "_id", rows, lone, told).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    own = own.withColumn("_lo", F.least("_s", "_o")).withColumn("_hi", F.greatest("_s", "_o")).drop("_m", "_o")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in (*keys, "_lo", "_hi")]
    once = (F.col("x._s") != F.col("y._s")) | (F.col("x._lo") == F.col("x._hi"))
    return own, reduce(lambda p, q: p & q, [*same, F.col("x._id") < F.col("y._id"), once])


def candidate_pairs(cases: DataFrame, keys: list[Column], *, id_: str, center: str, max_block: int | None = None, rows: int = BLOCK_ROWS, fields: DataFrame | None = None) -> DataFrame:
    """(a, b), a < b, of cases at different centers that share a block key (E2). Null keys block nothing.

    Hot keys are dealt to parts of ``rows`` cases. ``max_block`` drops keys with more cases than that (report them with :func:`block_sizes`); by default none is dropped. With ``fields``, the id and
    other columns, these come along as a_ and b_ columns; with one key they go to its blocks with the cases, so no pair is ever shuffled for them.
    """
    side = lambda end, id_as: fields.select(F.col(id_).alias(id_as), *[F.col(c).alias(f"{end}{c}") for c in fields.columns if c != id_])
    long = cases.select(F.col(id_).alias("_id"), F.col(center).alias("_c"), F.explode(block_keys(keys)).alias("_k"))
    if max_block:
        long = long.join(long.groupBy("_k").count().filter(F.col("count") <= max_block).select("_k"), "_k", "left_semi")
    # a row for each case and key, with all centers of the case, so that a pair comes once for a key
    long = long.groupBy("_id", "_k").agg(F.collect_set("_c").alias("_cs"))
    carried = fields is not None and len(keys) == 1
    if carried:
        long = long.join(side("_f_", "_id"), "_id")
    own, meet = met_in_blocks(long, ["_k"], rows)
    apart = (F.size("x._cs") > 0) & (F.size("y._cs") > 0) & ((F.size("x._cs") > 1) | (F.size("y._cs") > 1) | (F.col("x._cs")[0] != F.col("y._cs")[0]))
    along = [F.col(f"{x}._f_{c}").alias(f"{end}_{c}") for x, end in (("x", "a"), ("y", "b")) for c in fields.columns if c != id_] if carried else []
    met = own.alias("x").join(own.alias("y").hint("merge"), meet & apart).select(F.col("x._id").alias("a"), F.col("y._id").alias("b"), *along)
    if len(keys) == 1:
        return met
    return met.distinct() if fields is None else met.distinct().join(side("a_", "a"), "a").join(side("b_", "b"), "b")


def block_sizes(cases: DataFrame, keys: list[Column], least: int) -> DataFrame:
    """(key, n) of block keys with more than ``least`` cases."""
    return cases.select(F.explode(block_keys(keys)).alias("key")).groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > least)


def score_pairs(pairs: DataFrame, fields: list[tuple[str, str, float]], least: int = 2) -> DataFrame:
    """``pairs`` with ``score`` and ``compared`` (E3): weighted agreement over the fields that both sides have.

    ``fields`` are (name, kind, weight) over columns a_name and b_name; kinds are equal, text (edit distance), ages (bounds), tokens
    (Jaccard) and hours (timestamps, 0 at 48 h). A missing field drops out and the weights are rescaled; a pair with fewer
    than ``least`` compared fields scores 0.
    """
    total, weight, compared = F.lit(0.0), F.lit(0.0), F.lit(0)
    for name, kind, w in fields:
        a, b = F.col(f"a_{name}"), F.col(f"b_{name}")
        if kind == "equal":
            s = (a == b).cast("double")
        elif kind == "text":
            s = 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))
        elif kind == "ages":
            s = ages_overlap(a, b).cast("double")
        elif kind == "tokens":
            s = F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))
        else:
            s = 1 - F.abs(F.unix_seconds(a.cast("timestamp")) - F.unix_seconds(b.cast("timestamp"))) / F.lit(48 * 3600.0)
            s = F.when(s.isNotNull(), F.greatest(F.lit(0.0), s))  # greatest alone would take a missing time for 48 hours
        both = s.isNotNull()
        total, weight, compared = total + F.coalesce(s, F.lit(0.0)) * w, weight + F.when(both, w).otherwise(0.0), compared + both.cast("int")
    score = F.when(compared >= least, F.round(total / weight, 9)).otherwise(0.0)
    return pairs.withColumn("score", score).withColumn("compared", compared)


#: Combinations of fields up to which each two of them are scored once.
KINDS = 300


def scored_candidates(cases: DataFrame, keys: list[Column], own: DataFrame, fields: list[tuple[str, str, float]], *, id_: str, center: str, least: int = 2) -> DataFrame:
    """(a, b, score, compared): :func:`candidate_pairs` with their :func:`score_pairs` over the fields of ``own`` (the id and the fields). Pairs grow with the square of a block, so they are scored where they meet.

    Where the cases have no more than ``KINDS`` different combinations of fields, those are scored and a pair looks its score up.
    """
    names = [n for n, _, _ in fields]
    kinds = stored(own.select(*names).distinct().limit(KINDS + 1).withColumn("_kind", F.monotonically_increasing_id()))
    if kinds.count() > KINDS:
        forget(kinds)
        pairs = candidate_pairs(cases, keys, id_=id_, center=center, fields=own.select(id_, *names))
        return score_pairs(pairs, fields, least).select("a", "b", "score", "compared")
    side = lambda end: kinds.select(F.col("_kind").alias(f"{end}__kind"), *[F.col(n).alias(f"{end}_{n}") for n in names])
    scores = score_pairs(side("a").crossJoin(F.broadcast(side("b"))), fields, least).select("a__kind", "b__kind", "score", "compared")
    told = own.alias("o").join(F.broadcast(kinds.alias("k")), reduce(lambda p, q: p & q, [F.col(f"o.{n}").eqNullSafe(F.col(f"k.{n}")) for n in names])).select(F.col(f"o.{id_}"), "k._kind")
    pairs = candidate_pairs(cases, keys, id_=id_, center=center, fields=told)
    return pairs.join(F.broadcast(scores), ["a__kind", "b__kind"]).select("a", "b", "score", "compared")


def match_found(missing: DataFrame, found: DataFrame, *, block: list[str], hours: float, k: int, id_: str = "case_id", at: str = "reported_at", agree: Callable[[str, str], Column] | None = None, compare: tuple[str, ...] = ()) -> DataFrame:
    """(missing_id, found_id, gap_hours, rank): found cases of the same block within ``hours`` of the missing report, nearest in time first, ties by found_id.

    Without ``agree`` no block is multiplied out: reports of a block are numbered in order of time, and a missing case meets the k found ones
    before it and the k after it. ``agree(a, b)``, a condition over the columns ``compare`` prefixed a_ (missing) and b_ (found), as
    :func:`agreeing` makes one of genders and ages, is tested on all pairs of a span of time that grows up to ``hours`` for the missing cases that still lack k. A null block or time matches nothing.
    """
    seconds = F.unix_seconds(F.col(at).cast("timestamp"))
    m = missing.select(F.col(id_).alias("missing_id"), seconds.alias("_tm"), *block, *[F.col(c).alias(f"a_{c}") for c in compare]).dropna(subset=["_tm", *block])
    f = found.select(F.col(id_).alias("found_id"), seconds.alias("_tf"), *block, *[F.col(c).alias(f"b_{c}") for c in compare]).dropna(subset=["_tf", *block])
    if agree is None:
        near = _next_in_time(m, f, block, k)
        near = near.withColumn("gap_hours", F.abs(F.col("_tm") - F.col("_tf")) / F.lit(3600.0)).filter(F.col("gap_hours") <= hours)
        return near.withColumn("rank", _by_gap()).filter(F.col("rank") <= k).select("missing_id", "found_id", "gap_hours", "rank")
    return _agreeing_in_time(m, f, block, hours, k, agree)


def _by_gap() -> Column:
    return F.row_number().over(Window.partitionBy("missing_id").orderBy("gap_hours", "found_id"))


#: Found cases of a block and a slot with which the search in time begins, in multiples of k.
SLOT_CASES = 4


def _agreeing_in_time(m: DataFrame, f: DataFrame, block: list[str], hours: float, k: int, agree: Callable[[str, str], Column]) -> DataFrame:
    """:func:`match_found` with a condition, in growing spans of time: a missing case that has k found ones within a span is done, as all others are farther, and the
    rest go on to a span four times as wide, up to ``hours``. The first span is the widest whose slots hold some ``SLOT_CASES`` x k found cases of a block."""
    m = m.checkpoint()
    f = f.checkpoint()
    spans = [hours / 4**i for i in range(8) if i == 0 or hours * 3600 / 4**i >= 1]
    slots = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.floor(F.col("_tf") / (int(h * 3600) + 1)).alias("s")) for i, h in enumerate(spans)])).alias("_v")
    held = f.select(*block, slots).groupBy(*block, "_v").agg(F.count("*").alias("_n"))
    crowds = {r["i"]: r["mean"] for r in held.groupBy("_v.i").agg((F.sum(F.col("_n") * F.col("_n")) / F.sum("_n")).alias("mean")).collect()}
    first = next((i for i in range(len(spans)) if crowds.get(i, 0) <= SLOT_CASES * k), len(spans) - 1)
    todo, done = m, []
    for i in range(first, -1, -1):
        width = int(spans[i] * 3600) + 1
        slot = lambda c: F.floor(F.col(c) / width)  # noqa: B023, E731
        dealt = f.withColumn("_s", F.explode(F.array(slot("_tf") - 1, slot("_tf"), slot("_tf") + 1)))
        gap = F.abs(F.col("_tm") - F.col("_tf")) / F.lit(3600.0)
        near = todo.withColumn("_s", slot("_tm")).join(dealt.hint("merge"), [*block, "_s"]).filter((gap <= spans[i]) & agree("a_", "b_")).select("missing_id", "found_id", gap.alias("gap_hours"))
        near = near.withColumn("rank", _by_gap()).filter(F.col("rank") <= k).checkpoint()
        if not i:
            done.append(near)
            break
        whole = near.filter(F.col("rank") == k).select("missing_id")
        done.append(near.join(whole.hint("merge"), "missing_id", "left_semi"))
        todo = todo.join(whole.hint("merge"), "missing_id", "left_anti").checkpoint()
    return reduce(DataFrame.unionByName, done).select("missing_id", "found_id", "gap_hours", "rank")


def _next_in_time(m: DataFrame, f: DataFrame, block: list[str], k: int) -> DataFrame:
    """Pairs of each missing case with the k found ones of its block up to its time and the k after it.

    Found cases are numbered by day first and then by the counts of the days before, so a task holds a day of a block.
    """
    day = lambda c: F.floor(F.col(c) / 86_400)
    kind = dict(m.dtypes)["missing_id"]
    both = f.select(*block, F.col("_tf").alias("_t"), F.lit(None).cast(kind).alias("missing_id"), F.lit(1).alias("_is")).unionByName(m.select(*block, F.col("_tm").alias("_t"), "missing_id", F.lit(0).alias("_is"))).withColumn("_d", day("_t"))
    earlier = Window.partitionBy(*block).orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    days = both.groupBy(*block, "_d").agg(F.sum("_is").alias("_c")).select(*block, "_d", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"))
    w = Window.partitionBy(*block, "_d")
    # of equal times the smallest id is nearest: it comes last before and first after
    place = lambda *by: F.col("_before") + F.row_number().over(w.orderBy(*by))
    numbered = f.withColumn("_d", day("_tf")).join(days, [*block, "_d"]).withColumn("_up", place("_tf", F.desc("found_id"))).withColumn("_down", place("_tf", "found_id"))
    # number of found cases up to the time, those of the same second included
    own = F.sum("_is").over(w.orderBy("_t").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    passed = both.withColumn("_own", own).filter("_is = 0").join(days, [*block, "_d"]).select(*block, "missing_id", F.col("_t").alias("_tm"), (F.col("_before") + F.col("_own")).alias("_n"))
    before = passed.withColumn("_up", F.explode(F.sequence(F.col("_n") - (k - 1), F.col("_n")))).filter("_up > 0")
    after = passed.withColumn("_down", F.explode(F.sequence(F.col("_n") + 1, F.col("_n") + k)))
    take = lambda x, c: x.join(numbered.select(*block, c, "found_id", "_tf"), [*block, c]).select("missing_id", "found_id", "_tm", "_tf")
    return take(before, "_up").unionByName(take(after, "_down"))


def agreeing(gender: str | None = "gender", age: str | None = "age") -> Callable[[str, str], Column]:
    """The condition of :func:`match_found` that genders are equal and age intervals overlap; Unknown or null contradicts nothing."""

    def agree(a: str, b: str) -> Column:
        ok = F.lit(True)
        if gender:
            x, y = F.col(a + gender), F.col(b + gender)
            ok = ok & ((x == y) | x.isNull() | y.isNull() | (x == "Unknown") | (y == "Unknown"))
        if age:
            ok = ok & F.coalesce(ages_overlap(F.col(a + age), F.col(b + age)), F.lit(True))
        return ok

    return agree


def store_blocks(cases: DataFrame, table: str, path: str, keys: list[Column], fields: list[str], *, id_: str = "case_id", rows: int = BLOCK_ROWS, buckets: int = 64) -> DataFrame:
    """The registry as a table of block keys for :func:`search_registry`, written under ``path`` in buckets by key (E1): a row for each case and key, with the fields to compare.

    Keys of more than ``rows`` cases are dealt to parts, which are in buckets of their own.
    """
    own = cases.select(F.col(id_).alias("_c"), *[F.col(n).alias(f"b_{n}") for n in fields], block_keys(keys).alias("_ks"))
    long = dealt(own.withColumn("_k", F.explode("_ks")), ["_k"], "_c", rows)
    long.write.mode("overwrite").bucketBy(buckets, "_k", "_s").sortBy("_k", "_s").option("path", path).saveAsTable(table)
    return cases.sparkSession.table(table)


def search_registry(queries: DataFrame, blocks: DataFrame, *, keys: list[Column], fields: list[tuple[str, str, float]], k: int, id_: str = "case_id", query_id: str = "query_id") -> DataFrame:
    """(query_id, case_id, score, rank): family queries against all centers' cases that share a key with them.

    ``blocks`` is the table of :func:`store_blocks`, made with keys of the same meaning and the same fields. A null key of a query finds nothing, the others still do; a query
    and a case that share several keys are compared once, at the first. Only queries are shuffled, and a query of a hot key goes to each of its parts.

    With equal fields and one in hours no block is multiplied out: a query meets those cases of a key only that can be among its k best (``_timely``), at most 4k - 1 for each
    combination of equal fields that can reach them. Ids of cases are unique there, and the registry is shuffled.
    """
    names = [n for n, _, _ in fields]
    if _by_time(fields):
        q = queries.select(F.col(query_id).alias("_q"), *[F.col(n).alias(f"a_{n}") for n in names], F.explode(block_keys(keys)).alias("_k"))
        scored = score_pairs(_timely(q, blocks, fields, k), fields).filter("score > 0")
        # a case that comes by several keys has one rank
        rank = F.dense_rank().over(Window.partitionBy("_q").orderBy(F.desc("score"), "_c"))
        best = scored.select("_q", "_c", "score").withColumn("rank", rank).filter(F.col("rank") <= k).distinct()
        return best.select(F.col("_q").alias(query_id), F.col("_c").alias(id_), "score", "rank")
    q = queries.select(F.col(query_id).alias("_q"), *[F.col(n).alias(f"a_{n}") for n in names], block_keys(keys).alias("_mine")).withColumn("_k", F.explode("_mine"))
    parts = blocks.filter("_m > 1").select("_k", "_m").distinct()
    asked = q.join(parts, "_k", "left").withColumn("_s", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_m"), F.lit(1)) - 1))).drop("_m")
    first = F.element_at(F.array_intersect("_mine", "_ks"), 1) == F.col("_k")
    scored = score_pairs(asked.join(blocks.drop("_m"), ["_k", "_s"]).filter(first), fields).filter("score > 0")
    rank = F.row_number().over(Window.partitionBy("_q").orderBy(F.desc("score"), "_c"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("_q").alias(query_id), F.col("_c").alias(id_), "score", "rank")


def _by_time(fields: list[tuple[str, str, float]]) -> bool:
    """Whether scores are made of equal fields and one in hours that weighs enough for each second to show in nine digits."""
    hours = [w for _, kind, w in fields if kind == "hours"]
    return len(hours) == 1 and all(kind in ("equal", "hours") and w > 0 for _, kind, w in fields) and hours[0] > 1e-3 * sum(w for *_, w in fields)


def _timely(q: DataFrame, blocks: DataFrame, fields: list[tuple[str, str, float]], k: int) -> DataFrame:
    """(_q, _c, a_ and b_ fields): for each query and key all cases that can be among the k best of the key, some pairs several times.

    Cases of a key with the same equal fields are a class. What a class can score at least and most is known for each kind of query; classes that stay under k cases
    of better ones are left out. In a class the score falls with the gap in time, so the k cases before and after the query are the best; those without a score for time
    (48 hours or more, or no time) are all alike, and of these the smallest ids count: fewer than k of the first 2k - 1 ids are nearer in time if they are needed at all.
    """
    equal = [(n, w) for n, kind, w in fields if kind == "equal"]
    at, weight_of_time = next((n, w) for n, kind, w in fields if kind == "hours")
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    kind = lambda mark: F.struct(*[F.col(f"{mark}_{n}").alias(f"v{i}") for i, (n, _) in enumerate(equal)], seconds(f"{mark}_{at}").isNotNull().alias("timed"))
    # kinds and classes meet as texts, so that a null is a value like others
    told = lambda mark: F.array(*[F.coalesce(F.concat(F.lit("="), F.col(f"{mark}_{n}").cast("string")), F.lit("")) for n, _ in equal], seconds(f"{mark}_{at}").isNotNull().cast("string"))
    m = q.select("_k", told("a").alias("_ga"), kind("a").alias("_a"), "_q", F.col(f"a_{at}").alias("_at"), seconds(f"a_{at}").alias("_tm"))
    f = blocks.select("_k", told("b").alias("_g"), kind("b").alias("_e"), F.struct("_c", F.col(f"b_{at}").alias("at")).alias("found_id"), seconds(f"b_{at}").alias("_tf"))

    met = m.groupBy("_k", "_ga").agg(F.first("_a").alias("_a")).join(f.groupBy("_k", "_g").agg(F.count("*").alias("_n"), F.first("_e").alias("_e")), "_k")
    timed = F.col("_a.timed") & F.col("_e.timed")
    total, weight, compared = F.lit(0.0), F.when(timed, weight_of_time).otherwise(0.0), timed.cast("int")
    for i, (_, w) in enumerate(equal):
        same = F.col(f"_a.v{i}") == F.col(f"_e.v{i}")
        total, weight, compared = total + F.when(same, w).otherwise(0.0), weight + F.when(same.isNotNull(), w).otherwise(0.0), compared + same.isNotNull().cast("int")
    reach = lambda top: F.when(compared >= 2, (total + top) / weight).otherwise(0.0)
    bounds = met.select("_k", "_ga", "_g", "_e", "_n", reach(F.lit(0.0)).alias("_low"), reach(F.when(timed, weight_of_time).otherwise(0.0)).alias("_high"), timed.alias("_timed"))
    own = Window.partitionBy("_k", "_ga")
    bounds = bounds.withColumn("_sure", F.sum("_n").over(own.orderBy(F.desc("_low")).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    bounds = bounds.withColumn("_floor", F.max(F.when(F.col("_sure") >= k, F.col("_low"))).over(own))
    wanted = bounds.filter((F.col("_high") > 0) & F.coalesce(F.col("_high") >= F.col("_floor") - 1e-8, F.lit(True))).select("_k", "_ga", "_g", "_e", "_timed")

    asked = m.join(wanted, ["_k", "_ga"]).select("_k", "_g", "_timed", "_tm", F.struct("_q", F.col("_at").alias("at"), F.col("_a").alias("a"), F.col("_e").alias("e")).alias("missing_id"))
    near = _next_in_time(asked.filter("_timed").select("_k", "_g", "_tm", "missing_id"), f.filter("_e.timed").select("_k", "_g", "found_id", "_tf"), ["_k", "_g"], k).select("missing_id", "found_id")
    first = f.withColumn("_r", F.row_number().over(Window.partitionBy("_k", "_g").orderBy("found_id"))).filter(F.col("_r") < 2 * k).select("_k", "_g", "found_id")
    pairs = near.unionByName(asked.join(first, ["_k", "_g"]).select("missing_id", "found_id"))
    both = [F.col(f"missing_id.{x}.v{i}").alias(f"{mark}_{n}") for i, (n, _) in enumerate(equal) for x, mark in (("a", "a"), ("e", "b"))]
    return pairs.select(F.col("missing_id._q").alias("_q"), F.col("found_id._c").alias("_c"), F.col("missing_id.at").alias(f"a_{at}"), F.col("found_id.at").alias(f"b_{at}"), *both)


def one_to_one(matches: DataFrame, a: str = "missing_id", b: str = "found_id", score: str = "gap_hours", largest: bool = False) -> DataFrame:
    """Pairs that are each other's best (E5)."""
    by = F.desc(score) if largest else F.asc(score)
    best = lambda x, y: F.row_number().over(Window.partitionBy(x).orderBy(by, y))
    return matches.withColumn("_a", best(a, b)).withColumn("_b", best(b, a)).filter("_a = 1 and _b = 1").drop("_a", "_b")


def duplicate_clusters(pairs: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, cluster): the smallest id that each case of a pair reaches (E6). Labels spread along the pairs, one checkpoint a round, until none changes."""
    edges = pairs.select("a", "b").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("cluster")).select(F.col("a").alias("id"), "cluster")
    for _ in range(rounds):
        near = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("cluster").alias("_m"))
        hop = labels.select(F.col("id").alias("cluster"), F.col("cluster").alias("_h"))
        new = labels.join(near, "id").join(hop, "cluster", "left").select("id", F.least("cluster", "_m", F.coalesce("_h", "cluster")).alias("_new"), "cluster").checkpoint()
        changed = new.filter("_new <> cluster").limit(1).count()
        labels = new.select("id", F.col("_new").alias("cluster"))
        if not changed:
            return labels
    raise RuntimeError(f"the clusters did not settle in {rounds} rounds")


def merge_clusters(cases: DataFrame, clusters: DataFrame, *, id_: str, at: str, center: str, first: list[str]) -> DataFrame:
    """One person per cluster (E7): first non-null value of each field by report time, the centers and case ids; a case in no cluster is its own."""
    own = cases.join(clusters.select(F.col("id").alias(id_), "cluster"), id_, "left").withColumn("cluster", F.coalesce("cluster", id_))
    known = [F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(at, id_))).alias(c) for c in first]
    return own.groupBy("cluster").agg(F.min(at).alias("first_seen"), F.count("*").alias("reports"), *known, F.array_sort(F.collect_set(center)).alias("centers"), F.array_sort(F.collect_list(id_)).alias("case_ids"))


def evaluate_duplicates(pairs: DataFrame, truth: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, found, right, precision, recall, f1) of scored pairs against the true ones."""
    marked = pairs.join(truth.select("a", "b").distinct().withColumn("_t", F.lit(1)), ["a", "b"], "left")
    total = truth.select("a", "b").distinct().agg(F.count("*").alias("_all"))
    steps = pairs.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    counted = marked.crossJoin(F.broadcast(steps)).groupBy("threshold").agg(F.sum((F.col("score") >= F.col("threshold")).cast("long")).alias("found"), F.sum(((F.col("score") >= F.col("threshold")) & F.col("_t").isNotNull()).cast("long")).alias("right"))
    out = counted.crossJoin(F.broadcast(total)).withColumn("precision", F.try_divide(F.col("right"), F.col("found"))).withColumn("recall", F.try_divide(F.col("right"), F.col("_all")))
    return out.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).drop("_all")


def evaluate_cases(pairs: DataFrame, cases: DataFrame, thresholds: list[float], *, id_: str, flag: str) -> DataFrame:
    """(threshold, found, right, precision, recall, f1) of cases: those in a pair of the threshold or better, against the cases' own duplicate flag (E8). A null flag is false."""
    both = pairs.select(F.col("a").alias("_id"), "score").unionByName(pairs.select(F.col("b").alias("_id"), "score")).groupBy("_id").agg(F.max("score").alias("_s"))
    own = cases.groupBy(F.col(id_).alias("_id")).agg(F.max(F.coalesce(F.col(flag), F.lit(False))).alias("_f")).join(both, "_id", "left")
    sums = []
    for i, t in enumerate(thresholds):
        hit = F.coalesce(F.col("_s") >= t, F.lit(False))
        sums += [F.sum(hit.cast("long")).alias(f"_a{i}"), F.sum((hit & F.col("_f")).cast("long")).alias(f"_b{i}")]
    one = own.agg(F.sum(F.col("_f").cast("long")).alias("_all"), *sums)
    rows = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_a{i}").alias("found"), F.col(f"_b{i}").alias("right")) for i, t in enumerate(thresholds)]))
    out = one.select("_all", rows.alias("_x")).select("_all", "_x.*")
    out = out.withColumn("precision", F.try_divide(F.col("right"), F.col("found"))).withColumn("recall", F.try_divide(F.col("right"), F.col("_all"))).drop("_all")
    return out.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


#: Spark frees the shuffle files of a query at its end while this is on.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Bytes of a row group of stored tables, which a task holds while it writes, and of the dictionary of its values.
GROUP_BYTES, DICTIONARY_BYTES = 32 << 20, 4 << 20
#: Tables of :func:`stored` and their folders.
_folders: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the checkpoint folder, where numbers that return take little room; its shuffle files go as soon as it is there."""
    spark = df.sparkSession
    base = spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    path, before = f"{base}/rows-{uuid.uuid4().hex}", spark.conf.get(FREE_SHUFFLES)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").option("parquet.block.size", GROUP_BYTES).option("parquet.dictionary.page.size", DICTIONARY_BYTES).parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    _folders[out] = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables of :func:`stored` that no later job reads."""
    for df in tables:
        path = _folders.pop(df, None)
        if path:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def seen_before(*ends: tuple[str, str]) -> Column:
    """Whether x and y agree in one of these columns, keys that they had before: then they meet there, and their pair comes from there. Most pairs of near copies come once that way and not from each key that they share."""
    return reduce(lambda p, q: p | q, [F.coalesce(F.col(f"x.{a}") == F.col(f"y.{b}"), F.lit(False)) for a, b in ends])


def equal_sets(df: DataFrame, id_: str, tokens: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sets ``_id, _t, _n, _k`` with the tokens' sorted hashes, their number and a hash of them all; ``_id, _k, _n`` of the smallest id of each distinct set, ids once; pairs (a, b, jaccard) of that id with the others of an equal set).

    Rows without tokens are left out. Sets are written once, and only ids and hashes are shuffled.
    """
    rows = df.select(F.col(id_).alias("_id"), F.array_sort(F.array_distinct(F.transform(tokens, lambda w: F.xxhash64(w)))).alias("_t")).filter(F.size("_t") > 0)
    rows = stored(rows.select("_id", "_t", F.size("_t").alias("_n"), F.xxhash64(F.lit(3), "_t").alias("_k")))
    first = rows.groupBy("_k").agg(F.min("_id").alias("_o"), F.min("_n").alias("_n"))
    same = rows.select("_id", "_k").join(first, "_k").filter("_id <> _o").select(F.col("_o").alias("a"), F.col("_id").alias("b"), F.lit(1.0).alias("jaccard"))
    return rows, stored(one_set(first.withColumnRenamed("_o", "_id"))), stored(same)


def one_set(sets: DataFrame) -> DataFrame:
    """(_id, _k, _n): an id once, with the set of the smallest hash."""
    return sets.groupBy("_id").agg(F.min(F.struct("_k", "_n")).alias("_x")).select("_id", "_x.*")


#: Longs of a filter of :func:`those_of` at most: 8 MB.
FILTER_LONGS = 1 << 20


def chosen(sets: DataFrame, first: DataFrame) -> DataFrame:
    """Those ``sets`` whose ``_id, _k`` are among ``first``, dealt by ``_id`` alone, as later steps need them."""
    return sets.join(first.select("_id", F.col("_k").alias("_f")).hint("merge"), "_id").filter("(_k ^ _f) = 0").drop("_k", "_f")


def those_of(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """``sets`` without most of those whose ``_id, _k`` are not among ``wanted``: by a bit for each hash, 16 for each wanted row up to ``FILTER_LONGS``, that goes to all tasks, so sets are not shuffled for it."""
    n = min(FILTER_LONGS, wanted.count() // 4 + 1)
    place = F.pmod(F.xxhash64(F.lit(7), "_id", "_k"), F.lit(64 * n))
    bits = wanted.select(place.alias("_h")).groupBy(F.shiftright("_h", 6).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_h & 63 as int))")).alias("_b"))
    filled = sets.sparkSession.range(n).join(bits, "id", "left").select("id", F.coalesce("_b", F.lit(0).cast("long")).alias("_b"))
    one = filled.agg(F.sort_array(F.collect_list(F.struct("id", "_b"))).getField("_b").alias("_bits"))
    return sets.withColumn("_h", place).join(F.broadcast(one), F.expr("shiftright(get(_bits, cast(shiftright(_h, 6) as int)), cast(_h & 63 as int)) & 1 = 1")).drop("_h", "_bits")


#: Longs of a set's parity bits.
PARITY = 8
#: Tokens that are hashed at once.
CHUNK_TOKENS = 1 << 17


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """64-bit numbers as others that look drawn anew for each seed."""
    x = (x ^ np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def chunks(sets: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes of the tokens, places where sets begin) of as many sets at once as have ``CHUNK_TOKENS`` tokens, or one. No set is blank."""
    ends = np.cumsum(sets.map(len).to_numpy())
    lo = 0
    while lo < len(sets):
        begin = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, begin + CHUNK_TOKENS, "right")))
        yield np.concatenate(sets.iloc[lo:hi].to_list()).astype(np.int64).view(np.uint64), np.concatenate([[0], ends[lo : hi - 1] - begin]).astype(np.int64)
        lo = hi


def parities(flat: np.ndarray, starts: np.ndarray, longs: int = PARITY) -> np.ndarray:
    """(sets x longs): the parity of each set's tokens by place in as many bits; those of two sets differ in no more bits than tokens are in one set only."""
    bit, word = np.uint64(1) << (flat & np.uint64(63)), (flat >> np.uint64(6)) % np.uint64(longs)
    return np.stack([np.bitwise_xor.reduceat(np.where(word == np.uint64(i), bit, np.uint64(0)), starts) for i in range(longs)], axis=1).view(np.int64)


def may_be_similar(x: str, y: str, least: float) -> Column:
    """Whether the sizes ``_n`` and parity bits ``_p0`` to ``_p7`` of sets x and y leave it open that they are ``least`` similar."""
    n, m = F.col(f"{x}._n"), F.col(f"{y}._n")
    wanted = F.ceil(F.lit(least / (1 + least)) * (n + m) - 1e-9)  # tokens that sets of these sizes must share
    apart = sum((F.bit_count(F.col(f"{x}._p{i}").bitwiseXOR(F.col(f"{y}._p{i}"))) for i in range(PARITY)), F.lit(0))
    return (F.least(n, m) >= F.lit(least) * F.greatest(n, m) - 1e-9) & (apart <= n + m - 2 * wanted)


#: Tokens of the sets of a leader that meet in one block.
BLOCK_TOKENS = 4_000_000


#: Tokens that blocks of one round hold together at least.
ROUND_TOKENS = 64_000_000


def dealt_sets(pairs: DataFrame, sets: DataFrame, tokens: int) -> tuple[DataFrame, DataFrame]:
    """(pairs ``a, b`` with their block ``_b``; members ``_g, _id, _t`` of the blocks), so that a set goes to blocks and not to each of its pairs.

    The leader of a set is the smallest id among it and its partners, which near copies have in common. Leaders' sets are dealt to parts of some ``tokens``
    tokens, a pair is where the parts of its two sets meet, and as many of these meetings are one block as have that many tokens together.
    """
    placed, home, _ = _placed(pairs, one_set(sets), tokens)
    return placed.select("_b", "a", "b"), _members(placed, sets.join(home.select("_id", "_k"), ["_id", "_k"]))


def _placed(pairs: DataFrame, first: DataFrame, tokens: int) -> tuple[DataFrame, DataFrame, int]:
    """(pairs with their block; the sets that take part, ``_id, _k, _n``; tokens that the blocks hold together)."""
    both = pairs.select(F.col("a").alias("_id"), F.col("b").alias("_o")).unionAll(pairs.select("b", "a"))
    led = stored(both.groupBy("_id").agg(F.least(F.col("_id"), F.min("_o")).alias("_l")).join(first, "_id"))
    parts = led.groupBy("_l").agg(F.ceil(F.sum("_n") / tokens).alias("_m"))
    home = stored(led.join(parts, "_l").select("_id", "_n", "_k", F.struct("_l", F.pmod(F.xxhash64("_id"), F.col("_m")).alias("_s")).alias("_h")))
    at = lambda end: home.select(F.col("_id").alias(end), F.col("_n").alias(f"_n{end}"), F.xxhash64("_h").alias(f"_h{end}"))
    placed = stored(pairs.join(at("a"), "a").join(at("b"), "b").select("a", "b", "_na", "_nb", F.xxhash64(F.least("_ha", "_hb"), F.greatest("_ha", "_hb")).alias("_b")))
    forget(led)
    total = _ends(placed).agg(F.sum("_n")).first()[0] or 0
    return placed.withColumn("_b", F.pmod("_b", F.lit(max(1, -(-total // tokens))))), home, total


def _ends(placed: DataFrame) -> DataFrame:
    """(_g, _id, _n): the sets of each block."""
    return placed.select(F.col("_b").alias("_g"), F.explode(F.array(F.struct(F.col("a").alias("_id"), F.col("_na").alias("_n")), F.struct(F.col("b").alias("_id"), F.col("_nb").alias("_n")))).alias("_x")).select("_g", "_x.*").distinct()


def _members(placed: DataFrame, sets: DataFrame) -> DataFrame:
    return _ends(placed).select("_g", "_id").join(sets.select("_id", "_t"), "_id")


def similar_sets(met: DataFrame, sets: DataFrame, first: DataFrame, least: float) -> DataFrame:
    """(a, b, jaccard) of those pairs ``met`` of ``sets`` (of :func:`equal_sets`, with ``first``) that are at least ``least`` similar. Sets are read once in each block of :func:`dealt_sets`.

    The sets of a large group of near copies are in many blocks, the more the larger it is. So only as many blocks are filled in one round as hold some ``ROUND_TOKENS`` tokens, or as many as the sets
    themselves if these are more, and each round's shuffle files go before the next; ``sets`` are forgotten then.
    """
    pairs = stored(met)
    placed, home, total = _placed(pairs, first, BLOCK_TOKENS)
    some = chosen(those_of(sets, home), home).select("_id", "_t")
    rounds = max(1, -(-total // max(ROUND_TOKENS, home.agg(F.sum("_n")).first()[0] or 0)))
    forget(pairs)
    kind = dict(sets.dtypes)["_id"]

    def measured(asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        sizes = own["_t"].map(len).to_numpy()
        codes = np.split(np.unique(np.concatenate([*own["_t"], np.zeros(0, dtype=np.int64)]), return_inverse=True)[1], np.cumsum(sizes)[:-1])
        place = {x: i for i, x in enumerate(own["_id"])}
        asked = asked.sort_values("a", ignore_index=True)
        a, b = asked["a"].map(place).to_numpy(), asked["b"].map(place).to_numpy()
        marked, last, shared = np.zeros(sizes.sum() + 1, dtype=bool), None, np.zeros(len(asked), dtype=np.int64)
        for i, (x, y) in enumerate(zip(a, b, strict=True)):
            if x != last:
                if last is not None:
                    marked[codes[last]] = False
                marked[codes[x]], last = True, x
            shared[i] = np.count_nonzero(marked[codes[y]])
        asked["jaccard"] = shared / (sizes[a] + sizes[b] - shared)
        return asked.loc[asked["jaccard"] >= least - 1e-9, ["a", "b", "jaccard"]]

    def near(placed: DataFrame) -> DataFrame:
        return placed.select("_b", "a", "b").groupBy("_b").cogroup(_members(placed, some).groupBy("_g")).applyInPandas(measured, f"a {kind}, b {kind}, jaccard double")

    if rounds == 1:
        return near(placed)
    some = stored(some)
    forget(sets, home)
    done = [stored(near(placed.filter(F.pmod("_b", F.lit(rounds)) == i))) for i in range(rounds)]
    forget(some)
    return reduce(DataFrame.unionByName, done)


def token_join(df: DataFrame, *, id_: str, tokens: str, least: float) -> DataFrame:
    """(a, b, jaccard), a < b, of token sets at least ``least`` similar, exactly.

    Equal sets meet as one row first: their smallest id stands for all in the pairs with other sets, and has a pair of similarity 1 with each of the others,
    so n copies give n - 1 pairs. Tokens are compared by 64-bit hashes, ordered by rarity, and only a row's rarest ones are indexed: two sets this similar must share
    one of them. How frequent a token is is told by counts in ``SLOTS`` slots; any order that all sets have in common is right. Rows that meet there are held against three bounds before the sets are: their sizes, what they can still share after the
    places of the common token, and the bits in which the parities of their tokens differ. Rows with no tokens match nothing.
    """
    met, rows, first, same = _token_candidates(df, id_=id_, tokens=tokens, least=least)
    out = similar_sets(met, rows, first, least).unionByName(same)
    forget(first)
    return out


def token_candidates(df: DataFrame, *, id_: str, tokens: str, least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs a, b that no bound of :func:`token_join` rules out; sets of :func:`equal_sets`; pairs of equal sets)."""
    met, rows, _, same = _token_candidates(df, id_=id_, tokens=tokens, least=least)
    return met, rows, same


#: Tokens from which sets meet by size and not by tokens; longs of their parity bits, and those that are held against each other first; sets of a block.
LONG, WIDE, FIRST, LONG_BLOCK = 800, 64, 16, 2_500


def _long_pairs(long: DataFrame, least: float) -> DataFrame:
    """(a, b), a < b, of sets ``_id, _n, _wide`` of more than ``LONG`` tokens whose sizes and parity bits leave it open that they are ``least`` similar.

    Long sets share a rare token with most others of their size, so all of about the same size are held against each other, a few bits a token, in blocks. The work grows with the square of the long sets; only pairs within reach are written.
    """
    size = F.floor(F.log(F.col("_n") / LONG) / max(0.01, float(-np.log(max(least, 1e-9)))) + 1e-9).cast("int")  # similar sets are of the same size or the next
    sized = long.withColumn("_c", size)
    m = {r["_c"]: -(-r["n"] // LONG_BLOCK) for r in sized.groupBy("_c").agg(F.count("*").alias("n")).collect()}
    parts = F.create_map(*[F.lit(x) for c in sorted(m) for x in (c, m[c])]) if m else F.create_map(F.lit(0), F.lit(1))
    count = lambda c: F.coalesce(F.element_at(parts, c), F.lit(0))
    own = sized.withColumn("_s", F.pmod(F.xxhash64("_id"), count(F.col("_c"))).cast("int"))
    others = lambda c, lo: F.when(count(c) > lo, F.sequence(lo, count(c) - 1)).otherwise(F.array().cast("array<int>"))
    # a block is a part with one of its own size from it on, or with one of the next size
    group = lambda c, s, d, u: F.struct(c.alias("c"), s.alias("s"), d.alias("d"), u.alias("u"))
    c, s = F.col("_c"), F.col("_s")
    left = F.concat(F.transform(others(c, s), lambda u: group(c, s, c, u)), F.transform(others(c + 1, F.lit(0)), lambda u: group(c, s, c + 1, u)))
    right = F.concat(F.transform(F.filter(others(c, F.lit(0)), lambda u: u < s), lambda u: group(c, u, c, s)), F.transform(others(c - 1, F.lit(0)), lambda u: group(c - 1, u, c, s)))
    both = F.concat(F.transform(left, lambda g: F.struct(g.alias("g"), F.lit(0).alias("y"))), F.transform(right, lambda g: F.struct(g.alias("g"), F.lit(1).alias("y"))))
    dealt_ = own.select("_id", "_n", "_wide", F.explode(both).alias("_x")).select("_id", "_n", "_wide", F.col("_x.g").alias("_g"), F.col("_x.y").alias("_y"))
    kind = dict(long.dtypes)["_id"]

    def near(block: pd.DataFrame) -> pd.DataFrame:
        g = block["_g"].iloc[0]
        one = (g["c"], g["s"]) == (g["d"], g["u"])
        x, y = (block, block) if one else (block[block["_y"] == 0], block[block["_y"] == 1])
        ids, others_, sizes, n = x["_id"].to_numpy(), y["_id"].to_numpy(), x["_n"].to_numpy(), y["_n"].to_numpy()
        a, b = [ids[:0]], [ids[:0]]
        if len(x) and len(y):
            bits, held = (np.stack(v["_wide"].to_list()).astype(np.int64).view(np.uint64) for v in (x, y))
            begin = np.ascontiguousarray(held[:, :FIRST])
            for i in range(len(x)):
                most = sizes[i] + n - 2 * np.ceil(least / (1 + least) * (sizes[i] + n) - 1e-9).astype(np.int64)
                fit = (np.minimum(sizes[i], n) >= least * np.maximum(sizes[i], n) - 1e-9) & (ids[i] < others_ if one else ids[i] != others_)
                hit = np.flatnonzero(fit & (np.bitwise_count(begin ^ bits[i, :FIRST]).sum(axis=1, dtype=np.int64) <= most))
                hit = hit[np.bitwise_count(held[hit] ^ bits[i]).sum(axis=1, dtype=np.int64) <= most[hit]]
                a.append(np.minimum(ids[i], others_[hit]))
                b.append(np.maximum(ids[i], others_[hit]))
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    return dealt_.groupBy("_g").applyInPandas(near, f"a {kind}, b {kind}")


#: Slots of hashes in which tokens are counted.
SLOTS = 1 << 21


def _token_counts(rows: DataFrame) -> Broadcast:
    """How many tokens of all sets fall into each of ``SLOTS`` slots, for all tasks: 8 MB, however many tokens there are. Tokens that share a slot pass for more frequent ones."""
    spark = rows.sparkSession
    counts = stored(rows.select(F.explode("_t").alias("_w")).groupBy(F.expr(f"cast(_w & {SLOTS - 1} as int)").alias("_s")).agg(F.least(F.count("*"), F.lit(2**31 - 1)).cast("int").alias("_n")))
    found, table = counts.filter("_n > 1").toArrow(), np.ones(SLOTS, dtype=np.int32)
    table[found["_s"].to_numpy()] = found["_n"].to_numpy()
    forget(counts)
    return spark.sparkContext.broadcast(table)


def _token_candidates(df: DataFrame, *, id_: str, tokens: str, least: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    rows, first, same = equal_sets(df, id_, tokens)
    counts = _token_counts(rows)

    @F.pandas_udf("struct<before: int, words: array<long>, bits: array<long>, wide: array<long>>")
    def begun(t: pd.Series) -> pd.DataFrame:
        before, words, bits, wide = [np.zeros(0, dtype=np.int32)], [], [np.zeros((0, PARITY), dtype=np.int64)], []
        for flat, starts in chunks(t):
            n = np.diff(np.append(starts, len(flat)))
            known = counts.value[flat % np.uint64(SLOTS)].astype(np.int64)
            order = np.argsort(np.repeat(np.arange(len(n)), n) << 32 | known, kind="stable")  # of tokens counted as often the smaller hash comes first
            rare = np.add.reduceat(known == 1, starts)
            kept = np.maximum(rare, n - np.ceil(least * n - 1e-9).astype(np.int64) + 1)
            flat = flat.view(np.int64)[order]
            before.append(rare.astype(np.int32))
            words += [flat[s + r : s + k] for s, r, k in zip(starts, rare, kept, strict=True)]
            bits.append(parities(flat.view(np.uint64), starts))
            wide += [parities(flat[s : s + m].view(np.uint64), np.zeros(1, dtype=np.int64), WIDE)[0] if m > LONG else None for s, m in zip(starts, n, strict=True)]
        return pd.DataFrame({"before": np.concatenate(before), "words": words, "bits": list(np.concatenate(bits)), "wide": wide})

    own = rows.withColumn("_x", begun("_t")).select("_id", "_n", "_k", F.col("_x.before").alias("_before"), F.col("_x.words").alias("_words"), F.col("_x.wide").alias("_wide"), *[F.col("_x.bits")[i].alias(f"_p{i}") for i in range(PARITY)])
    own = stored(chosen(own, first).dropDuplicates(["_id"]))
    counts.destroy()
    at = lambda back: F.get("_words", F.col("_i") - back)
    begins = own.filter(F.col("_n") <= LONG / least + 1).select("*", F.posexplode("_words").alias("_i", "_w")).withColumns({"_p": F.col("_before") + F.col("_i") + 1, "_q1": at(1), "_q2": at(2)})
    parts, meet = met_in_blocks(begins.drop("_before", "_words", "_wide", "_i"), ["_w"], told=True)
    wanted = F.ceil(F.lit(least / (1 + least)) * (F.col("x._n") + F.col("y._n")) - 1e-9)  # tokens that sets of these sizes must share
    reach = F.least("x._p", "y._p") + F.least(F.col("x._n") - F.col("x._p"), F.col("y._n") - F.col("y._p")) >= wanted
    met = parts.alias("x").join(parts.alias("y").hint("merge"), meet & reach & (F.least("x._n", "y._n") <= LONG) & ~seen_before(("_q1", "_q1"), ("_q2", "_q2"), ("_q1", "_q2"), ("_q2", "_q1")) & may_be_similar("x", "y", least)).select(F.col("x._id").alias("a"), F.col("y._id").alias("b")).distinct()
    met = met.unionByName(_long_pairs(own.filter(F.col("_n") > LONG).select("_id", "_n", "_wide"), least))
    return met, rows, first, same


#: Terms of a transcript, those that can add most, that choose the cases which give its floor; cases scored for it, in multiples of k.
LEAD_TERMS, LEAD_CASES = 8, 4


def transcript_candidates(transcripts: DataFrame, cases: DataFrame, k: int, *, query_id: str, case_id: str, tokens: str = "tokens") -> DataFrame:
    """(query_id, case_id, score, rank): cases by TF-IDF cosine to each transcript (E11). Frequencies are counted over all cases.

    Cases that cannot be among the k best are not scored. The terms that can add most to a transcript's scores choose a few cases, and the k-th of their scores is
    a floor. Cases are blocked by norm, and each block knows the most that a term adds there: terms that together stay under the floor name no
    candidates of the block, and a case under the other terms is kept if what it has and the most that the terms left out can
    add reach the floor. The rows are those of scoring all cases.
    """
    candidates, mine, weighed, qnorms = _may_reach(transcripts, cases, k, query_id, case_id, tokens)
    more = candidates.join(mine.filter("_late").select("_q", "_b", "_w", "_y"), ["_q", "_b"]).join(weighed, ["_w", "_c", "_b"]).groupBy("_q", "_c").agg(F.sum(F.col("_x") * F.col("_y")).alias("_more"))
    dots = candidates.join(more, ["_q", "_c"], "left").withColumn("_d", F.col("_part") + F.coalesce("_more", F.lit(0.0)))
    scored = dots.join(qnorms, "_q").withColumn("score", F.round(F.try_divide(F.col("_d"), F.col("_qn")), 6)).filter("score > 0")
    rank = F.row_number().over(Window.partitionBy("_q").orderBy(F.desc("score"), "_c"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("_q").alias(query_id), F.col("_c").alias(case_id), "score", "rank")


def _may_reach(transcripts: DataFrame, cases: DataFrame, k: int, query_id: str, case_id: str, tokens: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(candidates ``_q, _c, _b, _part``; terms of transcripts by block with ``_late``, those that name no candidates; weights over norm of cases; norms of transcripts)."""
    terms = cases.select(F.col(case_id).alias("_c"), F.explode(tokens).alias("_w")).groupBy("_c", "_w").agg(F.count("*").alias("_tf")).checkpoint()
    n = cases.agg(F.count("*").alias("_n"))
    idf = terms.groupBy("_w").agg(F.count("*").alias("_df")).crossJoin(F.broadcast(n)).select("_w", F.ln((F.col("_n") + 1) / (F.col("_df") + 1)).alias("_idf"))
    asked = transcripts.select(F.col(query_id).alias("_q"), F.explode(tokens).alias("_w")).groupBy("_q", "_w").agg(F.count("*").alias("_qf"))
    known = asked.select("_w").distinct().withColumn("_in", F.lit(True))
    all_ = terms.join(idf.join(known, "_w", "left"), "_w").select("_c", "_w", "_in", (F.col("_tf") * F.col("_idf")).alias("_x"))
    norm = F.sqrt(F.sum(F.col("_x") * F.col("_x")).over(Window.partitionBy("_c")))
    weighed = all_.withColumn("_cn", norm).filter("_in and _x > 0").select("_c", "_w", (F.col("_x") / F.col("_cn")).alias("_x"), F.floor(2 * F.log2("_cn")).alias("_b")).checkpoint()
    most = weighed.groupBy("_w", "_b").agg(F.max("_x").alias("_top"))
    mine = asked.join(idf, "_w").select("_q", "_w", (F.col("_qf") * F.col("_idf")).alias("_y")).checkpoint()
    qnorms = mine.groupBy("_q").agg(F.sqrt(F.sum(F.col("_y") * F.col("_y"))).alias("_qn"))
    summed = F.sum(F.col("_x") * F.col("_y"))

    best = lambda df, score, m: df.withColumn("_r", F.row_number().over(Window.partitionBy("_q").orderBy(F.desc(score), "_c"))).filter(F.col("_r") <= m)
    gain = mine.join(most.groupBy("_w").agg(F.max("_top").alias("_top")), "_w").withColumn("_i", F.row_number().over(Window.partitionBy("_q").orderBy(F.desc(F.col("_y") * F.col("_top")), "_w")))
    lead = best(gain.filter(F.col("_i") <= LEAD_TERMS).join(weighed, "_w").groupBy("_q", "_c").agg(summed.alias("_part")), "_part", LEAD_CASES * k).select("_q", "_c")
    sure = lead.join(mine, "_q").join(weighed, ["_w", "_c"]).groupBy("_q", "_c").agg(summed.alias("_d"))
    # scores are rounded to six digits, so the floor is a little lower than the k-th of these
    floors = best(sure, "_d", k).filter(F.col("_r") == k).join(qnorms, "_q").select("_q", (F.col("_d") - 2e-6 * F.col("_qn")).alias("_floor"))

    # the most that a term and all that can add less may give, in each block
    rest = F.sum(F.col("_y") * F.col("_top")).over(Window.partitionBy("_q", "_b").orderBy(F.desc(F.col("_y") * F.col("_top")), "_w").rowsBetween(Window.currentRow, Window.unboundedFollowing))
    blocked = mine.join(most, "_w").withColumn("_rest", rest).join(floors, "_q", "left").withColumn("_late", F.coalesce(F.col("_rest") < F.col("_floor"), F.lit(False))).checkpoint()
    left_out = blocked.groupBy("_q", "_b").agg(F.coalesce(F.max(F.when(F.col("_late"), F.col("_rest"))), F.lit(0.0)).alias("_add"), F.max("_floor").alias("_floor"))
    parts = blocked.filter("not _late").select("_q", "_w", "_b", "_y").join(weighed, ["_w", "_b"]).groupBy("_q", "_c", "_b").agg(summed.alias("_part"))
    candidates = parts.join(left_out, ["_q", "_b"]).filter(F.coalesce(F.col("_part") + F.col("_add") >= F.col("_floor"), F.lit(True))).select("_q", "_c", "_b", "_part").checkpoint()
    return candidates, blocked, weighed, qnorms


def usable_vector(v: str) -> Column:
    """Whether a vector has a direction: not null, not all zero, no component null, infinite or undefined."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(F.exists(v, lambda x: x != 0) & ~F.exists(v, odd), F.lit(False))


def embedding_topk(queries: DataFrame, gallery: DataFrame, k: int, least: float = -1.0, *, query_id: str = "query_id", vec_id: str = "vec_id", embedding: str = "embedding", others: bool = False, query_block: int = QUERY_BLOCK, gallery_block: int = GALLERY_BLOCK) -> DataFrame:
    """(query_id, vec_id, score, rank) by exact cosine (E12, I2): queries and gallery are dealt to blocks, each pair of blocks meets in one task and keeps its own best, the best of all are kept.

    Null and zero vectors, such with null, infinite or undefined components, and such of another length than most of the gallery (the longest, on a
    tie) take no part; ties go by the smaller id. With ``others``, a gallery vector of the query's own id is left out. Only counts reach the driver.
    """
    spark = gallery.sparkSession
    q = queries.select(F.col(query_id).alias("_q"), F.col(embedding).cast("array<double>").alias("_v")).filter(usable_vector("_v"))
    g = gallery.select(F.col(vec_id).alias("_g"), F.col(embedding).cast("array<double>").alias("_v")).filter(usable_vector("_v"))
    sizes = g.groupBy(F.size("_v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    dim, n_gallery = (sizes[0]["dim"], sizes[0]["n"]) if sizes else (0, 0)
    q, g = q.filter(F.size("_v") == dim), g.filter(F.size("_v") == dim)
    deal = lambda n: F.array(*[F.lit(i) for i in range(n)]) if n <= 64 else F.sequence(F.lit(0), F.lit(n - 1))
    nq, ng = max(1, -(-q.count() // query_block)), max(1, -(-n_gallery // gallery_block), min(spark.sparkContext.defaultParallelism, 64))
    q = q.withColumn("_a", F.pmod(F.xxhash64("_q"), F.lit(nq)).cast("int")).withColumn("_b", F.explode(deal(ng)))
    g = g.withColumn("_b", F.pmod(F.xxhash64("_g"), F.lit(ng)).cast("int")).withColumn("_a", F.explode(deal(nq)))

    def best(asked: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(pdf):
            return pd.DataFrame({query_id: [], vec_id: [], "score": []}).astype({query_id: "int64", vec_id: "int64", "score": "float64"})
        unit = lambda c: (x := np.stack(c.to_numpy())) / np.linalg.norm(x, axis=1, keepdims=True)
        x, ids, v = unit(pdf["_v"]), asked["_q"].to_numpy(), pdf["_g"].to_numpy()
        parts = []
        for lo in range(0, len(asked), 256):
            s = np.round(unit(asked["_v"].iloc[lo : lo + 256]) @ x.T, 6)
            if others:
                s[ids[lo : lo + 256, None] == v] = -2  # below any cosine
            cut = -np.partition(-s, k - 1, axis=1)[:, k - 1] if k < len(v) else s.min(axis=1)
            row, hit = np.nonzero(s >= np.maximum(cut, max(least, -1))[:, None])
            order = np.lexsort((v[hit], -s[row, hit], row))
            row, hit = row[order], hit[order]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < k
            parts.append(pd.DataFrame({query_id: ids[lo + row[keep]], vec_id: v[hit[keep]], "score": s[row[keep], hit[keep]]}))
        return pd.concat(parts)

    near = q.groupBy("_a", "_b").cogroup(g.groupBy("_a", "_b")).applyInPandas(best, f"{query_id} long, {vec_id} long, score double")
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), vec_id))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k)


def fuse_scores(face: DataFrame, clothing: DataFrame, weight: float, keys: tuple[str, str] = ("query_id", "case_id")) -> DataFrame:
    """One score of two per (query, case); a missing side leaves the other alone."""
    both = face.select(*keys, F.col("score").alias("_f")).join(clothing.select(*keys, F.col("score").alias("_c")), list(keys), "full_outer")
    fused = F.when(F.col("_f").isNull(), F.col("_c")).when(F.col("_c").isNull(), F.col("_f")).otherwise(weight * F.col("_f") + (1 - weight) * F.col("_c"))
    return both.select(*keys, fused.alias("score"))


def open_cases(cases: DataFrame, matches: DataFrame, hours: float, now: Column, *, id_: str = "case_id", at: str = "reported_at") -> DataFrame:
    """Cases without an accepted match that are open longer than ``hours``."""
    old = (F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col(at).cast("timestamp"))) > hours * 3600
    return cases.filter(old).join(matches.select(id_).distinct(), id_, "left_anti")


def matched_cases(cases: DataFrame, matches: DataFrame, *, id_: str = "case_id") -> DataFrame:
    """Cases with an accepted match."""
    return cases.join(matches.select(id_).distinct(), id_, "left_semi")


def score_with(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A caller's own batch model over the partitions of ``df``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield fn(pdf)

    return df.mapInPandas(run, schema)
