"""The place graph: nodes, triples, edges, blocked places, shortest paths, routes and patterns (G)."""

from __future__ import annotations

import itertools
import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lostfound.functions.columns import EARTH_KM, haversine_km
from lostfound.operators.geo import DEGREE_KM, around, grid, nearest_k, within_radius

#: Goals of a start up to which its search is bounded by landmarks; starts x nodes from which that pays.
MOST_GOALS, MANY_STATES = 64, 2_000_000
#: Rounds of a search that are kept apart.
MOST_PARTS = 4
#: Nodes of either side that meet in one task of a search without stored edges; distances that such a task holds at once.
MEET_ROWS, HELD_WAYS = 4_000, 250_000


@dataclass(frozen=True)
class Nearby:
    """The graph of :func:`proximity_edges` with ``exact``, in both directions, for :func:`shortest_paths` and :func:`best_routes`: edges within ``km`` are
    measured where a search needs them and never written, so a dense graph costs no more than its nodes to keep. Of ways whose lengths differ by rounding alone either may be found."""

    nodes: DataFrame
    km: float
    k: int


def graph_nodes(**kinds: DataFrame) -> DataFrame:
    """(id, kind, name, lat, lng) of all kinds; ids are ``kind:name`` (G1). Each table has name, lat, lng."""
    parts = [df.select(F.concat(F.lit(kind + ":"), F.col("name").cast("string")).alias("id"), F.lit(kind).alias("kind"), F.col("name").cast("string").alias("name"), "lat", "lng") for kind, df in kinds.items()]
    return reduce(DataFrame.unionByName, parts)


def graph_triples(nodes: DataFrame, zones: DataFrame, stations: DataFrame, km: float, cases: DataFrame | None = None) -> DataFrame:
    """(subject, predicate, object): located_in the nearest zone, served_by the nearest station, near every node within ``km``.

    With ``cases`` (id, center, place), also reported_at the center and last_seen_at the place; nulls give no triple.
    """
    pick = lambda places, p: nearest_k(nodes, places.select(F.col("id").alias("object"), "lat", "lng"), 1, id_="id", place="object").select(F.col("id").alias("subject"), F.lit(p).alias("predicate"), "object")
    near = within_radius(nodes, nodes.select(F.col("id").alias("object"), "lat", "lng"), km, id_="id", other="object").filter("id <> object").select(F.col("id").alias("subject"), F.lit("near").alias("predicate"), "object")
    out = pick(zones, "located_in").unionByName(pick(stations, "served_by")).unionByName(near)
    if cases is None:
        return out
    said = F.array(*[F.struct(F.lit(p).alias("predicate"), F.concat(F.lit(f"{c}:"), F.col(c).cast("string")).alias("object")) for p, c in (("reported_at", "center"), ("last_seen_at", "place"))])
    of_cases = cases.select(F.concat(F.lit("case:"), F.col("id").cast("string")).alias("subject"), F.explode(said).alias("_x")).select("subject", "_x.*").filter("object is not null")
    return out.unionByName(of_cases)


def proximity_edges(nodes: DataFrame, km: float, k: int, exact: bool = False) -> DataFrame:
    """(src, dst, km), src < dst: all pairs within ``km``, and each node's k nearest so that none is alone.

    Distances have six digits; with ``exact`` they are not rounded, so that on a straight line many short steps are never shorter than a long one.
    """
    nodes = _placed_once(nodes)
    other = nodes.select(F.col("id").alias("dst"), "lat", "lng")
    near = within_radius(nodes, other, km, id_="id", other="dst", exact=exact).filter("id < dst").select(F.col("id").alias("src"), "dst", "km")
    return near.unionByName(_beyond(nodes, nodes, km, k, exact))


def _placed_once(nodes: DataFrame) -> DataFrame:
    """(id, lat, lng), a row for each id."""
    return nodes.groupBy("id").agg(F.min(F.struct("lat", "lng")).alias("_x")).select("id", "_x.*")


def _beyond(some: DataFrame, nodes: DataFrame, km: float, k: int, exact: bool) -> DataFrame:
    """(src, dst, km), src < dst: those of the k nearest nodes of ``some`` that are farther than ``km``."""
    other = nodes.select(F.col("id").alias("dst"), "lat", "lng")
    # pairs within the radius are there once already; only farther ones may be found from both ends
    close = nearest_k(some, other, k + 1, id_="id", place="dst").filter(F.col("km") > km).select(F.least("id", "dst").alias("src"), F.greatest("id", "dst").alias("dst"), "km").dropDuplicates(["src", "dst"])
    if exact:
        at = lambda end: nodes.select(F.col("id").alias(end), F.col("lat").alias(f"_{end}a"), F.col("lng").alias(f"_{end}o"))
        close = close.join(at("src"), "src").join(at("dst"), "dst").select("src", "dst", haversine_km(F.col("_srca"), F.col("_srco"), F.col("_dsta"), F.col("_dsto")).alias("km"))
    return close


def directed(edges: DataFrame) -> DataFrame:
    """Both directions of undirected edges."""
    return edges.select("src", "dst", "km").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "km"))


def _both_ways(edges: DataFrame | Nearby) -> DataFrame | Nearby:
    return edges if isinstance(edges, Nearby) else directed(edges)


def avoid(edges: DataFrame, blocked: DataFrame, penalty: float | None = None) -> DataFrame:
    """Edges without those that touch a blocked node, or with ``penalty`` km more for each blocked end."""
    ids = blocked.select("id").distinct()
    if penalty is None:
        return edges.join(ids.select(F.col("id").alias("src")), "src", "left_anti").join(ids.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst", "km")
    a, b = ids.select(F.col("id").alias("src"), F.lit(1).alias("_s")), ids.select(F.col("id").alias("dst"), F.lit(1).alias("_d"))
    more = (F.coalesce("_s", F.lit(0)) + F.coalesce("_d", F.lit(0))) * penalty
    return edges.join(a, "src", "left").join(b, "dst", "left").select("src", "dst", (F.col("km") + more).alias("km"))


def _stored(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the checkpoint folder. A checkpoint would keep the sizes that its plan was thought to have, products of those of the round before,
    whose digits double each round until planning takes longer than the work; a file has its own size."""
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/rounds-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _along(edges: DataFrame, shut: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """The step of a search along stored edges: of rows (source, node, km, path) the best ways on, (source, node, _n)."""
    edges = edges.select("src", "dst", "km").join(shut.withColumnRenamed("id", "src").withColumn("_shut", F.lit(True)), "src", "left").select(F.col("src").alias("node"), "dst", F.col("km").alias("_e"), F.coalesce("_shut", F.lit(False)).alias("_shut")).checkpoint()

    def step(front: DataFrame) -> DataFrame:
        on = front.join(edges, "node").filter(~F.col("_shut") | (F.col("node") == F.col("source"))).select("source", F.col("dst").alias("node"), (F.col("km") + F.col("_e")).alias("km"), F.concat("path", F.array("dst")).alias("path"))
        return on.groupBy("source", "node").agg(F.min(F.struct("km", "path")).alias("_n"))

    return step


def _among(graph: Nearby, shut: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """The step of :func:`_along` in a graph whose edges within ``km`` are not stored: nodes that improved meet the nodes of their own and the next cells of a grid.

    A crowded cell is dealt to parts of both sides. Of a source's ways to a node each task returns the best of its part.
    """
    km = graph.km
    band, columns, column = grid(km)
    at = _placed_once(graph.nodes).filter("lat is not null and lng is not null").join(shut.withColumn("_shut", F.lit(True)), "id", "left").withColumn("_shut", F.coalesce("_shut", F.lit(False)))
    lat, lng = F.radians("lat"), F.radians("lng")
    at = at.withColumns({"_v": F.monotonically_increasing_id(), "_px": F.cos(lat) * F.cos(lng), "_py": F.cos(lat) * F.sin(lng), "_pz": F.sin(lat)}).checkpoint()
    own = at.withColumn("_r", band(F.col("lat"))).withColumn("_c", column(F.col("lng"), columns(F.col("_r"))))
    to = around(at.select("_v", "lat", "lng", "_px", "_py", "_pz"), "lat", "lng", km)
    count = lambda df, name: df.groupBy("_r", "_c").agg(F.ceil(F.count("*") / MEET_ROWS).cast("int").alias(name))
    parts = count(own, "_mx").join(count(to, "_my"), ["_r", "_c"]).checkpoint()
    groups = parts.agg(F.sum(F.col("_mx").cast("long") * F.col("_my"))).first()[0] or 1
    n = min(groups, max(4 * graph.nodes.sparkSession.sparkContext.defaultParallelism, groups // 8))
    part = lambda m: F.pmod(F.xxhash64("_v"), F.col(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    keys = ["_r", "_c", "_sx", "_sy"]
    own = own.join(parts, ["_r", "_c"]).withColumn("_sx", part("_mx")).withColumnRenamed("id", "node").drop("lat", "lng", "_mx").checkpoint()
    to = to.join(parts, ["_r", "_c"]).withColumn("_sy", part("_my")).withColumn("_sx", every("_mx")).drop("lat", "lng", "_mx", "_my").checkpoint()
    # nodes of a cell as wide as half the radius are within it of each other, so where there are more than k of them all have their k nearest
    side = F.lit(max(km, 1e-6) / 2 / DEGREE_KM)
    cell = [F.floor(F.col("lat") / side).alias("_a"), F.floor(F.col("lng") / side).alias("_b")]
    alone = at.join(at.groupBy(*cell).agg(F.count("*").alias("_n")).filter(F.col("_n") > graph.k), [F.floor(F.col("lat") / side) == F.col("_a"), F.floor(F.col("lng") / side) == F.col("_b")], "left_anti")
    alone = alone.select("id", "lat", "lng").checkpoint()
    farther = None
    if alone.limit(1).count():
        farther = directed(_beyond(alone, at.select("id", "lat", "lng"), km, graph.k, True)).checkpoint()
        farther = _along(farther, shut) if farther.limit(1).count() else None
    most = math.floor(round(km * 1e6, 3)) / 1e6 + 5e-7  # distances of six digits count

    def relax(front: pd.DataFrame, places: pd.DataFrame) -> pd.DataFrame:
        """(_s, _v, km, _o) of the best way of each source to each place, ties by the smaller _o."""
        out = []
        if len(front) and len(places):
            front = front.sort_values(["_s", "_o"])
            s, o, done, (u, first) = front["_s"].to_numpy(), front["_o"].to_numpy(), front["km"].to_numpy(), np.unique(front["_v"].to_numpy(), return_index=True)
            col = np.searchsorted(u, front["_v"].to_numpy())
            ends = [*np.flatnonzero(np.r_[True, s[1:] != s[:-1]]), len(s)]
            here, there, ids = front[["_px", "_py", "_pz"]].to_numpy()[first], places[["_px", "_py", "_pz"]].to_numpy(), places["_v"].to_numpy()
            rows = max(1, HELD_WAYS // len(u))
            for lo in range(0, len(ids), rows):
                chord = np.sqrt(sum((there[lo : lo + rows, None, i] - here[None, :, i]) ** 2 for i in range(3)))
                way = 2 * EARTH_KM * np.arcsin(np.minimum(chord / 2, 1))
                way[way >= most] = np.inf
                for a, b in zip(ends, ends[1:]):
                    whole = way[:, col[a:b]] + done[a:b]
                    best = whole.argmin(axis=1)
                    least = whole[np.arange(len(best)), best]
                    hit = np.flatnonzero(np.isfinite(least))
                    out.append((np.full(len(hit), s[a]), ids[lo + hit], least[hit], o[a + best[hit]]))
        if not out:
            return pd.DataFrame({"_s": [], "_v": [], "km": [], "_o": []}).astype({"_s": "int64", "_v": "int64", "km": "float64", "_o": "int64"})
        return pd.DataFrame({c: np.concatenate(x) for c, x in zip(("_s", "_v", "km", "_o"), zip(*out))})

    def step(front: DataFrame) -> DataFrame:
        # numbers in the order of the paths, so that ties go as along stored edges
        known = front.join(own, "node").filter(~F.col("_shut") | (F.col("node") == F.col("source"))).join(at.select(F.col("id").alias("source"), F.col("_v").alias("_s")), "source")
        known = _stored(known.sort("path").withColumn("_o", F.monotonically_increasing_id()))
        left = known.select("_r", "_c", "_sx", every("_my").alias("_sy"), "_s", "_v", "km", "_o", "_px", "_py", "_pz").repartition(n, *keys)
        met = left.groupBy(*keys).cogroup(to.repartition(n, *keys).groupBy(*keys)).applyInPandas(relax, "_s long, _v long, km double, _o long")
        best = met.groupBy("_s", "_v").agg(F.min(F.struct("km", "_o")).alias("_b")).select("_v", "_b.km", "_b._o")
        named = best.join(known.select("_o", "source", "path"), "_o").join(at.select("_v", "id"), "_v")
        near = named.select("source", F.col("id").alias("node"), F.struct("km", F.concat("path", F.array("id")).alias("path")).alias("_n"))
        return near if farther is None else near.unionByName(farther(front)).groupBy("source", "node").agg(F.min("_n").alias("_n"))

    return step


def shortest_paths(edges: DataFrame | Nearby, sources: DataFrame, max_hops: int | None = None, closed: DataFrame | None = None, prune: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """(source, node, km, path) from every source (G5): each round relaxes the nodes that improved in the last, until none does.

    ``edges`` are directed (see :func:`directed`), or a :class:`Nearby` graph. Paths within 1e-9 km of each other tie: that with fewer steps is kept, of two found in one round the shorter, then
    the smaller. A node of ``closed`` (id) ends every path that reaches it, but for paths from itself. ``prune`` (offers, best so far) may
    drop offers (source, node, km, path) that nobody asks for. Each round writes the nodes that improved, and every ``MOST_PARTS`` rounds these are put together. Raises if nodes still improve after ``max_hops``
    rounds; without ``max_hops`` there is no such bound.
    """
    shut = sources.sparkSession.createDataFrame([], f"id {dict(sources.dtypes)['id']}") if closed is None else closed.select("id").distinct()
    step = _among(edges, shut) if isinstance(edges, Nearby) else _along(edges, shut)
    start = sources.select(F.col("id").alias("source"), F.col("id").alias("node"), F.lit(0.0).alias("km"), F.array("id").alias("path")).distinct().checkpoint()
    parts, front = [start], start
    # of a node that improved in several rounds the shortest row counts
    best = lambda: reduce(DataFrame.unionByName, parts).groupBy("source", "node").agg(F.min(F.struct("km", "path")).alias("_b")).select("source", "node", "_b.km", "_b.path")
    for _ in itertools.count() if max_hops is None else range(max_hops):
        offer = step(front)
        if prune is not None:
            offer = prune(offer.select("source", "node", "_n.km", "_n.path"), best()).select("source", "node", F.struct("km", "path").alias("_n"))
        old = reduce(DataFrame.unionByName, [p.select("source", "node", F.col("km").alias("_o")) for p in parts])
        held = offer.join(old, ["source", "node"], "left").groupBy("source", "node").agg(F.first("_n").alias("_n"), F.min("_o").alias("_o"))
        front = _stored(held.filter(F.col("_o").isNull() | (F.col("_n.km") < F.col("_o") - 1e-9)).select("source", "node", "_n.km", "_n.path"))
        if not front.limit(1).count():
            return best()
        parts.append(front)
        if len(parts) > MOST_PARTS:
            parts = [_stored(best())]
    raise ValueError(f"nodes still improve after {max_hops} rounds; paths have more edges than max_hops")


def landmark_bounds(nodes: DataFrame, edges: DataFrame | Nearby, max_hops: int | None = None) -> DataFrame:
    """(id, far): distances of each node from the northernmost, southernmost, easternmost and westernmost one, null where there is no way. |far(a) - far(b)| is never more than the way from a to b."""
    ends = nodes.agg(*[f("id", c).alias(f"{c}{i}") for c in ("lat", "lng") for i, f in enumerate((F.min_by, F.max_by))])
    marks = ends.select(F.posexplode(F.array("lat0", "lat1", "lng0", "lng1")).alias("_i", "id")).filter("id is not null").checkpoint()
    ways = shortest_paths(_both_ways(edges), marks.select("id").distinct(), max_hops).join(marks.withColumnRenamed("id", "source"), "source")
    return ways.groupBy(F.col("node").alias("id")).agg(F.array(*[F.max(F.when(F.col("_i") == i, F.col("km"))) for i in range(4)]).alias("far"))


def best_routes(requests: DataFrame, nodes: DataFrame, edges: DataFrame | Nearby, blocked: DataFrame | None = None, max_hops: int | None = None, *, landmarks: bool | None = None) -> DataFrame:
    """(start, goal, distance_km, path, steps) of a batch of requests (G6). A request may start or end at a blocked place, but never passes through one, whatever the others ask for; an unreachable goal has a null distance.

    Requests of one start share its search: a blocked place ends each of its paths, and so does what no goal needs. With ``landmarks``, a place is
    left out once its distance and the least way from it to any goal of the start, by :func:`landmark_bounds`, exceed the longest
    route the start still needs; by default for more than ``MANY_STATES`` starts x nodes. Routes are the same either way. Edges are the same in both directions.
    """
    asked = requests.select("start", "goal").distinct()
    prune = None
    if landmarks is None:
        landmarks = asked.select("start").distinct().count() * nodes.count() > MANY_STATES
    if landmarks:
        far = landmark_bounds(nodes, edges, max_hops).checkpoint()
        # a start with many goals is searched in full, so no row holds a long list
        few = asked.groupBy("start").agg(F.count("*").alias("_n")).filter(F.col("_n") <= MOST_GOALS)
        goals = asked.join(few, "start").join(far.select(F.col("id").alias("goal"), F.col("far").alias("_goal_far")), "goal", "left").groupBy(F.col("start").alias("source"), "_n").agg(F.collect_set("_goal_far").alias("_fars")).checkpoint()
        gap = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x.isNull() != y.isNull(), F.lit(float("inf"))).otherwise(F.coalesce(F.abs(x - y), F.lit(0.0)))), F.lit(0.0), lambda x, y: F.greatest(x, y))

        def prune(offers: DataFrame, best: DataFrame) -> DataFrame:
            reached = best.join(asked.select(F.col("start").alias("source"), F.col("goal").alias("node")), ["source", "node"]).groupBy("source").agg(F.max("km").alias("_most"), F.count("*").alias("_got"))
            known = goals.join(reached, "source").filter("_got = _n").select("source", "_fars", "_most")
            held = offers.join(known, "source", "left").join(far.select(F.col("id").alias("node"), "far"), "node", "left")
            least = F.col("km") + F.coalesce(F.array_min(F.transform("_fars", lambda g: gap(F.col("far"), g))), F.lit(0.0))
            return held.filter(F.coalesce(least <= F.col("_most") + 1e-6, F.lit(True))).select("source", "node", "km", "path")

    found = shortest_paths(_both_ways(edges), asked.select(F.col("start").alias("id")).distinct(), max_hops, blocked, prune)
    routes = requests.join(found.select(F.col("source").alias("start"), F.col("node").alias("goal"), F.col("km").alias("distance_km"), "path"), ["start", "goal"], "left")
    names = routes.select("start", "goal", F.posexplode("path").alias("_i", "id")).join(nodes.select("id", "name", "lat", "lng"), "id")
    named = names.groupBy("start", "goal").agg(F.transform(F.array_sort(F.collect_set(F.struct("_i", "name", "lat", "lng"))), lambda x: F.struct(x["name"].alias("name"), x["lat"].alias("lat"), x["lng"].alias("lng"))).alias("path"))
    out = routes.drop("path").join(named, ["start", "goal"], "left")
    return out.withColumn("steps", F.transform("path", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["name"])))


def match_pattern(triples: DataFrame, predicates: list[str]) -> DataFrame:
    """(n0, n1, ..): chains of triples with these predicates, the object of one the subject of the next."""
    out = None
    for i, p in enumerate(predicates):
        part = triples.filter(F.col("predicate") == p).select(F.col("subject").alias(f"n{i}"), F.col("object").alias(f"n{i + 1}"))
        out = part if out is None else out.join(part, f"n{i}")
    return out.select(*[f"n{i}" for i in range(len(predicates) + 1)])


def degree(edges: DataFrame) -> DataFrame:
    """(id, n, rank): neighbours of each node, most first. The few distinct numbers of neighbours are ranked, not the nodes."""
    n = directed(edges).groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("n")).checkpoint()
    before = F.sum("_c").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1))
    ranks = n.groupBy("n").agg(F.count("*").alias("_c")).select("n", (F.coalesce(before, F.lit(0)) + 1).cast("int").alias("rank"))
    return n.join(ranks, "n").select("id", "n", "rank")
