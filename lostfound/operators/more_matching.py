"""Approximate matching at scale (E10, E13), routing of face matches (E15), the match shares of centers."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lostfound.operators.geo import nearest_k
from lostfound.operators.matching import PARITY, chosen, chunks, dealt, equal_sets, forget, may_be_similar, met_in_blocks, mixed, parities, seen_before, similar_sets, stored, usable_vector

#: Share of pairs at the threshold that LSH tables may miss; vectors of a bucket that meet in one block.
MISSED, BUCKET = 0.005, 1_000


def minhash_pairs(df: DataFrame, bands: int, rows: int, *, id_: str, tokens: str, least: float) -> DataFrame:
    """(a, b, jaccard) of near token sets by min-hash bands, verified by the exact measure (E10). Blank sets are left out; of equal sets the smallest id stands for all and has a pair with each of the others.

    Buckets of more than ``BUCKET`` sets are dealt to parts. Sizes and parity bits go with a set to its buckets and rule out most pairs where they meet: pairs of sets that share a bucket by chance grow
    with the square of the sets, and are never written.
    """
    sets, first, same = equal_sets(df, id_, tokens)

    @F.pandas_udf("struct<keys: array<long>, bits: array<long>>")
    def signed(t: pd.Series) -> pd.DataFrame:
        keys, bits = [np.zeros((0, bands), dtype=np.int64)], [np.zeros((0, PARITY), dtype=np.int64)]
        for flat, starts in chunks(t):
            own = []
            for b in range(bands):
                key = np.full(len(starts), b, dtype=np.uint64)
                for r in range(rows):
                    key = mixed(key ^ np.minimum.reduceat(mixed(flat, 1 + b * rows + r), starts), 0)
                own.append(key.view(np.int64))
            keys.append(np.stack(own, axis=1))
            bits.append(parities(flat, starts))
        return pd.DataFrame({"keys": list(np.concatenate(keys)), "bits": list(np.concatenate(bits))})

    own = sets.withColumn("_x", signed("_t")).select("_id", "_n", "_k", F.col("_x.keys").alias("_keys"), *[F.col("_x.bits")[i].alias(f"_p{i}") for i in range(PARITY)])
    own = stored(chosen(own, first).dropDuplicates(["_id"]))
    parts, meet = met_in_blocks(own.select("_id", F.posexplode("_keys").alias("_i", "_k")), ["_k"], BUCKET, lone=False)
    parts = parts.join(own, "_id").withColumns({f"_q{back}": F.get("_keys", F.col("_i") - back) for back in (1, 2)}).drop("_keys", "_i")
    met = parts.alias("x").join(parts.alias("y").hint("merge"), meet & ~seen_before(("_q1", "_q1"), ("_q2", "_q2")) & may_be_similar("x", "y", least)).select(F.col("x._id").alias("a"), F.col("y._id").alias("b")).distinct()
    out = similar_sets(met, sets, first, least).unionByName(same)
    forget(first, own)
    return out


#: Hash tables of vectors, and the planes nearest to a vector that its probes may cross.
TABLES, NEAR_PLANES = 12, 6
#: Axes of the sketch that goes with a vector to its buckets.
SKETCH = 24


def sides(v: np.ndarray, normals: np.ndarray, tables: int, planes: int, probes: int) -> np.ndarray:
    """(vectors x tables x probes + 1): the bucket of each vector, and those it would be in if it stood beyond some of the planes nearest to it, likeliest first."""
    margin = (v @ normals.T).reshape(len(v), tables, planes)
    own = ((margin > 0) * (1 << np.arange(planes))).sum(axis=2)
    near = min(NEAR_PLANES, planes)
    order = np.argsort(np.abs(margin), axis=2)[:, :, :near]
    cost = np.take_along_axis(margin, order, axis=2) ** 2
    crossed = (np.arange(1 << near)[:, None] >> np.arange(near)) & 1
    best = np.argsort(cost @ crossed.T, axis=2, kind="stable")[:, :, : probes + 1]  # crossing none costs nothing and comes first
    flips = (crossed[best] * (1 << order)[:, :, None, :]).sum(axis=3)
    return own[:, :, None] ^ flips


def probes_for(planes: int, tables: int, least: float, dim: int, seed: int, missed: float = MISSED) -> int:
    """The fewest probes with which at most ``missed`` of pairs at cosine ``least`` meet in no table, on 2,000 random pairs."""
    rng = np.random.default_rng(seed)
    a, b = rng.standard_normal((2, 2_000, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (b * a).sum(axis=1, keepdims=True) * a
    b = least * a + math.sqrt(max(0.0, 1 - least**2)) * b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-12)
    normals = rng.standard_normal((tables * planes, dim))
    most = (1 << min(NEAR_PLANES, planes)) - 1
    x, y = sides(a, normals, tables, planes, most), sides(b, normals, tables, planes, most)
    first = np.minimum(np.where(x == y[:, :, :1], np.arange(most + 1), most + 1).min(axis=(1, 2)), np.where(y == x[:, :, :1], np.arange(most + 1), most + 1).min(axis=(1, 2)))
    return int(min(most, np.quantile(first, 1 - missed, method="inverted_cdf")))


def embedding_lsh_pairs(df: DataFrame, planes: int, tables: int | None, least: float, *, probes: int | None = None, vec_id: str = "vec_id", embedding: str = "embedding", dim: int = 64, seed: int = 5) -> DataFrame:
    """(a, b, score) of vectors with an exact cosine of ``least`` or more, found by the sides of random planes they stand on.

    Each vector is in one bucket of every table and looks into the buckets beyond the planes it is nearest to, too; :func:`probes_for` tells how many, so that at most
    ``MISSED`` of the pairs at the threshold are missed. Equal vectors meet through their smallest id, so copies cost a row each. Buckets of more than ``BUCKET`` vectors
    are dealt to parts, each of which meets all that look in. A sketch of each vector (its length along ``SKETCH`` axes, and the length left) bounds the cosine of a pair
    where it meets; only pairs within reach are gathered and measured. Vectors of another length than ``dim``, zero ones and such with null, infinite or
    undefined components have no partners.
    """
    tables = TABLES if tables is None else tables
    probes = probes_for(planes, tables, least, dim, seed) if probes is None else probes
    normals = np.random.default_rng(seed).standard_normal((tables * planes, dim))

    axes = np.linalg.qr(np.random.default_rng(seed + 1).standard_normal((dim, min(SKETCH, dim))))[0]

    @F.pandas_udf("struct<all: array<array<long>>, sketch: array<float>>")
    def looks(v: pd.Series) -> pd.DataFrame:
        x = np.array(v.tolist(), dtype=float).reshape(-1, dim)
        x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of any finite vector are finite
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        p = x @ axes
        rest = np.sqrt(np.maximum(0.0, 1 - (p * p).sum(axis=1, keepdims=True)))
        return pd.DataFrame({"all": [list(b) for b in sides(x, normals, tables, planes, probes)], "sketch": list(np.concatenate([p, rest], axis=1).astype(np.float32))})

    df = df.filter((F.size(embedding) == dim) & usable_vector(embedding))
    own = df.groupBy(F.col(embedding).alias("_v")).agg(F.min(vec_id).alias("_id"))
    flat = lambda mark: [F.col("_look.sketch")[i].alias(f"_{mark}{i}") for i in range(axes.shape[1] + 1)]
    looked = own.select("_id", looks("_v").alias("_look")).select("_id", F.posexplode("_look.all").alias("_table", "_all"), "_look").withColumn("_look", F.struct("_look.sketch")).checkpoint()
    keyed = dealt(looked.select("_id", "_table", F.col("_all")[0].alias("_bits"), *flat("y")), ["_table", "_bits"], "_id", BUCKET)
    parts = keyed.filter("_m > 1").select("_table", "_bits", "_m").distinct()  # one row for each ``BUCKET`` vectors of a table at most
    asked = looked.select(F.col("_id").alias("_x"), "_table", F.explode("_all").alias("_bits"), *flat("x")).join(F.broadcast(parts), ["_table", "_bits"], "left").withColumn("_s", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_m"), F.lit(1)) - 1))).drop("_m")
    # what the sketches have in common and the lengths left out bound the cosine, so most pairs end where they meet; sketches have seven digits
    reach = sum((F.col(f"_x{i}").cast("double") * F.col(f"_y{i}") for i in range(axes.shape[1] + 1)), F.lit(0.0))
    met = asked.join(keyed.drop("_m").hint("merge"), ["_table", "_bits", "_s"]).filter((F.col("_x") != F.col("_id")) & (reach >= least - 1e-5)).select(F.least("_x", "_id").alias("a"), F.greatest("_x", "_id").alias("b")).distinct()
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s.cast("double") * t.cast("double")), F.lit(0.0), lambda s, t: s + t)
    joined = met.join(own.select(F.col("_id").alias("a"), F.col("_v").alias("_va")), "a").join(own.select(F.col("_id").alias("b"), F.col("_v").alias("_vb")), "b")
    near = joined.withColumn("score", F.round(dot("_va", "_vb") / F.sqrt(dot("_va", "_va") * dot("_vb", "_vb")), 6)).filter(F.col("score") >= least).select("a", "b", "score")
    same = df.select(F.col(embedding).alias("_v"), F.col(vec_id).alias("b")).join(own, "_v").filter("b <> _id").select(F.col("_id").alias("a"), "b", F.lit(1.0).alias("score"))
    return near.unionByName(same)


def route_matches(matches: DataFrame, cameras: DataFrame, stations: DataFrame, *, camera: str, station: str, cases: DataFrame | None = None, case: str = "case_id", name: str = "name") -> DataFrame:
    """Matches with the camera's position and the nearest station, and with ``cases`` the ``matched_name`` of the case, null where it is not known."""
    near = nearest_k(cameras, stations, 1, id_=camera, place=station).select(camera, station, "km")
    out = matches.join(cameras.select(camera, "lat", "lng"), camera).join(near, camera)
    return out if cases is None else out.join(cases.select(case, F.col(name).alias("matched_name")), case, "left")


def duplicate_share(cases: DataFrame, clusters: DataFrame, *, id_: str, center: str) -> DataFrame:
    """(center, cases, duplicates, share): cases that another case of a smaller id stands for."""
    marked = cases.select(F.col(id_).alias("id"), F.col(center).alias("center")).join(clusters, "id", "left")
    extra = F.coalesce(F.col("cluster") != F.col("id"), F.lit(False)).cast("long")
    return marked.groupBy("center").agg(F.count("*").alias("cases"), F.sum(extra).alias("duplicates"), F.avg(extra.cast("double")).alias("share"))


def person_timeline(cases: DataFrame, person: str, at: str, id_: str) -> DataFrame:
    """Each report's number within its person, and the hours since the one before; ties in time by id."""
    w = Window.partitionBy(person).orderBy(at, id_)
    return cases.withColumn("seen", F.row_number().over(w)).withColumn("hours_since", (F.unix_seconds(F.col(at).cast("timestamp")) - F.unix_seconds(F.lag(at).over(w).cast("timestamp"))) / F.lit(3600.0))
