"""Near-duplicates by HyperMinHash: banded registers, estimated similarity, then verification on full shingle sets.

Each shingle is hashed once. The hash picks a register, whose content is the smallest rest of the hash seen there, kept as a
count of leading zeros and a few mantissa bits. Empty registers of short texts borrow from full ones in a fixed order.
Equal sets meet first and go on as one. Each band of registers is a key; the members of a key are compared with a head, the
one that shares most keys, and then only across groups that are not yet linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORDS, forget, tidied, written

#: Registers by band and bands: at similarity 0.8 a pair shares no band with probability 3e-6.
ROWS, BANDS = 5, 32
REGISTERS = ROWS * BANDS
#: Mantissa bits of a register; the leading zeros take the 6 bits above.
MANTISSA = 10
#: Estimates under the threshold less this margin (some five standard errors of the estimate) are not verified.
MARGIN = 0.18
_LOWER = {c: c + 32 for c in range(65, 91)}


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of ``size`` words, A-Z in lower case; of all words as one if there are fewer."""
    if not isinstance(text, str):
        return np.zeros(0, dtype=np.uint64)
    words = WORDS.findall(text.translate(_LOWER))
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(" ".join(words))], dtype=np.uint64)
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, number), dtype=np.uint64, count=len(number))[ids]
    h = np.zeros(len(words) - size + 1, dtype=np.uint64)
    for k in range(size):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + own[k : k + len(h)]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(h ^ (h >> np.uint64(32)))


def registers(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of a set: 16 bits each, leading zeros of the smallest rest and its next ``MANTISSA`` bits."""
    out = np.full(REGISTERS, 0xFFFF, dtype=np.uint16)
    if not len(hashes):
        return out
    mixed = (hashes ^ (hashes >> np.uint64(33))) * np.uint64(0xC2B2AE3D27D4EB4F)
    which = ((mixed >> np.uint64(40)) % np.uint64(REGISTERS)).astype(np.int64)
    rest = ((hashes ^ (hashes >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)) ^ (mixed >> np.uint64(32))
    smallest = np.full(REGISTERS, np.iinfo(np.uint64).max, dtype=np.uint64)
    np.minimum.at(smallest, which, rest)
    full = np.flatnonzero(np.bincount(which, minlength=REGISTERS))
    r = np.maximum(smallest[full], np.uint64(1))
    zeros = np.minimum(63 - np.floor(np.log2(r.astype(np.float64))).astype(np.int64), 62).clip(0)
    after = np.left_shift(r, (zeros + 1).clip(0, 63).astype(np.uint64))
    out[full] = ((zeros.astype(np.uint64) << np.uint64(MANTISSA)) | (after >> np.uint64(64 - MANTISSA))).astype(np.uint16)
    if len(full) < REGISTERS:
        taken = np.zeros(REGISTERS, dtype=bool)
        taken[full] = True
        order = _ORDER[~taken]
        out[~taken] = out[order[np.arange(len(order)), taken[order].argmax(axis=1)]]
    return out


#: Where an empty register looks for a full one: a fixed shuffled order for each.
_ORDER = np.array([np.random.default_rng(1000 + i).permutation(REGISTERS) for i in range(REGISTERS)])


def estimate(a: np.ndarray, b: np.ndarray, n: int, m: int) -> float:
    """Similarity from the share of equal registers, corrected for those that agree by chance.

    Two unrelated minima agree if they have the same leading zeros (probability 1/3 over all counts) and mantissa (2 ** -MANTISSA).
    """
    chance = 2.0**-MANTISSA / 3
    share = float((a == b).mean())
    return max(0.0, min((share - chance) / (1 - chance), min(n, m) / max(n, m)))


def sketches(docs: DataFrame, *, doc_id: str, text: str, size: int) -> DataFrame:
    """(_id, _n, _key, _reg): id, number of shingles, a 128-bit key of the set and its registers; key and registers are null without words."""

    def sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(len(h), xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None, registers(h).tobytes() if len(h) else None) for h in (shingle_hashes(t, size) for t in pdf["_t"])]
            out = pd.DataFrame(rows, columns=["_n", "_key", "_reg"])
            out.insert(0, "_id", pdf["_id"].astype("Int64").to_numpy())
            yield out

    return docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_t")).mapInPandas(tidied(sketched), "_id long, _n long, _key binary, _reg binary")


def components(links: DataFrame) -> DataFrame:
    """(_id, _label): the smallest id that each linked node reaches. ``links`` has (a, b), a < b.

    Links are turned towards the smallest neighbour, large ones first and then small ones, until nothing changes; each round
    is stored. The rounds grow with the logarithm of a component's size; no task sees a component as a whole.
    """
    edges = written(links.select("a", "b").distinct(), "cc-links")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b"), F.col("m").alias("a")).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        least2 = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least2, "b")
        turned = small.filter("a <> m").select(F.least("a", "m").alias("a"), F.greatest("a", "m").alias("b")).unionByName(least2.select(F.col("m").alias("a"), "b")).distinct()
        new = written(turned, "cc-links")
        forget(edges)
        # done when every node has one link and no target has a smaller one itself
        ends = new.select(F.explode(F.array(F.struct(F.col("b").alias("x"), F.lit(1).alias("up")), F.struct(F.col("a").alias("x"), F.lit(0).alias("up")))).alias("e")).select("e.*")
        open_ = ends.groupBy("x").agg(F.sum("up").alias("n"), F.min("up").alias("least")).filter("n > 1 or n = 1 and least = 0").limit(1).count()
        edges = new
        if not open_:
            break
    return edges.select(F.col("b").alias("_id"), F.col("a").alias("_label"))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked if 100 x shared shingles >= percent x all shingles of both; ``component_id`` is the smallest doc_id
    reachable and ``kept`` marks the document that has it. Without words or text a document has no shingles and stands alone. Rows that
    repeat an id are one document for the links and are all returned (of different texts of an id, one is compared with others and each with equal sets); ties are equal sets and always linked. A null id is in no
    component: its component_id is null and it is kept. An empty table gives no rows; other columns are not read.
    """
    all_ = written(sketches(docs, doc_id=doc_id, text=text, size=size), "mh-sketches")
    named = all_.filter(F.col("_id").isNotNull() & F.col("_key").isNotNull())
    # equal sets: the smallest id stands for all
    first = written(named.groupBy("_key").agg(F.min(F.struct("_id", "_n", "_reg")).alias("_f")).select("_key", "_f.*"), "mh-first")
    texts = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_t"))
    # stored, so that the pairs of a head that meets very many can be dealt to several tasks; of an id with several texts the smallest key counts
    reps = written(first.groupBy("_id").agg(F.min(F.struct("_key", "_n", "_reg")).alias("_f")).select("_id", "_f.*"), "mh-reps")
    links = linked(reps, texts, size, percent)
    forget(reps)
    same = named.select("_id", "_key").join(first.select("_key", F.col("_id").alias("_rep")), "_key").filter(F.col("_id") > F.col("_rep")).select(F.col("_rep").alias("a"), F.col("_id").alias("b"))
    labels = components(links.unionByName(same))
    label = F.coalesce(F.col("_label"), F.col("_id"))
    return all_.select("_id", "_n").join(labels, "_id", "left").select(F.col("_id").alias("doc_id"), F.col("_n").alias("n_shingles"), label.alias("component_id"), F.coalesce(label == F.col("_id"), F.lit(True)).alias("kept"))


#: Rounds in which the members of a key meet one head each, before all that are still apart meet.
HEADS = 2


def linked(reps: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Verified links (a, b), a < b, that join all linked sketches (_id, _n, _reg) into their components.

    In each of the first rounds the members of a band key meet one head: the member that shares most keys with others, from a
    component that no earlier head of the key was in. At last the members of a key meet that are still in different components, by
    what sets them apart from the first head (``open_pairs``).
    """
    bands = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.substring(F.col("_reg"), i * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    keys = reps.select("_id", "_n", bands.alias("_band", "_bits")).select("_id", "_n", F.xxhash64("_band", "_bits").alias("_k"))
    shared = keys.groupBy("_k").agg(F.count("*").alias("_m")).filter("_m > 1")
    both = written(keys.join(shared, "_k"), "mh-met")
    popular = both.groupBy("_id").agg(F.sum("_m").alias("_p"))
    met = written(both.join(popular, "_id"), "mh-met")
    forget(both)
    # only texts that share a key are shuffled on to full sets, once for all rounds
    wanted = reps.select("_id", "_key").join(met.select("_id").distinct(), "_id", "left_semi")
    full = written(texts.join(wanted, "_id").mapInPandas(tidied(_full_sets(size)), "_id long, _set binary").dropDuplicates(["_id"]), "mh-full")
    near = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    links = known = used = first_heads = None
    for _ in range(HEADS):
        labels = components(links) if links is not None else None
        own = met.join(labels, "_id", "left").withColumn("_label", F.coalesce("_label", "_id")) if labels is not None else met.withColumn("_label", F.col("_id"))
        free = own if used is None else own.join(used.join(labels.withColumnRenamed("_id", "_h"), "_h", "left").select("_k", F.coalesce("_label", "_h").alias("_label")).distinct(), ["_k", "_label"], "left_anti")
        heads = free.groupBy("_k").agg(F.max(F.struct("_p", (-F.col("_id")).alias("_i"), "_n", "_label")).alias("_x")).select("_k", (-F.col("_x._i")).alias("_h"), F.col("_x._n").alias("_hn"), F.col("_x._label").alias("_hl"))
        heads = written(heads, "mh-heads")
        pairs = own.join(heads, "_k").filter((F.col("_label") != F.col("_hl")) & near(F.col("_n"), F.col("_hn"))).select(F.least("_h", "_id").alias("a"), F.greatest("_h", "_id").alias("b")).distinct()
        pairs = pairs if known is None else pairs.join(known.select("a", "b"), ["a", "b"], "left_anti")
        new = written(verified(pairs, reps, full, percent), "mh-known")
        known = new if known is None else known.unionByName(new)
        first_heads = heads.select("_k", "_h") if first_heads is None else first_heads
        used = heads.select("_k", "_h") if used is None else used.unionByName(heads.select("_k", "_h"))
        links = known.filter("linked").select("a", "b")
    labels = components(links)
    own = met.filter("_m > 2").join(labels, "_id", "left").withColumn("_label", F.coalesce("_label", "_id"))
    mixed = own.groupBy("_k").agg(F.min("_label").alias("lo"), F.max("_label").alias("hi")).filter("lo <> hi").select("_k")
    members = own.join(mixed, "_k", "left_semi").join(first_heads, "_k").select("_h", "_id", "_label").distinct()
    rest = open_pairs(members, full, percent).join(known.select("a", "b"), ["a", "b"], "left_anti")
    out = written(links.unionByName(verified(rest, reps, full, percent).filter("linked").select("a", "b")), "mh-links")
    forget(met, full)
    return out


def open_pairs(members: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b: pairs of members (_h, _id, _label) of one head in different components whose sets may be near enough.

    The symmetric difference of two sets is that of their differences from the head. With n elements, d of them and of the
    head's in the difference, and c = (100 - percent) / (100 + percent), a link of x and y needs dx + dy - 2 x shared <= c (nx + ny): the
    excesses d - c n of both, added and halved, are the least number of shared difference elements. A sum of zero or less is
    a link of both with the head, found before. For all others an element must be shared early enough in an order from rare
    to frequent that the rest can still hold that number, so members that differ from the head each in its own way do not meet.
    """
    own, off = 100 + percent, 100 - percent

    def differ(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for h, i, label, sh, sx in zip(pdf["_h"], pdf["_id"], pdf["_label"], pdf["sh"], pdf["sx"], strict=True):
                sh, sx = np.frombuffer(sh, dtype=np.int64), np.frombuffer(sx, dtype=np.int64)
                d = np.setxor1d(sh, sx, assume_unique=True)
                out.append((h, i, label, len(sx), own * len(d) - off * len(sx), -off * len(sh), d))
            yield pd.DataFrame(out, columns=["_h", "_id", "_label", "_n", "_w", "_hw", "_all"])

    both = members.join(full.select(F.col("_id").alias("_h"), F.col("_set").alias("sh")), "_h").join(full.select("_id", F.col("_set").alias("sx")), "_id")
    apart = written(both.mapInPandas(tidied(differ), "_h long, _id long, _label long, _n long, _w long, _hw long, _all array<long>"), "mh-apart")
    apart = apart.withColumn("_e", F.explode("_all")).drop("_all")
    often = apart.groupBy("_h", "_e").agg(F.count("*").alias("_f")).filter("_f > 1")
    place = (F.row_number().over(Window.partitionBy("_h", "_id").orderBy("_f", "_e")) - 1).cast("long")
    # elements of one member only come first in the order and meet nobody: they are counted, not sorted
    shared = apart.join(often, ["_h", "_e"]).withColumn("_r", place).withColumn("_s", F.count("*").over(Window.partitionBy("_h", "_id")))
    left = F.col("_s") - F.col("_r")
    kept = written(shared.withColumn("_left", left).filter(2 * own * F.col("_left") >= F.col("_w") + F.col("_hw")).select("_h", "_e", "_id", "_label", "_n", "_w", "_left"), "mh-shared")
    x, y = kept.filter("_w > 0").alias("x"), kept.alias("y")
    near = 100 * F.least("x._n", "y._n") >= percent * F.greatest("x._n", "y._n")
    once = (F.col("y._w") <= 0) | (F.col("x._id") < F.col("y._id"))
    enough = F.col("x._w") + F.col("y._w") <= 2 * own * F.least("x._left", "y._left")
    met = x.join(y, (F.col("x._h") == F.col("y._h")) & (F.col("x._e") == F.col("y._e")) & (F.col("x._label") != F.col("y._label")) & near & once & enough)
    return met.select(F.least("x._id", "y._id").alias("a"), F.greatest("x._id", "y._id").alias("b")).distinct()


def _full_sets(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 512):
                sets = [(i, k, shingle_hashes(t, size).tobytes()) for i, k, t in pdf.iloc[lo : lo + 512][["_id", "_key", "_t"]].itertuples(index=False)]
                yield pd.DataFrame([(i, x) for i, k, x in sets if xxhash.xxh3_128_digest(x) == k], columns=["_id", "_set"])

    return run


def verified(pairs: DataFrame, reps: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """(a, b, similarity, linked) of candidate pairs whose estimate is near enough: exact, on the full sets."""

    def likely(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = [estimate(np.frombuffer(x, dtype=np.uint16), np.frombuffer(y, dtype=np.uint16), n, m) >= percent / 100 - MARGIN for x, y, n, m in zip(pdf["ra"], pdf["rb"], pdf["na"], pdf["nb"], strict=True)]
            yield pdf.loc[ok, ["a", "b"]]

    left = reps.select(F.col("_id").alias("a"), F.col("_n").alias("na"), F.col("_reg").alias("ra"))
    right = reps.select(F.col("_id").alias("b"), F.col("_n").alias("nb"), F.col("_reg").alias("rb"))
    wanted = written(pairs.join(left, "a").join(right, "b").mapInPandas(tidied(likely), "a long, b long"), "mh-likely")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for a, b, x, y in zip(pdf["a"], pdf["b"], pdf["sa"], pdf["sb"], strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                union = len(x) + len(y) - shared
                out.append((a, b, shared / union, 100 * shared >= percent * union))
            yield pd.DataFrame(out, columns=["a", "b", "similarity", "linked"])

    sa, sb = full.select(F.col("_id").alias("a"), F.col("_set").alias("sa")), full.select(F.col("_id").alias("b"), F.col("_set").alias("sb"))
    return wanted.join(sa, "a").join(sb, "b").mapInPandas(tidied(compare), "a long, b long, similarity double, linked boolean")
