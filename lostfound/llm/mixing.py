"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact size per source. Whole passes over a source come first; what remains of its
target is fitted on the counts alone: an equal share of each size, then bounded-knapsack dynamic programming
over the counts left. The chosen number of documents of each size is then taken by seeded rank.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import count_words, rank_within, written

#: Words that the dynamic programming covers at least, sizes of the largest document that it covers, and sums that it holds at most.
DP_WORDS, DP_SIZES, DP_SUMS = 1 << 16, 8, 1 << 26


def subset_sum(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each size to take so that their sum is the largest up to ``budget``: bounded knapsack by dynamic programming.

    Counts are split into powers of two. Sums are marked with the item that first reached them, so the way back uses each item once. With a
    budget above ``DP_SUMS`` sums are counted in coarser units, rounded up, and the sum may stay below the best by one unit a document.
    """
    take = np.zeros(len(sizes), dtype=np.int64)
    use = [i for i in np.argsort(-sizes, kind="stable") if 0 < sizes[i] <= budget and counts[i] > 0]
    if not use:
        return take
    unit = max(int(np.gcd.reduce(sizes[use])), -(-budget // DP_SUMS))
    goal = budget // unit
    items: list[tuple[int, int, int]] = []
    for i in use:
        size = -(-int(sizes[i]) // unit)
        left, k = min(int(counts[i]), goal // size), 1
        while left > 0:
            n = min(k, left)
            items.append((size * n, int(i), n))
            left, k = left - n, k * 2
    reached = np.zeros(goal + 1, dtype=bool)
    reached[0] = True
    first = np.full(goal + 1, -1, dtype=np.int32)
    top = 0
    for j, (w, _, _) in enumerate(items):
        if w <= goal:
            lo = min(goal, top + w)
            new = np.flatnonzero(reached[: lo + 1 - w] & ~reached[w : lo + 1]) + w
            reached[new] = True
            first[new] = j
            top = max(top, int(new[-1]) if len(new) else 0)
            if top == goal:
                break
    at = top
    while at > 0:
        w, i, n = items[first[at]]
        take[i] += n
        at -= w
    return take


def fit_counts(sizes: np.ndarray, counts: np.ndarray, budget: int, window: int = DP_WORDS) -> np.ndarray:
    """How many documents of each size to take (at most ``counts``) so that their sum comes as near below ``budget`` as it can.

    The first takes are the same share of every size, so the mix keeps the lengths of its source. They are then opened again, from the
    largest size down, until the budget left is a window: ``window`` words, or ``DP_SIZES`` of the largest document if that is more. Over it all
    counts left are fitted exactly. If that misses a budget up to the window, it is fitted exactly as a whole.
    """
    sizes, counts = np.asarray(sizes, dtype=np.int64), np.asarray(counts, dtype=np.int64)
    take = np.zeros(len(sizes), dtype=np.int64)
    total = int((sizes * counts).sum())
    if budget <= 0 or total <= 0:
        return take
    if budget >= total:
        return counts.copy()
    window = max(window, DP_SIZES * int(sizes[counts > 0].max()))
    take[:] = (counts.astype(object) * budget // total).astype(np.int64)
    take[sizes <= 0] = 0
    rest = budget - int((sizes * take).sum())
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        if size > 0 and rest > window:  # whole documents of this size while more than half a window stays open
            n = min(int(counts[i] - take[i]), (rest - window // 2) // size)
        elif size > 0 and rest < window // 2:
            n = -min(int(take[i]), -(-(window // 2 - rest) // size))
        else:
            continue
        take[i] += n
        rest -= n * size
    take += subset_sum(sizes, counts - take, rest)
    return take if budget > window or int((sizes * take).sum()) == budget else subset_sum(sizes, counts, budget)


def targets(sized: DataFrame, weights: tuple[float, ...], share: float, max_repeats: int) -> DataFrame:
    """(_src, source_size, target) per source: ``share`` of all words dealt by weight, no source above ``max_repeats`` times its own words.

    The excess of full sources goes to the others by weight. With sources ordered by how soon they fill up, the
    common level of the others after the first k are full is largest at the true k, so one pass of windows
    finds it. The table has a row per source.
    """
    per = sized.groupBy("_src").agg(F.sum("_size").alias("source_size"))
    i = F.row_number().over(Window.orderBy("_src")) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(i, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("_w", w).withColumn("_cap", F.lit(float(max_repeats)) * F.col("source_size"))
    up = Window.orderBy(F.col("_cap") / F.col("_w"), "_src")
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.lit(float(share)) * F.sum("source_size").over(everything)
    filled = F.coalesce(F.sum("_cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (budget - filled) / F.sum("_w").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return per.withColumn("_level", level).withColumn("target", F.least("_cap", F.col("_w") * F.max("_level").over(everything))).select("_src", "source_size", "target")


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, max_repeats: int = 2, seed: int = 17) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, repeats, taken``.

    ``size`` is the number of words, ``repeats`` how often the mix takes the document, ``taken`` = size x repeats.
    A null or empty text has size 0 and is never taken; a null source is a source of its own, last in order. Ties and
    repeated rows count one by one; equal rows are interchangeable, so reruns give the same rows. An empty table gives no rows.
    Other columns are not read.
    """
    key = F.coalesce(F.concat(F.lit("a"), F.col(source)), F.lit("b"))
    sized = written(docs.select(F.col(doc_id).alias("doc_id"), key.alias("_src"), count_words(F.col(text)).alias("_size")), "mix-sizes")
    goals = targets(sized, weights, share, max_repeats)
    counts = sized.groupBy("_src", "_size").agg(F.count("*").alias("_n")).join(goals, "_src")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        own = int(pdf["source_size"].iloc[0])
        passes = min(max_repeats, int(pdf["target"].iloc[0] // own)) if own else 0
        rest = 0 if passes >= max_repeats else int(round(pdf["target"].iloc[0] - passes * own))
        pdf = pdf.sort_values("_size", kind="stable")
        extra = fit_counts(pdf["_size"].to_numpy(), pdf["_n"].to_numpy(), rest)
        return pdf[["_src", "_size", "source_size", "target"]].assign(_passes=passes, _extra=extra)

    picks = counts.groupBy("_src").applyInPandas(choose, "_src string, _size long, source_size long, target double, _passes long, _extra long")
    ranked = rank_within(sized, ["_src", "_size"], ["doc_id"], seed)
    repeats = F.when(F.col("_size") > 0, F.col("_passes") + (F.col("_rank") < F.col("_extra")).cast("long")).otherwise(F.lit(0).cast("long"))
    return ranked.join(picks, ["_src", "_size"]).select("doc_id", F.col("_size").alias("size"), "source_size", "target", repeats.alias("repeats"), (repeats * F.col("_size")).alias("taken"))
