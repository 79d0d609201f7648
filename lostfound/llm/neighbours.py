"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are split on a bounded sample, every vector is dealt to one leaf of each tree, and a query walks all trees
through one priority queue, the most promising branch of any tree first, until its leaves hold enough candidates. How many are
enough is measured on the sample. Neighbouring leaves of a tree form a block, in which queries meet the vectors of
the leaves that they ask for; each block keeps the best of them by the exact measure, and the best of all blocks are the result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Vectors that the trees are fitted on at most, chosen by a hash of the id.
SAMPLE = 20_000
TREES = 16
#: Vectors that a leaf should hold at least; leaves of a tree at most as long as they hold no more than a block; and at most at all.
LEAF, LEAVES, MOST_LEAVES = 4, 512, 1_024
#: Rows of a block, which one task holds at a time; larger leaves are cut into several blocks.
GROUP = 8_192
#: Share of the sample's own neighbours that the queue must reach, and the rows of the sample that ask for theirs.
RECALL, ASKED = 0.95, 160


class Forest:
    """Nodes of all trees in arrays: normal, offset, children (a leaf is negative: -1 - number). Leaves are numbered from left to right."""

    def __init__(self, sample: np.ndarray, trees: int, leaves: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.dim = sample.shape[1] if len(sample) else 0
        normals, offsets, left, right, self.roots, self.n_leaves = [], [], [], [], [], 0
        for _ in range(trees if len(sample) else 0):
            stack = [(np.arange(len(sample)), leaves, None, 0)]
            while stack:
                rows, want, parent, side = stack.pop()
                split = self._split(sample[rows], rng) if want > 1 and len(rows) > 1 else None
                if split is None:
                    node, self.n_leaves = -1 - self.n_leaves, self.n_leaves + 1
                else:
                    node = len(normals)
                    normal, offset, below = split
                    normals.append(normal), offsets.append(offset), left.append(0), right.append(0)
                    stack += [(rows[~below], want // 2, node, 1), (rows[below], want - want // 2, node, 0)]
                if parent is None:
                    self.roots.append(node)
                else:
                    (right if side else left)[parent] = node
        self.normals, self.offsets = np.array(normals).reshape(-1, self.dim), np.array(offsets)
        self.left, self.right = np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)

    @staticmethod
    def _split(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float, np.ndarray] | None:
        """Normal between two random rows, median offset, and the rows below; None where no try parts the rows."""
        for _ in range(3):
            a, b = rng.choice(len(x), 2, replace=False)
            normal = x[a] - x[b]
            length = np.linalg.norm(normal)
            if length > 1e-9:
                p = x @ (normal / length)
                offset = float(np.median(p))
                below = p < offset
                if below.any():
                    return normal / length, offset, below
        return None

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """(rows x trees): the leaf of each row in each tree."""
        out = np.zeros((len(x), len(self.roots)), dtype=np.int64)
        for k, root in enumerate(self.roots):
            stack = [(root, np.arange(len(x)))]
            while stack:
                node, rows = stack.pop()
                if node < 0 or not len(rows):
                    out[rows, k] = -1 - node
                    continue
                below = x[rows] @ self.normals[node] < self.offsets[node]
                stack += [(self.left[node], rows[below]), (self.right[node], rows[~below])]
        return out

    def probes(self, margins: np.ndarray, sizes: np.ndarray, enough: float) -> list[int]:
        """Leaves for one query by its margins at all nodes, from the shared queue, until they hold ``enough`` vectors. A branch costs the squared margins of the planes crossed on its way."""
        squares, sides = (margins * margins).tolist(), (margins < 0).tolist()
        left, right = self._children()
        heap = [(0.0, root) for root in self.roots]
        heapq.heapify(heap)
        found, held = [], 0
        while heap and held < enough:
            cost, node = heapq.heappop(heap)
            while node >= 0:
                near, far = (left[node], right[node]) if sides[node] else (right[node], left[node])
                heapq.heappush(heap, (cost + squares[node], far))
                node = near
            found.append(-1 - node)
            held += sizes[-1 - node]
        return found

    def _children(self) -> tuple[list[int], list[int]]:
        if not hasattr(self, "_lists"):
            self._lists = self.left.tolist(), self.right.tolist()
        return self._lists

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_lists"}

    def margins(self, x: np.ndarray) -> np.ndarray:
        return x @ self.normals.T - self.offsets

    def share_for(self, sample: np.ndarray, k: int, recall: float, asked: int) -> float:
        """Rows that the leaves of a query must hold, in all trees together and as a share of all rows, to reach ``recall`` of the k nearest within the sample."""
        n = len(sample)
        step = max(1, n // asked)
        at = np.arange(0, n, step)[:asked]
        scores = sample[at] @ sample.T
        scores[np.arange(len(at)), at] = -np.inf
        near = np.argsort(-scores, axis=1)[:, : min(k, n - 1)]
        leaves = self.leaves_of(sample)
        sizes = np.bincount(leaves.ravel(), minlength=self.n_leaves)
        margins = self.margins(sample[at])
        costs, ends = np.zeros((len(self.left), len(at))), np.zeros((self.n_leaves, len(at)))
        for node in range(len(self.left)):  # a parent comes before its children
            for child, crossed in ((self.left[node], margins[:, node] >= 0), (self.right[node], margins[:, node] < 0)):
                (costs if child >= 0 else ends)[child if child >= 0 else -1 - child] = costs[node] + np.where(crossed, margins[:, node] ** 2, 0.0)
        needs = []
        for i in range(len(at)):
            order = np.argsort(ends[:, i], kind="stable")
            held = np.zeros(self.n_leaves)
            held[order] = np.cumsum(sizes[order])
            needs += held[leaves[near[i]]].min(axis=1).tolist()
        return float(np.quantile(needs, recall)) / n if needs else 1.0


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``_id, _v`` of the vectors that take part: not null, finite in every component, not zero."""
    v = F.col(embedding)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.select(F.col(vec_id).cast("long").alias("_id"), v.alias("_v")).filter(F.col("_id").isNotNull() & F.col("_v").isNotNull()).filter(finite.eqNullSafe(True) & F.exists("_v", lambda x: x != 0))


def exact_top(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int) -> pd.DataFrame:
    """The k largest cosines of each query among x in double precision, ties to the smaller id, the query's own row left out.

    A matrix product finds what may be among the best; those are measured again one by one, so equal vectors get equal scores.
    """
    qn, xn = np.sqrt((q * q).sum(axis=1)), np.sqrt((x * x).sum(axis=1))
    scores = (q / qn[:, None]) @ (x / xn[:, None]).T
    scores[q_ids[:, None] == x_ids[None, :]] = -np.inf
    n = min(k, len(x))
    least = -np.partition(-scores, n - 1, axis=1)[:, n - 1] if n < len(x) else scores.min(axis=1, initial=np.inf)
    row, hit = np.nonzero((scores >= least[:, None] - 1e-9) & (scores > -np.inf))
    exact = (x[hit] * q[row]).sum(axis=1) / (xn[hit] * qn[row])
    order = np.lexsort((x_ids[hit], -exact, row))
    row, hit, exact = row[order], hit[order], exact[order]
    first = np.searchsorted(row, np.arange(len(q)))
    best = np.arange(len(row)) - first[row] < k
    return pd.DataFrame({"query_id": q_ids[row[best]].astype(np.int64), "vec_id": x_ids[hit[best]].astype(np.int64), "score": exact[best]})


def search(vectors: DataFrame, is_query, *, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 5, trees: int = TREES, share: float | None = None, recall: float = RECALL, sample: int = SAMPLE, group: int = GROUP, seed: int = 3) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of each row where ``is_query`` (a column of ``vectors``) holds.

    Vectors of another length than the most frequent one take no part, like null, zero and non-finite ones. Of rows that repeat
    an id the one with the smallest vector counts. Equal scores go by the smaller id. A query's own row is no candidate; if all
    candidates are fewer than k, all are returned. Other columns are not read. Without usable rows the result is empty.

    The forest is fitted on at most ``sample`` rows; every row is in the index, once in each tree. A query's leaves hold ``share`` x all
    rows in all trees together; without ``share``, as many as reach ``recall`` of the neighbours within the sample.
    """
    spark = vectors.sparkSession
    own = usable(vectors, vec_id, embedding).groupBy("_id").agg(F.min("_v").alias("_v"))
    queries = vectors.filter(is_query).select(F.col(vec_id).cast("long").alias("_id")).distinct()
    stored = written(own.withColumn("_d", F.size("_v")).join(queries.withColumn("_q", F.lit(True)), "_id", "left").withColumn("_q", F.coalesce("_q", F.lit(False))), "ann-vectors")
    lengths = stored.groupBy("_d").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("_d")).limit(1).collect()
    out = "query_id long, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = lengths[0]["_d"], lengths[0]["n"]
    numbers = np.float32 if dict(vectors.dtypes)[embedding] == "array<float>" else np.float64
    same = stored.filter(F.col("_d") == dim)
    drawn = same.orderBy(F.xxhash64(F.lit(seed), "_id"), "_id").limit(sample).select(F.col("_v").cast("array<double>").alias("v")).toArrow()
    points = drawn["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
    points = points / np.linalg.norm(points, axis=1, keepdims=True)
    leaves = max(1, min(n // LEAF, LEAVES if n <= LEAVES * group else min(MOST_LEAVES, -(-n // group))))
    fitted = Forest(points, trees, leaves, seed)
    share = fitted.share_for(points, k, recall, ASKED) if share is None else share
    forest = spark.sparkContext.broadcast(fitted)

    def unit(v: pd.Series) -> np.ndarray:
        x = np.stack(v.to_numpy()).astype(np.float64)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(forest.value.n_leaves, dtype=np.int64)
        for pdf in batches:
            if len(pdf):
                held += np.bincount(forest.value.leaves_of(unit(pdf["_v"])).ravel(), minlength=len(held))
        yield pd.DataFrame({"_leaf": np.flatnonzero(held), "n": held[held > 0]})

    sizes = np.zeros(fitted.n_leaves, dtype=np.int64)
    for r in same.select("_v").mapInPandas(counted, "_leaf long, n long").groupBy("_leaf").agg(F.sum("n").alias("n")).collect():  # at most a row for each leaf of the fitted forest
        sizes[r["_leaf"]] = r["n"]
    # neighbouring leaves up to ``group`` rows are a block; a larger leaf is a block of its own, in several cuts
    block, at, held = np.zeros(len(sizes), dtype=np.int64), 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > group:
            at, held = at + 1, 0
        block[i], held = at, held + size
    rows = np.bincount(block, weights=sizes, minlength=at + 1)
    known = spark.sparkContext.broadcast((sizes.tolist(), block, np.maximum(1, np.ceil(rows / group)).astype(np.int64)))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, blocks, cuts = known.value
        for pdf in batches:
            if len(pdf):
                own = forest.value.leaves_of(unit(pdf["_v"]))
                data = [np.asarray(v, dtype=numbers).tobytes() for v in pdf["_v"]]
                ids = pdf["_id"].to_numpy()
                mixed = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
                for t in range(own.shape[1]):
                    b = blocks[own[:, t]]
                    yield pd.DataFrame({"_block": b, "_cut": mixed % cuts[b], "_leaf": own[:, t], "_id": ids, "_v": data})

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, blocks, cuts = known.value
        for pdf in batches:
            for lo in range(0, len(pdf), 64):
                part, found = pdf.iloc[lo : lo + 64], []
                for i, v, m in zip(part["_id"], part["_v"], forest.value.margins(unit(part["_v"])), strict=True):
                    asked = np.sort(np.array(forest.value.probes(m, held, max(share * n, 2.0 * k)), dtype=np.int32))
                    own, data = blocks[asked], np.asarray(v, dtype=numbers).tobytes()
                    for mine in np.split(asked, np.flatnonzero(np.diff(own)) + 1):
                        b = int(blocks[mine[0]])
                        found += [(b, c, i, data, mine.tobytes()) for c in range(int(cuts[b]))]
                yield pd.DataFrame(found, columns=["_block", "_cut", "_id", "_v", "_asked"])

    dealt = same.select("_id", "_v").mapInPandas(deal, "_block long, _cut long, _leaf long, _id long, _v binary")
    asked = same.filter("_q").select("_id", "_v").repartition(max(2, spark.sparkContext.defaultParallelism)).mapInPandas(walk, "_block long, _cut long, _id long, _v binary, _asked binary")

    def meet(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        if not len(q) or not len(x):
            return none
        x = x.sort_values("_leaf", kind="stable")
        x_ids, x_leaf = x["_id"].to_numpy(), x["_leaf"].to_numpy()
        xs = np.frombuffer(b"".join(x["_v"]), dtype=numbers).reshape(-1, dim).astype(np.float64)
        q_ids = q["_id"].to_numpy()
        qs = np.frombuffer(b"".join(q["_v"]), dtype=numbers).reshape(-1, dim).astype(np.float64)
        wants = [np.frombuffer(b, dtype=np.int32) for b in q["_asked"]]
        leaf = np.concatenate(wants)
        by_leaf = np.argsort(leaf, kind="stable")
        who, leaf = np.repeat(np.arange(len(q)), [len(w) for w in wants])[by_leaf], leaf[by_leaf]
        edges = np.flatnonzero(np.diff(leaf)) + 1
        parts = []
        for mine, f in zip(np.split(who, edges), leaf[np.concatenate([[0], edges])], strict=True):
            lo, hi = np.searchsorted(x_leaf, f, side="left"), np.searchsorted(x_leaf, f, side="right")
            if hi > lo:
                parts += [exact_top(qs[mine[i : i + 512]], q_ids[mine[i : i + 512]], xs[lo:hi], x_ids[lo:hi], k) for i in range(0, len(mine), 512)]
        if not parts:
            return none
        best = pd.concat(parts).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True], kind="stable").drop_duplicates(["query_id", "vec_id"])
        return best.groupby("query_id", sort=False).head(k)

    near = asked.groupBy("_block", "_cut").cogroup(dealt.groupBy("_block", "_cut")).applyInPandas(meet, out)
    once = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return once.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
