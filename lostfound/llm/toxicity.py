"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes.

All words of the labelled sample are terms, and so are all words of a text that the sample has. Document frequencies are counted
over all documents; a word whose share of toxic rows stands out in the sample (likelihood ratio G) weighs 1 + log(1 + G) times as much.

The examples stand in blocks. Short postings are summed as they are; of the frequent words the index has the largest weight in each block, which
bounds the cosines there. A curve fitted on rows held back turns votes into a probability. The blocks with the largest bounds are measured first, then all others whose bound reaches the k-th best.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_names, labelled_sample

#: Labelled rows of a class that the terms and the examples are taken from at most.
CLASS_ROWS = 4_000
#: Least likelihood ratio (G) of the toxic words that a result names: at 22, one word in 60,000 by chance.
TERM_G = 22.0
#: Neighbours that vote, and the share of examples from which on a word's postings are long: bounded by blocks instead of summed at once.
NEIGHBOURS, COMMON = 15, 0.1
#: Examples in a block, and blocks that are measured first.
BLOCK, FIRST = 32, 3
#: Added to a neighbour's distance before its inverse is its vote; and the weight of the sample's share among the votes.
SOFTEN, PRIOR_VOTES = 0.3, 1.0
#: Parts of the sample that are held back in turn to calibrate the votes, and rows of a class that are scored in each at most.
PARTS, PART_ROWS = 4, 300
WORD = re.compile(r"[^\W\d_]+")


def terms_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if isinstance(text, str) else []


class Index:
    """Unit TF-IDF vectors of examples, as postings by term. The neighbours are exact: no example that may be among them is left out.

    ``idf`` are the terms' whole weights, ``named`` the numbers of those that a result names.
    """

    def __init__(self, terms: list[str], idf: np.ndarray, ids: list[int], vectors: np.ndarray | list[tuple[np.ndarray, np.ndarray]], labels: list[int], named: Iterable[int] = ()) -> None:
        if isinstance(vectors, np.ndarray):
            vectors = [(np.flatnonzero(v), v[np.flatnonzero(v)]) for v in vectors]
        self.terms, self.idf, self.number, self.named = terms, idf, {t: i for i, t in enumerate(terms)}, frozenset(named)
        n, sizes = len(vectors), np.array([len(v[0]) for v in vectors], dtype=np.int64)
        own = np.concatenate([v[0] for v in vectors]).astype(np.int32) if vectors else np.zeros(0, dtype=np.int32)
        weights = np.concatenate([v[1] for v in vectors]).astype(float) if vectors else np.zeros(0)
        # examples that have the same of the most frequent words stand together, so that a block's bounds are close
        frequency = np.bincount(own, minlength=len(terms))
        lead = np.argsort(-frequency, kind="stable")[:24]
        held = np.zeros((n, len(lead)), dtype=bool)
        column = np.full(len(terms), -1)
        column[lead] = np.arange(len(lead))
        row = np.repeat(np.arange(n, dtype=np.int32), sizes)
        leading = np.flatnonzero(column[own] >= 0)
        held[row[leading], column[own[leading]]] = True
        order = np.lexsort(held.T[::-1]) if n else np.zeros(0, dtype=np.int64)
        rank = np.empty(n, dtype=np.int32)
        rank[order] = np.arange(n)
        row = rank[row]
        self.ids, self.labels = np.array(ids, dtype=np.int64)[order], np.array(labels, dtype=float)[order]
        by_term = np.lexsort((row, own))
        self.places, self.weights = row[by_term], weights[by_term]
        self.starts = np.concatenate([[0], np.cumsum(frequency)]).astype(np.int64)
        self.share = self.bare = 0.0
        #: What a vote for each label weighs, and the curve from votes to a probability.
        self.rates, self.curve = np.ones(2), None
        self._rows: tuple | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_rows": None, "number": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = state | {"number": {t: i for i, t in enumerate(state["terms"])}}

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the terms that a text has, and their unit weights (1 + log tf) x idf."""
        tf, number = Counter(terms_of(text)), self.number
        own = np.fromiter((number.get(w, -1) for w in tf), dtype=np.int64, count=len(tf))
        times = np.fromiter(tf.values(), dtype=float, count=len(tf))[own >= 0]
        own = own[own >= 0]
        order = np.argsort(own)
        own, times = own[order], times[order]
        w = (1 + np.log(times)) * self.idf[own]
        return own, w / np.sqrt((w * w).sum()) if len(w) else w

    def _frequent(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(weights of the frequent terms in all examples, their largest weight in each block, row of each term or -1)."""
        if self._rows is None:
            n, starts = len(self.ids), self.starts
            common = np.flatnonzero(np.diff(starts) >= max(1, COMMON * n))
            whole = np.zeros((len(common), n))
            for k, t in enumerate(common):
                whole[k, self.places[starts[t] : starts[t + 1]]] = self.weights[starts[t] : starts[t + 1]]
            at = np.full(len(self.terms), -1)
            at[common] = np.arange(len(common))
            self._rows = whole, np.maximum.reduceat(whole, np.arange(0, n, BLOCK), axis=1) if n else whole, at
        return self._rows

    def cosines(self, asked: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
        """The cosines of vectors (rows) to the examples; of those that can't be among the k nearest some are -inf instead."""
        n, starts = len(self.ids), self.starts
        whole, most, at = self._frequent()
        mine, rare = np.zeros((len(asked), len(whole))), np.zeros((len(asked), n))
        for q, (own, weights) in enumerate(asked):
            own = np.array(own, dtype=np.int64)
            row = at[own]
            mine[q, row[row >= 0]] = weights[row >= 0]
            own, weights = own[row < 0], weights[row < 0]
            size = starts[own + 1] - starts[own]
            if size.sum():
                i = np.repeat(starts[own] - np.cumsum(size) + size, size) + np.arange(size.sum())
                rare[q] = np.bincount(self.places[i], self.weights[i] * np.repeat(weights, size), minlength=n)
        out = np.full((len(asked), n), -np.inf)
        if not n:
            return out
        bounds = np.maximum.reduceat(rare, np.arange(0, n, BLOCK), axis=1) + mine @ most
        first = np.zeros(bounds.shape, dtype=bool)
        np.put_along_axis(first, np.argpartition(-bounds, min(FIRST, bounds.shape[1]) - 1, axis=1)[:, : max(FIRST, -(-k // BLOCK))], True, axis=1)

        def measure(use: np.ndarray) -> None:
            for b in np.flatnonzero(use.any(axis=0)):
                rows, part = np.flatnonzero(use[:, b]), slice(b * BLOCK, (b + 1) * BLOCK)
                out[rows, part] = rare[rows, part] + mine[rows] @ whole[:, part]

        measure(first)
        least = -np.partition(-out, k - 1, axis=1)[:, k - 1] if n > k else np.full(len(asked), -np.inf)
        measure(~first & (bounds >= least[:, None] - 1e-9))
        return out

    def best(self, cosines: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, cosines) of the k largest, ties to the smaller doc_id."""
        least = np.partition(cosines, -k)[-k] - 1e-11 if len(cosines) > k else 0.0
        places = np.flatnonzero((cosines > 0) & (cosines >= least))
        places = places[np.lexsort((self.ids[places], -np.round(cosines[places], 12)))[:k]]
        return places, cosines[places]

    def nearest(self, own: np.ndarray | tuple[int, ...], weights: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """(places, cosines) of the k nearest examples, nearest first, ties to the smaller doc_id."""
        return self.best(self.cosines([(own, weights)], k)[0], k)

    def votes(self, asked: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """(toxic share of the votes, places and cosines of the neighbours) of each vector; without a term the share of the rows without one."""
        out = []
        for (own, _), cosines in zip(asked, self.cosines(asked, k), strict=True):
            places, near = self.best(cosines, k) if len(own) else (np.zeros(0, dtype=np.int64), np.zeros(0))
            votes = 1 / (np.maximum(0, 1 - near) + SOFTEN)
            votes /= votes.max() if len(votes) else 1
            votes *= self.rates[self.labels[places].astype(int)]
            out.append((min(1.0, (float((votes * self.labels[places]).sum()) + PRIOR_VOTES * self.share) / (float(votes.sum()) + PRIOR_VOTES)) if len(own) else self.bare, places, near))
        return out

    def scores(self, texts: list[str | None], k: int = NEIGHBOURS) -> list[tuple[float, list[tuple[int, float, int]], list[str]]]:
        """(score, evidence as (doc_id, cosine, label) of the neighbours, toxic words of the text) of each text."""
        asked = [self.vector(t) for t in texts]
        out = []
        for (own, _), (p, places, near) in zip(asked, self.votes(asked, k), strict=True):
            if len(own) and self.curve is not None:
                p = float(np.interp(p, *self.curve))
            evidence = [(int(self.ids[i]), float(min(1.0, c)), int(self.labels[i])) for i, c in zip(places, near, strict=True)]
            out.append((p, evidence, [self.terms[t] for t in own if t in self.named]))
        return out

    def score(self, text: str | None, k: int = NEIGHBOURS) -> tuple[float, list[tuple[int, float, int]], list[str]]:
        return self.scores([text], k)[0]


def standing_out(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Likelihood ratio (G) of words with a toxic and b other rows of n1 and n0; 0 for those that do not lean to toxic."""
    if not (n1 and n0):
        return np.zeros(len(a))
    p1 = n1 / (n1 + n0)
    part = lambda x, p: np.where(x > 0, x * np.log(np.maximum(x, 1) / np.maximum((a + b) * p, 1e-300)), 0.0)
    return np.where(a * n0 > b * n1, np.maximum(0.0, 2 * (part(a, p1) + part(b, 1 - p1))), 0.0)


class Sample:
    """Labelled rows as numbers of their words, tokenized once: ``rows`` are (doc_id, numbers of terms, 1 + log of their counts, label)."""

    def __init__(self, samples: list[tuple[int, str, int]], frequency: dict[str, int], n_docs: int) -> None:
        number: dict[str, int] = {}
        self.rows = []
        for i, text, y in samples:
            tf = Counter(terms_of(text))
            own = np.fromiter((number.setdefault(w, len(number)) for w in tf), dtype=np.int32, count=len(tf))
            self.rows.append((i, own, 1 + np.log(np.fromiter(tf.values(), dtype=np.float32, count=len(tf))), y))
        self.terms = sorted(number)
        rank = np.empty(len(number), dtype=np.int32)
        rank[np.fromiter((number[t] for t in self.terms), dtype=np.int64, count=len(number))] = np.arange(len(number), dtype=np.int32)
        for k, (i, own, times, y) in enumerate(self.rows):
            own = rank[own]
            order = np.argsort(own)
            self.rows[k] = (i, own[order], times[order], y)
        self.idf = np.log((n_docs + 1) / (np.array([frequency.get(t, 0) for t in self.terms], dtype=float) + 1)) + 1

    def index(self, shares: dict[int, int], use: Iterable[int] | None = None) -> Index:
        """The index of the rows, or of those at the places ``use``."""
        rows = self.rows if use is None else [self.rows[i] for i in use]
        seen = Counter(r[3] for r in rows)
        of = lambda y: np.bincount(np.concatenate([r[1] for r in rows if r[3] == y] or [np.zeros(0, dtype=np.int32)]), minlength=len(self.terms)).astype(float)
        a, b = of(1), of(0)
        g = standing_out(a, b, seen[1], seen[0])
        # words of rows that are left out are no terms
        weights, named = self.idf * (1 + np.log1p(g)) * (a + b > 0), np.flatnonzero(g >= TERM_G).tolist()
        n = sum(shares.values())
        prior = shares.get(1, 0) / n if n else 0.0
        kept = [r for r in rows if len(r[1])]
        built = Index(self.terms, weights, [r[0] for r in kept], [(r[1], unit(r[2] * weights[r[1]])) for r in kept], [r[3] for r in kept], named)
        # rows of a class in the sample stand for so many rows of the table
        weight = {y: shares.get(y, 0) / seen[y] for y in seen}
        mass = lambda rs: (sum(weight[r[3]] for r in rs if r[3]), sum(weight[r[3]] for r in rs))
        one, all_ = mass([r for r in rows if not len(r[1])])
        built.bare = one / all_ if all_ else prior
        one, all_ = mass(kept)
        built.share = one / all_ if all_ else prior
        built.rates = np.array([weight.get(y, 1.0) for y in (0, 1)]) / max([*weight.values(), 1e-12])
        return built


def unit(w: np.ndarray) -> np.ndarray:
    return w / np.sqrt((w * w).sum()) if len(w) else w


def build(samples: list[tuple[int, str, int]], frequency: dict[str, int], n_docs: int, shares: dict[int, int]) -> Index:
    """The index of labelled (doc_id, text, label) samples. Of a class with fewer rows in the sample than in the table each votes for as many as it stands for."""
    return Sample(samples, frequency, n_docs).index(shares)


def rising(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and heights of the rising curve nearest to the weighted points (pool adjacent violators), drawn a little towards their mean, from 0 to 1."""
    mean = float((y * w).sum() / w.sum())
    blocks: list[list[float]] = []
    for i in np.lexsort((y, x)):
        blocks.append([x[i] * w[i], y[i] * w[i], w[i]])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    sx, sy, sw = np.array(blocks).T
    heights = np.maximum.accumulate((sy + mean) / (sw + 1))
    return np.concatenate([[0.0], sx / sw, [1.0]]), np.concatenate([[heights[0] / 2], heights, [(1 + heights[-1]) / 2]])


def calibration(sample: Sample, shares: dict[int, int]) -> tuple[np.ndarray, np.ndarray] | None:
    """The curve from votes to a probability: parts of the sample are held back in turn, and their rows scored by an index of the others. None if a class is missing."""
    part = np.array([zlib.crc32(f"part {r[0]}".encode()) % PARTS for r in sample.rows])
    label = np.array([r[3] for r in sample.rows])
    votes, labels = [], []
    for p in range(PARTS):
        own = np.concatenate([np.flatnonzero((part == p) & (label == y))[:PART_ROWS] for y in (0, 1)])
        if len(own) and len(set(label[part != p])) == 2:
            index = sample.index(shares, np.flatnonzero(part != p))
            asked = []
            for _, terms, times, _ in (sample.rows[i] for i in own):
                known = index.idf[terms] > 0
                asked.append((terms[known].astype(np.int64), unit(times[known] * index.idf[terms[known]])))
            votes += [v for lo in range(0, len(asked), 128) for v, _, _ in index.votes(asked[lo : lo + 128])]
            labels += label[own].tolist()
            del index
    if len(set(labels)) < 2:
        return None
    scored = Counter(labels)
    w = np.array([shares.get(y, scored[y]) / scored[y] for y in labels])
    return rising(np.array(votes), np.array(labels, dtype=float), w * len(labels) / w.sum())


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", folds: int = 5, class_rows: int = CLASS_ROWS) -> Index:
    """Learns from rows with a label outside fold 0, at most ``class_rows`` of each class; document frequencies of their words are counted over all documents.

    The words of the sample reach the driver.
    """
    sample, shares = labelled_sample(docs, labels, label, doc_id=doc_id, text=text, folds=folds, class_rows=class_rows)

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(i, y, " ".join(terms_of(t))) for i, t, y in zip(pdf["_id"], pdf["_t"], pdf["_y"], strict=True)], columns=["id", "y", "t"])

    drawn = sample.mapInPandas(words, "id long, y int, t string").orderBy("id", "t").toArrow()
    rows = list(zip(*(drawn[c].to_pylist() for c in ("id", "t", "y")), strict=True))
    del drawn
    wanted = docs.sparkSession.sparkContext.broadcast(frozenset(w for _, t, _ in rows for w in t.split(" ") if w))

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()
        for pdf in batches:
            found[""] += len(pdf)
            for t in pdf["_t"]:
                found.update(wanted.value.intersection(terms_of(t)))
        yield pd.DataFrame(list(found.items()), columns=["term", "n"])

    counts = docs.select(F.col(text).alias("_t")).mapInPandas(frequencies, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    frequency = dict(zip(counts["term"].to_pylist(), counts["n"].to_pylist(), strict=True))
    del counts
    wanted.unpersist()
    tokenized = Sample(rows, frequency, frequency.get("", 0))
    del rows, frequency
    curve = calibration(tokenized, shares)
    index = tokenized.index(shares)
    index.curve = curve
    return index


def score(docs: DataFrame, index: Index, *, doc_id: str = "doc_id", text: str = "text", cut: float = 0.5, neighbours: int = NEIGHBOURS) -> DataFrame:
    """``docs`` with ``score``, ``predicted`` (1 where score >= cut), ``evidence`` (neighbours with doc_id, cosine and label) and ``terms`` (its toxic words), in one pass without a shuffle.

    Null and empty texts, like all texts without a word of the sample, get the toxic share of the labelled rows without one. A text of
    any length is read as a whole. Neighbours of equal cosine go by the smaller doc_id. The score depends on the text alone, so rows that
    repeat a text get the same; the evidence leaves out the row's own doc_id. All other columns are kept, those of the four names replaced; an
    empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(index)

    @F.pandas_udf("score double, evidence array<struct<doc_id: long, cosine: double, label: int>>, terms array<string>")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in texts:
            found = [f for lo in range(0, len(t), 128) for f in sent.value.scores(t.iloc[lo : lo + 128].tolist(), neighbours)]
            yield pd.DataFrame({"score": [f[0] for f in found], "evidence": [[{"doc_id": i, "cosine": c, "label": y} for i, c, y in f[1]] for f in found], "terms": [f[2] for f in found]})

    (found,) = fresh_names(docs, "found")
    got = docs.withColumn(found, scored(F.col(text)))
    others = F.filter(F.col(f"{found}.evidence"), lambda e: ~e["doc_id"].eqNullSafe(F.col(doc_id).cast("long")))
    return got.withColumns({"score": F.col(f"{found}.score"), "predicted": (F.col(f"{found}.score") >= cut).cast("int"), "evidence": others, "terms": F.col(f"{found}.terms")}).drop(found)
