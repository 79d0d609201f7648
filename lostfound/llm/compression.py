"""Quality by compression: which of two zstandard dictionaries, of good and of bad text, fits a document better.

Texts are cut into blocks of about ``BLOCK`` bytes, so a long text is judged by all of it and not by its own repeats.
Each block is compressed with both dictionaries; a document's figures are (bad size - good size) / (bad size + good
size) over all its blocks, and both sizes a byte of text. The difference says little of a text that repeats one word, which is small
with either dictionary; the sizes show it. A logistic curve over the three, fitted on whole labelled texts that no dictionary
has seen, turns them into a score. README has the figures with the difference alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, labelled_sample, written

#: Bytes of a block.
BLOCK = 1024
#: Labelled rows of a class that the dictionaries are made from, and as many more for the calibration.
CLASS_ROWS = 1500
#: Pieces of ``BLOCK`` characters, dealt evenly over the text, that a labelled row gives to a dictionary at most.
ROW_BLOCKS = 6
DICTIONARY_BYTES = 112 * 1024
LEVEL = 3


def blocks(text: str, size: int = BLOCK) -> list[bytes]:
    """The whole text in blocks; the last holds what is left, and joins the one before if it is under half a block."""
    data = text.encode("utf-8", "surrogatepass")
    n = max(1, round(len(data) / size))
    step = -(-len(data) // n) if data else 1
    return [data[i : i + step] for i in range(0, len(data), step)]


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary, with entropy tables; too few samples to train on stand in a row as they are."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:] or b" " * 8


class Model:
    """Two dictionaries and the curve; small, and sent to tasks as it is."""

    def __init__(self, good: bytes, bad: bytes, level: int = LEVEL) -> None:
        self.good, self.bad, self.level = good, bad, level
        self.slope, self.shift = np.zeros(3), 0.0
        self.empty = 0.5
        self._c: tuple | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_c": None}

    def sizes(self, text: str) -> tuple[int, int, int]:
        """Bytes of the whole text, and compressed with the good and with the bad dictionary."""
        if self._c is None:
            self._c = tuple(zstandard.ZstdCompressor(level=self.level, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in (self.good, self.bad))
        parts = blocks(text)
        g, b = self._c
        return sum(map(len, parts)), sum(len(g.compress(p)) for p in parts), sum(len(b.compress(p)) for p in parts)

    def figures(self, text: str | None) -> tuple[float, float, float] | None:
        """The normalised difference, and both sizes a byte of text (a text of one repeated word is small with either); None for a blank text."""
        if not isinstance(text, str) or not text.strip():
            return None
        own, good, bad = self.sizes(text)
        return (bad - good) / (bad + good), good / own, bad / own

    def score(self, text: str | None) -> float:
        x = self.figures(text)
        return self.empty if x is None else float(1 / (1 + np.exp(-np.clip(np.dot(x, self.slope) + self.shift, -30, 30))))


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 100, ridge: float = 1e-2) -> tuple[np.ndarray, float]:
    """Slopes and intercept by Newton steps, with columns scaled first."""
    m, s = x.mean(axis=0), x.std(axis=0)
    s = np.where(s > 0, s, 1.0)
    z = np.column_stack([(x - m) / s, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w[:-1] / s, float(w[-1] - (w[:-1] * m / s).sum())


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", doc_id: str = "doc_id", text: str = "text", folds: int = 5, class_rows: int = CLASS_ROWS, dictionary_bytes: int = DICTIONARY_BYTES) -> Model:
    """Learns from rows with a label outside fold 0, at most 2 x ``class_rows`` of each class, chosen by a hash of the text.

    One half of them goes to the dictionaries, ``ROW_BLOCKS`` pieces of a row, so what reaches the driver is bounded by 4 x class_rows x ROW_BLOCKS x
    BLOCK characters. The other half calibrates: its whole texts are compressed in tasks, and three figures of each are returned. Without rows of
    both classes every score is the share of good rows (0.5 without any). Of an id with several labels the smallest counts; equal
    texts are learned once.
    """
    drawn, shares = labelled_sample(docs, labels, label, doc_id=doc_id, text=text, folds=folds, class_rows=2 * class_rows)
    sample = written(drawn.withColumn("_half", F.pmod(F.xxhash64(F.lit(23), "_t"), F.lit(2)).cast("int")), "labelled-texts")
    n, step = F.length("_t"), (F.length("_t") - BLOCK) / (ROW_BLOCKS - 1)
    pieces = F.concat(*[F.substring(F.col("_t"), (i * step + 1).cast("int"), F.lit(BLOCK)) for i in range(ROW_BLOCKS)])
    rows = sample.filter("_half = 0").select("_id", "_y", F.when(n <= ROW_BLOCKS * BLOCK, F.col("_t")).otherwise(pieces).alias("_p")).orderBy("_id", "_p").collect()
    model = train([r["_p"] for r in rows if r["_y"] == 1], [r["_p"] for r in rows if r["_y"] == 0], dictionary_bytes)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def figures(texts: pd.Series) -> pd.Series:
        return texts.map(sent.value.figures)

    known = sample.filter("_half = 1").select("_id", "_y", figures("_t").alias("_f")).filter("_f is not null").orderBy("_id", "_f").collect()
    forget(sample)
    return calibrate(model, [(r["_f"], r["_y"]) for r in known], shares)


def train(good: list[str], bad: list[str], dictionary_bytes: int = DICTIONARY_BYTES) -> Model:
    """Dictionaries of good and bad texts."""
    return Model(*(_dictionary([b for t in x for b in blocks(t)], dictionary_bytes) for x in (good, bad)))


def calibrate(model: Model, pairs: list[tuple], shares: dict[int, int]) -> Model:
    """The curve over (figures, label) pairs of texts that the dictionaries have not seen, its intercept moved to the classes' true shares."""
    n = sum(shares.values())
    prior = shares.get(1, 0) / n if n else 0.5
    model.empty = prior
    x, y = np.array([f for f, _ in pairs], dtype=float).reshape(-1, 3), np.array([y for _, y in pairs], dtype=float)
    if len(set(y)) < 2:
        model.shift = float(np.log(max(prior, 1e-3) / max(1 - prior, 1e-3)))
        return model
    model.slope, model.shift = logistic(x, y)
    seen = y.mean()
    model.shift += float(np.log(prior / (1 - prior)) - np.log(seen / (1 - seen)))
    return model


def score(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text", cut: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 where score >= cut), in one pass without a shuffle.

    Null and blank texts get the share of good rows; texts of any length are compressed as a whole. Rows that repeat a text get the same score, and a
    score of exactly ``cut`` counts as good. An empty table stays empty. All columns of ``docs`` are kept; columns of these two names are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            known: dict = {}
            yield pd.Series([known[x] if x in known else known.setdefault(x, sent.value.score(x)) for x in t], dtype="float64")

    return docs.withColumn("score", scored(F.col(text))).withColumn("predicted", (F.col("score") >= cut).cast("int"))
