"""Language identification of mixed text: scripts narrow the candidates, Viterbi over words labels the spans.

A word's score for a language is the mean log-probability of its character n-grams there. A path through the
languages pays a penalty for each switch; the best path gives spans, and the language with most letters the prediction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, fresh_names

#: Rows of a language that the model is learned from at most, chosen by a hash of the id; of all languages together; and characters of each, from its middle.
LANG_ROWS, ALL_ROWS, ROW_CHARS = 2_000, 32_000, 4_000
#: Languages that are learned at most, the most frequent ones: the model takes 1 MB for each.
LANGS = 64
#: Hash slots of n-grams of 1 to 4 characters.
SLOTS = 1 << 18
#: Cost of changing the language between two words, in units of the summed log-probability of a word.
SWITCH = 6.0
#: A language is a candidate for a script if at least this share of its letters is in the script.
SCRIPT_SHARE = 0.01
#: Distinct words whose scores a Python worker remembers.
CACHE_WORDS = 300_000
#: Texts that the path search handles side by side, and scores (words x languages) that it holds at once: a longer text is searched stretch by stretch.
SIDE_BY_SIDE, CELLS = 512, 2_000_000

# Ranges of the Unicode scripts told apart, as first and last code point.
SCRIPTS = (
    ("latin", ((0x0041, 0x005A), (0x0061, 0x007A), (0x00AA, 0x00AA), (0x00BA, 0x00BA), (0x00C0, 0x024F), (0x1E00, 0x1EFF))),
    ("greek", ((0x0370, 0x03FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x0400, 0x052F), (0x1C80, 0x1C8F))),
    ("armenian", ((0x0531, 0x058F),)),
    ("hebrew", ((0x0591, 0x05F4),)),
    ("arabic", ((0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF))),
    ("devanagari", ((0x0900, 0x097F),)),
    ("bengali", ((0x0980, 0x09FF),)),
    ("gurmukhi", ((0x0A00, 0x0A7F),)),
    ("gujarati", ((0x0A80, 0x0AFF),)),
    ("tamil", ((0x0B80, 0x0BFF),)),
    ("telugu", ((0x0C00, 0x0C7F),)),
    ("kannada", ((0x0C80, 0x0CFF),)),
    ("malayalam", ((0x0D00, 0x0D7F),)),
    ("thai", ((0x0E00, 0x0E7F),)),
    ("georgian", ((0x10A0, 0x10FF),)),
    ("hangul", ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7A3))),
    ("kana", ((0x3040, 0x30FF),)),
    ("han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F))),
)
LETTERS = re.compile(r"[^\W\d_]+")
LAST_LETTER = re.compile(r"([^\W\d_])(?=[\W\d_]*\Z)")
_bounds = sorted((a, b, i) for i, (_, ranges) in enumerate(SCRIPTS) for a, b in ranges)
_starts, _ends, _which = (np.array(x) for x in zip(*_bounds, strict=True))


def scripts_of(points: np.ndarray) -> np.ndarray:
    """Index of each code point's script; the number of scripts stands for any other."""
    at = np.clip(np.searchsorted(_starts, points, side="right") - 1, 0, None)
    return np.where((points >= _starts[at]) & (points <= _ends[at]), _which[at], len(SCRIPTS))


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots of all n-grams, first n-gram of each word, code points' script of each word's first letter)."""
    joined = " " + " ".join(words) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.cumsum(lengths + 1) - lengths  # position of each word's first letter
    h, parts = np.zeros(len(points), dtype=np.uint64), []
    own = np.repeat(np.arange(len(words)), lengths)  # word of each letter
    letter = np.arange(len(own)) + own + 1
    padded = np.concatenate([points, np.full(4, 32, dtype=np.uint64)])
    for n in range(4):  # n-grams end at the letter's place plus n; the space on both sides is part of the word
        h = h * np.uint64(0x9E3779B97F4A7C15 % (1 << 64)) + padded[n : n + len(points)] + np.uint64(n + 1)
        mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        from_space = np.maximum(letter - 1, 0) if n else letter  # begin one earlier so that prefixes count
        parts.append((mixed >> np.uint64(46)).astype(np.int64)[from_space])
    slots = np.stack(parts, axis=1)
    return slots, starts - np.arange(len(words)) - 1, scripts_of(points[starts].astype(np.int64))


class Model:
    """Log-probabilities of n-gram slots by language, and the candidates of each script."""

    def __init__(self, langs: list[str], logp: np.ndarray, candidates: np.ndarray, prior: np.ndarray) -> None:
        self.langs, self.logp, self.candidates, self.prior = langs, logp, candidates, prior

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_row", "_table")}

    def scores_of(self, words: list[str]) -> np.ndarray:
        """As :meth:`word_scores` of the words in lower case, with the distinct words of earlier calls remembered, ``CACHE_WORDS`` at most and a call's more."""
        if not hasattr(self, "_row") or len(self._row) > CACHE_WORDS:
            self._row, self._table = {}, np.empty((0, len(self.langs)), dtype=np.float32)
        known = self._row
        rows = list(map(known.get, words))
        if None in rows:
            new = list(dict.fromkeys(w for w, r in zip(words, rows, strict=True) if r is None))
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            self._table = np.concatenate([self._table, *(self.word_scores([w.lower() for w in new[i : i + 50_000]]).astype(np.float32) for i in range(0, len(new), 50_000))])
            rows = list(map(known.__getitem__, words))
        return self._table[rows]

    def word_scores(self, words: list[str]) -> np.ndarray:
        """(words x languages): summed log-probability over the word's n-grams, against the best language; far below for languages without the script."""
        slots, first, script = _grams(words)
        each = self.logp[slots].sum(axis=1)
        total = np.add.reduceat(each, first, axis=0) / slots.shape[1] * 2
        total = total - total.max(axis=1, keepdims=True)
        return np.where(self.candidates[script], total, -40.0)


def learn(samples: list[tuple[str, str]], smoothing: float = 0.5) -> Model | None:
    """The model of (text, lang) samples; None without any."""
    langs = sorted({lang for _, lang in samples})
    if not langs:
        return None
    counts = np.zeros((SLOTS, len(langs)))
    letters = np.zeros((len(SCRIPTS) + 1, len(langs)))
    rows = np.zeros(len(langs))
    for k, lang in enumerate(langs):
        texts = [t for t, x in samples if x == lang]
        rows[k] = len(texts)
        words = [w for t in texts for w in LETTERS.findall(t.lower())]
        for lo in range(0, len(words), 50_000):
            part = words[lo : lo + 50_000]
            counts[:, k] += np.bincount(_grams(part)[0].ravel(), minlength=SLOTS)
            letters[:, k] += np.bincount(scripts_of(np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)), minlength=len(SCRIPTS) + 1)
    logp = np.log((counts + smoothing) / (counts.sum(axis=0) + smoothing * SLOTS))
    share = letters / np.maximum(1, letters.sum(axis=0))
    candidates = share >= SCRIPT_SHARE
    candidates[~candidates.any(axis=1)] = True  # a script that no language has narrows nothing
    return Model(langs, logp.astype(np.float32), candidates, np.log((rows + 1) / (rows.sum() + len(rows))))


def paths(scores: list[np.ndarray], prior: np.ndarray, switch: float = SWITCH) -> list[np.ndarray]:
    """The best language of each word of each text, by Viterbi; texts go side by side, longest first."""
    if not scores:
        return []
    k = len(prior)
    order = np.argsort([-len(s) for s in scores], kind="stable")
    lengths = np.array([len(scores[i]) for i in order])
    steps = int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # texts longer than t
    at = np.concatenate([[0], np.cumsum(active)])
    flat = np.empty((int(at[-1]), k))
    for row, i in enumerate(order):
        flat[at[: lengths[row]] + row] = scores[i]
    back = np.empty((int(at[-1]), k), dtype=np.int16)
    own = np.arange(k, dtype=np.int16)
    v = np.zeros((len(order), k))
    last = np.empty(len(order), dtype=np.int16)
    for t in range(steps):
        n = active[t]
        ended = slice(n, active[t - 1] if t else n)
        last[ended] = v[ended].argmax(axis=1)
        if t == 0:
            v = prior + flat[: at[1]]
            back[: at[1]] = own
            continue
        p = v[:n]
        best = p.argmax(axis=1)
        jump = p[np.arange(n), best][:, None] - switch
        stay = p >= jump
        back[at[t] : at[t + 1]] = np.where(stay, own, best[:, None].astype(np.int16))
        v[:n] = np.where(stay, p, jump) + flat[at[t] : at[t + 1]]
    last[: active[steps - 1]] = v[: active[steps - 1]].argmax(axis=1)
    found = np.empty(int(at[-1]), dtype=np.int16)
    now = last.copy()
    for t in range(steps - 1, -1, -1):
        n = active[t]
        found[at[t] : at[t + 1]] = now[:n]
        now[:n] = back[at[t] : at[t + 1]][np.arange(n), now[:n]]
    out: list = [None] * len(scores)
    for row, i in enumerate(order):
        out[i] = found[at[: lengths[row]] + row]
    return out


def long_path(model: Model, words: list[str], switch: float = SWITCH, cells: int | None = None) -> np.ndarray:
    """:func:`paths` of one text, whose scores are made a stretch at a time; of each word only the way back is kept, two bytes a language."""
    k = len(model.langs)
    step = max(1, (cells or CELLS) // k)
    own = np.arange(k, dtype=np.int16)
    back = np.empty((len(words), k), dtype=np.int16)
    v = None
    for lo in range(0, len(words), step):
        for t, s in enumerate(model.scores_of(words[lo : lo + step]), lo):
            if v is None:
                v, back[0] = model.prior + s, own
                continue
            best = int(v.argmax())
            jump = v[best] - switch
            stay = v >= jump
            back[t] = np.where(stay, own, best)
            v = np.where(stay, v, jump) + s
    out = np.empty(len(words), dtype=np.int16)
    now = int(v.argmax())
    for t in range(len(words) - 1, -1, -1):
        out[t] = now
        now = int(back[t, now])
    return out


def _side_by_side(sizes: list[int], k: int) -> Iterator[tuple[int, int]]:
    """Runs of texts with at most ``CELLS`` scores and ``SIDE_BY_SIDE`` texts; a longer text stands alone."""
    lo = total = 0
    for i, n in enumerate(sizes):
        if i > lo and (total + n * k > CELLS or i - lo >= SIDE_BY_SIDE):
            yield lo, i
            lo = i
            total = 0
        total += n * k
    if lo < len(sizes):
        yield lo, len(sizes)


def label(texts: list[str | None], model: Model | None, switch: float = SWITCH) -> list[tuple[str, float, list[tuple[str, int, int]]]]:
    """(lang, share of letters, spans of (lang, first character, end)) of each text; ``und`` without letters or model."""
    found: list = [("und", 0.0, [])] * len(texts)
    if model is None:
        return found
    own = [(i, LETTERS.findall(t)) for i, t in enumerate(texts) if isinstance(t, str)]
    own = [(i, w) for i, w in own if w]
    for lo, hi in _side_by_side([len(ws) for _, ws in own], len(model.langs)):
        part = own[lo:hi]
        words = [w for _, ws in part for w in ws]
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        cuts = np.cumsum([len(ws) for _, ws in part])[:-1]
        found_paths = [long_path(model, words, switch)] if len(words) * len(model.langs) > CELLS else paths(np.split(model.scores_of(words), cuts), model.prior, switch)
        for (i, _), path, n in zip(part, found_paths, np.split(lengths, cuts), strict=True):
            edges = np.concatenate([[0], np.flatnonzero(np.diff(path)) + 1, [len(path)]])
            if len(edges) > 2:
                at = [m.span() for m in LETTERS.finditer(texts[i])]
                ends = [(at[a][0], at[b - 1][1]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            else:
                ends = [(LETTERS.search(texts[i]).start(), LAST_LETTER.search(texts[i]).end(1))]
            weight = np.bincount(path, weights=n, minlength=len(model.langs))
            top = int(weight.argmax())
            found[i] = (model.langs[top], float(weight[top] / weight.sum()), [(model.langs[path[a]], x, y) for a, (x, y) in zip(edges[:-1], ends, strict=True)])
    return found


def fit(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 4, held_out: int = 2, lang_rows: int = LANG_ROWS, all_rows: int = ALL_ROWS, row_chars: int = ROW_CHARS, langs: int = LANGS) -> Model | None:
    """Learns from rows with id, text and lang outside fold ``held_out``, at most ``lang_rows`` rows a language and ``all_rows`` in all, ``row_chars`` characters from the middle of each.

    The ``langs`` most frequent languages are learned, ties by name. Their rows are counted first; those whose hash of the id is under a bound that some
    more than the wanted number reach are ranked, so no task sees more than these. Rows that repeat an id and a lang count once for
    the choice; of an id with several texts the smallest hash of a text is taken. An empty table gives no model.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_t"), F.col(lang).alias("_l")).filter((fold(F.col("_id"), folds) != held_out) & F.col("_t").isNotNull() & F.col("_l").isNotNull())
    counts = own.groupBy("_l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "_l").limit(langs).collect()
    if not counts:
        return None
    each = max(1, min(lang_rows, all_rows // len(counts)))
    most = [(r["_l"], min((1 << 63) - 1, int((1.3 * each + 200) / r["n"] * (1 << 63)))) for r in counts]
    bound = F.broadcast(spark.createDataFrame(most, "_l string, _most long"))
    h = F.xxhash64(F.lit(5), "_id").bitwiseAND(F.lit((1 << 63) - 1))
    near = own.select("_l", "_id", h.alias("_h"), F.xxhash64("_t").alias("_x")).join(bound, "_l").filter("_h <= _most").groupBy("_l", "_id", "_h").agg(F.min("_x").alias("_x"))
    ranked = near.withColumn("_n", F.row_number().over(Window.partitionBy("_l").orderBy("_h", "_id"))).filter(F.col("_n") <= each)
    chosen = spark.createDataFrame([tuple(r) for r in ranked.select("_id", "_l", "_x").collect()], "_id long, _l string, _x long")
    middle = F.substring(F.col("_t"), F.greatest(F.lit(1), ((F.length("_t") - row_chars) / 2).cast("int")), F.lit(row_chars))
    rows = own.withColumn("_x", F.xxhash64("_t")).join(F.broadcast(chosen), ["_id", "_l", "_x"]).select("_id", "_l", middle.alias("_m")).dropDuplicates(["_id", "_l"]).orderBy("_id", "_l").collect()
    return learn([(r["_m"], r["_l"]) for r in rows])


def identify(docs: DataFrame, model: Model | None, *, text: str = "text", switch: float = SWITCH) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (share of letters in it) and ``lang_spans``, in one pass without a shuffle.

    Null texts and texts without a letter are ``und`` with score 0 and no spans, as is every text if nothing was learned. Texts of any length
    are read as a whole. Of languages with equally many letters the first by name is predicted, and a tie between paths keeps the language of the word
    before. Rows that repeat a text get the same. An empty table stays empty; all other columns are kept, those of the three names replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, spans array<struct<lang: string, start: int, end: int>>")
    def labelled(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in texts:
            found = label(list(t), sent.value, switch)
            yield pd.DataFrame({"lang_pred": [x[0] for x in found], "score": [x[1] for x in found], "spans": [[{"lang": a, "start": b, "end": c} for a, b, c in x[2]] for x in found]})

    (found,) = fresh_names(docs, "found")
    got = docs.withColumn(found, labelled(F.col(text)))
    return got.withColumns({"lang_pred": F.col(f"{found}.lang_pred"), "score": F.col(f"{found}.score"), "lang_spans": F.col(f"{found}.spans")}).drop(found)
