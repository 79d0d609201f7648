"""Quality rules: distribution divergence from language references, behind plain base rules.

A document's histograms of character classes and of common words are compared with those of its language by
Jensen-Shannon distance (base 2, 0 to 1). The references are sums over all documents that pass the base rules and are not full of signs or capitals.
Short texts are judged by fewer measures: histograms of a few words say little.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORDS, written

#: Character classes, in the order of the histogram: upper, lower, digit, white space, stops, signs, other.
CLASSES = 7
STOPS = frozenset(".,;:?!'\"-()")
SIGNS = frozenset("#*$%&|<>")
#: Common words of a language: its most frequent ones in the corpus.
COMMON = 50
#: Languages whose references go to all tasks: those with most text. Texts of the others are joined with their own.
LANGS = 256
#: Least characters and words for the two measures, and their largest distances.
LEAST_CHARS, LEAST_WORDS = 200, 100
MOST_CHAR_DISTANCE, MOST_WORD_DISTANCE = 0.18, 0.45
#: A reference takes no text in which signs are over this share of the characters, or capitals over this share of the letters.
REFERENCE_SIGNS, REFERENCE_UPPER = 0.005, 0.25
#: Base rules.
BASE_WORDS, BASE_REPEAT_PERCENT = 10, 20
WINDOW = 5
#: Distinct words a task counts before it passes its sums on.
TASK_WORDS = 200_000
_ASCII = np.array([3 if chr(c) in " \t\n\r\x0b\x0c" else 0 if chr(c).isupper() else 1 if chr(c).islower() else 2 if chr(c).isdigit() else 4 if chr(c) in STOPS else 5 if chr(c) in SIGNS else 6 for c in range(128)])
_SIGN = re.compile(r"[#*$%&|<>]")
_EDGES = ".,;:?!'\"()[]#*$%&|<>-"


def char_classes(text: str) -> np.ndarray:
    """Counts of the character classes of a text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    low = points < 128
    counts = np.bincount(_ASCII[points[low]], minlength=CLASSES)
    if not low.all():
        other, n = np.unique(points[~low], return_counts=True)
        for p, k in zip(other.tolist(), n.tolist(), strict=True):
            c = chr(p)
            counts[0 if c.isupper() else 1 if c.isalpha() else 2 if c.isdigit() else 3 if c.isspace() else 6] += k
    return counts


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words that stand in a window of ``window`` words which the text has twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    code, width = ids[:n], len(number)
    for k in range(1, window):  # exact: windows so far are numbered anew before the next word joins
        code = code * width + ids[k : k + n]
        if width ** (k + 2) >= 1 << 62 and k + 1 < window:
            code = np.unique(code, return_inverse=True)[1].astype(np.int64)
            if n * width >= 1 << 62:
                raise ValueError("the text is too long")
        elif width ** (k + 1) >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1].astype(np.int64)
    _, back, count = np.unique(code, return_inverse=True, return_counts=True)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.flatnonzero(count[back] >= 2)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def base_figures(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; all 0 for null and for empty texts."""
    if not isinstance(text, str):
        return 0, 0, 0, 0, 0
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), len(_SIGN.findall(text)), len(lines) - len(set(lines)), repeated_words(words)


def plain_words(text: str) -> list[str]:
    """Words in lower case without signs at their edges."""
    return [w for w in (x.strip(_EDGES) for x in text.lower().split()) if w]


def base_failed(n_words, n_repeat_words):
    return (n_words < BASE_WORDS) | (100 * n_repeat_words > BASE_REPEAT_PERCENT * n_words)


def divergence(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance, base 2; 1 if one side is empty."""
    a, b = p.sum(), q.sum()
    if not a or not b:
        return 1.0
    p, q = p / a, q / b
    m = (p + q) / 2
    part = lambda x: float((x[x > 0] * np.log2(x[x > 0] / m[x > 0])).sum())
    return float(np.sqrt(max(0.0, (part(p) + part(q)) / 2)))


class References:
    """By language: character-class counts, common words, their counts, and the count of other words."""

    def __init__(self, chars: dict[str, np.ndarray], words: dict[str, list[tuple[str, int]]], totals: dict[str, int]) -> None:
        self.chars, self.index, self.counts = chars, {}, {}
        for lang in chars:
            own = words.get(lang, [])
            self.index[lang] = {w: i for i, (w, _) in enumerate(own)}
            self.counts[lang] = np.array([n for _, n in own] + [max(0, totals.get(lang, 0) - sum(n for _, n in own))], dtype=float)

    def distances(self, text: str, lang: str | None) -> tuple[float, float, int, int]:
        """(character distance, word distance, characters, words): against the language's reference, or the nearest where the language is null or unknown."""
        counts = char_classes(text).astype(float)
        words = Counter(plain_words(text))
        n = sum(words.values())
        found = []
        for x in [lang] if lang in self.chars else self.chars:
            found.append((divergence(counts, self.chars[x]), divergence(self.histogram(words, n, x), self.counts[x])))
        c, w = min(found, key=lambda d: d[0] + d[1], default=(0.0, 0.0))
        return c, w, int(counts.sum()), n


    def histogram(self, words: Counter, n: int, lang: str) -> np.ndarray:
        """Counts of the language's common words in a text, and of its other words."""
        own = np.zeros(len(self.index[lang]) + 1)
        for w, i in self.index[lang].items():
            own[i] = words.get(w, 0)
        own[-1] = n - own.sum()
        return own


def representative(counts: np.ndarray) -> bool:
    """Whether a text with these character classes may stand for its language."""
    return counts[5] <= REFERENCE_SIGNS * counts.sum() and counts[0] <= REFERENCE_UPPER * (counts[0] + counts[1])


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What a task's documents add to the references: (lang, kind, key, n), already summed."""
    chars: dict[str, np.ndarray] = {}
    words: dict[str, Counter] = {}

    def rows() -> pd.DataFrame:
        out = [(x, "c", str(i), int(n)) for x, c in chars.items() for i, n in enumerate(c)]
        out += [(x, "w", w, n) for x, c in words.items() for w, n in c.items()]
        chars.clear(), words.clear()
        return pd.DataFrame(out, columns=["lang", "kind", "key", "n"])

    for pdf in batches:
        for text, lang, ok in zip(pdf["_t"], pdf["_lang"], pdf["_ok"], strict=True):
            if ok and isinstance(lang, str) and isinstance(text, str) and representative(own := char_classes(text)):
                chars[lang] = chars.get(lang, 0) + own
                words.setdefault(lang, Counter()).update(plain_words(text))
        if sum(map(len, words.values())) > TASK_WORDS:
            yield rows()
    if chars:
        yield rows()


def references(docs: DataFrame, *, common: int = COMMON, langs: int | None = None) -> tuple[References, DataFrame | None]:
    """The references of ``docs`` (``_t, _lang, _ok``): sums over all its rows with ``_ok``; those of the ``langs`` languages with most text, and a table (_own, _chars, _words, _counts) of all others, None if there are none.

    The driver gets ``common`` words and the class counts of each of the first.
    """
    langs = LANGS if langs is None else langs
    sums = written(docs.mapInPandas(_sums, "lang string, kind string, key string, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")), "rule-sums")
    most = [r["lang"] for r in sums.filter("kind = 'c'").groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(langs + 1).collect()]
    others = _other_references(sums.filter(~F.col("lang").isin(most[:langs])), common) if len(most) > langs else None
    sums = sums.filter(F.col("lang").isin(most[:langs]))
    chars, words, totals = {}, {}, {}
    for r in sums.filter("kind = 'c'").collect():
        chars.setdefault(r["lang"], np.zeros(CLASSES))[int(r["key"])] = r["n"]
    for r in sums.filter("kind = 'w'").groupBy("lang").agg(F.sum("n").alias("n")).collect():
        totals[r["lang"]] = r["n"]
    top = sums.filter("kind = 'w'").withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "key"))).filter(F.col("_r") <= common)
    for r in top.orderBy("lang", "_r").collect():
        words.setdefault(r["lang"], []).append((r["key"], r["n"]))
    return References(chars, words, totals), others


def _other_references(sums: DataFrame, common: int) -> DataFrame:
    """(_own, _chars, _words, _counts) by language: class counts, the common words, their counts and that of all other words."""
    chars = sums.filter("kind = 'c'").groupBy(F.col("lang").alias("_own")).agg(F.array(*[F.coalesce(F.sum(F.when(F.col("key") == str(i), F.col("n"))), F.lit(0)) for i in range(CLASSES)]).alias("_chars"))
    words = sums.filter("kind = 'w'")
    top = words.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "key"))).filter(F.col("_r") <= common)
    listed = top.groupBy(F.col("lang").alias("_own")).agg(F.array_sort(F.collect_list(F.struct("_r", "key", "n"))).alias("_w"))
    total = words.groupBy(F.col("lang").alias("_own")).agg(F.sum("n").alias("_n"))
    out = chars.join(listed, "_own", "left").join(total, "_own", "left")
    counts = F.coalesce(F.col("_w.n"), F.array().cast("array<bigint>"))
    left = F.coalesce("_n", F.lit(0)) - F.aggregate(counts, F.lit(0).cast("long"), lambda x, y: x + y)
    return out.select("_own", "_chars", F.coalesce(F.col("_w.key"), F.array().cast("array<string>")).alias("_words"), F.concat(counts, F.array(left)).alias("_counts"))


def judge(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", common: int = COMMON, most_char: float = MOST_CHAR_DISTANCE, most_word: float = MOST_WORD_DISTANCE, least_chars: int = LEAST_CHARS, least_words: int = LEAST_WORDS, langs: int | None = None) -> DataFrame:
    """One row per document: the base figures, ``base_failed``, both distances and ``kept``.

    A text under ``least_chars`` characters is not held to the character distance, one under ``least_words`` words not to the
    word distance. A null text counts as none: it fails the base rules. A null language, or one without a reference, is compared with the nearest
    of the ``langs`` languages with most text; texts of languages beyond these are joined with the reference of their own; without any reference only the base rules count. Rows that repeat are judged one by one; an empty table
    gives no rows. Other columns are not read.
    """
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_t"), F.col(lang).alias("_lang"))

    def figures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pd.DataFrame([base_figures(t) for t in pdf["_t"]], columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])
            yield pdf.reset_index(drop=True).assign(doc_id=pdf["doc_id"].astype("Int64").to_numpy(), **{c: out[c].to_numpy() for c in out}) if len(pdf) else pdf.assign(**{c: out[c] for c in out})

    columns = "doc_id long, _t string, _lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    failed = (F.col("n_words") < BASE_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * BASE_REPEAT_PERCENT)

    # the first pass needs only whether a text passes, which the same figures say; nothing wide is stored between the passes
    def passing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = []
            for t in pdf["_t"]:
                words = WORDS.findall(t) if isinstance(t, str) else []
                ok.append(len(words) >= BASE_WORDS and 100 * repeated_words(words) <= BASE_REPEAT_PERCENT * len(words))
            yield pdf.assign(_ok=ok)

    known, others = references(plain.select("_t", "_lang").mapInPandas(passing, "_t string, _lang string, _ok boolean"), common=common, langs=langs)
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def verdicts(batches: Iterator[pd.DataFrame], ref: References | None = None) -> Iterator[pd.DataFrame]:
        ref = ref or sent.value
        for pdf in figures(batches):
            bad = base_failed(pdf["n_words"].to_numpy(dtype=np.int64), pdf["n_repeat_words"].to_numpy(dtype=np.int64)) if len(pdf) else np.zeros(0, dtype=bool)
            got = [(None, None, False) if b else _verdict(ref, t, x) for b, t, x in zip(bad, pdf["_t"], pdf["_lang"], strict=True)]
            yield pdf.drop(columns=["_t", "_lang"]).assign(base_failed=bad, char_distance=pd.array([g[0] for g in got], dtype="Float64"), word_distance=pd.array([g[1] for g in got], dtype="Float64"), kept=np.array([g[2] for g in got], dtype=bool))

    def _verdict(ref: References, t: str, x: str | None) -> tuple[float, float, bool]:
        c, w, chars, words = ref.distances(t, x if isinstance(x, str) else None)
        return c, w, (chars < least_chars or c <= most_char) and (words < least_words or w <= most_word)

    def own_verdicts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """As ``verdicts``, each text by the reference in its row."""
        for pdf in batches:
            for lang, part in pdf.groupby("_own", sort=False):
                r = part.iloc[0]
                ref = References({lang: np.array(r["_chars"], dtype=float)}, {lang: list(zip(r["_words"], r["_counts"], strict=False))}, {lang: int(sum(r["_counts"]))})
                for out in verdicts(iter([part.drop(columns=["_own", "_chars", "_words", "_counts"])]), ref):
                    yield out

    out = columns.replace("_t string, _lang string, ", "") + ", base_failed boolean, char_distance double, word_distance double, kept boolean"
    if others is None:
        return plain.mapInPandas(verdicts, out)
    # each of these languages has less text than any of the others, so none is a hot key
    apart = plain.join(others, plain["_lang"] == others["_own"])
    rest = plain.join(others.select("_own"), plain["_lang"] == F.col("_own"), "left_anti")
    return rest.mapInPandas(verdicts, out).unionByName(apart.mapInPandas(own_verdicts, out))
