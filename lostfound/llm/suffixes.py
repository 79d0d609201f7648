"""Repeated passages by sparse suffix arrays.

Of all suffixes (by word) only those at minimiser positions are kept: in every window of k-grams the one with the smallest hash.
Two equal passages of ``least`` words or more keep a suffix at the same place inside. Suffixes whose k-gram occurs once in the
corpus go at once. The others are taken with ``least`` words to both sides; those of a batch of texts that are equal as far as that go on as one.
They are sorted, and neighbours that are equal as far as that repeat each other and go on as one; what a suffix shares with a neighbour of other surroundings bounds which windows of ``least`` words
around it can be repeated. Each such window has one smallest k-gram and is counted there by its hash, so every repeated window
is found, however its occurrences are ordered. Equal texts meet first, by the hash of the text, and go on as one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORDS, forget, fresh_names, n_parts, tidied, written

#: Least words of a repeated passage; words of a k-gram.
LEAST, GRAM = 50, 8
#: Bytes of a word's code; code 0 stands for no word.
CODE = 3
#: Distinct words whose codes a Python worker remembers; texts that are taken side by side; characters and words of a long text that are taken at once.
CACHE_WORDS, SIDE_BY_SIDE, PIECE_CHARS, PIECE_WORDS = 100_000, 256, 1 << 20, 1 << 18
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class _Codes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word) % ((1 << 8 * CODE) - 1) + 1
        return code


_codes = _Codes()


def word_codes(text: str) -> np.ndarray:
    """A code of 1 to 2 ** 24 - 1 for each word of a text. A long one is taken piece by piece, so its words never stand side by side."""
    parts, at = [], 0
    while at < len(text) or not parts:
        space = _SPACE.search(text, at + PIECE_CHARS) if len(text) > at + PIECE_CHARS else None
        end = space.start() if space else len(text)
        words = WORDS.findall(text, at, end)
        parts.append(np.fromiter(map(_codes.__getitem__, words), dtype=np.uint32, count=len(words)))
        at = max(end, at + 1)
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def gram_hashes(codes: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """64-bit hash of each k-gram along the last axis."""
    n = max(0, codes.shape[-1] - gram + 1)
    h = np.zeros((*codes.shape[:-1], n), dtype=np.uint64)
    for k in range(gram):
        h = (h ^ codes[..., k : k + n]) * _ODD
        h ^= h >> np.uint64(29)
    return h * _MIX


def minimisers(h: np.ndarray, window: int) -> np.ndarray:
    """For each ``window`` k-grams in a row the place of the first smallest."""
    if len(h) < window:
        return np.zeros(0, dtype=np.int64)
    best, width = np.arange(len(h)), 1
    while width < window:  # smallest of each window by doubling, then the first place that has it
        step = min(width, window - width)
        a, b = best[: len(best) - step], best[step:]
        best, width = np.where(h[b] < h[a], b, a), width + step
    return best


def sparse_suffixes(texts: list[str], least: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes of all texts with ``least`` zeros around each, text of each kept suffix, its place there, its place in the codes, its k-gram's hash)."""
    own = [word_codes(t) for t in texts]
    gap = np.zeros(least, dtype=np.uint32)
    codes = np.concatenate([x for c in own for x in (gap, c)] + [gap])
    lengths = np.array([len(c) for c in own], dtype=np.int64)
    starts = np.cumsum(lengths + least) - lengths
    found, hashes = [], []
    for lo in range(0, max(1, len(codes) - least + 1), PIECE_WORDS):
        h = gram_hashes(codes[lo : lo + PIECE_WORDS + least - 1], gram)
        best = minimisers(h, least - gram + 1)
        # windows of ``least`` words that lie inside one text hold no zero
        zeros = np.concatenate([[0], np.cumsum(codes[lo : lo + len(best) + least - 1] == 0)])
        places = np.unique(best[zeros[least : least + len(best)] == zeros[: len(best)]])
        found.append(places + lo), hashes.append(h[places])
    places, first = np.unique(np.concatenate(found), return_index=True)
    which = np.searchsorted(starts, places, side="right") - 1
    return codes, which, places - starts[which], places, np.concatenate(hashes)[first]


def _known_once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a text that the task has had before go; the others come in parts."""
    seen: set[int] = set()
    for pdf in batches:
        pdf = pdf[~pdf["_t"].duplicated().to_numpy() & ~pdf["_t"].isin(seen).to_numpy()]
        seen.update(pdf["_t"].tolist())
        for lo in range(0, len(pdf), SIDE_BY_SIDE):
            yield pdf.iloc[lo : lo + SIDE_BY_SIDE]


def text_key(text: Column) -> Column:
    """Equal texts have equal keys, and others but for collisions of 64-bit hashes."""
    return F.xxhash64(F.lit(7), text)


def _ordered(doc_id: Column) -> Column:
    """The id by which first occurrences are chosen; a null id comes before all others."""
    return F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63)).cast("long"))


def repeated_spans(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """One row per distinct text with repeated passages: ``_t, _first, _copied, _spans, _repeats``, places as lists of (start, end) in words.

    ``_t`` is the :func:`text_key`, ``_first`` the smallest doc_id that has the text, ``_copied`` whether several have it (then all of it
    is repeated). ``_spans`` are all passages of ``least`` words or more that occur in another text or again in this one;
    ``_repeats`` those of which an earlier occurrence stays, by doc_id, then text key, then place.
    """

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _known_once(batches):
            _, which, _, _, h = sparse_suffixes(list(pdf["_x"]), least, gram)
            both = pd.DataFrame({"_h": h.astype(np.int64), "_t": pdf["_t"].to_numpy()[which]})
            yield both.groupby(["_h", "_t"], as_index=False, sort=False).size().rename(columns={"size": "_n"}).astype({"_n": "int32"})

    texts = docs.select(text_key(F.col(text)).alias("_t"), _ordered(F.col(doc_id)).alias("_id"), F.col(text).alias("_x")).filter(F.col("_x").isNotNull())
    owners = written(texts.groupBy("_t").agg(F.min("_id").alias("_id"), F.max("_id").alias("_last")), "sa-owners")
    light = written(texts.select("_t", "_x").mapInPandas(tidied(sparse), "_h long, _t long, _n int"), "sa-sparse")
    # k-grams that occur more than once; no task sees all occurrences of one
    twice = light.groupBy("_h").agg(F.min("_t").alias("_a"), F.max("_t").alias("_b"), F.max("_n").alias("_n")).filter("_a <> _b or _n > 1").select("_h")
    twice = written(twice, "sa-twice")
    by_text = light.join(twice, "_h").groupBy("_t").agg(F.collect_set("_h").alias("_hs"))
    wanted = written(by_text.join(owners.select("_t", "_id"), "_t"), "sa-wanted")
    forget(light, twice)
    found = texts.join(wanted, ["_t", "_id"]).mapInArrow(tidied(contexts(least, gram)), "_s binary, _t long, _id long, _at int, _from int, _to int, _late boolean")
    found = written(found, "sa-contexts")
    forget(wanted)
    order = ["_s", "_id", "_t", "_at"]  # by all columns, so that no number of equal surroundings has to fit a task
    ordered = found.filter("_s is not null").select(*order).repartitionByRange(n_parts(docs.sparkSession), *order).sortWithinPartitions(*order)
    opened = ordered.mapInPandas(tidied(open_windows(least, gram)), "_w long, _t long, _id long, _at int, _from int, _to int, _late boolean")
    met = found.filter("_s is null").select(F.lit(None).cast("long").alias("_w"), "_t", "_id", "_at", "_from", "_to", "_late")
    opened = written(opened.unionByName(met), "sa-windows")
    forget(found)
    windows = opened.filter("_w is not null").select("_w", "_t", "_id", "_at", "_from", "_to")
    # windows that different surroundings share, with their first occurrence
    place = F.struct("_id", "_t", "_from")
    shared = written(windows.groupBy("_w").agg(F.count("*").alias("_k"), F.min(place).alias("_f")).filter("_k > 1").select("_w", "_f"), "sa-shared")
    counted = windows.join(shared, "_w").select("_t", "_at", "_from", "_to", (F.col("_f") < place).alias("_late"))
    both = counted.unionByName(opened.filter("_w is null").select("_t", "_at", "_from", "_to", "_late"))
    # all windows of a suffix hold its k-gram, so together they are one passage
    late = lambda c: F.when(F.col("_late"), F.col(c))
    joined = both.groupBy("_t", "_at").agg(F.min("_from").alias("_a"), F.max("_to").alias("_b"), F.min(late("_from")).alias("_c"), F.max(late("_to")).alias("_d"))
    pair = lambda a, b: F.when(F.col(a).isNotNull(), F.struct(F.col(a).alias("start"), F.col(b).alias("end")))
    spans = joined.groupBy("_t").agg(F.collect_list(pair("_a", "_b")).alias("_spans"), F.collect_list(pair("_c", "_d")).alias("_repeats"))
    out = owners.join(spans, "_t", "left").filter("_id <> _last or _spans is not null").select("_t", F.col("_id").alias("_first"), (F.col("_id") != F.col("_last")).alias("_copied"), "_spans", "_repeats")
    out = written(out, "sa-spans")
    forget(owners, opened, shared)
    return out


def first_of_equals(s: np.ndarray, t: np.ndarray, doc_id: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pd.DataFrame]:
    """(places of the rows that go on, passages ``_t, _id, _at, _from, _to, _late``) of suffixes with surroundings ``s``, bytes of one width.

    Of rows with equal surroundings the first goes on, by id, text and place. All of them are repeated, and all but the first are late, whatever else the
    corpus holds, so they are passages at once. Those of a text that overlap are one, so a word that is said n times in a row gives a row and not n.
    """
    _, key = np.unique(np.ascontiguousarray(s).view(f"S{s.shape[1]}").ravel(), return_inverse=True)
    order = np.lexsort((at, t, doc_id, key))
    late = np.zeros(len(order), dtype=bool)
    late[order[1:]] = key[order[1:]] == key[order[:-1]]
    whole = np.flatnonzero(np.bincount(key)[key] > 1)
    whole = whole[np.lexsort((at[whole], t[whole], late[whole]))]  # by place, so beginnings and ends grow
    apart = np.ones(len(whole), dtype=bool)
    apart[1:] = (late[whole[1:]] != late[whole[:-1]]) | (t[whole[1:]] != t[whole[:-1]]) | (begin[whole[1:]] > end[whole[:-1]])
    a = whole[apart]
    b = whole[np.roll(apart, -1)]  # the last row of a passage stands before the first of the next
    return np.flatnonzero(~late), pd.DataFrame({"_t": t[a], "_id": doc_id[a], "_at": at[a], "_from": begin[a], "_to": end[b], "_late": late[a]})


def contexts(least: int, gram: int):
    """The pass over texts ``_x`` with their repeated k-grams ``_hs``: kept suffixes with ``least`` words to both sides, and without ``_s`` the passages of :func:`first_of_equals`."""
    kind = pa.schema([("_s", pa.binary()), ("_t", pa.int64()), ("_id", pa.int64()), ("_at", pa.int32()), ("_from", pa.int32()), ("_to", pa.int32()), ("_late", pa.bool_())])
    view = np.lib.stride_tricks.sliding_window_view
    wide = 2 * least * CODE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pdf in _known_once(b.to_pandas() for b in batches):
            codes, which, at, places, h = sparse_suffixes(list(pdf["_x"]), least, gram)
            use = np.isin(h.astype(np.int64), np.concatenate(list(pdf["_hs"])))
            which, at, places = which[use], at[use], places[use]
            for lo in range(0, len(at), 8192):
                part = slice(lo, lo + 8192)
                both = np.concatenate([view(codes, least)[places[part]], view(codes, least)[places[part] - least][:, ::-1]], axis=1)
                data = np.ascontiguousarray(both.astype(">u4").view(np.uint8).reshape(-1, 2 * least, 4)[:, :, 4 - CODE :]).reshape(-1, wide)
                t, own_id, place = pdf["_t"].to_numpy()[which[part]], pdf["_id"].to_numpy()[which[part]], at[part].astype(np.int32)
                begin, end = place - (both[:, least:] > 0).sum(axis=1), place + (both[:, :least] > 0).sum(axis=1)
                on, met = first_of_equals(data, t, own_id, place, begin.astype(np.int32), end.astype(np.int32))
                n = len(on)
                s = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1, dtype=np.int32) * wide).tobytes()), pa.py_buffer(data[on].tobytes())])
                none = [pa.nulls(n, kind.field(c).type) for c in ("_from", "_to", "_late")]
                yield pa.RecordBatch.from_arrays([s, pa.array(t[on]), pa.array(own_id[on]), pa.array(place[on]), *none], schema=kind)
                if len(met):
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(met), pa.binary()), *[pa.array(met[c].to_numpy()) for c in kind.names[1:]]], schema=kind)

    return run


def open_windows(least: int, gram: int):
    """The pass over sorted suffixes.

    Of neighbours with equal surroundings each but the first gives a late passage without a hash, as wide as they are, and the first a
    passage that isn't late. Each first one also gives (hash, text, id, place, start, end) for every window of ``least`` words that may be
    repeated: those whose first smallest k-gram is the suffix's own, with no more words ahead than it shares with a neighbour
    (no other suffix shares more). At the edges of a task a neighbour is unknown and taken to share everything. One row is
    carried from batch to batch.
    """
    far = least - gram
    powers = np.ones(2 * least, dtype=np.uint64)
    powers[1:] = np.cumprod(np.full(2 * least - 1, _ODD, dtype=np.uint64), dtype=np.uint64)
    names = ["_w", "_t", "_id", "_at", "_from", "_to", "_late"]

    def table(rows: pd.DataFrame, w, first: np.ndarray, end: np.ndarray, late) -> pd.DataFrame:
        return pd.DataFrame({"_w": w, "_t": rows["_t"].to_numpy(), "_id": rows["_id"].to_numpy(), "_at": rows["_at"].to_numpy(), "_from": first.astype(np.int32), "_to": end.astype(np.int32), "_late": late}, columns=names)

    def emit(rows: pd.DataFrame, codes: np.ndarray, shares: np.ndarray, after: np.ndarray, before: np.ndarray) -> Iterator[pd.DataFrame]:
        """``after``: equal to the row before; ``before``: equal to the next one."""
        at = rows["_at"].to_numpy().astype(np.int64)
        ahead, back = (codes[:, :least] > 0).sum(axis=1), (codes[:, least:] > 0).sum(axis=1)
        whole = np.flatnonzero(after | before)
        if len(whole):
            yield table(rows.iloc[whole], pd.array([None] * len(whole), dtype="Int64"), (at - back)[whole], (at + ahead)[whole], after[whole])
        use = np.flatnonzero((shares >= gram) & ~after)
        if not len(use):
            return
        codes, shares, ahead, back, at, rows = codes[use], shares[use], ahead[use], back[use], at[use], rows.iloc[use]
        n = len(use)
        line = np.concatenate([codes[:, least:][:, ::-1], codes[:, :least]], axis=1).astype(np.uint64)  # the suffix begins at column ``least``
        g = gram_hashes(line[:, least - far : least + far + gram], gram)
        own = g[:, far : far + 1]
        length = lambda ok: np.where(ok.all(axis=1), far, ok.argmin(axis=1)) if far else np.zeros(n, dtype=np.int64)
        most = np.minimum(length(g[:, :far][:, ::-1] > own), back)
        fewest = np.maximum(far - length(g[:, far + 1 :] >= own), least - np.minimum(shares, ahead))
        j = np.arange(far + 1)
        r, j = np.nonzero((j >= fewest[:, None]) & (j <= most[:, None]))
        # hash of a window by prefix sums; every word is mixed first, and the place of the window goes by the power
        mixed = line * _MIX
        mixed ^= mixed >> np.uint64(31)
        sums = np.concatenate([np.zeros((n, 1), dtype=np.uint64), np.cumsum(mixed * powers, axis=1, dtype=np.uint64)], axis=1)
        w = (sums[r, 2 * least - j] - sums[r, least - j]) * powers[least - 1 + j]
        yield table(rows.iloc[r], pd.array(w.astype(np.int64), dtype="Int64"), at[r] - j, at[r] - j + least, False)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, held_codes, share, equal = None, None, least, False  # the last row, whose next one is still to come, and how it compares with the one before
        for pdf in batches:
            for lo in range(0, len(pdf), 4096):
                rows = pdf.iloc[lo : lo + 4096]
                raw = np.frombuffer(b"".join(rows["_s"]), dtype=np.uint8).reshape(len(rows), 2 * least, CODE).astype(np.uint32)
                codes = sum(raw[:, :, k] << np.uint32(8 * (CODE - 1 - k)) for k in range(CODE))
                if held is not None:
                    rows, codes = pd.concat([held, rows], ignore_index=True), np.concatenate([held_codes, codes])
                # a place that stands there twice is one
                twin = np.zeros(len(rows), dtype=bool)
                twin[1:] = (codes[1:] == codes[:-1]).all(axis=1)
                for c in ("_id", "_t", "_at"):
                    v = rows[c].to_numpy()
                    twin[1:] &= v[1:] == v[:-1]
                rows, codes = rows[~twin], codes[~twin]
                same = codes[1:] == codes[:-1]
                equals = same.all(axis=1)
                shared = np.where(same[:, :least].all(axis=1), least, same[:, :least].argmin(axis=1))
                up, twins = np.concatenate([[share], shared]), np.concatenate([[equal], equals])
                yield from emit(rows.iloc[:-1], codes[:-1], np.maximum(up[:-1], shared), twins[:-1], equals)
                held, held_codes, share, equal = rows.iloc[-1:], codes[-1:], int(up[-1]), bool(twins[-1])
        if held is not None:
            yield from emit(held, held_codes, np.array([least]), np.array([equal]), np.array([False]))

    return run


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Union of half-open intervals."""
    out: list[list[int]] = []
    for k in np.lexsort((ends, starts)):
        a, b = int(starts[k]), int(ends[k])
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def clean(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """``docs`` with ``text`` freed of repeats, and ``spans`` and ``removed`` as arrays of (start, end) in words of the old text.

    The first occurrence stays, in order of doc_id (a null id is first), then of a hash of the text, then of place. Null texts stay null
    and empty ones empty; texts under ``least`` words are never touched, and texts of any length are searched as a whole. What is removed ends at
    a word, and the white space after it goes too. Rows that repeat an id and a text are one occurrence and are treated alike. An empty
    table stays empty. All other columns are kept as they are, whatever their names; only columns named ``spans`` and ``removed`` are
    replaced.
    """
    found = repeated_spans(docs, doc_id=doc_id, text=text, least=least, gram=gram)
    pair = "array<struct<start: int, end: int>>"

    @F.pandas_udf(f"text string, spans {pair}, removed {pair}")
    def cut(texts: pd.Series, copied: pd.Series, first: pd.Series, spans: pd.Series, repeats: pd.Series) -> pd.DataFrame:
        out = []
        for t, c, own, s, r in zip(texts, copied, first, spans, repeats, strict=True):
            if not isinstance(t, str) or not (c or s is not None and len(s)):
                out.append((t if isinstance(t, str) else None, [], []))
                continue
            places = np.fromiter((x for m in WORDS.finditer(t) for x in m.span()), dtype=np.int64).reshape(-1, 2)
            n = len(places)
            both = [merged(np.array([x["start"] for x in xs], dtype=np.int64), np.array([x["end"] for x in xs], dtype=np.int64)) for xs in ([] if x is None else [y for y in x if y is not None] for x in (s, r))]
            if c and n >= least:  # all of a text that stands there again, all but the first time
                both = [[(0, n)], both[1] if own else [(0, n)]]
            parts, at = [], 0
            for a, b in both[1]:
                parts.append(t[at : int(places[a, 0])])
                at = int(places[b, 0]) if b < n else len(t)
            parts.append(t[at:])
            out.append(("".join(parts) if both[1] else t, *([{"start": a, "end": b} for a, b in x] for x in both)))
        return pd.DataFrame(out, columns=["text", "spans", "removed"])

    key, done = fresh_names(docs, "key", "cut")
    own = found.withColumnsRenamed({"_t": key, **{c: f"{key}{c}" for c in found.columns if c != "_t"}})
    first = _ordered(F.col(doc_id)) == F.col(f"{key}_first")
    joined = docs.withColumn(key, text_key(F.col(text))).join(own, key, "left")
    whole = joined.withColumn(done, cut(F.col(text), F.coalesce(f"{key}_copied", F.lit(False)), F.coalesce(first, F.lit(True)), f"{key}_spans", f"{key}_repeats"))
    columns = {c: F.col(f"`{c}`") for c in docs.columns} | {text: F.col(f"{done}.text"), "spans": F.col(f"{done}.spans"), "removed": F.col(f"{done}.removed")}
    return whole.select(*[c.alias(name) for name, c in columns.items()])
