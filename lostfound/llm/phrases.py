"""Phrase collocations: Misra-Gries summaries find what may be frequent, a second pass counts it exactly (operator 11).

First pass: every task hashes the n-grams of its texts and sends, for each hash partition, one block of (hash, count) a run of text. Each
partition merges its blocks into a Misra-Gries summary whose capacity exceeds the partition's mass divided by the threshold, so every n-gram
that reaches the threshold survives. Second pass: texts are read again, and only n-grams whose bit is set are counted, by their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, n_parts, tidied, written

#: Bytes of text that a task works on at once; n-gram occurrences of a hash partition on average; bits of all survivors' filter (16 MB).
RUN_BYTES, PART_MASS, FILTER_BITS = 3 << 20, 4_000_000, 27
#: Bits of a hash inside its partition that the first pass keeps.
LOW = 32
#: What a byte is: 0 part of a word, 1 between words, 2 between pieces.
KIND = np.zeros(256, dtype=np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A number for each byte at each of 64 places of a word.
PLACES = mix(np.arange(1, 64 * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def seed_of(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.sha256(lang.encode()).digest()[:8], "little"))


class Run:
    """The words of a run of text of one language: ``hash`` and ``piece`` of each, ``plain`` text with one space after each word, from ``start`` over ``length`` bytes."""

    def __init__(self, raw: bytes, seed: np.uint64) -> None:
        low = LOWER[np.frombuffer(raw, dtype=np.uint8)]
        kind = KIND[low]
        inside = np.zeros(len(low) + 2, dtype=np.int8)
        inside[1:-1] = kind == 0
        edges = np.diff(inside)
        first, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        self.length = end - first
        self.n = len(first)
        if not self.n:
            return
        signs = np.cumsum(kind == 2, dtype=np.int32)
        self.piece = signs[first]
        at = np.cumsum(self.length) - self.length
        letters = low[kind == 0]
        place = np.arange(len(letters), dtype=np.int32) - np.repeat(at.astype(np.int32), self.length)
        value = PLACES[((place & 63) << 8) | letters]
        if self.length.max() > 64:
            late = place >= 64
            value[late] = mix(value[late] + (place[late] >> 6).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        self.hash = mix(np.add.reduceat(value, at) ^ seed)
        self.start = at + np.arange(self.n)
        self.plain = np.full(len(letters) + self.n, 0x20, dtype=np.uint8)
        self.plain[np.arange(len(letters)) + np.repeat(np.arange(self.n), self.length)] = letters

    def ngrams(self, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words, places, hashes) of all n-grams inside pieces, for 1 to ``most`` words."""
        if not self.n:
            return
        own, at = self.hash, np.arange(self.n)
        yield 1, at, own
        for size in range(2, most + 1):
            last = np.minimum(at + size - 1, self.n - 1)
            keep = (at + size - 1 < self.n) & (self.piece[last] == self.piece[at])
            own, at = own[keep], at[keep]
            own = mix(own * np.uint64(0x9E3779B97F4A7C15) + self.hash[at + size - 1] + np.uint64(size))
            yield size, at, own

    def phrases(self, size: int, at: np.ndarray) -> pa.Array:
        """The words of n-grams, one space between them."""
        begin, last = self.start[at], at + size - 1
        n = self.start[last] + self.length[last] - begin
        ends = np.cumsum(n)
        picked = self.plain[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - n), n)]
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(picked)])


def pieces(raw: bytes, size: int) -> Iterator[bytes]:
    """A text in parts of about ``size`` bytes, cut between pieces; a longer piece stays whole."""
    lo = 0
    while len(raw) - lo > size:
        signs = np.flatnonzero(KIND[np.frombuffer(raw, dtype=np.uint8, count=size, offset=lo)] == 2)
        if len(signs):
            cut = lo + int(signs[-1]) + 1
        else:
            later = np.flatnonzero(KIND[np.frombuffer(raw, dtype=np.uint8, offset=lo + size)] == 2)
            cut = lo + size + int(later[0]) + 1 if len(later) else len(raw)
        yield raw[lo:cut]
        lo = cut
    if lo < len(raw):
        yield raw[lo:]


def runs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[tuple[str, Run]]]:
    """Texts of all batches as runs of some ``size`` bytes in all, a run for each language; a line end keeps the pieces of two texts apart."""
    held: dict[str, list[bytes]] = {}
    total = 0
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
            for part in pieces(text, size) if len(text) > size else (text,):
                held.setdefault(lang, []).append(part)
                total += len(part) + 1
                if total >= size:
                    yield [(k, Run(b"\n".join(v), seed_of(k))) for k, v in held.items()]
                    held, total = {}, 0
    if held:
        yield [(k, Run(b"\n".join(v), seed_of(k))) for k, v in held.items()]


def summarize(blocks: list[tuple[np.ndarray, np.ndarray]], capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(keys, counts, lost): a Misra-Gries summary merged from blocks of (keys, counts); a true count is at most ``lost`` above the one kept.

    Blocks are added up until they pass the capacity; then the (capacity + 1)-th largest count is taken off all, and what has none left goes.
    """
    keys, counts, lost = np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.int64), 0
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    for i, (k, c) in enumerate(blocks):
        waiting.append((k, c))
        held += len(k)
        if held < capacity and i < len(blocks) - 1:
            continue
        k, c = np.concatenate([keys, *[x for x, _ in waiting]]), np.concatenate([counts, *[x for _, x in waiting]]).astype(np.int64)
        waiting, held = [], 0
        order = np.argsort(k, kind="stable")
        k, c = k[order], c[order]
        at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, dtype=np.int64)
        keys, counts = k[at], np.add.reduceat(c, at) if len(at) else c
        if len(keys) > capacity:
            less = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
            keep = counts > less
            keys, counts, lost = keys[keep], counts[keep] - less, lost + less
    return keys, counts, lost


def survivors(own: DataFrame, least: int, most: int, *, part_mass: int = PART_MASS, filter_bits: int = FILTER_BITS, run_bytes: int = RUN_BYTES) -> np.ndarray:
    """First pass over ``_l, _t``: bits of all n-grams that may occur ``least`` times in their language.

    The filter has ``filter_bits`` bits however many survive: each partition sets those of its own range, and the driver puts the ranges together.
    Others that share a bit only cost rows in the second pass.
    """
    size = own.agg(F.coalesce(F.sum(F.octet_length("_t")), F.lit(0)).alias("n")).first()["n"]
    bits = max(4, min(24, (int(size * 0.5) // part_mass).bit_length()))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, run_bytes):
            found = [h for _, run in group for _, _, h in run.ngrams(most)]
            h = np.sort(np.concatenate(found) if found else np.empty(0, dtype=np.uint64))
            if not len(h):
                continue
            at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            n = np.diff(np.append(at, len(h))).astype("<u4")
            h = h[at]
            part = (h >> np.uint64(64 - bits)).astype(np.int64)
            low = (h >> np.uint64(64 - bits - LOW)).astype("<u4")
            edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            ends = np.append(edge[1:], len(part))
            yield pa.RecordBatch.from_arrays([pa.array(part[edge].astype(np.int32)), pa.array([low[a:b].tobytes() for a, b in zip(edge, ends, strict=True)], pa.binary()), pa.array([n[a:b].tobytes() for a, b in zip(edge, ends, strict=True)], pa.binary())], names=["part", "low", "n"])

    own_bits = filter_bits - bits

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = [np.frombuffer(x, dtype="<u4") for x in pdf["n"]]
        capacity = sum(int(x.sum(dtype=np.int64)) for x in counts) // least + 1
        keys, kept, lost = summarize([(np.frombuffer(k, dtype="<u4"), c) for k, c in zip(pdf["low"], counts, strict=True)], capacity)
        may = keys[kept + lost >= least]
        flags = np.zeros(1 << own_bits, dtype=bool)
        flags[may >> np.uint32(LOW - own_bits)] = True
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "bits": [np.packbits(flags, bitorder="little").tobytes()]})

    filter_ = np.zeros((1 << bits, (1 << own_bits) // 8), dtype=np.uint8)
    summaries = written(own.mapInArrow(tidied(blocks), "part int, low binary, n binary").groupBy("part").applyInPandas(summary, "part int, bits binary"), "phrase-bits")
    for r in summaries.collect():  # 2^filter_bits bits in all
        filter_[r["part"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    forget(summaries)
    return filter_.ravel()


def counted(own: DataFrame, bits: np.ndarray, most: int, run_bytes: int = RUN_BYTES) -> DataFrame:
    """Second pass over ``_l, _t``: (lang, size, phrase, n) of all n-grams whose bit is set, by their words, and a row of size 0 with all words of a language."""
    shift = np.uint64(64 - (len(bits) * 8 - 1).bit_length())
    sent = own.sparkSession.sparkContext.broadcast(bits)
    kinds = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for group in runs(batches, run_bytes):
            for lang, run in group:
                parts = [(0, pa.array([""]), np.array([run.n]))]
                for size, at, h in run.ngrams(most):
                    slot = h >> shift
                    keep = (known[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    _, first, n = np.unique(h[keep], return_index=True, return_counts=True)
                    if len(first):
                        parts.append((size, run.phrases(size, at[keep][first]), n))
                for size, phrase, n in parts:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(np.full(len(n), size, dtype=np.int32)), phrase, pa.array(n.astype(np.int64))], schema=kinds)

    rows = own.mapInArrow(tidied(count), "lang string, size int, phrase string, n long")
    return rows.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))


def unhidden(found: DataFrame, words: Column, most: int, inside: int) -> DataFrame:
    """Candidates that don't stand inside a longer one with at least ``inside`` percent of their occurrences."""
    inner = lambda k: F.transform(F.sequence(F.lit(1), F.col("size") - (k - 1)), lambda i: F.array_join(F.slice(words, i, F.lit(k)), " "))
    listed = [F.when(F.col("size") > k, inner(k)).otherwise(F.array().cast("array<string>")) for k in range(2, most)]
    hidden = found.filter("size > 2").select("lang", "a", F.explode(F.flatten(F.array(*listed))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("_most"))
    return found.join(hidden, ["lang", "phrase"], "left").filter(F.coalesce(F.lit(100) * F.col("_most") < F.lit(inside) * F.col("a"), F.lit(True))).drop("_most")


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = 10, most: int = 3, inside: int = 50, top: int | None = 2_000, part_mass: int = PART_MASS, filter_bits: int = FILTER_BITS, run_bytes: int = RUN_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of 2 to ``most`` words of each language that occur ``least`` times or more; all, if ``top`` is None.

    a counts the phrase, l and r the parts of its lowest-scoring cut (ties: the shorter first part), n all words of the language; score is
    floor(1000000 a a / (l r)), in decimals of 38 digits. A phrase inside a longer candidate that has at least ``inside`` percent of its
    occurrences is dropped. Order: score, a, then phrase by its bytes. Phrases never cross the signs ``.,;:!?`` and line ends.

    A null text is empty; a null language is ``und``, as is one of that name. Empty texts add no words; an empty table, or one without a phrase frequent
    enough, gives no rows. Texts of any length are read whole, piece by piece; rows that repeat count as often as they stand there. Other columns are not read.
    """
    own = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("_l"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    bits = survivors(own, least, most, part_mass=part_mass, filter_bits=filter_bits, run_bytes=run_bytes)
    counts = written(counted(own, bits, most, run_bytes).filter((F.col("n") >= least) | (F.col("size") == 0)), "phrase-counts")
    found = counts.filter("size > 1").select("lang", "size", F.col("phrase"), F.col("n").alias("a"))
    words = F.split("phrase", " ")

    shown = unhidden(found, words, most, inside) if most > 2 else found
    cuts = F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(k.alias("k"), F.array(F.array_join(F.slice(words, F.lit(1), k), " "), F.array_join(F.slice(words, k + 1, F.lit(most)), " ")).alias("p")))
    sides = shown.select("lang", "phrase", "a", F.explode(cuts).alias("_c")).select("lang", "phrase", "a", F.col("_c.k").alias("k"), F.posexplode("_c.p").alias("side", "_p"))
    parts = counts.filter("size > 0").select("lang", F.col("phrase").alias("_p"), F.col("n").alias("_n"))
    met = sides.join(parts, ["lang", "_p"]).groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == 0, F.col("_n"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("_n"))).alias("r"))
    whole = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    scored = met.withColumn("score", F.expr(f"(CAST(1000000 AS DECIMAL(7, 0)) * {whole('a')} * {whole('a')}) div ({whole('l')} * {whole('r')})"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("_b")).select("lang", "phrase", "a", "_b.l", "_b.r", "_b.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:
        # the best of every salt first, so no task ranks all phrases of a language
        salted = best.withColumn("_s", F.pmod(F.xxhash64("phrase"), F.lit(max(8, n_parts(docs.sparkSession)))))
        best = salted.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_s").orderBy(*order))).filter(F.col("_r") <= top).drop("_s", "_r")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    totals = counts.filter("size = 0").select("lang", F.col("n"))
    out = written(ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "phrases")
    forget(counts)
    return out
