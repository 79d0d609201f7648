"""Best-fit packing by minimum bin slack.

Pieces of one length are interchangeable, so the packing is solved on the histogram of lengths, which has at
most ``capacity`` entries whatever the corpus. A bin takes the longest length left and then the fullest feasible
combination of the others, found by subset-sum dynamic programming on a bitset; that combination is repeated
while the counts allow and removed. Pieces then take their places by rank inside their length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORDS, rank_within, tidied, written

CAPACITY = 2048
#: Distinct runs or words whose ids a Python worker keeps; beyond it the memory is emptied and filled anew.
CACHE_WORDS = 200_000
#: Letters that lower-casing and composing leave alone, and signs that never join with letters. In a text of these, digits and white
#: space only, the tokenizer encodes each run of letters, each digit and each run of signs by itself.
LETTERS = "a-zß-öø-ÿāăąćĉċčďđēĕėęěĝğġģĥħĩīĭįıĵķĺļľłńņňōŏőœŕŗřśŝşšţťŧũūŭůűųŵŷźżž"
SIGNS = r"!-&(-/:-@\[-^`{-~"
PLAIN = re.compile(rf"[{LETTERS}{SIGNS}0-9\x20\x09-\x0D]*")
RUNS = re.compile(rf"[{LETTERS}]+|[0-9]|[{SIGNS}]+")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts by way of their distinct parts: runs of a plain text, words of any other.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its words in a row, and
    those of a plain text are those of its runs. New runs are encoded many at a time; the vocabulary's mark of a
    word's end tells them apart.
    """

    def __init__(self, name: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.runs: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _encode_words(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _encode_runs(self, runs: list[str]) -> list[bytes]:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(runs)], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(cuts) != len(runs):
            return self._encode_words(runs)
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]

    def _look_up(self, known: dict[str, bytes], split: list[list[str]], encode) -> list[bytes]:
        if len(known) > CACHE_WORDS:
            known.clear()
        new = list(set().union(*split).difference(known))
        if new:
            known.update(zip(new, encode(new), strict=True))
        return [b"".join(map(known.__getitem__, parts)) + b"\0\0\0\0" for parts in split]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, then the closing id 0."""
        low = [t.lower() if isinstance(t, str) else "" for t in texts]
        plain = [PLAIN.fullmatch(t) is not None and "<|" not in t for t in low]
        of_runs = iter(self._look_up(self.runs, [RUNS.findall(t) for t, p in zip(low, plain, strict=True) if p], self._encode_runs))
        of_words = iter(self._look_up(self.words, [WORDS.findall(t) for t, p in zip(texts, plain, strict=True) if not p], self._encode_words))
        return [next(of_runs if p else of_words) for p in plain]


_encoders: dict[str, Encoder] = {}


def _encode(texts: list[str | None], name: str) -> list[bytes]:
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name].encode(texts)


def tokenize_pieces(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY, ids: bool = True) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, with ``ids``, ``ids_zstd`` (see :func:`packed_ids`).

    Each text's ids are closed by id 0; a null text is empty, so its only id is 0. Only texts longer than ``capacity``
    are cut. Rows that repeat are packed as often as they stand there; a null doc_id stays null.
    """
    columns = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids_zstd binary" * ids

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            yield from encoded(batches)
        finally:
            _encoders.clear()  # a worker that waits for other tasks holds no vocabulary

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 256):
                part = pdf.iloc[lo : lo + 256]
                rows = []
                for d, b in zip(part["doc_id"], _encode(list(part["text"]), tokenizer), strict=True):
                    for k in range(0, len(b) // 4, capacity):
                        own = b[4 * k : 4 * (k + capacity)]
                        rows.append((d, k // capacity, k, len(own) // 4, zlib.crc32(own), *([packed_ids(own)] if ids else [])))
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in columns.split(", ")])
                out["doc_id"] = pd.array(out["doc_id"], dtype="Int64")
                yield out

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(tidied(cut), columns)


def solve(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(repeats, {length: uses}) for each kind of bin, by minimum bin slack on the histogram."""
    left = {n: c for n, c in sorted(counts.items(), reverse=True) if c > 0}
    kinds = []
    while left:
        longest = next(iter(left))
        room = capacity - longest
        uses = {longest: 1}
        if room:
            reach, seen, full = 1, [], (1 << (room + 1)) - 1
            for n, c in left.items():
                c = min(c - (n == longest), room // n) if n <= room else 0
                k = 1
                while c > 0:
                    m = min(k, c)
                    seen.append((n, m, reach))
                    reach |= (reach << (n * m)) & full
                    c, k = c - m, 2 * k
                if reach >> room & 1:
                    break
            at = reach.bit_length() - 1
            for n, m, before in reversed(seen):
                if not before >> at & 1:
                    uses[n] = uses.get(n, 0) + m
                    at -= n * m
        times = min(left[n] // u for n, u in uses.items())
        kinds.append((times, uses))
        for n, u in uses.items():
            left[n] -= u * times
            if not left[n]:
                del left[n]
    return kinds


def places(kinds: list[tuple[int, dict[int, int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length, the runs of places that the bins give it: first rank of the run, first sequence, uses a bin, offset of the first use."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    first = 0
    for times, uses in kinds:
        offset = 0
        for n, u in uses.items():
            runs.setdefault(n, []).append((taken.get(n, 0), first, u, offset))
            taken[n] = taken.get(n, 0) + u * times
            offset += n * u
        first += times
    return {n: tuple(np.array(c, dtype=np.int64) for c in zip(*r, strict=True)) for n, r in runs.items()}


def pack(pieces: DataFrame, *, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece"), capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id, offset``: as few sequences as minimum bin slack finds, filled without gaps from 0.

    ``pieces`` must be stored (see ``written``) or cheap to compute, as it is read for the histogram, for the ranks and for the
    result. What the driver sees is the histogram of lengths, of at most ``capacity`` rows. An empty table gives no rows.
    """
    spark = pieces.sparkSession
    counts = {r["_len"]: r["n"] for r in pieces.groupBy(F.col(length).alias("_len")).agg(F.count("*").alias("n")).collect()}
    runs = spark.sparkContext.broadcast(places(solve(counts, capacity)))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lengths, ranks = pdf["_len"].to_numpy(), pdf["_rank"].to_numpy()
            sequence, offset = np.zeros(len(pdf), dtype=np.int64), np.zeros(len(pdf), dtype=np.int64)
            by_length = np.argsort(lengths, kind="stable")
            for own in np.split(by_length, np.flatnonzero(np.diff(lengths[by_length])) + 1):
                if len(own):
                    n = int(lengths[own[0]])
                    start, first, uses, at = runs.value[n]
                    j = np.searchsorted(start, ranks[own], side="right") - 1
                    k = ranks[own] - start[j]
                    sequence[own] = first[j] + k // uses[j]
                    offset[own] = at[j] + k % uses[j] * n
            yield pdf.drop(columns=["_len", "_rank"]).assign(sequence_id=sequence, offset=offset)

    ranked = rank_within(pieces.withColumn("_len", F.col(length).cast("long")), ["_len"], list(order))
    out = ranked.drop("_len", "_rank").schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInPandas(place, out)


def packed_ids(ids: bytes) -> bytes:
    """Little-endian 32-bit ids, as 16-bit ones if all are small enough, compressed by zstandard: some 1.3 bytes a token."""
    wide = np.frombuffer(ids, dtype="<u4")
    narrow = not len(wide) or wide.max() < 1 << 16
    return (b"\2" if narrow else b"\4") + zstandard.compress(wide.astype("<u2").tobytes() if narrow else ids)


def unpacked_ids(data: bytes) -> bytes:
    """The little-endian 32-bit ids of :func:`packed_ids`."""
    ids = zstandard.decompress(data[1:])
    return np.frombuffer(ids, dtype="<u2").astype("<u4").tobytes() if data[:1] == b"\2" else ids


def pack_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY, ids: bool | str = True) -> DataFrame:
    """All documents cut and packed: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` and, with ``ids``, each piece's token ids: ``ids``, or with "zstd" compressed as ``ids_zstd``.

    A null or empty text is a piece of the closing id alone; texts of any length are encoded as a whole. Rows that repeat an id are packed as
    often as they stand there, and a null id stays null. Pieces of equal length are interchangeable: they take places by a hash of id and
    piece. Other columns are not read. An empty table gives no rows. The ids themselves wait, compressed, in the stored pieces until places are known.
    """
    pieces = tokenize_pieces(docs, doc_id=doc_id, text=text, tokenizer=tokenizer, capacity=capacity, ids=bool(ids))
    if not ids:
        return pack(written(pieces, "pack-pieces"), capacity=capacity)
    stored = written(pieces.withColumn("_row", F.monotonically_increasing_id()), "pack-pieces")
    placed = pack(stored.drop("ids_zstd"), order=("doc_id", "piece", "_row"), capacity=capacity)
    both = placed.join(stored.select("_row", "ids_zstd"), "_row").drop("_row")
    if ids == "zstd":
        return both

    @F.pandas_udf("binary")
    def unpack(data: pd.Series) -> pd.Series:
        return data.map(unpacked_ids)

    return both.withColumn("ids", unpack("ids_zstd")).drop("ids_zstd")
