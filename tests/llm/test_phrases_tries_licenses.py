"""Operators 11 to 13 on small tables: brute force, ties, repeats, nulls, empty and long texts, clashing columns."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lostfound.llm import licenses, phrases, tries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TURNS = "conv_id long, turn long, role string, text string"


def docs_of(spark, rows, extra=""):
    df = spark.createDataFrame([(i, t, g, "s", 1) for i, (t, g) in enumerate(rows)], DOCS)
    for name in extra.split():
        df = df.withColumn(name, F.lit("clash"))
    return df


# 11 phrases


def brute_phrases(rows, least, top, inside=50):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in (1, 2, 3):
                for i in range(len(ws) - k + 1):
                    f[lang, tuple(ws[i : i + k])] += 1
    cand = {(g, p): a for (g, p), a in f.items() if len(p) > 1 and a >= least}
    hide = Counter()
    for (g, p), a in cand.items():
        if len(p) == 3:
            for q in (p[:2], p[1:]):
                hide[g, q] = max(hide[g, q], a)
    out = []
    for lang in n:
        found = []
        for (g, p), a in cand.items():
            if g != lang or ((g, p) in hide and 100 * hide[g, p] >= inside * a):
                continue
            score, k = min((1_000_000 * a * a // (f[g, p[:k]] * f[g, p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[g, p[:k]], f[g, p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def test_phrases_equal_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "Wort", "x" * 70, "x" * 64 + "y" * 66, " ", "a b", "日本"]
    marks = [" "] * 12 + [". ", ",", "\n", "\t", "  ", ";", "!?", "\r", "\x0b"]
    rows = [("".join(rng.choice(vocabulary[: rng.choice((5, 47))]) + rng.choice(marks) for _ in range(rng.randrange(1, 90))), rng.choice(["en", "de", None, "und"])) for _ in range(500)]
    rows += [(None, "en"), ("", "fr"), (" .,\n", "es"), ("once only", "it"), *[("the same row again", "en")] * 12]
    df = docs_of(spark, rows, "a l r n score rank phrase size")
    got = sorted(tuple(r) for r in phrases.collocations(df, part_mass=500, run_bytes=3_000).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == brute_phrases(rows, 10, 2_000) and len(got) > 100
    few = sorted(tuple(r) for r in phrases.collocations(df, top=7, least=15, filter_bits=10).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert few == brute_phrases(rows, 15, 7)  # nearly all bits set: more rows, the same result


def test_phrases_of_more_words_hide_shorter_ones(spark):
    rows = [("a b c d", "en")] * 12 + [("b c", "en")] * 30 + [("c d", "en")] * 3
    got = {r["phrase"]: (r["a"], r["l"], r["r"], r["score"]) for r in phrases.collocations(docs_of(spark, rows), most=4).collect()}
    assert got == {"a b c d": (12, 12, 15, 800_000), "b c": (42, 42, 45, 933_333)}


def test_phrases_of_empty_tables_and_exact_products(spark):
    assert phrases.collocations(docs_of(spark, [("x y", "en")]).limit(0)).count() == 0
    assert phrases.collocations(docs_of(spark, [("x y", "en")])).count() == 0
    big = 3_000_000_019
    row = spark.createDataFrame([(big, big + 7, big + 9)], "a long, l long, r long")
    whole = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    got = row.select(F.expr(f"(CAST(1000000 AS DECIMAL(7, 0)) * {whole('a')} * {whole('a')}) div ({whole('l')} * {whole('r')})").alias("s")).first()["s"]
    assert got == 1_000_000 * big * big // ((big + 7) * (big + 9))


@pytest.mark.parametrize("seed", range(4))
def test_summaries_keep_all_frequent_keys(seed):
    rng = np.random.default_rng(seed)
    keys = np.concatenate([rng.zipf(1.3, 30_000) % 5_000, rng.integers(5_000, 40_000, 20_000)]).astype(np.uint32)
    rng.shuffle(keys)
    least = 10
    blocks = [np.unique(part, return_counts=True) for part in np.array_split(keys, 23)]
    kept, counts, lost = phrases.summarize(blocks, len(keys) // least + 1)
    true = Counter(keys.tolist())
    held = dict(zip(kept.tolist(), counts.tolist(), strict=True))
    assert lost < least and len(held) <= len(keys) // least + 1
    for k, n in true.items():
        assert held.get(k, 0) <= n <= held.get(k, 0) + lost
        assert n < least or k in held


def test_long_texts_are_cut_between_pieces():
    text = (b"one two. three four\n" * 50) + b"x" * 400 + b" tail"
    parts = list(phrases.pieces(text, 64))
    assert b"".join(parts) == text and len(parts) > 10
    assert all(p[-1:] in b".\n" for p in parts[:-1])


# 12 tries


def brute_trie(rows):
    turns = {}
    for c, t, r, x in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, hashlib.sha256(f"{len(r or '')}:{r or ''}{x or ''}".encode()).hexdigest()[:32], r or "", x or ""))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in turns.items()}
    full = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:]
    nodes = {}
    for c, v in full.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    saved, leaves = Counter(), Counter()
    parents = {p[:-1] for p in nodes if p}
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(members) - 1) * len(p[-1][1]) if p else 0
            leaves[p[:d]] += p not in parents
    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(full[c]) == len(p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), sum(q[:-1] == p for q in nodes if q), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie(spark, rows):
    df = spark.createDataFrame(rows, TURNS)
    for c in ("depth", "t", "n", "_key", "x1", "length", "pos", "_h"):
        df = df.withColumn(c, F.lit("clash"))
    out = tries.prefix_trie(*tries.rebuilt(df))
    return sorted((tuple(r) for r in out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_trie_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(tries, "STRETCH", 4)
    monkeypatch.setattr(tries, "ID_RANGE", 16)
    rng = random.Random(seed)
    rows = []
    long_ = [(rng.choice("ab"), f"t{rng.randrange(3)}") for _ in range(45)]
    for c in [*range(40), *range(100, 130), *range(205, 230), 1_000_007, -3]:
        v = [(rng.choice("ab"), rng.choice(["", "x", "yy", "😀é"])) for _ in range(rng.randrange(1, 7))]
        if c % 5 == 0:
            v = long_[: rng.choice((7, 8, 9, 16, 17, 31, 40, 45))] + v[: rng.randrange(3)]
        rows += [(c, t, r, x) for t, (r, x) in enumerate(v)]
    rows += [(500, None, None, None), (500, None, "a", "first"), (500, 1, "b", None), (500, 1, "b", None), (None, 0, "a", "nobody"), (501, -7, None, "x")]
    rng.shuffle(rows)
    assert trie(spark, rows) == brute_trie(rows)


def test_trie_of_empty_turnless_and_equal_conversations(spark):
    assert trie(spark, [(1, 0, "a", "x")][:0]) == []
    lone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 0)
    assert trie(spark, [(lone, 0, "a", "x")]) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]
    same = [(c, t, "a", f"turn {t}") for c in range(60) for t in range(12)]
    got = trie(spark, same)
    assert got == brute_trie(same) and len(got) == 13
    assert {r[3] for r in got} == {60}


# 13 licenses


def brute_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_base(text):
    ws = brute_words(text)
    places = [(i, label) for p, label in licenses.BASE.items() for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
    return len(ws), sorted(places)


def brute_detections(text):
    """All rules on all words, and each match held against every other."""
    plain = (" " + " ".join(brute_words(text)) + " ").encode()
    rules = licenses.signatures()
    found = [(m.start(), m.end(), i) for i, r in enumerate(rules) for m in r.pattern.finditer(plain)]
    order = lambda x: (-rules[x[2]].priority, x[0] - x[1], x[2])
    kept = [x for x in found if not any(y != x and y[0] <= x[0] and x[1] <= y[1] and (rules[y[2]].priority > rules[x[2]].priority or (rules[y[2]].priority == rules[x[2]].priority and order(y) < order(x))) for y in found)]
    return sorted((plain[: a - 1].count(b" "), rules[i].name) for a, b, i in kept)


TEXTS = [
    "Licensed under the Apache License, Version 2.0 (the License). http://www.apache.org/licenses/LICENSE-2.0",
    "This work is licensed under the GNU General Public License, version 3.",
    "GNU Lesser General Public License version 2.1 or (at your option) any later version",
    "licensed under CC BY-NC 4.0. Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International Public License",
    "SPDX-License-Identifier: GPL-2.0-or-later\nSPDX-License-Identifier: MIT",
    "Released under the MIT License. All rights reserved. Copyright (c) 2019 Permission is hereby granted, free of charge",
    "the mit license mit license apache license apache license cc by cc by cc by",
    "GPLv3, gpl2, Apache2, MPL 2.0, BSD-3-Clause license, the FreeBSD license, 2-clause BSD",
    "permit license, accby, éMIT License, mit licenseé, cc bye, the apache licenses",
    None, "", " .,- ", "é", "X", "mit\x00license", "CC-BY-SA 3.0 unported cc by-nd", "İMIT LICENSE",
]


def test_licenses_equal_brute_force(spark):
    rng = random.Random(5)
    words = [w for t in TEXTS for w in (t or "").split()] + ["gnu", "cc", "by", "2.0", "license", "zlib", "version", "the"]
    texts = TEXTS + [rng.choice([" ", "-", "\n"]).join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(150)] + ["plain words only " * 3_000 + " mit license"]
    df = docs_of(spark, [(t, "en") for t in texts], "n_words labels score detections found first_word")
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    rules = {r.name: r for r in licenses.signatures()}
    for i, t in enumerate(texts):
        r = got[i]
        n, places = brute_base(t)
        starts = [p for p, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (n, len(places), min(starts, default=None), max(starts, default=None))
        own = {label for _, label in places}
        assert r["base_labels"] == ",".join(sorted(own))
        found = brute_detections(t)
        assert sorted((d["first_word"], d["rule"]) for d in r["detections"]) == found, t
        assert r["labels"] == ",".join(sorted(own | {rules[x].label for _, x in found}))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])


def test_license_labels():
    labels = lambda t: {d[1] for d in licenses.scanned(t).detections}
    assert labels(TEXTS[0]) == {"apache-2.0"}
    assert labels(TEXTS[1]) == {"gpl-3.0"}
    assert labels(TEXTS[2]) == {"lgpl-2.1-or-later"}
    assert labels(TEXTS[3]) == {"cc-by-nc-4.0", "cc-by-nc-sa-4.0"}
    assert labels(TEXTS[4]) == {"gpl-2.0-or-later", "mit"}
    assert labels("Licensed under CC BY-NC-ND 3.0") == {"cc-by-nc-nd-3.0"}
    assert labels("plain text about a commercial licence fee") == set()
    assert len(licenses.signatures()) > 300 and len({r.name for r in licenses.signatures()}) == len(licenses.signatures())


def test_license_scan_of_an_empty_table(spark):
    assert licenses.scan(docs_of(spark, [("x", "en")]).limit(0)).count() == 0


def test_every_gate_is_needed_by_its_rule():
    """A match without the gate word would be lost: no pattern matches the words of any other rule's examples once its gate word is taken out."""
    samples = [t for t in TEXTS if t] + [r.pattern.pattern.decode().replace("(?<= )(?:", " ").replace(")(?= )", " ") for r in licenses.signatures()]
    plain = [(" " + " ".join(brute_words(t)) + " ").encode() for t in samples]
    for r, p in itertools.product(licenses.signatures(), plain):
        without = b" " + b" ".join(w for w in p.split() if w != r.gate) + b" "
        assert not r.pattern.search(without), r.name
