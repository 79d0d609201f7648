"""The ten operators on small tables: brute force, round trips, edge rows, ties, repeats and clashing columns."""

import itertools
import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from lostfound.llm import compression, langid, minhash, mixing, neighbours, packing, rules, suffixes, toxicity, warc
from lostfound.llm import queries as Q
from lostfound.llm.common import WORDS, rank_within, scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, extra=""):
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    for name in filter(None, extra.split()):
        df = df.withColumn(name, F.lit("clash"))
    return df


def words(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, a null id, a repeated row, nulls in every column, clashing extra columns."""
    long_ = " ".join(words(6000, 1))
    rows = [(1, None, "en", "a", 0), (2, "", None, None, None), (3, "two words", "en", "a", 9), (4, long_, "en", "b", 1), (4, long_, "en", "b", 1), (None, "no id here", "fr", None, 3), (7, " \t\n ", "en", "a", 4)]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("size", "length", "score", "kept", "spans", "_rank", "_t", "_id", "sequence_id"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_rank_within(spark):
    df = spark.createDataFrame([("a", i % 50) for i in range(300)] + [("b", 1)], "k string, v long")
    got = rank_within(df, ["k"], ["v"]).groupBy("k").agg(F.array_sort(F.collect_list("_rank")).alias("r")).collect()
    assert {r["k"]: r["r"] for r in got} == {"a": list(range(300)), "b": [0]}


# 1 packing


def test_packing_places_every_token(spark):
    texts = [" ".join(words(n, n)) for n in (1, 5, 300, 900, 1500, 2500, 40, 40, 40)] + [None, "", "It's İstanbul, don't <|x|> 42 ŠΣΑΣ ﬁn"]
    got = packing.pack_documents(frame(spark, texts), capacity=256).collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path("word_bpe_49k.json"))
    by_doc, by_bin = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_bin.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, t in enumerate(texts):
        want = tok.encode(t or "", add_special_tokens=False).ids + [0]
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [x for p in parts for x in np.frombuffer(p["ids"], dtype="<u4").tolist()] == want
        assert all(p["start"] == 256 * p["piece"] and p["ids_crc32"] == zlib.crc32(bytes(p["ids"])) for p in parts)
        assert all(p["length"] == 256 for p in parts[:-1])
    for places in by_bin.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by_bin) <= -(-sum(r["length"] for r in got) // 256) + 1


def fewest_bins(lengths, capacity):
    """By exhaustive search over the loads of the bins."""
    lengths = sorted(lengths, reverse=True)
    k = -(-sum(lengths) // capacity)
    while True:
        seen = set()

        def fits(i, loads):
            if i == len(lengths):
                return True
            if (i, loads) in seen:
                return False
            seen.add((i, loads))
            return any(fits(i + 1, tuple(sorted((*loads[:j], x + lengths[i], *loads[j + 1 :])))) for j, x in enumerate(loads) if x + lengths[i] <= capacity and (j == 0 or loads[j - 1] != x))

        if fits(0, (0,) * k):
            return k
        k += 1


@pytest.mark.parametrize("capacity, n", [(10, 7), (12, 12), (30, 14)])
def test_packing_is_as_good_as_the_best(capacity, n):
    """The fewest bins there can be, in all but one of a hundred draws at most, and then one more."""
    rng = random.Random(capacity)
    more = []
    for _ in range(100):
        lengths = [rng.randrange(1, capacity + 1) for _ in range(n)]
        bins = sum(t for t, _ in packing.solve({x: lengths.count(x) for x in set(lengths)}, capacity))
        more.append(bins - fewest_bins(lengths, capacity))
    assert min(more) == 0 and sum(more) <= 1


def test_packing_odd_rows(spark, odd):
    got = packing.pack_documents(odd, ids=False).collect()
    assert sorted(r["length"] for r in got if r["doc_id"] in (1, 2, 7)) == [1, 1, 1]
    assert len({(r["doc_id"], r["piece"]) for r in got if r["doc_id"] == 4}) * 2 == sum(r["doc_id"] == 4 for r in got)
    assert packing.pack_documents(empty(spark)).count() == 0


# 2 rules


def test_rules_base_equals_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        ws = [rng.choice("abc") for _ in range(rng.randrange(0, 40))]
        windows = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
        hit = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
        assert rules.repeated_words(ws) == len(hit)
    wide = words(9000, 3, 1_000_000)
    assert rules.repeated_words(wide + wide[100:110]) == 20
    assert rules.base_figures("a b\n#c\na b\n\n a b") == (7, 8, 1, 1, 0)
    assert rules.base_figures(None) == (0, 0, 0, 0, 0)


def test_rules_distances_equal_brute_force(spark):
    rng = random.Random(12)
    texts = [" ".join(rng.choice(["the", "of", "Cat", "dog,", "9", "#tag", "süß", "end."]) + rng.choice(["", "s", "!"]) * (rng.random() < 0.3) for _ in range(rng.randrange(5, 60))) for _ in range(50)]
    frame_ = frame(spark, texts).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").when(F.col("doc_id") % 7 != 0, "de"))
    lang = {i: "en" if i % 2 == 0 else "de" if i % 7 else None for i in range(50)}
    kind = lambda c: "space" if c.isspace() else "up" if c.isupper() else "low" if c.isalpha() else "digit" if c.isdigit() else "stop" if c in ".,;:?!'\"-()" else "sign" if c in "#*$%&|<>" else "other"
    kinds = ["up", "low", "digit", "space", "stop", "sign", "other"]
    plain = lambda t: [w for w in (x.strip(".,;:?!'\"()[]#*$%&|<>-") for x in t.lower().split()) if w]
    sums, counts = {x: dict.fromkeys(kinds, 0) for x in ("en", "de")}, {"en": {}, "de": {}}
    for i, t in enumerate(texts):
        n, repeats = len(t.split()), rules.repeated_words(t.split())
        own = {k: sum(kind(c) == k for c in t) for k in kinds}
        if lang[i] and n >= 10 and 100 * repeats <= 20 * n and own["sign"] <= 0.005 * len(t) and own["up"] <= 0.25 * (own["up"] + own["low"]):
            for k in kinds:
                sums[lang[i]][k] += own[k]
            for w in plain(t):
                counts[lang[i]][w] = counts[lang[i]].get(w, 0) + 1

    def js(a, b):
        if not sum(a) or not sum(b):
            return 1.0
        p, q = [x / sum(a) for x in a], [x / sum(b) for x in b]
        kl = lambda u, v: sum(x * np.log2(x / ((x + y) / 2)) for x, y in zip(u, v) if x)
        return max(0.0, (kl(p, q) + kl(q, p)) / 2) ** 0.5

    top = {x: sorted(counts[x], key=lambda w: (-counts[x][w], w))[:6] for x in counts}
    got = {r["doc_id"]: r for r in rules.judge(frame_, common=6, least_chars=20, least_words=5, most_char=0.2, most_word=0.3).collect()}
    assert any(not r["base_failed"] for r in got.values()) and any(sum(sums[x].values()) for x in sums)
    for i, t in enumerate(texts):
        if got[i]["base_failed"]:
            continue
        words_, best = plain(t), None
        for x in [lang[i]] if lang[i] and sum(sums[lang[i]].values()) else [x for x in sums if sum(sums[x].values())]:
            c = js([sum(kind(ch) == k for ch in t) for k in kinds], [sums[x][k] for k in kinds])
            own = [words_.count(w) for w in top[x]]
            w = js(own + [len(words_) - sum(own)], [counts[x][w] for w in top[x]] + [sum(counts[x].values()) - sum(counts[x][w] for w in top[x])])
            best = min(best or (9, 9), (c, w), key=sum)
        assert abs(got[i]["char_distance"] - best[0]) < 1e-9 and abs(got[i]["word_distance"] - best[1]) < 1e-9, i
        assert got[i]["kept"] == ((len(t) < 20 or best[0] <= 0.2) and (len(words_) < 5 or best[1] <= 0.3))


def test_rules_join_references_of_rare_languages(spark):
    """With references for one language in all tasks, the others come by a join; the verdicts are those with all of them in all tasks."""
    pools = {"en": "the of and to in is that it was for on are as with his they at be this from".split(), "xx": "zu mo ka ri tel bon sa wi nu per".split(), "yy": "ubu ruk olo tat mim".split()}
    rng = random.Random(41)
    rows = [(i, " ".join(rng.choices(pools[g], k=150)), g, "s", 1) for i, g in enumerate(["en"] * 30 + ["xx"] * 12 + ["yy"] * 8)]
    rows += [(100, " ".join(rng.choices(pools["en"], k=150)), "xx", "s", 1), (101, rows[3][1], "zz", "s", 1), (102, rows[35][1], None, "s", 1), (103, None, "yy", "s", 1), (104, "###", "yy", "s", 1), (None, rows[45][1], "yy", "s", 1)]
    df = spark.createDataFrame(rows, DOCS)
    key = lambda n: sorted((tuple(r) for r in rules.judge(df, langs=n).collect()), key=repr)
    every, few = key(256), key(1)
    same = lambda r: r[0] not in (101, 102)
    assert list(filter(same, every)) == list(filter(same, few)) and len(few) == len(rows)
    kept = {r["doc_id"]: r["kept"] for r in rules.judge(df, langs=1).collect()}
    assert kept[100] is False and kept[101] is True


def test_rules_keep_clean_and_drop_junk(spark, odd):
    clean = [" ".join(words(150, i, 60)) + "." for i in range(60)]
    junk = [" ".join(w.upper() + "!!$$" for w in words(150, 900 + i, 60)) for i in range(4)]
    got = {r["doc_id"]: r["kept"] for r in rules.judge(frame(spark, clean + junk)).collect()}
    assert all(got[i] for i in range(60)) and not any(got[i] for i in range(60, 64))
    out = {r["doc_id"]: r for r in rules.judge(odd).collect()}
    assert out[1]["base_failed"] and not out[1]["kept"] and out[3]["n_words"] == 2
    assert rules.judge(odd).count() == 7 and rules.judge(empty(spark)).count() == 0


# 3 and 4: labelled text


def labelled(spark, n=400):
    rng = random.Random(11)
    texts, quality, toxic = [], [], []
    for i in range(n):
        ws = words(80, i, 3000)
        bad, mean = i % 4 == 0, i % 5 == 0
        if mean:
            for _ in range(3):
                ws.insert(rng.randrange(80), rng.choice(["idiot", "moron", "scum"]))
        texts.append(" ".join(w.upper() + "$$$" if bad else w for w in ws))
        quality.append(int(not bad)), toxic.append(int(mean))
    labels = spark.createDataFrame([(i, q, x) for i, (q, x) in enumerate(zip(quality, toxic))] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    return frame(spark, texts), labels, quality, toxic


def test_quality_held_out(spark, odd):
    docs, labels, quality, _ = labelled(spark)
    model = compression.fit(docs, labels)
    got = {r["doc_id"]: r for r in compression.score(docs, model).collect()}
    out = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i]["predicted"] == quality[i] for i in out) >= 0.95 * len(out)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert compression.score(odd, model).count() == 7
    none = compression.fit(empty(spark), labels)
    assert compression.score(empty(spark), none).count() == 0 and none.score(None) == 0.5


def test_quality_scores_equal_brute_force():
    """Sizes block by block with compressors of its own, the curve by its conditions, the score by its formula."""
    rng = random.Random(51)
    good = [" ".join(words(rng.randrange(20, 900), i, 900)) for i in range(60)]
    bad = [" ".join(rng.choice(["buy", "now", "$$$", "CLICK", "!!!"]) + str(rng.randrange(30)) for _ in range(rng.randrange(20, 900))) for _ in range(60)]
    model = compression.train(good[:30], bad[:30], 8_192)

    def sizes(text):
        data = text.encode()
        n = max(1, round(len(data) / 1024))
        step = math.ceil(len(data) / n)
        out = [len(data)]
        for d in (model.good, model.bad):
            c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False)
            out.append(sum(len(c.compress(data[i * step : (i + 1) * step])) for i in range(math.ceil(len(data) / step))))
        return tuple(out)

    def figures(text):
        own, g, b = sizes(text)
        return (b - g) / (b + g), g / own, b / own

    held = good[30:] + bad[30:] + ["x", "é" * 3_000, good[31] * 40]
    for t in held:
        assert model.sizes(t) == sizes(t) and np.allclose(model.figures(t), figures(t))
    assert b"".join(compression.blocks(good[40])) == good[40].encode() and model.figures(" \n") is None is model.figures(None)
    noisy = [(figures(t), int(y if rng.random() > 0.15 else not y)) for t, y in [(t, 1) for t in good[30:]] + [(t, 0) for t in bad[30:]]]
    shares = {0: 100, 1: 900}
    compression.calibrate(model, noisy, shares)
    x, y = np.array([f for f, _ in noisy]), np.array([v for _, v in noisy], dtype=float)
    m, s = x.mean(axis=0), x.std(axis=0)
    slope = model.slope * s
    moved = np.log(0.9 / 0.1) - np.log(y.mean() / (1 - y.mean()))
    shift = model.shift - moved + (model.slope * m).sum()
    z = (x - m) / s
    p = 1 / (1 + np.exp(-(z @ slope + shift)))
    # at the best curve the gradient of the penalised likelihood is nought
    assert np.allclose(z.T @ (y - p), 1e-2 * slope, atol=1e-6) and abs((y - p).sum() - 1e-2 * shift) < 1e-6
    for t in held:
        assert abs(model.score(t) - 1 / (1 + np.exp(-(np.dot(figures(t), model.slope) + model.shift)))) < 1e-9
    assert model.score(None) == model.score("  ") == 0.9


def test_toxicity_held_out_and_exact_neighbours(spark, odd):
    docs, labels, _, toxic = labelled(spark)
    index = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, index).collect()}
    out = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i]["predicted"] == toxic[i] for i in out) >= 0.95 * len(out)
    assert any(got[i]["evidence"] for i in out)
    rng = np.random.default_rng(1)
    vectors = rng.random((300, 6)) * (rng.random((300, 6)) < 0.5) + 1e-9
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    ix = toxicity.Index([f"t{i}" for i in range(6)], np.ones(6), list(range(300)), vectors, [0] * 300)
    for _ in range(20):
        w = rng.random(3)
        own = tuple(sorted(rng.choice(6, 3, replace=False).tolist()))
        places, cosines = ix.nearest(own, w / np.linalg.norm(w), 7)
        exact = np.sort(vectors[:, list(own)] @ (w / np.linalg.norm(w)))[::-1][:7]
        assert np.allclose(cosines, exact)
    assert toxicity.score(odd, index).count() == 7
    assert toxicity.score(docs, toxicity.fit(empty(spark), labels)).filter("predicted = 1").count() == 0


def test_toxicity_sees_all_words():
    """Too few toxic rows for any word to stand out: the nearest examples decide, and all words count in the cosine."""
    mean = "du bist so ein elender dummkopf und ich will dass du hier verschwindest"
    samples = [(i, mean, 1) for i in range(2)] + [(10, "brot und butter", 0), (11, "wasser aus dem fluss", 0), (12, "der zug nach bonn", 0)]
    index = toxicity.build(samples, {}, 5, {1: 2, 0: 3})
    near, far = index.score(f"{mean} anders"), index.score(samples[3][1])
    assert near[0] > far[0] and [e[0] for e in near[1]][:2] == [0, 1]
    assert far[1][0][0] == 11 and far[1][0][1] > 0.999 and {w for _, t, _ in samples for w in toxicity.terms_of(t)} == set(index.terms)


def test_toxicity_votes_and_curve_equal_brute_force():
    rng = random.Random(21)
    vocabulary = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(120)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(3, 40)) + (["vile", "awful"] if y and rng.random() < 0.8 else [])), y) for i in range(160) for y in (int(i % 4 == 0),)] + [(900, "", 0)]
    frequency = {w: sum(w in t.split() for _, t, _ in rows) for w in [*vocabulary, "vile", "awful"]}
    shares = {0: 1_210, 1: 40}  # the sample holds one in ten of the others, all toxic ones
    index = toxicity.build(rows, frequency, 5_000, shares)
    n1, n0 = 40, 121
    seen = {w: [sum(w in t.split() for _, t, y in rows if y == c) for c in (0, 1)] for w in frequency}

    def weight(w):
        b, a = seen[w]
        g = 0.0
        if a * n0 > b * n1:
            g = 2 * sum(x * np.log(x / ((a + b) * p)) for x, p in ((a, n1 / (n1 + n0)), (b, n0 / (n1 + n0))) if x)
        return (np.log(5_001 / (frequency[w] + 1)) + 1) * (1 + np.log1p(g))

    def vector(text):
        v = {w: (1 + np.log(text.split().count(w))) * weight(w) for w in set(text.split()) if w in seen and sum(seen[w])}
        n = np.sqrt(sum(x * x for x in v.values()))
        return {w: x / n for w, x in v.items()}

    vectors = [(i, y, vector(t)) for i, t, y in rows if t]
    share = 40 / (40 + 120 * 10)  # of what the rows with words stand for: 40 toxic, 120 others ten times each
    for _ in range(25):
        text = " ".join(rng.choices([*vocabulary, "vile", "unknown"], k=12))
        v = vector(text)
        near = sorted(((-round(sum(x * u.get(w, 0.0) for w, x in v.items()), 12), i, y) for i, y, u in vectors))[: toxicity.NEIGHBOURS]
        near = [(-c, i, y) for c, i, y in near if c < 0]
        votes = np.array([1 / (max(0, 1 - c) + toxicity.SOFTEN) for c, _, _ in near])
        votes = votes / votes.max() * np.array([0.1 if y else 1.0 for _, _, y in near])
        want = (sum(w for w, (_, _, y) in zip(votes, near) if y) + toxicity.PRIOR_VOTES * share) / (votes.sum() + toxicity.PRIOR_VOTES)
        p, evidence, _ = index.score(text)
        assert abs(p - want) < 1e-6 and [e[0] for e in evidence] == [i for _, i, _ in near]
    curve = toxicity.calibration(toxicity.Sample(rows, frequency, 5_000), shares)
    assert (np.diff(curve[0]) >= 0).all() and (np.diff(curve[1]) >= 0).all() and 0 <= curve[1][0] <= curve[1][-1] <= 1
    assert toxicity.calibration(toxicity.Sample(rows[1:4], frequency, 5_000), shares) is None
    index.curve = curve
    raw = [toxicity.build(rows, frequency, 5_000, shares).score(t)[0] for _, t, _ in rows]
    assert np.allclose([index.score(t)[0] for _, t, _ in rows[:-1]], np.interp(raw[:-1], *curve))
    assert index.score("")[0] == index.score(None)[0] == raw[-1]


@pytest.mark.parametrize("seed", range(5))
def test_rising_curve_is_the_best_of_all(seed):
    """No partition of the points into runs with rising means fits better than the curve before it is drawn towards the mean."""
    rng = np.random.default_rng(seed)
    n = 9
    x, y, w = np.sort(rng.random(n)), rng.integers(0, 2, n).astype(float), rng.integers(1, 4, n).astype(float)
    best = None
    for cuts in itertools.product([0, 1], repeat=n - 1):
        edges = [0, *[i + 1 for i, c in enumerate(cuts) if c], n]
        means = [np.average(y[a:b], weights=w[a:b]) for a, b in zip(edges, edges[1:])]
        if all(p < q for p, q in zip(means, means[1:])):
            loss = sum((w[a:b] * (y[a:b] - m) ** 2).sum() for (a, b), m in zip(zip(edges, edges[1:]), means))
            if best is None or loss < best[0] - 1e-12:
                best = (loss, edges, means)
    places, heights = toxicity.rising(x, y, w)
    sums = [(w[a:b] * x[a:b]).sum() / w[a:b].sum() for a, b in zip(best[1], best[1][1:])]
    mean = np.average(y, weights=w)
    drawn = np.maximum.accumulate([(m * w[a:b].sum() + mean) / (w[a:b].sum() + 1) for (a, b), m in zip(zip(best[1], best[1][1:]), best[2])])
    assert np.allclose(places[1:-1], sums) and np.allclose(heights[1:-1], drawn)


# 5 suffix arrays


def covered(texts, least):
    ws = [WORDS.findall(t or "") for t in texts]
    seen = {}
    for w in ws:
        for k in range(len(w) - least + 1):
            key = tuple(w[k : k + least])
            seen[key] = seen.get(key, 0) + 1
    return [{x for k in range(len(w) - least + 1) if seen[tuple(w[k : k + least])] > 1 for x in range(k, k + least)} for w in ws]


def test_suffixes_equal_brute_force(spark):
    passage, other = words(70, 1, 10**6), words(55, 2, 10**6)
    texts = [" ".join(words(90, 100 + i, 10**6) + (passage if i % 3 == 0 else []) + words(40, 300 + i, 10**6) + (other if i % 4 == 0 else [])) for i in range(24)]
    texts += [texts[0], texts[1], None, "", "short one", " ".join(["again"] * 120), " ".join(words(300, 9, 10**6))]
    done = {r["doc_id"]: r for r in suffixes.clean(frame(spark, texts, "extra")).collect()}
    want = covered(texts, 50)
    for i, t in enumerate(texts):
        assert {x for s in done[i]["spans"] for x in range(s["start"], s["end"])} == want[i], i
    after = [done[i]["text"] for i in range(len(texts))]
    assert not any(covered(after, 50)) and after[26] is None and after[27] == "" and after[28] == "short one"
    kept = {w for t in after for w in WORDS.findall(t or "")}
    assert kept == {w for t in texts for w in WORDS.findall(t or "")}
    assert after[30] == texts[30] and done[30]["extra"] == "clash"


def test_suffixes_find_all_copies_around_foreign_leads(spark):
    """Earlier excerpts and lines hold k-grams of a passage without 50 words of it; copies end in different words, in any order."""
    passage = words(60, 21, 10**6)
    line = passage[24:36]
    texts = [" ".join(words(30, 400 + i, 10**6) + passage[i : i + 30] + words(30, 500 + i, 10**6)) for i in range(0, 31, 3)]
    texts += [" ".join(words(20, 600 + i, 10**6) + line + words(20, 700 + i, 10**6)) for i in range(20)]
    texts += [" ".join(words(10, 800 + i, 10**6) + passage[: 30 + i % 9] + ["edit"] + passage[31 + i % 9 :] + words(10, 900 + i, 10**6)) for i in range(20)]
    texts += [" ".join(words(i % 23, 1000 + i, 10**6) + passage[i % 4 : 60 - i % 5] + words(15, 1100 + i, 10**6)) for i in range(60)]
    done = {r["doc_id"]: r for r in suffixes.clean(frame(spark, texts)).collect()}
    seen, late = {}, [set() for _ in texts]
    for i, t in enumerate(texts):
        w = WORDS.findall(t)
        for k in range(len(w) - 49):
            if seen.setdefault(tuple(w[k : k + 50]), (i, k)) != (i, k):
                late[i].update(range(k, k + 50))
    want = covered(texts, 50)
    for i in range(len(texts)):
        assert {x for s in done[i]["spans"] for x in range(s["start"], s["end"])} == want[i], i
        assert {x for s in done[i]["removed"] for x in range(s["start"], s["end"])} == late[i], i
    assert sum(map(bool, late)) > 40


def first_windows(texts, least):
    """Words in any repeated window and words in a window that an earlier one repeats, by text."""
    ws, seen, late = [WORDS.findall(t or "") for t in texts], {}, [set() for _ in texts]
    for i, w in enumerate(ws):
        for k in range(len(w) - least + 1):
            if seen.setdefault(tuple(w[k : k + least]), (i, k)) != (i, k):
                late[i].update(range(k, k + least))
    return covered(texts, least), late


def places(rows):
    return {x for s in rows for x in range(s["start"], s["end"])}


@pytest.mark.parametrize("seed", [1, 2])
def test_suffixes_random_overlaps(spark, seed):
    """Passages that overlap in part, in three and more texts, next to each other, at both ends, repeated inside a text, and equal texts."""
    rng = random.Random(seed)
    pool, texts = [], []
    for i in range(90):
        w = []
        for _ in range(rng.randrange(1, 6)):
            if pool and rng.random() < 0.7:
                p = pool[rng.randrange(len(pool))]
                a = rng.randrange(len(p))
                w += p[a : a + rng.randrange(1, 40)]
            else:
                w += words(rng.randrange(1, 25), rng.random(), 300)
        pool.append(w)
        texts.append(" ".join(w))
    texts += [texts[3], texts[40], texts[40], " ".join(["line of words that stands here"] * 30), "", None]
    df = frame(spark, texts).repartition(5)
    done = {r["doc_id"]: r for r in suffixes.clean(df, least=12, gram=4).collect()}
    spans, late = first_windows(texts, 12)
    for i in range(len(texts)):
        assert places(done[i]["spans"]) == spans[i] and places(done[i]["removed"]) == late[i], i
    assert sum(map(bool, late)) > 40


def test_suffixes_of_long_texts_in_pieces(monkeypatch):
    texts = [" ".join(words(900, i, 50)) for i in range(4)] + ["", " \t ", "x" * 300, "a b\n\n" * 40]
    whole = suffixes.sparse_suffixes(texts, 50, 8)
    monkeypatch.setattr(suffixes, "PIECE_CHARS", 37)
    monkeypatch.setattr(suffixes, "PIECE_WORDS", 61)
    assert all((a == b).all() for a, b in zip(whole, suffixes.sparse_suffixes(texts, 50, 8))) and len(whole[1]) > 100


def test_suffixes_of_equal_surroundings_go_on_once():
    """A common passage and a word said again and again give a row a text and not one for each kept suffix."""
    passage = words(400, 31, 10**6)
    texts = [" ".join(words(60, 1200 + i, 10**6) + passage + ["again"] * 300) for i in range(20)]
    _, which, at, _, h = suffixes.sparse_suffixes(texts, 50, 8)
    often = np.unique(h[np.isin(h, [x for x, n in Counter(h.tolist()).items() if n > 1])]).astype(np.int64)
    batch = pa.RecordBatch.from_pydict({"_t": list(range(20)), "_id": list(range(100, 120)), "_x": texts, "_hs": [often.tolist()] * 20})
    rows = pd.concat([b.to_pandas() for b in suffixes.contexts(50, 8)(iter([batch]))])
    kept = np.isin(h.astype(np.int64), often)
    assert kept.sum() > 20 * 250 and len(rows) < 20 * 60
    assert rows["_s"].dropna().is_unique
    spans, late = first_windows(texts, 50)
    met = rows[rows["_s"].isna()]
    for i in range(20):
        own = met[met["_t"] == i]
        cover = lambda df: {x for a, b in zip(df["_from"].astype(int), df["_to"].astype(int)) for x in range(a, b)}
        assert cover(own) <= spans[i] and cover(own[own["_late"].astype(bool)]) <= late[i]
        assert (own["_id"] == 100 + i).all() and len(cover(own)) > 500 and (not i or len(cover(own[own["_late"].astype(bool)])) > 500)


def test_suffixes_odd_rows(spark, odd):
    more = odd
    for c in ("_row", "removed", "_spans", "_cut", "_key", "_key_first"):
        more = more.withColumn(c, F.lit("clash"))
    done = suffixes.clean(more)
    assert done.columns == more.columns and done.filter("_row = 'clash' and _cut = 'clash' and _key_first = 'clash' and _t = 'clash' and _id = 'clash'").count() == 7
    again = [r for r in done.collect() if r["doc_id"] == 4]
    assert len(again) == 2 and again[0] == again[1] and again[0]["removed"] == []
    assert suffixes.clean(empty(spark)).count() == 0
    long_ = " ".join(words(6000, 1))
    twice = spark.createDataFrame([(4, long_), (None, long_)], "doc_id long, text string")
    assert {r["doc_id"]: len(r["removed"]) for r in suffixes.clean(twice).collect()} == {4: 1, None: 0}


# 6 nearest neighbours


def test_neighbours_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((900, 16))
    x[500:520] = x[499]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16), (1004, [1.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.search(df, F.col("vec_id") % 50 == 0).collect()
    n = np.linalg.norm(x, axis=1)
    hit = total = 0
    for q in range(0, 900, 50):
        s = x @ x[q] / (n * n[q])
        s[q] = -9
        want = np.lexsort((np.arange(900), -np.round(s, 12)))[:5]
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5]
        assert all(abs(r["score"] - s[r["vec_id"]]) < 1e-12 for r in own)
        hit, total = hit + len(set(want) & {r["vec_id"] for r in own}), total + 5
        if q == 500:
            assert [r["vec_id"] for r in own] == [499, 501, 502, 503, 504]
    assert hit >= 0.9 * total
    few = neighbours.search(df.filter("vec_id < 3"), F.col("vec_id") == 0).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2]
    assert neighbours.search(df.filter("vec_id > 999"), F.lit(True)).count() in (0,)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_neighbours_recall_on_the_table_of_the_query(spark, sf):
    """The vectors of these tables have no clusters; recall is 0.9 or more, with less than half of the rows compared (of 500 vectors 56 %)."""
    path = f"/root/testdata/{sf}"
    if not os.path.isdir(path):
        pytest.skip("no test tables")
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding").collect() if r[1] and all(v is not None for v in r[1])]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in Q.op6_nearest_neighbours(spark, path).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    asked = np.flatnonzero(ids % 50 == 0)
    scores = x[asked] @ x.T
    scores[np.arange(len(asked)), asked] = -9
    want = ids[np.argsort(-scores, axis=1)[:, :5]]
    assert sum(len(got[int(ids[q])] & set(w.tolist())) for q, w in zip(asked, want)) >= 0.9 * want.size
    forest = neighbours.Forest(x, neighbours.TREES, max(1, min(len(x) // neighbours.LEAF, neighbours.LEAVES)), 3)
    share = forest.share_for(x, 5, neighbours.RECALL, neighbours.ASKED)
    leaves = forest.leaves_of(x)
    sizes = np.bincount(leaves.ravel(), minlength=forest.n_leaves)
    compared = [np.isin(leaves, forest.probes(m, sizes, share * len(x))).any(axis=1).mean() for m in forest.margins(x[asked])]
    assert np.mean(compared) < (0.5 if len(x) > 1000 else 0.6)


# 7 archives


def test_warc_round_trip(spark):
    html = ["<p>é</p>", "<p>é</p>", None, "", "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n", "line\nbreak " * 500, "<p>é</p>"]
    pages = spark.createDataFrame([(i, f"http://a/{i}\nb" if i else None, h, "clash") for i, h in enumerate(html)] + [(6, "http://again", "<p>é</p>", "clash")], "page_id long, url string, html string, payload string")
    raw, slim = scratch(spark, "warc"), scratch(spark, "warc")
    warc.write_archives(warc.responses(pages), raw, file_records=2)
    back = {r["page_id"]: r["payload"] for r in warc.read_archives(spark, raw).collect()}
    assert back == {i: h or "" for i, h in enumerate(html)}
    warc.dedup_archives(spark, raw, slim)
    got = {r["page_id"]: r for r in warc.resolved(spark, slim).collect()}
    assert [got[i]["record_type"] for i in range(7)] == ["revisit", "revisit", "revisit", "response", "response", "response", "response"]
    assert [got[i]["refers_to"] for i in range(4)] == [6, 6, 3, None]
    assert all(got[i]["payload_bytes"] == len((h or "").encode()) and got[i]["payload_digest"] == warc.digest((h or "").encode()) for i, h in enumerate(html))
    ids = [r["record_id"] for r in warc.read_archives(spark, slim, payloads=False).collect()]
    assert len(set(ids)) == len(ids) == 8
    again = {r["page_id"]: r["payload"] for r in warc.read_archives(spark, slim).filter("record_type = 'response'").collect()}
    assert again == {i: html[i] or "" for i in (3, 4, 5, 6)}
    none, out = scratch(spark, "warc"), scratch(spark, "warc")
    warc.write_archives(warc.responses(pages.limit(0)), none)
    warc.dedup_archives(spark, none, out)
    assert warc.resolved(spark, out).count() == 0


def test_warc_repeated_and_null_pages_have_records_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(warc, "BATCH_BYTES", 200)
    monkeypatch.setattr(warc, "UNPACK_BYTES", 7)
    pages = spark.createDataFrame([(1, "u", "a" * 900)] * 3 + [(None, "u", "a" * 900), (None, None, None), (2, "v", "b")], "page_id long, url string, html string")
    raw, slim = scratch(spark, "warc"), scratch(spark, "warc")
    warc.write_archives(warc.responses(pages), raw)
    warc.dedup_archives(spark, raw, slim)
    got = warc.read_archives(spark, slim).collect()
    assert len(got) == 6 == len({r["record_id"] for r in got})
    by = {r["record_id"]: r for r in got}
    back = [r for r in got if r["record_type"] == "revisit"]
    assert [(r["page_id"], by[r["refers_to_record"]]["page_id"]) for r in back] == [(None, 1)]
    assert sorted((r["page_id"] or 0, r["payload_bytes"], r["refers_to"]) for r in warc.resolved(spark, slim).collect() if r["record_type"] == "revisit") == [(0, 900, 1)]


# 8 near duplicates


def brute_components(texts, size, percent=80):
    low = [WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) for t in texts]
    sets = [set() if not w else {tuple(w)} if len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} for w in low]
    label = list(range(len(texts)))
    for _ in texts:
        for a, b in itertools.combinations(range(len(texts)), 2):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                label[a] = label[b] = min(label[a], label[b])
    return label, [len(s) for s in sets]


def test_minhash_equals_brute_force(spark):
    rng = random.Random(8)
    texts = []
    for g in range(12):
        base = words(rng.choice([3, 8, 40, 120]), g, 500)
        for k in range(5):
            w = list(base)
            for _ in range(k * len(w) // 40):
                w[rng.randrange(len(w))] = f"x{rng.randrange(999)}"
            texts.append(" ".join(w).upper() if k == 1 else " ".join(w))
    chain = words(100, 77, 10**6)
    texts += [" ".join(chain[4 * i : 4 * i + 60]) for i in range(9)]  # neighbours linked, ends not
    texts += [None, "", "one", "ONE", "One two", " \n"]
    want, sizes = brute_components(texts, 2)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(frame(spark, texts, "kept component_id"), size=2).collect()}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert all(got[i]["kept"] == (want[i] == i) for i in range(len(texts)))


def test_minhash_id_with_two_texts_reruns_alike(spark):
    rows = [(1, " ".join(words(60, 1))), (1, " ".join(words(60, 2))), (2, " ".join(words(60, 2))), (3, " ".join(words(60, 1)) + " more"), (1, " ".join(words(60, 1)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = (sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(x, size=2).collect()) for x in (df, df.repartition(3, "text")))
    assert one == two and len(one) == 5 and {c for i, _, c in one if i == 2} == {1}


def test_minhash_odd_rows(spark, odd):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == 7 and sum(r["doc_id"] == 4 for r in got) == 2
    assert all(r["component_id"] == r["doc_id"] and r["kept"] for r in got)
    assert minhash.near_duplicates(empty(spark)).count() == 0


# 9 mixing


def best_sum(sizes, counts, budget):
    sums = {0}
    for n, c in zip(sizes, counts):
        sums = {x + n * k for x in sums for k in range(c + 1) if x + n * k <= budget}
    return max(sums)


def test_fit_counts_against_brute_force():
    rng = random.Random(6)
    for most in (30, 30, 100_000):
        for _ in range(100):
            sizes = np.array(sorted(rng.sample(range(1, most), 4)))
            counts = np.array([rng.randrange(1, 4) for _ in sizes])
            budget = rng.randrange(0, int((sizes * counts).sum()) + 5)
            take = mixing.fit_counts(sizes, counts, budget)
            assert (take >= 0).all() and (take <= counts).all()
            assert int((sizes * take).sum()) == best_sum(sizes.tolist(), counts.tolist(), budget)
    fit = lambda sizes, counts, budget, **k: int((np.array(sizes) * mixing.fit_counts(np.array(sizes), np.array(counts), budget, **k)).sum())
    assert fit([70000, 80000, 90000], [1, 1, 1], 150000) == 150000 and fit([1, 120000], [10, 1], 120000) == 120000
    many = list(range(1, 400))
    for budget in (200, 50_001, 3_000_017):  # larger than the window: shares first, then the window
        assert fit(many, [60] * len(many), budget, window=1000) == budget


def test_coarse_sums_stay_within_the_budget(monkeypatch):
    monkeypatch.setattr(mixing, "DP_SUMS", 1000)
    sizes = np.arange(900, 1000)
    take = mixing.subset_sum(sizes, np.full(100, 3), 100_000)
    assert 90_000 <= int((sizes * take).sum()) <= 100_000 and (take <= 3).all()


def test_mix_meets_targets(spark, odd):
    rng = random.Random(2)
    rows = [(i, " ".join(words(rng.randrange(1, 60), i)), "en", [None, "a", "b", "c", "d"][min(4, i % 9)], 0) for i in range(500)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(df).collect()
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(df.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}
    source = {r[0]: r[3] for r in rows}
    size = {s: sum(r["size"] for r in got if source[r["doc_id"]] == s) for s in set(source.values())}
    target = {}
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_ = 1.5 * sum(size.values()), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * size[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * size[s] for s in full}
        left -= sum(2.0 * size[s] for s in full)
        open_ -= full
    for s in order:
        taken = sum(r["taken"] for r in got if source[r["doc_id"]] == s)
        assert abs(taken - target[s]) <= 1 and all(abs(r["target"] - target[s]) < 1e-6 for r in got if source[r["doc_id"]] == s)
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mix(odd).count() == 7 and mixing.mix(empty(spark)).count() == 0


# 10 languages


def test_language_paths_of_long_texts_stretch_by_stretch(monkeypatch):
    from lostfound.llm import langid

    rng = random.Random(31)
    pools = {"aa": ["tana", "rasa", "lima", "nasal"], "bb": ["wort", "durch", "schloss", "zwei"], "cc": ["мир", "дом", "река"]}
    model = langid.learn([(" ".join(rng.choices(p, k=40)), g) for g, p in pools.items() for _ in range(6)])
    texts = [" ".join(w for g in rng.choices(list(pools), k=rng.randrange(1, 6)) for w in rng.choices(pools[g], k=rng.randrange(1, 30))) for _ in range(30)] + [None, "", "42"]
    whole = langid.label(texts, model)
    words = langid.LETTERS.findall(" ".join(t for t in texts if t))
    path = langid.long_path(model, words)
    assert (path == langid.paths([model.scores_of(words)], model.prior)[0]).all() and (path == langid.long_path(model, words, cells=21)).all()
    for cells in (9, 60, 300):
        monkeypatch.setattr(langid, "CELLS", cells)
        assert langid.label(texts, model) == whole


def test_language_scores_equal_brute_force():
    """A word's score: twice the mean over its letters and the four n-gram lengths of the smoothed log-probability, less the best language's."""
    from lostfound.llm import langid

    samples = [("tana rasa lima", "aa"), ("wort durch zwei", "bb"), ("мир дом", "cc"), ("rasa tana", "aa")]
    model = langid.learn(samples)
    langs = ["aa", "bb", "cc"]
    grams = lambda w: langid._grams([w])[0].ravel().tolist()
    counts = {g: {} for g in langs}
    for t, g in samples:
        words = langid.LETTERS.findall(t)
        for k, row in enumerate(langid._grams(words)[0]):
            for slot in row:
                counts[g][slot] = counts[g].get(slot, 0) + 1
    logp = lambda g, s: np.log((counts[g].get(s, 0) + 0.5) / (sum(counts[g].values()) + 0.5 * langid.SLOTS))
    for w in ("tana", "zwei", "ra", "мир", "q"):
        cyrillic = w == "мир"
        want = np.array([sum(logp(g, s) for s in grams(w)) / 4 * 2 for g in langs])
        want = np.where([(g == "cc") == cyrillic for g in langs], want - want.max(), -40.0)
        assert np.allclose(model.word_scores([w])[0], want, atol=1e-3), w


def test_language_spans_and_viterbi(spark, odd):
    en = ["the cat and the dog of this house with that thing", "other words are there when they think about it"]
    de = ["der hund und die katze sind nicht über das haus", "schöne wörter gehören auch zu dieser sprache"]
    ru = ["это русский текст про кошку и собаку"]
    rng = random.Random(3)
    mix = lambda xs: " ".join(rng.choice(xs).split()[rng.randrange(5)] for _ in range(40))
    rows = [(i, mix((en, de, ru)[i % 3]), ("en", "de", "ru")[i % 3], "s", 0) for i in range(240)]
    df = spark.createDataFrame(rows, DOCS)
    model = langid.fit(df)
    got = {r["doc_id"]: r for r in langid.identify(df, model).collect()}
    out = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert sum(got[r[0]]["lang_pred"] == r[2] for r in out) >= 0.98 * len(out)
    both = langid.label([en[0] + ". " + de[0] + " " + de[1]], model)[0]
    assert both[0] == "de" and [s[0] for s in both[2]] == ["en", "de"]
    assert langid.label([None, "", "12 !?"], model) == [("und", 0.0, [])] * 3
    assert langid.identify(odd, langid.fit(empty(spark))).filter("lang_pred <> 'und'").count() == 0
    rng2 = np.random.default_rng(1)
    scores = [rng2.standard_normal((n, 3)) * 4 for n in (1, 4, 6)]
    prior = np.log(np.array([0.5, 0.3, 0.2]))
    for s, p in zip(scores, langid.paths(scores, prior, 2.0)):
        value = lambda q, s=s: prior[q[0]] + sum(s[i, k] for i, k in enumerate(q)) - 2.0 * sum(a != b for a, b in zip(q, q[1:]))
        assert abs(value(p) - max(value(q) for q in itertools.product(range(3), repeat=len(s)))) < 1e-9


# the pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    docs, labels, quality, _ = labelled(spark, 120)
    shared = " ".join(words(60, 5, 10**6))
    more = spark.createDataFrame([(1000 + i, " ".join(words(120, 5000 + i, 3000)) + " " + shared, "en", "s1", 9) for i in range(5)] + [(2000, " ".join(words(120, 5000, 3000)) + " " + shared, "en", "s1", 9), (3000, None, None, None, None)], DOCS)
    d = str(tmp_path)
    for c in ("_id", "_place", "_size", "_copy", "_key", "_found", "repeats", "spans"):
        docs, more = docs.withColumn(c, F.lit("clash")), more.withColumn(c, F.lit("clash"))
    docs.unionByName(more).write.parquet(f"{d}/documents.parquet")
    labels.write.parquet(f"{d}/labels.parquet")
    now, seen = spark.read.parquet(f"{d}/documents.parquet"), {}
    for i, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, now, d)
        if i < len(P.STAGES) - 1:
            assert out.columns == now.columns
        out.write.parquet(f"{d}/{i}")
        now = spark.read.parquet(f"{d}/{i}")
        seen[name] = now.collect()
    ids = lambda k: {r["doc_id"] for r in seen[k]}
    assert not any(not quality[i] for i in ids("quality_classifier") if i < 1000) and 3000 in ids("quality_classifier")
    assert 2000 not in ids("minhash_near_dedup") and 1000 in ids("minhash_near_dedup")
    # each stage against brute force on what the one before kept
    before = sorted(seen["quality_classifier"], key=lambda r: r["doc_id"])
    sets = [set(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else {tuple(w)} if w else set() for w in (WORDS.findall((r["text"] or "").lower()) for r in before)]
    root = list(range(len(sets)))
    for _ in range(3):
        for i, j in itertools.combinations(range(len(sets)), 2):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[i] = root[j] = min(root[i], root[j])
    assert ids("minhash_near_dedup") == {r["doc_id"] for i, r in enumerate(before) if root[i] == i}
    before = sorted(seen["minhash_near_dedup"], key=lambda r: r["doc_id"])
    _, late = first_windows([r["text"] for r in before], 50)
    after = {r["doc_id"]: r for r in seen["suffix_array_dedup"]}
    for r, gone in zip(before, late):
        assert WORDS.findall(after[r["doc_id"]]["text"] or "") == [w for i, w in enumerate(WORDS.findall(r["text"] or "")) if i not in gone]
    assert all(r["_place"] == r["_id"] == r["_copy"] == "clash" for r in seen["source_mixing"])
    want = {(r["doc_id"], r["taken"]) for r in mixing.mix(spark.createDataFrame([(r["doc_id"], r["text"], r["source"]) for r in after.values()], "doc_id long, text string, source string")).filter("taken > 0").select("doc_id", "taken").collect()}
    took = {}
    for r in seen["source_mixing"]:
        took[r["doc_id"]] = took.get(r["doc_id"], 0) + len(WORDS.findall(r["text"]))
    assert set(took.items()) == want
    assert sum(shared in (r["text"] or "") for r in seen["suffix_array_dedup"]) == 1
    assert max(sum(r["doc_id"] == i for r in seen["source_mixing"]) for i in ids("source_mixing")) <= 2
    packed = seen["best_fit_packing"]
    ids = [packing.unpacked_ids(r["ids_zstd"]) for r in packed]
    assert all(zlib.crc32(b) == r["ids_crc32"] and len(b) == 4 * r["length"] for b, r in zip(ids, packed))
    mixed = sorted(t or "" for t in (r["text"] for r in seen["source_mixing"]))
    want = sum(len(x) // 4 for x in packing._encode(mixed, "word_bpe_49k.json"))
    assert sum(r["length"] for r in packed) == want > 0
    empty(spark).write.parquet(f"{d}/none/documents.parquet")
    labels.limit(0).write.parquet(f"{d}/none/labels.parquet")
    assert P.run(spark, f"{d}/none").count() == 0
