"""License scan: ordered signature rules behind a keyword gate, overlaps resolved by priority and containment (operator 13).

Rules are regular expressions over the words of a text, one space around each. They come from forms written by hand (identifier, name with
version, "or later", address, short name, bare name) over a table of licenses with their names and versions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_names

#: Bytes that separate words; everything else is part of one.
BREAKS = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
SPACED = bytes.maketrans(BREAKS, b" " * len(BREAKS))

# Phrases and labels that every scan counts, whatever the rules say.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Licenses by identifier stem, with the words of their names, short names, address and versions.
LICENSES = [
    # stem, gate word, name, short name, address, versions, named in notices
    ("gpl", "gnu", "gnu general public licen[cs]e", "gnu gpl|gpl", "gnu org (?:copyleft|licenses(?: old licenses)?) gpl", "1.0 2.0 3.0", True),
    ("lgpl", "gnu", "gnu (?:lesser|library) general public licen[cs]e", "gnu lgpl|lgpl", "gnu org licenses(?: old licenses)? lgpl", "2.0 2.1 3.0", True),
    ("agpl", "gnu", "gnu affero general public licen[cs]e", "gnu agpl|agpl", "gnu org licenses agpl", "1.0 3.0", True),
    ("gfdl", "gnu", "gnu free documentation licen[cs]e", "gnu fdl|gfdl", "gnu org licenses fdl", "1.1 1.2 1.3", True),
    ("apache", "apache", "apache(?: software)? licen[cs]e", "apache|asl", "apache org licenses license", "1.0 1.1 2.0", True),
    ("mpl", "mozilla", "mozilla public licen[cs]e", "mpl", "mozilla org mpl", "1.0 1.1 2.0", True),
    ("epl", "eclipse", "eclipse public licen[cs]e", "epl", "eclipse org legal epl", "1.0 2.0", True),
    ("cpl", "common", "common public licen[cs]e", "cpl", "opensource org licenses cpl", "1.0", True),
    ("cddl", "distribution", "common development and distribution licen[cs]e", "cddl", "opensource org licenses cddl", "1.0 1.1", True),
    ("eupl", "european", "european union public licen[cs]e", "eupl", "joinup ec europa eu licence eupl", "1.0 1.1 1.2", True),
    ("artistic", "artistic", "artistic licen[cs]e", "artistic", "opensource org licenses artistic", "1.0 2.0", True),
    ("osl", "open", "open software licen[cs]e", "osl", "opensource org licenses osl", "1.0 2.0 2.1 3.0", True),
    ("afl", "academic", "academic free licen[cs]e", "afl", "opensource org licenses afl", "1.1 1.2 2.0 2.1 3.0", True),
    ("bsl", "boost", "boost software licen[cs]e", "bsl", "boost org license", "1.0", True),
    ("ofl", "sil", "sil open font licen[cs]e", "sil ofl|ofl", "scripts sil org ofl", "1.0 1.1", True),
    ("zpl", "zope", "zope public licen[cs]e", "zpl", "opensource org licenses zpl", "1.1 2.0 2.1", True),
    ("lppl", "latex", "latex project public licen[cs]e", "lppl", "latex project org lppl", "1.0 1.1 1.2 1.3", True),
    ("apsl", "apple", "apple public source licen[cs]e", "apsl", "opensource apple com apsl", "1.0 1.1 1.2 2.0", True),
    ("cecill", "cecill", "cecill(?: free software)? licen[cs]e", "cecill", "cecill info licences licence cecill", "1.0 1.1 2.0 2.1", True),
    ("odbl", "database", "open database licen[cs]e", "odbl", "opendatacommons org licenses odbl", "1.0", True),
    ("ms-pl", "microsoft", "microsoft public licen[cs]e", "ms pl", "opensource org licenses ms pl", "", True),
    ("ms-rl", "microsoft", "microsoft reciprocal licen[cs]e", "ms rl", "opensource org licenses ms rl", "", True),
    ("mit", "mit", "(?:the )?mit(?: x11)? licen[cs]e", "mit", "opensource org licenses mit", "", True),
    ("bsd-2-clause", "bsd", "(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd)(?: licen[cs]e)?", "bsd 2", "opensource org licenses bsd 2 clause", "", True),
    ("bsd-3-clause", "bsd", "(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: licen[cs]e)?", "bsd 3", "opensource org licenses bsd 3 clause", "", True),
    ("bsd-4-clause", "bsd", "(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd)(?: licen[cs]e)?", "bsd 4", "directory fsf org wiki license bsd 4clause", "", True),
    ("bsd", "bsd", "bsd(?: style)? licen[cs]e", "bsd", "opensource org licenses bsd license", "", True),
    ("isc", "isc", "isc licen[cs]e", "isc", "opensource org licenses isc", "", True),
    ("zlib", "zlib", "zlib(?: libpng)? licen[cs]e", "zlib", "opensource org licenses zlib", "", True),
    ("unlicense", "unlicense", "(?:the )?unlicense", "unlicense", "unlicense org", "", True),
    ("wtfpl", "wtfpl", "wtfpl(?: licen[cs]e)?", "wtfpl", "wtfpl net", "", True),
    ("postgresql", "postgresql", "postgresql licen[cs]e", "postgresql", "opensource org licenses postgresql", "", True),
    ("psf", "python", "python software foundation licen[cs]e", "psf", "docs python org license", "2.0", True),
    ("ruby", "ruby", "ruby licen[cs]e", "ruby", "ruby lang org en about license", "", True),
    ("php", "php", "php licen[cs]e", "php", "php net license", "3.0 3.01", True),
    ("openssl", "openssl", "openssl licen[cs]e", "openssl", "openssl org source license", "", True),
    ("vim", "vim", "vim licen[cs]e", "vim", "vimhelp org uganda", "", True),
    ("cc0", "cc0", "(?:creative commons )?cc0", "cc0", "creativecommons org publicdomain zero", "1.0", False),
    ("public-domain-mark", "mark", "public domain mark", "pdm", "creativecommons org publicdomain mark", "1.0", False),
]
# Other names, with gate word and pattern.
OTHER_NAMES = [
    ("mit", "expat", "expat licen[cs]e"),
    ("bsd-2-clause", "freebsd", "freebsd licen[cs]e"),
    ("wtfpl", "fuck", "do what the fuck you want to public licen[cs]e"),
    ("cc0", "zero", "creative commons zero"),
]
# The parts of the Creative Commons licenses and their versions.
CC_PARTS = {"by": "attribution", "by-sa": "attribution share ?alike", "by-nc": "attribution non ?commercial", "by-nd": "attribution no ?deriv(?:s|atives|ative works)?", "by-nc-sa": "attribution non ?commercial share ?alike", "by-nc-nd": "attribution non ?commercial no ?deriv(?:s|atives|ative works)?"}
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
# Notices that name no license.
NOTICES = [
    ("all-rights-reserved", "rights", "all rights reserved"),
    ("public-domain", "domain", "(?:in|into|to) the public domain|public domain dedication|dedicated to the public domain"),
    ("proprietary", "proprietary", "proprietary and confidential|proprietary licen[cs]e|proprietary software"),
    ("copyright", "copyright", "copyright (?:c )?(?:19|20)[0-9][0-9]"),
    ("warranty-disclaimer", "warranty", "without warranty of any kind|without any warranty"),
    ("permissive-grant", "granted", "permission is hereby granted free of charge"),
    ("bsd-grant", "redistribution", "redistribution and use in source and binary forms"),
    ("non-commercial", "commercial", "for non ?commercial (?:use|purposes) only"),
    ("no-derivatives", "derivative", "no derivative works"),
    ("creative-commons", "creative", "creative commons licen[cs]e"),
]


class Rule(NamedTuple):
    """``gate`` is a word that every match holds; of two matches one inside the other, that of the larger ``priority`` counts, then the longer, then the earlier rule."""

    name: str
    label: str
    gate: bytes
    pattern: re.Pattern[bytes]
    priority: int
    confidence: float


def rule(name: str, label: str, gate: str, pattern: str, priority: int, confidence: float) -> Rule:
    return Rule(name, label, gate.encode(), re.compile(f"(?<= )(?:{pattern})(?= )".encode()), priority, confidence)


def version_words(version: str) -> str:
    """``2.0`` as it may stand among words: 2 0, 2, v2, version 2 0."""
    major, _, minor = version.partition(".")
    tail = f"(?: {minor})?" if minor == "0" else f" {minor}"
    return f"(?:version v?|ver |v )?v?{major}{tail}"


@cache
def signatures() -> tuple[Rule, ...]:
    """All rules, in order."""
    out = []
    add = lambda *x: out.append(rule(*x))
    for stem, gate, name, short, address, versions, notice in LICENSES:
        tag = stem.replace("-", " ")
        add(f"{stem}/id", stem, "spdx", f"spdx license identifier {tag}", 80, 0.95)
        add(f"{stem}/address", stem, address.split(" ")[0].replace("(?:", ""), address, 60, 0.85)
        add(f"{stem}/name", stem, gate, name, 40, 0.75)
        if notice:
            for i, s in enumerate(short.split("|")):
                add(f"{stem}/licensed-{i}", stem, s.split(" ")[0], f"(?:licen[cs]ed under|released under|distributed under|terms of)(?: the)? (?:{s})(?!(?: software)? licen[cs]e)(?! (?:version |v )?v?[0-9])", 45, 0.8)
        for v in versions.split():
            words = version_words(v)
            add(f"{stem}-{v}/id", f"{stem}-{v}", "spdx", f"spdx license identifier {tag} {v.replace('.', ' ')}(?: only)?", 90, 0.98)
            add(f"{stem}-{v}/id-later", f"{stem}-{v}-or-later", "spdx", f"spdx license identifier {tag} {v.replace('.', ' ')} or later", 95, 0.98)
            add(f"{stem}-{v}/name", f"{stem}-{v}", gate, f"(?:{name}) {words}", 70, 0.95)
            later = f"{words}(?: of the licen[cs]e)? or (?:at your option )?(?:any )?later(?: version)?"
            add(f"{stem}-{v}/name-later", f"{stem}-{v}-or-later", gate, f"(?:{name}) {later}", 85, 0.95)
            add(f"{stem}-{v}/address", f"{stem}-{v}", address.split(" ")[0].replace("(?:", ""), f"(?:{address}) {v.replace('.', ' ')}", 75, 0.9)
            for i, s in enumerate(short.split("|")):
                add(f"{stem}-{v}/short-{i}", f"{stem}-{v}", s.split(" ")[0], f"(?:{s}) {words}", 50, 0.8)
                if " " not in s:
                    for glued in (f"{s}v{v[0]}", f"{s}{v[0]}"):
                        tail = f" {v[2:]}" if v[2:] != "0" else "(?: 0)?"
                        add(f"{stem}-{v}/{glued}", f"{stem}-{v}", glued, f"{glued}{tail}", 50, 0.75)
    for label, gate, pattern in OTHER_NAMES:
        add(f"{label}/{gate}", label, gate, pattern, 40, 0.75)
    for part, name in CC_PARTS.items():
        tag = part.replace("-", " ")
        add(f"cc-{part}/short", f"cc-{part}", "cc", f"cc {tag}", 30 + len(part), 0.7)
        add(f"cc-{part}/name", f"cc-{part}", "creative", f"creative commons {name}", 40 + len(part), 0.8)
        for v in CC_VERSIONS:
            words, own = version_words(v), f"cc-{part}-{v}"
            add(f"{own}/id", own, "spdx", f"spdx license identifier cc {tag} {v.replace('.', ' ')}", 90, 0.98)
            add(f"{own}/short", own, "cc", f"cc {tag} {words}(?: international| unported| generic)?", 60 + len(part), 0.9)
            add(f"{own}/name", own, "creative", f"creative commons {name} {words}(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?", 70 + len(part), 0.95)
            add(f"{own}/address", own, "creativecommons", f"creativecommons org licenses {tag} {v.replace('.', ' ')}", 75 + len(part), 0.95)
    for label, gate, pattern in NOTICES:
        add(f"notice/{label}", label, gate, pattern, 10, 0.4)
    return tuple(out)


#: Confidence of a label that a phrase of ``BASE`` gives.
BASE_CONFIDENCE = 0.7
PHRASES = [(re.compile(f"(?<= ){p}(?= )".encode()), p.split(" ")[0].encode(), label) for p, label in BASE.items()]


@cache
def gates() -> tuple[dict[bytes, list[int]], list[bytes]]:
    """Rules by gate word, and all gate words with those of the base phrases."""
    by: dict[bytes, list[int]] = {}
    for i, r in enumerate(signatures()):
        by.setdefault(r.gate, []).append(i)
    return by, sorted({*by, *[g for _, g, _ in PHRASES]})


def resolved(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Matches (start, end, rule) that stand inside no other of larger priority, or of equal priority and longer or earlier in the rules; in order of start."""
    rules = signatures()
    reach: dict[int, int] = {}
    kept = []
    for start, end, i in sorted(found, key=lambda x: (x[0], -x[1], -rules[x[2]].priority, x[2])):
        own = rules[i].priority
        # all that begins at or before it and ends at or after it came earlier in this order
        if not any(e >= end for p, e in reach.items() if p >= own):
            kept.append((start, end, i))
        reach[own] = max(reach.get(own, 0), end)
    return kept


class Found(NamedTuple):
    n_words: int
    base: list[tuple[int, str]]
    detections: list[tuple[str, str, int, int, float]]


def scanned(text: str | None) -> Found:
    """Words of a text, base phrases as (word, label), and what the rules detect as (rule, label, first word, words, confidence)."""
    low = (text if isinstance(text, str) else "").encode("utf-8", "surrogatepass").lower()
    by, words = gates()
    spaced = low.translate(SPACED)
    if not any(g in low for g in words):
        inside = np.frombuffer(spaced, dtype=np.uint8) != 0x20
        return Found(int(np.count_nonzero(inside[1:] & ~inside[:-1]) + (len(inside) > 0 and bool(inside[0]))), [], [])
    parts = spaced.split()
    there = set(parts).intersection(words)
    if not there:
        return Found(len(parts), [], [])
    plain = b" " + b" ".join(parts) + b" "
    spaces = np.flatnonzero(np.frombuffer(plain, dtype=np.uint8) == 0x20)
    word = lambda at: int(np.searchsorted(spaces, at)) - 1
    base = [(word(m.start()), label) for p, gate, label in PHRASES if gate in there for m in p.finditer(plain)]
    rules = signatures()
    hits = [(m.start(), m.end(), i) for g in sorted(there) for i in by.get(g, ()) for m in rules[i].pattern.finditer(plain)]
    return Found(len(parts), base, [(rules[i].name, rules[i].label, word(a), word(b) - word(a) + 1, rules[i].confidence) for a, b, i in resolved(hits)])


RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<rule: string, label: string, first_word: long, n_words: long, confidence: double>>"


def scan(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_base (places of base phrases), first_word and last_word (their smallest and largest start), base_labels, labels, score and ``detections``.

    Labels are distinct, sorted and joined by commas; those of the base phrases always stay, the rules add theirs. The score is the largest confidence of a label, 0
    without one. A null or empty text has no words, no labels (empty strings) and null places. A text is read whole, in its row's task, without a
    shuffle; memory follows the longest text. Rows that repeat get the same. All other columns are kept, those of these names replaced; an empty table stays empty.
    """

    @F.pandas_udf(RESULT)
    def detect(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in texts:
            rows = []
            for n, base, found in map(scanned, t):
                places = [at for at, _ in base]
                own, more = {x for _, x in base}, {x[1] for x in found}
                score = max([*[x[4] for x in found], *[BASE_CONFIDENCE] * bool(base)], default=0.0)
                rows.append((n, len(base), min(places, default=None), max(places, default=None), ",".join(sorted(own)), ",".join(sorted(own | more)), score, [{"rule": a, "label": b, "first_word": c, "n_words": d, "confidence": e} for a, b, c, d, e in found]))
            out = pd.DataFrame(rows, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"])
            yield out.astype({"first_word": "Int64", "last_word": "Int64"})

    (found,) = fresh_names(docs, "found")
    got = docs.withColumn(found, detect(F.col(text)))
    return got.withColumns({c: F.col(f"{found}.{c}") for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")}).drop(found)
