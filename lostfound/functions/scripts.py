"""Transliteration of Indic scripts to Latin."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The shared layout of the Unicode blocks of the Indian scripts. Each block has 128 places; a letter has the same
# place in all of them. Consonants carry an inherent "a" unless a vowel sign or the virama follows.
BLOCKS = (0x0900, 0x0980, 0x0A00, 0x0A80, 0x0B00, 0x0B80, 0x0C00, 0x0C80, 0x0D00)
VOWELS = {0x05: "a", 0x06: "aa", 0x07: "i", 0x08: "ee", 0x09: "u", 0x0A: "oo", 0x0B: "ri", 0x0F: "e", 0x10: "ai", 0x13: "o", 0x14: "au"}
SIGNS = {0x3E: "aa", 0x3F: "i", 0x40: "ee", 0x41: "u", 0x42: "oo", 0x43: "ri", 0x47: "e", 0x48: "ai", 0x4B: "o", 0x4C: "au"}
CONSONANTS = {
    0x15: "k", 0x16: "kh", 0x17: "g", 0x18: "gh", 0x19: "n", 0x1A: "ch", 0x1B: "chh", 0x1C: "j", 0x1D: "jh", 0x1E: "n",
    0x1F: "t", 0x20: "th", 0x21: "d", 0x22: "dh", 0x23: "n", 0x24: "t", 0x25: "th", 0x26: "d", 0x27: "dh", 0x28: "n",
    0x2A: "p", 0x2B: "ph", 0x2C: "b", 0x2D: "bh", 0x2E: "m", 0x2F: "y", 0x30: "r", 0x32: "l", 0x33: "l", 0x35: "v",
    0x36: "sh", 0x37: "sh", 0x38: "s", 0x39: "h",
}
VIRAMA, NASALS = 0x4D, {0x01: "n", 0x02: "n", 0x03: "h"}


def latin(text: str | None) -> str | None:
    """Latin spelling of a text; letters of no Indian block stay. The inherent vowel at a word's end is silent."""
    if not isinstance(text, str):
        return None
    out: list[str] = []
    open_ = False  # a consonant whose vowel is not settled
    for ch in text:
        point = ord(ch)
        place = point & 0x7F if any(b <= point < b + 0x80 for b in BLOCKS) else None
        if place in SIGNS or place == VIRAMA:
            out.append(SIGNS.get(place, ""))
            open_ = False
            continue
        if open_ and place is not None and (place in CONSONANTS or place in VOWELS or place in NASALS):
            out.append("a")
        open_ = place in CONSONANTS
        out.append(CONSONANTS.get(place) or VOWELS.get(place) or NASALS.get(place) or (ch if place is None else ""))
    return "".join(out)


def _batch(names: pd.Series) -> pd.Series:
    return names.map(latin)


def transliterate(name: Column | str) -> Column:
    """Indic script to Latin, batch by batch; Latin text passes through."""
    return F.pandas_udf(_batch, "string")(name)
