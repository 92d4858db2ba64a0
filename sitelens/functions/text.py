"""Column functions of texts."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

VOWELS = re.compile("[aeiou][aeiou]?")
#: A word has a letter or digit.
WORD = r"(?U)\S*[\p{L}\p{N}]\S*"
ENDS = r"[.!?؟۔…]+"


def word_count(c: Column) -> Column:
    """Words between white space that have a letter or a digit."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(WORD))


def sentence_count(c: Column) -> Column:
    """Runs of terminators, or 1 for a text with words but without any; 0 for one without words."""
    n = F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"(?U)[\p{L}\p{N}][^.!?؟۔…]*[.!?؟۔…]|[\p{L}\p{N}][^.!?؟۔…]*$"))
    return n


@F.pandas_udf(DoubleType())
def flesch(texts: pd.Series) -> pd.Series:
    """Reading ease; null without words. Sentences are the pieces between . ! and ?; a vowel counts unless the letter before it
    counted, and a final e is taken off where more than one counts."""

    def score(text: str | None) -> float | None:
        words = (text or "").lower().split()
        if not words:
            return None
        total = 0
        for w in words:
            n = len(VOWELS.findall(w))
            total += n - (w.endswith("e") and n > 1)
        return 206.835 - 1.015 * (len(words) / len(re.split(r"[.!?]", text))) - 84.6 * (total / len(words))

    return texts.map(score)


def flesch_class(score: Column) -> Column:
    return F.when(score >= 90, "Very Easy").when(score >= 80, "Easy").when(score >= 70, "Fairly Easy").when(score >= 60, "Standard").when(score >= 50, "Fairly Difficult").when(score >= 30, "Difficult").otherwise("Very Difficult")


def scoreable(c: Column, lang: Column) -> Column:
    """Whether readability means anything: declared English or nothing, and half of the letters are a-z."""
    letters, latin = F.regexp_count(c, F.lit(r"\p{L}")), F.regexp_count(c, F.lit("[A-Za-z]"))
    primary = F.lower(F.regexp_extract(F.coalesce(lang, F.lit("")), "^([^-_]*)", 1))
    return primary.isin("", "en") & (letters > 0) & (latin >= letters * 0.5)


def reading_time(n_words: Column, wpm: int = 200) -> Column:
    return F.ceil(n_words / wpm)


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words; none where there are fewer."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def plain_words(c: Column) -> Column:
    """Lower-case words of letters and digits only."""
    return F.filter(F.transform(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", "")), lambda w: w != "")


@F.pandas_udf(LongType())
def simhash(words: pd.Series) -> pd.Series:
    """64-bit SimHash (by xxhash64) of three-word shingles, or of the whole text if it has fewer words; 0 without words."""
    out = np.zeros(len(words), np.int64)
    for i, w in enumerate(words):
        if w is not None and len(w):
            w = list(w)
            shingles = [" ".join(w[j : j + 3]) for j in range(max(1, len(w) - 2))]
            hashes = np.array([xxhash.xxh64_intdigest(x) for x in shingles], "<u8")
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            out[i] = np.packbits(bits.sum(axis=0) * 2 > len(shingles), bitorder="little").view("<i8")[0]
    return pd.Series(out)


def text_ratio(text_bytes: Column, html_bytes: Column) -> Column:
    return F.when(html_bytes > 0, text_bytes * 100.0 / html_bytes).otherwise(F.lit(0.0))


def html_kb(html: Column) -> Column:
    return F.floor(F.octet_length(html) / 1024)


def reading_level(c: Column) -> Column:
    """Reading ease of a single page's text: y is a vowel, a run of vowels is a syllable, a final e is none where there are others, and
    each word has one at least. Pieces between . ! ? are sentences, one after the last only if anything is there. Null without words."""
    low = F.lower(c)
    n = lambda x, pattern: F.regexp_count(x, F.lit(pattern))
    mute = n(low, r"(?U)[aeiouy][^\saeiouy]++[aeiouy]*e(?!\S)")  # words that end in an e after another syllable
    voiced = n(low, r"(?U)[aeiouy]\S*+")  # words with a vowel
    words = n(low, r"(?U)\S+")
    sentences = n(c, "[.!?]") + F.when(c.rlike("[^.!?]$") | c.endswith("\n"), 1).otherwise(0)
    counts = F.struct(words.alias("words"), (n(low, "[aeiouy]+") - mute - voiced).alias("more"), sentences.alias("sentences"))
    score = lambda r: F.when(r["words"] > 0, 206.835 - 1.015 * (r["words"] / r["sentences"]) - 84.6 * ((r["words"] + r["more"]) / r["words"]))
    return F.transform(F.array(counts), score)[0]  # so that a text is counted once


def reading_class(score: Column) -> Column:
    """The class of a reading level; scores between two classes' ends, or beyond them, are Unknown."""
    out = F.when(score.between(90, 100), "Very Easy")
    for low, high, name in ((80, 89.9, "Easy"), (70, 79.9, "Fairly Easy"), (60, 69.9, "Standard"), (50, 59.9, "Fairly Difficult"), (30, 49.9, "Difficult"), (0, 29.9, "Very Confusing")):
        out = out.when(score.between(low, high), name)
    return out.otherwise("Unknown")


def heading_text(*levels: Column) -> Column:
    """Words of all headings, lower case, of letters and digits only, with one space between; empty without any."""
    headings = F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in levels])
    return F.array_join(plain_words(F.array_join(headings, " ")), " ")


def heading_hash(*levels: Column) -> Column:
    """A hash of the headings' words, null where there are none."""
    return F.md5(F.nullif(heading_text(*levels), F.lit("")))
