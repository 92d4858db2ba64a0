"""Many patterns looked for at once, by one automaton (a trie with failure links).

The automaton is built once on the driver and goes to the executors with the function; a task runs it once for each distinct value of a
batch, and what it costs depends on the value's length, not on the number of patterns. Nothing is shuffled.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as T

CONTAINS, STARTS, EXACT = "contains", "startsWith", "exactMatch"


class FirstMatch:
    """Finds the first pattern of a list that fits a value. A pattern is (text, kind); an unknown kind means STARTS."""

    def __init__(self, patterns: list[tuple[str, str]]):
        self.exact: dict[str, int] = {}
        self.always = len(patterns)  # the first pattern that fits any value
        anywhere: dict[str, int] = {}
        at_start: dict[str, int] = {}
        for rank, (text, kind) in enumerate(patterns):
            if kind == EXACT:
                self.exact.setdefault(text, rank)
            elif text == "":
                self.always = min(self.always, rank)
            else:
                (anywhere if kind == CONTAINS else at_start).setdefault(text, rank)
        self.none = len(patterns)
        self.words = ahocorasick.Automaton()
        for text in anywhere.keys() | at_start.keys():
            self.words.add_word(text, (len(text), anywhere.get(text, self.none), at_start.get(text, self.none)))
        self.words.make_automaton()

    def rank(self, value: str) -> int:
        """The place of the first pattern that fits, or how many patterns there are."""
        best = min(self.always, self.exact.get(value, self.none))
        if len(self.words):
            for end, (length, anywhere, at_start) in self.words.iter(value):
                best = min(best, anywhere)
                if end + 1 == length:
                    best = min(best, at_start)
        return best

    def ranks(self, values: pd.Series) -> np.ndarray:
        """The ranks of many values, each distinct one looked at once; of null, as of none."""
        codes, distinct = pd.factorize(values)
        found = np.array([self.rank(v) for v in distinct] + [self.none])
        return found[codes]  # a null has code -1, the last place


def first_match(column: Column, patterns: list[tuple[str, str]]) -> Column:
    """The place of the first pattern that fits a column, null where none does."""
    finder = FirstMatch(patterns)

    @F.pandas_udf("int")
    def rank(values: pd.Series) -> pd.Series:
        return pd.Series(finder.ranks(values))

    return F.nullif(rank(column), F.lit(len(patterns)))


def classify_many(path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """A struct of segment, segment_match and taxonomy, as logs.classify says them, for any number of rules (path, match type, name)."""
    ordered = sorted(rules, key=lambda r: -len(r[0].encode()))
    finder = FirstMatch([(p, m) for p, m, _ in ordered])
    columns = {
        "segment": np.array([n for _, _, n in ordered] + ["Other"], object),
        "segment_match": np.array([m for _, m, _ in ordered] + [None], object),
        "taxonomy": np.array([p for p, _, _ in ordered] + ["other"], object),
    }

    @F.pandas_udf("struct<segment:string,segment_match:string,taxonomy:string>")
    def found(values: pd.Series) -> pd.DataFrame:
        ranks = finder.ranks(values)
        return pd.DataFrame({k: v[ranks] for k, v in columns.items()})

    return found(path)


def detect_bot(ua: Column) -> Column:
    """logs.detect_bot by automaton: for values that are too many to be told apart first."""
    low = F.lower(ua)
    names, words = [n for _, n in T.BOTS], list(T.GENERIC_BOTS)
    rank = first_match(low, [(k, CONTAINS) for k in [*[k for k, _ in T.BOTS], *words]])
    pick = lambda values, i: F.try_element_at(F.array(*map(F.lit, values)), i)
    word = pick(words, F.when(rank >= len(names), rank - len(names) + 1))
    token = F.regexp_substr(ua, F.concat(F.lit(r"(?i)[\p{L}\p{N}/]*?"), word, F.lit(r"[^ ;)\"]*")))
    blank = ua.isNull() | F.trim(ua).isin("-", "")
    return F.when(blank, "No User Agent").otherwise(F.coalesce(pick(names, F.when(rank < len(names), rank + 1)), token, F.lit("Human")))


def browser(ua: Column) -> Column:
    """logs.browser by automaton."""
    words = list(T.BROWSERS)
    rank = first_match(F.lower(ua), [(k, CONTAINS) for k in words])
    word = F.try_element_at(F.array(*map(F.lit, words)), rank + 1)
    token = F.regexp_substr(ua, F.concat(F.lit(r"(?i)[\p{L}\p{N}/]*?"), word, F.lit(r"[^ ;)\"]*")))
    return F.coalesce(F.split_part(token, F.lit("/"), F.lit(1)), F.lit("Other"))
