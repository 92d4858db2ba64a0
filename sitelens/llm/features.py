"""Dense statistics of whole documents, for the classifiers."""

from __future__ import annotations

import numpy as np

from .common import LOWER, SPACE, mix, word_hashes, words

UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
PUNCT = ~(LETTER | DIGIT | SPACE)
PUNCT[:32] = PUNCT[127] = False
#: Symbols that prose seldom has.
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#$%&*+<=>@\\^_`{|}~")] = True
#: What is between the tokens that lexicons are matched with.
BETWEEN = ~(LETTER | DIGIT)

STATS = ["log_words", "word_len", "word_len_sd", "long_words", "upper", "caps_words", "digits", "punct", "symbols", "symbol_words", "bang", "distinct", "top_word", "pairs_again", "next_again", "lines", "lines_again", "non_ascii", "stops"]


def _count(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many bytes of each row the mask has."""
    sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return (sums[at[1:]] - sums[at[:-1]]).astype(float)


def _again(row: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many different hashes each row has, and how often its commonest occurs."""
    if not len(row):
        return np.zeros(n), np.zeros(n)
    with np.errstate(over="ignore"):
        keys = mix(hashes + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys)
    edge = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
    runs = np.diff(np.append(edge, len(keys)))
    at = row[order[edge]]
    most = np.zeros(n)
    np.maximum.at(most, at, runs)
    return np.bincount(at, minlength=n).astype(float), most


def text_stats(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of STATS for each text; an empty text is all zeros."""
    n = len(at) - 1
    size = np.maximum(np.diff(at), 1).astype(float)
    starts, ends, row = words(data, at)
    count = np.bincount(row, minlength=n).astype(float)
    per_word = np.maximum(count, 1)
    length = (ends - starts).astype(float)
    mean = np.bincount(row, length, n) / per_word
    sd = np.sqrt(np.maximum(0, np.bincount(row, length**2, n) / per_word - mean**2))
    hashes = word_hashes(data, starts, ends)
    distinct, top = _again(row, hashes, n)
    pair = np.flatnonzero(row[1:] == row[:-1]) if len(row) else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        pairs = mix(hashes[pair] * np.uint64(3) + hashes[pair + 1])
    n_pairs = np.maximum(np.bincount(row[pair], minlength=n), 1)
    distinct_pairs, _ = _again(row[pair], pairs, n)
    same = np.bincount(row[pair], hashes[pair] == hashes[pair + 1], n)
    upper, symbol = UPPER[data], SYMBOL[data]
    up, letters = np.concatenate([[0], np.cumsum(upper)]), np.concatenate([[0], np.cumsum(LETTER[data])])
    sym = np.concatenate([[0], np.cumsum(symbol)])
    word_up = up[ends] - up[starts]
    caps = np.bincount(row, (word_up >= 2) & (word_up == letters[ends] - letters[starts]), n)
    odd = np.bincount(row, sym[ends] > sym[starts], n)
    newline = np.zeros(256, bool)
    newline[10] = True
    ls, le, lrow = words(data, at, newline)
    lines = np.maximum(np.bincount(lrow, minlength=n), 1).astype(float)
    distinct_lines, _ = _again(lrow, word_hashes(data, ls, le), n)
    return np.column_stack([
        np.log1p(count), mean, sd, np.bincount(row, length > 20, n) / per_word,
        _count(upper, at) / size, caps / per_word, _count(DIGIT[data], at) / size, _count(PUNCT[data], at) / size, _count(symbol, at) / size, odd / per_word,
        _count(data == 33, at) / size, distinct / per_word, top / per_word, 1 - distinct_pairs / n_pairs, same / n_pairs,
        lines / per_word, 1 - distinct_lines / lines, _count(data >= 128, at) / size, _count((data == 46) | (data == 44), at) / per_word,
    ])


def edge_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """A hash of the first n bytes of each word that is longer, else 0."""
    out = np.zeros(len(starts), np.uint64)
    long = ends - starts > n
    with np.errstate(over="ignore"):
        for i in range(n):
            out[long] = mix(out[long] * np.uint64(0xA24BAED4963EE407) + LOWER[data[starts[long] + i]].astype(np.uint64) + np.uint64(n))
    return out
