"""Statistics of whole texts as model inputs."""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np

NAMES = (
    "log_bytes", "log_words", "mean_word", "upper", "digits", "marks", "beyond_ascii", "bars", "distinct_words", "top_word", "repeats",
    "distinct_lines", "log_line", "marked_words", "stops", "capital_starts", "words_per_line",
)

_KIND = np.zeros(256, dtype=np.int64)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 1, 2, 3, 4
_KIND[[9, 10, 11, 12, 13, 32]] = 5
_ENDS = frozenset(b"!#$%&*@^~")


def text_stats(text: bytes | None) -> np.ndarray:
    """One row of the statistics in NAMES; zeros for a text without words."""
    text = text or b""
    words = text.split()
    if not words:
        return np.zeros(len(NAMES))
    per_byte = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    kinds = np.bincount(_KIND, weights=per_byte, minlength=6)
    marks, upper, lower, digits, beyond, _ = kinds
    solid, letters, n = max(kinds[:5].sum(), 1), max(upper + lower, 1), len(words)
    counts, lines = Counter(words), text.split(b"\n")
    return np.array([
        np.log1p(len(text)), np.log1p(n), solid / n, upper / letters, digits / solid, marks / solid, beyond / solid, per_byte[124] / n,
        len(counts) / n, max(counts.values()) / n, sum(map(eq, words, words[1:])) / n, len(set(lines)) / len(lines), np.log1p(len(text) / len(lines)),
        sum(w[-1] in _ENDS for w in words) / n, (per_byte[46] + per_byte[44]) / n, sum(65 <= w[0] <= 90 for w in words) / n, np.log1p(n / len(lines)),
    ])
