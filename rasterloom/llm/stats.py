"""Statistics of one document, used by the quality classifier and the quality rules."""

from __future__ import annotations

import math
from itertools import islice
from operator import eq

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = b"0123456789"
STOPS = b".,;:"

#: Names of the features that ``document_stats`` returns, in order.
FEATURES = (
    "log_chars", "log_words", "mean_word", "log_longest", "symbol_ratio", "upper_ratio", "digit_ratio",
    "bang_ratio", "bar_ratio", "stop_ratio", "dup_lines", "distinct_words", "repeat_words", "log_line_words",
    "symbol_words", "top_word", "echo_words",
)


def _count(data: bytes, chars: bytes) -> int:
    return len(data) - len(data.translate(None, chars))


def repeated_words(words: list) -> int:
    """Words inside a 3-word window that occurs twice or more; the first occurrence counts too."""
    windows = list(zip(words, islice(words, 1, None), islice(words, 2, None)))
    seen, twice = set(), set()
    if len(set(windows)) == len(windows):
        return 0
    for w in windows:
        (twice if w in seen else seen).add(w)
    n, covered = 0, 0
    for i, w in enumerate(windows):
        if w in twice:
            n += i + 3 - max(i, covered)
            covered = i + 3
    return n


def duplicate_lines(text: str) -> int:
    """Lines that hold a word and equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def document_stats(text: str | None) -> tuple[dict[str, int], list[float]]:
    """Exact counts and the feature vector of a whole text; a null text counts as an empty one."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n_chars, n_words = len(text), len(words)
    word_chars = n_chars - _count(data, SPACE)
    symbols, dup, rep = _count(data, SYMBOLS), duplicate_lines(text), repeated_words(words)
    counts = {"n_words": n_words, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": rep}
    chars, nw, lines = max(1, word_chars), max(1, n_words), text.count("\n") + 1
    upper, lower = _count(data, UPPER), _count(data, LOWER)
    distinct = set(words)
    sample = max(distinct, key=len, default=b"")
    first = words.count(words[0]) if words else 0
    symbol_words = sum(1 for w in distinct if w[-1] in b"#*$%&|!") / max(1, len(distinct))
    return counts, [
        math.log1p(n_chars), math.log1p(n_words), chars / nw, math.log1p(len(sample)), symbols / chars,
        upper / max(1, upper + lower), _count(data, DIGITS) / chars, min(2.0, data.count(b"!") / nw), min(2.0, data.count(b"|") / nw),
        _count(data, STOPS) / nw, dup / lines, len(distinct) / nw, rep / nw, math.log1p(n_words / lines), symbol_words, first / nw, sum(map(eq, words, islice(words, 1, None))) / nw,
    ]
