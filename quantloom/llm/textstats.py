"""Counts over whole texts that quality rules and the quality classifier use."""

from __future__ import annotations

import numpy as np

from .textkit import Texts, grams

_CLASS = {
    "upper": (65, 91), "lower": (97, 123), "digits": (48, 58),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_bytes", "n_lines", "n_distinct_words", "max_word", "upper", "lower", "digits", "bangs", "pipes", "marks", "stops", "short_lines")


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOLS = _table(b"#*$%&|<>")
_LEAD = (np.arange(256) & 0xC0) != 0x80
_SPACES = _table(b" \t\n\x0b\x0c\r")
_MARKS = _table(b",;:()\"'-")
_STOPS = _table(b".?")


def _per_doc(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offs[1:]] - total[offs[:-1]]


def _distinct(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    out = np.zeros(len(bounds) - 1, np.int64)
    for i in range(len(out)):
        a = np.sort(hashes[bounds[i] : bounds[i + 1]])
        out[i] = len(a) and 1 + int((a[1:] != a[:-1]).sum())
    return out


def _repeated(hashes: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    """Words inside runs of k words that come twice or more in the same document."""
    runs, first = grams(hashes, bounds, k)
    out = np.zeros(len(bounds) - 1, np.int64)
    for i in range(len(out)):
        a = runs[first[i] : first[i + 1]]
        if len(a) < 2:
            continue
        order = np.argsort(a, kind="stable")
        s = a[order]
        same = s[1:] == s[:-1]
        if same.any():
            hit = np.zeros(len(a), bool)
            hit[order[1:][same]] = hit[order[:-1][same]] = True
            marks = np.zeros(len(a) + k, np.int64)
            at = np.flatnonzero(hit)
            marks[at] += 1
            marks[at + k] -= 1
            out[i] = int((np.cumsum(marks) > 0).sum())
    return out


def stats(t: Texts, more: bool = True) -> dict[str, np.ndarray]:
    """The counts of each document in a slice, as int64 arrays."""
    starts, ends, bounds = t.words()
    buf, offs = t.buf, t.offs
    words = t.spans(starts, ends)
    space = _SPACES[buf]
    # lines: between line feeds and document edges; those with a word count
    feeds = np.flatnonzero(buf == 10)
    begin = np.sort(np.concatenate([offs[:-1], feeds + 1]))
    doc = np.searchsorted(offs[1:], begin, "right")
    # a line feed as a document's last byte would start a line in the next document: its doc index then points past it
    stop = np.sort(np.concatenate([offs[1:], feeds]))
    inside = np.concatenate([[0], np.cumsum(~space)])
    full = (inside[np.maximum(stop, begin)] - inside[begin]) > 0
    begin, stop, doc = begin[full], stop[full], doc[full]
    lines = t.spans(begin, stop)
    edges = np.searchsorted(doc, np.arange(t.n + 1))
    n_lines = np.diff(edges)
    out = {
        "n_words": np.diff(bounds),
        "word_chars": _per_doc(_LEAD[buf] & ~space, offs),
        "n_symbols": _per_doc(_SYMBOLS[buf], offs),
        "n_dup_lines": n_lines - _distinct(lines, edges),
        "n_repeat_words": _repeated(words, bounds, 8),
    }
    if more:
        size = ends - starts
        longest = np.zeros(t.n, np.int64)
        some = np.flatnonzero(np.diff(bounds))
        if len(some):
            longest[some] = np.maximum.reduceat(size, bounds[some])
        in_line = np.searchsorted(starts, stop) - np.searchsorted(starts, begin)
        short = np.concatenate([[0], np.cumsum(in_line < 4)])
        out |= {
            "n_bytes": np.diff(offs), "n_lines": n_lines, "n_distinct_words": _distinct(words, bounds), "max_word": longest,
            "bangs": _per_doc(buf == 33, offs), "pipes": _per_doc(buf == 124, offs), "marks": _per_doc(_MARKS[buf], offs), "stops": _per_doc(_STOPS[buf], offs),
            "short_lines": short[edges[1:]] - short[edges[:-1]],
        }
        out |= {k: _per_doc((buf >= a) & (buf < b), offs) for k, (a, b) in _CLASS.items()}
    return out


#: Ratios that do not depend on labels, language, source or id.
FEATURES = (
    "log_words", "chars_per_word", "symbols_per_word", "dup_lines", "repeat_words", "upper_share", "digit_share", "bangs_per_word",
    "pipes_per_word", "marks_per_word", "stops_per_word", "distinct_words", "words_per_line", "short_lines", "log_longest",
)


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """One row a document, columns as FEATURES; an empty text gives zeros."""
    w, lines = np.maximum(s["n_words"], 1), np.maximum(s["n_lines"], 1)
    letters = np.maximum(s["upper"] + s["lower"], 1)
    return np.stack(
        [
            np.log1p(s["n_words"]), s["word_chars"] / w, s["n_symbols"] / w, s["n_dup_lines"] / lines, s["n_repeat_words"] / w, s["upper"] / letters,
            s["digits"] / np.maximum(s["n_bytes"], 1), s["bangs"] / w, s["pipes"] / w, s["marks"] / w, s["stops"] / w, s["n_distinct_words"] / w,
            s["n_words"] / lines, s["short_lines"] / lines, np.log1p(s["max_word"]),
        ],
        axis=1,
    ).astype(np.float64)
