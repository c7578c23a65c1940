"""Statistics of whole texts, computed batch by batch from their UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm._common import utf8

WINDOW = 5
#: Long sums and counts of a text, in this order.
FIELDS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_lower",
    "n_digits", "n_bangs", "n_bars", "n_stops", "n_other", "n_top_word", "n_bytes", "n_chars", "n_longest", "n_caps_words", "n_markup",
)
SYMBOLS = b"#*$%&|<>"
STOPS = b".,;:?"
MARKUP = b"<>/={}[]@_\\"
_WEIGHTS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(WINDOW)], np.uint64)


def repeated_words(ids: np.ndarray) -> int:
    """Words in windows of five words that are found twice or more; ids: a number for each distinct word."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    with np.errstate(over="ignore"):
        u = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        u ^= u >> np.uint64(32)
        h = sum(u[k : k + n] * _WEIGHTS[k] for k in range(WINDOW))
    ranked = np.sort(h)
    if not (ranked[1:] == ranked[:-1]).any():
        return 0
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    maybe = np.zeros(n, bool)  # windows whose hash occurs twice; equal words decide
    maybe[order[1:][same]] = maybe[order[:-1][same]] = True
    at = np.flatnonzero(maybe)
    windows = ids[at[:, None] + np.arange(WINDOW)]
    order = np.lexsort(windows.T)
    eq = (windows[order[1:]] == windows[order[:-1]]).all(axis=1)
    twice = np.zeros(len(at), bool)
    twice[order[1:][eq]] = twice[order[:-1][eq]] = True
    covered = np.zeros(len(ids) + 1, np.int64)
    np.add.at(covered, at[twice], 1)
    np.add.at(covered, at[twice] + WINDOW, -1)
    return int((np.cumsum(covered) > 0).sum())


def text_stats(text: bytes | None) -> tuple:
    b = text or b""
    c = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
    words = b.split()
    n = len(words)
    chars = len(b) - int(c[128:192].sum())
    spaces = int(c[9:14].sum() + c[32])
    lines = [x for x in b.split(b"\n") if x and not x.isspace()]
    first: dict[bytes, int] = {}
    ids = np.array(list(map(first.setdefault, words, range(n))), np.int64)
    top = int(np.bincount(ids).max()) if n else 0
    some = lambda chars_: int(sum(c[x] for x in chars_))
    return (
        n, chars - spaces, some(SYMBOLS), len(lines) - len(set(lines)), repeated_words(ids), len(lines), len(first), int(c[65:91].sum()), int(c[97:123].sum()),
        int(c[48:58].sum()), int(c[33]), int(c[124]), some(STOPS), int(c[192:].sum()), top, len(b), chars, max(map(len, words), default=0), sum(map(bytes.isupper, words)), some(MARKUP),
    )


def stats_matrix(texts: list[bytes | None]) -> np.ndarray:
    return np.array([text_stats(t) for t in texts], np.int64).reshape(-1, len(FIELDS))


STATS_TYPE = T.StructType([T.StructField(f, T.LongType(), False) for f in FIELDS])


@F.arrow_udf(STATS_TYPE)
def _stats_udf(text: pa.Array) -> pa.Array:
    m = stats_matrix(utf8(text))
    return pa.StructArray.from_arrays([pa.array(m[:, i]) for i in range(len(FIELDS))], names=list(FIELDS))


def stats(text: Column | str) -> Column:
    """A struct of FIELDS; null text counts as empty."""
    return _stats_udf(text)
