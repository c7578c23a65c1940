"""Toxicity by compression distance: zstandard dictionaries trained on ordinary and on toxic text, the compressed length
of each window under both, and a calibrated score of what the toxic one saves.

Text is lower-cased (A-Z), ASCII characters other than letters become spaces, and windows of WINDOW words are compressed
one by one. Both dictionaries come from zstandard's trainer. The ordinary one is trained on windows of ordinary texts. A
label marks a whole text, most windows of a toxic text are like any others, so the toxic one is trained in rounds: of
the windows that a dictionary trained on the other half of the toxic texts shortens most against the ordinary one, the
words that the saving rests on (the window without them saves least) are the samples of the next dictionary, best
first. Of what the trainer makes of them the most valuable end is kept, and loaded after the ordinary dictionary, so
that the two lengths of a window differ by the toxic content alone.

A window's saving is its ordinary length less its toxic length, in bytes. The largest saving of a text and the share and
number of its windows that save enough give the score, through a logistic calibration on the labelled rows.

The fit uses at most SAMPLE_TOXIC + SAMPLE_ORDINARY labelled rows outside the held-out fold, in the order of a hash until
FIT_BYTES of text are reached (a row that would exceed it is left out), and the ordinary dictionary at most BASE_WINDOWS
of their windows: documented bounds. Every row is scored from its whole text, in one pass without a shuffle.

Defined results: null and empty texts are scored like a text that saves nothing; without labelled rows every score is 0,
with one class only the smoothed rate of toxic rows; a null doc_id is scored and not held out; repeated rows give
repeated results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm._common import fold, labelled_sample, utf8

SAMPLE_TOXIC = 1_500
SAMPLE_ORDINARY = 4_500
FIT_BYTES = 32 << 20
BASE_WINDOWS = 100_000
THRESHOLD = 0.3
WINDOW = 5
#: Bytes of the ordinary dictionary, and of the toxic content after it.
BASE_BYTES = 110_000
TOXIC_BYTES = 2_560
#: Toxic texts unlike each other that are enough to learn from; how often words are chosen and trained on; of the windows that save LEAST_SAVED bytes at most TOP of all are taken.
LEAST_TEXTS = 20
ROUNDS = 2
TOP = 0.1
LEAST_SAVED = 5
#: The trainer makes so many times the toxic content, in segments of so many bytes.
GROW = 4
SEGMENT = 20
#: zstandard starts no match in the last bytes of its input; these occur in no window.
TAIL = b"0123456789"
_LETTERS = bytes(c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def windows(text: bytes | None, words: int = WINDOW) -> list[bytes]:
    w = (text or b"").translate(_LETTERS).split()
    return [b" %b %b" % (b" ".join(w[i : i + words]), TAIL) for i in range(0, len(w), words)]


def unlike(texts: list[bytes], same: float = 0.5, cells: int = 4096) -> list[bytes]:
    """Texts of which no two share more than `same` of their words (hashed to cells): of copies the first stays."""
    has = np.zeros((len(texts), cells), np.float32)
    for i, t in enumerate(texts):
        has[i, [zlib.crc32(w) % cells for w in set(t.translate(_LETTERS).split())]] = 1
    size, stay = has.sum(axis=1), np.zeros(len(texts), bool)
    for i in range(len(texts)):
        both = has[:i][stay[:i]] @ has[i]
        stay[i] = not (both > same * (size[:i][stay[:i]] + size[i] - both)).any()
    return [t for t, ok in zip(texts, stay, strict=True) if ok]


@dataclass(frozen=True)
class Model:
    """Bytes of the two dictionaries and the calibration; `rate` alone if there is nothing to tell apart."""

    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]
    rate: float


def _dictionary(data: bytes, raw: bool):
    import zstandard

    d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT if raw else zstandard.DICT_TYPE_FULLDICT)
    p = zstandard.ZstdCompressionParameters(
        compression_level=3, strategy=zstandard.STRATEGY_GREEDY, min_match=5, hash_log=16, chain_log=16, search_log=4, window_log=18,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    return zstandard.ZstdCompressor(compression_params=p, dict_data=d).compress


@lru_cache(maxsize=4)
def _compressors(ordinary: bytes, toxic: bytes):
    raw = not ordinary.startswith(b"\x37\xa4\x30\xec")
    return _dictionary(ordinary, raw), _dictionary(toxic, raw)


def _lengths(compress, windows: list[bytes]) -> np.ndarray:
    return np.fromiter(map(len, map(compress, windows)), np.int64, len(windows))


def savings(ordinary: bytes, toxic: bytes, text: bytes | None) -> np.ndarray:
    """Bytes that the toxic dictionary saves on each window."""
    w = windows(text)
    a, b = _compressors(ordinary, toxic)
    return _lengths(a, w) - _lengths(b, w)


def measures(saved: np.ndarray) -> tuple[float, ...]:
    """The three largest savings of a text, and how many and what share of its windows save so many bytes."""
    n = max(len(saved), 1)
    top = np.zeros(3)
    top[: min(len(saved), 3)] = np.sort(saved)[::-1][:3]
    counts = {k: int((saved >= k).sum()) for k in range(1, 11)}
    logs = [np.log1p(counts[k]) for k in counts]
    few = [float(min(counts[k], 4)) for k in (3, 4, 5, 6)]
    shares = [10 * np.sqrt(counts[k] / n) for k in (2, 3, 4, 5, 6)]
    size = np.log1p(n) / 4
    return (1.0, *np.clip(top, -2, 14).tolist(), *logs, *few, *shares, size, size**2)


def _calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1.0) -> np.ndarray:
    """Weighted logistic regression by Newton's method; the constant isn't shrunk."""
    w, shrink = np.zeros(x.shape[1]), np.full(x.shape[1], l2)
    shrink[0] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(shrink)
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - shrink * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """A dictionary by zstandard's trainer; text that fits whole is its own dictionary, without entropy tables."""
    import zstandard

    text = b"".join(samples)
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes() if len(text) > size else text or b" " * 8
    except zstandard.ZstdError:  # nothing is found twice
        return text[-size:]


def bearing_words(plain, toxic, windows: list[bytes], saved: np.ndarray) -> list[bytes]:
    """Of each window the word that its saving rests on: without it the window saves least."""
    out = []
    for window, own in zip(windows, saved.tolist(), strict=True):
        words = window[: -len(TAIL)].split()
        without = [b" %b %b" % (b" ".join(words[:i] + words[i + 1 :]), TAIL) for i in range(len(words))]
        lost = own - (_lengths(plain, without) - _lengths(toxic, without))
        out.append(b" %b " % words[int(np.argmax(lost))])
    return out


def toxic_content(toxic: list[bytes], ordinary: bytes) -> bytes:
    """Content trained on the toxic texts, in rounds over two halves: each half's windows are judged by the other's."""
    raw = not ordinary.startswith(b"\x37\xa4\x30\xec")
    plain = _dictionary(ordinary, raw)
    halves = [[(i, w) for i, t in enumerate(toxic) if i % 2 == h for w in windows(t)] for h in (0, 1)]
    base = [_lengths(plain, [w for _, w in half]) for half in halves]
    content = [trained([w[: -len(TAIL)] for _, w in half], 8 << 10, 16) for half in halves]
    words: list[list[bytes]] = [[], []]
    for _ in range(ROUNDS):
        for h, half in enumerate(halves):
            other = _dictionary(ordinary + content[1 - h], raw)
            saved = base[h] - _lengths(other, [w for _, w in half])
            least = LEAST_SAVED if (saved >= LEAST_SAVED).any() else 1
            best = np.argsort(-saved, kind="stable")[: min(int((saved >= least).sum()), max(100, int(TOP * len(half))))]
            found = bearing_words(plain, other, [half[i][1] for i in best], saved[best])
            words[h] = [w for _, w in dict.fromkeys((half[i][0], w) for i, w in zip(best.tolist(), found, strict=True))]  # once a text
        content = [trained(w, GROW * TOXIC_BYTES, SEGMENT)[-TOXIC_BYTES:] if w else c for w, c in zip(words, content, strict=True)]
    both = words[0] + words[1]
    return trained(both, GROW * TOXIC_BYTES, SEGMENT)[-TOXIC_BYTES:] if both else (content[0] + content[1])[-TOXIC_BYTES:]


def train(texts: list[bytes], y: np.ndarray, class_sizes: tuple[int, int] | None = None, seed: int = 3) -> Model:
    """A model of labelled texts; class_sizes: how many ordinary and toxic rows these stand for."""
    n0, n1 = class_sizes or (int((y == 0).sum()), int((y == 1).sum()))
    rate = (n1 + 0.5) / (n0 + n1 + 1) if n0 + n1 else 0.0
    toxic = [t for t, v in zip(texts, y, strict=True) if v == 1]
    ordinary = [t for t, v in zip(texts, y, strict=True) if v == 0]
    if not toxic or not ordinary:
        return Model(b"", b"", (), rate)
    pool = [w for t in ordinary for w in windows(t)]
    pick = np.random.default_rng(seed).permutation(len(pool))[:BASE_WINDOWS]
    base = trained([pool[i][: -len(TAIL)] for i in sorted(pick.tolist())], BASE_BYTES, 16)
    few = unlike(toxic)  # copies would lend their own words weight; where there is little else, they count
    content = toxic_content(few if len(few) >= LEAST_TEXTS else toxic, base)
    x = np.array([measures(savings(base, base + content, t)) for t in texts])
    weight = np.where(y == 1, n1 / len(toxic), n0 / len(ordinary))
    weight = weight * len(y) / weight.sum()
    return Model(base, base + content, tuple(_calibrate(x, y.astype(float), weight).tolist()), rate)


def fit(docs: DataFrame, labels: DataFrame, toxic_cap: int = SAMPLE_TOXIC, ordinary_cap: int = SAMPLE_ORDINARY, fit_bytes: int = FIT_BYTES) -> Model:
    """A model of a bounded sample of the labelled documents; whole texts, in the order of a hash of the id."""
    sizes = dict(labels.where("doc_id is not null and toxic is not null").where(fold("doc_id") != 2).groupBy("toxic").count().collect())
    sample = labelled_sample(labels.where("toxic = 1"), "toxic", toxic_cap).unionByName(labelled_sample(labels.where("toxic = 0"), "toxic", ordinary_cap))
    sample = F.broadcast(sample.groupBy("doc_id").agg(F.max("y").alias("y")))  # at most toxic_cap + ordinary_cap rows
    rows = docs.select("doc_id", "text").where(F.octet_length("text") <= fit_bytes).join(sample, "doc_id")
    texts, y, size = [], [], 0
    for r in rows.orderBy(F.xxhash64("doc_id", F.lit("fit")), "doc_id", "text").toLocalIterator():
        own = r.text.encode()
        if size + len(own) <= fit_bytes:
            texts.append(own)
            y.append(r.y)
            size += len(own)
    return train(texts, np.array(y, np.int64), (sizes.get(0, 0), sizes.get(1, 0)))


def scores(model: Model, texts: list[bytes | None]) -> np.ndarray:
    if not model.weights:
        return np.full(len(texts), model.rate)
    x = np.array([measures(savings(model.ordinary, model.toxic, t)) for t in texts]).reshape(len(texts), len(model.weights))
    return 1 / (1 + np.exp(-np.clip(x @ np.array(model.weights), -30, 30)))


def score(model: Model, text: Column | str) -> Column:
    @F.arrow_udf(T.DoubleType())
    def go(text: pa.Array) -> pa.Array:
        return pa.array(scores(model, utf8(text)))

    return go(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select("doc_id", F.coalesce(fold("doc_id") == 2, F.lit(False)).alias("held_out"), score(model, "text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
