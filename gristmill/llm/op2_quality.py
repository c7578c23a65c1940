"""Quality classifier: histogram gradient-boosted trees over document statistics, flattened into arrays that numpy
traverses for a whole batch at once.

The fit uses at most SAMPLE_ROWS labelled rows (a documented bound) outside the held-out fold; every row is scored from
its whole text in one pass without a shuffle. Labels, lang, source and doc_id are never inputs.

Defined results: null and empty texts are scored from statistics of zero; without labelled rows every score is 0.5, with
one class only its smoothed rate; repeated rows give repeated results; a null doc_id is scored and not held out;
an empty table gives no rows; other columns, also of the result's names, are ignored by the query.
`keep_good` keeps rows when there is no model, and keeps all columns of its input.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm._common import fold, labelled_sample, scratch, utf8
from gristmill.llm._textstats import FIELDS, stats, stats_matrix

SAMPLE_ROWS = 12_000
THRESHOLD = 0.7
BINS = 64


@dataclass
class Trees:
    """Complete binary trees: inner node i has children 2i+1 and 2i+2; a row goes right where its value exceeds the threshold."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves
    base: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        n, (k, inner) = len(x), self.feature.shape
        raw = np.full(n, self.base)
        tree = np.arange(k)[None, :]
        for lo in range(0, n, 4096):
            part = x[lo : lo + 4096]
            row = np.arange(len(part))[:, None]
            node = np.zeros((len(part), k), np.int64)
            for _ in range(int(np.log2(inner + 1))):
                node = 2 * node + 1 + (part[row, self.feature[tree, node]] > self.threshold[tree, node])
            raw[lo : lo + 4096] += self.leaf[tree, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-raw))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.2, l2: float = 2.0, bins: int = BINS) -> Trees:
    """Logistic loss, level by level, from histograms of gradients and curvatures over quantile bins."""
    n, d = x.shape
    inner, leaves = 2**depth - 1, 2**depth
    p = (y.sum() + 0.5) / (n + 1)
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    edges = []
    for j in range(d):
        u = np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1))) if n else np.zeros(0)
        edges.append(np.unique((u[1:] + u[:-1]) / 2)[: bins - 1])
    if 0 < y.sum() < n:
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        cells = binned + np.arange(d) * bins
        raw = np.full(n, np.log(p / (1 - p)))
        for t in range(trees):
            q = 1 / (1 + np.exp(-raw))
            g, h = y - q, q * (1 - q)
            node = np.zeros(n, np.int64)
            for level in range(depth):
                width, first = 2**level, 2**level - 1
                at = (cells + (node - first)[:, None] * (d * bins)).ravel()
                hg, hh = (np.bincount(at, np.repeat(v, d), width * d * bins).reshape(width, d, bins) for v in (g, h))
                gl, hl = hg.cumsum(axis=2), hh.cumsum(axis=2)
                gt, ht = gl[:, :, -1:], hl[:, :, -1:]
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(hl < 1) | (ht - hl < 1)] = 0
                best = gain.reshape(width, -1).argmax(axis=1)
                for k in range(width):
                    j, b = divmod(int(best[k]), bins)
                    if gain[k, j, b] > 1e-6 and b < len(edges[j]):
                        feature[t, first + k], threshold[t, first + k] = j, edges[j][b]
                f = feature[t, node]
                node = 2 * node + 1 + (x[np.arange(n), f] > threshold[t, node])
            own = node - inner
            leaf[t] = rate * np.bincount(own, g, leaves) / (np.bincount(own, h, leaves) + l2)
            raw += leaf[t][own]
    return Trees(feature, threshold, leaf, float(np.log(p / (1 - p))))


def features(m: np.ndarray) -> np.ndarray:
    """Ratios and logarithms of the statistics of each text."""
    c = {k: m[:, i].astype(float) for i, k in enumerate(FIELDS)}
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    per_word = [c[k] / words for k in ("word_chars", "n_symbols", "n_repeat_words", "n_distinct", "n_bangs", "n_bars", "n_stops", "n_top_word", "n_caps_words", "n_longest")]
    per_char = [c[k] / chars for k in ("n_upper", "n_lower", "n_digits", "n_other", "n_markup")]
    lines = np.maximum(c["n_lines"], 1)
    return np.stack([*per_word, *per_char, c["n_dup_lines"] / lines, c["n_words"] / lines, np.log1p(c["n_words"]), np.log1p(c["n_lines"])], axis=1)


def fit(docs: DataFrame, labels: DataFrame, cap: int = SAMPLE_ROWS, **kw) -> Trees | None:
    """Trees from a bounded sample of the labelled documents; None without any."""
    sample = F.broadcast(labelled_sample(labels, "quality", cap))  # at most cap rows
    found = docs.select("doc_id", "text").join(sample, "doc_id").select("y", "doc_id", stats("text").alias("s")).select("y", "doc_id", "s.*").orderBy("doc_id", "n_bytes").limit(2 * cap).toPandas()
    if not len(found):
        return None
    return fit_trees(features(found[list(FIELDS)].to_numpy()), found["y"].to_numpy().astype(float), **kw)


def score(trees: Trees | None, text: Column | str) -> Column:
    """The score of each whole text, in one pass of a worker over its batch."""

    @F.arrow_udf(T.DoubleType())
    def go(text: pa.Array) -> pa.Array:
        m = stats_matrix(utf8(text))
        return pa.array(np.full(len(m), 0.5) if trees is None else trees.predict(features(m)))

    return go(text)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **kw) -> DataFrame:
    """The rows of docs with a score of the threshold or more, columns unchanged; all rows if there is no model."""
    trees = fit(docs, labels, **kw)
    if trees is None:
        return docs
    s = scratch("score")
    return docs.withColumn(s, score(trees, "text")).where(F.col(s) >= threshold).select(*[F.col(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    trees = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select("doc_id", F.coalesce(fold("doc_id") == 2, F.lit(False)).alias("held_out"), score(trees, "text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
