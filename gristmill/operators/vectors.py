"""Text vectors: weighted terms of words and characters, their reduction, two-dimensional coordinates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill import lexicons
from gristmill.functions.text import default_label, tokens

#: Directions beside those asked for, bound of passes over the rows, relative change of the squared values at which they
#: are taken as settled, and share of the largest singular value under which a direction is rounding noise.
SPARE = 20
MAX_PASSES = 20
SETTLED = 1e-9
RANK_CUT = 1e-7


def topic_words(text: Column, stop_words=lexicons.TOPIC_STOP_WORDS, brands=lexicons.VECTOR_BRANDS, shortest: int = 3) -> Column:
    """Lower-case words without punctuation, stop words, brands and short words."""
    words = F.transform(tokens(F.lower(F.coalesce(text, F.lit("")))), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    drop = {*stop_words, *brands}
    return F.filter(words, lambda w: (F.length(w) >= shortest) & (~w.isin(*sorted(drop)) if drop else F.lit(True)))


def lemmas(words: Column, forms: dict[str, str]) -> Column:
    """Words by a table of base forms, others as they are."""
    if not forms:
        return words
    known = F.create_map(*[F.lit(x) for kv in sorted(forms.items()) for x in kv])
    return F.transform(words, lambda w: F.coalesce(F.try_element_at(known, w), w))


def char_grams(words: Column, lo: int = 2, hi: int = 4) -> Column:
    """Character n-grams within words padded by a space."""
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    grams = lambda w, k: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - k + 1, F.lit(1))), lambda i: F.substr(w, i, F.lit(k)))
    return F.flatten(F.transform(padded, lambda w: F.concat(*[grams(w, k) for k in range(lo, hi + 1)])))


def weights(rows: DataFrame, key: str, terms: str, min_docs: int, vocabulary: int) -> DataFrame:
    """(key, indices, values): L2-normalised (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1) of each row's terms.

    The vocabulary has the terms of `min_docs` rows or more, the most frequent `vocabulary` of them, numbered from 0 in
    that order; it has that bound and is broadcast. Rows without a term have no row here.
    """
    counts = rows.select(key, F.explode(terms).alias("__t")).groupBy(key, "__t").agg(F.count(F.lit(1)).alias("__tf"))
    known = counts.groupBy("__t").agg(F.count(F.lit(1)).alias("__df"), F.sum("__tf").alias("__all")).where(F.col("__df") >= min_docs)
    known = known.orderBy(F.col("__all").desc(), "__t").limit(vocabulary)
    known = known.withColumn("__i", F.row_number().over(Window.orderBy(F.col("__all").desc(), "__t")) - 1)
    n = rows.agg(F.count(F.lit(1)).cast("double").alias("__n"))
    known = known.join(F.broadcast(n)).select("__t", "__i", (F.log((F.lit(1.0) + F.col("__n")) / (F.lit(1.0) + F.col("__df"))) + 1.0).alias("__idf"))  # one row
    weighed = counts.join(F.broadcast(known), "__t").select(key, "__i", ((F.lit(1.0) + F.log("__tf")) * F.col("__idf")).alias("__w"))  # at most `vocabulary` rows
    own = weighed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__i", "__w"))).alias("__x"))  # a row's own terms
    norm = F.sqrt(F.aggregate("__x", F.lit(0.0), lambda a, e: a + e["__w"] * e["__w"]))
    return own.select(key, F.transform("__x", lambda e: e["__i"]).alias("indices"), F.transform("__x", lambda e: e["__w"] / norm).alias("values"))


def text_vectors(df: DataFrame, key: str, text: str = "text", min_word: int = 3, min_char: int = 5, max_word: int = 15_000, max_char: int = 5_000) -> DataFrame:
    """(key, indices, values): words and pairs, then characters from max_word on; the two are normalised apart."""
    rows = df.select(key, topic_words(F.col(text)).alias("w"))
    pairs = F.when(F.size("w") > 1, F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    words = weights(rows.select(key, F.concat("w", pairs).alias("terms")), key, "terms", min_word, max_word)
    chars = weights(rows.select(key, char_grams(F.col("w")).alias("terms")), key, "terms", min_char, max_char)
    chars = chars.select(key, F.transform("indices", lambda i: i + max_word).alias("more"), F.col("values").alias("more_values"))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    both = rows.select(key).join(words, key, "left").join(chars, key, "left")
    return both.select(
        key, F.concat(F.coalesce("indices", none("int")), F.coalesce("more", none("int"))).alias("indices"), F.concat(F.coalesce("values", none("double")), F.coalesce("more_values", none("double"))).alias("values")
    )


def reduced(weighed: DataFrame, key: str, size: int, dims: int = 200) -> DataFrame:
    """(key, tfidf_embedding): rows of U times S of a truncated singular value decomposition.

    Subspace iteration from a seeded random block until the values settle, MAX_PASSES passes at most (the reference's
    randomized solver makes a fixed few). Each pass multiplies the distributed rows by a block of the used terms (`size` at
    most, the vocabulary's bound) x (dims + SPARE); directions under RANK_CUT of the largest value are left out.
    """
    rows = weighed.select("indices", "values").rdd.map(lambda r: (np.array(r[0], dtype=np.int64), np.array(r[1], dtype=float))).persist(StorageLevel.DISK_ONLY)
    sc = weighed.sparkSession.sparkContext
    used = np.array(sorted(rows.flatMap(lambda r: r[0].tolist()).distinct().collect()), dtype=np.int64)  # at most `size`

    def plus(a, b):
        return b if a is None else a if b is None else a + b

    def times(q):
        shared = sc.broadcast(q)

        def part(rows):
            q, out = shared.value, None
            for i, w in rows:
                i = np.searchsorted(used, i)
                out = np.zeros_like(q) if out is None else out
                out[i] += np.outer(w, w @ q[i])
            return [] if out is None else [out]

        found = rows.mapPartitions(part).treeAggregate(None, plus, plus, depth=4)  # a handful of matrices reach the driver
        shared.destroy()
        return np.zeros_like(q) if found is None else found

    q = np.linalg.qr(np.random.default_rng(42).normal(size=(len(used), min(len(used), dims + SPARE))))[0]
    product, before = times(q), None
    for _ in range(MAX_PASSES):
        q = np.linalg.qr(product)[0]
        product = times(q)
        squares, turn = (x[..., ::-1] for x in np.linalg.eigh(q.T @ product))
        if before is not None and (np.abs(squares - before)[:dims] <= SETTLED * squares[:1]).all():
            break
        before = squares
    rows.unpersist()
    kept = squares[:dims] > RANK_CUT**2 * squares[:1]
    v = (q @ turn)[:, :dims][:, kept]

    @F.pandas_udf("array<double>")
    def project(indices: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([(w @ v[np.searchsorted(used, i.astype(int))]).tolist() for i, w in zip(indices, values, strict=True)])

    return weighed.select(key, project("indices", "values").alias("tfidf_embedding"))


def usable(df: DataFrame, columns=("embedding", "tfidf_embedding"), least: int = 10) -> DataFrame:
    """Rows whose vectors are all there with `least` components or more."""
    out = df
    for c in columns:
        out = out.where(F.col(c).isNotNull() & (F.size(c) >= least))
    return out


def coordinates(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Adds x and y: the first two principal components of unit vectors. Stands in for a neighbourhood embedding."""
    norm = F.sqrt(F.aggregate(column, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    rows = df.withColumn("__u", array_to_vector(F.transform(column, lambda v: v.cast("double") / F.greatest(norm, F.lit(1e-12)))))
    out = PCA(k=2, inputCol="__u", outputCol="__p").fit(rows).transform(rows).withColumn("__p", vector_to_array("__p"))
    return out.withColumn("x", F.col("__p")[0]).withColumn("y", F.col("__p")[1]).drop("__u", "__p")


def points_by_label(df: DataFrame, label: str = "combined_label") -> DataFrame:
    """Points of each label that is drawn; rows without a label aren't."""
    rows = df.select(default_label(F.col(label)).alias("label")).where("label != 'unknown'")
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
