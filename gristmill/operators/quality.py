"""Low-quality reviews: weak labels, features, a classifier with its validation."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill import lexicons
from gristmill.functions.numeric import share
from gristmill.functions.text import any_of, count_class, has_letter, py_strip, sentence_count, tokens
from gristmill.operators.ingest import with_ids

FEATURES = (
    "f_text_len f_word_count f_avg_word_len f_char_per_word f_alpha_ratio f_digit_ratio f_upper_ratio f_punct_ratio "
    "f_unique_words f_type_token_ratio f_has_generic_word f_is_single_word f_thumbs_up f_has_votes f_has_punctuation f_sentence_count"
).split()


def duplicate_members(reviews: DataFrame, keys=("app_name", "text")) -> DataFrame:
    """All members of groups of equal keys, nulls being equal.

    Groups are counted before they are joined back, so a large group isn't gathered in one task.
    """
    keys = list(keys)
    many = reviews.groupBy(*keys).count().where("count > 1").select(*[F.col(k).alias(f"__{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return reviews.join(many, same, "left_semi")


def keyed(reviews: DataFrame) -> DataFrame:
    """Adds all that weak labels need of a text: __short, and SHA-256 of the text as it is and folded, __whole and __folded."""
    digest = lambda x: F.unhex(F.sha2(x.cast("binary"), 256))
    rows = reviews.withColumn("__clean", py_strip(F.col("text")))
    short = F.col("text").isNull() | (F.length("__clean") < 10) | ~has_letter(F.col("__clean"))
    return rows.withColumns({"__short": F.coalesce(short, F.lit(True)), "__whole": digest(F.col("text")), "__folded": digest(F.lower("__clean"))}).drop("__clean")


def duplicate_keys(rows: DataFrame) -> DataFrame:
    """(app_name, __folded) of texts that occur more than once as they are, from keyed rows."""
    texts = rows.groupBy("app_name", "__whole").agg(F.count(F.lit(1)).alias("__c"), F.min("__folded").alias("__folded"))
    return texts.where("__c > 1").select("app_name", "__folded").distinct()


def label_keyed(rows: DataFrame) -> DataFrame:
    """Adds low_quality_label to keyed rows, which need no text, and drops the keys."""
    out = rows.join(duplicate_keys(rows).withColumn("__dup", F.lit(True)), ["app_name", "__folded"], "left")
    return out.withColumn("low_quality_label", (F.col("__short") | F.coalesce("__dup", F.lit(False))).cast("int")).drop("__whole", "__folded", "__short", "__dup")


def weak_labels(reviews: DataFrame) -> DataFrame:
    """Adds low_quality_label: short, a duplicate of its app, or without letters.

    All that reads the text comes before the join, so texts are shuffled only if the caller keeps them.
    """
    return label_keyed(keyed(reviews))


def with_features(reviews: DataFrame) -> DataFrame:
    """The 16 features of a text.

    What several features share is a column of its own first, so that it is computed once for each text.
    """
    t = F.coalesce("text", F.lit(""))
    words, low = F.col("__words"), F.col("__low")  # words of the folded text: folding changes no white space, so they are as many
    n, chars, alpha, unique = (F.col(c) for c in ("__n", "__chars", "__alpha", "__unique"))
    parts = reviews.withColumns({"__words": tokens(F.lower(t)), "__chars": F.length(t), "__alpha": count_class(t, r"\p{L}")})
    parts = parts.withColumns({"__n": F.size(words), "__low": F.array_distinct(words)}).withColumn("__unique", F.size(low))
    votes = F.coalesce("thumbs_up", F.lit(0)).cast("int")
    letters = chars - F.length(F.regexp_replace(t, r"\S+", ""))
    one = F.lit(1)
    seen = F.length(F.regexp_replace(t, r"(?U)[\p{L}\p{N}\s\x1c-\x1f]+", ""))
    ratio = lambda a, b: a.cast("double") / b.cast("double")
    return parts.withColumns(
        {
            "f_text_len": chars,
            "f_word_count": n,
            "f_avg_word_len": F.coalesce(share(letters, F.nullif(n, F.lit(0))), F.lit(0.0)),
            "f_char_per_word": ratio(chars, n + 1),
            "f_alpha_ratio": ratio(alpha, F.greatest(chars, one)),
            "f_digit_ratio": ratio(count_class(t, r"\p{Nd}"), F.greatest(chars, one)),
            "f_upper_ratio": ratio(count_class(t, r"\p{Upper}"), F.greatest(alpha, one)),
            "f_punct_ratio": ratio(seen, F.greatest(chars, one)),
            "f_unique_words": unique,
            "f_type_token_ratio": ratio(unique, n + 1),
            "f_has_generic_word": any_of(low, lexicons.GENERIC_WORDS).cast("int"),
            "f_is_single_word": (n == 1).cast("int"),
            "f_thumbs_up": votes,
            "f_has_votes": (votes > 0).cast("int"),
            "f_has_punctuation": F.rlike(t, F.lit("[.!?,;]")).cast("int"),
            "f_sentence_count": sentence_count(t),
        }
    ).drop("__words", "__low", "__chars", "__alpha", "__n", "__unique")


def class_weights(labelled: DataFrame, label: str = "low_quality_label") -> DataFrame:
    """n / (classes * n of the class), a row for each class."""
    counts = labelled.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    total = counts.agg(F.sum("n_class").alias("n"), F.count(F.lit(1)).alias("classes"))
    return counts.join(F.broadcast(total)).select(label, "n_class", (F.col("n") / (F.col("classes") * F.col("n_class"))).alias("weight"))  # one row


def _scaled(featured: DataFrame, moments) -> DataFrame:
    return featured.withColumns({f"z_{c}": (F.col(c).cast("double") - moments[f"m_{c}"]) / (moments[f"s_{c}"] or 1.0) for c in FEATURES})


def moments_of(featured: DataFrame):
    """Means and population deviations of the features, one row."""
    return featured.agg(*[F.avg(c).alias(f"m_{c}") for c in FEATURES], *[F.stddev_pop(c).alias(f"s_{c}") for c in FEATURES]).first()


def train(featured: DataFrame, label: str = "low_quality_label", c: float = 1.0):
    """(moments, model): logistic regression on standardised features with balanced class weights."""
    moments = moments_of(featured)
    rows = _scaled(featured, moments).join(F.broadcast(class_weights(featured, label).select(label, "weight")), label)  # a row for each class
    n = featured.count()
    stages = [VectorAssembler(inputCols=[f"z_{f}" for f in FEATURES], outputCol="features"), LogisticRegression(labelCol=label, weightCol="weight", regParam=1.0 / (c * max(n, 1)), standardization=False, maxIter=200)]
    return moments, Pipeline(stages=stages).fit(rows)


def predict(featured: DataFrame, moments, model: PipelineModel) -> DataFrame:
    """Adds low_quality_pred and quality_score, the probability of acceptable quality."""
    rows = model.transform(_scaled(featured, moments))
    drop = [f"z_{f}" for f in FEATURES] + ["features", "rawPrediction", "probability", "prediction"]
    return rows.withColumn("low_quality_pred", F.col("prediction").cast("int")).withColumn("quality_score", vector_to_array("probability")[0]).drop(*drop)


def importance(model: PipelineModel, n: int = 8) -> list[tuple[str, float]]:
    """The largest coefficients by size."""
    return sorted(zip(FEATURES, model.stages[-1].coefficients.toArray().tolist(), strict=True), key=lambda x: -abs(x[1]))[:n]


def with_folds(labelled: DataFrame, folds: int = 5, label: str = "low_quality_label", key: str = "review_id") -> DataFrame:
    """Contiguous folds of equal size within each class, in key order; the first ones have a row more.

    Rows are numbered in (class, key) order over ranges, and each class starts at its least number: no class is one task.
    """
    rows = with_ids(labelled, [label, key], name="__row")
    ends = rows.groupBy(F.col(label).alias("__class")).agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__size"))
    rows = rows.join(F.broadcast(ends), F.col(label).eqNullSafe(F.col("__class")))  # a row for each class
    i, size, more = F.col("__row") - F.col("__first"), F.floor(F.col("__size") / folds), F.col("__size") % folds
    fold = F.when(i < more * (size + 1), F.floor(i / (size + 1))).otherwise(more + F.floor((i - more * (size + 1)) / F.greatest(size, F.lit(1))))
    return rows.withColumn("fold", fold.cast("int")).drop("__row", "__class", "__first", "__size")


def cross_validate(featured: DataFrame, folds: int = 5, label: str = "low_quality_label") -> list[float]:
    """F1 of the low-quality class for each fold."""
    rows, out = with_folds(featured, folds, label), []
    for k in range(folds):
        moments, model = train(rows.where(F.col("fold") != k), label)
        r = confusion(predict(rows.where(F.col("fold") == k), moments, model), label, "low_quality_pred").first()
        out.append(float(r["f1"] or 0.0))
    return out


def confusion(scored: DataFrame, label: str, pred: str) -> DataFrame:
    """tp, fp, fn, tn, precision, recall and F1 of class 1, one row; labels are cast where they can be."""
    y, p = F.expr(f"try_cast({label} as int)"), F.expr(f"try_cast({pred} as int)")
    cells = scored.agg(*[F.count_if((y == a) & (p == b)).alias(n) for n, a, b in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))])
    precision, recall = share(F.col("tp"), F.nullif(F.expr("tp + fp"), F.lit(0).cast("bigint"))), share(F.col("tp"), F.nullif(F.expr("tp + fn"), F.lit(0).cast("bigint")))
    return cells.withColumns({"precision": precision, "recall": recall, "f1": share(F.expr("2 * tp"), F.nullif(F.expr("2 * tp + fp + fn"), F.lit(0).cast("bigint")))})


def validation_sample(scored: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n / 2 rows of each predicted class, exactly, in an order of their own."""
    h = F.xxhash64("review_id", F.lit(seed))
    half = lambda c: scored.where(F.col("low_quality_pred") == c).orderBy(h, "review_id").limit(n // 2)
    return half(1).unionByName(half(0)).orderBy(F.xxhash64("review_id", F.lit(seed + 1)), "review_id")


def low_quality_share(labelled: DataFrame, column: str = "low_quality_label") -> DataFrame:
    """(A33)"""
    return labelled.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(column) == 1).alias("n_low"), share(F.count_if(F.col(column) == 1), F.count(F.lit(1))).alias("share_low"))


def labelled_by_hand(validation: DataFrame) -> DataFrame:
    """(P13)"""
    return validation.where(F.col("manual_label").isNotNull() & (F.col("manual_label") != ""))


def worst_first(scored: DataFrame) -> DataFrame:
    """(T8)"""
    return scored.orderBy("quality_score", "review_id")
