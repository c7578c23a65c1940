"""Quality rules: a learned decision list over document statistics, applied as ordered Spark conditional expressions.

Sequential covering: each rule is a conjunction of thresholds for low quality, grown on two thirds of the labelled
rows that no rule covers yet by information gain, pruned on the other third, and kept while it is precise there. The
list is plain data (name, sign, threshold) and becomes F.when(...).when(...).otherwise(keep).

The fit uses at most SAMPLE_ROWS labelled rows (a documented bound) outside the held-out fold; statistics and verdicts
cover all rows. One pass over the texts and no shuffle of them.

Defined results: null and empty texts have statistics of zero and fail the base rules; without labels of both classes
the list is empty and the base rules alone decide; a null doc_id is scored like any row; repeated rows give repeated
results; labels without a document, or null, are ignored; other columns, also of the result's names, are kept
by `keep_good` and ignored by the query; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm._common import labelled_sample, scratch
from gristmill.llm._textstats import stats

SAMPLE_ROWS = 12_000
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Name: numerator, denominator of the ratios that conditions may use. All are sums over the whole text.
RATIOS = {
    "word_length": ("word_chars", "n_words"), "symbols_per_word": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"),
    "repeat_words": ("n_repeat_words", "n_words"), "distinct_words": ("n_distinct", "n_words"), "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"), "bangs_per_word": ("n_bangs", "n_words"), "bars_per_word": ("n_bars", "n_words"),
    "stops_per_word": ("n_stops", "n_words"), "top_word_share": ("n_top_word", "n_words"), "caps_words": ("n_caps_words", "n_words"), "markup_share": ("n_markup", "word_chars"),
    "words": ("n_words", None),
}


@dataclass(frozen=True)
class Condition:
    name: str
    at_least: bool
    threshold: float


Rule = tuple[Condition, ...]


def ratio(name: str, s: Column) -> Column:
    a, b = RATIOS[name]
    return s[a].cast("double") / (F.greatest(s[b], F.lit(1)).cast("double") if b else F.lit(1.0))


def ratios(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {k: rows[a].astype(float) / (np.maximum(rows[b], 1).astype(float) if b else 1.0) for k, (a, b) in RATIOS.items()}


def _holds(c: Condition, x: dict[str, np.ndarray]) -> np.ndarray:
    return x[c.name] >= c.threshold if c.at_least else x[c.name] < c.threshold


def _covered(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= _holds(c, x)
    return out


def _best_condition(x, y, cuts) -> tuple[float, Condition | None]:
    """The threshold with the most gain for class 1 among the rows given (first-order inductive learner's gain)."""
    p0, n0 = y.sum(), len(y) - y.sum()
    base, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
    for name in sorted(x):
        v = x[name]
        if not len(cuts[name]):
            continue
        order = np.argsort(v, kind="stable")
        at = np.searchsorted(v[order], cuts[name], side="left")
        pos = np.concatenate(([0], np.cumsum(y[order])))
        for above in (True, False):
            p = p0 - pos[at] if above else pos[at]
            m = len(v) - at if above else at
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / np.maximum(m, 1)) - base), 0)
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (float(gain[i]), Condition(name, above, float(cuts[name][i])))
    return best


def learn_rules(rows: dict[str, np.ndarray], bad: np.ndarray, max_rules: int = 16, max_conditions: int = 4, precision: float = 0.9, least: int = 3, seed: int = 7) -> list[Rule]:
    """An ordered list of rules for `bad`. Each needs `precision` on the growing and on the pruning rows that it covers."""
    x, y = ratios(rows), bad.astype(int)
    n, rules = len(y), []
    if not 0 < y.sum() < n:
        return rules
    cuts = {}
    for k, v in x.items():
        u = np.unique(np.quantile(v, np.linspace(0, 1, 129)))
        cuts[k] = np.unique((u[1:] + u[:-1]) / 2)
    grow = np.random.default_rng(seed).random(n) < 2 / 3
    left = np.ones(n, bool)
    while len(rules) < max_rules:
        g = left & grow
        if not 0 < y[g].sum() < g.sum() and not y[g].sum():
            break
        rule: Rule = ()
        at = np.flatnonzero(g)
        while len(rule) < max_conditions and 0 < y[at].sum() < len(at):
            _, c = _best_condition({k: v[at] for k, v in x.items()}, y[at], cuts)
            if c is None:
                break
            rule += (c,)
            at = at[_holds(c, {c.name: x[c.name][at]})]
        pr = np.flatnonzero(left & ~grow)
        xp = {k: v[pr] for k, v in x.items()}

        def worth(r: Rule, xp=xp, pr=pr) -> float:
            hit = _covered(r, xp, len(pr))
            p = y[pr][hit].sum()
            return (2 * p - hit.sum()) / (hit.sum() + 2)  # the smoothed margin of bad rows over others

        while len(rule) > 1:  # drop final conditions while that helps
            shorter = max((rule[:k] for k in range(1, len(rule))), key=worth)
            if worth(shorter) < worth(rule):
                break
            rule = shorter
        hit = _covered(rule, x, n) & left
        every, own = y[hit].sum(), hit.sum()
        hit_pr = hit & ~grow
        if not rule or every < least or every < precision * own or y[hit_pr].sum() < precision * hit_pr.sum():
            break
        rules.append(rule)
        left &= ~hit
    return rules


def rule_expression(rule: Rule, s: Column) -> Column:
    out = F.lit(True)
    for c in rule:
        r = ratio(c.name, s)
        out = out & (r >= c.threshold if c.at_least else r < c.threshold)
    return out


def decision(rules: list[Rule], s: Column) -> Column:
    """The list as one ordered conditional expression: the number of the first rule that holds, else null."""
    out = None
    for i, rule in enumerate(rules):
        out = F.when(rule_expression(rule, s), F.lit(i)) if out is None else out.when(rule_expression(rule, s), F.lit(i))
    return F.lit(None).cast("int") if out is None else out.otherwise(F.lit(None).cast("int"))


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])


def fit_rules(docs: DataFrame, labels: DataFrame, cap: int = SAMPLE_ROWS, **kw) -> list[Rule]:
    """Learn from a bounded sample of the labelled documents; the sample's statistics come to the driver."""
    sample = F.broadcast(labelled_sample(labels, "quality", cap))  # at most cap rows
    found = docs.select("doc_id", "text").join(sample, "doc_id").select("y", "doc_id", stats("text").alias("s")).select("y", "doc_id", "s.*").orderBy("doc_id", "n_bytes").limit(2 * cap).toPandas()
    rows = {c: found[c].to_numpy() for c in found.columns}
    sound = ~((rows["n_words"] < 10) | (100 * rows["n_repeat_words"] > 20 * rows["n_words"])) if len(found) else np.zeros(0, bool)
    return learn_rules({k: v[sound] for k, v in rows.items()}, rows["y"][sound] == 0)


def verdicts(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    s = F.col("s")
    rows = docs.select("doc_id", stats("text").alias("s"))
    return rows.select("doc_id", *[s[c].alias(c) for c in BASE], base_failed(s).alias("base_failed"), (~base_failed(s) & decision(rules, s).isNull()).alias("kept"), decision(rules, s).alias("rule"))


def keep_good(docs: DataFrame, labels: DataFrame, learn_from: DataFrame | None = None, **kw) -> DataFrame:
    """The rows of docs that neither the base rules nor the learned list reject, columns unchanged.

    The list is learned from the labelled rows of `learn_from`, if docs has lost most of the bad ones.
    """
    rules = fit_rules(docs if learn_from is None else learn_from, labels, **kw)
    name = scratch("stats")
    s = F.col(name)
    return docs.withColumn(name, stats("text")).where(~base_failed(s) & decision(rules, s).isNull()).select(*[F.col(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return verdicts(docs, fit_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
