"""Named queries over the driver's tables, each with the same query as DuckDB SQL where SQL can say it.

A key begins with the ids of the operators of the survey that it covers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill import lexicons, views
from gristmill.functions import text as text_fns
from gristmill.functions.numeric import min_max_or_half, rounded
from gristmill.operators import aspects, dashboard, health, ingest, priority, probes, quality, retrieval, scorers, sentiment, vectors, vote
from gristmill.sources import tables
from gristmill.views import APPS, AS_OF, KNOWN, LABELLED, MENTIONS, NAMED, RAW, REVIEWS, RUN_LOG, RUNS, SEQ, with_

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Words that are frequent in the driver's documents stand for aspects.
VOCABULARY = ("the", "of", "and", "de", "to", "in", "is", "a", "der", "la", "that", "it", "for")
FORMS = {"the": "article", "der": "article", "la": "article", "of": "preposition"}
EMPTY = ("is", "it")
PART_FORMS: dict[str, str | None] = {"hot": None, "red": "rouge", "blue": "bleu"}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return sentiment.with_labels(views.named_reviews(spark, d))


def _in(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _sql_map(forms: dict) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in forms.items()) + "}"


def _pct(a: str, b: str) -> str:
    return f"CAST(100 * {a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0)"


# ---- the issue backlog

STATS = f"""{MENTIONS}, stats AS (SELECT app_name, aspect, count(*) AS mention_count, count(*) FILTER (WHERE label = 'negative') AS negative_count,
  count(*) FILTER (WHERE label = 'positive') AS positive_count,
  round_even(CAST(count(*) FILTER (WHERE label = 'negative') AS DOUBLE) / count(*), 3) AS negative_rate, round_even(CAST(sum(rating) AS DOUBLE) / count(rating), 2) AS avg_rating,
  round_even(coalesce(CAST(count(*) FILTER (WHERE label = 'negative' AND date > TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY) AS DOUBLE) / nullif(count(*) FILTER (WHERE label = 'negative'), 0), 0), 3) AS recency_score_raw
  FROM mentions GROUP BY app_name, aspect)"""
BACKLOG = f"""{STATS}, kept AS (SELECT * FROM stats WHERE mention_count >= 10),
ends AS (SELECT min(negative_rate) AS n0, max(negative_rate) AS n1, CAST(min(mention_count) AS DOUBLE) AS v0, CAST(max(mention_count) AS DOUBLE) AS v1, min(recency_score_raw) AS r0, max(recency_score_raw) AS r1 FROM kept),
scaled AS (SELECT kept.*, CASE WHEN n1 = n0 THEN 0.5 ELSE (negative_rate - n0) / (n1 - n0) END AS sentiment_norm,
  CASE WHEN v1 = v0 THEN 0.5 ELSE (mention_count - v0) / (v1 - v0) END AS volume_norm, CASE WHEN r1 = r0 THEN 0.5 ELSE (recency_score_raw - r0) / (r1 - r0) END AS recency_norm FROM kept, ends),
scored AS (SELECT *, round_even(CAST(0.40 AS DOUBLE) * sentiment_norm + CAST(0.35 AS DOUBLE) * volume_norm + CAST(0.25 AS DOUBLE) * recency_norm, 4) AS priority_score FROM scaled),
backlog AS (SELECT *, CAST(row_number() OVER (ORDER BY priority_score DESC, app_name, aspect) AS INTEGER) AS rank FROM scored)"""
_BACKLOG_COLUMNS = "rank, app_name, aspect, mention_count, negative_count, positive_count, negative_rate, avg_rating, recency_score_raw, sentiment_norm, volume_norm, recency_norm, priority_score"


def _backlog(spark: SparkSession, d: str) -> DataFrame:
    return priority.backlog(views.mentions(spark, d), AS_OF)


@_query("v11_issue_backlog", with_(BACKLOG) + f"SELECT {_BACKLOG_COLUMNS} FROM backlog")
def _(spark, d):
    return _backlog(spark, d).select(*_BACKLOG_COLUMNS.split(", "))


@_query("a16_v12_aspect_stats", with_(STATS) + "SELECT * FROM stats")
def _(spark, d):
    return priority.aspect_stats(views.mentions(spark, d), AS_OF)


@_query("p14_minimum_volume", with_(STATS) + "SELECT app_name, aspect, mention_count FROM stats WHERE mention_count >= 40")
def _(spark, d):
    return priority.aspect_stats(views.mentions(spark, d), AS_OF).where("mention_count >= 40").select("app_name", "aspect", "mention_count")


@_query("a17_w7_min_max", "SELECT c_custkey, CASE WHEN hi = lo THEN 0.5 ELSE (c_acctbal - lo) / (hi - lo) END AS scaled FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)")
def _(spark, d):
    return min_max_or_half(views.table(spark, d, "customer").select("c_custkey", "c_acctbal"), {"c_acctbal": "scaled"}).select("c_custkey", "scaled")


@_query("w2_best_issue_per_app", with_(BACKLOG) + "SELECT app_name, aspect, priority_score FROM (SELECT *, row_number() OVER (PARTITION BY app_name ORDER BY priority_score DESC, aspect) AS k FROM backlog) WHERE k = 1")
def _(spark, d):
    return priority.best_per_app(_backlog(spark, d)).select("app_name", "aspect", "priority_score")


@_query("w3_t4_top_issues", with_(BACKLOG) + "SELECT rank, app_name, aspect, priority_score FROM backlog ORDER BY rank LIMIT 20")
def _(spark, d):
    return priority.top(_backlog(spark, d), 20).select("rank", "app_name", "aspect", "priority_score")


@_query(
    "p17_p18_backlog_display",
    with_(BACKLOG) + "SELECT rank AS \"Rank\", app_name || ' / ' || aspect AS \"Issue\", round_even(priority_score, 3) AS \"Score\", printf('%.1f', round_even(negative_rate * 100, 1)) || '%' AS \"Neg%\", mention_count AS \"Mentions\", round_even(avg_rating, 2) AS \"Avg rating\" FROM backlog ORDER BY rank LIMIT 20",
)
def _(spark, d):
    return dashboard.backlog_display(_backlog(spark, d), 20)


@_query(
    "a18_a19_backlog_tiles",
    with_(BACKLOG) + "SELECT count(*) AS n_issues, (SELECT app_name FROM backlog GROUP BY app_name ORDER BY round(avg(priority_score), 9) DESC, app_name LIMIT 1) AS top_app, printf('%.1f', round_even(avg(negative_rate) * 100, 1)) || '%' AS negative_rate FROM backlog",
)
def _(spark, d):
    return dashboard.backlog_tiles(_backlog(spark, d))


# ---- labels

_LABEL_COLUMNS = "review_id, vader_label, vader_method, combined_label, combined_score, combined_weight_rating, rating_signal"


@_query("v1_v2_v5_sentiment_labels", with_(LABELLED) + f"SELECT {_LABEL_COLUMNS} FROM labelled")
def _(spark, d):
    return _labelled(spark, d).select(*_LABEL_COLUMNS.split(", "))


@_query(
    "v31_disagreement",
    with_(LABELLED)
    + """SELECT count(*) AS n, count(*) FILTER (WHERE vader_label IS NULL OR combined_label IS NULL OR vader_label <> combined_label) AS n_differ,
  CAST(count(*) FILTER (WHERE vader_label IS NULL OR combined_label IS NULL OR vader_label <> combined_label) AS DOUBLE) / count(*) AS share_differ,
  count(*) FILTER (WHERE combined_label IS NULL OR rating_signal IS NULL OR combined_label <> rating_signal) AS n_rating_conflict FROM labelled""",
)
def _(spark, d):
    return sentiment.disagreement(_labelled(spark, d))


VOTES = f"""{LABELLED}, votes AS (SELECT review_id, app_name, rating, replace(substr(text, 1, 100), chr(10), ' ') AS text_preview, rating_signal, vader_label, 'positive' AS llm_label, CAST(0.9 AS DOUBLE) AS llm_confidence,
  CASE WHEN rating_signal = vader_label THEN rating_signal WHEN rating_signal = 'positive' THEN rating_signal WHEN vader_label = 'positive' THEN vader_label ELSE 'ambiguous' END AS final_label,
  CASE WHEN rating_signal = vader_label AND vader_label = 'positive' THEN CAST(1.0 AS DOUBLE) WHEN rating_signal = vader_label OR rating_signal = 'positive' OR vader_label = 'positive'
    THEN CASE WHEN vader_label IS NULL THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.67 AS DOUBLE) END ELSE CAST(0 AS DOUBLE) END AS label_confidence, combined_score, combined_label
  FROM labelled WHERE vader_label <> combined_label OR rating = 3)"""


def _votes(spark, d):
    return vote.settle(_labelled(spark, d), F.lit("positive"), F.lit(0.9))


_VOTE_COLUMNS = "review_id, app_name, rating, text_preview, rating_signal, vader_label, llm_label, llm_confidence, final_label, label_confidence"


@_query("v3_v4_p7_conflict_votes", with_(VOTES) + f"SELECT {_VOTE_COLUMNS}, CASE WHEN final_label = 'ambiguous' THEN 'none' ELSE final_label END AS label_source, combined_score FROM votes")
def _(spark, d):
    return _votes(spark, d)


@_query("t3_conflict_order", with_(VOTES) + "SELECT review_id, CASE WHEN vader_label <> combined_label THEN 0 ELSE 1 END AS first, combined_score FROM votes ORDER BY first, abs(combined_score) DESC NULLS LAST, review_id LIMIT 50")
def _(spark, d):
    rows = vote.in_order(vote.conflicts(_labelled(spark, d))).limit(50)
    return rows.select("review_id", F.when(F.col("vader_label") != F.col("combined_label"), 0).otherwise(1).alias("first"), "combined_score")


@_query(
    "a34_vote_summary",
    with_(VOTES) + """SELECT 'label' AS kind, final_label AS value, count(*) AS n FROM votes GROUP BY final_label
UNION ALL SELECT 'source', CASE WHEN final_label = 'ambiguous' THEN 'none' ELSE final_label END, count(*) FROM votes GROUP BY 2""",
)
def _(spark, d):
    return vote.summary(_votes(spark, d))


@_query("a34_ambiguous_samples", with_(VOTES) + "SELECT review_id, app_name, rating, vader_label, llm_label, text_preview FROM votes WHERE final_label = 'ambiguous' ORDER BY CASE WHEN vader_label <> combined_label THEN 0 ELSE 1 END, abs(combined_score) DESC NULLS LAST, review_id LIMIT 3")
def _(spark, d):
    return vote.ambiguous_samples(_votes(spark, d), _labelled(spark, d))


@_query(
    "s10_vote_write_back",
    with_(VOTES) + """SELECT l.review_id, CASE WHEN v.review_id IS NULL THEN 'old' ELSE v.final_label END AS final_label, CASE WHEN v.review_id IS NULL THEN CAST(0.5 AS DOUBLE) WHEN v.rating = 3 THEN NULL ELSE v.label_confidence END AS label_confidence,
  CASE WHEN v.review_id IS NOT NULL THEN CASE WHEN v.final_label = 'ambiguous' THEN 'none' ELSE v.final_label END END AS label_source FROM labelled l LEFT JOIN votes v ON l.review_id = v.review_id""",
)
def _(spark, d):
    stored = _labelled(spark, d).select("review_id", F.lit("old").alias("final_label"), F.lit(0.5).alias("label_confidence"))
    votes = _votes(spark, d).withColumn("label_confidence", F.when(F.col("rating") != 3, F.col("label_confidence")))
    return vote.write_back(stored, votes)


@_query(
    "p20_reuse_model_label",
    "SELECT d.doc_id, coalesce(CASE l.toxic WHEN 1 THEN 'negative' WHEN 0 THEN 'neutral' END, 'positive') AS label, CASE WHEN l.toxic IS NULL THEN CAST(0.9 AS DOUBLE) END AS confidence FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
)
def _(spark, d):
    rows = views.table(spark, d, "documents").select("doc_id").join(views.table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    known = F.when(F.col("toxic") == 1, "negative").when(F.col("toxic") == 0, "neutral")
    label, sure = vote.reuse_or_score(known, F.lit("positive"), F.lit(0.9))
    return rows.select("doc_id", label.alias("label"), sure.alias("confidence"))


# ---- dashboards


@_query(
    "a32_a26_overview",
    with_(LABELLED, RUNS) + f"SELECT (SELECT count(*) FROM named) AS n_reviews, (SELECT count(DISTINCT app_name) FROM named) AS n_apps, (SELECT count(*) FROM runs) AS n_runs, {_pct("count(*) FILTER (WHERE combined_label = 'negative')", 'count(*)')} AS negative_pct FROM labelled",
)
def _(spark, d):
    rows = _labelled(spark, d)
    return dashboard.overview(rows, rows, views.runs(spark, d))


@_query("a13_label_counts", with_(LABELLED) + "SELECT combined_label AS value, count(*) AS n FROM labelled GROUP BY combined_label")
def _(spark, d):
    return dashboard.label_counts(_labelled(spark, d))


@_query(
    "a15_sentiment_by_app",
    with_(LABELLED) + ", t AS (SELECT app_name, " + ", ".join(f"count(*) FILTER (WHERE combined_label = '{x}') AS n_{x}" for x in dashboard.LABELS) + " FROM labelled GROUP BY app_name) SELECT *, "
    + ", ".join(f"{_pct(f'n_{x}', '(n_positive + n_neutral + n_negative)')} AS pct_{x}" for x in dashboard.LABELS) + " FROM t",
)
def _(spark, d):
    return dashboard.sentiment_by_app(_labelled(spark, d))


@_query("a25_sentiment_share", with_(LABELLED) + f", t AS (SELECT app_name, count(*) AS n, count(*) FILTER (WHERE vader_label = 'positive') AS n_positive, count(*) FILTER (WHERE vader_label = 'negative') AS n_negative FROM labelled GROUP BY app_name) SELECT *, {_pct('n_positive', 'n')} AS pct_positive, {_pct('n_negative', 'n')} AS pct_negative FROM t")
def _(spark, d):
    return dashboard.sentiment_share(_labelled(spark, d).select("app_name", F.col("vader_label").alias("combined_label")))


_MONTH = "strftime(date, '%Y-%m')"
_WEEK = "strftime(date_trunc('week', date), '%Y-%m-%d') || '/' || strftime(date_trunc('week', date) + INTERVAL 6 DAY, '%Y-%m-%d')"
for _weekly, _label in ((False, _MONTH), (True, _WEEK)):
    _unit = "weekly" if _weekly else "monthly"

    @_query(f"v26_f17_f18_a14_w1_trend_{_unit}", with_(LABELLED) + f", c AS (SELECT {_label} AS period, combined_label, count(*) AS n FROM labelled GROUP BY 1, 2) SELECT *, {_pct('n', 'sum(n) OVER (PARTITION BY period)')} AS pct FROM c")
    def _(spark, d, weekly=_weekly):
        rows = _labelled(spark, d)
        return dashboard.trend(rows, rows, weekly)

    @_query(f"j4_j5_negative_rate_{_unit}", with_(LABELLED) + f", c AS (SELECT {_label} AS period, count(*) FILTER (WHERE combined_label = 'negative') AS negative, count(*) AS total FROM labelled GROUP BY 1) SELECT *, {_pct('negative', 'total')} AS negative_pct FROM c WHERE negative > 0")
    def _(spark, d, weekly=_weekly):
        rows = _labelled(spark, d)
        return dashboard.negative_rate(rows, rows, weekly)


@_query("t4_p17_conflict_rows", with_(LABELLED) + 'SELECT app_name AS "App", rating AS "Stars", vader_label AS "Text label", combined_label AS "Combined", text AS "Review text" FROM labelled WHERE vader_label IS NULL OR vader_label <> combined_label ORDER BY review_id LIMIT 20')
def _(spark, d):
    return dashboard.conflict_rows(_labelled(spark, d))


@_query("t10_app_list", "SELECT DISTINCT n_name AS app_name FROM nation")
def _(spark, d):
    return dashboard.app_list(views.apps(spark, d))


_SOME_APPS = [f"NATION_{k}" for k in (1, 9, 17)]


@_query("p5_p6_p1_j1_app_filter", with_(NAMED) + f"SELECT review_id, app_name, rating, date FROM named WHERE app_name IN ({_in(_SOME_APPS)})")
def _(spark, d):
    return dashboard.app_filter(views.named_reviews(spark, d), _SOME_APPS).select("review_id", "app_name", "rating", "date")


@_query("a21_length_histogram", "WITH t AS (SELECT length(coalesce(text, '')) AS k FROM documents) SELECT least(CAST(floor(CAST(k AS DOUBLE) / 5) AS BIGINT), 59) AS bin, count(*) AS n, least(CAST(floor(CAST(k AS DOUBLE) / 5) AS BIGINT), 59) * CAST(5 AS DOUBLE) AS bin_start FROM t WHERE k BETWEEN 0 AND 300 GROUP BY 1")
def _(spark, d):
    return dashboard.histogram(dashboard.text_lengths(views.table(spark, d, "documents")), "text_len", 0.0, 300.0, 60)


@_query("a20_median_length", "SELECT quantile_cont(length(coalesce(text, '')), 0.5) AS median, CAST(trunc(quantile_cont(length(coalesce(text, '')), 0.5)) AS INTEGER) AS label FROM documents")
def _(spark, d):
    return dashboard.median_length(views.table(spark, d, "documents"))


@_query(
    "a8_p10_p12_quality_tiles",
    "SELECT count(*) AS n, count(*) FILTER (WHERE length(coalesce(text, '')) < 10) AS n_under_10, count(*) FILTER (WHERE length(coalesce(text, '')) < 20) AS n_under_20, count(*) FILTER (WHERE text IS NULL) AS n_missing, "
    "(SELECT CAST(coalesce(sum(g - 1), 0) AS BIGINT) FROM (SELECT count(*) AS g FROM documents GROUP BY lang, text)) AS n_extras FROM documents",
)
def _(spark, d):
    return dashboard.quality_tiles(views.table(spark, d, "documents").select(F.col("lang").alias("app_name"), "text"))


@_query("a9_common_duplicates", "SELECT lang AS app_name, replace(substr(text, 1, 40), chr(10), ' ') AS text_preview, n FROM (SELECT lang, text, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY lang, text HAVING count(*) > 1 ORDER BY n DESC, lang, text LIMIT 10)")
def _(spark, d):
    return dashboard.common_duplicates(views.table(spark, d, "documents").select(F.col("lang").alias("app_name"), "text"))


#: Two words of a part's name stand for the aspects of a mention.
_PART_ASPECTS = "pa AS (SELECT n_name AS app_name, string_split(p_name, ' ') AS aspects, CASE WHEN (l_partkey + l_linenumber + l_orderkey) % 5 <= 1 THEN 'negative' WHEN (l_partkey + l_linenumber + l_orderkey) % 5 >= 3 THEN 'positive' ELSE 'neutral' END AS combined_label FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"


def _part_aspects(spark, d):
    return views.mentions(spark, d).select("app_name", F.split("aspect", " ").alias("aspects"), F.col("label").alias("combined_label"))


@_query("a22_f26_aspect_counts", with_(_PART_ASPECTS) + "SELECT aspect, count(*) AS n FROM (SELECT unnest(aspects) AS aspect FROM pa) GROUP BY aspect ORDER BY n DESC, aspect LIMIT 20")
def _(spark, d):
    return dashboard.aspect_counts(_part_aspects(spark, d), 20)


@_query(
    "a23_j9_aspect_sentiment",
    with_(_PART_ASPECTS) + f"""SELECT aspect, sentiment, CAST(sum(CASE WHEN combined_label = sentiment THEN 1 ELSE 0 END) AS BIGINT) AS n, {_pct('sum(CASE WHEN combined_label = sentiment THEN 1 ELSE 0 END)', 'count(*)')} AS pct
FROM (SELECT unnest(list_distinct(aspects)) AS aspect, combined_label FROM pa), (VALUES ('positive'), ('neutral'), ('negative')) s(sentiment)
WHERE aspect IN (SELECT a FROM (SELECT unnest(aspects) AS a FROM pa) GROUP BY a ORDER BY count(*) DESC, a LIMIT 15) GROUP BY aspect, sentiment""",
)
def _(spark, d):
    return dashboard.aspect_sentiment(_part_aspects(spark, d), 15)


@_query("a24_top_negative_aspects", with_(_PART_ASPECTS) + "SELECT app_name, aspect, n, CAST(place AS INTEGER) AS place FROM (SELECT app_name, aspect, count(*) AS n, row_number() OVER (PARTITION BY app_name ORDER BY count(*) DESC, aspect) AS place FROM (SELECT app_name, unnest(aspects) AS aspect FROM pa WHERE combined_label = 'negative') GROUP BY app_name, aspect) WHERE place <= 5")
def _(spark, d):
    return dashboard.top_negative_aspects(_part_aspects(spark, d), 5)


# ---- runs and health


@_query("j8_w5_first_runs", with_(RUNS) + "SELECT id, app_id, started_at, rank() OVER (PARTITION BY app_id ORDER BY started_at) = 1 AS is_first FROM runs")
def _(spark, d):
    return health.with_first_run(views.runs(spark, d)).select("id", "app_id", "started_at", "is_first")


@_query("a1_a4_p11_run_health", with_(RUNS) + ", t AS (SELECT count(*) AS n_runs, count(*) FILTER (WHERE status = 'success') AS n_success, count(*) FILTER (WHERE status = 'failed') AS n_failed, count(*) FILTER (WHERE status = 'in_progress') AS n_in_progress FROM runs) SELECT *, CAST(n_failed AS DOUBLE) / n_runs AS failure_rate, CAST(n_failed AS DOUBLE) / n_runs > CAST(0.2 AS DOUBLE) AS alert FROM t")
def _(spark, d):
    return health.run_health(views.runs(spark, d))


@_query(
    "j2_t1_f21_p15_latest_runs",
    with_(RUNS, APPS) + ", f AS (SELECT *, rank() OVER (PARTITION BY app_id ORDER BY started_at) = 1 AS is_first FROM runs) SELECT id, app_name, strftime(started_at, '%Y-%m-%d %H:%M') AS started, CASE status WHEN 'success' THEN '[ok]' WHEN 'failed' THEN '[failed]' ELSE '[running]' END AS state, reviews_collected, is_first FROM f JOIN apps USING (app_id) ORDER BY started_at DESC, id DESC LIMIT 30",
)
def _(spark, d):
    return health.latest_runs(views.runs(spark, d), views.apps(spark, d), 30)


@_query("t2_newest_runs", with_(RUNS) + "SELECT id, app_id, started_at, reviews_collected FROM runs ORDER BY started_at DESC, id DESC LIMIT 50")
def _(spark, d):
    return dashboard.newest_runs(views.runs(spark, d)).select("id", "app_id", "started_at", "reviews_collected")


@_query("a12_low_volume", with_(RUNS, APPS) + ", f AS (SELECT *, rank() OVER (PARTITION BY app_id ORDER BY started_at) AS k FROM runs) SELECT id, app_name, reviews_collected FROM f JOIN apps USING (app_id) WHERE k = 1 AND status = 'success' AND reviews_collected < 100")
def _(spark, d):
    return health.low_volume_runs(views.runs(spark, d), views.apps(spark, d))


@_query("a3_date_range", with_(REVIEWS) + "SELECT min(date) AS first_date, max(date) AS last_date FROM reviews")
def _(spark, d):
    return health.date_range(views.reviews(spark, d))


@_query("a2_reviews_per_app", with_(NAMED) + "SELECT app_name, count(*) AS n FROM named GROUP BY app_name")
def _(spark, d):
    return health.reviews_per_app(views.named_reviews(spark, d))


@_query("a5_rating_histogram", with_(REVIEWS) + f"SELECT rating, count(*) AS n, {_pct('count(*)', 'sum(count(*)) OVER ()')} AS pct FROM reviews GROUP BY rating")
def _(spark, d):
    return health.rating_histogram(views.reviews(spark, d))


@_query("a6_duplicate_groups", "SELECT lang, count(*) AS n_groups FROM (SELECT lang, text FROM documents WHERE text IS NOT NULL GROUP BY lang, text HAVING count(*) > 1) GROUP BY lang")
def _(spark, d):
    return health.duplicate_groups(views.table(spark, d, "documents"), "lang").groupBy("lang").agg(F.count(F.lit(1)).alias("n_groups"))


_DUP = "g AS (SELECT lang, text, count(*) AS n FROM documents GROUP BY lang, text)"


@_query(
    "a6_a7_a8_a12_duplicate_report",
    with_(_DUP) + ", t AS (SELECT count(*) FILTER (WHERE text IS NOT NULL AND n > 1) AS n_groups, CAST(coalesce(sum(n) FILTER (WHERE text IS NOT NULL AND n > 1), 0) AS BIGINT) AS n_members, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n_extras, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM g) SELECT *, CAST(n_members AS DOUBLE) / n AS rate, CAST(n_members AS DOUBLE) / n > CAST(0.25 AS DOUBLE) AS alert FROM t",
)
def _(spark, d):
    return health.duplicate_report(views.table(spark, d, "documents"), "lang")


@_query("w4_duplicate_members", "SELECT doc_id, lang FROM (SELECT doc_id, lang, count(*) OVER (PARTITION BY lang, text) AS n FROM documents) WHERE n > 1")
def _(spark, d):
    return quality.duplicate_members(views.table(spark, d, "documents").select("doc_id", "lang", "text"), ("lang", "text")).select("doc_id", "lang")


@_query("a10_short_texts", "WITH t AS (SELECT count(*) AS n, count(*) FILTER (WHERE length(text) < 10) AS n_under_10, count(*) FILTER (WHERE length(text) < 20) AS n_under_20 FROM documents) SELECT *, CAST(n_under_10 AS DOUBLE) / n AS rate_under_10, CAST(n_under_20 AS DOUBLE) / n AS rate_under_20, CAST(n_under_20 AS DOUBLE) / n > CAST(0.3 AS DOUBLE) AS alert FROM t")
def _(spark, d):
    return health.short_texts(views.table(spark, d, "documents"))


@_query(
    "a11_p12_missing_fields",
    "WITH t AS (SELECT d.doc_id, text, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) SELECT field, n_missing, CAST(n_missing AS DOUBLE) / n AS rate FROM (SELECT unnest(['text', 'quality', 'toxic']) AS field, unnest([count(*) - count(text), count(*) - count(quality), count(*) - count(toxic)]) AS n_missing, count(*) AS n FROM t)",
)
def _(spark, d):
    rows = views.table(spark, d, "documents").select("doc_id", "text").join(views.table(spark, d, "labels"), "doc_id", "left")
    return health.missing_fields(rows, ["text", "quality", "toxic"])


_REPORT = with_(NAMED, RUNS) + """, r AS (SELECT *, CASE WHEN length(text) % 3 = 0 THEN lang END AS app_version, CASE WHEN rating > 4 THEN NULL ELSE 'thanks' END AS reply FROM named),
g AS (SELECT app_id, any_value(app_name) AS app_name, text, count(*) AS n FROM r WHERE text IS NOT NULL GROUP BY app_id, text HAVING count(*) > 1),
first_starts AS (SELECT app_id, min(started_at) AS started_at FROM runs GROUP BY app_id),
f AS (SELECT *, NOT EXISTS (SELECT 1 FROM first_starts e WHERE e.app_id = runs.app_id AND e.started_at < runs.started_at) AS is_first FROM runs),
l AS (SELECT f.*, app_name, row_number() OVER (ORDER BY started_at DESC, id DESC) AS place FROM f JOIN apps USING (app_id) QUALIFY place <= 10),
t AS (SELECT (SELECT count(*) FROM r) AS n_reviews, (SELECT count(*) FROM apps) AS n_apps, (SELECT count(*) FROM runs) AS n_runs, (SELECT count(*) FROM runs WHERE status = 'success') AS n_success,
  (SELECT count(*) FROM runs WHERE status = 'failed') AS n_failed, (SELECT min(date) FROM r) AS d0, (SELECT max(date) FROM r) AS d1,
  (SELECT count(*) FROM r WHERE app_version IS NULL) AS no_version, (SELECT count(*) FROM r WHERE reply IS NULL) AS no_reply,
  (SELECT count(*) FROM r WHERE length(text) < 10) AS s10, (SELECT count(*) FROM r WHERE length(text) < 20) AS s20,
  (SELECT count(*) FROM g) AS n_groups, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM g) AS n_members),
low AS (SELECT app_name || ': ' || reviews_collected || ' reviews in its first run' AS detail FROM l WHERE is_first AND status = 'success' AND reviews_collected < 100),
al AS (SELECT 1 AS place, 'failure_rate' AS metric, n_failed || ' of ' || n_runs || ' runs failed' AS detail FROM t WHERE CAST(n_failed AS DOUBLE) / n_runs > CAST(0.2 AS DOUBLE)
  UNION ALL SELECT 2, 'short_texts', s20 || ' of ' || n_reviews || ' texts are under 20 characters' FROM t WHERE CAST(s20 AS DOUBLE) / n_reviews > CAST(0.3 AS DOUBLE)
  UNION ALL SELECT 3, 'duplicates', n_members || ' of ' || n_reviews || ' texts are repeated' FROM t WHERE CAST(n_members AS DOUBLE) / n_reviews > CAST(0.25 AS DOUBLE)
  UNION ALL SELECT 4, 'low_volume', detail FROM low)
"""


@_query(
    "v27_health_report",
    _REPORT + """, q AS (SELECT unnest(['missing_app_version', 'missing_reply', 'n_under_10', 'n_under_20', 'duplicate_members']) AS metric, unnest([no_version, no_reply, s10, s20, n_members]) AS v, unnest([0, 1, 2, 3, 4]) AS i, n_reviews FROM t)
SELECT section, CAST(place AS INTEGER) AS place, metric, CAST(value AS DOUBLE) AS value, detail FROM (
SELECT 'overview' AS section, unnest([1, 2, 3, 4, 5, 6]) AS place, unnest(['n_reviews', 'n_apps', 'n_runs', 'n_success', 'n_failed', 'failure_rate']) AS metric,
  unnest([CAST(n_reviews AS DOUBLE), n_apps, n_runs, n_success, n_failed, CAST(n_failed AS DOUBLE) / n_runs]) AS value, CAST(NULL AS VARCHAR) AS detail FROM t
UNION ALL SELECT 'overview', unnest([7, 8]), unnest(['first_date', 'last_date']), NULL, unnest([strftime(d0, '%Y-%m-%d %H:%M:%S'), strftime(d1, '%Y-%m-%d %H:%M:%S')]) FROM t
UNION ALL SELECT 'runs', place, app_name, reviews_collected, CASE status WHEN 'success' THEN '[ok]' WHEN 'failed' THEN '[failed]' ELSE '[running]' END || ' ' || strftime(started_at, '%Y-%m-%d %H:%M') FROM l
UNION ALL SELECT 'apps', row_number() OVER (ORDER BY count(*) DESC, app_name), app_name, count(*), NULL FROM r GROUP BY app_name
UNION ALL SELECT 'quality', 2 * i + 1, metric, v, NULL FROM q UNION ALL SELECT 'quality', 2 * i + 2, metric || '_rate', CAST(v AS DOUBLE) / n_reviews, NULL FROM q
UNION ALL SELECT 'quality', 11, 'duplicate_groups', n_groups, NULL FROM t
UNION ALL SELECT 'repeated', row_number() OVER (ORDER BY n DESC, app_name, p), app_name, n, p FROM (SELECT app_name, n, replace(substr(text, 1, 40), chr(10), ' ') AS p FROM g ORDER BY n DESC, app_name, text LIMIT 5)
UNION ALL SELECT 'ratings', row_number() OVER (ORDER BY rating), 'stars_' || rating, count(*), CAST(round_even(CAST(100 * count(*) AS DOUBLE) / sum(count(*)) OVER (), 1) AS VARCHAR) || '%' FROM r GROUP BY rating
UNION ALL SELECT 'alerts', place, metric, NULL, detail FROM al
UNION ALL SELECT 'verdict', 1, CASE WHEN count(*) > 0 THEN 'WARNING' ELSE 'HEALTHY' END, count(*), NULL FROM al)""",
)
def _(spark, d):
    rows = views.named_reviews(spark, d)
    rows = rows.withColumns({"app_version": F.when(F.length("text") % 3 == 0, F.col("lang")), "reply": F.when(F.col("rating") <= 4, "thanks")})
    return health.report(rows, views.runs(spark, d), views.apps(spark, d))


@_query("v27_alerts", _REPORT + "SELECT metric AS alert, detail FROM al")
def _(spark, d):
    return health.alerts(views.named_reviews(spark, d), views.runs(spark, d), views.apps(spark, d))


@_query("a30_w8_degradation", with_(RUN_LOG) + ", t AS (SELECT *, first_value(CASE WHEN status = 'success' THEN returned END IGNORE NULLS) OVER (PARTITION BY probe ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS first_count FROM run_log) SELECT *, coalesce(first_count > 0 AND returned < first_count * CAST(0.8 AS DOUBLE), false) AS throttled FROM t")
def _(spark, d):
    return probes.degradation(views.run_log(spark, d))


@_query("a30_fill_rate", with_(RUN_LOG) + f"SELECT *, CASE WHEN status = 'success' AND requested > 0 THEN {_pct('returned', 'requested')} END AS fill_pct, status = 'success' AND returned < requested * CAST(0.5 AS DOUBLE) AS short FROM run_log")
def _(spark, d):
    return probes.fill_rate(views.run_log(spark, d))


# ---- ingest

_NEW = f"""{RAW}, {KNOWN}, fresh AS (SELECT * FROM raw WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.app_id = raw.app_id AND k.review_id = raw.review_id)),
attempted AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY app_id, review_id ORDER BY {SEQ}) AS k FROM fresh) WHERE k = 1),
allowed AS (SELECT * EXCLUDE (k) FROM attempted WHERE rating BETWEEN 1 AND 5 AND app_id IN (SELECT n_nationkey FROM nation)),
stored AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY {SEQ}) AS k FROM allowed) WHERE k = 1 AND review_id NOT IN (SELECT review_id FROM known))"""


def _batch(spark, d):
    return ingest.coerce(views.raw_batch(spark, d), "en", "us", "2024-01-01 00:00:00")


@_query("i1_i2_i3_i4_i5_i7_i8_new_reviews", with_(_NEW) + "SELECT review_id, app_id, rating, text, date, CAST(thumbs_up AS INTEGER) AS thumbs_up, 'en' AS lang, 'us' AS country FROM stored")
def _(spark, d):
    return ingest.new_reviews(_batch(spark, d), views.known_reviews(spark, d), views.apps(spark, d)).select("review_id", "app_id", "rating", "text", "date", "thumbs_up", "lang", "country")


_COUNTS = f"{_NEW}, counts AS (SELECT app_id, count(*) AS fetched, (SELECT count(*) FROM attempted a WHERE a.app_id = raw.app_id) AS attempted, (SELECT count(*) FROM stored s WHERE s.app_id = raw.app_id) AS stored FROM raw GROUP BY app_id)"


@_query("i6_i10_ingest_counts", with_(_COUNTS) + "SELECT *, fetched - attempted AS skipped FROM counts")
def _(spark, d):
    return ingest.ingest_counts(_batch(spark, d), views.known_reviews(spark, d), views.apps(spark, d))


@_query("i9_finished_runs", with_(_COUNTS) + "SELECT n_nationkey AS app_id, TIMESTAMP '2024-01-01' AS started_at, TIMESTAMP '2024-01-01 01:00:00' AS completed_at, CAST(coalesce(attempted, 0) AS INTEGER) AS reviews_collected, CASE WHEN coalesce(fetched, 0) = 0 THEN 'failed' ELSE 'success' END AS status FROM nation LEFT JOIN counts ON n_nationkey = app_id")
def _(spark, d):
    counts = ingest.ingest_counts(_batch(spark, d), views.known_reviews(spark, d), views.apps(spark, d))
    return ingest.finished_runs(views.apps(spark, d), counts, "2024-01-01 00:00:00", "2024-01-01 01:00:00")


@_query("i11_surrogate_ids", "SELECT o_orderkey, CAST(1000 + row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS id FROM orders")
def _(spark, d):
    rows = views.table(spark, d, "orders").select("o_orderdate", "o_orderkey")
    return ingest.with_ids(rows, ["o_orderdate", "o_orderkey"], start=1000).select("o_orderkey", F.col("id").cast("bigint").alias("id"))


@_query("i12_summary", with_(NAMED, RUNS) + "SELECT app_name, n, CAST((SELECT count(*) FROM named) AS BIGINT) AS total FROM (SELECT app_name, count(*) AS n FROM named GROUP BY app_name)")
def _(spark, d):
    parts = ingest.summary(views.named_reviews(spark, d), views.runs(spark, d), views.apps(spark, d))
    return parts["per_app"].join(F.broadcast(parts["total"].withColumnRenamed("n", "total")))  # one row


#: Stored rows and a batch of changes in which keys repeat, some new, some values null; seq is the place in the batch.
_UPSERT = """stored AS (SELECT s_suppkey AS key, s_name AS name, s_acctbal AS balance, CAST(s_nationkey AS VARCHAR) AS segment FROM supplier),
batch AS (SELECT c_custkey % 150 AS key, c_name AS name, CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END AS balance, c_custkey AS seq FROM customer),
newest AS (SELECT * EXCLUDE (seq) FROM batch b WHERE NOT EXISTS (SELECT 1 FROM batch o WHERE o.key = b.key AND o.seq > b.seq)),
oldest AS (SELECT * EXCLUDE (seq) FROM batch b WHERE NOT EXISTS (SELECT 1 FROM batch o WHERE o.key = b.key AND o.seq < b.seq))"""


def _customers(spark, d):
    return views.table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))


def _suppliers(spark, d):
    return views.table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("string").alias("segment"))


def _changes(spark, d):
    balance = F.when(F.col("c_custkey") % 3 > 0, F.col("c_acctbal"))
    return views.table(spark, d, "customer").select((F.col("c_custkey") % 150).alias("key"), F.col("c_name").alias("name"), balance.alias("balance"), F.col("c_custkey").alias("seq"))


@_query("s8_upsert_replace", with_(_UPSERT) + "SELECT *, CAST(NULL AS VARCHAR) AS segment FROM newest UNION ALL SELECT * FROM stored WHERE key NOT IN (SELECT key FROM batch)")
def _(spark, d):
    return ingest.upsert_replace(_suppliers(spark, d), _changes(spark, d), "key", "seq")


@_query("s9_upsert_ignore", with_(_UPSERT) + "SELECT key, name, balance FROM stored UNION ALL SELECT * FROM oldest WHERE key NOT IN (SELECT key FROM stored)")
def _(spark, d):
    return ingest.upsert_ignore(_suppliers(spark, d).drop("segment"), _changes(spark, d), ["key"], "seq")


@_query("s10_update_by_key", with_(_UPSERT) + "SELECT s.key, s.name, CASE WHEN n.key IS NULL THEN s.balance ELSE n.balance END AS balance, segment FROM stored s LEFT JOIN newest n ON s.key = n.key")
def _(spark, d):
    return ingest.update_by_key(_suppliers(spark, d), _changes(spark, d).drop("name"), "key", "seq")


@_query("s12_schema_evolution", "SELECT s_suppkey AS key, s_name AS name, CAST(NULL AS VARCHAR) AS final_label, CAST(NULL AS DOUBLE) AS label_confidence, CAST(NULL AS VARCHAR) AS label_source FROM supplier")
def _(spark, d):
    from gristmill.schemas import VOTE_COLUMNS, add_missing_columns

    return add_missing_columns(_suppliers(spark, d).select("key", "name"), VOTE_COLUMNS)


@_query("s7_vector_preview", "SELECT vec_id, array_to_string(list_transform(embedding[1:5], lambda v: printf('%.4f', CAST(v AS DOUBLE))), ', ') || '...' AS embedding FROM embeddings")
def _(spark, d):
    return tables.vector_preview(views.table(spark, d, "embeddings").select("vec_id", "embedding"), ["embedding"])


# ---- texts, filters, joins


@_query("p2_j1_eligible_reviews", with_(NAMED) + "SELECT review_id, app_name, rating FROM named WHERE text IS NOT NULL AND length(text) >= 10")
def _(spark, d):
    return views.named_reviews(spark, d).where(F.length("text") >= 10).select("review_id", "app_name", "rating")


@_query("p4_usable_vectors", "SELECT vec_id, label FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) >= 10")
def _(spark, d):
    return vectors.usable(views.table(spark, d, "embeddings"), ("embedding",)).select("vec_id", "label")


@_query("j3_p3_features_with_dates", "SELECT d.doc_id, lang, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE lang IS NOT NULL")
def _(spark, d):
    return views.table(spark, d, "documents").where("lang is not null").select("doc_id", "lang").join(views.table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")


_QUESTION = "What is wrong with the der for Version of it?"


@_query("p8_p9_v24_keyword_matches", with_(LABELLED) + f"SELECT review_id, app_name FROM labelled WHERE combined_label = 'negative' AND app_name IN ({_in(_SOME_APPS)}) AND (contains(lower(text), 'wrong') OR contains(lower(text), 'der') OR contains(lower(text), 'version') OR contains(lower(text), 'it?'))")
def _(spark, d):
    return retrieval.matches(_labelled(spark, d), _QUESTION, _SOME_APPS).select("review_id", "app_name")


@_query("t6_v24_excerpts")
def _(spark, d):
    return retrieval.excerpts(_labelled(spark, d), _QUESTION, _SOME_APPS)


@_query(
    "v25_context",
    with_(f"{LABELLED}, {BACKLOG}, {_PART_ASPECTS}") + f""", n AS (SELECT app_name, aspect, count(*) AS n FROM (SELECT app_name, unnest(aspects) AS aspect FROM pa WHERE combined_label = 'negative' AND app_name IN ({_in(_SOME_APPS)})) GROUP BY app_name, aspect),
h AS (SELECT app_name, {_pct("count(*) FILTER (WHERE combined_label = 'positive')", 'count(*)')} AS p, {_pct("count(*) FILTER (WHERE combined_label = 'negative')", 'count(*)')} AS q FROM pa WHERE app_name IN ({_in(_SOME_APPS)}) GROUP BY app_name)
SELECT 'total' AS section, CAST(NULL AS VARCHAR) AS app_name, 'reviews' AS item, CAST(count(*) AS DOUBLE) AS value FROM named
UNION ALL SELECT 'sentiment', app_name, 'positive_pct', p FROM h UNION ALL SELECT 'sentiment', app_name, 'negative_pct', q FROM h
UNION ALL SELECT 'negative_aspect', app_name, aspect, CAST(n AS DOUBLE) FROM (SELECT *, row_number() OVER (PARTITION BY app_name ORDER BY n DESC, aspect) AS k FROM n) WHERE k <= 5
UNION ALL SELECT * FROM (SELECT 'issue', app_name, aspect, priority_score FROM backlog WHERE app_name IN ({_in(_SOME_APPS)}) ORDER BY rank LIMIT 5)""",
)
def _(spark, d):
    return retrieval.context(views.named_reviews(spark, d), _part_aspects(spark, d), _backlog(spark, d), _SOME_APPS)


@_query(
    "f1_f2_f3_f4_f5_f9_p16_text_basics",
    r"""SELECT doc_id, substr(text, 1, 150) AS prefix, regexp_replace(text, '^\s+|\s+$', '', 'g') AS stripped, length(lower(text)) AS n_lower, CAST(len(regexp_extract_all(text, '\S+')) AS INTEGER) AS n_words,
  CAST(len(list_distinct(regexp_extract_all(lower(text), '\S+'))) AS INTEGER) AS n_distinct, replace(substr(text, 1, 40), chr(10), ' ') AS shown FROM documents""",
)
def _(spark, d):
    t = F.col("text")
    return views.table(spark, d, "documents").select(
        "doc_id", F.substring(t, 1, 150).alias("prefix"), text_fns.py_strip(t).alias("stripped"), F.length(F.lower(t)).cast("bigint").alias("n_lower"), F.size(text_fns.tokens(t)).alias("n_words"),
        F.size(F.array_distinct(text_fns.tokens(F.lower(t)))).alias("n_distinct"), text_fns.preview(t, 40).alias("shown"),
    )


@_query(
    "f6_f7_f8_f10_f11_v14_text_features",
    r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t, n_chars % 4 AS votes FROM documents),
w AS (SELECT *, length(t) AS n, regexp_extract_all(t, '\S+') AS words, len(regexp_extract_all(lower(t), '\S+')) AS nw, length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS alpha FROM t)
SELECT doc_id, CAST(n AS INTEGER) AS f_text_len, CAST(nw AS INTEGER) AS f_word_count, coalesce(CAST(list_sum(list_transform(words, lambda x: length(x))) AS DOUBLE) / nullif(nw, 0), 0) AS f_avg_word_len,
  CAST(n AS DOUBLE) / (nw + 1) AS f_char_per_word, CAST(alpha AS DOUBLE) / greatest(n, 1) AS f_alpha_ratio, CAST(length(regexp_replace(t, '[^\p{Nd}]', '', 'g')) AS DOUBLE) / greatest(n, 1) AS f_digit_ratio,
  CAST(len(list_distinct(regexp_extract_all(lower(t), '\S+'))) AS INTEGER) AS f_unique_words, CAST(len(list_distinct(regexp_extract_all(lower(t), '\S+'))) AS DOUBLE) / (nw + 1) AS f_type_token_ratio,
  CAST(nw = 1 AS INTEGER) AS f_is_single_word, CAST(votes AS INTEGER) AS f_thumbs_up, CAST(votes > 0 AS INTEGER) AS f_has_votes, CAST(regexp_matches(t, '[.!?,;]') AS INTEGER) AS f_has_punctuation,
  CAST(greatest(len(string_split_regex(t, '[.!?]+')), 1) AS INTEGER) AS f_sentence_count, CAST(len(list_intersect(regexp_extract_all(lower(t), '\S+'), ['good', 'bad', 'ok', 'okay', 'great', 'nice', 'love', 'hate',
  'best', 'worst', 'fine', 'awesome', 'terrible', 'poor', 'excellent', 'amazing', 'horrible', 'perfect', 'trash', 'rubbish', 'garbage', 'wow', 'yes', 'no', 'meh', 'cool', 'lol', 'hmm'])) > 0 AS INTEGER) AS f_has_generic_word FROM w""",
)
def _(spark, d):
    rows = views.table(spark, d, "documents").select("doc_id", "text", (F.col("n_chars") % 4).alias("thumbs_up"))
    return quality.with_features(rows).select("doc_id", *[c for c in quality.FEATURES if c not in ("f_upper_ratio", "f_punct_ratio")])


@_query("f8_upper_and_other_shares")
def _(spark, d):
    rows = views.table(spark, d, "documents").select("doc_id", "text", (F.col("n_chars") % 4).alias("thumbs_up"))
    return quality.with_features(rows).select("doc_id", "f_upper_ratio", "f_punct_ratio")


_WEAK = r"""k AS (SELECT DISTINCT lang, lower(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS folded FROM (SELECT lang, text FROM documents GROUP BY lang, text HAVING count(*) > 1)),
weak AS (SELECT doc_id, d.lang, CAST(text IS NULL OR length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 10 OR k.folded IS NOT NULL OR NOT regexp_matches(text, '[a-zA-Z]') AS INTEGER) AS low_quality_label
  FROM documents d LEFT JOIN k ON d.lang = k.lang AND lower(regexp_replace(text, '^\s+|\s+$', '', 'g')) = k.folded)"""


def _weak(spark, d):
    return quality.weak_labels(views.table(spark, d, "documents").select("doc_id", F.col("lang").alias("app_name"), "text"))


@_query("v13_c2_j7_weak_labels", with_(_WEAK) + "SELECT doc_id, low_quality_label FROM weak")
def _(spark, d):
    return _weak(spark, d).select("doc_id", "low_quality_label")


@_query("a33_low_quality_share", with_(_WEAK) + "SELECT count(*) AS n, count(*) FILTER (WHERE low_quality_label = 1) AS n_low, CAST(count(*) FILTER (WHERE low_quality_label = 1) AS DOUBLE) / count(*) AS share_low FROM weak")
def _(spark, d):
    return quality.low_quality_share(_weak(spark, d))


@_query("a29_class_weights", with_(_WEAK) + ", c AS (SELECT low_quality_label, count(*) AS n_class FROM weak GROUP BY 1) SELECT low_quality_label, n_class, CAST(sum(n_class) OVER () AS DOUBLE) / (count(*) OVER () * n_class) AS weight FROM c")
def _(spark, d):
    return quality.class_weights(_weak(spark, d))


@_query(
    "a27_p13_p21_confusion",
    with_(_WEAK) + ", c AS (SELECT count(*) FILTER (WHERE y = 1 AND p = 1) AS tp, count(*) FILTER (WHERE y = 0 AND p = 1) AS fp, count(*) FILTER (WHERE y = 1 AND p = 0) AS fn, count(*) FILTER (WHERE y = 0 AND p = 0) AS tn FROM (SELECT CAST(l.quality = 0 AS INTEGER) AS y, low_quality_label AS p FROM weak JOIN labels l USING (doc_id))) "
    "SELECT *, CAST(tp AS DOUBLE) / nullif(tp + fp, 0) AS \"precision\", CAST(tp AS DOUBLE) / nullif(tp + fn, 0) AS recall, CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0) AS f1 FROM c",
)
def _(spark, d):
    rows = _weak(spark, d).join(views.table(spark, d, "labels").select("doc_id", (F.col("quality") == 0).cast("int").cast("string").alias("manual_label")), "doc_id", "left")
    return quality.confusion(quality.labelled_by_hand(rows), "manual_label", "low_quality_label")


_EXTRACT = rf"""x AS (SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '\S') THEN list_sort(list_distinct(list_filter(list_transform(list_intersect(regexp_extract_all(lower(text), '\S+'), [{_in(VOCABULARY)}]),
  lambda a: coalesce({_sql_map(FORMS)}[a], a)), lambda a: a NOT IN ({_in(EMPTY)})))) END AS aspects FROM documents)"""


def _extracted(spark, d):
    words = F.col("text")
    found = aspects.term_aspects(words, VOCABULARY)
    return views.table(spark, d, "documents").select("doc_id", F.when(F.coalesce(text_fns.py_strip(words) != "", F.lit(False)), aspects.canonical(found, FORMS, EMPTY)).alias("aspects"))


@_query("v6_u2_u3_j10_f24_f25_aspects", with_(_EXTRACT) + "SELECT doc_id, array_to_string(aspects, ',') AS aspects, CAST(coalesce(len(aspects), 0) AS INTEGER) AS n FROM x")
def _(spark, d):
    return _extracted(spark, d).select("doc_id", F.array_join("aspects", ",").alias("aspects"), F.greatest(F.coalesce(F.size("aspects"), F.lit(0)), F.lit(0)).alias("n"))


@_query("v8_v9_j10_mentions", "SELECT p_partkey, CASE w WHEN 'red' THEN 'rouge' WHEN 'blue' THEN 'bleu' ELSE w END AS aspect FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) WHERE w <> 'hot'")
def _(spark, d):
    rows = views.table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("aspects"))
    return aspects.mentions(rows, "aspects", PART_FORMS)


@_query("v10_f12_product_features", "SELECT p_partkey, p_name FROM part WHERE p_name NOT IN ('red plate', 'hot bolt') AND NOT (contains(p_name, 'cold') OR contains(p_name, 'ring'))")
def _(spark, d):
    return views.table(spark, d, "part").select("p_partkey", "p_name").where(aspects.is_feature(F.col("p_name"), ("red plate", "hot bolt"), ("cold", "ring")))


@_query("v7_f27_chunk_aspects", r"SELECT p_partkey, CASE WHEN length(p_name) >= 4 AND p_size % 3 < 2 THEN [p_name] ELSE [] END AS aspects FROM part")
def _(spark, d):
    chunk = F.struct(F.concat(F.lit("My "), F.col("p_name"), F.lit(" ")).alias("text"), F.element_at(F.array(F.lit("NOUN"), F.lit("PROPN"), F.lit("VERB")), (F.col("p_size") % 3 + 1).cast("int")).alias("head_pos"))
    return views.table(spark, d, "part").select("p_partkey", aspects.chunk_aspects(F.array(chunk)).alias("aspects"))


@_query("f13_f14_json", "SELECT event_id, props AS parsed, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def _(spark, d):
    return views.table(spark, d, "events").select("event_id", F.to_json(F.from_json("props", "k int")).alias("x"), F.col("props").alias("parsed"), F.get_json_object("props", "$.k").cast("int").alias("k")).drop("x")


_ARRAY_OF_EVENT = """CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '[]' WHEN 2 THEN concat('["', event_type, '"') ELSE concat('["', event_type, '", "', CAST(user_id AS {kind}), '"]') END"""


#: An object, an empty array, a malformed array and an array of two: parsed, and dumped again.
@_query("f13_f14_json_array", f"SELECT event_id, CASE WHEN ok THEN CAST(CAST(x AS JSON) AS VARCHAR[]) END AS parsed, CASE WHEN ok THEN CAST(to_json(CAST(CAST(x AS JSON) AS VARCHAR[])) AS VARCHAR) END AS dumped FROM (SELECT event_id, x, CASE WHEN json_valid(x) THEN json_type(x) = 'ARRAY' ELSE FALSE END AS ok FROM (SELECT event_id, {_ARRAY_OF_EVENT.format(kind='VARCHAR')} AS x FROM events))")
def _(spark, d):
    rows = views.table(spark, d, "events").select("event_id", text_fns.string_array(F.expr(_ARRAY_OF_EVENT.format(kind="STRING"))).alias("parsed"))
    return rows.withColumn("dumped", F.to_json("parsed"))


@_query("f15_fenced_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def _(spark, d):
    reply = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    return views.table(spark, d, "events").select("event_id", text_fns.fenced_json(reply, "k int")["k"].alias("k"))


@_query("f16_f20_dates", "SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE o_orderdate END AS parsed FROM orders")
def _(spark, d):
    shown = F.when(F.col("o_orderpriority").startswith("1"), F.lit("soon")).otherwise(F.col("o_orderdate").cast("string"))
    return views.table(spark, d, "orders").select("o_orderkey", F.try_to_timestamp(shown).cast("timestamp_ntz").alias("parsed"))


@_query("f19_recent", f"SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_shipdate > TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY")
def _(spark, d):
    return views.table(spark, d, "lineitem").where(F.col("l_shipdate") > F.expr(f"timestamp_ntz'{AS_OF}' - interval '30' day")).select("l_orderkey", "l_linenumber", "l_shipdate")


@_query("f22_f23_rounding", "SELECT p_partkey, round_even(p_retailprice / 8, 2) AS r2, round_even(p_retailprice / 16, 3) AS r3, abs(p_retailprice - 1000) AS a FROM part")
def _(spark, d):
    x = F.col("p_retailprice")
    return views.table(spark, d, "part").select("p_partkey", rounded(x / 8, 2).alias("r2"), rounded(x / 16, 3).alias("r3"), F.abs(x - 1000).alias("a"))


@_query("p19_a31_points_by_label", "SELECT coalesce(nullif(CAST(label AS VARCHAR), ''), 'unknown') AS label, count(*) AS n FROM embeddings WHERE label IS NOT NULL GROUP BY 1")
def _(spark, d):
    return vectors.points_by_label(views.table(spark, d, "embeddings").select(F.col("label").cast("string").alias("label")), "label")


@_query("t5_first_rows", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100")
def _(spark, d):
    return views.table(spark, d, "documents").select("doc_id", "lang").orderBy("doc_id").limit(100)


@_query("u1_union_all", "SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier")
def _(spark, d):
    return _customers(spark, d).select("name").unionByName(_suppliers(spark, d).select("name"))


@_query("w6_distinct_key", f"SELECT l_orderkey || '-' || l_linenumber AS review_id, min(l_shipdate) AS first_date FROM lineitem GROUP BY 1")
def _(spark, d):
    return ingest.first_of_batch(_batch(spark, d), ["review_id"]).select("review_id", F.col("date").alias("first_date"))


# ---- models: rows only


def _quality_model(spark, d):
    """Labels, features, a model of all rows and its predictions. Texts are read once, for a table of keys and numbers."""
    rows = views.table(spark, d, "documents").select(F.col("doc_id").alias("review_id"), F.col("lang").alias("app_name"), "text", (F.col("n_chars") % 4).alias("thumbs_up"))
    keyed = tables.written_once(quality.keyed(quality.with_features(rows)).drop("text", "thumbs_up"))
    featured = tables.written_once(quality.label_keyed(keyed).drop("app_name"))
    moments, model = quality.train(featured)
    return quality.predict(featured, moments, model)


@_query("v15_v18_t8_quality_scores")
def _(spark, d):
    return quality.worst_first(_quality_model(spark, d).select("review_id", "low_quality_label", "low_quality_pred", "quality_score"))


@_query("t7_u1_validation_sample")
def _(spark, d):
    return quality.validation_sample(_quality_model(spark, d).select("review_id", "low_quality_pred", "quality_score"), 100)


@_query("v19_v20_v21_text_vectors")
def _(spark, d):
    return vectors.reduced(vectors.text_vectors(views.table(spark, d, "benchmark"), "item_id"), "item_id", 20_000)


_TERMS = r"""d AS (SELECT item_id, list_filter(list_transform(regexp_extract_all(lower(text), '\S+'), lambda w: regexp_replace(w, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')), lambda w: length(w) >= 4) AS w FROM benchmark),
c AS (SELECT item_id, t, count(*) AS tf FROM (SELECT item_id, unnest(w) AS t FROM d) GROUP BY item_id, t),
k AS (SELECT t, count(*) AS df, sum(tf) AS every FROM c GROUP BY t HAVING count(*) >= 3),
v AS (SELECT t, ln((CAST(1 AS DOUBLE) + (SELECT count(*) FROM d)) / (CAST(1 AS DOUBLE) + df)) + 1 AS idf, row_number() OVER (ORDER BY every DESC, t) - 1 AS i FROM k QUALIFY i < 200),
w AS (SELECT item_id, i, (CAST(1 AS DOUBLE) + ln(tf)) * idf AS w FROM c JOIN v USING (t))"""


def _term_weights(spark, d, vocabulary):
    rows = views.table(spark, d, "benchmark").select("item_id", vectors.topic_words(F.col("text"), stop_words=(), brands=(), shortest=4).alias("w"))
    out = vectors.weights(rows, "item_id", "w", 3, vocabulary)
    return out.select("item_id", F.explode(F.arrays_zip("indices", "values")).alias("x")).select("item_id", F.col("x.indices").alias("i"), F.round("x.values", 9).alias("w"))


@_query("v19_f4_term_weights", with_(_TERMS) + "SELECT item_id, CAST(i AS INTEGER) AS i, round(w / sqrt(sum(w * w) OVER (PARTITION BY item_id)), 9) AS w FROM w")
def _(spark, d):
    return _term_weights(spark, d, 200)


#: With the vocabulary of text_vectors.
@_query("v19_f4_term_weights_15000", with_(_TERMS.replace("i < 200", "i < 15000")) + "SELECT item_id, CAST(i AS INTEGER) AS i, round(w / sqrt(sum(w * w) OVER (PARTITION BY item_id)), 9) AS w FROM w")
def _(spark, d):
    return _term_weights(spark, d, 15_000)


@_query("v23_s16_coordinates")
def _(spark, d):
    return vectors.coordinates(views.table(spark, d, "embeddings")).select("vec_id", "label", "x", "y")


def _hits_sql(text: str, place: int) -> str:
    """Values of a text's words that are in the lexicon, as a list."""
    known = "MAP {" + ", ".join(f"'{row[0]}': CAST({row[place]} AS DOUBLE)" for row in lexicons.SENTIMENT) + "}"
    words = rf"list_transform(regexp_extract_all(lower({text}), '\S+'), lambda w: regexp_replace(w, '[^\p{{L}}]', '', 'g'))"
    return f"list_filter(list_transform({words}, lambda w: {known}[w]), lambda v: v IS NOT NULL)"


_MEAN = "round(coalesce(list_sum({0}) / nullif(len({0}), 0), 0) / {1}, 9)"


@_query(
    "v28_v29_lexicon_scores",
    f"WITH h AS (SELECT doc_id, text, coalesce(list_sum({_hits_sql('substr(text, 1, 150)', 1)}), 0) AS s, {_hits_sql('text', 1)} AS v, {_hits_sql('text', 2)} AS u FROM documents)"
    f" SELECT doc_id, CASE WHEN text IS NOT NULL THEN round(s / sqrt(s * s + 15), 9) END AS compound, {_MEAN.format('u', 'CAST(1 AS DOUBLE)')} AS subjectivity, {_MEAN.format('v', 'CAST(4 AS DOUBLE)')} AS polarity FROM h",
)
def _(spark, d):
    t = F.col("text")
    scores = {"compound": scorers.compound(t), "subjectivity": scorers.subjectivity(t), "polarity": scorers.polarity(t)}
    return views.table(spark, d, "documents").select("doc_id", *[F.round(x, 9).alias(name) for name, x in scores.items()])


@_query("v22_v30_x6_model_labels", r"SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '\S') THEN 'positive' END AS label, CASE WHEN regexp_matches(coalesce(text, ''), '\S') THEN CAST(0.9 AS DOUBLE) END AS confidence FROM documents")
def _(spark, d):
    rows = views.table(spark, d, "documents").select("doc_id", "text")
    return scorers.with_model(rows, scorers.constant_model(label="positive", confidence=0.9), "label string, confidence double").drop("text")
