"""Statistics against plain loops, the learned list against numpy, held-out accuracy, edge rows."""

import re

import numpy as np
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gristmill.llm import op8_rules as op
from gristmill.llm._textstats import FIELDS, stats_matrix, text_stats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else {w for w, n in __import__("collections").Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def base(text):
    return dict(zip(FIELDS, text_stats(text.encode() if text is not None else None), strict=True))


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.none(), st.text(alphabet="ab \n\t\x0b\x1c\x85é#|", max_size=80)))
def test_statistics(text):
    s = base(text)
    assert tuple(s[k] for k in op.BASE) == slow(text)


def test_repeats_of_long_texts():
    for t in ("a b c d e f " * 500, "x " * 9, " ".join(map(str, range(400))) + " 5 6 7 8 9 10", "one\n\none\n one\n", "a a a a a a"):
        assert tuple(base(t)[k] for k in op.BASE) == slow(t)


def test_query_columns(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()}
    got = op.query(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        s = slow(docs[r.doc_id])
        assert tuple(r[k] for k in op.BASE) == s
        assert r.base_failed == (s[0] < 10 or 100 * s[4] > 20 * s[0]) and not (r.base_failed and r.kept)


def test_held_out_accuracy(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.1")
    rows = {r.doc_id: r for r in op.query(spark, sf).where("crc32(cast(doc_id as string)) % 4 = 2").collect()}
    labels = [r for r in pq.read_table(f"{sf}/labels.parquet").to_pylist() if r["doc_id"] in rows]
    right = [rows[r["doc_id"]].kept == (r["quality"] == 1) for r in labels]
    good = [rows[r["doc_id"]].kept for r in labels if r["quality"] == 1]
    assert np.mean(right) > 0.9 and np.mean(good) > 0.95


def test_expression_equals_numpy(spark):
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["word", "W!", "|", "<b>", "12", "x."], rng.integers(0, 40))) for _ in range(300)]
    m = stats_matrix([t.encode() for t in texts])
    rows = {k: m[:, i] for i, k in enumerate(FIELDS)}
    bad = (rows["n_symbols"] > 0.4 * rows["n_words"]) | (rows["n_digits"] > 0.12 * rows["word_chars"])
    rules = op.learn_rules(rows, bad)
    assert rules and all(len(r) <= 4 for r in rules)
    x, first = op.ratios(rows), np.full(300, -1)
    for i, rule in enumerate(rules):
        first[(first < 0) & op._covered(rule, x, 300)] = i
    assert np.mean((first >= 0) == bad) > 0.9
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: -1 if r.rule is None else r.rule for r in op.verdicts(df, rules).collect()}
    assert [got[i] for i in range(300)] == first.tolist()


def test_edges(spark):
    good = "this is a fine sentence of several different plain words number {}"
    rows = [(i, good.format(i) if i % 2 else "| # | # " * 9 + str(i), "x", 1) for i in range(60)] + [(100, None, "x", 1), (101, "", "x", 1), (None, good, "x", 1), (102, "w%d " % 1 * 100_000, "x", 1), (1, good.format(1), "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, s string, kept int")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 0, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    kept = op.keep_good(df, labels)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert {i for i in ids if i is not None} == {i for i in range(60) if i % 2} and ids.count(1) == 2 and None in ids
    assert op.fit_rules(df, labels.limit(0)) == [] and op.fit_rules(df, labels.where("quality = 1")) == []
    assert op.keep_good(df.limit(0), labels).count() == 0
    assert df.select(F.lit(1).alias("doc_id"), "text").transform(lambda d: op.verdicts(d, [])).where("base_failed").count() > 0


def test_verdicts_of_repeated_rows_and_clashing_columns(spark):
    text = "one two three four five six seven eight nine ten eleven"
    df = spark.createDataFrame([(1, text, 5, "x", True), (1, text, 6, "y", False), (2, None, 7, "z", None)], "doc_id long, text string, n_words int, s string, kept boolean")
    got = sorted(tuple(r) for r in op.verdicts(df, []).drop("rule").collect())
    assert len(got) == 3 and got[0] == got[1] and got[0][1] == 11 and got[0][-1] is True and got[2][1] == 0 and got[2][-1] is False
    assert op.verdicts(df.limit(0), []).count() == 0
