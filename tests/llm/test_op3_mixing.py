"""The mix against SQL, its budgets, and edge rows."""

import re
from collections import defaultdict

import pyarrow.parquet as pq
from compare import assert_same, connect
from pyspark.sql import functions as F

from gristmill.llm import op3_mixing as op

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def size(text):
    return len(WORD.findall(text or ""))


def test_query_equals_sql(spark, sf_dir):
    assert_same(op.query(spark, sf_dir), connect(sf_dir), op.ORACLE)


def test_budgets_on_driver_tables(spark, sf_dir):
    docs = {r["doc_id"]: r for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()}
    rows = op.query(spark, sf_dir).collect()
    taken, target = defaultdict(int), {}
    for r in rows:
        assert r["size"] == size(docs[r.doc_id]["text"]) and 0 <= r.taken <= 3 * r["size"]
        taken[docs[r.doc_id]["source"]] += r.taken
        target[docs[r.doc_id]["source"]] = (r.target, r.source_size)
    assert all(taken[s] == round(t) and t <= 3 * n + 1e-6 for s, (t, n) in target.items())
    assert abs(sum(t for t, _ in target.values()) - sum(r["size"] for r in rows)) < 1e-6 * len(rows)


def naive_targets(sizes, weights=(5, 2, 1), most=3):
    """Share by weight, cap, and share the excess again until nothing is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > most * sizes[s]}
        if not over:
            out |= {s: left * w[s] / total for s in free}
            break
        for s in over:
            out[s] = float(most * sizes[s])
        left -= sum(out[s] for s in over)
        free -= over
    return out


def rows_of(counts):
    k, out = 0, []
    for source, n in counts.items():
        for i in range(n):
            out.append((k, "w " * (i % 5 + 1), "en", source, 0))
            k += 1
    return out


def test_targets_follow_the_naive_rule(spark):
    for counts in ({"a": 1, "b": 50, "c": 3, None: 2}, {"A": 5, "a": 5, "é": 9, "z": 1, "b": 100}, {"x": 4}):
        rows = rows_of(counts)
        got = {r.source: r.target for r in op.mix_sizes(spark.createDataFrame(rows, SCHEMA).select("doc_id", "source", op.word_count(F.col("text")).alias("size")), range_rows=7).collect()}
        sizes = defaultdict(int)
        for r in rows:
            sizes[r[3]] += size(r[1])
        want = naive_targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_ranges_do_not_change_the_plan(spark):
    df = spark.createDataFrame(rows_of({"a": 40, "b": 200, None: 30}), SCHEMA)
    plans = [sorted(map(tuple, op.mix_plan(df, range_rows=k).collect())) for k in (5, 64, 10_000)]
    assert plans[0] == plans[1] == plans[2]


def test_edges(spark):
    rows = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \x0b\x0c ", "en", None, 4), (None, "two words", "en", "b", 9), (4, "x\x85y z", None, "b", 5), (4, "x\x85y z", None, "b", 5), (5, "w " * 100_000, "en", "b", 0)]
    df = spark.createDataFrame([(*r, 7, 1.0) for r in rows], SCHEMA + ", size long, target double")
    got = op.mix_plan(df).collect()
    assert len(got) == len(rows) and sorted(r["size"] for r in got) == [0, 0, 0, 2, 2, 2, 100_000]
    assert sum(r.taken for r in got) == 100_006 and all(r.taken == 0 for r in got if r["size"] == 0)
    assert op.mix_plan(df.limit(0)).collect() == []
    only_empty = op.mix_plan(df.where("doc_id <= 3")).collect()
    assert [r.taken for r in only_empty] == [0, 0, 0]


def test_mixed_documents_have_the_words_of_the_plan(spark):
    texts = [" lead  and\ttabs\n", "one", "a b c d e f g", "  ", "é ß\n\n中 文 x"]
    rows = [(i, texts[i % 5], "en", "abc"[i % 3], len(texts[i % 5])) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    plan = {r.doc_id: r for r in op.mix_plan(df).collect()}
    out = op.mix_documents(df)
    assert out.columns == df.columns
    words = defaultdict(int)
    for r in out.collect():
        words[r.doc_id] += size(r.text)
        assert texts[r.doc_id % 5].startswith(r.text) and r.n_chars == len(r.text)
    assert {k: r.taken for k, r in plan.items() if r.taken} == dict(words)
    assert op.mix_documents(df.limit(0)).count() == 0


def test_repeated_and_null_ids_keep_the_budgets(spark):
    rows = [(None, "w " * (i % 4 + 1) + str(i), "en", "abc"[i % 3], 0) for i in range(60)] + [(7, "x " * (i % 3 + 2) + str(i % 5), "en", "ab"[i % 2], 0) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    taken, words = defaultdict(int), defaultdict(int)
    for r in op.mix_sizes(df.select("doc_id", "source", op.word_count(F.col("text")).alias("size"))).collect():
        taken[r.source] = round(r.target)
    for r in op.mix_documents(df).collect():
        words[r.source] += size(r.text)
    assert dict(words) == dict(taken)
