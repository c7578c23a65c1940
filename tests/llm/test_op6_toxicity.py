"""Compression distance: held-out accuracy, calibration, edge rows."""

import numpy as np
import pyarrow.parquet as pq

from gristmill.llm import op6_toxicity as op

LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.1")
    got = {r.doc_id: r for r in op.query(spark, sf).collect()}
    labels = [r for r in pq.read_table(f"{sf}/labels.parquet").to_pylist() if got[r["doc_id"]].held_out and r["toxic"] is not None]
    y = np.array([r["toxic"] for r in labels])
    p = np.array([got[r["doc_id"]].predicted for r in labels])
    s = np.array([got[r["doc_id"]].score for r in labels])
    tp = ((p == 1) & (y == 1)).sum()
    # 210 toxic texts to learn from; with 1,000 and more recall is above 0.9 (README)
    assert tp / max(1, (y == 1).sum()) > 0.4 and tp / max(1, (p == 1).sum()) > 0.7 and ((s >= 0) & (s <= 1)).all()


def test_scores_by_brute_force(spark, sf_dir):
    """Windows, lengths and the logistic score again, text by text, with compressors of the test's own."""
    import zstandard

    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    model = op.fit(docs, labels)
    full = model.ordinary[:4] == (0xEC30A437).to_bytes(4, "little")
    assert full and model.toxic.startswith(model.ordinary) and len(model.ordinary) < len(model.toxic) <= len(model.ordinary) + op.TOXIC_BYTES

    def length(dictionary, window):
        d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_FULLDICT)
        p = zstandard.ZstdCompressionParameters(compression_level=3, strategy=zstandard.STRATEGY_GREEDY, min_match=5, hash_log=16, chain_log=16, search_log=4, window_log=18, write_content_size=False, write_checksum=False, write_dict_id=False)
        return len(zstandard.ZstdCompressor(compression_params=p, dict_data=d).compress(window))

    rows = docs.where("length(text) < 600").select("doc_id", "text", op.score(model, "text").alias("s")).orderBy("doc_id").limit(25).collect()
    for r in rows:
        letters = "".join(c.lower() if c.isascii() and c.isalpha() else c if not c.isascii() else " " for c in r.text).split()
        saved = []
        for i in range(0, len(letters), 5):
            window = (" " + " ".join(letters[i : i + 5]) + " 0123456789 ").encode()
            saved.append(length(model.ordinary, window) - length(model.toxic, window))
        x = sum(w * m for w, m in zip(model.weights, op.measures(np.array(saved, np.int64)), strict=True))
        assert abs(r.s - 1 / (1 + np.exp(-x))) < 1e-9


def test_the_sample_is_bounded_in_bytes_and_takes_long_texts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(op, "train", lambda texts, y, sizes: seen.append([len(t) for t in texts]))
    rows = [(i, "ab " * (40_000 if i % 10 == 0 else 10)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(200)], LABELS)
    op.fit(docs, labels, fit_bytes=400_000)
    assert sum(seen[0]) <= 400_000 and max(seen[0]) == 120_000 and len(seen[0]) > 100


def test_query_with_clashing_columns_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "the river", 1.0, "x", True), (1, "the river", 2.0, "y", False)], "doc_id long, text string, score double, y string, held_out boolean")
    model = op.train([b"you idiot get lost"] * 20 + [b"a quiet river runs"] * 20, np.array([1] * 20 + [0] * 20))
    got = [r.s for r in df.select("doc_id", op.score(model, "text").alias("s")).collect()]
    assert len(got) == 2 and got[0] == got[1]


def test_edges(spark):
    bad, good = "you stupid awful idiot get lost forever ", "the quiet river runs along green meadows today "
    rows = [(i, (bad if i % 4 == 0 else good) * (2 + i % 3), 0.5, "w") for i in range(120)] + [(200, None, None, None), (201, "", None, None), (None, bad * 3, None, None), (202, bad + good * 40_000, None, None), (203, "#### 123", None, None), (204, good * 40_000, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double, y string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(120)] + [(None, 1, 1), (3, None, None)], LABELS)
    model = op.fit(df, labels)
    got = {r.doc_id: r.s for r in df.select("doc_id", op.score(model, "text").alias("s")).collect()}
    assert all((got[i] > 0.5) == (i % 4 == 0) for i in range(120)) and got[None] > 0.5
    assert got[200] == got[201] == got[203] and got[201] < 0.3
    assert 0 <= got[202] <= 1 and got[204] < 0.5
    none = op.fit(df, spark.createDataFrame([], LABELS))
    assert {r[0] for r in df.select(op.score(none, "text")).collect()} == {0.0}
    one = op.fit(df, spark.createDataFrame([(i, 1, 1) for i in range(10)], LABELS))
    assert {round(r[0], 6) for r in df.select(op.score(one, "text")).collect()} == {round(one.rate, 6)} and one.rate > 0.8
    assert df.limit(0).select(op.score(model, "text")).count() == 0


def test_windows_cover_the_whole_text():
    text = b"One two, three four five!  six\nSEVEN"
    joined = b" ".join(w.removesuffix(op.TAIL).strip() for w in op.windows(text))
    assert joined == b"one two three four five six seven" and op.windows(None) == []
