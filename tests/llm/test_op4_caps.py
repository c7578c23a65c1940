"""Cap filters against all cosines; recall; edge rows."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from gristmill.llm import op4_caps as op


def brute(rows):
    """(vec_id, embedding, label) to links and components by all pairs of a label."""
    ids = [r[0] for r in rows]
    ok = [i for i, (_, e, lab) in enumerate(rows) if lab is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    links, up = {i: 0 for i in range(len(rows))}, list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(ok)):
        for b in range(a + 1, len(ok)):
            i, j = ok[a], ok[b]
            x, y = (np.array(rows[k][1], np.float64) for k in (i, j))
            if rows[i][2] == rows[j][2] and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= op.COSINE:
                links[i] += 1
                links[j] += 1
                up[root(i)] = root(j)
    least = {}
    for i in range(len(rows)):
        least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return {ids[i]: (links[i], least[root(i)], ids[i] == least[root(i)]) for i in range(len(rows))}


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in op.near_vectors(df, **kw).collect()}


def f32(rows):
    return [(i, None if e is None else [None if x is None else float(np.float32(x)) for x in e], lab) for i, e, lab in rows]


def test_driver_table(spark, sf_dir):
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in op.query(spark, sf_dir).collect()}
    t = pq.read_table(f"{sf_dir}/embeddings.parquet").to_pylist()
    want = brute([(r["vec_id"], r["embedding"], r["label"]) for r in t])
    found, all_ = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
    assert found <= all_ and found >= 0.98 * all_
    assert all(got[k][0] <= want[k][0] for k in want)


@pytest.mark.parametrize("cell_rows", [2_048, 16])
def test_near_copies(spark, cell_rows):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(30, 64))
    rows, k = [], 0
    for c, x in enumerate(base):
        for _ in range(12):
            y = x + rng.normal(size=64) * rng.choice([0, 0.1, 0.3, 0.39])
            rows.append((k, y.tolist(), c % 3))
            k += 1
    rows = f32(rows)
    got, want = run(spark, rows, cell_rows=cell_rows), brute(rows)
    found, all_ = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
    assert 0.98 * all_ <= found <= all_
    assert np.mean([got[k][1] == want[k][1] for k in want]) > 0.98


def test_edges(spark):
    e = [1.0, 2.0, 3.0, 4.0]
    rows = [(1, e, 1), (2, [2.0, 4.0, 6.0, 8.0], 1), (3, e, 2), (4, e, None), (5, None, 1), (6, [0.0] * 4, 1), (7, [1.0, None, 1.0, 1.0], 1), (8, [float("nan"), 1.0, 1.0, 1.0], 1), (9, [float("inf"), 1.0, 1.0, 1.0], 1), (10, [], 1), (11, e, 1), (11, e, 1), (12, [1.0, 2.0, 3.0], 1), (13, [-x for x in e], 1), (None, e, 1)]
    got = run(spark, rows)
    assert got[1] == (3, 1, True) and got[2] == (3, 1, False) and got[11] == (3, 1, False) and got[3] == (0, 3, True)
    assert all(got[k] == (0, k, True) for k in (4, 5, 6, 7, 8, 9, 10, 12, 13)) and got[None][1] is None and got[None][2] is False
    assert run(spark, []) == {}
    df = spark.createDataFrame([(1, e, 1, "x", 2)], "vec_id long, embedding array<float>, label int, rid string, mult int")
    assert op.near_vectors(df).count() == 1


@pytest.mark.parametrize(("kind", "labels"), [("string", ["a", "b", ""]), ("double", [0.0, -0.0, float("nan")]), ("boolean", [True, False, None])])
def test_labels_of_other_types_and_repeated_ids(spark, kind, labels):
    e = [1.0, 2.0, 3.0, 4.0]
    rows = [(i % 4, e, labels[i % 3]) for i in range(12)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<float>, label {kind}")
    got = op.near_vectors(df).collect()
    same = lambda a, b: a is not None and b is not None and (a == b or (a != a and b != b))
    want = sorted((i, sum(same(x, y) for _, _, y in rows) - 1 if x is not None else 0) for i, _, x in rows)
    assert sorted((r.vec_id, r.n_links) for r in got) == want


def test_tiny_and_huge_components(spark):
    rows = f32([(1, [1e-30, 2e-30, 3e-30], 1), (2, [1e30, 2e30, 3e30], 1), (3, [1.0, 2.0, 3.5], 1)])
    got = run(spark, rows)
    assert {got[k][1] for k in (1, 2, 3)} == {1} and got[1][0] == 2


@pytest.mark.parametrize("n", [1_024, 65_536, 1 << 20])
def test_pairs_at_the_limit_share_a_filter(n):
    """2,000 pairs in 64 dimensions with a cosine of just 0.93: those that meet in no filter."""
    code, rng = op.ProductCode(64, n), np.random.default_rng(8)
    x = op.unit(rng.normal(size=(2_000, 64)))
    z = rng.normal(size=x.shape)
    z = op.unit(z - (z * x).sum(axis=1, keepdims=True) * x)
    y = op.COSINE * x + np.sqrt(1 - op.COSINE**2) * z
    own = [[set(part.tolist()) for part in np.split(f, np.searchsorted(row, np.arange(1, 2_000)))] for row, f in (code.decode(v) for v in (x, y))]
    assert np.mean([not (a & b) for a, b in zip(*own, strict=True)]) < 0.003
    assert 0.6 * op.FILTERS < np.mean([len(a) for a in own[0]]) < 1.6 * op.FILTERS


def test_decode_finds_exactly_the_directions_above_the_height():
    code = op.ProductCode(8, 4_000, codes=1)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(20, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    row, f = code.decode(x)
    turn, blocks = code.codes[0]
    m, w = len(blocks), code.words
    for i in range(20):
        dots = [(x[i] @ turn)[lo:hi] @ c.T for lo, hi, c in zip(code.cuts[:-1], code.cuts[1:], blocks, strict=True)]
        total = dots[0]
        for d in dots[1:]:
            total = (total[:, None] + d[None, :]).ravel()
        assert set(f[row == i].tolist()) == set(np.flatnonzero(total >= code.height).tolist()) and len(total) == w**m
