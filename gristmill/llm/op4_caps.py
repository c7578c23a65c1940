"""Embedding near-dedup by spherical-cap filters: a structured random product code gives filter directions; each vector
is list-decoded to all directions that it exceeds a threshold on; vectors meet on filters and are verified.

Filters: under a random rotation the dimensions are cut into BLOCKS with a random code each, a direction takes one word
of each block. Decoding walks the blocks, words in descending order, and stops where the best rest can't reach the
threshold, so its work follows the number of directions found. The threshold is set so that a vector has FILTERS
filters on average, and the code so that a filter holds about BUCKET_ROWS vectors of one label; both follow from the
number of distinct vectors. Two blocks and many codes: with four small blocks and few codes the number of filters varies
so much between vectors that 6 to 13 percent of the pairs at a cosine of 0.93 share none (in 64 dimensions); so it is
0.03 percent for 65,000 vectors of a label and 0.3 percent for 1 to 16 million, less for closer pairs (tests measure it).

Scale: equal vectors become one with a multiplicity before anything else. A filter with more than CELL_ROWS vectors is
cut into blocks that meet pairwise, so that a task's matrix has a bound. Cells return how many links each vector has
and a forest of links, never pairs: a pair is counted in the least filter that both share. Counting the links of each
of n near copies takes n^2 / 2 products of vectors by the nature of the result; they run as matrix products, in cells.

Volume: each of about 32 filters of a vector gets the vector and its list of filters, some 50 times the input, in
proportion to it.

Defined results: labels may be of any simple type and are compared as they are; a null label, and vectors that are null, empty, zero or hold null or non-finite components, link with
nothing; vectors of different length don't link; repeated rows link with each other; a null vec_id has a null component
and kept is false; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm._common import materialize
from gristmill.llm._components import connected_components
from gristmill.llm._forest import Forest

COSINE = 0.93
FILTERS = 32.0
CODES = 32
BUCKET_ROWS = 48
CELL_ROWS = 2_048
BLOCKS = 2
SEED = 11


def cap_height(dims: int, share: float) -> float:
    """The a with P(<u, c> >= a) = share for a random direction u."""
    if dims < 2 or share >= 0.5:
        return 0.0
    x = (np.arange(400_000) + 0.5) / 400_000
    tail = np.cumsum(((1 - x * x) ** ((dims - 3) / 2))[::-1])[::-1]
    tail = tail / tail[0] / 2
    return float(x[max(0, int(np.searchsorted(-tail, -share)) - 1)])


class ProductCode:
    """CODES independent sets of filter directions for vectors of `dims` dimensions, each under a rotation of its own; `n` is
    how many distinct vectors a label has at most."""

    def __init__(self, dims: int, n: int, filters: float = FILTERS, bucket_rows: int = BUCKET_ROWS, codes: int = CODES, seed: int = SEED):
        m = max(1, min(BLOCKS, dims // 2))
        self.words = words = max(8, int(np.ceil((n * filters / codes / bucket_rows) ** (1 / m))))
        self.cuts, self.height = np.linspace(0, dims, m + 1).astype(int), cap_height(dims, filters / codes / words**m)
        self.codes = []
        for k in range(codes):
            rng = np.random.default_rng([seed, dims, words, k])
            turn = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
            blocks = [rng.standard_normal((words, hi - lo)) for lo, hi in zip(self.cuts[:-1], self.cuts[1:], strict=True)]
            self.codes.append((turn, [c / np.linalg.norm(c, axis=1, keepdims=True) / np.sqrt(m) for c in blocks]))

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all directions that a row of unit vectors exceeds the threshold on, in order."""
        rows, filters = zip(*(self._decode(x @ turn, blocks) for turn, blocks in self.codes), strict=True)
        size = self.words ** (len(self.cuts) - 1)
        row, f = np.concatenate(rows), np.concatenate([f + k * size for k, f in enumerate(filters)])
        order = np.argsort(row, kind="stable")
        return row[order], f[order]

    def _decode(self, x: np.ndarray, blocks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        dots = [x[:, lo:hi] @ c.T for lo, hi, c in zip(self.cuts[:-1], self.cuts[1:], blocks, strict=True)]
        rest = [np.zeros(len(x))]
        for d in reversed(dots[1:]):
            rest.append(rest[-1] + d.max(axis=1))
        rest.reverse()
        row, word, total = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
        for d, r in zip(dots, rest, strict=True):
            order = np.argsort(-d, axis=1, kind="stable")
            falling = np.take_along_axis(d, order, axis=1)
            need = self.height - r[row] - total  # of each partial word, from this block
            # the rows' falling values one after another, set apart by more than their spread: one search serves all
            flat = (4.0 * np.arange(len(x))[:, None] - falling).ravel()
            n = np.searchsorted(flat, 4.0 * row - need, side="right") - row * self.words
            n = np.clip(n, 0, self.words)
            place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            row, word, total = np.repeat(row, n), np.repeat(word, n), np.repeat(total, n)
            total = total + falling[row, place]
            word = word * self.words + order[row, place]
        return row, word


@lru_cache(maxsize=16)
def _code(dims: int, n: int, filters: float, bucket_rows: int) -> ProductCode:
    return ProductCode(dims, n, filters, bucket_rows)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _lists(col) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of an Arrow list column without nulls."""
    o = col.offsets.to_numpy()
    return o - o[0], col.values.to_numpy(zero_copy_only=False)[o[0] : o[-1]]


def filters_of(embedding: Column | str, n: int, filters: float = FILTERS, bucket_rows: int = BUCKET_ROWS) -> Column:
    """The filters of each (valid) vector, in order; 32-bit numbers while there are few enough directions."""
    short = 4 * max(n * filters / bucket_rows, 64 * CODES) < 1 << 31

    @F.arrow_udf(T.ArrayType(T.IntegerType() if short else T.LongType()))
    def go(embedding: pa.Array) -> pa.Array:
        off, values = _lists(embedding)
        sizes, out = np.diff(off), [None] * len(embedding)
        for dims in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == dims)
            code = _code(dims, n, filters, bucket_rows)
            step = max(1, min(1024, (1 << 20) // code.words))  # bounds the matrix of products with the words
            for lo in range(0, len(at), step):
                part = at[lo : lo + step]
                row, f = code.decode(unit(values[off[part][:, None] + np.arange(dims)]))
                for i, own in zip(part.tolist(), np.split(f, np.searchsorted(row, np.arange(1, len(part)))), strict=True):
                    out[i] = own
        return pa.array(out, pa.list_(pa.int32() if short else pa.int64()))

    return go(embedding)


def shared_before(lists: list[np.ndarray], limit: int) -> np.ndarray:
    """Which two lists share a filter below `limit`; a matrix of the lists."""
    k = len(lists)
    row = np.repeat(np.arange(k), [len(x) for x in lists])
    flat = np.concatenate(lists) if k else np.zeros(0, np.int64)
    row, flat = row[flat < limit], flat[flat < limit]
    _, col, n = np.unique(flat, return_inverse=True, return_counts=True)
    on = n[col] > 1
    names, col = np.unique(col[on], return_inverse=True)
    row, out = row[on], np.zeros((k, k), bool)
    for lo in range(0, len(names), 1024):
        own = (col >= lo) & (col < lo + 1024)
        inc = np.zeros((k, min(1024, len(names) - lo)), np.float32)
        inc[row[own], col[own] - lo] = 1
        out |= inc @ inc.T > 0
    return out


def _cell(f: int, across: bool, block: np.ndarray, rid: np.ndarray, mult: np.ndarray, x: np.ndarray, lists: list[np.ndarray], cosine: float):
    """Links of one cell: (rid, links) and a forest of (rid, rid)."""
    hit = np.triu(x @ x.T >= cosine, 1)
    if across:
        hit &= block[:, None] != block[None, :]
    i, j = np.nonzero(hit)
    if not len(i):
        return None
    rows, back = np.unique(np.concatenate((i, j)), return_inverse=True)
    a, b = back[: len(i)], back[len(i) :]
    first = ~shared_before([lists[r] for r in rows], f)[a, b]
    a, b = a[first], b[first]
    if not len(a):
        return None
    links = np.bincount(a, mult[rows[b]], len(rows)) + np.bincount(b, mult[rows[a]], len(rows))
    u, v = Forest(len(rows)).link(a, b)
    own = np.flatnonzero(links)
    return (rid[rows[own]], links[own].astype(np.int64)), (rid[rows[u]], rid[rows[v]])


def _cells(cosine: float):
    """A mapInArrow function over rows sorted by cell: (kind, a, b) with kind 0 links of a, kind 1 a link of two."""

    def go(batches):
        parts, key = [], None

        def flush():
            if sum(len(p[1]) for p in parts) < 2:
                return
            f, across = int(key[2]), key[3] != key[4]
            block, rid, mult, off_values, lists = zip(*parts, strict=True)
            x = unit(np.concatenate(off_values))
            found = _cell(f, across, np.concatenate(block), np.concatenate(rid), np.concatenate(mult), x, [y for p in lists for y in p], cosine)
            for kind, pair in enumerate(found or ()):
                if len(pair[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair[0]), kind, np.int32)), pa.array(pair[0]), pa.array(pair[1])], names=["kind", "a", "b"])

        for batch in batches:
            names = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            block, rid, mult = (batch.column(i).to_numpy() for i in (5, 6, 7))
            off, values = _lists(batch.column(8))
            f_off, f_values = _lists(batch.column(9))
            change = np.zeros(max(len(rid) - 1, 0), bool)
            for c in names:
                change |= c[1:] != c[:-1]
            cuts = np.flatnonzero(change) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rid)], strict=True):
                if lo == hi:
                    continue
                now = tuple(c[lo] for c in names)
                if now != key:
                    yield from flush()
                    parts, key = [], now
                parts.append((block[lo:hi], rid[lo:hi], mult[lo:hi], values[off[lo] : off[hi]].reshape(hi - lo, -1), [f_values[f_off[k] : f_off[k + 1]] for k in range(lo, hi)]))
        if parts:
            yield from flush()

    return go


def _valid(e: str = "embedding"):
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(F.forall(e, finite) & F.exists(e, lambda x: x != 0) & F.col("label").isNotNull(), F.lit(False))


def near_vectors(vectors: DataFrame, cosine: float = COSINE, filters: float = FILTERS, bucket_rows: int = BUCKET_ROWS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding, label)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    good = rows.where(_valid()).where("vec_id is not null")
    reps = materialize(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("rid"), F.count(F.lit(1)).alias("mult")), "vectors")
    n = reps.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    n = 1 << (n - 1).bit_length()
    reps_f = materialize(reps.withColumn("filters", filters_of("embedding", n, filters, bucket_rows)), "caps")
    met = reps_f.select("label", F.size("embedding").alias("dims"), F.explode("filters").alias("f"), "rid", "mult", "embedding", "filters")
    full = met.groupBy("label", "dims", "f").count().where(F.col("count") > cell_rows).select("label", "dims", "f", F.ceil(F.col("count") / cell_rows).cast("int").alias("nb"))
    met = met.join(full, ["label", "dims", "f"], "left").withColumn("nb", F.coalesce("nb", F.lit(1)))
    met = met.withColumn("block", F.pmod(F.xxhash64("rid"), F.col("nb")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    kind = dict(rows.dtypes)["label"]
    # the label itself is the key: whole numbers as such, others as text (+ 0.0: a negative zero is zero)
    lab = F.col("label").cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else (F.col("label") + 0.0 if kind in ("float", "double") else F.col("label")).cast("string")
    cells = met.select(lab.alias("lab"), "dims", "f", F.least("block", "other").alias("ci"), F.greatest("block", "other").alias("cj"), "block", "rid", "mult", "embedding", "filters")
    key = ["lab", "dims", "f", "ci", "cj"]
    found = materialize(cells.repartition(*key).sortWithinPartitions(*key).mapInArrow(_cells(cosine), "kind int, a long, b long"), "links")
    links = found.where("kind = 0").groupBy(F.col("a").alias("l_rid")).agg(F.sum("b").alias("links"))
    comps = connected_components(found.where("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v")))
    classes = reps.join(links, F.col("rid") == F.col("l_rid"), "left").join(comps, F.col("rid") == F.col("node"), "left")
    classes = classes.select("label", "embedding", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rid").alias("component_id"))
    linked = good.join(classes, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~_valid() | F.col("vec_id").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
