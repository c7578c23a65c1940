"""SimHash near-dedup over a Gray-order hierarchical index.

Fingerprints are sorted by Gray rank, so that neighbours share most bits. Groups of neighbours factor the bits that
all members share (a mask and a pattern) into nodes, these into upper nodes, and each node keeps only the bits that
its parent hasn't. A search goes down with the differences so far and drops a whole group once they exceed the limit.

Scale: only distinct fingerprints are compared. The uppermost nodes (prefixes of the fingerprint; a prefix that holds
too many is split further, whatever its depth) deal the work over tasks: a fingerprint is a member of one leaf and a
visitor of each later leaf whose pattern it meets within the limit, at most C(64, <=2) and for a prefix of p bits
C(p, <=2) / 2 of them, so the work grows with the number of fingerprints even where a third of them lie in one small
ball. Tasks hold the members of one leaf, stream visitors past them and give a forest of links, not all pairs;
components follow from it. Counts of prefixes come to the driver (some 16 for each leaf), fingerprints never do.

Defined results: null and empty texts and texts without words have fingerprint zero and are linked like any other;
rows with a null doc_id have a fingerprint and a null component and link nothing; repeated rows of one doc_id share
its component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm._common import materialize, scratch, utf8
from gristmill.llm._components import connected_components
from gristmill.llm._forest import Forest
from gristmill.llm._xxh64 import hash_slices

SHINGLE = 3
MAX_BITS = 2
#: Members of a leaf of the distributed index that call for a split. Leaves grow once there are MAX_LEAVES of them, up to
#: MOST_ROWS members; beyond that their number follows the fingerprints, so that a task's index has a bound.
LEAF_ROWS = 65_536
MAX_LEAVES = 1_024
MOST_ROWS = 1 << 20
#: Bytes of text that are hashed together.
CHUNK_BYTES = 2 << 20
LANES = np.uint64(0x0101010101010101)


# ---- fingerprints


def _chunk_fingerprints(docs: list[list[bytes]], shingle: int) -> np.ndarray:
    out = np.zeros(len(docs), np.uint64)
    own = [i for i, w in enumerate(docs) if w]
    if not own:
        return out
    buf = b"\n".join(b" ".join(docs[i]) for i in own)
    n = np.array([len(docs[i]) for i in own], np.int64)
    raw = np.frombuffer(buf, np.uint8)
    seps = np.flatnonzero((raw == 32) | (raw == 10))
    start, end = np.concatenate(([0], seps + 1)), np.concatenate((seps, [len(buf)]))
    first = np.cumsum(n) - n
    k = np.maximum(n - shingle + 1, 1)  # shingles of each document
    at = np.cumsum(k) - k
    w = np.arange(int(k.sum())) + np.repeat(first - at, k)
    h = hash_slices(buf, start[w], end[w + np.repeat(np.minimum(n, shingle) - 1, k)] - start[w])
    # byte lanes hold sums of up to 255 shingles
    runs = -(-k // 255)
    run_doc = np.cumsum(runs) - runs
    run_at = (np.arange(int(runs.sum())) - np.repeat(run_doc, runs)) * 255 + np.repeat(at, runs)
    for bit in range(8):
        sums = np.add.reduceat((h >> np.uint64(bit)) & LANES, run_at)
        counts = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), run_doc, axis=0)
        over = (2 * counts > k[:, None]).astype(np.uint64)
        for lane in range(8):
            out[own] |= over[:, lane] << np.uint64(8 * lane + bit)
    return out


def fingerprints(texts: list[bytes | None], shingle: int = SHINGLE) -> np.ndarray:
    """SimHash of each whole text: A-Z lower-cased, words of ASCII white space, word shingles with repeats."""
    out, part, size, at = [np.zeros(0, np.uint64)], [], 0, 0
    for t in texts:
        part.append((t or b"").lower().split())
        size += len(t or b"")
        if size >= CHUNK_BYTES:
            out.append(_chunk_fingerprints(part, shingle))
            part, size = [], 0
    out.append(_chunk_fingerprints(part, shingle))
    return np.concatenate(out)


@F.arrow_udf(T.LongType())
def _fingerprint_udf(text: pa.Array) -> pa.Array:
    return pa.array(fingerprints(utf8(text)).view(np.int64))


def fingerprint(text: Column | str) -> Column:
    return _fingerprint_udf(text)


# ---- the index


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the order of the reflected Gray code."""
    r = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class GrayIndex:
    """Items with a pattern over the bits of a mask (codes: all bits), in Gray order, under nodes of shared bits."""

    def __init__(self, patterns: np.ndarray, masks: np.ndarray | None = None, leaf: int = 16, fan: int = 8):
        masks = np.full(len(patterns), ~np.uint64(0)) if masks is None else masks
        self.order = np.argsort(gray_rank(patterns), kind="stable")
        #: From the items to the root: patterns, masks; then the bits that a level adds to its parents'.
        self.levels = [(patterns[self.order], masks[self.order])]
        self.fans = []
        while len(self.levels[-1][0]) > 1:
            p, m = self.levels[-1]
            fan_now = leaf if len(self.levels) == 1 else fan
            at = np.arange(0, len(p), fan_now)
            ones, some = np.bitwise_and.reduceat(p, at), np.bitwise_or.reduceat(p, at)
            shared = np.bitwise_and.reduceat(m, at) & ~(ones ^ some)
            self.levels.append((ones & shared, shared))
            self.fans.append(fan_now)
        self.added = [m & ~np.repeat(self.levels[i + 1][1], self.fans[i])[: len(m)] if i < len(self.fans) else m for i, (_, m) in enumerate(self.levels)]

    def search(self, codes: np.ndarray, limit: int = MAX_BITS, block: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, item) indices of all pairs that differ in at most `limit` bits of the item's mask, block by block."""
        if not len(self.order):
            return
        top = len(self.levels) - 1
        for lo in range(0, len(codes), block):
            q = np.arange(lo, min(lo + block, len(codes)))
            node, acc = np.zeros(len(q), np.int64), np.zeros(len(q), np.uint8)
            for level in range(top, -1, -1):
                if level < top:
                    fan = self.fans[level]
                    q, acc = np.repeat(q, fan), np.repeat(acc, fan)
                    node = (node[:, None] * fan + np.arange(fan)).ravel()
                    if (node[-1:] >= len(self.added[level])).any() or len(self.added[level]) % fan:
                        ok = node < len(self.added[level])
                        q, acc, node = q[ok], acc[ok], node[ok]
                acc = acc + np.bitwise_count((codes[q] ^ self.levels[level][0][node]) & self.added[level][node])
                ok = acc <= limit
                q, acc, node = q[ok], acc[ok], node[ok]
            yield q, self.order[node]


# ---- the distributed join


def _cut(codes: DataFrame, n: int, leaf_rows: int, max_leaves: int) -> list[tuple[int, int, int]]:
    """(pattern, bits, members) of the leaves. Counts of prefixes come here: at most 2^10, then 16 for each one split."""
    cap = max(leaf_rows, min(-(-n // max_leaves), MOST_ROWS))
    bits = 4
    while bits < 10 and n > (leaf_rows // 8 << bits):
        bits += 1
    done: list[tuple[int, int, int]] = []
    now = codes
    while True:
        prefix = F.shiftrightunsigned("fp", 64 - bits)
        counts = [(r[0], r[1]) for r in now.groupBy(prefix.alias("p")).count().collect()]
        hot = [p for p, c in counts if c > cap and bits < 64]
        done += [(p << (64 - bits), bits, c) for p, c in counts if c <= cap or bits == 64]
        if not hot:
            return sorted(done)
        now = codes.where(prefix.isin(hot))
        bits = min(64, bits + 4)


def _visits(leaves: list[tuple[int, int, int]], limit: int):
    """A mapInArrow function: (fp, rep) to (leaf, role, fp, rep): 0 the one leaf it belongs to, 1 a later one within the limit."""
    patterns = np.array([p % (1 << 64) for p, _, _ in leaves], np.uint64)
    masks = np.array([((1 << b) - 1) << (64 - b) for _, b, _ in leaves], np.uint64)

    def go(batches):
        index = GrayIndex(patterns, masks)
        for batch in batches:
            fp, rep = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            codes = fp.astype(np.int64).view(np.uint64)
            for q, leaf in index.search(codes, limit):
                home = ((codes[q] ^ patterns[leaf]) & masks[leaf]) == 0
                own = np.full(len(codes), -1)
                own[q[home]] = leaf[home]
                keep = leaf >= own[q]
                q, leaf, home = q[keep], leaf[keep], home[keep]
                yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), pa.array((~home).astype(np.int32)), pa.array(fp[q]), pa.array(rep[q])], names=["leaf", "role", "fp", "rep"])

    return go


def _links(limit: int):
    """A mapInArrow function over rows sorted by leaf and role: links (u, v) of representatives that keep components."""

    def go(batches):
        leaf, members, index, forest = None, [], None, None

        def out(u, v):
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), pa.array(v.astype(np.int64))], names=["u", "v"])

        def build():
            nonlocal index, forest, codes, reps
            codes, reps = (np.concatenate([m[i] for m in members]) for i in (0, 1))
            index, forest = GrayIndex(codes), Forest(len(codes))
            for q, m in index.search(codes, limit):
                a, b = forest.link(q, m)
                yield from out(reps[a], reps[b])

        codes = reps = None
        for batch in batches:
            leaves, roles, fps, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            fps = fps.astype(np.int64).view(np.uint64)
            key = leaves.astype(np.int64) * 2 + roles
            cuts = np.flatnonzero(np.diff(key)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
                if lo == hi:
                    continue
                if leaves[lo] != leaf:
                    if members and index is None:
                        yield from build()
                    leaf, members, index, forest = leaves[lo], [], None, None
                if roles[lo] == 0:
                    members.append((fps[lo:hi], ids[lo:hi]))
                    continue
                if not members:
                    continue
                if index is None:
                    yield from build()
                for q, m in index.search(fps[lo:hi], limit):
                    if not len(q):
                        continue
                    # a visitor joins all members that it meets: by the first of them
                    at = np.flatnonzero(np.diff(q, prepend=-1))
                    head = m[at]
                    yield from out(ids[lo:hi][q[at]], reps[head])
                    a, b = forest.link(m, np.repeat(head, np.diff(np.append(at, len(q)))))
                    yield from out(reps[a], reps[b])
        if members and index is None:
            yield from build()

    return go


def linked_fingerprints(prints: DataFrame, max_bits: int = MAX_BITS, leaf_rows: int = LEAF_ROWS, max_leaves: int = MAX_LEAVES) -> DataFrame:
    """(doc_id, fp) to (fp, component_id): for each fingerprint the least doc_id that links reach from it."""
    reps = materialize(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "fps")
    n = reps.count()
    if n == 0:
        return reps.select("fp", F.col("rep").alias("component_id"))
    leaves = _cut(reps, n, leaf_rows, max_leaves)
    visits = reps.select("fp", "rep").mapInArrow(_visits(leaves, max_bits), "leaf int, role int, fp long, rep long")
    dealt = visits.repartition("leaf").sortWithinPartitions("leaf", "role")
    comps = connected_components(dealt.mapInArrow(_links(max_bits), "u long, v long"))
    return reps.join(comps, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))


def simhash_components(docs: DataFrame, **kw) -> DataFrame:
    """doc_id, fp (signed 64 bits), component_id for each row of docs (doc_id, text)."""
    prints = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint("text").alias("fp")), "prints")
    found = linked_fingerprints(prints, **kw)
    return prints.join(found, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, **kw) -> DataFrame:
    """The rows of docs without near copies: of each component of fingerprints the row with the least doc_id. A null doc_id stays.

    Rows of one doc_id whose fingerprints aren't linked are of different components. Of rows of a component with the
    same doc_id the first in order of a hash of the whole row stays, the same on every run.
    """
    c, h, n = scratch("id"), scratch("hash"), scratch("row")
    own = docs.where("doc_id is not null")
    row = F.xxhash64(*[k for k, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])
    prints = materialize(own.select(F.struct(F.col("doc_id").alias(c), row.alias(h)).alias("first"), fingerprint("text").alias("fp")).groupBy("fp").agg(F.min("first").alias("first")), "firsts")
    found = linked_fingerprints(prints.select(F.col("fp").alias("doc_id"), "fp"), **kw)  # components of fingerprints, not of ids
    heads = prints.join(found, "fp").groupBy("component_id").agg(F.min("first").alias("first")).select("first.*")
    kept = own.withColumn(n, row).join(heads, (F.col("doc_id") == F.col(c)) & (F.col(n) == F.col(h)), "left_semi")
    once = kept.withColumn(n, F.row_number().over(Window.partitionBy("doc_id", n).orderBy(n))).where(F.col(n) == 1).drop(n)
    return once.unionByName(docs.where("doc_id is null"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
