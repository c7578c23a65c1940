"""Token-ID output: raw id payloads in shards, found by key in constant time through a minimal perfect hash index.

A shard is three files. `.ids`: the ids of its documents one after another, raw little-endian unsigned integers of 16
bits where the vocabulary allows, else 32. `.key`: the doc_ids in order, 64 bits each (for scans). `.mph`: the index. It
maps each key to a slot of its own by levels of bit arrays (a key stays on the first level where no other key of that
level has its bit; the slot is the rank of the bit), and holds for each slot a 32-bit fingerprint of its key and the
document's place, and the start of each document. A key that is not in the shard is told by its fingerprint, but for
one in 2^32.

Above the shards the manifest is a directory: first and last key of each. A lookup over all shards takes the shard from
the directory and asks one index.

Scale: one shuffle, a range sort by doc_id; each task streams its range and starts a new shard after SHARD_BYTES, so
memory has a bound. Shards are written to a temporary name and renamed, and have the same bytes whenever a task runs
again. What comes back is one manifest row for each shard, from which prefix sums give each shard's first id. The
tokenizers library encodes each distinct piece of text that a worker meets (_byte_level.py).

Files go through pyarrow's file systems, in the shared folder that the cluster names.

Defined results: null counts as empty, an empty document has the end id alone; texts are whole, special tokens' strings
in them are ordinary text; rows with a null doc_id come first, have no key and are read by scans only; repeated doc_ids
are all written, side by side, and a key finds the first; an empty table gives no files and no rows; other columns are
ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.llm._byte_level import Encoder
from gristmill.llm._common import materialize, parts, shared_path

END_ID = 2
SHARD_BYTES = 32 << 20
#: Bound of the tasks that read shards back.
MAX_READERS = 8_192
MAGIC = b"GMPH0001"
NULL_KEY = -(1 << 63)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# ---- the index


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """64 well-mixed bits of each key."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.int64).view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Slots 0..n-1 for n distinct 64-bit keys."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words  # bits of each level; the levels' bit arrays one after another
        self.starts = np.concatenate(([0], np.cumsum(sizes)))
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    @classmethod
    def build(cls, keys: np.ndarray, room: float = 2.0) -> PerfectHash:
        sizes, words, left = [], [np.zeros(0, np.uint64)], keys
        while len(left):
            m = max(64, -(-int(room * len(left)) // 64) * 64)
            at = (mix(left, len(sizes)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            sizes.append(m)
            words.append(np.packbits(alone, bitorder="little").view("<u8").astype(np.uint64))
            left = left[~alone[at]]
            if len(sizes) > 64:
                raise ValueError("keys are not distinct")
        return cls(np.array(sizes, np.int64), np.concatenate(words))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; any slot or -1 for a key that was not built in."""
        out, todo = np.full(len(keys), -1), np.arange(len(keys))
        for level, m in enumerate(self.sizes.tolist()):
            if not len(todo):
                break
            at = self.starts[level] + (mix(keys[todo], level) % np.uint64(m)).astype(np.int64)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            w = self.words[word]
            hit = ((w >> bit) & np.uint64(1)).astype(bool)
            below = np.bitwise_count(w & ((np.uint64(1) << bit) - np.uint64(1)))
            out[todo[hit]] = self.before[word[hit]] + below[hit]
            todo = todo[~hit]
        return out


def index_bytes(keys: np.ndarray, starts: np.ndarray, width: int) -> bytes:
    """The .mph file. keys: in order, NULL_KEY for none; starts: first id of each document, and the end."""
    keyed = np.flatnonzero(keys != NULL_KEY)
    own, first = np.unique(keys[keyed], return_index=True)
    place = keyed[first]
    h = PerfectHash.build(own)
    slot = h.slots(own)
    prints, places = np.zeros(len(own), "<u4"), np.zeros(len(own), "<u4")
    prints[slot], places[slot] = (mix(own, 255) >> np.uint64(32)).astype("<u4"), place
    head = struct.pack("<8s5q", MAGIC, width, len(keys), len(own), len(h.sizes), len(h.words))
    return b"".join((head, h.sizes.astype("<i8").tobytes(), h.words.astype("<u8").tobytes(), prints.tobytes(), places.tobytes(), starts.astype("<i8").tobytes()))


class Shard:
    """Keyed access to one shard. `base` is the path without its ending."""

    def __init__(self, base: str):
        self.fs, self.base = filesystem(base)
        raw = self._read(".mph")
        magic, self.width, self.n, n_keys, n_levels, n_words = struct.unpack_from("<8s5q", raw)
        if magic != MAGIC:
            raise ValueError(f"{base}.mph is not an index")
        at, fields = struct.calcsize("<8s5q"), []
        for kind, n in (("<i8", n_levels), ("<u8", n_words), ("<u4", n_keys), ("<u4", n_keys), ("<i8", self.n + 1)):
            fields.append(np.frombuffer(raw, kind, n, at))
            at += n * int(kind[2])
        self.hash, (self.prints, self.places, self.starts) = PerfectHash(fields[0], fields[1].astype(np.uint64)), fields[2:]
        self.kind = "<u2" if self.width == 2 else "<u4"

    def _read(self, ending: str) -> bytes:
        with self.fs.open_input_stream(self.base + ending) as f:
            return f.read()

    def keys(self) -> np.ndarray:
        return np.frombuffer(self._read(".key"), "<i8")

    def payload(self) -> np.ndarray:
        return np.frombuffer(self._read(".ids"), self.kind)

    def places_of(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key's (first) document in the shard, -1 for none."""
        slot = self.hash.slots(keys)
        slot[slot >= len(self.prints)] = -1
        known = (slot >= 0) & (self.prints[slot] == (mix(keys, 255) >> np.uint64(32))) if len(self.prints) else np.zeros(len(keys), bool)
        return np.where(known, self.places[slot].astype(np.int64) if len(self.prints) else -1, -1)

    def get(self, doc_id: int) -> np.ndarray | None:
        """The ids of a document: one look into the index, one read of its bytes."""
        p = int(self.places_of(np.array([doc_id], np.int64))[0])
        if p < 0:
            return None
        with self.fs.open_input_file(self.base + ".ids") as f:
            return np.frombuffer(f.read_at(int(self.starts[p + 1] - self.starts[p]) * self.width, int(self.starts[p]) * self.width), self.kind)


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


# ---- files


def _writer(out: str, tokenizer: str, end_id: int, shard_bytes: int):
    def go(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, seq, keys, payload, size = TaskContext.get().partitionId(), 0, [], [], 0
        encoder = Encoder.load(tokenizer)
        end = np.array([end_id], encoder.kind).tobytes()
        width = len(end)
        fs, root = filesystem(out)
        fs.create_dir(root, recursive=True)

        def flush():
            name = f"{root}/shard-{part:06d}-{seq:05d}"
            own = np.array(keys, "<i8")
            keyed = own[own != NULL_KEY]
            starts = np.concatenate(([0], np.cumsum(np.array(list(map(len, payload)), np.int64) // width)))
            for ending, data in ((".ids", payload), (".key", [own.tobytes()]), (".mph", [index_bytes(own, starts, width)])):
                temp = f"{root}/.{part:06d}-{seq:05d}{ending}.{os.getpid()}-{TaskContext.get().taskAttemptId()}"
                with fs.open_output_stream(temp) as f:
                    f.write(b"".join(data))
                fs.move(temp, name + ending)
            first, last = (pa.array([int(keyed[k])] if len(keyed) else [None], pa.int64()) for k in (0, -1))
            row = [pa.array([f"{out}/shard-{part:06d}-{seq:05d}"]), pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(own)]), pa.array([int(starts[-1])]), first, last]
            return pa.RecordBatch.from_arrays(row, names=["base", "part", "seq", "docs", "ids", "first_key", "last_key"])

        for batch in (p for b in batches for p in parts(b, b.column(1))):
            ids = encoder.encode(batch.column(1))
            for key, own in zip(batch.column(0).to_pylist(), ids, strict=True):
                keys.append(NULL_KEY if key is None else key)
                payload.append(own + end)
                size += len(own) + width
                if size >= shard_bytes:
                    yield flush()
                    seq, keys, payload, size = seq + 1, [], [], 0
        if keys:
            yield flush()

    return go


def write_token_files(docs: DataFrame, out: str, tokenizer: str | None = None, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES, ranges: int | None = None) -> DataFrame:
    """Write docs (doc_id, text) to shards under `out`, and the manifest to out/manifest.

    The manifest has a row for each shard: base, part, seq, docs, ids, first_key, last_key, start (first id of all).
    """
    spark = docs.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    # ranges of (id, hash): rows without an id, or of one id, are dealt over several tasks too
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, *order[:2]).sortWithinPartitions(*order)
    made = rows.mapInArrow(_writer(out, tokenizer or default_tokenizer(), end_id, shard_bytes), "base string, part int, seq int, docs long, ids long, first_key long, last_key long")
    manifest = materialize(made, "manifest", f"{out}/manifest")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    return manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


class TokenFiles:
    """Keyed access to all shards under a folder.

    The directory, a row for each shard, is held in memory; a key's shard is the first whose last key isn't below it,
    and the shard's index gives the place in constant time. Of `kept` shards the index stays loaded.
    """

    def __init__(self, out: str, kept: int = 64):
        from pyarrow import dataset

        fs, root = filesystem(out)
        t = dataset.dataset(f"{root}/manifest", filesystem=fs, format="parquet", exclude_invalid_files=True).to_table(columns=["part", "seq", "base", "last_key"])
        rows = sorted((p, s, b, k) for p, s, b, k in zip(*(t.column(i).to_pylist() for i in range(4)), strict=True) if k is not None)
        self.bases, self.last = [r[2] for r in rows], np.array([r[3] for r in rows], np.int64)
        self.shard = lru_cache(maxsize=kept)(Shard)

    def get(self, doc_id: int) -> np.ndarray | None:
        """The ids of the (first) document with this id, or None."""
        i = int(np.searchsorted(self.last, doc_id))
        return self.shard(self.bases[i]).get(doc_id) if i < len(self.bases) else None


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read from the shards: each key is looked up in the index.

    Shards are dealt over as many tasks as there are shards, MAX_READERS at most; a task holds one shard at a time.
    """

    def go(batches):
        import pyarrow as pa

        for batch in batches:
            for base, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(base)
                keys, payload = shard.keys(), shard.payload()
                place = shard.places_of(keys)
                row = np.arange(len(keys))
                # rows without a key, and those after the first of a key, are read in order
                again = np.concatenate(([False], keys[1:] == keys[:-1])) & (keys != NULL_KEY) if len(keys) else np.zeros(0, bool)
                at = np.where((keys == NULL_KEY) | again, row, place)
                lo, hi = shard.starts[at], shard.starts[at + 1]
                crc = [zlib.crc32(payload[a:b].astype("<u4").tobytes()) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
                doc = pa.array(keys, mask=keys == NULL_KEY)
                yield pa.RecordBatch.from_arrays([doc, pa.array(lo + start), pa.array(hi - lo), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    readers = min(max(manifest.count(), 1), MAX_READERS)
    spread = manifest.select("base", "start").repartition(readers, "base")
    return spread.mapInArrow(go, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read_token_files(write_token_files(docs, shared_path(spark, "tokens")))
