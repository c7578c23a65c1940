"""Byte-level BPE encoding and decoding with numpy matrices.

Pieces of a batch that no earlier batch of the worker has had are bucketed by length and padded into matrices of token
ids, one row each. Each round every row merges its leftmost pair of minimum rank, found through a hashed table of the
pairs that merge; the matrix is compacted by one column and rows without a pair leave it. A matrix copies its row each
round, which is quadratic in the row's length: a piece of more than LONG bytes (an unbroken run of letters or of encoded
data) is a linked row instead, whose pairs stand in a heap by (rank, place), so that the leftmost pair of minimum rank
comes first and a merge touches its neighbours alone. Equal pieces are encoded once; the table of pieces that a worker
keeps has fixed bounds and is emptied when full, which changes no result.

Where a single space stands between two characters that aren't white space the pattern always begins a match, so in
texts without other runs with a space what lies between two spaces is encoded by itself and known again.

Scale: one pass over the texts, no shuffle; a worker holds one batch, the vocabulary and a bounded table of pieces.

Defined results: null counts as empty and has no ids; text of any length is encoded whole; repeated rows give repeated
results, a null doc_id is encoded like any; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm._common import parts

#: Chunks between spaces that a worker keeps the ids of, and their bytes with the ids'.
KEPT_PIECES = 500_000
KEPT_BYTES = 64 << 20
#: Bytes from which on a piece is a linked row.
LONG = 512
#: Pairs tried for one slot of the hashed table, and cells of one matrix.
CELLS = 1 << 20
NEVER = 2**31 - 1
#: Bytes of text encoded together.
PART_BYTES = 2 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class PairTable:
    """Open addressing over (left id, right id), filled and asked for whole arrays at once."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(len(rank), 1) * 4))))
        size = 1 << self.bits
        self.keys, self.ranks, self.reach = np.full(size, -1, np.int64), np.full(size, NEVER, np.int32), 1
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[slot] < 0
            at, first = np.unique(slot[free], return_index=True)  # one key takes each free slot
            winners = todo[free][first]
            self.keys[at], self.ranks[at] = keys[winners], rank[winners]
            lost = self.keys[slot] != keys[todo]
            todo, slot = todo[lost], (slot[lost] + 1) & (size - 1)
            self.reach += bool(len(todo))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; NEVER where they don't merge. A negative id is padding."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.ranks[slot], NEVER)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        for step in range(1, self.reach + 1):
            if not len(open_):
                break
            at = (slot[open_] + step) & (len(self.keys) - 1)
            found = self.keys[at]
            hit = found == keys[open_]
            out[open_[hit]] = self.ranks[at[hit]]
            open_ = open_[~hit & (found >= 0)]
        out[(left < 0) | (right < 0)] = NEVER
        return out


class Codec:
    """Ids of whole texts and the bytes of ids, as the ranks and the pattern of a vocabulary define them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, kept: int = KEPT_PIECES):
        self.ranks, self.pattern, self.kept = ranks, regex.compile(pattern), kept
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, r in ranks.items():
            self.tokens[r] = token
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self.pairs = PairTable(*np.array(pairs, np.int64).reshape(-1, 3).T)
        self.spans: dict[str, bytes] = {}
        self.size = 0

    @staticmethod
    @lru_cache(maxsize=2)
    def load(path: str, pattern: str) -> Codec:
        with open(path, "rb") as f:
            return Codec({base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}, pattern)

    # -- encoding

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of byte pieces by merging alone."""
        out = [b""] * len(pieces)
        sizes = np.array(list(map(len, pieces)), np.int64)
        order = np.argsort(sizes, kind="stable")
        lo, long = np.searchsorted(sizes[order], (1, LONG)).tolist()
        for i in order[long:].tolist():
            out[i] = self._merge_linked(pieces[i])
        order = order[:long]
        while lo < len(order):  # rows of a matrix: similar lengths, a bounded number of cells
            shortest = sizes[order[lo]]
            hi = int(np.searchsorted(sizes[order], shortest + max(1, shortest // 8), side="right"))
            hi = min(hi, lo + max(1, CELLS // int(sizes[order[hi - 1]])))
            self._merge_matrix([pieces[i] for i in order[lo:hi]], sizes[order[lo:hi]], order[lo:hi], out)
            lo = hi
        return out

    def _merge_linked(self, piece: bytes) -> bytes:
        """The same merges of one long piece: a heap of pairs and links between neighbours."""
        n, tokens, rank = len(piece), self.tokens, self.ranks.get
        ids = self.of_byte[np.frombuffer(piece, np.uint8)]
        low = self.pairs.get(ids[:-1], ids[1:])
        at = np.flatnonzero(low != NEVER)
        heap = np.sort(low[at].astype(np.int64) << 32 | at).tolist()  # rank, then place; sorted is a heap
        ids, low = ids.tolist(), [*low.tolist(), NEVER]
        after, before, place = list(range(1, n + 1)), list(range(-1, n - 1)), (1 << 32) - 1
        while heap:
            r = heappop(heap)
            i, r = r & place, r >> 32
            if low[i] != r:  # this pair is gone
                continue
            j = after[i]
            k = after[j]
            ids[i], after[i], low[j] = r, k, -1
            own = tokens[r]
            if k < n:
                before[k] = i
                low[i] = x = rank(own + tokens[ids[k]], NEVER)
                if x != NEVER:
                    heappush(heap, x << 32 | i)
            else:
                low[i] = NEVER
            h = before[i]
            if h >= 0:
                low[h] = x = rank(tokens[ids[h]] + own, NEVER)
                if x != NEVER:
                    heappush(heap, x << 32 | h)
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return np.array(out, "<u4").tobytes()

    def _merge_matrix(self, rows: list[bytes], sizes: np.ndarray, name: np.ndarray, out: list) -> None:
        width = int(sizes[-1])
        padded = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in rows), np.uint8).reshape(-1, width)
        ids = self.of_byte[padded]
        ids[np.arange(width) >= sizes[:, None]] = -1
        sizes = sizes.copy()
        best = self.pairs.get(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        while True:
            n, width = ids.shape
            at = best.argmin(axis=1) if width > 1 else np.zeros(n, np.int64)  # the leftmost of the least rank
            row = np.arange(n)
            low = best[row, at] if width > 1 else np.full(n, NEVER)
            over = low == NEVER
            if over.any():
                done, step = ids[over].astype("<u4").tobytes(), 4 * width
                for k, (i, size) in enumerate(zip(name[over].tolist(), sizes[over].tolist(), strict=True)):
                    out[i] = done[k * step : k * step + 4 * size]
                on = ~over
                ids, best, sizes, name, at, low = ids[on], best[on], sizes[on], name[on], at[on], low[on]
                n = len(ids)
                if not n:
                    return
                row = np.arange(n)
            ids[row, at] = low
            keep = np.ones(ids.shape, bool)
            keep[row, at + 1] = False
            ids = ids[keep].reshape(n, width - 1)
            keep = np.ones(best.shape, bool)
            keep[row, at] = False
            best = best[keep].reshape(n, width - 2)
            sizes = sizes - 1
            # of the pairs only the two that hold the new token have changed
            right = np.flatnonzero(at + 1 < width - 1)
            if len(right):
                best[right, at[right]] = self.pairs.get(ids[right, at[right]], ids[right, at[right] + 1])
            left = np.flatnonzero(at > 0)
            if len(left):
                best[left, at[left] - 1] = self.pairs.get(ids[left, at[left] - 1], ids[left, at[left]])

    def _piece_ids(self, pieces: set[str]) -> dict[str, bytes]:
        """A piece that is a token as a whole has that id; all others are merged."""
        raw = {p: p.encode() for p in pieces}
        out = {p: r.to_bytes(4, "little") for p, b in raw.items() if (r := self.ranks.get(b)) is not None}
        todo = raw.keys() - out.keys()
        out.update(zip(todo, self.merge([raw[p] for p in todo]), strict=True))
        return out

    def _learn(self, chunks: list[str]) -> None:
        """Ids of chunks that follow a single space; none of them begins or ends with white space or holds a space."""
        if not chunks:
            return
        parts = self.pattern.findall(" " + " ".join(chunks))
        get = self._piece_ids(set(parts)).__getitem__
        heads = [i for i, p in enumerate(parts) if p[0] == " "]  # a space begins a chunk
        ids = list(map(get, parts))
        for c, lo, hi in zip(chunks, heads, [*heads[1:], len(parts)], strict=True):
            self.spans[c] = own = ids[lo] if hi == lo + 1 else b"".join(ids[lo:hi])
            self.size += len(c) + len(own)

    def _direct(self, texts: list[str]) -> list[bytes]:
        parts = list(map(self.pattern.findall, texts))
        get = self._piece_ids(set().union(*parts)).__getitem__
        return [b"".join(map(get, p)) for p in parts]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each whole text as little-endian unsigned 32-bit integers."""
        if len(self.spans) > self.kept or self.size > KEPT_BYTES:
            self.spans, self.size = {}, 0
        cut, want = [], set()
        for t in texts:
            chunks = (t or "").split(" ")
            cut.append(chunks)
            want.update(chunks)
        self._learn([c for c in want - self.spans.keys() if c and not c[0].isspace() and not c[-1].isspace()])
        get, heads, rests = self.spans.__getitem__, [], []
        for t, chunks in zip(texts, cut, strict=True):
            try:
                rest = b"".join(map(get, chunks[1:]))
                get(chunks[0])  # the first chunk has no space before it but must end as the others do
                heads.append(chunks[0])
                rests.append(rest)
            except KeyError:  # more white space somewhere, or no text
                heads.append(t or "")
                rests.append(b"")
        return list(map(bytes.__add__, self._direct(heads), rests))

    # -- decoding

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_decode(docs: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of docs (doc_id, text)."""
    ranks, pattern = ranks or default_ranks(), pattern or default_pattern()

    def go(batches):
        import pyarrow as pa

        codec = Codec.load(ranks, pattern)
        for batch in (p for b in batches for p in parts(b, b.column(1), PART_BYTES)):
            ids = codec.encode(batch.column(1).to_pylist())
            n = pa.array([len(x) // 4 for x in ids], pa.int64())
            shas = [hashlib.sha256(x).hexdigest() for x in ids]
            back = [hashlib.sha256(codec.decode(x)).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), n, pa.array(shas, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(go, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_ids(docs: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and the ids themselves, as an array of ints."""
    ranks, pattern = ranks or default_ranks(), pattern or default_pattern()

    def go(batches):
        import pyarrow as pa

        codec = Codec.load(ranks, pattern)
        for batch in (p for b in batches for p in parts(b, b.column(1), PART_BYTES)):
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in codec.encode(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(go, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
