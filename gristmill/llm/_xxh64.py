"""XXH64 of many slices of one buffer at once: slices of one length share the numpy steps of the published algorithm."""

from __future__ import annotations

import numpy as np
import xxhash

P1, P2, P3, P4, P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc, lane):
    return _rotl(acc + lane * P2, 31) * P1


def hash_slices(buf: bytes, start: np.ndarray, size: np.ndarray, seed: int = 42, longest: int = 512) -> np.ndarray:
    """Unsigned 64-bit hashes of buf[start:start+size]. Slices over `longest` bytes go through the library one by one."""
    out = np.empty(len(start), np.uint64)
    if not len(start):
        return out
    padded = buf + bytes(8)
    q = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
    d = np.ndarray((len(buf) + 1,), "<u4", padded, strides=(1,))
    b = np.frombuffer(padded, np.uint8)
    s = np.uint64(seed)
    order = np.argsort(np.minimum(size, longest + 1).astype(np.int16), kind="stable")
    sizes = size[order]
    cuts = np.flatnonzero(np.diff(np.minimum(sizes, longest + 1))) + 1
    with np.errstate(over="ignore"):
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(order)], strict=True):
            at, n = order[lo:hi], int(sizes[lo])
            if n > longest:
                for i in at.tolist():
                    out[i] = xxhash.xxh64_intdigest(buf[start[i] : start[i] + size[i]], seed)
                continue
            p, left = start[at], n
            if n >= 32:
                acc = [np.full(len(p), x) for x in (s + P1 + P2, s + P2, s, s - P1)]
                while left >= 32:
                    for k in range(4):
                        acc[k] = _round(acc[k], q[p + 8 * k])
                    p = p + 32
                    left -= 32
                h = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
                for a in acc:
                    h = (h ^ _round(np.uint64(0), a)) * P1 + P4
            else:
                h = np.full(len(p), s + P5)
            h = h + np.uint64(n)
            while left >= 8:
                h = _rotl(h ^ _round(np.uint64(0), q[p]), 27) * P1 + P4
                p = p + 8
                left -= 8
            if left >= 4:
                h = _rotl(h ^ (d[p].astype(np.uint64) * P1), 23) * P2 + P3
                p = p + 4
                left -= 4
            while left:
                h = _rotl(h ^ (b[p].astype(np.uint64) * P5), 11) * P1
                p = p + 1
                left -= 1
            h = (h ^ (h >> np.uint64(33))) * P2
            h = (h ^ (h >> np.uint64(29))) * P3
            out[at] = h ^ (h >> np.uint64(32))
    return out
