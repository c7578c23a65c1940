"""The tokenizers library over the distinct pieces of many texts.

A byte-level tokenizer encodes each match of its pattern by itself. The matches of a batch are found by array operations
over the UTF-8 bytes; equal ones are folded by Arrow, and only those that the worker hasn't met go to the library, many
in one call. Which code points are letters, numbers or white space is asked of the library's own regular expressions,
so that its version of Unicode counts. A byte that UTF-8 never has, and that merges with nothing, begins each piece of
a call: the library then splits at its character, and its id tells the pieces' ids apart.

A tokenizer of another kind (a normalizer, another pattern, added tokens that aren't special) encodes texts whole.
"""

from __future__ import annotations

import codecs
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa

from gristmill.llm._common import quiet_threads

#: Pieces that a worker keeps the ids of, and pieces in one call of the library.
KEPT_PIECES = 600_000
CALL_PIECES = 128
#: Bytes of a piece that is kept; longer ones are encoded each time.
LONGEST_KEPT = 64
#: Bytes that UTF-8 never has.
UNUSED = (0xC0, 0xC1, *range(0xF5, 0x100))
#: Bytes that stand for themselves in a byte-level vocabulary; the others are, in order, the characters from 256 on.
VISIBLE = (range(33, 127), range(161, 173), range(174, 256))
OTHER, LETTER, NUMBER, SPACE, UNSEEN = range(5)
CLASSES = ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s"))
#: After an apostrophe at the start of a match these letters end it.
CONTRACTIONS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


class CodePoints:
    """The class of each code point, asked of the library when it is first seen."""

    def __init__(self):
        self.known = np.full(0x110000, UNSEEN, np.uint8)
        self.of_byte = np.full(256, OTHER, np.uint8)
        self.of_byte[:128] = self.of(np.arange(128))

    def of(self, points: np.ndarray) -> np.ndarray:
        new = np.unique(points[self.known[points] == UNSEEN])
        if len(new):
            from tokenizers import Regex
            from tokenizers.pre_tokenizers import Split

            self.known[new] = OTHER
            text = "".join(map(chr, new.tolist()))
            for kind, pattern in CLASSES:
                for _, (lo, hi) in Split(Regex(f"[^{pattern}]+"), "removed").pre_tokenize_str(text):
                    self.known[new[lo:hi]] = kind
        return self.known[points]


def matches(data: np.ndarray, ends: np.ndarray, points: CodePoints) -> np.ndarray:
    """Where the matches of the pattern begin in texts that stand one after another; ends: the texts' offsets, from 0."""
    n = len(data)
    kind = points.of_byte[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        head = data[lead].astype(np.int64)
        size = 2 + (head >= 0xE0) + (head >= 0xF0)
        code = head & np.array([0, 0, 0x1F, 0x0F, 0x07])[size]
        for k in (1, 2, 3):
            on = size > k
            code[on] = code[on] << 6 | data[lead[on] + k] & 0x3F
        own = points.of(code)
        for k in range(4):
            kind[lead[size > k] + k] = own[size > k]
    edge = np.zeros(n + 2, bool)  # a text begins or ends here
    edge[ends] = edge[n:] = True
    begins = edge[:n].copy()
    begins[1:] |= kind[1:] != kind[:-1]
    # the last white space before something else is a match of its own; if it is a space it opens the next one instead
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~edge[1:n])
    head = last.copy()
    while (inner := (data[head] & 0xC0) == 0x80).any():
        head[inner] -= 1
    begins[head] = True
    begins[last[data[last] == 32] + 1] = False
    quote = np.flatnonzero(data == 39)
    quote = quote[begins[quote]]
    padded = np.concatenate((data[: n], np.zeros(2, np.uint8)))
    for letters in CONTRACTIONS:
        at = quote
        for k, c in enumerate(letters, 1):
            at = at[~edge[np.minimum(at + k, n)] & (padded[np.minimum(at + k, n)] == c)]
        begins[at + 1] = False
        at = at + len(letters) + 1
        begins[at[at < n]] = True
    return np.flatnonzero(begins)


def byte_characters() -> str:
    """The character of each byte in a byte-level vocabulary."""
    others = iter(range(256, 512))
    return "".join(chr(b if any(b in r for r in VISIBLE) else next(others)) for b in range(256))


class Encoder:
    """Raw ids of whole texts as the tokenizers library gives them, special tokens' strings being ordinary text."""

    def __init__(self, path: str, kept: int = KEPT_PIECES):
        quiet_threads()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.kept, self.known, self.points = kept, {}, CodePoints()
        self.mark = self._mark(json.loads(self.tokenizer.to_str()))
        if self.mark is not None:
            from tokenizers.pre_tokenizers import Metaspace

            self.characters = byte_characters()
            sign = self.characters[self.mark]
            self.by_piece = Tokenizer.from_file(path)
            self.by_piece.pre_tokenizer = Metaspace(replacement=sign, prepend_scheme="never", split=True)
            self.mark_id = self.by_piece.token_to_id(sign)

    @staticmethod
    def _mark(spec: dict) -> int | None:
        """The byte to begin pieces with; None if the tokenizer must see whole texts."""
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        cut = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        plain = spec["normalizer"] is None and all(t["special"] for t in spec["added_tokens"]) and model["type"] == "BPE"
        odd = ("dropout", "ignore_merges", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix", "unk_token")
        if not (cut and plain) or any(model.get(k) for k in odd):
            return None
        characters, merged = byte_characters(), set("".join(t for t in model["vocab"] if len(t) > 1))
        return next((b for b in UNUSED if characters[b] in model["vocab"] and characters[b] not in merged), None)

    @staticmethod
    @lru_cache(maxsize=2)
    def load(path: str) -> Encoder:
        return Encoder(path)

    def _learn(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces."""
        mark, out = bytes([self.mark]), []
        calls = [mark + mark.join(pieces[lo : lo + CALL_PIECES]) for lo in range(0, len(pieces), CALL_PIECES)]
        texts = [codecs.charmap_decode(x, "strict", self.characters)[0] for x in calls]
        for e in self.by_piece.encode_batch_fast(texts, add_special_tokens=False):
            ids = np.array(e.ids, self.kind)
            raw, at = ids.tobytes(), np.flatnonzero(ids == self.mark_id) * ids.itemsize
            stops = [*at[1:].tolist(), len(raw)]
            out += [raw[lo:hi] for lo, hi in zip((at + ids.itemsize).tolist(), stops, strict=True)]
        return out

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Raw ids of each text; null counts as empty."""
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        if self.mark is None:
            whole = self.tokenizer.encode_batch_fast([t.decode() for t in texts.to_pylist()], add_special_tokens=False)
            return [np.array(e.ids, self.kind).tobytes() for e in whole]
        _, offsets, data = texts.buffers()
        ends = np.frombuffer(offsets, "<i8")[texts.offset : texts.offset + len(texts) + 1]
        if ends[0] == ends[-1]:
            return [b""] * len(texts)
        data = data.slice(int(ends[0]), int(ends[-1] - ends[0]))
        ends = ends - ends[0]
        starts = matches(np.frombuffer(data, np.uint8), ends, self.points)
        kind, width = (pa.binary(), "<i4") if len(data) < 1 << 31 else (pa.large_binary(), "<i8")
        bounds = pa.py_buffer(np.append(starts, len(data)).astype(width))
        pieces = pa.Array.from_buffers(kind, len(starts), [None, bounds, data]).dictionary_encode()
        own = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.known.get, own))
        new = [i for i, x in enumerate(ids) if x is None]
        for i, x in zip(new, self._learn([own[i] for i in new]), strict=True):
            ids[i] = x
            if len(own[i]) <= LONGEST_KEPT:
                self.known[own[i]] = x
        if len(self.known) > self.kept:
            self.known = {p: x for p, x in zip(own, ids, strict=True) if len(p) <= LONGEST_KEPT}
        out = pa.array(ids, pa.large_binary()).take(pieces.indices)
        raw = out.buffers()[2].to_pybytes()
        at = np.frombuffer(out.buffers()[1], "<i8")[: len(starts) + 1][np.searchsorted(starts, ends)].tolist()
        return [raw[lo:hi] for lo, hi in zip(at[:-1], at[1:], strict=True)]
