"""Token ids of whole texts from a public tokenizer file, with each distinct pre-token encoded once per worker."""

from __future__ import annotations

import os

import numpy as np

from assayer.llm.arrays import LOWER, byte_values, flat, prefix_hashes, ranges, span_hashes

KEPT = 1_500_000
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[10, 32]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
# ASCII marks that end a run of letters. Quotes, angle brackets and bars are left out: contractions and special tokens hold them.
_MARK = np.zeros(256, dtype=bool)
_MARK[np.frombuffer(b"!#$%&()*+,-./:;=?@[]^_{}~", dtype=np.uint8)] = True


def pre_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the pieces that a white-space dropping tokenizer treats apart.

    Pieces end at spaces and line feeds and where an ASCII letter meets a mark; they may hold several of the tokenizer's own pre-tokens.
    """
    if not len(data):
        return (np.zeros(0, dtype=np.int64),) * 3
    lowered = LOWER[data]
    full, letter, mark = ~_BLANK[lowered], _LETTER[lowered], _MARK[lowered]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    cut = first[1:-1] | (letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])
    begins = full.copy()
    begins[1:] &= ~full[:-1] | cut
    closes = full.copy()
    closes[:-1] &= ~full[1:] | cut
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(offsets, starts, "right") - 1


class WordEncoder:
    """Encodes texts piece by piece for tokenizers that lower-case and drop white space, so equal pieces share one encoding.

    Known pieces are held by 64-bit hash and size in sorted arrays, about 30 bytes each; beyond ``kept`` pieces the memory starts anew, which
    changes speed only.
    """

    def __init__(self, path: str, kept: int = KEPT):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.kept = Tokenizer.from_file(path), kept
        special = [t for t in self.tokenizer.get_added_tokens_decoder().items() if t[1].special]
        self.divider = (special[-1][0], special[-1][1].content) if special else None
        self._clear()

    def _clear(self) -> None:
        self.keys, self.starts, self.sizes = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
        self.pool, self.used = np.zeros(1 << 16, dtype=np.int32), 0

    def _ids(self, words: list[str]) -> list[list[int]]:
        """Ids of each word; words go through the tokenizer together, parted by a special token, unless one holds such a token."""
        if self.divider is None or any("<|" in w for w in words):
            return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        number, content = self.divider
        joined = np.array(self.tokenizer.encode_batch_fast([content.join(words)], add_special_tokens=False)[0].ids, dtype=np.int32)
        parts = np.split(joined, np.flatnonzero(joined == number))
        return [p[1:] if i else p for i, p in enumerate(parts)]

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        found = [ids for i in range(0, len(words), 500) for ids in self._ids(words[i:i + 500])]
        sizes = np.fromiter(map(len, found), dtype=np.int32, count=len(found))
        total = int(sizes.sum())
        if self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool[:self.used], np.zeros(max(total, self.used), dtype=np.int32)])
        self.pool[self.used:self.used + total] = np.concatenate([np.asarray(x, dtype=np.int32) for x in found]) if total else []
        starts = self.used + np.cumsum(sizes) - sizes
        self.used += total
        at = np.searchsorted(self.keys, keys)
        self.keys, self.starts, self.sizes = np.insert(self.keys, at, keys), np.insert(self.starts, at, starts), np.insert(self.sizes, at, sizes)

    def look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Place of every piece among the known ones; new pieces are encoded first."""
        hashes = span_hashes(prefix_hashes(byte_values(LOWER[data])), starts, ends)
        keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > self.kept:
            self._clear()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        if not known.all():
            new = np.flatnonzero(~known)
            raw = data.tobytes()
            self._learn(keys[new], [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
            at = np.searchsorted(self.keys, keys)
        return at[inverse]

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Number of ids of every piece."""
        if not len(starts):
            return np.zeros(0, dtype=np.int64)
        place = self.look_up(data, starts, ends)
        return self.sizes[place].astype(np.int64)

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Flat int32 ids of all texts and the number of ids of each; null texts have none."""
        data, offsets = flat(texts)
        starts, ends, rows = pre_tokens(data, offsets)
        counts = np.zeros(len(offsets) - 1, dtype=np.int64)
        if not len(starts):
            return np.zeros(0, dtype=np.int32), counts
        place = self.look_up(data, starts, ends)
        sizes = self.sizes[place].astype(np.int64)
        return self.pool[ranges(self.starts[place], sizes)], np.bincount(rows, weights=sizes, minlength=len(counts)).astype(np.int64)
