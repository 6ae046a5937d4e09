"""Word shingles of whole texts as 64-bit hashes: a digest a word, mixed over each run of words."""

from __future__ import annotations

import hashlib

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i < n, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for name, factor in (("up", BASE), ("down", INVERSE)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


class WordHashes(dict):
    """word -> 8 bytes of its BLAKE2b digest; emptied when it holds `most` words, long words are not kept."""

    def __init__(self, most: int = 50_000, longest: int = 64):
        super().__init__()
        self.most, self.longest = most, longest

    def __missing__(self, word: bytes) -> bytes:
        found = hashlib.blake2b(word, digest_size=8).digest()
        if len(word) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[word] = found
        return found


_words = WordHashes()


def word_hashes(lowered: bytes) -> np.ndarray:
    """One hash per run of bytes other than ASCII white space."""
    return np.frombuffer(b"".join(map(_words.__getitem__, lowered.split())), "<u8")


def set_print(elements: np.ndarray) -> tuple[int, int]:
    """Two sums over the elements of a set, 128 bits that tell sets apart."""
    sums = (mixed(elements).sum(keepdims=True), mixed(elements ^ np.uint64(0x9E3779B97F4A7C15)).sum(keepdims=True))
    return tuple(int(mixed(x + np.uint64(len(elements))).astype(np.int64)[0]) for x in sums)


def shingle_set(text: bytes, n: int) -> np.ndarray:
    """Distinct n-word shingles (A-Z in lower case), sorted; a shorter text's words are one shingle, no words give none."""
    words = word_hashes(text.lower())
    if not len(words):
        return words
    width = min(n, len(words))
    count = len(words) - width + 1
    out = np.full(count, np.uint64(width), np.uint64)
    for k in range(width):
        out = mixed(out * np.uint64(3) + words[k : k + count])
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]
