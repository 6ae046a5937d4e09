"""Loading a public tokenizer file, with a compiled merge engine that is tested to give the library's ids.

The library's full pipeline keeps alignments that no operator here needs and is several times slower than a plain merge
engine. The engine is built from the same file (vocabulary and merge list). Its normalising and splitting are used only
for texts made of characters on which it agreed with the library in several surroundings: a test, not a proof. Byte-level
texts with other characters, or with a special string, go to the library itself; the word-end encoder asks the library to
normalise and split those texts and merges their words itself.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import tiktoken
from tokenizers import Tokenizer

BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MARK = "\x01"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in characters of byte-level vocabularies: printable Latin-1 bytes stand for themselves."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _library(path: str) -> Tokenizer:
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return library


class Tested:
    """Which characters the engine may be used for: those on which it agreed with the library in several surroundings. The
    first ones are tried at load, others when they are first seen."""

    def _try_all(self, low: int = 0x250) -> None:
        good = [chr(p) for p in range(low) if self._agrees(chr(p))]
        self.good, self.bad = set(good), set()
        self.unusual = re.compile(f"[^{''.join(map(re.escape, good))}]")

    def _agrees(self, c: str) -> bool:
        return c != MARK and not 0xD800 <= ord(c) < 0xE000 and all(self.same(x) for x in (c, f"a{c}b", f"1{c}2", f"a {c} b", f" {c}{c}a", f"a{c} {c}1", f".{c}.", f"\n{c}\n", f"'{c}s", f"aé{c}E{c}"))

    def safe(self, text: str) -> bool:
        """Whether all characters are tested ones, and no special string is among them."""
        if self.unusual.search(text) is not None:
            for c in set(text) - self.good:
                if c not in self.bad:
                    (self.good if self._agrees(c) else self.bad).add(c)
                if c in self.bad:
                    return False
        return "<" not in text or self.special.search(text) is None

    def in_special(self, text: str, at: int, reach: int = 32) -> bool:
        """Whether a special string stands across an offset."""
        return any(m.start() < at < m.end() for m in self.special.finditer(text, max(0, at - reach), at + reach))


class ByteBpe(Tested):
    """Byte-level BPE: ids of whole texts as the tokenizers library gives them without added special tokens."""

    def __init__(self, path: str):
        self.library = _library(path)
        spec = json.loads(open(path, encoding="utf-8").read())
        alphabet = byte_alphabet()
        special = {x["content"] for x in spec["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.sizes[i] = len(token)
        self.engine = tiktoken.Encoding("byte", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)")
        self._try_all()

    def same(self, text: str) -> bool:
        return self._fast(text).tolist() == self.library.encode(text, add_special_tokens=False).ids

    def _fast(self, text: str) -> np.ndarray:
        return self.engine.encode_to_numpy(text, disallowed_special=())

    def encode(self, text: str) -> np.ndarray:
        """Ids as unsigned 32-bit integers."""
        if self.safe(text):
            return self._fast(text)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode_with_ends(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and for each the offset in code points at which it ends."""
        if self.safe(text):
            ids = self._fast(text)
            ends = np.cumsum(self.sizes[ids])
            if not text.isascii():
                starts = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
                ends = np.cumsum(starts)[ends - 1] if len(ends) else ends
            return ids, ends
        got = self.library.encode(text, add_special_tokens=False)
        return np.array(got.ids, np.uint32), np.array([b for _, b in got.offsets], np.int64)


class WordBpe(Tested):
    """The parts of a word-end BPE file that the streaming encoder and decoder need."""

    def __init__(self, path: str):
        self.library = _library(path)
        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        vocab, alphabet, end = model["vocab"], byte_alphabet(), model["end_of_word_suffix"]
        special = {x["content"] for x in spec["added_tokens"]}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]

        def as_bytes(token: str) -> bytes:
            stem = token.removesuffix(end)
            return bytes(alphabet[c] for c in stem) + (MARK.encode() if stem != token else b"")

        # Merge order is what the engine calls rank; a byte and the mark behind the last byte of a word join first.
        rank_to_id: list[int] = []
        ranks: dict[bytes, int] = {}

        def add(token: bytes, i: int) -> None:
            if token not in ranks:
                ranks[token] = len(rank_to_id)
                rank_to_id.append(i)

        for b in range(256):
            c = next(k for k, v in alphabet.items() if v == b)
            add(bytes([b]), vocab.get(c, 0))
        for b in range(256):
            c = next(k for k, v in alphabet.items() if v == b)
            if b != ord(MARK):
                add(bytes([b]) + MARK.encode(), vocab.get(c + end, 0))
        for left, right in merges:
            add(as_bytes(left + right), vocab[left + right])
        self.longest = max(map(len, ranks))
        self.lookahead = sufficient_lookahead([(as_bytes(a), as_bytes(b)) for a, b in merges], self.longest)
        self.ids = np.array(rank_to_id, np.uint32)
        self.tokens = {i: t for t, i in vocab.items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.engine = tiktoken.Encoding("word", pat_str=f"[^{MARK}]*{MARK}", mergeable_ranks=ranks, special_tokens={})
        self.words = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
        self.alphabet, self.special_ids = alphabet, {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)")
        self._try_all()

    def same(self, text: str) -> bool:
        fast = self.words.findall(unicodedata.normalize("NFC", text).lower())
        return self.word_ids(fast).tolist() == self.library.encode(text, add_special_tokens=False).ids

    def normal_words(self, text: str) -> tuple[str, list[str]]:
        """The text as normalised, and its words. The library's own normaliser and splitter are asked where a character
        is not tested. text holds no special string."""
        if self.safe(text):
            normal = unicodedata.normalize("NFC", text).lower()
            return normal, self.words.findall(normal)
        normal = self.library.normalizer.normalize_str(text)
        found = self.library.pre_tokenizer.pre_tokenize_str(normal)
        return normal, [bytes(self.alphabet[c] for c in word).decode() for word, _ in found]

    def word_ids(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0, np.uint32)
        joined = MARK.join(words) + MARK
        if joined.count(MARK) > len(words):  # a word that holds the mark itself is one for the library
            return np.concatenate([self.ids[self.engine.encode_to_numpy(w + MARK)] if MARK not in w else np.array(self.library.encode(w, add_special_tokens=False).ids, np.uint32) for w in words])
        return self.ids[self.engine.encode_to_numpy(joined, disallowed_special=())]

    def piece(self, word: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Of the beginning of a word (or a whole one, with the mark): ids, and where they end in bytes."""
        ranks = np.array(self.engine._core_bpe.encode_single_piece(word), np.int64)
        return self.ids[ranks], np.cumsum([len(self.engine.decode_single_token_bytes(i)) for i in ranks.tolist()])


def sufficient_lookahead(merges: list[tuple[bytes, bytes]], longest_token: int) -> int:
    """Bytes to the right of a token that decide whether it stays, from the merge list alone."""
    by_left: dict[bytes, int] = {}
    longest = 0
    for left, right in merges:  # in order of priority: chains only lead to earlier merges
        length = 1 + by_left.get(right, 0)
        by_left[left] = max(by_left.get(left, 0), length)
        longest = max(longest, length)
    return (longest + 1) * longest_token


_loaded: dict[tuple[type, str], object] = {}


def load(kind: type, path: str):
    """One tokenizer a worker process, built at its first batch."""
    if (kind, path) not in _loaded:
        _loaded[kind, path] = kind(path)
    return _loaded[kind, path]
