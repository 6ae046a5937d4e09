"""BPE encoding and decoding as streaming transducers.

The encoder reads a text slice by slice and gives out a token as soon as nothing that may follow can change it. White
space always ends a word, and merges never cross words, so what stands before the last white space is stable. Inside one
very long word the merge list bounds how far the right-hand side can reach: a merge (u, v) can be undone from the right
only by an earlier merge (v, w), that one by a still earlier merge (w, x), and so on. The longest such chain times the
longest token is the lookahead; tokens that end at least that far before the end of what is read are given out, the rest
is kept. A slice's last character waits for the next one, as a mark may be composed with it, and so does the beginning of
a special string. Memory is the slice and the lookahead, whatever the length of the text.

The decoder is a state machine over ids: it holds at most the bytes of one unfinished character.
"""

from __future__ import annotations

import codecs
import hashlib
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches
from .tokenizer import MARK, WordBpe, byte_alphabet, load

def _joining() -> frozenset[str]:
    """Characters that normalisation may compose with what stands before them: no slice may begin with one."""
    seconds = {chr(p) for p in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    for point in range(0xC0, 0x110000):
        parts = unicodedata.decomposition(chr(point)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            seconds.add(chr(int(parts[1], 16)))
    return frozenset(seconds)


JOINING = _joining()


class StreamEncoder:
    """feed(slice) gives the ids that became stable, finish() the rest; together the ids of the whole text."""

    def __init__(self, bpe: WordBpe):
        self.bpe = bpe
        self.held = ""  # read; may be composed with, or be the beginning of a special string
        self.tail = ""  # behind the last white space; may still change
        self.word, self.kind = b"", ""  # bytes of a very long open word, and a character of its kind (letter or symbol)

    def feed(self, text: str) -> np.ndarray:
        text = self.held + text
        stop = max(0, len(text) - 1)
        while stop > 0 and (text[stop] in JOINING or unicodedata.combining(text[stop])):
            stop -= 1
        begun = (stop - n for x in self.bpe.special_ids for n in range(1, len(x)) if text.endswith(x[:n], 0, stop))
        stop = min(begun, default=stop)
        self.held = text[stop:]
        return self._taken(text[:stop])

    def finish(self) -> np.ndarray:
        text, self.held = self.held, ""
        return np.concatenate([self._taken(text), self._ended()])

    def _taken(self, text: str) -> np.ndarray:
        out, at = [np.zeros(0, np.uint32)], 0
        for found in self.bpe.special.finditer(text):
            out += [self._plain(text[at : found.start()]), self._ended(), np.array([self.bpe.special_ids[found[0]]], np.uint32)]
            at = found.end()
        return np.concatenate([*out, self._plain(text[at:])])

    def _plain(self, text: str) -> np.ndarray:
        """A further stretch without special strings: white space ends words, so what stands before the last one is stable."""
        out = [np.zeros(0, np.uint32)]
        if self.kind and text:
            text = self._grown(text, out)
        self.tail += text
        cut = max(self.tail.rfind(" "), self.tail.rfind("\n"), self.tail.rfind("\t"))
        if cut > 0:
            out.append(self.bpe.word_ids(self.bpe.normal_words(self.tail[:cut])[1]))
            self.tail = self.tail[cut:]
        if len(self.tail) > 4 * self.bpe.lookahead:
            self._opened(out)
        return np.concatenate(out)

    def _opened(self, out: list[np.ndarray]) -> None:
        """A long stretch without white space: give out its ended words, and a long last word as far as it is stable."""
        normal, words = self.bpe.normal_words(self.tail)
        if words and normal.endswith(words[-1]) and len(words[-1]) > 2 * self.bpe.lookahead:
            out.append(self.bpe.word_ids(words[:-1]))
            self.kind = "a" if len(self.bpe.normal_words("a" + words[-1])[1]) == 1 else "-"
            self.tail = ""
            self._grown(words[-1], out)
        elif len(words) > 3:  # an apostrophe and up to two letters may still become one word
            out.append(self.bpe.word_ids(words[:-3]))
            at = len(normal)
            for word in reversed(words[-3:]):
                at = normal.rindex(word, 0, at)
            self.tail = normal[at:]

    def _grown(self, text: str, out: list[np.ndarray]) -> str:
        """Add to the open word what continues it, and return what stands behind it."""
        normal, words = self.bpe.normal_words(self.kind + text)
        self.word += words[0][1:].encode()
        if len(words[0]) < len(normal):
            out.append(self._ended())
            return normal[len(words[0]) :]
        if len(self.word) > 4 * self.bpe.lookahead and MARK.encode() not in self.word:
            ids, ends = self.bpe.piece(self.word)
            stable = int(np.searchsorted(ends, len(self.word) - self.bpe.lookahead, side="right"))
            out.append(ids[:stable])
            self.word = self.word[int(ends[stable - 1]) if stable else 0 :]
        return ""

    def _ended(self) -> np.ndarray:
        """Ids of all that is open, as at the end of a text."""
        word, kind, self.word, self.kind = self.word, self.kind, b"", ""
        tail, self.tail = self.tail, ""
        if not kind:
            return self.bpe.word_ids(self.bpe.normal_words(tail)[1])
        if MARK.encode() in word:
            return np.array(self.bpe.library.encode(word.decode(), add_special_tokens=False).ids, np.uint32)
        return self.bpe.piece(word + MARK.encode())[0]


def slices(text: str, size: int) -> Iterator[str]:
    for at in range(0, len(text), size):
        yield text[at : at + size]


def encode(bpe: WordBpe, text: str, size: int = 1 << 16) -> np.ndarray:
    """Ids of a text, read in slices by the streaming encoder, whatever its length and characters."""
    stream = StreamEncoder(bpe)
    return np.concatenate([*map(stream.feed, slices(text, size)), stream.finish()])


class StreamDecoder:
    """Ids to text, incrementally.

    as_tokens: as the library decodes a file that names no decoder, token strings with a blank between them.
    Otherwise the bytes of the tokens go through a UTF-8 state machine and a word's end becomes a blank.
    """

    def __init__(self, bpe: WordBpe, as_tokens: bool = True):
        self.as_tokens, self.started = as_tokens, False
        key = "decoding" if as_tokens else "decoding_bytes"
        if not hasattr(bpe, key):
            setattr(bpe, key, self._table(bpe))
        self.table = getattr(bpe, key)
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def _table(self, bpe: WordBpe) -> list[bytes]:
        alphabet = byte_alphabet()
        size = max(bpe.tokens) + 1
        if self.as_tokens:
            return [bpe.tokens.get(i, "").encode() for i in range(size)]
        out = []
        for i in range(size):
            token = bpe.tokens.get(i, "")
            stem = token.removesuffix("</w>")
            out.append(bytes(alphabet[c] for c in stem if c in alphabet) + (b" " if stem != token else b""))
        return out

    def feed(self, ids: np.ndarray) -> str:
        if self.as_tokens:
            text = (b" " if self.started and len(ids) else b"") + b" ".join(map(self.table.__getitem__, ids.tolist()))
            self.started |= len(ids) > 0
            return self.utf8.decode(text)
        return self.utf8.decode(b"".join(map(self.table.__getitem__, ids.tolist())))

    def finish(self) -> str:
        return self.utf8.decode(b"", final=True)


def decode_parts(bpe: WordBpe, ids: np.ndarray, as_tokens: bool = True, size: int = 1 << 16) -> Iterable[str]:
    decoder = StreamDecoder(bpe, as_tokens)
    for at in range(0, len(ids), size):
        yield decoder.feed(ids[at : at + size])
    yield decoder.finish()


def encode_documents(docs: DataFrame, path: str, keep_ids: bool = False, keep_text: bool = False) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded if asked).

    A null or empty text has no tokens and decodes to the empty text. Repeated rows give repeated rows, a null doc_id
    stays null, other columns are not read. No rows give no rows. A text of any length is read in slices; what is held beyond
    a slice is the open word.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(WordBpe, path)
        rows = []
        for text in batch.column("text").to_pylist():
            ids = encode(bpe, text or "")
            digest, kept = hashlib.sha256(), []
            for part in decode_parts(bpe, ids):
                digest.update(part.encode())
                if keep_text:
                    kept.append(part)
            raw = ids.astype("<u4").tobytes()
            rows.append((len(ids), hashlib.sha256(raw).hexdigest(), digest.hexdigest(), ids if keep_ids else None, "".join(kept) if keep_text else None))
        columns = list(zip(*rows, strict=True))
        arrays = [batch.column("doc_id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if keep_ids:
            offsets = np.concatenate([[0], np.cumsum(columns[0])]).astype(np.int32)
            flat = pa.array(np.concatenate(columns[3]).astype(np.int32))
            arrays, names = [*arrays, pa.ListArray.from_arrays(pa.array(offsets), flat)], [*names, "ids"]
        if keep_text:
            arrays, names = [*arrays, pa.array(columns[4], pa.string())], [*names, "decoded"]
        return pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "") + (", decoded string" if keep_text else "")
    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), work, schema)
