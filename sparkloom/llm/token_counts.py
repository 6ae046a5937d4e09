"""Token counts of texts of any length by overlap resynchronisation.

A long text is encoded in chunks that overlap. Two neighbouring chunks are spliced at a common boundary: an offset
inside the overlap at which a token ends in both encodings and that is proven stable, i.e. no encoding of any text that
holds these characters can have a token across it. For byte-level BPE the pre-tokenizer always starts a new piece,
whatever stands further left or right, before white space that follows something else, between a letter and a digit,
after a letter or digit that a symbol follows, and after a symbol other than an apostrophe that a letter or digit follows;
and merges never cross pieces; an offset inside a special string is not taken. When an overlap holds no such boundary it is doubled
until it does, or until the chunk reaches the end of the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches
from .tokenizer import ByteBpe, load

STABLE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])")


def spliced(bpe: ByteBpe, text: str, chunk: int, overlap: int) -> np.ndarray:
    """Ids of text, encoded in overlapping chunks of about chunk characters; the same ids as in one piece."""
    parts: list[np.ndarray] = []
    start, stop = 0, min(chunk, len(text))
    ids, ends = bpe.encode_with_ends(text[start:stop])
    while stop < len(text):  # a stretch without a boundary doubles, so its encodings add up to a few times its length
        width = min(overlap, stop - start)
        cut = None
        while cut is None:
            low = stop - width
            right_stop = min(len(text), stop + max(chunk, stop - start))
            right_ids, right_ends = bpe.encode_with_ends(text[low:right_stop])
            # The last character of either side may depend on what follows it.
            for found in STABLE.finditer(text, low + 1, stop - 1):
                at = found.start()
                if _ends_at(ends, at - start) and _ends_at(right_ends, at - low) and not bpe.in_special(text, at):
                    cut = at
            if cut is None:
                if width >= stop - start:  # the whole left chunk holds no boundary: take the two as one chunk
                    stop = right_stop
                    ids, ends = bpe.encode_with_ends(text[start:stop])
                    break
                width = min(2 * width, stop - start)
        if cut is not None:
            parts.append(ids[: np.searchsorted(ends, cut - start, side="right")])
            first = np.searchsorted(right_ends, cut - low, side="right")
            ids, ends, start, stop = right_ids[first:], right_ends[first:] - (cut - low), cut, right_stop
    return np.concatenate([*parts, ids]) if parts else ids


def _ends_at(ends: np.ndarray, offset: int) -> bool:
    i = np.searchsorted(ends, offset)
    return i < len(ends) and ends[i] == offset


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, chunk: int = 1 << 16, overlap: int = 1 << 10) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_bytes, n_tokens, over_limit, n_chunked.

    A null or empty text counts as no bytes and no tokens. Repeated rows give repeated rows; a null doc_id stays null.
    Other columns are not read. No rows give no rows. n_chunked is true where the text was long enough to be cut in chunks;
    a task holds one text, its ids, and the pieces of the longest stretch without a stable edge in it (letters, digits or
    signs of one kind without end), which is encoded in doubling pieces, so memory goes with that stretch.
    """

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(ByteBpe, path)
        texts = [x or "" for x in batch.column("text").to_pylist()]
        tokens = [len(spliced(bpe, t, chunk, overlap)) if len(t) > chunk else len(bpe.encode(t)) for t in texts]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(t) if t.isascii() else len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens]), pa.array([len(t) > chunk for t in texts])],
            ["doc_id", "n_bytes", "n_tokens", "over_limit", "n_chunked"],
        )

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_batches(docs, count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_chunked boolean")
