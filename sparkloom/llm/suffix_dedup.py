"""Removal of repeated 100-byte strings by sharded run-length indexes.

Every window of `length` bytes has an anchor, the k-byte string with the smallest hash in it, so equal windows have equal
anchors at equal places. Consecutive windows with one anchor form a stretch: at most length - k + 1 windows, a few bytes
of identity each. Stretches meet by anchor. Where two stretches hold the same bytes (by a cryptographic digest, within one
anchor), the later one is a repeat as a whole.
Stretches that share an anchor and differ are collected, with their bytes, in shards; each shard builds a run-length
Burrows-Wheeler index: only at the ends of its runs are suffix positions sampled and common prefixes compared; streaming
over the text, every other position's matching length is one less than its left neighbour's. Positions whose match
reaches `length` are grouped, and all but the earliest of a group are marked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, key_runs, map_batches, utf8, written
from .shingles import mixed, powers

PLACE_BITS = 20
SEGMENT = (1 << PLACE_BITS) - 1


def stretches(raw: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, first window, last window, digest of the bytes from the first to the end of the last) of a text."""
    n = len(raw)
    empty = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    if n < length:
        return empty
    parts = []
    step = SEGMENT - length
    for base in range(0, n - length + 1, step):
        piece = raw[base : base + step + length - 1]
        up, down = powers(len(piece) + 1)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        anchors = mixed((sums[k:] - sums[:-k]) * down[: len(sums) - k])
        keyed = (anchors >> np.uint64(PLACE_BITS)) << np.uint64(PLACE_BITS)
        keyed |= np.arange(len(keyed), dtype=np.uint64)
        width, span, least = length - k + 1, 1, keyed
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        place = (least & np.uint64(SEGMENT)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.append(first[1:], len(place)) - 1
        at = place[first]
        end = last + length
        whole = piece.tobytes()
        digests = [hashlib.blake2b(whole[a:b], digest_size=8).digest() for a, b in zip(first.tolist(), end.tolist(), strict=True)]
        content = np.frombuffer(b"".join(digests), "<u8")
        parts.append((anchors[at], first + base, last + base, content))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a text of terminated strings (0 ends a string), exact to `depth` symbols or a string's
    end; what is equal up to there is in text order, as if terminators rose. Prefix doubling from packed 7-symbol words."""
    n = len(symbols)
    ended = np.flatnonzero(symbols == 0)
    left = ended[np.searchsorted(ended, np.arange(n))] - np.arange(n)  # symbols before the terminator
    padded = np.concatenate([symbols, np.zeros(7, symbols.dtype)]).astype(np.int64)
    rank = np.zeros(n, np.int64)
    for j in range(7):
        rank = rank * 512 + np.where(j < left, padded[j : j + n], 0)
    order = np.argsort(rank, kind="stable")
    reach = 7
    while True:
        ranked = rank[order]
        fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        if reach >= depth or fresh.all():
            return order
        ahead = np.where(left > reach, np.concatenate([rank, np.zeros(reach, np.int64)])[reach : reach + n], 0)
        rank = rank * (n + 1) + ahead
        order = np.argsort(rank, kind="stable")
        reach *= 2


class RunLengthIndex:
    """A run-length Burrows-Wheeler index of strings: `heads` are the text positions at the starts of the runs of its
    transform, `samples` the lengths that the suffixes there have in common with the suffixes before them in order."""

    def __init__(self, strings: list[bytes]):
        longest = max(map(len, strings))
        flat = np.frombuffer(b"".join(strings), np.uint8)
        sizes = np.array([len(s) for s in strings])
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)])
        self.text = np.zeros(self.starts[-1], np.int16)
        keep = np.ones(len(self.text), bool)
        keep[self.starts[1:] - 1] = False
        self.text[keep] = flat.astype(np.int16) + 1
        self.order = suffix_array(self.text, longest + 1)
        transform = self.text[self.order - 1]  # the symbol before each suffix; terminators all differ
        run = np.concatenate([[True], (transform[1:] != transform[:-1]) | (transform[1:] == 0)])
        at = np.flatnonzero(run)
        heads, before = self.order[at], self.order[at - 1]
        samples = self._common(heads, before)
        samples[at == 0] = 0
        by_text = np.argsort(heads)
        self.heads, self.samples = heads[by_text], samples[by_text]

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common symbols of the suffixes at a and b, up to a terminator."""
        out = np.zeros(len(a), np.int64)
        alive = np.arange(len(a))
        while len(alive):
            x, y = self.text[a[alive] + out[alive]], self.text[b[alive] + out[alive]]
            alive = alive[(x == y) & (x != 0)]
            out[alive] += 1
        return out

    def matching_statistics(self) -> np.ndarray:
        """For each text position, the length it has in common with the suffix before it in order: streamed over the
        text from the samples, falling by one a position until the next run head."""
        if not len(self.heads) or self.heads[0] != 0:
            raise AssertionError("the first position starts a run, as nothing precedes it")
        places = np.arange(len(self.text))
        last = np.searchsorted(self.heads, places, side="right") - 1
        return np.maximum(self.samples[last] - (places - self.heads[last]), 0)

    def repeats(self, length: int) -> np.ndarray:
        """Marks positions at which a string of `length` starts that also starts at an earlier position."""
        match = self.matching_statistics()[self.order]
        starts = np.flatnonzero(np.concatenate([[True], match[1:] < length]))
        earliest = np.minimum.reduceat(self.order, starts)
        repeated = np.ones(len(self.text), bool)
        repeated[earliest] = False
        return repeated


def changes(*columns: np.ndarray) -> np.ndarray:
    """Marks the rows that differ from the row before in any of the columns."""
    fresh = np.ones(len(columns[0]), bool)
    fresh[1:] = np.any([x[1:] != x[:-1] for x in columns], axis=0)
    return fresh


STRETCH = "key long, again boolean, content long, doc long, mark long, first int, more int"


def _keyed(batch: pa.RecordBatch, rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """The stretches of a batch's documents as rows; a repeat inside the batch needs no comparison any more and travels
    under a key of its own."""
    sizes = [len(r[0]) for r in rows]
    anchor, first, last, content = (np.concatenate([r[i] for r in rows]) for i in range(4))
    doc, mark = (np.repeat(batch.column(c).to_numpy(), sizes) for c in ("doc", "mark"))
    order = np.lexsort((first, mark, doc, content, anchor))
    anchor, first, last, content, doc, mark = (x[order] for x in (anchor, first, last, content, doc, mark))
    fresh = changes(anchor, content, doc, mark, first)  # rows with the same id and text are one document
    anchor, first, last, content, doc, mark = (x[fresh] for x in (anchor, first, last, content, doc, mark))
    again = np.concatenate([[False], (anchor[1:] == anchor[:-1]) & (content[1:] == content[:-1])])[: len(anchor)]
    key = np.where(again, mixed(mark.astype(np.uint64) + first.astype(np.uint64)), anchor)
    arrays = [pa.array(key.astype(np.int64)), pa.array(again), pa.array(content.astype(np.int64)), pa.array(doc), pa.array(mark), pa.array(first.astype(np.int32)), pa.array((last - first).astype(np.int32))]
    return pa.RecordBatch.from_arrays(arrays, ["key", "again", "content", "doc", "mark", "first", "more"])


def _meet(found: DataFrame) -> DataFrame:
    """(kind, key, doc, mark, first, more). kind 0: repeat as a whole; kind 1: shares its key with other bytes around it,
    to be indexed.

    Rows are sorted by Spark and pass in order; of a key, only its first and its latest row are held."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        latest = np.zeros((6, 0), np.int64)  # the latest row that was no repeat inside a batch
        alone = np.zeros((6, 0), np.int64)  # the first row of its key, as long as the key has one content
        for batch in batches:
            again = batch.column("again").to_numpy(zero_copy_only=False)
            columns = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "content", "doc", "mark", "first", "more")])
            sure, opened = columns[:, again], np.zeros((6, 0), np.int64)
            known, rows = latest.shape[1], np.hstack([latest, columns[:, ~again]])
            if rows.shape[1] > known:
                new_key, new_content = changes(rows[0]), changes(*rows[:2])
                distinct = changes(*rows[:5])
                real = np.arange(rows.shape[1]) >= known
                group = np.cumsum(new_key) - 1
                several = np.bincount(group, new_content & ~new_key) > 0
                sure = np.hstack([sure, rows[:, real & distinct & ~new_content]])
                opened = rows[:, real & new_content & several[group]]
                if known and several[0]:
                    opened, alone = np.hstack([alone, opened]), alone[:, :0]
                start = int(np.flatnonzero(new_key)[-1])
                if start >= known:
                    alone = rows[:, start : start + (0 if several[-1] else 1)]
                latest = rows[:, -1:]
            both = np.hstack([sure, opened])
            kind = np.repeat(np.array([0, 1], np.int32), [sure.shape[1], opened.shape[1]])
            arrays = [pa.array(kind), *(pa.array(both[i]) for i in (0, 2, 3)), *(pa.array(both[i].astype(np.int32)) for i in (4, 5))]
            yield pa.RecordBatch.from_arrays(arrays, ["kind", "key", "doc", "mark", "first", "more"])

    dealt = found.repartition("key").sortWithinPartitions("key", "content", "doc", "mark", "first")
    return in_arrow(dealt, meet, "kind int, key long, doc long, mark long, first int, more int")


def repeated_spans(docs: DataFrame, length: int, k: int) -> DataFrame:
    """(doc, mark, first, last): runs of windows of a document that also start earlier. doc and mark name a document: its
    id (the smallest long for null) and a hash of its text."""

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        return _keyed(batch, [stretches(np.frombuffer(t, np.uint8), length, k) for t in utf8(batch.column("text"))])

    met = written(_meet(map_batches(docs, scan, STRETCH)), "repeat-stretches")
    sure = met.where("kind = 0").select("doc", "mark", "first", (F.col("first") + F.col("more")).alias("last"))
    opened = met.where("kind = 1")
    open_ones = opened.groupBy("doc", "mark").agg(F.collect_set(F.struct("key", "first", "more")).alias("open"))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, mark, text, open_here in zip(batch.column("doc").to_pylist(), batch.column("mark").to_pylist(), utf8(batch.column("text")), batch.column("open").to_pylist(), strict=True):
            rows.extend((x["key"], doc, mark, x["first"], text[x["first"] : x["first"] + x["more"] + length]) for x in open_here)
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["key", "doc", "mark", "first", "bytes"])

    texts = map_batches(docs.join(open_ones, ["doc", "mark"]), cut, "key long, doc long, mark long, first int, bytes binary")
    sharded = texts.repartition("key").sortWithinPartitions("key", "doc", "mark", "first")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in key_runs(batches, ["key"]):
            doc, mark, first = (whole.column(c).to_numpy() for c in ("doc", "mark", "first"))
            order = np.lexsort((first, mark, doc))  # text order of the index is document order
            fresh = np.concatenate([[True], (np.diff(doc[order]) != 0) | (np.diff(mark[order]) != 0) | (np.diff(first[order]) != 0)])
            order = order[fresh]  # rows with the same id and text are one document
            strings = [whole.column("bytes")[int(i)].as_py() for i in order]
            index = RunLengthIndex(strings)
            repeated = index.repeats(length)
            out = []
            for i, at, string in zip(order.tolist(), index.starts.tolist(), strings, strict=False):
                flags = np.concatenate([[False], repeated[at : at + len(string) - length + 1], [False]])
                edges = np.flatnonzero(flags[1:] != flags[:-1])
                out.extend((doc[i], mark[i], first[i] + a, first[i] + b - 1) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64), t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.int32(), pa.int32()], strict=True)], ["doc", "mark", "first", "last"])

    return sure.union(in_arrow(sharded, search, "doc long, mark long, first int, last int"))


def remove_repeats(docs: DataFrame, length: int = 100, k: int = 32, keep_text: bool = False) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (and kept, bytes).

    A byte goes if a string of `length` bytes that covers it also starts earlier: in a document with a smaller doc_id or
    further left in the same one, judged on the input. A null or empty text has no bytes. A null doc_id counts as the
    smallest. Rows that share a doc_id are ordered by a hash of their text; equal rows are one document and get one result
    each. Matches are of bytes and never cross documents. Other columns are not read. No rows give no rows; very long texts
    are read in pieces of 2^20 bytes that overlap.
    """
    keyed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    keyed = keyed.withColumn("doc", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("mark", F.xxhash64("text"))
    spans = repeated_spans(keyed.select("doc", "mark", "text"), length, k)
    gathered = spans.groupBy("doc", "mark").agg(F.collect_list(F.struct("first", "last")).alias("found"))
    joined = keyed.select("doc", "mark", "text").join(gathered, ["doc", "mark"], "left")

    def remove(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text, found in zip(utf8(batch.column("text")), batch.column("found").to_pylist(), strict=True):
            spans = []
            for a, b in sorted((x["first"], x["last"] + length) for x in found or ()):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            kept, at = [], 0
            for a, b in spans:
                kept.append(text[at:a])
                at = b
            kept = b"".join([*kept, text[at:]])
            rows.append((len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [x for s in spans for x in s], kept if keep_text else None))
        columns = list(zip(*rows, strict=True))
        doc = batch.column("doc").to_numpy()
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
        arrays = [pa.array(doc, mask=doc == -(1 << 63)), *(pa.array(columns[i], pa.int64()) for i in range(3)), pa.array(columns[3], pa.string()), pa.array(columns[4], pa.list_(pa.int64()))]
        if keep_text:
            names, arrays = [*names, "kept"], [*arrays, pa.array(columns[5], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>" + (", kept binary" if keep_text else "")
    return map_batches(joined, remove, schema)
