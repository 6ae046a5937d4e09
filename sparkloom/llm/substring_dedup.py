"""Removal of long word sequences that occur more than once: seeds from winnowing, extended both ways.

Every window of `length` words has an anchor, the run of k words with the smallest hash in it (the leftmost of equals), so
equal windows have equal anchors at equal places: the anchors are winnowed seeds. Consecutive windows with one anchor form
a stretch: the anchor with the words to its left and right that such windows can reach. Documents are joined on anchors:

1. Stretches meet by anchor. Equal ones (by 128 bits, pre-summed in the task) repeat as a whole and need no extension.
2. Different stretches of one anchor are extended. For each number of words to the left, those with the same left words
   are put in order of their right words; a stretch's longest match to the right is then with a neighbour, so all maximal
   matches of a group are found by sorting, without its pairs. Matches of `length` words and more are kept.
3. Anchors with very many occurrences (found on a sample of the documents, which only decides on this way) are spread by
   content in step 1. Their different stretches, and those of any anchor with over GROUP of them, are cut into windows that
   meet by digest, pre-summed like any count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import in_arrow, key_runs, map_batches, utf8, written
from .shingles import mixed, powers

PLACE_BITS = 20
SEGMENT = (1 << PLACE_BITS) - 1
LANES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
SAMPLE_ONE_IN, CROWD = 32, 64  # an anchor is spread from so many sampled occurrences on, or more than 1 in 2^16 of all
GROUP = 512  # contents of an anchor that are extended together
SALTS = 32  # parts that the occurrences of a window are dealt to, as one may be in very many documents
NO_ID = -(1 << 63)


class Digests(dict):
    """word -> 16 bytes of its BLAKE2b digest; emptied when it holds `most` words, long words are not kept."""

    def __init__(self, most: int = 100_000, longest: int = 64):
        super().__init__()
        self.most, self.longest = most, longest

    def __missing__(self, word: bytes) -> bytes:
        found = hashlib.blake2b(word, digest_size=16).digest()
        if len(word) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[word] = found
        return found


_digests = Digests()


def word_lanes(text: bytes) -> np.ndarray:
    """(words, 2): 128 bits of each run of bytes other than ASCII white space."""
    return np.frombuffer(b"".join(map(_digests.__getitem__, text.split())), "<u8").reshape(-1, 2)


class RunHashes:
    """Hashes of runs of words, from prefix sums of both lanes."""

    def __init__(self, words: np.ndarray):
        up, self.down = powers(len(words) + 1)
        self.sums = np.zeros((2, len(words) + 1), np.uint64)
        for lane in (0, 1):
            np.cumsum(mixed(words[:, lane] ^ LANES[lane]) * up[:-1], out=self.sums[lane, 1:])

    def of(self, first: np.ndarray, end: np.ndarray, lane: int) -> np.ndarray:
        return mixed((self.sums[lane, end] - self.sums[lane, first]) * self.down[first] + (end - first).astype(np.uint64))


def seeds(words: np.ndarray, length: int, k: int) -> np.ndarray:
    """(anchor, content, check, first, more, left) as rows of one array: for each stretch the hash of its anchor, two
    hashes of its words, its first window, the number of further windows, and the words before the anchor."""
    parts = []
    step = SEGMENT - length
    for base in range(0, len(words) - length + 1, step):
        piece = words[base : base + step + length - 1]
        runs = RunHashes(piece)
        starts = np.arange(len(piece) - k + 1)
        anchors = runs.of(starts, starts + k, 0)
        least = (anchors >> np.uint64(PLACE_BITS)) << np.uint64(PLACE_BITS) | starts.astype(np.uint64)
        width, span = length - k + 1, 1
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        place = (least & np.uint64(SEGMENT)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.append(first[1:], len(place)) - 1
        at = place[first]
        # an anchor's place in its stretch is part of what is equal
        content, check = (runs.of(first, last + length, lane) + mixed((at - first).astype(np.uint64)) for lane in (0, 1))
        parts.append(np.stack([anchors[at].view(np.int64), content.view(np.int64), check.view(np.int64), first + base, last - first, at - first]))
    return np.hstack(parts) if parts else np.zeros((6, 0), np.int64)


STRETCH = "key long, content long, check long, doc long, mark long, first int, more int, left int, times int"
NAMES = [c.split()[0] for c in STRETCH.split(", ")]


def stretches(docs: DataFrame, length: int, k: int) -> DataFrame:
    """Stretches of docs(doc, mark, text). Of equal stretches in a batch the first travels with `times`, their number; the
    others, known as repeats, under keys of their own with times 0."""

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [seeds(word_lanes(t), length, k) for t in utf8(batch.column("text"))]
        sizes = [r.shape[1] for r in rows]
        doc, mark = (np.repeat(batch.column(c).to_numpy(), sizes) for c in ("doc", "mark"))
        key, content, check, first, more, left = np.hstack(rows)
        order = np.lexsort((check, content, key))
        key, content, check, first, more, left, doc, mark = (x[order] for x in (key, content, check, first, more, left, doc, mark))
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1]) | (check[1:] != check[:-1])
        starts = np.flatnonzero(fresh)
        times = np.zeros(len(key), np.int32)
        times[starts] = np.diff(np.append(starts, len(key)))
        key = np.where(fresh, key, mixed((mark ^ first).view(np.uint64)).view(np.int64))
        arrays = [key, content, check, doc, mark, first.astype(np.int32), more.astype(np.int32), left.astype(np.int32), times]
        return pa.RecordBatch.from_arrays(list(map(pa.array, arrays)), NAMES)

    return map_batches(docs, scan, STRETCH)


def crowded_anchors(docs: DataFrame, length: int, k: int) -> DataFrame:
    """(key): anchors that occur very often in a sample of the documents; at most 2^16 of them."""
    sample = docs.where(F.pmod(F.xxhash64("doc", "mark"), F.lit(SAMPLE_ONE_IN)) == 0)
    found = stretches(sample, length, k).where("times > 0").groupBy("key").agg(F.sum("times").alias("n"))
    found = written(found.where(F.col("n") >= CROWD), "crowded-anchors")
    total = found.agg(F.sum("n")).first()[0] or 0
    return found.where(F.col("n") >= max(CROWD, total >> 16)).select("key", F.lit(True).alias("crowd"))


def met(found: DataFrame, crowded: DataFrame) -> DataFrame:
    """(kind, key, doc, mark, first, more, left). kind 0: a stretch that repeats as a whole; of the others and one each of
    these, where an anchor has different ones, kind 1: to be extended, kind 2: to be cut into windows."""
    dealt = found.join(F.broadcast(crowded), "key", "left").withColumn("crowd", F.col("crowd").isNotNull())
    dealt = dealt.withColumn("deal", F.when(F.col("crowd"), F.col("content")).otherwise(F.lit(0)))
    dealt = dealt.repartition("key", "deal")
    content = Window.partitionBy("key", "deal", "content", "check")
    counted = dealt.withColumn("nth", F.row_number().over(content.orderBy("doc", "mark", "first"))).withColumn("same", F.sum("times").over(content))
    counted = counted.withColumn("contents", F.sum((F.col("nth") == 1).cast("int")).over(Window.partitionBy("key", "deal")))
    many = F.col("crowd") | (F.col("contents") > GROUP)
    head = (F.col("nth") == 1) & (F.col("times") > 0)
    kinds = F.array_compact(F.array(F.when((F.col("times") == 0) | (F.col("same") > 1), 0), F.when(head & ~many & (F.col("contents") > 1), 1), F.when(head & many, 2)))
    return counted.select(F.explode(kinds).alias("kind"), "key", "doc", "mark", "first", "more", "left")


def numbered(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Words of several texts as numbers, equal for equal words, one after the other; and where each text begins."""
    numbers: dict[bytes, int] = {}
    flat = np.fromiter((numbers.setdefault(w, len(numbers)) for text in words for w in text), np.int64)
    return flat, np.concatenate([[0], np.cumsum([len(t) for t in words])])


def extended(group: np.ndarray, words: list[list[bytes]], more: np.ndarray, left: np.ndarray, length: int, k: int) -> np.ndarray:
    """(stretch, window) flags: windows of a stretch whose words some other stretch of its group has around the anchor.

    Seeds are extended to the left word by word; for each reach, stretches with the same left words are sorted by their
    right words, so the longest match to the right is with a neighbour in that order."""
    n, reach = len(words), length - k
    flat, begin = numbered(words)
    place = begin[:-1] + left
    steps = np.arange(reach)
    before, after = place[:, None] - 1 - steps, place[:, None] + k + steps
    alone = -1 - np.arange(n)[:, None]  # no word there: equal to nothing else
    lefts = np.where(before >= begin[:-1, None], flat[np.maximum(before, 0)], alone)
    rights = np.where(after < begin[1:, None], flat[np.minimum(after, len(flat) - 1)], alone)
    flags = np.zeros((n, reach + 1), bool)
    order_of = np.empty(n, np.int64)
    order_of[np.lexsort((*rights.T[::-1], group))] = np.arange(n)
    same = np.unique(group, return_inverse=True)[1]
    for s in range(reach + 1):
        if s:
            _, same = np.unique(np.stack([same, lefts[:, s - 1]]), axis=1, return_inverse=True)
            same = same.ravel()
        rows = np.flatnonzero((left >= s) & (left - s <= more))
        rows = rows[np.lexsort((order_of[rows], same[rows]))]
        a, b = rows[:-1], rows[1:]
        equal = same[a] == same[b]
        a, b = a[equal], b[equal]
        hit = (rights[a, : reach - s] == rights[b, : reach - s]).all(axis=1)
        for x in (a[hit], b[hit]):
            flags[x, left[x] - s] = True
    return flags


SPAN = "doc long, mark long, first int, last int"


def repeated_spans(docs: DataFrame, length: int, k: int) -> DataFrame:
    """(doc, mark, first, last): runs of windows of docs(doc, mark, text) that also start elsewhere."""
    found = written(met(stretches(docs, length, k), crowded_anchors(docs, length, k)), "repeat-seeds")
    sure = found.where("kind = 0").select("doc", "mark", "first", (F.col("first") + F.col("more")).alias("last"))
    asked = found.where("kind > 0").groupBy("doc", "mark").agg(F.collect_set(F.struct("kind", "key", "first", "more", "left")).alias("asked"))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, mark, text, here in zip(batch.column("doc").to_pylist(), batch.column("mark").to_pylist(), utf8(batch.column("text")), batch.column("asked").to_pylist(), strict=True):
            words = text.split()
            rows.extend((x["kind"], x["key"], doc, mark, x["first"], x["more"], x["left"], b" ".join(words[x["first"] : x["first"] + x["more"] + length])) for x in here)
        columns = list(zip(*rows, strict=True)) or [()] * 8
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["kind", "key", "doc", "mark", "first", "more", "left", "words"])

    texts = written(map_batches(docs.join(asked, ["doc", "mark"]), cut, "kind int, key long, doc long, mark long, first int, more int, left int, words binary"), "repeat-words")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in key_runs(batches, ["key"]):
            doc, mark, first, more, left = (whole.column(c).to_numpy() for c in ("doc", "mark", "first", "more", "left"))
            flags = extended(whole.column("key").to_numpy(), [w.split(b" ") for w in whole.column("words").to_pylist()], more, left, length, k)
            edged = np.zeros((len(flags), flags.shape[1] + 2), bool)
            edged[:, 1:-1] = flags
            row, at = np.nonzero(edged[:, 1:] != edged[:, :-1])  # a run's start and end follow each other
            row, start, end = row[::2], at[::2], at[1::2]
            arrays = [doc[row], mark[row], (first[row] + start).astype(np.int32), (first[row] + end - 1).astype(np.int32)]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, arrays)), ["doc", "mark", "first", "last"])

    groups = texts.where("kind = 1").repartition("key").sortWithinPartitions("key", "doc", "mark", "first")
    matched = in_arrow(groups, extend, SPAN)

    def windows(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [np.zeros((5, 0), np.int64)]
        for doc, mark, first, more, words in zip(*(batch.column(c).to_pylist() for c in ("doc", "mark", "first", "more", "words")), strict=True):
            runs, at = RunHashes(word_lanes(words)), np.arange(more + 1)
            parts.append(np.stack([*(runs.of(at, at + length, lane).view(np.int64) for lane in (0, 1)), np.full(more + 1, doc), np.full(more + 1, mark), first + at]))
        one, two, doc, mark, at = np.hstack(parts)
        return pa.RecordBatch.from_arrays([*map(pa.array, (one, two, doc, mark)), pa.array(at.astype(np.int32))], ["one", "two", "doc", "mark", "first"])

    cuts = written(map_batches(texts.where("kind = 2"), windows, "one long, two long, doc long, mark long, first int"), "repeat-windows")
    often = cuts.groupBy("one", "two").agg(F.count("*").alias("n")).where("n > 1")
    often = often.select("one", "two", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = cuts.withColumn("salt", F.pmod(F.xxhash64("doc", "mark", "first"), F.lit(SALTS)).cast("int"))
    seen = salted.join(often, ["one", "two", "salt"]).select("doc", "mark", "first", F.col("first").alias("last"))
    return sure.union(matched).union(seen)


def remove_repeats(docs: DataFrame, length: int = 35, k: int = 16, keep_text: bool = False) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_words, n_removed, kept_sha256, spans (and kept, bytes).

    Words are runs of characters other than ASCII white space, unchanged. A word goes if a window of `length` words that
    covers it also starts anywhere else, in another document or in the same one, judged on the input; the kept words are
    joined by one space. spans lists first and end word of what is removed, in order. Windows never cross documents. A
    null or empty text has no words; a text shorter than a window keeps all. Rows are documents of their own, also those
    with the same or no doc_id: two equal rows of `length` words and more lose everything. Very long texts are read in
    pieces of 2^20 words that overlap. No rows give no rows. Other columns are not read. Words are told apart by 128 bits,
    in extended stretches by themselves.
    """
    keyed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    keyed = keyed.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("mark"), "text")
    spans = repeated_spans(keyed, length, min(k, length))
    gathered = spans.groupBy("doc", "mark").agg(F.collect_set(F.struct("first", "last")).alias("found"))

    def remove(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text, found in zip(utf8(batch.column("text")), batch.column("found").to_pylist(), strict=True):
            words, spans, kept, at = text.split(), [], [], 0
            for a, b in sorted((x["first"], x["last"] + length) for x in found or ()):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            for a, b in spans:
                kept += words[at:a]
                at = b
            kept += words[at:]
            left = b" ".join(kept)
            rows.append((len(words), len(words) - len(kept), hashlib.sha256(left).hexdigest(), [x for s in spans for x in s], left if keep_text else None))
        columns = list(zip(*rows, strict=True))
        doc = batch.column("doc").to_numpy()
        arrays = [pa.array(doc, mask=doc == NO_ID), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.list_(pa.int64()))]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "spans"]
        if keep_text:
            names, arrays = [*names, "kept"], [*arrays, pa.array(columns[4], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<long>" + (", kept binary" if keep_text else "")
    return map_batches(keyed.join(gathered, ["doc", "mark"], "left"), remove, schema)
