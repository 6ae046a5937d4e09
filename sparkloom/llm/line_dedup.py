"""Reversible corpus-wide line de-duplication.

The index is two tables. Reference counts are exact: for every line key the number of documents that hold it. In front of
them stand cuckoo filters, one per shard of the key space, that hold the keys found in at least `min_docs` documents; they
are small, answer most lookups without touching the counts, and take deletions as well as insertions. Inserting documents
adds to the counts, deleting documents subtracts, and only keys that cross the threshold move in or out of a filter, so
deleting what was inserted gives back the same decisions.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, map_batches, utf8, written

SLOTS, KICKS = 4, 500
LEAST_SHARDS, SHARD_KEYS = 64, 1 << 16  # a shard's filter is to hold about that many keys


def line_keys(text: bytes) -> list[bytes]:
    """The key of each line: ASCII white space stripped at both ends, A-Z in lower case."""
    return [line.strip() for line in text.lower().split(b"\n")]


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; a fingerprint lives in one of two buckets, each found from the other."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def of(cls, hashes: np.ndarray) -> CuckooFilter:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, len(hashes)) / (SLOTS * 0.8)))))
        while True:
            made = cls(np.zeros((buckets, SLOTS), np.uint16))
            if made.insert_all(hashes):
                return made
            buckets *= 2

    def insert_all(self, hashes: np.ndarray) -> bool:
        """Insert many hashes in rounds: in each, every bucket takes as many of those that wait for it as it has free slots;
        what is left goes to its other bucket, and then pushes out one entry a bucket, which waits for its own other one.
        False if some find no place; the table is then of no use."""
        if not len(hashes):
            return True
        mask = np.uint64(len(self.table) - 1)
        marks = np.maximum(hashes >> np.uint64(48), np.uint64(1)).astype(np.uint16)
        at = (hashes & mask).astype(np.int64)
        for step in range(KICKS):
            order = np.argsort(at, kind="stable")
            marks, at = marks[order], at[order]
            starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            rank = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
            free = self.table[at] == 0
            fits = rank < free.sum(axis=1)
            slot = np.argsort(~free[fits], axis=1, kind="stable")[np.arange(int(fits.sum())), rank[fits]]
            self.table[at[fits], slot] = marks[fits]
            marks, at = marks[~fits], at[~fits]
            if not len(at):
                return True
            if step:
                heads = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                place = at[heads], np.full(len(heads), step % SLOTS)
                marks[heads], self.table[place] = self.table[place].copy(), marks[heads].copy()
                at[heads] = self._others(at[heads], marks[heads])
            else:
                at = self._others(at, marks)
        return False

    def _others(self, buckets: np.ndarray, marks: np.ndarray) -> np.ndarray:
        return ((buckets.astype(np.uint64) ^ ((marks.astype(np.uint64) * np.uint64(0x5BD1E995)) & np.uint64(0xFFFFFFFF))) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _places(self, h: int) -> tuple[int, int, int]:
        mark = (h >> 48) or 1
        first = h & (len(self.table) - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ ((mark * 0x5BD1E995) & 0xFFFFFFFF)) & (len(self.table) - 1)

    def insert(self, h: int) -> bool:
        mark, first, second = self._places(h)
        for bucket in (first, second):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return True
        bucket = first
        for step in range(KICKS):
            slot = step % SLOTS
            mark, self.table[bucket, slot] = int(self.table[bucket, slot]), mark
            bucket = self._other(bucket, mark)
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return True
        return False

    def delete(self, h: int) -> None:
        mark, first, second = self._places(h)
        for bucket in (first, second):
            at = np.flatnonzero(self.table[bucket] == mark)
            if len(at):
                self.table[bucket, at[0]] = 0
                return

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        marks = np.maximum(hashes >> np.uint64(48), np.uint64(1))
        mask = np.uint64(len(self.table) - 1)
        first = hashes & mask
        second = (first ^ ((marks * np.uint64(0x5BD1E995)) & np.uint64(0xFFFFFFFF))) & mask
        marks = marks.astype(np.uint16)[:, None]
        return (self.table[first.astype(np.int64)] == marks).any(1) | (self.table[second.astype(np.int64)] == marks).any(1)


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(k[:8] for k in keys), "<u8")


def _shards(keys: list[bytes], shards: int) -> np.ndarray:
    return (np.frombuffer(b"".join(k[8:12] for k in keys), "<u4") % np.uint32(shards)).astype(np.int64)


def reference_counts(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """(key binary, n long): the number of rows of docs(text) that hold each line key, pre-summed per batch."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: Counter = Counter()
        for text in utf8(batch.column("text")):
            counts.update({k for k in line_keys(text) if len(k) >= min_chars and (min_chars < 2 or len(k.decode()) >= min_chars)})
        return pa.RecordBatch.from_arrays([pa.array([digest(k) for k in counts], pa.binary()), pa.array(list(counts.values()), pa.int64())], ["key", "n"])

    return map_batches(docs.select(F.col("text").cast("string")), count, "key binary, n long").groupBy("key").agg(F.sum("n").alias("n"))


class LineIndex:
    """counts(key, n) and filters(shard, table): written tables, replaced as a whole by each update."""

    def __init__(self, counts: DataFrame, filters: DataFrame, min_docs: int, shards: int, min_chars: int, sized: bool = False):
        self.counts, self.filters, self.min_docs, self.shards, self.min_chars, self.sized = counts, filters, min_docs, shards, min_chars, sized

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = 10, shards: int | None = None, min_chars: int = 1) -> LineIndex:
        """Without a number of shards there are as many as the frequent keys need, and more once they have grown."""
        empty = docs.sparkSession.createDataFrame([], "key binary, n long")
        filters = docs.sparkSession.createDataFrame([], "shard long, table binary")
        return cls(empty, filters, min_docs, shards or LEAST_SHARDS, min_chars, shards is None)._changed(reference_counts(docs, min_chars))

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._changed(reference_counts(docs, self.min_chars))

    def delete(self, docs: DataFrame) -> LineIndex:
        """docs: rows inserted before, with their texts."""
        return self._changed(reference_counts(docs, self.min_chars).withColumn("n", -F.col("n")))

    def _changed(self, deltas: DataFrame) -> LineIndex:
        old = self.counts.withColumn("was", F.col("n"))
        both = old.unionByName(deltas.withColumn("was", F.lit(0).cast("long"))).groupBy("key").agg(F.sum("n").alias("n"), F.sum("was").alias("was"))
        both = written(both, "line-counts")
        low, shards, filters = self.min_docs, self.shards, self.filters
        wanted = shards_for(both.where(F.col("n") >= low).count()) if self.sized else shards
        if wanted > shards:  # all filters anew, in more shards
            shards, filters, both = wanted, filters.limit(0), both.withColumn("was", F.lit(0).cast("long"))
        moves = both.where((F.col("n") >= low) != (F.col("was") >= low)).select("key", (F.col("n") >= low).alias("enters"))
        grouped = moves.withColumn("shard", _shard_column(shards)).groupBy("shard").cogroup(filters.groupBy("shard"))

        def update(key: tuple, changed: pa.Table, held: pa.Table) -> pa.Table:
            enters = np.array(changed.column("enters").to_pylist(), bool)
            keys = _hashes(changed.column("key").to_pylist())
            entering, leaving = keys[enters], keys[~enters]
            if not held.num_rows:
                table = CuckooFilter.of(entering).table
            else:
                made = CuckooFilter(np.frombuffer(held.column("table")[0].as_py(), np.uint16).reshape(-1, SLOTS).copy())
                for h in leaving.tolist():
                    made.delete(h)
                table = made.table if made.insert_all(entering) else None
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "table": pa.array([None if table is None else table.tobytes()], pa.binary())})

        def remake(key: tuple, frequent: pa.Table) -> pa.Table:
            table = CuckooFilter.of(_hashes(frequent.column("key").to_pylist())).table
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "table": pa.array([table.tobytes()], pa.binary())})

        filters = written(grouped.applyInArrow(update, "shard long, table binary"), "line-filters")
        full = [r.shard for r in filters.where("table is null").select("shard").collect()]  # a row a shard at most
        if full:  # made anew, larger, from the exact counts
            keys = both.where(F.col("n") >= low).select("key", _shard_column(shards).alias("shard")).where(F.col("shard").isin(full))
            remade = keys.groupBy("shard").applyInArrow(remake, "shard long, table binary")
            filters = written(filters.where("table is not null").unionByName(remade), "line-filters")
        return LineIndex(both.where("n > 0").select("key", "n"), filters, low, shards, self.min_chars, self.sized)

    def frequent(self) -> DataFrame:
        return self.counts.where(F.col("n") >= self.min_docs).select("key")


def shards_for(keys: int) -> int:
    """A power of two of shards, so that each holds SHARD_KEYS keys at most on average."""
    return max(LEAST_SHARDS, 1 << max(0, -(-keys // SHARD_KEYS) - 1).bit_length())


def _shard_column(shards: int):
    """The shard of a key, as _shards computes it: bytes 9 to 12, lowest first."""
    hexed = F.hex(F.substring("key", 9, 4))
    low_first = F.concat(*[F.substring(hexed, at, 2) for at in (7, 5, 3, 1)])
    return F.pmod(F.conv(low_first, 16, 10).cast("long"), F.lit(shards))


def drop_frequent_lines(docs: DataFrame, index: LineIndex, broadcast_keys: int = 1 << 20, indexed: bool = False) -> DataFrame:
    """One row per row of docs(doc_id, text, ...): its columns, then n_lines, n_dropped, kept.

    A line whose key is non-empty and found in at least index.min_docs documents goes; the others stay, joined by line
    feeds. A null or empty text is one empty line and stays (as an empty text). Repeated rows count as documents of their
    own. Columns of docs that clash with the three new ones are replaced.

    Every line is looked up in its shard's filter. What a filter wrongly holds is settled by the exact counts. Where docs
    are among those the index has counted (indexed), the wrongly held keys are the infrequent ones of the counts that the
    filters hold, few enough to be sent along with filters of up to broadcast_keys keys. Otherwise the keys that pass the
    filters are joined with the frequent keys; filters of more than broadcast_keys keys are then met by shuffle.
    """
    docs = docs.drop("n_lines", "n_dropped", "kept")
    few = index.frequent().limit(broadcast_keys + 1).count() <= broadcast_keys
    if few and indexed:
        held = _held(index.counts.where(F.col("n") < index.min_docs).select("key"), _sent(index), index.shards)
        wrong = [bytes(r.key) for r in held.limit(broadcast_keys + 1).toLocalIterator()]
        if len(wrong) <= broadcast_keys:
            return _drop_by_broadcast(docs, index, frozenset(wrong))
    return _drop_by_join(docs, index, few)


def _sent(index: LineIndex) -> Broadcast:
    """The filters, by shard, for every task; the caller has checked their size."""
    tables = {r.shard: np.frombuffer(r.table, np.uint16).reshape(-1, SLOTS) for r in index.filters.toLocalIterator()}
    return index.filters.sparkSession.sparkContext.broadcast(tables)


def _passing(digests: list[bytes], tables: dict[int, np.ndarray], shards: int) -> np.ndarray:
    """Marks the digests that their shard's filter holds."""
    out = np.zeros(len(digests), bool)
    if len(digests):
        hashes, places = _hashes(digests), _shards(digests, shards)
        order = np.argsort(places, kind="stable")
        for chunk in np.split(order, np.flatnonzero(np.diff(places[order])) + 1):
            table = tables.get(int(places[chunk[0]]))
            if table is not None:
                out[chunk] = CuckooFilter(table).holds(hashes[chunk])
    return out


def _held(keyed: DataFrame, sent: Broadcast, shards: int) -> DataFrame:
    """The rows whose key passes the broadcast filters."""

    def look(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(_passing(batch.column("key").to_pylist(), sent.value, shards)))

    return map_batches(keyed, look, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keyed.schema))


def _held_by_shuffle(pairs: DataFrame, index: LineIndex, salts: int = 16) -> DataFrame:
    """The (row, key) pairs whose key passes its shard's filter: each shard's pairs, in `salts` parts, follow a copy of its
    filter into a task, so a task holds one filter and a batch of pairs, however many documents hold a line."""
    asked = pairs.select(_shard_column(index.shards).alias("shard"), F.pmod(F.xxhash64("row"), F.lit(salts)).alias("salt"), "row", "key", F.lit(None).cast("binary").alias("table"))
    salted = index.filters.select(F.col("shard").cast("long"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"), F.lit(None).cast("long").alias("row"), F.lit(None).cast("binary").alias("key"), "table")
    dealt = asked.unionByName(salted).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("table").isNull())
    shards = index.shards

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tables = None, {}
        for batch in batches:
            place = list(zip(batch.column("shard").to_pylist(), batch.column("salt").to_pylist(), strict=True))
            keys, filters = batch.column("key").to_pylist(), batch.column("table")
            starts = [i for i in range(len(place)) if i == 0 or place[i] != place[i - 1]]
            for a, b in zip(starts, [*starts[1:], len(place)], strict=True):
                if place[a] != at:
                    at, tables = place[a], {}
                if filters[a].is_valid:
                    tables, a = {at[0]: np.frombuffer(filters[a].as_py(), np.uint16).reshape(-1, SLOTS)}, a + 1
                hit = np.flatnonzero(_passing(keys[a:b], tables, shards)) + a
                yield batch.select(["row", "key"]).take(pa.array(hit))

    return in_arrow(dealt, look, "row long, key binary")


def _kept(text: bytes, drops) -> tuple[int, int, str]:
    lines = text.split(b"\n")
    keys = line_keys(text)
    kept = [line for line, key in zip(lines, keys, strict=True) if not (key and key in drops)]
    return len(lines), len(lines) - len(kept), b"\n".join(kept).decode()


def _out(batch: pa.RecordBatch, columns: list[str], rows: list[tuple]) -> pa.RecordBatch:
    made = list(zip(*rows, strict=True))
    arrays = [pa.array(made[0], pa.int64()), pa.array(made[1], pa.int64()), pa.array(made[2], pa.string())]
    return pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *arrays], [*columns, "n_lines", "n_dropped", "kept"])


def _drop_by_broadcast(docs: DataFrame, index: LineIndex, wrong: frozenset[bytes]) -> DataFrame:
    """Filters decide, but for the keys that they are known to hold wrongly."""
    filters, exceptions = _sent(index), docs.sparkSession.sparkContext.broadcast(wrong)
    columns, shards = docs.columns, index.shards

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = utf8(batch.column("text"))
        known = list({k for t in texts for k in line_keys(t)} - {b""})
        digests = [digest(k) for k in known]
        passing = np.flatnonzero(_passing(digests, filters.value, shards)).tolist()
        drops = {known[i] for i in passing if digests[i] not in exceptions.value}
        return _out(batch, columns, [_kept(t, drops) for t in texts])

    return map_batches(docs.withColumn("text", F.col("text").cast("string")), work, _schema(docs))


def _drop_by_join(docs: DataFrame, index: LineIndex, few: bool) -> DataFrame:
    """The same by join: what passes the filters meets the frequent keys, and what was found comes back to the row."""
    columns = docs.columns
    number, drops = (next(x for x in (base + "_" * i for i in range(len(columns) + 1)) if x.lower() not in map(str.lower, columns)) for base in ("row", "drops"))
    numbered = written(docs.withColumn("text", F.col("text").cast("string")).withColumn(number, F.monotonically_increasing_id()), "numbered-docs")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(row, digest(k)) for row, text in zip(batch.column("row").to_pylist(), utf8(batch.column("text")), strict=True) for k in set(line_keys(text)) - {b""}]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.binary())], ["row", "key"])

    pairs = in_arrow(numbered.select(F.col(number).alias("row"), "text"), keys, "row long, key binary")
    passing = _held(pairs, _sent(index), index.shards) if few else _held_by_shuffle(pairs, index)
    hits = passing.join(index.frequent(), "key", "left_semi").groupBy(F.col("row").alias(number)).agg(F.collect_set("key").alias(drops))
    found = numbered.join(hits, number, "left")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text, gone in zip(utf8(batch.column("text")), batch.column(drops).to_pylist(), strict=True):
            mine = set(gone or ())
            rows.append(_kept(text, {k for k in line_keys(text) if k and digest(k) in mine}))
        return _out(batch, columns, rows)

    return map_batches(found, work, _schema(docs))


def _schema(docs: DataFrame) -> str:
    types = [f"`{f.name}` {'string' if f.name == 'text' else f.dataType.simpleString()}" for f in docs.schema]
    return ", ".join([*types, "n_lines long", "n_dropped long", "kept string"])


def dedup_lines(docs: DataFrame, min_docs: int = 10, shards: int | None = None, min_chars: int = 1, broadcast_keys: int = 1 << 20) -> DataFrame:
    """docs(doc_id, text, ...) without the lines found in at least min_docs of them: an index built of docs, applied to them.

    Columns, nulls, empty texts, repeated rows and clashing names as in drop_frequent_lines; texts of any length are split
    whole, and no rows give no rows.
    """
    return drop_frequent_lines(docs, LineIndex.build(docs, min_docs, shards, min_chars), broadcast_keys, indexed=True)
