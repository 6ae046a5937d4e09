"""Token-id files in bit planes.

Documents are dealt to shards by ranges of doc_id and encoded shard by shard. The ids of a shard are cut into blocks of a
fixed number of ids. A block is transposed: all lowest bits (or bytes) of its ids together, then all next ones, and so on;
each plane is compressed by zstandard on its own, so the nearly constant high planes take almost no room. A chunk row
holds one block with its index: place in the shard, number of ids, plane sizes, and which documents lie in it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh_path, in_arrow
from .tokenizer import ByteBpe, load

CHUNK = "shard int, chunk long, n_ids long, planes array<binary>, doc_ids array<long>, doc_seq array<long>, doc_parts array<long>, doc_ends array<boolean>"
PIECE = "shard int, doc_seq long, part long, doc_id long, n_ids long, crc32 long, whole boolean, ids binary"


def pack(ids: np.ndarray, by_bit: bool, level: int) -> list[bytes]:
    """Planes of a block of 32-bit ids, each compressed; planes above the highest bit in use are left out."""
    squeeze = zstandard.ZstdCompressor(level=level)
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    used = max(1, (int(ids.max()).bit_length() + 7) // 8) if len(ids) else 0
    planes = [np.ascontiguousarray(raw[:, k]) for k in range(used)]
    if by_bit:
        planes = [np.packbits((p >> b) & 1) for p in planes for b in range(8)]
    return [squeeze.compress(p.tobytes()) for p in planes]


def unpack(planes: list[bytes], n: int, by_bit: bool) -> np.ndarray:
    expand = zstandard.ZstdDecompressor()
    raw = np.zeros((n, 4), np.uint8)
    for k, plane in enumerate(planes):
        got = np.frombuffer(expand.decompress(plane), np.uint8)
        if by_bit:
            raw[:, k // 8] |= np.unpackbits(got, count=n) << np.uint8(k % 8)
        else:
            raw[:, k] = got
    return raw.reshape(-1).view("<u4")


def write_token_files(docs: DataFrame, tokenizer_path: str, out: str, end_id: int = 2, block_ids: int = 1 << 16, shard_docs: int = 8192, by_bit: bool = False, level: int = 3) -> None:
    """Encode docs(doc_id, text) and write the chunk rows under out, in ascending doc_id order.

    Every document ends with end_id; a null or empty text is that id alone. Rows with the same doc_id follow each other
    in order of their text; a null doc_id comes first. Shard bounds come from quantiles of doc_id alone, so texts are read
    and encoded once; a doc_id that repeats stays in one shard. No rows give no chunks. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    n = docs.count()
    shards = max(1, -(-n // shard_docs))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / shards for i in range(1, shards)], 10 * shards)).first()[0] if shards > 1 else []
    cuts = sorted(set(cuts or []))
    dealt = docs.withColumn("shard", _bucket(F.col("doc_id"), cuts)).repartition(max(1, len(cuts) + 1), "shard").sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(ByteBpe, tokenizer_path)
        rows: list[tuple] = []
        current, chunk, seq, waiting, held = None, 0, 0, [], 0  # waiting: (doc_id, seq, ids, ends) of the open block

        def close() -> None:
            nonlocal chunk, waiting, held
            if waiting:
                ids = np.concatenate([w[2] for w in waiting])
                rows.append((current, chunk, len(ids), pack(ids, by_bit, level), [w[0] for w in waiting], [w[1] for w in waiting], [len(w[2]) for w in waiting], [w[3] for w in waiting]))
                chunk, waiting, held = chunk + 1, [], 0

        for batch in batches:
            for doc_id, text, of in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "shard")), strict=True):
                if of != current:
                    close()
                    current, chunk, seq = of, 0, 0
                ids = np.append(bpe.encode(text or ""), np.uint32(end_id))
                while len(ids):
                    take = ids[: block_ids - held]
                    ids = ids[len(take) :]
                    waiting.append((doc_id, seq, take, not len(ids)))
                    held += len(take)
                    if held == block_ids:
                        close()
                seq += 1
                if len(rows) >= 16:
                    yield _chunks(rows)
                    rows = []
        close()
        if rows:
            yield _chunks(rows)

    in_arrow(dealt, encode, CHUNK).write.option("compression", "none").parquet(out)


def _chunks(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_())]
    names = ["shard", "chunk", "n_ids", "planes", "doc_ids", "doc_seq", "doc_parts", "doc_ends"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _bucket(value, cuts: list[int]):
    """Index of the range of sorted cuts that value falls in; null is in the first."""
    if not cuts:
        return F.lit(0)
    inside = F.array(*[F.lit(c) for c in cuts])
    return F.coalesce(F.size(F.filter(inside, lambda c: c <= value)), F.lit(0))


def read_token_files(spark: SparkSession, path: str, by_bit: bool = False) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32, in no order.

    Blocks are decoded where they are read. A document inside one block needs no shuffle; the parts of one that crosses
    blocks meet by (shard, place in the shard).
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                ids = unpack(row["planes"], row["n_ids"], by_bit)
                at, last = 0, len(row["doc_parts"]) - 1
                for k, (doc_id, seq, size, ended) in enumerate(zip(row["doc_ids"], row["doc_seq"], row["doc_parts"], row["doc_ends"], strict=True)):
                    raw = ids[at : at + size].tobytes()
                    # The first piece of a later block may continue a document of the block before.
                    whole = ended and (k > 0 or row["chunk"] == 0)
                    out.append((row["shard"], seq, row["chunk"], doc_id, size, zlib.crc32(raw) if whole else None, whole, None if whole else raw))
                    at += size
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
            names = ["shard", "doc_seq", "part", "doc_id", "n_ids", "crc32", "whole", "ids"]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    chunks = spark.read.schema(CHUNK).parquet(path)
    pieces = in_arrow(chunks, decode, PIECE)
    whole = pieces.where("whole").select("shard", "doc_seq", "doc_id", F.col("n_ids").alias("n_tokens"), F.col("crc32").alias("ids_crc32"))
    joined = F.aggregate(F.array_sort(F.collect_list(F.struct("part", "ids"))), F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    crossing = pieces.where("not whole").groupBy("shard", "doc_seq").agg(F.first("doc_id").alias("doc_id"), F.sum("n_ids").alias("n_tokens"), F.crc32(joined).alias("ids_crc32"))
    docs = whole.unionByName(crossing)
    # Ids before a shard: a window over one row per shard. Ids before a document in its shard: over the shard's documents.
    before = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", (F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("doc_seq").rowsBetween(Window.unboundedPreceding, -1))
    return docs.withColumn("inside", inside).join(before, "shard").select("doc_id", (F.coalesce("before", F.lit(0)) + F.coalesce("inside", F.lit(0))).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer_path: str, **how) -> DataFrame:
    """Write the files to a new folder of the shared directory, and read them back."""
    spark = docs.sparkSession
    out = fresh_path(spark, "token-files")
    write_token_files(docs, tokenizer_path, out, **how)
    return read_token_files(spark, out, how.get("by_bit", False))
