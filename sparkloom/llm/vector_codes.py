"""Compression of vectors to codes of 16 bytes with exact integer arithmetic.

Vectors become integers, are cut into 16 equal parts, and each part is replaced by the number of the nearest of 64 entries
of its codebook. Nearest means by exact squared distance: |x|^2 - 2 x.c + |c|^2, where the products x.c come from BLAS in
double precision. To be exact there, integers are split into limbs so narrow that no sum of products of two limbs passes
2^53; the limbs' products are put together again in 64-bit integers, and the first smallest distance wins.

A round is one pass over the vectors: the codebooks, 64 times a vector's length, travel with the task; back come sums and
counts by entry, added up in the task before the shuffle. Sums travel as limbs of 31 bits, so they are exact at any number
of rows. No vector is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, map_batches, written

PARTS, ENTRIES = 16, 64
LONGEST = (1 << 63) - 1
SUM_BITS = 31


def limb_bits(width: int) -> int:
    """Bits of a limb, so that `width` products of two limbs add up to at most 2^53."""
    return (53 - (width - 1).bit_length()) // 2


def widest(width: int) -> int:
    """Components up to this size keep every squared distance of `width` components below 2^63."""
    return 1 << (60 - (width - 1).bit_length()) // 2


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """x = sum of limb i shifted by i * bits; limbs lie in 0 .. 2^bits - 1, the last one in -2^bits .. 2^bits."""
    out = []
    while x.size and max(int(x.max()), -int(x.min())) > 1 << bits:
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits
    return [*out, x.astype(np.float64)]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of 64-bit integers whose products fit 64 bits, exactly, by double-precision BLAS on limbs."""
    bits = limb_bits(a.shape[1])
    out = np.zeros((len(a), len(b)), np.int64)
    for i, x in enumerate(limbs(a, bits)):
        for j, y in enumerate(limbs(b, bits)):
            out += (x @ y.T).astype(np.int64) << (bits * (i + j))
    return out


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the first nearest row of book, and its squared distance. Arrays of Python integers (wide
    components) are compared in Python's own arithmetic."""
    if x.dtype == object or book.dtype == object:
        at, least = np.zeros(len(x), np.int64), np.zeros(len(x), object)
        wide = book.astype(object)
        for i, row in enumerate(x.astype(object)):
            far = ((wide - row) ** 2).sum(axis=1)
            at[i] = min(range(len(far)), key=far.__getitem__)
            least[i] = far[at[i]]
        return at, least
    far = (x * x).sum(axis=1)[:, None] - 2 * products(x, book) + (book * book).sum(axis=1)[None, :]
    at = far.argmin(axis=1)
    return at, far[np.arange(len(x)), at]


def as_integers(values: np.ndarray, scale: int, width: int) -> np.ndarray:
    """floor(scale * x) of finite doubles: 64-bit integers, or Python integers if one is too wide for exact distances."""
    if not values.size or np.abs(values).max() * scale < widest(width):
        return np.floor(values * scale).astype(np.int64)
    exact = [int(np.floor(v * scale)) if abs(v) < 2.0**53 else int(v) * scale for v in values.ravel().tolist()]
    return np.array(exact, object).reshape(values.shape)


def narrow(book: np.ndarray, width: int) -> np.ndarray:
    """The codebook as 64-bit integers where its components allow exact distances."""
    flat = book.ravel().tolist()
    return book.astype(np.int64) if not flat or max(map(abs, flat)) <= widest(width) else book


def _blocks(column: pa.Array, scale: int, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, integers) of a batch: rows with wide components apart from the others."""
    values = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)
    wide = np.abs(values).max(axis=1, initial=0) * scale >= widest(dims // PARTS)
    for rows in (np.flatnonzero(~wide), np.flatnonzero(wide)):
        if len(rows):
            yield rows, as_integers(values[rows], scale, dims // PARTS)


def sum_limbs(value: int) -> list[int]:
    """A Python integer as limbs of SUM_BITS bits, the last one signed."""
    out = []
    while not -(1 << SUM_BITS) <= value < 1 << SUM_BITS:
        out.append(value & ((1 << SUM_BITS) - 1))
        value >>= SUM_BITS
    return [*out, value]


def refined(vectors: DataFrame, books: list[np.ndarray], scale: int) -> list[np.ndarray]:
    """One round: every part goes to its nearest entry, and each entry in use becomes floor(sum / count) of its parts."""
    width = books[0].shape[1]
    dims, size = PARTS * width, len(books[0])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((PARTS, size, width + 1), object)  # the last component counts
        for batch in batches:
            for _, x in _blocks(batch.column("e"), scale, dims):
                for p, book in enumerate(books):
                    part = x[:, p * width : (p + 1) * width]
                    at, _ = nearest(part, book)
                    here = np.zeros((size, width + 1), x.dtype)
                    np.add.at(here, at, np.concatenate([part, np.ones((len(part), 1), x.dtype)], axis=1))
                    total[p] += here.astype(object)
        rows = [(slot, i, limb) for slot, value in enumerate(total.ravel().tolist()) if value for i, limb in enumerate(sum_limbs(value))]
        slots, places, values = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(places, pa.int32()), pa.array(values, pa.int64())], ["slot", "limb", "value"])

    summed = in_arrow(vectors.select("e"), add, "slot int, limb int, value long").groupBy("slot", "limb").agg(F.sum("value").alias("value"))
    total = [0] * (PARTS * size * (width + 1))
    for slot, limb, value in summed.collect():  # a row a limb of a codebook's sums, whatever the number of vectors
        total[slot] += value << SUM_BITS * limb
    sums = np.array(total, object).reshape(PARTS, size, width + 1)
    out = []
    for book, here in zip(books, sums, strict=True):
        made = [[s // n for s in row] if n else old for *row, n, old in ((*r, o) for r, o in zip(here.tolist(), book.tolist(), strict=True))]
        out.append(narrow(np.array(made, object).reshape(book.shape), width))
    return out


def compress(rows: DataFrame, scale: int = 256, rounds: int = 2, label: str = "label") -> DataFrame:
    """One row per row of rows(vec_id, embedding, label) that takes part: vec_id, code, error, label_error,
    codebooks_sha256.

    Codebooks start from the parts of the 64 smallest vec_ids (fewer rows: fewer entries) and are refined `rounds` times;
    then every part gets its nearest entry, ties to the lower number. Left out are vectors that are null, hold a null or
    non-finite component, have a length that is no multiple of 16 (or none), or another length than the vector with the
    smallest vec_id among the rest. A null vec_id comes after all others; equal vec_ids are ordered by their vectors.
    Repeated rows each count. Components too wide for distances in 64 bits are compared in Python integers, slowly, and
    errors beyond the largest long are given as that. label_error sums the errors of equal labels, nulls together. No rows
    give no rows. Other columns are not read.
    """
    kept = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("e"), F.col(label).alias("label"))
    kept = kept.where(F.expr(f"size(e) > 0 and size(e) % {PARTS} = 0 and forall(e, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"))
    order = [F.col("vec_id").asc_nulls_last(), "e"]
    first = kept.orderBy(*order).select("e").first()
    dims = len(first.e) if first else PARTS
    kept = kept.where(F.size("e") == dims)
    width = dims // PARTS
    start = np.array([r.e for r in kept.orderBy(*order).select("e").limit(ENTRIES).collect()], np.float64).reshape(-1, dims)
    start = as_integers(start, scale, width)
    books = [narrow(start[:, p * width : (p + 1) * width].astype(object), width) for p in range(PARTS)]
    for _ in range(rounds if len(start) else 0):
        books = refined(kept, books, scale)
    print_of = hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()

    def assign(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes, errors = np.zeros((batch.num_rows, PARTS), np.uint8), np.zeros(batch.num_rows, object)
        for at, x in _blocks(batch.column("e"), scale, dims):
            for p, book in enumerate(books):
                codes[at, p], far = nearest(x[:, p * width : (p + 1) * width], book)
                errors[at] += far.astype(object)
        text, step = codes.tobytes().hex(), 2 * PARTS
        hexed = [text[i : i + step] for i in range(0, len(text), step)]
        capped = pa.array([min(e, LONGEST) for e in errors.tolist()], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(hexed, pa.string()), capped, batch.column("label")], ["vec_id", "code", "error", "label"])

    kind = kept.schema["label"].dataType.simpleString()
    coded = written(map_batches(kept, assign, f"vec_id long, code string, error long, label {kind}"), "vector-codes")
    sums = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("s"))
    sums = sums.select(F.col("label").alias("of"), F.least("s", F.lit(LONGEST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(print_of).alias("codebooks_sha256"))
