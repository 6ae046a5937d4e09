"""Near-duplicate vectors by randomised-rotation binary codes.

Each vector is normalised and turned by seeded random rotations. The signs of its turned components are its code; the
factor stored with it is the inner product of the turned vector with its own code. Code times another turned vector,
divided by that factor, is an unbiased estimate of their cosine, and the factor also gives its spread. The other vector
enters rounded at random to four bits a component, so an estimate is a few counts of common bits. Vectors that share a band
of further sign bits are candidates; only codes meet there. An estimate whose upper confidence bound stays below the
threshold settles a pair; the rows of all other pairs meet again with their components, and pairs are computed anew in
double precision, so no reported link is below the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, in_arrow, key_runs, run_bounds, written


def rotations(dims: int, bits: int, seed: int) -> np.ndarray:
    """Random orthogonal matrices side by side, dims x bits or wider: a sign of each column is one bit."""
    rng = np.random.default_rng(seed)
    made = []
    while sum(m.shape[1] for m in made) < bits:
        q, r = np.linalg.qr(rng.standard_normal((dims, dims)))
        made.append(q * np.sign(np.diag(r)))
    return np.concatenate(made, 1)[:, :bits]


def bands_for(rows: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits of a band, number of bands): buckets hold few strangers, and a pair at the threshold meets with `recall`."""
    bits = int(np.clip(round(math.log2(max(rows, 2))) - 2, 6, 28))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same))


LEVELS = 4  # bits to a component of the side that is not a code


def encoded(turned: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """Of turned unit vectors: packed signs, the correction factor of each, and its components rounded at random to sixteen
    steps, as one packed plane per binary place, with the lowest value and the width of a step."""
    bits = turned.shape[1]
    padding = -bits % 64
    factors = np.abs(turned).sum(1) / math.sqrt(bits)
    low, high = turned.min(1), turned.max(1)
    step = np.maximum((high - low) / (2**LEVELS - 1), 1e-300)
    place = np.clip(np.floor((turned - low[:, None]) / step[:, None] + rng.random(turned.shape)), 0, 2**LEVELS - 1).astype(np.uint8)
    pack = lambda x: np.packbits(np.pad(x, ((0, 0), (0, padding))), axis=1)
    planes = np.stack([pack((place >> k) & 1) for k in range(LEVELS)], 1)
    return pack((turned >= 0).astype(np.uint8)), factors, planes, low, step


def estimates(code: np.ndarray, factor: np.ndarray, planes: np.ndarray, low: np.ndarray, step: np.ndarray, bits: int) -> np.ndarray:
    """Unbiased estimates of inner products, pair by pair: codes (words) of one side, planes (words) of the other."""
    ones = np.bitwise_count(code).sum(1, dtype=np.int64)
    inside = sum(np.bitwise_count(code & planes[:, k]).sum(1, dtype=np.int64) << k for k in range(LEVELS))
    every = sum(np.bitwise_count(planes[:, k]).sum(1, dtype=np.int64) << k for k in range(LEVELS))
    return (low * (2 * ones - bits) + step * (2 * inside - every)) / math.sqrt(bits) / factor


def upper_bounds(code: np.ndarray, factor: np.ndarray, planes: np.ndarray, low: np.ndarray, step: np.ndarray, bits: int, z: float) -> np.ndarray:
    """Estimates and z deviations: those of the code, and those of the rounding (half a step a component at most)."""
    of_code = (1 - np.minimum(factor, 1) ** 2) / factor**2 / (bits - 1)
    return estimates(code, factor, planes, low, step, bits) + z * np.sqrt(of_code + (step / 2 / factor) ** 2)


def _pairs(whole: pa.RecordBatch, keys: list[str], most: int, small: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of rows of each run. Of all runs of one size up to `small`, flat lists of pairs, each once; of a longer run,
    or one of two parts, left rows (a column) against right rows (a row), most pairs at a time."""
    bounds = run_bounds(whole, keys)
    part, first, second = (whole.column(c).to_numpy() for c in ("part", "first", "second"))
    sizes, starts = np.diff(bounds), bounds[:-1]
    flat = (sizes <= small) & (first[starts] == second[starts])
    for size in np.unique(sizes[flat & (sizes > 1)]).tolist():
        a, b = np.triu_indices(size, 1)
        at = starts[flat & (sizes == size)]
        for some in np.array_split(at, -(-len(at) * len(a) // most)):
            yield (some[:, None] + a).ravel(), (some[:, None] + b).ravel()
    for start, end in zip(starts[~flat].tolist(), bounds[1:][~flat].tolist(), strict=True):
        here = np.arange(start, end)
        left, right = (here, here) if first[start] == second[start] else (here[part[start:end] == x] for x in (first[start], second[start]))
        if len(left) and len(right):
            for some in np.array_split(left, -(-len(left) * len(right) // (most * 16))):
                yield some[:, None], right[None, :]


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.999, code_bits: int = 256, z: float = 5.0, block: int = 2048, seed: int = 0) -> DataFrame:
    """vectors(vec_id, embedding): one row per row with vec_id, n_links, component_id, kept.

    n_links counts the other rows found linked, component_id is the smallest vec_id reached by links, kept marks
    vec_id = component_id. A vector that is null, empty, zero, or holds a null or non-finite component links with nothing,
    nor do vectors of different lengths. Repeated rows are vectors of their own (of rows with one vec_id all can be kept);
    a null vec_id stays null and does not count as a component's smallest unless nothing else does. No rows give no rows;
    vectors of any length are taken, those of one length meet each other.

    Buckets of more than `block` vectors are compared in pairs of blocks, so no task holds more than two blocks; no bucket
    is cut short. `recall` is the chance that a pair exactly at the threshold shares a band; closer pairs share more.
    """
    numbered = written(vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), F.monotonically_increasing_id().alias("row")), "vectors")
    rows, dims = numbered.agg(F.count("*"), F.max(F.size("embedding"))).first()
    dims = max(1, dims or 1)
    bits, bands = bands_for(rows, threshold, recall)
    code_turn = rotations(dims, code_bits, seed) / math.sqrt(code_bits / dims)
    band_turn = rotations(dims, bits * bands, seed + 1)
    powers = 1 << np.arange(bits, dtype=np.int64)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Code, factor, planes and band keys of every usable vector."""
        for batch in batches:
            ids, vecs, units = [], [], []
            for row, vec in zip(batch.column("row").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
                if not vec or None in vec:
                    continue
                v = np.array(vec, np.float64)
                scale = np.abs(v).max()
                if not np.isfinite(scale) or scale == 0:
                    continue
                unit = np.zeros(dims)
                unit[: len(v)] = v / scale
                ids.append(row)
                vecs.append(v.astype("<f8"))
                units.append(unit / np.linalg.norm(unit))
            if not ids:
                continue
            m = np.array(units)
            codes, factors, planes, low, step = encoded(m @ code_turn, np.random.default_rng(np.array(ids, np.uint64)))
            keys = ((m @ band_turn >= 0).reshape(len(m), bands, bits) * powers).sum(2)
            texts = [pa.array([x.tobytes() for x in column], pa.binary()) for column in (vecs, codes, planes)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *texts, pa.array(factors), pa.array(low), pa.array(step), pa.array(keys.tolist(), pa.list_(pa.int64()))], ["row", "v", "code", "planes", "factor", "low", "step", "keys"])

    indexed = written(in_arrow(numbered.select("row", "embedding"), index, "row long, v binary, code binary, planes binary, factor double, low double, step double, keys array<long>"), "vector-codes")
    bucketed = indexed.select("row", F.posexplode("keys").alias("band", "key"))
    sizes = bucketed.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / block).cast("int"))
    placed = bucketed.join(sizes, ["band", "key"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts").cast("long")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    placed = placed.withColumn("other", other).select("band", "key", "row", "part", F.least("part", "other").alias("first"), F.greatest("part", "other").alias("second"))
    keys = ["band", "key", "first", "second"]

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of each block of a bucket for which some pair is not ruled out by its upper confidence bound."""
        for whole in key_runs(batches, keys):
            code, planes = (np.frombuffer(b"".join(whole.column(c).to_pylist()), "<u8").reshape(whole.num_rows, *shape) for c, shape in (("code", (-1,)), ("planes", (LEVELS, -1))))
            factor, low, step = (whole.column(c).to_numpy() for c in ("factor", "low", "step"))
            kept = np.zeros(whole.num_rows, bool)
            for i, j in _pairs(whole, keys, 1 << 14):
                if i.ndim == 2:  # a block: each left row with all right rows
                    i, j = np.broadcast_arrays(i, j)
                    i, j = i.ravel(), j.ravel()
                able = upper_bounds(code[i], factor[i], planes[j], low[j], step[j], code_bits, z) >= threshold
                kept[i[able]] = True
                kept[j[able]] = True
            yield whole.filter(pa.array(kept)).select([*keys, "row", "part"])

    codes = placed.join(indexed.select("row", "code", "planes", "factor", "low", "step"), "row")
    dealt = codes.repartition(*keys).sortWithinPartitions(*keys)
    able = in_arrow(dealt, estimate, "band int, key long, first int, second int, row long, part int")
    able = written(able, "vector-candidates")
    # Components and band keys travel only for rows that have a pair left to be computed.
    exact = able.join(indexed.select("row", "v", "keys"), "row").repartition(*keys).sortWithinPartitions(*keys)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in key_runs(batches, keys):
            row, band, part = (whole.column(c).to_numpy() for c in ("row", "band", "part"))
            keyed = np.array(whole.column("keys").to_pylist(), np.int64).reshape(-1, bands)
            units, lengths = np.zeros((whole.num_rows, dims)), np.zeros(whole.num_rows, np.int64)
            for at, raw in enumerate(whole.column("v").to_pylist()):
                v = np.frombuffer(raw, "<f8")
                lengths[at] = len(v)
                v = v / np.abs(v).max()
                units[at, : len(v)] = v / np.sqrt((v * v).sum())
            out = []
            for i, j in _pairs(whole, keys, 1 << 14):
                if i.ndim == 2:  # a product first, then each close pair by itself, as pairs of small buckets are
                    a, b = np.nonzero(units[i[:, 0]] @ units[j[0]].T >= threshold - 1e-9)
                    i, j = i[a, 0], j[0, b]
                    new = (i < j) | (part[i] != part[j])  # inside one part, each pair from its smaller row
                    i, j = i[new], j[new]
                close = (np.einsum("ij,ij->i", units[i], units[j]) >= threshold) & (lengths[i] == lengths[j])
                i, j = i[close], j[close]
                earlier = (keyed[i] == keyed[j]) & (np.arange(bands) < band[i][:, None])  # the first band that two rows share counts them
                once = ~earlier.any(1)
                out.append(np.stack([i[once], j[once]]))
            pairs = np.concatenate(out, 1) if out else np.zeros((2, 0), np.int64)
            if pairs.shape[1]:
                counts = np.bincount(pairs.ravel(), minlength=whole.num_rows)
                roots = np.arange(whole.num_rows)
                while True:  # smallest linked row, passed on until nothing changes: a spanning forest, not all pairs
                    before = roots.copy()
                    np.minimum.at(roots, pairs[0], roots[pairs[1]])
                    np.minimum.at(roots, pairs[1], roots[pairs[0]])
                    if (before == roots).all():
                        break
                hit = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(row[hit]), pa.array(row[roots[hit]]), pa.array(counts[hit], pa.int64())], ["row", "root", "n"])

    found = written(in_arrow(exact, compare, "row long, root long, n long"), "vector-links")
    counts = found.groupBy("row").agg(F.sum("n").alias("n_links"))
    classes = connected_components(found.select(F.col("row").alias("a"), F.col("root").alias("b")))
    named = numbered.select("row", "vec_id").join(classes, F.col("row") == F.col("node"), "left").join(counts, "row", "left")
    named = named.withColumn("class", F.coalesce("component", "row"))
    smallest = named.groupBy("class").agg(F.min("vec_id").alias("component_id"))
    return named.join(smallest, "class").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
