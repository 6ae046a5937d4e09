"""Exact top-k by inner product as a Voronoi kNN join.

Pivots are drawn from the rows, and every row lies in the cell of its nearest pivot. A cell is summed up by its number of
rows, the greatest distance and angle to its pivot, and its greatest norm. From that summary and a query q follow bounds
on all scores in a cell with pivot p: q.p + |q| (greatest distance), and |q| (greatest norm) cos(angle(q, p) - greatest
angle). A query is solved in its own cell first; its k-th score there is reached for sure, so it goes on only to the cells
whose bounds reach that score. Cells are solved locally, each with the queries that were sent to it, in blocks.

Vectors that spread evenly in many dimensions give wide bounds; cells_asked() tells how much was ruled out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import in_arrow, written

EXACT = 2.0**53


def scaled(column: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose vectors take part, and floor(scale * x) of each as float64, shorter ones padded by zeros."""
    lists = column.cast(pa.list_(pa.float64()))
    sizes = np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, np.diff(lists.offsets.to_numpy()))
    values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
    at = lists.offsets.to_numpy()
    sound = ~lists.is_null().to_numpy(zero_copy_only=False)
    width = int(sizes.max()) if len(sizes) else 0
    out = np.zeros((len(sizes), width))
    if len(sizes) and (sizes == width).all():
        out[:] = values[at[0] : at[-1]].reshape(-1, width)
    else:
        for i in np.flatnonzero(sizes):
            out[i, : sizes[i]] = values[at[i] : at[i] + sizes[i]]
    sound &= np.isfinite(out).all(1)
    with np.errstate(invalid="ignore", over="ignore"):
        out = np.floor(scale * out)
    return np.flatnonzero(sound), out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, raw in enumerate(column.to_pylist()):
        got = np.frombuffer(raw, "<f8")
        out[i, : len(got)] = got
    return out


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of integer-valued rows; Python integers, held to 64 bits, where doubles would round."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if top < EXACT:
        return (a @ b.T).astype(np.int64)
    wide = np.vectorize(int, otypes=[object])
    ends = np.iinfo(np.int64)
    return np.clip(wide(a).dot(wide(b).T), ends.min, ends.max).astype(np.int64)


KEPT = "vec_id long, q boolean, v binary, n int"


def _prepared(vectors: DataFrame, is_query, scale: float) -> DataFrame:
    """Usable rows with their scaled integer vectors, written once."""

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sound, ints = scaled(batch.column("embedding"), scale)
                keep = pa.array(sound)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(keep), batch.column("q").take(keep), pa.array([ints[i].tobytes() for i in sound], pa.binary()), pa.array([len(ints[i]) for i in sound], pa.int32())], ["vec_id", "q", "v", "n"])

    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), is_query.alias("q")).where("vec_id is not null")
    return written(in_arrow(rows, prepare, KEPT), "knn-vectors")


class Cells:
    """The rows by cell, and what is known of the cells on the driver: at most most_cells pivots and summaries."""

    def __init__(self, kept: DataFrame, rows: int, width: int, cell_rows: int, most_cells: int, block_rows: int, seed: int):
        self.width = width
        many = int(min(most_cells, max(1, -(-rows // cell_rows))))
        chosen = kept.dropDuplicates(["v"]).orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(many).select("v").collect()
        self.pivots = np.zeros((len(chosen), width))
        for i, r in enumerate(chosen):
            self.pivots[i, : len(r.v) // 8] = np.frombuffer(bytes(r.v), "<f8")
        sent = kept.sparkSession.sparkContext.broadcast(self.pivots)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p = sent.value
            for batch in batches:
                if batch.num_rows:
                    m = _matrix(batch.column("v"), width)
                    with np.errstate(all="ignore"):
                        far = np.sqrt(np.maximum((m**2).sum(1)[:, None] - 2 * m @ p.T + (p**2).sum(1), 0))
                        cell = np.where(np.isnan(far), np.inf, far).argmin(1)
                        size = np.sqrt((m**2).sum(1))
                        angle = _angle(m, p)[np.arange(len(m)), cell]
                    far = np.sqrt(((m - p[cell]) ** 2).sum(1))  # computed anew, without cancellation
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "q", "v")), pa.array(cell, pa.int32()), pa.array(far), pa.array(size), pa.array(angle)], ["vec_id", "q", "v", "cell", "far", "size", "angle"])

        assigned = written(in_arrow(kept, assign, "vec_id long, q boolean, v binary, cell int, far double, size double, angle double"), "knn-cells")
        summary = assigned.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.max("size").alias("size"), F.max("angle").alias("angle"))
        by_cell = {r.cell: r for r in summary.collect()}  # a row a cell
        get = lambda name, none: np.array([by_cell[i][name] if i in by_cell else none for i in range(len(self.pivots))])
        self.n, self.far, self.size, self.angle = get("n", 0), get("far", 0.0), get("size", 0.0), get("angle", 0.0)
        self.parts = np.maximum(1, -(-self.n // block_rows))
        parts = kept.sparkSession.createDataFrame([(i, int(x)) for i, x in enumerate(self.parts)], "cell int, parts int")
        self.rows = assigned.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.col("parts").cast("long")).cast("int"))
        self.queries = assigned.where("q").dropDuplicates(["vec_id"]).select(F.col("vec_id").alias("query_id"), "v", "cell")

    def bounds(self, m: np.ndarray) -> np.ndarray:
        """For each query the highest score that any row of each cell can have."""
        with np.errstate(all="ignore"):
            size = np.sqrt((m**2).sum(1))[:, None]
            ball = m @ self.pivots.T + size * self.far
            cone = size * self.size * np.cos(np.maximum(_angle(m, self.pivots) - self.angle, 0))
            return np.where(self.n > 0, np.fmin(ball, cone), -np.inf)


def _angle(m: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Angles between rows; those of a zero vector are zero, which rules nothing out wrongly: its scores are zero."""
    with np.errstate(all="ignore"):
        cos = (m @ p.T) / (np.sqrt((m**2).sum(1))[:, None] * np.sqrt((p**2).sum(1)))
    return np.where(np.isfinite(cos), np.arccos(np.clip(cos, -1, 1)), 0.0)


def _solved(asked: DataFrame, cells: Cells, k: int, group_queries: int, seed: int) -> DataFrame:
    """asked(query_id, v, cell): the k best rows of the cell for each of its queries; blocks of queries meet blocks of rows."""
    width = cells.width
    counted = written(asked, "knn-asked")
    sizes = counted.groupBy("cell").agg(F.ceil(F.count("*") / group_queries).cast("int").alias("groups"))
    parts = asked.sparkSession.createDataFrame([(i, int(x)) for i, x in enumerate(cells.parts)], "cell int, parts int")
    sizes = sizes.join(F.broadcast(parts), "cell")  # a row a cell
    left = counted.join(F.broadcast(sizes), "cell").withColumn("grp", F.pmod(F.xxhash64(F.lit(seed), "query_id"), F.col("groups").cast("long")).cast("int"))
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("cell", "grp", "part", "query_id", "v")
    right = cells.rows.select("cell", "part", "vec_id", "v").join(F.broadcast(sizes.select("cell", "groups")), "cell")
    right = right.withColumn("grp", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).select("cell", "grp", "part", "vec_id", "v")

    def solve(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        ids, others = (t.column(c).to_numpy() for t, c in ((left, "query_id"), (right, "vec_id")))
        order = np.argsort(others, kind="stable")
        others = others[order]
        a, b = (_matrix(t.column("v").combine_chunks(), width) for t in (left, right))
        b, out = b[order], []
        for at in range(0, len(ids), 512):
            scores = exact_products(a[at : at + 512], b)
            for i, row in enumerate(scores):
                able = others != ids[at + i]
                keys, who = row[able], others[able]
                if len(keys) > k:
                    least = np.partition(keys, len(keys) - k)[len(keys) - k]
                    sure = np.flatnonzero(keys > least)
                    take = np.append(sure, np.flatnonzero(keys == least)[: k - len(sure)])  # others ascend: ties to smaller ids
                    keys, who = keys[take], who[take]
                out.append(np.stack([np.full(len(keys), ids[at + i]), who, keys]))
        got = np.concatenate(out, 1)
        return pa.table({n: pa.array(got[i], pa.int64()) for i, n in enumerate(names)})

    keys = ["cell", "grp", "part"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(solve, "query_id long, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _joined(vectors: DataFrame, is_query, k: int, scale: float, group_queries: int, block_rows: int, cell_rows: int, most_cells: int, seed: int) -> tuple[DataFrame, DataFrame, Cells] | None:
    """(rows found in the own cells, further (query_id, v, cell) to ask, cells); None without queries."""
    kept = _prepared(vectors, is_query, scale)
    stats = kept.agg(F.count_if("q").alias("queries"), F.count("*").alias("rows"), F.max("n").alias("width")).first()
    if not stats.queries:
        return None
    cells = Cells(kept, stats.rows, stats.width, cell_rows, most_cells, block_rows, seed)
    home = written(_ranked(_solved(cells.queries, cells, k, group_queries, seed), k), "knn-home")
    floors = home.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    cells_sent = vectors.sparkSession.sparkContext.broadcast((cells.pivots, cells.n, cells.far, cells.size, cells.angle))
    width = cells.width

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Cells.__new__(Cells)
        known.pivots, known.n, known.far, known.size, known.angle = cells_sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                m = _matrix(some.column("v"), width)
                floor = np.array([-np.inf if x is None else float(x) for x in some.column("floor").to_pylist()])
                reach = known.bounds(m)
                with np.errstate(all="ignore"):  # bounds that overflow decide nothing: such queries go everywhere
                    able = ~(reach + 1e-9 * (np.abs(reach) + 1) < floor[:, None]) & (known.n > 0)
                able[np.arange(len(m)), some.column("cell").to_numpy()] = False  # solved already
                row, cell = np.nonzero(able)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([some.column("query_id").take(take), some.column("v").take(take), pa.array(cell, pa.int32())], ["query_id", "v", "cell"])

    asked = in_arrow(cells.queries.join(floors, "query_id", "left"), spread, "query_id long, v binary, cell int")
    return home, asked, cells


def top_k(vectors: DataFrame, is_query, k: int = 20, scale: float = 64.0, group_queries: int = 2048, block_rows: int = 16384, cell_rows: int = 1024, most_cells: int = 4096, seed: int = 0) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query with every other row.

    vectors(vec_id, embedding); is_query is a condition on vec_id. Ties go to the smaller vec_id. A vector that is null or
    holds a null or non-finite component takes no part; shorter vectors count as padded by zeros. A row is not its own
    candidate, and neither is another row with the same vec_id. Repeated rows are candidates of their own, and repeated
    query rows answer once. Rows with a null vec_id take no part. Fewer than k others give fewer rows; scores beyond 64
    bits are held at the limit. Other columns are not read; no rows give no rows.

    There is about a cell for cell_rows rows, most_cells at most, which bounds pivots and summaries; a cell of more than
    block_rows rows is solved in parts, so no task holds more than that many rows and group_queries queries.
    """
    got = _joined(vectors, is_query, k, scale, group_queries, block_rows, cell_rows, most_cells, seed)
    if got is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    home, asked, cells = got
    found = home.select("query_id", "vec_id", "score").unionByName(_solved(asked, cells, k, group_queries, seed))
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")


def cells_asked(vectors: DataFrame, is_query, k: int = 20, scale: float = 64.0, group_queries: int = 2048, block_rows: int = 16384, cell_rows: int = 1024, most_cells: int = 4096, seed: int = 0) -> DataFrame:
    """query_id, n_cells, n_rows: how many cells, and rows in them, each query of top_k is compared with."""
    got = _joined(vectors, is_query, k, scale, group_queries, block_rows, cell_rows, most_cells, seed)
    if got is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, n_cells long, n_rows long")
    _, asked, cells = got
    sizes = vectors.sparkSession.createDataFrame([(i, int(n)) for i, n in enumerate(cells.n)], "cell int, n long")
    every = asked.select("query_id", "cell").unionByName(cells.queries.select("query_id", "cell"))
    return every.join(F.broadcast(sizes), "cell").groupBy("query_id").agg(F.count("*").alias("n_cells"), F.sum("n").alias("n_rows"))
