"""Stated query sets against all rows, block by block inside tasks: scores in dense blocks, best rows kept as they come."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CELLS = 1 << 20  # of a block: what a task holds at once, beside its k rows a query
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def in_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches bounded by bytes as well as by rows, so what a worker reads at once does not grow with the
    texts or the parts. A session that allows more than BATCH_BYTES is set to it, and stays so, as plans read the setting
    when they run; Arrow functions that feed the same tasks (folding) keep to it too."""
    conf = df.sparkSession.conf
    allowed = re.match(r"(-?\d+)\s*([kmgtp]?)", conf.get(BATCH_SETTING).lower())
    size = int(allowed[1]) << 10 * " kmgtp".index(allowed[2] or " ")
    if not 0 < size <= BATCH_BYTES:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def spans(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(first, last) of consecutive rows that together have at most `most` elements, one row at least. ends: the number of
    elements before each row, and in all."""
    at = 0
    while at < len(ends) - 1:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield at, to
        at = to


class Best:
    """The k best (score, then smaller id) rows of each of n queries among the blocks added so far; k None keeps all."""

    def __init__(self, n: int, k: int | None, threshold: float | None = None):
        self.k, self.least = k, -np.inf if threshold is None else threshold
        self.floor = np.full(n, self.least)
        self.at, self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.more = np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray, more: np.ndarray | None = None) -> None:
        """scores: queries x rows, NaN where a row is none for a query; more: an integer to carry, as scores."""
        able = scores >= self.floor[:, None]
        if self.k is not None and scores.shape[1] > self.k:
            at = scores.shape[1] - self.k
            able &= scores >= np.partition(np.where(able, scores, -np.inf), at, axis=1)[:, at, None]
        q, row = np.nonzero(able)
        q, ids, carried = np.append(self.at, q), np.append(self.ids, ids[row]), np.append(self.more, np.zeros(len(q), np.int64) if more is None else more[q, row])
        found = np.append(self.scores, scores[able])
        if self.k is not None:
            order = np.lexsort((ids, -found, q))
            q, ids, found, carried = q[order], ids[order], found[order], carried[order]
            starts = np.flatnonzero(np.append(True, q[1:] != q[:-1])[: len(q)])
            rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
            keep = rank < self.k
            full = rank == self.k - 1
            self.floor[q[full]] = np.maximum(found[full], self.least)
            q, ids, found, carried = q[keep], ids[keep], found[keep], carried[keep]
        self.at, self.ids, self.scores, self.more = q, ids, found, carried

    def taken(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query number, id, score, carried) of all kept rows."""
        return self.at, self.ids, self.scores, self.more
