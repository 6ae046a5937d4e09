"""Toxicity by cumulative-link ordinal regression on sparse text features.

Severity grades are ordered: 0 is clean, higher is worse. One weight vector serves all thresholds: the chance of grade k or
worse is the logistic of (score - threshold k), and thresholds rise. Features are words and their first letters (whole
words, and prefixes of 4 to 6 letters), counted with a logarithm, hashed, and chosen by how much likelier they are in
toxic documents. The expected severity is the sum of the chances over all thresholds.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, map_batches, written

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)
MASK = (1 << 30) - 1


def word_features(word: str) -> tuple[int, ...]:
    names = [word, *(f"^{word[:n]}" for n in PREFIXES if len(word) >= n)]
    return tuple(dict.fromkeys(xxhash.xxh32_intdigest(x) & MASK for x in names))


class WordCache(dict):
    """word -> its features (those in `chosen`, if given); emptied when it has grown large."""

    def __init__(self, chosen: dict[int, int] | None = None, most: int = 200_000):
        super().__init__()
        self.chosen, self.most = chosen, most

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.clear()
        found = word_features(word)
        if self.chosen is not None:
            found = tuple(self.chosen[f] for f in found if f in self.chosen)
        self[word] = found
        return found


def hits(cache: WordCache, text: str | None) -> Counter:
    """How often each feature occurs in the whole text."""
    found: Counter = Counter()
    for features in filter(None, map(cache.__getitem__, WORD.findall((text or "").lower()))):
        found.update(features)
    return found


class SeverityModel:
    """chosen: feature -> column; weights by column; rising thresholds, one fewer than there are grades."""

    def __init__(self, chosen: dict[int, int], weights: np.ndarray, thresholds: np.ndarray):
        self.chosen, self.weights, self.thresholds = chosen, weights, thresholds

    def chances(self, counts: Counter) -> np.ndarray:
        """The chance of each grade from 1 on, or worse."""
        score = sum(self.weights[c] * np.log1p(n) for c, n in counts.items())
        return 1 / (1 + np.exp(np.clip(self.thresholds - score, -50, 50)))


def fit(docs: DataFrame, labels: DataFrame, grades: int = 4, max_rows: int = 20_000, max_features: int = 4096, min_docs: int = 4, ridge: float = 1e-3, steps: int = 400, seed: int = 0) -> SeverityModel:
    """Fit on docs(doc_id, text) and labels(doc_id, toxic).

    At most about max_rows labelled rows are used, drawn by a hash of doc_id (all of them where there are fewer); that and
    max_features bound what reaches the driver, where the convex fit runs. Grades of toxic rows are the thirds (for four
    grades) of how many of their words carry a chosen feature; a labels column `grade` (0 clean .. grades-1) is used
    instead where there is one. Null labels and labels without a document are left out. Without toxic rows,
    or without any rows, everything is scored clean. Texts of any length are read whole; repeated rows count as often as they
    come, and rows with one doc_id share its labels.
    """
    spark = docs.sparkSession
    given = "grade" in labels.columns
    kept = labels.select(F.col("doc_id").cast("long"), (F.col("grade") if given else F.when(F.col("toxic") > 0, 1).when(F.col("toxic") == 0, 0)).cast("int").alias("grade")).where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.max("grade").alias("grade"))
    n = kept.count()
    share = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40)) < int(min(1.0, max_rows / max(n, 1)) * (1 << 40))
    sample = F.broadcast(kept.where(share))  # bounded by max_rows
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(sample, "doc_id").select("text", "grade")
    rows = written(rows, "labelled-sample")  # docs are read once; the passes below read the sample

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCache()
        for batch in batches:
            clean, toxic = Counter(), Counter()
            for text, grade in zip(batch.column("text").to_pylist(), batch.column("grade").to_pylist(), strict=True):
                (toxic if grade else clean).update(hits(cache, text).keys())
            keys = list(clean.keys() | toxic.keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([clean[k] for k in keys], pa.int64()), pa.array([toxic[k] for k in keys], pa.int64())], ["f", "clean", "toxic"])

    split = {r.grade: r.n for r in rows.groupBy((F.col("grade") > 0).cast("int").alias("grade")).agg(F.count("*").alias("n")).collect()}
    n_clean, n_toxic = split.get(0, 0), split.get(1, 0)
    if not n_toxic:
        return SeverityModel({}, np.zeros(0), np.full(grades - 1, 50.0))
    counted = in_arrow(rows, count, "f long, clean long, toxic long").groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    lift = F.log(((F.col("toxic") + 0.5) / (n_toxic + 1)) / ((F.col("clean") + 0.5) / (n_clean + 1)))
    useful = counted.where(F.col("toxic") >= min_docs).withColumn("gain", F.col("toxic") * lift).where(lift > 1.5)
    best = useful.orderBy(F.desc("gain"), "f").limit(max_features).select("f").collect()
    chosen = {r.f: i for i, r in enumerate(best)}

    def lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCache(chosen)
        for batch in batches:
            found = [hits(cache, t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.array([list(c) for c in found], pa.list_(pa.int32())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))], ["grade", "f", "n"])

    table = in_arrow(rows, lookup, "grade int, f array<int>, n array<int>").toArrow()
    sizes = np.array([len(x) for x in table.column("f").to_pylist()])
    row = np.repeat(np.arange(len(sizes)), sizes)
    column = np.array([c for x in table.column("f").to_pylist() for c in x], np.int64)
    count_of = np.array([c for x in table.column("n").to_pylist() for c in x], np.float64)
    grade = table.column("grade").to_numpy().astype(np.int64)
    if not given:
        marked = np.bincount(row, count_of, len(sizes))
        toxic = grade > 0
        bars = np.quantile(marked[toxic], np.arange(1, grades - 1) / (grades - 1))
        grade[toxic] = 1 + np.searchsorted(bars, marked[toxic], side="left")
    weights, thresholds = _cumulative_link(row, column, np.log1p(count_of), np.clip(grade, 0, grades - 1), len(chosen), grades, ridge, steps)
    return SeverityModel(chosen, weights, thresholds)


def _cumulative_link(row: np.ndarray, column: np.ndarray, value: np.ndarray, grade: np.ndarray, width: int, grades: int, ridge: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that maximise the likelihood, by full-batch Adam steps. Thresholds rise by exp(gap)."""
    n = len(grade)
    params = np.concatenate([np.zeros(width), [2.0], np.zeros(grades - 2)])
    first, second = np.zeros_like(params), np.zeros_like(params)

    def thresholds_of(p: np.ndarray) -> np.ndarray:
        return p[width] + np.concatenate([[0.0], np.cumsum(np.exp(p[width + 1 :]))])

    for t in range(1, steps + 1):
        bars = thresholds_of(params)
        score = np.bincount(row, params[:width][column] * value, n)
        above = 1 / (1 + np.exp(np.clip(bars - score[:, None], -50, 50)))
        ladder = np.hstack([np.ones((n, 1)), above, np.zeros((n, 1))])
        slope = np.hstack([np.zeros((n, 1)), above * (1 - above), np.zeros((n, 1))])
        at = np.arange(n)
        chance = np.maximum(ladder[at, grade] - ladder[at, grade + 1], 1e-12)
        by_score = -(slope[at, grade] - slope[at, grade + 1]) / chance / n
        by_bar = np.zeros((n, grades + 1))
        by_bar[at, grade] += slope[at, grade] / chance / n
        by_bar[at, grade + 1] -= slope[at, grade + 1] / chance / n
        bar = by_bar[:, 1:-1].sum(0)
        gaps = np.array([bar[k + 1 :].sum() for k in range(grades - 2)]) * np.exp(params[width + 1 :])
        grad = np.concatenate([np.bincount(column, by_score[row] * value, width) + ridge * params[:width] / max(1, width) ** 0.5, [bar.sum()], gaps])
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        params -= 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return params[:width], thresholds_of(params)


def score(docs: DataFrame, model: SeverityModel, reject_at: float = 0.5) -> DataFrame:
    """The rows of docs, each with severity (expected grade), grade (the likeliest) and toxic (chance of grade 1 or worse
    is at least reject_at). A null or empty text has no features and gets the severity of a clean text. Columns of docs
    with these names are replaced; repeated rows and null ids stay as they are."""
    docs = docs.drop("severity", "grade", "toxic").withColumn("text", F.col("text").cast("string"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = sent.value
        if not hasattr(model, "cache"):
            model.cache = WordCache(model.chosen)
        chances = np.array([model.chances(hits(model.cache, t)) for t in batch.column("text").to_pylist()])
        ladder = np.hstack([np.ones((len(chances), 1)), chances, np.zeros((len(chances), 1))])
        made = [pa.array(chances.sum(1)), pa.array((ladder[:, :-1] - ladder[:, 1:]).argmax(1).astype(np.int32)), pa.array(chances[:, 0] >= reject_at)]
        return pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "severity", "grade", "toxic"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "severity double, grade int, toxic boolean"])
    return map_batches(docs, work, schema)
