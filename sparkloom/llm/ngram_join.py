"""Exact Jaccard join of word n-gram sets through prefix trees.

All sets are ordered the same way: n-grams that very many documents hold come last, the others by hash. Two sets with
Jaccard similarity t must share one of the first |x| - ceil(t|x|) + 1 elements, so sets meet by the elements of these
prefixes. A pair that met is a candidate unless its sizes, or the counts of its elements in hash buckets, already show
that too much differs; both tests are bounds, so no link is lost. Candidates fall into clusters. A cluster's sets meet
once, in a trie: a search walks it sharing the overlap of common beginnings and leaves a subtree when what remains of
either set cannot reach the overlap needed. Clusters of more than `block` sets are compared in pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, in_arrow, key_runs, map_batches, run_bounds, utf8, written
from .shingles import set_print, shingle_set

FEWEST, MOST = 64, 4096  # hash buckets in which a set's elements are counted


def spread_of(elements: np.ndarray) -> np.ndarray:
    """Counts of the elements in hash buckets: more buckets for larger sets, about sixteen elements each. Buckets go by
    the highest bits, so two neighbouring buckets add up to one of a coarser count. A count stops at 255, which can only
    lower the difference between two sets."""
    buckets = FEWEST
    while buckets < MOST and buckets * 16 < len(elements):
        buckets *= 4
    shift = np.uint64(64 - buckets.bit_length() + 1)
    return np.minimum(np.bincount((elements >> shift).astype(np.int64), minlength=buckets), 255).astype(np.uint8)


def spreads(raw: list[bytes], buckets: int) -> np.ndarray:
    """Counts side by side, added up to the given number of buckets or fewer."""
    out = np.empty((len(raw), buckets), np.int32)
    for i, x in enumerate(raw):
        out[i] = np.frombuffer(x, np.uint8).reshape(buckets, -1).sum(1)
    return out


def common_ngrams(docs: DataFrame, n: int, least: int = 16, most: int = 1 << 18) -> Broadcast:
    """Sorted n-grams held by many documents: at least `least` among those counted, and the `most` commonest of them.

    Batches report n-grams that two of their documents hold. The list only orders elements (any list gives exact
    results), so it may be cut; its size bounds what is collected and broadcast.
    """

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        every = np.sort(np.concatenate([shingle_set(t, n) for t in utf8(batch.column("text"))]))
        starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])[: len(every)])
        counts = np.diff(np.append(starts, len(every)))
        kept = counts >= 2
        return pa.RecordBatch.from_arrays([pa.array(every[starts][kept].astype(np.int64)), pa.array(counts[kept], pa.int64())], ["g", "n"])

    counted = map_batches(docs.select("text"), count, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    found = counted.orderBy(F.desc("n"), "g").limit(most).select("g").toArrow().column("g").to_numpy().astype(np.int64).view(np.uint64)
    return docs.sparkSession.sparkContext.broadcast(np.sort(found))


def prefix(elements: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    """The elements by one of which every set similar enough to this sorted set is met."""
    length = len(elements) - -(-percent * len(elements) // 100) + 1
    if not len(common):
        return elements[:length]
    at = np.minimum(np.searchsorted(common, elements), len(common) - 1)
    late = common[at] == elements
    return np.concatenate([elements[~late], elements[late]])[:length]


class Node:
    """A stretch of elements in a radix tree of sorted arrays. low and high: the least and the greatest number of elements
    that sets have below the stretch. of: the class of all sets below, or -1 when they are of several."""

    __slots__ = ("stretch", "children", "ending", "low", "high", "of")

    def __init__(self, stretch: np.ndarray, children: dict, ending: list[int], low: int, high: int, of: int):
        self.stretch, self.children, self.ending, self.low, self.high, self.of = stretch, children, ending, low, high, of


class Trie:
    """Sorted sets in a radix tree; a search leaves out sets of the searcher's own class."""

    def __init__(self):
        self.root: Node | None = None

    def add(self, elements: np.ndarray, number: int, of: int) -> None:
        if self.root is None:
            self.root = Node(elements[:0], {}, [], len(elements), len(elements), of)
        node, rest = self.root, elements
        while True:
            node.low, node.high = min(node.low, len(rest)), max(node.high, len(rest))
            node.of = of if node.of == of else -1
            if not len(rest):
                node.ending.append(number)
                return
            child = node.children.get(int(rest[0]))
            if child is None:
                node.children[int(rest[0])] = Node(rest, {}, [number], 0, 0, of)
                return
            n = min(len(child.stretch), len(rest))
            differ = np.flatnonzero(child.stretch[:n] != rest[:n])
            same = int(differ[0]) if len(differ) else n
            if same < len(child.stretch):
                tail = child.stretch[same:]
                lower = Node(tail, child.children, child.ending, child.low, child.high, child.of)
                child.stretch, child.children, child.ending = child.stretch[:same], {int(tail[0]): lower}, []
                child.low, child.high = child.low + len(tail), child.high + len(tail)
            node, rest = child, rest[same:]

    def search(self, elements: np.ndarray, of: int, percent: int) -> list[int]:
        """Numbers of the sets of other classes whose similarity with elements is at least percent / 100."""
        out, size = [], len(elements)
        stack = [(self.root, 0, 0, 0)] if self.root is not None else []  # node, overlap and elements above it, how far the searched set is used up
        while stack:
            node, overlap, depth, at = stack.pop()
            if node.of == of:
                continue
            stretch = node.stretch
            if len(stretch):
                end = int(np.searchsorted(elements, stretch[-1], side="right"))
                mine = elements[at:end]
                if len(mine):
                    where = np.searchsorted(mine, stretch)
                    where[where == len(mine)] = 0
                    overlap += int((mine[where] == stretch).sum())
                depth, at = depth + len(stretch), end
            if (100 + percent) * overlap >= percent * (size + depth):
                out.extend(node.ending)
            if node.children:
                # Below, the overlap grows by what either has left; of all lengths below, the one nearest to what the
                # searched set has left can reach most.
                left = size - at
                below = min(max(left, node.low), node.high)
                if (100 + percent) * (overlap + min(left, below)) >= percent * (size + depth + below):
                    stack.extend((child, overlap, depth, at) for child in node.children.values())
        return out


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    where = np.minimum(np.searchsorted(x, y), len(x) - 1)
    return (100 + percent) * int((x[where] == y).sum()) >= percent * (len(x) + len(y))


def similar_pairs(sets: list[np.ndarray], others: list[np.ndarray] | None, percent: int, leaders: int = 16) -> np.ndarray:
    """Links that connect whatever is linked within sets (others None), or between sets and others, numbered on.

    Near copies are first put to one of a few leaders; the trie then only has to find links between different classes, so
    a large group of near copies costs little more than one comparison a set.
    """
    every = [*sets, *(others or ())]
    heads, of, pairs = [], np.arange(len(every)), []
    for number, elements in enumerate(every):
        for head in heads:
            if alike(every[head], elements, percent):
                of[number] = head
                pairs.append((head, number))
                break
        else:
            if len(heads) < leaders:
                heads.append(number)
    if len(np.unique(of)) > 1:
        trie = Trie()
        for number, elements in enumerate(sets):
            if others is None:
                pairs.extend((number, found) for found in trie.search(elements, int(of[number]), percent))
            trie.add(elements, number, int(of[number]))
        for number, elements in enumerate(others or (), len(sets)):
            pairs.extend((found, number) for found in trie.search(elements, int(of[number]), percent))
    return np.array(pairs, np.int64).reshape(-1, 2)


def jaccard_classes(docs: DataFrame, n: int = 3, percent: int = 90, pair_run: int = 64, block: int = 1024, broadcast_rows: int = 1 << 19) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_shingles, component_id, mark (the xxhash64 of id and text) and
    class_row, a number that the rows of a component share.

    Rows link when 100 * shared >= percent * joint shingles; component_id is the smallest doc_id reached by links. A null
    or empty text, or one without words, has no shingles, links with nothing and is its own component. Repeated rows are
    linked copies. A null doc_id keeps its row and its links but names a component only when nothing else does. Other
    columns are not read. No rows give no rows; a text of any length is one set of all its shingles, held in a task. Sets that meet by one element are all paired up to pair_run sets; longer runs are compared in
    blocks. Neither that nor the blocks of a cluster leave out a link. Up to broadcast_rows clustered sets are looked up in
    the texts by broadcast; beyond, by a shuffled join.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    common = common_ngrams(docs, n)

    def describe(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [shingle_set(t, n) for t in utf8(batch.column("text"))]
        prints = [set_print(s) if len(s) else (None, None) for s in made]
        keys = [prefix(s, common.value, percent).astype(np.int64) for s in made]
        spread = [spread_of(s).tobytes() for s in made]
        offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])))
        arrays = [*(batch.column(c) for c in ("row", "mark", "doc_id")), pa.array([len(s) for s in made], pa.int64()), *(pa.array([p[k] for p in prints], pa.int64()) for k in (0, 1)), pa.array(spread, pa.binary()), lists]
        return pa.RecordBatch.from_arrays(arrays, ["row", "mark", "doc_id", "n_shingles", "fp", "fp2", "spread", "keys"])

    same_set, seed = ["fp", "fp2", "n_shingles"], 0
    while True:
        # Rows with the same id and text share a number; so may, once in very many rows, two others: then all are numbered anew.
        numbered = docs.withColumn("row", F.xxhash64(F.lit(seed), "doc_id", "text"))
        described = map_batches(numbered.withColumn("mark", F.xxhash64("doc_id", "text")), describe, "row long, mark long, doc_id long, n_shingles long, fp long, fp2 long, spread binary, keys array<long>")
        described = written(described, "ngram-sets")
        # Equal sets are one class, spoken for by the row with the smallest number.
        classes = described.where("fp is not null").groupBy(*same_set).agg(F.min("row").alias("speaker"), F.min("doc_id").alias("least"))
        classes = written(classes, "ngram-classes")
        if classes.groupBy("speaker").count().where("count > 1").isEmpty():
            break
        seed += 1
    speakers = described.join(classes.select(F.col("speaker").alias("row")), "row").groupBy("row").agg(*(F.first(c).alias(c) for c in ("n_shingles", "spread", "keys")))
    keyed = speakers.select("row", F.col("n_shingles").cast("int").alias("size"), F.posexplode("keys").alias("place", "key"))
    pairs = written(_met(keyed, percent, pair_run), "ngram-pairs")
    candidates = _able(pairs.where("paired"), speakers, percent).union(_crowded(pairs.where("not paired"), speakers, percent))
    clusters = connected_components(candidates).select(F.col("node").alias("row"), F.col("component").alias("cluster"))
    clusters = written(clusters, "ngram-clusters")
    linked = connected_components(_verified(numbered, clusters, n, percent, block, broadcast_rows))
    named = classes.join(linked, F.col("speaker") == F.col("node"), "left").withColumn("class", F.coalesce("component", "speaker"))
    smallest = named.groupBy("class").agg(F.min("least").alias("component_id"))
    ids = named.join(smallest, "class").select(*same_set, "component_id", F.col("class").alias("class_row"))
    mine = described.where("fp is not null").select("mark", "doc_id", *same_set).join(ids, same_set).select("doc_id", "n_shingles", "component_id", "mark", "class_row")
    alone = described.where("fp is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "mark", F.col("row").alias("class_row"))
    return mine.union(alone)


def _met(keyed: DataFrame, percent: int, pair_run: int) -> DataFrame:
    """(a, b, paired): pairs of rows that share a key; for a run of more than pair_run rows, not paired, each row and the key.

    size is a set's size, place where the key stands in its order. Two sets that share the element at places i and j share
    at most min(i, j) before it and what is left of the shorter rest; pairs whose sizes or places rule out the similarity
    are left out here.
    """

    def able(n: np.ndarray, m: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        most = np.minimum(i, j) + np.minimum(n - i, m - j)
        return (100 + percent) * most >= percent * (n + m)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in key_runs(batches, ["key"]):
            row, size, place = (whole.column(c).to_numpy().astype(np.int64) for c in ("row", "size", "place"))
            bounds = run_bounds(whole, ["key"])
            sizes = np.diff(bounds)
            found = []
            for many in np.unique(sizes[(sizes > 1) & (sizes <= pair_run)]).tolist():
                i, j = np.triu_indices(many, 1)
                at = bounds[:-1][sizes == many]
                for some in np.array_split(at, max(1, len(at) * len(i) >> 20)):
                    x, y = (some[:, None] + i).ravel(), (some[:, None] + j).ravel()
                    fit = able(size[x], size[y], place[x], place[y])
                    x, y = row[x[fit]], row[y[fit]]
                    found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], 1))
            crowded = np.repeat(sizes > pair_run, sizes)
            keys = whole.column("key").to_numpy()
            for paired, parts in ((True, found), (False, [np.stack([row[crowded], keys[crowded]], 1)])):
                if parts:
                    got = np.unique(np.concatenate(parts), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1]), pa.array(np.full(len(got), paired))], ["a", "b", "paired"])

    dealt = keyed.repartition("key").sortWithinPartitions("key", "size", "row")
    return in_arrow(dealt, meet, "a long, b long, paired boolean").distinct()


def _crowded(rows: DataFrame, speakers: DataFrame, percent: int, most: int = 1 << 14) -> DataFrame:
    """(a, b): of the rows (a row, b key) of long runs, links that connect all pairs that sizes and bucket counts allow.

    A run is compared in blocks and in order of size, and only a spanning forest of what is allowed leaves it. A run of more
    than `most` rows is chained untested as far as neighbours' sizes allow a link: its rows then share a cluster.
    """
    of = rows.select(F.col("a").alias("row"), F.col("b").alias("key")).join(speakers.select("row", F.col("n_shingles").alias("size"), "spread"), "row")
    dealt = of.repartition("key").sortWithinPartitions("key", "size", "row")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in key_runs(batches, ["key"]):
            row, size = (whole.column(c).to_numpy() for c in ("row", "size"))
            spread = whole.column("spread").to_pylist()
            names, number = np.unique(row, return_inverse=True)
            of = np.arange(len(names))  # classes so far: what earlier runs have linked needs no comparison in this one
            bounds = run_bounds(whole, ["key"])
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if b - a > most:
                    near = np.flatnonzero(percent * size[a + 1 : b] <= 100 * size[a : b - 1])
                    pairs = np.stack([near, near + 1], 1)
                else:
                    pairs = _allowed(spread[a:b], size[a:b], of[number[a:b]], percent)
                if len(pairs):
                    _merge(of, number[a + pairs])
            linked = np.flatnonzero(of != np.arange(len(of)))
            yield pa.RecordBatch.from_arrays([pa.array(names[linked]), pa.array(names[of[linked]])], ["a", "b"])

    return in_arrow(dealt, compare, "a long, b long").distinct()


def _allowed(spread: list[bytes], size: np.ndarray, of: np.ndarray, percent: int) -> np.ndarray:
    """Pairs of rows, in order of size, that sizes and bucket counts allow; at least one for any two classes in `of`
    that some allowed pair joins, none within a class."""
    classes, counts = np.unique(of, return_counts=True)
    if len(classes) == 1:
        return np.zeros((0, 2), np.int64)
    parts = [np.zeros((0, 2), np.int64)]
    rest = np.flatnonzero(of != classes[counts.argmax()])  # each pair of two classes has an end outside the largest one
    low, high = np.searchsorted(size, -(-percent * size // 100)), np.searchsorted(size, 100 * size // percent, side="right")
    for some in np.array_split(rest, -(-len(rest) // 64)):
        for at in range(int(low[some[0]]), int(high[some[-1]]), 512):
            stop = min(at + 512, int(high[some[-1]]))
            mine, others = [spread[i] for i in some], spread[at:stop]
            buckets = min(map(len, mine + others))
            x, y = spreads(mine, buckets), spreads(others, buckets)
            apart = np.stack([np.abs(row - y).sum(1) for row in x])
            able = (100 + percent) * apart <= (100 - percent) * (size[some, None] + size[None, at:stop])
            i, j = np.nonzero(able & (of[some, None] != of[None, at:stop]))
            parts.append(np.stack([some[i], at + j], 1))
    return np.concatenate(parts)


def _merge(of: np.ndarray, pairs: np.ndarray) -> None:
    """Put the classes that pairs join together, under their smallest number."""
    a, b = of[pairs[:, 0]], of[pairs[:, 1]]
    ends, local = np.unique(np.concatenate([a, b]), return_inverse=True)
    links = np.unique(local.reshape(2, -1).T, axis=0)
    roots = np.arange(len(ends))
    while True:
        before = roots.copy()
        np.minimum.at(roots, links[:, 0], roots[links[:, 1]])
        np.minimum.at(roots, links[:, 1], roots[links[:, 0]])
        if (before == roots).all():
            break
    at = np.searchsorted(ends, of)
    at[at == len(ends)] = 0
    hit = ends[at] == of
    of[hit] = ends[roots[at[hit]]]


def _able(pairs: DataFrame, speakers: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes and bucket counts leave the similarity possible."""
    of = speakers.select("row", "n_shingles", "spread")
    a, b = (of.select(F.col("row").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("spread").alias(f"s_{x}")) for x in "ab")
    joined = pairs.select("a", "b").join(a, "a").where(F.col("n_a") > 0).join(b, "b")
    joined = joined.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

    def test(batch: pa.RecordBatch) -> pa.RecordBatch:
        left, right = (batch.column(c).to_pylist() for c in ("s_a", "s_b"))
        coarse = np.array([min(len(x), len(y)) for x, y in zip(left, right, strict=True)])
        sizes = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
        able = np.zeros(len(coarse), bool)
        for buckets in np.unique(coarse).tolist():
            for some in np.array_split(np.flatnonzero(coarse == buckets), -(-len(coarse) * buckets // (1 << 20))):
                x, y = (spreads([side[i] for i in some], buckets) for side in (left, right))
                able[some] = (100 + percent) * np.abs(x - y).sum(1, dtype=np.int64) <= (100 - percent) * sizes[some]
        return pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(able)) for c in "ab"], ["a", "b"])

    return map_batches(joined, test, "a long, b long")


def _verified(numbered: DataFrame, clusters: DataFrame, n: int, percent: int, block: int, broadcast_rows: int) -> DataFrame:
    """(a, b): links that connect what is linked in each cluster, found by trie search over whole sets."""
    sizes = clusters.groupBy("cluster").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    placed = clusters.join(sizes, "cluster").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts").cast("long")).cast("int"))

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [shingle_set(t, n).tobytes() for t in utf8(batch.column("text"))]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "cluster", "part", "parts")), pa.array(made, pa.binary())], ["row", "cluster", "part", "parts", "set"])

    if clusters.limit(broadcast_rows + 1).count() <= broadcast_rows:  # else both sides are shuffled, texts included
        placed = F.broadcast(placed)
    carried = map_batches(numbered.join(placed, "row").select("row", "cluster", "part", "parts", "text"), sets, "row long, cluster long, part int, parts int, set binary")
    paired = carried.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    paired = paired.select("row", "cluster", "part", "set", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    keys = ["cluster", "low", "high"]
    dealt = paired.repartition(*keys).sortWithinPartitions(*keys, "row")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in key_runs(batches, keys):
            row, part, low, high = (whole.column(c).to_numpy() for c in ("row", "part", "low", "high"))
            raw, out = whole.column("set").to_pylist(), []
            bounds = run_bounds(whole, keys)
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                members = [i for i in range(a, b) if i == a or row[i] != row[i - 1]]
                if low[a] == high[a]:
                    left, right = members, None
                else:
                    left, right = ([i for i in members if part[i] == x] for x in (low[a], high[a]))
                got = similar_pairs([np.frombuffer(raw[i], np.uint64) for i in left], None if right is None else [np.frombuffer(raw[i], np.uint64) for i in right], percent)
                if len(got):
                    of = row[np.array(left + (right or []))]
                    out.append(of[_forest(len(of), got)])
            if out:
                links = np.concatenate(out)
                yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

    return in_arrow(dealt, join, "a long, b long")


def _forest(n: int, pairs: np.ndarray) -> np.ndarray:
    """Links from each linked member to the smallest of its class: a spanning forest instead of all pairs."""
    roots = np.arange(n)
    while True:
        before = roots.copy()
        np.minimum.at(roots, pairs[:, 0], roots[pairs[:, 1]])
        np.minimum.at(roots, pairs[:, 1], roots[pairs[:, 0]])
        if (before == roots).all():
            break
    linked = np.flatnonzero(roots != np.arange(n))
    return np.stack([linked, roots[linked]], 1)
