"""Which of many phrases a text holds: a trie over words, walked once over each text from all its words in step."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Trie:
    """Phrases of words joined by one blank. Edges lie in one sorted array, so all walks of a batch take a step together."""

    def __init__(self, phrases: Iterable[str]):
        self.phrases = sorted({p for p in phrases if p})
        parts = [p.split(" ") for p in self.phrases]
        self.words = pa.array(sorted({w for p in parts for w in p}), pa.string())
        number = {w: i for i, w in enumerate(self.words.to_pylist())}
        children: dict[tuple[int, int], int] = {}
        self.longest, ends = max(map(len, parts), default=0), {}
        for i, words in enumerate(parts):
            node = 0
            for w in words:
                node = children.setdefault((node, number[w]), len(children) + 1)
            ends[node] = i
        size = max(1, len(number))
        edges = sorted((node * size + w, child) for (node, w), child in children.items())
        self.size, self.edges, self.child = size, np.array([e for e, _ in edges], np.int64), np.array([c for _, c in edges], np.int64)
        self.phrase = np.full(len(children) + 1, -1)
        for node, i in ends.items():
            self.phrase[node] = i

    def walk(self, codes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, phrase) of every place where a phrase begins: codes of the words in a row (-1: in no phrase), and the
        number of the text that each belongs to."""
        start = at = np.flatnonzero(codes >= 0)
        node = np.zeros(len(at), np.int64)
        texts, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(at) and len(self.edges):
            wanted = node * self.size + codes[at]
            edge = np.minimum(np.searchsorted(self.edges, wanted), len(self.edges) - 1)
            alive = self.edges[edge] == wanted
            start, at, node = start[alive], at[alive], self.child[edge[alive]]
            ended = self.phrase[node] >= 0
            texts.append(text[start[ended]])
            found.append(self.phrase[node[ended]])
            inside = at + 1 < len(codes)
            start, at, node = start[inside], at[inside] + 1, node[inside]
            same = (text[at] == text[start]) & (codes[at] >= 0)
            start, at, node = start[same], at[same], node[same]
        return np.concatenate(texts), np.concatenate(found)

    def found(self, words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, phrase, times) of a column of word lists, by text and phrase."""
        offsets = words.offsets.to_numpy()
        codes = pc.index_in(words.flatten().cast(pa.string()), value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = np.where(words.is_null().to_numpy(zero_copy_only=False), 0, np.diff(offsets))
        text, phrase = self.walk(codes, np.repeat(np.arange(len(words)), sizes))
        keys, times = np.unique(text * max(1, len(self.phrases)) + phrase, return_counts=True)
        return keys // max(1, len(self.phrases)), keys % max(1, len(self.phrases)), times


def held(words: Column, phrases: Iterable[str]) -> Column:
    """Which of the phrases, whole words only, are in a list of words: an array in the phrases' order. One pass a text,
    whatever the number of phrases; null words give an empty array."""
    trie = Trie(phrases)

    @F.arrow_udf("array<string>")
    def walk(column: pa.Array) -> pa.Array:
        text, phrase, _ = trie.found(column)
        offsets = np.searchsorted(text, np.arange(len(column) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(trie.phrases, pa.string()).take(pa.array(phrase)))

    return walk(words)


def hits(texts: DataFrame, key: str, words: str, phrases: Iterable[str]) -> DataFrame:
    """(key, term, times): how often each of the phrases is in the list of words of each row; no row where it is not."""
    trie = Trie(phrases)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, phrase, times = trie.found(pa.concat_arrays([batch.column(1)]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), pa.array(trie.phrases, pa.string()).take(pa.array(phrase)), pa.array(times)], [key, "term", "times"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, words).mapInArrow(walk, f"{key} {kind}, term string, times long")
