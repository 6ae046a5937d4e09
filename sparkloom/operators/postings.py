"""Term postings and term search."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources.shared import written
from .blocks import CELLS, Best, in_arrow, spans
from .ranking import top

WORDS = 1 << 19  # looked up at once


def postings(docs: DataFrame, least: int = 2) -> DataFrame:
    """term, doc_id, tf, positions, of folded words. Counted inside a document before anything is shuffled."""
    words = docs.select("doc_id", F.posexplode(text.folded_words("text", least)).alias("pos", "term"))
    return words.groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


def terms(df: DataFrame, key: str, least: int = 2) -> DataFrame:
    """Distinct (key, term) rows of folded words, made distinct inside the row."""
    return df.select(key, F.explode(F.array_distinct(text.folded_words("text", least))).alias("term"))


def bm25(queries: DataFrame, docs: DataFrame, k1: float = 1.2, b: float = 0.75, least: int = 4) -> DataFrame:
    """query_id, doc_id, score, matched: BM25 of every document that shares a term with a query. queries(query_id, text).

    Postings are cut to the terms of the queries before they are grouped; document frequencies come from the same rows.
    """
    asked = terms(queries, "query_id", least)
    words = docs.select("doc_id", text.folded_words("text", least).alias("w")).select("doc_id", "w", F.size("w").alias("len"))
    totals = words.agg(F.count("*").alias("n_docs"), F.avg("len").alias("mean"))
    found = words.select("doc_id", "len", F.explode("w").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    tf = found.groupBy("term", "doc_id", "len").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    hits = asked.join(tf, "term").join(df, "term").join(F.broadcast(totals))  # one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return hits.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"), F.count("*").alias("matched"))


def holding(queries: DataFrame, docs: DataFrame, least: int = 2, places: bool = False, most_terms: int = 1 << 19, salt: int = 0) -> DataFrame:
    """query_id, doc_id of each document that holds all terms of a query. queries(query_id, terms), docs(doc_id, text);
    terms are distinct folded words of at least `least` characters; a query without any holds nothing. places adds n, the
    number of terms, and where they stand: an array of (pos, term), by pos, term the place in the query's list from 1 on.

    Texts are folded in one scan, which writes the terms asked for that each document holds. A document is looked at for a
    query only if it holds the query's rarest term; that is done in the task, so no pair is shuffled. More than most_terms
    (query, term) rows are asked in parts, as in bm25_top; a single query is never split."""
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.posexplode("terms").alias("number", "term"))
    given = asked.limit(most_terms + 1).toArrow()
    if given.num_rows > most_terms:
        parts = min(-(-2 * asked.count() // max(1, most_terms)), asked.select("query_id").distinct().count())
        if parts > 1:
            part = F.pmod(F.xxhash64(F.col("query_id").cast("long"), F.lit(salt)), F.lit(parts))
            return reduce(DataFrame.unionByName, [holding(queries.where(part == i), docs, least, places, most_terms, salt + 1) for i in range(parts)])
        given = asked.toArrow()  # of one query
    given = given.sort_by([("query_id", "ascending"), ("number", "ascending")])
    ids, first = np.unique(given.column("query_id").to_numpy(), return_index=True)
    coded = pc.dictionary_encode(given.column("term").combine_chunks())
    terms_of, ends = coded.indices.to_numpy().astype(np.int64), np.append(first, given.num_rows)
    size = max(1, len(coded.dictionary))
    vocabulary = docs.sparkSession.sparkContext.broadcast(coded.dictionary.cast(pa.string()))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = pa.concat_arrays([batch.column("w")])
            offsets = w.offsets.to_numpy()
            for at, to in spans(offsets, WORDS):
                codes = pc.index_in(w.slice(at, to - at).flatten().cast(pa.string()), value_set=vocabulary.value)
                known, held = codes.is_valid().to_numpy(zero_copy_only=False), codes.drop_null().to_numpy()
                sizes = np.diff(offsets[at : to + 1])
                place = np.repeat(np.arange(to - at), sizes)[known]
                pos = (np.arange(len(known)) - np.repeat(offsets[at:to] - offsets[at], sizes))[known]
                if not places:
                    keys = np.unique(place * size + held)
                    place, held, pos = keys // size, keys % size, keys[:0]
                cut = np.searchsorted(place, np.arange(to - at + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(c), pa.array(x.astype(np.int32))) for c, x in ((cut, held), (cut if places else cut * 0, pos))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, to - at), *lists], ["doc_id", "terms", "pos"])

    words = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text.folded_words("text", least).alias("w"))
    words = written(in_arrow(words, code, "doc_id long, terms array<int>, pos array<int>"), "held-terms")
    sums = words.select(F.explode(F.array_distinct("terms") if places else "terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).toArrow()  # a row a term
    df = np.zeros(size, np.int64)
    df[sums.column("term").to_numpy()] = sums.column("n").to_numpy()
    rarest = np.array([terms_of[a + np.argmin(df[terms_of[a:b]])] for a, b in zip(ends, ends[1:], strict=False)], np.int64)
    by_term = np.argsort(rarest, kind="stable")
    sent = docs.sparkSession.sparkContext.broadcast((ids, terms_of, ends, by_term, np.searchsorted(rarest[by_term], np.arange(size + 1))))
    kind = "array<struct<pos: int, term: int>>"

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, terms_of, ends, by_term, starts = sent.value
        asks = np.diff(ends)
        work = np.append(0, np.cumsum(asks[by_term]))
        number = np.zeros(size, np.int32)
        for batch in batches:
            held = pa.concat_arrays([batch.column("terms")])
            cut, codes = held.offsets.to_numpy(), held.flatten().to_numpy().astype(np.int64)
            pos = pa.concat_arrays([batch.column("pos")]).flatten().to_numpy()
            keys = np.unique(np.repeat(np.arange(len(held)), np.diff(cut)) * size + codes)
            place, term = keys // size, keys % size
            docs = np.searchsorted(place, np.arange(len(held) + 1))
            for at, to in spans(np.append(0, np.cumsum(work[starts[term + 1]] - work[starts[term]]))[docs], CELLS >> 2):
                here = slice(docs[at], docs[to])
                times = starts[term[here] + 1] - starts[term[here]]
                who = by_term[np.repeat(starts[term[here]] - (np.cumsum(times) - times), times) + np.arange(times.sum())]
                where = np.repeat(place[here], times)
                if not len(who):
                    continue
                n = asks[who]
                before = np.cumsum(n) - n
                wanted = np.repeat(where * size, n) + terms_of[np.repeat(ends[who] - before, n) + np.arange(n.sum())]
                found = keys[np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)] == wanted
                all_held = np.logical_and.reduceat(found, before)
                who, where = who[all_held], where[all_held]
                made = [pa.array(ids[who]), pa.array(batch.column("doc_id").to_numpy()[where])]
                if places:
                    spots = []
                    for q, d in zip(who, where, strict=True):
                        mine = terms_of[ends[q] : ends[q + 1]]
                        number[mine] = np.arange(1, len(mine) + 1)
                        numbers = number[codes[cut[d] : cut[d + 1]]]
                        spots.append((pos[cut[d] : cut[d + 1]][numbers > 0], numbers[numbers > 0]))
                        number[mine] = 0
                    flat = [np.concatenate([np.zeros(0, np.int32), *(s[i] for s in spots)]) for i in (0, 1)]
                    offsets = np.cumsum([0, *(len(s[0]) for s in spots)]).astype(np.int32)
                    made += [pa.array(asks[who].astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(x) for x in flat], ["pos", "term"]))]
                yield pa.RecordBatch.from_arrays(made, ["query_id", "doc_id", "n", "places"][: len(made)])

    return in_arrow(words, met, "query_id long, doc_id long" + (f", n int, places {kind}" if places else ""))


def filled(offsets: np.ndarray, term: np.ndarray, part: np.ndarray, who: np.ndarray, starts: np.ndarray, asked: int, most: int = CELLS >> 2) -> tuple[np.ndarray, np.ndarray]:
    """(scores, matched), documents x queries: the sums of part, and how many there are, over the terms of a document that a
    query asks for. offsets, term, part: the terms of each document; who[starts[t]:starts[t + 1]] ask for term t.

    A term that many ask for counts once for each of them, so documents are taken as far as `most` such rows go."""
    many = starts[term + 1] - starts[term]
    docs = len(offsets) - 1
    scores, matched = np.zeros((docs, asked)), np.zeros((docs, asked), np.int32)
    for at, to in spans(np.append(0, np.cumsum(many))[offsets], most):
        here = slice(offsets[at], offsets[to])
        times = many[here]
        asker = who[np.repeat(starts[term[here]] - (np.cumsum(times) - times), times) + np.arange(times.sum())]
        place = np.repeat(np.arange(to - at), np.diff(offsets[at : to + 1]))
        cell, size = asker + np.repeat(place * asked, times), (to - at) * asked
        matched[at:to] = np.bincount(cell, minlength=size).reshape(to - at, asked)
        scores[at:to] = np.bincount(cell, np.repeat(part[here], times), size).reshape(to - at, asked)
    return scores, matched


def bm25_top(queries: DataFrame, docs: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, least: int = 4, most_terms: int = 1 << 19, salt: int = 0) -> DataFrame:
    """query_id, doc_id, score, matched, rank: the k documents with the highest BM25 score for each query, ties to the
    smaller doc_id. queries(query_id, text), docs(doc_id, text); null texts take no part.

    The distinct (query, term) rows go to the tasks that scan the documents, if there are at most most_terms, and as many
    rows to return (k a query): one scan writes which of the terms each document holds; from that, document frequencies are
    counted and documents scored in blocks, and a task returns k rows a query, so no pair of query and document is shuffled.
    More rows than that are asked in parts of about that many, each with scans of its own; a single query is never split, and
    meets the postings by shuffle if it is that large. salt deals queries anew where a part is still too large.
    """
    asked = terms(queries.where("text is not null").select(F.col("query_id").cast("long").alias("query_id"), "text"), "query_id", least).distinct()
    given = asked.limit(most_terms + 1).toArrow()
    docs = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = (F.desc("score"), F.asc("doc_id"))
    if max(given.num_rows, k * len(pc.unique(given.column("query_id")))) > most_terms:
        n = asked.select("query_id").distinct().count()
        parts = min(-(-2 * max(asked.count(), k * n) // max(1, most_terms)), n)
        if parts > 1:
            part = F.pmod(F.xxhash64(F.col("query_id").cast("long"), F.lit(salt)), F.lit(parts))
            return reduce(DataFrame.unionByName, [bm25_top(queries.where(part == i), docs, k, k1, b, least, most_terms, salt + 1) for i in range(parts)])
    if given.num_rows > most_terms:
        return top(bm25(queries, docs, k1, b, least), ["query_id"], k, *order)
    ids, number = np.unique(given.column("query_id").to_numpy(), return_inverse=True)
    coded = pc.dictionary_encode(given.column("term").combine_chunks())
    term = coded.indices.to_numpy()
    by_term = np.argsort(term, kind="stable")
    starts = np.searchsorted(term[by_term], np.arange(len(coded.dictionary) + 1))
    vocabulary = docs.sparkSession.sparkContext.broadcast(coded.dictionary.cast(pa.string()))
    asking = docs.sparkSession.sparkContext.broadcast((ids, number[by_term], starts))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each document: its words, and which of the terms asked for it holds, how often."""
        known = vocabulary.value
        many = max(1, len(known))
        for batch in batches:
            w = pa.concat_arrays([batch.column("w")])
            ends = w.offsets.to_numpy()
            for at, to in spans(ends, WORDS):
                codes = pc.index_in(w.slice(at, to - at).flatten().cast(pa.string()), value_set=known)
                place = np.repeat(np.arange(to - at), np.diff(ends[at : to + 1]))[codes.is_valid().to_numpy(zero_copy_only=False)]
                keys, n = np.unique(place * many + codes.drop_null().to_numpy(), return_counts=True)
                offsets = pa.array(np.searchsorted(keys, np.arange(to - at + 1) * many).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (keys % many, n)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, to - at), pa.array(np.diff(ends[at : to + 1]), pa.int64()), *lists], ["doc_id", "len", "terms", "n"])

    words = docs.select("doc_id", text.folded_words("text", least).alias("w"))
    words = written(in_arrow(words, code, "doc_id long, len long, terms array<int>, n array<int>"), "term-counts")
    n_docs, mean = words.agg(F.count("*"), F.coalesce(F.avg("len"), F.lit(0.0))).first()
    sums = words.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).toArrow()  # a row a term
    df = np.zeros(len(coded.dictionary))
    df[sums.column("term").to_numpy()] = sums.column("n").to_numpy()
    idf = np.log(1 + (n_docs - df + 0.5) / (df + 0.5))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, who, starts = asking.value
        best, step = Best(len(ids), k), max(1, CELLS // max(1, len(ids)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                held = pa.concat_arrays([some.column("terms")])
                offsets, term = held.offsets.to_numpy(), held.flatten().to_numpy()
                n = pa.concat_arrays([some.column("n")]).flatten().to_numpy()
                length = np.repeat(some.column("len").to_numpy(), np.diff(offsets))
                part = idf[term] * n * (k1 + 1) / (n + k1 * (1 - b + b * length / max(mean, 1e-9)))
                scores, matched = filled(offsets, term, part, who, starts, len(ids))
                scores = np.round(scores, 6, out=scores)
                scores[matched == 0] = np.nan
                best.add(scores.T, some.column("doc_id").to_numpy(), matched.T)
        at, docs_found, scores, matched = best.taken()
        yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(docs_found), pa.array(scores), pa.array(matched)], ["query_id", "doc_id", "score", "matched"])

    return top(in_arrow(words, score, "query_id long, doc_id long, score double, matched long"), ["query_id"], k, *order)
