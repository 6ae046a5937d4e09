"""How far the sources of a language diverge in their words: exact triangular divergences of smoothed shares.

Equal texts are collapsed first: a task sends a text once and after that only how often which source has it; where copies
meet, the text is cut into terms once, and its counts and document frequencies are added with those multiplicities. Counts
leave a task as one row a (lang, term) with the sources' counts side by side, so a term's sources are together after one
shuffle.

Pairs of sources are evaluated sparsely, in cells of a bucket of terms and two blocks of sources: a cell holds only the
terms that one of its sources uses; all other terms of the bucket have the same share in a source and give one value for
each pair, times their number. A cell returns one partial sum a pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import in_arrow, utf8, written

ONE = 1_000_000_000
TO_TERMS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and of all characters beyond ASCII, A-Z in lower case."""
    return text.translate(TO_TERMS).split()


def collapsed(docs: DataFrame, hold: int = 1 << 16) -> DataFrame:
    """(digest, lang, text, sources, counts) of docs(lang, source, text): a task's first copy of a text with the text,
    later ones as one row with how often each source has it."""

    def packed(digests, langs, texts, sources, counts) -> pa.RecordBatch:
        arrays = [pa.array(digests, pa.binary()), pa.array(langs, pa.string()), texts, pa.array(sources, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(arrays, ["digest", "lang", "text", "sources", "counts"])

    def later(seen: dict) -> pa.RecordBatch:
        rows = [(d, lang, list(more), list(more.values())) for (d, lang), more in seen.items() if more]
        digests, langs, sources, counts = zip(*rows, strict=True) if rows else ((),) * 4
        return packed(digests, langs, pa.nulls(len(digests), pa.string()), sources, counts)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[bytes, str], dict[str, int]] = {}
        for batch in batches:
            langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            fresh = []
            for i, (lang, source, text) in enumerate(zip(langs, sources, utf8(batch.column("text")), strict=True)):
                name = lang.encode()
                key = hashlib.blake2b(b"%d %b" % (len(name), name) + text, digest_size=16).digest(), lang
                more = seen.get(key)
                if more is None:
                    seen[key] = {}
                    fresh.append((i, key[0]))
                else:
                    more[source] = more.get(source, 0) + 1
            at = [i for i, _ in fresh]
            yield packed([d for _, d in fresh], [langs[i] for i in at], batch.column("text").take(pa.array(at, pa.int64())), [[sources[i]] for i in at], [[1]] * len(at))
            if len(seen) > hold:
                yield later(seen)
                seen = {}
        yield later(seen)

    return in_arrow(docs, scan, "digest binary, lang string, text string, sources array<string>, counts array<long>")


class Numbers(dict):
    """Keys numbered as they come."""

    def __missing__(self, key):
        self[key] = found = len(self)
        return found


class Tally:
    """Counts and document frequencies by (term, group) as sorted arrays; groups are (lang, source)."""

    def __init__(self, combinations: int, terms: int):
        self.most, self.most_terms = combinations, terms
        self.terms, self.groups = Numbers(), Numbers()
        self.kept = np.zeros((3, 0), np.int64)
        self.fresh: list[np.ndarray] = []
        self.waiting = 0

    def add(self, text: bytes, lang: str, sources: dict[str, int]) -> None:
        words = terms_of(text)
        if not words:
            return
        ids, counts = np.unique(np.fromiter(map(self.terms.__getitem__, words), np.int64, len(words)), return_counts=True)
        for source, times in sources.items():
            self.fresh.append(np.stack([ids << 32 | self.groups[lang, source], counts * times, np.full(len(ids), times)]))
            self.waiting += len(ids)
            if self.waiting > self.most:
                self.settle()

    def settle(self) -> None:
        if self.fresh:
            rows = np.hstack([self.kept, *self.fresh])
            rows = rows[:, np.argsort(rows[0], kind="stable")]
            starts = np.flatnonzero(np.concatenate([[True], rows[0, 1:] != rows[0, :-1]]))
            self.kept = np.stack([rows[0, starts], np.add.reduceat(rows[1], starts), np.add.reduceat(rows[2], starts)])
        self.fresh, self.waiting = [], 0

    def full(self) -> bool:
        return len(self.terms) > self.most_terms or self.kept.shape[1] > self.most

    def batches(self) -> Iterator[pa.RecordBatch]:
        """One row a (lang, term): sources, counts, docs."""
        self.settle()
        if not self.kept.shape[1]:
            return
        names = list(self.groups)
        langs = Numbers()
        lang_of = np.array([langs[lang] for lang, _ in names])
        term, group = self.kept[0] >> 32, self.kept[0] & 0xFFFFFFFF
        order = np.lexsort((group, term, lang_of[group]))
        term, group, counts, docs = term[order], group[order], self.kept[1][order], self.kept[2][order]
        lang = lang_of[group]
        starts = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (lang[1:] != lang[:-1])]))
        ends = pa.array(np.append(starts, len(term)), pa.int32())
        source = pa.array([s for _, s in names], pa.string()).take(pa.array(group))
        lists = [pa.ListArray.from_arrays(ends, x) for x in (source, pa.array(counts), pa.array(docs))]
        heads = [pa.array(list(langs), pa.string()).take(pa.array(lang[starts])), pa.array(list(self.terms), pa.binary()).cast(pa.string()).take(pa.array(term[starts]))]
        whole = pa.RecordBatch.from_arrays([*heads, *lists], ["lang", "term", "sources", "counts", "docs"])
        for at in range(0, whole.num_rows, 1 << 14):
            yield whole.slice(at, 1 << 14)


def term_counts(docs: DataFrame, hold: tuple[int, int, int]) -> DataFrame:
    """(lang, source, term, n, docs) of docs(lang, source, text), in partitions by lang and term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(*hold[1:])
        current, text, sources, lang = None, b"", {}, ""
        for batch in batches:
            lists = zip(batch.column("digest").to_pylist(), batch.column("lang").to_pylist(), batch.column("text"), batch.column("sources").to_pylist(), batch.column("counts").to_pylist(), strict=True)
            for digest, its_lang, its_text, names, times in lists:
                if digest != current:
                    tally.add(text, lang, sources)
                    current, lang, sources, text = digest, its_lang, {}, (its_text.as_py() or "").encode()
                for name, n in zip(names, times, strict=True):
                    sources[name] = sources.get(name, 0) + n
            tally.settle()
            if tally.full():
                yield from tally.batches()
                tally = Tally(*hold[1:])
        tally.add(text, lang, sources)
        yield from tally.batches()

    once = collapsed(docs, hold[0]).repartition("digest").sortWithinPartitions("digest", F.col("text").isNull())
    found = in_arrow(once, count, "lang string, term string, sources array<string>, counts array<long>, docs array<long>")
    dealt = found.repartition("lang", "term").select("lang", "term", F.explode(F.arrays_zip("sources", "counts", "docs")).alias("x"))
    dealt = dealt.select("lang", "term", F.col("x.sources").alias("source"), F.col("x.counts").alias("n"), F.col("x.docs").alias("docs"))
    return dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 kinds)), exact; null without kinds."""
    above = F.lit(ONE).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    below = (total + 2 * kinds).cast("decimal(20,0)")
    return F.when(kinds > 0, 1 + F.call_function("div", above, below)).cast("long")


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q).cast("long")


def divide_cell(key: tuple, used: pa.Table, sources: pa.Table, block: int) -> pa.Table:
    """Partial sums of one cell: used(place, term, p) and sources(place, source, none, size), one row a source of the two
    blocks of `block` sources; `none` is a source's share of a term that it does not use, size the number of terms in the bucket."""
    place = sources.column("place").to_numpy()
    order = np.argsort(place)
    place, none = place[order], sources.column("none").to_numpy()[order]
    names = sources.column("source").take(pa.array(order)).combine_chunks()
    terms, column = np.unique(used.column("term").to_numpy(), return_inverse=True)
    shares = np.repeat(none[:, None], len(terms), axis=1)
    shares[np.searchsorted(place, used.column("place").to_numpy()), column] = used.column("p").to_numpy()
    rest = int(sources.column("size")[0].as_py()) - len(terms)
    low, high, its_block = key[2].as_py(), key[3].as_py(), place // block
    firsts, seconds = np.flatnonzero(its_block == low), np.flatnonzero(its_block == high)
    left, right, values = [], [], []
    for i in firsts.tolist():
        other = seconds[seconds > i]
        p, q = shares[i][None, :], shares[other]
        value = ((p - q) ** 2 // (p + q)).sum(axis=1) + rest * ((none[i] - none[other]) ** 2 // (none[i] + none[other]))
        left.append(np.full(len(other), i))
        right.append(other)
        values.append(value)
    left, right, values = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right, values))
    at, of = pa.array(np.concatenate([left, right]), pa.int64()), pa.array(np.concatenate([right, left]), pa.int64())
    lang = pa.array([key[0].as_py()] * (2 * len(left)), pa.string())
    return pa.table({"lang": lang, "source": names.take(at), "item": names.take(of), "value": pa.array(np.concatenate([values, values]).astype(np.int64))})


def audit(docs: DataFrame, min_docs: int = 10, top: int = 10, block: int = 128, bucket_terms: int = 4096, hold: tuple[int, int, int] = (1 << 16, 1 << 21, 1 << 18)) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs(lang, source, text); null lang, source and text are ''.

    A lang keeps the terms found in at least min_docs of its documents. p is a group's smoothed share of a term, q that of
    its lang (part 'term', the `top` terms that the group uses more than its lang) or of another source of the lang (part
    'pair', summed over all kept terms). Ranks run by falling value, then by the item's bytes. A lang of one source has no
    pairs; a lang without kept terms has pairs of value 0; groups without terms take part. Repeated rows are documents of
    their own. Texts count as equal by a 128-bit digest. Cells have two blocks of `block` sources and about bucket_terms
    terms; hold says how many texts, combinations of term and group, and terms a task holds before it sends them on. None
    of these changes a result. No rows give no rows. Other columns are not read.
    """
    blank = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("lang", "source", "text")}
    plain = docs.select(*(v.alias(c) for c, v in blank.items()))
    of_term = Window.partitionBy("lang", "term")
    counted = term_counts(plain, hold).withColumn("seen", F.sum("docs").over(of_term)).withColumn("lang_n", F.sum("n").over(of_term))
    counted = counted.withColumn("head", F.row_number().over(of_term.orderBy("source")) == 1)
    kept = written(counted.where(F.col("seen") >= min_docs).select("lang", "source", "term", "n", "lang_n", "head"), "audit-terms")
    per_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    per_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum(F.col("head").cast("long")).alias("kinds"))
    groups = plain.select("lang", "source").distinct().join(per_group, ["lang", "source"], "left").join(per_lang, "lang", "left").na.fill(0)
    groups = groups.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1)
    groups = groups.withColumn("blocks", F.ceil(F.count("*").over(Window.partitionBy("lang")) / block).cast("int"))
    groups = groups.withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("kinds") / bucket_terms)).cast("int"))
    groups = written(groups.withColumn("none", F.coalesce(share(F.lit(0), F.col("total"), F.col("kinds")), F.lit(1))), "audit-groups")

    used = kept.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("kinds")))
    used = used.withColumn("q", share(F.col("lang_n"), F.col("lang_total"), F.col("kinds")))
    by_rank = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = used.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= top)

    bucket = F.pmod(F.xxhash64("term"), "buckets").cast("int")
    own = F.floor(F.col("place") / block).cast("int")
    partners = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.least(b, own).alias("low"), F.greatest(b, own).alias("high")))
    cells = ["lang", "bucket", "low", "high"]
    again = groups.toDF(*groups.columns)  # both sides of the cells come from it
    sizes = kept.where("head").join(again.select("lang", "buckets").distinct(), "lang").groupBy("lang", bucket.alias("bucket")).agg(F.count("*").alias("size"))
    there = again.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1))).join(sizes, ["lang", "bucket"], "left").na.fill(0, ["size"])
    there = there.withColumn("pair", F.explode(partners)).select("lang", "bucket", "pair.low", "pair.high", "place", "source", "none", "size")
    cell_terms = used.withColumn("bucket", bucket).withColumn("pair", F.explode(partners)).select("lang", "bucket", "pair.low", "pair.high", "place", "term", "p")
    parts = cell_terms.groupBy(*cells).cogroup(there.groupBy(*cells)).applyInArrow(lambda key, used, sources: divide_cell(key, used, sources, block), "lang string, source string, item string, value long")
    pairs = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_rank).alias("rank"))
    return pairs.unionByName(terms)
