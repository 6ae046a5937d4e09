"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree. DataFrame functions only.

Documents of a source fall into blocks by a seeded hash, which permutes them. A source takes whole passes over all its
blocks and then a prefix of them, cut to the word, so that its words equal its target. Which output shard gets how many
of a source's block draws is decided by a tree over the shards: a node's quotas are split between its two halves as drawing
without replacement would split them (one hypergeometric draw per source, given the sources before it), down to single
shards. Quotas stay exact at every level, and each shard is composed as after a shuffle of all draws, without that
shuffle. Consecutive runs of a source's draws then go to the shards, and rows are put in hash order inside their shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

WORDS = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """sizes(key, source, source_size, n_rows), one row per source: adds place, weight and target.

    Sources in code-point order, null last, weigh `weights` in turn and share the sum of all sizes; a target stops at cap
    times its source's size and the excess goes to the others by weight until none is above. That fixed point is found in
    one pass: by rising cap-to-weight ratio, sources are capped as long as their cap is below the level that is left.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    low = Window.orderBy("ratio", "place")
    before, after = low.rowsBetween(Window.unboundedPreceding, -1), low.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    ranked = sizes.withColumn("place", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("place") % len(weights) + 1).cast("double"))
    ranked = ranked.withColumn("most", (F.col("source_size") * cap).cast("double")).withColumn("ratio", F.col("most") / F.col("weight"))
    ranked = ranked.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    level = (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    ranked = ranked.withColumn("level", level).withColumn("capped", F.col("ratio") <= F.col("level"))
    ranked = ranked.withColumn("final", F.min(F.when(~F.col("capped"), F.struct("ratio", "place", "level"))).over(everything)["level"])
    target = F.when(F.col("capped"), F.col("most")).otherwise(F.col("weight") * F.col("final"))
    return ranked.select("key", "source", "source_size", "n_rows", "place", "weight", "capped", target.alias("target"))


def hypergeometric(population: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of `marked` in `population` are among `drawn` ones, by inverting the distribution at u in [0, 1).

    The walk covers eight standard deviations on both sides of the mean; less than 1e-14 of the mass lies outside.
    """
    size = F.greatest(population, F.lit(1)).cast("double")
    mean = drawn * marked / size
    spread = F.sqrt(F.greatest(mean * (1 - marked / size) * (size - drawn) / F.greatest(size - 1, F.lit(1.0)), F.lit(0.0)))
    low = F.greatest(F.lit(0), drawn - (population - marked), F.floor(mean - 8 * spread - 1)).cast("long")
    high = F.least(marked, drawn, F.ceil(mean + 8 * spread + 1)).cast("long")

    def ratio(k: Column) -> Column:
        return ((marked - k) * (drawn - k)).cast("double") / ((k + 1) * (population - marked - drawn + k + 1)).cast("double")

    steps = F.when(high > low, F.sequence(low, high - 1)).otherwise(F.array().cast("array<bigint>"))
    start = F.struct(F.lit(1.0).alias("p"), F.lit(1.0).alias("sum"))
    total = F.aggregate(steps, start, lambda a, k: F.struct((a["p"] * ratio(k)).alias("p"), (a["sum"] + a["p"] * ratio(k)).alias("sum")))["sum"]
    state = F.struct(F.lit(1.0).alias("p"), F.lit(1.0).alias("sum"), low.alias("k"), total.alias("all"))
    walked = F.aggregate(
        steps,
        state,
        lambda a, k: F.when(a["sum"] > u * a["all"], a).otherwise(F.struct((a["p"] * ratio(k)).alias("p"), (a["sum"] + a["p"] * ratio(k)).alias("sum"), (k + 1).alias("k"), a["all"].alias("all"))),
    )
    return F.least(walked["k"], high)


def split_quotas(quotas: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """quotas: one row with `quota` array<long>. One row per shard: shard, quota; the arrays add up to the given one."""
    nodes = quotas.select(F.lit(0).alias("low"), F.lit(shards).alias("high"), "quota")
    depth = (shards - 1).bit_length()
    for _ in range(depth):
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        slots = F.aggregate("quota", F.lit(0).cast("long"), lambda a, q: a + q)
        left = F.floor(slots * (middle - F.col("low")) / (F.col("high") - F.col("low"))).cast("long")
        numbered = F.transform("quota", lambda q, i: F.struct(q.alias("q"), i.cast("long").alias("i")))
        start = F.struct(slots.alias("rest"), left.alias("drawn"), F.array().cast("array<bigint>").alias("out"))

        def step(a: Column, x: Column) -> Column:
            u = F.pmod(F.xxhash64(F.lit(seed), F.col("low"), F.col("high"), x["i"]), F.lit(1 << 52)) / float(1 << 52)
            k = hypergeometric(a["rest"], x["q"], a["drawn"], u)
            return F.transform(F.array(k), lambda k: F.struct((a["rest"] - x["q"]).alias("rest"), (a["drawn"] - k).alias("drawn"), F.concat(a["out"], F.array(k)).alias("out")))[0]

        drawn = F.aggregate(numbered, start, step)["out"]
        nodes = nodes.withColumn("middle", middle).withColumn("left", F.when(F.col("high") - F.col("low") > 1, drawn).otherwise(F.col("quota")))
        halves = F.array(
            F.struct("low", "middle", F.col("left").alias("quota")),
            F.struct(F.col("middle").alias("low"), F.col("high").alias("middle"), F.zip_with("quota", "left", lambda q, k: q - k).alias("quota")),
        )
        whole = F.array(F.struct("low", F.col("high").alias("middle"), "quota"))
        nodes = nodes.select(F.explode(F.when(F.col("high") - F.col("low") > 1, halves).otherwise(whole)).alias("n")).select(F.col("n.low").alias("low"), F.col("n.middle").alias("high"), F.col("n.quota").alias("quota"))
    return nodes.select(F.col("low").alias("shard"), "quota")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, shards: int | None = None, block_words: int = 1 << 16, block_rows: int = 1 << 14, most_blocks: int = 1 << 14, seed: int = 0, carry: tuple[str, ...] = ()) -> DataFrame:
    """docs(doc_id, source, text): one row per row with doc_id, source, size, source_size, target, taken, draws, and the
    columns named in carry.

    draws lists the times the document is taken: copy, words, shard, and the place that orders rows in the shard. A null
    or empty text has size 0 and is never taken; null is a source of its own. Repeated rows are documents of their own.
    No document is taken more than cap times its size. Blocks are about block_words words, or larger so that there are
    about most_blocks of them; both only set the grain of the draws, the words taken are exact. A draw counts only where
    the tree gave its block to a shard, and taken adds up those draws. Without a number of shards there is one a 2**20
    words, 16 at least and 16,384 at most. No rows give no rows.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    sized = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), key.alias("key"), size.alias("size"), F.xxhash64(F.lit(seed), "doc_id", "source", F.length("text")).alias("order"), *carry)
    sized = written(sized, "mix-sizes")
    sizes = sized.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    sources = source_targets(sizes, weights, cap)
    grain = F.greatest(F.lit(block_words), F.floor(F.sum("source_size").over(Window.partitionBy()) / most_blocks))
    crowd = F.greatest(F.lit(block_rows), F.floor(F.sum("n_rows").over(Window.partitionBy()) / most_blocks))
    n_blocks = F.greatest(F.lit(1), F.ceil(F.col("source_size") / grain), F.ceil(F.col("n_rows") / crowd)).cast("long")
    whole = F.when(F.col("capped"), F.lit(cap)).when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.when(F.col("capped"), F.lit(0)).otherwise(F.round("target").cast("long") - F.col("passes") * F.col("source_size"))
    sources = sources.withColumn("n_blocks", n_blocks).withColumn("passes", whole).withColumn("rest", rest.cast("long"))
    sources = written(sources, "mix-sources")
    if shards is None:
        total = sources.agg(F.sum("source_size")).first()[0] or 0
        shards = int(min(max(16, total >> 20), 1 << 14))
    blocked = sized.join(sources.select("key", "n_blocks"), "key").withColumn("block", F.pmod("order", "n_blocks"))
    in_source = Window.partitionBy("key").orderBy("block")
    blocks = blocked.groupBy("key", "block").agg(F.sum("size").alias("words"))
    blocks = blocks.withColumn("ahead", F.coalesce(F.sum("words").over(in_source.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("nth", F.row_number().over(in_source) - 1)
    blocks = blocks.join(sources, "key").withColumn("passes_here", F.col("passes") + (F.col("ahead") < F.col("rest")).cast("long"))
    blocks = blocks.withColumn("in_use", F.count("*").over(Window.partitionBy("key")))
    blocks = written(blocks, "mix-blocks")
    quotas = blocks.groupBy("key").agg(F.sum("passes_here").alias("n"), F.first("place").alias("place"))
    ordered = quotas.agg(F.array_sort(F.collect_list(F.struct("place", "key", "n"))).alias("q"))
    leaves = split_quotas(ordered.select(F.transform("q", lambda x: x["n"]).alias("quota")), shards, seed)
    keys = ordered.select(F.posexplode("q").alias("i", "x")).select("i", F.col("x.key").alias("key"))
    ends = leaves.select("shard", F.posexplode("quota").alias("i", "n")).join(keys, "i")
    ends = ends.withColumn("end", F.sum("n").over(Window.partitionBy("key").orderBy("shard")))
    ends = ends.groupBy("key").agg(F.array_sort(F.collect_list("end")).alias("ends"))
    blocks = blocks.join(ends, "key")
    # A source's draws in order: all blocks of the first pass, of the second, and so on; shards take runs of them.
    leaf = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(cap).cast("long")), lambda c: F.size(F.filter("ends", lambda e: e <= c * F.col("in_use") + F.col("nth"))))
    shard_of = F.transform(leaf, lambda n: F.when(n < F.size("ends"), n))  # past the last end, no leaf's quota holds the draw
    blocks = blocks.select("key", "block", "ahead", "source_size", "target", "passes", "rest", shard_of.alias("shards"))
    in_block = Window.partitionBy("key", "block").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocked.withColumn("inside", F.coalesce(F.sum("size").over(in_block), F.lit(0))).join(blocks, ["key", "block"])
    last = F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - F.col("ahead") - F.col("inside"))).cast("long")
    copies = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("passes")),
        lambda c: F.struct(c.cast("int").alias("copy"), F.when(c < F.col("passes"), F.col("size")).otherwise(last).alias("words"), F.element_at("shards", c.cast("int") + 1).alias("shard"), F.xxhash64(F.lit(seed + 1), c, "order").alias("place")),
    )
    draws = F.filter(copies, lambda d: (d["words"] > 0) & d["shard"].isNotNull())
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    drawn = placed.select("doc_id", "source", "size", "source_size", "target", draws.alias("draws"), *carry)
    return drawn.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "draws", *carry)


def write_shards(mixed: DataFrame, path: str) -> None:
    """The draws of mix() as files, one folder per shard, each in its own order: the local shuffle. A document that is
    taken several times has a row a draw; one that is not taken has none; no draws give no files. Repeated rows have draws
    of their own; a null doc_id or source stays null."""
    rows = mixed.select("doc_id", "source", F.explode("draws").alias("d")).select("doc_id", "source", "d.*")
    rows.repartition("shard").sortWithinPartitions("shard", "place", "doc_id").write.partitionBy("shard").parquet(path)
