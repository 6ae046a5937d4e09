"""Ranked lists: top-k per group, fusion of rankings, and what is done with fused rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import written


def ranked(df: DataFrame, by: list[str], *order: Column, name: str = "rank") -> DataFrame:
    """Adds the 1-based place of each row in its group. Orders must be total, so that reruns agree."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top(df: DataFrame, by: list[str], k: int, *order: Column, name: str = "rank") -> DataFrame:
    """The first k rows of each group. The rank filter is pushed below the shuffle, so each task sends k rows a group."""
    return ranked(df, by, *order, name=name).where(F.col(name) <= k)


def positions(df: DataFrame, *order: Column | str, name: str = "position") -> DataFrame:
    """Adds the 1-based place of each row in the whole table, without bringing it to one task: rows are dealt by ranges of
    the order and written with their place inside their part; the few sizes of the parts give the rest."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = written(dealt, "positions").withColumn("_part", F.shiftright("_at", 33))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part").withColumn(name, F.col("_before") + inside + 1).drop("_at", "_part", "_before")  # a row a part


def in_blocks(df: DataFrame, by: list[str], order: list[str], back: int, size: int = 1 << 14) -> DataFrame:
    """Rows for a window of the last `back` rows before each one of its group: adds _block and _carried.

    A group is cut in its order into blocks of `size` rows, and the last `back` rows of a block are also given to the next
    one, marked as carried; so a window over (by, _block) sees what it needs, and a group of very many rows is dealt over
    many tasks. Leave carried rows out of the result.
    """
    dealt = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_at", F.monotonically_increasing_id())
    dealt = written(dealt, "blocks").withColumn("_part", F.shiftright("_at", 33))
    parts = dealt.groupBy(*by, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumns({f"_by{i}": F.col(c) for i, c in enumerate(by)}).withColumn("_before", before).select("_part", *(f"_by{i}" for i in range(len(by))), "_first", "_before")
    placed = dealt.join(parts.withColumnRenamed("_part", "_part2"), (F.col("_part") == F.col("_part2")) & _same(by)).withColumn("_place", F.col("_before") + F.col("_at") - F.col("_first"))
    block, inside = F.floor(F.col("_place") / size), F.col("_place") % size
    here = F.array(F.struct(block.alias("b"), F.lit(False).alias("c")))
    both = F.array(F.struct(block.alias("b"), F.lit(False).alias("c")), F.struct((block + 1).alias("b"), F.lit(True).alias("c")))
    spread = placed.withColumn("_in", F.explode(F.when(inside >= size - back, both).otherwise(here)))
    return spread.select(*df.columns, F.col("_in.b").alias("_block"), F.col("_in.c").alias("_carried"))


def _same(by: list[str]) -> Column:
    out = F.lit(True)
    for i, c in enumerate(by):
        out = out & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    return out


def fuse(lists: dict[str, tuple[DataFrame, float]], by: list[str], key: str, constant: int = 60) -> DataFrame:
    """Weighted reciprocal rank fusion: sum of weight / (constant + rank) over the lists that hold a key.

    One union and one aggregate, whatever the number of lists; the sum is of at most one row per list and key."""
    parts = [df.select(*by, key, (F.lit(float(w)) / (constant + F.col("rank"))).alias("score")) for df, w in lists.values()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy(*by, key).agg(F.sum("score").alias("score"))


def boosted(score: Column, words: Column, text: Column, by: float = 0.01, definition: Column | None = None, marks: tuple[str, str, str] = ("term:", "substitution:", "keywords:")) -> Column:
    """Score plus `by` for each word found in the text, as a substring.

    Where a definition is asked for, a text with the first two marks (an entry of a glossary) gains 0.20 and 0.15 more for
    each word that follows the first mark; one with the third mark (a row that only lists keywords) loses 0.05.
    """
    out = score + by * F.size(F.filter(words, lambda w: F.contains(text, w)))
    if definition is None:
        return out
    entry, second, listing = (F.contains(text, F.lit(m)) for m in marks)
    exact = F.size(F.filter(words, lambda w: F.contains(text, F.concat(F.lit(marks[0] + " "), w))))
    more = F.when(entry & second, 0.20).otherwise(0.0) + 0.15 * exact - F.when(listing, 0.05).otherwise(0.0)
    return out + F.when(definition, more).otherwise(0.0)
