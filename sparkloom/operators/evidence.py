"""Evidence cut down to the sentences that answer a question. All in the row, without a shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text

NUMBER_UNIT = r"\d+[.,]?\d*\s*[%a-zA-Z°]"
LABEL = r"\s+(?=\p{Lu}[\p{L}]{2,20}:\s)"  # a label opens a sentence of its own
LEAST_CHARS = 18


@dataclass(frozen=True)
class Weights:
    """What counts for a sentence, and what against it."""

    term: int = 2
    metric: int = 4
    number: int = 5
    negative: int = 8
    next_negative: int = 8
    anchor: int = 12
    strong: tuple[float, int] = (0.075, 2)
    fair: tuple[float, int] = (0.05, 1)
    least: int = 4
    least_factual: int = 5
    most: int = 5
    most_factual: int = 3


WEIGHTS = Weights()


def sentences(c: Column | str) -> Column:
    """Distinct sentences of a text in order: cut behind . ! ? and blanks and before labels like 'Result: ', bullets and
    rulers of tables out, white space collapsed; those under LEAST_CHARS characters go."""
    plain = F.regexp_replace(c, r"\|[-:\s|]+\|", " ")
    parts = F.split(plain, rf"(?<=[.!?])\s+|{LABEL}")
    cleaned = F.transform(parts, lambda s: F.regexp_replace(text.collapse(F.regexp_replace(s, r"^\s*[-*]\s*", "")), "^[ ;]+|[ ;]+$", ""))
    return F.array_distinct(F.filter(cleaned, lambda s: F.length(s) >= LEAST_CHARS))


def bonus(top_score: Column, weights: Weights = WEIGHTS) -> Column:
    """What every sentence gains when the search behind it was sure."""
    return F.when(top_score >= weights.strong[0], weights.strong[1]).when(top_score >= weights.fair[0], weights.fair[1]).otherwise(0)


def scored(found: Column, lowered: Column, terms: Column, metrics: Column, factual: Column, top_score: Column, negative: str, anchors: Column | None = None, weights: Weights = WEIGHTS) -> Column:
    """Array of (i, s, f, score) over sentences `found` with their folded forms `lowered`.

    For: each term of the question that a sentence has as a word; any of the question's metrics; a number with a unit, when
    a number is asked for; a sure search. Against: a number that is called wrong, in the sentence or in the next one; and
    that none of the anchors is there, if the question needs one."""

    def one(s: Column, i: Column) -> Column:
        f, after = F.get(lowered, i), F.get(lowered, i + 1)
        own = F.size(F.array_intersect(text.words(f, 1), terms)) * weights.term
        own = own + F.when(F.exists(metrics, lambda m: F.contains(f, m)), weights.metric).otherwise(0)
        number = s.rlike(NUMBER_UNIT)
        own = own + F.when(factual & number, weights.number).otherwise(0) + bonus(top_score, weights)
        own = own - F.when(number & f.rlike(negative), weights.negative).otherwise(0) - F.when(F.coalesce(after.rlike(negative), F.lit(False)), weights.next_negative).otherwise(0)
        if anchors is not None:
            own = own - F.when((F.size(anchors) > 0) & ~F.exists(anchors, lambda a: F.contains(f, a)), weights.anchor).otherwise(0)
        return F.struct(i.alias("i"), s.alias("s"), f.alias("f"), own.alias("score"))

    return F.transform(found, one)


def reduced(scores: Column, factual: Column, top_score: Column, weights: Weights = WEIGHTS) -> Column:
    """Of scored(): sentences that reach the threshold, best first, without those contained in one taken before or
    containing it; three if a number is asked for, else five; then back in the order of the text."""
    least = F.when(factual, weights.least_factual).otherwise(weights.least) - F.when(top_score >= weights.strong[0], 1).otherwise(0)
    most = F.when(factual, weights.most_factual).otherwise(weights.most)
    able = F.array_sort(F.transform(F.filter(scores, lambda x: x["score"] >= least), lambda x: F.struct((-x["score"]).alias("n"), x["i"].alias("i"), x["f"].alias("f"), x["s"].alias("s"))))
    kind = "array<struct<i: int, s: string, f: string, score: int>>"

    def step(acc: Column, x: Column) -> Column:
        clash = F.exists(acc, lambda k: F.contains(k["f"], x["f"]) | F.contains(x["f"], k["f"]))
        return F.when(clash | (F.size(acc) >= most), acc).otherwise(F.array_append(acc, F.struct(x["i"].alias("i"), x["s"].alias("s"), x["f"].alias("f"), (-x["n"]).cast("int").alias("score"))))

    return F.array_sort(F.aggregate(able, F.array().cast(kind), step))


def direct_answer(kept: Column, metrics: Column, most_parts: Column | int = 2, most_chars: int = 650) -> Column:
    """The answer to a question for a number, from reduced sentences: those with a number and a unit; of these the ones that
    name a metric of the question, where there are any; the first distinct ones, best before others; null if none is there
    or the answer is longer than most_chars."""
    able = F.filter(kept, lambda x: x["s"].rlike(NUMBER_UNIT))
    focused = F.filter(able, lambda x: F.exists(metrics, lambda m: F.contains(x["f"], m)))
    chosen = F.when(F.size(focused) > 0, focused).otherwise(able)
    parts = F.slice(F.array_distinct(F.transform(chosen, lambda x: x["s"])), F.lit(1), most_parts if isinstance(most_parts, Column) else F.lit(most_parts))
    answer = F.array_join(parts, " ")
    return F.when((F.size(parts) > 0) & (F.length(answer) <= most_chars), answer)
