"""Routing rules as data: words, phrases of any number of words and patterns by rule set, and what is noise in any of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from . import phrases
from .routing import execution_plan

#: rule set -> kind -> terms. The terms are of the languages of the texts at hand; a deployment brings its own.
RULES: dict[str, dict[str, tuple[str, ...]]] = {
    "greeting": {"word": ("hello", "hallo", "bonjour", "hola"), "phrase": ("good day", "guten tag")},
    "domain": {"word": ("the", "les", "der", "los", "and", "und")},
    "strong": {"phrase": ("of the", "que les", "der die", "en la"), "pattern": (r"(^|[^\p{L}])norm[\p{L}]*",)},
    "normative": {"phrase": ("by the", "dans les", "und das", "por la")},
    "legal": {"phrase": ("is for", "qui que", "das und", "para el", "under the apache license", "licensed under the apache license version 2 0"), "pattern": (r"(^|[^\p{L}])shall([^\p{L}]|$)",)},
    "labelling": {"word": ("label", "etikett"), "phrase": ("for the", "pour les", "auf der")},
    "special": {"word": ("with", "elle", "nicht", "con"), "pattern": (r"[\p{L}]ableness([^\p{L}]|$)",)},
    "fermented": {"pattern": (r"eau[\p{L}]*x([^\p{L}]|$)", r"keit[\p{L}]*ung")},
    "quality": {"word": ("that", "une", "mit", "como")},
    "defect": {"pattern": (r"(^|[^\p{L}])un[\p{L}]+ung",)},
    "formulation": {"phrase": ("and of", "et la", "die der", "que el")},
}
#: Keywords of each agent for the weighted score; those of the first tuple weigh 3.
STRONG_HINTS: dict[int, tuple[str, ...]] = {1: ("with", "elle"), 3: ("of the", "en la")}
KEYWORDS: dict[int, tuple[str, ...]] = {1: ("with", "elle", "that", "une", "and", "et la", "threatening", "mit"), 3: ("of the", "en la", "the", "les", "by the", "die", "para el")}
NOISE = ("the", "les")
LONG = 9


def rows() -> list[tuple[str, str, str]]:
    """(rule_set, kind, term) of every rule, and the noise as a set of its own."""
    found = [(name, kind, term) for name, kinds in RULES.items() for kind, terms in kinds.items() for term in terms]
    return [*found, *(("noise", "word", t) for t in NOISE)]


def table(spark: SparkSession) -> DataFrame:
    """The rules as a long table; fixed and small."""
    return spark.createDataFrame(rows(), "rule_set string, kind string, term string")


#: All words and phrases that any rule or agent asks for.
TERMS = tuple(sorted({t for _, kind, t in rows() if kind != "pattern"} | {t for k in KEYWORDS.values() for t in k}))


def terms_in(c: Column | str) -> Column:
    """Which of TERMS a text holds, in lower case, whole words only: one pass, at any number and length of terms."""
    return phrases.held(text.words(F.lower(c), 1), TERMS)


def held(known: Column, terms: tuple[str, ...]) -> Column:
    """Which of the terms are among the known ones."""
    return F.array_intersect(F.array(*map(F.lit, terms)), known)


def signal(name: str, known: Column, lowered: Column) -> Column:
    """Whether a rule set speaks: a word or phrase of it is known, or a pattern matches. No join, no shuffle."""
    kinds = RULES[name]
    terms = kinds.get("word", ()) + kinds.get("phrase", ())
    out = F.size(held(known, terms)) > 0 if terms else F.lit(False)
    for pattern in kinds.get("pattern", ()):
        out = out | lowered.rlike(pattern)
    return out


def signals(docs: DataFrame, key: str) -> DataFrame:
    """key, one boolean a rule set, n_words, objective (a number or a question mark), hits and weight of agent 1."""
    seen = docs.select(key, F.lower("text").alias("t"), terms_in("text").alias("g"))
    flags = [signal(name, F.col("g"), F.col("t")).alias(name) for name in RULES]
    kw = F.filter(held(F.col("g"), KEYWORDS[1]), lambda x: ~x.isin(*NOISE))
    objective = F.col("t").rlike(r"[\d?]")
    return seen.select(key, *flags, F.size(text.words("t", 1)).alias("n_words"), objective.alias("objective"), F.size(kw).alias("hits"), weight_of(kw, 1).alias("weight"))


def weight_of(found: Column, agent: int) -> Column:
    """Sum of the weights of found keywords: strong hints 3, noise 0, phrases and long words 2, others 1."""
    one = lambda x: F.when(x.isin(*STRONG_HINTS[agent]), 3).when(x.isin(*NOISE), 0).when(F.contains(x, F.lit(" ")) | (F.length(x) >= LONG), 2).otherwise(1)
    return F.aggregate(F.transform(found, one), F.lit(0), lambda a, x: a + x)


def matched(hits: Column, weight: Column) -> Column:
    return (hits >= 2) | (weight >= 3) | ((weight >= 2) & (hits >= 1))


def route() -> Column:
    """Over the columns of signals(): the first rule that holds gives the agents; none for greetings, null when no rule
    holds. Agent 3 answers what is only about rules; a special or quality signal brings agent 1 in."""
    none = F.array().cast("array<int>")
    legal, both = F.array(F.lit(3)), F.array(F.lit(1), F.lit(3))
    ruled = F.col("normative") | F.col("labelling") | F.col("strong")
    return (
        F.when((F.col("n_words") == 0) | (F.col("greeting") & (F.col("n_words") <= 6)), none)
        .when(F.col("legal"), legal)
        .when(ruled & ~F.col("special") & ~F.col("quality"), legal)
        .when(ruled | F.col("special") | F.col("fermented"), both)
        .when(matched(F.col("hits"), F.col("weight")) | F.col("domain"), both)
    )


def estimate(ids: Column) -> Column:
    """Confidence of a route by its clearest sign."""
    return F.when(F.size(ids) == 0, 0.98).when(F.col("strong") | F.col("special"), 0.86).when(F.array_contains(ids, 1), 0.82).when(F.col("domain"), 0.70).otherwise(0.60)


def recalibrated(raw: Column, ids: Column) -> Column:
    """Floors for clear signs, ceilings for several specialists and for plain questions that only agent 3 answers."""
    out = F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))
    floored = F.when(F.col("strong") & F.array_contains(ids, 3), F.greatest(out, F.lit(0.84))).otherwise(out)
    floored = F.when(F.col("special") & F.array_contains(ids, 1), F.greatest(floored, F.lit(0.82))).otherwise(floored)
    specialists = F.size(F.filter(ids, lambda x: x != 3))
    capped = F.when(specialists > 1, F.least(floored, F.lit(0.74))).otherwise(floored)
    capped = F.when((specialists == 0) & F.col("domain") & F.col("objective"), F.least(capped, F.lit(0.69))).otherwise(capped)
    return F.when(F.size(ids) == 0, out).otherwise(capped)


def plan(ids: Column, bucket: Column, barred: tuple[int, ...], alternatives: tuple[int, ...]) -> Column:
    """The route without barred agents, agent 3 where a strong sign asks for it, then alternatives; the surer the bucket,
    the fewer agents."""
    kept = F.filter(ids, lambda x: ~x.isin(*barred))
    guarded = F.when(F.col("strong") & (F.size(kept) > 0), F.array_union(kept, F.array(F.lit(3)))).otherwise(kept)
    most = F.when(bucket == "high", 2).when(bucket == "medium", 3).otherwise(4)
    return F.slice(execution_plan(guarded, barred, alternatives), F.lit(1), most)


def intent() -> Column:
    """Over the columns of signals(): domain, tables to search, whether rules are needed, and the type of question."""

    def found(domain: str, tables: tuple[str, ...], ruled: bool, kind: str) -> Column:
        return F.struct(F.lit(domain).alias("domain"), F.array(*map(F.lit, tables)).cast("array<string>").alias("tables"), F.lit(ruled).alias("needs_rules"), F.lit(kind).alias("type"))

    ruled = F.col("strong") | F.col("normative") | F.col("labelling")
    return (
        F.when(F.col("greeting") & (F.col("n_words") <= 6), found("greeting", (), False, "general"))
        .when(F.col("quality") & F.col("defect"), found("process", ("quality", "rules"), True, "general"))
        .when(F.col("legal"), found("legal", ("rules",), True, "regulatory"))
        .when(ruled & F.col("special"), found("special_rules", ("special", "rules"), True, "regulatory"))
        .when(ruled, found("rules", ("rules",), True, "regulatory"))
        .when(F.col("fermented") & ~F.col("special"), found("fermented", ("fermented",), False, "general"))
        .when(F.col("formulation") & ~F.col("special") & ~F.col("quality"), found("formulation", ("formulation",), False, "general"))
        .otherwise(found("fallback", ("special", "rules"), False, "general"))
    )
