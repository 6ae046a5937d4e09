"""JSON containment, cover density and formulas against loops."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import documents, formulas
from sparkloom.operators import cover


def holds(doc, pattern, top=True):
    if isinstance(pattern, dict):
        return isinstance(doc, dict) and all(k in doc and holds(doc[k], p, False) for k, p in pattern.items())
    if isinstance(pattern, list):
        return isinstance(doc, list) and all(any(holds(x, p, False) for x in doc) for p in pattern)
    if top and isinstance(doc, list):
        return any(holds(x, pattern, False) for x in doc)
    if isinstance(doc, bool) or isinstance(pattern, bool):
        return doc is pattern
    return not isinstance(doc, (dict, list)) and (doc is None) == (pattern is None) and isinstance(doc, str) == isinstance(pattern, str) and doc == pattern


def value(rng, depth):
    kind = rng.randint(0, 6) if depth else rng.randint(0, 4)
    if kind < 5:
        return rng.choice([0, 1, 1.0, 2.5, -7, "a", "1", "é\"'\\", True, False, None, ""])
    if kind == 5:
        return [value(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice(["a", "b", "it's", "x.y", "é", "", "?'\""]): value(rng, depth - 1) for _ in range(rng.randint(0, 3))}


def test_containment(spark):
    rng = random.Random(6)
    docs = [value(rng, 3) for _ in range(150)] + [{"a": [1, {"b": [2]}]}, [[1]], {"it's": {"x.y": 1}}]
    raw = [json.dumps(d, ensure_ascii=bool(i % 2)) for i, d in enumerate(docs)] + ["{broken", None]
    patterns = [value(rng, 2) for _ in range(25)] + [{}, [], {"a": [{"b": [2]}]}, 1, [[1]], {"it's": {"x.y": 1}}]
    df = spark.createDataFrame(list(enumerate(raw)), "i int, raw string").withColumn("doc", documents.parsed("raw")).coalesce(2).cache()
    for at in range(0, len(patterns), 8):
        some = patterns[at : at + 8]
        got = {r.i: (r.h, r.m) for r in df.select("i", F.array(*[documents.contains(F.col("doc"), p) for p in some]).alias("h"), F.array(*[documents.may_contain(F.col("raw"), p) for p in some]).alias("m")).collect()}
        for i, doc in enumerate(docs):
            assert got[i][0] == [holds(doc, p) for p in some], (doc, some)
            assert all(m or not h for h, m in zip(*got[i], strict=True))
        assert not any(got[len(docs)][0] + got[len(docs) + 1][0])


def minimal_spans(words, terms):
    """Spans that hold all terms and no shorter span that does, by trying all."""
    holding = [(a, b) for a in range(len(words)) for b in range(a, len(words)) if set(terms) <= set(words[a : b + 1])]
    return [(a, b) for a, b in holding if not any((a <= c and d <= b) and (a, b) != (c, d) for c, d in holding)]


def test_cover_density(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "x", "y", "Délta"]) for _ in range(rng.randint(0, 25))) for _ in range(60)] + [None, ""]
    asked = {1: "alpha beta", 2: "Gamma", 3: "delta alpha alpha gamma", 4: "alpha unheard", 5: "x y", 6: None}
    queries = spark.createDataFrame(list(asked.items()), "query_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.query_id, r.doc_id): (round(r.score, 9), r.covers) for r in cover.cover_density(queries, docs).collect()}
    want = {}
    for q, terms in ((1, {"alpha", "beta"}), (2, {"gamma"}), (3, {"delta", "alpha", "gamma"})):
        for d, t in enumerate(texts):
            words = (t or "").lower().replace("é", "e").split()
            if spans := minimal_spans(words, terms):
                noise = [sum(w not in terms for w in words[a : b + 1]) for a, b in spans]
                want[q, d] = round(sum(0.1 / (1 + n) for n in noise), 9), len(spans)
    assert got == want


GOOD = {"F": 3.5, "C": 2.65, "W": 0.44, "FRF": 0.9, "PTN": 3.2, "PC": 0.78, "FT": 1.0, "D15": 1.032, "RVS": 9.5, "L15": 32.0, "L20": 30.5, "D": 1.0325, "RFF": 12.1}
RESULTS = {
    "van_slyke_original": (0.93 * 3.5 + 2.65 - 0.1) * 1.09 / 0.56, "van_slyke_otimizada": (0.9 * 3.5 + 3.2 * 0.78 * 1.11) / 0.56, "van_slyke_lkg": 100 / 1.032 / 9.5,
    "fleischmann": 1.2 * 3.5 + 266.5 * 0.032 / 1.032 + 0.25, "furtado": 4.2 + 8 + 0.25, "esd_fleischmann_furtado": 8.6, "richmond_f1": 8 + 4.2 + 0.14, "richmond_f2": 7.625 + 4.2 + 0.5,
    "richmond_f3": 8 + 0.7 + 0.14, "richmond_f4": 7.625 + 0.7 + 0.5, "densidade_para_graus_lactometricos": 32.5, "furtado_soro": 4.2 + 32 / 4.33 + 0.25,
}


def computed(spark, slug, kind="filados", **changed):
    row = {**GOOD, **changed}
    df = spark.createDataFrame([(slug, kind, *row.values())], "slug string, kind string, " + ", ".join(f"{k} double" for k in row))
    return tuple(df.select(formulas.compute(F.col("slug"), {k: F.col(k) for k in row}, F.col("kind")).alias("r")).first().r)


@pytest.mark.parametrize("slug", sorted(RESULTS))
def test_formulas(spark, slug):
    result, error = computed(spark, slug)
    assert error is None and math.isclose(result, RESULTS[slug], abs_tol=5.1e-5)


def test_every_fault_is_told(spark):
    range_faults = [("van_slyke_original", {"W": 1.0}), ("van_slyke_original", {"W": -0.1}), ("van_slyke_otimizada", {"W": 1.5}), ("van_slyke_lkg", {"D15": 0.0}), ("van_slyke_lkg", {"RVS": -1.0}), ("fleischmann", {"D15": -1.0})]
    for slug, changed in range_faults:
        result, error = computed(spark, slug, **changed)
        assert result is None and error.startswith(f"{next(iter(changed))} must be")
    assert computed(spark, "furtado", F=None, L15=None) == (None, "missing: F, L15")
    assert computed(spark, "furtado", F=float("nan")) == (None, "not finite: F")
    assert computed(spark, "furtado", L15=float("inf")) == (None, "not finite: L15")
    assert computed(spark, "esd_fleischmann_furtado", RFF=1e308, F=-1e308) == (None, "result not finite")
    assert computed(spark, "van_slyke_otimizada", kind="gouda") == (None, "unknown kind")
    assert computed(spark, "van_slyke_otimizada", kind=None) == (None, "missing: FC")
    assert computed(spark, "van_slyke_otimizada", kind=" FILADOS") == computed(spark, "van_slyke_otimizada", kind="1.11")
    assert computed(spark, "van_slyke_otimizada", kind=None, FC=1.11)[0] == computed(spark, "van_slyke_otimizada")[0]
    assert computed(spark, None) == computed(spark, "other") == (None, "unknown formula")
    assert {r.formula for r in formulas.listing(spark).collect()} == set(RESULTS)


def test_formulas_named_beforehand_agree_with_those_chosen_by_row(spark):
    """A name known beforehand gives the one formula's columns, without a function called for each row."""
    rows = [(2.0, None, 0.5, 0.0, 1.0, "duros"), (float("nan"), 3.0, 1.5, 1.1, 0.0, "gouda"), (1.0, 2.0, 0.2, 1.2, float("inf"), None), (3.5, 2.5, 0.4, 1.03, 30.0, "1.25")]
    df = spark.createDataFrame(rows, "F double, C double, W double, D15 double, L15 double, kind string")
    inputs = {k: F.col(k) for k in df.columns[:-1]} | {k: F.col("L15") for k in ("FRF", "PTN", "PC", "FT", "RVS", "L20", "D", "RFF")}
    for name in (*formulas.CATALOGUE, "no_such_formula"):
        one = df.select(formulas.compute(name, inputs, F.col("kind")).alias("r"))
        by_row = df.withColumn("slug", F.lit(name)).select(formulas.compute(F.col("slug"), inputs, F.col("kind")).alias("r"))
        assert one.collect() == by_row.collect()
        assert "lambda" not in one._jdf.queryExecution().executedPlan().toString()
