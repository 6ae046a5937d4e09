"""Arithmetic over columns: costs, confidence, and the formula catalogue. Bad input gives null and says why
in a column beside it, never an error of the job."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def routing_cost(agents: Column, tries: Column) -> Column:
    """Two calls, then one per agent and try."""
    return F.lit(0.0005) + F.lit(0.0008) + F.greatest(F.lit(1), agents) * (1 + tries) * F.lit(0.0015)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def bucket(confidence: Column, high: float = 0.86, medium: float = 0.55) -> Column:
    return F.when(confidence >= high, "high").when(confidence >= medium, "medium").otherwise("low")


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, 100 * part / whole)


def dilution(c1: Column, v1: Column, c2: Column) -> Column:
    """V2 of C1 V1 = C2 V2."""
    return F.when(c2 > 0, c1 * v1 / c2)


# Correction factors by kind of cheese, and the twelve formulas with their constants.
FACTORS = {"massa_mole": 1.18, "filados": 1.11, "continentais": 1.11, "duros": 1.09}


@dataclass(frozen=True)
class Formula:
    """inputs: the names a formula needs, in order; of: its expression over columns of those names."""

    inputs: tuple[str, ...]
    unit: str
    written: str
    of: Callable[..., Column]


CATALOGUE: dict[str, Formula] = {
    "van_slyke_original": Formula(("F", "C", "W"), "kg/100L", "(0.93 F + C - 0.1) 1.09 / (1 - W)", lambda F, C, W: (0.93 * F + C - 0.1) * 1.09 / (1 - W)),
    "van_slyke_otimizada": Formula(("FRF", "F", "PTN", "PC", "FT", "FC", "W"), "kg/100L", "(FRF F + PTN PC FT FC) / (1 - W)", lambda FRF, F, PTN, PC, FT, FC, W: (FRF * F + PTN * PC * FT * FC) / (1 - W)),
    "van_slyke_lkg": Formula(("D15", "RVS"), "L/kg", "100 / D15 / RVS", lambda D15, RVS: 100 / D15 / RVS),
    "fleischmann": Formula(("F", "D15"), "%", "1.2 F + 266.5 (D15 - 1) / D15 + 0.25", lambda F, D15: 1.2 * F + 266.5 * (D15 - 1) / D15 + 0.25),
    "furtado": Formula(("F", "L15"), "%", "1.2 F + 0.25 L15 + 0.25", lambda F, L15: 1.2 * F + 0.25 * L15 + 0.25),
    "esd_fleischmann_furtado": Formula(("RFF", "F"), "%", "RFF - F", lambda RFF, F: RFF - F),
    "richmond_f1": Formula(("L15", "F"), "%", "L15 / 4 + 1.2 F + 0.14", lambda L15, F: L15 / 4 + 1.2 * F + 0.14),
    "richmond_f2": Formula(("L20", "F"), "%", "L20 / 4 + 1.2 F + 0.50", lambda L20, F: L20 / 4 + 1.2 * F + 0.50),
    "richmond_f3": Formula(("L15", "F"), "%", "L15 / 4 + 0.2 F + 0.14", lambda L15, F: L15 / 4 + 0.2 * F + 0.14),
    "richmond_f4": Formula(("L20", "F"), "%", "L20 / 4 + 0.2 F + 0.50", lambda L20, F: L20 / 4 + 0.2 * F + 0.50),
    "densidade_para_graus_lactometricos": Formula(("D",), "°GL", "1000 (D - 1)", lambda D: (D - 1) * 1000),
    "furtado_soro": Formula(("F", "L15"), "%", "1.2 F + L15 / 4.33 + 0.25", lambda F, L15: 1.2 * F + L15 / 4.33 + 0.25),
}
#: What an input must lie in, where its formulas divide by it: (formulas, input, test, what is wrong).
RANGES = (
    (("van_slyke_original", "van_slyke_otimizada"), "W", lambda x: (x >= 0) & (x < 1), "W must be at least 0 and below 1"),
    (("van_slyke_lkg", "fleischmann"), "D15", lambda x: x > 0, "D15 must be above 0"),
    (("van_slyke_lkg",), "RVS", lambda x: x > 0, "RVS must be above 0"),
)


def factor(kind: Column) -> Column:
    """FC of a kind by name, in any case, or of a number written out; null for anything else."""
    names = F.create_map(*[F.lit(x) for pair in FACTORS.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.lower(F.trim(kind))), kind.try_cast("double"))


def compute(slug: Column | str, inputs: dict[str, Column], kind: Column | None = None, digits: int = 4) -> Column:
    """Struct of result and error for the formula that `slug` names, by row if it is a column: exactly one of them is null.
    inputs are columns by name; kind (a name or a number written out) gives FC where it is not among them. The first fault
    counts: a formula nobody knows, inputs that are null, inputs that are no finite number, an input out of its range, a
    result that is no finite number."""
    known = {k: v.cast("double") for k, v in inputs.items()}
    unknown = F.struct(F.lit(None).cast("double").alias("result"), F.lit("unknown formula").alias("error"))
    if isinstance(slug, str):
        return _computed(CATALOGUE[slug], slug, known, kind, digits) if slug in CATALOGUE else unknown
    chosen = F
    for name, formula in CATALOGUE.items():
        chosen = chosen.when(slug == name, _computed(formula, name, known, kind, digits))
    return chosen.otherwise(unknown)


def _computed(formula: Formula, name: str, known: dict[str, Column], kind: Column | None, digits: int) -> Column:
    by_kind = kind is not None and "FC" in formula.inputs and "FC" not in known
    own = {k: known.get(k, F.lit(None).cast("double")) for k in formula.inputs}
    if by_kind:
        own["FC"] = factor(kind)
    finite = lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))
    named = lambda said, tests: F.concat(F.lit(said), F.concat_ws(", ", *[F.when(test, k) for k, test in tests.items()]))
    gaps = {k: x.isNull() for k, x in own.items() if k != "FC" or not by_kind}
    odd = {k: ~finite(x) for k, x in own.items()}
    fault = F.when(reduce(Column.__or__, gaps.values()), named("missing: ", gaps))
    if by_kind:
        fault = fault.when(kind.isNull(), "missing: FC").when(own["FC"].isNull(), "unknown kind")
    fault, guarded = fault.when(reduce(Column.__or__, odd.values()), named("not finite: ", odd)), dict(own)
    for formulas, key, test, said in RANGES:
        if name in formulas:
            fault, guarded[key] = fault.when(~test(own[key]), said), F.when(test(own[key]), own[key])
    value = formula.of(**guarded)
    fault = fault.when(~finite(value), "result not finite")
    return F.struct(F.when(fault.isNull(), F.round(value, digits)).alias("result"), fault.alias("error"))


def listing(spark: SparkSession) -> DataFrame:
    """The catalogue as a table: formula, unit, written, inputs. Fixed and small."""
    rows = [(name, f.unit, f.written, list(f.inputs)) for name, f in CATALOGUE.items()]
    return spark.createDataFrame(rows, "formula string, unit string, written string, inputs array<string>")
