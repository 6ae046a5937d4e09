"""Section stack, glossaries and phrase search against loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sparkloom.functions.unicode import nfkc
from sparkloom.operators import phrases, rules, sections
from sparkloom.operators.chunking import recursive_chunks
from sparkloom.plans.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"


def sections_of(text):
    stack, fence = [], ""
    out = [(0, [], [])]
    for at, line in enumerate(text.split("\n")):
        t = line.strip(" \t\r")
        mark = t[:3] if t[:3] in ("```", "~~~") else ""
        if fence:
            fence = "" if mark == fence else fence
        elif mark and not (mark == "```" and "```" in t[3:]):
            fence = mark
        elif m := re.match(r"(#{1,4})(\s|$)", t):
            stack = [h for h in stack if h[0] < len(m[1])] + [(len(m[1]), t.lstrip("#").strip())]
            out.append((at + 1, [name for _, name in stack if name], []))
            continue
        out[-1][2].append(line)
    return out


MARKDOWN = ["# One", "## Two", "### Three ", "#### Four", "##### five", "#no", "####", "text", "", "```", "```py", "``` a ```", "~~~", "~~~", " ## In", "| a |", "# One"]


def test_sections(spark):
    rng = random.Random(2)
    texts = ["\n".join(rng.choice(MARKDOWN) for _ in range(rng.randint(0, 25))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: [(s.first, list(s.path), list(s.lines)) for s in r.s] for r in df.select("i", sections.sections("t").alias("s")).collect()}
    assert got == {i: sections_of(t) for i, t in enumerate(texts)}


def test_section_chunks(spark):
    """Long sections are cut by recursive chunking, short ones stay whole; nulls have none."""
    rng = random.Random(3)
    texts = ["\n".join(rng.choice(["# Head", "## Deep", "word " * rng.randint(1, 40), "Some. Other! " * 5]) for _ in range(12)) for _ in range(40)]
    df = spark.createDataFrame([*enumerate(texts), (99, None), (98, "")], "doc_id int, text string")
    got = {(r.doc_id, r.section, r.i): r.chunk for r in sections.section_chunks(df, size=100, overlap=20, most=140).collect()}
    want = {}
    for d, text in enumerate(texts):
        for n, (_, path, lines) in enumerate(sections_of(text)):
            body = "\n".join(lines).strip()
            chunk = " > ".join(path) + "\n" + body if path else body
            if body:
                for i, c in enumerate(recursive_chunks(chunk, 100, 20) if len(chunk) > 140 else [chunk]):
                    want[d, n, i] = c
    assert got == want


def test_all_chunks_of_the_query_hold_their_sections(spark):
    parts = QUERIES["gen_03_chunks"](spark, FOLDER).collect()
    whole = {(r.doc_id, r.section): r for r in QUERIES["gen_03"](spark, FOLDER).collect()}
    assert {(r.doc_id, r.section) for r in parts} == set(whole)
    assert {k for k, r in whole.items() if not r.oversize} >= {(r.doc_id, r.section) for r in parts} - {k for k, r in whole.items() if r.oversize}


def entries_of(text):
    trim = lambda s: s.strip(" -;:.")
    lines = [x for x in (re.sub(r"\s+", " ", x).strip() for x in re.split(r"\r\n?|\n", text)) if x]
    out, term, meaning = [], "", ""
    if any("|" in x for x in lines):
        for x in lines:
            low = x.lower()
            if "|" not in x or ("substit" in low and any(w in low for w in sections.TERM_LABELS)) or re.fullmatch(r"\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)+\|?", x):
                continue
            cells = x.strip("|").split("|")
            if len(cells) > 1 and trim(cells[0]) and trim(cells[1]):
                out.append((trim(cells[0].strip()), trim(cells[1].strip())))
    else:
        for x in [*lines, "# record"]:
            if x.startswith("#"):
                if re.search("registro|record", x.lower()):
                    out += [(term, meaning)] if term and meaning else []
                    term = meaning = ""
                continue
            x = re.sub(r"^\s*[-*]\s*", "", x)
            if m := re.match(rf"({'|'.join(sections.TERM_LABELS)})\s*:\s*(.+)$", x, re.I):
                out += [(term, meaning)] if term and meaning else []
                term, meaning = trim(m[2]), ""
            elif m := re.match(rf"({'|'.join(sections.MEANING_LABELS)})\s*:\s*(.+)$", x, re.I):
                meaning = trim(m[2])
            elif "->" in x:
                a, b = map(trim, x.split("->", 1))
                out += [(term, meaning)] if term and meaning else []
                out += [(a, b)] if a and b else []
                term = meaning = ""
            elif ":" in x and not x.lower().startswith(sections.NOT_TERMS):
                a, b = map(trim, x.split(":", 1))
                if a and b:
                    out += [(term, meaning)] if term and meaning else []
                    out.append((a, b))
                    term = meaning = ""
    seen, kept = set(), []
    for t, m in out:
        if (t.lower(), m.lower()) not in seen:
            seen.add((t.lower(), m.lower()))
            kept.append((t, m))
    return kept


def test_glossary(spark):
    rng = random.Random(4)
    listed = ["## Registro 1", "# other", "- Palavra encontrada: Starter", "* Substituição:  Fermento;", "Termo: ", "termo: x ", "EQUIVALENTE: y", "a -> b", " -> b", "A -> b -> c", "c: d", "C : D", "Fonte: x", "nota: -> y", "plain", "", "e:", "- term: ﬁn"]
    tabled = ["| Termo | Substituição |", "|---|:--:|", "| a | b |", "| A |B | c |", "|x|", "| | y |", "text", "p | q", "-- | --"]
    texts = [rng.choice(["\n", "\r\n", "\r"]).join(rng.choice(kind) for _ in range(rng.randint(0, 14))) for kind in (listed, tabled) for _ in range(200)]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "i int, t string").withColumn("t", nfkc("t"))
    got = {r.i: (None if r.g is None else [tuple(e) for e in r.g], r.c) for r in df.select("i", sections.glossary("t").alias("g"), sections.glossary_text("t").alias("c")).collect()}
    assert got.pop(-1)[0] in (None, [])
    for i, t in enumerate(texts):
        entries = entries_of(t.replace("ﬁ", "fi"))
        assert got[i][0] == entries, t
        if entries:
            assert got[i][1] == "".join(f"termo: {a} | substituicao: {b}\n" for a, b in entries)
    df = spark.createDataFrame([("two  lines\nTwo lines\nx",), ("",)], "t string")
    assert [r.c for r in df.select(sections.glossary_text("t").alias("c")).collect()] == ["two lines\nx\n", ""]


@pytest.mark.parametrize("longest", [1, 3, 8])
def test_phrases(spark, longest):
    """Equal to a theta join on padded texts, for phrases that nest and overlap."""
    rng = random.Random(longest)
    draw = lambda n: " ".join(rng.choice("aabcdé") for _ in range(n))
    asked = {draw(rng.randint(1, longest)) for _ in range(60)} | {"zz", "a z"}
    texts = [draw(rng.randint(0, 40)) for _ in range(200)] + [""]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "i int, t string").withColumn("w", F.filter(F.split("t", " "), lambda x: x != ""))
    got = {(r.i, r.term, r.times) for r in phrases.hits(df, "i", "w", asked).collect()}
    want = {(i, p, n) for i, t in enumerate(texts) for p in asked if (n := len(re.findall(f"(?= {re.escape(p)} )", f" {t} ")))}
    assert got == want
    held = {r.i: list(r.h) for r in df.select("i", phrases.held(F.col("w"), asked).alias("h")).collect()}
    assert held == {-1: []} | {i: sorted(p for p in asked if f" {p} " in f" {t} ") for i, t in enumerate(texts)}
    assert phrases.hits(df, "i", "w", []).count() == 0


def test_rules_have_long_phrases(spark):
    assert max(len(t.split()) for t in rules.TERMS) == 8
    assert QUERIES["jn_10"](spark, "/root/testdata/sf0.01").where("size(split(term, ' ')) = 8").count() > 0
