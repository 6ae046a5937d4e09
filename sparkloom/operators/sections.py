"""Sections of Markdown texts, and glossaries in their several written forms. Folds inside the row, without a shuffle."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import text
from .chunking import recursive_chunks

LEVELS = 4


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def sections(c: Column | str) -> Column:
    """Array of (first, path, lines): the runs of lines under one heading, in order. first is the number of the first line
    (from 0) after the heading, path the open headings of levels 1 to 4, outermost first, where a heading closes those of
    its level and below; lines are what stands under it. A heading is one to four signs and a blank or nothing behind them;
    lines between fences of three back-ticks or tildes are none. What stands before the first heading has an empty path."""
    lines = F.split(c, "\n")
    hashes = lambda t: F.length(F.regexp_extract(t, rf"^(#{{1,{LEVELS}}})(\s|$)", 1))
    seen = F.transform(F.transform(lines, lambda x: text.strip(x)), lambda t, i: F.struct(i.alias("at"), hashes(t).alias("level"), text.strip(F.regexp_replace(t, "^#+", "")).alias("name"), F.regexp_extract(t, r"^(```(?!.*```)|~~~)", 1).alias("opens"), F.regexp_extract(t, "^(```|~~~)", 1).alias("closes")))
    before = F.struct(F.lit(-1).alias("at"), F.array(*[F.lit("")] * LEVELS).alias("stack"))
    start = F.struct(F.lit("").alias("fence"), F.array(*[F.lit("")] * LEVELS).alias("stack"), F.array(before).alias("heads"))

    def step(acc: Column, x: Column) -> Column:
        inside = acc["fence"] != ""
        fence = F.when(inside, F.when(x["closes"] == acc["fence"], "").otherwise(acc["fence"])).otherwise(x["opens"])
        level = F.when(inside | (x["opens"] != ""), 0).otherwise(x["level"])
        stack = F.transform(acc["stack"], lambda h, j: F.when(j + 1 < level, h).when(j + 1 == level, x["name"]).otherwise(F.lit("")))
        headed = F.struct(fence.alias("fence"), stack.alias("stack"), F.array_append(acc["heads"], F.struct(x["at"].alias("at"), stack.alias("stack"))).alias("heads"))
        return F.when(level > 0, headed).otherwise(F.struct(fence.alias("fence"), acc["stack"].alias("stack"), acc["heads"].alias("heads")))

    heads = F.aggregate(seen, start, step, lambda acc: acc["heads"])
    ends = F.transform(heads, lambda h, k: F.coalesce(F.get(heads, k + 1)["at"], F.size(lines)))
    return F.zip_with(heads, ends, lambda h, end: F.struct((h["at"] + 1).alias("first"), F.filter(h["stack"], lambda x: x != "").alias("path"), F.slice(lines, h["at"] + 2, end - h["at"] - 1).alias("lines")))


@F.pandas_udf(ArrayType(StringType()))
def _cut(texts: pd.Series, size: pd.Series, overlap: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else recursive_chunks(t, int(s), int(o)) for t, s, o in zip(texts, size, overlap, strict=True)])


def section_chunks(docs: DataFrame, size: int | Column = 800, overlap: int | Column = 200, ratio: float | Column = 1.5, most: int | Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """docs(doc_id, text) to (doc_id, section, path, i, chunk, oversize): each section with text, its path in front. One
    longer than size times ratio (or than `most`, if less) is cut by recursive chunking; the others stay whole, in the JVM.
    Sections are numbered with the empty ones, which give no chunk. A null text has none. Columns named in carry come along."""
    value = lambda x: x if isinstance(x, Column) else F.lit(x)
    bound = F.floor(value(size) * value(ratio))
    bound = F.least(bound, value(most)) if most is not None else bound
    bounds = docs.select("doc_id", *carry, "text", value(size).cast("int").alias("_size"), value(overlap).cast("int").alias("_overlap"), bound.cast("int").alias("_bound"))
    parts = bounds.select("doc_id", *carry, "_size", "_overlap", "_bound", F.posexplode(sections("text")).alias("section", "s"))
    parts = parts.withColumn("path", F.array_join("s.path", " > ")).withColumn("body", text.strip(F.array_join("s.lines", "\n"))).where("body <> ''")
    parts = parts.withColumn("chunk", F.when(F.col("path") == "", F.col("body")).otherwise(F.concat_ws("\n", "path", "body")))
    parts = parts.withColumn("oversize", F.length("chunk") > F.col("_bound"))
    cut = F.coalesce(_cut(F.when(F.col("oversize"), F.col("chunk")), "_size", "_overlap"), F.array("chunk"))
    return parts.select("doc_id", *carry, "section", "path", F.posexplode(cut).alias("i", "chunk"), "oversize")


# The words that a glossary's lines begin with, what separates records, and the form of an entry.
TERM_LABELS = ("palavra encontrada", "termo", "term")
MEANING_LABELS = ("substituicao", "substituição", "equivalente", "substitution")
NOT_TERMS = ("fonte:", "nota:")
RECORD = "registro|record"
BREAKS = r"\r\n?|\n"
ENTRY = ("termo: ", " | substituicao: ")


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ \-;:.]+|[ \-;:.]+$", "")


def glossary(c: Column | str) -> Column:
    """Array of (term, meaning) from a glossary's text, in order, without those that came before in any case. The text is to
    be in NFKC, as a column of its own (functions.unicode.nfkc).

    A text with a bar in any line is a table: its first two columns, without headings and rulers. Otherwise lines are read
    with the open term carried on: 'term: x' opens one, 'substitution: y' gives its meaning (the last one counts), and the
    next term, a record's heading, 'a -> b' or 'a: b' closes it; the last two are entries of their own. Bullets are left
    out, lines that begin like a source or a note are no entries."""
    lines = F.filter(F.transform(F.split(c, BREAKS), text.strip), lambda x: x != "")
    barred = F.filter(lines, lambda x: F.contains(x, F.lit("|")))
    entry = lambda term, meaning: F.struct(_trimmed(term).alias("term"), _trimmed(meaning).alias("meaning"))

    header = lambda x: F.lower(x).rlike("|".join(TERM_LABELS)) & F.contains(F.lower(x), F.lit("substit"))
    ruler = lambda x: x.rlike(r"^\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)+\|?$")
    cells = F.transform(F.filter(barred, lambda x: ~header(x) & ~ruler(x)), lambda x: F.split(F.regexp_replace(x, r"^\|+|\|+$", ""), r"\|"))
    table = F.transform(F.filter(cells, lambda p: F.size(p) >= 2), lambda p: entry(text.collapse(p[0]), text.collapse(p[1])))

    def labelled(x: Column, labels: tuple[str, ...]) -> Column:
        return F.regexp_extract(x, rf"(?iu)^(?:{'|'.join(labels)})\s*:\s*(.+)$", 1)

    def read(line: Column) -> Column:
        plain = F.regexp_replace(line, r"^\s*[-*]\s*", "")
        arrow, colon = F.split(plain, "->", 2), F.split(plain, ":", 2)
        term, meaning = labelled(plain, TERM_LABELS), labelled(plain, MEANING_LABELS)
        source = F.lower(plain).rlike("^(" + "|".join(NOT_TERMS) + ")")
        kind = (
            F.when(line.startswith("#"), F.when(F.lower(line).rlike(RECORD), "record").otherwise("none"))
            .when(term != "", "term").when(meaning != "", "meaning").when(F.size(arrow) == 2, "pair").when((F.size(colon) == 2) & ~source, "colon").otherwise("none")
        )
        left = F.when(term != "", term).when(meaning != "", meaning).when(F.size(arrow) == 2, arrow[0]).otherwise(colon[0])
        right = F.when(F.size(arrow) == 2, arrow[1]).otherwise(F.get(colon, F.lit(1)))
        return F.struct(kind.alias("kind"), _trimmed(left).alias("left"), F.coalesce(_trimmed(right), F.lit("")).alias("right"))

    pair = "struct<term: string, meaning: string>"
    start = F.struct(F.lit("").alias("term"), F.lit("").alias("meaning"), _empty(pair).alias("out"))
    one = lambda term, meaning: F.struct(term.alias("term"), meaning.alias("meaning"))

    def flushed(acc: Column) -> Column:
        return F.when((acc["term"] != "") & (acc["meaning"] != ""), F.array_append(acc["out"], one(acc["term"], acc["meaning"]))).otherwise(acc["out"])

    def step(acc: Column, x: Column) -> Column:
        state = lambda term, meaning, out: F.struct(term.alias("term"), meaning.alias("meaning"), out.alias("out"))
        nothing, whole = F.lit(""), (x["left"] != "") & (x["right"] != "")
        return (
            F.when(x["kind"] == "term", state(x["left"], nothing, flushed(acc)))
            .when(x["kind"] == "meaning", state(acc["term"], x["left"], acc["out"]))
            .when(x["kind"] == "record", state(nothing, nothing, flushed(acc)))
            .when(x["kind"].isin("pair", "colon") & whole, state(nothing, nothing, F.array_append(flushed(acc), one(x["left"], x["right"]))))
            .when(x["kind"] == "pair", state(nothing, nothing, flushed(acc)))
            .otherwise(acc)
        )

    listed = F.aggregate(F.transform(F.transform(lines, text.collapse), read), start, step, flushed)
    found = F.when(F.size(barred) > 0, F.filter(table, lambda e: (e["term"] != "") & (e["meaning"] != ""))).otherwise(listed)
    lowered = F.transform(found, lambda e: F.lower(F.concat_ws("\x00", e["term"], e["meaning"])))
    return F.filter(found, lambda e, i: F.array_position(lowered, F.get(lowered, i)) == i + 1)


def glossary_text(c: Column | str) -> Column:
    """A glossary in its canonical form, one entry a line; lines without any entry stay, collapsed. Nothing gives ''."""
    entries = F.transform(glossary(c), lambda e: F.concat(F.lit(ENTRY[0]), e["term"], F.lit(ENTRY[1]), e["meaning"]))
    lines = F.filter(F.transform(F.split(c, BREAKS), text.collapse), lambda x: x != "")
    distinct = F.transform(lines, F.lower)
    kept = F.filter(lines, lambda x, i: F.array_position(distinct, F.lower(x)) == i + 1)
    out = F.when(F.size(entries) > 0, entries).when(F.exists(lines, lambda x: F.contains(x, F.lit("|"))), _empty("string")).otherwise(kept)
    return F.when(F.size(out) > 0, F.concat(F.array_join(out, "\n"), F.lit("\n"))).otherwise("")
