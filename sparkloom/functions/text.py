"""Column expressions over text. All are built-in functions that run inside code generation; only rare texts are handed to
Python: those with odd entities in html_to_text, and those that a Unicode normal form may change beyond single letters."""

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .unicode import nfkc, unmarked

def strip(c: Column | str) -> Column:
    """White space off both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


#: Characters whose capital is several characters, and what stands for it alone: a title form, or the character itself.
LONG_CAPITALS = {c: "\u1e9e" if c == "\xdf" else c.title() if len(c.title()) == 1 else c for c in map(chr, range(0x10000)) if len(c.upper()) > 1}


def capital(c: Column) -> Column:
    """The capital of a single character, as a single character."""
    return F.when(F.length(F.upper(c)) > 1, F.translate(c, "".join(LONG_CAPITALS), "".join(LONG_CAPITALS.values()))).otherwise(F.upper(c))


def collapse(c: Column | str) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return strip(F.regexp_replace(c, r"\s+", " "))


BLANKS = r"[\s\x1C-\x1F\x85\u1680\u2028\u2029]+"  # what is left of Unicode's white space after NFKD


def plain(c: Column) -> Column:
    """Lower case and collapsed white space: what fold() does after the marks are gone."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), BLANKS, " "), "^ | $", "")


def fold(c: Column | str) -> Column:
    """For comparing: NFKD without combining marks, lower case, white space collapsed."""
    return plain(unmarked(c))


def canonical(c: Column | str) -> Column:
    """The text that a document's hash is taken of: NFKC, line ends as newlines, runs of blanks and tabs as one blank, at most
    one blank line, nothing blank at the ends. A null text counts as empty."""
    t = F.translate(F.replace(nfkc(F.coalesce(c, F.lit(""))), F.lit("\r\n"), F.lit("\n")), "\r", "\n")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(t, f"^{BLANKS}|{BLANKS}$", "")


def alphanumerics(c: Column | str) -> Column:
    return F.regexp_count(c, F.lit(r"[\p{L}\p{N}]"))


def words(c: Column | str, least: int = 2) -> Column:
    """Words of at least `least` letters, digits or underscores."""
    return F.regexp_extract_all(c, F.lit(rf"([\p{{L}}\p{{N}}_]{{{least},}})"), F.lit(1))


def folded_words(c: Column | str, least: int = 2) -> Column:
    """The words of the folded text. White space need not be collapsed for that, so it is not."""
    return words(F.lower(unmarked(c)), least)


def keywords(c: Column | str, stop: tuple[str, ...] = (), least: int = 4) -> Column:
    """Distinct words of `least` characters or more in lower case, in order, without stop words."""
    found = F.array_distinct(words(F.lower(c), least))
    return F.array_except(found, F.array(*map(F.lit, stop))) if stop else found


def numbers(c: Column | str) -> Column:
    """Distinct digit groups with their punctuation taken out."""
    groups = F.regexp_extract_all(c, F.lit(r"(\d[\d.,]*)"), F.lit(1))
    return F.array_distinct(F.transform(groups, lambda g: F.regexp_replace(g, r"[^\d]", "")))


def is_good_chunk(c: Column | str, least: int = 60, share: float = 0.25) -> Column:
    """Long enough, not a lone mark, and mostly letters or digits."""
    text = strip(c)
    return (F.length(text) >= least) & ~text.rlike(r"^[^\p{L}\p{N}\s]$") & (alphanumerics(text) / F.greatest(F.length(text), F.lit(1)) >= share)


# What wrong decodings leave behind, and the least of a document (of a glossary entry) that is taken in.
GARBLED = r"[ÃÂÐÑ\x{FFFD}\x00]"
MOJIBAKE = ("Ã", "Â", "â€", "â€“", "â€”", "ï¿½")
LEAST_CHARS, LEAST_WORDS = 400, 80
LEAST_CHARS_GLOSSARY, LEAST_WORDS_GLOSSARY = 250, 30
MOST_GARBLED, MOST_MOJIBAKE, LEAST_SCORE = 0.08, 0.03, 60.0


def quality(c: Column | str, doc_type: Column | None = None) -> Column:
    """Struct of chars, words, garbled (share of odd characters), mojibake (marks a word), score (0 to 100) and reasons to
    reject, of the text in NFKC. Bounds are lower where doc_type is glossary."""
    c = nfkc(c)
    n, w = F.length(c), F.size(words(c))
    short = F.lower(F.trim(doc_type)) == "glossary" if doc_type is not None else F.lit(False)
    chars, count = F.when(short, LEAST_CHARS_GLOSSARY).otherwise(LEAST_CHARS), F.when(short, LEAST_WORDS_GLOSSARY).otherwise(LEAST_WORDS)
    garbled = F.regexp_count(c, F.lit(GARBLED)) / F.greatest(n, F.lit(1))
    marks = sum((F.regexp_count(c, F.lit(m)) for m in MOJIBAKE), F.lit(0)) / F.greatest(w, F.lit(1))
    score = F.round(100 * (0.35 * F.least(n / chars, F.lit(1.0)) + 0.35 * F.least(w / count, F.lit(1.0)) + 0.30 * F.greatest(1 - garbled / MOST_GARBLED, F.lit(0.0))) + 1e-9, 2)
    reasons = F.array(
        F.when(n < chars, "too short"),
        F.when(w < count, "too few words"),
        F.when(garbled > MOST_GARBLED, "odd characters"),
        F.when(marks > MOST_MOJIBAKE, "wrong decoding"),
        F.when(score < LEAST_SCORE, "low score"),
    )
    return F.struct(n.cast("long").alias("chars"), w.cast("long").alias("words"), F.round(garbled + 1e-12, 6).alias("garbled"), F.round(marks + 1e-12, 6).alias("mojibake"), score.alias("score"), F.array_compact(reasons).alias("reasons"))


def host(url: Column | str) -> Column:
    """Host of a URL in lower case, without user, port and a leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), r"^www\.", "")


def is_allowed(domain: Column, bases: tuple[str, ...]) -> Column:
    """The domain is a base or lies below one; no bases allow everything."""
    if not bases:
        return F.lit(True)
    hit = F.lit(False)
    for base in bases:
        hit = hit | (domain == base) | domain.endswith("." + base)
    return hit


@F.pandas_udf(StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: html.unescape(x.replace("&nbsp;", " ")) if x is not None else None)


def html_to_text(c: Column | str, most: int | None = None) -> Column:
    """Text of a page: scripts, styles and tags out, entities back to characters, white space collapsed; cut with an
    ellipsis if it is longer than `most`. The common entities are replaced by built-in functions; only texts with another
    one are handed to Python, which knows them all."""
    out = F.regexp_replace(c, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<noscript[^>]*>.*?</noscript>", " ")
    raw = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    rare = raw.rlike(r"&(?!(?:nbsp|lt|gt|quot|#39|copy|middot|amp);)(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")
    out = raw
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = collapse(F.coalesce(_unescaped(F.when(rare, raw)), F.regexp_replace(out, "&amp;?", "&")))
    return cut(out, most) if most else out


def cut(c: Column | str, most: int) -> Column:
    """At most `most` characters, with an ellipsis in the last three of them when cut."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.length(c) > most, F.concat(F.rtrim(F.substring(c, 1, most - 3)), F.lit("..."))).otherwise(c)


def sentences(c: Column | str) -> Column:
    return F.split(c, r"(?<=[.!?])\s+")
