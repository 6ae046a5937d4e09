"""Unicode normal forms and wrongly decoded text as column expressions.

Texts that a form cannot change, told by a character class, stay in the JVM; the others are handed to Python's unicodedata
in Arrow batches. Dropping the marks of single letters is a translation inside the JVM; its table is made from the
character database, for the blocks from Latin-1 to Cyrillic.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

BLOCKS = range(0xA0, 0x530)  # Latin-1 to Cyrillic
IDEOGRAPHS = (0x4E00, 0x9FFF)
PUNCTUATION = (0x2010, 0x2013, 0x2014, 0x2018, 0x2019, 0x201C, 0x201D, 0x201E, 0x2022, 0x20AC)  # fixed values: what no form changes


def without_marks(s: str) -> str:
    """NFKD without combining marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def char_class(points: list[int]) -> str:
    """A regular expression's class of what is not ASCII, an ideograph or one of these code points."""
    runs: list[list[int]] = []
    for p in sorted({*points, *(p for p in PUNCTUATION if p != 0x2011)}):
        if runs and p == runs[-1][1] + 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return "[^\\x00-\\x7F" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in [*runs, IDEOGRAPHS]) + "]"


MARKED = {chr(p): without_marks(chr(p)) for p in BLOCKS if len(without_marks(chr(p))) == 1}
ACCENTED = "".join(c for c, plain in MARKED.items() if c != plain)
FOLDED = "".join(MARKED[c] for c in ACCENTED)
NEEDS_NFKD = char_class([ord(c) for c in MARKED])
NEEDS_NFKC = char_class([p for p in BLOCKS if unicodedata.is_normalized("NFKC", chr(p)) and not unicodedata.combining(chr(p))])
BEYOND_ASCII = r"(?=[^\x00-\x7F])"  # in front of a class: ASCII is passed over by one test, not by one for each of its ranges


@F.pandas_udf(StringType())
def _unmarked(texts: pd.Series) -> pd.Series:
    return texts.map(without_marks, na_action="ignore")


@F.pandas_udf(StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def unmarked(c: Column | str) -> Column:
    """NFKD without combining marks, for any text."""
    c = column(c)
    return F.coalesce(_unmarked(F.when(c.rlike(BEYOND_ASCII + NEEDS_NFKD), c)), F.translate(c, ACCENTED, FOLDED))


def nfkc(c: Column | str) -> Column:
    c = column(c)
    return F.coalesce(_composed(F.when(c.rlike(BEYOND_ASCII + NEEDS_NFKC), c)), c)


# What is left of UTF-8 read as Latin-1 or cp1252, the least number of such marks that tells a garbled text,
# and the last resort, where neither decoding leads back.
MARKERS = ("Ã", "Â", "â€“", "â€”", "â€™", "â€œ", "â€", "�")
LEAST_MARKERS = 3
STAND_INS = {"–": "-", "—": "-", "‘": "'", "’": "'", "“": '"', "”": '"', "…": "..."}


def byte_map() -> dict[str, int]:
    """cp1252: the byte of each character, Latin-1 where cp1252 has none."""
    out = {chr(b): b for b in range(256)}
    for b in range(0x80, 0xA0):
        try:
            out[bytes([b]).decode("cp1252")] = b
        except UnicodeDecodeError:
            continue
    return out


CP1252 = byte_map()
#: Pairs that a letter turns into, with the letter: U+00A0 to U+00FF, the longest first, by either reading of its bytes.
PAIRS = {"".join(reading): chr(p) for p in range(0xA0, 0x100) for reading in ([chr(b) for b in chr(p).encode()], [bytes([b]).decode("cp1252", "replace") for b in chr(p).encode()]) if "�" not in reading}
PAIRS |= {s.encode().decode("cp1252", "ignore"): plain for s, plain in STAND_INS.items()}


def count_markers(c: Column | str) -> Column:
    """How many signs of a wrong decoding a text has; a sign that holds another one counts for both."""
    return sum((F.regexp_count(c, F.lit(m)) for m in MARKERS), F.lit(0)).cast("long")


def repaired(s: str) -> str:
    """The text with its characters taken for bytes and read as UTF-8, if that leaves fewer 'Ã': characters beyond Latin-1
    or, in the second try, beyond cp1252 are dropped, and so are bytes that are no UTF-8. Otherwise each known pair of
    characters gives its letter, the longest first."""
    for table in ({chr(b): b for b in range(256)}, {c: b for c, b in CP1252.items() if b < 0x80 or b >= 0xA0 or ord(c) > 0xFF}):
        found = bytes(table[c] for c in s if c in table).decode("utf-8", "ignore")
        if found.count("Ã") < s.count("Ã"):
            return found
    out, at = [], 0
    while at < len(s):
        for size in (3, 2):
            if s[at : at + size] in PAIRS:
                out.append(PAIRS[s[at : at + size]])
                at += size
                break
        else:
            out.append("" if s[at] == "Â" else s[at])
            at += 1
    return "".join(out)


@F.pandas_udf(StringType())
def _repaired(texts: pd.Series) -> pd.Series:
    return texts.map(repaired, na_action="ignore")


def repair(c: Column | str) -> Column:
    """Garbled texts repaired; a text with fewer than LEAST_MARKERS signs of a wrong decoding stays as it is."""
    c = column(c)
    return F.coalesce(_repaired(F.when(count_markers(c) >= LEAST_MARKERS, c)), c)
