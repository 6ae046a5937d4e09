"""JSON documents as VARIANT: access by path and containment of a pattern."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(c: Column | str) -> Column:
    """The document, null where it is none."""
    return F.try_parse_json(c)


def field(doc: Column, path: str, kind: str = "string") -> Column:
    """The value at a path like $.a.b[0], null where it is missing or of another kind."""
    return F.try_variant_get(doc, path, kind)


def _member(v: Column, key: str) -> Column:
    """An object's value under a key; a path names it, unless the key has signs that no path can."""
    for quote in "'\"":
        if key and not set(key) & {quote, "?"}:
            return F.try_variant_get(v, f"$[{quote}{key}{quote}]", "variant")
    return F.try_element_at(F.try_variant_get(v, "$", "map<string,variant>"), F.lit(key))


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def contains(v: Column, pattern: Any) -> Column:
    """Whether a document contains the pattern (a Python value as json.loads gives it): an object every key of the pattern
    with a value that contains the pattern's, an array for each element of the pattern one that contains it, in any order
    and as often as may be, a scalar an equal one of the same kind, numbers by value. An array also contains a scalar
    that is among its elements, but only at the top. The pattern becomes one expression; there is no recursion over rows.
    A null document contains nothing, not even the empty pattern: the result is false."""
    top = _contains(v, pattern)
    if not isinstance(pattern, (dict, list)):
        top = top | (_kind(v) == "ARRAY") & _any(v, pattern)
    return F.coalesce(top & v.isNotNull(), F.lit(False))


def _any(v: Column, pattern: Any) -> Column:
    """Whether an element of an array contains the pattern."""
    return F.coalesce(F.exists(F.try_variant_get(v, "$", "array<variant>"), lambda e: _contains(e, pattern)), F.lit(False))


def _contains(v: Column, pattern: Any) -> Column:
    kind = _kind(v)
    if isinstance(pattern, dict):
        out = kind == "OBJECT"
        for key, inner in pattern.items():
            out = out & F.coalesce(_contains(_member(v, key), inner), F.lit(False))
    elif isinstance(pattern, list):
        out = kind == "ARRAY"
        for inner in pattern:
            out = out & _any(v, inner)
    elif pattern is None:
        out = kind == "VOID"
    elif isinstance(pattern, bool):
        out = (kind == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == pattern)
    elif isinstance(pattern, (int, float)):
        out = kind.isin("BIGINT", "DOUBLE", "DECIMAL") & (F.try_variant_get(v, "$", "double") == float(pattern))
    else:
        out = (kind == "STRING") & (F.try_variant_get(v, "$", "string") == str(pattern))
    return F.coalesce(out, F.lit(False))


def may_contain(raw: Column, pattern: Any) -> Column:
    """A test on the document's text that lets through everything that contains the pattern, and little else: every key, in
    quotes, is somewhere in it. Texts with escapes are let through. It can be pushed below the parsing."""
    keys: set[str] = set()

    def walk(p: Any) -> None:
        if isinstance(p, dict):
            keys.update(p)
        for inner in p.values() if isinstance(p, dict) else p if isinstance(p, list) else ():
            walk(inner)

    walk(pattern)
    out = F.lit(True)
    for key in sorted(keys):
        out = out & F.contains(raw, F.lit(json.dumps(key, ensure_ascii=False)))
    return F.contains(raw, F.lit("\\")) | out
