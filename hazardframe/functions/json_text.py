"""Canonical form of JSON texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hazardframe.functions.base import col


def strip_keys(text, keys: list[str]) -> Column:
    """JSON text without scalar members of the given names, at any depth."""
    out = col(text)
    for k in keys:
        member = rf'"{k}"\s*:\s*("(?:[^"\\]|\\.)*"|[^,{{}}\[\]]+)'
        out = F.regexp_replace(F.regexp_replace(out, rf",\s*{member}", ""), rf"{member}\s*,?", "")
    return out


def canonical(text, strip: list[str] = ()) -> Column:
    """Compact JSON with sorted keys (VARIANT keeps object keys in order)."""
    return F.to_json(F.try_parse_json(strip_keys(text, list(strip))))


def canonical_hash(text, strip: list[str] = ()) -> Column:
    return F.sha2(canonical(text, strip), 256)
