"""Identities, buckets and orders from hashes: the same on every run and machine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix: and 16 hex digits of the SHA-256 of the parts, a unit separator between them; null parts are empty."""
    joined = F.concat_ws("\u001f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit(f"{prefix}:"), F.substring(F.sha2(joined, 256), 1, 16))


def hash_number(key: Column) -> Column:
    """The first 8 hex digits of the key's SHA-256, as a number."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("long")


def hash_bucket(key: Column, n: int) -> Column:
    return hash_number(key) % n


def hash_fraction(key: Column) -> Column:
    """In [0, 1): the first 8 bytes of the key's SHA-256."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / float(1 << 64)


def hash_order(key: Column) -> Column:
    return F.sha2(key.cast("string"), 256)


def shard(stable: Column, digits: int = 2) -> Column:
    """The first hex digits after a stable id's prefix."""
    return F.lower(F.substring(F.element_at(F.split(stable, ":"), -1), 1, digits))


def first_key(*candidates: tuple[str, Column]) -> Column:
    """The first candidate that isn't blank, with its authority before it: ('chebi', col)..."""
    return F.coalesce(*(F.when(F.trim(c) != "", F.concat(F.lit(f"{name}:"), F.trim(c))) for name, c in candidates))


def code_text(number: Column) -> Column:
    """An identifier's text without zeros after its point: 338.0 is 338, and not 338.1."""
    text = F.trim(number.cast("string"))
    return F.when(text.rlike(r"^\d+\.\d+$"), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text)
