"""Identities and deterministic fractions from sha256; each variant keeps its own width and rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha(*parts: Column, sep: str = "\x00") -> Column:
    return F.sha2(F.concat_ws(sep, *[p.cast("string") for p in parts]), 256)


def number(hexes: Column, digits: int) -> Column:
    """The first hex digits as an unsigned number."""
    return F.conv(F.substr(hexes, F.lit(1), F.lit(digits)), 16, 10).cast("decimal(20,0)")


def record_id(domain: Column, body: Column) -> Column:
    return F.substr(sha(domain, body), F.lit(1), F.lit(32))


def unit64(hexes: Column) -> Column:
    """First 16 digits over 2^64."""
    return number(hexes, 16).cast("double") / F.lit(2.0**64)


def unit32(hexes: Column) -> Column:
    """First 8 digits over 2^32 - 1."""
    return number(hexes, 8).cast("double") / F.lit(float(0xFFFFFFFF))


def tenth(hexes: Column) -> Column:
    """First 8 digits modulo 10."""
    return (number(hexes, 8) % 10).cast("int")


def priority(seed: int, *key: Column) -> Column:
    """A hex string to order by: the smallest are the sample."""
    return sha(F.lit(str(seed)), *key)
