"""Hashes as folds over characters, in SQL terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FNV_BASIS, FNV_PRIME, U32 = 2166136261, 16777619, 4294967295


def _codes(text: Column) -> Column:
    return F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))


def fnv1a32(text: Column) -> Column:
    """FNV-1a over a string's characters, as an unsigned 32-bit number."""
    return F.aggregate(_codes(text), F.lit(FNV_BASIS).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(U32)))


def hash31(text: Column) -> Column:
    """``h * 31 + c`` modulo 2 ** 32, as used for ids of signatures and nodes."""
    return F.aggregate(_codes(text), F.lit(0).cast("long"), lambda h, c: (h * F.lit(31) + c).bitwiseAND(F.lit(U32)))


def candidate_key(*parts: Column) -> Column:
    """The first 16 hex digits of the SHA-1 of parts joined by a pipe; null parts are empty."""
    return F.substring(F.sha1(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))), 1, 16)


def bucket(text: Column, modulo: int) -> Column:
    return fnv1a32(text) % modulo
