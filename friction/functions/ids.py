"""Identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def java_hash(text: Column) -> Column:
    """The 32-bit string hash h = 31 h + c, signed, as a long (characters of the basic plane)."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: (a * 31 + c).bitwiseAND(F.lit(4294967295)))
    return F.when(h >= 2147483648, h - F.lit(4294967296)).otherwise(h)


def pick_variant(session: Column, kind: Column, n: Column) -> Column:
    """The same variant for a session and type each time."""
    return F.abs(java_hash(F.concat_ws(":", session, kind))) % n


def doubled_hex(text: Column) -> Column:
    h = F.lower(F.hex(F.abs(java_hash(text))))
    return F.rpad(F.substring(F.concat(h, h), 1, 16), 16, "0")


def row_id(kind: Column, element: Column, variant: Column) -> Column:
    """Names an intervention for all sessions."""
    return F.concat(F.lit("iv_"), doubled_hex(F.concat(kind, F.lit("|"), F.coalesce(element, F.lit("_")), F.lit("|v"), variant)))


def tracking_id(session: Column, kind: Column, element: Column, variant: Column) -> Column:
    """Names an intervention in one session."""
    return F.concat(F.lit("iv_"), doubled_hex(F.concat(session, F.lit("|"), kind, F.lit("|"), F.coalesce(element, F.lit("_")), F.lit("|v"), variant)))


def element_id(org: Column, path: Column, descriptor: Column) -> Column:
    return F.concat(F.lit("sh_"), F.substring(F.sha2(F.concat_ws(":", org, path, descriptor), 256), 1, 32))


def user_hash(user: Column) -> Column:
    return F.substring(F.sha2(user, 256), 1, 32)
