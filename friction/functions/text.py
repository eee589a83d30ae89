"""Display and hashing helpers as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no function for it."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t), na_action=None)


def label_hash(label: Column) -> Column:
    """SHA-256 of the composed label, '' without one. Labels of ASCII are composed as they are: only others go to Python."""
    plain = label.rlike(r"^[\x00-\x7F]*$")
    composed = F.when(plain, label).otherwise(nfc(F.when(~plain, label)))
    return F.when(F.coalesce(label, F.lit("")) == "", F.lit("")).otherwise(F.sha2(composed, 256))


def context_hash(parts: dict[str, Column]) -> Column:
    """SHA-256 of the parts as JSON in the given order; nulls stay in it."""
    return F.sha2(F.to_json(F.struct(*[c.alias(k) for k, c in parts.items()]), {"ignoreNullFields": "false"}), 256)


def masked(secret: Column, shown: int = 4) -> Column:
    """All but the last characters as dots."""
    n = F.char_length(secret)
    return F.when(n <= shown, F.repeat(F.lit("•"), n)).otherwise(F.concat(F.repeat(F.lit("•"), n - shown), F.right(secret, F.lit(shown))))


def token_prefix(token: Column) -> Column:
    return F.substring(token, 1, 8)


def relative_time(seconds: Column) -> Column:
    """Age in the largest unit that it fills."""
    said = lambda unit, sign: F.concat(F.floor(seconds / unit + 0.5).cast("string"), F.lit(sign + " ago"))
    return F.when(seconds < 60, said(1, "s")).when(seconds < 3600, said(60, "m")).when(seconds < 86400, said(3600, "h")).otherwise(said(86400, "d"))


def humanised(kind: Column) -> Column:
    """RAGE_CLICK as Rage click."""
    words = F.lower(F.replace(kind, F.lit("_"), F.lit(" ")))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 1 << 20))


def form_factor(width: Column) -> Column:
    return F.when(width <= 640, "mobile").when(width <= 1024, "tablet").when(width.isNotNull(), "desktop")


def inferred_role(css: Column, label: Column, has_popup: Column) -> Column:
    """What an element is for, from its class and text; the first that holds."""
    css, label = F.lower(F.coalesce(css, F.lit(""))), F.lower(F.coalesce(label, F.lit("")))
    dismiss = css.contains("dismiss") | css.contains("close") | label.rlike("[×✕]")
    retry = css.contains("retry") | label.contains("retry") | label.contains("try again")
    helps = label.startswith("help") | label.contains("support") | label.contains("contact") | css.contains("help")
    return F.when(dismiss, "dismiss").when(retry, "retry").when(helps, "help").when(css.contains("menu") | F.coalesce(has_popup, F.lit(False)), "menu")


def number(n: Column) -> Column:
    """A whole number with its thousands apart."""
    return F.format_number(n, 0)


def percent(share: Column, digits: int = 1) -> Column:
    """A share as a percentage."""
    return F.concat(F.format_string(f"%.{digits}f", share.cast("double") * 100), F.lit("%"))


def is_element_id(text: Column) -> Column:
    return text.rlike("^sh_[0-9a-f]{32}$")
