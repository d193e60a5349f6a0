"""Unit notes: the scale that a statement's amounts are stated in. It is metadata; amounts are never rescaled by it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerflow.functions.fixed_values import SCALES
from ledgerflow.functions.text import normalize

_PATTERNS = {"thousands": r"\bthousands\b|\$000\b|\b000['’�]?s\b", "millions": r"\bmillions\b|\$mm\b", "billions": r"\bbillions\b|\$bn\b"}
_NOTE = r"in thousands|in millions|in billions|\$000|\$mm|\$bn|\b000['’�]?s\b"
_SHARES = r"\b(?:number of shares|share counts|shares outstanding|shares)(?:\s*,?\s*(?:which are|are)?\s*(?:reflected|reported|expressed))?\s+in\s+(thousands|millions|billions)\b"


def factor(label: Column) -> Column:
    out = F.lit(1).cast("long")
    for name, n in SCALES.items():
        out = F.when(label == name, F.lit(n).cast("long")).otherwise(out)
    return out


def classify(note: Column) -> Column:
    """struct(unit_label, scale_factor, currency, unit_exceptions, share_unit_label, share_scale_factor).

    What stands after the word except is an exception and doesn't set the scale; two scales at once set none.
    """
    low = F.lower(normalize(note))
    money = F.regexp_replace(low, r"(?s)\bexcept\b.*$", "")
    has_exception = low.rlike(r"\bexcept\b")
    exception = F.regexp_replace(low, r"(?s)^.*?\bexcept\b", "")
    hits = {name: money.rlike(p) for name, p in _PATTERNS.items()}
    n = sum((h.cast("int") for h in hits.values()), F.lit(0))
    label = F.lit("reported units")
    for name, hit in hits.items():
        label = F.when((n == 1) & hit, name).otherwise(label)
    raw = F.coalesce(note, F.lit(""))
    currency = F.when(low.contains("usd") | raw.contains("$"), "USD").when(low.contains("eur") | raw.contains("€"), "EUR").when(low.contains("gbp") | raw.contains("£"), "GBP").otherwise("")
    share = F.nullif(F.regexp_extract(F.when(has_exception, exception).otherwise(""), _SHARES, 1), F.lit(""))
    return F.struct(
        label.alias("unit_label"),
        factor(label).alias("scale_factor"),
        currency.alias("currency"),
        F.when(has_exception, F.regexp_replace(F.trim(exception), r"\)+$", "")).alias("unit_exceptions"),
        share.alias("share_unit_label"),
        F.when(share.isNotNull(), factor(share)).alias("share_scale_factor"),
    )


def note_in(line: Column) -> Column:
    """The unit note that a line states, else null: the parenthesis that holds it, or the whole line."""
    text = normalize(line)
    low = F.lower(text)
    states = low.rlike(_NOTE) | low.rlike(r"^\(\s*(?:thousands|millions|billions)\s*\)$")
    inside = F.regexp_extract(text, rf"(?i)(\([^)]*(?:{_NOTE})[^)]*\))", 1)
    return F.when(states, F.when(inside != "", inside).otherwise(text))
