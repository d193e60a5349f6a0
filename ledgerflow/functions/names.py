"""Names of filings and outputs, from their metadata."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Forms by the first pattern that a text has.
_FORMS = tuple((name, rf"(?i)(?<![A-Z0-9]){form}(?![A-Z0-9])") for name, form in (("10K-A", "10-?K/A"), ("10Q-A", "10-?Q/A"), ("10K", "10-?K"), ("10Q", "10-?Q")))
#: Latin letters with marks and what they are without, by Unicode's decomposition.
_MARKED = [(chr(c), plain) for c in range(0xC0, 0x250) if len(plain := unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode()) == 1]
_YEAR = r"(?<!\d)((?:19|20|21)\d{2})(?!\d)"


def form_type(text: Column) -> Column:
    out = F.lit("")
    for name, pattern in reversed(_FORMS):
        out = F.when(F.coalesce(text, F.lit("")).rlike(pattern), name).otherwise(out)
    return out


def component(text: Column) -> Column:
    """A part of a file name: ASCII letters and digits, everything else one underscore."""
    plain = F.translate(F.coalesce(text, F.lit("")), "".join(a for a, _ in _MARKED), "".join(b for _, b in _MARKED))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"[^\x00-\x7F]", ""), r"[^A-Za-z0-9]+", "_"), r"^_+|_+$", "")


def year_token(text: Column) -> Column:
    """FY26 of 2026, FY 26 or '26; else ''."""
    whole = F.regexp_extract(F.coalesce(text, F.lit("")), _YEAR, 1)
    short = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)^\s*(?:FY\s*)?'?(\d{2})\s*$", 1)
    return F.when(whole != "", F.concat(F.lit("FY"), F.substring(whole, 3, 2))).when(short != "", F.concat(F.lit("FY"), short)).otherwise("")


def fiscal_year(labels: Column) -> Column:
    """The token of the latest year that period labels name; '' where none does."""
    years = F.flatten(F.transform(labels, lambda x: F.regexp_extract_all(x, F.lit(_YEAR), 1)))
    return year_token(F.array_max(years))


def period_token(period: Column, stem: Column, form: Column) -> Column:
    """Q1 to Q4, SemiAnnual or Monthly; annual forms have none; quarterly ones take it from the file's name if need be."""
    own = F.upper(F.regexp_replace(F.coalesce(period, F.lit("")), "[^A-Za-z0-9]+", ""))
    given = F.when(own.rlike("^Q[1-4]$"), own).when(own.isin("SEMIANNUAL", "HALFYEAR"), "SemiAnnual").when(own == "MONTHLY", "Monthly").otherwise("")
    named = F.regexp_extract(F.upper(F.coalesce(stem, F.lit(""))), r"(?<![A-Z0-9])(Q[1-4])(?![A-Z0-9])", 1)
    return F.when(form.startswith("10K"), "").when((given == "") & form.startswith("10Q"), named).otherwise(given)


def output_name(company: Column, year: Column, period: Column, form: Column, stem: Column | None = None) -> Column:
    """FY26_Q2_10Q_Acme_Corp.xlsx, or the fullest of the simpler names whose parts are known; Extracted_Financials.xlsx from nothing."""
    stem = F.lit("") if stem is None else stem
    kind = F.coalesce(F.nullif(form_type(form), F.lit("")), form_type(stem))
    fy = F.coalesce(F.nullif(year_token(year), F.lit("")), year_token(stem))
    client, part = component(company), period_token(period, stem, kind)
    f, q, k, c = (F.nullif(x, F.lit("")) for x in (fy, part, kind, client))
    money = F.lit("Financials")
    public = kind != ""
    join = lambda *x: F.array_join(F.when(F.forall(F.array(*x), lambda v: v.isNotNull()), F.array(*x)), "_")
    full = F.when(public & ~kind.startswith("10Q"), F.lit(None).cast("string")).otherwise(join(f, q, k, c))
    names = F.coalesce(full, join(f, k, c), F.when(~public, join(f, q, c)), F.when(public, join(k, c)), join(f, c), F.when(~public, join(k, c)), join(c, money), join(f, k), join(k), join(f, money), F.lit("Extracted_Financials"))
    return F.concat(names, F.lit(".xlsx"))
