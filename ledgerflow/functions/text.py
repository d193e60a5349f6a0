"""Texts and labels as Column expressions. Java's classes are ASCII unless (?U) stands before them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Python's and Unicode's white space together.
_SPACE = r"(?U)[\s\x1c-\x1f]+"
# Names of months, dates and years.
MONTH = r"(?:January|February|March|April|May|June|July|August|September|October|November|December|Jan\.?|Feb\.?|Mar\.?|Apr\.?|Jun\.?|Jul\.?|Aug\.?|Sep\.?|Sept\.?|Oct\.?|Nov\.?|Dec\.?)"
DATE = rf"(?i)\b{MONTH}\s+\d{{1,2}},?\s+(?:19|20)\d{{2}}\b"
YEAR = r"\b(?:19|20)\d{2}\b"
#: A number in running text, without sign: what coverage counts.
NUMBER = r"(?<!\w)\d[\d,]*(?:\.\d+)?"


def normalize(text: Column) -> Column:
    """White space of all kinds becomes single blanks, none at the ends; null becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), _SPACE, " "))


def straight_quotes(text: Column) -> Column:
    return F.translate(text, "’", "'")


def concept_label(text: Column) -> Column:
    """What row labels and aliases are compared by."""
    return F.trim(F.regexp_replace(F.regexp_replace(straight_quotes(F.lower(normalize(text))), r"[^a-z0-9%/()'& -]+", " "), r"\s+", " "))


def title_label(text: Column) -> Column:
    """What statement titles are compared by: without condensed, combined, consolidated, and punctuation."""
    plain = straight_quotes(F.lower(normalize(text)))
    plain = F.regexp_replace(F.regexp_replace(plain, r"\b(?:condensed\s+)?consolidated\s+", ""), r"\b(?:condensed|combined)\s+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^a-z0-9' ]+", " "), r"\s+", " "))


def fingerprint(line: Column) -> Column:
    """Row identity across renderings: only letters, digits and hyphens count. Parentheses go too, so a loss equals a gain of that size."""
    return F.regexp_replace(F.translate(F.lower(F.coalesce(line, F.lit(""))), "—,", "-"), r"[^a-z0-9-]", "")


def label_key(text: Column) -> Column:
    """A grid label without note references, in lower case."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)\(\s*(?:Note\s+)?\d+\s*\)", "")
    return F.lower(F.trim(F.regexp_replace(bare, _SPACE, " ")))


def split_note(label: Column) -> Column:
    """struct(label, note): a last number of one to three digits in parentheses is a note reference."""
    bare = F.trim(label)
    note = F.regexp_extract(bare, r"^.*?\s+\((\d{1,3})\)$", 1)
    return F.struct(F.when(note != "", F.trim(F.regexp_replace(bare, r"\s+\(\d{1,3}\)$", ""))).otherwise(bare).alias("label"), note.alias("note"))


def safe_name(text: Column) -> Column:
    """A part of a path: no characters that file systems refuse, no blanks."""
    bare = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"[<>:\"/\\|?*]+", "_")
    return F.regexp_replace(F.regexp_replace(bare, r"\s+", "_"), r"^[_ .]+|[_ .]+$", "")


def numbers_in(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({NUMBER})"), 1)


def years_in(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({YEAR})"), 1)


# How labels of totals begin.
TOTAL_LABELS = r"^(?:total |net cash |net income|operating income|income before |net increase |net decrease )"


def is_total_label(label: Column) -> Column:
    """Rows that sheets set apart as totals."""
    return F.lower(F.trim(label)).rlike(TOTAL_LABELS)


def is_grand_total_label(label: Column) -> Column:
    low = F.lower(F.trim(label))
    return low.isin("net income", "total assets") | low.startswith("total liabilities and ") | low.endswith("cash, cash equivalents and restricted cash, end of year")
