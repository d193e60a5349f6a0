"""Numeric tokens as Column expressions. A missing value is never zero, and each way to be missing keeps its name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.functions.fixed_values import CURRENCIES, DASHES, NOT_AVAILABLE, NOT_MEANINGFUL
from ledgerflow.functions.text import normalize

#: A value in a line of text.
VALUE = r"(?:[$€£¥]\s*)?(?:\(\s*[-+]?\d[\d,]*(?:\.\d+)?\s*\)|[-+]?\d[\d,]*(?:\.\d+)?%?|[-+]?\d[\d,]*(?:\.\d+)?x|N/?A|N\.A\.?|NM|N\.M\.?|-|–|—|−)"
#: A cell that is one number and nothing else.
SINGLE = r"^\s*(?:[$€£¥]\s*)?(?:\(\s*(?:[$€£¥]\s*)?[+-]?\d[\d,]*(?:\.\d+)?(?:%|[xX])?\s*\)|[+-]?\d[\d,]*(?:\.\d+)?(?:%|[xX])?)\s*$"
_FLOAT = r"^[+-]?(?:(?:\d+(?:_\d+)*)(?:\.(?:\d+(?:_\d+)*)?)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?$"
_WORDS = r"(?i)^[+-]?(?:inf|infinity|nan)$"


def parse(raw: Column) -> Column:
    """struct(raw, normalized, value, status, currency, is_percent, is_ratio, precision).

    status: NUMERIC, BLANK, DASH, NA, NM or PARSE_ERROR; value only if NUMERIC. Parentheses make a number negative, % divides by 100, a leading S before a
    digit is a misread dollar sign that names no currency. Null counts as blank.
    """
    text = normalize(raw)
    body = F.trim(F.regexp_replace(text, rf"^(?:[{CURRENCIES}]|S(?=[ 0-9]))\s*", ""))
    inner = F.trim(F.regexp_replace(body, r"(?s)^\((.*)\)$", "$1"))
    bare = F.trim(F.regexp_replace(inner, rf"^[{CURRENCIES}]\s*", ""))
    return _token(raw, text, body, inner, bare, F.translate(F.trim(F.regexp_replace(bare, r"[%xX]$", "")), "−, ", "-"))


def _token(raw: Column, text: Column, body: Column, inner: Column, bare: Column, digits: Column) -> Column:
    low = F.lower(text)
    first = F.regexp_extract(text, rf"^([{CURRENCIES}])", 1)
    wrapped = body.rlike(r"(?s)^\(.*\)$")
    second = F.regexp_extract(inner, rf"^([{CURRENCIES}])", 1)
    percent, ratio = bare.endswith("%"), F.lower(bare).endswith("x")
    currency = F.when(first != "", first).otherwise(second)
    number = F.when(digits.rlike(_FLOAT), F.regexp_replace(digits, "_", "").try_cast("double")).when(digits.rlike(_WORDS), F.regexp_replace(F.lower(digits), "^([+-]?)inf$", "$1infinity").try_cast("double"))
    number = F.when(wrapped, -F.abs(number)).otherwise(number)
    early = F.when(text == "", "BLANK").when(low.isin(*DASHES), "DASH").when(low.isin(*NOT_AVAILABLE), "NA").when(low.isin(*NOT_MEANINGFUL), "NM")
    status = F.coalesce(early, F.when(digits.isin(*DASHES), "DASH").when(number.isNotNull(), "NUMERIC").otherwise("PARSE_ERROR"))
    numeric = status == "NUMERIC"
    late = early.isNull()
    return F.struct(
        F.coalesce(raw.cast("string"), F.lit("")).alias("raw"),
        text.alias("normalized"),
        F.when(numeric, F.when(percent, number / 100.0).otherwise(number)).alias("value"),
        status.alias("status"),
        F.when(late, currency).otherwise("").alias("currency"),
        (late & percent).alias("is_percent"),
        (late & ratio).alias("is_ratio"),
        F.when(numeric, F.length(F.regexp_extract(digits, r"\.(\d+)", 1))).alias("precision"),
    )


def with_token(rows: DataFrame, raw: str, name: str = "token") -> DataFrame:
    """rows with parse() of a column as a struct. The steps are projections of their own, so that each text is worked on once and the generated code stays small."""
    text = rows.withColumn("_t", normalize(F.col(raw))).withColumn("_body", F.trim(F.regexp_replace("_t", rf"^(?:[{CURRENCIES}]|S(?=[ 0-9]))\s*", "")))
    inner = text.withColumn("_inner", F.trim(F.regexp_replace("_body", r"(?s)^\((.*)\)$", "$1"))).withColumn("_bare", F.trim(F.regexp_replace("_inner", rf"^[{CURRENCIES}]\s*", "")))
    digits = inner.withColumn("_digits", F.translate(F.trim(F.regexp_replace("_bare", r"[%xX]$", "")), "−, ", "-"))
    return digits.withColumn(name, _token(F.col(raw), *[F.col(c) for c in ("_t", "_body", "_inner", "_bare", "_digits")])).drop("_t", "_body", "_inner", "_bare", "_digits")


def strict_number(cell: Column, movement: bool = False) -> Column:
    """The value of a cell that is one finite number, else null; in movements a dash counts as 0."""
    token = parse(cell)
    value = F.when(cell.rlike(SINGLE) & ~F.isnan(token["value"]) & (F.abs(token["value"]) != float("inf")), token["value"])
    return F.when(token["status"] == "DASH", 0.0).otherwise(value) if movement else value


def decimal_amount(cell: Column) -> Column:
    """The exact amount of a cell that is one number, as decimal(38,9), without a detour over floating point; else null. Parentheses are a minus."""
    plain = F.translate(normalize(cell), "$€£¥, ", "")
    minus = plain.rlike(r"^\(.*\)$")
    digits = F.regexp_extract(F.translate(F.regexp_replace(plain, r"^\((.*)\)$", "$1"), "−", "-"), r"^([-+]?\d+(?:\.\d+)?)$", 1).try_cast("decimal(38,9)")
    return F.when(minus, -digits).otherwise(digits).cast("decimal(38,9)")


def display_precision(value: Column) -> Column:
    """Digits after the point that a number needs, 0 to 6."""
    return F.least(F.lit(6), F.length(F.regexp_extract(F.regexp_replace(F.abs(value).cast("decimal(38,9)").cast("string"), r"0+$", ""), r"\.(\d+)$", 1)))
