"""Column expressions: cleaning, measures, dates of publication, errors and bands.

Missing stays null: none of these turns a null into zero, and sums of parts are null if a part is.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that mean a missing value (fixed values, compared in upper case).
MISSING = ("", "-", "--", ".", "NA", "N/A", "NULL")
TIE = 1e-10


def text(c: Column) -> Column:
    return F.upper(F.trim(c))


def clean_number(c: Column) -> Column:
    """A number from text with thousands separators; missing marks and other text are null."""
    value = F.regexp_replace(F.trim(c), ",", "").try_cast("double")
    return F.when(text(c).isin(*MISSING) | F.isnan(value) | (F.abs(value) == F.lit(float("inf"))), None).otherwise(value)


def bad_number(c: Column) -> Column:
    """Text that is neither a number nor a missing mark."""
    return c.isNotNull() & ~text(c).isin(*MISSING) & clean_number(c).isNull()


def clean_count(c: Column) -> Column:
    value = clean_number(c)
    return F.when((value >= 0) & (value == F.floor(value)), value.cast("long"))


def clean_percent(value: Column) -> Column:
    """A percentage; noise of 1e-10 beyond 0 and 100 is cut off, other values outside are null."""
    return F.when((value >= -TIE) & (value <= 100 + TIE), F.least(F.lit(100.0), F.greatest(F.lit(0.0), value)))


def entity_key(code: Column, kind: Column) -> Column:
    """CODE:KIND in upper case; null unless the code has letters and digits only."""
    code, kind = text(code), text(kind)
    return F.when(code.rlike("^[A-Z0-9]+$") & kind.rlike("^[A-Z0-9]+$"), F.concat_ws(":", code, kind))


def key_code(key: Column) -> Column:
    return F.regexp_extract(key, "^([A-Z0-9]+):([A-Z0-9]+)$", 1)


def key_kind(key: Column) -> Column:
    return F.regexp_extract(key, "^([A-Z0-9]+):([A-Z0-9]+)$", 2)


def name_or_code(name: Column, code: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.concat(F.lit("Program "), code))


def positive_log(c: Column) -> Column:
    return F.when(c > 0, F.log(c))


def comparable_log(c: Column) -> Column:
    """positive_log to the last bit of the C library's logarithm, for values that are compared for equality: Spark's differs there for a tenth of the ratios."""

    def logs(values):
        return pd.Series([math.log(v) if v > 0 else None for v in values], dtype="float64")

    logs.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.when(c > 0, F.pandas_udf(logs, "double")(c))


def lacks_log(c: Column, required: Column) -> Column:
    """Whether a required logarithm doesn't exist: the value is null or not positive."""
    return required & F.coalesce(c <= 0, F.lit(True))


def log1p_nonneg(c: Column) -> Column:
    return F.when(c >= 0, F.log1p(c))


def interval_log_width(lower: Column, upper: Column) -> Column:
    return F.when((lower > 0) & (upper >= lower), F.log(upper) - F.log(lower))


def share(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def per100(count: Column, start: Column) -> Column:
    return F.try_divide(100.0 * count, start.cast("double"))


def published_successes(n: Column, percent: Column) -> Column:
    return F.floor(n * percent / 100.0 + 0.5)


def empirical_logit(n: Column, percent: Column) -> Column:
    """ln of ((s + 0.5) / (n + 1)) over its complement, s from the published percentage; null if s doesn't give that percentage back."""
    s = published_successes(n, percent)
    p = (s + 0.5) / (n + 1.0)
    return F.when((n > 0) & (F.abs(F.try_divide(100.0 * s, n) - percent) <= 0.051), F.log(p / (1.0 - p)))


def smoothed_logit(n: Column, p: Column) -> Column:
    return F.log((n * p + 0.5) / (n * (1.0 - p) + 0.5))


def expit(c: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-c))


def suppressed_number(c: Column) -> Column:
    """The number of a text; null for a suppressed one such as '>72'."""
    return F.trim(c).try_cast("double")


def error_values(target: Column, predicted: Column, target_log: Column, predicted_log: Column) -> dict[str, Column]:
    """Signed and absolute errors on three scales; null unless both values are positive. The logarithms are taken as they are: exp and log don't give them back to the last bit."""
    valid = (target > 0) & (predicted > 0)
    difference, share, log = F.when(valid, predicted - target), F.when(valid, 100.0 * (predicted / target - 1.0)), F.when(valid, predicted_log - target_log)
    return {"signed_ratio": difference, "absolute_ratio": F.abs(difference), "signed_percent": share, "absolute_percent": F.abs(share), "signed_log": log, "absolute_log": F.abs(log)}


def ratio_bucket(ratio: Column) -> Column:
    return F.when(ratio < 0.5, "<0.5").when(ratio < 1.0, "0.5-1").when(ratio < 2.0, "1-2").when(ratio.isNotNull(), ">=2")


def interval_status(lower: Column, upper: Column) -> Column:
    return F.when(lower.isNull() | upper.isNull(), "Not reported").when(upper < 1.0, "Below expected").when(lower > 1.0, "Above expected").otherwise("Includes expected")


def decimal_places(c: Column) -> Column:
    """Printed decimal places of a number, whatever its size (up to 12 places)."""
    return F.length(F.regexp_replace(F.substring_index(c.cast("decimal(36,12)").cast("string"), ".", -1), "0+$", ""))


def display_value(c: Column, digits: int) -> Column:
    return F.coalesce(F.format_number(c, digits), F.lit("Not reported"))


def printed_as_declared(printed: Column, value: Column, precision: Column) -> Column:
    """Whether a printed date is the declared month, or at most a day from the declared day."""
    close = F.abs(F.datediff(printed, value.try_cast("date"))) <= 1
    return F.when(precision == "day", close).otherwise(F.date_format(printed, "yyyy-MM") == value)


def normalize_date(c: Column, expected: Column, tolerance: int = 2) -> Column:
    """The expected date if the written one (ISO, m/d/Y or a serial day number) is at most `tolerance` days away, else null."""
    iso = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))
    written = F.when(c.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(c, "M/d/yyyy"))
    serial = F.when(c.rlike(r"^\d{4,6}$"), F.date_add(F.lit("1899-12-30").cast("date"), c.try_cast("int")))
    return F.when(F.abs(F.datediff(F.coalesce(iso, written, serial), expected)) <= tolerance, expected)


def earliest_publication(value: Column, precision: Column) -> Column:
    return F.when(precision == "day", F.to_date(value)).otherwise(F.to_date(F.concat(value, F.lit("-01"))))


def latest_publication(value: Column, precision: Column) -> Column:
    return F.when(precision == "day", F.to_date(value)).otherwise(F.last_day(F.to_date(F.concat(value, F.lit("-01")))))


def elapsed_fraction(value: Column, precision: Column, target_year: Column) -> Column:
    """Part of the target year that has passed on publication: whole months, or days including the day itself."""
    day = earliest_publication(value, precision)
    days = F.dayofyear(F.make_date(target_year, F.lit(12), F.lit(31)))
    part = F.when(precision == "day", F.dayofyear(day) / days.cast("double")).otherwise((F.month(day) - 1) / F.lit(12.0))
    return F.when(F.year(day) == target_year, part).when(F.year(day) < target_year, F.lit(0.0)).when(F.year(day) > target_year, F.lit(1.0))


def month_offset(start: Column, end: Column) -> Column:
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)


def format_publication(value: Column, precision: Column) -> Column:
    day = earliest_publication(value, precision)
    return F.when(precision == "day", F.date_format(day, "MMMM d, yyyy")).otherwise(F.date_format(day, "MMMM yyyy"))


def segments_text(segments: Column) -> Column:
    """'a to b; c to d' of an array of (start, end)."""
    return F.array_join(F.transform(segments, lambda s: F.concat(s["start"].cast("string"), F.lit(" to "), s["end"].cast("string"))), "; ")
