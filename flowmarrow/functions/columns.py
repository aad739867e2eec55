"""Column expressions shared by the operators. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lenient_double(c: Column | str) -> Column:
    """Text or number to double; unparsable text and NaN become null."""
    return F.nanvl(col(c).try_cast("double"), F.lit(None).cast("double"))


def numeric_or_zero(c: Column | str) -> Column:
    return F.coalesce(lenient_double(c), F.lit(0.0))


def timestamp_of(c: Column | str) -> Column:
    """Epoch seconds when the value is a number, otherwise a parsed timestamp text.

    Seconds go through a decimal: a double would lose the last microsecond.
    """
    text = col(c).cast("string")
    seconds = F.timestamp_seconds(text.try_cast("decimal(20,6)"))
    return F.coalesce(seconds, text.try_cast("timestamp"))


def guarded_ratio(num: Column | str, den: Column | str) -> Column:
    """``num / den`` where ``den > 0``, else 0."""
    return F.when(col(den) > 0, col(num) / col(den)).otherwise(F.lit(0.0))


def clipped_finite(c: Column | str, bound: float = 1e9) -> Column:
    """Null, NaN and infinities become 0; everything else is clipped to ±bound."""
    v = lenient_double(c)
    finite = F.when(F.abs(v) < F.lit(float("inf")), v).otherwise(F.lit(0.0))
    return F.least(F.greatest(finite, F.lit(-bound)), F.lit(bound))


def is_truthy_label(c: Column | str) -> Column:
    """1 for the spellings of a positive label, else 0 (any case)."""
    text = F.lower(F.trim(col(c).cast("string")))
    return F.coalesce(text.isin("1", "anomaly", "attack"), F.lit(False)).cast("int")


def has_syn(flags: Column | str) -> Column:
    return F.coalesce(col(flags).bitwiseAND(2) != 0, F.lit(False))


def non_negative_seconds(start: Column | str, end: Column | str) -> Column:
    return F.greatest(seconds_between(start, end), F.lit(0.0))


def micros(ts: Column | str) -> Column:
    return F.unix_micros(col(ts).cast("timestamp"))


def seconds_between(start: Column | str, end: Column | str) -> Column:
    return (micros(end) - micros(start)) / F.lit(1e6)


def score_band(score: Column | str) -> Column:
    s = col(score)
    return F.when(s < 0.3, "normal").when(s < 0.7, "suspicious").otherwise("anomalous")


def f1_band(f1: Column | str) -> Column:
    v = col(f1)
    return F.when(v > 0.95, "excellent").when(v > 0.85, "good").otherwise("needs_improvement")


def verdict(prediction: Column | str) -> Column:
    return F.when(col(prediction) == 1, "ANOMALY").otherwise("NORMAL")


def flag(condition: Column) -> Column:
    """A condition as 0/1, with null as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def safe_div(num: Column, den: Column) -> Column:
    """``num / den`` with 0 on an empty denominator."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


def severity(ratio: Column | str) -> Column:
    """Band of error / threshold: lower bounds 1, 1.5, 3 and 5."""
    r = col(ratio)
    return (
        F.when(r >= 5, "CRITICAL")
        .when(r >= 3, "HIGH")
        .when(r >= 1.5, "MEDIUM")
        .when(r >= 1, "LOW")
        .otherwise("UNKNOWN")
    )


def name_matches(name: Column | str, text: str, negate: bool = False) -> Column:
    """Whether a name contains a text in any letter case, or does not; null names do not match."""
    hit = F.coalesce(F.lower(name).contains(text.lower()), F.lit(False))
    return ~hit if negate else hit


def at_threshold(score: Column | str, threshold: float) -> Column:
    """1 from the threshold on, else 0; rows without a score are 0."""
    return F.coalesce((F.col(score) if isinstance(score, str) else score) >= threshold, F.lit(False)).cast("int")
