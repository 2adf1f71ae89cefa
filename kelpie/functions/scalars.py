"""Scalar expressions: dates, decay kernels, guards, hashes."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Event weights of the activity model, and cost multipliers by class.
WEIGHTS = {"hit": 2.0, "confirm": 1.5, "create": 1.0, "display": 0.0, "retrieve": 0.0, "promote": 0.0, "demote": 0.0, "mention_observed": 0.0}
COST_MULTIPLIER = {"low": 1.0, "med": 1.25, "high": 1.5}
KERNELS = ("legacy", "exponential", "mixture", "power", "bounded_power")


def case_of(col: Column, table: dict, default=None) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), col), F.lit(default))


def day(text: Column) -> Column:
    """A strict ``YYYY-MM-DD`` day; anything else is an error."""
    return F.when(F.assert_true(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).isNotNull(), F.lit("dates must use YYYY-MM-DD")).isNull(), F.to_date(text))


def days_since(now: Column, then: Column) -> Column:
    return F.datediff(now, then)


def epoch(value: Column) -> Column:
    """UTC time of an epoch number or an ISO text with an offset; null for a naive or broken text."""
    number = F.timestamp_seconds(F.expr("0D") + F.when(value.rlike(r"^-?\d+(\.\d+)?$"), value).cast("double"))
    iso = F.when(value.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(value))
    return F.coalesce(number, iso)


def decay(age: Column, kernel: str, half_life: float = 30.0, exponent: float = 0.5, window_days: int = 180) -> Column:
    """Weight of an event ``age`` days ago."""
    age = age.cast("double")
    if kernel == "legacy":
        return F.pow(age + 1, F.lit(-0.5))
    if kernel == "exponential":
        return F.pow(F.lit(2.0), -age / half_life)
    if kernel == "mixture":
        return 0.7 * F.pow(F.lit(2.0), -age / half_life) + 0.3 * F.pow(F.lit(2.0), -age / (half_life * 4))
    tau = half_life / (2 ** (1 / exponent) - 1)
    power = F.pow(1 + age / tau, F.lit(-exponent))
    if kernel == "power":
        return power
    if kernel == "bounded_power":
        return F.when(age > window_days, 0.0).otherwise(power)
    raise ValueError(f"unknown kernel {kernel}")


def sanitised(text: Column, n: int) -> Column:
    """One line without pipes, at most ``n`` characters."""
    return F.left(F.trim(F.regexp_replace(F.replace(text, F.lit("|"), F.lit("/")), r"(?U)\s+", " ")), F.lit(n))


def safe_locator(locator: Column) -> Column:
    """A relative path with forward slashes, without parent steps, home, drive or NUL; null otherwise."""
    text = F.replace(F.regexp_replace(locator, r"^\s+|\s+$", ""), F.lit("\\"), F.lit("/"))
    bad = text.rlike(r"^(/|~|[A-Za-z]:/|$)") | text.rlike(r"(^|/)\.\.(/|$)") | text.rlike(r"\x00")
    return F.when(~bad, text)


def entry_locator(locator: Column, store: Column) -> Column:
    """An entry's own locator if it is safe; where it has none, its store, unless that is one of the two always resident files."""
    return F.when(locator.isNotNull(), safe_locator(locator)).when(~store.isin("MEMORY.md", "USER.md"), safe_locator(store))


def entry_scope(*names: Column) -> Column:
    """The first of scope, project and profile that says anything, as a field of 80 characters."""
    return F.coalesce(*(F.when(F.trim(n) != "", sanitised(n, 80)) for n in names), F.lit("profile-local"))


def locator_topic(locator: Column) -> Column:
    """The stem of a path as words, at most 80 characters."""
    stem = F.regexp_replace(F.regexp_extract(locator, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return F.left(F.trim(F.regexp_replace(stem, "[_-]+", " ")), F.lit(80))


def source_hash(store: Column, text: Column) -> Column:
    return F.sha2(F.concat(store, F.lit("\0"), text), 256)


def scale_bucket(footprint: Column, budget: Column) -> Column:
    return F.floor(F.log2(footprint / budget)).cast("long")


def numeric_guard(dimension: int) -> float:
    """Bound on the difference of two single-precision dot products."""
    k, u = 2 * dimension + 1, 2.0**-24
    return 2 * k * u / (1 - k * u)


def input_cost(tokens: Column, rate_per_million: Column) -> Column:
    return tokens / F.lit(1e6) * rate_per_million


def canonical_sha_udf(style: str):
    """SHA-256 of a JSON text in canonical form: ``spaced`` and ``compact`` keep Unicode, ``ascii`` is compact and escaped."""
    options = {
        "spaced": {"ensure_ascii": False},
        "compact": {"ensure_ascii": False, "separators": (",", ":")},
        "ascii": {"ensure_ascii": True, "separators": (",", ":")},
    }[style]

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hashlib.sha256(json.dumps(json.loads(t), sort_keys=True, allow_nan=False, **options).encode()).hexdigest(), na_action="ignore")

    return run


def percentile_linear(col: str, q: float) -> Column:
    return F.percentile(col, F.lit(q))


def percentile_nearest(values: Column, q: float) -> Column:
    """The value at rank ceil(q * n) of an array."""
    v = F.array_sort(values)
    return F.element_at(v, F.greatest(F.ceil(F.lit(q) * F.size(v)).cast("int"), F.lit(1)))


def percentile_floor(values: Column, q: float) -> Column:
    """The value at index int(q * (n - 1)) of an array."""
    v = F.array_sort(values)
    return F.element_at(v, F.floor(F.lit(q) * (F.size(v) - 1)).cast("int") + 1)
