"""Dates, ratings, scores and vectors."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Date formats in order of precedence, after ISO.
FORMATS = ("M/d/yyyy", "d/M/yyyy", "yyyy/M/d", "MMMM d yyyy", "MMM d yyyy")


def clip(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def parse_datetime(c: Column) -> Column:
    """ISO dates and times (a Z or offset is obeyed, none means the session's zone), then FORMATS; null if nothing fits."""
    text = F.regexp_replace(F.trim(c), ",", "")
    return F.coalesce(F.try_to_timestamp(F.trim(c)), *[F.try_to_timestamp(text, F.lit(f)) for f in FORMATS])


def invalid_datetime(c: Column) -> Column:
    """Not blank, and no date."""
    return F.coalesce(F.trim(c) != "", F.lit(False)) & parse_datetime(c).isNull()


def parse_rating(c: Column, lo: float = 1.0, hi: float = 5.0) -> Column:
    value = F.trim(c.cast("string")).try_cast("double")
    return F.when(value.between(lo, hi), value)


def invalid_rating(c: Column, lo: float = 1.0, hi: float = 5.0) -> Column:
    return F.coalesce(F.trim(c.cast("string")) != "", F.lit(False)) & parse_rating(c, lo, hi).isNull()


def whole_days(later: Column, earlier: Column) -> Column:
    return F.floor((F.unix_timestamp(later) - F.unix_timestamp(earlier)) / 86400)


def recency(age_days: Column, half_life: float = 365.0) -> Column:
    return F.exp(-math.log(2) * F.greatest(age_days.cast("double"), F.lit(0.0)) / half_life)


def log_saturation(n: Column, cap: float) -> Column:
    return clip(F.log1p(n.cast("double")) / math.log1p(cap))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def opportunity(importance: Column, satisfaction: Column) -> Column:
    i, s = clip(importance, 0, 10), clip(satisfaction, 0, 10)
    return i + F.greatest(i - s, F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def normalized(v: Column) -> Column:
    """Of unit length; the zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector; vectors of different length are an error."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length"))).when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))
