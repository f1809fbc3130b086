"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(c: Column) -> Column:
    """Missing values are NULL everywhere; a NaN would poison sums."""
    return F.when(~F.isnan(c), c)


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate: mean over present values; a missing one leaves numerator and denominator; NULL without weight."""
    return F.try_divide(F.sum(value * weight), F.sum(F.when(value.isNotNull(), weight)))


def weighted_mean_all(value: Column, weight: Column) -> Column:
    """Aggregate, older definition: the denominator keeps the weight of missing values."""
    return F.try_divide(F.sum(value * weight), F.sum(weight))


def month_days(ts: Column) -> Column:
    return F.day(F.last_day(ts)).cast("double")


def lat_band(lat: Column, width: float = 10.0) -> Column:
    """0-based half-open band [lo, hi); the pole at +90 is in none."""
    n = round(180 / width)
    band = F.floor((lat + 90.0) / width).cast("int")
    return F.when((band >= 0) & (band < n), band)


def band_centre(band: Column, width: float = 10.0) -> Column:
    return band * width - 90.0 + width / 2


def member_index(name: Column) -> Column:
    """'001.x' and '1' are 0, '….m042' and 'm042' are 42; NULL for names that are no member."""
    leading, tagged = F.regexp_extract(name, r"^(\d+)(?:\.|$)", 1), F.regexp_extract(name, r"(?:^|\.)m(\d+)$", 1)
    return F.when(leading != "", leading.cast("long") - 1).when(tagged != "", tagged.cast("long"))


def draw(key: Column, k: Column | int, seed: int) -> Column:
    """Uniform in [0, 1): the first 32 bits of md5('key:k:seed'); the same in every engine."""
    k = F.lit(k) if isinstance(k, int) else k
    text = F.concat_ws(":", key.cast("string"), k.cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def rescale(x: Column, lo: Column, hi: Column) -> Column:
    """(x - lo) / span, with a span of 1 where the range is degenerate."""
    return (x - lo) / F.when(hi > lo, hi - lo).otherwise(1.0)


def tidy(c: Column, digits: int = 6) -> Column:
    """Rounded for reports, without a negative zero."""
    return F.round(c, digits) + 0.0
