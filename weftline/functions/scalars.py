"""Scalar functions: time, decay, bins, pair counts, number format."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.config import SIZE_BINS, SIZE_STEP

#: hours are counted from here, so that sums of squares keep their digits
BASE = "2024-01-01 00:00:00"


def micros_between(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later)


def hours(ts: Column) -> Column:
    return micros_between(ts, F.lit(BASE).cast("timestamp_ntz")) / F.lit(3.6e9)


def day_difference(a: Column, b: Column) -> Column:
    return micros_between(a, b) / F.lit(8.64e10)


def gaussian(x: Column, std: float = 3.0, mean: float = 0.0) -> Column:
    """Peak 1."""
    return F.exp(-((x - mean) * (x - mean)) / F.lit(2.0 * std * std))


def size_bin(n: Column) -> Column:
    out = F.lit(1.0)
    for i, bound in reversed(list(enumerate(SIZE_BINS))):
        out = F.when(n <= bound, F.lit(round(SIZE_STEP * (i + 1), 4))).otherwise(out)
    return out


def relevance_stamp(n: Column, total: Column, squares: Column, z: float = 1.282) -> Column:
    """Mean plus z population deviations of timestamps in hours, from their count, sum and sum of squares."""
    mean = total / n
    return mean + F.lit(z) * F.sqrt(F.greatest(squares / n - mean * mean, F.lit(0.0)))


def relevance_score(complete: Column, rank: Column, threshold: int = 5) -> Column:
    """What a member counts for: the cluster's size while it is small, then its rank plus the threshold."""
    return F.when(complete < threshold, complete.cast("double")).otherwise(rank + F.lit(float(threshold)))


def pairs(n: Column) -> Column:
    """n over 2, exact."""
    return (n * (n - 1) / 2).cast("long")


def logistic(margin: Column, bias: float = 0.0) -> Column:
    return 1 / (1 + F.exp(-(margin - F.lit(bias))))


def short_number(x: Column) -> Column:
    """Six decimals at most, without zeros at the end."""
    text = F.regexp_replace(F.format_string("%.6f", x), r"\.?0+$", "")
    return F.when(text == "-0", F.lit("0")).otherwise(text)


def rounded(x: Column, digits: int) -> Column:
    """As SQL on doubles rounds: scaled, halves away from zero, scaled back; small negative numbers give -0.0 (``F.round`` goes by the
    decimal digits of a number, and gives 0.0)."""
    scaled = F.abs(x) * F.lit(10.0**digits)
    near = F.rint(scaled)
    return F.signum(x) * (near + F.when(scaled - near == 0.5, F.lit(1.0)).otherwise(F.lit(0.0))) / F.lit(10.0**digits)
