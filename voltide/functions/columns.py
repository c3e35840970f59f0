"""Column functions: time buckets, guarded logarithms and ratios, the normal distribution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR_SECONDS = 365 * 24 * 3600


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def time_bucket(ts: Column | str, seconds: int) -> Column:
    """The start of the bucket of `seconds`, counted from the epoch, that a timestamp is in."""
    return F.timestamp_seconds(F.floor(F.unix_seconds(col(ts)) / seconds) * seconds)


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is 0."""
    b = col(b)
    return col(a) / F.when(b != 0, b)


def log_ratio(a: Column | str, b: Column | str) -> Column:
    """ln(a / b), null unless the ratio is above 0."""
    r = ratio(a, b)
    return F.when(r > 0, F.log(r))


def exact_mean(price: Column | str) -> Column:
    """Aggregate: the mean to six decimals, halves away from 0, the same in whatever order rows come; null over prices that
    aren't all finite.

    Prices count to nine decimals and are summed as whole numbers; a sum of doubles would leave ties to the order of rows.
    """
    price = col(price)
    whole = F.floor(price)
    billionths = whole.cast("decimal(20,0)") * 1_000_000_000 + F.round((price - whole) * 1e9).try_cast("decimal(10,0)")
    total, n = F.sum(billionths), F.count(price).cast("decimal(20,0)")
    millionths = F.signum(total).cast("long") * F.call_function("div", F.abs(total) * 2 + n * 1000, F.nullif(n * 2000, F.lit(0)))
    return F.when(F.count(billionths) == F.count(price), (millionths.cast("decimal(20,0)") * F.lit("0.000001").cast("decimal(7,6)")).cast("decimal(18,6)"))


# The rational approximation 7.1.26 of erf by Abramowitz and Stegun.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_cdf(x: Column | str) -> Column:
    """The standard normal distribution function, to 1e-7."""
    x = col(x)
    z = F.abs(x) / (2**0.5)
    t = 1 / (1 + ERF_P * z)
    series = F.lit(0.0)
    for a in reversed(ERF_A):
        series = (series + a) * t
    half = 0.5 * series * F.exp(-z * z)
    return F.when(x >= 0, 1 - half).otherwise(half)
