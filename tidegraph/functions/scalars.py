"""Scalar expressions: fees, units, week labels, moments, Student's t."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

WEI = 1e18
#: Decimals of tokens that differ from 18.
TOKEN_DECIMALS = {
    "0xdac17f958d2ee523a2206206994597c13d831ec7": 6,
    "0xa0b86991c6218b36c1d19d4a2e9eb0ce3606eb48": 6,
    "0x2260fac5e5542a773aa44fbcfedf7c193bc2c599": 8,
}
#: Addresses of well-known tokens.
TOKENS = {
    "USDT": "0xdac17f958d2ee523a2206206994597c13d831ec7",
    "USDC": "0xa0b86991c6218b36c1d19d4a2e9eb0ce3606eb48",
    "LINK": "0x514910771af9ca656af840dff83e8264ecf986ca",
    "UNI": "0x1f9840a85d5af5bf1d1762f925bdaddc4201f984",
    "WBTC": "0x2260fac5e5542a773aa44fbcfedf7c193bc2c599",
    "DAI": "0x6b175474e89094c44da98b954eedeac495271d0f",
}


def fee(gas_used: Column, kind: Column, max_fee: Column, priority: Column, base_fee: Column, gas_price: Column) -> Column:
    """Paid fee: capped base plus priority for the dynamic kind, the gas price otherwise."""
    dynamic = F.least(max_fee, F.coalesce(base_fee, F.lit(0.0)) + priority)
    return gas_used * F.when(kind == 2, dynamic).otherwise(gas_price)


def decimals(token: Column, known: dict[str, int] | None = None, default: int = 18) -> Column:
    known = TOKEN_DECIMALS if known is None else known
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    return F.coalesce(table[F.lower(token)], F.lit(default))


def scaled(amount: Column, digits: Column) -> Column:
    return amount.cast("double") / F.pow(F.lit(10.0), digits)


def week_of_month(date: Column) -> Column:
    return F.concat(F.date_format(date, "yyyy-MM"), F.lit("_W"), (F.floor((F.dayofmonth(date) - 1) / 7) + 1).cast("string"))


def week_range(label: Column) -> tuple[Column, Column]:
    """First and last day of a ``YYYY-MM_Wn`` label; the fifth week ends with its month."""
    month = F.to_date(F.concat(F.substring(label, 1, 7), F.lit("-01")))
    start = F.date_add(month, (F.substring(label, 10, 1).cast("int") - 1) * 7)
    return start, F.least(F.date_add(start, 6), F.last_day(month))


def iso_week(date: Column) -> tuple[Column, Column]:
    return F.expr("extract(YEAROFWEEK FROM d)").alias("iso_year"), F.weekofyear(date)


def adjusted_skewness(x: Column) -> Column:
    n = F.count(x)
    return F.when((n > 2) & (F.stddev_pop(x) > 0), F.skewness(x) * F.sqrt(n * (n - 1.0)) / (n - 2.0))


def adjusted_kurtosis(x: Column) -> Column:
    n = F.count(x)
    return F.when((n > 3) & (F.stddev_pop(x) > 0), ((n + 1.0) * F.kurtosis(x) + 6.0) * (n - 1.0) / ((n - 2.0) * (n - 3.0)))


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson correlation of the rows where both are present; NULL where either side is constant."""
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    covariance = F.avg(x * y) - F.avg(x) * F.avg(y)
    return F.when((F.stddev_pop(x) > 1e-12) & (F.stddev_pop(y) > 1e-12), covariance / (F.stddev_pop(x) * F.stddev_pop(y)))


def t_quantile(p: float, df: float) -> float:
    """Inverse of Student's t distribution, by bisection on the regularised incomplete beta function."""
    if p == 0.5:
        return 0.0
    if p < 0.5:
        return -t_quantile(1 - p, df)
    low, high = 0.0, 1.0
    while 1 - t_tail(high, df) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if 1 - t_tail(mid, df) < p:
            low = mid
        else:
            high = mid
        if high - low <= 1e-13 * max(1.0, high):
            break
    return (low + high) / 2


def t_tail(t: float, df: float) -> float:
    """P(T > t) for t >= 0."""
    return 0.5 * incomplete_beta(df / (df + t * t), df / 2, 0.5)


def incomplete_beta(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            numerator = 1.0
        elif i % 2 == 0:
            numerator = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            numerator = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + numerator * d if abs(1 + numerator * d) > 1e-300 else 1e-300)
        c = 1 + numerator / c if abs(1 + numerator / c) > 1e-300 else 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-16:
            break
    return front * (f - 1)
