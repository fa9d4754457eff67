"""Shared column expressions: all native Spark SQL functions, no UDFs.

These are the few formulas where engines disagree (sample vs population
moments, correlation of a constant, NaN vs NULL); every operator builds on them
so the choice is made once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    """Numeric columns in schema order; Boolean is not numeric (it is a category)."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in exclude]


def other_columns(df: DataFrame, exclude=()) -> list[str]:
    """Everything that is not numeric: strings, booleans, dates, timestamps."""
    num = set(numeric_columns(df))
    return [f.name for f in df.schema.fields
            if f.name not in num and f.name not in exclude]


def is_float(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, FLOAT_TYPES)


def clean(df: DataFrame, name: str) -> Column:
    """Column with NaN mapped to NULL (Spark aggregates do not skip NaN)."""
    c = F.col(name)
    if is_float(df, name):
        return F.when(F.isnan(c), F.lit(None)).otherwise(c)
    return c


def is_missing(df: DataFrame, name: str) -> Column:
    c = F.col(name)
    if is_float(df, name):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def fold_hash(c) -> Column:
    """32-bit hash of a key from md5; equal to the DuckDB form
    ``cast('0x' || substr(md5(cast(x as varchar)), 1, 8) as bigint)``."""
    return F.conv(F.substring(F.md5(col(c).cast("string")), 1, 8), 16, 10).cast("bigint")


def fold_of(c, k: int) -> Column:
    return (fold_hash(c) % F.lit(k)).cast("int")


def sample_skew(x: Column) -> Column:
    """Bias-corrected skewness G1 (pandas ``skew``, DuckDB ``skewness``).

    0 for a constant column with n >= 3, NULL below n = 3.
    """
    n = F.count(x).cast("double")
    g1 = F.skewness(x)
    return (F.when(n < 3, F.lit(None).cast("double"))
            .when(F.stddev_pop(x) == 0, F.lit(0.0))
            .otherwise(g1 * F.sqrt(n * (n - 1)) / (n - 2)))


def sample_kurtosis(x: Column) -> Column:
    """Bias-corrected excess kurtosis G2 (pandas ``kurt``, DuckDB ``kurtosis``)."""
    n = F.count(x).cast("double")
    g2 = F.kurtosis(x)
    return (F.when(n < 4, F.lit(None).cast("double"))
            .when(F.stddev_pop(x) == 0, F.lit(0.0))
            .otherwise((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)))


def safe_corr(x: Column, y: Column) -> Column:
    """Pairwise-complete Pearson r; NULL (not an ANSI error) when either side
    is constant over the complete pairs."""
    xp = F.when(y.isNotNull(), x)
    yp = F.when(x.isNotNull(), y)
    denom = F.stddev_pop(xp) * F.stddev_pop(yp)
    return F.when(denom > 0, F.covar_pop(xp, yp) / denom)


def r4(c: Column) -> Column:
    return F.round(c.cast("double"), 4)


def r2(c: Column) -> Column:
    return F.round(c.cast("double"), 2)


def clip(c, lo: float, hi: float) -> Column:
    """Clip into [lo, hi]; NULL stays NULL (greatest/least skip NULLs)."""
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(c, F.lit(hi))))


def days_between(ref_date: str, ts: Column) -> Column:
    """Whole days from ts to ref_date, floored (pandas ``(ref - ts).dt.days``)."""
    ref = F.to_timestamp(F.lit(ref_date))
    return F.floor((F.unix_micros(ref) - F.unix_micros(ts.cast("timestamp")))
                   / F.lit(86400e6)).cast("bigint")
