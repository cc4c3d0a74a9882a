"""Numeric expressions that stay null-safe under ANSI mode."""

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .text import quoted

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NUMERIC_TYPES)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and null are one kind of missing value here."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not floats:
        return df
    return df.select(*[
        F.when(~F.isnan(quoted(c)), quoted(c)).alias(c) if c in floats else quoted(c) for c in df.columns
    ])


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def pct(a: Column, b: Column, digits: int = 2) -> Column:
    """a / b in percent, 0 when b is 0."""
    return F.coalesce(F.round(ratio(a, b) * 100, digits), F.lit(0.0))


def sample_skewness(n: Column, g1: Column) -> Column:
    """Bias-corrected skewness from the population form."""
    n = n.cast("double")
    return F.when(n >= 3, F.try_divide(F.sqrt(n * (n - 1)) * g1, n - 2))


def sample_kurtosis(n: Column, g2: Column) -> Column:
    """Bias-corrected excess kurtosis from the population form."""
    n = n.cast("double")
    return F.when(n >= 4, F.try_divide((n - 1) * ((n + 1) * g2 + 6), (n - 2) * (n - 3)))


def skewness_agg(c: Column) -> Column:
    return F.coalesce(sample_skewness(F.count(c), F.skewness(c)), F.when(F.count(c) >= 3, F.lit(0.0)))


def kurtosis_agg(c: Column) -> Column:
    return F.coalesce(sample_kurtosis(F.count(c), F.kurtosis(c)), F.when(F.count(c) >= 4, F.lit(0.0)))


def pearson_agg(x: Column, y: Column, x_nulls: bool = True, y_nulls: bool = True) -> Column:
    """Pairwise-complete Pearson r as one aggregate; null for a constant side. A side without nulls takes none of the other's rows away, so the other's deviation is the
    same in all pairs with such sides and is aggregated once."""
    sx = F.stddev_samp(F.when(x.isNotNull() & y.isNotNull(), x) if y_nulls else x)
    sy = F.stddev_samp(F.when(x.isNotNull() & y.isNotNull(), y) if x_nulls else y)
    return F.try_divide(F.covar_samp(x, y), sx * sy)


def whole_word(name: str, words) -> bool:
    """Whole-word match in a column name where an underscore counts as a letter."""
    import re
    return any(re.search(rf"\b{re.escape(w)}\b", name.lower()) for w in words)
