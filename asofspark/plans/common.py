"""Small helpers of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, digits: int = 6, growth: tuple[str, ...] = ()) -> DataFrame:
    """Doubles at ``digits`` places (and no negative zero), as hashes of results aren't tolerant; those of ``growth`` at six significant digits."""
    shown = lambda c: F.format_string("%.5e", c).try_cast("double")
    return df.select(*[shown(c).alias(c) if c in growth else (F.round(c, digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def significant_sql(x: str) -> str:
    return f"CAST(printf('%.5e', {x}) AS DOUBLE)"


def rounded_sql(names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) + 0.0 AS {n}" for n in names.split())
