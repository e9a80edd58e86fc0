"""Binding an expression to a name inside a larger one, so that it is evaluated once however often it is used."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def settled(df: DataFrame) -> DataFrame:
    """df with its columns computed at this point: a generator of one row, through which the optimizer does not merge projections."""
    return df.select(F.explode(F.array(F.struct("*"))).alias("_r")).select("_r.*")
