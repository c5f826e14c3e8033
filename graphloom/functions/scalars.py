"""Scalar functions over columns that Spark lacks or defines differently."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def normalised(path: Column, keep_leading: bool = False) -> Column:
    """path without empty parts, `.` and `..`. A `..` beyond the start goes, or stays with keep_leading."""

    def step(acc: Column, part: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        can = F.coalesce(last != "..", F.lit(False))
        popped = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        pushed = F.concat(acc, F.array(part))
        return F.when((part == "") | (part == "."), acc).when((part == "..") & can, popped).when((part == "..") & F.lit(not keep_leading), acc).otherwise(pushed)

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def half_up(x: Column, digits: int = 0) -> Column:
    """floor(x + 0.5) at a digit."""
    return F.floor(x * 10**digits + F.lit(0.5)) / 10**digits


@F.pandas_udf(T.DoubleType())
def to_fixed_1(values: pd.Series) -> pd.Series:
    """One decimal, rounding the exact binary value half up."""
    return values.map(lambda x: None if pd.isna(x) else float(Decimal(x).quantize(Decimal("0.1"), ROUND_HALF_UP)))


def padded(text: Column, width: int, left: bool = False) -> Column:
    """text filled up with blanks, never cut."""
    fill = F.repeat(F.lit(" "), F.greatest(F.lit(0), F.lit(width) - F.char_length(text)))
    return F.concat(fill, text) if left else F.concat(text, fill)
