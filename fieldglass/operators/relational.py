"""Relational operators of the pipe language on DataFrames: extend, join with renaming, summarize, union, take."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.functions import scalar as S


def extend(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds or replaces columns, all computed from the input's columns."""
    return df.withColumns(columns)


def project(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*(c.alias(n) for n, c in columns.items()))


def join_inner(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner equi-join on one column; columns of the right side whose names are taken get the suffix 1 (then 2, ...), its key included."""
    taken, names = set(left.columns), []
    for name in right.columns:
        new, i = name, 0
        while new in taken:
            i += 1
            new = f"{name}{i}"
        taken.add(new)
        names.append(new)
    own = right.toDF(*names)
    return left.join(own, left[key] == own[names[right.columns.index(key)]], "inner")


def any_value(c: Column, kind: str = "string") -> Column:
    """Some value of the group, one that isn't empty if there is one: the smallest, so that runs agree."""
    return F.min(F.when(S.isnotempty(c), c) if kind == "string" else c)


def summarize(df: DataFrame, by: Mapping[str, Column], **aggregates: Column) -> DataFrame:
    """Aggregates by named expressions; null groups stay, and one expression may be a key twice."""
    named = [c.alias(n) for n, c in by.items()]
    return df.groupBy(*named).agg(*(c.alias(n) for n, c in aggregates.items())) if named else df.agg(*(c.alias(n) for n, c in aggregates.items()))


def union(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows of all inputs, over all their columns; what an input lacks is null."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def take(df: DataFrame, n: int, *order: str) -> DataFrame:
    """Some n rows; with `order` the first ones by it."""
    return (df.orderBy(*order) if order else df).limit(n)


def count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("Count"))
