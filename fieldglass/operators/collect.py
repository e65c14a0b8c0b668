"""Collection of a table or query result in verified parts: window, buckets, plan, checks."""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldglass.functions import scalar as S

ROW_LIMIT, LARGEST_ROW_LIMIT = 30_000, 100_000
_SCALAR = (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.TimestampType, T.TimestampNTZType, T.DateType, T.DayTimeIntervalType)


class CollectionError(ValueError):
    """A result that isn't complete or can't be divided."""


def window(df: DataFrame, column: str, lookback: str, cutoff: datetime, ingested: str | None = None) -> DataFrame:
    """Rows with cutoff - lookback <= time < cutoff, both fixed before the query runs, and arrived before the cutoff.

    Bounds are literals, so they reach the scan as pushed filters. A row whose arrival is unknown stays.
    """
    start = cutoff - timedelta(microseconds=S.lookback_microseconds(lookback))
    out = df.filter((F.col(column) >= F.lit(start)) & (F.col(column) < F.lit(cutoff)))
    return out.filter(F.coalesce(F.col(ingested) < F.lit(cutoff), F.lit(True))) if ingested else out


def key_columns(schema: T.StructType) -> list[str]:
    """The columns of a bucket key: all scalar ones, by name. Names must be there and differ."""
    names = [f.name for f in schema.fields]
    if any(not n for n in names) or len(set(names)) < len(names):
        raise CollectionError("column names must be unique and not empty")
    found = sorted(f.name for f in schema.fields if isinstance(f.dataType, _SCALAR))
    if not found:
        raise CollectionError("no scalar column to divide rows by")
    return found


def key_number(columns: Sequence[str]) -> Column:
    """A 60-bit number of a row's key: from the SHA-256 of the JSON array of its values as text."""
    return S.digest_number(S.pack_array(*(F.col(f"`{c.replace('`', '``')}`") for c in columns)))


def with_bucket(df: DataFrame, buckets: int, columns: Sequence[str] | None = None, name: str = "DumpPartition") -> DataFrame:
    return df.withColumn(name, key_number(columns or key_columns(df.schema)) % buckets)


def bucket_counts(df: DataFrame, buckets: int, columns: Sequence[str] | None = None) -> DataFrame:
    """(DumpPartition, Count); one shuffle of as many rows per task as there are buckets at most."""
    key = key_number(columns or key_columns(df.schema)) % buckets
    return df.groupBy(key.alias("DumpPartition")).agg(F.count(F.lit(1)).alias("Count"))


def bucket(df: DataFrame, buckets: int, number: int, columns: Sequence[str] | None = None) -> DataFrame:
    """The rows of one bucket."""
    return df.filter(key_number(columns or key_columns(df.schema)) % buckets == number)


def check_counts(counts: DataFrame, buckets: int, total: int) -> None:
    """Bucket numbers are unique and in range, counts positive, and their sum is the total."""
    c, p = F.col("Count"), F.col("DumpPartition")
    r = counts.agg(
        F.coalesce(F.sum(c), F.lit(0)).alias("sum"),
        (F.count(p) - F.countDistinct(p)).alias("repeated"),
        F.sum(F.when(p.isNull() | (p < 0) | (p >= buckets), 1).otherwise(0)).alias("outside"),
        F.sum(F.when(c.isNull() | (c <= 0), 1).otherwise(0)).alias("empty"),
    ).first()
    if r["outside"] or r["repeated"] or r["empty"]:
        raise CollectionError(f"bucket counts are malformed: {r['outside']} out of range, {r['repeated']} repeated, {r['empty']} not positive")
    if r["sum"] != total:
        raise CollectionError(f"bucket counts sum to {r['sum']}, not {total}")


@dataclass(frozen=True)
class Plan:
    """How a result is fetched: as one part (buckets None), or in buckets with their counts, ascending."""

    total: int
    buckets: int | None
    counts: tuple[tuple[int, int], ...]
    rounds: tuple[int, ...]


def first_buckets(total: int, limit: int, least: int = 2) -> int:
    return max(2, -(-total // limit), least)


def plan(df: DataFrame, limit: int = ROW_LIMIT, least: int = 2, byte_limit: int | None = None) -> Plan:
    """Doubles the number of buckets until each has fewer rows than `limit` (and bytes than `byte_limit`).

    Every number of buckets tried divides the largest, so rows are counted once at that one and counts are folded down:
    a shuffle of at most `limit` rows per task, and at most `limit` counts at the driver.
    """
    if not 0 < limit <= LARGEST_ROW_LIMIT:
        raise CollectionError(f"the row limit must be 1 to {LARGEST_ROW_LIMIT}")
    size = F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)))) if byte_limit else F.lit(0)
    total, volume = df.agg(F.count(F.lit(1)), F.sum(size)).first()
    if total < limit and (not byte_limit or (volume or 0) <= byte_limit):
        return Plan(total, None, (), ())
    tried = [first_buckets(total, limit, least)]
    while tried[-1] * 2 <= limit:
        tried.append(tried[-1] * 2)
    if tried[0] <= limit:
        number = key_number(key_columns(df.schema)) % tried[-1]
        finest = df.select(number.alias("DumpPartition"), size.alias("s")).groupBy("DumpPartition").agg(F.count(F.lit(1)).alias("n"), F.sum("s").alias("s")).collect()
        if (seen := sum(r["n"] for r in finest)) != total:
            raise CollectionError(f"bucket counts sum to {seen}, not {total}")
        for i, buckets in enumerate(tried):
            rows: dict[int, int] = {}
            sizes: dict[int, int] = {}
            for r in finest:
                at = r["DumpPartition"] % buckets
                rows[at] = rows.get(at, 0) + r["n"]
                sizes[at] = sizes.get(at, 0) + r["s"]
            if max(rows.values()) < limit and (not byte_limit or max(sizes.values()) <= byte_limit):
                return Plan(total, buckets, tuple(sorted(rows.items())), tuple(tried[: i + 1]))
    raise CollectionError(f"rows can't be divided into parts under {limit} rows with at most {limit} buckets")


def planned_rounds(df: DataFrame, rounds: Sequence[int], columns: Sequence[str] | None = None) -> DataFrame:
    """(Buckets, DumpPartition, Count) for each number of buckets, counted once at a multiple of all of them and folded down."""
    finest = math.lcm(*rounds)
    counted = df.groupBy((key_number(columns or key_columns(df.schema)) % finest).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    each = counted.select("n", F.explode(F.array(*(F.struct(F.lit(r).cast("long").alias("Buckets"), (F.col("k") % r).alias("DumpPartition")) for r in rounds))).alias("b"))
    return each.groupBy("b.Buckets", "b.DumpPartition").agg(F.sum("n").alias("Count"))


def collect_to(df: DataFrame, path: str, made: Plan, columns: Sequence[str] | None = None) -> int:
    """Writes the planned parts as Parquet, one folder a bucket, in one job; returns the rows written after comparing with the plan.

    A column DumpPartition that `df` brings is taken as it is: rows may have been rewritten since they were planned. Parts
    are written beside `path`, checked, and only then put in its place, so a failure leaves earlier parts alone.
    """
    spark, temp = df.sparkSession, f"{path}.{uuid.uuid4().hex}.new"
    files = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    at = lambda name: spark._jvm.org.apache.hadoop.fs.Path(name)
    try:
        if made.buckets is None:
            df.write.parquet(temp)
        else:
            dealt = df if "DumpPartition" in df.columns else with_bucket(df, made.buckets, columns)
            dealt.repartition(min(made.buckets, 2_000), "DumpPartition").write.partitionBy("DumpPartition").parquet(temp)
        back = spark.read.parquet(temp)
        kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields if f.name != "DumpPartition"}
        if kinds != {f.name: f.dataType.simpleString() for f in back.schema.fields if f.name != "DumpPartition"}:
            raise CollectionError("written parts differ from the result in columns or types")
        if made.buckets is not None and {r[0]: r[1] for r in back.groupBy("DumpPartition").count().collect()} != dict(made.counts):
            raise CollectionError("written buckets differ from the plan")
        written = back.count()
        if written != made.total:
            raise CollectionError(f"{written} rows written, {made.total} planned")
        if files.exists(at(path)):
            files.delete(at(path), True)
        if not files.rename(at(temp), at(path)):
            raise CollectionError(f"the checked parts can't be put at {path}")
        return written
    finally:
        files.delete(at(temp), True)


def count_reply(rows: list[dict]) -> int:
    """The number in a count reply: exactly one row with an integral column named Count in any case."""
    if len(rows) != 1:
        raise CollectionError(f"a count reply has one row, not {len(rows)}")
    for name, value in rows[0].items():
        if name.lower() == "count" and not isinstance(value, bool):
            if isinstance(value, int) or isinstance(value, float) and value.is_integer() or isinstance(value, str) and value.lstrip("-").isdigit():
                return int(value)
    raise CollectionError("a count reply needs an integral Count")
