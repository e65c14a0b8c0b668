"""Result envelopes and ingest files as DataFrames, and what their errors mean."""

from __future__ import annotations

import email.utils
import json
import re
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.operators import schema as L


class EnvelopeError(ValueError):
    """A reply that isn't one well-formed table."""


def _frame(spark: SparkSession, names: list[str], declared: list[str], rows: DataFrame, value: Callable) -> DataFrame:
    out = []
    for i, (name, kind) in enumerate(zip(names, declared, strict=True)):
        c, want = value(i, name), L.export_type(kind)
        text = F.try_variant_get(c, "$", "string")
        if want == "dynamic":
            new = F.when(F.schema_of_variant(c) == "STRING", text).otherwise(F.to_json(c))
        elif want == "decimal":
            new = text.try_cast("decimal(38,10)")
        elif want == "datetime":
            new = text.try_cast("timestamp")
        else:
            new = F.try_variant_get(c, "$", L.SPARK_TYPES[want].simpleString())
        out.append(F.when(F.is_variant_null(c), None).otherwise(new).alias(name, metadata={"declared": kind}))
    return rows.select(*out)


def read_named(spark: SparkSession, path: str) -> DataFrame:
    """An envelope of Schema and Results (either spelling): rows as objects. Entries that aren't objects and unnamed columns are left out."""
    text = spark.read.text(path, wholetext=True)
    key = lambda j, a, b: F.coalesce(F.get_json_object(j, f"$.{a}"), F.get_json_object(j, f"$.{b}"))
    head = text.select(key("value", "Schema", "schema").alias("s"), (F.get_json_object("value", "$.Results").isNotNull() | F.get_json_object("value", "$.results").isNotNull()).alias("r")).first()
    if head is None or not head["r"]:
        raise EnvelopeError("the reply has no results")
    rows = text.select(F.explode(F.from_json(key("value", "Results", "results"), "array<variant>")).alias("row")).filter(F.schema_of_variant("row").startswith("OBJECT"))
    columns = [(c.get("Name") or c.get("name"), c.get("Type") or c.get("type") or "dynamic") for c in json.loads(head["s"] or "[]") if isinstance(c, dict)]
    columns = [(n, t) for n, t in columns if n]
    if not columns:
        found = L.infer(rows.select(F.to_json("row").alias("j")), "j").orderBy("name").collect()
        columns = [(r["name"], {"Boolean": "bool", "Int64": "long", "Double": "real", "DateTime": "datetime", "String": "string"}.get(r["type"], "dynamic")) for r in found]
    return _frame(spark, [n for n, _ in columns], [t for _, t in columns], rows, lambda i, n: F.try_variant_get("row", "$['" + n.replace("'", "\\'") + "']", "variant"))


def read_positional(spark: SparkSession, path: str) -> DataFrame:
    """An envelope with one table whose rows are arrays; a reply with an error, other numbers of tables, repeated or empty column names and ragged rows fail."""
    text = spark.read.text(path, wholetext=True)
    head = text.select(F.get_json_object("value", "$.error").alias("e"), F.expr("json_array_length(get_json_object(value, '$.tables'))").alias("n"), F.get_json_object("value", "$.tables[0].columns").alias("c")).first()
    if head is None or head["n"] != 1:
        raise EnvelopeError("a reply has one table")
    if head["e"]:
        raise EnvelopeError(f"the reply is partial: {head['e'][:200]}")
    columns = json.loads(head["c"] or "[]")
    names = [c.get("name") or "" for c in columns]
    if not all(names) or len(set(names)) < len(names):
        raise EnvelopeError("column names must be unique and not empty")
    rows = text.select(F.explode(F.from_json(F.get_json_object("value", "$.tables[0].rows"), "array<array<variant>>")).alias("row"))
    even = F.when(F.size("row") == len(names), F.col("row")).otherwise(F.raise_error("a row has more or fewer values than columns").cast("array<variant>"))
    return _frame(spark, names, [c.get("type") or "dynamic" for c in columns], rows.select(even.alias("row")), lambda i, n: F.get("row", F.lit(i)))


def read_ingest(spark: SparkSession, path: str) -> DataFrame:
    """A file of one JSON object, an envelope, an array, or one object a line, told apart by its beginning; an empty file is an error."""
    head = spark.read.text(path).filter(F.trim("value") != "").limit(2).collect()
    if not head:
        raise EnvelopeError("the file is empty")
    first = head[0]["value"].lstrip()
    if first.startswith("["):
        return spark.read.option("mode", "FAILFAST").json(path, multiLine=True)
    try:
        whole = len(head) == 1 and json.loads(first)
    except ValueError:
        whole = None
    if whole is None or not first.startswith("{") or len(head) == 1 or not _is_json(first):
        if first.startswith("{") and (re.search(r'"(Results|results)"\s*:', first) or not _is_json(first)):
            try:
                return read_named(spark, path)
            except EnvelopeError:
                return spark.read.option("mode", "FAILFAST").json(path, multiLine=True)
    return spark.read.option("mode", "FAILFAST").json(path)


def _is_json(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


def retry_delay(headers: dict[str, str], body: str, throttled: int, now: datetime | None = None) -> float:
    """Seconds to wait after a throttled request: as the header says (a number or a date), else as the text says, else 30 s doubling to 15 min."""
    said = {k.lower(): v for k, v in headers.items()}.get("retry-after", "").strip()
    if said.isdigit():
        return float(said)
    if said:
        try:
            return max(0.0, (email.utils.parsedate_to_datetime(said) - (now or datetime.now(UTC))).total_seconds())
        except ValueError:
            pass
    if m := re.search(r"(?i)(?:retry|try again)\s+(?:in|after)\s+(\d+)\s+second", body):
        return float(m[1])
    return float(min(30 * 2 ** max(0, throttled - 1), 900))


def is_size_exceeded(code: int, body: str) -> bool:
    """Does an error say that the result is too large?"""
    low = body.lower()
    return "e_query_result_set_too_large" in low or code == 400 and "result size" in low and ("exceed" in low or "too large" in low)


def is_table_missing(code: int, body: str, table: str) -> bool:
    """Does an error say that exactly this table doesn't exist?"""
    return code == 400 and any(n == table for n in re.findall(r"['\"‘]([^'\"’]+)['\"’]", body)) and bool(re.search(r"(?i)could not be resolved|failed to resolve|not found|does not exist", body))


class Tables:
    """A source of named tables in the session's catalog or in a folder of Parquet files."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet") if self.folder else self.spark.table(name)

    def exists(self, name: str) -> bool:
        try:
            self.table(name).schema
        except AnalysisException as e:
            if e.getCondition() in ("TABLE_OR_VIEW_NOT_FOUND", "PATH_NOT_FOUND"):
                return False
            raise
        return True


SOURCES: dict[str, Callable[..., Tables]] = {"catalog": Tables, "folder": Tables}
