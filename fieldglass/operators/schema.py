"""Schema inference, type mapping and export names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ranks of inferred types: a column takes the largest, except that integers and doubles meet as doubles.
RANKS = ["Boolean", "Int64", "Double", "DateTime", "String", "Dynamic"]
#: Declared type text to key type and to export type; the tables differ on purpose.
KEY_TYPES = {"string": "string", "bool": "bool", "boolean": "bool", "sbyte": "bool", "int": "int", "int32": "int", "long": "long", "int64": "long", "real": "real", "double": "real", "decimal": "decimal", "sqldecimal": "decimal", "datetime": "datetime", "timespan": "timespan", "guid": "guid"}
EXPORT_TYPES = {"string": "string", "bool": "bool", "boolean": "bool", "sbyte": "bool", "int": "int", "int32": "int", "integer": "int", "long": "long", "int64": "long", "real": "real", "double": "real", "float": "real", "decimal": "decimal", "sqldecimal": "decimal", "datetime": "datetime", "date": "datetime", "guid": "guid"}
#: Spark types of declared types.
SPARK_TYPES = {"string": T.StringType(), "bool": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "real": T.DoubleType(), "decimal": T.DecimalType(38, 10), "datetime": T.TimestampType(), "guid": T.StringType(), "dynamic": T.StringType()}


def key_type(declared: str) -> str | None:
    """The key type of a declared type, None where it can't be part of a key."""
    return KEY_TYPES.get(declared.strip().lower())


def export_type(declared: str) -> str:
    return EXPORT_TYPES.get(declared.strip().lower(), "dynamic")


def declared_type(kind: T.DataType) -> str:
    """The declared type text of a Spark type."""
    names = {"string": "String", "boolean": "Boolean", "byte": "Int32", "short": "Int32", "integer": "Int32", "long": "Int64", "float": "Double", "double": "Double", "decimal": "SqlDecimal", "timestamp": "DateTime", "timestamp_ntz": "DateTime", "date": "DateTime"}
    return names.get(kind.typeName(), "Dynamic")


def merge(left: str, right: str) -> str:
    return RANKS[max(RANKS.index(left), RANKS.index(right))]


def value_type(c: Column) -> Column:
    """The inferred type of a JSON value given as a variant: null, objects and lists are Dynamic."""
    kind = F.schema_of_variant(c)
    text = F.variant_get(c, "$", "string")
    time = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
    return (
        F.when(kind == "BOOLEAN", "Boolean")
        .when(kind == "BIGINT", "Int64")
        .when(kind.rlike("^(DOUBLE|DECIMAL|FLOAT)"), F.when(F.try_variant_get(c, "$", "double") == F.floor(F.try_variant_get(c, "$", "double")), "Int64").otherwise("Double"))
        .when(kind == "STRING", F.when(text.rlike(time), "DateTime").otherwise("String"))
        .otherwise("Dynamic")
    )


def infer(df: DataFrame, column: str) -> DataFrame:
    """(name, type) of the members of JSON objects in a text column: the sorted union of keys, annotation keys left out.

    The fold is a built-in maximum of ranks per key, combined before the shuffle.
    """
    members = df.select(F.explode(F.from_json(column, "map<string,variant>")).alias("name", "value")).filter(~F.col("name").endswith("@odata.type"))
    kind = F.coalesce(F.when(F.col("value").isNull(), F.lit("Dynamic")).otherwise(value_type(F.col("value"))), F.lit("Dynamic"))
    rank = F.array_position(F.array(*map(F.lit, RANKS)), kind)
    best = members.select("name", rank.alias("rank")).groupBy("name").agg(F.max("rank").alias("rank"))
    return best.select("name", F.element_at(F.array(*map(F.lit, RANKS)), F.col("rank").cast("int")).alias("type"))


def safe_names(names: list[str]) -> list[str]:
    """Names of letters, digits and underscores; a leading digit gets an underscore, repeats get _2, _3 and so on."""
    out, seen = [], set()
    for name in names:
        clean = re.sub(r"[^A-Za-z0-9_]", "_", name.strip()) or "column"
        clean = f"_{clean}" if clean[0].isdigit() else clean
        new, i = clean, 1
        while new.lower() in seen:
            i += 1
            new = f"{clean}_{i}"
        seen.add(new.lower())
        out.append(new)
    return out


def json_path(name: str) -> str:
    """The JSON path of a field: dotted where the name is plain, quoted otherwise."""
    return f"$.{name}" if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name) else "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"
