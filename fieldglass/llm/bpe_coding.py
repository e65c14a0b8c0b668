"""Operator 2: BPE encoding and decoding of whole texts with a public byte-level vocabulary.

A null text is encoded as the empty text: no ids, decoded as empty. Rows, their order of columns and extra
columns pass through; a column that bears the output's name is replaced. Repeated rows are coded each alike.
Both directions run where the rows are: no shuffle, memory bounded by a chunk of text and the word table.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldglass.llm import bpe
from fieldglass.llm.common import over_text, texts_of


def vocabulary(spark: SparkSession, path: str) -> Callable[[], bpe.RankedBpe]:
    """The vocabulary file (a few MB, whatever the data) sent to the executors once; the result loads it there."""
    spec = Path(path).read_bytes()
    version, shipped = bpe.version_of(spec), spark.sparkContext.broadcast(spec)
    return lambda: bpe.loaded(version, shipped.value)


def _with(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), values], names=[*names, name])


def _schema(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name != name]).add(name, kind)


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds `out`, the ids of each text; special tokens inside texts become their own ids, none is added."""
    load = vocabulary(df.sparkSession, path)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat, offsets = load().encode_flat(texts_of(batch, text))
        return _with(batch, out, pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.astype(np.int32))))

    return over_text(df, step, _schema(df, out, T.ArrayType(T.IntegerType())), text)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded", special: bool = True) -> DataFrame:
    """Adds `out`, the text of each row's ids; special ids are written as their strings unless `special` is off."""
    load = vocabulary(df.sparkSession, path)
    given = df.withColumn(ids, F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>")))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder, column = load(), batch.column(batch.schema.get_field_index(ids))
        flat, offsets = column.flatten().fill_null(-1).to_numpy(zero_copy_only=False), column.offsets.to_numpy() - column.offsets[0].as_py()
        if not special:
            flat = np.where(np.isin(flat, list(coder.special.values())), -1, flat)
        return _with(batch, out, pa.array(coder.decode_flat(flat, offsets), pa.string()))

    return over_text(given, step, _schema(given, out, T.StringType()), ids)

