"""Shared pieces of the training-data operators: staging in the shared folder, Arrow batches, text columns."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.operators.staging import discard as discard
from fieldglass.operators.staging import hidden as hidden
from fieldglass.operators.staging import shared_dir as shared_dir
from fieldglass.operators.staging import spread as spread
from fieldglass.operators.staging import staged as staged

#: Text handed to one vectorised step, in bytes; longer documents form a chunk of their own.
CHUNK_BYTES = 2 << 20


def tidied(step: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives freed memory back when its task ends: Python workers live on between tasks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    """Returns freed memory to the system, from Arrow's pool and where there is one from glibc's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def text_column(name: str = "text") -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def texts_of(batch: pa.RecordBatch, text: str) -> list[str]:
    """The texts of a batch, null read as empty."""
    return batch.column(batch.schema.get_field_index(text)).cast(pa.string()).fill_null("").to_pylist()


def id_remainder(name: str, modulus: int) -> Column:
    """crc32 of an id written as decimal text, modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit(""))) % modulus


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each holds about `limit` bytes of text at most (or one row)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if batch.num_rows == 0:
            continue
        if column.nbytes <= limit:
            yield batch
            continue
        start = size = 0
        lengths = pc.multiply(pc.list_value_length(column), 4) if pa.types.is_list(column.type) else pc.binary_length(column)
        for i, n in enumerate(lengths.to_pylist()):
            if size and size + (n or 0) > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n or 0
        yield batch.slice(start)


def over_text(df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, text: str = "text", limit: int = CHUNK_BYTES) -> DataFrame:
    """mapInArrow over chunks of bounded text size; `step` maps one record batch to one record batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, text, limit):
            yield step(chunk)

    return df.mapInArrow(tidied(run), schema)
