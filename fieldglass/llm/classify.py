"""Operators 5 and 6: quality and toxicity scores from naive Bayes support vectors, trained on labelled documents.

Labels are learnt only from rows with crc32(id as text) mod 5 other than 0. The fit takes at most SAMPLE of these, half
from each class where there are enough, chosen by the hash of the id, and at most FIT_BYTES of their features; class
shares are counted over all of them. Scores are computed for every row, from its whole text and nothing else.

A null or empty text is scored like any other. Null labels are no labels; a document labelled twice counts once, with
the larger label. Without labels of both classes every text's score is the share of label 1 (0.5 if there is none).
Repeated rows score alike; a null id is held out. Extra columns pass through; those named like the outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldglass.llm import nbsvm
from fieldglass.llm.common import give_back, id_remainder, over_text, staged, text_column, texts_of

#: Most labelled documents that a fit takes.
SAMPLE = 4_000
#: Most bytes of their features that reach the driver; rows beyond it, in the order of their ids' hashes, aren't taken.
FIT_BYTES = 96 << 20


def fit(docs: DataFrame, labels: DataFrame, label: str, features: nbsvm.Features, sample: int = SAMPLE, key: str = "doc_id", text: str = "text") -> nbsvm.Model:
    """A model of `label` from the labelled training rows of `docs`."""
    spark = docs.sparkSession
    given = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & (id_remainder(key, 5) != 0)).groupBy(key).agg(F.max(label).cast("int").alias("label"))
    counts = {r["label"]: r["n"] for r in given.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    ones, zeros = counts.get(1, 0), counts.get(0, 0)
    share = ones / (ones + zeros) if ones + zeros else 0.5
    take = {1: max(sample // 2, sample - zeros), 0: max(sample // 2, sample - ones)}
    chosen = []
    for y in (0, 1):
        order = F.xxhash64(key)
        chosen += [(r[0], y) for r in given.filter(F.col("label") == y).orderBy(order, key).limit(min(take[y], sample)).select(key).collect()]
    if not ones or not zeros:
        return nbsvm.fit([], np.zeros(0), share)
    ids = spark.createDataFrame(chosen, f"__own {docs.schema[key].dataType.simpleString()}, label int")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = features(batch.column(0).to_pylist())
        packed = [zstandard.ZstdCompressor().compress(np.diff(r, prepend=r.dtype.type(0)).tobytes()) for r in found]
        return pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), pa.array([r.nbytes for r in found], pa.int64()), batch.column(1), batch.column(2)], names=["buckets", "size", "label", "order"])

    # at most `sample` ids: a bounded broadcast; of rows that share an id the one with the smallest digest, so at most as many rows back
    matched = docs.select(F.col(key).alias("__id"), text_column(text).alias("__text")).join(F.broadcast(ids), F.col("__id") == F.col("__own"))
    rows = over_text(matched.select("__text", "label", F.xxhash64("__id").alias("order")), step, "buckets binary, size long, label int, order long", "__text")
    rows = staged(rows.groupBy("order", "label").agg(F.min_by("buckets", F.md5("buckets")).alias("buckets"), F.min_by("size", F.md5("buckets")).alias("size")), "fit")
    sizes = sorted(tuple(r) for r in rows.select("order", "size").collect())
    last = max((o for (o, _), n in zip(sizes, np.cumsum([n for _, n in sizes])) if n <= FIT_BYTES), default=sizes[0][0] if sizes else 0)
    rows = sorted(rows.filter(F.col("order") <= last).collect(), key=lambda r: (r["order"], r["buckets"]))
    signs = np.array([1 if r["label"] == 1 else -1 for r in rows])
    found = [np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(r["buckets"]), np.int32), dtype=np.int32) for r in rows]
    del rows
    try:
        return nbsvm.fit(found, signs, share)
    finally:
        del found
        give_back()  # the driver lives on, in the pipeline through four more stages


def score(docs: DataFrame, model: nbsvm.Model, features: nbsvm.Features, threshold: float, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds held_out, score and predicted to each row. The model shipped to the executors has a fixed size of 2 MB."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = shipped.value.probabilities(features(texts_of(batch, text)))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, "score"])

    given = docs.drop("held_out", "score", "predicted").withColumn("held_out", id_remainder(key, 5) == 0)
    scored = over_text(given, step, T.StructType([*given.schema.fields]).add("score", "double"), text)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classified(docs: DataFrame, labels: DataFrame, label: str, features: Callable, threshold: float) -> DataFrame:
    return score(docs, fit(docs, labels, label, features), features, threshold)
