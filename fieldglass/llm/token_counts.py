"""Operator 10: token counts through a digest cache.

The digest of a text's normalised content and the digest of the tokenizer's file together name a stored count.
Texts whose digest has a count are not encoded; of the rest each distinct text is encoded once, and its count is
appended to the cache. Content is normalised only where that can't change a count: a null text is the empty text.

The result has one row per input row (repeated rows each have theirs), in no order, with every input column; columns
named digest, n_bytes or n_tokens are replaced. An empty table gives an empty result and leaves the cache alone.
Rows of one hot text meet only as pre-aggregated digests; the joins that bring counts back are sort-merge joins,
which the engine splits where a digest is hot.
"""

from __future__ import annotations

from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.llm import bpe
from fieldglass.llm.common import over_text, shared_dir, text_column

_models: dict[str, object] = {}


def _counter(version: str, spec: bytes, kind: str):
    """Counts for a list of texts as the library of that file kind gives them, without added tokens."""
    if kind == ".model":
        import sentencepiece

        if version not in _models:
            _models[version] = sentencepiece.SentencePieceProcessor(model_proto=spec)
        model = _models[version]
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    try:
        return bpe.loaded(version, spec).count_each
    except ValueError:  # another kind of vocabulary: its own library
        from tokenizers import Tokenizer

        if version not in _models:
            model = Tokenizer.from_str(spec.decode())
            model.no_truncation()
            model.no_padding()
            _models[version] = model
        model = _models[version]
        return lambda texts: [len(model.encode(t, add_special_tokens=False).ids) for t in texts]


class DigestCache:
    """Counts by (digest, tokenizer version), kept as Parquet that is only ever appended to."""

    SCHEMA = "digest string, n_tokens long, version string"

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{shared_dir(spark)}/token-cache"

    def _exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def known(self, version: str) -> DataFrame | None:
        if not self._exists():
            return None
        rows = self.spark.read.schema(self.SCHEMA).parquet(self.path).filter(F.col("version") == version)
        return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))  # two writers may have appended the same count

    def append(self, counts: DataFrame, version: str) -> None:
        counts.select("digest", "n_tokens").withColumn("version", F.lit(version)).write.mode("append").option("compression", "zstd").parquet(self.path)


def count_tokens(df: DataFrame, path: str, cache: DigestCache, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Adds digest, n_bytes and n_tokens to each row; `key` picks the row whose text is encoded, and may repeat or be null."""
    spark, kind = df.sparkSession, Path(path).suffix
    spec = Path(path).read_bytes()
    version, shipped = bpe.version_of(spec), spark.sparkContext.broadcast(spec)
    content = text_column(text)
    given = df.withColumn("digest", F.sha2(content, 256)).withColumn("n_bytes", F.octet_length(content).cast("long")).drop("n_tokens")

    first = given.groupBy("digest").agg(F.min(key).alias("__key"))
    known = cache.known(version)
    misses = first if known is None else first.join(known, "digest", "left_anti")
    texts = df.select(F.col(key).alias("__own"), content.alias("__text")).withColumn("digest", F.sha2("__text", 256))
    misses = misses.withColumnRenamed("digest", "__digest").hint("shuffle_hash")
    chosen = texts.join(misses, (F.col("digest") == F.col("__digest")) & F.col("__own").eqNullSafe(F.col("__key")), "left_semi")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = _counter(version, shipped.value, kind)(batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    encoded = over_text(chosen.select("digest", "__text"), step, "digest string, n_tokens long", "__text")
    cache.append(encoded.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), version)  # rows repeated with their key meet here
    counts = cache.known(version)
    return given.join(counts.hint("merge"), "digest")
