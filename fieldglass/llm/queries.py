"""The registered queries of the training-data operators, each over its whole table, and SQL where it can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.llm import bpe_coding, chat, classify, decontaminate, fingerprints, lm_score, minhash_dedup, nbsvm, suffix_dedup, token_counts
from fieldglass.llm.common import read_table, shared_dir, spread, text_column

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@_query
def op2_bpe_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and the text decoded from them, as digests."""
    path = tokenizer_path("byte_bpe_50k.json")
    docs = _documents(spark, sf_dir)
    coded = bpe_coding.decode(bpe_coding.encode(docs, path).drop("text"), path)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@_query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every text through a cache that starts empty, so that every distinct text is encoded."""
    cache = token_counts.DigestCache(spark, f"{shared_dir(spark)}/token-cache-{uuid.uuid4().hex}")
    docs = _documents(spark, sf_dir)
    counted = token_counts.count_tokens(docs, tokenizer_path("byte_bpe_50k.json"), cache)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


@_query
def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return minhash_dedup.linked(_documents(spark, sf_dir))


@_query
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removal of every byte that a repeating 400-byte string covers."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")  # read several times: not dealt out
    return suffix_dedup.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_removed") > 0).alias("removed"))


@_query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents from word n-grams."""
    docs = _documents(spark, sf_dir)
    return classify.classified(docs, read_table(spark, sf_dir, "labels"), "quality", nbsvm.word_features, 0.3).drop("text")


@_query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents from character n-grams."""
    docs = _documents(spark, sf_dir)
    return classify.classified(docs, read_table(spark, sf_dir, "labels"), "toxic", nbsvm.char_features, 0.5).drop("text")


@_query
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item found in it."""
    return decontaminate.matches(_documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark").select("item_id", "text"))


@_query
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and the fixed conversation -7, formatted and read back."""
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    fixed = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    back = chat.read_back(chat.format_conversations(rows.union(fixed)))
    turns = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")


ORACLES["op8_chat_format"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), f AS (
  SELECT *, 4 + length(role) + length(regexp_replace(role, '[^\\<#:]', '', 'g')) + 2
    + length(text) + length(regexp_replace(text, '[^\\<#]', '', 'g')) + 8 AS chars FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""


@_query
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likeness to each other and to the next document's."""
    f = fingerprints
    rows = f.with_edit(f.with_next(read_table(spark, sf_dir, "documents").select("doc_id", "text")))
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), f.as_text(F.col("sketch")).alias("fingerprint"), f.as_text(F.col("edited_sketch")).alias("edited_fingerprint"), f.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), f.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"))


@_query
def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of all documents, from those that are not held out."""
    return lm_score.score(_documents(spark, sf_dir))


ORACLES["op3_minhash_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)]) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)
), e AS (SELECT x, y FROM l UNION SELECT y, x FROM l
), r AS (SELECT doc_id AS root, doc_id AS node FROM documents UNION SELECT r.root, e.y FROM r JOIN e ON r.node = e.x
), c AS (SELECT root, min(node) AS component_id FROM r GROUP BY root)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.root = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
