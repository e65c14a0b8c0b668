"""Operator 4: documents that hold benchmark items, by BM25 with block-max WAND and a check of question and answer.

Items of more than 256 words are cut into pieces of about equal length, each indexed as an item of its own. Documents are
cut into passages of as many words as the longest piece has (32 to 256), each half covered by the next, so that three
quarters of any piece fall into one passage. Every passage is a query against the index of pieces. A passage is
dropped as a whole if the largest impacts of its terms can't reach the threshold, over all items or within any group of
items; what is left is searched by block-max WAND, which gives all pieces above it. The whole item is confirmed on the
passage and its surroundings, as far as the item reaches from a piece: runs of three terms of its question and of its
answer must be there.

The index is sent to all executors. Its size is checked first: items are dealt into shards of at most SHARD_BYTES of text,
each with the statistics of all items, and with more than one shard the documents are searched once for each.

The result has one row per confirmed document and item, the best confirmed passage's; an item is a distinct id and text. A null or empty text, or a document without
words of any item, gives no row; a null item text or item without words is never found. Repeated rows of documents
give repeated results; items that share an id, or have none, are found by each of their texts. An empty table on either side gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm import bm25
from fieldglass.llm.common import chunks, text_column, texts_of, tidied

SHARD_BYTES = 16 << 20
#: Least score of a passage for an item, as a share of the item's own, and least overlaps of question and answer. A
#: question found as good as whole counts without its answer.
THRESHOLD, QUESTION, ANSWER, WHOLE_QUESTION = 0.5, 0.5, 0.5, 0.8
CACHE_WORDS = 200_000


class _Numbers(dict):
    def __init__(self, index: bm25.ItemIndex):
        super().__init__()
        self.index = index

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = n = self.index.number(word)
        return n


def passages(index: bm25.ItemIndex, numbers: np.ndarray, threshold: float) -> Iterator[tuple[int, int]]:
    """The passages start..end of a document (its words as term numbers) that the bounds don't rule out."""
    size = min(bm25.PIECE, max(32, index.longest))
    step, n = size // 2, len(numbers)
    sums = np.concatenate([[0.0], np.cumsum(index.most[numbers])])
    starts = np.arange(0, max(1, n - step), step)
    ends = np.minimum(starts + size, n)
    for k in np.flatnonzero(sums[ends] - sums[starts] >= threshold).tolist():
        s, e = int(starts[k]), int(ends[k])
        part = np.unique(numbers[s:e])
        if index.group_most[part].sum(axis=0).max() >= threshold - 1e-6:
            yield s, e


def found_in(index: bm25.ItemIndex, numbers: _Numbers, text: str, threshold: float = THRESHOLD) -> list[tuple]:
    """(item id, score, question overlap, answer overlap, first word of the passage) for each confirmed item of one text."""
    words = text.split()
    if not words or not index.ids:
        return []
    coded = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    hits: dict[int, list[tuple[float, int, int, int]]] = {}  # by item
    unknown = len(index.items)
    for s, e in passages(index, coded, threshold):
        for piece, score in index.search([t for t in np.unique(coded[s:e]).tolist() if t != unknown], threshold):
            hits.setdefault(index.pieces[piece][0], []).append((-score, s, e, piece))
    out = []
    for item in sorted(hits):
        for score, s, e, piece in sorted(hits[item]):  # the best of those confirmed, the first of equals
            _, before, after = index.pieces[piece]
            around = bm25.terms(" ".join(words[max(0, s - (e - s) - before) : e + (e - s) + after]))
            question, answer = (bm25.overlap(p, around) for p in index.parts[item])
            if question >= QUESTION and answer >= ANSWER or question >= WHOLE_QUESTION:
                out.append((index.ids[item], -score, question, answer, s))
                break
    return out


def _shards(items: DataFrame, key: str, text: str) -> Iterator[bm25.ItemIndex]:
    """Indexes over all items, each of a bounded size."""
    given = items.select(key, text_column(text).alias("__text")).distinct()
    size, count = given.agg(F.sum(F.octet_length("__text")), F.count(F.lit(1))).first()
    shards = -(-(size or 0) // SHARD_BYTES)
    if shards <= 1:
        yield bm25.ItemIndex([tuple(r) for r in given.collect()])
        return
    split = F.udf(bm25.terms, "array<string>")
    tokens = given.select(key, "__text", split("__text").alias("terms"))
    mean = tokens.agg(F.avg(F.size("terms"))).first()[0]
    frequency = tokens.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    for k in range(shards):
        own = given.filter(F.pmod(F.xxhash64(key, "__text"), F.lit(shards)) == k)
        wanted = own.select(F.explode(F.array_distinct(split("__text"))).alias("term")).distinct()
        yield bm25.ItemIndex([tuple(r) for r in own.collect()], dict(frequency.join(wanted, "term", "left_semi").collect()), count, mean)


def matches(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """(key, item, score, question_overlap, answer_overlap, first_word) for each document and item found in it."""
    spark, out = docs.sparkSession, None
    kinds = docs.schema[key].dataType.simpleString(), items.schema[item].dataType.simpleString()
    schema = f"`{key}` {kinds[0]}, `{item}` {kinds[1]}, score double, question_overlap double, answer_overlap double, first_word long"
    for index in _shards(items, item, text):
        shipped, kind = spark.sparkContext.broadcast(index), spark.createDataFrame([], f"x {kinds[1]}").toArrow().schema.field(0).type

        def run(batches, shipped=shipped, kind=kind):
            numbers = _Numbers(shipped.value)
            for batch in chunks(batches, "__text"):
                rows, at = [], []
                for i, t in enumerate(batch.column(1).to_pylist()):
                    new = found_in(shipped.value, numbers, t, threshold)
                    rows += new
                    at += [i] * len(new)
                columns = [pa.array([r[j] for r in rows], k) for j, k in enumerate((kind, pa.float64(), pa.float64(), pa.float64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names=[key, item, "score", "question_overlap", "answer_overlap", "first_word"])

        part = docs.select(key, text_column(text).alias("__text")).mapInArrow(tidied(run), schema)
        out = part if out is None else out.union(part)
    return out


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` in which no item is found, with their columns; judged row by row, without a join."""
    spark, rest = docs.sparkSession, docs
    for index in _shards(items, "item_id", "text"):
        shipped = spark.sparkContext.broadcast(index)

        def run(batches, shipped=shipped):
            numbers = _Numbers(shipped.value)
            for batch in chunks(batches, text):
                yield batch.filter(pa.array([not found_in(shipped.value, numbers, t) for t in texts_of(batch, text)], pa.bool_()))

        rest = rest.mapInArrow(tidied(run), rest.schema)
    return rest
