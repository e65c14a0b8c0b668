"""Operator 9: a smoothed bigram model of the training documents, stored as Elias-Fano tries, scores every document.

Documents are packed into batches of some megabytes: texts as word numbers, and distinct words as 64-bit hashes.

1. Words. A batch sends each shard of the hash space its distinct words there with their counts in training documents. A
   shard sums them into its level of words and answers with counts and with numbers: a training word's number is its rank
   among all, so from here on words are small numbers.
2. Pairs. A batch sends the distinct pairs of its training documents with their counts to the shards of their contexts;
   a shard sums them and builds its levels: contexts, monotone pointers, successors, quantised smoothed probabilities. They
   are stored as a table, a row for each shard.
3. Queries. A batch asks each shard for all its distinct pairs, held-out ones included. A shard maps its levels from a
   file and answers with a code for each pair. The batch then adds up its documents' scores.

p(w|v) = (c(v w) + KAPPA p(w)) / (c(v) + KAPPA), where p(w) is absolutely discounted and unseen words share the discount as
one unknown word. Every pair of the training documents counts; a pair not among them keeps KAPPA p(w) / (c(v) + KAPPA). A
text begins with the context of the end mark. What is learnt grows with the corpus and is never gathered in one place; the
driver gets five sums for each shard of words.

Only distinct n-grams of whole batches move, so a frequent word or pair is one entry per batch. The successors of a context
are dealt over more shards the more often it occurs, so none outgrows a task. Words are known by 64-bit hashes: with 10^9
different words two agree with a probability of 3 percent. Pairs are exact over the words' numbers.

Null and empty texts have one token, the end. A null id trains (its remainder is 0). Repeated rows count repeatedly and score
alike. Without training documents every score is 0. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm import ngram_trie as T
from fieldglass.llm import shingles as S
from fieldglass.llm.common import chunks, discard, give_back, id_remainder, staged, text_column, tidied

_U = np.uint64
#: Weight of the word model in a context; bytes of text in a batch; distinct words of batches per shard of words; tokens per shard of pairs.
KAPPA, BATCH_BYTES, SHARD_WORDS, SHARD_TOKENS = 20.0, 8 << 20, 1_000_000, 2_000_000
#: Occurrences of a context, as a share of a shard's tokens, from which on its successors are dealt over more shards.
DEAL = 8
END = S._hashes[b"\n"]


def _pack(a: np.ndarray) -> bytes:
    """Numbers with their bytes of equal weight side by side, compressed: the high bytes of small numbers take no room."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T).tobytes())


def _unpack(b: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _batches(docs: DataFrame, key: str) -> DataFrame:
    """(batch, ids, held, sizes, tokens, words, n, distinct): documents as places in their batch's sorted distinct word hashes; tokens include each text's end."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for chunk in chunks(batches, "__text", BATCH_BYTES):
            hashes = [np.append(S.word_hashes(t), _U(END)) for t in chunk.column(2).to_pylist()]
            words, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
            sizes = np.array([len(h) for h in hashes], np.int32)
            one = pa.array([0, chunk.num_rows], pa.int32())
            columns = [pa.array([(task << 24) | n], pa.int64()), pa.ListArray.from_arrays(one, chunk.column(0)), *(pa.array([_pack(x)]) for x in (np.array(chunk.column(1).to_pylist(), bool), sizes, tokens.astype(np.int32))), pa.array([words.tobytes()])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([len(tokens)], pa.int64()), pa.array([len(words)], pa.int64())], names=["batch", "ids", "held", "sizes", "tokens", "words", "n", "distinct"])
            n += 1

    return docs.mapInArrow(tidied(run), f"batch long, ids array<{kind}>, held binary, sizes binary, tokens binary, words binary, n long, distinct long")


def _training(held: bytes, sizes: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(held-out documents, their sizes, training tokens)"""
    h, n = _unpack(held, bool), _unpack(sizes, np.int32).astype(np.int64)
    return h, n, np.repeat(~h, n)


def _word_requests(batches: DataFrame, bits: int) -> DataFrame:
    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for batch, held, sizes, tokens, words in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                w = np.frombuffer(words, _U)
                c = np.bincount(_unpack(tokens, np.int32)[_training(held, sizes)[2]], minlength=len(w)).astype(np.int32)
                at = np.append(np.searchsorted(w >> _U(64 - bits), np.arange(1 << bits, dtype=_U)), len(w))
                k = np.flatnonzero(at[1:] > at[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.full(len(k), batch)), pa.array([w[at[i] : at[i + 1]].tobytes() for i in k], pa.binary()), pa.array([_pack(c[at[i] : at[i + 1]]) for i in k], pa.binary())], names=["shard", "batch", "words", "counts"])

    return batches.select("batch", "held", "sizes", "tokens", "words").mapInArrow(tidied(run), "shard long, batch long, words binary, counts binary")


def _word_level(bits: int):
    def build(table: pa.Table) -> pa.Table:
        """Numbers (within the shard) and counts of its words for each batch; in a row of batch -1 the level itself and sums over it."""
        words = [np.frombuffer(x, _U) & _U((1 << (64 - bits)) - 1) for x in table["words"].to_pylist()]
        distinct, place = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate([_unpack(x, np.int32) for x in table["counts"].to_pylist()]), minlength=len(distinct)).astype(np.int64)
        known = np.flatnonzero(total)
        level = T.Words.build(distinct[known], total[known], 1 << (64 - bits))
        answers = [level.search(w) for w in words]
        shard, n = table["shard"][0].as_py(), len(words)
        sums = np.array([total.sum(), len(known), (total == 1).sum(), (total == 2).sum()], np.int64)
        out = {"batch": pa.array([*table["batch"].to_pylist(), -1], pa.int64()), "shard": pa.array([shard] * (n + 1), pa.int64())}
        out |= {"numbers": pa.array([*(_pack(a) for a, _ in answers), level.to_bytes()], pa.binary()), "counts": pa.array([*(_pack(c) for _, c in answers), sums.tobytes()], pa.binary())}
        give_back()
        return pa.table(out)

    return build


def _counted(batches: DataFrame, replies: DataFrame, firsts: dict[int, int]) -> DataFrame:
    """Batches with the number (over all shards) and count of each of their words instead of the words."""
    kind = batches.schema["ids"].dataType.simpleString()

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            numbers, counts = [], []
            for replied in b.column(5).to_pylist():
                replied.sort(key=lambda r: r["shard"])
                own = [(_unpack(r["numbers"], np.int64), firsts[r["shard"]]) for r in replied]
                numbers.append(_pack(np.concatenate([np.where(x < 0, -1, x + first) for x, first in own])))
                counts.append(_pack(np.concatenate([_unpack(r["counts"], np.int64) for r in replied])))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(numbers, pa.binary()), pa.array(counts, pa.binary())], names=["batch", "ids", "held", "sizes", "tokens", "numbers", "counts"])

    joined = batches.join(replies.groupBy("batch").agg(F.collect_list(F.struct("shard", "numbers", "counts")).alias("replies")), "batch")
    return joined.select("batch", "ids", "held", "sizes", "tokens", "replies").mapInArrow(tidied(run), f"batch long, ids {kind}, held binary, sizes binary, tokens binary, numbers binary, counts binary")


class _Unigrams:
    """Probabilities of a batch's words."""

    def __init__(self, counts: np.ndarray, sums: tuple[int, int, int, int]):
        n, v, n1, n2 = sums
        self.n, self.v = n, v
        discount = min(max(n1 / max(1, n1 + 2 * n2), 0.1), 0.95)
        with np.errstate(divide="ignore"):
            known = np.log10(np.maximum(counts - discount, 0) / max(n, 1))
        self.log10p = np.where(counts > 0, known, np.log10(discount * v / n) if n else 0.0)


class _Pairs:
    """The distinct pairs of some tokens of a batch, sorted by shard, context and successor; `number` has each token's pair, -1 where it can't have been seen."""

    def __init__(self, tokens: np.ndarray, sizes: np.ndarray, numbers: np.ndarray, counts: np.ndarray, end: int, bits: int, of: np.ndarray | None = None):
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[np.cumsum(sizes) - sizes] = end
        self.total = counts[before]  # how often each token's context was seen
        used = np.flatnonzero((self.total > 0) & (counts[tokens] > 0) & (True if of is None else of))
        keys, which, self.seen = np.unique(before[used] * len(counts) + tokens[used], return_inverse=True, return_counts=True)
        first, second = keys // max(1, len(counts)), keys % max(1, len(counts))
        parts = 1 << np.ceil(np.log2(np.maximum(1.0, counts[first] * DEAL / SHARD_TOKENS))).astype(np.int64)
        deal = (numbers[second] & (parts - 1)).astype(_U)
        self.shard = (S.mixed(numbers[first].astype(_U) + deal * _U(0x9E3779B97F4A7C15)) >> _U(64 - bits)).astype(np.int64)
        order = np.argsort(self.shard.astype(np.uint16) if bits <= 16 else self.shard, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.number = np.full(len(tokens), -1)
        self.number[used] = place[which]
        self.first, self.second, self.shard, self.seen = first[order], second[order], self.shard[order], self.seen[order]
        self.context, self.successor = numbers[self.first], numbers[self.second]

    def slices(self) -> Iterator[tuple[int, slice, np.ndarray]]:
        """(shard, its pairs, where contexts begin among them)"""
        at = np.flatnonzero(np.concatenate([[True], self.shard[1:] != self.shard[:-1]])) if len(self.shard) else np.zeros(0, np.int64)
        for s, e in zip(at.tolist(), [*at[1:].tolist(), len(self.shard)]):
            c = self.context[s:e]
            yield int(self.shard[s]), slice(s, e), np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))


def _listed(context: np.ndarray, successor: np.ndarray, heads: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Sorted pairs as steps between contexts, lengths of runs, and steps between successors."""
    return _pack(np.diff(context[heads], prepend=0)), _pack(np.diff(np.append(heads, len(context))).astype(np.int32)), _pack(T.rises(successor, heads))


def _unlisted(contexts: bytes, runs: bytes, successors: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, successor, lengths of runs)"""
    n = _unpack(runs, np.int32).astype(np.int64)
    heads = np.cumsum(n) - n
    return np.repeat(np.cumsum(_unpack(contexts, np.int64)), n), T.of_rises(_unpack(successors, np.int64), heads, n), n


_REQUEST = "shard long, batch long, contexts binary, runs binary, successors binary"


def _requests(counted: DataFrame, bits: int, sums: tuple, train: bool) -> DataFrame:
    """The pairs of each batch for each shard; to train, those of training documents with their counts, their contexts' counts and their words' probabilities."""
    schema = _REQUEST + ", seen binary, totals binary, codes binary" * train

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for batch, held, sizes, tokens, numbers, counts in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                ids, c = _unpack(numbers, np.int64), _unpack(counts, np.int64)
                t, (_, n, training) = _unpack(tokens, np.int32).astype(np.int64), _training(held, sizes)
                p = _Pairs(t, n, ids, c, int(t[n[0] - 1]), bits, training if train else None)
                code = T.quantised(_Unigrams(c, sums).log10p)[p.second] if train else None
                out: list[list] = [[] for _ in schema.split(", ")]
                for shard, s, heads in p.slices():
                    more = (_pack(p.seen[s].astype(np.int32)), _pack(c[p.first[s][heads]]), _pack(code[s])) if train else ()
                    for column, value in zip(out, (shard, batch, *_listed(p.context[s], p.successor[s], heads), *more), strict=True):
                        column.append(value)
                named = [x.split() for x in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if k == "long" else pa.binary()) for x, (_, k) in zip(out, named, strict=True)], names=[x for x, _ in named])

    return counted.select("batch", "held", "sizes", "tokens", "numbers", "counts").mapInArrow(tidied(run), schema)


def _built(table: pa.Table) -> pa.Table:
    """A shard's levels from the pairs of all batches."""
    parts = []
    for contexts, runs, successors, seen, totals, codes in zip(*(table[c].to_pylist() for c in ("contexts", "runs", "successors", "seen", "totals", "codes")), strict=True):
        context, successor, n = _unlisted(contexts, runs, successors)
        parts.append((context, successor, _unpack(seen, np.int32), np.repeat(_unpack(totals, np.int64), n), _unpack(codes, np.uint8)))
    context, successor, seen, total, code = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    order = np.lexsort((successor, context))
    context, successor = context[order], successor[order]
    heads = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (successor[1:] != successor[:-1])]))
    count = np.add.reduceat(seen[order].astype(np.int64), heads)
    own = order[heads]
    p = (count + KAPPA * 10.0 ** T.restored(code[own])) / (total[own] + KAPPA)
    body = T.Trie.build(context[heads], successor[heads], T.quantised(np.log10(p))).to_bytes()
    give_back()
    return pa.table({"shard": table["shard"].slice(0, 1), "levels": pa.array([body], pa.binary())})


def _answered(requests: pa.Table, levels: pa.Table) -> pa.Table:
    """A code for each pair that the batches ask a shard for, from its mapped levels."""
    trie = T.Trie.mapped(levels["levels"][0].as_py()) if levels.num_rows else None
    replies = []
    for contexts, runs, successors in zip(*(requests[c].to_pylist() for c in ("contexts", "runs", "successors")), strict=True):
        context, successor, _ = _unlisted(contexts, runs, successors)
        replies.append(_pack(trie.search(context, successor) if trie else np.zeros(len(context), np.uint8)))
    give_back()
    return pa.table({"batch": requests["batch"], "shard": requests["shard"], "reply": pa.array(replies, pa.binary())})


def _scored(counted: DataFrame, key: str, kind: str, bits: int, sums: tuple) -> DataFrame:
    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            ids = b.column(0)
            for i, (held, sizes, tokens, numbers, counts, answers) in enumerate(zip(*(b.column(j).to_pylist() for j in range(1, 7)), strict=True)):
                c, t, (h, n, _) = _unpack(counts, np.int64), _unpack(tokens, np.int32).astype(np.int64), _training(held, sizes)
                words, pairs = _Unigrams(c, sums), _Pairs(t, n, _unpack(numbers, np.int64), c, int(t[n[0] - 1]), bits)
                codes = np.concatenate([_unpack(r["reply"], np.uint8) for r in sorted(answers or (), key=lambda r: r["shard"])] or [np.zeros(0, np.uint8)])
                p = words.log10p[t] + np.log10(KAPPA / (pairs.total + KAPPA))
                paired = np.flatnonzero(pairs.number >= 0)
                code = codes[pairs.number[paired]]
                p[paired[code > 0]] = T.restored(code[code > 0])
                base = np.log10((c[t] + 1.0) / (words.n + words.v + 1.0))
                begin = np.cumsum(n) - n
                columns = [pa.array(h), pa.array(n), pa.array(np.add.reduceat((c[t] > 0).astype(np.int64), begin)), pa.array(np.full(len(n), words.n, np.int64)), pa.array(np.add.reduceat(base, begin)), pa.array(np.add.reduceat(p, begin))]
                yield pa.RecordBatch.from_arrays([ids[i].values, *columns], names=[key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return counted.select("ids", "held", "sizes", "tokens", "numbers", "counts", "answers").mapInArrow(tidied(run), f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _bits(entries: int, each: int) -> int:
    return max(5, int(np.ceil(np.log2(max(1, entries / each)))))


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", modulus: int = 7, out: int = 2) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row; rows with crc32(key) mod `modulus` = `out` don't train."""
    kind = docs.schema[key].dataType.simpleString()
    given = docs.select(F.col(key), (id_remainder(key, modulus) == out).alias("held"), text_column(text).alias("__text"))
    batches = staged(_batches(given, key), "batches")
    tokens, words = (x or 0 for x in batches.agg(F.sum("n"), F.sum("distinct")).first())
    word_bits, bits = _bits(words, SHARD_WORDS), _bits(tokens, SHARD_TOKENS)

    reply = "batch long, shard long, numbers binary, counts binary"
    told = staged(_word_requests(batches, word_bits).groupBy("shard").applyInArrow(_word_level(word_bits), reply), "words")
    each = sorted((r["shard"], np.frombuffer(r["counts"], np.int64)) for r in told.filter("batch = -1").select("shard", "counts").collect())
    firsts = dict(zip((s for s, _ in each), np.cumsum([0, *(int(x[1]) for _, x in each)]).tolist()))
    sums = tuple(np.sum([x for _, x in each] or [[0] * 4], axis=0).tolist())
    counted = staged(_counted(batches, told.filter("batch >= 0"), firsts), "counted")
    for old in (batches, told):  # all that is still asked of them is in `counted`
        discard(old)
    tries = staged(_requests(counted, bits, sums, True).groupBy("shard").applyInArrow(_built, "shard long, levels binary"), "levels")
    asked = _requests(counted, bits, sums, False).groupBy("shard").cogroup(tries.groupBy("shard"))
    answered = staged(asked.applyInArrow(_answered, "batch long, shard long, reply binary"), "answers")
    discard(tries)
    answers = answered.groupBy("batch").agg(F.collect_list(F.struct("shard", "reply")).alias("answers"))
    return _scored(counted.join(answers, "batch", "left"), key, kind, bits, sums)
