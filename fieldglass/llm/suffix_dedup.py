"""Operator 7: removal of byte strings that repeat within or across documents.

A window is a string of `width` bytes; it repeats if it starts anywhere else in the corpus. Every byte covered by a
repeating window goes, or, with `keep_first`, by a window that starts earlier (smaller document id, then place).

1. Every window has an anchor (see suffixes.anchors); equal windows share it. Anchors are counted by hash, and
   those seen once can't belong to a repeating window.
2. For the others, the text around an anchor that its windows cover (its context, some 570 bytes) is cut out.
   Equal contexts are combined within a task before they move; a context that occurs twice repeats as a whole.
3. Different contexts of one anchor meet in one place, in order of first occurrence: their suffixes are ordered, and
   longest previous factors from previous and next smaller places tell which windows begin earlier too, longest
   next factors which begin later too.
4. An anchor with more than DIVIDE different contexts is divided: each piece holds GRID windows of the contexts that
   share it and meets only pieces with the same inner bytes; where more than DIVIDE different pieces do, their single
   windows are counted instead. So no group has to fit one task, and nothing is left out.
5. The runs found return to the documents by context, and the removed bytes are cut.

Contexts, pieces and texts are known by 128-bit digests: among 10^12 of them two different ones agree with a probability
of about 10^-15. Anchors are 64-bit hashes, but those only bring bytes together that are then compared.

Ids may repeat or be null; a null text is empty. Texts under `width` bytes stay as they
are. Equal texts with equal ids count as copies of each other, and with `keep_first` share the first's result.
Extra columns pass through; columns named like the outputs are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.llm import suffixes
from fieldglass.llm.common import chunks, discard, hidden, over_text, partitions, staged, text_column, tidied

#: Bytes of contexts whose suffixes are ordered at once.
BATCH = 1 << 20
#: An anchor with more different contexts than this is divided into pieces of GRID windows.
DIVIDE, GRID = 1_000, 16
#: Contexts that a task remembers as met, so that it gives their bytes once.
MET = 100_000


def _key(value: bytes) -> bytes:
    return xxhash.xxh3_128_digest(value)


def _buffer(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer() if x.is_valid else b"", np.uint8) for x in column.cast(pa.binary())]


def _anchor_rows(texts: DataFrame, width: int) -> DataFrame:
    """(anchor, digest, place, first, last) for each anchor of each text of at least `width` bytes."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [suffixes.anchors(x, width) for x in _buffer(batch.column(1))]
        sizes = [len(x[0]) for x in found]
        take = pa.array(np.repeat(np.arange(len(sizes)), sizes))
        parts = [pa.array(np.concatenate([f[i] for f in found])) for i in range(4)]
        return pa.RecordBatch.from_arrays([parts[0], batch.column(0).take(take), *parts[1:]], names=["anchor", "digest", "place", "first", "last"])

    return over_text(texts, step, "anchor long, digest binary, place long, first long, last long", "__text")


def _rows(columns: list[list], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    named = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, named, strict=True)], names=[n for n, _ in named])


def _contexts(texts: DataFrame, width: int) -> DataFrame:
    """(anchor, context, digest, place, windows, first, bytes) for each wanted anchor; bytes only where the task first met that context."""
    schema = "anchor long, context binary, digest binary, place long, windows long, first long, bytes binary"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for batch in chunks(batches, "__text"):
            rows: list[list] = [[] for _ in range(7)]
            for digest, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for a in wanted:
                    cut = text[a["first"] : a["last"] + width]
                    context = _key(cut + (a["place"] - a["first"]).to_bytes(4, "big"))
                    fresh = context not in met
                    if fresh:
                        if len(met) >= MET:
                            met.clear()
                        met.add(context)
                    for row, value in zip(rows, (a["anchor"], context, digest, a["place"], a["last"] - a["first"] + 1, a["first"], cut if fresh else None), strict=True):
                        row.append(value)
            yield _rows(rows, schema)

    return texts.mapInArrow(tidied(run), schema)


def _pieces(contexts: DataFrame, width: int) -> DataFrame:
    """(group, piece, context, at, bytes) for contexts (anchor, context, lead, bytes): pieces of GRID windows, grouped by their inner bytes."""
    schema = "group binary, piece binary, context binary, at long, bytes binary"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(5)]
            for anchor, context, lead, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                windows = len(value) - width + 1
                at = 0
                while at < windows:
                    cell = (lead - at) // GRID  # windows by their distance to the anchor, on a fixed grid
                    end = min(windows, lead - cell * GRID + 1)
                    inner = value[max(0, lead - cell * GRID) : lead - (cell + 1) * GRID + 1 + width]
                    own, body = anchor.to_bytes(8, "big", signed=True) + cell.to_bytes(4, "big"), value[at : end - 1 + width]
                    # equal bytes are one piece only where they lie alike on the grid
                    for row, x in zip(rows, (_key(inner + own), _key(body + own + (lead - at).to_bytes(4, "big")), context, at, body), strict=True):
                        row.append(x)
                    at = end
            yield _rows(rows, schema)

    return contexts.select("anchor", "context", "lead", "bytes").mapInArrow(tidied(run), schema)


def _windows(pieces: DataFrame, width: int) -> DataFrame:
    """(window, piece, start) for each window of pieces (group, piece, bytes); equal windows of one group have equal digests."""
    schema = "window binary, piece binary, start long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(3)]
            for piece, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for start in range(len(value) - width + 1):
                    for row, x in zip(rows, (_key(value[start : start + width]), piece, start), strict=True):
                        row.append(x)
            yield _rows(rows, schema)

    return pieces.select("piece", "bytes").mapInArrow(tidied(run), schema)


def _runs(groups: DataFrame, width: int, keep_first: bool) -> DataFrame:
    """(name, start, end) for each run of windows start..end of bodies (group, name, rank, bytes) that another body of the group has, or has at a lower rank."""
    schema = "name binary, start long, end long"

    def judged(rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        out: list[list] = [[], [], []]
        if rows:
            sizes = np.array([len(x[1]) for x in rows])
            begins = np.cumsum(sizes) - sizes
            windows = sizes - width + 1
            starts = np.repeat(begins - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
            owner = np.repeat(np.arange(len(rows)), windows)
            before, after = suffixes.previous_factors(np.frombuffer(b"".join(x[1] for x in rows), np.uint8), starts, width, both=not keep_first)
            hit = np.flatnonzero(np.maximum(before, after) >= width)
            if len(hit):
                new = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (owner[hit][1:] != owner[hit][:-1])])
                first, last = hit[new], hit[np.concatenate([new[1:], [True]])]
                base = begins[owner[first]]
                out = [[rows[o][0] for o in owner[first].tolist()], (starts[first] - base).tolist(), (starts[last] - base).tolist()]
        return _rows(out, schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple[bytes, bytes]] = []
        group: list[tuple[bytes, bytes]] = []
        size, now = 0, None
        for batch in batches:
            for g, name, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != now:
                    if len(group) > 1:
                        size += sum(len(v) for _, v in group)
                        ready += group
                    group, now = [], g
                    if size >= BATCH:
                        yield judged(ready)
                        ready, size = [], 0
                group.append((name, value))
        yield judged(ready + group if len(group) > 1 else ready)

    dealt = groups.repartition(partitions(groups.sparkSession), "group").sortWithinPartitions("group", "rank", "name")
    return dealt.select("group", "name", "bytes").mapInArrow(tidied(run), schema)


def _of_divided(bodies: DataFrame, width: int, keep_first: bool) -> DataFrame:
    """(name, start, end) as `_runs` gives them, for contexts (anchor, context, rank, lead, bytes) of anchors that have very many."""
    made = staged(_pieces(bodies, width).join(bodies.select("context", "rank"), "context"), "pieces")
    if made.isEmpty():
        return made.select(F.col("context").alias("name"), F.col("at").alias("start"), F.col("at").alias("end"))
    distinct = staged(made.groupBy("piece").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("rank"), F.min("group").alias("group"), F.min("bytes").alias("bytes")), "distinct")
    groups = staged(distinct.groupBy("group").agg(F.count(F.lit(1)).alias("pieces")).filter("pieces > 1"), "groups")
    met = staged(distinct.join(groups, "group").select("group", "piece", "rank", "bytes", "pieces"), "met")
    runs = _runs(met.filter(F.col("pieces") <= DIVIDE).select("group", F.col("piece").alias("name"), "rank", "bytes"), width, keep_first)

    windows = _windows(met.filter(F.col("pieces") > DIVIDE), width).join(met.select("piece", "rank"), "piece")
    counted = windows.groupBy("window").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("least")).filter("n > 1")
    single = windows.join(counted, "window").filter(F.col("rank") != F.col("least") if keep_first else F.lit(True))
    found = staged(runs.union(single.select(F.col("piece").alias("name"), "start", F.col("start").alias("end"))), "piece-runs")

    copied = made.join(distinct.select("piece", "n", F.col("rank").alias("least")), "piece").filter("n > 1")
    whole = (copied.filter(F.col("rank") != F.col("least")) if keep_first else copied).select("context", "at", (F.col("at") + F.octet_length("bytes") - width).alias("end"))
    part = made.join(found, F.col("piece") == F.col("name")).select("context", (F.col("at") + F.col("start")).alias("at"), (F.col("at") + F.col("end")).alias("end"))
    out = staged(whole.union(part).select(F.col("context").alias("name"), F.col("at").alias("start"), "end").distinct(), "divided-runs")
    for old in (made, distinct, groups, met, found):
        discard(old)
    return out


def _cut(batch: pa.RecordBatch, width: int, as_text: bool, own: list[str]) -> pa.RecordBatch:
    """Removes from each text the bytes its intervals of windows cover; a row marked loses everything. `own` names the columns of text, intervals and mark."""
    removed, spans, kept, sizes = [], [], [], []
    for text, intervals, whole in zip(batch.column(own[0]).cast(pa.binary()).to_pylist(), batch.column(own[1]).to_pylist(), batch.column(own[2]).to_pylist(), strict=True):
        sizes.append(len(text))
        if whole:
            removed.append(len(text))
            spans.append(1)
            kept.append(b"")
            continue
        parts, at, n = [], 0, 0
        for s, e in sorted((x["s"], x["e"] + width) for x in intervals or ()):
            if n and s <= at:
                at = max(at, e)
            else:
                parts.append(text[at:s])
                at, n = e, n + 1
        parts.append(text[at:])
        rest = b"".join(parts)
        removed.append(len(text) - len(rest))
        spans.append(n)
        kept.append(rest)
    names = [x for x in batch.schema.names if x not in own]
    rest = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
    added = [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), rest]
    return pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), *added], names=[*names, "n_bytes", "n_removed", "n_spans", "kept"])


def intervals(long: DataFrame, width: int, keep_first: bool) -> DataFrame:
    """(digest, intervals) for texts (digest, __text, __key) of at least `width` bytes: the windows s..e to remove."""
    rows = staged(_anchor_rows(long.select("digest", "__text"), width), "anchors")
    twice = staged(rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"), "twice")
    wanted = staged(rows.join(twice, "anchor").groupBy("digest").agg(F.collect_set(F.struct("anchor", "place", "first", "last")).alias("wanted")), "wanted")
    discard(rows)
    discard(twice)
    texts = long.select("digest", "__text").join(wanted.hint("shuffle_hash"), "digest").select("digest", "__text", "wanted")
    cut = staged(_contexts(texts, width), "contexts")
    discard(wanted)

    # Occurrences of each context; those of equal texts are counted, not listed.
    met = cut.groupBy("digest", "first", "place", "windows", "context", "anchor").agg(F.count(F.lit(1)).alias("n"))
    at = F.struct(F.lit(0).alias("place"))
    if keep_first:
        met = met.join(long.groupBy("digest").agg(F.min("__key").alias("owner")), "digest")
        at = F.struct(F.col("owner").isNull().alias("none"), "owner", "digest", "place")
    met = staged(met.withColumn("at", at), "occurrences")
    counted = staged(met.groupBy("context").agg(F.sum("n").alias("n"), F.min("at").alias("rank"), F.min("anchor").alias("anchor")), "counted")

    # Contexts of an anchor that has more than one go to suffix ordering. Both sides of each join are plain tables, so that hot anchors can be split.
    many = staged(counted.groupBy("anchor").agg(F.count(F.lit(1)).alias("contexts")).filter("contexts > 1"), "many")
    ranked = staged(counted.join(many, "anchor").select("context", "anchor", "rank", "contexts"), "ranked")
    given = cut.filter(F.col("bytes").isNotNull()).select("context", (F.col("place") - F.col("first")).alias("lead"), "bytes")
    once = given.join(ranked.select("context"), "context", "left_semi").groupBy("context").agg(F.min("lead").alias("lead"), F.min("bytes").alias("bytes"))
    bodies = staged(once.join(ranked, "context"), "bodies")
    for old in (cut, many, ranked):
        discard(old)
    whole = bodies.filter(F.col("contexts") <= DIVIDE).select(F.col("anchor").alias("group"), F.col("context").alias("name"), "rank", "bytes")
    divided = _of_divided(bodies.filter(F.col("contexts") > DIVIDE), width, keep_first)
    runs = staged(_runs(whole, width, keep_first).union(divided).select(F.col("name").alias("context"), "start", "end"), "runs")
    discard(bodies)

    # What is told of each context goes to all its occurrences in one join of two plain tables, which can be split where a context is hot.
    lists = runs.groupBy("context").agg(F.collect_list(F.struct("start", "end")).alias("runs"))
    verdicts = staged(counted.select("context", "n", "rank").join(lists, "context", "left"), "verdicts")
    all_of_it = (F.col("at") != F.col("rank")) if keep_first else (F.col("n") > 1)
    whole = F.array(F.struct(F.col("first").alias("s"), (F.col("first") + F.col("windows") - 1).alias("e")))
    part = F.transform("runs", lambda r: F.struct((F.col("first") + r["start"]).alias("s"), (F.col("first") + r["end"]).alias("e")))
    found = met.select("digest", "first", "windows", "context", "at").join(verdicts, "context").select("digest", F.when(all_of_it, whole).otherwise(part).alias("spans"))
    told = staged(found.filter("spans IS NOT NULL").groupBy("digest").agg(F.flatten(F.collect_list("spans")).alias("intervals")), "intervals")
    for old in (met, counted, runs, verdicts):
        discard(old)
    return told


def remove_repeats(df: DataFrame, width: int = 400, keep_first: bool = False, as_text: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds n_bytes, n_removed, n_spans (maximal removed runs) and kept to each row: the bytes that stay, or with `as_text` those of whole characters as text."""
    pre = hidden(df)
    given = df.drop("n_bytes", "n_removed", "n_spans", "kept").withColumn(f"{pre}text", text_column(text)).withColumn(f"{pre}digest", F.unhex(F.md5(f"{pre}text")))
    body, digest = F.col(f"{pre}text"), F.col(f"{pre}digest")
    long = given.filter(F.octet_length(body) >= width).select(digest.alias("digest"), body.alias("__text"), F.col(key).alias("__key"))
    told = intervals(long, width, keep_first).select(F.col("digest").alias(f"{pre}digest"), F.col("intervals").alias(f"{pre}intervals"))
    whole: Column = F.lit(False)
    if keep_first:  # a copy of a text that has a smaller id goes as a whole
        owners = long.groupBy(F.col("digest").alias(f"{pre}digest")).agg(F.min("__key").alias(f"{pre}owner"), F.count(F.lit(1)).alias(f"{pre}n")).filter(F.col(f"{pre}n") > 1)
        told = staged(told.join(owners.select(f"{pre}digest", f"{pre}owner", F.lit(True).alias(f"{pre}copied")), f"{pre}digest", "full"), "told")
        whole = F.coalesce(F.col(f"{pre}copied"), F.lit(False)) & ~F.col(key).eqNullSafe(F.col(f"{pre}owner"))
    joined = given.join(told.hint("shuffle_hash"), f"{pre}digest", "left").withColumn(f"{pre}all", whole)
    own = [f"{pre}{x}" for x in ("text", "intervals", "all")]
    out = joined.select(*[c for c in df.columns if c not in ("n_bytes", "n_removed", "n_spans", "kept")], *own)
    schema = out.drop(*own).schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "string" if as_text else "binary")
    return over_text(out, lambda batch: _cut(batch, width, as_text, own), schema, own[0])
