"""Operator 3: near-duplicate documents by Fast Similarity Sketching, banding and exact verification.

Documents with equal shingle sets form one class; sketches, buckets, links and components are over classes, so
a group of exact copies of any size is one node. Classes that share a band meet in a bucket. A bucket never
emits all its pairs: its members are compared with a few leaders first, true links (confirmed on the full
sets) are merged into components, and only members of different components in one bucket are compared
further: with other leaders, and then, where few are outside the bucket's largest component, with all
others. Where many are, an exact prefix filter leaves only pairs that can link. No pair is tried twice, and none of one bucket is left
that is neither in one component, nor compared, nor ruled out, so nothing is lost to hot buckets.

32 bands of 4 coordinates miss a pair at the threshold of 0.75 with probability below 1e-5. Before full sets
are fetched, a pair is dropped if its sketches agree so little that a resemblance of 0.75 is over five
standard deviations away.

Defined results: null text or no words: n_shingles 0, own component. A null id takes part and never names a
component unless all ids of its component are null. Repeated rows get a row each. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm import shingles as S
from fieldglass.llm.common import over_text, partitions, staged, text_column, tidied
from fieldglass.llm.components import components

BINS, ROWS = 128, 4
#: Agreeing coordinates (of BINS, 8 bits each) under which a pair can't reach the threshold, with five sigma to spare.
SIGMAS = 5.0
LEADERS, ROUNDS = 4, 1
#: Buckets with more members outside their largest component are compared by prefixes, not by pairs; cells of the shingle order, and parts they are summed in.
FEW, ORDER, PARTS = 8, 1 << 20, 256


def signatures(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, also: tuple[str, ...] = ()) -> DataFrame:
    """(key, also..., n, node, bands, sketch) for each row: set size, class of equal sets, band keys, low bytes of the sketch."""
    own = [key, *also]
    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in own) + ", n long, node long, bands array<long>, sketch binary"

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, nodes, bands, sketches = [], [], [], []
        place = np.arange(BINS // ROWS, dtype=np.uint64)
        for text in batch.column(len(own)).to_pylist():
            h = S.shingles(text, size)
            n.append(len(h))
            if len(h):
                sk = S.sketch(h, BINS)
                key_of = place.copy()
                for c in sk.reshape(-1, ROWS).T:
                    key_of = S.mixed(key_of + c)
                nodes.append(S.set_id(h))
                bands.append(key_of.view(np.int64))
                sketches.append(S.mixed(sk).astype(np.uint8).tobytes())
            else:
                nodes.append(None)
                bands.append(None)
                sketches.append(None)
        return pa.RecordBatch.from_arrays([*batch.columns[: len(own)], pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=[*own, "n", "node", "bands", "sketch"])

    return over_text(df.select(*own, text_column(text).alias("__text")), step, schema, "__text")


def _sets(df: DataFrame, text: str, size: int) -> DataFrame:
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [S.shingles(t, size) for t in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array([S.set_id(h) if len(h) else None for h in found], pa.int64()), pa.array([h.view(np.int64) for h in found], pa.list_(pa.int64()))], names=["node", "members"])

    return over_text(df.select(F.col(text).alias("__text")), step, "node long, members array<long>", "__text")


class _Links:
    """Confirms pairs of classes on their full sets."""

    def __init__(self, sketches: DataFrame, sets: DataFrame, percent: int):
        self.sketches, self.sets, self.percent = sketches, sets, percent
        j = percent / 100
        self.least = int(np.floor(BINS * j - SIGMAS * np.sqrt(BINS * j * (1 - j))))

    def likely(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose sketches and set sizes leave the threshold possible."""
        least, percent = self.least, self.percent

        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                one, two = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, BINS) for i in (2, 3))
                yield batch.filter(pa.array((one == two).sum(axis=1) >= least)).select([0, 1])

        side = {c: self.sketches.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "ab"}
        fitting = pairs.join(side["a"], "a").join(side["b"], "b").filter(_fits("na", "nb", percent))
        return fitting.select("a", "b", "sa", "sb").mapInArrow(tidied(run), "a long, b long")

    def confirmed(self, likely: DataFrame) -> DataFrame:
        one = self.sets.select(F.col("node").alias("a"), F.col("members").alias("ma"))
        two = self.sets.select(F.col("node").alias("b"), F.col("members").alias("mb"))
        both = likely.join(one, "a").join(two, "b").withColumn("shared", F.size(F.array_intersect("ma", "mb")))
        return both.filter(F.col("shared") * 100 >= (F.size("ma") + F.size("mb") - F.col("shared")) * self.percent).select("a", "b")


def _ordered(x, y):
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _main(rows: DataFrame, by: str) -> DataFrame:
    """Rows (by, node, component) of keys with more than one component, with the key's largest one and the number of nodes outside it."""
    sizes = rows.groupBy(by, "component").agg(F.count(F.lit(1)).alias("n"))
    keys = sizes.groupBy(by).agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    return rows.join(keys.select(by, F.col("top.component").alias("main"), (F.col("all") - F.col("top.n")).alias("others")), by)


def _fits(one: str, two: str, percent: int):
    """Can sets of two sizes reach the threshold?"""
    return F.least(one, two) * 100 >= F.greatest(one, two) * percent


def _across(rows: DataFrame, by: str, percent: int, placed: bool = False) -> DataFrame:
    """Pairs of nodes of one key in different components whose sizes n leave a link possible; one is outside the key's largest component.

    With `placed`, rows also have the key's place among a node's ordered shingles. If the key is the first that two
    nodes share, they share no more than what follows it in either, which must suffice for a link.
    """
    more = ["n", "place"] if placed else ["n"]
    one = rows.filter("component != main").select(by, F.col("node").alias("x"), F.col("component").alias("cx"), *(F.col(c).alias(f"x_{c}") for c in more))
    two = rows.select(by, F.col("node").alias("y"), F.col("component").alias("cy"), *(F.col(c).alias(f"y_{c}") for c in more))
    met = (one[by] == two[by]) & (F.col("cx") != F.col("cy")) & _fits("x_n", "y_n", percent)
    if placed:
        met &= F.least(F.col("x_n") - F.col("x_place"), F.col("y_n") - F.col("y_place")) * (100 + percent) >= (F.col("x_n") + F.col("y_n")) * percent
    return one.join(two, met).select(*_ordered("x", "y")).distinct()


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(token, node, component, n, place): the tokens by which a class can meet others that link with it (exact prefix filtering).

    Shingles are put in one fixed order, rare ones first. Classes of sizes a and b that link share p/(100+p) of a + b
    shingles at least, so they share one of the first a - that + 1 of a's. As that depends on the other's size, sizes
    are cut into bands of 5 percent, and tokens are a shingle with a pair of bands. The order's counts are kept in a
    vector of ORDER cells, whatever the data: cells shared by chance make the order less sharp but never lose a pair.
    """

    def counted(batches):
        total = np.zeros(ORDER, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy().view(np.uint64) >> np.uint64(44), minlength=ORDER)
        for part, counts in enumerate(total.reshape(PARTS, -1)):  # one row for each part of the cells, however many cells it has
            cell = np.flatnonzero(counts)
            if len(cell):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([cell.astype(np.int32).tobytes()]), pa.array([counts[cell].tobytes()])], names=["part", "cells", "counts"])

    def summed(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, cells, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                totals.setdefault(part, np.zeros(ORDER // PARTS, np.int64))[np.frombuffer(cells, np.int32)] += np.frombuffer(counts, np.int64)
        for part, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([total.tobytes()])], names=["part", "counts"])

    parts = sets.select("members").mapInArrow(tidied(counted), "part long, cells binary, counts binary").repartition(partitions(sets.sparkSession), "part")
    frequency = np.zeros((PARTS, ORDER // PARTS), np.int64)
    for row in parts.mapInArrow(tidied(summed), "part long, counts binary").collect():  # PARTS rows, 8 MB in all
        frequency[row["part"]] = np.frombuffer(row["counts"], np.int64)
    frequency = frequency.ravel()
    shipped = sets.sparkSession.sparkContext.broadcast(frequency)

    def run(batches):
        share = percent / (100 + percent)
        band = lambda n: int(np.floor(np.log(n) / np.log(1.05)))
        least = lambda b: max(1, int(np.ceil(1.05**b - 1e-9)))
        for batch in batches:
            tokens, nodes, comps, sizes, places = [], [], [], [], []
            for node, component, members in zip(*batch.columns, strict=True):
                h = members.values.to_numpy().view(np.uint64)
                f = shipped.value[h >> np.uint64(44)]
                order = np.lexsort((h, f))
                h, f, n = h[order], f[order], len(h)
                own = band(n)
                for other in range(band(max(1, n * percent // 100)), band(-(-n * 100 // percent)) + 1):
                    shared = int(np.ceil(share * (n + least(other)) - 1e-9))
                    place = np.flatnonzero(f[: max(0, n - shared + 1)] > 1)  # what only this class has meets no other
                    first = h[place]
                    tokens.append(S.mixed(first + np.uint64(min(own, other) * 4096 + max(own, other))).view(np.int64))
                    nodes.append(np.full(len(first), node.as_py()))
                    comps.append(np.full(len(first), component.as_py()))
                    sizes.append(np.full(len(first), n))
                    places.append(place)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (tokens, nodes, comps, sizes, places)], names=["token", "node", "component", "n", "place"])

    return staged(sets.select("node", "component", "members").mapInArrow(tidied(run), "token long, node long, component long, n long, place long"), "prefixes")


def _labelled(df: DataFrame, key: str, text: str, size: int, percent: int, also: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The rows' signatures, with the columns `also`, and (node, component) of the classes that link with others."""
    given = df.select(F.col(key), *also, text_column(text).alias("__text"))
    signed = staged(signatures(given, key, "__text", size, also), "signatures")
    banded = signed.filter(F.col("node").isNotNull()).select("node", "n", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high")
    rows = staged(banded.join(shared, "bucket").select("bucket", "node", "n", "low", "high").distinct(), "buckets")
    nodes = rows.select("node").distinct()
    held = signed.filter(F.col("node").isNotNull())
    meeting = staged(held.join(nodes, "node", "left_semi").groupBy("node").agg(F.min(key).alias("__first"), F.min("n").alias("n"), F.min("sketch").alias("sketch")), "meeting")

    # The members of each bucket against its smallest and largest class.
    pairs = rows.select("node", F.explode(F.array("low", "high")).alias("leader")).filter("node != leader").select(*_ordered("node", "leader")).distinct()
    links, tried = _Links(meeting, meeting, percent), staged(pairs, "tried")
    likely = staged(links.likely(tried), "pairs")

    # Full sets are fetched for classes of buckets where something may link.
    texts = given.withColumnRenamed(key, "__own").join(meeting.select("__first").hint("shuffle_hash"), F.col("__own").eqNullSafe(F.col("__first")), "left_semi")
    links.sets = staged(_sets(texts, "__text", size).join(nodes, "node", "left_semi"), "sets")
    found = staged(links.confirmed(likely), "links")
    label = staged(components(found), "components")

    for step in range(ROUNDS + 1):
        open_rows = rows.select("bucket", "node", "n").join(label, "node", "left").select("bucket", "node", "n", F.coalesce("component", "node").alias("component"))
        if step < ROUNDS:
            order = [F.xxhash64("node", F.lit(step * LEADERS + i)) for i in range(LEADERS)]
            mixed = open_rows.groupBy("bucket").agg(F.min("component").alias("__low"), F.max("component").alias("__high"), *(F.min(F.struct(o.alias("o"), "node", "n", "component")).alias(f"l{i}") for i, o in enumerate(order))).filter("__low < __high")
            rows = staged(open_rows.join(mixed, "bucket").select("bucket", "node", "n", "component", F.array(*(F.struct(F.col(f"l{i}.node").alias("node"), F.col(f"l{i}.n").alias("n"), F.col(f"l{i}.component").alias("component")) for i in range(LEADERS))).alias("leaders")), "open")
            if rows.isEmpty():
                break
            led = rows.select("node", "n", "component", F.explode("leaders").alias("l")).filter("component != l.component")
            pairs = led.filter(_fits("n", "l.n", percent)).select(*_ordered("node", "l.node")).distinct()
        else:
            rows = staged(open_rows, "open")
            pairs = _across(_main(rows, "bucket").filter(F.col("others") <= FEW), "bucket", percent)
            many = _main(rows, "bucket").filter(F.col("others") > FEW).select("node", "component").distinct()
            pairs = pairs.union(_across(_main(_prefixes(many.join(links.sets, "node"), percent), "token"), "token", percent, placed=True)).distinct()
        pairs = staged(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")  # a pair that was tried isn't tried again
        tried = tried.union(pairs)
        new = staged(links.confirmed(links.likely(pairs)), "links")
        if new.isEmpty():
            continue
        name = label.select("node", "component")
        ends = new.join(name.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(name.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
        merged = components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).filter("a != b").distinct())
        old = label.select("node", F.col("component").alias("c")).union(new.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(label, "node", "left_anti").select("node", F.col("node").alias("c")))
        label = staged(old.join(merged.select(F.col("node").alias("c"), "component"), "c", "left").select("node", F.coalesce("component", "c").alias("component")), "components")
    return signed, label


def linked(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """(key, n_shingles, component_id, kept) for each row of `df`."""
    signed, label = _labelled(df, key, text, size, percent)
    held = signed.filter(F.col("node").isNotNull())
    named = held.select("node", key).join(label, "node", "left").select(key, "node", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min(key).alias("component_id"))
    classes = named.groupBy("node", "component").agg(F.lit(1).alias("one")).join(least, "component").select("node", "component_id")
    out = signed.select(key, F.col("n").alias("n_shingles"), "node").join(classes, "node", "left")
    component = F.when(F.col("node").isNull(), F.col(key)).otherwise(F.col("component_id"))
    return out.select(key, "n_shingles", component.alias("component_id"), F.col(key).eqNullSafe(component).alias("kept"))


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """The rows of `df` without near duplicates: of each component one with the smallest id (null only where all are), then text hash.

    Rows without shingles are components of their own; rows equal in id and text count as one.
    """
    columns = df.columns
    hashed = df.withColumn("__hash", F.xxhash64(text_column(text)))
    signed, label = _labelled(hashed, key, text, size, percent, ("__hash",))
    texts = signed.groupBy(F.col(key).alias("__id"), F.col("__hash").alias("__own"), "node").agg(F.count(F.lit(1)).alias("__n"))
    named = texts.filter(F.col("node").isNotNull()).join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = named.groupBy("component").agg(F.min(F.struct(F.col("__id").isNull().alias("none"), "__id", "__own", "__n")).alias("first"))
    kept = first.select("first.__id", "first.__own", "first.__n").union(texts.filter(F.col("node").isNull()).select("__id", "__own", "__n"))
    left = hashed.join(kept.hint("shuffle_hash"), hashed[key].eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__own")))
    repeated = left.filter("__n > 1").groupBy(key, "__hash").agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("row"))
    return left.filter("__n = 1").select(*columns).unionByName(repeated.select("row.*"))
