"""Operator 1: document fingerprints as bottom-k sketches of shingle hashes, in DataFrame functions only.

A sketch is the sorted array of the K smallest distinct 64-bit hashes of a text's shingles of five words (white-space
separated, lower-cased; a text of fewer words is one shingle, one without words has an empty sketch). Sketches of parts
merge into the sketch of the whole, and two sketches estimate resemblance, containment and distinct shingle counts.
With fewer than K shingles the sketch is the whole set and every estimate is exact.

Null texts are empty texts. Two empty sketches resemble each other fully, an empty and another one not at all. Repeated
rows get equal results. `with_next` orders rows by id (null first), equal ids by a hash of their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldglass.llm.common import text_column

K, WORDS = 128, 5
#: Rows in a run of neighbouring ids, splits of the id range by quantiles, and runs that one task puts in order.
RUN, SPLITS, RUNS = 2_048, 64, 4_096
_LOW = -(2**63)


def with_fingerprint(df: DataFrame, text: str, out: str, k: int = K) -> DataFrame:
    """Adds `out`, the sketch of each text."""
    words = F.array_remove(F.split(F.lower(F.col(text)), "[ \\t-\\r]+"), "")
    return (
        df.withColumn("__words", words)
        .withColumn(out, F.when(F.size("__words") == 0, F.array().cast("array<long>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size("__words") - (WORDS - 1), F.lit(1))), lambda i: F.xxhash64(F.slice("__words", i, WORDS)))))
        .withColumn(out, F.slice(F.sort_array(F.array_distinct(out)), 1, k))
        .drop("__words")
    )


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of what two sketches describe."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merged_by(df: DataFrame, by: str, sketch: str, k: int = K) -> DataFrame:
    """(by, sketch) per group of any size: hashes are combined before they move, and only the low hash ranges that can hold the k smallest are gathered."""
    hashes = df.select(F.col(by), F.explode(sketch).alias("h")).distinct().withColumn("range", F.shiftright("h", 46))
    counts = hashes.groupBy(by, "range").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    low = counts.withColumn("before", before).filter(F.col("before") < k).select(F.col(by).alias("__by"), F.col("range").alias("__range"))
    kept = hashes.join(low, F.col(by).eqNullSafe(F.col("__by")) & (F.col("range") == F.col("__range")), "left_semi")
    return kept.groupBy(by).agg(F.slice(F.sort_array(F.collect_list("h")), 1, k).alias(sketch))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated size of intersection over size of union: the share of the union's sketch that is in both."""
    union = merged(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(union))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else k - 1 over the k-th smallest hash as a share of its range."""
    share = (F.element_at(a, -1).cast("double") - F.lit(float(_LOW))) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has: intersection size over a's size, both estimated."""
    union = merged(a, b, k)
    shared = resemblance(a, b, k) * distinct_shingles(union, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    """A sketch as text: hexadecimal hashes joined by commas."""
    return F.array_join(F.transform(a, lambda x: F.hex(x)), ",")


def _runs(ids: DataFrame) -> tuple[DataFrame, Column]:
    """(first, before) for each run of neighbouring ids: its smallest id and the run that its row is also sent to; and the run of an id.

    Runs cut the id range at quantiles and evenly in between. The row that begins a run follows the last row of the run
    before it, and the first of all follows the last of all.
    """
    n = ids.agg(F.count(F.lit(1)), F.percentile_approx("__o", [i / SPLITS for i in range(SPLITS)], 10_000)).first()
    cuts = sorted({*(n[1] or [0])})
    each = max(1, -(-n[0] // (len(cuts) * RUN)))
    array = F.array(*(F.lit(c).cast("long") for c in cuts))
    at = F.greatest(F.size(F.filter(array, lambda c: c <= F.col("__o"))), F.lit(1))
    low = F.element_at(array, at)
    width = F.coalesce(F.element_at(F.array(*(F.lit(float(max(1, b - a))) for a, b in zip(cuts, [*cuts[1:], cuts[-1] + max(1, cuts[-1] - cuts[-2] if len(cuts) > 1 else 1)], strict=True))), at), F.lit(1.0))
    within = F.greatest(F.lit(0.0), F.least(F.floor((F.col("__o").cast("double") - low.cast("double")) / width * each), F.lit(each - 1))).cast("long")
    run = (at.cast("long") * each + within).alias("run")
    firsts = ids.select(run, "__o").groupBy("run").agg(F.min("__o").alias("first")).withColumn("block", F.floor(F.col("run") / RUNS))
    blocks = firsts.groupBy("block").agg(F.max("run").alias("last")).withColumn("before_block", F.lag("last").over(Window.orderBy("block"))).withColumn("whole", F.max("last").over(Window.partitionBy(F.lit(1))))
    inside = F.lag("run").over(Window.partitionBy("block").orderBy("run"))
    return firsts.join(blocks, "block").select("first", F.coalesce(inside, "before_block", "whole").alias("before")), run


def with_next(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """(key, text, sketch, next_text, next_sketch) for each row, the next row being that of the next larger id."""
    given = df.select(F.col(key), text_column(text).alias("text"), F.coalesce(F.col(key).cast("long"), F.lit(_LOW)).alias("__o"))
    firsts, run = _runs(given.select("__o"))
    marked = given.join(firsts, F.col("__o") == F.col("first"), "left").withColumn("run", run)
    own = F.struct(F.col("run"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("before").alias("run"), F.lit(True).alias("guest"))
    dealt = marked.withColumn("in", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, guest)))).select(key, "text", "__o", F.col("in.run").alias("run"), F.col("in.guest").alias("guest")).repartition("run")
    order = Window.partitionBy("run").orderBy("guest", "__o", "__h")
    ordered = with_fingerprint(dealt.withColumn("__h", F.xxhash64("text")), "text", "sketch", k)
    return ordered.withColumns({"next_text": F.lead("text").over(order), "next_sketch": F.lead("sketch").over(order)}).filter("NOT guest").drop("run", "guest", "__o", "__h")


def with_edit(df: DataFrame, k: int = K) -> DataFrame:
    """Adds n_chars, edited (the last quarter replaced by as much of the next text's beginning) and edited_sketch."""
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    return with_fingerprint(df.withColumn("n_chars", n.cast("long")).withColumn("edited", edited), "edited", "edited_sketch", k)
