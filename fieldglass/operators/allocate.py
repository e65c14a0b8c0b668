"""Unique pseudonyms for distinct entities, set by set instead of row by row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldglass.functions import digest as D
from fieldglass.functions import scalar as S
from fieldglass.operators.staging import staged

ATTEMPTS = 256


class AllocationError(ValueError):
    """No free pseudonym within the attempts of a kind."""


def entities(df: DataFrame, column: str) -> DataFrame:
    """(key, original): distinct entities of a text column by canonical form; blanks are none."""
    c = F.col(column).cast("string")
    return df.filter(F.trim(c) != "").groupBy(D.canonical(c).alias("key")).agg(F.min(c).alias("original"))


#: Kinds whose pseudonyms can run out, and how many there are.
CAPACITY = {"address": 399 * len(D.STREETS)}


def _settled(open_: DataFrame, seed: bytes, used: DataFrame | None, kinds: list[str], attempts: int) -> DataFrame:
    """(kind, key, original, pseudonym, attempt), by rounds of proposals for all kinds at once."""
    done = []
    for attempt in range(attempts):
        h = D.entity_digest(seed, F.col("kind"), F.col("original"), attempt)
        named = F.lit(None).cast("string")
        for kind in kinds:
            named = F.when(F.col("kind") == kind, D.candidate(kind, F.col("original"), F.col("h"), attempt)).otherwise(named)
        proposed = staged(open_.withColumn("h", h).withColumn("pseudonym", named).drop("h").withColumn("form", F.lower("pseudonym")), "proposed")
        first = proposed.groupBy("kind", "form").agg(F.min("key").alias("key"))  # combined within tasks, however many ask for one form
        if used is not None:
            first = first.join(used, ["kind", "form"], "left_anti")
        done.append(staged(proposed.join(first, ["kind", "form", "key"]).select("kind", "key", "original", "pseudonym", F.lit(attempt).alias("attempt")), "settled"))
        open_ = proposed.join(done[-1].select("kind", "key").hint("merge"), ["kind", "key"], "left_anti").select("kind", "key", "original")
        kinds = [r[0] for r in open_.select("kind").distinct().collect()]
        if not kinds:
            return reduce(DataFrame.union, done)
        taken = done[-1].select("kind", F.lower("pseudonym").alias("form"))
        used = taken if used is None else used.union(taken)
    raise AllocationError(f"no free pseudonym after {attempts} attempts")


def _numbered(found: DataFrame, seed: bytes, private: bool, taken: DataFrame | None) -> DataFrame:
    """IPv4 addresses (key, original) at the first free place from their digest's on, in one pass over at most as many rows as there are places.

    Places that are free are numbered; entities in the order of their own place take the next number from it on (a
    running maximum), and those that run over the end take the numbers left at the beginning.
    """
    spark, size = found.sparkSession, D.PRIVATE_IPV4 if private else D.PUBLIC_IPV4
    digest = D.entity_digest(seed, "ip_address", F.col("original"), 0)
    at = spark.range(size).select(F.col("id").alias("place"), D.ip_address_at(F.col("id"), private).alias("pseudonym"))
    gone = (taken if taken is not None else spark.createDataFrame([], "pseudonym string")).select("pseudonym", F.lit(1).alias("gone")).distinct()
    if found.count() + at.join(gone, "pseudonym").count() > size:
        raise AllocationError(f"more than {size} {'private' if private else 'public'} addresses")
    every = Window.orderBy("place")
    places = at.join(gone, "pseudonym", "left").withColumn("free", F.coalesce(F.lit(1) - F.col("gone"), F.lit(1))).withColumn("number", F.sum("free").over(every) - F.col("free"))
    free = staged(places.filter("free = 1").select("number", "place", "pseudonym"), "free")
    asked = found.withColumn("place", D.number(digest, 0, 2) % size).join(places.select("place", "number"), "place").withColumn("i", F.row_number().over(Window.orderBy("number", "key")))
    put = asked.withColumn("number", F.col("i") + F.max(F.col("number") - F.col("i")).over(Window.orderBy("i"))).drop("i")
    fits = staged(put.join(free.select("number", F.col("place").alias("got"), "pseudonym"), "number", "left"), "placed")
    inside = fits.filter(F.col("got").isNotNull())
    left = free.join(inside.select("number"), "number", "left_anti").withColumn("turn", F.row_number().over(Window.orderBy("number")))
    over = fits.filter(F.col("got").isNull()).select("key", "original", "place").withColumn("turn", F.row_number().over(Window.orderBy("place", "key")))
    wrapped = over.join(left.select("turn", F.col("place").alias("got"), "pseudonym"), "turn")
    shape = ["key", "original", "pseudonym", ((F.col("got") - F.col("place") + size) % size).cast("int").alias("attempt")]
    return inside.select(*shape).union(wrapped.select(*shape))


def allocate_kinds(found: DataFrame, seed: bytes, taken: DataFrame | None = None, attempts: int = ATTEMPTS, kinds: list[str] | None = None) -> DataFrame:
    """(kind, key, original, pseudonym, attempt) for each entity (kind, key, original), as `allocate` for each kind; `taken` has (kind, pseudonym).

    Where `kinds` are given and none of them can run out, nothing is counted first.
    """
    found, counts = found.select("kind", "key", "original"), dict.fromkeys(kinds or (), 0)
    if kinds is None or any(k in CAPACITY or k == "ip_address" for k in kinds):
        found = staged(found, "wanted")
        counts = {r["kind"]: r["n"] for r in found.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    for kind, n in counts.items():
        if n > CAPACITY.get(kind, n):
            raise AllocationError(f"{n} entities of kind {kind}, and {CAPACITY[kind]} pseudonyms")
    four = (F.col("kind") == "ip_address") & ~F.col("original").contains(":")
    used = None if taken is None else taken.select("kind", F.lower("pseudonym").alias("form")).distinct()
    out = _settled(found.filter(~four), seed, used, sorted(counts), attempts)
    if "ip_address" in counts:
        private = D.is_private_ipv4(F.col("original"))
        old = None if taken is None else taken.filter("kind = 'ip_address'").select("pseudonym")
        for inside in (True, False):
            own = found.filter(four & (private if inside else ~private)).select("key", "original")
            out = out.unionByName(_numbered(own, seed, inside, old).withColumn("kind", F.lit("ip_address")))
    return out.select("kind", "key", "original", "pseudonym", "attempt")


def allocate(found: DataFrame, kind: str, seed: bytes, taken: DataFrame | None = None, attempts: int = ATTEMPTS) -> DataFrame:
    """(key, original, pseudonym, attempt) for each entity (key, original); pseudonyms differ in any case from each other and from `taken`.

    In each round every open entity proposes; of equal proposals the smallest key's wins, the others go to the next
    attempt with a large keyed suffix. Almost all are settled after the first two rounds. IPv4 addresses are placed at once.
    Where there are fewer pseudonyms than entities that is an error before any round. The result depends on the set of
    entities alone, not on their order, and entries given before are never changed.
    """
    old = None if taken is None else taken.select(F.lit(kind).alias("kind"), "pseudonym")
    return allocate_kinds(found.withColumn("kind", F.lit(kind)), seed, old, attempts, [kind]).drop("kind")


def composite_email(df: DataFrame, column: str, users: DataFrame, domains: DataFrame) -> DataFrame:
    """Adds the pseudonym of an address from those of its user and its domain, so that parts agree everywhere."""
    user, domain = S.split_email(F.lower(F.trim(F.col(column))))
    u = users.select(F.col("key").alias("__u"), F.col("pseudonym").alias("__pu"))
    d = domains.select(F.col("key").alias("__d"), F.col("pseudonym").alias("__pd"))
    joined = df.withColumn("__user", user).withColumn("__domain", domain).join(u, F.col("__user") == F.col("__u"), "left").join(d, F.col("__domain") == F.col("__d"), "left")
    return joined.withColumn("pseudonym", F.concat("__pu", F.lit("@"), "__pd")).drop("__user", "__domain", "__u", "__pu", "__d", "__pd")


#: Public suffixes of two labels.
COMPOUND_SUFFIXES = "co.uk com.au co.jp com.br co.nz co.za com.cn com.sg com.mx com.tr co.in com.ar".split()


def split_subdomain(c):
    """(sub, base) of a domain: base is the last two labels, three after a compound suffix; both empty without a sub."""
    parts = F.split(F.lower(F.regexp_replace(c, r"\.$", "")), r"\.")
    n = F.size(parts)
    base = F.when(F.array_join(F.slice(parts, F.greatest(n - 1, F.lit(1)), 2), ".").isin(COMPOUND_SUFFIXES), 3).otherwise(2)
    has = (n >= 3) & (n > base)
    return F.when(has, F.array_join(F.slice(parts, F.lit(1), F.greatest(n - base, F.lit(0))), ".")).otherwise(""), F.when(has, F.array_join(F.slice(parts, F.greatest(n - base + 1, F.lit(1)), base), ".")).otherwise("")
