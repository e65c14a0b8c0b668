"""Pseudonymisation of tables: entities are noted row by row, linked and allocated set-wise, and put in row by row.

What becomes of a row's values is told in `rows.Rewriter`. Its first run notes the simple entities (kind and text) and which
user names one row holds as one user; these are reduced to distinct ones within tasks before they move. User names that
rows link, directly or through others, share a pseudonym: the smallest name of their component is its root, so the result
depends on the set of values and not on row order. A person that a row shows with a user is named after that user. The second
run puts pseudonyms in. A mapping of at most SHIPPED entries is sent to the executors, and rows are not shuffled. A larger one
stays a table, as does what the vault gets of it: rows are then cut into chunks, each told which entities it asks for, and
meet the pseudonyms of these by chunk, so that an entity that every row has is joined once a chunk.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldglass.functions.scalar import normalised_field
from fieldglass.operators import allocate as A
from fieldglass.operators import paths, recognise, rows
from fieldglass.operators.policy import FieldPolicy
from fieldglass.operators.staging import hidden, spread, staged
from fieldglass.operators.vault import Vault, VaultError, canonical

_FAMILY = [
    (r"(account)(name|domain|displayname)$", r"\1"),
    (r"(user)(name|account|principalname|principal|domain|displayname)$", r"\1"),
    (r"loginname$", "user"),
    (r"(actor)principalname$", r"\1"),
    (r"(recipient)displayname$", r"\1"),
    (r"(emailaddress|mailaddress|email|upn|address|domain|displayname)$", ""),
]
#: Mappings that are gathered and sent to the executors at most; rows of a chunk, and about how many bytes they have.
SHIPPED, CHUNK_ROWS, CHUNK_BYTES = 50_000, 2_000, 4 << 20
_DEVICE = re.compile(r"device|computer|machine|workstation|hostname|dvc")


@lru_cache(4096)
def identity_family(field: str) -> str | None:
    """The family of an identity field: its name with what tells the member taken off."""
    name = normalised_field(field)
    for pattern, rest in _FAMILY:
        if re.search(pattern, name):
            family = re.sub(pattern, rest, name)
            family = re.sub(r"account$", "account", family)
            return "senderfrom" if family == "sender" else re.sub(r"(account|user)$", "", family) or "account"
    return None


def device_family(field: str) -> tuple[str, str] | None:
    """(family, member) of a device field: host, fqdn or domain."""
    name = normalised_field(field)
    if not _DEVICE.search(name):
        return None
    for pattern, member in ((r"fqdn$", "fqdn"), (r"(dnsdomain|domain)$", "domain"), (r"(devicename|computername|machinename|workstationname|hostname|name)$", "host")):
        if re.search(pattern, name):
            return re.sub(pattern, "", name), member
    return None


@dataclass(frozen=True)
class Options:
    """What is rewritten beyond the field policy: file names (off unless asked for) and configured phrases."""

    filenames: bool = False
    phrases: recognise.Phrases | None = None


def _holds_text(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds_text(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _holds_text(kind.elementType)
    if isinstance(kind, T.MapType):
        return _holds_text(kind.keyType) or _holds_text(kind.valueType)
    return isinstance(kind, (T.StringType, T.VarcharType, T.CharType))


def _plain(value, kind: T.DataType):
    """A value as objects, lists and texts; maps come as lists of pairs."""
    if value is None:
        return None
    if isinstance(kind, T.MapType):
        return {k: _plain(v, kind.valueType) for k, v in value}
    if isinstance(kind, T.ArrayType):
        return [_plain(v, kind.elementType) for v in value]
    if isinstance(kind, T.StructType):
        return {f.name: _plain(value[f.name], f.dataType) for f in kind.fields}
    return value


def _typed(value, kind: T.DataType):
    if value is None:
        return None
    if isinstance(kind, T.MapType):
        return [(k, _typed(v, kind.valueType)) for k, v in value.items()]
    if isinstance(kind, T.ArrayType):
        return [_typed(v, kind.elementType) for v in value]
    if isinstance(kind, T.StructType):
        return {f.name: _typed(value[f.name], f.dataType) for f in kind.fields}
    return value


def _rows(batch: pa.RecordBatch, fields: list[T.StructField]) -> list[dict]:
    columns = [[_plain(v, f.dataType) for v in batch.column(batch.schema.get_field_index(f.name)).to_pylist()] for f in fields]
    return [dict(zip((f.name for f in fields), values)) for values in zip(*columns, strict=True)]


def noted(df: DataFrame, policy: FieldPolicy, options: Options = Options()) -> DataFrame:
    """(kind, key, original, to): the distinct simple entities of all rows with kind and canonical key; links have kind `link` (two user names) or `named` (a person and a user name)."""
    fields = [f for f in df.schema.fields if _holds_text(f.dataType)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, str, str], str] = {}

            def note(kind: str, text: str, found=found) -> str:
                key = (kind, canonical(text), "")
                found[key] = min(text, found.get(key, text))
                return text

            def link(users: list[str], people: list[str], found=found) -> None:
                keys = sorted({canonical(u) for u in users})
                for u in users:
                    note("username", u)
                for p in people:
                    note("person", p)
                for k in keys[1:]:
                    found["link", keys[0], k] = ""
                for p in people:
                    if keys:
                        found["named", canonical(p), keys[0]] = ""

            rewriter = rows.Rewriter(policy, identity_family, note, link, options.filenames, options.phrases, masks=False)
            for row in _rows(batch, fields):
                rewriter.row(row)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.string()), pa.array([k[2] for k in found], pa.string())], names=["kind", "key", "original", "to"])

    each = df.select(*(F.col(f"`{f.name}`") for f in fields)).mapInArrow(run, "kind string, key string, original string, to string")
    return each.groupBy("kind", "key", "to").agg(F.min("original").alias("original")).select("kind", "key", "original", "to")


def aliases(links: DataFrame) -> DataFrame:
    """(key, root): the user names in links (key, to), each with the smallest of its component."""
    edges = links.select(F.col("key").alias("a"), F.col("to").alias("b"))
    both = staged(edges.union(edges.select("b", "a")).distinct(), "linked")
    label = staged(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("key"), F.least("a", "m").alias("root")), "roots")
    while True:
        near = both.join(label.select(F.col("key").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        after = staged(label.join(near.withColumnRenamed("a", "key"), "key").select("key", F.col("root").alias("was"), F.least("root", "near").alias("root")), "roots")
        if after.filter("was != root").isEmpty():
            return after.select("key", "root")
        label = after.select("key", "root")


def mapping(found: DataFrame, vault: Vault) -> DataFrame:
    """(kind, key, original, pseudonym) of every simple entity that was noted; entries of the vault are kept as they are."""
    spark = found.sparkSession
    simple, links, named = (found.filter(c) for c in (~F.col("kind").isin("link", "named"), F.col("kind") == "link", F.col("kind") == "named"))
    known = vault.table(spark)
    own = vault.keyed(simple)
    old = known.select(F.col("kind").alias("__kind"), F.col("key").alias("__key"), "pseudonym")
    told = staged(own.join(old, (F.col("kind") == F.col("__kind")) & (F.col("__vault") == F.col("__key")), "left").select("kind", "key", "original", "pseudonym"), "told")

    users = told.filter("kind = 'username'")
    rooted = users.withColumn("root", F.col("key")) if links.isEmpty() else users.join(aliases(links), "key", "left").withColumn("root", F.coalesce("root", "key"))
    groups = staged(rooted.groupBy("root").agg(F.countDistinct("pseudonym").alias("n"), F.min("pseudonym").alias("pseudonym"), F.min("original").alias("original")), "users")
    if not groups.filter("n > 1").isEmpty():
        raise VaultError("rows link users that have different pseudonyms")
    fresh = told.filter("pseudonym IS NULL")
    people = named.groupBy(F.col("key").alias("person")).agg(F.min("to").alias("user"))
    other = fresh.filter("kind != 'username'").join(people.select(F.lit("person").alias("kind"), F.col("person").alias("key")), ["kind", "key"], "left_anti")
    wanted = other.select("kind", "key", "original").union(groups.filter("n = 0").select(F.lit("username").alias("kind"), F.col("root").alias("key"), "original"))
    made = A.allocate_kinds(wanted, vault.seed, known.select("kind", "pseudonym"))
    users = rooted.join(groups.filter("n = 1").select("root", "pseudonym").union(made.filter("kind = 'username'").select("key", "pseudonym")).withColumnRenamed("pseudonym", "given"), "root").select(F.lit("username").alias("kind"), "key", "original", F.col("given").alias("pseudonym"))
    words = F.filter(F.split("given", r"[._-]+"), lambda w: w != "")
    shown = people.join(users.select(F.col("key").alias("user"), F.col("pseudonym").alias("given")), "user").select("person", F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(w.substr(F.lit(2), F.length(w))))), " ").alias("given"))
    persons = fresh.filter("kind = 'person'").join(shown, F.col("key") == F.col("person")).select("kind", "key", "original", F.col("given").alias("pseudonym"))
    rest = made.filter("kind != 'username'").select("kind", "key", "original", "pseudonym")
    settled = told.filter("pseudonym IS NOT NULL AND kind != 'username'")
    return settled.select("kind", "key", "original", "pseudonym").union(users).union(persons).union(rest)


def _rewritten(table: pa.RecordBatch | pa.Table, fields: list[T.StructField], rewriter: rows.Rewriter) -> list[pa.Array]:
    """The columns of a batch with the text fields rewritten."""
    changed = [rewriter.row(row) for row in _rows(table, fields)]
    columns = list(table.columns)
    for f in fields:
        i = table.schema.get_field_index(f.name)
        columns[i] = pa.array([_typed(r[f.name], f.dataType) for r in changed], table.column(i).type)
    return columns


def put_in(df: DataFrame, policy: FieldPolicy, told: dict[tuple[str, str], str], options: Options = Options()) -> DataFrame:
    """The rows with every entity replaced by what `told` has for its kind and canonical key; columns keep names, order and types."""
    fields = [f for f in df.schema.fields if _holds_text(f.dataType)]
    shipped = df.sparkSession.sparkContext.broadcast(told)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapped = shipped.value
        rewriter = rows.Rewriter(policy, identity_family, lambda kind, text: mapped[kind, canonical(text)], None, options.filenames, options.phrases)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(_rewritten(batch, fields, rewriter), names=batch.schema.names)

    return df.mapInArrow(run, df.schema)


def _chunked(df: DataFrame, policy: FieldPolicy, options: Options, pre: str) -> DataFrame:
    """The rows with the number of their chunk, and in each chunk's first row the (kind, key) of the entities that the chunk asks for."""
    fields = [f for f in df.schema.fields if _holds_text(f.dataType)]
    asked_type = pa.list_(pa.struct([("kind", pa.string()), ("key", pa.string())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 40
        for batch in batches:
            step = max(1, min(CHUNK_ROWS, batch.num_rows * CHUNK_BYTES // max(1, batch.nbytes)))
            for part in (batch.slice(i, step) for i in range(0, batch.num_rows, step)):
                asked: set[tuple[str, str]] = set()

                def note(kind: str, text: str, asked=asked) -> str:
                    asked.add((kind, canonical(text)))
                    return text

                rewriter = rows.Rewriter(policy, identity_family, note, None, options.filenames, options.phrases, masks=False)
                for row in _rows(part, fields):
                    rewriter.row(row)
                wanted = [[{"kind": k, "key": x} for k, x in sorted(asked)], *[None] * (part.num_rows - 1)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([chunk] * part.num_rows, pa.int64()), pa.array(wanted, asked_type)], names=[*part.schema.names, f"{pre}chunk", f"{pre}asked"])
                chunk += 1

    schema = T.StructType([*df.schema.fields, T.StructField(f"{pre}chunk", T.LongType()), T.StructField(f"{pre}asked", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("key", T.StringType())])))])
    return df.mapInArrow(run, schema)


def put_in_from(df: DataFrame, policy: FieldPolicy, told: DataFrame, options: Options = Options()) -> DataFrame:
    """As `put_in`, with a mapping (kind, key, pseudonym) of any size, of which each chunk of rows gets what it asks for."""
    fields, names, pre = [f for f in df.schema.fields if _holds_text(f.dataType)], df.columns, hidden(df)
    chunks = staged(_chunked(spread(df), policy, options, pre), "chunks")
    asked = chunks.filter(F.col(f"{pre}asked").isNotNull()).select(F.col(f"{pre}chunk").alias("chunk"), F.explode(f"{pre}asked").alias("e")).select("chunk", "e.kind", "e.key")
    given = asked.join(told.select("kind", "key", "pseudonym").hint("merge"), ["kind", "key"]).select("chunk", "kind", "key", "pseudonym")

    def run(part: pa.Table, found: pa.Table) -> pa.Table:
        mapped = {(k, x): p for k, x, p in zip(*(found.column(c).to_pylist() for c in ("kind", "key", "pseudonym")), strict=True)}
        rewriter = rows.Rewriter(policy, identity_family, lambda kind, text: mapped[kind, canonical(text)], None, options.filenames, options.phrases)
        part = part.select(names).combine_chunks()
        return pa.Table.from_arrays(_rewritten(part, fields, rewriter), names=names)

    return chunks.drop(f"{pre}asked").groupBy(f"{pre}chunk").cogroup(given.groupBy("chunk")).applyInArrow(run, df.schema)


def pseudonymise(df: DataFrame, policy: FieldPolicy, vault: Vault, record: int = 1_000_000, options: Options = Options()) -> DataFrame:
    """`df` with identities replaced; new mappings are added to the vault, at most `record` of them (else an error, nothing added).

    Command lines are masked in any case. With `options.filenames` file names, and what names the same file, are replaced first.
    """
    if options.filenames:
        df = paths.linked_files(df, vault.seed, lambda f: f in policy)
    found = staged(noted(spread(df), policy, options), "noted")
    told = staged(mapping(found, vault), "mapping")
    small = told.count() <= SHIPPED
    entries = told.collect() if small else []
    if small and vault.held is None:
        fresh = [r for r in entries if vault.get(r["kind"], r["original"]) is None]
        new = len(fresh)
    else:
        fresh = staged(vault.unknown(told), "fresh")
        new = fresh.count()
    if new > record:
        raise VaultError(f"more than {record} new entities: raise the limit")
    if isinstance(fresh, list):
        vault.add_all((r["kind"], r["original"], r["pseudonym"]) for r in sorted(fresh))
    elif new:
        vault.add_table(fresh)
    return put_in(df, policy, {(r["kind"], r["key"]): r["pseudonym"] for r in entries}, options) if small else put_in_from(df, policy, told, options)
