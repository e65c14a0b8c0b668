"""Graph export: rows of a result as nodes and edges, distributed, without a limit on rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.functions import scalar as S

FALLBACK_KIND, FALLBACK_EDGE, KINDS = "ImportedNode", "RELATED_TO", 3
#: The icon of each kind known by name, as (icon, colour); other kinds get the last.
ICONS = {
    "alert": ("triangle-exclamation", "#D97706"),
    "user": ("user", "#16A34A"),
    "machine": ("desktop", "#2563EB"),
    "computer": ("desktop", "#2563EB"),
    "file": ("file", "#6B7280"),
    "process": ("gears", "#7C3AED"),
    "ip": ("network-wired", "#0891B2"),
    "url": ("link", "#0284C7"),
    "cloudresource": ("cloud", "#0F766E"),
    "mailmessage": ("envelope", "#DC2626"),
    "application": ("window-maximize", "#4F46E5"),
    "group": ("users", "#1D4ED8"),
    "user_group": ("users", "#1D4ED8"),
    "finding": ("shield-halved", "#B45309"),
    "security_finding": ("shield-halved", "#B45309"),
    "identity": ("id-badge", "#15803D"),
}
FALLBACK_ICON = ("circle-question", "#64748B")


class GraphError(ValueError):
    """Rows that are neither nodes nor edges, or columns that differ in case only."""


def lowered(df: DataFrame) -> DataFrame:
    """Columns by lower-case name; an error where two differ in case or surrounding space only."""
    names = [c.strip().lower() for c in df.columns]
    if len(set(names)) < len(names):
        raise GraphError("column names differ in case only")
    return df.toDF(*names)


def _first(df: DataFrame, *names: str) -> Column:
    have = [S.first_nonempty(F.trim(F.col(f"`{n}`").cast("string"))) for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def row_kind(df: DataFrame) -> Column:
    """edge with both ends, else node with an id, else null."""
    source, target = _first(df, "sourceid", "sourcenodeid", "source"), _first(df, "targetid", "targetnodeid", "target")
    return F.when(source.isNotNull() & target.isNotNull(), "edge").when(_first(df, "id", "nodeid").isNotNull(), "node")


def classified(df: DataFrame) -> DataFrame:
    """Adds row_kind; one row of neither kind fails the whole result."""
    low = lowered(df)
    return low.withColumn("row_kind", F.coalesce(row_kind(low), F.raise_error("row is neither a node nor an edge").cast("string")))


def kinds(primary: Column, categories: Column | None = None) -> Column:
    """Up to three distinct sanitised kinds, primary first; the fallback if there is none."""
    every = F.array(S.graph_kind(primary))
    if categories is not None:
        every = F.concat(every, F.coalesce(F.transform(categories, lambda x: S.graph_kind(x)), F.array().cast("array<string>")))
    found = F.slice(F.array_distinct(F.filter(every, lambda k: k != "")), 1, KINDS)
    return F.when(F.size(found) == 0, F.array(F.lit(FALLBACK_KIND))).otherwise(found)


def nodes(df: DataFrame, order: str | None = None) -> DataFrame:
    """(id, kinds, name, ord, properties) of node rows."""
    low = lowered(df)
    categories = F.col("categories") if "categories" in low.columns and low.schema["categories"].dataType.typeName() == "array" else None
    name = F.coalesce(_first(low, "nodename"), _first(low, "label"), _first(low, "name"), _first(low, "id", "nodeid"))
    rest = [c for c in low.columns if c not in ("id", "nodeid", "categories") and not c.endswith("@odata.type")]
    return low.select(_first(low, "id", "nodeid").alias("id"), kinds(_first(low, "type", "nodelabel"), categories).alias("kinds"), name.alias("name"), (F.col(order) if order else F.lit(0)).cast("long").alias("ord"), properties(low, rest).alias("properties"))


def edge_kind(df: DataFrame) -> Column:
    """From edgetype, else type unless it ends in Edges, else edgelabel, else label, else the fallback."""
    kind = _first(df, "type")
    return S.graph_kind(F.coalesce(_first(df, "edgetype"), F.when(~kind.rlike("(?i)edges$"), kind), _first(df, "edgelabel"), _first(df, "label")), FALLBACK_EDGE)


def edges(df: DataFrame) -> DataFrame:
    """(start, end, kind, properties) of edge rows."""
    low = lowered(df)
    ends = ("sourceid", "sourcenodeid", "source", "targetid", "targetnodeid", "target")
    rest = [c for c in low.columns if c not in ends and not c.endswith("@odata.type")]
    return low.select(_first(low, *ends[:3]).alias("start"), _first(low, *ends[3:]).alias("end"), edge_kind(low).alias("kind"), properties(low, rest).alias("properties"))


def endpoint_nodes(df: DataFrame) -> DataFrame:
    """The two end nodes that edge rows with Source/TargetNode columns describe."""
    low, sides = lowered(df), []
    for side in ("source", "target"):
        own = F.col(f"{side}nodecategories") if f"{side}nodecategories" in low.columns else None
        id_ = _first(low, f"{side}nodeid")
        sides.append(low.select(id_.alias("id"), kinds(_first(low, f"{side}nodelabel"), own).alias("kinds"), F.coalesce(_first(low, f"{side}nodename"), id_).alias("name"), F.lit(0).cast("long").alias("ord"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("properties")))
    return sides[0].unionByName(sides[1]).filter(F.col("id").isNotNull())


def merged(found: DataFrame) -> DataFrame:
    """One node per id: kinds in order of first mention, name and properties from the first row that has them.

    Rows become one entry for each kind, property and name, and these are reduced to the first of each (id, sort, key)
    before an id's row is built, so an id with very many rows shrinks to its distinct kinds and keys within each task.
    """
    entry = lambda sort, key, value, ord_, pos: F.struct(F.lit(sort).alias("sort"), key.alias("key"), F.struct(ord_.alias("ord"), pos.alias("pos"), value.alias("value")).alias("first"))
    none = F.lit(0)
    kinds = F.transform("kinds", lambda k, i: entry("kind", k, F.lit(None).cast("string"), F.col("ord"), i))
    held = F.transform(F.map_entries("properties"), lambda e: entry("property", e["key"], e["value"], F.col("ord"), none))
    named = F.array(entry("name", F.lit(""), F.col("name"), F.col("ord"), none))
    each = found.select("id", F.explode(F.concat(*(F.coalesce(x, F.array().cast(f"array<struct<sort:string,key:string,first:struct<ord:bigint,pos:int,value:string>>>")) for x in (kinds, held, named)))).alias("e"))
    firsts = each.groupBy("id", F.col("e.sort").alias("sort"), F.col("e.key").alias("key")).agg(F.min("e.first").alias("first"))
    of = lambda sort, value: F.collect_list(F.when(F.col("sort") == sort, value))
    rows = firsts.groupBy("id").agg(
        F.transform(F.sort_array(of("kind", F.struct("first.ord", "first.pos", "key"))), lambda x: x["key"]).alias("kinds"),
        F.max(F.when(F.col("sort") == "name", F.col("first.value"))).alias("name"),
        F.sort_array(of("property", F.struct("key", "first.value"))).alias("held"),
    )
    return rows.select("id", "kinds", "name", F.when(F.size("held") > 0, F.map_from_entries("held")).alias("properties"))


def properties(df: DataFrame, columns: list[str]) -> Column:
    """A map of sanitised names to text: structs flattened with underscores, arrays as JSON, nulls left out; of different texts with one name the later are numbered."""
    from pyspark.sql import types as T

    entries: list[tuple[str, Column]] = []

    def walk(path: str, value: Column, kind: T.DataType) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f"{path}_{f.name}", value[f.name], f.dataType)
        elif isinstance(kind, (T.ArrayType, T.MapType)):
            entries.append((path, F.to_json(value)))
        else:
            entries.append((path, value.cast("string")))

    for c in columns:
        walk(c, F.col(f"`{c}`"), df.schema[c].dataType)
    named: dict[str, list[Column]] = {}
    for path, value in entries:
        named.setdefault(_clean(path), []).append(value)
    pairs = []
    for name, values in named.items():
        # of paths with one name, each text once and nulls not at all; the first there keeps the name, others are numbered
        texts = F.array_distinct(F.filter(F.array(*values), lambda v: v.isNotNull()))
        pairs += [F.struct(F.lit(name if i == 0 else f"{name}_{i + 1}").alias("key"), F.get(texts, F.lit(i)).alias("value")) for i in range(len(values))]
    if not pairs:
        return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))


def _clean(path: str) -> str:
    import re

    name = re.sub(r"[^a-z0-9]+", "_", path.strip().lower()).strip("_")
    name = f"_{name}" if name[:1].isdigit() else name
    return "source_objectid" if name == "objectid" else name


def icons(found: DataFrame) -> DataFrame:
    """(kind, icon, colour) of the distinct kinds among nodes."""
    table = F.create_map(*(F.lit(x) for k, v in ICONS.items() for x in (k, f"{v[0]} {v[1]}")))
    icon = F.split(F.coalesce(F.element_at(table, F.lower(F.trim("kind"))), F.lit(" ".join(FALLBACK_ICON))), " ")
    return found.select(F.explode("kinds").alias("kind")).distinct().select("kind", icon[0].alias("icon"), icon[1].alias("colour"))


def icon_changes(wanted: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Icons to create and icons to update, given the kinds that exist already."""
    return wanted.join(existing, "kind", "left_anti"), wanted.join(existing, "kind", "left_semi")


def payload(df: DataFrame, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a mixed result; ends described by edge rows become nodes too."""
    rows = classified(df)
    node_rows, edge_rows = rows.filter("row_kind = 'node'").drop("row_kind"), rows.filter("row_kind = 'edge'").drop("row_kind")
    return merged(nodes(node_rows, order).unionByName(endpoint_nodes(edge_rows))), edges(edge_rows)


def exported(found: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges in the form of a graph file: names among the properties, and ends as references by id."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    held = F.coalesce("properties", none)
    named = F.map_filter(F.create_map(F.lit("displayname"), F.col("name"), F.lit("name"), F.col("name")), lambda k, v: v.isNotNull() & ~F.map_contains_key(held, k))
    some = lambda m: F.when(F.size(m) > 0, m)
    end = lambda c: F.struct(F.lit("id").alias("match_by"), F.col(c).alias("value")).alias(c)
    return found.select("id", "kinds", some(F.map_concat(held, named)).alias("properties")), links.select(end("start"), end("end"), "kind", some(F.coalesce("properties", none)).alias("properties"))
