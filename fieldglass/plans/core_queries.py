"""The registered queries of the library's own operators over whole tables, with the SQL that checks them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.functions import digest as D
from fieldglass.functions import patterns as P
from fieldglass.functions import scalar as S
from fieldglass.operators import allocate as A
from fieldglass.operators import collect as C
from fieldglass.operators import graph as G
from fieldglass.operators import relational as R
from fieldglass.operators import schema as L

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CUTOFF, LOOKBACK, SEED = datetime(2024, 1, 25), "14d", b"fieldglass example seed"
EVENT_KEY = ["event_id", "event_type", "props", "ts", "user_id"]  # scalar columns other than doubles, whose text form differs between engines
_JSON_KEY = "to_json([event_id::VARCHAR, event_type, coalesce(props, ''), ts::VARCHAR, user_id::VARCHAR])::VARCHAR"
_KEY = f"('0x' || substr(sha256({_JSON_KEY}), 1, 15))::BIGINT"
_IN_WINDOW = "ts >= TIMESTAMP '2024-01-11' AND ts < TIMESTAMP '2024-01-25'"


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """A scan of fewer partitions than there are cores, dealt out over all of them before a scanner in Python."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.window(table(spark, sf_dir, "events"), "ts", LOOKBACK, CUTOFF)


@_query(f"SELECT {_KEY} % 16 AS \"DumpPartition\", count(*) AS \"Count\" FROM events WHERE {_IN_WINDOW} GROUP BY 1")
def dump_bucket_counts(spark, sf_dir):
    """Rows of a fixed window by hash bucket of their key."""
    return C.bucket_counts(events(spark, sf_dir), 16, EVENT_KEY)


@_query(f"SELECT event_id, ts, user_id, event_type, value, props FROM events WHERE {_IN_WINDOW}")
def dump_window(spark, sf_dir):
    return events(spark, sf_dir)


@_query(f"SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-11' AND ts < TIMESTAMP '2024-01-25' AND coalesce(ts + INTERVAL (user_id % 4) DAY < TIMESTAMP '2024-01-25', true)")
def dump_window_late_arrivals(spark, sf_dir):
    """The window without rows that arrived after the cutoff (arrival: the time plus some days)."""
    df = table(spark, sf_dir, "events").withColumn("arrived", F.col("ts") + F.make_dt_interval((F.col("user_id") % 4).cast("int")))
    return C.window(df, "ts", LOOKBACK, CUTOFF, "arrived").select("event_id", "user_id")


@_query(f"SELECT count(*) AS \"Count\" FROM events WHERE {_IN_WINDOW}")
def dump_count(spark, sf_dir):
    return R.count(events(spark, sf_dir))


@_query(f"SELECT event_id, user_id, event_type FROM events WHERE {_IN_WINDOW} AND {_KEY} % 16 = 5")
def dump_bucket_chunk(spark, sf_dir):
    return C.bucket(events(spark, sf_dir), 16, 5, EVENT_KEY).select("event_id", "user_id", "event_type")


_LINE_KEY = "('0x' || substr(sha256(to_json([l_linenumber::VARCHAR, l_linestatus, l_orderkey::VARCHAR, l_partkey::VARCHAR, l_returnflag, l_shipdate::VARCHAR, l_suppkey::VARCHAR])::VARCHAR), 1, 15))::BIGINT"
_LINE_COLUMNS = ["l_linenumber", "l_linestatus", "l_orderkey", "l_partkey", "l_returnflag", "l_shipdate", "l_suppkey"]


@_query(" UNION ALL ".join(f"SELECT {n}::BIGINT AS \"Buckets\", {_LINE_KEY} % {n} AS \"DumpPartition\", count(*) AS \"Count\" FROM lineitem GROUP BY 1, 2" for n in (20, 40, 80)))
def dump_plan_rounds(spark, sf_dir):
    """Bucket counts for each doubling of the number of buckets, from one pass."""
    return C.planned_rounds(table(spark, sf_dir, "lineitem"), [20, 40, 80], _LINE_COLUMNS)


@_query(f"WITH c AS (SELECT {_KEY} % 16 AS p, count(*) AS n FROM events GROUP BY 1) SELECT sum(n)::BIGINT AS total, count(*) AS buckets, count(DISTINCT p) AS distinct_buckets, min(n) AS least, max(n) AS most, bool_and(p BETWEEN 0 AND 15) AS in_range FROM c")
def bucket_check(spark, sf_dir):
    c = C.bucket_counts(table(spark, sf_dir, "events"), 16, EVENT_KEY)
    p, n = F.col("DumpPartition"), F.col("Count")
    return c.agg(F.sum(n).alias("total"), F.count(p).alias("buckets"), F.countDistinct(p).alias("distinct_buckets"), F.min(n).alias("least"), F.max(n).alias("most"), F.bool_and(p.between(0, 15)).alias("in_range"))


@_query("SELECT literal, microseconds FROM (VALUES ('30d', 2592000000000), ('1.5h', 5400000000), ('90m', 5400000000), ('30s', 30000000), ('500ms', 500000), ('.5s', 500000), ('2.d', 172800000000), ('5w', NULL), ('12', NULL), ('1d; drop', NULL)) v(literal, microseconds)")
def lookback_parse(spark, sf_dir):
    df = spark.createDataFrame([(x,) for x in ("30d", "1.5h", "90m", "30s", "500ms", ".5s", "2.d", "5w", "12", "1d; drop")], "literal string")
    return df.select("literal", S.lookback_column(F.col("literal")).alias("microseconds"))


@_query("SELECT event_id, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 12:00:00' AND TIMESTAMP '2024-01-09'")
def where_between(spark, sf_dir):
    return table(spark, sf_dir, "events").filter(F.col("ts").between(F.lit(datetime(2024, 1, 5, 12)), F.lit(datetime(2024, 1, 9)))).select("event_id", "value")


@_query("SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 300")
def take_first(spark, sf_dir):
    return R.take(table(spark, sf_dir, "events"), 300, "event_id").select("event_id", "user_id")


@_query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debit' WHEN c_acctbal < 1000 THEN 'low' ELSE 'high' END AS band, coalesce(nullif(CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_mktsegment END, ''), c_name, 'none') AS label, CASE WHEN c_nationkey IS NULL OR c_nationkey::VARCHAR = '' THEN 'no' ELSE 'yes' END AS placed, lower(c_name) || '/' || coalesce(c_nationkey::VARCHAR, '') AS path FROM customer")
def extend_case_coalesce(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    blank = S.iff(F.col("c_mktsegment") == "BUILDING", F.lit(""), F.col("c_mktsegment"))
    out = R.extend(
        c,
        band=S.case(F.col("c_acctbal") < 0, F.lit("debit"), F.col("c_acctbal") < 1000, F.lit("low"), F.lit("high")),
        label=S.first_nonempty(blank, F.col("c_name"), F.lit("none")),
        placed=S.iff(S.isempty(F.col("c_nationkey")), F.lit("no"), F.lit("yes")),
        path=S.strcat(F.lower("c_name"), F.lit("/"), F.col("c_nationkey")),
    )
    return out.select("c_custkey", "band", "label", "placed", "path")


@_query("SELECT o.o_custkey AS k, o.o_orderkey AS id, o.o_totalprice AS amount, c.c_custkey AS k1, c.c_nationkey AS id1 FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
def join_inner_suffix(spark, sf_dir):
    left = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
    right = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("id"))
    return R.join_inner(left, right, "k")


@_query("SELECT o_orderstatus AS status, o_orderpriority AS label, o_orderpriority AS kind, min(o_orderdate) AS first, min(o_orderpriority) AS some, count(*) AS weight FROM orders GROUP BY 1, 2, 3")
def summarize_any_min(spark, sf_dir):
    p = F.col("o_orderpriority")
    return R.summarize(table(spark, sf_dir, "orders"), {"status": F.col("o_orderstatus"), "label": p, "kind": p}, first=F.min("o_orderdate"), some=R.any_value(p), weight=F.count(F.lit(1)))


@_query("SELECT c_custkey AS id, c_name AS name, NULL::DOUBLE AS price FROM customer UNION ALL SELECT o_orderkey, NULL, o_totalprice FROM orders")
def union_outer(spark, sf_dir):
    one = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return R.union(one, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price")))


@_query("SELECT o_orderkey, to_json({status: o_orderstatus, customer: o_custkey, note: NULL})::VARCHAR AS props FROM orders")
def pack_props(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", S.pack("status", F.col("o_orderstatus"), "customer", F.col("o_custkey"), "note", F.lit(None).cast("string")).alias("props"))


@_query("""SELECT o.o_orderpriority || '_' || lower('Order' || o_orderstatus) || '_' || c_mktsegment AS id, o_orderpriority AS "sourceId", c_mktsegment AS "targetId", 'Order' || o_orderstatus AS type,
 CASE WHEN o_orderstatus = 'F' THEN 'Finished' WHEN o_orderstatus = 'O' THEN 'Open' ELSE o_orderstatus END AS label, count(*) AS weight, min(c_name) AS some_name, min(o_orderdate) AS timestamp
 FROM orders o JOIN customer c ON o_custkey = c_custkey WHERE coalesce(c_mktsegment, '') <> '' GROUP BY o_orderpriority, c_mktsegment, o_orderstatus""")
def alert_edges_analog(spark, sf_dir):
    """The flagship edge query: join, extend, filter, summarize, project."""
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "k")
    base = R.join_inner(o, table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "k"), "k").filter(S.isnotempty(F.col("c_mktsegment")))
    base = R.extend(base, sourceId=F.col("o_orderpriority"), targetId=S.tostring(F.col("c_mktsegment")), edgeType=S.strcat(F.lit("Order"), F.col("o_orderstatus")), edgeLabel=S.case(F.col("o_orderstatus") == "F", F.lit("Finished"), F.col("o_orderstatus") == "O", F.lit("Open"), F.col("o_orderstatus")))
    grouped = R.summarize(base, {"sourceId": F.col("sourceId"), "targetId": F.col("targetId"), "type": F.col("edgeType"), "edgeType": F.col("edgeType"), "label": F.col("edgeLabel")}, some_name=R.any_value(F.col("c_name")), timestamp=F.min("o_orderdate"), weight=F.count(F.lit(1)))
    return grouped.select(S.strcat(F.col("sourceId"), F.lit("_"), F.lower("edgeType"), F.lit("_"), F.col("targetId")).alias("id"), "sourceId", "targetId", "type", "label", "weight", "some_name", "timestamp")


@_query("""WITH base AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey)
 SELECT c_custkey::VARCHAR AS id, 'Customer' AS type, min(c_name) AS label, min(o_orderdate) AS timestamp FROM base GROUP BY c_custkey
 UNION ALL SELECT o_orderpriority, 'Priority', min(o_orderpriority), min(o_orderdate) FROM base GROUP BY o_orderpriority""")
def alert_nodes_analog(spark, sf_dir):
    """The flagship node query: one join, two summaries, their union."""
    base = R.join_inner(table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "k"), table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "k"), "k")
    one = R.summarize(base, {"id": S.tostring(F.col("k"))}, label=R.any_value(F.col("c_name")), timestamp=F.min("o_orderdate")).withColumn("type", F.lit("Customer"))
    two = R.summarize(base, {"id": S.tostring(F.col("o_orderpriority"))}, label=R.any_value(F.col("o_orderpriority")), timestamp=F.min("o_orderdate")).withColumn("type", F.lit("Priority"))
    return R.union(one, two).select("id", "type", "label", "timestamp")


# Digests and pseudonyms


def _pads(seed: bytes) -> tuple[str, str]:
    block = (hashlib.sha256(seed).digest() if len(seed) > 64 else seed).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block).hex(), bytes(b ^ 0x5C for b in block).hex()


def _sql_hmac(message: str) -> str:
    inner, outer = _pads(SEED)
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))"


def _sql_entity(kind: str, column: str, attempt: int = 0) -> str:
    return _sql_hmac(f"'{kind}' || chr(0) || regexp_replace(trim(lower({column})), '\\s+', ' ', 'g') || chr(0) || '{attempt}'")


def _sql_number(h: str, start: int, size: int) -> str:
    return f"('0x' || substr({h}, {2 * start + 1}, {2 * size}))::BIGINT"


def _sql_pick(pool: list[str], h: str, start: int) -> str:
    return f"(['{"','".join(pool)}'])[({_sql_number(h, start, 2)} % {len(pool)} + 1)::INT]"


@_query(f"SELECT c_custkey, {_sql_entity('person', 'c_name')} AS digest FROM customer")
def hmac_digest(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", D.entity_digest(SEED, "person", F.col("c_name")).alias("digest"))


@_query(f"SELECT c_custkey, {_sql_hmac("'fieldglass-vault' || chr(0) || 'person' || chr(0) || trim(lower(c_name))")} AS vault_key FROM customer")
def vault_key(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", D.vault_key(SEED, "person", F.col("c_name")).alias("vault_key"))


_CANDIDATES = {
    "person": f"{_sql_pick(D.FIRST_NAMES, 'h', 0)} || ' ' || {_sql_pick(D.LAST_NAMES, 'h', 2)}",
    "organization": f"{_sql_pick(D.ADJECTIVES, 'h', 0)} || ' ' || {_sql_pick(D.NOUNS, 'h', 2)}",
    "username": f"lower({_sql_pick(D.FIRST_NAMES, 'h', 0)}) || '.' || lower({_sql_pick(D.LAST_NAMES, 'h', 2)})",
    "email": f"lower({_sql_pick(D.FIRST_NAMES, 'h', 0)}) || '.' || lower({_sql_pick(D.LAST_NAMES, 'h', 2)}) || '@' || lower({_sql_pick(D.ADJECTIVES, 'h', 4)}) || '.example'",
    "domain": f"lower({_sql_pick(D.ADJECTIVES, 'h', 0)}) || '-' || lower({_sql_pick(D.NOUNS, 'h', 2)}) || '.internal'",
    "hostname": f"'host-' || lpad(({_sql_number('h', 0, 2)} % 9999 + 1)::VARCHAR, 4, '0')",
    "ip_address": f"(['192.0.2', '198.51.100', '203.0.113'])[({_sql_number('h', 0, 2)} % 762) // 254 + 1] || '.' || ({_sql_number('h', 0, 2)} % 762 % 254 + 1)::VARCHAR",
    "mac_address": "'02:' || substr(h, 1, 2) || ':' || substr(h, 3, 2) || ':' || substr(h, 5, 2) || ':' || substr(h, 7, 2) || ':' || substr(h, 9, 2)",
    "sid": f"'S-1-5-21-' || {_sql_number('h', 0, 4)}::VARCHAR || '-' || {_sql_number('h', 4, 4)}::VARCHAR || '-' || {_sql_number('h', 8, 4)}::VARCHAR || '-' || ({_sql_number('h', 12, 4)} % 9000 + 1000)::VARCHAR",
    "address": f"({_sql_number('h', 0, 2)} % 399 + 1)::VARCHAR || ' ' || {_sql_pick(D.STREETS, 'h', 2)}",
    "filename": "'file-' || substr(h, 1, 10)",
    "resource_group": f"'rg-' || lower({_sql_pick(D.ADJECTIVES, 'h', 0)}) || '-' || substr(h, 5, 4)",
    "resource_name": "'resource-' || substr(h, 1, 10)",
    "identifier": "'id-' || substr(h, 1, 16)",
}


def _candidate_query(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = table(spark, sf_dir, "customer").withColumn("h", D.entity_digest(SEED, kind, F.col("c_name")))
        return c.select("c_custkey", D.candidate(kind, F.col("c_name"), F.col("h")).alias("pseudonym"))

    return run


for _kind, _sql in _CANDIDATES.items():
    QUERIES[f"candidate_{_kind}"] = _candidate_query(_kind)
    ORACLES[f"candidate_{_kind}"] = f"WITH d AS (SELECT c_custkey, {_sql_entity(_kind, 'c_name')} AS h FROM customer) SELECT c_custkey, {_sql} AS pseudonym FROM d"


_ALLOCATED = _CANDIDATES["person"]


@_query(f"""WITH e AS (SELECT DISTINCT trim(lower(c_name)) AS key FROM customer), d AS (SELECT key, {_sql_entity('person', 'key')} AS h FROM e),
 p AS (SELECT key, {_ALLOCATED} AS pseudonym FROM d), r AS (SELECT *, row_number() OVER (PARTITION BY lower(pseudonym) ORDER BY key) AS n FROM p),
 l AS (SELECT key, {_sql_entity('person', 'key', 1)} AS h FROM r WHERE n > 1)
 SELECT key, pseudonym, 0 AS attempt FROM r WHERE n = 1 UNION ALL SELECT key, {_ALLOCATED} || substr(h, 33, 16) AS pseudonym, 1 FROM l""")
def allocate_unique(spark, sf_dir):
    """Unique person pseudonyms for all customer names: friendly first, suffixed on collision."""
    return A.allocate(A.entities(table(spark, sf_dir, "customer"), "c_name"), "person", SEED).select("key", "pseudonym", "attempt")


@_query("""SELECT * FROM (VALUES ('a.example.com', 'a', 'example.com'), ('x.y.shop.co.uk', 'x.y', 'shop.co.uk'), ('shop.co.uk', '', ''), ('example.com', '', ''), ('host', '', ''), ('A.B.c.d.', 'a.b', 'c.d')) v(domain, sub, base)""")
def subdomain_split(spark, sf_dir):
    df = spark.createDataFrame([(x,) for x in ("a.example.com", "x.y.shop.co.uk", "shop.co.uk", "example.com", "host", "A.B.c.d.")], "domain string")
    sub, base = A.split_subdomain(F.col("domain"))
    return df.select("domain", sub.alias("sub"), base.alias("base"))


# Recognition


def _found(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = table(spark, sf_dir, "documents").select("doc_id", P.matches(name, F.col("text")).alias("found"))
        return docs.filter(F.size("found") > 0).select("doc_id", F.size("found").cast("long").alias("n"), F.array_join("found", " ").alias("found"))

    return run


for _name in P.SQL:
    QUERIES[f"entity_{_name}"] = _found(_name)
    ORACLES[f"entity_{_name}"] = f"WITH m AS (SELECT doc_id, regexp_extract_all(text, '{P.SQL[_name].replace(chr(39), chr(39) * 2)}') AS f FROM documents) SELECT doc_id, len(f) AS n, array_to_string(f, ' ') AS found FROM m WHERE len(f) > 0"


@_query("SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)) AS host FROM pages")
def url_domain(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", P.url_host(F.col("url")).alias("host"))


@_query(r"SELECT doc_id, regexp_replace(text, '(?i)\bthe\b', 'THE-TERM', 'g') AS text FROM documents")
def phrase_replace(spark, sf_dir):
    """One configured phrase replaced in all texts, whole words in any case."""
    return table(spark, sf_dir, "documents").select("doc_id", P.replace_phrase(F.col("text"), "the", "THE-TERM").alias("text"))


# Schema


@_query("SELECT 'k' AS name, 'Int64' AS type FROM events LIMIT 1")
def ingest_json_schema(spark, sf_dir):
    """The inferred columns of a JSON text column's members."""
    return L.infer(table(spark, sf_dir, "events"), "props")


@_query("""SELECT * FROM (VALUES ('Device-Name', 'Device_Name', '$[''Device-Name'']'), ('Device Name', 'Device_Name_2', '$[''Device Name'']'), ('1Count', '_1Count', '$[''1Count'']'), ('Plain', 'Plain', '$.Plain')) v(source, name, path)""")
def column_sanitize(spark, sf_dir):
    names = ["Device-Name", "Device Name", "1Count", "Plain"]
    return spark.createDataFrame([(s, n, L.json_path(s)) for s, n in zip(names, L.safe_names(names), strict=True)], "source string, name string, path string")


@_query("SELECT batch, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM (SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 500 AS batch FROM events) GROUP BY batch")
def ingest_batches(spark, sf_dir):
    """Batches of 500 rows in order of id, numbered without gathering rows in one task."""
    from fieldglass.operators import batches as B

    return B.numbered(table(spark, sf_dir, "events").select("event_id"), "event_id", 500).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


# Graph


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as nodes and orders as edges from a customer to a priority, with gaps."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.lit("Customer").alias("type"), F.col("c_name").alias("label"), F.col("c_mktsegment").alias("segment"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("sourceId"), F.col("o_orderpriority").alias("targetId"), F.concat(F.lit("Placed "), F.col("o_orderstatus")).alias("type"), F.col("o_orderkey").cast("string").alias("label"))
    return R.union(c, o)


@_query("SELECT 'node' AS row_kind, count(*) AS n FROM customer UNION ALL SELECT 'edge', count(*) FROM orders")
def row_kinds(spark, sf_dir):
    return G.classified(_mixed(spark, sf_dir)).groupBy("row_kind").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT c_custkey::VARCHAR AS id, 'Customer' AS kind, c_name AS name FROM customer")
def node_rows(spark, sf_dir):
    found, _ = G.payload(_mixed(spark, sf_dir))
    return found.select("id", F.array_join("kinds", ",").alias("kind"), "name")


@_query("SELECT o_custkey::VARCHAR AS start, o_orderpriority AS \"end\", 'Placed_' || o_orderstatus AS kind, count(*) AS n FROM orders GROUP BY 1, 2, 3")
def edge_rows(spark, sf_dir):
    _, found = G.payload(_mixed(spark, sf_dir))
    return found.groupBy("start", "end", "kind").agg(F.count(F.lit(1)).alias("n"))


@_query("""WITH f AS (SELECT o_custkey::VARCHAR AS id, o_orderstatus AS kind, min(o_orderkey) AS first FROM orders GROUP BY 1, 2),
 n AS (SELECT o_custkey::VARCHAR AS id, arg_min(o_orderpriority, o_orderkey) AS priority FROM orders GROUP BY 1)
 SELECT f.id, string_agg(kind, ',' ORDER BY first) AS kinds, any_value(priority) AS priority FROM f JOIN n ON f.id = n.id GROUP BY f.id""")
def node_merge(spark, sf_dir):
    """One node per customer from its orders: kinds in order, properties from the first row."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("id"), F.col("o_orderstatus").alias("type"), F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("ord"))
    found = G.merged(G.nodes(rows, "ord"))
    return found.select("id", F.array_join("kinds", ",").alias("kinds"), F.element_at("properties", "priority").alias("priority"))


@_query("SELECT * FROM (VALUES ('A_b,C,D', 1), ('ImportedNode', 2), ('_1abc,X', 3)) v(kinds, k)")
def kinds_cap(spark, sf_dir):
    df = spark.createDataFrame([("A b", ["C", "D", "E"], 1), ("  ", [], 2), (" 1abc", ["X", "_1abc"], 3)], "primary string, categories array<string>, k int")
    return df.select(F.array_join(G.kinds(F.col("primary"), F.col("categories")), ",").alias("kinds"), "k")


@_query("""SELECT kind, icon, colour FROM (SELECT DISTINCT unnest(CASE WHEN o_orderstatus = 'F' THEN ['Alert', 'Finding'] WHEN o_orderstatus = 'O' THEN ['Machine', 'User_Group'] ELSE ['CloudResource'] END) AS kind FROM orders UNION SELECT DISTINCT upper(c_mktsegment) FROM customer)
 LEFT JOIN (VALUES ('alert', 'triangle-exclamation', '#D97706'), ('finding', 'shield-halved', '#B45309'), ('machine', 'desktop', '#2563EB'), ('user_group', 'users', '#1D4ED8'), ('cloudresource', 'cloud', '#0F766E')) v(k, i, c) ON lower(kind) = k,
 LATERAL (SELECT coalesce(i, 'circle-question') AS icon, coalesce(c, '#64748B') AS colour)""")
def node_icons(spark, sf_dir):
    """The icons of the kinds that orders and customers have."""
    status = F.col("o_orderstatus")
    told = F.when(status == "F", F.array(F.lit("Alert"), F.lit("Finding"))).when(status == "O", F.array(F.lit("Machine"), F.lit("User_Group"))).otherwise(F.array(F.lit("CloudResource")))
    segments = table(spark, sf_dir, "customer").select(F.array(F.upper("c_mktsegment")).alias("kinds"))
    return G.icons(table(spark, sf_dir, "orders").select(told.alias("kinds")).unionByName(segments))


@_query("SELECT event_id, event_type AS kind, user_id::VARCHAR AS user_id, (props::JSON->>'$.k') AS props_k FROM events")
def prop_flatten(spark, sf_dir):
    """A nested column flattened into properties."""
    e = table(spark, sf_dir, "events").withColumn("props", F.from_json("props", "k long"))
    p = e.select("event_id", G.properties(e, ["event_type", "user_id", "props"]).alias("p"))
    return p.select("event_id", F.element_at("p", "event_type").alias("kind"), F.element_at("p", "user_id").alias("user_id"), F.element_at("p", "props_k").alias("props_k"))


# Pipe language


def _pipe(name: str, text: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from fieldglass.plans import pipe_language as K

        return K.query(text, lambda n: table(spark, sf_dir, n), CUTOFF)

    QUERIES[name], ORACLES[name] = run, sql


_pipe(
    "pipe_edges",
    """let base = orders
    | join kind=inner (customer | extend o_custkey = c_custkey) on o_custkey
    | extend value = case(o_orderstatus == "F", coalesce(c_mktsegment, c_name), o_orderstatus == "O", c_mktsegment, coalesce(c_name, c_mktsegment))
    | where isnotempty(value)
    | extend sourceId = o_orderpriority, targetId = tostring(value), edgeType = strcat("Order", tostring(o_orderstatus));
    base
    | summarize timestamp = min(o_orderdate), weight = count() by sourceId, targetId, type = edgeType, edgeType
    | project id = strcat(sourceId, "_", tolower(edgeType), "_", targetId), sourceId, targetId, type, weight, timestamp""",
    """WITH b AS (SELECT *, CASE WHEN o_orderstatus IN ('F', 'O') THEN c_mktsegment ELSE c_name END AS v FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT o_orderpriority || '_order' || lower(o_orderstatus) || '_' || v AS id, o_orderpriority AS "sourceId", v AS "targetId", 'Order' || o_orderstatus AS type, count(*) AS weight, min(o_orderdate) AS timestamp FROM b GROUP BY o_orderpriority, o_orderstatus, v""",
)
_pipe("pipe_between", "events | where ts between (datetime(2024-01-05T12:00:00) .. datetime(2024-01-09)) and event_type != \"view\" | project event_id, event_type", "SELECT event_id, event_type FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 12:00:00' AND TIMESTAMP '2024-01-09' AND event_type <> 'view'")
_pipe("pipe_ago", "events | where ts >= ago(14d) and ts < datetime(2024-01-25) | summarize n = count(), last = max(ts) by event_type", f"SELECT event_type, count(*) AS n, max(ts) AS last FROM events WHERE {_IN_WINDOW} GROUP BY 1")
_pipe("pipe_union", "let c = customer; union (c | summarize n = count() by id = c_mktsegment), (orders | summarize n = count() by id = o_orderstatus);", "SELECT c_mktsegment AS id, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT o_orderstatus, count(*) FROM orders GROUP BY 1")
_pipe("pipe_buckets", "events | summarize Count = count() by DumpPartition = tolong(strcat(\"0x\", substring(hash_sha256(tostring(pack_array(tostring([\"event_id\"]), tostring([\"user_id\"])))), 0, 15))) % 8", "SELECT ('0x' || substr(sha256(to_json([event_id::VARCHAR, user_id::VARCHAR])::VARCHAR), 1, 15))::BIGINT % 8 AS \"DumpPartition\", count(*) AS \"Count\" FROM events GROUP BY 1")
_pipe("pipe_pack", "customer | extend band = iff(c_acctbal < 0, \"debit\", \"credit\") | project c_custkey, props = pack(\"name\", c_name, \"band\", band, \"nation\", c_nationkey)", "SELECT c_custkey, to_json({name: c_name, band: CASE WHEN c_acctbal < 0 THEN 'debit' ELSE 'credit' END, nation: c_nationkey})::VARCHAR AS props FROM customer")


@_query("SELECT event_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-25' AND ts + INTERVAL (user_id % 4) DAY < TIMESTAMP '2024-01-25'")
def pipe_ingested(spark, sf_dir):
    """ingestion_time() of a query text, from a column of arrival times (the time plus some days)."""
    from fieldglass.plans import pipe_language as K

    arrived = F.col("ts") + F.make_dt_interval((F.col("user_id") % 4).cast("int"))
    return K.query("events | where ts < datetime(2024-01-25) and ingestion_time() < datetime(2024-01-25) | project event_id, event_type", lambda n: table(spark, sf_dir, n).withColumn("arrived", arrived), CUTOFF, "arrived")


# Command lines, policies, resources, manifest, pseudonymised tables


@_query(r"SELECT doc_id, regexp_replace(text, '\b((?:AKIA|ASIA)[A-Z0-9]{16})\b', '***', 'g') AS text FROM documents")
def command_access_keys(spark, sf_dir):
    """The single-pattern case of masking over all texts, in built-in functions."""
    from fieldglass.operators import command_lines as M

    return table(spark, sf_dir, "documents").select("doc_id", M.masked_access_keys(F.col("text")).alias("text"))


@_query()
def command_lines_masked(spark, sf_dir):
    """The whole scanner over all texts; tests hold it against cases of its own."""
    from fieldglass.operators import command_lines as M

    return dealt(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", M.masked(F.col("text")).alias("text"))


@_query("""SELECT * FROM (VALUES ('AccountName', 'username'), ('DeviceName', 'hostname'), ('SHA256', NULL), ('RemoteIP', 'ip_address'), ('SenderFromAddress', 'email'), ('AccountSid', 'sid'), ('ProcessId', 'sid'), ('ReportId', 'identifier'), ('FileName', 'filename'), ('AccountDisplayName', 'person'), ('ResourceGroup', 'resource_group'), ('UserDomain_s', 'domain')) v(field, kind)""")
def entity_kinds(spark, sf_dir):
    from fieldglass.operators import policy

    names = ["AccountName", "DeviceName", "SHA256", "RemoteIP", "SenderFromAddress", "AccountSid", "ProcessId", "ReportId", "FileName", "AccountDisplayName", "ResourceGroup", "UserDomain_s"]
    return spark.createDataFrame([(n, policy.field_kind(n)) for n in names], "field string, kind string")


@_query("""SELECT * FROM (VALUES ('/subscriptions/0f8fad5b-d9cb-469f-a165-70867728950e/resourceGroups/rg1/providers/Ns.Compute/virtualMachines/vm1', '0f8fad5b-d9cb-469f-a165-70867728950e', 'rg1', true), ('/subscriptions/0f8fad5b-d9cb-469f-a165-70867728950e', '0f8fad5b-d9cb-469f-a165-70867728950e', '', true), ('/other/x', '', '', false)) v(id, subscription, grp, whole)""")
def resource_id_split(spark, sf_dir):
    from fieldglass.operators import resource_ids as I

    g = "/subscriptions/0f8fad5b-d9cb-469f-a165-70867728950e"
    df = spark.createDataFrame([(g + "/resourceGroups/rg1/providers/Ns.Compute/virtualMachines/vm1",), (g,), ("/other/x",)], "id string")
    return df.select("id", I.subscription(F.col("id")).alias("subscription"), I.group(F.col("id")).alias("grp"), I.is_resource_id(F.col("id")).alias("whole"))


@_query("SELECT name, CASE WHEN name = 'missing' THEN NULL ELSE n END AS rows, CASE WHEN name = 'missing' THEN 'absent_in_source' WHEN n > 0 THEN 'captured' ELSE 'captured_empty' END AS status FROM (SELECT 'events' AS name, count(*) AS n FROM events UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'none', 0 UNION ALL SELECT 'missing', NULL)")
def manifest_status(spark, sf_dir):
    """Status of each collected table from its count."""
    from fieldglass.operators import manifest as M
    from fieldglass.sources.envelopes import Tables

    source, parts = Tables(spark, sf_dir), []
    for name in ("events", "orders", "none", "missing"):
        df = source.table(name) if name in ("events", "orders") else None
        count = df.agg(F.count(F.lit(1)).alias("rows")) if df is not None else spark.range(1).select(F.lit(0 if name == "none" else None).cast("long").alias("rows"))
        parts.append(count.select(F.lit(name).alias("name"), "rows", F.lit(name == "missing").alias("absent")))
    return M.table_statuses(R.union(*parts))


@_query(r"""SELECT c_custkey, 'run --password *** --level 3' AS command, 'run.exe' AS file, 'C:\Users\' AS folder_start, '\x.txt' AS folder_end, true AS one_user, true AS address_agrees,
  '1.10' AS number, true AS nested_agrees, false AS shown, c_mktsegment AS note FROM customer""")
def pseudonymised_rows(spark, sf_dir):
    """A table of account, address, path, command line and JSON under the built-in policy: what is fixed of each row, and that parts of one user agree everywhere."""
    from fieldglass.operators import pseudonyms
    from fieldglass.operators.policy import FieldPolicy, default_fields
    from fieldglass.operators.vault import Vault

    name, key = F.concat(F.lit("user"), "c_custkey"), F.col("c_custkey").cast("string")
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", name.alias("AccountName"), F.concat(name, F.lit("@corp.test")).alias("AccountUpn"), F.lit("run.exe").alias("FileName"), F.col("c_mktsegment").alias("note"),
        F.concat(F.lit("C:\\Users\\"), name, F.lit("\\x.txt")).alias("FolderPath"), F.concat(F.lit("run --password s"), key, F.lit(" --level 3")).alias("ProcessCommandLine"),
        F.concat(F.lit('{"AccountName":"'), name, F.lit('","n":1.10}')).alias("AdditionalFields"),
    )
    out = pseudonyms.pseudonymise(rows, FieldPolicy(default_fields("DeviceProcessEvents")), Vault(SEED))
    user, json = F.col("AccountName"), F.col("AdditionalFields")
    texts = F.concat_ws(" ", "AccountName", "AccountUpn", "FolderPath", "ProcessCommandLine", "AdditionalFields")
    return out.select(
        "c_custkey", F.col("ProcessCommandLine").alias("command"), F.col("FileName").alias("file"), F.substring("FolderPath", 1, 9).alias("folder_start"), F.substring("FolderPath", -6, 6).alias("folder_end"),
        (F.regexp_extract("FolderPath", r"Users\\([^\\]+)", 1) == user).alias("one_user"), (F.substring_index("AccountUpn", "@", 1) == user).alias("address_agrees"),
        F.regexp_extract(json, r'"n":([0-9.]+)', 1).alias("number"), (F.get_json_object(json, "$.AccountName") == user).alias("nested_agrees"), texts.contains(name).alias("shown"), "note",
    )


@_query("""SELECT * FROM (VALUES (1, true, true, 3), (2, true, true, 3)) v(run, distinct_names, stable, columns)""")
def pseudonymised_customers(spark, sf_dir):
    """Customer names as persons in a table of their own: all distinct, and a second run over a vault gives the same."""
    from fieldglass.operators import pseudonyms
    from fieldglass.operators.policy import FieldPolicy
    from fieldglass.operators.vault import Vault

    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("FullName"), F.col("c_mktsegment").alias("note"))
    vault, policy = Vault(SEED), FieldPolicy("*fullname")
    one = pseudonyms.pseudonymise(rows, policy, vault)
    two = pseudonyms.pseudonymise(rows, policy, vault)
    both = one.select("c_custkey", F.col("FullName").alias("a")).join(two.select("c_custkey", F.col("FullName").alias("b")), "c_custkey")
    told = both.agg((F.countDistinct("a") == F.count("a")).alias("distinct_names"), F.bool_and(F.col("a") == F.col("b")).alias("stable"))
    return told.select(F.explode(F.array(F.lit(1), F.lit(2))).alias("run"), "distinct_names", "stable", F.lit(len(one.columns)).alias("columns"))


@_query(r"SELECT page_id, regexp_replace(url, '^([A-Za-z][A-Za-z0-9+.-]*://)[^/:?#]+', '\1h-' || substr(sha256(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1))), 1, 10) || '.example') AS url FROM pages")
def url_domain_rewrite(spark, sf_dir):
    """Hosts of all URLs replaced through a mapping of the distinct hosts."""
    from fieldglass.operators import paths

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    told = pages.select(P.url_host(F.col("url")).alias("key")).filter("key != ''").distinct().withColumn("pseudonym", F.concat(F.lit("h-"), F.substring(F.sha2("key", 256), 1, 10), F.lit(".example")))
    return paths.rewrite_host(F.col("url"), told, pages, "out").select("page_id", F.col("out").alias("url"))


@_query(r"SELECT * FROM (VALUES ('C:\Users\ann\x.txt', 'C:\Users\***\x.txt', 'ann'), ('/home/bo', '/home/***', 'bo'), ('/srv/home', '/srv/home', ''), ('\\s\users\Cy D\z', '\\s\users\*** D\z', 'Cy')) v(path, masked, who)")
def path_user_mask(spark, sf_dir):
    from fieldglass.operators import paths

    df = spark.createDataFrame([(x,) for x in (r"C:\Users\ann\x.txt", "/home/bo", "/srv/home", r"\\s\users\Cy D\z")], "path string")
    return df.select("path", paths.mask_home_user(F.col("path")).alias("masked"), paths.home_user(F.col("path")).alias("who"))


@_query("SELECT * FROM (VALUES ('AccountName', true), ('DeviceName_s', true), ('InitiatingProcessAccountUpn', true), ('ReportId', false), ('FolderPath', true), ('RemoteUrl', true), ('Protocol', false)) v(field, selected)")
def policy_match(spark, sf_dir):
    """The built-in policy of one table on field names."""
    from fieldglass.operators.policy import FieldPolicy, default_fields

    p = FieldPolicy(default_fields("DeviceEvents"))
    names = ["AccountName", "DeviceName_s", "InitiatingProcessAccountUpn", "ReportId", "FolderPath", "RemoteUrl", "Protocol"]
    return spark.createDataFrame([(n, n in p) for n in names], "field string, selected boolean")


@_query("SELECT event_id, count(*) OVER () AS n, 2 AS parts FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def nested_props(spark, sf_dir):
    """JSON members reached in a text column: rows with a member, their number, and the parts of an address split."""
    user, domain = S.split_email(F.lit("ann@x.test"))
    e = table(spark, sf_dir, "events").filter(F.get_json_object("props", "$.k").isNotNull())
    n = e.agg(F.count(F.lit(1)).alias("n"))
    return e.select("event_id", F.lit(1).alias("__one")).join(F.broadcast(n.withColumn("__one", F.lit(1))), "__one").select("event_id", "n", (F.when(user != "", 1).otherwise(0) + F.when(domain != "", 1).otherwise(0)).alias("parts"))


@_query("SELECT start, event_type, count(*) AS \"Count\" FROM (SELECT date_trunc('day', ts) AS start, event_type FROM events) GROUP BY 1, 2")
def daily_counts(spark, sf_dir):
    """Counts by day and type through the same windowed aggregation that streams use."""
    from fieldglass import streaming

    counts = streaming.windowed_counts(table(spark, sf_dir, "events"), "ts", "1 day", "1 hour", "event_type")
    return counts.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "Count")
