"""Commands: collect a table or a query's result, ingest rows, send graph files. `python -m fieldglass --help` names the settings.

A setting comes from the command line, else from the environment (FIELDGLASS_ and its name), else from a dotenv file.
"""

from __future__ import annotations

import argparse
import sys
from datetime import UTC, datetime

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from fieldglass.operators import collect, config, files, manifest, pseudonyms, recognise, run
from fieldglass.operators.policy import FieldPolicy
from fieldglass.operators.vault import Vault
from fieldglass.sources import envelopes, transport

#: Name, kind of value, what it says.
SETTINGS = [
    ("source", str, "folder, catalog, hunt or workspace"), ("folder", str, "Parquet files of a folder source"), ("endpoint", str, "address of a service"), ("token", str, "its bearer token"),
    ("table", str, "table to collect"), ("time_column", str, "its time column"), ("lookback", str, "length of the window"), ("cutoff", str, "its end, now if left out"),
    ("ingested", str, "column of arrival times"), ("query", str, "query text"), ("query_file", str, "file with it"), ("out", str, "result"), ("limit", int, "rows of a part"),
    ("sidecars", bool, "lines and table script too"), ("graph", bool, "graph and icon files too"), ("manifest", str, "manifest file"), ("manifest_table", str, "name of a query in it"),
    ("vault", str, "vault file: pseudonymise"), ("irreversible", bool, "keep no originals in it"), ("retention", str, "keep or delete it"), ("fields", str, "field patterns"), ("filenames", bool, "replace file names too"), ("phrases", str, "file of phrases"),
    ("ingest", bool, "ingest what was collected"), ("ingest_file", str, "ingest a file"), ("cluster", str, "where to"), ("database", str, ""), ("ingest_table", str, ""), ("ingest_mapping", str, ""), ("ingest_token", str, ""), ("batch", int, "rows of a batch"),
    ("graph_url", str, "graph service"), ("graph_token", str, ""), ("graph_token_id", str, ""), ("graph_token_key", str, ""), ("graph_upload", bool, "send the graph files made"), ("graph_file", str, "send a graph file"), ("icon_file", str, "send an icon file"),
]


def settings(argv: list[str]) -> dict:
    """All settings by name, checked against each other."""
    parser = argparse.ArgumentParser("fieldglass")
    parser.add_argument("--dotenv")
    for name, kind, says in SETTINGS:
        more = {"action": "store_const", "const": "true"} if kind is bool else {}
        parser.add_argument("--" + name.replace("_", "-"), help=says, **more)
    given = vars(parser.parse_args(argv))
    dotenv = config.load_dotenv(given["dotenv"]) if given["dotenv"] else {}
    found = {}
    for name, kind, _ in SETTINGS:
        value = config.setting(name, given[name], dotenv, f"FIELDGLASS_{name.upper()}")
        try:
            found[name] = value if value is None or kind is str else int(value) if kind is int else value.strip().lower() in ("1", "true", "yes")
        except ValueError:
            raise config.ConfigError(f"{name} isn't a number") from None
    config.check(found)
    return found


def _collected(spark: SparkSession, c: dict) -> None:
    source = envelopes.Tables(spark, c["folder"])
    vault = Vault.open(c["vault"], bool(c["irreversible"])) if c["vault"] else None
    phrases = recognise.Phrases.load(c["phrases"]) if c["phrases"] else None
    how = {
        "limit": c["limit"] or collect.ROW_LIMIT, "vault": vault, "vault_path": c["vault"], "policy": FieldPolicy(c["fields"]) if c["fields"] else None, "manifest_path": c["manifest"],
        "record": manifest.Manifest.open(c["manifest"], vault is not None, vault.key_id if vault else None) if c["manifest"] else None,
        "sidecars": bool(c["sidecars"]), "graph_files": bool(c["graph"]), "options": pseudonyms.Options(bool(c["filenames"]), phrases),
    }
    if not c["out"]:
        raise config.ConfigError("a collection needs an output file")
    if c["table"]:
        if not (c["time_column"] and c["lookback"]):
            raise config.ConfigError("a table needs a time column and a look-back")
        cutoff = datetime.fromisoformat(c["cutoff"]) if c["cutoff"] else datetime.now(UTC).replace(tzinfo=None)
        made = run.collect_table(source, c["table"], c["time_column"], c["lookback"], cutoff, c["out"], **how)
    else:
        text, name = config.read_query(c["query"], c["query_file"]), c["manifest_table"] or "query"
        if c["source"] in ("hunt", "workspace"):
            ask = transport.hunt if c["source"] == "hunt" else transport.workspace
            df = ask(spark, transport.http, c["endpoint"], c["token"] or "", text)
            limit, record = how.pop("limit"), how.pop("record")
            made = run.finish(df, c["source"], name, c["out"], limit, how.pop("vault"), how.pop("vault_path"), how.pop("policy"), record, how.pop("manifest_path"), {"query": text}, **how)
        else:
            made = run.collect_query(source, text, name, c["out"], **how)
    print("absent in the source" if made is None else f"{made.total} rows in {c['out']}")
    if vault is not None and c["retention"]:
        vault.finish(c["vault"], c["retention"])


def _ingested(spark: SparkSession, c: dict) -> None:
    df = envelopes.read_ingest(spark, c["ingest_file"] or c["out"])
    to = (transport.http, c["cluster"], c["database"], c["ingest_token"] or "")
    mapping = c["ingest_mapping"] or f"{c['ingest_table']}_json"
    transport.ensure_table(*to, c["ingest_table"], mapping, df)
    batches, rows = transport.ingest(*to, c["ingest_table"], mapping, df, c["batch"] or 500)
    print(f"{rows} rows ingested in {batches} batches")


def _sent(c: dict) -> None:
    import json
    import os

    service = transport.GraphService(transport.http, c["graph_url"], c["graph_token"], c["graph_token_id"], c["graph_token_key"])
    graph, icons = files.graph_sidecars(c["out"]) if c["graph_upload"] else (c["graph_file"], c["icon_file"])
    if icons and os.path.exists(icons):  # a graph without kinds has no icons
        with open(icons) as f:
            print("icons created and updated:", *service.icons(json.load(f).get("custom_types") or {}))
    if graph:
        print(f"graph sent as job {service.upload(graph)}")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0, or 1 and a line that says what is wrong."""
    try:
        c = settings(sys.argv[1:] if argv is None else argv)
        asked = c["table"] or c["query"] or c["query_file"]
        if asked or c["ingest_file"]:
            spark = spark or SparkSession.builder.appName("fieldglass").getOrCreate()
        if asked:
            _collected(spark, c)
        if c["ingest_file"] or c["ingest"] and asked:
            _ingested(spark, c)
        if c["graph_upload"] or c["graph_file"] or c["icon_file"]:
            _sent(c)
    except (ValueError, OSError, RuntimeError, PySparkException) as error:
        print(f"error: {str(error).splitlines()[0] if str(error) else type(error).__name__}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
