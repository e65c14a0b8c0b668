"""The collection of one table from end to end: window, plan, pseudonyms, parts, artifacts, vault and manifest."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from fieldglass.operators import collect, files, graph, manifest, pseudonyms
from fieldglass.operators.policy import FieldPolicy, default_fields
from fieldglass.operators.vault import Vault
from fieldglass.plans import pipe_language
from fieldglass.sources.envelopes import Tables


def finish(df: DataFrame, source: str, name: str, out: str, limit: int, vault: Vault | None, vault_path: str | None, policy: FieldPolicy | None, record: manifest.Manifest | None, manifest_path: str | None, extra: dict, sidecars: bool = False, graph_files: bool = False, options: pseudonyms.Options = pseudonyms.Options()) -> collect.Plan:
    """Plan, pseudonyms, parts, envelope, sidecars and manifest. A row's bucket is fixed on the row as it was counted and goes with it."""
    planned = collect.plan(df, limit)
    if planned.buckets is not None:
        df = collect.with_bucket(df, planned.buckets)
    if vault is not None:
        df = pseudonyms.pseudonymise(df, policy or FieldPolicy(default_fields(name)), vault, options=options)
        vault.save(vault_path)  # before any data: a later failure leaves mappings too many, never too few
    if planned.buckets is not None:
        collect.collect_to(df, f"{out}.parts", planned)
        df = df.sparkSession.read.schema(df.schema).parquet(f"{out}.parts").drop("DumpPartition")  # what was checked, not computed again
    files.write_envelope(df, out, planned.total)
    if sidecars:
        lines, script = files.sidecars(out)
        files.write_lines(df, lines)
        files.write_atomically(script, [files.schema_script(df, files.default_table(out), f"{files.default_table(out)}_json", lines).encode()])
    if graph_files:
        graph_path, icons = files.graph_sidecars(out)
        made, links = graph.payload(df)
        files.write_graph(*graph.exported(made, links), graph_path)
        files.write_icons(graph.icons(made), icons)
    if record is not None:
        entry = {"source": source, "name": name, "status": manifest.status(planned.total), "rows": planned.total, "columns": manifest.columns(df), **manifest.describe(out, manifest_path), **extra}
        record.record(entry)
        record.save(manifest_path)
    return planned


def collect_table(source: Tables, name: str, column: str, lookback: str, cutoff: datetime, out: str, limit: int = collect.ROW_LIMIT, vault: Vault | None = None, vault_path: str | None = None, policy: FieldPolicy | None = None, record: manifest.Manifest | None = None, manifest_path: str | None = None, sidecars: bool = False, graph_files: bool = False, options: pseudonyms.Options = pseudonyms.Options()) -> collect.Plan | None:
    """Collects one table's window; a table that the source lacks is recorded as absent and gives None, a failure is recorded and raised."""
    if not source.exists(name):
        if record is not None:
            record.record({"source": "tables", "name": name, "status": "absent_in_source", "note": "no such table"})
            record.save(manifest_path)
        return None
    try:
        df = collect.window(source.table(name), column, lookback, cutoff)
        return finish(df, "tables", name, out, limit, vault, vault_path, policy, record, manifest_path, {"window_end": cutoff.isoformat(), "window_start": (cutoff - _span(lookback)).isoformat()}, sidecars, graph_files, options)
    except Exception as error:
        if record is not None:
            record.record({"source": "tables", "name": name, "status": "not_captured", "note": manifest.failure_note(error, vault is not None)})
            record.save(manifest_path)
        raise


def _span(lookback: str):
    from datetime import timedelta

    from fieldglass.functions.scalar import lookback_microseconds

    return timedelta(microseconds=lookback_microseconds(lookback))


def collect_query(source: Tables, text: str, name: str, out: str, limit: int = collect.ROW_LIMIT, vault: Vault | None = None, vault_path: str | None = None, policy: FieldPolicy | None = None, record: manifest.Manifest | None = None, manifest_path: str | None = None, sidecars: bool = False, graph_files: bool = False, options: pseudonyms.Options = pseudonyms.Options()) -> collect.Plan:
    """Collects the result of a query text in the same way, without a window."""
    return finish(pipe_language.query(text, source.table), "query", name, out, limit, vault, vault_path, policy, record, manifest_path, {"query": text}, sidecars, graph_files, options)
