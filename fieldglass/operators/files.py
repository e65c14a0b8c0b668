"""Driver-side artifacts: owner-only atomic files, envelopes, sidecar names, signed requests."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import os
import tempfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame

from fieldglass.operators import schema as L


def write_atomically(path: str, pieces: Iterable[bytes]) -> None:
    """A file that appears whole or not at all, readable by its owner only; a failure leaves an earlier file alone."""
    folder = os.path.dirname(os.path.abspath(path))
    fd, temp = tempfile.mkstemp(dir=folder, prefix=".part-")
    try:
        os.fchmod(fd, 0o600)
        with os.fdopen(fd, "wb") as f:
            for piece in pieces:
                f.write(piece)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temp, path)
    except BaseException:
        Path(temp).unlink(missing_ok=True)
        raise


def _rows(df: DataFrame, nulls: bool = True) -> Iterable[str]:
    from pyspark.sql import functions as F

    for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": str(not nulls).lower()}).alias("j")).toLocalIterator(prefetchPartitions=True):
        yield r["j"]


def write_envelope(df: DataFrame, path: str, rows: int | None = None) -> int:
    """One JSON envelope of schema and rows, streamed partition by partition; the number of rows, which must be `rows` if that is given: else no file appears."""
    schema = json.dumps([{"Name": f.name, "Type": L.declared_type(f.dataType)} for f in df.schema.fields])

    written = 0

    def pieces():
        nonlocal written
        yield f'{{"Schema": {schema}, "Results": ['.encode()
        for row in _rows(df):
            yield (",\n" if written else "\n").encode() + row.encode()
            written += 1
        if rows is not None and written != rows:
            raise ValueError(f"{written} rows came, {rows} were counted")
        yield b"\n]}\n"

    write_atomically(path, pieces())
    return written


def write_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line."""
    write_atomically(path, ((row + "\n").encode() for row in _rows(df)))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One JSON document of a graph's nodes and edges, streamed."""

    def pieces():
        for i, (name, df) in enumerate((("nodes", nodes), ("edges", edges))):
            yield ((", " if i else '{"graph": {') + f'"{name}": [').encode()
            for k, row in enumerate(_rows(df, nulls=False)):
                yield (",\n" if k else "\n").encode() + row.encode()
            yield b"]"
        yield b"}}\n"

    write_atomically(path, pieces())


def write_icons(icons: DataFrame, path: str) -> bool:
    """The icon of each kind as one JSON document of custom types; without kinds no file, and False."""
    types = {r["kind"]: {"icon": {"type": "font-awesome", "name": r["icon"], "color": r["colour"]}} for r in icons.orderBy("kind").toLocalIterator()}
    if types:
        write_atomically(path, [json.dumps({"custom_types": types}).encode()])
    return bool(types)


def sidecars(path: str) -> tuple[str, str]:
    """Names of the line file and of the schema script beside an output."""
    base = path[: -len(".json")] if path.endswith(".json") else path
    return f"{base}.adx.json", f"{base}.adx.kql"


def graph_sidecars(path: str) -> tuple[str, str]:
    base = path[: -len(".json")] if path.endswith(".json") else path
    return f"{base}.opengraph.json", f"{base}.opengraph.icons.json"


def default_table(path: str) -> str:
    """A table name from a file name."""
    name = Path(path).name.split(".")[0]
    return L.safe_names([name])[0] if name else "Results"


def table_commands(df: DataFrame, table: str, mapping: str) -> list[str]:
    """The statements that create a table and its JSON mapping for an export of `df`."""
    fields = [f for f in df.schema.fields if not f.name.endswith("@odata.type")]
    names, kinds = L.safe_names([f.name for f in fields]), [L.export_type(L.declared_type(f.dataType)) for f in fields]
    columns = ", ".join(f"{n}:{k}" for n, k in zip(names, kinds, strict=True))
    mapped = json.dumps([{"column": n, "datatype": k, "Properties": {"Path": L.json_path(f.name)}} for n, k, f in zip(names, kinds, fields, strict=True)])
    quoted = mapped.replace("'", "''")
    return [f".create table {table} ({columns})", f".create-or-alter table {table} ingestion json mapping \"{mapping}\" '{quoted}'"]


def schema_script(df: DataFrame, table: str, mapping: str, data_file: str) -> str:
    """The same statements as a script, with the file that they are for."""
    return "\n".join([*table_commands(df, table, mapping), f"// data: {data_file}, format json", ""])


def signature(token_key: str, when: str, method: str, uri: str, body: bytes = b"") -> str:
    """A request signature in base64: HMAC-SHA256 over method and path with the key (given in base64), over the request's date with the result, and over the body with that."""
    digest = base64.b64decode(token_key, validate=True)
    for part in (f"{method.upper()}{uri}".encode(), when.encode(), body):
        digest = hmac.new(digest, part, hashlib.sha256).digest()
    return base64.b64encode(digest).decode()


def ingest_failures(reply: dict) -> list[str]:
    """What an ingest reply complains of: rows in an exception table, or only all-zero extent ids."""
    out = []
    for t in reply.get("Tables", []):
        if "exception" in str(t.get("TableName", "")).lower() and t.get("Rows"):
            out.append("the reply has exceptions")
        at = next((i for i, c in enumerate(t.get("Columns", [])) if c.get("ColumnName", "").lower() == "extentid"), None)
        if at is not None and t.get("Rows") and all(str(r[at]).replace("0", "").replace("-", "") == "" for r in t["Rows"]):
            out.append("nothing was ingested: every extent id is zero")
    return out
