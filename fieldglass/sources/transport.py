"""Requests to query, ingest and graph services: what is sent, how throttling is waited out, and what replies mean.

Each function takes `send`, so that another client, or a test's, can take the place of `http`. Replies of queries go to the
folder that all executors share and are read from there; rows to ingest are sent by the tasks that hold them.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.operators import files
from fieldglass.operators.staging import shared_dir
from fieldglass.sources import envelopes


class RequestError(RuntimeError):
    """A request that a service refused."""

    def __init__(self, what: str, code: int, body: str):
        super().__init__(f"{what} failed: {code}: {body.strip()[:500]}")
        self.code, self.body = code, body


@dataclass(frozen=True)
class Reply:
    code: int
    body: bytes
    headers: dict[str, str] = field(default_factory=dict)

    def checked(self, what: str) -> bytes:
        if not 200 <= self.code < 300:
            raise RequestError(what, self.code, self.body.decode(errors="replace"))
        return self.body


Send = Callable[[str, str, dict[str, str], bytes], Reply]


def http(method: str, url: str, headers: dict[str, str], body: bytes, timeout: float = 60.0) -> Reply:
    """One HTTP request; codes that mean failure are replies like any other."""
    request = urllib.request.Request(url, data=body if method != "GET" else None, headers=headers, method=method)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return Reply(r.status, r.read(), dict(r.headers))
    except urllib.error.HTTPError as e:
        return Reply(e.code, e.read(), dict(e.headers))


def _json_headers(token: str, **more: str) -> dict[str, str]:
    return {"Content-Type": "application/json", "Accept": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {}) | more


def post_query(send: Send, url: str, token: str, body: dict, wait: Callable[[float], None] = time.sleep, **headers: str) -> Reply:
    """Posts a query as JSON, and again after each reply that asks to slow down, as long as these come."""
    throttled = 0
    while (reply := send("POST", url, _json_headers(token, **headers), json.dumps(body).encode())).code == 429:
        throttled += 1
        wait(envelopes.retry_delay(reply.headers, reply.body.decode(errors="replace"), throttled))
    return reply


def _kept(spark: SparkSession, body: bytes) -> str:
    """A reply in the shared folder."""
    path = f"{shared_dir(spark)}/reply-{uuid.uuid4().hex}.json"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    try:
        out.write(body)
    finally:
        out.close()
    return path


def hunt(spark: SparkSession, send: Send, endpoint: str, token: str, text: str, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """The result of a query at a service whose rows are objects."""
    reply = post_query(send, f"{endpoint}/security/runHuntingQuery", token, {"Query": text}, wait)
    return envelopes.read_named(spark, _kept(spark, reply.checked("query")))


def workspace(spark: SparkSession, send: Send, url: str, token: str, text: str, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """The result of a query at a service whose rows are lists; it is asked to take its time."""
    reply = post_query(send, url, token, {"query": text}, wait, Prefer="wait=600")
    return envelopes.read_positional(spark, _kept(spark, reply.checked("query")))


def manage(send: Send, cluster: str, database: str, token: str, command: str) -> None:
    """Runs one management command; exceptions in the reply, and an ingest without any extent, are errors."""
    what = f"command {command[:80]!r}"
    body = send("POST", f"{cluster}/v1/rest/mgmt", _json_headers(token), json.dumps({"db": database, "csl": command}).encode()).checked(what)
    try:
        told = json.loads(body)
    except ValueError:
        return
    found = files.ingest_failures(told if command.lstrip().startswith(".ingest inline") else {"Tables": [t | {"Columns": []} for t in told.get("Tables", [])]})
    if found:
        raise RequestError(what, 200, "; ".join(found))


def ensure_table(send: Send, cluster: str, database: str, token: str, table: str, mapping: str, df: DataFrame) -> None:
    """Creates the table and the mapping that rows of `df` need."""
    for command in files.table_commands(df, table, mapping):
        manage(send, cluster, database, token, command)


def ingest(send: Send, cluster: str, database: str, token: str, table: str, mapping: str, df: DataFrame, size: int = 500) -> tuple[int, int]:
    """(batches, rows) sent inline as one JSON object a line, `size` rows at most in a batch.

    Each task sends its own rows, so none pass the driver. A batch is sent at least once: a task that is run again, as when
    its executor was lost, sends its rows again.
    """
    head = f".ingest inline into table {table} with (format='json', ingestionMappingReference='{mapping.replace(chr(39), chr(39) * 2)}') <|\n"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = b.column(0).to_pylist()
            for at in range(0, len(lines), size):
                part = lines[at : at + size]
                manage(send, cluster, database, token, head + "".join(f"{x}\n" for x in part))
                yield pa.RecordBatch.from_arrays([pa.array([len(part)], pa.int64())], names=["n"])

    lines = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line"))
    sent = lines.mapInArrow(run, "n long").agg(F.count("n").alias("batches"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    return sent["batches"], sent["rows"]


class GraphService:
    """A graph service that takes files in jobs and icons by kind; requests carry a token or a signature."""

    def __init__(self, send: Send, url: str, token: str | None = None, token_id: str | None = None, token_key: str | None = None, now: Callable[[], datetime] = lambda: datetime.now(UTC)):
        if not token and not (token_id and token_key):
            raise ValueError("give a token, or a token id and its key")
        self.send, self.url, self.token, self.token_id, self.token_key, self.now = send, url.rstrip("/"), token, token_id, token_key, now

    def _ask(self, what: str, method: str, path: str, body: bytes = b"", **headers: str) -> bytes:
        if self.token:
            own = {"Authorization": f"Bearer {self.token}"}
        else:
            when, uri = self.now().strftime("%Y-%m-%dT%H:%M:%SZ"), urllib.parse.urlsplit(self.url + path).path
            own = {"Authorization": f"bhesignature {self.token_id}", "RequestDate": when, "Signature": files.signature(self.token_key, when, method, uri, body)}
        return self.send(method, self.url + path, own | {"Accept": "application/json"} | headers, body).checked(what)

    def upload(self, path: str) -> int:
        """Sends a file in a job of its own: start, send, end; the job's number."""
        with open(path, "rb") as f:
            body = f.read()
        job = (json.loads(self._ask("start of an upload", "POST", "/api/v2/file-upload/start")).get("data") or {}).get("id")
        if not job:
            raise RequestError("start of an upload", 200, "the reply names no job")
        kind = "application/zip" if path.lower().endswith(".zip") else "application/json"
        self._ask("upload", "POST", f"/api/v2/file-upload/{job}", body, **{"Content-Type": kind, "X-File-Upload-Name": os.path.basename(path)})
        self._ask("end of an upload", "POST", f"/api/v2/file-upload/{job}/end")
        return job

    def icons(self, wanted: dict[str, dict]) -> tuple[int, int]:
        """Creates the kinds that the service lacks and updates the others: (created, updated)."""
        if not wanted:
            raise ValueError("there are no kinds to send")
        listed = json.loads(self._ask("list of kinds", "GET", "/api/v2/custom-nodes")).get("data") or []
        known = {k["kindName"] for k in listed if isinstance(k, dict) and k.get("kindName")}
        new = {k: v for k, v in wanted.items() if k not in known}
        as_json = {"Content-Type": "application/json"}
        if new:
            self._ask("creation of kinds", "POST", "/api/v2/custom-nodes", json.dumps({"custom_types": new}).encode(), **as_json)
        old = sorted(wanted.keys() & known)
        for kind in old:
            self._ask(f"update of kind {kind}", "PUT", f"/api/v2/custom-nodes/{urllib.parse.quote(kind, safe='')}", json.dumps({"config": wanted[kind]}).encode(), **as_json)
        return len(new), len(old)
