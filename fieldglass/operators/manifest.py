"""The collection manifest: what was captured, what was empty, what failed, what the source lacks."""

from __future__ import annotations

import hashlib
import json
import os
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.operators import schema as L
from fieldglass.operators.files import write_atomically

STATUSES = ("captured", "captured_empty", "not_captured", "absent_in_source")
_TABLE = {"source", "name", "status", "rows", "columns", "file", "sha256", "bytes", "query", "window_start", "window_end", "captured_at", "note"}
_TOP = {"version", "tool_version", "pseudonymized", "key_id", "updated_at", "tables"}


class ManifestError(ValueError):
    """A manifest that breaks one of its rules."""


def status(rows: int | None, absent: bool = False) -> str:
    """captured with rows, captured_empty without, absent_in_source if the source has no such table, else not_captured."""
    return "absent_in_source" if absent else "not_captured" if rows is None else "captured" if rows else "captured_empty"


def failure_note(error: BaseException | None, pseudonymised: bool) -> str:
    """What is said of a failure: with pseudonymisation only its class, as messages may quote data."""
    if error is None:
        return ""
    return type(error).__name__ if pseudonymised else f"{type(error).__name__}: {error}"[:500]


def columns(df: DataFrame) -> list[dict]:
    return [{"name": f.name, "type": L.export_type(L.declared_type(f.dataType))} for f in df.schema.fields]


#: Rules of an entry: a name, and what must hold.
RULES = [
    ("source and name are texts", lambda t: all(isinstance(t.get(k), str) and t[k].strip() for k in ("source", "name"))),
    ("no unknown fields", lambda t: not set(t) - _TABLE),
    ("the status is known", lambda t: t.get("status") in STATUSES),
    ("captured has rows", lambda t: t.get("status") != "captured" or isinstance(t.get("rows"), int) and t["rows"] > 0),
    ("captured_empty has no rows", lambda t: t.get("status") != "captured_empty" or t.get("rows") == 0),
    ("others have no count", lambda t: t.get("status") in ("captured", "captured_empty") or t.get("rows") is None),
    ("captured has a file with digest and size", lambda t: t.get("status") not in ("captured", "captured_empty") or bool(t.get("file")) and isinstance(t.get("sha256"), str) and len(t["sha256"]) == 64 and set(t["sha256"]) <= set("0123456789abcdef") and isinstance(t.get("bytes"), int) and t["bytes"] >= 0),
    ("others have no file", lambda t: t.get("status") in ("captured", "captured_empty") or not any(t.get(k) for k in ("file", "sha256", "bytes"))),
    ("the file is relative and inside", lambda t: not t.get("file") or not os.path.isabs(t["file"]) and ".." not in Path(t["file"]).parts),
    ("captured has columns", lambda t: t.get("status") != "captured" or bool(t.get("columns"))),
    ("columns have unique names and types", lambda t: all(isinstance(c, dict) and set(c) == {"name", "type"} and c["name"] for c in t.get("columns") or []) and len({c["name"] for c in t.get("columns") or []}) == len(t.get("columns") or [])),
    ("not_captured says why", lambda t: t.get("status") != "not_captured" or bool(t.get("note"))),
    ("only failures have notes", lambda t: t.get("status") in ("not_captured", "absent_in_source") or not t.get("note")),
    ("the window has both ends in order", lambda t: (t.get("window_start") is None) == (t.get("window_end") is None) and (t.get("window_start") or "") <= (t.get("window_end") or "")),
    ("a time of capture", lambda t: isinstance(t.get("captured_at"), str) and bool(t["captured_at"])),
]


def broken_rules(entry: dict) -> list[str]:
    return [name for name, holds in RULES if not holds(entry)]


class Manifest:
    def __init__(self, pseudonymised: bool = False, key_id: str | None = None, tables: list[dict] | None = None):
        self.pseudonymised, self.key_id, self.tables = pseudonymised, key_id, tables or []

    @classmethod
    def open(cls, path: str, pseudonymised: bool = False, key_id: str | None = None) -> Manifest:
        """The manifest in a file, checked whole, or a new one; an existing one must have the same pseudonymisation."""
        if not os.path.exists(path):
            return cls(pseudonymised, key_id)
        d = json.loads(Path(path).read_bytes())
        if not isinstance(d, dict) or set(d) - _TOP or d.get("version") != 1 or not isinstance(d.get("tables"), list):
            raise ManifestError("not a manifest of a known version")
        if bool(d.get("pseudonymized")) != pseudonymised or d.get("key_id") != key_id:
            raise ManifestError("the manifest has another pseudonymisation")
        made = cls(pseudonymised, key_id, d["tables"])
        made.check()
        return made

    def check(self) -> None:
        if self.pseudonymised != bool(self.key_id):
            raise ManifestError("a key id goes with pseudonymisation")
        for t in self.tables:
            if found := broken_rules(t):
                raise ManifestError(f"{t.get('source')}/{t.get('name')}: {'; '.join(found)}")
            if self.pseudonymised and t.get("query"):
                raise ManifestError("a pseudonymised manifest has no query texts")
        if len({(t["source"], t["name"]) for t in self.tables}) < len(self.tables):
            raise ManifestError("a table is there twice")

    def record(self, entry: dict) -> None:
        """Adds an entry or replaces the one of the same source and name; a bad one changes nothing."""
        entry = {"captured_at": datetime.now(UTC).isoformat(), **entry}
        if self.pseudonymised:
            entry.pop("query", None)
        old = self.tables
        self.tables = [t for t in old if (t["source"], t["name"]) != (entry.get("source"), entry.get("name"))] + [entry]
        try:
            self.check()
        except ManifestError:
            self.tables = old
            raise

    def save(self, path: str) -> None:
        self.check()
        d = {"version": 1, "pseudonymized": self.pseudonymised, **({"key_id": self.key_id} if self.key_id else {}), "updated_at": datetime.now(UTC).isoformat(), "tables": sorted(self.tables, key=lambda t: (t["source"], t["name"]))}
        write_atomically(path, [json.dumps(d, indent=2).encode()])


def describe(path: str, manifest_path: str) -> dict:
    """File, digest and size of an artifact; the path is relative to the manifest."""
    body = Path(path)
    h = hashlib.sha256()
    with body.open("rb") as f:
        while chunk := f.read(1 << 20):
            h.update(chunk)
    return {"file": os.path.relpath(path, os.path.dirname(os.path.abspath(manifest_path))), "sha256": h.hexdigest(), "bytes": body.stat().st_size}


def describe_folder(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256, bytes) of each file of a folder, read by the executors."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entries as tables: those of `new` replace those of the same source and name."""
    return old.join(new, ["source", "name"], "left_anti").unionByName(new, allowMissingColumns=True)


def table_statuses(counts: DataFrame) -> DataFrame:
    """(name, rows, status) from (name, rows, absent)."""
    s = F.when(F.col("absent"), "absent_in_source").when(F.col("rows").isNull(), "not_captured").when(F.col("rows") > 0, "captured").otherwise("captured_empty")
    return counts.select("name", F.when(F.col("absent"), None).otherwise(F.col("rows")).alias("rows"), s.alias("status"))
