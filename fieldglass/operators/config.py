"""Settings: a dotenv file under environment variables under explicit values, and which settings need or exclude which."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from pathlib import Path

from fieldglass.functions.scalar import lookback_microseconds
from fieldglass.operators import files

_IDENTIFIER = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$", re.ASCII)
_LINE = re.compile(r"""^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*$""")


class ConfigError(ValueError):
    """Settings that can't be read or contradict each other."""


def load_dotenv(path: str) -> dict[str, str]:
    """NAME=value lines; comments, quotes and an export word are understood, anything else is an error with its line."""
    out = {}
    for n, line in enumerate(Path(path).read_text().splitlines(), 1):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        m = _LINE.match(line)
        if not m:
            raise ConfigError(f"{path}:{n}: not NAME=value")
        value = m[2]
        if value[:1] in ("'", '"'):
            end = re.match(r"""("(?:[^"\\]|\\.)*"|'[^']*')\s*(?:#.*)?$""", value)
            if not end:
                raise ConfigError(f"{path}:{n}: the quotation isn't closed")
            value = end[1][1:-1] if value[0] == "'" else re.sub(r"\\(.)", lambda e: {"n": "\n", "t": "\t"}.get(e[1], e[1]), end[1][1:-1])
        else:
            value = re.sub(r"\s+#.*$", "", value)
        out[m[1]] = value
    return out


def setting(name: str, given: str | None, dotenv: Mapping[str, str], *variables: str, default: str | None = None) -> str | None:
    """The first there is: the value given, an environment variable, a dotenv line, the default."""
    if given:
        return given
    return next((v for source in (os.environ, dotenv) for k in variables if (v := source.get(k))), default)


def read_query(text: str | None, path: str | None) -> str:
    """A query text, inline or from a file, not both, and not empty."""
    if bool(text) == bool(path):
        raise ConfigError("give a query text or a query file")
    body = (text or Path(path).read_text()).strip()
    if not body:
        raise ConfigError("the query is empty")
    return body


def artifacts(settings: Mapping) -> list[str]:
    """The files that a collection with these settings writes."""
    out = settings.get("out")
    if not out:
        return []
    return [out, *(files.sidecars(out) if settings.get("sidecars") else ()), *(files.graph_sidecars(out) if settings.get("graph") else ())]


def _apart(c: Mapping) -> bool:
    """Do all files that are read or written differ?"""
    paths = [os.path.realpath(p) for p in (*artifacts(c), *(c[k] for k in ("vault", "phrases", "manifest", "query_file") if c.get(k)))]
    return len(set(paths)) == len(paths)


def _query(c: Mapping) -> bool:
    return bool(c.get("query") or c.get("query_file"))


def _named(c: Mapping, *names: str) -> bool:
    return all(not c.get(n) or bool(_IDENTIFIER.match(c[n])) for n in names)


def _needs(c: Mapping, what: str, *needed: str) -> bool:
    return not c.get(what) or all(c.get(n) for n in needed)


def _span(c: Mapping) -> bool:
    try:
        return not c.get("lookback") or lookback_microseconds(c["lookback"]) > 0
    except ValueError:
        return False


def _sends_graph(c: Mapping) -> bool:
    return bool(c.get("graph_upload") or c.get("graph_file") or c.get("icon_file"))


#: Rules between settings: what must hold of them together.
RULES = [
    ("a table or a query, not both", lambda c: not (c.get("table") and _query(c))),
    ("a query text or a query file, not both", lambda c: not (c.get("query") and c.get("query_file"))),
    ("a table, a time column, a target table and mapping are plain names", lambda c: _named(c, "table", "time_column", "ingested", "ingest_table", "ingest_mapping", "manifest_table")),
    ("a look-back is a number and d, h, m, s or ms", _span),
    ("a look-back needs a table", lambda c: not c.get("lookback") or bool(c.get("table"))),
    ("a service needs an endpoint and a query", lambda c: c.get("source") not in ("hunt", "workspace") or bool(c.get("endpoint")) and _query(c)),
    ("a vault's mode, file names, phrases, fields and retention need pseudonymisation", lambda c: bool(c.get("vault")) or not any(c.get(k) for k in ("irreversible", "filenames", "phrases", "fields", "retention"))),
    ("pseudonymisation needs a table or a query", lambda c: not c.get("vault") or bool(c.get("table")) or _query(c)),
    ("retention is keep or delete", lambda c: c.get("retention") in (None, "", "keep", "delete")),
    ("the row limit is 1 to 100000", lambda c: 0 < int(1 if c.get("limit") is None else c["limit"]) <= 100_000),
    ("a batch has a row or more", lambda c: int(1 if c.get("batch") is None else c["batch"]) > 0),
    ("a manifest needs a table or a query", lambda c: not c.get("manifest") or bool(c.get("table")) or _query(c)),
    ("a manifest of a query needs a name for it, that of a table has one", lambda c: not c.get("manifest") or bool(c.get("manifest_table")) == _query(c)),
    ("a name in a manifest needs a manifest", lambda c: _needs(c, "manifest_table", "manifest")),
    ("ingest needs a cluster, a database and a table", lambda c: not (c.get("ingest") or c.get("ingest_file")) or all(c.get(k) for k in ("cluster", "database", "ingest_table"))),
    ("what was collected needs graph files to be uploaded", lambda c: _needs(c, "graph_upload", "graph")),
    ("a graph upload needs an address", lambda c: not _sends_graph(c) or bool(c.get("graph_url"))),
    ("a graph upload needs a token, or a token id and its key", lambda c: not _sends_graph(c) or bool(c.get("graph_token") or c.get("graph_token_id") and c.get("graph_token_key"))),
    ("outputs and inputs are different files", _apart),
]


def check(settings: Mapping) -> None:
    broken = [name for name, holds in RULES if not holds(settings)]
    if broken:
        raise ConfigError("; ".join(broken))
