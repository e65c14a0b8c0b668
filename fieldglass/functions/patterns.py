"""Patterns of entities in free text, with ASCII word boundaries in every engine."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_B, _E = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"
#: Patterns (fixed values) as text between word boundaries.
CORES = {
    "email": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,63}",
    "sid": r"[Ss]-[0-9]+(?:-[0-9]+){2,15}",
    "guid": r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}",
    "mac": r"(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}",
    "ipv4": r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}",
    "ipv6": r"(?:[0-9A-Fa-f]{1,4}:){2,7}[0-9A-Fa-f]{0,4}",
    "phone": r"[0-9][0-9 .()\-]{6,}[0-9]",
    "domain": r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,63}",
}
#: The same for an engine with ASCII word boundaries of its own.
SQL = {n: rf"\b{CORES[n]}\b" for n in ("email", "sid", "guid", "mac", "ipv4", "phone")}
PYTHON = {n: re.compile(rf"\b{p}\b", re.ASCII) for n, p in CORES.items()}
#: File-like endings that no domain has (fixed values).
NOT_DOMAINS = frozenset("bak bat bin cfg cmd conf csv dll doc docx env exe gif gz ini jpeg jpg js json kql lock log md msi pdf png ps1 py sh sql svg tar tmp toml ts txt xls xlsx xml yaml yml zip".split())


def matches(name: str, c: Column) -> Column:
    """All matches of a pattern in order, each where an ASCII word begins and ends."""
    first = "" if name == "email" else _B
    begin = rf"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))" if name == "email" else first
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"{begin}{CORES[name]}{_E}"), F.lit(0))


def count(name: str, c: Column) -> Column:
    return F.size(matches(name, c))


def url_host(c: Column) -> Column:
    """The host in a URL with a scheme, in lower case; empty for anything else."""
    return F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1))


def replace_phrase(c: Column, phrase: str, replacement: str, whole_words: bool = True, case_sensitive: bool = False) -> Column:
    """One literal phrase replaced, whole words in any case by default."""
    begin = _B if whole_words and (phrase[:1].isalnum() or phrase[:1] == "_") else ""
    end = _E if whole_words and (phrase[-1:].isalnum() or phrase[-1:] == "_") else ""
    flags = "" if case_sensitive else "(?iu)"
    return F.regexp_replace(c, f"{flags}{begin}{re.escape(phrase)}{end}", replacement.replace("\\", "\\\\").replace("$", "\\$"))
