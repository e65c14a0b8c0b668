"""Paths, file-name families, domains in URLs, and names in prose."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.functions import digest as D
from fieldglass.functions import patterns as P
from fieldglass.functions import scalar as S
from fieldglass.functions.scalar import normalised_field
from fieldglass.operators import command_lines as M
from fieldglass.operators import recognise as N

_HOME = r"(?i)([/\\](?:home|users)[/\\])([^/\\\s]+)"
_LAST = re.compile(r"[^/\\]+(?=[/\\]*$)")
_EDGE = r"[A-Za-z0-9_.-]"


def home_user(c: Column) -> Column:
    """The user in a home-directory path, empty if it is none."""
    return F.regexp_extract(c, _HOME, 2)


def mask_home_user(c: Column, replacement: str = "***") -> Column:
    return F.regexp_replace(c, _HOME, "$1" + replacement.replace("$", "\\$"))


def path_spans(field: str, text: str, filenames: bool = False, phrases: N.Phrases | None = None) -> list[N.Span]:
    """Spans of a path field: phrases, the home directory's user, and for some fields the last segment.

    The last segment is a user in home-directory and profile fields, and a file name (opt-in) in file paths and shares.
    """
    name = normalised_field(field)
    found = (phrases.spans(text) if phrases else []) + [N.Span(m.start(2), m.end(2), "username", m[2]) for m in re.finditer(_HOME, text)]
    bears_path = re.search("(filename|fileinternalname|fileoriginalname|processname)$", name) and ("/" in text or "\\" in text)
    kind = "filename" if filenames and (re.search("filepath|fullpath", name) or bears_path) else "username" if re.search("homedirectory|profilepath", name) else "filename" if filenames and name.endswith("sharename") else None
    if kind and (m := _LAST.search(text)) and m[0] not in (".", ".."):
        found.append(N.Span(m.start(), m.end(), kind, m[0]))
    return found


def embedded_domain_spans(text: str) -> list[N.Span]:
    """Domains inside a URL or name, endings of files left out."""
    return [N.Span(m.start(), m.end(), "domain", m[0]) for m in P.PYTHON["domain"].finditer(text) if m[0].rsplit(".", 1)[1].lower() not in P.NOT_DOMAINS]


def rewrite_host(c: Column, told: DataFrame, df: DataFrame, out: str) -> DataFrame:
    """Adds `out`: URLs with their host replaced by the pseudonym that `told` (key, pseudonym) has for it."""
    side = told.select(F.col("key").alias("__h"), F.col("pseudonym").alias("__p"))
    joined = df.withColumn("__host", P.url_host(c)).join(side, F.col("__host") == F.col("__h"), "left")
    new = F.regexp_replace(c, F.lit(r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/:?#]+"), F.concat(F.lit("$1"), F.col("__p")))
    return joined.withColumn(out, F.coalesce(new, c)).drop("__host", "__h", "__p")


def filename_family(field: str) -> tuple[str, str] | None:
    """(family, member) of a field that has to do with one file: its name, its path or its command line."""
    name = normalised_field(field)
    for pattern, member in (("commandline$", "commandline"), ("(folderpath|filepath|fullpath)$", "path"), ("filename$", "filename")):
        if re.search(pattern, name):
            family = re.sub(pattern, "", name)
            return family if family not in ("", "process") else "process", member
    return None


def replace_file_tokens(line: str, original: str, replacement: str) -> str:
    """A file name in a command line, with and without .exe, replaced where it is a token of its own."""
    pairs = [(original, replacement)]
    stem, dot, ending = original.rpartition(".")
    if dot and ending.lower() == "exe":
        pairs.append((stem, replacement.rpartition(".")[0] or replacement))
    for old, new in pairs:
        line = re.sub(rf"(?<!{_EDGE}){re.escape(old)}(?!{_EDGE})", lambda m: new, line, flags=re.IGNORECASE)  # noqa: B023
    return line


def linked_files(df: DataFrame, seed: bytes, selected: Callable[[str], bool] = lambda f: True) -> DataFrame:
    """Families of file name, path and command line rewritten with one pseudonym per file name; command lines are masked first.

    The first selected file-name field of a family, by name, decides. The pseudonym comes from the name's digest alone.
    """
    families: dict[str, dict[str, list[str]]] = {}
    for c in sorted(df.columns):
        if (found := filename_family(c)) and df.schema[c].dataType.typeName() == "string":
            families.setdefault(found[0], {}).setdefault(found[1], []).append(c)
    for members in families.values():
        names = [c for c in members.get("filename", []) if selected(c)]
        if not names:
            continue
        original = S.last_component(F.trim(F.coalesce(*(F.when(F.trim(F.col(f"`{c}`")) != "", F.col(f"`{c}`")) for c in names))))
        df = df.withColumn("__file", original).withColumn("__new", D.candidate("filename", F.col("__file"), D.entity_digest(seed, "filename", F.col("__file"))))
        for c in [*names, *(c for c in members.get("path", []) if selected(c))]:
            old = F.col(f"`{c}`")
            same = F.lower(S.last_component(old)) == F.lower("__file")
            new = F.concat(F.regexp_extract(old, r"(?s)^(.*?)[^/\\]+[/\\]*$", 1), F.col("__new"), F.regexp_extract(old, r"([/\\]*)$", 1))
            plain = F.when(~old.rlike(r"[/\\]") & (F.trim(old) != ""), D.candidate("filename", old, D.entity_digest(seed, "filename", old))).otherwise(old) if c in names else old
            df = df.withColumn(c, F.when(same, new).otherwise(plain))
        for c in members.get("commandline", []):

            @F.pandas_udf("string")
            def run(lines: pd.Series, old: pd.Series, new: pd.Series) -> pd.Series:
                return pd.Series([None if x is None else replace_file_tokens(M.mask(x), o, n) if o else M.mask(x) for x, o, n in zip(lines, old, new, strict=True)])

            df = df.withColumn(c, run(F.col(f"`{c}`"), F.col("__file"), F.col("__new")))
        df = df.drop("__file", "__new")
    return df


_PROSE = re.compile("description|message|title|details|summary|additionalfields|properties|body")
_PERSON = re.compile(r"\b(?!(?:The|This|That|And|For|From|With|User|Process|Device|File)\b)([A-Z][a-z]{2,} (?:[A-Z]\. )?[A-Z][a-z]{2,})\b")


def is_prose(field: str, text: str) -> bool:
    """Is a text worth looking for names: 3 bytes to 16 KiB, with white space, not a path, in a field of prose or mostly letters?"""
    if not 3 <= len(text.encode()) <= 16 << 10 or not re.search(r"[ \t\n]", text) or "path" in normalised_field(field):
        return False
    if _PROSE.search(normalised_field(field)):
        return True
    return not re.search(r"[\\{}\[\]=|<>]", text) and sum(c.isalpha() for c in text) >= 3


def name_spans(text: str, known: frozenset[str] = frozenset()) -> list[N.Span]:
    """Names of persons by a plain rule, pairs of capitalised words, and of organisations by a given list.

    It stands where a trained recogniser would: no model is available offline. Any function of the same form fits.
    """
    people = [N.Span(m.start(1), m.end(1), "person", m[1]) for m in _PERSON.finditer(text) if m[1] not in known]
    return people + [N.Span(m.start(), m.end(), "organization", m[0]) for k in known for m in re.finditer(rf"\b{re.escape(k)}\b", text)]
