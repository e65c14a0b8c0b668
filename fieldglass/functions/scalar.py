"""Scalar functions of the pipe query language as column expressions.

The language treats null strings as empty text in most places; that rule lives here alone.
"""

from __future__ import annotations

import re
from fractions import Fraction
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hexadecimal digits of a digest that a bucket number is taken from: 15 of them fit a signed 64-bit integer.
BUCKET_DIGITS = 15
_LOOKBACK = re.compile(r"^(\d+\.?\d*|\.\d+)(d|h|ms|m|s)$")
_UNIT_US = {"d": 86_400_000_000, "h": 3_600_000_000, "m": 60_000_000, "s": 1_000_000, "ms": 1_000}


def tostring(c: Column) -> Column:
    """Text of any value; null becomes empty text."""
    return F.coalesce(c.cast("string"), F.lit(""))


def isempty(c: Column) -> Column:
    return tostring(c) == ""


def isnotempty(c: Column) -> Column:
    return tostring(c) != ""


def first_nonempty(*columns: Column) -> Column:
    """The first argument that is neither null nor empty text; null if there is none."""
    return F.coalesce(*(F.when(c.cast("string") != "", c) for c in columns))


def strcat(*columns: Column) -> Column:
    """Concatenation with null as empty text."""
    return F.concat(*(tostring(c) for c in columns))


def iff(condition: Column, yes: Column, no: Column) -> Column:
    return F.when(condition, yes).otherwise(no)


def case(*arguments: Column) -> Column:
    """case(condition, value, ..., otherwise)."""
    out = F
    for condition, value in zip(arguments[:-1:2], arguments[1::2], strict=True):
        out = out.when(condition, value)
    return out.otherwise(arguments[-1])


def pack(*arguments: Column | str) -> Column:
    """A property bag as JSON text, null values included."""
    fields = [value.alias(key) for key, value in zip(arguments[::2], arguments[1::2], strict=True)]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def pack_array(*columns: Column) -> Column:
    """A JSON array of texts."""
    return F.to_json(F.array(*(tostring(c) for c in columns)))


def digest_number(text: Column) -> Column:
    """The first 60 bits of a text's SHA-256 as a number that is never negative."""
    return F.conv(F.substring(F.sha2(text, 256), 1, BUCKET_DIGITS), 16, 10).cast("bigint")


def lookback_microseconds(literal: str) -> int:
    """The length of a look-back literal such as 30d, 1.5h or .5s; an error if it isn't one or doesn't fit 64 bits of nanoseconds."""
    m = _LOOKBACK.match(literal)
    if not m:
        raise ValueError(f"not a look-back literal: {literal!r}")
    number = m[1].rstrip(".")
    exact = Fraction("0" + number if number.startswith(".") else number) * _UNIT_US[m[2]]
    if exact * 1000 > 2**63 - 1:
        raise ValueError(f"look-back too long: {literal!r}")
    return int(exact)


def lookback_column(c: Column) -> Column:
    """The same in microseconds for a column of literals; null for what isn't one."""
    pattern = r"^(\d+\.?\d*|\.\d+)(d|h|ms|m|s)$"
    unit = F.regexp_extract(c, pattern, 2)
    scale = F.when(unit == "d", 86_400_000_000).when(unit == "h", 3_600_000_000).when(unit == "m", 60_000_000).when(unit == "s", 1_000_000).when(unit == "ms", 1_000)
    number = F.regexp_replace(F.regexp_extract(c, pattern, 1), r"\.$", "").try_cast("decimal(20,6)")
    return F.floor(number * scale).cast("bigint")


def is_safe_identifier(c: Column) -> Column:
    return F.coalesce(c.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), F.lit(False))


@lru_cache(4096)
def normalised_field(name: str, raw: bool = False) -> str:
    """A field name in lower case without punctuation; unless `raw`, a one-letter type suffix such as _s goes first."""
    text = name.strip().lower()
    if not raw and len(text) > 2 and text[-2] == "_" and text[-1] in "sdbtgi":
        text = text[:-2]
    return "".join(c for c in text if c.isalnum())


def normalised_field_column(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "(?<=.)_[sdbtgi]$", ""), r"[^\p{L}\p{Nd}]", "")


def graph_kind(c: Column, fallback: str = "") -> Column:
    """A kind name: runs of other characters become one underscore, none at the ends, and a leading digit gets one."""
    clean = F.regexp_replace(F.regexp_replace(F.trim(tostring(c)), "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(clean == "", F.lit(fallback)).when(clean.rlike("^[0-9]"), F.concat(F.lit("_"), clean)).otherwise(clean)


def property_name(c: Column) -> Column:
    """A property name in lower case; objectid is kept for the graph itself."""
    clean = F.regexp_replace(F.regexp_replace(F.lower(F.trim(tostring(c))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    clean = F.when(clean.rlike("^[0-9]"), F.concat(F.lit("_"), clean)).otherwise(clean)
    return F.when(clean == "objectid", F.lit("source_objectid")).otherwise(clean)


def split_email(c: Column) -> tuple[Column, Column]:
    return F.regexp_extract(c, "^([^@]+)@([^@]+)$", 1), F.regexp_extract(c, "^([^@]+)@([^@]+)$", 2)


def split_account(c: Column) -> tuple[Column, Column]:
    r"""DOMAIN and user of DOMAIN\user, empty where it has another form."""
    return F.regexp_extract(c, r"^([^\\]+)\\([^\\]+)$", 1), F.regexp_extract(c, r"^([^\\]+)\\([^\\]+)$", 2)


def last_component(c: Column) -> Column:
    """The last part of a path with either separator, without trailing separators."""
    return F.regexp_extract(c, r"([^/\\]+)[/\\]*$", 1)


def extension(c: Column) -> Column:
    """The extension of a file name with its dot, empty if it has none."""
    return F.regexp_extract(last_component(c), r"[^.](\.[A-Za-z0-9]{1,10})$", 1)


def is_ipv4(c: Column) -> Column:
    part = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    return F.coalesce(c.rlike(rf"^(?:{part}\.){{3}}{part}$"), F.lit(False))


def is_ip(c: Column) -> Column:
    """Is a text an IPv4 or IPv6 address? Brackets around it, a zone, one run of omitted groups and an IPv4 tail are understood."""
    text = F.lower(F.regexp_replace(F.trim(c), r"^\[+|\]+$", ""))
    tail = F.regexp_extract(text, r"([0-9.]+)(?:%.+)?$", 1)
    v6 = F.regexp_replace(text, "%.+$", "")
    v6 = F.when(tail.contains("."), F.when(is_ipv4(tail), F.regexp_replace(v6, r":[0-9.]+$", ":0:0")).otherwise("")).otherwise(v6)
    group = "[0-9a-f]{1,4}"
    whole = v6.rlike(rf"^(?:{group}:){{7}}{group}$")
    short = v6.rlike(rf"^(?:{group}(?::{group})*)?::(?:{group}(?::{group})*)?$") & (F.size(F.filter(F.split(v6, ":"), lambda g: g != "")) <= 7)
    return F.coalesce(is_ipv4(text) | whole | short, F.lit(False))


def is_plausible_phone(c: Column) -> Column:
    """8 to 15 digits that are neither a date nor a version number."""
    digits = F.length(F.regexp_replace(c, "[^0-9]", ""))
    date = r"^(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}-[0-9]{1,2}-[0-9]{4})$"
    return digits.between(8, 15) & ~c.rlike(date) & ~c.rlike(r"^[0-9]+(?:\.[0-9]+){2,}$")


def host_role(c: Column) -> Column:
    """A role word for a host's pseudonym, by what its name says or begins with."""
    name, out = F.lower(tostring(c)), F
    for word, role in (("domaincontroller", "dc"), ("server", "srv"), ("laptop", "lap"), ("workstation", "ws")):
        out = out.when(name.contains(word) | name.contains(f"-{role}") | name.startswith(role), role)
    return out.otherwise("host")
