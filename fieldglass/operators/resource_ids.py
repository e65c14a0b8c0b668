"""Cloud resource ids: /subscriptions/{guid}[/resourceGroups/{group}][/providers/{namespace}/{type}/{name}...]."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_GUID = "[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}"
_PROVIDER = r"/providers/[^/]+(?:/(?!providers/)[^/]+/[^/]+)+"
_WHOLE = re.compile(rf"^/subscriptions/{_GUID}(?:/resourceGroups/[^/]+)?(?:{_PROVIDER})*$", re.IGNORECASE)
#: Resource types whose names are hosts (fixed values).
HOST_TYPES = frozenset("machine machines virtualmachine virtualmachines computer computers device devices host hosts server servers".split())


def parts(text: str) -> list[tuple[int, str]] | None:
    """(segment number, kind) of what identifies in an id; None if it isn't one. Structure and types aren't listed."""
    if not _WHOLE.match(text):
        return None
    seg = text.split("/")
    out, i = [(2, "identifier")], 3
    if i < len(seg) and seg[i].lower() == "resourcegroups":
        out.append((i + 1, "resource_group"))
        i += 2
    while i < len(seg):
        if seg[i].lower() == "providers":
            i += 2
            continue
        kind = "identifier" if re.fullmatch(_GUID, seg[i + 1]) else "hostname" if seg[i].lower() in HOST_TYPES else "resource_name"
        out.append((i + 1, kind))
        i += 2
    return out


def rewrite(text: str, replace: Callable[[str, str], str]) -> str:
    """An id with each identifying segment replaced; other text as it is."""
    found = parts(text)
    if found is None:
        return text
    seg = text.split("/")
    for i, kind in found:
        seg[i] = replace(kind, seg[i])
    return "/".join(seg)


def subscription(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, rf"(?i)^/subscriptions/({_GUID})(?:/|$)", 1))


def group(c: Column) -> Column:
    return F.regexp_extract(c, rf"(?i)^/subscriptions/{_GUID}/resourceGroups/([^/]+)", 1)


def is_resource_id(c: Column) -> Column:
    return F.coalesce(c.rlike(f"(?i){_WHOLE.pattern}"), F.lit(False))
