"""Keyed digests as column expressions, and pseudonym candidates taken from their bytes."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldglass.functions import scalar as S

#: Pools of invented names. Only their sizes matter to results' shape.
FIRST_NAMES = "Ada Bela Cleo Dara Edan Faye Gita Hale Ines Joss Kemi Lior Mira Nico Orla Pavo Quin Reva Sami Tova Ulla Vito Wren Xena Yuri Zola Arlo Bryn Cato Dune Esme Finn".split()
LAST_NAMES = "Abbot Barlow Calder Denby Easton Farrow Garner Hollis Ingram Jessop Keating Lathom Marlow Norwood Oakley Penrose Quayle Radley Selby Thorne Upton Vickers Whitby Yardley Ashby Bexley Corwin Dalton Elwood Fenton Gresham Harlow".split()
ADJECTIVES = "Amber Basalt Cobalt Dapple Ember Flint Golden Hazel Indigo Jade Keen Lunar Maple Noble Opal Pearl Quiet Russet Silver Tidal Umber Velvet Willow Zephyr Alpine Brisk Coral Dusky Elder Frosty Gentle Humble Ivory Jolly Kindly Lively Mellow Nimble Olive Placid Rapid Sturdy Tawny Upland Vivid Windy Young Azure Bright Crisp".split()
NOUNS = "Anchor Beacon Canyon Delta Estuary Forest Glacier Harbor Island Juniper Kestrel Lantern Meadow Nebula Orchard Prairie Quarry River Summit Timber Valley Wharf Yarrow Arbor Bridge Cedar Dune Falcon Grove Heron Ivy Jetty Knoll Ledge Marsh Osprey Pier Reef Shore Thicket".split()
STREETS = "Alder Way;Birch Lane;Cedar Road;Dogwood Court;Elm Street;Fir Avenue;Gorse Close;Holly Drive;Iris Row;Juniper Place".split(";")


def canonical(c: Column) -> Column:
    """Lower case, no space around, runs of white space as one space."""
    return F.regexp_replace(F.trim(F.lower(c)), r"\s+", " ")


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 of a text column as lower-case hex, from two SHA-256 with padded keys as literals."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ pad for b in block).hex())) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def entity_digest(seed: bytes, kind: Column | str, original: Column, attempt: Column | int = 0) -> Column:
    """The digest of an entity: kind, canonical form and attempt, separated by zero characters."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    attempt = F.lit(attempt) if isinstance(attempt, int) else attempt
    return hmac_sha256(seed, F.concat(kind, F.lit("\0"), canonical(original), F.lit("\0"), attempt.cast("string")))


def vault_key(seed: bytes, kind: Column | str, original: Column, context: str = "fieldglass-vault") -> Column:
    """A one-way key for an entity in a vault that keeps no originals."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return hmac_sha256(seed, F.concat(F.lit(context), F.lit("\0"), kind, F.lit("\0"), canonical(original)))


def key_id(seed: bytes, label: str = "fieldglass-key") -> str:
    """The first 16 hex digits of a digest that names the key without telling it."""
    return hmac.new(seed, label.encode(), hashlib.sha256).hexdigest()[:16]


def number(h: Column, start: int, size: int) -> Column:
    """`size` bytes of a hex digest from byte `start`, as a big-endian number."""
    return F.conv(F.substring(h, 2 * start + 1, 2 * size), 16, 10).cast("bigint")


def _hex(h: Column, start: int, end: int) -> Column:
    return F.substring(h, 2 * start + 1, 2 * (end - start))


def pick(pool: list[str], h: Column, start: int) -> Column:
    """A pool's entry at the number in two bytes of the digest."""
    return F.element_at(F.array(*map(F.lit, pool)), (number(h, start, 2) % len(pool) + 1).cast("int"))


def candidate(kind: str, original: Column, h: Column, attempt: Column | int = 0) -> Column:
    """The pseudonym that digest `h` proposes for an entity of `kind`; later attempts carry eight bytes of their digest."""
    attempt = F.lit(attempt) if isinstance(attempt, int) else attempt
    late = F.when(attempt > 0, _hex(h, 16, 24)).otherwise("")
    dashed = F.when(attempt > 0, F.concat(F.lit("-"), late)).otherwise("")
    if kind == "person":
        return F.concat(pick(FIRST_NAMES, h, 0), F.lit(" "), pick(LAST_NAMES, h, 2), late)
    if kind == "organization":
        return F.concat(pick(ADJECTIVES, h, 0), F.lit(" "), pick(NOUNS, h, 2), late)
    if kind == "username":
        return F.concat(F.lower(pick(FIRST_NAMES, h, 0)), F.lit("."), F.lower(pick(LAST_NAMES, h, 2)), late)
    if kind == "email":
        return F.concat(candidate("username", original, h, attempt), F.lit("@"), F.lower(pick(ADJECTIVES, h, 4)), F.lit(".example"))
    if kind == "domain":
        name = F.lower(F.trim(original))
        local = ~name.contains(".") | name.rlike(r"\.(local|internal|lan)$")
        return F.concat(F.lower(pick(ADJECTIVES, h, 0)), F.lit("-"), F.lower(pick(NOUNS, h, 2)), dashed, F.when(local, ".internal").otherwise(".example"))
    if kind == "hostname":
        return F.concat(S.host_role(original), F.lit("-"), F.lpad((number(h, 0, 2) % 9999 + 1).cast("string"), 4, "0"), dashed)
    if kind == "ip_address":
        return ip_candidate(original, h, attempt)
    if kind == "mac_address":
        return F.concat_ws(":", F.lit("02"), *(_hex(h, i, i + 1) for i in range(5)))
    if kind == "sid":
        return F.concat_ws("-", F.lit("S-1-5-21"), *(number(h, 4 * i, 4).cast("string") for i in range(3)), (number(h, 12, 4) % 9000 + 1000).cast("string"))
    if kind == "phone":
        return phone_candidate(original, h)
    if kind == "address":
        return F.concat((number(h, 0, 2) % 399 + 1).cast("string"), F.lit(" "), pick(STREETS, h, 2))
    if kind == "filename":
        return F.concat(F.lit("file-"), _hex(h, 0, 5), S.extension(original))
    if kind == "resource_group":
        return F.concat(F.lit("rg-"), F.lower(pick(ADJECTIVES, h, 0)), F.lit("-"), _hex(h, 2, 4))
    if kind == "resource_name":
        return F.concat(F.lit("resource-"), _hex(h, 0, 5))
    if kind == "identifier":
        guid = F.trim(original).rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
        variant = F.lower(F.hex((number(h, 8, 1) % 64 + 128).cast("bigint")))
        version4 = F.concat_ws("-", _hex(h, 0, 4), _hex(h, 4, 6), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), _hex(h, 10, 16))
        return F.when(guid, version4).otherwise(F.concat(F.lit("id-"), _hex(h, 0, 8)))
    return F.concat(F.lit("entity-"), _hex(h, 0, 8))


#: Pseudonyms that exist for private and for public IPv4 addresses.
PRIVATE_IPV4, PUBLIC_IPV4 = 256 * 254, 3 * 254


def is_private_ipv4(c: Column) -> Column:
    return F.trim(c).rlike(r"^(10\.|127\.|169\.254\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)")


def ip_address_at(place: Column, private: bool) -> Column:
    """The pseudonym at a place: private addresses are 10.203.x.y, public ones those of the documentation ranges."""
    last = (place % 254 + 1).cast("string")
    if private:
        return F.concat(F.lit("10.203."), F.floor(place / 254).cast("string"), F.lit("."), last)
    ranges = F.element_at(F.array(*map(F.lit, ("192.0.2", "198.51.100", "203.0.113"))), (F.floor(place / 254) + 1).cast("int"))
    return F.concat(ranges, F.lit("."), last)


def ip_candidate(original: Column, h: Column, attempt: Column | int = 0) -> Column:
    """Private addresses go to 10.203.x.y, public ones to the documentation ranges, IPv6 to the documentation prefix; attempts probe linearly."""
    attempt = F.lit(attempt) if isinstance(attempt, int) else attempt
    v6 = F.concat_ws(":", F.lit("2001:db8"), *(_hex(h, 2 * i, 2 * i + 2) for i in range(6)))
    place = number(h, 0, 2) + attempt
    return F.when(original.contains(":"), v6).when(is_private_ipv4(original), ip_address_at(place % PRIVATE_IPV4, True)).otherwise(ip_address_at(place % PUBLIC_IPV4, False))


def phone_candidate(original: Column, h: Column) -> Column:
    """Digits replaced one by one by digits of the digest, punctuation kept; the first stays a 5."""
    letters = F.split(original, "")
    digits = F.transform(letters, lambda c, i: F.when(c.rlike("^[0-9]$"), F.when(F.size(F.filter(F.slice(letters, 1, i + 1), lambda x: x.rlike("^[0-9]$"))) == 1, "5").otherwise((F.conv(F.substring(h, (i % 64 + 1).cast("int"), F.lit(1)), 16, 10).cast("int") % 10).cast("string"))).otherwise(c))
    return F.array_join(digits, "")
