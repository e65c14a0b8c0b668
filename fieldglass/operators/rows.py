"""How one row is pseudonymised: which of its values are identities, and what each is replaced by.

`Rewriter` is the one description of it. It runs twice over the data: once to note the simple entities that it would ask
for (and which of them belong to one user), and once, after these have pseudonyms, to put them in. In a row, in this order:
members of an identity family, command lines (always masked, whatever the field policy says), and then for fields of the
policy paths, cloud resource ids, kinds told by the field's name or the row's type, domains inside URLs, configured phrases
and entities in text. Objects, lists and JSON texts are walked at any depth; numbers in JSON keep their spelling.
"""

from __future__ import annotations

import ipaddress
import json
import re
from collections.abc import Callable

from fieldglass.functions import patterns as P
from fieldglass.functions.scalar import normalised_field
from fieldglass.operators import command_lines, paths, policy, recognise, resource_ids
from fieldglass.operators.allocate import COMPOUND_SUFFIXES

_EMAIL = re.compile(r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,63}", re.ASCII)
_IDENTITY = ("username", "email", "person")


def is_address(text: str) -> bool:
    """Is a text an IPv4 or IPv6 address?"""
    try:
        ipaddress.ip_address(text.strip().strip("[]").split("%")[0])
    except ValueError:
        return False
    return True


def split_email(text: str) -> tuple[str, str] | None:
    text = text.strip()
    user, at, domain = text.partition("@")
    return (user, domain) if at and user and domain and "@" not in domain else None


def split_account(text: str) -> tuple[str, str] | None:
    domain, slash, user = text.strip().partition("\\")
    return (domain, user) if slash and domain and user and "\\" not in user else None


def split_domain(text: str) -> tuple[str, str] | None:
    """(sub, base) of a domain with more labels than its base has."""
    labels = text.strip().rstrip(".").split(".")
    base = 3 if ".".join(labels[-2:]).lower() in COMPOUND_SUFFIXES else 2
    return (".".join(labels[:-base]), ".".join(labels[-base:])) if len(labels) > max(base, 2) else None


def display_name(user: str) -> str:
    """A person's name from a user name's parts."""
    return " ".join(w[:1].upper() + w[1:].lower() for w in re.split(r"[._-]+", user) if w)


def user_name(person: str) -> str:
    """A user name from a person's name: the first word, a dot, the others together."""
    words = [w for w in ("".join(c for c in x.lower() if c.isalnum()) for x in person.split()) if w]
    return ".".join([words[0], "".join(words[1:])] if len(words) > 1 else words or ["user"])


class Rewriter:
    """Rewrites rows with `get(kind, text)` for simple entities; `link(users, people)` hears which of them a row holds as one.

    Without `masks`, for runs that only note entities, command lines stay as they are: masking asks for none.
    """

    def __init__(self, fields: policy.FieldPolicy, family: Callable[[str], str | None], get: Callable[[str, str], str], link: Callable[[list[str], list[str]], None] | None = None, filenames: bool = False, phrases: recognise.Phrases | None = None, masks: bool = True):
        self.fields, self.family, self.get, self.link, self.filenames, self.phrases, self.masks = fields, family, get, link, filenames, phrases, masks

    # Entities

    def domain(self, text: str) -> str:
        if found := split_domain(text):
            return f"{self.get('hostname', found[0])}.{self.get('domain', found[1])}"
        return self.get("domain", text.strip())

    def user(self, text: str) -> str:
        """A user name, alone, in an account, or in an address."""
        if found := split_email(text):
            return f"{self.get('username', found[0])}@{self.domain(found[1])}"
        if found := split_account(text):
            return f"{self.domain(found[0])}\\{self.get('username', found[1])}"
        return self.get("username", text.strip())

    def entity(self, kind: str, text: str) -> str:
        """The replacement of one entity; parts of composite ones have theirs everywhere."""
        if not text.strip() or kind in ("domain", "hostname") and is_address(text) or kind == "filename" and not self.filenames:
            return text
        if kind in _IDENTITY and split_email(text) or kind == "username":
            return self.user(text)
        if kind == "domain":
            return self.domain(text)
        if kind == "hostname":
            host, dot, rest = text.strip().partition(".")
            if dot and host and P.PYTHON["domain"].fullmatch(rest):
                return f"{self.get('hostname', host)}.{self.domain(rest)}"
        return self.get(kind, text.strip())

    # Rows

    def identities(self, row: dict) -> dict[str, str]:
        """Members of the row's identity families; blank ones are made up from those that aren't."""
        families: dict[str, list[tuple[str, str, str]]] = {}
        for field in sorted(row):
            kind = policy.field_kind(field)
            if isinstance(row[field], str) and kind in (*_IDENTITY, "domain") and field in self.fields and (family := self.family(field)):
                families.setdefault(family, []).append((field, kind, row[field]))
        out = {}
        for members in families.values():
            users, people, domains = set(), set(), set()
            for _, kind, text in members:
                if not text.strip():
                    continue
                if kind == "domain":
                    domains.add(text.strip())
                elif (found := split_email(text)) or (kind == "username" and (found := split_account(text))):
                    user, domain = found if split_email(text) else found[::-1]
                    users.add(user)
                    domains.add(domain)
                elif kind == "person":
                    people.add(text.strip())
                else:
                    users.add(text.strip())
            if not users and not people:
                continue
            if self.link:
                self.link(sorted(users), sorted(people))
            blank = {kind for _, kind, text in members if not text.strip()}
            user = self.get("username", min(users)) if users else user_name(self.get("person", min(people)))
            domain = self.domain(min(domains)) if domains else self.get("domain", f"linked-identity-domain:{min(users or people)}") if blank & {"email", "domain"} else ""
            made = {"username": user, "email": f"{user}@{domain}", "domain": domain, "person": display_name(user)}
            for field, kind, text in members:
                out[field] = self.entity(kind, text) if text.strip() else made[kind]
        return out

    def row(self, row: dict) -> dict:
        told = self.identities(row)
        out = {}
        for field, value in row.items():
            if isinstance(value, str) and normalised_field(field).endswith("commandline"):
                known = [v for f, v in row.items() if isinstance(v, str) and v.strip() and policy.field_kind(f) in _IDENTITY] if self.masks else []
                out[field] = command_lines.mask(value, known) if self.masks else value
            elif field in told:
                out[field] = told[field]
            elif isinstance(value, str):
                out[field] = self.text(field, value, row)
            else:
                out[field] = self.value(field, value)
        return out

    def value(self, field: str, value):
        if isinstance(value, dict):
            return self.row(value)
        if isinstance(value, list):
            return [self.value(field, v) for v in value]
        return self.text(field, value, {}) if isinstance(value, str) else value

    def text(self, field: str, text: str, row: dict) -> str:
        if not text.strip():
            return text
        chosen = field in self.fields
        if chosen:
            name = normalised_field(field)
            if policy.is_path_field(field) or re.search("(filename|fileinternalname|fileoriginalname|processname)$", name) and re.search(r"[/\\]", text):
                return recognise.rewrite(text, paths.path_spans(field, text, self.filenames, self.phrases), self.entity)
            if resource_ids.parts(text) is not None:
                return resource_ids.rewrite(text, self.entity)
            if kind := policy.field_kind_in(field, row):
                if not (self.phrases and self.phrases.spans(text)):
                    return self.entity(kind, text)
            elif name == "remoteurl" or name == "name" and (is_address(text) or P.PYTHON["domain"].search(text)):
                return recognise.rewrite(text, paths.embedded_domain_spans(text) + (self.phrases.spans(text) if self.phrases else []), self.entity)
        if text.lstrip()[:1] in ("{", "["):
            changed = recognise.rewritten_value(text, lambda value: self.value(field, value))
            if changed is not None:
                return changed
        if not chosen:
            return text
        spans = recognise.pattern_spans(text) + (self.phrases.spans(text) if self.phrases else [])
        if paths.is_prose(field, text):
            spans += paths.name_spans(text)
        return recognise.rewrite(text, spans, self.entity)
