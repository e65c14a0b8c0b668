"""The pipe query language: texts such as `T | where a > 1 | summarize n = count() by b` planned as DataFrames.

Supported: let, where, extend, project, join kind=inner, summarize, union, take and limit, count; between, case, iff,
coalesce, isempty, isnotempty, isnull, tostring, tolower, strcat, pack, pack_array, hash_sha256, substring, datetime, ago, ingestion_time;
min, max, sum, count, any. Planning is Catalyst's business; this only builds the logical plan.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.functions import scalar as S
from fieldglass.operators import relational as R

_TOKEN = re.compile(
    r"""\s+|//[^\n]*|(?P<date>datetime\s*\([^)]*\))|(?P<string>@?"(?:[^"\\]|\\.)*"|@?'(?:[^'\\]|\\.)*')|(?P<time>\d+(?:\.\d+)?(?:ms|d|h|m|s)\b)|(?P<number>\d+(?:\.\d+)?)|(?P<quoted>\[\s*(?:"[^"]*"|'[^']*')\s*\])|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<op>\.\.|==|!=|<=|>=|=~|[|(),;=<>%+\-*/])"""
)


class QueryError(ValueError):
    """A query text that can't be read or planned."""


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise QueryError(f"unexpected {text[at : at + 20]!r}")
        if m.lastgroup:
            out.append((m.lastgroup, m[0]))
        at = m.end()
    return out


class Planner:
    """Reads a query text and builds its DataFrame; tables come from `tables(name)`, `now` is fixed for the whole query, `ingested` names the column of arrival times."""

    def __init__(self, tables: Callable[[str], DataFrame], now: datetime | None = None, ingested: str | None = None):
        self.ingested = ingested
        self.tables, self.now = tables, now or datetime.now(UTC).replace(tzinfo=None)
        self.known: dict[str, DataFrame] = {}

    def plan(self, text: str) -> DataFrame:
        self.tokens, self.at = _tokens(text), 0
        while self._is("name", "let"):
            self._next()
            name = self._take("name")
            self._op("=")
            self.known[name] = self._pipeline()
            self._op(";")
        out = self._pipeline()
        while self._try(";"):
            pass
        if self.at < len(self.tokens):
            raise QueryError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def _peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def _next(self) -> tuple[str, str]:
        t = self._peek()
        self.at += 1
        return t

    def _is(self, kind: str, value: str) -> bool:
        return self._peek() == (kind, value)

    def _try(self, op: str) -> bool:
        if self._is("op", op):
            self.at += 1
            return True
        return False

    def _op(self, op: str) -> None:
        if not self._try(op):
            raise QueryError(f"expected {op!r}, not {self._peek()[1]!r}")

    def _take(self, *kinds: str) -> str:
        kind, value = self._next()
        if kind not in kinds:
            raise QueryError(f"unexpected {value!r}")
        return value[1:].strip(" ]")[1:-1] if kind == "quoted" else value

    def _list(self, item: Callable) -> list:
        out = [item()]
        while self._try(","):
            out.append(item())
        return out

    # tables

    def _pipeline(self) -> DataFrame:
        df = self._source()
        while self._try("|"):
            df = self._step(df, self._take("name"))
        return df

    def _source(self) -> DataFrame:
        if self._try("("):
            df = self._pipeline()
            self._op(")")
            return df
        name = self._take("name", "quoted")
        if name == "union":
            return R.union(*self._list(self._source))
        return self.known[name] if name in self.known else self.tables(name)

    def _step(self, df: DataFrame, verb: str) -> DataFrame:
        self.df = df
        if verb == "where":
            return df.filter(self._or())
        if verb == "extend":
            return df.withColumns(dict(self._list(self._named)))
        if verb == "project":
            return df.select(*(c.alias(n) for n, c in self._list(self._named)))
        if verb in ("take", "limit"):
            return df.limit(int(self._take("number")))
        if verb == "count":
            return R.count(df)
        if verb == "union":
            return R.union(df, *self._list(self._source))
        if verb == "join":
            kind = "innerunique"
            if self._is("name", "kind"):
                self._next()
                self._op("=")
                kind = self._take("name")
            if kind != "inner":
                raise QueryError(f"join kind {kind} isn't supported")
            right = self._source()
            if self._take("name") != "on":
                raise QueryError("expected on")
            return R.join_inner(df, right, self._take("name", "quoted"))
        if verb == "summarize":
            aggregates = [] if self._is("name", "by") else self._list(self._named)
            keys = []
            if self._is("name", "by"):
                self._next()
                keys = self._list(self._named)
            return R.summarize(df, dict(keys), **dict(aggregates))
        raise QueryError(f"operator {verb} isn't supported")

    def _named(self) -> tuple[str, Column]:
        kind, value = self._peek()
        after = self.tokens[self.at + 1] if self.at + 1 < len(self.tokens) else ("end", "")
        if kind in ("name", "quoted") and after == ("op", "="):
            name = self._take("name", "quoted")
            self._op("=")
            return name, self._or()
        name = self._take("name", "quoted") if kind in ("name", "quoted") and after != ("op", "(") else None
        if name is not None:
            self.at -= 1
        c = self._or()
        return name or f"{value}_", c

    # expressions

    def _or(self) -> Column:
        c = self._and()
        while self._is("name", "or"):
            self._next()
            c = c | self._and()
        return c

    def _and(self) -> Column:
        c = self._compare()
        while self._is("name", "and"):
            self._next()
            c = c & self._compare()
        return c

    def _compare(self) -> Column:
        left = self._sum()
        kind, op = self._peek()
        if kind == "op" and op in ("==", "!=", "<", ">", "<=", ">=", "=~"):
            self._next()
            right = self._sum()
            return {"==": left == right, "!=": left != right, "<": left < right, ">": left > right, "<=": left <= right, ">=": left >= right, "=~": F.lower(left) == F.lower(right)}[op]
        if (kind, op) == ("name", "between"):
            self._next()
            self._op("(")
            low = self._sum()
            self._op("..")
            high = self._sum()
            self._op(")")
            return left.between(low, high)
        return left

    def _sum(self) -> Column:
        c = self._product()
        while self._peek()[0] == "op" and self._peek()[1] in "+-":
            c = c + self._product() if self._next()[1] == "+" else c - self._product()
        return c

    def _product(self) -> Column:
        c = self._value()
        while self._peek()[0] == "op" and self._peek()[1] in "*/%":
            op, right = self._next()[1], self._value()
            c = c * right if op == "*" else c / right if op == "/" else c % right
        return c

    def _value(self) -> Column:
        kind, value = self._next()
        if kind == "string":
            body = value[2:-1] if value[0] == "@" else re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), value[1:-1])
            return F.lit(body)
        if kind == "date":
            return F.lit(value[value.index("(") + 1 : -1].strip(" \"'")).cast("timestamp_ntz").cast("timestamp")
        if kind == "number":
            return F.lit(float(value) if "." in value else int(value))
        if kind == "time":
            return F.lit(timedelta(microseconds=S.lookback_microseconds(value)))
        if (kind, value) == ("op", "("):
            c = self._or()
            self._op(")")
            return c
        if (kind, value) == ("op", "-"):
            return -self._value()
        if kind == "quoted":
            return F.col(f"`{value[1:].strip(' ]')[1:-1]}`")
        if kind != "name":
            raise QueryError(f"unexpected {value!r}")
        if value in ("true", "false"):
            return F.lit(value == "true")
        if not self._try("("):
            return F.col(f"`{value}`")
        arguments = [] if self._is("op", ")") else self._list(self._or)
        self._op(")")
        return self._call(value, arguments)

    def _call(self, name: str, a: list[Column]) -> Column:
        simple: dict[str, Callable[..., Column]] = {
            "case": S.case, "iff": S.iff, "coalesce": S.first_nonempty, "isempty": S.isempty, "isnotempty": S.isnotempty, "tostring": S.tostring, "strcat": S.strcat,
            "pack_array": S.pack_array, "tolower": F.lower, "isnull": F.isnull, "count": lambda: F.count(F.lit(1)), "min": F.min, "max": F.max, "sum": F.sum, "any": R.any_value,
            "hash_sha256": lambda c: F.sha2(S.tostring(c), 256), "ago": lambda c: F.lit(self.now) - c,
            "substring": lambda c, start, n: c.substr(start + 1, n), "tolong": lambda c: F.when(c.startswith("0x"), F.conv(F.substring(c, 3, 64), 16, 10)).otherwise(c).try_cast("bigint"),
        }
        if name == "pack":
            fields = [F.struct(k.cast("string").alias("k"), F.to_json(F.struct(v.alias("v")), {"ignoreNullFields": "false"}).alias("v")) for k, v in zip(a[::2], a[1::2], strict=True)]
            return F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit('"'), f["k"], F.lit('":'), F.regexp_extract(f["v"], r"(?s)^\{\"v\":(.*)\}$", 1)) for f in fields)), F.lit("}"))
        if name == "ingestion_time":
            if self.ingested is None:
                raise QueryError("ingestion_time() needs a column of arrival times")
            return F.col(f"`{self.ingested}`")
        if name not in simple:
            raise QueryError(f"function {name} isn't supported")
        return simple[name](*a)


def query(text: str, tables: Callable[[str], DataFrame], now: datetime | None = None, ingested: str | None = None) -> DataFrame:
    if not text.strip():
        raise QueryError("the query is empty")
    return Planner(tables, now, ingested).plan(text)
