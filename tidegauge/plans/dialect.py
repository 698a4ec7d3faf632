"""A one-aggregate SQL dialect over measurements.

    SELECT agg(field) FROM name [WHERE key op literal AND ...] [GROUP BY tag, ...]

Aggregates are count, sum, mean, min and max in lower case; keywords are in any
case. A name may be quoted with double quotes. Text is in single quotes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..errors import ParseError, QueryError
from ..functions.aggregates import aggregate
from ..operators.predicates import Both, Comparison

# The words of the dialect.
FUNCTIONS = ("count", "sum", "mean", "min", "max")
KEYWORDS = ("select", "from", "where", "and", "group", "by")

_LEXEME = re.compile(r"""\s*(?:(?P<text>'[^']*')|(?P<number>-?\d+(?:\.\d+)?)|(?P<op><=|>=|!=|=|<|>)|(?P<mark>[(),])|(?P<quoted>"[^"]+")|(?P<word>[A-Za-z_][A-Za-z0-9_]*)|(?P<end>$)|(?P<bad>.))""", re.DOTALL)


@dataclass(frozen=True)
class Lexeme:
    kind: str
    value: object
    at: int


def lexemes(query: str) -> list[Lexeme]:
    """The query's words, marks and literals; ParseError at any other character."""
    out = []
    for m in _LEXEME.finditer(query):
        kind, raw = m.lastgroup, m[m.lastgroup]
        if kind == "end":
            break
        if kind == "bad":
            raise ParseError(f"unexpected character {raw!r} at {m.start(kind)}")
        value: object = raw
        if kind in ("text", "quoted"):
            value = raw[1:-1]
            kind = "text" if kind == "text" else "name"
        elif kind == "number":
            value = float(raw) if "." in raw else int(raw)
        elif kind == "word":
            kind = "keyword" if raw.lower() in KEYWORDS else "name"
            value = raw.lower() if kind == "keyword" else raw
        out.append(Lexeme(kind, value, m.start(m.lastgroup)))
    return out


@dataclass(frozen=True)
class Select:
    function: str
    field: str
    measurement: str
    where: tuple[Comparison, ...] = ()
    by: tuple[str, ...] = ()


class _Reader:
    def __init__(self, query: str):
        self.rest = lexemes(query)[::-1]

    def ahead(self, kind: str, value: object = None) -> bool:
        return bool(self.rest) and self.rest[-1].kind == kind and value in (None, self.rest[-1].value)

    def take(self, kind: str, value: object = None):
        if not self.ahead(kind, value):
            found = f"{self.rest[-1].value!r} at {self.rest[-1].at}" if self.rest else "the end"
            raise ParseError(f"expected {value or kind}, found {found}")
        return self.rest.pop().value


def parse(query: str) -> Select:
    r = _Reader(query)
    r.take("keyword", "select")
    function = r.take("name")
    if function not in FUNCTIONS:
        raise ParseError(f"unknown aggregate: {function!r}")
    r.take("mark", "(")
    field = r.take("name")
    r.take("mark", ")")
    r.take("keyword", "from")
    measurement, where, by = r.take("name"), [], []
    if r.ahead("keyword", "where"):
        while r.take("keyword", "and" if where else "where"):
            key, op = r.take("name"), r.take("op")
            where.append(Comparison(key, op, r.take("text") if r.ahead("text") else r.take("number")))
            if not r.ahead("keyword", "and"):
                break
    if r.ahead("keyword", "group"):
        r.take("keyword")
        r.take("keyword", "by")
        by.append(r.take("name"))
        while r.ahead("mark", ","):
            r.take("mark")
            by.append(r.take("name"))
    if r.rest:
        raise ParseError(f"trailing {r.rest[-1].value!r} at {r.rest[-1].at}")
    return Select(function, field, measurement, tuple(where), tuple(by))


def plan(query: str | Select, catalog: Catalog) -> DataFrame:
    """The query as a DataFrame: a column per GROUP BY tag, and ``value``; one row without GROUP BY.

    Conditions and columns go to the scan; groups come in order, a missing tag
    first. A tag called ``value`` can't be grouped by.
    """
    q = parse(query) if isinstance(query, str) else query
    if "value" in q.by:
        raise QueryError("a group tag can't be called value")
    rel = catalog[q.measurement]
    rel = rel.where(Both(q.where).column(rel)) if q.where else rel
    value = aggregate(q.function)(rel.number(q.field)).alias("value")
    if not q.by:
        return rel.df.agg(value)
    keys = []
    for k in dict.fromkeys(q.by):
        c = rel.tag(k)
        keys.append((c if c is not None else F.lit(None).cast("string")).alias(k))
    return rel.df.groupBy(*keys).agg(value).orderBy(*[F.col(k).asc_nulls_first() for k in dict.fromkeys(q.by)])


def rows(df: DataFrame) -> list[dict]:
    """Result rows as dicts; a missing tag has no key."""
    return [{k: v for k, v in r.asDict().items() if v is not None or k == "value"} for r in df.collect()]
