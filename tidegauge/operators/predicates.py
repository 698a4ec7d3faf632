"""Predicates over tags and fields, compiled to Columns.

An absent key makes every comparison null, != too, which a filter drops like
false; there is no NOT that could tell the two apart. Text never equals a number;
to order the two is an error where the column's type is known, and drops the
point where it isn't. NaN is equal to nothing and in no order.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryError
from ..model import PointRelation, Relation

OPERATORS = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


@dataclass(frozen=True)
class Comparison:
    """``on``: "tag", "field", or "any", which means the tag of that name if there is one, else the field."""

    key: str
    op: str
    value: object
    on: str = "any"

    def __post_init__(self):
        if self.op not in OPERATORS:
            raise QueryError(f"unknown comparison: {self.op!r}")

    def column(self, rel: Relation) -> Column:
        if isinstance(rel, PointRelation):
            return self._of_point(rel)
        tag = rel.tag(self.key) if self.on != "field" else None
        if tag is not None:
            return _text(tag, self.op, self.value)
        found = rel.field(self.key) if self.on != "tag" else None
        if found is None:
            return F.lit(False)
        c, kind = found
        return _number(c, self.op, self.value) if kind == "number" else _truth(c, self.op, self.value) if kind == "boolean" else _text(c, self.op, self.value)

    def _of_point(self, rel: PointRelation) -> Column:
        tag = _text(rel.tag(self.key), self.op, self.value, strict=False)
        kind = rel.kind(self.key)
        text, _ = rel.field(self.key)
        leaf = F.try_variant_get("fields", "$['" + self.key.replace("'", "\\'") + "']", "double")
        field = (
            F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), _number(leaf, self.op, self.value, strict=False))
            .when(kind == "STRING", _text(text, self.op, self.value, strict=False))
            .when(kind == "BOOLEAN", _truth(text == "true", self.op, self.value))
        )
        if self.on == "tag":
            return tag
        if self.on == "field":
            return field
        return F.when(rel.tag(self.key).isNotNull(), tag).otherwise(field)


def _differ(c: Column, op: str, strict: bool = True) -> Column:
    """A comparison of text with a number."""
    if op == "=":
        return F.lit(False)
    if op == "!=":
        return c.isNotNull()
    if strict:
        raise QueryError("text and numbers have no order")
    return F.lit(False)


def _text(c: Column, op: str, value: object, strict: bool = True) -> Column:
    return OPERATORS[op](c, F.lit(value)) if isinstance(value, str) else _differ(c, op, strict)


def _number(c: Column, op: str, value: object, strict: bool = True) -> Column:
    if isinstance(value, str):
        return _differ(c, op, strict)
    plain = OPERATORS[op](c, F.lit(int(value) if isinstance(value, bool) else value))
    # NaN is Spark's greatest number, so only these two would take it
    return plain & ~F.isnan(c.cast("double")) if op in (">", ">=") else plain


def _truth(c: Column, op: str, value: object) -> Column:
    return _differ(c, op, strict=False) if isinstance(value, str) else OPERATORS[op](c.cast("int"), F.lit(int(value) if isinstance(value, bool) else value))


@dataclass(frozen=True)
class Both:
    """True if all are; of none, true."""

    parts: tuple

    def column(self, rel: Relation) -> Column:
        return reduce(operator.and_, (p.column(rel) for p in self.parts), F.lit(True))


@dataclass(frozen=True)
class Either:
    """True if any is; of none, false."""

    parts: tuple

    def column(self, rel: Relation) -> Column:
        return reduce(operator.or_, (p.column(rel) for p in self.parts), F.lit(False))


def tag(key: str, op: str, value: object) -> Comparison:
    return Comparison(key, op, value, "tag")


def fld(key: str, op: str, value: object) -> Comparison:
    return Comparison(key, op, value, "field")


def AND(*parts) -> Both:
    return Both(parts)


def OR(*parts) -> Either:
    return Either(parts)


def split_for_pushdown(predicate):
    """(part on tags alone, the rest): what an index on tags could answer, None if nothing."""
    if isinstance(predicate, Comparison):
        return (predicate, None) if predicate.on == "tag" else (None, predicate)
    if isinstance(predicate, Both):
        tags = tuple(p for p in predicate.parts if isinstance(p, Comparison) and p.on == "tag")
        rest = tuple(p for p in predicate.parts if p not in tags)
        join = lambda x: None if not x else x[0] if len(x) == 1 else Both(x)
        return join(tags), join(rest)
    return None, predicate


def between(rel: Relation, start: float | None, end: float | None) -> Column:
    """Inclusive bounds on Unix seconds; a missing time is in no range."""
    c = rel.seconds.isNotNull() if start is not None or end is not None else F.lit(True)
    if start is not None:
        c &= rel.seconds >= start
    if end is not None:
        c &= rel.seconds <= end
    return c


def equal_to(tags: dict | None = None, fields: dict | None = None) -> Both:
    """All of the given tags and fields have the given values; tag values compare as text."""
    return Both(tuple([tag(k, "=", str(v)) for k, v in (tags or {}).items()] + [fld(k, "=", v) for k, v in (fields or {}).items()]))
