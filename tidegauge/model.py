"""Measurements as DataFrames.

A ``Relation`` says how keys of a measurement map to columns. ``WideRelation``
has one typed column per tag and field, so that predicates reach the Parquet
scan; ``PointRelation`` holds schemaless points, tags as a map and fields as a
VARIANT, whose leaves are type-checked before any cast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The shape in which schemaless points land.
POINTS = "measurement STRING, timestamp DOUBLE, tags MAP<STRING,STRING>, fields VARIANT"

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def finite(c: Column) -> Column:
    """c as a double where it is an ordinary number, else null: NaN and infinities never count."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


class Relation:
    """What every operator asks of a measurement."""

    df: DataFrame
    name: str

    def tag(self, key: str) -> Column | None:
        raise NotImplementedError

    def field(self, key: str) -> tuple[Column, str] | None:
        """The field's column and its kind: number, string, boolean or any."""
        raise NotImplementedError

    def number(self, key: str) -> Column:
        """The field as a finite double; null where it is absent or anything else."""
        raise NotImplementedError

    def on(self, df: DataFrame) -> Relation:
        """The same keys over another DataFrame of the same columns."""
        raise NotImplementedError

    def where(self, condition: Column) -> Relation:
        return self.on(self.df.where(condition))

    @property
    def seconds(self) -> Column:
        """Unix seconds as a double."""
        raise NotImplementedError


@dataclass(frozen=True)
class WideRelation(Relation):
    name: str
    df: DataFrame
    time: str
    tags: tuple[str, ...]
    fields: tuple[str, ...]

    def tag(self, key: str) -> Column | None:
        return F.col(key).cast("string") if key in self.tags and not self._is_text(key) else F.col(key) if key in self.tags else None

    def _is_text(self, key: str) -> bool:
        return isinstance(self.df.schema[key].dataType, T.StringType)

    def field(self, key: str) -> tuple[Column, str] | None:
        if key not in self.fields:
            return None
        kind = self.df.schema[key].dataType
        return F.col(key), "number" if isinstance(kind, NUMERIC) else "boolean" if isinstance(kind, T.BooleanType) else "string"

    def number(self, key: str) -> Column:
        found = self.field(key)
        return finite(found[0]) if found and found[1] == "number" else F.lit(None).cast("double")

    def on(self, df: DataFrame) -> WideRelation:
        return WideRelation(self.name, df, self.time, self.tags, self.fields)

    @property
    def micros(self) -> Column:
        return F.unix_micros(F.col(self.time).cast("timestamp"))

    @property
    def seconds(self) -> Column:
        kind = self.df.schema[self.time].dataType
        return F.col(self.time).cast("double") if isinstance(kind, NUMERIC) else self.micros / 1e6


@dataclass(frozen=True)
class PointRelation(Relation):
    name: str
    df: DataFrame

    def tag(self, key: str) -> Column:
        return F.col("tags")[key]

    def _leaf(self, key: str, kind: str) -> Column:
        return F.try_variant_get("fields", "$['" + key.replace("'", "\\'") + "']", kind)

    def kind(self, key: str) -> Column:
        """The field's own type, such as BIGINT, DOUBLE, DECIMAL(2,1), STRING or BOOLEAN; null where it is absent."""
        return F.schema_of_variant(self._leaf(key, "variant"))

    def field(self, key: str) -> tuple[Column, str]:
        return self._leaf(key, "string"), "any"

    def number(self, key: str) -> Column:
        return F.when(self.kind(key).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), finite(self._leaf(key, "double")))

    def on(self, df: DataFrame) -> PointRelation:
        return PointRelation(self.name, df)

    @property
    def seconds(self) -> Column:
        return F.col("timestamp")


def series_points(rel: Relation, tag_keys: tuple[str, ...], field_key: str) -> DataFrame:
    """(tag columns, timestamp, value) of the rows that have the field as a number."""
    return rel.df.select(*[rel.tag(k).alias(k) for k in tag_keys], rel.seconds.alias("timestamp"), rel.number(field_key).alias("value")).where("value is not null")
