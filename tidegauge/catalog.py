"""Names to measurements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .errors import QueryError, ValidationError
from .model import Relation, WideRelation


def safe_name(name: object) -> str:
    """The name of a measurement, which becomes a folder: never a path."""
    if not isinstance(name, str) or not name.strip() or name == "." or ".." in name or any(c in name for c in "/\\\0"):
        raise ValidationError(f"not a measurement name: {name!r}")
    return name


class Catalog:
    """A resolver of measurements; ``add`` takes a relation or a function that makes one when asked."""

    def __init__(self):
        self._known: dict[str, Relation | Callable[[], Relation]] = {}

    def add(self, name: str, relation: Relation | Callable[[], Relation]) -> None:
        self._known[safe_name(name)] = relation

    def names(self) -> list[str]:
        return sorted(self._known)

    def __getitem__(self, name: str) -> Relation:
        if name not in self._known:
            raise QueryError(f"unknown measurement: {name!r}")
        found = self._known[name]
        return found() if callable(found) else found


def table_catalog(spark: SparkSession, folder: str) -> Catalog:
    """events, lineitem and orders of a folder of Parquet tables as measurements."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")

    def read(name):
        return spark.read.parquet(f"{folder}/{name}.parquet")

    c = Catalog()
    c.add("events", lambda: WideRelation("events", read("events").withColumn("k", F.get_json_object("props", "$.k").cast("long")), "ts", ("event_type", "user_id"), ("value", "k")))
    c.add("lineitem", lambda: WideRelation("lineitem", read("lineitem"), "l_shipdate", ("l_returnflag", "l_linestatus"), ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
    c.add("orders", lambda: WideRelation("orders", read("orders"), "o_orderdate", ("o_orderstatus", "o_orderpriority"), ("o_totalprice",)))
    return c
