"""JSON points: one object per line, fields bare or typed, and checked batches."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..model import POINTS

TYPES = {bool: "boolean", int: "integer", float: "float", str: "string"}


def read(spark: SparkSession, path: str) -> DataFrame:
    """Bare points of JSON lines; a broken line is a row of nulls with its text in ``_corrupt``."""
    return spark.read.schema(POINTS + ", _corrupt STRING").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def read_typed(spark: SparkSession, path: str) -> DataFrame:
    """Points whose fields are {"value": v, "type": t}: fields become a VARIANT of the values, checked against their types."""
    raw = spark.read.schema("measurement STRING, timestamp DOUBLE, tags MAP<STRING,STRING>, fields MAP<STRING,STRUCT<value:VARIANT,type:STRING>>").json(path)
    return raw.withColumn("fields", F.try_parse_json(F.to_json(F.transform_values("fields", lambda k, v: v["value"]))))


def typed_fields(fields: dict) -> dict:
    """{key: {"value", "type"}}."""
    for k, v in fields.items():
        if type(v) not in TYPES:
            raise ValidationError(f"no field type for {k!r}: {v!r}")
    return {k: {"value": v, "type": TYPES[type(v)]} for k, v in fields.items()}


def check_point(p: dict) -> dict:
    """A point is a name, a time that isn't negative, text tags, and a field at least."""
    if not isinstance(p.get("measurement"), str) or not p["measurement"]:
        raise ValidationError("a point has a measurement")
    if isinstance(p.get("timestamp"), bool) or not isinstance(p.get("timestamp"), (int, float)) or not p["timestamp"] >= 0:
        raise ValidationError("a point's time isn't negative")
    if any(not isinstance(k, str) or not isinstance(v, str) for k, v in p.get("tags", {}).items()):
        raise ValidationError("tags are text")
    if not p.get("fields"):
        raise ValidationError("a point has a field")
    typed_fields(p["fields"])
    return p


def dump_batch(points: list[dict], at: float) -> str:
    """A batch with version, count and MD5 of its points' canonical JSON."""
    body = [{**check_point(p), "fields": typed_fields(p["fields"])} for p in points]
    return json.dumps({"version": "1.0", "serialized_at": at, "count": len(body), "data_points": body, "checksum": _md5(body)})


def load_batch(text: str) -> list[dict]:
    batch = json.loads(text)
    if batch.get("version") != "1.0":
        raise ValidationError(f"unknown version: {batch.get('version')!r}")
    body = batch.get("data_points")
    if not isinstance(body, list) or batch.get("count") != len(body) or batch.get("checksum") != _md5(body):
        raise ValidationError("the batch doesn't match its checksum")
    kinds = {name: kind for kind, name in TYPES.items()}
    return [{**p, "fields": {k: kinds[f["type"]](f["value"]) for k, f in p["fields"].items()}} for p in body]


def _md5(body: list) -> str:
    return hashlib.md5(json.dumps(body, sort_keys=True).encode()).hexdigest()


def checksum(*columns: Column, sha256: bool = False) -> Column:
    """MD5, or SHA-256 as write-ahead logs have, of the columns' texts joined by "|"."""
    text = F.concat_ws("|", *[c.cast("string") for c in columns])
    return F.sha2(text, 256) if sha256 else F.md5(text)


def typed_point(p: dict) -> dict:
    """A checked point as one object, with typed fields."""
    p = check_point(p)
    return {"measurement": p["measurement"], "timestamp": p["timestamp"], "tags": p.get("tags", {}), "fields": typed_fields(p["fields"])}
