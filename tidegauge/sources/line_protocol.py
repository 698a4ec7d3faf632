"""Line protocol: name[,tag=value...] field=value[,...] [time].

Plain lines are parsed by columns, lines with escapes or quoted marks in Arrow
batches by one function; a line that isn't valid becomes a row with ``error``
set, and never stops the others.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ParseError
from ..session import findable

NAME = re.compile(r"[A-Za-z0-9-][A-Za-z0-9_-]*")
# Digits of a time to its unit in seconds.
UNITS = {10: 1, 13: 1e3, 16: 1e6, 19: 1e9}
#: A time may be this far ahead of now.
AHEAD = 86400


def _split(text: str, mark: str, most: int = -1) -> list[str]:
    """At unescaped marks outside double quotes."""
    if "\\" not in text and ('"' not in text or most < 0):
        out = [""]
        for i, part in enumerate(text.split('"') if most < 0 else [text]):
            inside = i % 2
            head, *rest = [part] if inside else part.split(mark, most)
            out[-1] += '"' * (i > 0) + head
            out += rest
        return out
    out, now, quoted, i = [], "", False, 0
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            now += text[i : i + 2]
            i += 2
            continue
        if c == '"':
            quoted = not quoted
        if c == mark and not quoted and most != len(out):
            out.append(now)
            now = ""
        else:
            now += c
        i += 1
    return [*out, now]


def unescape(text: str, context: str = "tag") -> str:
    """Of a tag: backslash before comma, equals or space; of a field: before a quote or a backslash."""
    if context not in ("tag", "field"):
        raise ParseError(f"unknown context: {context!r}")
    return re.sub(r"\\([,= ])" if context == "tag" else r'\\(["\\])', r"\1", text)


def _pair(text: str, what: str) -> tuple[str, str]:
    parts = _split(text, "=", 1)
    if len(parts) != 2 or not parts[0] or not parts[1]:
        raise ParseError(f"bad {what}: {text!r}")
    return unescape(parts[0]), parts[1]


def check_name(name: str, what: str = "measurement") -> str:
    if not NAME.fullmatch(name):
        raise ParseError(f"bad {what}: {name!r}")
    return name


def field_value(text: str) -> int | float | str | bool:
    """42i is an integer, "..." text, t and f in any case and length truth, all else a float."""
    if re.fullmatch(r"-?\d+i", text):
        value = int(text[:-1])
        if not -(1 << 63) <= value < 1 << 63:
            raise ParseError(f"integer out of range: {text!r}")
        return value
    if len(text) > 1 and text[0] == text[-1] == '"':
        return unescape(text[1:-1], "field")
    if text.lower() in ("t", "true", "f", "false"):
        return text.lower()[0] == "t"
    try:
        return float(text)
    except ValueError:
        raise ParseError(f"bad field value: {text!r}") from None


def parse_time(text: str, now: float | None = None) -> float:
    """Seconds of a time whose digits tell its unit; none before 1970 or over a day ahead of ``now``."""
    if not text.isdigit() or len(text) not in UNITS:
        raise ParseError(f"bad time: {text!r}")
    seconds = int(text) / UNITS[len(text)]
    if now is not None and seconds > now + AHEAD:
        raise ParseError(f"time in the future: {text!r}")
    return seconds


def parse_line(line: str, now: float | None = None) -> dict:
    """measurement, tags, fields, timestamp (None if the line has none)."""
    parts = [p for p in _split(line.strip(), " ") if p]
    if not 2 <= len(parts) <= 3:
        raise ParseError(f"expected two or three sections: {line!r}")
    name, *pairs = _split(parts[0], ",")
    tags = {}
    for p in pairs:
        k, v = _pair(p, "tag")
        tags[check_name(k, "tag key")] = unescape(v)
    fields = {}
    for p in _split(parts[1], ","):
        k, v = _pair(p, "field")
        fields[check_name(k, "field key")] = field_value(v)
    return {"measurement": check_name(unescape(name)), "tags": tags, "fields": fields, "timestamp": parse_time(parts[2], now) if len(parts) == 3 else None}


_WORD = r"[A-Za-z0-9-][A-Za-z0-9_-]*"
_WHOLE = r"-?(?:0|[1-9]\d{0,14})"
_PLAIN_VALUE = rf'(?:{_WHOLE}i|{_WHOLE}(?:\.(?:0|\d{{0,5}}[1-9]))?|"[^"\\,= ]*"|[tTfF]|[tT][rR][uU][eE]|[fF][aA][lL][sS][eE])'
#: Lines that columns can parse: one space between sections, nothing escaped, no mark within quotes, and numbers as JSON has them.
PLAIN = rf'^{_WORD}(?:,{_WORD}=[^,= "\\\s]+)* {_WORD}={_PLAIN_VALUE}(?:,{_WORD}={_PLAIN_VALUE})*(?: (?:\d{{10}}|\d{{13}}|\d{{16}}|\d{{19}}))?$'


def _plain_parts(line: Column) -> tuple[Column, Column, Column, Column]:
    """Measurement, (key, value) pairs of tags and of fields, and the time's digits, of a plain line."""
    part = F.split(line, " ")
    head = F.split(part[0], ",")

    def pairs(items: Column) -> Column:
        return F.transform(items, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.substring_index(p, "=", -1).alias("value")))

    return head[0], pairs(F.slice(head, F.lit(2), F.greatest(F.size(head) - 1, F.lit(0)))), pairs(F.split(part[1], ",")), F.try_element_at(part, F.lit(3))


def _json_value(v: Column) -> Column:
    """A plain field value as JSON: truth by its first letter, integers without their mark, whole floats with a fraction."""
    first = F.lower(F.substring(v, 1, 1))
    return F.when(first == "t", F.lit("true")).when(first == "f", F.lit("false")).when(v.endswith("i"), F.rtrim(v, F.lit("i"))).when((first == '"') | v.contains("."), v).otherwise(F.concat(v, F.lit(".0")))


def read(lines: DataFrame, column: str = "value", now: float | None = None) -> DataFrame:
    """(measurement, timestamp, tags, fields, line, error) of a DataFrame of lines; blank lines and comments give nothing.

    Valid rows have a null ``error``; filter on it for the rejects. Plain lines
    are parsed by columns; Python sees the others only.
    """
    findable(lines.sparkSession)
    line = lines.select(F.col(column).alias("line"))
    name, tags, fields, digits = _plain_parts(F.col("line"))
    unit = F.create_map(*[F.lit(x) for k, v in UNITS.items() for x in (k, float(v))])
    seconds = digits.cast("double") / unit[F.length(digits)]
    # a generator, so that a line is taken apart once, however often its parts are used; null if it isn't plain
    parts = F.when(F.col("line").rlike(PLAIN), F.struct(name.alias("name"), tags.alias("tags"), fields.alias("fields"), seconds.alias("at")))
    cut = line.select("line", F.explode(F.array(parts)).alias("cut"))
    soon = F.lit(True) if now is None else F.coalesce(F.col("cut.at") <= now + AHEAD, F.lit(True))
    once = (F.size(F.array_distinct("cut.tags.key")) == F.size("cut.tags")) & (F.size(F.array_distinct("cut.fields.key")) == F.size("cut.fields"))
    easy = F.coalesce(F.col("cut").isNotNull() & once & soon, F.lit(False))
    text = F.concat(F.lit("{"), F.array_join(F.transform("cut.fields", lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), _json_value(e["value"]))), ","), F.lit("}"))
    parsed = cut.where(easy).select(F.col("cut.name").alias("measurement"), F.col("cut.at").alias("timestamp"), F.map_from_entries("cut.tags").alias("tags"), text.alias("fields"), "line", F.lit(None).cast("string").alias("error"))

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for one in frame["line"]:
                if one is None or not one.strip() or one.lstrip().startswith("#"):
                    continue
                try:
                    p = parse_line(one, now)
                    out.append((p["measurement"], p["timestamp"], p["tags"], json.dumps(p["fields"]), one, None))
                except ParseError as e:
                    out.append((None, None, None, None, one, str(e)))
            yield pd.DataFrame(out, columns=["measurement", "timestamp", "tags", "fields", "line", "error"])

    schema = "measurement string, timestamp double, tags map<string,string>, fields string, line string, error string"
    hard = cut.where(~easy).select("line").mapInPandas(parse, schema)
    return parsed.unionByName(hard).withColumn("fields", F.try_parse_json("fields"))


def read_files(spark: SparkSession, path: str, now: float | None = None) -> DataFrame:
    return read(spark.read.text(path), "value", now)


def _escape_tag(c: Column) -> Column:
    return F.regexp_replace(c, r"([,= ])", r"\\$1")


def format_lines(measurement: Column, tags: dict[str, Column], fields: dict[str, tuple[Column, str]], micros: Column) -> Column:
    """A line per row, in nanoseconds. Fields are (column, kind), kind integer, float, string or boolean; null ones are left out."""
    head = F.concat_ws(",", _escape_tag(measurement), *[F.concat(F.lit(k + "="), _escape_tag(c.cast("string"))) for k, c in sorted(tags.items())])

    def shown(c: Column, kind: str) -> Column:
        if kind == "integer":
            return F.concat(c.cast("long").cast("string"), F.lit("i"))
        if kind == "string":
            return F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\])', r"\\$1"), F.lit('"'))
        return c.cast("string")

    body = F.concat_ws(",", *[F.concat(F.lit(k + "="), shown(c, kind)) for k, (c, kind) in fields.items()])
    return F.concat_ws(" ", head, body, (micros * 1000).cast("string"))
