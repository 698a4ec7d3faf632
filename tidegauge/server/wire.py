"""Frames, requests and responses.

A frame is four bytes of big-endian length and that many bytes of UTF-8. A
request is one line, version, command and arguments; a response is a status
line and body lines.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass

from ..errors import EngineError, ParseError, QueryError, ValidationError
from ..plans.dialect import lexemes

# Fixed values of the wire format.
VERSION = "TSDB/1"
COMMANDS = ("PING", "WRITE", "QUERY")
BAD_REQUEST, NOT_FOUND, UNPROCESSABLE, INTERNAL = 400, 404, 422, 500
#: Frames beyond this many bytes are refused.
LARGEST = 64 << 20


class WireError(EngineError):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def frame(payload: bytes) -> bytes:
    return struct.pack(">I", len(payload)) + payload


class Deframer:
    """Whole payloads from bytes as they come, in any pieces."""

    def __init__(self):
        self._held = bytearray()

    def feed(self, data: bytes) -> list[bytes]:
        self._held += data
        out = []
        while len(self._held) >= 4:
            (n,) = struct.unpack_from(">I", self._held)
            if n > LARGEST:
                raise WireError(BAD_REQUEST, "frame too large")
            if len(self._held) < 4 + n:
                break
            out.append(bytes(self._held[4 : 4 + n]))
            del self._held[: 4 + n]
        return out


def request(command: str, arguments: str = "") -> str:
    return f"{VERSION} {command} {arguments}".rstrip()


def parse_request(line: str) -> tuple[str, str]:
    version, _, rest = line.strip().partition(" ")
    command, _, arguments = rest.strip().partition(" ")
    if version != VERSION or not command:
        raise WireError(BAD_REQUEST, "malformed request")
    if command.upper() not in COMMANDS:
        raise WireError(NOT_FOUND, f"unknown command: {command}")
    return command.upper(), arguments.strip()


@dataclass(frozen=True)
class Response:
    ok: bool
    code: int = 0
    body: tuple[str, ...] = ()

    def text(self) -> str:
        status = f"{VERSION} {'OK' if self.ok else 'ERROR'}" + (f" {self.code}" if self.code or not self.ok else "")
        return "\n".join([status, *self.body])


def parse_response(text: str) -> Response:
    head, *body = text.splitlines() or [""]
    parts = head.split()
    if len(parts) < 2 or parts[0] != VERSION or parts[1] not in ("OK", "ERROR"):
        raise WireError(BAD_REQUEST, "malformed response")
    return Response(parts[1] == "OK", int(parts[2]) if len(parts) > 2 else 0, tuple(body))


# A backslash and a letter stand for a character that would end a value.
_STANDS = {"\\": "\\\\", " ": "\\s", ",": "\\c", "=": "\\e", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
_MEANS = {v: k for k, v in _STANDS.items()}


def escape(text: str) -> str:
    """A key or value without spaces, commas, equals and line ends; text without these or backslashes stays as it is."""
    return "".join(_STANDS.get(c, c) for c in text)


def unescape(text: str) -> str:
    return re.sub(r"\\.", lambda m: _MEANS.get(m[0], m[0]), text)


def parse_write(arguments: str) -> dict:
    """measurement tags fields [seconds]; tags may be "-" for none. Values are integers, else floats, else text, unescaped."""
    parts = arguments.split()
    if not 3 <= len(parts) <= 4:
        raise ValidationError("WRITE has a measurement, tags, fields and perhaps a time")

    def pairs(text: str) -> dict[str, str]:
        if text == "-":
            return {}
        out = [p.partition("=") for p in text.split(",")]
        if any(not k or not eq for k, eq, _ in out):
            raise ValidationError(f"bad key=value in {text!r}")
        return {unescape(k): unescape(v) for k, _, v in out}

    def value(text: str):
        for kind in (int, float):
            try:
                return kind(text)
            except ValueError:
                continue
        return text

    fields = {k: value(v) for k, v in pairs(parts[2]).items()}
    if not fields:
        raise ValidationError("a point has a field")
    try:
        at = float(parts[3]) if len(parts) == 4 else None
    except ValueError:
        raise ValidationError(f"bad time: {parts[3]!r}") from None
    return {"measurement": parts[0], "tags": pairs(parts[1]), "fields": fields, "timestamp": at}


def answer(line: str, write, query) -> Response:
    """The response to any request; an unexpected error never shows its text."""
    try:
        command, arguments = parse_request(line)
        if command == "WRITE":
            write(parse_write(arguments))
        elif command == "QUERY":
            words = [w.value for w in lexemes(arguments) if w.kind == "keyword"]
            if words[:1] != ["select"] or "from" not in words:
                raise QueryError("a query has SELECT and FROM")
            return Response(True, body=tuple(" ".join(f"{escape(str(k))}={escape(str(v))}" for k, v in row.items()) for row in query(arguments)))
        return Response(True)
    except WireError as e:
        return Response(False, e.code, (str(e),))
    except (ParseError, QueryError) as e:
        return Response(False, UNPROCESSABLE, (str(e),))
    except ValidationError as e:
        return Response(False, BAD_REQUEST, (str(e),))
    except Exception:
        return Response(False, INTERNAL, ("internal error",))


def table(rows: list[dict]) -> str:
    """Rows as aligned columns; a missing value is blank."""
    if not rows:
        return "(no results)"
    columns = list(dict.fromkeys(k for r in rows for k in r))
    cells = [columns, *([str(r.get(c, "")) for c in columns] for r in rows)]
    width = [max(len(line[i]) for line in cells) for i in range(len(columns))]
    lines = ["  ".join(c.ljust(w) for c, w in zip(line, width, strict=True)).rstrip() for line in cells]
    return "\n".join([lines[0], "  ".join("-" * w for w in width), *lines[1:]])
