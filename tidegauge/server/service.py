"""A server with a thread per connection on one SparkSession, a client, and metrics of operations."""

from __future__ import annotations

import socket
import socketserver
import threading
import time
from collections import defaultdict, deque
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from ..database import Database
from . import wire


class Metrics:
    """The last ``keep`` latencies and errors of each operation, with a clock that can be given. ``frame`` makes them a DataFrame."""

    def __init__(self, clock: Callable[[], float] = time.perf_counter, keep: int = 10_000):
        self.clock, self._lock = clock, threading.Lock()
        self._seen: dict[str, deque[tuple[float, bool]]] = defaultdict(lambda: deque(maxlen=keep))

    def record(self, operation: str, latency: float, error: bool = False) -> None:
        with self._lock:
            self._seen[operation].append((latency, error))

    @contextmanager
    def measure(self, operation: str) -> Iterator[None]:
        began, failed = self.clock(), True
        try:
            yield
            failed = False
        finally:
            self.record(operation, self.clock() - began, failed)

    def frame(self, spark):
        with self._lock:
            rows = [(op, lat, err) for op, seen in self._seen.items() for lat, err in seen]
        return spark.createDataFrame(rows, "operation string, latency double, error boolean")


class Server:
    def __init__(self, database: Database, host: str = "127.0.0.1", port: int = 0):
        self.metrics = metrics = Metrics()

        class Handler(socketserver.BaseRequestHandler):
            def handle(self):
                frames = wire.Deframer()
                while data := self.request.recv(65536):
                    for payload in frames.feed(data):
                        line = payload.decode("utf-8", "replace")
                        asked = (line.split() + ["", ""])[1].upper()
                        with metrics.measure(asked if asked in wire.COMMANDS else "NONE"):
                            out = wire.answer(line, lambda p: database.write(**p), database.query)
                        self.request.sendall(wire.frame(out.text().encode()))

        class Threads(socketserver.ThreadingTCPServer):
            allow_reuse_address = daemon_threads = True

        self._server = Threads((host, port), Handler)
        self.address = self._server.server_address

    def __enter__(self) -> Server:
        threading.Thread(target=self._server.serve_forever, daemon=True).start()
        return self

    def __exit__(self, *_) -> None:
        self._server.shutdown()
        self._server.server_close()


class Client:
    def __init__(self, host: str, port: int, timeout: float = 60):
        self._socket, self._frames = socket.create_connection((host, port), timeout), wire.Deframer()

    def _ask(self, command: str, arguments: str = "") -> wire.Response:
        self._socket.sendall(wire.frame(wire.request(command, arguments).encode()))
        while not (got := self._frames.feed(self._socket.recv(65536))):
            pass
        out = wire.parse_response(got[0].decode())
        if not out.ok:
            raise wire.WireError(out.code, " ".join(out.body))
        return out

    def ping(self) -> bool:
        return self._ask("PING").ok

    def write(self, measurement: str, tags: dict[str, str], fields: dict, timestamp: float | None = None) -> None:
        def pairs(d):
            return ",".join(f"{wire.escape(str(k))}={wire.escape(str(v))}" for k, v in d.items()) or "-"

        self._ask("WRITE", " ".join([measurement, pairs(tags), pairs(fields), *([repr(timestamp)] if timestamp is not None else [])]))

    def query(self, sql: str) -> list[dict]:
        rows = [{wire.unescape(k): wire.unescape(v) for k, _, v in (p.partition("=") for p in line.split(" "))} for line in self._ask("QUERY", sql).body]
        return [{k: (None if v == "None" else float(v)) if k == "value" else v for k, v in r.items()} for r in rows]

    def close(self) -> None:
        self._socket.close()
