"""python -m tidegauge.server PATH [--host HOST] [--port PORT] [--interval 1h|1d|1M]: serves a database until it is interrupted."""

from __future__ import annotations

import argparse
import threading

from pyspark.sql import SparkSession

from ..database import Database
from .service import Server


def main(arguments: list[str] | None = None, stop: threading.Event | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tidegauge.server", description=__doc__)
    parser.add_argument("path")
    parser.add_argument("--host", default="127.0.0.1")
    parser.add_argument("--port", type=int, default=8765)
    parser.add_argument("--interval", default="1d")
    given = parser.parse_args(arguments)
    stop = stop or threading.Event()
    with Database(spark or SparkSession.builder.appName("tidegauge").getOrCreate(), given.path, given.interval) as db, Server(db, given.host, given.port) as server:
        print("listening on {}:{}".format(*server.address), flush=True)
        try:
            stop.wait()
        except KeyboardInterrupt:
            pass


if __name__ == "__main__":
    main()
