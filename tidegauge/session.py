"""What Python workers need to know."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def findable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver did, whatever folder they start in."""
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, known)])


_own: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder that the driver and all executors see: in ``spark.checkpoint.dir``, or, on one machine without that, a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        at = _own.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="tidegauge-")
        _own[spark.sparkContext.applicationId] = at
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"
