"""Seeded points for benchmarks, and timing with a check that results agree."""

from __future__ import annotations

import statistics
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .model import WideRelation


def points(spark: SparkSession, n: int, hosts: int = 4, regions: int = 3, seed: int = 42, step: float = 1.0) -> WideRelation:
    """n points of a measurement ``cpu``: tags host and region, value in [0, 100); made where they are used, the same for a seed."""
    draw = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30))
    df = spark.range(n).select(
        (F.col("id") * step).alias("timestamp"),
        F.concat(F.lit("host"), F.pmod(draw, F.lit(hosts))).alias("host"),
        F.concat(F.lit("region"), F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(regions))).alias("region"),
        (draw / (1 << 30) * 100).alias("value"),
    )
    return WideRelation("cpu", df, "timestamp", ("host", "region"), ("value",))


@dataclass(frozen=True)
class Timing:
    name: str
    seconds: tuple[float, ...]

    @property
    def mean(self) -> float:
        return statistics.fmean(self.seconds)

    @property
    def median(self) -> float:
        return statistics.median(self.seconds)

    @property
    def p95(self) -> float:
        s = sorted(self.seconds)
        at = 0.95 * (len(s) - 1)
        low = int(at)
        return s[low] + (s[min(low + 1, len(s) - 1)] - s[low]) * (at - low)

    @property
    def spread(self) -> float:
        return statistics.pstdev(self.seconds)


def timed(name: str, run: Callable[[], object], times: int = 5, clock: Callable[[], float] = time.perf_counter) -> Timing:
    seconds = []
    for _ in range(times):
        began = clock()
        run()
        seconds.append(clock() - began)
    return Timing(name, tuple(seconds))


def drain(df: DataFrame) -> None:
    """Makes every row, keeps none."""
    df.write.format("noop").mode("overwrite").save()


def compare(name: str, slow: DataFrame, fast: DataFrame, times: int = 5) -> tuple[bool, float]:
    """(whether both have the same rows, how many times faster the second is)."""
    same = slow.exceptAll(fast).limit(1).count() == 0 and fast.exceptAll(slow).limit(1).count() == 0
    a, b = timed(name, lambda: drain(slow), times), timed(name, lambda: drain(fast), times)
    return same, a.median / b.median


def write_sweep(rows: list, sizes: tuple[int, ...], write: Callable[[list], object], clock: Callable[[], float] = time.perf_counter) -> dict[int, float]:
    """Rows a second that ``write`` takes in batches of each size."""
    out = {}
    for size in sizes:
        began = clock()
        for i in range(0, len(rows), size):
            write(rows[i : i + size])
        out[size] = len(rows) / max(clock() - began, 1e-9)
    return out


def concurrent_writes(write: Callable[[int, int], object], writers: int, each: int, clock: Callable[[], float] = time.perf_counter) -> dict[str, float]:
    """Runs ``write(writer, n)`` ``each`` times in every one of some threads that start together: writes, failures, seconds, writes a second, mean latency."""
    together, lock, latencies, failed = threading.Barrier(writers), threading.Lock(), [], [0]

    def run(writer: int) -> None:
        together.wait()
        for n in range(each):
            began = clock()
            try:
                write(writer, n)
            except Exception:
                with lock:
                    failed[0] += 1
            else:
                with lock:
                    latencies.append(clock() - began)

    threads = [threading.Thread(target=run, args=(i,)) for i in range(writers)]
    began = clock()
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    took = max(clock() - began, 1e-9)
    return {"writes": len(latencies), "failures": failed[0], "seconds": took, "writes_per_s": len(latencies) / took, "mean_latency": statistics.fmean(latencies) if latencies else 0.0}


def suite(rel: WideRelation, key: str, times: int = 3) -> DataFrame:
    """(query, rows_agree, speedup): a point lookup, a range, an aggregate and a grouping, by conditions that reach the scan against the same ones on computed columns."""
    first = rel.df.select(key, rel.time).orderBy(rel.time).head()
    value, at = first[key], first[rel.time]
    hidden = F.concat(F.col(key), F.lit(""))  # a computed column, which no scan can skip by
    kinds = {
        "point": (lambda c: rel.df.where(c == value)),
        "range": (lambda c: rel.df.where((F.col(rel.time) >= at) & (c == value))),
        "aggregation": (lambda c: rel.df.where(c == value).agg(F.count(F.lit(1)).alias("n"))),
        "group_by": (lambda c: rel.df.groupBy(c.alias("k")).agg(F.count(F.lit(1)).alias("n"))),
    }
    rows = [(name, *compare(name, q(hidden), q(F.col(key)), times)) for name, q in kinds.items()]
    return rel.df.sparkSession.createDataFrame(rows, "query string, rows_agree boolean, speedup double")


def scored(marks: DataFrame, weights: DataFrame) -> DataFrame:
    """(option, score, rank) of marks (option, criterion, mark) under weights (criterion, weight): the weighted mean; equal scores by name."""
    total = marks.join(weights, "criterion").groupBy("option").agg((F.sum(F.col("mark") * F.col("weight")) / F.sum("weight")).alias("score"))
    return total.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "option")).cast("long"))


def prioritized(plan: DataFrame, quick: float = 1.0) -> DataFrame:
    """Steps (name, impact, effort) by impact for effort, then impact, then name, with their ``rank`` and whether they are a ``quick_win``: of more impact than effort times ``quick``."""
    gain = F.col("impact") / F.col("effort")
    order = W.orderBy(gain.desc(), F.desc("impact"), "name")
    return plan.withColumns({"gain": gain, "rank": F.row_number().over(order).cast("long"), "quick_win": gain > quick})


def markdown(df: DataFrame, most: int = 100) -> str:
    """The first rows of a report as a Markdown table."""
    rows = [df.columns, ["---"] * len(df.columns), *([("" if v is None else str(v).replace("|", "\\|")) for v in r] for r in df.limit(most).collect())]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)
