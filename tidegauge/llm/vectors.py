"""Vectors from an array column, shared by the nearest-neighbour operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dimension(df: DataFrame) -> int:
    """The most common length of the vectors, the larger of equally common ones; 0 without vectors."""
    got = df.where("embedding is not null and vec_id is not null").groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return got[0].d if got else 0


def matrices(rows: Iterator[pa.RecordBatch], d: int, batch: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(vec_id, float64 matrix) of rows with an id and d finite components."""
    for big in rows:
        for at in range(0, big.num_rows, batch):
            b = big.slice(at, batch)
            ids, lists = b.column(0), b.column(1)
            sizes = np.diff(np.asarray(lists.offsets))
            ok = np.asarray(ids.is_valid()) & np.asarray(lists.is_valid()) & (sizes == d)
            if not ok.any():
                continue
            x = lists.filter(pa.array(ok)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, d)  # null: nan
            fine = np.isfinite(x).all(axis=1)
            if fine.any():
                yield ids.filter(pa.array(ok)).to_numpy(zero_copy_only=False).astype(np.int64)[fine], x[fine]


def best(score: np.ndarray, k: int) -> np.ndarray:
    """Column numbers of the k greatest of each row, in no order."""
    if score.shape[1] <= k:
        return np.broadcast_to(np.arange(score.shape[1]), score.shape)
    return np.argpartition(-score, k - 1, axis=1)[:, :k]
