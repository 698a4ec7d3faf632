"""Exact top-k inner products over vectors of descending length.

Vectors are rotated by the eigenvectors of their Gram matrix (the right
singular vectors), so that a few leading coordinates hold most of a product;
by Cauchy-Schwarz the rest adds at most the product of the residual lengths.
Candidates lie in chunks of descending length. The longest ones give each query
a first threshold; a chunk goes only to query blocks with a query whose length
times the chunk's greatest reaches its threshold, and within a chunk the
threshold rises from block to block. Scores are of the integers themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import by_key, materialize, n_parts, pack, prepare, unpack
from .vectors import best, dimension, matrices

#: Less than any score.
NONE = -(1 << 62)
#: Rows of a chunk at least, of a step within it, of a query block, and of the head of longest vectors.
CHUNK, STEP, QUERIES, HEAD = 8192, 1024, 1024, 2048
#: Chunks at most, but for the last of each partition: the directory, 16 bytes each, goes to all tasks.
CHUNKS = 1 << 20
#: Tasks that sum Gram matrices, so that the driver gets a bounded number of these.
SUMS = 16


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of a and b, exactly, as int64."""
    if len(a) and len(b) and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Rotated:
    """Vectors in rotated coordinates: the leading ones, and the length of the rest."""

    def __init__(self, x: np.ndarray, turn: np.ndarray, lead: int):
        f = x.astype(np.float64)
        y = f @ turn
        self.lead, self.rest = y[:, :lead], np.sqrt((y[:, lead:] ** 2).sum(axis=1))
        self.length = np.sqrt((f * f).sum(axis=1))


def top_in_chunk(qid, q, least, cid, c, turn, lead, k):
    """(query number, vec_id, score) of what in a chunk can be among the k best: scores of at least ``least``."""
    least = least.copy()
    rq = Rotated(q, turn, lead)
    slack = 1e-9 * (1 + rq.length)
    kept = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in qid]
    for i in range(0, len(cid), STEP):
        ids, x = cid[i : i + STEP], c[i : i + STEP]
        rc = Rotated(x, turn, lead)
        live = np.flatnonzero(rq.length * rc.length.max() + slack * rc.length.max() >= least)
        if not len(live):
            break  # the rest is shorter still
        limit = rq.lead[live] @ rc.lead.T + rq.rest[live][:, None] * rc.rest[None, :] + slack[live][:, None] * rc.length[None, :]
        may = limit >= least[live][:, None]
        some = np.flatnonzero(may.any(axis=1))
        columns = np.flatnonzero(may.any(axis=0))
        if not len(some):
            continue
        score = products(q[live[some]], x[columns])
        may = may[some][:, columns] & (qid[live[some]][:, None] != ids[columns][None, :]) & (score >= least[live[some]][:, None])
        for a in np.flatnonzero(may.any(axis=1)):
            n = live[some[a]]
            hit = np.flatnonzero(may[a])
            s, v = np.concatenate([kept[n][0], score[a, hit]]), np.concatenate([kept[n][1], ids[columns[hit]]])
            order = np.lexsort((v, -s))[:k]
            kept[n] = s[order], v[order]
            if len(order) == k:
                least[n] = max(least[n], s[order[-1]])
    n = np.repeat(np.arange(len(qid)), [len(s) for s, _ in kept])
    return n, np.concatenate([v for _, v in kept]), np.concatenate([s for s, _ in kept])


def search(vectors: DataFrame, queries: str = "vec_id % 50 = 0", k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k greatest integer inner products.

    Components become floor(scale * x). Vectors that are null, of another
    length than most, or that hold null or non-finite components, and rows
    without an id take no part. Ties go to the smaller vec_id; rows with the
    query's own id are no candidates for it. Repeated rows count once. Without
    a valid vector the result is empty. Scores must fit 64 bits.
    """
    spark = vectors.sparkSession
    prepare(spark)
    n = n_parts(spark)
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    d = dimension(source)
    empty = "query_id long, rank int, vec_id long, score long"
    if not d:
        return spark.createDataFrame([], empty)

    def parse(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in matrices(rows, d):
            x = np.floor(x * scale).astype(np.int64)
            f = x.astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(-(f * f).sum(axis=1)), pa.array([v.tobytes() for v in x], pa.binary())], names=["vec_id", "order", "v"])

    chunk_rows = max(CHUNK, -(-source.count() // CHUNKS))
    rows = source.mapInArrow(parse, "vec_id long, order double, v binary").distinct()
    rows = rows.repartitionByRange(n, "order", "vec_id").sortWithinPartitions("order", "vec_id")

    def chunks(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size, made = TaskContext.get().partitionId(), [], 0, 0

        def cut():
            ids, x = (np.concatenate(y) for y in zip(*held, strict=True))
            f = x.astype(np.float64)
            return pa.RecordBatch.from_arrays([pa.array([part << 24 | made], pa.int64()), pa.array([float((f * f).sum(axis=1).max())]), pa.array([pack(ids, x.ravel())], pa.binary()), pa.array([(f.T @ f).tobytes()], pa.binary())], names=["chunk", "most", "payload", "gram"])

        for b in rows:
            for i in range(0, b.num_rows, STEP):
                s = b.slice(i, STEP)
                held.append((s.column(0).to_numpy(), np.frombuffer(b"".join(s.column(2).to_pylist()), dtype=np.int64).reshape(-1, d)))
                size += s.num_rows
                if size >= chunk_rows:
                    yield cut()
                    held, size, made = [], 0, made + 1
        if size:
            yield cut()

    table = materialize(rows.mapInArrow(chunks, "chunk long, most double, payload binary, gram binary"), "chunks")

    def add(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d * d)
        for b in rows:
            for g in b.column(0).to_pylist():
                total += np.frombuffer(g)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["gram"])

    gram = sum((np.frombuffer(r.gram) for r in table.select("gram").mapInArrow(add, "gram binary").repartition(SUMS).mapInArrow(add, "gram binary").collect()), np.zeros(d * d)).reshape(d, d)
    directory = sorted((r.chunk, r.most) for r in table.select("chunk", "most").collect())
    if not directory:
        return spark.createDataFrame([], empty)
    weight, turn = np.linalg.eigh(gram)
    turn = np.ascontiguousarray(turn[:, ::-1])
    share = np.cumsum(weight[::-1]) / max(weight.sum(), 1e-300)
    lead = min(d, max(4, int(np.searchsorted(share, 0.8)) + 1))

    def longest(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for c, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids, x = unpack(payload, np.int64, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([pack(ids[:HEAD], x[: HEAD * d])], pa.binary())], names=["chunk", "payload"])

    first = [c for c, _ in directory[: 1 + HEAD // STEP]]  # one may be the short last one of its partition
    tops = table.where(F.col("chunk").isin(first)).select("chunk", "payload").mapInArrow(longest, "chunk long, payload binary").collect()
    hid, head = zip(*(unpack(r.payload, np.int64, np.int64) for r in sorted(tops, key=lambda r: r.chunk)), strict=True)
    head = [x.reshape(-1, d) for x in head]
    hid, head = np.concatenate(hid)[:HEAD], np.concatenate(head)[:HEAD]
    # chunks come by descending length, so those that a query needs are the first ones
    lengths = np.sqrt(np.maximum.accumulate(np.array([m for _, m in directory])[::-1])[::-1])
    state = spark.sparkContext.broadcast((hid, head, turn, np.array([c for c, _ in directory]), lengths))

    def ask(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hid, head, _, chunk_ids, lengths = state.value
        for ids, x in matrices(rows, d):
            for i in range(0, len(ids), QUERIES):
                qid, q = ids[i : i + QUERIES], np.floor(x[i : i + QUERIES] * scale).astype(np.int64)
                score = products(q, head)
                least = np.full(len(qid), NONE)
                score[qid[:, None] == hid[None, :]] = NONE
                if len(hid) > k:
                    least = np.take_along_axis(score, best(score, k), 1).min(axis=1)
                length = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
                # the shortest chunk that a query needs, by lengths that grow from the last chunk to the first
                need = len(lengths) - np.searchsorted(lengths[::-1], (least - 1e-9) / np.maximum(length * (1 + 1e-9), 1e-300), "left")
                need = np.where(least <= 0, len(lengths), need)
                for c in range(int(need.max(initial=0))):
                    live = need > c
                    yield pa.RecordBatch.from_arrays([pa.array([chunk_ids[c]], pa.int64()), pa.array([1], pa.int32()), pa.array([pack(qid[live], q[live].ravel(), least[live])], pa.binary())], names=["chunk", "kind", "payload"])

    def meet(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, turn, _, _ = state.value
        now, cid, c = None, None, None
        for b in rows:
            for chunk, kind, payload in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if kind == 0:
                    now, (cid, c) = chunk, unpack(payload, np.int64, np.int64)
                    c = c.reshape(-1, d)
                    continue
                assert chunk == now
                qid, q, least = unpack(payload, np.int64, np.int64, np.int64)
                at, ids, score = top_in_chunk(qid, q.reshape(-1, d), least, cid, c, turn, lead, k)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(qid[at]), pa.array(ids), pa.array(score)], names=["query_id", "vec_id", "score"])

    asked = source.where(queries).mapInArrow(ask, "chunk long, kind int, payload binary")
    both = table.select("chunk", F.lit(0).alias("kind"), "payload").unionByName(asked)
    found = by_key(both, n, "chunk", meet, "query_id long, vec_id long, score long", "kind").distinct()
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
