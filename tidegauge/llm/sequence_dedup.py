"""The steps that both substring deduplicators share.

A window is ``window`` consecutive symbols of one document. Each window has an
anchor: its k-gram of least hash. Equal windows have equal anchors, so only
windows whose anchor also occurs in another document can repeat.

1. ``recurring``: anchors' fingerprints meet in shards; those in two or more
   documents come back to their documents. A task sends one row per
   fingerprint: further documents that it holds itself need no answer.
2. ``candidates``: documents read again, now beside their recurring anchors,
   give the stretches around these; stretches that a task sees in two documents
   are settled there, and one of each kind goes to the shard of its anchor.
3. A shard's ``judge`` (suffix-array levels, or window groups) says which
   windows start in a document with a smaller doc_id.
4. ``marks`` come back to the documents, which drop the covered symbols.

A hot passage thus costs one row per task and step, however many documents
hold it. Nothing is gathered on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, by_key, ids_of, pack, pieces, runs, slots, text_arrays, unpack
from .seqhash import U, minimizers, mix

BLOB = "shard int, payload binary"
BLOB_SCHEMA = pa.schema([("shard", pa.int32()), ("payload", pa.binary())])
#: Anchors that a task gathers before it sends them on.
FLUSH = 1 << 20


def keyed(docs: DataFrame, buckets: int, *carry: str) -> DataFrame:
    """(bucket, row, doc_id, text): ``row`` tells rows of one doc_id with different texts apart."""
    d = docs.withColumn("row", F.xxhash64("text"))
    return d.withColumn("bucket", F.pmod(F.hash(F.lit(5), "doc_id", "row"), F.lit(buckets))).select("bucket", "row", "doc_id", "text", *carry)


def blob(shard: int, *arrays: np.ndarray) -> tuple[int, bytes]:
    raw = pack(*arrays)
    return shard, len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def opened(payload: bytes, *dtypes) -> list[np.ndarray]:
    return unpack(pa.decompress(payload[8:], int.from_bytes(payload[:8], "little"), codec="zstd", asbytes=True), *dtypes)


def gathered(payloads: list[bytes], *dtypes) -> list[np.ndarray]:
    """The arrays of several blobs, each kind joined."""
    got = [opened(p, *dtypes) for p in payloads]
    return [np.concatenate([np.empty(0, t), *x]) for t, x in zip(dtypes, zip(*got, strict=True) if got else [()] * len(dtypes), strict=True)]


def sent(blobs: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Blobs as batches of a few megabytes."""
    held, size = [], 0
    for b in blobs:
        held.append(b)
        size += len(b[1])
        if size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.int32()), pa.array([x[1] for x in held], pa.binary())], schema=BLOB_SCHEMA)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.int32()), pa.array([x[1] for x in held], pa.binary())], schema=BLOB_SCHEMA)


Split = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


class Anchors:
    """Of a stream of texts: where their anchors are."""

    def __init__(self, split: Split, k: int, window: int):
        self.split, self.k, self.window = split, k, window

    def of(self, buf: np.ndarray, lengths: np.ndarray):
        """symbols, their number per text, and of each anchor: text, position in it, fingerprint, first and last window start in it."""
        sym, n = self.split(buf, lengths)
        starts = np.cumsum(n) - n
        at, g, first, last = minimizers(sym, n, self.k, self.window)
        d = np.searchsorted(starts + n, at, side="right")
        return sym, n, d, at - starts[d], g, first - starts[d], last - starts[d]


def grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, start of each group in it)."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    return order, np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.empty(0, np.int64)


def recurring(docs: DataFrame, anchors: Anchors, buckets: int) -> DataFrame:
    """Blobs (bucket; row, doc, position): the anchors that occur in other documents as well."""
    n = shards = buckets

    def find(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, owners, size, seen = [], [], 0, 0

        def flush():
            nonlocal held, owners, size, seen
            g, pos, owner = (np.concatenate(x) for x in zip(*held, strict=True))
            row, doc, bucket = (np.concatenate(x) for x in zip(*owners, strict=True))
            held, owners, size, seen = [], [], 0, 0
            order, start = grouped(g)
            d = doc[owner[order]]
            known = np.empty(len(g), dtype=bool)
            known[order] = np.repeat(np.minimum.reduceat(d, start) != np.maximum.reduceat(d, start), np.diff(np.append(start, len(order))))
            # one row of a known fingerprint tells its shard; all its anchors are on their way back already
            speaks = ~known
            speaks[order[start]] = True
            at = np.flatnonzero(speaks)
            out = []
            for s, i in slots(((g[at] >> U(40)) % U(shards)).astype(np.int64), shards):
                i = at[i]
                o = owner[i]
                cut = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
                u = o[cut]
                out.append(blob(s, g[i].astype(np.uint32), pos[i].astype(np.uint32), known[i].astype(np.uint8), np.diff(np.append(cut, len(o))).astype(np.uint32), row[u], doc[u], bucket[u].astype(np.int32)))
            at = np.flatnonzero(known)
            key = key_of(row, doc)
            for b, i in slots(bucket[owner[at]], buckets):
                i = at[i]
                out.append(blob(-1 - b, key[owner[i]], pos[i].astype(np.uint32)))
            return out

        for b in rows:
            bucket = b.column(0).to_numpy()
            row, doc = b.column(1).to_numpy(), ids_of(b.column(2))
            buf, off = text_arrays(b.column(3))
            for i, j in pieces(off):
                _, _, d, pos, g, _, _ = anchors.of(buf[off[i] : off[j]], np.diff(off[i : j + 1]))
                held.append((g, pos, seen + d))
                owners.append((row[i:j], doc[i:j], bucket[i:j]))
                size += len(g)
                seen += j - i
                if size > FLUSH:
                    yield from sent(flush())
        if size:
            yield from sent(flush())

    def meet(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, group in runs(rows):
            payloads = [p for b in group for p in b.column(1).to_pylist()]
            if shard < 0:  # known already: passed on
                yield from sent([(-1 - int(shard), p) for p in payloads])
                continue
            g, pos, known, n, row, doc, bucket = gathered(payloads, np.uint32, np.uint32, np.uint8, np.uint32, np.int64, np.int64, np.int32)
            owner = np.repeat(np.arange(len(n)), n)
            order, start = grouped(g)
            d = doc[owner[order]]
            often = (np.minimum.reduceat(d, start) != np.maximum.reduceat(d, start)) | (np.maximum.reduceat(known[order], start) > 0)
            back = order[np.repeat(often, np.diff(np.append(start, len(order))))]
            back = np.sort(back[known[back] == 0])
            key = key_of(row, doc)
            yield from sent([blob(b, key[owner[back[i]]], pos[back[i]]) for b, i in slots(bucket[owner[back]].astype(np.int64), buckets)])

    found = keyed(docs, buckets).mapInArrow(find, BLOB)
    return by_key(found, n, "shard", meet, BLOB).withColumnRenamed("shard", "bucket")


def beside(docs: DataFrame, blobs: DataFrame, buckets: int, make: Callable, schema: str, *carry: str) -> DataFrame:
    """Documents and the blobs of their bucket meet.

    ``make(bucket)`` gives an object per bucket; it gets the bucket's blobs
    first, ``take(payloads)``, then its documents batch by batch,
    ``docs(row, doc_id, text, *carry)``, and ``end()``. The latter two give
    batches of the result.
    """
    n = buckets
    d = keyed(docs, buckets, *carry).withColumns({"kind": F.lit(1), "payload": F.lit(None).cast("binary")})
    b = blobs.withColumns({"kind": F.lit(0)} | {f.name: F.lit(None).cast(f.dataType) for f in d.schema if f.name not in ("bucket", "kind", "payload")})
    both = d.unionByName(b)

    def each(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for bucket, b in _stream(rows):
            column = dict(zip(b.schema.names, b.columns, strict=True))
            if bucket != now:
                if state is not None:
                    yield from state.end()
                now, state = bucket, make(int(bucket))
            cut = int(np.searchsorted(column["kind"].to_numpy(), 1))
            if cut:
                state.take(column["payload"].slice(0, cut).to_pylist())
            if cut < b.num_rows:
                yield from state.docs(*(column[c].slice(cut) for c in ("row", "doc_id", "text", *carry)))
        if state is not None:
            yield from state.end()

    return by_key(both, n, "bucket", each, schema, "kind")


def _stream(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Like runs(), but a batch at a time: a bucket's texts needn't be in memory together."""
    for b in rows:
        if b.num_rows:
            k = b.column(b.schema.names.index("bucket")).to_numpy()
            cut = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            for i, j in zip(cut, np.r_[cut[1:], len(k)], strict=True):
                yield k[i], b.slice(i, j - i)


class ByDocument:
    """Rows of blobs (document key, then arrays), looked up by document."""

    def __init__(self, *dtypes):
        self.dtypes, self.payloads, self.key = dtypes, [], None

    def add(self, payloads: list[bytes]) -> None:
        self.payloads += payloads

    def of(self, key) -> list[np.ndarray]:
        if self.key is None:
            k, *rest = gathered(self.payloads, U, *self.dtypes)
            order = np.argsort(k, kind="stable")
            self.key, self.rest, self.payloads = k[order], [x[order].astype(np.int64) for x in rest], []
        i, j = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        return [x[i:j] for x in self.rest]


def key_of(row: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return mix(row.astype(U) ^ mix(doc.astype(U) + U(1)))


def covered(n: int, first: np.ndarray, last: np.ndarray, window: int) -> np.ndarray:
    """Which of n symbols lie in a window that starts in one of the runs first..last."""
    step = np.zeros(n + 1, dtype=np.int32)
    np.add.at(step, first, 1)
    np.add.at(step, np.minimum(last + window, n), -1)
    return np.cumsum(step[:n]) > 0


def null_id(doc: np.ndarray) -> pa.Array:
    """LAST_ID stands for no id."""
    return pa.array(doc, pa.int64(), mask=np.asarray(doc) == LAST_ID)
