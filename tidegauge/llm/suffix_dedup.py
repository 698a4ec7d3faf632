"""Substring deduplication with a logarithmic family of suffix arrays.

Each byte covered by a ``window``-byte string that also starts in a document
with a smaller doc_id goes. Suffixes are dealt to shards by their anchors (see
sequence_dedup); of a shard, documents come in batches by ascending doc_id.
A batch gets a suffix array (its suffixes' leading ``window`` bytes, sorted),
is merge-scanned against the existing levels, and what is new in it becomes a
level; levels of about equal size merge. The family compares bytes. A shard of
many windows, as a passage in very many documents makes it, has a family for
each class of them, one after another, which bounds memory; a window's class is
found once, so that the work stays in proportion to the windows. Stretches
equal to one of an earlier document are settled before it, by a 64-bit
fingerprint, in their bucket or shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_key, discard, ids_of, materialize, n_shards, pieces, prepare, runs, text_arrays, texts
from .seqhash import BYTE_SYMBOLS, U, grams, mix, spans
from .sequence_dedup import BLOB, Anchors, ByDocument, beside, blob, covered, gathered, grouped, key_of, null_id, recurring, sent, slots

#: Bytes of an anchor; a window of 50 bytes has 31 of these grams.
GRAM = 20
#: Suffixes of a batch, about.
BATCH = 1 << 17
#: Bytes of a family's suffixes, about: a shard with more is gone through in classes of windows, a family each.
FAMILY_BYTES = 24 << 20
#: Bytes of text behind one shard or bucket at most.
SHARD_BYTES = 32 << 20
#: Windows of classes that are taken apart at a time, about.
HELD = 4 << 20


class SuffixFamily:
    """Levels of sorted, distinct ``window``-byte strings, largest first."""

    def __init__(self):
        self.levels: list[np.ndarray] = []

    @staticmethod
    def scan(level: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Which of the sorted, distinct strings ``new`` are in the level: one merge of the two."""
        at = np.searchsorted(level, new)
        return (at < len(level)) & (level[np.minimum(at, len(level) - 1)] == new)

    @staticmethod
    def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Two sorted levels without common strings as one."""
        at = np.searchsorted(a, b) + np.arange(len(b))
        out, old = np.empty(len(a) + len(b), dtype=a.dtype), np.ones(len(a) + len(b), dtype=bool)
        out[at], old[at] = b, False
        out[old] = a
        return out

    def add(self, strings: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Takes a batch whose documents all come after those before; which of its strings occur in an earlier document."""
        order = np.argsort(strings, kind="stable")
        ranked = strings[order]
        start = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
        distinct, least = ranked[start], np.minimum.reduceat(doc[order], start)
        old = np.zeros(len(distinct), dtype=bool)
        for level in self.levels:
            old |= self.scan(level, distinct)
        hit = np.empty(len(strings), dtype=bool)
        size = np.diff(np.append(start, len(ranked)))
        hit[order] = np.repeat(old, size) | (doc[order] > np.repeat(least, size))
        if not old.all():
            self.levels.append(distinct[~old])
        while len(self.levels) > 1 and 2 * len(self.levels[-1]) > len(self.levels[-2]):
            last = self.levels.pop()
            self.levels[-1] = self.merged(self.levels[-1], last)
        return hit


def bytes_as_symbols(buf: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return BYTE_SYMBOLS[buf], lengths


def _contents(raw: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A fingerprint of each of the stretches that lie one after another in ``raw``, a piece of them at a time."""
    off = np.append(0, np.cumsum(size))
    parts = [spans(BYTE_SYMBOLS[raw[off[i] : off[j]]], off[i:j] - off[i], off[i + 1 : j + 1] - off[i]) for i, j in pieces(off)]
    return np.concatenate([np.empty(0, dtype=U), *parts])


CONTEXT = (np.uint8, np.uint16, U, np.int64, np.int32, np.uint32)  # bytes, their number, document key, doc_id, bucket, first start
MARK = (np.uint32, np.uint32)


class Stretches:
    """A bucket's stretches around recurring anchors."""

    def __init__(self, bucket: int, anchors: Anchors, shards: int):
        self.bucket, self.anchors, self.shards = bucket, anchors, shards
        self.recurring = ByDocument(np.uint32)
        self.held, self.size = [], 0

    def take(self, payloads: list[bytes]) -> None:
        self.recurring.add(payloads)

    def docs(self, row: pa.Array, doc_id: pa.Array, text: pa.Array) -> Iterator[pa.RecordBatch]:
        doc = ids_of(doc_id)
        key = key_of(row.to_numpy(), doc)
        buf, off = text_arrays(text)
        for i, j in pieces(off):
            part = buf[off[i] : off[j]]
            sym, n, d, pos, g, first, last = self.anchors.of(part, np.diff(off[i : j + 1]))
            begin = np.cumsum(n) - n
            keep = np.zeros(len(d), dtype=bool)
            at = np.searchsorted(d, np.arange(j - i + 1))
            for x in range(j - i):
                if at[x] < at[x + 1]:
                    (known,) = self.recurring.of(key[i + x])
                    if len(known):
                        keep[at[x] : at[x + 1]] = np.isin(pos[at[x] : at[x + 1]], known)
            d, g, first, last = d[keep], g[keep], first[keep], last[keep]
            if not len(d):
                continue
            a, z = begin[d] + first, begin[d] + last + self.anchors.window
            size = z - a
            where = np.arange(size.sum()) + np.repeat(a - (np.cumsum(size) - size), size)
            self.held.append((part[where], size, spans(sym, a, z), g, key[i + d], doc[i + d], first, last))
            self.size += len(where)
            if self.size > 32 << 20:
                yield from self.end()

    def end(self) -> Iterator[pa.RecordBatch]:
        """Settles what the bucket itself shows, and sends one stretch of each kind to its shard."""
        if not self.held:
            return
        raw, size, same, g, key, doc, first, last = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.size = [], 0
        order, start = grouped(same)
        least = np.empty(len(doc), dtype=np.int64)
        least[order] = np.repeat(np.minimum.reduceat(doc[order], start), np.diff(np.append(start, len(order))))
        begin = np.cumsum(size) - size
        out = []
        settled = doc > least
        if settled.any():
            out.append(blob(-1 - self.bucket, key[settled], first[settled].astype(np.uint32), last[settled].astype(np.uint32)))
        at = np.flatnonzero(~settled)
        for s, i in slots(((g[at] >> U(40)) % U(self.shards)).astype(np.int64), self.shards):
            i = at[i]
            n = size[i]
            where = np.arange(n.sum()) + np.repeat(begin[i] - (np.cumsum(n) - n), n)
            out.append(blob(s, raw[where], n.astype(np.uint16), key[i], doc[i], np.full(len(i), self.bucket, np.int32), first[i].astype(np.uint32)))
        yield from sent(out)


def classes_of(raw: np.ndarray, begin: np.ndarray, n: np.ndarray, window: int, classes: int) -> np.ndarray:
    """A class of each window of stretches that begin there and have n windows each, by all its bytes: equal windows are in one class."""
    if classes == 1:
        return np.zeros(n.sum(), dtype=np.uint16)
    out = [np.empty(0, dtype=np.uint16)]
    for i, j in pieces(np.append(0, np.cumsum(n + window - 1))):
        owner, inner = steps(n[i:j] + window - 1)
        g = grams(BYTE_SYMBOLS[raw[begin[i:j][owner] + inner]], window)
        owner, inner = steps(n[i:j])
        upto = np.cumsum(n[i:j] + window - 1) - (n[i:j] + window - 1)
        out.append((mix(g[upto[owner] + inner]) % U(classes)).astype(np.uint16 if classes <= 1 << 16 else np.uint32))
    return np.concatenate(out)


def steps(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, 0), ..., (i, n[i] - 1) for each i."""
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - (np.cumsum(n) - n)[owner]


def by_class(kind: np.ndarray, n: np.ndarray, classes: int, held: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each class that occurs: the stretches and places in them of its windows, in their order.

    About ``held`` windows are taken apart at a time, or those of one class.
    """
    count = np.cumsum(np.bincount(kind, minlength=classes))
    upto = np.append(0, np.cumsum(n))
    lo = 0
    while lo < classes:
        hi = max(lo + 1, int(np.searchsorted(count, (count[lo - 1] if lo else 0) + held, "right")))
        found = [[] for _ in range(lo, hi)]
        for i, j in pieces(upto):
            part = kind[upto[i] : upto[j]]
            at = np.flatnonzero((part >= lo) & (part < hi))
            at = at[np.argsort(part[at], kind="stable")]
            cut = np.searchsorted(part[at], np.arange(lo, hi + 1))
            owner = np.searchsorted(upto, at + upto[i], "right") - 1
            inner = (at + upto[i] - upto[owner]).astype(np.uint16)
            owner = owner.astype(np.uint32)
            for c in np.flatnonzero(cut[1:] > cut[:-1]):
                found[c].append((owner[cut[c] : cut[c + 1]], inner[cut[c] : cut[c + 1]]))
        while found:
            one = found.pop()
            if one:
                yield tuple(np.concatenate(x).astype(np.int64) for x in zip(*one, strict=True))
        lo = hi


def judge(window: int, buckets: int, batch: int, family_bytes: int):
    """A shard's stretches to marks: runs of window starts to remove, for the documents' buckets."""

    def fn(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, group in runs(rows):
            payloads = [p for b in group for p in b.column(1).to_pylist()]
            if shard < 0:
                yield from sent([(-1 - int(shard), p) for p in payloads])
                continue
            raw, size, key, doc, bucket, first = gathered(payloads, *CONTEXT)
            size = size.astype(np.int64)
            begin = np.cumsum(size) - size
            # a stretch that an earlier document has just so is settled; the family takes one of each kind
            kind, start = grouped(_contents(raw, size))
            least = np.empty(len(doc), dtype=np.int64)
            least[kind] = np.repeat(np.minimum.reduceat(doc[kind], start), np.diff(np.append(start, len(kind))))
            settled = np.flatnonzero(doc > least)
            order = np.flatnonzero(doc == least)
            order = order[np.argsort(doc[order], kind="stable")]
            n = size[order] - window + 1  # windows
            out = [(key[settled], bucket[settled], first[settled].astype(np.int64), first[settled].astype(np.int64) + size[settled] - window)]
            strings = np.lib.stride_tricks.sliding_window_view(raw, window)
            classes = max(1, -(-int(n.sum()) * window // family_bytes))
            kind = classes_of(raw, begin[order], n, window, classes)
            for owner, inner in by_class(kind, n, classes, HELD):
                family, i = SuffixFamily(), 0
                owner = order[owner]
                of = doc[owner]
                while i < len(of):
                    j = min(i + batch, len(of))
                    j = int(np.searchsorted(of, of[j - 1], "right"))  # no document is in two batches
                    at = i + np.flatnonzero(family.add(np.ascontiguousarray(strings[begin[owner[i:j]] + inner[i:j]]).view(f"S{window}").ravel(), of[i:j]))
                    i = j
                    if len(at):
                        o, pos = owner[at], first[owner[at]].astype(np.int64) + inner[at]
                        new = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]) | (pos[1:] != pos[:-1] + 1)])
                        stop = np.append(new[1:], len(at)) - 1
                        out.append((key[o[new]], bucket[o[new]], pos[new], pos[stop]))
            k, b, a, z = (np.concatenate(x) for x in zip(*out, strict=True))
            if classes > 1 and len(k):  # neighbouring windows come from several classes
                at = np.lexsort((a, k))
                k, b, a, z = k[at], b[at], a[at], z[at]
                new = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (a[1:] > z[:-1] + 1)])
                k, b, a, z = k[new], b[new], a[new], np.maximum.reduceat(z, new)
            yield from sent([blob(s, k[i], a[i].astype(np.uint32), z[i].astype(np.uint32)) for s, i in slots(b.astype(np.int64), buckets)])

    return fn


class Cut:
    """Removes a bucket's marked bytes."""

    def __init__(self, window: int, keep_text: bool):
        self.window, self.keep_text = window, keep_text
        self.marks = ByDocument(*MARK)

    def take(self, payloads: list[bytes]) -> None:
        self.marks.add(payloads)

    def docs(self, row: pa.Array, doc_id: pa.Array, text: pa.Array, *carry: pa.Array) -> Iterator[pa.RecordBatch]:
        doc = ids_of(doc_id)
        key = key_of(row.to_numpy(), doc)
        buf, off = text_arrays(text)
        n, removed, runs_, sha, kept = [], [], [], [], []
        for x in range(len(doc)):
            t = buf[off[x] : off[x + 1]]
            first, last = self.marks.of(key[x])
            n.append(len(t))
            if len(first):
                gone = covered(len(t), first, last, self.window)
                removed.append(int(gone.sum()))
                runs_.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                t = t[~gone]
            else:
                removed.append(0)
                runs_.append(0)
            sha.append(hashlib.sha256(t.tobytes()).hexdigest())
            if self.keep_text:
                kept.append(t.tobytes().decode("utf-8", "ignore"))
        out = [null_id(doc), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs_, pa.int64()), pa.array(sha, pa.string())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if self.keep_text:
            out += [pa.array(kept, pa.string()), *carry]
            names += ["text", *(f"c{i}" for i in range(len(carry)))]
        yield pa.RecordBatch.from_arrays(out, names=names)

    def end(self) -> Iterator[pa.RecordBatch]:
        return iter(())


def dedup(docs: DataFrame, window: int = 50, gram: int = GRAM, batch: int = BATCH, family_bytes: int = FAMILY_BYTES, keep_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    With ``keep_text`` also ``text``, the bytes that are left as UTF-8 (parts of
    a cut character go), and the columns ``carry``. A null text is empty. Rows
    without a doc_id come after all others and not before each other; of rows
    with one doc_id, none is earlier. An empty table gives none.
    """
    spark = docs.sparkSession
    prepare(spark)
    d = texts(docs, *carry)
    n = buckets = n_shards(d, SHARD_BYTES)
    anchors = Anchors(bytes_as_symbols, gram, window)
    again = materialize(recurring(d, anchors, buckets), "recurring")
    stretches = beside(d, again, buckets, lambda bucket: Stretches(bucket, anchors, buckets), BLOB)
    marks = materialize(by_key(stretches, n, "shard", judge(window, buckets, batch, family_bytes), BLOB).withColumnRenamed("shard", "bucket"), "marks")
    discard(again)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if keep_text:
        schema += ", text string" + "".join(f", `{c}` {d.schema[c].dataType.simpleString()}" for c in carry)
    return beside(d, marks, buckets, lambda bucket: Cut(window, keep_text), schema, *carry)
