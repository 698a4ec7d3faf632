"""Substring deduplication with automata of recurring phrases.

Each word covered by a ``window``-word sequence that also starts in a document
with a smaller doc_id goes. Phrases (the ``gram`` words of anchors, see
sequence_dedup) that two or more documents share are confirmed first, by their
spelling in a few letters a word. The confirmed phrases are dealt to automaton
shards, one for each bucket of documents, with the phrases that occur anywhere
in the bucket: so a document passes one automaton, and every phrase that it can
hold is in that. All documents stream through, and the hits locate the phrases.
Windows around them go to the phrase's shard, where the first document of each
is found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_key, discard, ids_of, materialize, n_shards, pieces, prepare, runs, text_arrays, texts
from .seqhash import U, grams, mix, spans, words
from .sequence_dedup import BLOB, FLUSH, Anchors, ByDocument, beside, blob, covered, gathered, grouped, key_of, keyed, null_id, opened, sent, slots
from .suffix_dedup import MARK

#: Words of an anchor phrase.
GRAM = 12
WINDOWS = (U, np.uint16, U, np.int64, np.int32, np.uint32)  # windows' hashes, their number, document key, doc_id, bucket, first start


def words_as_symbols(buf: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h, _, _, n = words(buf, lengths)
    return h, n


#: Letters of a word in an automaton's text, and the bits of each: few enough that a node has few children to look through.
#: Unlike words that are spelled alike only give windows that are judged in vain.
LETTERS, LETTER_BITS = 2, 6
#: Stands between documents, twice; no letter of a word.
BETWEEN = 47
#: Bytes of text behind one bucket at most: an automaton takes some 1.5 KB a phrase, and at most every 25th word begins one.
BUCKET_BYTES = 32 << 20
#: Windows that a bucket holds before it sends them on.
WINDOWS_HELD = 1 << 21


def lettered(sym: np.ndarray) -> np.ndarray:
    """LETTERS letters for each word, a row each."""
    shifts = np.arange(LETTERS, dtype=U) * U(LETTER_BITS)
    return ((sym[:, None] >> shifts) & U((1 << LETTER_BITS) - 1)).astype(np.uint8) + np.uint8(48)


def automaton(payloads: list[bytes], k: int) -> ahocorasick.Automaton:
    """The automaton of all phrases of k words in some blobs."""
    a = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for p in payloads:
        letters = opened(p, np.uint8)[0].tobytes().decode("ascii")
        for i in range(0, len(letters), k * LETTERS):
            a.add_word(letters[i : i + k * LETTERS])
    a.make_automaton()
    return a


def located(machine: ahocorasick.Automaton, sym: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """Which words of some texts, of n words each, begin a phrase of the automaton."""
    where = np.arange(len(sym)) + np.repeat(np.arange(len(n)), n)
    wide = np.full((len(sym) + len(n), LETTERS), BETWEEN, dtype=np.uint8)
    wide[where] = lettered(sym)
    ends = np.fromiter((e for e, _ in machine.iter(wide.tobytes().decode("ascii"))), dtype=np.int64) + 1
    seen = np.zeros(len(wide), dtype=bool)
    seen[ends[ends % LETTERS == 0] // LETTERS - k] = True
    return seen[where]


def phrases_at(sym: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The spelled phrases of k words from each position, a row of bytes each."""
    return lettered(sym)[at[:, None] + np.arange(k)].reshape(len(at), k * LETTERS)


def phrase_keys(phrases: np.ndarray) -> np.ndarray:
    """A hash of each phrase's letters, which are a multiple of 8 bytes."""
    h = np.zeros(len(phrases), dtype=U)
    for part in np.ascontiguousarray(phrases).view(U).reshape(len(phrases), -1).T:
        h = mix(h + part)
    return h


def confirmed(docs: DataFrame, anchors: Anchors, buckets: int) -> DataFrame:
    """Blobs (bucket; letters): the phrases that occur in several documents, each once for every bucket of documents that it occurs in.

    Nothing is said about documents or positions. A task that has a phrase in
    two documents confirms it to their buckets itself, and tells its shard so
    in one row; other phrases meet in shards.
    """
    n, k = buckets, anchors.k

    def find(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            letters, doc, bucket = (np.concatenate(x) for x in zip(*held, strict=True))
            h = phrase_keys(letters)
            order, start = grouped(h)
            d = doc[order]
            known = np.minimum.reduceat(d, start) != np.maximum.reduceat(d, start)
            first = order[start]
            out = [blob(s, letters[first[i]].ravel(), known[i].astype(np.uint8), doc[first[i]], bucket[first[i]]) for s, i in slots(((h[first] >> U(40)) % U(n)).astype(np.int64), n)]
            at = order[np.repeat(known, np.diff(np.append(start, len(order))))]
            for b, i in slots(bucket[at].astype(np.int64), n):
                i = at[i]
                out.append(blob(-1 - b, letters[i[grouped(h[i])[1]]].ravel()))  # i is sorted by h
            return out

        for b in rows:
            bucket, doc = b.column(0).to_numpy().astype(np.int32), ids_of(b.column(2))
            buf, off = text_arrays(b.column(3))
            for i, j in pieces(off):
                sym, m, d, pos, _, _, _ = anchors.of(buf[off[i] : off[j]], np.diff(off[i : j + 1]))
                if not len(d):
                    continue
                held.append((phrases_at(sym, (np.cumsum(m) - m)[d] + pos, k), doc[i + d], bucket[i + d]))
                size += len(d)
                if size > FLUSH:
                    yield from sent(flush())
                    held, size = [], 0
        if size:
            yield from sent(flush())

    def meet(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, group in runs(rows):
            payloads = [p for b in group for p in b.column(1).to_pylist()]
            if shard < 0:  # confirmed already: passed on
                yield from sent([(-1 - int(shard), p) for p in payloads])
                continue
            letters, known, doc, bucket = gathered(payloads, np.uint8, np.uint8, np.int64, np.int32)
            letters = letters.reshape(len(doc), k * LETTERS)
            order, start = grouped(phrase_keys(letters))
            d = doc[order]
            often = (np.minimum.reduceat(d, start) != np.maximum.reduceat(d, start)) | (np.maximum.reduceat(known[order], start) > 0)
            back = order[np.repeat(often, np.diff(np.append(start, len(order))))]
            back = back[known[back] == 0]
            yield from sent([blob(b, letters[back[i]].ravel()) for b, i in slots(bucket[back].astype(np.int64), n)])

    found = keyed(docs, n).mapInArrow(find, BLOB)
    return by_key(found, n, "shard", meet, BLOB).withColumnRenamed("shard", "bucket")


class Passages:
    """A bucket's documents, streamed through the automaton of the confirmed phrases that occur somewhere in the bucket.

    The automaton's hits, and nothing else, say where.
    """

    def __init__(self, bucket: int, anchors: Anchors, shards: int):
        self.bucket, self.anchors, self.shards = bucket, anchors, shards
        self.payloads, self.machine = [], None
        self.held, self.size = [], 0

    def take(self, payloads: list[bytes]) -> None:
        self.payloads += payloads

    def docs(self, row: pa.Array, doc_id: pa.Array, text: pa.Array) -> Iterator[pa.RecordBatch]:
        k, window = self.anchors.k, self.anchors.window
        if self.payloads:
            self.machine, self.payloads = automaton(self.payloads, k), []
        if self.machine is None:  # no phrase of this bucket is confirmed
            return
        doc = ids_of(doc_id)
        key = key_of(row.to_numpy(), doc)
        buf, off = text_arrays(text)
        for i, j in pieces(off):
            sym, n, d, pos, g, first, last = self.anchors.of(buf[off[i] : off[j]], np.diff(off[i : j + 1]))
            begin = np.cumsum(n) - n
            here = located(self.machine, sym, n, k)[begin[d] + pos] if len(d) else np.empty(0, dtype=bool)
            d, g, first, last = d[here], g[here], first[here], last[here]
            if not len(d):
                continue
            a = begin[d] + first
            size = last - first + 1
            hashes = mix(grams(sym, window))
            where = np.arange(size.sum()) + np.repeat(a - (np.cumsum(size) - size), size)
            self.held.append((hashes[where], size, spans(sym, a, begin[d] + last + window), g, key[i + d], doc[i + d], first, last))
            self.size += len(where)
            if self.size > WINDOWS_HELD:
                yield from self.end()

    def end(self) -> Iterator[pa.RecordBatch]:
        """Settles what the bucket itself shows, and sends one stretch of each kind to its phrase's shard."""
        if not self.held:
            return
        hashes, size, same, g, key, doc, first, last = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.size = [], 0
        order, start = grouped(same)
        least = np.empty(len(doc), dtype=np.int64)
        least[order] = np.repeat(np.minimum.reduceat(doc[order], start), np.diff(np.append(start, len(order))))
        begin = np.cumsum(size) - size
        settled = doc > least
        blobs = []
        if settled.any():
            blobs.append(blob(-1 - self.bucket, key[settled], first[settled].astype(np.uint32), last[settled].astype(np.uint32)))
        at = np.flatnonzero(~settled)
        for s, i in slots(((g[at] >> U(40)) % U(self.shards)).astype(np.int64), self.shards):
            i = at[i]
            m = size[i]
            where = np.arange(m.sum()) + np.repeat(begin[i] - (np.cumsum(m) - m), m)
            blobs.append(blob(s, hashes[where], m.astype(np.uint16), key[i], doc[i], np.full(len(i), self.bucket, np.int32), first[i].astype(np.uint32)))
        yield from sent(blobs)


def judge(buckets: int):
    """A shard's windows to marks: those that an earlier document has."""

    def fn(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, group in runs(rows):
            payloads = [p for b in group for p in b.column(1).to_pylist()]
            if shard < 0:
                yield from sent([(-1 - int(shard), p) for p in payloads])
                continue
            h, n, key, doc, bucket, first = gathered(payloads, *WINDOWS)
            n = n.astype(np.int64)
            owner = np.repeat(np.arange(len(n)), n)
            pos = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n) + first.astype(np.int64)[owner]
            order, start = grouped(h)
            d = doc[owner]
            hit = np.empty(len(h), dtype=bool)
            hit[order] = d[order] > np.repeat(np.minimum.reduceat(d[order], start), np.diff(np.append(start, len(order))))
            at = np.flatnonzero(hit)
            if not len(at):
                continue
            o, p = owner[at], pos[at]
            new = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]) | (p[1:] != p[:-1] + 1)])
            stop = np.append(new[1:], len(at)) - 1
            k, b, a, z = key[o[new]], bucket[o[new]], p[new], p[stop]
            yield from sent([blob(s, k[i], a[i].astype(np.uint32), z[i].astype(np.uint32)) for s, i in slots(b.astype(np.int64), buckets)])

    return fn


class Cut:
    """Removes a bucket's marked words."""

    def __init__(self, window: int, keep_text: bool):
        self.window, self.keep_text = window, keep_text
        self.marks = ByDocument(*MARK)

    def take(self, payloads: list[bytes]) -> None:
        self.marks.add(payloads)

    def docs(self, row: pa.Array, doc_id: pa.Array, text: pa.Array) -> Iterator[pa.RecordBatch]:
        doc = ids_of(doc_id)
        key = key_of(row.to_numpy(), doc)
        buf, off = text_arrays(text)
        n, removed, sha, kept = [], [], [], []
        for x in range(len(doc)):
            w = buf[off[x] : off[x + 1]].tobytes().split()
            first, last = self.marks.of(key[x])
            n.append(len(w))
            if len(first):
                gone = covered(len(w), first, last, self.window)
                w = list(compress(w, (~gone).tolist()))
            removed.append(n[-1] - len(w))
            w = b" ".join(w)
            sha.append(hashlib.sha256(w).hexdigest())
            if self.keep_text:
                kept.append(w.decode("utf-8"))
        out = [null_id(doc), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if self.keep_text:
            out, names = [*out, pa.array(kept, pa.string())], [*names, "text"]
        yield pa.RecordBatch.from_arrays(out, names=names)

    def end(self) -> Iterator[pa.RecordBatch]:
        return iter(())


def dedup(docs: DataFrame, window: int = 50, gram: int = GRAM, keep_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, and with ``keep_text`` the kept words as ``text``.

    Words are runs of bytes other than space and 0x09-0x0D, unchanged; a null
    text has none. Rows without a doc_id come after all others and not before
    each other; of rows with one doc_id, none is earlier. An empty table gives
    none. Words are compared by 64-bit fingerprints. ``gram`` must be a multiple of 4.
    """
    if gram * LETTERS % 8:
        raise ValueError("gram must be a multiple of 4")
    spark = docs.sparkSession
    prepare(spark)
    d = texts(docs)
    n = buckets = n_shards(d, BUCKET_BYTES)
    anchors = Anchors(words_as_symbols, gram, window)
    again = materialize(confirmed(d, anchors, buckets), "phrases")
    passages = beside(d, again, buckets, lambda bucket: Passages(bucket, anchors, buckets), BLOB)
    marks = materialize(by_key(passages, n, "shard", judge(buckets), BLOB).withColumnRenamed("shard", "bucket"), "marks")
    discard(again)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * keep_text
    return beside(d, marks, buckets, lambda bucket: Cut(window, keep_text), schema)
