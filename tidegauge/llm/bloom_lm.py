"""Language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs over all training texts are quantised,
q(c) = 1 + floor(log_b(c)), and (n-gram, j) is put into the filter for every j
up to q. A probe for j = 1, 2, ... until one misses gives the count back. Every
n-gram goes in: the filter has a segment per shard of n-grams, built where the
counts meet, with BITS_PER_ENTRY bits for each entry there. Nothing of it is
broadcast. A task sends each n-gram of some million tokens once to its shard,
where the segment is probed, and the levels meet the tokens again.

The unigram base score is exact: words' counts come back with their levels.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, SHARD_BYTES, by_key, ids_of, materialize, n_shards, pieces, prepare, runs, slots, text_arrays, texts
from .seqhash import U, mix, words
from .sequence_dedup import BLOB, blob, null_id, opened, sent

#: Probes of an entry, and bits that an entry has.
PROBES, BITS_PER_ENTRY = 4, 9
#: Levels per doubling of a count, for words and for pairs.
LEVELS = (4, 2)
#: Bits of a pair's hash. That two of a billion pairs share one is a thousand times less likely than the filter's own false hits.
PAIR_BITS = 48
#: Weight of the unigram distribution in a word's history.
PRIOR = 60.0
#: Tokens gathered before their counts or questions are sent on.
FLUSH = 1 << 21
#: N-grams put into a segment at a time.
STEP = 1 << 18
TOP = 160

END, START = U(0x5BD1E9955BD1E995), U(0x27D4EB2F165667C5)


def fold_of(doc: np.ndarray, folds: int) -> np.ndarray:
    """crc32 of the doc_id as text modulo folds; of an empty text without an id."""
    return np.array([zlib.crc32(b"" if d == LAST_ID else str(d).encode()) % folds for d in doc.tolist()], dtype=np.int64)


def tokens(buf: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hashes with an end per text, hashes of the pairs with the token before, number per text)."""
    h, _, _, n = words(buf, lengths, lower=True)
    at = np.cumsum(n + 1) - 1
    out = np.empty(len(h) + len(n), dtype=U)
    end = np.zeros(len(out), dtype=bool)
    end[at] = True
    out[end], out[~end] = END, h
    return out, pairs_of(out, at - n), n + 1


def pairs_of(token: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hashes, of PAIR_BITS bits, of each token with the one before; ``first``: where texts begin."""
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[first] = START
    return mix(before * U(0x9E3779B97F4A7C15) + token) >> U(64 - PAIR_BITS)


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return (h % U(shards)).astype(np.int64)


def level(count: np.ndarray, per: int) -> np.ndarray:
    return 1 + np.floor(np.log2(count) * per + 1e-9).astype(np.int64)


def count_at(levels: np.ndarray, per: int) -> np.ndarray:
    """The middle of the counts that a level stands for, 0 for level 0."""
    low, high = np.ceil(2.0 ** ((levels - 1) / per) - 1e-9), np.ceil(2.0 ** (levels / per) - 1e-9) - 1
    return np.where(levels > 0, (low + np.maximum(low, high)) / 2, 0.0)


def thinned(h: np.ndarray) -> np.ndarray:
    """Ascending hashes as the bytes of their differences, the same byte of all together: the leading ones are mostly 0."""
    return np.ascontiguousarray(np.diff(h, prepend=U(0)).view(np.uint8).reshape(-1, 8).T).ravel()


def thickened(raw: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view(U).ravel(), dtype=U)


class Filter:
    """Bits in ``segments`` equal parts; an n-gram's entries lie in its own part."""

    def __init__(self, segments: int, bits: int):
        self.segments, self.size = segments, min(bits // segments // 64 * 64, (1 << 32) - 64)
        self.data: list[np.ndarray] = []

    def segment(self, h: np.ndarray) -> np.ndarray:
        return (h >> U(40)) % U(self.segments)

    @staticmethod
    def entry(h: np.ndarray, j: np.ndarray | int) -> np.ndarray:
        return mix(h + np.asarray(j).astype(U) * U(0xC2B2AE3D27D4EB4F))

    def position(self, entry: np.ndarray, probe: int) -> np.ndarray:
        """Of an entry's hash, half of it or of a multiple, scaled to the segment."""
        x = entry if probe < 2 else entry * U(0x9FB21C651E98DF25)
        return ((x >> U(32) if probe % 2 else x & U(0xFFFFFFFF)) * U(self.size)) >> U(32)

    def build(self, h: np.ndarray, lowest: int, levels: np.ndarray, into: np.ndarray) -> None:
        """Sets the entries lowest..levels of each n-gram in one segment's bit array (a byte per bit)."""
        n = np.maximum(levels - lowest + 1, 0)
        x = self.entry(np.repeat(h, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lowest)
        for p in range(PROBES):
            into[self.position(x, p).astype(np.int64)] = 1

    def load(self, segments: list[bytes]) -> None:
        self.bytes = np.frombuffer(b"".join(segments), dtype=np.uint8)

    def levels(self, h: np.ndarray, lowest: int) -> np.ndarray:
        """The highest level of each n-gram by repeated probes, 0 if it isn't there."""
        out = np.zeros(len(h), dtype=np.int64)
        base = self.segment(h) * U(self.size)
        live = np.arange(len(h))
        j = lowest
        while len(live) and j < TOP:
            x, start = self.entry(h[live], j), base[live]
            for p in range(PROBES):
                at = start + self.position(x, p)
                hit = (self.bytes[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & 1 > 0
                live, x, start = live[hit], x[hit], start[hit]
                if not len(live):
                    break
            out[live] = j
            j += 1
        return out


def segment(grams: list[tuple[np.ndarray, np.ndarray]]) -> Filter:
    """A filter of one segment, sized by its entries, of (hashes, counts) of words and of pairs."""
    levels = [level(c, per) for (_, c), per in zip(grams, LEVELS, strict=True)]
    f = Filter(1, 64 + BITS_PER_ENTRY * int(sum(x.sum() for x in levels)))
    into = np.zeros(f.size, dtype=np.uint8)
    for (h, _), x in zip(grams, levels, strict=True):
        for at in range(0, len(h), STEP):
            f.build(h[at : at + STEP], 1, x[at : at + STEP], into)
    f.load([np.packbits(into, bitorder="little").tobytes()])
    return f


def log10(count: np.ndarray, both: np.ndarray, first: np.ndarray, total: int, distinct: int, texts: int) -> np.ndarray:
    """log10 p(token | token before) by the counts of tokens and pairs; ``first``: where texts begin."""
    before = np.empty_like(count)
    before[1:] = count[:-1]
    before[first] = texts
    one = (count + 1) / (total + distinct + 1)
    return np.log10((np.minimum(both, before) + PRIOR * one) / (before + PRIOR))


def lowest_levels(histogram: np.ndarray, bits: int) -> tuple[int, int]:
    """For words and pairs, the lowest level that a filter of so many bits could keep; score() keeps all.

    ``histogram[kind, level]`` counts n-grams. From everything, the level whose
    n-grams are least frequent goes out first, pairs before words.
    """
    low = [1, 1]

    def entries(kind: int) -> int:
        j = np.arange(TOP)
        return int((histogram[kind] * np.maximum(j - low[kind] + 1, 0)).sum())

    while entries(0) + entries(1) > bits // BITS_PER_ENTRY and min(low) < TOP - 1:
        floor = [2 ** ((low[k] - 1) / LEVELS[k]) for k in (0, 1)]
        low[0 if floor[0] < floor[1] and entries(0) else 1 if entries(1) else 0] += 1
    return low[0], low[1]


def score(docs: DataFrame, folds: int = 7, held_fold: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows whose crc32(doc_id as text) mod folds isn't ``held_fold``
    (a null doc_id counts as an empty text). A null or empty text has just its
    end token. Copies and repeated rows count each. An empty table gives none.
    Words are told apart by 64-bit fingerprints.
    """
    spark = docs.sparkSession
    prepare(spark)
    d = texts(docs)
    n = n_shards(d, SHARD_BYTES // 4)

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, texts_ = [], 0, 0

        def flush():
            out = []
            for kind, x in enumerate(zip(*held, strict=True)):
                h, c = np.unique(np.concatenate(x), return_counts=True)
                for s, i in slots(shard_of(h, n), n):
                    out.append(blob(s, np.array([kind, texts_ if kind == 0 and not out else 0]), thinned(h[i]), c[i].astype(np.uint32)))
            return out

        for b in rows:
            train = fold_of(ids_of(b.column(0)), folds) != held_fold
            column = b.column(1).filter(pa.array(train))
            buf, off = text_arrays(column)
            for i, j in pieces(off):
                t, p, m = tokens(buf[off[i] : off[j]], np.diff(off[i : j + 1]))
                held.append((t, p))
                size += len(t)
                texts_ += len(m)
                if size > FLUSH:
                    yield from sent(flush())
                    held, size, texts_ = [], 0, 0
        if size:
            yield from sent(flush())

    def build(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, group in runs(rows):
            parts, texts_ = ([], []), 0
            for b in group:
                for p in b.column(1).to_pylist():
                    k, h, c = opened(p, np.int64, np.uint8, np.uint32)
                    parts[k[0]].append((thickened(h), c))
                    texts_ += int(k[1])
            del group
            both = []
            for mine in parts:
                h, c = (np.concatenate(x) for x in zip((np.empty(0, U), np.empty(0, np.uint32)), *mine, strict=True))
                mine.clear()
                order = np.argsort(h, kind="stable")
                h, c = h[order], c[order].astype(np.int64)
                start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, np.int64)
                both.append((h[start], np.add.reduceat(c, start) if len(h) else c))
            h, c = both[0]
            row = [int(shard), len(h), int(c.sum()), texts_, blob(0, h, c, segment(both).bytes)[1]]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["shard", "types", "tokens", "texts", "payload"])

    segments = materialize(by_key(d.mapInArrow(count, BLOB), n, "shard", build, "shard int, types long, tokens long, texts long, payload binary"), "segments")
    stats = segments.drop("payload").collect()  # a row a shard
    all_tokens, all_types, all_texts = (sum(r[f] for r in stats) for f in ("tokens", "types", "texts"))
    divisor = np.log10(float(all_tokens + all_types + 1))
    parcel = "shard int, flush long, part int, payload binary"

    def parcels(rows: list[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for i, r in enumerate(rows):
            held.append(r)
            size += len(r[3])
            if size > 4 << 20 or i == len(rows) - 1:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["shard", "flush", "part", "payload"])
                held, size = [], 0

    def asked(token: np.ndarray, pair: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, its words, its pairs), as indices in the order in which they are asked and answered."""
        w, p = dict(slots(shard_of(token, n), n)), dict(slots(shard_of(pair, n), n))
        none = np.empty(0, np.int64)
        for s in sorted(w.keys() | p.keys()):
            yield s, w.get(s, none), p.get(s, none)

    def ask(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each word and pair of a flush to its shard once, and the flush itself, as numbers of words, on to where the answers go."""
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            token, pair, doc, held_out, m = (np.concatenate(x) for x in zip(*held, strict=True))
            kinds, which, often = np.unique(token, return_inverse=True, return_counts=True)
            order = np.argsort(-often, kind="stable")  # frequent words have small numbers
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            kinds, which, pair = kinds[order], rank[which].astype(np.uint32), np.unique(pair)
            id_ = (part << 24) + number
            out = [(-1 - (part + 31 * number) % n, id_, -1, blob(0, doc, held_out, m, kinds, which.astype(np.uint16), (which >> 16).astype(np.uint16))[1])]
            out += [(s, id_, 1, blob(0, kinds[w], thinned(pair[p]))[1]) for s, w, p in asked(kinds, pair)]
            return out

        for b in rows:
            doc = ids_of(b.column(0))
            held_out = (fold_of(doc, folds) == held_fold).astype(np.uint8)
            buf, off = text_arrays(b.column(1))
            for i, j in pieces(off):
                t, p, m = tokens(buf[off[i] : off[j]], np.diff(off[i : j + 1]))
                held.append((t, p, doc[i:j], held_out[i:j], m))
                size += len(t)
                if size > FLUSH:
                    yield from parcels(flush())
                    number, held, size = number + 1, [], 0
        if size:
            yield from parcels(flush())

    def answer(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each question the words' counts and levels and the pairs' levels; a shard's segment comes before its questions."""
        now, h, c, bloom = None, None, None, None
        for b in rows:
            out = []
            for shard, flush, part, payload in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if shard < 0:
                    out.append((-1 - shard, flush, part, payload))
                    continue
                if shard != now:
                    now, bloom = shard, None
                if part == 0:
                    h, c, bits = opened(payload, U, np.int64, np.uint8)
                    bloom = Filter(1, len(bits) * 8)
                    bloom.load([bits.tobytes()])
                    continue
                w, p = opened(payload, U, np.uint8)
                p = thickened(p)
                count, lw, lp = np.zeros(len(w), np.int64), np.zeros(len(w), np.uint8), np.zeros(len(p), np.uint8)
                if bloom is not None:
                    if len(h):
                        at = np.minimum(np.searchsorted(h, w), len(h) - 1)
                        count = np.where(h[at] == w, c[at], 0)
                    lw, lp = (bloom.levels(x, 1).astype(np.uint8) for x in (w, p))
                out.append(((flush // (1 << 24) + 31 * (flush % (1 << 24))) % n, flush, shard, blob(0, count, lw, lp)[1]))
            yield from parcels(out)

    def finish(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in runs(rows, "flush"):
            parts = {s: p for b in group for s, p in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)}
            doc, held_out, m, kinds, low, high = opened(parts.pop(-1), np.int64, np.uint8, np.int64, U, np.uint16, np.uint16)
            which = low.astype(np.int64) + (high.astype(np.int64) << 16)
            first = np.cumsum(m) - m
            pair, place = np.unique(pairs_of(kinds[which], first), return_inverse=True)
            exact, words_, both = np.empty(len(kinds), np.int64), np.empty(len(kinds), np.int64), np.empty(len(pair), np.int64)
            for s, w, p in asked(kinds, pair):
                exact[w], words_[w], both[p] = opened(parts.pop(s), np.int64, np.uint8, np.uint8)
            owner = np.repeat(np.arange(len(m)), m)
            value = log10(count_at(words_, LEVELS[0])[which], count_at(both, LEVELS[1])[place], first, all_tokens, all_types, all_texts)
            value = np.bincount(owner, weights=value, minlength=len(m))
            base = np.bincount(owner, weights=np.log10(exact + 1.0)[which], minlength=len(m)) - m * divisor
            known = np.bincount(owner, weights=(exact > 0)[which], minlength=len(m)).astype(np.int64)
            for i in range(0, len(m), 8192):
                s = slice(i, i + 8192)
                yield pa.RecordBatch.from_arrays([null_id(doc[s]), pa.array(held_out[s] > 0), pa.array(m[s]), pa.array(known[s]), pa.array(np.full(len(m[s]), all_tokens)), pa.array(base[s]), pa.array(value[s])], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    own = segments.select("shard", F.lit(0).cast("long").alias("flush"), F.lit(0).alias("part"), "payload")
    answers = by_key(d.mapInArrow(ask, parcel).unionByName(own), n, "shard", answer, parcel, "part")
    return by_key(answers, n, "shard", finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double", "flush", "part")
