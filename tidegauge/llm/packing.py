"""Packing token ids into sequences by minimum bin slack.

Documents longer than a sequence are cut into whole sequences and a rest. The
rests of a window of documents are a multiset of lengths. For each sequence,
the longest rest goes in first, and a subset-sum dynamic program over bitsets
finds the lengths, and how many of each, that fill what is left most closely;
the counts come from walking back through the program's stages.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, n_parts, pieces, prepare, text_arrays, texts
from .tokens import encoder

#: Ids held at once: a task packs its documents window by window.
WINDOW_TOKENS = 1 << 21
#: What a document counts for in its window at least: short ones take up memory as objects, not as ids.
LEAST_TOKENS = 64
#: Bytes of an Arrow batch: texts are encoded in smaller pieces anyway.
BATCH_BYTES = 2 << 20
#: Partitions whose sequences with slack are packed once more, together.
TOGETHER = 64


def closest_fill(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """(length, how many) with the greatest sum of at most ``capacity``.

    Lengths are tried from the longest; the program ends as soon as the
    capacity is reached exactly. A count is split in powers of two, so that a
    stage adds one item of a multiple of the length.
    """
    full = (1 << (capacity + 1)) - 1
    reach, stages = 1, []
    for length in sorted((x for x in counts if x <= capacity), reverse=True):
        left, m = min(counts[length], capacity // length), 1
        while left > 0:
            take = min(m, left)
            stages.append((length, take, reach))
            reach |= (reach << (length * take)) & full
            left -= take
            m *= 2
        if reach >> capacity:
            break
    at = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, take, before in reversed(stages):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return sorted(used.items(), reverse=True)


def fill(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Sequences as lists of item numbers; every item (of 1..capacity) is in one."""
    by_length: dict[int, list[int]] = {}
    for i in np.argsort(lengths, kind="stable")[::-1]:
        by_length.setdefault(int(lengths[i]), []).append(int(i))
    counts = {k: len(v) for k, v in by_length.items()}
    out = []
    order = sorted(counts, reverse=True)
    k = 0
    while k < len(order):
        longest = order[k]
        if not counts.get(longest):
            k += 1
            continue
        plan = [(longest, 1)]
        counts[longest] -= 1
        if not counts[longest]:
            del counts[longest]
        plan += closest_fill(counts, capacity - longest)
        sequence = []
        for n, (length, many) in enumerate(plan):
            sequence += [by_length[length].pop() for _ in range(many)]
            if n:
                counts[length] -= many
                if not counts[length]:
                    del counts[length]
        out.append(sequence)
    return out


FIELDS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048, window_tokens: int = WINDOW_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text is empty; its document is the end id alone. Documents are
    packed where they lie, without a shuffle. Only sequences with slack, a few
    of each window, meet again: those of ``TOGETHER`` partitions are packed
    anew. Repeated rows are documents of their own; an empty table gives none.
    """
    spark = docs.sparkSession
    prepare(spark, BATCH_BYTES)

    def window(number: int, ids: list, tokens: list[np.ndarray]) -> tuple[pa.RecordBatch, pa.RecordBatch]:
        rows, rest = [], []  # (document, start, length, sequence, offset)
        n = 0
        for d, t in enumerate(tokens):
            whole = len(t) // capacity
            for k in range(whole):
                rows.append((d, k * capacity, capacity, n, 0))
                n += 1
            if len(t) % capacity:
                rest.append((d, whole * capacity, len(t) % capacity))
        again = []
        for sequence in fill(np.array([r[2] for r in rest], dtype=np.int64), capacity):
            done = sum(rest[i][2] for i in sequence) == capacity
            at = 0
            for i in sequence:
                (rows if done else again).append((*rest[i], n, at))
                at += rest[i][2]
            n += 1
        return [_batch(ids, tokens, r, number) for r in (rows, again)]

    def _batch(ids, tokens, rows, number) -> pa.RecordBatch:
        crc = [zlib.crc32(tokens[d][s : s + n].astype("<u4").tobytes()) for d, s, n, _, _ in rows]
        d, s, n, q, o = np.array(rows, dtype=np.int64).reshape(-1, 5).T
        return pa.RecordBatch.from_arrays([pa.array([ids[x] for x in d], pa.int64()), pa.array(s), pa.array(n), pa.array(crc, pa.int64()), pa.array([len(tokens[x]) for x in d], pa.int64()), pa.array(q + number), pa.array(o)], names=[f.split()[0] for f in FIELDS.split(", ")])

    def first(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # what the worker's earlier tasks left
        part, enc, w = TaskContext.get().partitionId(), encoder(tokenizer), 0
        ids, tokens, held = [], [], 0

        def flush():
            nonlocal ids, tokens, held, w
            # sequence_id: 22 bits of partition, 14 of window, 26 of sequence
            for b, slack in zip(window((part << 40) + (w << 26), ids, tokens), (False, True), strict=True):
                yield b.append_column("part", pa.array(np.full(b.num_rows, part // TOGETHER if slack else -1), pa.int32()))
            ids, tokens, held = [], [], 0
            w += 1

        for b in rows:
            for i, j in pieces(text_arrays(b.column(1))[1]):
                ids += b.column(0).slice(i, j - i).to_pylist()
                for t in enc.encode(b.column(1).slice(i, j - i).to_pylist()):
                    tokens.append(np.append(t, np.uint32(end_id)))
                    held += max(len(tokens[-1]), LEAST_TOKENS)
                if held >= window_tokens:
                    yield from flush()
        if ids:
            yield from flush()
        enc.clear()
        give_back()

    def second(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in rows:
            slack = np.asarray(b.column(7)) >= 0
            yield b.filter(pa.array(~slack)).drop_columns(["part"])
            if slack.any():
                held.append(b.filter(pa.array(slack)))
        if not held:
            return
        t = pa.Table.from_batches(held).sort_by([(c, "ascending") for c in ("part", "sequence_id", "offset")])
        group, length = t["part"].to_numpy(), t["length"].to_numpy()
        for g in np.unique(group):
            at = np.flatnonzero(group == g)
            sequence, offset = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
            for n, items in enumerate(fill(length[at], capacity)):
                sequence[items] = (1 << 62) + (int(g) << 32) + n
                offset[items] = np.cumsum(length[at][items]) - length[at][items]
            b = t.take(pa.array(at)).combine_chunks().drop_columns(["part", "sequence_id", "offset"])
            yield from b.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).to_batches()

    packed = texts(docs).mapInArrow(first, FIELDS + ", part int")
    where = F.when(F.col("part") >= 0, F.hash(F.lit("slack"), F.col("part"))).otherwise(F.hash("sequence_id"))
    return packed.repartition(n_parts(spark), where).mapInArrow(second, FIELDS)
