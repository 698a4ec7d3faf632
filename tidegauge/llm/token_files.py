"""Token ids in flat unsigned integer files with 64-bit document offsets.

Layout of a folder, one set of files for each partition of the doc_id order:
``tokens-NNNNN.bin`` ids (uint16 if they all fit, else uint32, little-endian),
``tokens-NNNNN.idx`` uint64 offsets, one more than documents, counted in ids
from the start of the whole corpus, and ``tokens-NNNNN.doc`` int64 doc_ids
(2**63-1: none). ``manifest.json`` has the partitions' bases.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .common import LAST_ID, n_shards, pieces, prepare, shared_dir, text_arrays, texts
from .tokens import encoder


def _name(folder: str, part: int, kind: str) -> str:
    return f"{folder}/tokens-{part:05d}.{kind}"


def write(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> str:
    """Encodes all documents into ``folder`` (a fresh one in the shared folder if None) and returns it.

    Documents are in ascending doc_id order, those without an id last; of equal
    ids, by a hash of the text. A null text is an empty one: its document has
    the end id only. An empty table gives a manifest without documents. The
    driver sees one pair of counts per partition; their prefix sums are the
    partitions' bases.
    """
    spark = docs.sparkSession
    prepare(spark)
    folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    top = max(encoder(tokenizer).tokenizer.get_vocab_size(with_added_tokens=True) - 1, end_id)
    dtype = "<u2" if top < 1 << 16 else "<u4"

    def put(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, enc, ids, sizes = TaskContext.get().partitionId(), encoder(tokenizer), [], []
        with store.Writer(_name(folder, part, "bin")) as out:
            for b in rows:
                column, off = b.column(1), text_arrays(b.column(1))[1]
                ids.append(b.column(0).to_numpy(zero_copy_only=False))
                for i, j in pieces(off):
                    coded = enc.encode(column.slice(i, j - i).to_pylist())
                    sizes += [len(c) + 1 for c in coded]
                    end = np.array([end_id], dtype=np.uint32)
                    out.write(np.concatenate([x for c in coded for x in (c, end)]).astype(dtype).tobytes())
        with store.Writer(_name(folder, part, "doc")) as out:
            out.write(np.concatenate([np.empty(0, np.int64), *ids]).astype("<i8").tobytes())
        with store.Writer(_name(folder, part, "len")) as out:
            out.write(np.array(sizes, dtype="<u8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(sizes)], pa.int64()), pa.array([sum(sizes)], pa.int64())], names=["part", "docs", "tokens"])

    rows = texts(docs).select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc_id"), "text")
    order = [F.col("doc_id"), F.xxhash64("text")]
    counts = rows.repartitionByRange(n_shards(rows), *order).sortWithinPartitions(*order).mapInArrow(put, "part int, docs long, tokens long").collect()
    counts = sorted((r.part, r.docs, r.tokens) for r in counts)
    base, parts = 0, []
    for part, n, tokens in counts:
        parts.append([part, base, n, tokens])
        base += tokens

    def offsets(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for k in b.column(0).to_pylist():
                part, base, _, _ = parts[k]
                sizes = store.load(_name(folder, part, "len"), "<u8")
                with store.Writer(_name(folder, part, "idx")) as out:
                    out.write((np.append(0, np.cumsum(sizes)).astype("<u8") + np.uint64(base)).tobytes())
            yield b

    if parts:
        spark.range(0, len(parts), 1, len(parts)).mapInArrow(offsets, "id long").write.format("noop").mode("overwrite").save()
    with store.Writer(f"{folder}/manifest.json") as out:
        out.write(json.dumps({"dtype": dtype, "tokens": base, "end_id": end_id, "parts": parts}).encode())
    return folder


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the mapped files.

    ids_crc32 is over the ids as little-endian unsigned 32-bit integers.
    """
    prepare(spark)
    where, path = store.at(f"{folder}/manifest.json")
    with where.open_input_file(path) as f:
        manifest = json.loads(f.read())
    parts, dtype = manifest["parts"], manifest["dtype"]

    def get(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for k in b.column(0).to_pylist():
                part = parts[k][0]
                ids, idx, doc = (store.load(_name(folder, part, kind), t) for kind, t in (("bin", dtype), ("idx", "<u8"), ("doc", "<i8")))
                at = (idx - idx[0]).astype(np.int64)
                for i in range(0, len(doc), 4096):
                    j = min(len(doc), i + 4096)
                    crc = [zlib.crc32(ids[a:z].astype("<u4").tobytes()) for a, z in zip(at[i:j], at[i + 1 : j + 1], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(doc[i:j], mask=np.asarray(doc[i:j]) == LAST_ID), pa.array(idx[i:j].astype(np.int64)), pa.array(np.diff(at[i : j + 1])), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.range(0, len(parts), 1, max(1, len(parts))).mapInArrow(get, "doc_id long, start long, n_tokens long, ids_crc32 long")
