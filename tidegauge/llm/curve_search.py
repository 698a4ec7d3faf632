"""Approximate nearest neighbours by cosine along shifted space-filling curves.

Unit vectors are projected by seeded rotations to a few dimensions, made even
by the sample's quantiles, shifted, and ordered along a Hilbert curve, several
times over. Spark range-partitions each ordering, so that a row's rank is its
partition's base plus its place; of a vector, an ordering holds a code of one
byte a component. A query looks at the rows within its window of ranks on each
ordering: at those of its own partition where they lie, and across the
partition's ends at the rows near the ends of the neighbouring ones, which alone
are dealt once more. What the orderings find merges, and the best are ranked
anew by exact cosines of the vectors.

The windows are fitted before any row is ordered: for a bounded sample of
queries the true neighbours are found by brute force, and one pass counts the
rows before each of these on every ordering. Of all numbers of orderings, with
the window that finds the wanted share of the neighbours on them, the one with
the fewest rows to look at is taken. That is never more than one ordering with
all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from . import hilbert
from .common import by_key, materialize, n_parts, prepare, runs
from .vectors import best, dimension, matrices

#: Orderings at most; dimensions and bits of each one's cells.
CURVES, DIMS, BITS = 32, 8, 6
#: Rows of a block, at least and at most: about as many as a window has.
BLOCKS = 256, 16384
#: Bytes of codes in a partition of an ordering, which a task holds; a code's key, id and length are RECORD bytes.
PART_BYTES, RECORD = 64 << 20, 32
#: Bounds of the samples that fit the quantiles and the window.
SAMPLE, PROBES = 4096, 256
#: Share of the probes' true neighbours that the window must reach.
REACH = 0.95
#: Finalists a query keeps beyond k until exact cosines rank them: codes tell scores to about 0.005.
SPARE = 11


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; dividing by the largest component first avoids overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows, alike wherever the pair is met."""
    a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """float64 vectors from their bytes, which are those of float32 where the table holds such."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), dtype=np.float32 if len(raw[0]) == 4 * d else np.float64).reshape(-1, d).astype(np.float64)


def coded(x: np.ndarray) -> list[bytes]:
    """Each unit vector as a float32 step and a signed byte a component."""
    step = (np.abs(x).max(axis=1, keepdims=True) / 127).astype(np.float32)
    return [s.tobytes() + c.tobytes() for s, c in zip(step, np.rint(x / step).astype(np.int8), strict=True)]


def decoded(codes: list[bytes], d: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(codes), dtype=np.int8).reshape(-1, 4 + d)
    return raw[:, 4:] * np.ascontiguousarray(raw[:, :4]).view(np.float32)


class Curves:
    def __init__(self, sample: np.ndarray, count: int, dims: int, bits: int, seed: int):
        rng = np.random.default_rng(seed)
        d = sample.shape[1]
        self.bits, self.dims = bits, min(dims, d)
        self.rotations = [np.linalg.qr(rng.normal(size=(d, d)))[0][:, : self.dims] for _ in range(count)]
        self.shifts = [rng.random(self.dims) for _ in range(count)]
        self.quantiles = [np.sort(sample @ r, axis=0) for r in self.rotations]

    def keys(self, x: np.ndarray, c: int) -> np.ndarray:
        """Keys of unit vectors in ordering c: quantiles fill half the cube, from a shifted corner."""
        y, q = x @ self.rotations[c], self.quantiles[c]
        even = np.stack([np.searchsorted(q[:, i], y[:, i]) for i in range(self.dims)], axis=1) / max(1, len(q))
        return hilbert.keys(np.minimum(((even + self.shifts[c]) / 2 * (1 << self.bits)).astype(np.int64), (1 << self.bits) - 1), self.bits)


def within(ranks: np.ndarray, ids: np.ndarray, x: np.ndarray, lo: np.ndarray, hi: np.ndarray, q: np.ndarray, v: np.ndarray, keep: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query's place, ids, scores): the best of the rows that rank from lo to hi, but the query itself."""
    first, last = np.searchsorted(ranks, lo, "left"), np.searchsorted(ranks, hi, "right")
    for y in np.flatnonzero(last > first):
        score = x[first[y] : last[y]] @ v[y]
        score[ids[first[y] : last[y]] == q[y]] = -np.inf
        top = best(score[None], keep)[0]
        top = top[score[top] > -np.inf]
        yield int(y), ids[first[y] + top], score[top]


def search(vectors: DataFrame, queries: str = "vec_id % 50 = 0", k: int = 5, curves: int = CURVES, reach: float = REACH, seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found.

    Vectors that are null, zero or of another length than most, or that hold
    null or non-finite components, and rows without an id take no part. Equal
    vectors are searched as one and come back as their smallest ids; ties go to
    the smaller vec_id. Repeated rows count once. With no valid vector the
    result is empty; with fewer than k others, all are found.
    """
    spark = vectors.sparkSession
    prepare(spark)
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    d = dimension(source)
    empty = "query_id long, rank int, vec_id long, score double"
    if not d:
        return spark.createDataFrame([], empty)
    kind = np.float32 if source.schema["embedding"].dataType.elementType == FloatType() else np.float64

    def parse(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in matrices(rows, d):
            some = np.abs(x).max(axis=1) > 0
            x = (x[some] + 0.0).astype(kind)  # -0.0 is 0.0
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array([v.tobytes() for v in x], pa.binary())], names=["vec_id", "v"])

    rows = source.mapInArrow(parse, "vec_id long, v binary").withColumn("h", F.unhex(F.sha2("v", 256)))
    ids = materialize(rows.select("h", "vec_id"), "ids")
    # equal vectors combine before they are shuffled: a task sends one row of them
    groups = rows.groupBy("h").agg(F.min("vec_id").alias("g"), F.max(F.coalesce(F.expr(queries), F.lit(False))).alias("ask"), F.first("v").alias("v"))
    groups = materialize(groups, "groups")
    least = ids.distinct().withColumn("nth", F.row_number().over(W.partitionBy("h", F.pmod(F.hash("vec_id"), F.lit(32))).orderBy("vec_id"))).where(f"nth <= {k + 1}")
    least = least.groupBy("h").agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1).alias("ids"))
    asked = ids.where(queries).select(F.col("vec_id").alias("query_id"), "h").distinct()
    asked = materialize(asked.join(groups.where("ask").select("h", "g"), "h").select("query_id", "g"), "queries")
    points = groups.select("g", "v", "ask")
    total = points.count()
    sample = points.orderBy(F.xxhash64("g"), "g").limit(SAMPLE).collect()
    if not total or asked.limit(1).count() == 0:
        return spark.createDataFrame([], empty)
    curve = spark.sparkContext.broadcast(Curves(unit(np.stack([np.frombuffer(r.v, kind).astype(np.float64) for r in sample])), curves, DIMS, BITS, seed))
    used, window = _window(points, curve, d, k, reach, total)
    n = max(n_parts(spark), -(-used * total * (d + RECORD) // PART_BYTES))
    block = min(max(BLOCKS[0], 2 * window), BLOCKS[1])
    keep = k + SPARE

    def place(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for i in range(0, b.num_rows, 2048):
                s = b.slice(i, 2048)
                x = unit(matrix(s.column(1), d))
                code = pa.array(coded(x), pa.binary())
                full = pa.array([v if ask else None for v, ask in zip(s.column(1).to_pylist(), s.column(2).to_pylist(), strict=True)], pa.binary())
                for c in range(used):
                    yield pa.RecordBatch.from_arrays([pa.array(c << DIMS * BITS | curve.value.keys(x, c)), s.column(0), code, full], names=["key", "g", "code", "full"])

    def run(part: int, c: int, held: list[pa.RecordBatch], starts: bool, ends: bool) -> Iterator[pa.RecordBatch]:
        """An ordering's rows in one partition: their number, what their queries find among them, and the rows near the ends where others may follow."""
        t = pa.Table.from_batches(held)
        size, g = t.num_rows, t.column("g").to_numpy()
        at = np.flatnonzero(t.column("full").is_valid().to_numpy())
        yield row(part, c, place=[size])
        if len(at):
            q, v = g[at], unit(matrix(t.column("full").take(pa.array(at)), d)).astype(np.float32)
            found = [(np.empty(0, np.int64), np.empty(0, np.float32))] * len(at)
            for i in range(0, size, BLOCKS[1]):
                j = min(i + BLOCKS[1], size)
                a, z = np.searchsorted(at, i - window, "left"), np.searchsorted(at, j - 1 + window, "right")
                if a == z:
                    continue
                x = decoded(t.column("code").slice(i, j - i).to_pylist(), d)
                for y, ids, score in within(np.arange(i, j), g[i:j], x, at[a:z] - window, at[a:z] + window, q[a:z], v[a:z], keep):
                    ids, score = np.r_[found[a + y][0], ids], np.r_[found[a + y][1], score]
                    top = best(score[None], keep)[0]
                    found[a + y] = ids[top], score[top]
            some = [f for f in found if len(f[0])]
            if some:
                yield row(part, c, q=np.repeat(q, [len(f[0]) for f in found]), g=np.concatenate([f[0] for f in some]), score=np.concatenate([f[1] for f in some]).astype(np.float64))
        edge = np.arange(size)
        edge = edge[((edge < window) & (not starts)) | ((edge >= size - window) & (not ends))]
        for i in range(0, len(edge), BLOCKS[1]):
            s = t.take(pa.array(edge[i : i + BLOCKS[1]]))
            yield row(part, c, place=edge[i : i + BLOCKS[1]], g=s.column("g").to_numpy(), code=s.column("code").combine_chunks(), full=s.column("full").combine_chunks())

    def local(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), None
        for c, held in runs(rows, "curve"):
            if before:
                yield from run(part, *before[:2], starts=before[2], ends=True)
            before = c, held, before is not None or part == 0
        if before:
            yield from run(part, *before[:2], starts=before[2], ends=False)

    # an ordering's number is above its keys' bits
    placed = points.mapInArrow(place, "key long, g long, code binary, full binary").repartitionByRange(n, "key", "g").sortWithinPartitions("key", "g")
    placed = placed.select(F.shiftright("key", DIMS * BITS).cast("int").alias("curve"), "g", "code", "full")
    looked = materialize(placed.mapInArrow(local, FOUND), "looked")
    base, end, upto = {}, {}, {}
    for r in sorted(looked.where("g is null").select("part", "curve", "place").collect(), key=lambda r: (r.curve, r.part)):
        base[r.part, r.curve] = upto.get(r.curve, 0)
        end[r.part, r.curve] = upto[r.curve] = base[r.part, r.curve] + r.place

    def rank(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ranks for places, and of queries the ranks that their partition lacks, as up to two ranges."""
        for b in rows:
            p, c, r = (b.column(i).to_numpy() for i in range(3))
            lo, hi = np.empty(len(r), np.int64), np.empty(len(r), np.int64)
            for x, y in set(zip(p.tolist(), c.tolist(), strict=True)):
                at = (p == x) & (c == y)
                lo[at], hi[at] = base[x, y], end[x, y]
            r = r + lo
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(r), *b.columns[3:], pa.array(np.maximum(r - window, 0)), pa.array(lo - 1), pa.array(hi), pa.array(np.minimum(r + window, total - 1))], names=["curve", "rank", *b.schema.names[3:], "lo1", "hi1", "lo2", "hi2"])

    edges = looked.where("code is not null").select("part", "curve", "place", "g", "code", "full")
    edges = edges.mapInArrow(rank, "curve int, rank long, g long, code binary, full binary, lo1 long, hi1 long, lo2 long, hi2 long")
    spans = F.array(*(F.struct(F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi")) for i in (1, 2)))
    q = edges.where("full is not null").select("curve", "rank", "g", F.col("full").alias("payload"), F.explode(spans).alias("span")).select("*", "span.lo", "span.hi").where("lo <= hi")
    q = q.withColumns({"block": F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor(F.col("hi") / block))), "kind": F.lit(1)}).drop("span")
    none = F.lit(None).cast("long")
    both = edges.select("curve", "rank", "g", F.col("code").alias("payload"), none.alias("lo"), none.alias("hi"), F.floor(F.col("rank") / block).alias("block"), F.lit(0).alias("kind")).unionByName(q)
    both = both.select((F.col("curve") * (total // block + 1) + F.col("block")).alias("at"), "kind", "rank", "g", "lo", "hi", "payload")

    def look(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a block, after its rows in their order: each query's best among the rows in its range."""
        now, held, x = None, [], None
        for b in rows:
            key, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
            cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            for i, j in zip(cut, np.r_[cut[1:], len(key)], strict=True):
                s = b.slice(i, j - i)
                if key[i] != now:
                    now, held, x = key[i], [], None
                z = int(np.searchsorted(kind[i:j], 1))
                if z:
                    held.append((s.column(2).to_numpy()[:z], s.column(3).to_numpy()[:z], decoded(s.column(6).slice(0, z).to_pylist(), d)))
                if z == s.num_rows or not (held or x is not None):
                    continue
                if x is None:
                    ranks, ids, x = (np.concatenate(y) for y in zip(*held, strict=True))
                    held = []
                s = s.slice(z)
                q, v = s.column(3).to_numpy(), unit(matrix(s.column(6), d)).astype(np.float32)
                out = [(np.full(len(f), q[y]), f, score.astype(np.float64)) for y, f, score in within(ranks, ids, x, s.column(4).to_numpy(), s.column(5).to_numpy(), q, v, keep)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["q", "g", "score"])

    across = by_key(both, n_parts(spark), "at", look, "q long, g long, score double", "kind", "rank")
    found = looked.where("q is not null").select("q", "g", "score").unionByName(across).groupBy("q", "g").agg(F.max("score").alias("score"))
    found = found.withColumn("nth", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "g"))).where(f"nth <= {keep}").select("q", "g")
    found = found.unionByName(asked.select(F.col("g").alias("q"), "g").distinct())  # copies of the query itself
    pairs = found.join(points.select("g", "v"), "g").join(points.where("ask").select(F.col("g").alias("q"), F.col("v").alias("qv")), "q").select("q", "g", "qv", "v")

    def rerank(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cosines(matrix(b.column(2), d), matrix(b.column(3), d)))], names=["q", "g", "score"])

    exact = pairs.mapInArrow(rerank, "q long, g long, score double")
    ids = groups.select("g", "h").join(least, "h").select("g", F.explode("ids").alias("vec_id"))
    hits = exact.join(ids, "g").join(asked.select("query_id", F.col("g").alias("q")), "q").where("query_id <> vec_id")
    ranked_hits = hits.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked_hits.where(f"rank <= {k}").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: What a partition gives: the number of an ordering's rows in it (no g), what its queries found (q) and the rows near its ends (code).
FOUND = "part int, curve int, place long, g long, code binary, full binary, q long, score double"
TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.float64()]


def row(part: int, curve: int, **columns) -> pa.RecordBatch:
    """Rows of FOUND, null where no column is given."""
    size = len(next(iter(columns.values())))
    columns |= {"part": np.full(size, part), "curve": np.full(size, curve)}
    names = [f.split()[0] for f in FOUND.split(", ")]
    arrays = [(c if isinstance(c, pa.Array) else pa.array(c, t)) if (c := columns.get(f)) is not None else pa.nulls(size, t) for f, t in zip(names, TYPES, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _window(points: DataFrame, curve: Broadcast, d: int, k: int, reach: float, total: int) -> tuple[int, int]:
    """How many orderings to use, and the ranks to either side that reach the wanted share of a bounded sample's true neighbours on them."""
    spark = points.sparkSession
    probes = points.where("ask").orderBy(F.xxhash64("g"), "g").limit(PROBES).select("g", "v").collect()
    ids, x = np.array([r.g for r in probes], dtype=np.int64), unit(matrix(pa.array([bytes(r.v) for r in probes]), d))

    def brute(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for i in range(0, b.num_rows, 4096):
                s = b.slice(i, 4096)
                g = s.column(0).to_numpy()
                score = x @ unit(matrix(s.column(1), d)).T
                score[ids[:, None] == g[None, :]] = -np.inf
                top = best(score, k)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, top.shape[1])), pa.array(g[top].ravel()), pa.array(np.take_along_axis(score, top, 1).ravel())], names=["q", "g", "score"])

    near = points.select("g", "v").mapInArrow(brute, "q long, g long, score double").where("score > double('-inf')")
    near = near.withColumn("nth", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "g"))).where(f"nth <= {k}").select("q", "g").collect()
    if not near:
        return 1, 0
    wanted = sorted({r.q for r in near} | {r.g for r in near})  # PROBES * (k + 1) at most
    small = spark.createDataFrame([(g,) for g in wanted], "g long")
    them = points.join(F.broadcast(small), "g").select("g", "v").collect()
    seat, y = np.array([r.g for r in them], dtype=np.int64), unit(matrix(pa.array([bytes(r.v) for r in them]), d))
    count = len(curve.value.rotations)
    keys = [curve.value.keys(y, c) for c in range(count)]

    def before(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows before each of the wanted ones on each ordering."""
        seen = np.zeros((count, len(seat)), dtype=np.int64)
        for b in rows:
            for i in range(0, b.num_rows, 4096):
                s = b.slice(i, 4096)
                g, z = s.column(0).to_numpy(), unit(matrix(s.column(1), d))
                for c in range(count):
                    order = np.lexsort((np.r_[np.zeros(len(seat), int), np.ones(len(g), int)], np.r_[seat, g], np.r_[keys[c], curve.value.keys(z, c)]))
                    mine = np.flatnonzero(order < len(seat))
                    seen[c, order[mine]] += np.cumsum(order >= len(seat))[mine]
        for c in range(count):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seat), c, np.int32)), pa.array(np.arange(len(seat), dtype=np.int32)), pa.array(seen[c])], names=["curve", "seat", "n"])

    at = np.zeros((len(seat), count), dtype=np.int64)
    for r in points.select("g", "v").mapInArrow(before, "curve int, seat int, n long").groupBy("curve", "seat").agg(F.sum("n").alias("n")).collect():
        at[r.seat, r.curve] = r.n
    of = {int(g): i for i, g in enumerate(seat)}
    gap = np.abs(at[[of[r.q] for r in near]] - at[[of[r.g] for r in near]])
    least = np.sort(np.minimum.accumulate(gap, axis=1), axis=0)  # over the first 1, 2, ... orderings
    window = least[min(len(gap) - 1, int(np.ceil(reach * len(gap))) - 1)]
    rows = (2 * window + 1) * np.arange(1, gap.shape[1] + 1)
    used = int(rows.argmin())
    return (used + 1, int(window[used])) if rows[used] < total else (1, total)
