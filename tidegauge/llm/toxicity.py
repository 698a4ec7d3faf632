"""Toxicity scores from a counterfactually regularised linear classifier.

A text's features are which words, and which first four and five bytes of
words, it has, hashed to a fixed number of weights; only features that mark
either label significantly get one. Near copies teach once. The loss is logistic, plus
an L2 term, plus a penalty for scores that change when identity terms in a
labelled text are swapped for others of their kind: so the weights of such
terms, and whatever stands for them, stay near each other, and neutral mentions
of groups aren't held against a text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom_lm import fold_of
from .common import ids_of, pieces, prepare, text_arrays, texts
from .seqhash import BYTE_SYMBOLS, LOWER, NOT_LETTERS, U, grams, mix, spans, words
from .sequence_dedup import null_id

#: Weights, and the largest numbers of labelled rows, and of features in all of them, that the classifier is fitted on.
FEATURES, TRAIN_ROWS, TRAIN_FEATURES = 1 << 19, 12_000, 1 << 24
#: First bytes of words that are features besides whole words.
PREFIXES = (4, 5)
STEPS, RATE, L2, COUNTERFACTUAL = 150, 0.1, 1e-3, 1.0
#: A feature counts if its share of toxic texts is so many standard errors from the mean, in so many texts at least.
SIGNIFICANT, LEAST = 5.0, 4

# Identity terms by kind; a term is swapped for the next of its kind.
IDENTITY = (
    ("women", "men", "girls", "boys", "mujeres", "hombres", "frauen", "männer", "femmes", "hommes"),
    ("woman", "man", "girl", "boy", "mujer", "hombre", "frau", "mann", "femme", "homme"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "heterosexual", "bisexual", "transgender"),
    ("immigrant", "citizen", "foreigner", "native", "refugee"),
    ("immigrants", "citizens", "foreigners", "natives", "refugees"),
    ("disabled", "deaf", "blind", "autistic"),
    ("old", "young", "elderly"),
)
_SWAP = {term: kind[(i + 1) % len(kind)] for kind in IDENTITY for i, term in enumerate(kind)}
_TERM = re.compile(r"\b(" + "|".join(sorted(_SWAP, key=len, reverse=True)) + r")\b", re.IGNORECASE)


def swapped(text: str) -> str:
    """The text with each identity term replaced by the next of its kind."""
    return _TERM.sub(lambda m: _SWAP[m[0].lower()], text)


def features(buf: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature number) of each feature that a text has, once."""
    h, s, e, n = words(buf, lengths, lower=True, between=NOT_LETTERS)
    sym = BYTE_SYMBOLS[LOWER[buf]] if len(buf) else np.empty(0, dtype=U)
    owner = np.repeat(np.arange(len(n)), n)
    found, of = [h], [owner]
    for p in PREFIXES:
        long = e - s > p
        found.append(mix(spans(sym, s[long], s[long] + p) + U(p)))
        of.append(owner[long])
    key = np.unique(np.concatenate(of).astype(U) << U(32) | np.concatenate(found) % U(FEATURES))
    return (key >> U(32)).astype(np.int64), (key & U(0xFFFFFFFF)).astype(np.int64)


class Classifier:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def __reduce__(self):
        at = np.flatnonzero(self.weights)
        return _of_few, (at, self.weights[at], self.bias)

    def scores(self, buf: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        owner, f = features(buf, lengths)
        z = self.bias + np.bincount(owner, weights=self.weights[f], minlength=len(lengths))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _of_few(at: np.ndarray, values: np.ndarray, bias: float) -> Classifier:
    weights = np.zeros(FEATURES)
    weights[at] = values
    return Classifier(weights, bias)


def shingle_minima(raw: bytes) -> np.ndarray:
    """Three minima over five-word shingles: texts that share one are likely near copies."""
    h, _, _, _ = words(np.frombuffer(raw, dtype=np.uint8), np.array([len(raw)]), lower=True)
    g = mix(grams(h, 5)) if len(h) >= 5 else np.array([h.sum(dtype=U)])
    return np.array([mix(g + U(k)).min() for k in range(3)], dtype=U)


def lesson(text: str) -> tuple[bytes, bytes, bytes | None]:
    """What a labelled text teaches: its shingle minima, its features, and those of the swapped text if it names identities."""

    def of(raw: bytes) -> bytes:
        return features(np.frombuffer(raw, dtype=np.uint8), np.array([len(raw)]))[1].astype(np.int32).tobytes()

    raw = text.encode()
    return shingle_minima(raw).tobytes(), of(raw), of(swapped(text).encode()) if _TERM.search(text) else None


def _listed(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row number, feature number) of lists of features."""
    return np.repeat(np.arange(len(lists), dtype=np.int32), [len(x) for x in lists]), np.concatenate([np.empty(0, np.int32), *lists])


def _without_copies(rows: list[tuple[bytes, bytes, bytes | None, int]], most_features: int) -> list[tuple[bytes, bytes, bytes | None, int]]:
    """One of those that share any of the three minima, so that no group of copies makes its words look significant; up to a number of features."""
    seen, out, size = [set(), set(), set()], [], 0
    for row in rows:
        least = np.frombuffer(row[0], dtype=U).tolist()
        if not any(x in s for x, s in zip(least, seen, strict=True)):
            size += len(row[1]) // 4
            if size > most_features and out:
                break
            out.append(row)
            for x, s in zip(least, seen, strict=True):
                s.add(x)
    return out


def fit(rows: list[tuple[str, int]], steps: int = STEPS, counterfactual: float = COUNTERFACTUAL) -> Classifier:
    """A classifier of (text, label) rows that are at hand; train() fits one to tables."""
    return _fit([(*lesson(text), label) for text, label in rows], steps, counterfactual)


def _fit(rows: list[tuple[bytes, bytes, bytes | None, int]], steps: int = STEPS, counterfactual: float = COUNTERFACTUAL, most_features: int = TRAIN_FEATURES) -> Classifier:
    """Full-batch Adam, so the same rows give the same weights; without both labels, a constant score."""
    rows = _without_copies(rows, most_features)
    y = np.array([label for *_, label in rows], dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return Classifier(np.zeros(FEATURES), 0.0 if not len(y) else (4.0 if y[0] else -4.0))
    mean = y.mean()
    owner, f = _listed([np.frombuffer(x, dtype=np.int32) for _, x, _, _ in rows])
    n, toxic = np.bincount(f, minlength=FEATURES), np.bincount(f, weights=y[owner], minlength=FEATURES)
    chosen = np.flatnonzero((n >= LEAST) & (np.abs(toxic - n * mean) >= SIGNIFICANT * np.sqrt(n * mean * (1 - mean))))
    number = np.full(FEATURES, -1)
    number[chosen] = np.arange(len(chosen))

    def select(owner, f):
        keep = number[f] >= 0
        return owner[keep], number[f[keep]]

    owner, f = select(owner, f)
    paired = [(np.frombuffer(x, dtype=np.int32), np.frombuffer(z, dtype=np.int32)) for _, x, z, _ in rows if z is not None] if counterfactual else []
    pairs = [select(*_listed(list(side))) for side in zip(*paired, strict=True)] if paired else []
    size = len(chosen)
    balance = np.where(y > 0, 0.5 / mean, 1.0) / len(y)
    w, b = np.zeros(size), float(np.log(mean / (1 - mean)))
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for step in range(1, steps + 1):
        z = b + np.bincount(owner, weights=w[f], minlength=len(y))
        miss = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) * balance
        g = np.bincount(f, weights=miss[owner], minlength=size) + L2 * w
        if pairs:
            before, after = (np.bincount(o, weights=w[i], minlength=len(paired)) for o, i in pairs)
            pull = 2 * counterfactual * (before - after) / len(paired)
            for (o, i), sign in zip(pairs, (1, -1), strict=True):
                g += np.bincount(i, weights=sign * pull[o], minlength=size)
        gb = miss.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        b -= RATE * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(FEATURES)
    weights[chosen] = w
    return Classifier(weights, float(b))


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held_fold: int = 0, most: int = TRAIN_ROWS, most_features: int = TRAIN_FEATURES) -> Classifier:
    """Fits on labelled documents outside the held-out fold, in the order of a hash of doc_id.

    At most ``most`` of them, and as many as have ``most_features`` features in
    all, teach. Executors turn texts into features, and one task fits them; the
    driver sees the weights only. Labels that are null or contradict each
    other, and null ids, teach nothing; of rows with one id, the least text does.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != held_fold).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other")
    known = known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", "toxic")  # a bounded number of pairs of integers
    rows = texts(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic")

    def teach(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for i in range(0, b.num_rows, 64):
                s = b.slice(i, 64)
                least, own, other = zip(*map(lesson, s.column(1).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([s.column(0), s.column(2), *(pa.array(x, pa.binary()) for x in (least, own, other))], names=["doc_id", "toxic", "least", "own", "other"])

    def learn(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [row for b in rows for row in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 1)), strict=True)]
        model = _fit(held, most_features=most_features)
        at = np.flatnonzero(model.weights)
        yield pa.RecordBatch.from_arrays([pa.array([model.bias]), pa.array([at.astype(np.int32).tobytes()], pa.binary()), pa.array([model.weights[at].tobytes()], pa.binary())], names=["bias", "feature", "weight"])

    lessons = rows.mapInArrow(teach, "doc_id long, toxic int, least binary, own binary, other binary")
    # one task for a number of rows that doesn't grow with the table
    learnt = lessons.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").mapInArrow(learn, "bias double, feature binary, weight binary").collect()
    weights = np.zeros(FEATURES)
    for r in learnt:
        weights[np.frombuffer(r.feature, dtype=np.int32)] = np.frombuffer(r.weight)
    return Classifier(weights, learnt[0].bias if learnt else 0.0)


def score(docs: DataFrame, labels: DataFrame, folds: int = 5, held_fold: int = 0, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted (and ``text`` with ``carry`` columns).

    A null text is empty and gets the score of no features. Without labels of
    both kinds the score is a constant. A null doc_id counts as an empty text
    for its fold. An empty table gives none.
    """
    spark = docs.sparkSession
    prepare(spark)
    model = spark.sparkContext.broadcast(train(docs, labels, folds, held_fold))
    d = texts(docs, *carry)

    def rate(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            doc = ids_of(b.column(0))
            buf, off = text_arrays(b.column(1))
            s = np.concatenate([np.empty(0), *(model.value.scores(buf[off[i] : off[j]], np.diff(off[i : j + 1])) for i, j in pieces(off))])
            out = [null_id(doc), pa.array(fold_of(doc, folds) == held_fold), pa.array(s), pa.array((s >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(out + list(b.columns[1:]) * bool(carry), names=["doc_id", "held_out", "score", "predicted"] + b.schema.names[1:] * bool(carry))

    schema = "doc_id long, held_out boolean, score double, predicted int" + (", text string" + "".join(f", `{c}` {d.schema[c].dataType.simpleString()}" for c in carry) if carry else "")
    return d.mapInArrow(rate, schema)
