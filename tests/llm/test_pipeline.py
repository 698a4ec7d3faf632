"""The pipeline's stages against plain versions, each on its own input, and the guard around it."""

import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tidegauge.llm import toxicity
from tidegauge.llm.common import materialize

from . import brute

DATA = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of each stage."""
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, f in P.STAGES:
        new = materialize(f(spark, docs, DATA), "stage")
        out.append((name, docs, new))
        docs = new
    return out


def rows(df):
    return sorted((tuple(r) for r in df.select(*P.COLUMNS).collect()), key=str)


def test_columns(stages):
    assert all(new.columns == P.COLUMNS for _, _, new in stages[:-1])
    assert [s.split()[0] for s, _ in P.STAGES] == ["toxicity", "near", "repeated", "source", "packing"]


def test_toxic_documents_go(spark, stages):
    _, docs, new = stages[0]
    bad = {r.doc_id for r in toxicity.score(docs, spark.read.parquet(f"{DATA}/labels.parquet")).where("predicted = 1").collect()}
    assert rows(new) == [r for r in rows(docs) if r[0] not in bad]


def test_one_of_each_class_stays(stages):
    _, docs, new = stages[1]
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    keep = {d for d, _, c in brute.jaccard(pairs) if d == c}
    assert rows(new) == [r for r in rows(docs) if r[0] in keep]


def test_repeats_are_cut(stages):
    _, docs, new = stages[2]
    given = [tuple(r) for r in docs.select(*P.COLUMNS).collect()]
    want = []
    for r, (s, gone) in zip(given, brute.covered([(r[0], r[1]) for r in given], brute.raw, 50), strict=True):
        text = bytes(c for c, g in zip(s, gone, strict=True) if not g).decode("utf-8", "ignore")
        if not s or not all(gone):
            want.append((r[0], text, r[2], r[3], len(text)))
    assert rows(new) == sorted(want, key=str)


def test_mix_follows_targets(stages):
    _, docs, new = stages[3]
    words = F.size(F.expr("filter(split(text, '[ \\t-\\r]+'), x -> x <> '')"))
    before = {r.source: r.n for r in docs.groupBy("source").agg(F.sum(words).alias("n")).collect()}
    after = {r.source: r.n for r in new.groupBy("source").agg(F.sum(words).alias("n")).collect()}
    want = brute.targets(before)
    assert abs(sum(after.values()) - 1.5 * sum(before.values())) < 0.1 * sum(before.values())
    assert new.groupBy("doc_id").count().agg(F.max("count")).collect()[0][0] <= 2
    # a document is rounded to whole copies by its own draw: an error of half its words, at one standard deviation
    spread = {r.source: r.v**0.5 / 2 for r in docs.groupBy("source").agg(F.sum(words * words).alias("v")).collect()}
    assert all(abs(after.get(s, 0) - want[s]) <= 4 * spread[s] + 32 for s in before)


def test_packed_pieces_cover_all(stages):
    _, docs, new = stages[4]
    tokens = sum(len(brute.ids(r.text, 1)) for r in docs.collect())
    assert new.agg(F.sum("length")).collect()[0][0] == tokens
    assert new.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).collect()[0][0] <= 2048


@pytest.mark.parametrize("n", range(len(P.STAGES)))
def test_stages_take_odd_rows(spark, docs, rows, n):
    """Nulls, empty and long texts, repeated rows, rows without an id and clashing columns: all but the last stage give documents."""
    name, stage = P.STAGES[n]
    out = stage(spark, docs, DATA)
    if name == "packing":
        assert out.agg(F.sum("length")).collect()[0][0] == sum(len(brute.ids(t, 1)) for _, t, _ in rows)
        return
    assert out.columns == P.COLUMNS and [f.dataType for f in out.schema][:2] == [docs.schema["doc_id"].dataType, docs.schema["text"].dataType]
    got = {(r.doc_id, r.text or "") for r in out.collect()}
    before = {(d, t or "") for d, t, _ in rows}
    if name == "near duplicates":
        first = {(d, c) for d, _, c in brute.jaccard([(d, t) for d, t, _ in rows])}
        gone = {d for d, c in first if d is not None and c != d}
        assert got == {(d, t) for d, t in before if d not in gone}
    elif name == "repeated passages":
        assert {d for d, _ in got} <= {d for d, _ in before} and (1, "") in got and (2, "") in got
    else:
        assert got <= before
    if name == "toxicity":
        assert {(1, ""), (2, ""), (4, "one two")} <= got


@pytest.mark.parametrize("n", range(len(P.STAGES)))
def test_stages_take_empty_tables(spark, docs, n):
    assert P.STAGES[n][1](spark, docs.limit(0), DATA).count() == 0


def test_run(spark, stages):
    assert P.run(spark, DATA).drop("sequence_id", "offset").exceptAll(stages[4][2].drop("sequence_id", "offset")).count() == 0


def test_the_rest_works_without_this_part(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'sql_group_mean' in q and not any(n.startswith('op1') or n == 'pipeline' for n in q); e.oracle_sql(); print('fine')"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert out.stdout.strip().endswith("fine"), out.stderr
