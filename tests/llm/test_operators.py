"""Each operator against a plain version, on a table of awkward rows."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidegauge.llm import bloom_lm, curve_search, exact_search, jaccard_join, packing, phrase_dedup, seqhash, sequence_dedup, source_mixing, suffix_dedup, token_files, toxicity, voronoi

from . import brute


def key(r):
    return tuple((x is None, 0 if x is None else x) for x in r)


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=key)


def pairs(rows):
    return [(d, t) for d, t, _ in rows]


def test_token_files(spark, docs, rows, nothing):
    folder = token_files.write(docs, brute.TOKENIZER, end_id=2)
    found = {}
    for r in token_files.read(spark, folder).collect():
        found.setdefault(r.doc_id, []).append(r)
    total = sum(len(brute.ids(t, 2)) for _, t, _ in rows)
    spans = sorted((r.start, r.n_tokens) for v in found.values() for r in v)
    assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and sum(spans[-1]) == total
    for d, t, _ in rows:
        want = brute.ids(t, 2)
        assert any(r.n_tokens == len(want) and r.ids_crc32 == zlib.crc32(want.tobytes()) for r in found[d])
    ordered = [d for d in sorted(found, key=brute.order)]
    assert [d for d in ordered] == sorted(ordered, key=lambda d: min(r.start for r in found[d]))
    assert token_files.read(spark, token_files.write(nothing, brute.TOKENIZER, end_id=2)).count() == 0


def test_encoder_equals_whole_texts():
    from tidegauge.llm.tokens import encoder

    rng = random.Random(1)
    odd = ["".join(rng.choice([" ", "  ", "\n", "\t", "a", "b", "é", "1", ".", "'s", " the", " ", "　", "中", "<|endoftext|>", "\x1c", "​", "😀"]) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    e = encoder(brute.TOKENIZER)
    assert all(list(a) == list(b) for a, b in zip(e.encode(odd), (x.ids for x in e.tokenizer.encode_batch(odd, add_special_tokens=False)), strict=True))


def test_packing(docs, rows, nothing):
    pieces = packing.pack(docs, brute.TOKENIZER, end_id=1, capacity=256).collect()
    texts = {}
    for d, t, _ in rows:
        texts.setdefault(d, []).append(brute.ids(t, 1))
    assert all(any(len(t) == p.doc_tokens and zlib.crc32(t[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for t in texts[p.doc_id]) for p in pieces)
    assert sum(p.length for p in pieces) == sum(len(t) for v in texts.values() for t in v)
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == list(np.cumsum([0] + [n for _, n in s])[:-1]) and sum(n for _, n in s) <= 256
    least = -(-sum(p.length for p in pieces) // 256)
    assert len(sequences) <= least + 1 + 0.02 * least
    assert packing.pack(nothing, brute.TOKENIZER, end_id=1).count() == 0


def test_packing_leaves_no_chunks_in_workers(spark, docs):
    def known(batches):
        from tidegauge.llm import tokens

        for _ in batches:
            pass
        yield pa.RecordBatch.from_pydict({"n": [sum(len(e.number) for e in tokens._encoders.values())]})

    assert packing.pack(docs.repartition(8), brute.TOKENIZER, end_id=1).count() > 0
    assert [r.n for r in spark.range(0, 8, 1, 8).mapInArrow(known, "n long").collect()] == [0] * 8


def test_short_documents_are_packed_by_number_too(spark):
    few = spark.range(30_000).selectExpr("id AS doc_id", "'' AS text").coalesce(1)
    pieces = packing.pack(few, brute.TOKENIZER, end_id=1, capacity=256, window_tokens=1 << 16).collect()
    assert sorted(p.doc_id for p in pieces) == list(range(30_000)) and len({p.sequence_id for p in pieces}) == -(-30_000 // 256)
    assert len({p.sequence_id >> 26 for p in pieces if p.sequence_id < 1 << 62}) > 1


def test_closest_fill_is_closest():
    rng = random.Random(5)
    for _ in range(200):
        counts = {rng.randint(1, 40): rng.randint(1, 3) for _ in range(rng.randint(0, 5))}
        capacity = rng.randint(0, 90)
        plan = packing.closest_fill(counts, capacity)
        assert all(0 < n <= counts[length] for length, n in plan)
        sums = {0}
        for length, n in counts.items():
            sums = {s + length * k for s in sums for k in range(n + 1)}
        assert sum(length * n for length, n in plan) == max(s for s in sums if s <= capacity)


def test_jaccard_join(docs, rows, nothing):
    assert got(jaccard_join.join(docs), "doc_id", "n_shingles", "component_id") == sorted(brute.jaccard(pairs(rows)), key=key)
    assert jaccard_join.join(nothing).count() == 0


@pytest.mark.parametrize("limits", [(3, 2), (6, 5)])
def test_regions_beyond_the_limits(spark, docs, rows, limits):
    """Regions and clusters dealt to several tasks give the same classes."""
    assert got(jaccard_join.join(docs, limits), "doc_id", "n_shingles", "component_id") == sorted(brute.jaccard(pairs(rows)), key=key)


def test_jaccard_join_at_the_threshold(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[a : a + 40]) for a in range(0, 60)] + [" ".join(words[a : a + 100] + [f"x{a}"]) for a in range(0, 30, 2)]
    rows = list(enumerate(texts))
    assert got(jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "n_shingles", "component_id") == sorted(brute.jaccard(rows), key=key)


def turning(n, x, y):
    """A Thue-Morse word: with its counterpart, what polynomials modulo 2**64 can't tell apart from some length on."""
    return "".join(y if i.bit_count() % 2 else x for i in range(n))


def test_jaccard_join_tells_long_words_apart(spark):
    """different words of up to 512 bytes had one hash."""
    words = [turning(n, x, y) for n in (128, 256, 512, 1024) for x, y in ("u'", "'u", "ab", "ba")]
    rows = list(enumerate(words + [f"{w} b c d e" for w in words] + [" ".join([w, "b c d e f", v, "b c d e f"]) for w, v in zip(words, words[1:], strict=False)]))
    assert got(jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "n_shingles", "component_id") == sorted(brute.jaccard(rows), key=key)


def test_jaccard_join_keeps_the_last_id(spark):
    """the largest id was taken for none: it came back null, and its text was not found for the links."""
    a, b = ([f"{c}{i}" for i in range(100)] for c in "ab")
    texts = {brute.LAST: a, brute.LAST - 1: [*a, "x"], -brute.LAST - 1: b}
    rows = [(d, " ".join(w)) for d, w in texts.items()] + [(None, " ".join([*b, "x"])), (None, " ".join(a)), (None, "alone"), (None, None)]
    want = [(d, len(brute.shingles(t)), c) for (d, t), c in zip(rows, [brute.LAST - 1, brute.LAST - 1, -brute.LAST - 1, -brute.LAST - 1, brute.LAST - 1, None, None], strict=True)]
    assert got(jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "n_shingles", "component_id") == sorted(want, key=key)
    only = spark.createDataFrame([(brute.LAST, "one two"), (brute.LAST, "")], "doc_id long, text string")
    assert got(jaccard_join.join(only), "doc_id", "n_shingles", "component_id") == [(brute.LAST, 0, brute.LAST), (brute.LAST, 1, brute.LAST)]


def test_short_words_have_hashes_of_their_own():
    rng = random.Random(8)
    kinds = {bytes(rng.choice(b"ab\0\xff") for _ in range(rng.randint(1, 12))) for _ in range(3000)}
    words = sorted(kinds, key=lambda w: rng.random())
    text = np.frombuffer(b" ".join(words + words), dtype=np.uint8)
    h, s, e, n = seqhash.words(text, np.array([len(text)]), exact=True)
    assert n.tolist() == [2 * len(words)] and [text[i:j].tobytes() for i, j in zip(s, e, strict=True)] == words + words
    assert len(np.unique(h)) == len(words) and (h[: len(words)] == h[len(words) :]).all()


def test_large_regions_recurse():
    """Cells, windows and pairs of a region find what comparing all pairs finds."""
    rng = np.random.default_rng(2)
    centres = [np.unique(rng.integers(0, 2**63, 300).astype(np.uint64)) for _ in range(60)]
    sets = []
    for c in centres:
        for _ in range(40):
            keep = rng.random(len(c)) > 0.04
            sets.append(np.unique(np.concatenate([c[keep], rng.integers(0, 2**63, 5).astype(np.uint64)])))
    n = np.array([len(s) for s in sets])
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in jaccard_join.allowed([jaccard_join.sketch_of(s) for s in sets], n):
        root[find(a)] = find(b)
    assert [find(i) == find(i - 1) for i in range(1, len(sets))] == [i % 40 > 0 for i in range(1, len(sets))]


def classes(m, links):
    root = list(range(m))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    least = {}
    return [least.setdefault(find(i), i) for i in range(m)]


def chained_sets(rng, groups, each):
    """Groups whose members differ step by step, so that the ends of a group aren't linked, and some unrelated sets."""
    sets = []
    for _ in range(groups):
        now = rng.integers(0, 2**63, int(rng.integers(3, 90))).astype(np.uint64)
        for _ in range(each):
            now = now.copy()
            now[rng.random(len(now)) < 0.07] = rng.integers(0, 2**63, 1).astype(np.uint64)[0]
            sets.append(np.unique(now))
    return sets


def brute_links(sets, percent=80):
    for a in range(len(sets)):
        for b in range(a):
            common = len(np.intersect1d(sets[a], sets[b]))
            if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                yield a, b


def test_voronoi_cells_in_a_task():
    """Cells, windows and guests give the classes that all pairs give."""
    rng = np.random.default_rng(14)
    for _ in range(8):
        sets = chained_sets(rng, 6, int(rng.integers(2, 30)))
        want = list(brute_links(sets))
        for pivots in (1, 2, 8):
            found = voronoi.join(sets, 80, None, pivots)
            assert set(map(tuple, map(sorted, found))) <= set(map(tuple, map(sorted, want)))
            assert classes(len(sets), found) == classes(len(sets), want)


def test_voronoi_regions_in_spark(spark, monkeypatch):
    """Regions of large cells, with their replicated guests, are the cells of further levels, and give the classes that all pairs give."""
    rng = np.random.default_rng(15)
    sets = chained_sets(rng, 5, 40) + chained_sets(rng, 60, 1)
    rows = [(i % 2, 2 * i + i % 2, s.tobytes()) for i, s in enumerate(sets)]
    levels = []
    kept = voronoi.materialize

    def watched(df, name, free=True):
        out = kept(df, name, free)
        if name.startswith("cells"):
            levels.append([out.where(f"{'' if own else 'not '}own").count() for own in (True, False)] + [out.select("cell").distinct().count()])
        return out

    monkeypatch.setattr(voronoi, "materialize", watched)
    found = [(r.a, r.b) for r in voronoi.edges(spark.createDataFrame(rows, "region long, node long, members binary"), 80, 16, 4, 4).collect()]
    number = {r[1]: i for i, r in enumerate(rows)}
    assert len(levels) >= 2 and levels[0][1] > 0 and levels[0][2] > 2  # recursion, guests, cells
    for region in (0, 1):
        mine = [i for i in range(len(sets)) if i % 2 == region]
        want = classes(len(mine), brute_links([sets[i] for i in mine]))
        assert classes(len(mine), [(mine.index(number[a]), mine.index(number[b])) for a, b in found if a % 2 == region]) == want


def bridged_sets():
    """Two groups of near copies, of which only one member each is linked to the other group."""
    return [np.arange(a, a + 400).astype(np.uint64) for a in [*range(0, 31), 44, 88, *range(102, 133)]]


def test_voronoi_finds_a_link_of_members_that_are_settled_apart():
    """each end of the only link between two groups is connected to a pivot of its own group, at different levels."""
    rng = np.random.default_rng(16)
    for _ in range(20):
        sets = [bridged_sets()[i] for i in rng.permutation(64)]
        for pivots in (1, 2, 4):
            assert len(set(classes(64, voronoi.join(sets, 80, None, pivots)))) == 1


def test_voronoi_regions_find_a_link_of_members_that_are_settled_apart(spark):
    """the same in regions that are dealt out in Spark."""
    rows = [(region, 100 * region + i, s.tobytes()) for region in range(6) for i, s in enumerate(bridged_sets())]
    found = voronoi.edges(spark.createDataFrame(rows, "region long, node long, members binary"), 80, 8, 4, 4).collect()
    for region in range(6):
        assert len(set(classes(64, [(r.a % 100, r.b % 100) for r in found if r.a // 100 == region]))) == 1


def test_suffix_dedup(docs, rows, nothing):
    columns = "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"
    want = sorted(brute.suffix_dedup(pairs(rows)), key=key)
    assert got(suffix_dedup.dedup(docs, batch=64), *columns) == want
    assert got(suffix_dedup.dedup(docs, batch=64, family_bytes=5000), *columns) == want  # shards in classes of windows
    assert suffix_dedup.dedup(nothing).count() == 0


def test_classes_of_a_shard_hash_each_window_once(monkeypatch):
    """a shard's time is in proportion to its windows, however many classes they are gone through in; the marks are the same."""
    rng = np.random.default_rng(6)
    raw = rng.integers(97, 123, (2000, 80)).astype(np.uint8)
    raw[:1000, 40:], raw[1000:, :60] = raw[0, 40:], raw[rng.integers(0, 1000, 1000), :60]
    doc = np.arange(2000)
    (_, payload) = sequence_dedup.blob(0, raw.ravel(), np.full(2000, 80, np.uint16), doc.astype(np.uint64), doc, np.zeros(2000, np.int32), np.zeros(2000, np.uint32))
    batch = pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([payload], pa.binary())], names=["shard", "payload"])
    hashed, kept = [], suffix_dedup.mix
    monkeypatch.setattr(suffix_dedup, "mix", lambda h: hashed.append(len(h)) or kept(h))
    monkeypatch.setattr(suffix_dedup, "HELD", 9000, raising=False)

    def marks(family_bytes):
        hashed.clear()
        out = [p for b in suffix_dedup.judge(50, 1, 500, family_bytes)(iter([batch])) for p in b.column(1).to_pylist()]
        return sorted(zip(*(x.tolist() for x in sequence_dedup.gathered(out, np.uint64, np.uint32, np.uint32)), strict=True))

    want = marks(1 << 30)
    assert want and marks(62_000) == want  # fifty classes
    assert sum(hashed) <= 2000 * 31


def test_anchors_are_the_same_in_blocks(monkeypatch):
    rng = np.random.default_rng(5)
    lengths = np.array([400, 0, 49, 50, 3000, 700])
    sym = suffix_dedup.bytes_as_symbols(np.r_[rng.integers(0, 4, lengths.sum() - 600), np.zeros(600)].astype(np.uint8), lengths)[0]
    for k, window in ((20, 50), (12, 50), (5, 5)):
        whole = [x.tolist() for x in seqhash.minimizers(sym, lengths, k, window)]
        for most in (window + 1, 64, 257, len(sym), len(sym) + window):
            with monkeypatch.context() as m:
                m.setattr(seqhash, "MAX_CHUNK", most)
                assert [x.tolist() for x in seqhash.minimizers(sym, lengths, k, window)] == whole


def test_suffix_family_levels():
    f = suffix_dedup.SuffixFamily()
    rng = random.Random(4)
    seen = set()
    for d in range(40):
        batch = [bytes(rng.choice(b"ab") for _ in range(4)) for _ in range(rng.randint(1, 6))]
        hit = f.add(np.array(batch, dtype="S4"), np.full(len(batch), d))
        assert hit.tolist() == [b in seen for b in batch]
        seen.update(batch)
        sizes = [len(x) for x in f.levels]
        assert all(2 * b <= a for a, b in zip(sizes, sizes[1:], strict=False))


def test_phrase_dedup(docs, rows, nothing):
    assert got(phrase_dedup.dedup(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.phrase_dedup(pairs(rows)), key=key)
    assert phrase_dedup.dedup(nothing).count() == 0


def test_the_automaton_locates_phrases():
    """Phrases go in without documents or positions; windows come out where the automaton finds them, and only there."""
    anchors = sequence_dedup.Anchors(phrase_dedup.words_as_symbols, 12, 50)
    rng = random.Random(13)
    shared = [f"p{i}" for i in range(70)]
    texts = [" ".join([f"w{rng.randrange(10**6)}" for _ in range(rng.randint(0, 90))] + shared * (i % 3 > 0) + [f"w{rng.randrange(10**6)}" for _ in range(60)]).encode() for i in range(12)] + [b"", b"one two"]
    buf, lengths = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
    sym, n, d, pos, _, first, last = anchors.of(buf, lengths)
    begin = np.cumsum(n) - n
    letters = phrase_dedup.phrases_at(sym, begin[d] + pos, 12)
    keys = phrase_dedup.phrase_keys(letters)
    kinds, often = np.unique(keys, return_counts=True)
    common = np.isin(keys, kinds[often > 1])
    assert {int(x) for x in d[common]} == {i for i in range(12) if i % 3 > 0}

    def windows(payloads):
        bucket = phrase_dedup.Passages(0, anchors, 4)
        bucket.take(payloads)
        rows = pa.array(range(14), pa.int64()), pa.array(range(14), pa.int64()), pa.array([t.decode() for t in texts])
        out = pa.Table.from_batches([*bucket.docs(*rows), *bucket.end()], schema=sequence_dedup.BLOB_SCHEMA)
        return sum(len(sequence_dedup.opened(p, *phrase_dedup.WINDOWS)[0]) for s, p in zip(out["shard"].to_pylist(), out["payload"].to_pylist(), strict=True) if s >= 0), out.num_rows

    phrases = np.unique(letters[common], axis=0)
    all_found = windows([sequence_dedup.blob(0, phrases.ravel())[1]] * 2)
    some = windows([sequence_dedup.blob(0, phrases[: len(phrases) // 2].ravel())[1]])
    assert all_found[0] > some[0] > 0 and windows([]) == (0, 0)
    assert windows([sequence_dedup.blob(0, np.full(24, 60, np.uint8))[1]]) == (0, 0)
    machine = phrase_dedup.automaton([sequence_dedup.blob(0, phrases.ravel())[1]], 12)
    assert (phrase_dedup.located(machine, sym, n, 12)[begin[d] + pos] == common).all()


def test_long_words_differ():
    """Words that a polynomial modulo 2**64 confuses are told apart."""
    a, b = b"a", b"b"
    for _ in range(11):
        a, b = a + b, b + a
    h, _, _, n = seqhash.words(np.frombuffer(a + b" " + b + b" " + a, np.uint8), np.array([2 * 2048 + 1, 2049]))
    assert len(h) == 3 and n.tolist() == [2, 1] and h[0] != h[1] and h[0] == h[2]


def test_source_mixing(docs, rows, nothing):
    out = source_mixing.mix(docs)
    again = got(out, "doc_id", "source", "size", "taken")
    assert again == got(source_mixing.mix(docs.repartition(5)), "doc_id", "source", "size", "taken")
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(brute.raw(t).split())
    want, taken = brute.targets(sizes), {}
    for r in out.collect():
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 2 * source_mixing.BLOCK for s in sizes)
    assert source_mixing.mix(nothing).count() == 0


def test_shards_have_integer_quotas(docs, rows):
    """Of several shards a source, the quotas add up to the source's, follow the highest quotients, and are what is taken."""
    out = source_mixing.mix(docs, shard_words=300).collect()
    by = {}
    for r in out:
        by.setdefault((r.source, r.quota), {}).setdefault((r.shard, r.shard_quota), []).append(r)
    assert any(len(shards) > 2 for shards in by.values())
    for (_, quota), shards in by.items():
        size = {s: sum(r.size for r in rs) for (s, _), rs in shards.items()}
        won = dict.fromkeys(size, 0)
        for _ in range(quota if any(size.values()) else 0):
            won[min(won, key=lambda s: (-size[s] / (2 * won[s] + 1), s))] += 1
        for (s, q), rs in shards.items():
            assert q == min(won[s], 2 * -(-size[s] // 16))
            assert abs(sum(r.taken for r in rs) - 16 * q) <= 32
            assert all(0 <= r.taken <= 2 * r.size for r in rs)


def test_sainte_lague_quotas(spark):
    """Quotas are those of the highest quotients, one by one."""
    rng = random.Random(6)
    for _ in range(3):
        size = {f"s{i}": rng.randint(100, 5000) for i in range(7)}
        df = spark.createDataFrame([(s, n, float(n) * rng.uniform(0.2, 1)) for s, n in size.items()], "source string, source_size long, target double")
        target = {r.source: r.target for r in df.collect()}
        quota = {r.source: r.quota for r in source_mixing.apportioned(df.withColumn("weight", df.target), 16, 2).collect()}
        total = round(sum(target.values()) / 16)
        won = dict.fromkeys(size, 0)
        for _ in range(total):
            won[max(won, key=lambda s: target[s] / (2 * won[s] + 1))] += 1
        assert quota == won


def test_language_model(docs, rows, nothing):
    out = bloom_lm.score(docs)
    found = sorted((tuple(r) for r in out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score").collect()), key=lambda r: key(r[:5]) + (r[5],))
    want = sorted(brute.unigram(pairs(rows)), key=lambda r: key(r[:5]) + (r[5],))
    assert [r[:5] for r in found] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in found], [r[5] for r in want], rtol=1e-12)
    scores = [r.score for r in out.collect()]
    assert all(s < 0 and np.isfinite(s) for s in scores)
    assert bloom_lm.score(nothing).count() == 0


def test_language_model_keeps_every_pair(docs, rows, monkeypatch):
    """Scores follow the counts of all n-grams, also where a fixed number of bits, if there is one, is far too small for them."""
    few = tuple(1 << 14 if x == 1 << 28 else x for x in bloom_lm.score.__defaults__)
    monkeypatch.setattr(bloom_lm.score, "__defaults__", few)
    found = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.score) for r in bloom_lm.score(docs).collect())
    want = sorted((d is None, d or 0, n, s) for d, n, s in brute.pair_scores(pairs(rows)))
    assert [r[:3] for r in found] == [r[:3] for r in want]
    off = [abs(a[3] - b[3]) / a[2] for a, b in zip(found, want, strict=True)]
    assert sum(off) / len(off) < 0.05 and max(off) < 0.25


def test_hashes_come_back_from_differences():
    for h in ([], [0], [7], [0, 1, 1 << 40, (1 << 64) - 1]):
        h = np.array(h, dtype=np.uint64)
        assert bloom_lm.thickened(bloom_lm.thinned(h)).tolist() == h.tolist()


def test_segments_follow_their_entries():
    sizes = []
    for n in (1000, 8000):
        h = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        f = bloom_lm.segment([(h, np.full(n, 4)), (h + np.uint64(1), np.ones(n, dtype=np.int64))])
        sizes.append(f.size)
        assert (f.levels(h, 1) >= 9).all() and (f.levels(h, 1) > 9).mean() < 0.03
        assert (f.levels(h + np.uint64(1), 1) >= 1).all() and (f.levels(h + np.uint64(2), 1) > 0).mean() < 0.03
    assert sizes[1] > 7.9 * sizes[0]


def test_filter_gives_levels_back():
    f = bloom_lm.Filter(1, 1 << 20)
    h = np.arange(1, 5001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    levels = 1 + np.arange(5000) % 7
    bits = np.zeros(f.size, dtype=np.uint8)
    f.build(h, 1, levels, bits)
    f.load([np.packbits(bits, bitorder="little").tobytes()])
    back = f.levels(h, 1)
    assert (back >= levels).all() and (back > levels).mean() < 0.02
    assert (f.levels(h + np.uint64(1), 1) > 0).mean() < 0.02


def test_level_bounds_keep_the_filter_small():
    counts = np.zeros((2, bloom_lm.TOP), dtype=np.int64)
    counts[0, 1:9], counts[1, 1:5] = 1000, 100_000
    low = bloom_lm.lowest_levels(counts, 9 * 50_000)
    assert low[1] > 1
    assert bloom_lm.lowest_levels(counts, 1 << 40) == (1, 1)


def test_toxicity(spark, nothing):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        words = [rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randrange(50)) for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(40)] = rng.choice(["vilewords", "nastything", "foulmouth"]) + rng.choice(["", "!", "er"])
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "foulmouth nastything"), (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5, None), (None, 1), (7, 0)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert len(out) == 403
    assert all(out[i].held_out == (brute.crc(i) % 5 == 0) for i, _, _ in rows)
    held = [(out[i].predicted, y) for i, _, y in rows if out[i].held_out]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    assert out[900].score == out[901].score < 0.5 < out[None].score
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())
    assert toxicity.score(nothing, labels).count() == 0
    assert {r.score for r in toxicity.score(docs, labels.where("toxic = 0")).collect()} == {toxicity.Classifier(np.zeros(toxicity.FEATURES), -4.0).scores(np.empty(0, np.uint8), np.array([0]))[0]}


def test_toxicity_of_odd_rows(spark, docs, rows):
    """Nulls, empty and long texts, repeated rows, rows without an id and clashing columns score as their text does by itself."""
    rng = random.Random(9)
    more = [(1000 + i, " ".join(f"word{rng.randrange(900)}" for _ in range(30)) + " vileword" * (i % 4 == 0)) for i in range(300)]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    rows = rows + [(d, t, None) for d, t in more]
    labels = spark.createDataFrame([(i, 0) for i in range(90)] + [(1000 + i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert np.any(model.weights)

    def plain(text):
        raw = (text or "").encode()
        _, f = toxicity.features(np.frombuffer(raw, dtype=np.uint8), np.array([len(raw)]))
        return 1 / (1 + math.exp(-(model.bias + sum(model.weights[i] for i in set(f.tolist())))))

    def order(r):
        return r[0] is None, r[0] or 0, r[2]

    found = sorted((tuple(r) for r in toxicity.score(docs, labels).select("doc_id", "held_out", "score", "predicted").collect()), key=order)
    want = sorted(((d, brute.crc(d) % 5 == 0, plain(t)) for d, t, _ in rows), key=order)
    assert [r[:2] for r in found] == [r[:2] for r in want]
    assert np.allclose([r[2] for r in found], [r[2] for r in want], rtol=1e-9)
    assert all(r[3] == (r[2] >= 0.5) for r in found)


def test_swapping_terms_changes_little():
    """A term that goes with the label by chance weighs less when swaps are penalised."""
    rng = random.Random(9)
    filler = "house tree river stone cloud bread field night".split()
    rows = []
    for i in range(600):
        words = [rng.choice(filler) + str(rng.randrange(60)) for _ in range(25)]
        if i % 3 == 0:
            words[3] = "horribleinsult" if i % 2 else words[3]
            words[5] = "muslim"
        elif i % 5 == 0:
            words[5] = "christian"
        rows.append((" ".join(words), int(i % 3 == 0)))

    def change(model):
        raw = [b"a muslim neighbour", b"a christian neighbour"]
        s = model.scores(np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw]))
        return abs(s[0] - s[1])

    assert toxicity.swapped("Muslim women") == "christian men"
    assert change(toxicity.fit(rows)) < 0.5 * change(toxicity.fit(rows, counterfactual=0.0))


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(10)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(400)]
    rows += [(i, rows[7][1]) for i in range(400, 460)] + [(460, [2 * x for x in rows[7][1]]), (500, rows[7][1])]
    odd = [(600, None), (601, []), (602, [1.0] * 5), (603, [float("nan")] * 8), (604, [None] + [1.0] * 7), (605, [float("inf")] * 8), (None, [1.0] * 8), (606, [0.0] * 8), (607, [1e300] * 8), (608, [1e-300] * 8)]
    return rows, odd


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 0.5, 2) for i, v in rows], "vec_id long, embedding array<double>, rank int, score double, g int").repartition(3)


def test_curve_search(spark, vectors):
    rows, odd = vectors
    every = brute.valid(rows + odd, 8)
    every = [(i, v) for i, v in every if np.abs(v).max() > 0]

    def cosine(x, y):
        x, y = x / np.abs(x).max(), y / np.abs(y).max()
        return round(float(x @ y / np.sqrt((x @ x) * (y @ y))), 12)

    want = brute.nearest(every, cosine)
    found = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 12)) for r in curve_search.search(frame(spark, rows + odd)).collect())
    assert len(found) == len(want)
    agree = sum(a[3] == pytest.approx(b[3], abs=1e-9) for a, b in zip(found, want, strict=True))
    assert agree >= 0.9 * len(want)
    assert [r[2] for r in found if r[0] == 500] == [r[2] for r in want if r[0] == 500]
    repeated = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 12)) for r in curve_search.search(frame(spark, rows + odd + rows[:60])).collect())
    assert len(repeated) == len(want)
    assert curve_search.search(frame(spark, odd[:6])).count() == 0
    assert [(r.query_id, r.vec_id) for r in curve_search.search(frame(spark, rows[:2])).collect()] == [(0, 1)]


def test_exact_search(spark, vectors):
    rows, odd = vectors
    every = [(i, np.floor(256 * v).astype(int)) for i, v in brute.valid(rows + odd[:8] + odd[9:], 8)]
    want = brute.nearest(every, lambda x, y: int(x @ y))
    assert got(exact_search.search(frame(spark, rows + odd[:8] + odd[9:])), "query_id", "rank", "vec_id", "score") == want
    assert exact_search.search(frame(spark, odd[:6])).count() == 0
    assert exact_search.search(frame(spark, rows[:0] or [(1, None)])).count() == 0


def test_pruned_chunks_lose_nothing():
    rng = np.random.default_rng(11)
    c = np.floor(rng.normal(size=(3000, 12)) * rng.gamma(1, 40, size=(3000, 1))).astype(np.int64)
    c = c[np.argsort(-(c**2).sum(axis=1))]
    q = c[::60]
    ids = np.arange(len(c))
    turn = np.linalg.eigh((c.T @ c).astype(float))[1][:, ::-1]
    n, v, s = exact_search.top_in_chunk(ids[::60], q, np.full(len(q), exact_search.NONE), ids, c, turn, 4, 5)
    for x in range(len(q)):
        score = q[x] @ c.T
        score[60 * x] = exact_search.NONE
        order = np.lexsort((ids, -score))[:5]
        assert [(int(a), int(b)) for a, b in zip(v[n == x], s[n == x], strict=True)] == [(int(i), int(score[i])) for i in order]


def test_own_folder_only_where_none_is_set(spark):
    from tidegauge.llm import common

    class Bare:
        sparkContext = spark.sparkContext

        class conf:
            get = staticmethod(lambda key, default=None: default)

    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    own = common.shared_dir(Bare)
    assert own.startswith("file:///") and own == common.shared_dir(Bare)
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))


def recall_and_rows(spark, monkeypatch, x):
    """Recall of the five nearest, and rows looked at per query as a share of the table."""
    seen = []
    fitted = curve_search._window
    monkeypatch.setattr(curve_search, "_window", lambda *a: seen.append(fitted(*a)) or seen[-1])
    found = curve_search.search(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    asked = range(0, len(x), 50)
    assert len(found) == 5 * len(asked)
    hits = 0
    for q in asked:
        s = unit[q] @ unit.T
        s[q] = -2
        hits += len(set(np.argsort(-s)[:5].tolist()) & {r.vec_id for r in found if r.query_id == q})
    used, window = seen[0]
    return hits / (5 * len(asked)), min(used * (2 * window + 1) / len(x), 1.0)


def test_curve_search_in_clusters(spark, monkeypatch):
    """With structure, windows are much smaller than the table, and recall stays."""
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(60, 16))
    recall, rows = recall_and_rows(spark, monkeypatch, centres[rng.integers(0, 60, 6000)] + 0.25 * rng.normal(size=(6000, 16)))
    assert recall >= 0.9 and rows < 0.25


def test_curve_search_without_structure(spark, monkeypatch):
    """In plain noise, windows never cost more than looking at all rows."""
    recall, rows = recall_and_rows(spark, monkeypatch, np.random.default_rng(13).normal(size=(4000, 24)))
    assert recall >= 0.9 and rows <= 1.0


@pytest.mark.parametrize("window", [7, 150, 700])
def test_windows_cross_partitions(spark, monkeypatch, window):
    """On given orderings a query finds the best of all rows within its window of ranks, wherever partitions end."""
    seen = []
    monkeypatch.setattr(curve_search, "_window", lambda points, curve, *a: seen.append(curve.value) or (2, window))
    x = np.random.default_rng(17).normal(size=(1200, 8)).astype(np.float32)
    x[601] = x[600]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    found = {}
    for r in curve_search.search(rows).collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    u = curve_search.unit(np.delete(x, 601, axis=0).astype(np.float64))
    ids = np.delete(np.arange(1200), 601)
    ranks = [np.argsort(np.lexsort((ids, seen[0].keys(u, c)))) for c in range(2)]
    for q in range(0, 1200, 50):
        i = int(np.flatnonzero(ids == q)[0])
        near = [j for j in range(len(ids)) if any(abs(r[j] - r[i]) <= window for r in ranks)]
        want = {int(ids[j]): float(u[j] @ u[i]) for j in near if j != i}
        if q == 600 or 600 in want:  # a copy is found with its first
            want[601] = want.get(600, 1.0)
        best = sorted(want.items(), key=lambda w: (-w[1], w[0]))[:5]
        assert [v for v, _ in found[q]] == [v for v, _ in best]
        assert [s for _, s in found[q]] == pytest.approx([s for _, s in best])


def test_codes_come_back():
    x = curve_search.unit(np.random.default_rng(16).normal(size=(50, 24)))
    assert np.abs(curve_search.decoded(curve_search.coded(x), 24) - x).max() < 0.01
