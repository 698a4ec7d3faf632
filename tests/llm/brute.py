"""Plain Python versions of the operators, for small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
_tokenizer = Tokenizer.from_file(TOKENIZER)
LAST = (1 << 63) - 1
WORD = rb"[^\x20\x09-\x0D]+"


def raw(text):
    return (text or "").encode()


def lowered(text):
    return bytes(x + 32 if 65 <= x <= 90 else x for x in raw(text))


def ids(text, end):
    return np.array([*_tokenizer.encode(text or "", add_special_tokens=False).ids, end], dtype="<u4")


def order(doc):
    return LAST if doc is None else doc


def crc(doc):
    return zlib.crc32(b"" if doc is None else str(doc).encode())


def shingles(text):
    w = re.findall(WORD, lowered(text))
    if len(w) >= 5:
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    return {tuple(w)} if w else set()


def jaccard(docs):
    """[(doc_id, n_shingles, component_id)] in the order of docs."""
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), LAST), order(d))
    out = []
    for i, (d, _) in enumerate(docs):
        c = least[find(i)] if sets[i] else order(d)
        out.append((d, len(sets[i]), None if c == LAST else c))
    return out


def covered(docs, split, window):
    """For each document its symbols and which of them an earlier document's window covers."""
    symbols = [split(t) for _, t in docs]
    first = {}
    for (d, _), s in zip(docs, symbols, strict=True):
        for p in range(len(s) - window + 1):
            k = tuple(s[p : p + window])
            first[k] = min(first.get(k, LAST), order(d))
    out = []
    for (d, _), s in zip(docs, symbols, strict=True):
        gone = [False] * len(s)
        for p in range(len(s) - window + 1):
            if first[tuple(s[p : p + window])] < order(d):
                gone[p : p + window] = [True] * window
        out.append((s, gone))
    return out


def suffix_dedup(docs, window=50):
    out = []
    for (d, _), (s, gone) in zip(docs, covered(docs, raw, window), strict=True):
        kept = bytes(c for c, g in zip(s, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(s), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def phrase_dedup(docs, window=50):
    out = []
    for (d, _), (w, gone) in zip(docs, covered(docs, lambda t: raw(t).split(), window), strict=True):
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def unigram(docs):
    """[(doc_id, held_out, n_tokens, n_known, train_tokens, base_score)]"""
    tokens = [[*re.findall(WORD, lowered(t)), None] for _, t in docs]
    c = Counter()
    for (d, _), w in zip(docs, tokens, strict=True):
        if crc(d) % 7 != 2:
            c.update(w)
    n, v = sum(c.values()), len(c)
    return [(d, crc(d) % 7 == 2, len(w), sum(c[x] > 0 for x in w), n, float(sum(np.log10((c[x] + 1) / (n + v + 1)) for x in w))) for (d, _), w in zip(docs, tokens, strict=True)]


def pair_scores(docs, prior=60.0):
    """[(doc_id, n_tokens, score)] by exact counts of words and pairs."""
    tokens = [[*re.findall(WORD, lowered(t)), None] for _, t in docs]
    c, both, n = Counter(), Counter(), 0
    for (d, _), w in zip(docs, tokens, strict=True):
        if crc(d) % 7 != 2:
            c.update(w)
            both.update(zip([b" ", *w], w, strict=False))
            n += 1
    total, distinct = sum(c.values()), len(c)
    c[b" "] = n  # begins a text

    def p(a, x):
        one = (c[x] + 1) / (total + distinct + 1)
        return (min(both[a, x], c[a]) + prior * one) / (c[a] + prior)

    return [(d, len(w), float(sum(np.log10(p(a, x)) for a, x in zip([b" ", *w], w, strict=False)))) for (d, _), w in zip(docs, tokens, strict=True)]


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """{source: target} by sharing out again what goes beyond the caps."""
    of = dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), (weights[i % len(weights)] for i in range(len(sizes))), strict=True))
    out, free, left = {}, set(sizes), share * sum(sizes.values())
    while free:
        level = left / sum(of[s] for s in free)
        over = [s for s in free if of[s] * level > most * sizes[s]]
        if not over:
            return out | {s: of[s] * level for s in free}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            free.remove(s)
    return out


def valid(rows, d):
    return [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v is not None and len(v) == d and all(x is not None for x in v) and np.isfinite(np.array(v, dtype=float)).all()]


def nearest(rows, score, k=5):
    """[(query_id, rank, vec_id, score)] over rows (id, vector), ids distinct."""
    out = []
    for q, x in rows:
        if q % 50 == 0:
            found = sorted(((-score(x, y), i) for i, y in rows if i != q))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return out


def by_id(rows):
    out = defaultdict(list)
    for r in rows:
        out[r[0]].append(r)
    return out
