"""Vectorised fingerprints over long symbol sequences (bytes or words).

All arithmetic is modulo 2**64. A *sequence* is a concatenation of documents;
``ends[i]`` is where the document holding position ``i`` stops, so that no
k-gram and no window ever crosses a document boundary.
"""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
POS_BITS = 24
POS_MASK = U((1 << POS_BITS) - 1)
#: Positions are numbered within blocks of fewer symbols than this.
MAX_CHUNK = 1 << POS_BITS


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble: close values become unrelated ones."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


BYTE_SYMBOLS = mix(np.arange(1, 257, dtype=U) * U(BASE))

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1); grown by doubling and kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.ones(size, dtype=U)
        filled = 1
        while filled < size:
            step = min(filled, size - filled)
            have[filled : filled + step] = have[:step] * U(pow(base, filled, 1 << 64))
            filled += step
        _powers[base] = have
    return have[:n]


def grams(sym: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of the k symbols from each position (len - k + 1 values)."""
    n = len(sym)
    if n < k:
        return np.empty(0, dtype=U)
    part, length, done, out = sym, 1, 0, None
    while True:
        if k & length:
            if out is None:
                out, done = part, length
            else:
                m = n - done - length + 1
                out = out[:m] * U(pow(BASE, length, 1 << 64)) + part[done : done + m]
                done += length
        if length * 2 > k:
            return out[: n - k + 1]
        m = n - 2 * length + 1
        part = part[:m] * U(pow(BASE, length, 1 << 64)) + part[length : length + m]
        length *= 2


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    n = len(v) - w + 1
    if n <= 0:
        return np.empty(0, dtype=v.dtype)
    part, length = v, 1
    while length * 2 <= w:
        part = np.minimum(part[:-length], part[length:])
        length *= 2
    return np.minimum(part[:n], part[w - length : w - length + n])


def spans(sym: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each sym[start:end]; equal content gives equal values anywhere."""
    acc = np.zeros(len(sym) + 1, dtype=U)
    np.cumsum(sym * powers(BASE, len(sym)), out=acc[1:])
    return mix((acc[ends] - acc[starts]) * powers(BASE_INV, len(sym) + 1)[starts] + (ends - starts).astype(U))


#: Windows that minimizers() goes through at a time: temporary arrays stay this long, however long the texts.
BLOCK = 1 << 20


def minimizers(sym: np.ndarray, lengths: np.ndarray, k: int, window: int):
    """The anchors of every ``window`` symbols long stretch of each document.

    ``sym`` holds the documents one after another, ``lengths`` their sizes.
    Each window's anchor is its leftmost k-gram of least hash, which depends on
    nothing but the window's content: equal windows have equal anchors at equal
    offsets. Returns (anchor position, fingerprint of its k-gram, first window
    start, last window start) for each run of windows that share an anchor.
    Sequences are gone through in overlapping blocks, with the same result for
    any size of them.
    """
    empty = np.empty(0, dtype=np.int64)
    out = []
    bounds, within = np.cumsum(lengths), window - k + 1
    step = min(BLOCK, MAX_CHUNK - within)  # windows of a block
    for i in range(0, len(sym) - window + 1, step):
        part = sym[i : i + step + window - 1]
        g = mix(grams(part, k))
        keyed = (g & ~POS_MASK) | np.arange(len(g), dtype=U)
        least = (sliding_min(keyed, within) & POS_MASK).astype(np.int64)
        del keyed
        # windows that end within the document that they start in
        at = i + np.arange(len(least))
        starts = np.flatnonzero(at + window <= bounds[np.minimum(np.searchsorted(bounds, at, side="right"), len(bounds) - 1)])
        if not len(starts):
            continue
        at = least[starts]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        last = np.append(first[1:], len(at)) - 1
        out.append((at[first] + i, g[at[first]], starts[first] + i, starts[last] + i))
    if not out:
        return empty, empty.astype(U), empty, empty
    at, g, first, last = (np.concatenate(x) for x in zip(*out, strict=True))
    new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])  # a run may go on in the next block
    return at[new], g[new], first[new], last[np.append(new[1:], len(at)) - 1]


WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


#: Bytes that aren't part of a run of letters and digits (all bytes of characters beyond ASCII count as letters).
NOT_LETTERS = np.ones(256, dtype=bool)
NOT_LETTERS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


#: Words of more bytes get a cryptographic hash: there are different words of 1024 bytes that a polynomial modulo 2**64 can't tell apart.
LONG_WORD = 512


#: What of eight bytes belongs to a word of 0 to 8 bytes.
_EIGHT = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=U)


def distinct(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hash of each buf[s:e]: different ones of up to eight bytes never share it; longer ones, and those that end in a zero byte, get a cryptographic one."""
    held = np.concatenate([buf, np.zeros(8, dtype=np.uint8)])
    h = mix(np.ndarray(len(buf) + 1, dtype="<u8", buffer=held, strides=(1,))[s] & _EIGHT[np.minimum(e - s, 8)])
    raw, known = buf.tobytes(), {}
    at = np.flatnonzero((e - s > 8) | (buf[e - 1] == 0))
    found = []
    for i, j in zip(s[at].tolist(), e[at].tolist(), strict=True):
        w = raw[i:j]
        x = known.get(w)
        if x is None:
            x = known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        found.append(x)
    h[at] = np.array(found, dtype=U)
    return h


def words(buf: np.ndarray, lengths: np.ndarray, lower: bool = False, between: np.ndarray = WHITE, exact: bool = False):
    """Words of concatenated texts: (hash of each, start, end, words per text).

    A word is a maximal run of bytes other than those ``between`` within one
    text: space and 0x09-0x0D if not given; ``lower`` folds A-Z first, and
    ``exact`` takes hashes of ``distinct`` instead of polynomials.
    """
    if not len(buf):
        e = np.empty(0, dtype=np.int64)
        return e.astype(U), e, e, np.zeros(len(lengths), dtype=np.int64)
    if lower:
        buf = LOWER[buf]
    solid = ~between[buf]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    stops = solid.copy()
    stops[:-1] &= ~solid[1:]
    bounds = np.cumsum(lengths)
    cut = bounds[:-1][(bounds[:-1] > 0) & (bounds[:-1] < len(buf))]
    begins[cut] = solid[cut]
    stops[cut - 1] = solid[cut - 1]
    s, e = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    n = np.diff(np.searchsorted(s, bounds), prepend=0)
    if exact:
        return distinct(buf, s, e), s, e, n
    h = np.empty(len(s), dtype=U)
    i = 0
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(e, s[i] + BLOCK, side="right")))
        if j > i + 1 or e[i] - s[i] <= LONG_WORD:
            h[i:j] = spans(BYTE_SYMBOLS[buf[s[i] : e[j - 1]]], s[i:j] - s[i], e[i:j] - s[i])
        i = j
    for i in np.flatnonzero(e - s > LONG_WORD):
        h[i] = int.from_bytes(hashlib.blake2b(buf[s[i] : e[i]].tobytes(), digest_size=8).digest(), "little")
    return h, s, e, n
