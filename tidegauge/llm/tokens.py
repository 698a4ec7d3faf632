"""Byte-level BPE encoding with the tokenizers library, word by word from a cache.

A byte-level pre-tokenizer never lets a token reach over a single space that
stands between two characters that aren't white space, so the chunks between
such spaces encode to the same ids alone as within their text. Most chunks
repeat, and so each distinct chunk is encoded once per worker process.
"""

from __future__ import annotations

import os
import re

import numpy as np

_SAFE = re.compile(r"(?<=\S) (?=\S)")
#: Distinct chunks a worker keeps before it starts anew.
KEEP = 600_000
_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class _Numbers(dict):
    """Chunk (without the space before it) to its number; a new one is noted in ``fresh``."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, chunk: str) -> int:
        n = self[chunk] = len(self)
        self.fresh.append(chunk)
        return n


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        #: Whether a token begins with a space: in joined chunks, just the first token of each.
        self.opens = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.opens[[i for token, i in vocab.items() if token.startswith("\u0120")]] = True
        self.clear()

    def clear(self) -> None:
        self.number = _Numbers()
        #: Chunk i has ids[at[i]:at[i+1]]; none if it isn't safe to encode alone.
        self.ids = np.empty(1 << 16, dtype=np.uint32)
        self.at = np.zeros(1 << 12, dtype=np.int64)
        self.n = 0

    def _learn(self) -> None:
        """Encodes the fresh chunks, joined by spaces: each begins at a token with a space."""
        fresh, self.number.fresh = self.number.fresh, []
        safe = np.array([bool(c) and not c[0].isspace() and not c[-1].isspace() for c in fresh], dtype=bool)
        good = [c for c, s in zip(fresh, safe, strict=True) if s]
        sizes = np.zeros(len(fresh), dtype=np.int64)
        coded = np.empty(0, dtype=np.uint32)
        if good:
            joined = [" " + " ".join(good[i : i + 2000]) for i in range(0, len(good), 2000)]
            coded = np.concatenate([np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
            sizes[safe] = np.diff(np.append(np.flatnonzero(self.opens[coded]), len(coded)))
        need, total = self.n + len(fresh) + 1, int(self.at[self.n]) + len(coded)
        if need > len(self.at):
            self.at = np.concatenate([self.at, np.zeros(max(need, len(self.at)), dtype=np.int64)])
        if total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(max(total, len(self.ids)), dtype=np.uint32)])
        self.ids[self.at[self.n] : total] = coded
        self.at[self.n + 1 : need] = self.at[self.n] + np.cumsum(sizes)
        self.n += len(fresh)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, just as the tokenizer gives them for the whole text."""
        if self.n > KEEP:
            self.clear()
        split = [t.split(" ") for t in texts]
        number = self.number.__getitem__
        chunks = [np.fromiter(map(number, s[1:]), dtype=np.int64, count=len(s) - 1) for s in split]
        if self.number.fresh:
            self._learn()
        heads = self.tokenizer.encode_batch_fast([s[0] for s in split], add_special_tokens=False)
        out = []
        for text, s, k, e in zip(texts, split, chunks, heads, strict=True):
            head = np.array(e.ids, dtype=np.uint32)
            if not len(k):
                out.append(head)
                continue
            a, z = self.at[k], self.at[k + 1]
            size = z - a
            if not s[0] or s[0][-1].isspace() or not size.all():
                out.append(self._careful(text))
                continue
            ends = np.cumsum(size)
            where = np.arange(ends[-1]) + np.repeat(a - (ends - size), size)
            out.append(np.concatenate([head, self.ids[where]]))
        return out

    def _careful(self, text: str) -> np.ndarray:
        """A text with other white space next to spaces: cut at the safe spaces only."""
        parts = _SAFE.split(text)
        coded = self.tokenizer.encode_batch_fast([parts[0], *(" " + p for p in parts[1:])], add_special_tokens=False)
        return np.fromiter((x for e in coded for x in e.ids), dtype=np.uint32)
