"""Byte-level BPE by contiguous rank arrays.

A short word is held as one contiguous array of part ids with one array of the
ranks of adjacent pairs beside it. The smallest rank is searched by a scan of
the array, the boundary there is deleted, and the two ranks beside it are
refreshed, until no pair has a rank. Words of one batch run side by side: the
arrays of all of them are rows of one matrix, so scan, deletion and refresh are
single numpy calls. Words of over ``SHORT`` bytes, where repeated scans would
cost the square of the length, take a heap with the same order of merges.

Texts are cut at single spaces first. A cut before a space is one of the
pre-tokenizer's own boundaries unless white space stands on both sides of that
space; texts that have such places are cut by the pattern alone. Results are
kept per piece, so a repeated piece costs one look-up.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from itertools import chain

import numpy as np
import regex

PATTERN = regex.compile(
    # fixed value: the public vocabulary's pre-tokenizer
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
INNER_SPACE = re.compile(r"\s \s")
SHORT = 192
NONE = np.int32(2**31 - 1)
KEEP_LENGTH, KEEP_PIECES = 32, 400_000
BATCH_CHARS = 2_000_000


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class RankArrayEncoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.byte_ids = np.array([vocab[s] for s in byte_symbols()], dtype=np.int32)
        left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        out = np.array([vocab[a + b] for a, b in merges], dtype=np.int32)
        keys = left << 17 | right
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = out  # by rank
        self.name = f"{os.path.basename(path)}:{len(vocab)}:{len(merges)}"
        self._words: dict[str, tuple[int, ...]] = {}
        self._pieces: dict[str, int] = {}
        self._ids: list[np.ndarray] = []
        self._reset()

    def _reset(self) -> None:
        self._words.clear()
        self._pieces.clear()
        self._ids, self._sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 17 | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def _rows(self, words: list[bytes]) -> list[np.ndarray]:
        """Words of one batch, all at most SHORT bytes, longest first or of like length."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        width = int(lens.max())
        flat = np.frombuffer(b"".join(words), np.uint8)
        cols = np.arange(width)
        inside = cols < lens[:, None]
        ids = np.zeros((len(words), width), np.int32)
        ids[inside] = self.byte_ids[flat]
        out: list = [None] * len(words)
        who = np.arange(len(words))
        ranks = np.full((len(words), max(width - 1, 1)), NONE, np.int32)
        if width > 1:
            pair = inside[:, 1:]
            ranks[:, : width - 1][pair] = self._rank(ids[:, :-1][pair], ids[:, 1:][pair])
        while len(who):
            k = ranks.argmin(1)
            row = np.arange(len(who))
            least = ranks[row, k]
            done = least == NONE
            if done.any():
                for i in np.flatnonzero(done):
                    out[who[i]] = ids[i, : lens[i]].copy()
                go = ~done
                who, ids, ranks, lens, k, least = who[go], ids[go], ranks[go], lens[go], k[go], least[go]
                row = np.arange(len(who))
                if not len(who):
                    break
            width = ids.shape[1]
            take = np.arange(width - 1)
            ids = np.take_along_axis(ids, take + (take > k[:, None]), 1)
            ids[row, k] = self.merged[least]
            lens = lens - 1
            if width - 2 > 0:
                take = take[:-1]
                ranks = np.take_along_axis(ranks, take + (take >= k[:, None]), 1)
            else:
                ranks = np.full((len(who), 1), NONE, np.int32)
            before, after = k > 0, k + 1 < lens
            r, kk = row[before], k[before]
            ranks[r, kk - 1] = self._rank(ids[r, kk - 1], ids[r, kk])
            r, kk = row[after], k[after]
            ranks[r, kk] = self._rank(ids[r, kk], ids[r, kk + 1])
        return out

    def _long(self, word: bytes) -> np.ndarray:
        """The same merges for a word of any length: a heap of (rank, place) over a linked list."""
        ids = self.byte_ids[np.frombuffer(word, np.uint8)]
        n = len(ids)
        first = self._rank(ids[:-1], ids[1:])
        heap = [(int(first[i]), i, int(ids[i]), int(ids[i + 1])) for i in np.flatnonzero(first != NONE)]
        heapq.heapify(heap)
        ids = ids.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        known: dict[tuple[int, int], int] = {}

        def push(i: int, j: int) -> None:
            pair = ids[i], ids[j]
            if pair not in known:
                known[pair] = int(self._rank(np.array([pair[0]]), np.array([pair[1]]))[0])
            if known[pair] != NONE:
                heapq.heappush(heap, (known[pair], i, *pair))

        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.merged[rank]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                push(i, after[i])
            if before[i] >= 0:
                push(before[i], i)
        return np.array([x for x in ids if x >= 0], np.int32)

    def words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of pre-tokenized words."""
        raw = [w.encode("utf-8", "replace") for w in words]
        out: list = [None] * len(raw)
        short = []
        for i, b in enumerate(raw):
            if len(b) > SHORT:
                out[i] = self._long(b)
            else:
                short.append(i)
        short.sort(key=lambda i: len(raw[i]))
        at = 0
        while at < len(short):
            # rows of nearly one length, about a quarter of a million cells
            longest = len(raw[short[min(at + 4096, len(short)) - 1]]) or 1
            take = short[at : at + max(64, min(4096, 250_000 // longest))]
            for i, ids in zip(take, self._rows([raw[i] for i in take])):
                out[i] = ids
            at += len(take)
        return out

    def _pieces_of(self, text: str) -> list[str]:
        """Pieces of a text; a piece without the space before it is marked by one behind it."""
        if INNER_SPACE.search(text):
            return [w[1:] if w[0] == " " and " " not in w[1:] else w + " " for w in PATTERN.findall(text)]
        parts = text.split(" ")
        if parts[0]:
            parts[0] += " "
        else:
            del parts[0]
        return parts

    def _learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of new pieces, one after another."""
        split = [PATTERN.findall(p[:-1] if p[-1:] == " " else " " + p) for p in pieces]
        new = list(set(chain.from_iterable(split)) - self._words.keys())
        if len(self._words) + len(new) > KEEP_PIECES:
            self._words.clear()
            new = list(set(chain.from_iterable(split)))
        self._words.update(zip(new, map(np.ndarray.tolist, self.words(new))))
        of = self._words
        lists = [list(chain.from_iterable([of[w] for w in s])) for s in split]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum()))
        return ids, sizes

    def _batch(self, texts: list[str], count_only: bool):
        split = [self._pieces_of(t) if t else [] for t in texts]
        per = np.fromiter(map(len, split), np.int64, len(split))
        flat = list(chain.from_iterable(split))
        if len(self._pieces) > KEEP_PIECES:
            self._reset()
        new = list(set(flat) - self._pieces.keys())
        kept = [p for p in new if len(p) <= KEEP_LENGTH]
        rest = [p for p in new if len(p) > KEEP_LENGTH]
        ids, sizes = self._learn(kept + rest)
        n = len(self._sizes)
        index = dict(zip(rest, range(n + len(kept), n + len(new))))
        self._pieces.update(zip(kept, range(n, n + len(kept))))
        all_ids, all_sizes = np.concatenate([self._ids, ids]), np.concatenate([self._sizes, sizes])
        self._sizes = all_sizes[: n + len(kept)]
        self._ids = all_ids[: int(self._sizes.sum())]
        self._pieces.update(index)
        at = np.fromiter(map(self._pieces.__getitem__, flat), np.int64, len(flat))
        for p in rest:
            del self._pieces[p]
        size = all_sizes[at]
        bounds = np.concatenate([[0], np.cumsum(size)])
        ends = bounds[np.cumsum(per)]
        counts = np.diff(np.concatenate([[0], ends]))
        if count_only:
            return None, counts
        starts = np.concatenate([[0], np.cumsum(all_sizes)])[at]
        where = np.repeat(starts - bounds[:-1], size) + np.arange(bounds[-1])
        return all_ids[where], counts

    def encode(self, texts: list[str | None], count_only: bool = False) -> tuple[np.ndarray | None, np.ndarray]:
        """All ids one after another and the number of ids of each text; null and empty have none."""
        ids, counts, at = [], [], 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and chars < BATCH_CHARS:
                chars += len(texts[end] or "")
                end += 1
            some, n = self._batch(texts[at:end], count_only)
            ids.append(some)
            counts.append(n)
            at = end
        n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        return (None if count_only else np.concatenate(ids) if ids else np.zeros(0, np.int32)), n


_ENCODERS: dict[str, RankArrayEncoder] = {}


def encoder(path: str) -> RankArrayEncoder:
    """One encoder per Python worker, with what it has learnt."""
    if path not in _ENCODERS:
        _ENCODERS[path] = RankArrayEncoder(path)
    return _ENCODERS[path]
