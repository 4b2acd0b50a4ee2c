"""Folding the lattices of many words at once, by merge priority, with numpy inside a task.

A lattice edge is a piece; for a BPE model an edge is taken where both of its parts still stand, in the
order of its priority and from left to right. All words of about one length are rows of a matrix of
symbols, and each step takes every row's best edge, so that no word costs a loop of its own.
"""

from __future__ import annotations

import heapq

import numpy as np

NONE = np.iinfo(np.int32).max
#: Widths of the matrices; longer words are folded one by one with a heap.
WIDTHS = (6, 8, 10, 12, 16, 24, 40, 64)


class Merges:
    """The edges of a BPE model by their two parts.

    pieces: piece to (id, score). Characters that are in pieces without being one get symbols behind the
    ids; all others are -1 and join nothing.
    """

    def __init__(self, pieces: dict[str, tuple[int, float]], size: int, byte_ids: list[int], unknown: int):
        self.byte_ids, self.unknown, self.size = byte_ids, unknown, size
        symbol = {p: i for p, (i, _) in pieces.items()}
        for c in sorted({c for p in pieces for c in p}):
            symbol.setdefault(c, size + len(symbol))
        self.base = max(symbol.values()) + 1
        self.of_char = np.full(0x110000, -1, np.int32)
        for s, i in symbol.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        order = sorted((p for p in pieces if len(p) > 1), key=lambda p: -pieces[p][1])
        levels = {score: i for i, score in enumerate(sorted({-pieces[p][1] for p in order}))}
        self.length = {i: len(s) for s, i in symbol.items()}
        edges = {}
        for p in order:
            for k in range(1, len(p)):
                left, right = symbol.get(p[:k]), symbol.get(p[k:])
                if left is not None and right is not None:
                    edges[left * self.base + right] = levels[-pieces[p][1]], symbol[p]
        self.edges = edges
        # an open-addressed table of the same, for whole arrays of pairs
        self.bits = max(4, (4 * len(edges)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full((1 << self.bits, 2), NONE, np.int32)
        left, rank = np.array(list(edges), np.int64), np.array(list(edges.values()), np.int32).reshape(-1, 2)
        at = self._place(left)
        while len(left):
            free = self.keys[at] < 0
            first = np.zeros(len(at), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.keys[at[put]], self.values[at[put]] = left[put], rank[put]
            left, rank, at = left[~put], rank[~put], (at[~put] + 1) & ((1 << self.bits) - 1)

    def _place(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray, value: int = 0) -> np.ndarray:
        """The priority (value 0) or the symbol (1) of the edge that each pair of symbols makes, NONE without one."""
        key = left.astype(np.int64) * self.base + right
        out = np.full(key.shape, NONE, np.int32)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        key, flat = key.ravel()[todo], out.reshape(-1)
        at = self._place(key)
        while len(todo):
            held = self.keys[at]
            same = held == key
            flat[todo[same]] = self.values[at[same], value]
            on = ~same & (held >= 0)
            todo, key, at = todo[on], key[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out

    def fold(self, words: list[str], kind: np.dtype) -> list[bytes]:
        """The packed ids of each word."""
        out: list[bytes] = [b""] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        low = 0
        for width in WIDTHS:
            own = np.flatnonzero((lengths > low) & (lengths <= width))
            low = width
            for at in range(0, len(own), 20_000):
                part = own[at : at + 20_000]
                self._rows([words[i] for i in part], lengths[part], width, kind, out, part)
        for i in np.flatnonzero(lengths > low):
            out[i] = self._ids(words[i], self._long(words[i]), kind)
        return out

    def _rows(self, words: list[str], lengths: np.ndarray, width: int, kind: np.dtype, out: list[bytes], where: np.ndarray) -> None:
        chars = np.array(words, f"<U{width}").view(np.uint32).reshape(len(words), width)
        symbols = self.of_char[chars]
        columns = np.arange(width)
        symbols[columns >= lengths[:, None]] = -2
        ranks = np.full((len(words), width), NONE, np.int32)
        ranks[:, :-1] = self.rank(symbols[:, :-1], symbols[:, 1:])
        done, rows = np.full((len(words), width), -2, np.int32), np.arange(len(words))
        while len(rows):
            at = ranks.argmin(axis=1)
            every = np.arange(len(rows))
            best = ranks[every, at]
            ended = best == NONE
            if ended.any():
                done[rows[ended]] = symbols[ended]
                go = ~ended
                rows, symbols, ranks, at = rows[go], symbols[go], ranks[go], at[go]
                every = np.arange(len(rows))
            if not len(rows):
                break
            made = self.rank(symbols[every, at], symbols[every, at + 1], 1)
            behind = columns[:-1] > at[:, None]
            symbols[:, :-1] = np.where(behind, symbols[:, 1:], symbols[:, :-1])
            symbols[:, -1] = -2
            ranks[:, :-1] = np.where(behind, ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NONE
            symbols[every, at] = made
            right = np.where(at + 1 < width, symbols[every, np.minimum(at + 1, width - 1)], -2)
            ranks[every, at] = self.rank(symbols[every, at], right)
            inner = np.flatnonzero(at > 0)
            ranks[inner, at[inner] - 1] = self.rank(symbols[inner, at[inner] - 1], symbols[inner, at[inner]])
        plain = ((done < self.size) & (done != -1)).all(axis=1)
        used = done != -2
        ends = np.cumsum(used.sum(axis=1)) * kind.itemsize
        data = done[used].astype(kind).tobytes()
        first = 0
        for i, end in enumerate(ends.tolist()):
            out[where[i]] = data[first:end]
            first = end
        for i in np.flatnonzero(~plain):
            out[where[i]] = self._ids(words[i], done[i][used[i]].tolist(), kind)

    def _long(self, word: str) -> list[int]:
        """The symbols of one word of any length: neighbours in a linked list, edges in a heap."""
        symbols, n = self.of_char[np.array([word], f"<U{len(word)}").view(np.uint32)].tolist(), len(word)
        before, behind = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = behind[i]
            if j < n and symbols[i] >= 0 and symbols[j] >= 0:
                edge = self.edges.get(symbols[i] * self.base + symbols[j])
                if edge is not None:
                    heapq.heappush(heap, (edge[0], i, symbols[i], symbols[j]))

        for i in range(n - 1):
            offer(i)
        gone = -3
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = behind[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue
            symbols[i], symbols[j] = self.edges[left * self.base + right][1], gone
            behind[i] = behind[j]
            if behind[i] < n:
                before[behind[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [s for s in symbols if s != gone]

    def _ids(self, word: str, symbols: list[int], kind: np.dtype) -> bytes:
        """Ids of symbols some of which stand for no piece: bytes where the model has them, else the unknown id."""
        ids, at = [], 0
        for s in symbols:
            n = self.length.get(s, 1)
            if 0 <= s < self.size:
                ids.append(s)
            elif self.byte_ids:
                ids += [self.byte_ids[b] for b in word[at : at + n].encode()]
            else:
                ids.append(self.unknown)
            at += n
        return np.array(ids, kind).tobytes()
