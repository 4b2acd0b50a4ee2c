"""Benchmark decontamination by a prefix-filtered join of word windows.

A window is `window` consecutive words of an item (an item with fewer words is one window). Seen as
the set of its word shingles, a window is contained in a document only if all its shingles are; so
it suffices to look for one of them. Shingles are counted over all documents, and each window is
looked for by its rarest. Where that occurs, the shingle's place in the window gives the place the
window must take (positional bound), which must lie inside the document (length bound), and all of
its words are then compared.

The items are a stated query set: they are taken in blocks of at most `block_windows` windows, long
items in parts, so that what is sent to the tasks has a fixed bound, and each block passes over all
documents; the driver holds one block at a time, and what was found is written between blocks. Texts
never move between tasks; a window that occurs everywhere costs its occurrences and nothing else.

Defined results: null or empty texts have no words and no windows; texts of any length are read whole;
repeated items count once; of shingles equally rare a window's first is looked for; items without an id mark
words but are not listed; repeated documents stay repeated; without items or documents nothing is hit. Columns
of docs other than its id and text are held in `row` if `carry` names them, so that none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facelake.llm.common import raw_bytes, spans_of, stored, text_column

#: Letters, digits and whatever lies above ASCII stay, A-Z in lower case; the rest parts words.
WORDS = bytes(
    b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)
#: Bytes of text that are looked through at once.
CHUNK = 4 << 20


class Windows:
    """A block of windows, by the numbers of their words, and the shingles they are found by."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int, shingle: int):
        self.number: dict[bytes, int] = {}
        self.shingle = shingle
        found: dict[tuple[int, ...], set[str]] = {}
        for item, words in items:
            ids = [self.number.setdefault(w, len(self.number)) for w in words]
            for at in range(max(1, len(ids) - window + 1)):
                listed = found.setdefault(tuple(ids[at : at + window]), set())
                if item is not None:
                    listed.add(item)
        self.items = [sorted(x) for x in found.values()]
        by_length: dict[int, list[int]] = {}
        keys = list(found)
        for i, key in enumerate(keys):
            by_length.setdefault(len(key), []).append(i)
        #: windows of one length: their numbers, and their words as a matrix
        self.lengths = {k: (np.array(v), np.array([keys[i] for i in v], np.int64)) for k, v in by_length.items()}
        self.codes: dict[int, np.ndarray] = {}
        self.anchors: dict[int, tuple] = {}
        wide = sorted({min(shingle, k) for k in self.lengths})
        #: for each further word of a shingle, the numbers of the runs up to it
        self.runs: list[np.ndarray] = []
        for n in range(2, max(wide, default=0)):
            runs = [self.code(m, n).ravel() for k, (_, m) in self.lengths.items() if k >= n]
            self.runs.append(np.unique(np.concatenate(runs)))
        for w in wide:
            own = [self.code(m, w).ravel() for k, (_, m) in self.lengths.items() if min(shingle, k) == w]
            self.codes[w] = np.unique(np.concatenate(own))

    def code(self, words: np.ndarray, width: int) -> np.ndarray:
        """One number for each run of so many words along the last axis; -1 where none of the block's has it.

        A run's number is that of all but its last word, as its place among the block's runs of that length,
        and its last word: both lie below the number of the block's words, and so their product below 2**63.
        """
        n, base = words.shape[-1] - width + 1, max(1, len(self.number))
        if n <= 0:
            return np.zeros((*words.shape[:-1], 0), np.int64)
        code = words[..., :n]
        for i in range(1, width):
            if i > 1:
                place = np.searchsorted(self.runs[i - 2], code)
                place[place == len(self.runs[i - 2])] = 0
                code = np.where((code >= 0) & (self.runs[i - 2][place] == code), place, -1)
            part = words[..., i : i + n]
            code = np.where((code >= 0) & (part >= 0), code * base + part, -1)
        return code

    def look_up(self, code: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of code that hold a shingle of this block, and that shingle's rank."""
        at = np.flatnonzero(code >= 0)
        rank = np.searchsorted(self.codes[width], code[at])
        rank[rank == len(self.codes[width])] = 0
        known = self.codes[width][rank] == code[at]
        return at[known], rank[known]

    def choose(self, counts: dict[int, np.ndarray]) -> None:
        """Sets each window's anchor: the shingle with the least count, the first of equal ones."""
        for k, (_, matrix) in self.lengths.items():
            w = min(self.shingle, k)
            ranks = np.searchsorted(self.codes[w], self.code(matrix, w))
            offset = counts[w][ranks].argmin(axis=1)
            anchor = ranks[np.arange(len(ranks)), offset]
            order = np.argsort(anchor, kind="stable")
            first = np.searchsorted(anchor[order], np.arange(len(self.codes[w]) + 1))
            self.anchors[k] = (order, offset[order], first)

    def occurrences(self, words: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, window numbers, starts) of the windows in a run of word numbers."""
        for k, (numbers, matrix) in self.lengths.items():
            w = min(self.shingle, k)
            order, offset, first = self.anchors[k]
            at, rank = self.look_up(self.code(words, w), w)
            n = first[rank + 1] - first[rank]
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[rank], n)
            row, start = order[place], np.repeat(at, n) - offset[place]
            inside = (start >= 0) & (start + k <= len(words))
            row, start = row[inside], start[inside]
            for i in range(k):
                same = words[start + i] == matrix[row, i]
                row, start = row[same], start[same]
            yield k, numbers[row], start


def _numbered(texts: list[bytes], number: dict[bytes, int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, word numbers, first place of each text and the end) for runs of texts.

    Words outside the block are -1, and so is a place behind each text."""
    first = 0
    while first < len(texts):
        words: list[bytes] = []
        bounds, size, last = [0], 0, first
        while last < len(texts) and (last == first or size + len(texts[last]) <= CHUNK):
            words += texts[last].translate(WORDS).split()
            words.append(b"")
            bounds.append(len(words))
            size += len(texts[last])
            last += 1
        yield first, np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words)), np.array(bounds)
        first = last


def _blocks(items: DataFrame, window: int, shingle: int, most: int) -> Iterator[Windows]:
    held, n = [], 0
    for item, text in items.toLocalIterator():
        words = text.encode().translate(WORDS).split()
        windows = max(1, len(words) - window + 1) if words else 0
        at = 0
        while at < windows:
            part = min(windows - at, most - n)
            held.append((item, words[at : at + part + window - 1]))
            at, n = at + part, n + part
            if n >= most:
                yield Windows(held, window, shingle)
                held, n = [], 0
    if held:
        yield Windows(held, window, shingle)


def _count(docs: DataFrame, sent) -> dict[int, np.ndarray]:
    """How often each shingle of the block occurs in all documents."""

    def count(batches):
        import pyarrow as pa

        block = sent.value
        totals = {w: np.zeros(len(c), np.int64) for w, c in block.codes.items()}
        for batch in batches:
            for _, words, _ in _numbered(raw_bytes(batch.column(0)), block.number):
                for w, total in totals.items():
                    total += np.bincount(block.look_up(block.code(words, w), w)[1], minlength=len(total))
        for w, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.record_batch([pa.array(np.full(len(at), w)), pa.array(at), pa.array(total[at])], names=["width", "rank", "n"])

    found = docs.select("text").mapInArrow(count, "width long, rank long, n long").groupBy("width", "rank").agg(F.sum("n").alias("n"))
    counts = {w: np.zeros(len(c), np.int64) for w, c in sent.value.codes.items()}
    for width, rank, n in found.collect():  # a row for each of the block's shingles at most
        counts[width][rank] = n
    return counts


def _mark(docs: DataFrame, sent, last: bool) -> DataFrame:
    """Adds a block's hits to those of the blocks before it."""

    def mark(batches):
        import pyarrow as pa

        block = sent.value
        for batch in batches:
            col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            before = [col[x].to_pylist() for x in ("starts", "ends", "items")]
            n_words, starts, ends, listed = [], [], [], []
            for first, words, bounds in _numbered(raw_bytes(col["text"]), block.number):
                edges = np.zeros(len(words) + 1, np.int64)
                owner: list[tuple[np.ndarray, np.ndarray]] = []
                for k, number, start in block.occurrences(words):
                    np.add.at(edges, start, 1)
                    np.add.at(edges, start + k, -1)
                    owner.append((np.searchsorted(bounds, start, "right") - 1, number))
                items: dict[int, set[str]] = {}
                for text, number in owner:
                    for t, w in set(zip(text.tolist(), number.tolist(), strict=True)):
                        items.setdefault(t, set()).update(block.items[w])
                hit = np.cumsum(edges[:-1]) > 0
                for t, (a, b) in enumerate(zip(bounds, bounds[1:] - 1, strict=False)):
                    own = hit[a:b].copy()
                    old = [x[first + t] for x in before]
                    for s, e in zip(old[0], old[1], strict=True):
                        own[s:e] = True
                    s, e = spans_of(own) if own.any() else ((), ())
                    n_words.append(int(b - a))
                    starts.append(list(s))
                    ends.append(list(e))
                    listed.append(sorted({*old[2], *items.get(t, ())}))
            out = [col["id"], col["row"], pa.array(n_words, pa.int64()), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), pa.array(listed, pa.list_(pa.string()))]
            names = ["id", "row", "n_words", "starts", "ends", "items"]
            yield pa.record_batch(out if last else [*out, col["text"]], names=names if last else [*names, "text"])

    schema = docs.select(
        "id", "row", F.lit(0).cast("long").alias("n_words"), "starts", "ends", "items", *([] if last else ["text"])
    ).schema
    return docs.mapInArrow(mark, schema)


def find_windows(
    docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3, block_windows: int = 200_000,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", carry: tuple[str, ...] = (),
) -> DataFrame:
    """(id, row, n_words, starts, ends, items): for each row of docs the spans of words, by their places in
    the text, that lie inside an occurrence of an item's window, and the items they come from.

    block_windows: the most windows that are sent to the tasks at once. carry: columns of docs that `row` holds.
    """
    spark = docs.sparkSession
    none = F.array().cast("array<int>")
    kept = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.struct(F.lit(0).alias("none"))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), kept.alias("row"), text_column(docs, text_col))
    queries = items.select(F.col(f"`{item_col}`").cast("string"), text_column(items, item_text_col)).distinct()
    blocks = _blocks(queries, window, shingle, block_windows)
    block = next(blocks, Windows([], window, shingle))
    found = rows.select("id", "row", "text", none.alias("starts"), none.alias("ends"), F.array().cast("array<string>").alias("items"))
    while True:
        if block.items:
            sent = spark.sparkContext.broadcast(block)
            block.choose(_count(rows, sent))
            sent.destroy()
        sent, block = spark.sparkContext.broadcast(block), next(blocks, None)
        if block is None:
            return _mark(found, sent, True)
        found = stored(_mark(found, sent, False), "windows")
        sent.destroy()
