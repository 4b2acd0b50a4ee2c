"""Token ids as binary files with Elias-Fano document boundaries.

A file holds the ids of a range of documents in ascending order of doc_id, concatenated as 16- or
32-bit integers, and two Elias-Fano sequences: where each document starts, and the documents' ids.
n values below u take about n * (2 + log2(u / n)) bits; a sample of the upper half's ones lets
`select` reach any document by looking at a few bytes. A reader takes every offset from there.

Layout, little-endian: magic `FLTOK1`, byte width of an id (uint16), number of rows without doc_id,
smallest doc_id (int64 each), byte lengths of the two sequences (int64 each), the sequences, the ids.

Files are written by tasks under names no other attempt uses; the manifest, written when all tasks
have ended, names those that count, so a lost executor or a repeated task leaves nothing wrong.

Defined results: a null text is empty and gives just the end id; rows without doc_id come first and
keep their null; rows of one doc_id are in the order of a hash of their texts; repeated rows stay repeated;
texts of any length are encoded whole; an empty table gives no file and an empty result. Other columns than id
and text are not read, so that none can clash.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facelake.llm.common import stored, text_column

MAGIC = b"FLTOK1"
HEADER = struct.Struct("<6sHqqqq")
#: One in so many ones of the upper half has its place recorded.
SAMPLE = 64
SEQUENCE = struct.Struct("<qqBq")


class EliasFano:
    """A non-decreasing sequence of non-negative integers in near-minimal space."""

    def __init__(self, n: int, universe: int, low_bits: int, low: np.ndarray, high: np.ndarray, sample: np.ndarray):
        self.n, self.universe, self.low_bits, self.low, self.high, self.sample = n, universe, low_bits, low, high, sample

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n, universe = len(values), int(values[-1]) + 1 if len(values) else 0
        low_bits = max(0, (universe // n).bit_length() - 1) if n else 0
        shifts = np.arange(low_bits, dtype=np.int64)
        low = np.packbits((values[:, None] >> shifts & 1).astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> low_bits) + np.arange(n)
        if n and ones[-1] >= 1 << 32:
            raise ValueError("too many values for a 32-bit directory")
        upper = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        upper[ones] = 1
        return cls(n, universe, low_bits, low, np.packbits(upper, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        head = SEQUENCE.pack(self.n, self.universe, self.low_bits, len(self.high))
        return head + self.low.tobytes() + self.high.tobytes() + self.sample.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, universe, low_bits, n_high = SEQUENCE.unpack_from(data)
        at = SEQUENCE.size
        n_low = (n * low_bits + 7) // 8
        low = np.frombuffer(data, np.uint8, n_low, at)
        high = np.frombuffer(data, np.uint8, n_high, at + n_low)
        return cls(n, universe, low_bits, low, high, np.frombuffer(data, "<u4", -1, at + n_low + n_high))

    def select(self, i: int) -> int:
        """Value i, read from the sampled place before it on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.sample[i // SAMPLE]), i % SAMPLE
        byte, left = at // 8, left + int.bit_count(int(self.high[at // 8]) & ((1 << at % 8) - 1))
        while left >= (here := int.bit_count(int(self.high[byte]))):
            left, byte = left - here, byte + 1
        place = byte * 8 + int(np.flatnonzero(np.unpackbits(self.high[byte : byte + 1], bitorder="little"))[left])
        first = i * self.low_bits
        bits = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8].tobytes(), "little") >> first % 8
        return (place - i) << self.low_bits | bits & ((1 << self.low_bits) - 1)

    def values(self) -> np.ndarray:
        """The whole sequence."""
        high = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n] - np.arange(self.n)
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        return high << self.low_bits | bits.astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))


def pack(doc_ids: list[int | None], encoded: list[bytes], width: int) -> bytes:
    """A file's bytes: doc_ids ascending with nulls first, encoded the bytes of each document's ids."""
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    least = int(known[0]) if len(known) else 0
    lengths = np.array([len(e) // width for e in encoded], np.int64)
    starts = EliasFano.encode(np.concatenate(([0], np.cumsum(lengths)))).to_bytes()
    docs = EliasFano.encode(known - least).to_bytes()
    head = HEADER.pack(MAGIC, width, len(doc_ids) - len(known), least, len(starts), len(docs))
    return b"".join([head, starts, docs, *encoded])


class TokenFile:
    """A file's documents, each reached by its place through the encoded sequences."""

    def __init__(self, data: bytes):
        magic, self.width, self.n_null, self.least, n_starts, n_docs = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = HEADER.size
        self.starts = EliasFano.from_bytes(data[at : at + n_starts])
        self.docs = EliasFano.from_bytes(data[at + n_starts : at + n_starts + n_docs])
        self.ids = np.frombuffer(data, f"<u{self.width}", -1, at + n_starts + n_docs)

    def __len__(self) -> int:
        return self.starts.n - 1

    def doc_id(self, i: int) -> int | None:
        return None if i < self.n_null else self.docs.select(i - self.n_null) + self.least

    def documents(self):
        """(doc_id, start, ids) of each document in order."""
        start = 0
        for i in range(len(self)):
            end = self.starts.select(i + 1)
            yield self.doc_id(i), start, self.ids[start:end]
            start = end

    def document(self, i: int) -> np.ndarray:
        """The ids of document i alone."""
        return self.ids[self.starts.select(i) : self.starts.select(i + 1)]


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, file_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Writes the token files of docs below folder and returns their manifest.

    manifest: (file, part, n_docs, n_ids, start), start being the number of ids in all files before.
    file_bytes: a file ends with the document that brings its ids to this size.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_column(docs, text_col))
    # a doc_id that many rows have is dealt on by their texts
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").drop("tie")

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from facelake.llm.token_counts import tokenizer_path
        from facelake.llm.word_memo import word_ids

        memo = word_ids(tokenizer_path(tokenizer), end_id)
        width = memo.width
        end = end_id.to_bytes(width, "little")
        filesystem, base = _filesystem(folder)
        filesystem.create_dir(base, recursive=True)
        part, count = TaskContext.get().partitionId(), 0

        def flush(ids, encoded):
            name = f"part-{part:06d}-{count:04d}-{uuid.uuid4().hex}.tok"
            with filesystem.open_output_stream(f"{base}/{name}") as out:
                out.write(pack(ids, encoded, width))
            n = sum(map(len, encoded)) // width
            return pa.record_batch(
                [pa.array([name]), pa.array([part], pa.int32()), pa.array([count], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([n], pa.int64())],
                names=["file", "part", "ordinal", "n_docs", "n_ids"],
            )

        ids, encoded, size = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(doc)
                encoded.append(memo.encode(text) + end)
                size += len(encoded[-1])
                if size >= file_bytes:
                    yield flush(ids, encoded)
                    ids, encoded, size, count = [], [], 0, count + 1
        if ids:
            yield flush(ids, encoded)

    files = stored(rows.mapInArrow(write, "file string, part int, ordinal int, n_docs long, n_ids long"), "token-manifest")
    before = Window.orderBy("part", "ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document, read from the files that manifest names."""

    def read(batches):
        import pyarrow as pa

        filesystem, base = _filesystem(folder)
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with filesystem.open_input_file(f"{base}/{name}") as file:
                    held = TokenFile(file.readall())
                found = [(doc, first + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for doc, start, ids in held.documents()]
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["id", "start", "n_tokens", "ids_crc32"])

    files = manifest.select("file", "start")
    return files.repartition(files.sparkSession.sparkContext.defaultParallelism).mapInArrow(
        read, "id long, start long, n_tokens long, ids_crc32 long"
    )
