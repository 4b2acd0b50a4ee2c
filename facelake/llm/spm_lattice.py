"""SentencePiece encoding and decoding over a relational lattice of word pieces.

A word's lattice has an edge for each substring that is a piece. `encode_words` builds the lattices
of a table of words with DataFrame operations: bounded-length substrings are exploded, equi-joined to
the piece table, grouped by word, and folded with the higher-order `aggregate`. What is folded
depends on the model. Unigram scores add up, and the fold over positions is Viterbi's. In a BPE model
scores are merge priorities, for which the best sum is not what the library returns; there the fold
takes the edges by priority and joins an edge's two parts where both still stand side by side, which
gives the library's pieces. Boundaries are the bits of one long.

`encode` counts the words of all documents, sends the lattice results of the frequent ones (a bounded
table) to the tasks, and lets each task fold the lattices of its rare words itself, many at once
(`piece_merges`); texts do not move. Pieces never reach across a blank or, if the vocabulary shows so,
between letters and other characters, so words are what lies between. The library only reads the
model's file. `decode` looks pieces up in a constant table, in column expressions.

Defined results: a null or empty text has no ids; characters outside the vocabulary become bytes where
the model has them, else the unknown id; blanks, tabs and line ends keep their number; a word of any
length is folded whole (in n log n steps); texts of any length are taken in runs of a megabyte or one text;
repeated rows stay repeated; an empty table gives an empty result. Decoding gives the text back, with
U+2581 as a blank. A column of the input that is called `ids` (or, in `decode`, as `into` says) gives
way to the new one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facelake.llm.common import stored, text_column
from facelake.llm.piece_merges import Merges
from facelake.llm.token_counts import tokenizer_path

BLANK = "▁"
LONGEST = 62
#: Letters, and the rest; superscripts and fractions are digits to Unicode but word characters to the pattern.
RUNS = rf"{BLANK}*[^\W\d_²³¹¼½¾]+|{BLANK}*(?:[\d_²³¹¼½¾]|(?!{BLANK})\W)+|{BLANK}+"
WORDS = rf"{BLANK}*[^{BLANK}]+|{BLANK}+"
#: Words that a task holds before it empties its memo or hands on its counts.
HELD = 100_000
#: Bytes of texts that are cut into words at once.
RUN = 1_000_000


@dataclass(frozen=True)
class Model:
    """What the lattice needs of a model: pieces with id and score, byte ids, and how words are cut."""

    kind: str
    pieces: dict[str, tuple[int, float]]
    names: list[str]
    byte_ids: list[int]
    unknown: int
    pattern: str
    reach: int


@lru_cache(maxsize=2)
def load(name: str) -> Model:
    """The model in a file."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name))
    size = processor.get_piece_size()
    names = [processor.id_to_piece(i) for i in range(size)]
    plain = [i for i in range(size) if not (processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i) or processor.is_byte(i))]
    pieces = {names[i]: (i, processor.get_score(i)) for i in plain}
    byte_ids = [i for i in range(size) if processor.is_byte(i)]
    # scores that fall by one from piece to piece are the ranks of merges
    scores = [s for p, (_, s) in pieces.items() if len(p) > 1]
    kind = "bpe" if all(s == round(s) for s in scores) else "unigram"
    cut = [p for p in pieces if len(re.findall(RUNS, p)) > 1]
    return Model(kind, pieces, names, byte_ids if len(byte_ids) == 256 else [], processor.unk_id(), WORDS if cut else RUNS, max(map(len, pieces)))


def best_path(word: str, model: Model) -> list[int]:
    """The ids of a word by the fold that encode_words does for unigram models: Viterbi over positions."""
    pieces, n = model.pieces, len(word)
    lowest = min(s for _, s in pieces.values()) - 10
    best: list[tuple[float, int]] = [(0.0, 0)]
    for e in range(1, n + 1):
        ways = [(best[s][0] + pieces[word[s:e]][1], -s) for s in range(max(0, e - model.reach), e) if word[s:e] in pieces]
        if word[e - 1] not in pieces:
            ways.append((best[e - 1][0] + lowest, 1 - e))
        best.append(max(ways))
    parts, e = [], n
    while e:
        parts.append(word[-best[e][1] : e])
        e = -best[e][1]
    ids = []
    for part in reversed(parts):
        if found := pieces.get(part):
            ids.append(found[0])
        elif model.byte_ids:
            ids += [model.byte_ids[b] for b in part.encode()]
        else:
            ids.append(model.unknown)
    return ids


@lru_cache(maxsize=2)
def merges(name: str) -> Merges:
    """The edges of a BPE model, kept for the later tasks of the same worker."""
    model = load(name)
    return Merges(model.pieces, len(model.names), model.byte_ids, model.unknown)


def encode_words(words: DataFrame, name: str = "piece_bpe_32k.model") -> DataFrame:
    """(word, ids) of distinct words of LONGEST characters at most, blanks written as U+2581."""
    spark = words.sparkSession
    model = load(name)
    # as many rows as the vocabulary has pieces
    table = spark.createDataFrame([(p, i, s) for p, (i, s) in model.pieces.items()], "piece string, id int, score double")
    distinct = words.select(F.col(words.columns[0]).alias("word")).distinct()
    n = F.length("word")
    starts = distinct.select("word", F.explode(F.sequence(F.lit(0), n - 1)).alias("s"))
    spans = starts.select("word", "s", F.explode(F.sequence(F.col("s") + 1, F.least(n, F.col("s") + model.reach))).alias("e"))
    parts = spans.select("word", "s", "e", F.substring("word", F.col("s") + 1, F.col("e") - F.col("s")).alias("piece"))
    edges = parts.join(F.broadcast(table), "piece", "left").where("id is not null or e = s + 1")
    if model.byte_ids:
        code = F.hex(F.encode("piece", "utf-8"))
        unknown = F.transform(
            F.sequence(F.lit(0), F.octet_length("piece") - 1), lambda i: F.lit(model.byte_ids[0]) + F.conv(F.substring(code, 2 * i + 1, F.lit(2)), 16, 10).cast("int")
        )
    else:
        unknown = F.array(F.lit(model.unknown))
    ids = F.when(F.col("id").isNull(), unknown).otherwise(F.array("id"))
    lowest = min(s for _, s in model.pieces.values()) - 10
    edge = F.struct((-F.coalesce("score", F.lit(lowest))).alias("cost"), "s", "e", ids.alias("ids"))
    lattice = edges.groupBy("word").agg(F.array_sort(F.collect_list(edge)).alias("edges"))

    def bit(i: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), i)

    def inner(edge: Column) -> Column:
        return (bit(edge["e"]) - 1).bitwiseAND(F.bitwise_not(bit(edge["s"] + 1) - 1))

    def stands(bounds: Column, edge: Column) -> Column:
        ends = bit(edge["s"]).bitwiseOR(bit(edge["e"]))
        return bounds.bitwiseAND(ends) == ends

    every = bit(n + 1) - 1
    if model.kind == "bpe":

        def join(bounds: Column, edge: Column) -> Column:
            fits = stands(bounds, edge) & (F.bit_count(bounds.bitwiseAND(inner(edge))) == 1)
            return F.when(fits, bounds.bitwiseAND(F.bitwise_not(inner(edge)))).otherwise(bounds)

        bounds = F.aggregate("edges", every, join)
    else:
        # best[e]: score of the best path to place e and the bits of its boundaries
        start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("back"), F.lit(1).cast("long").alias("bits")))

        def reach(best: Column, e: Column) -> Column:
            ways = F.transform(
                F.filter("edges", lambda x: x["e"] == e),
                lambda x: F.struct((F.get(best, x["s"])["score"] - x["cost"]).alias("score"), (-x["s"]).alias("back"), F.get(best, x["s"])["bits"].bitwiseOR(bit(e)).alias("bits")),
            )
            return F.concat(best, F.array(F.array_max(ways)))

        bounds = F.aggregate(F.sequence(F.lit(1), n), start, reach, lambda best: F.get(best, n)["bits"])
    kept = F.filter("edges", lambda x: stands(F.col("bounds"), x) & (F.col("bounds").bitwiseAND(inner(x)) == 0))
    ordered = F.array_sort(F.transform(kept, lambda x: F.struct(x["s"].alias("s"), x["ids"].alias("ids"))))
    return lattice.withColumn("bounds", bounds).select("word", F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))


def _chunks(text: str) -> list[str]:
    """The text cut before each run of blanks, a U+2581 for each blank and one in front, as the library reads it."""
    return re.findall(WORDS, BLANK + text.replace(" ", BLANK)) if text else []


def id_type(model: Model) -> np.dtype:
    """The integers that ids are held as."""
    return np.dtype("<u2" if len(model.names) <= 1 << 16 else "<u4")


def _runs(column) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """Runs of the texts of an Arrow column: how many chunks each text has, and of all chunks one after the other
    the place in the list of distinct ones, and that list."""
    import pyarrow as pa
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // RUN
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(column)]
    for a, b in zip(edges, edges[1:], strict=False):
        texts = column.slice(a, b - a)
        odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, BLANK)), pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")))
        marked = pc.binary_join_element_wise("", pc.replace_substring(texts, " ", f" {BLANK}"), BLANK)
        marked = pc.if_else(pc.equal(texts, ""), pa.scalar(None, marked.type), marked)
        if pc.any(odd).as_py():  # several blanks in a row belong to one chunk
            places = odd.to_numpy(zero_copy_only=False)
            own = pa.array([" ".join(_chunks(t)) for t in texts.filter(odd).to_pylist()], marked.type)
            marked = pc.replace_with_mask(marked, pa.array(places), own)
        lists = pc.split_pattern(marked, " ")
        coded = lists.flatten().dictionary_encode()
        counts = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)
        yield counts, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_numpy(zero_copy_only=False).tolist()


class PieceIds(dict):
    """Words and chunks of words to their packed ids: the frequent words, which are given, and others until it
    is full. Only distinct chunks are looked at one by one."""

    def __init__(self, name: str, head: dict[str, bytes]):
        super().__init__(head)
        self.name, self.model, self.head = name, load(name), head
        self.dtype = id_type(self.model)
        self.find = re.compile(self.model.pattern).findall

    def _fold(self, words: list[str]) -> list[bytes]:
        if self.model.kind == "bpe":
            return merges(self.name).fold(words, self.dtype)
        return [np.array(best_path(w, self.model), self.dtype).tobytes() for w in words]

    def learn(self, chunks: list[str]) -> None:
        """Adds chunks by their words, which are found in one go: only a chunk's first word has a blank, or all of it is blanks."""
        blanks = [c for c in chunks if not c.strip(BLANK)]
        chunks = [c for c in chunks if c.strip(BLANK)] if blanks else chunks
        words = self.find("".join(chunks))
        new = list({w for w in [*words, *blanks] if w not in self})
        self.update(zip(new, self._fold(new), strict=True))
        firsts = [i for i, w in enumerate(words) if w[0] == BLANK]
        for chunk, a, b in zip(chunks, firsts, [*firsts, len(words)][1:], strict=True):
            if b > a + 1:
                self[chunk] = b"".join(map(self.__getitem__, words[a:b]))

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of an Arrow column, one after the other, and where each text's end, with 0 in front."""
        flat, sizes = [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)]
        for counts, places, distinct in _runs(column):
            if len(self) > len(self.head) + HELD:
                self.clear()
                self.update(self.head)
            self.learn([c for c in distinct if c not in self])
            own = list(map(self.__getitem__, distinct))
            n = np.fromiter(map(len, own), np.int64, len(own)) // self.dtype.itemsize
            starts, held = np.cumsum(n) - n, np.frombuffer(b"".join(own), self.dtype)
            n, starts = n[places], starts[places]
            ends = np.cumsum(n)
            flat.append(held[np.repeat(starts - (ends - n), n) + np.arange(n.sum())])
            sizes.append(np.diff(np.append(0, ends)[np.append(0, np.cumsum(counts))]))
        return np.concatenate(flat), np.cumsum(np.append(0, np.concatenate(sizes)))


def word_counts(texts: DataFrame, name: str, least: int) -> DataFrame:
    """(word, n) of the words with at least so many occurrences in a table of one text column."""

    def count(batches):
        import pyarrow as pa

        find = re.compile(load(name).pattern).findall
        held: Counter[str] = Counter()

        def words():
            total: Counter[str] = Counter()
            for chunk, n in held.items():
                for word in find(chunk):
                    if len(word) <= LONGEST:
                        total[word] += n
            held.clear()
            return pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for _, places, distinct in _runs(batch.column(0)):
                held.update(dict(zip(distinct, np.bincount(places, minlength=len(distinct)).tolist(), strict=True)))
                if len(held) > 2 * HELD:
                    yield words()
        yield words()

    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def frequent(texts: DataFrame, name: str, most: int) -> DataFrame:
    """(word, ids) of the most frequent words, no more than `most`, by their lattices."""
    counts = stored(word_counts(texts, name, 4), "word-counts")
    level = F.least(F.floor(F.log2("n") * 16).cast("int"), F.lit(1024))
    left, threshold = most, 1 << 20
    for row in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # 1,024 rows at most
        left -= row["count"]
        if left < 0:
            break
        threshold = row["level"]
    words = counts.where(level >= threshold).select("word")
    return encode_words(words.repartition(texts.sparkSession.sparkContext.defaultParallelism, "word"), name)


def packed(words: DataFrame, kind: np.dtype) -> dict[str, bytes]:
    """A bounded table (word, ids) on the driver, ids packed."""
    table = words.toArrow()
    names, lists = table.column(0).to_pylist(), table.column(1).combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(kind).tobytes()
    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)) * kind.itemsize
    return {w: flat[a:b] for w, a, b in zip(names, [0, *ends.tolist()[:-1]], ends.tolist(), strict=True)} if names else {}


def encode(docs: DataFrame, name: str = "piece_bpe_32k.model", most: int = 100_000, text_col: str = "text") -> DataFrame:
    """docs with `ids`, the pieces of the whole text without added special tokens.

    most: frequent words that are encoded once for all tasks.
    """
    own = [c for c in docs.columns if c != "ids"]
    texts = docs.select(text_column(docs, text_col))
    head = packed(frequent(texts, name, most), id_type(load(name)))  # `most` rows at most
    sent = docs.sparkSession.sparkContext.broadcast(head)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), text_column(docs, text_col))

    def run(batches):
        import pyarrow as pa

        memo = PieceIds(name, sent.value)
        for batch in batches:
            flat, ends = memo.encode(batch.column(1))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int32)))
            yield pa.record_batch([batch.column(0), ids], names=["row", "ids"])

    schema = rows.select("row", F.array().cast("array<int>").alias("ids")).schema
    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col("row").getField(c).alias(c) for c in own], "ids")


def decoded(ids: Column, name: str = "piece_bpe_32k.model") -> Column:
    """The text that an array of ids stands for.

    The table of pieces is one constant of hexadecimal bytes, since a byte piece is no text by itself.
    """
    model = load(name)
    parts = [p.replace(BLANK, " ").encode() for p in model.names]
    for value, i in enumerate(model.byte_ids):
        parts[i] = bytes([value])
    parts[model.unknown] = " ⁇ ".encode()
    table = F.split(F.lit(",".join(p.hex() for p in parts)), ",")
    text = F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i)), "")).cast("string")
    return F.when(F.startswith(text, F.lit(" ")), F.substring(text, 2, F.length(text))).otherwise(text)


def decode(encoded: DataFrame, name: str = "piece_bpe_32k.model", into: str = "decoded") -> DataFrame:
    """encoded (with `ids`) with the text that the ids stand for in column `into`."""
    return encoded.withColumn(into, decoded(F.col("ids"), name))


def piece_table(spark: SparkSession, name: str = "piece_bpe_32k.model") -> DataFrame:
    """(id, piece) of a model's whole vocabulary."""
    return spark.createDataFrame(list(enumerate(load(name).names)), "id int, piece string")
