"""Token counts through a digest cache.

The cache is a table of (tokenizer, digest, n_tokens), each of whose files is of one tokenizer, so that files of others are
passed over by their statistics: digest is the SHA-256 of the normalised content, tokenizer that of the
tokenizer's file, so another version misses. Texts meet the cache as
digests only; one row of each missing digest is sent to the library and its count appended. Few misses, in number and of the
rows, are sent to where the texts are, so that over a warm cache no text moves; many are met by dealing the texts by
digest and id, which never gathers a digest's rows. A cold cache is met that way at any size, so that what a run writes to disk
is in proportion to its texts.

Defined results: a null text counts as empty, with 0 bytes and 0 tokens; equal texts share one
entry whatever their ids, null ids included; texts of any length are counted whole; repeated rows stay
repeated; an empty table gives an empty result and appends nothing. Only id, digest, n_bytes and n_tokens are
returned, so that no further column can clash.
"""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facelake.llm.common import stored, text_column

#: A digest with more than this share of the rows is joined by itself.
HOT_SHARE = 1000
#: Misses up to this number (16 MB), and up to this share of the rows, are broadcast.
FEW_MISSES = 100_000
FEW_SHARE = 10
CACHE_SCHEMA = "tokenizer string, digest string, n_tokens long"


def tokenizer_path(name: str) -> str:
    """Where the node that runs this keeps a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _counter(name: str):
    """A function from a text to its number of tokens."""
    from facelake.llm.word_memo import PieceCounts

    path = tokenizer_path(name)
    if name.endswith(".model"):
        import sentencepiece

        return PieceCounts(sentencepiece.SentencePieceProcessor(model_file=path)).count
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache table, empty where nothing has been appended yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def token_counts(
    docs: DataFrame, cache: str, tokenizer: str = "piece_bpe_32k.model", normalise=None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, digest, n_bytes, n_tokens) of each row, after appending what the cache lacked.

    cache: path of the cache table; a run that is lost before its append leaves the cache as it was.
    normalise: a function of the text's column, applied before digest and encoding (default: none).
    """
    spark = docs.sparkSession
    version = hashlib.sha256(Path(tokenizer_path(tokenizer)).read_bytes()).hexdigest()
    text = text_column(docs, text_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), (normalise(text) if normalise else text).alias("text"))
    rows = rows.withColumn("digest", F.sha2("text", 256))
    keys = stored(rows.select("id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    known = read_cache(spark, cache).where(F.col("tokenizer") == version).select("digest", "n_tokens")
    sizes = keys.groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    misses = stored(sizes.select("digest", "id").join(known, "digest", "left_anti"), "misses")
    n_rows, way = keys.count(), "shuffle_hash"
    if misses.count() <= min(FEW_MISSES, n_rows / FEW_SHARE):
        way = "broadcast"
    texts = rows.alias("r").join(
        misses.alias("m").hint(way), (F.col("r.digest") == F.col("m.digest")) & F.col("r.id").eqNullSafe(F.col("m.id")), "left_semi"
    )

    def encode(batches):
        import pyarrow as pa

        count = _counter(tokenizer)
        for batch in batches:
            n = [count(t) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    fresh = texts.select("digest", "text").mapInArrow(encode, "digest string, n_tokens long").dropDuplicates(["digest"])
    fresh.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    counts = read_cache(spark, cache).where(F.col("tokenizer") == version).dropDuplicates(["digest"])
    counts = counts.select("digest", "n_tokens")
    # digests of more than a thousandth of all rows, of which there are no more than a thousand, stay where they are
    hot = sizes.where(F.col("n") > n_rows / HOT_SHARE).join(counts, "digest").select("digest", F.col("n_tokens").alias("hot"))
    marked = keys.join(F.broadcast(stored(hot, "hot-digests")), "digest", "left")
    columns = ("id", "digest", "n_bytes", "n_tokens")
    apart = marked.where("hot is not null").withColumnRenamed("hot", "n_tokens").select(*columns)
    return marked.where("hot is null").join(counts, "digest", "left").select(*columns).unionByName(apart)
