"""A corpus pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with the columns of
documents; the last returns them with their pieces. `run` writes each stage's documents and reads
them back for the next.

1. quality: documents that the co-trained classifier takes for bad go.
2. lines: lines that an earlier document has, exactly or within two edits, go; so do documents of
   which nothing is left.
3. near_duplicates: of documents linked by five-word shingles at Jaccard 0.8 or more, exactly compared,
   one stays, that of the smallest doc_id; MinHash fingerprints find the pairs to compare.
4. decontamination: documents with a benchmark window go.
5. pieces: `ids` are added, and documents that the ids don't give back go.

Columns besides those of documents are dropped by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facelake.llm import decontaminate, line_dedup, near_copies, quality, spm_lattice
from facelake.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    model = quality.train(docs, table(spark, sf_dir, "labels"), rounds=2, sure=0.99)
    return quality.classify(docs, model, threshold=0.6).where("keep").select(*COLUMNS)


def by_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = line_dedup.dedup_lines(docs, min_chars=20, max_edits=2)
    left = left.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", n_chars).select(*COLUMNS)


def by_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, gone = near_copies.near_copies(docs.select(*COLUMNS), width=5, similarity=0.8)
    return rows.join(gone, "row", "left_anti").select(*COLUMNS)


def by_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keep = [F.col(c) for c in COLUMNS]
    found = decontaminate.find_windows(docs.select(*keep), table(spark, sf_dir, "benchmark"), window=10, carry=COLUMNS)
    return found.where(F.size("starts") == 0).select("row.*").select(*COLUMNS)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    both = spm_lattice.decode(spm_lattice.encode(docs, "piece_bpe_32k.model"), "piece_bpe_32k.model")
    text = F.replace(F.coalesce("text", F.lit("")), F.lit(spm_lattice.BLANK), F.lit(" "))
    return both.where(F.col("decoded") == text).select(*COLUMNS, F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", by_quality),
    ("lines", by_lines),
    ("near_duplicates", by_near_duplicates),
    ("decontamination", by_benchmark),
    ("pieces", to_pieces),
]
#: No stage but the fourth can be said in SQL over whole tables; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
