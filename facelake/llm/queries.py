"""One query for each operator: production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facelake.llm.common import scratch, table
from facelake.llm.rules import BLOCKED, RULES


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from facelake.llm import quality

    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), rounds=2, sure=0.99)
    return quality.classify(docs, model, threshold=0.6).select("doc_id", "p_text", "p_meta", "p_bad", F.col("keep").alias("kept"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from facelake.llm import spm_lattice

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = spm_lattice.decode(spm_lattice.encode(docs, "piece_bpe_32k.model"), "piece_bpe_32k.model")
    text = F.replace(F.coalesce("text", F.lit("")), F.lit(spm_lattice.BLANK), F.lit(" "))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == text).alias("round_trip"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from facelake.llm.token_counts import token_counts

    counts = token_counts(table(spark, sf_dir, "documents"), scratch(spark, "token-cache"), "piece_bpe_32k.model")
    return counts.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from facelake.llm.decontaminate import find_windows

    found = find_windows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    n_hit = F.aggregate(
        F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y
    )
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("starts") > 0).alias("contaminated"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from facelake.llm.line_dedup import dedup_lines

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, min_chars=20, max_edits=2).select("doc_id", "text", "n_lines", "n_removed")


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from facelake.llm import rules

    entries = rules.with_ablations(rules.apply_policy(rules.ledger(table(spark, sf_dir, "documents")), version=2), version=2)
    return entries.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        rules.fails(("few_words", "repeated_windows")).alias("base_failed"), "kept", "failed", "policy",
        "only_rule", "kept_without",
    )


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from facelake.llm import pii

    found = pii.find_personal_data(table(spark, sf_dir, "documents"), threshold=0.95, min_support=2)
    return found.select(
        F.col("id").alias("doc_id"),
        *[pii.count_kind(F.col("base"), kind).alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(pii.label(F.col("base")), 256).alias("base_sha256"),
        pii.label(F.col("spans")).alias("spans"),
        pii.count_kind(F.col("spans"), "term").alias("n_term"),
        F.when(F.size("spans") > 0, pii.sanitise(F.col("text"), F.col("spans"))).alias("sanitised"),
    )


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from facelake.llm.token_files import read_tokens, write_tokens

    folder = scratch(spark, "token-files")
    manifest = write_tokens(table(spark, sf_dir, "documents"), folder, "word_bpe_49k.json", end_id=1)
    return read_tokens(manifest, folder).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from facelake.llm import simhash

    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, max_distance=2)
    return found.select(
        F.col("id").alias("doc_id"), simhash.hex64("fp").alias("fingerprint"), F.col("component").alias("component_id")
    )


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from facelake.llm.html_extract import extract

    texts = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return texts.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from facelake.llm import centroids

    found = centroids.cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10, dim=64, scale=1024, seed="3")
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from facelake.llm import whitening

    found = whitening.whiten(table(spark, sf_dir, "embeddings"), k=8, scale=1024, shift=100_000)
    return found.select(F.col("id").alias("vec_id"), "component", "n", "deviation", "whitened", "explained", "identity_error")


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from facelake.llm import cuckoo

    found = cuckoo.deduplicate(table(spark, sf_dir, "documents"), scratch(spark, "digest-index"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


QUERIES = {
    "op1_quality": op1_quality,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_token_counts": op3_token_counts,
    "op4_decontaminate": op4_decontaminate,
    "op5_line_dedup": op5_line_dedup,
    "op6_rules": op6_rules,
    "op7_personal_data": op7_personal_data,
    "op8_token_files": op8_token_files,
    "op9_simhash": op9_simhash,
    "op10_html_text": op10_html_text,
    "op11_centroids": op11_centroids,
    "op12_whitening": op12_whitening,
    "op13_exact_dedup": op13_exact_dedup,
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BENCH_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_BITS = " + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, rule in enumerate(RULES.values()))
_ONLY = " ".join(f"WHEN {1 << i} THEN '{rule}'" for i, rule in enumerate(RULES))
ORACLE_SQL: dict[str, str] = {
    "op4_decontaminate": rf"""
    WITH d AS (SELECT doc_id, {BENCH_WORDS} AS w FROM documents),
    b AS (SELECT item_id::varchar AS item, {BENCH_WORDS} AS w FROM benchmark),
    windows AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM
        (SELECT item, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
    grams AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM
        (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)),
    hits AS (SELECT doc_id, item, k, i FROM grams JOIN windows USING (k, g)),
    places AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS place FROM hits) GROUP BY doc_id),
    items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
    SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
        sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op13_exact_dedup": r"""
    WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
    SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
        row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
    FROM d WINDOW same AS (PARTITION BY text_sha256)""",
    "op6_rules": rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
    windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM
        (SELECT doc_id, i, w[i:i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d))),
    inside AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS place FROM windows WHERE n > 1) GROUP BY doc_id),
    m AS (SELECT doc_id, len(w)::bigint AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint AS n_symbols, len(lines)::bigint AS n_lines,
        (len(lines) - len(list_distinct(lines)))::bigint AS n_dup_lines, coalesce(inside.n, 0)::bigint AS n_repeat_words,
        length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
        length(regexp_replace(text, '[^!-@\x5B-\x60\x7B-\x7E]', '', 'g')) AS n_marks,
        len(list_filter(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z]+'), lambda x: x IN ({", ".join(f"'{x}'" for x in sorted(BLOCKED))}))) AS n_blocked
        FROM d LEFT JOIN inside USING (doc_id)),
    f AS (SELECT *, ({_BITS})::bigint AS failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
        failed = 0 AS kept, failed, 2 AS policy, CASE failed {_ONLY} ELSE '' END AS only_rule,
        (count(*) FILTER (WHERE failed = 0) OVER () + CASE WHEN bit_count(failed) = 1 THEN count(*) OVER (PARTITION BY failed) ELSE 0 END)::bigint AS kept_without FROM f""",
}
