"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document, in the order of RULES; the ledger stores the
measurements and one bit for each rule that failed. Policies are versioned sets of rules: applying
one, comparing versions and ablating rules are bitwise operations on the stored bits and never look
at a text again.

Words are runs of characters other than ASCII white space. Defined results: null, empty and blank
texts have no words and fail `few_words`; texts of any length are measured whole; equal lines count as
repeated from the second on; repeated rows stay repeated; an empty table gives an empty ledger. Ratios of a
text without words are 0. Other columns than id and text are not read, so that none can clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facelake.llm.common import stored, text_column

SYMBOLS = b"#*$%&|<>"
#: English insults, the default of `ledger`'s blocked terms.
BLOCKED = frozenset("idiot idiots stupid moron morons loser losers worthless pathetic scum trash disgusting clown".split())
LONG = 1000

#: The rules in the order of their bits, each with the condition under which a document fails it.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "duplicate_lines": "n_lines >= 4 and 10 * n_dup_lines > 3 * n_lines",
    "word_length": "n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words)",
    "shouting": "n_letters >= 100 and 10 * n_upper > 5 * n_letters",
    "few_letters": "word_chars >= 100 and 10 * (word_chars - n_marks) < 6 * word_chars",
    "blocked_terms": "n_blocked >= 3 or (n_blocked >= 2 and 100 * n_blocked > n_words)",
}
#: Sets of rules by version; versions are never changed, only added.
POLICIES: dict[int, tuple[str, ...]] = {
    1: ("few_words", "repeated_windows"),
    2: tuple(RULES),
}
MEASURES = "n_words n_chars word_chars n_symbols n_lines n_dup_lines n_repeat_words n_letters n_upper n_marks n_blocked".split()

_LETTERS = bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122))
_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_MARKS = bytes(b for b in range(256) if not (33 <= b <= 47 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 126 or 48 <= b <= 57))
_SPACE = b" \t\n\v\f\r"
_CONTINUED = bytes(b for b in range(256) if not 128 <= b <= 191)


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words inside windows of so many words that occur twice or more."""
    windows = list(zip(*(words[i:] for i in range(width)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen: dict[tuple[bytes, ...], int] = {}
    number = np.fromiter((seen.setdefault(w, len(seen)) for w in windows), np.int64, len(windows))
    twice = np.bincount(number)[number] > 1
    inside = np.zeros(len(words), bool)
    for i in range(width):
        inside[i : i + len(windows)] |= twice
    return int(inside.sum())


def term_pattern(terms: Iterable[str]) -> re.Pattern[bytes]:
    """Finds terms as whole runs of ASCII letters, whatever their case; no terms, no finds."""
    return re.compile(rb"(?<![a-z])(?:" + "|".join(map(re.escape, sorted(terms))).encode() + rb")(?![a-z])" if terms else rb"(?!)", re.I)


def measure(text: bytes, blocked: re.Pattern[bytes]) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    n_chars = len(text) - len(text.translate(None, _CONTINUED))
    visible = text.translate(None, _SPACE)
    return (
        len(words),
        n_chars,
        len(visible) - len(visible.translate(None, _CONTINUED)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(text.translate(None, _LETTERS)),
        len(text.translate(None, _UPPER)),
        len(text.translate(None, _MARKS)),
        sum(1 for _ in blocked.finditer(text)),
    )


def ledger(docs: DataFrame, blocked: Iterable[str] = BLOCKED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, one column for each measurement, failed): bit i of failed is set if rule i fails.

    It is written once; policies and ablations read it from there. blocked: the terms that n_blocked counts.
    """
    blocked = frozenset(blocked)

    def compute(batches):
        import pyarrow as pa

        from facelake.llm.common import raw_bytes

        pattern = term_pattern(blocked)
        for batch in batches:
            flat = np.fromiter(chain.from_iterable(measure(t, pattern) for t in raw_bytes(batch.column(1))), np.int64)
            table = flat.reshape(-1, len(MEASURES))
            yield pa.record_batch([batch.column(0), *(pa.array(table[:, i]) for i in range(len(MEASURES)))], names=["id", *MEASURES])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_column(docs, text_col))
    measured = rows.mapInArrow(compute, "id long, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, rule in enumerate(RULES.values())]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return stored(measured.withColumn("failed", failed), "rule-ledger")


def mask(rules) -> int:
    """The bits of some rules."""
    return sum(1 << list(RULES).index(r) for r in rules)


def fails(rules) -> Column:
    """Whether a ledger's row fails one of the rules."""
    return F.col("failed").bitwiseAND(F.lit(mask(rules)).cast("long")) != 0


def apply_policy(entries: DataFrame, version: int = 2) -> DataFrame:
    """The ledger with `kept` and the version that decided it."""
    return entries.withColumn("policy", F.lit(version)).withColumn("kept", ~fails(POLICIES[version]))


def only_rule(version: int = 2) -> Column:
    """The rule of a policy that alone rejects a ledger's row, the empty string where none or several do."""
    bits = F.col("failed").bitwiseAND(F.lit(mask(POLICIES[version])).cast("long"))
    return F.coalesce(*[F.when(bits == F.lit(mask([r])).cast("long"), F.lit(r)) for r in POLICIES[version]], F.lit(""))


def with_ablations(entries: DataFrame, version: int = 2) -> DataFrame:
    """The ledger with `only_rule` and `kept_without`: how many documents the policy keeps once that rule is dropped, or as it is."""
    without = ablations(entries, version).select(F.col("rule").alias("only_rule"), F.col("n_kept_without").alias("kept_without"))
    as_it_is = entries.agg(F.count_if(~fails(POLICIES[version])).alias("kept_without")).select(F.lit("").alias("only_rule"), "kept_without")
    without = without.unionByName(as_it_is)
    return entries.withColumn("only_rule", only_rule(version)).join(F.broadcast(without), "only_rule", "left")  # a row for each rule


def ablations(entries: DataFrame, version: int = 2) -> DataFrame:
    """(rule, n_failed, n_only, n_kept_without) for each rule of a policy.

    n_only: documents that no other rule of the policy rejects, so that dropping the rule keeps them.
    Rows are folded to the distinct patterns of bits first, of which there are 2**len(RULES) at most.
    """
    policy = mask(POLICIES[version])
    active = F.col("failed").bitwiseAND(F.lit(policy).cast("long")).alias("bits")
    patterns = entries.groupBy(active).agg(F.count("*").alias("n"))
    each = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask([r])).cast("long").alias("bit")) for r in POLICIES[version]])
    rows = patterns.select("bits", "n", F.explode(each).alias("r"))
    hit, rest = F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("bits").bitwiseAND(F.bitwise_not("r.bit"))
    return rows.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(hit & (rest == 0), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(rest == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )
