"""Near copies by exact similarity of word-shingle sets; SimHash and MinHash only name who to compare.

Texts of equal shingle sets are one class from the start. The Gray-order index of `simhash` names the classes
whose SimHashes differ in few bits. A pair at Jaccard 0.8 differs in about ten of 64 bits, too many for any
index of them, so the minima of a set under fixed mixtures of its shingles' hashes are dealt in bands as well:
classes that share a band of minima are candidates too, and a pair at Jaccard j stays unseen by them with
probability (1 - j**ROWS)**BANDS: 0.000015 at 0.8. Candidates and their candidates make a family. The sets of
a family meet once in a task, and a link is a pair whose exact similarity suffices; a family too large for a
task is dealt as pairs of its blocks. Links join rows to components, of which the row of the smallest doc_id
stays.

Defined results: texts without words have equal (empty) sets; texts of any length are compared whole; rows
without doc_id come after all others of their component, and of rows of one doc_id a first one stays; repeated
rows are copies of each other; an empty table gives an empty result.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facelake.llm import simhash
from facelake.llm.common import LOWER, raw_bytes, stored
from facelake.llm.graph import components

#: Minima in a band, and bands.
ROWS, BANDS = 5, 28
#: Bits in which SimHashes of candidates differ at most.
BITS = 3
#: Shingles of a family that meet in a task at most.
FAMILY = 250_000
#: Odd multipliers.
MIXERS = np.random.Generator(np.random.PCG64(42)).integers(1 << 63, size=ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, width: int) -> np.ndarray:
    """The text's set of word shingles as sorted XXH64 values."""
    from xxhash import xxh64_intdigest

    words = text.translate(LOWER).split()
    if len(words) <= width:
        found = [b" ".join(words)] if words else []
    else:
        found = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return np.unique(np.fromiter((xxh64_intdigest(s, 42) for s in found), np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """One signed long for each band of minima, none for an empty set."""
    from xxhash import xxh64_intdigest

    if not len(hashes):
        return []
    least = np.full(len(MIXERS), ~np.uint64(0))
    for at in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[at : at + 1024, None] * MIXERS).min(axis=0), out=least)
    return np.array([xxh64_intdigest(least[k : k + ROWS].tobytes(), k) for k in range(0, len(least), ROWS)], np.uint64).view(np.int64).tolist()


def sketched(docs: DataFrame, width: int) -> DataFrame:
    """docs with `row`, a key of each row, `digest` and `n` of its shingle set, `bands` and the SimHash `fp`; written once."""

    def compute(batches):
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        for batch in batches:
            texts = raw_bytes(batch.column(batch.schema.names.index("text")))
            sets = [shingles(t or b"", width) for t in texts]
            new = [
                pa.array([xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([bands(s) for s in sets], pa.list_(pa.int64())),
                pa.array(np.array([simhash.majority(s) for s in sets], np.uint64).view(np.int64)),
            ]
            yield pa.record_batch([*batch.columns, *new], names=[*batch.schema.names, "digest", "n", "bands", "fp"])

    rows = docs.withColumn("row", F.monotonically_increasing_id())
    schema = rows.select("*", F.lit(b"").alias("digest"), F.lit(0).cast("long").alias("n"), F.array(F.lit(0).cast("long")).alias("bands"), F.lit(0).cast("long").alias("fp")).schema
    return stored(rows.mapInArrow(compute, schema), "sketched")


def stars(ids: np.ndarray, sets: list[np.ndarray], similarity: Fraction):
    """(member, smallest id) of each set of items that a chain of pairs at that similarity joins."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    unseen = np.ones(len(sets), bool)
    indexed = 0
    for first in range(len(sets)):
        if not unseen[first]:
            continue
        unseen[first] = False
        joined, at = [first], 0
        while at < len(joined):
            left = int(unseen.sum())
            if not left:
                break
            if not indexed or 2 * left < indexed:  # an index over what is left
                indexed, those = left, np.flatnonzero(unseen)
                owner = np.repeat(those, size[those])
                flat = np.concatenate([sets[i] for i in those])
                order = np.argsort(flat, kind="stable")
                owner, flat = owner[order], flat[order]
                starts = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
                values, ends = flat[starts], np.append(starts[1:], len(flat))
            i, at = joined[at], at + 1
            place = np.minimum(np.searchsorted(values, sets[i]), len(values) - 1)
            place = place[values[place] == sets[i]]
            n = ends[place] - starts[place]
            of = np.repeat(starts[place] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            shared = np.bincount(owner[of], minlength=len(sets))
            near = unseen & (shared * similarity.denominator >= (size[i] + size - shared) * similarity.numerator)
            unseen &= ~near
            joined.extend(np.flatnonzero(near).tolist())
        if len(joined) > 1:
            members = ids[joined]
            yield members[members != members.min()], members.min()


def _verified(batches, width: int, similarity: Fraction):
    """Stars (src, dst) from rows (key, row, text) that are sorted by key."""
    import pyarrow as pa

    def linked(ids, sets):
        for members, root in stars(np.array(ids, np.int64), sets, similarity):
            yield pa.record_batch([pa.array(members), pa.array(np.full(len(members), root))], names=["src", "dst"])

    now, ids, sets = None, [], []
    for batch in batches:
        for key, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw_bytes(batch.column(2)), strict=True):
            if key != now:
                yield from linked(ids, sets)
                now, ids, sets = key, [], []
            ids.append(row)
            sets.append(shingles(text or b"", width))
    yield from linked(ids, sets)


def alike(prints: DataFrame) -> DataFrame:
    """(src, dst) stars of the rows (row, fp) whose SimHashes differ in BITS bits at most."""
    prints = stored(prints, "prints")
    first = stored(prints.groupBy("fp").agg(F.min("row").alias("id")), "distinct-prints")
    same = prints.join(first, "fp").where("row <> id").select(F.col("row").alias("src"), F.col("id").alias("dst"))
    return same.unionByName(simhash.links(first.select("fp", "id"), BITS, first.count()))


def links(rows: DataFrame, reps: DataFrame, width: int, similarity: Fraction) -> DataFrame:
    """(src, dst) row keys of classes, of which reps has one row key each: stars of the verified links."""
    keyed = stored(rows.select("row", "bands").join(reps.select("row"), "row", "left_semi").select("row", F.explode("bands").alias("band")), "bands")
    first = keyed.groupBy("band").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    edges = keyed.join(first, "band").where("row <> first").select(F.col("row").alias("src"), F.col("first").alias("dst"))
    edges = edges.unionByName(alike(rows.select("row", "fp").join(reps.select("row"), "row", "left_semi")))
    families = stored(components(edges).withColumnRenamed("node", "row"), "families")
    weights = families.join(rows.select("row", "n"), "row").groupBy("root").agg(F.sum("n").alias("n"))
    parts = families.join(weights.select("root", F.ceil(F.col("n") / FAMILY).cast("int").alias("k")), "root")
    # each block of a family meets itself and every other block
    own = F.pmod(F.xxhash64("row"), "k")
    pairs = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.xxhash64("root", F.least(own, j), F.greatest(own, j)))
    dealt = rows.select("row", "text").join(parts.select("row", F.explode(pairs).alias("key")), "row").select("key", "row", "text")
    dealt = dealt.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(lambda batches: _verified(batches, width, similarity), "src long, dst long")


def near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """docs with a key `row` (and further columns), and the keys of those that go: all but one row of a component.

    width: words in a shingle. similarity: Jaccard of two texts' shingle sets that links them.
    """
    rows = sketched(docs, width)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least")
    reps = stored(rows.groupBy("digest").agg(least, F.count("*").alias("n")).withColumn("row", F.col("least.row")), "classes")
    joined = components(links(rows, reps, width, Fraction(str(similarity))))
    rooted = stored(reps.join(joined, F.col("row") == F.col("node"), "left").select("digest", "least", "n", "root"), "rooted")
    kept = rooted.where("root is not null").groupBy("root").agg(F.min("least").alias("kept"))
    # classes of several rows or with a link; all others stay whole
    several = rooted.where("n > 1 or root is not null").join(kept, "root", "left").select("digest", F.coalesce("kept.row", "least.row").alias("kept"))
    gone = rows.select("row", "digest").join(several, "digest").where("row <> kept").select("row")
    return rows, stored(gone, "near-copies")
