"""Near-duplicate detection by SimHash over word shingles, with a Gray-order hierarchical index.

Fingerprints are computed from whole texts, equal ones are folded before anything is compared, and
the distinct ones meet only where whole blocks of bits agree: of `max_distance + s` blocks, any two
fingerprints at that distance or less share at least s. Inside such a group the fingerprints are
sorted by Gray rank, so that neighbours share most bits; runs of neighbours become the nodes of a
hierarchy that hold the bit patterns their members share, and two nodes are compared member by
member only while the differences accumulated on shared bits stay within the distance.

Each group gives back one star per set of linked fingerprints instead of all pairs, which keeps
every connection; connected components then run over those stars.

Defined results: a null or empty text has fingerprint zero and links like any other; texts of any length are
read whole; a bit that just half of the shingles have is not set; a row without doc_id gets its fingerprint
and the class of equal fingerprints of other rows, if any, else null; repeated rows stay repeated; an empty
table gives an empty result. Other columns than id and text are not read, so that none can clash.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facelake.llm.common import LOWER, raw_bytes, stored, text_column
from facelake.llm.graph import components

FANOUT = 4
#: Node pairs that are held at once while an index is walked.
FRONTIER = 1 << 20
#: Fingerprints that may meet in a group on average.
GROUP = 64
#: Groups above this many fingerprints are dealt out again by more of their bits.
LARGE_GROUP = 50_000


#: Odd multipliers that turn one hash into further ones.
MIXERS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)


def fingerprint(text: bytes, width: int, prints: int = 1) -> list[int]:
    """SimHashes of the text's word shingles as unsigned 64-bit integers, 0 where it has no word.

    The first is over the shingles' XXH64, the others over independent mixtures of it."""
    from xxhash import xxh64_intdigest

    words = text.translate(LOWER).split()
    if not words:
        return [0] * prints
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    hashes = np.fromiter((xxh64_intdigest(s, 42) for s in shingles), np.uint64)
    return [majority(hashes, k) for k in range(prints)]


def majority(hashes: np.ndarray, k: int = 0) -> int:
    """The bits that more than half of some hashes have, or of their mixtures by multiplier k - 1."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        if k:
            part = (part ^ (part >> np.uint64(31))) * MIXERS[k - 1]
            part = (part ^ (part >> np.uint64(29))) * MIXERS[k - 1]
            part ^= part >> np.uint64(32)
        bits = part.astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, prints: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fps): one row for each row of docs, fps as signed longs with the fingerprints' bits."""

    def compute(batches):
        import pyarrow as pa

        for batch in batches:
            fps = np.array([fingerprint(t, width, prints) for t in raw_bytes(batch.column(1))], np.uint64).reshape(-1).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * prints, pa.int32()), pa.array(fps, pa.int64()))
            yield pa.record_batch([batch.column(0), lists], names=["id", "fps"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_column(docs, text_col))
    return rows.mapInArrow(compute, "id long, fps array<long>")


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """The position of each 64-bit pattern in the reflected Gray code."""
    rank = fps.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Hierarchies over the groups of a sorted run of fingerprints; group and fps are equally long."""

    def __init__(self, group: np.ndarray, fps: np.ndarray):
        every = ~np.uint64(0)
        self.levels = [(fps, np.full(len(fps), every), None)]
        while len(group) > 1 and (group[1:] == group[:-1]).any():
            value, mask, _ = self.levels[-1]
            first = np.concatenate(([True], group[1:] != group[:-1]))
            ordinal = np.arange(len(group)) - np.flatnonzero(first)[np.cumsum(first) - 1]
            starts = np.flatnonzero(ordinal % FANOUT == 0)
            ends = np.append(starts[1:], len(group))
            differs = np.bitwise_or.reduceat(value ^ np.repeat(value[starts], ends - starts), starts)
            shared = np.bitwise_and.reduceat(mask, starts) & ~differs
            self.levels.append((value[starts], shared, (starts, ends)))
            group = group[starts]

    def pairs(self, distance: int):
        """Arrays (i, j), i < j, of the fingerprints of one group that differ in so many bits at most."""
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top][0]))
        todo = [(top, roots, roots, np.zeros(len(roots), np.int64))]
        while todo:
            level, a, b, so_far = todo.pop()
            if level == 0:
                apart = a != b
                if apart.any():
                    yield a[apart], b[apart]
                continue
            if len(a) > FRONTIER // FANOUT**2:
                half = len(a) // 2
                todo += [(level, a[half:], b[half:], so_far[half:]), (level, a[:half], b[:half], so_far[:half])]
                continue
            _, mask, (starts, ends) = self.levels[level]
            value, below, _ = self.levels[level - 1]
            n_a, n_b = ends[a] - starts[a], ends[b] - starts[b]
            n = n_a * n_b
            of = np.repeat(np.arange(len(a)), n)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            c, d = starts[a][of] + k // n_b[of], starts[b][of] + k % n_b[of]
            keep = c <= d
            of, c, d = of[keep], c[keep], d[keep]
            # bits that both parents share are counted already
            new = below[c] & below[d] & ~(mask[a] & mask[b])[of]
            acc = so_far[of] + np.bitwise_count((value[c] ^ value[d]) & new)
            keep = acc <= distance
            todo.append((level - 1, c[keep], d[keep], acc[keep]))


def smallest_reachable(n: int, pairs) -> np.ndarray:
    """For each of n items the smallest item that a chain of pairs leads to."""
    label = np.arange(n)
    for i, j in pairs:
        while True:
            low = np.minimum(label[i], label[j])
            if (label[i] == low).all() and (label[j] == low).all():
                break
            np.minimum.at(label, label[i], low)
            np.minimum.at(label, label[j], low)
            while (label[label] != label).any():
                label = label[label]
    return label


def _stars(batches, distance: int):
    """From rows (key, fp, id) that are sorted by key: (id, root) for each fingerprint with a link."""
    import pyarrow as pa

    def linked(key, fps, ids):
        order = np.lexsort((ids, gray_rank(fps), key))
        key, fps, ids = key[order], fps[order], ids[order]
        label = smallest_reachable(len(fps), GrayIndex(key, fps).pairs(distance))
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, label, ids)
        root = least[label]
        far = root != ids
        return pa.record_batch([pa.array(ids[far]), pa.array(root[far])], names=["src", "dst"])

    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        key, fps, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if not len(key):
            continue
        cut = int(np.searchsorted(key, key[-1]))
        if cut or (held and held[-1][0][-1] != key[-1]):
            held.append((key[:cut], fps[:cut], ids[:cut]))
            key0, fps0, ids0 = (np.concatenate(x) for x in zip(*held, strict=True))
            yield linked(key0, fps0.view(np.uint64), ids0)
            held = []
        held.append((key[cut:], fps[cut:], ids[cut:]))
    if held:
        key0, fps0, ids0 = (np.concatenate(x) for x in zip(*held, strict=True))
        yield linked(key0, fps0.view(np.uint64), ids0)


def _blocks(n: int) -> list[tuple[int, int]]:
    """(first bit, mask) of n nearly equal blocks of 64 bits."""
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, ((1 << (b - a)) - 1) << a) for a, b in zip(edges, edges[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(distinct: DataFrame, distance: int, n: int) -> DataFrame:
    """Stars (src, dst) over the ids of n distinct (id, fp) rows; their components are those of all links.

    Of distance + s blocks, s agree in any link. s is 2, or as large as it takes for a value of s blocks to
    have GROUP fingerprints on average at most: the index looks through a group at less cost than a larger
    s has in rows to deal.
    """
    s = next((s for s in range(2, 8) if 64 // (distance + s) * s > math.log2(max(n / GROUP, 1))), 8)
    blocks = _blocks(distance + s)
    masks = [sum(b[1] for b in some) for some in combinations(blocks, s)]
    ways = F.array(*[F.struct(F.lit(i).alias("way"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for i, m in enumerate(masks)])
    keyed = distinct.select("fp", "id", F.explode(ways).alias("k")).select(F.xxhash64("k.way", "k.bits").alias("key"), "fp", "id", F.col("k.way").alias("way"))
    size = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    grouped = keyed.join(size, "key")
    # of the bits that a large group does not share yet, one of distance + 1 parts agrees in any link:
    # below that, a group has no more members than its few free bits allow
    parts = []
    for m in masks:
        free = [b for b in range(64) if not m >> b & 1]
        edges = [len(free) * p // (distance + 1) for p in range(distance + 2)]
        parts.append([sum(1 << b for b in free[a:z]) for a, z in zip(edges, edges[1:], strict=False)])
    fine = [
        F.xxhash64("key", F.lit(p), F.col("fp").bitwiseAND(F.element_at(F.array(*[F.lit(_signed(x[p])) for x in parts]), F.col("way") + 1)))
        for p in range(distance + 1)
    ]
    keys = F.when(F.col("n") <= LARGE_GROUP, F.array("key")).otherwise(F.array(*fine))
    dealt = grouped.select(F.explode(keys).alias("key"), "fp", "id")
    dealt = dealt.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(lambda batches: _stars(batches, distance), "src long, dst long").distinct()


def near_duplicates(
    docs: DataFrame, width: int = 3, max_distance: int = 2, prints: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, fp, component): for each row of docs its first fingerprint and the smallest id it is linked to.

    width: words in a shingle. max_distance: differing bits of a link, chains of links included.
    prints: independent fingerprints, one of which must make the link; more find more of the pairs
    whose fingerprints differ by chance.
    """
    if not 1 <= prints <= len(MIXERS) + 1:
        raise ValueError(f"prints must be from 1 to {len(MIXERS) + 1}")
    rows = stored(fingerprints(docs, width, prints, id_col, text_col), "simhash")
    distinct = stored(rows.where("id is not null").groupBy("fps").agg(F.min("id").alias("id")), "simhash-distinct")
    n, found = distinct.count(), []
    for k in range(prints):
        own = distinct.select(F.get("fps", F.lit(k)).alias("fp"), "id")
        if prints > 1:  # texts that share this fingerprint but not the others
            first = own.groupBy("fp").agg(F.min("id").alias("first"))
            found.append(own.join(first, "fp").where("id <> first").select(F.col("id").alias("src"), F.col("first").alias("dst")))
            own = first.select("fp", F.col("first").alias("id"))
        found.append(links(own, max_distance, n))
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    classes = distinct.join(components(edges), F.col("id") == F.col("node"), "left").select("fps", F.coalesce("root", "id").alias("component"))
    return rows.join(classes, "fps", "left").select("id", F.get("fps", F.lit(0)).alias("fp"), "component")


def hex64(column: str):
    """A long's bits as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))
