"""Exact deduplication over an index of live digests: cuckoo filters in front of bucketed content.

The index has one entry for each live row: shard, digest, id and place, where the digest is the sha256 of the normalised text.
Entries are dealt to shards by bits of the digest. A shard has a cuckoo filter: buckets of four 16-bit
fingerprints, each in one of two buckets, which, unlike a Bloom filter, can lose entries again.

* insert: a batch is folded to its distinct digests before it moves. They meet their shard's filter; only digests that it
  may hold are verified against the content, and the others are new without a look at it. New digests go
  into the filter, many at once: every pending fingerprint takes a free slot of its bucket, or flips to its other
  bucket, or throws one out. A filter that overflows is built again at twice the size from the stored keys,
  since fingerprints alone do not tell new buckets. Content is only ever appended.
* delete: live rows of the given ids and texts go, and digests without a row left are taken out of the filters.
* find: the filters' hits are verified against the content and get their first row and the number of their rows; what a
  filter does not hold is known to be new.

Content is the whole 256-bit digest, by which rows are equal, and not the text: no text moves after it is hashed. Every
version of filters and entries is a folder of its own below the index's folder, which all executors share; a state file
names the current ones, so that a run that is lost leaves the index as it was.

Equal texts may be a third of all rows: rows are aggregated before they are dealt, a task holds the distinct
digests of a shard (shards double beyond SHARD_KEYS of them), and rows join their group by a plain equi-join.

Defined results: a null text is empty; of equal texts the row with the smallest id stays, rows without id after
all others; of rows that repeat the id and text one stays, whichever was placed first; texts of any length are
hashed whole; an empty table gives an empty result. Only the returned columns are kept, so that none can clash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facelake.llm.common import stored, text_column

#: Fingerprints of a bucket.
SLOTS = 4
#: Distinct digests of a shard on average, at most.
SHARD_KEYS = 100_000
#: Rounds after which a filter has overflowed.
ROUNDS = 200
#: Fewest shards, so that small tables have tasks enough.
LEAST_SHARDS = 64
FILTERS = "shard int, filter binary"
STATE = "version int, shards int, buckets int, id_type string, log array<string>, content array<string>, filters string"


def fingerprints(digests: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """First buckets and 16-bit fingerprints, never 0, of digests of at least 16 bytes."""
    words = np.frombuffer(b"".join(d[:16] for d in digests), "<u8").reshape(-1, 2)
    prints = (words[:, 1] % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
    return (words[:, 0] & np.uint64(buckets - 1)).astype(np.int64), prints


def other_bucket(bucket: np.ndarray, prints: np.ndarray, buckets: int) -> np.ndarray:
    """The second bucket of a fingerprint from its first and the other way round."""
    mixed = (prints.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
    return bucket ^ (mixed & np.uint64(buckets - 1)).astype(np.int64)


def rank_within(groups: np.ndarray) -> np.ndarray:
    """How many earlier entries are in the same group."""
    order = np.argsort(groups, kind="stable")
    ordered = groups[order]
    first = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    start = np.maximum.accumulate(np.where(first, np.arange(len(groups)), 0))
    rank = np.empty(len(groups), np.int64)
    rank[order] = np.arange(len(groups)) - start
    return rank


def add(table: np.ndarray, bucket: np.ndarray, prints: np.ndarray) -> bool:
    """Puts fingerprints into a table (buckets x SLOTS), all pending ones at once in each round; False: it has overflowed,
    and some of what it held is lost."""
    bucket, prints = bucket.copy(), prints.copy()
    flipped = np.zeros(len(bucket), bool)
    for turn in range(ROUNDS):
        if not len(bucket):
            return True
        rank = rank_within(bucket)
        empty = table[bucket] == 0
        free = empty.sum(axis=1)
        fits = rank < free
        # the rank-th free slot
        slot = (np.cumsum(empty, axis=1) == (rank + 1)[:, None]).argmax(axis=1)
        table[bucket[fits], slot[fits]] = prints[fits]
        # the first that found no room throws one out if it has been in both buckets; the others try their other bucket
        throws = (rank == free) & flipped
        at = (turn + np.arange(len(bucket))) % SLOTS
        out = table[bucket[throws], at[throws]]
        table[bucket[throws], at[throws]] = prints[throws]
        prints[throws] = out
        bucket, prints, flipped = bucket[~fits], prints[~fits], np.ones(int((~fits).sum()), bool)
        bucket = other_bucket(bucket, prints, len(table))
    return not len(bucket)


def holds(table: np.ndarray, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Whether each fingerprint is in one of its buckets."""
    other = other_bucket(bucket, prints, len(table))
    return (table[bucket] == prints[:, None]).any(axis=1) | (table[other] == prints[:, None]).any(axis=1)


def drop(table: np.ndarray, bucket: np.ndarray, prints: np.ndarray) -> None:
    """Takes one copy of each fingerprint out; each must have been put in."""
    other = other_bucket(bucket, prints, len(table))
    low, high = np.minimum(bucket, other), np.maximum(bucket, other)
    while len(low):
        turn = rank_within(low * 65536 + prints) == 0  # equal fingerprints of a pair of buckets go one after the other
        a, b, f = low[turn], high[turn], prints[turn]
        there = table[a] == f[:, None]
        own = there.any(axis=1)
        table[a[own], there[own].argmax(axis=1)] = 0
        there = table[b[~own]] == f[~own][:, None]
        if not there.any(axis=1).all():
            raise ValueError("a digest to be dropped is not in its filter")
        table[b[~own], there.argmax(axis=1)] = 0
        low, high, prints = low[~turn], high[~turn], prints[~turn]


def table_of(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2").reshape(-1, SLOTS).copy()


def built(digests: list[bytes], buckets: int) -> np.ndarray:
    """A filter of these digests, with as many buckets or, doubled until they fit, more."""
    while True:
        table = np.zeros((buckets, SLOTS), "<u2")
        if len(digests) <= buckets * SLOTS and add(table, *fingerprints(digests, buckets)):
            return table
        buckets *= 2


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " ")


class CuckooIndex:
    """The index below a folder that all executors share; a folder without one is an empty index."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, id_type: str = "bigint"):
        """buckets: of a new shard's filter, a power of two; id_type: of a new index's ids."""
        from pyspark.errors import AnalysisException

        if buckets < 1 or buckets & (buckets - 1):
            raise ValueError("buckets must be a power of two")
        self.spark, self.folder = spark, folder.rstrip("/")
        self.state = {"version": 0, "shards": LEAST_SHARDS, "buckets": buckets, "id_type": id_type, "log": [], "content": [], "filters": ""}
        try:
            states = spark.read.schema(STATE).parquet(f"{self.folder}/state")
            if last := states.orderBy(F.desc("version")).first():
                self.state = last.asDict()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise

    # what is stored

    def _write(self, df: DataFrame, name: str) -> str:
        path = f"{self.folder}/{name}-{self.state['version'] + 1}"
        df.write.mode("overwrite").parquet(path)  # of a run that was lost
        return path

    def _commit(self, **changed) -> None:
        state = self.state | changed | {"version": self.state["version"] + 1}
        self.spark.createDataFrame([tuple(state[c.split()[0]] for c in STATE.split(", "))], STATE).coalesce(1).write.mode("append").parquet(f"{self.folder}/state")
        self.state = state

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def log(self) -> DataFrame:
        """(digest, at) of each live row; at (missing, id, version, row) is its place among equal texts."""
        return self._read(self.state["log"], f"digest binary, at {self._at_type()}")

    def content(self) -> DataFrame:
        """(shard, digest, n, first) of each live digest."""
        found = self._read(self.state["content"], f"shard int, digest binary, n long, first {self._at_type()}")
        return found.groupBy("shard", "digest").agg(F.sum("n").alias("n"), F.min("first").alias("first"))

    def filters(self) -> DataFrame:
        return self._read([self.state["filters"]] if self.state["filters"] else [], FILTERS)

    def _at_type(self) -> str:
        return f"struct<missing:boolean,id:{self.state['id_type']},version:int,row:bigint>"

    def _shard(self, shards: int) -> Column:
        """The shard of a digest, from bits that its filter does not use."""
        return F.pmod(F.conv(F.hex(F.substring("digest", 17, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int").alias("shard")

    # what is done with filters, a shard in a task

    def _probe(self, digests: DataFrame) -> DataFrame:
        """(shard, digest, hit) of distinct digests (shard, digest)."""

        def run(left, right):
            import pandas as pd

            hit = np.zeros(len(left), bool)
            if len(left) and len(right):
                table = table_of(right["filter"].iloc[0])
                hit = holds(table, *fingerprints(left["digest"].tolist(), len(table)))
            return pd.DataFrame({"shard": left["shard"], "digest": left["digest"], "hit": hit})

        return digests.groupBy("shard").cogroup(self.filters().groupBy("shard")).applyInPandas(run, "shard int, digest binary, hit boolean")

    def _changed(self, digests: DataFrame, removed: bool) -> DataFrame:
        """(shard, filter): the filters with distinct digests (shard, digest) put in or taken out; null: overflowed."""
        buckets = self.state["buckets"]

        def run(left, right):
            import pandas as pd

            shard = int((left if len(left) else right)["shard"].iloc[0])
            table = table_of(right["filter"].iloc[0]) if len(right) else np.zeros((buckets, SLOTS), "<u2")
            fits = True
            if len(left):
                own = fingerprints(left["digest"].tolist(), len(table))
                if removed:
                    drop(table, *own)
                else:
                    fits = add(table, *own)
            return pd.DataFrame({"shard": [shard], "filter": [table.tobytes() if fits else None]})

        return digests.groupBy("shard").cogroup(self.filters().groupBy("shard")).applyInPandas(run, FILTERS)

    def _rebuilt(self, digests: DataFrame, least: DataFrame) -> DataFrame:
        """(shard, filter) of the shards in least (shard, buckets), from all their distinct digests (shard, digest)."""

        def run(left, right):
            import pandas as pd

            if not len(right):
                return pd.DataFrame({"shard": pd.Series([], dtype="int32"), "filter": []})
            table = built(left["digest"].tolist(), int(right["buckets"].iloc[0]))
            return pd.DataFrame({"shard": [int(right["shard"].iloc[0])], "filter": [table.tobytes()]})

        return digests.groupBy("shard").cogroup(least.groupBy("shard")).applyInPandas(run, FILTERS)

    def _resized(self, filters: DataFrame, keys: DataFrame) -> DataFrame:
        """filters with those that overflowed built again from the stored keys (shard, digest), at twice the size at least."""
        full = filters.where("filter is null").select("shard")
        if full.isEmpty():
            return filters
        before = self.filters().select("shard", (F.octet_length("filter") / (2 * SLOTS)).cast("long").alias("buckets"))
        least = full.join(before, "shard", "left").select("shard", (2 * F.coalesce("buckets", F.lit(self.state["buckets"]))).alias("buckets"))
        # a row for each shard, no keys of the others
        wanted = keys.join(full, "shard", "left_semi")
        return filters.where("filter is not null").unionByName(self._rebuilt(wanted, least))

    # operations

    def rows(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(digest, at) of each row of docs, stored: texts are read and hashed once."""
        digest = F.unhex(F.sha2(normalised(text_column(docs, text_col)), 256))
        own = F.col(f"`{id_col}`").cast(self.state["id_type"])
        at = F.struct(own.isNull().alias("missing"), own.alias("id"), F.lit(self.state["version"] + 1).alias("version"), F.monotonically_increasing_id().alias("row"))
        return stored(docs.select(digest.alias("digest"), at.alias("at")), "digests")

    def insert(self, rows: DataFrame) -> None:
        """Adds rows (digest, at), as `rows` makes them."""
        folded = stored(rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("at").alias("first")), "folded")
        n, held = folded.count(), self.content().count() if self.state["content"] else 0
        if not n:
            return
        shards = self.state["shards"]
        while n + held > shards * SHARD_KEYS:
            shards *= 2
        if shards != self.state["shards"]:
            self._reshard(shards)
        own = folded.select(self._shard(shards), "digest")
        if held:
            probed = stored(self._probe(own), "probed")
            known = probed.where("hit").join(self.content().select("digest"), "digest", "left_semi")
            own = stored(probed.join(known.select("digest"), "digest", "left_anti").select("shard", "digest"), "new-digests")
        changed = stored(self._changed(own, removed=False), "filters")
        keys = own.unionByName(self.content().select("shard", "digest")) if held else own
        filters = self._write(self._resized(changed, keys), "filters")
        content = self._write(folded.select(self._shard(shards), "digest", "n", "first").repartition("shard").sortWithinPartitions("shard", "digest"), "content")
        log = self._write(rows, "log")
        self._commit(log=[*self.state["log"], log], content=[*self.state["content"], content], filters=filters)

    def delete(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Removes the live rows that have the id and text of a row of docs; others of docs are ignored."""
        gone = self.rows(docs, id_col, text_col).select("digest", F.col("at.id").alias("gone_id")).distinct()
        live = self.log().alias("l")
        match = (F.col("l.digest") == F.col("g.digest")) & F.col("l.at.id").eqNullSafe(F.col("g.gone_id"))
        left = self._write(live.join(gone.alias("g"), match, "left_anti"), "log")
        touched = gone.select("digest").distinct()
        remaining = self._read([left], f"digest binary, at {self._at_type()}").join(touched, "digest", "left_semi")
        folded = stored(remaining.groupBy("digest").agg(F.count("*").alias("n"), F.min("at").alias("first")), "folded")
        content = self.content()
        dead = content.join(touched, "digest", "left_semi").join(folded, "digest", "left_anti").select("shard", "digest")
        kept = content.join(touched, "digest", "left_anti").unionByName(folded.select(self._shard(self.state["shards"]), "digest", "n", "first"))
        filters = self._write(self._changed(stored(dead, "dead-digests"), removed=True), "filters")
        kept = self._write(kept.repartition("shard").sortWithinPartitions("shard", "digest"), "content")
        self._commit(log=[left], content=[kept], filters=filters)

    def find(self, rows: DataFrame) -> DataFrame:
        """(digest, n, first) of the live digests among rows (digest, ..): the filters' hits, verified."""
        own = rows.select("digest").distinct().select(self._shard(self.state["shards"]), "digest")
        hits = self._probe(own).where("hit").select("digest")
        return hits.join(self.content().select("digest", "n", "first"), "digest")

    def _reshard(self, shards: int) -> None:
        """Deals the index to more shards, whose filters are built from the stored keys."""
        if self.state["content"]:
            moved = self.content().select(self._shard(shards), "digest", "n", "first")
            path = self._write(moved.repartition("shard").sortWithinPartitions("shard", "digest"), "content")
            keys = self._read([path], "shard int, digest binary")
            sizes = keys.select("shard").distinct().withColumn("buckets", F.lit(self.state["buckets"]).cast("long"))
            self._commit(shards=shards, content=[path], filters=self._write(self._rebuilt(keys, sizes), "filters"))
        else:
            self.state = self.state | {"shards": shards}


def deduplicate(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of each row of docs, after adding docs to the index below folder.

    Rows that the index held before count as well: the row that stays may be one of them.
    """
    index = CuckooIndex(docs.sparkSession, folder, id_type=docs.select(F.col(f"`{id_col}`")).schema[0].dataType.simpleString())
    rows = index.rows(docs, id_col, text_col)
    index.insert(rows)
    # stored, so that the join has a dealing of its own, which Spark can split where many rows are equal
    both = rows.join(stored(index.find(rows), "found"), "digest")
    return both.select(
        F.col("at.id").alias("id"), F.col("first.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("at") == F.col("first")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
