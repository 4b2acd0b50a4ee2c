"""Collections: fixed-schema tables of face vectors in the session's catalog."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facelake.functions.filters import condition
from facelake.operators.ledger import Ledger
from facelake.operators.search import FIELDS, search
from facelake.session import stored

SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("embedding", T.ArrayType(T.FloatType(), False), False),
        T.StructField("person_id", T.StringType(), False),
        T.StructField("image_path", T.StringType(), False),
        T.StructField("created_at", T.StringType(), False),
    ]
)
LIMITS = {"person_id": 256, "image_path": 512, "created_at": 32}
STAMP = "yyyy-MM-dd HH:mm:ss"


class Collection:
    """A table with the columns of SCHEMA and vectors of one length. Ids follow on from the greatest one."""

    def __init__(self, spark: SparkSession, name: str, dim: int, create: bool = True):
        self.spark, self.name, self.dim = spark, name, dim
        if create:
            self.ensure()

    def within(self, spark: SparkSession) -> Collection:
        """The same table in another session of the application, such as that of a micro-batch."""
        return Collection(spark, self.name, self.dim, create=False)

    def ensure(self) -> None:
        """Creates the table where it is missing; an existing one must hold vectors of this length."""
        columns = ", ".join(
            f"{f.name} " + (f"VARCHAR({LIMITS[f.name]})" if f.name in LIMITS else f.dataType.simpleString()) for f in SCHEMA
        )
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}) USING parquet TBLPROPERTIES ('dim' = '{self.dim}')")
        held = self.spark.sql(f"SHOW TBLPROPERTIES {self.name}").where("key = 'dim'").first()
        if held and int(held["value"]) != self.dim:
            raise ValueError(f"{self.name} holds vectors of {held['value']} values, not {self.dim}")

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def refreshed(self) -> Collection:
        """This collection with what other sessions have appended."""
        self.spark.catalog.refreshTable(self.name)
        return self

    def location(self) -> str:
        """The table's folder."""
        return self.spark.sql(f"DESCRIBE EXTENDED {self.name}").where("col_name = 'Location'").first()["data_type"].rstrip("/")

    def ledger(self) -> Ledger:
        """The table's commit files, in a folder that its readers pass over."""
        return Ledger(self.spark, f"{self.location()}/_ledger")

    def insert(self, rows: DataFrame, key: str | None = None) -> int:
        """Appends rows (embedding, person_id, image_path) and returns their number.

        One timestamp for the call; missing names become "None"; a vector of another length or a name beyond its limit is
        an error. Ids are consecutive and reserved, so that several writers may append at a time. A call with the key of
        one that has been completed appends nothing and returns 0; what a lost call with the key has left is removed.
        """
        ledger, table = self.ledger(), self.location()
        prefix = f"batch-{hashlib.sha256(key.encode()).hexdigest()[:32]}-" if key else f"rows-{uuid.uuid4().hex}-"
        if key and ledger.done(key) is not None:
            return 0
        if key:
            for old in ledger.fs.globStatus(ledger.jvm.org.apache.hadoop.fs.Path(f"{table}/{prefix}*")):
                ledger.fs.delete(old.getPath(), False)
        now = self.spark.sql(f"SELECT date_format(current_timestamp(), '{STAMP}')").first()[0]
        vector = F.when(F.size("embedding") == self.dim, F.col("embedding").cast("array<float>")).otherwise(
            F.raise_error(F.lit(f"a vector does not have {self.dim} values"))
        )

        def name(column: str) -> Column:
            text = F.coalesce(F.col(column).cast("string"), F.lit("None"))
            return F.when(F.length(text) <= LIMITS[column], text).otherwise(F.raise_error(F.lit(f"{column} exceeds {LIMITS[column]} characters"))).alias(column)

        # consecutive ids need one place per row: numbered inside partitions, shifted by the rows before; written
        # first, so that whatever made the rows runs once and both passes see the same partitions
        placed = rows.select(vector.alias("embedding"), name("person_id"), name("image_path"), F.monotonically_increasing_id().alias("place"))
        placed = stored(placed, "insert")
        n = placed.count()
        if n:
            self.spark.catalog.refreshTable(self.name)  # another session may have appended
            offset = ledger.reserve(n, self.read().agg(F.coalesce(F.max("id"), F.lit(0))).first()[0])
            numbered = numbered_rows(placed, "place").select(
                (F.col("number") + F.lit(offset)).alias("id"), "embedding", "person_id", "image_path", F.lit(now).alias("created_at")
            )
            # written apart and moved into the table, since writers of one folder would clear each other's files away
            staged = f"{table}/_staged-{uuid.uuid4().hex}"
            numbered.write.parquet(staged)
            path = ledger.jvm.org.apache.hadoop.fs.Path
            for file in ledger.fs.globStatus(path(f"{staged}/part-*")):
                if not ledger.fs.rename(file.getPath(), path(f"{table}/{prefix}{file.getPath().getName()}")):
                    raise OSError(f"{file.getPath()} cannot be moved into {self.name}")
            ledger.fs.delete(path(staged), True)
        if key:
            ledger.finish(key, n)
        self.spark.catalog.refreshTable(self.name)
        return n

    def insert_single(self, embedding: Sequence[float], person_id: str, image_path: str) -> int:
        row = self.spark.createDataFrame([(list(map(float, embedding)), person_id, image_path)], "embedding array<float>, person_id string, image_path string")
        return self.insert(row)

    def search(self, query: Sequence[float], k: int = 5, fields: Sequence[str] = FIELDS) -> DataFrame:
        return search(self.read(), query, k, fields)

    def query(self, expression: str = "", fields: Sequence[str] = ("id", *FIELDS), limit: int = 10) -> DataFrame:
        rows = self.read().where(condition(expression)) if expression else self.read()
        return rows.select(*fields).limit(limit)

    def query_by_person(self, person_id: str, limit: int = 100) -> DataFrame:
        return self.read().where(F.col("person_id") == F.lit(person_id)).select("id", *FIELDS).limit(limit)

    def stats(self) -> dict:
        exists = self.spark.catalog.tableExists(self.name)
        return {
            "collection_name": self.name,
            "row_count": self.read().count() if exists else 0,
            "fields": SCHEMA.jsonValue()["fields"],
            "embedding_dim": self.dim,
        }

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def recreate(self) -> None:
        self.drop()
        self.ensure()


def numbered_rows(rows: DataFrame, order: str) -> DataFrame:
    """rows with `number` from 1 in the order of monotonically increasing ids, without gathering them.

    The upper bits of such an id name the partition, so a count for each partition is all that is
    put in sequence. rows are evaluated twice: give a scan or a written table.
    """
    part = F.shiftrightunsigned(F.col(order), 33)
    place = F.col(order).bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.select(part.alias("part")).groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", before.alias("start"))  # a row for each partition
    return rows.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("number", F.col("start") + place + 1).drop("part", "start")
