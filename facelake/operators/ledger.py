"""Commit files beside a table: ids reserved by several writers, and batches that are appended once.

A reservation is a file whose name is the next number of a sequence; it comes into being whole or not at all, and only one
writer gets a number, so no two share an id. A batch's mark is written after its rows are in place. On HDFS the claim is a
rename, which fails where the target exists; on a local file system it is a hard link. Object stores without such an
operation need one writer at a time.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import SparkSession


class Ledger:
    """Reservations and marks below a folder that all writers share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _write(self, name: str, value) -> None:
        stream = self.fs.create(self._path(name), True)
        try:
            stream.write(bytearray(json.dumps(value).encode()))
        finally:
            stream.close()

    def _read(self, name: str):
        stream = self.fs.open(self._path(name))
        try:
            return json.loads(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def _claim(self, name: str, value) -> bool:
        """Writes a file unless another writer has; whether this one did."""
        own = f"_{uuid.uuid4().hex}"
        self._write(own, value)
        try:
            if self.fs.getUri().getScheme() != "file":
                return self.fs.rename(self._path(own), self._path(name))
            files, paths = self.jvm.java.nio.file.Files, self.jvm.java.nio.file.Path
            local = [paths.of(self.fs.makeQualified(self._path(n)).toUri()) for n in (name, own)]
            try:
                files.createLink(*local)
                return True
            except Exception as error:
                if "FileAlreadyExistsException" not in str(error):
                    raise
                return False
        finally:
            self.fs.delete(self._path(own), False)

    def _last(self) -> int:
        """The number of the last reservation, 0 without one."""
        if not self.fs.exists(self._path("")):
            return 0
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(""))]
        return max((int(n[4:]) for n in names if n.startswith("ids-")), default=0)

    def reserve(self, n: int, floor: int) -> int:
        """The id before the first of n ids that no other reservation has, and that lie above floor."""
        while True:
            last = self._last()
            after = self._read(f"ids-{last:012d}")["last"] if last else 0
            start = max(after, floor)
            if self._claim(f"ids-{last + 1:012d}", {"first": start + 1, "last": start + n}):
                return start

    @staticmethod
    def _mark(key: str) -> str:
        return f"done-{hashlib.sha256(key.encode()).hexdigest()}"

    def done(self, key: str) -> int | None:
        """The number of rows of a batch that is in place, None for another."""
        return self._read(self._mark(key))["n"] if self.fs.exists(self._path(self._mark(key))) else None

    def finish(self, key: str, n: int) -> None:
        self._write(self._mark(key), {"key": key, "n": n})

    def clear(self) -> None:
        self.fs.delete(self._path(""), True)
