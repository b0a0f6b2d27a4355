"""The policy's sample buffer as a table: append, clear, and seeded reading in batches.

Layout under ``path``::

    data/append=<name>/range=<r>/part-*   rows, cut into ranges of their shuffle key
    manifest/part-*                       a row per finished append or clear

An append first writes its rows and then its manifest row; readers start from the
manifest and see whole appends only.  What a lost job has written without a
manifest row is never read, and a repeated append of the same name writes the same
folder anew and counts once.  One job writes to a buffer at a time.

The shuffle key is a seeded md5 of the sample's key, so the order of reading
depends on the samples alone: any number of tasks, appends or reruns gives the
same batches.  Its ranges are even whatever the samples are, and numbering is
the two-level scan, so no task holds more than a range.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scan
from ..functions.hashing import md5_int
from .io import remove_path

KEY_BITS = 32        # bits of the shuffle key
RANGE_BITS = 4       # ranges of an append's layout: folders to read by
RANGE_ROWS = 1 << 16  # rows numbered in one window

_MANIFEST = "seq long, kind string, name string, n long"


class SampleBuffer:
    """``key_cols`` identify a sample: integer or string columns of the appended rows."""

    def __init__(self, spark: SparkSession, path: str, key_cols, *, seed: int = 42):
        self.spark, self.path, self.key_cols, self.seed = spark, path.rstrip("/"), list(key_cols), seed

    # -- writing

    def append(self, rows: DataFrame, name: str) -> int:
        """Add ``rows`` as the append ``name``; returns the number of rows of that append.
        An append whose name is in the manifest already (since the last clear) is not written again."""
        done = {r.name: r.n for r in self._entries()}
        if name in done:
            return done[name]
        key = md5_int(self.seed, *self.key_cols)
        data = rows.withColumn("shuffle_key", key).withColumn("range", F.shiftrightunsigned("shuffle_key", KEY_BITS - RANGE_BITS).cast("int"))
        where = f"{self.path}/data/append={name}"
        (data.repartitionByRange("range", "shuffle_key").write.mode("overwrite").partitionBy("range").parquet(where))
        n = self.spark.read.schema(data.schema).parquet(where).count()
        self._commit("append", name, n)
        return n

    def clear(self) -> None:
        """Forget every sample: one manifest row; then the folders of the forgotten appends are removed."""
        gone = [r.name for r in self._entries()]
        self._commit("clear", "", 0)
        for name in gone:
            remove_path(self.spark, f"{self.path}/data/append={name}")

    def _commit(self, kind: str, name: str, n: int) -> None:
        rows = self._manifest()
        seq = max((r.seq for r in rows), default=0) + 1
        self.spark.createDataFrame([(seq, kind, name, n)], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    # -- reading

    def _exists(self, path: str) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def _manifest(self) -> list:
        """Rows of the manifest: one per append or clear."""
        if not self._exists(f"{self.path}/manifest"):
            return []
        return sorted(self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest").collect(), key=lambda r: r.seq)

    def _entries(self) -> list:
        """Appends since the last clear."""
        out: list = []
        for r in self._manifest():
            out = [] if r.kind == "clear" else [*out, r]
        return out

    def _folder(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/data/append={name}")

    def read(self, schema: str | None = None) -> DataFrame:
        """All samples with their ``shuffle_key`` and the ``append`` that brought them.  Appends
        without rows add nothing; an empty buffer needs ``schema``."""
        found = None
        for r in self._entries():
            if r.n:
                one = self._folder(r.name).drop("range").withColumn("append", F.lit(r.name))
                found = one if found is None else found.unionByName(one, allowMissingColumns=True)
        if found is not None:
            return found
        if schema is None:
            raise ValueError("the buffer is empty; give a schema to read it")
        return self.spark.createDataFrame([], schema).withColumns({"shuffle_key": F.lit(None).cast("long"), "append": F.lit(None).cast("string")})

    def batches(self, size: int, schema: str | None = None) -> DataFrame:
        """All samples in seeded order, cut into batches of ``size``: adds ``batch_no`` and
        ``batch_pos`` (both from 0).  Samples of one key (the same one appended
        twice) follow each other by append."""
        rows = self.read(schema)
        n = sum(r.n for r in self._entries())
        bits = min(KEY_BITS, max(1, math.ceil(math.log2(max(n, 1) / RANGE_ROWS + 1))))
        numbered = scan.multi_scan(
            rows.withColumns({"_all": F.lit(0), "_one": F.lit(1).cast("long")}), "_all", "_one", running=[("_one", "sum", "_n", False)],
            order=["shuffle_key", *self.key_cols, "append"], chunk=F.shiftrightunsigned("shuffle_key", KEY_BITS - bits))
        place = F.col("_n") - 1
        return numbered.withColumns({"batch_no": F.floor(place / size).cast("long"), "batch_pos": (place % size).cast("int")}).drop(
            "_all", "_one", "_n")
