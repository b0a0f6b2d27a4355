"""Small Spark helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000  # a counted side of at most this many short rows may be broadcast
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # older Sparks don't know it and keep the files longer


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).  Only a local
    session without that setting, as in tests, gets a folder of its own."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="haggle-checkpoints-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path for a table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is planned and run within deletes its shuffle files when it ends, not
    when the driver happens to collect its garbage."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: lineage is cut, and the files lie in the shared
    folder.  Nothing needs its shuffle files afterwards, so they are deleted."""
    shared_dir(df.sparkSession)
    with shuffles_freed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # planned anew, so that the setting holds


def written(df: DataFrame, name: str = "table") -> tuple[DataFrame, str]:
    """(df written as Parquet in the shared folder and read again, its path).
    Unlike a checkpoint, the new table has its true size as statistics, so loops
    that join their own results don't multiply size estimates round by round."""
    path = shared_path(df.sparkSession, name)
    with shuffles_freed(df.sparkSession):
        df.select("*").write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def semi_join(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows of df whose ``column`` is in ids (one distinct column of that name).
    ids is counted first and broadcast only up to BROADCAST_ROWS; beyond that
    it is a shuffle join."""
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(ids) if few else ids, column, "left_semi")


def ascii_lower(column):
    """A-Z to a-z only; every other character is kept."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unused_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df is called that."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def packed(df: DataFrame) -> Column:
    """All columns of df in one struct called ``row``, so that their names can't clash with working columns."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
