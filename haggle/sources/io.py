"""Sources and sinks.

Scratch output goes under the session's shared ``spark.checkpoint.dir``
(never a machine-local folder), one fresh sub-folder per call.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.joins import small
from ..session import ensure_checkpoint_dir

DIALOGUE_SCHEMA = T.StructType([
    T.StructField("conv_id", T.LongType()),
    T.StructField("turn_no", T.IntegerType()),
    T.StructField("speaker", T.IntegerType()),
    T.StructField("utterance", T.StringType()),
    T.StructField("intent", T.StringType()),
    T.StructField("price", T.DecimalType(12, 2)),
    T.StructField("items", T.StringType()),
    T.StructField("background_data", T.StringType()),
])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared scratch folder; :func:`clear_scratch`
    removes what this process wrote there."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/haggle-scratch"
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


_written: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a scratch table: a plan that reads it several times computes it once."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> int:
    """Remove this process's scratch tables (through the cluster's file
    system); call it once their results have been read.  Returns their number."""
    n = len(_written)
    while _written:
        remove_path(spark, _written.pop())
    return n


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove a folder through the cluster's file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


TEXT_COLUMNS = ("utterance", "items", "background_data")


def write_dialogues_csv(df: DataFrame, path: str, *, escaped: bool = False) -> None:
    """Turn table as CSV with a header and ``NA`` for a missing price;
    ``escaped`` keeps every record on one line, so that files can be split."""
    if escaped:
        df = df.withColumns({c: escape_lines(c) for c in TEXT_COLUMNS})
    (df.select([f.name for f in DIALOGUE_SCHEMA.fields])
       .write.mode("overwrite").option("header", True).option("nullValue", "NA")
       .option("escape", '"').csv(path))


def read_dialogues(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Load a turn table with a declared schema (no inference); ``NA`` is
    NULL; quoted fields may span lines.  A CSV with such fields can't be
    split, so one file is one task: keep large tables as ``parquet``, or as
    ``csv_escaped`` (written with line breaks escaped, splittable)."""
    if fmt == "parquet":
        return spark.read.schema(DIALOGUE_SCHEMA).parquet(path)
    if fmt == "csv_escaped":
        d = (spark.read.schema(DIALOGUE_SCHEMA).option("header", True).option("nullValue", "NA")
             .option("escape", '"').csv(path))
        return d.withColumns({c: unescape_lines(c) for c in TEXT_COLUMNS})
    return (spark.read.schema(DIALOGUE_SCHEMA).option("header", True).option("nullValue", "NA")
            .option("multiLine", True).option("escape", '"').csv(path))


def write_catalog_json(products: DataFrame, acc_variants: DataFrame, prod_variants: DataFrame,
                       path: str) -> None:
    """Nested catalog as JSON lines of one schema: price range, features,
    ``description`` map name -> text and ``accessories`` map type -> (name ->
    text).  A product's catalog is spread over lines (one for the product,
    one per variant, with one-entry maps), so no row holds a whole product."""
    none_d = F.lit(None).cast("map<string,string>")
    none_a = F.lit(None).cast("map<string,map<string,string>>")
    none = F.lit(None).cast("string")
    heads = products.select("product", "price", "features", none_d.alias("description"), none_a.alias("accessories"))
    desc = prod_variants.select("product", none.alias("price"), none.alias("features"),
                                F.create_map("name", "text").alias("description"), none_a.alias("accessories"))
    acc = acc_variants.select("product", none.alias("price"), none.alias("features"), none_d.alias("description"),
                              F.create_map("acc_type", F.create_map("name", "text")).alias("accessories"))
    heads.unionByName(desc).unionByName(acc).write.mode("overwrite").json(path)


CATALOG_SCHEMA = T.StructType([
    T.StructField("product", T.StringType()),
    T.StructField("price", T.StringType()),
    T.StructField("features", T.StringType()),
    T.StructField("description", T.MapType(T.StringType(), T.StringType())),
    T.StructField("accessories", T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType()))),
])


def read_catalog(spark: SparkSession, path: str, *, multi_line: bool = False) -> DataFrame:
    """Load the nested catalog with a declared schema and list its
    accessories: (product, acc_type, name, description)."""
    cat = spark.read.schema(CATALOG_SCHEMA).option("multiLine", multi_line).json(path)
    acc = cat.select("product", F.explode("accessories").alias("acc_type", "names"))
    return acc.select("product", "acc_type", F.explode("names").alias("name", "description"))


HEADER_FORMAT = "######conversation %d###############"   # FIXED VALUE: flow header line


def escape_lines(c):
    """Backslash, newline and carriage return as two-character escapes."""
    c = F.col(c) if isinstance(c, str) else c
    for raw, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
        c = F.replace(c, F.lit(raw), F.lit(shown))
    return c


def unescape_lines(c):
    """Inverse of :func:`escape_lines`, in one pass over the escapes."""
    c = F.col(c) if isinstance(c, str) else c
    pieces = F.regexp_extract_all(c, F.lit(r"(\\.|[^\\]+)"), 1)
    one = lambda p: (F.when(p == "\\n", "\n").when(p == "\\r", "\r").when(p == "\\\\", "\\").otherwise(p))
    return F.array_join(F.transform(pieces, one), "")


def write_transcript(df: DataFrame, path: str, *, keys: str = "conv_id", pos: str = "turn_no",
                     text: str = "text", mode: str = "errorifexists") -> None:
    """Flow headers and turn lines as plain text ``conversation TAB line TAB
    text``, one line each (line breaks in a text are escaped), every
    conversation a contiguous block, header (line 0) first.  The order comes
    from a distributed range-partitioned sort on (conversation, line): a very
    long conversation is split across consecutive output files instead of
    landing in one task.  ``mode="append"`` adds to an existing transcript; a
    re-run of the same job must not, so the default refuses."""
    heads = df.select(keys).distinct().select(
        keys, F.lit(0).cast("long").alias("_ord"),
        F.format_string(HEADER_FORMAT, F.col(keys)).alias("value"))
    lines = df.select(keys, F.col(pos).cast("long").alias("_ord"), escape_lines(F.col(text)).alias("value"))
    (heads.unionByName(lines).orderBy(keys, "_ord")
     .select(F.concat_ws("\t", F.col(keys).cast("string"), F.col("_ord").cast("string"), F.coalesce("value", F.lit("")))
             .alias("value")).write.mode(mode).text(path))


def read_transcript(spark: SparkSession, path: str) -> DataFrame:
    """(conv_id, line_no, text) of a written transcript; line 0 is the header."""
    p = F.split("value", "\t", 3)
    return spark.read.text(path).select(p[0].cast("long").alias("conv_id"), p[1].cast("long").alias("line_no"),
                                        unescape_lines(p[2]).alias("text"))


METRIC_SCHEMA = "step long, value double, run string, name string"


def _has_path(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _foldered(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRIC_SCHEMA).parquet(f"{path}/series")


def _packed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{METRIC_SCHEMA}, pack int").parquet(f"{path}/packed")


def _in_series(df: DataFrame, series: DataFrame, how: str) -> DataFrame:
    """df's rows that are (left_semi) or are not (left_anti) of one of the series (run, name; null is a name too)."""
    series = series.select(F.col("run").alias("_r"), F.col("name").alias("_n"))
    return df.join(series, F.col("run").eqNullSafe(F.col("_r")) & F.col("name").eqNullSafe(F.col("_n")), how)


METRIC_STEPS = 1 << 20  # steps of a series that one task writes
SHORT_SERIES = 1000     # a series of fewer steps is short
FEW_SERIES = 1000       # so many short series of one write get folders
PACKS = 64              # folders of all the others


def write_metrics(df: DataFrame, path: str) -> None:
    """Write series of ``(run, step, name, value)`` to the metric store: a folder per run
    and series.  Writing a series of a run replaces what the store had of it, and
    leaves all others alone, so a job that runs again doesn't count twice; tasks
    commit their files only when the whole job has succeeded.

    A long series is several files of its folder; rows are dealt out by run, name and
    a slice of the steps, so no run has to fit in one task.  Where a write has more
    than ``FEW_SERIES`` short series, as the one best step of each of many runs,
    the short ones share ``PACKS`` folders by a hash of their run: folders and files
    follow the rows, not the runs.  A series stays where the store has it."""
    spark = df.sparkSession
    rows = written(df.select(F.col("step").cast("long").alias("step"), F.col("value").cast("double").alias("value"),
                             F.col("run").cast("string").alias("run"), F.col("name").cast("string").alias("name")), "metric_rows")
    series = rows.groupBy("run", "name").agg(F.count(F.lit(1)).alias("n"))
    few = series.where(F.col("n") < SHORT_SERIES).limit(FEW_SERIES + 1).count() <= FEW_SERIES
    own = series if few else series.where(F.col("n") >= SHORT_SERIES)
    if _has_path(spark, f"{path}/packed"):
        own = _in_series(own, _packed(spark, path), "left_anti")
    if not few and _has_path(spark, f"{path}/series"):
        own = own.unionByName(_in_series(series, _foldered(spark, path), "left_semi"))
    own = small(written(own.select("run", "name").distinct(), "metric_series"))  # before folders it is read from are replaced
    (_in_series(rows, own, "left_semi").repartition("run", "name", F.floor(F.col("step") / F.lit(METRIC_STEPS)))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "name").parquet(f"{path}/series"))
    rest = _in_series(rows, own, "left_anti").withColumn("pack", F.pmod(F.xxhash64("run"), F.lit(PACKS)).cast("int"))
    if _has_path(spark, f"{path}/packed"):  # a pack keeps its other series
        stay = _packed(spark, path).join(F.broadcast(rest.select("pack").distinct()), "pack", "left_semi")
        stay = _in_series(stay, small(series.select("run", "name")), "left_anti")
        rest = rest.unionByName(written(stay, "metric_rows"))
    elif few:
        return
    (rest.hint("rebalance", "pack").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("pack").parquet(f"{path}/packed"))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(run, step, name, value) of a metric store; filters on run and name skip folders of series."""
    found = [read(spark, path).select("run", "step", "name", "value") for read, folder in (
        (_foldered, "series"), (_packed, "packed")) if _has_path(spark, f"{path}/{folder}")]
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def write_run_config(spark: SparkSession, config: dict, path: str) -> None:
    """One-row run configuration as JSON: the caller's fields (numbers,
    strings, booleans), whatever they are."""
    cols = [F.lit(v).alias(k) for k, v in config.items()]
    spark.range(1).select(*cols).coalesce(1).write.mode("overwrite").json(path)
