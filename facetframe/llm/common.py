"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import math
import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a session without executors of their own (tests) may go without: it gets a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if at is None and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="ckpt-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def give_back() -> None:
    """At a task's end: memory that a reused Python worker no longer needs goes back to the machine."""
    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def small_batches(df: DataFrame) -> DataFrame:
    """df, whose session from now on hands at most 2000 rows and about 4 MB at a time to Python; a setting of the user's own stays.

    Texts may be long: without this, 10,000 of them are held in a task's JVM and again in its Python worker.
    """
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", 2000), ("maxBytesPerBatch", 4 << 20)):
        if conf.get(f"spark.sql.execution.arrow.{name}", None) is None:
            conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    return df


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text; null stays null."""
    return F.unhex(F.md5(text.cast("binary")))


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def bounded_sample(df: DataFrame, rows: int) -> DataFrame:
    """At most `rows` rows, chosen by a hash of their columns: the same ones on every run, whatever the partitioning, and spread over all of df.

    Repeated rows are kept or left together; if that leaves none, any `rows` rows are taken.
    """
    on = [F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and kind != "variant"]
    n = df.count()
    if n <= rows:
        return checkpointed(df.repartition(8, *on))
    chosen = df.where(F.pmod(F.xxhash64(*on, F.lit(17)), F.lit(1 << 31)) < int(0.9 * rows / n * (1 << 31)))
    some = checkpointed(chosen.limit(rows).repartition(8, *on))
    return checkpointed(df.limit(rows).repartition(8, *on)) if some.isEmpty() else some


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, rows: int, doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs (doc_id, text, ...) that belong to at most `rows` labelled ids, with their label.

    Ids are chosen by hash from labels, before any text is read, and broadcast (at most `rows` of them), so docs are
    scanned once and only the chosen texts move. Labels other than 0 and 1 and null ids are left out.
    """
    ids = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(doc_id, label).distinct()
    return checkpointed(docs.join(F.broadcast(bounded_sample(ids, rows)), doc_id))


def gapless_rank(df: DataFrame, keys: list[str], order: list[Column], name: str, rows: int, rows_per_task: int = 20_000) -> DataFrame:
    """Add `name`: 0, 1, 2, ... within each value of `keys`.

    A key may hold most rows, so each key is cut into hash buckets of about rows_per_task rows; ranks within a bucket
    are shifted by the sizes of the buckets before it. `keys` must not be null and `df` should be cheap to read twice.
    """
    n_sub = max(16, math.ceil(rows / rows_per_task))
    cut = df.withColumn("_sub", F.pmod(F.xxhash64(*order), F.lit(n_sub)).cast("int"))
    sizes = cut.groupBy(*keys, "_sub").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(*keys, "_sub", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    within = F.row_number().over(Window.partitionBy(*keys, "_sub").orderBy(*order)) - 1
    return cut.withColumn("_r", within).join(shift, [*keys, "_sub"]).withColumn(name, (F.col("_r") + F.col("_shift")).cast("long")).drop("_sub", "_r", "_shift")
