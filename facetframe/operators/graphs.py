"""Graphs kept as tables of links: connected components, with or without a parity on each link, and what can be reached."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder of spark.checkpoint.dir, which all executors share. Only a session without executors of their own (tests) may go without."""
    _folder(df)
    return df.checkpoint(eager=True)


def _folder(df: DataFrame) -> str:
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if at is None and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="ckpt-"))
    return sc.getCheckpointDir()


def landed(df: DataFrame, batch: int | None = None) -> DataFrame:
    """df by way of Parquet in that folder: what reads it again takes the columns and, by their statistics, the row groups that it needs. batch: bytes, about, that Python is given at a time meanwhile."""
    at, name, conf = f"{_folder(df)}/landed-{uuid.uuid4().hex}", "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    before = conf.get(name)
    if batch is not None:
        conf.set(name, str(batch))
    try:
        df.write.parquet(at)
    finally:
        conf.set(name, before)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def signed_components(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """links: a, b, odd (0 or 1: whether b differs from a). Returns labels (key, label, odd: whether key differs from its label) and conflicts (label of components whose links disagree).

    A label is the least key that a key is connected with. Each round hands labels on along links and then follows labels
    of labels, so there are about as many rounds as the logarithm of the longest way; a round is three joins of a fixed size.
    """
    both = checkpointed(links.select("a", "b", "odd").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "odd")).distinct())
    labels = checkpointed(both.select(F.col("a").alias("key")).distinct().select("key", F.col("key").alias("label"), F.lit(0).alias("odd")))
    step = lambda x, y: (F.col(x) + F.col(y)) % 2
    while True:
        near = both.join(labels.select(F.col("key").alias("b"), "label", F.col("odd").alias("far")), "b").groupBy("a").agg(F.min(F.struct("label", step("odd", "far").alias("odd"))).alias("m"))
        moved = labels.join(near.withColumnRenamed("a", "key"), "key").select("key", F.col("label").alias("old"), F.least(F.struct("label", "odd"), "m").alias("m")).select("key", "old", F.col("m.label").alias("at"), F.col("m.odd").alias("odd"))
        jump = labels.select(F.col("key").alias("at"), F.col("label").alias("far"), F.col("odd").alias("more"))
        after = checkpointed(moved.join(jump, "at", "left").select("key", "old", F.coalesce("far", "at").alias("label"), ((F.col("odd") + F.coalesce("more", F.lit(0))) % 2).alias("odd")))
        labels = after.select("key", "label", "odd")
        if after.where("old <> label").isEmpty():
            break
    ends = both.join(labels.select(F.col("key").alias("a"), "label", F.col("odd").alias("p")), "a").join(labels.select(F.col("key").alias("b"), F.col("odd").alias("q")), "b")
    return labels, ends.where((F.col("p") + F.col("q") + F.col("odd")) % 2 == 1).select("label").distinct()


def components(links: DataFrame) -> DataFrame:
    """(key, label) of each end of links (a, b): the least key it is connected with."""
    return signed_components(links.select("a", "b", F.lit(0).alias("odd")))[0].select("key", "label")


def reachable(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots: root, node; links: node, target. Distinct (root, node) with all nodes that can be reached, roots included; cycles end by themselves."""
    known = new = checkpointed(roots.select("root", "node").distinct())
    while not new.isEmpty():
        found = new.join(links, "node").select("root", F.col("target").alias("node")).distinct()
        new = checkpointed(found.join(known, ["root", "node"], "left_anti"))
        known = checkpointed(known.unionByName(new))
    return known


#: Triangles up to which an object is worked on by one task.
SMALL = 50_000


def by_size(triangles: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """triangles (object_id, ...) of objects with at most SMALL of them, and of the others (None if there are none)."""
    large = large_objects(triangles, keys=("object_id",))
    if large is None:
        return triangles, None
    return triangles.join(large, "object_id", "left_anti"), triangles.join(large, "object_id", "left_semi")


def large_objects(*tables: DataFrame, keys: tuple[str, ...], most: int | None = None) -> DataFrame | None:
    """keys of objects with more than `most` (SMALL if it is larger or not given) rows in all tables together, or None. With v1, v2 and v3, objects with an unknown one among them count as large."""
    most = SMALL if most is None else min(SMALL, most)
    odd = lambda df: F.expr("v1 is null or v2 is null or v3 is null") if {"v1", "v2", "v3"} <= set(df.columns) else F.lit(False)
    n = reduce(DataFrame.unionByName, [df.select(*keys, odd(df).alias("odd")) for df in tables]).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.bool_or("odd").alias("odd"))
    large = checkpointed(n.where((F.col("n") > most) | F.col("odd")).select(*keys))
    return None if large.isEmpty() else large
