"""Sharding by Karmarkar-Karp differencing: near equal bytes per shard with groups of equal texts kept together."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, gapless_rank, table, text_key


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """A part 0..k-1 for each item. The two partial partitions with the largest spread are combined, oppositely ordered, until one is left."""
    n = len(sizes)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    sums: list = []
    for x in sizes:
        first = np.zeros(k, dtype=np.int64)
        first[0] = x
        sums.append(first)
    made: list[tuple[int, int, np.ndarray]] = []
    heap = [(-int(x), i) for i, x in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        total = sums[a] + sums[b][::-1]
        order = np.argsort(-total, kind="stable")
        total = total[order]
        sums[a] = sums[b] = None
        sums.append(total)
        made.append((a, b, order))
        heapq.heappush(heap, (-int(total[0] - total[-1]), len(sums) - 1))
    labels = np.zeros(n, dtype=np.int64)
    todo = [(heap[0][1], np.arange(k))]
    while todo:
        node, names = todo.pop()
        if node < n:
            labels[node] = names[0]
            continue
        a, b, order = made[node - n]
        left, right = np.empty(k, dtype=np.int64), np.empty(k, dtype=np.int64)
        left[order] = names
        right[k - 1 - order] = names
        todo += [(a, left), (b, right)]
    return labels


def _parts(k: int):
    def parts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "item"], ascending=[False, True])
        return pdf.assign(part=difference(pdf["bytes"].to_numpy(), k).astype("int32"))

    return parts


def assign_groups(groups: DataFrame, shards: int, n_groups: int, per_bucket: int = 20_000, lumps: int = 64, fine: int = 4096, heavy: int = 512) -> DataFrame:
    """groups: item binary (unique), bytes long. Returns item, shard.

    Groups of at least total / (shards * heavy) bytes (at most shards * heavy of them) and about `fine` others stay
    single; the rest are dealt into buckets of about per_bucket groups, and differencing makes `lumps` equal lumps of
    each bucket. While the lumps are too many for one task, they are lumped again. Lumps and single groups then go to
    the shards, again by differencing, so one task never sees more than a bounded number of rows.
    """
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    buckets = math.ceil(n_groups / per_bucket)
    single = (F.col("bytes") * shards * heavy >= total) | (F.pmod(F.xxhash64("item", F.lit(5)), F.lit(max(1, n_groups // fine))) == 0)
    groups = checkpointed(groups.withColumn("single", single).withColumn("at", F.pmod(F.xxhash64("item"), F.lit(buckets if buckets else 1)).cast("long")))
    schema = "at long, item binary, bytes long, part int"
    below = checkpointed(groups.where("not single").select("at", "item", "bytes").groupBy("at").applyInPandas(_parts(lumps), schema))
    owner, width = below.select("item", F.struct("at", "part").alias("lump")), max(1, buckets)
    lump_sums = below.groupBy("at", "part").agg(F.sum("bytes").alias("bytes"))
    while width > 300:
        up = lump_sums.withColumn("old", F.struct("at", "part")).select(F.expr("at div 300").alias("at"), F.concat(F.encode(F.lpad(F.col("at").cast("string"), 20, "0"), "utf-8"), F.encode(F.lpad(F.col("part").cast("string"), 4, "0"), "utf-8")).alias("item"), "bytes", "old")
        made = checkpointed(up.groupBy("at").applyInPandas(_parts(lumps), "at long, item binary, bytes long, old struct<at:long,part:int>, part int"))
        owner = owner.join(made.select(F.col("old").alias("lump"), F.struct("at", "part").alias("new")), "lump").select("item", F.col("new").alias("lump"))
        lump_sums, width = made.groupBy("at", "part").agg(F.sum("bytes").alias("bytes")), math.ceil(width / 300)
    name = F.encode(F.concat_ws("/", F.lit("lump"), F.col("at").cast("string"), F.col("part").cast("string")), "utf-8")
    top = lump_sums.select(F.lit(0).cast("long").alias("at"), name.alias("item"), "bytes").unionByName(groups.where("single").select(F.lit(0).cast("long").alias("at"), "item", "bytes"))
    placed = checkpointed(top.groupBy("at").applyInPandas(_parts(shards), schema).select("item", F.col("part").alias("shard")))
    lump_name = F.encode(F.concat_ws("/", F.lit("lump"), F.col("lump.at").cast("string"), F.col("lump.part").cast("string")), "utf-8")
    by_lump = owner.withColumn("l", lump_name).join(placed.withColumnRenamed("item", "l"), "l").select("item", "shard")
    return by_lump.unionByName(groups.where("single").select("item").join(placed, "item"))


def shard_documents(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text", per_bucket: int = 20_000) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law 'bytes', shard, slot, grown_shard (null).

    Size is the UTF-8 length plus 1. Equal texts share a shard; a null text counts as an empty one, and a null doc_id is
    kept. Ties are broken by text key and doc_id, so repeated rows only swap slots among themselves. An empty table
    gives an empty result; other columns are ignored.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), text_key(body).alias("item"))
    rows = checkpointed(rows)
    n = rows.count()
    groups = rows.groupBy("item").agg(F.sum("size").alias("bytes"))
    placed = rows.join(assign_groups(groups, shards, n, per_bucket), "item")
    ranked = gapless_rank(checkpointed(placed), ["shard"], [F.col("doc_id"), F.col("item")], "slot", n)
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
