"""Structure of packages: references, component trees, islands, overlap, repair, comparison, merge and placement."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions.vectors import matmul
from .batches import dealt, together
from .graphs import by_size, checkpointed, components

MAX_DEPTH = 16


def dangling(children: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose non-null reference has no target."""
    return children.where(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def resolve(items: DataFrame, components: DataFrame, max_depth: int = MAX_DEPTH) -> tuple[DataFrame, DataFrame]:
    """items: instance_id, object_id, transform; components: object_id, child_object_id, transform.

    Returns (leaves, errors): leaves are placed objects without components, with their matrix (parent x child) and depth;
    errors are paths that meet an object again or go deeper than max_depth. One join per level, at most max_depth + 1.
    """
    leaves = errors = None
    parents = components.select("object_id").distinct()
    step = components.select("object_id", F.col("child_object_id").alias("child"), F.col("transform").alias("move"))
    now = items.select("instance_id", "object_id", "transform", F.array("object_id").alias("path"))
    for depth in range(max_depth + 2):
        leaf = now.join(parents, "object_id", "left_anti").select("instance_id", "object_id", "transform", F.lit(depth).alias("depth"))
        leaves = leaf if leaves is None else leaves.unionByName(leaf)
        below = now.join(step, "object_id").select("instance_id", F.col("child").alias("object_id"), matmul(F.col("transform"), F.col("move")).alias("transform"), "path")
        seen = F.array_contains("path", F.col("object_id"))
        bad = below.where(seen | F.lit(depth >= max_depth)).select("instance_id", "object_id", F.when(seen, "cycle").otherwise("depth").alias("problem"))
        errors = bad if errors is None else errors.unionByName(bad)
        if depth >= max_depth:
            break
        now = below.where(~seen).withColumn("path", F.array_append("path", F.col("object_id")))
        if depth % 4 == 3:
            now = checkpointed(now)
            if now.isEmpty():
                break
    return leaves, errors


def islands(triangles: DataFrame) -> DataFrame:
    """(object_id, tid, island): triangles connected by shared edges; an island is named by its least tid.

    Objects of bounded size are labelled within tasks, many at once. In others the least triangle at each edge is linked with those
    there, and labels move along links, so an object may be of any size.
    """
    small, large = by_size(triangles.select("object_id", F.col("tid").cast("long").alias("tid"), *[F.col(v).cast("long").alias(v) for v in ("v1", "v2", "v3")]))
    made = together(small, ("object_id",), ("tid",)).mapInPandas(_labelled_batches, f"object_id {triangles.schema['object_id'].dataType.simpleString()}, tid long, island long")
    return made if large is None else made.unionByName(_linked(large))


def _labelled_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by object, labelled in batches of whole objects."""
    held = None
    for batch in batches:
        held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if len(held):
            cut = int(np.argmax(held["object_id"].to_numpy() == held["object_id"].iloc[-1]))
            if cut:
                yield _labelled(held.iloc[:cut])
                held = held.iloc[cut:].reset_index(drop=True)
    if held is not None and len(held):
        yield _labelled(held)


def _labelled(pdf: pd.DataFrame) -> pd.DataFrame:
    """pdf: triangles of whole objects, sorted by object and tid."""
    v, n = pdf[["v1", "v2", "v3"]].to_numpy(), len(pdf)
    code = np.tile(pd.factorize(pdf["object_id"])[0], 3)
    sides = np.sort(np.concatenate([v[:, [0, 1]], v[:, [1, 2]], v[:, [2, 0]]]), axis=1)
    order = np.lexsort((sides[:, 1], sides[:, 0], code))
    new = np.ones(3 * n, bool)
    new[1:] = (np.diff(code[order]) != 0) | (np.diff(sides[order], axis=0) != 0).any(axis=1)
    edge = np.empty(3 * n, np.int64)
    edge[order] = np.cumsum(new) - 1
    face, label = np.tile(np.arange(n), 3), np.arange(n)
    while True:
        least = np.full(int(new.sum()), n)
        np.minimum.at(least, edge, label[face])
        after = label.copy()
        np.minimum.at(after, face, least[edge])
        after = after[after]
        if (after == label).all():
            tid = pdf["tid"].to_numpy()
            return pd.DataFrame({"object_id": pdf["object_id"].to_numpy(), "tid": tid, "island": tid[label]})
        label = after


def _linked(triangles: DataFrame) -> DataFrame:
    ends = F.array(*[F.struct(F.least(p, q).alias("lo"), F.greatest(p, q).alias("hi")) for p, q in (("v1", "v2"), ("v2", "v3"), ("v3", "v1"))])
    sides = checkpointed(triangles.select("object_id", "tid", F.explode(ends).alias("e")))
    least = sides.groupBy("object_id", "e").agg(F.min("tid").alias("first"))
    links = sides.join(least, ["object_id", "e"]).where("tid <> first").select(F.struct("object_id", F.col("first").alias("tid")).alias("a"), F.struct("object_id", "tid").alias("b")).distinct()
    labels = components(links).select(F.col("key.object_id").alias("object_id"), F.col("key.tid").alias("tid"), F.col("label.tid").alias("island"))
    return triangles.select("object_id", "tid").join(labels, ["object_id", "tid"], "left").select("object_id", "tid", F.coalesce("island", "tid").alias("island"))


@F.pandas_udf(IntegerType())
def _fans(links: pd.Series) -> pd.Series:
    def parts(some) -> int:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for pair in some:
            a, b = root(pair["a"]), root(pair["b"])
            parent[max(a, b)] = min(a, b)
        return len({root(x) for x in list(parent)})

    return links.map(parts)


def vertex_fans(triangles: DataFrame) -> DataFrame:
    """(object_id, v, fans): groups of triangles at each vertex that are connected by edges at that vertex. Triangles with a repeated vertex are left out.

    What is gathered for a vertex are the distinct edges opposite to it.
    """
    turns = F.array(*[F.struct(F.col(v).alias("v"), F.least(a, b).alias("a"), F.greatest(a, b).alias("b")) for v, a, b in (("v1", "v2", "v3"), ("v2", "v3", "v1"), ("v3", "v1", "v2"))])
    at = sound_faces(triangles).select("object_id", F.explode(turns).alias("t")).select("object_id", "t.v", "t.a", "t.b")
    return at.groupBy("object_id", "v").agg(F.collect_set(F.struct("a", "b")).alias("links")).select("object_id", "v", _fans("links").alias("fans"))


def largest_island(triangles: DataFrame) -> DataFrame:
    """Triangles of each object's largest island; of equal ones the one with the least tid."""
    named = islands(triangles)
    best = named.groupBy("object_id", "island").agg(F.count(F.lit(1)).alias("n")).groupBy("object_id").agg(F.max_by("island", F.struct("n", -F.col("island"))).alias("island"))
    return triangles.join(named.join(best, ["object_id", "island"]).select("object_id", "tid"), ["object_id", "tid"])


def _crosses(a: str, b: str, closed: bool) -> Column:
    out = F.lit(True)
    for axis in "xyz":
        lo, hi = F.col(f"{a}.min_{axis}") , F.col(f"{b}.max_{axis}")
        lo2, hi2 = F.col(f"{b}.min_{axis}"), F.col(f"{a}.max_{axis}")
        out = out & ((lo <= hi) & (lo2 <= hi2) if closed else (lo < hi) & (lo2 < hi2))
    return out


def box_overlaps(boxes: DataFrame, cell: float, closed: bool = True, keys: tuple[str, ...] = ()) -> DataFrame:
    """boxes: id, min_x..max_z and `keys`. Pairs (a_id < b_id) that overlap, found through grid cells.

    A box is entered in each cell it covers; a pair counts only in the least cell that both cover, so none comes twice.
    """
    at = lambda c: F.floor(F.col(c) / cell).cast("long")
    cells = boxes
    for axis in "xyz":
        cells = cells.withColumn(f"c{axis}", F.explode(F.sequence(at(f"min_{axis}"), at(f"max_{axis}"))))
    a, b = cells.alias("a"), cells.alias("b")
    on = F.col("a.id") < F.col("b.id")
    for c in (*keys, "cx", "cy", "cz"):
        on = on & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    first = F.lit(True)
    for axis in "xyz":
        first = first & (F.col(f"a.c{axis}") == F.floor(F.greatest(f"a.min_{axis}", f"b.min_{axis}") / cell).cast("long"))
    return a.join(b, on & first & _crosses("a", "b", closed)).select(*[F.col(f"a.{k}") for k in keys], F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"))


def stitch(vertices: DataFrame, triangles: DataFrame, epsilon: float) -> tuple[DataFrame, DataFrame]:
    """Vertices of one grid cell become the first of them. Returns (mapping object_id, vid, kept), triangles remapped. An epsilon of 0 or less leaves all as it is."""
    if epsilon <= 0:
        return vertices.select("object_id", "vid", F.col("vid").alias("kept")), triangles
    cell = [F.round(F.col(axis) * (1.0 / epsilon)).cast("long").alias(f"c{axis}") for axis in "xyz"]
    keyed = vertices.select("object_id", "vid", *cell)
    first = keyed.groupBy("object_id", "cx", "cy", "cz").agg(F.min("vid").alias("kept"))
    mapping = keyed.join(first, ["object_id", "cx", "cy", "cz"]).select("object_id", "vid", "kept")
    out = triangles
    for v in ("v1", "v2", "v3"):
        out = out.join(mapping.select("object_id", F.col("vid").alias(v), F.col("kept").alias("_k")), ["object_id", v]).withColumn(v, F.col("_k")).drop("_k")
    return mapping, out


def unique_faces(triangles: DataFrame) -> DataFrame:
    """Of triangles with the same three vertices, in any order, the one with the least tid."""
    sorted_ = triangles.withColumn("_f", F.sort_array(F.array("v1", "v2", "v3")))
    least = Window.partitionBy("object_id", "_f0", "_f1", "_f2").orderBy("tid")
    return sorted_.withColumns({f"_f{i}": F.col("_f")[i] for i in range(3)}).withColumn("_n", F.row_number().over(least)).where("_n = 1").drop("_f", "_f0", "_f1", "_f2", "_n")


def sound_faces(triangles: DataFrame) -> DataFrame:
    return triangles.where("v1 <> v2 and v2 <> v3 and v1 <> v3")


def used_vertices(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """Vertices in use with a dense new index in the old order.

    Vertices and triangles are dealt by object in one shuffle and meet in one sort, so a task keeps no table of ids. The triangles are counted for that.
    """
    own = [c for c in vertices.columns if c not in ("object_id", "vid")]
    none = F.lit(None)
    named = vertices.select("object_id", F.col("vid").alias("v1"), none.alias("v2"), none.alias("v3"), F.lit(True).alias("_own"), *own)
    rows = named.unionByName(triangles.select("object_id", "v1", "v2", "v3", F.lit(False).alias("_own")), allowMissingColumns=True)
    each = dealt(rows, triangles.count(), "object_id").select("object_id", F.explode(F.array_distinct(F.array("v1", "v2", "v3"))).alias("vid"), "_own", *own).where("object_id is not null and vid is not null")
    met = each.withColumn("_all", F.min("_own").over(Window.partitionBy("object_id", "vid"))).where("_own and not _all")
    return met.select("object_id", F.col("vid").cast(vertices.schema["vid"].dataType).alias("vid"), *own, (F.row_number().over(Window.partitionBy("object_id").orderBy("vid")) - 1).alias("new_vid"))


def compare(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Rows that differ: key, left_value, right_value, change (added, removed, changed)."""
    a, b = left.select(key, F.col(value).alias("left_value"), F.lit(1).alias("_l")), right.select(key, F.col(value).alias("right_value"), F.lit(1).alias("_r"))
    change = F.when(F.col("_l").isNull(), "added").when(F.col("_r").isNull(), "removed").otherwise("changed")
    return a.join(b, key, "full_outer").where(F.col("_l").isNull() | F.col("_r").isNull() | ~F.col("left_value").eqNullSafe(F.col("right_value"))).select(key, "left_value", "right_value", change.alias("change"))


def merge_offsets(ids: DataFrame, file: str, id_: str) -> DataFrame:
    """How far each file's ids move so that no two files share one: the running sum of the largest id + 1 of the files before."""
    top = ids.groupBy(file).agg((F.max(id_) + 1).alias("span"))
    return running_sum(top, file, "span", "offset")


def running_sum(rows: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """rows with the sum of `value` of all rows before them by `order` (unique). Sums within ranges of `order` meet the sums of the ranges before; no task has all rows."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(rows.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()))
    before = lambda by, at: F.coalesce(F.sum(at).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.sum(at).over(by.rowsBetween(0, 0)) * 0)
    sums = ranged.groupBy("_part").agg(F.sum(value).alias("_s"))  # a row for each partition
    shift = sums.select("_part", before(Window.orderBy("_part"), "_s").alias("_shift"))
    within = ranged.withColumn("_w", before(Window.partitionBy("_part").orderBy(order), value))
    return within.join(F.broadcast(shift), "_part").withColumn(name, F.col("_w") + F.col("_shift")).drop("_part", "_w", "_shift")


def compact_ids(ids: DataFrame, group: str, id_: str) -> DataFrame:
    return ids.select(group, id_, F.row_number().over(Window.partitionBy(group).orderBy(id_)).alias("new_id"))


def grid_places(items: DataFrame, order: str, width: str, gap: float, n: int, height: str | None = None) -> DataFrame:
    """Column, row and x offset (with `height`, y too) of items in a square grid; a column is as wide as its widest item, a row as high as its highest."""
    columns = max(1, int(-(-(n**0.5) // 1)))
    cells = running_sum(items.withColumn("_one", F.lit(1)), order, "_one", "_s").withColumn("col", F.col("_s") % columns).withColumn("row", F.floor(F.col("_s") / columns).cast("long")).drop("_s", "_one")

    def offsets(by: str, size: str, name: str) -> DataFrame:
        most = cells.groupBy(by).agg((F.max(size) + gap).cast("double").alias("_w"))  # about sqrt(n) of them
        return running_sum(most, by, "_w", name).select(by, name)

    placed = cells.join(offsets("col", width, "x"), "col")
    return placed.join(offsets("row", height, "y"), "row") if height else placed


