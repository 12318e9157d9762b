"""Whole packages: statistics, repair with counts, merging with remapped ids, splitting by what an object needs, names and batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import triangle_area
from . import geometry as G
from . import repair as R
from . import structure as S
from .batches import dealt
from .graphs import checkpointed, reachable

#: Resource kinds in the order in which counts name them.
KINDS = ("basematerials", "colorgroup", "texture2dgroup", "compositematerials", "multiproperties")


def geometry_stats(items: DataFrame, components: DataFrame, triangles: DataFrame, vertices: DataFrame, meshes: DataFrame | None = None) -> DataFrame:
    """items: path, seq, object_id, transform; components: path, object_id, child_object_id, transform; triangles and vertices with path, or meshes: path, object_id, xyz, corners (whole objects, a row each).

    Per package: instances (items), objects, triangles and vertices in all placed copies, area and volume of them. Each
    mesh is measured once; placing it only multiplies.
    """
    key = lambda df, c, name: df.withColumn(name, F.struct("path", F.col(c).alias("id")))
    leaves = key(items, "object_id", "object_id").withColumn("instance_id", F.struct("path", "seq")).select("instance_id", "object_id", "transform")
    if not components.isEmpty():
        leaves, _ = S.resolve(leaves, key(key(components, "object_id", "_o"), "child_object_id", "_c").select(F.col("_o").alias("object_id"), F.col("_c").alias("child_object_id"), "transform"))
    own = G.own_measures(triangles, vertices)
    measured = key(own if meshes is None else own.unionByName(G.mesh_measures(meshes)), "object_id", "object_id").drop("path")
    n = items.count()
    placed = G.placed_measures(dealt(leaves, n, "object_id"), dealt(measured, n, "object_id"))
    per = placed.groupBy(F.col("instance_id.path").alias("path")).agg(F.count(F.lit(1)).alias("objects"), F.sum("triangle_count").alias("triangles"), F.sum("vertex_count").alias("vertices"), F.sum("area").alias("area"), F.sum("volume").alias("volume"))
    return items.groupBy("path").agg(F.count(F.lit(1)).alias("instances")).join(per, "path", "left").fillna(0, ["objects", "triangles", "vertices", "area", "volume"])


def material_stats(resources: DataFrame) -> DataFrame:
    """resources: path, resource. Groups of each kind per package."""
    return resources.groupBy("path").agg(*[F.count_if(F.col("resource") == k).alias(k) for k in KINDS])


def displacement_stats(triangles: DataFrame, normals: DataFrame, gradients: DataFrame) -> DataFrame:
    """Per package: displacement meshes, triangles, displaced ones (with any of d1, d2, d3) and their share in percent, normals, gradients."""
    t = triangles.groupBy("path").agg(F.count_distinct("object_id").alias("meshes"), F.count(F.lit(1)).alias("triangles"), F.count_if(F.coalesce("d1", "d2", "d3").isNotNull()).alias("displaced"))
    of = lambda df, name: df.groupBy("path").agg(F.count(F.lit(1)).alias(name))
    out = t.join(of(normals, "normals"), "path", "left").join(of(gradients, "gradients"), "path", "left").fillna(0, ["normals", "gradients"])
    return out.withColumn("coverage", 100.0 * F.col("displaced") / F.col("triangles"))


def slicer_stats(plates: DataFrame, filaments: DataFrame, warnings: DataFrame) -> DataFrame:
    """plates: path, plate, seconds; filaments: path, plate, grams; warnings: path, plate, text. Per package: print seconds of all plates, warnings in plate order, and filaments and grams of the first plate alone."""
    total = plates.groupBy("path").agg(F.sum("seconds").alias("seconds"), F.min("plate").alias("first"))
    said = warnings.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("plate", "text"))), lambda x: x["text"]).alias("warnings"))
    used = filaments.join(total.select("path", F.col("first").alias("plate")), ["path", "plate"]).groupBy("path").agg(F.count(F.lit(1)).alias("filaments"), F.sum("grams").alias("grams"))
    return total.drop("first").join(said, "path", "left").join(used, "path", "left").withColumn("warnings", F.coalesce("warnings", F.array().cast("array<string>"))).fillna(0, ["filaments", "grams"])


def joined_metadata(metadata: DataFrame) -> DataFrame:
    """metadata: file, name, value. Values of a name over all files in their order, joined with '; '."""
    return metadata.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file", "value"))), lambda x: x["value"]), "; ").alias("value"))


def largest_ids(*tables: DataFrame) -> DataFrame:
    """Tables path, id of every kind. The largest id of each package over all kinds."""
    return reduce(DataFrame.unionByName, tables).groupBy("path").agg(F.max("id").alias("largest"))


def merged(tables: dict[str, DataFrame], ids: dict[str, tuple[str, ...]]) -> dict[str, DataFrame]:
    """tables: path (the file) and rows of each kind; ids: the columns of each table that hold resource ids, the first its own if it is a resource.

    The union of all files as one package: each file's ids, and references to them, move by the sum of the largest id + 1
    of the files before it, so a file's references stay within it.
    """
    own = [df.select("path", F.col(ids[k][0]).alias("id")) for k, df in tables.items() if k in ("objects", "resources")]
    shift = checkpointed(S.merge_offsets(reduce(DataFrame.unionByName, own), "path", "id").select("path", "offset"))

    def moved(name: str, df: DataFrame) -> DataFrame:
        out = df.join(shift, "path", "left")
        for c in ids.get(name, ()):
            out = out.withColumn(c, F.col(c) + F.coalesce("offset", F.lit(0)))
        return out.drop("offset")

    return {k: moved(k, df) for k, df in tables.items()}


def merged_attachments(attachments: DataFrame) -> DataFrame:
    """attachments: file (its number), name, digest. (file, name, new_name, kept): equal path and content are kept once, from the first file; an equal path with other content gets the file's number behind its name."""
    first = attachments.withColumn("_n", F.row_number().over(Window.partitionBy("name", "digest").orderBy("file")))
    lead = attachments.groupBy("name").agg(F.min_by("digest", "file").alias("lead"))
    same = first.groupBy("name", "digest").agg(F.min("file").alias("owner"))
    out = first.join(lead, "name").join(same, ["name", "digest"])
    return out.select("file", "name", F.when(F.col("digest") == F.col("lead"), F.col("name")).otherwise(F.concat_ws(".", "name", "owner")).alias("new_name"), (F.col("_n") == 1).alias("kept"))


def needed(roots: DataFrame, references: DataFrame) -> DataFrame:
    """roots: path, part (the new package), id; references: path, id, target (components, property groups, stacks, boolean operands). (path, part, id, new_id): all that each part needs, numbered 1, 2, ... by old id."""
    node = lambda c: F.struct("path", F.col(c).alias("id"))
    found = reachable(roots.select(F.struct("path", "part").alias("root"), node("id").alias("node")), references.select(node("id").alias("node"), node("target").alias("target")))
    flat = found.select(F.col("root.path").alias("path"), F.col("root.part").alias("part"), F.col("node.id").alias("id"))
    return flat.withColumn("new_id", F.row_number().over(Window.partitionBy("path", "part").orderBy("id")))


def selected(items: DataFrame, selectors: list[str]) -> DataFrame:
    """items: seq (from 0), name. Those that a selector names: a number is a place, anything else part of a name in any case; no selector takes all."""
    if not selectors:
        return items
    hit = [F.col("seq") == int(s) if s.isdigit() else F.coalesce(F.contains(F.lower("name"), F.lit(s.lower())), F.lit(False)) for s in selectors]
    return items.where(reduce(Column.__or__, hit))


def file_names(parts: DataFrame) -> DataFrame:
    """parts: package, seq (from 0), name. File names: letters, digits, '.', '_' and '-' stay, all else is '_'; without a name part_1, part_2, ...; names that come again get _1, _2, ... by seq."""
    plain = F.regexp_replace(F.col("name"), r"[^\p{L}\p{N}._-]", "_")
    base = F.when(F.coalesce(F.length("name"), F.lit(0)) > 0, plain).otherwise(F.concat(F.lit("part_"), F.col("seq") + 1))
    again = F.row_number().over(Window.partitionBy("package", "_base").orderBy("seq")) - 1
    out = parts.withColumn("_base", base).withColumn("_n", again)
    return out.withColumn("file_name", F.when(F.col("_n") == 0, F.col("_base")).otherwise(F.concat_ws("_", "_base", F.col("_n")))).drop("_base", "_n")


def batch_summary(results: DataFrame) -> DataFrame:
    """results: batch, status (ok, skipped, failed)."""
    return results.groupBy("batch").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(n) for s, n in (("ok", "succeeded"), ("skipped", "skipped"), ("failed", "failed"))])


def repair(vertices: DataFrame, triangles: DataFrame, epsilon: float = 1e-4, degenerate: bool = True, duplicates: bool = True, largest_island: bool = False, holes: bool = False, harmonize: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The repairs in their fixed order over all objects: stitch, clean, drop unused vertices, islands, holes, winding.

    Returns vertices (object_id, vid, x, y, z, renumbered densely), triangles (object_id, tid, v1, v2, v3) and counts
    (object_id, vertices_removed, triangles_removed, triangles_added, triangles_flipped). Areas of 1e-9 or less are degenerate.
    """
    count = lambda df, name: df.groupBy("object_id").agg(F.count(F.lit(1)).alias(name))
    faces = ["object_id", "tid", "v1", "v2", "v3"]
    before_v, before_t = count(vertices, "v0"), count(triangles, "t0")
    mapping, now = S.stitch(vertices, triangles.select(*faces), epsilon)
    if degenerate:
        abc = G.point("a"), G.point("b"), G.point("c")
        now = G.corners(S.sound_faces(now), vertices.select("object_id", "vid", "x", "y", "z")).where(triangle_area(*abc) > 1e-9).select(*faces)
    if duplicates:
        now = S.unique_faces(now).select(*faces)
    now = checkpointed(now)
    kept = checkpointed(S.used_vertices(vertices.select("object_id", "vid", "x", "y", "z"), now))
    for v in ("v1", "v2", "v3"):
        now = now.join(kept.select("object_id", F.col("vid").alias(v), F.col("new_vid").cast("long").alias("_new")), ["object_id", v]).withColumn(v, F.col("_new")).drop("_new")
    now = checkpointed(now.select(*faces))
    if largest_island:
        now = checkpointed(S.largest_island(now).select(*faces))
    after_t = count(now, "t1")
    added = flipped = None
    if holes:
        made = checkpointed(R.fill_holes(now))
        now, added = made.select(*faces), count(made.where("added"), "triangles_added")
    if harmonize:
        made = checkpointed(R.harmonize(now))
        now, flipped = made.select(*faces), count(made.where("flipped"), "triangles_flipped")
    out = before_v.join(before_t, "object_id", "full").join(count(kept, "v1"), "object_id", "left").join(after_t, "object_id", "left")
    for df, name in ((added, "triangles_added"), (flipped, "triangles_flipped")):
        out = out.join(df, "object_id", "left") if df is not None else out.withColumn(name, F.lit(0).cast("long"))
    out = out.fillna(0).select("object_id", (F.col("v0") - F.col("v1")).alias("vertices_removed"), (F.col("t0") - F.col("t1")).alias("triangles_removed"), "triangles_added", "triangles_flipped")
    return kept.select("object_id", F.col("new_vid").cast("long").alias("vid"), "x", "y", "z"), now, out


def object_boxes(leaves: DataFrame, boxes: DataFrame) -> DataFrame:
    """leaves: instance_id, object_id, transform (as `structure.resolve` gives them); boxes: object_id, min_x .. max_z. Per instance the box that holds the moved boxes of all its leaves."""
    per = boxes.withColumns({"triangle_count": F.lit(0), "area": F.lit(0.0), "volume": F.lit(0.0)})
    p = G.placed_measures(leaves, per)
    return p.groupBy("instance_id").agg(*[f(f"placed_{n}_{a}").alias(f"{n}_{a}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))])
