"""Geometry of mesh objects: corners, measures, edges and the checks that follow from them.

triangles: object_id, tid, v1, v2, v3; vertices: (object_id,) vid, x, y, z. Where vertices have no object_id they are
shared by all objects. Each object is measured once however often it is placed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import determinant, point, signed_volume, transform_point, triangle_area
from . import batches as B
from .graphs import by_size, large_objects


def corners(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """Triangles with ax..cz: three equi-joins, which Spark broadcasts or sort-merges by the vertices' size. Vertices of objects of their own are never broadcast, as they are as many as the triangles."""
    keys = ["object_id"] if "object_id" in vertices.columns else []
    out = triangles
    for name, v in (("a", "v1"), ("b", "v2"), ("c", "v3")):
        one = vertices.select(*keys, F.col("vid").alias(v), *[F.col(axis).cast("double").alias(f"{name}{axis}") for axis in "xyz"])
        out = out.join(one.hint("merge") if keys else one, [*keys, v])
    return out


def measures(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """Per object: triangles, area, signed volume and bounding box of the corners in use."""
    t = corners(triangles, vertices)
    abc = point("a"), point("b"), point("c")
    return t.groupBy("object_id").agg(
        F.count(F.lit(1)).alias("triangle_count"), F.sum(triangle_area(*abc)).alias("area"), F.sum(signed_volume(*abc)).alias("volume"),
        *[F.min(F.least(*[p[i] for p in abc])).alias(f"min_{axis}") for i, axis in enumerate("xyz")],
        *[F.max(F.greatest(*[p[i] for p in abc])).alias(f"max_{axis}") for i, axis in enumerate("xyz")],
    )


BOX = ["min_x", "min_y", "min_z", "max_x", "max_y", "max_z"]


def own_measures(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """path, object_id (text) and what `measures` gives, with vertex_count. Triangles and vertices of objects of bounded size are shuffled once and measured within tasks."""
    keys = ["path", "object_id"]
    t = triangles.select(*keys, *[F.col(v).cast("long").alias(v) for v in ("v1", "v2", "v3")])
    v = vertices.select(*keys, F.col("vid").cast("long").alias("vid"), *[F.col(a).cast("double").alias(a) for a in "xyz"])
    large = large_objects(t, v, keys=tuple(keys))
    small = lambda df: df if large is None else df.join(large, keys, "left_anti")
    none = lambda kind, *names: [F.lit(0).cast(kind).alias(n) for n in names]
    rows = small(v).select(*keys, F.lit(0).alias("tag"), F.col("vid").alias("v1"), *none("long", "v2", "v3"), *"xyz").unionByName(small(t).select(*keys, F.lit(1).alias("tag"), "v1", "v2", "v3", *none("double", *"xyz")))
    types = ", ".join(f"{k} {dict(t.dtypes)[k]}" for k in keys)
    made = B.whole(rows, tuple(keys), ("tag",), _measured, f"{types}, triangle_count long, area double, volume double, {', '.join(f'{b} double' for b in BOX)}, vertex_count long")
    if large is None:
        return made
    keyed = lambda df: df.join(large, keys, "left_semi").withColumn("object_id", F.struct(*keys)).drop("path")
    big = measures(keyed(t), keyed(v)).join(keyed(v).groupBy("object_id").agg(F.count(F.lit(1)).alias("vertex_count")), "object_id", "left")
    return made.unionByName(big.select("object_id.*", *[c for c in big.columns if c != "object_id"]))


def _measured(pdf: pd.DataFrame, code: np.ndarray) -> pd.DataFrame:
    tag = pdf["tag"].to_numpy()
    own, face = np.flatnonzero(tag == 0), np.flatnonzero(tag == 1)
    v, of = pdf[["v1", "v2", "v3"]].to_numpy(), code[face]
    points = np.array(pdf[["x", "y", "z"]].to_numpy(), float)[own]
    at = B.places(np.repeat(of, 3), v[face].astype(np.int64).ravel(), code[own], v[own, 0].astype(np.int64)).reshape(-1, 3)
    there = (at >= 0).all(axis=1)
    of, p = of[there], points[at[there]]
    heads, numbers = _sums(of, p)
    out = pdf.iloc[np.searchsorted(code, of[heads])][["path", "object_id"]].reset_index(drop=True)
    for name, x in zip(["triangle_count", "area", "volume", *BOX], numbers):
        out[name] = x
    out["vertex_count"] = np.bincount(code[own], minlength=int(code[-1]) + 1)[of[heads]]
    return out[["path", "object_id", "triangle_count", "area", "volume", *BOX, "vertex_count"]]


def mesh_measures(meshes: DataFrame) -> DataFrame:
    """What own_measures gives, of meshes that are a row each: path, object_id, xyz (array of coordinates), corners (array of vertices by place). Nothing is shuffled."""
    types = ", ".join(f"{k} {dict(meshes.dtypes)[k]}" for k in ("path", "object_id"))
    return meshes.select("path", "object_id", "xyz", "corners").mapInArrow(_mesh_measured, f"{types}, triangle_count long, area double, volume double, {', '.join(f'{b} double' for b in BOX)}, vertex_count long")


def _mesh_measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not len(batch):
            continue
        xyz, corners = batch.column("xyz"), batch.column("corners")
        sizes = lambda x: np.diff(x.offsets.to_numpy()) // 3
        held, n = sizes(xyz), sizes(corners)
        points, v = np.array(xyz.flatten(), float).reshape(-1, 3), np.array(corners.flatten(), np.int64).reshape(-1, 3)
        of = np.repeat(np.arange(len(batch)), n)
        there = ((v >= 0) & (v < held[of][:, None])).all(axis=1)
        of, v = of[there], v[there]
        heads, numbers = _sums(of, points[v + (np.cumsum(held) - held)[of][:, None]])
        rows = of[heads]
        columns = [batch.column(c).take(pa.array(rows)) for c in ("path", "object_id")] + [pa.array(x) for x in numbers] + [pa.array(held[rows].astype(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, names=["path", "object_id", "triangle_count", "area", "volume", *BOX, "vertex_count"])


def _sums(of: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The first triangle of each object that has any, and its count, area, volume and box; of: the triangles' objects, in order, p: their corners."""
    a, b, c = p[:, 0], p[:, 1], p[:, 2]
    n = np.cross(b - a, c - a)
    heads = np.flatnonzero(np.diff(of, prepend=-1))
    by = lambda f, x: f.reduceat(x, heads) if len(heads) else x[:0]
    low, high = p.min(axis=1), p.max(axis=1)
    box = [by(np.minimum, low[:, i]) for i in range(3)] + [by(np.maximum, high[:, i]) for i in range(3)]
    return heads, [by(np.add, np.ones(len(of), np.int64)), by(np.add, np.sqrt((n * n).sum(axis=1)) * 0.5), by(np.add, (a * np.cross(b, c)).sum(axis=1) / 6.0), *box]


def directed_edges(triangles: DataFrame) -> DataFrame:
    pairs = F.array(*[F.struct(F.col(a).alias("s"), F.col(b).alias("e")) for a, b in (("v1", "v2"), ("v2", "v3"), ("v3", "v1"))])
    return triangles.select("object_id", "tid", F.explode(pairs).alias("p")).select("object_id", "tid", "p.s", "p.e")


def edge_counts(triangles: DataFrame) -> DataFrame:
    """Triangles at each undirected edge."""
    return directed_edges(triangles).groupBy("object_id", F.least("s", "e").alias("lo"), F.greatest("s", "e").alias("hi")).agg(F.count(F.lit(1)).alias("n"))


def edge_summary(triangles: DataFrame) -> DataFrame:
    """Per object: edges, boundary (1 triangle), non-manifold (more than 2), those with other than 2, and whether all have 2."""
    n = F.col("n")
    return edge_counts(triangles).groupBy("object_id").agg(F.count(F.lit(1)).alias("edges"), F.count_if(n == 1).alias("boundary"), F.count_if(n > 2).alias("non_manifold"), F.count_if(n != 2).alias("irregular"), F.bool_and(n == 2).alias("is_manifold"))


def repeated_directed_edges(triangles: DataFrame) -> DataFrame:
    return directed_edges(triangles).groupBy("object_id", "s", "e").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def euler(triangles: DataFrame) -> DataFrame:
    """Per object: vertices in use, edges, faces, Euler characteristic."""
    used = triangles.select("object_id", F.explode(F.array("v1", "v2", "v3")).alias("v")).distinct().groupBy("object_id").agg(F.count(F.lit(1)).alias("vertices"))
    edges = edge_counts(triangles).groupBy("object_id").agg(F.count(F.lit(1)).alias("edges"))
    faces = triangles.groupBy("object_id").agg(F.count(F.lit(1)).alias("faces"))
    return used.join(edges, "object_id").join(faces, "object_id").withColumn("euler", F.col("vertices") - F.col("edges") + F.col("faces"))


def findings(triangles: DataFrame, vertices: DataFrame, min_area: float = 1e-6) -> DataFrame:
    """Codes 4001 to 4005 as (object_id, code, element, n): element is the tid, or the edge as text."""
    one = lambda df, code, element, n: df.select("object_id", F.lit(code).alias("code"), element.cast("string").alias("element"), n.cast("long").alias("n"))
    thin = corners(triangles, vertices).where(triangle_area(point("a"), point("b"), point("c")) < min_area)
    small, large = by_size(triangles.select("object_id", F.col("tid").cast("long").alias("tid"), *[F.col(v).cast("long").alias(v) for v in ("v1", "v2", "v3")]))
    made = B.whole(small, ("object_id",), ("tid",), _found, f"object_id {dict(triangles.dtypes)['object_id']}, code int, element string, n long").unionByName(one(thin, 4005, F.col("tid"), F.lit(1)))
    if large is None:
        return made
    edges, edge = edge_counts(large), F.concat_ws("-", "lo", "hi")
    repeated = large.where("v1 = v2 or v2 = v3 or v1 = v3")
    return (
        made.unionByName(one(repeated, 4001, F.col("tid"), F.lit(1))).unionByName(one(edges.where("n = 1"), 4002, edge, F.col("n"))).unionByName(one(edges.where("n > 2"), 4003, edge, F.col("n")))
        .unionByName(one(repeated_directed_edges(large), 4004, F.concat_ws("-", "s", "e"), F.col("n")))
    )


def _found(pdf: pd.DataFrame, code: np.ndarray) -> pd.DataFrame:
    found = edge_findings(code, pdf["tid"].to_numpy(), pdf[["v1", "v2", "v3"]].to_numpy())
    row = np.concatenate([r for _, r, _, _ in found])
    return pd.DataFrame({"object_id": pdf["object_id"].to_numpy()[row], "code": np.repeat([c for c, *_ in found], [len(r) for _, r, _, _ in found]), "element": [x for *_, some, _ in found for x in some], "n": np.concatenate([n for *_, n in found])})


def edge_findings(code: np.ndarray, tid: np.ndarray, v: np.ndarray) -> list[tuple[int, np.ndarray, list[str], np.ndarray]]:
    """Rules 4001 to 4004 over triangles of whole objects: code, a row of the object for each finding, element, count."""
    ends = lambda a, b: [f"{x}-{y}" for x, y in zip(a.tolist(), b.tolist())]
    same = np.flatnonzero((v == v[:, [1, 2, 0]]).any(axis=1))
    s, e = v.T.ravel(), v[:, [1, 2, 0]].T.ravel()
    lo, hi, of = np.minimum(s, e), np.maximum(s, e), np.tile(code, 3)
    out = [(4001, same, list(map(str, tid[same].tolist())), np.ones(len(same), np.int64))]
    edge, first = B.numbered(of, lo, hi)
    n = np.bincount(edge)
    for rule, hit in ((4002, n == 1), (4003, n > 2)):
        out.append((rule, first[hit] % len(v), ends(lo[first[hit]], hi[first[hit]]), n[hit]))
    side, first = B.numbered(of, s, e)
    n = np.bincount(side)
    first, n = first[n > 1], n[n > 1]
    return [*out, (4004, first % len(v), ends(s[first], e[first]), n)]


def placed_measures(instances: DataFrame, per_object: DataFrame) -> DataFrame:
    """instances: instance_id, object_id, transform. Area by |det|^(2/3), volume by |det|, box of the 8 moved corners of the local box."""
    d = F.abs(determinant(F.col("transform")))
    j = instances.join(per_object, "object_id")
    box = [transform_point(F.col("transform"), (F.col(f"{x}_x"), F.col(f"{y}_y"), F.col(f"{z}_z"))) for x in ("min", "max") for y in ("min", "max") for z in ("min", "max")]
    moved = [F.least(*[p[i] for p in box]).alias(f"placed_min_{a}") for i, a in enumerate("xyz")] + [F.greatest(*[p[i] for p in box]).alias(f"placed_max_{a}") for i, a in enumerate("xyz")]
    return j.select("instance_id", "object_id", "triangle_count", (F.col("area") * F.pow(d, 2 / 3)).alias("area"), (F.col("volume") * d).alias("volume"), *moved, *[c for c in ("vertex_count",) if c in per_object.columns])
