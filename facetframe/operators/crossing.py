"""Pairs of triangles of one mesh that cross each other: all pairs of small meshes, of others those whose boxes meet in a grid with levels; then planes and intervals decide."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..functions.vectors import shared_vertices
from . import batches as B
from .graphs import large_objects

#: Squared normal under which a triangle is degenerate, distance at which a corner is on a plane, overlap that counts.
FLAT, ON, SLACK = 1e-12, 1e-7, 1e-6
CORNERS = [f"{p}{axis}" for p in "abc" for axis in "xyz"]


def _box(t: DataFrame) -> DataFrame:
    for axis in "xyz":
        t = t.withColumn(f"min_{axis}", F.least(*[f"{p}{axis}" for p in "abc"])).withColumn(f"max_{axis}", F.greatest(*[f"{p}{axis}" for p in "abc"]))
    return t


def box_pairs(boxes: DataFrame, keys: tuple[str, ...], id_: str = "id", closed: bool = True) -> DataFrame:
    """boxes: keys, id, min_x .. max_z. Distinct (keys, a_id < b_id) whose boxes meet (closed), or overlap.

    A box is entered at the level where a cell is as long as its longest side, so in at most 8 cells; it looks for others
    in its own level and in each coarser level that the group has, there too in at most 8 cells. So a large box costs no
    more than a small one.
    """
    side = F.greatest(*[F.col(f"max_{a}") - F.col(f"min_{a}") for a in "xyz"])
    level = F.greatest(F.when(side > 0, F.ceil(F.log2(side))), F.lit(-20)).cast("int")
    own = boxes.withColumn("level", level)
    levels = own.select(*keys, "level").distinct().withColumnRenamed("level", "up")  # few for each group

    def entered(df: DataFrame, at: str) -> DataFrame:
        for a in "xyz":
            cell = lambda e: F.floor(F.col(f"{e}_{a}") / F.pow(F.lit(2.0), F.col(at))).cast("long")  # noqa: B023, E731
            df = df.withColumn(f"c{a}", F.explode(F.sequence(cell("min"), cell("max"))))
        return df

    cells = ["cx", "cy", "cz"]
    edges = [f"{e}_{a}" for e in ("min", "max") for a in "xyz"]
    there = entered(own, "level").select(*keys, F.col("level").alias("up"), *cells, F.col(id_).alias("b_id"), *[F.col(c).alias(f"b_{c}") for c in edges])
    seek = entered(own.join(levels, list(keys)).where("up >= level"), "up").select(*keys, "level", "up", *cells, F.col(id_).alias("a_id"), *edges)
    met = F.lit(True)
    for a in "xyz":
        lo, hi = F.col(f"max_{a}") - F.col(f"b_min_{a}"), F.col(f"b_max_{a}") - F.col(f"min_{a}")
        met = met & ((lo >= 0) & (hi >= 0) if closed else (lo > 0) & (hi > 0))
    first = F.lit(True)  # a pair counts in the least cell that both are entered in
    for a in "xyz":
        first = first & (F.col(f"c{a}") == F.floor(F.greatest(f"min_{a}", f"b_min_{a}") / F.pow(F.lit(2.0), F.col("up"))).cast("long"))
    once = (F.col("level") < F.col("up")) | (F.col("a_id") < F.col("b_id"))
    pairs = seek.join(there, [*keys, "up", *cells]).where(met & first & once & (F.col("a_id") != F.col("b_id")))
    return pairs.select(*keys, F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id"))


def _interval(points: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where triangles cross the other ones' planes. points: coordinates (n, 3 corners) along the common line, d: distances of the corners to the plane. Least and greatest coordinate; NaN where it is less than two places."""
    at = np.full(points.shape, np.nan)
    for k, (i, j) in enumerate(((0, 1), (1, 2), (2, 0))):
        turns = (d[:, i] >= 0) != (d[:, j] >= 0)
        way = d[:, i] / np.where(turns, d[:, i] - d[:, j], 1)
        at[:, k] = np.where(turns, points[:, i] + (points[:, j] - points[:, i]) * way, np.where(np.abs(d[:, i]) < ON, points[:, i], np.nan))
    few = (~np.isnan(at)).sum(axis=1) < 2
    lo, hi = np.where(np.isnan(at), np.inf, at).min(axis=1), np.where(np.isnan(at), -np.inf, at).max(axis=1)
    return np.where(few, np.nan, lo), np.where(few, np.nan, hi)


def triangles_cross(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Which triangles p (n, 3 corners, 3) cross those of q: not if one is degenerate or lies on one side of the other, else if their intervals on the common line overlap."""
    n1, n2 = (np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]) for t in (p, q))
    du = np.einsum("nx,nkx->nk", n2, p) - np.einsum("nx,nx->n", n2, q[:, 0])[:, None]
    dv = np.einsum("nx,nkx->nk", n1, q) - np.einsum("nx,nx->n", n1, p[:, 0])[:, None]
    line = np.abs(np.cross(n1, n2))
    axis = np.where((line[:, 0] > line[:, 1]) & (line[:, 0] > line[:, 2]), 0, np.where(line[:, 1] > line[:, 2], 1, 2))
    along = lambda t: np.take_along_axis(t, axis[:, None, None], axis=2)[:, :, 0]
    apart = lambda d: (d > 0).all(axis=1) | (d < 0).all(axis=1)
    flat = ((n1 * n1).sum(axis=1) < FLAT) | ((n2 * n2).sum(axis=1) < FLAT)
    (lo1, hi1), (lo2, hi2) = _interval(along(p), du), _interval(along(q), dv)
    return ~flat & ~apart(du) & ~apart(dv) & (lo1 + SLACK < hi2) & (lo2 + SLACK < hi1)


@F.pandas_udf(BooleanType())
def _cross(corners: pd.DataFrame) -> pd.Series:
    both = corners.to_numpy(float).reshape(len(corners), 2, 3, 3)
    return pd.Series(triangles_cross(both[:, 0], both[:, 1]))


#: Rows up to which all pairs of an object's triangles are tried within a task; boxes of larger objects meet in the grid.
ALL_PAIRS = 500


def self_intersections(corners: DataFrame) -> DataFrame:
    """corners: object_id, tid, v1, v2, v3, ax .. cz. (object_id, a_tid < b_tid) of triangles that cross and share fewer than two vertices."""
    one = corners.select("object_id", "tid", "v1", "v2", "v3", *[F.col(c).cast("double").alias(c) for c in CORNERS])
    large = large_objects(one, keys=("object_id",), most=ALL_PAIRS)
    rows = one if large is None else one.join(large, "object_id", "left_anti")
    kinds = dict(one.dtypes)
    made = B.whole(rows, ("object_id",), ("tid",), _crossing_pairs, f"object_id {kinds['object_id']}, a_tid {kinds['tid']}, b_tid {kinds['tid']}")
    return made if large is None else made.unionByName(_by_grid(one.join(large, "object_id", "left_semi")))


def _crossing_pairs(pdf: pd.DataFrame, code: np.ndarray) -> pd.DataFrame:
    a, b = crossing_rows(code, pdf[["v1", "v2", "v3"]].to_numpy(), pdf[CORNERS].to_numpy(float).reshape(-1, 3, 3))
    tid = pdf["tid"].to_numpy()
    return pd.DataFrame({"object_id": pdf["object_id"].to_numpy()[a], "a_tid": tid[a], "b_tid": tid[b]})


def crossing_rows(code: np.ndarray, v: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows, the earlier first, of triangles (v: vertices, p: corners) of one object that cross and share fewer than two vertices."""
    low, high, found = p.min(axis=1), p.max(axis=1), []
    for a, b in B.pairs(code):
        near = ((low[a] <= high[b]) & (low[b] <= high[a])).all(axis=1)
        a, b = a[near], b[near]
        apart = (v[a][:, :, None] == v[b][:, None, :]).sum(axis=(1, 2)) < 2
        a, b = a[apart], b[apart]
        cross = triangles_cross(p[a], p[b])
        found.append((a[cross], b[cross]))
    return tuple(np.concatenate([x[k] for x in found]) if found else np.empty(0, np.int64) for k in (0, 1))


def _by_grid(one: DataFrame) -> DataFrame:
    pairs = box_pairs(_box(one), ("object_id",), "tid")
    for side in ("a", "b"):
        pairs = pairs.join(one.select("object_id", F.col("tid").alias(f"{side}_id"), *[F.col(c).alias(f"{side}_{c}") for c in ("v1", "v2", "v3", *CORNERS)]), ["object_id", f"{side}_id"])
    shared = shared_vertices(*[[F.col(f"{side}_v{i}") for i in (1, 2, 3)] for side in "ab"])
    return pairs.where(shared < 2).where(_cross(F.struct(*[f"{side}_{c}" for side in "ab" for c in CORNERS]))).select("object_id", F.col("a_id").alias("a_tid"), F.col("b_id").alias("b_tid"))
