"""Repair of meshes: winding and holes. Objects of bounded size are worked on by one task each. In larger ones islands whose windings fit together are turned by labels with a parity, of any size; one task gets what has no such winding."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batches as B
from .graphs import by_size, checkpointed, signed_components

def _schema(triangles: DataFrame, extra: str) -> str:
    return f"object_id {triangles.schema['object_id'].dataType.simpleString()}, tid long, v1 long, v2 long, v3 long, {extra} boolean"


def harmonize(triangles: DataFrame) -> DataFrame:
    """object_id, tid, v1, v2, v3, flipped: each island gets the winding of its least tid."""
    small, large = by_size(triangles.select("object_id", F.col("tid").cast("long").alias("tid"), *[F.col(v).cast("long").alias(v) for v in ("v1", "v2", "v3")]))
    return _turned(small) if large is None else _turned(small).unionByName(_by_parity(large))


def _by_parity(triangles: DataFrame) -> DataFrame:
    """Two triangles at an edge that run along it in the same direction must differ, others agree. Islands with two
    triangles at most at an edge and no contradiction follow from that. In the others windings can't fit; there a walk
    from the least triangle, breadth first, decides: one that runs along a shared edge in the same direction is turned
    (v2 and v3 change places), and an edge is followed once, by the first triangle that reaches it. Only these islands
    are gathered, object by object.
    """
    t = checkpointed(triangles)
    key = F.struct("object_id", "tid")
    ends = F.array(*[F.struct(F.least(p, q).alias("lo"), F.greatest(p, q).alias("hi"), (F.col(p) < F.col(q)).alias("up")) for p, q in (("v1", "v2"), ("v2", "v3"), ("v3", "v1"))])
    sides = checkpointed(t.select("object_id", key.alias("key"), F.explode(ends).alias("e")).select("object_id", "key", "e.lo", "e.hi", "e.up"))
    edges = sides.groupBy("object_id", "lo", "hi").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.min_by("up", "key").alias("p"), F.max_by("up", "key").alias("q"), F.count(F.lit(1)).alias("n"))
    edges = checkpointed(edges)
    links = edges.where("a <> b").select("a", "b", (F.col("p") == F.col("q")).cast("int").alias("odd"))
    crowded = sides.join(edges.where("n > 2").select("object_id", "lo", "hi", "a"), ["object_id", "lo", "hi"]).where("key <> a")
    links = links.unionByName(crowded.select("a", F.col("key").alias("b"), F.lit(0).alias("odd"))).dropDuplicates(["a", "b", "odd"])
    labels, conflicts = signed_components(links)
    labels = checkpointed(labels)
    crowded_labels = edges.where("n > 2").select(F.col("a").alias("key")).distinct().join(labels, "key").select("label")
    repeated = t.where("v1 = v2 or v2 = v3 or v1 = v3").select(key.alias("key")).join(labels, "key").select("label")
    by_walk = checkpointed(conflicts.unionByName(crowded_labels).unionByName(repeated).distinct().withColumn("walk", F.lit(True)))
    named = t.withColumn("key", key).join(labels, "key", "left").join(by_walk, "label", "left")
    turned = F.coalesce(F.col("odd") == 1, F.lit(False))
    plain = named.where("walk is null").select("object_id", "tid", "v1", F.when(turned, F.col("v3")).otherwise(F.col("v2")).alias("v2"), F.when(turned, F.col("v2")).otherwise(F.col("v3")).alias("v3"), turned.alias("flipped"))
    return plain.unionByName(_walked(named.where("walk").select("object_id", "tid", "v1", "v2", "v3")))


def _turned(triangles: DataFrame) -> DataFrame:
    return B.whole(triangles, ("object_id",), ("tid",), _walk, _schema(triangles, "flipped"))


def _walked(triangles: DataFrame) -> DataFrame:
    """Whole objects, object by object in a task, whatever their size."""
    return _turned(triangles.select("object_id", "tid", "v1", "v2", "v3"))


def _walk(pdf: pd.DataFrame, code: np.ndarray) -> pd.DataFrame:
    """The walk of all islands of all objects at once, a level of each at a time. now holds the triangles of a level in the order in which they are met."""
    v, n = pdf[["v1", "v2", "v3"]].to_numpy().copy(), len(pdf)
    edge = B.sides(code, v)[2].reshape(3, n).T
    root = B.least_labels(np.tile(np.arange(n), 3), edge.T.ravel(), n)
    order = np.argsort(edge.ravel(), kind="stable")  # triangles at each edge by tid
    at, begin = order // 3, np.append(np.searchsorted(edge.ravel()[order], np.arange(edge.max(initial=-1) + 1)), 3 * n)
    met, flipped, done = root == np.arange(n), np.zeros(n, bool), np.zeros(len(begin) - 1, bool)
    now = np.flatnonzero(met)
    while len(now):
        turned = flipped[now][:, None]
        e = np.where(turned, edge[now][:, ::-1], edge[now])  # v1-v3-v2: its sides are the third, second and first
        s, t = v[now], v[now][:, [1, 2, 0]]
        e, s, t = e.ravel(), s.ravel(), t.ravel()
        first = np.unique(e, return_index=True)[1]
        first = np.sort(first[~done[e[first]]])
        e, s, t = e[first], s[first], t[first]
        done[e] = True
        many = begin[e + 1] - begin[e]
        j = at[np.repeat(begin[e], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
        s, t = np.repeat(s, many), np.repeat(t, many)
        first = np.unique(j, return_index=True)[1]
        first = np.sort(first[~met[j[first]]])
        now, s, t = j[first], s[first], t[first]
        g = v[now]
        same = ((g == s[:, None]) & (g[:, [1, 2, 0]] == t[:, None])).any(axis=1)
        turn = now[same]
        v[turn] = v[turn][:, [0, 2, 1]]
        flipped[turn], met[now] = True, True
    return pd.DataFrame({"object_id": pdf["object_id"].to_numpy(), "tid": pdf["tid"].to_numpy(), "v1": v[:, 0], "v2": v[:, 1], "v3": v[:, 2], "flipped": flipped})


def fill_holes(triangles: DataFrame) -> DataFrame:
    """object_id, tid, v1, v2, v3, added: with a fan for each closed loop of boundary edges.

    Loops start at their least vertex and run against the triangles at the boundary, so that the fan's winding fits. New
    triangles are numbered after the largest tid. Boundary walks that do not close are left open.
    """

    return B.whole(triangles.select("object_id", F.col("tid").cast("long").alias("tid"), *[F.col(v).cast("long").alias(v) for v in ("v1", "v2", "v3")]), ("object_id",), ("tid",), _filled, _schema(triangles, "added"))


def _filled(pdf: pd.DataFrame, code: np.ndarray) -> pd.DataFrame:
    known = pdf[["v1", "v2", "v3"]].notna().all(axis=1).to_numpy()
    s, e, edge = B.sides(code[known], pdf.loc[known, ["v1", "v2", "v3"]].to_numpy(np.int64))
    keep = np.flatnonzero((s != e) & (np.bincount(edge)[edge] == 1))  # sides at the boundary
    of = np.tile(code[known], 3)[keep]
    order = np.lexsort((-e[keep], -s[keep], of))
    keep, of = keep[order], of[order]
    heads = np.flatnonzero(np.diff(of, prepend=-1)).tolist()
    last = np.searchsorted(code, of[heads], side="right") - 1
    owner, most = pdf["object_id"].to_numpy()[last], pdf["tid"].to_numpy()[last].tolist()
    made, of_made, tids = [], [], []
    start, end = s[keep].tolist(), e[keep].tolist()
    for k, (i, j) in enumerate(zip(heads, [*heads[1:], len(of)])):
        new = _fans(start[i:j], end[i:j])
        made += new
        of_made += [k] * len(new)
        tids += range(most[k] + 1, most[k] + 1 + len(new))
    out = pd.DataFrame(np.array(made, np.int64).reshape(-1, 3), columns=["v1", "v2", "v3"])
    out["object_id"], out["tid"], out["added"] = owner[of_made], tids, True
    faces = ["object_id", "tid", "v1", "v2", "v3", "added"]
    return pd.concat([pdf.assign(added=False)[faces], out[faces]]) if made else pdf.assign(added=False)[faces]


def _fans(start: list[int], end: list[int]) -> list[tuple[int, int, int]]:
    """Triangles of the closed loops of one object's boundary sides, given by descending start and end."""
    after: dict[int, list[int]] = {}
    for a, b in zip(start, end):
        after.setdefault(b, []).append(a)
    made = []
    for begin in sorted(after):
        while after[begin]:
            loop, v = [begin], after[begin].pop()
            while v != begin and after.get(v):
                loop.append(v)
                v = after[v].pop()
            if v == begin and len(loop) >= 3:
                made += [(loop[0], loop[i], loop[i + 1]) for i in range(1, len(loop) - 1)]
    return made
