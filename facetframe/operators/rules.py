"""The rules of a package model as a table: code, severity, level and the rows that break it.

A model is a dict of tables, each with `path` (the package), so that one run judges all packages:
objects (object_id, type, kind, pid, pindex, ref_id), vertices (object_id, vid, x, y, z), triangles (object_id, tid, v1, v2,
v3, pid, d1, d2, d3), components (object_id, seq, child_object_id, part), items (seq, item_object_id), resources
(resource_id, resource, matid), layers (resource_id, seq, pid), metadata (name), booleans (object_id, base_id, transform),
operands (object_id, seq, operand_id, transform), displacements (resource_id, image, height, offset), attachments (name),
normals and gradients (object_id, seq, x, y, z). `kind` is mesh, components, slicestack, volumetricstack, boolean or
displacement. units (unit) is asked for by none, but scales the area of rule 4005. A rule is left out where one of its
tables is. Rules 4002 to 4008 are for objects of type model and solidsupport, 4100 for the others.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import UNIT_METRES
from . import batches as B
from . import crossing as X
from . import geometry as G
from . import structure as S
from .graphs import checkpointed, large_objects

LEVELS = {"minimal": 0, "standard": 1, "strict": 2, "paranoid": 3}
Model = dict[str, DataFrame]


class Rule(NamedTuple):
    code: int
    severity: str
    level: str
    tables: tuple[str, ...]
    find: Callable[[Model], DataFrame]


def _found(df: DataFrame, owner: str, element: str | Column) -> DataFrame:
    element = F.col(element) if isinstance(element, str) else element
    return df.select("path", F.col(owner).cast("long").alias("owner"), element.cast("string").alias("element"))


def _ids(df: DataFrame, column: str) -> DataFrame:
    return df.select("path", F.col(column).cast("long").alias("_id"))


def _all_ids(m: Model) -> DataFrame:
    return _ids(m["objects"], "object_id").unionByName(_ids(m["resources"], "resource_id"))


def _missing(child: DataFrame, ref: str, ids: DataFrame) -> DataFrame:
    """Rows of child whose reference is set and not among the ids of its package."""
    return child.where(F.col(ref).isNotNull()).withColumn("_id", F.col(ref).cast("long")).join(ids.distinct(), ["path", "_id"], "left_anti")


def _target(child: DataFrame, ref: str, objects: DataFrame) -> DataFrame:
    """child with _type and _kind of the object that it refers to."""
    return child.join(objects.select("path", F.col("object_id").alias(ref), F.col("type").alias("_type"), F.col("kind").alias("_kind")), ["path", ref])


def _not_finite(x: Column) -> Column:
    return F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(False))


def _layers(m: Model) -> DataFrame:
    return m["layers"].join(m["resources"].select("path", F.col("resource_id").alias("pid"), "resource"), ["path", "pid"])


def _layer_count(resource: str) -> Callable[[Model], DataFrame]:
    def find(m: Model) -> DataFrame:
        n = _layers(m).where(F.col("resource") == resource).groupBy("path", "resource_id").agg(F.count(F.lit(1)).alias("n"))
        return _found(n.where("n > 1"), "resource_id", "n")

    return find


def _two_materials(m: Model) -> DataFrame:
    has = lambda r: F.bool_or(F.col("resource") == r)
    both = _layers(m).groupBy("path", "resource_id").agg((has("basematerials") & has("compositematerials")).alias("both"))
    return _found(both.where("both"), "resource_id", F.lit(None))


def _stack(kind: str) -> Callable[[Model], DataFrame]:
    return lambda m: _found(_missing(m["objects"].where(F.col("kind") == kind), "ref_id", _ids(m["resources"].where(F.col("resource") == kind), "resource_id")), "object_id", "ref_id")


def _composite_base(m: Model) -> DataFrame:
    r = m["resources"]
    bad = _missing(r.where("resource = 'compositematerials'"), "matid", _ids(r.where("resource = 'basematerials'"), "resource_id"))
    known = bad.join(_all_ids(m).distinct().withColumnRenamed("_id", "matid").withColumn("_known", F.lit(True)), ["path", "matid"], "left")
    return _found(known, "resource_id", F.when(F.col("_known"), "other resource").otherwise("no resource"))


def boolean_cycles(m: Model) -> DataFrame:
    """Boolean objects on a cycle of references, or between two cycles: what is left once objects without a way in or out are peeled off.

    A round is two semi-joins over the edges that are left; there are as many rounds as the longest chain has objects.
    """
    edges = m["booleans"].select("path", "object_id", F.col("base_id").alias("ref")).unionByName(m["operands"].select("path", "object_id", F.col("operand_id").alias("ref"))).distinct()
    n, left = -1, checkpointed(edges)
    while True:
        sources, targets = left.select("path", F.col("object_id").alias("ref")).distinct(), left.select("path", F.col("ref").alias("object_id")).distinct()
        left = checkpointed(left.join(sources, ["path", "ref"], "left_semi").join(targets, ["path", "object_id"], "left_semi").select("path", "object_id", "ref"))
        now = left.count()
        if now in (0, n):
            return _found(left.select("path", "object_id").distinct(), "object_id", F.lit(None))
        n = now


def _out_of_range(displaced: bool) -> Callable[[Model], DataFrame]:
    def find(m: Model) -> DataFrame:
        n = m["vertices"].groupBy("path", "object_id").agg(F.count(F.lit(1)).alias("n"))
        of = m["objects"].where(F.col("kind") == ("displacement" if displaced else "mesh")).select("path", "object_id")
        t = m["triangles"].join(of, ["path", "object_id"], "left_semi").join(n, ["path", "object_id"], "left")
        return _found(t.where(F.greatest("v1", "v2", "v3") >= F.coalesce("n", F.lit(0))), "object_id", "tid")

    return find


def _counts(m: Model, *names: str) -> DataFrame:
    """Displacement meshes with the number of rows each has in the tables named."""
    out = m["objects"].where("kind = 'displacement'").select("path", "object_id")
    for name in names:
        out = out.join(m[name].groupBy("path", "object_id").agg(F.count(F.lit(1)).alias(name)), ["path", "object_id"], "left")
    return out.fillna(0, list(names))


def _displacement_index(m: Model) -> DataFrame:
    d = m["triangles"].select("path", "object_id", "tid", F.explode(F.array("d1", "d2", "d3")).alias("d"))
    return _found(_missing(d, "d", _ids(m["resources"].where("resource = 'displacement2d'"), "resource_id")), "object_id", "tid")


def _keyed(df: DataFrame) -> DataFrame:
    """object_id and path in one text, for the geometry of many packages at once."""
    return df.withColumn("object_id", F.to_json(F.struct(F.col("path"), F.col("object_id"))))


def _unkeyed(df: DataFrame, element: str | Column) -> DataFrame:
    at = F.from_json("object_id", "path string, object_id long")
    return _found(df.select("*", at["path"].alias("path"), at["object_id"].alias("_owner")), "_owner", element)


def _of_types(m: Model, table: str, solid: bool) -> DataFrame:
    """Rows of mesh objects that must be closed (model, solidsupport, and where no type is given), or of the others."""
    is_solid = F.coalesce(F.col("type"), F.lit("model")).isin("model", "solidsupport")
    return m[table].join(m["objects"].where(is_solid if solid else ~is_solid).select("path", "object_id"), ["path", "object_id"], "left_semi")


def _edges(condition: str) -> Callable[[Model], DataFrame]:
    return lambda m: _unkeyed(G.edge_counts(_keyed(_of_types(m, "triangles", True))).where(condition), F.concat_ws("-", "lo", "hi"))


def _thin(m: Model) -> DataFrame:
    """Area under 1e-12 square metres, in the package's unit (a millimetre where m has no units)."""
    t = G.corners(_keyed(_of_types(m, "triangles", True)), _keyed(m["vertices"]).drop("path"))
    area = G.triangle_area(G.point("a"), G.point("b"), G.point("c"))
    if "units" not in m:
        return _unkeyed(t.where(area < 1e-6).drop("path"), "tid")
    metres = F.create_map(*[x for k, v in UNIT_METRES.items() for x in (F.lit(k), F.lit(v))])
    scale = F.coalesce(F.try_element_at(metres, F.col("unit")), F.lit(UNIT_METRES["millimeter"]))
    return _unkeyed(t.join(m["units"].select("path", "unit"), "path", "left").where(area < 1e-12 / (scale * scale)).drop("path"), "tid")


def _several_islands(m: Model) -> DataFrame:
    n = S.islands(_keyed(_of_types(m, "triangles", True))).groupBy("object_id").agg(F.count_distinct("island").alias("n"))
    return _unkeyed(n.where("n > 1"), "n")


def _crossing(m: Model) -> DataFrame:
    t = G.corners(_keyed(_of_types(m, "triangles", True)), _keyed(m["vertices"]).drop("path"))
    n = X.self_intersections(t).groupBy("object_id").agg(F.count(F.lit(1)).alias("n"))
    return _unkeyed(n, "n")


def _loose_types(m: Model) -> DataFrame:
    n = G.edge_counts(_keyed(_of_types(m, "triangles", False))).where("n <> 2").groupBy("object_id").agg(F.count(F.lit(1)).alias("n"))
    return _unkeyed(n, "n")


#: Rules on the geometry of one object at a time: objects of bounded size are judged by all of them in one pass.
BY_OBJECT = (4001, 4002, 4003, 4004, 4005, 4006, 4007, 4008, 4100)
#: Rows (triangles and vertices) up to which an object counts as small.
ALL_RULES = 1000


def _by_object(m: Model, codes: list[int]) -> tuple[DataFrame, Model | None]:
    """(path, code, owner, element) of small objects by the rules of `codes`, and the model of the large ones (None if there are none). One shuffle brings an object's rows together."""
    keys = ["path", "object_id"]
    t, v = m["triangles"], m["vertices"].select(*keys, "vid", *"xyz") if {4005, 4008} & set(codes) else None
    large = large_objects(*[df for df in (t, v) if df is not None], keys=tuple(keys), most=ALL_RULES)
    small = lambda df: df if large is None else df.join(large, keys, "left_anti")
    row = lambda df, tag, longs, doubles: df.select("path", F.col("object_id").cast("long").alias("object_id"), F.lit(tag).alias("tag"), *[x.cast("long").alias(n) for x, n in zip(longs, ("id", "v1", "v2", "v3"))], *[x.cast("double").alias(n) for x, n in zip(doubles, "xyz")])
    zero = F.lit(0)
    rows = row(small(t), 2, [F.col(c) for c in ("tid", "v1", "v2", "v3")], [zero] * 3)
    if v is not None:
        rows = rows.unionByName(row(small(v).where("vid is not null"), 1, [F.col("vid"), zero, zero, zero], [F.col(c) for c in "xyz"]))
    if "objects" in m:
        o = m["objects"].select(*keys, F.coalesce(F.col("type"), F.lit("model")).isin("model", "solidsupport").alias("solid"))
        least = F.lit(1e-6)
        if "units" in m:
            metres = F.create_map(*[x for k, u in UNIT_METRES.items() for x in (F.lit(k), F.lit(u))])
            scale = F.coalesce(F.try_element_at(metres, F.col("unit")), F.lit(UNIT_METRES["millimeter"]))
            o, least = o.join(m["units"].select("path", "unit").distinct(), "path", "left"), 1e-12 / (scale * scale)
        rows = rows.unionByName(row(o, 0, [F.col("solid"), zero, zero, zero], [least, zero, zero]))
    found = B.whole(rows, ("path", "object_id"), ("tag", "id"), partial(_judged, tuple(codes)), "path string, code int, owner long, element string")
    if large is None:
        return found, None
    return found, m | {k: m[k].join(large, keys, "left_semi") for k in ("triangles", "vertices") if k in m}


def _judged(codes: tuple[int, ...], pdf: pd.DataFrame, code: np.ndarray) -> pd.DataFrame:
    tag, n = pdf["tag"].to_numpy(), int(code[-1]) + 1
    ids, v = pdf["id"].to_numpy(), pdf[["v1", "v2", "v3"]].to_numpy()
    number = np.searchsorted(code, np.arange(n))  # a row of each object
    thing, point, face = (np.flatnonzero(tag == k) for k in (0, 1, 2))
    solid, loose, least = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n)
    solid[code[thing[ids[thing] == 1]]], loose[code[thing[ids[thing] == 0]]] = True, True
    least[code[thing]] = pdf["x"].to_numpy()[thing]
    found: list[tuple[int, np.ndarray, list[str]]] = []  # code, objects, elements
    of, tid, v = code[face], ids[face], v[face]
    found += [(4001, of[r], x) for c, r, x, _ in G.edge_findings(of, tid, v) if c == 4001] if 4001 in codes else []
    if 4100 in codes:
        keep = loose[of]
        edge, first = B.numbered(*_undirected(of[keep], v[keep]))
        odd = np.bincount(np.tile(of[keep], 3)[first[np.bincount(edge) != 2]], minlength=n)
        found.append((4100, np.flatnonzero(odd), list(map(str, odd[odd > 0].tolist()))))
    keep = solid[of]
    of, tid, v = of[keep], tid[keep], v[keep]
    if {4002, 4003, 4004} & set(codes):
        found += [(c, of[r], x) for c, r, x, _ in G.edge_findings(of, tid, v) if c != 4001]
    if 4006 in codes:
        found.append((4006, *_several_fans(of, v)))
    if 4007 in codes:
        edge = B.numbered(*_undirected(of, v))[0]
        heads = B.least_labels(np.tile(np.arange(len(of)), 3), edge, len(of)) == np.arange(len(of))
        islands = np.bincount(of[heads], minlength=n)
        found.append((4007, np.flatnonzero(islands > 1), list(map(str, islands[islands > 1].tolist()))))
    if {4005, 4008} & set(codes):
        at = B.places(np.repeat(of, 3), v.ravel(), code[point], ids[point]).reshape(-1, 3)
        there = (at >= 0).all(axis=1)
        of, tid, v, p = of[there], tid[there], v[there], np.array(pdf[["x", "y", "z"]].to_numpy(), float)[point][at[there]]
        normal = np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0])
        thin = np.sqrt(normal[:, 0] * normal[:, 0] + normal[:, 1] * normal[:, 1] + normal[:, 2] * normal[:, 2]) * 0.5 < least[of]
        found.append((4005, of[thin], list(map(str, tid[thin].tolist()))))
        if 4008 in codes:
            cuts = np.bincount(of[X.crossing_rows(of, v, p)[0]], minlength=n)
            found.append((4008, np.flatnonzero(cuts), list(map(str, cuts[cuts > 0].tolist()))))
    found = [x for x in found if x[0] in codes]
    row = number[np.concatenate([of for _, of, _ in found])]
    return pd.DataFrame({"path": pdf["path"].to_numpy()[row], "code": np.repeat([c for c, *_ in found], [len(x) for *_, x in found]), "owner": pdf["object_id"].to_numpy()[row], "element": [x for *_, some in found for x in some]})


def _undirected(of: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    s, e = v.T.ravel(), v[:, [1, 2, 0]].T.ravel()
    return np.tile(of, 3), np.minimum(s, e), np.maximum(s, e)


def _several_fans(of: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Vertices at which triangles without a repeated vertex are in more than one group connected by edges: their objects, and themselves as text."""
    sound = (v != v[:, [1, 2, 0]]).all(axis=1)
    of, v = np.tile(of[sound], 3), v[sound]
    at, a, b = (v[:, turn].T.ravel() for turn in ([0, 1, 2], [1, 2, 0], [2, 0, 1]))
    node, first = B.numbered(np.tile(of, 2), np.tile(at, 2), np.concatenate([a, b]))
    label = B.least_labels(node, np.tile(np.arange(len(of)), 2), len(first))
    heads = first[label == np.arange(len(label))] % max(1, len(of))  # one for each fan
    vertex, one = B.numbered(of[heads], at[heads])
    several = one[np.bincount(vertex) > 1] if len(heads) else one
    return of[heads][several], list(map(str, at[heads][several].tolist()))


def _vector(table: str, condition: Column) -> Callable[[Model], DataFrame]:
    return lambda m: _found(m[table].where(condition), "object_id", "seq")


def _rules() -> tuple[Rule, ...]:
    E, W, I = "error", "warning", "info"  # noqa: E741
    bad_vector = _not_finite(F.col("x")) | _not_finite(F.col("y")) | _not_finite(F.col("z"))
    bad_matrix = F.exists("transform", _not_finite)
    off_unit = ~bad_vector & (F.abs(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2) - 1) > 1e-4)
    std, par = "standard", "paranoid"
    known, mesh, typed = ("objects", "resources"), ("triangles", "vertices"), ("objects", "triangles")
    objects = lambda m: _ids(m["objects"], "object_id")
    return (
        Rule(2001, E, std, known, lambda m: _found(_missing(m["objects"], "pid", _all_ids(m)), "object_id", "pid")),
        Rule(2002, E, std, (*known, "triangles"), lambda m: _found(_missing(m["triangles"], "pid", _all_ids(m)), "object_id", "tid")),
        Rule(2003, E, std, ("objects", "components"), lambda m: _found(_missing(m["components"].where("part is null"), "child_object_id", objects(m)), "object_id", "child_object_id")),
        Rule(2004, E, std, known, _stack("slicestack")),
        Rule(2005, E, std, known, _stack("volumetricstack")),
        Rule(2010, E, std, ("objects",), lambda m: _found(m["objects"].where("pindex is not null and pid is null"), "object_id", "pindex")),
        *(Rule(2020 + i, E, std, ("layers", "resources"), _layer_count(r)) for i, r in enumerate(("basematerials", "colorgroup", "texture2dgroup", "compositematerials"))),
        Rule(2024, E, std, ("layers", "resources"), lambda m: _found(_layers(m).where("resource = 'multiproperties'"), "resource_id", "pid")),
        Rule(2025, E, std, ("layers", "resources"), _two_materials),
        Rule(2030, E, std, known, _composite_base),
        Rule(2040, E, std, ("metadata",), lambda m: _found(m["metadata"].where("name = ''").withColumn("_o", F.lit(None)), "_o", "name")),
        Rule(2041, E, std, ("metadata",), lambda m: _found(m["metadata"].groupBy("path", "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("_o", F.lit(None)), "_o", "name")),
        Rule(2100, E, std, ("booleans", "operands"), boolean_cycles),
        Rule(2101, E, std, ("objects", "booleans"), lambda m: _found(_target(m["booleans"], "base_id", m["objects"]).where("_kind = 'components'"), "object_id", "base_id")),
        Rule(2102, E, std, ("objects", "booleans"), lambda m: _found(_missing(m["booleans"], "base_id", objects(m)), "object_id", "base_id")),
        Rule(2103, E, std, ("objects", "operands"), lambda m: _found(_target(m["operands"], "operand_id", m["objects"]).where("_kind <> 'mesh'"), "object_id", "operand_id")),
        Rule(2104, E, std, ("objects", "operands"), lambda m: _found(_missing(m["operands"], "operand_id", objects(m)), "object_id", "operand_id")),
        Rule(2105, E, std, ("operands",), lambda m: _found(m["operands"].where(bad_matrix), "object_id", "seq")),
        Rule(2106, E, std, ("booleans",), lambda m: _found(m["booleans"].where(bad_matrix), "object_id", "base_id")),
        Rule(3001, E, std, ("objects", *mesh), _out_of_range(False)),
        Rule(3002, E, std, ("objects", "items"), lambda m: _found(_missing(m["items"], "item_object_id", objects(m)), "item_object_id", "seq")),
        Rule(3010, E, std, ("objects", "items"), lambda m: _found(_target(m["items"], "item_object_id", m["objects"]).where("_type = 'other'"), "item_object_id", "seq")),
        Rule(4001, W, par, ("triangles",), lambda m: _found(m["triangles"].where("v1 = v2 or v2 = v3 or v1 = v3"), "object_id", "tid")),
        Rule(4002, W, par, typed, _edges("n = 1")),
        Rule(4003, W, par, typed, _edges("n > 2")),
        Rule(4004, W, par, typed, lambda m: _unkeyed(G.repeated_directed_edges(_keyed(_of_types(m, "triangles", True))), F.concat_ws("-", "s", "e"))),
        Rule(4005, W, par, ("objects", *mesh), _thin),
        Rule(4006, W, par, typed, lambda m: _unkeyed(S.vertex_fans(_keyed(_of_types(m, "triangles", True))).where("fans > 1"), "v")),
        Rule(4007, W, par, typed, _several_islands),
        Rule(4008, W, par, ("objects", *mesh), _crossing),
        Rule(4100, I, par, ("objects", "triangles"), _loose_types),
        Rule(5001, E, std, ("displacements",), lambda m: _found(m["displacements"].where("image = ''"), "resource_id", "image")),
        Rule(5002, W, std, ("displacements", "attachments"), lambda m: _found(m["displacements"].where("image <> ''").join(m["attachments"].select("path", F.col("name").alias("image")), ["path", "image"], "left_anti"), "resource_id", "image")),
        Rule(5003, E, par, ("displacements",), lambda m: _found(m["displacements"].where(_not_finite(F.col("height"))), "resource_id", "height")),
        Rule(5004, E, par, ("displacements",), lambda m: _found(m["displacements"].where(_not_finite(F.col("offset"))), "resource_id", "offset")),
        Rule(5010, E, "minimal", ("objects", "vertices"), lambda m: _found(_counts(m, "vertices").where("vertices = 0"), "object_id", "vertices")),
        Rule(5011, E, "minimal", ("objects", "triangles"), lambda m: _found(_counts(m, "triangles").where("triangles = 0"), "object_id", "triangles")),
        Rule(5012, E, "minimal", ("objects", "vertices", "normals"), lambda m: _found(_counts(m, "vertices", "normals").where("vertices <> normals"), "object_id", "normals")),
        Rule(5013, E, "minimal", ("objects", *mesh, "normals"), _out_of_range(True)),
        Rule(5014, E, std, ("triangles", "resources", "normals"), _displacement_index),
        Rule(5015, E, std, ("objects", "vertices", "gradients"), lambda m: _found(_counts(m, "vertices", "gradients").where("gradients > 0 and vertices <> gradients"), "object_id", "gradients")),
        Rule(5020, E, par, ("normals",), _vector("normals", bad_vector)),
        Rule(5021, W, par, ("normals",), _vector("normals", off_unit)),
        Rule(5022, E, par, ("gradients",), _vector("gradients", bad_vector)),
        Rule(5023, I, par, ("gradients",), _vector("gradients", (F.col("seq") == 0) & ~bad_vector)),
    )


def validate(model: Model, level: str = "paranoid", codes: tuple[int, ...] = ()) -> DataFrame:
    """(path, code, severity, owner, element): what breaks the rules up to `level`, or those of `codes` alone."""
    wanted = [r for r in _rules() if LEVELS[r.level] <= LEVELS[level] and set(r.tables) <= set(model) and (not codes or r.code in codes)]
    if not wanted:
        raise ValueError("no rule fits the tables given")
    found, large = [], None
    by_object = [r for r in wanted if r.code in BY_OBJECT]
    if by_object:
        small, large = _by_object(model, [r.code for r in by_object])
        severity = F.create_map(*[F.lit(x) for r in by_object for x in (r.code, r.severity)])
        found = [small.select("path", "code", severity[F.col("code")].alias("severity"), "owner", "element")]
    for r in wanted:
        m = model if r.code not in BY_OBJECT else large
        if m is not None:
            found.append(r.find(m).select("path", F.lit(r.code).alias("code"), F.lit(r.severity).alias("severity"), "owner", "element"))
    return reduce(DataFrame.unionByName, found)
