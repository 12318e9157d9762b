import os
import struct
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from facetframe.functions import vectors as V
from facetframe.operators import graphs
from facetframe.operators import geometry as G
from facetframe.operators import repair as R
from facetframe.operators import rules
from facetframe.operators import structure as S
from facetframe.plans import bindings
from facetframe.sources import files, sinks
from facetframe.streaming.ingest import ingest

SF = "/root/testdata/sf0.001"
CUBE_V = [(x, y, z) for z in (0.0, 1.0) for y in (0.0, 1.0) for x in (0.0, 1.0)]
CUBE_T = [(0, 2, 1), (1, 2, 3), (4, 5, 6), (5, 7, 6), (0, 1, 4), (1, 5, 4), (2, 6, 3), (3, 6, 7), (0, 4, 2), (2, 4, 6), (1, 3, 5), (3, 7, 5)]


def mesh(spark, v, t):
    tri = spark.createDataFrame([(1, i, *x) for i, x in enumerate(t)], "object_id long, tid long, v1 long, v2 long, v3 long")
    return tri, spark.createDataFrame([(1, i, *x) for i, x in enumerate(v)], "object_id long, vid long, x double, y double, z double")


@pytest.mark.parametrize("name", sorted(bindings.SQL))
def test_binding_equals_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    want = c.sql(bindings.SQL[name])
    got, columns = bindings.QUERIES[name](spark, SF), sorted(want.columns)
    assert columns == sorted(got.columns)
    rows = lambda some: sorted(tuple(map(str, r)) for r in some)
    assert rows(got.select(*[f"`{x}`" for x in columns]).collect()) == rows(want.select(*[duckdb.ColumnExpression(x) for x in columns]).fetchall())


def test_cube(spark):
    t, v = mesh(spark, CUBE_V, CUBE_T)
    m = G.measures(t, v).first()
    assert (m.triangle_count, round(m.area, 9), round(m.volume, 9)) == (12, 6.0, 1.0)
    e = G.edge_summary(t).first()
    assert (e.edges, e.irregular, e.is_manifold) == (18, 0, True)
    assert G.findings(t, v).count() == 0 and G.euler(t).first().euler == 2


def test_open_and_flipped_cube(spark):
    t, v = mesh(spark, CUBE_V, CUBE_T[:-2])
    assert G.findings(t, v).where("code = 4002").count() == 4
    flipped = [(a, c, b) if i == 0 else (a, b, c) for i, (a, b, c) in enumerate(CUBE_T)]
    t, v = mesh(spark, CUBE_V, flipped)
    assert G.findings(t, v).where("code = 4004").count() == 3


def test_islands_and_repair(spark):
    t, v = mesh(spark, [(0.0, 0.0, 0.0)] * 7, [(0, 1, 2), (1, 2, 3), (4, 5, 6), (2, 1, 0), (1, 1, 2)])
    clean = S.unique_faces(S.sound_faces(t))
    assert {r.tid for r in clean.collect()} == {0, 1, 2}
    assert {r.tid: r.island for r in S.islands(clean).collect()} == {0: 0, 1: 0, 2: 2}
    assert {r.tid for r in S.largest_island(clean).collect()} == {0, 1}


def test_resolve_cycle_and_transform(spark):
    one, z = F.lit(1.0), F.lit(0.0)
    move = F.array(one, z, z, z, z, one, z, z, z, z, one, z, F.lit(5.0), z, z, one)
    items = spark.createDataFrame([(1, 10)], "instance_id long, object_id long").withColumn("transform", V.identity())
    parts = spark.createDataFrame([(10, 11), (11, 12), (11, 10)], "object_id long, child_object_id long").withColumn("transform", move)
    leaves, errors = S.resolve(items, parts)
    assert [(r.object_id, r.transform[12], r.depth) for r in leaves.collect()] == [(12, 10.0, 2)]
    assert [r.problem for r in errors.collect()] == ["cycle"]


def test_text_functions(spark):
    d = spark.createDataFrame([(s,) for s in (0, 45, 60, 61, 1895, 3600, 3660, 3661, 7200)], "s long")
    assert [r[0] for r in d.select(V.duration_text(F.col("s"))).collect()] == ["0s", "45s", "1m", "1m 1s", "31m 35s", "1h", "1h 1m", "1h 1m 1s", "2h"]
    assert spark.range(1).select(V.convert_unit(F.lit(1.0), F.lit("inch"), F.lit("millimeter"))).first()[0] == pytest.approx(25.4)


MODEL = """<model unit="millimeter" xmlns="http://schemas.microsoft.com/3dmanufacturing/core/2015/02"><resources><object id="1"><mesh><vertices><vertex x="0" y="0" z="0"/><vertex x="1" y="0" z="0"/><vertex x="0" y="1" z="0"/></vertices><triangles><triangle v1="0" v2="1" v3="2"/></triangles></mesh></object><object id="2"><components><component objectid="1"/></components></object></resources><build><item objectid="2"/></build></model>"""
RELS = """<Relationships><Relationship Id="r" Type="http://schemas.microsoft.com/3dmanufacturing/2013/01/3dmodel" Target="/3D/3dmodel.model"/></Relationships>"""


def write_inputs(folder):
    with zipfile.ZipFile(folder / "a.3mf", "w") as z:
        z.writestr("_rels/.rels", RELS)
        z.writestr("3D/3dmodel.model", MODEL)
    facet = struct.pack("<12fH", 0, 0, 0, 0, 0, 0, 1, 0, 0, 0, 1, 0, 0)
    (folder / "b.stl").write_bytes(b"\0" * 80 + struct.pack("<I", 2) + facet * 2)
    (folder / "c.obj").write_text("v 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf 1 2 3 4\n")
    (folder / "d.3mf").write_bytes(b"PK\x03\x04 broken")


def test_sources_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write_inputs(tmp_path / "in")
    t = files.tables(files.read_files(spark, str(tmp_path / "in")).cache())
    n = {r.path[-5:]: r["count"] for r in t["triangles"].groupBy("path").count().collect()}
    assert n == {"a.3mf": 1, "b.stl": 2, "c.obj": 2}
    assert {r.path[-5:]: r["count"] for r in t["vertices"].groupBy("path").count().collect()} == {"a.3mf": 3, "b.stl": 3, "c.obj": 4}
    assert [r.path[-5:] for r in t["errors"].collect()] == ["d.3mf"] and t["components"].count() == 1
    ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).where("kind = 'triangle'").count() == 5


def test_stl_text(spark):
    t, v = mesh(spark, CUBE_V, CUBE_T[:1])
    assert "facet normal 0.000000e+00 0.000000e+00 -1.000000e+00" in sinks.stl_text(G.corners(t, v)).first().value


def test_packages_and_obj_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write_inputs(tmp_path / "in")
    t = files.tables(files.read_files(spark, str(tmp_path / "in")).cache())
    made = sinks.packages(*[t[n] for n in ("objects", "vertices", "triangles", "components", "items")])
    again = files.tables(files.parse_files(made).cache())
    for name in ("objects", "vertices", "triangles", "components", "items"):
        rows = lambda df: sorted(map(str, df.collect()))
        assert rows(again[name]) == rows(t[name])
    assert again["errors"].where("message <> ''").count() == 0 or {r.message for r in again["errors"].collect()} <= {"no build element"}
    tri, v = mesh(spark, CUBE_V, CUBE_T)
    both = lambda df: df.unionByName(df.withColumn("object_id", F.lit(2).cast("long")))
    lines = [r.value for r in sinks.obj_text(both(v), both(tri)).orderBy("part", "object_id", "seq").collect()]
    back = list(files.obj_rows("\n".join(lines).encode()))
    assert [sum(r[0] == k for r in back) for k in ("object", "vertex", "triangle")] == [2, 16, 24]


def test_harmonize_and_fill(spark):
    flipped = [(a, c, b) if i in (3, 7) else (a, b, c) for i, (a, b, c) in enumerate(CUBE_T)]
    out = R.harmonize(mesh(spark, CUBE_V, flipped)[0]).orderBy("tid").collect()
    assert [r.tid for r in out if r.flipped] == [3, 7] and [(r.v1, r.v2, r.v3) for r in out] == CUBE_T
    t, v = mesh(spark, CUBE_V, CUBE_T[:-2])
    full = R.fill_holes(t)
    assert full.where("added").count() == 2 and G.findings(full, v).count() == 0 and round(G.measures(full, v).first().volume, 9) == 1.0
    assert R.fill_holes(mesh(spark, CUBE_V, CUBE_T)[0]).where("added").count() == 0


def test_fans(spark):
    t, _ = mesh(spark, [(0.0, 0.0, 0.0)] * 5, [(0, 1, 2), (0, 3, 4), (1, 1, 0)])
    assert {r.v: r.fans for r in S.vertex_fans(t).collect()} == {0: 2, 1: 1, 2: 1, 3: 1, 4: 1}


def test_rules(spark):
    make = lambda rows, schema: spark.createDataFrame([("p", *r) for r in rows], "path string, " + schema)
    inf = float("inf")
    model = {
        "objects": make([(1, "model", "mesh", 99, None, None), (2, "other", "components", None, 4, None), (3, "model", "slicestack", None, None, 50), (4, "model", "boolean", 10, None, None), (5, "model", "boolean", None, None, None), (6, "model", "displacement", None, None, None), (7, "model", "boolean", None, None, None)], "object_id long, type string, kind string, pid long, pindex long, ref_id long"),
        "vertices": make([(1, i, float(i % 2), float(i // 2), 0.0) for i in range(4)] + [(6, 0, 0.0, 0.0, 0.0)], "object_id long, vid long, x double, y double, z double"),
        "triangles": make([(1, 0, 0, 1, 2, None, None), (1, 1, 1, 2, 9, 98, None), (1, 2, 3, 3, 1, None, None), (6, 0, 0, 0, 4, None, 77)], "object_id long, tid long, v1 long, v2 long, v3 long, pid long, d1 long").withColumn("d2", F.lit(None).cast("long")).withColumn("d3", F.lit(None).cast("long")),
        "components": make([(2, 0, 1, None), (2, 1, 70, None), (2, 2, 71, "/3D/other.model")], "object_id long, seq long, child_object_id long, part string"),
        "items": make([(0, 1), (1, 2), (2, 80)], "seq long, item_object_id long"),
        "resources": make([(10, "basematerials", None), (11, "compositematerials", 10), (12, "compositematerials", 14), (13, "compositematerials", 97), (14, "multiproperties", None), (15, "multiproperties", None)], "resource_id long, resource string, matid long"),
        "layers": make([(14, 0, 10), (14, 1, 10), (14, 2, 11), (14, 3, 15)], "resource_id long, seq long, pid long"),
        "metadata": make([("",), ("a",), ("a",)], "name string"),
        "booleans": make([(4, 5, [1.0] * 16), (5, 4, [inf] * 16), (7, 2, None)], "object_id long, base_id long, transform array<double>"),
        "operands": make([(7, 0, 4, [1.0]), (7, 1, 96, [float("nan")])], "object_id long, seq long, operand_id long, transform array<double>"),
        "displacements": make([(20, "", inf, 0.0), (21, "x.png", 1.0, 0.0)], "resource_id long, image string, height double, offset double"),
        "attachments": make([("y.png",)], "name string"),
        "normals": make([(6, 0, 2.0, 0.0, 0.0), (6, 1, inf, 0.0, 0.0)], "object_id long, seq long, x double, y double, z double"),
        "gradients": make([(6, 0, 1.0, 0.0, 0.0), (6, 1, inf, 0.0, 0.0)], "object_id long, seq long, x double, y double, z double"),
    }
    found = {}
    for r in rules.validate({k: v for k, v in model.items()}, codes=tuple(c for c in range(2000, 6000) if not 4002 <= c <= 4100)).collect():
        found.setdefault(r.code, set()).add((r.owner, r.element))
    assert found == {
        2001: {(1, "99")}, 2002: {(1, "1")}, 2003: {(2, "70")}, 2004: {(3, "50")}, 2010: {(2, "4")}, 2020: {(14, "2")}, 2024: {(14, "15")}, 2025: {(14, None)},
        2030: {(12, "other resource"), (13, "no resource")}, 2040: {(None, "")}, 2041: {(None, "a")}, 2100: {(4, None), (5, None)}, 2101: {(7, "2")}, 2103: {(7, "4")}, 2104: {(7, "96")}, 2105: {(7, "1")}, 2106: {(5, "4")},
        3001: {(1, "1")}, 3002: {(80, "2")}, 3010: {(2, "1")}, 4001: {(1, "2"), (6, "0")}, 5001: {(20, "")}, 5002: {(21, "x.png")}, 5003: {(20, "Infinity")}, 5012: {(6, "2")}, 5013: {(6, "0")}, 5014: {(6, "0")}, 5015: {(6, "2")}, 5020: {(6, "1")}, 5021: {(6, "0")}, 5022: {(6, "1")}, 5023: {(6, "0")},
    }
    assert {r.code for r in rules.validate(model, "minimal").collect()} == {5012, 5013}


def test_rules_of_geometry_by_package(spark):
    t, v = mesh(spark, CUBE_V + [(9.0, 9.0, 9.0), (9.0, 9.0, 8.0)], [*CUBE_T, (0, 8, 9)])
    objects = spark.createDataFrame([("a", 1, "solidsupport", "mesh"), ("b", 1, "support", "mesh")], "path string, object_id long, type string, kind string")
    add = lambda df: df.withColumn("path", F.explode(F.array(F.lit("a"), F.lit("b"))))
    got = rules.validate({"triangles": add(t), "vertices": add(v), "objects": objects}, codes=(4002, 4003, 4004, 4005, 4006, 4007, 4100)).groupBy("path", "code").count().collect()
    assert {(r.path, r.code): r["count"] for r in got} == {("a", 4002): 3, ("a", 4006): 1, ("a", 4007): 1, ("b", 4100): 1}


def parts(links):
    """The least member of each item's connected part."""
    at = {}

    def root(x):
        while at.setdefault(x, x) != x:
            x = at[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        at[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(at)}


def test_whole_meshes_by_brute_force(spark):
    islands, fans = {}, {}
    objects = {}
    for r in bindings.triangles(spark, SF).collect():
        objects.setdefault(r.object_id, []).append((r.tid, r.v1, r.v2, r.v3))
    for o, faces in objects.items():
        at, around = {}, {}
        links = [(t, at.setdefault(frozenset(e), t)) for t, *v in faces for e in zip(v, v[1:] + v[:1])]
        islands |= {(o, t): i for t, i in parts(links).items()}
        for _, *v in faces:
            for k in range(3) if len(set(v)) == 3 else ():
                around.setdefault(v[k], []).append((v[k - 2], v[k - 1]))
        fans |= {(o, v): len(set(parts(some).values())) for v, some in around.items()}
    assert sum(len(x) for x in objects.values()) == len(islands) == spark.read.parquet(f"{SF}/lineitem.parquet").count() > 12 * len(objects)
    assert {(r.object_id, r.tid): r.island for r in bindings.QUERIES["mesh_islands_whole"](spark, SF).collect()} == islands
    assert {(r.object_id, r.v): r.fans for r in bindings.QUERIES["vertex_fans_whole"](spark, SF).collect()} == fans


def test_islands_of_one_large_object(spark, monkeypatch):
    monkeypatch.setattr(graphs, "SMALL", 100)  # so the object is a large one, which no task may hold
    strip = [(i, i + 1, i + 2) for i in range(400)]
    t, _ = mesh(spark, [(0.0, 0.0, 0.0)], strip[1::2] + strip[::2] + [(900, 901, 902)])
    named = S.islands(t)
    assert {r.tid: r.island for r in named.collect()} == {i: 0 if i < 400 else 400 for i in range(401)}
    assert "InPandas" not in S._linked(t)._jdf.queryExecution().toString()
