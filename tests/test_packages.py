import io
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from facetframe.functions.vectors import part_subtype
from facetframe.operators import crossing, graphs, packages, repair, rules, structure
from facetframe.plans import bindings, models
from facetframe.sources import files, sinks, vendor

SF = "/root/testdata/sf0.001"
MESH = '<mesh><vertices><vertex x="0" y="0" z="0"/><vertex x="1" y="0" z="0"/><vertex x="0" y="1" z="0"/><vertex x="0" y="0" z="1"/></vertices><triangles><triangle v1="0" v2="2" v3="1" pid="5" p1="0"/><triangle v1="0" v2="1" v3="3"/><triangle v1="1" v2="2" v3="3"/><triangle v1="2" v2="0" v3="3"/></triangles></mesh>'
ROOT = f"""<model unit="inch" xmlns="{sinks.CORE}" xmlns:p="p" xmlns:s="s"><metadata name="Title">x</metadata><metadata name="Title">y</metadata><resources>
<basematerials id="5"><base name="a" displaycolor="#FF0000"/><base name="b" displaycolor="#00FF00"/></basematerials>
<colorgroup id="6"><color color="#010203"/></colorgroup><multiproperties id="7" pids="5 5 6"><multi pindices="0 0"/></multiproperties>
<slicestack id="8"><slice ztop="1"><vertices><vertex x="9" y="9"/><vertex x="8" y="8"/></vertices><polygon start="0"><segment v2="1"/></polygon></slice></slicestack>
<object id="1" type="model" pid="5">{MESH}</object><object id="2" slicestackid="8" type="support">{MESH}</object>
<object id="3"><components><component objectid="1" transform="2 0 0 0 2 0 0 0 2 0 0 0"/><component p:path="/3D/more.model" objectid="1"/></components></object><object id="4" slicestackid="99" pindex="1"/>
</resources><build><item objectid="3"/><item objectid="3" printable="0"/><item objectid="77"/></build></model>"""
PART = f'<model xmlns="{sinks.CORE}"><resources><object id="1">{MESH.replace("1", "1")}</object></resources><build/></model>'


def package(extra=(), rels=sinks.RELS):
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w") as z:
        for name, text in (("[Content_Types].xml", sinks.TYPES), ("_rels/.rels", rels), ("3D/3dmodel.model", ROOT), ("3D/more.model", PART), *extra):
            z.writestr(name, text)
    return content.getvalue()


@pytest.fixture(scope="module")
def rows(spark):
    twice = sinks.RELS.replace("</Relationships>", f'<Relationship Id="r2" Type="{sinks.MODEL_TYPE}" Target="/3D/more.model"/></Relationships>')
    return files.parse_files(spark.createDataFrame([("a", bytearray(package())), ("b", bytearray(package(rels=twice)))], "path string, content binary")).cache()


def test_parts_kinds_and_children(rows):
    t = files.tables(rows)
    got = {(r.part, r.object_id): r for r in t["objects"].where("path = 'a'").collect()}
    assert {k: (r.kind, r.ref_id, r.type) for k, r in got.items()} == {(None, 1): ("mesh", None, "model"), (None, 2): ("slicestack", 8, "support"), (None, 3): ("components", None, "model"), (None, 4): ("slicestack", 99, "model"), ("3D/more.model", 1): ("mesh", None, "model")}
    assert {(r.part, r.object_id): r["count"] for r in t["vertices"].where("path = 'a'").groupBy("part", "object_id").count().collect()} == {(None, 1): 4, (None, 2): 4, ("3D/more.model", 1): 4}
    assert [(r.pid, r.p1) for r in t["triangles"].where("part is null and object_id = 1 and tid = 0").collect()] == [(5, 0)]
    assert [(r.object_id, r.seq, r.name) for r in t["base"].where("path = 'a'").orderBy("seq").collect()] == [(5, 0, "a"), (5, 1, "b")]
    assert {r.target_part for r in t["components"].where("path = 'a'").collect()} == {None, "3D/more.model"}
    assert [r.message for r in t["errors"].collect()] == ["2 model relationships"] and t["slice"].where("path = 'a'").count() == 1 and t["content_types"].count() == 4


def test_what_is_read_can_be_judged(rows):
    found = {(r.code, r.owner) for r in rules.validate(files.model(rows.where("path = 'a'"))).collect()}
    assert {(2004, 4), (2010, 4), (2020, 7), (2041, None), (3002, 77)} <= found and not {c for c, _ in found} & {4002, 4003, 4004, 3001, 2001}


def test_statistics_across_parts(rows):
    r = packages.geometry_stats(*files.geometry(rows.where("path = 'a'"))).collect()[0]
    one = 1.5 + math.sqrt(3) / 2
    assert (r.instances, r.objects, r.triangles, r.vertices) == (2, 2, 8, 8) and abs(r.area - 5 * one) < 1e-6 and abs(abs(r.volume) - 9 / 6) < 1e-6


def test_settings_of_slicers(spark):
    extra = [
        (vendor.SLICE_INFO, '<config><header><header_item key="X-BBL-Client-Version" value="2.1"/></header><plate><metadata key="prediction" value="61"/><filament id="1" used_g="2.5" type="PLA"/><warning msg="w"/></plate><plate><metadata key="prediction" value="9"/><filament id="2" used_g="7"/></plate></config>'),
        (vendor.MODEL_SETTINGS, '<config><object id="4"><metadata key="name" value="Gear"/><metadata face_count="12"/><part id="1" subtype="odd"><metadata key="k" value="v"/></part></object><plate><metadata key="plater_id" value="1"/><model_instance><metadata key="object_id" value="4"/></model_instance></plate></config>'),
        (vendor.PROJECT_SETTINGS, '{"bed_type": "a", "curr_bed_type": "b", "machine_start_gcode": "G1", "nozzle_diameter": ["0.4"]}'),
        ("Metadata/machine_settings_3.config", '{"name": "M", "inherits": "Base"}'), ("Metadata/machine_settings_16.config", "{}"), ("Metadata/process_settings_1.config", "no json"),
    ]
    rows = files.parse_files(spark.createDataFrame([("a", bytearray(package(extra)))], "path string, content binary")).cache()
    r = packages.slicer_stats(*vendor.slicer_tables(rows)).collect()[0]
    assert (r.seconds, r.warnings, r.filaments, r.grams) == (70, ["w"], 1, 2.5)
    assert vendor.slicer_versions(rows).collect()[0].slicer_version == "BambuStudio-2.1" and vendor.printer_models(rows).collect()[0].printer_model == "Base"
    assert [(x.plate, x.object_id, x.name) for x in vendor.plate_objects(rows).collect()] == [(0, 4, "Gear")]
    project = rows.where("kind = 'projectsettings'").select(F.get_json_object("payload", "$.bed_type").alias("b"), F.get_json_object("payload", "$.machine_start_gcode").alias("g")).collect()[0]
    assert (project.b, project.g) == ("b", None) and rows.where("kind = 'profile'").count() == 1
    assert rows.where("kind = 'settingspart'").select(part_subtype(F.get_json_object("payload", "$.subtype")).alias("s")).collect()[0].s == "other"


def test_materials_of_obj_files(spark):
    obj = "mtllib m.mtl\nv 0 0 0\nv 1 0 0\nv 0 1 0\nv 1 1 0\nusemtl red\nf 1 2 3\nusemtl none\nf 1 2 4\ng other\nusemtl red\nf 2 3 4\nf 1 2\n"
    mtl = "newmtl red\nKd 1.5 0 0.5\nnewmtl grey\nmap_Kd x.png\n"
    rows = files.parse_files(spark.createDataFrame([("d/a.obj", bytearray(obj, "utf-8")), ("d/m.mtl", bytearray(mtl, "utf-8")), ("e/b.obj", bytearray(obj.replace("f 1 2 3", "f -1 2 3"), "utf-8"))], "path string, content binary")).cache()
    got = sorted((r.object_id, r.tid, r.material, r.color, r.material_index) for r in vendor.used_materials(rows).where("path = 'd/a.obj'").collect())
    assert got == [(1, 0, "red", "#FF0080FF", 0), (1, 1, "none", None, 1), (2, 0, "red", "#FF0080FF", 0)]
    assert [(r.path, r.kind) for r in rows.where("kind = 'error'").collect()] == [("e/b.obj", "error")]


def test_archives_are_copied_whole(spark):
    one = spark.createDataFrame([("a", bytearray(package([("Metadata/x.bin", "bytes")])))], "path string, content binary")
    again = sinks.archives(sinks.entries(one))
    read = lambda df: sorted((r.path, r.name, bytes(r.content)) for r in sinks.entries(df).collect())
    assert read(again) == read(one) and [r.name for r in sinks.entries(one, "Metadata/.*").collect()] == ["Metadata/x.bin"]


def test_stl_files_are_read_back(spark, rows):
    t = spark.createDataFrame([("x.stl", k, *map(float, range(k, k + 9))) for k in range(5)], "path string, tid long, " + ", ".join(f"{p}{a} double" for p in "abc" for a in "xyz"))
    back = files.tables(files.parse_files(sinks.stl_binary(t)))
    assert back["triangles"].count() == 5 and back["errors"].count() == 0
    lines = sinks.stl_lines(t.withColumn("object_id", F.lit(1))).orderBy("object_id", "tid").collect()
    again = files.tables(files.parse_files(spark.createDataFrame([("y.stl", bytearray("\n".join(r.value for r in lines), "utf-8"))], "path string, content binary")))
    assert again["triangles"].count() == 5 and lines[0].value.startswith("solid") and lines[-1].value.startswith("endsolid")
    six = "solid a\nfacet normal 0 0 0\nouter loop\n" + "vertex 0 0 0\n" * 6 + "endloop\nendfacet\nendsolid a"
    assert files.tables(files.parse_files(spark.createDataFrame([("z.stl", bytearray(six, "utf-8"))], "path string, content binary")))["errors"].count() == 1


def test_crossing_triangles_by_hand(spark):
    flat, through, beside = [(0, 0, 0), (4, 0, 0), (0, 4, 0)], [(1, 1, -1), (1, 1, 1), (2, 1, 1)], [(9, 9, 9), (10, 9, 9), (9, 10, 9)]
    make = lambda tid, p, v: (1, tid, *v, *[float(x) for q in p for x in q])
    rows = [make(0, flat, (0, 1, 2)), make(1, through, (3, 4, 5)), make(2, beside, (6, 7, 8)), make(3, through, (0, 1, 9)), make(4, [(0, 0, 0)] * 3, (10, 11, 12))]
    c = spark.createDataFrame(rows, "object_id long, tid long, v1 long, v2 long, v3 long, " + ", ".join(f"{p}{a} double" for p in "abc" for a in "xyz"))
    assert sorted((r.a_tid, r.b_tid) for r in crossing.self_intersections(c).collect()) == [(0, 1), (1, 3)]


def test_boxes_of_all_sizes_meet(spark):
    import random

    r = random.Random(4)
    boxes = []
    for i in range(150):
        low, size = [r.uniform(-50, 50) for _ in "xyz"], 10 ** r.uniform(-3, 2)
        boxes.append((1, i, *low, *[x + r.uniform(0, size) for x in low]))
    df = spark.createDataFrame(boxes, "g int, id long, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double")
    want = {(a[1], b[1]) for a in boxes for b in boxes if a[1] < b[1] and all(a[2 + k] <= b[5 + k] and b[2 + k] <= a[5 + k] for k in range(3))}
    got = [(x.a_id, x.b_id) for x in crossing.box_pairs(df, ("g",)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_signed_components(spark):
    links = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (3, 4, 0), (7, 8, 1), (8, 9, 1), (9, 7, 1)], "a long, b long, odd int")
    labels, conflicts = graphs.signed_components(links)
    assert {(r.key, r.label, r.odd) for r in labels.where("label = 1").collect()} == {(1, 1, 0), (2, 1, 1), (3, 1, 0), (4, 1, 0)} and [r.label for r in conflicts.collect()] == [7]


def test_repair_in_order(spark):
    v = [(1, i, *p) for i, p in enumerate([(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0), (0.00001, 0.0, 0.0), (9.0, 9.0, 9.0)])]
    t = [(1, i, *f) for i, f in enumerate([(4, 2, 1), (0, 1, 3), (1, 2, 3), (0, 2, 3), (1, 4, 2), (0, 4, 1)])]
    out_v, out_t, counts = packages.repair(spark.createDataFrame(v, "object_id long, vid long, x double, y double, z double"), spark.createDataFrame(t, "object_id long, tid long, v1 long, v2 long, v3 long"))
    assert tuple(counts.collect()[0]) == (1, 2, 2, 0, 1) and out_v.count() == 4 and out_t.count() == 4


@pytest.mark.parametrize("small", [0, 50_000])
def test_islands_of_small_and_large_objects(spark, monkeypatch, small):
    monkeypatch.setattr(graphs, "SMALL", small)
    rows = [(1, k, k // 5 * 10 + k % 5, k // 5 * 10 + k % 5 + 1, k // 5 * 10 + 9) for k in range(20)] + [(2, 7, 0, 1, 2)]
    got = {(r.object_id, r.tid): r.island for r in structure.islands(spark.createDataFrame(rows, "object_id long, tid long, v1 long, v2 long, v3 long")).collect()}
    assert got == {(1, k): k // 5 * 5 for k in range(20)} | {(2, 7): 7}


@pytest.mark.parametrize("small", [0, 50_000])
def test_windings_of_large_and_odd_meshes(spark, monkeypatch, small):
    monkeypatch.setattr(graphs, "SMALL", small)
    ring = [(1, i, i, i + 1, 100) if i % 3 else (1, i, i + 1, i, 100) for i in range(40)]
    odd = [(2, 0, 0, 1, 2), (2, 1, 0, 1, 3), (2, 2, 0, 1, 4)]
    df = spark.createDataFrame(ring + odd, "object_id long, tid long, v1 long, v2 long, v3 long")
    got = {(r.object_id, r.tid): r for r in repair.harmonize(df).collect()}
    assert len(got) == 43
    assert all(got[1, i].flipped == (i % 3 != 0) for i in range(40))
    assert [got[2, i].flipped for i in range(3)] == [False, True, True]


def test_selectors_and_secrets(spark):
    items = spark.createDataFrame([(0, "Gear"), (1, "bolt"), (2, None)], "seq long, name string")
    names = lambda s: sorted(r.seq for r in packages.selected(items, s).collect())
    assert names([]) == [0, 1, 2] and names(["2", "GE"]) == [0, 2] and names(["x"]) == []
    sealed = spark.sql("select aes_decrypt(aes_encrypt(unhex('010203'), unhex(repeat('0b', 32)), 'GCM'), unhex(repeat('0b', 32)), 'GCM') as x, length(aes_encrypt(unhex('010203'), unhex(repeat('0b', 32)), 'GCM')) as n").collect()[0]
    assert bytes(sealed.x) == b"\x01\x02\x03" and sealed.n == 31


@pytest.mark.parametrize("name", ["mesh_rules", "package_rules", "crossing_triangles", "repaired_meshes", "merged_objects", "needed_resources", "package_statistics", "attachments_of_files", "names_of_files", "slicer_files"])
def test_queries_equal_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for table in ("lineitem", "orders", "customer", "supplier", "part", "nation", "documents"):
        c.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    df = bindings.QUERIES[name](spark, SF)
    want = c.sql(bindings.SQL[name])
    columns = sorted(df.columns)
    show = lambda rows: sorted(str([f"{x:.6g}" if isinstance(x, float) else x for x in r]) for r in rows)
    assert sorted(want.columns) == columns and show(map(tuple, df.select(*columns).collect())) == show(want.select(*[duckdb.ColumnExpression(x) for x in columns]).fetchall())
    assert models and structure
