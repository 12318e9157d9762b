"""Operators keep to one batch, or to objects of bounded size, in a task; objects over the bound go another way with the same results."""

import io
import random
import re
import zipfile

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from facetframe.operators import batches, crossing, geometry, graphs, packages, repair, rules, structure
from facetframe.sources import files, sinks


def plan(df):
    return df._jdf.queryExecution().toString()


def solids(spark, n=5):
    v = spark.range(n * 8).select(F.lit("p").alias("path"), (F.col("id") % n).alias("object_id"), F.floor(F.col("id") / n).alias("vid"), *[(F.col("id") * k % 7).cast("double").alias(a) for k, a in ((3, "x"), (5, "y"), (11, "z"))])
    t = spark.range(n * 20).select(F.lit("p").alias("path"), (F.col("id") % n).alias("object_id"), F.floor(F.col("id") / n).alias("tid"), *[(F.col("id") * k % 8).alias(c) for k, c in ((1, "v1"), (3, "v2"), (7, "v3"))])
    return v, t.unionByName(t.limit(1).withColumns({"tid": F.lit(99).cast("long"), "v1": F.lit(50).cast("long")}))  # the last names no vertex


def test_packages_are_written_batch_by_batch(spark):
    v, t = solids(spark)
    both = lambda df: df.unionByName(df.withColumn("path", F.lit("q")))
    objects = both(v.select("path", "object_id").distinct().withColumns({"type": F.lit("model"), "name": F.lit(None).cast("string"), "pid": F.lit(None).cast("long"), "pindex": F.lit(None).cast("long")}))
    parts = objects.select("path", "object_id", F.lit(0).alias("seq"), F.col("object_id").alias("child_object_id"), F.lit(None).cast("string").alias("transform")).where("object_id < 2")
    items = objects.select("path", F.col("object_id").alias("seq"), F.col("object_id").alias("item_object_id"), F.lit(None).cast("string").alias("transform"))
    texts = []
    for size in ("3", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        made = sinks.packages(objects, both(v), both(t), parts, items)
        assert "FlatMapGroupsInPandas" not in plan(made)
        texts.append({r.path: zipfile.ZipFile(io.BytesIO(r.content)).read("3D/3dmodel.model").decode() for r in made.collect()})
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert texts[0] == texts[1] and texts[0]["p"] == texts[0]["q"]
    text = texts[0]["p"]
    assert [text.count(x) for x in ("<object ", "</object>", "<mesh><vertices><vertex ", "</vertices><triangles><triangle ", "</triangles></mesh>", "</mesh><components><component ", "</resources><build><item ", "</build></model>")] == [5, 5, 5, 5, 5, 2, 1, 1]


def test_own_vertices_are_not_broadcast(spark, monkeypatch):
    v, t = solids(spark)
    made = []
    for small in (0, 50_000):
        monkeypatch.setattr(graphs, "SMALL", small)
        made.append(sorted((r.object_id, r.triangle_count, round(r.area, 9), round(r.volume, 9), r.min_x, r.max_z, r.vertex_count) for r in geometry.own_measures(t, v).collect()))
    assert made[0] == made[1] and [r[1] for r in made[0]] == [20] * 5 and [r[-1] for r in made[0]] == [8] * 5
    for df in (geometry.corners(t.drop("path"), v.drop("path")), geometry.own_measures(t, v)):
        assert "BroadcastHashJoin" not in plan(df)


def wild(spark, seed=5):
    """Random meshes of a few objects, with repeated vertices and repeated faces among the triangles."""
    r = random.Random(seed)
    t = [("p", o, k, *[r.randrange(o + 4) for _ in "abc"]) for o in range(6) for k in range(9 * o + 1)]
    v = [("p", o, k, *[float(r.randrange(5)) for _ in "xyz"]) for o in range(6) for k in range(o + 4)]
    return spark.createDataFrame(t, "path string, object_id long, tid long, v1 long, v2 long, v3 long"), spark.createDataFrame(v, "path string, object_id long, vid long, x double, y double, z double")


def test_crossings_of_small_meshes_stay_in_tasks(spark, monkeypatch):
    t, v = wild(spark)
    c = geometry.corners(t.drop("path"), v.drop("path"))
    made = crossing.self_intersections(c)
    assert "MapInPandas" in plan(made) and "log2" not in plan(made).lower()
    got = sorted(map(tuple, made.collect()))
    monkeypatch.setattr(crossing, "ALL_PAIRS", 20)  # so that some objects go to the grid
    assert got and got == sorted(map(tuple, crossing.self_intersections(c).collect()))


def test_rules_on_meshes_are_one_pass(spark, monkeypatch):
    t, v = wild(spark)
    objects = t.select("path", "object_id").distinct().withColumns({"type": F.when(F.col("object_id") == 3, "support").otherwise("model"), "kind": F.lit("mesh")})
    model = {"objects": objects, "triangles": t, "vertices": v, "units": spark.createDataFrame([("p", "micron")], "path string, unit string")}
    codes = (4001, 4002, 4003, 4004, 4005, 4006, 4007, 4008, 4100)
    made = rules.validate(model, codes=codes)
    assert plan(made).count("MapInPandas") <= 4  # one in each of the printed plans
    got = sorted(map(str, made.collect()))
    assert {r.code for r in made.collect()} == set(codes)
    for small in (25, 0):  # some objects, and all of them, go by joins
        monkeypatch.setattr(rules, "ALL_RULES", small)
        assert got == sorted(map(str, rules.validate(model, codes=codes).collect()))


def walked(faces):
    """The walk by hand: breadth first from the least triangle not met, an edge is followed once."""
    faces, met, out = [list(f) for f in faces], set(), set()
    sides, used = (lambda f: [(f[0], f[1]), (f[1], f[2]), (f[2], f[0])]), set()
    for first in range(len(faces)):
        queue = [] if first in met else [first]
        met.add(first)
        for i in queue:
            for a, b in sides(faces[i]):
                if frozenset((a, b)) not in used:
                    used.add(frozenset((a, b)))
                    for j, g in enumerate(faces):
                        if j not in met and any({a, b} == {p, q} for p, q in sides(g)):
                            if (a, b) in sides(g):
                                g[1], g[2] = g[2], g[1]
                                out.add(j)
                            met.add(j)
                            queue.append(j)
    return [(*f, i in out) for i, f in enumerate(faces)]


def test_windings_of_many_objects_at_once(spark):
    t, _ = wild(spark)
    made = repair.harmonize(t.drop("path"))
    assert "FlatMapGroupsInPandas" not in plan(made)
    rows, got = t.orderBy("object_id", "tid").collect(), made.orderBy("object_id", "tid").collect()
    for o in range(6):
        assert [(r.v1, r.v2, r.v3, r.flipped) for r in got if r.object_id == o] == walked([(r.v1, r.v2, r.v3) for r in rows if r.object_id == o])
    twice = structure.unique_faces(t.drop("path"))
    assert "Join" not in plan(twice) and twice.select("object_id", F.array_sort(F.array("v1", "v2", "v3"))).distinct().count() == twice.count()


def test_holes_of_many_objects_at_once(spark):
    square = [(0, 1, 2), (0, 2, 3)]
    rows = [(o, k + 5 * o, *f) for o in range(3) for k, f in enumerate(square[: o + 1 if o < 2 else 0] or [(7, 7, 8)])]
    made = repair.fill_holes(spark.createDataFrame(rows, "object_id long, tid long, v1 long, v2 long, v3 long"))
    assert "FlatMapGroupsInPandas" not in plan(made)
    assert sorted((r.object_id, r.tid, r.v1, r.v2, r.v3) for r in made.where("added").collect()) == [(0, 1, 0, 2, 1), (1, 7, 0, 3, 2), (1, 8, 0, 2, 1)]
    assert made.where("not added").count() == len(rows)


def test_faces_dealt_by_object_are_shuffled_once(spark):
    t, _ = wild(spark)
    t = t.drop("path")
    made = repair.fill_holes(structure.unique_faces(structure.sound_faces(t.repartition(3, "object_id"))))
    physical = made._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange ") == 1 and "array_sort" not in physical
    seen, want = set(), []
    for r in t.orderBy("object_id", "tid").collect():
        face = (r.object_id, *sorted((r.v1, r.v2, r.v3)))
        if len(set(face[1:])) == 3 and face not in seen:
            seen.add(face)
            want.append((r.object_id, r.tid, r.v1, r.v2, r.v3))
    assert want == sorted((r.object_id, r.tid, r.v1, r.v2, r.v3) for r in made.where("not added").collect())


def test_used_vertices_are_dealt_by_their_number(spark, monkeypatch):
    t, v = wild(spark)
    t, v = t.drop("path"), v.drop("path").unionByName(v.drop("path").withColumn("vid", F.col("vid") + 100))  # half of them in no triangle
    by_hand = {}
    for r in t.collect():
        by_hand.setdefault(r.object_id, set()).update((r.v1, r.v2, r.v3))
    at = {(r.object_id, r.vid): (r.x, r.y, r.z) for r in v.collect()}
    want = sorted((o, i, k, *at[o, i]) for o, ids in by_hand.items() for k, i in enumerate(sorted(ids)))
    for most in (5, 1_000_000):
        monkeypatch.setattr(batches, "TASK_ROWS", most, raising=False)
        made = structure.used_vertices(v, t)
        assert sorted((r.object_id, r.vid, r.new_vid, r.x, r.y, r.z) for r in made.collect()) == want
        assert "Join" not in plan(made) and "HashAggregate" not in plan(made)
        assert (f", {-(-t.count() // most)}), REPARTITION_BY_NUM" in plan(made)) == (most == 5)


def test_tables_are_dealt_without_sorted_writes(spark):
    tasks = lambda n: batches.dealt(spark.range(5), n, "id").rdd.getNumPartitions()
    assert [tasks(n * batches.TASK_ROWS) for n in (20, 200, 216, 400, 401, 500)] == [20, 200, 200, 200, 201, 250]


def test_findings_need_one_pass_over_small_meshes(spark, monkeypatch):
    t, v = wild(spark)
    shared = v.where("object_id = 5").drop("path", "object_id")
    made = geometry.findings(t.drop("path"), shared)
    assert plan(made).count("Aggregate(key") == 0 and "HashAggregate" not in plan(made)
    got = sorted(map(str, made.collect()))
    monkeypatch.setattr(graphs, "SMALL", 10)
    assert got == sorted(map(str, geometry.findings(t.drop("path"), shared).collect()))


def test_many_files_are_a_few_frames(spark, monkeypatch):
    made = []
    monkeypatch.setattr(files, "_frame", lambda rows, f=files._frame: made.append(len(rows)) or f(rows))
    df = spark.createDataFrame([("a", bytearray(b"x"))], "path string, content binary")
    parse = {}
    monkeypatch.setattr(type(df), "mapInPandas", lambda self, f, schema: parse.setdefault("f", f))
    files.parse_files(df)
    rows = pd.concat(parse["f"](iter([pd.DataFrame({"path": [f"f{i}" for i in range(30)], "content": [b"?"] * 30})])))
    assert made == [30] and list(rows["path"]) == [f"f{i}" for i in range(30)]


def test_one_package_is_written_in_stretches(spark, monkeypatch):
    v, t = solids(spark)
    objects = v.select("path", "object_id").distinct().withColumns({"type": F.lit("model"), "name": F.lit(None).cast("string"), "pid": F.lit(None).cast("long"), "pindex": F.lit(None).cast("long")})
    # object 9 has triangles alone, 700 a component alone
    t = t.unionByName(t.where("object_id = 1").withColumn("object_id", F.lit(9).cast("long")))
    parts = objects.where("object_id = 4").select("path", F.explode(F.array(F.lit(4).cast("long"), F.lit(700).cast("long"))).alias("object_id"), F.lit(0).alias("seq"), F.lit(1).cast("long").alias("child_object_id"), F.lit(None).cast("string").alias("transform"))
    items = objects.select("path", (5 - F.col("object_id")).alias("seq"), F.col("object_id").alias("item_object_id"), F.lit(None).cast("string").alias("transform"))
    texts = []
    for stretch, known in ((100_000, 1000), (20, 1000), (20, 0)):
        monkeypatch.setattr(sinks, "STRETCH", stretch)
        monkeypatch.setattr(sinks, "KNOWN", known)
        assert (sinks._stretches(objects, t).parts > 1) == (stretch == 20)
        z = zipfile.ZipFile(io.BytesIO(sinks.packages(objects, v, t, parts, items).collect()[0].content))
        assert z.testzip() is None
        texts.append(z.read("3D/3dmodel.model").decode())
    assert texts[0] == texts[1] == texts[2]
    assert [texts[0].count(x) for x in ("<object", "</object>", "<vertex ", "<triangle ", "<component ", "<item ")] == [7, 7, 40, 121, 2, 5]
    assert re.findall(r'<item objectid="(\d)"', texts[0]) == list("43210")


def test_stretches_in_pieces_are_one_archive(monkeypatch):
    rows = [("p", 0, 1, 0, '<object id="1">')] + [("p", 0, 1, 1, f'<vertex x="{random.Random(k).random()}"/>') for k in range(9000)] + [("p", 1, 2, 2, "<triangle/>")] + [("q", 0, 5, 3, "<component/>")]
    contents = []
    for piece, size in ((1, 50), (1 << 20, 1000)):
        monkeypatch.setattr(sinks, "PIECE", piece)
        frames = [pd.DataFrame(rows[i : i + size], columns=["path", "cut", "owner", "part", "value"]).astype({"cut": "int32", "part": "int32"}) for i in range(0, len(rows), size)]
        made = pd.concat([b.to_pandas() for b in sinks._strung(iter([pa.RecordBatch.from_pandas(f) for f in frames]))])
        assert (len(made) > 3) == (piece == 1)
        zips = [zipfile.ZipFile(io.BytesIO(c)) for f in sinks._joined("inch", iter([made])) for c in f["content"]]
        assert [z.testzip() for z in zips] == [None, None]
        contents.append([z.read("3D/3dmodel.model").decode() for z in zips])
    assert contents[0] == contents[1] and contents[0][0].count("<vertex ") == 9000
    assert contents[0][0].endswith("</vertices></mesh></object><object><mesh><triangles><triangle/></triangles></mesh></object></resources><build></build></model>")
    assert contents[0][1].endswith("<resources><object><components><component/></components></object></resources><build></build></model>")


def plain_object(k, x="0.5", more="", end=""):
    return f'<object id="{k}"{more}><mesh><vertices><vertex x="{x}" y="-1" z="1E2"/><vertex x="1" y="0" z="0"/>{end}</vertices><triangles><triangle v1="0" v2="1" v3="1"/></triangles></mesh></object>'


def test_plain_objects_are_read_as_any_other(spark, monkeypatch):
    objects = "".join(plain_object(k) for k in range(1, 40))
    resources = [
        objects, plain_object(1) + " \n" + plain_object(2, more=' type="support"') + plain_object(3, more=' name="x"') + plain_object(4), plain_object(1, more=' type="odd"'), plain_object(1) + plain_object(1) + plain_object(2),
        f"<!-- {plain_object(1)} -->{plain_object(2)}", f"<![CDATA[{plain_object(1)}]]>{plain_object(2)}", f"<?x {plain_object(1)} ?>{plain_object(2)}", f'<a b=">{plain_object(1)}"/>{plain_object(2)}', f"<a>{plain_object(1)}</a>{plain_object(2)}",
        plain_object(1, end="<vertex/>") + plain_object(2), plain_object(1, "1-2") + plain_object(2), plain_object(1, "1E60") + plain_object(2, "1E-60"), plain_object(1) + "<object/>" + plain_object(2), plain_object(1) + "<b>" + plain_object(2), plain_object(1) + plain_object(2)[:60], '<basematerials id="1"/>' + plain_object(1),
    ]
    builds = ['<item objectid="1"/><item objectid="2"/> <item objectid="2" printable="0"/><item objectid="1"/>', '<!--<item objectid="1"/>--><item objectid="x"/><item objectid="2"/>']
    texts = [f'<?xml version="1.0"?><model xmlns="c"><metadata name="a">b</metadata><resources>{r}</resources><build>{b}</build></model>' for r in resources for b in builds]
    texts += [t.replace("<model xmlns", "<model xml:space='x' xmlns") for t in texts[:1]] + [texts[0].replace("<build>", "<resources>" + plain_object(77) + "</resources><build>"), texts[0][:-30], texts[0] + plain_object(5)]

    def read(text, plain):
        out = []
        try:
            for r in files.model_rows(io.BytesIO(text.encode()), plain):
                out += files._elements(r) if r[0] == "mesh" else [("item", None, r[2], {"objectid": str(r[1])})] if r[0] == "placed" else [r]
        except Exception as e:  # noqa: BLE001
            out.append((type(e), None if plain and isinstance(e, SyntaxError) else str(e) if isinstance(e, ValueError) else None))
        return out

    for window in (7, 64, 500, 1 << 20):
        monkeypatch.setattr(files, "WINDOW", window)
        for text in texts:
            assert read(text, True) == read(text, False), text
    assert sum(r[0] == "mesh" for r in files.model_rows(io.BytesIO(texts[0].encode()), True)) == 39

    def package(text):
        content = io.BytesIO()
        with zipfile.ZipFile(content, "w") as z:
            for name, x in (("_rels/.rels", sinks.RELS), ("3D/3dmodel.model", text), ("3D/b.model", texts[2])):
                z.writestr(name, x)
        return bytearray(content.getvalue())

    df = spark.createDataFrame([(f"f{i}", package(x)) for i, x in enumerate(texts)] + [("s", bytearray(b"?"))], "path string, content binary").repartition(4)
    a, b = files.parse_files(df).cache(), graphs.landed(files.parse_meshes(df))
    assert sorted(map(str, files.tables(a)["errors"].collect())) == sorted(map(str, files.tables(b)["errors"].collect()))
    show = lambda rows: sorted(str([f"{x:.9g}" if isinstance(x, float) else x for x in r]) for r in packages.geometry_stats(*files.geometry(rows)).collect())
    assert show(a) == show(b) and b.where("kind = 'mesh'").count() > 200


def test_rows_of_an_object_meet_whatever_they_lie_by(spark):
    t, v = wild(spark)
    few = t.where("object_id > 3").select("path", "object_id").distinct()
    lie = lambda df: df.join(few, ["path", "object_id"], "left_anti").select("path", "object_id")
    rows = lie(t).unionByName(lie(v)).unionByName(lie(t.distinct()))
    made = batches.whole(rows, ("path", "object_id"), (), lambda pdf, code: pdf.drop_duplicates(), "path string, object_id long")
    assert sorted(r.object_id for r in made.collect()) == [0, 1, 2, 3] and "REPARTITION_BY_COL" in made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
