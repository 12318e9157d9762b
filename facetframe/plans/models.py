"""Queries of the package operators over the given tables, with their SQL. Order lines are triangles of the object that their order is, suppliers objects of the package that their nation is."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.vectors import UNIT_METRES
from ..operators import crossing as X
from ..operators import packages as P
from ..operators import rules
from ..operators.batches import dealt
from ..operators.graphs import checkpointed, landed
from ..sources import files, sinks, vendor
from .bindings import LINE_ORDER, TRI, VERT, query, read, triangles, vertices

LINE = f"line AS MATERIALIZED (SELECT l_orderkey % 25 AS path, l_orderkey AS object_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER[1:])}, l_suppkey) - 1 AS tid, l_partkey % 8 AS v1, (l_partkey * 7 + l_linenumber) % 8 AS v2, l_suppkey % 8 AS v3 FROM lineitem)"
TYPES = ("model", "solidsupport", "support", "surface", "other")


def _lines(spark, sf_dir, deal=False):
    """path, object_id, tid, v1, v2, v3: small meshes on 8 vertices. deal: in partitions of bounded size."""
    tid = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER[1:], "l_suppkey")) - 1
    line = read(spark, sf_dir, "lineitem")
    return (dealt(line, line.count(), "l_orderkey") if deal else line).select(F.concat(F.lit("p"), F.col("l_orderkey") % 25).alias("path"), F.col("l_orderkey").cast("long").alias("object_id"), tid.cast("long").alias("tid"), (F.col("l_partkey") % 8).cast("long").alias("v1"), ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % 8).cast("long").alias("v2"), (F.col("l_suppkey") % 8).cast("long").alias("v3"))


def _places(vid):
    return [(vid * vid % 7).cast("double").alias("x"), (vid * 3 % 8).cast("double").alias("y"), (vid * vid * vid % 5).cast("double").alias("z")]


def _sql_places(v: str, p: str) -> str:
    return f"({v} * {v} % 7)::DOUBLE AS {p}x, ({v} * 3 % 8)::DOUBLE AS {p}y, ({v} * {v} * {v} % 5)::DOUBLE AS {p}z"


def _sql_cross(a, b):
    return [f"(({a[1]}) * ({b[2]}) - ({a[2]}) * ({b[1]}))", f"(({a[2]}) * ({b[0]}) - ({a[0]}) * ({b[2]}))", f"(({a[0]}) * ({b[1]}) - ({a[1]}) * ({b[0]}))"]


def _sql_crossing() -> str:
    """CTEs `corner` (line with ax..cz) and `cut` (object_id, path, a_tid, b_tid): every pair of an object's triangles is tried."""
    point = lambda side, p: [f"{side}.{p}{x}" for x in "xyz"]
    minus = lambda a, b: [f"{x} - {y}" for x, y in zip(a, b)]
    normal = lambda s: _sql_cross(minus(point(s, "b"), point(s, "a")), minus(point(s, "c"), point(s, "a")))
    n = ", ".join(f"{e} AS {side}n{x}" for side, s in (("p", "p"), ("q", "q")) for e, x in zip(normal(s), "xyz"))
    dist = lambda n, origin, side, p: " + ".join(f"{n}n{x} * ({side}_{p}{x} - {origin}_a{x})" for x in "xyz")
    flat = ", ".join(f"{s}.{p}{x} AS {s}_{p}{x}" for s in "pq" for p in "abc" for x in "xyz")
    d = ", ".join(f"{dist(n, n, s, p)} AS {s}d{k}" for n, s in (("q", "p"), ("p", "q")) for k, p in enumerate("abc"))
    line = _sql_cross([f"pn{x}" for x in "xyz"], [f"qn{x}" for x in "xyz"])

    def ends(s: str) -> str:
        pick = lambda p: f"(CASE axis WHEN 0 THEN {s}_{p}x WHEN 1 THEN {s}_{p}y ELSE {s}_{p}z END)"
        out = []
        for (i, a), (j, b) in (((0, "a"), (1, "b")), ((1, "b"), (2, "c")), ((2, "c"), (0, "a"))):
            da, db = f"{s}d{i}", f"{s}d{j}"
            out.append(f"CASE WHEN ({da} >= 0) <> ({db} >= 0) THEN {pick(a)} + ({pick(b)} - {pick(a)}) * ({da} / ({da} - {db})) WHEN abs({da}) < 1e-7 THEN {pick(a)} END")
        return f"[{', '.join(out)}]"

    side = lambda s: f"NOT (({s}d0 > 0 AND {s}d1 > 0 AND {s}d2 > 0) OR ({s}d0 < 0 AND {s}d1 < 0 AND {s}d2 < 0))"
    shared = " + ".join(f"(p.v{i} = q.v{j})::INT" for i in (1, 2, 3) for j in (1, 2, 3))
    square = lambda s: " + ".join(f"{s}n{x} * {s}n{x}" for x in "xyz")
    corner = f"corner AS MATERIALIZED (SELECT *, {_sql_places('v1', 'a')}, {_sql_places('v2', 'b')}, {_sql_places('v3', 'c')} FROM line)"
    return f"""{corner}, pair AS (SELECT p.path, p.object_id, p.tid AS a_tid, q.tid AS b_tid, {n}, {flat} FROM corner p JOIN corner q ON p.object_id = q.object_id AND p.tid < q.tid WHERE {shared} < 2),
    far AS (SELECT *, {d}, {', '.join(f'abs({e}) AS l{x}' for e, x in zip(line, 'xyz'))} FROM pair WHERE {square('p')} >= 1e-12 AND {square('q')} >= 1e-12),
    axes AS (SELECT *, CASE WHEN lx > ly AND lx > lz THEN 0 WHEN ly > lz THEN 1 ELSE 2 END AS axis FROM far WHERE {side('p')} AND {side('q')}),
    span AS (SELECT *, list_filter({ends('p')}, lambda t: t IS NOT NULL) AS s, list_filter({ends('q')}, lambda t: t IS NOT NULL) AS t FROM axes),
    cut AS MATERIALIZED (SELECT path, object_id, a_tid, b_tid FROM span WHERE len(s) >= 2 AND len(t) >= 2 AND list_min(s) + 1e-6 < list_max(t) AND list_min(t) + 1e-6 < list_max(s))"""


@query(f"WITH {LINE}, {_sql_crossing()} SELECT object_id, a_tid::BIGINT AS a_tid, b_tid::BIGINT AS b_tid FROM cut")
def crossing_triangles(spark, sf_dir):
    """Pairs of crossing triangles within each order's mesh (code 4008)."""
    t = _lines(spark, sf_dir).drop("path")
    for p, v in (("a", "v1"), ("b", "v2"), ("c", "v3")):
        t = t.select("*", *[c.alias(f"{p}{x}") for c, x in zip(_places(F.col(v)), "xyz")])
    return X.self_intersections(t)


_AREA = "sqrt(" + " + ".join(f"({e}) * ({e})" for e in _sql_cross([f'"b{x}" - a{x}' for x in "xyz"], [f"c{x} - a{x}" for x in "xyz"])) + ") / 2"
_UNITS = list(UNIT_METRES)


@query(f"""WITH RECURSIVE {LINE}, {_sql_crossing()}, solid AS (SELECT * FROM corner WHERE object_id % 5 < 2), loose AS (SELECT * FROM corner WHERE object_id % 5 >= 2),
de AS (SELECT path, object_id, tid, object_id % 5 < 2 AS solid, v1 AS s, v2 AS e FROM line UNION ALL SELECT path, object_id, tid, object_id % 5 < 2, v2, v3 FROM line UNION ALL SELECT path, object_id, tid, object_id % 5 < 2, v3, v1 FROM line),
ed AS MATERIALIZED (SELECT path, object_id, solid, least(s, e) AS lo, greatest(s, e) AS hi, count(*) AS n FROM de GROUP BY ALL),
tr AS (SELECT path, object_id, tid, least(s, e) AS lo, greatest(s, e) AS hi FROM de WHERE solid),
isl AS (SELECT path, object_id, tid, tid AS i FROM solid UNION SELECT f.path, f.object_id, f.tid, isl.i FROM isl JOIN tr e ON e.object_id = isl.object_id AND e.tid = isl.tid JOIN tr f ON f.object_id = e.object_id AND f.lo = e.lo AND f.hi = e.hi),
island AS (SELECT path, object_id, tid, min(i) AS i FROM isl GROUP BY ALL),
good AS (SELECT * FROM solid WHERE v1 <> v2 AND v2 <> v3 AND v1 <> v3), l AS (SELECT path, object_id, v1 AS v, v2 AS a, v3 AS b FROM good UNION SELECT path, object_id, v2, v3, v1 FROM good UNION SELECT path, object_id, v3, v1, v2 FROM good),
u AS (SELECT * FROM l UNION SELECT path, object_id, v, b, a FROM l), r AS (SELECT path, object_id, v, a AS x, a AS y FROM u UNION SELECT r.path, r.object_id, r.v, r.x, u.b FROM r JOIN u ON u.object_id = r.object_id AND u.v = r.v AND u.a = r.y),
fan AS (SELECT path, object_id, v, count(DISTINCT least) AS n FROM (SELECT path, object_id, v, x, min(y) AS least FROM r GROUP BY ALL) GROUP BY ALL),
f AS (SELECT path, 4001 AS code, object_id AS owner, tid::VARCHAR AS element FROM line WHERE v1 = v2 OR v2 = v3 OR v1 = v3
UNION ALL SELECT path, 4002, object_id, lo || '-' || hi FROM ed WHERE solid AND n = 1 UNION ALL SELECT path, 4003, object_id, lo || '-' || hi FROM ed WHERE solid AND n > 2
UNION ALL SELECT path, 4004, object_id, s || '-' || e FROM (SELECT path, object_id, s, e FROM de WHERE solid GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT path, 4005, object_id, tid::VARCHAR FROM solid WHERE {_AREA} < 1e-12 / power([{', '.join(map(repr, UNIT_METRES.values()))}][path % 6 + 1], 2)
UNION ALL SELECT path, 4006, object_id, v::VARCHAR FROM fan WHERE n > 1
UNION ALL SELECT path, 4007, object_id, count(DISTINCT i)::VARCHAR FROM island GROUP BY path, object_id HAVING count(DISTINCT i) > 1
UNION ALL SELECT path, 4008, object_id, count(*)::VARCHAR FROM cut WHERE object_id % 5 < 2 GROUP BY path, object_id
UNION ALL SELECT path, 4100, object_id, count(*)::VARCHAR FROM ed WHERE NOT solid AND n <> 2 GROUP BY path, object_id)
SELECT 'p' || path AS path, code, CASE code WHEN 4100 THEN 'info' ELSE 'warning' END AS severity, owner, element FROM f""")
def mesh_rules(spark, sf_dir):
    """All rules on geometry over every order's mesh: types by order number, units by package."""
    t = _lines(spark, sf_dir)
    objects = t.select("path", "object_id").distinct().withColumns({"type": F.array(*[F.lit(x) for x in TYPES])[(F.col("object_id") % 5).cast("int")], "kind": F.lit("mesh")})
    v = t.select("path", "object_id", F.explode(F.array("v1", "v2", "v3")).alias("vid")).distinct()
    units = objects.select("path").distinct().withColumn("unit", F.array(*[F.lit(u) for u in _UNITS])[F.substring("path", 2, 9).cast("int") % 6])
    return rules.validate({"objects": objects, "triangles": t, "vertices": v.select("path", "object_id", "vid", *_places(F.col("vid"))), "units": units}, codes=(4001, 4002, 4003, 4004, 4005, 4006, 4007, 4008, 4100))


RES = """res AS MATERIALIZED (SELECT DISTINCT o_orderkey % 25 AS path, o_custkey % 60 AS id FROM orders), reso AS (SELECT path, id AS resource_id, ['basematerials','colorgroup','texture2dgroup','compositematerials','multiproperties','slicestack'][id % 6 + 1] AS resource, CASE WHEN id % 6 = 3 THEN id * 7 % 61 END AS matid FROM res)"""
OBJ = "obj AS MATERIALIZED (SELECT (s_suppkey % 25) AS path, s_suppkey AS object_id, CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey * 3 % 61 END AS pid, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 5 END AS pindex, ['mesh','components','slicestack','volumetricstack','boolean'][s_suppkey % 5 + 1] AS kind, CASE WHEN s_suppkey % 3 = 1 THEN 'other' ELSE 'model' END AS type, s_suppkey * 11 % 61 AS ref_id FROM supplier)"


def _model(spark, sf_dir):
    p = lambda c: F.concat(F.lit("p"), c).alias("path")
    o, s, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "supplier"), read(spark, sf_dir, "customer")
    key, kinds = F.col("s_suppkey").cast("long"), ("mesh", "components", "slicestack", "volumetricstack", "boolean")
    objects = s.select(p(key % 25), key.alias("object_id"), F.when(key % 4 > 0, key * 3 % 61).alias("pid"), F.when(key % 3 == 0, key % 5).alias("pindex"), F.array(*[F.lit(k) for k in kinds])[(key % 5).cast("int")].alias("kind"), F.when(key % 3 == 1, "other").otherwise("model").alias("type"), (key * 11 % 61).alias("ref_id"))
    names = F.array(*[F.lit(k) for k in (*P.KINDS, "slicestack")])
    resources = o.select(p(F.col("o_orderkey") % 25), (F.col("o_custkey") % 60).cast("long").alias("resource_id")).distinct().withColumn("resource", names[(F.col("resource_id") % 6).cast("int")]).withColumn("matid", F.when(F.col("resource_id") % 6 == 3, F.col("resource_id") * 7 % 61))
    layers = o.where("o_custkey % 60 % 6 = 4").select(p(F.col("o_orderkey") % 25), (F.col("o_custkey") % 60).cast("long").alias("resource_id"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") * 3 % 60).cast("long").alias("pid"))
    items = c.select(p(F.col("c_custkey") % 25), F.col("c_custkey").cast("long").alias("seq"), (F.col("c_custkey") * 2 % 130).cast("long").alias("item_object_id"))
    metadata = c.select(p(F.col("c_custkey") % 2500), F.when(F.col("c_custkey") % 50 == 0, "").otherwise(F.col("c_mktsegment")).alias("name"))
    matrix = F.array(F.when(key % 10 == 9, F.lit(float("nan"))).otherwise(1.0))
    booleans = s.where("s_suppkey % 5 = 4").select(p(key % 25), key.alias("object_id"), (key * 5 % 120).alias("base_id"), matrix.alias("transform"))
    operands = s.where("s_suppkey % 5 = 4").select(p(key % 25), key.alias("object_id"), F.lit(0).alias("seq"), (key + 25).alias("operand_id"), matrix.alias("transform"))
    components = s.where("s_suppkey % 5 = 1").select(p(key % 25), key.alias("object_id"), F.lit(0).alias("seq"), (key + 25 * (key % 3)).alias("child_object_id"), F.lit(None).cast("string").alias("part"))
    return {"objects": objects, "resources": resources, "layers": layers, "items": items, "metadata": metadata, "booleans": booleans, "operands": operands, "components": components}


_MISSING = "NOT EXISTS (SELECT 1 FROM obj b WHERE b.path = {0}.path AND b.object_id = {1})"


@query(f"""WITH {RES}, {OBJ}, lay AS (SELECT o_orderkey % 25 AS path, o_custkey % 60 AS resource_id, o_orderkey * 3 % 60 AS pid FROM orders WHERE o_custkey % 60 % 6 = 4), lk AS MATERIALIZED (SELECT lay.*, resource FROM lay JOIN reso ON reso.path = lay.path AND reso.resource_id = lay.pid),
n AS (SELECT path, resource_id, resource, count(*) AS n FROM lk GROUP BY ALL), item AS (SELECT c_custkey % 25 AS path, c_custkey AS seq, c_custkey * 2 % 130 AS o FROM customer), meta AS (SELECT c_custkey % 2500 AS path, CASE WHEN c_custkey % 50 = 0 THEN '' ELSE c_mktsegment END AS name FROM customer),
boo AS (SELECT path, object_id, object_id * 5 % 120 AS base, object_id + 25 AS operand, object_id % 10 = 9 AS odd FROM obj WHERE kind = 'boolean'), com AS (SELECT path, object_id, object_id + 25 * (object_id % 3) AS child FROM obj WHERE kind = 'components'),
f AS (SELECT path, 2001 AS code, object_id AS owner, pid::VARCHAR AS element FROM obj o WHERE pid IS NOT NULL AND NOT EXISTS (SELECT 1 FROM res WHERE res.path = o.path AND res.id = o.pid) AND {_MISSING.format('o', 'o.pid')}
UNION ALL SELECT path, 2003, object_id, child::VARCHAR FROM com WHERE {_MISSING.format('com', 'child')}
UNION ALL SELECT path, 2004, object_id, ref_id::VARCHAR FROM obj o WHERE kind = 'slicestack' AND NOT EXISTS (SELECT 1 FROM reso r WHERE r.path = o.path AND r.resource_id = o.ref_id AND r.resource = 'slicestack')
UNION ALL SELECT path, 2005, object_id, ref_id::VARCHAR FROM obj WHERE kind = 'volumetricstack'
UNION ALL SELECT path, 2010, object_id, pindex::VARCHAR FROM obj WHERE pindex IS NOT NULL AND pid IS NULL
UNION ALL SELECT path, CASE resource WHEN 'basematerials' THEN 2020 WHEN 'colorgroup' THEN 2021 WHEN 'texture2dgroup' THEN 2022 ELSE 2023 END, resource_id, n::VARCHAR FROM n WHERE n > 1 AND resource IN ('basematerials', 'colorgroup', 'texture2dgroup', 'compositematerials')
UNION ALL SELECT path, 2024, resource_id, pid::VARCHAR FROM lk WHERE resource = 'multiproperties'
UNION ALL SELECT path, 2025, resource_id, NULL FROM lk GROUP BY path, resource_id HAVING bool_or(resource = 'basematerials') AND bool_or(resource = 'compositematerials')
UNION ALL SELECT path, 2030, resource_id, CASE WHEN EXISTS (SELECT 1 FROM res b WHERE b.path = r.path AND b.id = r.matid) OR EXISTS (SELECT 1 FROM obj b WHERE b.path = r.path AND b.object_id = r.matid) THEN 'other resource' ELSE 'no resource' END FROM reso r WHERE resource = 'compositematerials' AND NOT EXISTS (SELECT 1 FROM reso b WHERE b.path = r.path AND b.resource_id = r.matid AND b.resource = 'basematerials')
UNION ALL SELECT path, 2040, NULL, '' FROM meta WHERE name = '' UNION ALL SELECT path, 2041, NULL, name FROM meta GROUP BY path, name HAVING count(*) > 1
UNION ALL SELECT b.path, 2101, b.object_id, base::VARCHAR FROM boo b JOIN obj o ON o.path = b.path AND o.object_id = base WHERE o.kind = 'components'
UNION ALL SELECT path, 2102, object_id, base::VARCHAR FROM boo WHERE {_MISSING.format('boo', 'base')}
UNION ALL SELECT b.path, 2103, b.object_id, operand::VARCHAR FROM boo b JOIN obj o ON o.path = b.path AND o.object_id = operand WHERE o.kind <> 'mesh'
UNION ALL SELECT path, 2104, object_id, operand::VARCHAR FROM boo WHERE {_MISSING.format('boo', 'operand')}
UNION ALL SELECT path, 2105, object_id, '0' FROM boo WHERE odd UNION ALL SELECT path, 2106, object_id, base::VARCHAR FROM boo WHERE odd
UNION ALL SELECT path, 3002, o, seq::VARCHAR FROM item WHERE {_MISSING.format('item', 'o')}
UNION ALL SELECT i.path, 3010, o, seq::VARCHAR FROM item i JOIN obj ON obj.path = i.path AND object_id = o WHERE type = 'other')
SELECT 'p' || path AS path, code, 'error' AS severity, owner::BIGINT AS owner, element FROM f""")
def package_rules(spark, sf_dir):
    """The rules on references, materials, metadata and booleans."""
    return rules.validate(_model(spark, sf_dir), codes=(2001, 2003, 2004, 2005, 2010, 2020, 2021, 2022, 2023, 2024, 2025, 2030, 2040, 2041, 2101, 2102, 2103, 2104, 2105, 2106, 3002, 3010))


@query(f"WITH {RES} SELECT 'p' || path AS path, " + ", ".join(f"count(*) FILTER (resource = '{k}')::BIGINT AS {k}" for k in P.KINDS) + " FROM reso GROUP BY path")
def material_counts(spark, sf_dir):
    return P.material_stats(_model(spark, sf_dir)["resources"])


@query(f"""WITH {OBJ}, top AS (SELECT path, max(object_id) + 1 AS span FROM obj GROUP BY path), sh AS (SELECT path, coalesce(sum(span) OVER (ORDER BY 'p' || path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM top)
SELECT 'p' || path AS path, (object_id + s)::BIGINT AS object_id, (pid + s)::BIGINT AS pid, (CASE WHEN kind = 'components' THEN object_id + 25 * (object_id % 3) + s END)::BIGINT AS child FROM obj JOIN sh USING (path)""")
def merged_objects(spark, sf_dir):
    """All packages as one: ids and references of each moved behind those of the packages before."""
    m = _model(spark, sf_dir)
    out = P.merged({k: m[k] for k in ("objects", "components")}, {"objects": ("object_id", "pid"), "components": ("object_id", "child_object_id")})
    return out["objects"].join(out["components"].select("path", "object_id", F.col("child_object_id").alias("child")), ["path", "object_id"], "left").select("path", "object_id", "pid", "child")


@query("""WITH RECURSIVE ref AS (SELECT s_suppkey AS id, s_suppkey // 2 AS target FROM supplier WHERE s_suppkey > 1 UNION ALL SELECT s_suppkey, s_suppkey // 3 + 1 FROM supplier), g AS (SELECT s_suppkey AS part, s_suppkey AS id FROM supplier UNION SELECT part, target FROM g JOIN ref USING (id))
SELECT part, id, row_number() OVER (PARTITION BY part ORDER BY id)::INT AS new_id FROM g""")
def needed_resources(spark, sf_dir):
    """What each object needs if it becomes a package of its own; references go round in circles too."""
    s = F.col("s_suppkey").cast("long")
    suppliers = read(spark, sf_dir, "supplier").select(F.lit("p").alias("path"), s.alias("id"))
    links = suppliers.where("id > 1").withColumn("target", F.expr("id div 2")).unionByName(suppliers.withColumn("target", F.expr("id div 3 + 1")))
    return P.needed(suppliers.withColumn("part", F.col("id")), links).select("part", "id", "new_id")


@query(f"""WITH {VERT}, {TRI}, c AS (SELECT vid, min(vid) OVER (PARTITION BY round(x / 4.0), round(y / 4.0), round(z / 4.0)) AS k FROM vert), m AS (SELECT object_id, tid, a.k AS v1, b.k AS v2, d.k AS v3 FROM tri JOIN c a ON a.vid = v1 JOIN c b ON b.vid = v2 JOIN c d ON d.vid = v3),
co AS (SELECT m.*, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS "by", b.z AS bz, d.x AS cx, d.y AS cy, d.z AS cz FROM m JOIN vert a ON a.vid = v1 JOIN vert b ON b.vid = v2 JOIN vert d ON d.vid = v3 WHERE v1 <> v2 AND v2 <> v3 AND v1 <> v3),
g AS (SELECT *, row_number() OVER (PARTITION BY object_id, list_sort([v1, v2, v3]) ORDER BY tid) AS r FROM co WHERE {_AREA} > 1e-9), kept AS (SELECT * FROM g WHERE r = 1), used AS (SELECT object_id, count(DISTINCT v) AS n FROM (SELECT object_id, unnest([v1, v2, v3]) AS v FROM kept) GROUP BY 1),
t AS (SELECT object_id, count(*) AS n FROM tri GROUP BY 1), k AS (SELECT object_id, count(*) AS n FROM kept GROUP BY 1)
SELECT t.object_id, ((SELECT count(*) FROM vert) - coalesce(used.n, 0))::BIGINT AS vertices_removed, (t.n - coalesce(k.n, 0))::BIGINT AS triangles_removed, 0::BIGINT AS triangles_added, 0::BIGINT AS triangles_flipped FROM t LEFT JOIN used USING (object_id) LEFT JOIN k USING (object_id)""")
def repaired_meshes(spark, sf_dir):
    """Counts of the repairs of every supplier's mesh: stitching, degenerate and repeated faces, unused vertices."""
    t, v = triangles(spark, sf_dir), vertices(spark, sf_dir)
    own = t.select("object_id").distinct().select("object_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(49).cast("long"))).alias("vid")).join(v, "vid")
    return P.repair(own, t, epsilon=4.0, harmonize=False)[2]


@query("""WITH t AS (SELECT l_suppkey % 25 AS k, count(DISTINCT l_suppkey) AS meshes, count(*) AS triangles, count(*) FILTER (l_linenumber > 3) AS displaced FROM lineitem GROUP BY 1), n AS (SELECT o_orderkey % 25 AS k, count(*) AS n FROM orders GROUP BY 1), g AS (SELECT c_custkey % 50 AS k, count(*) AS n FROM customer GROUP BY 1)
SELECT 'p' || k AS path, meshes::BIGINT AS meshes, triangles::BIGINT AS triangles, displaced::BIGINT AS displaced, coalesce(n.n, 0)::BIGINT AS normals, coalesce(g.n, 0)::BIGINT AS gradients, round(100.0::DOUBLE * displaced / triangles, 6) AS coverage FROM t LEFT JOIN n USING (k) LEFT JOIN g USING (k)""")
def displacement_counts(spark, sf_dir):
    p = lambda c: F.concat(F.lit("p"), c).alias("path")
    d = F.when(F.col("l_linenumber") > 3, F.col("l_linenumber"))
    t = read(spark, sf_dir, "lineitem").select(p(F.col("l_suppkey") % 25), F.col("l_suppkey").alias("object_id"), F.lit(None).cast("int").alias("d1"), d.alias("d2"), F.lit(None).cast("int").alias("d3"))
    normals, gradients = read(spark, sf_dir, "orders").select(p(F.col("o_orderkey") % 25)), read(spark, sf_dir, "customer").select(p(F.col("c_custkey") % 50))
    return P.displacement_stats(t, normals, gradients).withColumn("coverage", F.round("coverage", 6))


@query("""WITH t AS (SELECT o_custkey AS path, sum(o_orderkey % 5000)::BIGINT AS seconds, min(o_orderkey) AS first FROM orders GROUP BY 1), w AS (SELECT o_custkey AS path, string_agg(o_orderpriority, ', ' ORDER BY o_orderkey) AS warnings FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1),
u AS (SELECT path, count(*) AS filaments, sum(l_linenumber) AS grams FROM t JOIN lineitem ON l_orderkey = first GROUP BY 1)
SELECT path, seconds, coalesce(warnings, '') AS warnings, coalesce(filaments, 0)::BIGINT AS filaments, coalesce(grams, 0)::BIGINT AS grams FROM t LEFT JOIN w USING (path) LEFT JOIN u USING (path)""")
def slicer_results(spark, sf_dir):
    """Customers are packages, their orders plates, order lines filaments."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("plate"), (F.col("o_orderkey") % 5000).cast("long").alias("seconds"), F.col("o_orderpriority").alias("text"))
    filaments = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("plate"), F.col("l_linenumber").cast("long").alias("grams")).join(o, "plate").select("path", "plate", "grams")
    return P.slicer_stats(o, filaments, o.where("text like '1%'")).withColumn("warnings", F.array_join("warnings", ", "))


@query("SELECT c_mktsegment || c_nationkey AS name, string_agg(c_custkey::VARCHAR, '; ' ORDER BY c_custkey % 7, c_custkey::VARCHAR) AS value FROM customer GROUP BY 1")
def metadata_of_files(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    return P.joined_metadata(c.select((F.col("c_custkey") % 7).alias("file"), F.concat("c_mktsegment", "c_nationkey").alias("name"), F.col("c_custkey").cast("string").alias("value")))


@query("""WITH a AS (SELECT DISTINCT doc_id % 7 AS file, 'n' || (doc_id % 50) AS name, md5(coalesce(text, '')) AS d FROM documents), l AS (SELECT name, arg_min(d, (file, d)) AS lead FROM a GROUP BY 1), s AS (SELECT *, min(file) OVER (PARTITION BY name, d) AS owner, row_number() OVER (PARTITION BY name, d ORDER BY file) AS r FROM a)
SELECT file, name, CASE WHEN d = lead THEN name ELSE name || '.' || owner END AS new_name, r = 1 AS kept FROM s JOIN l USING (name)""")
def attachments_of_files(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select((F.col("doc_id") % 7).alias("file"), F.concat(F.lit("n"), F.col("doc_id") % 50).alias("name"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest")).distinct()
    return P.merged_attachments(d)


@query(r"""WITH p AS (SELECT p_size AS package, p_partkey AS seq, CASE WHEN p_partkey % 5 > 0 THEN CASE WHEN p_partkey % 5 < 3 THEN p_brand || '/' || p_type ELSE p_name END ELSE '' END AS name FROM part), b AS (SELECT *, CASE WHEN length(name) > 0 THEN regexp_replace(name, '[^\p{L}\p{N}._-]', '_', 'g') ELSE 'part_' || (seq + 1) END AS base FROM p), n AS (SELECT *, row_number() OVER (PARTITION BY package, base ORDER BY seq) - 1 AS n FROM b)
SELECT package, seq, CASE WHEN n = 0 THEN base ELSE base || '_' || n END AS file_name FROM n""")
def names_of_files(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    name = F.when(F.col("p_partkey") % 5 == 0, "").when(F.col("p_partkey") % 5 < 3, F.concat_ws("/", "p_brand", "p_type")).otherwise(F.col("p_name"))
    return P.file_names(p.select(F.col("p_size").alias("package"), F.col("p_partkey").alias("seq"), name.alias("name"))).select("package", "seq", "file_name")


@query("SELECT o_custkey AS batch, count(*)::BIGINT AS total, count(*) FILTER (o_orderstatus = 'O')::BIGINT AS succeeded, count(*) FILTER (o_orderstatus = 'P')::BIGINT AS skipped, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS failed FROM orders GROUP BY 1")
def batch_results(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return P.batch_summary(o.select(F.col("o_custkey").alias("batch"), F.when(F.col("o_orderstatus") == "O", "ok").when(F.col("o_orderstatus") == "P", "skipped").when(F.col("o_orderstatus") == "F", "failed").alias("status")))


@query("SELECT doc_id, sha1(coalesce(text, '')) AS sha1, sha256(coalesce(text, '')) AS sha256, base64(encode(coalesce(text, ''))) AS coded FROM documents")
def digests(spark, sf_dir):
    """Digests and the coded form of what signatures cover."""
    body = F.coalesce("text", F.lit("")).cast("binary")
    return read(spark, sf_dir, "documents").select("doc_id", F.sha1(body).alias("sha1"), F.sha2(body, 256).alias("sha256"), F.regexp_replace(F.base64(body), "\r\n", "").alias("coded"))


@query("""SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey - 1 IN (3, 8) OR contains(lower(s_name), 'r#000000007')""")
def selected_items(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").withColumns({"seq": F.col("s_suppkey") - 1, "name": F.col("s_name")})
    return P.selected(s, ["3", "8", "R#000000007"]).select("s_suppkey", "s_name")


@query(f"""WITH {VERT}, {TRI}, a AS (SELECT s_nationkey AS path, s_suppkey AS mesh, s_suppkey AS object_id, 1.0 AS k FROM supplier UNION ALL SELECT s_nationkey, s_suppkey, 100000 + s_suppkey, 2.0 FROM supplier), co AS (SELECT t.object_id, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS "by", b.z AS bz, d.x AS cx, d.y AS cy, d.z AS cz FROM tri t JOIN vert a ON a.vid = v1 JOIN vert b ON b.vid = v2 JOIN vert d ON d.vid = v3),
m AS (SELECT object_id, count(*) AS t, sum({_AREA}) AS area FROM co GROUP BY 1), it AS (SELECT c_nationkey AS path, CASE WHEN c_custkey % 3 = 0 THEN 100000 ELSE 0 END + c_custkey % 10 + 1 AS object_id FROM customer),
p AS (SELECT it.path, t, area * k * k AS area FROM it JOIN a ON a.path = it.path AND a.object_id = it.object_id JOIN m ON m.object_id = a.mesh), s AS (SELECT path, count(*) AS objects, sum(t) AS triangles, sum(area) AS area FROM p GROUP BY 1), n AS (SELECT path, count(*) AS instances FROM it GROUP BY 1)
SELECT 'p' || path AS path, instances::BIGINT AS instances, coalesce(objects, 0)::BIGINT AS objects, coalesce(triangles, 0)::BIGINT AS triangles, (50 * coalesce(objects, 0))::BIGINT AS vertices, round(coalesce(area, 0), 2) AS area FROM n LEFT JOIN s USING (path)""")
def package_statistics(spark, sf_dir):
    """Nations are packages of suppliers' meshes and of assemblies that hold one at twice its size; customers place them."""
    p = lambda c: F.concat(F.lit("p"), c).alias("path")
    s, c = read(spark, sf_dir, "supplier").select(p(F.col("s_nationkey")), F.col("s_suppkey").cast("long").alias("object_id")), read(spark, sf_dir, "customer")
    scale = lambda k: F.array(*[F.lit(1.0 if i == 15 else k if i % 5 == 0 else 0.0) for i in range(16)])
    items = c.select(p(F.col("c_nationkey")), F.col("c_custkey").alias("seq"), (F.when(F.col("c_custkey") % 3 == 0, 100_000).otherwise(0) + F.col("c_custkey") % 10 + 1).cast("long").alias("object_id"), scale(1.0).alias("transform"))
    # an item whose object its package does not have is reported by rule 3002 and placed nowhere
    held = s.select("path", "object_id").unionByName(s.select("path", (F.col("object_id") + 100_000).alias("object_id")))
    components = s.select("path", (F.col("object_id") + 100_000).alias("object_id"), F.col("object_id").alias("child_object_id"), scale(2.0).alias("transform"))
    t = triangles(spark, sf_dir).join(s, "object_id")
    v = s.select("path", "object_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(49).cast("long"))).alias("vid")).join(vertices(spark, sf_dir), "vid")
    there = items.join(held, ["path", "object_id"], "left_semi")
    stats = P.geometry_stats(there, components, t, v)
    return items.groupBy("path").agg(F.count(F.lit(1)).alias("instances")).join(stats.drop("instances"), "path", "left").fillna(0).select("path", "instances", "objects", "triangles", "vertices", F.round("area", 2).alias("area"))




@query(f"""WITH {LINE}, corner AS (SELECT *, {_sql_places('v1', 'a')}, {_sql_places('v2', 'b')}, {_sql_places('v3', 'c')} FROM line), u AS (SELECT path, count(*) AS n FROM (SELECT DISTINCT path, object_id FROM line) GROUP BY 1),
m AS (SELECT path, count(*) AS n, sum({_AREA}) AS area FROM corner GROUP BY 1) SELECT 'p' || path AS path, u.n::BIGINT AS instances, u.n::BIGINT AS objects, m.n::BIGINT AS triangles, (8 * u.n)::BIGINT AS vertices, round(area, 2) AS area FROM u JOIN m USING (path)""")
def packages_read_back(spark, sf_dir):
    """Orders' meshes are written as packages, one for each path, read again as files are, and measured."""
    t = landed(_lines(spark, sf_dir, deal=True))
    objects = t.where("tid = 0").select("path", "object_id")
    v = objects.select("path", "object_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("vid"))
    none = F.lit(None)
    content = sinks.packages(
        objects.select("path", "object_id", F.lit("model").alias("type"), none.cast("string").alias("name"), none.cast("long").alias("pid"), none.cast("long").alias("pindex")),
        v.select("path", "object_id", "vid", *_places(F.col("vid"))), t.withColumn("pid", none.cast("long")),
        objects.where("false").select("path", "object_id", F.lit(0).alias("seq"), F.col("object_id").alias("child_object_id"), none.cast("string").alias("transform")),
        objects.select("path", F.col("object_id").alias("seq"), F.col("object_id").alias("item_object_id"), none.cast("string").alias("transform")),
    )
    rows = landed(files.parse_meshes(content))
    return P.geometry_stats(*files.geometry(rows)).select("path", "instances", "objects", "triangles", "vertices", F.round("area", 2).alias("area"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderkey % 5000 AS s, o_orderpriority AS w FROM orders), t AS (SELECT o_custkey AS c, sum(s)::BIGINT AS seconds, min(o_orderkey) AS first FROM o GROUP BY 1), u AS (SELECT c, count(*) AS filaments, sum(l_linenumber) AS grams FROM t JOIN lineitem ON l_orderkey = first GROUP BY 1)
SELECT 'c' || c AS path, seconds, (SELECT count(*) FROM o WHERE o_custkey = c AND w LIKE '1%')::BIGINT AS warnings, coalesce(filaments, 0)::BIGINT AS filaments, coalesce(grams, 0)::DOUBLE AS grams, 'Slicer-1.' || c AS slicer_version FROM t LEFT JOIN u USING (c)""")
def slicer_files(spark, sf_dir):
    """Customers' orders are written as a slicer's settings inside packages, read again, and summed up."""
    line = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.collect_list(F.concat(F.lit('<filament id="1" used_g="'), F.col("l_linenumber"), F.lit('"/>'))), "").alias("f"))
    o = read(spark, sf_dir, "orders").join(line, "o_orderkey", "left")
    warning = F.when(F.col("o_orderpriority").like("1%"), '<warning msg="late"/>').otherwise("")
    plate = F.concat(F.lit('<plate><metadata key="prediction" value="'), F.col("o_orderkey") % 5000, F.lit('"/>'), F.coalesce("f", F.lit("")), warning, F.lit("</plate>"))
    body = o.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", plate.alias("p")))), lambda x: x["p"]), "").alias("plates"))
    head = F.concat(F.lit(f'<config><header><header_item key="{vendor.CLIENT_TYPE}" value="Sli cer"/><header_item key="{vendor.CLIENT_VERSION}" value="1.'), F.col("o_custkey"), F.lit('"/></header>'))
    settings = body.select(F.concat(F.lit("c"), "o_custkey").alias("path"), F.lit(vendor.SLICE_INFO).alias("name"), F.concat(head, "plates", F.lit("</config>")).alias("text"))
    fixed = [("[Content_Types].xml", sinks.TYPES), ("_rels/.rels", sinks.RELS), ("3D/3dmodel.model", f'<model xmlns="{sinks.CORE}"><resources/><build/></model>')]
    more = settings.select("path", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(x).alias("text")) for n, x in fixed])).alias("e")).select("path", "e.*")
    content = sinks.archives(settings.unionByName(more).select("path", "name", F.col("text").cast("binary").alias("content")))
    rows = checkpointed(files.parse_files(content))
    return P.slicer_stats(*vendor.slicer_tables(rows)).withColumn("warnings", F.size("warnings").cast("long")).join(vendor.slicer_versions(rows), "path", "left")
