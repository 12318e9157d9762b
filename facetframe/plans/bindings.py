"""Queries of the mesh operators over the given tables: suppliers are mesh objects, order lines triangles, parts modulo 50 vertices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import geometry as G
from ..operators import repair as R
from ..operators import rules
from ..operators import structure as S
from ..operators.batches import dealt

LINE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return p.groupBy((F.col("p_partkey") % 50).alias("vid")).agg(F.min("p_size").cast("double").alias("x"), (F.min("p_retailprice") - 900).alias("y"), F.max("p_size").cast("double").alias("z"))


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dealt by object once, by the name object_id, so that steps that go by object need no shuffle of their own."""
    line = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("object_id"), *LINE_ORDER)
    tid = F.row_number().over(Window.partitionBy("object_id").orderBy(*LINE_ORDER)) - 1
    numbered = dealt(line, line.count(), "object_id").select("object_id", "l_orderkey", "l_linenumber", "l_partkey", tid.cast("long").alias("tid"))
    return numbered.select("object_id", "tid", (F.col("l_partkey") % 50).alias("v1"), ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % 50).alias("v2"), (F.col("l_orderkey") % 50).alias("v3"))


def untied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles where no tid is asked for: no sort."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("object_id"), F.lit(0).cast("long").alias("tid"), (F.col("l_partkey") % 50).alias("v1"), ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % 50).alias("v2"), (F.col("l_orderkey") % 50).alias("v3"))


VERT = "vert AS (SELECT CAST(p_partkey % 50 AS BIGINT) AS vid, CAST(min(p_size) AS DOUBLE) AS x, min(p_retailprice) - 900 AS y, CAST(max(p_size) AS DOUBLE) AS z FROM part GROUP BY p_partkey % 50)"
TRI = f"tri AS (SELECT l_suppkey AS object_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY {', '.join(LINE_ORDER)}) - 1 AS tid, l_partkey % 50 AS v1, (l_partkey * 7 + l_linenumber) % 50 AS v2, l_orderkey % 50 AS v3 FROM lineitem)"
EDGE = "de AS (SELECT object_id, tid, v1 AS s, v2 AS e FROM tri UNION ALL SELECT object_id, tid, v2, v3 FROM tri UNION ALL SELECT object_id, tid, v3, v1 FROM tri), ed AS (SELECT object_id, least(s, e) AS lo, greatest(s, e) AS hi, count(*) AS n FROM de GROUP BY ALL)"
CORNER = "co AS (SELECT t.*, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz FROM tri t JOIN vert a ON a.vid = v1 JOIN vert b ON b.vid = v2 JOIN vert c ON c.vid = v3), nm AS (SELECT *, (by_-ay)*(cz-az)-(bz-az)*(cy-ay) AS nx, (bz-az)*(cx-ax)-(bx-ax)*(cz-az) AS ny, (bx-ax)*(cy-ay)-(by_-ay)*(cx-ax) AS nz FROM co)"

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {VERT}, {TRI}, {CORNER} SELECT object_id, count(*)::BIGINT AS triangle_count, round(sum(sqrt(nx*nx+ny*ny+nz*nz)/2), 3) AS area,
round(sum((ax*(by_*cz-bz*cy)+ay*(bz*cx-bx*cz)+az*(bx*cy-by_*cx))/6), 2) AS volume, round(min(least(ax,bx,cx)), 6) AS min_x, round(min(least(ay,by_,cy)), 6) AS min_y, round(min(least(az,bz,cz)), 6) AS min_z,
round(max(greatest(ax,bx,cx)), 6) AS max_x, round(max(greatest(ay,by_,cy)), 6) AS max_y, round(max(greatest(az,bz,cz)), 6) AS max_z FROM nm GROUP BY object_id""")
def mesh_geometry(spark, sf_dir):
    m = G.measures(untied(spark, sf_dir), vertices(spark, sf_dir))
    return m.select("object_id", "triangle_count", F.round("area", 3).alias("area"), F.round("volume", 2).alias("volume"), *[F.round(f"{e}_{a}", 6).alias(f"{e}_{a}") for e in ("min", "max") for a in "xyz"])


@query(f"WITH {TRI}, {EDGE} SELECT object_id, count(*)::BIGINT AS edges, count(*) FILTER (n = 1)::BIGINT AS boundary, count(*) FILTER (n > 2)::BIGINT AS non_manifold, count(*) FILTER (n <> 2)::BIGINT AS irregular, bool_and(n = 2) AS is_manifold FROM ed GROUP BY object_id")
def edge_summary(spark, sf_dir):
    return G.edge_summary(untied(spark, sf_dir))


@query(f"WITH {TRI}, {EDGE}, u AS (SELECT DISTINCT object_id, s AS v FROM de), a AS (SELECT object_id, count(*) AS vertices FROM u GROUP BY 1), b AS (SELECT object_id, count(*) AS edges FROM ed GROUP BY 1), f AS (SELECT object_id, count(*) AS faces FROM tri GROUP BY 1) SELECT object_id, vertices, edges, faces, vertices - edges + faces AS euler FROM a JOIN b USING (object_id) JOIN f USING (object_id)")
def euler_characteristic(spark, sf_dir):
    return G.euler(untied(spark, sf_dir))


@query(f"""WITH {VERT}, {TRI}, {EDGE}, {CORNER}, dd AS (SELECT object_id, s, e, count(*) AS n FROM de GROUP BY ALL HAVING count(*) > 1)
SELECT object_id, 4001 AS code, CAST(tid AS VARCHAR) AS element, 1::BIGINT AS n FROM tri WHERE v1 = v2 OR v2 = v3 OR v1 = v3
UNION ALL SELECT object_id, 4002, lo || '-' || hi, n FROM ed WHERE n = 1 UNION ALL SELECT object_id, 4003, lo || '-' || hi, n FROM ed WHERE n > 2
UNION ALL SELECT object_id, 4004, s || '-' || e, n FROM dd UNION ALL SELECT object_id, 4005, CAST(tid AS VARCHAR), 1 FROM nm WHERE sqrt(nx*nx+ny*ny+nz*nz)/2 < 1e-6""")
def mesh_findings(spark, sf_dir):
    return G.findings(triangles(spark, sf_dir), vertices(spark, sf_dir))


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def dangling_references(spark, sf_dir):
    return S.dangling(read(spark, sf_dir, "orders"), "o_orderkey", read(spark, sf_dir, "lineitem"), "l_orderkey").select("o_orderkey", "o_custkey")


@query("SELECT coalesce(o_orderstatus <> 'P', true) AS printable, count(*)::BIGINT AS items FROM orders GROUP BY 1")
def printable_items(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy(F.coalesce(F.col("o_orderstatus") != "P", F.lit(True)).alias("printable")).agg(F.count(F.lit(1)).alias("items"))


@query("SELECT c_mktsegment AS object_type, count(*)::BIGINT AS n FROM customer GROUP BY 1")
def type_counts(spark, sf_dir):
    return read(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("object_type")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'r' || n_regionkey AS instance_id, 's' || s_suppkey AS object_id, (n_regionkey + n_nationkey + s_suppkey % 11)::DOUBLE AS x, (2 * (n_nationkey + 0.5 * (s_suppkey % 11)))::DOUBLE AS y, 8.0::DOUBLE AS det, 2 AS depth
FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def component_tree(spark, sf_dir):
    """Regions hold nations, which are scaled by 2, which hold suppliers; each edge moves its child."""
    def moved(x, y, scale):
        z = F.lit(0.0)
        return F.array(F.lit(scale), z, z, z, z, F.lit(scale), z, z, z, z, F.lit(scale), z, x.cast("double"), y.cast("double"), z, F.lit(1.0))

    n, s = read(spark, sf_dir, "nation"), read(spark, sf_dir, "supplier")
    items = read(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("instance_id"), F.concat(F.lit("r"), "r_regionkey").alias("object_id"), moved(F.col("r_regionkey"), F.lit(0), 1.0).alias("transform"))
    edges = n.select(F.concat(F.lit("r"), "n_regionkey").alias("object_id"), F.concat(F.lit("n"), "n_nationkey").alias("child_object_id"), moved(F.col("n_nationkey"), F.col("n_nationkey") * 2, 2.0).alias("transform")).unionByName(
        s.select(F.concat(F.lit("n"), "s_nationkey").alias("object_id"), F.concat(F.lit("s"), "s_suppkey").alias("child_object_id"), moved(F.col("s_suppkey") % 11 / 2, F.col("s_suppkey") % 11 / 2, 1.0).alias("transform")))
    leaves, _ = S.resolve(items, edges, 4)
    return leaves.where("object_id like 's%'").select("instance_id", "object_id", F.col("transform")[12].alias("x"), F.col("transform")[13].alias("y"), V.determinant(F.col("transform")).alias("det"), "depth")


def _rounds(n: int, one) -> str:
    return ", ".join(one(k) for k in range(1, n + 1))


#: The least tid moves from triangles to edges and back; far fewer rounds than these are needed for meshes of some hundred triangles on 50 vertices.
ISLANDS = _rounds(12, lambda k: f"m{k} AS MATERIALIZED (SELECT e.object_id, lo, hi, min(l) AS l FROM e JOIN t{k - 1} USING (object_id, tid) GROUP BY ALL), t{k} AS MATERIALIZED (SELECT e.object_id, e.tid, min(l) AS l FROM e JOIN m{k} USING (object_id, lo, hi) GROUP BY ALL)")


@query(f"""WITH {TRI.replace("tri AS (", "tri AS MATERIALIZED (")}, e AS MATERIALIZED (SELECT object_id, tid, least(a, b) AS lo, greatest(a, b) AS hi FROM (SELECT object_id, tid, v1 AS a, v2 AS b FROM tri UNION ALL SELECT object_id, tid, v2, v3 FROM tri UNION ALL SELECT object_id, tid, v3, v1 FROM tri)),
t0 AS MATERIALIZED (SELECT object_id, tid, tid AS l FROM tri), {ISLANDS} SELECT object_id, tid, l AS island FROM t12""")
def mesh_islands(spark, sf_dir):
    return S.islands(triangles(spark, sf_dir))


@query(SQL["mesh_islands"])
def mesh_islands_whole(spark, sf_dir):
    """The same as mesh_islands, kept by its name of the first round."""
    return mesh_islands(spark, sf_dir)


BOX = "box AS (SELECT s_nationkey AS id, min(s_acctbal) AS x0, max(s_acctbal) AS x1, min(s_suppkey) AS y0, max(s_suppkey) AS y1, min(s_suppkey % 7) AS z0, max(s_suppkey % 7) AS z1 FROM supplier GROUP BY 1)"


@query(f"WITH {BOX} SELECT a.id AS a_id, b.id AS b_id FROM box a JOIN box b ON a.id < b.id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1 AND a.z0 < b.z1 AND b.z0 < a.z1")
def item_overlaps(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    axes = (("x", F.col("s_acctbal")), ("y", F.col("s_suppkey")), ("z", F.col("s_suppkey") % 7))
    boxes = s.groupBy(F.col("s_nationkey").alias("id")).agg(*[f(c).alias(f"{n}_{a}") for a, c in axes for n, f in (("min", F.min), ("max", F.max))])
    return S.box_overlaps(boxes, 2000.0, closed=False)


@query("SELECT label, round(min(embedding[1]), 5) AS min_x, round(max(embedding[1]), 5) AS max_x, round(min(embedding[2]), 5) AS min_y, round(max(embedding[2]), 5) AS max_y, round(min(embedding[3]), 5) AS min_z, round(max(embedding[3]), 5) AS max_z, count(*)::BIGINT AS points FROM (SELECT label, list_transform(embedding, lambda v: v::DOUBLE) AS embedding FROM embeddings) GROUP BY 1")
def point_cloud_boxes(spark, sf_dir):
    at = lambda i: F.col("embedding")[i].cast("double")
    return read(spark, sf_dir, "embeddings").groupBy("label").agg(*[F.round(f(at(i)), 5).alias(f"{n}_{a}") for i, a in enumerate("xyz") for n, f in (("min", F.min), ("max", F.max))], F.count(F.lit(1)).alias("points"))


@query("WITH k AS (SELECT vec_id, CAST(round(embedding[1]::DOUBLE * 10) AS BIGINT) AS a, CAST(round(embedding[2]::DOUBLE * 10) AS BIGINT) AS b, CAST(round(embedding[3]::DOUBLE * 10) AS BIGINT) AS c, label::BIGINT AS object_id FROM embeddings) SELECT object_id, vec_id AS vid, min(vec_id) OVER (PARTITION BY object_id, a, b, c) AS kept FROM k")
def stitch_vertices(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("object_id"), F.col("vec_id").alias("vid"), *[F.col("embedding")[i].cast("double").alias(a) for i, a in enumerate("xyz")])
    return S.stitch(v, v.select("object_id", F.col("vid").alias("v1"), F.col("vid").alias("v2"), F.col("vid").alias("v3")), 0.1)[0]


@query(f"WITH {TRI}, g AS (SELECT * FROM tri WHERE v1 <> v2 AND v2 <> v3 AND v1 <> v3), k AS (SELECT *, row_number() OVER (PARTITION BY object_id, list_sort([v1, v2, v3]) ORDER BY tid) AS r FROM g) SELECT object_id, tid, v1, v2, v3 FROM k WHERE r = 1")
def clean_faces(spark, sf_dir):
    return S.unique_faces(S.sound_faces(triangles(spark, sf_dir))).select("object_id", "tid", "v1", "v2", "v3")


@query("WITH u AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem) SELECT s AS object_id, p AS vid, row_number() OVER (PARTITION BY s ORDER BY p) - 1 AS new_vid FROM u")
def dense_vertices(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("object_id"), F.col("l_partkey").alias("v"))
    return S.used_vertices(dealt(line, line.count(), "object_id").select("object_id", F.col("v").alias("vid")).distinct(), line.select("object_id", F.col("v").alias("v1"), F.col("v").alias("v2"), F.col("v").alias("v3"))).select("object_id", "vid", F.col("new_vid").cast("long").alias("new_vid"))


@query("WITH a AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1) SELECT o_custkey, a.n AS left_value, b.n AS right_value, CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (o_custkey) WHERE a.n IS DISTINCT FROM b.n")
def model_diff(spark, sf_dir):
    half = lambda k: read(spark, sf_dir, "orders").where(F.col("o_orderkey") % 2 == k).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return S.compare(half(0), half(1), "o_custkey", "n")


@query("WITH t AS (SELECT s_nationkey, max(s_suppkey) + 1 AS span FROM supplier GROUP BY 1) SELECT s_nationkey, span, coalesce(sum(span) OVER (ORDER BY s_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM t")
def merge_offsets(spark, sf_dir):
    return S.merge_offsets(read(spark, sf_dir, "supplier"), "s_nationkey", "s_suppkey")


@query("SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey)::INT AS new_id FROM supplier")
def compact_ids(spark, sf_dir):
    return S.compact_ids(read(spark, sf_dir, "supplier"), "s_nationkey", "s_suppkey")


@query("SELECT min(doc_id) AS doc_id, count(*)::BIGINT AS copies FROM documents GROUP BY text")
def attachment_dedupe(spark, sf_dir):
    """Equal contents by a 256-bit digest, so contents are not shuffled."""
    return read(spark, sf_dir, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).select("doc_id", "copies")


@query("""WITH n AS (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) AS c FROM supplier), i AS (SELECT s_suppkey, abs(s_acctbal) AS w, row_number() OVER (ORDER BY s_suppkey) - 1 AS q FROM supplier),
k AS (SELECT s_suppkey, w, q % c AS col, q // c AS row FROM i, n), m AS (SELECT col, max(w) AS w FROM k GROUP BY 1), p AS (SELECT col, coalesce(sum(w + 10) OVER (ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x FROM m)
SELECT s_suppkey, col, row, round(x, 4) AS x FROM k JOIN p USING (col)""")
def grid_placement(spark, sf_dir):
    items = read(spark, sf_dir, "supplier").select("s_suppkey", F.abs("s_acctbal").alias("w"))
    return S.grid_places(items, "s_suppkey", "w", 10.0, items.count()).select("s_suppkey", F.col("col").cast("long").alias("col"), "row", F.round("x", 4).alias("x"))


@query("SELECT event_type, count(*)::BIGINT AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total FROM events GROUP BY 1")
def vendor_settings(spark, sf_dir):
    k = F.get_json_object("props", "$.k").try_cast("long")
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total"))


@query("WITH d AS (SELECT p_partkey, CAST(p_partkey * 37 % 20000 AS BIGINT) AS s FROM part) SELECT p_partkey, CASE WHEN s >= 3600 THEN (s // 3600) || 'h' || CASE WHEN s % 60 > 0 THEN ' ' || (s % 3600 // 60) || 'm ' || (s % 60) || 's' WHEN s % 3600 // 60 > 0 THEN ' ' || (s % 3600 // 60) || 'm' ELSE '' END WHEN s >= 60 THEN (s // 60) || 'm' || CASE WHEN s % 60 > 0 THEN ' ' || (s % 60) || 's' ELSE '' END ELSE s || 's' END AS duration, printf('#%02X%02X%02XFF', p_partkey % 256, p_partkey * 7 % 256, p_partkey * 13 % 256) AS color FROM d")
def text_functions(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    raw = F.format_string("#%02x%02x%02x", F.col("p_partkey") % 256, F.col("p_partkey") * 7 % 256, F.col("p_partkey") * 13 % 256)
    return p.select("p_partkey", V.duration_text(F.col("p_partkey") * 37 % 20000).alias("duration"), V.color_text(V.color_parts(raw)).alias("color"))


@query("""WITH u(unit, m) AS (VALUES ('micron', 1e-6::DOUBLE), ('millimeter', 1e-3), ('centimeter', 1e-2), ('inch', 0.0254), ('foot', 0.3048), ('meter', 1.0)), p AS (SELECT p_partkey, p_size::DOUBLE AS v, ['micron','millimeter','centimeter','inch','foot','meter'][p_partkey % 6 + 1] AS unit FROM part)
SELECT p_partkey, unit, round(v * m / 0.001, 6) AS mm FROM p JOIN u USING (unit)""")
def unit_conversion(spark, sf_dir):
    units = F.array(*[F.lit(u) for u in V.UNIT_METRES])
    return read(spark, sf_dir, "part").select("p_partkey", units[(F.col("p_partkey") % 6).cast("int")].alias("unit"), F.col("p_size").cast("double").alias("v")).select("p_partkey", "unit", F.round(V.convert_unit(F.col("v"), F.col("unit"), F.lit("millimeter")), 6).alias("mm"))


@query(f"""WITH {VERT}, {TRI}, {CORNER}, g AS (SELECT object_id, sum(sqrt(nx*nx+ny*ny+nz*nz)/2) AS area, sum((ax*(by_*cz-bz*cy)+ay*(bz*cx-bx*cz)+az*(bx*cy-by_*cx))/6) AS volume, count(*) AS t, min(least(ax,bx,cx)) AS x0, max(greatest(ax,bx,cx)) AS x1 FROM nm GROUP BY 1)
SELECT o_orderkey AS instance_id, object_id, t::BIGINT AS triangle_count, round(area * k * k, 2) AS area, round(volume * k * k * k, 1) AS volume, round(x0 * k + o_custkey, 5) AS placed_min_x, round(x1 * k + o_custkey, 5) AS placed_max_x
FROM (SELECT *, (1 + o_orderkey % 3)::DOUBLE AS k FROM orders) JOIN g ON object_id = o_orderkey % 10""")
def placed_instances(spark, sf_dir):
    """Orders place scaled copies of the first ten objects: each mesh is measured once, then joined."""
    k, z = (1 + F.col("o_orderkey") % 3).cast("double"), F.lit(0.0)
    m = F.array(k, z, z, z, z, k, z, z, z, z, k, z, F.col("o_custkey").cast("double"), z, z, F.lit(1.0))
    inst = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("instance_id"), (F.col("o_orderkey") % 10).alias("object_id"), m.alias("transform"))
    p = G.placed_measures(inst, G.measures(untied(spark, sf_dir), vertices(spark, sf_dir)))
    return p.select("instance_id", "object_id", "triangle_count", F.round("area", 2).alias("area"), F.round("volume", 1).alias("volume"), F.round("placed_min_x", 5).alias("placed_min_x"), F.round("placed_max_x", 5).alias("placed_max_x"))


#: Labels move along links and jump to the label's label, so that 24 rounds cover any fan on 50 vertices.
FANS = _rounds(24, lambda k: f"n{k} AS MATERIALIZED (SELECT u.object_id, u.v, u.a, least(min(p.l), min(q.l)) AS l FROM u JOIN f{k - 1} p ON p.object_id = u.object_id AND p.v = u.v AND p.a = u.a JOIN f{k - 1} q ON q.object_id = u.object_id AND q.v = u.v AND q.a = u.b GROUP BY ALL), f{k} AS MATERIALIZED (SELECT x.object_id, x.v, x.a, least(x.l, y.l) AS l FROM n{k} x JOIN n{k} y ON y.object_id = x.object_id AND y.v = x.v AND y.a = x.l)")


@query(f"""WITH {TRI.replace("tri AS (", "tri AS MATERIALIZED (")}, g AS (SELECT * FROM tri WHERE v1 <> v2 AND v2 <> v3 AND v1 <> v3), l AS (SELECT object_id, v1 AS v, v2 AS a, v3 AS b FROM g UNION SELECT object_id, v2, v3, v1 FROM g UNION SELECT object_id, v3, v1, v2 FROM g), u AS MATERIALIZED (SELECT * FROM l UNION SELECT object_id, v, b, a FROM l),
f0 AS MATERIALIZED (SELECT DISTINCT object_id, v, a, a AS l FROM u), {FANS} SELECT object_id, v, count(DISTINCT l)::INT AS fans FROM f24 GROUP BY 1, 2""")
def vertex_fans(spark, sf_dir):
    return S.vertex_fans(untied(spark, sf_dir))


@query(SQL["vertex_fans"])
def vertex_fans_whole(spark, sf_dir):
    """The same as vertex_fans, kept by its name of the first round."""
    return vertex_fans(spark, sf_dir)


@query("""WITH o AS (SELECT s_nationkey AS path, s_suppkey AS object_id, s_suppkey % 37 AS pid FROM supplier), res AS (SELECT DISTINCT c_nationkey AS path, o_orderkey % 37 AS resource_id FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 37 < 30),
i AS (SELECT c_nationkey AS path, c_custkey AS seq, c_custkey % 20 AS obj FROM customer)
SELECT path::VARCHAR AS path, 2001 AS code, 'error' AS severity, object_id::BIGINT AS owner, pid::VARCHAR AS element FROM o WHERE NOT EXISTS (SELECT 1 FROM res WHERE res.path = o.path AND resource_id = pid) AND NOT EXISTS (SELECT 1 FROM o b WHERE b.path = o.path AND b.object_id = o.pid)
UNION ALL SELECT path::VARCHAR, 2010, 'error', object_id, '0' FROM o WHERE false
UNION ALL SELECT path::VARCHAR, 3002, 'error', obj, seq::VARCHAR FROM i WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.path = i.path AND object_id = obj)
UNION ALL SELECT i.path::VARCHAR, 3010, 'error', obj, seq::VARCHAR FROM i JOIN o ON o.path = i.path AND object_id = obj WHERE obj % 3 = 0""")
def reference_rules(spark, sf_dir):
    """Nations are packages, suppliers objects, order numbers modulo 37 of its customers resources, customers build items."""
    path = lambda c: F.col(c).cast("string").alias("path")
    objects = read(spark, sf_dir, "supplier").select(path("s_nationkey"), F.col("s_suppkey").cast("long").alias("object_id"), F.when(F.col("s_suppkey") % 3 == 0, "other").otherwise("model").alias("type"), F.lit("mesh").alias("kind"), (F.col("s_suppkey") % 37).cast("long").alias("pid"), F.lit(None).cast("long").alias("pindex"), F.lit(None).cast("long").alias("ref_id"))
    resources = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(path("c_nationkey"), (F.col("o_orderkey") % 37).cast("long").alias("resource_id")).where("resource_id < 30").distinct().withColumn("resource", F.lit("colorgroup")).withColumn("matid", F.lit(None).cast("long"))
    items = read(spark, sf_dir, "customer").select(path("c_nationkey"), F.col("c_custkey").cast("long").alias("seq"), (F.col("c_custkey") % 20).cast("long").alias("item_object_id"))
    return rules.validate({"objects": objects, "resources": resources, "items": items}, codes=(2001, 2010, 3002, 3010))


@query()
def harmonized_faces(spark, sf_dir):
    return R.harmonize(S.unique_faces(S.sound_faces(triangles(spark, sf_dir))))


@query()
def filled_holes(spark, sf_dir):
    return R.fill_holes(S.unique_faces(S.sound_faces(triangles(spark, sf_dir))))
