"""Sources: package archives, STL and OBJ files as tables. Errors are rows, never a failed run.

Every reader gives tagged rows (path, part, kind, object_id, seq, payload); `tables` splits them, `model` and `geometry` make
what rules and statistics take. part is the model part of a package, null for its root. One file is one task's work.
"""

from __future__ import annotations

import io
import json
import re
import struct
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import csv
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import identity, parse_transform, part_path
from .vendor import vendor_rows

ROWS = "path string, part string, kind string, object_id long, seq long, payload string"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def sniff(content: bytes, path: str) -> str:
    head = content[:6].lstrip().lower()
    if content[:4] == b"PK\x03\x04":
        return "package"
    if path.lower().endswith((".obj", ".mtl")):
        return path[-3:].lower()
    if head.startswith(b"solid") or path.lower().endswith(".stl"):
        return "stl"
    return "unknown"


def stl_rows(content: bytes) -> Iterator[tuple]:
    """Corners with the same bits are one vertex, numbered by first use. A facet of a text file has 3 vertices."""
    n = struct.unpack("<I", content[80:84])[0] if len(content) >= 84 else -1
    if len(content) >= 5 and content[:5].lower() != b"solid" or n >= 0 and len(content) == 84 + 50 * n:
        if n < 0 or len(content) < 84 + 50 * n:
            raise ValueError("binary STL is cut short")
        facets = np.frombuffer(content, np.dtype([("f", "<f4", 12), ("a", "<u2")]), n, 84)["f"][:, 3:].reshape(-1, 3)
        solids = [facets]
    else:
        solids, corners, begun = [], [], 0
        for line in content.decode("utf-8", "replace").splitlines():
            word = line.split()
            if word[:1] == ["facet"]:
                begun = len(corners)
            elif word[:1] == ["vertex"]:
                corners.append([float(x) for x in word[1:4]])
            elif word[:1] == ["endfacet"] and len(corners) - begun != 3:
                raise ValueError("a facet needs 3 vertices")
            elif word[:1] == ["endsolid"]:
                solids.append(np.array(corners, np.float32).reshape(-1, 3))
                corners = []
        if corners:
            solids.append(np.array(corners, np.float32).reshape(-1, 3))
    for k, points in enumerate(solids, 1):
        yield "object", k, 0, {"type": "model", "kind": "mesh"}
        seen: dict[bytes, int] = {}
        at = [seen.setdefault(p.tobytes(), len(seen)) for p in np.ascontiguousarray(points)]
        for i, bits in enumerate(seen):
            yield "vertex", k, i, dict(zip("xyz", np.frombuffer(bits, np.float32).astype(float).tolist()))
        for t in range(len(at) // 3):
            yield "triangle", k, t, dict(zip(("v1", "v2", "v3"), at[3 * t : 3 * t + 3]))


def obj_rows(content: bytes) -> Iterator[tuple]:
    """Groups become objects with vertices of their own; faces are fans and keep the material in use."""
    points, groups, now, material, libraries = [], {}, "default", None, 0
    for line in content.decode("utf-8", "replace").splitlines():
        word = line.split()
        if not word:
            continue
        if word[0] == "v":
            points.append([float(x) for x in word[1:4]])
        elif word[0] in ("g", "o"):
            now = " ".join(word[1:]) or "default"
        elif word[0] == "usemtl":
            material = " ".join(word[1:]) or None
        elif word[0] == "mtllib":
            yield "mtllib", None, libraries, {"name": " ".join(word[1:])}
            libraries += 1
        elif word[0] == "f" and len(word) > 3:
            at = [int(x.split("/")[0]) for x in word[1:]]
            if min(at) < 1 or max(at) > len(points):
                raise ValueError("face index out of range")
            groups.setdefault(now, []).extend((at[0] - 1, at[i] - 1, at[i + 1] - 1, material) for i in range(1, len(at) - 1))
    for k, (name, faces) in enumerate(groups.items(), 1):
        yield "object", k, 0, {"type": "model", "kind": "mesh", "name": name}
        seen: dict[int, int] = {}
        made = [[seen.setdefault(v, len(seen)) for v in f[:3]] for f in faces]
        for v, i in seen.items():
            yield "vertex", k, i, dict(zip("xyz", points[v]))
        for t, (f, face) in enumerate(zip(made, faces)):
            yield "triangle", k, t, dict(zip(("v1", "v2", "v3"), f)) | ({"material": face[3]} if face[3] else {})


def mtl_rows(content: bytes) -> Iterator[tuple]:
    """Materials with their diffuse colour, grey where none is given; textures are left out."""
    found: list[dict] = []
    for line in content.decode("utf-8", "replace").splitlines():
        word = line.split()
        if word[:1] == ["newmtl"]:
            found.append({"name": " ".join(word[1:]), "color": "#808080FF"})
        elif word[:1] == ["Kd"] and found and len(word) > 3:
            found[-1]["color"] = "#" + "".join(f"{int(min(1.0, max(0.0, float(x))) * 255 + 0.5):02X}" for x in word[1:4]) + "FF"
    for i, m in enumerate(found):
        yield "material", None, i, m


#: Elements that are resources, and by the element around them the kind of row of their children.
RESOURCES = ("basematerials", "colorgroup", "texture2d", "texture2dgroup", "compositematerials", "multiproperties", "slicestack", "volumetricstack", "displacement2d", "normvectorgroup", "disp2dgroup")
CHILDREN = {
    ("vertices", "vertex"): "vertex", ("triangles", "triangle"): "triangle", ("components", "component"): "component", ("basematerials", "base"): "base", ("colorgroup", "color"): "color",
    ("texture2dgroup", "tex2coord"): "tex2coord", ("compositematerials", "composite"): "composite", ("multiproperties", "multi"): "multi", ("normvectors", "normvector"): "normal", ("gradients", "gradient"): "gradient",
    ("slicestack", "slice"): "slice", ("slicestack", "sliceref"): "sliceref", ("volumetricstack", "layer"): "layer", ("volumetricstack", "volumetricref"): "volumetricref", ("beams", "beam"): "beam", ("beamset", "ref"): "beamref",
    ("booleanshape", "boolean"): "operand", ("build", "item"): "item",
}
SHAPES = {"mesh": "mesh", "components": "components", "displacementmesh": "displacement", "booleanshape": "boolean"}
TYPES = ("model", "support", "solidsupport", "surface", "other")


#: An object that is a mesh of plain numbers and no more, items that only name an object, and bytes of text that are searched for them at once.
PLAIN_OBJECT = re.compile(rb'<object id="([0-9]{1,18})"(?: type="([a-z]+)")?><mesh><vertices>((?:<vertex x="[-0-9.E]{1,40}" y="[-0-9.E]{1,40}" z="[-0-9.E]{1,40}"/>)*+)</vertices><triangles>((?:<triangle v1="[0-9]{1,9}" v2="[0-9]{1,9}" v3="[0-9]{1,9}"/>)*+)</triangles></mesh></object>')
PLAIN_ITEMS = re.compile(rb'(?:<item objectid="[0-9]{1,18}"/>)++')
WINDOW = 1 << 20
WIDEST = 16 << 20


def _plain_events(source, names: list[str], open_: list) -> Iterator[tuple]:
    """The events of ElementTree.iterparse, but for plain objects and items, which come as ("objects", matches) and ("items", matches).

    The parser is not shown those: it has been fed up to them and stands among the children of <resources> or <build>, as an
    element tried there shows (within a comment or an attribute there would be no such element).
    """
    parser = ElementTree.XMLPullParser(("start", "end"))
    text, at, more = b"", 0, True

    def fed(data: bytes) -> Iterator[tuple]:
        wrong = None
        parser.feed(data)
        try:
            parser.flush()
        except ElementTree.ParseError as e:
            wrong = e  # what is in front of it comes first
        yield from parser.read_events()
        if wrong:
            raise wrong

    def stands(*where: str) -> bool:
        if names != list(where):
            return False
        parser.feed(b"<_/>")
        parser.flush()
        tried = [el for _, el in parser.read_events()]
        if tried:
            open_[-1].remove(tried[0])
        return len(tried) == 2

    def longer() -> None:
        nonlocal text, at, more
        piece = source.read(WINDOW)
        text, at, more = text[at:] + piece, 0, bool(piece)

    fresh = 0  # where the search goes on: behind the start of what is not plain
    while True:
        found = [i for i in (text.find(b"<object ", fresh), text.find(b"<item ", fresh)) if i >= 0]
        if not found:
            end = max(at, len(text) - 8) if more else len(text)
            if at < end:
                yield from fed(text[at:end])
            at = end
            if not more:
                break
            longer()
            fresh = 0
            continue
        if min(found) > at:
            yield from fed(text[at : min(found)])
        at = min(found)
        plain, where, kind, end = (PLAIN_OBJECT, ("model", "resources"), "objects", b"</object>") if text.startswith(b"<object ", at) else (PLAIN_ITEMS, ("model", "build"), "items", b"/>")
        if stands(*where):
            while more and text.find(end, at) < 0 and len(text) - at < WIDEST:
                longer()
            run = []
            while m := plain.match(text, at):
                run.append(m)
                at = m.end()
            if run:
                yield kind, run
                fresh = at
                continue
        fresh = at + 1
    parser.close()
    yield from parser.read_events()


def model_rows(source, plain: bool = False) -> Iterator[tuple]:
    """One model part, read as a stream of elements. What an element is follows from the one around it, so vertices of slices are none of the mesh.

    With plain, a row "mesh" with its match stands for an object that PLAIN_OBJECT fits, and a row "placed" with the object's id for a plain item.
    """
    names, open_, owner, thing, seq, seen, saw_build = [], [], None, None, {}, set(), False

    def new(a: dict) -> int:
        if "id" not in a:
            raise ValueError("a resource needs an id")
        if int(a["id"]) in seen:
            raise ValueError(f"duplicate id {a['id']}")
        seen.add(int(a["id"]))
        return int(a["id"])

    for event, el in _plain_events(source, names, open_) if plain else ElementTree.iterparse(source, events=("start", "end")):
        if event == "objects":
            for m in el:
                if (m[2] or b"model").decode() not in TYPES:
                    raise ValueError(f"object type {m[2].decode()}")
                new({"id": m[1].decode()})
                yield "mesh", int(m[1]), 0, m
            continue
        if event == "items":
            for m in el:
                ids, k = m[0].decode().split('"')[1::2], seq.get((None, "item"), -1)
                yield from (("placed", int(x), k + i, {}) for i, x in enumerate(ids, 1))
                seq[None, "item"] = k + len(ids)
            continue
        tag = _local(el.tag)
        if event == "start":
            a = {_local(k): v for k, v in el.attrib.items()}
            around = names[-1] if names else None
            if tag == "model":
                if names:
                    raise ValueError("a model within a model")
                if "space" in a:
                    raise ValueError("xml:space is not allowed")
                yield "model", None, 0, {"unit": a.get("unit", "millimeter"), "language": a.get("lang")}
            elif tag == "object" and around == "resources":
                if a.get("type", "model") not in TYPES:
                    raise ValueError(f"object type {a['type']}")
                owner, thing = new(a), {"type": a.get("type", "model"), "kind": "mesh", "ref_id": None} | {k: a.get(k) for k in ("name", "pid", "pindex", "partnumber", "UUID", "thumbnail")}
                for key, kind in (("slicestackid", "slicestack"), ("volumetricstackid", "volumetricstack")):
                    if key in a:
                        thing |= {"kind": kind, "ref_id": a[key]}
            elif tag in RESOURCES and around == "resources":
                owner = new(a)
                yield "resource", owner, 0, a | {"resource": tag}
            elif thing is not None and around == "object" and tag in SHAPES:
                if thing["ref_id"] is None:
                    thing["kind"] = SHAPES[tag]
                if tag == "booleanshape":
                    yield "booleanshape", owner, 0, a
            elif tag == "build":
                saw_build, owner = True, None
            elif (kind := CHILDREN.get((around, tag))) and not (tag == "vertex" and "slice" in names):
                k = seq[owner, kind] = seq.get((owner, kind), -1) + 1
                yield kind, owner, k, a
            names.append(tag)
            open_.append(el)
        else:
            names.pop()
            open_.pop()
            if tag == "metadata":
                yield "metadata", owner, 0, {"name": el.get("name"), "value": el.text}
            elif tag == "object" and thing is not None:
                yield "object", owner, 0, thing
                owner = thing = None
            elif tag in RESOURCES and names[-1:] == ["resources"]:
                owner = None
            el.clear()
            if open_:
                open_[-1].remove(el)
    if not saw_build:
        raise ValueError("no build element")


def package_rows(content: bytes, plain: bool = False) -> Iterator[tuple]:
    """Entries, relationships and all model parts, the root first; rows of other parts have a fifth field, the part's path. plain is that of `model_rows`."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        for i, n in enumerate(z.infolist()):
            yield "entry", None, i, {"name": n.filename, "size": n.file_size}
        if "_rels/.rels" not in names:
            raise ValueError("no _rels/.rels")
        if "[Content_Types].xml" in names:
            for i, t in enumerate(ElementTree.fromstring(z.read("[Content_Types].xml"))):
                yield "contenttype", None, i, {"rule": _local(t.tag), "for": t.get("Extension") or t.get("PartName"), "type": t.get("ContentType")}
        targets, tickets = [], 0
        for i, r in enumerate(ElementTree.fromstring(z.read("_rels/.rels"))):
            kind, target = r.get("Type") or "", (r.get("Target") or "").lstrip("/")
            yield "relationship", None, i, {k: r.get(k) for k in ("Id", "Type", "Target")} | {"TargetMode": r.get("TargetMode", "Internal")}
            if r.get("TargetMode") == "External":
                raise ValueError("external relationship")
            if kind.endswith("/3dmodel"):
                targets.append(target)
            elif kind.endswith("/thumbnail") and target not in names:
                raise ValueError(f"no thumbnail {target}")
            tickets += kind.endswith("/printticket")
        if len(targets) != 1:
            raise ValueError(f"{len(targets)} model relationships")
        if tickets > 1:
            raise ValueError(f"{tickets} print tickets")
        for name in [targets[0], *(n for n in names if n.lower().endswith(".model") and n != targets[0])]:
            try:
                with z.open(name) as part:
                    for row in model_rows(part, plain):
                        yield row if name == targets[0] else (*row, name)
            except ElementTree.ParseError:
                if plain:  # its place is told by a parser that has seen all
                    with z.open(name) as part:
                        for _ in model_rows(part):
                            pass
                raise
        yield from vendor_rows(z, names)


READERS = {"package": package_rows, "stl": stl_rows, "obj": obj_rows, "mtl": mtl_rows}


def parse_files(files: DataFrame) -> DataFrame:
    """files: path, content. Tagged rows in batches; a file that can't be read ends in a row of kind 'error'."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    kind = sniff(content, path)
                    for row in READERS[kind](content) if kind in READERS else [("error", None, 0, {"message": "unknown file type"})]:
                        out.append((path, row[4] if len(row) > 4 else None, row[0], row[1], row[2], json.dumps(row[3])))
                        if len(out) >= 50_000:
                            yield _frame(out)
                            out = []
                except Exception as e:  # noqa: BLE001  a bad file is a result
                    out.append((path, None, "error", None, 0, json.dumps({"message": str(e)})))
            if out:
                yield _frame(out)

    return files.select("path", "content").mapInPandas(parse, ROWS)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    made = pd.DataFrame(rows, columns=["path", "part", "kind", "object_id", "seq", "payload"])
    made["object_id"] = made["object_id"].astype("Int64")
    return made


MESHES = pa.schema([("path", pa.string()), ("part", pa.string()), ("kind", pa.string()), ("object_id", pa.int64()), ("seq", pa.int64()), ("payload", pa.string()), ("xyz", pa.list_(pa.float32())), ("corners", pa.list_(pa.int32()))])
OF_TYPE = {t and t.encode(): json.dumps({"type": t or "model", "kind": "mesh"}) for t in (None, *TYPES)}
#: Bytes of plain objects that become rows at once.
PLAIN_BYTES = 4 << 20


def parse_meshes(files: DataFrame) -> DataFrame:
    """The rows of parse_files for `geometry`, but that a plain object (PLAIN_OBJECT) is one row of kind 'mesh': xyz has the coordinates of its vertices, corners the vertices of its triangles. An item that has no more than its object's id is a row of kind 'placed' with that id."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                out, held = [], 0
                try:
                    content = content.as_py()
                    kind = sniff(content, path)
                    rows = package_rows(content, plain=True) if kind == "package" else READERS[kind](content) if kind in READERS else [("error", None, 0, {"message": "unknown file type"})]
                    for row in rows:
                        out.append(row)
                        held += len(row[3][0]) if row[0] == "mesh" else 80
                        if held >= PLAIN_BYTES:
                            yield _meshes(path, out)
                            out, held = [], 0
                except Exception as e:  # noqa: BLE001  a bad file is a result
                    out.append(("error", None, 0, {"message": str(e)}))
                if out:
                    yield _meshes(path, out)

    return files.select("path", "content").mapInArrow(parse, ROWS + ", xyz array<float>, corners array<int>")


def _meshes(path: str, rows: list[tuple]) -> pa.RecordBatch:
    """One batch of rows of a file; meshes with numbers that are not of the plain form after all are given element by element."""
    meshes = [r for r in rows if r[0] == "mesh"]
    try:
        xyz, corners = _numbers([r[3] for r in meshes])
    except pa.ArrowInvalid:
        rows = [x for r in rows for x in (_elements(r) if r[0] == "mesh" else (r,))]
        meshes, (xyz, corners) = [], _numbers([])
    is_mesh = np.fromiter((r[0] == "mesh" for r in rows), bool, len(rows))
    at = pa.array(np.cumsum(is_mesh) - 1, mask=~is_mesh)
    payload = [OF_TYPE[r[3][2]] if r[0] == "mesh" else None if r[0] == "placed" else json.dumps(r[3]) for r in rows]
    columns = [pa.array([path] * len(rows), pa.string()), pa.array([r[4] if len(r) > 4 else None for r in rows], pa.string()), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array(payload, pa.string()), xyz.take(at), corners.take(at)]
    return pa.RecordBatch.from_arrays(columns, schema=MESHES)


def _numbers(plain: list) -> tuple[pa.Array, pa.Array]:
    """Coordinates and corners of plain objects: only what lies between quotes is left of their text, which is read as CSV."""

    def lists(group: int, letters: bytes, fields: int, kind: pa.DataType) -> pa.Array:
        sections = [m[group] for m in plain]
        n = np.array([s.count(b"<") for s in sections], np.int64)
        text = b"".join(sections).translate(bytes.maketrans(b">", b"\n"), letters)
        names = [f"f{i}" for i in range(7)]
        if not text:
            flat = pa.array([], kind)
        else:
            options = csv.ConvertOptions(column_types={names[i]: kind for i in (1, 3, 5)}, include_columns=[names[i] for i in (1, 3, 5)], null_values=[], strings_can_be_null=False)
            t = csv.read_csv(io.BytesIO(text), csv.ReadOptions(use_threads=False, column_names=names, block_size=len(text) + 1), csv.ParseOptions(delimiter='"', quote_char=False), options)
            flat = pa.array(np.column_stack([t.column(i).to_numpy() for i in range(3)]).ravel(), kind)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(3 * n)]), pa.int32()), flat)

    return lists(3, b"<vertex yz=/", 3, pa.float32()), lists(4, b"<triangle v=/", 3, pa.int32())


def _elements(row: tuple) -> Iterator[tuple]:
    """A plain object as `model_rows` gives any other."""
    text = b"<model><resources>" + row[3][0] + b"</resources><build/></model>"
    yield from ((*r, *row[4:]) for r in model_rows(io.BytesIO(text)) if r[1] is not None)


def read_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    return parse_files(spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path))


def _split(rows: DataFrame):
    at = lambda k, t="string": F.get_json_object("payload", f"$.{k}").try_cast(t).alias(k)
    return at, lambda *kinds: rows.where(F.col("kind").isin(*kinds))


def tables(rows: DataFrame) -> dict[str, DataFrame]:
    """objects, vertices, triangles, components, items, resources with their children, and errors of tagged rows, all with their part (land them as Parquet first: each table reads them again)."""
    at, of = _split(rows)
    key = ["path", "part", "object_id"]
    target = part_path(at("path")).alias("target_part")
    child = {name: of(name).select(*key, "seq", *[at(c) for c in columns]) for name, columns in {"base": ("name", "displaycolor"), "color": ("color",), "tex2coord": ("u", "v"), "composite": ("values",), "multi": ("pindices",), "slice": ("ztop",), "sliceref": ("slicestackid", "slicepath"), "layer": ("z", "path"), "beam": ("v1", "v2", "r1", "r2")}.items()}
    return child | {
        "objects": of("object").select(*key, at("type"), at("name"), at("kind"), at("pid", "long"), at("pindex", "long"), at("ref_id", "long"), at("UUID"), at("thumbnail")),
        "vertices": of("vertex").select(*key, F.col("seq").alias("vid"), *[at(c, "float") for c in "xyz"]),
        "triangles": of("triangle").select(*key, F.col("seq").alias("tid"), *[at(c, "long") for c in ("v1", "v2", "v3", "pid", "p1", "p2", "p3", "d1", "d2", "d3")]),
        "components": of("component").select(*key, "seq", at("objectid", "long").alias("child_object_id"), at("transform"), target, at("UUID")),
        "items": of("item").select("path", "part", "seq", at("objectid", "long").alias("item_object_id"), at("transform"), at("printable"), at("partnumber"), target, at("UUID")),
        "resources": of("resource").select("path", "part", F.col("object_id").alias("resource_id"), at("resource"), at("matid", "long"), at("pids"), at("contenttype"), at("path").alias("image"), at("texid", "long"), at("zbottom", "double")),
        "entries": of("entry").select("path", "seq", at("name"), at("size", "long")),
        "relationships": of("relationship").select("path", "seq", *[at(c) for c in ("Id", "Type", "Target", "TargetMode")]),
        "content_types": of("contenttype").select("path", "seq", *[at(c) for c in ("rule", "for", "type")]),
        "metadata": of("metadata").where("object_id is null and part is null").select("path", at("name"), at("value")),
        "errors": of("error").select("path", at("message")),
    }


def model(rows: DataFrame) -> dict[str, DataFrame]:
    """The root part of every package as operators.rules.validate takes it."""
    at, of = _split(rows.where("part is null"))
    t = {k: df.where("part is null").drop("part") if "part" in df.columns else df for k, df in tables(rows).items()}
    vectors = lambda kind: of(kind).select("path", "object_id", "seq", *[at(c, "double") for c in "xyz"])
    matrix = parse_transform(at("transform")).alias("transform")
    layers = t["resources"].where("resource = 'multiproperties' and pids is not null").select("path", "resource_id", F.posexplode(F.split(F.trim("pids"), r"\s+")).alias("seq", "pid")).withColumn("pid", F.col("pid").try_cast("long"))
    return {
        **{k: t[k] for k in ("objects", "vertices", "triangles", "items", "metadata")},
        "components": t["components"].withColumnRenamed("target_part", "part"), "resources": t["resources"].select("path", "resource_id", "resource", "matid"), "layers": layers,
        "booleans": of("booleanshape").select("path", "object_id", at("objectid", "long").alias("base_id"), matrix), "operands": of("operand").select("path", "object_id", "seq", at("objectid", "long").alias("operand_id"), matrix),
        "displacements": of("resource").where(F.get_json_object("payload", "$.resource") == "displacement2d").select("path", F.col("object_id").alias("resource_id"), F.coalesce(at("path"), F.lit("")).alias("image"), at("height", "double"), F.coalesce(at("offset", "double"), F.lit(0.0)).alias("offset")),
        "attachments": t["entries"].select("path", F.concat(F.lit("/"), "name").alias("name")), "normals": vectors("normal"), "gradients": vectors("gradient"), "units": of("model").select("path", at("unit")),
    }


def geometry(rows: DataFrame) -> tuple[DataFrame, ...]:
    """items, components, triangles, vertices of all parts as operators.packages.geometry_stats takes them: an object's id has its part in front, so references meet across parts. Items with printable 0 or false are left out. Rows of `parse_meshes` give meshes too."""
    t = tables(rows)
    own, to = (lambda c: F.concat_ws("#", F.coalesce("part", F.lit("")), F.col(c).cast("string"))), lambda c: F.concat_ws("#", F.coalesce("target_part", "part", F.lit("")), F.col(c).cast("string"))
    printable = ~F.coalesce(F.lower("printable").isin("0", "false"), F.lit(False))
    items = t["items"].where(F.col("part").isNull() & printable).select("path", "seq", to("item_object_id").alias("object_id"), parse_transform(F.col("transform")).alias("transform"))
    components = t["components"].select("path", own("object_id").alias("object_id"), to("child_object_id").alias("child_object_id"), parse_transform(F.col("transform")).alias("transform"))
    mesh = lambda name: t[name].withColumn("object_id", own("object_id")).drop("part")
    if "xyz" in rows.columns:
        items = items.unionByName(rows.where("kind = 'placed' and part is null").select("path", "seq", own("object_id").alias("object_id"), identity().alias("transform")))
    meshes = [rows.where("kind = 'mesh'").select("path", own("object_id").alias("object_id"), "xyz", "corners")] if "xyz" in rows.columns else []
    return items, components, mesh("triangles"), mesh("vertices"), *meshes
