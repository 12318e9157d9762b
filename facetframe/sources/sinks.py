"""Sinks: STL and OBJ text by Spark expressions, packages as one archive a group."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache, partial
from typing import NamedTuple
from xml.sax.saxutils import quoteattr

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.vectors import face_normal, point
from ..operators.batches import dealt
from ..operators.graphs import checkpointed, landed
from ..operators.structure import running_sum


def stl_text(corners: DataFrame) -> DataFrame:
    """corners: object_id, tid, ax..cz. Rows (object_id, tid, value), a facet each; write them sorted by object and tid as text."""
    n = face_normal(point("a"), point("b"), point("c"))
    vertex = "      vertex %.6f %.6f %.6f\n"
    text = F.format_string("  facet normal %.6e %.6e %.6e\n    outer loop\n" + vertex * 3 + "    endloop\n  endfacet", *n, *point("a"), *point("b"), *point("c"))
    return corners.select("object_id", "tid", text.alias("value"))


def stl_lines(corners: DataFrame) -> DataFrame:
    """corners as for stl_text. Rows (object_id, tid, value) of complete text files, one solid an object: first and last line have tid -1 and the largest long."""
    edge = lambda word, tid: corners.select("object_id").distinct().select("object_id", F.lit(tid).cast("long").alias("tid"), F.concat(F.lit(f"{word} object"), F.col("object_id").cast("string")).alias("value"))
    return edge("solid", -1).unionByName(stl_text(corners).withColumn("tid", F.col("tid").cast("long"))).unionByName(edge("endsolid", 2**63 - 1))


def stl_binary(corners: DataFrame) -> DataFrame:
    """corners: path, tid, ax .. cz in world coordinates. (path, content): a binary file for each path, facets by tid, normals zero; a file is one task's work."""
    order = [f"{p}{axis}" for p in "abc" for axis in "xyz"]

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("tid", kind="stable")
        facets = np.zeros(len(pdf), np.dtype([("f", "<f4", 12), ("a", "<u2")]))
        facets["f"][:, 3:] = pdf[order].to_numpy(np.float32)
        return pd.DataFrame({"path": [pdf["path"].iloc[0]], "content": [bytes(80) + struct.pack("<I", len(pdf)) + facets.tobytes()]})

    return corners.select("path", "tid", *order).groupBy("path").applyInPandas(build, "path string, content binary")


def obj_text(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """Rows (object_id, part, seq, value) of one OBJ file: write them sorted by part, object and seq. Vertex numbers run on over all objects."""
    size = vertices.groupBy("object_id").agg(F.count(F.lit(1)).alias("n"))
    shift = running_sum(size, "object_id", "n", "shift").select("object_id", "shift")
    v = vertices.select("object_id", F.lit(0).alias("part"), F.col("vid").alias("seq"), F.format_string("v %.6f %.6f %.6f", *[F.col(a).cast("double") for a in "xyz"]).alias("value"))
    at = lambda c: (F.col(c) + F.col("shift") + 1).cast("long")
    f = triangles.join(shift, "object_id").select("object_id", F.lit(1).alias("part"), F.col("tid").alias("seq"), F.format_string("f %d %d %d", at("v1"), at("v2"), at("v3")).alias("value"))
    g = size.select("object_id", F.lit(1).alias("part"), F.lit(-1).cast("long").alias("seq"), F.concat(F.lit("g object"), "object_id").alias("value"))
    return v.unionByName(g).unionByName(f)


#: Fixed values of the package format.
CORE = "http://schemas.microsoft.com/3dmanufacturing/core/2015/02"
MODEL_TYPE = "http://schemas.microsoft.com/3dmanufacturing/2013/01/3dmodel"
TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="model" ContentType="application/vnd.ms-package.3dmanufacturing-3dmodel+xml"/></Types>'
RELS = f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rel0" Type="{MODEL_TYPE}" Target="/3D/3dmodel.model"/></Relationships>'


def archives(entries: DataFrame) -> DataFrame:
    """entries: path, name, content binary. (path, content): an archive for each path, entries by name, those of a name once. What was read from a package can be written again so, attachments and all."""

    once = entries.groupBy("path", "name").agg(F.min("content").alias("content"))
    return once.repartition("path").sortWithinPartitions("path", "name").mapInPandas(_archived, "path string, content binary")


def _archived(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entries sorted by path and name go into their archives as they come; a task holds one batch and its archives."""
    no = object()
    path = content = z = no
    for batch in batches:
        done = []
        for at, name, data in zip(batch["path"], batch["name"], batch["content"]):
            if path is no or at != path:
                if path is not no:
                    z.close()
                    done.append((path, content.getvalue()))
                path, content = at, io.BytesIO()
                z = zipfile.ZipFile(content, "w", zipfile.ZIP_DEFLATED)
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED)
        if done:
            yield pd.DataFrame(done, columns=["path", "content"])
    if path is not no:
        z.close()
        yield pd.DataFrame({"path": [path], "content": [content.getvalue()]})


def entries(packages: DataFrame, wanted: str = ".*") -> DataFrame:
    """packages: path, content. (path, name, content) of the entries whose whole name fits the pattern."""
    fits = re.compile(wanted)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    found = [(path, n, z.read(n)) for n in z.namelist() if fits.fullmatch(n)]
                yield pd.DataFrame(found, columns=["path", "name", "content"])

    return packages.select("path", "content").mapInPandas(read, "path string, name string, content binary")


#: Rows of a package, about, that go into its archive as one stretch.
STRETCH = 100_000
#: Bytes of compressed text, about, that a row between two tasks holds.
PIECE = 1 << 20


def packages(objects: DataFrame, vertices: DataFrame, triangles: DataFrame, components: DataFrame, items: DataFrame, unit: str = "millimeter") -> DataFrame:
    """(path, content): an archive for each path. Tables as `sources.files.tables` gives them; rows become elements in Spark.

    A package's objects are cut by id (its items by seq) into stretches that many tasks string together, row by row, and compress; a task
    for each path only puts compressed stretches one behind the other.
    """
    attribute = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f' {name}="'), F.col(c).cast("string"), F.lit('"'))).otherwise(F.lit(""))
    row = lambda df, part, owner, seq, value: df.select("path", F.col(owner).cast("long").alias("owner"), F.lit(part).alias("part"), F.col(seq).cast("long").alias("seq"), value.alias("value"))
    name = F.when(F.col("name").isNotNull(), F.concat(F.lit(" name="), _quoted("name"))).otherwise(F.lit(""))
    rows = (
        row(objects, 0, "object_id", "object_id", F.concat(F.lit("<object"), attribute("id", "object_id"), attribute("type", "type"), attribute("pid", "pid"), attribute("pindex", "pindex"), name, F.lit(">")))
        .unionByName(row(vertices, 1, "object_id", "vid", F.concat(F.lit("<vertex"), *[attribute(a, a) for a in "xyz"], F.lit("/>"))))
        .unionByName(row(triangles, 2, "object_id", "tid", F.concat(F.lit("<triangle"), *[attribute(a, a) for a in ("v1", "v2", "v3", "pid", "p1", "p2", "p3") if a in triangles.columns], F.lit("/>"))))
        .unionByName(row(components, 3, "object_id", "seq", F.concat(F.lit("<component"), attribute("objectid", "child_object_id"), attribute("transform", "transform"), F.lit("/>"))))
        .unionByName(row(items.withColumn("_last", F.lit(2**62)), 4, "_last", "seq", F.concat(F.lit("<item"), attribute("objectid", "item_object_id"), attribute("transform", "transform"), F.lit("/>"))))
    )

    plan = _stretches(objects, triangles)
    at = lambda c: F.least(F.greatest(F.expr(f"({c} - {plan.low}L) div {plan.width}L"), F.lit(0)), F.lit(plan.parts - 1))
    cut = F.when(F.col("part") == 4, plan.parts + at("seq")).otherwise(at("owner"))
    rows = rows.where("owner is not null").select("path", cut.cast("int").alias("cut"), "owner", "part", "seq", "value")
    place = _place(plan)
    order = ["path", "cut", "owner", "part", "seq"] if place is None else [place, "owner", "part", "seq"]
    together = dealt(rows, plan.rows, "path", "cut")
    together = (together if together is not rows else rows.repartition("path", "cut")).sortWithinPartitions(*order)
    pieces = together.select("path", "cut", "owner", "part", "value").mapInArrow(_strung, "path string, cut int, piece int, first int, last int, first_owner long, last_owner long, crc long, size long, data binary")
    pieces = landed(pieces, batch=2**31 - 1)  # bounded by their rows alone: Spark would weigh a batch at every row, which takes longer than writing a short one
    # partitions by number, so that few large archives are not put into one task
    return pieces.repartition(plan.tasks, "path").sortWithinPartitions("path", "cut", "piece").mapInPandas(partial(_joined, unit), "path string, content binary")


class _Plan(NamedTuple):
    """The least id of objects and the largest one, the ids in a stretch, the stretches of objects in a package, about how many rows there are in all, partitions to deal packages to, and a modulus by which all packages' hashes differ (0: not looked for)."""

    low: int
    high: int
    width: int
    parts: int
    rows: int
    tasks: int
    modulus: int


#: Packages whose names the driver may look at.
KNOWN = 1000


def _stretches(objects: DataFrame, triangles: DataFrame) -> _Plan:
    """Stretches of about STRETCH rows in the largest package."""
    ids = objects.groupBy("path").agg(F.min(F.col("object_id").cast("long")).alias("low"), F.max(F.col("object_id").cast("long")).alias("high"), F.count(F.lit(1)).alias("o"))
    sizes = triangles.groupBy("path").agg(F.count(F.lit(1)).alias("t"))
    some = ids.join(sizes, "path", "full").select(F.hash("path").alias("h"), "low", "high", (3 * (F.coalesce("o", F.lit(0)) + F.coalesce("t", F.lit(0)))).alias("n"))
    some = checkpointed(some)
    packages, low, high, most, n = (x or 0 for x in some.agg(F.count(F.lit(1)), F.min("low"), F.max("high"), F.max("n"), F.sum("n")).first())
    parts = min(max(1, -(-most // STRETCH)), 10_000, high - low + 1)
    tasks, modulus = max(200, objects.sparkSession.sparkContext.defaultParallelism), 0
    if 0 < packages <= KNOWN:
        hashes = [r.h for r in some.select("h").collect()]
        most_at = lambda m: max(Counter(h % m for h in hashes).values())
        tasks = min(range(packages, 4 * packages + 1), key=lambda m: (most_at(m), m))
        modulus = next((m for m in range(packages, 2**16) if most_at(m) == 1), 0)
    return _Plan(low, high, -(-(high - low + 1) // parts), parts, n, tasks, modulus)


def _place(plan: _Plan) -> Column | None:
    """A long by which rows of a task sort as by path, items last, owner, part and seq, but for ties, so that rows need hardly be looked at; None if it can't be made."""
    bits = (plan.high - plan.low).bit_length()
    rest = 63 - 17 - bits
    if not plan.modulus or rest < 3:
        return None
    item, span = F.col("part") == 4, 2**bits - 1
    clipped = lambda c, low, high: F.least(F.greatest(c, F.lit(low)), F.lit(high))
    # outside of the known ids only owner decides, by the columns that follow
    within = F.when(item | (F.col("owner") < plan.low), 0).when(F.col("owner") > plan.high, 2**rest - 1).otherwise(F.col("part").cast("long") * 2 ** (rest - 2) + clipped(F.col("seq"), 0, 2 ** (rest - 2) - 1))
    known = clipped(F.when(item, F.col("seq")).otherwise(F.col("owner")), plan.low, plan.low + span) - plan.low
    return (F.pmod(F.hash("path"), F.lit(plan.modulus)).cast("long") * 2 + item.cast("long")) * 2 ** (bits + rest) + known * 2**rest + within


WRAP = {1: "vertices", 2: "triangles", 3: "components"}


def _between(part: int, now: int, other: bool) -> str:
    """What stands between a row of one part and the next row, of part `now` (of another object or not). Parts: -1 the file's head, 0 object, 1 vertex, 2 triangle, 3 component, 4 item, 5 the file's end."""
    leave = lambda after: (f"</{WRAP[part]}>" if part in WRAP else "") + ("</mesh>" if part in (1, 2) and after != 2 else "") + ("</object>" if after is None else "")
    if now == 5:
        return (leave(None) if part in (0, 1, 2, 3) else "") + ("" if part == 4 else "</resources><build>") + "</build></model>"
    if now == 4:
        return "" if part == 4 else (leave(None) if part >= 0 else "") + "</resources><build>"
    out = ""
    if other:
        out, part = (leave(None) if part >= 0 else "") + ("<object>" if now else ""), 0
    if now in WRAP and now != part:
        out += leave(now) + ("<mesh>" if now == 1 or now == 2 and part != 1 else "") + f"<{WRAP[now]}>"
    return out


#: `_between` by part + 1, now and whether the object is another one.
BETWEEN = np.array([[[_between(p, now, other).encode() for other in (False, True)] for now in range(6)] for p in range(-1, 5)], object)


PIECES = pa.schema([("path", pa.string()), ("cut", pa.int32()), ("piece", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("first_owner", pa.int64()), ("last_owner", pa.int64()), ("crc", pa.int64()), ("size", pa.int64()), ("data", pa.binary())])


def _strung(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by stretch, then by place in the file, are compressed as they come. Pieces of a stretch carry its ends up to there, checksum and size; what stands in front of its first row is left to `_joined`."""
    path = cut = packer = None
    piece = first = last = first_owner = last_owner = crc = size = held = 0
    data: list[bytes] = []
    rows = lambda done: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), PIECES)], schema=PIECES)
    made = lambda: (path, cut, piece, first, last, first_owner, last_owner, crc, size, b"".join(data))

    for batch in batches:
        n, done = len(batch), []
        if not n:
            continue
        paths = batch.column("path").dictionary_encode()
        names, of = paths.dictionary.to_pylist(), paths.indices.to_numpy()
        cuts, owners, parts = (batch.column(c).to_numpy() for c in ("cut", "owner", "part"))
        values = batch.column("value")
        text = memoryview(values.buffers()[2] or b"")
        ends = np.frombuffer(values.buffers()[1], np.int32, n + 1, 4 * values.offset).tolist()
        other = owners[1:] != owners[:-1]
        fresh = (cuts[1:] != cuts[:-1]) | (of[1:] != of[:-1])
        at = np.flatnonzero((other | (parts[1:] != parts[:-1])) & ~fresh) + 1
        glue = BETWEEN[parts[at - 1] + 1, parts[at], other[at - 1].astype(int)].tolist()
        at = at.tolist()
        heads = [0, *(np.flatnonzero(fresh) + 1).tolist(), n]
        g = 0
        for i, j in zip(heads, heads[1:]):
            if packer is None or names[of[i]] != path or cuts[i] != cut:
                if packer is not None:
                    data.append(packer.flush(zlib.Z_FULL_FLUSH))
                    done.append(made())
                path, cut, packer, data = names[of[i]], int(cuts[i]), zlib.compressobj(zlib.Z_DEFAULT_COMPRESSION, zlib.DEFLATED, -15), []
                piece, first, first_owner, crc, size, held, out = 0, int(parts[i]), int(owners[i]), 0, 0, 0, []
            else:
                out = [BETWEEN[last + 1, parts[i], int(owners[i] != last_owner)]]
            begin = ends[i]
            while g < len(at) and at[g] < j:
                out += text[begin : ends[at[g]]], glue[g]
                begin = ends[at[g]]
                g += 1
            whole = b"".join([*out, text[begin : ends[j]]])
            crc, size, last, last_owner = zlib.crc32(whole, crc), size + len(whole), int(parts[j - 1]), int(owners[j - 1])
            data.append(packer.compress(whole))
            held += len(data[-1])
            if held >= PIECE:
                done.append(made())
                piece, data, held = piece + 1, [], 0
        if done:
            yield rows(done)
    if packer is not None:
        data.append(packer.flush(zlib.Z_FULL_FLUSH))
        yield rows([made()])


def _joined(unit: str, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces sorted by path, stretch and piece become archives; a task holds one batch and the archive it is at."""
    path = entry = None
    part, owner = -1, 0

    for batch in batches:
        for r in batch.itertuples(index=False):
            if entry is None or r.path != path:
                if entry is not None:
                    yield pd.DataFrame({"path": [path], "content": [entry.close(BETWEEN[part + 1, 5, 0])]})
                path, part, entry = r.path, -1, _Archive(f'<?xml version="1.0" encoding="UTF-8"?><model unit="{unit}" xmlns="{CORE}"><resources>'.encode())
            if r.piece == 0:
                entry.end_stretch()
                entry.text(BETWEEN[part + 1, r.first, int(part < 0 or r.first_owner != owner)])
            entry.add(r.data, r.crc, r.size)
            part, owner = r.last, r.last_owner
    if entry is not None:
        yield pd.DataFrame({"path": [path], "content": [entry.close(BETWEEN[part + 1, 5, 0])]})


class _Archive:
    """A package whose model part is put together from stretches that were compressed elsewhere."""

    def __init__(self, head: bytes):
        self.content = io.BytesIO()
        self.zip = zipfile.ZipFile(self.content, "w", zipfile.ZIP_DEFLATED)
        for name, text in (("[Content_Types].xml", TYPES), ("_rels/.rels", RELS)):
            self.zip.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text, zipfile.ZIP_DEFLATED)
        self.info = zipfile.ZipInfo("3D/3dmodel.model", (1980, 1, 1, 0, 0, 0))
        self.info.compress_type, self.info.header_offset = zipfile.ZIP_DEFLATED, self.content.tell()
        self.info.CRC = 0
        self.content.write(self.info.FileHeader(zip64=True))
        self.begin, self.crc, self.size, self.stretch = self.content.tell(), 0, 0, (0, 0)
        self.text(head)

    def text(self, data: bytes, last: bool = False) -> None:
        packer = zlib.compressobj(zlib.Z_DEFAULT_COMPRESSION, zlib.DEFLATED, -15)
        self.content.write(packer.compress(data) + packer.flush(zlib.Z_FINISH if last else zlib.Z_FULL_FLUSH))
        self.crc, self.size = zlib.crc32(data, self.crc), self.size + len(data)

    def add(self, data: bytes, crc: int, size: int) -> None:
        """A piece of a stretch; crc and size are the stretch's up to its end."""
        self.content.write(data)
        self.stretch = crc, size

    def end_stretch(self) -> None:
        crc, size = self.stretch
        self.crc, self.size, self.stretch = crc_joined(self.crc, crc, size), self.size + size, (0, 0)

    def close(self, tail: bytes) -> bytes:
        self.end_stretch()
        self.text(tail, last=True)
        end = self.content.tell()
        self.info.CRC, self.info.file_size, self.info.compress_size = self.crc, self.size, end - self.begin
        self.content.seek(self.info.header_offset)
        self.content.write(self.info.FileHeader(zip64=True))
        self.content.seek(end)
        self.zip.filelist.append(self.info)
        self.zip.NameToInfo[self.info.filename] = self.info
        self.zip.start_dir = end
        self.zip.close()
        return self.content.getvalue()


def _shifted(matrix: tuple[int, ...], crc: int) -> int:
    out = 0
    for row in matrix:
        if not crc:
            break
        if crc & 1:
            out ^= row
        crc >>= 1
    return out


@cache
def _zeros(k: int) -> tuple[int, ...]:
    """What 2 ** k zero bits do to each bit of a CRC-32."""
    if k == 0:
        return (0xEDB88320, *(1 << i for i in range(31)))
    return tuple(_shifted(_zeros(k - 1), row) for row in _zeros(k - 1))


def crc_joined(a: int, b: int, size: int) -> int:
    """The CRC-32 of two texts, one behind the other, of their own and the second one's size in bytes."""
    bits, k = 8 * size, 0
    while bits:
        if bits & 1:
            a = _shifted(_zeros(k), a)
        bits, k = bits >> 1, k + 1
    return a ^ b


@F.pandas_udf(StringType())
def _quoted(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else quoteattr(t))
