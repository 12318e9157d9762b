"""Slicer settings inside packages, as tagged rows like those of the package itself, and what statistics take from them."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the formats: entries, header keys, and settings with machine code, which are left out.
SLICE_INFO, MODEL_SETTINGS, PROJECT_SETTINGS = "Metadata/slice_info.config", "Metadata/model_settings.config", "Metadata/project_settings.config"
PROFILE = re.compile(r"Metadata/(filament|machine|process)_settings_(1[0-5]|[0-9])\.config")
CLIENT_TYPE, CLIENT_VERSION = "X-BBL-Client-Type", "X-BBL-Client-Version"
MACHINE_CODE = (
    "change_filament_gcode", "machine_end_gcode", "machine_start_gcode", "time_lapse_gcode", "before_layer_change_gcode", "layer_change_gcode",
    "printer_start_gcode", "printer_end_gcode", "toolchange_gcode", "gcode_end", "gcode_start",
)


def _settings(el) -> dict:
    return {m.get("key"): m.get("value") for m in el.findall("metadata") if m.get("key") is not None and m.get("value") is not None}


def slice_info(content: bytes) -> Iterator[tuple]:
    root = ElementTree.fromstring(content)
    for i, h in enumerate(root.iter("header_item")):
        yield "slicer", None, i, {"key": h.get("key"), "value": h.get("value")}
    for p, plate in enumerate(root.iter("plate")):
        yield "plate", p, 0, _settings(plate)
        for tag, kind in (("filament", "filament"), ("warning", "slicerwarning"), ("object", "plateobject")):
            for k, el in enumerate(plate.findall(tag)):
                yield kind, p, k, dict(el.attrib)


def model_settings(content: bytes) -> Iterator[tuple]:
    root = ElementTree.fromstring(content)
    for el in root.findall("object"):
        owner = int(el.get("id", 0))
        faces = next((m.get("face_count") for m in el.findall("metadata") if m.get("face_count")), None)
        yield "settingsobject", owner, 0, _settings(el) | {"face_count": faces}
        for k, part in enumerate(el.findall("part")):
            yield "settingspart", owner, k, {"part_id": part.get("id"), "subtype": part.get("subtype", "normal_part"), "settings": _settings(part)}
    for p, plate in enumerate(root.findall("plate")):
        yield "settingsplate", p, 0, _settings(plate)
        for k, el in enumerate(plate.findall("model_instance")):
            yield "plateinstance", p, k, _settings(el)
    for k, el in enumerate(root.iter("assemble_item")):
        yield "assembly", None, k, dict(el.attrib)


def project_settings(content: bytes) -> Iterator[tuple]:
    """Settings without machine code; the bed type is the current one where there is one. What is no JSON object gives no settings."""
    try:
        found = json.loads(content)
    except ValueError:
        found = {}
    found = found if isinstance(found, dict) else {}
    bed = found.get("curr_bed_type") if isinstance(found.get("curr_bed_type"), str) else found.get("bed_type")
    yield "projectsettings", None, 0, {k: v for k, v in found.items() if k not in MACHINE_CODE} | {"bed_type": bed}


def vendor_rows(archive, names: list[str]) -> Iterator[tuple]:
    """Rows of the settings of one package; an entry that can't be read gives none, as a model is whole without it."""
    for name, read in ((SLICE_INFO, slice_info), (MODEL_SETTINGS, model_settings), (PROJECT_SETTINGS, project_settings)):
        if name in names:
            try:
                yield from list(read(archive.read(name)))
            except (ElementTree.ParseError, ValueError):
                yield "vendorerror", None, 0, {"name": name}
    for name in names:
        if m := PROFILE.fullmatch(name):
            try:
                found = json.loads(archive.read(name))
            except ValueError:
                continue
            if isinstance(found, dict):
                yield "profile", None, int(m[2]), {"config_type": m[1], "name": found.get("name"), "inherits": found.get("inherits")}


def _texts(rows: DataFrame, kind: str, *keys: str) -> DataFrame:
    return rows.where(F.col("kind") == kind).select("path", F.col("object_id").alias("plate"), "seq", *[F.get_json_object("payload", f"$.{k}").alias(k) for k in keys])


def slicer_tables(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """plates, filaments, warnings of tagged rows, as operators.packages.slicer_stats takes them."""
    plates = _texts(rows, "plate", "prediction").select("path", "plate", F.coalesce(F.col("prediction").try_cast("long"), F.lit(0)).alias("seconds"))
    filaments = _texts(rows, "filament", "used_g", "type", "color").select("path", "plate", F.coalesce(F.col("used_g").try_cast("double"), F.lit(0.0)).alias("grams"), "type", "color")
    return plates, filaments, _texts(rows, "slicerwarning", "msg").select("path", "plate", F.coalesce("msg", F.lit("")).alias("text"))


def slicer_versions(rows: DataFrame) -> DataFrame:
    """(path, slicer_version): the client's name without spaces, '-' and its version; no row without a version."""
    of = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))
    heads = _texts(rows, "slicer", "key", "value").groupBy("path").agg(of(CLIENT_TYPE).alias("client"), of(CLIENT_VERSION).alias("version")).where("version is not null")
    return heads.select("path", F.concat_ws("-", F.regexp_replace(F.coalesce("client", F.lit("BambuStudio")), " ", ""), "version").alias("slicer_version"))


def printer_models(rows: DataFrame) -> DataFrame:
    """(path, printer_model): what the project inherits, else its printer, else what the first machine profile inherits, else its name."""
    project = _texts(rows, "projectsettings", "inherits", "printer_model").select("path", F.coalesce("inherits", "printer_model").alias("own"))
    machine = _texts(rows, "profile", "config_type", "name", "inherits").where("config_type = 'machine'").groupBy("path").agg(F.min_by(F.coalesce("inherits", "name"), "seq").alias("profile"))
    return project.join(machine, "path", "full").select("path", F.coalesce("own", "profile").alias("printer_model")).where("printer_model is not null")


def plate_objects(rows: DataFrame) -> DataFrame:
    """(path, plate, seq, object_id, name): instances on plates with the name that the settings give their object."""
    instance = _texts(rows, "plateinstance", "object_id").withColumn("object_id", F.col("object_id").try_cast("long"))
    names = rows.where("kind = 'settingsobject'").select("path", "object_id", F.get_json_object("payload", "$.name").alias("name"))
    return instance.join(names, ["path", "object_id"], "left").select("path", "plate", "seq", "object_id", "name")


def used_materials(rows: DataFrame) -> DataFrame:
    """(path, object_id, tid, material, color, material_index) of the triangles of OBJ files: the material's colour from the library beside the file (null if it has none), materials numbered by first use."""
    get = lambda k: F.get_json_object("payload", f"$.{k}").alias(k)
    t = rows.where("kind = 'triangle'").select("path", "object_id", F.col("seq").alias("tid"), get("material")).where("material is not null")
    folder = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    libraries = rows.where("kind = 'mtllib'").select("path", F.concat(folder, get("name")).alias("library")).distinct()
    materials = rows.where("kind = 'material'").select(F.col("path").alias("library"), "seq", get("name").alias("material"), get("color").alias("color"))
    colors = libraries.join(materials, "library").groupBy("path", "material").agg(F.max_by("color", "seq").alias("color"))
    first = t.groupBy("path", "material").agg(F.min(F.struct("object_id", "tid")).alias("at"))
    index = first.withColumn("material_index", F.row_number().over(Window.partitionBy("path").orderBy("at")) - 1).drop("at")
    return t.join(index, ["path", "material"]).join(colors, ["path", "material"], "left").select("path", "object_id", "tid", "material", "color", "material_index")
