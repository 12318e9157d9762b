"""Column expressions for points, triangles, affine matrices, colours, units and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres per unit.
UNIT_METRES = {"micron": 1e-6, "millimeter": 1e-3, "centimeter": 1e-2, "inch": 0.0254, "foot": 0.3048, "meter": 1.0}


def cross(a, b):
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def minus(a, b):
    return tuple(x - y for x, y in zip(a, b))


def dot(a, b) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def triangle_area(a, b, c) -> Column:
    n = cross(minus(b, a), minus(c, a))
    return F.sqrt(dot(n, n)) * 0.5


def signed_volume(a, b, c) -> Column:
    return dot(a, cross(b, c)) / 6.0


def face_normal(a, b, c):
    """Unit normal; zero for a degenerate triangle."""
    n = cross(minus(b, a), minus(c, a))
    size = F.sqrt(dot(n, n))
    return tuple(F.when(size > 0, x / size).otherwise(F.lit(0.0)) for x in n)


def point(prefix: str):
    return tuple(F.col(f"{prefix}{axis}") for axis in "xyz")


def identity() -> Column:
    return F.array(*[F.lit(1.0 if i % 5 == 0 else 0.0) for i in range(16)])


def matmul(a: Column, b: Column) -> Column:
    """Product of column-major 4x4 matrices kept as arrays of 16."""
    def cell(i: Column) -> Column:
        r, c = (i % 4).cast("int"), (F.floor(i / 4) * 4).cast("int")
        return a[r] * b[c] + a[r + 4] * b[c + 1] + a[r + 8] * b[c + 2] + a[r + 12] * b[c + 3]

    return F.transform(F.sequence(F.lit(0), F.lit(15)), cell)


def transform_point(m: Column, p):
    return tuple(m[i] * p[0] + m[4 + i] * p[1] + m[8 + i] * p[2] + m[12 + i] for i in range(3))


def determinant(m: Column) -> Column:
    """Of the linear part of an affine matrix."""
    return m[0] * (m[5] * m[10] - m[9] * m[6]) - m[4] * (m[1] * m[10] - m[9] * m[2]) + m[8] * (m[1] * m[6] - m[5] * m[2])


def parse_transform(text: Column) -> Column:
    """12 numbers (four columns of three) to a 4x4 matrix; null for anything else, identity for null."""
    n = F.transform(F.split(F.trim(text), r"\s+"), lambda x: x.try_cast("double"))
    full = F.array(n[0], n[1], n[2], F.lit(0.0), n[3], n[4], n[5], F.lit(0.0), n[6], n[7], n[8], F.lit(0.0), n[9], n[10], n[11], F.lit(1.0))
    return F.when(text.isNull(), identity()).when((F.size(n) == 12) & ~F.exists(n, lambda x: x.isNull()), full)


def convert_unit(value: Column, source: Column, target: Column) -> Column:
    scale = F.create_map(*[x for k, v in UNIT_METRES.items() for x in (F.lit(k), F.lit(v))])
    of = lambda u: F.coalesce(scale[u], F.lit(UNIT_METRES["millimeter"]))
    return F.when(source == target, value).otherwise(value * of(source) / of(target))


def color_parts(text: Column) -> Column:
    """#RRGGBB or #RRGGBBAA as struct(r, g, b, a); alpha 255 if left out, null if malformed."""
    h = F.regexp_replace(text, "^#+", "")
    part = lambda i: F.conv(F.substring(h, i, 2), 16, 10).cast("short")
    return F.when(h.rlike("^([0-9A-Fa-f]{6}|[0-9A-Fa-f]{8})$"), F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b"), F.when(F.length(h) == 8, part(7)).otherwise(F.lit(255).cast("short")).alias("a")))


def color_text(c: Column) -> Column:
    return F.format_string("#%02X%02X%02X%02X", c["r"], c["g"], c["b"], c["a"])


def duration_text(seconds: Column) -> Column:
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60
    hs, ms, ss = F.concat(h, F.lit("h")), F.concat(m, F.lit("m")), F.concat(s, F.lit("s"))
    return (
        F.when((h > 0) & (s > 0), F.concat_ws(" ", hs, ms, ss)).when((h > 0) & (m > 0), F.concat_ws(" ", hs, ms)).when(h > 0, hs)
        .when((m > 0) & (s > 0), F.concat_ws(" ", ms, ss)).when(m > 0, ms).otherwise(ss)
    )


def part_path(path: Column) -> Column:
    """Canonical part path: null for the root part under any of its names."""
    p = F.regexp_replace(F.coalesce(path, F.lit("")), "^/+", "")
    return F.when(p.isin("", "ROOT") | (F.lower(p) == "3d/3dmodel.model"), F.lit(None).cast("string")).otherwise(p)


def part_subtype(text: Column) -> Column:
    """The kind of a part of a print: one of the known ones, else 'other'."""
    return F.when(text.isin("normal_part", "modifier_part", "support_blocker", "support_enforcer"), text).otherwise(F.lit("other"))


def shared_vertices(a, b) -> Column:
    """How many pairs of equal vertices two triangles (three columns each) have."""
    return sum(((x == y).cast("int") for x in a for y in b), F.lit(0))
