"""WKB in and out, per Arrow batch; layers meet WKB only when files are read or written."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.functions.kernels import GEOMETRY_ARROW, flat_coordinates, rebuild
from geoloom.layer import GEOMETRY

# WKB type codes.
KIND_OF_CODE = {
    1: "Point",
    2: "LineString",
    3: "Polygon",
    4: "MultiPoint",
    5: "MultiLineString",
    6: "MultiPolygon",
}
FAMILY_OF_CODE = {1: "point", 2: "line", 3: "polygon", 4: "point", 5: "line", 6: "polygon"}


CODE_OF_KIND = {kind: code for code, kind in KIND_OF_CODE.items()}
_BYTES16 = np.arange(16)


class _Cursor:
    """One reading position per WKB value of a batch, moved for all of them at once; ``bad`` marks values that end too early,
    are of an unknown kind or hold empty rings or coordinates that are not finite."""

    def __init__(self, data: pa.Array):
        data = data.cast(pa.large_binary())
        ends = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
        held = data.buffers()[2]
        # values of less than 16 bytes are read as such: the padding keeps the gathers inside the buffer
        self.data = np.concatenate([np.frombuffer(held, np.uint8)[: ends[-1]] if held else np.zeros(0, np.uint8), np.zeros(16, np.uint8)])
        self.at, self.end = ends[:-1].copy(), ends[1:]
        self.bad = data.is_null().to_numpy(zero_copy_only=False).copy()

    def _take(self, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows that have ``width`` more bytes, where these begin); the others are bad."""
        enough = self.at[rows] + width <= self.end[rows]
        self.bad[rows[~enough]] = True
        rows = rows[enough]
        begin = self.at[rows]
        self.at[rows] += width
        return rows, begin

    def number(self, rows: np.ndarray, little: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, their byte orders, an unsigned 32-bit number each)."""
        kept = self.at[rows] + 4 <= self.end[rows]
        rows, begin = self._take(rows, 4)
        little = little[kept]
        raw = self.data[begin[:, None] + np.arange(4)]
        return rows, little, np.where(little, raw.view("<u4").ravel(), raw.view(">u4").ravel()).astype(np.int64)

    def header(self, rows: np.ndarray):
        """(rows, byte orders, kinds 1 to 6, ordinates per vertex)."""
        rows, begin = self._take(rows, 1)
        rows, little, code = self.number(rows, self.data[begin] == 1)
        z, m, srid = code & 0x80000000 > 0, code & 0x40000000 > 0, code & 0x20000000 > 0
        thousands, kind = np.divmod(code & 0x0FFFFFFF, 1000)
        width = 2 + (z | np.isin(thousands, (1, 3))) + (m | np.isin(thousands, (2, 3)))
        self.at[rows[srid]] += 4
        known = (kind >= 1) & (kind <= 6)
        self.bad[rows[~known]] = True
        return rows[known], little[known], kind[known], width[known]


def decode(data: pa.Array) -> pa.Array:
    """Geometries of a WKB column; null for null, unknown, truncated or empty values. All values are read side by side:
    steps follow the most parts and rings that one value has, not the number of values."""
    cursor = _Cursor(data)
    n = len(data)
    if n == 0:
        return pa.array([], GEOMETRY_ARROW)
    paths = []  # (row, part, ring, first byte, ordinates, vertices, byte order) of every ring

    def rings(rows, little, kind, width, part):
        """Read the body of one single geometry per row."""
        counts = np.ones(len(rows), np.int64)
        area = np.flatnonzero(kind == 3)
        got, _, number = cursor.number(rows[area], little[area])
        counts[area] = 0
        counts[area[np.isin(rows[area], got)]] = number
        cursor.bad[rows[counts == 0]] = True
        ring = 0
        while True:
            live = (counts > ring) & ~cursor.bad[rows]
            if not live.any():
                return
            r, le, k, w = rows[live], little[live], kind[live], width[live]
            size = np.ones(len(r), np.int64)
            many = np.flatnonzero(k != 1)
            got, _, number = cursor.number(r[many], le[many])
            size[many] = 0
            size[many[np.isin(r[many], got)]] = number
            fits = (size > 0) & (cursor.at[r] + 8 * w * size <= cursor.end[r])
            cursor.bad[r[~fits]] = True
            r, le, w, size = r[fits], le[fits], w[fits], size[fits]
            paths.append((r, np.full(len(r), part), np.full(len(r), ring), cursor.at[r].copy(), w, size, le))
            cursor.at[r] += 8 * w * size
            ring += 1

    rows, little, kind, width = cursor.header(np.flatnonzero(~cursor.bad))
    kinds = np.zeros(n, np.int64)
    kinds[rows] = kind
    single = kind <= 3
    rings(rows[single], little[single], kind[single], width[single], 0)
    rows, little, parts = cursor.number(rows[~single], little[~single])
    cursor.bad[rows[parts == 0]] = True
    part = 0
    while True:
        live = (parts > part) & ~cursor.bad[rows]
        if not live.any():
            break
        r, le, k, w = cursor.header(rows[live])
        fits = k == kinds[r] - 3
        cursor.bad[r[~fits]] = True
        rings(r[fits], le[fits], k[fits], w[fits], part)
        part += 1

    row, part, ring, begin, width, size, little = (np.concatenate([p[i] for p in paths]) if paths else np.zeros(0, np.int64) for i in range(7))
    order = np.lexsort((ring, part, row))
    row, part, begin, width, size, little = (v[order] for v in (row, part, begin, width, size, little.astype(bool)))
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    raw = cursor.data[(np.repeat(begin, size) + step * 8 * np.repeat(width, size))[:, None] + _BYTES16]
    xy = np.where(np.repeat(little, size)[:, None], raw.view("<f8"), raw.view(">f8"))
    owner = np.repeat(row, size)
    cursor.bad[owner[~np.isfinite(xy).all(1)]] = True
    good = ~cursor.bad
    keep, held = good[row], good[owner]
    row, part, size = row[keep], part[keep], size[keep]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (part[1:] != part[:-1])
    n_rings = np.diff(np.append(np.flatnonzero(first), len(row)))
    found = rebuild([KIND_OF_CODE[k] for k in kinds[good].tolist()], xy[held, 0], xy[held, 1], size, n_rings, np.bincount(row[first], minlength=n)[good])
    return found.take(pa.array(np.where(good, np.cumsum(good) - 1, 0), mask=~good))


def encode(geom: pa.Array) -> pa.Array:
    """Little-endian WKB of a geometry column; null for null geometries and for those without a vertex.

    The places of all headers and counts follow from running sums of sizes; what is left between them are the
    coordinates, in order."""
    valid = geom.is_valid().to_numpy(zero_copy_only=False)
    code = np.array([CODE_OF_KIND.get(k, 0) for k in geom.field("kind").to_pylist()], np.int64)
    x, y, n_vertices, n_rings, n_parts = flat_coordinates(geom)
    n_parts = np.where(valid, n_parts, 0)
    valid = valid & (n_parts > 0) & (code > 0)
    multi = code > 3
    base = np.where(multi, code - 3, code)
    part_row = np.repeat(np.arange(len(code)), n_parts)
    part_base = base[part_row]
    ring_part = np.repeat(np.arange(len(part_row)), n_rings)
    counted = part_base[ring_part] != 1
    ring_size = 16 * n_vertices.astype(np.int64) + 4 * counted
    part_head = 5 + 4 * (part_base == 3)
    part_size = part_head + np.bincount(ring_part, ring_size, len(part_row)).astype(np.int64)
    size = (9 * multi + np.bincount(part_row, part_size, len(code)).astype(np.int64)) * valid
    end = np.cumsum(size)
    total = int(end[-1]) if len(end) else 0

    begin = end - size
    part_begin = begin[part_row] + 9 * multi[part_row] + _running(part_size, part_row)
    ring_begin = part_begin[ring_part] + part_head[ring_part] + _running(ring_size, ring_part)
    out, coordinates = np.zeros(total, np.uint8), np.ones(total, bool)

    def put(at, values):
        places = at[:, None] + np.arange(4)
        out[places] = np.asarray(values, "<u4").reshape(-1, 1).view(np.uint8)
        coordinates[places] = False

    def head(at, codes):
        out[at] = 1
        coordinates[at] = False
        put(at + 1, codes)

    several = valid & multi
    head(begin[several], code[several])
    put(begin[several] + 5, n_parts[several])
    head(part_begin, part_base)
    area = part_base == 3
    put(part_begin[area] + 5, n_rings[area])
    put(ring_begin[counted], n_vertices[counted])
    out[coordinates] = np.stack([x, y], 1).astype("<f8").reshape(-1).view(np.uint8)
    offsets = np.concatenate([[0], end]).astype(np.int64)
    missing = None if valid.all() else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    held = pa.Array.from_buffers(pa.large_binary(), len(code), [missing, pa.py_buffer(offsets), pa.py_buffer(out)])
    return held.cast(pa.binary())


def _running(sizes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Sum of the sizes before each element among those of its owner."""
    before = np.cumsum(sizes) - sizes
    first = np.ones(len(owner), bool)
    first[1:] = owner[1:] != owner[:-1]
    return before - np.repeat(before[first], np.diff(np.append(np.flatnonzero(first), len(owner))))


@F.arrow_udf(GEOMETRY)
def from_wkb(data: pa.Array) -> pa.Array:
    """Geometry of WKB or extended WKB, either byte order; further ordinates are dropped."""
    return decode(data)


@F.arrow_udf(T.BinaryType())
def to_wkb(geom: pa.Array) -> pa.Array:
    return encode(geom)


def type_code(wkb: Column) -> Column:
    """The type code in the header of a WKB value as stored, in its own byte order."""
    digits = F.hex(wkb)
    big = F.substring(digits, 3, 8)
    little = F.concat(*[F.substring(digits, i, 2) for i in (9, 7, 5, 3)])
    ordered = F.when(F.substring(digits, 1, 2) == "01", little).otherwise(big)
    return F.when(F.octet_length(wkb) >= 5, F.conv(ordered, 16, 10).cast("long"))


def family_of_wkb(wkb: Column, strict_codes: bool = False) -> Column:
    """Geometry family from the header alone.

    ``strict_codes`` takes the code as it stands, so values with Z, M or SRID flags are ``other``;
    otherwise flags and the thousands of ISO codes are ignored. Null and short values are ``other``.
    """
    code = type_code(wkb)
    if not strict_codes:
        code = code.bitwiseAND(F.lit(0x0FFFFFFF)) % 1000
    family = F.lit("other")
    for known, name in FAMILY_OF_CODE.items():
        family = F.when(code == known, F.lit(name)).otherwise(family)
    return family
