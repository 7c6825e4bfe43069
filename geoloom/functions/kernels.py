"""Arrow-batch functions for what array expressions cannot say well.

Each one receives whole Arrow columns and works on the flattened coordinate buffers with numpy, so
there is no Python loop over edges; Spark decides which rows reach it. Pairwise functions compare
every edge of one geometry with every edge of the other *within a candidate pair*, in slices of
bounded size, after the joins have already discarded pairs whose boxes do not meet.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.functions.coords import MERCATOR_RADIUS_M
from geoloom.layer import GEOMETRY

# Edge-against-edge comparisons held in memory at once (about 100 bytes each).
SLICE = 100_000

# Two positions closer than this (degrees) are one.
TOLERANCE = 1e-10

VERTEX_ARROW = pa.struct([("x", pa.float64()), ("y", pa.float64())])
GEOMETRY_ARROW = pa.struct(
    [("kind", pa.string()), ("parts", pa.list_(pa.list_(pa.list_(VERTEX_ARROW))))]
)
DIMENSION = {"Point": 0, "MultiPoint": 0, "LineString": 1, "MultiLineString": 1}


def _lengths(lists) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)


def _plain(column):
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _group_starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])[:-1].astype(np.int64)


def _spread(counts: np.ndarray) -> np.ndarray:
    """0..n-1 within each group, for groups of the given sizes."""
    counts = counts.astype(np.int64)
    return np.arange(counts.sum(), dtype=np.int64) - np.repeat(_group_starts(counts), counts)


def flat_coordinates(column):
    """(x, y, vertices per ring, rings per part, parts per geometry) of a geometry column."""
    column = _plain(column)
    parts = column.field("parts")
    n_parts = _lengths(parts)
    rings = parts.flatten()
    n_rings = _lengths(rings)
    paths = rings.flatten()
    n_vertices = _lengths(paths)
    points = paths.flatten()
    x = points.field("x").to_numpy(zero_copy_only=False)
    y = points.field("y").to_numpy(zero_copy_only=False)
    return x, y, n_vertices, n_rings, n_parts


def rebuild(kinds, x, y, n_vertices, n_rings, n_parts) -> pa.Array:
    """Inverse of ``flat_coordinates``."""

    def lists(counts, values):
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), values)

    points = pa.StructArray.from_arrays([pa.array(x), pa.array(y)], fields=list(VERTEX_ARROW))
    nested = lists(n_parts, lists(n_rings, lists(n_vertices, points)))
    return pa.StructArray.from_arrays([pa.array(kinds, pa.string()), nested], fields=list(GEOMETRY_ARROW))


@dataclass
class Edges:
    """Edges of a geometry column, flattened; polygon interiors lie to the left of each edge."""

    x1: np.ndarray
    y1: np.ndarray
    x2: np.ndarray
    y2: np.ndarray
    owner: np.ndarray  # row of each edge
    start: np.ndarray  # first edge of each row
    count: np.ndarray  # edges of each row
    dimension: np.ndarray  # 0 point, 1 line, 2 polygon, of each row
    end_points: tuple  # (x, y, owner) of the vertices that bound open lines


def edges_of(column, mercator: bool = False) -> Edges:
    column = _plain(column)
    x, y, n_vertices, n_rings, n_parts = flat_coordinates(column)
    if mercator:
        x = np.radians(x) * MERCATOR_RADIUS_M
        y = np.log(np.tan(np.pi / 4 + np.radians(y) / 2)) * MERCATOR_RADIUS_M
    n_rows = len(column)
    dimension = np.array([DIMENSION.get(k, 2) for k in column.field("kind").to_pylist()], dtype=np.int64)
    part_row = np.repeat(np.arange(n_rows), n_parts)
    ring_row = np.repeat(part_row, n_rings)
    is_hole = _spread(n_rings) > 0
    ring_start = _group_starts(n_vertices)

    # A ring of n vertices has n-1 edges; a lone point is one edge of length zero.
    n_edges = np.where(n_vertices > 1, n_vertices - 1, n_vertices)
    ring_of_edge = np.repeat(np.arange(len(n_vertices)), n_edges)
    first = ring_start[ring_of_edge] + _spread(n_edges) if len(n_edges) else np.zeros(0, np.int64)
    second = np.where(n_vertices[ring_of_edge] > 1, first + 1, first)
    x1, y1, x2, y2 = x[first], y[first], x[second], y[second]

    # Wind shells counter-clockwise and holes clockwise.
    ox, oy = x[ring_start[ring_of_edge]], y[ring_start[ring_of_edge]]
    twice_area = np.bincount(
        ring_of_edge,
        (x1 - ox) * (y2 - oy) - (x2 - ox) * (y1 - oy),
        minlength=len(n_vertices),
    )
    flip = ((twice_area < 0) != is_hole) & (dimension[ring_row] == 2)
    swap = flip[ring_of_edge]
    x1, x2 = np.where(swap, x2, x1), np.where(swap, x1, x2)
    y1, y2 = np.where(swap, y2, y1), np.where(swap, y1, y2)

    owner = ring_row[ring_of_edge]
    count = np.bincount(owner, minlength=n_rows).astype(np.int64)

    last = ring_start + n_vertices - 1
    open_line = (dimension[ring_row] == 1) & (n_vertices > 1)
    open_line &= (x[ring_start] != x[last]) | (y[ring_start] != y[last]) if len(last) else open_line
    tips = np.concatenate([ring_start[open_line], last[open_line]])
    tip_rows = np.concatenate([ring_row[open_line], ring_row[open_line]])
    return Edges(x1, y1, x2, y2, owner, _group_starts(count), count, dimension, (x[tips], y[tips], tip_rows))


def _against(owner: np.ndarray, other: Edges):
    """Yield (i, j): item ``i`` of ``owner`` against every edge ``j`` of the same row in ``other``."""
    sizes = other.count[owner]
    bounds = np.cumsum(sizes)
    at = 0
    while at < len(owner):
        base = bounds[at - 1] if at else 0
        to = max(int(np.searchsorted(bounds, base + SLICE, side="right")), at + 1)
        n = sizes[at:to]
        i = np.repeat(np.arange(at, to), n)
        yield i, other.start[owner[i]] + _spread(n)
        at = to


def _row_boxes(e: Edges) -> list[np.ndarray]:
    """xmin, ymin, xmax, ymax of each row's edges; NaN where there is none."""
    some = e.count > 0
    found = []
    for smallest, ends in ((np.fmin, (e.x1, e.x2)), (np.fmin, (e.y1, e.y2)), (np.fmax, (e.x1, e.x2)), (np.fmax, (e.y1, e.y2))):
        box = np.full(len(e.count), np.nan)
        if some.any():
            box[some] = smallest.reduceat(smallest(*ends), e.start[some])
        found.append(box)
    return found


def _diagonal_spans(e: Edges) -> list[tuple[np.ndarray, np.ndarray]]:
    """Least and most of x + y and of x - y over each row's edges, with room for the tolerance; NaN where there is none."""
    some = e.count > 0
    found = []
    for sign in (1, -1):
        ends = e.x1 + sign * e.y1, e.x2 + sign * e.y2
        low, high = np.full((2, len(e.count)), np.nan)
        if some.any():
            low[some] = np.fmin.reduceat(np.fmin(*ends), e.start[some]) - 2 * TOLERANCE
            high[some] = np.fmax.reduceat(np.fmax(*ends), e.start[some]) + 2 * TOLERANCE
        found.append((low, high))
    return found


def _close(a: Edges, b: Edges) -> np.ndarray:
    """Which edges of ``a`` have a box that meets the box of their row in ``b``."""
    x0, y0, x1, y1 = (v[a.owner] for v in _row_boxes(b))
    near = (np.minimum(a.x1, a.x2) <= x1 + TOLERANCE) & (np.maximum(a.x1, a.x2) >= x0 - TOLERANCE)
    near &= (np.minimum(a.y1, a.y2) <= y1 + TOLERANCE) & (np.maximum(a.y1, a.y2) >= y0 - TOLERANCE)
    near = np.flatnonzero(near)
    for sign, (low, high) in zip((1, -1), _diagonal_spans(b)):
        p, q = a.x1[near] + sign * a.y1[near], a.x2[near] + sign * a.y2[near]
        row = a.owner[near]
        near = near[(np.minimum(p, q) <= high[row]) & (np.maximum(p, q) >= low[row])]
    return near


def _split(a: Edges, b: Edges):
    """Cut the edges of ``a`` where they meet ``b``.

    Returns the pieces (x1, y1, x2, y2, owner), the rows in contact, and the contact points.
    """
    edge, t = _cuts(a, b)
    contact = a.owner[edge], a.x1[edge] + t * (a.x2 - a.x1)[edge], a.y1[edge] + t * (a.y2 - a.y1)[edge]
    return _pieces(a, edge, t), *contact


def _cuts(a: Edges, b: Edges) -> tuple[np.ndarray, np.ndarray]:
    """Edges of ``a`` that meet ``b``, and where along them (0..1)."""
    dx, dy = a.x2 - a.x1, a.y2 - a.y1
    size = np.hypot(dx, dy)
    cut_edge, cut_t = [], []
    # Most edges of either row lie away from the whole other row.
    mine, other = _close(a, b), _close(b, a)
    count = np.bincount(b.owner[other], minlength=len(b.count)).astype(np.int64)
    own_spans = [(np.minimum(p[mine], q[mine]), np.maximum(p[mine], q[mine])) for p, q in ((a.x1, a.x2), (a.y1, a.y2))]
    other_spans = [(np.minimum(p[other], q[other]) - TOLERANCE, np.maximum(p[other], q[other]) + TOLERANCE) for p, q in ((b.x1, b.x2), (b.y1, b.y2))]
    for i, j in _against(a.owner[mine], replace(b, start=_group_starts(count), count=count)):
        # Only edges whose boxes meet can touch.
        for (low, high), (other_low, other_high) in zip(own_spans, other_spans):
            near = (low[i] <= other_high[j]) & (high[i] >= other_low[j])
            i, j = i[near], j[near]
        i, j = mine[i], other[j]
        ex, ey = b.x2[j] - b.x1[j], b.y2[j] - b.y1[j]
        esize = np.hypot(ex, ey)
        px, py = b.x1[j] - a.x1[i], b.y1[j] - a.y1[i]
        cross = dx[i] * ey - dy[i] * ex
        slanted = np.abs(cross) > 1e-14 * np.maximum(size[i] * esize, 1e-300)
        slanted &= (size[i] > 0) & (esize > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (px * ey - py * ex) / cross
            u = (px * dy[i] - py * dx[i]) / cross
        meets = slanted & (t * size[i] >= -TOLERANCE) & ((1 - t) * size[i] >= -TOLERANCE)
        meets &= (u * esize >= -TOLERANCE) & ((1 - u) * esize >= -TOLERANCE)
        found = [(i[meets], t[meets])]

        # Parallel edges and single points: project the ends of b on a, and of a on b.
        flat = ~slanted
        for qx, qy in ((b.x1[j], b.y1[j]), (b.x2[j], b.y2[j])):
            rx, ry = qx - a.x1[i], qy - a.y1[i]
            with np.errstate(divide="ignore", invalid="ignore"):
                t = np.where(size[i] > 0, (rx * dx[i] + ry * dy[i]) / (size[i] ** 2), 0.0)
            off = np.hypot(rx - t * dx[i], ry - t * dy[i])
            hit = flat & (off <= TOLERANCE)
            hit &= (t * size[i] >= -TOLERANCE) & ((1 - t) * size[i] >= -TOLERANCE)
            found.append((i[hit], t[hit]))
        for qx, qy, t in ((a.x1[i], a.y1[i], 0.0), (a.x2[i], a.y2[i], 1.0)):
            rx, ry = qx - b.x1[j], qy - b.y1[j]
            with np.errstate(divide="ignore", invalid="ignore"):
                u = np.where(esize > 0, (rx * ex + ry * ey) / (esize**2), 0.0)
            off = np.hypot(rx - u * ex, ry - u * ey)
            hit = flat & (off <= TOLERANCE)
            hit &= (u * esize >= -TOLERANCE) & ((1 - u) * esize >= -TOLERANCE)
            found.append((i[hit], np.full(hit.sum(), t)))
        for edge, t in found:
            cut_edge.append(edge)
            cut_t.append(t)

    def join(chunks, dtype=float):
        return np.concatenate(chunks) if chunks else np.zeros(0, dtype)

    return join(cut_edge, np.int64).astype(np.int64), join(cut_t)


def _pieces(a: Edges, edge: np.ndarray, t: np.ndarray) -> tuple:
    """The edges of ``a``, cut at the given places, as (x1, y1, x2, y2, owner)."""
    dx, dy = a.x2 - a.x1, a.y2 - a.y1
    size = np.hypot(dx, dy)
    inner = (t * size[edge] > TOLERANCE) & ((1 - t) * size[edge] > TOLERANCE)
    n = len(a.owner)
    all_edge = np.concatenate([np.arange(n), edge[inner], np.arange(n)])
    all_t = np.concatenate([np.zeros(n), t[inner], np.ones(n)])
    order = np.lexsort((all_t, all_edge))
    all_edge, all_t = all_edge[order], all_t[order]
    same = all_edge[1:] == all_edge[:-1]
    e, t0, t1 = all_edge[:-1][same], all_t[:-1][same], all_t[1:][same]
    keep = ((t1 - t0) * size[e] > TOLERANCE) | (size[e] <= TOLERANCE)
    e, t0, t1 = e[keep], t0[keep], t1[keep]
    return (
        a.x1[e] + t0 * dx[e],
        a.y1[e] + t0 * dy[e],
        np.where(t1 == 1, a.x2[e], a.x1[e] + t1 * dx[e]),
        np.where(t1 == 1, a.y2[e], a.y1[e] + t1 * dy[e]),
        a.owner[e],
    )


OUTSIDE, INSIDE, SAME_WAY, OPPOSITE = 0, 1, 2, 3


def _classify(pieces, b: Edges) -> np.ndarray:
    """Where the middle of each piece lies against ``b``; on an edge, which way that edge runs."""
    x1, y1, x2, y2, owner = pieces
    mx, my = (x1 + x2) / 2, (y1 + y2) / 2
    crossings = np.zeros(len(owner), np.int64)
    where = np.zeros(len(owner), np.int64)
    x_low, y_low, x_high, y_high = (v[owner] for v in _row_boxes(b))
    near = (mx >= x_low - TOLERANCE) & (mx <= x_high + TOLERANCE) & (my >= y_low - TOLERANCE) & (my <= y_high + TOLERANCE)
    some = np.flatnonzero(near)
    for sign, (low, high) in zip((1, -1), _diagonal_spans(b)):
        at, row = mx[some] + sign * my[some], owner[some]
        some = some[(at >= low[row]) & (at <= high[row])]
    spot_y = my[some]
    low, high, right = np.minimum(b.y1, b.y2) - TOLERANCE, np.maximum(b.y1, b.y2) + TOLERANCE, np.maximum(b.x1, b.x2) + TOLERANCE
    for i, j in _against(owner[some], b):
        # Only edges level with the middle and not wholly to its left can cross its ray or hold it.
        height = spot_y[i]
        level = (low[j] <= height) & (high[j] >= height)
        i, j = some[i[level]], j[level]
        ahead = right[j] >= mx[i]
        i, j = i[ahead], j[ahead]
        bx1, by1, bx2, by2 = b.x1[j], b.y1[j], b.x2[j], b.y2[j]
        ex, ey = bx2 - bx1, by2 - by1
        straddles = (by1 > my[i]) != (by2 > my[i])
        with np.errstate(divide="ignore", invalid="ignore"):
            at = bx1 + ex * (my[i] - by1) / (by2 - by1)
        crossings += np.bincount(i[straddles & (mx[i] < at)], minlength=len(owner))
        rx, ry = mx[i] - bx1, my[i] - by1
        square = ex * ex + ey * ey
        with np.errstate(divide="ignore", invalid="ignore"):
            u = np.where(square > 0, np.clip((rx * ex + ry * ey) / square, 0, 1), 0.0)
        on = np.hypot(rx - u * ex, ry - u * ey) <= TOLERANCE
        along = (x2[i] - x1[i]) * ex + (y2[i] - y1[i]) * ey
        where[i[on & (along >= 0)]] = SAME_WAY
        where[i[on & (along < 0)]] = OPPOSITE
    inside = (where == 0) & (crossings % 2 == 1) & (b.dimension[owner] == 2)
    where[inside] = INSIDE
    return where


RELATION_ARROW = pa.struct(
    [
        ("intersects", pa.bool_()),
        ("contains", pa.bool_()),
        ("within", pa.bool_()),
        ("crosses", pa.bool_()),
        ("touches", pa.bool_()),
        ("overlaps", pa.bool_()),
        ("area", pa.float64()),
        ("length", pa.float64()),
    ]
)
MEASURES = T.StructType(
    [T.StructField(name, T.DoubleType()) for name in ("area", "length", "perimeter", "x", "y")]
)


@F.arrow_udf(MEASURES)
def measure(geom: pa.Array) -> pa.Array:
    """Planar area (holes subtract), length of lines, boundary length of polygons, and the centroid:
    area-weighted for polygons, length-weighted for lines, the mean of points.
    """
    e = edges_of(geom)
    n = len(e.count)
    dimension = e.dimension[e.owner]
    some = e.count > 0
    ox, oy = np.full(n, np.nan), np.full(n, np.nan)
    ox[some], oy[some] = e.x1[e.start[some]], e.y1[e.start[some]]
    ax, ay = e.x1 - ox[e.owner], e.y1 - oy[e.owner]
    bx, by = e.x2 - ox[e.owner], e.y2 - oy[e.owner]
    size = np.hypot(bx - ax, by - ay)
    cross = (ax * by - bx * ay) / 2

    def total(values):
        return np.bincount(e.owner, values, minlength=n)

    length = total(np.where(dimension == 1, size, 0.0))
    perimeter = total(np.where(dimension == 2, size, 0.0))
    area = np.abs(total(np.where(dimension == 2, cross, 0.0)))
    weight = np.choose(dimension, [np.ones_like(size), size, cross])
    third = np.where(dimension == 2, 3.0, 2.0)
    mass = total(weight)
    with np.errstate(divide="ignore", invalid="ignore"):
        x = ox + np.where(mass != 0, total(weight * (ax + bx) / third) / mass, 0.0)
        y = oy + np.where(mass != 0, total(weight * (ay + by) / third) / mass, 0.0)
    return pa.StructArray.from_arrays(
        [pa.array(v, mask=~some) for v in (area, length, perimeter, x, y)], names=MEASURES.names
    )


@F.arrow_udf(T.IntegerType())
def place(x: pa.Array, y: pa.Array, geom: pa.Array) -> pa.Array:
    """Where a point lies against a polygon: 0 outside, 1 inside, 2 on the boundary."""
    px, py = (_plain(v).to_numpy(zero_copy_only=False) for v in (x, y))
    spot = (px, py, px, py, np.arange(len(px)))
    where = _classify(spot, edges_of(geom))
    return pa.array(np.minimum(where, 2).astype(np.int32))


PREDICATES = ["intersects", "contains", "within", "crosses", "touches", "overlaps"]
RELATION = T.StructType(
    [T.StructField(name, T.BooleanType()) for name in PREDICATES]
    + [T.StructField(name, T.DoubleType()) for name in ("area", "length")]
)


def relation(left, right) -> pa.Array:
    """Every predicate of each pair, the area both share, and the length of ``left`` inside
    ``right``. Pieces of one boundary are located against the other shape; the predicates and the
    shared area (a boundary integral over the pieces that bound it) follow from that.
    """
    a, b = edges_of(left), edges_of(right)
    n = len(a.count)
    a_pieces, rows, cx, cy = _split(a, b)
    b_pieces, _, _, _ = _split(b, a)
    a_where, b_where = _classify(a_pieces, b), _classify(b_pieces, a)

    def any_of(owner, mask):
        return np.bincount(owner[mask], minlength=n) > 0

    a_own, b_own = a_pieces[4], b_pieces[4]
    a_in, a_out = any_of(a_own, a_where == INSIDE), any_of(a_own, a_where == OUTSIDE)
    b_in, b_out = any_of(b_own, b_where == INSIDE), any_of(b_own, b_where == OUTSIDE)
    a_on, a_same = any_of(a_own, a_where >= SAME_WAY), any_of(a_own, a_where == SAME_WAY)
    contact = np.bincount(rows, minlength=n) > 0

    # Contacts away from the ends of both lines are interior points of both.
    tip = np.zeros(len(rows), bool)
    for tips in (a.end_points, b.end_points):
        tip |= _matches(rows, cx, cy, *tips)
    inner_contact = any_of(rows, ~tip)

    da, db = a.dimension, b.dimension
    interiors = np.select(
        [
            (da == 2) & (db == 2),
            (da == 1) & (db == 2),
            (da == 2) & (db == 1),
            (da == 1) & (db == 1),
            (da == 0) & (db == 2),
            (da == 2) & (db == 0),
        ],
        [a_in | b_in | a_same, a_in, b_in, a_on | inner_contact, a_in, b_in],
        default=inner_contact,
    )
    intersects = contact | a_in | b_in | a_on
    within = interiors & ~a_out & (da <= db) & ~((da == 2) & b_in)
    contains = interiors & ~b_out & (db <= da) & ~((db == 2) & a_in)
    # Interiors of equal dimension overlap in that dimension unless two lines merely cross.
    thick = np.where((da == 1) & (db == 1), a_on, interiors)
    overlaps = (da == db) & thick & ~within & ~contains
    crosses = np.select(
        [da < db, da > db, (da == 1) & (db == 1)],
        [interiors & a_out, interiors & b_out, inner_contact & ~a_on],
        default=False,
    )
    touches = intersects & ~interiors & ((da > 0) | (db > 0))

    shared = np.zeros(n)
    inside_length = np.zeros(n)
    with_origin = a.count > 0
    ox, oy = np.zeros(n), np.zeros(n)
    ox[with_origin], oy[with_origin] = a.x1[a.start[with_origin]], a.y1[a.start[with_origin]]
    for pieces, where, wanted in (
        (a_pieces, a_where, (INSIDE, SAME_WAY)),
        (b_pieces, b_where, (INSIDE,)),
    ):
        x1, y1, x2, y2, owner = pieces
        x1, x2, y1, y2 = x1 - ox[owner], x2 - ox[owner], y1 - oy[owner], y2 - oy[owner]
        bounds = np.isin(where, wanted)
        shared += np.bincount(owner, np.where(bounds, (x1 * y2 - x2 * y1) / 2, 0.0), minlength=n)
    shared = np.where((da == 2) & (db == 2), np.maximum(shared, 0.0), 0.0)
    x1, y1, x2, y2, owner = a_pieces
    inside_length += np.bincount(
        owner, np.where(a_where == INSIDE, np.hypot(x2 - x1, y2 - y1), 0.0), minlength=n
    )
    return pa.StructArray.from_arrays(
        [pa.array(v) for v in (intersects, contains, within, crosses, touches, overlaps, shared, inside_length)],
        fields=list(RELATION_ARROW),
    )


def _matches(rows, x, y, tip_x, tip_y, tip_rows) -> np.ndarray:
    """Which of the points (rows, x, y) coincide with a tip of the same row."""
    order = np.argsort(tip_rows, kind="stable")
    tip_x, tip_y, tip_rows = tip_x[order], tip_y[order], tip_rows[order]
    low = np.searchsorted(tip_rows, rows, side="left")
    n = np.searchsorted(tip_rows, rows, side="right") - low
    i = np.repeat(np.arange(len(rows)), n)
    j = np.repeat(low, n) + _spread(n)
    close = np.hypot(x[i] - tip_x[j], y[i] - tip_y[j]) <= 10 * TOLERANCE
    return np.bincount(i[close], minlength=len(rows)) > 0


def separation(left, right, mercator: bool) -> np.ndarray:
    """Smallest planar distance of each pair; zero when they share a point."""
    a, b = edges_of(left, mercator), edges_of(right, mercator)
    best = np.full(len(a.count), np.inf)

    def from_ends(x, y, p1x, p1y, ex, ey):
        square = ex * ex + ey * ey
        rx, ry = x - p1x, y - p1y
        with np.errstate(divide="ignore", invalid="ignore"):
            u = np.where(square > 0, np.clip((rx * ex + ry * ey) / square, 0, 1), 0.0)
        return np.hypot(rx - u * ex, ry - u * ey)

    for i, j in _against(a.owner, b):
        ax1, ay1, ax2, ay2 = a.x1[i], a.y1[i], a.x2[i], a.y2[i]
        bx1, by1, bx2, by2 = b.x1[j], b.y1[j], b.x2[j], b.y2[j]
        ux, uy, vx, vy = ax2 - ax1, ay2 - ay1, bx2 - bx1, by2 - by1
        gap = from_ends(ax1, ay1, bx1, by1, vx, vy)
        for other in (
            from_ends(ax2, ay2, bx1, by1, vx, vy),
            from_ends(bx1, by1, ax1, ay1, ux, uy),
            from_ends(bx2, by2, ax1, ay1, ux, uy),
        ):
            np.minimum(gap, other, out=gap)
        s1 = ux * (by1 - ay1) - uy * (bx1 - ax1)
        s2 = ux * (by2 - ay1) - uy * (bx2 - ax1)
        t1 = vx * (ay1 - by1) - vy * (ax1 - bx1)
        t2 = vx * (ay2 - by1) - vy * (ax2 - bx1)
        gap[(s1 * s2 < 0) & (t1 * t2 < 0)] = 0.0
        np.minimum.at(best, a.owner[i], gap)
    # One shape may lie inside the other without their edges being near.
    for p, q in ((a, b), (b, a)):
        rows = np.flatnonzero((p.count > 0) & (q.dimension == 2) & (best > 0))
        x, y = p.x1[p.start[rows]], p.y1[p.start[rows]]
        best[rows[_classify((x, y, x, y, rows), q) > 0]] = 0.0
    return best


@F.arrow_udf(RELATION)
def relate(left: pa.Array, right: pa.Array) -> pa.Array:
    return relation(left, right)


@F.arrow_udf(T.DoubleType())
def mercator_separation(left: pa.Array, right: pa.Array) -> pa.Array:
    return pa.array(separation(left, right, mercator=True))


@F.arrow_udf(T.DoubleType())
def degree_separation(left: pa.Array, right: pa.Array) -> pa.Array:
    return pa.array(separation(left, right, mercator=False))


def _kept_by_tolerance(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker: which vertices of one path stay."""
    keep = np.zeros(len(x), bool)
    if len(x):
        keep[[0, -1]] = True
    stack = [(0, len(x) - 1)]
    while stack:
        lo, hi = stack.pop()
        if hi - lo < 2:
            continue
        mx, my = x[lo + 1 : hi] - x[lo], y[lo + 1 : hi] - y[lo]
        ex, ey = x[hi] - x[lo], y[hi] - y[lo]
        square = ex * ex + ey * ey
        u = np.clip((mx * ex + my * ey) / square, 0, 1) if square > 0 else 0.0
        off = np.hypot(mx - u * ex, my - u * ey)
        far = int(np.argmax(off))
        if off[far] > tolerance:
            keep[lo + 1 + far] = True
            stack += [(lo, lo + 1 + far), (lo + 1 + far, hi)]
    return keep


@F.arrow_udf(GEOMETRY)
def simplify(geom: pa.Array, tolerance: pa.Array) -> pa.Array:
    """Drop vertices closer than ``tolerance`` to the simplified path. A polygon ring that would
    collapse below a triangle keeps its original vertices; a zero tolerance changes nothing.
    """
    geom = _plain(geom)
    x, y, n_vertices, n_rings, n_parts = flat_coordinates(geom)
    kinds = geom.field("kind").to_pylist()
    limits = np.asarray(_plain(tolerance).to_pylist(), float)
    ring_row = np.repeat(np.repeat(np.arange(len(geom)), n_parts), n_rings)
    start = _group_starts(n_vertices)
    keep = np.ones(len(x), bool)
    for ring, row in enumerate(ring_row):
        n, s = n_vertices[ring], start[ring]
        smallest = 4 if kinds[row] in ("Polygon", "MultiPolygon") else 2
        if limits[row] > 0 and n > smallest:
            kept = _kept_by_tolerance(x[s : s + n], y[s : s + n], limits[row])
            if kept.sum() >= smallest:
                keep[s : s + n] = kept
    ring_of = np.repeat(np.arange(len(n_vertices)), n_vertices)
    left = np.bincount(ring_of[keep], minlength=len(n_vertices))
    return rebuild(kinds, x[keep], y[keep], left, n_rings, n_parts)


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull of an (n, 2) array, counter-clockwise, not closed."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def half(sequence):
        chain: list = []
        for px, py in sequence:
            while len(chain) > 1:
                (ax, ay), (bx, by) = chain[-2], chain[-1]
                if (bx - ax) * (py - ay) - (by - ay) * (px - ax) > 0:
                    break
                chain.pop()
            chain.append((px, py))
        return chain[:-1]

    listed = points.tolist()
    return np.array(half(listed) + half(listed[::-1]))


def _gather(edges: Edges, rows: np.ndarray, owner: np.ndarray, n_owners: int) -> Edges:
    """Edges of the given rows, re-owned: row ``rows[p]`` now belongs to ``owner[p]`` (ascending)."""
    sizes = edges.count[rows]
    pick = np.repeat(edges.start[rows], sizes) + _spread(sizes)
    owners = np.repeat(owner, sizes)
    count = np.bincount(owners, minlength=n_owners).astype(np.int64)
    none = (np.zeros(0), np.zeros(0), np.zeros(0, np.int64))
    dimension = np.full(n_owners, 2)
    return Edges(
        edges.x1[pick], edges.y1[pick], edges.x2[pick], edges.y2[pick], owners, _group_starts(count), count, dimension, none
    )


def outline(regions: pa.Array, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directed pieces (n, 4) that bound the union of each group of polygon geometries, and the
    group of each piece. Regions of a group stand together.

    A piece of one boundary survives when no other region covers it. Where boundaries coincide and
    run the same way only the first region keeps the piece; where they run opposite ways nobody does.
    Null and empty regions bound nothing.
    """
    edges = edges_of(regions)
    n = len(edges.count)
    some = edges.count > 0
    (x0, y0), (x1, y1) = np.full((2, n), np.inf), np.full((2, n), -np.inf)
    if some.any():
        starts = edges.start[some]
        x0[some], x1[some] = np.minimum.reduceat(edges.x1, starts), np.maximum.reduceat(edges.x1, starts)
        y0[some], y1[some] = np.minimum.reduceat(edges.y1, starts), np.maximum.reduceat(edges.y1, starts)
    first_of_group = np.searchsorted(group, group, side="left")
    size_of_group = np.searchsorted(group, group, side="right") - first_of_group
    own = np.repeat(np.arange(n), size_of_group)
    other = np.repeat(first_of_group, size_of_group) + _spread(size_of_group)
    near = (own != other) & (x0[own] <= x1[other]) & (x1[own] >= x0[other])
    near &= (y0[own] <= y1[other]) & (y1[own] >= y0[other])
    own, other = own[near], other[near]
    # Slanted regions seldom meet where their boxes do: look along the diagonals as well.
    for low, high in _diagonal_spans(edges):
        apart = (low[own] > high[other]) | (high[own] < low[other])
        own, other = own[~apart], other[~apart]
    # Cuts are sought pair by pair: few edges of a region are near any one other region.
    pair = np.arange(len(own))
    edge, t = _cuts(_gather(edges, own, pair, len(own)), _gather(edges, other, pair, len(own)))
    sizes = edges.count[own]
    pieces = _pieces(edges, (np.repeat(edges.start[own], sizes) + _spread(sizes))[edge], t)
    owner = pieces[4]
    per_region = np.bincount(owner, minlength=n).astype(np.int64)
    begin = _group_starts(per_region)
    # Every piece against every near region, one row per (region, near region).
    sizes = per_region[own]
    pick = np.repeat(begin[own], sizes) + _spread(sizes)
    pair_of = np.repeat(pair, sizes)
    placed = tuple(c[pick] for c in pieces[:4]) + (pair_of,)
    where = _classify(placed, _gather(edges, other, pair, len(own)))
    covered = (where == INSIDE) | (where == OPPOSITE) | ((where == SAME_WAY) & (other < own)[pair_of])
    lost = np.bincount(pick[covered], minlength=len(owner)) > 0
    return np.column_stack(pieces[:4])[~lost], group[owner[~lost]]


STRETCHES = T.ArrayType(
    T.StructType([T.StructField("t0", T.DoubleType()), T.StructField("t1", T.DoubleType())])
)


@F.arrow_udf(STRETCHES)
def covered_intervals(segment: pa.Array, region: pa.Array, earlier: pa.Array) -> pa.Array:
    """Which stretches (0..1) of a directed boundary segment another region covers; ``earlier``
    says whether the region wins where both boundaries coincide.
    """
    a, b = edges_of(segment), edges_of(region)
    pieces, _, _, _ = _split(a, b)
    where = _classify(pieces, b)
    owner = pieces[4]
    first = np.asarray(_plain(earlier).to_pylist(), bool)
    covered = (where == INSIDE) | (where == OPPOSITE) | ((where == SAME_WAY) & first[owner])
    dx, dy = a.x2 - a.x1, a.y2 - a.y1
    square = np.maximum(dx * dx + dy * dy, 1e-300)

    def position(x, y):
        return ((x - a.x1[owner]) * dx[owner] + (y - a.y1[owner]) * dy[owner]) / square[owner]

    t0, t1 = position(pieces[0], pieces[1]), position(pieces[2], pieces[3])
    counts = np.bincount(owner[covered], minlength=len(a.count))
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    values = pa.StructArray.from_arrays([pa.array(t0[covered]), pa.array(t1[covered])], names=["t0", "t1"])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


# Regions of a group united in one go; larger groups are united in rounds. Every region of a chunk is
# compared with every other, so small chunks are cheaper: covered edges are gone by the next round.
UNION_CHUNK = 8


def unite(regions: pa.Array, group: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Union of each group of polygon geometries (groups in ascending order)."""
    from geoloom.functions.clip import trace  # tracing builds on this module

    while True:
        order_in_group = np.arange(len(group)) - np.searchsorted(group, group, side="left")
        lone = np.searchsorted(group, group, side="right") - np.searchsorted(group, group, side="left") == 1
        if lone.all():
            return regions, group
        # Chunks of a group are numbered so that they stay together and in order.
        chunk = np.cumsum(order_in_group % UNION_CHUNK == 0) - 1
        many = np.flatnonzero(np.bincount(chunk)[chunk] > 1)
        pieces, of_chunk = outline(regions.take(pa.array(many)), chunk[many])
        first = np.flatnonzero(order_in_group % UNION_CHUNK == 0)
        merged, owner = np.unique(of_chunk, return_inverse=True)
        united = trace([*pieces.T, owner], len(merged))
        pool = pa.concat_arrays([regions.cast(GEOMETRY_ARROW), united])
        kept = first.copy()
        kept[merged] = len(regions) + np.arange(len(merged))
        regions, group = pool.take(pa.array(kept)), group[first]


def capsules(edges: Edges, distance: np.ndarray, segments: int) -> tuple[pa.Array, np.ndarray]:
    """Every edge widened by its own distance: the regular polygon of ``segments`` sides swept along
    it. Returns closed rings as polygons and the row each belongs to.
    """
    step = 2 * np.pi / segments
    angle = np.arctan2(edges.y2 - edges.y1, edges.x2 - edges.x1)
    # The polygon's corner that lies farthest to the right of the edge; half a turn on, to the left.
    first = np.rint((angle - np.pi / 2) / step)
    half = segments // 2
    turn = np.concatenate([np.arange(half + 1), np.arange(half, segments + 1)])
    at_end = np.concatenate([np.ones(half + 1, bool), np.zeros(half + 1, bool)])
    corner = (first[:, None] + turn) * step
    x = np.where(at_end, edges.x2[:, None], edges.x1[:, None]) + np.cos(corner) * distance[:, None]
    y = np.where(at_end, edges.y2[:, None], edges.y1[:, None]) + np.sin(corner) * distance[:, None]
    x, y = np.column_stack([x, x[:, :1]]), np.column_stack([y, y[:, :1]])
    n = len(edges.owner)
    ones = np.ones(n, np.int64)
    return rebuild(["Polygon"] * n, x.ravel(), y.ravel(), ones * x.shape[1], ones, ones), edges.owner
