"""Clipped geometries: what two shapes share, and what of the first lies outside the second.

All pairs of an Arrow batch are clipped together. The boundaries of both shapes are cut where they meet and the pieces
located against the other shape (``kernels``); those that bound the result are then traced into rings by array steps over
the whole batch: ends are gathered into nodes, the ways round every node are sorted by angle, each piece is followed by the
first one clockwise from the way it came, and pointer doubling numbers the pieces of each ring.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.functions import kernels
from geoloom.functions.kernels import INSIDE, OPPOSITE, OUTSIDE, SAME_WAY
from geoloom.layer import GEOMETRY

# Ends of pieces closer than this (degrees) are one node.
NODE = 1e-9


def _clusters(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Number the values of each group so that neighbours at most NODE apart share a number."""
    order = np.lexsort((value, group))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(group[order]) != 0) | (np.diff(value[order]) > NODE)
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def _successors(x1, y1, x2, y2, owner) -> np.ndarray:
    """The piece that follows each piece, or -1."""
    n = len(owner)
    group = np.concatenate([owner, owner])
    node = _clusters(_clusters(group, np.concatenate([x1, x2])), np.concatenate([y1, y2]))
    angle = np.arctan2(np.concatenate([y2 - y1, y1 - y2]), np.concatenate([x2 - x1, x1 - x2]))
    ends = np.repeat([0, 1], n)
    order = np.lexsort((ends, -angle, node))
    node, begins, piece = node[order], ends[order] == 0, order % n
    leaving = np.append(np.flatnonzero(begins), -1)
    arriving = np.flatnonzero(~begins)
    following = leaving[np.searchsorted(leaving[:-1], arriving)]
    first = leaving[np.searchsorted(leaving[:-1], np.searchsorted(node, node[arriving]))]
    ahead = (following >= 0) & (node[following] == node[arriving])
    wraps = (first >= 0) & (node[first] == node[arriving])
    out = np.full(n, -1)
    out[piece[arriving]] = np.where(ahead, piece[following], np.where(wraps, piece[first], -1))
    return out


def _cycles(follow: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(on a cycle, smallest member of the cycle, steps until it) by pointer doubling."""
    n = len(follow)
    open_end = follow < 0
    jump = np.where(open_end, np.arange(n), follow)
    low, ahead, step = np.arange(n), np.zeros(n, np.int64), 1
    while n:
        lower = low[jump] < low
        lost = open_end[jump] & ~open_end
        if not lower.any() and not lost.any():
            break
        ahead = np.where(lower, ahead[jump] + step, ahead)
        low, open_end, jump, step = np.minimum(low, low[jump]), open_end | open_end[jump], jump[jump], step * 2
    return ~open_end, low, ahead


def _straightened(x, y, ring):
    """Drop vertices on the straight line between their neighbours; rings stand together, not closed. The first vertex of a
    ring is its leftmost, lowest one, hence a corner."""
    while len(ring):
        starts = np.searchsorted(ring, ring, "left")
        stops = np.searchsorted(ring, ring, "right") - 1
        at = np.arange(len(ring))
        before, after = np.where(at == starts, stops, at - 1), np.where(at == stops, starts, at + 1)
        dx, dy = x[after] - x[before], y[after] - y[before]
        off = np.abs((x - x[before]) * dy - (y - y[before]) * dx)
        straight = (at > starts) & (off <= kernels.TOLERANCE * np.maximum(np.hypot(dx, dy), kernels.TOLERANCE))
        odd = straight & ((at - starts) % 2 == 1)  # of two neighbours one at a time
        straight = odd if odd.any() else straight
        if not straight.any():
            break
        x, y, ring = x[~straight], y[~straight], ring[~straight]
    return x, y, ring


def trace(pieces, n: int) -> pa.Array:
    """The polygons bounded by directed pieces (x1, y1, x2, y2, owner), interior on the left, for owners 0 to n - 1; null where
    nothing is bounded. Rings begin at their leftmost, lowest vertex; shells run counter-clockwise, holes clockwise."""
    order = np.lexsort((pieces[1], pieces[0], pieces[4]))
    x1, y1, x2, y2, owner = (c[order] for c in pieces)
    closed, ring, ahead = _cycles(_successors(x1, y1, x2, y2, owner))
    place = np.where(ahead == 0, np.iinfo(np.int64).min, -ahead)
    order = np.lexsort((place, ring))
    order = order[closed[order]]
    x, y, ring = _straightened(x1[order], y1[order], ring[order])

    ids, start, count = np.unique(ring, return_index=True, return_counts=True)
    of = np.repeat(np.arange(len(ids)), count)
    after = np.arange(len(ring)) + 1
    after[start + count - 1] = start
    ox, oy = x[start][of], y[start][of]
    area = np.bincount(of, ((x - ox) * (y[after] - oy) - (x[after] - ox) * (y - oy)) / 2, minlength=len(ids))
    around = np.bincount(of, np.hypot(x[after] - x, y[after] - y), minlength=len(ids))
    real = (count > 2) & (np.abs(area) > kernels.TOLERANCE * around)
    shells, holes = np.flatnonzero(real & (area > 0)), np.flatnonzero(real & (area < 0))
    ring_owner = owner[ids]

    def path(r):
        at = np.append(np.arange(start[r], start[r] + count[r]), start[r])
        return x[at], y[at]

    parent = _parents(shells, holes, ring_owner, area, path)
    listed = np.concatenate([shells, holes[parent >= 0]])
    shell_of = np.concatenate([shells, parent[parent >= 0]])
    order = np.lexsort((listed, listed != shell_of, shell_of, ring_owner[listed]))
    listed, shell_of = listed[order], shell_of[order]
    size = count[listed] + 1
    turn = kernels._spread(size)
    at = np.repeat(start[listed], size) + np.where(turn == np.repeat(count[listed], size), 0, turn)
    n_rings = np.unique(shell_of, return_counts=True)[1] if len(shell_of) else np.zeros(0, np.int64)
    n_parts = np.bincount(ring_owner[shells], minlength=n)
    kinds = np.where(n_parts > 1, "MultiPolygon", "Polygon").tolist()
    found = kernels.rebuild(kinds, x[at], y[at], size, n_rings, n_parts)
    return found.take(pa.array(np.arange(n), mask=n_parts == 0))


def _parents(shells, holes, ring_owner, area, path) -> np.ndarray:
    """The smallest shell of the same owner that holds each hole, or -1."""
    first, last = (np.searchsorted(ring_owner[shells], ring_owner[holes], side) for side in ("left", "right"))
    many = last - first
    hole = np.repeat(np.arange(len(holes)), many)
    shell = shells[np.repeat(first, many) + kernels._spread(many)] if len(hole) else np.zeros(0, np.int64)
    out = np.full(len(holes), -1)
    if not len(hole):
        return out
    used, at = np.unique(shell, return_inverse=True)
    paths = [path(r) for r in used]
    ones = np.ones(len(used), np.int64)
    column = kernels.rebuild(["Polygon"] * len(used), *[np.concatenate([p[k] for p in paths]) for k in (0, 1)], np.array([len(p[0]) for p in paths]), ones, ones)
    edges = kernels._gather(kernels.edges_of(column), at, np.arange(len(at)), len(at))
    spots = [path(holes[h]) for h in hole]
    mx, my = (np.array([(s[k][0] + s[k][1]) / 2 for s in spots]) for k in (0, 1))
    inside = kernels._classify((mx, my, mx, my, np.arange(len(hole))), edges) == INSIDE
    for k in np.lexsort((-area[shell], hole)):  # the smallest comes last
        if inside[k]:
            out[hole[k]] = shell[k]
    return out


def _kept_lines(pieces, kept: np.ndarray, n: int) -> pa.Array:
    """The kept pieces of lines as MultiLineStrings; pieces that follow one another are one path."""
    x1, y1, x2, y2, owner = (c[kept] for c in pieces)
    goes_on = np.zeros(len(owner), bool)
    goes_on[1:] = (owner[1:] == owner[:-1]) & (np.hypot(x1[1:] - x2[:-1], y1[1:] - y2[:-1]) <= NODE)
    goes_on[1:] &= np.diff(np.flatnonzero(kept)) == 1
    path = np.cumsum(~goes_on) - 1
    n_paths = int(path[-1]) + 1 if len(path) else 0
    size = np.bincount(path, minlength=n_paths) + 1
    begins = np.cumsum(size) - size
    x, y = np.zeros(size.sum()), np.zeros(size.sum())
    at = np.arange(len(path)) + path
    x[at + 1], y[at + 1] = x2, y2
    x[begins], y[begins] = x1[~goes_on], y1[~goes_on]
    n_parts = np.bincount(owner[~goes_on], minlength=n)
    kinds = np.where(n_parts > 1, "MultiLineString", "LineString").tolist()
    found = kernels.rebuild(kinds, x, y, size, np.ones(n_paths, np.int64), n_parts)
    return found.take(pa.array(np.arange(n), mask=n_parts == 0))


CLIPPED = T.StructType([T.StructField("shared", GEOMETRY), T.StructField("rest", GEOMETRY)])


def clipped(left, right) -> tuple[pa.Array, pa.Array]:
    """(what left and right share, what of left is outside right) of each pair of lines or polygons with polygons; null
    where that is empty. What polygons share along an edge or in a point only, without area, is nothing."""
    a, b = kernels.edges_of(left), kernels.edges_of(right)
    n = len(a.count)
    pieces = kernels._split(a, b)[0]
    where = kernels._classify(pieces, b)
    others = kernels._split(b, a)[0]
    inside = kernels._classify(others, a) == INSIDE
    area = a.dimension[pieces[4]] == 2
    turned = tuple(others[k][inside] for k in (2, 3, 0, 1, 4))
    bounds = area & ((where == INSIDE) | (where == SAME_WAY))
    shared = trace([np.concatenate([p[bounds], o[inside]]) for p, o in zip(pieces, others)], n)
    bounds = area & ((where == OUTSIDE) | (where == OPPOSITE))
    rest = trace([np.concatenate([p[bounds], o]) for p, o in zip(pieces, turned)], n)
    if not area.all():
        line = a.dimension != 2
        choice = pa.array(np.where(line, np.arange(n) + n, np.arange(n)))
        shared, rest = (
            pa.concat_arrays([polygons, _kept_lines(pieces, ~area & keep, n)]).take(choice)
            for polygons, keep in ((shared, where != OUTSIDE), (rest, where == OUTSIDE))
        )
    return shared, rest


@F.arrow_udf(CLIPPED)
def clip(left: pa.Array, right: pa.Array) -> pa.Array:
    return pa.StructArray.from_arrays(list(clipped(left, right)), names=["shared", "rest"])
