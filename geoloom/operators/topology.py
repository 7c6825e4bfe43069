"""Simplification that keeps neighbours together.

Polygons that share boundaries are a graph: where other than two edges meet there is a node, and the boundary between two nodes
is an arc, used by the one or two features beside it. Arcs are a table; each is simplified once, whichever features
use it, and the rings are put together again from the simplified arcs. Neighbours so keep touching without gaps or
overlaps, and the areas of a tiling still add up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.functions import kernels
from geoloom.layer import GEOM, VERTEX, Layer, geometry, with_box
from geoloom.sources.place import written

PATH = T.ArrayType(VERTEX)
ARCS = T.ArrayType(T.StructType([T.StructField("flipped", T.BooleanType()), T.StructField("path", PATH)]))
PATH_ARROW = pa.list_(kernels.VERTEX_ARROW)
RING = ["_feature", "_part", "_ring"]


def _paths(column: pa.Array) -> list[np.ndarray]:
    """The (n, 2) vertices of each list of vertices."""
    points = column.flatten()
    flat = np.column_stack([points.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y")])
    return np.split(flat, np.cumsum(kernels._lengths(column))[:-1]) if len(column) else []


def _path_array(paths: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in paths])]).astype(np.int32)
    flat = np.concatenate(paths) if paths else np.zeros((0, 2))
    points = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], fields=list(kernels.VERTEX_ARROW))
    return pa.ListArray.from_arrays(pa.array(offsets), points)


def _canonical(path: np.ndarray) -> tuple[bool, np.ndarray]:
    """(turned, the arc in its own direction): from the smaller end, or, if it is closed, towards the smaller neighbour."""
    ends = tuple(path[0]), tuple(path[-1])
    turned = ends[1] < ends[0] or (ends[0] == ends[1] and tuple(path[-2]) < tuple(path[1]))
    return turned, path[::-1] if turned else path


@F.arrow_udf(ARCS)
def cut_ring(path: pa.Array, is_node: pa.Array) -> pa.Array:
    """The arcs of each ring (not closed) in ring order, from its first node on; a ring without a node is one closed arc from
    its smallest vertex on."""
    flags = np.split(is_node.flatten().to_numpy(zero_copy_only=False), np.cumsum(kernels._lengths(is_node))[:-1]) if len(path) else []
    arcs, turned, counts = [], [], []
    for points, nodes in zip(_paths(path), flags):
        at = np.flatnonzero(nodes)
        if not len(at):
            at = np.lexsort((points[:, 1], points[:, 0]))[:1]
        around = np.concatenate([points[at[0] :], points[: at[0] + 1]])
        stops = np.append(at - at[0], len(points))
        for a, b in zip(stops[:-1], stops[1:]):
            flip, arc = _canonical(around[a : b + 1])
            arcs.append(arc)
            turned.append(flip)
        counts.append(len(at))
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    found = pa.StructArray.from_arrays([pa.array(turned, pa.bool_()), _path_array(arcs)], names=["flipped", "path"])
    return pa.ListArray.from_arrays(pa.array(offsets), found)


def _farthest(path: np.ndarray, lo: int, hi: int) -> int | None:
    """The vertex between two others that is farthest from their line (from the point, if they are one)."""
    if hi - lo < 2:
        return None
    d, m = path[hi] - path[lo], path[lo + 1 : hi] - path[lo]
    size = np.hypot(*d)
    off = np.abs(m[:, 0] * d[1] - m[:, 1] * d[0]) / size if size > 0 else np.hypot(m[:, 0], m[:, 1])
    return lo + 1 + int(off.argmax())


@F.arrow_udf(PATH)
def simplify_arc(path: pa.Array, tolerance: pa.Array, fewest: pa.Array) -> pa.Array:
    """Each arc without the vertices nearer than the tolerance. ``fewest`` is the smallest number of arcs in a ring that uses
    it: an arc of a ring of two keeps its farthest vertex, a closed one two of them, so that no ring collapses."""
    out = []
    for points, limit, arcs in zip(_paths(path), tolerance.to_pylist(), fewest.to_pylist()):
        last = len(points) - 1
        keep = kernels._kept_by_tolerance(points[:, 0], points[:, 1], limit) if limit > 0 else np.ones(len(points), bool)
        if arcs < 3 and keep.sum() < 3 + (arcs == 1):
            far = _farthest(points, 0, last)
            wanted = [far] if far is not None else []
            if arcs == 1 and far is not None:
                sides = [k for k in (_farthest(points, 0, far), _farthest(points, far, last)) if k is not None]
                wanted += sides[:1]
            keep[wanted] = True
        out.append(points[keep])
    return _path_array(out)


def simplify_topology(layer: Layer, tolerance: float) -> Layer:
    """The polygons of a layer with every shared boundary simplified once, within ``tolerance`` degrees.

    Boundaries are shared where neighbours have the same vertices. Nodes stay; every ring keeps three vertices at least. Geometries
    that are no polygons, null or without rings stay as they are. Ids may repeat: rings are told apart by a hash of the
    feature's id and geometry, so equal rows simplify alike.
    """
    polygonal = F.coalesce(F.col(f"{GEOM}.kind").isin("Polygon", "MultiPolygon") & (F.size(F.flatten(f"{GEOM}.parts")) > 0), F.lit(False))
    rows = layer.df.withColumn("_feature", F.when(polygonal, F.xxhash64(layer.id, GEOM)))
    shapes = rows.where("_feature is not null").select("_feature", F.col(f"{GEOM}.kind").alias("_kind"), F.col(f"{GEOM}.parts").alias("_parts")).dropDuplicates(["_feature"])
    parts = shapes.select("_feature", F.posexplode("_parts").alias("_part", "_rings"))
    rings = parts.select("_feature", "_part", F.posexplode("_rings").alias("_ring", "_path"))
    open_path = F.slice("_path", 1, F.greatest(F.size("_path") - 1, F.lit(0)))
    rings = written(rings.select(*RING, open_path.alias("_path")).where(F.size("_path") > 2), "rings")

    a, b = F.col("_path"), F.concat(F.slice("_path", 2, F.size("_path")), F.slice("_path", 1, 1))
    sides = F.zip_with(a, b, lambda p, q: F.struct(F.least(p, q).alias("p"), F.greatest(p, q).alias("q")))
    edges = rings.select(F.explode(sides).alias("e")).where("e.p <> e.q").distinct()
    ends = edges.select(F.explode(F.array("e.p", "e.q")).alias("_v")).groupBy("_v").agg(F.count("*").alias("_n"))
    nodes = ends.where("_n <> 2").select("_v", F.lit(True).alias("_node"))
    placed = rings.select(*RING, F.posexplode("_path").alias("_at", "_v")).join(nodes, "_v", "left")
    line = F.array_sort(F.collect_list(F.struct("_at", "_v", F.coalesce("_node", F.lit(False)).alias("_node"))))
    marked = placed.groupBy(*RING).agg(line.alias("_l"))
    cut = cut_ring(F.transform("_l", lambda v: v["_v"]), F.transform("_l", lambda v: v["_node"]))
    used = marked.select(*RING, cut.alias("_arcs")).select(*RING, F.size("_arcs").alias("_n"), F.posexplode("_arcs").alias("_pos", "_arc"))
    keys = [F.xxhash64("_arc.path").alias("_k1"), F.xxhash64(F.lit(1), "_arc.path").alias("_k2")]
    used = written(used.select(*RING, "_n", "_pos", *keys, "_arc.flipped", "_arc.path"), "arcs")

    arcs = used.groupBy("_k1", "_k2").agg(F.first("path").alias("path"), F.min("_n").alias("_fewest"))
    arcs = arcs.select("_k1", "_k2", simplify_arc(F.col("path"), F.lit(float(tolerance)), F.col("_fewest")).alias("_simple"))
    joined = used.select(*RING, "_pos", "_k1", "_k2", "flipped").join(arcs, ["_k1", "_k2"])
    way = F.when(F.col("flipped"), F.reverse("_simple")).otherwise(F.col("_simple"))
    pieces = joined.select(*RING, F.struct("_pos", F.slice(way, 1, F.size(way) - 1).alias("p")).alias("_piece"))
    built = pieces.groupBy(*RING).agg(F.flatten(F.transform(F.array_sort(F.collect_list("_piece")), lambda p: p["p"])).alias("_p"))
    closed = built.select(*RING, F.concat("_p", F.slice("_p", 1, 1)).alias("_p"))
    whole = _gathered(_gathered(closed, ["_feature", "_part"], "_ring"), ["_feature"], "_part")
    new = whole.join(shapes.select("_feature", "_kind"), "_feature").select("_feature", geometry(F.col("_kind"), F.col("_p")).alias("_new"))
    result = rows.join(new, "_feature", "left").withColumn(GEOM, F.coalesce("_new", GEOM)).drop("_feature", "_new")
    return layer.with_df(with_box(result.select(*layer.df.columns)), boxes=False)


def _gathered(rows: DataFrame, by: list[str], place: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(place, "_p"))), lambda r: r["_p"]).alias("_p"))
