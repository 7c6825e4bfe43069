"""Closed rings and polygons from a table of directed boundary pieces.

A boundary may be far longer than a task can hold, so it stays a table until the last step. Every piece (x1, y1, x2, y2), with
the interior on its left, first finds its successor; a successor table is a set of cycles. Pointer doubling then gives every
piece the smallest piece of its cycle (the ring) and its distance to it (the place in the ring) in a number of joins that
grows with the logarithm of the longest ring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions import coords
from geoloom.layer import GEOM, Layer, geometry, with_box
from geoloom.operators.joins import spatial_pairs
from geoloom.sources.place import written

#: Ends of pieces meet in steps of this many degrees; ends in neighbouring steps still meet.
STEP = 1e-9
HASH = "xxhash64(x1, y1, x2, y2)"


def successors(pieces: DataFrame) -> DataFrame:
    """(piece, next, x1, y1, x2, y2) of directed pieces without repeats.

    Where several pieces leave a node, a piece is followed by the first one clockwise from the way it came, so parts that
    touch in one point become rings of their own. Ways round a node are ordered in one window, so a node of many
    pieces costs its size and no pairs. Pieces whose end no other begins at have a null ``next``.
    """
    rows = pieces.select("x1", "y1", "x2", "y2").distinct().withColumn("piece", F.expr(HASH))
    ways = rows.select(
        "piece",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("ends"), F.col("x1").alias("x"), F.col("y1").alias("y"), _angle("x1", "y1", "x2", "y2").alias("angle")),
                F.struct(F.lit(1).alias("ends"), F.col("x2").alias("x"), F.col("y2").alias("y"), _angle("x2", "y2", "x1", "y1").alias("angle")),
            )
        ).alias("w"),
    ).select("piece", "w.*")
    ways = written(ways.withColumn("node", _node("x", "y")), "ways")
    # A node without both a beginning and an end was split by rounding: its ways go to the smallest node nearby.
    odd = ways.groupBy("node").agg(F.sum(F.col("ends") * 2 - 1).alias("_more")).where("_more <> 0")
    moved = ways.join(odd, "node", "left_semi").select("node", "x", "y").distinct()
    if not moved.isEmpty():
        near = moved.select("node", F.explode(_nodes_around("x", "y")).alias("other"))
        target = near.join(moved.select(F.col("node").alias("other")).distinct(), "other").groupBy("node").agg(F.min("other").alias("_to"))
        ways = ways.join(target, "node", "left").withColumn("node", F.coalesce("_to", "node")).drop("_to")
    clockwise = Window.partitionBy("node").orderBy(F.col("angle").desc(), "ends", "piece")
    leaves = F.when(F.col("ends") == 0, F.col("piece"))
    after = F.first(leaves, ignorenulls=True).over(clockwise.rowsBetween(1, Window.unboundedFollowing))
    wrapped = F.first(leaves, ignorenulls=True).over(clockwise.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    follow = ways.withColumn("next", F.coalesce(after, wrapped)).where("ends = 1").select("piece", "next")
    return rows.join(follow, "piece").select("piece", "next", "x1", "y1", "x2", "y2")


def _angle(x1: str, y1: str, x2: str, y2: str) -> Column:
    return F.atan2(F.col(y2) - F.col(y1), F.col(x2) - F.col(x1))


def _node(x: str, y: str) -> Column:
    return F.struct(F.round(F.col(x) / STEP).cast("long").alias("i"), F.round(F.col(y) / STEP).cast("long").alias("j"))


def _nodes_around(x: str, y: str) -> Column:
    node = _node(x, y)
    return F.array(*[F.struct((node["i"] + i).alias("i"), (node["j"] + j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])


def ranked(follow: DataFrame) -> DataFrame:
    """(piece, ring, ahead) for every piece of a cycle of (piece, next): the cycle's smallest piece, and how many steps lie
    between the piece and that one.

    Round k joins each piece's window of 2**k pieces to the window that follows it. When a round changes no window's smallest
    piece, every window has met its ring's. Pieces on no cycle (a next is null somewhere ahead) are left out.
    """
    state = written(follow.where("next is not null").select("piece", "next", F.col("piece").alias("low"), F.lit(0).cast("long").alias("ahead")), "ranks")
    step, rows = 1, state.count()
    while True:
        beyond = state.select(F.col("piece").alias("next"), F.col("next").alias("_next"), F.col("low").alias("_low"), F.col("ahead").alias("_ahead"))
        lower = F.col("_low") < F.col("low")
        joined = state.join(beyond, "next").select(
            "piece",
            F.col("_next").alias("next"),
            F.least("low", "_low").alias("low"),
            F.when(lower, F.col("_ahead") + step).otherwise(F.col("ahead")).alias("ahead"),
            lower.alias("changed"),
        )
        state = written(joined, "ranks")
        changed, left = state.agg(F.count_if("changed"), F.count("*")).first()
        # A join that lost rows met an open chain; the rest goes on until nothing changes.
        if not changed and left == rows:
            return state.select("piece", F.col("low").alias("ring"), "ahead")
        state, step, rows = state.drop("changed"), step * 2, left


def rings(pieces: DataFrame) -> DataFrame:
    """(ring, ring_area, boundary_length, n_vertices, path): the closed rings of directed pieces; the area (degrees squared) is
    positive where the interior lies inside, negative for holes. ``path`` begins at the ring's smallest piece and ends there."""
    follow = written(successors(pieces), "successors")
    placed = ranked(follow.select("piece", "next")).join(follow.drop("next"), "piece")
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    # The smallest piece comes first (0 steps ahead), then those that have the most steps left.
    order = F.when(F.col("ahead") == 0, F.lit(-(1 << 62))).otherwise(-F.col("ahead"))
    found = placed.groupBy("ring").agg(
        F.sum((x1 * y2 - x2 * y1) / 2).alias("ring_area"),
        F.sum(coords.planar(x2 - x1, y2 - y1)).alias("boundary_length"),
        F.count("*").alias("n_vertices"),
        F.array_sort(F.collect_list(F.struct(order.alias("o"), x1.alias("x"), y1.alias("y")))).alias("_v"),
    )
    path = F.transform("_v", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y")))
    closed = F.concat(path, F.slice(path, 1, 1))
    return found.select("ring", "ring_area", "boundary_length", "n_vertices", closed.alias("path"))


def polygons(pieces: DataFrame, **options) -> Layer:
    """The polygons that directed pieces bound, as a layer with columns part, part_area, boundary_length, n_vertices and n_holes.

    A ring with its interior inside is a shell; a hole goes to the smallest shell that holds it, found by the spatial join of
    one point of the hole with the shells.
    """
    found = written(rings(pieces), "rings")
    kept = [F.col("ring").alias("part"), "ring_area", "boundary_length", "n_vertices", "path"]
    shells = found.where("ring_area > 0").select(*kept)
    shell_layer = Layer(with_box(shells.withColumn(GEOM, geometry("Polygon", F.array(F.array(F.col("path")))))).drop("path"), "part", "polygon")
    middle = [((F.col("path")[0][c] + F.col("path")[1][c]) / 2).alias(c) for c in ("x", "y")]
    holes = found.where("ring_area < 0").withColumns({"x": middle[0], "y": middle[1]})
    spots = Layer(holes.select("ring", geometry("Point", F.array(F.array(F.array(F.struct("x", "y"))))).alias(GEOM), F.col("x").alias("xmin"), F.col("y").alias("ymin"), F.col("x").alias("xmax"), F.col("y").alias("ymax")), "ring", "point")
    inside = spatial_pairs(spots, shell_layer, "intersects", left_columns=[], right_columns=["ring_area"], **options)
    owner = inside.groupBy(F.col("l_ring").alias("ring")).agg(F.min_by("r_part", F.struct("r_ring_area", "r_part")).alias("part"))
    taken = holes.join(owner, "ring").groupBy("part").agg(
        F.sum("ring_area").alias("_area"),
        F.sum("boundary_length").alias("_length"),
        F.sum("n_vertices").alias("_vertices"),
        F.count("*").alias("n_holes"),
        F.transform(F.array_sort(F.collect_list(F.struct("ring", "path"))), lambda h: h["path"]).alias("_holes"),
    )
    none = F.lit(0)
    whole = shells.join(taken, "part", "left").select(
        "part",
        (F.col("ring_area") + F.coalesce("_area", none)).alias("part_area"),
        (F.col("boundary_length") + F.coalesce("_length", none)).alias("boundary_length"),
        (F.col("n_vertices") + F.coalesce("_vertices", none)).alias("n_vertices"),
        F.coalesce("n_holes", none).alias("n_holes"),
        geometry("Polygon", F.array(F.concat(F.array("path"), F.coalesce("_holes", F.array().cast(found.select(F.array("path")).schema[0].dataType))))).alias(GEOM),
    )
    return Layer(with_box(whole), "part", "polygon")
