"""Hard-negative mining (operator 11) with a multiway hyperplane tree of distance ranges.

Vectors become integer vectors; rows of one label and vector are one class, of which the smallest ids are enough. A tree is
fitted on a bounded sample: each node has up to DEGREE split points, far from one another, and a vector goes to the
nearest one, down to a leaf. All classes are then indexed: for every subtree of a node the node keeps the smallest and
largest distance to each of its split points, over all vectors of the subtree, and the subtree's range of norms.

A window of scores is, by the norms, an annulus of distances around the anchor. An anchor's distance to a split point and the
ranges bound the distances to each sibling subtree; those that do not meet the annulus are eliminated, with all below.
An anchor meets its own leaf first, which narrows the window (for positives: what the sixth best has; for negatives: the
third best inside each positive's window), then the leaves that remain. In a leaf every vector is compared, in blocks, so
the results are exact.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoloom.llm.common import arrow_map, cut, seeded, table
from geoloom.llm.registry import query
from geoloom.operators.spread import spread_join

SAMPLE = 16_384  # vectors the tree is fitted on
DEGREE = 8
CANDIDATES = 5  # sampled vectors per split point, of which distant ones are taken
LEAF_SAMPLE = 512  # sampled vectors of a leaf at least: some 130 leaves at most, as every leaf may be sent every anchor
LEAF = 1024  # vectors expected in a leaf while there are few
BLOCK = 256  # vectors, or anchors, compared at once
SHARE = 64  # blocks of a leaf that meet an anchor in one task
LONGEST = 1 << 54  # squared length of an integer vector; 100 times a score must fit in 64 bits
NEVER = -(1 << 62)


def integer_vectors(rows: DataFrame, anchor: Column, id: str, embedding: str, label: str, scale: int) -> DataFrame:
    """(vec_id, label, anchor, q, norm): q is floor(scale * x) of every component, packed, norm its squared length. Rows
    without id, label or vector, with a null or non-finite component or too long a vector are left out."""

    def run(batch: pa.RecordBatch):
        column = batch.column(3)
        flat = np.floor(scale * column.values.cast(pa.float64()).to_numpy(zero_copy_only=False))
        at = np.asarray(column.offsets)
        kept, found, norms = [], [], []
        for k, (a, b) in enumerate(zip(at[:-1], at[1:])):
            x = flat[a:b]
            if np.isfinite(x).all() and (np.abs(x) < 1 << 30).all() and (x * x).sum() < LONGEST:
                kept.append(k)
                found.append(packed(x))
                norms.append(int((x.astype(np.int64) ** 2).sum()))
        taken = [batch.column(k).take(pa.array(kept, pa.int64())) for k in range(3)]
        yield pa.RecordBatch.from_arrays([*taken, pa.array(found, pa.binary()), pa.array(norms, pa.int64())], ["vec_id", "label", "anchor", "q", "norm"])

    narrow = rows.select(F.col(id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(embedding).cast("array<double>").alias("e"))
    return arrow_map(narrow.where("vec_id is not null and label is not null and e is not null"), run, "vec_id long, label long, anchor boolean, q binary, norm long")


def packed(x: np.ndarray) -> bytes:
    """Integers in the narrower of two widths that holds them all, after a byte that names it; equal vectors are equal."""
    narrow = bool((np.abs(x) < 1 << 15).all())
    return (b"2" + x.astype("<i2").tobytes()) if narrow else (b"4" + x.astype("<i4").tobytes())


def matrix(column: pa.Array) -> np.ndarray:
    """The packed vectors of a binary column as rows of doubles; shorter ones end in zeros."""
    found = [np.frombuffer(x, "<i2" if x[:1] == b"2" else "<i4", offset=1) for x in column.to_pylist()]
    width = max((len(x) for x in found), default=0)
    out = np.zeros((len(found), width))
    for row, x in zip(out, found):
        row[: len(x)] = x
    return out


def scores(a: np.ndarray, b: np.ndarray, norm_a: np.ndarray, norm_b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles, where no partial sum can pass 2**53, else in integers."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if float(norm_a.max(initial=0)) ** 0.5 * float(norm_b.max(initial=0)) ** 0.5 < 1 << 52:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def distances(a: np.ndarray, b: np.ndarray, norm_a: np.ndarray, norm_b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, norm_a[:, None].astype(float) + norm_b[None, :] - 2.0 * scores(a, b, norm_a, norm_b)))


@dataclass
class Node:
    points: np.ndarray
    norms: np.ndarray
    children: list[int]  # a node's number, or -1 - a leaf's
    near: np.ndarray = field(default=None)  # [point, child]: smallest distance
    far: np.ndarray = field(default=None)  # largest
    short: np.ndarray = field(default=None)  # [child]: smallest norm
    long: np.ndarray = field(default=None)


class Tree:
    """``nodes``, the root first, and the number of leaves; ``sizes`` counts each leaf's classes once all are indexed."""

    def __init__(self, x: np.ndarray, norms: np.ndarray, leaf: int):
        self.nodes: list[Node] = []
        self.leaves = 0
        self.sizes: list[int] = []
        self._draw = np.random.default_rng(17)
        if len(x):
            todo = [(np.arange(len(x)), None, 0)]
            while todo:
                rows, parent, place = todo.pop(0)
                points = self._points(x, norms, rows) if parent is None or len(rows) > leaf else rows[:0]
                if parent is not None and len(points) < 2:
                    self.nodes[parent].children[place] = -1 - self.leaves
                    self.leaves += 1
                    continue
                number = len(self.nodes)
                if parent is not None:
                    self.nodes[parent].children[place] = number
                self.nodes.append(Node(x[points], norms[points], [0] * len(points)))
                child = distances(x[rows], x[points], norms[rows], norms[points]).argmin(axis=1)
                todo += [(rows[child == k], number, k) for k in range(len(points))]

    def _points(self, x, norms, rows) -> np.ndarray:
        """Up to DEGREE different vectors of a node's sample, each as far as possible from those before."""
        drawn = self._draw.permutation(rows)[: DEGREE * CANDIDATES]
        away = distances(x[drawn], x[drawn], norms[drawn], norms[drawn])
        chosen = [0]
        while len(chosen) < DEGREE:
            least = away[:, chosen].min(axis=1)
            if least.max(initial=0) <= 0:
                break
            chosen.append(int(least.argmax()))
        return drawn[chosen]

    def descend(self, x: np.ndarray, norms: np.ndarray):
        """(node number, rows, their distances to its points, their children) of every node some rows pass."""
        todo = [(0, np.arange(len(x)))] if len(x) else []
        while todo:
            number, rows = todo.pop()
            node = self.nodes[number]
            away = distances(x[rows], node.points, norms[rows], node.norms)
            child = away.argmin(axis=1)
            yield number, rows, away, child
            for k, next in enumerate(node.children):
                if next >= 0 and (child == k).any():
                    todo.append((next, rows[child == k]))

    def leaf_of(self, x: np.ndarray, norms: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        for number, rows, _, child in self.descend(x, norms):
            to = np.array(self.nodes[number].children)[child]
            out[rows[to < 0]] = -1 - to[to < 0]
        return out

    def ranges(self, ranged) -> None:
        """Take in the ranges of all indexed vectors: rows (node, child, point, near, far, short, long, n)."""
        for node in self.nodes:
            m = len(node.children)
            node.near, node.far = np.full((m, m), np.inf), np.full((m, m), -np.inf)
            node.short, node.long = np.full(m, np.inf), np.full(m, -np.inf)
        self.sizes = [0] * self.leaves
        for r in ranged:
            node = self.nodes[r.node]
            node.near[r.point, r.child], node.far[r.point, r.child] = r.near, r.far
            node.short[r.child], node.long[r.child] = r.short, r.long
            if node.children[r.child] < 0:
                self.sizes[-1 - node.children[r.child]] = r.n

    def visits(self, x: np.ndarray, norms: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that can hold a vector with a score inside one of a row's windows [low, high]."""
        found, todo = [], [(0, np.arange(len(x)))] if len(x) and self.nodes else []
        while todo:
            number, rows = todo.pop()
            node = self.nodes[number]
            away = distances(x[rows], node.points, norms[rows], node.norms)
            slack = 1e-6 * (1 + np.sqrt(norms[rows].astype(float)) + np.sqrt(float(node.norms.max())))
            for k, next in enumerate(node.children):
                if node.long[k] < 0:
                    continue
                least = np.maximum(away - node.far[:, k], node.near[:, k] - away).max(axis=1)
                most = (away + node.far[:, k]).min(axis=1)
                inner = np.sqrt(np.maximum(0.0, norms[rows, None] + node.short[k] - 2.0 * high[rows]))
                outer = norms[rows, None] + node.long[k] - 2.0 * low[rows]
                meets = (low[rows] <= high[rows]) & (outer >= 0) & (most[:, None] + slack[:, None] >= inner)
                meets &= least[:, None] - slack[:, None] <= np.sqrt(np.maximum(0.0, outer))
                alive = rows[meets.any(axis=1)]
                if len(alive) and next >= 0:
                    todo.append((next, alive))
                elif len(alive):
                    found.append((alive, np.full(len(alive), -1 - next)))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(v) for v in zip(*found))


def _fitted(classes: DataFrame, n: int):
    """The tree, with the ranges of all classes, as a broadcast of bounded size."""
    drawn = classes.orderBy(seeded(5, "label", "q")).limit(SAMPLE).select("q", "norm").toArrow()
    sampled = max(1, drawn.num_rows)
    tree = Tree(matrix(drawn.column(0)), drawn.column(1).to_numpy(), max(LEAF_SAMPLE, LEAF * sampled // max(1, n)))
    context = classes.sparkSession.sparkContext
    shape = context.broadcast(tree)

    def run(batch: pa.RecordBatch):
        x, norms = matrix(batch.column(0)), batch.column(1).to_numpy()
        out = []
        for number, rows, away, child in shape.value.descend(x, norms):
            for k in np.unique(child):
                own = child == k
                part = norms[rows[own]]
                for j in range(away.shape[1]):
                    out.append((number, int(k), j, away[own, j].min(), away[own, j].max(), float(part.min()), float(part.max()), int(own.sum())))
        names = ["node", "child", "point", "near", "far", "short", "long", "n"]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*out)], names)

    ranged = arrow_map(classes.select("q", "norm"), run, "node long, child long, point long, near double, far double, short double, long double, n long")
    least = [F.min(c).alias(c) for c in ("near", "short")]
    most = [F.max(c).alias(c) for c in ("far", "long")]
    tree.ranges(ranged.groupBy("node", "child", "point").agg(*least, *most, F.sum("n").alias("n")).collect())
    return context.broadcast(tree)


def _blocks(classes: DataFrame, tree) -> DataFrame:
    """(leaf, share, m): the classes of every leaf in blocks of about BLOCK, SHARE blocks to a share."""

    def run(batch: pa.RecordBatch):
        held = tree.value
        leaf = held.leaf_of(matrix(batch.column(0)), batch.column(1).to_numpy())
        count = np.maximum(1, -(-np.array(held.sizes) // BLOCK))[leaf]
        block = batch.column(4).to_numpy().view(np.uint64) % count.astype(np.uint64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(leaf), pa.array(block.astype(np.int64))], ["q", "norm", "label", "ids", "leaf", "block"])

    placed = arrow_map(classes.select("q", "norm", "label", "ids", F.xxhash64("label", "q").alias("h")), run, "q binary, norm long, label long, ids array<long>, leaf long, block long")
    grouped = placed.groupBy("leaf", "block").agg(F.collect_list(F.struct("q", "norm", "label", "ids")).alias("m"))
    return grouped.select("leaf", F.floor(F.col("block") / SHARE).alias("share"), "m")


ANCHOR = "k1 long, k2 long, label long, norm long, q binary, windows array<struct<p:long,low:long,high:long>>"


def _windows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, p, low, high) of all windows, row by row."""
    at = np.asarray(column.offsets)
    inner = column.values.slice(at[0], at[-1] - at[0])
    row = np.repeat(np.arange(len(column)), np.diff(at))
    return row, *(inner.field(c).to_numpy(zero_copy_only=False) for c in ("p", "low", "high"))


def _visited(anchors: DataFrame, tree, own: bool, blocks: int) -> DataFrame:
    """(leaf, share, a): lists of about BLOCK anchors (see ANCHOR) by the leaves they visit: their own one, or all others that
    the ranges leave."""

    def run(batch: pa.RecordBatch):
        held = tree.value
        x, norms = matrix(batch.column(4)), batch.column(3).to_numpy()
        home = held.leaf_of(x, norms)
        if own:
            row, leaf = np.arange(len(x)), home
        else:
            of, _, low, high = _windows(batch.column(5))
            count = np.bincount(of, minlength=len(x))
            wide = max(1, int(count.max(initial=0)))
            lows, highs = np.zeros((len(x), wide), np.int64), np.full((len(x), wide), -1, np.int64)
            place = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            lows[of, place], highs[of, place] = low, high
            row, leaf = held.visits(x, norms, lows, highs)
            other = leaf != home[row]
            row, leaf = row[other], leaf[other]
        shares = -(-np.maximum(1, -(-np.array(held.sizes) // BLOCK)) // SHARE)
        many = shares[leaf] if len(leaf) else np.zeros(0, np.int64)
        share = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        taken = batch.take(pa.array(np.repeat(row, many), pa.int64()))
        yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(np.repeat(leaf, many).astype(np.int64)), pa.array(share.astype(np.int64))], [*batch.schema.names, "leaf", "share"])

    dealt = anchors.select("k1", "k2", "label", "norm", "q", "windows").repartition(min(blocks, 20_000), "k1")
    visits = arrow_map(dealt, run, f"{ANCHOR}, leaf long, share long")
    return visits.groupBy("leaf", "share", F.pmod("k1", F.lit(blocks)).alias("b")).agg(F.collect_list(F.struct("k1", "k2", "label", "norm", "q", "windows")).alias("a"))


def _met(visits: DataFrame, blocks: DataFrame, k: int, same_label: bool) -> DataFrame:
    """(k1, k2, p, score, vec_id, same): for each window of a visiting anchor the k first rows of each block inside it, of the
    anchor's label or of any other; ``same`` tells a row of the anchor's own class."""

    def run(batch: pa.RecordBatch):
        for i in range(batch.num_rows):
            a, m = batch.column(0).slice(i, 1).flatten(), batch.column(1).slice(i, 1).flatten()
            ids = m.field("ids")
            first = np.asarray(ids.values)[np.asarray(ids.offsets)[:-1]]
            order = np.argsort(first, kind="stable")  # ties of a score are met by id
            m = m.take(pa.array(order))
            key, norm_a, norm_m = a.field("label").to_numpy(), a.field("norm").to_numpy(), m.field("norm").to_numpy()
            score = scores(matrix(a.field("q")), matrix(m.field("q")), norm_a, norm_m)
            alike = key[:, None] == m.field("label").to_numpy()[None, :]
            of, p, low, high = _windows(a.field("windows"))
            here = score[of]
            w, col = np.nonzero((alike if same_label else ~alike)[of] & (here >= low[:, None]) & (here <= high[:, None]))
            value = here[w, col]
            best = np.lexsort((col, -value, w))
            w, col, value = w[best], col[best], value[best]
            rank = np.arange(len(w)) - np.searchsorted(w, w)
            w, col, value = w[rank < k], col[rank < k], value[rank < k]
            row = of[w]
            same = alike[row, col] & (value == norm_a[row]) & (value == norm_m[col])
            columns = [a.field("k1").take(pa.array(row)), a.field("k2").take(pa.array(row)), pa.array(p[w]), pa.array(value), m.field("ids").take(pa.array(col)), pa.array(same)]
            yield pa.RecordBatch.from_arrays(columns, ["k1", "k2", "p", "score", "ids", "same"])

    pairs = visits.join(blocks.hint("merge"), ["leaf", "share"]).select("a", "m")  # neither side is small
    found = arrow_map(pairs, run, "k1 long, k2 long, p long, score long, ids array<long>, same boolean")
    return found.select("k1", "k2", "p", "score", F.explode("ids").alias("vec_id"), "same")


def _first(rows: DataFrame, k: int) -> DataFrame:
    """The k first rows of each (k1, k2, p), with their ``rank``: higher scores, then smaller ids."""
    by = Window.partitionBy("k1", "k2", "p").orderBy(F.col("score").desc(), "vec_id", "same")
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _searched(anchors: DataFrame, blocks: DataFrame, tree, k: int, same_label: bool, n: int) -> DataFrame:
    """The k first rows inside each window of the anchors: those of the own leaf narrow the windows for the other leaves."""
    at_home = cut(_first(_met(_visited(anchors, tree, True, n), blocks, k, same_label), k))
    full = at_home.where(F.col("rank") == k).groupBy("k1", "k2").agg(F.map_from_entries(F.collect_list(F.struct("p", "score"))).alias("_full"))
    narrowed = F.transform("windows", lambda w: F.struct(w["p"].alias("p"), F.coalesce(F.try_element_at("_full", w["p"]), w["low"]).alias("low"), w["high"].alias("high")))
    narrower = cut(anchors.join(full, ["k1", "k2"], "left").withColumn("windows", narrowed).drop("_full"))
    away = _met(_visited(narrower, tree, False, n), blocks, k, same_label)
    return cut(_first(at_home.drop("rank").unionByName(away), k))


def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row that ``anchor`` chooses and each
    of its ``positives`` first other rows of the same label, the ``negatives`` first rows of other labels whose score is from
    ``low`` to ``high`` per cent of the positive's. Scores are inner products of floor(scale * x); higher ones come first.

    Null ids, labels and vectors and vectors with null or non-finite components take no part, nor do integer vectors of a
    squared length of 2**54 or more, whose scores would not fit. An empty vector scores 0 with all; of vectors of different
    lengths the shorter one counts as ending in zeros. Ties of a score go to the smaller id. Rows that repeat id, label and
    vector are one row; rows that share an id only are rows of their own. A negative positive score has no negatives. An
    empty table, or one without anchors, gives an empty result; other columns are ignored, whatever their names.

    Results are exact. Of rows with one label and vector only the smallest ids travel, so copies cannot make a hot leaf; a leaf of
    many different vectors is dealt into blocks. The tree holds at most SAMPLE vectors. How much it eliminates depends on
    the vectors; an anchor visits every leaf at worst, so the work then grows with anchors times rows.
    """
    rows = cut(integer_vectors(vectors, anchor, id, embedding, label, scale))
    keys = [F.xxhash64("label", "q").alias("k1"), F.xxhash64(F.lit(1), "q", "label").alias("k2")]
    smallest = Window.partitionBy("label", "q").orderBy("vec_id")
    members = rows.select("label", "q", "norm", "vec_id").distinct().withColumn("_n", F.row_number().over(smallest)).where(F.col("_n") <= positives + 1)
    classes = cut(members.groupBy("label", "q").agg(F.first("norm").alias("norm"), F.array_sort(F.collect_list("vec_id")).alias("ids")))
    anchors = cut(rows.where("anchor").select("vec_id", "label", "norm", "q", *keys).distinct())
    kinds = cut(anchors.select("k1", "k2", "label", "norm", "q").distinct())
    n, n_blocks = classes.count(), -(-max(1, kinds.count()) // BLOCK)
    tree = _fitted(classes, n)
    blocks = cut(_blocks(classes, tree))

    everything = F.array(F.struct(F.lit(0).cast("long").alias("p"), F.lit(NEVER).cast("long").alias("low"), F.lit(-NEVER).cast("long").alias("high")))
    best = _searched(kinds.withColumn("windows", everything), blocks, tree, positives + 1, True, n_blocks)
    kind = F.struct("k1", "k2").alias("k")
    own = anchors.select(kind, F.col("vec_id").alias("anchor_id"))
    others = spread_join(own, best.select(kind, "score", "vec_id", "same"), "k", F.xxhash64("anchor_id"), F.xxhash64("vec_id"))
    in_order = Window.partitionBy("anchor_id", "k").orderBy(F.col("score").desc(), "vec_id", "same")
    chosen = others.where("not (same and vec_id = anchor_id)").withColumn("_n", F.row_number().over(in_order)).where(F.col("_n") <= positives)
    pairs = cut(chosen.select("anchor_id", "k.k1", "k.k2", F.col("vec_id").alias("positive_id"), F.col("score").alias("p")))

    bounds = F.struct("p", F.expr(f"(p * {low} + 99) div 100").alias("low"), F.expr(f"p * {high} div 100").alias("high"))
    windows = pairs.where("p >= 0").select("k1", "k2", "p").distinct().groupBy("k1", "k2").agg(F.collect_list(bounds).alias("windows"))
    hard = _searched(cut(kinds.join(windows, ["k1", "k2"])), blocks, tree, negatives, False, n_blocks)
    window = F.struct("k1", "k2", "p").alias("k")
    negative = hard.select(window, F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    mined = spread_join(pairs.select("anchor_id", "positive_id", window), negative, "k", F.xxhash64("anchor_id", "positive_id"), F.xxhash64("negative_id"))
    return mined.select("anchor_id", "positive_id", "rank", "negative_id", F.col("k.p").alias("positive_score"), "negative_score")


_SQL = """
WITH good AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM good a JOIN good b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS p FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, vec_id AS negative_id, p AS positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id) WHERE NOT same AND 50 * p <= 100 * score AND 100 * score <= 95 * p
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 3
"""


@query("op11_hard_negatives", _SQL)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end"))
    return hard_negatives(vectors, F.col("vec_id") % 50 == 0)
