"""Embedding near-dedup (operator 8): NN-descent on a neighbour graph of distinct vectors.

Equal vectors merge at once. Random hyperplane buckets give every vector a first list of NEIGHBOURS; each round
then compares the neighbours (both ways) of every vector with one another, as neighbours of neighbours are
likely near, and keeps the nearest. An audit compares sampled query vectors with all vectors; while it misses too many
links, new buckets and rounds follow, and in the end a comparison of all vectors in blocks. A list full of links is saturated: it may hide further ones. Those
inside its component are found by comparing the whole component block by block; those that leave it by new lists
over the saturated vectors of other components only, again and again until no list holds a link. Only links of cosine
THRESHOLD or more in double precision are kept.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import arrow_map, components, cut, seeded, table
from geoloom.llm.registry import query

THRESHOLD = 0.9
NEIGHBOURS = 6
TABLES = 8
BUCKET = 64  # vectors expected in a bucket
BLOCK = 256  # vectors compared at once in a task
ROUNDS = 3
AUDIT = 256  # query vectors of an audit's first sample
ENOUGH = 64  # linked query vectors an audit needs
QUERIES = 2048  # query vectors broadcast at once
RECALL = 0.98
WAVES = 4  # of buckets and rounds; if recall is still lower then, all vectors are compared
WIDE = 4096  # vectors in a block of that comparison


def _matrix(column: pa.Array, kind) -> np.ndarray:
    """The rows of a binary column, all of one length, as a matrix."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].view(kind).reshape(len(column), -1) if len(column) else np.zeros((0, 1), kind)


def unit_vectors(rows: DataFrame, id: str, embedding: str) -> DataFrame:
    """(vec_id, dim, vec): vec is the unit vector in doubles, null where the vector is null, empty, zero or not finite."""

    def run(batch: pa.RecordBatch):
        found, dims = [], []
        column = batch.column(1)
        flat = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
        valid, at = column.is_valid().to_numpy(zero_copy_only=False), np.asarray(column.offsets)
        for ok, a, b in zip(valid, at[:-1], at[1:]):
            x = flat[a:b] if ok else flat[:0]
            top = np.abs(x).max(initial=0.0)
            if not np.isfinite(x).all() or not top > 0:
                found.append(None)
            else:
                x = x / top + 0.0
                found.append((x / np.sqrt((x * x).sum())).tobytes())
            dims.append(len(x))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims, pa.int32()), pa.array(found, pa.binary())], ["vec_id", "dim", "vec"])

    narrow = rows.select(F.col(id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"))
    return arrow_map(narrow, run, "vec_id long, dim int, vec binary")


def _top(pairs: DataFrame, k: int) -> DataFrame:
    """(a, near): the k nearest b of every a, nearest first, as (sim, b)."""
    best = pairs.groupBy("a", "b").agg(F.max("sim").alias("sim")).groupBy("a")
    return best.agg(F.slice(F.sort_array(F.collect_list(F.struct("sim", "b")), asc=False), 1, k).alias("near"))


def _compare(groups: DataFrame, k: int) -> DataFrame:
    """(a, b, sim) of each member's k nearest others within its group, if nearer than its ``least``; a group's ``m`` is a
    list of (id, least, vec)."""

    def run(batch: pa.RecordBatch):
        column = batch.column(0)
        at, inner = np.asarray(column.offsets), column.values
        ids, least, x = inner.field("id").to_numpy(), inner.field("least").to_numpy(), _matrix(inner.field("vec"), np.float32)
        a, b, sims = [], [], []
        for s, e in zip(at[:-1], at[1:]):
            if e - s < 2:
                continue
            sim = x[s:e] @ x[s:e].T
            np.fill_diagonal(sim, -2)
            n = min(k, e - s - 1)
            near = np.argpartition(-sim, n - 1, axis=1)[:, :n]
            value = np.take_along_axis(sim, near, 1)
            row, col = np.nonzero(value > least[s:e, None])
            a.append(ids[s + row])
            b.append(ids[s + near[row, col]])
            sims.append(value[row, col])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b)), pa.array(np.concatenate(sims))], ["a", "b", "sim"])

    return arrow_map(groups, run, "a long, b long, sim float").where("a <> b")


def _grouped(rows: DataFrame, by: list[str]) -> DataFrame:
    """Lists of about BLOCK members (id, least, vec) of each group; a larger group is dealt into several at random."""
    sizes = rows.groupBy(*by).agg(F.ceil(F.count("*") / BLOCK).alias("_blocks")).where(F.col("_blocks") > 1)
    dealt = rows.join(sizes, by, "left").withColumn("_block", F.when(F.col("_blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("id", *by), F.col("_blocks"))))
    return dealt.groupBy(*by, "_block").agg(F.collect_list(F.struct("id", "least", "vec")).alias("m")).where(F.size("m") > 1).select("m")


def _bits(n: int) -> int:
    return max(0, int(np.log2(max(1, n / BUCKET))))


def _tables(bits: int) -> int:
    """So many tables that a pair at THRESHOLD shares a bucket of one with probability RECALL, TABLES at least."""
    same = (1 - np.arccos(THRESHOLD) / np.pi) ** bits
    return TABLES if same >= 1 else max(TABLES, int(np.ceil(np.log(1 - RECALL) / np.log(1 - same))))


def _codes(rows: DataFrame, dim: int, bits: int, tables: int, seed: int) -> DataFrame:
    """(t, code, id, label, vec): the bucket of each row (id, label, vec) in ``tables`` random-hyperplane tables."""

    def run(batch: pa.RecordBatch):
        x = _matrix(batch.column(2), np.float32)
        for t in range(tables):
            plane = np.random.default_rng([seed, t, dim]).normal(size=(dim, max(1, bits))).astype(np.float32)
            code = ((x @ plane > 0) @ (1 << np.arange(max(1, bits)))).astype(np.int64) if bits else np.zeros(len(x), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(code), *batch.columns], ["t", "code", "id", "label", "vec"])

    return arrow_map(rows.select("id", "label", "vec"), run, "t int, code long, id long, label long, vec binary")


def _bucketed(vectors: DataFrame, dim: int, n: int, seed: int) -> DataFrame:
    """Neighbour candidates from random-hyperplane tables with about BUCKET vectors to a bucket."""
    rows = _codes(vectors.withColumn("label", F.col("id")), dim, _bits(n), _tables(_bits(n)), seed)
    return _compare(_grouped(rows.withColumn("least", F.lit(-2.0).cast("float")), ["t", "code"]), NEIGHBOURS)


def _across(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): links between members (t, code, id, label, vec) of one bucket with different labels; each member that has such
    links within a pair of blocks gives its NEIGHBOURS nearest, so none is left without one.

    A bucket is dealt into blocks of about ``block`` members and all pairs of its blocks are compared. A label of a block's
    size or more has blocks of its own, which are not compared with one another.
    """
    by = ["t", "code"]
    sizes = rows.groupBy(*by, "label").agg(F.count("*").alias("n"))
    groups = sizes.groupBy(*by).agg(F.count("*").alias("labels"), F.sum(F.when(F.col("n") < block, F.col("n")).otherwise(0)).alias("rest")).where("labels > 1")
    sizes = cut(sizes.join(groups, by))
    large = sizes.where(F.col("n") >= block).select(*by, "label", F.ceil(F.col("n") / block).alias("parts"))
    mixed = F.col("parts").isNull()
    rest = F.greatest(F.lit(1), F.ceil(F.col("rest") / block))
    place = F.when(mixed, F.pmod(F.xxhash64("label"), rest)).otherwise(F.xxhash64("label", F.pmod(F.xxhash64("id"), F.col("parts"))))
    dealt = rows.join(groups, by).join(large, [*by, "label"], "left").select(*by, place.alias("block"), F.when(~mixed, F.col("label")).alias("own"), "id", "label", "vec")
    small = sizes.where(F.col("n") < block).select(*by, F.pmod(F.xxhash64("label"), rest).alias("block"), F.lit(None).cast("long").alias("own"))
    pieces = large.select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "label")
    blocks = cut(small.unionByName(pieces.select(*by, F.xxhash64("label", "part").alias("block"), F.col("label").alias("own"))).distinct())
    x, y = blocks.toDF(*by, "x", "xo"), blocks.toDF(*by, "y", "yo")
    pairs = x.join(y, by).where("x < y and (xo is null or yo is null or xo <> yo) or x = y and xo is null").select(*by, "x", "y")
    left = dealt.join(pairs.withColumn("block", F.col("x")), [*by, "block"]).withColumn("side", F.lit(0))
    right = dealt.join(pairs.withColumn("block", F.col("y")), [*by, "block"]).withColumn("side", F.lit(1))
    members = left.unionByName(right).groupBy(*by, "x", "y").agg(F.collect_list(F.struct("side", "id", "label", "vec")).alias("m")).select("m")

    def run(batch: pa.RecordBatch):
        column = batch.column(0)
        at, inner = np.asarray(column.offsets), column.values
        side, ids, label = (inner.field(k).to_numpy() for k in ("side", "id", "label"))
        v = _matrix(inner.field("vec"), np.float32)
        a, b = [], []
        for s, e in zip(at[:-1], at[1:]):
            own, others = s + np.flatnonzero(side[s:e] == 0), s + np.flatnonzero(side[s:e] == 1)
            sim = v[own] @ v[others].T
            sim[label[own][:, None] == label[others]] = -2
            k = min(NEIGHBOURS, len(others))
            near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
            row, col = np.nonzero(np.take_along_axis(sim, near, 1) >= THRESHOLD - 1e-4)
            a.append(ids[own[row]])
            b.append(ids[others[near[row, col]]])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    found = arrow_map(members, run, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _labelled(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, label, vec): the component of each vector, itself where it has none."""
    return vectors.join(labels.toDF("id", "label"), "id", "left").select("id", F.coalesce("label", "id").alias("label"), "vec")


def _enlarged(edges: DataFrame, near: DataFrame, vectors: DataFrame, classes: DataFrame, dim: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(edges, component of each linked vector) with the links that saturated lists hide between components."""
    full = near.where((F.size("near") >= NEIGHBOURS) & (F.element_at("near", -1)["sim"] >= THRESHOLD - 1e-4))
    full = cut(vectors.join(full.select(F.col("a").alias("id")), "id"))
    n, labels = full.count(), cut(components(edges))
    for turn in count() if n else ():
        codes = _codes(_labelled(full, labels), dim, _bits(n), _tables(_bits(n)), 1000 * (seed + 1) + turn)
        more = cut(_exact(_across(codes), classes))
        if more.isEmpty():
            break
        edges = cut(edges.unionByName(more))
        labels = cut(components(edges))
    return edges, labels


def _finished(edges: DataFrame, vectors: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """Component of each linked vector, all vectors of different components compared, in blocks, until no link is left."""
    block = int(np.clip(n // 16, BLOCK, WIDE))
    while True:
        labels = cut(components(edges))
        rows = _labelled(vectors, labels).select(F.lit(0).alias("t"), F.lit(0).cast("long").alias("code"), "id", "label", "vec")
        more = cut(_exact(_across(rows, block), classes))
        if more.isEmpty():
            return labels
        edges = cut(edges.unionByName(more))


def _close(near: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): the links among the lists' entries."""
    close = near.select("a", F.explode("near").alias("x")).where(F.col("x.sim") >= THRESHOLD - 1e-4)
    return _exact(close.select(F.least("a", "x.b").alias("a"), F.greatest("a", "x.b").alias("b")).distinct(), classes)


def _descend(near: DataFrame, vectors: DataFrame) -> tuple[DataFrame, int]:
    """One round: (new lists, entries that entered)."""
    one_way = near.select("a", F.explode("near.b").alias("b"))
    member = one_way.unionByName(one_way.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(near.select("a", F.col("a").alias("b"))).distinct()
    least = near.select(F.col("a").alias("id"), F.when(F.size("near") < NEIGHBOURS, F.lit(-2.0)).otherwise(F.element_at("near", -1)["sim"]).cast("float").alias("least"))
    known = vectors.select("id", "vec").join(least, "id")
    rows = member.select(F.col("a").alias("u"), F.col("b").alias("id")).join(known, "id")
    found = _compare(_grouped(rows, ["u"]), NEIGHBOURS)
    old = near.select("a", F.explode("near").alias("x")).select("a", "x.b", "x.sim", F.lit(1).alias("old"))
    both = old.unionByName(found.withColumn("old", F.lit(0))).groupBy("a", "b").agg(F.max("sim").alias("sim"), F.max("old").alias("old"))
    lists = cut(both.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct("sim", "b", "old")), asc=False), 1, NEIGHBOURS).alias("x")))
    entered = lists.select(F.sum(F.size(F.filter("x", lambda v: v["old"] == 0)))).first()[0] or 0
    return lists.select("a", F.transform("x", lambda v: F.struct(v["sim"].alias("sim"), v["b"].alias("b"))).alias("near")), entered


def _exact(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose cosine in doubles reaches the threshold."""

    def run(batch: pa.RecordBatch):
        same = (_matrix(batch.column(2), np.float64) * _matrix(batch.column(3), np.float64)).sum(1) >= THRESHOLD
        yield batch.select([0, 1]).filter(pa.array(same))

    a, b = classes.select(F.col("id").alias("a"), F.col("vec").alias("va")), classes.select(F.col("id").alias("b"), F.col("vec").alias("vb"))
    return arrow_map(pairs.join(a, "a").join(b, "b").select("a", "b", "va", "vb"), run, "a long, b long")


def _recalls(classes: DataFrame, labels: DataFrame, chosen: DataFrame) -> np.ndarray:
    """For each of the ``chosen`` query vectors (id, vec) that has true links, the share of them in its own component."""
    got = chosen.select("id", "vec").collect()
    if not got:
        return np.zeros(0)
    shared = classes.sparkSession.sparkContext.broadcast((np.array([r[0] for r in got]), np.stack([np.frombuffer(r[1], np.float64) for r in got])))

    def run(batch: pa.RecordBatch):
        ids, q = shared.value
        mine, label = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        i, j = np.nonzero(_matrix(batch.column(1), np.float64) @ q.T >= THRESHOLD)
        keep = mine[i] != ids[j]
        pairs, n = np.unique(np.stack([ids[j][keep], label[i][keep]]), axis=1, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.array(n.astype(np.int64))], ["id", "label", "n"])

    rows = _labelled(classes, labels).select("id", "vec", "label")
    links = arrow_map(rows, run, "id long, label long, n long")
    own = _labelled(chosen, labels).select("id", F.col("label").alias("own"))
    each = links.join(own, "id").groupBy("id").agg((F.sum(F.when(F.col("label") == F.col("own"), F.col("n")).otherwise(0)) / F.sum("n")).alias("r"))
    found = np.array([r[0] for r in each.select("r").collect()], float)
    shared.destroy()
    return found


def audit(classes: DataFrame, labels: DataFrame, seed: int = 9) -> float:
    """Estimated recall: the share of a linked vector's true links that lie in its component, each vector counting alike, however
    many links it has; the lower of the averages within and outside the largest component (1 where nothing is linked).

    Outside it, vectors with and without a component are sampled apart, as the latter are linked only if all their
    links were missed. Their sample grows until it holds ENOUGH linked ones, or is so large without one that
    (with 95 % certainty) the missed ones cannot bring recall below RECALL, or holds all.
    """
    sized = cut(labels.groupBy("component").agg(F.count("*").alias("n")))
    largest = sized.orderBy(F.desc("n"), "component").first()
    known = labels.toDF("id", "component")
    drawn = classes.select("id", "vec").join(known, "id", "left").withColumn("place", F.pmod(seeded(seed, "id"), F.lit(1 << 40)) / float(1 << 40))

    def part(rows: DataFrame, n: int, at: int, to: int) -> np.ndarray:
        """Recalls of the sampled rows number ``at`` to ``to``, in about QUERIES at once."""
        out = [np.zeros(0)]
        for a in range(at, min(n, to), QUERIES):
            b = min(n, to, a + QUERIES)
            rank = rows.where((F.col("place") >= a / n) & (F.col("place") < (b / n if b < n else 2.0)))
            out.append(_recalls(classes, labels, rank))
        return np.concatenate(out)

    inside = outside = 1.0
    others = 0
    if largest is not None:
        others = labels.count() - largest["n"]
        inside = part(drawn.where(F.col("component") == largest["component"]), largest["n"], 0, AUDIT).mean()
    if others:
        met = part(drawn.where(F.col("component") != largest["component"]), others, 0, AUDIT)
        outside = met.mean() if len(met) else 1.0
    alone = drawn.where("component is null")
    n, at, size, missed = alone.count(), 0, AUDIT, 0
    while at < n:
        missed += len(part(alone, n, at, size))
        at = min(n, size)
        if missed >= ENOUGH or not missed and 3 * n / at <= (1 - RECALL) * others:
            break
        size *= 4
    lost = missed * n / at if at else 0.0
    return float(min(inside, outside * others / (others + lost) if lost else outside))


def _link_counts(classes: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, links): how many vectors of other classes are linked with each vector of a component, every pair of the component
    compared, in blocks of about BLOCK by BLOCK."""
    sized = labels.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = labels.withColumnRenamed("node", "id").join(sized, "component").join(classes.select("id", "n", "vec"), "id")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    left = rows.select("component", F.col("mine").alias("i"), F.lit(0).alias("side"), "id", "n", "vec", other).withColumnRenamed("other", "j")
    right = rows.select("component", F.col("mine").alias("j"), F.lit(1).alias("side"), "id", "n", "vec", other).withColumnRenamed("other", "i")
    groups = left.unionByName(right).groupBy("component", "i", "j").agg(F.collect_list(F.struct("side", "id", "n", "vec")).alias("m")).select("m")

    def run(batch: pa.RecordBatch):
        column = batch.column(0)
        at, inner = np.asarray(column.offsets), column.values
        side, ids, n = (inner.field(k).to_numpy() for k in ("side", "id", "n"))
        x = _matrix(inner.field("vec"), np.float64)
        out, links = [], []
        for s, e in zip(at[:-1], at[1:]):
            own, others = s + np.flatnonzero(side[s:e] == 0), s + np.flatnonzero(side[s:e] == 1)
            same = (x[own] @ x[others].T >= THRESHOLD) & (ids[own][:, None] != ids[others])
            out.append(ids[own])
            links.append(same @ n[others])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)), pa.array(np.concatenate(links).astype(np.int64))], ["id", "links"])

    return arrow_map(groups, run, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def _linked(classes: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """(links per class, component of each linked class) among classes of one length."""

    def narrow(batch: pa.RecordBatch):
        x = _matrix(batch.column(1), np.float64).astype(np.float32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "vec"])

    vectors = cut(arrow_map(classes.select("id", "vec"), narrow, "id long, vec binary"))
    n = classes.count()
    near = edges = None
    for wave in range(WAVES):
        found = _bucketed(vectors, dim, n, wave)
        if near is not None:
            found = found.unionByName(near.select("a", F.explode("near").alias("x")).select("a", "x.b", "x.sim"))
        near = cut(_top(found, NEIGHBOURS))
        for _ in range(ROUNDS):
            near, entered = _descend(near, vectors)
            if entered <= 0.001 * n * NEIGHBOURS:
                break
        now = _close(near, classes)
        edges = cut(now if edges is None else edges.unionByName(now).distinct())  # a link stays, whatever enters the lists later
        edges, labels = _enlarged(edges, near, vectors, classes, dim, wave)
        if audit(classes, labels) >= RECALL:
            break
    else:
        labels = _finished(edges, vectors, classes, n)
    return _link_counts(classes, labels), labels


def embedding_dedup(rows: DataFrame, id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row; other columns are ignored, whatever their names.

    Two vectors are linked if their cosine is THRESHOLD or more. Vectors that are null, empty or zero, or hold null or
    non-finite components, and rows without an id, have no link, are their own component and kept. Vectors of different
    lengths are never linked. Repeated rows are vectors of their own. An empty table gives an empty result.
    Reported links are exact; links missed are audited (see ``audit``), each wave adds tables until RECALL is met, and if
    WAVES of them do not meet it all vectors of different components are compared, which misses none.
    """
    every = cut(unit_vectors(rows, id, embedding))
    classes = cut(every.where("vec is not null and vec_id is not null").groupBy("dim", "vec").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")))
    counts, labels = None, None
    for (dim,) in classes.select("dim").distinct().orderBy("dim").collect():  # embeddings come in one length, or a few
        c, l = _linked(classes.where(F.col("dim") == dim), dim)
        counts, labels = (c, l) if counts is None else (counts.unionByName(c), labels.unionByName(l))
    named = every.join(classes.select("dim", "vec", "id", "n"), ["dim", "vec"], "left")
    if counts is None:
        named = named.withColumns({"links": F.lit(0).cast("long"), "component": F.lit(None).cast("long")})
    else:
        named = named.join(counts, "id", "left").join(labels.toDF("id", "component"), "id", "left")
    linked = F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("links", F.lit(0)) + F.coalesce(F.col("n") - 1, F.lit(0)))
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "id", "vec_id"))
    return named.select("vec_id", linked.cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


@query("op8_embedding_dedup")
def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))
