"""Hard negatives against all pairs, the tree's eliminations against all scores, and edge rows."""

import math
import random

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from geoloom.llm import hard_negatives as hn

NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, is_anchor, positives=5, negatives=3):
    """Expected rows, from every pair."""
    good = set()
    for i, x, y in rows:
        if i is not None and x is not None and y is not None and all(v is not None and math.isfinite(v) for v in x):
            q = tuple(math.floor(256 * v) for v in x)
            if sum(v * v for v in q) < hn.LONGEST:
                good.add((i, y, q))
    out = []
    for a in good:
        if not is_anchor(a[0]):
            continue
        scored = sorted((-sum(u * v for u, v in zip(a[2], b[2])), b[0], b[1] == a[1]) for b in good if b != a)
        for s, i, _ in [r for r in scored if r[2]][:positives]:
            hard = [r for r in scored if not r[2] and 50 * -s <= 100 * -r[0] <= 95 * -s][:negatives]
            out += [(a[0], i, k + 1, r[1], -s, -r[0]) for k, r in enumerate(hard)]
    return sorted(out)


def mined(spark, rows, anchors):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    return sorted(tuple(r[n] for n in NAMES) for r in hn.hard_negatives(df.repartition(4), anchors).collect())


def clustered(seed, n, dim, labels, spread=0.15):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(labels * 2, dim))
    out = []
    for k in range(n):
        c = int(r.integers(len(centres)))
        x = centres[c] + spread * r.normal(size=dim)
        out.append((k, [float(v) for v in x / np.linalg.norm(x)], int(c % labels if r.random() < 0.8 else r.integers(labels))))
    return out


@pytest.mark.parametrize("leaf, block, share", [(8, 5, 2), (64, 256, 64)])
def test_against_all_pairs(spark, monkeypatch, leaf, block, share):
    monkeypatch.setattr(hn, "LEAF", leaf)
    monkeypatch.setattr(hn, "LEAF_SAMPLE", leaf)
    monkeypatch.setattr(hn, "BLOCK", block)
    monkeypatch.setattr(hn, "SHARE", share)
    rows = clustered(1, 500, 6, 4)
    assert mined(spark, rows, F.col("vec_id") % 10 == 0) == brute(rows, lambda i: i % 10 == 0)


def test_a_third_of_the_rows_are_copies_and_scores_tie(spark, monkeypatch):
    monkeypatch.setattr(hn, "LEAF", 8)
    monkeypatch.setattr(hn, "LEAF_SAMPLE", 8)
    r = random.Random(2)
    rows = [(i, [float(r.randint(-2, 2)) for _ in range(3)], r.randint(0, 2)) for i in range(240)]
    rows = [(i, [0.5, 0.25, 1.0], 1) if i % 3 == 0 else (i, x, y) for i, x, y in rows]
    rows += rows[:100]  # repeated rows count once
    assert mined(spark, rows, F.col("vec_id") % 9 == 0) == brute(rows, lambda i: i % 9 == 0)


def test_query_against_all_pairs(spark):
    read = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    rows = [(r.vec_id, list(r.embedding), (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in read]
    got = sorted(tuple(r[n] for n in NAMES) for r in hn.op11_hard_negatives(spark, SF).collect())
    assert got == brute(rows, lambda i: i % 50 == 0) and len(got) > 50


def test_tree_eliminates_and_loses_nothing():
    rows = clustered(4, 3000, 8, 5, spread=0.05)
    x = np.floor(256 * np.array([r[1] for r in rows]))
    norms = (x * x).sum(axis=1).astype(np.int64)
    tree = hn.Tree(x[:1000], norms[:1000], 32)
    leaf = tree.leaf_of(x, norms)

    class Range:
        def __init__(self, **at):
            self.__dict__.update(at)

    ranged = []
    for number, at, away, child in tree.descend(x, norms):
        for k in np.unique(child):
            own = child == k
            for j in range(away.shape[1]):
                ranged.append(Range(node=number, child=k, point=j, near=away[own, j].min(), far=away[own, j].max(), short=float(norms[at[own]].min()), long=float(norms[at[own]].max()), n=int(own.sum())))
    tree.ranges(ranged)
    assert sum(tree.sizes) == 3000 and tree.leaves > 20
    anchors = np.arange(0, 3000, 60)
    score = hn.scores(x[anchors], x, norms[anchors], norms)
    low, high = np.percentile(score, 99, axis=1).astype(np.int64)[:, None], np.percentile(score, 99.9, axis=1).astype(np.int64)[:, None]
    row, visited = tree.visits(x[anchors], norms[anchors], low, high)
    pairs = set(zip(row.tolist(), visited.tolist()))
    for k in range(len(anchors)):
        inside = (score[k] >= low[k]) & (score[k] <= high[k])
        assert {(k, n) for n in leaf[inside].tolist()} <= pairs
    assert len(pairs) < 0.5 * len(anchors) * tree.leaves


SCHEMA = "vec_id long, embedding array<double>, label int, q string, norm string, k1 int, leaf int, ids string, anchor int"


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], 1), (2, None, 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 1), (5, [None, 1.0], 1), (None, [1.0, 1.0], 1), (6, [1.0, 1.0], None)]
    rows += [(7, [1.0, 1.5], 1), (8, [1.0, 1.0], 2), (9, [0.5, 1.0], 2), (10, [], 2), (11, [], 1), (12, [1.0], 2), (13, [1e30, 0.0], 2), (14, [-1.0, -2.0], 2)]
    rows += [(1, [1.0, 2.0], 1), (1, [2.0, 0.5], 1)]  # a repeated row, a row of the same id
    wide = [(*r, "x", "y", 1, 2, "z", 3) for r in rows]
    df = spark.createDataFrame(wide, SCHEMA)
    got = sorted(tuple(r[n] for n in NAMES) for r in hn.hard_negatives(df, F.col("vec_id") > 0).collect())
    assert got == brute(rows, lambda i: True) and {r[0] for r in got} > {1, 7}
    assert hn.hard_negatives(df.where("false"), F.col("vec_id") > 0).count() == 0
    assert hn.hard_negatives(df, F.col("vec_id") > 100).count() == 0


def test_large_components_stay_exact():
    a = np.array([[1 << 25, (1 << 25) - 1, 3]], float)
    b = np.array([[(1 << 25) - 5, (1 << 25) + 7, 1]], float)
    norms = lambda v: np.array([int((v.astype(object) ** 2).sum())])
    assert hn.scores(a, b, norms(a), norms(b))[0, 0] == (1 << 25) * ((1 << 25) - 5) + ((1 << 25) - 1) * ((1 << 25) + 7) + 3
