"""Ranks over composite keys against a plain sort, and the plans behind deep pages."""

import random

import pytest
from pyspark.sql import functions as F

from geoloom.layer import point_layer
from geoloom.operators import paging, ranks


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(6)
    data = [(k, r.choice([None, "a", "b", "c"]), r.choice([None, 1.5, 2.5, r.random()]), 0.0, 0.0) for k in range(3000)]
    return spark.createDataFrame(data, "id long, name string, v double, lon double, lat double").repartition(4).cache()


def expected(rows, keys):
    found = [r.asDict() for r in rows.select("id", "name", "v").collect()]
    for key in reversed(keys):  # stable sorts from the last key to the first
        some, none = [r for r in found if r[key.name] is not None], [r for r in found if r[key.name] is None]
        found = sorted(some, key=lambda r: r[key.name], reverse=key.descending) + none
    return [r["id"] for r in found]


ORDERS = [["id"], ["name", "v desc", "id"], ["v desc", "name desc", "id desc"]]


@pytest.mark.parametrize("order", ORDERS)
@pytest.mark.parametrize("offset, limit", [(0, 10), (1500, 7), (2995, 20), (4000, 5), (700, 900)])
def test_rows_between_against_a_sort(rows, monkeypatch, order, offset, limit):
    monkeypatch.setattr(ranks, "SMALL", 100)
    monkeypatch.setattr(ranks, "SAMPLED", 96)
    keys = paging.sort_keys(order)
    got = [r.id for r in ranks.rows_between(rows, keys, offset, limit).collect()]
    assert got == expected(rows, keys)[offset : offset + limit]


def test_deep_page_and_wanted_ids_touch_few_rows(spark):
    table = spark.range(1_000_000).select("id", F.pmod(F.xxhash64("id"), F.lit(1000)).alias("k"), F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat"))
    layer = point_layer(table, "id")
    page = paging.page(layer, ["k desc"], limit=50, offset=600_000).rows
    plan = page._jdf.queryExecution().executedPlan().toString()
    top = int(plan.split("TakeOrderedAndProject(limit=")[1].split(",")[0])
    assert top <= ranks.SMALL + 50
    keys = paging.sort_keys(["k desc", "id"])
    inside, below = ranks.narrowed(table, keys, 600_000, 600_049)
    assert inside.count() <= ranks.SMALL and below <= 600_000
    first = page.first()
    assert table.where(f"k > {first.k} or (k = {first.k} and id < {first.id})").count() == 600_000

    ids = list(range(5, 1_000_000, 10_000))
    found = paging.by_ids(layer, ids)
    assert sorted((r.oid, r.id) for r in found.select("oid", "id").collect()) == [(i, i) for i in ids]
    numbered = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_slice" in numbered and " IN " in numbered.upper() or "INSET" in numbered.upper()


def test_one_key_value_only(spark, monkeypatch):
    monkeypatch.setattr(ranks, "SMALL", 10)
    same = spark.range(500).select(F.lit(1).alias("k"), "id")
    assert [r.id for r in ranks.rows_between(same, paging.sort_keys(["k", "id"]), 490, 5).collect()] == [490, 491, 492, 493, 494]
    assert ranks.key_at(same.where("false"), paging.sort_keys(["k"]), 0) is None


def test_quartiles_narrow_their_brackets(spark, monkeypatch):
    from geoloom.operators import profile

    monkeypatch.setattr(profile, "FEW", 50)
    monkeypatch.setattr(profile, "SKETCH_ACCURACY", 20)
    r = random.Random(2)
    data = [(r.gauss(0, 1), float(r.randint(0, 3)), None if k % 3 else float(k)) for k in range(5000)]
    df = spark.createDataFrame(data, "a double, b double, c double").repartition(3)
    got = {s.column_name: s for s in profile.column_stats(df, ["a", "b", "c"]).collect()}
    for c in "abc":
        exact = df.selectExpr(f"percentile({c}, array(0.25, 0.5, 0.75)) p").first()["p"]
        assert [got[c].q25, got[c].median, got[c].q75] == pytest.approx(exact)
