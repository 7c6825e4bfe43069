import json
import struct
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from shapes_for_tests import box, line, multipolygon, point, polygon
from test_joins import layer_of

from geoloom.functions import codec, kernels, text
from geoloom.layer import GEOM, Layer, point_layer
from geoloom.sources import catalog, collections, export, geoparquet, ingest, place, versions
from geoloom.streaming import jobs

ALL = [
    point(1, 2),
    line((0, 0), (1, 1)),
    polygon(box(0, 0, 4, 4), box(1, 1, 2, 2)),
    {"kind": "MultiPoint", "parts": [[[{"x": 1.0, "y": 2.0}]], [[{"x": 3.0, "y": 4.0}]]]},
    {"kind": "MultiLineString", "parts": [[[{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 1.0}]], [[{"x": 2.0, "y": 2.0}, {"x": 3.0, "y": 3.0}]]]},
    multipolygon([box(0, 0, 1, 1)], [box(2, 2, 3, 3)]),
]


def test_wkb_round_trip(spark):
    layer = layer_of(spark, ALL, "mixed")
    back = layer.df.select(GEOM, codec.from_wkb(codec.to_wkb(F.col(GEOM))).alias("back"))
    assert back.filter(F.col("back") != F.col(GEOM)).count() == 0


def test_wkb_flavours(spark):
    values = {
        "big endian": struct.pack(">BIdd", 0, 1, 5.0, 6.0),
        "z flag": struct.pack("<BIddd", 1, 0x80000001, 5.0, 6.0, 7.0),
        "iso z": struct.pack("<BIddd", 1, 1001, 5.0, 6.0, 7.0),
        "srid": struct.pack("<BIIdd", 1, 0x20000001, 4326, 5.0, 6.0),
        "truncated": struct.pack("<BId", 1, 1, 5.0),
        "short": b"\x01",
        "unknown": struct.pack("<BI", 1, 99),
        "nan": struct.pack("<BIdd", 1, 1, float("nan"), 1.0),
        "null": None,
    }
    df = spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in values.items()], "name string, geometry binary")
    layer, quarantine = ingest.normalize_layer(df, id="name")
    good = {r["name"]: (r["xmin"], r["ymin"]) for r in layer.df.filter("xmin is not null").collect()}
    assert good == {n: (5.0, 6.0) for n in ("big endian", "z flag", "iso z", "srid")}
    assert {r["name"] for r in quarantine.collect()} == {"truncated", "short", "unknown", "nan"}
    strict = {r["name"]: r["f"] for r in df.select("name", codec.family_of_wkb(F.col("geometry"), True).alias("f")).collect()}
    loose = {r["name"]: r["f"] for r in df.select("name", codec.family_of_wkb(F.col("geometry")).alias("f")).collect()}
    assert strict["big endian"] == "point" and strict["z flag"] == strict["iso z"] == strict["null"] == strict["short"] == "other"
    assert loose["z flag"] == loose["iso z"] == loose["srid"] == "point" and loose["unknown"] == "other"


def test_wkb_batches(spark):
    """Every kind beside nulls and values cut at each byte; parts of another kind than their whole are unreadable."""
    column = pa.array([*ALL, None, *ALL[::-1]], kernels.GEOMETRY_ARROW)
    stored = codec.encode(column)
    assert codec.decode(stored).equals(column) and codec.decode(stored.slice(3, 5)).equals(column.slice(3, 5))
    assert len(codec.decode(pa.array([], pa.binary()))) == len(codec.encode(column.slice(0, 0))) == 0
    whole = stored[5].as_py()
    pieces = [whole[:n] for n in range(len(whole))] + [whole]
    assert codec.decode(pa.array(pieces, pa.binary())).to_pylist() == [None] * len(whole) + [ALL[5]]
    assert codec.decode(pa.array([whole[:9] + stored[0].as_py()], pa.binary())).to_pylist() == [None]
    hostile = struct.pack("<BIII", 1, 3, 0xFFFFFFFF, 0xFFFFFFFF)
    assert codec.decode(pa.array([hostile, struct.pack("<BI", 1, 6)], pa.binary())).to_pylist() == [None, None]


def test_geoparquet_footers(spark, tmp_path):
    layer = layer_of(spark, [*ALL, ALL[0]], "mixed")
    missing = layer.df.withColumn(GEOM, F.when(F.col("id") < 6, F.col(GEOM)))
    layer = layer.with_df(missing.withColumn("bbox", F.lit("taken")).repartition(3))
    path = str(tmp_path / "mixed")
    export.write_geoparquet(layer, path, "outline")
    with pytest.raises(FileExistsError):
        export.write_geoparquet(layer, path, "outline")
    assert not [f for f in (tmp_path / "mixed").iterdir() if f.name.startswith("_staging")]
    found = geoparquet.footers(spark, path).collect()
    assert sum(r["n_rows"] for r in found) == 7 and {r["primary_column"] for r in found} == {"outline"}
    assert {k for r in found for k in r["kinds"]} == set(codec.CODE_OF_KIND)
    assert min(r["xmin"] for r in found if r["xmin"] is not None) == 0 and max(r["xmax"] for r in found if r["xmax"] is not None) == 4
    back, quarantine = ingest.read_geoparquet(spark, path, id=layer.id)
    assert quarantine.count() == 0 and set(back.attributes) == {layer.id, "bbox"}
    pair = back.df.select(layer.id, F.col(GEOM).alias("g")).join(layer.df, layer.id)
    assert pair.count() == 7 and pair.filter(~F.col("g").eqNullSafe(F.col(GEOM))).count() == 0


def test_geoparquet_without_rows(spark, tmp_path):
    layer = layer_of(spark, ALL, "mixed")
    path = str(tmp_path / "none")
    export.write_geoparquet(layer.with_df(layer.df.filter("1 = 0")), path, "outline")
    back, _ = ingest.read_geoparquet(spark, path, id=layer.id)
    assert back.df.count() == 0 and layer.id in back.df.columns


def test_geojson_collection(spark, tmp_path):
    features = [
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"id": 1, "label": "A"}},
        {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}, "properties": {"id": 2, "label": "B"}},
        {"type": "Feature", "geometry": None, "properties": {"id": 3, "label": "C"}},
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": ["x"]}, "properties": {"id": 4, "label": "D"}},
    ]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    layer, quarantine = ingest.read_geojson(spark, str(tmp_path / "a.geojson"))
    assert layer.id == "id" and layer.df.columns[0] == GEOM
    rows = {r["id"]: r for r in layer.df.collect()}
    assert rows[1]["xmin"] == 1.0 and rows[2]["xmax"] == 1.0 and rows[3][GEOM] is None
    assert [r["id"] for r in quarantine.collect()] == [4]


@pytest.mark.parametrize("sent", [0, collections.SENT_SPLITS])
def test_collection_in_splits(spark, tmp_path, monkeypatch, sent):
    """Cut at any byte, a collection gives the features it holds: braces in strings, escapes, other members around them."""
    monkeypatch.setattr(collections, "SENT_SPLITS", sent)
    odd = ['}{"', "\\", '\\"}],', "{[", "é}ü", "", "line\nbreak }", "]}"]
    features = [
        {"type": "Feature", "properties": {"id": k, "name": odd[k % 8] * (k % 5), "nested": {"a": [{"b": k}, "}"]}}, "geometry": {"type": "Point", "coordinates": [k, k / 2]}}
        for k in range(20)
    ]
    crs = {"type": "name", "properties": {"name": "x}"}}
    whole = {"type": "FeatureCollection", "crs": crs, "links": [{"rel": "self"}, {"rel": "}]"}], "features": features, "after": [{"x": 1}], "n": {"m": [[1]]}}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.geojson").write_text(json.dumps(whole, ensure_ascii=False))
    (tmp_path / "in" / "b.geojson").write_text("\ufeff" + json.dumps({"features": [], "type": "FeatureCollection"}, indent=2) + "\n")
    (tmp_path / "in" / "c.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features[:3]}, indent=3) + "\n")
    (tmp_path / "in" / "d.geojson").write_text("")
    expected = sorted(json.dumps(f, sort_keys=True) for f in features + features[:3])
    for size in ("97", "100000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            reader = spark.read.option("lineSep", "}").text(str(tmp_path / "in"))
            tasks = reader.rdd.getNumPartitions()
            got = [r["value"] for r in collections.feature_texts(spark, str(tmp_path / "in")).collect()]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert sorted(json.dumps(json.loads(v), sort_keys=True) for v in got) == expected and not any("\n" in v for v in got)
        assert tasks > 20 or size != "97"


def test_union_rejects_type_conflicts(spark):
    a, b = Layer(spark.sql("select 1 as id, 'x' as v"), "id"), Layer(spark.sql("select 2 as id, 3 as v"), "id")
    with pytest.raises(ValueError, match="'v'"):
        ingest.union_layers([a, b])
    both = ingest.union_layers([a, Layer(spark.sql("select 2 as id, 5 as w"), "id")]).df
    assert {tuple(r) for r in both.select("id", "v", "w").collect()} == {(1, "x", None), (2, None, 5)}


def test_retype(spark):
    df = spark.createDataFrame([(1, ""), (2, " 12 "), (3, "abc"), (4, None)], "id int, t string")
    layer, warnings = ingest.retype(Layer(df, "id"), {"t": "INTEGER"})
    assert [r["t"] for r in layer.df.orderBy("id").collect()] == [None, 12, None, None]
    assert tuple(warnings.first()) == ("t", 3, 2)
    for bad in ({"nope": "INTEGER"}, {"t": "BLOB"}):
        with pytest.raises(ValueError):
            ingest.retype(Layer(df, "id"), bad)


def test_preview_cuts_values(spark):
    head, columns = ingest.preview(spark.sql("select id, repeat('y', 200) as long from range(9)"))
    assert head.count() == 5 and len(head.first()["long"]) == 80 and columns.count() == 2


def test_split_by_family(spark):
    split = ingest.split_by_family(layer_of(spark, ALL, "mixed"))
    assert {k: v.count() for k, v in split.items()} == {"_points": 2, "_lines": 2, "_polygons": 2}
    assert list(ingest.split_by_family(layer_of(spark, ALL[:1]))) == [""]


def test_scratch_life_cycle(spark):
    db = "_scratch_test"
    rows = spark.sql("select 1 as a, 2 as b, 3 as A")
    assert catalog.materialize(spark.range(7), "t", db) == 7
    assert catalog.materialize(rows, "t", db) == 1 and spark.table(f"{db}.t").columns == ["a", "b"]
    with pytest.raises(Exception):
        catalog.materialize(rows, "t", db, overwrite=False)
    assert catalog.inventory(spark).filter("namespace = '_scratch_test'").count() == 0
    assert catalog.inventory(spark, include_scratch=True).filter("namespace = '_scratch_test'").count() == 2
    assert catalog.promote(spark, f"{db}.t", "default.kept_test") == 1
    with pytest.raises(Exception):
        catalog.promote(spark, f"{db}.t", "default.kept_test")
    with pytest.raises(ValueError):
        catalog.promote(spark, "default.kept_test", "default.other")
    assert catalog.drop_scratch(spark, db, idle=timedelta(hours=1)) == []
    assert catalog.drop_scratch(spark, db) == ["t"] and not spark.catalog.databaseExists(db)
    with pytest.raises(ValueError):
        catalog.drop_scratch(spark, "default")


def test_versions(spark):
    rows = [(1, "a", 1, datetime(2024, 1, 1)), (2, "b", 2, datetime(2024, 1, 2)), (3, "c", 3, datetime(2024, 1, 3))]
    table = spark.createDataFrame(rows, "k int, v string, version int, committed_at timestamp_ntz")
    assert [tuple(r)[:3] for r in versions.commits(table).orderBy("version").collect()] == [(i, "append", 1) for i in (1, 2, 3)]
    assert versions.as_of(table, 2).count() == 2
    assert versions.as_of(table, timestamp=datetime(2024, 1, 2, 5)).count() == 2
    for wrong in ({}, {"number": 1, "timestamp": datetime(2024, 1, 1)}):
        with pytest.raises(ValueError):
            versions.as_of(table, **wrong)
    before = versions.as_of(table, 2).select("k", "v")
    after = spark.sql("select 2 as k, 'c' as v, 9 as w union all select 4, 'd', 1")
    assert {r["k"]: r["change"] for r in versions.diff(before, after, "k").collect()} == {1: "removed", 2: "changed", 4: "added"}


def test_quantise_edges(spark):
    same = point_layer(spark.createDataFrame([(1, 7.0, 8.0), (2, 7.0, 8.0)], "id int, lon double, lat double"), "id")
    assert {(tuple(r["coords"]), r["scale_x"]) for r in export.quantize_layer(same).collect()} == {((0, 0), 1e-8)}
    layer = layer_of(spark, [ALL[2], ALL[5]])
    rows = {r["id"]: r for r in export.quantize_layer(layer).collect()}
    assert rows[0]["lengths"] == [5, 5] and rows[1]["lengths"] == [5, 5]
    # Each ring starts again from zero: its first pair is absolute.
    assert rows[0]["coords"][10:12] == [25_000_000, 25_000_000]
    assert layer.df.limit(0).count() == export.quantize_layer(layer.with_df(layer.df.limit(0))).count() == 0


def test_esri_shapes(spark):
    layer = layer_of(spark, ALL, "mixed")
    shapes = [json.loads(r["geometry"]) for r in export.esri_features(layer).orderBy("id").collect()]
    assert [list(s) for s in shapes] == [["x", "y"], ["paths"], ["rings"], ["points"], ["paths"], ["rings"]]
    assert len(shapes[2]["rings"]) == 2 and len(shapes[5]["rings"]) == 2


def test_geojson_text(spark):
    layer = layer_of(spark, ALL, "mixed")
    read = [json.loads(r["g"]) for r in layer.df.orderBy("id").select(text.to_geojson(F.col(GEOM)).alias("g")).collect()]
    assert [g["type"] for g in read] == [g["kind"] for g in ALL]
    assert read[5]["coordinates"][1][0][2] == [3, 3] and read[3]["coordinates"] == [[1, 2], [3, 4]]


def test_csv_quoting(spark):
    df = spark.createDataFrame([(1, 'a "b", c', 2.0, 0.12345), (2, "x\ny", None, 3.0)], "id int, t string, w double, d double")
    lines = [r["line"] for r in export.csv_lines(Layer(df, "id")).collect()]
    assert lines == ['1,"a ""b"", c",2,0.1235', '2,"x\ny",,3']


def test_shared_folder_follows_the_session(spark):
    assert place.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_stream_equals_batch_over_many_files(spark, tmp_path):
    """Geofence notices do not depend on how events are cut into micro-batches."""
    events = spark.range(400).select(
        F.col("id"), (F.col("id") % 3).alias("user"), F.timestamp_seconds(F.col("id") * 600 + 1_700_000_000).alias("ts"),
        F.when(F.col("id") * 7 % 5 < 3, F.col("id") * 7 % 5).alias("zone"),
    )
    for i in range(4):
        events.filter((F.col("id") >= i * 100) & (F.col("id") < i * 100 + 100)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.file_stream(spark, str(tmp_path / "in"), events.schema, files_per_batch=1)
    notices = jobs.geofence_stream(stream, "user", "ts", "id", watermark="30 days")
    jobs.run_appends(notices, str(tmp_path / "out"), str(tmp_path / "check"))
    from geoloom.operators.timeline import geofence_events

    batch = geofence_events(events, "user", "ts", "id")
    got = {(r["key"], r["id"], r["left_zone"], r["entered_zone"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r["user"], r["id"], r["left_zone"], r["entered_zone"]) for r in batch.collect()}
