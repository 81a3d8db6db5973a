import json
from math import cos, pi

import pytest
from pyspark.sql import functions as F

from geostrata.functions.geo import in_multi_polygon, project, ring_points
from geostrata.functions.render import band_label, ramp_colour, subarea_label
from geostrata.sinks.writers import csv_text
from geostrata.sources.points import detect_name_field, merge_points, parse_admin_units, parse_points, read_features
from geostrata.sources.raster import Filter, Raster, apply_filters, outside_counts

SQUARE = [[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]]
HOLE = [[4, 4], [6, 4], [6, 6], [4, 6], [4, 4]]


def write(tmp_path, name, features):
    p = tmp_path / f"{name}.json"
    p.write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    return str(p)


def test_points(spark, tmp_path):
    a = write(tmp_path, "a", [
        {"type": "Feature", "id": 7, "geometry": {"type": "Point", "coordinates": [1, 2]}},
        {"type": "Feature", "properties": {"id": "m"}, "geometry": {"type": "MultiPoint", "coordinates": [[3, 4], [5, 6]]}},
        {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}},
        {"type": "Feature", "geometry": None},
    ])
    b = write(tmp_path, "b", [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [9.5, 8]}}])
    rows = merge_points([parse_points(read_features(spark, p), n, i) for i, (n, p) in enumerate((("a", a), ("b", b)))]).orderBy("idx").collect()
    assert [(r.idx, r.id, r.lon, r.lat, r.source, r.orig_id) for r in rows] == [(0, "a:0", 1, 2, "a", "7"), (1, "a:1", 3, 4, "a", "m"), (2, "a:2", 5, 6, "a", "m"), (3, "b:0", 9.5, 8, "b", None)]


def test_admin_units_and_names(spark, tmp_path):
    f = write(tmp_path, "u", [
        {"type": "Feature", "properties": {"code": 1, "Name": "A", "name": " "}, "geometry": {"type": "Polygon", "coordinates": [SQUARE, HOLE]}},
        {"type": "Feature", "properties": {"code": 2, "Name": "B"}, "geometry": {"type": "Point", "coordinates": [0, 0]}},
        {"type": "Feature", "id": "x", "properties": {"Name": " "}, "geometry": {"type": "MultiPolygon", "coordinates": [[SQUARE]]}},
    ])
    features = read_features(spark, f)
    assert detect_name_field(features) == "Name"
    rows = parse_admin_units(features, "Name").orderBy("unit_idx").collect()
    assert [(r.id, r.name, r.minx, r.maxy) for r in rows] == [(" ", "A", 0, 10), ("x", "x", 0, 10)]
    at = spark.createDataFrame([(1.0, 1.0), (5.0, 5.0), (20.0, 20.0)], "x double, y double")
    polygons = F.from_json(F.lit(json.dumps([[[{"x": x, "y": y} for x, y in ring] for ring in (SQUARE, HOLE)]])), "array<array<array<struct<x:double,y:double>>>>")
    assert [r[0] for r in at.select(in_multi_polygon(F.col("x"), F.col("y"), polygons)).collect()] == [True, False, False]


def cells(spark):
    return spark.createDataFrame([(r, c, float(3 * r + c + 1)) for r in range(3) for c in range(3)], "row int, col int, value double")


@pytest.mark.parametrize("ry", [1.0, -1.0])
def test_raster_sample(spark, ry):
    r = Raster("v", cells(spark), 3, 3, 0, 3, 1.0, ry, nodata=9.0)
    pts = spark.createDataFrame([(0, 0.5, 2.5), (1, 2.5, 0.5), (2, 1.5, 1.5), (3, 5.0, 5.0)], "idx int, lon double, lat double")
    rows = {x.idx: (x.s, x.c) for x in r.sample(pts, "s", "c").collect()}
    assert rows == {0: (1.0, True), 1: (None, True), 2: (5.0, True), 3: (None, False)}
    kept = apply_filters(pts, [Filter(r, "<=", 4.0), Filter(r, ">=", 0.0)])
    assert {x.idx for x in kept.where("keep").collect()} == {0, 1, 3}
    assert [(x.raster, x.n) for x in outside_counts(kept).collect()] == [("v", 2)]


def test_density_cells(spark):
    r = Raster("v", cells(spark), 3, 3, 0, 3, 1.0, -1.0, is_density=True, is_geographic=False, to_meter=0)
    got = {(x.row, x.col): x.people for x in r.populated().collect()}
    assert got[0, 0] == pytest.approx(1e-6) and len(got) == 9


def test_projection_and_ring(spark):
    pts = spark.createDataFrame([(0, 37.0, 0.0), (1, 38.0, 1.0)], "idx int, lon double, lat double")
    x = {r.idx: (r.x_m, r.y_m) for r in project(pts).collect()}
    k = 6371000 * pi / 180
    assert x[1][0] == pytest.approx(0.5 * k * cos(0.5 * pi / 180)) and x[0][1] == pytest.approx(-0.5 * k)
    ring = pts.limit(1).select(ring_points(F.col("lon"), F.col("lat"), F.lit(1000.0)).alias("r")).first().r
    assert len(ring) == 16 and ring[0].y == 0 and ring[0].x == pytest.approx(37 + 1000 / k)


def test_labels_and_csv(spark):
    d = spark.createDataFrame([(0, 1, False), (0, 5, True), (1, 5, False), (4, 5, False), (8, 12, False)], "b int, k int, s boolean")
    assert [r[0] for r in d.select(band_label(F.col("b"), F.col("k"))).collect()] == ["whole area", "lowest fifth", "second-lowest fifth", "highest fifth", "9th-lowest 1/12"]
    assert d.select(subarea_label(F.col("b"), F.col("k"), F.col("s"))).collect()[1][0] == "scattered points — lowest fifth of this area"
    assert [r[0] for r in spark.range(1).select(F.explode(F.array(ramp_colour(F.lit(-1.0)), ramp_colour(F.lit(2.0))))).collect()] == ["#eaf1f5", "#164a68"]
    c = spark.createDataFrame([(2, "a,b", None), (1, 'q"', "x\ny")], "o int, t string, u string")
    assert csv_text(c, ["o"]).first()[0] == 't,u\r\n"q""","x\ny"\r\n"a,b",\r\n'
