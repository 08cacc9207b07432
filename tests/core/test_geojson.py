import json

import numpy as np
import pytest

from tests.core.test_districts import CASES, MAIN, collection
from trellis.functions import crs
from trellis.sources import geojson


def base():
    return json.loads(collection(MAIN + CASES["detour"]))


def at(root, i):
    return next(f for f in root["features"] if f["properties"]["id"] == i)


def edit(f):
    root = base()
    f(root)
    return json.dumps(root)


BAD = {
    "repeated id": (edit(lambda r: at(r, "src")["properties"].update(id="ch_1")), "properties.id"),
    "boolean id": (edit(lambda r: at(r, "a")["properties"].update(id=True)), "properties.id"),
    "no id": (edit(lambda r: at(r, "a")["properties"].pop("id")), "properties.id"),
    "flow zero": (edit(lambda r: at(r, "a")["properties"].update(flow_tph=0)), "properties.flow_tph"),
    "flow text": (edit(lambda r: at(r, "a")["properties"].update(flow_tph="20")), "properties.flow_tph"),
    "diameter": (edit(lambda r: at(r, "net_1")["properties"].update(diameter=301)), "properties.diameter"),
    "diameter with fraction": (edit(lambda r: at(r, "net_1")["properties"].update(diameter=300.0)), "properties.diameter"),
    "null geometry": (edit(lambda r: at(r, "a").update(geometry=None)), "geometry"),
    "outside": (edit(lambda r: at(r, "a")["geometry"].update(coordinates=[200, 10])), "geometry"),
    "bow tie": (edit(lambda r: at(r, "b")["geometry"]["coordinates"][0].__setitem__(slice(1, 3), at(r, "b")["geometry"]["coordinates"][0][2:0:-1])), "geometry"),
    "open ring": (edit(lambda r: at(r, "b")["geometry"]["coordinates"][0].pop()), "geometry"),
    "no length": (edit(lambda r: at(r, "net_1")["geometry"].update(coordinates=[[37.6, 55.7], [37.6, 55.7]])), "geometry"),
    "wrong geometry": (edit(lambda r: at(r, "a")["properties"].update(object_type="restriction", restriction_type="oks")), "geometry"),
    "type": (edit(lambda r: at(r, "a")["properties"].update(object_type="tree")), "properties.object_type"),
    "blank restriction": (edit(lambda r: at(r, "b")["properties"].update(restriction_type=" ")), "properties.restriction_type"),
    "no source": (edit(lambda r: r["features"].pop(0)), "features"),
    "nothing": ('{"type":"FeatureCollection","features":[]}', "features"),
    "broken": ('{"type":"FeatureCollection",', "$"),
    "trailing": (collection(MAIN) + " {}", "$"),
    "double key": ('{"type":"FeatureCollection","type":"FeatureCollection","features":[]}', "$"),
    "not a number": ('{"type":"FeatureCollection","features":[],"x":NaN}', "$"),
    "no collection": ('{"type":"Feature"}', "$"),
    "array": ("[]", "$"),
}


@pytest.fixture(scope="module")
def found(spark):
    files = spark.createDataFrame([(k, v[0]) for k, v in BAD.items()] + [("good", collection(MAIN + CASES["detour"])), ("unknown", edit(lambda r: at(r, "b")["properties"].update(restriction_type="moon")))], "district string, text string")
    features = geojson.scan_text(files)
    out = {}
    for r in geojson.diagnostics(features, files).collect():
        out.setdefault(r.district, []).append(r)
    return out


@pytest.mark.parametrize("name", BAD)
def test_bad_inputs(found, name):
    errors = [r for r in found[name] if r.severity == "ERROR"]
    assert errors and BAD[name][1] in {r.field for r in errors}


def test_good_and_unknown(found):
    assert "good" not in found
    assert [r.severity for r in found["unknown"]] == ["WARNING"]


def test_ids_keep_their_type():
    assert geojson.id_key(geojson.parse("1")) == geojson.id_key(geojson.parse("1.0")) != geojson.id_key("1")
    long = "123456789012345678901234567890"
    assert geojson.id_key(geojson.parse(long)) == f"n:{long}"


def test_list_is_cut(spark):
    root = base()
    root["features"] += [{"type": "Feature", "properties": {"id": f"x{i}"}, "geometry": None} for i in range(250)]
    files = spark.createDataFrame([("d", json.dumps(root))], "district string, text string")
    rows = geojson.diagnostics(geojson.scan_text(files)).collect()
    assert len(rows) == geojson.MAX_DIAGNOSTICS + 1 and sum(r.severity == "WARNING" for r in rows) == 1


def test_projection(spark):
    lon, lat = np.meshgrid(np.linspace(36, 42, 7), np.linspace(50, 60, 5))
    p = crs.to_utm(lon, lat)
    back = crs.to_wgs(p[..., 0], p[..., 1])
    assert np.abs(back - np.stack([lon, lat], -1)).max() < 1e-9
    assert np.allclose(crs.to_utm(39.0, 0.0), [500000, 0])
    from pyspark.sql import functions as F

    x, y = crs.utm_columns(F.col("lon"), F.col("lat"))
    r = spark.createDataFrame([(37.63, 55.69)], "lon double, lat double").select(x.alias("x"), y.alias("y")).first()
    assert np.allclose([r.x, r.y], crs.to_utm(37.63, 55.69), atol=1e-6)
