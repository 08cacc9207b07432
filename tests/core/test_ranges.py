import json

import pytest

from tests.core.test_districts import CASES, MAIN, collection
from tests.core.test_geojson import BAD
from trellis.sources import geojson, ranges

ODD = {
    "braces in strings": '{"note":"} ] { \\" \\\\","type":"FeatureCollection","features":[]}',
    "other arrays": '{"bbox":[1,2],"old":[{"id":1},{"a":[{"b":{}}]}],"crs":{"type":"name","properties":{"name":"x"}},"type":"FeatureCollection","features":[{"type":"Feature","properties":{"id":7,"object_type":"source","text":"\\"}]}{["},"geometry":{"type":"Point","coordinates":[37.6,55.7]}}],"end":[{"z":{}}]}',
    "number among features": '{"type":"FeatureCollection","features":[{},1]}',
    "other array broken": '{"old":[{"a":}],"type":"FeatureCollection","features":[]}',
    "last brace missing": collection(MAIN)[:-1],
    "too many braces": "}" + collection(MAIN),
    "brackets mixed": '{"type":"FeatureCollection","features":[{"a":[1}]]}',
    "comma missing": '{"type":"FeatureCollection","features":[{} {}]}',
    "comma too many": '{"type":"FeatureCollection","features":[{},{},]}',
    "control character": '{"type":"FeatureCollection","features":[\x02]}',
    "byte order mark": "﻿" + collection(MAIN),
    "line feed at the end": collection(MAIN) + "\n",
    "blank": "  ",
    "empty": "",
    "string unended": '{"type":"FeatureCollection","features":[],"x":"',
    "features twice": '{"type":"FeatureCollection","features":[{}],"features":[{}]}',
    "features no array": '{"type":"FeatureCollection","features":{"a":[{}]}}',
    "letters beyond ASCII": collection(MAIN).replace('"src"', '"насос 💧 {"'),
}


def rows(df):
    """All rows; of the messages of malformed JSON only that they are such."""
    return sorted([str(r[:-2]) + str(r.message if r.pos >= 0 else r.message[:14]) + str(r.warning) for r in df.collect()])


@pytest.mark.parametrize("split, names", [(400, ODD), (1 << 20, BAD)])
def test_equal_to_a_parse_of_whole_files(spark, tmp_path, monkeypatch, split, names):
    monkeypatch.setattr(ranges, "BLOCK", 50)
    for name, text in {**{k: v if isinstance(v, str) else v[0] for k, v in names.items()}, "good": collection(MAIN + CASES["detour"]), "indented": json.dumps(json.loads(collection(MAIN)), indent=3)}.items():
        (tmp_path / f"{name}.geojson").write_text(text, encoding="utf-8", newline="")
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in keep:
            spark.conf.set(k, str(split))
        held = []
        got = rows(ranges.scan(spark, str(tmp_path), held))
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert got == rows(geojson.scan(spark, str(tmp_path)))
    assert len(held) == 4


def test_states_of_strings():
    text = '{"a":"x\\\\\\"}","b":["\\\\",{"c":"]"}]}'
    whole, _ = ranges.blanked(text, 0)
    for cut in range(len(text) + 1):
        head, state = ranges.blanked(text[:cut], 0)
        tail, _ = ranges.blanked(text[cut:], state)
        assert (head + tail).replace(" ", "") == whole.replace(" ", ""), cut


def test_one_large_file_in_many_tasks(spark, tmp_path):
    point = lambda i: {"type": "Feature", "properties": {"id": i, "object_type": "source"}, "geometry": {"type": "Point", "coordinates": [37.6, 55.7]}}
    path = tmp_path / "large.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [point(i) for i in range(20000)]}))
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
        pieces = spark.read.text(str(path), lineSep="}")
        assert pieces.rdd.getNumPartitions() > 8
        got = ranges.scan(spark, str(path)).select("pos", "id_json").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
    assert sorted((r.pos, int(r.id_json)) for r in got) == [(i, i) for i in range(20000)]
