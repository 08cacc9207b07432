"""GeoJSON districts: strict scan with diagnostics, typed tables, and the writer of results.

A district is one file with one FeatureCollection. Files are parsed whole, one task each (a file is the unit of
work and bounded; a corpus of districts is many files), with duplicate keys, trailing tokens and non-finite numbers
refused. Duplicate ids and missing classes are checked over all features with DataFrame operations.
"""

from __future__ import annotations

import json
import os
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.functions import crs
from trellis.functions.tables import ALIASES, DIAMETERS, RULES
from trellis.operators import geometry

MAX_DIAGNOSTICS = 200
FEATURE = "district string, pos int, id_key string, id_json string, object_type string, diameter int, flow double, restriction_type string, geometry_type string, coords string, field string, message string, warning string"
_KNOWN_DN = {row[0] for row in DIAMETERS}
_GEOMETRY = {"source": {"Point"}, "heat_chamber": {"Point"}, "heat_network": {"LineString"}, "oks_connection_point": {"Point"}, "restriction": {"LineString", "MultiLineString", "Polygon", "MultiPolygon"}}
_DEPTH = {"Point": 0, "LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}


class Refused(ValueError):
    """A feature or file that breaks a rule, with the field it breaks it in."""

    def __init__(self, field: str, message: str):
        super().__init__(message)
        self.field = field


def _pairs(items):
    out = dict(items)
    if len(out) != len(items):
        raise ValueError("duplicate key")
    return out


def _constant(x):
    raise ValueError(f"number {x}")


def parse(text: str) -> dict:
    """Strict JSON: numbers with a fraction stay decimal, duplicate keys, NaN and trailing tokens raise."""
    return json.loads(text, object_pairs_hook=_pairs, parse_float=Decimal, parse_constant=_constant)


def id_key(value) -> str:
    """Identity of an id: numbers by value (1 and 1.0 are one), text apart from numbers."""
    if isinstance(value, str):
        return f"s:{value}"
    if isinstance(value, bool) or not isinstance(value, (int, Decimal)):
        raise Refused("properties.id", "id must be text or a number")
    text = f"{Decimal(value):f}"  # no rounding: ids may have any number of digits
    text = text.rstrip("0").rstrip(".") if "." in text else text
    return f"n:{'0' if text in ('-0', '') else text}"


def _coordinates(geom) -> tuple[str, list]:
    if not isinstance(geom, dict) or geom.get("type") not in _DEPTH or not isinstance(geom.get("coordinates"), list):
        raise Refused("geometry", "geometry is missing or of an unknown type")

    def walk(c, depth):
        if depth:
            if not isinstance(c, list) or not c:
                raise Refused("geometry", "empty geometry")
            return [walk(x, depth - 1) for x in c]
        if not isinstance(c, list) or len(c) < 2 or any(isinstance(v, bool) or not isinstance(v, (int, Decimal)) for v in c[:2]):
            raise Refused("geometry", "a position needs two numbers")
        lon, lat = float(c[0]), float(c[1])
        if not (-180 <= lon <= 180 and -90 <= lat <= 90):
            raise Refused("geometry", "coordinates outside WGS84")
        return [lon, lat]

    return geom["type"], walk(geom["coordinates"], _DEPTH[geom["type"]])


def _metres(coords, depth):
    if depth == 0:
        return crs.to_utm(*coords).tolist()
    if depth == 1:
        a = np.array(coords)
        return crs.to_utm(a[:, 0], a[:, 1]).tolist()
    return [_metres(c, depth - 1) for c in coords]


def _check(kind: str, metres) -> None:
    if not np.isfinite(np.array([v for v in _flat(metres)])).all():
        raise Refused("geometry", "coordinate undefined after projection")
    lines = [metres] if kind == "LineString" else metres if kind == "MultiLineString" else []
    for line in lines:
        a = np.array(line)
        if len(a) < 2 or np.hypot(*np.diff(a, axis=0).T).sum() == 0 or geometry.self_crossing(a[np.r_[True, (np.diff(a, axis=0) != 0).any(1)]]):
            raise Refused("geometry", "line meets itself or has no length")
    for area in [metres] if kind == "Polygon" else metres if kind == "MultiPolygon" else []:
        for ring in area:
            a = np.array(ring)
            if len(a) < 4 or (a[0] != a[-1]).any() or geometry.self_crossing(a[np.r_[True, (np.diff(a, axis=0) != 0).any(1)]]):
                raise Refused("geometry", "invalid geometry: ring open or meets itself")


def _flat(c):
    if isinstance(c, list):
        for x in c:
            yield from _flat(x)
    else:
        yield c


def feature_row(district: str, pos: int, f: dict) -> dict:
    """A typed feature, or the first rule it breaks."""
    row = dict.fromkeys((c.split()[0] for c in FEATURE.split(", ")))
    row |= {"district": district, "pos": pos}
    props = f.get("properties")
    try:
        value = props.get("id") if isinstance(props, dict) else None
        row["id_key"] = id_key(value)
        row["id_json"] = json.dumps(value, ensure_ascii=False) if isinstance(value, str) else str(value)
        if f.get("type") != "Feature":
            raise Refused("feature", "a Feature with properties is expected")
        row["object_type"] = kind = props.get("object_type") if isinstance(props.get("object_type"), str) else ""
        row["geometry_type"], wgs = _coordinates(f.get("geometry"))
        metres = _metres(wgs, _DEPTH[row["geometry_type"]])
        _check(row["geometry_type"], metres)
        if kind not in _GEOMETRY:
            raise Refused("properties.object_type", f"unknown object_type {kind}")
        if row["geometry_type"] not in _GEOMETRY[kind]:
            raise Refused("geometry", f"{kind} can't be a {row['geometry_type']}")
        row["coords"] = json.dumps(metres)
        if kind == "heat_network":
            dn = props.get("diameter")
            if isinstance(dn, bool) or not isinstance(dn, int) or dn not in _KNOWN_DN:
                raise Refused("properties.diameter", "unknown diameter")
            row["diameter"] = dn
        elif kind == "oks_connection_point":
            flow = props.get("flow_tph")
            if isinstance(flow, bool) or not isinstance(flow, (int, Decimal)) or not 0 < float(flow) < float("inf"):
                raise Refused("properties.flow_tph", "flow_tph must be a finite positive number")
            row["flow"] = float(flow)
        elif kind == "restriction":
            rt = props.get("restriction_type")
            if not isinstance(rt, str) or not rt.strip():
                raise Refused("properties.restriction_type", "restriction_type is missing")
            row["restriction_type"] = rt
            own = rt.strip().lower()
            if ALIASES.get(own, own) not in {r[0] for r in RULES["heat"]}:
                row["warning"] = "unknown restriction_type: taken as forbidden"
    except Refused as e:
        row["field"], row["message"] = e.field, str(e)
    return row


def scan_text(files: DataFrame) -> DataFrame:
    """Features of files(district, text). A file that isn't one FeatureCollection gives one row with field $."""

    def run(batches):
        for batch in batches:
            for district, text in zip(batch["district"], batch["text"]):
                rows = []
                try:
                    root = parse(text)
                    if not isinstance(root, dict) or root.get("type") != "FeatureCollection" or not isinstance(root.get("features"), list) or not all(isinstance(f, dict) for f in root["features"]):
                        raise ValueError("one FeatureCollection with an array of features is expected")
                    rows = [feature_row(district, i, f) for i, f in enumerate(root["features"])]
                except (ValueError, RecursionError) as e:
                    rows = [dict.fromkeys((c.split()[0] for c in FEATURE.split(", "))) | {"district": district, "pos": -1, "field": "$", "message": f"malformed JSON: {e}"}]
                if rows:
                    out = pd.DataFrame(rows).astype(object)
                    yield out.where(out.notna(), None)

    return files.mapInPandas(run, FEATURE)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Features of all GeoJSON files under a path; district is the file's address."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("district"), F.col("value").alias("text"))
    return scan_text(files)


def diagnostics(features: DataFrame, districts: DataFrame | None = None, limit: int = MAX_DIAGNOSTICS) -> DataFrame:
    """district, severity, object_id, rule, field and message: each feature's first error, warnings, duplicate ids, missing classes.

    districts(district) lists the files looked at, so that one without any feature is reported too. A district lists
    at most ``limit`` in file order, and then says so.
    """
    from pyspark.sql import Window

    read = features.where("pos >= 0")
    place = F.row_number().over(Window.partitionBy("district", "id_key").orderBy("pos"))
    marked = read.withColumn("_again", F.col("id_key").isNotNull() & (place > 1))
    line = lambda severity, rule, field, message: [F.lit(severity).alias("severity"), "id_json", F.lit(rule).alias("rule"), field.alias("field"), message.alias("message"), "pos"]
    errors = marked.where("_again OR message IS NOT NULL").select("district", *line("ERROR", "§1.1", F.when(F.col("_again"), "properties.id").otherwise(F.col("field")), F.when(F.col("_again"), "duplicate id").otherwise(F.col("message"))))
    warnings = marked.where("NOT _again AND message IS NULL AND warning IS NOT NULL").select("district", *line("WARNING", "§1.2/§4", F.lit("properties.restriction_type"), F.col("warning")))
    broken = features.where("pos < 0").select("district", *line("ERROR", "§1", F.col("field"), F.col("message")))
    good = marked.where("NOT _again AND message IS NULL")
    counts = good.groupBy("district").agg(*[F.count_if(F.col("object_type") == k).alias(k) for k in ("source", "heat_network", "oks_connection_point")])
    known = (districts if districts is not None else features).select("district").distinct().join(features.where("pos < 0").select("district"), "district", "left_anti")
    missing = known.join(counts, "district", "left").select("district", F.explode(F.array(*[F.when(F.coalesce(F.col(k), F.lit(0)) == 0, F.lit(k)) for k in ("source", "heat_network", "oks_connection_point")])).alias("k")).where("k IS NOT NULL")
    missing = missing.select("district", F.lit("ERROR").alias("severity"), F.lit(None).cast("string").alias("id_json"), F.lit("§1.1").alias("rule"), F.lit("features").alias("field"), F.concat(F.lit("no "), F.col("k")).alias("message"), F.lit(2**31 - 1).alias("pos"))
    every = errors.unionByName(warnings).unionByName(broken).unionByName(missing)
    numbered = every.withColumn("_n", F.row_number().over(Window.partitionBy("district").orderBy("pos", "severity", "field", "message")))
    cut = numbered.where(F.col("_n") == limit + 1).select("district", F.lit("WARNING").alias("severity"), F.lit(None).cast("string").alias("id_json"), F.lit("§1").alias("rule"), F.lit(None).cast("string").alias("field"), F.lit("list of diagnostics cut").alias("message"))
    return numbered.where(F.col("_n") <= limit).drop("_n", "pos").unionByName(cut)


def typed(features: DataFrame) -> dict[str, DataFrame]:
    """The five typed tables of valid features."""
    ok = features.where("message IS NULL AND pos >= 0")
    of = lambda k, *cols: ok.where(F.col("object_type") == k).select("district", "pos", "id_key", "id_json", "coords", *cols)
    return {
        "sources": of("source"),
        "pipes": of("heat_network", "diameter"),
        "chambers": of("heat_chamber"),
        "points": of("oks_connection_point", "flow"),
        "restrictions": of("restriction", "restriction_type", "geometry_type"),
    }


def _nine(c: Column) -> Column:
    return c.cast("decimal(12,9)")


def feature_json(geometry_type: Column, positions: Column, properties: Column) -> Column:
    """One output feature as text: coordinates in degrees with nine decimals, null geometry where there are none."""
    coords = F.transform(positions, lambda p: F.concat(F.lit("["), _nine(p["lon"]).cast("string"), F.lit(","), _nine(p["lat"]).cast("string"), F.lit("]")))
    shape = F.when(geometry_type == "Point", coords[0]).otherwise(F.concat(F.lit("["), F.array_join(coords, ","), F.lit("]")))
    geom = F.when(geometry_type.isNull(), F.lit("null")).otherwise(F.concat(F.lit('{"type":"'), geometry_type, F.lit('","coordinates":'), shape, F.lit("}")))
    return F.concat(F.lit('{"type":"Feature","geometry":'), geom, F.lit(',"properties":'), properties, F.lit("}"))


def publish(lines: DataFrame, path: str, max_bytes: int = 500 << 20) -> int:
    """Write ordered feature texts(seq, json) of one result as one FeatureCollection; returns its bytes.

    Its size is summed first and one over the limit is refused. Rows are streamed in order to a temporary file, which
    then takes the place of the result in one step.
    """
    size = (lines.agg(F.sum(F.octet_length("json") + 1)).first()[0] or 0) + 50
    if size > max_bytes:
        raise ValueError(f"result of {size} bytes is over the limit of {max_bytes}")
    temporary = f"{path}.{os.getpid()}.tmp"
    with open(temporary, "w", encoding="utf-8") as f:
        f.write('{"type":"FeatureCollection","features":[')
        for i, row in enumerate(lines.orderBy("seq").select("json").toLocalIterator()):
            f.write(("," if i else "") + row["json"])
        f.write("]}")
    os.replace(temporary, path)
    return os.path.getsize(path)
