"""Result files read back for an independent check: nothing their writer promised is taken on trust.

Each feature is parsed and typed on its own; what holds between features (unique ids, one summary for each variant, one to
three variants) is a query over their rows. A file that breaks any of it is refused as a whole, with its first fault.
"""

from __future__ import annotations

from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.sources import geojson
from trellis.sources.geojson import Refused, id_key

RESULT = (
    "district string, pos int, kind string, key string, variant string, start string, end string, line array<struct<x:double,y:double>>, flow double, diameter int, length double, laying string, "
    "k_special double, k_depth double, depth_start double, depth_end double, cost double, tie_in_pipe string, approach string, rank int, construction double, chamber_cost double, tie_ins int, "
    "tie_in_cost double, penalty double, calculated double, score double, unconnected array<string>, message string"
)
_COLUMNS = [c.split()[0] for c in RESULT.replace("array<struct<x:double,y:double>>", "a").split(", ")]
MOST_VARIANTS = 3

#: Object types and the properties that carry numbers, as the output format names them.
PIPE, CHAMBER, NODE, SUMMARY = "heat_network", "heat_chamber", "technical_node", "variant_summary"
SUMS = {
    "construction_cost": "construction",
    "chamber_construction_cost": "chamber_cost",
    "existing_chamber_tie_in_cost": "tie_in_cost",
    "unconnected_penalty": "penalty",
    "calculated_cost": "calculated",
    "new_network_length": "length",
    "score": "score",
}


class _Missing:
    """Stands for a property that isn't there."""


def _is_number(v) -> bool:
    return not isinstance(v, bool) and isinstance(v, (int, Decimal)) and abs(float(v)) < float("inf")


def _is_id(v) -> bool:
    try:
        return v is not _Missing and id_key(v) is not None
    except Refused:
        return False


def _or_null(v, make):
    return None if v is None or v is _Missing else make(v)


#: What a property holds: the values that will do, and what the column gets from them.
_HOLDS = {
    "id": (_is_id, id_key),
    "id or nothing": (lambda v: v in (None, _Missing) or _is_id(v), lambda v: _or_null(v, id_key)),
    "array of ids": (lambda v: isinstance(v, list) and all(map(_is_id, v)), lambda v: [id_key(x) for x in v]),
    "finite number": (_is_number, float),
    "finite number or null": (lambda v: v is None or _is_number(v), lambda v: _or_null(v, float)),
    "number if any": (lambda v: True, lambda v: float(v) if _is_number(v) else None),
    "integer of 32 bits": (lambda v: type(v) is int and -(2**31) <= v < 2**31, int),
    "laying method": (lambda v: v in ("base", "special"), str),
    "text if any": (lambda v: True, lambda v: v if isinstance(v, str) else None),
}
_ALL = {"id": ("key", "id"), "variant_id": ("variant", "id")}
#: Fixed values of the output format: for each object type its kind, its geometry, and the column and content of each property.
_TYPES = {
    PIPE: ("pipe", "LineString", {
        "start_node_id": ("start", "id"), "end_node_id": ("end", "id"), "flow_tph": ("flow", "finite number"), "diameter": ("diameter", "integer of 32 bits"), "length": ("length", "finite number"),
        "laying_method": ("laying", "laying method"), "depth_start": ("depth_start", "finite number or null"), "depth_end": ("depth_end", "finite number or null"), "cost": ("cost", "finite number"),
        "k_special": ("k_special", "number if any"), "k_depth": ("k_depth", "number if any"), "approach": ("approach", "text if any"),
    }),
    CHAMBER: ("chamber", "Point", {"diameter": ("diameter", "integer of 32 bits"), "cost": ("cost", "finite number"), "tie_in_pipe_id": ("tie_in_pipe", "id or nothing")}),
    NODE: ("technical_node", "Point", {}),
    SUMMARY: ("summary", None, {"rank": ("rank", "integer of 32 bits"), "existing_chamber_tie_in_count": ("tie_ins", "integer of 32 bits"), "unconnected_oks_ids": ("unconnected", "array of ids")} | {name: (c, "finite number") for name, c in SUMS.items()}),
}


def _places(geometry, shape: str | None) -> list[dict] | None:
    """Positions in metres of a geometry of the given type; None for a feature that has none."""
    if shape is None:
        if geometry is not None:
            raise Refused("geometry", "null expected")
        return None
    found, degrees = geojson._coordinates(None if geometry is _Missing else geometry)
    if found != shape:
        raise Refused("geometry", f"{shape} expected")
    metres = geojson._metres(degrees, geojson._DEPTH[shape])
    geojson._check(shape, metres)
    return [{"x": x, "y": y} for x, y in (metres if shape == "LineString" else [metres])]


def result_row(district: str, pos: int, f: dict) -> dict:
    """A typed feature of a result, or what it breaks first: its type, a property of the table, its geometry."""
    row = dict.fromkeys(_COLUMNS) | {"district": district, "pos": pos}
    props = f.get("properties") if f.get("type") == "Feature" else None
    known = _TYPES.get(props.get("object_type") if isinstance(props, dict) and isinstance(props.get("object_type"), str) else None)
    if known is None:
        return row | {"message": "properties.object_type: a Feature of a known type expected"}
    row["kind"], shape, columns = known
    told = [(name, column, holds, props.get(name, _Missing)) for name, (column, holds) in (_ALL | columns).items()]
    wrong = next((f"properties.{name}: {holds} expected" for name, _, holds, v in told if not _HOLDS[holds][0](v)), None)
    try:
        row["line"] = _places(f.get("geometry", _Missing), shape)
    except Refused as e:
        wrong = wrong or str(e)
    return row | ({"message": wrong} if wrong else {column: _HOLDS[holds][1](v) for _, column, holds, v in told})


def scan_text(files: DataFrame) -> DataFrame:
    """Features of result files(district, text); a file that isn't one FeatureCollection, or an empty one, gives one row at -1."""

    def run(batches):
        for batch in batches:
            for district, text in zip(batch["district"], batch["text"]):
                try:
                    root = geojson.parse(text or "")
                    if not isinstance(root, dict) or root.get("type") != "FeatureCollection" or not isinstance(root.get("features"), list) or not all(isinstance(f, dict) for f in root["features"]):
                        raise ValueError("one FeatureCollection with an array of features is expected")
                    if not root["features"]:
                        raise ValueError("no variants")
                    rows = [result_row(district, i, f) for i, f in enumerate(root["features"])]
                except (ValueError, RecursionError) as e:
                    rows = [dict.fromkeys(_COLUMNS) | {"district": district, "pos": -1, "message": f"malformed result: {e}"}]
                out = pd.DataFrame(rows, columns=_COLUMNS).astype(object)
                yield out.where(out.notna(), None)

    return files.mapInPandas(run, RESULT)


def scan(spark: SparkSession, path: str, district: str) -> DataFrame:
    """Features of one result file, under the district whose input it answers, as it is now: what was kept of it before is dropped."""
    spark.catalog.refreshByPath(path)
    return scan_text(spark.read.text(path, wholetext=True).select(F.lit(district).alias("district"), F.col("value").alias("text")))


def faults(results: DataFrame) -> DataFrame:
    """district and message of the results to be refused: their first broken feature, repeated id, or summaries unlike the variants."""
    broken = results.where("message IS NOT NULL").select("district", F.struct("pos", "message").alias("f"))
    last = F.lit(2**31 - 1)
    again = results.where("key IS NOT NULL").groupBy("district", "key").agg(F.count("*").alias("n"), F.max("pos").alias("pos")).where("n > 1").select("district", F.struct("pos", F.concat(F.lit("repeated id "), "key").alias("message")).alias("f"))
    variants = results.where("variant IS NOT NULL").groupBy("district", "variant").agg(F.count_if(F.col("kind") == "summary").alias("n"))
    sets = variants.groupBy("district").agg(F.count("*").alias("variants"), F.min("n").alias("least"), F.max("n").alias("most"))
    wrong = F.when(F.col("most") > 1, "two summaries of one variant").when(F.col("variants") > MOST_VARIANTS, "one to three variants are expected").when(F.col("least") < 1, "every variant needs a summary")
    unlike = sets.select("district", F.struct(last.alias("pos"), wrong.alias("message")).alias("f")).where("f.message IS NOT NULL")
    return broken.unionByName(again).unionByName(unlike).groupBy("district").agg(F.min("f").alias("f")).select("district", "f.message")


def tables(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The network's rows and the summaries of results, as solving makes them, without the refused ones."""
    good = results.join(faults(results).select("district"), "district", "left_anti")
    parts = ["district", "variant", "kind", "key", "start", "end", "line", "flow", "diameter", "length", "laying", "k_special", "k_depth", "depth_start", "depth_end", "cost", "tie_in_pipe", "approach"]
    net = good.where("kind <> 'summary'").select(*parts)
    summary = good.where("kind = 'summary'")
    missed = summary.select("district", "variant", F.lit("unconnected").alias("kind"), F.explode("unconnected").alias("key"))
    sums = summary.select("district", "variant", "rank", "tie_ins", *SUMS.values())
    return net.unionByName(missed, allowMissingColumns=True), sums
