"""Solving districts: typed features in, ranked variants out.

The search of one district by one strategy is one group of applyInPandas, so districts and strategies run side by side;
everything after it (prices, sums, selection, ranking, output) is one DataFrame plan over the network's rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.functions import crs
from trellis.functions import tables as T
from trellis.operators import measures, routing, selection, shared
from trellis.sources import geojson

STRATEGIES = ("flow", "nearest", "farthest", "shuffle-1", "shuffle-2")
NETWORK = (
    "district string, variant string, kind string, key string, start string, end string, line array<struct<x:double,y:double>>, lonlat array<struct<lon:double,lat:double>>, flow double, diameter int, length double, "
    "laying string, k_special double, k_depth double, depth_start double, depth_end double, crossed string, cost double, tie_in_pipe string, approach string"
)
_COLUMNS = [c.split()[0] for c in NETWORK.replace("array<struct<x:double,y:double>>", "a").replace("array<struct<lon:double,lat:double>>", "a").split(", ")]


def network(features: DataFrame, mode: str = "PLAN_2D", strategies: tuple[str, ...] = STRATEGIES, profile: str = "heat", pin: Iterable[str] = (), exclude: Iterable[str] = ()) -> DataFrame:
    """Rows of each district's network by each strategy: pipes, chambers, technical nodes, tie-ins and unconnected points.

    pin and exclude are ids, as text, of existing chambers and pipes: routes tie in to pinned ones only, if there are any,
    and to none that is excluded. An id in both raises ValueError.
    """
    pinned, excluded = frozenset(pin), frozenset(exclude)
    if both := pinned & excluded:
        raise ValueError(f"pinned and excluded at once: {', '.join(sorted(both))}")
    ok = features.where("message IS NULL AND pos >= 0").select("district", "pos", "id_key", "object_type", "diameter", "flow", "restriction_type", "geometry_type", "coords")
    spread = ok.withColumn("variant", F.explode(F.array(*map(F.lit, strategies))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("pos").to_dict("records")
        for r in rows:
            r["coords"] = json.loads(r["coords"])
        made = routing.solve(rows, pdf["variant"].iloc[0], mode, profile, pinned, excluded)
        out = []
        for r in made:
            row = dict.fromkeys(_COLUMNS) | {k: v for k, v in r.items() if k in _COLUMNS} | {"district": pdf["district"].iloc[0], "variant": pdf["variant"].iloc[0]}
            if row["kind"] == "pipe":  # sums are taken over what is written
                row |= {c: float(np.floor(row[c] * 100 + 0.5) / 100) for c in ("length", "cost")}
            line = np.array(r.get("line") or np.empty((0, 2)))
            row["line"] = [{"x": float(x), "y": float(y)} for x, y in line]
            row["lonlat"] = [{"lon": float(x), "lat": float(y)} for x, y in crs.to_wgs(line[:, 0], line[:, 1])] if len(line) else []
            out.append(row)
        made = pd.DataFrame(out, columns=_COLUMNS).astype(object)
        return made.where(made.notna(), None)

    return spread.groupBy("district", "variant").applyInPandas(run, NETWORK)


def stub_network(features: DataFrame) -> DataFrame:
    """Straight lines from each point to the nearest existing pipe, without regard to obstacles: one relational plan.

    Pipes are cut into segments; each point meets those of its district (a district is bounded), keeps the nearest
    by min, and is sized by flow and length.
    """
    t = geojson.typed(features)
    xy = "array<array<double>>"
    segs = t["pipes"].select("district", F.col("id_key").alias("pipe"), F.col("diameter").alias("old_dn"), F.from_json("coords", xy).alias("c"))
    segs = segs.select("district", "pipe", "old_dn", F.explode(F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.struct(F.get("c", i - 1).alias("a"), F.get("c", i).alias("b")))).alias("s")).select("district", "pipe", "old_dn", F.col("s.a")[0].alias("ax"), F.col("s.a")[1].alias("ay"), F.col("s.b")[0].alias("bx"), F.col("s.b")[1].alias("by"))
    pts = t["points"].select("district", "id_key", "flow", F.from_json("coords", "array<double>").alias("p")).select("district", "id_key", "flow", F.col("p")[0].alias("px"), F.col("p")[1].alias("py"))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("px") - F.col("ax")) * dx + (F.col("py") - F.col("ay")) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))))
    met = pts.join(segs, "district").withColumn("t", F.coalesce(share, F.lit(0.0)))
    met = met.withColumns({"sx": F.col("ax") + F.col("t") * dx, "sy": F.col("ay") + F.col("t") * dy})
    met = met.withColumn("length", F.hypot(F.col("sx") - F.col("px"), F.col("sy") - F.col("py")))
    best = met.groupBy("district", "id_key", "flow", "px", "py").agg(F.min(F.struct("length", "pipe", "old_dn", "sx", "sy")).alias("b")).select("district", "id_key", "flow", "px", "py", "b.*")
    sized = best.withColumn("dn", F.when(F.col("length") > 0, T.smallest_diameter("flow", "length")))
    return sized.select(
        "district", "id_key", "flow", "pipe", "sx", "sy", "px", "py", "length", "dn",
        (F.col("length") * T.diameter_value("dn", "cost_m")).alias("cost"),
        F.when(F.col("dn").isNotNull(), T.chamber_cost(F.greatest("dn", "old_dn"))).alias("chamber_cost"),
        F.when(F.col("dn").isNull(), T.penalty("flow")).otherwise(0.0).alias("penalty"),
    )


def summaries(net: DataFrame) -> DataFrame:
    """Per variant: costs, counts, length, score, unconnected points and a signature of its shape."""
    of = lambda kind, c: F.coalesce(F.sum(F.when(F.col("kind") == kind, c)), F.lit(0.0))
    s = net.groupBy("district", "variant").agg(
        of("pipe", F.col("cost")).alias("pipe_cost"),
        of("chamber", F.col("cost")).alias("chamber_cost"),
        of("existing_tie_in", F.col("flow")).cast("int").alias("tie_ins"),
        of("existing_tie_in", F.col("cost")).alias("tie_in_cost"),
        of("unconnected", F.col("cost")).alias("penalty"),
        of("pipe", F.col("length")).alias("length"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "unconnected", F.col("key")))).alias("unconnected"),
        F.count_if(F.col("kind") == "pipe").alias("n_pipes"),
        F.count_if(F.col("kind") == "chamber").alias("n_chambers"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "chamber", F.concat_ws(":", F.round(F.col("line")[0]["x"], -1).cast("bigint"), F.round(F.col("line")[0]["y"], -1).cast("bigint"))))).alias("places"),
    )
    s = s.withColumns({"construction": F.col("pipe_cost") + F.col("chamber_cost") + F.col("tie_in_cost")})
    s = s.withColumn("calculated", F.col("construction") + F.col("penalty"))
    return s.withColumn("score", T.round_half_up(T.score("calculated", "length"), 4))


def select(sums: DataFrame, most: int = 3, net: DataFrame | None = None, alike: float = 0.9) -> DataFrame:
    """Up to ``most`` variants of each district, no two of one shape, ranked by score; pareto tells those none beats in cost and length.

    With the network's rows, a variant whose route runs more than ``alike`` along a better one is left out too.
    """
    shapes = selection.best_of(sums, [F.col("district").alias("_d"), F.concat_ws("|", F.array_join("places", ","), "n_pipes", "n_chambers").alias("_s")], ["score", "variant"])
    if net is not None:
        order = lambda n: shapes.select("district", F.col("variant").alias(n), F.struct("score", "variant").alias(f"_{n}"))
        near = measures.overlaps(net).where(F.col("overlap") > alike).join(order("a"), ["district", "a"]).join(order("b"), ["district", "b"]).where("_b < _a")
        shapes = shapes.join(near.select("district", F.col("a").alias("variant")).distinct(), ["district", "variant"], "left_anti")
    ranked = shapes.withColumn("rank", F.row_number().over(Window.partitionBy("district").orderBy("score", "variant"))).where(F.col("rank") <= most)
    beaten = ranked.alias("a").join(ranked.alias("b"), F.expr("a.district = b.district AND b.calculated <= a.calculated AND b.length <= a.length AND (b.calculated < a.calculated OR b.length < a.length)"), "left_semi").select("district", "variant", F.lit(False).alias("_p"))
    return ranked.join(beaten, ["district", "variant"], "left").withColumn("pareto", F.coalesce("_p", F.lit(True))).drop("_p")


def crop(features: DataFrame, margin: float = 500.0) -> DataFrame:
    """Features near their district's points: the points' box widened by half its side or the margin, if that is more.

    Sources, points and broken rows stay. The box is one row for each district, joined back by district.
    """
    numbers = F.transform(F.filter(F.split(F.col("coords"), r"[\[\], ]+"), lambda t: t != ""), lambda t: t.cast("double"))
    even = F.filter(F.col("_n"), lambda v, i: i % 2 == 0)
    odd = F.filter(F.col("_n"), lambda v, i: i % 2 == 1)
    boxed = features.withColumn("_n", numbers).withColumns({"_x1": F.array_min(even), "_x2": F.array_max(even), "_y1": F.array_min(odd), "_y2": F.array_max(odd)}).drop("_n")
    points = boxed.where("object_type = 'oks_connection_point' AND message IS NULL")
    half = F.least(F.max("_x2") - F.min("_x1"), F.max("_y2") - F.min("_y1")) / 2
    area = points.groupBy("district").agg(*[f(c).alias(f"_a{c}") for f, c in ((F.min, "_x1"), (F.max, "_x2"), (F.min, "_y1"), (F.max, "_y2"))], F.greatest(half, F.lit(margin)).alias("_m"))
    j = boxed.join(area, "district", "left")
    inside = (F.col("_x2") >= F.col("_a_x1") - F.col("_m")) & (F.col("_x1") <= F.col("_a_x2") + F.col("_m")) & (F.col("_y2") >= F.col("_a_y1") - F.col("_m")) & (F.col("_y1") <= F.col("_a_y2") + F.col("_m"))
    keep = F.col("message").isNotNull() | F.col("object_type").isin("source", "oks_connection_point") | F.coalesce(inside, F.lit(True))
    return j.where(keep).select(*features.columns)


def without(features: DataFrame, ids: Iterable[str]) -> DataFrame:
    """Features but for the restrictions of these ids, compared as text; broken rows stay."""
    gone = list(ids)
    restriction = F.coalesce(F.col("object_type") == "restriction", F.lit(False))
    return features.where(~(restriction & F.coalesce(F.substring("id_key", 3, 2**31 - 1).isin(gone), F.lit(False)))) if gone else features


def cost_breakdown(net: DataFrame) -> DataFrame:
    """Pipe cost by diameter and by crossing, with what crossings add, in one pass of grouping sets."""
    p = net.where("kind = 'pipe'").withColumn("extra", F.col("cost") - F.col("cost") / F.col("k_special"))
    return p.groupingSets([["district", "variant", "diameter"], ["district", "variant", "crossed"]], "district", "variant", "diameter", "crossed").agg(F.sum("length").alias("length"), F.sum("cost").alias("cost"), F.sum("extra").alias("extra"))


def own_id(key: Column) -> Column:
    """The id behind a key, a number or a text as it was read."""
    rest = F.substring(key, 3, 10**6)
    return F.when(key.startswith("n:"), F.try_parse_json(rest)).otherwise(rest.cast("variant"))


def _details(net: DataFrame) -> DataFrame:
    """Per variant of one district: route metrics, and cost by diameter and by crossed types."""
    metrics = measures.route_metrics(net).drop("district").withColumn("longest_path_to", own_id(F.col("longest_path_to")))
    metrics = metrics.select("variant", F.struct(*[c for c in metrics.columns if c != "variant"]).alias("route_metrics"))
    part = F.struct(F.round("length", 2).alias("length_m"), F.round("cost", 2).alias("cost"))
    by = lambda key: F.map_from_entries(F.sort_array(F.collect_list(F.when(key.isNotNull(), F.struct(key.alias("key"), part.alias("value"))))))
    costs = cost_breakdown(net).withColumn("crossed", F.nullif(F.col("crossed"), F.lit(""))).groupBy("variant").agg(
        F.struct(by(F.concat(F.lit("DN"), F.col("diameter").cast("string"))).alias("pipes_by_diameter"), by(F.col("crossed")).alias("special_sections"), F.round(F.sum(F.when(F.col("crossed").isNotNull(), F.col("extra"))), 2).alias("special_extra_cost")).alias("cost_breakdown")
    )
    return metrics.join(costs, "variant", "left")


def result_features(net: DataFrame, chosen: DataFrame, district: str, details: bool = False) -> DataFrame:
    """Output features (seq, json) of one district: pipes, chambers, nodes and summary of each variant by rank.

    With details, summaries also carry route metrics and a breakdown of cost, which are worked out once and written first.
    """
    one = net.where(F.col("district") == district).join(chosen.where(F.col("district") == district).select("variant", "rank"), "variant")
    strip = lambda c: own_id(F.col(c))
    own = F.when(F.col("kind") == "pipe", F.to_json(F.struct(strip("key").alias("id"), F.lit("heat_network").alias("object_type"), F.col("variant").alias("variant_id"), strip("start").alias("start_node_id"), strip("end").alias("end_node_id"), F.col("flow").alias("flow_tph"), "diameter", T.round_half_up("length", 2).alias("length"), F.col("laying").alias("laying_method"), "depth_start", "depth_end", T.round_half_up("cost", 2).alias("cost"), "k_special", "k_depth", "crossed", "approach"), {"ignoreNullFields": "false"}))
    own = own.when(F.col("kind") == "chamber", F.to_json(F.struct(strip("key").alias("id"), F.lit("heat_chamber").alias("object_type"), F.col("variant").alias("variant_id"), "diameter", "cost", strip("tie_in_pipe").alias("tie_in_pipe_id")), {"ignoreNullFields": "false"}))
    own = own.when(F.col("kind") == "technical_node", F.to_json(F.struct(strip("key").alias("id"), F.lit("technical_node").alias("object_type"), F.col("variant").alias("variant_id"), F.lit("change of laying").alias("reason"))))
    place = F.create_map(*[F.lit(x) for k in enumerate(("pipe", "chamber", "technical_node")) for x in reversed(k)])
    parts = one.where(F.col("kind").isin("pipe", "chamber", "technical_node")).select(F.format_string("%03d-%d-%s", "rank", place[F.col("kind")], "key").alias("seq"), geojson.feature_json(F.when(F.col("kind") == "pipe", "LineString").otherwise("Point"), F.col("lonlat"), own).alias("json"))
    s = chosen.where(F.col("district") == district)
    s = s.join(shared.written(_details(one), "details"), "variant", "left") if details else s
    props = F.to_json(F.struct(F.concat(F.lit("summary_"), "variant").alias("id"), F.lit("variant_summary").alias("object_type"), F.col("variant").alias("variant_id"), "rank", T.round_half_up("construction", 2).alias("construction_cost"), F.col("chamber_cost").alias("chamber_construction_cost"), F.col("tie_ins").alias("existing_chamber_tie_in_count"), F.col("tie_in_cost").alias("existing_chamber_tie_in_cost"), F.col("penalty").alias("unconnected_penalty"), T.round_half_up("calculated", 2).alias("calculated_cost"), T.round_half_up("length", 2).alias("new_network_length"), "score", F.transform("unconnected", own_id).alias("unconnected_oks_ids"), F.col("pareto").alias("pareto_optimal"), *(["route_metrics", "cost_breakdown"] if details else [])))
    empty = F.lit(None).cast("array<struct<lon:double,lat:double>>")
    return parts.unionByName(s.select(F.format_string("%03d-9", "rank").alias("seq"), geojson.feature_json(F.lit(None).cast("string"), empty, props).alias("json")))
