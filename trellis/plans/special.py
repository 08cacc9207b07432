"""Special stretches: where new pipes cross roads, tracks and other lines, what that asks of their pieces, and whether they keep to it.

The kernel turns each pair of a pipe's segment and an obstacle into intervals along the pipe: stretches that count as special because of
the obstacle, and stretches that come too near it. All rules are then interval arithmetic over rows: what lies too near outside every
special stretch, which set of obstacles is active between two boundaries (a sweep over all boundaries of a pipe), the factor at its middle,
and the depth at each crossing. Neighbouring pieces are met through the nodes they share.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.functions import tables as T
from trellis.operators import shared, spatial, zones
from trellis.operators.zones import EPS, KEY

#: Shortest piece that the sweep looks at, most pieces of a chain of special stretches.
LEAST_PIECE, CHAIN = 0.5, 32
_NOTHING = 1e-9
_INTERVALS = "array<struct<lo:double,hi:double>>"
FOUND = (
    "district string, variant string, key string, n int, obstacle string, "
    f"special {_INTERVALS}, tight {_INTERVALS}, angle double, at array<double>, crosses boolean, foreign boolean, tied boolean, middle boolean"
)


def obstacles(features: DataFrame, profile: str = "heat") -> DataFrame:
    """Restrictions and existing pipes (as heat_network) as shapes with the values of their rules."""
    ok = features.where("message IS NULL AND object_type IN ('restriction', 'heat_network')").where("id_key IS NOT NULL")
    kind = F.when(F.col("object_type") == "heat_network", F.lit("heat_network")).otherwise(T.canonical_type("restriction_type"))
    own = ok.select("district", F.col("id_key").alias("obstacle"), F.coalesce(kind, F.lit("unknown")).alias("kind"), F.col("geometry_type").isin("Polygon", "MultiPolygon").alias("area"), zones.rings("geometry_type", "coords").alias("rings"), F.when(F.col("object_type") == "heat_network", F.col("diameter")).alias("dn"))
    ruled = T.with_rule(own, "kind", profile)
    value = lambda name, column: F.coalesce(T.diameter_value("dn", column), F.col(f"rule_own_{name}"), F.lit(0.0))
    return ruled.select(
        "district", "obstacle", "kind", "area", "rings", (F.col("rule_kind") == "special").alias("is_special"), F.col("rule_clearance").alias("base"), F.coalesce("rule_min_angle", F.lit(0.0)).alias("min_angle"), F.col("rule_margin").alias("margin"),
        F.col("rule_k_special").alias("k"), (value("width", "width") / 2).alias("own_half"), value("height", "height").alias("own_height"), F.col("rule_own_depth").alias("own_depth"), F.coalesce("rule_vertical_clearance", F.lit(0.0)).alias("vertical"), F.coalesce("rule_under_only", F.lit(False)).alias("under_only"),
    )


def ties(features: DataFrame, net: DataFrame) -> DataFrame:
    """Nodes at which a pipe may touch the existing network: points, and chambers at which new pipes end (KEY, node, x, y)."""
    ends = net.where("kind = 'pipe'").select(*KEY, F.explode(F.array("start", "end")).alias("node")).distinct()
    xy = F.from_json("coords", "array<double>")
    old = features.where("message IS NULL AND object_type IN ('heat_chamber', 'oks_connection_point')").select("district", F.col("id_key").alias("node"), "object_type", xy[0].alias("x"), xy[1].alias("y"))
    points = old.where("object_type = 'oks_connection_point'").join(net.select(*KEY).distinct(), "district").select(*KEY, "node", "x", "y")
    made = net.where("kind = 'chamber'").select(*KEY, F.col("key").alias("node"), F.col("line")[0]["x"].alias("x"), F.col("line")[0]["y"].alias("y"))
    chambers = old.where("object_type = 'heat_chamber'").select("district", "node", "x", "y").join(ends, ["district", "node"]).select(*KEY, "node", "x", "y")
    return points.unionByName(chambers).unionByName(made.join(ends, [*KEY, "node"], "left_semi")).dropDuplicates([*KEY, "node"])


def measure(size, offset, total, within, area, passes, edge, margin, clearance, special, network, tie_x, tie_y, tie_own) -> dict:
    """What one segment of a pipe has to do with one obstacle, as intervals along the pipe. edge: x1, y1, x2, y2 in the segment's frame."""
    parts = zones.clipped(zones.inside(passes, within, size) if area else zones.touched(*edge), -margin, size + margin)
    spots = list(zip(tie_x, tie_y, tie_own)) if network else []
    # Ties that lie on the obstacle itself.
    spots = [(x, y, own) for x, y, own in spots if any(a <= 0 <= b for a, b in zones.near(edge[0] - x, edge[1] - y, edge[2] - x, edge[3] - y, EPS))]
    at_tie = lambda lo, hi, own=False: any(max(np.hypot(x - lo, y), np.hypot(x - hi, y)) <= EPS and (o or not own) for x, y, o in spots)
    here = [(lo, hi) for lo, hi in parts if hi >= -EPS and lo <= size + EPS]
    foreign = any(not at_tie(lo, hi, own=True) for lo, hi in here)
    zone = zones.clipped(zones.merged(zones.near(*edge, clearance) + (zones.inside(passes, within, size) if area else [])), 0.0, size)
    strict = zones.clipped(zones.merged(zones.near(*edge, clearance - EPS) + (zones.inside(passes, within, size) if area else [])), 0.0, size)
    angles, at, out = [], [], []
    for lo, hi in parts:
        if at_tie(lo, hi):
            continue
        for u in {lo, hi}:
            if (a := zones.least_angle(u, *edge)) is not None:
                angles.append(a)
            if -EPS <= u <= size + EPS:
                at.append(offset + min(max(u, 0.0), size))
        if not special and (lo > size + EPS or hi < -EPS):
            continue
        a, b = max(0.0, lo - margin), min(size, hi + margin)
        for c, d in zone if special else []:
            if c <= b + EPS and d >= a - EPS:
                a, b = min(a, c), max(b, d)
            elif d > c + EPS:
                out.append((c, d))
        if special and len(zone) == 1 and zone[0][0] <= _NOTHING and zone[0][1] >= size - _NOTHING:
            a, b = 0.0, size
        if b > a + EPS:
            out.append((a, b))
    # A departure from a tie can't keep the distance.
    reach = 2 * clearance + EPS
    strict = zones.without(strict, [(x - h, x + h) for x, h in ((x, (reach**2 - y * y) ** 0.5) for x, y, _ in spots if abs(y) < reach)])
    middle = total / 2 - offset
    rows = lambda pieces: [{"lo": offset + float(a), "hi": offset + float(b)} for a, b in pieces]
    return {
        "special": rows(out), "tight": rows((a, b) for a, b in strict if b - a > 1e-6), "angle": min(angles, default=None), "at": [float(u) for u in at], "crosses": bool(here),
        "foreign": foreign, "tied": any(o for *_, o in spots), "middle": bool(0 <= middle <= size and any(a <= middle <= b for a, b in zone)),
    }


def intervals(features: DataFrame, net: DataFrame, profile: str = "heat", held: list | None = None) -> DataFrame:
    """KEY, key, obstacle and what its pipe and obstacle have to do with each other, for every new pipe and special obstacle near it."""
    shapes = shared.written(obstacles(features, profile).where("is_special"), "obstacles", held)
    pipes = net.where("kind = 'pipe'").select(*KEY, "key", "start", "end", "line", "laying", "diameter")
    half = F.coalesce(T.diameter_value("diameter", "width"), F.lit(0.0)) / 2
    cut = spatial.segments(pipes, "line", *KEY, "key", "start", "end", "laying", "diameter").withColumn("size", F.hypot(F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")))
    along = Window.partitionBy(*KEY, "key")
    cut = shared.written(cut.withColumn("total", F.sum("size").over(along)).withColumn("offset", F.sum("size").over(along.orderBy("n")) - F.col("size")), "segments", held)
    near = zones.local(pipes, shapes)
    # Ties near each segment, in its frame.
    spots = ties(features, net).select("*", spatial.tile("x", zones.TILE).alias("tx"), spatial.tile("y", zones.TILE).alias("ty"))
    met = spatial.tiled(cut.where(f"size > {EPS}"), zones.TILE, zones.REACH).join(spots, [*KEY, "tx", "ty"])
    ux, uy = (F.col(f"b.{c}") - F.col(f"a.{c}") for c in "xy")
    dx, dy = F.col("x") - F.col("a.x"), F.col("y") - F.col("a.y")
    spot = F.struct(((dx * ux + dy * uy) / F.col("size")).alias("x"), ((dy * ux - dx * uy) / F.col("size")).alias("y"), F.col("node").isin(F.col("start"), F.col("end")).alias("own"))
    spots = met.groupBy(*KEY, "key", "n").agg(F.collect_list(spot).alias("_t"))
    value = shapes.select("district", "obstacle", "kind", "base", "margin", "own_half")
    asked = near.drop("size").join(cut.select(*KEY, "key", "n", "laying", "diameter", "size", "offset", "total"), [*KEY, "key", "n"]).join(spots, [*KEY, "key", "n"], "left").join(value, ["district", "obstacle"])
    asked = asked.select(
        *KEY, "key", "n", "obstacle", "area", "size", "offset", "total", "within", "passes", "x1", "y1", "x2", "y2", "margin", (T.clearance("kind", "diameter", "base") + half + F.col("own_half")).alias("clearance"),
        (F.col("laying") == "special").alias("is_special"), (F.col("kind") == "heat_network").alias("network"), *[F.coalesce(F.col(f"_t.{c}"), F.array().cast(f"array<{t}>")).alias(f"tie_{c}") for c, t in (("x", "double"), ("y", "double"), ("own", "boolean"))],
    )

    def run(batches):
        for pdf in batches:
            made = [
                measure(r.size, r.offset, r.total, bool(r.within), bool(r.area), np.asarray(r.passes, float), tuple(np.asarray(x, float) for x in (r.x1, r.y1, r.x2, r.y2)), r.margin, r.clearance, bool(r.is_special), bool(r.network), r.tie_x, r.tie_y, r.tie_own)
                for r in pdf.itertuples(index=False)
            ]
            yield pd.concat([pdf[[*KEY, "key", "n", "obstacle"]].reset_index(drop=True), pd.DataFrame(made, columns=["special", "tight", "angle", "at", "crosses", "foreign", "tied", "middle"])], axis=1)

    found = asked.mapInPandas(run, FOUND)
    flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
    whole = found.groupBy(*KEY, "key", "obstacle").agg(flat("special"), flat("tight"), F.min("angle").alias("angle"), flat("at"), *[F.bool_or(c).alias(c) for c in ("crosses", "foreign", "tied", "middle")])
    return whole.join(shapes.drop("rings", "area", "is_special"), ["district", "obstacle"])


def chained(pieces: DataFrame, crossing: DataFrame, hops: int = CHAIN, held: list | None = None) -> DataFrame:
    """(KEY, key, obstacle) of special pieces that hang together, over shared nodes and other special pieces, with another one that crosses the obstacle.

    pieces: KEY, key, start, end; crossing: KEY, key, obstacle. Each round hands the smallest and the largest crossing piece known on to the
    neighbours, so a piece that knows another than itself is chained, and cycles end when nothing changes.
    """
    ends = pieces.select(*KEY, "key", F.explode(F.array("start", "end")).alias("node"))
    beside = shared.written(ends.join(ends.withColumnRenamed("key", "other"), [*KEY, "node"]).where("key <> other").select(*KEY, "key", "other").distinct(), "beside", held)
    seed = crossing.join(pieces.select(*KEY, "key"), [*KEY, "key"]).select(*KEY, "key", "obstacle", F.col("key").alias("low"), F.col("key").alias("high"))
    known = shared.written(seed.withColumn("fresh", F.lit(True)), "chains", held)
    for _ in range(hops):
        if known.where("fresh").isEmpty():
            break
        told = known.where("fresh").withColumnRenamed("key", "other").join(beside, [*KEY, "other"]).select(*seed.columns)
        old = known.select(*seed.columns, F.col("low").alias("_low"), F.col("high").alias("_high"))
        after = old.unionByName(told, allowMissingColumns=True).groupBy(*KEY, "key", "obstacle").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("_low").alias("_low"), F.max("_high").alias("_high"))
        fresh = F.col("_low").isNull() | (F.col("low") != F.col("_low")) | (F.col("high") != F.col("_high"))
        known = shared.written(after.select(*seed.columns, fresh.alias("fresh")), "chains", held)
    return known.where("low <> key OR high <> key").select(*KEY, "key", "obstacle")


def _told(df: DataFrame, *rules: tuple) -> DataFrame:
    """Findings of rules (rule, message, failed, where it applies, severity) over one table, in one pass."""
    each = []
    for rule, message, failed, where, *severity in rules:
        row = F.struct(F.col("key").alias("object_id"), F.lit(rule).alias("rule"), F.lit(*severity or ["error"]).alias("severity"), F.coalesce(failed, F.lit(True)).alias("failed"), (F.lit(message) if isinstance(message, str) else message).alias("message"))
        each.append(F.when(where, row))
    return df.select(*KEY, F.inline(F.array_compact(F.array(*each))))


def _bare(tight: str, open_: str) -> Column:
    """Whether more than EPS of an interval of tight is in none of open_: a cursor moves over the sorted open ones."""

    def left(t):
        start = F.struct(t["lo"].alias("at"), F.lit(0.0).alias("gap"))
        step = lambda s, o: F.struct(F.greatest(s["at"], o["hi"]).alias("at"), F.greatest(s["gap"], F.least(o["lo"], t["hi"]) - s["at"]).alias("gap"))
        return F.aggregate(open_, start, step, lambda s: F.greatest(s["gap"], t["hi"] - s["at"])) > EPS

    return F.exists(tight, left)


def special_checks(features: DataFrame, net: DataFrame, mode: str | None = None, profile: str = "heat", held: list | None = None) -> DataFrame:
    """Checks of special stretches: straightness, angles, distances outside them, their limits, the set of obstacles, factors, and clearance in depth.

    held: the tables that were written for it, until the caller lets go of them.
    """
    length = F.aggregate(F.sequence(F.lit(1), F.size("line") - 1), F.lit(0.0), lambda a, i: a + F.hypot(F.get("line", i)["x"] - F.get("line", i - 1)["x"], F.get("line", i)["y"] - F.get("line", i - 1)["y"]))
    pipes = net.where("kind = 'pipe'").withColumn("total", length)
    met = shared.written(intervals(features, net, profile, held), "intervals", held)
    crossing = met.where("crosses").select(*KEY, "key", "obstacle")
    special = pipes.where("laying = 'special'").select(*KEY, "key", "start", "end")
    linked = chained(special, crossing, held=held)

    # Special pieces that cross something, by node: the smallest and largest tell a pipe of another from itself.
    at_node = special.join(crossing, [*KEY, "key"]).select(*KEY, "key", "obstacle", F.explode(F.array("start", "end")).alias("node"))
    ends = lambda *by: at_node.groupBy(*KEY, "node", *by).agg(F.struct(F.min("key").alias("low"), F.max("key").alias("high")).alias("near"))
    at_end = lambda name, table: table.withColumnRenamed("node", name).withColumnRenamed("near", f"_{name}")
    other = lambda name: F.coalesce((F.col(f"_{name}.low") != F.col("key")) | (F.col(f"_{name}.high") != F.col("key")), F.lit(False))

    # Pairs of a pipe and an obstacle. A pipe that only touches the existing pipe at its own tie-in isn't near it.
    pairs = met.where("NOT (kind = 'heat_network' AND tied AND NOT foreign)").join(pipes.select(*KEY, "key", "start", "end", "laying", "total", "depth_start", "depth_end", "diameter"), [*KEY, "key"])
    here = ends("obstacle")
    pairs = pairs.join(at_end("start", here), [*KEY, "start", "obstacle"], "left").join(at_end("end", here), [*KEY, "end", "obstacle"], "left").join(linked.withColumn("_chained", F.lit(True)), [*KEY, "key", "obstacle"], "left")
    on_chain = (F.col("laying") == "special") & F.coalesce("_chained", F.lit(False))
    clearance = T.clearance("kind", "diameter", "base") + F.coalesce(T.diameter_value("diameter", "width"), F.lit(0.0)) / 2 + F.col("own_half")
    base, stretch = F.col("laying") == "base", lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    whole = F.array(stretch(F.lit(0.0), F.col("total")))
    # A base piece beside a special one that crosses the obstacle starts within its distance.
    spared = F.array_compact(F.array(F.when(base & other("start"), stretch(F.lit(0.0), clearance + EPS)), F.when(base & other("end"), stretch(F.col("total") - clearance - EPS, F.col("total")))))
    pairs = pairs.select("*", on_chain.alias("on_chain"), spared.alias("spared")).withColumn("special", F.when((F.size("special") == 0) & F.col("on_chain") & F.col("middle"), whole).otherwise(F.col("special")))
    pairs = pairs.withColumn("open", F.array_sort(F.concat("special", "spared"))).drop("spared")
    pairs = shared.written(pairs, "pairs", held)
    of_pairs = [
        ("§4", F.concat(F.lit("angle of crossing too small: "), "kind"), F.col("angle") + 0.01 < F.col("min_angle"), (F.col("min_angle") > 0) & F.col("angle").isNotNull()),
        ("§4", F.concat(F.lit("too near outside a special stretch: "), "kind"), ~F.col("on_chain") & _bare("tight", "open"), F.lit(True)),
    ]
    if mode == "DEPTH_3D":
        height = F.coalesce(T.diameter_value("diameter", "height"), F.lit(0.0))

        def blocked(u):
            depth = F.col("depth_start") + (F.col("depth_end") - F.col("depth_start")) * u / F.col("total")
            above = depth + height <= F.col("own_depth") - F.col("vertical") + 0.001
            below = depth >= F.col("own_depth") + F.col("own_height") + F.col("vertical") - 0.001
            return ~F.coalesce(F.when(F.col("under_only"), depth >= F.col("vertical") - 0.001).otherwise(above | below), F.lit(True))

        of_pairs.append(("§5", F.concat(F.lit("too little room above or below: "), "kind"), F.exists("at", blocked), F.col("depth_start").isNotNull() & F.col("depth_end").isNotNull() & (F.size("at") > 0)))
    swept = _swept(pipes, pairs).join(at_end("start", ends()), [*KEY, "start"], "left").join(at_end("end", ends()), [*KEY, "end"], "left")
    is_special = F.col("laying") == "special"
    direct = F.hypot(F.element_at("line", -1)["x"] - F.col("line")[0]["x"], F.element_at("line", -1)["y"] - F.col("line")[0]["y"])
    # Pieces without a crossing of their own are no fault beside a special piece that has one.
    p = swept.withColumn("_lone", is_special & (other("start") | other("end")) & (F.col("empty") > 0)).withColumn("_k", F.when(F.col("_lone"), F.greatest("factor", F.coalesce("k_special", F.lit(1.0)))).otherwise(F.col("factor")))
    per_metre = T.diameter_value("diameter", "cost_m") * F.coalesce("k_depth", F.lit(1.0)) * F.col("_k")
    of_pipes = [
        ("§4", "a special stretch isn't straight", F.abs(F.col("total") - direct) > EPS, is_special),
        ("§4", "a special stretch without a crossing of its own, part of a chain", F.lit(True), F.col("_lone"), "warning"),
        ("§4", "laying method unlike the limits of special stretches", F.when(is_special, (F.col("empty") > 0) & ~F.col("_lone")).otherwise(F.col("filled") > 0), F.lit(True)),
        ("§4", "a node is needed where the set of crossed obstacles changes", (F.col("changes") > 0) | ((F.col("gaps") > 0) & ~F.col("_lone")), F.lit(True)),
        ("§4", "k_special", F.abs(F.col("k_special") - F.col("_k")) > 1e-8, F.col("k_special").isNotNull()),
        ("§6", "cost of a pipe by its crossings", F.abs(F.col("cost") - F.col("total") * per_metre) > F.greatest(F.lit(1.0), per_metre * F.size("line") * 0.0002), F.lit(True)),
    ]
    return _told(pairs, *of_pairs).unionByName(_told(p, *of_pipes))


def _swept(pipes: DataFrame, pairs: DataFrame) -> DataFrame:
    """pipes with what a sweep over the boundaries of their special stretches finds.

    Between two boundaries at least LEAST_PIECE apart the set of active obstacles is one: empty and filled count such pieces, changes those whose
    set differs from that before (both filled), gaps those where one of the two is empty. factor: the largest at the middle of the pipe.
    """
    at = [*KEY, "key"]
    own = pairs.select(*at, "obstacle", "k", F.inline("special"))
    bounds = own.select(*at, F.explode(F.array("lo", "hi")).alias("lo")).unionByName(pipes.select(*at, F.explode(F.array(F.lit(0.0), F.col("total"))).alias("lo"))).distinct()
    along = Window.partitionBy(*at).orderBy("lo")
    pieces = bounds.withColumn("hi", F.lead("lo").over(along)).where(F.col("hi") - F.col("lo") >= LEAST_PIECE)
    of = own.select(*at, "obstacle", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    middle = (F.col("lo") + F.col("hi")) / 2
    sets = pieces.join(of, at, "left").groupBy(*at, "lo").agg(F.sort_array(F.collect_set(F.when((F.col("_lo") <= middle) & (F.col("_hi") >= middle), F.col("obstacle")))).alias("set"))
    sets = sets.withColumn("_n", F.size("set")).withColumn("_before", F.lag("set").over(along))
    differs = F.col("_before").isNotNull() & (F.col("_before") != F.col("set"))
    full = (F.col("_n") > 0) & (F.size("_before") > 0)
    counted = sets.groupBy(*at).agg(F.count_if(F.col("_n") == 0).alias("empty"), F.count_if(F.col("_n") > 0).alias("filled"), F.count_if(differs & full).alias("changes"), F.count_if(differs & ~full).alias("gaps"))
    half = F.col("total") / 2
    factors = own.join(pipes.select(*at, "total"), at).where((F.col("lo") <= half) & (F.col("hi") >= half)).groupBy(*at).agg(F.max("k").alias("factor"))
    return pipes.join(counted, at, "left").join(factors, at, "left").na.fill(0, ["empty", "filled", "changes", "gaps"]).na.fill(1.0, ["factor"])
