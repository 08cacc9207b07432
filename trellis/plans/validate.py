"""Independent checks of networks: every rule is a query over the rows, and a report counts them.

Nothing of the search is used here; only the reference tables are shared. All tables carry district and variant. Rules
over one table share one pass over it; what several of them need is kept in one table by node, summed in one shuffle.
"""

from __future__ import annotations

import json
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.functions import tables as T
from trellis.operators import checks, measures, shared, spatial, zones
from trellis.operators.geometry import Shape
from trellis.plans import special, walls
from trellis.sources import geojson, results

KEY = ["district", "variant"]
EPS = 0.02
TILE = 50.0
CHECK = "district string, variant string, object_id string, rule string, severity string, failed boolean, message string"


def _rows(df: DataFrame, object_id: str, *rules: tuple) -> DataFrame:
    """Findings of rules (rule, message, condition that must hold, where it applies) over one table, in one pass."""
    each = []
    for rule, message, ok, *where in rules:
        row = F.struct(F.col(object_id).alias("object_id"), F.lit(rule).alias("rule"), F.lit("error").alias("severity"), (~F.coalesce(ok, F.lit(False))).alias("failed"), F.lit(message).alias("message"))
        each.append(F.when(where[0], row) if where else row)
    return df.select(*KEY, F.inline(F.array_compact(F.array(*each))))


def _places(t: DataFrame, *cols: str) -> DataFrame:
    """district, key, x and y of point features."""
    return t.select("district", F.col("id_key").alias("key"), F.from_json("coords", "array<double>").alias("c"), *cols).select("district", "key", F.col("c")[0].alias("x"), F.col("c")[1].alias("y"), *cols)


def _keep(df: DataFrame, held: list | None) -> DataFrame:
    """df written to the shared folder, so that plans stay short and lost executors cost nothing, and noted for whoever lets go of it."""
    return shared.written(df, "checked", held)


def hung(pipes: DataFrame, held: list | None = None) -> DataFrame:
    """By pipe: top, where the chain of pipes above it starts (null on a cycle), run, the length of its diameter up to its end, and above.

    Pointers jump: each round joins a pipe to the topmost it has met and doubles the reach, so a chain of n pipes takes log2 n
    joins over rows of one size, and a cycle ends with them. A run grows while all that was met has one diameter.
    A pipe below several keeps the one with the smallest key (the pipes above are told apart by their count at the node).
    """
    edges = pipes.select(*KEY, F.col("key").alias("pipe"), "start", "end", "diameter", "flow", "length")
    into = edges.groupBy(*KEY, F.col("end").alias("start")).agg(F.min(F.struct("pipe", "diameter", "flow")).alias("above"))
    at = edges.join(into, [*KEY, "start"], "left").dropDuplicates([*KEY, "pipe"])
    at = at.select(*KEY, "pipe", "above", F.col("above.pipe").alias("next"), F.col("start").alias("top"), F.col("length").alias("run"), F.coalesce(F.col("above.diameter") == F.col("diameter"), F.lit(False)).alias("whole"))
    at = _keep(at, held)
    most = at.groupBy(*KEY).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(most.bit_length()):
        if at.where("next IS NOT NULL").isEmpty():
            break
        up = at.select(*KEY, F.col("pipe").alias("next"), F.col("next").alias("_next"), F.col("top").alias("_top"), F.col("run").alias("_run"), F.col("whole").alias("_whole"))
        step = at.join(up, [*KEY, "next"], "left").select(*KEY, "pipe", "above", F.col("_next").alias("next"), F.coalesce("_top", "top").alias("top"), (F.col("run") + F.when(F.col("whole"), F.coalesce("_run", F.lit(0.0))).otherwise(0.0)).alias("run"), (F.col("whole") & F.coalesce("_whole", F.lit(False))).alias("whole"))
        at = _keep(step, held)
    return at.select(*KEY, "pipe", "above", F.when(F.col("next").isNull(), F.col("top")).alias("top"), "run")


def graph_checks(features: DataFrame, net: DataFrame, sums: DataFrame, mode: str | None = None, slack: float = 0.0, held: list | None = None) -> DataFrame:
    """Checks of identity, topology, flow, diameters, chambers and sums; with a mode, of its depths too.

    slack is what each position may be off in metres, as it was written with few digits. Tables that several rules read are
    written and added to held, so that the caller can let go of them once the findings are used.
    """
    t = geojson.typed(features)
    variants = sums.select(*KEY)
    here = lambda df: df.join(variants, "district")
    chambers_old, points = here(_places(t["chambers"])), here(_places(t["points"], "flow"))
    pipes = net.where("kind = 'pipe'")
    own = net.where("kind IN ('chamber', 'technical_node')").select(*KEY, "key", "kind", F.col("line")[0]["x"].alias("x"), F.col("line")[0]["y"].alias("y"), "diameter", "cost", "tie_in_pipe")
    d1, d2 = F.col("depth_start"), F.col("depth_end")
    first, last = F.col("line")[0], F.element_at("line", -1)
    ends = pipes.select(*KEY, F.col("key").alias("pipe"), "diameter", F.inline(F.array(
        F.struct(F.col("start").alias("key"), first.alias("p"), d1.alias("depth"), F.col("flow").alias("flow_out")),
        F.struct(F.col("end").alias("key"), last.alias("p"), d2.alias("depth"), F.lit(None).cast("double").alias("flow_out")))))

    # Links of the existing network with every chamber: its segments, cut once, meet the chambers in their tiles.
    xy = t["pipes"].select("district", F.col("id_key").alias("old"), F.col("diameter").alias("old_dn"), F.transform(F.from_json("coords", "array<array<double>>"), lambda c: F.struct(c[0].alias("x"), c[1].alias("y"))).alias("c"))
    cut = spatial.tiled(spatial.segments(xy.select("*", F.col("c")[0].alias("f"), F.element_at("c", -1).alias("l")), "c", "district", "old", "old_dn", "f", "l"), TILE, EPS)
    spots = own.where("kind = 'chamber'").select(*KEY, "key", "x", "y").unionByName(chambers_old)
    j = spots.select("*", spatial.tile("x", TILE).alias("tx"), spatial.tile("y", TILE).alias("ty")).join(cut, ["district", "tx", "ty"])
    dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    share = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - F.col("a.x")) * dx + (F.col("y") - F.col("a.y")) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)))), F.lit(0.0))
    near = j.where(F.hypot(F.col("a.x") + share * dx - F.col("x"), F.col("a.y") + share * dy - F.col("y")) <= EPS)
    tip = (F.hypot(F.col("f.x") - F.col("x"), F.col("f.y") - F.col("y")) <= EPS) | (F.hypot(F.col("l.x") - F.col("x"), F.col("l.y") - F.col("y")) <= EPS)
    old = _keep(near.groupBy(*KEY, "key", "old").agg(F.max("old_dn").alias("old_dn"), F.min(F.when(tip, 1).otherwise(2)).alias("old_degree")), held)

    # One row for each node, from all that is said about it.
    said = [
        ends.select(*KEY, "key", F.lit(1).alias("degree"), F.col("diameter").alias("dn"), "depth", "flow_out"),
        old.select(*KEY, "key", "old_degree", "old_dn"),
        own.select(*KEY, "key", "x", "y", F.when(F.col("kind") == "chamber", 1).alias("made"), F.when(F.col("kind") == "technical_node", 1).alias("tech"), F.when(F.col("kind") == "chamber", F.col("diameter")).alias("own_dn"), F.when(F.col("kind") == "chamber", F.col("cost")).alias("cost"), "tie_in_pipe"),
        chambers_old.select(*KEY, "key", "x", "y", F.lit(1).alias("stood")),
        points.select(*KEY, "key", "x", "y", F.lit(1).alias("point"), "flow"),
        net.where("kind = 'unconnected'").select(*KEY, "key", F.lit(1).alias("listed")),
    ]
    many = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    node = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), said).groupBy(*KEY, "key").agg(
        *map(many, ("degree", "old_degree", "listed", "made", "stood", "tech", "point")),
        *[F.max(c).alias(c) for c in ("dn", "old_dn", "own_dn", "cost", "tie_in_pipe", "flow")],
        *[F.min(c).alias(c) for c in ("x", "y")],
        (F.max("depth") - F.min("depth")).alias("step"),
        F.coalesce(F.sum("flow_out"), F.lit(0.0)).alias("flow_out"),
    )
    node = _keep(node, held)
    used, chamber = F.col("degree") > 0, (F.col("made") > 0) | (F.col("stood") > 0)
    largest = F.greatest(F.coalesce("dn", F.lit(0)), F.coalesce("old_dn", F.lit(0)))
    rules = [
        ("§2.1", "branch outside a chamber", (F.col("degree") <= 2) | chamber, used),
        ("§2.1", "a point must be a leaf", F.col("degree") == 1, used & (F.col("point") > 0)),
        ("§2.1", "a technical node joins two pipes", F.col("degree") == 2, F.col("tech") > 0),
        ("§2.1", "more than four links with the existing network", F.col("degree") + F.col("old_degree") <= T.MAX_LINKS, used & chamber),
        ("§3.2", "chamber's diameter isn't the largest at it", (F.col("own_dn") == largest) & (largest > 0), F.col("made") > 0),
        ("§3.2", "chamber's cost", F.abs(F.col("cost") - T.chamber_cost(largest)) <= 0.01, F.col("made") > 0),
    ]
    if mode != "PLAN_2D":
        rules.append(("§5", "depth changes at a node", F.col("step").isNull() | (F.col("step") <= 0.001), used))
    out = [_rows(node, "key", *rules)]

    made = net.where("kind IN ('pipe', 'chamber', 'technical_node')").groupBy(*KEY, "key").agg(F.count("*").alias("n"))
    old_ids = features.where("message IS NULL AND id_key IS NOT NULL").select("district", F.col("id_key").alias("key")).distinct().withColumn("_old", F.lit(True))
    out.append(_rows(made.join(old_ids, ["district", "key"], "left"), "key", ("§7", "new id equals an input id", F.col("_old").isNull()), ("§7", "new id repeated", F.col("n") == 1)))
    at = ends.join(node.select(*KEY, "key", "x", "y"), [*KEY, "key"], "left")
    out.append(_rows(at, "pipe", ("§7.2", "end of a pipe isn't at its node", F.hypot(F.col("x") - F.col("p.x"), F.col("y") - F.col("p.y")) <= EPS)))

    tied = node.where("made > 0 AND tie_in_pipe IS NOT NULL").join(old.select(*KEY, "key", F.col("old").alias("tie_in_pipe"), F.lit(True).alias("_on")), [*KEY, "key", "tie_in_pipe"], "left")
    out.append(_rows(tied, "key", ("§2.4", "tie-in chamber isn't on its pipe", F.col("_on").isNotNull())))
    known = node.where("stood > 0").select(*KEY, F.col("x").alias("cx"), F.col("y").alias("cy"), (F.col("degree") + F.col("old_degree")).alias("_links"), spatial.tile("x", T.SNAP).alias("tx"), spatial.tile("y", T.SNAP).alias("ty"))
    new = node.where("made > 0 AND old_degree > 0").select(*KEY, "key", "x", "y", "degree")
    close = spatial.around(new, "x", "y", T.SNAP).join(known, [*KEY, "tx", "ty"]).where(F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")) <= T.SNAP)
    out.append(_rows(close, "key", ("§2.4", "new chamber within 10 m of a usable one", F.col("_links") + F.col("degree") > T.MAX_LINKS)))

    # What a pipe hangs on, and what hangs on it.
    roots = node.where("old_degree > 0 AND degree > 0").select(*KEY, F.col("key").alias("top"), F.lit(True).alias("_root"))
    arrivals = pipes.groupBy(*KEY, "end").agg(F.count("*").alias("arrivals"))
    below = node.select(*KEY, F.col("key").alias("end"), (F.coalesce("flow", F.lit(0.0)) + F.col("flow_out")).alias("flow_below"), ((F.col("old_degree") > 0)).alias("end_is_root"))
    hang = hung(pipes, held).join(roots, [*KEY, "top"], "left").withColumnRenamed("pipe", "key")
    p = _keep(pipes.join(hang, [*KEY, "key"], "left").join(arrivals, [*KEY, "end"], "left").join(below, [*KEY, "end"], "left"), held)
    ln = F.aggregate(F.sequence(F.lit(1), F.size("line") - 1), F.lit(0.0), lambda a, i: a + F.hypot(F.get("line", i)["x"] - F.get("line", i - 1)["x"], F.get("line", i)["y"] - F.get("line", i - 1)["y"]))
    per_metre = T.diameter_value("diameter", "cost_m") * F.coalesce("k_special", F.lit(1.0)) * F.coalesce("k_depth", F.lit(1.0))
    up = F.col("above")
    rules = [
        ("§2.1/§2.4", "a pipe must hang on exactly one root, without a cycle", F.col("_root") & (F.col("arrivals") == 1) & ~F.col("end_is_root")),
        ("§2.3", "flow", F.abs(F.col("flow") - F.col("flow_below")) <= 0.0051),
        ("§2.3", "diameter falls toward the root", up.isNull() | (up["diameter"] >= F.col("diameter"))),
        ("§2.3", "a run of one diameter is too long", F.col("run") <= T.diameter_value("diameter", "max_run") + EPS),
        ("§2.3", "diameter changes without a change of flow", up.isNull() | (F.abs(up["flow"] - F.col("flow")) > 1e-6) | (up["diameter"] == F.col("diameter"))),
        ("§2.3", "diameter below the smallest for its flow", F.col("diameter") >= T.smallest_diameter("flow")),
        ("§6", "cost of a pipe", F.abs(F.col("cost") - ln * per_metre) <= 0.01 + per_metre * F.size("line") * slack),
        ("§7", "length of a pipe", F.abs(F.col("length") - ln) <= 0.0051 + F.size("line") * 0.0002),
    ]
    if mode == "PLAN_2D":
        rules.append(("§5/§7", "depths in a plan", d1.isNull() & d2.isNull()))
    else:
        none = d1.isNull() & d2.isNull() & F.lit(mode is None)
        deep = (F.least(d1, d2) >= T.MIN_DEPTH) & (F.abs(d1 - d2) <= T.SLOPE * ln + 0.011)
        factor = (T.depth_factor(d1) + T.depth_factor(d2)) / 2
        rules.append(("§5", "depths", none | (d1.isNotNull() & d2.isNotNull() & deep)))
        rules.append(("§5", "a node is needed at the usual depth", none | ((d1 - T.DEPTH) * (d2 - T.DEPTH) >= -1e-8)))
        rules.append(("§5", "k_depth", none | (F.abs(F.col("k_depth") - factor) <= 1e-8), F.col("k_depth").isNotNull()))
    out.append(_rows(p, "key", *rules))

    reached = p.where("_root").select(*KEY, F.col("end").alias("key"), F.lit(True).alias("_on")).distinct()
    state = node.where("point > 0 OR listed > 0").join(reached, [*KEY, "key"], "left")
    out.append(_rows(state, "key", ("§2.5/§7", "a point is either connected or listed once", (F.col("point") > 0) & (F.col("_on").isNotNull() != (F.col("listed") == 1)) & (F.col("listed") <= 1))))

    built = net.groupBy(*KEY).agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col(c))), F.lit(0.0)).alias(n) for k, c, n in (("pipe", "cost", "_p"), ("chamber", "cost", "_c"), ("pipe", "length", "_l"))])
    extra = node.groupBy(*KEY).agg(F.sum(F.when(F.col("stood") > 0, F.col("degree"))).alias("_t"), F.sum(F.when((F.col("listed") > 0) & (F.col("point") > 0), T.penalty("flow"))).alias("_f"))
    s = sums.join(built, KEY, "left").join(extra, KEY, "left").na.fill(0, ["_p", "_c", "_l", "_t", "_f"])
    cost = F.col("_p") + F.col("_c") + F.col("_t") * T.TIE_IN_COST
    want = [("chamber_cost", F.col("_c"), 0.01), ("tie_ins", F.col("_t"), 0), ("tie_in_cost", F.col("_t") * T.TIE_IN_COST, 0.01), ("construction", cost, 0.01), ("penalty", F.col("_f"), 0.01), ("calculated", cost + F.col("_f"), 0.01), ("length", F.col("_l"), 0.01), ("score", T.score(cost + F.col("_f"), F.col("_l")), 0.000051)]
    out.append(_rows(s, "variant", *[("§6", f"summary: {name}", F.abs(F.col(name) - w) <= eps) for name, w, eps in want]))
    return reduce(DataFrame.unionByName, out)


def pipe_crossings(pipes: DataFrame) -> DataFrame:
    """KEY, key and other of new pipes that meet anywhere but at a node they share. Segments meet in their tiles."""
    seg = spatial.segments(pipes.select("*", F.col("line")[0].alias("first"), F.element_at("line", -1).alias("last")), "line", *KEY, "key", "start", "end", "first", "last")
    cut = spatial.tiled(seg, TILE, EPS)
    names = ["key", "start", "end", "first", "last", "a", "b"]
    left, right = (cut.select(*KEY, "tx", "ty", F.struct(*names).alias(n)) for n in "lr")
    met = left.join(right, [*KEY, "tx", "ty"]).where("l.key < r.key")
    c = lambda path: F.col(path)
    rx, ry, sx, sy = c("l.b.x") - c("l.a.x"), c("l.b.y") - c("l.a.y"), c("r.b.x") - c("r.a.x"), c("r.b.y") - c("r.a.y")
    wx, wy, cross = c("r.a.x") - c("l.a.x"), c("r.a.y") - c("l.a.y"), rx * sy - ry * sx
    met = met.where(F.abs(cross) > 1e-9).withColumns({"t": (wx * sy - wy * sx) / cross, "u": (wx * ry - wy * rx) / cross}).where("t BETWEEN -1e-9 AND 1 + 1e-9 AND u BETWEEN -1e-9 AND 1 + 1e-9")
    hx, hy = c("l.a.x") + rx * c("t"), c("l.a.y") + ry * c("t")
    at = lambda name, p: c(f"l.{name}").isin(c("r.start"), c("r.end")) & (F.hypot(hx - c(f"l.{p}.x"), hy - c(f"l.{p}.y")) <= EPS)
    shared = F.coalesce(at("start", "first"), F.lit(False)) | F.coalesce(at("end", "last"), F.lit(False))
    return met.where(~shared).select(*KEY, c("l.key").alias("key"), c("r.key").alias("other")).distinct()


def near_obstacles(features: DataFrame, pipes: DataFrame, profile: str = "heat", spared: DataFrame | None = None) -> DataFrame:
    """KEY, key, obstacle, kind and bad of each new pipe and each forbidden obstacle in whose tiles it runs; bad where it comes too near.

    An obstacle's tiles are those along its edges, widened by the largest clearance, and for what may lie inside it a few as wide as its box. Pairs are
    found by keys alone; coordinates of an obstacle join them once, and each batch of pairs is measured by the kernel. The last segment may enter what covers its point, and
    what spared (district, point, obstacle) lists for it.
    """
    rules = T.RULES[profile]
    known, allowed = [r[0] for r in rules], [r[0] for r in rules if r[1] != "forbidden"]
    kind = T.canonical_type("restriction_type")
    lost = T.unknown_rule(profile)
    default = F.lit(lost[2])
    base = reduce(lambda c, r: c.when(kind == r[0], F.lit(r[2])), rules[1:], F.when(kind == rules[0][0], F.lit(rules[0][2]))).otherwise(default)
    forbidden = ~kind.isin(allowed) if lost[1] == "forbidden" else kind.isin([k for k in known if k not in allowed])
    areas = features.where("message IS NULL AND object_type = 'restriction'").where(F.coalesce(forbidden, F.lit(True))).select("district", F.col("id_key").alias("obstacle"), F.coalesce(kind, F.lit("unknown")).alias("kind"), base.alias("base"), "geometry_type", "coords")
    size = 4 * TILE
    reach = max([r[2] for r in rules] + [9.0]) + max(r[4] for r in T.DIAMETERS) / 2
    areas = shared.written(areas.withColumns({"area": F.col("geometry_type").isin("Polygon", "MultiPolygon"), "rings": zones.rings("geometry_type", "coords")}), "forbidden")
    points = _places(geojson.typed(features)["points"]).select("district", F.col("key").alias("end"), F.struct("x", "y").alias("point")).dropDuplicates(["district", "end"])
    cut = spatial.segments(pipes.select("*", F.size("line").alias("_size")), "line", *KEY, "key", "end", "diameter", "_size")
    at = [*KEY, "key", "n"]
    border = spatial.tiled(zones.edges(areas), size, reach).select("district", "obstacle", "tx", "ty").distinct()
    near = spatial.tiled(cut.select(*at, "a", "b"), size, 0.0).join(border, ["district", "tx", "ty"]).select(*at, "obstacle")
    inner = zones.containing(cut.select(*at, F.col("a.x").alias("x"), F.col("a.y").alias("y")), areas).select(*at, "obstacle")
    pairs = near.unionByName(inner).distinct().join(cut, at)
    pairs = pairs.join(points, ["district", "end"], "left").join(areas.drop("rings", "area"), ["district", "obstacle"])
    if spared is not None:
        free = spared.select("district", F.col("point").alias("end"), "obstacle", F.lit(True).alias("_free"))
        pairs = pairs.join(free, ["district", "end", "obstacle"], "left").where(~F.coalesce(F.col("_free") & (F.col("n") == F.col("_size") - 1), F.lit(False)))
    need = T.clearance("kind", "diameter", "base") + F.coalesce(T.diameter_value("diameter", "width"), F.lit(0.0)) / 2
    flat = pairs.select(*KEY, "key", "obstacle", "kind", need.alias("need"), "a.x", "a.y", F.col("b.x").alias("x2"), F.col("b.y").alias("y2"), F.when(F.col("n") == F.col("_size") - 1, F.col("point.x")).alias("px"), F.when(F.col("n") == F.col("_size") - 1, F.col("point.y")).alias("py"), "geometry_type", "coords")

    def measure(batches):
        for pdf in batches:
            shapes, bad = {}, []
            for r in pdf.itertuples():
                name = (r.geometry_type, r.coords)
                if name not in shapes:
                    c, g = json.loads(r.coords), r.geometry_type
                    parts = {"Polygon": lambda c: [c], "MultiPolygon": lambda c: c, "LineString": lambda c: [[c]], "MultiLineString": lambda c: [[x] for x in c]}[g](c)
                    shapes[name] = Shape([[np.array(x) for x in p] for p in parts], "Polygon" in g)
                shape, a, b = shapes[name], np.array([r.x, r.y]), np.array([r.x2, r.y2])
                inside = r.px == r.px and r.px is not None and shape.covers(np.array([r.px, r.py]))
                bad.append(bool(not inside and shape.box_distance(a, b) < r.need and shape.segment_distance(a, b) < r.need - EPS))
            yield pdf[["district", "variant", "key", "obstacle", "kind"]].assign(bad=pd.Series(bad, index=pdf.index, dtype=bool))

    found = flat.mapInPandas(measure, "district string, variant string, key string, obstacle string, kind string, bad boolean")
    return found.groupBy(*KEY, "key", "obstacle", "kind").agg(F.max("bad").alias("bad"))


def spatial_checks(features: DataFrame, net: DataFrame, profile: str = "heat", spared: DataFrame | None = None) -> DataFrame:
    """Checks of turns, of crossings between new pipes and of clearances to forbidden obstacles: joins by tiles, no district in one task."""
    pipes = net.where("kind = 'pipe'").select(*KEY, "key", "start", "end", "line", "diameter")
    straight = F.forall(measures.turns("line"), lambda a: a <= T.MAX_TURN + 0.01)
    out = _rows(pipes, "key", ("§2.1", "turn over a right angle", straight))
    told = lambda df, rule, failed, message: df.select(*KEY, F.col("key").alias("object_id"), F.lit(rule).alias("rule"), F.lit("error").alias("severity"), failed.alias("failed"), message.alias("message"))
    out = out.unionByName(told(pipe_crossings(pipes), "§2.1", F.lit(True), F.concat(F.lit("crosses "), "other", F.lit(" outside a common node"))))
    return out.unionByName(told(near_obstacles(features, pipes, profile, spared), "§3.1/§4", F.col("bad"), F.concat(F.lit("too near to "), "kind")))


def rank_checks(chosen: DataFrame) -> DataFrame:
    """Ranks are 1..n and scores don't fall with them."""
    from pyspark.sql import Window

    w = Window.partitionBy("district").orderBy("rank", "variant")
    r = chosen.select(*KEY, "rank", "score", F.row_number().over(w).alias("_n"), F.lag("score").over(w).alias("_s"))
    return _rows(r, "variant", ("§6", "rank", F.col("rank") == F.col("_n")), ("§6", "order of scores", F.col("_s").isNull() | (F.col("score") >= F.col("_s"))))


def refusals(read: DataFrame) -> DataFrame:
    """One failed check for each result file that can't be read."""
    f = results.faults(read)
    return f.select("district", F.lit(None).cast("string").alias("variant"), F.lit(None).cast("string").alias("object_id"), F.lit("§7").alias("rule"), F.lit("error").alias("severity"), F.lit(True).alias("failed"), "message")


def result_checks(features: DataFrame, read: DataFrame, mode: str | None = None, profile: str = "heat", held: list | None = None) -> DataFrame:
    """All checks of result files (as ``results.scan`` reads them) against the districts they answer.

    A refused file has one row alone. Positions have nine decimals of a degree, 0.0002 m. held: as in ``graph_checks``.
    """
    read = _keep(read, held)
    net, sums = (_keep(df, held) for df in results.tables(read))
    found = graph_checks(features, net, sums, mode, slack=0.0002, held=held).unionByName(spatial_checks(features, net, profile, walls.spared(features, profile, held))).unionByName(rank_checks(sums))
    found = found.unionByName(special.special_checks(features, net, mode, profile, held=held)).unionByName(walls.wall_checks(features, net, profile, held))
    return found.unionByName(refusals(read))


def report(found: DataFrame) -> DataFrame:
    """Per district: validity, errors and warnings."""
    bad = F.col("failed").cast("int")
    return found.groupBy("district").agg((F.sum(F.when(F.col("severity") == "error", bad).otherwise(0)) == 0).alias("valid"), F.sum(F.when(F.col("severity") == "error", bad).otherwise(0)).alias("errors"), F.sum(F.when(F.col("severity") == "warning", bad).otherwise(0)).alias("warnings"), F.count("*").alias("checks"))


def rule_summary(found: DataFrame) -> DataFrame:
    """Per rule: checks, errors, warnings."""
    return checks.summary(found)
