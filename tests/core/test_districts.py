import json

import pytest
from pyspark.sql import functions as F

from trellis.functions import crs
from trellis.plans import solve, special, validate, walls
from trellis.sources import geojson, results

MAIN = [("src", "source", [180, 0], {}), ("net_1", "heat_network", [[-150, 0], [0, 0]], {"diameter": 300}), ("net_2", "heat_network", [[0, 0], [180, 0]], {"diameter": 300}), ("ch_1", "heat_chamber", [0, 0], {})]


def box(x1, y1, x2, y2):
    return [[x1, y1], [x2, y1], [x2, y2], [x1, y2], [x1, y1]]


def point(name, x, y, flow=20.0):
    return (name, "oks_connection_point", [x, y], {"flow_tph": flow})


def wall(name, kind, *rings):
    return (name, "restriction", list(rings), {"restriction_type": kind})


CASES = {
    "straight": [point("a", 0, 100)],
    "detour": [wall("b", "oks", box(-40, 30, 40, 70)), wall("t", "building", box(-20, 110, 20, 140)), point("a", 0, 125)],
    "road": [wall("r", "road", box(-300, 40, 300, 60)), point("a", 0, 100)],
    "trunk": [point("a", -15, 300), point("b", 15, 300)],
    "courtyard": [wall("u", "oks", box(-40, 95, 40, 170), box(-25, 100, 25, 150)[::-1]), point("a", -32, 130)],
    "long": [point("a", 0, 450)],
    "school": [wall("s", "school", box(-70, 60, 70, 200)), wall("o", "oks", box(-25, 110, 25, 150)), point("a", 0, 130)],
    "gas": [("g", "restriction", [[-300, 50], [300, 50]], {"restriction_type": "gas"}), point("a", 0, 100)],
    "near": [point("a", 6, 100)],
    "trapped": [wall("w", "water", box(150, 150, 250, 250), box(160, 160, 240, 240)[::-1]), point("in", 200, 200, 10.0), point("a", 0, 100)],
    "tram": [wall("m", "tram_tracks", [[298.7, 202.7], [301.3, 197.3], [-298.7, -102.7], [-301.3, -97.3], [298.7, 202.7]]), point("a", 120, 160)],
    "two": [wall("o", "oks", box(-60, 250, 60, 290)), point("a", -40, 270, 15.0), point("b", 40, 270, 25.0)],
}


def collection(items):
    def degrees(c):
        return [round(float(v), 11) for v in crs.to_wgs(414000.0 + c[0], 6173000.0 + c[1])] if not isinstance(c[0], list) else [degrees(x) for x in c]

    def kind(c):
        return "Point" if not isinstance(c[0], list) else "LineString" if not isinstance(c[0][0], list) else "Polygon"

    return json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"id": i, "object_type": t} | p, "geometry": {"type": kind(c), "coordinates": degrees(c)}} for i, t, c, p in items]})


@pytest.fixture(scope="module")
def solved(spark):
    files = spark.createDataFrame([(k, collection(MAIN + v)) for k, v in CASES.items()], "district string, text string").repartition(8)
    features = geojson.scan_text(files).cache()
    out = {}
    for mode in ("PLAN_2D", "DEPTH_3D"):  # depths matter to one district alone
        net = solve.network(features if mode == "PLAN_2D" else features.where("district IN ('gas', 'road')"), mode, ("flow", "nearest")).cache()
        sums = solve.summaries(net).cache()
        out[mode] = (features, net, sums, solve.select(sums).cache())
    return out


def rows(solved, district, mode="PLAN_2D", rank=1):
    _, net, _, chosen = solved[mode]
    best = chosen.where((F.col("district") == district) & (F.col("rank") == rank)).first()
    return best, net.where((F.col("district") == district) & (F.col("variant") == best.variant)).collect()


def test_known_answers(solved):
    best, net = rows(solved, "straight")
    pipes = [r for r in net if r.kind == "pipe"]
    assert len(pipes) == 1 and pipes[0].diameter == 100 and abs(pipes[0].cost - 8_974_800) < 1
    assert abs(best.construction - 13_974_800) < 1 and abs(best.score - 0.6913) < 1e-4
    best, _ = rows(solved, "detour")
    assert best.unconnected == [] and best.length > 135
    best, net = rows(solved, "road")
    pipes = [r for r in net if r.kind == "pipe"]
    special = [p for p in pipes if p.laying == "special"]
    assert len(pipes) == 3 and len(special) == 1 and abs(special[0].length - 26) < 0.05 and special[0].k_special == 1.6
    assert sum(r.kind == "technical_node" for r in net) == 2
    best, net = rows(solved, "trunk")
    pipes = [r for r in net if r.kind == "pipe"]
    assert best.tie_ins + sum(r.kind == "chamber" and r.tie_in_pipe is not None for r in net) == 1
    assert len(pipes) == 3 and any(p.diameter == 125 and abs(p.flow - 40) < 1e-6 for p in pipes)
    best, net = rows(solved, "courtyard")
    last = next(r for r in net if r.kind == "pipe" and r.end == "s:a")
    assert best.unconnected == [] and last.line[-2].x < 414000 - 40
    assert [r.diameter for r in rows(solved, "long")[1] if r.kind == "pipe"] == [125]
    assert rows(solved, "school")[0].unconnected == []
    best, net = rows(solved, "near")
    assert best.tie_ins == 1 and not any(r.kind == "chamber" for r in net)
    best, net = rows(solved, "trapped")
    assert best.unconnected == ["s:in"] and best.penalty == 105_000_000
    special = [r for r in rows(solved, "tram")[1] if r.kind == "pipe" and r.laying == "special"]
    assert special and special[0].k_special == 1.75
    best, net = rows(solved, "two")
    assert best.unconnected == [] and any(r.kind == "pipe" and abs(r.flow - 40) < 1e-6 for r in net)
    _, net = rows(solved, "gas", "DEPTH_3D")
    pipes = [r for r in net if r.kind == "pipe"]
    assert len(pipes) == 5 and all(p.k_depth == 1 for p in pipes)
    assert abs(next(p for p in pipes if p.k_special > 1).depth_start - 2.41) < 1e-6


def test_own_results_pass_the_checks(solved):
    for mode, (features, net, sums, chosen) in solved.items():
        found = validate.graph_checks(features, net, sums).unionByName(validate.spatial_checks(features, net)).unionByName(validate.rank_checks(chosen)).unionByName(special.special_checks(features, net, mode)).unionByName(walls.wall_checks(features, net)).cache()
        assert found.where("failed AND severity = 'error'").collect() == [] and found.count() > (500 if mode == "PLAN_2D" else 50)
        assert validate.report(found).where("NOT valid").count() == 0
        # Out of the courtyard no route leads through the nearest wall, which the pipe says.
        warned = {(r.district, r.rule) for r in found.where("failed").collect()}
        assert warned == ({("courtyard", "§2.2")} if mode == "PLAN_2D" else set())


CORRUPTIONS = {
    "flow": ("pipe", {"flow": "flow + 1"}),
    "length": ("pipe", {"length": "length + 1"}),
    "too small": ("pipe", {"diameter": "50"}),
    "cost": ("pipe", {"cost": "cost + 1"}),
    "endpoint": ("pipe", {"end": "'s:elsewhere'"}),
    "factor": ("pipe", {"k_special": "k_special + 0.1D"}),
    "depth": ("pipe", {"depth_start": "0.1D", "depth_end": "0.1D"}),
    "id": ("pipe", {"key": "'s:ch_1'"}),
    "shift": ("pipe", {"line": "transform(line, p -> named_struct('x', p.x + 1, 'y', p.y))"}),
    "listed though connected": ("pipe", {"kind": "'unconnected'", "key": "'s:a'"}),
    "chamber price": ("chamber", {"cost": "cost - 1"}),
    "chamber diameter": ("chamber", {"diameter": "50"}),
}


SUMS = ["score", "construction", "penalty", "chamber_cost", "tie_ins", "length", "calculated"]


def test_corruptions_are_found(solved):
    """Each corruption is a district of its own, so one plan checks them all."""
    tables = [df.where("district = 'trunk'") for df in solved["PLAN_2D"][:3]]
    names = [*CORRUPTIONS, *(f"sum {c}" for c in SUMS), "none"]
    features, net, sums = (df.drop("district").withColumn("district", F.explode(F.array(*map(F.lit, names)))).select(*df.columns) for df in tables)
    for name, (kind, change) in CORRUPTIONS.items():
        net = net.withColumns({c: F.when((F.col("district") == name) & (F.col("kind") == kind), F.expr(v)).otherwise(F.col(c)) for c, v in change.items()})
    sums = sums.withColumns({c: F.when(F.col("district") == f"sum {c}", F.col(c) + 1).otherwise(F.col(c)) for c in SUMS})
    found = {r.district: r.errors for r in validate.report(validate.graph_checks(features, net.cache(), sums)).collect()}
    assert {n for n in names if not found[n]} == {"none"}


def test_output_round_trip(solved, tmp_path):
    features, net, _, chosen = solved["PLAN_2D"]
    path = str(tmp_path / "out.geojson")
    lines = solve.result_features(net, chosen, "road")
    size = geojson.publish(lines, path)
    root = geojson.parse(open(path).read())
    kinds = [f["properties"]["object_type"] for f in root["features"]]
    assert size > 0 and kinds.count("variant_summary") == chosen.where("district = 'road'").count() and kinds.count("technical_node") >= 2
    with pytest.raises(ValueError):
        geojson.publish(lines, path, max_bytes=100)
    assert solve.cost_breakdown(net).count() > 0
    stub = solve.stub_network(features).where("district = 'straight'").first()
    assert abs(stub.length - 100) < 1e-6 and stub.dn == 100 and abs(stub.cost - 8_974_800) < 1


def test_profiles(spark):
    files = spark.createDataFrame([("road", collection(MAIN + CASES["road"]))], "district string, text string")
    features = geojson.scan_text(files)
    factors = {p: {r.k_special for r in solve.network(features, strategies=("flow",), profile=p).where("laying = 'special'").collect()} for p in ("heat", "water", "cable")}
    assert factors == {"heat": {1.6}, "water": {1.5}, "cable": {1.4}}


def test_ids_keep_their_type(spark):
    keys = spark.createDataFrame([("n:12", ["s:a", "n:1.5"]), ("s:12", [])], "key string, more array<string>")
    made = keys.select(F.to_json(F.struct(solve.own_id(F.col("key")).alias("id"), F.transform("more", solve.own_id).alias("more")))).collect()
    assert [r[0] for r in made] == ['{"id":12,"more":["a",1.5]}', '{"id":"12","more":[]}']


FILE_CHANGES = {
    "flow": ("heat_network", lambda p: p.update(flow_tph=p["flow_tph"] + 1)),
    "length": ("heat_network", lambda p: p.update(length=p["length"] + 1)),
    "cost": ("heat_network", lambda p: p.update(cost=p["cost"] + 1000)),
    "diameter": ("heat_network", lambda p: p.update(diameter=50)),
    "end": ("heat_network", lambda p: p.update(end_node_id="elsewhere")),
    "factor": ("heat_network", lambda p: p.update(k_special=p["k_special"] + 0.1)),
    "special without a crossing": ("heat_network", lambda p: p.update(laying_method="special")),
    "depth in a plan": ("heat_network", lambda p: p.update(depth_start=3.0, depth_end=3.0)),
    "laying": ("heat_network", lambda p: p.update(laying_method="other")),
    "no depth": ("heat_network", lambda p: p.pop("depth_start")),
    "input id": ("heat_network", lambda p: p.update(id="ch_1")),
    "text for number": ("heat_network", lambda p: p.update(cost=str(p["cost"]))),
    "chamber price": ("heat_chamber", lambda p: p.update(cost=p["cost"] - 1)),
    "chamber diameter": ("heat_chamber", lambda p: p.update(diameter=50)),
    "type": ("heat_chamber", lambda p: p.update(object_type="heat_tower")),
    "rank": ("variant_summary", lambda p: p.update(rank=7)),
    "listed": ("variant_summary", lambda p: p.update(unconnected_oks_ids=["a"])),
    "unknown listed": ("variant_summary", lambda p: p.update(unconnected_oks_ids=["nobody"])),
    "not a list": ("variant_summary", lambda p: p.update(unconnected_oks_ids=None)),
    "other variant": ("variant_summary", lambda p: p.update(variant_id="another")),
    **{c: ("variant_summary", lambda p, c=c: p.update({c: p[c] + 1})) for c in [*results.SUMS, "existing_chamber_tie_in_count"]},
}


def test_result_file_is_read_and_checked(solved, spark, tmp_path):
    """The written file passes as it is; every change of one of its properties is found; broken files are refused whole."""
    features, net, _, chosen = solved["PLAN_2D"]
    path = str(tmp_path / "trunk.geojson")
    geojson.publish(solve.result_features(net, chosen, "trunk"), path)
    text = open(path).read()
    files = [("none", text), ("not json", text[:-1]), ("empty", '{"type":"FeatureCollection","features":[]}'), ("null", None)]
    for name, (kind, change) in FILE_CHANGES.items():
        root = json.loads(text)
        change(next(f["properties"] for f in root["features"] if f["properties"]["object_type"] == kind))
        files.append((name, json.dumps(root)))
    root = json.loads(text)
    files.append(("twice", json.dumps(root | {"features": [*root["features"], root["features"][0]]})))
    root["features"][-1]["geometry"] = {"type": "Point", "coordinates": [37, 55]}
    files.append(("summary with a place", json.dumps(root)))
    names = [f[0] for f in files]
    own = features.where("district = 'trunk'").drop("district").withColumn("district", F.explode(F.array(*map(F.lit, names)))).select(*features.columns)
    read = results.scan_text(spark.createDataFrame(files, "district string, text string")).cache()
    refused = {r.district for r in results.faults(read).collect()}
    assert refused == {"not json", "empty", "null", "laying", "no depth", "text for number", "type", "not a list", "other variant", "twice", "summary with a place"}
    found = validate.result_checks(own.cache(), read, "PLAN_2D").cache()
    errors = {r.district: r.errors for r in validate.report(found).collect()}
    assert {n for n in names if not errors[n]} == {"none"}
    assert all(errors[n] == 1 for n in refused)


def test_depths_read_back(solved, spark, tmp_path):
    features, net, _, chosen = solved["DEPTH_3D"]
    path = str(tmp_path / "gas.geojson")
    geojson.publish(solve.result_features(net, chosen, "gas"), path)
    found = validate.result_checks(features.where("district = 'gas'"), results.scan(spark, path, "gas"), "DEPTH_3D")
    assert found.where("failed").collect() == [] and found.where("rule = '§5'").count() > 10
    root = json.loads(open(path).read())
    next(f["properties"] for f in root["features"] if f["properties"].get("k_special", 1) > 1)["depth_start"] += 0.01
    text = spark.createDataFrame([("gas", json.dumps(root))], "district string, text string")
    assert "depth changes at a node" in {r.message for r in validate.result_checks(features.where("district = 'gas'"), results.scan_text(text), "DEPTH_3D").where("failed").collect()}


def test_command_line_reads_the_result(spark, tmp_path):
    from trellis.__main__ import main

    source, out = str(tmp_path / "in.geojson"), str(tmp_path / "out.geojson")
    open(source, "w").write(collection(MAIN + CASES["straight"]))
    assert main(["solve", source, out]) == 0 and main(["validate", source, out]) == 0
    report = json.load(open(out + ".validation.json"))
    assert report["valid"] and report["errorCount"] == 0 and report["ruleSummary"]["§6"]["checks"] > 0
    text = open(out).read()
    open(out, "w").write(text.replace('"flow_tph":20.0', '"flow_tph":21.0'))
    assert main(["validate", source, out]) == 2 and not json.load(open(out + ".validation.json"))["valid"]
    open(out, "w").write(text[:50])
    assert main(["validate", source, out]) == 2 and json.load(open(out + ".validation.json"))["errorCount"] == 1


def test_pinned_excluded_and_left_out(spark):
    """Ids bound the tie-ins; restrictions left out bar no route; an id can't be pinned and excluded at once."""
    near = geojson.scan_text(spark.createDataFrame([("near", collection(MAIN + CASES["near"]))], "district string, text string"))
    made = lambda **options: solve.network(near, strategies=("flow",), **options).collect()
    ties = lambda rows: [r.kind for r in rows if r.kind in ("chamber", "existing_tie_in", "unconnected")]
    chambers = [r.id_key[2:] for r in near.where("object_type = 'heat_chamber'").collect()]
    pipes = [r.id_key[2:] for r in near.where("object_type = 'heat_network'").collect()]
    assert ties(made()) == ["existing_tie_in"] and ties(made(pin=chambers)) == ["existing_tie_in"]
    assert "existing_tie_in" not in ties(made(exclude=chambers)) and "existing_tie_in" not in ties(made(pin=pipes))
    assert ties(made(exclude=chambers + pipes)) == ["unconnected"] and ties(made(pin=["nobody"])) == ["unconnected"]
    with pytest.raises(ValueError):
        made(pin=["a", "b"], exclude=["b"])
    trapped = geojson.scan_text(spark.createDataFrame([("trapped", collection(MAIN + CASES["trapped"]))], "district string, text string"))
    walls = [r.id_key[2:] for r in trapped.where("object_type = 'restriction'").collect()]
    open_ = solve.without(trapped, walls)
    assert open_.count() == trapped.count() - len(walls) and solve.without(trapped, ["src"]).count() == trapped.count()
    assert not [r for r in solve.network(open_, strategies=("flow",)).collect() if r.kind == "unconnected"]
    cropped = solve.crop(trapped)
    assert {r.object_type for r in trapped.exceptAll(cropped).collect()} <= {"restriction", "heat_network", "heat_chamber"}


def test_summary_tells_metrics_and_costs(solved, tmp_path):
    _, net, _, chosen = solved["PLAN_2D"]
    path = str(tmp_path / "road.geojson")
    geojson.publish(solve.result_features(net, chosen, "road", details=True), path)
    own = [f["properties"] for f in json.load(open(path))["features"]]
    for s in (p for p in own if p["object_type"] == "variant_summary"):
        pipes = [p for p in own if p["object_type"] == "heat_network" and p["variant_id"] == s["variant_id"]]
        assert abs(sum(x["cost"] for x in s["cost_breakdown"]["pipes_by_diameter"].values()) - sum(p["cost"] for p in pipes)) < 0.1
        assert abs(sum(x["length_m"] for x in s["cost_breakdown"]["special_sections"].values()) - sum(p["length"] for p in pipes if p["crossed"])) < 0.1
        assert s["route_metrics"]["specials"] == sum(p["laying_method"] == "special" for p in pipes)
        assert abs(s["route_metrics"]["longest_path"] - sum(p["length"] for p in pipes)) < 0.1 and s["route_metrics"]["longest_path_to"] == "a"


def test_command_line_refuses_contradictions(tmp_path):
    from trellis.__main__ import main

    with pytest.raises(SystemExit) as e:
        main(["solve", str(tmp_path / "x"), "--pin", "a,b", "--exclude", "b"])
    assert e.value.code == 2
