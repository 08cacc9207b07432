"""python -m trellis parse|solve|validate FILE [OUT] [--mode PLAN_2D|DEPTH_3D] [--engine core|stub] [--profile heat|water|cable]
[--pin IDS] [--exclude IDS] [--exclude-restriction IDS] [--crop] [--details] [--ranges].

solve writes OUT and checks what it wrote; validate reads OUT and checks it against FILE. Both leave OUT.validation.json and
end with 2 if a check fails, 3 if FILE itself can't be read.
"""

from __future__ import annotations

import argparse
import json
import sys
import time

MAX_DIAGNOSTICS = 1000
LIMITATIONS = [
    "that no permitted route exists can't be shown from one result",
    "whether variants differ in substance needs an expert",
    "the nearest wall, extents of special zones and vertical clearances aren't checked",
]


def main(args: list[str]) -> int:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from trellis.functions import tables as T
    from trellis.plans import solve, special, validate, walls
    from trellis.sources import geojson, ranges, results

    p = argparse.ArgumentParser(prog="trellis")
    p.add_argument("command", choices=["parse", "solve", "validate"])
    p.add_argument("file")
    p.add_argument("out", nargs="?")
    p.add_argument("--mode", default="PLAN_2D", choices=["PLAN_2D", "DEPTH_3D"])
    p.add_argument("--engine", default="core", choices=["core", "stub"])
    p.add_argument("--profile", default="heat", choices=list(T.RULES))
    listed = lambda text: [i.strip() for i in text.split(",") if i.strip()]
    for name, use in (("pin", "tie in to these alone"), ("exclude", "never tie in to these"), ("exclude-restriction", "leave these restrictions out")):
        p.add_argument(f"--{name}", type=listed, default=[], metavar="ID,ID", help=use)
    p.add_argument("--crop", action="store_true", help="only what lies near the points")
    p.add_argument("--details", action="store_true", help="summaries tell route metrics and a breakdown of cost")
    p.add_argument("--ranges", action="store_true", help="read FILE by byte ranges, in many tasks")
    o = p.parse_args(args)
    if o.command == "validate" and not o.out:
        p.error("validate needs OUT")
    if set(o.pin) & set(o.exclude):
        p.error("an id is pinned and excluded at once")
    spark = SparkSession.builder.getOrCreate()
    began = time.time()
    held = []
    features = (ranges.scan(spark, o.file, held) if o.ranges else geojson.scan(spark, o.file)).cache()
    held.append(features)
    errors = [r.asDict() for r in geojson.diagnostics(features).where("severity = 'ERROR'").collect()]  # at most 200 a file
    if errors:
        print(json.dumps(errors, ensure_ascii=False))
        return 3
    if o.command == "parse":
        counts = {r["object_type"]: r["count"] for r in features.groupBy("object_type").count().collect()}
        print(json.dumps({"features": counts, "seconds": round(time.time() - began, 2)}))
        return 0
    features = solve.without(features, o.exclude_restriction)
    features = solve.crop(features) if o.crop else features
    if o.engine == "stub":
        solve.stub_network(features).show(truncate=False)
        return 0
    district = features.select("district").first()[0]
    if o.command == "validate":
        return _report(validate.result_checks(features, results.scan(spark, o.out, district), o.mode, o.profile, held), o.out, held)
    net = solve.network(features, o.mode, profile=o.profile, pin=o.pin, exclude=o.exclude).cache()
    chosen = solve.select(solve.summaries(net), net=net).cache()
    held += [net, chosen]
    kept = net.join(chosen.select("district", "variant"), ["district", "variant"], "left_semi")
    print(json.dumps([r.asDict() for r in chosen.select("rank", "variant", "score", "calculated", "length", F.size("unconnected").alias("unconnected")).orderBy("rank").collect()]))  # three at most
    if o.out:
        geojson.publish(solve.result_features(kept, chosen, district, o.details), o.out)
        return _report(validate.result_checks(features, results.scan(spark, o.out, district), o.mode, o.profile, held), o.out, held)
    own = validate.graph_checks(features, kept, chosen, o.mode, held=held).unionByName(validate.spatial_checks(features, kept, o.profile, walls.spared(features, o.profile, held))).unionByName(validate.rank_checks(chosen))
    own = own.unionByName(special.special_checks(features, kept, o.mode, o.profile, held)).unionByName(walls.wall_checks(features, kept, o.profile, held))
    return _report(own, None, held)


def _report(found, out: str | None, held: list) -> int:
    """Count the checks, leave the report beside the result, let go of the tables held, and give the exit code."""
    from trellis.operators import shared
    from trellis.plans import validate

    found = found.cache()
    rules = {r["rule"]: {k: r[k] for k in ("checks", "errors", "warnings")} for r in validate.rule_summary(found).collect()}  # one row a rule
    errors, warnings = (sum(r[k] for r in rules.values()) for k in ("errors", "warnings"))
    listed = found.where("failed").orderBy("variant", "rule", "object_id", "message").limit(MAX_DIAGNOSTICS).select("severity", "variant", "object_id", "rule", "message").collect()
    text = {"valid": errors == 0, "errorCount": errors, "warningCount": warnings, "diagnostics": [r.asDict() for r in listed], "limitations": LIMITATIONS, "ruleSummary": rules}
    if out:
        with open(f"{out}.validation.json", "w", encoding="utf-8") as f:
            json.dump(text, f, ensure_ascii=False, indent=1)
    print(json.dumps({"valid": errors == 0, "errorCount": errors, "warningCount": warnings}))
    shared.release([found, *held])
    return 2 if errors else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
