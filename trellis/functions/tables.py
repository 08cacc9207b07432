"""Reference tables of pipes, chambers and restrictions, and the scalars built on them, as Column expressions.

The tables are a few dozen rows whatever the data, so they are folded into expressions (no join, no shuffle) or into
literal DataFrames that Spark broadcasts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values. Diameter mm, capacity t/h, longest run m, cost per m, width m, height m.
DIAMETERS = [
    (50, 3.5, 181.0, 74023.0, 0.400, 0.125),
    (65, 8.3, 245.0, 78631.0, 0.430, 0.140),
    (80, 13.2, 327.0, 83530.0, 0.470, 0.160),
    (100, 22.3, 419.0, 89748.0, 0.510, 0.180),
    (125, 40.2, 554.0, 97275.0, 0.600, 0.225),
    (150, 65.1, 696.0, 105507.0, 0.650, 0.250),
    (200, 152.3, 1042.0, 120275.0, 0.880, 0.315),
    (250, 274.9, 1379.0, 135323.0, 1.050, 0.400),
    (300, 437.4, 1718.0, 150022.0, 1.150, 0.450),
    (400, 943.1, 2477.0, 190299.0, 1.370, 0.560),
    (500, 1663.4, 3245.0, 224137.0, 1.670, 0.710),
    (600, 2627.7, 4037.0, 264790.0, 1.850, 0.800),
    (700, 3735.1, 4775.0, 324298.0, 2.050, 0.900),
    (800, 5296.8, 5644.0, 325996.0, 2.250, 1.000),
    (900, 7165.0, 6518.0, 327693.0, 2.450, 1.100),
    (1000, 9391.8, 7419.0, 418777.0, 2.650, 1.200),
    (1200, 15012.8, 9288.0, 428074.0, 3.100, 1.425),
    (1400, 22501.9, 11276.0, 683417.0, 3.450, 1.600),
]

#: Fixed values. Type, kind, clearance m, least crossing angle, margin m, cost factor, own width, height, depth, vertical clearance, under only.
RULES = {
    "heat": [
        ("oks", "forbidden", 5.0, None, 0.0, 1.0, None, None, None, None, False),
        ("park", "forbidden", 1.0, None, 0.0, 1.0, None, None, None, None, False),
        ("social_area", "forbidden", 1.0, None, 0.0, 1.0, None, None, None, None, False),
        ("prohibited_site", "forbidden", 1.0, None, 0.0, 1.0, None, None, None, None, False),
        ("water", "forbidden", 1.0, None, 0.0, 1.0, None, None, None, None, False),
        ("railway", "forbidden", 1.0, None, 0.0, 1.0, None, None, None, None, False),
        ("road", "special", 1.5, 45.0, 3.0, 1.60, None, None, None, 1.0, True),
        ("tram_tracks", "special", 1.5, 45.0, 3.0, 1.75, None, None, None, 1.2, True),
        ("gas_pipeline", "special", 2.0, None, 2.0, 1.25, 0.40, 0.40, 2.8, 0.2, False),
        ("power_cable", "special", 2.0, None, 2.0, 1.15, 0.20, 0.20, 2.7, 0.5, False),
        ("heat_network", "special", 1.0, None, 2.0, 1.05, None, None, 3.0, 0.5, False),
        ("metro", "forbidden", 5.0, None, 0.0, 1.0, None, None, None, None, False),
        ("cemetery", "forbidden", 3.0, None, 0.0, 1.0, None, None, None, None, False),
        ("water_pipeline", "special", 1.5, None, 2.0, 1.10, 0.50, 0.50, 2.5, 0.2, False),
        ("sewer", "special", 1.5, None, 2.0, 1.10, 0.60, 0.60, 3.5, 0.2, False),
        ("telecom", "special", 1.0, None, 2.0, 1.05, 0.20, 0.20, 1.0, 0.3, False),
    ],
    "water": [
        ("oks", "forbidden", 5.0, None, 0.0, 1.0, None, None, None, None, False),
        ("park", "forbidden", 1.5, None, 0.0, 1.0, None, None, None, None, False),
        ("social_area", "forbidden", 1.5, None, 0.0, 1.0, None, None, None, None, False),
        ("prohibited_site", "forbidden", 1.0, None, 0.0, 1.0, None, None, None, None, False),
        ("water", "forbidden", 1.0, None, 0.0, 1.0, None, None, None, None, False),
        ("railway", "forbidden", 1.0, None, 0.0, 1.0, None, None, None, None, False),
        ("road", "special", 2.0, 45.0, 3.0, 1.50, None, None, None, 1.0, True),
        ("tram_tracks", "special", 2.0, 45.0, 3.0, 1.60, None, None, None, 1.2, True),
        ("gas_pipeline", "special", 1.0, None, 2.0, 1.20, 0.40, 0.40, 2.8, 0.2, False),
        ("power_cable", "special", 0.5, None, 2.0, 1.10, 0.20, 0.20, 2.7, 0.5, False),
        ("heat_network", "special", 1.5, None, 2.0, 1.10, None, None, 3.0, 0.5, False),
        ("sewer", "special", 1.5, None, 2.0, 1.10, 0.60, 0.60, 3.5, 0.4, False),
    ],
    "cable": [
        ("oks", "forbidden", 0.6, None, 0.0, 1.0, None, None, None, None, False),
        ("park", "forbidden", 0.6, None, 0.0, 1.0, None, None, None, None, False),
        ("social_area", "forbidden", 0.6, None, 0.0, 1.0, None, None, None, None, False),
        ("prohibited_site", "forbidden", 1.0, None, 0.0, 1.0, None, None, None, None, False),
        ("water", "forbidden", 1.0, None, 0.0, 1.0, None, None, None, None, False),
        ("railway", "forbidden", 1.0, None, 0.0, 1.0, None, None, None, None, False),
        ("road", "special", 1.0, 45.0, 2.0, 1.40, None, None, None, 1.0, True),
        ("tram_tracks", "special", 1.0, 45.0, 2.0, 1.50, None, None, None, 1.0, True),
        ("gas_pipeline", "special", 1.0, None, 1.0, 1.15, 0.40, 0.40, 2.8, 0.5, False),
        ("power_cable", "special", 0.5, None, 1.0, 1.05, 0.20, 0.20, 2.7, 0.25, False),
        ("heat_network", "special", 2.0, None, 2.0, 1.10, None, None, 3.0, 0.5, False),
    ],
}
UNKNOWN_RULE = ("unknown", "forbidden", 1.0, None, 0.0, 1.0, None, None, None, None, False)
#: Clearance of unknown types by profile.
UNKNOWN_CLEARANCE = {"heat": 1.0, "water": 1.0, "cable": 0.6}


def unknown_rule(profile: str = "heat") -> tuple:
    """Rule of a type that the profile doesn't know: forbidden."""
    return (*UNKNOWN_RULE[:2], UNKNOWN_CLEARANCE[profile], *UNKNOWN_RULE[3:])


ALIASES = {
    "school": "social_area", "kindergarten": "social_area", "hospital": "social_area", "detsad": "social_area", "building": "oks", "river": "water",
    "pond": "water", "rail": "railway", "tram": "tram_tracks", "gas": "gas_pipeline", "cable": "power_cable",
}
RULE_SCHEMA = "type string, kind string, clearance double, min_angle double, margin double, k_special double, own_width double, own_height double, own_depth double, vertical_clearance double, under_only boolean"

#: Fixed values.
TIE_IN_COST, SNAP, MAX_LINKS, MAX_TURN = 5e6, 10.0, 4, 90.0
DEPTH, MIN_DEPTH, SLOPE = 3.0, 0.7, 0.10
CHAMBER_BANDS = [(200, 3e6), (500, 5e6), (1000, 8e6)]
CHAMBER_TOP = 12e6
PENALTY_BASE, PENALTY_PER_FLOW = 100e6, 0.5e6


def diameters(spark: SparkSession) -> DataFrame:
    """The diameter table."""
    return spark.createDataFrame(DIAMETERS, "dn int, capacity double, max_run double, cost_m double, width double, height double")


def rules(spark: SparkSession, profile: str = "heat") -> DataFrame:
    """The restriction rules of a profile."""
    return spark.createDataFrame(RULES[profile], RULE_SCHEMA)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def smallest_diameter(flow: Column | str, length: Column | str | None = None) -> Column:
    """Smallest diameter whose capacity carries the flow, and whose run reaches the length if given; null past the table."""
    flow, cases = _col(flow), []
    for dn, capacity, run, *_ in DIAMETERS:
        ok = flow <= capacity
        cases.append(F.when(ok if length is None else ok & (_col(length) <= run), F.lit(dn)))
    return F.coalesce(*cases)


def diameter_value(dn: Column | str, column: str) -> Column:
    """A column of the table for an exact diameter; null if there is none."""
    at = {"capacity": 1, "max_run": 2, "cost_m": 3, "width": 4, "height": 5}[column]
    return F.coalesce(*[F.when(_col(dn) == row[0], F.lit(row[at])) for row in DIAMETERS])


def next_diameter(dn: Column | str) -> Column:
    """The next larger diameter of the table; null past its end."""
    return F.coalesce(*[F.when(F.lit(row[0]) > _col(dn), F.lit(row[0])) for row in DIAMETERS])


def previous_diameter(dn: Column | str) -> Column:
    """The next smaller diameter of the table; null before its start."""
    return F.coalesce(*[F.when(F.lit(row[0]) < _col(dn), F.lit(row[0])) for row in reversed(DIAMETERS)])


def canonical_type(kind: Column | str) -> Column:
    """Restriction type trimmed, in lower case, aliases resolved."""
    own = F.lower(F.trim(_col(kind)))
    return F.coalesce(*[F.when(own == a, F.lit(t)) for a, t in ALIASES.items()], own)


def with_rule(df: DataFrame, kind: str, profile: str = "heat") -> DataFrame:
    """df with the columns of its type's rule (rule_type null where the type is unknown, with that rule's values)."""
    table = F.broadcast(rules(df.sparkSession, profile).select(*[F.col(c.split()[0]).alias(f"rule_{c.split()[0]}") for c in RULE_SCHEMA.split(", ")]))
    joined = df.join(table, canonical_type(kind) == F.col("rule_type"), "left")
    default = dict(zip([c.split()[0] for c in RULE_SCHEMA.split(", ")], unknown_rule(profile)))
    return joined.withColumns({f"rule_{k}": F.when(F.col("rule_type").isNull(), F.lit(v)).otherwise(F.col(f"rule_{k}")) for k, v in default.items() if k != "type" and v is not None})


def clearance(kind: Column | str, dn: Column | str, base: Column | str) -> Column:
    """Clearance for a diameter: buildings ask 5 m below DN 500, 7 m up to DN 800, 9 m above, in every profile; other types their own."""
    dn = _col(dn)
    return F.when(canonical_type(kind) == "oks", F.when(dn < 500, 5.0).when(dn <= 800, 7.0).otherwise(9.0)).otherwise(_col(base))


def chamber_cost(dn: Column | str) -> Column:
    """Cost of a new chamber by its diameter band."""
    return reduce(lambda c, band: c.when(_col(dn) <= band[0], band[1]), CHAMBER_BANDS[1:], F.when(_col(dn) <= CHAMBER_BANDS[0][0], CHAMBER_BANDS[0][1])).otherwise(CHAMBER_TOP)


def penalty(flow: Column | str) -> Column:
    """Penalty of a point left unconnected."""
    return F.lit(PENALTY_BASE) + F.lit(PENALTY_PER_FLOW) * _col(flow)


def score(cost: Column | str, length: Column | str) -> Column:
    """Variant score; lower is better."""
    return 0.7 * _col(cost) / 25e6 + 0.3 * _col(length) / 100


def depth_factor(depth: Column | str) -> Column:
    """Cost factor of depth."""
    d = _col(depth)
    return F.when(d <= DEPTH, 1.0).otherwise(1 + 0.1 * (d - DEPTH))


def round_half_up(c: Column | str, digits: int) -> Column:
    """Rounded half toward plus infinity."""
    return F.floor(_col(c) * 10**digits + 0.5) / 10**digits
