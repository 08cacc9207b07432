"""Queries over the driver's tables, one for each relational operator, with the same result in plain SQL.

The tables hold no geometry, so a tree stands in for a network: region (root) - nation - customer - order (leaf).
An order's flow is the sum of its lines' quantities. Node keys are text: r1, n7, c42, o99. Coordinates are whole
numbers made from keys, or the first two values of an embedding in ten-thousandths, so results are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.functions import tables as T
from trellis.operators import checks, intervals, network, selection, spatial

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _node(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def _leaf_flows(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("flow"))


def _edges(spark: SparkSession, d: str, orders: bool = True) -> DataFrame:
    """child and parent of the tree; orders are left out where only the upper levels matter."""
    e = _t(spark, d, "nation").select(_node("n", "n_nationkey").alias("child"), _node("r", "n_regionkey").alias("parent"))
    e = e.union(_t(spark, d, "customer").select(_node("c", "c_custkey"), _node("n", "c_nationkey")))
    return e.union(_t(spark, d, "orders").select(_node("o", "o_orderkey"), _node("c", "o_custkey"))) if orders else e


def _customer_flows(spark: SparkSession, d: str) -> DataFrame:
    """Flow of every customer node: lines summed by order first, so the join with orders moves one row an order."""
    lines = _leaf_flows(spark, d)
    return lines.join(_t(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(_node("c", "o_custkey").alias("node")).agg(F.sum("flow").alias("value"))


def _place(df: DataFrame, key: str, prefix: str) -> DataFrame:
    """Whole-number position of a key."""
    k = F.col(key)
    return df.select(k.alias(f"{prefix}id"), (k * 7919 % 10007).cast("double").alias(f"{prefix}x"), (k * 104729 % 10009).cast("double").alias(f"{prefix}y"))


def _points(spark: SparkSession, d: str, prefix: str) -> DataFrame:
    at = lambda i: F.floor(F.col("embedding")[i].cast("double") * 10000).cast("double")
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias(f"{prefix}id"), at(0).alias(f"{prefix}x"), at(1).alias(f"{prefix}y"), F.col("label").alias(f"{prefix}label"))


_VALUES = ", ".join(f"({dn}, {c!r}::DOUBLE, {r!r}::DOUBLE, {m!r}::DOUBLE)" for dn, c, r, m, *_ in T.DIAMETERS)
_DN = f"dn AS (SELECT * FROM (VALUES {_VALUES}) AS v(dn, capacity, max_run, cost_m))"
_FLOWS = "flows AS (SELECT l_orderkey, sum(l_quantity) AS flow FROM lineitem GROUP BY 1)"
_EDGES = "edges AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders)"
_POINTS = "pts AS (SELECT vec_id, floor(embedding[1]::DOUBLE * 10000) AS x, floor(embedding[2]::DOUBLE * 10000) AS y, label FROM embeddings)"
_SPOT = "(k * 7919 % 10007)::DOUBLE AS x, (k * 104729 % 10009)::DOUBLE AS y"


# ---- threshold lookups and rules


@query(f"WITH {_FLOWS}, {_DN} SELECT l_orderkey, flow, (SELECT min(dn) FROM dn WHERE capacity >= flow)::INT AS dn FROM flows")
def min_diameter_by_flow(spark: SparkSession, d: str) -> DataFrame:
    """Smallest diameter that carries an order's flow."""
    return _leaf_flows(spark, d).select("l_orderkey", "flow", T.smallest_diameter("flow").alias("dn"))


@query(f"""WITH {_DN}, p AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity AS flow, floor(l_extendedprice / 50) AS length FROM lineitem)
SELECT dn, count(*) AS n, sum(flow) AS flow, sum(length) AS length FROM (SELECT p.*, (SELECT min(dn) FROM dn WHERE capacity >= flow AND max_run >= length)::INT AS dn FROM p) GROUP BY dn""")
def diameter_by_flow_and_length(spark: SparkSession, d: str) -> DataFrame:
    """Diameters that lines need by flow and length, with what they carry."""
    lines = _t(spark, d, "lineitem").select(F.col("l_quantity").alias("flow"), F.floor(F.col("l_extendedprice") / 50).cast("double").alias("length"))
    return lines.groupBy(T.smallest_diameter("flow", "length").alias("dn")).agg(F.count("*").alias("n"), F.sum("flow").alias("flow"), F.sum("length").alias("length"))


@query(f"WITH {_DN} SELECT dn::INT AS dn, lead(dn) OVER (ORDER BY dn)::INT AS next_dn, lag(dn) OVER (ORDER BY dn)::INT AS previous_dn, capacity, cost_m FROM dn")
def diameter_next_prev(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of every diameter of the table."""
    return T.diameters(spark).select("dn", T.next_diameter("dn").alias("next_dn"), T.previous_diameter("dn").alias("previous_dn"), T.diameter_value("dn", "capacity").alias("capacity"), T.diameter_value("dn", "cost_m").alias("cost_m"))


_PART_TYPE = "CASE p_type WHEN 'ECONOMY' THEN ' Road ' WHEN 'SMALL' THEN 'school' WHEN 'PROMO' THEN 'GAS' WHEN 'LARGE' THEN 'oks' ELSE p_type END"


@query(f"""WITH a AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{t}')" for a, t in T.ALIASES.items())}) AS v(alias, type)),
r AS (SELECT * FROM (VALUES {', '.join(f"('{x[0]}', '{x[1]}', {x[2]}::DOUBLE, {x[5]}::DOUBLE)" for x in T.RULES['heat'])}) AS v(type, kind, clearance, k)),
p AS (SELECT p_partkey, lower(trim({_PART_TYPE})) AS t FROM part)
SELECT p_partkey, coalesce(a.type, t) AS type, coalesce(r.kind, 'forbidden') AS kind, coalesce(r.clearance, 1.0) AS clearance, coalesce(r.k, 1.0) AS k_special
FROM p LEFT JOIN a ON a.alias = t LEFT JOIN r ON r.type = coalesce(a.type, t)""")
def rule_lookup_default(spark: SparkSession, d: str) -> DataFrame:
    """Rule of each part's type: trimmed, lower case, alias, then the rule or the default of unknown types."""
    parts = _t(spark, d, "part").select("p_partkey", F.expr(_PART_TYPE).alias("t"))
    return T.with_rule(parts, "t").select("p_partkey", T.canonical_type("t").alias("type"), F.col("rule_kind").alias("kind"), F.col("rule_clearance").alias("clearance"), F.col("rule_k_special").alias("k_special"))


@query("""WITH p AS (SELECT p_partkey, p_size * 25 AS dn, p_retailprice AS depth FROM part)
SELECT p_partkey, dn, CASE WHEN dn < 500 THEN 5.0 WHEN dn <= 800 THEN 7.0 ELSE 9.0 END::DOUBLE AS clearance,
  CASE WHEN dn <= 200 THEN 3e6 WHEN dn <= 500 THEN 5e6 WHEN dn <= 1000 THEN 8e6 ELSE 12e6 END::DOUBLE AS chamber_cost,
  100e6 + 0.5e6 * dn AS penalty, floor((CASE WHEN depth / 300 <= 3 THEN 1.0 ELSE 1 + 0.1 * (depth / 300 - 3) END) * 10000 + 0.5) / 10000 AS depth_factor FROM p""")
def domain_scalars(spark: SparkSession, d: str) -> DataFrame:
    """Clearance, chamber cost, penalty and depth factor as expressions."""
    p = _t(spark, d, "part").select("p_partkey", (F.col("p_size") * 25).alias("dn"), (F.col("p_retailprice") / 300).alias("depth"))
    return p.select("p_partkey", "dn", T.clearance(F.lit("oks"), "dn", F.lit(5.0)).cast("double").alias("clearance"), T.chamber_cost("dn").alias("chamber_cost"), T.penalty("dn").alias("penalty"), T.round_half_up(T.depth_factor("depth"), 4).alias("depth_factor"))


# ---- networks


@query(f"""WITH RECURSIVE {_EDGES}, {_FLOWS}, up AS (
  SELECT 'o' || l_orderkey AS node, flow FROM flows UNION ALL SELECT parent, flow FROM up JOIN edges ON child = node)
SELECT node, sum(flow) AS flow FROM up WHERE node NOT LIKE 'o%' GROUP BY 1""")
def tree_flow_accumulation(spark: SparkSession, d: str) -> DataFrame:
    """Flow through every customer, nation and region."""
    return network.accumulate(_edges(spark, d, orders=False), _customer_flows(spark, d), levels=2).select("node", F.col("value").alias("flow"))


@query(f"""WITH RECURSIVE {_EDGES}, {_FLOWS}, {_DN}, leaf AS (SELECT 'o' || l_orderkey AS node, (SELECT min(dn) FROM dn WHERE capacity >= flow)::INT AS v FROM flows),
up AS (SELECT node, v FROM leaf UNION ALL SELECT parent, v FROM up JOIN edges ON child = node)
SELECT node, max(v) AS dn FROM up WHERE node NOT LIKE 'o%' GROUP BY 1""")
def monotone_diameter(spark: SparkSession, d: str) -> DataFrame:
    """Largest diameter of the leaves behind every inner node."""
    leaf = _leaf_flows(spark, d).withColumn("dn", T.smallest_diameter("flow"))
    own = leaf.join(_t(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(_node("c", "o_custkey").alias("node")).agg(F.max("dn").alias("value"))
    return network.accumulate(_edges(spark, d, orders=False), own, "max", levels=2).select("node", F.col("value").alias("dn"))


@query("""SELECT 'r' || n_regionkey AS node, count(*) AS n, string_agg('c' || c_custkey, ',' ORDER BY c_custkey) AS downstream
FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1""")
def downstream_points(spark: SparkSession, d: str) -> DataFrame:
    """Customers behind every region, in order."""
    c = _t(spark, d, "customer").join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy(_node("r", "n_regionkey").alias("node")).agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("c_custkey")), lambda k: F.concat(F.lit("c"), k.cast("string"))), ",").alias("downstream"))


@query(f"""WITH {_EDGES}
SELECT a.child, c.parent AS ancestor, 3 AS hops FROM edges a JOIN edges b ON a.parent = b.child JOIN edges c ON b.parent = c.child
UNION ALL SELECT a.child, b.parent, 2 FROM edges a JOIN edges b ON a.parent = b.child UNION ALL SELECT child, parent, 1 FROM edges""")
def ancestor_closure(spark: SparkSession, d: str) -> DataFrame:
    """Every node with all nodes above it."""
    return network.ancestors(_edges(spark, d), 3)


@query("""WITH k AS (
  SELECT n_regionkey, count(DISTINCT n_nationkey) + count(DISTINCT c_custkey) + count(DISTINCT o_orderkey) AS edges
  FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1
)
SELECT 'r' || n_regionkey AS root, edges + 1 AS n_nodes, edges AS n_edges, true AS is_tree FROM k""")
def forest_check(spark: SparkSession, d: str) -> DataFrame:
    """Components with their root, and whether each is a tree."""
    return network.forest(_edges(spark, d), rounds=2)


_LENGTHS = """lengths AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent, (n_nationkey + 1)::DECIMAL(18,2) AS length FROM nation
UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, (c_custkey % 97 + 1)::DECIMAL(18,2) FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, (o_totalprice / 1000)::DECIMAL(18,2) FROM orders)"""


@query(f"""WITH RECURSIVE {_LENGTHS}, up AS (
  SELECT child AS node, NULL::VARCHAR AS via, 0::DECIMAL(18,2) AS d, child AS leaf FROM lengths WHERE child NOT IN (SELECT parent FROM lengths)
  UNION ALL SELECT parent, child, (d + length)::DECIMAL(18,2), leaf FROM up JOIN lengths ON child = node),
b AS (SELECT node, via, d, leaf, row_number() OVER (PARTITION BY node, via ORDER BY d DESC, leaf DESC) AS k FROM up WHERE via IS NOT NULL),
r AS (SELECT node, d, leaf, row_number() OVER (PARTITION BY node ORDER BY d DESC, leaf DESC) AS k FROM b WHERE k = 1)
SELECT node, max(d) FILTER (k = 1)::DOUBLE AS longest, max(leaf) FILTER (k = 1) AS leaf, (max(d) FILTER (k = 1) + coalesce(max(d) FILTER (k = 2), 0))::DOUBLE AS through FROM r GROUP BY 1""")
def longest_path(spark: SparkSession, d: str) -> DataFrame:
    """Longest way down from every inner node, the order or customer at its end, and the longest simple path over the node."""
    length = lambda c: c.cast("decimal(18,2)").alias("length")
    e = _t(spark, d, "nation").select(_node("n", "n_nationkey").alias("child"), _node("r", "n_regionkey").alias("parent"), length(F.col("n_nationkey") + 1))
    e = e.union(_t(spark, d, "customer").select(_node("c", "c_custkey"), _node("n", "c_nationkey"), length(F.col("c_custkey") % 97 + 1)))
    e = e.union(_t(spark, d, "orders").select(_node("o", "o_orderkey"), _node("c", "o_custkey"), length(F.col("o_totalprice") / 1000)))
    found = network.longest(e, levels=3)
    return found.select("node", F.col("longest").cast("double").alias("longest"), "leaf", F.col("through").cast("double").alias("through"))


@query(f"WITH {_EDGES} SELECT node, count(*) AS degree FROM (SELECT child AS node FROM edges UNION ALL SELECT parent FROM edges) GROUP BY 1")
def node_degree(spark: SparkSession, d: str) -> DataFrame:
    """Incident edges of every node."""
    return network.degrees(_edges(spark, d))


@query(f"""WITH {_FLOWS}, {_DN}, e AS (SELECT 'o' || o_orderkey AS child, 'c' || o_custkey AS parent, (SELECT min(dn) FROM dn WHERE capacity >= flow)::INT AS dn FROM orders JOIN flows ON l_orderkey = o_orderkey),
m AS (SELECT node, max(dn) AS largest FROM (SELECT child AS node, dn FROM e UNION ALL SELECT parent, dn FROM e) GROUP BY 1)
SELECT node, largest, CASE WHEN largest <= 200 THEN 3e6 WHEN largest <= 500 THEN 5e6 WHEN largest <= 1000 THEN 8e6 ELSE 12e6 END::DOUBLE AS cost FROM m""")
def chamber_max_incident(spark: SparkSession, d: str) -> DataFrame:
    """Largest diameter at every node, and the chamber it costs."""
    e = _leaf_flows(spark, d).join(_t(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    e = e.select(_node("o", "o_orderkey").alias("child"), _node("c", "o_custkey").alias("parent"), T.smallest_diameter("flow").alias("dn"))
    return network.incident_max(e, "dn").withColumn("cost", T.chamber_cost("largest"))


_RUNS = """r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (
  SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type THEN 0 ELSE 1 END AS c FROM events))"""


@query(f"WITH {_RUNS} SELECT user_id, run::BIGINT AS run, event_type, count(*) AS pieces, sum(value::DECIMAL(18,2))::DOUBLE AS run_length FROM r GROUP BY ALL")
def path_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of equal type along each user's events."""
    r = network.run_lengths(_t(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", F.col("value").cast("decimal(18,2)"))
    return r.withColumn("run_length", F.col("run_length").cast("double"))


@query(f"WITH {_RUNS} SELECT user_id, run::BIGINT AS run, event_type, sum(value::DECIMAL(18,2))::DOUBLE AS run_length FROM r GROUP BY ALL HAVING sum(value::DECIMAL(18,2)) > 181")
def run_limit_violations(spark: SparkSession, d: str) -> DataFrame:
    """Runs longer than the longest run of the smallest diameter."""
    return path_runs(spark, d).where(F.col("run_length") > T.DIAMETERS[0][2]).select("user_id", "run", "event_type", "run_length")


@query("""SELECT user_id, count(*) AS changes FROM (SELECT user_id, event_type, value, lag(event_type) OVER w AS pt, lag(value) OVER w AS pv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
WHERE pt <> event_type AND pv >= value GROUP BY 1""")
def adjacent_change(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring rows on a path whose type changes although the value doesn't grow."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = _t(spark, d, "events").select("user_id", "event_type", "value", F.lag("event_type").over(w).alias("pt"), F.lag("value").over(w).alias("pv"))
    return e.where("pt <> event_type AND pv >= value").groupBy("user_id").agg(F.count("*").alias("changes"))


# ---- costs and variants

_LINES = f"""{_DN}, l AS (SELECT *, (l_extendedprice::DECIMAL(18,2) * 0.01) AS len, CASE l_returnflag WHEN 'A' THEN 1.60 WHEN 'R' THEN 1.25 ELSE 1.00 END::DECIMAL(4,2) AS k,
  (SELECT min(dn) FROM dn WHERE capacity >= l_quantity)::INT AS dn FROM lineitem), c AS (SELECT l.*, (len * k * (SELECT cost_m FROM dn x WHERE x.dn = l.dn)::DECIMAL(10,0)) AS cost FROM l)"""


def _costed(spark: SparkSession, d: str) -> DataFrame:
    k = F.when(F.col("l_returnflag") == "A", 1.60).when(F.col("l_returnflag") == "R", 1.25).otherwise(1.00).cast("decimal(4,2)")
    lines = _t(spark, d, "lineitem").select("l_suppkey", "l_returnflag", "l_quantity", (F.col("l_extendedprice").cast("decimal(18,2)") * F.lit("0.01").cast("decimal(2,2)")).cast("decimal(18,4)").alias("len"), k.alias("k"), T.smallest_diameter("l_quantity").alias("dn"))
    return lines.withColumn("cost", (F.col("len") * F.col("k") * T.diameter_value("dn", "cost_m").cast("decimal(10,0)")))


@query(f"WITH {_LINES} SELECT dn, count(*) AS n, sum(len)::DOUBLE AS length, sum(cost)::DOUBLE AS cost FROM c GROUP BY 1")
def cost_by_diameter(spark: SparkSession, d: str) -> DataFrame:
    """Pieces, length and cost by diameter."""
    return _costed(spark, d).groupBy("dn").agg(F.count("*").alias("n"), F.sum("len").cast("double").alias("length"), F.sum("cost").cast("double").alias("cost"))


@query(f"WITH {_LINES} SELECT l_returnflag AS kind, count(*) AS n, sum(cost)::DOUBLE AS cost, (sum(cost) - sum(len * (SELECT cost_m FROM dn x WHERE x.dn = c.dn)::DECIMAL(10,0)))::DOUBLE AS extra FROM c GROUP BY 1")
def cost_by_special(spark: SparkSession, d: str) -> DataFrame:
    """Cost by crossing type, and the part that the crossing factor adds."""
    return _costed(spark, d).groupBy(F.col("l_returnflag").alias("kind")).agg(F.count("*").alias("n"), F.sum("cost").cast("double").alias("cost"), (F.sum("cost") - F.sum(F.col("len") * T.diameter_value("dn", "cost_m").cast("decimal(10,0)"))).cast("double").alias("extra"))


_TOTALS = f"""{_LINES}, v AS (SELECT n_regionkey AS variant, sum(cost)::DOUBLE AS cost, sum(len)::DOUBLE AS length, count(*) AS pieces FROM c JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1),
s AS (SELECT *, floor((0.7 * cost / 25e6 + 0.3 * length / 100) * 10000 + 0.5) / 10000 AS score FROM v)"""


@query(f"WITH {_TOTALS} SELECT * FROM s")
def network_totals(spark: SparkSession, d: str) -> DataFrame:
    """Cost, length and score of each variant (region)."""
    by = _costed(spark, d).groupBy("l_suppkey").agg(F.sum("cost").alias("cost"), F.sum("len").alias("length"), F.count("*").alias("pieces"))
    at = by.join(_t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(_t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    v = at.groupBy(F.col("n_regionkey").alias("variant")).agg(F.sum("cost").cast("double").alias("cost"), F.sum("length").cast("double").alias("length"), F.sum("pieces").alias("pieces"))
    return v.withColumn("score", T.round_half_up(T.score("cost", "length"), 4))


@query(f"WITH {_TOTALS} SELECT variant, score, row_number() OVER (ORDER BY score, variant)::INT AS rank FROM s")
def score_rank(spark: SparkSession, d: str) -> DataFrame:
    """Variants ranked by score."""
    return selection.ranked(network_totals(spark, d).select("variant", "score"), [F.col("score"), F.col("variant")])


@query("""WITH s AS (SELECT s_suppkey, -s_acctbal AS cost, (s_suppkey * 7919 % 10007)::DOUBLE AS length FROM supplier)
SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.cost <= s.cost AND o.length <= s.length AND (o.cost < s.cost OR o.length < s.length))""")
def pareto_front(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers that none beats in both cost and length."""
    s = _t(spark, d, "supplier").select("s_suppkey", (-F.col("s_acctbal")).alias("cost"), (F.col("s_suppkey") * 7919 % 10007).cast("double").alias("length"))
    return selection.pareto(s, "cost", "length")


@query("""SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment, floor(c_acctbal / 1000) ORDER BY c_acctbal, c_custkey) AS n FROM customer) WHERE n = 1""")
def signature_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Best customer of each signature."""
    c = _t(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    return selection.best_of(c, [F.col("c_nationkey").alias("_a"), F.col("c_mktsegment").alias("_b2"), F.floor(F.col("c_acctbal") / 1000).alias("_c")], ["c_acctbal", "c_custkey"])


@query("SELECT count(*) AS n, sum(100000000 + 500000 * floor(o_totalprice / 1000))::DOUBLE AS penalty FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def unconnected_penalty(spark: SparkSession, d: str) -> DataFrame:
    """Orders without lines, and their penalty."""
    left = _t(spark, d, "orders").select("o_orderkey", "o_totalprice").join(_t(spark, d, "lineitem").select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")
    return left.agg(F.count("*").alias("n"), F.sum(T.penalty(F.floor(F.col("o_totalprice") / 1000))).alias("penalty"))


@query("""WITH p AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2), pr AS (SELECT a.o_orderpriority AS a, b.o_orderpriority AS b, sum(least(a.n, b.n)) AS shared FROM p a JOIN p b ON a.o_custkey = b.o_custkey AND a.o_orderpriority < b.o_orderpriority GROUP BY 1, 2),
t AS (SELECT o_orderpriority AS k, count(*) AS n FROM orders GROUP BY 1)
SELECT a, b, floor(10000.0 * shared / least(x.n, y.n) + 0.5) / 10000 AS overlap FROM pr JOIN t x ON x.k = a JOIN t y ON y.k = b""")
def variant_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Share of what two variants (priorities) have in common, by customer."""
    p = _t(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    total = p.groupBy("o_orderpriority").agg(F.sum("n").alias("total"))
    p = p.join(F.broadcast(total), "o_orderpriority")  # one row for each of the five priorities
    name = lambda s: p.select("o_custkey", *[F.col(c).alias(f"{s}_{c}") for c in ("o_orderpriority", "n", "total")])
    pairs = name("a").join(name("b"), "o_custkey").where("a_o_orderpriority < b_o_orderpriority")
    both = pairs.groupBy(F.col("a_o_orderpriority").alias("a"), F.col("b_o_orderpriority").alias("b"), "a_total", "b_total").agg(F.sum(F.least("a_n", "b_n")).alias("shared"))
    return both.select("a", "b", T.round_half_up(F.col("shared") / F.least("a_total", "b_total"), 4).alias("overlap"))


# ---- intervals and profiles

_IV = "iv AS (SELECT user_id, event_id AS id, epoch_us(ts) AS lo, epoch_us(ts) + (value * 600000000)::BIGINT AS hi FROM events)"


def _event_intervals(spark: SparkSession, d: str) -> DataFrame:
    # Micros of the wall clock, whatever the session's time zone.
    lo = F.unix_date(F.col("ts").cast("date")).cast("bigint") * 86400000000 + F.hour("ts").cast("bigint") * 3600000000 + F.minute("ts").cast("bigint") * 60000000 + (F.expr("extract(SECOND FROM ts)") * 1000000).cast("bigint")
    return _t(spark, d, "events").select("user_id", F.col("event_id").alias("id"), lo.alias("lo"), (lo + F.round(F.col("value") * 600000000).cast("bigint")).alias("hi"))


@query(f"WITH {_IV} SELECT a.user_id, a.id, count(*) AS covering FROM iv a JOIN iv b ON a.user_id = b.user_id AND b.lo <= (a.lo + a.hi) // 2 AND (a.lo + a.hi) // 2 <= b.hi GROUP BY 1, 2")
def interval_cover(spark: SparkSession, d: str) -> DataFrame:
    """How many of a user's intervals cover each interval's middle."""
    iv = _event_intervals(spark, d).withColumn("mid", F.expr("(lo + hi) div 2"))
    return intervals.stabbed(iv, "user_id", "mid")


@query(f"WITH {_IV} SELECT user_id, reach AS gap_from, lo AS gap_to FROM (SELECT *, max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv) WHERE lo > reach")
def uncovered_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Times that none of a user's intervals covers."""
    return intervals.gaps(_event_intervals(spark, d), "user_id")


@query(f"""WITH {_IV}, m AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS c FROM iv),
g AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT user_id, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY user_id, g""")
def interval_merge(spark: SparkSession, d: str) -> DataFrame:
    """Unions of a user's overlapping intervals."""
    return intervals.merged(_event_intervals(spark, d), "user_id")


_RAMPS = [(0.0, 3.0), (20.0, 2.4), (45.0, 4.1), (60.0, 2.9)]


@query(f"""WITH r AS (SELECT * FROM (VALUES {', '.join(f'({a}::DOUBLE, {b}::DOUBLE)' for a, b in _RAMPS)}) AS v(pos, depth)), s AS (SELECT DISTINCT (p_size * 1.5)::DOUBLE AS s FROM part)
SELECT s, floor(max(depth - 0.1 * abs(s - pos)) * 1000 + 0.5) / 1000 AS deepest, floor(min(depth + 0.1 * abs(s - pos)) * 1000 + 0.5) / 1000 AS shallowest FROM s, r GROUP BY s""")
def depth_envelope(spark: SparkSession, d: str) -> DataFrame:
    """Envelope of the slopes from required depths, at sampled places: ramps are an array, so no join."""
    ramps = F.array(*[F.struct(F.lit(a).alias("pos"), F.lit(b).alias("depth")) for a, b in _RAMPS])
    s = _t(spark, d, "part").select((F.col("p_size") * 1.5).alias("s")).distinct()
    off = lambda r: F.lit(T.SLOPE) * F.abs(F.col("s") - r["pos"])
    return s.select("s", T.round_half_up(F.array_max(F.transform(ramps, lambda r: r["depth"] - off(r))), 3).alias("deepest"), T.round_half_up(F.array_min(F.transform(ramps, lambda r: r["depth"] + off(r))), 3).alias("shallowest"))


# ---- space


@query(f"""WITH {_POINTS}, b AS (SELECT min(x) - 500 AS x1, max(x) + 500 AS x2, min(y) - 500 AS y1, max(y) + 500 AS y2 FROM pts WHERE label = 0)
SELECT vec_id, x, y FROM pts, b WHERE label <> 0 AND x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2""")
def bbox_crop(spark: SparkSession, d: str) -> DataFrame:
    """Points inside the widened box of the points of label 0."""
    p = _points(spark, d, "").withColumnRenamed("id", "vec_id")
    box = spatial.bounds(p.where("label = 0"), "x", "y", 500.0)
    other = p.where("label <> 0").select("vec_id", "x", "y")
    return spatial.crop(other, "x", "y", box) if box else other.where("false")


@query(f"""WITH {_POINTS} SELECT vec_id, rid, d2 FROM (SELECT a.vec_id, b.vec_id AS rid, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.vec_id) AS n FROM pts a JOIN pts b ON a.vec_id <> b.vec_id) WHERE n = 1""")
def nearest_neighbour(spark: SparkSession, d: str) -> DataFrame:
    """Nearest other point of every point."""
    left, right = _points(spark, d, "l").drop("llabel"), _points(spark, d, "r").drop("rlabel")
    return spatial.nearest(left, right, self_join=True).select(F.col("lid").alias("vec_id"), "rid", "d2")


@query(f"WITH {_POINTS} SELECT a.vec_id AS a, b.vec_id AS b, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM pts a JOIN pts b ON a.vec_id < b.vec_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 2500")
def within_radius(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of points at most 50 apart."""
    left, right = _points(spark, d, "l").drop("llabel"), _points(spark, d, "r").drop("rlabel")
    return spatial.within(left, right, 50.0).where("lid < rid").select(F.col("lid").alias("a"), F.col("rid").alias("b"), "d2")


_SEG = f"seg AS (SELECT k AS id, x AS x1, y AS y1, x + (k * 31 % 1601) - 800 AS x2, y + (k * 17 % 1601) - 800 AS y2 FROM (SELECT k, {_SPOT} FROM (SELECT s_suppkey AS k FROM supplier)))"


@query(f"""WITH {_SEG} SELECT a.id AS a_id, b.id AS b_id FROM seg a JOIN seg b ON a.id < b.id
WHERE sign((a.x2 - a.x1) * (b.y1 - a.y1) - (a.y2 - a.y1) * (b.x1 - a.x1)) * sign((a.x2 - a.x1) * (b.y2 - a.y1) - (a.y2 - a.y1) * (b.x2 - a.x1)) < 0
  AND sign((b.x2 - b.x1) * (a.y1 - b.y1) - (b.y2 - b.y1) * (a.x1 - b.x1)) * sign((b.x2 - b.x1) * (a.y2 - b.y1) - (b.y2 - b.y1) * (a.x2 - b.x1)) < 0""")
def segment_crossings(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of segments that cross."""
    s = _place(_t(spark, d, "supplier"), "s_suppkey", "")
    k = F.col("id")
    return spatial.crossings(s.select("id", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + k * 31 % 1601 - 800).alias("x2"), (F.col("y") + k * 17 % 1601 - 800).alias("y2")), 512.0)


_STEP = "st AS (SELECT label, vec_id, x, y, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM pts WINDOW w AS (PARTITION BY label ORDER BY vec_id))"


def _steps(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("label").orderBy("vec_id")
    p = _points(spark, d, "").withColumnRenamed("id", "vec_id")
    return p.select("label", "vec_id", "x", "y", F.lag("x").over(w).alias("px"), F.lag("y").over(w).alias("py"), F.lead("x").over(w).alias("nx"), F.lead("y").over(w).alias("ny"))


@query(f"WITH {_POINTS}, {_STEP} SELECT label, count(*) AS n, floor(sum(floor(sqrt((x - px) * (x - px) + (y - py) * (y - py)) * 100 + 0.5)) + 0.5) / 100 AS length FROM st WHERE px IS NOT NULL GROUP BY 1")
def segment_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Pieces and length of each label's path."""
    s = _steps(spark, d).where("px IS NOT NULL")
    own = F.floor(F.sqrt((F.col("x") - F.col("px")) * (F.col("x") - F.col("px")) + (F.col("y") - F.col("py")) * (F.col("y") - F.col("py"))) * 100 + 0.5)
    return s.groupBy("label").agg(F.count("*").alias("n"), T.round_half_up(F.sum(own).cast("double") / 100, 2).alias("length"))


@query(f"""WITH {_POINTS}, {_STEP}, t AS (SELECT label, (x - px) * (nx - x) + (y - py) * (ny - y) AS dot FROM st WHERE px IS NOT NULL AND nx IS NOT NULL)
SELECT label, count(*) AS turns, count(*) FILTER (WHERE dot < 0) AS sharp FROM t GROUP BY 1""")
def turn_angles(spark: SparkSession, d: str) -> DataFrame:
    """Turns of each label's path, and those sharper than a right angle."""
    dot = (F.col("x") - F.col("px")) * (F.col("nx") - F.col("x")) + (F.col("y") - F.col("py")) * (F.col("ny") - F.col("y"))
    return _steps(spark, d).where("px IS NOT NULL AND nx IS NOT NULL").groupBy("label").agg(F.count("*").alias("turns"), F.count_if(dot < 0).alias("sharp"))


_NEAR = f"""c AS (SELECT k AS id, {_SPOT} FROM (SELECT c_custkey AS k FROM customer)), s AS (SELECT k AS id, {_SPOT} FROM (SELECT s_suppkey AS k FROM supplier)),
b AS (SELECT id, rid, d2 FROM (SELECT c.id, s.id AS rid, (c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y) AS d2, row_number() OVER (PARTITION BY c.id ORDER BY (c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y), s.id) AS n FROM c, s) WHERE n = 1)"""


@query(f"""WITH {_DN}, {_NEAR}, f AS (SELECT b.*, sqrt(d2) AS length, (id % 40 + 1)::DOUBLE AS flow FROM b),
g AS (SELECT *, (SELECT min(dn) FROM dn WHERE capacity >= flow AND max_run >= length)::INT AS dn FROM f)
SELECT id AS point_id, rid AS tie_in_id, flow, floor(length * 100 + 0.5) / 100 AS length, dn, floor(length * (SELECT cost_m FROM dn x WHERE x.dn = g.dn) + 0.5) AS cost,
  CASE WHEN dn IS NULL OR length = 0 THEN 100e6 + 0.5e6 * flow ELSE 0.0 END::DOUBLE AS penalty FROM g""")
def stub_connect(spark: SparkSession, d: str) -> DataFrame:
    """Every customer joined by a straight line to the nearest supplier, sized by flow and length, and priced."""
    near = spatial.nearest(_place(_t(spark, d, "customer"), "c_custkey", "l"), _place(_t(spark, d, "supplier"), "s_suppkey", "r"))
    f = near.select(F.col("lid").alias("point_id"), F.col("rid").alias("tie_in_id"), (F.col("lid") % 40 + 1).cast("double").alias("flow"), F.sqrt("d2").alias("_len"))
    f = f.withColumn("dn", T.smallest_diameter("flow", "_len"))
    return f.select("point_id", "tie_in_id", "flow", T.round_half_up("_len", 2).alias("length"), "dn", F.floor(F.col("_len") * T.diameter_value("dn", "cost_m") + 0.5).cast("double").alias("cost"), F.when(F.col("dn").isNull() | (F.col("_len") == 0), T.penalty("flow")).otherwise(0.0).alias("penalty"))


# ---- checks, filters, jobs


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    """Keys of lines found more than once."""
    return checks.repeated(_t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT o_orderkey, 'flow' AS field FROM orders WHERE NOT coalesce(o_totalprice > 5000, false)")
def flow_positive(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose flow fails its bound."""
    found = checks.findings(_t(spark, d, "orders"), "o_orderkey", {"flow": ("error", F.col("o_totalprice") > 5000)})
    return found.where("failed").select(F.col("object_id").alias("o_orderkey"), F.col("rule").alias("field"))


@query("""SELECT rule, count(*) AS checks, sum(CASE WHEN sev = 'error' AND NOT ok THEN 1 ELSE 0 END)::BIGINT AS errors, sum(CASE WHEN sev = 'warning' AND NOT ok THEN 1 ELSE 0 END)::BIGINT AS warnings FROM (
SELECT 'quantity' AS rule, 'error' AS sev, l_quantity <= 45 AS ok FROM lineitem UNION ALL SELECT 'discount', 'warning', l_discount <= 0.08 FROM lineitem UNION ALL SELECT 'price', 'error', l_extendedprice > 1000 FROM lineitem) GROUP BY 1""")
def rule_summary(spark: SparkSession, d: str) -> DataFrame:
    """Checks, errors and warnings by rule."""
    rules = {"quantity": ("error", F.col("l_quantity") <= 45), "discount": ("warning", F.col("l_discount") <= 0.08), "price": ("error", F.col("l_extendedprice") > 1000)}
    return checks.summary(checks.findings(_t(spark, d, "lineitem"), "l_orderkey", rules))


@query("SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (0, 2)) AND s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 4 = 1)")
def pin_exclude_filter(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of pinned regions, without the excluded nations."""
    n = _t(spark, d, "nation")
    pinned, out = n.where("n_regionkey IN (0, 2)"), n.where("n_nationkey % 4 = 1")
    s = _t(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    return s.join(pinned, s["s_nationkey"] == pinned["n_nationkey"], "left_semi").join(out, s["s_nationkey"] == out["n_nationkey"], "left_anti")


@query("""SELECT * FROM (SELECT o_orderkey AS id, 'only left' AS side FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT DISTINCT l_orderkey, 'both' FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))""")
def connected_or_not(spark: SparkSession, d: str) -> DataFrame:
    """Each order on exactly one side: reached by lines, or left out."""
    o, lines = _t(spark, d, "orders").select("o_orderkey"), _t(spark, d, "lineitem").groupBy("l_orderkey").count()
    j = o.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "full_outer")
    return j.select(F.coalesce("o_orderkey", "l_orderkey").alias("id"), F.when(F.col("l_orderkey").isNull(), "only left").when(F.col("o_orderkey").isNull(), "only right").otherwise("both").alias("side"))


@query("SELECT event_id, event_type, user_id FROM events WHERE event_type IN ('error', 'signup') ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 20")
def job_page(spark: SparkSession, d: str) -> DataFrame:
    """Second page of twenty, newest first, of rows in some states."""
    e = _t(spark, d, "events").where(F.col("event_type").isin("error", "signup"))
    return selection.page(e, [F.desc("ts"), F.desc("event_id")], 1, 20).select("event_id", "event_type", "user_id")


@query("SELECT event_type, count(*) AS n, sum((props->>'$.k')::BIGINT)::BIGINT AS total, max((props->>'$.k')::BIGINT) AS largest FROM events GROUP BY 1")
def json_props_scan(spark: SparkSession, d: str) -> DataFrame:
    """A typed property of JSON text, by type."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return _t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"), F.max(k).alias("largest"))


@query("""WITH e AS (SELECT s_nationkey AS g, s_suppkey AS id, s_acctbal AS score, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rank FROM supplier)
SELECT g, id, rank FROM (SELECT *, lag(score) OVER (PARTITION BY g ORDER BY rank) AS p FROM e) WHERE p > score""")
def rank_order_faults(spark: SparkSession, d: str) -> DataFrame:
    """Ranks whose score falls below the one before."""
    from pyspark.sql import Window

    s = _t(spark, d, "supplier").select(F.col("s_nationkey").alias("g"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("score"))
    s = s.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("id")).cast("bigint"))
    return selection.rank_faults(s, "g", "rank", "score").select("g", "id", "rank")


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY 1")
def type_counts(spark: SparkSession, d: str) -> DataFrame:
    """Objects by type."""
    return _t(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
