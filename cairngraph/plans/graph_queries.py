"""Scans, hops, traversals, cones, patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairngraph.operators import traversal as T
from cairngraph.plans.intents import Anchor, FilterIntent, NeighborhoodIntent, TraverseIntent, run_pattern
from cairngraph.plans.registry import query
from cairngraph.sources.lineage import dealt
from cairngraph.sources.tables import EDGES_SQL, NODES_SQL, driver_edges, driver_nodes, key, table

WITH = f"WITH {NODES_SQL}, {EDGES_SQL}"
WITH_R = f"WITH RECURSIVE {NODES_SQL}, {EDGES_SQL}"
CANONICAL_SQL = """id, kind, 'semantic' AS category, name, source, 'driver' AS corpus, 'origin:' || source AS origin_id,
  CAST(-1 AS BIGINT) AS start_offset, CAST(-1 AS BIGINT) AS end_offset, CAST(NULL AS INTEGER) AS start_line, CAST(NULL AS INTEGER) AS end_line,
  CAST(NULL AS INTEGER) AS start_col, CAST(NULL AS INTEGER) AS end_col, payload"""


def seed(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id string")


@query("scan_nodes_canonical", f"{WITH} SELECT {CANONICAL_SQL} FROM nodes")
def scan_nodes_canonical(spark, sf):
    return driver_nodes(spark, sf)


@query("filter_intent", f"{WITH} SELECT {CANONICAL_SQL} FROM nodes WHERE kind = 'Part' AND name = 'small ring' ORDER BY id LIMIT 100")
def filter_intent(spark, sf):
    return FilterIntent({"kind": "Part", "name": "small ring"}, 100).plan(driver_nodes(spark, sf))


@query("anchor_unique", f"{WITH} SELECT kind, name, min(id) AS id FROM nodes GROUP BY kind, name HAVING count(*) = 1")
def anchor_unique(spark, sf):
    return driver_nodes(spark, sf).groupBy("kind", "name").agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n = 1").drop("n")


@query("anchor_ambiguous", f"{WITH} SELECT kind, name, count(*) AS n FROM nodes GROUP BY kind, name HAVING count(*) > 1")
def anchor_ambiguous(spark, sf):
    return driver_nodes(spark, sf).groupBy("kind", "name").agg(F.count("*").alias("n")).where("n > 1")


@query("present_sources", f"{WITH} SELECT DISTINCT source FROM nodes")
def present_sources(spark, sf):
    return driver_nodes(spark, sf).select("source").distinct()


@query(
    "hop_two_pairs",
    """SELECT o_orderkey AS order_id, l_partkey AS part_id
       FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE c_nationkey = 3""",
)
def hop_two_pairs(spark, sf):
    customer = table(spark, sf, "customer").where("c_nationkey = 3").select("c_custkey")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    joined = customer.join(orders, F.col("c_custkey") == F.col("o_custkey")).join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select(F.col("o_orderkey").alias("order_id"), F.col("l_partkey").alias("part_id"))


@query("hop_one", f"{WITH} SELECT src, dst FROM edges WHERE type = 'INSTANTIATES'")
def hop_one(spark, sf):
    return driver_edges(spark, sf).where("type = 'INSTANTIATES'").select("src", "dst")


@query("hop_union_types", f"{WITH} SELECT src, dst, type FROM edges WHERE type IN ('PARENT_OF', 'CONTAINS')")
def hop_union_types(spark, sf):
    return T.of_types(driver_edges(spark, sf), ["PARENT_OF", "CONTAINS"]).select("src", "dst", "type")


@query(
    "edge_degree_stats",
    f"""{WITH}, deg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id)
    SELECT id, degree, (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges FROM deg ORDER BY degree DESC, id LIMIT 10""",
)
def edge_degree_stats(spark, sf):
    edges = driver_edges(spark, sf)
    degree = dealt(edges.select(F.explode(F.array("src", "dst")).alias("id")), "id").groupBy("id").agg(F.count("*").alias("degree"))
    top = degree.orderBy(F.col("degree").desc(), "id").limit(10)
    totals = driver_nodes(spark, sf).agg(F.count("*").alias("n_nodes")).crossJoin(edges.agg(F.count("*").alias("n_edges")))
    return top.crossJoin(F.broadcast(totals))  # one row of totals


@query("edge_type_counts", f"{WITH} SELECT type, count(*) AS n, CAST(sum(weight) AS BIGINT) AS weight FROM edges GROUP BY type")
def edge_type_counts(spark, sf):
    return driver_edges(spark, sf).groupBy("type").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


BALL = """, sym AS MATERIALIZED (SELECT DISTINCT src, dst FROM ({edges})),
  walk(id, hop) AS (SELECT {seed}, 0 UNION SELECT s.dst, w.hop + 1 FROM walk w JOIN sym s ON s.src = w.id WHERE w.hop < {depth}),
  ball AS (SELECT id, min(hop) AS hop FROM walk GROUP BY id)"""
BOTH = "SELECT src, dst FROM edges {0} UNION ALL SELECT dst, src FROM edges {0}"
OUT = "SELECT src, dst FROM edges {0}"
INTO = "SELECT dst AS src, src AS dst FROM edges {0}"


@query(
    "neighbors_out_plus_preds",
    f"""{WITH_R}{BALL.format(edges=OUT.format(''), seed="'nation:3'", depth=2)}
    SELECT id FROM ball WHERE hop > 0 UNION SELECT src FROM edges WHERE dst = 'nation:3'""",
)
def neighbors_out_plus_preds(spark, sf):
    return T.neighbors_default(driver_edges(spark, sf), seed(spark, "nation:3"), 2)


@query("neighbors_undirected", f"""{WITH_R}{BALL.format(edges=BOTH.format(''), seed="'supplier:1'", depth=2)} SELECT id, hop FROM ball WHERE hop > 0""")
def neighbors_undirected(spark, sf):
    return T.neighbors_undirected(driver_edges(spark, sf), seed(spark, "supplier:1"), 2)


TYPED = "WHERE type IN ('CONTAINS', 'CONNECTS')"


@query("neighbors_typed_mixed", f"""{WITH_R}{BALL.format(edges=BOTH.format(TYPED), seed="'nation:7'", depth=2)} SELECT id FROM ball WHERE hop > 0""")
def neighbors_typed_mixed(spark, sf):
    return T.neighbors_typed(driver_edges(spark, sf), seed(spark, "nation:7"), ["CONTAINS", "CONNECTS"], 2)


@query(
    "neighbors_typed_pure",
    f"""{WITH_R}, one AS MATERIALIZED ({OUT.format(TYPED)}), two AS MATERIALIZED ({INTO.format(TYPED)}),
    f(id, hop) AS (SELECT 'part:5', 0 UNION SELECT dst, hop + 1 FROM f JOIN one ON src = id WHERE hop < 2),
    b(id, hop) AS (SELECT 'part:5', 0 UNION SELECT dst, hop + 1 FROM b JOIN two ON src = id WHERE hop < 2)
    SELECT id FROM f WHERE hop > 0 UNION SELECT id FROM b WHERE hop > 0""",
)
def neighbors_typed_pure(spark, sf):
    return T.neighbors_typed(driver_edges(spark, sf), seed(spark, "part:5"), ["CONTAINS", "CONNECTS"], 2, mixed=False)


@query(
    "traverse_paths",
    f"""{WITH}, e AS (SELECT src, dst FROM edges WHERE type IN ('PARENT_OF', 'CONTAINS', 'INSTANTIATES'))
    SELECT 1 AS hop, [a.src, a.dst] AS nodes FROM e a WHERE a.src = 'region:1'
    UNION ALL SELECT 2, [a.src, a.dst, b.dst] FROM e a JOIN e b ON a.dst = b.src WHERE a.src = 'region:1'
    UNION ALL SELECT 3, [a.src, a.dst, b.dst, c.dst] FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src WHERE a.src = 'region:1'""",
)
def traverse_paths(spark, sf):
    edges = T.forward(T.of_types(driver_edges(spark, sf), ["PARENT_OF", "CONTAINS", "INSTANTIATES"]))
    return T.paths(seed(spark, "region:1"), edges, 3).select("hop", "nodes")


@query(
    "traverse_intent_limited",
    f"""{WITH} SELECT 1 AS hop, [src, dst] AS nodes, [type] AS types FROM edges WHERE src = 'nation:3' AND type = 'CONTAINS' ORDER BY nodes LIMIT 20""",
)
def traverse_intent_limited(spark, sf):
    return TraverseIntent(Anchor(kind="Nation", name="NATION_3"), ("CONTAINS",), "fwd", 1, 20).plan(driver_nodes(spark, sf), driver_edges(spark, sf))


@query("neighborhood_ball", f"""{WITH_R}{BALL.format(edges=BOTH.format(''), seed="'nation:4'", depth=2)} SELECT id, hop FROM ball ORDER BY hop, id LIMIT 500""")
def neighborhood_ball(spark, sf):
    return NeighborhoodIntent(Anchor(id="nation:4"), 2, 500).plan(driver_nodes(spark, sf), driver_edges(spark, sf))


@query(
    "path_pattern",
    f"""{WITH}, e AS (SELECT src, dst, type FROM edges),
    h1 AS (SELECT a.src AS seed, a.dst AS t, [a.src, a.dst] AS nodes FROM e a WHERE a.type = 'PARENT_OF' AND a.src LIKE 'region:%'),
    c1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY nodes) AS n FROM h1) WHERE n <= 50),
    h2 AS (SELECT seed, b.dst AS t, list_append(nodes, b.dst) AS nodes FROM c1 JOIN e b ON b.src = t AND b.type = 'CONTAINS'),
    c2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY nodes) AS n FROM h2) WHERE n <= 50),
    h3 AS (SELECT seed, c.dst AS t, list_append(nodes, c.dst) AS nodes FROM c2 JOIN e c ON c.src = t AND c.type = 'INSTANTIATES'),
    c3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY nodes) AS n FROM h3) WHERE n <= 50)
    SELECT seed, t AS terminal, 'PARENT_OF/CONTAINS/INSTANTIATES' AS label, min(nodes) AS nodes FROM c3 GROUP BY seed, t""",
)
def path_pattern(spark, sf):
    seeds = driver_nodes(spark, sf).where("kind = 'Region'").select("id")
    return T.path_pattern(seeds, driver_edges(spark, sf), ["PARENT_OF", "CONTAINS", "INSTANTIATES"], directed=True)


SHARED = "WHERE type = 'CONNECTS'"


@query("bfs_hops", f"""{WITH_R}{BALL.format(edges=BOTH.format(SHARED), seed="'supplier:0'", depth=4)} SELECT id, hop FROM ball""")
def bfs_hops(spark, sf):
    return T.reach(seed(spark, "supplier:0"), T.both_ways(T.of_types(driver_edges(spark, sf), ["CONNECTS"])), 4)


@query(
    "shortest_path",
    f"""{WITH}, s AS MATERIALIZED ({BOTH.format(SHARED)}),
    one AS (SELECT min([a.src, a.dst]) AS path, a.dst AS id FROM s a WHERE a.src = 'supplier:0' GROUP BY a.dst),
    two AS (SELECT min(list_append(path, s.dst)) AS path, s.dst AS id FROM one JOIN s ON s.src = one.id WHERE s.dst NOT IN (SELECT id FROM one) AND s.dst <> 'supplier:0' GROUP BY s.dst)
    SELECT id, 2 AS hop, path FROM two WHERE id IN ('supplier:7', 'supplier:8')""",
)
def shortest_path(spark, sf):
    edges = T.of_types(driver_edges(spark, sf), ["CONNECTS"])
    return T.shortest_path(edges, seed(spark, "supplier:0"), seed(spark, "supplier:7", "supplier:8"), 4, undirected=True)


def flow_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Dataflow over events: a user drives an event type; a type reads an hour; an hour connects to the users of it."""
    events = table(spark, sf, "events")
    hour = F.concat(F.lit("hour:"), F.hour("ts").cast("string"))
    user, kind = key("user", "user_id"), F.concat(F.lit("type:"), F.col("event_type"))
    rows = lambda a, b, t: events.select(a.alias("src"), b.alias("dst"), F.lit(t).alias("type")).distinct()
    purchases = events.where("event_type = 'purchase' AND value > 95")
    return (
        rows(user, kind, "DRIVES").unionByName(rows(kind, hour, "READS"))
        .unionByName(purchases.select(hour.alias("src"), user.alias("dst"), F.lit("CONNECTS").alias("type")).distinct())
    )


FLOW_SQL = """WITH RECURSIVE ev AS (SELECT 'user:' || user_id AS u, 'type:' || event_type AS k, 'hour:' || hour(ts) AS h, event_type, value FROM events),
  drives AS MATERIALIZED (SELECT DISTINCT u AS src, k AS dst FROM ev), reads AS MATERIALIZED (SELECT DISTINCT k AS src, h AS dst FROM ev),
  connects AS MATERIALIZED (SELECT DISTINCT h AS src, u AS dst FROM ev WHERE event_type = 'purchase' AND value > 95)"""


@query(
    "cone_backward",
    f"""{FLOW_SQL}, adj AS MATERIALIZED (SELECT dst AS src, src AS dst FROM drives UNION SELECT d.dst, r.dst FROM drives d JOIN reads r ON d.src = r.src UNION SELECT dst, src FROM connects),
    cone(id) AS (SELECT 'type:click' UNION SELECT adj.dst FROM cone JOIN adj ON adj.src = cone.id) SELECT id FROM cone""",
)
def cone_backward(spark, sf):
    return T.cone_of_influence(flow_edges(spark, sf), seed(spark, "type:click")).select("id")


@query(
    "cone_forward",
    f"""{FLOW_SQL}, adj AS MATERIALIZED (SELECT dst AS src, src AS dst FROM reads UNION SELECT r.dst, d.dst FROM reads r JOIN drives d ON d.src = r.src UNION SELECT src, dst FROM connects UNION SELECT dst, src FROM connects),
    cone(id) AS (SELECT 'hour:5' UNION SELECT adj.dst FROM cone JOIN adj ON adj.src = cone.id) SELECT id FROM cone""",
)
def cone_forward(spark, sf):
    return T.forward_cone(flow_edges(spark, sf), seed(spark, "hour:5")).select("id")


@query(
    "find_drivers",
    f"{FLOW_SQL} SELECT src AS id FROM drives WHERE dst = 'type:view'",
)
def find_drivers(spark, sf):
    return flow_edges(spark, sf).where("type = 'DRIVES' AND dst = 'type:view'").select(F.col("src").alias("id"))


@query(
    "reachability_root",
    """WITH RECURSIVE adj AS (SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst FROM nation
      UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer
      UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey FROM supplier),
    r(id, hop) AS (SELECT 'region:2', 0 UNION SELECT adj.dst, hop + 1 FROM r JOIN adj ON adj.src = r.id) SELECT id, hop FROM r""",
)
def reachability_root(spark, sf):
    edges = driver_edges(spark, sf)
    down = edges.where("type = 'PARENT_OF'").withColumn("type", F.lit("INSTANTIATES"))
    bound = edges.where("type = 'CONTAINS'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("BOUND_INTO").alias("type"), "weight")
    return T.reachability(driver_nodes(spark, sf), down.unionByName(bound), seed(spark, "region:2"))


def turn_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn to the next of its conversation."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn").distinct()
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("turn").alias("next"))
    return turns.join(after, ["conv_id", "turn"]).select(key("turn", "conv_id", "turn").alias("src"), F.concat_ws(":", F.lit("turn"), "conv_id", "next").alias("dst"), F.lit("READS").alias("type"))


@query(
    "trace_paths",
    """WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT 'turn:' || a.conv_id || ':' || a.turn AS src, 'turn:' || b.conv_id || ':' || b.turn AS dst FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
    w(id, hop, path) AS (SELECT DISTINCT 'turn:' || conv_id || ':0', 0, ['turn:' || conv_id || ':0'] FROM conversations WHERE turn = 0
      UNION ALL SELECT e.dst, hop + 1, list_append(path, e.dst) FROM w JOIN e ON e.src = w.id WHERE hop < 50)
    SELECT id, hop, path FROM w""",
)
def trace_paths(spark, sf):
    starts = table(spark, sf, "conversations").where("turn = 0").select(key("turn", "conv_id", "turn").alias("id"))
    return T.first_paths(starts, turn_edges(spark, sf), 50)


@query(
    "ancestor_chase",
    f"""{WITH} SELECT c.dst AS seed, p.src AS id, 2 AS hop FROM edges p JOIN edges c ON c.src = p.dst WHERE p.type = 'PARENT_OF' AND c.type = 'CONTAINS'
    UNION ALL SELECT dst, src, 1 FROM edges WHERE type IN ('PARENT_OF', 'CONTAINS')""",
)
def ancestor_chase(spark, sf):
    edges = T.of_types(driver_edges(spark, sf), ["PARENT_OF", "CONTAINS"])
    return T.reach_pairs(edges.select(F.col("dst").alias("id")), T.backward(edges), 8)


@query(
    "subtree_text_ordered",
    "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS text, count(*) AS n FROM conversations GROUP BY conv_id",
)
def subtree_text_ordered(spark, sf):
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"), F.count("*").alias("n"))
    return rows.select("conv_id", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("text"), "n")


@query(
    "pattern_two_hops",
    f"""{WITH} SELECT DISTINCT a.name AS nation, p.id AS part FROM nodes a JOIN edges x ON x.src = a.id AND x.type = 'CONTAINS' JOIN nodes s ON s.id = x.dst AND s.kind = 'Supplier'
    JOIN edges y ON y.src = s.id AND y.type = 'CONNECTS' JOIN nodes p ON p.id = y.dst AND p.kind = 'Part' WHERE a.kind = 'Nation' AND a.name IN ('NATION_1', 'NATION_2')""",
)
def pattern_two_hops(spark, sf):
    text = """MATCH (a:Nation)-[:CONTAINS]->(s:Supplier)-[:CONNECTS]->(p:Part) WHERE a.name IN ['NATION_1', 'NATION_2'] RETURN DISTINCT a.name AS nation, p.id AS part"""
    return run_pattern(text, driver_nodes(spark, sf), driver_edges(spark, sf))


@query(
    "pattern_aggregate",
    f"""{WITH} SELECT n.name AS nation, count(o.dst) AS n_orders FROM nodes n JOIN edges c ON c.src = n.id AND c.type = 'CONTAINS' JOIN edges o ON o.src = c.dst AND o.type = 'INSTANTIATES'
    WHERE n.kind = 'Nation' GROUP BY n.name ORDER BY n_orders DESC, nation LIMIT 10""",
)
def pattern_aggregate(spark, sf):
    text = """MATCH (n:Nation)-[:CONTAINS]->(c)-[:INSTANTIATES]->(o) RETURN n.name AS nation, count(o.id) AS n_orders ORDER BY n_orders DESC, nation LIMIT 10"""
    return run_pattern(text, driver_nodes(spark, sf), driver_edges(spark, sf))


@query("param_map", f"""{WITH} SELECT src, string_agg(dst || '=' || weight, ',' ORDER BY dst) AS params FROM edges WHERE type = 'CONNECTS' GROUP BY src""")
def param_map(spark, sf):
    rows = driver_edges(spark, sf).where("type = 'CONNECTS'").groupBy("src").agg(F.map_from_entries(F.collect_list(F.struct("dst", "weight"))).alias("m"))
    entries = F.array_sort(F.transform(F.map_entries("m"), lambda e: F.struct(e["key"].alias("k"), F.concat(e["key"], F.lit("="), e["value"].cast("string")).alias("s"))))
    return rows.select("src", F.array_join(F.transform(entries, lambda e: e["s"]), ",").alias("params"))


@query(
    "json_payload",
    f"""{WITH} SELECT id, json_extract_string(payload, '$.brand') AS brand, json_extract_string(payload, '$.type') AS type FROM nodes WHERE kind = 'Part'""",
)
def json_payload(spark, sf):
    return driver_nodes(spark, sf).where("kind = 'Part'").select("id", F.get_json_object("payload", "$.brand").alias("brand"), F.get_json_object("payload", "$.type").alias("type"))


@query("event_props", "SELECT CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1")
def event_props(spark, sf):
    return table(spark, sf, "events").groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"))
