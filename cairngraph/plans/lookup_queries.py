"""Lookups and connectors over the driver tables, read as modules, instances, classes and captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairngraph.operators import connectors as C
from cairngraph.operators import lookups as L
from cairngraph.plans.registry import query
from cairngraph.sources.tables import NODES_SQL, driver_nodes, key, table

PATHS_SQL = """paths AS (SELECT 'customer:' || c_custkey AS id, n_name || '.' || c_mktsegment || '.' || c_name AS path FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT 'order:' || o_orderkey, 'orders.' || o_orderkey || '.' || o_orderstatus FROM orders),
  wanted AS (SELECT c_name AS name FROM customer UNION SELECT c_mktsegment || '.' || c_name FROM customer UNION SELECT path FROM paths UNION SELECT o_orderstatus FROM orders UNION SELECT 'no.such.name')"""


@query(
    "find_by_name",
    f"""WITH {PATHS_SQL}, tails AS (SELECT id, path, list_transform(generate_series(2, len(string_split(path, '.'))), lambda i: array_to_string(string_split(path, '.')[i:], '.')) AS t FROM paths),
    hit AS (SELECT unnest(t) AS name, id FROM tails), one AS (SELECT name, min(id) AS id FROM hit GROUP BY name HAVING count(*) = 1)
    SELECT w.name, coalesce(p.id, o.id, '-') AS id FROM wanted w LEFT JOIN paths p ON p.path = w.name LEFT JOIN one o ON o.name = w.name""",
)
def find_by_name(spark, sf):
    customers = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    orders = table(spark, sf, "orders")
    nodes = customers.select(key("customer", "c_custkey").alias("id"), F.concat_ws(".", "n_name", "c_mktsegment", "c_name").alias("path")).unionByName(
        orders.select(key("order", "o_orderkey").alias("id"), F.concat_ws(".", F.lit("orders"), F.col("o_orderkey").cast("string"), "o_orderstatus").alias("path"))
    )
    wanted = customers.select(F.explode(F.array("c_name", F.concat_ws(".", "c_mktsegment", "c_name"))).alias("name"))
    wanted = wanted.unionByName(nodes.select(F.col("path").alias("name"))).unionByName(orders.select(F.col("o_orderstatus").alias("name"))).unionByName(spark.createDataFrame([("no.such.name",)], "name string"))
    return L.find_by_name(nodes, wanted).select("name", F.coalesce("id", F.lit("-")).alias("id"))


@query("instances_of", "SELECT 'customer:' || o_custkey AS module, string_agg('order:' || o_orderkey, ',' ORDER BY 'order:' || o_orderkey) AS instances FROM orders GROUP BY o_custkey")
def instances_of(spark, sf):
    edges = table(spark, sf, "orders").select(key("order", "o_orderkey").alias("src"), key("customer", "o_custkey").alias("dst"), F.lit("OF_MODULE").alias("type"))
    return L.instances_of(edges).select("module", F.array_join("instances", ",").alias("instances"))


@query("port_connections", "SELECT CAST(l_orderkey AS VARCHAR) AS instance, 'port:' || l_linenumber AS port, 'part:' || l_partkey AS src FROM lineitem")
def port_connections(spark, sf):
    props = F.create_map(F.lit("instance"), F.col("l_orderkey").cast("string"))
    return L.port_connections(table(spark, sf, "lineitem").select(key("part", "l_partkey").alias("src"), key("port", "l_linenumber").alias("dst"), F.lit("CONNECTS").alias("type"), props.alias("props")))


@query("modports_of", "SELECT 'nation:' || s_nationkey AS interface, string_agg(DISTINCT s_name, ',' ORDER BY s_name) AS modports FROM supplier GROUP BY s_nationkey")
def modports_of(spark, sf):
    edges = table(spark, sf, "supplier").select(key("nation", "s_nationkey").alias("src"), key("supplier", "s_suppkey").alias("dst"), F.lit("HAS_MODPORT").alias("type"))
    return L.modports_of(edges, driver_nodes(spark, sf)).select("interface", F.array_join("modports", ",").alias("modports"))


@query("package_of", "SELECT 'type:' || p_type AS typedef, min(p_brand) AS package FROM part GROUP BY p_type")
def package_of(spark, sf):
    parts = table(spark, sf, "part")
    edges = parts.select(key("brand", "p_brand").alias("src"), key("type", "p_type").alias("dst"), F.lit("HAS_TYPEDEF").alias("type")).distinct()
    return L.package_of(edges, parts.select(key("brand", "p_brand").alias("id"), F.col("p_brand").alias("name")).distinct())


@query("param_overrides", "WITH p AS (SELECT l_suppkey, l_partkey, min(l_quantity) AS v FROM lineitem GROUP BY ALL) SELECT 'supplier:' || l_suppkey AS instance, string_agg('part:' || l_partkey || '=' || CAST(v AS BIGINT), ',' ORDER BY 'part:' || l_partkey) AS params FROM p GROUP BY l_suppkey")
def param_overrides(spark, sf):
    edges = table(spark, sf, "lineitem").select(key("supplier", "l_suppkey").alias("src"), key("part", "l_partkey").alias("dst"), F.lit("OVERRIDES").alias("type"), F.col("l_quantity").cast("long").alias("value"))
    entry = lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    return L.param_overrides(edges).select("instance", F.array_join(F.transform(F.map_entries("params"), entry), ",").alias("params"))


@query("sensitivity_of", "SELECT DISTINCT 'user:' || user_id AS block, event_type AS signal, CASE WHEN value > 50 THEN 'posedge' ELSE 'negedge' END AS edge FROM events")
def sensitivity_of(spark, sf):
    edge = F.when(F.col("value") > 50, "posedge").otherwise("negedge")
    return L.sensitivity_of(table(spark, sf, "events").select(key("user", "user_id").alias("src"), F.col("event_type").alias("dst"), F.lit("SENSITIVE_TO").alias("type"), F.create_map(F.lit("edge"), edge).alias("props")))


def declarations(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens (id, position, text) of ``TYPE [size:0] name [3:0] = size``, a part each; parts of odd size have no default."""
    size = F.col("p_size").cast("string")
    text = F.concat_ws(" ", "p_type", F.concat(F.lit("["), size, F.lit(":0]")), F.concat(F.lit("n_"), F.col("p_partkey").cast("string")), F.lit("[3:0]"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("= "), size)))
    return table(spark, sf, "part").select(key("part", "p_partkey").alias("id"), F.posexplode(F.split(text, " ")).alias("position", "text"))


@query("width_of", "SELECT 'part:' || p_partkey AS id, p_type AS data_type, '[' || p_size || ':0]' AS packed_dim, '[3:0]' AS unpacked_dim FROM part")
def width_of(spark, sf):
    names = table(spark, sf, "part").select(key("part", "p_partkey").alias("id"), F.concat(F.lit("n_"), F.col("p_partkey").cast("string")).alias("name"))
    return L.width_of(declarations(spark, sf), names)


@query("default_value_of", "SELECT 'part:' || p_partkey AS id, CAST(p_size AS VARCHAR) AS value FROM part WHERE p_size % 2 = 0")
def default_value_of(spark, sf):
    return L.default_value_of(declarations(spark, sf))


# --- connectors ---------------------------------------------------------------


@query("self_references", f"WITH {NODES_SQL} SELECT id AS src, id AS dst, 'CONTAINS' AS type FROM nodes")
def self_references(spark, sf):
    return C.self_references(driver_nodes(spark, sf))


@query(
    "code_references",
    """WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]+')) AS name FROM benchmark),
    s AS (SELECT 'inline:' || item_id AS src, [trim(string_split(text, ' ')[1])] AS t FROM benchmark UNION ALL SELECT 'fence:' || doc_id, list_distinct(regexp_extract_all(text, '[A-Za-z0-9_]+')) FROM documents),
    w AS (SELECT src, unnest(t) AS name FROM s) SELECT DISTINCT src, 'name:' || name AS dst, 'REFERENCES' AS type, name AS ref_text FROM w JOIN n USING (name)""",
)
def code_references(spark, sf):
    words = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("name")).distinct()
    names = words.select(key("name", "name").alias("id"), F.lit("c").alias("corpus"), "name")
    inline = table(spark, sf, "benchmark").select(key("inline", "item_id").alias("id"), F.lit("c").alias("corpus"), F.lit("inline").alias("kind"), F.substring_index("text", " ", 1).alias("text"))
    fences = table(spark, sf, "documents").select(key("fence", "doc_id").alias("id"), F.lit("c").alias("corpus"), F.lit("fence").alias("kind"), "text")
    return C.code_references(inline.unionByName(fences), names)


def decorated(spark: SparkSession, sf: str) -> DataFrame:
    """Declarations (id, kind, decorators, aliases): a decorator by the part's size, one that means nothing before it."""
    kind = F.when(F.col("p_partkey") % 2 == 0, "PyFunction").otherwise("PyClass")
    by_size = F.element_at(F.array(*[F.lit(d) for d in ("property", "dc(frozen=True)", "pt.fixture(scope='x')", "functools.cached_property", "staticmethod")]), (F.col("p_size") % 5 + 1).cast("int"))
    aliases = F.create_map(F.lit("dc"), F.lit("dataclasses.dataclass"), F.lit("pt"), F.lit("pytest"))
    return table(spark, sf, "part").select(key("part", "p_partkey").alias("id"), kind.alias("kind"), F.array(F.lit("trace"), by_size).alias("decorators"), aliases.alias("aliases"))


@query(
    "decorator_roles",
    """SELECT 'part:' || p_partkey AS id, CASE p_size % 5 WHEN 0 THEN 'property' WHEN 1 THEN 'dataclass' ELSE 'fixture' END AS role FROM part
    WHERE (p_partkey % 2 = 0 AND p_size % 5 IN (0, 2)) OR (p_partkey % 2 = 1 AND p_size % 5 = 1)""",
)
def decorator_roles(spark, sf):
    return C.decorator_roles(decorated(spark, sf))


@query("property_descriptors", "SELECT 'part:' || p_partkey AS id, 'property-descriptor' AS role FROM part WHERE p_partkey % 2 = 0 AND p_size % 5 IN (0, 3)")
def property_descriptors(spark, sf):
    return C.property_descriptors(decorated(spark, sf))


def classes(spark: SparkSession, sf: str) -> DataFrame:
    """Regions without bases, nations that extend their region, customers that extend ``pkg.<nation>``."""
    regions = table(spark, sf, "region")
    nations = table(spark, sf, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    customers = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = regions.select(key("region", "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.array().cast("array<string>").alias("bases"))
    rows = rows.unionByName(nations.select(key("nation", "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.array("r_name").alias("bases")))
    rows = rows.unionByName(customers.select(key("customer", "c_custkey").alias("id"), F.col("c_name").alias("name"), F.array(F.concat(F.lit("pkg."), F.col("n_name"))).alias("bases")))
    return rows.withColumn("qualname", F.concat(F.lit("m."), F.col("name")))


@query("base_edges", "SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst, 'EXTENDS' AS type FROM nation UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'EXTENDS' FROM customer")
def base_edges(spark, sf):
    return C.base_edges(classes(spark, sf))


@query(
    "descriptor_roles",
    """SELECT 'region:' || r_regionkey AS id, 'descriptor' AS role FROM region WHERE r_regionkey IN (1, 3) UNION ALL SELECT 'nation:' || n_nationkey, 'descriptor' FROM nation WHERE n_regionkey IN (1, 3)
    UNION ALL SELECT 'customer:' || c_custkey, 'descriptor' FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey IN (1, 3)""",
)
def descriptor_roles(spark, sf):
    """Two regions declare ``__get__``; all that descend from them inherit the role."""
    methods = table(spark, sf, "region").select(key("region", "r_regionkey").alias("class_id"), F.when(F.col("r_regionkey").isin(1, 3), "__get__").otherwise("close").alias("name"))
    return C.method_roles(classes(spark, sf), methods, "__get__", "descriptor")


@query("metaclass_roles", "SELECT 'nation:' || n_nationkey AS id, 'meta' AS role FROM nation WHERE n_regionkey IN (1, 3)")
def metaclass_roles(spark, sf):
    regions, nations = table(spark, sf, "region"), table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = regions.select(key("region", "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("metaclass"))
    rows = rows.unionByName(nations.select(key("nation", "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("pkg."), F.col("r_name")).alias("metaclass")))
    tagged = regions.where(F.col("r_regionkey").isin(1, 3)).select(key("region", "r_regionkey").alias("id"), F.lit("meta").alias("role"))
    return C.metaclass_roles(rows, tagged)


@query(
    "of_type_edges",
    """WITH t AS (SELECT o_orderstatus AS name, 'order:' || min(o_orderkey) AS dst FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_orderstatus)
    SELECT 'line:' || l_orderkey || ':' || l_linenumber AS src, coalesce(dst, '_unresolved.' || l_linestatus) AS dst, 'OF_TYPE' AS type FROM lineitem LEFT JOIN t ON l_linestatus = name""",
)
def of_type_edges(spark, sf):
    signals = table(spark, sf, "lineitem").select(key("line", "l_orderkey", "l_linenumber").alias("id"), F.col("l_linestatus").alias("type_name"))
    types = table(spark, sf, "orders").where("o_orderstatus <> 'P'").groupBy("o_orderstatus").agg(F.min("o_orderkey").alias("k")).select(key("order", "k").alias("id"), F.col("o_orderstatus").alias("name"))
    return C.of_type_edges(signals, types)


@query(
    "checks_edges",
    """SELECT 'check:' || c_custkey AS src, 'customer:' || c_custkey AS dst, 'CHECKS' AS type, c_name AS name FROM customer
    UNION ALL SELECT 'top:' || n_nationkey, 'nation:' || n_nationkey, 'CHECKS', n_name FROM nation""",
)
def checks_edges(spark, sf):
    """Customers are checked by their path, nations by a bare name; segments, which many signals bear, by neither."""
    customers, nations = table(spark, sf, "customer"), table(spark, sf, "nation")
    named = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    signals = named.select(key("customer", "c_custkey").alias("id"), F.concat_ws(".", "n_name", "c_name").alias("path"), F.lit("same").alias("name"))
    signals = signals.unionByName(nations.select(key("nation", "n_nationkey").alias("id"), F.concat_ws(".", F.lit("world"), "n_name").alias("path"), F.col("n_name").alias("name")))
    signals = signals.unionByName(named.select(key("segment", "c_custkey").alias("id"), F.concat_ws(".", F.lit("s"), F.col("c_custkey").cast("string")).alias("path"), F.col("c_mktsegment").alias("name")))
    asked = named.select(key("check", "c_custkey").alias("id"), F.col("n_name").alias("scope"), F.col("c_name").alias("name"))
    asked = asked.unionByName(nations.select(key("top", "n_nationkey").alias("id"), F.lit("nowhere").alias("scope"), F.col("n_name").alias("name")))
    asked = asked.unionByName(named.select(key("many", "c_custkey").alias("id"), F.lit("nowhere").alias("scope"), F.col("c_mktsegment").alias("name")))
    return C.checks_edges(asked, signals)


@query(
    "resolve_captures",
    """SELECT p_partkey AS capture_id,
      CASE p_size % 6 WHEN 0 THEN 'local-in-enclosing' WHEN 1 THEN 'cross-file-import' WHEN 2 THEN 'module-import' WHEN 3 THEN 'module-level' WHEN 4 THEN 'builtin' ELSE 'unresolved' END AS resolution,
      CASE p_size % 6 WHEN 1 THEN 'export:' || p_partkey WHEN 2 THEN 'mod' || p_partkey WHEN 3 THEN 'part:' || p_partkey ELSE '-' END AS target FROM part""",
)
def resolve_captures(spark, sf):
    """A capture a part, its name defined in the place its size names and in all that come after it."""
    number = F.col("p_partkey").cast("string")
    rows = table(spark, sf, "part").select(
        F.col("p_partkey").alias("capture_id"), (F.col("p_size") % 6).alias("at"), F.concat(F.lit("f"), number).alias("uri"), F.lit("fn").alias("scope"),
        F.when(F.col("p_size") % 6 == 4, "len").otherwise(F.concat(F.lit("v"), number)).alias("name"), F.concat(F.lit("mod"), number).alias("module"),
        key("export", "p_partkey").alias("export_id"), key("part", "p_partkey").alias("own_id"),
    )
    item = F.lit("thing")
    imports = rows.where("at <= 1").select("uri", "name", "module", item.alias("item")).unionByName(rows.where("at <= 2").select("uri", "name", "module", F.lit(None).cast("string").alias("item")))
    exports = rows.where("at <= 1").select("module", item.alias("item"), F.col("export_id").alias("id"))
    own = rows.where("at <= 3").select("uri", "name", F.col("own_id").alias("id"))
    found = C.resolve_captures(rows.select("capture_id", "uri", "scope", "name"), rows.where("at = 0").select("uri", "scope", "name"), own, imports, exports)
    return found.withColumn("target", F.coalesce("target", F.lit("-")))
