"""Tables in, graph frames out.

``nodes`` and ``edges`` are unions of one projection a table.  Filters on ``kind`` or
``type`` are constants in each branch, so Catalyst drops the branches that cannot
match and pushes the rest to the Parquet scans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairngraph.sources.lineage import dealt

NODE_FIELDS = (
    "id", "kind", "category", "name", "source", "corpus", "origin_id",
    "start_offset", "end_offset", "start_line", "end_line", "start_col", "end_col", "payload",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(kind: str, *columns: str) -> Column:
    """``kind:<k>[:<k>]``, the id of a node."""
    return F.concat_ws(":", F.lit(kind), *[F.col(c).cast("string") for c in columns])


def node_rows(df: DataFrame, kind: str, identity: Column, name: Column, source: str, payload: Column) -> DataFrame:
    absent = F.lit(-1).cast("long")
    none = F.lit(None).cast("int")
    return df.select(
        identity.alias("id"), F.lit(kind).alias("kind"), F.lit("semantic").alias("category"), name.cast("string").alias("name"),
        F.lit(source).alias("source"), F.lit("driver").alias("corpus"), F.concat(F.lit("origin:"), F.lit(source)).alias("origin_id"),
        absent.alias("start_offset"), absent.alias("end_offset"), none.alias("start_line"), none.alias("end_line"),
        none.alias("start_col"), none.alias("end_col"), payload.alias("payload"),
    )


def _payload(**fields: str) -> Column:
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":"'), F.col(c).cast("string"), F.lit('"')) for k, c in fields.items()]), F.lit("}"))


def driver_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the driver tables, in the canonical 14 columns."""
    t = lambda name: table(spark, sf_dir, name)
    empty = F.lit("{}")
    branches = [
        node_rows(t("region"), "Region", key("region", "r_regionkey"), F.col("r_name"), "region", empty),
        node_rows(t("nation"), "Nation", key("nation", "n_nationkey"), F.col("n_name"), "nation", empty),
        node_rows(t("customer"), "Customer", key("customer", "c_custkey"), F.col("c_name"), "customer", _payload(segment="c_mktsegment")),
        node_rows(t("supplier"), "Supplier", key("supplier", "s_suppkey"), F.col("s_name"), "supplier", empty),
        node_rows(t("part"), "Part", key("part", "p_partkey"), F.col("p_name"), "part", _payload(brand="p_brand", type="p_type")),
        node_rows(t("orders"), "Order", key("order", "o_orderkey"), F.col("o_orderkey"), "orders", _payload(status="o_orderstatus")),
    ]
    return reduce(DataFrame.unionByName, branches)


def driver_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, type, weight) of the driver tables; one row for each (src, dst, type)."""
    t = lambda name: table(spark, sf_dir, name)

    def rows(df: DataFrame, src: Column, dst: Column, kind: str) -> DataFrame:
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), F.lit(1).cast("long").alias("weight"))

    lines = t("lineitem")
    counted = lambda *keys: dealt(lines.select(*keys), *keys).groupBy(*keys).agg(F.count("*").alias("weight"))
    pairs, supplies = counted("l_orderkey", "l_partkey"), counted("l_suppkey", "l_partkey")
    branches = [
        rows(t("nation"), key("region", "n_regionkey"), key("nation", "n_nationkey"), "PARENT_OF"),
        rows(t("customer"), key("nation", "c_nationkey"), key("customer", "c_custkey"), "CONTAINS"),
        rows(t("supplier"), key("nation", "s_nationkey"), key("supplier", "s_suppkey"), "CONTAINS"),
        rows(t("orders"), key("customer", "o_custkey"), key("order", "o_orderkey"), "INSTANTIATES"),
        pairs.select(key("order", "l_orderkey").alias("src"), key("part", "l_partkey").alias("dst"), F.lit("OF_MODULE").alias("type"), "weight"),
        supplies.select(key("supplier", "l_suppkey").alias("src"), key("part", "l_partkey").alias("dst"), F.lit("CONNECTS").alias("type"), "weight"),
    ]
    return reduce(DataFrame.unionByName, branches)


#: The same two frames for DuckDB, as the start of a WITH clause.
NODES_SQL = """nodes AS (
  SELECT 'region:' || r_regionkey AS id, 'Region' AS kind, r_name AS name, 'region' AS source, '{}' AS payload FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'Nation', n_name, 'nation', '{}' FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'Customer', c_name, 'customer', '{"segment":"' || c_mktsegment || '"}' FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'Supplier', s_name, 'supplier', '{}' FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'Part', p_name, 'part', '{"brand":"' || p_brand || '","type":"' || p_type || '"}' FROM part
  UNION ALL SELECT 'order:' || o_orderkey, 'Order', CAST(o_orderkey AS VARCHAR), 'orders', '{"status":"' || o_orderstatus || '"}' FROM orders)"""
EDGES_SQL = """edges AS MATERIALIZED (
  SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst, 'PARENT_OF' AS type, CAST(1 AS BIGINT) AS weight FROM nation
  UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'CONTAINS', 1 FROM customer
  UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'CONTAINS', 1 FROM supplier
  UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey, 'INSTANTIATES', 1 FROM orders
  UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'OF_MODULE', count(*) FROM lineitem GROUP BY l_orderkey, l_partkey
  UNION ALL SELECT 'supplier:' || l_suppkey, 'part:' || l_partkey, 'CONNECTS', count(*) FROM lineitem GROUP BY l_suppkey, l_partkey)"""
