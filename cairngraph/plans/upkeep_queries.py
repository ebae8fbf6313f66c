"""Fusion, audits, layers, resolution, communities, lifecycle, evaluation, ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairngraph.operators import audit as A
from cairngraph.operators import fusion as U
from cairngraph.operators import resolution as R
from cairngraph.operators import similar
from cairngraph.plans.registry import query
from cairngraph.sources import lifecycle as L
from cairngraph.sources.lineage import dealt
from cairngraph.sources.tables import key, table
from cairngraph.streaming import ingest


def observations(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as triples: an order supplies a part, with a confidence from the tax and a tier from the discount."""
    lines = table(spark, sf, "lineitem")
    tier = F.when(F.col("l_discount") < 0.03, "low").when(F.col("l_discount") < 0.07, "medium").otherwise("high")
    return lines.select(
        key("order", "l_orderkey").alias("subject"), F.lit("supplies").alias("predicate"), key("part", "l_partkey").alias("object"), F.col("l_quantity").alias("weight"),
        (0.1 + F.col("l_tax") * 5).alias("confidence"), tier.alias("confidence_tier"), (F.col("l_linestatus") == "F").alias("resolved"), F.col("l_returnflag").alias("source"),
        F.col("l_linestatus").alias("slice"),
    )


OBS_SQL = """WITH obs AS (SELECT 'order:' || l_orderkey AS subject, 'supplies' AS predicate, 'part:' || l_partkey AS object, l_quantity AS weight, 0.1 + l_tax * 5 AS confidence,
  CASE WHEN l_discount < 0.03 THEN 0 WHEN l_discount < 0.07 THEN 1 ELSE 2 END AS tier, l_linestatus = 'F' AS resolved, l_returnflag AS source, l_linestatus AS slice FROM lineitem)"""


@query(
    "fuse_edges",
    f"""{OBS_SQL} SELECT subject, predicate, object, sum(weight) AS weight, round(1 - product(1 - confidence), 6) AS confidence,
    ['low', 'medium', 'high'][max(tier) + 1] AS confidence_tier, bool_or(resolved) AS resolved, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources,
    CASE WHEN count(DISTINCT slice) = 1 THEN min(slice) END AS slice, count(*) AS n_observations FROM obs GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY subject, predicate, object"),
)
def fuse_edges(spark, sf):
    fused = U.fuse_triples(observations(spark, sf))
    return fused.withColumn("confidence", F.round("confidence", 6)).withColumn("sources", F.array_join("sources", ","))


def mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Words of documents that start with a capital, as mentions in order of document and place."""
    docs = table(spark, sf, "documents")
    words = docs.select("doc_id", "source", F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("pos", "name")).where(F.col("name").rlike("^[A-Z]"))
    return words.select("name", (F.col("doc_id") * 1_000_000 + F.col("pos")).alias("seq"), F.lit("concept").alias("type"), F.lit("text").alias("layer"), "source", F.lit(None).cast("boolean").alias("is_test"))


@query(
    "upsert_entities",
    """WITH w AS (SELECT doc_id, source, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS name, generate_subscripts(regexp_extract_all(text, '[A-Za-z]+'), 1) - 1 AS pos FROM documents)
    SELECT lower(name) AS name_lower, arg_min(name, doc_id * 1000000 + pos) AS name, count(*) AS mention_count, count(DISTINCT source) AS n_sources
    FROM w WHERE regexp_matches(name, '^[A-Z]') GROUP BY lower(name)""",
)
def upsert_entities(spark, sf):
    return U.upsert_entities(mentions(spark, sf)).select("name_lower", "name", "mention_count", F.size("sources").cast("long").alias("n_sources"))


@query(
    "extractor_priors",
    """SELECT source, CASE source WHEN 'src0' THEN 1.0 WHEN 'src1' THEN 0.9 WHEN 'src2' THEN 0.6 ELSE 0.5 END AS prior, count(*) AS n FROM documents GROUP BY source""",
)
def extractor_priors(spark, sf):
    extractor = F.when(F.col("source") == "src0", "parser").when(F.col("source") == "src1", "regex").when(F.col("source") == "src2", "llm").otherwise("other")
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n")).select("source", U.prior(extractor).alias("prior"), "n")


def word_entities(spark: SparkSession, sf: str) -> DataFrame:
    words = table(spark, sf, "documents").select("source", F.explode(F.array_distinct(F.split("text", " "))).alias("name"))
    return words.groupBy("name").agg(F.array_sort(F.collect_set("source")).alias("sources"))


WORDS_SQL = "WITH w AS (SELECT source, unnest(list_distinct(string_split(text, ' '))) AS name FROM documents), e AS (SELECT name, list_sort(list_distinct(list(source))) AS sources FROM w GROUP BY name)"


@query(
    "remove_by_source",
    f"""{WORDS_SQL} SELECT name, array_to_string(list_filter(sources, lambda s: s <> 'src0'), ',') AS sources FROM e WHERE len(list_filter(sources, lambda s: s <> 'src0')) > 0""",
)
def remove_by_source(spark, sf):
    entities = word_entities(spark, sf)
    left, _ = U.remove_by_source(entities, entities.select("sources"), "src0")
    return left.select("name", F.array_join("sources", ",").alias("sources"))


@query("prune_source", f"{WORDS_SQL} SELECT count(*) AS n_left FROM e WHERE NOT list_contains(sources, 'src1')")
def prune_source(spark, sf):
    entities = word_entities(spark, sf)
    _, edges = U.remove_by_source(entities, entities, "src1")
    return edges.agg(F.count("*").alias("n_left"))


@query(
    "merge_entities",
    """WITH e AS (SELECT 'customer:' || o_custkey AS s, 'status:' || o_orderstatus AS o, o_totalprice AS w FROM orders),
    m AS (SELECT 'customer:' || c_custkey AS d, 'segment:' || c_mktsegment || ':' || c_nationkey AS c FROM customer)
    SELECT m.c AS subject, 'placed' AS predicate, e.o AS object, round(sum(w), 2) AS weight FROM e JOIN m ON e.s = m.d GROUP BY m.c, e.o""",
)
def merge_entities(spark, sf):
    edges = table(spark, sf, "orders").select(key("customer", "o_custkey").alias("subject"), F.lit("placed").alias("predicate"), key("status", "o_orderstatus").alias("object"), F.col("o_totalprice").alias("weight"))
    mapping = table(spark, sf, "customer").select(key("customer", "c_custkey").alias("duplicate"), key("segment", "c_mktsegment", "c_nationkey").alias("canonical"))
    return U.merge_entities(edges, mapping).withColumn("weight", F.round("weight", 2))


CUST_SUPP_SQL = "SELECT 'customer:' || o_custkey AS c, 'supplier:' || l_suppkey AS s, l_quantity AS q FROM orders JOIN lineitem ON o_orderkey = l_orderkey"


@query(
    "undirected_max_weight",
    f"""WITH p AS ({CUST_SUPP_SQL}), e AS (SELECT c AS a, s AS b, max(q) AS w FROM p GROUP BY c, s UNION ALL SELECT s, c, sum(q) FROM p GROUP BY c, s)
    SELECT least(a, b) AS a, greatest(a, b) AS b, max(w) AS weight FROM e GROUP BY least(a, b), greatest(a, b)""",
)
def undirected_max_weight(spark, sf):
    orders, lines = table(spark, sf, "orders").select("o_orderkey", "o_custkey"), table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    pairs = dealt(orders, "o_orderkey", like=lines).join(dealt(lines, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    sums = dealt(pairs, "o_custkey", "l_suppkey").groupBy("o_custkey", "l_suppkey").agg(F.max("l_quantity").alias("m"), F.sum("l_quantity").alias("t"))
    both = sums.select(key("customer", "o_custkey").alias("c"), key("supplier", "l_suppkey").alias("s"), "m", "t")
    # both directions from one aggregation
    edges = both.select(F.explode(F.array(F.struct(F.col("c").alias("src"), F.col("s").alias("dst"), F.col("m").alias("weight")), F.struct(F.col("s").alias("src"), F.col("c").alias("dst"), F.col("t").alias("weight")))).alias("e")).select("e.*")
    return U.undirected_max_weight(edges)


@query(
    "layer_diff",
    """WITH a AS (SELECT 'part:' || l_partkey AS name, max(l_linestatus) AS type FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_partkey),
    b AS (SELECT 'part:' || l_partkey AS name, max(l_linestatus) AS type FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey)
    SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN 'only_in_b' WHEN b.name IS NULL THEN 'only_in_a' ELSE 'in_both' END AS status,
    a.type AS type_a, b.type AS type_b, coalesce(a.type <> b.type, FALSE) AS conflict FROM a FULL JOIN b ON a.name = b.name""",
)
def layer_diff(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_returnflag", "l_linestatus")
    layer = lambda f: lines.where(F.col("l_returnflag") == f).groupBy(key("part", "l_partkey").alias("name")).agg(F.max("l_linestatus").alias("type"))
    return A.layer_diff(layer("A"), layer("R"))


@query(
    "layer_subgraph",
    """WITH u AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup'), v AS (SELECT DISTINCT user_id AS a, (user_id + 1) AS b FROM events)
    SELECT 'user:' || a AS src, 'user:' || b AS dst FROM v WHERE a IN (SELECT user_id FROM u) AND b IN (SELECT user_id FROM u)""",
)
def layer_subgraph(spark, sf):
    events = table(spark, sf, "events")
    nodes = events.where("event_type = 'signup'").select(key("user", "user_id").alias("id")).distinct()
    edges = events.select("user_id").distinct().select(key("user", "user_id").alias("src"), F.concat(F.lit("user:"), (F.col("user_id") + 1).cast("string")).alias("dst"))
    return A.subgraph(nodes, edges)


@query(
    "token_budget_mentions",
    """WITH r AS (SELECT source, doc_id, n_chars, row_number() OVER w AS n, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING) AS used FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id DESC))
    SELECT source, doc_id, n_chars FROM r WHERE used <= 20000 OR n = 1""",
)
def token_budget_mentions(spark, sf):
    return U.within_budget(table(spark, sf, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars", 20_000)


@query("orphan_audit", "SELECT 'customer:' || c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000)")
def orphan_audit(spark, sf):
    links = table(spark, sf, "orders").select(key("customer", "o_custkey").alias("src"), ((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000)).alias("resolved"))
    return A.orphans(table(spark, sf, "customer").select(key("customer", "c_custkey").alias("id")), links)


def part_links(spark: SparkSession, sf: str) -> DataFrame:
    tier = F.when(F.col("l_discount") < 0.03, "low").when(F.col("l_discount") < 0.09, "medium").otherwise("high")
    return table(spark, sf, "lineitem").select(key("part", "l_partkey").alias("dst"), (F.col("l_quantity") > 45).alias("resolved"), tier.alias("tier"))


@query("coverage_gaps", "SELECT 'part:' || p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def coverage_gaps(spark, sf):
    return A.coverage_gaps(table(spark, sf, "part").select(key("part", "p_partkey").alias("id")), part_links(spark, sf))


@query("coverage_gaps_floor", "SELECT 'part:' || p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45 AND l_discount >= 0.09)")
def coverage_gaps_floor(spark, sf):
    return A.coverage_gaps(table(spark, sf, "part").select(key("part", "p_partkey").alias("id")), part_links(spark, sf), "high")


@query(
    "coverage_transitive",
    """SELECT 'order:' || o_orderkey AS id FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    WHERE NOT (n_regionkey = 1 OR c_acctbal > 5000 OR o_orderpriority = '1-URGENT')""",
)
def coverage_transitive(spark, sf):
    nation, customer, orders = table(spark, sf, "nation"), table(spark, sf, "customer"), table(spark, sf, "orders")
    rows = lambda df, a, b: df.select(a.alias("src"), b.alias("dst"), F.lit("INSTANTIATES").alias("type"))
    down = (
        rows(nation, key("region", "n_regionkey"), key("nation", "n_nationkey"))
        .unionByName(rows(customer, key("nation", "c_nationkey"), key("customer", "c_custkey")))
        .unionByName(rows(orders, key("customer", "o_custkey"), key("order", "o_orderkey")))
    )
    covered = (
        spark.createDataFrame([("region:1",)], "id string")
        .unionByName(customer.where("c_acctbal > 5000").select(key("customer", "c_custkey").alias("id")))
        .unionByName(orders.where("o_orderpriority = '1-URGENT'").select(key("order", "o_orderkey").alias("id")))
    )
    return A.coverage_gaps_transitive(orders.select(key("order", "o_orderkey").alias("id")), covered, down)


@query("confidence_tiers", f"{OBS_SQL} SELECT tier, count(*) AS n FROM obs GROUP BY tier")
def confidence_tiers(spark, sf):
    return observations(spark, sf).groupBy(U.tier_rank(F.col("confidence_tier")).alias("tier")).agg(F.count("*").alias("n"))


@query(
    "name_index",
    """WITH e AS (SELECT c_name AS name, 'C' || c_custkey AS alias FROM customer UNION ALL SELECT s_name, 'S' || s_suppkey FROM supplier),
    k AS (SELECT lower(name) AS key, 0 AS rank, name FROM e UNION ALL SELECT lower(alias), 1, name FROM e)
    SELECT key, arg_min(name, (rank, name)) AS name FROM k GROUP BY key""",
)
def name_index(spark, sf):
    customers = table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.array(F.concat(F.lit("C"), F.col("c_custkey").cast("string"))).alias("aliases"))
    suppliers = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.array(F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))).alias("aliases"))
    return U.name_index(customers.unionByName(suppliers))


@query(
    "alias_lookup",
    """SELECT o_orderkey, c_name AS name FROM orders JOIN customer ON lower('C' || o_custkey) = lower('C' || c_custkey)""",
)
def alias_lookup(spark, sf):
    index = U.name_index(table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.array(F.concat(F.lit("C"), F.col("c_custkey").cast("string"))).alias("aliases")))
    asked = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("key"))
    return asked.join(index, "key").select("o_orderkey", "name")


@query(
    "alias_resolution",
    """WITH n AS (SELECT DISTINCT p_name AS name FROM part) SELECT b.name AS canonical, a.name AS duplicate, 1.0 AS similarity, 'alias' AS reason FROM n a JOIN n b
    ON split_part(a.name, ' ', 1) = 'small' AND split_part(b.name, ' ', 1) = 'red' AND split_part(a.name, ' ', 2) = split_part(b.name, ' ', 2)""",
)
def alias_resolution(spark, sf):
    names = table(spark, sf, "part").select(F.col("p_name").alias("name")).distinct()
    second = F.split("name", " ")[1]
    aliases = names.where("name LIKE 'small %'").select(F.col("name").alias("variant"), F.concat(F.lit("red "), second).alias("canonical"))
    return R.alias_candidates(names, aliases)


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


COSINE_SQL = """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
  p AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label AS g, list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS s FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id)"""


@query("cosine_pairs", f"{COSINE_SQL} SELECT a, b, CAST(g AS BIGINT) AS g, round(s, 6) AS similarity FROM p WHERE s >= 0.3")
def cosine_pairs(spark, sf):
    return R.cosine_pairs(vectors(spark, sf), "label", 0.3).select("a", "b", F.col("g").cast("long").alias("g"), F.round("similarity", 6).alias("similarity"))


@query("embedding_merges")
def embedding_merges(spark, sf):
    pairs = R.cosine_pairs(vectors(spark, sf), "label", 0.35).withColumn("mentions_a", F.lit(1)).withColumn("mentions_b", F.lit(1))
    return R.greedy_merge(pairs).withColumn("similarity", F.round("similarity", 6))


@query(
    "components",
    f"""{COSINE_SQL.replace('WITH', 'WITH RECURSIVE', 1)}, s AS MATERIALIZED (SELECT a, b FROM p WHERE s >= 0.3 UNION SELECT b, a FROM p WHERE s >= 0.3),
    r(node, other) AS (SELECT a, a FROM s UNION SELECT r.node, s.b FROM r JOIN s ON s.a = r.other) SELECT node, min(other) AS component FROM r GROUP BY node""",
)
def components(spark, sf):
    # edges with the same components as all pairs have, without listing the pairs
    return R.connected_components(similar.links(vectors(spark, sf), "label", 0.3))


@query(
    "community_edges",
    f"""{COSINE_SQL.replace('WITH', 'WITH RECURSIVE', 1)}, s AS MATERIALIZED (SELECT a, b FROM p WHERE s >= 0.3 UNION SELECT b, a FROM p WHERE s >= 0.3),
    r(node, other) AS (SELECT a, a FROM s UNION SELECT r.node, s.b FROM r JOIN s ON s.a = r.other), m AS (SELECT node, min(other) AS c FROM r GROUP BY node)
    SELECT node, CASE WHEN n >= 3 THEN CAST(c AS VARCHAR) ELSE '-1' END AS community, n FROM m JOIN (SELECT c, count(*) AS n FROM m GROUP BY c) USING (c)""",
)
def community_edges(spark, sf):
    return R.communities(components(spark, sf))


@query("label_communities")
def label_communities(spark, sf):
    # similarities to six places, as whole millionths: votes add up without rounding
    millionths = F.when(~F.isnan("similarity"), F.round(F.round("similarity", 6) * 1_000_000).cast("long")).otherwise(F.lit(0).cast("long"))
    edges = R.cosine_pairs(vectors(spark, sf), "label", 0.3).select(F.col("a").alias("src"), F.col("b").alias("dst"), millionths.alias("weight"))
    return R.label_propagation(edges, 4)


@query(
    "community_diff",
    """WITH o AS (SELECT user_id % 50 AS c, list_sort(list_distinct(list(event_type))) AS m FROM events WHERE day(ts) <= 3 GROUP BY 1),
    n AS (SELECT user_id % 50 AS c, list_sort(list_distinct(list(event_type))) AS m FROM events WHERE day(ts) > 3 AND value > 20 GROUP BY 1)
    SELECT coalesce(o.c, n.c) AS community, CASE WHEN o.c IS NULL THEN 'new' WHEN n.c IS NULL THEN 'removed' WHEN o.m = n.m THEN 'unchanged' ELSE 'changed' END AS status FROM o FULL JOIN n ON o.c = n.c""",
)
def community_diff(spark, sf):
    rows = table(spark, sf, "events").select((F.col("user_id") % 50).alias("community"), F.col("event_type").alias("member"), "ts", "value")
    return A.community_diff(rows.where(F.dayofmonth("ts") <= 3), rows.where((F.dayofmonth("ts") > 3) & (F.col("value") > 20)))


@query("snapshot_hash", "SELECT 'doc:' || doc_id AS uri, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS byte_length FROM documents")
def snapshot_hash(spark, sf):
    return L.origins_of(table(spark, sf, "documents"), key("doc", "doc_id"), F.col("text")).select("uri", "sha256", "byte_length")


@query(
    "incremental_diff",
    """SELECT CASE WHEN doc_id % 5 = 0 THEN 'new' WHEN doc_id % 5 = 1 THEN 'removed' WHEN doc_id % 5 = 2 AND length(text) > 0 THEN 'replaced' ELSE 'unchanged' END AS status, 'doc:' || doc_id AS uri FROM documents""",
)
def incremental_diff(spark, sf):
    docs = table(spark, sf, "documents")
    # the synthetic later state: some documents come, some go, some change
    old = L.origins_of(docs.where("doc_id % 5 <> 0"), key("doc", "doc_id"), F.col("text"))
    changed = F.when(F.col("doc_id") % 5 == 2, F.reverse(F.concat("text", F.lit("~")))).otherwise(F.col("text"))
    new = L.origins_of(docs.where("doc_id % 5 <> 1").withColumn("text", changed), key("doc", "doc_id"), F.col("text"))
    return L.diff(old, new)


@query("orphan_gc", "SELECT 'origin:' || doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphan_gc(spark, sf):
    origins = table(spark, sf, "documents").select(key("origin", "doc_id").alias("id"))
    return L.orphan_origins(origins, table(spark, sf, "labels").select(key("origin", "doc_id").alias("origin_id")))


@query("source_at", "SELECT doc_id, substr(hex(encode(text)), 7, 18) AS piece FROM documents")
def source_at(spark, sf):
    """Bytes 3 to 12 of every text, as hexadecimal: a slice may begin or end within a character."""
    return table(spark, sf, "documents").select("doc_id", F.hex(L.source_at(F.col("text"), F.lit(3), F.lit(12))).alias("piece"))


@query(
    "prf_macro",
    """WITH g AS (SELECT source, list('d' || doc_id) FILTER (WHERE quality = 1) AS gold, list('d' || doc_id) FILTER (WHERE n_chars > 1000) AS pred FROM documents JOIN labels USING (doc_id) GROUP BY source),
    s AS (SELECT coalesce(len(list_intersect(gold, pred)), 0) AS hit, coalesce(len(gold), 0) AS g, coalesce(len(pred), 0) AS p FROM g),
    x AS (SELECT CASE WHEN p > 0 THEN hit / p ELSE 0 END AS precision, CASE WHEN g > 0 THEN hit / g ELSE 0 END AS recall FROM s)
    SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END), 6) AS f1, count(*) AS n FROM x""",
)
def prf_macro(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    sets = rows.groupBy("source").agg(F.collect_list(F.when(F.col("quality") == 1, name)).alias("gold"), F.collect_list(F.when(F.col("n_chars") > 1000, name)).alias("pred"))
    out = A.macro_mean(A.precision_recall(sets, "pred", "gold"))
    return out.select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "n")


@query(
    "event_microbatch",
    """SELECT 'user:' || user_id AS subject, 'did' AS predicate, event_type AS object, round(sum(value), 4) AS weight, count(*) AS n_observations FROM events GROUP BY user_id, event_type""",
)
def event_microbatch(spark, sf):
    """Three micro-batches folded one after another; equal to one batch over everything."""
    triples = table(spark, sf, "events").select(key("user", "user_id").alias("subject"), F.lit("did").alias("predicate"), F.col("event_type").alias("object"), F.col("value").alias("weight"), F.col("event_type").alias("source"), F.dayofmonth("ts").alias("day"))
    store = ingest.EdgeStore(spark)
    for batch, (first, last) in enumerate(((1, 10), (11, 20), (21, 31))):
        store.merge(triples.where(F.col("day").between(first, last)), batch)
    return store.edges.select("subject", "predicate", "object", F.round("weight", 4).alias("weight"), "n_observations")


@query("event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf):
    return ingest.windowed_counts(table(spark, sf, "events")).withColumn("total", F.round("total", 4))
