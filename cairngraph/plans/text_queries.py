"""Text rules, term index, query expansion, references."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairngraph.functions import text as X
from cairngraph.operators import retrieval as Q
from cairngraph.operators import traversal as T
from cairngraph.plans.registry import query
from cairngraph.sources.lineage import cut, dealt
from cairngraph.sources.tables import EDGES_SQL, driver_edges, key, table

#: DuckDB's word boundaries know ASCII only.  A letter of another kind becomes an underscore there, which is a word
#: character too and in no pattern, so that boundaries fall where Java has them.
LETTERS = "[\\x{AA}\\x{B5}\\x{BA}\\x{C0}-\\x{D6}\\x{D8}-\\x{F6}\\x{F8}-\\x{24F}]"
DOCS_SQL = f"docs AS (SELECT doc_id, source, regexp_replace(text, '{LETTERS}', '_', 'g') AS text FROM documents)"
STOP = ("THE", "AND", "OR", "FOR", "IS", "TO", "OF", "BY", "AT", "ON", "AS", "IF", "IN", "IT", "BE", "WITH", "FROM", "THAT", "THIS", "WAS", "ARE", "The", "This", "That", "And", "For")


def all_docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "source", "text")


def stopwords(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in STOP], "word string")


@query(
    "prose_entities_acronym",
    f"""WITH {DOCS_SQL}, m AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(regexp_replace(text, '(?m)^#{{1,6}}\\s+.*$', '', 'g'), '\\b[A-Z][A-Z0-9]{{1,9}}\\b')) AS name FROM docs)
    SELECT doc_id, name, 'acronym' AS type FROM m WHERE name NOT IN {STOP}""",
)
def prose_entities_acronym(spark, sf):
    found = X.extract_entities(all_docs(spark, sf), stopwords(spark)).where("kind = 'acronym'")
    return found.select("doc_id", "name", "type")


@query(
    "prose_entities_phrase",
    f"""WITH {DOCS_SQL}, m AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(regexp_replace(text, '(?m)^#{{1,6}}\\s+.*$', '', 'g'), '\\b[A-Z][a-z]{{2,}}(?: [A-Z][a-z]{{2,}}){{1,2}}\\b')) AS name FROM docs)
    SELECT doc_id, name FROM m WHERE len(list_intersect(string_split(name, ' '), {list(STOP)})) = 0""",
)
def prose_entities_phrase(spark, sf):
    return X.extract_entities(all_docs(spark, sf), stopwords(spark)).where("kind = 'phrase'").select("doc_id", "name")


@query(
    "entity_type",
    """WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS name FROM documents)
    SELECT CASE WHEN regexp_matches(name, '^[A-Z][a-z]+[A-Z]') THEN 'technology' WHEN regexp_matches(name, '^[A-Z][A-Z0-9]+$') THEN 'acronym' ELSE 'concept' END AS type, count(*) AS n FROM w GROUP BY 1""",
)
def entity_type(spark, sf):
    names = table(spark, sf, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0)))).alias("name")).distinct()
    return names.groupBy(X.entity_type(F.col("name")).alias("type")).agg(F.count("*").alias("n"))


IS_A = X.RELATIONS["is_a"]


@query(
    "prose_is_a",
    f"""WITH {DOCS_SQL}, s AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(text, '(?m)^#{{1,6}}\\s+.*$', '', 'g'), '[.!?\\n]\\s*')) AS s FROM docs),
    m AS (SELECT doc_id, trim(regexp_extract(s, '{IS_A}', 1)) AS subject, regexp_split_to_array(trim(regexp_extract(s, '{IS_A}', 2)), '\\s+') AS o FROM s WHERE length(trim(s)) >= 10 AND regexp_matches(s, '{IS_A}'))
    SELECT DISTINCT doc_id, subject, array_to_string(o[1:4], ' ') AS object FROM m""",
)
def prose_is_a(spark, sf):
    docs = all_docs(spark, sf)
    facts = X.extract_relations(docs, docs.select("doc_id", F.lit("").alias("name")))
    return facts.where("predicate = 'is_a'").select("doc_id", "subject", "object")


@query("acronym_alias")
def acronym_alias(spark, sf):
    """Documents and, as they hold none, two literal rows."""
    literal = spark.createDataFrame([(-1, "Retrieval Augmented Generation (RAG) and CNN (Convolutional neural network)")], "doc_id long, text string")
    return X.acronym_aliases(table(spark, sf, "documents").select("doc_id", "text").unionByName(literal))


NOTES = [
    (1, "# Intro\ntext `alpha` and ``not this``\n```\n# not a heading\n`nor_this`\n```\n## Usage\n# Intro\nuse `beta`"),
    (2, "no headings, `gamma` only"),
]


def with_notes(spark: SparkSession, sf: str, found: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A Markdown rule over the notes and over all documents (apart, as their ids meet).

    The driver tables hold no Markdown, so the SQL lists the notes' rows only; doc_id has its type, a larger one raises.
    """
    notes = found(spark.createDataFrame(NOTES, "doc_id int, text string"))
    docs = found(table(spark, sf, "documents").select("doc_id", "text"))
    return notes.unionByName(docs.withColumn("doc_id", F.col("doc_id").cast("int")))


@query("md_headings", """SELECT * FROM (VALUES (1, 0, 1, 'Intro', 'intro'), (1, 6, 2, 'Usage', 'usage'), (1, 7, 1, 'Intro', 'intro-1')) AS t(doc_id, line, level, title, slug)""")
def md_headings(spark, sf):
    return with_notes(spark, sf, X.markdown_headings)


@query("md_inline_code", """SELECT * FROM (VALUES (1, 1, 'alpha'), (1, 8, 'beta'), (2, 0, 'gamma')) AS t(doc_id, line, code)""")
def md_inline_code(spark, sf):
    return with_notes(spark, sf, X.inline_code)


@query(
    "doc_reference_join",
    """WITH t AS (SELECT DISTINCT doc_id, source, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS ref_text FROM documents),
    n AS (SELECT source, ref_text, min(doc_id) AS first_doc FROM t GROUP BY source, ref_text HAVING count(*) > 1)
    SELECT t.doc_id, 'doc:' || n.first_doc AS id, t.ref_text FROM t JOIN n ON t.source = n.source AND t.ref_text = n.ref_text""",
)
def doc_reference_join(spark, sf):
    docs = all_docs(spark, sf)
    tokens = cut(X.tokens_of(docs, "source"))  # read from the texts once, for the names and for the references
    names = tokens.groupBy("source", F.col("ref_text").alias("name")).agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    named = cut(names.select("source", "name", key("doc", "first").alias("id")))
    return X.token_references(dealt(tokens, "source", "ref_text", like=docs), dealt(named, "source", "name", like=docs), "source")


def parts(spark: SparkSession, sf: str) -> DataFrame:
    """Part names with the number of their line items as mentions."""
    lines = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    named = table(spark, sf, "part").select("p_partkey", "p_name").join(lines, F.col("p_partkey") == F.col("l_partkey"))
    return named.groupBy(F.col("p_name").alias("name")).agg(F.sum("n").alias("mention_count"))


PARTS_SQL = """WITH e AS (SELECT p_name AS name, CAST(count(*) AS BIGINT) AS mentions FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY p_name),
  idx AS (SELECT DISTINCT unnest(string_split(lower(name), ' ')) AS word, name AS term, mentions FROM e WHERE length(name) BETWEEN 2 AND 60), ix AS (SELECT * FROM idx WHERE length(word) >= 3)"""


@query("term_index", f"{PARTS_SQL} SELECT word, term, mentions FROM ix")
def term_index(spark, sf):
    return Q.term_index(parts(spark, sf))


@query("match_terms", f"{PARTS_SQL} SELECT word, term, mentions FROM ix WHERE word IN (SELECT DISTINCT lower(unnest(string_split(p_name, ' '))) FROM part)")
def match_terms(spark, sf):
    words = table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("word"))
    return Q.match_terms(Q.term_index(parts(spark, sf)), words)


QUERIES_SQL = "q AS (SELECT p_partkey AS query_id, CASE WHEN p_size < 10 THEN 'zzz ' || p_brand ELSE 'Find-' || p_name END AS text FROM part)"
NORMAL = "trim(regexp_replace(regexp_replace(lower(text), '[-_]', ' ', 'g'), '\\s+', ' ', 'g'), ' ')"


def asked(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("p_size") < 10, F.concat(F.lit("zzz "), "p_brand")).otherwise(F.concat(F.lit("Find-"), F.col("p_name")))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("query_id"), text.alias("text"))


@query(
    "match_kg_query",
    f"""{PARTS_SQL}, {QUERIES_SQL}, w AS (SELECT DISTINCT query_id, unnest(string_split({NORMAL}, ' ')) AS word FROM q),
    h AS (SELECT DISTINCT query_id, term, mentions FROM w JOIN ix USING (word) WHERE length(word) >= 3),
    r AS (SELECT query_id, term, CAST(row_number() OVER (PARTITION BY query_id ORDER BY mentions DESC, term) AS INTEGER) AS rank, FALSE AS is_fallback FROM h),
    top AS (SELECT term, CAST(row_number() OVER (ORDER BY mentions DESC, term) AS INTEGER) AS rank FROM (SELECT DISTINCT term, mentions FROM ix) ORDER BY mentions DESC, term LIMIT 3)
    SELECT * FROM r WHERE rank <= 5 UNION ALL SELECT query_id, term, rank, TRUE FROM q, top WHERE query_id NOT IN (SELECT query_id FROM h)""",
)
def match_kg_query(spark, sf):
    return Q.match_query(Q.term_index(parts(spark, sf)), asked(spark, sf), 5, 3)


@query("query_normalise", f"SELECT doc_id, {NORMAL} AS text FROM documents")
def query_normalise(spark, sf):
    return all_docs(spark, sf).select("doc_id", Q.normalise(F.col("text")).alias("text"))


def first_words(spark: SparkSession, sf: str) -> DataFrame:
    """Names to look for: the lower-case words of the benchmark texts, of one letter and more."""
    return table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("name")).distinct()


NAMES_SQL = "n AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]+')) AS name FROM benchmark)"


@query("entity_match_substring", f"WITH {NAMES_SQL} SELECT item_id AS query_id, name FROM benchmark b JOIN n ON contains(lower(b.text), lower(n.name))")
def entity_match_substring(spark, sf):
    return Q.match_substring(table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text"), first_words(spark, sf))


@query(
    "entity_match_token",
    f"""WITH {NAMES_SQL}, d AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(regexp_replace(text, '[^\\w\\s-]', ' ', 'g')), '[-_]', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM documents),
    w AS (SELECT DISTINCT doc_id, unnest(string_split(t, ' ')) AS name FROM d) SELECT doc_id AS query_id, name FROM w JOIN n USING (name)""",
)
def entity_match_token(spark, sf):
    docs = all_docs(spark, sf).select(F.col("doc_id").alias("query_id"), "text")
    return Q.match_tokens(docs, first_words(spark, sf), 1)


@query(
    "expand_terms",
    f"""WITH {EDGES_SQL}, seed AS (SELECT s_suppkey AS query_id, 'supplier:' || s_suppkey AS id FROM supplier),
    c AS (SELECT DISTINCT query_id, dst AS term FROM seed JOIN edges ON id = src UNION SELECT query_id, src FROM seed JOIN edges ON id = dst),
    r AS (SELECT query_id, term, CAST(row_number() OVER (PARTITION BY query_id ORDER BY term) AS INTEGER) AS rank FROM c) SELECT * FROM r WHERE rank <= 10""",
)
def expand_terms(spark, sf):
    seeds = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("query_id"), key("supplier", "s_suppkey").alias("id"))
    return Q.expand(seeds, driver_edges(spark, sf), 10)


@query(
    "context_lines",
    f"""WITH {EDGES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY type, dst) AS n FROM edges)
    SELECT src, string_agg(src || ' --[' || type || ']--> ' || dst, '; ' ORDER BY n) AS context FROM r WHERE n <= 5 GROUP BY src""",
)
def context_lines(spark, sf):
    return Q.context_lines(driver_edges(spark, sf), 5)


@query(
    "path_narrative",
    f"""WITH {EDGES_SQL} SELECT a.src || ' --[PARENT_OF]--> ' || a.dst || ' --[CONTAINS]--> ' || b.dst AS narrative FROM edges a JOIN edges b ON a.dst = b.src WHERE a.type = 'PARENT_OF' AND b.type = 'CONTAINS'""",
)
def path_narrative(spark, sf):
    edges = T.of_types(driver_edges(spark, sf), ["PARENT_OF", "CONTAINS"])
    found = T.paths(table(spark, sf, "region").select(key("region", "r_regionkey").alias("id")), edges, 2).where("hop = 2")
    return Q.path_narrative(found).select("narrative")


@query(
    "context_budget",
    """WITH r AS (SELECT 'customer:' || o_custkey AS query_id, o_orderkey AS priority, 'order ' || o_orderkey || ' ' || o_orderstatus AS line FROM orders),
    u AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY query_id ORDER BY priority, line ROWS UNBOUNDED PRECEDING) AS used FROM r)
    SELECT query_id, string_agg(line, chr(10) ORDER BY priority, line) AS context FROM u WHERE used <= 100 GROUP BY query_id""",
)
def context_budget(spark, sf):
    line = F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" "), F.col("o_orderstatus"))
    rows = table(spark, sf, "orders").select(key("customer", "o_custkey").alias("query_id"), F.col("o_orderkey").alias("priority"), line.alias("line"))
    return Q.budgeted_context(rows, 100)


@query("page_host_links", "SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, CAST(len(regexp_extract_all(html, '<a href=\"')) AS BIGINT) AS n_links FROM pages")
def page_host_links(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"), F.regexp_count("html", F.lit('<a href="')).cast("long").alias("n_links"))
