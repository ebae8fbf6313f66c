"""Query expansion: matching names in queries, expanding over the graph, formatting context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairngraph.sources.lineage import cut, dealt


def normalise(query: Column) -> Column:
    """Lower case, trimmed, hyphens and underscores as spaces, runs of white space as one."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(query), "[-_]", " "), r"\s+", " "))


def term_index(entities: DataFrame, min_mentions: int = 1) -> DataFrame:
    """(word, term, mentions): words of 3 or more characters of terms of 2 to 60."""
    rows = entities.where((F.length("name").between(2, 60)) & (F.col("mention_count") >= min_mentions))
    words = rows.select(F.explode(F.array_distinct(F.split(F.lower("name"), " "))).alias("word"), F.col("name").alias("term"), F.col("mention_count").alias("mentions"))
    return words.where(F.length("word") >= 3)


def match_terms(index: DataFrame, words: DataFrame) -> DataFrame:
    """(word, term) of the words asked for."""
    return words.select(F.lower("word").alias("word")).distinct().join(index, "word").select("word", "term", "mentions")


def match_query(index: DataFrame, queries: DataFrame, max_terms: int, fallback: int) -> DataFrame:
    """(query_id, term, rank, is_fallback): the first terms by mentions of a query's words, else the top terms.

    queries: query_id, text.  Ties by name; the limits are part of the operator.  Equal texts are matched once.
    """
    first = lambda terms: F.slice(F.array_sort(F.array_distinct(terms)), 1, max_terms)
    # what is not among the first terms of a word, or of a text, is not among those of a query that holds it
    rank = F.row_number().over(W.partitionBy("word").orderBy(F.col("mentions").desc(), "term"))
    kept = index.distinct().withColumn("n", rank).where(F.col("n") <= max_terms)
    word_terms = kept.groupBy("word").agg(F.collect_list(F.struct((-F.col("mentions")).alias("less"), "term")).alias("terms"))
    texts = dealt(queries.select("text").distinct(), "text", like=queries)
    words = texts.select("text", F.explode(F.array_distinct(F.split(normalise(F.col("text")), " "))).alias("word")).where(F.length("word") >= 3)
    hits = words.join(word_terms, "word").groupBy("text").agg(F.flatten(F.collect_list("terms")).alias("terms"))
    by_text = cut(hits.select("text", first("terms").alias("terms")))
    matched = queries.join(by_text, "text", "left").select("query_id", F.coalesce("terms", F.array().cast(by_text.schema["terms"].dataType)).alias("terms"))
    found = dealt(matched, "query_id", like=queries).groupBy("query_id").agg(F.flatten(F.collect_list("terms")).alias("terms"), F.count("*").alias("n"))
    top = index.select("term", "mentions").distinct().orderBy(F.col("mentions").desc(), "term").limit(fallback)
    # at most ``fallback`` entries, a parameter
    top = top.agg(F.sort_array(F.collect_list(F.struct((-F.col("mentions")).alias("less"), "term"))).alias("top"))
    rows = found.crossJoin(F.broadcast(top)).withColumn("is_fallback", F.size("terms") == 0)
    given = F.when(F.col("is_fallback"), F.col("top")).otherwise(first("terms"))
    # a query that is asked n times falls back n times
    again = rows.withColumn("given", given).withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.when(F.col("is_fallback"), F.col("n")).otherwise(1))))
    return again.select("query_id", "is_fallback", F.posexplode("given").alias("rank", "t")).select("query_id", "t.term", (F.col("rank") + 1).alias("rank"), "is_fallback")


def _run(n: int):
    return lambda i: F.array_join(F.slice("w", i, n), " ")


def match_tokens(queries: DataFrame, names: DataFrame, longest: int = 4) -> DataFrame:
    """(query_id, name): names equal to a run of 1..longest query words, case aside."""
    words = queries.select("query_id", F.split(normalise(F.regexp_replace("text", r"[^\w\s-]", " ")), " ").alias("w"))
    runs = [F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), _run(n))).otherwise(F.array().cast("array<string>")) for n in range(1, longest + 1)]
    spans = F.flatten(F.array(*runs))
    grams = words.select("query_id", F.explode(F.array_distinct(spans)).alias("gram"))
    keyed = names.select("name", normalise(F.col("name")).alias("gram"))
    return grams.join(keyed, "gram").select("query_id", "name").distinct()


def match_substring(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, name) where the lower-cased name, of any length but 0, occurs in the lower-cased text.

    Each name is found through its first characters, three at most: those of the texts meet those of the names in an
    equi-join that carries no text.  Longer names are then checked against the text of their few candidates.
    """
    text = queries.select("query_id", F.lower("text").alias("t"))
    runs = lambda n: F.when(F.length("t") >= n, F.transform(F.sequence(F.lit(1), F.length("t") - n + 1), lambda i: F.substring("t", i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    grams = text.select("query_id", F.explode(F.array_distinct(F.flatten(F.array(*[runs(n) for n in (1, 2, 3)])))).alias("g"))
    keyed = names.where(F.length("name") > 0).select("name", F.lower("name").alias("n")).withColumn("g", F.substring("n", 1, 3))
    found = grams.join(keyed, "g").select("query_id", "name", "n").distinct()
    long = found.where(F.length("n") > 3).join(text, "query_id").where(F.contains("t", F.col("n")))
    return found.where(F.length("n") <= 3).select("query_id", "name").unionByName(long.select("query_id", "name")).distinct()


def expand(seeds: DataFrame, edges: DataFrame, max_terms: int, membership: DataFrame | None = None) -> DataFrame:
    """(query_id, term, rank): neighbours either way of the seeds (query_id, id), then members of their communities.

    Seeds are left out; neighbours come first, then by name; at most ``max_terms`` a query, a parameter.
    """
    # one reading of the edges gives both directions
    either = edges.select(F.inline(F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("term")), F.struct(F.col("dst").alias("id"), F.col("src").alias("term")))))
    rows = seeds.join(either, "id").select("query_id", "term", F.lit(0).alias("tier"))
    if membership is not None:
        own = seeds.join(membership.withColumnRenamed("node", "id"), "id").select("query_id", "community").distinct()
        rows = rows.unionByName(own.join(membership, "community").select("query_id", F.col("node").alias("term"), F.lit(1).alias("tier")))
    # seeds come in as tier -1 and go out with their group, so that one exchange serves leaving out, grouping and order
    own = seeds.where("query_id IS NOT NULL AND id IS NOT NULL").select("query_id", F.col("id").alias("term"), F.lit(-1).alias("tier"))
    grouped = dealt(rows.unionByName(own), "query_id", like=edges).groupBy("query_id", "term").agg(F.min("tier").alias("tier"))
    ranked = grouped.where("tier >= 0")
    order = W.partitionBy("query_id").orderBy("tier", "term")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_terms).select("query_id", "term", "rank")


def context_lines(edges: DataFrame, per_subject: int) -> DataFrame:
    """(src, context): the first edges of each subject as ``s --[p]--> o``, joined by a semicolon; the number is a parameter."""
    order = W.partitionBy("src").orderBy("type", "dst")
    line = F.concat("src", F.lit(" --["), "type", F.lit("]--> "), "dst")
    # one exchange serves the distinct rows, their order and the joining
    rows = dealt(edges.select("src", "type", "dst"), "src").distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_subject).withColumn("line", line)
    return rows.groupBy("src").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "; ").alias("context"))


def path_narrative(paths: DataFrame) -> DataFrame:
    """Adds ``narrative``: nodes and types of a path, ``a --[t]--> b --[u]--> c``."""
    tail = F.zip_with("types", F.slice("nodes", 2, F.size("types")), lambda t, n: F.concat(F.lit(" --["), t, F.lit("]--> "), n))
    return paths.withColumn("narrative", F.concat(F.element_at("nodes", 1), F.array_join(tail, "")))


def budgeted_context(rows: DataFrame, budget: int) -> DataFrame:
    """(query_id, context): lines (query_id, priority, line) in order of priority while their characters fit."""
    order = W.partitionBy("query_id").orderBy("priority", "line")
    kept = rows.withColumn("used", F.sum(F.length("line") + 1).over(order.rowsBetween(W.unboundedPreceding, 0))).where(F.col("used") <= budget)
    return kept.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("priority", "line"))), lambda x: x["line"]), "\n").alias("context"))
