"""Queries over collections: pages, statistics, checks and changes. documents stand for chunks, source for a knowledge base."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnlake.operators import mutations, paging, predicates, relational, trigrams
from tarnlake.operators.relational import absent_from, exists_in, repeated_keys
from tarnlake.schemas import flatten, with_file_struct
from tarnlake.session import shared_folder, table

WORDS = ["the", "of"]


def chunks(spark, sf_dir):
    """documents with the labels' score and activity, defaults where there is no label."""
    d = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "l_id")
    rows = d.join(labels, F.col("doc_id") == F.col("l_id"), "left")
    score = F.coalesce(F.col("quality").cast("double"), F.lit(0.0))
    return rows.select("doc_id", "text", "source", "n_chars", score.alias("score"), F.coalesce(F.col("toxic") == 0, F.lit(True)).alias("is_active"))


CHUNKS = "c AS (SELECT d.doc_id, d.text, d.source, d.n_chars, coalesce(quality::DOUBLE, 0.0) AS score, coalesce(toxic = 0, true) AS is_active FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"


def list_page(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter(predicates.equals(source="src3")).select("doc_id", "source", "lang", "n_chars")
    return paging.page_of(d, page=2, limit=7, sort_by="n_chars", order="desc", tie="doc_id")


DEEP = [1, 1_111, 10_000, 11_999]


def deep_pages(spark, sf_dir):
    """Pages of all lines by price, the deepest as cheap as the first."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    index = paging.RankIndex.build(lines, shared_folder(spark, "ranks"), "l_extendedprice", "desc", ["l_orderkey", "l_linenumber"], range_rows=4096)
    out = None
    for page in DEEP:
        rows = index.page(page, 5).withColumn("page", F.lit(page))
        out = rows if out is None else out.union(rows)
    return out


def search_page(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter(predicates.matches("text", "licen[sc]e|RESERVED")).select("doc_id", "source", "n_chars")
    return paging.page_of(d, page=1, limit=20, sort_by="n_chars", order="asc", tie="doc_id")


def indexed_search(spark, sf_dir):
    """All texts that match, by the index of trigrams."""
    d = table(spark, sf_dir, "documents")
    posted = trigrams.index(d, shared_folder(spark, "postings"))
    return trigrams.search(d, posted, "licen[sc]e|RESERVED|(example|test)\\.(com|org)").select("doc_id", "source", "n_chars")


def literal_search(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter(predicates.matches("text", "Version 2.0.", literal=True))
    return d.select("doc_id", "source")


def chunk_page_tiebreak(spark, sf_dir):
    rows = chunks(spark, sf_dir).filter(predicates.in_range("score", 0.5, 1.0)).select("doc_id", "score", "is_active")
    return paging.page_of(rows, page=3, limit=10, sort_by="score", order="desc", tie="doc_id")


def job_history_page(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter(predicates.below("o_totalprice", 200000) & predicates.equals(o_orderstatus="O"))
    return paging.page_of(o.select("o_orderkey", "o_totalprice", "o_orderpriority"), page=2, limit=15, sort_by=paging.sort_column(o, "o_totalprice"), order="desc", tie="o_orderkey")


def page_totals(spark, sf_dir):
    return paging.page_counts(table(spark, sf_dir, "documents"), 10, "source")


def score_avg_per_source(spark, sf_dir):
    out = relational.average_or_zero(chunks(spark, sf_dir), "score", "source")
    return out.select("source", F.round("avg_score", 6).alias("avg_score"))


def collection_stats_recount(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("knowledge_id"), F.col("n_chars").alias("file_size_bytes"))
    return relational.collection_stats(d)


def duplicate_hashes(spark, sf_dir):
    return relational.content_hashes(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").filter("copies > 1").select("doc_id", "file_hash", "copies")


def first_seen_distinct(spark, sf_dir):
    return relational.first_seen(table(spark, sf_dir, "documents"), "lang", "doc_id")


def uniqueness_violations(spark, sf_dir):
    return repeated_keys(table(spark, sf_dir, "documents").withColumn("hash", F.md5("text")), ["source", "hash"])


def exists_check(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "user_id")
    return exists_in(c, table(spark, sf_dir, "events"), ["user_id"]).select("user_id", "c_name")


def absent_check(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "user_id")
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'").withColumnRenamed("o_custkey", "user_id")
    return absent_from(c, urgent, ["user_id"]).select("user_id", "c_name")


def toggle_active(spark, sf_dir):
    c = chunks(spark, sf_dir).select(F.col("doc_id").cast("string").alias("_id"), "doc_id", "is_active")
    flagged = table(spark, sf_dir, "labels").filter("quality = 0").select(F.col("doc_id").cast("string").alias("_id"))
    meta = F.struct(F.col("_id").alias("document_chunk_id"), F.col("is_active").alias("is_active"))
    points = c.select("doc_id", F.struct(meta.alias("metadata")).alias("payload"))
    new, synced = mutations.toggle_chunks(c, points, flagged)
    copied = synced.select(F.col("doc_id").alias("p_id"), F.col("payload.metadata.is_active").alias("point_active"))
    return new.join(copied, F.col("doc_id") == F.col("p_id")).select("doc_id", "is_active", "point_active")


def delete_cascade(spark, sf_dir):
    """Customers of one segment deleted with their orders and the orders' lines; what is left, counted."""
    c, o, l = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    gone = c.filter(F.col("c_mktsegment") == "MACHINERY").select(F.col("c_custkey").alias("o_custkey"))
    left_o = absent_from(o, gone, ["o_custkey"])
    left_l = l.withColumnRenamed("l_orderkey", "o_orderkey").join(left_o.select("o_orderkey"), "o_orderkey", "left_semi")
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return relational.bag_union(count(mutations.delete(c, F.col("c_mktsegment") == "MACHINERY"), "customer"), count(left_o, "orders"), count(left_l, "lineitem"))


def settings_flags(spark, sf_dir):
    k = table(spark, sf_dir, "documents").select(F.col("source").alias("_id")).distinct().withColumn("select_training", F.lit(True))
    settings = spark.range(1).select(F.lit(5).alias("top_k"), F.array(F.lit("src1")).alias("list_knowledge_ids"))
    new, flagged = mutations.update_settings(settings, k, ["src2", "src5", "src7"], top_k=8)
    pulled = new.select(F.array_join(relational.pull(F.col("list_knowledge_ids"), "src5"), ",").alias("ids"), "top_k")
    return flagged.join(F.broadcast(pulled)).select("_id", "select_training", "ids", "top_k")  # settings are one row


def default_fill(spark, sf_dir):
    return chunks(spark, sf_dir).select("doc_id", "score", "is_active")


def layout_fallback(spark, sf_dir):
    """Old flat rows as jobs with a file struct, flattened again."""
    flat = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("file_path"), F.length("html").alias("file_size_bytes"))
    return flatten(with_file_struct(flat).select("page_id", "file"), "file")


def membership_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(F.col("source").isin("src1", "src4") & predicates.not_blank(F.col("text"))).groupBy("source", "lang").agg(F.count("*").alias("n"))


def insert_unique(spark, sf_dir):
    """Customers inserted as profiles where neither the table nor the batch has their name's last digits."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.substring("c_name", -3, 3).alias("user_id"))
    return mutations.add_profiles(c.filter("c_custkey < 100"), c.filter("c_custkey >= 100")).select("c_custkey", "user_id")


def training_jobs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("_id"), F.col("source").alias("knowledge_id"), F.col("lang").alias("title"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("document_id"), F.lit("training_document").alias("type"))
    return mutations.add_training_jobs(labels, d).groupBy("knowledge_id").agg(F.count("*").alias("n"), F.count("processing_status.status").alias("pending"))


ENTRIES = {
    "list_page": (list_page, "SELECT doc_id, source, lang, n_chars FROM documents WHERE source = 'src3' ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 7 OFFSET 7"),
    "deep_pages": (deep_pages, f"WITH r AS (SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey, l_linenumber) AS n FROM lineitem) SELECT l_orderkey, l_linenumber, l_extendedprice, (1 + (n - 1) // 5)::INT AS page FROM r WHERE 1 + (n - 1) // 5 IN ({', '.join(map(str, DEEP))})"),
    "search_page": (search_page, "SELECT doc_id, source, n_chars FROM documents WHERE regexp_matches(text, 'licen[sc]e|RESERVED', 'i') ORDER BY n_chars NULLS FIRST, doc_id LIMIT 20"),
    "indexed_search": (indexed_search, "SELECT doc_id, source, n_chars FROM documents WHERE regexp_matches(text, 'licen[sc]e|RESERVED|(example|test)\\.(com|org)', 'i')"),
    "literal_search": (literal_search, "SELECT doc_id, source FROM documents WHERE contains(lower(text), lower('Version 2.0.'))"),
    "chunk_page_tiebreak": (chunk_page_tiebreak, f"WITH {CHUNKS} SELECT doc_id, score, is_active FROM c WHERE score BETWEEN 0.5 AND 1 ORDER BY score DESC, doc_id LIMIT 10 OFFSET 20"),
    "job_history_page": (job_history_page, "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_totalprice < 200000 AND o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 15 OFFSET 15"),
    "page_totals": (page_totals, "SELECT source, count(*) AS total, ceil(count(*) / 10)::BIGINT AS total_pages FROM documents GROUP BY source"),
    "score_avg_per_source": (score_avg_per_source, f"WITH {CHUNKS} SELECT source, round(avg(score), 6) AS avg_score FROM c GROUP BY source"),
    "collection_stats_recount": (collection_stats_recount, "SELECT source AS knowledge_id, count(*) AS document_count, coalesce(sum(n_chars), 0)::BIGINT AS total_size_bytes FROM documents GROUP BY source"),
    "duplicate_hashes": (duplicate_hashes, "SELECT doc_id, md5(text) AS file_hash, count(*) OVER (PARTITION BY md5(text)) AS copies FROM documents QUALIFY copies > 1"),
    "first_seen_distinct": (first_seen_distinct, "SELECT lang, min(doc_id) AS first_position FROM documents GROUP BY lang"),
    "uniqueness_violations": (uniqueness_violations, "SELECT source, md5(text) AS hash, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1"),
    "exists_check": (exists_check, "SELECT c_custkey AS user_id, c_name FROM customer WHERE c_custkey IN (SELECT user_id FROM events)"),
    "absent_check": (absent_check, "SELECT c_custkey AS user_id, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')"),
    "toggle_active": (toggle_active, f"WITH {CHUNKS}, f AS (SELECT doc_id FROM labels WHERE quality = 0), t AS (SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM f) THEN NOT is_active ELSE is_active END AS is_active FROM c) SELECT doc_id, is_active, is_active AS point_active FROM t"),
    "delete_cascade": (delete_cascade, "WITH c AS (SELECT * FROM customer WHERE c_mktsegment <> 'MACHINERY'), g AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY'), o AS (SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM g)) SELECT 'customer' AS name, count(*) AS n FROM c UNION ALL SELECT 'orders', count(*) FROM o UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)"),
    "settings_flags": (settings_flags, "SELECT DISTINCT source AS _id, source IN ('src2', 'src5', 'src7') AS select_training, 'src2,src7' AS ids, 8 AS top_k FROM documents"),
    "default_fill": (default_fill, f"WITH {CHUNKS} SELECT doc_id, score, is_active FROM c"),
    "layout_fallback": (layout_fallback, "SELECT page_id, url AS file_path, length(html)::BIGINT AS file_size_bytes, '' AS file_name, '' AS file_type FROM pages"),
    "membership_filter": (membership_filter, "SELECT source, lang, count(*) AS n FROM documents WHERE source IN ('src1', 'src4') AND length(trim(text)) > 0 GROUP BY ALL"),
    "insert_unique": (insert_unique, "WITH c AS (SELECT c_custkey, right(c_name, 3) AS user_id FROM customer), o AS (SELECT * FROM c WHERE c_custkey < 100), n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS k FROM c WHERE c_custkey >= 100) SELECT * FROM o UNION ALL SELECT c_custkey, user_id FROM n WHERE k = 1 AND user_id NOT IN (SELECT user_id FROM o)"),
    "training_jobs": (training_jobs, "SELECT source AS knowledge_id, count(*) AS n, count(*) AS pending FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY source UNION ALL SELECT NULL, count(*), 0 FROM labels"),
}
