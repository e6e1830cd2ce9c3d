"""Projections, filters, validation, sorting, deduplication and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as tx, vectors
from textloom.operators import corpus
from textloom.operators.corpus import Rule
from textloom.plans.registry import plan
from textloom.scale import running, settle, top_per_group

# Unicode whitespace as DuckDB's engine spells it.
WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"


@plan(
    "P01_standardise",
    """
    SELECT event_id, props AS text, event_type AS title, ts AS date FROM events
    WHERE props IS NOT NULL AND event_type IS NOT NULL AND value >= 0
    UNION ALL
    SELECT event_id, props, event_type, NULL FROM events
    WHERE props IS NOT NULL AND event_type IS NOT NULL AND value < 0
    """,
)
def standardise(t):
    rows = t.events.select(
        "event_id", "props", "event_type",
        F.when(F.col("value") >= 0, F.col("ts").cast("string")).otherwise(F.lit("no date")).alias("at"),
    )
    return corpus.standardise(rows, "props", "event_type", "at", on_bad_date="null", keep=["event_id"])


@plan("P02_require_columns", "SELECT doc_id, md5(text) AS digest, source FROM documents")
def require_columns(t):
    return corpus.require_columns(t.documents, ["doc_id", "text", "source"]).select(
        "doc_id", F.md5("text").alias("digest"), "source"
    )


@plan(
    "P03_min_tokens",
    r"""
    SELECT doc_id, lang, n_chars FROM documents WHERE len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) >= 64
    """,
)
def min_tokens(t):
    return corpus.min_tokens(t.documents, 64).select("doc_id", "lang", "n_chars")


@plan(
    "P04_ascii_ratio",
    r"""
    SELECT doc_id, length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) / length(text) AS ratio
    FROM documents
    WHERE length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) / length(text) > 0.9
    """,
)
def ascii_ratio(t):
    kept = corpus.ascii_filter(t.documents)
    return kept.select("doc_id", tx.ascii_ratio(F.col("text")).alias("ratio"))


@plan(
    "P05_filter_texts",
    r"""
    WITH kept AS (
      SELECT doc_id, source FROM documents
      WHERE text IS NOT NULL AND source IS NOT NULL AND length(text) > 0
        AND length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) / length(text) > 0.9),
    head AS (
      SELECT doc_id, source FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 200)
      WHERE length(text) > 0 AND length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) / length(text) > 0.9
      ORDER BY doc_id LIMIT 100)
    SELECT 'all' AS kind, doc_id, source FROM kept UNION ALL SELECT 'first', doc_id, source FROM head
    """,
)
def filter_texts(t):
    whole = corpus.filter_texts(t.documents, "text", "source", ["doc_id"])
    head = corpus.filter_texts(t.documents, "text", "source", ["doc_id"], n_docs=100)
    return whole.select(F.lit("all").alias("kind"), "doc_id", "source").unionByName(
        head.select(F.lit("first").alias("kind"), "doc_id", "source")
    )


@plan(
    "P06_min_lines",
    rf"""
    WITH d AS (
      SELECT doc_id, len(string_split(
          regexp_replace(regexp_replace(text, '^{WS}', ''), '{WS}$', ''), chr(10))) AS n
      FROM documents)
    SELECT doc_id, CAST(n AS INTEGER) AS lines FROM d WHERE n >= 4
    """,
)
def min_lines(t):
    return corpus.min_lines(t.documents, 4).select("doc_id", tx.line_count(F.col("text")).alias("lines"))


@plan("P07_non_null", "SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE quality IS NOT NULL")
def non_null(t):
    rows = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return rows.where(F.col("quality").isNotNull()).select("doc_id", "quality")


@plan("P08_substring_exclude", "SELECT p_partkey, p_name FROM part WHERE NOT contains(p_name, 'ring')")
def substring_exclude(t):
    return corpus.exclude_containing(t.part, "p_name", "ring").select("p_partkey", "p_name")


@plan(
    "P09_url_pattern",
    """
    SELECT page_id, url, contains(url, '.example.com/') AS on_host FROM pages
    WHERE NOT contains(url, '?page=') AND NOT contains(url, '?utm_')
    """,
)
def url_pattern(t):
    kept = corpus.keep_pages(t.pages, "url", ["?page=", "?utm_"])
    return kept.select("page_id", "url", F.col("url").contains(".example.com/").alias("on_host"))


@plan(
    "P10_predicates",
    """
    SELECT doc_id, starts_with(text, 'Th') AS prefixed, lang = 'en' AS equal, source IN ('src1', 'src2') AS member
    FROM documents WHERE starts_with(text, 'Th') OR lang = 'en' OR source IN ('src1', 'src2')
    """,
)
def predicates(t):
    pre, same, member = F.col("text").startswith("Th"), F.col("lang") == "en", F.col("source").isin("src1", "src2")
    return t.documents.where(pre | same | member).select(
        "doc_id", pre.alias("prefixed"), same.alias("equal"), member.alias("member")
    )


RULES = [
    Rule("c_custkey", "bigint", at_least=0),
    Rule("c_name", "string"),
    Rule("c_acctbal", "double", at_least=0),
    Rule("c_mktsegment", "int"),
    Rule("quality", "int"),
]


@plan(
    "P11_schema_check",
    """
    WITH c AS (SELECT c.*, l.quality FROM customer c LEFT JOIN labels l ON c_custkey = doc_id)
    SELECT 'c_custkey' AS "column", 'type' AS rule, count(*) FILTER (FALSE) AS n_bad FROM c
    UNION ALL SELECT 'c_custkey', 'not_null', count(*) FILTER (c_custkey IS NULL) FROM c
    UNION ALL SELECT 'c_custkey', 'at_least_0', count(*) FILTER (c_custkey < 0) FROM c
    UNION ALL SELECT 'c_name', 'type', 0 FROM c WHERE c_custkey = 0
    UNION ALL SELECT 'c_name', 'not_null', count(*) FILTER (c_name IS NULL) FROM c
    UNION ALL SELECT 'c_acctbal', 'type', 0 FROM c WHERE c_custkey = 0
    UNION ALL SELECT 'c_acctbal', 'not_null', count(*) FILTER (c_acctbal IS NULL) FROM c
    UNION ALL SELECT 'c_acctbal', 'at_least_0', count(*) FILTER (c_acctbal < 0) FROM c
    UNION ALL SELECT 'c_mktsegment', 'type', count(*) FILTER (TRY_CAST(c_mktsegment AS INTEGER) IS NULL) FROM c
    UNION ALL SELECT 'c_mktsegment', 'not_null', 0 FROM c WHERE c_custkey = 0
    UNION ALL SELECT 'quality', 'type', 0 FROM c WHERE c_custkey = 0
    UNION ALL SELECT 'quality', 'not_null', count(*) FILTER (quality IS NULL) FROM c
    """,
)
def schema_check(t):
    rows = t.customer.join(t.labels, F.col("c_custkey") == F.col("doc_id"), "left")
    return corpus.check_schema(rows, RULES)


@plan(
    "P12_text_merge",
    """
    SELECT c_custkey, 'c_name:' || chr(10) || c_name || chr(10) || chr(10) || 'c_mktsegment:' || chr(10)
        || CASE WHEN c_nationkey = 3 THEN 'nan' ELSE c_mktsegment END AS merged
    FROM customer
    """,
)
def text_merge(t):
    rows = t.customer.withColumn("c_mktsegment", F.when(F.col("c_nationkey") != 3, F.col("c_mktsegment")))
    return rows.select("c_custkey", tx.merge_columns(["c_name", "c_mktsegment"]).alias("merged"))


@plan(
    "P13_clip_and_squash",
    rf"SELECT doc_id, regexp_replace(substring(text, 1, 1024), '{WS}', ' ', 'g') AS content FROM documents",
)
def clip_and_squash(t):
    return t.documents.select("doc_id", tx.clip_and_squash(F.col("text"), 1024).alias("content"))


@plan(
    "P14_assign_ids",
    "SELECT row_number() OVER (ORDER BY source, doc_id) AS id, doc_id, source FROM documents",
)
def assign_ids(t):
    return corpus.assign_ids(t.documents.select("doc_id", "source"), ["source", "doc_id"])


@plan(
    "P15_list_to_text",
    """
    SELECT p_partkey, '[' || p_brand || ', ' || p_type || ', ' || p_name || ']' AS tasks FROM part
    """,
)
def list_to_text(t):
    return t.part.select("p_partkey", tx.list_to_text(F.array("p_brand", "p_type", "p_name")).alias("tasks"))


@plan(
    "P16_text_to_list",
    """
    SELECT p_partkey, p_brand AS first, p_name AS last, 3 AS n FROM part
    """,
)
def text_to_list(t):
    text = F.concat(F.lit("["), F.concat_ws(", ", "p_brand", "p_type", "p_name"), F.lit("]"))
    items = tx.text_to_list(text)
    return t.part.select(
        "p_partkey", F.element_at(items, 1).alias("first"), F.element_at(items, -1).alias("last"),
        F.size(items).alias("n"),
    )


@plan(
    "P17_valid_vectors",
    """
    SELECT vec_id, label FROM embeddings WHERE vec_id % 9 <> 0 AND vec_id % 7 <> 0 AND vec_id % 5 <> 0
    """,
)
def valid_vectors(t):
    vec, n = F.col("embedding"), F.col("vec_id")
    broken = (
        F.when(n % 9 == 0, F.lit(None))
        .when(n % 7 == 0, F.transform(vec, lambda x, i: F.when(i == 3, F.lit(float("nan"))).otherwise(x)))
        .when(n % 5 == 0, F.transform(vec, lambda x, i: F.when(i != 5, x)))
        .otherwise(vec)
    )
    rows = t.embeddings.withColumn("vec", broken)
    return rows.where(vectors.is_valid(F.col("vec"))).select("vec_id", "label")


# -- sorting, limits, duplicates, sets ---------------------------------------------------


@plan(
    "O01_sort",
    """
    SELECT o_orderkey, row_number() OVER (ORDER BY year(o_orderdate) DESC, o_orderkey) AS place FROM orders
    """,
)
def sort_rows(t):
    rows = t.orders.select("o_orderkey", F.year("o_orderdate").alias("year"))
    return running(rows, [], [F.col("year").desc_nulls_last(), F.col("o_orderkey")], position="place").select(
        "o_orderkey", "place"
    )


@plan(
    "O02_mixed_sort",
    """
    SELECT c_mktsegment, c_custkey, row_number() OVER (ORDER BY c_mktsegment, c_acctbal DESC, c_custkey) AS place
    FROM customer
    """,
)
def mixed_sort(t):
    rows = t.customer.select("c_mktsegment", "c_custkey", "c_acctbal")
    return running(
        rows, [], [F.col("c_mktsegment"), F.col("c_acctbal").desc(), F.col("c_custkey")], position="place"
    ).drop("c_acctbal")


@plan(
    "O03_global_topk",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
)
def global_topk(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@plan(
    "O04_tail_mean",
    """
    WITH r AS (SELECT o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS pos,
                      count(*) OVER () AS n FROM orders)
    SELECT count(*) AS rows, round(avg(o_totalprice), 4) AS tail_mean FROM r WHERE pos > n - n // 10
    """,
)
def tail_mean(t):
    placed = running(t.orders.select("o_totalprice", "o_orderkey"), [], ["o_totalprice", "o_orderkey"])
    n = placed.count()
    return placed.where(F.col("pos") > n - n // 10).agg(
        F.count("*").alias("rows"), F.round(F.avg("o_totalprice"), 4).alias("tail_mean")
    )


@plan("O05_page_cap", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 300")
def page_cap(t):
    pages, page_size = 3, 100
    return t.orders.select("o_orderkey").orderBy("o_orderkey").limit(pages * page_size)


@plan(
    "U01_dedup_by_title",
    """
    SELECT title, doc_id, n_chars FROM (
      SELECT string_split(text, chr(10))[1] AS title, doc_id, n_chars,
             row_number() OVER (PARTITION BY string_split(text, chr(10))[1] ORDER BY doc_id) AS rn FROM documents)
    WHERE rn = 1
    """,
)
def dedup_by_title(t):
    rows = t.documents.select(F.substring_index("text", "\n", 1).alias("title"), "doc_id", "n_chars")
    return corpus.dedup_first(rows, ["title"], ["doc_id"])


@plan("U02_distinct", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def distinct(t):
    return t.lineitem.select("l_partkey", "l_suppkey").distinct()


@plan(
    "U03_union_all",
    """
    SELECT kind, count(*) AS n, CAST(sum(k) AS BIGINT) AS keys FROM (
      SELECT 'customer' AS kind, c_custkey AS k FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier)
    GROUP BY kind
    """,
)
def union_all(t):
    a = t.customer.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("k"))
    b = t.supplier.select(F.col("s_suppkey").alias("k"), F.lit("supplier").alias("kind"))
    return a.unionByName(b).groupBy("kind").agg(F.count("*").alias("n"), F.sum("k").alias("keys"))


@plan(
    "U04_set_difference",
    "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'",
)
def set_difference(t):
    placed = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"))
    return t.customer.select(F.col("c_custkey").alias("k")).subtract(placed)


@plan(
    "U05_intersect",
    """
    SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'
    INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'
    """,
)
def intersect(t):
    some = lambda s: t.orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return some("F").intersect(some("O"))


@plan(
    "U06_ordered_union",
    """
    WITH hops AS (
      SELECT 1 AS hop, source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank
      FROM documents
      UNION ALL
      SELECT 2, source, doc_id, row_number() OVER (PARTITION BY source ORDER BY length(text), doc_id)
      FROM documents),
    cut AS (SELECT * FROM hops WHERE rank <= 5),
    firsts AS (SELECT source, doc_id, min(hop * 1000 + rank) AS first FROM cut GROUP BY 1, 2)
    SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY first) AS place FROM firsts
    """,
)
def ordered_union(t):
    from textloom.operators.retrieval import merge_hops

    docs = t.documents.select("source", "doc_id", "n_chars", F.length("text").alias("len"))
    one = top_per_group(docs, ["source"], [F.desc("n_chars"), F.asc("doc_id")], 5)
    two = top_per_group(docs, ["source"], [F.asc("len"), F.asc("doc_id")], 5)
    hops = one.select(F.lit(1).alias("hop"), "source", "doc_id", "rank").unionByName(
        two.select(F.lit(2).alias("hop"), "source", "doc_id", "rank")
    )
    return merge_hops(settle(hops), "source", "doc_id").select("source", "doc_id", "place")
