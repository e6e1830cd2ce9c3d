"""Readers and writers: given tables are written to the shared folder and read back."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from textloom.plans.registry import plan
from textloom.scale import fit_broadcast, scratch_path
from textloom.sources import readers, writers

DOCUMENT = "doc_id bigint, text string, lang string, source string"


@plan(
    "S01_load_documents",
    """
    SELECT doc_id, lang, source, CAST(length(text) AS INTEGER) AS chars, md5(text) AS digest, 'csv' AS kind
    FROM documents
    UNION ALL
    SELECT doc_id, lang, source, CAST(length(text) AS INTEGER), md5(text), 'jsonl' FROM documents
    """,
)
def load_documents(t):
    docs = t.documents.select("doc_id", "text", "lang", "source")
    base = scratch_path(t.spark)
    writers.write_csv(docs, f"{base}/docs.csv")
    writers.write_jsonl(docs, f"{base}/docs.jsonl")

    def read(kind):
        found = readers.load_documents(t.spark, f"{base}/docs.{kind}", DOCUMENT)
        return found.select(
            "doc_id", "lang", "source", F.length("text").alias("chars"),
            F.md5("text").alias("digest"), F.lit(kind).alias("kind"),
        )

    return read("csv").unionByName(read("jsonl"))


@plan(
    "S02_load_corpus",
    """
    SELECT 'csv.gz' AS kind, p_partkey, p_name, p_brand, p_size, round(p_retailprice, 2) AS price FROM part
    UNION ALL SELECT 'json.gz', p_partkey, p_name, p_brand, p_size, round(p_retailprice, 2) FROM part
    UNION ALL SELECT 'parquet', p_partkey, p_name, p_brand, p_size, round(p_retailprice, 2) FROM part
    """,
)
def load_corpus(t):
    part = t.part.select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    schema = "p_partkey bigint, p_name string, p_brand string, p_size int, p_retailprice double"
    base = scratch_path(t.spark)
    writers.write_csv(part, f"{base}/part.csv.gz", compression="gzip")
    writers.write_parquet(part, f"{base}/part.parquet")
    # a JSON corpus is one array per file: one small array file per slice of the keys
    rows = part.withColumn("slice", F.floor(F.col("p_partkey") / 1000)).groupBy("slice").agg(
        F.to_json(F.collect_list(F.struct(*part.columns))).alias("value")
    )
    rows.write.partitionBy("slice").option("compression", "gzip").text(f"{base}/part.json.gz")

    def read(kind):
        found = readers.load_corpus(t.spark, f"{base}/part.{kind}", schema, multi_line=False)
        return found.select(
            F.lit(kind).alias("kind"), "p_partkey", "p_name", "p_brand", "p_size",
            F.round("p_retailprice", 2).alias("price"),
        )

    return read("csv.gz").unionByName(read("json.gz")).unionByName(read("parquet"))


@plan("S03_preview", "SELECT doc_id, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT 5")
def preview(t):
    return readers.preview(t.documents.select("doc_id", "lang", "source", "n_chars"), 5, ["doc_id"])


@plan(
    "S04_guess_columns",
    """
    SELECT md5(text) AS text_digest, doc_id AS title, doc_id AS date FROM documents
    """,
)
def guess_columns(t):
    docs = t.documents
    guess = readers.guess_columns(docs.columns)
    return docs.select(
        F.md5(guess["text"]).alias("text_digest"),
        F.col(guess["title"]).alias("title"),
        F.col(guess["date"]).alias("date"),
    )


@plan(
    "S05_load_csv_dir",
    """
    SELECT c_mktsegment AS playlist, CAST(c_custkey AS VARCHAR) AS c_custkey, c_name,
           CASE WHEN c_mktsegment = 'BUILDING' THEN CAST(c_nationkey AS VARCHAR) END AS c_nationkey
    FROM customer
    """,
)
def load_csv_dir(t):
    base = scratch_path(t.spark)
    whole = t.customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    building = F.col("c_mktsegment") == "BUILDING"
    # two headers: one segment carries an extra column
    for rows in (whole.where(building), whole.where(~building).drop("c_nationkey")):
        rows.write.options(**writers.PLAIN).partitionBy("c_mktsegment").mode("append").csv(base)
    return readers.load_csv_folder(t.spark, base, "playlist", r"c_mktsegment=([^/]+)/")


@plan(
    "S06_load_snapshots",
    """
    SELECT o_orderpriority AS username, count(*) AS n, count(DISTINCT o_custkey) AS repos,
           CAST(sum(o_orderkey) AS BIGINT) AS key_sum
    FROM orders GROUP BY 1
    """,
)
def load_snapshots(t):
    base = scratch_path(t.spark)
    stars = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority", F.date_trunc("year", "o_orderdate").alias("at"))
    writers.write_snapshot(stars, base, "o_orderpriority", "at")
    found = readers.load_snapshots(
        t.spark, base,
        "o_orderkey bigint, o_custkey bigint, o_orderpriority string, at string",
        user_pattern=r"username=([^/]+)/", glob="*.csv",
    )
    return found.groupBy("username").agg(
        F.count("*").alias("n"), F.countDistinct("o_custkey").alias("repos"),
        F.sum("o_orderkey").alias("key_sum"),
    )


@plan(
    "S07_load_wiki_dump",
    """
    SELECT doc_id AS page_id, source || ':' || CAST(doc_id AS VARCHAR) AS title, 0 AS namespace,
           CASE WHEN doc_id % 7 = 0 THEN source END AS redirect,
           doc_id * 10 + 2 AS rev_id, TIMESTAMP '2020-01-02 00:00:00' AS moment,
           CASE WHEN doc_id % 2 = 0 THEN lang ELSE '10.0.0.1' END AS contributor, md5(text) AS digest,
           CAST(length(text) AS INTEGER) AS text_length
    FROM (SELECT doc_id, lang, source, regexp_replace(text, '[^\\p{L}\\p{N} .,]', '_', 'g') AS text FROM documents)
    """,
)
def load_wiki_dump(t):
    base = scratch_path(t.spark)
    docs = t.documents.withColumn("text", F.regexp_replace("text", r"[^\p{L}\p{N} .,]", "_"))

    def revision(no, day, text):
        return F.struct(
            (F.col("doc_id") * 10 + no).alias("id"),
            F.lit(f"2020-01-0{day}T00:00:00Z").alias("timestamp"),
            F.struct(
                F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("username"),
                F.when(F.col("doc_id") % 2 != 0, F.lit("10.0.0.1")).alias("ip"),
            ).alias("contributor"),
            F.lit("edit").alias("comment"),
            text.alias("text"),
        )

    pages = docs.select(
        F.concat("source", F.lit(":"), F.col("doc_id").cast("string")).alias("title"),
        F.lit(0).alias("ns"),
        F.col("doc_id").alias("id"),
        F.when(F.col("doc_id") % 7 == 0, F.struct(F.col("source").alias("_title"))).alias("redirect"),
        F.array(revision(1, 1, F.col("source")), revision(2, 2, F.col("text"))).alias("revision"),
    )
    pages.write.format("xml").option("rowTag", "page").option("rootTag", "mediawiki").save(base)
    return readers.load_wiki_dump(t.spark, base).select(
        "page_id", "title", "namespace", "redirect", "rev_id",
        F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("timestamp").cast("timestamp_ntz")).alias("moment"),
        "contributor", F.md5("text").alias("digest"), "text_length",
    )


@plan(
    "S09_load_content_tree",
    """
    SELECT s_name AS title, CAST(s_suppkey AS VARCHAR) || ' [[' || n_name || ']]' AS contents
    FROM supplier JOIN nation ON s_nationkey = n_nationkey
    """,
)
def load_content_tree(t):
    base = scratch_path(t.spark)
    rows = t.supplier.join(fit_broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey"))
    body = F.concat(F.col("s_suppkey").cast("string"), F.lit(" [["), "n_name", F.lit("]]"))
    files = rows.select(
        F.col("s_suppkey").alias("page"),
        F.explode(F.create_map(F.lit("name"), F.col("s_name"), F.lit("content.md"), body)).alias("file", "value"),
    )
    # a file a row: the folders are dealt over the cores, some thousand each
    tasks = max(t.spark.sparkContext.defaultParallelism, math.ceil(t.supplier.count() / 1000))
    files.repartition(tasks, "page").write.partitionBy("page", "file").text(base)
    tree = readers.load_content_tree(t.spark, base)
    return tree.select(F.trim(F.regexp_replace("title", "\n", "")).alias("title"),
                       F.regexp_replace("contents", "\n", "").alias("contents"))


@plan(
    "S10_load_ocr_pages",
    """
    SELECT source AS book, CAST(doc_id AS INTEGER) AS page_num,
           md5(CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END) AS digest
    FROM documents
    """,
)
def load_ocr_pages(t):
    base = scratch_path(t.spark)
    pages = t.documents.select(
        F.col("source").alias("book"),
        F.col("doc_id").alias("page_num"),
        F.struct(F.when(F.col("doc_id") % 5 != 0, F.col("text")).alias("natural_text")).alias("page_response"),
    )
    blank = pages.where("page_num % 50 = 0").withColumn("page_num", F.lit(None).cast("bigint"))
    writers.write_jsonl(pages.unionByName(blank), base)
    return readers.load_ocr_pages(t.spark, base).select("book", "page_num", F.md5("text").alias("digest"))


@plan(
    "S11_load_link_records",
    """
    SELECT kind, s_name AS source_name, n_name AS destination_name, '2020' AS source_date
    FROM supplier JOIN nation ON s_nationkey = n_nationkey, (VALUES ('json'), ('parquet')) AS k(kind)
    """,
)
def load_link_records(t):
    base = scratch_path(t.spark)
    links = t.supplier.join(fit_broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_name").alias("source_name"), F.col("n_name").alias("destination_name"),
        F.lit("2020").alias("source_date"), F.lit("2021").alias("destination_date"),
        "s_acctbal", "n_regionkey",
    )
    writers.write_jsonl(links, f"{base}/links.json")
    writers.write_parquet(links, f"{base}/links.parquet")
    fields = "source_name string, destination_name string, source_date string"
    parts = [
        readers.load_link_records(t.spark, f"{base}/links.{kind}", fields).withColumn("kind", F.lit(kind))
        for kind in ("json", "parquet")
    ]
    return parts[0].unionByName(parts[1])


@plan(
    "S12_load_crawl_records",
    """
    SELECT url, CAST(page_id % 3 AS INTEGER) AS depth, md5(content) AS digest,
           CAST(coalesce(length(content), 0) AS INTEGER) AS content_length,
           CASE WHEN page_id % 4 = 0 THEN 0 ELSE 2 END AS links_count, success, title
    FROM (SELECT *, CASE page_id % 3 WHEN 0 THEN 'md ' || url WHEN 1 THEN 'clean ' || url
                    ELSE nullif(html, '') END AS content,
                 page_id % 10 <> 0 AS success,
                 CASE WHEN page_id % 5 = 0 THEN '' ELSE 'page' END AS title FROM pages)
    """,
)
def load_crawl_records(t):
    base = scratch_path(t.spark)
    n = F.col("page_id")
    pages = t.pages.select(
        "url",
        F.when(n % 3 == 0, F.concat(F.lit("md "), "url")).otherwise(F.lit("")).alias("markdown"),
        F.when(n % 3 == 1, F.concat(F.lit("clean "), "url")).alias("cleaned_html"),
        "html",
        F.when(n % 10 != 0, F.lit(True)).alias("success"),
        F.when(n % 4 != 0, F.array(F.col("url"), F.lit("/x"))).alias("links"),
        F.struct(
            F.when(n % 3 != 0, n % 3).alias("depth"), F.when(n % 5 != 0, F.lit("page")).alias("title")
        ).alias("metadata"),
    )
    writers.write_jsonl(pages, base)
    return readers.load_crawl_records(t.spark, base).select(
        "url", "depth", F.md5("content").alias("digest"), "content_length", "links_count", "success", "title"
    )


@plan(
    "S13_load_runs",
    """
    SELECT o_orderstatus AS env_id, o_orderpriority AS algo_name, CAST(o_custkey % 5 AS INTEGER) AS seed,
           count(*) AS n, round(sum(o_totalprice), 2) AS total
    FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 11 <> 0
    GROUP BY 1, 2, 3
    """,
)
def load_runs(t):
    price = F.col("o_totalprice")
    runs = t.orders.select(
        F.when(F.col("o_orderstatus") == "P", F.lit("Default")).otherwise(F.col("o_orderstatus")).alias("experiment"),
        F.create_map(
            F.lit("algo_name"), F.col("o_orderpriority"),
            F.lit("seed"), (F.col("o_custkey") % 5).cast("string"),
        ).alias("params"),
        F.create_map(F.lit("experiment_group"), F.lit("orders")).alias("tags"),
        F.when(F.col("o_orderkey") % 11 != 0, F.create_map(F.lit("eval/mean_reward"), price)).alias("metrics"),
    )
    return (
        readers.tidy_runs(runs)
        .groupBy("env_id", "algo_name", "seed")
        .agg(F.count("*").alias("n"), F.round(F.sum("mean_reward"), 2).alias("total"))
    )


@plan(
    "S14_write_tsv",
    """
    SELECT doc_id AS id, md5(regexp_replace(text, '[\\t\\n\\r]', ' ', 'g')) AS digest, source AS title FROM documents
    """,
)
def write_tsv(t):
    base = scratch_path(t.spark)
    docs = t.documents.select(
        F.col("doc_id").alias("id"), F.regexp_replace("text", r"[\t\n\r]", " ").alias("content"),
        F.col("source").alias("title"),
    )
    writers.write_tsv(docs, base)
    back = t.spark.read.options(header="true", sep="\t", escape="\\").schema(docs.schema).csv(base)
    return back.select("id", F.md5("content").alias("digest"), "title")


@plan("S15_write_jsonl", "SELECT conv_id, turn, role, md5(text) AS digest FROM conversations")
def write_jsonl(t):
    base = scratch_path(t.spark)
    writers.write_jsonl(t.conversations, base)
    back = t.spark.read.schema(t.conversations.schema).json(base)
    return back.select("conv_id", "turn", "role", F.md5("text").alias("digest"))


@plan(
    "S16_write_csv_parquet",
    """
    SELECT kind, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys, round(sum(l_extendedprice), 2) AS price
    FROM lineitem, (VALUES ('comma'), ('tab'), ('parquet')) AS k(kind) GROUP BY kind
    """,
)
def write_csv_parquet(t):
    base = scratch_path(t.spark)
    rows = t.lineitem.select("l_orderkey", "l_extendedprice", "l_returnflag")
    writers.write_csv(rows, f"{base}/comma")
    writers.write_csv(rows, f"{base}/tab", sep="\t")
    writers.write_parquet(rows, f"{base}/parquet")
    read = {
        "comma": readers.read_csv(t.spark, f"{base}/comma", rows.schema, multi_line=False),
        "tab": readers.read_csv(t.spark, f"{base}/tab", rows.schema, sep="\t", multi_line=False),
        "parquet": t.spark.read.parquet(f"{base}/parquet"),
    }
    whole = None
    for kind, df in read.items():
        part = df.select(F.lit(kind).alias("kind"), "l_orderkey", "l_extendedprice")
        whole = part if whole is None else whole.unionByName(part)
    return whole.groupBy("kind").agg(
        F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"),
        F.round(F.sum("l_extendedprice"), 2).alias("price"),
    )


@plan(
    "S17_snapshot_names",
    """
    SELECT o_orderstatus AS username, strftime(date_trunc('year', o_orderdate), '%Y%m%d_%H%M%S') AS snapshot_ts,
           count(*) AS n
    FROM orders GROUP BY 1, 2
    """,
)
def snapshot_names(t):
    base = scratch_path(t.spark)
    stars = t.orders.select("o_orderkey", "o_orderstatus", F.date_trunc("year", "o_orderdate").alias("at"))
    writers.write_snapshot(stars, base, "o_orderstatus", "at")
    back = t.spark.read.options(header="true").schema(
        "o_orderkey bigint, o_orderstatus string, at string, username string, snapshot_ts string"
    ).csv(base)
    return back.groupBy("username", "snapshot_ts").agg(F.count("*").alias("n"))


@plan(
    "S08_load_notes_dir",
    """
    WITH notes AS (
      SELECT 's' || CAST(s_suppkey AS VARCHAR) AS org_id, s_name, n_name, s_nationkey
      FROM supplier JOIN nation ON s_nationkey = n_nationkey)
    SELECT org_id, org_id AS file_name, '' AS heading, 0 AS level,
           '[n' || CAST(s_nationkey AS VARCHAR) || ']' AS links, '#+title: ' || s_name AS body FROM notes
    UNION ALL
    SELECT org_id, org_id, 'Nation', 1, '[n' || CAST(s_nationkey AS VARCHAR) || ']',
           'in [[id:n' || CAST(s_nationkey AS VARCHAR) || '][' || n_name || ']]' FROM notes
    """,
)
def load_notes_dir(t):
    from textloom.functions.text import list_to_text
    from textloom.operators.notes import note_elements

    base = scratch_path(t.spark)
    rows = t.supplier.join(fit_broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey"))
    note = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    files = rows.select(
        note.alias("note"),
        F.concat(
            F.lit(":PROPERTIES:\n:ID:       "), note, F.lit("\n:END:\n#+title: "), "s_name",
            F.lit("\n* TODO Nation :place:\nin [[id:n"), F.col("s_nationkey").cast("string"),
            F.lit("]["), "n_name", F.lit("]]"),
        ).alias("value"),
    )
    tasks = max(t.spark.sparkContext.defaultParallelism, math.ceil(t.supplier.count() / 1000))
    files.repartition(tasks, "note").write.partitionBy("note").text(base)
    read = readers.load_whole_files(t.spark, base)
    found = note_elements(read, name_pattern=r"note=([^/]+)/")
    return found.select(
        "org_id", "file_name", "heading", "level", list_to_text(F.col("links")).alias("links"), "body"
    )
