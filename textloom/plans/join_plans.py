"""Joins, aggregations and window operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import dates, text as tx, vectors
from textloom.operators import books, corpus, frames, runs
from textloom.operators.similarity import cosine_rows
from textloom.plans.registry import plan
from textloom.scale import (
    best_per_group, concat_parts, fit_broadcast, neighbourhood, running, salted_join, settle, top_per_group,
)


@plan(
    "J01_enrich_by_key",
    """
    SELECT l_orderkey, l_linenumber, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    """,
)
def enrich_by_key(t):
    info = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return salted_join(t.lineitem.select("l_orderkey", "l_linenumber"), info, ["l_orderkey"])


@plan("J02_inner_same_key", "SELECT doc_id, lang, quality, toxic FROM documents JOIN labels USING (doc_id)")
def inner_same_key(t):
    return t.documents.select("doc_id", "lang").join(fit_broadcast(t.labels), "doc_id")


@plan("J03_inner_other_key", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def inner_other_key(t):
    names = fit_broadcast(t.nation.select("n_nationkey", "n_name"))
    return t.customer.join(names, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


@plan(
    "J04_metadata_lookup",
    """
    WITH meta AS (SELECT p_name AS title, min(p_partkey) AS first FROM part GROUP BY 1),
    m AS (SELECT title, p_brand AS brand FROM meta JOIN part ON first = p_partkey)
    SELECT l_orderkey, l_linenumber, brand FROM lineitem
    JOIN m ON title = CASE l_linenumber % 3 WHEN 0 THEN 'small ring' WHEN 1 THEN 'red widget' ELSE 'nothing' END
    """,
)
def metadata_lookup(t):
    meta = corpus.dedup_first(t.part.select(F.col("p_name").alias("title"), "p_partkey", F.col("p_brand").alias("brand")), ["title"], ["p_partkey"])
    title = F.when(F.col("l_linenumber") % 3 == 0, "small ring").when(F.col("l_linenumber") % 3 == 1, "red widget").otherwise("nothing")
    results = t.lineitem.select("l_orderkey", "l_linenumber", title.alias("title"))
    # a third of the rows share one title: the heavy titles are salted
    return salted_join(results, meta.select("title", "brand"), ["title"]).select("l_orderkey", "l_linenumber", "brand")


@plan(
    "J05_link_resolution",
    """
    SELECT 's' || CAST(s_suppkey AS VARCHAR) AS src, 'n' || CAST(n_nationkey AS VARCHAR) AS dst
    FROM supplier JOIN nation ON s_nationkey = n_nationkey
    """,
)
def link_resolution(t):
    files = t.nation.select(
        F.concat(F.lit("id-"), F.col("n_nationkey").cast("string")).alias("link"),
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("dst"),
    )
    wanted = t.supplier.select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("src"),
        F.explode(F.array(F.concat(F.lit("id-"), F.col("s_nationkey").cast("string")), F.lit("id-unknown"))).alias("link"),
    )
    return salted_join(wanted, files, ["link"]).select("src", "dst")


@plan(
    "J06_title_resolution",
    """
    WITH titles AS (SELECT DISTINCT lower(p_name) AS t FROM part),
    links AS (SELECT p_partkey, p_name, unnest([upper(p_name), 'small RING', p_brand]) AS link FROM part)
    SELECT p_partkey, link FROM links JOIN titles ON lower(link) = t WHERE link <> p_name
    """,
)
def title_resolution(t):
    from textloom.operators.graphs import resolve_titles

    wanted = t.part.select(
        "p_partkey", F.col("p_name").alias("title"),
        F.explode(F.array(F.upper("p_name"), F.lit("small RING"), "p_brand")).alias("link"),
    )
    return resolve_titles(wanted, t.part.select(F.col("p_name").alias("title"))).select("p_partkey", "link")


@plan(
    "J07_semi_join",
    "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
)
def semi_join(t):
    some = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return salted_join(t.orders.select("o_orderkey", "o_custkey"), some, ["o_custkey"], "left_semi").select("o_orderkey")


@plan(
    "J08_anti_join_resume",
    """
    SELECT o_orderkey, o_orderstatus AS env_id, o_orderpriority AS algo_name, CAST(o_custkey % 7 AS INTEGER) AS seed
    FROM orders o WHERE NOT EXISTS (
      SELECT 1 FROM orders l WHERE l.o_totalprice > 480000 AND l.o_orderstatus = o.o_orderstatus
        AND l.o_orderpriority = o.o_orderpriority AND l.o_custkey % 7 = o.o_custkey % 7)
    """,
)
def anti_join_resume(t):
    wanted = t.orders.select(
        "o_orderkey", F.col("o_orderstatus").alias("env_id"), F.col("o_orderpriority").alias("algo_name"),
        (F.col("o_custkey") % 7).cast("int").alias("seed"), "o_totalprice",
    )
    return runs.pending(wanted.drop("o_totalprice"), wanted.where("o_totalprice > 480000")).select(
        "o_orderkey", "env_id", "algo_name", "seed"
    )


@plan(
    "J09_run_matrix",
    """
    WITH p AS (SELECT DISTINCT c_mktsegment AS env_id, c_nationkey AS g FROM customer),
    a AS (SELECT DISTINCT c_nationkey AS g, o_orderpriority AS algo_name FROM orders JOIN customer ON o_custkey = c_custkey),
    s AS (SELECT unnest(range(3)) AS seed)
    SELECT 'g' || CAST(g AS VARCHAR) AS experiment_name, env_id, algo_name, CAST(seed AS INTEGER) AS seed,
      CAST(CASE WHEN env_id = 'BUILDING' THEN 500 ELSE 10000 END AS BIGINT) AS total_timesteps,
      'logs/g' || CAST(g AS VARCHAR) || '/' || algo_name || '_' || env_id || '_seed' || CAST(seed AS VARCHAR) AS log_dir,
      CASE WHEN algo_name = '5-LOW' THEN '0.1' ELSE '0.2' END AS lr
    FROM p JOIN a USING (g), s WHERE NOT (env_id = 'MACHINERY' AND algo_name = '1-URGENT')
    """,
)
def run_matrix(t):
    names = t.orders.select(F.col("o_orderpriority").alias("name")).distinct()
    low = F.col("name") == "5-LOW"
    algorithms = names.select(
        "name",
        F.when(low, F.create_map(F.lit("lr"), F.lit("0.1"))).otherwise(
            F.create_map(F.lit("_base"), F.lit("5-LOW"), F.lit("lr"), F.lit("0.2"))
        ).alias("config"),
    )
    resolved = runs.resolve_algorithms(algorithms, names.select("name", F.col("name").alias("algo_class")))
    problems = t.customer.select(
        F.concat(F.lit("g"), F.col("c_nationkey").cast("string")).alias("name"),
        F.struct(
            F.col("c_mktsegment").alias("env_id"),
            F.when(F.col("c_mktsegment") == "BUILDING", F.lit(500)).alias("total_timesteps"),
        ).alias("p"),
    ).distinct()
    groups = problems.groupBy("name").agg(F.collect_set("p").alias("problems"))
    used = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(
        F.concat(F.lit("g"), F.col("c_nationkey").cast("string")).alias("name")
    ).agg(F.collect_set("o_orderpriority").alias("algorithms"))  # names of algorithms: a handful
    groups = groups.join(used, "name")
    bad = t.spark.createDataFrame([("MACHINERY", "1-URGENT")], "env_id string, algo_name string")
    rows = runs.expand_matrix(groups, resolved, bad, 3, 10000, "logs")
    return rows.select(
        "experiment_name", "env_id", "algo_name", "seed", "total_timesteps", "log_dir",
        F.col("algo_kwargs")["lr"].alias("lr"),
    )


BOOK_SQL = """
    WITH toc AS (SELECT source AS book, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS entry
                 FROM documents WHERE lang = 'fr'),
    spans AS (SELECT book, entry, doc_id AS page_ref,
                     lead(doc_id) OVER (PARTITION BY book ORDER BY doc_id) - 1 AS nxt FROM toc),
    last AS (SELECT source AS book, max(doc_id) AS last_page FROM documents GROUP BY 1),
    ends AS (SELECT book, entry, page_ref, coalesce(nxt, last_page) AS end_page FROM spans JOIN last USING (book))
"""


def book_pages(t):
    return t.documents.select(F.col("source").alias("book"), F.col("doc_id").cast("int").alias("page_num"), "text")


def book_spans(t):
    first = t.documents.where("lang = 'fr'").select(
        F.col("source").alias("book"), F.col("doc_id").cast("int").alias("page_ref")
    )
    toc = running(first, ["book"], ["page_ref"], position="entry").select(
        "book", "entry", "page_ref", F.lit("I").alias("roman"), F.lit("CHAPTER").alias("title")
    )
    last = book_pages(t).groupBy("book").agg(F.max("page_num").alias("last_page"))
    return books.chapter_spans(toc, last)


@plan(
    "J10_page_chapter",
    BOOK_SQL
    + """
    SELECT source AS book, CAST(doc_id AS INTEGER) AS page_num, entry, 'I. CHAPTER' AS chapter
    FROM documents JOIN ends ON source = book AND doc_id BETWEEN page_ref AND end_page
    UNION ALL
    SELECT source, CAST(doc_id AS INTEGER), 0, 'Remaining Content' FROM documents
    WHERE doc_id >= 1 AND source NOT IN (SELECT book FROM ends)
    """,
)
def page_chapter(t):
    return books.pages_in_chapters(book_pages(t), settle(book_spans(t))).drop("text")


@plan(
    "W04_chapter_end",
    BOOK_SQL + "SELECT book, entry, CAST(page_ref AS INTEGER) AS page_ref, CAST(end_page AS INTEGER) AS end_page FROM ends",
)
def chapter_end(t):
    return book_spans(t).select("book", "entry", "page_ref", "end_page")


@plan(
    "J11_pairwise_join",
    """
    WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
    SELECT a.vec_id, count(*) AS others, round(max(list_cosine_similarity(a.v, b.v)), 5) AS nearest,
           round(avg(list_cosine_similarity(a.v, b.v)), 5) AS mean
    FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY 1
    """,
)
def pairwise_join(t):
    rows = cosine_rows(t.embeddings, "vec_id", "embedding")
    return rows.select("vec_id", "others", F.round("nearest", 5).alias("nearest"), F.round("mean", 5).alias("mean"))


@plan(
    "J12_concat_by_id",
    "SELECT e.vec_id, label, embedding[1] AS first, lang FROM embeddings e JOIN documents ON vec_id = doc_id",
)
def concat_by_id(t):
    docs = t.documents.select(F.col("doc_id").alias("vec_id"), "lang")
    return t.embeddings.join(docs, "vec_id").select("vec_id", "label", F.col("embedding")[0].alias("first"), "lang")


@plan(
    "J13_aligned_assign",
    """
    SELECT source, n AS doc_count, good FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)
    JOIN (SELECT source, CAST(sum(quality) AS BIGINT) AS good FROM documents JOIN labels USING (doc_id) GROUP BY 1) USING (source)
    """,
)
def aligned_assign(t):
    counts = t.documents.groupBy("source").agg(F.count("*").alias("doc_count"))
    good = t.documents.select("doc_id", "source").join(fit_broadcast(t.labels), "doc_id")
    return counts.join(good.groupBy("source").agg(F.sum("quality").alias("good")), "source")


# -- aggregations ------------------------------------------------------------------------


@plan(
    "A01_value_counts",
    "SELECT l_suppkey, count(*) AS count FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50",
)
def value_counts(t):
    return frames.value_counts(t.lineitem, ["l_suppkey"], 50)


@plan(
    "A02_explode_count",
    """
    WITH firsts AS (SELECT p_name, min(p_partkey) AS k FROM part GROUP BY 1),
    lists AS (SELECT unnest([p_brand, p_type, 'all']) AS item FROM firsts JOIN part ON k = p_partkey)
    SELECT item, count(*) AS doc_count FROM lists GROUP BY 1 HAVING count(*) >= 5
    """,
)
def explode_count(t):
    rows = t.part.select("p_name", "p_partkey", F.array("p_brand", "p_type", F.lit("all")).alias("tasks"))
    return frames.exploded_counts(rows, "p_name", "tasks", [F.col("p_partkey")], 5)


def run_records(t):
    return t.orders.select(
        F.col("o_orderstatus").alias("env_id"), F.col("o_orderpriority").alias("algo_name"),
        F.col("o_totalprice").alias("mean_reward"), F.col("o_custkey"),
    )


@plan(
    "A03_seed_summary",
    """
    SELECT o_orderstatus AS env_id, o_orderpriority AS algo_name, round(avg(o_totalprice), 4) AS reward_mean,
           round(stddev_samp(o_totalprice), 4) AS reward_std, count(*) AS n_seeds
    FROM orders GROUP BY 1, 2
    """,
)
def seed_summary(t):
    rows = runs.seed_summary(run_records(t))
    return rows.select(
        "env_id", "algo_name", F.round("reward_mean", 4).alias("reward_mean"),
        F.round("reward_std", 4).alias("reward_std"), "n_seeds",
    )


@plan(
    "A04_algo_chart",
    """
    SELECT o_orderstatus AS env_id, o_orderpriority AS algo_name, round(avg(o_totalprice), 4) AS mean,
           round(stddev_samp(o_totalprice), 4) AS std,
           row_number() OVER (PARTITION BY o_orderstatus ORDER BY avg(o_totalprice)) AS bar
    FROM orders GROUP BY 1, 2
    """,
)
def algo_chart(t):
    rows = run_records(t).groupBy("env_id", "algo_name").agg(
        F.avg("mean_reward").alias("mean"), F.stddev_samp("mean_reward").alias("std")
    )
    placed = running(rows, ["env_id"], ["mean"], position="bar")
    return placed.select("env_id", "algo_name", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "bar")


@plan(
    "A05_population_summary",
    """
    SELECT o_custkey % 10 AS step, round(avg(o_totalprice), 4) AS mean_reward, round(stddev_pop(o_totalprice), 4) AS std_reward
    FROM orders GROUP BY 1
    """,
)
def population_summary(t):
    rows = run_records(t).withColumn("step", F.col("o_custkey") % 10)
    out = runs.evaluation_summary(rows, ["step"], "mean_reward")
    return out.select("step", F.round("mean_reward", 4).alias("mean_reward"), F.round("std_reward", 4).alias("std_reward"))


@plan(
    "A06_column_means",
    "SELECT round(avg(l_quantity), 6) AS l_quantity, round(avg(l_discount), 6) AS l_discount, round(avg(l_tax), 6) AS l_tax FROM lineitem",
)
def column_means(t):
    names = ["l_quantity", "l_discount", "l_tax"]
    means = frames.group_means(t.lineitem, [], names)
    return means.select(*[F.round(n, 6).alias(n) for n in names])


@plan(
    "A07_mean_per_hits",
    """
    SELECT CAST(h AS BIGINT) AS hits, round(avg(l_quantity), 6) AS mean
    FROM range(11) r(h) LEFT JOIN lineitem ON l_linenumber = h GROUP BY 1
    """,
)
def mean_per_hits(t):
    rows = t.lineitem.select(F.col("l_linenumber").alias("hits"), "l_quantity")
    out = frames.conditional_mean(rows, "hits", "l_quantity", 10)
    return out.select("hits", F.round("mean", 6).alias("mean"))


@plan(
    "A08_describe",
    """
    SELECT 'count' AS statistic, CAST(count(o_totalprice) AS DOUBLE) AS value FROM orders
    UNION ALL SELECT 'mean', round(avg(o_totalprice), 4) FROM orders
    UNION ALL SELECT 'std', round(stddev_samp(o_totalprice), 4) FROM orders
    UNION ALL SELECT 'min', min(o_totalprice) FROM orders
    UNION ALL SELECT 'max', max(o_totalprice) FROM orders
    UNION ALL SELECT 'q0.25', round(quantile_cont(o_totalprice, 0.25), 4) FROM orders
    UNION ALL SELECT 'q0.50', round(quantile_cont(o_totalprice, 0.5), 4) FROM orders
    UNION ALL SELECT 'q0.75', round(quantile_cont(o_totalprice, 0.75), 4) FROM orders
    UNION ALL SELECT 'q0.95', round(quantile_cont(o_totalprice, 0.95), 4) FROM orders
    """,
)
def describe(t):
    out = frames.describe(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", (0.25, 0.5, 0.75, 0.95))
    return out.select("statistic", F.round("value", 4).alias("value"))


@plan(
    "A09_concat_text",
    """
    SELECT conv_id, 0 AS part, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS digest, count(*) AS turns
    FROM conversations GROUP BY 1
    """,
)
def concat_text(t):
    turns = t.conversations.select("conv_id", "turn", F.concat("role", F.lit(": "), "text").alias("text"))
    whole = concat_parts(turns, ["conv_id"], ["turn"], "text", "\n", part_bytes=64 << 20)
    counts = turns.groupBy("conv_id").agg(F.count("*").alias("turns"))
    return whole.join(counts, "conv_id").select("conv_id", "part", F.md5("text").alias("digest"), "turns")


@plan(
    "A10_flatten_lists",
    """
    SELECT conv_id, turn, i AS no, word, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) AS pos
    FROM (SELECT conv_id, turn, unnest(w) AS word, unnest(range(len(w))) AS i FROM
      (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations))
    """,
)
def flatten_lists(t):
    words = t.conversations.select("conv_id", "turn", F.posexplode(F.split("text", " ", -1)).alias("no", "word"))
    return running(words, ["conv_id"], ["turn", "no"]).withColumn("no", F.col("no").cast("long"))


@plan(
    "A11_mean_by_category",
    "SELECT source, round(avg(n_chars), 6) AS n_chars FROM documents GROUP BY 1 ORDER BY avg(n_chars) DESC, 1 LIMIT 10",
)
def mean_by_category(t):
    out = frames.group_means(t.documents, ["source"], ["n_chars"]).orderBy(F.desc("n_chars"), "source").limit(10)
    return out.select("source", F.round("n_chars", 6).alias("n_chars"))


@plan(
    "A12_daily_means",
    """
    SELECT CAST(ts AS DATE) AS day, round(avg(value), 6) AS value, round(avg(CAST(json_extract(props, '$.k') AS DOUBLE)), 6) AS k
    FROM events WHERE value > 5 GROUP BY 1
    """,
)
def daily_means(t):
    rows = t.events.where("value > 5").select(
        F.to_date("ts").alias("day"), "value", F.get_json_object("props", "$.k").cast("double").alias("k")
    )
    out = frames.group_means(rows, ["day"], ["value", "k"])
    return out.select("day", F.round("value", 6).alias("value"), F.round("k", 6).alias("k"))


@plan("A13_distinct_count", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def distinct_count(t):
    return t.events.groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))


@plan(
    "A14_sum_scores",
    """
    SELECT l_partkey, round(sum(l_discount), 6) AS score FROM lineitem GROUP BY 1 ORDER BY round(sum(l_discount), 6) DESC, 1 LIMIT 20
    """,
)
def sum_scores(t):
    total = frames.sum_scores(t.lineitem, ["l_partkey"], "l_discount")
    rounded = total.select("l_partkey", F.round("l_discount", 6).alias("score"))
    return rounded.orderBy(F.desc("score"), "l_partkey").limit(20)


@plan(
    "A15_docs_per_group",
    "SELECT count(*) AS groups, round(avg(n), 6) AS mean FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1)",
)
def docs_per_group(t):
    counts = frames.value_counts(t.lineitem, ["l_suppkey"])
    return counts.agg(F.count("*").alias("groups"), F.round(F.avg("count"), 6).alias("mean"))


@plan(
    "A16_set_overlap",
    """
    WITH l AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'),
    r AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P'),
    b AS (SELECT count(*) AS n FROM l JOIN r USING (k))
    SELECT n AS common, round(n / (SELECT count(*) FROM l), 6) AS share_left, round(n / (SELECT count(*) FROM r), 6) AS share_right
    FROM b
    """,
)
def set_overlap(t):
    some = lambda s: t.orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    out = frames.overlap(some("F"), some("P"), "k")
    return out.select("common", F.round("share_left", 6).alias("share_left"), F.round("share_right", 6).alias("share_right"))


@plan(
    "A17_mean_nonzero_norm",
    """
    WITH n AS (SELECT CASE WHEN vec_id % 4 = 0 THEN 0.0 ELSE sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) END AS norm
               FROM embeddings)
    SELECT round(avg(norm), 6) AS mean_norm FROM n WHERE norm > 1e-6
    """,
)
def mean_nonzero_norm(t):
    zeroed = F.transform("embedding", lambda x: F.when(F.col("vec_id") % 4 == 0, F.lit(0.0)).otherwise(x))
    out = frames.nonzero_norm_mean(t.embeddings, vectors.norm(zeroed))
    return out.select(F.round("mean_norm", 6).alias("mean_norm"))


# -- windows -----------------------------------------------------------------------------


@plan(
    "W01_best_per_group",
    """
    SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM (
      SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rn FROM lineitem)
    WHERE rn = 1 ORDER BY l_extendedprice DESC, l_suppkey LIMIT 10
    """,
)
def best_rows(t):
    rows = t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    best = best_per_group(rows, ["l_suppkey"], [-F.col("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")])
    return best.orderBy(F.desc("l_extendedprice"), "l_suppkey").limit(10)


@plan(
    "W02_nearest_to_centroid",
    """
    WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, unnest(range(1, 65)) AS i FROM embeddings),
    c AS (SELECT label, i, avg(v) AS m FROM x GROUP BY 1, 2),
    d AS (SELECT label, vec_id, round(sqrt(sum((v - m) * (v - m))), 9) AS dist FROM x JOIN c USING (label, i) GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY dist, vec_id) AS rank FROM d)
    SELECT label, vec_id, round(dist, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3
    """,
)
def nearest_to_centroid(t):
    rows = frames.nearest_to_centroid(t.embeddings, "label", "embedding", "vec_id", 3)
    return rows.select("label", "vec_id", F.round("distance", 6).alias("distance"), "rank")


@plan(
    "W03_sentence_window",
    r"""
    WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(
        regexp_replace(text, '([.!?])[ \t\n\x0b\f\r]+', '\1' || chr(1), 'g'), '\x01|\n+'), lambda s: trim(s)), lambda s: length(s) > 0) AS s
      FROM documents),
    e AS (SELECT doc_id, unnest(range(len(s))) AS no, s FROM p)
    SELECT doc_id, CAST(no AS INTEGER) AS no, md5(s[no + 1]) AS sentence,
           md5(array_to_string(s[greatest(no - 3, 0) + 1 : no + 4], ' ')) AS around
    FROM e
    """,
)
def sentence_window(t):
    found = t.documents.select("doc_id", tx.sentences(F.col("text")).alias("found"))
    rows = found.select("doc_id", F.inline(tx.sentence_windows(F.col("found"), 3)))
    return rows.select("doc_id", "no", F.md5("sentence").alias("sentence"), F.md5("window").alias("around"))


@plan(
    "W06_cue_numbers",
    """
    WITH c AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS cue,
           strftime(ts, '%H:%M:%S,%g') || ' --> ' || strftime(ts + INTERVAL 1 SECOND, '%H:%M:%S,%g') AS span
    FROM events)
    SELECT user_id, cue, span, CAST(cue AS VARCHAR) || chr(10) || span || chr(10) || event_type || chr(10) AS block FROM c
    """,
)
def cue_numbers(t):
    start = F.pmod(dates.millis_of(F.col("ts")), F.lit(86_400_000)) / 1000 + F.lit(0.0001)
    rows = t.events.select(
        "user_id", "event_id", "ts", start.alias("start"), (start + 1).alias("end"), F.col("event_type").alias("text")
    )
    return books.cues(rows, "user_id", "start", "end", "text", ["ts", "event_id"]).select(
        "user_id", "cue", "span", "block"
    )


@plan(
    "W07_latest_row",
    """
    SELECT user_id, event_id, event_type FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1
    """,
)
def latest_row(t):
    rows = t.events.select("user_id", "event_id", "event_type", "ts")
    return frames.latest(rows, ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type")


@plan(
    "W08_ranks",
    "SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS rank FROM lineitem",
)
def ranks(t):
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity",
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tie"),
    )
    return frames.ranks(rows, ["l_returnflag"], "l_quantity", "tie").select("l_orderkey", "l_linenumber", "rank")


@plan(
    "W09_moving_average",
    """
    SELECT event_type, event_id, CASE WHEN row_number() OVER w >= 250 THEN
             round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 249 PRECEDING AND CURRENT ROW), 6) END AS sma
    FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)
    """,
)
def moving_average(t):
    rows = t.events.select("event_type", "event_id", "ts", "value")
    out = frames.moving_average(rows, ["event_type"], ["ts", "event_id"], "value", 250)
    return out.select("event_type", "event_id", F.round("sma", 6).alias("sma"))
