"""Retrieval and its evaluation, with the benchmark texts as queries over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import evaluation, frames, retrieval
from textloom.plans.registry import plan
from textloom.scale import fit_broadcast, settle

WORDS = r"'[\p{L}\p{N}]+'"


def bm25_sql(name="", corpus="documents", doc="doc_id", text="text", queries="benchmark", query="item_id", query_text="text"):
    """The formula as common table expressions that end in {name}scores(query, doc, score)."""
    stop = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)

    def terms(column):
        return f"list_filter(regexp_extract_all(lower({column}), {WORDS}), lambda w: w NOT IN ({stop}))"

    return f"""
    {name}tok AS (SELECT {doc} AS doc, {terms(text)} AS toks FROM {corpus}),
    {name}len AS (SELECT doc, len(toks) AS dl FROM {name}tok),
    {name}st AS (SELECT count(*) AS n, avg(dl) AS a FROM {name}len),
    {name}tf AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(toks) AS term FROM {name}tok) GROUP BY 1, 2),
    {name}df AS (SELECT term, count(*) AS df FROM {name}tf GROUP BY 1),
    {name}q AS (SELECT query, term, count(*) AS qtf FROM
        (SELECT {query} AS query, unnest({terms(query_text)}) AS term FROM {queries}) GROUP BY 1, 2),
    {name}scores AS (
      SELECT query, doc, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5))
               * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS score
      FROM {name}q JOIN {name}df USING (term) JOIN {name}tf USING (term) JOIN {name}len USING (doc), {name}st GROUP BY 1, 2)"""


def top_sql(source, k, keys="query", tie="doc", name="rank"):
    return (
        f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, {tie}) AS INTEGER) AS {name} "
        f"FROM {source}) WHERE {name} <= {k}"
    )


COSINE_SQL = """
    e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    dq AS (SELECT item_id AS query, v AS qv FROM benchmark JOIN e ON item_id = vec_id),
    dscores AS (SELECT query, vec_id AS doc, round(list_cosine_similarity(qv, v), 9) AS score FROM dq, e)"""


def text_scores(t):
    return retrieval.bm25_scores(t.documents, t.benchmark, "doc_id", "text", "item_id", "text")


def vector_queries(t):
    """Every benchmark item takes the vector of the same number."""
    items = fit_broadcast(t.benchmark.select(F.col("item_id").alias("vec_id")))
    return t.embeddings.join(items, "vec_id").select(F.col("vec_id").alias("item_id"), "embedding")


def dense_run(t, k):
    return retrieval.dense(t.embeddings, vector_queries(t), "vec_id", "embedding", "item_id", "embedding", k)


@plan("R01_bm25", f"WITH {bm25_sql()} {top_sql('scores', 10)}")
def bm25(t):
    return retrieval.cut(text_scores(t), 10)


@plan("R02_dense", f"WITH {COSINE_SQL}, r AS ({top_sql('dscores', 10)}) SELECT query, doc, round(score, 6) AS score, rank FROM r")
def dense(t):
    return dense_run(t, 10)


LISTS, BITS, NEAR = 32, 512, 8


@plan(
    "R03_dense_approximate",
    f"""
    WITH {COSINE_SQL},
    centres AS (SELECT row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) - 1 AS list, v AS c
                FROM e QUALIFY row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) <= {LISTS}),
    angles AS (SELECT vec_id, list, acos(least(greatest(round(list_cosine_similarity(v, c), 9), -1), 1)) AS angle FROM e, centres),
    placed AS (SELECT vec_id, arg_min(list, {{'a': angle, 'l': list}}) AS list, min(angle) AS away FROM angles GROUP BY 1),
    radii AS (SELECT list, coalesce(max(away), 0) AS radius FROM centres LEFT JOIN placed USING (list) GROUP BY 1),
    planes AS (SELECT b, list(CASE WHEN ('0x' || substr(md5('42:' || b || ':' || i), 1, 1))::BIGINT >= 8 THEN 1.0::DOUBLE ELSE -1.0 END ORDER BY i) AS r
               FROM (SELECT c.range AS b, d.range AS i FROM range({BITS}) c, range(64) d) GROUP BY 1),
    words AS (SELECT vec_id, b // 32 AS w, sum(CASE WHEN round(list_dot_product(v, r), 9) >= 0 THEN 1::BIGINT << (b % 32) ELSE 0 END)::BIGINT AS s
              FROM e, planes GROUP BY 1, 2),
    signs AS (SELECT vec_id, list(s ORDER BY w) AS signs FROM words GROUP BY 1),
    away AS (SELECT q.vec_id AS query, x.vec_id AS doc,
                    list_sum(list_transform(range(1, {BITS // 32 + 1}), lambda i: bit_count(xor(q.signs[i], x.signs[i])))) AS n
             FROM signs q JOIN dq ON dq.query = q.vec_id, signs x),
    close AS (SELECT vec_id AS query, list FROM angles JOIN dq ON dq.query = vec_id
              QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY angle, list) <= {NEAR}),
    likely AS (SELECT a.query, a.doc, a.n FROM away a JOIN placed p ON p.vec_id = a.doc JOIN close c ON c.query = a.query AND c.list = p.list
               QUALIFY row_number() OVER (PARTITION BY a.query ORDER BY a.n, a.doc) <= 20),
    kth AS (SELECT query, CASE WHEN count(*) >= 10 THEN min(score) ELSE -1 END AS floor FROM (
              SELECT query, score FROM likely JOIN dscores USING (query, doc)
              QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) <= 10) GROUP BY 1),
    asked AS (SELECT dq.query, coalesce(floor, -1) AS floor,
                     floor({BITS} * acos(least(greatest(coalesce(floor, -1), -1), 1)) / pi() + 1.2815515655446004 * sqrt({BITS}) / 2) AS most
              FROM dq LEFT JOIN kth USING (query)),
    open AS (SELECT query, a.list FROM asked JOIN angles a ON a.vec_id = query JOIN radii r ON r.list = a.list
             WHERE cos(greatest(angle - radius, 0)) >= floor - 1e-9),
    cand AS (SELECT a.query, a.doc FROM away a JOIN asked USING (query) JOIN placed p ON p.vec_id = a.doc
             JOIN open o ON o.query = a.query AND o.list = p.list WHERE a.n <= most
             UNION SELECT query, doc FROM likely),
    cs AS (SELECT query, doc, score FROM dscores JOIN cand USING (query, doc)),
    near AS ({top_sql('cs', 10)}), exact AS ({top_sql('dscores', 10)}),
    rec AS (SELECT exact.query, avg(CASE WHEN near.doc IS NULL THEN 0.0 ELSE 1.0 END) AS recall
            FROM exact LEFT JOIN near ON near.query = exact.query AND near.doc = exact.doc GROUP BY 1),
    part AS (SELECT query, count(*) / (SELECT count(*) FROM e) AS candidates FROM cand GROUP BY 1)
    SELECT query, doc, round(score, 6) AS score, rank, round(recall, 6) AS recall, round(candidates, 6) AS candidates
    FROM near JOIN rec USING (query) JOIN part USING (query)
    """,
)
def dense_approximate(t):
    """The found rows, with the recall and the share of exactly compared rows of their query."""
    asks = settle(vector_queries(t))
    sides = (t.embeddings, asks, "vec_id", "embedding", "item_id", "embedding")
    found, counted = retrieval.dense_approximate(*sides, 10, LISTS, BITS, NEAR)
    found = settle(found)
    recall = retrieval.recall(found, dense_run(t, 10))
    part = counted.select("query", (F.col("candidates") / F.lit(t.embeddings.count())).alias("candidates"))
    return found.join(recall, "query").join(part, "query").select(
        "query", "doc", "score", "rank", F.round("recall", 6).alias("recall"), F.round("candidates", 6).alias("candidates")
    )


def letters_sql(column):
    shares = ", ".join(f"(length(lower({column})) - length(replace(lower({column}), '{c}', ''))) / greatest(length({column}), 1)" for c in "etaonihsrl")
    return f"[1e-3::DOUBLE, {shares}]"


def chunk_search_sql():
    from textloom.plans.document_plans import BLANK, chunk_sql

    return rf"""
    WITH RECURSIVE {chunk_sql(1024, 0)},
    trimmed AS (SELECT doc_id, regexp_replace(regexp_replace(substr(text, s + 1, e - s), '^{BLANK}+', ''), '{BLANK}+$', '') AS chunk FROM chunks JOIN d USING (doc_id)),
    coded AS (SELECT DISTINCT sha1('d' || doc_id || '/' || chunk) AS id, doc_id % 50 = 0 AS asked, {letters_sql('chunk')} AS v FROM trimmed WHERE chunk <> ''),
    scored AS (SELECT q.id AS query, x.id AS doc, round(list_cosine_similarity(q.v, x.v), 9) AS score FROM coded q, coded x WHERE q.asked),
    r AS ({top_sql('scored', 10)})
    SELECT query, doc, round(score, 6) AS score, rank FROM r
    """


@plan("R02_chunk_search_whole", chunk_search_sql())
def chunk_search_whole(t):
    """The chunks of every 50th document searched among the chunks of all documents, ten each.

    Equal chunks of one document have one id and count once.
    """
    from textloom.operators import chunks, features

    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("/"))
    asked = (F.col("doc_id") % 50 == 0).alias("asked")
    rows = chunks.chunk_rows(t.documents.select(name.alias("name"), "text", asked), "name", "text", 1024, 0)
    # coded where they are cut: vectors are shuffled, not texts
    pieces = features.encode(rows.select("id", "chunk", "asked"), "chunk", letter_profile)
    coded = settle(pieces.select("id", "embedding", "asked").dropDuplicates(["id"]))
    return retrieval.dense(coded, coded.where("asked"), "id", "embedding", "id", "embedding", 10)


def letter_profile(texts):
    """Shares of some letters, with a constant so that no vector is zero: stands in for a text model."""
    import numpy as np

    letters = np.frombuffer(b"etaonihsrl", np.uint8)
    lowered = (t.lower().encode("utf-8", "surrogatepass") for t in texts)
    counts = [np.bincount(np.frombuffer(t, np.uint8), minlength=256)[letters] for t in lowered]  # other signs have bytes past 127
    sizes = np.array([max(len(t), 1) for t in texts])
    return np.column_stack([np.full(len(texts), 1e-3), np.array(counts).reshape(-1, len(letters)) / sizes[:, None]])


@plan(
    "R04_hybrid_fusion",
    f"""
    WITH {bm25_sql()}, {COSINE_SQL},
    s AS ({top_sql('scores', 50)}), dr AS ({top_sql('dscores', 50)}),
    d AS (SELECT query, doc, round(score, 6) AS score FROM dr),
    sn AS (SELECT query, doc, CASE WHEN max(score) OVER w > min(score) OVER w
        THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS p FROM s WINDOW w AS (PARTITION BY query)),
    dn AS (SELECT query, doc, CASE WHEN max(score) OVER w > min(score) OVER w
        THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS p FROM d WINDOW w AS (PARTITION BY query)),
    f AS (SELECT query, doc, round(0.5 * coalesce(sn.p, 0) + 0.5 * coalesce(dn.p, 0), 6) AS score
          FROM sn FULL JOIN dn USING (query, doc))
    {top_sql('f', 10)}
    """,
)
def hybrid_fusion(t):
    sparse = settle(retrieval.cut(text_scores(t), 50).drop("rank"))
    return retrieval.fuse(sparse, settle(dense_run(t, 50).drop("rank")), 0.5, 10)


@plan(
    "R05_hybrid_sum",
    f"""
    WITH names AS (SELECT doc_id, string_split(text, chr(10))[1] AS name FROM documents),
    {bm25_sql()}, {bm25_sql('n', corpus='names', text='name')}, {COSINE_SQL}, near AS ({top_sql('dscores', 100)}),
    cand AS (SELECT query, doc FROM scores UNION SELECT query, doc FROM nscores UNION SELECT query, doc // 5 FROM near),
    c AS (SELECT query, cand.doc, max(round(s.score, 6)) AS score FROM cand JOIN dscores s USING (query) WHERE s.doc // 5 = cand.doc GROUP BY 1, 2),
    u AS (SELECT query, doc, score FROM scores UNION ALL SELECT query, doc, score FROM nscores UNION ALL SELECT query, doc, score FROM c),
    f AS (SELECT query, doc, round(sum(score), 6) AS score FROM u GROUP BY 1, 2)
    {top_sql('(SELECT * FROM f WHERE score > 0)', 10)}
    """,
)
def hybrid_sum(t):
    names = t.documents.select("doc_id", F.substring_index("text", "\n", 1).alias("name"))
    name_scores = settle(retrieval.bm25_scores(names, t.benchmark, "doc_id", "name", "item_id", "text"))
    chunk_scores = settle(text_scores(t))
    # five vectors per document; matched are the text hits and the nearest hundred vectors
    owner = F.floor(F.col("vec_id") / 5).cast("long")
    doc_vectors = t.embeddings.select(owner.alias("doc"), F.col("embedding").alias("vector"))
    asks = vector_queries(t).select(F.col("item_id").alias("query"), F.col("embedding").alias("vector"))
    near = dense_run(t, 100).select("query", F.floor(F.col("doc") / 5).cast("long").alias("doc"))
    matched = name_scores.select("query", "doc").unionByName(chunk_scores.select("query", "doc")).unionByName(near)
    return retrieval.hybrid_sum(name_scores, chunk_scores, retrieval.candidate_cosines(matched, doc_vectors, asks), 10)


@plan(
    "R06_late_interaction",
    f"""
    WITH {COSINE_SQL}, c AS ({top_sql('dscores', 50)}),
    tk AS (SELECT vec_id, i, v[i * 8 + 1 : i * 8 + 8] AS w FROM e, (SELECT unnest(range(8)) AS i)),
    p AS (SELECT c.query, c.doc, q.i, max(list_inner_product(q.w, d.w)) AS best
          FROM c JOIN tk q ON q.vec_id = c.query JOIN tk d ON d.vec_id = c.doc GROUP BY 1, 2, 3),
    f AS (SELECT query, doc, round(sum(best), 6) AS score FROM p GROUP BY 1, 2)
    {top_sql('f', 10)}
    """,
)
def late_interaction(t):
    pieces = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, F.lit(8)))
    tokens = t.embeddings.select(F.col("vec_id").alias("doc"), pieces.alias("tokens"))
    asks = vector_queries(t).select(F.col("item_id").alias("query"), pieces.alias("tokens"))
    return retrieval.late_interaction(dense_run(t, 50), asks, tokens, 10)


GROUPED_SQL = f"""
    {bm25_sql()}, raw AS ({top_sql('scores', 1000)}),
    best AS (SELECT query, source AS "group", doc, score FROM (
      SELECT raw.*, source, row_number() OVER (PARTITION BY query, source ORDER BY score DESC, doc) AS rn
      FROM raw JOIN documents ON doc = doc_id) WHERE rn = 1)"""


def grouped_run(t, k=10, raw_top=1000):
    return retrieval.grouped(text_scores(t), t.documents, "doc_id", "source", raw_top, k)


@plan("R07_grouped_search", f"WITH {GROUPED_SQL} {top_sql('best', 10)}")
def grouped_search(t):
    return grouped_run(t)


@plan(
    "R08_accumulated",
    f"""
    WITH {bm25_sql()}, r AS ({top_sql('scores', 10)}),
    f AS (SELECT query % 10 AS question, doc, round(sum(score), 6) AS score FROM r GROUP BY 1, 2)
    {top_sql('f', 10, keys='question')}
    """,
)
def accumulated(t):
    variants = t.benchmark.where(F.length("text") > 0).select(
        F.col("item_id").alias("query"), (F.col("item_id") % 10).alias("question")
    )
    return retrieval.accumulate(retrieval.cut(text_scores(t), 10).drop("rank"), variants, 10)


@plan(
    "R09_fuzzy_terms",
    f"""
    WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), {WORDS})) AS term FROM documents),
    q AS (SELECT DISTINCT unnest(regexp_extract_all(lower(p_name), {WORDS})) || 'e' AS asked FROM part
          UNION SELECT DISTINCT unnest(regexp_extract_all(lower(text), {WORDS})) FROM benchmark)
    SELECT asked, term FROM q JOIN w ON asked = term
    UNION
    SELECT asked, term FROM q JOIN w ON length(asked) = length(term)
      AND len(list_filter(range(1, length(asked) + 1), lambda i: substring(asked, i, 1) <> substring(term, i, 1))) = 1
    UNION
    SELECT asked, term FROM q JOIN w ON length(asked) = length(term) + 1
      AND len(list_filter(range(1, length(asked) + 1), lambda i: substring(asked, 1, i - 1) || substring(asked, i + 1) = term)) > 0
    UNION
    SELECT asked, term FROM q JOIN w ON length(asked) + 1 = length(term)
      AND len(list_filter(range(1, length(term) + 1), lambda i: substring(term, 1, i - 1) || substring(term, i + 1) = asked)) > 0
    """,
)
def fuzzy_terms(t):
    words = lambda df, c: df.select(F.explode(tx.words(F.col(c))).alias("term"))
    names = words(t.part, "p_name").select(F.concat("term", F.lit("e")).alias("term"))
    asked = words(t.benchmark, "text").unionByName(names).distinct()
    return retrieval.fuzzy_terms(settle(words(t.documents, "text").distinct()), settle(asked))


@plan(
    "R10_term_match",
    f"""
    WITH w AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), {WORDS})) AS term FROM documents)),
    q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), {WORDS})) AS term FROM benchmark))
    SELECT item_id AS query, doc_id AS doc, count(*) AS n FROM q JOIN w USING (term) GROUP BY 1, 2
    """,
)
def term_match(t):
    asked = retrieval.query_terms(t.benchmark, "item_id", "text", ())
    return retrieval.matching_docs(t.documents, "doc_id", "text", asked)


SENTENCE_SQL = r"""
    p AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(
        regexp_replace(text, '([.!?])[ \t\n\x0b\f\r]+', '\1' || chr(1), 'g'), '\x01|\n+'), lambda s: trim(s)), lambda s: length(s) > 0) AS s
      FROM conversations),
    sents AS (SELECT conv_id * 1000000 + turn * 1000 + no AS sid, s[no + 1] AS sentence,
                     array_to_string(s[greatest(no - 3, 0) + 1 : no + 4], ' ') AS around
              FROM (SELECT conv_id, turn, s, unnest(range(len(s))) AS no FROM p))"""


def _stopped(column):
    stop = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
    return f"list_distinct(list_filter(regexp_extract_all(lower({column}), {WORDS}), lambda w: w NOT IN ({stop})))"


@plan(
    "R11_window_rerank",
    f"""
    WITH {SENTENCE_SQL}, {bm25_sql(corpus='sents', doc='sid', text='sentence')}, h AS ({top_sql('scores', 10)}),
    a AS (SELECT query, doc, h.score, round(len(list_intersect({_stopped('text')}, {_stopped('around')})) / len({_stopped('text')}), 6) AS again
          FROM h JOIN sents ON doc = sid JOIN benchmark ON item_id = query)
    SELECT query, doc, again, score, CAST(rank AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query ORDER BY again DESC, score DESC, doc) AS rank FROM a) WHERE rank <= 5
    """,
)
def window_rerank(t):
    found = t.conversations.select("conv_id", "turn", tx.sentences(F.col("text")).alias("found"))
    rows = found.select("conv_id", "turn", F.inline(tx.sentence_windows(F.col("found"), 3)))
    rows = rows.withColumn("doc", F.col("conv_id") * 1_000_000 + F.col("turn") * 1_000 + F.col("no"))
    return retrieval.window_rerank(rows, t.benchmark, "item_id", "text").drop("window")


@plan(
    "R12_multi_hop",
    f"""
    WITH {bm25_sql()}, r AS ({top_sql('scores', 5)}),
    f AS (SELECT query % 10 AS question, doc, min(query // 10 * 100 + rank) AS first FROM r GROUP BY 1, 2)
    SELECT question, doc, row_number() OVER (PARTITION BY question ORDER BY first) AS place FROM f
    """,
)
def multi_hop(t):
    hops = retrieval.cut(text_scores(t), 5).select(
        (F.col("query") % 10).alias("question"), F.floor(F.col("query") / 10).alias("hop"), "doc", "rank"
    )
    return retrieval.merge_hops(hops, "question", "doc").select("question", "doc", "place")


@plan(
    "R13_result_projection",
    f"""
    WITH {GROUPED_SQL}, r AS ({top_sql('best', 10)})
    SELECT query, "group" AS repo, doc AS name, score AS relevance FROM r
    """,
)
def result_projection(t):
    run = grouped_run(t)
    hit = F.struct(
        F.col("score").alias("relevance"), F.struct(F.col("group").alias("repo"), F.col("doc").alias("name")).alias("fields")
    )
    nested = run.groupBy("query").agg(F.collect_list(hit).alias("hits"))  # at most ten hits per query
    return retrieval.project_hits(nested, ["repo", "name"])


# -- evaluation --------------------------------------------------------------------------


def labelled_queries(t):
    """Each benchmark item asks for a source by number; its document count comes along."""
    queries = t.benchmark.select(
        F.col("item_id").alias("query"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("query_label")
    )
    counts = t.documents.groupBy(F.col("source").alias("query_label")).agg(
        F.sum(F.when(F.col("lang") == "en", 1).otherwise(0)).alias("doc_count")
    )
    return queries.join(counts, "query_label", "left").select("query", "query_label", "doc_count")


def labelled_results(t, k=10):
    run = retrieval.cut(text_scores(t), k)
    return evaluation.result_labels(run, t.documents, "doc_id", F.array("source", "lang"))


EVAL_SQL = f"""
    {bm25_sql()}, r AS ({top_sql('scores', 10)}),
    lq AS (SELECT item_id AS query, 'src' || CAST(item_id % 20 AS VARCHAR) AS query_label FROM benchmark),
    hit AS (SELECT lq.query, query_label, CAST(coalesce(sum(CASE WHEN source = query_label THEN 1 ELSE 0 END), 0) AS BIGINT) AS hits_at_10,
              CAST(coalesce(sum(CASE WHEN contains('[' || source || ', ' || lang || ']', query_label) THEN 1 ELSE 0 END), 0) AS BIGINT) AS loose
            FROM lq LEFT JOIN r USING (query) LEFT JOIN documents ON doc = doc_id GROUP BY 1, 2)"""


@plan(
    "E01_hits_at_k",
    f"""
    WITH {EVAL_SQL}
    SELECT 'element' AS rule, query, hits_at_10, CASE WHEN hits_at_10 > 0 THEN 1 ELSE 0 END AS accuracy_at_10 FROM hit
    UNION ALL SELECT 'substring', query, loose, CASE WHEN loose > 0 THEN 1 ELSE 0 END FROM hit
    """,
)
def hits_at_k(t):
    results, queries = settle(labelled_results(t)), labelled_queries(t)
    out = None
    for rule in ("element", "substring"):
        part = evaluation.hits_at_k(results, queries, 10, rule).select(
            F.lit(rule).alias("rule"), "query", "hits_at_10", "accuracy_at_10"
        )
        out = part if out is None else out.unionByName(part)
    return out


def evaluation_table(t):
    run = settle(grouped_run(t))
    labelled = run.withColumn("true_labels", F.array("group"))
    return evaluation.hits_at_k(labelled, labelled_queries(t), 10)


@plan(
    "E02_evaluation_table",
    f"""
    WITH {GROUPED_SQL}, r AS ({top_sql('best', 10)}),
    lq AS (SELECT item_id AS query, 'src' || CAST(item_id % 20 AS VARCHAR) AS query_label FROM benchmark),
    c AS (SELECT source, CAST(sum(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) AS BIGINT) AS doc_count FROM documents GROUP BY 1)
    SELECT lq.query, query_label, doc_count, count(*) FILTER (r."group" = query_label) AS hits_at_10,
           CASE WHEN count(*) FILTER (r."group" = query_label) > 0 THEN 1 ELSE 0 END AS accuracy_at_10
    FROM lq LEFT JOIN r USING (query) LEFT JOIN c ON c.source = query_label GROUP BY 1, 2, 3
    """,
)
def evaluation_rows(t):
    return evaluation_table(t)


@plan(
    "E03_map_ndcg",
    f"""
    WITH {bm25_sql()}, r AS ({top_sql('scores', 100)}),
    qr AS (SELECT item_id AS query, doc_id AS doc, quality + 2 * toxic AS rel
           FROM benchmark JOIN documents ON source = 'src' || CAST(item_id % 20 AS VARCHAR) JOIN labels USING (doc_id)),
    j AS (SELECT r.query, r.rank, rel, row_number() OVER (PARTITION BY r.query ORDER BY r.rank) AS nth
          FROM r JOIN qr USING (query, doc) WHERE rel > 0),
    got AS (SELECT query, sum(nth / rank) AS p, sum(rel / log2(rank + 1)) AS dcg FROM j GROUP BY 1),
    i AS (SELECT query, rel, row_number() OVER (PARTITION BY query ORDER BY rel DESC, doc) AS place FROM qr WHERE rel > 0),
    ideal AS (SELECT query, count(*) AS n, sum(rel / log2(place + 1)) AS idcg FROM i GROUP BY 1)
    SELECT query, round(coalesce(p / n, 0), 6) AS map, round(coalesce(dcg / idcg, 0), 6) AS ndcg
    FROM (SELECT DISTINCT query FROM qr) LEFT JOIN ideal USING (query) LEFT JOIN got USING (query)
    """,
)
def map_ndcg(t):
    docs = t.documents.select("doc_id", "source").join(fit_broadcast(t.labels), "doc_id")
    items = fit_broadcast(t.benchmark.select(
        F.col("item_id").alias("query"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("source")
    ))
    qrels = settle(docs.join(items, "source").select(
        "query", F.col("doc_id").alias("doc"), (F.col("quality") + 2 * F.col("toxic")).alias("rel")
    ))
    out = evaluation.rank_metrics(retrieval.cut(text_scores(t), 100), qrels)
    return out.select("query", F.round("map", 6).alias("map"), F.round("ndcg", 6).alias("ndcg"))


TAU_SQL = """
    SELECT {out}round(sum(sign(a.x - b.x) * sign(a.y - b.y)) /
      sqrt(sum(CASE WHEN a.x <> b.x THEN 1 ELSE 0 END) * 1.0 * sum(CASE WHEN a.y <> b.y THEN 1 ELSE 0 END)), 6) AS tau
    FROM v a JOIN v b ON {on} {group}"""


@plan(
    "E04_kendall",
    "WITH v AS (SELECT l_quantity AS x, l_discount AS y, count(*) AS n FROM lineitem GROUP BY 1, 2) "
    """
    SELECT round(sum(a.n * b.n * sign(a.x - b.x) * sign(a.y - b.y)) /
      sqrt(sum(CASE WHEN a.x <> b.x THEN a.n * b.n ELSE 0 END) * 1.0 * sum(CASE WHEN a.y <> b.y THEN a.n * b.n ELSE 0 END)), 6) AS tau
    FROM v a, v b""",
)
def kendall(t):
    out = evaluation.kendall_tau(t.lineitem, [], "l_quantity", "l_discount")
    return out.select(F.round("tau", 6).alias("tau"))


@plan(
    "E05_mean_row_kendall",
    f"""
    WITH v AS (SELECT user_id AS g, value AS x, CAST(json_extract(props, '$.k') AS INTEGER) AS y, event_id FROM events),
    r AS ({TAU_SQL.format(out='a.g, ', on='a.g = b.g AND a.event_id <> b.event_id', group='GROUP BY a.g')})
    SELECT round(avg(tau), 5) AS tau FROM r
    """,
)
def mean_row_kendall(t):
    rows = t.events.select("user_id", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    out = evaluation.mean_row_tau(rows, "user_id", "value", "k")
    return out.select(F.round("tau", 5).alias("tau"))


@plan(
    "E06_run_adapter",
    """
    SELECT CAST(l_suppkey AS BIGINT) AS query, l_orderkey AS doc, round(CASE WHEN l_returnflag = 'N' THEN l_tax ELSE 1 - l_discount END, 6) AS score
    FROM lineitem
    """,
)
def run_adapter(t):
    rows = t.lineitem.select(
        F.col("l_suppkey").alias("query"), F.col("l_orderkey").alias("doc"), F.col("l_discount").alias("distance"),
        F.col("l_tax").alias("score"), "l_returnflag",
    )
    hybrid = evaluation.as_run(rows.where("l_returnflag = 'N'"), is_hybrid=True)
    plain = evaluation.as_run(rows.where("l_returnflag <> 'N'"))
    return hybrid.unionByName(plain).withColumn("score", F.round("score", 6))


@plan(
    "E07_evaluation_summary",
    f"""
    WITH {EVAL_SQL}
    SELECT round(avg(hits_at_10), 6) AS hits, round(avg(CASE WHEN hits_at_10 > 0 THEN 1 ELSE 0 END), 6) AS accuracy FROM hit
    """,
)
def evaluation_summary(t):
    rows = evaluation.hits_at_k(labelled_results(t), labelled_queries(t), 10)
    means = frames.group_means(rows, [], ["hits_at_10", "accuracy_at_10"])
    return means.select(F.round("hits_at_10", 6).alias("hits"), F.round("accuracy_at_10", 6).alias("accuracy"))
