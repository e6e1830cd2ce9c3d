"""Term features, topics, clusters, diversity, corpus comparison and user functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import features, frames, topics
from textloom.operators.similarity import coherence, cosine_matrix
from textloom.plans.registry import plan
from textloom.plans.retrieval_plans import WORDS
from textloom.scale import running, settle
from textloom.sources.markup import encode_each

STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)


def terms_sql(column):
    return f"list_filter(regexp_extract_all(lower({column}), {WORDS}), lambda w: w NOT IN ({STOP}))"


TF_SQL = f"""
    tok AS (SELECT DISTINCT doc_id AS doc, unnest({terms_sql('text')}) AS term FROM documents),
    df AS (SELECT term, count(*) AS df FROM tok GROUP BY 1 HAVING count(*) >= 5),
    w AS (SELECT doc, term, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1 AS w FROM tok JOIN df USING (term)),
    s AS (SELECT doc, sqrt(sum(w * w)) AS size FROM w GROUP BY 1)"""


def weights(t):
    counts = features.term_counts(t.documents, "doc_id", "text", min_df=5, binary=True)
    return features.tf_idf(counts, t.documents.count())


@plan("M01_tf_idf", f"WITH {TF_SQL} SELECT doc, term, round(w / size, 6) AS weight FROM w JOIN s USING (doc)")
def tf_idf(t):
    return weights(t).withColumn("weight", F.round("weight", 6))


def digamma_sql(x):
    tail = "0.0::DOUBLE"
    for c in reversed(topics.SERIES):
        tail = f"(({tail}) + ({c!r}::DOUBLE)) / (({x} + 6) * ({x} + 6))"
    return f"(ln({x} + 6) - 0.5::DOUBLE / ({x} + 6) + {tail} - (" + " + ".join(f"1.0::DOUBLE / ({x} + {i})" for i in range(6)) + "))"


TOPICS, ROUNDS = 4, 2


def lda_sql(k=TOPICS, rounds=ROUNDS):
    """The variational updates written out; the last are lt{rounds} (term, t0, ...) and ld{rounds} (doc, g0, ...)."""
    each = range(k)
    listed = lambda form: ", ".join(form.format(i=i) for i in each)
    added = lambda form: " + ".join(form.format(i=i) for i in each)
    first = ", ".join(f"0.1::DOUBLE + ((length(term) + ascii(term)) * {7 + 3 * i} + {i}) % 11 / 10.0::DOUBLE AS t{i}" for i in each)
    parts = [
        "n AS (SELECT doc, term, 1.0::DOUBLE AS tf FROM tok JOIN df USING (term))",
        f"lt0 AS (SELECT term, {first} FROM df)",
        f"ld0 AS (SELECT doc, {listed(f'1.0::DOUBLE / {k} + sum(tf) / {k} AS g{{i}}')} FROM n GROUP BY 1)",
    ]
    for r in range(rounds):
        parts += [
            f"lb{r} AS (SELECT term, {', '.join(f'exp({digamma_sql(f't{i}')} - {digamma_sql(f'w{i}')}) AS b{i}' for i in each)} "
            f"FROM lt{r}, (SELECT {listed('sum(t{i}) AS w{i}')} FROM lt{r}))",
            f"le{r} AS (SELECT doc, {', '.join(f'exp({digamma_sql(f'g{i}')} - {digamma_sql('w')}) AS e{i}' for i in each)} "
            f"FROM (SELECT *, {added('g{i}')} AS w FROM ld{r}))",
            f"lp{r} AS (SELECT doc, term, {listed(f'tf * e{{i}} * b{{i}} / ({added('e{i} * b{i}')}) AS p{{i}}')} "
            f"FROM n JOIN lb{r} USING (term) JOIN le{r} USING (doc))",
            f"lt{r + 1} AS (SELECT term, {listed(f'1.0::DOUBLE / {k} + sum(p{{i}}) AS t{{i}}')} FROM lp{r} GROUP BY 1)",
            f"ld{r + 1} AS (SELECT doc, {listed(f'1.0::DOUBLE / {k} + sum(p{{i}}) AS g{{i}}')} FROM lp{r} GROUP BY 1)",
        ]
    return f"WITH {TF_SQL}, {', '.join(parts)}"


def binary_counts(t):
    return features.term_counts(t.documents, "doc_id", "text", min_df=5, binary=True)


def fitted_lda(t):
    counts = settle(binary_counts(t))
    cells = topics.packed(counts)
    return topics.lda(counts, TOPICS, ROUNDS, start=fixed_start, cells=cells), counts, cells


@plan("M02_lda", f"{lda_sql()} SELECT term, df AS documents, {', '.join(f'round(t{i}, 6) AS t{i}' for i in range(TOPICS))} FROM lt{ROUNDS} JOIN df USING (term)")
def lda(t):
    """The weight of every term in every topic after the stated rounds."""
    model, counts, _ = fitted_lda(t)
    known = counts.groupBy("term").agg(F.max("df").alias("documents"))
    return model.terms.join(known, "term").select("term", "documents", *[F.round(f"t{i}", 6).alias(f"t{i}") for i in range(TOPICS)])


def nmf_sql(topics, rounds):
    """The updates written out: one table expression per half round."""

    def half(name, mine, other, key, other_key):
        gram = ", ".join(f"sum(f{i} * f{j}) AS g{i}_{j}" for i in range(topics) for j in range(topics))
        up = ", ".join(f"sum(weight * f{i}) AS u{i}" for i in range(topics))
        fresh = ", ".join(
            f"m.f{j} * u{j} / (1e-12 + " + " + ".join(f"m.f{i} * g{i}_{j}" for i in range(topics)) + f") AS f{j}" for j in range(topics)
        )
        return (
            f"{name} AS (SELECT m.{key}, {fresh} FROM {mine} m JOIN (SELECT {key}, {up} FROM v JOIN {other} USING ({other_key}) GROUP BY 1) u "
            f"ON u.{key} = m.{key}, (SELECT {gram} FROM {other}) g)"
        )


    def first(text):
        return ", ".join(
            f"0.1::DOUBLE + ((length({text}) + ascii({text})) * {7 + 3 * i} + {i}) % 11 / 10.0::DOUBLE AS f{i}" for i in range(topics)
        )

    parts = [
        "v AS (SELECT doc, term, w / size AS weight FROM w JOIN s USING (doc))",
        f"d0 AS (SELECT DISTINCT doc, {first('CAST(doc AS VARCHAR)')} FROM v)",
        f"t0 AS (SELECT DISTINCT term, {first('term')} FROM v)",
    ]
    for r in range(rounds):
        parts.append(half(f"t{r + 1}", f"t{r}", f"d{r}", "term", "doc"))
        parts.append(half(f"d{r + 1}", f"d{r}", f"t{r + 1}", "doc", "term"))
    rounded = ", ".join(f"round(f{i}, 6) AS f{i}" for i in range(topics))
    return f"WITH {TF_SQL}, {', '.join(parts)} SELECT doc, {rounded} FROM d{rounds}"


def fixed_start(key, i):
    """First factor values from the length and first character of a key."""
    text = key.cast("string")
    return 0.1 + ((F.length(text) + F.ascii(text)) * (7 + 3 * i) + i) % 11 / F.lit(10.0)


@plan("M03_nmf", nmf_sql(3, 2))
def nmf(t):
    docs, _ = features.nmf(weights(t), 3, rounds=2, start=fixed_start)
    return docs.select("doc", *[F.round(F.col("factor")[i], 6).alias(f"f{i}") for i in range(3)])


@plan(
    "M04_topic_of_document",
    """
    WITH v AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(64)) AS i FROM embeddings)
    SELECT vec_id, CAST(i AS INTEGER) AS topic FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS rn FROM v) WHERE rn = 1
    """,
)
def topic_of_document(t):
    return features.with_topic(t.embeddings, "embedding").select("vec_id", "topic")


@plan(
    "M05_topic_words",
    f"""
    {lda_sql()},
    shares AS ({" UNION ALL ".join(f"SELECT {i} AS topic, term, round(t{i} / (SELECT sum(t{i}) FROM lt{ROUNDS}), 9) AS weight FROM lt{ROUNDS}" for i in range(TOPICS))})
    SELECT topic, term, round(weight, 6) AS weight, CAST(rank AS INTEGER) AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) AS rank FROM shares) WHERE rank <= 10
    """,
)
def topic_words(t):
    """The ten heaviest terms of every topic."""
    best = features.top_words(fitted_lda(t)[0].term_shares(), ["topic"], 10)
    return best.withColumn("weight", F.round("weight", 6)).select("topic", "term", "weight", "rank")


@plan(
    "M06_topic_representatives",
    "SELECT vec_id, embedding[4] AS topic_score FROM embeddings ORDER BY 2 DESC, 1 LIMIT 5",
)
def topic_representatives(t):
    scored = t.embeddings.withColumnRenamed("embedding", "distribution")
    return features.topic_representatives(scored, 3, "vec_id", 5).select("vec_id", "topic_score")


CLASS_SQL = f"""
    tok AS (SELECT source, unnest({terms_sql('text')}) AS term FROM documents),
    tf AS (SELECT source, term, count(*) AS tf FROM tok GROUP BY 1, 2),
    a AS (SELECT avg(n) AS a FROM (SELECT source, sum(tf) AS n FROM tf GROUP BY 1)),
    f AS (SELECT term, sum(tf) AS f FROM tf GROUP BY 1),
    w AS (SELECT source, term, round(tf * ln(1 + a / f), 9) AS weight FROM tf JOIN f USING (term), a),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY weight DESC, term) AS rank FROM w)"""


@plan(
    "M07_class_words",
    f"""
    WITH {CLASS_SQL}, l AS (SELECT source, string_agg(term, '_' ORDER BY rank) AS words FROM r WHERE rank <= 10 GROUP BY 1)
    SELECT source, size, words FROM (SELECT source, count(*) AS size FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10) JOIN l USING (source)
    """,
)
def class_words(t):
    return features.topic_table(t.documents, "source", "text", 10, 10)


@plan(
    "M08_topics_over_time",
    f"""
    WITH e AS (SELECT event_type, date_diff('millisecond', TIMESTAMP '1970-01-01', ts) AS m,
                 replace(replace(props, '{{"k": ', 'w'), '}}', ' ') || event_type AS body FROM events),
    x AS (SELECT min(m) AS lo, max(m) AS hi FROM e),
    b AS (SELECT *, CAST(greatest(least(ceil((m - lo) / (hi - lo) * 20) - 1, 19), 0) AS INTEGER) AS bin FROM e, x),
    tok AS (SELECT event_type, bin, unnest({terms_sql('body')}) AS term FROM b),
    tf AS (SELECT event_type, bin, term, count(*) AS tf FROM tok GROUP BY 1, 2, 3),
    a AS (SELECT avg(n) AS a FROM (SELECT event_type, sum(tf) AS n FROM tf GROUP BY 1)),
    f AS (SELECT term, sum(tf) AS f FROM tf GROUP BY 1),
    w AS (SELECT event_type, bin, term, round(tf * ln(1 + a / f), 9) AS weight FROM tf JOIN f USING (term), a),
    r AS (SELECT *, row_number() OVER (PARTITION BY event_type, bin ORDER BY weight DESC, term) AS rank FROM w),
    l AS (SELECT event_type, bin, string_agg(term, ', ' ORDER BY rank) AS words FROM r WHERE rank <= 5 GROUP BY 1, 2),
    n AS (SELECT event_type, bin, count(*) AS frequency FROM b GROUP BY 1, 2)
    SELECT event_type, bin, frequency, words FROM n JOIN l USING (event_type, bin)
    """,
)
def topics_over_time(t):
    body = F.concat(F.replace(F.replace("props", F.lit('{"k": '), F.lit("w")), F.lit("}"), F.lit(" ")), "event_type")
    rows = t.events.select("event_type", "ts", body.alias("body"))
    return features.topics_over_time(rows, "event_type", "ts", "body", 20, 5).drop("start")


def transform_sql():
    """One update of the documents of the table, from even shares, with the fitted terms."""
    each = range(TOPICS)
    whole = " + ".join(f"e{i} * b{i}" for i in each)
    expected = ", ".join(f"exp({digamma_sql(f't{i}')} - {digamma_sql(f'w{i}')}) AS b{i}" for i in each)
    steps = [
        f"xb AS (SELECT term, {expected} FROM lt{ROUNDS}, (SELECT {', '.join(f'sum(t{i}) AS w{i}' for i in each)} FROM lt{ROUNDS}))",
        f"xn AS (SELECT doc, term, tf FROM n WHERE term IN (SELECT term FROM xb))",
        f"x0 AS (SELECT doc, {', '.join(f'1.0::DOUBLE / {TOPICS} + sum(tf) / {TOPICS} AS g{i}' for i in each)} FROM xn GROUP BY 1)",
    ]
    for r in range(2):
        steps += [
            f"xe{r} AS (SELECT doc, {', '.join(f'exp({digamma_sql(f'g{i}')} - {digamma_sql('w')}) AS e{i}' for i in each)} "
            f"FROM (SELECT *, {' + '.join(f'g{i}' for i in each)} AS w FROM x{r}))",
            f"x{r + 1} AS (SELECT doc, {', '.join(f'1.0::DOUBLE / {TOPICS} + sum(tf * e{i} * b{i} / ({whole})) AS g{i}' for i in each)} "
            f"FROM xn JOIN xb USING (term) JOIN xe{r} USING (doc) GROUP BY 1)",
        ]
    total = " + ".join(f"g{i}" for i in each)
    shares = ", ".join(f"round(g{i} / ({total}), 6) AS share{i}" for i in each)
    best = "CASE WHEN g0 IS NOT NULL THEN CAST(list_position([" + ", ".join(f"g{i}" for i in each) + "], greatest(" + ", ".join(f"g{i}" for i in each) + ")) - 1 AS INTEGER) END"
    return f"{lda_sql()}, {', '.join(steps)} SELECT doc_id, {shares}, {best} AS topic FROM documents LEFT JOIN x2 ON doc = doc_id"


@plan("M09_topic_transform", transform_sql())
def topic_transform(t):
    """The share of every topic in every document; none where no term is known."""
    model, counts, cells = fitted_lda(t)
    shares = features.with_topic(topics.transform(model, counts, 2, cells).distributions(), "distribution")
    shares = shares.select(F.col("doc").alias("doc_id"), *[F.round(F.col("distribution")[i], 6).alias(f"share{i}") for i in range(TOPICS)], "topic")
    return t.documents.select("doc_id").join(shares, "doc_id", "left")


def lloyd_sql(k, rounds, name=""):
    """Table expressions of Lloyd steps from the first ``k`` vectors; the last is {name}a{rounds}."""
    away = "round(list_sum(list_transform(range(1, 65), lambda i: (v[i] - m[i]) * (v[i] - m[i]))), 9)"
    parts = [f"{name}c0 AS (SELECT CAST(vec_id AS INTEGER) AS id, v AS m FROM e WHERE vec_id < {k})"]
    for r in range(rounds + 1):
        parts.append(f"{name}a{r} AS (SELECT vec_id, arg_min(id, {{'d': {away}, 'i': id}}) AS id FROM e, {name}c{r} GROUP BY vec_id)")
        if r < rounds:
            parts.append(
                f"{name}n{r} AS (SELECT id, list(x ORDER BY i) AS m FROM (SELECT id, i, avg(x) AS x FROM (SELECT id, unnest(v) AS x, "
                f"unnest(range(64)) AS i FROM {name}a{r} JOIN e USING (vec_id)) GROUP BY 1, 2) GROUP BY 1)"
            )
            parts.append(f"{name}c{r + 1} AS (SELECT id, coalesce(n.m, c.m) AS m FROM {name}c{r} c LEFT JOIN {name}n{r} n USING (id))")
    return ", ".join(parts)


VECTORS_SQL = "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def lloyd(rows, k, rounds):
    first = rows.where(F.col("vec_id") < k).select(
        F.col("vec_id").cast("int").alias("cluster_id"), F.col("embedding").cast("array<double>").alias("centre")
    )
    return features.kmeans_from(rows, "vec_id", "embedding", first, rounds)


@plan("M10_kmeans", f"WITH {VECTORS_SQL}, {lloyd_sql(10, 3)} SELECT vec_id, id AS cluster_id FROM a3")
def kmeans(t):
    rows = t.embeddings.select("vec_id", "embedding")
    return features.cluster(rows, clusterer=lambda df: lloyd(df, 10, 3)).select("vec_id", "cluster_id")


def sparse_lloyd_sql(weights, k, rounds):
    """Lloyd steps over the sparse rows of ``weights`` (doc, term, weight) from its ``k`` first documents; the last is sa{rounds}."""
    parts = [
        f"sd AS (SELECT DISTINCT doc FROM {weights})",
        f"ss AS (SELECT CAST(row_number() OVER (ORDER BY doc) - 1 AS INTEGER) AS id, doc FROM sd QUALIFY row_number() OVER (ORDER BY doc) <= {k})",
        f"sc0 AS (SELECT id, term, weight AS m FROM ss JOIN {weights} USING (doc))",
    ]
    for r in range(rounds + 1):
        parts += [
            f"sn{r} AS (SELECT id, sum(m * m) AS size FROM sc{r} GROUP BY 1)",
            f"sx{r} AS (SELECT doc, id, sum(weight * m) AS dot FROM {weights} JOIN sc{r} USING (term) GROUP BY 1, 2)",
            f"sa{r} AS (SELECT doc, arg_max(id, {{'g': round(2 * coalesce(dot, 0) - size, 9), 'i': -id}}) AS id "
            f"FROM (SELECT sd.doc, n.id, n.size, x.dot FROM sd CROSS JOIN sn{r} n LEFT JOIN sx{r} x ON x.doc = sd.doc AND x.id = n.id) GROUP BY 1)",
        ]
        if r < rounds:
            parts.append(
                f"sc{r + 1} AS (SELECT id, term, sum(weight) / any_value(c) AS m FROM {weights} JOIN sa{r} USING (doc) "
                f"JOIN (SELECT id, count(*) AS c FROM sa{r} GROUP BY 1) USING (id) GROUP BY 1, 2 "
                f"UNION ALL SELECT * FROM sc{r} WHERE id NOT IN (SELECT id FROM sa{r}))"
            )
    return ", ".join(parts)


def first_documents(weights, k):
    """The ``k`` first documents with a feature, numbered from 0."""
    return running(weights.select("doc").distinct().orderBy("doc").limit(k), [], ["doc"], position="cluster_id").select(
        (F.col("cluster_id") - 1).cast("int").alias("cluster_id"), "doc"
    )


MERGED_SQL = "(SELECT doc_id, 'source:' || chr(10) || source || chr(10) || chr(10) || 'text:' || chr(10) || text AS body FROM documents)"


@plan(
    "M10_text_clusters",
    f"""
    WITH {TF_SQL.replace(terms_sql('text'), terms_sql('body')).replace('FROM documents),', f'FROM {MERGED_SQL}),', 1)},
    wt AS (SELECT doc, term, w / size AS weight FROM w JOIN s USING (doc)), {sparse_lloyd_sql('wt', 5, 2)}
    SELECT doc_id, id AS cluster_id FROM documents LEFT JOIN sa2 ON doc = doc_id
    """,
)
def text_clusters(t):
    """Cluster of every document by the weights of its terms."""
    def extract(rows):
        return features.tf_idf(features.term_counts(rows, "doc", "text", min_df=5, binary=True), t.documents.count())

    def clusters(weights):
        cells = topics.packed(weights, "weight", nulls=True, grouped=True)
        return topics.sparse_kmeans(weights, first_documents(topics.documents_of(cells), 5), 2, cells)

    docs = t.documents.select("doc_id", "source", "text")
    return features.cluster_texts(docs, "doc_id", ["source", "text"], extract, clusters).select("doc_id", "cluster_id")


@plan(
    "M11_refit",
    f"WITH {VECTORS_SQL}, {lloyd_sql(10, 1, 'x')}, {lloyd_sql(5, 2)} SELECT vec_id, a2.id AS cluster_id, xa1.id AS earlier FROM a2 JOIN xa1 USING (vec_id)",
)
def refit(t):
    stored = settle(lloyd(t.embeddings.select("vec_id", "embedding"), 10, 1))
    rows = stored.withColumn("earlier", F.col("cluster_id"))
    return features.refit(rows, lambda df: lloyd(df, 5, 2)).select("vec_id", "cluster_id", "earlier")


@plan(
    "M12_cluster_examples",
    """
    WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, unnest(range(1, 65)) AS i FROM embeddings),
    c AS (SELECT label, i, avg(v) AS m FROM x GROUP BY 1, 2),
    d AS (SELECT label, vec_id, round(sqrt(sum((v - m) * (v - m))), 9) AS dist FROM x JOIN c USING (label, i) GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY dist, vec_id) AS rank FROM d)
    SELECT label AS cluster_id, r.vec_id, e.embedding[1] AS first FROM r JOIN embeddings e USING (vec_id, label) WHERE rank <= 3
    """,
)
def cluster_examples(t):
    rows = t.embeddings.withColumnRenamed("label", "cluster_id")
    found = features.cluster_examples(rows, "embedding", "vec_id", 3)
    return found.select("cluster_id", "vec_id", F.col("embedding")[0].alias("first"))


def vowel_profile(texts):
    """Share of each vowel: stands in for a text model."""
    return np.array([[t.count(v) / max(len(t), 1) for v in "aeiou"] for t in texts])


def vowels_sql(column, name):
    return ", ".join(
        f"(length({column}) - length(replace({column}, '{v}', ''))) / greatest(length({column}), 1) AS {name}{v}" for v in "aeiou"
    )


@plan("M13_text_encoder", f"SELECT doc_id, {vowels_sql('text', 'v_')} FROM documents")
def text_encoder(t):
    rows = features.encode(t.documents.select("doc_id", "text"), "text", vowel_profile)
    return rows.select("doc_id", *[F.col("embedding")[i].alias(f"v_{v}") for i, v in enumerate("aeiou")])


def power_sql(cells, k, rounds, start, centred=True):
    """Block power iteration over ``cells`` (row, col, value), step by step; the last columns are pq{rounds} (col, v0, ...)."""
    each = range(k)

    def orthonormal(name, source):
        """Gram and Schmidt column by column."""
        parts, at = [], source
        for i in each:
            minus = "".join(f" - p{j} * v{j}" for j in range(i))
            dots = ", ".join(f"sum(w{i} * v{j}) AS p{j}" for j in range(i))
            head = f"SELECT * FROM {at}, (SELECT {dots} FROM {at})" if i else f"SELECT * FROM {at}"
            keep = ", ".join(["col", *[f"v{j}" for j in range(i)], *[f"w{j}" for j in range(i + 1, k)]])
            step = f"{name}_{i}" if i < k - 1 else name
            parts.append(
                f"{name}t{i} AS (SELECT {keep}, w{i}{minus} AS x FROM ({head}))",
            )
            parts.append(f"{step} AS (SELECT {keep}, x / (SELECT sqrt(sum(x * x)) FROM {name}t{i}) AS v{i} FROM {name}t{i})")
            at = step
        return parts

    mean = "pm AS (SELECT col, sum(value) / (SELECT count(DISTINCT row) FROM {c}) AS mean FROM {c} GROUP BY 1)".format(c=cells)
    parts = [mean, f"pw0 AS (SELECT col, {', '.join(f'{start(i)} AS w{i}' for i in each)} FROM pm)", *orthonormal("pq0", "pw0")]
    for r in range(rounds):
        less = lambda text: text if centred else "0"
        shift = less(f"(SELECT sum(mean * v{{i}}) FROM pm JOIN pq{r} USING (col))")
        whole = less(f"(SELECT sum(y{{i}}) FROM py{r})")
        parts += [
            f"py{r} AS (SELECT row, {', '.join(f'sum(value * v{i}) - {shift.format(i=i)} AS y{i}' for i in each)} FROM {cells} JOIN pq{r} USING (col) GROUP BY 1)",
            f"pw{r + 1} AS (SELECT col, {', '.join(f's{i} - mean * {whole.format(i=i)} AS w{i}' for i in each)} FROM pm JOIN "
            f"(SELECT col, {', '.join(f'sum(value * y{i}) AS s{i}' for i in each)} FROM {cells} JOIN py{r} USING (row) GROUP BY 1) USING (col))",
            *orthonormal(f"pq{r + 1}", f"pw{r + 1}"),
        ]
    top = lambda i: f"(SELECT arg_max(v{i}, {{'a': round(abs(v{i}), 9), 'r': -rk}}) FROM (SELECT *, row_number() OVER (ORDER BY col) AS rk FROM pq{rounds}))"
    parts.append(f"axes AS (SELECT col, {', '.join(f'CASE WHEN {top(i)} < 0 THEN -v{i} ELSE v{i} END AS v{i}' for i in each)} FROM pq{rounds})")
    return ", ".join(parts)


def counted_start(key, i):
    """First axis entries from a column's number."""
    return ((key * (3 + 2 * i) + 1) % 7 - 3) / F.lit(7.0)


@plan(
    "M14_projection",
    f"""
    WITH cells AS (SELECT vec_id AS row, unnest(range(64)) AS col, unnest(embedding)::DOUBLE AS value FROM embeddings),
    {power_sql("cells", 2, 3, lambda i: f"((col * {3 + 2 * i} + 1) % 7 - 3) / 7.0::DOUBLE")},
    p AS (SELECT row, sum(value * v0) AS x, sum(value * v1) AS y FROM cells JOIN axes USING (col) GROUP BY 1)
    SELECT row AS vec_id, round(x - (SELECT avg(x) FROM p), 6) AS x, round(y - (SELECT avg(y) FROM p), 6) AS y FROM p
    """,
)
def projection(t):
    """Three rounds from stated axes."""
    rows = features.project(t.embeddings, "vec_id", "embedding", 2, 3, counted_start)
    return rows.select("vec_id", *[F.round(F.col("projection")[i], 6).alias(n) for i, n in enumerate("xy")])


@plan(
    "M16_parameter_sweep",
    f"WITH {VECTORS_SQL}, {lloyd_sql(5, 2, 'p')}, {lloyd_sql(10, 2, 'q')}, {lloyd_sql(20, 2, 'r')} "
    + " UNION ALL ".join(
        f"SELECT '[(''k'', {k})]' AS params, max(n) AS value FROM (SELECT count(*) AS n FROM {x}a2 GROUP BY id)" for k, x in ((5, "p"), (10, "q"), (20, "r"))
    ),
)
def parameter_sweep(t):
    """Three numbers of clusters, from the first vectors, stepped together."""
    rows = t.embeddings.select("vec_id", "embedding")
    sets = F.array(*[F.struct(F.lit(f"[('k', {k})]").alias("params"), F.lit(k).alias("k")) for k in (5, 10, 20)])
    first = rows.where("vec_id < 20").select("vec_id", F.col("embedding").cast("array<double>").alias("centre"), F.explode(sets).alias("s"))
    starts = first.where(F.col("vec_id") < F.col("s.k")).select("s.params", F.col("vec_id").cast("int").alias("cluster_id"), "centre")
    return features.sweep(rows, "vec_id", "embedding", starts, 2)


@plan(
    "M17_similarity_matrix",
    """
    WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS i FROM embeddings),
    c AS (SELECT label, i, avg(v) AS m FROM x GROUP BY 1, 2),
    s AS (SELECT label, sqrt(sum(m * m)) AS n FROM c GROUP BY 1),
    p AS (SELECT a.label AS l, b.label AS r, sum(a.m * b.m) AS d FROM c a JOIN c b USING (i) GROUP BY 1, 2)
    SELECT l AS "left", r AS "right", round(d / (x.n * y.n), 6) AS cosine FROM p JOIN s x ON x.label = l JOIN s y ON y.label = r
    """,
)
def similarity_matrix(t):
    means = t.embeddings.groupBy("label").agg(
        F.array(*[F.avg(F.col("embedding")[i].cast("double")) for i in range(64)]).alias("mean")
    )
    out = cosine_matrix(settle(means), "label", "mean")
    return out.select("left", "right", F.round("cosine", 6).alias("cosine"))


def draw_sql(i, earlier):
    """The i-th draw of a sample: a rank among the numbers not drawn yet, moved past those in ``earlier``."""
    rank = f"('0x' || substr(md5('42:' || size || ':' || trial || ':{i}'), 1, 12))::BIGINT % (n - {i})"
    for e in earlier:
        rank = f"({rank}) + CASE WHEN {e} <= ({rank}) THEN 1 ELSE 0 END"
    return rank


@plan(
    "M18_sample_diversity",
    f"""
    WITH e AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS at, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    p AS (SELECT t.range AS trial, s.range AS size, (SELECT count(*) FROM e) AS n FROM range(50) t, range(1, 4) s),
    d0 AS (SELECT *, {draw_sql(0, [])} AS a FROM p),
    d1 AS (SELECT *, {draw_sql(1, ['a'])} AS b FROM d0),
    d2 AS (SELECT *, {draw_sql(2, ['least(a, b)', 'greatest(a, b)'])} AS c FROM d1),
    g AS (SELECT size, list_cosine_similarity(x.v, y.v) AS ab, list_cosine_similarity(x.v, z.v) AS ac, list_cosine_similarity(y.v, z.v) AS bc
          FROM d2 JOIN e x ON x.at = a JOIN e y ON y.at = b JOIN e z ON z.at = c)
    SELECT CAST(size AS INTEGER) AS size, count(*) AS trials, round(avg(CASE size WHEN 1 THEN 1.0 WHEN 2 THEN 1 - ab * ab
           ELSE 1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc END), 6) AS determinant FROM g GROUP BY 1
    """,
)
def sample_diversity(t):
    out = features.sample_diversity(t.embeddings, "vec_id", "embedding", sizes=(1, 2, 3), trials=50)
    return out.withColumn("determinant", F.round("determinant", 6))


def diverse_sql(places):
    """The greedy rule written out: one table expression per place."""
    steps = ["p1 AS (SELECT label, vec_id, 1 AS place FROM cand WHERE rank = 1)"]
    for i in range(2, places + 1):
        steps.append(
            f"g{i} AS (SELECT c.label, c.vec_id, c.rank, round(0.7 * (1 - c.distance) - 0.3 * max(list_cosine_similarity(c.v, o.v)), 9) AS gain "
            f"FROM cand c JOIN p{i - 1} p ON p.label = c.label JOIN cand o ON o.vec_id = p.vec_id "
            f"WHERE c.vec_id NOT IN (SELECT vec_id FROM p{i - 1}) GROUP BY c.label, c.vec_id, c.rank, c.distance)"
        )
        steps.append(
            f"p{i} AS (SELECT * FROM p{i - 1} UNION ALL SELECT label, vec_id, {i} FROM "
            f"(SELECT *, row_number() OVER (PARTITION BY label ORDER BY gain DESC, rank) AS rn FROM g{i}) WHERE rn = 1)"
        )
    return f"""
    WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, unnest(range(1, 65)) AS i FROM embeddings),
    m AS (SELECT label, i, avg(v) AS m FROM x GROUP BY 1, 2),
    d AS (SELECT label, vec_id, round(sqrt(sum((v - m) * (v - m))), 9) AS distance FROM x JOIN m USING (label, i) GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) AS rank FROM d),
    cand AS (SELECT r.*, CAST(embedding AS DOUBLE[]) AS v FROM r JOIN embeddings USING (vec_id)),
    {", ".join(steps)} SELECT label, vec_id, place FROM p{places}"""


@plan("M19_diverse_selection", diverse_sql(10))
def diverse_selection(t):
    near = frames.nearest_to_centroid(t.embeddings, "label", "embedding", "vec_id", None)
    rows = near.withColumn("relevance", 1 - F.col("distance"))
    return features.diverse_selection(rows, "label", "vec_id", "embedding", "relevance", 10, 0.3)


@plan(
    "M20_feature_difference",
    f"""
    WITH tok AS (SELECT DISTINCT lang, doc_id, unnest({terms_sql('text')}) AS feature FROM documents WHERE lang IN ('en', 'de')),
    n1 AS (SELECT count(*) AS n FROM documents WHERE lang = 'en'), n2 AS (SELECT count(*) AS n FROM documents WHERE lang = 'de'),
    f AS (SELECT feature, count(*) FILTER (lang = 'en') / (SELECT n FROM n1) AS f1, count(*) FILTER (lang = 'de') / (SELECT n FROM n2) AS f2 FROM tok GROUP BY 1),
    m AS (SELECT feature, CASE WHEN greatest(f1, f2) > 0.9 THEN -1.0 ELSE f1 END AS f1, CASE WHEN greatest(f1, f2) > 0.9 THEN -1.0 ELSE f2 END AS f2 FROM f)
    SELECT 'absolute' AS metric, feature, round(f1, 6) AS freq_first, round(f2, 6) AS freq_second, round(f1 - f2, 6) AS frequency_difference FROM m
    UNION ALL
    SELECT 'relative', feature, round(f1, 6), round(f2, 6),
           round(f1 / (CASE WHEN greatest(f1, f2) = 0 THEN 1 ELSE greatest(f1, f2) END) - f2 / (CASE WHEN greatest(f1, f2) = 0 THEN 1 ELSE greatest(f1, f2) END), 6) FROM m
    """,
)
def feature_difference(t):
    docs = t.documents.where(F.col("lang").isin("en", "de"))
    present = docs.select("lang", F.explode(F.array_distinct(tx.terms(F.col("text")))).alias("feature"))
    counts = settle(present.groupBy("lang", "feature").agg(F.count("*").alias("n")))
    counted = {r[0]: r[1] for r in docs.groupBy("lang").count().collect()}
    sizes = {lang: counted.get(lang, 1) for lang in ("en", "de")}
    out = None
    for metric in ("absolute", "relative"):
        part = features.share_gaps(counts, "lang", "feature", sizes, metric == "relative", most=0.9).select(
            F.lit(metric).alias("metric"), "feature",
            *[F.round(c, 6).alias(n) for c, n in (("share_a", "freq_first"), ("share_b", "freq_second"), ("gap", "frequency_difference"))],
        )
        out = part if out is None else out.unionByName(part)
    return out


@plan(
    "M21_coherence",
    """
    WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    c AS (SELECT CASE WHEN a.vec_id = b.vec_id THEN 0.0 ELSE list_cosine_similarity(a.v, b.v) END AS c FROM e a, e b)
    SELECT 'count' AS statistic, CAST(count(*) AS DOUBLE) AS value FROM c UNION ALL SELECT 'mean', round(avg(c), 5) FROM c
    UNION ALL SELECT 'std', round(stddev_samp(c), 5) FROM c UNION ALL SELECT 'min', round(min(c), 5) FROM c
    UNION ALL SELECT 'max', round(max(c), 5) FROM c UNION ALL SELECT 'q0.25', round(quantile_cont(c, 0.25), 5) FROM c
    UNION ALL SELECT 'q0.50', round(quantile_cont(c, 0.5), 5) FROM c UNION ALL SELECT 'q0.75', round(quantile_cont(c, 0.75), 5) FROM c
    UNION ALL SELECT 'q0.95', round(quantile_cont(c, 0.95), 5) FROM c
    """,
)
def vector_coherence(t):
    out = coherence(t.embeddings, "vec_id", "embedding")
    return out.select("statistic", F.round("value", 5).alias("value"))


@plan(
    "M22_activations",
    """
    SELECT 'row' AS kind, vec_id AS id, CAST(len(list_filter(embedding, lambda x: x > 0)) AS DOUBLE) AS value FROM embeddings
    UNION ALL
    SELECT 'feature', i, round(CAST(max(x) AS DOUBLE), 6) FROM (SELECT unnest(embedding) AS x, unnest(range(64)) AS i FROM embeddings) GROUP BY i
    """,
)
def activations(t):
    rows = features.activation_counts(t.embeddings, "vec_id", "embedding").select(
        F.lit("row").alias("kind"), F.col("vec_id").alias("id"), F.col("active").cast("double").alias("value")
    )
    peaks = features.features_by_peak(t.embeddings, "embedding").select(
        F.lit("feature").alias("kind"), F.col("feature").cast("long").alias("id"), F.round(F.col("peak").cast("double"), 6).alias("value")
    )
    return rows.unionByName(peaks)


@plan("M23_batched_scores", f"SELECT conv_id, turn, {vowels_sql('text', 'score_')} FROM conversations")
def batched_scores(t):
    labels = [f"score_{v}" for v in "aeiou"]
    return features.score(t.conversations, "text", labels, vowel_profile).select("conv_id", "turn", *labels)


# -- user functions ----------------------------------------------------------------------


def swap_case(texts: pd.Series) -> pd.Series:
    return texts.str.swapcase()


@plan("L01_row_function", "SELECT p_partkey, upper(p_name) AS swapped FROM part")
def row_function(t):
    return features.map_column(t.part.select("p_partkey", "p_name"), "p_name", swap_case, "string", "swapped").drop("p_name")


@plan(
    "L02_text_preprocessor",
    f"""
    WITH tok AS (SELECT event_id AS doc, unnest(regexp_extract_all(lower(event_type || '  NUMBER ' || ' x'), {WORDS})) AS term FROM events)
    SELECT doc, term, count(*) AS tf FROM tok GROUP BY 1, 2
    """,
)
def text_preprocessor(t):
    rows = t.events.select("event_id", F.concat("event_type", F.lit("_ 12345 x")).alias("body"))
    return features.term_counts(rows, "event_id", "body", stop_words=(), preprocess=tx.unsnake).select("doc", "term", "tf")


@plan(
    "L03_pluggable_models",
    f"""
    WITH tok AS (SELECT conv_id * 1000 + turn AS doc, unnest({terms_sql("'role:' || chr(10) || role || chr(10) || chr(10) || 'text:' || chr(10) || text")}) AS term FROM conversations),
    wt AS (SELECT doc, term, CAST(count(*) AS DOUBLE) AS weight FROM tok GROUP BY 1, 2), {sparse_lloyd_sql('wt', 4, 1)}
    SELECT doc, id AS cluster_id FROM (SELECT conv_id * 1000 + turn AS doc FROM conversations) LEFT JOIN sa1 USING (doc)
    """,
)
def pluggable_models(t):
    """Another vectoriser, plain counts, and another number of clusters and rounds."""
    def extract(rows):
        return features.term_counts(rows, "doc", "text").select("doc", "term", F.col("tf").cast("double").alias("weight"))

    def clusters(weights):
        cells = topics.packed(weights, "weight", nulls=True)
        return topics.sparse_kmeans(weights, first_documents(topics.documents_of(cells), 4), 1, cells)

    turns = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc"), "role", "text")
    return features.cluster_texts(turns, "doc", ["role", "text"], extract, clusters).select("doc", "cluster_id")


def checked_length(text):
    if text.startswith("T"):
        raise ValueError("starts with T")
    return len(text)


@plan(
    "L04_item_map",
    """
    SELECT doc_id, CASE WHEN NOT starts_with(text, 'T') THEN CAST(length(text) AS INTEGER) END AS chars,
           CASE WHEN starts_with(text, 'T') THEN 'ValueError: starts with T' END AS error
    FROM documents
    """,
)
def item_map(t):
    return encode_each(t.documents.select("doc_id", "text"), "text", checked_length, "chars", "int").drop("text")


HOT = "CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE l_suppkey END"


@plan(
    "L05_group_function",
    f"""
    SELECT {HOT} AS supplier, count(*) AS n, CAST(quantile_cont(l_extendedprice, 0.5) AS DOUBLE) AS median,
           count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1
    """,
)
def group_function(t):
    """The median price and the number of parts of every supplier; a third of all rows share one key."""
    def describe(key, size, frames):
        middle, at, parts = [], 0, set()
        for frame in frames:
            for place in ((size - 1) // 2, size // 2):
                if at <= place < at + len(frame):
                    middle.append(float(frame["l_extendedprice"].iloc[place - at]))
            at += len(frame)
            parts.update(frame["l_partkey"].tolist())
        yield pd.DataFrame({"supplier": [key[0]], "n": [size], "median": [sum(middle) / 2], "parts": [len(parts)]})

    rows = t.lineitem.select(F.expr(HOT).alias("supplier"), "l_extendedprice", "l_partkey")
    found = features.group_stream(rows, ["supplier"], ["l_extendedprice", "l_partkey"], describe, "supplier long, n long, median double, parts long")
    return found


@plan(
    "L05_mergeable_function",
    "SELECT l_suppkey, count(*) AS n, max(l_quantity) AS top FROM lineitem GROUP BY 1",
)
def mergeable_function(t):
    def summary(frame):
        return pd.DataFrame({"l_suppkey": frame["l_suppkey"].iloc[:1], "n": [len(frame)], "top": [frame["l_quantity"].max()]})

    rows = t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return features.group_apply(
        rows, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"], summary,
        "l_suppkey long, n long, top double", {"n": F.sum("n"), "top": F.max("top")},
    )
