"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import (
    bpe, filter_audit, html_density, line_templates, packing, pii, pq, quality, secret_scan, sharding, simhash,
    token_alignment, token_counts,
)
from textloom.llm.registry import query

SHARDS = 24
VOCABULARY = "byte_bpe_50k.json"


@query("op1_tiered_packing", "documents")
def tiered_packing(docs: DataFrame) -> DataFrame:
    tokens = packing.load_tokens(public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return packing.pack(docs, "doc_id", "text", tokens)


@query("op5_merge_automaton", "documents")
def merge_automaton(docs: DataFrame) -> DataFrame:
    return bpe.round_trip(docs, "doc_id", "text", public_tokenizers.path(VOCABULARY))


@query("op8_rendezvous_shards", "documents")
def rendezvous_shards(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        sharding.rendezvous(["doc_id"], SHARDS).alias("shard"),
        sharding.rendezvous(["doc_id"], SHARDS + 1).alias("grown_shard"),
    )
    return sharding.number_slots(rows, "shard", ["doc_id", "size", "text_crc32"])


@query(
    "op6_threshold_rules",
    "documents",
    """
    WITH base AS (
        SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents
    ), split AS (
        SELECT doc_id, r, text,
               list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words,
               list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
        FROM base
    ), windows AS (
        SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
        FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM split WHERE len(words) >= 3)
    ), again AS (
        SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM windows) WHERE n > 1
    ), covered AS (
        SELECT r, count(DISTINCT p) AS n
        FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r
    ), counts AS (
        SELECT doc_id,
               len(words) AS n_words,
               length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
               length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
               length(text) - length(regexp_replace(text, '!', '', 'g')) AS n_exclamations,
               length(text) - length(regexp_replace(text, '\\p{Lu}', '', 'g')) AS n_upper,
               len(lines) AS n_lines,
               len(lines) - len(list_distinct(lines)) AS n_dup_lines,
               len(list_filter(words, lambda w: list_contains([%s], lower(w)))) AS n_stop_words,
               coalesce(n, 0) AS n_repeat_words
        FROM split LEFT JOIN covered USING (r)
    ), judged AS (
        SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               list_filter([
                   CASE WHEN n_words > 0 AND (word_chars < 3.0 * n_words OR word_chars > 10.0 * n_words) THEN 'word_length' END,
                   CASE WHEN n_words > 0 AND n_symbols > 0.1 * n_words THEN 'symbols' END,
                   CASE WHEN n_words > 0 AND n_exclamations > 0.5 * n_words THEN 'exclamations' END,
                   CASE WHEN word_chars > 0 AND n_upper > 0.4 * word_chars THEN 'upper_case' END,
                   CASE WHEN n_words > 0 AND n_stop_words < 0.03 * n_words THEN 'stop_words' END,
                   CASE WHEN n_lines > 0 AND n_dup_lines > 0.5 * n_lines THEN 'duplicate_lines' END
               ], lambda x: x IS NOT NULL) AS failed
        FROM counts
    )
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
           CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
           CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
           NOT base_failed AND len(failed) = 0 AS kept, array_to_string(failed, ',') AS failed_rules
    FROM judged
    """.replace("%s", ", ".join(f"'{w}'" for w in quality.STOP_WORDS)),
)
def threshold_rules(docs: DataFrame) -> DataFrame:
    return quality.judge(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.array_join("failed_rules", ",").alias("failed_rules"),
    )


@query("op10_popcount_grid", "documents")
def popcount_grid(docs: DataFrame) -> DataFrame:
    return simhash.near_duplicates(docs, "doc_id", "text").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query("op9_text_density", "pages")
def text_density(pages: DataFrame) -> DataFrame:
    return html_density.extract(pages.select("page_id", "url", "html"), "html")


@query("op7_shape_field", "documents")
def shape_field(docs: DataFrame) -> DataFrame:
    return pii.find(docs, "doc_id", "text")


@query("op4_product_quantisation", "embeddings")
def product_quantisation(vectors: DataFrame) -> DataFrame:
    return pq.near_duplicates(vectors, "vec_id", "embedding")


@query(
    "op2_line_templates",
    "documents",
    """
    WITH lines AS (
        SELECT doc_id, md5(coalesce(text, '')) AS body, unnest(range(len(l))) AS pos, unnest(l) AS line
        FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)
    ), parsed AS (
        SELECT doc_id, body, pos, list_filter(string_split_regex(regexp_replace(line,
                   '[^\\x20\\x09-\\x0D]*[0-9][^\\x20\\x09-\\x0D]*', '<*>', 'g'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words
        FROM lines
    ), leaves AS (
        SELECT doc_id, body, pos, words, array_to_string(words, ' ') AS sign,
               {'n': len(words), 'a': words[1], 'b': words[2], 'c': words[3]} AS leaf
        FROM parsed WHERE len(list_filter(words, lambda w: w <> '<*>')) > 0
    ), signs AS (
        SELECT leaf, sign, any_value(words) AS words FROM leaves GROUP BY leaf, sign
    ), shared AS (
        SELECT * FROM signs WHERE leaf IN (SELECT leaf FROM signs GROUP BY leaf HAVING count(*) > 1)
    ), places AS (
        SELECT leaf, unnest(range(len(words))) AS place, unnest(words) AS word FROM shared
    ), usual AS (
        SELECT leaf, place, max({'n': n, 'word': word}).word AS word
        FROM (SELECT leaf, place, word, count(*) AS n FROM places GROUP BY ALL) GROUP BY leaf, place
    ), templates AS (
        SELECT leaf, list(word ORDER BY place) AS template FROM usual GROUP BY leaf
    ), merged AS (
        SELECT leaf, sign FROM shared JOIN templates USING (leaf)
        WHERE len(list_filter(range(1, len(words) + 1), lambda i: words[i] = template[i])) >= 0.8 * len(words)
    ), stretches AS (
        SELECT leaf, sign, words, j,
               words[4 + (j * (len(words) - 3) + 4) // 5 : 3 + ((j + 1) * (len(words) - 3) + 4) // 5] AS part
        FROM shared, range(5) r(j) WHERE sign NOT IN (SELECT sign FROM merged)
    ), met AS (
        SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY leaf, j, part) AS size FROM stretches WHERE len(part) > 0)
        WHERE size > 1
    ), part_usual AS (
        SELECT leaf, j, part, place, max({'n': n, 'word': word}).word AS word FROM (
            SELECT leaf, j, part, place, word, count(*) AS n
            FROM (SELECT leaf, j, part, unnest(range(len(words))) AS place, unnest(words) AS word FROM met) GROUP BY ALL
        ) GROUP BY leaf, j, part, place
    ), part_templates AS (
        SELECT leaf, j, part, list(word ORDER BY place) AS template FROM part_usual GROUP BY leaf, j, part
    ), later AS (
        SELECT sign, max({'size': size, 'j': -j, 'part': part}) AS best FROM met JOIN part_templates USING (leaf, j, part)
        WHERE len(list_filter(range(1, len(words) + 1), lambda i: words[i] = template[i])) >= 0.8 * len(words)
        GROUP BY sign
    ), named AS (
        SELECT l.*, CASE WHEN m.sign IS NOT NULL THEN 'leaf' WHEN t.sign IS NOT NULL THEN concat(t.best.j, ' ', array_to_string(t.best.part, ' '))
                         ELSE concat('own ', l.sign) END AS own
        FROM leaves l LEFT JOIN merged m USING (sign) LEFT JOIN later t USING (sign)
    ), groups AS (
        SELECT leaf, own, min({'d': doc_id, 'b': body, 'p': pos}) AS first FROM named
        GROUP BY leaf, own HAVING count(DISTINCT body) > 1
    ), dropped AS (
        SELECT doc_id, count(*) AS n, list(pos) AS pos
        FROM named n JOIN groups g USING (leaf, own)
        WHERE n.body <> g.first.b OR n.pos <> g.first.p GROUP BY doc_id
    )
    SELECT d.doc_id, coalesce(len(string_split(text, chr(10))), 0) AS n_lines, coalesce(x.n, 0) AS n_dropped,
           CASE WHEN x.n IS NULL THEN text ELSE coalesce((SELECT string_agg(t.line, chr(10) ORDER BY t.pos) FROM lines t
               WHERE t.doc_id = d.doc_id AND NOT list_contains(x.pos, t.pos)), '') END AS text
    FROM documents d LEFT JOIN dropped x USING (doc_id)
    """,
)
def drop_line_templates(docs: DataFrame) -> DataFrame:
    return line_templates.drop_recurring(docs.select("doc_id", "text"), "doc_id", "text", ("n_lines", "n_dropped"))


@query("op3_secret_forest", "documents")
def secret_forest(docs: DataFrame) -> DataFrame:
    found = secret_scan.scan(docs.select("doc_id", "source", "text"), "text", path="source")
    return found.select("doc_id", "start", "end", "kind", F.round("score", 6).alias("score"), "secret")


@query("op11_rank_merging", "documents")
def rank_merging(docs: DataFrame) -> DataFrame:
    counter = token_counts.load_counter(public_tokenizers.path("word_bpe_49k.json"))
    return token_counts.count_tokens(docs, "doc_id", "text", counter, 2048)


@query("op12_merge_path", "documents")
def merge_path(docs: DataFrame) -> DataFrame:
    sides = token_alignment.load_sides(
        public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")
    )
    return token_alignment.compare(docs, "doc_id", "text", sides)


@query(
    "op13_truth_table_words",
    "documents labels",
    """
    WITH texts AS (
        SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
    ), split AS (
        SELECT *, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words,
               min(doc_id) OVER (PARTITION BY text) AS first
        FROM texts
    ), judged AS (
        SELECT doc_id, part, [
                   len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
                   100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text),
                   regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > first, false)
               ] AS fails
        FROM split
    ), said AS (
        SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
        FROM labels GROUP BY doc_id
    ), kinds AS (
        SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic
        FROM judged LEFT JOIN said USING (doc_id) GROUP BY ALL
    ), letters AS (
        SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest(range(1, 6)) AS i
    ), orders AS (
        SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS places
        FROM letters a, letters b, letters c, letters d, letters e
        WHERE b.x <> a.x AND c.x NOT IN (a.x, b.x) AND d.x NOT IN (a.x, b.x, c.x) AND e.x NOT IN (a.x, b.x, c.x, d.x)
    ), steps AS (
        SELECT filter_order, CAST(step AS INTEGER) AS step, places[step] AS own, places[1:step - 1] AS earlier,
               list_filter([1, 2, 3, 4, 5], lambda i: i <> places[step]) AS others
        FROM orders, (SELECT unnest(range(1, 6)) AS step)
    ), met AS (
        SELECT part, filter_order, step, own, n, n_good, n_toxic, fails[own] AS failed,
               len(list_filter(earlier, lambda i: fails[i])) > 0 AS gone,
               len(list_filter(others, lambda i: fails[i])) > 0 AS shared
        FROM kinds, steps
    ), told AS (
        SELECT part, filter_order, step, own,
               sum(n) FILTER (NOT gone AND NOT failed) AS kept, sum(n) FILTER (NOT gone AND failed) AS removed,
               sum(n) FILTER (gone AND failed) AS redundant, sum(n) FILTER (failed AND NOT shared) AS unique_fails,
               sum(n_good) FILTER (NOT gone AND failed) AS good_lost, sum(n_toxic) FILTER (NOT gone AND failed) AS toxic_lost
        FROM met GROUP BY ALL
    )
    SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
           CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
           CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
           CAST(coalesce(sum(removed) OVER (PARTITION BY part, own), 0) AS BIGINT) AS shapley
    FROM told
    """,
)
def truth_table_words(docs: DataFrame, labels: DataFrame) -> DataFrame:
    counts = filter_audit.survivors(
        docs, "doc_id", "text", "lang", filter_audit.text_failures("text"), labels, "doc_id",
        F.col("quality") == 1, F.col("toxic") == 1,
    )
    return filter_audit.audit(counts, "ABCDE")
