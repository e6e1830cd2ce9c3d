"""Text and vector retrieval as joins over postings and block products."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions import text as tx, vectors
from textloom.operators import inverted
from textloom.operators.similarity import _matrix, top_k
from textloom.scale import (
    best_per_group, fit_broadcast, fits, running, salted_join, settle, top_per_group,
)

# The usual BM25 parameters of inverted-index stores.
K1, B = 1.2, 0.75

VOCABULARY = 20_000
ROUND = 6


def query_terms(queries: DataFrame, query: str, text: str, stop_words=tx.STOP_WORDS) -> DataFrame:
    """(query, term, qtf) rows."""
    found = queries.select(F.col(query).alias("query"), F.explode(tx.terms(F.col(text), stop_words)).alias("term"))
    return found.groupBy("query", "term").agg(F.count(F.lit(1)).alias("qtf"))


def postings(corpus: DataFrame, doc: str, text: str, asked: DataFrame, stop_words=tx.STOP_WORDS):
    """Postings of the asked terms, rows of whole documents, and the number and mean length of all documents.

    Where the asked terms fit a list, one pass over the texts leaves one small row per document: its
    length and the tokens that some query asks for (``hits``). A document whose key is its own stays such a row; rows that share
    a key, or have none, are counted as postings. Beyond the list the counted terms of each document
    are joined with the asked ones, and only what is asked is kept; there are no whole rows then.
    """
    tokens = corpus.select(F.col(doc).alias("doc"), tx.terms(F.col(text), stop_words).alias("tokens"))
    words = asked.select("term").distinct()
    if fits(words, VOCABULARY):
        listed = ", ".join(f"'{r['term']}'" for r in words.collect())  # letters and digits only
        wanted = F.expr(f"filter(tokens, t -> t IN ({listed}))") if listed else F.array().cast("array<string>")
        hits = settle(tokens.select("doc", F.size("tokens").alias("length"), wanted.alias("hits")))
        total = hits.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).first()
        keys = hits.groupBy("doc").agg(F.count(F.lit(1)).alias("_n"))
        shared = settle(keys.where("_n > 1 OR doc IS NULL").select(F.col("doc").alias("_shared")))
        whole, rows = hits, hits.limit(0)
        if not shared.isEmpty():
            same, shared = F.col("doc").eqNullSafe(F.col("_shared")), fit_broadcast(shared)
            whole, rows = hits.join(shared, same, "left_anti"), hits.join(shared, same, "left_semi")
        return _counted(rows), whole, total["n"], total["mean"] or 1.0
    total = tokens.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("tokens")).alias("mean")).first()
    rows = tokens.select("doc", F.size("tokens").alias("length"), F.col("tokens").alias("hits"))
    return _counted(rows).join(words, "term", "left_semi"), None, total["n"], total["mean"] or 1.0


def _counted(rows: DataFrame) -> DataFrame:
    """(doc, length, term, tf) from rows of tokens."""
    return rows.select("doc", "length", F.explode("hits").alias("term")).groupBy("doc", "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25_scores(
    corpus: DataFrame,
    queries: DataFrame,
    doc: str,
    text: str,
    query: str,
    query_text: str,
    stop_words=tx.STOP_WORDS,
    k1: float = K1,
    b: float = B,
) -> DataFrame:
    """BM25 score of every document that shares a term with a query: (query, doc, score).

    A row of a whole document meets the weights of all queries inside its task, so its scores need no shuffle; where
    the weights are too many for that, and for postings, they are joined by term and added up.
    """
    asked = settle(query_terms(queries, query, query_text, stop_words))
    counted, whole, n, mean = postings(corpus, doc, text, asked, stop_words)
    counted = settle(counted)
    held = counted.select("term")
    if whole is not None:
        held = held.unionByName(whole.select(F.explode(F.array_distinct("hits")).alias("term")))
    frequency = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = settle(asked.join(frequency, "term").select("query", "term", (F.col("qtf") * idf).alias("weight")))
    scored = None
    if whole is not None and fits(weighted):
        scored = _row_scores(whole, weighted, mean, k1, b)
    elif whole is not None:
        counted = counted.unionByName(_counted(whole))
    if scored is None or not counted.isEmpty():
        saturation = (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(mean)))
        impact = counted.select("doc", "term", saturation.alias("impact"))
        matched = salted_join(impact, weighted, ["term"])
        summed = matched.groupBy("query", "doc").agg(F.sum(F.col("weight") * F.col("impact")).alias("score"))
        scored = summed if scored is None else scored.unionByName(summed)
    return scored.select("query", "doc", F.round("score", ROUND).alias("score"))


SCORES = 500_000  # numbers of a table of some documents by all queries


def _row_scores(whole: DataFrame, weighted: DataFrame, mean: float, k1: float, b: float) -> DataFrame:
    """(query, doc, score) of rows (doc, length, hits) that are one document each, for ``weighted`` of a bounded size."""
    table = weighted.orderBy("term").toArrow().combine_chunks()
    asks = table["query"].combine_chunks().dictionary_encode(null_encoding="encode") if len(table) else None
    if asks is None:
        return whole.sparkSession.createDataFrame([], f"query {dict(weighted.dtypes)['query']}, doc {dict(whole.dtypes)['doc']}, score double")
    terms = table["term"].combine_chunks().dictionary_encode()
    starts = np.searchsorted(terms.indices.to_numpy(), np.arange(len(terms.dictionary) + 1))  # numbered as they come, in order
    shared = whole.sparkSession.sparkContext.broadcast(
        (terms.dictionary, starts, asks.dictionary, asks.indices.to_numpy(), table["weight"].to_numpy())
    )

    def score(batches):
        words, starts, names, asked, weights = shared.value
        step = max(1, SCORES // len(names))
        for batch in (whole.slice(at, step) for whole in batches for at in range(0, whole.num_rows, step)):
            hits = batch.column("hits")
            sizes = pc.fill_null(pc.list_value_length(hits), 0).to_numpy(zero_copy_only=False)
            found = pc.index_in(hits.flatten(), value_set=words)
            row = np.repeat(np.arange(batch.num_rows), sizes)[pc.is_valid(found).to_numpy(zero_copy_only=False)]
            entry, tf = np.unique(row * len(words) + found.drop_null().to_numpy(), return_counts=True)
            row, word = entry // len(words), entry % len(words)
            length = pc.fill_null(batch.column("length"), 0).to_numpy(zero_copy_only=False)[row]
            impact = (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * length / mean))
            times = starts[word + 1] - starts[word]
            ends = np.cumsum(times)
            at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - times - starts[word], times)
            pair = np.repeat(row, times) * len(names) + asked[at]
            total = np.bincount(pair, weights[at] * np.repeat(impact, times), batch.num_rows * len(names))
            met = np.flatnonzero(np.bincount(pair, minlength=len(total)))
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(met % len(names))), batch.column("doc").take(pa.array(met // len(names))), pa.array(total[met])],
                names=["query", "doc", "score"],
            )

    return whole.mapInArrow(score, f"query {dict(weighted.dtypes)['query']}, doc {dict(whole.dtypes)['doc']}, score double")


KEPT = 200_000  # rows of a task before its lists are cut again


def _first_cut(scores: DataFrame, k: int) -> DataFrame:
    """Rows of ``scores`` (query, doc, score) among the first ``k`` of their query in some rows of their task.

    A task cuts its lists whenever ``KEPT`` further rows have come, so it never holds or sorts all of them. Scores that are no numbers and null
    documents pass unseen; so does all where documents are neither whole numbers nor texts.
    """
    if not isinstance(scores.schema["doc"].dataType, (T.IntegralType, T.StringType)):
        return scores

    def cut_lists(table):
        query = table["query"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        doc = table["doc"].combine_chunks()
        doc = (doc if pa.types.is_integer(doc.type) else pc.rank(doc, tiebreaker="dense")).to_numpy()
        order = np.lexsort((doc, -table["score"].to_numpy(), query))
        ordered = query[order]
        first = np.r_[0, np.flatnonzero(np.diff(ordered)) + 1]
        place = np.arange(len(ordered)) - np.repeat(first, np.diff(np.r_[first, len(ordered)]))
        return table.take(pa.array(order[place < k]))

    def run(batches):
        held, rows, least = [], 0, KEPT
        for batch in batches:
            plain = pc.and_(pc.is_valid(batch.column("doc")), pc.fill_null(pc.is_finite(batch.column("score")), False))
            yield batch.filter(pc.invert(plain))
            held.append(batch.filter(plain))
            rows += held[-1].num_rows
            if rows >= least:
                table = cut_lists(pa.Table.from_batches(held))
                if len(table) > 10 * KEPT:  # very many queries
                    yield from table.to_batches()
                    table = table.slice(0, 0)
                held, rows = table.to_batches(), len(table)
                least = 2 * rows + KEPT
        if rows:
            yield from cut_lists(pa.Table.from_batches(held)).to_batches()

    return scores.mapInArrow(run, scores.schema)


def cut(scores: DataFrame, k: int) -> DataFrame:
    """Top ``k`` of each query by score, ties to the smaller document."""
    return top_per_group(_first_cut(scores, k), ["query"], [F.desc("score"), F.asc("doc")], k)


def bm25(corpus, queries, doc, text, query, query_text, k: int = 10, **options) -> DataFrame:
    return cut(bm25_scores(corpus, queries, doc, text, query, query_text, **options), k)


def dense(corpus, queries, doc, vector, query, query_vector, k: int = 10) -> DataFrame:
    """Exact cosine top ``k``: (query, doc, score, rank)."""
    found = top_k(queries, corpus, query, query_vector, doc, vector, k)
    return found.select("query", F.col("row").alias("doc"), F.round("score", ROUND).alias("score"), "rank")


def dense_approximate(corpus, queries, doc, vector, query, query_vector, k: int = 10, lists: int = 1024, bits: int = 512,
                      near: int = 8, miss: float = 0.1, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Cosine top ``k`` by inverted lists, and the number of exact comparisons of each query.

    See ``textloom.operators.inverted``: a row as good as the k-th result is left out with probability ``miss``.
    """
    index = inverted.build(corpus, doc, vector, lists, bits, seed)
    found, candidates = inverted.search(index, queries, query, query_vector, k, near, miss=miss)
    return found.withColumn("score", F.round("score", ROUND)), candidates


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact results of each query that were found."""
    hit = found.select("query", "doc", F.lit(1).alias("hit"))
    return (
        exact.select("query", "doc")
        .join(hit, ["query", "doc"], "left")
        .groupBy("query")
        .agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    )


def relative_scores(run: DataFrame) -> DataFrame:
    """Scores of each query mapped to [0, 1]; equal scores become 1."""
    ends = run.groupBy("query").agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    spread = F.col("_hi") - F.col("_lo")
    share = F.when(spread > 0, (F.col("score") - F.col("_lo")) / spread).otherwise(F.lit(1.0))
    return salted_join(run, settle(ends), ["query"]).select("query", "doc", share.alias("share"))


def fuse(sparse: DataFrame, dense_run: DataFrame, alpha: float = 0.5, k: int = 10) -> DataFrame:
    """Relative-score fusion: alpha * dense + (1 - alpha) * sparse over both result lists."""
    both = relative_scores(sparse).select(
        "query", "doc", (F.col("share") * (1 - alpha)).alias("part")
    ).unionByName(relative_scores(dense_run).select("query", "doc", (F.col("share") * alpha).alias("part")))
    return cut(both.groupBy("query", "doc").agg(F.round(F.sum("part"), ROUND).alias("score")), k)


PAIRS = 50_000  # pairs compared at once
QUERY_VALUES = 4_000_000  # most numbers of the query vectors that go to every task


def candidate_cosines(candidates: DataFrame, doc_vectors: DataFrame, query_vectors: DataFrame) -> DataFrame:
    """(query, doc, score) per candidate pair and vector of the document.

    ``doc_vectors`` has one row (doc, vector) per chunk, ``query_vectors`` (query, vector). While the query vectors hold at
    most ``QUERY_VALUES`` numbers they go to every task as one matrix, and a document's vectors meet the
    numbers of its queries; past that both kinds of vectors are joined to the pairs.
    """
    pairs = candidates.select("query", "doc").distinct()
    asks = settle(query_vectors.select("query", "vector"))
    docs = doc_vectors.select("doc", F.col("vector").alias("_d"))
    total = asks.agg(F.sum(F.size("vector"))).first()[0] or 0
    if total > QUERY_VALUES:
        met = salted_join(pairs, asks.withColumnRenamed("vector", "_q"), ["query"])
        rows = salted_join(met, docs, ["doc"])
        return rows.select("query", "doc", F.round(vectors.cosine(F.col("_q"), F.col("_d")), ROUND).alias("score"))
    held = asks.orderBy("query").collect()
    names = np.array([r["query"] for r in held], dtype=object)
    shared = pairs.sparkSession.sparkContext.broadcast((names, _matrix([r["vector"] for r in held]) if held else np.zeros((0, 1))))
    table = pairs.sparkSession.createDataFrame([(r["query"], i) for i, r in enumerate(held)], f"query {dict(asks.dtypes)['query']}, _n int")
    placed = pairs.join(F.broadcast(table), "query").select("doc", "_n")  # a row per query vector
    listed = placed.groupBy("doc").agg(F.collect_list("_n").alias("_asked"))  # at most all queries
    rows = salted_join(docs, listed, ["doc"])
    kinds = f"query {dict(asks.dtypes)['query']}, doc {dict(docs.dtypes)['doc']}, score double"

    def compare(batches):
        names, matrix = shared.value
        for frame in batches:
            if not len(frame):
                continue
            units = _matrix(frame["_d"])
            sizes = frame["_asked"].map(len).to_numpy()
            asked, row = np.concatenate(frame["_asked"].to_list()), np.repeat(np.arange(len(frame)), sizes)
            for lo in range(0, len(row), PAIRS):
                q, d = asked[lo : lo + PAIRS], row[lo : lo + PAIRS]
                score = np.round(np.einsum("ij,ij->i", matrix[q], units[d]), ROUND)
                yield pd.DataFrame({"query": names[q], "doc": frame["doc"].to_numpy()[d], "score": score})

    return rows.mapInPandas(compare, kinds)


def hybrid_sum(name_scores: DataFrame, chunk_scores: DataFrame, chunk_cosines: DataFrame, k: int = 10) -> DataFrame:
    """Text score of the name plus that of the chunks plus the best chunk cosine, if positive.

    ``chunk_cosines`` has one row per matched query, document and chunk.
    """
    best = chunk_cosines.groupBy("query", "doc").agg(F.max("score").alias("score"))
    parts = name_scores.select("query", "doc", "score").unionByName(
        chunk_scores.select("query", "doc", "score")
    ).unionByName(best)
    total = parts.groupBy("query", "doc").agg(F.round(F.sum("score"), ROUND).alias("score"))
    return cut(total.where("score > 0"), k)


def late_interaction(candidates: DataFrame, query_tokens: DataFrame, doc_tokens: DataFrame, k: int = 10) -> DataFrame:
    """Re-rank candidates by the sum over query tokens of the best dot product.

    ``query_tokens`` (query, tokens) and ``doc_tokens`` (doc, tokens) hold arrays of token
    vectors; the work per candidate stays in its row.
    """
    rows = salted_join(
        salted_join(candidates.select("query", "doc"), query_tokens.withColumnRenamed("tokens", "_q"), ["query"]),
        doc_tokens.withColumnRenamed("tokens", "_d"),
        ["doc"],
    )

    @F.pandas_udf("double")
    def total(asked: pd.Series, held: pd.Series) -> pd.Series:
        tokens = lambda v: np.stack([np.asarray(x, np.float64) for x in v]) if len(v) else None
        pairs = ((tokens(q), tokens(d)) for q, d in zip(asked, held))
        return pd.Series([0.0 if q is None or d is None else float((q @ d.T).max(axis=1).sum()) for q, d in pairs])

    return cut(rows.select("query", "doc", F.round(total("_q", "_d"), ROUND).alias("score")), k)


def grouped(run: DataFrame, groups: DataFrame, doc: str, group: str, raw_top: int = 1000, k: int = 10) -> DataFrame:
    """Best document of each group among the ``raw_top`` results, then the ``k`` best groups.

    Results without an entry in ``groups`` are dropped.
    """
    named = salted_join(cut(run, raw_top).drop("rank"), groups.select(F.col(doc).alias("doc"), F.col(group).alias("group")), ["doc"])
    best = best_per_group(named, ["query", "group"], [-F.col("score"), F.col("doc")])
    return cut(best.select("query", "group", "doc", "score"), k)


def accumulate(run: DataFrame, variants: DataFrame, k: int = 10) -> DataFrame:
    """Sum the scores a document got from the variants of a question: (question, doc, score)."""
    summed = salted_join(run, variants, ["query"]).groupBy("question", "doc").agg(
        F.round(F.sum("score"), ROUND).alias("score")
    )
    return top_per_group(summed, ["question"], [F.desc("score"), F.asc("doc")], k)


def _near_forms(term: Column) -> Column:
    """The term and all its one-character deletions."""
    cuts = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(term), F.lit(1))),
        lambda i: F.concat(F.substr(term, F.lit(1), i - 1), F.substr(term, i + 1)),
    )
    return F.array_distinct(F.concat(F.array(term), cuts))


def fuzzy_terms(vocabulary: DataFrame, asked: DataFrame) -> DataFrame:
    """Pairs (asked, term) at edit distance at most one.

    Two words within one edit share a word or a one-character deletion, so candidates meet
    by an equi join on those forms and are then checked.
    """
    forms = vocabulary.select("term", F.explode(_near_forms(F.col("term"))).alias("_form"))
    asks = asked.select(F.col("term").alias("asked"), F.explode(_near_forms(F.col("term"))).alias("_form"))
    near = salted_join(forms, asks, ["_form"])
    return near.where(F.levenshtein("asked", "term", 1).between(0, 1)).select("asked", "term").distinct()


def matching_docs(corpus: DataFrame, doc: str, text: str, terms: DataFrame, stop_words=()) -> DataFrame:
    """(query, doc, n) for documents holding any of the query's terms; n counts distinct terms."""
    words = corpus.select(F.col(doc).alias("doc"), F.array_distinct(tx.terms(F.col(text), stop_words)).alias("w"))
    rows = words.select("doc", F.explode("w").alias("term"))
    hits = salted_join(rows, terms.select("query", "term").distinct(), ["term"])
    return hits.groupBy("query", "doc").agg(F.count(F.lit(1)).alias("n"))


def merge_hops(hops: DataFrame, query: str, passage: str) -> DataFrame:
    """Union of the passages of several hops, each at its first place: (query, passage, place)."""
    first = hops.groupBy(query, passage).agg(F.min(F.struct("hop", "rank")).alias("_at"))
    return running(first.select(query, passage, "_at.hop", "_at.rank"), [query], ["hop", "rank"], position="place")


def window_rerank(
    sentences: DataFrame,
    queries: DataFrame,
    query: str,
    query_text: str,
    first: int = 10,
    keep: int = 5,
    score: Column | None = None,
) -> DataFrame:
    """Sentence hits, replaced by their windows and scored again: the ``keep`` best per query.

    ``sentences`` has doc (unique), sentence and window. ``score`` sees the columns window,
    asked (query terms) and score; by default it is the share of query terms in the window.
    """
    hits = bm25(sentences, queries, "doc", "sentence", query, query_text, first)
    asked = queries.select(F.col(query).alias("query"), F.array_distinct(tx.terms(F.col(query_text))).alias("asked"))
    rows = salted_join(salted_join(hits.drop("rank"), sentences.select("doc", "window"), ["doc"]), asked, ["query"])
    if score is None:
        score = F.size(F.array_intersect("asked", tx.terms(F.col("window")))) / F.size("asked")
    again = rows.withColumn("again", F.round(score, ROUND))
    return top_per_group(again, ["query"], [F.desc("again"), F.desc("score"), F.asc("doc")], keep).select(
        "query", "doc", "again", "score", "window", "rank"
    )


def project_hits(results: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Chosen fields and the relevance of nested hits."""
    return results.select("query", F.explode("hits").alias("hit")).select(
        "query", *[F.col(f"hit.fields.{f}").alias(f) for f in fields], F.col("hit.relevance").alias("relevance")
    )
