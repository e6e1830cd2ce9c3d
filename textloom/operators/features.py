"""Term features, clusters, topics, diversity and corpus comparison."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from itertools import chain, groupby

import numpy as np
import pandas as pd
from pyspark.ml import Estimator
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from textloom.cells import Cells, added, slices
from textloom.functions import dates, text as tx, vectors
from textloom.operators import axes
from textloom.operators.frames import nearest_to_centroid
from textloom.scale import best_per_group, fit_broadcast, on_disk, release, running, salted_join, settle, top_per_group

SHORT_ROWS = 1_000_000  # of a name and a number

# -- term features -----------------------------------------------------------------------


def term_counts(
    df: DataFrame, doc: str, text: str, min_df: int = 1, binary: bool = False, stop_words=tx.STOP_WORDS,
    preprocess: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """(doc, term, tf, df) for terms in at least ``min_df`` documents.

    Texts are dealt by document before they are cut into terms, so no term is shuffled to be counted.
    """
    source = F.col(text) if preprocess is None else preprocess(F.col(text))
    texts = df.select(F.col(doc).alias("doc"), source.alias("_text")).repartition("doc")
    tokens = texts.select("doc", F.explode(tx.terms(F.col("_text"), stop_words)).alias("term"))
    times = F.count(F.lit(1))
    counted = on_disk(tokens.groupBy("doc", "term").agg((F.least(times, F.lit(1)) if binary else times).alias("tf")))
    found = settle(counted.groupBy("term").agg(F.count(F.lit(1)).alias("_n")))
    common = found.where(F.col("_n") >= min_df).select("term", F.col("_n").alias("df"))
    # two short columns: more rows of them than of others keep within the bytes of a broadcast
    return salted_join(counted, common, ["term"], counts=found, broadcast_rows=SHORT_ROWS).select("doc", "term", "tf", "df")


def tf_idf(counts: DataFrame, n_docs: int) -> DataFrame:
    """Smoothed inverse document frequency and unit length per document: (doc, term, weight).

    ``counts`` is that of ``term_counts``. The window that gives a document its length holds the
    terms of one document.
    """
    idf = F.log(F.lit(1.0 + n_docs) / (F.lit(1.0) + F.col("df"))) + 1
    weighed = counts.select("doc", "term", (F.col("tf") * idf).alias("w"))
    size = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("doc")))
    return weighed.select("doc", "term", (F.col("w") / size).alias("weight"))


# -- topics ------------------------------------------------------------------------------


def with_topic(df: DataFrame, distribution: str) -> DataFrame:
    best = F.array_position(distribution, F.array_max(distribution)).cast("int") - 1
    return df.withColumn("topic", best)


def topic_representatives(scored: DataFrame, topic: int, row_id: str, k: int = 5) -> DataFrame:
    """The ``k`` documents with the largest share of one topic."""
    share = F.col("distribution")[topic]
    return scored.withColumn("topic_score", share).orderBy(F.desc("topic_score"), row_id).limit(k)


def nmf(
    weights: DataFrame,
    topics: int,
    rounds: int = 20,
    seed: int = 42,
    start: Callable[[Column, int], Column] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Nonnegative factors of a sparse document-term table: (doc, factor), (term, factor).

    Multiplicative updates of the squared error. Products with the table are sums
    over its non-zero entries, packed in cells that get the factors of their documents or terms; the Gram matrices are ``topics`` squared numbers.
    ``start`` gives the first value of a factor from the document or term and its number.
    """
    names = [f"f{i}" for i in range(topics)]
    # weights of ``tf_idf`` have each document's together; others are dealt anew
    cells = Cells(weights.select(F.col("doc").alias("row"), F.col("term").alias("col"), F.col("weight").alias("value")), nulls=True, grouped=True)

    def drawn(key, i):
        return 0.1 + F.pmod(F.xxhash64(key, F.lit(seed), F.lit(i)), F.lit(1000)) / 1000.0

    def begin(key):
        value = start or drawn
        return settle(
            cells.places[key == "term"].select(F.col("col" if key == "term" else "row").alias(key)).select(key, *[value(F.col(key), i).cast("double").alias(n) for i, n in enumerate(names)])
        )

    def by_term(at_row, at_col, weight, own, other):
        return None, sum((added(at_col[p], weight[p, None] * own[at_row[p]], len(other)) for p in slices(len(weight), topics)), np.zeros((len(other), topics)))

    def by_doc(at_row, at_col, weight, own, other):
        return sum((added(at_row[p], weight[p, None] * other[at_col[p]], len(own)) for p in slices(len(weight), topics)), np.zeros((len(own), topics))), None

    def update(mine, key, other, other_key):
        pair = [(i, j) for i in range(topics) for j in range(i, topics)]
        gram_row = other.agg(*[F.sum(F.col(names[i]) * F.col(names[j])) for i, j in pair]).first()
        gram = np.zeros((topics, topics))
        for (i, j), v in zip(pair, gram_row):
            gram[i, j] = gram[j, i] = v
        if key == "term":
            _, found, both = cells.meet(by_term, (0, topics), rows=other.withColumnRenamed("doc", "row"))
        else:
            found, _, both = cells.meet(by_doc, (topics, 0), cols=other.withColumnRenamed("term", "col"))
        up = found.groupBy(F.col(found.columns[0]).alias(key)).agg(*[F.sum(f"s{i}").alias(f"u_{n}") for i, n in enumerate(names)])
        down = lambda j: sum((F.col(names[i]) * float(gram[i, j]) for i in range(topics)), F.lit(1e-12))
        fresh = [(F.col(n) * F.col(f"u_{n}") / down(j)).alias(n) for j, n in enumerate(names)]
        stepped = settle(mine.join(up.hint("merge"), key).select(key, *fresh))
        release(mine, both)
        return stepped

    docs, terms = begin("doc"), begin("term")
    for _ in range(rounds):
        terms = update(terms, "term", docs, "doc")
        docs = update(docs, "doc", terms, "term")
    cells.release()
    pack = lambda df, key: df.select(key, F.array(*names).alias("factor"))
    return pack(docs, "doc"), pack(terms, "term")


def class_tf_idf(df: DataFrame, topic: str, text: str, stop_words=tx.STOP_WORDS, outlier: int | None = -1,
                 extra: Sequence[str] = ()) -> DataFrame:
    """Term weights per topic: term count in the topic times log(1 + A / f), A being the mean
    number of words per topic and f the count of the term in all topics."""
    rows = df if outlier is None else df.where(~F.col(topic).cast("string").eqNullSafe(str(outlier)))
    keys = [topic, *extra]
    tokens = rows.select(*keys, F.explode(tx.terms(F.col(text), stop_words)).alias("term"))
    counted = settle(tokens.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf")))
    mean = counted.groupBy(topic).agg(F.sum("tf").alias("w")).agg(F.avg("w")).first()[0] or 0.0
    total = settle(counted.groupBy("term").agg(F.sum("tf").alias("_f"), F.count(F.lit(1)).alias("_n")))
    weight = F.col("tf") * F.log(1 + F.lit(float(mean)) / F.col("_f"))
    return salted_join(counted, total.drop("_n"), ["term"], counts=total).select(*keys, "term", "tf", weight.alias("weight"))


def top_words(weights: DataFrame, keys: Sequence[str], n: int = 10) -> DataFrame:
    """The ``n`` heaviest terms per group; weights are rounded to nine places, ties by term."""
    rounded = weights.withColumn("weight", F.round("weight", 9))
    return top_per_group(rounded, list(keys), [F.desc("weight"), F.asc("term")], n)


def topic_table(df: DataFrame, topic: str, text: str, topics: int = 10, words: int = 10, **options) -> DataFrame:
    """The most frequent topics with their size and their top words in one text."""
    size = df.where(F.col(topic).cast("string") != "-1").groupBy(topic).agg(F.count(F.lit(1)).alias("size"))
    biggest = size.orderBy(F.desc("size"), topic).limit(topics)
    words_of = top_words(class_tf_idf(df, topic, text, **options), [topic], words)
    listed = words_of.groupBy(topic).agg(  # at most ``words`` rows per topic
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda p: p["term"]), "_").alias("words")
    )
    return biggest.join(listed, topic, "left")


def topics_over_time(df: DataFrame, topic: str, moment: str, text: str, bins: int = 20, words: int = 5, **options) -> DataFrame:
    """Frequency and top words of each topic in equal-width time bins: (topic, bin, start,
    frequency, words)."""
    micros = dates.millis_of(F.col(moment))
    low, high = df.agg(F.min(micros), F.max(micros)).first()
    binned = df.withColumn("bin", dates.equal_width_bin(micros, F.lit(low), F.lit(high), bins))
    frequency = binned.groupBy(topic, "bin").agg(F.count(F.lit(1)).alias("frequency"))
    heavy = top_words(class_tf_idf(binned, topic, text, extra=["bin"], **options), [topic, "bin"], words)
    listed = heavy.groupBy(topic, "bin").agg(  # at most ``words`` rows per topic and bin
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda p: p["term"]), ", ").alias("words")
    )
    start = F.timestamp_millis(F.lit(low) + F.floor(F.col("bin") * F.lit((high - low) / bins)).cast("long"))
    return frequency.join(listed, [topic, "bin"], "left").withColumn("start", start)


# -- clusters ----------------------------------------------------------------------------


def vectors_from_arrays(df: DataFrame, array: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(array)))


Clusterer = Estimator | Callable[[DataFrame], DataFrame]


def cluster(df: DataFrame, features: str = "features", clusterer: Clusterer | None = None, k: int = 20, seed: int = 42) -> DataFrame:
    """Add cluster_id by any Spark ML clusterer, k-means by default, or by a function that adds it."""
    if clusterer is not None and not isinstance(clusterer, Estimator):
        return clusterer(df)
    clusterer = clusterer or KMeans(k=k, seed=seed)
    clusterer = clusterer.copy().setFeaturesCol(features)
    return clusterer.fit(df).transform(df).withColumnRenamed(clusterer.getPredictionCol(), "cluster_id")


def kmeans_from(df: DataFrame, row_id: str, vector: str, starts: DataFrame, rounds: int = 10) -> DataFrame:
    """``df`` with cluster_id after Lloyd steps from stated centres (cluster_id, centre array).

    Squared distances are rounded to nine places and ties go to the smaller number; a centre without
    rows stays where it is. The centres, a few rows, are broadcast after measuring them.
    """
    rows = settle(df)
    centres = settle(starts.select("cluster_id", "centre"))

    def assigned():
        listed = centres.agg(F.array_sort(F.collect_list(F.struct("cluster_id", "centre"))).alias("_all"))  # one row
        near = F.transform("_all", lambda c: F.struct(
            F.round(F.aggregate(F.zip_with(vector, c["centre"], lambda x, m: (x.cast("double") - m) * (x.cast("double") - m)),
                                F.lit(0.0), lambda a, x: a + x), 9).alias("away"), c["cluster_id"].alias("id")))
        return rows.crossJoin(fit_broadcast(listed)).withColumn("cluster_id", F.array_min(near)["id"]).drop("_all")

    for _ in range(rounds):
        moved = assigned().groupBy("cluster_id").agg(vector_to_array(Summarizer.mean(array_to_vector(F.col(vector)))).alias("_m"))
        fresh = centres.join(moved, "cluster_id", "left").select(
            "cluster_id", F.coalesce("_m", "centre").alias("centre")
        )
        before, centres = centres, settle(fresh)
        release(before)
    return assigned()


def cluster_texts(
    df: DataFrame, row_id: str, columns: list[str], extractor: Callable[[DataFrame], DataFrame],
    clusterer: Callable[[DataFrame], DataFrame], joiner: str = "\n\n",
) -> DataFrame:
    """Merge text columns, extract features, cluster: ``df`` with cluster_id.

    ``extractor`` turns (doc, text) into feature rows that name their ``doc``, such as (doc, term, weight);
    ``clusterer`` turns those into (doc, cluster_id). Rows without features have no cluster.
    """
    merged = df.select(F.col(row_id).alias("doc"), tx.merge_columns(columns, joiner).alias("text"))
    found = clusterer(extractor(merged)).select(F.col("doc").alias(row_id), "cluster_id")
    return salted_join(df, found, [row_id], "left")


def refit(clustered: DataFrame, clusterer: Clusterer, features: str = "features") -> DataFrame:
    return cluster(clustered.drop("cluster_id"), features, clusterer)


def cluster_examples(clustered: DataFrame, array: str, row_id: str, n: int = 3) -> DataFrame:
    """Original columns of the ``n`` rows nearest to each cluster's mean."""
    return nearest_to_centroid(clustered, "cluster_id", array, row_id, n)


def project(df: DataFrame, row_id: str, vector: str, k: int = 2, rounds: int = 30, start: Callable = axes.hashed_start) -> DataFrame:
    """(row id, projection): coordinates on the first ``k`` principal axes of a column of vectors."""
    cells = settle(axes.vector_cells(df, row_id, vector))
    found = settle(axes.principal_axes(cells, k, rounds, start=start))
    return axes.scores(cells, found).select(F.col("row").alias(row_id), F.col("point").alias("projection"))


def sweep(df: DataFrame, row_id: str, vector: str, starts: DataFrame, rounds: int = 10) -> DataFrame:
    """(params, value): the size of the largest cluster for every set of starting centres (params, cluster_id, centre).

    All sets are stepped together: one pass over the rows per round assigns every row to the nearest centre
    of each set, and the centres of all sets move at once, so the jobs do not grow with the sets. The
    centres, a few rows per set, are one row of every pass.
    """
    rows = settle(df.select(row_id, F.col(vector).alias("_v")))
    centres = settle(starts.select("params", "cluster_id", "centre"))

    def assigned():
        each = centres.groupBy("params").agg(F.array_sort(F.collect_list(F.struct("cluster_id", "centre"))).alias("all"))
        listed = each.agg(F.collect_list(F.struct("params", "all")).alias("_sets"))  # one row
        away = lambda c: F.round(F.aggregate(
            F.zip_with("_v", c["centre"], lambda x, m: (x.cast("double") - m) * (x.cast("double") - m)), F.lit(0.0), lambda a, x: a + x), 9)
        best = lambda s: F.struct(s["params"].alias("params"), F.array_min(
            F.transform(s["all"], lambda c: F.struct(away(c).alias("away"), c["cluster_id"].alias("id"))))["id"].alias("cluster_id"))
        return rows.crossJoin(fit_broadcast(listed)).select("_v", F.inline(F.transform("_sets", best)))

    for _ in range(rounds):
        moved = assigned().groupBy("params", "cluster_id").agg(vector_to_array(Summarizer.mean(array_to_vector(F.col("_v")))).alias("_m"))
        fresh = centres.join(moved, ["params", "cluster_id"], "left").select(
            "params", "cluster_id", F.coalesce("_m", "centre").alias("centre")
        )
        before, centres = centres, settle(fresh)
        release(before)
    sizes = assigned().groupBy("params", "cluster_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("params").agg(F.max("n").alias("value")).orderBy("value", "params")


def encode(df: DataFrame, text: str, encoder: Callable[[list[str]], np.ndarray], out: str = "embedding", batch: int = 64) -> DataFrame:
    """Vectors from an injected batch encoder, inside Arrow batches."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches):
        for frame in batches:
            texts, found = frame[text].tolist(), []
            for i in range(0, len(texts), batch):
                found.extend(np.asarray(encoder(texts[i : i + batch]), dtype=np.float64))
            yield frame.assign(**{out: found})

    return df.mapInPandas(run, f"{schema}, `{out}` array<double>")


def score(df: DataFrame, text: str, labels: Sequence[str], scorer: Callable[[list[str]], np.ndarray], batch: int = 64) -> DataFrame:
    """One score column per label from an injected batch scorer."""
    scored = encode(df, text, scorer, "_scores", batch)
    return scored.select(*df.columns, *[F.col("_scores")[i].alias(label) for i, label in enumerate(labels)])


# -- diversity ---------------------------------------------------------------------------


def distinct_draws(key: Column, size: Column, total: Column) -> Column:
    """``size`` different numbers from 0 to ``total`` - 1, as an array in drawing order.

    The i-th draw picks a rank among the numbers not drawn yet, by the first twelve hex digits of the
    MD5 of ``key:i``, and is moved past the drawn ones before it. No draw is repeated or lost.
    """
    def step(drawn: Column, i: Column) -> Column:
        digits = F.substring(F.md5(F.concat(key, F.lit(":"), i.cast("string"))), 1, 12)
        rank = F.conv(digits, 16, 10).cast("long") % (total - i)
        return F.array_append(drawn, F.aggregate(F.array_sort(drawn), rank, lambda x, d: x + F.when(d <= x, 1).otherwise(0)))

    none = F.array().cast("array<bigint>")
    return F.aggregate(F.sequence(F.lit(0).cast("long"), (size - 1).cast("long")), none, step)


def sample_diversity(df: DataFrame, row_id: str, vector: str, sizes: Sequence[int] = tuple(range(1, 11)), trials: int = 100, seed: int = 42) -> DataFrame:
    """Mean determinant of the cosine matrix of random samples, per sample size.

    A trial draws different rows, as many as its size, so a group never holds more than the sample;
    sizes beyond the table have no sample and no row.
    """
    placed = settle(running(df.select(row_id, vector), [], [row_id], position="n"))
    total = placed.count()
    plan = df.sparkSession.range(trials).select(
        F.col("id").alias("trial"), F.explode(F.array(*[F.lit(int(s)) for s in sizes if s <= total])).alias("size")
    )
    key = F.concat_ws(":", F.lit(str(seed)), F.col("size").cast("string"), F.col("trial").cast("string"))
    picked = plan.select("trial", "size", F.explode(distinct_draws(key, F.col("size"), F.lit(total).cast("long"))).alias("_at"))
    rows = salted_join(picked.select("trial", "size", (F.col("_at") + 1).alias("n")), placed, ["n"])

    def determinant(key, frame):
        m = np.stack(frame[vector].to_numpy()).astype(np.float64)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        sign, log = np.linalg.slogdet(m @ m.T)
        return pd.DataFrame({"size": [key[0]], "trial": [key[1]], "value": [float(sign * math.exp(log))]})

    per_trial = rows.groupBy("size", "trial").applyInPandas(determinant, "size int, trial long, value double")
    return per_trial.groupBy("size").agg(F.avg("value").alias("determinant"), F.count(F.lit(1)).alias("trials"))


def diverse_selection(df: DataFrame, group: str, row_id: str, vector: str, relevance: str, n: int = 10, diversity: float = 0.3) -> DataFrame:
    """Maximal marginal relevance per group over all its rows: (group, id, place).

    Each place goes to the row with the largest (1 - diversity) * relevance - diversity * nearest
    chosen cosine, rounded to nine places; ties go to the more relevant row, then the smaller id. One
    pass over the rows per place keeps the nearest cosine of each as a column.
    """
    rows = settle(df.select(
        F.col(group).alias("group"), F.col(row_id).alias("id"), F.col(vector).alias("vec"),
        F.col(relevance).cast("double").alias("worth"), F.lit(-1.0).alias("near"),
    ))
    picked = []
    for place in range(1, n + 1):
        gain = F.col("worth") if place == 1 else (1 - diversity) * F.col("worth") - diversity * F.col("near")
        order = [F.round(-gain, 9), -F.col("worth"), F.col("id")]
        chosen = settle(best_per_group(rows.select("group", "id", "vec", "worth", "near"), ["group"], order))
        picked.append(chosen.select("group", "id", F.lit(place).alias("place")))
        if place == n:
            break
        mate = chosen.select("group", F.col("id").alias("_id"), F.col("vec").alias("_vec"))
        near = F.greatest("near", vectors.cosine(F.col("vec"), F.col("_vec")))
        before = rows
        rows = settle(salted_join(rows, mate, ["group"]).where(F.col("id") != F.col("_id")).select("group", "id", "vec", "worth", near.alias("near")))
        release(before)
    out = picked[0]
    for part in picked[1:]:
        out = out.unionByName(part)
    return out.select(F.col("group").alias(group), F.col("id").alias(row_id), "place")


# -- corpus comparison -------------------------------------------------------------------


def share_gaps(counts: DataFrame, side: str, feature: str, sizes: dict[str, int], relative: bool = False,
               least: float = 0.0, most: float = 1.0) -> DataFrame:
    """How much more often documents of the first side have a feature than those of the second.

    ``counts`` has a row (side, feature, n) for the documents of a side that have the feature; ``sizes``
    maps the two sides to their numbers of documents. Returns (feature, share_a, share_b, gap). Features rarer than
    ``least`` on a side or more common than ``most`` show -1 on both. ``relative`` divides by the larger share.
    """
    (a, n_a), (b, n_b) = sizes.items()
    share = lambda name, n: F.sum(F.when(F.col(side) == name, F.col("n")).otherwise(0)) / F.lit(n)
    both = counts.groupBy(feature).agg(share(a, n_a).alias("a"), share(b, n_b).alias("b"))
    outside = (F.least("a", "b") < least) | (F.greatest("a", "b") > most)
    both = both.select(feature, *[F.when(outside, -1.0).otherwise(F.col(c)).alias(f"share_{c}") for c in "ab"])
    gap = F.col("share_a") - F.col("share_b")
    if relative:
        top = F.greatest("share_a", "share_b")
        top = F.when(top == 0, 1.0).otherwise(top)
        gap = F.col("share_a") / top - F.col("share_b") / top
    return both.withColumn("gap", gap)


def activation_counts(df: DataFrame, row_id: str, array: str) -> DataFrame:
    """Number of positive entries per row."""
    return df.select(row_id, F.size(F.filter(array, lambda x: x > 0)).alias("active"))


def features_by_peak(df: DataFrame, array: str) -> DataFrame:
    """(feature, peak): largest activation of every feature, strongest first."""
    cells = df.select(F.posexplode(array).alias("feature", "value"))
    return cells.groupBy("feature").agg(F.max("value").alias("peak")).orderBy(F.desc("peak"), "feature")


# -- user functions ----------------------------------------------------------------------


def group_apply(df: DataFrame, keys: Sequence[str], order: Sequence[str], fn: Callable[[pd.DataFrame], pd.DataFrame],
                schema: str, merge: dict[str, Column], rows_per_part: int = 100_000) -> DataFrame:
    """A partial pandas function over groups of any size, merged by aggregates.

    ``fn`` always gets an ordered part of a group, at most ``rows_per_part`` rows, and ``merge`` joins
    the parts, also where a group has only one: ``fn`` must be mergeable, as counts, sums, extremes
    and sketches are. Medians and fits need a mergeable form of their own.
    """
    placed = running(df, list(keys), list(order))
    part = F.floor((F.col("pos") - 1) / rows_per_part).alias("_part")
    parts = placed.withColumn("_part", part).groupBy(*keys, "_part").applyInPandas(fn, schema)
    return parts.groupBy(*keys).agg(*[c.alias(n) for n, c in merge.items()])


GroupFunction = Callable[[tuple, int, Iterable[pd.DataFrame]], Iterable[pd.DataFrame]]


def group_stream(df: DataFrame, keys: Sequence[str], order: Sequence[str], fn: GroupFunction, schema: str) -> DataFrame:
    """Any function over whole groups, each handed over as its rows in order, some thousand at a time.

    ``fn`` gets the key, the number of rows and an iterator of frames, and yields frames of ``schema``. It sees every
    row of its group however large that is, and holds what it keeps itself: a median needs the two middle
    rows. A group is read by one task from its sorted rows; ``group_apply`` spreads functions whose
    parts can be merged. Null keys are a group; a group whose frames are not read to their end is passed over.
    """
    keys = list(keys)
    rows = settle(df)
    sizes = settle(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")))
    names = [f"_key{i}" for i in range(len(keys))]
    same = F.lit(True)
    for k, n in zip(keys, names):
        same = same & F.col(k).eqNullSafe(F.col(n))
    sized = rows.join(fit_broadcast(sizes.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], "_rows")), same).drop(*names)
    placed = sized.repartition(*keys).sortWithinPartitions(*keys, *order)

    def pieces(batches):
        for frame in batches:
            if len(frame):
                change = np.zeros(len(frame), bool)
                for k in keys:
                    now, past = frame[k], frame[k].shift()
                    change |= ((now != past) & ~(now.isna() & past.isna())).to_numpy()
                change[0] = False
                cuts = [0, *np.flatnonzero(change).tolist(), len(frame)]
                for a, b in zip(cuts[:-1], cuts[1:]):
                    part = frame.iloc[a:b]
                    yield tuple(None if pd.isna(x) else x for x in part[keys].iloc[0]), part

    def run(batches):
        for key, group in groupby(pieces(batches), key=lambda piece: piece[0]):
            _, first = next(group)
            size = int(first["_rows"].iloc[0])
            yield from fn(key, size, (f.drop(columns="_rows") for f in chain([first], (part for _, part in group))))

    return placed.mapInPandas(run, schema)


def map_column(df: DataFrame, column: str, fn: Callable[[pd.Series], pd.Series], kind: str, out: str) -> DataFrame:
    """A vectorised user function over one column, for what no built-in expresses."""
    return df.withColumn(out, F.pandas_udf(fn, kind)(F.col(column)))

