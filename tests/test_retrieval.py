"""Retrieval, metrics, features and similarity against plain Python."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import evaluation, features, frames, retrieval, similarity

DOCS = ["the cat sat on the mat", "a dog and a cat", "dogs run far far away", "cat cat cat", "", "nothing here"]
ASKS = ["cat", "far dog", "zebra", ""]


def texts(spark, items, name="id"):
    return spark.createDataFrame(list(enumerate(items)), f"{name} long, text string")


def plain_bm25(docs, ask, k1=1.2, b=0.75):
    toks = [[w for w in d.split() if w not in tx.STOP_WORDS] for d in docs]
    mean = sum(map(len, toks)) / len(toks)
    out = {}
    for i, t in enumerate(toks):
        total = 0.0
        for w in (w for w in ask.split() if w not in tx.STOP_WORDS):
            df = sum(w in u for u in toks)
            tf = t.count(w)
            if tf:
                total += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(t) / mean))
        if total:
            out[i] = round(total, 6)
    return out


@pytest.mark.parametrize("vocabulary", [20_000, 0], ids=["filtered", "all tokens"])
def test_bm25(spark, monkeypatch, vocabulary):
    monkeypatch.setattr(retrieval, "VOCABULARY", vocabulary)
    got = {}
    for r in retrieval.bm25_scores(texts(spark, DOCS), texts(spark, ASKS, "q"), "id", "text", "q", "text").collect():
        got.setdefault(r["query"], {})[r["doc"]] = r["score"]
    assert got == {i: s for i, a in enumerate(ASKS) if (s := plain_bm25(DOCS, a))}


def vectors(spark, n, dim=6, seed=0):
    rng = np.random.default_rng(seed)
    data = rng.normal(size=(n, dim))
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "id long, vec array<double>"), data


@pytest.mark.parametrize("broadcast_values", [4_000_000, 1], ids=["broadcast", "blocks"])
def test_dense_top_k_both_ways(spark, broadcast_values):
    docs, d = vectors(spark, 120)
    asks, q = vectors(spark, 9, seed=1)
    got = {}
    rows = similarity.top_k(asks, docs, "id", "vec", "id", "vec", 5, block_rows=16, broadcast_values=broadcast_values)
    for r in rows.collect():
        got.setdefault(r["query"], {})[r["rank"]] = r["row"]
    cos = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (d / np.linalg.norm(d, axis=1, keepdims=True)).T
    for i in range(9):
        assert [got[i][k] for k in range(1, 6)] == list(np.argsort(-cos[i])[:5])


def test_cosine_rows_and_coherence_in_blocks(spark):
    docs, d = vectors(spark, 70)
    u = d / np.linalg.norm(d, axis=1, keepdims=True)
    full = u @ u.T
    np.fill_diagonal(full, 0)
    near = full.copy()
    np.fill_diagonal(near, -2)
    for r in similarity.cosine_rows(docs, "id", "vec").collect():
        assert r["others"] == 69 and abs(r["nearest"] - near[r["id"]].max()) < 1e-9
        assert abs(r["mean"] - full[r["id"]].sum() / 69) < 1e-9
    got = {r["statistic"]: r["value"] for r in similarity.coherence(docs, "id", "vec", (0.25, 0.8)).collect()}
    flat = full.reshape(-1)
    want = {"count": len(flat), "mean": flat.mean(), "std": flat.std(ddof=1), "min": flat.min(), "max": flat.max(),
            "q0.25": np.quantile(flat, 0.25), "q0.80": np.quantile(flat, 0.8)}
    assert all(abs(got[k] - v) < 1e-6 for k, v in want.items())


def test_text_ids_in_vector_work(spark):
    docs, _ = vectors(spark, 60)
    named = docs.withColumn("id", F.concat(F.lit("n"), F.lpad(F.col("id").cast("string"), 3, "0")))
    strip = lambda rows: sorted((int(r["query"][1:]), int(r["doc"][1:]), r["rank"]) for r in rows)
    plain = sorted((r["query"], r["doc"], r["rank"]) for r in retrieval.dense(docs, docs, "id", "vec", "id", "vec", 3).collect())
    assert strip(retrieval.dense(named, named, "id", "vec", "id", "vec", 3).collect()) == plain
    a = {r["id"]: r["nearest"] for r in similarity.cosine_rows(docs, "id", "vec").collect()}
    b = {int(r["id"][1:]): r["nearest"] for r in similarity.cosine_rows(named, "id", "vec").collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)
    assert similarity.coherence(named, "id", "vec").count() == 9


def test_postings_past_the_vocabulary(spark, monkeypatch):
    """Joined terms give the scores that listed terms give."""
    docs = texts(spark, ["red apple pie", "apple apple tree", "blue sky", "a red sky at night"], "doc")
    asks = texts(spark, ["red apple", "sky", "nothing here"], "q")
    run = lambda: sorted(map(tuple, retrieval.bm25_scores(docs, asks, "doc", "text", "q", "text").collect()))
    listed = run()
    monkeypatch.setattr(retrieval, "VOCABULARY", 1)
    assert run() == listed and listed


def test_approximate_results_are_mostly_exact(spark):
    docs, _ = vectors(spark, 400, dim=16)
    asks, _ = vectors(spark, 40, dim=16, seed=1)
    exact = retrieval.dense(docs, asks, "id", "vec", "id", "vec", 5)
    found, _ = retrieval.dense_approximate(docs, asks, "id", "vec", "id", "vec", 5, lists=20, bits=256, near=4)
    assert retrieval.recall(found, exact).agg(F.avg("recall")).first()[0] >= 0.9
    every, compared = retrieval.dense_approximate(docs, asks, "id", "vec", "id", "vec", 5, lists=20, bits=64, near=4, miss=1e-12)
    assert {tuple(r) for r in every.collect()} == {tuple(r) for r in exact.select("query", "doc", "score", "rank").collect()}
    assert all(r["candidates"] <= 400 for r in compared.collect())


def test_far_lists_are_left_out_without_loss(spark, monkeypatch):
    """Tight groups: lists beyond the floor's bound are skipped, and parts of a list give what a whole list gives."""
    from textloom.operators import inverted

    rng = np.random.default_rng(7)
    means = np.eye(8)
    data = np.concatenate([m + 0.05 * rng.normal(size=(60, 8)) for m in means])
    docs = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "id long, vec array<double>")
    asks = docs.where("id % 40 = 0")
    exact = {tuple(r) for r in retrieval.dense(docs, asks, "id", "vec", "id", "vec", 4).select("query", "doc", "score", "rank").collect()}
    for values, least in ((inverted.PART_VALUES, 256), (1, 16)):
        monkeypatch.setattr(inverted, "PART_VALUES", values)
        monkeypatch.setattr(inverted, "PART_ROWS", least)
        found, compared = retrieval.dense_approximate(docs, asks, "id", "vec", "id", "vec", 4, lists=64, bits=256, near=4, miss=1e-9)
        assert {tuple(r) for r in found.collect()} == exact
        assert max(r["candidates"] for r in compared.collect()) <= 60 + 8


def test_registered_approximate_search_reaches_its_recall(spark):
    import __spark_entry__

    rows = __spark_entry__.queries()["R03_dense_approximate"](spark, "/root/testdata/sf0.1").collect()
    recalls = {r["query"]: r["recall"] for r in rows}
    assert len(recalls) == 200 and sum(recalls.values()) / 200 >= 0.95 and min(recalls.values()) >= 0.7
    assert sum(r["candidates"] for r in rows) / len(rows) < 0.2


def test_approximate_search_of_nothing(spark):
    docs, _ = vectors(spark, 20)
    for corpus, asks in ((docs.limit(0), docs), (docs, docs.limit(0))):
        found, compared = retrieval.dense_approximate(corpus, asks, "id", "vec", "id", "vec", 3)
        assert found.count() == 0 and compared.count() == 0


def test_candidate_cosines_both_ways(spark, monkeypatch):
    docs, d = vectors(spark, 30)
    asks, q = vectors(spark, 4, seed=1)
    held = docs.select((F.col("id") % 10).alias("doc"), F.col("vec").alias("vector"))
    pairs = spark.createDataFrame([(a, b) for a in range(4) for b in range(10) if (a + b) % 3] + [(0, 1), (9, 1), (1, 99)], "query long, doc long")
    asked = asks.select(F.col("id").alias("query"), F.col("vec").alias("vector"))
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    cosines = np.round(unit(q) @ unit(d).T, 6)
    want = sorted((a, b, float(cosines[a, i])) for a in range(4) for b in range(10) if (a + b) % 3 or (a, b) == (0, 1) for i in range(b, 30, 10))
    for most in (retrieval.QUERY_VALUES, 0):
        monkeypatch.setattr(retrieval, "QUERY_VALUES", most)
        got = sorted(map(tuple, retrieval.candidate_cosines(pairs, held, asked).collect()))
        assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want])
    assert retrieval.candidate_cosines(pairs, held, asked.limit(0)).count() == 0


def test_chunks_of_whole_documents_are_searched(spark):
    from hashlib import sha1

    import __spark_entry__
    from textloom.operators.chunks import _chunks
    from textloom.plans.retrieval_plans import letter_profile

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    held = {}
    for d in docs:
        for c in _chunks(d["text"], 1024, 0):
            held[sha1(f"d{d['doc_id']}/{c['chunk']}".encode()).hexdigest()] = (c["chunk"], d["doc_id"] % 50 == 0)
    ids, units = list(held), letter_profile([c for c, _ in held.values()])
    units /= np.linalg.norm(units, axis=1)[:, None]
    row = {x: i for i, x in enumerate(ids)}
    got = __spark_entry__.queries()["R02_chunk_search_whole"](spark, "/root/testdata/sf0.001").collect()
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r["query"], []).append(r)
    assert len(held) > len(docs) and found.keys() == {x for x, (_, asked) in held.items() if asked}
    for query, rows in found.items():
        cosines = units @ units[row[query]]
        assert np.allclose([r["score"] for r in rows], np.sort(cosines)[::-1][:10], atol=2e-6)
        assert np.allclose([r["score"] for r in rows], [cosines[row[r["doc"]]] for r in rows], atol=2e-6)
        assert len({r["doc"] for r in rows}) == 10


def test_grouped_takes_the_best_of_each_group_and_drops_unknown(spark):
    run = spark.createDataFrame([(1, 1, 5.0), (1, 2, 4.0), (1, 3, 3.0), (1, 4, 9.0), (1, 5, 1.0)], "query long, doc long, score double")
    groups = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (5, "c")], "id long, g string")
    got = [(r["group"], r["doc"], r["rank"]) for r in retrieval.grouped(run, groups, "id", "g", 4, 10).orderBy("rank").collect()]
    assert got == [("a", 1, 1), ("b", 3, 2)]


def test_fusion_of_one_sided_results(spark):
    schema = "query long, doc long, score double"
    sparse = spark.createDataFrame([(1, 1, 4.0), (1, 2, 2.0)], schema)
    dense = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.9)], schema)
    got = {r["doc"]: r["score"] for r in retrieval.fuse(sparse, dense, 0.5).collect()}
    assert got == {1: 0.5, 2: 0.5, 3: 0.5}


def test_hybrid_sum_drops_scores_below_zero(spark):
    schema = "query long, doc long, score double"
    empty = spark.createDataFrame([], schema)
    cosines = spark.createDataFrame([(1, 1, -0.5), (1, 1, 0.25), (1, 2, -0.1)], schema)
    assert [(r["doc"], r["score"]) for r in retrieval.hybrid_sum(empty, empty, cosines).collect()] == [(1, 0.25)]


def test_fuzzy_terms_against_all_pairs(spark):
    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) <= 1
        short, long = sorted((a, b), key=len)
        return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))

    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(1, 5))) for _ in range(60)})
    table = spark.createDataFrame([(w,) for w in words], "term string")
    got = {tuple(r) for r in retrieval.fuzzy_terms(table, table).collect()}
    assert got == {(a, b) for a in words for b in words if near(a, b)}


def plain_tau(x, y):
    con = dis = tx_ = ty = 0
    for (a, b), (c, d) in itertools.combinations(zip(x, y), 2):
        s = (a > c) - (a < c), (b > d) - (b < d)
        con += s[0] * s[1] > 0
        dis += s[0] * s[1] < 0
        tx_ += s[0] == 0
        ty += s[1] == 0
    n = len(x) * (len(x) - 1) / 2
    return (con - dis) / math.sqrt((n - tx_) * (n - ty))


def test_kendall_per_group_and_over_all(spark):
    rng = random.Random(4)
    data = [(rng.choice("aab"), rng.randrange(300), rng.randrange(40) / 3) for _ in range(300)]
    df = spark.createDataFrame(data, "k string, x int, y double")
    for r in evaluation.kendall_tau(df, ["k"], "x", "y").collect():
        part = [(x, y) for k, x, y in data if k == r["k"]]
        assert abs(r["tau"] - plain_tau(*zip(*part))) < 1e-9
    whole = evaluation.kendall_tau(df, [], "y", "x").first()["tau"]
    assert abs(whole - plain_tau([y for _, _, y in data], [x for _, x, _ in data])) < 1e-9
    constant = evaluation.kendall_tau(df.withColumn("x", F.lit(1)), [], "x", "y").first()["tau"]
    assert constant is None


def test_hits_rules_and_empty_results(spark):
    results = spark.createDataFrame([("q1", 1, ["machine translation"]), ("q1", 2, ["translation", "x"]), ("q1", 11, ["translation"])],
                                    "query string, rank int, true_labels array<string>")
    queries = spark.createDataFrame([("q1", "translation"), ("q2", "z")], "query string, query_label string")
    got = {r["query"]: (r["hits_at_10"], r["accuracy_at_10"]) for r in evaluation.hits_at_k(results, queries).collect()}
    assert got == {"q1": (1, 1), "q2": (0, 0)}
    loose = evaluation.hits_at_k(results, queries, 10, "substring").where("query = 'q1'").first()
    assert loose["hits_at_10"] == 2


def test_map_and_ndcg_by_hand(spark):
    run = spark.createDataFrame([(1, 10, 3.0), (1, 11, 2.0), (1, 12, 1.0), (3, 1, 1.0)], "query long, doc long, score double")
    qrels = spark.createDataFrame([(1, 10, 1), (1, 12, 2), (1, 99, 1), (1, 11, 0), (2, 5, 1)], "query long, doc long, rel int")
    got = {r["query"]: (r["map"], r["ndcg"]) for r in evaluation.rank_metrics(run, qrels).collect()}
    ideal = 2 + 1 / math.log2(3) + 0.5
    assert got[2] == (0.0, 0.0) and 3 not in got
    assert abs(got[1][0] - (1 + 2 / 3) / 3) < 1e-9 and abs(got[1][1] - (1 + 2 / 2) / ideal) < 1e-9


def test_moving_average_and_ranks_on_a_hot_series(spark):
    data = [("s", i, float((i * 7) % 13)) for i in range(700)] + [("t", 1, 5.0)]
    df = spark.createDataFrame(data, "k string, i long, v double")
    got = {(r["k"], r["i"]): r["sma"] for r in frames.moving_average(df, ["k"], ["i"], "v", 250).collect()}
    v = [x[2] for x in data[:700]]
    for i in (0, 248, 249, 500, 699):
        want = None if i < 249 else sum(v[i - 249 : i + 1]) / 250
        assert got["s", i] == want or abs(got["s", i] - want) < 1e-9
    assert got["t", 1] is None
    ranked = {(r["k"], r["i"]): r["rank"] for r in frames.ranks(df, ["k"], "v", "i").collect()}
    assert all(ranked["s", i] == 1 + sum(x < v[i] for x in v) for i in (0, 5, 699))


def test_describe_and_overlap(spark):
    df = spark.createDataFrame([(i, float(i * i)) for i in range(11)], "i long, v double")
    got = {r["statistic"]: r["value"] for r in frames.describe(df, "v", "i", (0.25, 0.95)).collect()}
    v = np.arange(11) ** 2
    assert got["q0.25"] == np.quantile(v, 0.25) and abs(got["q0.95"] - np.quantile(v, 0.95)) < 1e-9
    assert got["count"] == 11 and abs(got["std"] - v.std(ddof=1)) < 1e-9
    left = spark.createDataFrame([(1,), (2,), (2,), (3,)], "k int")
    right = spark.createDataFrame([(3,), (4,)], "k int")
    r = frames.overlap(left, right, "k").first()
    assert (r["common"], r["share_left"], r["share_right"]) == (1, 1 / 3, 0.5)


def test_nmf_equals_dense_updates_and_lowers_the_error(spark):
    rng = np.random.default_rng(5)
    v = rng.random((8, 6)) * (rng.random((8, 6)) < 0.6)
    v[0, :] += 0.01
    v[:, 0] += 0.01
    rows = [(i, f"t{j}", float(v[i, j])) for i in range(8) for j in range(6) if v[i, j] > 0]
    table = spark.createDataFrame(rows, "doc long, term string, weight double")
    start = lambda key, i: 0.2 + F.pmod(F.ascii(F.substring(key.cast("string"), -1, 1)) * (i + 2), F.lit(7)) / 7.0

    def dense(rounds):
        w = np.array([[0.2 + (ord(str(i)[-1]) * (k + 2)) % 7 / 7 for k in range(2)] for i in range(8)])
        h = np.array([[0.2 + (ord(f"t{j}"[-1]) * (k + 2)) % 7 / 7 for k in range(2)] for j in range(6)])
        for _ in range(rounds):
            h = h * (v.T @ w) / (h @ (w.T @ w) + 1e-12)
            w = w * (v @ h) / (w @ (h.T @ h) + 1e-12)
        return w, h

    docs, _ = features.nmf(table, 2, rounds=3, start=start)
    w, _ = dense(3)
    for r in docs.collect():
        assert np.allclose(r["factor"], w[r["doc"]])
    errors = [np.linalg.norm(v - w @ h.T) for w, h in (dense(1), dense(3), dense(10))]
    assert errors == sorted(errors, reverse=True)


def test_class_words_leave_out_the_outlier_topic(spark):
    df = spark.createDataFrame([(-1, "noise noise"), (0, "apple apple pear"), (1, "wheel pear")], "topic int, text string")
    got = {(r["topic"], r["term"]): r["weight"] for r in features.class_tf_idf(df, "topic", "text").collect()}
    assert set(got) == {(0, "apple"), (0, "pear"), (1, "wheel"), (1, "pear")}
    assert abs(got[0, "apple"] - 2 * math.log(1 + 2.5 / 2)) < 1e-9
    table = features.topic_table(df, "topic", "text", words=1).collect()
    assert {(r["topic"], r["words"]) for r in table} == {(0, "apple"), (1, "wheel")}


def test_share_gaps_masks_and_metrics(spark):
    counts = spark.createDataFrame([("a", "x", 2), ("a", "y", 1), ("b", "y", 1), ("b", "z", 2)], "side string, f string, n long")
    sizes = {"a": 2, "b": 2}
    got = {r["f"]: tuple(r)[1:] for r in features.share_gaps(counts, "side", "f", sizes).collect()}
    assert got == {"x": (1.0, 0.0, 1.0), "y": (0.5, 0.5, 0.0), "z": (0.0, 1.0, -1.0)}
    rel = {r["f"]: tuple(r)[1:] for r in features.share_gaps(counts, "side", "f", sizes, True, least=0.1).collect()}
    assert rel == {"x": (-1.0, -1.0, 0.0), "y": (0.5, 0.5, 0.0), "z": (-1.0, -1.0, 0.0)}


def test_diverse_selection_equals_the_greedy_rule(spark):
    _, v = vectors(spark, 25, 4, 3)
    rel = np.random.default_rng(1).random(25)
    df = spark.createDataFrame([("g", i, [float(x) for x in v[i]], float(rel[i])) for i in range(25)], "g string, id long, vec array<double>, r double")
    got = [r["id"] for r in features.diverse_selection(df, "g", "id", "vec", "r", 6, 0.3).orderBy("place").collect()]
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    left, chosen = set(range(25)), []
    while len(chosen) < 6:
        best = max(sorted(left), key=lambda i: rel[i] if not chosen else 0.7 * rel[i] - 0.3 * max(u[i] @ u[j] for j in chosen))
        chosen.append(best)
        left.remove(best)
    assert got == chosen


def test_sample_diversity_falls_with_size(spark):
    docs, _ = vectors(spark, 40)
    got = {r["size"]: (r["determinant"], r["trials"]) for r in features.sample_diversity(docs, "id", "vec", (1, 3, 5), 20).collect()}
    assert abs(got[1][0] - 1) < 1e-9 and got[1][0] > got[3][0] > got[5][0] > 0
    assert {n for _, n in got.values()} == {20}


def test_clusters_and_refit(spark):
    from pyspark.ml.clustering import BisectingKMeans

    docs, _ = vectors(spark, 60)
    rows = features.cluster(features.vectors_from_arrays(docs, "vec"), k=4)
    assert rows.count() == 60 and {r[0] for r in rows.select("cluster_id").distinct().collect()} <= set(range(4))
    again = features.refit(rows, BisectingKMeans(k=2, seed=1))
    assert {r[0] for r in again.select("cluster_id").distinct().collect()} == {0, 1}
    assert len(features.cluster_examples(rows.drop("features"), "vec", "id", 2).collect()) <= 8


def test_projection_finds_the_principal_axes(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(80, 5)) * [9.0, 3.0, 1.0, 0.5, 0.2] + [9, -4, 0, 1, 2]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "id long, vec array<double>")
    got = {r["id"]: r["projection"] for r in features.project(df, "id", "vec", 2, rounds=12).collect()}
    centred = data - data.mean(axis=0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    for k in range(2):
        axis = axes[k] * np.sign(axes[k][np.argmax(abs(axes[k]))])
        assert np.allclose([got[i][k] for i in range(80)], centred @ axis, atol=1e-5)


def test_all_parameter_sets_are_stepped_together(spark):
    docs, data = vectors(spark, 50, dim=3)
    starts = [(name, i, [float(x) for x in data[i]]) for name, k in (("a", 2), ("b", 5), ("c", 1)) for i in range(k)]
    table = spark.createDataFrame(starts, "params string, cluster_id int, centre array<double>")
    got = [(r["params"], r["value"]) for r in features.sweep(docs, "id", "vec", table, 4).collect()]
    want = {}
    for name, k in (("a", 2), ("b", 5), ("c", 1)):
        first = table.where(F.col("params") == name).select("cluster_id", "centre")
        alone = features.kmeans_from(docs, "id", "vec", first, 4).groupBy("cluster_id").count()
        want[name] = alone.agg(F.max("count")).first()[0]
    assert got == sorted(want.items(), key=lambda x: (x[1], x[0]))


def test_whole_groups_are_handed_over_in_order(spark):
    import pandas as pd

    data = [("hot", i * 7919 % 12_345) for i in range(12_345)] + [("b", 3), ("b", 1), (None, 2), (None, 5)]
    df = spark.createDataFrame(data, "k string, v long").repartition(5)

    def median(key, size, frames):
        at, middle, last = 0, [], -1
        for frame in frames:
            values = frame["v"].tolist()
            assert values == sorted(values) and values[0] >= last and list(frame.columns) == ["k", "v"]
            last = values[-1]
            middle += [values[p - at] for p in ((size - 1) // 2, size // 2) if at <= p < at + len(values)]
            at += len(values)
        assert at == size
        yield pd.DataFrame({"k": [key[0]], "n": [size], "median": [sum(middle) / 2]})

    got = {r["k"]: (r["n"], r["median"]) for r in features.group_stream(df, ["k"], ["v"], median, "k string, n long, median double").collect()}
    assert got == {"hot": (12_345, 6172.0), "b": (2, 2.0), None: (2, 3.5)}
    first = lambda key, size, frames: [next(iter(frames)).head(1)]
    assert features.group_stream(df, ["k"], ["v"], first, "k string, v long").count() == 3
    assert features.group_stream(df.limit(0), ["k"], ["v"], first, "k string, v long").count() == 0


def test_group_function_over_parts(spark):
    import pandas as pd

    df = spark.createDataFrame([("a", i) for i in range(95)] + [("b", 1)], "k string, i long")
    fn = lambda f: pd.DataFrame({"k": f["k"].iloc[:1], "n": [len(f)]})
    got = features.group_apply(df, ["k"], ["i"], fn, "k string, n long", {"n": F.sum("n"), "parts": F.count("*")}, rows_per_part=10)
    assert {tuple(r) for r in got.collect()} == {("a", 95, 10), ("b", 1, 1)}


def test_window_rerank_with_another_score(spark):
    found = texts(spark, ["One cat. Two dogs! Three birds? Four fish."], "doc").select("doc", tx.sentences(F.col("text")).alias("s"))
    rows = found.select(F.inline(tx.sentence_windows(F.col("s"), 1))).withColumn("doc", F.col("no").cast("long"))
    assert [r["window"] for r in rows.orderBy("no").collect()][1] == "One cat. Two dogs! Three birds?"
    asks = spark.createDataFrame([(1, "dogs birds")], "q long, text string")
    got = retrieval.window_rerank(rows, asks, "q", "text", score=F.length("window").cast("double")).orderBy("rank").collect()
    assert [r["doc"] for r in got] == [2, 1]


def test_nearest_rows_leaves_out_far_leaves():
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(40, 6))
    rows = np.concatenate([np.repeat(middles, 100, axis=0) + rng.normal(scale=0.02, size=(4000, 6)), np.zeros((3, 6)), np.tile(middles[:1], (900, 1))])
    sizes = np.linalg.norm(rows, axis=1, keepdims=True)
    units = rows / np.where(sizes > 0, sizes, 1.0)
    ids, asked = np.arange(len(units)), np.arange(0, len(units), 50)
    found, compared = similarity.nearest_rows(ids[asked], units[asked], ids, units, 7)
    scores = np.round(units[asked] @ units.T, 9)
    expected = {q: [(i, s[i]) for i in np.lexsort((ids, -s))[:7]] for q, s in zip(asked.tolist(), scores)}
    got = {q: list(zip(f["row"], f["score"])) for q, f in found.groupby("query")}
    assert got == expected
    assert compared < 0.2 * scores.size


def test_scores_of_whole_rows_and_shared_keys(spark, monkeypatch):
    """Documents that are one row are scored in it; keys of several rows, and null, are added up as postings."""
    items = [(1, "red apple pie"), (2, "apple apple tree"), (2, "apple tree"), (2, "a red red sky"), (None, "red sky"), (None, "sky"), (3, None), (4, "blue")]
    docs = spark.createDataFrame(items, "doc long, text string")
    asks = spark.createDataFrame([(1, "red apple red"), (None, "sky"), (3, "nothing here"), (4, "")], "q long, text string")
    asked = retrieval.query_terms(asks, "q", "text")
    _, whole, n, _ = retrieval.postings(docs, "doc", "text", asked)
    assert sorted(r["doc"] for r in whole.collect()) == [1, 3, 4] and n == 8
    order = lambda row: tuple((v is None, v or 0) for v in row)
    run = lambda: sorted(map(tuple, retrieval.bm25_scores(docs, asks, "doc", "text", "q", "text").collect()), key=order)
    rows = run()
    monkeypatch.setattr(retrieval, "VOCABULARY", 1)
    assert run() == rows and len(rows) == 5


@pytest.mark.parametrize("kind", ["long", "string"])
def test_cut_leaves_few_rows_to_sort(spark, monkeypatch, kind):
    monkeypatch.setattr(retrieval, "KEPT", 500)
    scores = spark.range(20_000).select(
        (F.col("id") % 3).alias("query"), F.col("id").cast(kind).alias("doc"), ((F.col("id") * 7919) % 50 / 10.0).alias("score")
    ).unionByName(spark.createDataFrame([(0, None, 9.0), (1, "5", None), (2, "7", float("nan"))], "query long, doc string, score double").withColumn("doc", F.col("doc").cast(kind))).coalesce(2)
    assert retrieval._first_cut(scores, 5).count() <= 2 * 15 + 3
    every = retrieval.top_per_group(scores, ["query"], [F.desc("score"), F.asc("doc")], 5)
    assert sorted(map(str, retrieval.cut(scores, 5).collect())) == sorted(map(str, every.collect()))


def test_many_queries_meet_only_cells_in_reach(spark, monkeypatch):
    """Cells of near rows find what all pairs do: with copies of a vector, zero vectors and queries that share an id."""
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(4000, 5)) * np.array([3, 2, 1, 1, 0.5]) + np.array([4, 0, 0, 0, 0])
    rows[1000:1900], rows[2500:2510] = rows[7], 0
    docs = spark.createDataFrame([(f"r{i:04d}", [float(x) for x in v]) for i, v in enumerate(rows)], "id string, vec array<double>").cache()
    asks = docs.where("id like '%3'").select(F.when(F.col("id") < "r0050", "many").otherwise(F.col("id")).alias("id"), "vec")
    sides = (asks, docs, "id", "vec", "id", "vec", 7)
    search = lambda **more: sorted(map(tuple, similarity.top_k(*sides, **more).collect()))
    want = search()
    assert len(want) == 7 * asks.select("id").distinct().count()
    assert search(block_rows=300, broadcast_values=1) == want
    monkeypatch.setattr(similarity, "ASK_VALUES", 500)  # queries in several parts
    assert search(block_rows=2000, broadcast_values=1) == want


def test_rows_below_a_floor_are_left_out():
    rng = np.random.default_rng(5)
    units = rng.normal(size=(3000, 4))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    ids, asked = np.arange(len(units)), np.arange(0, 3000, 100)
    scores = np.round(units[asked] @ units.T, 9)
    floors = np.sort(scores, axis=1)[:, -3]
    found, compared = similarity.nearest_rows(ids[asked], units[asked], ids, units, 9, floors)
    assert all(sorted(f["score"]) == sorted(np.sort(scores[ids[asked].tolist().index(q)])[-3:]) for q, f in found.groupby("query"))
    assert len(found) == 3 * len(asked) and compared < similarity.nearest_rows(ids[asked], units[asked], ids, units, 9)[1]


def test_letter_profile_counts_letters_of_any_text():
    from textloom.plans.retrieval_plans import letter_profile

    texts = ["", "Eat HERE", "éèß ſ İ ñ tt", "😀 enso\ud800", "K Å Ho"]
    want = [[1e-3] + [t.lower().count(v) / max(len(t), 1) for v in "etaonihsrl"] for t in texts]
    assert letter_profile(texts).tolist() == want and letter_profile([]).shape == (0, 11)


def test_chunk_borders_are_found_by_leaps(monkeypatch):
    """The same spans as cutting at every separator and joining, without a span for every word."""
    import random

    from textloom.operators import chunks

    draw, cuts = random.Random(4), []
    whole = chunks._cuts

    def slow(text, size, lo, hi, level):  # every piece of the text becomes a span
        fitting = []
        for a, b in whole(text, lo, hi, chunks.SEPARATORS[level]):
            if b - a < size:
                fitting.append((a, b))
                continue
            yield from chunks._pack(fitting, size, 0)
            fitting = []
            below = level + 1
            while below < 3 and text.find(chunks.SEPARATORS[below], a, b) == -1:
                below += 1
            yield from ((a, b),) if level == 3 else slow(text, size, a, b, below)
        yield from chunks._pack(fitting, size, 0)

    monkeypatch.setattr(chunks, "_cuts", lambda *a: cuts.append(a) or whole(*a))
    for _ in range(3000):
        text = "".join(draw.choice(draw.choice(["ab \n", "ab ", "abc", "a\n"])) for _ in range(draw.randrange(60))).replace("\n\n", "\n")
        size = draw.randrange(1, 14)
        level = 0
        while level < 3 and chunks.SEPARATORS[level] not in text:
            level += 1
        assert list(chunks.chunk_spans(text, size, 0)) == list(slow(text, size, 0, len(text), level)), (text, size)
    assert all(a[3] == "\n\n" for a in cuts)


@pytest.mark.parametrize("shape", ["even", "wide", "square corners", "copies", "two"])
def test_coherence_counts_every_pair_exactly(spark, shape):
    """Entries are placed in single precision, also where many lie on one value or next to the ends."""
    rng = np.random.default_rng(3)
    rows = {
        "even": rng.normal(size=(1300, 6)), "wide": rng.normal(size=(150, 300)), "square corners": np.tile(np.eye(5), (60, 1)),
        "copies": np.concatenate([np.zeros((20, 3)), np.tile([[1.0, 2, 3]], (200, 1)), rng.normal(size=(300, 3))]), "two": rng.normal(size=(2, 3)),
    }[shape]
    docs = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "id long, vec array<double>")
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    units = rows / np.where(size > 0, size, 1)
    full = units @ units.T
    np.fill_diagonal(full, 0)
    flat = full.reshape(-1)
    want = {"count": flat.size, "mean": flat.mean(), "std": flat.std(ddof=1), "min": flat.min(), "max": flat.max()}
    want |= {f"q{p:.2f}": np.quantile(flat, p) for p in (0.25, 0.5, 0.75, 0.95)}
    got = {r["statistic"]: r["value"] for r in similarity.coherence(docs, "id", "vec").collect()}
    assert all(abs(got[k] - v) < 1e-8 for k, v in want.items()), (got, want)
