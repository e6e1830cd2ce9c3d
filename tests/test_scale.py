"""Positions, frames, cuts and joins on inputs where one group holds most rows."""

import random

import pytest
from pyspark.sql import functions as F

from textloom import scale


@pytest.fixture(autouse=True)
def many_partitions(spark):
    """Keep shuffle partitions apart, so that a hot group really covers several."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def skewed(spark, n=3000):
    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(20)}", i, rng.randrange(5)) for i in range(n)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "k string, i long, v long"), sorted(data)


def test_running_positions_and_sums(spark):
    df, data = skewed(spark)
    got = rows(scale.running(df, ["k"], ["i"], sums={"s": "v"}), "k", "i", "pos", "s")
    want, seen = [], {}
    for k, i, v in data:
        n, s = seen.get(k, (0, 0))
        seen[k] = (n + 1, s + v)
        want.append((k, i, n + 1, s + v))
    assert got == want


def test_running_without_keys_and_with_null_keys(spark):
    df = spark.createDataFrame([(None, 3), ("a", 1), (None, 1)], "k string, i int")
    assert rows(scale.running(df, [], [F.col("i").desc(), F.col("k").asc_nulls_last()]), "i", "pos") == [(1, 2), (1, 3), (3, 1)]
    got = {(r["k"], r["i"]): r["pos"] for r in scale.running(df, ["k"], ["i"]).collect()}
    assert got == {(None, 1): 1, (None, 3): 2, ("a", 1): 1}


def test_running_covers_many_partitions(spark):
    df, _ = skewed(spark, 5000)
    laid = df.repartitionByRange("k", "i").select(F.spark_partition_id().alias("p"), "k").where("k = 'hot'")
    assert laid.select("p").distinct().count() > 1


def test_neighbourhood_equals_plain_window(spark):
    df, data = skewed(spark, 600)
    placed = scale.running(df, ["k"], ["i"])
    got = rows(scale.neighbourhood(placed, ["k"], "pos", 3, 2, {"s": F.sum("v"), "n": F.count("*")}, block=7), "k", "i", "s", "n")
    groups, want = {}, []
    for k, i, v in data:
        groups.setdefault(k, []).append((i, v))
    for k, items in groups.items():
        for j, (i, _) in enumerate(items):
            near = [v for _, v in items[max(0, j - 3) : j + 3]]
            want.append((k, i, sum(near), len(near)))
    assert got == sorted(want)


def test_top_per_group_past_the_limit_threshold(spark):
    df, data = skewed(spark)
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "10")
    try:
        got = rows(scale.top_per_group(df, ["k"], [F.desc("v"), F.asc("i")], 25), "k", "i", "rank")
    finally:
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "1000")
    want, groups = [], {}
    for k, i, v in data:
        groups.setdefault(k, []).append((-v, i))
    for k, items in groups.items():
        want += [(k, i, r + 1) for r, (_, i) in enumerate(sorted(items)[:25])]
    assert got == sorted(want)


def test_top_per_group_cuts_before_the_shuffle(spark):
    df, _ = skewed(spark, 100)
    plan = scale.top_per_group(df, ["k"], [F.desc("v"), F.asc("i")], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_best_per_group(spark):
    df, data = skewed(spark, 500)
    want = {}
    for k, i, v in data:
        want[k] = min(want.get(k, (9, 0)), (v, i))
    got = {r["k"]: (r["v"], r["i"]) for r in scale.best_per_group(df, ["k"], [F.col("v"), F.col("i")]).collect()}
    assert got == want


def test_salted_join_equals_plain_join_for_every_kind(spark):
    df, _ = skewed(spark, 800)
    small = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), ("other", 4)], "k string, w int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        salted = scale.Salted(df, ["k"], rows_per_task=50, broadcast_rows=0)
        got = salted.join(small, how)
        want = df.join(small, ["k"], how)
        assert salted.heavy.where("k = 'hot'").first()["_salts"] > 5
        assert rows(got, *want.columns) == rows(want, *want.columns) if how not in ("left",) else got.count() == want.count()
        assert rows(got, "k", "i") == rows(want, "k", "i")


def test_fits_counts_rows_and_bytes(spark):
    df = spark.range(10).select("id", F.repeat(F.lit("x"), 1000).alias("t"), F.array(F.lit(1.0)).alias("a"))
    assert scale.fits(df) and not scale.fits(df, rows=9) and not scale.fits(df, size=5000)


@pytest.mark.parametrize("n", [10, 10_000])
def test_concat_parts_keeps_everything(spark, n):
    """The same shape and contract for short and long groups: parts by bytes, in order."""
    rows = [("hot", i, str(i)) for i in range(n)] + [("one", 0, "x" * 500), (None, 1, "a"), (None, 2, "b")]
    df = spark.createDataFrame(rows, "k string, i long, t string").repartition(5)
    parts = scale.concat_parts(df, ["k"], ["i"], "t", ",", part_bytes=200).collect()
    whole = {}
    for r in sorted(parts, key=lambda r: (str(r["k"]), r["part"])):
        whole.setdefault(r["k"], []).append(r["t"])
    assert {k: ",".join(v) for k, v in whole.items()} == {"hot": ",".join(str(i) for i in range(n)), "one": "x" * 500, None: "a,b"}
    assert all(len(t) <= 210 for t in whole["hot"]) and len(whole["one"]) == 1
    assert len(scale.concat_parts(df, ["k"], ["i"], "t", ",").collect()) == 3


def test_top_per_group_in_stages(spark, monkeypatch):
    """Two cuts give what one gives, and no bucket passes on more than k rows of a key."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(scale, "MERGE_ROWS", 10)
    df = spark.range(3000).select((F.col("id") % 2).alias("k"), F.xxhash64("id").alias("v"), "id").repartition(12)
    got = scale.top_per_group(df, ["k"], [F.asc("v"), F.asc("id")], 7)
    want = {}
    for r in df.collect():
        want.setdefault(r["k"], []).append((r["v"], r["id"]))
    for k, v in want.items():
        assert [(r["v"], r["id"]) for r in got.where(F.col("k") == k).orderBy("rank").collect()] == sorted(v)[:7]
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_exact_quantiles(spark):
    import numpy as np

    df, data = skewed(spark, 400)
    got = {(r["k"], r["q"]): r["quantile"] for r in scale.exact_quantiles(df, ["k"], "v", "i", [0.05, 0.5, 0.9]).collect()}
    groups = {}
    for k, _, v in data:
        groups.setdefault(k, []).append(v)
    for (k, q), value in got.items():
        assert abs(value - np.quantile(groups[k], q)) < 1e-9
    assert len(got) == 3 * len(groups)


def test_results_do_not_depend_on_row_order(spark):
    df, _ = skewed(spark, 400)
    one = rows(scale.running(df, ["k"], ["v", "i"], sums={"s": "v"}), "k", "i", "pos", "s")
    two = rows(scale.running(df.orderBy(F.rand(5)).repartition(7), ["k"], ["v", "i"], sums={"s": "v"}), "k", "i", "pos", "s")
    assert one == two


def test_scratch_folder_comes_from_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert scale.scratch_path(spark).startswith(base.rstrip("/"))


def test_tables_measured_as_large_are_not_broadcast(spark):
    """200,000 rows that take little room in files, whose size is what the optimizer goes by."""
    small = scale.settle(spark.range(200_000).withColumn("v", F.lit(1)))
    big = scale.settle(spark.range(300_000))
    for joined in (scale.salted_join(big, small, ["id"]), big.join(scale.fit_broadcast(small), "id")):
        assert joined.count() == 200_000
        assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    few = scale.salted_join(big, small.limit(10), ["id"])
    assert "Broadcast" in few._jdf.queryExecution().executedPlan().toString()
    placed = scale.running(big.withColumn("k", F.col("id") % 150_000), ["k"], ["id"])
    assert placed.where("pos = 2").count() == 150_000
    assert "Broadcast" not in placed._jdf.queryExecution().executedPlan().toString()
