"""Retrieval metrics and rank correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.scale import running, salted_join, settle

TREE_BITS = 4


def matches(label: Column, true_labels: Column, rule: str = "element") -> Column:
    """Whether a result carries the label: as a list element, or inside the list's text."""
    if rule == "element":
        return F.array_contains(true_labels, label)
    if rule == "substring":
        return F.concat(F.lit("["), F.array_join(true_labels, ", "), F.lit("]")).contains(label)
    raise ValueError(f"unknown match rule {rule!r}")


def hits_at_k(results: DataFrame, queries: DataFrame, k: int = 10, rule: str = "element") -> DataFrame:
    """Hits and accuracy among the first ``k`` results of every query.

    ``results`` has query, rank and true_labels; ``queries`` has query and query_label.
    Queries without results count zero.
    """
    near = salted_join(results.where(F.col("rank") <= k), queries.select("query", "query_label"), ["query"])
    hit = matches(F.col("query_label"), F.col("true_labels"), rule).cast("long")
    found = near.groupBy("query").agg(F.sum(hit).alias("_hits"))
    hits = F.coalesce("_hits", F.lit(0).cast("long"))
    return queries.join(found, "query", "left").select(
        *queries.columns, hits.alias(f"hits_at_{k}"), (hits > 0).cast("int").alias(f"accuracy_at_{k}")
    )


def rank_metrics(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Average precision and NDCG per judged query.

    ``run`` has query, doc, score; ``qrels`` query, doc, rel. Gains are linear, discounts
    log2(rank + 1); relevant documents that were not found count against both.
    """
    placed = running(run.select("query", "doc", "score"), ["query"], [F.desc("score"), F.asc("doc")], position="rank")
    judged = placed.join(qrels.where("rel > 0"), ["query", "doc"])
    relevant = running(judged, ["query"], ["rank"], position="nth")
    discount = lambda c: F.log2(F.col(c) + 1)
    got = relevant.groupBy("query").agg(
        F.sum(F.col("nth") / F.col("rank")).alias("precisions"), F.sum(F.col("rel") / discount("rank")).alias("dcg")
    )
    best = running(qrels.where("rel > 0"), ["query"], [F.desc("rel"), F.asc("doc")], position="place")
    ideal = best.groupBy("query").agg(
        F.count(F.lit(1)).alias("n_relevant"), F.sum(F.col("rel") / discount("place")).alias("idcg")
    )
    return (
        qrels.select("query")
        .distinct()
        .join(ideal, "query", "left")
        .join(got, "query", "left")
        .select(
            "query",
            F.coalesce(F.col("precisions") / F.col("n_relevant"), F.lit(0.0)).alias("map"),
            F.coalesce(F.col("dcg") / F.col("idcg"), F.lit(0.0)).alias("ndcg"),
        )
    )


def as_run(results: DataFrame, is_hybrid: bool = False) -> DataFrame:
    """Search results as (query, doc, score): the score, or one minus the distance."""
    score = F.col("score") if is_hybrid else 1 - F.col("distance")
    return results.select("query", "doc", score.alias("score"))


def _dense_rank(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    values = df.select(*keys, value).distinct()
    return salted_join(df, settle(running(values, keys, [value], position=name)), [*keys, value])


def kendall_tau(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Kendall's tau-b of two columns per group, without pairing the rows.

    Rows are first counted per distinct (x, y). Concordant pairs are then found digit by
    digit of the rank of y: two ranks are ordered by the first digit in which they differ,
    so for each digit one running sum in order of x per prefix and digit value suffices.
    """
    given = list(keys)
    keys = given or ["_all"]
    if not given:
        df = df.withColumn("_all", F.lit(0))
    cells = settle(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, x, y).agg(F.count(F.lit(1)).alias("n")))
    cells = _dense_rank(cells.withColumnsRenamed({x: "_x", y: "_y"}), keys, "_x", "rx")
    cells = settle(_dense_rank(cells, keys, "_y", "ry").select(*keys, "rx", "ry", "n"))
    top = cells.agg(F.max("ry")).first()[0] or 1
    levels = max(1, (int(top).bit_length() + TREE_BITS - 1) // TREE_BITS)
    base = 1 << TREE_BITS
    # one row per cell and level; the running sums count, per digit value, the weight of
    # cells of the same prefix with a smaller or equal x
    rows = cells.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).select(
        *keys,
        "level",
        F.expr(f"shiftright(ry, (level + 1) * {TREE_BITS})").alias("prefix"),
        F.expr(f"shiftright(ry, level * {TREE_BITS}) & {base - 1}").alias("digit"),
        "rx",
        "ry",
        "n",
    )
    group = [*keys, "level", "prefix"]
    weights = {f"w{d}": F.when(F.col("digit") == d, F.col("n")).otherwise(F.lit(0)) for d in range(base)}
    by_x = rows.groupBy(*group, "rx").agg(*[F.sum(w).alias(name) for name, w in weights.items()])
    summed = running(by_x, group, ["rx"], sums={f"c{d}": f"w{d}" for d in range(base)})
    # strictly smaller x and smaller digit -> concordant; smaller x and larger digit -> discordant
    con, dis = F.lit(0), F.lit(0)
    for d in range(base):
        below = [F.col(f"c{e}") - F.col(f"w{e}") for e in range(d)]
        above = [F.col(f"c{e}") - F.col(f"w{e}") for e in range(d + 1, base)]
        for part in below:
            con = con + F.col(f"w{d}") * part
        for part in above:
            dis = dis + F.col(f"w{d}") * part
    pairs = summed.groupBy(*keys).agg(F.sum(con).alias("con"), F.sum(dis).alias("dis"))
    tied = lambda c, name: cells.groupBy(*keys, c).agg(F.sum("n").alias("n")).groupBy(*keys).agg(
        F.sum(F.col("n") * (F.col("n") - 1) / 2).alias(name)
    )
    total = cells.groupBy(*keys).agg(F.sum("n").alias("rows"))
    out = pairs
    for part in (total, tied("rx", "tx"), tied("ry", "ty")):
        out = out.join(part, keys)
    all_pairs = F.col("rows") * (F.col("rows") - 1) / 2
    scale = F.sqrt((all_pairs - F.col("tx")) * (all_pairs - F.col("ty")))
    return out.select(*given, F.when(scale > 0, (F.col("con") - F.col("dis")) / scale).alias("tau"))


def mean_row_tau(rows: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Mean over rows of a matrix of the tau between two kinds of distances."""
    return kendall_tau(rows, [key], x, y).agg(F.avg("tau").alias("tau"))


def result_labels(run: DataFrame, docs: DataFrame, doc: str, labels: Column) -> DataFrame:
    """Search results with the list of true labels of each document."""
    return salted_join(run, docs.select(F.col(doc).alias("doc"), labels.alias("true_labels")), ["doc"])
