"""Approximate dense search: inverted lists around stated centres, sign sketches inside them.

Every row belongs to the list of its nearest centre and carries a sketch, the signs of fixed random projections.
A query first looks into its nearest lists, takes the rows with the most similar sketches there and
computes their cosines; the k-th of them is a floor for the result. Lists that cannot hold anything above
the floor, by the triangle bound of their radius, are left out whole. In the others only rows whose sketch
differs in few enough places are compared exactly: as many as a row as good as the floor exceeds with
probability ``miss`` only, whatever the vectors. So the expected recall is at least 1 - ``miss``.

The centres are a bounded number of rows, chosen by a digest of their ids. Rows, queries and both
waves meet per list; a list with many rows or queries is met in parts.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from hashlib import md5
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import vectors
from textloom.operators.similarity import _matrix
from textloom.scale import salted_join, settle, top_per_group

PART_VALUES = 4_000_000  # vector components of one side of a meeting
PART_ROWS = 256  # fewest rows worth a meeting
TILE_ENTRIES = 1_000_000


def projections(bits: int, dim: int, seed: int = 42) -> np.ndarray:
    """Entries 1 or -1 by the first hex digit of the MD5 of ``seed:bit:place``: no fit, the same everywhere."""
    names = (f"{seed}:{b}:{i}" for b in range(bits) for i in range(dim))
    return np.array([1.0 if int(md5(n.encode()).hexdigest()[0], 16) >= 8 else -1.0 for n in names]).reshape(bits, dim)


@dataclass
class Lists:
    """The table (id, list, vec, sketch) with the centres' directions and the radius of every list."""

    rows: DataFrame
    centres: np.ndarray
    radii: np.ndarray
    bits: int
    seed: int


def _angles(matrix: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(np.round(matrix @ centres.T, 9), -1.0, 1.0))


def _sketches(frame: pd.DataFrame, planes: np.ndarray) -> list:
    sides = np.round(np.stack(frame["vec"].to_list()).astype(np.float64) @ planes.T, 9) >= 0
    return list(np.packbits(sides, axis=1).view(np.int64))


def _checked(bits: int) -> int:
    if bits % 64:
        raise ValueError("bits must be a multiple of 64")
    return bits


def build(corpus: DataFrame, row_id: str, vector: str, lists: int = 1024, bits: int = 512, seed: int = 42) -> Lists:
    """Lists around the ``lists`` rows whose ids have the smallest MD5; every row is indexed.

    The centres (at most ``lists`` vectors) and one radius per list are all that reaches the driver.
    """
    rows = corpus.select(F.col(row_id).alias("id"), F.col(vector).alias("vec"))
    digest = F.md5(F.col("id").cast("string"))
    chosen = rows.orderBy(digest, "id").limit(lists).collect()
    centres = _matrix([r["vec"] for r in chosen]) if chosen else np.zeros((0, 1))
    bits = _checked(bits)

    def place(batches):
        planes = projections(bits, centres.shape[1], seed)
        for frame in batches:
            if len(frame):
                angles = _angles(_matrix(frame["vec"]), centres)
                own = angles.argmin(axis=1)
                yield frame.assign(list=own.astype(np.int32), away=angles[np.arange(len(own)), own], sketch=_sketches(frame, planes))

    kinds = dict(rows.dtypes)
    placed = settle(rows.mapInPandas(place, f"id {kinds['id']}, vec {kinds['vec']}, list int, away double, sketch array<long>"))
    radii = np.zeros(len(centres))
    for r in placed.groupBy("list").agg(F.max("away").alias("r")).collect():
        radii[r["list"]] = r["r"]
    return Lists(placed.drop("away"), centres, radii, bits, seed)


def _meet(rows: DataFrame, asks: DataFrame, limit: int, fn: Callable, schema: str) -> DataFrame:
    """``fn`` over the rows and the queries of each list, in parts of about ``limit`` on both sides."""
    parts = rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / limit).alias("_r"))
    parts = settle(parts.join(asks.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / limit).alias("_a")), "list"))  # a row per list

    def dealt(side, key, own, other, mine, copies):
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies) - 1))
        return side.join(F.broadcast(parts), "list").withColumn(mine, F.pmod(F.xxhash64(key), F.col(own))).withColumn(other, every)

    left = dealt(rows, "id", "_r", "_j", "_i", "_a").drop("_r", "_a")
    right = dealt(asks, "query", "_a", "_i", "_j", "_r").select(
        F.col("list").alias("_l"), F.col("_i").alias("_k"), F.col("_j").alias("_m"), *[c for c in asks.columns if c != "list"]
    )
    meet = lambda x, y: fn(x, y) if len(x) and len(y) else pd.DataFrame()
    return left.groupBy("list", "_i", "_j").cogroup(right.groupBy("_l", "_k", "_m")).applyInPandas(meet, schema)


def _differences(x: pd.DataFrame, y: pd.DataFrame):
    """Tiles of differing sketch places: (first query, matrix of queries by rows)."""
    held, asked = (np.stack(side.to_list()).astype(np.int64).view(np.uint64) for side in (x["sketch"], y["asked"]))
    step = max(1, TILE_ENTRIES // len(held))
    for lo in range(0, len(asked), step):
        part = asked[lo : lo + step]
        away = np.zeros((len(part), len(held)), np.int32)
        for word in range(held.shape[1]):
            away += np.bitwise_count(part[:, word, None] ^ held[None, :, word])
        yield lo, away


def search(index: Lists, queries: DataFrame, query_id: str, query_vector: str, k: int = 10, near: int = 8,
           first: int = 2, miss: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(query, doc, score, rank) of the k best rows found, and (query, candidates) with the exact comparisons.

    The floor comes from the ``first`` * k most similar sketches of the ``near`` nearest lists.
    """
    spark = queries.sparkSession
    centres, radii, bits, seed = index.centres, index.radii, index.bits, index.seed
    asks = queries.select(F.col(query_id).alias("query"), F.col(query_vector).alias("vec"))
    kinds, row_kind = dict(asks.dtypes), dict(index.rows.dtypes)["id"]
    result = f"query {kinds['query']}, row {row_kind}"
    if not len(centres):
        none = spark.createDataFrame([], f"query {kinds['query']}, doc {row_kind}, score double, rank int")
        return none, none.groupBy("query").agg(F.count(F.lit(1)).alias("candidates"))
    limit = max(PART_ROWS, PART_VALUES // centres.shape[1])

    def approach(batches):
        planes = projections(bits, centres.shape[1], seed)
        for frame in batches:
            if len(frame):
                order = np.argsort(_angles(_matrix(frame["vec"]), centres), axis=1, kind="stable")[:, :near]
                yield frame.assign(asked=_sketches(frame, planes), lists=list(order.astype(np.int32)))

    sketched = settle(asks.mapInPandas(approach, f"query {kinds['query']}, vec {kinds['vec']}, asked array<long>, lists array<int>"))

    def alike(x, y):
        found, most = [], first * k
        for lo, away in _differences(x, y):
            edge = np.partition(away, most - 1, axis=1)[:, most - 1] if away.shape[1] > most else np.full(len(away), bits)
            at, row = np.nonzero(away <= edge[:, None])
            found.append(pd.DataFrame({"query": y["query"].to_numpy()[lo + at], "row": x["id"].to_numpy()[row], "away": away[at, row]}))
        return pd.concat(found)

    nearby = sketched.select("query", "asked", F.explode("lists").alias("list"))
    likely = _meet(index.rows.select("id", "list", "sketch"), nearby, limit, alike, f"{result}, away int")
    likely = top_per_group(likely, ["query"], [F.asc("away"), F.asc("row")], first * k).select("query", "row", "away")
    pairs = salted_join(settle(likely), sketched.select("query", F.col("vec").alias("_q")), ["query"])
    pairs = salted_join(pairs, index.rows.select(F.col("id").alias("row"), F.col("vec").alias("_d")), ["row"])
    opened = settle(pairs.select("query", "row", "away", F.round(vectors.cosine(F.col("_q"), F.col("_d")), 9).alias("score")))
    kth = top_per_group(opened, ["query"], [F.desc("score"), F.asc("row")], k).groupBy("query").agg(
        F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(F.lit(-1.0)).alias("floor")
    )
    floors = sketched.join(kth, "query", "left").withColumn("floor", F.coalesce("floor", F.lit(-1.0)))
    slack = NormalDist().inv_cdf(1 - miss) * math.sqrt(bits) / 2

    def remaining(batches):
        for frame in batches:
            if len(frame):
                angles = _angles(_matrix(frame["vec"]), centres)
                bound = np.cos(np.maximum(angles - radii[None, :], 0.0))
                floor = frame["floor"].to_numpy()
                open_ = bound >= floor[:, None] - 1e-9
                most = np.floor(bits * np.arccos(np.clip(floor, -1.0, 1.0)) / math.pi + slack).astype(np.int32)
                yield frame.drop(columns=["floor"]).assign(most=most, lists=[np.flatnonzero(x).astype(np.int32) for x in open_])

    visits = floors.select("query", "vec", "asked", "floor").mapInPandas(
        remaining, f"query {kinds['query']}, vec {kinds['vec']}, asked array<long>, most int, lists array<int>"
    )
    visits = settle(visits)

    def compare(x, y):
        ids, names = x["id"].to_numpy(), y["query"].to_numpy()
        held, asked, most = _matrix(x["vec"]), _matrix(y["vec"]), y["most"].to_numpy()
        found = []
        for lo, away in _differences(x, y):
            at, row = np.nonzero(away <= most[lo : lo + len(away), None])
            score = np.concatenate([
                np.round(np.einsum("ij,ij->i", asked[lo + at[s : s + limit]], held[row[s : s + limit]]), 9)
                for s in range(0, len(at), limit)
            ]) if len(at) else np.zeros(0)
            order = np.lexsort((ids[row], -score, at))
            at, row, score = at[order], row[order], score[order]
            starts = np.searchsorted(at, np.arange(len(away)))
            best = np.arange(len(at)) - starts[at] < k
            found.append(pd.DataFrame({"query": names[lo + at[best]], "row": ids[row[best]], "score": score[best], "n": 0}))
            counted = np.bincount(at, minlength=len(away))
            found.append(pd.DataFrame({"query": names[lo : lo + len(away)], "row": None, "score": np.nan, "n": counted}))
        return pd.concat([f for f in found if len(f)])

    asked = visits.select("query", "vec", "asked", "most", F.explode("lists").alias("list"))
    renamed = asked.withColumnRenamed("vec", "vec_")

    met = settle(_meet(
        index.rows, renamed, limit, lambda x, y: compare(x, y.rename(columns={"vec_": "vec"})), f"{result}, score double, n long"
    ))
    extra = opened.join(visits.select("query", "most"), "query").where("away > most")  # opened by the first wave only
    scored = met.where("row IS NOT NULL").select("query", "row", "score").unionByName(extra.select("query", "row", "score"))
    best = top_per_group(scored, ["query"], [F.desc("score"), F.asc("row")], k)
    counted = met.select("query", "n").unionByName(extra.select("query", F.lit(1).cast("long").alias("n")))
    return (
        best.select("query", F.col("row").alias("doc"), "score", "rank"),
        counted.groupBy("query").agg(F.sum("n").alias("candidates")),
    )
