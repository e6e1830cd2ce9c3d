"""Near-duplicate vectors by product quantisation and exact cosines.

Equal vectors are one class. A coarse k-means makes inverted lists; the residual of each vector is
coded per subspace. A vector is searched in every list whose cell a neighbour may lie in; distances come
from per-query tables, a pair is passed on unless its table distance shows that it is too far even with
the coding error known for each vector, and the exact cosine decides.

Lists and their queries are cut into blocks, so one list may hold most of the rows. A block returns link
counts and one edge per linked vector to its local component, never pairs.

The index is fitted on at most ``SAMPLE`` classes picked by hash and covers all of them.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.graphs import components
from textloom.scale import Salted, settle

SAMPLE = 16_384
MOST_LISTS = 1_024
SUBSPACES = 8
CODES = 256
BLOCK = 2_048
SLACK = 1e-9  # for rounding


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first so that squares cannot overflow."""
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def square_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :] - 2 * a @ b.T
    return np.maximum(d, 0)


def kmeans(points: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd steps from points drawn with a fixed seed; an empty cell keeps its centre."""
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), k, replace=k > len(points))].copy()
    for _ in range(rounds):
        nearest = square_distances(points, centres).argmin(axis=1)
        sizes = np.bincount(nearest, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        centres[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centres


@dataclass
class Index:
    """Coarse centres, residual codebooks (subspace, code, width) and the neighbour radius."""

    centres: np.ndarray
    books: np.ndarray
    radius: float

    def __post_init__(self):
        self.gaps = np.sqrt(square_distances(self.centres, self.centres))

    def _split(self, residuals: np.ndarray) -> np.ndarray:
        """Residuals as (row, subspace, width), padded with zeros to whole subspaces."""
        subspaces, _, width = self.books.shape
        wide = np.zeros((len(residuals), subspaces * width))
        wide[:, : residuals.shape[1]] = residuals
        return wide.reshape(len(residuals), subspaces, width)

    def place(self, vectors: np.ndarray):
        """List, codes and coding error of each vector, and the lists to search for its neighbours."""
        distances = square_distances(vectors, self.centres)
        own = distances.argmin(axis=1)
        residuals = vectors - self.centres[own]
        parts = self._split(residuals)
        codes = np.stack(
            [square_distances(parts[:, s], self.books[s]).argmin(axis=1) for s in range(len(self.books))], axis=1
        )
        coded = np.concatenate([self.books[s][codes[:, s]] for s in range(len(self.books))], axis=1)
        errors = np.sqrt(((residuals - coded[:, : residuals.shape[1]]) ** 2).sum(axis=1))
        # Two neighbours on either side of a cell border are at most the radius apart, so one of them is
        # within half of it of the border and searches the other's list: square distances differ there
        # by at most twice the gap of the centres times half the radius.
        margin = self.radius * self.gaps[own] + SLACK
        probes = distances <= distances[np.arange(len(own)), own][:, None] + margin
        return own, codes.astype(np.uint8), errors, probes

    def tables(self, queries: np.ndarray, where: int) -> np.ndarray:
        """Square distances of each query's residual to each code, (query, subspace, code)."""
        parts = self._split(queries - self.centres[where])
        return np.stack([square_distances(parts[:, s], self.books[s]) for s in range(len(self.books))], axis=1)


def fit(sample: np.ndarray, total: int, threshold: float) -> Index:
    """Fit on unit vectors; the number of lists follows the root of the whole table's size."""
    lists = max(1, min(MOST_LISTS, int(sqrt(total)), len(sample) // 16 or 1))
    centres = kmeans(sample, lists, 8, seed=1)
    residuals = sample - centres[square_distances(sample, centres).argmin(axis=1)]
    width = ceil(sample.shape[1] / SUBSPACES)
    wide = np.zeros((len(sample), SUBSPACES * width))
    wide[:, : sample.shape[1]] = residuals
    parts = wide.reshape(len(sample), SUBSPACES, width)
    books = np.stack([kmeans(parts[:, s], min(CODES, len(sample)), 6, seed=2 + s) for s in range(SUBSPACES)])
    return Index(centres, books, sqrt(2 - 2 * threshold))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column without nulls, all of one length, as rows."""
    n = len(column)
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in getattr(column, "chunks", [column])] or [np.zeros(0)])
    return flat.reshape(n, -1)


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links (a, b) and the smallest node each is connected with."""
    nodes, numbers = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = numbers[: len(a)], numbers[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        fresh = label.copy()
        np.minimum.at(fresh, a, low)
        np.minimum.at(fresh, b, low)
        np.minimum.at(fresh, label[a], low)
        np.minimum.at(fresh, label[b], low)
        fresh = fresh[fresh]
        if (fresh == label).all():
            return nodes, nodes[label]
        label = fresh


def search_block(index: Index, where: int, base: dict, queries: dict, threshold: float):
    """(class, linked copies) and (class, local component) of one block of a list and of its queries.

    A pair that both sides search is counted from the smaller class number only.
    """
    found_q, found_x = [], []
    limit = (index.radius + base["error"] + 1e-9) ** 2
    for at in range(0, len(queries["class"]), 256):
        part = slice(at, at + 256)
        tables = index.tables(queries["unit"][part], where)
        near = np.zeros((len(tables), len(limit)))
        for s in range(tables.shape[1]):
            near += tables[:, s][:, base["codes"][:, s]]
        q, x = np.nonzero(near <= limit)
        q += at
        for cut in range(0, len(q), 1 << 17):
            qs, xs = q[cut : cut + (1 << 17)], x[cut : cut + (1 << 17)]
            close = np.einsum("ij,ij->i", queries["unit"][qs], base["unit"][xs]) >= threshold
            found_q.append(qs[close])
            found_x.append(xs[close])
    q, x = (np.concatenate(f) if f else np.zeros(0, np.int64) for f in (found_q, found_x))
    mutual = base["probes"][x, queries["list"][q]]
    a, b = queries["class"][q], base["class"][x]
    take = np.where(mutual, a < b, a != b)
    q, x, a, b = q[take], x[take], a[take], b[take]
    counts_q = np.bincount(q, base["copies"][x], len(queries["class"]))
    counts_x = np.bincount(x, queries["copies"][q], len(base["class"]))
    counted = [(queries["class"], counts_q), (base["class"], counts_x)]
    classes = np.concatenate([c[n > 0] for c, n in counted])
    copies = np.concatenate([n[n > 0] for _, n in counted]).astype(np.int64)
    return (classes, copies), local_components(a, b)


FOUND = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("n", pa.int64())])


def _search(classes: DataFrame, vector: str, index: Index, threshold: float) -> DataFrame:
    """Link counts (dst null) and connecting edges (n null) between class numbers."""
    spark = classes.sparkSession
    shared = spark.sparkContext.broadcast(index)
    lists = len(index.centres)

    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            own, codes, errors, probes = shared.value.place(unit(_matrix(batch.column(2))))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns, pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()),
                    pa.array(errors, pa.float64()),
                    pa.array([np.flatnonzero(p).astype(np.int32) for p in probes], pa.list_(pa.int32())),
                ],
                names=["class", "copies", "v", "list", "codes", "error", "probes"],
            )

    kind = classes.schema[vector].dataType.simpleString()
    indexed = settle(
        classes.select("class", "copies", F.col(vector).alias("v")).mapInArrow(
            place, f"class long, copies long, v {kind}, list int, codes binary, error double, probes array<int>"
        )
    )
    asked = indexed.select("class", "copies", "v", "list", "codes", "error", "probes", F.explode("probes").alias("where"))
    sizes = (  # one row per list, of which there are at most MOST_LISTS
        indexed.groupBy(F.col("list").alias("where")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
        .join(asked.groupBy("where").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")), "where")
    )
    sizes = F.broadcast(settle(sizes))
    spread = F.xxhash64("class")
    columns = ["class", "copies", "v", "list", "codes", "error", "probes", "where", "block", "part", "asks"]
    held = (
        indexed.withColumn("where", F.col("list")).join(sizes, "where")
        .withColumn("block", F.pmod(spread, F.col("blocks")).cast("int"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("asks", F.lit(False)).select(*columns)
    )
    asking = (
        asked.join(sizes, "where")
        .withColumn("part", F.pmod(spread, F.col("parts")).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("asks", F.lit(True)).select(*columns)
    )

    def search(table: pa.Table) -> pa.Table:
        vectors, asks = unit(_matrix(table.column("v"))), table.column("asks").to_numpy()
        numbers = {c: table.column(c).to_numpy() for c in ("class", "copies", "list", "error")}
        numbers["unit"] = vectors
        base = {c: v[~asks] for c, v in numbers.items()}
        queries = {c: v[asks] for c, v in numbers.items()}
        if not len(base["class"]) or not len(queries["class"]):
            return FOUND.empty_table()
        rows = np.flatnonzero(~asks)
        codes = table.column("codes").take(pa.array(rows)).to_pylist()
        base["codes"] = np.frombuffer(b"".join(codes), np.uint8).reshape(len(rows), -1)
        base["probes"] = np.zeros((len(rows), lists), bool)
        for i, p in enumerate(table.column("probes").take(pa.array(rows)).to_pylist()):
            base["probes"][i, p] = True
        where = table.column("where")[0].as_py()
        (classes_, copies), (nodes, roots) = search_block(shared.value, where, base, queries, threshold)
        edge = nodes != roots
        none_n, none_c = pa.nulls(int(edge.sum()), pa.int64()), pa.nulls(len(classes_), pa.int64())
        return pa.Table.from_arrays(
            [
                pa.concat_arrays([pa.array(classes_, pa.int64()), pa.array(nodes[edge], pa.int64())]),
                pa.concat_arrays([none_c, pa.array(roots[edge], pa.int64())]),
                pa.concat_arrays([pa.array(copies, pa.int64()), none_n]),
            ],
            schema=FOUND,
        )

    return held.unionByName(asking).groupBy("where", "block", "part").applyInArrow(search, "src long, dst long, n long")


def near_duplicates(df: DataFrame, key: str, vector: str, threshold: float = 0.95) -> DataFrame:
    """(key, n_links, component_id, kept): one row per row of ``df``.

    ``n_links`` counts the other rows with a cosine of at least ``threshold``, copies included;
    ``component_id`` is the smallest key reachable by links. Vectors that are null, empty or zero or hold
    a null or a non-finite number link with nothing, nor do rows without a key; vectors of different
    lengths do not link. Repeated rows count as vectors of their own. Other columns are not read.
    """
    rows = df.select(F.col(key).alias("_key"), F.col(vector).alias("_v"))
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    whole = F.col("_v").isNotNull() & F.forall("_v", number) & F.exists("_v", lambda x: x != 0) & F.col("_key").isNotNull()
    marked = settle(rows.withColumn("_ok", F.coalesce(whole, F.lit(False))))
    valid = marked.where("_ok").select("_key", "_v")
    classes = settle(
        valid.groupBy("_v").agg(F.min("_key").alias("first"), F.count(F.lit(1)).alias("copies"))
        .withColumn("class", F.monotonically_increasing_id())
    )
    sizes = sorted((r[0], r[1]) for r in classes.groupBy(F.size("_v")).count().collect())  # one row per length
    parts = []
    for size, total in sizes:
        same = classes.where(F.size("_v") == size)
        share = min(1.0, SAMPLE / total)
        picked = same.where(F.pmod(F.xxhash64("class"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
        sample = unit(_matrix(picked.select("_v").limit(2 * SAMPLE).toArrow().column(0)))
        parts.append(settle(_search(same, "_v", fit(sample, total, threshold), threshold)))
    if not parts:
        return df.select(
            key, F.lit(0).cast("long").alias("n_links"), F.col(key).alias("component_id"),
            F.col(key).isNotNull().alias("kept"),
        )
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    counts = found.where(F.col("dst").isNull()).groupBy(F.col("src").alias("class")).agg(F.sum("n").alias("n"))
    joined = components(found.where(F.col("dst").isNotNull()).select("src", "dst")).select(
        F.col("id").alias("class"), F.col("component").alias("root")
    )
    rooted = settle(
        classes.select("class", "first", "copies").join(joined, "class", "left")
        .join(counts, "class", "left").withColumn("root", F.coalesce("root", "class"))
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    # only classes with copies or links need more than their own key
    told = (
        rooted.where("copies > 1 OR n IS NOT NULL").join(least, "root")
        .select("class", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), "least")
    )
    told = settle(told.join(classes.select("class", "_v", F.col("copies").alias("_n")), "class").select("_v", "n", "least", "_n"))
    heavy = told.select("_v", "_n")
    answered = Salted(marked, ["_v"], counts=heavy).join(told.drop("_n"), "left")
    component = F.when(F.col("_ok"), F.coalesce("least", "_key")).otherwise(F.col("_key"))
    return answered.select(
        F.col("_key").alias(key),
        F.when(F.col("_ok"), F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("_key") == component, F.lit(False)).alias("kept"),
    )
