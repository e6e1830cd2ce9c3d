"""Principal axes and spectral embeddings by block power iteration.

A matrix is a table of cells (row, col, value). Each round multiplies k columns by the matrix and its transpose as
joins and sums over the cells, and makes them orthonormal with the k x k table of their products, the only
numbers that reach the driver. The columns stay tables, so neither side of the matrix is bounded.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.scale import Salted, release, salted_join, settle


def hashed_start(key: Column, i: int) -> Column:
    """A first entry between -0.5 and 0.5 by a hash of the name and the number of the axis."""
    return F.pmod(F.xxhash64(key, F.lit(i)), F.lit(100_003)) / 100_003.0 - 0.5


def _names(k: int, letter: str = "v") -> list[str]:
    return [f"{letter}{i}" for i in range(k)]


def _orthonormal(table: DataFrame, key: str, k: int) -> DataFrame:
    """The columns w0, w1, ... made orthonormal in their order, as v0, v1, ...; a dependent one becomes zero."""
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    row = table.agg(*[F.sum(F.col(f"w{i}") * F.col(f"w{j}")) for i, j in cells]).first()
    gram = np.zeros((k, k))
    for (i, j), value in zip(cells, row):
        gram[i, j] = gram[j, i] = value or 0.0
    # rows of ``mix`` express each new column by the old ones, as Gram and Schmidt do
    mix = np.zeros((k, k))
    for i in range(k):
        own = np.eye(k)[i]
        for j in range(i):
            own = own - (mix[j] @ gram[i]) * mix[j]
        length = own @ gram @ own
        mix[i] = own / np.sqrt(length) if length > 1e-18 * max(gram[i, i], 1e-300) else 0.0
    parts = [sum((F.col(f"w{j}") * float(mix[i, j]) for j in range(i + 1)), F.lit(0.0)).alias(f"v{i}") for i in range(k)]
    return table.select(key, *parts)


def _signed(table: DataFrame, key: str, k: int) -> DataFrame:
    """Each column turned so that its entry of largest size, of equal ones that of the smallest key, is positive."""
    size = lambda n: F.struct(F.round(F.abs(F.col(n)), 9).alias("a"))
    tops = table.agg(*[F.max(size(n)["a"]).alias(n) for n in _names(k)]).first()
    marks = [F.min_by(F.col(n), F.when(F.round(F.abs(F.col(n)), 9) >= F.lit(tops[n]), F.col(key))).alias(n) for n in _names(k)]
    first = table.agg(*marks).first()
    return table.select(key, *[(F.col(n) * (-1.0 if (first[n] or 0.0) < 0 else 1.0)).alias(n) for n in _names(k)])


def principal_axes(cells: DataFrame, k: int = 2, rounds: int = 30, centred: bool = True,
                   start: Callable[[Column, int], Column] = hashed_start) -> DataFrame:
    """(col, axis): the k leading right singular directions of (row, col, value), an array of k numbers per column.

    ``centred`` takes each column less its mean over all rows, as principal components do. Missing cells
    are zeros. The entry of largest size on an axis is positive.
    """
    table = settle(cells.select("row", "col", F.col("value").cast("double").alias("value")))
    n = table.select("row").distinct().count()
    means = settle(table.groupBy("col").agg((F.sum("value") / F.lit(max(n, 1))).alias("mean")))
    by_col, by_row = Salted(table, ["col"]), Salted(table, ["row"])
    first = means.select("col", "mean", *[start(F.col("col"), i).cast("double").alias(f"w{i}") for i in range(k)])
    columns = settle(_orthonormal(first, "col", k))
    for _ in range(rounds):
        # Y = (X - 1 m^T) V, then W = (X - 1 m^T)^T Y
        shift = [0.0] * k
        if centred:
            row = columns.join(means, "col").agg(*[F.sum(F.col("mean") * F.col(v)) for v in _names(k)]).first()
            shift = [float(x or 0.0) for x in row]
        sent = by_col.join(columns).groupBy("row").agg(*[F.sum(F.col("value") * F.col(v)).alias(f"s{i}") for i, v in enumerate(_names(k))])
        scores = settle(sent.select("row", *[(F.col(f"s{i}") - F.lit(shift[i])).alias(f"y{i}") for i in range(k)]))
        whole = [0.0] * k
        if centred:
            whole = [float(x or 0.0) for x in scores.agg(*[F.sum(f"y{i}") for i in range(k)]).first()]
        back = by_row.join(scores).groupBy("col").agg(*[F.sum(F.col("value") * F.col(f"y{i}")).alias(f"b{i}") for i in range(k)])
        moved = settle(back.join(means, "col").select("col", *[(F.col(f"b{i}") - F.col("mean") * F.lit(whole[i])).alias(f"w{i}") for i in range(k)]))
        older, columns = columns, settle(_orthonormal(moved, "col", k))
        release(older, scores, moved)
    return _signed(columns, "col", k).select("col", F.array(*_names(k)).alias("axis"))


def scores(cells: DataFrame, axes: DataFrame, centred: bool = True) -> DataFrame:
    """(row, point): each row's coordinates on the axes, the column means not taken off where ``centred`` is false."""
    k = len(axes.first()["axis"]) if not axes.isEmpty() else 0
    table = cells.select("row", "col", F.col("value").cast("double").alias("value"))
    met = salted_join(table, axes, ["col"])
    sums = [F.sum(F.col("value") * F.col("axis")[i]).alias(f"p{i}") for i in range(k)]
    points = met.groupBy("row").agg(*sums)
    if centred and k:
        means = points.agg(*[F.avg(f"p{i}").alias(f"p{i}") for i in range(k)]).first()
        return points.select("row", F.array(*[F.col(f"p{i}") - F.lit(means[f"p{i}"] or 0.0) for i in range(k)]).alias("point"))
    return points.select("row", F.array(*[F.col(f"p{i}") for i in range(k)]).alias("point"))


def vector_cells(df: DataFrame, row_id: str, vector: str) -> DataFrame:
    """The cells of a column of vectors."""
    return df.select(F.col(row_id).alias("row"), F.posexplode(vector).alias("col", "value"))


def landmark_embedding(affinity: DataFrame, k: int = 4, rounds: int = 30, start: Callable[[Column, int], Column] = hashed_start) -> DataFrame:
    """(id, point): k spectral coordinates of every vertex from its affinities (id, landmark, affinity) to a few landmarks.

    Affinities are shares of a vertex's total, scaled by the root of each landmark's total; the points are the
    leading left singular directions of that table. Time and space grow with vertices times landmarks.
    """
    total = affinity.groupBy("id").agg(F.sum("affinity").alias("_t"))
    shares = settle(salted_join(affinity, total, ["id"]).select("id", "landmark", (F.col("affinity") / F.col("_t")).alias("z")))
    weight = shares.groupBy("landmark").agg(F.sum("z").alias("_w"))
    cells = salted_join(shares, weight, ["landmark"]).select(
        F.col("id").alias("row"), F.col("landmark").alias("col"), (F.col("z") / F.sqrt("_w")).alias("value")
    )
    cells = settle(cells)
    found = scores(cells, settle(principal_axes(cells, k, rounds, centred=False, start=start)), centred=False)
    return found.select(F.col("row").alias("id"), "point")
