"""Pairwise work on vectors in blocks.

Rows are dealt into blocks by a hash of their id. A task gets one pair of blocks and turns
it into a matrix product; only what the operator asks for (a nearest value, a histogram, the
k best) leaves the task, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.scale import kept, running, settle, top_per_group

BLOCK_ROWS = 2048
MATRIX_ENTRIES = 4_000_000
LEAF_ROWS = 128
TILE_ROWS, TILE_COLS = 256, 1024  # a tile whose entries are placed stays in a core's cache
LOWEST, HIGHEST = -1.00137, 1.00091  # of a histogram of cosines; no usual value lies on a border of its bins
AXES = 10  # main axes of the boxes
CELL_VALUES = 2_000_000  # numbers of the rows of a cell
ASK_VALUES = 8_000_000  # numbers of the queries that a cell meets at once
SLACK = 1e-7  # more than rounding can take off a distance between vectors of length one


def block_count(df: DataFrame, rows: int = BLOCK_ROWS) -> int:
    return max(1, math.ceil(df.count() / rows))


def _matrix(column) -> np.ndarray:
    """Vectors over their length as rows; zero vectors stay zero."""
    return _units_of(np.stack(list(column)).astype(np.float64))


def _finite(matrix: np.ndarray) -> np.ndarray:
    """Without rows that have no cosine."""
    return matrix[np.isfinite(matrix).all(axis=1)]


def _units_of(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size > 0, size, 1.0)


def block_pairs(
    left: DataFrame,
    right: DataFrame,
    fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str,
    left_blocks: int,
    right_blocks: int,
) -> DataFrame:
    """``fn`` over every pair of a left and a right block. Both sides have id and vec."""

    def dealt(df, mine, other, my_name, other_name):
        return df.withColumn(my_name, F.pmod(F.xxhash64("id"), F.lit(mine))).withColumn(
            other_name, F.explode(F.sequence(F.lit(0), F.lit(other - 1)).cast("array<bigint>"))
        )

    def meet(x, y):
        if not len(x) or not len(y):
            return pd.DataFrame()
        return fn(x, y.rename(columns=lambda c: c.removesuffix("__r")))

    # the right side gets names of its own: both may come from one table
    renamed = right.select(*[F.col(c).alias(c if c == "id" else f"{c}__r") for c in right.columns])
    a = dealt(left, left_blocks, right_blocks, "_i", "_j")
    b = dealt(renamed, right_blocks, left_blocks, "_j", "_i").withColumnRenamed("id", "id__r")
    return a.groupBy("_i", "_j").cogroup(b.groupBy("_i", "_j")).applyInPandas(meet, schema)


def _units(df: DataFrame, row_id: str, vector: str) -> DataFrame:
    return df.select(F.col(row_id).alias("id"), F.col(vector).alias("vec"))


SELF_ROWS = 100_000  # most rows of a block in a task


def self_blocks(df: DataFrame, fn: Callable[[pd.DataFrame, pd.DataFrame, bool], pd.DataFrame], schema: str, per_core: int = 2) -> DataFrame:
    """``fn`` over every unordered pair of blocks of one table (id, vec), and each block with itself.

    The grid follows the cores, not the rows, while a block stays under ``SELF_ROWS``: a row is copied
    about as often as the root of the number of tasks. ``fn`` is told whether both blocks are one.
    """
    spark = df.sparkSession
    rows = df.count()
    tasks = per_core * int(spark.sparkContext.defaultParallelism)
    grid = max(1, math.ceil(rows / SELF_ROWS), min(math.ceil(math.sqrt(2 * tasks)), math.ceil(rows / 256)))
    own, other = F.pmod(F.xxhash64("id"), F.lit(grid)), F.col("_k")
    dealt = df.withColumn("_own", own).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(grid - 1)).cast("array<bigint>")))
    dealt = dealt.withColumn("_i", F.least("_own", other)).withColumn("_j", F.greatest("_own", other)).drop("_k")

    def meet(key, frame):
        x = frame[frame["_own"] == key[0]]
        y = x if key[0] == key[1] else frame[frame["_own"] == key[1]]
        return fn(x, y, key[0] == key[1]) if len(x) and len(y) else pd.DataFrame()

    return dealt.groupBy("_i", "_j").applyInPandas(meet, schema)


def _tiles(x: pd.DataFrame, y: pd.DataFrame, same: bool):
    """Cosine tiles of two blocks with the row numbers they cover; of one block only those on or above
    the diagonal. The entry of a vector and itself is NaN."""
    a, b = _matrix(x["vec"]), None
    b = a if same else _matrix(y["vec"])
    for i in range(0, len(a), BLOCK_ROWS):
        for j in range(i if same else 0, len(b), BLOCK_ROWS):
            tile = a[i : i + BLOCK_ROWS] @ b[j : j + BLOCK_ROWS].T
            if same and i == j:
                np.fill_diagonal(tile, np.nan)
            yield i, j, tile


def cosine_rows(df: DataFrame, row_id: str, vector: str) -> DataFrame:
    """Per vector: number of others, largest and mean cosine to them."""
    units = _units(df, row_id, vector)
    kind = dict(units.dtypes)["id"]

    def summarise(x, y, same):
        n = {"x": np.zeros(len(x), np.int64), "y": np.zeros(len(y), np.int64)}
        top = {k: np.full(len(v), -np.inf) for k, v in n.items()}
        total = {k: np.zeros(len(v)) for k, v in n.items()}

        def add(side, at, tile, axis):
            part = slice(at, at + tile.shape[1 - axis])
            n[side][part] += (~np.isnan(tile)).sum(axis=axis)
            total[side][part] += np.nansum(tile, axis=axis)
            top[side][part] = np.fmax(top[side][part], np.fmax.reduce(tile, axis=axis))

        for i, j, tile in _tiles(x, y, same):
            add("x", i, tile, 1)
            if not same or i != j:
                add("x" if same else "y", j, tile, 0)
        sides = ["x"] if same else ["x", "y"]
        ids = {"x": x["id"], "y": y["id"]}
        return pd.concat([
            pd.DataFrame({"id": ids[k].to_numpy(), "others": n[k], "nearest": top[k], "total": total[k]}) for k in sides
        ])

    parts = self_blocks(units, summarise, f"id {kind}, others long, nearest double, total double")
    return parts.groupBy(F.col("id").alias(row_id)).agg(
        F.sum("others").alias("others"),
        F.max("nearest").alias("nearest"),
        (F.sum("total") / F.sum("others")).alias("mean"),
    )


def cosine_matrix(df: DataFrame, row_id: str, vector: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The labelled similarity matrix as a long table (left, right, cosine), both triangles.

    Meant for sets whose square is a result one wants to keep.
    """
    units = df.select(F.col(row_id).alias("id"), F.col(vector).alias("vec"))
    kind = dict(units.dtypes)["id"]
    blocks = block_count(units, block_rows)

    def product(x, y):
        values = _matrix(x["vec"]) @ _matrix(y["vec"]).T
        return pd.DataFrame(
            {
                "left": np.repeat(x["id"].to_numpy(), len(y)),
                "right": np.tile(y["id"].to_numpy(), len(x)),
                "cosine": values.reshape(-1),
            }
        )

    return block_pairs(units, units, product, f"left {kind}, right {kind}, cosine double", blocks, blocks)


def coherence(
    df: DataFrame,
    row_id: str,
    vector: str,
    probs=(0.25, 0.5, 0.75, 0.95),
    bins: int = 20_000,
) -> DataFrame:
    """Summary of the cosine matrix with a zero diagonal: (statistic, value) rows.

    Mean and deviation follow from the sums and products of the vectors themselves. The entries next to each
    quantile are found by a histogram over all pairs and a second one around the bins that hold
    them, to within ``4 / bins ** 2``, and interpolated; a task returns its histogram, never entries. All pairs are placed in
    bins in single precision; those the second one counts, and the ends, are computed in double.
    """
    units = settle(_units(df, row_id, vector))
    rows = units.count()

    def moments(batches):
        for frame in batches:
            if len(frame):
                m = _matrix(frame["vec"])
                yield pd.DataFrame({"total": [m.sum(axis=0)], "gram": [(m.T @ m).reshape(-1)], "ones": [float((m * m).sum())], "fourth": [float(((m * m).sum(axis=1) ** 2).sum())]})

    parts = units.mapInPandas(moments, "total array<double>, gram array<double>, ones double, fourth double")
    summed = parts.agg(  # a few numbers per dimension, whatever the rows
        Summarizer.sum(array_to_vector("total")).alias("t"), Summarizer.sum(array_to_vector("gram")).alias("g"),
        F.sum("ones").alias("ones"), F.sum("fourth").alias("fourth"),
    ).first()
    n = float(rows) ** 2
    s = float((summed["t"].toArray() ** 2).sum()) - summed["ones"]
    q = float((summed["g"].toArray() ** 2).sum()) - summed["fourth"]

    width = len(summed["t"])
    low, scale = LOWEST, bins / (HIGHEST - LOWEST)
    # single precision places an entry within a fraction of a bin; what lies next to a quantile is computed again in double
    kind = np.float32 if (width + 4) * 2.0**-23 * scale < 0.25 else np.float64
    error = (width + 4) * 2.0**-23 + 4e-7  # the second for the place in the bins

    def placed(x, y, same):
        """Places of the tiles' entries in bins, with the double rows and columns of the tile; a pair of rows once."""
        a = _finite(_matrix(x["vec"]))
        b = a if same else _finite(_matrix(y["vec"]))
        left, right = a.astype(kind), b.astype(kind)
        for i in range(0, len(a), TILE_ROWS):
            for j in range(i - i % TILE_COLS if same else 0, len(b), TILE_COLS):
                tile = left[i : i + TILE_ROWS] @ right[j : j + TILE_COLS].T
                shape, kept = tile.shape, None
                if same and j < i + shape[0]:  # on the diagonal, or left of it
                    kept = np.flatnonzero(np.arange(j, j + shape[1]) > np.arange(i, i + shape[0])[:, None])
                    tile = tile.reshape(-1)[kept]
                if tile.size:
                    tile *= kind(scale)
                    tile -= kind(low * scale)
                    yield tile.reshape(-1), kept, a[i : i + TILE_ROWS], b[j : j + TILE_COLS]

    def coarse(x, y, same):
        held, least, most = np.zeros(bins, np.int64), np.inf, -np.inf
        for tile, kept, a, b in placed(x, y, same):
            held += np.bincount(tile.astype(np.intp), minlength=bins)
            first, last = tile.min() / scale + low, tile.max() / scale + low
            if (least > -1 + 1e-9 and first < least + error) or (most < 1 - 1e-9 and last > most - error):
                exact = (a @ b.T).reshape(-1)
                exact = exact if kept is None else exact[kept]
                least, most = min(least, exact.min()), max(most, exact.max())
        at = np.flatnonzero(held)
        return pd.DataFrame({"bin": at, "n": 2 * held[at], "lo": least, "hi": most})

    table = self_blocks(units, coarse, "bin long, n long, lo double, hi double", 4).groupBy("bin").agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    ).collect()  # a row a bin
    least = min([0.0, *[round(r["lo"], 12) for r in table]])
    most = max([0.0, *[round(r["hi"], 12) for r in table]])
    counts = np.zeros(bins, np.int64)
    counts[[r["bin"] for r in table]] = [r["n"] for r in table]
    zero = int((0.0 - low) * scale)
    counts[zero] += rows  # the zeros of the diagonal
    ranks = sorted({f(p * (n - 1)) for p in probs for f in (math.floor, math.ceil)}) if rows else []
    middle = dict(zip(ranks, np.searchsorted(np.cumsum(counts), ranks, side="right").clip(0, bins - 1).tolist()))
    # the bin of a rank and the ones beside it, for entries that single precision puts there
    firsts = sorted({k - 1 for k in middle.values()})
    cut = 3 * bins  # finer bins in them
    near = np.zeros(bins, bool)
    for k in firsts:
        near[max(k, 0) : k + 3] = True

    def fine(x, y, same):
        below, held = np.zeros(len(firsts), np.int64), [[] for _ in firsts]
        counted = [np.zeros(cut, np.int64) for _ in firsts]

        def count(k):
            if held[k]:
                counted[k] += np.bincount(np.concatenate(held[k]), minlength=cut)
                held[k].clear()

        for tile, kept, a, b in placed(x, y, same):
            found = np.flatnonzero(near[tile.astype(np.intp)])
            bin_of, place = tile[found], found if kept is None else kept[found]
            value = np.einsum("ij,ij->i", a[place // len(b)], b[place % len(b)])
            for k, first in enumerate(firsts):
                below[k] += np.count_nonzero(tile < first)
                mine = value[(bin_of >= first) & (bin_of < first + 3)]
                held[k].append(np.clip((mine - low - first / scale) * scale * (cut / 3), 0, cut - 1).astype(np.int64))
                if len(held[k]) >= 64:
                    count(k)
        frames = []
        for k in range(len(firsts)):
            count(k)
            at = np.flatnonzero(counted[k])
            frames.append(pd.DataFrame({"range": k, "bin": np.append(at, -1), "n": 2 * np.append(counted[k][at], below[k])}))
        return pd.concat(frames)

    value = {}
    if ranks:
        table = self_blocks(units, fine, "range long, bin long, n long", 4).groupBy("range", "bin").agg(F.sum("n").alias("n")).collect()  # ranges x bins
        finer = [np.zeros(cut + 1, np.int64) for _ in firsts]
        for r in table:
            finer[r["range"]][r["bin"] + 1] += r["n"]
        for k, first in enumerate(firsts):
            at = min(max((0.0 - low - first / scale) * scale * (cut / 3), 0), cut - 1)
            finer[k][0 if zero < first else int(at) + 1] += rows if zero < first + 3 else 0
        for rank, k in middle.items():
            first = k - 1
            at = int(np.searchsorted(np.cumsum(finer[firsts.index(first)]), rank, side="right"))
            value[rank] = low + (first + (min(max(at, 1), cut) - 0.5) * 3 / cut) / scale
    out = [
        ("count", n), ("mean", s / n), ("std", math.sqrt(max(0.0, (q - s * s / n) / max(n - 1, 1)))),
        ("min", float(least)), ("max", float(most)),
    ]
    for p in probs:
        at = p * (n - 1)
        a, b = value[math.floor(at)], value[math.ceil(at)]
        out.append((f"q{p:.2f}", a + (b - a) * (at - math.floor(at))))
    return df.sparkSession.createDataFrame(out, "statistic string, value double")


def _best(ask_ids, ask_matrix, ids, matrix, k: int) -> pd.DataFrame:
    """The k best rows per query, by comparing all."""
    step = max(1, MATRIX_ENTRIES // max(len(ids), 1))
    parts = []
    for lo in range(0, len(ask_ids), step):
        scores = np.round(ask_matrix[lo : lo + step] @ matrix.T, 9)
        if scores.shape[1] > k:
            floor = np.partition(scores, -k, axis=1)[:, -k]
            asked, at = np.nonzero(scores >= floor[:, None])
        else:
            asked, at = (i.reshape(-1) for i in np.indices(scores.shape))
        parts.append(pd.DataFrame({"query": ask_ids[lo + asked], "row": ids[at], "score": scores[asked, at]}))
    return _cut(pd.concat(parts), k)


def _slabs(batches, values: int):
    """(ids, unit vectors) of the rows of many batches, some ``values`` numbers at a time."""
    ids, rows, held = [], [], 0
    for batch in batches:
        if not len(batch):
            continue
        ids.append(batch["id"].to_numpy())
        rows.append(_matrix(batch["vec"]))
        held += rows[-1].size
        if held >= values:
            yield np.concatenate(ids), np.concatenate(rows)
            ids, rows, held = [], [], 0
    if ids:
        yield np.concatenate(ids), np.concatenate(rows)


def _leaves(matrix: np.ndarray, rows: int = LEAF_ROWS) -> list[np.ndarray]:
    """Row numbers in leaves of near rows: halves along the widest axis, down to ``rows`` rows."""
    out, todo = [], [np.arange(len(matrix))]
    while todo:
        at = todo.pop()
        if len(at) <= rows:
            out.append(at)
            continue
        part = matrix[at]
        order = np.argpartition(part[:, np.argmax(np.var(part, axis=0))], len(at) // 2)
        todo += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]
    return out


def _without_copies(ids: np.ndarray, matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows with one vector, which tie for every query, the k smallest ids."""
    _, same, times = np.unique(matrix, axis=0, return_inverse=True, return_counts=True)
    if times.max() <= k:
        return ids, matrix
    order = pd.DataFrame({"same": same.reshape(-1), "id": ids}).sort_values(["same", "id"])
    kept = order.groupby("same", sort=False).head(k).index.to_numpy()
    return ids[kept], matrix[kept]


def _main_axes(matrix: np.ndarray) -> np.ndarray:
    return np.linalg.eigh(np.cov(matrix, rowvar=False).reshape(matrix.shape[1], -1))[1][:, ::-1][:, :AXES]


def _boxed(low: np.ndarray, high: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Per box and point the largest cosine that a row of the box can have; both lie along the main axes."""
    gap = np.zeros((len(points), len(low)))
    for a, at in enumerate(points.T):
        beside = np.maximum(low[:, a] - SLACK - at[:, None], at[:, None] - high[:, a] - SLACK)
        gap += np.square(np.maximum(beside, 0, out=beside), out=beside)
    return np.ascontiguousarray((1 + SLACK - gap / 2).T)


def nearest_rows(
    ask_ids: np.ndarray, asks: np.ndarray, ids: np.ndarray, matrix: np.ndarray, k: int, floors: np.ndarray | None = None
) -> tuple[pd.DataFrame, int]:
    """The k best rows per query among vectors of length one (or zero), and how many pairs were compared.

    Rows lie in leaves, and a leaf in a box along the main axes. A query meets the nearest leaf first; a leaf whose
    box is too far from the query for its k-th score so far is left out, which loses nothing. ``floors`` are k-th scores the
    queries have among other rows; rows below them are left out too.
    """
    if len(ids) <= 2 * LEAF_ROWS or not (np.isfinite(matrix).all() and np.isfinite(asks).all()):
        return _best(ask_ids, asks, ids, matrix, k), len(ask_ids) * len(ids)
    ids, matrix = _without_copies(ids, matrix, k)
    axes = _main_axes(matrix)
    turned = matrix @ axes
    leaves = _leaves(turned)
    held = [matrix[at] for at in leaves]
    low = np.stack([turned[at].min(axis=0) for at in leaves])
    high = np.stack([turned[at].max(axis=0) for at in leaves])
    step, compared, parts = max(1, MATRIX_ENTRIES // len(leaves)), 0, []
    for lo in range(0, len(ask_ids), step):
        some = asks[lo : lo + step]
        most = _boxed(low, high, some @ axes)
        top = np.full((len(some), k), -np.inf)
        floor = np.full(len(some), -np.inf) if floors is None else floors[lo : lo + step].copy()
        found = []

        def meet(leaf, asked):
            scores = some[asked] @ held[leaf].T
            reached = scores >= (floor[asked] - SLACK)[:, None]
            row, at = np.nonzero(reached)
            found.append((asked[row], leaves[leaf][at], np.round(scores[row, at], 9)))
            better = np.flatnonzero(reached.any(axis=1))
            both = np.concatenate([top[asked[better]], np.round(scores[better], 9)], axis=1)
            top[asked[better]] = np.partition(both, -k, axis=1)[:, -k:]
            floor[asked[better]] = np.maximum(floor[asked[better]], top[asked[better]].min(axis=1))
            return scores.size

        own = np.argmax(most, axis=0)
        order = np.argsort(own, kind="stable")
        order = order[most[own[order], order] >= floor[order]]
        for asked in np.split(order, np.flatnonzero(np.diff(own[order])) + 1) if len(order) else ():
            compared += meet(own[asked[0]], asked)
        for leaf in range(len(leaves)):
            asked = np.flatnonzero((most[leaf] >= floor) & (own != leaf))
            if len(asked):
                compared += meet(leaf, asked)
        if not found:
            continue
        asked, at, score = (np.concatenate(c) for c in zip(*found))
        last = score >= floor[asked]
        parts.append(_cut(pd.DataFrame({"query": ask_ids[lo + asked[last]], "row": ids[at[last]], "score": score[last]}), k))
    return (pd.concat(parts) if parts else _no_rows()), compared


def _no_rows() -> pd.DataFrame:
    return pd.DataFrame({"query": [], "row": [], "score": np.zeros(0)})


def _cuts(points: np.ndarray, cells: int) -> list[tuple[int, float, int, int]]:
    """A tree of (axis, cut, below, above) over sampled points, halves along the widest axis; ~c is cell c."""
    tree, todo = [], [(points, cells, 0, None)]
    while todo:
        some, n, first, parent = todo.pop()
        if parent is not None:
            at, side = parent
            tree[at][side] = len(tree) if n > 1 else ~first
        if n > 1:
            axis = int(np.argmax(np.var(some, axis=0))) if len(some) else 0
            cut = float(np.quantile(some[:, axis], (n // 2) / n)) if len(some) else 0.0
            below = some[:, axis] <= cut
            tree.append([axis, cut, None, None])
            todo += [(some[below], n // 2, first, (len(tree) - 1, 2)), (some[~below], n - n // 2, first + n // 2, (len(tree) - 1, 3))]
    return [tuple(node) for node in tree]


def _cell_numbers(points: np.ndarray, tree: list[tuple[int, float, int, int]]) -> np.ndarray:
    out, todo = np.zeros(len(points), np.int64), [(0, np.arange(len(points)))] if tree else []
    while todo:
        node, at = todo.pop()
        if node < 0:
            out[at] = ~node
        elif len(at):
            axis, cut, below, above = tree[node]
            under = points[at, axis] <= cut
            todo += [(below, at[under]), (above, at[~under])]
    return out


def _names(column: pa.ChunkedArray) -> np.ndarray:
    plain = column.null_count == 0 and not pa.types.is_nested(column.type)
    return column.to_numpy() if plain else pd.Series(column.to_pylist(), dtype=object).to_numpy()


def _bytes(matrix: np.ndarray) -> pa.Array:
    """Rows of doubles as binary values."""
    size = matrix.shape[1] * 8
    ends = np.arange(len(matrix) + 1, dtype=np.int64) * size
    data = np.ascontiguousarray(matrix, dtype=np.float64)
    return pa.Array.from_buffers(pa.large_binary(), len(matrix), [None, pa.py_buffer(ends), pa.py_buffer(data)]).cast(pa.binary())


def _rows(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, width)


class _Near:
    """Corpus rows dealt into cells of near rows, for queries too many to go to every task.

    Cells are cut along the main axes of a sample, which only shapes them. A query meets its own cell first. The k-th score it
    finds there is a floor, and only cells whose box a row at the floor can lie in are met then, so nothing is lost
    and a task returns no rows below the floor.
    """

    def __init__(self, asks: DataFrame, docs: DataFrame, kinds: tuple[str, str], width: int, k: int, cell_rows: int):
        self.kinds, self.width, self.k = kinds, width, k
        spark, rows, many = docs.sparkSession, docs.count(), asks.count()
        cores = int(spark.sparkContext.defaultParallelism)
        cells = max(1, math.ceil(rows / cell_rows), min(4 * cores, math.ceil(rows / (32 * LEAF_ROWS))))
        wanted = max(20_000, 64 * cells)
        some = docs.select("vec") if rows <= wanted else docs.select("vec").sample(False, wanted / rows, 42)
        sample = [r["vec"] for r in some.collect()]
        sample = _matrix(sample) if sample else np.zeros((0, width))
        sample = sample[np.isfinite(sample).all(axis=1)]
        self.axes = _main_axes(sample) if len(sample) > 1 else np.eye(width)[:, :AXES]
        tree = _cuts(sample @ self.axes, cells) if cells > 1 else []
        laid = settle(self._dealt(docs, tree, kinds[1]))
        # a cell of many rows, such as those of one vector, is split again
        held = {r["cell"]: r["n"] for r in laid.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        split = [max(1, math.ceil(held.get(c, 0) / (2 * cell_rows))) for c in range(cells)]
        first = np.concatenate([[0], np.cumsum(split)]).tolist()
        numbered = F.get(F.lit(first), F.col("cell").cast("int")) + F.pmod(F.xxhash64("id", "vec"), F.get(F.lit(split), F.col("cell").cast("int")))
        parts = max(1, math.ceil(many * width / ASK_VALUES))
        part = F.pmod(F.xxhash64("id"), F.lit(parts))
        docs_in = laid.withColumn("cell", numbered.cast("long"))
        self.docs = docs_in.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>")))
        self.asks = self._dealt(asks, tree, kinds[0]).withColumn("cell", numbered.cast("long")).withColumn("part", part).withColumn("floor", F.lit(float("-inf")))

    def _dealt(self, df: DataFrame, tree: list, kind: str) -> DataFrame:
        axes, width = self.axes, self.width

        def deal(batches):
            for batch in batches:
                values = batch.column("vec").flatten().to_numpy(zero_copy_only=False)
                units = _units_of(values.reshape(batch.num_rows, -1).astype(np.float64)) if batch.num_rows else np.zeros((0, width))
                cell = pa.array(_cell_numbers(units @ axes, tree))
                yield pa.RecordBatch.from_arrays([cell, batch.column("id"), _bytes(units)], names=["cell", "id", "vec"])

        return df.mapInArrow(deal, f"cell long, id {kind}, vec binary")

    def found(self) -> DataFrame:
        """(query, row, score): the k best rows of every query, among others."""
        query, row = self.kinds
        axes, width, k = self.axes, self.width, self.k
        both = f"query {query}, row {row}, score double"

        def search(names, asks, docs):
            floors, ids = asks["floor"].to_numpy(), _names(docs["id"])
            if not len(ids) or not len(names):
                return _no_rows()
            return nearest_rows(names, _rows(asks["vec"], width), ids, _rows(docs["vec"], width), k, floors)[0]

        def column(values, like):
            return pa.array(values, like["id"].type, from_pandas=True)

        def own(key, docs, asks):
            got = search(np.arange(len(asks)), asks, docs)  # ids may repeat, so places stand for them
            at, scores = got["query"].to_numpy(np.int64), got["score"].to_numpy(np.float64)
            floors = np.full(len(asks), np.inf)
            np.minimum.at(floors, at, scores)
            floors[(np.bincount(at, minlength=len(asks)) < k) | ~np.isfinite(floors)] = -np.inf
            points = _rows(docs["vec"], width) @ axes
            names = asks["id"].combine_chunks()
            out = [
                {"query": names.take(pa.array(at)), "row": column(got["row"], docs), "score": pa.array(scores)},
                {"query": names, "vec": asks["vec"].combine_chunks(), "floor": pa.array(floors)},
            ]
            if len(points):
                out.append({"low": pa.array([points.min(axis=0).tolist()]), "high": pa.array([points.max(axis=0).tolist()])})
            for kind, given in enumerate(out):
                n = len(next(iter(given.values())))
                given |= {"kind": pa.array([kind] * n, pa.int32()), "cell": pa.array([key[0].as_py()] * n, pa.int64()), "part": pa.array([key[1].as_py()] * n, pa.int64())}
                out[kind] = pa.table({f.name: given.get(f.name, pa.nulls(n, f.type)) for f in columns(docs, asks)})
            return pa.concat_tables(out)

        def columns(docs, asks):
            real, numbers = pa.float64(), pa.list_(pa.float64())
            kinds = {"kind": pa.int32(), "cell": pa.int64(), "part": pa.int64(), "query": asks["id"].type, "row": docs["id"].type, "score": real,
                     "vec": asks["vec"].type, "floor": real, "low": numbers, "high": numbers}
            return pa.schema(list(kinds.items()))

        schema = f"kind int, cell long, part long, query {query}, row {row}, score double, vec binary, floor double, low array<double>, high array<double>"
        first = settle(self.docs.groupBy("cell", "part").cogroup(self.asks.groupBy("cell", "part")).applyInArrow(own, schema))
        boxes = first.where("kind = 2").groupBy("cell").agg(F.first("low").alias("low"), F.first("high").alias("high")).collect()  # a row a cell
        if not boxes:
            return first.where("kind = 0").select("query", "row", "score")
        numbers = np.array([b["cell"] for b in boxes])
        low, high = np.array([b["low"] for b in boxes]), np.array([b["high"] for b in boxes])
        open_cells = ~np.isfinite(low + high).all(axis=1)

        def reach(batches):
            step = max(1, ASK_VALUES // (width * len(numbers)))
            for whole in batches:
                for batch in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                    units, floors = _rows(batch.column("vec"), width), batch.column("floor").to_numpy(zero_copy_only=False)
                    most = np.nan_to_num(_boxed(low, high, units @ axes), nan=2.0)
                    met = (most >= floors) | open_cells[:, None] | ~np.isfinite(units).all(axis=1)
                    met &= numbers[:, None] != batch.column("cell").to_numpy()
                    cell, at = np.nonzero(met)
                    taken = batch.select(["part", "query", "vec", "floor"]).take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array(numbers[cell]), *taken.columns], names=["cell", "part", "id", "vec", "floor"])

        sent = first.where("kind = 1").select("cell", "part", "query", "vec", "floor").mapInArrow(reach, f"cell long, part long, id {query}, vec binary, floor double")

        def others(docs, asks):
            got = search(_names(asks["id"]), asks, docs)
            return pa.table({"query": column(got["query"], asks), "row": column(got["row"], docs), "score": pa.array(got["score"], pa.float64())})

        further = self.docs.groupBy("cell", "part").cogroup(sent.groupBy("cell", "part")).applyInArrow(others, both)
        return first.where("kind = 0").select("query", "row", "score").unionByName(further)


def top_k(
    queries: DataFrame,
    corpus: DataFrame,
    query_id: str,
    query_vector: str,
    row_id: str,
    vector: str,
    k: int,
    block_rows: int | None = None,
    broadcast_values: int = 40_000,
) -> DataFrame:
    """The ``k`` corpus rows with the largest cosine per query: (query, row, score, rank).

    While the query vectors hold at most ``broadcast_values`` numbers they go to every task
    as one matrix and the corpus is not shuffled; a query leaves out the leaves of near rows that cannot
    reach its k-th score (``nearest_rows``). Past that both sides meet in cells of near rows, ``block_rows`` or so each,
    and a query in those only that can hold one of its best (``_Near``).
    Either way a task keeps only its k best per query. Scores are rounded to nine places
    before ranking and ties go to the smaller id.
    """
    asks = queries.select(F.col(query_id).alias("id"), F.col(query_vector).alias("vec"))
    docs = corpus.select(F.col(row_id).alias("id"), F.col(vector).alias("vec"))
    schema = f"query {dict(asks.dtypes)['id']}, row {dict(docs.dtypes)['id']}, score double"

    first = asks.first()
    width = len(first["vec"]) if first else 1
    limit = max(1, broadcast_values // width)
    few = asks.collect() if asks.count() <= limit else None
    if few is not None:
        ask_ids = np.array([r["id"] for r in few])
        shared = corpus.sparkSession.sparkContext.broadcast(
            (ask_ids, _matrix([r["vec"] for r in few]))
        )

        def scan(batches):
            names, matrix = shared.value
            held = None
            for ids, rows in _slabs(batches, MATRIX_ENTRIES):
                found, _ = nearest_rows(names, matrix, ids, rows, k)
                held = found if held is None else _cut(pd.concat([held, found]), k)
            if held is not None:
                yield held

        local = docs.mapInPandas(scan, schema)
    else:
        kinds = (dict(asks.dtypes)["id"], dict(docs.dtypes)["id"])
        local = _Near(kept(asks, queries), kept(docs, corpus), kinds, width, k, block_rows or max(1, CELL_VALUES // width)).found()
    return top_per_group(local, ["query"], [F.desc("score"), F.asc("row")], k)


def _cut(found: pd.DataFrame, k: int) -> pd.DataFrame:
    ordered = found.sort_values(["query", "score", "row"], ascending=[True, False, True])
    return ordered.groupby("query", sort=False).head(k)


def ranked(df: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """Full ranking of each group, best first."""
    return running(df, keys, [F.col(score).desc(), F.col(tie)], position="rank")
