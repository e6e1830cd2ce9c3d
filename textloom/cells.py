"""Sparse tables (row, col, value) packed into cells, for steps that meet every entry with numbers of its row and column.

An entry is shuffled once, when its cell is packed. After that a round moves the packed cells, and per cell one row for each
different row or column name in it, instead of every entry with all its numbers twice.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.scale import on_disk, release, settle

CELL_ENTRIES = 2_000_000
PIECE = 100_000  # entries in a row of a packed cell
SLICE = 2_000_000  # numbers that a step holds at once
LEAST = 20_000  # entries below which a further cell does not pay

# of a cell: numbers of the entries' rows and columns, their values, and the numbers sent for its rows and columns;
# returns the numbers of its rows and of its columns, either may be None
Step = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray | None, np.ndarray | None]]


def added(at: np.ndarray, numbers: np.ndarray, size: int) -> np.ndarray:
    """The rows of ``numbers`` added up by ``at``."""
    return np.stack([np.bincount(at, weights=n, minlength=size) for n in numbers.T], axis=1) if len(at) else np.zeros((size, numbers.shape[1]))


def slices(entries: int, numbers: int):
    """Slices of a cell's entries, so that a step with some numbers an entry holds a bounded part of them at once."""
    step = max(1, SLICE // max(numbers, 1))
    return (slice(i, i + step) for i in range(0, entries, step))


def _ints(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32)


def _coded(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Numbers of the values and the different values, null among them."""
    held = column.combine_chunks().dictionary_encode(null_encoding="encode")
    return held.indices.to_numpy(zero_copy_only=False).astype(np.int32), held.dictionary


def _packed(entries: pa.Table, cell: int) -> pa.Table:
    """The rows of one packed cell; the first holds the names."""
    (at_row, rows), (at_col, cols) = _coded(entries["row"]), _coded(entries["col"])
    order, values = np.lexsort((at_col, at_row)), entries["value"].to_numpy()
    starts = range(0, len(order), PIECE)

    def cut(x):
        return pa.array([x[order[i : i + PIECE]].tobytes() for i in starts], pa.binary())

    def once(names):
        return pa.ListArray.from_arrays(pa.array([0] + [len(names)] * len(starts), pa.int32()), names)

    return pa.table({
        "cell": pa.array([cell] * len(starts), pa.int64()), "piece": pa.array(range(len(starts)), pa.int32()),
        "rows": once(rows), "cols": once(cols), "at_row": cut(at_row), "at_col": cut(at_col), "values": cut(values),
    })


def _numbers(table: pa.Table, side: int, size: int, names: list[str]) -> np.ndarray:
    mine = table.filter(pa.compute.equal(table["_side"], side))
    found = np.zeros((size, len(names)))
    at = mine["_pos"].to_numpy()
    for i, n in enumerate(names):
        found[at, i] = mine[n].to_numpy()
    return found


class Cells:
    """``entries`` (row, col, value) as packed cells.

    No number is sent to a null row or column; without ``nulls`` such entries are left out. ``square`` cuts rows and columns
    alike, as a graph needs; otherwise a row is whole in one cell, so its numbers are final when a cell has been passed. ``grouped`` entries come from
    a window over the row, which has them in one task and together; they are not dealt again, which is checked.
    """

    def __init__(self, entries: DataFrame, square: bool = False, nulls: bool = False, grouped: bool = False, cell_entries: int = CELL_ENTRIES):
        table = entries.select("row", "col", F.col("value").cast("double").alias("value"))
        if not nulls:
            table = table.where("row is not null and col is not null")
        self.kinds = {f.name: f.dataType.simpleString() for f in table.schema.fields}
        schema = f"cell long, piece int, rows array<{self.kinds['row']}>, cols array<{self.kinds['col']}>, at_row binary, at_col binary, values binary"
        cores = int(table.sparkSession.sparkContext.defaultParallelism)

        def in_square(key, cell):
            return _packed(cell, key[0].as_py())

        def whole_rows(batches):
            first, done, held = TaskContext.get().partitionId() << 32, 0, None
            for batch in batches:
                held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
                if len(held) >= cell_entries:
                    at = _coded(held["row"])[0]
                    last = int(np.searchsorted(np.cumsum(np.concatenate([[0], np.diff(at) != 0])), len(np.unique(at)) - 1))
                    if last:  # the last row may go on
                        yield from _packed(held.slice(0, last), first + done).to_batches()
                        held, done = held.slice(last).combine_chunks(), done + 1
            if held is not None and len(held):
                yield from _packed(held, first + done).to_batches()

        if square:
            total = table.count()
            grid = math.ceil(math.sqrt(max(math.ceil(total / cell_entries), min(2 * cores, math.ceil(total / LEAST)), 1)))
            cell = F.pmod(F.xxhash64("row"), F.lit(grid)) * grid + F.pmod(F.xxhash64("col"), F.lit(grid))
            packed = table.withColumn("cell", cell.cast("long")).groupBy("cell").applyInArrow(in_square, schema)
        else:
            dealt = table if grouped else table.repartition("row").sortWithinPartitions("row")
            packed = dealt.mapInArrow(whole_rows, schema)
        self.table = settle(packed)
        self.places = [self._placed("rows", "row"), self._placed("cols", "col")]
        if grouped and not square and not self.places[0].where(F.size("_at") > 1).isEmpty():
            release(self.table, *self.places)
            self.table = settle(table.repartition("row").sortWithinPartitions("row").mapInArrow(whole_rows, schema))
            self.places = [self._placed("rows", "row"), self._placed("cols", "col")]
        count = self.table.select("cell").distinct().count()
        # kept on disk where they are met; a lost part is read again from the table
        self.cells = on_disk(self.table.repartition(max(count, min(4 * count, 2 * cores), 1), "cell"))

    def _placed(self, listed: str, name: str) -> DataFrame:
        """(name, at): the cells that hold a row or column, with its number there."""
        names = self.table.where("piece = 0").select("cell", F.posexplode(listed).alias("_pos", name))
        return settle(names.groupBy(name).agg(F.collect_list(F.struct("cell", "_pos")).alias("_at")))

    def release(self) -> None:
        self.cells.unpersist()
        release(self.table, *self.places)

    def meet(self, step: Step, width: tuple[int, int], rows: DataFrame | None = None, cols: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """``step`` over every cell with the numbers of its rows and columns, tables (row, ...) and (col, ...) of doubles.

        ``width`` tells how many numbers ``step`` returns of a row and of a column. The result is (row, s0, s1, ...) and
        (col, s0, s1, ...) with a row per cell that holds the name, and the settled table behind both, for ``release``.
        """
        sent, counts = [], [0, 0]
        for side, (table, name) in enumerate(((rows, "row"), (cols, "col"))):
            if table is not None:
                numbers = [c for c in table.columns if c != name]
                counts[side] = len(numbers)
                met = self.places[side].join(table.hint("merge"), name).select(F.explode("_at").alias("_one"), *numbers)
                sent.append(met.select("_one.cell", F.lit(side).alias("_side"), "_one._pos", *[F.col(c).alias(f"n{i}") for i, c in enumerate(numbers)]))
        most, out = max(counts), max(width)
        sent = [s.select("cell", "_side", "_pos", *[(F.col(f"n{i}") if f"n{i}" in s.columns else F.lit(0.0)).alias(f"n{i}") for i in range(most)]) for s in sent]
        given = reduce(DataFrame.unionByName, sent)
        names, sums = [f"n{i}" for i in range(most)], [f"s{i}" for i in range(out)]

        def run(cell, numbers):
            order = np.argsort(cell["piece"].to_numpy())
            cell = cell.take(pa.array(order))
            first = cell.slice(0, 1)
            keys = [first[c].combine_chunks().flatten() for c in ("rows", "cols")]
            at_row, at_col = _ints(cell["at_row"]), _ints(cell["at_col"])
            values = np.frombuffer(b"".join(cell["values"].to_pylist()), np.float64)
            mine = [_numbers(numbers, side, len(keys[side]), names[: counts[side]]) for side in (0, 1)]
            found = step(at_row, at_col, values, *mine)
            parts = []
            for side, got in enumerate(found):
                if got is not None:
                    columns = {sums[i]: pa.array(got[:, i] if i < got.shape[1] else np.zeros(len(got))) for i in range(out)}
                    empty = pa.nulls(len(got), keys[1 - side].type)
                    pair = {"row": keys[0], "col": empty} if not side else {"row": empty, "col": keys[1]}
                    parts.append(pa.table({"side": pa.array(np.full(len(got), side, np.int32)), **pair, **columns}))
            return pa.concat_tables(parts)

        # every cell there is meets what was sent to it; nothing is sent to others
        kinds = f"side int, row {self.kinds['row']}, col {self.kinds['col']}, " + ", ".join(f"{s} double" for s in sums)
        both = settle(self.cells.groupBy("cell").cogroup(given.groupBy("cell")).applyInArrow(run, kinds))
        out_rows = both.where("side = 0").select("row", *sums[: width[0]])
        return out_rows, both.where("side = 1").select("col", *sums[: width[1]]), both
