"""Packed cells against plain sums."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.cells import Cells, added
from textloom.operators import features, graphs


def entries(spark):
    rows = [(f"r{i % 23}" if i % 11 else None, f"c{i * 7 % 19}", i % 5 + 0.5) for i in range(900)]
    return spark.createDataFrame(rows, "row string, col string, value double"), rows


@pytest.mark.parametrize("square", [False, True])
def test_sums_over_cells_are_those_over_entries(spark, square):
    """Cells of few entries: no entry is lost, and rows stay whole where they should."""
    df, rows = entries(spark)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    cells = Cells(df, square=square, cell_entries=60)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert cells.table.select("cell").distinct().count() > 3
    if not square:
        assert cells.places[0].where(F.size("_at") > 1).isEmpty()
    ask = spark.createDataFrame([(f"c{j}", float(j)) for j in range(19)], "col string, n double")
    by_row, by_col, _ = cells.meet(
        lambda r, c, v, mine, other: (added(r, v[:, None] * other[c], len(mine)), added(c, v[:, None], len(other))), (1, 1), cols=ask
    )
    want = {}
    for r, c, v in rows:
        if r is not None:
            want[r] = want.get(r, 0) + v * int(c[1:])
            want[c] = want.get(c, 0) + v
    got = {r[0]: r[1] for t, k in ((by_row, "row"), (by_col, "col")) for r in t.groupBy(k).agg(F.sum("s0")).collect()}
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want)


def test_entries_said_to_be_grouped_that_are_not(spark):
    df, _ = entries(spark)
    cells = Cells(df.repartition(4, "col"), nulls=True, grouped=True, cell_entries=60)
    assert cells.places[0].where(F.size("_at") > 1).isEmpty()
    held = cells.table.where("piece = 0").select(F.explode("rows").alias("row"))
    assert sorted(r[0] or "" for r in held.collect()) == sorted({r or "" for r in [x["row"] for x in df.collect()]})


def test_terms_are_counted_without_being_shuffled(spark):
    """A document's terms are counted where its text is; a document in two rows is one."""
    df = spark.createDataFrame([(1, "ash elm ash"), (2, "elm"), (1, "elm oak"), (None, "oak")], "id long, text string")
    counts = features.term_counts(df, "id", "text")
    assert sorted(map(tuple, counts.collect()), key=str) == sorted(
        [(1, "ash", 2, 1), (1, "elm", 2, 2), (2, "elm", 1, 2), (1, "oak", 1, 2), (None, "oak", 1, 2)], key=str
    )
    plan = features.tf_idf(counts, 2)._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    assert "Exchange hashpartitioning" not in plan


def test_distances_from_more_sources_than_a_set_has(spark, monkeypatch):
    monkeypatch.setattr(graphs, "SET", 7)
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)], "src long, dst long")
    got = {(r["src"], r["dst"]): r["d"] for r in graphs.distances(edges).collect()}
    assert got == {(a, b): abs(a - b) for a in range(31) for b in range(31)} and graphs.distances(edges).count() == 31 * 31
