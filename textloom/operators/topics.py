"""Topic models and text clusters over sparse (doc, term) rows, packed into cells.

Nothing of the size of the vocabulary or of the corpus leaves the executors: the driver sees one number per topic
or cluster. Models start from stated values, so SQL can follow every step.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.cells import Cells, added, slices
from textloom.scale import Salted, kept, release, settle

TINY = 1e-100
# The asymptotic series of the digamma function in 1 / y^2.
SERIES = (-1 / 12, 1 / 120, -1 / 252, 1 / 240)
SHIFT = 6


def digamma(x: Column) -> Column:
    """The logarithmic derivative of the gamma function for positive ``x``, to about ten places."""
    y = x + SHIFT
    square = 1.0 / (y * y)
    tail = F.lit(0.0)
    for c in reversed(SERIES):
        tail = (tail + c) * square
    steps = sum((1.0 / (x + i) for i in range(SHIFT)), F.lit(0.0))
    return F.log(y) - 0.5 / y + tail - steps


@dataclass
class Topics:
    """``terms`` (term, t0, t1, ...): the weight of every term in every topic; ``documents`` (doc, g0, g1, ...):
    how much of a document each topic has, the prior included."""

    terms: DataFrame
    documents: DataFrame
    topics: int
    alpha: float

    def _shares(self, table: DataFrame, key: str, letter: str) -> DataFrame:
        names = [f"{letter}{i}" for i in range(self.topics)]
        total = sum((F.col(n) for n in names), F.lit(0.0))
        return table.select(key, F.array(*[F.col(n) / total for n in names]).alias("distribution"))

    def distributions(self) -> DataFrame:
        """(doc, distribution): the share of each topic."""
        return self._shares(self.documents, "doc", "g")

    def term_shares(self) -> DataFrame:
        """(topic, term, weight): the share of each term in each topic."""
        names = [f"t{i}" for i in range(self.topics)]
        totals = _totals(self.terms, names)
        cells = F.array(*[F.col(n) / F.lit(total) for n, total in zip(names, totals)])
        return self.terms.select("term", F.posexplode(cells).alias("topic", "weight")).select("topic", "term", "weight")


def _totals(table: DataFrame, names: list[str]) -> list[float]:
    """One sum per topic, all that comes to the driver."""
    row = table.agg(*[F.sum(n) for n in names]).first()
    return [float(v or 0.0) for v in row]


def drawn_start(term: Column, topic: int, seed: int = 42) -> Column:
    """A first weight between 0.5 and 1.5 by a hash of the term and the topic."""
    return 0.5 + F.pmod(F.xxhash64(term, F.lit(seed), F.lit(topic)), F.lit(1000)) / 1000.0


def _expected_terms(terms: DataFrame, topics: int) -> DataFrame:
    names = [f"t{i}" for i in range(topics)]
    totals = _totals(terms, names)
    return terms.select("term", *[
        F.exp(digamma(F.col(n)) - digamma(F.lit(max(total, TINY)))).alias(f"b{i}") for i, (n, total) in enumerate(zip(names, totals))
    ])


def _expected_documents(documents: DataFrame, topics: int) -> DataFrame:
    names = [f"g{i}" for i in range(topics)]
    whole = digamma(sum((F.col(n) for n in names), F.lit(0.0)))
    return documents.select("doc", *[F.exp(digamma(F.col(n)) - whole).alias(f"e{i}") for i, n in enumerate(names)])


def _portions(tf: np.ndarray, e: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The count of each entry dealt over the topics."""
    weight = e * b
    return tf[:, None] * weight / (weight.sum(axis=1, keepdims=True) + TINY)


def packed(entries: DataFrame, value: str = "tf", nulls: bool = False, grouped: bool = False) -> Cells:
    """The entries (doc, term, value) in cells that hold whole documents, for ``lda``, ``transform`` and ``sparse_kmeans``.

    ``grouped`` entries are those of ``tf_idf``, which has each document's together.
    """
    return Cells(entries.select(F.col("doc").alias("row"), F.col("term").alias("col"), F.col(value).alias("value")), nulls=nulls, grouped=grouped)


def documents_of(cells: Cells) -> DataFrame:
    """(doc): the documents with an entry."""
    return cells.table.where("piece = 0").select(F.explode("rows").alias("doc"))


def _as_col(table: DataFrame) -> DataFrame:
    return table.withColumnRenamed("term", "col")


def _first_documents(table: DataFrame, topics: int, alpha: float) -> DataFrame:
    share = F.lit(alpha) + F.sum("tf") / topics
    return table.groupBy("doc").agg(*[share.alias(f"g{i}") for i in range(topics)])


def lda(counts: DataFrame, topics: int = 25, rounds: int = 10, alpha: float | None = None, eta: float | None = None,
        start: Callable[[Column, int], Column] = drawn_start, cells: Cells | None = None) -> Topics:
    """Latent Dirichlet allocation by variational updates over all entries (doc, term, tf).

    Each round sends the expected topic weights of terms and documents to the cells that hold them, deals every count
    over the topics there, and adds the portions up by document and by term in one pass. ``alpha`` and ``eta`` are the priors,
    one over the number of topics by default; ``start`` gives the first weight of a term in a topic, and a document starts
    with even shares, which leave its first portions to the terms. ``cells`` are those of ``packed(counts)`` where they are there already.
    """
    alpha, eta = alpha or 1.0 / topics, eta or 1.0 / topics
    table = kept(counts.select("doc", "term", F.col("tf").cast("double").alias("tf")), counts)
    terms = settle(table.select("term").distinct().select("term", *[start(F.col("term"), i).cast("double").alias(f"t{i}") for i in range(topics)]))
    if not rounds:
        return Topics(terms, settle(_first_documents(table, topics, alpha)), topics, alpha)
    own = cells or packed(table)

    def deal(at_row, at_col, tf, e, b):
        by_row, by_col = np.zeros((len(e), topics)), np.zeros((len(b), topics))
        for part in slices(len(tf), topics):
            shares = _portions(tf[part], e[at_row[part]] if e.shape[1] else np.ones(1), b[at_col[part]])
            by_row += added(at_row[part], shares, len(e))
            by_col += added(at_col[part], shares, len(b))
        return by_row, by_col

    documents, last = None, None
    for _ in range(rounds):
        known = None if documents is None else _expected_documents(documents, topics).withColumnRenamed("doc", "row")
        found, parts, both = own.meet(deal, (topics, topics), known, _as_col(_expected_terms(terms, topics)))
        older, documents = terms, found.select(F.col("row").alias("doc"), *[(F.lit(alpha) + F.col(f"s{i}")).alias(f"g{i}") for i in range(topics)])
        terms = settle(parts.groupBy(F.col("col").alias("term")).agg(*[(F.lit(eta) + F.sum(f"s{i}")).alias(f"t{i}") for i in range(topics)]))
        release(older, last)
        last = both
    if cells is None:
        own.release()
    return Topics(terms, documents, topics, alpha)


def transform(model: Topics, counts: DataFrame, rounds: int = 10, cells: Cells | None = None) -> Topics:
    """The topics of other documents: their shares after ``rounds`` updates, the terms' weights fixed.

    Terms that the model does not know are left out; a document without a known term has no row. ``cells`` as in ``lda``.
    """
    k = model.topics
    expected = settle(_expected_terms(model.terms, k))
    if not rounds:
        met = Salted(counts.select("doc", "term", F.col("tf").cast("double").alias("tf")), ["term"]).join(expected.select("term"))
        return Topics(model.terms, settle(_first_documents(met, k, model.alpha)), k, model.alpha)
    own = cells or packed(counts)

    def deal(at_row, at_col, tf, e, b):
        by_row = np.zeros((len(e), k + 1))
        for part in slices(len(tf), k):
            known = b[at_col[part]]
            shares = _portions(tf[part], e[at_row[part]] if e.shape[1] else np.ones(1), known[:, :k])
            by_row += added(at_row[part], np.column_stack([shares, known[:, k]]), len(e))
        return by_row, None

    documents, last = None, None
    for _ in range(rounds):
        now = None if documents is None else _expected_documents(documents, k).withColumnRenamed("doc", "row")
        found, _, both = own.meet(deal, (k + 1, 0), now, _as_col(expected).withColumn("known", F.lit(1.0)))
        documents = found.where(F.col(f"s{k}") > 0).select(
            F.col("row").alias("doc"), *[(F.lit(model.alpha) + F.col(f"s{i}")).alias(f"g{i}") for i in range(k)]
        )
        release(last)
        last = both
    if cells is None:
        own.release()
    release(expected)
    return Topics(model.terms, documents, k, model.alpha)


# -- clusters of sparse rows -----------------------------------------------------------------


def sparse_kmeans(weights: DataFrame, starts: DataFrame, rounds: int = 10, cells: Cells | None = None) -> DataFrame:
    """(doc, cluster_id) after Lloyd steps over (doc, term, weight) rows from stated documents (cluster_id, doc).

    The entries are packed in cells of whole documents. A round sends each cell the centres' weights of its terms, as a column
    per cluster, and brings back each document's cluster and the cell's sums by term and cluster. Gains are rounded to nine
    places and ties go to the smaller number; a centre without documents stays where it is. The names of the first documents and
    the sizes of the centres and clusters, some numbers per cluster, come to the driver. ``cells`` are those of
    ``packed(weights, "weight", nulls=True)`` where they are there already.
    """
    table = weights.select("doc", "term", "weight") if cells else kept(weights.select("doc", "term", "weight"), weights)
    chosen = table.where(F.col("doc").isin([r["doc"] for r in starts.select("doc").distinct().collect()]))
    first = settle(Salted(chosen, ["doc"]).join(starts.select("doc", "cluster_id")).select("cluster_id", "term", "weight"))
    sizes = {r["cluster_id"]: r["size"] for r in first.groupBy("cluster_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("size")).collect()}
    ids = sorted(sizes)
    if not ids:
        return table.select("doc", F.lit(0).alias("cluster_id")).limit(0)
    names = [f"c{i}" for i in range(len(ids))]
    centres = settle(first.groupBy("term").agg(*[F.sum(F.when(F.col("cluster_id") == c, F.col("weight")).otherwise(0.0)).alias(n) for c, n in zip(ids, names)]))
    cells, given = cells or packed(table, "weight", nulls=True), cells
    named = cells.places[0].where("row is not null").select("row", F.lit(1.0).alias("named"))  # a null doc has a cluster but moves none

    def passed(moving: bool):
        size = np.array([sizes[c] for c in ids])

        def nearest(at_row, at_col, weight, is_named, centre):
            dots = np.zeros((len(is_named), len(ids)))
            for part in slices(len(weight), len(ids)):
                dots += added(at_row[part], weight[part, None] * centre[at_col[part]], len(is_named))
            own = np.argmax(np.round(2 * dots - size, 9), axis=1)
            if not moving:
                return own[:, None].astype(float), None
            at, worth = at_col.astype(np.int64) * len(ids) + own[at_row], weight * is_named[at_row, 0]
            sums = np.bincount(at, weights=worth, minlength=len(centre) * len(ids)).reshape(-1, len(ids))
            return own[:, None].astype(float), sums

        return cells.meet(nearest, (1, len(ids) if moving else 0), named, _as_col(centres))

    for _ in range(rounds):
        members, sums, both = passed(True)
        n = {int(r["s0"]): r["n"] for r in members.groupBy("s0").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per cluster
        moved = sums.groupBy(F.col("col").alias("term")).agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(len(ids))])
        step = centres.withColumnRenamed("term", "_term").join(moved.hint("merge"), F.col("_term").eqNullSafe(F.col("term")), "full")
        fresh = [(F.coalesce(f"s{i}", F.lit(0.0)) / F.lit(float(n[i])) if n.get(i) else F.coalesce(c, F.lit(0.0))).alias(c) for i, c in enumerate(names)]
        older, centres = centres, settle(step.select(F.coalesce("term", "_term").alias("term"), *fresh))
        square = centres.agg(*[F.sum(F.col(c) * F.col(c)).alias(c) for c in names]).first()
        sizes = {c: square[n_] or 0.0 for c, n_ in zip(ids, names)}
        release(older, both)
    members, _, _ = passed(False)
    numbered = F.array(*[F.lit(int(c)) for c in ids])
    out = members.select(F.col("row").alias("doc"), F.element_at(numbered, (F.col("s0") + 1).cast("int")).cast("int").alias("cluster_id"))
    if given is None:
        cells.release()
    return out
