"""Near duplicates by SimHash fingerprints met in a grid of segment popcounts.

A fingerprint's 21 segments of three bits (the last of four) give a vector of popcounts. One flipped bit moves the vector
by one step, so the Manhattan distance of two vectors is at most the Hamming distance of their
fingerprints. Vectors within distance 2 share a grid point at distance 1 or 0 of both: each
fingerprint visits its own point and its neighbours, and only those that met another one go on.
They meet again on the finest grid, of 1-bit segments, where at most 65 fingerprints share a point and
any two of them differ in at most 2 bits; links run from the smallest of a point and are verified.
No pairs of a group are formed, so a group of any size costs as many rows as it has fingerprints.

Texts whose shingles are equal to four fifths differ in some ten bits, beyond any popcount grid. ``keep_similar``
therefore takes further fingerprints, of a few shingles drawn alike from every text: similar texts agree in one of
them. What met there or in the grid is verified by the similarity of all shingles. Members of a draw first meet three of its
members; all pairs of a draw that this leaves in different groups are decided afterwards, in cells of bounded size, and never as rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_hexdigest, xxh64_intdigest

from textloom.llm.names import fresh
from textloom.operators.graphs import components
from textloom.scale import Salted, fit_broadcast, fits, salted_join, settle

SEED = 42
WORDS = 3
MOST_BITS = 2
CHUNK = 1 << 16
SEGMENTS = 21
SIMILAR_WORDS = 5
SIMILARITY = 0.8
DRAWS = 12
DRAWN = 3
CELL = 2048
CELL_SHINGLES = 2_000_000
DENSE_SHARE = 256
COLUMNS = 512
PAIRS_AT_ONCE = 4_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)
DRAW_SEEDS = np.arange(1, DRAWS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
FIELD_ONES = sum(1 << 3 * i for i in range(SEGMENTS))


def hash_chunks(text: str | None, words_per_shingle: int) -> Iterator[np.ndarray]:
    """The unsigned hashes of a text's shingles in order, some thousand at a time; none for a text without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(words) - words_per_shingle + 1)
    lo, hi = starts[:n].tolist(), ends[-n:].tolist()
    for at in range(0, n, CHUNK):
        hashes = [xxh64_intdigest(line[a:b], SEED) for a, b in zip(lo[at : at + CHUNK], hi[at : at + CHUNK])]
        yield np.array(hashes, "<u8")


def majority(hashes: np.ndarray, axis: int = 0) -> tuple[np.ndarray, int]:
    """How often each of the 64 bits is set along an axis, and out of how many."""
    bits = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(*hashes.shape, 8), axis=-1, bitorder="little")
    return bits.sum(axis=axis, dtype=np.int64), hashes.shape[axis]


def fingerprint(text: str | None, words_per_shingle: int = WORDS) -> int:
    """The signed 64-bit fingerprint of a whole text.

    A-Z are lowered, words end at ASCII white space, repeated shingles count each time. A text with
    fewer words is one shingle; one without words (or null) has the fingerprint zero.
    """
    return vote(hash_chunks(text, words_per_shingle))


def vote(chunks: Iterable[np.ndarray]) -> int:
    """The signed fingerprint of hashes: the bits set in over half of them."""
    votes, n = np.zeros(64, np.int64), 0
    for hashes in chunks:
        ones, many = majority(hashes)
        votes, n = votes + ones, n + many
    return int(np.packbits(2 * votes > n, bitorder="little").view("<i8")[0])


def draw(distinct: np.ndarray, seeds: np.ndarray = DRAW_SEEDS) -> list[int]:
    """One signed fingerprint per seed, each of the few hashes that come first in an order of that seed.

    The order depends on seed and hash alone, so two texts draw the same hashes about as often as the power
    ``DRAWN`` of their similarity. Fewer hashes are all drawn; none give zeros.
    """
    if not len(distinct):
        return [0] * len(seeds)
    picks = []
    for seed in seeds:
        order = (distinct ^ seed) * MIX
        order = (order ^ order >> np.uint64(29)) * MIX
        picks.append(distinct[np.argpartition(order, DRAWN - 1)[:DRAWN]] if len(distinct) > DRAWN else distinct)
    ones, n = majority(np.stack(picks), axis=1)
    return np.packbits(2 * ones > n, axis=1, bitorder="little").view("<i8")[:, 0].tolist()


def fingerprints(df: DataFrame, text: str, name: str = "fingerprint") -> DataFrame:
    """``df`` without ``text`` and with its fingerprint as a long."""
    rest = [c for c in df.columns if c not in (text, name)]
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest)

    def run(batches):
        for batch in batches:
            found = pa.array([fingerprint(t.as_py()) for t in batch.column(len(rest))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], found], names=[*rest, name])

    return df.select(*rest, text).mapInArrow(run, f"{fields}{', ' if fields else ''}`{name}` long")


def popcount_vector(fp: Column) -> Column:
    """The segment popcounts as 3-bit fields of a long, each one higher by 1.

    Twenty segments have 3 bits and the last has 4, so a neighbour's fields stay within 0 to 6.
    """
    ones = F.lit(FIELD_ONES)
    counts = ones + F.shiftleft(F.shiftrightunsigned(fp, 63), 3 * (SEGMENTS - 1))
    for k in range(3):
        counts = counts + F.shiftrightunsigned(fp, k).bitwiseAND(ones)
    return counts


def vector_points(vector: Column) -> Column:
    """The vector and its neighbours at Manhattan distance 1."""
    steps = [0] + [sign * (1 << 3 * i) for i in range(SEGMENTS) for sign in (1, -1)]
    return F.array(*[vector + F.lit(s).cast("long") for s in steps])


def bit_points(fp: Column) -> Column:
    """The fingerprint and those one bit away."""
    flips = [F.lit(0).cast("long")] + [F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long") for i in range(64)]
    return F.array(*[fp.bitwiseXOR(f) for f in flips])


def links(prints: DataFrame, fp: str = "fingerprint") -> DataFrame:
    """(src, dst) between distinct fingerprints at most 2 bits apart, enough to connect all that are."""
    distinct = prints.select(F.col(fp).alias("fp")).distinct()
    coarse = settle(distinct.select("fp", F.explode(vector_points(popcount_vector(F.col("fp")))).alias("point")))
    shared = coarse.groupBy("point").agg(F.min("fp").alias("_lo"), F.max("fp").alias("_hi")).where("_lo <> _hi")
    met = coarse.join(shared.select("point"), "point", "left_semi").select("fp").distinct()
    fine = met.select("fp", F.explode(bit_points(F.col("fp"))).alias("point"))
    stars = fine.groupBy("point").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    edges = stars.select(F.array_min("fps").alias("src"), F.explode("fps").alias("dst")).where("src <> dst").distinct()
    return edges.where(F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= MOST_BITS)


def groups(rows: DataFrame, key: str, fp: str = "fingerprint") -> DataFrame:
    """``rows`` with ``root`` (the smallest fingerprint reachable) and ``component_id`` (the smallest key).

    Null keys are no candidates for the smallest; a group of null keys only has a null component.
    ``rows`` must be a settled table.
    """
    edges = settle(links(rows, fp))
    linked = components(edges).select(F.col("id").alias(fp), F.col("component").alias("root"))
    prints = rows.groupBy(fp).agg(F.min(key).alias("_first"), F.count(F.lit(1)).alias("_n"))
    rooted = settle(prints.join(linked, fp, "left").withColumn("root", F.coalesce("root", fp)))
    least = rooted.groupBy("root").agg(F.min("_first").alias("component_id"))
    single = (F.col("_n") == 1) & (F.col("root") == F.col(fp)) & F.col("component_id").eqNullSafe(F.col("_first"))
    # rows alone in their group name themselves; only the others are looked up
    wanted = settle(rooted.join(least, "root").where(~single).select(fp, "root", "component_id"))
    heavy = rooted.select(fp, "_n")
    found = Salted(rows, [fp], counts=heavy).join(wanted, "left")
    return found.select(
        *rows.columns, F.coalesce("root", fp).alias("root"),
        F.when(F.col("root").isNull(), F.col(key)).otherwise(F.col("component_id")).alias("component_id"),
    )


def near_duplicates(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, fingerprint long, root, component_id): one row per row of ``df``, copies included.

    Rows with equal fingerprints are one group; a null or empty text has fingerprint zero. An empty
    table gives no rows; other columns are not read, and may have any name.
    """
    return groups(settle(fingerprints(df.select(key, text), text)), key)


def keep_one(df: DataFrame, key: str, text: str) -> DataFrame:
    """``df`` without near duplicates: the row with the smallest key of each group stays whole.

    Null keys come last; rows with equal keys are told apart by a hash of all their columns, and
    of rows equal in every column one stays.
    """
    hashed, mark = _marked(df)
    prints = settle(fingerprints(hashed.select(key, mark, text), text))
    best = groups(prints, key).groupBy("root").agg(F.min(_order(key, mark)).alias("_best"))
    return _chosen_rows(hashed, prints, best, key, mark)


def _marked(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` with a hash of all its columns, and that column's name."""
    (mark,) = fresh(df, "_mark")
    return df.withColumn(mark, F.xxhash64(*[F.to_json(F.struct(c)) if _nested(df, c) else F.col(c) for c in df.columns])), mark


def _order(key: str, mark: str) -> Column:
    return F.struct(F.col(key).isNull(), F.col(key).alias("k"), F.col(mark).alias("m"))


def _chosen_rows(hashed: DataFrame, rows: DataFrame, best: DataFrame, key: str, mark: str) -> DataFrame:
    """The rows of ``hashed`` named by ``_best`` (k and m), each once; ``rows`` holds key and mark of all."""
    of, twin_of = fresh(hashed, "_of", "_twin_of")
    chosen = settle(best.select(F.col("_best.k").alias(of), F.col("_best.m").alias(twin_of)))
    same = F.col(key).eqNullSafe(F.col(of)) & (F.col(mark) == F.col(twin_of))
    twins = settle(
        rows.groupBy(key, mark).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        .join(chosen, same, "left_semi").select(F.col(key).alias(of), F.col(mark).alias(twin_of))
    )
    kept = hashed.join(chosen, same, "left_semi")  # one row per group: as many as the result has
    if not twins.isEmpty():
        twin = fit_broadcast(twins)
        kept = kept.join(twin, same, "left_anti").unionByName(
            kept.join(twin, same, "left_semi").dropDuplicates([key, mark])
        )
    return kept.drop(mark)


def draws(df: DataFrame, text: str, words_per_shingle: int = SIMILAR_WORDS) -> DataFrame:
    """``df`` without ``text`` and with ``same`` (a digest of its words), ``size`` (its distinct shingles), its fingerprint and its drawn ones."""
    rest = [c for c in df.columns if c != text]
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest)

    def run(batches):
        for batch in batches:
            same, sizes, prints, drawn = [], [], [], []
            for cell in batch.column(len(rest)):
                value = cell.as_py()
                hashes = list(hash_chunks(value, words_per_shingle))
                same.append(xxh3_128_hexdigest(b" ".join((value or "").encode().lower().split())))
                prints.append(vote(hashes))
                distinct = np.unique(np.concatenate(hashes)) if hashes else np.empty(0, np.uint64)
                sizes.append(len(distinct))
                drawn.append(draw(distinct))
            found = [pa.array(same), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), pa.array(drawn, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(rest)], *found], names=[*rest, "same", "size", "fingerprint", "drawn"]
            )

    return df.select(*rest, text).mapInArrow(run, f"{fields}, same string, size long, fingerprint long, drawn array<long>")


def shingle_sets(df: DataFrame, key: str, text: str, words_per_shingle: int = SIMILAR_WORDS) -> DataFrame:
    """(key, shingles): the distinct shingle hashes of every text."""

    def run(batches):
        for batch in batches:
            sets, first = [], 0
            for at, cell in enumerate(batch.column(1)):
                hashes = list(hash_chunks(cell.as_py(), words_per_shingle))
                sets.append(np.unique(np.concatenate(hashes)).view("<i8") if hashes else np.empty(0, np.int64))
                if at + 1 == batch.num_rows or sum(map(len, sets)) >= CHUNK:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(first, len(sets)), pa.array(sets, pa.list_(pa.int64()))], names=[key, "shingles"]
                    )
                    sets, first = [], at + 1

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, shingles array<long>")


def candidates(classes: DataFrame, near: DataFrame) -> DataFrame:
    """(src, dst): ids of ``classes`` (id, spot, fingerprint, drawn) that met in a draw or in the popcount grid.

    ``near`` holds the ``links`` of their fingerprints.

    Those that share a draw meet three of its members and not each other, so a group costs three rows a member and draw:
    the first and the last in an order of the draw's own, and the one that shares most draws with others. ``spot`` is a
    hash of the text; it makes the order.
    """
    points = classes.select("id", "spot", F.posexplode("drawn").alias("turn", "point"))
    order = F.xxhash64("spot", "turn")
    shared = settle(
        points.groupBy("turn", "point")
        .agg(F.min_by("id", order).alias("lo"), F.max_by("id", order).alias("hi"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
    )
    counts = shared.select("turn", "point", "_n")
    met = settle(Salted(points, ["turn", "point"], counts=counts).join(shared))
    weight = met.groupBy("id").agg(F.sum("_n").alias("weight"))
    # the text that others are copies of shares most draws
    middle = met.join(weight, "id").groupBy("turn", "point").agg(F.max_by("id", F.struct("weight", "spot")).alias("mid"))
    centred = Salted(met.select("turn", "point", "id"), ["turn", "point"], counts=counts).join(settle(middle))
    drawn = met.select(F.explode(F.array("lo", "hi")).alias("src"), F.col("id").alias("dst")).unionByName(
        centred.select(F.col("mid").alias("src"), F.col("id").alias("dst"))
    )
    first = settle(
        classes.groupBy("fingerprint").agg(F.min_by("id", "spot").alias("src"), F.count(F.lit(1)).alias("_n"))
    )
    equal = Salted(classes.select("id", "fingerprint"), ["fingerprint"], counts=first.select("fingerprint", "_n")).join(
        first.where("_n > 1").drop("_n")
    )
    ends = [first.select(F.col("fingerprint").alias(end), F.col("src").alias(f"{end}_id")) for end in ("src", "dst")]
    grid = salted_join(salted_join(near, ends[0], ["src"]), ends[1], ["dst"])
    return (
        drawn.unionByName(equal.select("src", F.col("id").alias("dst")))
        .unionByName(grid.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst")))
        .where("src <> dst").distinct()
    )


def parted_cells(classes: DataFrame, near: DataFrame, linked: DataFrame) -> DataFrame:
    """(turn, point, x, y, part, id, root, size): the members of ``classes`` (id, size, fingerprint, drawn) that share a draw, a fingerprint
    or a point of the 1-bit grid with one of another group, dealt over cells.

    ``near`` holds the ``links`` of the fingerprints, ``linked`` (id, component) names the groups found so far. A draw's
    members are dealt over parts of about ``CELL`` members and ``CELL_SHINGLES`` shingles at most, and every two parts (x <= y) meet in a cell, so no
    task holds a large group.
    """
    named = settle(classes.join(linked, "id", "left").withColumn("root", F.coalesce("component", "id")))
    spots = named.select("id", "root", "size", F.posexplode(F.concat("drawn", F.array("fingerprint"))).alias("turn", "point"))
    ends = settle(near.select(F.explode(F.array("src", "dst")).alias("fingerprint")).distinct())
    grid = salted_join(named, ends, ["fingerprint"], "left_semi")
    spots = spots.unionByName(grid.select("id", "root", "size", F.lit(-1).alias("turn"), F.explode(bit_points(F.col("fingerprint"))).alias("point")))
    sides = F.ceil(F.greatest(F.count(F.lit(1)) / CELL, F.sum("size") / CELL_SHINGLES)).cast("int")
    parted = settle(
        spots.groupBy("turn", "point")
        .agg(F.min("root").alias("_lo"), F.max("root").alias("_hi"), F.count(F.lit(1)).alias("_n"), sides.alias("sides"))
        .where("_lo <> _hi").select("turn", "point", "_n", "sides")
    )
    met = Salted(spots, ["turn", "point"], counts=parted.select("turn", "point", "_n")).join(parted.drop("_n"))
    part, other = F.pmod(F.xxhash64("id"), F.col("sides")).cast("int"), F.col("other")
    every = met.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    cell = [F.least("part", other).alias("x"), F.greatest("part", other).alias("y")]
    return every.select("turn", "point", *cell, "part", "id", "root", "size")


def parted_pairs(classes: DataFrame, near: DataFrame, linked: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(src, dst): every pair of ``parted_cells`` of different groups, as rows; sizes so far apart that the similarity is
    out of reach never link."""
    dealt = settle(parted_cells(classes, near, linked))
    cell = ["turn", "point", "x", "y"]
    left = dealt.select(*cell, F.col("id").alias("src"), F.col("root").alias("_r"), F.col("size").alias("_s"), F.col("part").alias("_p"))
    pairs = left.join(dealt.withColumnRenamed("id", "dst").hint("merge"), cell)
    reach = F.least("_s", "size") >= F.lit(similarity) * F.greatest("_s", "size")
    across = (F.col("x") == F.col("y")) | (F.col("_p") != F.col("part"))
    return pairs.where((F.col("src") < F.col("dst")) & (F.col("_r") != F.col("root")) & across & reach).select("src", "dst").distinct()


def parted_links(cells: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(src, dst): links between members of different groups, enough to connect all that are similar.

    ``cells`` are ``parted_cells`` and ``sets`` (id, shingles) their texts. All pairs of a cell are decided in the task that holds it, by the
    common shingles of its two parts as one table of counts; a cell returns fewer links than twice its members, so no pairs become rows.
    """
    whole = salted_join(cells.select("turn", "point", "x", "y", "part", "id", "root"), sets, ["id"])
    kinds = pa.schema([("src", pa.int64()), ("dst", pa.int64())])

    def decide(table: pa.Table) -> pa.Table:
        x, part = table.column("x")[0].as_py(), table.column("part").to_numpy()
        ids, roots = table.column("id").to_numpy(), table.column("root").to_numpy()
        shingles = table.column("shingles").combine_chunks()
        sizes = pa.compute.list_value_length(shingles).to_numpy(zero_copy_only=False)
        owner, hashes = np.repeat(np.arange(len(ids)), sizes), shingles.flatten().to_numpy()
        mine = np.flatnonzero(part == x)
        others = mine if table.column("y")[0].as_py() == x else np.flatnonzero(part != x)
        common = common_counts(owner, hashes, mine, others, len(ids))
        union = sizes[mine][:, None] + sizes[others][None, :] - common
        alike = (common >= similarity * np.maximum(union, 1) - 1e-6) & (roots[mine][:, None] != roots[others][None, :])
        a, b = np.nonzero(alike)
        alike[a, b] = common[a, b] / union[a, b] >= similarity
        pairs = spanning_pairs(alike)
        return pa.table([pa.array(ids[mine[pairs[:, 0]]]), pa.array(ids[others[pairs[:, 1]]])], schema=kinds)

    return whole.groupBy("turn", "point", "x", "y").applyInArrow(decide, "src long, dst long").distinct()


def common_counts(owner: np.ndarray, hashes: np.ndarray, mine: np.ndarray, others: np.ndarray, n: int) -> np.ndarray:
    """How many hashes each row of ``mine`` has in common with each of ``others``; ``owner`` names the row of every hash.

    Frequent hashes are counted by matrix products of some hundred columns each, the others by their few pairs.
    """
    common = np.zeros((len(mine), len(others)), np.float32)
    place = np.full((2, n), -1)
    place[0, mine], place[1, others] = np.arange(len(mine)), np.arange(len(others))
    values, column = np.unique(hashes, return_inverse=True)
    sides = []
    for at in place:
        here = at[owner] >= 0
        order = np.argsort(column[here], kind="stable")
        sides.append((at[owner][here][order], column[here][order]))
    many = [np.bincount(c, minlength=len(values)) for _, c in sides]
    product = many[0] * many[1]
    dense = product * DENSE_SHARE > common.size
    starts = [np.cumsum(m) - m for m in many]
    columns = np.flatnonzero(dense)
    for at in range(0, len(columns), COLUMNS):
        chosen = np.full(len(values), -1)
        chosen[columns[at : at + COLUMNS]] = np.arange(len(columns[at : at + COLUMNS]))
        flags = []
        for (rows, cols), size in zip(sides, common.shape):
            held = chosen[cols] >= 0
            flag = np.zeros((size, COLUMNS), np.float32)
            flag[rows[held], chosen[cols[held]]] = 1
            flags.append(flag)
        common += flags[0] @ flags[1].T
    rare = np.flatnonzero(~dense & (product > 0))
    flat = common.reshape(-1)
    ends = np.cumsum(product[rare])
    at = 0
    while at < len(rare):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
        some = rare[at:stop]
        of = np.repeat(some, product[some])
        step = np.arange(len(of)) - np.repeat(np.cumsum(product[some]) - product[some], product[some])
        left = sides[0][0][starts[0][of] + step // many[1][of]]
        right = sides[1][0][starts[1][of] + step % many[1][of]]
        found, times = np.unique(left * len(others) + right, return_counts=True)
        flat[found] += times
        at = stop
    return common.astype(np.int64)


def spanning_pairs(alike: np.ndarray) -> np.ndarray:
    """Pairs (row, column) of a table of links that connect what all its links connect, each row and column found once."""
    new_rows, new_columns = alike.any(axis=1), alike.any(axis=0)
    pairs = []
    for first in np.flatnonzero(new_rows).tolist():
        if not new_rows[first]:
            continue
        new_rows[first] = False
        ahead = [(first, True)]
        while ahead:
            at, is_row = ahead.pop()
            new = new_columns if is_row else new_rows
            found = np.flatnonzero((alike[at] if is_row else alike[:, at]) & new)
            new[found] = False
            pairs += [(at, k) if is_row else (k, at) for k in found.tolist()]
            ahead += [(k, not is_row) for k in found.tolist()]
    return np.array(pairs, np.int64).reshape(-1, 2)


def similar_pairs(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (src, dst) whose ``sets`` (id, shingles) have at least this share of their union in common."""
    left = sets.select(F.col("id").alias("src"), F.col("shingles").alias("_a"))
    right = sets.select(F.col("id").alias("dst"), F.col("shingles").alias("_b"))
    both = salted_join(pairs, left, ["src"]).join(right, "dst")
    common = F.size(F.array_intersect("_a", "_b"))
    return both.where(common / (F.size("_a") + F.size("_b") - common) >= similarity).select("src", "dst")


def keep_similar(
    df: DataFrame, key: str, text: str, words_per_shingle: int = SIMILAR_WORDS, similarity: float = SIMILARITY
) -> DataFrame:
    """``df`` with one row of each group of texts linked by the similarity of their distinct shingles.

    Texts of equal words (A-Z lowered, any white space between them) are one class; null and texts without words are the
    same one. Of a group the row with the smallest key stays whole. Null keys come last; rows with equal keys are told apart by a hash of
    all their columns, and of rows equal in every column one stays. An empty table stays empty; other columns may have any name.
    """
    hashed, mark = _marked(df)
    names = [F.col(key).alias("k"), F.col(mark).alias("m"), F.col(text).alias("text")]
    marked = hashed.select(*names)
    rows = settle(draws(marked, "text", words_per_shingle))
    # written once, so the numbers stay as they are
    classes = settle(
        rows.groupBy("same")
        .agg(F.min(_order("k", "m")).alias("_best"), *[F.first(c).alias(c) for c in ("size", "fingerprint", "drawn")])
        .select(
            F.monotonically_increasing_id().alias("id"), F.xxhash64("same").alias("spot"), "_best", "size", "fingerprint", "drawn"
        )
    )
    def sets_of(ids: DataFrame) -> DataFrame:
        wanted = settle(
            ids.join(classes.select("id", "_best"), "id").select("id", F.col("_best.k").alias("of"), F.col("_best.m").alias("by"))
        )
        if fits(wanted):
            wanted = F.broadcast(wanted)
        met = marked.join(wanted, F.col("k").eqNullSafe(F.col("of")) & (F.col("m") == F.col("by")))
        return settle(shingle_sets(met, "id", "text", words_per_shingle).dropDuplicates(["id"]))

    near = settle(links(classes))
    first = settle(candidates(classes, near))
    ids = first.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    edges = settle(similar_pairs(first, sets_of(ids), similarity))
    linked = settle(components(edges).select("id", "component"))
    cells = settle(parted_cells(classes, near, linked))
    if not cells.isEmpty():
        more = settle(parted_links(cells, sets_of(cells.select("id").distinct()), similarity))
        if not more.isEmpty():
            linked = components(edges.unionByName(more)).select("id", "component")
    best = (
        classes.join(linked, "id", "left").groupBy(F.coalesce("component", "id").alias("root"))
        .agg(F.min("_best").alias("_best"))
    )
    return _chosen_rows(hashed, rows.select(F.col("k").alias(key), F.col("m").alias(mark)), best, key, mark)


def _nested(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName() in ("map", "variant")
