"""Building blocks that keep one hot key, source or bucket from landing in one task.

``settle``       cuts lineage by a table in the shared checkpoint folder.
``on_disk``      keeps rows where they are dealt, for steps that need them dealt so.
``running``      exact row numbers and running sums inside groups of any size.
``neighbourhood`` row frames (lead, lag, moving average) over block halos.
``top_per_group`` / ``best_per_group``  partial cuts below the shuffle.
``Salted``       an equi join whose heavy keys are spread over several tasks.
``fit_broadcast`` a broadcast hint that is only given after measuring the side.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20
ROWS_PER_TASK = 1_000_000

_WRITTEN: set[str] = set()


def scratch_path(spark: SparkSession) -> str:
    """A fresh path in the folder the cluster shares through spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="textloom-")  # one process, one machine: nobody else reads it
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/textloom-{uuid.uuid4().hex}"
    _WRITTEN.add(path)
    return path


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The plan after it starts at files that survive the loss of an executor, and the
    optimizer sees real sizes. The tables stay until ``release`` or ``release_all``.
    """
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def kept(df: DataFrame, source: DataFrame) -> DataFrame:
    """``df``, a projection of ``source``, settled unless that is a settled table itself."""
    return df if getattr(source, "_scratch", None) in _WRITTEN else settle(df)


_ON_DISK: list[DataFrame] = []


def on_disk(df: DataFrame) -> DataFrame:
    """``df`` kept on the executors' disks until ``release_all``, dealt as it is: a table read back would have to be dealt again.

    A lost part is computed again from what ``df`` reads.
    """
    held = df.persist(StorageLevel.DISK_ONLY)
    _ON_DISK.append(held)
    return held


def _delete(spark: SparkSession, path: str) -> None:
    jvm, context = spark.sparkContext._jvm, spark.sparkContext._jsc
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context.hadoopConfiguration()).delete(target, True)
    _WRITTEN.discard(path)


def release(*tables: DataFrame | None) -> None:
    """Delete settled tables that no later plan reads, such as those of an earlier round."""
    for table in tables:
        path = getattr(table, "_scratch", None)
        if path in _WRITTEN:
            _delete(table.sparkSession, path)


def release_all(spark: SparkSession) -> None:
    """Delete every table this process has settled, once the results are written elsewhere."""
    while _ON_DISK:
        _ON_DISK.pop().unpersist()
    for path in list(_WRITTEN):
        _delete(spark, path)


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan dealt over all cores when it has fewer splits than there are cores.

    A table of many files or row groups is left as it is, so nothing is shuffled at scale.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt evenly over all cores, before a step that takes long for each row.

    A file of few row groups fills few tasks, however many splits its scan has.
    """
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)


def _row_bytes(df: DataFrame) -> Column:
    """Rough size of a row, by type for numbers and by content for the rest."""
    total = F.lit(0).cast("long")
    for field in df.schema.fields:
        kind = field.dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            width = F.octet_length(F.col(field.name))
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
            width = F.size(F.col(field.name)) * 8
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            width = F.octet_length(F.to_json(F.struct(F.col(field.name))))
        else:
            width = F.lit(8)
        total = total + F.coalesce(width, F.lit(0)) + 8
    return total


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` stays under both bounds, by one distributed aggregate."""
    found = df.select(_row_bytes(df).alias("b")).agg(F.count(F.lit(1)), F.sum("b")).first()
    return found[0] <= rows and (found[1] or 0) <= size


def fit_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint when its rows and bytes are within bounds, else with one for a sorted join.

    The optimizer would go by the size of files, in which equal values take little room, and by plans that take no
    account of exploded rows; it may send a large table through the driver.
    """
    return F.broadcast(df) if fits(df, rows) else df.hint("merge")


def _columns(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    sums: dict[str, str] | None = None,
    position: str = "pos",
) -> DataFrame:
    """Add the 1-based position of each row in its group and inclusive running sums.

    ``order`` must be unique inside a group; ``sums`` maps a new column to the column
    it accumulates. Rows are range partitioned on (keys, order), so a hot group covers
    many partitions; only one row per group and partition enters the window that adds
    up the partition totals.
    """
    sums = sums or {}
    keys = list(keys)
    spread = _columns(keys) + _columns(order)
    laid = settle(
        df.repartitionByRange(*spread)
        .sortWithinPartitions(*spread)
        .withColumn("_row", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_row", 33))
    cut = [*keys, "_part"]
    heads = laid.groupBy(*cut).agg(
        F.min("_row").alias("_first"),
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(src).alias(f"_total_{name}") for name, src in sums.items()],
    )
    earlier = W.partitionBy(*(keys or [F.lit(0)])).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    heads = heads.select(
        *[F.col(c).alias(f"_h{i}") for i, c in enumerate(cut)],
        "_first",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        *[
            F.coalesce(F.sum(f"_total_{name}").over(earlier), F.lit(0)).alias(f"_before_{name}")
            for name in sums
        ],
    )
    # without keys one row per shuffle partition
    heads = fit_broadcast(settle(heads)) if keys else F.broadcast(heads)
    inside = W.partitionBy(*cut).orderBy("_row").rowsBetween(W.unboundedPreceding, 0)
    for name, src in sums.items():
        laid = laid.withColumn(f"_in_{name}", F.sum(src).over(inside))
    same = F.lit(True)
    for i, c in enumerate(cut):
        same = same & F.col(c).eqNullSafe(F.col(f"_h{i}"))
    return laid.join(heads, same).select(
        *df.columns,
        (F.col("_row") - F.col("_first") + F.col("_before") + 1).cast("long").alias(position),
        *[(F.col(f"_in_{name}") + F.col(f"_before_{name}")).alias(name) for name in sums],
    )


def neighbourhood(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    before: int,
    after: int,
    exprs: dict[str, Column],
    block: int = 10_000,
) -> DataFrame:
    """Evaluate frame expressions over ``before`` rows back to ``after`` rows ahead.

    ``position`` is the dense 1-based row number inside the group. Each group is cut
    into blocks that overlap by the frame, so no window holds more than
    ``block + before + after`` rows. ``exprs`` maps names to aggregate columns.
    """
    at = F.col(position) - 1
    first = F.greatest(F.floor((at - after) / block), F.lit(0))
    last = F.floor((at + before) / block)
    own = F.floor(at / block)
    copies = df.withColumn("_block", F.explode(F.sequence(first, last)))
    frame = W.partitionBy(*keys, "_block").orderBy(position).rowsBetween(-before, after)
    framed = copies.select("*", *[expr.over(frame).alias(name) for name, expr in exprs.items()])
    return framed.where(F.col("_block") == own).drop("_block")


MERGE_ROWS = 200_000


def top_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    rank: str = "rank",
) -> DataFrame:
    """First ``k`` rows of each group. ``order`` must be total.

    Up to the optimizer's group-limit threshold the cut runs before the shuffle; past it the groups are
    first cut inside each partition's rows. Where the partitions' survivors of one group could pass
    ``MERGE_ROWS`` they meet in about the root of that many buckets first.
    """
    spark = df.sparkSession
    limit = int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stages = []
    if k > limit:
        stages.append(F.spark_partition_id())
    if k * partitions > MERGE_ROWS:
        stages.append(F.pmod(F.spark_partition_id(), F.lit(math.isqrt(partitions))))
    for bucket in stages:
        cut = W.partitionBy(*keys, "_slice").orderBy(*order)
        df = (
            df.withColumn("_slice", bucket)
            .withColumn("_local", F.row_number().over(cut))
            .where(F.col("_local") <= k)
            .drop("_slice", "_local")
        )
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(
        F.col(rank) <= k
    )


def best_per_group(df: DataFrame, keys: Sequence[str], smallest: Sequence[Column]) -> DataFrame:
    """The row of each group with the smallest ``smallest`` tuple, by a partial aggregate."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.struct(*smallest)).alias("_best"))
        .select(*keys, *[F.col(f"_best.{c}").alias(c) for c in rest])
        .select(*df.columns)
    )


def _is_scan(df: DataFrame) -> bool:
    """Whether reading ``df`` again costs no more than a scan with projections and filters."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return not any(node in plan for node in ("Join", "Aggregate", "Window", "Generate", "MapIn", "FlatMap", "Sort", "Repartition"))


class Salted:
    """A large side prepared for one or many equi joins on the same columns.

    A side that fits is broadcast and nothing of the large side moves. Otherwise heavy keys,
    those with more than ``rows_per_task`` rows, take one of several salts and the matching
    rows of the other side are repeated once per salt. There are at most
    ``rows / rows_per_task`` heavy keys. They are looked up once, when first needed, or
    taken from ``counts`` (the key columns and ``_n``).
    """

    def __init__(self, big: DataFrame, on: Sequence[str], counts: DataFrame | None = None,
                 rows_per_task: int = ROWS_PER_TASK, broadcast_rows: int = BROADCAST_ROWS):
        self.big, self.on, self.counts = big, list(on), counts
        self.rows_per_task, self.broadcast_rows = rows_per_task, broadcast_rows
        self.heavy: DataFrame | None = None
        self.salted: DataFrame | None = None

    def _prepare(self) -> None:
        counts = self.counts
        if counts is None:
            if not _is_scan(self.big):
                self.big = settle(self.big)  # it is read for the counts and for the join
            counts = self.big.groupBy(*self.on).agg(F.count(F.lit(1)).alias("_n"))
        self.heavy = settle(
            counts.where(F.col("_n") > self.rows_per_task).select(
                *self.on, F.ceil(F.col("_n") / self.rows_per_task).cast("int").alias("_salts")
            )
        )
        if self.heavy.isEmpty():
            return
        # written once: the salt follows the row's place, so equal copies of a row part too,
        # and a re-run task cannot deal them anew
        place = F.xxhash64(F.monotonically_increasing_id())
        self.salted = settle(
            self.big.join(fit_broadcast(self.heavy), self.on, "left")
            .withColumn("_salt", F.pmod(place, F.coalesce("_salts", F.lit(1))).cast("int"))
            .drop("_salts")
        )

    def join(self, small: DataFrame, how: str = "inner") -> DataFrame:
        """Any join that keeps or drops rows of the large side (inner, left, semi, anti)."""
        if fits(small, self.broadcast_rows):
            return self.big.join(F.broadcast(small), self.on, how)
        if self.heavy is None:
            self._prepare()
        small = small.hint("merge")  # measured as too large, whatever the optimizer takes it for
        if self.salted is None:
            return self.big.join(small, self.on, how)
        copies = (
            small.join(fit_broadcast(self.heavy), self.on, "left")
            .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
            .drop("_salts")
        )
        return self.salted.join(copies.hint("merge"), [*self.on, "_salt"], how).drop("_salt")


def salted_join(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", **options) -> DataFrame:
    """One join of a large side, spread over its heavy keys where needed."""
    return Salted(big, on, **options).join(small, how)


PART_BYTES = 64 << 20


def concat_parts(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, joiner: str, part_bytes: int = PART_BYTES
) -> DataFrame:
    """The texts of each group joined in order, as rows (keys, part, text).

    ``order`` must be unique inside a group. A group's text is cut into consecutive parts before the piece
    that begins at or past each multiple of ``part_bytes``, so a row stays near that size however long
    the group is; the parts in order, joined by ``joiner``, are the whole text. Places are numbered from the
    lengths alone, the texts move once.
    """
    keys, order = list(keys), list(order)
    sized = df.select(*keys, *order, (F.octet_length(text) + F.lit(len(joiner.encode()))).alias("_size"))
    placed = running(sized, keys, order, {"_end": "_size"}, position="_pos")
    names = [f"_k{i}" for i in range(len(keys) + len(order))]
    part = F.floor((F.col("_end") - F.col("_size")) / part_bytes).cast("int").alias("part")
    placed = placed.select(*[F.col(c).alias(n) for c, n in zip(keys + order, names)], part)
    same = F.lit(True)
    for c, n in zip(keys + order, names):
        same = same & F.col(c).eqNullSafe(F.col(n))
    pieces = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_text"))))
    return (
        df.join(placed, same).groupBy(*keys, "part").agg(pieces.alias("_pieces"))
        .select(*keys, "part", F.array_join(F.transform("_pieces", lambda p: p["_text"]), joiner).alias(text))
    )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, tie: str, probs: Sequence[float]
) -> DataFrame:
    """Interpolated quantiles by row position: one row per group and probability."""
    numbered = running(df.select(*keys, value, tie).where(F.col(value).isNotNull()), keys, [value, tie])
    sizes = numbered.groupBy(*keys).agg(F.max("pos").alias("n"))
    want = sizes.select(
        *keys, "n", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("q")
    ).withColumn("at", F.col("q") * (F.col("n") - 1))
    want = want.withColumn("lo", F.floor("at") + 1).withColumn("hi", F.ceil("at") + 1)
    ask = want.select(*keys, "q", "at", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("pos"))
    got = numbered.join(fit_broadcast(ask), [*keys, "pos"])
    return got.groupBy(*keys, "q").agg(
        (
            F.min_by(value, "pos")
            + (F.max_by(value, "pos") - F.min_by(value, "pos")) * F.max(F.col("at") - F.floor("at"))
        ).alias("quantile")
    )
