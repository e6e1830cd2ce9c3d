"""What each of up to five filters removes, alone, after others and in every order.

A document's failures give a 32-bit word: bit s is set where the document survives the filters of
subset s. The words of a batch are added up by position with carry-save adders, which turn three words of
one weight into one of that weight and one of twice the weight. The survivors of all subsets, per part and
label, answer every question about order: what a filter removes at a step is the difference of two of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.scale import Salted, salted_join, settle

SUBSETS = 32
GROUPS = ("all", "good", "toxic")


def survival_words(failures: np.ndarray) -> np.ndarray:
    """The 32-bit word of every failure mask: bit s is set where mask and s share no filter."""
    subsets = np.arange(SUBSETS)
    table = ((subsets[:, None] & subsets[None, :]) == 0) @ (np.uint64(1) << subsets.astype(np.uint64))
    return table.astype(np.uint32)[failures]


def positional_counts(words: np.ndarray) -> np.ndarray:
    """How many of ``words`` have each of the 32 bits, by carry-save addition.

    Thirds of the words of one weight meet in full adders until at most two are left; the carries are the words of
    the next weight. That is about three bitwise steps a word in all, whatever the bits.
    """
    counts, weight = np.zeros(SUBSETS, np.int64), 0
    positions = np.arange(SUBSETS, dtype=np.uint32)
    while len(words):
        carries = []
        while len(words) > 2:
            third = len(words) // 3
            a, b, c = words[:third], words[third : 2 * third], words[2 * third : 3 * third]
            half = a ^ b
            carries.append((a & b) | (c & half))
            words = np.concatenate([half ^ c, words[3 * third :]])
        for word in words:
            counts += ((word >> positions) & np.uint32(1)).astype(np.int64) << weight
        words = np.concatenate(carries) if carries else words[:0]
        weight += 1
    return counts


def _repeats(rows: DataFrame) -> DataFrame:
    """``_repeat``: whether a row's ``_text`` digest also belongs to a smaller ``_key``."""
    seen = rows.groupBy("_text").agg(F.min("_key").alias("_first"), F.max("_key").alias("_latest"), F.count(F.lit(1)).alias("_n"))
    seen = settle(seen.where(F.col("_n") > 1))
    again = seen.where(F.col("_latest") > F.col("_first")).select("_text", "_first")
    joined = Salted(rows, ["_text"], counts=seen.select("_text", "_n")).join(again, "left")
    return joined.withColumn("_repeat", F.coalesce(F.col("_key") > F.col("_first"), F.lit(False))).drop("_first")


def survivors(
    docs: DataFrame, key: str, text: str, part: str, failures: Sequence[Column], labels: DataFrame,
    label_key: str, good: Column, toxic: Column,
) -> DataFrame:
    """(part, all, good, toxic): per part the survivors of every subset of filters, as arrays of 32.

    ``failures`` are conditions on ``docs`` of the first filters; the last filter is repetition: a text that also
    belongs to a smaller key, removed or not. Element s of an array counts the documents that no filter of
    subset s (bit i: filter i) removes. ``good`` and ``toxic`` are conditions on ``labels``; a key with
    several labels is good (toxic) if one of them says so. A null condition is false, a null part the
    empty string, a null text empty; a null key has no smaller one and no label.
    """
    if len(failures) > 4:
        raise ValueError("a word of 32 bits holds the subsets of five filters")
    mask = F.lit(0)
    for i, failed in enumerate(failures):
        mask = mask + F.when(failed, F.lit(1 << i)).otherwise(F.lit(0))
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = settle(docs.select(
        F.col(key).alias("_key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), mask.alias("_mask"),
        F.unhex(F.sha2(whole, 256)).alias("_text"),
    ))
    said = labels.groupBy(F.col(label_key).alias("_key")).agg(
        F.max(F.coalesce(good, F.lit(False))).alias("_good"), F.max(F.coalesce(toxic, F.lit(False))).alias("_toxic")
    )
    named = salted_join(_repeats(rows), said.where("_key IS NOT NULL"), ["_key"], "left")
    last = 1 << len(failures)
    words = named.select(
        "part", (F.col("_mask") + F.when(F.col("_repeat"), F.lit(last)).otherwise(F.lit(0))).cast("int").alias("_mask"),
        F.coalesce("_good", F.lit(False)).alias("_good"), F.coalesce("_toxic", F.lit(False)).alias("_toxic"),
    )

    def add_up(batches):
        for batch in batches:
            found = words_per_part(batch)
            yield pa.RecordBatch.from_pydict(found, schema=pa.schema(
                [("part", pa.string()), *[(g, pa.list_(pa.int64())) for g in GROUPS]]
            ))

    partial = words.mapInArrow(add_up, "part string, " + ", ".join(f"`{g}` array<long>" for g in GROUPS))
    return partial.groupBy("part").agg(
        *[F.array(*[F.sum(F.col(g)[s]) for s in range(SUBSETS)]).alias(g) for g in GROUPS]
    )


def words_per_part(batch: pa.RecordBatch) -> dict[str, list]:
    """The positional counts of one batch (part, mask, good, toxic) by part: all, good and toxic documents."""
    names = batch.column(0).dictionary_encode()
    part = np.asarray(names.indices)
    words = survival_words(np.asarray(batch.column(1)))
    chosen = [np.ones(len(part), bool), *(batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))]
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(len(names.dictionary) + 1))
    found: dict[str, list] = {"part": names.dictionary.to_pylist(), **{g: [] for g in GROUPS}}
    for a, b in zip(cuts[:-1], cuts[1:]):
        rows = order[a:b]
        for group, wanted in zip(GROUPS, chosen):
            found[group].append(positional_counts(words[rows[wanted[rows]]]))
    return found


def audit(counts: DataFrame, names: str) -> DataFrame:
    """Every order of the filters, step by step, from the survivors of each part.

    ``names`` has one letter per filter, in the order of the bits. One row per part, ``filter_order`` and ``step``:
    kept, removed, redundant (would fail, but was removed earlier), unique_fails (fails no other filter),
    good_lost, toxic_lost, and shapley: what the filter removes, summed over all orders.
    """
    n = len(names)
    bits = {c: 1 << i for i, c in enumerate(names)}

    def union(letters: Column) -> Column:
        total = F.lit(0)
        for c, bit in bits.items():
            total = total + F.when(F.instr(letters, c) > 0, F.lit(bit)).otherwise(F.lit(0))
        return total

    def left(group: str, subset: Column | int) -> Column:
        return F.element_at(group, F.lit(subset + 1) if isinstance(subset, int) else subset + 1)

    every = (1 << n) - 1
    shares = []
    for bit in bits.values():
        total = F.lit(0).cast("long")
        for before in range(every + 1):
            if not before & bit:
                size = before.bit_count()
                orders = factorial(size) * factorial(n - 1 - size)
                total = total + F.lit(orders) * (left("all", before) - left("all", before | bit))
        shares.append(total)
    orders = F.array(*[F.lit("".join(p)) for p in permutations(names)])
    steps = counts.select("*", F.array(*shares).alias("_shares")).select(
        "*", F.explode(orders).alias("filter_order")
    ).select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    before = union(F.expr("substring(filter_order, 1, step - 1)"))
    own = union(F.expr("substring(filter_order, step, 1)"))
    steps = steps.withColumn("_before", before).withColumn("_own", own).withColumn("_after", F.col("_before") + F.col("_own"))
    removed = left("all", F.col("_before")) - left("all", F.col("_after"))
    place = F.instr(F.lit(names), F.expr("substring(filter_order, step, 1)"))
    return steps.select(
        "part", "filter_order", "step", left("all", F.col("_after")).alias("kept"), removed.alias("removed"),
        (left("all", 0) - left("all", F.col("_own")) - removed).alias("redundant"),
        (left("all", F.lit(every) - F.col("_own")) - left("all", every)).alias("unique_fails"),
        (left("good", F.col("_before")) - left("good", F.col("_after"))).alias("good_lost"),
        (left("toxic", F.col("_before")) - left("toxic", F.col("_after"))).alias("toxic_lost"),
        F.element_at("_shares", place).alias("shapley"),
    )


def text_failures(text: str) -> list[Column]:
    """Four conditions on whole texts (null: empty): few words, few different words, capitals, odd signs."""
    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(whole, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    capitals = F.length(whole) - F.length(F.translate(whole, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [
        F.size(words) < 200,
        100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        100 * capitals.cast("long") > 3 * F.length(whole).cast("long"),
        whole.rlike("[#$%&*|]"),
    ]
