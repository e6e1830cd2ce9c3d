"""Two tokenizers' tokens of the same bytes: groups between common ends, and overlaps.

The token ends of both sides are two sorted lists, and merging them walks through every overlap once. The walk is
cut into pieces of equal work: on every diagonal of the merge grid a binary search finds where the walk crosses it,
so all pieces start independently and advance side by side, one step of every piece at a time. Each
piece gives its overlaps and the common ends it met; adding up the common ends over the pieces before
it stitches a group that lies on a border together.

Texts are aligned in blocks. A block keeps the different id pairs of its documents once; how many documents of the
whole corpus hold a pair is added up over the blocks, and each block gets back the counts of its own pairs.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.llm.bpe import byte_letters
from textloom.scale import Salted, settle

PIECE_STEPS = 256
BLOCK_BYTES = 2 << 20
BLOCK_TEXTS = 4096
LONG_SPACE = 5000  # white space signs in a row that the quicker library is not given
BEYOND = np.iinfo(np.int64).max


def crossings(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many of ``a`` are among the first d of the merge of ``a`` and ``b``, for each d, ``a`` first in ties."""
    low, high = np.maximum(diagonals - len(b), 0), np.minimum(diagonals, len(a))
    while True:
        open_ = low < high
        if not open_.any():
            return low
        middle = (low + high) >> 1
        further = np.zeros(len(low), bool)
        further[open_] = a[middle[open_]] <= b[(diagonals - 1 - middle)[open_]]
        low, high = np.where(open_ & further, middle + 1, low), np.where(open_ & ~further, middle, high)


@dataclass
class Alignment:
    """Overlaps (``left`` and ``right`` token places, ``group`` of each) in text order, and for
    every group the number of left and right tokens up to its end."""

    left: np.ndarray
    right: np.ndarray
    group: np.ndarray
    left_ends: np.ndarray
    right_ends: np.ndarray


def align(a: np.ndarray, b: np.ndarray, steps: int = PIECE_STEPS) -> Alignment:
    """Align two rising lists of token ends whose last ends are equal (both may be empty)."""
    total = len(a) + len(b)
    starts = np.arange(0, total, steps)
    i = crossings(a, b, starts)
    j = starts - i
    ends_a, ends_b = np.append(a, BEYOND), np.append(b, BEYOND)
    begins_a = np.append(0, a)
    lefts, rights, common = (np.empty((steps, len(starts)), kind) for kind in (np.int64, np.int64, bool))
    for step in range(min(steps, total)):
        lefts[step], rights[step] = i, j
        end_b = ends_b[j]
        # the left side's end was passed first: nothing of the next left token lies in this right one
        common[step] = begins_a[i] >= end_b
        forward = ends_a[i] <= end_b
        inside = i + j < total
        i = i + (forward & inside)
        j = j + (~forward & inside)
    walked = np.minimum(steps, total - starts)
    real = np.arange(steps)[None, :] < walked[:, None]
    left, right, common = lefts.T[real], rights.T[real], common.T[real]
    met = np.add.reduceat(common, np.cumsum(walked) - walked) if total else np.zeros(0, np.int64)
    before = np.cumsum(met) - met  # groups that ended in earlier pieces
    inner = np.cumsum(common) - np.repeat(np.cumsum(met) - met, walked)
    group = inner + np.repeat(before, walked)
    overlap = ~common
    return Alignment(left[overlap], right[overlap], group[overlap], left[common], right[common] + 1)


class Sides:
    """Both tokenizers, opened in the task, with the bytes and lengths of their tokens.

    The left vocabulary is read as ranks by the quicker of its two libraries, which gives the same numbers; that one
    stops at very long runs of white space, so texts with such a run go through the file's own library.
    """

    def __init__(self, left_spec: str, left_pattern: str, right_model: bytes):
        self.kept = left_spec, left_pattern, right_model
        self.left = None

    def __reduce__(self):
        return Sides, self.kept

    def _open(self) -> None:
        import tiktoken
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to other tasks
        spec, pattern, model = self.kept
        whole = Tokenizer.from_str(spec)
        whole.encode_special_tokens = True
        whole.no_truncation()
        whole.no_padding()
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in whole.get_vocab(with_added_tokens=False).items()}
        self.left_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.left_bytes[i] = token
        quick = tiktoken.Encoding("left", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        long_space = re.compile(r"\s{%d}" % LONG_SPACE).search
        self.left = lambda text: whole.encode(text, add_special_tokens=False).ids if long_space(text) else quick.encode_ordinary(text)
        self.right = SentencePieceProcessor(model_proto=model)
        self.right_bytes = [self._piece(i) for i in range(self.right.get_piece_size())]
        self.left_length, self.right_length = (np.array([len(x) for x in y], np.int64) for y in (self.left_bytes, self.right_bytes))
        decimals = max(len(self.left_bytes), len(self.right_bytes))
        self.decimals = decimals
        self.written = [b"%d%s" % (i, sign) for sign in (b",", b"|", b";") for i in range(decimals)]

    def _piece(self, i: int) -> bytes:
        if self.right.is_byte(i):
            return bytes([int(re.fullmatch("<0x([0-9A-F]{2})>", self.right.id_to_piece(i))[1], 16)])
        return self.right.id_to_piece(i).replace("▁", " ").encode()

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Both sides' ids; none where the text is empty or a side does not spell it."""
        none = np.zeros(0, np.int64)
        if not text:
            return none, none
        if self.left is None:
            self._open()
        wanted = (" " + text).encode()
        right = self.right.encode(text)
        if b"".join(map(self.right_bytes.__getitem__, right)) != wanted:
            return none, none
        left = self.left(" " + text)
        if b"".join(map(self.left_bytes.__getitem__, left)) != wanted:
            return none, none
        return np.array(left, np.int64), np.array(right, np.int64)

    def digests(self, left: list[np.ndarray], right: list[np.ndarray], found: Alignment) -> list[str]:
        """SHA-256 of every text's groups written out; the empty string for a text without tokens."""
        if self.left is None or not len(found.left_ends):
            return [""] * len(left)
        ids_a, ids_b = np.concatenate(left), np.concatenate(right)
        group_a, group_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        group_a[found.left], group_b[found.right] = found.group, found.group
        i, j = np.arange(len(ids_a)), np.arange(len(ids_b))
        right_before = np.append(0, found.right_ends[:-1])
        codes = np.empty(len(ids_a) + len(ids_b), np.int64)
        codes[i + right_before[group_a]] = ids_a + self.decimals * (i + 1 == found.left_ends[group_a])
        codes[j + found.left_ends[group_b]] = ids_b + 2 * self.decimals * (j + 1 == found.right_ends[group_b])
        digests, start = [], 0
        for a, b in zip(left, right):
            size = len(a) + len(b)
            spelled = b"".join(map(self.written.__getitem__, codes[start : start + size].tolist()))[:-1]
            digests.append(sha256(spelled).hexdigest() if size else "")
            start += size
        return digests


def load_sides(left_path: str, left_pattern: str, right_path: str) -> Sides:
    """Both vocabulary files, read on the driver; ``left_pattern`` splits texts before the left side's merges."""
    with open(left_path, encoding="utf-8") as left, open(right_path, "rb") as right:
        return Sides(left.read(), left_pattern, right.read())


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values, kind))


def align_block(sides: Sides, texts: list[str | None]) -> tuple[dict, dict]:
    """The columns of each text, and the different id pairs of the block with their numbers of texts."""
    encoded = [sides.encode(t) for t in texts]
    left, right = [x for x, _ in encoded], [y for _, y in encoded]
    n_a, n_b = (np.array([len(x) for x in side], np.int64) for side in (left, right))
    ids_a, ids_b = (np.concatenate(side) if side else np.zeros(0, np.int64) for side in (left, right))
    ends_a = np.cumsum(sides.left_length[ids_a]) if len(ids_a) else ids_a
    ends_b = np.cumsum(sides.right_length[ids_b]) if len(ids_b) else ids_b
    found = align(ends_a, ends_b)
    owner = np.repeat(np.arange(len(texts)), n_a)
    of_link = owner[found.left]
    pairs, local = np.unique(ids_a[found.left] << 32 | ids_b[found.right], return_inverse=True)
    held, weight = np.unique(of_link * max(len(pairs), 1) + local, return_counts=True)
    place = held % max(len(pairs), 1)
    texts_of = np.bincount(held // max(len(pairs), 1), minlength=len(texts))
    rows = {
        "n_a": pa.array(n_a), "n_b": pa.array(n_b),
        "n_groups": pa.array(np.bincount(owner[found.left_ends - 1], minlength=len(texts)).astype(np.int64)),
        "n_links": pa.array(np.bincount(of_link, minlength=len(texts)).astype(np.int64)),
        "digest": pa.array(sides.digests(left, right, found), pa.string()),
        "places": _lists(place, texts_of, pa.int32()), "weights": _lists(weight, texts_of, pa.int32()),
    }
    return rows, {"pairs": pairs, "docs": np.bincount(place, minlength=len(pairs))}


DOC = "block long, {key}, n_a long, n_b long, n_groups long, n_links long, digest string, places array<int>, weights array<int>"


def blocks(df: DataFrame, key: str, text: str, sides: Sides) -> DataFrame:
    """Rows of texts (``pairs`` is null) and one row per block (its ``pairs`` and their numbers of texts)."""
    shared = df.sparkSession.sparkContext.broadcast(sides)
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        block, keys, texts, size, key_type = TaskContext.get().partitionId() << 33, [], [], 0, None

        def flush():
            rows, pairs = align_block(shared.value, texts)
            n, one = len(texts), [0] * len(texts)
            listed = pa.array([None] * n, pa.list_(pa.int64()))
            counted = pa.array([None] * n, pa.list_(pa.int32()))
            yield [pa.array([block] * n, pa.int64()), pa.array(keys, key_type), *rows.values(), listed, counted]
            empty = [pa.array([None], kind) for kind in (key_type, *(x.type for x in rows.values()))]
            sizes = np.array([len(pairs["pairs"])])
            yield [pa.array([block], pa.int64()), *empty, _lists(pairs["pairs"], sizes, pa.int64()), _lists(pairs["docs"], sizes, pa.int32())]

        names = ["block", "key", "n_a", "n_b", "n_groups", "n_links", "digest", "places", "weights", "pairs", "docs"]
        for batch in batches:
            key_type = batch.schema.field(0).type
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys.append(k)
                texts.append(t.as_py())
                size += len(texts[-1] or "")
                if size >= BLOCK_BYTES or len(texts) >= BLOCK_TEXTS:
                    for columns in flush():
                        yield pa.RecordBatch.from_arrays(columns, names=names)
                    block, keys, texts, size = block + 1, [], [], 0
        if texts:
            for columns in flush():
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.select(key, text).mapInArrow(run, DOC.format(key=f"key {kind}") + ", pairs array<long>, docs array<int>")


def _score(texts: pa.Table, rated: pa.Table) -> pa.Table:
    """Best links and sums of counts of a block's texts from the counts of the block's pairs."""
    size = len(rated)
    count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    if size:
        at = rated["place"].to_numpy()
        count[at], best[at] = rated["count"].to_numpy(), rated["best"].to_numpy()
    columns = {"n_best": [], "count_sum": []}
    for places, weights in zip(texts["places"], texts["weights"]):
        at, n = (x.values.to_numpy(zero_copy_only=False) for x in (places, weights))
        columns["n_best"].append(int((best[at] * n).sum()))
        columns["count_sum"].append(int((count[at] * n).sum()))
    kept = texts.select(["key", "n_a", "n_b", "n_groups", "n_links"])
    for name, values in columns.items():
        kept = kept.append_column(name, pa.array(values, pa.int64()))
    return kept.append_column("digest", texts["digest"])


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, count, blocks, best): texts of the corpus that hold the pair, and 1 where no pair of its left id
    has more. A left id has at most as many pairs as the right vocabulary has ids."""
    counted = settle(links.groupBy("pair").agg(F.sum("docs").alias("count"), F.count(F.lit(1)).alias("blocks")))
    same = W.partitionBy(F.shiftright("pair", 32))
    return counted.withColumn("best", (F.col("count") == F.max("count").over(same)).cast("int"))


def compare(df: DataFrame, key: str, text: str, sides: Sides) -> DataFrame:
    """One row per text: n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    Tokens are of a space and the text. Links are the overlapping token occurrences; a pair's count is the number of texts of
    the table that hold it, ``n_best`` the links whose count no pair of the same left id passes,
    ``count_sum`` the counts of all links added up. Null and empty texts, and texts that a side does not spell byte by
    byte, have no tokens: zeros and an empty digest. Repeated rows count as texts of their own, null keys as any
    other; an empty table gives no rows; other columns, whatever their names, are not read.
    """
    parts = settle(blocks(df, key, text, sides))
    links = parts.where("pairs IS NOT NULL").select(
        F.col("block").alias("owner"), F.posexplode(F.arrays_zip("pairs", "docs")).alias("place", "link")
    )
    links = links.select("owner", "place", F.col("link.pairs").alias("pair"), F.col("link.docs").alias("docs"))
    counts = settle(pair_counts(links))
    rated = Salted(links.drop("docs"), ["pair"], counts=counts.select("pair", F.col("blocks").alias("_n"))).join(
        counts.select("pair", "count", "best")
    ).select("owner", "place", "count", "best")
    kind = df.schema[key].dataType.simpleString()
    scored = (
        parts.where("pairs IS NULL").drop("pairs", "docs").groupBy("block").cogroup(rated.groupBy("owner"))
        .applyInArrow(_score, f"key {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, digest string")
    )
    return scored.withColumnsRenamed({"key": key, "digest": "groups_sha256"})
