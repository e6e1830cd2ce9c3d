"""Packing of token sequences into windows of several lengths.

Every document becomes its token numbers and one end number. Windows of the longest tier are cut off
whole; what remains of a document is routed to the shortest tier that holds it. Tiers are packed
from the longest down: the longest remaining piece opens a window, the best fitting shorter pieces
fill it, and a last gap is closed by cutting a piece of a shorter tier. Only the last window of a task
can stay short; it is cut into sequences of powers of two. So no sequence needs padding.

Each task packs the rows of its own input split in bounded groups: nothing is shuffled, no task sees
more than ``POOL_TOKENS`` numbers and one batch of texts at a time, and a lost task is repeated alone.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from textloom.llm.bpe import byte_letters

TIERS = (128, 256, 512, 1024)
STEP_TOKENS = 8192
POOL_TOKENS = 1 << 20
LONG_TEXT = 100_000

PIECE = (
    "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, "
    "sequence_tokens int, step_group long"
)


class Tokens:
    """Token numbers by a public byte-level vocabulary file.

    The quick library takes texts of common length; it works on a whole text at once, so very long
    texts go through the file's own library, which gives the same numbers.
    """

    def __init__(self, spec: str, pattern: str):
        self.kept = spec, pattern
        self.quick = None

    def __reduce__(self):
        return Tokens, self.kept

    def _open(self) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        spec, letters = json.loads(self.kept[0]), byte_letters()
        ranks = {bytes(letters[c] for c in s): i for s, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.quick = tiktoken.Encoding("file", pat_str=self.kept[1], mergeable_ranks=ranks, special_tokens=self.special)
        self.whole = Tokenizer.from_str(self.kept[0])
        self.whole.no_truncation()
        self.whole.no_padding()

    def ids(self, text: str) -> np.ndarray:
        if self.quick is None:
            self._open()
        if len(text) > LONG_TEXT:
            found = self.whole.encode(text, add_special_tokens=False).ids
        elif any(s in text for s in self.special):
            found = self.quick.encode(text, allowed_special="all")
        else:
            found = self.quick.encode_ordinary(text)
        return np.array(found, "<u4")


def load_tokens(path: str, pattern: str) -> Tokens:
    """``path`` is read on the driver; its merges must be in the order of their numbers."""
    with open(path, encoding="utf-8") as file:
        spec = file.read()
    return Tokens(spec, pattern)


class Pool:
    """Pieces by length, with the longest, the longest up to a bound and the shortest above it."""

    def __init__(self):
        self.by_length: dict[int, list] = defaultdict(list)
        self.mask = 0  # bit n: there is a piece of n tokens
        self.tokens = 0

    def push(self, piece: tuple) -> None:
        length = piece[2]
        self.by_length[length].append(piece)
        self.mask |= 1 << length
        self.tokens += length

    def _take(self, length: int) -> tuple:
        pieces = self.by_length[length]
        piece = pieces.pop()
        if not pieces:
            self.mask &= ~(1 << length)
        self.tokens -= length
        return piece

    def longest(self) -> tuple:
        return self._take(self.mask.bit_length() - 1)

    def fit(self, gap: int) -> tuple:
        """The longest piece up to ``gap``; else ``gap`` tokens cut off the shortest longer piece."""
        below = self.mask & ((2 << gap) - 1)
        if below:
            return self._take(below.bit_length() - 1)
        above = self.mask >> (gap + 1)
        doc, start, length = self._take((above & -above).bit_length() + gap)
        self.push((doc, start + gap, length - gap))
        return doc, start, gap


def pack_pool(pool: Pool, tiers: Sequence[int], last: bool) -> Iterator[list[tuple]]:
    """Full windows from the pool; a rest too short for its window stays unless it is the ``last``."""
    while pool.mask:
        window = [pool.longest()]
        size = next(t for t in tiers if t >= window[0][2])
        gap = size - window[0][2]
        while gap and pool.mask:
            window.append(pool.fit(gap))
            gap -= window[-1][2]
        if not gap:
            yield window
        elif last:
            yield from powers_of_two(window)
        else:
            for piece in window:
                pool.push(piece)
            return


def powers_of_two(window: list[tuple]) -> Iterator[list[tuple]]:
    """A short window as sequences whose lengths are the binary digits of its length."""
    rest, total = list(reversed(window)), sum(p[2] for p in window)
    while total:
        size = 1 << (total.bit_length() - 1)
        total -= size
        part = []
        while size:
            doc, start, length = rest.pop()
            took = min(length, size)
            if took < length:
                rest.append((doc, start + took, length - took))
            part.append((doc, start, took))
            size -= took
        yield part


def step_groups(windows: list[list[tuple]], step_tokens: int, first: int) -> list[int]:
    """Step group of each window: windows of one length, as many tokens per group, costs dealt evenly.

    The cost is the sum of squared piece lengths, as attention inside a document costs; the dearest
    windows are dealt to and fro over the groups of their length.
    """
    found, by_size = [0] * len(windows), defaultdict(list)
    for i, w in enumerate(windows):
        by_size[sum(p[2] for p in w)].append(i)
    for size in sorted(by_size, reverse=True):
        members = sorted(by_size[size], key=lambda i: (-sum(p[2] ** 2 for p in windows[i]), i))
        groups = -(-len(members) * size // step_tokens)
        for k, i in enumerate(members):
            turn, at = divmod(k, groups)
            found[i] = first + (groups - 1 - at if turn % 2 else at)
        first += groups
    return found


def _rows(windows: list[list[tuple]], sequence: int, group: int, step_tokens: int, keep_ids: bool):
    """Columns of the pieces of ``windows`` and the next free numbers."""
    columns: list[list] = [[] for _ in range(10)]
    groups = step_groups(windows, step_tokens, group)
    for i, window in enumerate(windows):
        at, size = 0, sum(p[2] for p in window)
        for (key, ids), start, length in window:
            part = ids[start : start + length]
            row = (key, start, length, zlib.crc32(part), len(ids), sequence + i, at, size, groups[i], part.astype(np.int32) if keep_ids else None)
            for column, value in zip(columns, row):
                column.append(value)
            at += length
    return columns, sequence + len(windows), max(groups, default=group - 1) + 1


def pack(
    df: DataFrame, key: str, text: str, tokens: Tokens, tiers: Sequence[int] = TIERS,
    end_id: int = 0, step_tokens: int = STEP_TOKENS, keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: the key column, ``PIECE`` and, where wanted, the piece's ``ids``.

    ``tiers`` are rising powers of two. ``sequence_id`` and ``step_group`` are unique over the table;
    ``offset`` counts from 0 inside a sequence without gaps. Each number of each row lies in one piece.
    A null or empty text is its end number alone; repeated rows and null keys are packed like others;
    an empty table gives no rows. Other columns are not read.
    """
    tiers = tuple(sorted(tiers))
    if any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be powers of two")
    shared = df.sparkSession.sparkContext.broadcast(tokens)
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, {PIECE}" + (", ids array<int>" if keep_ids else "")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest, base = tiers[-1], TaskContext.get().partitionId() << 33
        sequence = group = base
        pool, ready, held, key_type = Pool(), [], 0, None

        def flush(last: bool):
            nonlocal sequence, group, ready, held
            ready.extend(pack_pool(pool, tiers, last))
            columns, sequence, group = _rows(ready, sequence, group, step_tokens, keep_ids)
            ready, held = [], 0
            kinds = [key_type, *[pa.int64()] * 6, pa.int32(), pa.int64()] + [pa.list_(pa.int32())] * keep_ids
            names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "step_group"]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=names + ["ids"] * keep_ids
            )

        for batch in batches:
            key_type = batch.schema.field(0).type
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(shared.value.ids(value.as_py() or ""), np.uint32(end_id))
                doc = (name, ids)
                whole = len(ids) - len(ids) % longest
                ready.extend([(doc, start, longest)] for start in range(0, whole, longest))
                if whole < len(ids):
                    pool.push((doc, whole, len(ids) - whole))
                held += len(ids)
                if held >= POOL_TOKENS:
                    yield flush(False)
        if key_type is not None:
            yield flush(True)

    return df.select(key, text).mapInArrow(run, schema)


def padding(pieces: DataFrame, longest: int = TIERS[-1]) -> DataFrame:
    """One row: tokens, and the padding of sequences that are neither full nor a power of two."""
    from pyspark.sql import functions as F

    short = F.bit_count(F.col("n").cast("long")) != 1
    return (
        pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
        .agg(F.sum("n").alias("tokens"), F.sum(F.when(short, longest - F.col("n")).otherwise(0)).alias("padding"))
    )
