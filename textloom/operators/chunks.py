"""Texts to chunks: recursive character splitting, offsets, two row layouts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as tx

# Separators from coarse to fine; the empty one cuts between characters.
SEPARATORS = ("\n\n", "\n", " ", "")

CHUNK_TYPE = "array<struct<no:int,start:int,end:int,chunk:string>>"
CHUNK_FIELDS = pa.schema([("no", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("chunk", pa.string())])
AT_ONCE = 128  # texts whose chunks are Python strings at once


def _cuts(text: str, lo: int, hi: int, mark: str) -> Iterator[tuple[int, int]]:
    """Spans of text[lo:hi]; every separator opens the span after it."""
    if not mark:
        yield from ((i, i + 1) for i in range(lo, hi))
        return
    begin, at = lo, text.find(mark, lo, hi)
    while at != -1:
        if at > begin:
            yield begin, at
        begin, at = at, text.find(mark, at + len(mark), hi)
    if begin < hi:
        yield begin, hi


def _pack(spans: list[tuple[int, int]], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Adjacent spans joined up to ``size``, keeping at most ``overlap`` from the chunk before."""
    first = 0
    for i, (lo, hi) in enumerate(spans):
        held = lo - spans[first][0]
        if first < i and held + hi - lo > size:
            yield spans[first][0], lo
            while first < i and (lo - spans[first][0] > overlap or hi - spans[first][0] > size):
                first += 1
    if spans:
        yield spans[first][0], spans[-1][1]


def _leaps(text: str, size: int, lo: int, hi: int, level: int) -> Iterator[tuple[int, int]]:
    """The chunks of text[lo:hi] without overlap at a separator of one character or none, from border to border."""
    mark = SEPARATORS[level]
    if not mark:
        yield from ((i, min(i + size, hi)) for i in range(lo, hi, size))
        return
    while lo < hi:
        last = text.rfind(mark, lo + 1, min(lo + size + 1, hi))
        if hi - lo < size or (hi - lo == size and last != -1):
            yield lo, hi
            return
        if last == -1 or (last == lo + size and text.find(mark, lo + 1, last) == -1):  # one span of size or more
            end = last if last != -1 else text.find(mark, lo + 1, hi)
            end = hi if end == -1 else end
            yield from chunk_spans(text, size, 0, lo, end, level + 1)
        else:
            end = last
            yield lo, end
        lo = end


def chunk_spans(text: str, size: int, overlap: int, lo: int = 0, hi: int | None = None, level: int = 0):
    """(start, end) of the chunks of a text, before trimming."""
    hi = len(text) if hi is None else hi
    while level < len(SEPARATORS) - 1 and text.find(SEPARATORS[level], lo, hi) == -1:
        level += 1
    if not overlap and len(SEPARATORS[level]) < 2:
        yield from _leaps(text, size, lo, hi, level)
        return
    fitting: list[tuple[int, int]] = []
    for a, b in _cuts(text, lo, hi, SEPARATORS[level]):
        if b - a < size:
            fitting.append((a, b))
            continue
        yield from _pack(fitting, size, overlap)
        fitting = []
        if level == len(SEPARATORS) - 1:
            yield a, b
        else:
            yield from chunk_spans(text, size, overlap, a, b, level + 1)
    yield from _pack(fitting, size, overlap)


def _chunks(text: str | None, size: int, overlap: int) -> list[dict]:
    out = []
    for lo, hi in chunk_spans(text or "", size, overlap):
        piece = text[lo:hi]
        kept = piece.strip()
        if kept:
            start = lo + len(piece) - len(piece.lstrip())
            out.append({"no": len(out), "start": start, "end": start + len(kept), "chunk": kept})
    return out


def _chunk_array(texts: pa.Array, size: int, overlap: int) -> pa.Array:
    """The chunks of a few texts, as Arrow columns instead of an object per chunk."""
    ends, columns = [0], {name: [] for name in CHUNK_FIELDS.names}
    for text in texts:
        for found in _chunks(text.as_py(), size, overlap):
            for name, values in columns.items():
                values.append(found[name])
        ends.append(len(columns["no"]))
    held = pa.StructArray.from_arrays([pa.array(columns[f.name], f.type) for f in CHUNK_FIELDS], fields=list(CHUNK_FIELDS))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), held)


def split_text(text: Column, size: int = 1024, overlap: int = 0) -> Column:
    """Chunks of at most ``size`` characters as an array, one Arrow batch at a time."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")

    @F.arrow_udf(CHUNK_TYPE)
    def split(texts: pa.Array) -> pa.Array:
        pieces = [_chunk_array(texts.slice(at, AT_ONCE), size, overlap) for at in range(0, len(texts), AT_ONCE)]
        return pa.concat_arrays(pieces or [_chunk_array(texts, size, overlap)])

    return split(text)


def chunk_lists(df: DataFrame, text: str, size: int = 1024, overlap: int = 0, out: str = "chunks") -> DataFrame:
    """Each text beside its own chunks with their numbers and offsets."""
    return df.withColumn(out, split_text(F.col(text), size, overlap))


def chunk_rows(df: DataFrame, name: str, text: str, size: int = 1024, overlap: int = 0) -> DataFrame:
    """One row per chunk: id, name, number, offsets, chunk and the other columns."""
    rest = [c for c in df.columns if c not in (name, text)]
    found = df.select(name, *rest, F.inline(split_text(F.col(text), size, overlap)))
    return found.select(
        tx.chunk_id(F.col(name), F.col("chunk")).alias("id"),
        name,
        F.col("no").alias("chunkno"),
        "start",
        "end",
        "chunk",
        *rest,
    )


def chunk_arrays(df: DataFrame, name: str, text: str, size: int = 1024, overlap: int = 0) -> DataFrame:
    """One row per document with all its chunks."""
    rest = [c for c in df.columns if c not in (name, text)]
    return df.select(
        tx.document_id(F.col(name)).alias("id"),
        name,
        F.transform(split_text(F.col(text), size, overlap), lambda c: c["chunk"]).alias("chunks"),
        *rest,
    )


def chunks_stand(text: Column, chunks: Column) -> Column:
    """Whether every chunk of a list stands at its offsets in the text, in one walk over both."""

    @F.arrow_udf("boolean")
    def check(texts: pa.Array, lists: pa.Array) -> pa.Array:
        stands = lambda t, found: all(t[c["start"] : c["end"]] == c["chunk"] for c in found)
        rows = ((t.as_py(), found.as_py()) for t, found in zip(texts, lists))
        return pa.array([t is None or found is None or stands(t, found) for t, found in rows], pa.bool_())

    return check(text, chunks)
