"""Token numbers of whole texts by merging many words at once.

Words of a batch of texts are laid end to end in one ragged array of symbols. Every round finds each
word's lowest ranked pair and merges all its occurrences in all words at the same time; words
without a pair left leave the array with the number of their surviving symbols. The words a task meets again
are looked up; only words of moderate length are remembered.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from textloom.llm.bpe import byte_letters
from textloom.llm.names import fresh

SLICE = 1 << 20
REMEMBERED_WORDS = 400_000
REMEMBERED_LENGTH = 48
NO_PAIR = np.iinfo(np.int32).max


class MergeTable:
    """Merges as sorted arrays: pair number -> rank, and the symbol each rank leaves behind."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        letters = {b: c for c, b in byte_letters().items()}
        self.inner = np.array([vocabulary[letters[b]] for b in range(256)], np.int64)
        self.last = np.array([vocabulary[letters[b] + suffix] for b in range(256)], np.int64)
        self.size = max(vocabulary.values()) + 1
        left = np.array([vocabulary[a] for a, _ in merges], np.int64)
        right = np.array([vocabulary[b] for _, b in merges], np.int64)
        self.product = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        born = np.full(self.size, -1, np.int64)
        born[self.product] = np.arange(len(merges))
        if len(set(self.product.tolist())) < len(merges) or (np.maximum(born[left], born[right]) >= np.arange(len(merges))).any():
            raise ValueError("merges must be listed in the order in which they were learned, each symbol once")
        keys = left * self.size + right
        self.rank_of = np.argsort(keys).astype(np.int32)
        self.keys = np.append(keys[self.rank_of], np.iinfo(np.int64).max)
        self.rank_of = np.append(self.rank_of, NO_PAIR).astype(np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left * self.size + right
        at = np.searchsorted(self.keys, wanted)
        return np.where(self.keys[at] == wanted, self.rank_of[at], NO_PAIR).astype(np.int32)

    def survivors(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each word (none of them empty) after all its merges.

        A merge only makes pairs of higher rank than its own, so the occurrences of the lowest pair of a word can
        be merged together; of overlapping ones every second counts, from the left.
        """
        found = np.zeros(len(words), np.int64)
        length = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(length)
        symbols = self.inner[raw]
        symbols[ends - 1] = self.last[raw[ends - 1]]
        word = np.repeat(np.arange(len(words)), length)
        rank = np.full(len(symbols), NO_PAIR, np.int32)
        inside = np.flatnonzero(word[1:] == word[:-1])
        rank[inside] = self.ranks(symbols[inside], symbols[inside + 1])
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[starts, len(symbols)])
            lowest = np.minimum.reduceat(rank, starts)
            done = lowest == NO_PAIR
            found[word[starts[done]]] = size[done]
            if done.all():
                break
            lowest = np.repeat(lowest, size)
            if done.any():
                live = np.repeat(~done, size)
                symbols, word, rank, lowest = symbols[live], word[live], rank[live], lowest[live]
            hits = np.flatnonzero(rank == lowest)
            run = np.flatnonzero(np.r_[True, np.diff(hits) > 1])
            if len(run) < len(hits):
                in_run = np.arange(len(hits)) - np.repeat(run, np.diff(np.r_[run, len(hits)]))
                hits = hits[in_run % 2 == 0]
            symbols[hits] = self.product[rank[hits]]
            keep = np.ones(len(symbols), bool)
            keep[hits + 1] = False
            symbols, word, rank = symbols[keep], word[keep], rank[keep]
            hits = hits - np.arange(len(hits))  # one place is lost before each later hit
            rank[hits] = NO_PAIR
            changed = np.unique(np.r_[hits, hits[hits > 0] - 1])
            changed = changed[changed + 1 < len(symbols)]
            changed = changed[word[changed] == word[changed + 1]]
            rank[changed] = self.ranks(symbols[changed], symbols[changed + 1])
        return found


BLOCK = 64
POINTS = np.r_[0:0xD800, 0xE000:0x110000]


def character_classes(probe) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters, numbers and white space as the vocabulary's own splitter sees every code point.

    ``probe`` splits a string into (piece, (start, end)). A block of code points behind an ``a`` makes one piece
    where all are letters and two where all are other signs. In blocks of several kinds each is asked
    about alone: doubled behind an ``a`` a letter makes one piece, a number three, other signs two, and
    white space leaves the ``a``.
    """
    letter, number, white = (np.zeros(0x110000, bool) for _ in range(3))
    mixed = []
    for block in POINTS.reshape(-1, BLOCK):
        pieces = probe("a" + "".join(map(chr, block)))
        if len(pieces) == 1 and pieces[0][1] == (0, BLOCK + 1):
            letter[block] = True
        elif len(pieces) != 2 or pieces[1][1] != (1, BLOCK + 1) or pieces[0][1] != (0, 1):
            mixed.extend(block.tolist())
    for first in range(0, len(mixed), 4096):
        part = np.array(mixed[first : first + 4096])
        spans = np.array([span for _, span in probe("".join(f"a{chr(p)}{chr(p)} " for p in part.tolist()))])
        owner, heads = spans[:, 0] // 4, spans[:, 0] % 4 == 0
        pieces, size = np.bincount(owner, minlength=len(part)), np.zeros(len(part), np.int64)
        size[owner[heads]] = (spans[:, 1] - spans[:, 0])[heads]
        letter[part], number[part], white[part] = size == 3, pieces == 3, (pieces == 1) & (size == 1)
    return letter, number, white


def _ranges(wanted: np.ndarray) -> str:
    points = np.flatnonzero(wanted)
    cuts = np.flatnonzero(np.diff(points) > 1)
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(points[np.r_[0, cuts + 1]], points[np.r_[cuts, len(points) - 1]]))


def word_pattern(letter: np.ndarray, number: np.ndarray, white: np.ndarray, within: np.ndarray) -> str:
    """The vocabulary's split into words, for texts of the code points ``within``."""
    letters, numbers, spaces = _ranges(letter & within), _ranges(number & within), _ranges(white & within)
    return f"'(?:s|t|re|ve|m|ll|d)|[{letters}]+|[{numbers}]|[^{spaces}{letters}{numbers}]+"


# Signs that neither compose with others nor depend on their neighbours when lower-cased
SIMPLE = "\\x00-\\u02ff\\u2010-\\u2027\\u2030-\\u205e\\u20a0-\\u20bf"


class Counter:
    """Counts tokens of texts by one vocabulary file whose words end in a suffix and drop white space.

    Texts of ``SIMPLE`` signs are lower-cased here and split by a short pattern; other texts go through the
    vocabulary's own normalizer and the pattern over all code points. Both give the same words.
    """

    def __init__(self, spec: str, simple_pattern: str, pattern: str):
        self.kept = spec, simple_pattern, pattern
        self.table: MergeTable | None = None

    def __reduce__(self):
        return Counter, self.kept

    def _open(self) -> None:
        spec = json.loads(self.kept[0])
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.table = MergeTable(spec["model"]["vocab"], merges, spec["model"]["end_of_word_suffix"])
        self.normal = Tokenizer.from_str(self.kept[0]).normalizer.normalize_str
        specials = [re.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = re.compile("|".join(specials)) if specials else None
        self.simple_words, self.all_words = re.compile(self.kept[1]).findall, re.compile(self.kept[2]).findall
        self.odd = re.compile(f"[^{SIMPLE}]").search
        self.known: dict[str, int] = {}

    def slices(self, text: str) -> Iterator[list[str]]:
        """Words of a text, some million characters at a time; no word spans a space."""
        if self.odd(text):
            text, words = self.normal(text), self.all_words
        else:
            text, words = text.lower(), self.simple_words
        start = 0
        while start < len(text):
            cut = text.find(" ", start + SLICE)
            cut = len(text) if cut < 0 else cut
            yield words(text, start, cut)
            start = cut

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; strings of special tokens inside a text are one token each."""
        if self.table is None:
            self._open()
        found, waiting, held = [0] * len(texts), [], 0
        for i, text in enumerate(texts):
            parts = [text]
            if self.special is not None and "<" in text:
                parts = self.special.split(text)
                found[i] += len(parts) - 1
            for part in parts:
                for words in self.slices(part):
                    waiting.append((i, words))
                    held += 1 + min(len(part), SLICE)
                    if held >= SLICE:
                        self._settle(waiting, found)
                        waiting, held = [], 0
        self._settle(waiting, found)
        return found

    def _settle(self, waiting: list[tuple[int, list[str]]], found: list[int]) -> None:
        known = self.known
        if len(known) > REMEMBERED_WORDS:
            known.clear()
        new = list({w for _, words in waiting for w in words if w not in known})
        if new:
            known.update(zip(new, self.table.survivors([w.encode() for w in new]).tolist()))
        for i, words in waiting:
            found[i] += sum(map(known.__getitem__, words))
        for word in new:
            if len(word) > REMEMBERED_LENGTH:
                del known[word]


def load_counter(path: str) -> Counter:
    """Read the vocabulary file on the driver and ask its splitter about every code point once."""
    with open(path, encoding="utf-8") as file:
        spec = file.read()
    whole = Tokenizer.from_str(spec)
    simple = np.zeros(0x110000, bool)
    simple[[p for p in range(0x3000) if re.match(f"[{SIMPLE}]", chr(p))]] = True
    if any(whole.normalizer.normalize_str(f"x{chr(p)}x") != f"x{chr(p)}x".lower()
           for p in np.flatnonzero(simple).tolist() if not chr(p).isspace()):
        raise ValueError("the vocabulary does not lower-case as published")
    kinds = character_classes(whole.pre_tokenizer.pre_tokenize_str)
    return Counter(spec, word_pattern(*kinds, simple), word_pattern(*kinds, np.ones(0x110000, bool)))


def count_tokens(df: DataFrame, key: str, text: str, counter: Counter, limit: int) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit): tokens of every whole text, without added special tokens.

    ``over_limit`` says whether there are more than ``limit``. A null or empty text has none and 0 bytes;
    one row per row of ``df``, repeated rows and null keys included; an empty table gives no rows;
    other columns, whatever their names, are not read. Memory of a task: one batch of texts, some
    million characters as words, and ``REMEMBERED_WORDS`` short words.
    """
    shared = df.sparkSession.sparkContext.broadcast(counter)
    name = fresh(df.select(key), "n_bytes", "n_tokens", "over_limit")
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            counts = pa.array(shared.value.count([t or "" for t in column.to_pylist()]), pa.int64())
            size = pc.fill_null(pc.binary_length(column), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, counts, pc.greater(counts, limit)], names=[key, *name])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, `{name[0]}` long, `{name[1]}` long, `{name[2]}` boolean")
