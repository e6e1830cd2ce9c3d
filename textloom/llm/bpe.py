"""Byte-pair encoding as a deterministic automaton over tokens.

``compile_merges`` starts from one state that loops on every byte and applies one gadget per merge
(u, v) -> w: wherever the path u v was possible an arc w appears beside it, and after u the token v is
no longer possible. What remains are exactly the token sequences the merges can leave behind, and each
text has one of them. A text is encoded by following arcs whose labels spell it, and decoded by
emitting the labels of its tokens.

Rows and columns of the transition table that never came apart are stored once, so the table stays
at some megabytes for a vocabulary of tens of thousands; it depends on the vocabulary alone.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

CACHED_WORDS = 500_000


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte, inverted."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def word_pattern(probe) -> str:
    """The published pre-split: contractions, letters, numbers, other signs, white space.

    ``probe`` is the vocabulary's own splitter. It is asked about code points that this Python's
    Unicode tables do not know yet, so that newer letters and numbers are split as it splits them.
    """
    kinds = np.array([unicodedata.category(chr(i)) for i in range(0x40000)])
    letter, number = np.char.startswith(kinds, "L"), np.char.startswith(kinds, "N")
    for i in np.flatnonzero(kinds == "Cn").tolist():
        letter[i] = len(probe("a" + chr(i))) == 1
        number[i] = len(probe("1" + chr(i))) == 1

    def ranges(wanted) -> str:
        points = np.flatnonzero(wanted)
        cuts = np.flatnonzero(np.diff(points) > 1)
        starts, ends = points[np.r_[0, cuts + 1]], points[np.r_[cuts, len(points) - 1]]
        return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends))

    letters, numbers = ranges(letter), ranges(number)
    # the code points with the property White_Space: fixed values
    white = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
    return (
        f"'(?:s|t|re|ve|m|ll|d)| ?[{letters}]+| ?[{numbers}]+| ?[^{white}{letters}{numbers}]+"
        f"|[{white}]+(?![^{white}])|[{white}]+"
    )


class Paths(dict):
    """Token numbers by pre-split word; a word met for the first time is looked up in the table."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = self[word] = self.automaton.path(word.encode())
        return found


class Automaton:
    """The compiled table: ``rows[state]`` holds one bit per column, ``state`` and ``column`` map tokens."""

    def __init__(self, labels, ids, specials, pattern, state, column, rows):
        self.kept = labels, ids, specials, pattern, state, column, rows
        self.labels, self.ids, self.specials = labels, ids, specials
        self.state, self.column, self.rows = state, column, rows
        self.decimal = [b"%d" % i for i in range(len(labels))]
        self.arcs = {label[:n]: -1 for label in ids for n in range(1, len(label))} | ids
        self.split = re.compile(pattern).findall
        self.paths = Paths(self)
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None

    def __reduce__(self):
        return Automaton, self.kept

    def allowed(self, before: int | None, token: int) -> bool:
        """Whether ``token`` may follow ``before`` (None: the start)."""
        column = self.column[token]
        return bool(self.rows[0 if before is None else self.state[before]][column >> 3] >> (column & 7) & 1)

    def _options(self, word: bytes, place: int) -> list[tuple[int, int]]:
        """Tokens that ``word`` spells at ``place``, as (end, token), the longest last."""
        arcs, found, stop, end = self.arcs, [], place, len(word)
        while stop < end:
            stop += 1
            token = arcs.get(word[place:stop])
            if token is None:
                break
            if token >= 0:
                found.append((stop, token))
        return found

    def path(self, word: bytes) -> tuple[int, ...]:
        """The one accepted path that spells ``word``.

        Longest arcs are tried first. Any two accepted paths to a place are equal, so a place from
        which the end was not reached needs no second visit: the work is linear in the word.
        """
        state, column, rows = self.state, self.column, self.rows
        row, end, dead = rows[0], len(word), set()
        whole = self.ids.get(word)
        if whole is not None and row[column[whole] >> 3] >> (column[whole] & 7) & 1:
            return (whole,)
        place, options, taken, left = 0, self._options(word, 0), [], []
        while place < end:
            while options:
                stop, token = options.pop()
                c = column[token]
                if row[c >> 3] >> (c & 7) & 1 and stop not in dead:
                    taken.append(token)
                    left.append((place, row, options))
                    place, row = stop, rows[state[token]]
                    options = self._options(word, place)
                    break
            else:
                dead.add(place)
                if not left:
                    raise ValueError(f"no path spells {word[:40]!r}")
                place, row, options = left.pop()
                taken.pop()
        return tuple(taken)

    def encode(self, text: str) -> list[int]:
        split, paths = self.split, self.paths
        if len(paths) > CACHED_WORDS:
            paths.clear()
        if self.special_pattern is None or not self.special_pattern.search(text):
            return list(chain.from_iterable(map(paths.__getitem__, split(text))))
        found: list[int] = []
        for i, part in enumerate(self.special_pattern.split(text)):
            if i % 2:
                found.append(self.specials[part])
            else:
                found.extend(chain.from_iterable(map(paths.__getitem__, split(part))))
        return found

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.labels.__getitem__, ids))


def compile_merges(base: dict[bytes, int], merges: list[tuple[bytes, bytes]], ids: dict[bytes, int]):
    """States, columns and the bit table after one gadget per merge.

    ``state[t]`` is where every arc labelled ``t`` leads. Rows (states) and columns (tokens) are
    copied only when one of the tokens that share them has to change.
    """
    size = max(ids.values()) + 1
    state, column = np.zeros(size, np.int64), np.zeros(size, np.int64)
    table = np.zeros((1024, 1024), bool)  # states x columns, grown as needed
    # state 0 is the start and is never changed; 1 is reached by every byte at first
    table[:2, 0] = True
    state[list(base.values())] = 1
    sharers_of_state, sharers_of_column = [1, len(base)], [len(base)]

    def grown(axis: int) -> None:
        nonlocal table
        more = np.zeros_like(table)
        table = np.concatenate([table, more], axis=axis)

    def own_state(token: int) -> int:
        s = state[token]
        if sharers_of_state[s] > 1:
            n = len(sharers_of_state)
            if n == table.shape[0]:
                grown(0)
            table[n, : len(sharers_of_column)] = table[s, : len(sharers_of_column)]
            sharers_of_state[s] -= 1
            sharers_of_state.append(1)
            state[token] = n
        return state[token]

    def own_column(token: int) -> int:
        c = column[token]
        if sharers_of_column[c] > 1:
            n = len(sharers_of_column)
            if n == table.shape[1]:
                grown(1)
            table[: len(sharers_of_state), n] = table[: len(sharers_of_state), c]
            sharers_of_column[c] -= 1
            sharers_of_column.append(1)
            column[token] = n
        return column[token]

    for left, right in merges:
        u, v, w = ids[left], ids[right], ids[left + right]
        if not table[state[u], column[v]]:
            raise ValueError(f"merge {left!r} {right!r} can never apply")
        column[w] = column[u]  # w may begin wherever u may
        sharers_of_column[column[w]] += 1
        state[w] = state[v]  # and what may follow v may follow w
        sharers_of_state[state[w]] += 1
        after_u = own_state(u)
        for gone in {v, w} if u == v else {v}:  # u u u merges from the left: w cannot follow u either
            c = own_column(gone)
            table[after_u, c] = False
    used = table[: len(sharers_of_state), : len(sharers_of_column)]
    packed = np.packbits(used, axis=1, bitorder="little")
    return state.tolist(), column.tolist(), [row.tobytes() for row in packed]


@lru_cache(maxsize=2)
def load(path: str) -> Automaton:
    """Compile the byte-level vocabulary file at ``path`` (read on the driver only)."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    to_byte = byte_letters()
    spell = lambda s: bytes(to_byte[c] for c in s)
    ids = {spell(s): i for s, i in spec["model"]["vocab"].items()}
    pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
    merges = [(spell(a), spell(b)) for a, b in pairs]
    specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
    labels = [b""] * (max([*ids.values(), *specials.values()]) + 1)
    for label, i in ids.items():
        labels[i] = label
    for content, i in specials.items():
        labels[i] = content.encode()
    base = {label: i for label, i in ids.items() if len(label) == 1}
    splitter = Tokenizer.from_file(path).pre_tokenizer
    pattern = word_pattern(splitter.pre_tokenize_str)
    return Automaton(labels, ids, specials, pattern, *compile_merges(base, merges, ids))


RESULT = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode_texts(df: DataFrame, key: str, text: str, vocabulary: str) -> DataFrame:
    """(key, ids): the token numbers of every whole text; a null text counts as empty (no tokens)."""
    shared = df.sparkSession.sparkContext.broadcast(load(vocabulary))

    def run(batches):
        automaton = shared.value
        for batch in batches:
            ids = pa.array([automaton.encode(t or "") for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode_ids(df: DataFrame, key: str, ids: str, vocabulary: str) -> DataFrame:
    """(key, text) from token numbers; bytes that are no UTF-8 become replacement characters."""
    shared = df.sparkSession.sparkContext.broadcast(load(vocabulary))

    def run(batches):
        automaton = shared.value
        for batch in batches:
            texts = [automaton.decode(x or ()).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")


def round_trip(df: DataFrame, key: str, text: str, vocabulary: str) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): both directions over every whole text.

    ``ids_sha256`` is of the decimal numbers joined by commas, ``decoded_sha256`` of the UTF-8 text
    spelled by the tokens. A null or empty text has no tokens and the digests of the empty string.
    One row per row of ``df``, repeated rows and null keys included; other columns are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(load(vocabulary))

    def digests(automaton: Automaton, text: str) -> tuple[int, str, str]:
        ids = automaton.encode(text)
        listed = b",".join(map(automaton.decimal.__getitem__, ids))
        spelled = automaton.decode(ids).decode("utf-8", "replace").encode()
        return len(ids), sha256(listed).hexdigest(), sha256(spelled).hexdigest()

    def run(batches):
        automaton = shared.value
        for batch in batches:
            rows = [digests(automaton, t.as_py() or "") for t in batch.column(1)]
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else ([], [], []), RESULT)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, *RESULT.names])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(
        run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
