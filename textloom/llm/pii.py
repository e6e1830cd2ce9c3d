"""Personal data: four plain patterns, and a conditional random field that finds what they miss.

The field reads the shapes of a word and its neighbours and is trained from ``LABELLED``, a small marked
table. Only words with a digit or an @ may carry a label, so a text falls into short chains between
other words; the chains of a batch are decoded together.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textloom.llm.crf import FORBIDDEN, Chain, train

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *[f"{p}-{k}" for k in KINDS for p in "BI"])

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")

# The labelled table: [kind|span] marks personal data. Numbers that are none stand unmarked.
LABELLED = """
Write to [email|anna.smith@example.com] or call [phone|+1 (212) 555-0172] today.
My address is [email|j.doe99@mail2.example.org], thanks.
contact: [email|info@example.co.uk]
Questions go to [email|first_last+tag@sub.example.net] please
[email|rolf.81@mail4.example.com] is mine
Schreib an [email|müller.42@mail1.example.de] oder ruf an.
Escribe a [email|niña.07@mail3.example.es] hoy.
The host [ip|192.168.10.24] did not answer.
Login from [ip|10.0.0.7], then from [ip|172.16.254.1].
Server [ip|203.0.113.195] was reached from [ip|2001:db8:0:1:1:1:1:1] twice.
client [ip|fe80:0:0:0:204:61ff:fe9d:f156] sent the request
the [ip|8.8.4.4]!! reply
on [ip|61.204.38.119] the
She paid with [card|4556737586899855] last week.
Card number [card|4111 1111 1111 1111], valid.
card [card|5500-0000-0000-0004] expired
conto [card|378282246310005] era
the old [card|7312480956113427] was blocked
tarjeta [card|4917330284516673]. El banco
number, [card|8250917364402918]$$$ please
voilà le [card|4539027716648805]!! né
und [card|6011000990139424] der die
Reach me at [phone|+44 20 7946 0958] before noon.
Rufen Sie [phone|+49 30 901820] an.
Tel. [phone|(212) 555-0187] or [phone|(415) 555-0193].
Phone [phone|212-555-0199] any time.
Call [phone|555-867-5309] now
ring [phone|800-555-0123] or [phone|888-555-0145] for help
Les ées [phone|+33 1 70 18 99 00] et la
the [phone|+1 (084) 555-0163] Marlene he.
asked [phone|+1 (907) 555-0148]%%% or of
This work is licensed under the GNU General Public License, version 3.
Licensed under the Apache License, Version 2.0.
Released under CC BY-NC 4.0.
Section 4.2.1 of the manual, page 117.
In 1998 there were 1,250 people; by 2024 there were 31,400.
It costs $19.99 or 20 euros, or 1000 in all.
On 2024-05-17 at 10:30 the meeting began.
The order 48213 has 12 items of 3 kg each.
version 10.4.3 build 20231105 was released
token = "c41d9a27e8b35f60917ad2e4408bb36f5512ce7a" there
key B7D4019F62EA8C35F1D0743A9E58C26B1F90A4D3!! keep
sha 269b1cea0846965f2d3ecc05a4b7f2d1e0c9a8b7 done
chapter 12 verse 3, then 14-16
Windows 11 and Python 3.13 with 64 bit
a ratio of 16:9, 3.14159 and 2.71828
room 101, floor 7, 50% off
ISBN 978-3-16-148410-0 was printed in 1999
score 3-2 after 90 minutes
from 1914-1918 and 1939-1945
see @home and @user123 online
handle @spark2024 posted
item no. 000123 of 999
mail 3 of the 5 boxes by 7.30 pm
about 7 500 000 people in 27 states
x86 and h264 and mp3 files
""".strip().split("\n")

MARK = re.compile(r"\[(email|ip|card|phone)\|([^\]]*)\]")


def parse_marks(lines: Iterable[str]) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Marked lines as plain texts with their (kind, start, end)."""
    rows = []
    for line in lines:
        text, spans, at = "", [], 0
        for m in MARK.finditer(line):
            text += line[at : m.start()]
            spans.append((m[1], len(text), len(text) + len(m[2])))
            text, at = text + m[2], m.end()
        rows.append((text + line[at:], spans))
    return rows


# -- the plain patterns -------------------------------------------------------------------


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping; each @ is looked at once, so long words cost their length."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = _run_start(text, free, at)
        domain = DOMAIN.match(text, at + 1)
        if start < at and domain:
            found.append((start, domain.end()))
            free = domain.end()
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed and then by start."""
    spans = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not TRIGGER.search(text):
        return spans
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            spans.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() < 40:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m.group())) <= 15:
                spans.append(("phone", *m.span()))
    return spans


# -- the field ----------------------------------------------------------------------------


class _Shapes(dict):
    """Code points to shape letters: 9 for 0-9, A and a for letters, ASCII signs as they are."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        self[point] = "9" if "0" <= c <= "9" else "A" if c.isupper() else "a" if c.isalpha() else c if point < 128 else "~"
        return self[point]


SHAPES = _Shapes()
REPEAT = re.compile(r"(.)\1+")
BUCKETS = (0, 1, 2, 3, 4, 6, 8, 10, 12, 13, 19, 30)


def _bucket(n: int) -> int:
    return int(np.searchsorted(BUCKETS, n))


def shape_features(shape: str) -> tuple[str, ...]:
    """Features of one word from its shape alone; those of very long words are not remembered."""
    return _remembered(shape) if len(shape) <= 64 else _shape_features(shape)


def _shape_features(shape: str) -> tuple[str, ...]:
    core = shape.strip(".,;:!?\"'#*$%&|<>[]{}=~")
    short = REPEAT.sub(r"\1", core)
    digits, letters = core.count("9"), core.count("a") + core.count("A")
    signs = "".join(sorted(set(short) - set("9aA")))
    return (
        f"short={short[:24]}", f"digits={_bucket(digits)}", f"letters={_bucket(letters)}", f"signs={signs}",
        f"mix={_bucket(digits)}/{bool(letters)}/{signs}", f"dots={min(core.count('.'), 4)}",
        f"colons={min(core.count(':'), 5)}", f"ends={core[:1]}{core[-1:]}", f"size={_bucket(len(core))}",
    )


_remembered = lru_cache(maxsize=100_000)(_shape_features)


def word_features(before: str | None, shape: str, after: str | None) -> list[str]:
    """Own features, and the neighbours' with a sign for their side."""
    found = ["bias", *shape_features(shape)]
    for side, other in (("<", before), (">", after)):
        if other is None:
            found.append(side + "none")
        else:
            own = shape_features(other)
            found += [side + own[1], side + own[4]]
    return found


@lru_cache(maxsize=1)
def default_model() -> Chain:
    return fit(parse_marks(LABELLED))


def fit(table: Sequence[tuple[str, Sequence[tuple[str, int, int]]]]) -> Chain:
    """Train from (text, spans) rows. A word belongs to the span that covers one of its digits or its @."""
    chains, tags, allowed = [], [], []
    for text, spans in table:
        words = list(WORD.finditer(text))
        if not words:
            continue
        shapes = [m.group().translate(SHAPES) for m in words]
        around = [None, *shapes, None]
        chains.append([word_features(around[i], s, around[i + 2]) for i, s in enumerate(shapes)])
        marks, before = [], None
        for m in words:
            hit = next((k for k in spans if m.start() < k[2] and k[1] < m.end()), None)
            marks.append("O" if hit is None else f"{'I' if hit is before else 'B'}-{hit[0]}")
            before = hit
        tags.append(marks)
        allowed.append([bool(TRIGGER.search(m.group())) for m in words])
    return train(chains, tags, LABELS, allowed)


EDGE = {
    "email": re.compile(r"[^\s\"'<>(),;:|]*@[^\s\"'<>(),;:|]*[A-Za-z0-9]"),
    "ip": re.compile(r"[0-9A-Fa-f][0-9A-Fa-f:.]*[0-9A-Fa-f]"),
    "card": re.compile(r"[0-9](?:.*[0-9])?", re.S),
    "phone": re.compile(r"(?:\+|\()?[0-9].*[0-9]", re.S),
}


class Tagger:
    """Finds chains of words that may carry a label and decodes those of many texts at once."""

    def __init__(self, model: Chain):
        self.model = model
        self.known: dict[tuple, np.ndarray] = {}

    def __reduce__(self):
        return Tagger, (self.model,)

    def _score(self, before: str | None, shape: str, after: str | None) -> np.ndarray:
        key = (before and shape_features(before), shape_features(shape), after and shape_features(after))
        if key not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[key] = self.model.score(self.model.numbers(word_features(before, shape, after)))
        return self.known[key]

    def _chains(self, text: str) -> list[list[tuple[int, int]]]:
        """Runs of neighbouring words with a digit or an @, as (start, end) lists."""
        runs, last = [], -1
        hit = TRIGGER.search(text)
        while hit:
            start, end = _word_around(text, hit.start())
            if runs and not text[last:start].strip(" \t\n\x0b\x0c\r"):
                runs[-1].append((start, end))
            else:
                runs.append([(start, end)])
            last = end
            hit = TRIGGER.search(text, end)
        return runs

    def spans(self, texts: Sequence[str]) -> list[list[tuple[str, int, int]]]:
        """Labelled spans of each text, whether or not a plain pattern finds them too."""
        found: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        owners, chains = [], []
        for i, text in enumerate(texts):
            for run in self._chains(text):
                shapes = [text[a:b].translate(SHAPES) for a, b in run]
                before, after = _neighbour(text, run[0][0], -1), _neighbour(text, run[-1][1], 1)
                around = [before, *shapes, after]
                chains.append(np.stack([self._score(around[k], s, around[k + 2]) for k, s in enumerate(shapes)]))
                owners.append((i, run))
        for (i, run), path in zip(owners, self.model.viterbi(chains)):
            found[i] += self._join(texts[i], run, path)
        return found

    def _join(self, text: str, run: list[tuple[int, int]], path: np.ndarray) -> list[tuple[str, int, int]]:
        spans, open_span = [], None
        for (start, end), label in zip(run, path.tolist()):
            name = LABELS[label]
            if name == "O":
                open_span = None
            elif name[0] == "I" and open_span and open_span[0] == name[2:]:
                open_span[2] = end
            else:
                open_span = [name[2:], start, end]
                spans.append(open_span)
        cut = [(k, a, EDGE[k].search(text, a, b)) for k, a, b in spans]
        return [(k, *m.span()) for k, _, m in cut if m]


def _is_white(c: str) -> bool:
    return c == " " or "\t" <= c <= "\r"


def _word_around(text: str, at: int) -> tuple[int, int]:
    start = at
    while start and not _is_white(text[start - 1]):
        start -= 1
    return start, WORD.match(text, at).end()


def _run_start(text: str, free: int, at: int) -> int:
    start = at
    while start > free and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
        start -= 1
    return start


def _neighbour(text: str, at: int, step: int) -> str | None:
    """Shape of the word before (-1) or after (1) a place; None at the text's edge."""
    if step > 0:
        m = WORD.search(text, at)
        return m.group().translate(SHAPES) if m else None
    end = at
    while end and _is_white(text[end - 1]):
        end -= 1
    if not end:
        return None
    start = end
    while start and not _is_white(text[start - 1]):
        start -= 1
    return text[start:end].translate(SHAPES)


def merge(base: list[tuple[str, int, int]], added: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Base spans and those added ones that overlap none of them, by kind and start."""
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    reach, most = [], 0
    for _, b in taken:
        most = max(most, b)
        reach.append(most)
    fresh = []
    for kind, a, b in added:
        k = int(np.searchsorted(starts, b))  # base spans that start before b
        if k == 0 or reach[k - 1] <= a:
            fresh.append((kind, a, b))
    return sorted({*base, *fresh}, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def listed(spans: Iterable[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(df: DataFrame, key: str, text: str, model: Chain | None = None) -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans): one row per row of ``df``.

    Counts and digest are of the plain patterns; ``spans`` has all. A null or empty text has none.
    Repeated rows and null keys are kept; other columns are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(Tagger(model or default_model()))

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            every = [merge(b, a) for b, a in zip(base, shared.value.spans(texts))]
            counts = [pa.array([sum(k == kind for k, _, _ in b) for b in base], pa.int64()) for kind in KINDS]
            digests = pa.array([sha256(listed(b).encode()).hexdigest() for b in base], pa.string())
            spans = pa.array([listed(s) for s in every], pa.string())
            names = [key, *[f"n_{k}" for k in KINDS], "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, spans], names=names)

    kind = df.schema[key].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, {counts}, base_sha256 string, spans string")


def mask(text: str, spans: Iterable[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind; overlapping spans become one."""
    parts, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            parts += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def redact(df: DataFrame, text: str, model: Chain | None = None) -> DataFrame:
    """``df`` with personal data in ``text`` replaced by <EMAIL>, <IP>, <CARD> or <PHONE>; null stays null."""
    shared = df.sparkSession.sparkContext.broadcast(Tagger(model or default_model()))
    place = df.columns.index(text)

    def run(batches):
        for batch in batches:
            raw = batch.column(place).to_pylist()
            texts = [t or "" for t in raw]
            every = zip(raw, texts, shared.value.spans(texts))
            clean = [None if r is None else mask(t, merge(base_spans(t), a)) for r, t, a in every]
            columns = [pa.array(clean, pa.string()) if i == place else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, fields)
