"""Token counts, token alignment and the filter audit against plain versions and edge cases."""

import random
import re
from collections import Counter, defaultdict
from hashlib import sha256
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

import __spark_entry__ as entry
from oracle import compare, duck

FOLDER = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, lang string, n_tokens string, n_a string, block string, part string, _key string, _text string, `key` string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, a very long one, ties, repeated rows and clashing names."""
    long_text = "one two three four Five 6 seven é ñ 日本語 " * 20_000
    rows = [
        (1, "a plain text of some words", "en"), (1, "a plain text of some words", "en"), (2, None, None), (None, "no key", "en"),
        (None, None, ""), (3, "", "de"), (4, " \n\t ", "de"), (5, long_text, None), (6, "a plain text of some words", "fr"),
        (7, "x▁y <s> <|endoftext|> \x00", "fr"), (0, "a plain text of some words", "zz"),
    ]
    return spark.createDataFrame([(*r, "n", "a", "b", "p", "k", "t", "q") for r in rows], ODD)


# -- token counts ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def counter():
    from textloom.llm import token_counts

    return token_counts.load_counter(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_counts_equal_the_library(counter, library):
    draw = random.Random(1)
    texts = [
        "", "<|endoftext|>", "a<|startoftext|>b", "<|endoftext|", "aaaaaaa", "İstanbul ΣΑΣ Σ", "é Å",
        "don't I'LL 'S", "\x00\x1f\x85  x", "123 4५६", "ﬁ①", "日本語" * 500, "ab" * 3000, "x" * 5000,
    ]
    for _ in range(400):
        signs = [(32, 127), (0x20, 0x800), (0x800, 0xD800), (0xE000, 0x20000), (0x20, 0x21), (0x27, 0x28)]
        texts.append("".join(chr(draw.randrange(*draw.choice(signs))) for _ in range(60)))
    assert counter.count(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_every_code_point_is_split_alike(counter, library):
    texts = []
    for first in range(0, 0x110000, 64):
        points = [p for p in range(first, first + 64) if not 0xD800 <= p < 0xE000]
        texts.append("".join(f"a{chr(p)}{chr(p)}b1{chr(p)}" for p in points))
    assert counter.count(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_slices_do_not_change_counts(counter, monkeypatch):
    from textloom.llm import token_counts

    texts = ["some words, it's 42 here " * 50, "x" * 300, "日本 " * 40]
    whole = counter.count(texts)
    monkeypatch.setattr(token_counts, "SLICE", 16)
    monkeypatch.setattr(token_counts, "REMEMBERED_WORDS", 3)
    assert counter.count(texts) == whole


def test_merges_out_of_order_are_refused():
    from textloom.llm import token_counts

    from textloom.llm.bpe import byte_letters

    vocabulary = {c: i for i, c in enumerate(byte_letters())}
    vocabulary |= {c + "</w>": 256 + i for c, i in list(vocabulary.items())} | {"ab": 512, "abc": 513}
    with pytest.raises(ValueError):
        token_counts.MergeTable(vocabulary, [("ab", "c"), ("a", "b")], "</w>")
    table = token_counts.MergeTable(vocabulary, [("a", "b"), ("ab", "c")], "</w>")
    assert table.survivors([b"abcab", b"x", b"ababab"]).tolist() == [3, 1, 4]


def test_counts_of_odd_rows(spark, odd, counter, library):
    from textloom.llm import token_counts

    got = token_counts.count_tokens(odd, "doc_id", "text", counter, 2048).collect()
    want = [(r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.collect()]
    assert Counter((r[0], r[1], r[2]) for r in got) == Counter(want)
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got) and any(r.over_limit for r in got)
    assert token_counts.count_tokens(odd.limit(0), "doc_id", "text", counter, 1).count() == 0
    assert token_counts.count_tokens(odd.select("text", F.lit(1).alias("n_tokens")), "n_tokens", "text", counter, 1).columns[0] == "n_tokens"


def test_counts_of_the_table(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = entry.queries()["op11_rank_merging"](spark, FOLDER).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.n_tokens == len(library.encode(docs[r.doc_id] or "", add_special_tokens=False).ids)


# -- token alignment ------------------------------------------------------------------------


def test_pieces_of_any_size_align_alike():
    from textloom.llm import token_alignment

    draw = random.Random(3)
    for _ in range(500):
        n = draw.randrange(1, 40)
        a, b = (sorted({n, *draw.sample(range(1, n + 1), draw.randrange(1, n + 1))}) for _ in range(2))
        found = token_alignment.align(np.array(a), np.array(b), steps=draw.choice([1, 2, 3, 5, 256]))
        spans = [list(zip([0, *ends[:-1]], ends)) for ends in (a, b)]
        links = [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (t, f) in enumerate(spans[1]) if s < f and t < e]
        common = sorted(set(a) & set(b))
        assert list(zip(found.left.tolist(), found.right.tolist())) == links
        assert [a[x - 1] for x in found.left_ends] == common == [b[x - 1] for x in found.right_ends]
        assert found.group.tolist() == [sum(c < a[i] and c < b[j] for c in common) for i, j in links]
    nothing = np.zeros(0, np.int64)
    assert not len(token_alignment.align(nothing, nothing).left)


def plain_alignment(texts):
    """Every text's row by nested loops."""
    from textloom.llm.bpe import byte_letters

    left = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    left.encode_special_tokens = True
    right = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = byte_letters()
    spelled = {i: bytes(letters[c] for c in t) for t, i in left.get_vocab(False).items()}

    def piece(i):
        s = right.id_to_piece(i)
        return bytes([int(s[3:5], 16)]) if right.is_byte(i) else s.replace("▁", " ").encode()

    rows = []
    for t in texts:
        wanted = (" " + (t or "")).encode()
        a = [(i, spelled[i]) for i in left.encode(" " + t, add_special_tokens=False).ids] if t else []
        b = [(i, piece(i)) for i in right.encode(t)] if t else []
        if not t or b"".join(x for _, x in a) != wanted or b"".join(x for _, x in b) != wanted:
            rows.append(None)
            continue
        spans = []
        for side in (a, b):
            ends = np.cumsum([len(x) for _, x in side]).tolist()
            spans.append([(i, s, e) for (i, _), s, e in zip(side, [0, *ends[:-1]], ends)])
        groups, links, start = [], [], 0
        for cut in sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]}):
            inside = [[x for x in side if start <= x[1] and x[2] <= cut] for side in spans]
            groups.append("|".join(",".join(str(i) for i, _, _ in side) for side in inside))
            links += [(x[0], y[0]) for x in inside[0] for y in inside[1] if x[1] < y[2] and y[1] < x[2]]
            start = cut
            spans = [side[len(part):] for side, part in zip(spans, inside)]
        rows.append((len(a), len(b), len(groups), links, sha256(";".join(groups).encode()).hexdigest()))
    counts, best = Counter(), defaultdict(int)
    for row in rows:
        counts.update(set(row[3]) if row else ())
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    return [
        (0, 0, 0, 0, 0, 0, "") if r is None
        else (*r[:3], len(r[3]), sum(counts[x] == best[x[0]] for x in r[3]), sum(counts[x] for x in r[3]), r[4])
        for r in rows
    ]


@pytest.fixture(scope="module")
def sides():
    from textloom.llm import token_alignment

    return token_alignment.load_sides(
        public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")
    )


def test_left_side_equals_its_library(sides):
    from textloom.llm import token_alignment

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    sides.encode("x")
    texts = ["a" + c * n + "b" for c in " \n\u00a0\u3000" for n in (1, token_alignment.LONG_SPACE - 1, token_alignment.LONG_SPACE, 400_000)]
    texts += [" <|endoftext|> it's 12 ", "日本" * 2000]
    for first in range(0, 0x110000, 256):
        points = [p for p in range(first, first + 256) if not 0xD800 <= p < 0xE000]
        texts.append("".join(f" a{chr(p)}{chr(p)}1{chr(p)} {chr(p)}" for p in points))
    assert all(sides.left(t) == library.encode(t, add_special_tokens=False).ids for t in texts)


def test_alignment_of_odd_rows(spark, odd, sides, monkeypatch):
    from textloom.llm import token_alignment

    short = odd.withColumn("text", F.when(F.col("doc_id") == 5, F.substring("text", 1, 400)).otherwise(F.col("text")))
    rows = short.collect()
    want = Counter((r.doc_id, *x) for r, x in zip(rows, plain_alignment([r.text for r in rows])))
    assert want[(2, 0, 0, 0, 0, 0, 0, "")] == 1 and want[(7, 0, 0, 0, 0, 0, 0, "")] == 1
    for cut in (token_alignment.BLOCK_TEXTS, 2):  # one block and many give the same
        monkeypatch.setattr(token_alignment, "BLOCK_TEXTS", cut)
        got = token_alignment.compare(short, "doc_id", "text", sides)
        assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert Counter(tuple(r) for r in got.collect()) == want
    assert token_alignment.compare(odd.limit(0), "doc_id", "text", sides).count() == 0
    whole = token_alignment.compare(odd.where("doc_id = 5"), "doc_id", "text", sides).first()
    assert whole.n_links == whole.n_a + whole.n_b - whole.n_groups > 100_000


def test_alignment_of_the_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    got = {r[0]: tuple(r[1:]) for r in entry.queries()["op12_merge_path"](spark, FOLDER).collect()}
    assert len(got) == len(docs)
    for r, row in zip(docs, plain_alignment([r.text for r in docs])):
        assert got[r.doc_id] == row


# -- filter audit ---------------------------------------------------------------------------


def test_positional_counts():
    from textloom.llm import filter_audit

    draw = np.random.default_rng(5)
    for n in (0, 1, 2, 3, 7, 100, 4097):
        words = draw.integers(0, 1 << 32, n, dtype=np.uint32)
        want = ((words[:, None] >> np.arange(32, dtype=np.uint32)) & 1).sum(axis=0)
        assert filter_audit.positional_counts(words).tolist() == want.tolist()
    word = int(filter_audit.survival_words(np.array([0b10010]))[0])
    assert all((word >> s & 1) == (s & 0b10010 == 0) for s in range(32))


def test_audit_equals_sql(spark):
    out = compare(entry.queries()["op13_truth_table_words"](spark, FOLDER), duck(FOLDER), entry.oracle_sql()["op13_truth_table_words"])
    assert out[0] is None and out[1] % 600 == 0, out


def test_audit_of_odd_rows(spark, odd):
    from textloom.llm import filter_audit

    labels = spark.createDataFrame(
        [(1, 1, 0, "x"), (1, 0, 1, "x"), (6, 1, 1, "x"), (5, None, 1, "x"), (99, 1, 1, "x"), (None, 1, 1, "x")],
        "doc_id long, quality int, toxic int, part string",
    )
    rows = odd.collect()
    marks = {1: (True, True), 6: (True, True), 5: (False, True)}
    first = {}
    for r in rows:
        if r.doc_id is not None:
            first[r.text or ""] = min(first.get(r.text or "", r.doc_id), r.doc_id)
    fails = []
    for r in rows:
        text = r.text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        fails.append((
            len(words) < 200, 100 * len(set(words)) < 50 * len(words),
            100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), any(c in "#$%&*|" for c in text),
            r.doc_id is not None and r.doc_id > first[text],
        ))
    counts = filter_audit.survivors(
        odd, "doc_id", "text", "lang", filter_audit.text_failures("text"), labels, "doc_id", F.col("quality") == 1, F.col("toxic") == 1
    )
    got = {(r.part, r.filter_order, r.step): r for r in filter_audit.audit(counts, "ABCDE").collect()}
    assert len(got) == 600 * len({r.lang or "" for r in rows})
    shapley = Counter()
    for (part, order, step), r in got.items():
        own = "ABCDE".index(order[step - 1])
        earlier = ["ABCDE".index(c) for c in order[: step - 1]]
        mine = [(f, marks.get(x.doc_id, (False, False))) for f, x in zip(fails, rows) if (x.lang or "") == part]
        left = [(f, m) for f, m in mine if not any(f[i] for i in earlier)]
        out = [(f, m) for f, m in left if f[own]]
        assert (r.kept, r.removed) == (len(left) - len(out), len(out))
        assert r.redundant == sum(f[own] for f, _ in mine) - len(out)
        assert r.unique_fails == sum(f[own] and sum(f) == 1 for f, _ in mine)
        assert (r.good_lost, r.toxic_lost) == (sum(m[0] for _, m in out), sum(m[1] for _, m in out))
        shapley[part, order[step - 1]] += r.removed
    assert all(r.shapley == shapley[part, order[step - 1]] for (part, order, step), r in got.items())
    assert {o for _, o, _ in got} == {"".join(p) for p in permutations("ABCDE")}
    nothing = filter_audit.survivors(
        odd.limit(0), "doc_id", "text", "lang", filter_audit.text_failures("text"), labels, "doc_id", F.lit(True), F.lit(None).cast("boolean")
    )
    assert filter_audit.audit(nothing, "ABCDE").count() == 0
    with pytest.raises(ValueError):
        filter_audit.survivors(odd, "doc_id", "text", "lang", [F.lit(True)] * 5, labels, "doc_id", F.lit(True), F.lit(True))
