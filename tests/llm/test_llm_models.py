"""Tokens, packing, vectors, personal data, pages and secrets against plain versions and edge cases."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(FILE)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@pytest.fixture(scope="module")
def automaton():
    from textloom.llm import bpe

    return bpe.load(FILE)


@pytest.fixture(scope="module")
def odd(spark):
    long_text = "müßig 12 ab\n" * 20_000
    rows = [(1, "a b"), (1, "a b"), (2, None), (None, "x"), (None, None), (3, ""), (4, long_text), (5, "<|endoftext|>é<|endoftext|>")]
    return spark.createDataFrame(
        [(k, t, "n", "s") for k, t in rows], "doc_id long, text string, n_tokens string, start string"
    )


# -- the merge automaton ------------------------------------------------------------------


def test_automaton_of_a_toy_vocabulary():
    """Every string over two letters, against merging step by step."""
    from itertools import product

    from textloom.llm import bpe

    merges = [(b"a", b"b"), (b"a", b"a"), (b"aa", b"ab"), (b"b", b"b"), (b"ab", b"ab"), (b"aa", b"aa"), (b"bb", b"a")]
    ids = {b"a": 0, b"b": 1} | {a + b: 2 + i for i, (a, b) in enumerate(merges)}
    labels = sorted(ids, key=ids.get)
    toy = bpe.Automaton(labels, ids, {}, ".+", *bpe.compile_merges({b"a": 0, b"b": 1}, merges, ids))

    def step_by_step(word):
        parts = [bytes([c]) for c in word]
        for a, b in merges:
            i = 0
            while i < len(parts) - 1:
                if (parts[i], parts[i + 1]) == (a, b):
                    parts[i : i + 2] = [a + b]
                i += 1
        return tuple(ids[p] for p in parts)

    for n in range(1, 12):
        for letters in product(b"ab", repeat=n):
            word = bytes(letters)
            assert toy.path(word) == step_by_step(word), word


def test_automaton_equals_library(library, automaton):
    rnd = random.Random(1)
    pool = list("aaaab  \n\t'stremvld0123²½Ⅳ٣éñß中文字日本ａ ​\x1c\x85😀👍🏽_-!?́ẞ𝒜Ᲊ") + ["<|endoftext|>", "'re", " the"]
    for i in range(1_500):
        text = "".join(rnd.choices(pool, k=rnd.randint(0, 60)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert automaton.encode(text) == ids, repr(text)
        assert automaton.decode(ids).decode("utf-8", "replace") == library.decode(ids, skip_special_tokens=False)


def test_automaton_takes_long_words(library, automaton):
    for text in ("ab" * 30_000, "a" * 20_001, " " * 20_000 + "x"):
        assert automaton.encode(text) == library.encode(text, add_special_tokens=False).ids


def digests(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    back = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_round_trip_query(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = entry.queries()["op5_merge_automaton"](spark, FOLDER).collect()
    assert len(rows) == len(docs)
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == digests(library, docs[r.doc_id]) for r in rows)


def test_encode_edges(spark, library, odd):
    from textloom.llm import bpe

    got = sorted(map(str, ((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(odd, "doc_id", "text", FILE).collect())))
    assert got == sorted(str((r.doc_id, *digests(library, r.text))) for r in odd.collect())
    tokens = bpe.encode_texts(odd, "doc_id", "text", FILE)
    back = bpe.decode_ids(tokens, "doc_id", "ids", FILE)
    assert sorted(r.text for r in back.collect()) == sorted(r.text or "" for r in odd.collect())
    assert bpe.round_trip(odd.limit(0), "doc_id", "text", FILE).count() == 0


# -- packing ------------------------------------------------------------------------------


def check_packing(pieces, documents, library, longest=1024):
    """``documents``: (key, text) rows; every number in one piece, sequences gapless and full."""
    expected = sorted(
        (k if k is not None else -1, [*library.encode(t or "", add_special_tokens=False).ids, 0]) for k, t in documents
    )
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append(p)
        assert p.length > 0 and len(p.ids) == p.length
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
    for rows in sequences.values():
        at = 0
        for p in sorted(rows, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == rows[0].sequence_tokens <= longest and at & (at - 1) == 0
    parts = {}
    for p in pieces:
        parts.setdefault((p.doc_id if p.doc_id is not None else -1, p.doc_tokens), []).append(p)
    total = sum(p.length for p in pieces)
    assert total == sum(len(ids) for _, ids in expected)
    for key, ids in expected:
        mine = sorted(parts[key, len(ids)], key=lambda p: p.start)
        covered = sorted({i for p in mine for i in range(p.start, p.start + p.length)})
        assert covered == list(range(len(ids)))
        assert all(p.ids == ids[p.start : p.start + p.length] for p in mine) or len({tuple(i) for k, i in expected if k == key}) > 1


def test_packing(spark, library):
    from textloom.llm import packing

    tokens = packing.load_tokens(FILE, public_tokenizers.PATTERN)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    packed = packing.pack(docs, "doc_id", "text", tokens, keep_ids=True)
    pieces = packed.collect()
    check_packing(pieces, [tuple(r) for r in docs.collect()], library)
    assert packing.padding(packed).first().padding == 0
    assert entry.queries()["op1_tiered_packing"](spark, FOLDER).count() == len(pieces)
    groups = {}
    for p in pieces:
        groups.setdefault(p.step_group, set()).add((p.sequence_id, p.sequence_tokens))
    assert all(sum(n for _, n in g) <= packing.STEP_TOKENS and len({n for _, n in g}) == 1 for g in groups.values())


def test_packing_edges(spark, library, odd):
    from textloom.llm import packing

    tokens = packing.load_tokens(FILE, public_tokenizers.PATTERN)
    pieces = packing.pack(odd, "doc_id", "text", tokens, keep_ids=True).collect()
    check_packing(pieces, [(r.doc_id, r.text) for r in odd.collect()], library)
    assert packing.pack(odd.limit(0), "doc_id", "text", tokens).count() == 0
    with pytest.raises(ValueError):
        packing.pack(odd, "doc_id", "text", tokens, tiers=(100, 1000))


def test_step_groups_are_even():
    from textloom.llm import packing

    rnd = random.Random(2)
    windows = [[("d", 0, n), ("d", n, 1024 - n)] for n in (rnd.randint(1, 1023) for _ in range(64))]
    groups = packing.step_groups(windows, 8192, 0)
    costs = [0] * 8
    for w, g in zip(windows, groups):
        costs[g] += sum(p[2] ** 2 for p in w)
    assert sorted(groups.count(g) for g in range(8)) == [8] * 8 and max(costs) < 1.1 * min(costs)


# -- vectors ------------------------------------------------------------------------------


def plain_links(keys, vectors, threshold=0.95):
    units = [None if v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) or not any(v) or k is None
             else np.array(v, float) / np.linalg.norm(np.array(v, float)) for k, v in zip(keys, vectors)]
    n, label = len(keys), list(range(len(keys)))
    links = [0] * n
    for i in range(n):
        for j in range(i):
            if units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold:
                links[i] += 1
                links[j] += 1
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return links, [None if keys[i] is None else min(keys[j] for j in range(n) if label[j] == label[i] and keys[j] is not None) for i in range(n)]


def test_vectors_equal_brute_force(spark):
    from textloom.llm import pq

    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding").collect()
    rnd = np.random.default_rng(4)
    keys, vectors = [r.vec_id for r in rows][:400], [r.embedding for r in rows][:400]
    for i in range(150):  # chains and crowds of near copies, some of them equal
        base = np.array(vectors[i % 20])
        keys.append(10_000 + i)
        vectors.append([float(x) for x in np.float32(base + (i % 5) * 0.03 * rnd.normal(size=64) / 8 ** 0.5)])
    table = spark.createDataFrame(list(zip(keys, vectors)), "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in pq.near_duplicates(table, "vec_id", "embedding").collect()}
    links, components = plain_links(keys, vectors)
    found = sum(got[k].n_links for k in keys)
    assert found <= sum(links) and found >= 0.98 * sum(links)
    same = sum(got[k].component_id == c for k, c in zip(keys, components))
    assert same >= 0.99 * len(keys) and all(got[k].kept == (got[k].component_id == k) for k in keys)


@pytest.mark.parametrize("kind", ["low rank", "one axis"])
def test_neighbours_in_few_directions_are_all_linked(spark, kind):
    from textloom.llm import pq

    rnd = np.random.default_rng(8)
    base = rnd.normal(size=(600, 3)) @ rnd.normal(size=(3, 64))
    if kind == "one axis":  # copies moved along one axis, just above the threshold
        base = pq.unit(base)
        base = np.r_[base, base + 0.3 * np.eye(64)[0]]
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(base)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in pq.near_duplicates(table, "vec_id", "embedding").collect()}
    cosines = pq.unit(base) @ pq.unit(base).T
    assert np.abs(cosines - 0.95).min() > 1e-9
    want = (cosines >= 0.95).sum(axis=1) - 1
    assert [got[i] for i in range(len(base))] == want.tolist() and want.sum() > 1000


def test_vector_edges(spark):
    from textloom.llm import pq

    one, two = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [
        (5, one), (3, one), (3, one), (7, [2.0, 0.1, 0.0]), (1, two), (2, None), (4, []), (6, [0.0, 0.0, 0.0]),
        (8, [1.0, None, 0.0]), (9, [float("nan"), 1.0, 0.0]), (10, [float("inf"), 1.0, 0.0]), (None, one), (11, [1.0, 0.0]),
    ]
    table = spark.createDataFrame([(k, v, "x") for k, v in rows], "vec_id long, embedding array<double>, n_links string")
    got = pq.near_duplicates(table, "vec_id", "embedding").collect()
    assert len(got) == len(rows)
    links, components = plain_links([k for k, _ in rows], [v for _, v in rows])
    want = sorted(str((k, n, c, c is not None and c == k)) for (k, _), n, c in zip(rows, links, components))
    assert sorted(str((r.vec_id, r.n_links, r.component_id, r.kept)) for r in got) == want
    assert pq.near_duplicates(table.limit(0), "vec_id", "embedding").count() == 0
    assert pq.near_duplicates(table.where("vec_id = 2"), "vec_id", "embedding").count() == 1


def test_blocks_give_the_same(spark, monkeypatch):
    from textloom.llm import pq

    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    whole = sorted(map(tuple, pq.near_duplicates(rows, "vec_id", "embedding").collect()))
    monkeypatch.setattr(pq, "BLOCK", 16)
    assert sorted(map(tuple, pq.near_duplicates(rows, "vec_id", "embedding").collect())) == whole


# -- personal data ------------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    found = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            luhn = sum((int(d) * (1 + i % 2) - 9 * (int(d) * (1 + i % 2) > 9)) for i, d in enumerate(reversed(digits))) % 10 == 0
            good = {
                "email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True,
                "card": 13 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((kind, *m.span()))
    return found


def test_plain_patterns(spark):
    from textloom.llm import pii

    rnd = random.Random(3)
    bits = ["1", "2", "255", "3.", "4", "@", "a", ".", "-", "+", " ", "(", ")", "é", "_", "%", "4111111111111111"]
    for _ in range(20_000):
        text = "".join(rnd.choices(bits, k=rnd.randint(0, 30)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_field_on_held_out_lines():
    """Five folds of the labelled table: spans of lines the field was not trained on."""
    from textloom.llm import pii

    table = pii.parse_marks(pii.LABELLED)
    hit = wrong = total = 0
    for k in range(5):
        tagger = pii.Tagger(pii.fit([r for i, r in enumerate(table) if i % 5 != k]))
        held = [r for i, r in enumerate(table) if i % 5 == k]
        for (_, want), got in zip(held, tagger.spans([t for t, _ in held])):
            total += len(want)
            hit += len(set(want) & set(got))
            wrong += len(set(got) - set(want))
    assert hit >= 0.75 * total and wrong <= 0.25 * total


def test_viterbi_against_all_paths():
    from itertools import product

    from textloom.llm.crf import Chain

    rnd = np.random.default_rng(1)
    model = Chain("OAB", {}, np.zeros((0, 3)), rnd.normal(size=(3, 3)))
    chains = [rnd.normal(size=(n, 3)) for n in (4, 1, 6, 2, 6)] + [np.zeros((0, 3))]
    for chain, path in zip(chains, model.viterbi(chains)):
        def worth(labels):
            steps = [0, *labels, 0]
            return sum(model.transition[a, b] for a, b in zip(steps, steps[1:])) + sum(chain[t, x] for t, x in enumerate(labels))
        if len(chain):
            assert tuple(path) == max(product(range(3), repeat=len(chain)), key=worth)


def test_personal_data_query(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = entry.queries()["op7_shape_field"](spark, FOLDER).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = plain_spans(docs[r.doc_id])
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for x, _, _ in base) for k in PLAIN]
        every = r.spans.split(",") if r.spans else []
        assert set(listed.split(",")) - {""} <= set(every)
        assert every == sorted(every, key=lambda s: (list(PLAIN).index(s.split(":")[0]), int(s.split(":")[1])))
        if not re.search("[0-9@]", docs[r.doc_id]):
            assert not every


def test_personal_data_edges(spark, odd):
    from textloom.llm import pii

    got = pii.find(odd, "doc_id", "text").collect()
    assert len(got) == 8 and all(r.spans == "" for r in got)
    table = spark.createDataFrame([(1, "a b@c.de 4556737586899855", 5), (2, None, 6), (3, "", 7)], "doc_id long, text string, spans long")
    clean = {r.doc_id: (r.text, r.spans) for r in pii.redact(table, "text").collect()}
    assert clean == {1: ("a <EMAIL> <CARD>", 5), 2: (None, 6), 3: ("", 7)}
    assert pii.find(odd.limit(0), "doc_id", "text").count() == 0
    for text in ("1" * 50_000, "1 " * 20_000, "a@" * 20_000, "@" * 20_000, "+1" * 20_000):
        pii.base_spans(text)


# -- pages --------------------------------------------------------------------------------


def test_pages_of_the_table(spark):
    from html import unescape

    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    rows = entry.queries()["op9_text_density"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(pages)
    for r in rows:
        page = pages[r.page_id]
        article = page[page.index("<article>") : page.index("</article>")]
        blocks = (" ".join(unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


BODY = "<p>First paragraph with   enough words to be the text of an article.<p>Second &lt;one&gt; with <a href=x>a link</a>.<br>More."


@pytest.mark.parametrize("page", [
    f"<body><header><a>Home</a></header><div class='post-body'><h2>Title &amp; more</h2>{BODY}</div><footer>f</footer>",
    f"<body><div id=wrap><div class=main><h2>Title &amp; more</h2>{BODY}</div><div class=sidebar><ul><li><a>one</a><li><a>two</a></ul></div></div>",
    f"<main><h2>Title &amp; more</h2>{BODY}<div class='share-bar'>Share</div></main><section id=comments><p>{'long reader comment ' * 30}</section>",
    f"<article class='has-sidebar'><h2>Title &amp; more</h2>{BODY}<form>Sign up<input></form><script>if(a<b)document.write('<p>x</p>')</script></article><aside>s</aside>",
    f"<body><div class=cookie-notice>We use cookies</div><nav><a>m</a></nav><div><h2>Title &amp; more</h2>{BODY}<ul class=links><li><a>rel one</a><li><a>rel two</a></ul></div>",
])
def test_article_without_its_surroundings(page):
    from textloom.llm.html_density import main_text

    want = "Title & more\nFirst paragraph with enough words to be the text of an article.\nSecond <one> with a link. More."
    assert main_text(page) == want


@pytest.mark.parametrize("page", [
    f"<body><form id='aspnetForm'><input name=q><nav><a>m</a></nav><div><h2>Title &amp; more</h2>{BODY}</div><select><option>x</select></form></body>",
    f"<body><h1>Site</h1><form class=form role=form><div><h2>Title &amp; more</h2>{BODY}</div></form><footer>f</footer>",
    f"<body><form action=/find><input name=q><nav><a>m</a></nav><article><h2>Title &amp; more</h2>{BODY}</article><aside><p>short</aside>",
    f"<body><main><fieldset><h2>Title &amp; more</h2>{BODY}</fieldset></main><form>Sign up<input></form>",
    f"<body><aside><div><h2>Title &amp; more</h2>{BODY}</div></aside><form>Find<input></form>",
    f"<body><dialog open><article><h2>Title &amp; more</h2>{BODY}</article></dialog>",
    f"<body><form><article><h2>Title &amp; more</h2>{BODY}</article></form><aside><article><p>teaser</article></aside>",
    f"<body><article><h2>Title &amp; more</h2>{BODY}</article><aside><article><p>{'other story ' * 5}</article></aside><form><h1>Find</h1><p>it</form>",
    f"<body><form><fieldset><h2>Title &amp; more</h2>{BODY}</fieldset><fieldset><p>Send a note<input></fieldset></form>",
    f"<body><div class=menu><h2>Title &amp; more</h2>{BODY}</div><form><p>Search here<input></form>",
    f"<body><form><fieldset><h2>Title &amp; more</h2><p>First paragraph with enough words to be the text of an article.</fieldset><fieldset><p>Second &lt;one&gt; with <a href=x>a link</a>.<br>More.</fieldset></form>",
])
def test_article_in_a_page_wide_wrapper(page):
    test_article_without_its_surroundings(page)


class Tree:
    """A page without void or unclosed elements as nested nodes (tag, children and texts)."""

    def __init__(self, html):
        from html.parser import HTMLParser

        root = self.root = ("#root", [])
        stack = [root]

        class Reader(HTMLParser):
            def handle_starttag(self, tag, attributes):
                stack[-1][1].append((tag, []))
                stack.append(stack[-1][1][-1])

            def handle_endtag(self, tag):
                stack.pop()

            def handle_data(self, data):
                stack[-1][1].append(data)

        Reader().feed(html)


def plain_density(html):
    """The main text by recursion: sums of child densities, threshold of the path, marked nodes."""
    body = Tree(html).root[1][0][1][-1]

    def walk(node):
        yield node
        for c in node[1]:
            if isinstance(c, tuple):
                yield from walk(c)

    def chars(node, linked=False, only=False):
        linked = linked or node[0] == "a"
        found = 0
        for c in node[1]:
            found += chars(c, linked, only) if isinstance(c, tuple) else len(c.strip()) * (linked or not only)
        return found

    share = chars(body, only=True) / chars(body)

    def density(node):
        c, lc = chars(node), chars(node, only=True)
        t, lt = max(len(list(walk(node))) - 1, 1), sum(n[0] == "a" for n in walk(node)) - (node[0] == "a")
        if not c:
            return 0.0
        base = math.log(c * lc / max(c - lc, 1) + share * c + math.e) + math.e - 1
        return c / t * math.log(1 + (c / max(lc, 1)) * (t / max(lt, 1))) / math.log(base)

    def total(node):
        return sum(density(c) for c in node[1] if isinstance(c, tuple) and c[0] != "a")

    def top(node):
        return max((n for n in walk(node) if n[0] != "a"), key=total)  # the first of equal ones

    best = top(body)
    path = [n for n in walk(body) if any(m is best for m in walk(n))]
    threshold = min(map(density, path))
    marked = []

    def mark(node):
        if density(node) >= threshold:
            marked.append(top(node))
            for c in node[1]:
                if isinstance(c, tuple) and c[0] != "a":
                    mark(c)

    mark(body)
    for n in path:
        if n is not best and (n is not body or any(c is best for c in body[1])):
            marked.extend(c for c in n[1] if isinstance(c, tuple) and c[0] in ("p", "h1", "h2", "h3") and chars(c, only=True) < chars(c))
    kept = [m for n in walk(body) for m in marked if m is n]

    def blocks(node, inside):
        inside = inside or any(node is m for m in kept)
        line = []
        for c in node[1]:
            if isinstance(c, str):
                line.append(c if inside else "")
            elif c[0] == "a":
                line.append("".join(x for x in c[1]) if inside else "")
            else:
                yield " ".join("".join(line).split())
                line = []
                yield from blocks(c, inside)
        yield " ".join("".join(line).split())

    return "\n".join(b for b in blocks(body, False) if b)


def made_page(draw):
    """An article in nested boxes, with short columns and link lists around it, no telling names; and its text."""
    words = lambda n: " ".join("".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randrange(2, 9))) for _ in range(n))
    lines = [words(draw.randrange(3, 8)), *[words(draw.randrange(40, 120)) + "." for _ in range(draw.randrange(3, 9))]]
    inner = f"<h1>{lines[0]}</h1>" + "".join(f"<p>{x}</p>" for x in lines[1:])
    for _ in range(draw.randrange(1, 3)):
        inner = f"<div>{inner}</div>"

    def column():
        kind = draw.randrange(3)
        items = [words(draw.randrange(1, 4)) for _ in range(draw.randrange(2, 7))]
        if kind == 0:
            return "<div><ul>" + "".join(f"<li><a href='/x'>{x}</a></li>" for x in items) + "</ul></div>"
        if kind == 1:
            return "<div><h3>" + words(2) + "</h3><ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul></div>"
        return "<div>" + "".join(f"<div><h3>{x}</h3><p>{words(2)}</p></div>" for x in items) + "</div>"

    parts = [column() for _ in range(draw.randrange(0, 3))] + [inner] + [column() for _ in range(draw.randrange(0, 3))]
    whole = f"<div>{''.join(parts)}</div>" if draw.random() < 0.5 else "".join(parts)
    return f"<html><body>{whole}</body></html>", "\n".join(lines)


def test_made_pages_by_density_alone():
    from textloom.llm.html_density import main_text

    draw = random.Random(9)
    for _ in range(200):
        page, want = made_page(draw)
        assert main_text(page) == want == plain_density(page)


def test_columns_beside_an_article():
    """One box around opening hours, an article and a column of weather and a poll."""
    from textloom.llm.html_density import main_text

    text = "The council met on a rainy evening to discuss the new bridge over the river and its price. "
    article = "".join(f"<p>{text * n}</p>" for n in (3, 2, 4, 1))
    page = (
        "<body><div><div><h3>Opening hours</h3><ul><li>Monday 9 to 5</li><li>Friday 9 to 12</li></ul></div>"
        f"<div><h1>The bridge</h1>{article}</div>"
        "<div><h3>Weather</h3><p>Rain, 12 degrees</p><h3>Poll</h3><p>Do you like it?</p><ul><li>Yes</li><li>No</li></ul></div></div>"
    )
    assert main_text(page) == "\n".join(["The bridge", *[(text * n).strip() for n in (3, 2, 4, 1)]])
    assert main_text(page.replace("<body><div>", "<body><main>")) == main_text(page)


def test_page_edges(spark):
    from textloom.llm import html_density

    pages = [None, "", "<", "plain & text", "<p>a<p>b", "<div>" * 3000 + "x", "<a" * 3000, "<script>x", "<!-- c", "a < b", "<p>é&#233;&nbsp;x</p>"]
    want = ["", "", "<", "plain & text", "a\nb", "x", "", "", "", "a < b", "éé x"]
    table = spark.createDataFrame([(i, h, "t") for i, h in enumerate(pages)], "page_id long, html string, text string")
    got = sorted(map(tuple, html_density.extract(table, "html").collect()))
    assert got == [(i, w, len(w)) for i, w in enumerate(want)]
    assert html_density.extract(table.limit(0), "html").count() == 0


# -- secrets ------------------------------------------------------------------------------


def test_forest_on_held_out_findings(spark):
    from textloom.llm import secret_scan as ss

    wrong = total = 0
    for k in range(3):
        model = ss.train(ss.labelled(spark, [x for i, x in enumerate(ss.FINDINGS) if i % 3 != k]))
        lines = spark.createDataFrame([(int(x[0]), x[2:]) for i, x in enumerate(ss.FINDINGS) if i % 3 == k], "label int, text string")
        rows = ss.scan(lines, "text", model=model).collect()
        total += len(rows)
        wrong += sum(r.secret != bool(r.label) for r in rows)
    assert total == len(ss.FINDINGS) - 1 and wrong <= 0.2 * total  # one line has no candidate


def test_labelled_rows_are_not_from_the_tables(spark):
    """Telling values of the labelled rows occur in no document, so figures on the documents are held out."""
    from textloom.llm import pii, secret_scan as ss

    values = {v for line in ss.FINDINGS if line[0] == "1" for v in re.findall(r"[0-9A-Za-z]{24,}", line)}
    values |= {v for _, v in re.findall(r"\[(email|ip|card|phone)\|([^\]]+)\]", "\n".join(pii.LABELLED))}
    assert len(values) > 40
    text = "\n".join(r.text or "" for sf in ("sf0.01", "sf0.1") for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("text").toLocalIterator())
    assert not [v for v in values if v in text]


def test_secret_scan_keeps_columns_of_any_name(spark):
    from textloom.llm import secret_scan as ss

    names = ["_features", "_row", "row", "kept", "_probability", "length", "Score", "place"]
    line = 'the token = "e93b57c0418fda62b60d7e1f3395ac84d27f610b" of'
    table = spark.createDataFrame([(1, line, *names)], "doc_id int, text string, " + ", ".join(f"`{n}` string" for n in names))
    row = ss.scan(table, "text").first()
    assert row.secret and row.start == 13 and all(row[n] == n for n in names if n != "Score")
    assert ss.candidates(table, "text").first()["Score"] == "Score"


def test_secrets_of_the_documents(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = entry.queries()["op3_secret_forest"](spark, "/root/testdata/sf0.01").collect()
    planted = {(k, m.start(1)) for k, t in docs.items() for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', t)}
    assert planted and {(r.doc_id, r.start) for r in rows if r.secret} == planted
    assert all(r.end <= len(docs[r.doc_id]) for r in rows)


def test_secrets_of_prefixed_names(spark):
    from textloom.llm import secret_scan as ss

    lines = ['db_password = "Tr0ub4dor&3x"', 'client_secret: "zP4!kLm92qs"', 'dbPassword: "hunter2Xq9!v"', 'my_password = "placeholder"']
    rows = ss.scan(spark.createDataFrame(list(enumerate(lines)), "doc_id int, text string"), "text").collect()
    assert {(r.doc_id, r.value, r.secret) for r in rows} == {
        (0, "Tr0ub4dor&3x", True), (1, "zP4!kLm92qs", True), (2, "hunter2Xq9!v", True), (3, "placeholder", False),
    }


def test_secret_edges(spark):
    from textloom.llm import secret_scan as ss

    hidden = 'é token = "5f367f08b1a810c7777ad785b0be42018bfcbf49" x'
    rows = [(1, None), (2, ""), (3, "no candidate"), (4, hidden), (4, hidden), (5, "word 1 " * 30_000 + hidden), (None, hidden)]
    table = spark.createDataFrame([(k, t, 9, "p") for k, t in rows], "doc_id long, text string, score int, path string")
    got = ss.scan(table, "text", path="path").collect()
    assert len(got) == 4 and all(r.secret and r.value.startswith("5f367f08") for r in got)
    assert all(r.end - r.start == 40 for r in got) and {r.start for r in got} == {11, 210_011}
    assert ss.scan(table.limit(0), "text").count() == 0
