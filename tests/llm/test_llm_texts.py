"""Quality, shards, line templates, SimHash and the pipeline against plain versions and edge cases."""

import re
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from oracle import compare, duck

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, n_words string, _words string, shard string, root string, kept string"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, a very long one, ties, repeated rows and clashing names."""
    long_text = "one two three four five six seven eight nine ten " * 30_000
    rows = [
        (1, "a plain text of some words"), (1, "a plain text of some words"), (2, None), (None, "no key here at all"),
        (None, None), (3, ""), (4, " \n\t "), (5, long_text), (6, "a plain text of some words"), (7, "word"),
    ]
    return spark.createDataFrame([(k, t, "x", "y", "z", "r", "s") for k, t in rows], DOCS)


@pytest.mark.parametrize("name", ["op6_threshold_rules", "op2_line_templates"])
def test_query_equals_sql(spark, con, name):
    out = compare(entry.queries()[name](spark, FOLDER), con, entry.oracle_sql()[name])
    assert out[0] is None, out


def test_every_operator_has_a_query():
    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14))


# -- quality ------------------------------------------------------------------------------


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 3_000 else set(windows)
    covered = {j for i, w in enumerate(windows) if w in twice for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(lines) - len(set(lines)), len(covered)


def test_quality_edges(spark, odd):
    from textloom.llm import quality

    got = quality.judge(odd).collect()
    assert len(got) == 10 and all(r.kept is False for r in got)  # none has 50 words that do not repeat
    for r in got:
        n, chars, dup, repeat = plain_counts(r.text)
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (n, chars, dup, repeat)
    assert quality.judge(odd.limit(0)).count() == 0
    assert quality.keep_good(odd).columns == odd.columns and quality.keep_good(odd).count() == 0


def test_quality_verdicts_agree(spark):
    from textloom.llm import quality

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    judged = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    assert judged == {r.doc_id for r in quality.keep_good(docs).collect()} and judged
    bad = spark.createDataFrame(
        [(1, "The ### of&&& and*** " * 10 + " ".join(f"w{i}%%%" for i in range(60))), (2, " ".join(f"AND{i}A!!" for i in range(80)))],
        "doc_id long, text string",
    )
    assert [r.kept for r in quality.judge(bad).orderBy("doc_id").collect()] == [False, False]


def test_quality_keeps_labelled_good(spark):
    """Held against labels the thresholds never saw at this size: good texts stay, bad ones mostly go."""
    from textloom.llm import quality

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.judge(docs).where("NOT base_failed").join(labels, "doc_id")
    share = {r.quality: r.k for r in rows.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert share[1] == 1.0 and share.get(0, 0) < 0.1


# -- shards -------------------------------------------------------------------------------


def test_shards_grow_into_the_new_one_only(spark):
    from textloom.llm import sharding

    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    rows = ids.select("doc_id", *[sharding.rendezvous(["doc_id"], n).alias(f"s{n}") for n in (24, 25)]).collect()
    assert all(r.s25 in (r.s24, 24) for r in rows)
    moved, sizes = sum(r.s25 == 24 for r in rows), [0] * 24
    for r in rows:
        sizes[r.s24] += 1
    assert 600 < moved < 1_000 and min(sizes) > 650 and max(sizes) < 1_050


def test_shards_follow_weights(spark):
    from textloom.llm import sharding

    got = spark.range(30_000).select(sharding.rendezvous(["id"], 3, [1, 2, 3]).alias("s")).groupBy("s").count().collect()
    share = {r.s: r["count"] / 30_000 for r in got}
    assert all(abs(share[s] - (s + 1) / 6) < 0.02 for s in range(3))
    with pytest.raises(ValueError):
        sharding.rendezvous(["id"], 2, [1, 0])


def test_shards_recomputed(spark):
    """The smallest draw of the record and each shard, with 64-bit hashes of the same rule from a library of its own."""
    import math
    import struct

    import xxhash
    from textloom.llm import sharding

    def draw(key, shard, weight):
        seed = xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
        bits = xxhash.xxh64_intdigest(struct.pack("<i", shard), seed) >> 11
        return -math.log((bits + 0.5) * 2.0**-53) / weight

    weights = [1.0, 2.0, 0.5, 1.0, 3.0]
    for shards, given in ((24, None), (5, weights)):
        used = given or [1.0] * shards
        rows = spark.range(-200, 800).select("id", sharding.rendezvous(["id"], shards, given).alias("s")).collect()
        for r in rows:
            costs = [draw(r.id, s, w) for s, w in enumerate(used)]
            assert math.isclose(costs[r.s], min(costs), rel_tol=1e-12)


def test_shard_query_by_hand(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = entry.queries()["op8_rendezvous_shards"](spark, FOLDER).collect()
    slots = {}
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "key") and 0 <= r.shard < 24
        assert r.grown_shard in (r.shard, 24)
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == len(docs) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shard_edges(spark, odd):
    from textloom.llm import sharding

    rows = sharding.assign_shards(odd, ["doc_id"], 4)
    got = sharding.number_slots(rows, "shard", ["doc_id", "text"]).collect()
    assert len(got) == 10 and len({r.shard for r in got if r.doc_id is None}) == 1
    assert len({(r.shard, r.slot) for r in got}) == 10
    assert sharding.number_slots(rows.limit(0), "shard", ["doc_id"]).count() == 0


# -- line templates -----------------------------------------------------------------------


def test_lines_of_recurring_templates_go(spark):
    from textloom.llm import line_templates as lt

    rows = [
        (1, "Page 3 of 10 in the book\nOwn line of the first text here"),
        (2, "Page 77 of 120 in the book\nAnother line that is its own\nPage 4 of 9 in the book"),
        (3, "user alice logged in from the main office today\nshort a\n17 3"),
        (4, "user alice logged in from the other office today\nshort a\n18 4"),
        (5, "Own line of a fifth text\n\n  Own   line of the first text here "),
        (6, None), (7, ""), (8, "Own line of a fifth text\n\n  Own   line of the first text here "),
    ]
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, at string")
    got = {r.doc_id: r for r in lt.drop_recurring(docs, "doc_id", "text", ("n", "gone")).collect()}
    assert got[1].text == rows[0][1] and got[2].text == "Another line that is its own"
    assert got[3].text == rows[2][1] and got[4].text == "18 4"  # eight of nine words agree
    # two copies of one text are one text: they keep the same lines
    assert got[5].text == got[8].text == "Own line of a fifth text\n"
    assert got[6].text is None and got[7].text == "" and got[2].gone == 2 and got[6].n == 0
    assert lt.drop_recurring(docs.limit(0), "doc_id", "text").count() == 0


def test_several_templates_of_a_leaf(spark):
    """Templates of one leaf (eleven words, the same three in front) do not hide each other, whatever their sizes."""
    from textloom.llm import line_templates as lt

    kinds = [
        ("This page was last edited on the old server by {}", 5), ("This page was printed from our archive in Rome by {}", 3),
        ("This page was printed for our readers in Oslo by {}", 2), ("This page was {} moved without a note to the attic", 4),
    ]
    names = ["anna", "boris", "carla", "dmitri", "elena", "fahad", "gita", "hugo", "ines", "jan", "kemal", "lea", "mila", "nils"]
    lines = [(kind, pattern) for kind, (pattern, n) in enumerate(kinds) for _ in range(n)]
    rows = [(i, f"{pattern.format(names[i])}\nnumber {names[i]} has a line of its own") for i, (_, pattern) in enumerate(lines)]
    rows.append((50, "This page was once the only one with such words"))
    out = lt.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    left = {r.doc_id: r.text.split("\n") for r in out}
    firsts = {min(i for i, (k, _) in enumerate(lines) if k == kind) for kind in range(len(kinds))}
    assert {i for i, t in left.items() if t[0].startswith("This page")} == firsts | {50}


def test_line_edges(spark, odd):
    from textloom.llm import line_templates as lt

    got = lt.drop_recurring(odd, "doc_id", "text").collect()
    assert len(got) == 10 and got[0].__fields__ == odd.columns
    assert sorted(str(r.text) for r in got) == sorted(str(r.text) for r in odd.collect())  # only whole copies recur


def test_clean_lines_stay(spark):
    """Lines that occur in one text only are in the result, whatever else is dropped."""
    from textloom.llm import line_templates as lt

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    before = {r.doc_id: r.text for r in docs.collect()}
    after = {r.doc_id: r.text for r in lt.drop_recurring(docs, "doc_id", "text").collect()}
    seen = {}
    for text in {t for t in before.values() if t}:
        for line in set(text.split("\n")):
            seen[line] = seen.get(line, 0) + 1
    for k, t in before.items():
        lines, left = (t or "").split("\n"), (after[k] or "").split("\n")
        gone = [x for x in lines if x not in left]
        assert all(x.split() for x in gone)
        places = iter(lines)
        assert left == [""] or all(x in places for x in left)  # in the old order
    exact = sum(n > 1 and x.split() != [] for x, n in seen.items())
    assert exact and sum(len(t or "") for t in after.values()) < sum(len(t or "") for t in before.values())


# -- SimHash ------------------------------------------------------------------------------


def plain_groups(prints):
    label = list(range(len(prints)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if ((prints[i] ^ prints[j]) & (2**64 - 1)).bit_count() <= 2:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(prints))]


def test_fingerprint_by_hand():
    from xxhash import xxh64_intdigest

    from textloom.llm.simhash import fingerprint

    def plain(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        votes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in votes) > len(votes))

    for text in ("", " \n", "One", "One two", "ONE\ttwo Three", "É a É a É a b c", "a b c d e f g " * 9, "x y z w"):
        assert fingerprint(text) & (2**64 - 1) == plain(text)
    assert fingerprint(None) == 0


def test_links_are_exact(spark):
    import random

    from textloom.llm import simhash

    rnd = random.Random(5)
    prints = [rnd.getrandbits(64) for _ in range(60)]
    for p in list(prints):  # chains of one, two and three flipped bits
        for flips in (1, 2, 2, 3):
            for b in rnd.sample(range(64), flips):
                p ^= 1 << b
            prints.append(p)
    prints += [0, 1 << 63, 2**64 - 1, 3 << 62, prints[0]]
    signed = [p - (p >> 63 << 64) for p in prints]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(signed)], "doc_id long, fingerprint long")
    got = {r.doc_id: r.component_id for r in simhash.groups(rows, "doc_id").collect()}
    assert [got[i] for i in range(len(prints))] == plain_groups(prints)


def test_simhash_edges(spark, odd):
    from textloom.llm import simhash

    got = simhash.near_duplicates(odd, "doc_id", "text").collect()
    assert len(got) == 10
    by_id = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert by_id[6] == 1 and by_id[2] == by_id[3] == by_id[4] == 2 and by_id[5] == 5 and by_id[7] == 7
    assert sorted((r.component_id is None, r.component_id) for r in got if r.doc_id is None)[0] == (False, 2)
    assert simhash.near_duplicates(odd.limit(0), "doc_id", "text").count() == 0
    kept = simhash.keep_one(odd, "doc_id", "text")
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "5", "7", "None"]


def plain_similar(texts, words=5, least=0.8):
    """For every text the place of the first one linked to it, all pairs compared."""
    sets = []
    for text in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        found = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set())
    label = list(range(len(sets)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or (min(len(a), len(b)) >= least * max(len(a), len(b)) and len(a & b) / len(a | b) >= least):
                low, high = sorted((root(i), root(j)))
                label[high] = low
    return [root(i) for i in range(len(sets))]


def test_similar_texts_equal_brute_force(spark):
    import random

    from textloom.llm import simhash

    rnd = random.Random(3)
    vocabulary = [f"word{i}" for i in range(3_000)]
    passage = rnd.choices(vocabulary, k=60)
    texts = []
    for _ in range(40):
        words = rnd.choices(vocabulary, k=rnd.randint(3, 200)) + passage  # a passage that all share
        texts.append(" ".join(words))
        for changes in (0, 1, 2, 4, 8, 30):
            copy = list(words)
            for at in rnd.sample(range(len(copy)), min(changes, len(copy))):
                copy[at] = rnd.choice(vocabulary)
            texts.append("  ".join(copy).upper() if changes == 0 else " ".join(copy))
    hub = rnd.choices(vocabulary, k=300)  # a large group of near copies
    for _ in range(150):
        copy = list(hub)
        copy[rnd.randrange(300)] = rnd.choice(vocabulary)
        texts.append(" ".join(copy))
    texts += ["", None, " \n", "a b c", "A b  c", "a b d", "one"]
    rnd.shuffle(texts)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    kept = {r.doc_id: r.text for r in simhash.keep_similar(rows, "doc_id", "text").collect()}
    assert set(kept) == set(plain_similar(texts)) and all(texts[k] == t for k, t in kept.items())


def test_all_pairs_of_a_draw_are_decided(spark):
    """Sixty texts with a passage in common and two variants of each: the draws of the passage gather texts that do not link."""
    import random

    from textloom.llm import simhash

    rnd = random.Random(8)
    vocabulary = [f"word{i}" for i in range(5_000)]
    passage, texts = rnd.choices(vocabulary, k=60), []
    for _ in range(60):
        base = rnd.choices(vocabulary, k=60)
        for _ in range(3):
            copy = list(base)
            copy[rnd.randrange(60)] = rnd.choice(vocabulary)
            texts.append(" ".join(passage + copy))
    rnd.shuffle(texts)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    spots = {r.doc_id: {*enumerate(r.drawn), r.fingerprint} for r in simhash.draws(rows, "text").collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if spots[i] & spots[j] and len(a & sets[j]) / len(a | sets[j]) >= 0.8:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    kept = simhash.keep_similar(rows, "doc_id", "text")
    assert {r.doc_id for r in kept.collect()} == set(label)


@pytest.mark.parametrize("cell", [3, 2048])
def test_parted_pairs_are_whole(spark, cell, monkeypatch):
    """Twenty texts share a draw; every pair of different groups and near sizes is formed, whatever the cells."""
    from textloom.llm import simhash

    monkeypatch.setattr(simhash, "CELL", cell)
    sizes, parts = {i: 80 + 3 * i for i in range(20)}, {0: 0, 3: 0, 5: 0, 7: 7, 8: 7}
    classes = spark.createDataFrame(
        [(i, n, i << 20, [9, i]) for i, n in sizes.items()], "id long, size long, fingerprint long, drawn array<long>"
    )
    linked = spark.createDataFrame(list(parts.items()), "id long, component long")
    near = classes.limit(0).selectExpr("id AS src", "id AS dst")
    got = sorted(map(tuple, simhash.parted_pairs(classes, near, linked).collect()))
    assert got == [
        (i, j) for i in sizes for j in sizes if i < j and parts.get(i, i) != parts.get(j, j) and sizes[i] >= 0.8 * sizes[j]
    ]


@pytest.mark.parametrize("cell", [50, 2048])
def test_pairs_of_a_large_draw_are_no_rows(spark, cell, monkeypatch):
    """Three hundred variants of one text that do not link, and twins of some: decided in cells, without a table of their pairs."""
    import random

    from textloom.llm import simhash

    rnd = random.Random(3)
    words = [f"word{i}" for i in range(3_000)]
    base, texts = rnd.sample(words, 60), []
    for i in range(300):
        copy = list(base)
        copy[rnd.randrange(5, 25)], copy[rnd.randrange(35, 55)] = f"new{i}", f"other{i}"
        texts += [" ".join(copy), " ".join([*copy[:-1], f"last{i}"])] if i % 10 == 0 else [" ".join(copy)]
    rnd.shuffle(texts)
    sizes, settle = [], simhash.settle

    def counted(df):
        table = settle(df)
        sizes.append(table.count())
        return table

    monkeypatch.setattr(simhash, "settle", counted)
    monkeypatch.setattr(simhash, "CELL", cell)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in simhash.keep_similar(rows, "doc_id", "text").collect()}
    assert kept == set(plain_similar(texts)) and len(kept) == 300
    parts = -(-330 // cell)
    assert max(sizes) <= 330 * max(43, 13 * parts)  # grid points, or the copies dealt over cells; pairs would be 43,132


def test_similar_texts_edges(spark, odd):
    from textloom.llm import simhash

    clashing = odd.withColumnsRenamed({"n_words": "same", "_words": "drawn", "shard": "id", "root": "k", "kept": "_mark"})
    kept = simhash.keep_similar(clashing, "doc_id", "text")
    assert kept.columns == clashing.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "5", "7", "None"]
    assert simhash.keep_similar(clashing.limit(0), "doc_id", "text").count() == 0


# -- the pipeline -------------------------------------------------------------------------


def test_pipeline_stages_take_odd_rows(spark, odd):
    import corpus_pipeline

    good = "Some words about the {} and its long way to the sea, told by people who have seen it with their own eyes. " \
        "They say that of all that they met there the {} was what they liked most, and that the road back was harder, " \
        "but nobody was lost on it, for which the {} is to be thanked."
    fine = spark.createDataFrame(
        [(i, good.format(*[w] * 3), "x", "y", "z", "r", "s") for i, w in ((20, "river"), (20, "river"), (21, "river"), (22, "moon"))]
        + [(None, good.format(*["hill"] * 3), "x", "y", "z", "r", "s")], DOCS,
    )
    for docs in (odd.unionByName(fine), odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, FOLDER).toPandas().columns.tolist() == docs.columns, name
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
        assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}


def test_pipeline_keeps_its_word(spark):
    import corpus_pipeline
    from textloom.llm import pii, quality

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, tables = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{spark.conf.get('spark.checkpoint.dir')}/stage-{len(tables)}-{id(docs)}"
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = tables[name] = spark.read.parquet(path)
        assert docs.columns == columns
    good = {r.doc_id: r.text for r in tables["quality rules"].collect()}
    assert set(good) == {r.doc_id for r in quality.judge(spark.read.parquet(f"{FOLDER}/documents.parquet")).where("kept").collect()}
    lines = {r.doc_id: r.text for r in tables["line dedup"].collect()}
    assert set(lines) == set(good)
    unique = {r.doc_id: r.text for r in tables["simhash near-dedup"].collect()}
    keys = sorted(lines)
    roots = plain_similar([lines[k] for k in keys])
    assert set(unique) == {keys[r] for r in roots} and all(unique[k] == lines[k] for k in unique)
    clean = {r.doc_id: (r.text, r.n_chars) for r in tables["personal data"].collect()}
    assert set(clean) == set(unique) and all(len(t) == n for t, n in clean.values())
    assert not any(pii.base_spans(t) for t, _ in clean.values())
    packed = corpus_pipeline.run(spark, FOLDER)
    sums = {r.doc_id: r.n for r in packed.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    totals = {r.doc_id: r.doc_tokens for r in packed.select("doc_id", "doc_tokens").distinct().collect()}
    assert sums == totals and set(sums) == set(clean)
