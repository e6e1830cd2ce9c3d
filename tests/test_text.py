"""Cleaning, links, dates, notes, books, chunks and markup on small cases."""

import datetime

import pytest
from pyspark.sql import functions as F

from textloom.functions import dates, links, text as tx, vectors
from textloom.operators import books, chunks, corpus, notes, runs
from textloom.sources import markup


def one(spark, expr, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1)])
    return row.select(expr.alias("out")).first()["out"]


@pytest.mark.parametrize("text,want", [
    ("see [[Mana]] now", [("Mana", None)]),
    ("[[#Trade|x]]", [(None, "Trade")]),
    ("[[Mana#Trade|x]]", [("Mana", "Trade")]),
    ("[[File:a.png]] [[Category:b]] [[Image:c]]", []),
    ("[[A]] [[B|b]] [[C#d#e]]", [("A", None), ("B", None), ("C", "d#e")]),
    ("", []), (None, []),
])
def test_wikitext_links(spark, text, want):
    got = one(spark, links.wikitext_links(F.col("t").cast("string")), t=text)
    assert [(r["page"], r["section"]) for r in got] == want


def test_wikitext_headings(spark):
    text = "intro\n== One ==\nx = y\n=== Two words ===\n== bad ===\n==Three==  \n"
    got = one(spark, links.wikitext_headings(F.col("t")), t=text)
    assert [(r["level"], r["title"]) for r in got] == [(2, "One"), (3, "Two words"), (2, "Three")]
    assert one(spark, links.wikitext_headings(F.col("t").cast("string")), t=None) == []


def test_note_link(spark):
    assert one(spark, links.note_links(F.col("t")), t="a [[id:ab-12][x]] [[id:zz]] [[http://q][r]]") == ["ab-12"]


@pytest.mark.parametrize("path,want", [
    ("roam/20230303100438-small_data.org", ("roam", "20230303100438", "small_data.org")),
    ("notes.org", (None, None, None)),
])
def test_note_path(spark, path, want):
    got = one(spark, links.note_path(F.col("p")), p=path)
    assert (got["root_path"], got["date"], got["name"]) == want


def test_urls_and_repo(spark):
    text = "go to https://a.example.com/x?y=1, (www.b.org/z) or c.dev/q. Not a.b or x@y.com or me.too@b.org"
    assert one(spark, links.urls(F.col("t")), t=text) == ["https://a.example.com/x?y=1", "www.b.org/z", "c.dev/q"]
    text = "example.com and http://a.org/w_(b), <http://x.y/(a(b)c)>; foo.barr/x, http://q.de/" + "a" * 30_000
    assert one(spark, links.urls(F.col("t")), t=text) == ["example.com", "http://a.org/w_(b)", "http://x.y/(a(b)c)", "http://q.de/" + "a" * 30_000]
    assert one(spark, links.urls(F.col("t"), ["barr"]), t="foo.barr/x example.com") == ["foo.barr/x"]
    got = [one(spark, links.repo_url(F.col("t")), t=t) for t in ("github.com/a/b/", "https://github.com/a", "http://x.y/z")]
    assert got == ["https://github.com/a/b", "https://github.com/a", None]


@pytest.mark.parametrize("day", ["1969-12-28", "1969-12-31", "1970-01-04", "1970-01-05", "2000-02-29", "2024-12-30", "2025-01-05"])
def test_period_ordinals_equal_pandas(spark, day):
    import pandas as pd

    at = F.col("d").cast("timestamp_ntz")
    for name, code in (("day", "D"), ("week", "W"), ("month", "M")):
        assert one(spark, dates.period_ordinal(at, name), d=day) == pd.Timestamp(day).to_period(code).ordinal


def test_right_closed_bins_equal_pandas_cut(spark):
    import pandas as pd

    values = [0, 1, 5, 10, 15, 20, 99, 100]
    want = pd.cut(pd.Series(values), 20, labels=False).tolist()
    df = spark.createDataFrame([(v,) for v in values], "v long")
    got = [r["b"] for r in df.select("v", dates.equal_width_bin(F.col("v"), F.lit(0), F.lit(100), 20).alias("b")).orderBy("v").collect()]
    assert got == want


def test_srt_time_truncates(spark):
    assert one(spark, dates.srt_range(F.lit(3661.2509), F.lit(59.9999))) == "01:01:01,250 --> 00:00:59,999"


def test_clip_squashes_after_the_cut(spark):
    assert one(spark, tx.clip_and_squash(F.col("t"), 6), t="ab\u00a0\n cdef") == "ab c"


def test_text_merge_prints_missing(spark):
    df = spark.createDataFrame([("x", None)], "a string, b string")
    assert df.select(tx.merge_columns(["a", "b"]).alias("m")).first()["m"] == "a:\nx\n\nb:\nnan"


def test_unsnake(spark):
    assert one(spark, tx.unsnake(F.col("t")), t="a_b 12 c2024") == "a b NUMBER c NUMBER "


def test_inherit(spark):
    df = spark.sql("SELECT map('lr', '1', '_base', 'b') AS c, map('lr', '2', 'p', '3', '_base', 'q') AS b")
    assert df.select(tx.inherit(F.col("c"), F.col("b")).alias("m")).first()["m"] == {"lr": "1", "p": "3"}
    assert df.select(tx.inherit(F.col("c"), F.lit(None).cast("map<string,string>")).alias("m")).first()["m"] == {"lr": "1"}


def test_topk_entropy_equals_scipy_definition(spark):
    import math

    got = one(spark, tx.topk_entropy(F.array(F.lit(0.1), F.lit(0.5), F.lit(0.2), F.lit(0.0)), 3))
    p = [0.5 / 0.8, 0.2 / 0.8, 0.1 / 0.8]
    assert abs(got + sum(x * math.log(x) for x in p)) < 1e-12


def test_half_plane_map(spark):
    z = 0.3 + 0.4j
    w = -1j * (z - 1j) / (z + 1j)
    got = one(spark, vectors.disk_to_half_plane(F.lit(0.3), F.lit(0.4)))
    assert abs(got["re"] - w.real) < 1e-12 and abs(got["im"] - w.imag) < 1e-12


def test_standardise(spark):
    df = spark.createDataFrame([("a", "t", "2024-01-02"), (None, "t", "2024-01-02"), ("b", None, None), ("c", "u", "soon")], "x string, y string, z string")
    got = corpus.standardise(df, "x", "y", "z", on_bad_date="null").orderBy("text").collect()
    assert [(r["text"], r["title"], r["date"]) for r in got] == [("a", "t", datetime.datetime(2024, 1, 2)), ("c", "u", None)]
    with pytest.raises(Exception, match="unreadable date"):
        corpus.standardise(df, "x", "y", "z").collect()
    with pytest.raises(ValueError, match="nope"):
        corpus.standardise(df, "nope", "y")


def test_filter_texts_cuts_before_and_after(spark):
    df = spark.createDataFrame([(1, "ok"), (2, "éé"), (3, ""), (4, "fine"), (5, "late")], "i int, t string")
    got = corpus.filter_texts(df, "t", None, ["i"], n_docs=2).collect()
    assert sorted(r["i"] for r in got) == [1, 4]
    assert corpus.filter_texts(df.orderBy(F.desc("i")), "t", None, ["i"], n_docs=1).first()["i"] == 1


def test_build_collection_keeps_the_first_title(spark):
    df = spark.createDataFrame([(3, "c  c", "B", ["x", "y"]), (1, "a\n a", "A", ["x"]), (2, "b", "A", []), (4, None, "Z", [])],
                               "i int, t string, title string, tasks array<string>")
    got = corpus.build_collection(df, "t", ["i"], "title", extra=["tasks"]).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "a a", "A", "[x]"), (2, "c c", "B", "[x, y]")]


def test_schema_rules(spark):
    rules = [corpus.Rule("n", "bigint", at_least=0), corpus.Rule("s", "string")]
    df = spark.createDataFrame([("1", "a"), ("-2", None), ("x", "b"), (None, "c")], "n string, s string")
    got = {(r["column"], r["rule"]): r["n_bad"] for r in corpus.check_schema(df, rules).collect()}
    assert got == {("n", "type"): 1, ("n", "not_null"): 1, ("n", "at_least_0"): 1, ("s", "type"): 0, ("s", "not_null"): 1}
    assert corpus.rejects(df, rules).count() == 3
    assert [r["n"] for r in corpus.coerce(df, rules).collect()] == [1, -2, None, None]


NOTE = """:PROPERTIES:
:ID:       abc-1
:END:
#+title: Games
intro
* TODO [#A] First :tag:other:
:PROPERTIES:
:X: y
:END:
see [[id:q-2][q]]
** Deep
SCHEDULED: <2024-01-01>
text
* Last
"""


def test_note_elements(spark):
    files = spark.createDataFrame([("/r/20240207133304-games.org", NOTE), ("/r/none.org", "* x\n")], "path string, text string")
    got = notes.note_elements(files, changed=None).orderBy("no").collect()
    assert [(r["level"], r["heading"], r["body"]) for r in got] == [
        (0, "", "#+title: Games\nintro"), (1, "First", "see [[id:q-2][q]]"), (2, "Deep", "text"), (1, "Last", "")]
    assert {r["org_id"] for r in got} == {"abc-1"}
    assert got[0]["links"] == ["q-2"] and got[1]["links"] == ["q-2"] and got[2]["links"] == []
    assert got[3]["creation_date"] == datetime.datetime(2024, 2, 7, 13, 33, 4)
    whole = notes.note_elements(files, changed=None, whole_file=True).collect()
    assert len(whole) == 1 and "** Deep" in whole[0]["text"]
    assert [r["path"] for r in notes.unreadable_notes(files).collect()] == ["/r/none.org"]


def test_chunks_against_a_plain_reference(spark):
    texts = ["", "one two three four five six seven", "para one is here\n\npara two\nline two of it\n\n" + "x" * 40, "  lead and tail  ", "ab " * 30]
    for size, overlap in ((10, 0), (16, 5), (25, 10)):
        df = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "name string, text string")
        rows = chunks.chunk_rows(df, "name", "text", size, overlap).collect()
        for r in rows:
            source = texts[int(r["name"][1:])]
            assert source[r["start"] : r["end"]] == r["chunk"] and len(r["chunk"]) <= size and r["chunk"] == r["chunk"].strip()
        for i, t in enumerate(texts):
            seen = set()
            for r in rows:
                if r["name"] == f"d{i}":
                    seen |= set(range(r["start"], r["end"]))
            assert all(j in seen for j, c in enumerate(t) if not c.isspace())
    assert [c["chunk"] for c in chunks._chunks("aa bb cc dd ee", 5, 0)] == ["aa bb", "cc", "dd", "ee"]


def test_chunk_overlap_repeats_the_tail():
    found = [c["chunk"] for c in chunks._chunks("aaa bbb ccc ddd eee", 12, 5)]
    assert found == ["aaa bbb ccc", "ccc ddd eee"]


TOC = [("b", 1, "TITLE"), ("b", 2, "x\nCONTENTS\nI. First things 3\nII. SECOND 7\nwords\n"), ("b", 3, "III. Third\n"), ("b", 4, "body I. NOT AN ENTRY 9")]


def page_rows(spark, rows):
    return spark.createDataFrame(rows, "book string, page_num int, text string")


def test_contents_page(spark):
    got = books.contents(page_rows(spark, TOC), first_page=5).orderBy("entry").collect()
    assert [(r["page_ref"], r["roman"], r["title"]) for r in got] == [(5, "I", "First things"), (9, "II", "SECOND"), (12, "III", "Third")]


def test_contents_of_a_long_book(spark):
    """Real references past 1,000 are no different from others."""
    toc = "CONTENTS\nI. One 3\nII. Two 998\nIII. Three 1001\nIV. Four 1150\nV. Five\n"
    rows = [("b", 1, toc)] + [("b", i, f"p{i}") for i in range(2, 1201)]
    got = books.contents(page_rows(spark, rows)).orderBy("entry").collect()
    assert [r["page_ref"] for r in got] == [3, 998, 1001, 1150, 1205]


def test_contents_in_running_text_and_even_spacing(spark):
    rows = [("c", 1, "CHAPTER\nI. SOME NAME\n"), ("c", 5, "CHAPTER\nII. OTHER NAME\n"), ("c", 12, "end")]
    got = books.contents(page_rows(spark, rows)).orderBy("entry").collect()
    assert [(r["page_ref"], r["roman"], r["title"]) for r in got] == [(1, "I", "SOME NAME"), (5, "II", "OTHER NAME")]


def test_chapters_and_pages(spark):
    pages = page_rows(spark, [("b", i, f" p{i} " if i != 4 else " ") for i in range(1, 9)] + [("z", 1, "q"), ("z", 2, "r")])
    toc = spark.createDataFrame([("b", 1, 2, "I", "A"), ("b", 2, 4, "II", "B"), ("b", 3, 5, "III", "C")], "book string, entry long, page_ref int, roman string, title string")
    last = pages.groupBy("book").agg(F.max("page_num").alias("last_page"))
    spans = books.chapter_spans(toc, last)
    assert [(r["entry"], r["page_ref"], r["end_page"]) for r in spans.orderBy("entry").collect()] == [(1, 2, 3), (2, 4, 4), (3, 5, 8)]
    got = {(r["book"], r["chapter"]): r["text"] for r in books.chapter_texts(pages, spans).collect()}
    assert got == {("b", "I. A"): "p2 p3", ("b", "III. C"): "p5 p6 p7 p8", ("z", "Remaining Content"): "q r"}


def test_sections(spark):
    text = "12\nPreface\n\nPART I. One\n\nCHAPTER II: Two\nfirst line\nsecond\n\nXIV\nThe Freedom 12\nthird\n"
    got = one(spark, books.sections(F.col("t"), ["freedom"]), t=text)
    assert [(s["title"], s["paragraphs"]) for s in got] == [("Front Matter", ["Preface"]), ("CHAPTER II: Two", ["first line second", "third"])]
    assert [s["title"] for s in one(spark, books.sections(F.col("t")), t="only text")] == ["Front Matter"]


PAGE = """<html><head><title>A &amp; B</title><script>var x = "<a href='no'>";</script></head><body>
<blockquote class="abstract mathjax"><span>Abstract:</span> We show <b>that</b>.</blockquote>
<p>See <a href="/one">first <i>link</i></a><br> and <a href="two">second</a></p>
<ul class="ltx_biblist"><li class="ltx_bibitem"><span>X (2019)</span><span> A. Author </span><span>Title </span><span>ArXiv, arXiv:1901.00001</span></li>
<li><span>Y</span><span>B</span><span>Old</span></li><li><span>broken</span></li></ul></body></html>"""


def test_page_parts_and_bibliography(spark):
    parsed = markup.parse_pages(spark.createDataFrame([(1, PAGE), (2, ""), (3, None)], "id int, html string"))
    row = parsed.where("id = 1").first()
    assert row["title"] == "A & B" and row["block"] == "We show that."
    assert [(a["href"], a["label"]) for a in row["anchors"]] == [("/one", "first link"), ("two", "second")]
    assert "var x" not in row["body"]
    got = [tuple(r) for r in markup.bibliography(parsed, ["id"]).orderBy("item").collect()]
    assert got == [(1, 0, "X (2019)", "A. Author", "Title", "ArXiv, arXiv:1901.00001", "ArXiv", 2019), (1, 1, "Y", "B", "Old", None, None, None)]
    assert [r["label"] for r in markup.anchors(parsed, ["id"]).collect()] == ["first link", "second"]


def test_item_errors_do_not_stop_the_job(spark):
    df = spark.createDataFrame([("1",), ("x",)], "s string")
    got = {r["s"]: (r["n"], r["error"]) for r in markup.encode_each(df, "s", int, "n", "int").collect()}
    assert got["1"] == (1, None) and got["x"][0] is None and got["x"][1].startswith("ValueError")


def matrix(spark, problems, algorithms, incompatible=(), seeds=2):
    groups = spark.createDataFrame([("g", problems, algorithms)], "name string, problems array<struct<env_id:string,total_timesteps:int>>, algorithms array<string>")
    table = spark.createDataFrame([("ppo", {"lr": "1"}), ("dqn", {}), ("ppo_big", {"_base": "ppo", "n": "5"})], "name string, config map<string,string>")
    classes = spark.createDataFrame([("ppo", "PPO"), ("dqn", "DQN")], "name string, algo_class string")
    bad = spark.createDataFrame(list(incompatible), "env_id string, algo_name string")
    return runs.expand_matrix(groups, runs.resolve_algorithms(table, classes), bad, seeds, 1000, "logs").collect()


def test_run_matrix(spark):
    assert len(matrix(spark, [("e1", None)], ["ppo"])) == 2
    assert len(matrix(spark, [("e1", None), ("e2", None)], ["ppo", "dqn"], seeds=1)) == 4
    assert matrix(spark, [("e1", None)], ["dqn"], [("e1", "dqn")]) == []
    rows = matrix(spark, [("e1", 50), ("e2", None)], ["ppo_big"], seeds=1)
    assert {(r["env_id"], r["total_timesteps"]) for r in rows} == {("e1", 50), ("e2", 1000)}
    assert rows[0]["algo_class"] == "PPO" and rows[0]["algo_kwargs"] == {"lr": "1", "n": "5"}
    assert {r["log_dir"] for r in rows} == {"logs/g/ppo_big_e1_seed0", "logs/g/ppo_big_e2_seed0"}


def test_unknown_algorithms_stop(spark):
    classes = spark.createDataFrame([("ppo", "PPO")], "name string, algo_class string")
    for config in ({"_base": "gone"}, {}):
        table = spark.createDataFrame([("odd", config)], "name string, config map<string,string>")
        with pytest.raises(Exception, match="unknown"):
            runs.resolve_algorithms(table, classes).collect()


def test_pending_runs(spark):
    wanted = spark.createDataFrame([("e", "ppo", 0), ("e", "ppo", 1)], "env_id string, algo_name string, seed int")
    logged = spark.createDataFrame([("e", "ppo", 0)], wanted.schema)
    assert [r["seed"] for r in runs.pending(wanted, logged).collect()] == [1]


def test_chunks_across_slices(spark):
    """Chunks are built as Arrow columns, some texts at a time; empty and null texts have an empty list."""
    from textloom.operators import chunks

    texts = ["", None, "  one  two\n\nthree", "x" * 70, "é word " * 30]
    rows = [(i, texts[i % len(texts)]) for i in range(2 * chunks.AT_ONCE + 3)]
    df = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    listed = chunks.chunk_lists(df, "text", 20, 5)
    got = {r["id"]: r for r in listed.withColumn("stand", chunks.chunks_stand(F.col("text"), F.col("chunks"))).collect()}
    assert len(got) == len(rows) and all(r["stand"] for r in got.values())
    for i, text in rows:
        assert [c.asDict() for c in got[i]["chunks"]] == chunks._chunks(text, 20, 5)
    moved = F.transform("chunks", lambda c: c.withField("start", c["start"] + 1))
    assert not listed.where("id = 2").select(chunks.chunks_stand(F.col("text"), moved)).first()[0]
    assert listed.limit(0).count() == 0
