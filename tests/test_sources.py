"""Readers, writers and the streaming use of row-wise operators."""

import json

import pytest
from pyspark.sql import functions as F

from textloom.sources import readers, writers
from textloom.streaming import rowwise


def test_dispatch_on_extension(spark, tmp_path):
    (tmp_path / "a.csv").write_text('text,title\n"two\nlines, ""q""",t\n,u\n')
    (tmp_path / "a.jsonl").write_text('{"text": "x", "title": "t"}\n{"title": "u"}\n')
    assert [r["text"] for r in readers.load_documents(spark, str(tmp_path / "a.csv")).collect()] == ['two\nlines, "q"', None]
    assert readers.load_documents(spark, str(tmp_path / "a.jsonl")).count() == 2
    with pytest.raises(ValueError):
        readers.load_documents(spark, "a.xlsx")
    with pytest.raises(ValueError):
        readers.load_corpus(spark, "a.jsonl")


def test_json_corpus_is_one_array(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"t": "a"}, {"t": "b"}], indent=1))
    assert {r["t"] for r in readers.load_corpus(spark, str(tmp_path / "c.json")).collect()} == {"a", "b"}


def test_column_guesses():
    assert readers.guess_columns(["id", "body", "content", "name", "time"]) == {"text": "body", "title": "name", "date": "time"}
    assert readers.guess_columns(["a", "b"]) == {"text": "a", "title": "a", "date": "a"}
    assert readers.guess_columns([]) == {"text": None, "title": None, "date": None}


def test_csv_folder_with_two_headers(spark, tmp_path):
    (tmp_path / "Watch later.csv").write_text("Video ID,When\nv1,x\n")
    (tmp_path / "music.csv").write_text("Video ID\nv2\nv3\n")
    (tmp_path / "more.csv").write_text("When,Video ID\ny,v4\n")
    rows = readers.load_csv_folder(spark, str(tmp_path), "Playlist")
    got = {(r["Video ID"], r["When"], r["Playlist"]) for r in rows.collect()}
    assert got == {("v1", "x", "Watch later"), ("v2", None, "music"), ("v3", None, "music"), ("v4", "y", "more")}
    assert readers.load_csv_folder(spark, str(tmp_path), "Playlist", glob="none*.csv").count() == 0


def test_snapshots_take_the_user_from_the_file_name(spark, tmp_path):
    (tmp_path / "ann_github_stars_20240101.csv").write_text("name,stars\nx,1\n")
    (tmp_path / "bob_b_github_stars_20240102.csv").write_text("name,stars\ny,2\n")
    (tmp_path / "other.csv").write_text("name,stars\nz,3\n")
    got = readers.load_snapshots(spark, str(tmp_path), "name string, stars int")
    assert {tuple(r) for r in got.collect()} == {("x", 1, "ann"), ("y", 2, "bob_b")}


DUMP = """<mediawiki><page><title>A</title><ns>0</ns><id>1</id>
<revision><id>5</id><timestamp>2020-02-02T00:00:00Z</timestamp><contributor><username>u</username></contributor><text>new  text</text></revision>
<revision><id>4</id><timestamp>2019-01-01T00:00:00Z</timestamp><contributor><ip>1.2.3.4</ip></contributor><comment>c</comment><text>older but last</text></revision>
</page><page><title>B</title><ns>0</ns><id>2</id><redirect title="A"/><revision><id>9</id><timestamp>2021-01-01T00:00:00Z</timestamp><text/></revision></page></mediawiki>"""


def test_wiki_dump_takes_the_last_revision_in_file_order(spark, tmp_path):
    (tmp_path / "d.xml").write_text(DUMP)
    a, b = readers.load_wiki_dump(spark, str(tmp_path / "d.xml")).orderBy("page_id").collect()
    assert (a["rev_id"], a["contributor"], a["text"], a["text_length"], a["redirect"]) == (4, "1.2.3.4", "older but last", 14, None)
    assert (b["redirect"], b["contributor"], b["text_length"]) == ("A", None, 0)


def test_content_tree_needs_both_files(spark, tmp_path):
    for folder, files in {"p1": {"name": "One", "content.md": "[[Two]]\nx"}, "p2": {"name": "Two"}, "p3": {"content.md": "y"}}.items():
        (tmp_path / folder).mkdir()
        for f, text in files.items():
            (tmp_path / folder / f).write_text(text)
    rows = readers.load_content_tree(spark, str(tmp_path)).collect()
    assert [(r["title"], r["contents"]) for r in rows] == [("One", "[[Two]]\nx")]


def test_content_tree_is_written_by_all_cores_and_read_once(spark):
    from pathlib import Path

    from textloom import scale
    from textloom.plans import source_plans
    from textloom.plans.registry import Tables

    tables = Tables(spark, "/root/testdata/sf0.001")
    tables.supplier = spark.range(40).selectExpr("id AS s_suppkey", "concat('n', id) AS s_name", "int(id % 25) AS s_nationkey")
    before = set(scale._WRITTEN)
    found = source_plans.load_content_tree(tables)
    assert "FileScan text" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 40
    parts = {f.name[:10] for p in set(scale._WRITTEN) - before for f in Path(p).rglob("page=*/*/part-*")}
    assert len(parts) > 1


def test_ocr_pages(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"page_num": 2, "page_response": {"natural_text": null}}\n{"page_num": 1, "page_response": {"natural_text": "a"}}\n{"x": 1}\n')
    got = readers.load_ocr_pages(spark, str(tmp_path / "p.jsonl")).orderBy("page_num").collect()
    assert [(r["page_num"], r["text"]) for r in got] == [(1, "a"), (2, "")]


def test_csv_round_trip_keeps_blanks_and_quotes(spark, tmp_path):
    df = spark.createDataFrame([(1, ' a "b" \\ c,\nd '), (2, ""), (3, None)], "i int, t string")
    writers.write_csv(df, str(tmp_path / "x.csv"))
    back = {r["i"]: r["t"] for r in readers.load_documents(spark, str(tmp_path / "x.csv"), "i int, t string").collect()}
    assert back[1] == ' a "b" \\ c,\nd ' and back[3] is None


def test_row_wise_operators_run_on_a_stream(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, "one two three. [[Page#S|x]]\n\nnext", "t", "2024-01-08 10:00:00"), (2, None, "t", None), (3, "short", "u", None)],
        "id long, text string, title string, at string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))

    def drain(df, name):
        query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        query.processAllAvailable()
        query.stop()
        return sorted(map(tuple, spark.table(name).collect()), key=repr)

    plain = lambda df: sorted(map(tuple, df.collect()), key=repr)
    for i, make in enumerate([
        lambda df: rowwise.clean(df, "text", "title", "at", 3, keep=["id"]),
        lambda df: rowwise.link_rows(df, "id", "text"),
        lambda df: rowwise.sentence_rows(df, "id", "text", 1),
        lambda df: rowwise.paragraph_rows(df, "id", "text"),
        lambda df: rowwise.with_period(df.select("id", F.col("at").cast("timestamp_ntz").alias("m")), "m", "week"),
    ]):
        got = drain(make(stream), f"out{i}")
        assert got and got == plain(make(rows))


def test_notes_are_written_by_all_cores(spark):
    from pathlib import Path

    from textloom import scale
    from textloom.plans import source_plans
    from textloom.plans.registry import Tables

    tables = Tables(spark, "/root/testdata/sf0.001")
    rows = spark.range(0, 40, 1, 1).selectExpr("id AS s_suppkey", "concat('n', id) AS s_name", "int(id % 25) AS s_nationkey")
    tables.supplier = rows
    before = set(scale._WRITTEN)
    assert source_plans.load_notes_dir(tables).count() == 80
    parts = {f.name[:10] for p in set(scale._WRITTEN) - before for f in Path(p).rglob("note=*/part-*")}
    assert len(parts) > 1


def test_pages_of_one_row_group_are_parsed_by_all_cores(spark, tmp_path):
    from textloom.plans import scalar_plans
    from textloom.plans.registry import Tables

    text = "concat('n', id)"
    rows = spark.range(0, 400, 1, 1).selectExpr(
        "id AS p_partkey", f"{text} AS p_name", f"{text} AS p_brand", f"{text} AS p_type", "int(id % 50) AS p_size"
    )
    rows.write.parquet(str(tmp_path / "part.parquet"))
    pages = scalar_plans.paper_pages(Tables(spark, str(tmp_path)))
    tasks = [r["count"] for r in pages.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 400 and len(tasks) >= 4 and max(tasks) <= 200
