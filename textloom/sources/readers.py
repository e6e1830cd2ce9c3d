"""Files to DataFrames. Every reader takes a path, folder or glob and declares its schema
where the layout is known."""

from __future__ import annotations

import csv
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.scale import salted_join, settle

CSV_OPTIONS = {
    "header": "true",
    "multiLine": "true",
    "quote": '"',
    "escape": '"',
    "mode": "PERMISSIVE",
}


def _stem(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1].lower()


def read_csv(spark: SparkSession, path, schema=None, sep: str = ",", multi_line: bool = True) -> DataFrame:
    """CSV with a header. ``multi_line=False`` lets Spark split files that hold no line
    breaks inside quotes."""
    reader = spark.read.options(**CSV_OPTIONS).option("sep", sep)
    reader = reader.option("multiLine", str(multi_line).lower())
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", "true")
    return reader.csv(path)


def load_documents(spark: SparkSession, path: str, schema=None, multi_line: bool = True) -> DataFrame:
    """A document table from a .csv or .jsonl path. Large CSV files without line breaks inside
    quotes should be read with ``multi_line=False``, which lets Spark split them."""
    name = _stem(path)
    if name.endswith(".jsonl"):
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.json(path)
    if name.endswith(".csv"):
        return read_csv(spark, path, schema, multi_line=multi_line)
    raise ValueError(f"unsupported file format: {path}; use .csv or .jsonl")


def load_corpus(spark: SparkSession, path: str, schema=None, multi_line: bool = True) -> DataFrame:
    """A corpus from .csv, .csv.gz, .json, .json.gz or .parquet. A JSON file is one document
    (an array of rows). ``multi_line=False`` lets Spark split CSV files without line breaks in quotes."""
    name = _stem(path)
    if name.endswith((".csv", ".csv.gz")):
        return read_csv(spark, path, schema, multi_line=multi_line)
    if name.endswith((".json", ".json.gz")):
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.option("multiLine", "true").json(path)
    if name.endswith(".parquet"):
        return spark.read.parquet(path)
    raise ValueError(f"unsupported file format: {path}")


def preview(df: DataFrame, rows: int = 5, order: list[str] | None = None) -> DataFrame:
    """The first rows, by ``order`` where one is given."""
    return (df.orderBy(*order) if order else df).limit(rows)


# Column names tried in this order.
TEXT_NAMES = ("text", "body", "content", "description")
TITLE_NAMES = ("title", "heading", "name", "subject")
DATE_NAMES = ("date", "created_at", "timestamp", "time")


def guess_columns(columns: list[str]) -> dict[str, str | None]:
    """Text, title and date column by name, else the first column."""
    first = columns[0] if columns else None

    def pick(names):
        return next((n for n in names if n in columns), first)

    return {"text": pick(TEXT_NAMES), "title": pick(TITLE_NAMES), "date": pick(DATE_NAMES)}


def file_path() -> Column:
    """Path of a row's file as it was given, not URL encoded."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def file_part(pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(file_path(), pattern, group)


HEAD_SETTINGS = ("spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes")


def csv_headers(spark: SparkSession, folder: str, glob: str = "*.csv") -> DataFrame:
    """(path, head): the first line of every file, as a table.

    Each file, or part of a large one, is a scan partition of its own, and a task takes its first lines and stops, so
    only the first bytes of the files are read.
    """
    lines = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(folder)
        .select(file_path().alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("head"))
    )

    def first_line(batches):
        for batch in batches:
            if batch.num_rows:
                if batch.column(1)[0].as_py() == 0:
                    yield batch.slice(0, 1).select([0, 2])
                return

    kept = {name: spark.conf.get(name) for name in HEAD_SETTINGS}
    try:  # a split that costs as much to open as a partition may hold shares it with no other
        for name in HEAD_SETTINGS:
            spark.conf.set(name, kept["spark.sql.files.maxPartitionBytes"])
        found = settle(lines.mapInArrow(first_line, "path string, head string"))
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)
    return found.select("path", F.regexp_replace("head", "^\ufeff|\\r+$", "").alias("head"))


def load_csv_folder(
    spark: SparkSession,
    folder: str,
    name_column: str,
    name_pattern: str = r"([^/]+)\.csv$",
    schema: T.StructType | None = None,
    skip_unreadable: bool = False,
    multi_line: bool = True,
    glob: str = "*.csv",
) -> DataFrame:
    """All CSV files of a folder, with a name taken from each path as a column.

    The files are read in one scan. Without a schema the columns are read by place, and each file's header, joined
    by path, says which place holds which name; only the different headers reach the driver.
    """

    def scan(paths, with_schema, extra=()):
        return (
            spark.read.options(**CSV_OPTIONS)
            .option("multiLine", str(multi_line).lower())
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", glob)
            .option("ignoreCorruptFiles", str(skip_unreadable).lower())
            .schema(with_schema)
            .csv(paths)
            .select("*", file_part(name_pattern).alias(name_column), *extra)
        )

    if schema is not None:
        return scan(folder, schema)
    headers = csv_headers(spark, folder, glob)
    names = {r["head"]: next(csv.reader([r["head"]]), []) for r in headers.select("head").distinct().collect()}
    if not names:
        return spark.createDataFrame([], T.StructType([T.StructField(name_column, T.StringType())]))
    places = [f"_place_{i}" for i in range(max(map(len, names.values())))]
    rows = scan(folder, T.StructType([T.StructField(p, T.StringType()) for p in places]), [file_path().alias("_path")])
    rows = salted_join(rows, headers.select(F.col("path").alias("_path"), F.col("head").alias("_head")), ["_path"])
    listed = list(dict.fromkeys(name for head in sorted(names) for name in names[head]))
    columns = []
    for name in listed:
        value = F.lit(None).cast("string")
        for head, held in names.items():
            if name in held:
                value = F.when(F.col("_head") == head, F.col(places[held.index(name)])).otherwise(value)
        columns.append(value.alias(name))
    return rows.select(*columns, name_column)


SNAPSHOT_USER = r"([^/]+)_github_stars_[^/]*\.csv$"


def load_snapshots(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    user_pattern: str = SNAPSHOT_USER,
    glob: str = "*_github_stars_*.csv",
) -> DataFrame:
    """Union of timestamped star snapshots with the user from the path. Files that cannot be
    read are left out."""
    return load_csv_folder(
        spark, folder, "username", user_pattern, schema, skip_unreadable=True, glob=glob
    )


# Columns of a page in a wiki export.
WIKI_PAGE = """
    title string, ns int, id bigint, redirect struct<_title string>,
    revision array<struct<id bigint, timestamp timestamp,
        contributor struct<username string, ip string>, comment string, text string>>
"""


def load_wiki_dump(spark: SparkSession, path: str) -> DataFrame:
    """One row per page of a MediaWiki export, with the last revision in file order."""
    reader = spark.read.format("xml").option("rowTag", "page").option("ignoreSurroundingSpaces", "false")
    pages = reader.schema(WIKI_PAGE).load(path)
    last = F.element_at("revision", -1)
    body = last["text"]
    return pages.where(F.size("revision") > 0).select(
        F.col("id").alias("page_id"),
        "title",
        F.col("ns").alias("namespace"),
        F.col("redirect._title").alias("redirect"),
        last["id"].alias("rev_id"),
        last["timestamp"].alias("timestamp"),
        F.coalesce(last["contributor"]["username"], last["contributor"]["ip"]).alias("contributor"),
        last["comment"].alias("comment"),
        body.alias("text"),
        F.coalesce(F.length(body), F.lit(0)).alias("text_length"),
    )


def load_whole_files(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """One row per file: path, change time and whole text. ``glob`` matches file names."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(folder, wholetext=True).select(
        file_path().alias("path"),
        F.col("_metadata.file_modification_time").alias("changed"),
        F.col("value").alias("text"),
    )


def load_content_tree(
    spark: SparkSession, folder: str, content: str = "content.md", name: str = "name"
) -> DataFrame:
    """Folders that hold both a content and a name file, as (folder, title, contents)."""
    files = load_whole_files(spark, folder)
    leaf = rf"^(.*)/(?:[^/=]+=)?({re.escape(content)}|{re.escape(name)})(?:/[^/]*)?$"
    kinds = settle(  # every file is opened once, for both sides of the join
        files.select(
            F.regexp_extract("path", leaf, 1).alias("folder"),
            F.regexp_extract("path", leaf, 2).alias("kind"),
            "text",
        ).where("kind <> ''")
    )
    contents = kinds.where(F.col("kind") == content).select("folder", F.col("text").alias("contents"))
    titles = kinds.where(F.col("kind") == name).select("folder", F.col("text").alias("title"))
    return titles.join(contents, "folder")


# Layout of a page record of the text recogniser.
OCR_PAGE = "book string, page_num int, page_response struct<natural_text string>"


def load_ocr_pages(spark: SparkSession, path: str) -> DataFrame:
    """Numbered pages with their text; a missing text is empty."""
    return (
        spark.read.schema(OCR_PAGE)
        .json(path)
        .where(F.col("page_num").isNotNull())
        .select(
            "book", "page_num", F.coalesce("page_response.natural_text", F.lit("")).alias("text")
        )
    )


# Layout of a link record.
LINK_RECORD = "source_name string, destination_name string, source_date string, destination_date string"


def load_link_records(spark: SparkSession, path: str, schema: str = LINK_RECORD, multi_line=False) -> DataFrame:
    """Chosen fields of wider link records in JSON or Parquet."""
    if _stem(path).endswith(".parquet"):
        names = [part.split()[0] for part in schema.split(",")]
        return spark.read.parquet(path).select(*names)
    return spark.read.schema(schema).option("multiLine", str(multi_line).lower()).json(path)


# Layout of a crawl record.
CRAWL_RECORD = """
    url string, markdown string, cleaned_html string, html string, success boolean,
    error_message string, links array<string>,
    metadata struct<depth int, title string, description string>
"""


def load_crawl_records(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Crawl results with the first non-empty of markdown, cleaned HTML and HTML as content."""
    raw = spark.read.schema(CRAWL_RECORD).option("multiLine", str(multi_line).lower()).json(path)
    some = lambda name: F.nullif(F.col(name), F.lit(""))
    content = F.coalesce(some("markdown"), some("cleaned_html"), some("html"))
    links = F.coalesce("links", F.array().cast("array<string>"))
    return raw.select(
        "url",
        F.coalesce("metadata.depth", F.lit(0)).alias("depth"),
        F.coalesce("metadata.title", F.lit("")).alias("title"),
        F.coalesce("metadata.description", F.lit("")).alias("description"),
        content.alias("content"),
        "html",
        F.coalesce(F.length(content), F.lit(0)).alias("content_length"),
        links.alias("links"),
        F.size(links).alias("links_count"),
        F.coalesce("success", F.lit(False)).alias("success"),
        F.col("error_message").alias("error"),
    )


def tidy_runs(runs: DataFrame) -> DataFrame:
    """Finished runs as flat rows.

    ``runs`` has experiment, params, tags and metrics (maps). Runs of the ``Default``
    experiment and runs without a mean reward are left out.
    """
    metric = lambda name: F.col("metrics").getItem(name)
    return runs.where((F.col("experiment") != "Default") & metric("eval/mean_reward").isNotNull()).select(
        F.col("experiment").alias("env_id"),
        F.coalesce(F.col("tags").getItem("experiment_group"), F.lit("")).alias("experiment_group"),
        F.coalesce(F.col("params").getItem("algo_name"), F.lit("")).alias("algo_name"),
        F.coalesce(F.col("params").getItem("seed").cast("int"), F.lit(0)).alias("seed"),
        metric("eval/mean_reward").alias("mean_reward"),
        F.coalesce(metric("eval/std_reward"), F.lit(0.0)).alias("std_reward"),
    )
