"""Collections, chunks, notes, books, threads and the crawl frontier."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import links
from textloom.operators import books, chunks, corpus, notes
from textloom.plans.registry import plan
from textloom.plans.scalar_plans import note_text
from textloom.plans.table_plans import WS
from textloom.scale import scratch_path, settle
from textloom.sources import writers


@plan(
    "D01_doc_collection",
    rf"""
    WITH kept AS (
      SELECT doc_id, string_split(text, chr(10))[1] AS title, regexp_replace(substring(text, 1, 1024), '{WS}', ' ', 'g') AS content,
             '[' || lang || ', ' || source || ']' AS tasks
      FROM documents WHERE length(text) > 0
        AND length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) / length(text) > 0.9),
    firsts AS (SELECT title, min(doc_id) AS doc_id FROM kept GROUP BY 1)
    SELECT CAST(row_number() OVER (ORDER BY doc_id) AS BIGINT) AS id, md5(content) AS digest, md5(title) AS title, tasks
    FROM kept JOIN firsts USING (title, doc_id)
    """,
)
def doc_collection(t):
    docs = t.documents.select("doc_id", "text", F.substring_index("text", "\n", 1).alias("title"), F.array("lang", "source").alias("tasks"))
    built = corpus.build_collection(docs, "text", ["doc_id"], "title", extra=["tasks"])
    path = scratch_path(t.spark)
    writers.write_tsv(built, path)
    back = t.spark.read.options(header="true", sep="\t", escape="\\", multiLine="true").schema(built.schema).csv(path)
    return back.select("id", F.md5("content").alias("digest"), F.md5("title").alias("title"), "tasks")


def _chunked(t, size, overlap):
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    return chunks.chunk_rows(t.documents.select(name.alias("name"), "text", "lang"), "name", "text", size, overlap)


BLANK = r"[\p{Z}\x09-\x0d\x1c-\x1f\x85]"


def chunk_sql(size, overlap):
    """The separator recursion as steps over cut places; the last table is chunks (doc_id, s, e), before trimming.

    A span of ``size`` characters or more is cut at the next finer separator. The others, between two such spans of
    one parent, are a run. From every possible start of a chunk the place after it and the next start
    follow by two nearest-place joins, and a recursive walk takes those that are reached from the run's first.
    """

    def spans(level, nodes, cuts):
        return (
            f"m{level} AS (SELECT doc_id, lo AS node, hi AS top, lo FROM {nodes} UNION "
            f"SELECT doc_id, lo, hi, i FROM {nodes} JOIN {cuts} USING (doc_id) WHERE i > lo AND i < hi), "
            f"s{level} AS (SELECT doc_id, node, lo, lead(lo, 1, top) OVER w AS hi FROM m{level} WINDOW w AS (PARTITION BY doc_id, node ORDER BY lo)), "
            f"f{level} AS (SELECT *, hi - lo >= {size} AS big FROM s{level}), "
            f"r{level} AS (SELECT doc_id, {level} AS level, node, sum(CAST(big AS INTEGER)) OVER (PARTITION BY doc_id, node ORDER BY lo) AS part, lo, hi, big FROM f{level})"
        )

    return rf"""
    d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0),
    c AS (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS c FROM (SELECT doc_id, regexp_extract_all(text, '(?s).') AS l FROM d)),
    breaks AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM c WHERE c = chr(10)),
    pairs AS (SELECT doc_id, i, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY doc_id, g) AS m FROM breaks WINDOW w AS (PARTITION BY doc_id, g ORDER BY i)),
    c0 AS (SELECT doc_id, i FROM pairs WHERE k % 2 = 0 AND k + 1 < m),
    c1 AS (SELECT doc_id, i FROM breaks), c2 AS (SELECT doc_id, i FROM c WHERE c = ' '), c3 AS (SELECT doc_id, i FROM c),
    n0 AS (SELECT doc_id, 0 AS lo, n AS hi FROM d),
    {spans(0, 'n0', 'c0')}, n1 AS (SELECT doc_id, lo, hi FROM f0 WHERE big),
    {spans(1, 'n1', 'c1')}, n2 AS (SELECT doc_id, lo, hi FROM f1 WHERE big),
    {spans(2, 'n2', 'c2')}, n3 AS (SELECT doc_id, lo, hi FROM f2 WHERE big),
    {spans(3, 'n3', 'c3')},
    runs AS (SELECT doc_id, level || '/' || node || '/' || part AS run, lo, hi FROM
             (SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3) WHERE NOT big),
    ends AS (SELECT doc_id, run, min(lo) AS first, max(hi) AS top FROM runs GROUP BY 1, 2),
    over AS (SELECT a.doc_id, a.run, a.lo AS s, b.lo AS e, greatest(b.lo - {overlap}, b.hi - {size}) AS least
             FROM runs a ASOF JOIN runs b ON a.doc_id = b.doc_id AND a.run = b.run AND a.lo + {size} < b.hi WHERE b.lo > a.lo),
    steps AS (SELECT o.doc_id, o.run, o.s, o.e, least(b.lo, o.e) AS next FROM over o ASOF JOIN runs b ON o.doc_id = b.doc_id AND o.run = b.run AND o.least <= b.lo),
    walk AS (SELECT doc_id, run, first AS s FROM ends
             UNION ALL SELECT w.doc_id, w.run, t.next FROM walk w JOIN steps t ON t.doc_id = w.doc_id AND t.run = w.run AND t.s = w.s),
    chunks AS (SELECT w.doc_id, w.s, coalesce(t.e, top) AS e FROM walk w JOIN ends USING (doc_id, run)
               LEFT JOIN steps t ON t.doc_id = w.doc_id AND t.run = w.run AND t.s = w.s)"""


@plan(
    "D02_recursive_chunks",
    rf"""
    WITH RECURSIVE {chunk_sql(512, 128)},
    pieces AS (SELECT doc_id, s, substr(text, s + 1, e - s) AS piece FROM chunks JOIN d USING (doc_id)),
    trimmed AS (SELECT doc_id, s + length(piece) - length(regexp_replace(piece, '^{BLANK}+', '')) AS b,
                       regexp_replace(regexp_replace(piece, '^{BLANK}+', ''), '{BLANK}+$', '') AS chunk FROM pieces)
    SELECT 'd' || CAST(doc_id AS VARCHAR) AS name, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY b) - 1 AS INTEGER) AS chunkno,
           CAST(b AS INTEGER) AS start, CAST(b + length(chunk) AS INTEGER) AS "end", md5(chunk) AS digest
    FROM trimmed WHERE chunk <> ''
    """,
)
def recursive_chunks(t):
    return _chunked(t, 512, 128).select("name", "chunkno", "start", "end", F.md5("chunk").alias("digest"))


SOLID_SQL = r"CAST(length(regexp_replace(text, '[\p{Z}\x09-\x0d\x1c-\x1f\x85]', '', 'g')) AS BIGINT)"


def _solid(text):
    """Characters that are no white space."""
    return F.length(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]", "")).cast("long")


@plan(
    "D03_chunk_layouts",
    f"""
    SELECT 'd' || CAST(doc_id AS VARCHAR) AS name, sha1('d' || CAST(doc_id AS VARCHAR)) AS id, {SOLID_SQL} AS in_list, {SOLID_SQL} AS in_rows,
           CASE WHEN length(text) <= 1024 THEN md5(trim(text, ' ' || chr(9) || chr(10) || chr(13))) END AS only_chunk
    FROM documents WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''
    """,
)
def chunk_layouts(t):
    """The list of a document's chunks and the rows of them hold the same text; a short text is one chunk."""
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    docs = t.documents.select(name.alias("name"), "text")
    lists = chunks.chunk_arrays(docs.withColumn("size", F.length("text")), "name", "text", 1024, 0)
    rows = chunks.chunk_rows(docs, "name", "text", 1024, 0)
    counted = rows.groupBy("name").agg(F.sum(_solid(F.col("chunk"))).alias("in_rows"))
    total = F.aggregate("chunks", F.lit(0).cast("long"), lambda n, c: n + _solid(c))
    only = F.when(F.col("size") <= 1024, F.md5(F.array_join("chunks", "")))
    return lists.select("id", "name", total.alias("in_list"), only.alias("only_chunk")).join(counted, "name")


@plan(
    "D04_chunk_offsets",
    f"""
    SELECT 'd' || CAST(doc_id AS VARCHAR) AS name, TRUE AS found, {SOLID_SQL} AS solid,
           CASE WHEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 0 ELSE 1 END AS any_chunk
    FROM documents
    """,
)
def chunk_offsets(t):
    """Each chunk stands at its offsets, and the chunks hold every character that is no white space."""
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    listed = chunks.chunk_lists(t.documents.select(name.alias("name"), "text"), "text", 512, 0)
    return listed.select(
        "name", chunks.chunks_stand(F.col("text"), F.col("chunks")).alias("found"),
        F.aggregate("chunks", F.lit(0).cast("long"), lambda n, c: n + _solid(c["chunk"])).alias("solid"),
        F.least(F.size("chunks"), F.lit(1)).alias("any_chunk"),
    )


@plan(
    "D05_note_tree",
    """
    WITH n AS (SELECT s_suppkey, 'n-' || CAST(n_nationkey AS VARCHAR) || ', r-' || CAST(n_regionkey AS VARCHAR) AS links,
                 '[[id:n-' || CAST(n_nationkey AS VARCHAR) || '][' || n_name || ']] and [[id:r-' || CAST(n_regionkey AS VARCHAR)
                 || '][region]] [[id:broken]]' AS body
               FROM supplier JOIN nation ON s_nationkey = n_nationkey)
    SELECT 's-' || CAST(s_suppkey AS VARCHAR) AS org_id, 0 AS no, 0 AS level, '' AS heading, links, '' AS body FROM n
    UNION ALL
    SELECT 's-' || CAST(s_suppkey AS VARCHAR), 1, 1, 'Place', links, body FROM n
    """,
)
def note_tree(t):
    files = note_text(t).select(
        F.concat(F.lit("roam/"), F.col("s_suppkey").cast("string"), F.lit(".org")).alias("path"), F.col("body").alias("text")
    )
    rows = notes.note_elements(files, changed=None)
    return rows.select("org_id", "no", "level", "heading", F.array_join("links", ", ").alias("links"), F.trim("body").alias("body"))


def toc_pages(t):
    """Books from the suppliers of a nation: a contents page and three text pages each."""
    listed = t.supplier.select(F.col("s_suppkey").alias("k"), F.concat(F.lit("b"), F.col("s_suppkey").cast("string")).alias("book"))
    k = F.col("k").cast("string")
    page = lambda no, text: F.struct(F.lit(no).alias("page_num"), text.alias("text"))
    return listed.select(
        "book",
        F.inline(F.array(
            page(1, F.lit("A BOOK")),
            page(2, F.concat(F.lit("CONTENTS\nI. FIRST DAYS "), F.lit("3\nnoise\nII. LATER "), k, F.lit(" DAYS 5\n"),
                             F.when(F.col("k") % 2 == 0, F.lit("III. LAST DAYS")).otherwise(F.lit("")))),
            page(4, F.concat(F.lit("text "), k)),
            page(6, F.lit("more")),
            page(7, F.lit("")),
        )),
    )


@plan(
    "D06_book_toc",
    """
    SELECT 'b' || CAST(s_suppkey AS VARCHAR) AS book, 1 AS entry, 4 AS page_ref, 'I' AS roman, 'FIRST DAYS' AS title FROM supplier
    UNION ALL SELECT 'b' || CAST(s_suppkey AS VARCHAR), 2, 6, 'II', 'LATER ' || CAST(s_suppkey AS VARCHAR) || ' DAYS' FROM supplier
    UNION ALL SELECT 'b' || CAST(s_suppkey AS VARCHAR), 3, 10, 'III', 'LAST DAYS' FROM supplier WHERE s_suppkey % 2 = 0
    """,
)
def book_toc(t):
    rows = books.contents(toc_pages(t), first_page=4)
    return rows.withColumn("entry", F.col("entry").cast("int"))


@plan(
    "D07_thread",
    """
    SELECT conv_id, turn, role, md5(text) AS digest, row_number() OVER (ORDER BY conv_id, turn) AS place
    FROM conversations WHERE role <> 'system'
    """,
)
def thread(t):
    rows = t.conversations.where("role <> 'system'").select("conv_id", "turn", "role", F.md5("text").alias("digest"))
    return corpus.assign_ids(rows, ["conv_id", "turn"], "place")


def page_links(t):
    """(src, dst) addresses: anchors of each page, resolved against its host."""
    host = links.url_host(F.col("url"))
    rows = t.pages.select(
        F.concat(F.lit("http://"), host, F.lit("/")).alias("src"), host.alias("host"),
        F.explode(links.html_hrefs(F.col("html"))).alias("href"),
    )
    away = F.concat(F.lit("http://"), F.lower(F.expr("substring(href, 2)")), F.lit(".example.com/"))
    return rows.select("src", F.explode(F.array(F.concat(F.lit("http://"), "host", F.col("href")), away)).alias("dst")).distinct()


@plan(
    "D08_crawl_frontier",
    """
    WITH a AS (SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, unnest(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1)) AS href FROM pages),
    l AS (SELECT DISTINCT 'http://' || host || '/' AS src, 'http://' || host || href AS dst FROM a
          UNION SELECT 'http://' || host || '/', 'http://' || lower(substring(href, 2)) || '.example.com/' FROM a),
    s AS (SELECT DISTINCT 'http://' || regexp_extract(url, '^https?://([^/?#]+)', 1) || '/' AS url FROM pages),
    d1 AS (SELECT DISTINCT s.url AS start, dst AS url FROM s JOIN l ON src = s.url
           WHERE regexp_extract(dst, '^http://([^/]*)', 1) = regexp_extract(s.url, '^http://([^/]*)', 1) AND dst <> s.url
             AND NOT regexp_matches(dst, '\\.(jpg|jpeg|png|gif|webp|svg|ico|bmp)$')),
    d2 AS (SELECT DISTINCT d1.start, dst AS url FROM d1 JOIN l ON src = d1.url
           WHERE regexp_extract(dst, '^http://([^/]*)', 1) = regexp_extract(d1.start, '^http://([^/]*)', 1)
             AND NOT regexp_matches(dst, '\\.(jpg|jpeg|png|gif|webp|svg|ico|bmp)$')),
    u AS (SELECT url AS start, url, 0 AS depth FROM s UNION ALL SELECT start, url, 1 FROM d1 UNION ALL SELECT start, url, 2 FROM d2)
    SELECT start, url, min(depth) AS depth FROM u GROUP BY 1, 2
    """,
)
def crawl_frontier(t):
    from textloom.operators.graphs import crawl

    starts = t.pages.select(F.concat(F.lit("http://"), links.url_host(F.col("url")), F.lit("/")).alias("url")).distinct()
    return crawl(settle(page_links(t)), settle(starts), depth=2)


def book_text(t):
    nl = "\n"
    name = F.col("s_name")
    body = F.concat(
        F.lit("Preface "), name, F.lit(f"{nl}12{nl}goes   on{nl}{nl}---{nl}{nl}Second{nl}PART I: Start{nl}Freedom 1861-1865{nl}"
                                       f"One  two{nl}three{nl}  {nl}four{nl}CHAPTER II{nl}XIV{nl}CHAPTER III. Ends{nl}"),
        name, F.lit(f" the Freedom of 7{nl}last"),
    )
    return t.supplier.select("s_suppkey", body.alias("body"))


@plan(
    "W05_paragraphs",
    """
    SELECT s_suppkey, 0 AS no, 'Preface ' || s_name || ' goes on' AS paragraph FROM supplier
    UNION ALL SELECT s_suppkey, 1, 'Second PART I: Start One two three' FROM supplier
    UNION ALL SELECT s_suppkey, 2, 'four CHAPTER II CHAPTER III. Ends last' FROM supplier
    """,
)
def paragraphs(t):
    found = books.paragraphs(F.col("body"), ["freedom"])
    return book_text(t).select("s_suppkey", F.posexplode(found).alias("no", "paragraph"))


def stripped(x):
    return f"regexp_replace(regexp_replace({x}, '^{WS}', ''), '{WS}$', '')"


PARAGRAPH_SQL = rf"""
    WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: [x, {stripped('x')}]) AS pairs FROM documents),
    k AS (SELECT doc_id, list_filter(pairs, lambda p: p[2] <> '---' AND (p[2] = '' OR regexp_matches(p[1], '^(PART|CHAPTER)[	 ]+[IVXLCDM]+')
            OR NOT (regexp_matches(p[1], '^\s*(\d+|[IVXLCDM]+)\s*$') OR (regexp_matches(p[2], '\d{{4}}[-–—]\d{{4}}') AND length(p[2]) < 80)))) AS kept FROM l),
    j AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(array_to_string(list_transform(kept, lambda p: p[2]), chr(10)), '

+'),
            lambda x: {stripped(f"regexp_replace(x, '{WS}', ' ', 'g')")}), lambda x: x <> '') AS parts FROM k)
"""


@plan(
    "W05_document_paragraphs",
    PARAGRAPH_SQL + "SELECT doc_id, CAST(i AS INTEGER) AS no, md5(parts[i + 1]) AS digest FROM (SELECT doc_id, parts, unnest(range(len(parts))) AS i FROM j)",
)
def document_paragraphs(t):
    found = t.documents.select("doc_id", F.posexplode(books.paragraphs(F.col("text"))).alias("no", "paragraph"))
    return found.select("doc_id", "no", F.md5("paragraph").alias("digest"))


@plan(
    "D09_book_sections",
    """
    SELECT s_suppkey, 'Front Matter' AS title, 'Preface ' || s_name || ' goes on|Second' AS body FROM supplier
    UNION ALL SELECT s_suppkey, 'PART I: Start', 'One two three|four' FROM supplier
    UNION ALL SELECT s_suppkey, 'CHAPTER III. Ends', 'last' FROM supplier
    """,
)
def book_sections(t):
    found = book_text(t).select("s_suppkey", F.inline(books.sections(F.col("body"), ["freedom"])))
    return found.select("s_suppkey", "title", F.array_join("paragraphs", "|").alias("body"))


@plan(
    "D09_document_sections",
    PARAGRAPH_SQL + "SELECT doc_id, 'Front Matter' AS title, md5(array_to_string(parts, '|')) AS digest FROM j WHERE len(parts) > 0",
)
def document_sections(t):
    """Documents have no headings, so all of a text is its front matter."""
    found = t.documents.select("doc_id", F.inline(books.sections(F.col("text"))))
    return found.select("doc_id", "title", F.md5(F.array_join("paragraphs", "|")).alias("digest"))


@plan(
    "D10_chapter_texts",
    """
    WITH d AS (SELECT source AS book, doc_id, text, sum(CASE WHEN lang = 'fr' THEN 1 ELSE 0 END)
                 OVER (PARTITION BY source ORDER BY doc_id) AS entry,
                 sum(CASE WHEN lang = 'fr' THEN 1 ELSE 0 END) OVER (PARTITION BY source) AS n FROM documents),
    w AS (SELECT book, doc_id, entry, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS text FROM d WHERE entry > 0 OR (n = 0 AND doc_id >= 1))
    SELECT book, CAST(entry AS BIGINT) AS entry, 0 AS part, md5(string_agg(text, ' ' ORDER BY doc_id)) AS digest
    FROM w WHERE text <> '' GROUP BY 1, 2
    """,
)
def chapter_texts(t):
    from textloom.plans.join_plans import book_pages, book_spans

    rows = books.chapter_texts(book_pages(t), settle(book_spans(t)), part_bytes=64 << 20)
    return rows.select("book", "entry", "part", F.md5("text").alias("digest"))


@plan(
    "D11_preprocessed",
    r"""
    SELECT event_id, props AS text, event_type AS title, ts AS date,
           CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS time_period
    FROM events WHERE len(regexp_extract_all(lower(props), '[\p{L}\p{N}]+')) >= 2
    """,
)
def preprocessed(t):
    return corpus.preprocess(t.events, "day", "props", "event_type", "ts", 2, keep=["event_id"])

