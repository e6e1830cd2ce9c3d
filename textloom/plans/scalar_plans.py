"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import dates, links, text as tx, vectors
from textloom.plans.registry import plan
from textloom.scale import dealt, fit_broadcast
from textloom.sources import markup

# Texts with links, headings and addresses are built from the part and nation names.


def wiki_text(t):
    body = F.concat(
        F.lit("[["), "p_brand", F.lit("|"), "p_name", F.lit("]] and [[#"), "p_type", F.lit("|x]] see [["),
        "p_name", F.lit("#"), "p_type", F.lit("|y]] [[File:"), "p_name", F.lit(".png]] [[Category:"), "p_type",
        F.lit("]] [[!include "), "p_name", F.lit("]] [["), "p_brand", F.lit("]]"),
    )
    return t.part.select(F.col("p_partkey").alias("id"), body.alias("body"), "p_brand", "p_type", "p_name")


@plan(
    "X01_period_ordinals",
    """
    SELECT o_orderkey, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS day,
      CAST(date_diff('week', DATE '1969-12-29', date_trunc('week', o_orderdate)) + 1 AS INTEGER) AS week,
      CAST(date_diff('month', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS month
    FROM orders
    """,
)
def period_ordinals(t):
    at = F.col("o_orderdate")
    return t.orders.select(
        "o_orderkey", *[dates.period_ordinal(at, g).alias(g) for g in ("day", "week", "month")]
    )


@plan(
    "X02_wikitext_links",
    """
    SELECT p_partkey AS id, 0 AS pos, string_split(p_brand, '#')[1] AS page, string_split(p_brand, '#')[2] AS section FROM part
    UNION ALL SELECT p_partkey, 1, NULL, p_type FROM part
    UNION ALL SELECT p_partkey, 2, p_name, p_type FROM part
    UNION ALL SELECT p_partkey, 3, '!include ' || p_name, NULL FROM part
    UNION ALL SELECT p_partkey, 4, string_split(p_brand, '#')[1], string_split(p_brand, '#')[2] FROM part
    """,
)
def wikitext_links(t):
    return wiki_text(t).select(
        "id", F.posexplode(links.wikitext_links(F.col("body"))).alias("pos", "link")
    ).select("id", "pos", "link.page", "link.section")


@plan(
    "X03_wikitext_headings",
    """
    SELECT n_nationkey AS id, 0 AS pos, 2 AS level, n_name AS title FROM nation
    UNION ALL SELECT n_nationkey, 1, 3, n_name || ' trade' FROM nation
    UNION ALL SELECT n_nationkey, 2, 2, 'k' || CAST(c_custkey AS VARCHAR)
      FROM nation JOIN (SELECT c_nationkey, min(c_custkey) AS c_custkey FROM customer GROUP BY 1) ON n_nationkey = c_nationkey
    """,
)
def wikitext_headings(t):
    first = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.min("c_custkey").alias("c"))
    body = F.concat(
        F.lit("== "), "n_name", F.lit(" ==\ntext = x\n=== "), "n_name", F.lit(" trade  ===  \n== bad ===\n==k"),
        F.col("c").cast("string"), F.lit("=="),
    )
    rows = t.nation.join(first, "n_nationkey")
    return rows.select(
        F.col("n_nationkey").alias("id"), F.posexplode(links.wikitext_headings(body)).alias("pos", "h")
    ).select("id", "pos", "h.level", "h.title")


@plan(
    "X04_wiki_links",
    """
    WITH all_links AS (
      SELECT p_partkey AS id, unnest([p_brand || '|' || p_name, '#' || p_type || '|x', p_name || '#' || p_type || '|y',
        'File:' || p_name || '.png', 'Category:' || p_type, p_brand]) AS link FROM part)
    SELECT DISTINCT id, link FROM all_links
    """,
)
def wiki_links(t):
    return wiki_text(t).select("id", F.explode(links.wiki_links(F.col("body"))).alias("link"))


def note_text(t):
    """One outline note per supplier that links to its nation and region."""
    rows = t.supplier.join(fit_broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey"))
    body = F.concat(
        F.lit(":PROPERTIES:\n:ID:  s-"), F.col("s_suppkey").cast("string"),
        F.lit("\n:END:\n* Place\n[[id:n-"), F.col("n_nationkey").cast("string"), F.lit("]["), "n_name",
        F.lit("]] and [[id:r-"), F.col("n_regionkey").cast("string"), F.lit("][region]] [[id:broken]]"),
    )
    return rows.select("s_suppkey", "n_nationkey", "n_regionkey", body.alias("body"))


@plan(
    "X05_note_links",
    """
    SELECT s_suppkey, 0 AS pos, 'n-' || CAST(n_nationkey AS VARCHAR) AS link FROM supplier JOIN nation ON s_nationkey = n_nationkey
    UNION ALL
    SELECT s_suppkey, 1, 'r-' || CAST(n_regionkey AS VARCHAR) FROM supplier JOIN nation ON s_nationkey = n_nationkey
    """,
)
def note_links(t):
    return note_text(t).select("s_suppkey", F.posexplode(links.note_links(F.col("body"))).alias("pos", "link"))


@plan("X06_note_id", "SELECT s_suppkey, 's-' || CAST(s_suppkey AS VARCHAR) AS org_id FROM supplier")
def note_id(t):
    return note_text(t).select("s_suppkey", links.note_id(F.col("body")).alias("org_id"))


@plan(
    "X07_file_name_time",
    """
    SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN date_trunc('second', ts) END AS created FROM events
    """,
)
def file_name_time(t):
    name = F.concat(
        F.when(F.col("event_id") % 4 != 0, F.date_format("ts", "yyyyMMddHHmmss")).otherwise(F.lit("note")),
        F.lit("-"), "event_type",
    )
    return t.events.select("event_id", dates.file_name_time(name).alias("created"))


@plan(
    "X08_path_parts",
    """
    SELECT event_id, 'roam/' || event_type AS root_path, strftime(ts, '%Y%m%d%H%M%S') AS date,
           'k' || CAST(user_id AS VARCHAR) || '.org' AS name
    FROM events
    """,
)
def path_parts(t):
    path = F.concat(
        F.lit("roam/"), "event_type", F.lit("/"), F.date_format("ts", "yyyyMMddHHmmss"), F.lit("-k"),
        F.col("user_id").cast("string"), F.lit(".org"),
    )
    parts = links.note_path(path)
    return t.events.select("event_id", parts["root_path"].alias("root_path"), parts["date"].alias("date"), parts["name"].alias("name"))


@plan(
    "X09_unsnake",
    """
    SELECT event_id, event_type || ' ' || ' NUMBER ' || CASE WHEN user_id >= 100 THEN ' NUMBER ' ELSE CAST(user_id AS VARCHAR) END
        || 'x' AS words
    FROM events
    """,
)
def unsnake(t):
    raw = F.concat("event_type", F.lit("_"), F.lit(" 7 "), F.col("user_id").cast("string"), F.lit("x"))
    return t.events.select("event_id", tx.unsnake(raw).alias("words"))


@plan(
    "X10_drop_control",
    r"SELECT doc_id, md5(regexp_replace(text, '\p{C}', '', 'g')) AS digest FROM documents",
)
def drop_control(t):
    noisy = F.concat(F.col("text"), F.lit("​\u0007"))
    return t.documents.select("doc_id", F.md5(tx.drop_control(noisy)).alias("digest"))


@plan(
    "X11_sha1_ids",
    "SELECT doc_id, sha1(source) AS name_id, sha1(source || text) AS chunk_id FROM documents",
)
def sha1_ids(t):
    return t.documents.select(
        "doc_id", tx.document_id(F.col("source")).alias("name_id"),
        tx.chunk_id(F.col("source"), F.col("text")).alias("chunk_id"),
    )


@plan(
    "X12_html_parts",
    """
    SELECT page_id,
      regexp_extract(html, '<title>(.*?)</title>', 1, 's') LIKE '%&%' AS escaped,
      len(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS n_anchors,
      regexp_extract(html, '<a [^>]*href="([^"]*)"', 1) AS first_href,
      FALSE AS has_script,
      trim(regexp_replace(regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1, 's'), '&quot;', '"', 'g'), '&amp;?', '&', 'g')) AS title,
      regexp_extract(html, '<a [^>]*>([^<]*)</a>', 1) AS first_label,
      regexp_extract(html, '<footer>&copy; ([a-zA-Z0-9]*)', 1) AS footer
    FROM pages
    """,
)
def html_parts(t):
    parsed = markup.parse_pages(t.pages.select("page_id", "html"))
    raw = t.pages.select("page_id", links.html_title(F.col("html")).contains("&").alias("escaped"))
    rows = parsed.select(
        "page_id",
        F.size("anchors").cast("long").alias("n_anchors"),
        F.coalesce(F.get("anchors", F.lit(0))["href"], F.lit("")).alias("first_href"),
        F.trim("title").alias("title"),
        F.coalesce(F.get("anchors", F.lit(0))["label"], F.lit("")).alias("first_label"),
        F.regexp_extract("body", "© ([a-zA-Z0-9]*)", 1).alias("footer"),
        (F.col("body").contains("track(") | F.col("body").contains("margin:0")).alias("has_script"),
    )
    return rows.join(raw, "page_id")


def paper_pages(t):
    """Paper pages with an abstract and a bibliography made from the part names."""
    item = F.concat(
        F.lit('<li id="b"><span class="tag">'), "p_brand", F.lit(" ("), (F.col("p_size") + 1970).cast("string"),
        F.lit(")</span><span>"), "p_type", F.lit("</span><span> "), "p_name",
        F.lit('</span>'),
        F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("<span>ArXiv, arXiv:"), F.col("p_partkey").cast("string"), F.lit(".1</span>"))).otherwise(F.lit("")),
        F.lit("</li>"),
    )
    html = F.concat(
        F.lit("<html><head><title>Paper "), F.col("p_partkey").cast("string"),
        F.lit('</title><style>x</style></head><body><blockquote class="abstract mathjax">Abstract: On &amp; about '), "p_name",
        F.lit('</blockquote><ul class="ltx_biblist">'), item, item, F.lit("</ul></body></html>"),
    )
    parts = dealt(t.part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size"))
    return parts.select("p_partkey", html.alias("html"))


@plan(
    "X13_bibliography",
    """
    SELECT p_partkey, item, p_brand || ' (' || CAST(p_size + 1970 AS VARCHAR) || ')' AS ref_name,
           p_type AS authors, p_name AS title,
           CASE WHEN p_size % 2 = 0 THEN 'ArXiv, arXiv:' || CAST(p_partkey AS VARCHAR) || '.1' END AS source,
           'On & about ' || p_name AS block, 'Paper ' || CAST(p_partkey AS VARCHAR) AS page_title
    FROM part, (VALUES (0), (1)) AS i(item)
    """,
)
def bibliography(t):
    parsed = markup.parse_pages(paper_pages(t)).withColumnRenamed("title", "page_title")
    rows = markup.bibliography(parsed, ["p_partkey", "block", "page_title"])
    return rows.drop("year", "source_type")


@plan(
    "X14_citation_fields",
    """
    SELECT p_partkey, CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER) AS year, 'ArXiv' AS source_type
    FROM part
    """,
)
def citation_fields(t):
    source = F.concat(F.lit(" ArXiv, vol. "), F.col("p_size").cast("string"), F.lit(", 2"))
    return t.part.select(
        "p_partkey", links.citation_year(F.concat("p_brand", F.lit(" 1999"))).alias("year"),
        links.citation_source_type(source).alias("source_type"),
    )


@plan(
    "X15_arxiv_id",
    """
    SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN CAST(p_partkey + 1000 AS VARCHAR) || '.' || CAST(p_size AS VARCHAR) END AS arxiv_id
    FROM part
    """,
)
def arxiv_id(t):
    ref = F.when(
        F.col("p_size") % 2 == 0,
        F.concat("p_name", F.lit(" arXiv:"), (F.col("p_partkey") + 1000).cast("string"), F.lit("."), F.col("p_size").cast("string"), F.lit("v2")),
    ).otherwise(F.col("p_name"))
    return t.part.select("p_partkey", links.arxiv_id(ref).alias("arxiv_id"))


@plan(
    "X16_url_extraction",
    """
    WITH said AS (
        SELECT 'page' AS kind, page_id AS id, [url, 'www.site.org/p' || CAST(page_id AS VARCHAR), 'http://a.org/w_(b_(c))', 'foo.com',
            'Sub.Example.co.uk:80/x?y=1#z'] AS found FROM pages
        UNION ALL SELECT 'document', doc_id, ['http://a.org/w_(' || CAST(doc_id AS VARCHAR) || ')', 'example.net', 'example.lt', 'shop.mobi/x'] FROM documents
    )
    SELECT kind, id, CAST(pos AS INTEGER) AS pos, url FROM (SELECT kind, id, unnest(range(len(found))) AS pos, unnest(found) AS url FROM said)
    """,
)
def url_extraction(t):
    number = lambda c: F.col(c).cast("string")
    page = F.concat(
        F.lit("see "), "url", F.lit(" and (www.site.org/p"), number("page_id"),
        F.lit("), not a.b; <http://a.org/w_(b_(c))>. foo.com, me@foo.com, x@mail.site.org! 'Sub.Example.co.uk:80/x?y=1#z' http:// .com v1.2"),
    )
    document = F.concat("text", F.lit("\n(http://a.org/w_("), number("doc_id"), F.lit(")) example.net, example.lt; shop.mobi/x. not.anending"))
    rows = t.pages.select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), page.alias("text")).unionByName(
        t.documents.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), document.alias("text"))
    )
    return rows.select("kind", "id", F.posexplode(links.urls(F.col("text"))).alias("pos", "url"))


@plan(
    "X17_repo_url",
    """
    SELECT s_suppkey, CASE WHEN s_suppkey % 3 < 2 THEN 'https://github.com/o/' || CAST(s_suppkey AS VARCHAR) END AS repo
    FROM supplier
    """,
)
def repo_url(t):
    n = F.col("s_suppkey")
    prefix = F.when(n % 3 == 0, F.lit("https://github.com/o/")).when(n % 3 == 1, F.lit("github.com/o/")).otherwise(F.lit("http://gitlab.com/o/"))
    return t.supplier.select("s_suppkey", links.repo_url(F.concat(prefix, n.cast("string"), F.lit("//"))).alias("repo"))


@plan(
    "X18_iso_times",
    """
    SELECT event_id, strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S UTC') AS utc, CAST(ts - INTERVAL 2 HOUR AS DATE) AS day
    FROM events
    """,
)
def iso_times(t):
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    utc = dates.iso_to_utc_text(iso)
    return t.events.select("event_id", utc.alias("utc"), dates.utc_text_date(utc).alias("day"))


@plan(
    "X19_url_host",
    "SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages",
)
def url_host(t):
    return t.pages.select("page_id", links.url_host(F.col("url")).alias("host"))


@plan(
    "X20_srt_times",
    """
    WITH s AS (SELECT event_id, CAST(floor(value * 100) AS BIGINT) AS s, CAST(event_id * 7 % 1000 AS BIGINT) AS ms FROM events)
    SELECT event_id, format('{:02d}:{:02d}:{:02d},{:03d}', s // 3600 % 24, s // 60 % 60, s % 60, 500) AS start FROM s
    """,
)
def srt_times(t):
    seconds = F.floor(F.col("value") * 100) + F.lit(0.5)
    return t.events.select("event_id", dates.srt_time(seconds).alias("start"))


@plan(
    "X21_cosine",
    """
    WITH c AS (SELECT embedding AS anchor FROM embeddings WHERE vec_id = 0)
    SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(anchor AS DOUBLE[])), 6) AS cosine,
           round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(anchor AS DOUBLE[])), 6) AS distance
    FROM embeddings, c
    """,
)
def cosine(t):
    anchor = F.array(*[F.lit(float(x)) for x in t.embeddings.where("vec_id = 0").first()["embedding"]])
    similarity = vectors.cosine(F.col("embedding"), anchor)
    return t.embeddings.select(
        "vec_id", F.round(similarity, 6).alias("cosine"), F.round(1 - similarity, 6).alias("distance")
    )


@plan(
    "X22_hyperbolic_distance",
    """
    WITH h AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
    SELECT vec_id, round(acosh(greatest(1.0, sqrt(1 + list_dot_product(v, v)) * sqrt(1.25) - v[1] * 0.5)), 5) AS d FROM h
    """,
)
def hyperbolic_distance(t):
    point = vectors.to_hyperboloid(F.col("embedding"))
    axis = F.transform("embedding", lambda x, i: F.when(i == 0, 0.5).otherwise(0.0))
    return t.embeddings.select("vec_id", F.round(vectors.lorentz_distance(point, vectors.to_hyperboloid(axis)), 5).alias("d"))


@plan(
    "X23_hyperbolic_maps",
    """
    WITH h AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings),
    d AS (SELECT vec_id, a / (1 + sqrt(1 + a * a + b * b)) AS x, b / (1 + sqrt(1 + a * a + b * b)) AS y FROM h)
    SELECT vec_id, round(x, 6) AS x, round(y, 6) AS y, round(-2 * x / (x * x + (y + 1) * (y + 1)), 6) AS re,
           round((1 - x * x - y * y) / (x * x + (y + 1) * (y + 1)), 6) AS im
    FROM d
    """,
)
def hyperbolic_maps(t):
    lifted = vectors.to_hyperboloid(F.slice("embedding", 1, 2))
    turned = F.array(lifted[1], lifted[2], lifted[0])  # time-like coordinate last
    rows = t.embeddings.select("vec_id", vectors.hyperboloid_to_disk(turned).alias("p"))
    half = vectors.disk_to_half_plane(F.col("p")[0], F.col("p")[1])
    return rows.select(
        "vec_id", F.round(F.col("p")[0], 6).alias("x"), F.round(F.col("p")[1], 6).alias("y"),
        F.round(half["re"], 6).alias("re"), F.round(half["im"], 6).alias("im"),
    )


@plan(
    "X24_topk_entropy",
    """
    WITH s AS (SELECT vec_id, list_sort(list_transform(embedding, lambda x: abs(x::DOUBLE)), 'DESC')[1:3] AS top FROM embeddings),
    p AS (SELECT vec_id, list_transform(top, lambda x: x / list_sum(top)) AS p FROM s)
    SELECT vec_id, round(-list_sum(list_transform(p, lambda x: x * ln(x))), 6) AS entropy FROM p
    """,
)
def topk_entropy(t):
    scores = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    return t.embeddings.select("vec_id", F.round(tx.topk_entropy(scores), 6).alias("entropy"))


@plan(
    "X25_harmonic_mean",
    """
    SELECT l_orderkey, l_linenumber, round(2 / (1 / l_quantity + 1 / l_extendedprice), 6) AS hm FROM lineitem
    """,
)
def harmonic_mean(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber",
        F.round(tx.harmonic_mean(F.col("l_quantity"), F.col("l_extendedprice")), 6).alias("hm"),
    )


@plan(
    "X26_map_inherit",
    """
    SELECT p_partkey, CASE WHEN p_size > 25 THEN p_name ELSE p_brand END AS lr, p_type AS policy, p_brand AS "group",
           3 AS n
    FROM part
    """,
)
def map_inherit(t):
    base = F.create_map(F.lit("lr"), F.col("p_brand"), F.lit("group"), F.col("p_brand"), F.lit("_base"), F.lit("x"))
    child = F.when(
        F.col("p_size") > 25,
        F.create_map(F.lit("lr"), F.col("p_name"), F.lit("policy"), F.col("p_type"), F.lit("_base"), F.lit("b")),
    ).otherwise(F.create_map(F.lit("policy"), F.col("p_type"), F.lit("_base"), F.lit("b")))
    kwargs = tx.inherit(child, base)
    return t.part.select(
        "p_partkey", kwargs["lr"].alias("lr"), kwargs["policy"].alias("policy"), kwargs["group"].alias("group"),
        F.size(kwargs).alias("n"),
    )


@plan(
    "X27_marked_sections",
    """
    WITH m AS (SELECT conv_id, turn, 'intro ' || role || '##' || text || '## end' AS body FROM conversations),
    p AS (SELECT conv_id, turn, string_split(body, '##') AS parts FROM m)
    SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS no, string_split(parts[i], chr(10))[1] AS header,
           CAST(length(parts[i]) AS INTEGER) AS chars
    FROM (SELECT conv_id, turn, parts, unnest(range(1, len(parts) + 1)) AS i FROM p)
    """,
)
def marked_sections(t):
    body = F.concat(F.lit("intro "), "role", F.lit("##"), "text", F.lit("## end"))
    return t.conversations.select("conv_id", "turn", F.inline(tx.marked_sections(body))).select(
        "conv_id", "turn", "no", "header", F.length("body").alias("chars")
    )


@plan(
    "X28_run_names",
    """
    SELECT o_orderkey, 'logs/' || o_orderstatus || '/' || o_orderpriority || '_' || o_orderstatus || '_seed'
        || CAST(o_custkey % 3 AS VARCHAR) AS log_dir
    FROM orders
    """,
)
def run_names(t):
    return t.orders.select(
        "o_orderkey",
        tx.run_name(
            F.lit("logs"), F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_orderstatus"),
            F.col("o_custkey") % 3,
        ).alias("log_dir"),
    )
