"""Queries of pages, catalogs, ingest and state."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkmill.functions.numerals import parse_chapter_number
from inkmill.functions.text import content_hash
from inkmill.functions.urls import extract_url, host, make_page_url
from inkmill.operators.assembling import book_blocks, join_pages, readable_pages
from inkmill.operators.dedup import mark_duplicates
from inkmill.operators.elements import Pick
from inkmill.operators.selecting import (
    chapter_bounds, limit_chapters, range_spans, select_range, with_process_order, with_resume_status,
)
from inkmill.plans.catalog import (
    books, chapter_links, chapter_texts, chapter_titles, directory_pages, parsed_pages,
)
from inkmill.plans.ingest import IngestOptions, duplicate_report, failure_report, ingest, ingest_summary
from inkmill.session import dealt, shared_folder
from inkmill.sources.sinks import chapter_files
from inkmill.sources.sites import Part, Site, route
from inkmill.sources.state import latest_state
from inkmill.streaming.ingest import current_state, event_counts, first_seen, ingest_batch, ingest_events
from inkmill.suite.data import WS, documents, same, sql_chapters, sql_strip, table
from inkmill.suite.registry import query

_DIGEST = f"sha256(regexp_replace(text, '[{WS}]+', '', 'g'))"
_CH = sql_chapters(same)


# ---- deduplication -----------------------------------------------------------------------------


def _sql_dedup(order: str) -> str:
    return f"""WITH {_CH}, d AS (SELECT *, {_DIGEST} AS digest FROM chapters),
w AS (SELECT *, first_value(title) OVER g AS first_title, first_value(url) OVER g AS first_url, row_number() OVER g AS rn
      FROM d WINDOW g AS (PARTITION BY book_id, digest ORDER BY {order}))"""


def _marked(spark, sf, reverse=False):
    chapters = with_process_order(documents(spark, sf), reverse)
    return mark_duplicates(chapters), chapters


@query("dedup_keep", f"{_sql_dedup('chapter_index')} SELECT book_id, chapter_index, digest FROM w WHERE rn = 1")
def dedup_keep(spark, sf):
    return _marked(spark, sf)[0].filter("not duplicate").select("book_id", "chapter_index", "digest")


@query(
    "dedup_reverse",
    f"{_sql_dedup('chapter_index DESC')} SELECT book_id, chapter_index, digest, first_url FROM w WHERE rn > 1",
)
def dedup_reverse(spark, sf):
    return _marked(spark, sf, True)[0].filter("duplicate").select("book_id", "chapter_index", "digest", "first_url")


@query(
    "dedup_report",
    f"{_sql_dedup('chapter_index')} SELECT book_id, chapter_index, title, url, first_title, first_url, digest FROM w WHERE rn > 1",
)
def dedup_report(spark, sf):
    marks, chapters = _marked(spark, sf)
    return (
        marks.filter("duplicate")
        .join(chapters.select("book_id", "chapter_index", "title", "url"), ["book_id", "chapter_index"])
        .select("book_id", "chapter_index", "title", "url", "first_title", "first_url", "digest")
    )


# ---- selection ---------------------------------------------------------------------------------

# Every third document is an unnumbered chapter; books src0 to src4 have no numbers at all.
_NUMBERED = "source NOT IN ('src0', 'src1', 'src2', 'src3', 'src4') AND doc_id % 3 <> 0"
_CATALOG_SQL = f"""c AS (SELECT source AS book_id, doc_id AS chapter_index, source || '/' || doc_id AS url,
  CASE WHEN {_NUMBERED} THEN doc_id // 20 + 1 END AS number,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) AS position FROM documents)"""


def numbered_catalog(spark, sf):
    number = F.floor(F.col("doc_id") / 20) + 1
    rows = dealt(table(spark, sf, "documents").select("doc_id", "source"))
    return rows.select(
        F.col("source").alias("book_id"),
        F.col("doc_id").alias("chapter_index"),
        F.concat(F.lit("章 "), F.col("doc_id").cast("string")).alias("title"),
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        F.when(F.expr(_NUMBERED), number).alias("number"),
    )


_SPANS_SQL = f"""{_CATALOG_SQL},
b AS (SELECT book_id, count(*) AS chapter_count, min(number) AS lo, max(number) AS hi,
        min(chapter_index) FILTER (number BETWEEN 3 AND 7) AS first_index,
        max(chapter_index) FILTER (number BETWEEN 3 AND 7) AS last_index FROM c GROUP BY 1)"""


@query(
    "range_select",
    f"""WITH {_SPANS_SQL} SELECT c.book_id, c.chapter_index, c.number FROM c JOIN b USING (book_id)
WHERE CASE WHEN lo IS NOT NULL THEN chapter_index BETWEEN first_index AND last_index ELSE position BETWEEN 3 AND 7 END""",
)
def range_select(spark, sf):
    return select_range(numbered_catalog(spark, sf), 3, 7).select("book_id", "chapter_index", "number")


@query(
    "range_errors",
    f"""WITH {_CATALOG_SQL}, b AS (SELECT book_id, count(*) AS n, min(number) AS lo,
   count(*) FILTER (number BETWEEN 100000 AND 200000) AS hits FROM c GROUP BY 1)
SELECT book_id, CASE WHEN lo IS NOT NULL AND hits = 0 THEN 'no chapter in range'
  WHEN lo IS NULL AND n < 100000 THEN 'start lies behind the last chapter' END AS selection_error FROM b""",
)
def range_errors(spark, sf):
    return range_spans(numbered_catalog(spark, sf), 100000, 200000).select("book_id", "selection_error")


@query("chapter_limit", f"WITH {_CATALOG_SQL} SELECT book_id, chapter_index FROM c WHERE position <= 5")
def chapter_limit(spark, sf):
    return limit_chapters(numbered_catalog(spark, sf), 5).select("book_id", "chapter_index")


@query(
    "book_bounds",
    f"""WITH {_CATALOG_SQL} SELECT book_id, count(*) AS chapter_count, min(number) AS first_number,
  max(number) AS last_number FROM c GROUP BY 1""",
)
def book_bounds(spark, sf):
    return chapter_bounds(numbered_catalog(spark, sf))


def label_state(spark, sf):
    """Labelled documents as the state of an earlier run: good ones done, toxic ones known duplicates.

    Each has an older transition to another status, which does not count any more. Every tenth document is
    also known under an older URL, with the hash of its content.
    """
    every = table(spark, sf, "documents").select("doc_id", "source", "text")
    docs = every.select("doc_id", "source")
    labels = table(spark, sf, "labels")
    none = F.lit(None).cast("string")
    status = F.when(F.col("toxic") == 1, "duplicate").when(F.col("quality") == 1, "completed").otherwise("failed")
    now = labels.join(docs, "doc_id").select(
        F.col("source").alias("book_id"),
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        F.lit("old").alias("title"), status.alias("status"), F.lit("why").alias("reason"),
        none.alias("digest"), none.alias("first_title"), none.alias("first_url"),
        (F.col("doc_id") % 5 != 0).alias("stored"),
        F.timestamp_seconds(F.lit(3600)).alias("updated_at"),
    )
    other = F.when(F.col("status") == "completed", F.lit("failed")).otherwise(F.lit("completed"))
    before = now.withColumn("status", other).withColumn("updated_at", F.timestamp_seconds(F.lit(0)))
    stored = every.filter("doc_id % 10 = 3").select(
        F.col("source").alias("book_id"),
        F.concat("source", F.lit("/old"), F.col("doc_id").cast("string")).alias("url"),
        F.lit("old").alias("title"), F.lit("completed").alias("status"), none.alias("reason"),
        content_hash("text").alias("digest"), none.alias("first_title"), none.alias("first_url"),
        F.lit(True).alias("stored"), F.timestamp_seconds(F.lit(0)).alias("updated_at"),
    )
    return now.unionByName(before).unionByName(stored)


_STATUS_SQL = f"""{_CH}, s AS (SELECT source || '/' || d.doc_id AS url, toxic, quality, d.doc_id
   FROM labels JOIN documents d USING (doc_id)),
st AS (SELECT c.*, CASE WHEN toxic = 1 THEN 'duplicate' WHEN quality = 1 AND doc_id % 5 <> 0 THEN 'skipped'
   ELSE 'pending' END AS status, toxic, quality FROM chapters c LEFT JOIN s USING (url))"""


@query("resume", f"WITH {_STATUS_SQL} SELECT book_id, chapter_index, status FROM st")
def resume(spark, sf):
    catalog = documents(spark, sf).drop("text")
    return with_resume_status(catalog, latest_state(label_state(spark, sf))).select("book_id", "chapter_index", "status")


# A run over the documents after that state; documents of a length divisible by 11 fail.
_RUN_SQL = f"""{_STATUS_SQL}, run AS (SELECT *, {_DIGEST} AS digest FROM st WHERE status = 'pending'),
kept AS (SELECT source AS book_id, {_DIGEST} AS digest, min(source || '/old' || doc_id) AS old_url
         FROM documents WHERE doc_id % 10 = 3 GROUP BY 1, 2),
ok AS (SELECT run.*, old_url, row_number() OVER g > 1 OR old_url IS NOT NULL AS again,
              coalesce(CASE WHEN old_url IS NOT NULL THEN 'old' END, first_value(title) OVER g) AS first_title,
              coalesce(old_url, first_value(url) OVER g) AS first_url
       FROM run LEFT JOIN kept USING (book_id, digest)
       WHERE length(text) % 11 <> 0 AND text <> '' WINDOW g AS (PARTITION BY book_id, digest ORDER BY chapter_index)),
outcome AS (
  SELECT book_id, chapter_index, title, url, CASE WHEN again THEN 'duplicate' ELSE 'completed' END AS status, digest,
         CASE WHEN again THEN first_title END AS first_title, CASE WHEN again THEN first_url END AS first_url FROM ok
  UNION ALL SELECT book_id, chapter_index, title, url, 'failed', NULL, NULL, NULL FROM run
     WHERE length(text) % 11 = 0 OR text = ''
  UNION ALL SELECT book_id, chapter_index, title, url, status, NULL, NULL, NULL FROM st WHERE status <> 'pending')"""


def _run(spark, sf):
    docs = documents(spark, sf)
    catalog = docs.select("book_id", "chapter_index", "title", "url", F.lit(None).cast("bigint").alias("number"))
    bad = F.length("text") % 11 == 0
    texts = docs.select("book_id", "url", "text", F.when(bad, F.lit("not readable")).alias("error"))
    return ingest(catalog, texts, label_state(spark, sf)), catalog


@query(
    "ingest_outcomes",
    f"WITH {_RUN_SQL} SELECT book_id, chapter_index, title, url, status, digest, first_title, first_url FROM outcome",
)
def ingest_outcomes(spark, sf):
    return _run(spark, sf)[0].outcomes.drop("reason")


@query(
    "ingest_summary",
    f"""WITH {_RUN_SQL} SELECT book_id, count(*) FILTER (status = 'completed') AS completed,
  count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'duplicate') AS duplicates,
  count(*) FILTER (status = 'failed') AS failed FROM outcome GROUP BY 1""",
)
def ingest_summary_query(spark, sf):
    return ingest_summary(_run(spark, sf)[0].outcomes)


@query("ingest_chapters", f"WITH {_RUN_SQL} SELECT book_id, chapter_index, md5(text) AS digest FROM ok WHERE NOT again")
def ingest_chapters(spark, sf):
    return _run(spark, sf)[0].chapters.select("book_id", "chapter_index", F.md5("text").alias("digest"))


@query(
    "failure_report",
    f"WITH {_RUN_SQL} SELECT book_id, chapter_index, title, url, CASE WHEN status = 'failed' THEN 'not readable' END AS reason FROM outcome WHERE status = 'failed'",
)
def failure_report_query(spark, sf):
    done, catalog = _run(spark, sf)
    return failure_report(done.state, catalog)


@query(
    "duplicate_report",
    f"WITH {_RUN_SQL} SELECT book_id, chapter_index, title, url, first_title, first_url, digest FROM outcome WHERE status = 'duplicate' AND digest IS NOT NULL",
)
def duplicate_report_query(spark, sf):
    done, catalog = _run(spark, sf)
    return duplicate_report(done.state, catalog)


# ---- pages -------------------------------------------------------------------------------------

# The provided pages as a site of its own layout.
PAGE_SITE = Site(
    "pages",
    ("example.com", "example.net", "example.org"),
    title=(Part(Pick("h1")), Part(Pick("title"))),
    chapter_title=(Part(Pick("h1")), Part(Pick("title"))),
    links_in=Pick("nav"),
    link_parent="li",
    link_path="^/",
    content=Pick("article"),
)
OTHER_SITE = Site("farm", ("spam-farm.example.org",))
FALLBACK = Site("generic", is_fallback=True)


def pages(spark, sf):
    return dealt(table(spark, sf, "pages").select("page_id", "url", "html"))


_HOST = "lower(regexp_extract(url, '^https?://([^/?#:]+)', 1))"


@query(
    "route",
    f"""SELECT page_id, CASE WHEN h = 'spam-farm.example.org' OR h LIKE '%.spam-farm.example.org' THEN 'farm'
  WHEN regexp_matches(h, '(^|\\.)example\\.com$') THEN 'com' WHEN h <> '' THEN 'generic' END AS site_id
FROM (SELECT *, {_HOST} AS h FROM pages)""",
)
def route_query(spark, sf):
    sites = [FALLBACK, OTHER_SITE, Site("com", ("example.com",))]
    return table(spark, sf, "pages").select("page_id", route(F.col("url"), sites).alias("site_id"))


_PAGE_URL = """CASE WHEN q = '' THEN base || '?page=3' || f
  WHEN regexp_matches(q, '(^|&)page=') THEN base || '?' || regexp_replace(q, '(^|&)page=[^&]*', '\\1page=3') || f
  ELSE base || '?' || q || '&page=3' || f END"""


@query(
    "page_url",
    f"""WITH u AS (SELECT page_id, regexp_extract(url, '^[^?#]*') AS base, regexp_extract(url, '\\?([^#]*)', 1) AS q,
  regexp_extract(url, '#.*$') AS f FROM pages)
SELECT page_id, {_PAGE_URL} AS third, base || CASE WHEN r = '' THEN '' ELSE '?' || r END || f AS first
FROM (SELECT *, regexp_replace(regexp_replace(q, '(^|&)page=[^&]*', ''), '^&', '') AS r FROM u)""",
)
def page_url(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", make_page_url(url, 3).alias("third"), make_page_url(url, 1).alias("first")
    )


@query(
    "extract_url",
    "SELECT page_id, url AS bare, url AS marked, url AS ended, '第' || page_id || '页' AS no_url FROM pages",
)
def extract_url_query(spark, sf):
    pasted = F.concat(F.lit("看这里："), F.col("url"), F.lit("。谢谢"))
    marked = F.concat(F.lit("见 [目录 1]("), F.col("url"), F.lit(") 或 http://no.example/"))
    return table(spark, sf, "pages").select(
        "page_id", extract_url(pasted).alias("bare"), extract_url(marked).alias("marked"),
        extract_url(F.concat(F.lit("("), F.col("url"), F.lit("),. 完"))).alias("ended"),
        extract_url(F.concat(F.lit(" 第"), F.col("page_id").cast("string"), F.lit("页\n"))).alias("no_url"),
    )


def _sql_unescape(c: str) -> str:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        c = f"replace({c}, '{name}', '{char}')"
    return c


_TITLE = f"trim(regexp_replace({_sql_unescape('t')}, '[{WS}]+', ' ', 'g'))"


@query(
    "page_titles",
    f"""WITH t AS (SELECT page_id, url, regexp_extract(html, '<h1>(.*?)</h1>', 1, 's') AS t FROM pages)
SELECT page_id, url, {_TITLE} AS title FROM t""",
)
def page_titles(spark, sf):
    return chapter_titles(parsed_pages(pages(spark, sf), [PAGE_SITE]), [PAGE_SITE])


@query(
    "page_links",
    f"""WITH n AS (SELECT page_id, url, regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'), '<li><a href="([^"]*)">', 1) AS hrefs,
   regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'), '<a href="[^"]*">([^<]*)</a>', 1) AS names FROM pages),
l AS (SELECT page_id, regexp_extract(url, '^https?://[^/?#]+') AS origin, unnest(hrefs) AS href, unnest(names) AS t FROM n)
SELECT page_id, {_TITLE} AS title, origin || {_sql_unescape('href')} AS chapter_url, count(*) AS n FROM l GROUP BY 1, 2, 3""",
)
def page_links(spark, sf):
    links = chapter_links(parsed_pages(pages(spark, sf), [PAGE_SITE]), [PAGE_SITE])
    return links.groupBy("page_id", "title", "chapter_url").agg(F.count(F.lit(1)).alias("n"))


@query(
    "directory_walk",
    f"""WITH RECURSIVE u AS (SELECT url, min(page_id) AS id, {_HOST} AS h FROM pages GROUP BY url),
o AS (SELECT *, lead(url) OVER w AS next_url, first_value(url) OVER w AS root FROM u
      WINDOW w AS (PARTITION BY h ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT url, coalesce(next_url, root) AS next_url FROM o),
r AS (SELECT DISTINCT root FROM o),
walk AS (SELECT root AS book_url, root AS url, 1 AS page_no FROM r
  UNION ALL SELECT book_url, e.next_url, page_no + 1 FROM walk JOIN e ON e.url = walk.url WHERE e.next_url <> book_url)
SELECT book_url, url, page_no FROM walk""",
)
def directory_walk(spark, sf):
    """The pages of each host as one directory, in which the last page leads back to the first; all landed twice."""
    seen = table(spark, sf, "pages").groupBy("url").agg(F.min("page_id").alias("id")).withColumn("h", host(F.col("url")))
    whole = W.partitionBy("h").orderBy("id")
    listed = seen.select(
        "url", F.lead("url").over(whole).alias("next_url"), F.first("url").over(whole).alias("root")
    )
    edges = listed.select("url", F.coalesce("next_url", "root").alias("next_url"))
    roots = listed.select(F.col("root").alias("book_url"), F.col("root").alias("url"))
    return directory_pages(roots, edges.unionByName(edges))


@query("page_text")
def page_text(spark, sf):
    """Article text of each page; block structure has no SQL form and is tested on small pages."""
    texts = chapter_texts(parsed_pages(pages(spark, sf), [PAGE_SITE]), [PAGE_SITE])
    return texts.select("page_id", "url", F.length("text").alias("chars"), content_hash("text").alias("digest"), "error")


_ARTICLE = "regexp_replace(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), '<[^>]*>', '', 'g')"


@query(
    "page_digest",
    f"""WITH a AS (SELECT page_id, url, regexp_replace({_sql_unescape(_ARTICLE)}, '[{WS}]+', '', 'g') AS t FROM pages)
SELECT page_id, url, CASE WHEN t <> '' THEN sha256(t) END AS digest, CASE WHEN t = '' THEN 'empty content' END AS error FROM a""",
)
def page_digest(spark, sf):
    """Article text of each page by the hash that white space does not change."""
    texts = chapter_texts(parsed_pages(pages(spark, sf), [PAGE_SITE]), [PAGE_SITE])
    return texts.select("page_id", "url", F.when(F.col("text") != "", content_hash("text")).alias("digest"), "error")


# Pages in a layout that no site knows: the navigation says it is the content, the advert that it is the chapter.
_GENERIC = [
    ("<article>", '<div class="read body">'), ("</article>", "</div>"), ("<nav>", '<div id="content">'),
    ("</nav>", "</div>"), ('class="ad"', 'class="ad chapter"'),
]
_AD = "regexp_replace(regexp_extract(html, '<div class=\"ad\">(.*?)</div>', 1, 's'), '<[^>]*>', '', 'g')"


@query(
    "generic_content",
    f"""WITH a AS (SELECT page_id, url, regexp_replace({_sql_unescape(_ARTICLE)}, '[{WS}]+', '', 'g') AS t,
  regexp_replace({_sql_unescape(_AD)}, '[{WS}]+', '', 'g') AS ad FROM pages)
SELECT page_id, url, CASE WHEN t <> '' THEN sha256(t) WHEN ad <> '' THEN sha256(ad) END AS digest,
  CASE WHEN t = '' AND ad = '' THEN 'no content area' END AS error FROM a""",
)
def generic_content(spark, sf):
    """Content of pages without a known layout: the best named element that is not mostly links."""
    html = F.col("html")
    for known, other in _GENERIC:
        html = F.replace(html, F.lit(known), F.lit(other))
    texts = chapter_texts(parsed_pages(pages(spark, sf).withColumn("html", html), [FALLBACK]), [FALLBACK])
    return texts.select("page_id", "url", F.when(F.col("text") != "", content_hash("text")).alias("digest"), "error")


# The provided pages name their host in the footer; their advert stands for a description.
META_SITE = Site(
    "meta",
    ("example.com", "example.net", "example.org"),
    title=(Part(Pick("h1")),),
    author=(Part(Pick("footer"), before="·", after="©"),),
    description=(Part(Pick(cls="ad")),),
)


def _sql_line(c: str) -> str:
    return f"trim(regexp_replace({_sql_unescape(c)}, '[{WS}]+', ' ', 'g'))"


@query(
    "book_meta",
    f"""WITH m AS (SELECT page_id, url, regexp_extract(html, '<h1>(.*?)</h1>', 1, 's') AS t,
   regexp_extract(html, '<footer>&copy; (.*?) &middot;', 1) AS a, regexp_extract(html, '<div class="ad">(.*?)</div>', 1, 's') AS d FROM pages)
SELECT page_id, url AS book_url, {_sql_line('t')} AS title, {_sql_line('a')} AS author, {_sql_line('d')} AS description,
       CASE WHEN {_sql_line('t')} = '' THEN 'no book title' END AS error FROM m""",
)
def book_meta(spark, sf):
    """Title, author and description of each page seen as the page of a book."""
    return books(parsed_pages(pages(spark, sf), [META_SITE]), [META_SITE])


_DIGIT = "零一二三四五六七八九"


@query(
    "chapter_number",
    "SELECT o_orderkey, o_orderkey AS arabic, o_orderkey AS chinese, 300000000 + o_orderkey AS large FROM orders",
)
def chapter_number(spark, sf):
    """Chapter numbers written in ASCII digits and as Chinese numerals, of any size, and read back."""

    def section(number):
        def place(unit: int, name: str):
            digit = (F.floor(number / unit) % 10).cast("int")
            return F.when(
                digit > 0, F.concat(F.substring(F.lit(_DIGIT), digit + 1, F.lit(1)), F.lit(name))
            ).otherwise(F.lit("零"))

        return F.concat(place(1000, "千"), place(100, "百"), place(10, "十"), place(1, ""))

    above = F.floor(F.col("o_orderkey") / 10000)
    numeral = F.concat(
        F.when(above > 0, F.concat(section(above), F.lit("万"))).otherwise(F.lit("")), section(F.col("o_orderkey") % 10000)
    )
    titles = table(spark, sf, "orders").select("o_orderkey", numeral.alias("numeral"))
    return titles.select(
        "o_orderkey",
        parse_chapter_number(F.concat(F.lit(" 第 "), F.col("o_orderkey").cast("string"), F.lit(" 章 x"))).alias("arabic"),
        parse_chapter_number(F.concat(F.lit("第"), F.col("numeral"), F.lit("章"))).alias("chinese"),
        parse_chapter_number(F.concat(F.lit("第三亿"), F.col("numeral"), F.lit("章"))).alias("large"),
    )


# ---- assembly ----------------------------------------------------------------------------------


@query(
    "assemble",
    "SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS digest, count(*)::INT AS pages FROM conversations GROUP BY 1",
)
def assemble(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("page_no"), "text")
    return join_pages(turns, ["conv_id"]).select("conv_id", F.md5("text").alias("digest"), "pages")


@query(
    "page_stop",
    f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
p AS (SELECT doc_id, unnest(ls) AS text, unnest(range(1, len(ls) + 1)) AS page_no FROM l),
d AS (SELECT *, row_number() OVER (PARTITION BY doc_id, {_DIGEST} ORDER BY page_no) AS rn FROM p),
e AS (SELECT doc_id, coalesce(min(page_no) FILTER (text = '' OR rn > 1), 9223372036854775807) AS stop FROM d GROUP BY 1)
SELECT doc_id, page_no::INT AS page_no, md5(text) AS digest FROM d JOIN e USING (doc_id) WHERE page_no < stop""",
)
def page_stop(spark, sf):
    """Lines of a document as the pages of a chapter."""
    docs = documents(spark, sf).select(F.col("chapter_index").alias("doc_id"), "text")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "text")).select(
        "doc_id", (F.col("at") + 1).alias("page_no"), F.lit(None).cast("int").alias("page_total"), "text"
    )
    kept = readable_pages(lines, keys=["doc_id"])
    return kept.select("doc_id", "page_no", F.md5("text").alias("digest"))


@query(
    "book_text",
    f"""WITH {_CH}, b AS (SELECT DISTINCT book_id FROM chapters)
SELECT book_id, 0::BIGINT AS block, md5(book_id || chr(10) || '作者：未知' || chr(10) || '来源：' || book_id || '/' || chr(10)) AS digest FROM b
UNION ALL SELECT book_id, chapter_index, md5(title || chr(10) || chr(10) || {sql_strip('text')} || chr(10)) FROM chapters""",
)
def book_text(spark, sf):
    chapters = documents(spark, sf)
    books = chapters.select("book_id").distinct().select(
        "book_id", F.col("book_id").alias("title"), F.lit("").alias("author"),
        F.concat("book_id", F.lit("/")).alias("source_url"),
    )
    return book_blocks(books, chapters).select("book_id", "block", F.md5("text").alias("digest"))


# ---- events and sinks --------------------------------------------------------------------------


@query(
    "event_counts",
    "SELECT user_id % 100 AS book_id, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2",
)
def event_counts_query(spark, sf):
    events = table(spark, sf, "events").select((F.col("user_id") % 100).alias("book_id"), F.col("event_type").alias("kind"))
    return event_counts(events)


@query(
    "ingest_events",
    f"""WITH {_RUN_SQL} SELECT book_id, 'chapter_' || status AS kind, count(*) AS n FROM outcome GROUP BY 1, 2""",
)
def ingest_events_query(spark, sf):
    return event_counts(ingest_events(_run(spark, sf)[0].outcomes))


@query(
    "chapter_files",
    f"""WITH {_CH}, n AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(title, '[<>:"/\\\\|?*\\x00-\\x1f]', '_', 'g'),
   '[{WS}]+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g') AS clean FROM chapters)
SELECT book_id, chapter_index, CASE WHEN chapter_index < 10000 THEN lpad(chapter_index::VARCHAR, 4, '0') ELSE chapter_index::VARCHAR END
   || '_' || CASE WHEN regexp_replace(left(clean, 80), '[ .]+$', '') = '' THEN 'chapter' ELSE regexp_replace(left(clean, 80), '[ .]+$', '') END || '.txt' AS file_name,
   md5({sql_strip('text')} || chr(10)) AS digest FROM n""",
)
def chapter_files_query(spark, sf):
    return chapter_files(documents(spark, sf)).select("book_id", "chapter_index", "file_name", F.md5("text").alias("digest"))


@query(
    "first_seen",
    f"WITH {_CH}, d AS (SELECT DISTINCT book_id, {_DIGEST} AS digest FROM chapters) SELECT book_id, digest FROM d",
)
def first_seen_query(spark, sf):
    return first_seen(documents(spark, sf)).select("book_id", "digest")


# ---- state over batches ------------------------------------------------------------------------

# All documents, the last digit of their number says in which of ten batches they land.
_BATCHES_SQL = f"""{_CH}, d AS (SELECT *, {_DIGEST} AS digest, coalesce(text, '') = '' AS bad FROM chapters),
w AS (SELECT *, first_value(title) OVER g AS ft, first_value(url) OVER g AS fu, row_number() OVER g AS rn
      FROM d WHERE NOT bad WINDOW g AS (PARTITION BY book_id, digest ORDER BY chapter_index % 10, chapter_index))"""


@query(
    "state_batches",
    f"""WITH {_BATCHES_SQL} SELECT book_id, url, title, CASE WHEN rn = 1 THEN 'completed' ELSE 'duplicate' END AS status,
  digest, CASE WHEN rn > 1 THEN ft END AS first_title, CASE WHEN rn > 1 THEN fu END AS first_url FROM w
UNION ALL SELECT book_id, url, title, 'failed', NULL, NULL, NULL FROM d WHERE bad""",
)
def state_batches(spark, sf):
    """State after all documents came in ten batches, each against the state of those before."""
    out = f"{shared_folder(spark)}/state-batches-{uuid.uuid4().hex}"
    none = F.lit(None).cast("string")
    landed = documents(spark, sf).withColumns({"number": F.lit(None).cast("bigint"), "error": none})
    for k in range(10):
        ingest_batch(landed.filter(F.pmod("chapter_index", F.lit(10)) == k), k, out)
    return current_state(spark, out).select("book_id", "url", "title", "status", "digest", "first_title", "first_url")
