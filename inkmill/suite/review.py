"""Queries of the review plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkmill.operators.reviewing import MIN_BLOCK, TOLD, change_rows
from inkmill.plans.clean import clean
from inkmill.plans.review import decision_log, only, review_chapters, reviewed_chapters
from inkmill.session import stored
from inkmill.suite.data import WS, sql_strip, sql_words, word_chapters
from inkmill.suite.registry import query
from inkmill.suite.rules import _DAMAGED, _NO_ADS, sql_auto

_JUDGED = sql_auto(sql_words)
# Words are parted by exactly one blank line, so places are sums of lengths.
_PLACES = f"""{_JUDGED},
lead AS (SELECT book_id, chapter_index, text, length(text) - length(regexp_replace(text, '^[{WS}]+', '')) AS lead FROM chapters),
located AS (SELECT o.*, l.lead + coalesce(sum(length(raw) + 2) OVER (PARTITION BY o.book_id, o.chapter_index ORDER BY paragraph
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS i1
       FROM outs o JOIN lead l USING (book_id, chapter_index)),
ch AS (SELECT *, CASE WHEN result = '' THEN 'delete' ELSE 'replace' END AS tag FROM located WHERE result <> raw)"""


def _reviewed(spark, sf):
    return review_chapters(word_chapters(spark, sf), _NO_ADS, mode="auto")


def _changed(spark, sf, texts=True):
    """Changes written down, as a reviewer needs them before deciding; with the texts where these are to be reviewed."""
    changed = _reviewed(spark, sf).withColumn("changes", only([n for n, _ in TOLD if n not in ("j1", "j2")]))
    return stored(changed if texts else changed.drop("title", "original_text"), "review-changes", "zstd")


# Every finding with its place in the chapter; what auto mode removes as residue hides the others of its paragraph.
_LISTED = f"""{_PLACES},
every AS (
  SELECT book_id, chapter_index, paragraph, 0 AS grp, 0 AS seq, split_part(hit, ' ', 1) AS rule, split_part(hit, ' ', 2) AS confidence,
         NULL::DOUBLE AS score, s AS original, '' AS replacement FROM res WHERE hit IS NOT NULL
  UNION ALL
  SELECT p.book_id, p.chapter_index, p.paragraph, 1, p.seq, f.rule, f.confidence, NULL, p.i.original, p.i.replacement
  FROM (SELECT book_id, chapter_index, paragraph, unnest(issues) AS i, unnest(range(len(issues))) AS seq FROM k) p
  JOIN fact f ON f.rule = p.i.rule
  UNION ALL
  SELECT book_id, chapter_index, paragraph, 2, seq, CASE WHEN c = chr(65533) THEN 'replacement_character'
         ELSE 'control_or_zero_width_character' END, 'high', NULL, c, ''
  FROM (SELECT book_id, chapter_index, paragraph, unnest(regexp_extract_all(text, '{_DAMAGED}')) AS c,
          unnest(range(len(regexp_extract_all(text, '{_DAMAGED}')))) AS seq FROM k)
  UNION ALL
  SELECT book_id, chapter_index, paragraph, 3, pos, 'contextual_traditional_character',
         CASE score WHEN 0.96 THEN 'high' WHEN 0.35 THEN 'low' ELSE 'medium' END, score, ch, new FROM t),
listed AS MATERIALIZED (SELECT * FROM every WHERE grp = 0 UNION ALL
           SELECT * FROM every ANTI JOIN gone USING (book_id, chapter_index, paragraph) WHERE grp > 0),
touched AS (SELECT DISTINCT book_id, chapter_index FROM ch),
-- In a chapter that auto mode left alone, doubtful page numbers are suggested to go: the k-th of equal ones takes
-- the k-th place in the text where it is found.
asked AS (SELECT i.book_id, i.chapter_index, i.original AS o,
            row_number() OVER (PARTITION BY i.book_id, i.chapter_index, i.original ORDER BY i.paragraph) AS nth
          FROM listed i ANTI JOIN touched u USING (book_id, chapter_index) WHERE grp = 0),
places AS (SELECT l.*, o, ((length(raw) - length(replace(raw, o, ''))) // length(o))::BIGINT AS n
           FROM located l JOIN (SELECT DISTINCT book_id, chapter_index, o FROM asked) USING (book_id, chapter_index)),
upto AS (SELECT *, sum(n) OVER (PARTITION BY book_id, chapter_index, o ORDER BY paragraph) AS top FROM places),
suggested AS (SELECT book_id, chapter_index, paragraph, i1, raw,
                left(raw, instr(raw, o) - 1) || substr(raw, instr(raw, o) + length(o)) AS result
              FROM upto JOIN asked USING (book_id, chapter_index, o) WHERE nth > top - n AND nth <= top),
changes AS MATERIALIZED (SELECT book_id, chapter_index, paragraph, i1, raw, result, tag, true AS own FROM ch
            UNION ALL SELECT book_id, chapter_index, paragraph, i1, raw, result,
              CASE WHEN result = '' THEN 'delete' ELSE 'replace' END, false FROM suggested),
bare AS MATERIALIZED (SELECT *, {sql_strip('original')} AS o, {sql_strip('replacement')} AS r FROM listed),
-- A change of auto mode stems from an issue of its own paragraph, a suggested one from any of its chapter.
met AS (SELECT c.book_id, c.chapter_index, c.paragraph AS place, c.raw, c.result, i.paragraph, i.grp, i.seq, i.rule, i.confidence, i.o, i.r
        FROM changes c JOIN bare i USING (book_id, chapter_index, paragraph) WHERE c.own
        UNION ALL SELECT c.book_id, c.chapter_index, c.paragraph, c.raw, c.result, i.paragraph, i.grp, i.seq, i.rule, i.confidence, i.o, i.r
        FROM changes c JOIN bare i USING (book_id, chapter_index) WHERE NOT c.own),
fitting AS (SELECT *, row_number() OVER (PARTITION BY book_id, chapter_index, place ORDER BY confidence <> 'high', paragraph, grp, seq) AS nth
   FROM met WHERE (o <> '' AND (contains(raw, o) OR contains(o, {sql_strip('raw')}))) OR (r <> '' AND contains(result, r))),
shown AS (SELECT * FROM fitting WHERE nth = 1),
unseen AS (SELECT * FROM listed ANTI JOIN shown USING (book_id, chapter_index, paragraph, grp, seq)
           WHERE confidence <> 'low' AND original <> '' AND original <> replacement),
told AS (SELECT c.book_id, c.chapter_index, c.paragraph, -1 AS grp, 0::BIGINT AS seq, i1::INT AS i1, (i1 + length(c.raw))::INT AS i2, tag,
           c.raw AS original, c.result AS replacement, coalesce(f.rule, 'cleaned_text_diff') AS rule, coalesce(f.confidence, 'high') AS confidence
         FROM changes c LEFT JOIN shown f ON f.book_id = c.book_id AND f.chapter_index = c.chapter_index AND f.place = c.paragraph
  UNION ALL SELECT book_id, chapter_index, paragraph, grp, seq, 0, 0, 'issue_replace', original, replacement, rule, confidence FROM unseen),
review AS (SELECT *, row_number() OVER (PARTITION BY book_id, chapter_index ORDER BY grp >= 0, paragraph, grp, seq) - 1 AS change_index FROM told)"""


@query(
    "issues",
    f"""WITH {_LISTED} SELECT l.book_id, l.chapter_index, l.paragraph,
  row_number() OVER (PARTITION BY l.book_id, l.chapter_index, l.paragraph ORDER BY l.grp, l.seq) - 1 AS seq,
  f.category, f.confidence, f.confidence_score, f.rule, md5(l.original) AS original, md5(l.replacement) AS replacement,
  CASE WHEN f.confidence = 'high' THEN f.action ELSE 'report' END AS action, f.confidence = 'high' AS applied
FROM listed l JOIN fact f ON f.rule = l.rule AND f.confidence = l.confidence
  AND (l.score IS NULL OR l.score = f.confidence_score)""",
)
def issues(spark, sf):
    """Every finding of auto mode, in the order of its paragraph."""
    found = clean(word_chapters(spark, sf), _NO_ADS, mode="auto").issues
    return found.select(
        "book_id", "chapter_index", "paragraph", F.col("seq").cast("long").alias("seq"), "category", "confidence", "confidence_score", "rule",
        F.md5("original").alias("original"), F.md5("replacement").alias("replacement"), "action", "applied",
    )


@query(
    "review_changes",
    f"""WITH {_LISTED} SELECT v.book_id, v.chapter_index, change_index, i1, i2, tag, md5(original) AS original, md5(replacement) AS replacement,
  coalesce(category, 'text_change') AS category, v.rule, v.confidence, v.confidence = 'high' AS default_accepted
FROM review v LEFT JOIN (SELECT DISTINCT rule, category FROM fact) f ON f.rule = v.rule""",
)
def review_changes(spark, sf):
    """Changes of all chapters, and suggestions that no change shows, with the issues they stem from."""
    rows = change_rows(_reviewed(spark, sf))
    return rows.select(
        "book_id", "chapter_index", F.col("change_index").cast("long").alias("change_index"), "i1", "i2", "tag",
        F.md5("original").alias("original"), F.md5("replacement").alias("replacement"),
        "category", "rule", "confidence", "default_accepted",
    )


def _decisions(changed):
    """Every third place rejected, every third suggestion accepted; texts of six characters and more could be replaced nearly,

    which has no SQL form, so they are turned down.
    """
    rows = change_rows(changed)
    suggestion = F.col("tag") == "issue_replace"
    return rows.select(
        "book_id", "chapter_index", "change_index",
        F.when(suggestion, (F.col("change_index") % 3 == 0) & (F.length("original") < MIN_BLOCK)).otherwise(F.col("i1") % 3 != 0).alias("accepted"),
    )


@query(
    "review_apply",
    f"""WITH {_LISTED},
r_picked AS (SELECT l.book_id, l.chapter_index, l.paragraph, CASE WHEN c.i1 % 3 <> 0 THEN c.result ELSE l.raw END AS part,
             coalesce(c.i1 % 3 <> 0, false) AS touched FROM located l LEFT JOIN changes c USING (book_id, chapter_index, paragraph)),
r_body AS (SELECT book_id, chapter_index, bool_or(touched) AS touched,
           string_agg(part, chr(10) || chr(10) ORDER BY paragraph) AS t FROM r_picked GROUP BY 1, 2),
r_walked AS (SELECT c.book_id, c.chapter_index, c.text, CASE WHEN touched THEN t ELSE c.text END AS t
           FROM chapters c LEFT JOIN r_body USING (book_id, chapter_index)),
-- Accepted suggestions take the first place where they are found, one after the other.
r_asks AS (SELECT book_id, chapter_index, list({{'a': original, 'b': replacement}} ORDER BY change_index) AS l FROM review
         WHERE tag = 'issue_replace' AND change_index % 3 = 0 AND length(original) < {MIN_BLOCK} GROUP BY 1, 2),
r_done AS (SELECT w.*, CASE WHEN l IS NULL THEN t ELSE list_reduce(list_prepend({{'a': t, 'b': ''}}, l), lambda x, y: {{
     'a': CASE WHEN contains(x.a, y.a) THEN left(x.a, instr(x.a, y.a) - 1) || y.b || substr(x.a, instr(x.a, y.a) + length(y.a)) ELSE x.a END,
     'b': ''}}).a END AS u FROM r_walked w LEFT JOIN r_asks USING (book_id, chapter_index))
SELECT book_id, chapter_index, md5(CASE WHEN u <> text THEN regexp_replace(
   regexp_replace(u, '\\n[{WS}]*\\n(?:[{WS}]*\\n)+', chr(10) || chr(10), 'g'), '^[{WS}]+|[{WS}]+$', '', 'g')
   ELSE u END) AS digest FROM r_done""",
)
def review_apply(spark, sf):
    changed = _changed(spark, sf)
    done = reviewed_chapters(changed, _decisions(changed))
    return done.select("book_id", "chapter_index", F.md5("text").alias("digest"))


@query(
    "review_decisions",
    f"""WITH {_LISTED} SELECT book_id, chapter_index, count(*) AS changes, count(*) FILTER (tag = 'issue_replace') AS suggestions,
  count(*) FILTER (CASE WHEN tag = 'issue_replace' THEN change_index % 3 = 0 AND length(original) < {MIN_BLOCK} ELSE i1 % 3 <> 0 END) AS accepted FROM review GROUP BY 1, 2""",
)
def review_decisions(spark, sf):
    """Decisions on all changes and suggestions."""
    changed = _changed(spark, sf, texts=False)
    log = decision_log(changed, _decisions(changed), told=("tag",))
    return log.groupBy("book_id", "chapter_index").agg(
        F.count(F.lit(1)).alias("changes"), F.count_if(F.col("tag") == "issue_replace").alias("suggestions"),
        F.count_if("accepted").alias("accepted"),
    )
