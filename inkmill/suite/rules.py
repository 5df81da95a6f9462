"""Queries of the paragraph rules and of the clean plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkmill.functions.arrays import unnest
from inkmill.functions.text import is_english_or_url, split_paragraphs
from inkmill.operators import rulebook as rb
from inkmill.operators.ads import ad_issue, soft_cue_count
from inkmill.operators.blacklist import add_entries, all_matches, best_matches, normalized_paragraphs, paragraph_matches, read_entries
from inkmill.operators.characters import damaged_issues, repair
from inkmill.operators.punctuation import closed_quotes, paired_quotes, punctuate
from inkmill.operators.profile import profile_bigrams, profile_chars, profile_totals
from inkmill.operators.residue import residue_issue
from inkmill.plans.clean import clean, judge, tallied
from inkmill.plans.report import (
    category_counts, chapter_issue_totals, chapter_summary, confidence_counts, rule_counts,
)
from inkmill.sources.rules import load_rules, make_rules
from inkmill.sources.sinks import report_lines
from inkmill.suite.data import (
    CJK, WS, chinese_chapters, line_chapters, quoted, sql_chinese, sql_lines, sql_paragraphs, sql_strip,
    sql_words, table, word_chapters,
)
from inkmill.suite.registry import query

KEYS = ["book_id", "chapter_index", "paragraph"]
RULES = load_rules()


def paragraphs(chapters):
    """One row per paragraph: ``(book_id, chapter_index, paragraph, n, raw)``."""
    split = chapters.select("book_id", "chapter_index", split_paragraphs(F.col("text")).alias("ps"))
    # Counted before the list is unnested: what is taken of the list beside its elements carries it whole into every row.
    counted = split.select("book_id", "chapter_index", F.size("ps").alias("n"), "ps")
    return unnest(counted, ["book_id", "chapter_index", "n"], "ps", "raw", "paragraph")


# ---- SQL pieces --------------------------------------------------------------------------------

S, E = "chr(57344)", "chr(57345)"
_LEFT, _NEXT = f"([{CJK}])", f"""[{CJK}“”"'']"""
_B = f"[{WS}]*"
# rule: pattern around the match (left context, match, right context), replacement
_PATTERNS = {
    "escaped_quote_artifact": ("()", r"\\+", '(")', ""),
    "mixed_dash_sequence": (_LEFT, f"{_B}[—–-]{{2,}}{_B}", f"([{CJK}])", "——"),
    "repeated_cjk_comma": ("()", "，{2,}", "()", "，"),
    "repeated_cjk_period": ("()", "。{2,}", "()", "。"),
    "ascii_comma_in_chinese": (_LEFT, f"{_B},{_B}", f"({_NEXT})", "，"),
    "ascii_period_in_chinese": (_LEFT, rf"{_B}\.{_B}", f"($|{_NEXT})", "。"),
    "ascii_question_in_chinese": (_LEFT, rf"{_B}\?{_B}", f"($|{_NEXT})", "？"),
    "ascii_exclamation_in_chinese": (_LEFT, f"{_B}!{_B}", f"($|{_NEXT})", "！"),
    "ascii_ellipsis_in_chinese": (_LEFT, rf"{_B}\.{{3,}}{_B}", f"($|{_NEXT})", "……"),
}
_FIND = f"{S} || '([^' || {E} || ']*)' || {E}"


def sql_count(c: str, ch: str) -> str:
    return f"(length({c}) - length(replace({c}, {quoted(ch)}, '')))"


def sql_cjk_count(c: str) -> str:
    return f"length(regexp_replace({c}, '[^{CJK}]+', '', 'g'))"


_IS_ENGLISH = f"""(regexp_matches(raw, 'https?://|www\\.|[\\p{{L}}\\p{{N}}_.+-]@[\\p{{L}}\\p{{N}}_.-]+\\.[\\p{{L}}\\p{{N}}_]')
  OR (length(regexp_replace(raw, '[^A-Za-z]+', '', 'g')) >= 20
      AND length(regexp_replace(raw, '[^A-Za-z]+', '', 'g')) > {sql_cjk_count('raw')} * 2))"""


def _sql_paired(t: str) -> str:
    q, co, cc, lo, lc = (sql_count(t, ch) for ch in '"「」“”')
    marked = f"list_transform(string_split({t}, '\"'), lambda x, i: x || CASE WHEN i = {q} + 1 THEN '' WHEN i % 2 = 1 THEN '“' ELSE '”' END)"
    return f"""CASE WHEN {q} = 0 THEN {t}
  WHEN {co} = {cc} + 1 AND {q} = 1 THEN replace({t}, '"', '」')
  WHEN {cc} = {co} + 1 AND {q} = 1 THEN replace({t}, '"', '「')
  WHEN {co} = {cc} AND regexp_matches({t}, '[」”][{WS}]*"$') THEN left({t}, length({t}) - 1)
  WHEN {lo} > {lc} AND {q} = 1 THEN replace({t}, '"', '”')
  WHEN {lc} > {lo} AND {q} = 1 THEN replace({t}, '"', '“')
  WHEN {q} % 2 = 1 THEN array_to_string({marked}, '') ELSE {t} END"""


def _sql_closed(t: str, opening: str, closing: str) -> str:
    return f"""CASE WHEN {sql_count(t, opening)} = {sql_count(t, closing)} + 1
  AND regexp_matches({t}, '[。！？…][{WS}]*$') AND {sql_cjk_count(t)} >= 2
  THEN regexp_replace({t}, '([。！？…])([{WS}]*)$', '\\1{closing}\\2') ELSE {t} END"""


def _found(rule: str, original: str, replacement: str) -> str:
    return f"{{'rule': '{rule}', 'original': {original}, 'replacement': {replacement}}}"


def sql_punctuated(projection) -> str:
    """CTE ``k(book_id, chapter_index, paragraph, n, raw, text, issues)``: the whole rule chain."""
    none = "[]::STRUCT(rule VARCHAR, original VARCHAR, replacement VARCHAR)[]"
    steps = [
        sql_paragraphs(projection),
        f"k0 AS (SELECT *, {_IS_ENGLISH} AS english, raw AS text, {none} AS issues FROM p)",
    ]
    last = "k0"
    for i, (rule, (left, match, right, new)) in enumerate(_PATTERNS.items(), start=1):
        pattern = quoted_regex(f"{left}({match}){right}")
        once = f"regexp_replace(text, {pattern}, '\\1' || {S} || '\\2' || {E} || '\\3', 'g')"
        twice = once if left == "()" else (
            f"regexp_replace({once}, {pattern}, '\\1' || {S} || '\\2' || {E} || '\\3', 'g')"
        )
        steps.append(f"m{i} AS (SELECT * REPLACE (CASE WHEN english THEN text ELSE {twice} END AS text) FROM {last})")
        issues = f"list_transform(regexp_extract_all(text, {_FIND}, 1), lambda x: {_found(rule, 'x', quoted(new))})"
        steps.append(
            f"k{i} AS (SELECT * REPLACE (regexp_replace(text, {_FIND}, '{new}', 'g') AS text, "
            f"list_concat(issues, {issues}) AS issues) FROM m{i})"
        )
        last = f"k{i}"
    for name, rule, changed in (
        ("kq", "straight_quote_in_chinese", _sql_paired("text")),
        ("kc", "unclosed_dialogue_quote", None),
    ):
        if changed is None:
            steps.append(f"kc0 AS (SELECT *, {_sql_closed('text', '「', '」')} AS half FROM {last})")
            last, changed, extra = "kc0", _sql_closed("half", "“", "”"), " EXCLUDE (half)"
        else:
            extra = ""
        steps.append(f"{name}1 AS (SELECT *{extra}, CASE WHEN english THEN text ELSE {changed} END AS new FROM {last})")
        steps.append(
            f"{name} AS (SELECT * EXCLUDE (new) REPLACE (new AS text, CASE WHEN new <> text THEN "
            f"list_append(issues, {_found(rule, 'text', 'new')}) ELSE issues END AS issues) FROM {name}1)"
        )
        last = name
    repeated = _found("long_repeated_expression", "x", "x")
    unmatched = (
        f"{sql_count('text', '“')} <> {sql_count('text', '”')} OR {sql_count('text', '「')} <> {sql_count('text', '」')}"
    )
    steps.append(
        f"k AS (SELECT * REPLACE (CASE WHEN english THEN issues ELSE list_concat(issues, list_concat("
        f"list_transform(regexp_extract_all(text, '[！!]{{3,}}|[？?]{{3,}}'), lambda x: {repeated}), "
        f"CASE WHEN {unmatched} THEN [{_found('unmatched_chinese_quotes', 'raw', 'raw')}] ELSE {none} END)) END AS issues) FROM kc)"
    )
    return ",\n".join(steps)


def quoted_regex(pattern: str) -> str:
    return "'" + pattern + "'"


# What each finding is worth, spelled out apart from the library so that the comparison can tell.
_ALL_FACTS = """
  ('standalone_page_number', 'web_residue', 'high', 0.95::DOUBLE, 'remove'),
  ('standalone_page_number', 'web_residue', 'medium', 0.6::DOUBLE, 'report'),
  ('empty_dialogue_fragment', 'web_residue', 'high', 0.96::DOUBLE, 'remove'),
  ('isolated_quote_escape', 'web_residue', 'high', 0.97::DOUBLE, 'remove'),
  ('strong_promotion_phrase', 'advertisement', 'high', 0.99::DOUBLE, 'delete'),
  ('promotional_url', 'advertisement', 'high', 0.98::DOUBLE, 'delete'),
  ('url_in_text', 'advertisement', 'medium', 0.62::DOUBLE, 'report'),
  ('multiple_soft_promotion_cues', 'advertisement', 'medium', 0.58::DOUBLE, 'report'),
  ('escaped_quote_artifact', 'punctuation', 'high', 0.96::DOUBLE, 'replace'),
  ('mixed_dash_sequence', 'punctuation', 'high', 0.94::DOUBLE, 'replace'),
  ('repeated_cjk_comma', 'punctuation', 'high', 0.98::DOUBLE, 'replace'),
  ('repeated_cjk_period', 'punctuation', 'high', 0.98::DOUBLE, 'replace'),
  ('ascii_comma_in_chinese', 'punctuation', 'high', 0.95::DOUBLE, 'replace'),
  ('ascii_period_in_chinese', 'punctuation', 'high', 0.95::DOUBLE, 'replace'),
  ('ascii_question_in_chinese', 'punctuation', 'high', 0.95::DOUBLE, 'replace'),
  ('ascii_exclamation_in_chinese', 'punctuation', 'high', 0.95::DOUBLE, 'replace'),
  ('ascii_ellipsis_in_chinese', 'punctuation', 'high', 0.93::DOUBLE, 'replace'),
  ('straight_quote_in_chinese', 'punctuation', 'high', 0.9::DOUBLE, 'replace'),
  ('unclosed_dialogue_quote', 'punctuation', 'high', 0.93::DOUBLE, 'replace'),
  ('long_repeated_expression', 'punctuation', 'low', 0.35::DOUBLE, 'report'),
  ('unmatched_chinese_quotes', 'punctuation', 'medium', 0.55::DOUBLE, 'report'),
  ('replacement_character', 'abnormal_character', 'high', 0.99::DOUBLE, 'remove'),
  ('control_or_zero_width_character', 'abnormal_character', 'high', 0.98::DOUBLE, 'remove'),
  ('contextual_traditional_character', 'traditional_character', 'medium', 0.58::DOUBLE, 'report'),
  ('contextual_traditional_character', 'traditional_character', 'high', 0.96::DOUBLE, 'replace'),
  ('contextual_traditional_character', 'traditional_character', 'medium', 0.72::DOUBLE, 'report'),
  ('contextual_traditional_character', 'traditional_character', 'low', 0.35::DOUBLE, 'report'),
  ('user_ad_blacklist', 'advertisement', 'high', 1.0::DOUBLE, 'delete'),
  ('user_ad_blacklist', 'advertisement', 'medium', 0.78::DOUBLE, 'report')
"""

# ---- punctuation -------------------------------------------------------------------------------


@query(
    "paragraphs",
    f"""WITH {sql_paragraphs(sql_lines)}
SELECT book_id, chapter_index, paragraph, n, length(raw) AS chars, md5(raw) AS digest FROM p""",
)
def paragraph_rows(spark, sf):
    rows = paragraphs(line_chapters(spark, sf))
    return rows.select(*KEYS, "n", F.length("raw").alias("chars"), F.md5("raw").alias("digest"))


@query(
    "english_skip",
    f"""WITH {sql_paragraphs(sql_lines)}
SELECT book_id, count(*) AS n, count(*) FILTER ({_IS_ENGLISH}) AS skipped FROM p GROUP BY 1""",
)
def english_skip(spark, sf):
    rows = paragraphs(line_chapters(spark, sf))
    return rows.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_english_or_url(F.col("raw"))).alias("skipped")
    )


def _punctuated(spark, sf):
    states = punctuate(split_paragraphs(F.col("text")))
    rows = unnest(chinese_chapters(spark, sf), ["book_id", "chapter_index"], states, "s", "paragraph")
    return rows.select(*KEYS, "s.*")


@query(
    "punctuation_text",
    f"""WITH {sql_punctuated(sql_chinese)}
SELECT book_id, chapter_index, paragraph, md5(text) AS digest, len(issues) AS issues FROM k""",
)
def punctuation_text(spark, sf):
    return _punctuated(spark, sf).select(*KEYS, F.md5("text").alias("digest"), F.size("issues").alias("issues"))


@query(
    "punctuation_issues",
    f"""WITH {sql_punctuated(sql_chinese)},
i AS (SELECT book_id, chapter_index, paragraph, unnest(issues) AS i, unnest(range(len(issues))) AS seq FROM k),
f(rule, category, confidence, confidence_score, action) AS (VALUES {_ALL_FACTS})
SELECT book_id, rule, confidence, confidence_score, count(*) AS n,
       sum(length(i.original)) AS original_chars, sum(length(i.replacement)) AS replacement_chars,
       sum(seq) AS seq_total, max(md5(i.original || '|' || i.replacement)) AS last_digest
FROM i JOIN f ON f.rule = i.i.rule GROUP BY 1, 2, 3, 4""",
)
def punctuation_issues(spark, sf):
    issues = unnest(_punctuated(spark, sf), ["book_id"], "issues", "i", "seq")
    fact = rb.fact_of(F.col("i"))
    return (
        issues.select(
            "book_id", "seq", "i",
            fact["rule"].alias("rule"), fact["confidence"].alias("confidence"),
            fact["score"].alias("confidence_score"),
        )
        .groupBy("book_id", "rule", "confidence", "confidence_score")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.length("i.original")).alias("original_chars"),
            F.sum(F.length("i.replacement")).alias("replacement_chars"),
            F.sum("seq").alias("seq_total"),
            F.max(F.md5(F.concat("i.original", F.lit("|"), "i.replacement"))).alias("last_digest"),
        )
    )


@query(
    "quote_pairing",
    f"""WITH {sql_paragraphs(sql_chinese)}
SELECT book_id, chapter_index, paragraph, md5({_sql_paired('raw')}) AS paired,
       md5({_sql_closed(f"({_sql_closed('raw', '「', '」')})", '“', '”')}) AS closed FROM p""",
)
def quote_pairing(spark, sf):
    rows = paragraphs(chinese_chapters(spark, sf))
    return rows.select(
        *KEYS, F.md5(paired_quotes(F.col("raw"))).alias("paired"), F.md5(closed_quotes(F.col("raw"))).alias("closed")
    )


# ---- residue and characters --------------------------------------------------------------------

_EDGE = f"""[{WS}\\\\"'']*"""
_RESIDUE = f"""CASE WHEN regexp_matches(s, '^{_EDGE}[0-9]{{1,4}}{_EDGE}$')
    THEN CASE WHEN regexp_extract(s, '[0-9]+')::INT <= 99 AND n >= 3 THEN 'standalone_page_number high'
              ELSE 'standalone_page_number medium' END
  WHEN s LIKE '%…%' AND regexp_matches(s, '^[{WS}「」“”"''….]+$') THEN 'empty_dialogue_fragment high'
  WHEN regexp_matches(s, '[\\\\"'']') AND regexp_matches(s, '^[{WS}\\\\"'']+$') THEN 'isolated_quote_escape high' END"""


@query(
    "residue",
    f"""WITH {sql_paragraphs(sql_words)}, s AS (SELECT *, {sql_strip('raw')} AS s FROM p),
r AS (SELECT *, {_RESIDUE} AS hit FROM s)
SELECT book_id, chapter_index, paragraph, split_part(hit, ' ', 1) AS rule, split_part(hit, ' ', 2) AS confidence,
       s AS original FROM r WHERE hit IS NOT NULL""",
)
def residue(spark, sf):
    rows = paragraphs(word_chapters(spark, sf)).withColumn("i", residue_issue(F.col("raw"), F.col("n")))
    fact = rb.fact_of(F.col("i"))
    return rows.filter("i is not null").select(
        *KEYS, fact["rule"].alias("rule"), fact["confidence"].alias("confidence"), F.col("i.original").alias("original")
    )


_DAMAGED = r"[\x{fffd}\x{200b}-\x{200d}\x{feff}\x00-\x08\x0b\x0c\x0e-\x1f]"


@query(
    "abnormal_chars",
    f"""WITH {sql_paragraphs(sql_chinese)},
h AS (SELECT book_id, chapter_index, paragraph, regexp_extract_all(raw, '{_DAMAGED}') AS hits, raw FROM p)
SELECT book_id, chapter_index, paragraph, len(hits) AS n,
       len(list_filter(hits, lambda x: x = chr(65533))) AS replacement_characters,
       md5(regexp_replace(raw, '{_DAMAGED}', '', 'g')) AS repaired FROM h WHERE len(hits) > 0""",
)
def abnormal_chars(spark, sf):
    rows = paragraphs(chinese_chapters(spark, sf)).withColumn("issues", damaged_issues(F.col("raw")))
    lost = F.filter("issues", lambda i: rb.is_fact(i, rb.REPLACEMENT_CHAR))
    return rows.filter(F.size("issues") > 0).select(
        *KEYS,
        F.size("issues").alias("n"),
        F.size(lost).alias("replacement_characters"),
        F.md5(repair(F.col("raw"), F.col("issues"))).alias("repaired"),
    )


# ---- corpus profile ----------------------------------------------------------------------------

_MAP = ", ".join(f"('{k}', '{v}')" for k, v in RULES.traditional.items())
_CHARS = f"""m(old, new) AS (VALUES {_MAP}),
cjk AS (SELECT book_id, chapter_index, regexp_replace(text, '[^{CJK}]+', '', 'g') AS t FROM chapters),
chars AS (SELECT book_id, unnest(string_split(t, '')) AS ch FROM cjk WHERE t <> ''),
bigrams AS (SELECT book_id, unnest(list_transform(range(1, length(t)), lambda i: substring(t, i, 2))) AS bigram FROM cjk),
totals AS (SELECT book_id, count(*) AS cjk_total, count(*) FILTER (ch IN (SELECT old FROM m)) AS traditional_total
           FROM chars GROUP BY 1)"""


def _sql_profile(projection) -> str:
    from inkmill.suite.data import sql_chapters

    return f"{sql_chapters(projection)},\n{_CHARS}"


@query(
    "style_chars",
    f"""WITH {_sql_profile(sql_chinese)}
SELECT book_id, ch, 'simplified' AS kind, count(*) AS n FROM chars WHERE ch IN (SELECT new FROM m) GROUP BY 1, 2
UNION ALL
SELECT book_id, ch, 'traditional' AS kind, count(*) AS n FROM chars WHERE ch IN (SELECT old FROM m) GROUP BY 1, 2""",
)
def style_chars(spark, sf):
    return profile_chars(chinese_chapters(spark, sf), RULES.traditional)


@query(
    "style_bigrams",
    f"WITH {_sql_profile(sql_chinese)} SELECT book_id, bigram, count(*) AS n FROM bigrams GROUP BY 1, 2",
)
def style_bigrams(spark, sf):
    return profile_bigrams(chinese_chapters(spark, sf))


@query(
    "style_ratio",
    f"""WITH {_sql_profile(sql_chinese)}
SELECT book_id, cjk_total, traditional_total,
       round(greatest(0.0, 1.0::DOUBLE - traditional_total::DOUBLE / cjk_total), 9) AS simplified_ratio FROM totals""",
)
def style_ratio(spark, sf):
    return profile_totals(chinese_chapters(spark, sf), RULES.traditional).withColumn(
        "simplified_ratio", F.round("simplified_ratio", 9)
    )


def sql_judged(projection) -> str:
    """CTE ``t``: traditional hits of the punctuated text with the verdict on each."""
    return f"""{sql_punctuated(projection)},
{_CHARS},
counts AS (SELECT book_id, ch, count(*) AS n FROM chars GROUP BY 1, 2),
words AS (SELECT book_id, bigram, count(*) AS n FROM bigrams GROUP BY 1, 2),
spot AS (SELECT book_id, chapter_index, paragraph, text, unnest(string_split(text, '')) AS ch,
               unnest(range(1, length(text) + 1)) AS pos FROM k WHERE text <> ''),
hit AS (SELECT spot.*, m.new, {"length(text) - length(replace(text, ch, ''))"} AS same,
               CASE WHEN pos > 1 THEN substring(text, pos - 1, 1) ELSE '' END AS l,
               CASE WHEN pos < length(text) THEN substring(text, pos + 1, 1) ELSE '' END AS r
        FROM spot JOIN m ON m.old = spot.ch),
ev AS (SELECT hit.*, coalesce(c.n, 0) AS simple,
              (l <> '' AND wl.n IS NOT NULL) OR (r <> '' AND wr.n IS NOT NULL) AS word,
              1.0::DOUBLE - traditional_total::DOUBLE / cjk_total AS ratio
       FROM hit JOIN totals USING (book_id)
       LEFT JOIN counts c ON c.book_id = hit.book_id AND c.ch = hit.new
       LEFT JOIN words wl ON wl.book_id = hit.book_id AND wl.bigram = hit.l || hit.new
       LEFT JOIN words wr ON wr.book_id = hit.book_id AND wr.bigram = hit.new || hit.r),
t AS (SELECT *, CASE WHEN same > 1 THEN 0.58::DOUBLE WHEN word AND simple >= 2 THEN 0.96::DOUBLE
                     WHEN simple >= 5 AND ratio > 0.995 THEN 0.72::DOUBLE ELSE 0.35::DOUBLE END AS score FROM ev)"""


@query(
    "traditional_hits",
    f"""WITH {sql_judged(sql_chinese)}
SELECT book_id, ch AS original, new AS replacement, score::DOUBLE AS confidence_score, count(*) AS n
FROM t GROUP BY 1, 2, 3, 4""",
)
def traditional_hits_query(spark, sf):
    issues = clean(chinese_chapters(spark, sf), _NO_ADS, mode="detect").issues
    return (
        issues.filter("category = 'traditional_character'")
        .groupBy("book_id", "original", "replacement", "confidence_score")
        .agg(F.count(F.lit(1)).alias("n"))
    )


# ---- advertisements ----------------------------------------------------------------------------

_NO_ADS = make_rules({}, [], RULES.traditional)

# Cues in the letters of the documents, for the raw text.
_LATIN = {
    "url_pattern": r"(?:https?://|www\.)[^\s，。！？；：\"'<>]+",
    "domain_pattern": r"\b(?:[a-zA-Z0-9-]+\.)+(?:com|net|org|cc|cn|io|me|top|xyz)(?:/[^\s]*)?",
    "strong_phrases": ["thion.{0,20}and", "Éle.{0,10}que", "(?:der|die).{0,5}ver", "hain"],
    "promo_cues": ["ation", "que", "sch", "ment", "@"],
    "soft_cues": ["on", "er", "th", "que", "ich", "en"],
}
LATIN_RULES = make_rules(_LATIN, ["zent", "ouèl"], {})


def _contains_any(terms, c="s"):
    return "(" + " OR ".join(f"contains({c}, {quoted(t)})" for t in terms) + ")"


_W = r"\p{L}\p{N}_"
# A hit begins at a letter or digit that follows no word character.
_DOMAIN = (
    rf"(?:^|[^{_W}])([a-zA-Z0-9][a-zA-Z0-9-]*(?:\.[a-zA-Z0-9-]+)*\.(?:com|net|org|cc|cn|io|me|top|xyz)(?:/[^{WS}]*)?)"
)
_URL_RE = r"(?:https?://|www\.)[^" + WS + "，。！？；：\"''<>]+"
_STRONG = " ".join(
    f"WHEN regexp_matches(s, {quoted(p)}) THEN regexp_extract(s, {quoted(p)})" for p in _LATIN["strong_phrases"]
)
_ADS = f"""a0 AS (SELECT *, {sql_strip('raw')} AS s FROM p),
a1 AS (SELECT *, regexp_extract_all(s, '{_URL_RE}') AS urls,
         regexp_extract_all(s, '{_DOMAIN}', 1) AS domains
       FROM a0),
a2 AS (SELECT *, list_concat(urls, domains) AS links, CASE {_STRONG} END AS phrase FROM a1),
a3 AS (SELECT *, length(regexp_replace(list_reduce(list_prepend(s, links), lambda acc, x: replace(acc, x, '')),
         '[{WS}，。！？；：、（）()【】\\[\\]<>《》"'']+', '', 'g')) <= 8 AS mostly FROM a2),
a AS (SELECT *, CASE WHEN {_contains_any(LATIN_RULES.whitelist)} THEN NULL
  WHEN phrase <> '' THEN 'strong_promotion_phrase'
  WHEN len(links) > 0 THEN CASE WHEN length(s) <= 320 AND ({_contains_any(LATIN_RULES.promo_cues)} OR len(links) >= 2 OR mostly)
                           THEN 'promotional_url' ELSE 'url_in_text' END
  WHEN {" + ".join(f"contains(s, {quoted(c)})::INT" for c in LATIN_RULES.soft_cues)} >= 3 AND length(s) <= 220
    THEN 'multiple_soft_promotion_cues' END AS rule FROM a3)"""


@query(
    "ad_rules",
    f"""WITH {sql_paragraphs(sql_lines)},
{_ADS}
SELECT book_id, chapter_index, paragraph, rule,
       md5(CASE WHEN rule = 'strong_promotion_phrase' THEN phrase ELSE s END) AS original FROM a WHERE rule IS NOT NULL""",
)
def ad_rules(spark, sf):
    rows = paragraphs(line_chapters(spark, sf)).withColumn("i", ad_issue(F.col("raw"), LATIN_RULES))
    return rows.filter("i is not null").select(
        *KEYS, rb.fact_of(F.col("i"))["rule"].alias("rule"), F.md5("i.original").alias("original")
    )


@query(
    "ad_soft",
    f"""WITH {sql_paragraphs(sql_lines)}
SELECT book_id, {" + ".join(f"contains(raw, {quoted(c)})::INT" for c in LATIN_RULES.soft_cues)} AS cues, count(*) AS n
FROM p GROUP BY 1, 2""",
)
def ad_soft(spark, sf):
    rows = paragraphs(line_chapters(spark, sf))
    return rows.groupBy("book_id", soft_cue_count(F.col("raw"), LATIN_RULES).alias("cues")).agg(
        F.count(F.lit(1)).alias("n")
    )


# ---- the clean plan ----------------------------------------------------------------------------

def sql_issues(projection) -> str:
    """CTE ``issue``: every finding in detect mode, rules without advertisements and residue included."""
    return f"""{sql_judged(projection)},
fact(rule, category, confidence, confidence_score, action) AS (VALUES {_ALL_FACTS}),
res AS (SELECT *, {_RESIDUE} AS hit FROM (SELECT *, {sql_strip('raw')} AS s FROM p)),
found AS (
  SELECT book_id, chapter_index, paragraph, split_part(hit, ' ', 1) AS rule, split_part(hit, ' ', 2) AS confidence,
         NULL::DOUBLE AS score FROM res WHERE hit IS NOT NULL
  UNION ALL
  SELECT book_id, chapter_index, paragraph, i.rule, NULL, NULL
  FROM (SELECT book_id, chapter_index, paragraph, unnest(issues) AS i FROM k)
  UNION ALL
  SELECT book_id, chapter_index, paragraph, CASE WHEN c = chr(65533) THEN 'replacement_character'
         ELSE 'control_or_zero_width_character' END, NULL, NULL
  FROM (SELECT book_id, chapter_index, paragraph, unnest(regexp_extract_all(text, '{_DAMAGED}')) AS c FROM k)
  UNION ALL
  SELECT book_id, chapter_index, paragraph, 'contextual_traditional_character', NULL, score FROM t),
issue AS (SELECT found.book_id, chapter_index, paragraph, found.rule, f.category, f.confidence, f.confidence_score,
       f.confidence = 'high' AND f.action IN ('delete', 'remove', 'replace') AS may_apply
  FROM found JOIN fact f ON f.rule = found.rule
    AND (found.confidence IS NULL OR found.confidence = f.confidence)
    AND (found.score IS NULL OR found.score = f.confidence_score))"""


def _detected(spark, sf):
    return clean(chinese_chapters(spark, sf), _NO_ADS, mode="detect")


@query(
    "issue_counts",
    f"""WITH {sql_issues(sql_chinese)}
SELECT book_id, category, rule, confidence, count(*) AS n FROM issue GROUP BY 1, 2, 3, 4""",
)
def issue_counts(spark, sf):
    return rule_counts(_detected(spark, sf).issues)


@query(
    "category_counts",
    f"WITH {sql_issues(sql_chinese)} SELECT book_id, category, count(*) AS n FROM issue GROUP BY 1, 2",
)
def category_counts_query(spark, sf):
    return category_counts(_detected(spark, sf).issues)


@query(
    "chapter_issue_totals",
    f"""WITH {sql_issues(sql_chinese)}
SELECT book_id, chapter_index, count(*) AS total, count(*) FILTER (category = 'punctuation') AS punctuation,
       count(*) FILTER (category = 'advertisement') AS advertisement,
       count(*) FILTER (category NOT IN ('punctuation', 'advertisement')) AS other FROM issue GROUP BY 1, 2""",
)
def chapter_issue_totals_query(spark, sf):
    return chapter_issue_totals(_detected(spark, sf).issues)


def sql_auto(projection) -> str:
    """CTE ``final``: chapters as auto mode leaves them, and ``done``: the findings it lists."""
    return f"""{sql_issues(projection)},
gone AS (SELECT DISTINCT book_id, chapter_index, paragraph FROM issue WHERE category = 'web_residue' AND may_apply),
done AS (SELECT * FROM issue WHERE category = 'web_residue'
         UNION ALL SELECT * FROM issue ANTI JOIN gone USING (book_id, chapter_index, paragraph)
                   WHERE category <> 'web_residue'),
fixes AS (SELECT book_id, chapter_index, paragraph, list(ch || new) AS fix FROM t WHERE score = 0.96::DOUBLE GROUP BY 1, 2, 3),
outs AS (SELECT k.book_id, k.chapter_index, k.paragraph, k.raw, CASE WHEN gone.book_id IS NOT NULL THEN ''
           ELSE list_reduce(list_prepend(regexp_replace(k.text, '{_DAMAGED}', '', 'g'), coalesce(fix, [])),
                            lambda acc, x: replace(acc, left(x, 1), right(x, 1))) END AS result
         FROM k LEFT JOIN gone USING (book_id, chapter_index, paragraph)
                LEFT JOIN fixes USING (book_id, chapter_index, paragraph)),
joined AS (SELECT book_id, chapter_index, bool_or(result <> raw) AS touched,
             {sql_strip("coalesce(string_agg(result, chr(10) || chr(10) ORDER BY paragraph) FILTER (result <> ''), '')")} AS body
           FROM outs GROUP BY 1, 2),
applied AS (SELECT book_id, chapter_index, count(*) FILTER (may_apply) AS applied_count FROM done GROUP BY 1, 2),
final AS (SELECT c.book_id, c.chapter_index, c.title, c.text AS original_text,
            CASE WHEN touched THEN body ELSE c.text END AS cleaned_text,
            coalesce(applied_count, 0) AS applied_count
          FROM chapters c LEFT JOIN joined USING (book_id, chapter_index) LEFT JOIN applied USING (book_id, chapter_index))"""


_SUMMARY = """SELECT book_id, chapter_index, md5(cleaned_text) AS digest, cleaned_text <> original_text AS changed,
       applied_count FROM final"""


def _cleaned(chapters):
    done = clean(chapters, _NO_ADS, mode="auto").chapters
    return done.select(
        "book_id", "chapter_index", F.md5("cleaned_text").alias("digest"), "changed", "applied_count"
    )


@query("clean_auto", f"WITH {sql_auto(sql_chinese)} {_SUMMARY}")
def clean_auto(spark, sf):
    return _cleaned(chinese_chapters(spark, sf))


@query("clean_auto_words", f"WITH {sql_auto(sql_words)} {_SUMMARY}")
def clean_auto_words(spark, sf):
    return _cleaned(word_chapters(spark, sf))


@query(
    "clean_detect",
    f"""WITH {sql_issues(sql_words)}
SELECT c.book_id, c.chapter_index, md5(c.text) AS digest, count(i.rule) AS issues
FROM chapters c LEFT JOIN issue i USING (book_id, chapter_index) GROUP BY 1, 2, 3""",
)
def clean_detect(spark, sf):
    judged = judge(word_chapters(spark, sf), _NO_ADS, mode="detect")
    count = F.aggregate("paragraphs", F.lit(0).cast("bigint"), lambda n, p: n + F.size(p["issues"]))
    return judged.select("book_id", "chapter_index", F.md5("text").alias("digest"), count.alias("issues"))


@query(
    "confidence_counts",
    f"""WITH {sql_auto(sql_words)}
SELECT book_id, confidence, count(*) AS n, count(*) FILTER (may_apply) AS applied FROM done GROUP BY 1, 2""",
)
def confidence_counts_query(spark, sf):
    return confidence_counts(clean(word_chapters(spark, sf), _NO_ADS, mode="auto").issues)


@query(
    "chapter_summary",
    f"""WITH {sql_auto(sql_words)}
SELECT book_id, chapter_index, title, NULL::VARCHAR AS source_path, cleaned_text <> original_text AS changed,
       applied_count FROM final""",
)
def chapter_summary_query(spark, sf):
    return chapter_summary(clean(word_chapters(spark, sf), _NO_ADS, mode="auto").chapters)


_HEAD = ["'小说内容检测报告'", f"'{'=' * 24}'", "'处理模式：auto'", "'章节数量：' || chapters", "'问题总数：' || total",
         "'自动修改：' || applied", "''", "'分类统计：'"]


@query(
    "report_lines",
    f"""WITH {sql_auto(sql_words)},
tot AS (SELECT c.book_id, c.chapters, coalesce(total, 0) AS total, coalesce(applied, 0) AS applied
        FROM (SELECT book_id, count(*) AS chapters FROM chapters GROUP BY 1) c
        LEFT JOIN (SELECT book_id, count(*) AS total, count(*) FILTER (may_apply) AS applied FROM done GROUP BY 1) USING (book_id))
{" UNION ALL ".join(f"SELECT book_id, 'a0{i}' AS place, {line} AS line FROM tot" for i, line in enumerate(_HEAD))}
UNION ALL SELECT book_id, 'b' || category, '  ' || category || ': ' || count(*) FROM done GROUP BY book_id, category
UNION ALL SELECT book_id, 'c00', '' FROM tot UNION ALL SELECT book_id, 'c01', '置信度统计：' FROM tot
UNION ALL SELECT book_id, 'd' || confidence, '  ' || confidence || ': ' || count(*) FROM done GROUP BY book_id, confidence""",
)
def report_lines_query(spark, sf):
    done = tallied(judge(word_chapters(spark, sf), _NO_ADS, mode="auto"), "auto")
    return report_lines(done.chapters, done.issues, "auto")


# ---- blacklist ---------------------------------------------------------------------------------


def blacklist(spark, sf):
    raw = table(spark, sf, "benchmark")
    return read_entries(raw.select(F.col("item_id").alias("id"), "text", F.col("item_id").alias("ordinal")))


def _sql_norm(c: str) -> str:
    return f"lower(regexp_replace(regexp_replace({c}, '<[^>]+>', '', 'g'), '[^\\p{{L}}\\p{{N}}]+', '', 'g'))"


@query("blacklist_match")
def blacklist_match(spark, sf):
    """All methods; the sequence ratio has no SQL form and is tested against brute force."""
    return paragraph_matches(line_chapters(spark, sf), blacklist(spark, sf))


@query(
    "blacklist_contains",
    f"""WITH {sql_paragraphs(sql_lines)}, e AS (SELECT item_id, {_sql_norm('text')} AS en FROM benchmark),
q AS (SELECT book_id, chapter_index, paragraph, {_sql_norm('raw')} AS norm FROM p)
SELECT book_id, chapter_index, paragraph, min(item_id)::VARCHAR AS entry_id, 1.0::DOUBLE AS score
FROM q JOIN e ON contains(norm, en) WHERE length(norm) >= 6 AND length(en) >= 6 GROUP BY 1, 2, 3""",
)
def blacklist_contains(spark, sf):
    found = paragraph_matches(line_chapters(spark, sf), blacklist(spark, sf))
    return found.filter("method = 'contains'").select(*KEYS, "entry_id", "score")


# Next to all lines, every entry in four shapes: shortened, without some letters, between other words, and cut in two.
_SHAPES = "left({t}, (length({t}) * 9 // 10)::INT)", "replace({t}, 'th', '')", "'zzz ' || {t} || ' qqq'", "left({t}, (length({t}) // 2)::INT)"
_SQL_SHAPES = f"""shaped AS (SELECT book_id, chapter_index, paragraph, {_sql_norm('raw')} AS norm FROM p
  UNION ALL SELECT 'shapes', item_id, paragraph, {_sql_norm('raw')} FROM (SELECT item_id,
    unnest([{", ".join(x.format(t="text") for x in _SHAPES)}]) AS raw, unnest(range(4)) AS paragraph FROM benchmark)),
e AS (SELECT min(item_id) AS item_id, en FROM (SELECT item_id, {_sql_norm('text')} AS en FROM benchmark) WHERE length(en) >= 6 GROUP BY en),
q AS (SELECT DISTINCT norm FROM shaped WHERE length(norm) >= 6),
held AS (SELECT norm, item_id, en, length(norm) AS a, length(en) AS b, CASE WHEN contains(norm, en) THEN 'contains'
    WHEN contains(en, norm) AND length(norm) >= length(en) * 0.65 THEN 'contained'
    WHEN least(length(norm), length(en)) >= 10 AND least(length(norm), length(en)) / greatest(length(norm), length(en)) >= 0.35
      THEN 'fuzzy' END AS method FROM q, e),
grams AS (SELECT DISTINCT t, unnest(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) AS g
          FROM (SELECT norm AS t FROM q UNION SELECT en FROM e)),
counts AS (SELECT t, count(*) AS n FROM grams GROUP BY t),
met AS (SELECT x.t AS norm, y.t AS en, count(*) AS k FROM grams x JOIN grams y ON x.g = y.g
        WHERE x.t IN (SELECT norm FROM q) AND y.t IN (SELECT en FROM e) GROUP BY 1, 2),
every AS (SELECT h.norm, item_id, method, CASE method WHEN 'contains' THEN 1.0::DOUBLE WHEN 'contained' THEN a::DOUBLE / b
    ELSE 2 * k::DOUBLE / (cx.n + cy.n) END AS score
  FROM held h LEFT JOIN met USING (norm, en) LEFT JOIN counts cx ON cx.t = h.norm LEFT JOIN counts cy ON cy.t = h.en
  WHERE method IS NOT NULL),
found AS (SELECT * FROM every WHERE score >= 0.78)"""


def _shaped(spark, sf):
    """Normalised paragraphs: all lines, and the shapes of the entries."""
    text = F.col("text")
    shapes = F.array(
        F.expr("left(text, cast(length(text) * 9 div 10 AS int))"), F.replace(text, F.lit("th"), F.lit("")),
        F.concat(F.lit("zzz "), text, F.lit(" qqq")), F.expr("left(text, cast(length(text) div 2 AS int))"),
    )
    chapters = table(spark, sf, "benchmark").select(
        F.lit("shapes").alias("book_id"), F.col("item_id").alias("chapter_index"), F.array_join(shapes, "\n\n").alias("text")
    )
    lines = line_chapters(spark, sf).select("book_id", "chapter_index", "text")
    return normalized_paragraphs(lines.unionByName(chapters))


def _shape_matches(spark, sf, method):
    found = all_matches(_shaped(spark, sf), blacklist(spark, sf), sequence=False).filter(F.col("method") == method)
    return found.select(F.md5("norm").alias("digest"), "entry_id", F.round("score", 9).alias("score"))


_SQL_MATCHES = "SELECT md5(norm) AS digest, item_id::VARCHAR AS entry_id, round(score, 9) AS score FROM found WHERE method = "


@query("blacklist_contained", f"WITH {sql_paragraphs(sql_lines)}, {_SQL_SHAPES} {_SQL_MATCHES}'contained'")
def blacklist_contained(spark, sf):
    """Every text that lies inside an entry and is most of it."""
    return _shape_matches(spark, sf, "contained")


@query("blacklist_dice", f"WITH {sql_paragraphs(sql_lines)}, {_SQL_SHAPES} {_SQL_MATCHES}'fuzzy'")
def blacklist_dice(spark, sf):
    """Every text and entry whose trigrams overlap enough."""
    return _shape_matches(spark, sf, "fuzzy")


@query(
    "blacklist_best",
    f"""WITH {sql_paragraphs(sql_lines)}, {_SQL_SHAPES}
SELECT md5(norm) AS digest, item_id::VARCHAR AS entry_id, round(score, 9) AS score, method
FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY score DESC, item_id) AS nth FROM found) WHERE nth = 1""",
)
def blacklist_best(spark, sf):
    """The best entry of every text, by containment and trigrams; the sequence ratio has no SQL form."""
    found = best_matches(_shaped(spark, sf).select("norm"), blacklist(spark, sf), sequence=False)
    return found.select(F.md5("norm").alias("digest"), "entry_id", F.round("score", 9).alias("score"), "method")


@query(
    "blacklist_entries",
    f"""WITH n AS (SELECT item_id, text, {_sql_norm('text')} AS norm FROM benchmark
  UNION ALL SELECT 100000 + doc_id, left(text, length(text)), {_sql_norm('text')} FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY item_id) AS rn FROM n WHERE length(norm) >= 6)
SELECT left(sha256(norm), 16) AS id, md5(norm) AS norm_digest FROM k WHERE rn = 1""",
)
def blacklist_entries(spark, sf):
    """Every benchmark passage and every document added to an empty list."""
    texts = table(spark, sf, "benchmark").select("text", F.col("item_id").alias("ordinal")).unionByName(
        table(spark, sf, "documents").select("text", (F.col("doc_id") + 100000).alias("ordinal"))
    )
    empty = texts.limit(0).select(
        F.lit("").alias("id"), "text", F.lit("").alias("norm"), "ordinal", F.lit("").alias("created_at")
    )
    added = add_entries(empty, texts.withColumn("created_at", F.lit(None).cast("string")))
    return added.entries.select("id", F.md5("norm").alias("norm_digest"))


@query("clean_with_blacklist")
def clean_with_blacklist(spark, sf):
    """Auto mode on the raw lines with the blacklist and Latin cues."""
    done = clean(line_chapters(spark, sf), LATIN_RULES, blacklist(spark, sf), mode="auto")
    return rule_counts(done.issues)
