"""The queries of the corpus operators, and the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.llm.collocations import collocations
from inkmill.llm.common import table
from inkmill.llm.decontam import leaked
from inkmill.llm.dialogue import damaged, repair
from inkmill.llm.exact import exact_groups
from inkmill.llm.extract import main_texts
from inkmill.llm.mixing import by_source, mix, word_count
from inkmill.llm.near import near_groups
from inkmill.llm.phrases import without_phrases
from inkmill.llm.quality import classified
from inkmill.llm.suffixes import without_repeats
from inkmill.llm.tokens import prefix_counts
from inkmill.llm.toxicity import scored
from inkmill.llm.warc import archive_folder, read_archives, write_archives

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


@query(
    "op1_exact_dedup",
    """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
           FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d""",
)
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays for it."""
    return exact_groups(table(spark, sf_dir, "documents"), hash_all=True)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The installed vocabulary file; another can be named."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op9_token_counts")
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document; over the limit above 512."""
    counts = prefix_counts(table(spark, sf_dir, "documents"), tokenizer_path(), steps=False)
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


@query(
    "op6_suffix_dedup",
    """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, s, b[s + 1:s + 100] AS win FROM (SELECT doc_id, b, unnest(range(octet_length(b) - 99)) AS s FROM d)),
late AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY win ORDER BY doc_id, s) AS nth FROM w)
         WHERE nth > 1),
gaps AS (SELECT doc_id, s, max(s) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p
         FROM late),
parts AS (SELECT doc_id, s, sum(CASE WHEN p IS NULL OR s > p + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS k
          FROM gaps),
runs AS (SELECT doc_id, k, min(s) AS a, max(s) + 100 AS z FROM parts GROUP BY doc_id, k),
cuts AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM runs),
kept AS (SELECT c.doc_id, string_agg(hex(b[p + 1:a]), '' ORDER BY a) AS h, max(z) AS z, sum(z - a) AS n, count(*) AS m
         FROM cuts c JOIN d USING (doc_id) GROUP BY c.doc_id)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(m, 0)::BIGINT AS n_spans,
       sha256(CASE WHEN h IS NULL THEN b ELSE unhex(h || hex(b[z + 1:])) END) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
)
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without passages of 100 bytes that occur earlier."""
    return without_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


@query(
    "op10_substring_dedup",
    r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, s, array_to_string(ws[s:s + 34], ' ') AS win
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS s FROM d)),
twice AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY win) AS n FROM w) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, s + o AS i FROM twice, (SELECT unnest(range(35)) AS o)),
ones AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n
         FROM ones ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
)
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without passages of 35 words that occur anywhere else."""
    return without_phrases(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )


@query(
    "op8_warc",
    """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b)::BIGINT AS n, sha1(b) AS h, max(page_id) OVER (PARTITION BY b) AS top FROM p),
v AS (SELECT *, list_transform(range(0, 8), lambda j: ('0x' || substr(h, 5 * j + 1, 5))::BIGINT) AS vs FROM h)
SELECT page_id, n AS payload_bytes,
       list_aggregate(list_transform(vs, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> 15) & 31), 1)
         || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> 10) & 31), 1)
         || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> 5) & 31), 1)
         || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (v & 31), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM v""",
)
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a record and read back from the archives."""
    folder = archive_folder(spark)
    write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op5_mix_sources")
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    docs = table(spark, sf_dir, "documents")
    mixed, plan = mix(docs, F.array("source"), word_count("text"))
    sources = F.broadcast(by_source(plan, spark))  # one row for each source, as the plan has them
    return mixed.join(sources, mixed["sources"][0].eqNullSafe(sources["source"])).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


@query(
    "op3_near_dedup",
    r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) < 2 THEN ws
             ELSE list_sort(list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) END AS sh FROM d),
sets AS (SELECT min(doc_id) AS rep, sh, len(sh) AS n FROM s WHERE len(sh) > 0 GROUP BY sh),
post AS (SELECT rep, n, unnest(sh) AS x FROM sets),
inter AS (SELECT a.rep AS u, b.rep AS v, a.n AS nu, b.n AS nv, count(*) AS k
          FROM post a JOIN post b ON a.x = b.x AND a.rep < b.rep AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
          GROUP BY ALL),
links AS (SELECT u, v FROM inter WHERE 100 * k >= 80 * (nu + nv - k)),
ways AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach AS (SELECT rep AS node, rep AS root FROM sets UNION SELECT w.v, r.root FROM reach r JOIN ways w ON r.node = w.u),
comp AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, coalesce(component_id, s.doc_id) AS component_id,
       s.doc_id = coalesce(component_id, s.doc_id) AS kept
FROM s LEFT JOIN sets ON s.sh = sets.sh LEFT JOIN comp ON sets.rep = comp.node""",
)
def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the component of near duplicates it belongs to."""
    return near_groups(table(spark, sf_dir, "documents"), words=2)


@query("op4_decontaminate")
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items that leak into it."""
    return leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_quality")
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its probabilities of being good and toxic, and whether it stays."""
    return classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_main_text")
def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_texts(table(spark, sf_dir, "pages"))


# CRC-32 as a table of 256 values worked out by its rule: eight shifts of the reversed polynomial.
_CRC = """
steps AS (SELECT i, 0 AS k, i::BIGINT AS c FROM range(256) t(i) UNION ALL
          SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8)"""


def sql_crc32(codes: str) -> str:
    """CRC-32 of a list of byte values, beside the table ``crc``."""
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


@query(
    "op11_conversation_repair",
    rf"""
WITH RECURSIVE {_CRC},
given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
kinds AS (SELECT given.*, {sql_crc32("list_transform(range(1, length(k) + 1), lambda j: ascii(k[j])::BIGINT)")} % 20 AS kind FROM given, crc),
hurt AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
           unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
             left(role, 1) AS x, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed FROM hurt),
judged AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, trimmed = '' AS blank, right(trimmed, 1) NOT IN ('.', '!', '?') AS cut,
             lag(x) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
rows_ AS (SELECT *, NOT (blank OR again) AS stays FROM judged),
told AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
           count(*) FILTER (cut AND stays) AS truncated,
           count(*) FILTER (before IS NOT NULL AND before || x NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY conv_id),
-- What may be put in before the next row: from each state to the next ones, with what is written.
puts(q, q2, cost, audit, lines) AS (VALUES ('-', '-', 0, '', []::VARCHAR[]), ('s', 's', 0, '', []), ('u', 'u', 0, '', []), ('a', 'a', 0, '', []),
  ('-', 'u', 2, 'I', ['user:']), ('s', 'u', 2, 'I', ['user:']), ('a', 'u', 2, 'I', ['user:']), ('u', 'a', 2, 'I', ['assistant:']),
  ('-', 'a', 4, 'II', ['user:', 'assistant:']), ('s', 'a', 4, 'II', ['user:', 'assistant:'])),
edits(q, x, e, cost, q2, name) AS (VALUES
  ('-', 's', 'K', 0, 's', NULL), ('-', 'u', 'K', 0, 'u', NULL), ('s', 'u', 'K', 0, 'u', NULL), ('a', 'u', 'K', 0, 'u', NULL),
  ('u', 'a', 'K', 0, 'a', NULL), ('-', NULL, 'R', 2, 'u', 'user'), ('s', NULL, 'R', 2, 'u', 'user'), ('a', NULL, 'R', 2, 'u', 'user'),
  ('u', NULL, 'R', 2, 'a', 'assistant'), ('-', NULL, 'D', 3, '-', NULL), ('s', NULL, 'D', 3, 's', NULL), ('u', NULL, 'D', 3, 'u', NULL),
  ('a', NULL, 'D', 3, 'a', NULL)),
items AS (
  SELECT conv_id, n, 0::BIGINT AS i, p.q2 AS q, {{'cost': p.cost::BIGINT, 'audit': p.audit, 'lines': p.lines}} AS v
  FROM told, puts p WHERE p.q = '-'
  UNION ALL
  SELECT t.conv_id, t.n, t.i + 1, p.q2, min({{'cost': t.v.cost + e.cost + p.cost + CASE WHEN r.cut AND e.e <> 'D' THEN 1 ELSE 0 END,
      'audit': t.v.audit || e.e || p.audit,
      'lines': list_concat(t.v.lines, CASE WHEN e.e = 'D' THEN [] ELSE [coalesce(e.name, r.role) || ':' || r.text] END, p.lines)}})
  FROM items t JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM t.conv_id AND r.i = t.i + 1
    JOIN edits e ON e.q = t.q AND (e.x IS NULL OR e.x = r.x) AND (r.stays OR e.e = 'D') JOIN puts p ON p.q = e.q2
  GROUP BY t.conv_id, t.n, t.i, p.q2),
best AS (SELECT conv_id, min(v) AS v FROM items WHERE i = n AND q IN ('-', 'a') GROUP BY conv_id),
all_ AS (SELECT DISTINCT conv_id FROM conversations)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(v.cost, 0)::BIGINT AS cost,
  coalesce(v.audit, '') AS audit, sha256(coalesce(array_to_string(v.lines, chr(10)), '')) AS repaired_sha256
FROM all_ a LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM a.conv_id""",
)
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation with its faults and its cheapest repair after damage."""
    return repair(damaged(table(spark, sf_dir, "conversations")))


@query(
    "op12_collocations",
    r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM t),
words AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM pieces),
totals AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM words GROUP BY lang),
grams AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase
          FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM words, range(1, 6) s(m) WHERE len(ws) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
-- A longer phrase never occurs more often, so the counts have to be equal.
hidden AS (SELECT DISTINCT a.lang, a.phrase FROM f a JOIN f b ON a.lang = b.lang AND a.f = b.f AND a.m > 1 AND b.m > a.m
           WHERE contains(' ' || b.phrase || ' ', ' ' || a.phrase || ' ')),
candidates AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f ANTI JOIN hidden USING (lang, phrase) WHERE m > 1),
cuts AS (SELECT c.lang, c.phrase, c.a, k, array_to_string(ws[:k], ' ') AS x, array_to_string(ws[k + 1:], ' ') AS y
         FROM candidates c, range(1, 5) s(k) WHERE k < m),
scored AS (SELECT c.lang, c.phrase, c.a, k, l.f AS l, r.f AS r, n,
             (1000::HUGEINT * c.a * n) // (l.f::HUGEINT * r.f) AS score
           FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = x JOIN f r ON r.lang = c.lang AND r.phrase = y
             JOIN totals t ON t.lang = c.lang),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best WHERE nth = 1)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= 2000""",
)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best collocations of each language."""
    return collocations(table(spark, sf_dir, "documents"))


@query("op13_toxicity")
def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How likely every document is toxic, from its text alone."""
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
