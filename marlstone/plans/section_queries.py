"""Queries on books of pages: body sizes, headings, sections, page roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import sections as sc
from marlstone.plans.queries import _BLOCKS, _BOILER, query
from marlstone.sources import corpus

#: Pages in a book, and sizes of the text of each tag.
BOOK_PAGES = 16
SIZES = {"h1": 24.0, "h2": 18.0, "h3": 14.0, "caption": 10.0, "figcaption": 10.0}
PLAIN_SIZE = 12.0


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of all pages with book, page, position, size, text; pages without an id are in no book."""
    size = F.lit(PLAIN_SIZE)
    for tag, n in SIZES.items():
        size = F.when(F.col("tag") == tag, n).otherwise(size)
    book, page = F.floor(F.col("page_id") / BOOK_PAGES), (F.col("page_id") % BOOK_PAGES + 1).cast("int")
    return corpus.html_blocks(spark, sf_dir).where("page_id IS NOT NULL").select(book.alias("book"), page.alias("page"), "position", size.alias("size"), "text")


_CASES = " ".join(f"WHEN '{tag}' THEN {n}" for tag, n in SIZES.items())
_LINES = f"""{_BLOCKS},
lined AS (SELECT page_id // {BOOK_PAGES} AS book, CAST(page_id % {BOOK_PAGES} + 1 AS INT) AS page, position, CASE tag {_CASES} ELSE {PLAIN_SIZE} END AS size, text FROM blocks),
sized AS (SELECT book, arg_max(size, {{n: n, s: -size}}) AS body_size FROM (SELECT book, size, sum(length(text)) AS n FROM lined GROUP BY ALL) GROUP BY book)""".replace("{{", "{").replace("}}", "}")
_LETTERS = r"regexp_replace(text, '[^\p{L}]', '', 'g')"
_HEADING = rf"""(length(text) BETWEEN 3 AND {sc.HEADING_CHARS} AND len(regexp_split_to_array(trim(text), '\s+')) <= {sc.HEADING_WORDS} AND NOT regexp_matches(text, '{sc.PAGE_NUMBER}')
  AND NOT regexp_matches(text, '[.!?,;]$') AND {_LETTERS} <> '' AND (size >= body_size * {sc.SIZE_RATIO}::DOUBLE OR (length({_LETTERS}) >= 2 AND NOT regexp_matches({_LETTERS}, '[^\p{{Lu}}]'))))"""
_DENSE = r"regexp_replace(text, '\s', '', 'g')"
_MEANS = rf"""(length(trim(text)) >= 3 AND NOT regexp_matches(text, '{sc.DOT_LEADERS}')
  AND length(regexp_replace({_DENSE}, '[^\p{{L}}\p{{N}}]', '', 'g')) >= {sc.ALNUM_RATIO}::DOUBLE * length({_DENSE}) AND NOT (length(text) < 400 AND {_BOILER}))"""
_RAW = f"""{_LINES},
marks AS (SELECT *, {_HEADING} AS head FROM lined JOIN sized USING (book)),
counted AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY book ORDER BY page, position) AS n FROM marks WHERE head OR {_MEANS}),
raws AS (SELECT book, n, max(text) FILTER (head) AS title, count(*) FILTER (NOT head) AS np, sum(length(text)) FILTER (NOT head) AS chars, min(page) FILTER (NOT head) AS lo,
  max(page) FILTER (NOT head) AS hi FROM counted GROUP BY book, n),
told AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY n) AS k FROM raws WHERE np > 0)"""


@query(f"WITH {_LINES} SELECT book, body_size FROM sized")
def body_font_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.body_sizes(lines(spark, sf_dir))


@query(f"WITH {_LINES} SELECT book, page, position, {_HEADING} AS is_heading, {_MEANS} AS is_meaningful FROM lined JOIN sized USING (book)")
def heading_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    marks = {"is_heading": sc.heading(F.col("text"), F.col("size"), F.col("body_size")), "is_meaningful": sc.meaningful(F.col("text"))}
    return rows.join(sc.body_sizes(rows), "book").withColumns(marks).select("book", "page", "position", *marks)


@query(
    f"""WITH RECURSIVE {_RAW},
    walk AS (
      SELECT book, k, n, title, chars, lo, hi, 0 AS g FROM told WHERE k = 1
      UNION ALL
      SELECT book, k, n, title, CASE WHEN j THEN was + coalesce(length(title), 0) + chars ELSE chars END, CASE WHEN j THEN least(wlo, lo) ELSE lo END,
        CASE WHEN j THEN greatest(whi, hi) ELSE hi END, CASE WHEN j THEN g ELSE g + 1 END
      FROM (SELECT t.*, w.chars AS was, w.lo AS wlo, w.hi AS whi, w.g, w.chars < {sc.SECTION_CHARS} AND greatest(w.hi, t.hi) - least(w.lo, t.lo) <= {sc.MERGE_PAGES} AS j
        FROM walk w JOIN told t ON t.book = w.book AND t.k = w.k + 1)),
    placed AS (SELECT t.*, w.g, t.n = min(t.n) OVER (PARTITION BY t.book, w.g) AS own FROM told t JOIN walk w ON w.book = t.book AND w.k = t.k),
    parts AS (
      SELECT book, g, n, 0 AS o, 0 AS page, 0 AS position, title AS text FROM placed WHERE NOT own AND title IS NOT NULL
      UNION ALL SELECT c.book, p.g, c.n, 1, c.page, c.position, c.text FROM counted c JOIN placed p ON p.book = c.book AND p.n = c.n WHERE NOT c.head),
    texts AS (SELECT book, g, CAST(count(*) AS INT) AS n_paragraphs, CAST(sum(length(text)) AS BIGINT) AS n_chars, md5(string_agg(text, chr(10) || chr(10) ORDER BY n, o, page, position)) AS text_md5
      FROM parts GROUP BY book, g),
    whole AS (SELECT book, g, max(title) FILTER (own) AS given, min(lo) AS page_start, max(hi) AS page_end FROM placed GROUP BY book, g),
    named AS (SELECT *, coalesce(given, 'book ' || book || ' (front matter)') AS title FROM whole JOIN texts USING (book, g))
    SELECT book, CAST(row_number() OVER (PARTITION BY book ORDER BY g) - 1 AS INT) AS section_index, title, given IS NOT NULL AS from_document, page_start, page_end, n_paragraphs, n_chars, text_md5
    FROM named WHERE lower(trim(title)) NOT IN ({", ".join(f"'{t}'" for t in sc.NAVIGATION_TITLES)})"""
)
def book_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.sections(lines(spark, sf_dir)).withColumn("text_md5", F.md5("text")).drop("text")


@query(
    f"""WITH {_LINES}, whole AS (SELECT book, page, string_agg(text, chr(10) ORDER BY position) AS t FROM lined GROUP BY book, page),
    judged AS (SELECT book, page, t, {_BOILER.replace("text", "t")} AS b, {_BOILER.replace("text", "substring(t, 1, 900)")} AS b_head, lower(substring(t, 1, 800)) AS head FROM whole)
    SELECT book, page, CASE WHEN length(t) < 80 OR (page <= {sc.FRONT_PAGES} AND ({" OR ".join(f"contains(head, '{w}')" for w in sc.FRONT_WORDS)}) AND (b_head OR length(t) < 250))
      THEN 'front_matter' WHEN b AND length(t) < 900 THEN 'credits' ELSE 'curriculum' END AS page_role FROM judged"""
)
def page_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = lines(spark, sf_dir).groupBy("book", "page").agg(F.sort_array(F.collect_list(F.struct("position", "text"))).alias("l"))
    text = whole.select("book", "page", F.array_join(F.col("l.text"), "\n").alias("t"))
    return text.select("book", "page", sc.page_role(F.col("t"), F.col("page")).alias("page_role"))
