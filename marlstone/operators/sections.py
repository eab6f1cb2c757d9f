"""Sections of books: headings by size or capitals, paragraphs between them, short sections merged in reading order, page roles.

Lines have book, page, position, size and text. Windows and aggregates do the work; only the merge depends on what was
merged before, and it folds over four numbers a section, so no text is gathered until the groups are known.
Null texts are no lines; a book without paragraphs has no section.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.partitions import boilerplate

#: Bounds of headings and of meaningful text, titles that only lead elsewhere, words of front matter.
SIZE_RATIO, HEADING_CHARS, HEADING_WORDS = 1.12, 95, 14
PAGE_NUMBER = r"(?i)^\s*(?:page\s*)?[ivxlcdm\d]{1,6}\s*$"
DOT_LEADERS = r"(?:[.\x{00b7}\x{2022}\x{2026}\x{fffd}]\s*){4,}"
ALNUM_RATIO = 0.55
MERGE_PAGES = 2
NAVIGATION_TITLES = ("table of contents", "table of content", "contents", "index")
FRONT_WORDS = ("table of contents", "copyright", "isbn")
FRONT_PAGES = 5

#: Sections of fewer characters take the next one in.
SECTION_CHARS = 600
_BLOCK = 256


def body_sizes(lines: DataFrame) -> DataFrame:
    """book, body_size: the size, rounded to a tenth, of most characters; of equal ones the smaller."""
    each = lines.groupBy("book", F.round("size", 1).alias("size")).agg(F.sum(F.length("text")).alias("n"))
    return each.groupBy("book").agg(F.max_by("size", F.struct("n", -F.col("size"))).alias("body_size"))


def heading(text: Column, size: Column, body: Column) -> Column:
    """Short, no page number, not the end of a sentence, and larger than the body or in capitals."""
    letters = F.regexp_replace(text, r"[^\p{L}]", "")
    capitals = (F.length(letters) >= 2) & ~letters.rlike(r"[^\p{Lu}]")
    short = F.length(text).between(3, HEADING_CHARS) & (F.size(F.split(F.trim(text), r"\s+")) <= HEADING_WORDS)
    stands = ~text.rlike(PAGE_NUMBER) & ~text.rlike(r"[.!?,;]$") & (letters != "")
    return short & stands & (((body > 0) & (size >= body * SIZE_RATIO)) | capitals)


def meaningful(text: Column) -> Column:
    """At least three characters, mostly letters and digits, without dot leaders, and no short boilerplate."""
    dense = F.regexp_replace(text, r"\s", "")
    kept = F.length(F.regexp_replace(dense, r"[^\p{L}\p{N}]", ""))
    return (F.length(F.trim(text)) >= 3) & ~text.rlike(DOT_LEADERS) & (kept >= ALNUM_RATIO * F.length(dense)) & ~((F.length(text) < 400) & boilerplate(text))


def page_role(text: Column, page: Column) -> Column:
    """front_matter, credits or curriculum."""
    head = F.lower(F.substring(text, 1, 800))
    named = head.contains(FRONT_WORDS[0]) | head.contains(FRONT_WORDS[1]) | head.contains(FRONT_WORDS[2])
    front = (page <= FRONT_PAGES) & named & (boilerplate(F.substring(text, 1, 900)) | (F.length(text) < 250))
    return F.when((F.length(text) < 80) | front, "front_matter").when(boilerplate(text) & (F.length(text) < 900), "credits").otherwise("curriculum")


def raw_sections(lines: DataFrame) -> DataFrame:
    """book, n, title, paragraphs, chars, lo, hi: what stands between two headings; empty ones are left out."""
    head = F.col("is_heading")
    marked = lines.where(F.col("text").isNotNull()).join(body_sizes(lines), "book").withColumn("is_heading", heading(F.col("text"), F.col("size"), F.col("body_size")))
    numbered = marked.where(head | meaningful(F.col("text"))).withColumn("n", F.sum(head.cast("int")).over(Window.partitionBy("book").orderBy("page", "position")))
    body = lambda c: F.when(~head, c)
    return numbered.groupBy("book", "n").agg(
        F.max(F.when(head, F.col("text"))).alias("title"),
        F.transform(F.sort_array(F.collect_list(body(F.struct("page", "position", "text")))), lambda p: p["text"]).alias("paragraphs"),
        F.sum(body(F.length("text"))).alias("chars"),
        F.min(body(F.col("page"))).alias("lo"),
        F.max(body(F.col("page"))).alias("hi"),
    ).where(F.size("paragraphs") > 0)


def merge_groups(sections: Column, least: int) -> Column:
    """For each (n, chars, lo, hi, extra) in order the number of its merged section.

    A section joins the one before while that is short and both together span few pages; its title then counts as a paragraph.
    The numbers grow in blocks, as each append copies its array.
    """

    def step(s: Column, x: Column) -> Column:
        lo, hi = F.least(s["lo"], x["lo"]), F.greatest(s["hi"], x["hi"])
        join = (s["g"] >= 0) & (s["chars"] < least) & (hi - lo <= MERGE_PAGES)
        return F.struct(
            F.when(join, s["g"]).otherwise(s["g"] + 1).alias("g"),
            F.when(join, s["chars"] + x["extra"] + x["chars"]).otherwise(x["chars"]).alias("chars"),
            F.when(join, lo).otherwise(x["lo"]).alias("lo"),
            F.when(join, hi).otherwise(x["hi"]).alias("hi"),
        )

    def inside(s: Column, i: Column) -> Column:
        some = F.slice(sections, i * _BLOCK + 1, F.lit(_BLOCK))
        return F.aggregate(some, F.array(s), lambda out, x: F.concat(out, F.array(step(F.element_at(out, -1), x))))

    zero = F.struct(F.lit(-1).alias("g"), F.lit(0).cast("long").alias("chars"), F.lit(0).alias("lo"), F.lit(0).alias("hi"))
    blocks = F.sequence(F.lit(0), F.floor((F.size(sections) - 1) / _BLOCK).cast("int"))
    states = F.aggregate(blocks, F.array(F.array(zero)), lambda out, i: F.concat(out, F.array(inside(F.element_at(F.element_at(out, -1), -1), i))))
    # every block but the first, which is the start alone, begins with the state it got
    return F.flatten(F.transform(F.slice(states, 2, F.size(blocks)), lambda b: F.transform(F.slice(b, 2, F.lit(_BLOCK)), lambda s: s["g"])))


def sections(lines: DataFrame, least: int = SECTION_CHARS) -> DataFrame:
    """book, section_index, title, from_document, page_start, page_end, n_paragraphs, n_chars, text.

    Untitled beginnings get a title of the book, sections that only lead elsewhere are left out, and the rest is numbered from 0.
    """
    raw = raw_sections(lines)
    extra = F.coalesce(F.length("title"), F.lit(0)).alias("extra")
    digests = raw.groupBy("book").agg(F.sort_array(F.collect_list(F.struct("n", "chars", "lo", "hi", extra))).alias("s"))
    groups = digests.select("book", F.explode(F.arrays_zip(F.col("s.n").alias("n"), merge_groups(F.col("s"), least).alias("g"))).alias("m")).select("book", "m.n", "m.g")
    first = F.col("n") == F.min("n").over(Window.partitionBy("book", "g"))
    kept = raw.join(groups, ["book", "n"]).withColumn("own", first)
    whole = kept.withColumn("paragraphs", F.when(F.col("own") | F.col("title").isNull(), F.col("paragraphs")).otherwise(F.concat(F.array("title"), "paragraphs")))
    merged = whole.groupBy("book", "g").agg(
        F.max(F.when(F.col("own"), F.col("title"))).alias("given"),
        F.min("lo").alias("page_start"),
        F.max("hi").alias("page_end"),
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("n", "paragraphs"))), lambda x: x["paragraphs"])).alias("p"),
    )
    title = F.coalesce("given", F.format_string("book %d (front matter)", "book"))
    index = (F.row_number().over(Window.partitionBy("book").orderBy("g")) - 1).alias("section_index")
    return merged.withColumn("title", title).where(~F.lower(F.trim("title")).isin(*NAVIGATION_TITLES)).select(
        "book", index, "title", F.col("given").isNotNull().alias("from_document"), "page_start", "page_end", F.size("p").alias("n_paragraphs"),
        F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("n_chars"), F.array_join("p", "\n\n").alias("text"),
    )
