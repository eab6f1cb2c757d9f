"""The document hierarchy built from the given tables: chunks, pages, concepts, HTML blocks."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions.partitions import partition
from marlstone.functions.text import lines
from marlstone.session import spread, table

CHUNK_LINES, PAGE_LINES, SECTION_LINES = 4, 5, 10
#: Tags that open a block.
BLOCK_TAGS = ("h1", "h2", "h3", "h4", "p", "li", "caption", "figcaption")


def with_lineage(docs: DataFrame) -> DataFrame:
    """doc_id gives grade and subject; both and the source give unit and document ids."""
    g = (1 + F.col("doc_id") % 12).cast("int")
    i = F.floor(F.col("doc_id") / 12)
    subject = (
        F.when(g <= 2, "mathematics")
        .when(g <= 10, F.element_at(F.array(F.lit("mathematics"), F.lit("science")), (i % 2 + 1).cast("int")))
        .otherwise(F.element_at(F.array(*[F.lit(x) for x in ("mathematics", "physics", "chemistry", "biology")]), (i % 4 + 1).cast("int")))
    )
    out = docs.withColumns({"grade": g, "subject": subject})
    out = out.withColumn("unit_id", F.concat_ws(":", F.format_string("grade_%02d", "grade"), "subject", "source"))
    return out.withColumns(
        {
            "document_id": F.concat_ws(":", "unit_id", F.lit("student"), F.format_string("doc%06d", "doc_id")),
            "source_role": F.when(F.col("doc_id") % 7 == 0, "support").otherwise("primary"),
        }
    )


def chunks(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """The fact table: the chunks of all documents."""
    return cut(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")), *more)


def cut(docs: DataFrame, *more: str) -> DataFrame:
    """Chunks of four lines each, with lineage, pages, section and position; cut inside each row, without a shuffle. ``more`` may be ``title_before``, the section title of the chunk before."""
    docs = with_lineage(docs).withColumn("_l", lines(F.col("text"))).where(F.size("_l") > 0)
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size("_l") - 1) / CHUNK_LINES).cast("int")), lambda i: F.slice("_l", i * CHUNK_LINES + 1, CHUNK_LINES))
    each = docs.select("*", F.posexplode(pieces).alias("chunk_index", "_c"))
    first = F.col("chunk_index") * CHUNK_LINES
    section = F.floor(first / SECTION_LINES).cast("int")
    title = lambda at: F.substring(F.get("_l", at * SECTION_LINES), 1, 60)
    before = F.when(F.col("chunk_index") > 0, title(F.floor((first - CHUNK_LINES) / SECTION_LINES).cast("int")))
    extra = {"title_before": before}
    return each.select(
        F.concat("document_id", F.format_string(":c%04d", "chunk_index")).alias("chunk_id"),
        "doc_id", "document_id", "unit_id", "grade", "subject", "source", "lang", "source_role", "chunk_index",
        F.concat("document_id", F.format_string(":s%04d", section)).alias("section_id"),
        title(section).alias("section_title"),
        (1 + F.floor(first / PAGE_LINES)).cast("int").alias("page_start"),
        (1 + F.floor((first + F.size("_c") - 1) / PAGE_LINES)).cast("int").alias("page_end"),
        F.array_join("_c", "\n").alias("text"), *[extra[m].alias(m) for m in more],
    )


def with_unit_titles(chunk_rows: DataFrame) -> DataFrame:
    """Chunks with ``unit_title``: the first section title of the unit's first document."""
    first = chunk_rows.groupBy("unit_id").agg(F.min_by("section_title", F.struct("doc_id", "chunk_index")).alias("unit_title"))
    return chunk_rows.join(first, "unit_id")


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with ``content_partition``; the rules also see the title of the chunk before."""
    before = F.lag("section_title").over(Window.partitionBy("doc_id").orderBy("chunk_index"))
    return chunks(spark, sf_dir).withColumn("_before", before).withColumn(
        "content_partition", partition(F.col("section_title"), F.col("text"), F.col("_before"))
    ).drop("_before")


def on_page(chunk_rows: DataFrame) -> DataFrame:
    """chunk_id, page_id: a row for each page a chunk covers."""
    page = F.explode(F.sequence("page_start", "page_end"))
    return chunk_rows.select("chunk_id", "document_id", page.alias("page")).select("chunk_id", F.concat("document_id", F.format_string(":p%04d", "page")).alias("page_id"))


#: Elements that leave no text, and block boundaries in their place where they stand between blocks.
DROPPED = r"(?is)<!--.*?-->|<!doctype[^>]*>|<(script|style)\b[^>]*>.*?</\1\s*>"
NAVIGATION = r"(?is)<nav\b[^>]*>.*?</nav\s*>"
OPENED = rf"(?i)<({'|'.join(BLOCK_TAGS)})(?:\s[^>]*)?>"
CLOSED = rf"(?i)</(?:{'|'.join(BLOCK_TAGS)})\s*>"
ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"
_START, _NAMED = "\u0001", "\u0002"


def decoded(text: Column) -> Column:
    """Character references, named or by number, as their characters; each is read once, and unknown ones stay."""
    names = F.create_map(*[F.lit(x) for name, point in sorted(name2codepoint.items()) for x in (name, chr(point))])

    def one(piece: Column) -> Column:
        name = F.substring(piece, 2, F.length(piece) - 2)
        point = F.when(F.lower(F.substring(name, 1, 2)) == "#x", F.conv(F.substring(name, 3, F.length(name)), 16, 10)).when(name.startswith("#"), F.substring(name, 2, F.length(name)))
        number = point.cast("long")
        legal = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        character = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        return F.when(piece.rlike(f"^{ENTITY}$"), F.coalesce(F.when(legal, character), F.try_element_at(names, name), piece)).otherwise(piece)

    pieces = F.regexp_extract_all(text, F.lit(f"{ENTITY}|[^&]+|&"), F.lit(0))
    return F.when(text.contains("&"), F.array_join(F.transform(pieces, one), "")).otherwise(text)


def blocks(html: Column) -> Column:
    """(tag, text) of a page's blocks in order: inline tags leave their text, text outside blocks is a ``p``, and the last block needs no end tag."""
    bare = F.regexp_replace(F.regexp_replace(F.translate(F.coalesce(html, F.lit("")), _START + _NAMED, ""), DROPPED, ""), NAVIGATION, "</p>")
    marked = F.regexp_replace(F.regexp_replace(bare, OPENED, f"{_START}$1{_NAMED}"), CLOSED, f"{_START}p{_NAMED}")
    # what stands before the first mark is a paragraph as well
    pieces = F.split(F.concat(F.lit(f"p{_NAMED}"), marked), _START)
    text = lambda x: F.trim(F.regexp_replace(decoded(F.regexp_replace(F.substring_index(x, _NAMED, -1), "<[^>]*>", "")), r"\s+", " "))
    return F.filter(F.transform(pieces, lambda x: F.struct(F.lower(F.substring_index(x, _NAMED, 1)).alias("tag"), text(x).alias("text"))), lambda b: b["text"] != "")


def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, position, tag, text: headings, paragraphs, items and captions in page order, each whole; scripts, styles and navigation skipped."""
    each = table(spark, sf_dir, "pages").select("page_id", F.posexplode(blocks(F.col("html"))).alias("position", "b"))
    return each.select("page_id", "position", "b.tag", "b.text")
