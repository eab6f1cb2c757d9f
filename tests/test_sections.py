"""Sections of books, by hand."""

from pyspark.sql import functions as F

from marlstone.operators import sections as sc

SCHEMA = "book long, page int, position int, size double, text string"


def test_headings_and_meaningful_text(spark):
    cases = [
        ("Living things", 14.0, True, True), ("Living things", 13.0, False, True), ("LIVING THINGS", 12.0, True, True), ("A", 20.0, False, False),
        ("page 12", 20.0, False, True), ("xii", 20.0, False, True), ("It is over.", 20.0, False, True), ("1.2", 20.0, False, True), ("----", 20.0, False, False),
        ("w " * 14 + "w", 20.0, False, True), ("x" * 96, 20.0, False, True), ("Chapter 4 . . . . . 32", 12.0, False, False), ("É È", 12.0, True, True), ("", 12.0, False, False),
    ]
    rows = spark.createDataFrame([(t, s) for t, s, *_ in cases], "text string, size double").withColumn("body", F.lit(12.0))
    got = rows.select("text", "size", sc.heading(F.col("text"), F.col("size"), F.col("body")), sc.meaningful(F.col("text"))).collect()
    assert sorted(map(tuple, got)) == sorted(cases)


def test_sections_merge_in_order(spark):
    """Short ones take the next in while both span at most two pages; the title of what was taken in counts as a paragraph."""
    body = "plain words of the body "
    lines = [
        (1, 1, 0, 12.0, body), (1, 1, 1, 20.0, "One"), (1, 1, 2, 12.0, body * 2), (1, 2, 0, 20.0, "Nothing below"), (1, 2, 1, 20.0, "Two"), (1, 3, 0, 12.0, body * 9),
        (1, 4, 0, 20.0, "Three"), (1, 4, 1, 12.0, body), (1, 9, 0, 20.0, "Far away"), (1, 9, 1, 12.0, body * 9), (1, 10, 0, 20.0, "Contents"), (1, 10, 1, 12.0, body * 9),
        (2, 1, 0, 20.0, "HEADING ALONE"), (3, 1, 0, 12.0, None), (None, 1, 0, 12.0, body),
    ]
    got = sc.sections(spark.createDataFrame(lines, SCHEMA), least=150).orderBy("book", "section_index").collect()
    assert [(r["book"], r["section_index"], r["title"], r["from_document"], r["page_start"], r["page_end"], r["n_paragraphs"]) for r in got] == [
        (1, 0, "book 1 (front matter)", False, 1, 3, 5), (1, 1, "Three", True, 4, 4, 1), (1, 2, "Far away", True, 9, 9, 1),
    ]
    assert got[0]["text"] == "\n\n".join([body, "One", body * 2, "Two", body * 9]) and got[0]["n_chars"] == len(body) * 12 + 6


def test_long_books_keep_their_groups(spark):
    """As many sections as fill several blocks of the fold, against a plain loop."""
    sizes = [(i * 37) % 90 + 1 for i in range(1000)]
    rows = spark.createDataFrame([([(i, c, i // 7, i // 7, 3) for i, c in enumerate(sizes)],)], "s array<struct<n:int,chars:long,lo:int,hi:int,extra:int>>")
    want, g, chars, lo = [], -1, 0, 0
    for i, c in enumerate(sizes):
        if g >= 0 and chars < 100 and i // 7 - lo <= 2:
            chars += c + 3
        else:
            g, chars, lo = g + 1, c, i // 7
        want.append(g)
    assert rows.select(sc.merge_groups(F.col("s"), 100)).first()[0] == want


def test_page_roles(spark):
    page = "The leaves of the tree fall in autumn and grow again in spring. " * 20
    cases = [("short", 9, "front_matter"), ("Copyright of all. " + "words of a page " * 8, 2, "front_matter"), (page, 2, "curriculum"), ("ISBN " + page, 7, "curriculum")]
    got = spark.createDataFrame([c[:2] for c in cases], "t string, page int").select("t", "page", sc.page_role(F.col("t"), F.col("page"))).collect()
    assert sorted(map(tuple, got)) == sorted(cases)
