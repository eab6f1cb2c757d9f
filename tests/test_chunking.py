"""Chunk packing against a plain walk over lists, and the rules for titles, answers and evidence on small cases."""

import random

from pyspark.sql import functions as F

from marlstone.functions import answers as an
from marlstone.functions import concepts as cn
from marlstone.operators.chunking import Budget, count, pack, packed_chunks, ranges, sentences, tail


def plain_groups(sizes, target, overlap):
    """Lists of unit numbers; where no whole unit fits the overlap the next group starts anew."""
    out, now = [], []
    for i, n in enumerate(sizes):
        if now and sum(sizes[j] for j in now) + n > target:
            out.append(now)
            keep = []
            while len(keep) < len(now) and sum(sizes[j] for j in keep) + sizes[now[-1 - len(keep)]] <= overlap:
                keep.insert(0, now[-1 - len(keep)])
            now = keep
        now = [*now, i]
    return [*out, now] if now else out


def test_ranges_equal_a_plain_walk():
    rng = random.Random(5)
    for _ in range(300):
        sizes = [rng.randint(1, 40) for _ in range(rng.randint(0, 40))]
        target, overlap = rng.randint(20, 100), rng.randint(0, 30)
        assert [list(range(x, y)) for x, y, _, _ in ranges(sizes, target, overlap)] == plain_groups(sizes, target, overlap)


def test_short_section_stays_whole():
    (chunk,) = pack([" ".join(["word"] * 40), " ".join(["word"] * 30)])
    assert chunk[:2] == (0, 1) and chunk[3].count("\n\n") == 1


def test_every_word_is_packed_and_a_stub_joins():
    paragraphs = [" ".join(f"w{p}x{i}" for i in range(60)) for p in range(3)] + ["w3x0 w3x1 and a few more words"]
    chunks = pack(paragraphs)
    packed = {w for c in chunks for w in c[3].split()}
    assert packed == {w for p in paragraphs for w in p.split()}
    assert chunks[-1][1] == 3 and chunks[-1][2] >= Budget().least


def test_long_paragraph_is_cut_at_sentences_with_overlap():
    text = " ".join(f"Sentence number {i} has some plain words." for i in range(40))
    chunks = pack([text])
    assert len(chunks) > 1 and all(c[2] <= Budget().target + Budget().overlap for c in chunks)
    for a, b in zip(chunks, chunks[1:], strict=False):
        assert b[3].startswith(tail(a[3], Budget().overlap).split("\n\n")[0][:20])
    assert [s for c in chunks for s in sentences(c[3])][0] == "Sentence number 0 has some plain words."


def test_tail():
    assert tail("One two. Three four. Five six.", 6) == "Three four. Five six."
    assert tail("one two three four five six", 4) == "four five six"
    assert tail("anything", 0) == "" and count("") == 1


def test_packed_chunks_of_odd_rows(spark):
    long = " ".join(["Plain words in a row here."] * 2000)
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (4, "1 2 3 " * 40), (5, long), (5, long)], "doc_id long, text string")
    rows = packed_chunks(docs).collect()
    assert {r["doc_id"] for r in rows} == {5}
    assert len(rows) % 2 == 0 and sorted(r["piece"] for r in rows)[:2] == [0, 0]
    assert packed_chunks(docs.limit(0)).count() == 0


def test_concepts(spark):
    names = ["The Plant Life Cycles", "Stories", "Mathematics", "Plant-Life", "", "Gas"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r["n"]: r["c"] for r in df.select("n", cn.normal_form(F.col("n")).alias("c")).collect()}
    assert got == {"The Plant Life Cycles": "plant life cycle", "Stories": "story", "Mathematics": "mathematics", "Plant-Life": "plant life", "": "", "Gas": "gas"}
    words = ["AP 1", "Unit 3", "Numbers to 1000", "exit ticket", "Photosynthesis", "NOS4 Models", "1234", "lessons"]
    df = spark.createDataFrame([(w,) for w in words], "p string")
    kept = [r["p"] for r in df.where(cn.is_concept(F.col("p"), cn.normal_form(F.col("p")))).collect()]
    assert kept == ["Numbers to 1000", "Photosynthesis"]
    title = spark.createDataFrame([("Grade 4 Unit 2: Sun, Moon, and Stars",)], "t string")
    assert title.select(cn.title_pieces(F.col("t"))).first()[0] == ["Sun, Moon, and Stars", "Sun", "Moon", "Stars"]


def test_answers(spark):
    rows = [("Think of the slope.", "What is it?", True), ("What now?", "Why?", False), ("Hint.", "Is it? Or not?", False), ("Step 1 do. Step 2 go.", "Why?", False), (None, "Why?", False)]
    df = spark.createDataFrame(rows, "h string, q string, ok boolean")
    assert df.where(an.hint_ok(F.col("h"), F.col("q")) != F.col("ok")).count() == 0
    one = spark.range(1)
    shown = one.select(
        an.page_range(F.lit(None).cast("int"), F.lit(3)), an.page_range(F.lit(7), F.lit(None).cast("int")), an.page_range(F.lit(12), F.lit(13)),
        an.evidence_text(F.lit("aa  bb cc"), 4), an.preview(F.lit("abcdefgh"), 6), an.state_of(F.lit(False), F.lit("confirm_answer")), an.state_of(F.lit(True), F.lit(None).cast("string")),
    ).first()
    assert tuple(shown) == ("?", "7", "12-13", "aa ...", "abc...", "insufficient_evidence", "give_hint")
