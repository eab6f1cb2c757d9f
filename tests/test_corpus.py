"""The sources on hand-made rows."""

from marlstone.sources import corpus


def test_html_blocks_are_whole(spark, tmp_path):
    html = (
        "<nav><p>menu</p></nav><script>var t = '<p>no</p>';</script><h1>A &amp; B</h1><p><b>Bold</b> then <i>more</i> text</p><ul><li><a href='/x'>Link</a></li></ul>"
        "<table><caption>Cap</caption></table><figure><FIGCAPTION>Fig</FIGCAPTION></figure><div>loose</div><p>open <em>end"
    )
    spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = [tuple(r) for r in corpus.html_blocks(spark, str(tmp_path)).orderBy("page_id", "position").collect()]
    want = [("h1", "A & B"), ("p", "Bold then more text"), ("li", "Link"), ("caption", "Cap"), ("figcaption", "Fig"), ("p", "loose"), ("p", "open end")]
    assert got == [(1, i, *b) for i, b in enumerate(want)]


def test_character_references_are_read_once(spark, tmp_path):
    html = "a &amp;lt;b&amp;gt; c<P class='x'>&lt;i&gt; &#233;&#xE9;&eacute; &unknown; R&D & &#0; &#x1F600; &copy</P>tail\u0001\u0002<style>p {}</STYLE><!-- <p>x</p> --> end"
    spark.createDataFrame([(1, html)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = [tuple(r)[1:] for r in corpus.html_blocks(spark, str(tmp_path)).orderBy("position").collect()]
    assert got == [(0, "p", "a &lt;b&gt; c"), (1, "p", "<i> ééé &unknown; R&D & &#0; 😀 &copy"), (2, "p", "tail end")]
