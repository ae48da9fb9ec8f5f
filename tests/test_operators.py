"""Operators that the supplied tables do not exercise, on inline fixtures."""

import io
import zipfile

from pyspark.sql import functions as F

from marlstone.functions import markdown as M
from marlstone.functions import text as T
from marlstone.operators import extraction, jobs, layout, quality, reports, transcript, urls
from marlstone.sources import files, html


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items())).select(column.alias("x")).first().x


def test_clean_markdown(spark):
    body = "Title\n\n#\n Head\nSkip to main content\ntext  \n\n\n\nmore\n##   \n## Next\nline"
    got = one(spark, M.clean_markdown(F.col("b"), F.lit("title!")), b=body)
    assert not got.startswith("Title") and "Skip to" not in got and "\n\n\n" not in got and "\n\n## Next" in got


def test_summary_lines_lose_blanks_and_nothing_else(spark):
    body = "\n".join(["0 first 0", "\u3000 # a heading", " 1 second 1 ", "2 third\u00a02", "\ttab\t", "4 4", "  ", "\u2003# again", "88 ", "10 01", "01 10"])
    assert one(spark, T.summary(F.col("b")), b=body) == "0 first 0 1 second 1 2 third\u00a02 \ttab\t 4 4 88 10 01 01 10"


def test_markdown_table_escapes_and_pads(spark):
    rows = F.array(F.array(F.lit("a"), F.lit("b|c")), F.array(F.lit("x")))
    assert one(spark, T.markdown_table(rows), z="") == "| a | b\\|c |\n| --- | --- |\n| x |  |"


def test_table_rows_and_formulas(spark):
    md = "| a |\n| --- |\n| 1 |\n| 2 |\nend\n$$\nx\n$$"
    assert one(spark, T.table_rows(F.col("m")), m=md) == 2
    assert one(spark, T.formulas(F.col("m")), m=md) == 1
    assert one(spark, T.tables(F.col("m")), m=md) == 1


def test_timestamps(spark):
    assert [one(spark, T.timestamp(F.lit(s)), z="") for s in (None, 59.9, 61, 3723)] == ["00:00", "00:59", "01:01", "01:02:03"]


def test_quality_of_media_and_empty(spark):
    df = spark.createDataFrame([("", "untitled", 0), ("words " * 400, "A long talk", 9)], "body string, title string, segments int")
    got = quality.score_conversions(df, segments="segments").orderBy("segments").collect()
    assert got[0].quality_status == "failed" and got[0].quality_warnings == ["no_extractable_content"]
    assert got[1].quality_score == 59.3 and got[1].quality_status == "usable"  # 40 + 2399 / 180 + 6


def test_timeline_merges_short_segments(spark):
    df = spark.createDataFrame([([(0.0, 4.0, "One."), (4.0, 8.0, " "), (8.0, 12.5, "two")],)], "segments array<struct<start:double,end:double,text:string>>")
    row = transcript.timeline(df).first()
    assert [(e.start, e.end, e.text) for e in row.timeline] == [("00:00", "00:12", "One. two")] and row.duration_label == "00:12"


def test_source_types(spark):
    c = lambda v: F.lit(v).cast("string")
    kind = lambda f=None, r=None, u=None, t=None, h=None: one(spark, jobs.detect_source_type(c(f), c(r), c(u), c(t), c(h)), z="")
    assert [kind("a.PDF"), kind("a.exe"), kind(None, "video_url"), kind(h="<p>", t="x"), kind(u="http://x"), kind()] == ["pdf", None, "video_url", "html", "webpage", None]


def test_retention_order(spark):
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    rows = [(1, "pending", "2024-01-01 00:00:00", "2024-01-01 12:00:00"), (2, "processing", "2024-01-01 23:30:00", "2024-01-09 00:00:00")]
    df = spark.createDataFrame(rows, "id int, status string, u string, e string").select("id", "status", F.col("u").cast("timestamp").alias("updated_at"), F.col("e").cast("timestamp").alias("expires_at"), F.lit(None).cast("timestamp").alias("deleted_at"))
    assert [(r.status, r.swept) for r in jobs.retention(df, now).orderBy("id").collect()] == [("expired", "expired"), ("processing", None)]


def test_url_guard(spark):
    rows = [
        ("http://example.com/x", None, "unresolved"), ("http://example.com/x", ["93.184.216.34"], "ok"), ("http://example.com/x", ["93.184.216.34", "10.0.0.1"], "address"), ("http://a.example/", ["198.18.0.233"], "ok"),
        ("http://a.example/", ["::ffff:10.0.0.1"], "address"), ("http://a.example/", ["2606:4700::1111"], "ok"), ("file:///etc", None, "scheme"), (None, None, "scheme"), ("http://localhost:8000/", ["127.0.0.1"], "host"),
        ("http://localhost.localdomain/", None, "host"), ("http://x.localhost/", None, "host"), ("http:///x", None, "host"), ("http://8.8.8.8/", None, "ok"), ("http://[2001:4860:4860::8888]/", None, "ok"), ("http://192.0.2.1/", None, "ok"),
        *((f"http://{h}/", None, "address") for h in ("10.1.2.3", "198.18.0.1", "[::1]", "[0:0:0:0:0:0:0:1]", "[::]", "2130706433", "127.1", "0x7f.0.0.1", "0177.0.0.1", "[::ffff:127.0.0.1]", "[::ffff:7f00:1]", "[fd00::1]", "[fe80::1]", "[ff02::1]", "u@10.0.0.1:80")),
    ]
    got = spark.createDataFrame(rows, "u string, a array<string>, want string").select("u", "want", urls.url_verdict(F.col("u"), F.col("a")).alias("got")).collect()
    assert [(r.u, r.got) for r in got] == [(r.u, r.want) for r in got]
    words = spark.createDataFrame([("1:2:3:4:5:6:7:8",), ("1::8",), ("::",), ("1:2:3",), ("::1::2",), ("12345::",), ("1.2.3.4",), ("::1.2.3.4",), ("1:2:3:4:5:6:7::",)], "a string").select(urls.ipv6_words(F.col("a")).alias("w")).collect()
    assert [r.w for r in words] == [[1, 2, 3, 4, 5, 6, 7, 8], [1, 0, 0, 0, 0, 0, 0, 8], [0] * 8, None, None, None, None, [0, 0, 0, 0, 0, 0, 258, 772], [1, 2, 3, 4, 5, 6, 7, 0]]


def test_csv_dialects():
    for d in files.DELIMITERS:
        assert files.csv_rows(f"a{d}b\n1{d}2 \n3{d}4{d}5") == [["a", "b"], ["1", "2"], ["3", "4", "5"]]


def test_docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = (
        '<w:p><w:pPr><w:pStyle w:val="Heading 1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r><w:r><w:t xml:space="preserve"> text</w:t></w:r></w:p>'
        "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    )
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    title, md, tables = files.docx_markdown(data.getvalue())
    assert (title, tables) == ("Head", 1) and "**bold** text" in md and "| a | b |" in md


PAGE = "<html><head><title>Good news - Site</title></head><body><nav>{nav}</nav><article><h1>Good news</h1>{body}</article><footer>sign in</footer></body></html>"


def test_article_beats_navigation(spark):
    page = PAGE.format(nav="".join(f"<a href='/{i}'>Link {i}</a>" for i in range(80)), body="".join(f"<p>Paragraph number {i} tells something long enough to count as content of the page.</p>" for i in range(12)))
    df = spark.createDataFrame([(1, "https://x.example/good-news", page), (2, "https://x.example/", None)], "page_id long, url string, html string")
    best = extraction.winners(df, []).where("page_id = 1").first()
    assert best.source == "semantic" and best.quality == "strong" and best.title == "Good news" and "Link 3" not in best.markdown


def test_specialised_extractor_wins(spark):
    page = PAGE.format(nav="", body="<p>" + "word " * 80 + "</p>")
    df = spark.createDataFrame([(1, "https://forum.example/t/1", page)], "page_id long, url string, html string")
    extract = lambda root, url, title: ("forum", f"# {title}\n\n" + "post text " * 30, 910.0)
    assert extraction.winners(df, [extract]).first().name == "forum"


def test_html_details():
    assert html.best_srcset("a.png 1x, b.png 2x, c.png 600w") == "b.png"
    root = html.parse("<body><p>one<p>two <a href='javascript:x'>go</a><pre>x = 1</pre></body>")
    md = html.markdown(html.cleaned(root, "https://e.x/"))
    assert "one" in md and "javascript" not in md and "```\nx = 1\n```" in md
    assert html.title_candidates(html.parse("<title>A | B</title>"), "https://e.x/", {})[0][0] == "A"


def test_retry_merge_keeps_failures(spark):
    first = spark.createDataFrame([("a", False, "failed", 0.0, 1), ("b", True, "usable", 60.0, 1)], "url string, ok boolean, status string, score double, attempt int")
    again = spark.createDataFrame([("a", True, "weak", 30.0, 2)], first.schema)
    got = {r.url: (r.status, r.first_attempt_status) for r in reports.merge_retries(first, again).collect()}
    assert got == {"a": ("weak", "failed"), "b": ("usable", None)}


def test_words_to_table(spark):
    table = [("name", "n"), ("ann", "1"), ("bob", "2")]
    words = [(1, 1, float(x), 20.0 * i, x + 20.0, 20.0 * i + 8.0, t) for i, row in enumerate(table) for x, t in zip((10, 110), row)]
    df = spark.createDataFrame(words, "doc int, page int, x0 double, y0 double, x1 double, y1 double, text string")
    assert layout.table_from_words(df).first().rows == [["name", "n"], ["ann", "1"], ["bob", "2"]]


def test_lifecycle_steps_are_known():
    from marlstone.streaming import events

    assert events.STEPS["finished"] == ("succeeded", 100)


def test_table_cells(spark):
    rows = F.array(F.array(F.lit("a ..... b"), F.lit(""), F.lit("x :")), F.array(F.lit(" "), F.lit("")), F.array(F.lit("c"), F.lit(""), F.lit("y")), F.array(F.lit("c"), F.lit(""), F.lit("y")))
    clean = layout.normalized_rows(rows)
    df = spark.range(1).select(clean.alias("rows"))
    assert df.first().rows == [["a … b", "", "x:"], ["c", "", "y"], ["c", "", "y"]]
    assert df.select(layout.without_empty_columns(F.col("rows")).alias("r")).first().r == [["a … b", "x:"], ["c", "y"]]
    assert df.select(layout.renders_as_form(F.col("rows")).alias("r")).first().r is False
    assert df.select(layout.form_lines(F.col("rows")).alias("r")).first().r == "- a … b | x:\n- c | y"


def test_regions_below_each_other_are_one(spark):
    boxes = [(1, 1, 0.0, 0.0, 100.0, 50.0), (1, 1, 1.0, 55.0, 100.0, 90.0), (1, 1, 0.0, 120.0, 100.0, 150.0), (1, 2, 0.0, 92.0, 100.0, 99.0)]
    got = layout.merged_regions(spark.createDataFrame(boxes, "doc int, page int, x0 double, y0 double, x1 double, y1 double")).collect()
    assert sorted((r.page, r.y0, r.y1) for r in got) == [(1, 0.0, 90.0), (1, 120.0, 150.0), (2, 92.0, 99.0)]


def test_page_snapshot_sections():
    page = """<html><head><title>Home</title><meta name=description content="What it is"><meta property="og:type" content=website></head><body>
    <form><input type=search name=q><input type=hidden name=t value=x><button>Go</button></form><ul><li>One item</li><li>Two items</li></ul>
    <label>A label</label><details><summary>A summary</summary></details><dl><dt>Term</dt><dd>Meaning</dd></dl><table><tr><th>a|b</th><td>2</td></tr></table>
    <a href="/s?x=1&q=cat">Cats</a><a href="javascript:x()">No</a><img src="/i/cat.png"><video src="/v.mp4" title=Film></video><p style="display:none">unseen</p></body></html>"""
    md = html.snapshot(html.parse(page), "https://e.x/")
    for part in ("What it is", "- og:type: website", "- input:search - 搜索关键词", "- button - Go", "- A label", "- A summary", "- Term", "- Meaning", "### 列表 1\n\n- One item\n- Two items",
                 "| a\\|b | 2 |", "- [Cats](https://e.x/s?q=cat)", "- [cat.png](https://e.x/i/cat.png)", "- [Film](https://e.x/v.mp4)"):
        assert part in md
    assert "unseen" not in md and "javascript" not in md and "hidden" not in md
    assert "- just some words" in html.snapshot(html.parse("<body><div>just some words</div></body>"), "https://e.x/")
    assert html.candidates(page, "https://e.x/")[1][-1]["markdown"] == M.clean(md)
    assert html.snapshot(html.parse("<body></body>"), "").startswith("## 页面快照")
