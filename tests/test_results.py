"""Shown results, job requests, reports, recordings and rendered files."""

from pyspark.sql import functions as F

from marlstone.operators import jobs, reports, transcript, viewer
from marlstone.sources import files, html

TEXT = """# Title
one
two

![pic](./assets/a.png)
| a | b\\|c |
| --- | ---: |
| 1 | 2 | 3 |
| 4 |
> said
```py
x = 1

y
```
$$
a = b
$$
#### Deep
tail
$$
open"""


def test_markdown_in_blocks(spark):
    got = [(b["kind"], b["level"], b["text"], b["source"], b["rows"]) for b in viewer.blocks(TEXT, "7")]
    assert got == [
        ("heading", 2, "Title", None, None), ("paragraph", 0, "one two", None, None), ("image", 0, "pic", "/api/jobs/7/assets/a.png", None),
        ("table", 0, "", None, [["a", "b\\", "c"], ["1", "2", "3"], ["4", "", ""]]), ("quote", 0, "said", None, None), ("code", 0, "x = 1\n\ny", None, None),
        ("formula", 0, "a = b", None, None), ("heading", 5, "Deep", None, None), ("paragraph", 0, "tail", None, None), ("formula", 0, "open", None, None),
    ]
    assert list(viewer.blocks("```\nnever closed")) == [] and list(viewer.blocks(None)) == []
    assert viewer.image_source("1", "https://x/y.png") == "https://x/y.png" and viewer.image_source("1", "other/a.png") == "other/a.png"
    df = spark.createDataFrame([(1, TEXT), (2, None)], "job_id long, markdown string")
    assert [len(r.blocks) for r in viewer.with_blocks(df).orderBy("job_id").collect()] == [10, 0] and viewer.with_blocks(df.where("1 = 0")).count() == 0


def test_quality_panels_and_addresses(spark):
    rows = [('{"quality_score": 81.5, "quality_status": "strong", "quality_reasons": ["a", "b", "c", "d", "e"], "quality_warnings": ["w", "x"]}',), ('{"quality_score": "n", "quality_status": "weak"}',), ('{"quality_score": 5}',), (None,)]
    got = [r.p for r in spark.createDataFrame(rows, "m string").select(viewer.quality_panel(F.col("m")).alias("p")).collect()]
    assert (got[0].score, got[0].label, got[0].reasons, got[0].warnings) == (81.5, "强", ["a", "b", "c", "d"], "w, x") and got[1:] == [None] * 3
    asked = spark.createDataFrame([("text", "failed", "a b&c"), (None, "", "x"), (None, None, None)], "t string, s string, q string").select(viewer.list_address(F.col("t"), F.col("s"), F.col("q")).alias("u")).collect()
    assert [r.u for r in asked] == ["/api/jobs?source_type=text&status_filter=failed&search=a+b%26c", "/api/jobs?search=x", "/api/jobs"]


def test_jobs_are_created_and_deleted(spark):
    rows = [(1, 5, "C:\\x\\a.pdf", "application/pdf", None, None, None, None), (2, None, None, None, None, None, "text é", "<p>"), (3, None, "a.exe", None, None, None, None, None), (4, None, "a.pdf", "image/png", None, None, None, None), (5, 5, None, None, "video_url", "http://x", None, None), (6, None, None, None, None, None, None, None)]
    asked = spark.createDataFrame(rows, "id long, user_id long, filename string, mime string, requested string, url string, text string, html string").withColumns({"address": F.lit("1.1.1.1"), "agent": F.lit("x")})
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    got = {r.id: r for r in jobs.created(asked, now, F.lit("s")).collect()}
    assert [got[k].refusal for k in range(1, 7)] == [None, None, "source_type", "upload", None, "source_type"]
    assert (got[1].input_filename, got[1].queue_name, got[1].guest_token_hash, str(got[1].expires_at)[:10]) == ("a.pdf", "file", None, "2024-01-08")
    assert (got[2].source_type, got[2].input_filename, got[2].input_size, str(got[2].expires_at)[:10]) == ("html", "input.txt", 7, "2024-01-02") and len(got[2].guest_token_hash) == 64
    made = jobs.created(asked, now, F.lit("s")).where("refusal is null")
    gone = jobs.deleted(made, spark.createDataFrame([(1,), (1,), (9,)], "id long"), now)
    assert {r.id for r in gone.where("deleted_at is not null").collect()} == {1} and gone.count() == 3


def test_results_on_request(spark):
    rows = [("succeeded", "md", "T", "p.md", "p.zip"), ("succeeded", "zip", None, "p.md", "p.zip"), ("succeeded", "pdf", "T", "p.md", "p.zip"), ("pending", "md", "T", None, None), ("succeeded", "md", "T", None, None)]
    df = spark.createDataFrame(rows, "s string, f string, t string, m string, z string")
    got = [r.d for r in df.select(jobs.download(F.col("s"), F.col("f"), F.col("t"), F.lit(3), F.col("m"), F.col("z")).alias("d")).collect()]
    assert [(d.code, d.name, d.media_type) for d in got] == [(200, "T.md", "text/markdown"), (200, "3.zip", "application/zip"), (400, None, None), (409, None, None), (404, None, None)]
    assert [r.c for r in df.select(jobs.result_status(F.col("s"), F.col("m")).alias("c")).collect()] == [200, 200, 200, 409, 404]
    users = spark.createDataFrame([(1, True), (2, False)], "id long, is_active boolean")
    told = spark.createDataFrame([("1", 5, 3), ("1", 2, 3), ("2", 5, 3), ("9", 5, 3), (None, 5, 3)], "subject string, expires_at int, at int")
    assert sorted((r.subject or "", r.expires_at, r.user_id) for r in jobs.current_users(told, users).collect()) == [("", 5, None), ("1", 2, None), ("1", 5, 1), ("2", 5, None), ("9", 5, None)]
    assert jobs.capabilities({"asr_provider": "cloud_openai_compatible", "ai_api_key": "k"})["cloud_asr_configured"] and not jobs.capabilities({})["ai_summary_configured"]


def test_reports(spark, tmp_path):
    (tmp_path / "s.yml").write_text('# corpus\nsites:\n  - category: docs\n    url: "https://a.example/x"\n  - url: https://b.example # note\n    category: news\nother:\n  - url: no\n')
    assert reports.load_sites(str(tmp_path / "s.yml")) == [{"category": "docs", "url": "https://a.example/x"}, {"url": "https://b.example", "category": "news"}]
    rows = [("r", 1, "u1", True, "strong", "strong", 90.0, 1, "docs", "x", "semantic", 3, True, None, None), ("r", 2, "u2", False, "failed", None, 0.0, 2, "news", None, None, None, False, "blocked", "a|b")]
    df = spark.createDataFrame(rows, "run string, finished_at int, url string, ok boolean, status string, quality_status string, score double, attempt int, category string, extractor string, winner_source string, candidate_count int, rendered boolean, failure_reason string, error string")
    lines = reports.markdown_report(df, "2024-01-01", 4).split("\n")
    assert lines[2:8] == ["- Generated: 2024-01-01", "- Sites: 2", "- Success rate: 50.00%", "- Average score: 45.0", "- Retry successes: 0", "- Completed: 50.00%"]
    assert lines[-3:-1] == ["| failed |  | 0.0 | 2 | news |  |  |  |  | u2 | blocked | a\\|b |", "| strong | strong | 90.0 | 1 | docs | x | semantic | 3 | yes | u1 |  |  |"] and "- blocked: 1" in lines
    assert [(r.n, r.ok, r.average_score) for r in reports.running_reports(df).orderBy("n").collect()] == [(1, 1, 90.0), (2, 1, 45.0)]
    want = spark.createDataFrame([("a", "u", 2, 1, 0, 0, "Tall"), ("b", "u", 1, 0, 0, 0, None), ("c", "u", 1, 0, 0, 0, None)], "id string, url string, min_pages int, min_formulas int, min_inline_images int, min_tables int, title_contains string")
    done = spark.createDataFrame([("a", "tall trees", 1, 1, 0, 0, None), ("b", "x", 3, 0, 0, 0, "no file")], "id string, title string, page_count int, formula_count int, image_count int, table_count int, error string")
    assert {r.id: (r.ok, r.failures) for r in reports.pdf_report(done, want).collect()} == {"a": (False, ["page_count<2"]), "b": (False, ["error: no file"]), "c": (False, ["no result"])}


def test_recordings(spark):
    segments = [(0.0, 2.0, "Hello there."), (2.0, 4.0, "Second part")]
    df = spark.createDataFrame([("in/talk.one.mp3", segments, None, "en", None), ("b.wav", [], "whole text", None, 75.0), ("c.wav", None, None, None, None)], "filename string, segments array<struct<start:double,end:double,text:string>>, text string, language string, duration double")
    got = {r.title: r for r in transcript.convert_audio(df).collect()}
    assert got["talk.one"].body == "Hello there. Second part" and got["talk.one"].duration == "00:04" and got["talk.one"].metadata.segment_count == 1
    assert got["b"].body == "whole text" and got["b"].duration == "01:15"
    said = spark.createDataFrame([("x" * 900, None, 1), (None, " out ", 2), (None, None, 3)], "e string, o string, c int").select(transcript.process_error(F.col("e"), F.col("o"), F.col("c")).alias("m")).collect()
    assert [r.m for r in said] == ["x" * 800, "out", "exit code 3"]


def test_rendered_files(spark):
    at = F.lit("2024-01-02 03:04:05").cast("timestamp")
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = F.lit
    md = one(files.render_document(lit('A "title"'), lit("webpage"), lit("Body."), at, url=lit("http://x"), author=lit("")))
    assert md == '---\ntitle: "A \\"title\\""\nsource_type: "webpage"\nsource_url: "http://x"\nconverted_at: "2024-01-02T03:04:05Z"\nassets_dir: "./assets"\n---\n\n# A "title"\n\n## 摘要\n\nBody.\n\n## 正文\n\nBody.\n\n## 资源\n\n- 原始链接：http://x\n'
    empty = one(files.render_document(lit("T"), lit("text"), lit(None).cast("string"), at, summary=lit(" ")))
    assert "## 摘要\n\n暂无摘要。" in empty and "## 正文\n\n未提取到正文内容。" in empty and empty.endswith("- 图片资源：\n- 附件：\n")
    entries = F.array(F.struct(lit("00:00").alias("start"), lit("00:12").alias("end"), lit("").alias("title"), lit("said").alias("text")))
    assert "## 时间轴\n\n### 00:00 - 00:12 转写片段\n\nsaid\n" in one(files.render_media(lit("T"), lit("audio"), entries, at, lit("s")))
    assert one(files.render_media(lit("T"), lit("audio"), F.array().cast("array<struct<start:string,end:string,title:string,text:string>>"), at, lit("s"))).endswith("未生成转写时间轴。\n")
    assert one(files.stats_metadata(lit("pdf"), {"page_count": lit(3)}))["page_count"] == "3"
    kinds = spark.createDataFrame([("image/jpeg", "u"), ("image/png", "u"), ("x/y", "http://a/b.webp?q=1.z"), (None, "http://a/b"), (None, "http://a/b.jpeg")], "t string, u string").select(files.image_extension(F.col("t"), F.col("u")).alias("e")).collect()
    assert [r.e for r in kinds] == [".jpg", ".png", ".webp", ".img", ".jpg"]
    images, got = spark.createDataFrame([(1, "a"), (1, "b")], "page int, url string"), spark.createDataFrame([(1, "a", "./assets/image-1.png"), (2, "b", "no")], "page int, url string, path string")
    assert sorted((r.url, r.local) for r in files.local_images(images, got).collect()) == [("a", "./assets/image-1.png"), ("b", "b")]


def test_page_details():
    root = html.parse('<head><meta name="author" content=" "><meta property="article:author" content="Jo"><meta name="date" content="2024-05-01"></head><body><time datetime="2020"></time><video src="v.mp4" poster="data:x"></video></body>')
    assert html.author_of(root) == "Jo" and html.date_of(root) == "2024-05-01" and html.date_of(html.parse('<time datetime="2020"></time>')) == "2020"
    assert html.absolute_media(root, "http://e.x/a/b").nodes("video")[0].attrs == {"src": "http://e.x/a/v.mp4", "poster": "data:x"}
    assert html.best_title("Shown", "Social") == "Social" and html.best_title("Search", "Social") == "Search" and html.best_title("Shown", "A long sentence that goes on and on. And on.") == "Shown" and html.best_title(None, None) is None
    assert html.restriction("please solve the CAPTCHA") and not html.restriction("captcha" + "x" * 1800) and html.image_label("http://x/a/b.png?c") == "b.png"
    assert html.is_meaningful("a" * 201) and not html.is_meaningful("# " * 500) and html.is_agent_block("Documentation Index at llms.txt")


def test_deep_pages_are_read_without_recursion():
    n = 3000
    page, found = html.candidates("<body>" + "<div><b>word and more words " * n + "</body>", "http://e.x/a")
    assert found and page["text_length"] > 19 * n and html.markdown(html.parse("<p>" * 5000 + "x")) == "x"
