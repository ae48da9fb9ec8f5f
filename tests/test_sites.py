"""Site extractors on inline pages."""

from marlstone.operators import sites
from marlstone.sources.html import parse


def run(html, url, title="Title"):
    return sites.best(parse(html), url, title)


def test_forum_topic():
    page = "".join(f'<article data-post-id="{i}"><div class="names"><span class="username"><a>user{i}</a></span></div><div class="cooked"><p>Post number {i} says something.</p></div></article>' for i in (7, 9))
    name, md, score = run(page, "https://forum.example/t/topic/5")
    assert (name, score) == ("forum-topic", 700.0) and "user7" in md and "https://forum.example/t/topic/5/2" in md


def test_code_review_needs_its_address():
    page = '<meta property="og:title" content="Fix it by ann · Pull Request #3"><div class="TimelineItem"><a class="author">ann</a><div class="comment-body">Why and how.</div></div><div class="commit">abcdef1234 Fix</div>'
    name, md, score = run(page, "https://github.com/o/r/pull/3")
    assert score == 925 and md.startswith("# Fix it") and "abcdef1234" in md and "o/r" in md
    assert run(page, "https://github.com/o/r/issues/3") is None


def test_floors_are_sorted_and_unique():
    item = '<div class="content-item"><a class="floor-link">#{0}</a><a class="author-name">u{0}</a><article class="post-content"><p>text of floor {0}</p></article></div>'
    md = run(item.format(10) + item.format(2) + item.format(2), "https://www.nodeseek.com/post-1-1")[1]
    assert md.index("text of floor 2") < md.index("text of floor 10") and md.count("text of floor 2\n") + md.count("text of floor 2") >= 1 and md.count("## #2") == 1


def test_encyclopedia_drops_references():
    page = '<h1 id="firstHeading">Thing</h1><div id="mw-content-text"><div class="mw-parser-output"><p>' + "A thing is a thing. " * 10 + '<sup>[1]</sup></p><div class="navbox">see also</div></div></div>'
    name, md, score = run(page, "https://en.wikipedia.org/wiki/Thing")
    assert score == 930 and "# Thing" in md and "[1]" not in md and "see also" not in md


def test_video_state():
    page = '<script>window.__INITIAL_STATE__={"videoData":{"title":"Clip","duration":3661,"pubdate":1700000000,"owner":{"name":"up"},"stat":{"view":5}},"tags":[{"tag_name":"x"}]};f()</script>'
    name, md, score = run(page, "https://www.bilibili.com/video/BV1")
    assert score == 920 and "01:01:01" in md and "2023-11-15 06:13:20 +0800" in md and "| view | 5 |" in md


def test_table_function(spark):
    sites.register(spark)
    spark.createDataFrame([("<p>x", "https://a.example/", "t")], "html string, url string, title string").createOrReplaceTempView("site_pages")
    assert spark.sql("SELECT p.url, e.* FROM site_pages p, LATERAL extract_pages(p.html, p.url, p.title) e").count() == 0
