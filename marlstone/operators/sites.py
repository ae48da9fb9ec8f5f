"""Extractors for kinds of sites: video pages, forum topics, floor threads, code reviews, encyclopedia articles.

Each takes (tree, url, title) and returns (name, Markdown, confidence), or None where the page is of another kind. They
are plain functions in a list; `extraction.register_extractor` adds further ones, and `extract_pages` is the same as a
table function for SQL.
"""

from __future__ import annotations

import json
import re
from datetime import datetime, timedelta, timezone
from urllib.parse import urlparse

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from marlstone.sources.html import Node, _join, cleaned, flat, image_source, markdown, metadata, parse, table

# Hosts, paths, class names and scripts' names in this file are the sites' own; so are the numbers that say how
# sure an extraction is and how many of a kind are kept.
MOST_TAGS, MOST_CARDS, MOST_COMMITS, MOST_IMAGES = 20, 50, 20, 20
# Statistics of a video, as its page's state names them.
VIDEO_STATS = ("view", "danmaku", "reply", "like", "coin", "favorite", "share")


def host(url: str) -> str:
    return urlparse(url or "").netloc.lower().rpartition("@")[2].partition(":")[0]


def first(node: Node, *selectors: str) -> Node | None:
    return next((x for s in selectors for x in node.select(s)[:1]), None)


def said(node: Node, *selectors: str) -> str:
    return next((t for s in selectors for x in node.select(s) if (t := x.text())), "")


def unique(rows, key=lambda r: r) -> list:
    return list({key(r): r for r in reversed(list(rows))}.values())[::-1]


def info(pairs) -> str:
    return "\n".join(f"- {k}: {v}" for k, v in pairs if v)


def sections(*parts: str) -> str:
    return "\n\n".join(p for p in parts if p)


def clock(value) -> str | None:
    """Seconds as [HH:]MM:SS; None for what is no such number."""
    try:
        s = int(value)
    except (TypeError, ValueError):
        return None
    if s < 0:
        return None
    return (f"{s // 3600:02d}:" if s >= 3600 else "") + f"{s % 3600 // 60:02d}:{s % 60:02d}"


def local_time(value, hours: int = 8) -> str | None:
    try:
        s = int(value)
    except (TypeError, ValueError):
        return None
    return datetime.fromtimestamp(s, timezone(timedelta(hours=hours))).strftime("%Y-%m-%d %H:%M:%S %z") if s > 0 else None


def page_state(root: Node) -> dict:
    """The object that a script assigns to the page's initial state."""
    for s in root.nodes("script"):
        text = "".join(x for x in s.kids if isinstance(x, str))
        m = re.search(r"window\.__INITIAL_STATE__\s*=\s*", text)
        if m:
            try:
                found = json.JSONDecoder().raw_decode(text[m.end() :])[0]
            except ValueError:
                continue
            if isinstance(found, dict):
                return found
    return {}


def video_page(root: Node, url: str, title: str):
    if not re.search(r"(^|\.)bilibili\.com$", host(url)):
        return None
    if not urlparse(url).path.startswith("/video/"):
        return video_cards(root, url)
    state, meta = page_state(root), metadata(root)
    data = state.get("videoData") if isinstance(state.get("videoData"), dict) else {}
    up = state.get("upData") if isinstance(state.get("upData"), dict) else {}
    owner = data.get("owner") if isinstance(data.get("owner"), dict) else {}
    name = flat(str(data.get("title") or "")) or said(root, ".video-title", ".video-info-title", "h1") or flat(title)
    if not name:
        return None
    tags = [flat(str(t.get("tag_name", ""))) for t in state.get("tags") or [] if isinstance(t, dict)] or [t.text() for t in root.select(".tag-link")]
    tags = tags or [k for k in re.split(r"[,，]", meta.get("keywords", "")) if flat(k) and flat(k) not in (name, "弹幕")]
    stat = data.get("stat") if isinstance(data.get("stat"), dict) else {}
    rows = [[k, str(stat[k])] for k in VIDEO_STATS if stat.get(k) is not None]
    text = sections(
        f"# {name}", "## Information",
        info([("author", flat(str(owner.get("name") or up.get("name") or meta.get("author") or "")) or said(root, ".up-name")), ("published", local_time(data.get("pubdate"))), ("duration", clock(data.get("duration"))),
              ("category", flat(str(data.get("tname_v2") or data.get("tname") or ""))), ("address", url), ("cover", re.sub(r"^//", "https://", str(data.get("pic") or meta.get("og:image") or "")))]),
        (d := flat(str(data.get("desc") or "")) or said(root, ".desc-info-text", ".basic-desc-info")) and f"## Description\n\n{d}",
        rows and "## Statistics\n\n" + table([["item", "value"], *rows]), (kept := unique(map(flat, tags))[:MOST_TAGS]) and "## Tags\n\n" + ", ".join(kept),
    )
    return "video", text, 920.0


def video_cards(root: Node, url: str):
    rows = []
    for card in root.select(".feed-card") + root.select(".bili-video-card"):
        head = first(card, ".bili-video-card__info--tit")
        link = next((a for a in (head or card).nodes("a") + card.nodes("a") if "/video/" in a.attrs.get("href", "")), None)
        if link is None:
            continue
        name = flat((head and head.attrs.get("title")) or link.attrs.get("title") or link.text())
        stats = unique(x.text() for x in card.select(".bili-video-card__stats--text") if x.text())
        if name:
            rows.append([name, said(card, ".bili-video-card__info--author"), said(card, ".bili-video-card__info--date").lstrip("· "), *(stats + ["", ""])[:2], said(card, ".bili-video-card__stats__duration"), _join(url, link.attrs["href"])])
    rows = unique(rows, key=lambda r: r[-1])[:MOST_CARDS]
    return ("video-home", "# Videos\n\n" + table([["title", "author", "date", "views", "interactions", "duration", "address"], *rows]), 850.0) if len(rows) >= 3 else None


def thread(title: str, head: str, posts: list[tuple[str, str, str, str, str]]) -> str:
    """Posts (label, author, date, address, text) as an index and a section each."""
    index = "\n".join(f"- [{label}]({where}) {who}".rstrip() for label, who, _, where, _ in posts)
    return sections(f"# {title}", head, "## Posts\n\n" + index, *(sections(f"## {label}" + f" {who}" * bool(who), info([("date", when), ("address", where)]), text) for label, who, when, where, text in posts))


def forum_topic(root: Node, url: str, title: str):
    posts = []
    for n, post in enumerate(root.select("[data-post-id]"), 1):
        body = first(post, ".cooked")
        text = markdown(cleaned(body, url)) if body is not None else ""
        if not text.strip():
            continue
        date = first(post, ".relative-date")
        link = first(post, ".post-date", ".relative-date")
        href = link.attrs.get("href") if link is not None else None
        where = _join(url, href) if href else f"{url.rstrip('/')}/{n}" if n > 1 and urlparse(url).scheme else url
        posts.append((f"#{n}", said(post, ".names .username a", ".username a", ".names .first a", "[data-user-card]"), (date.attrs.get("title") or date.text()) if date is not None else "", where, text))
    tags = unique([said(root, ".badge-category__name", ".category-name"), *(t.text() for t in root.select(".discourse-tag"))])
    return ("forum-topic", thread(title, info([("tags", ", ".join(t for t in tags if t))]), posts), 700.0) if posts else None


def floor_thread(root: Node, url: str, title: str):
    if not re.search(r"(^|\.)nodeseek\.com$", host(url)) or not re.match(r"/post-\d+", urlparse(url).path):
        return None
    posts = []
    for item in root.select(".content-item"):
        body = first(item, ".post-content")
        text = markdown(cleaned(body, url)) if body is not None else ""
        if text.strip():
            floor = re.sub(r"\D", "", said(item, ".floor-link")) or ""
            posts.append((f"#{floor}" if floor else "#?", said(item, ".author-name"), said(item, ".content-info time", "time"), url, text))
    posts = unique(posts, key=lambda p: (p[0], p[1], p[4]))
    posts.sort(key=lambda p: int(p[0][1:]) if p[0][1:].isdigit() else 10**9)
    name = said(root, ".post-title-link", ".post-title", "h1") or title
    return ("floor-thread", thread(name, info([("category", said(root, ".content-category a", ".content-category"))]), posts), 910.0) if posts else None


def code_review(root: Node, url: str, title: str):
    m = re.match(r"/([^/]+)/([^/]+)/pull/(\d+)", urlparse(url or "").path)
    if host(url) not in ("github.com", "www.github.com") or not m:
        return None
    named = re.match(r"(.+?) by (\S+) · Pull Request", metadata(root).get("og:title", "") or title)
    comments = []
    for body in root.select(".comment-body"):
        box = next((a for a in body.above() if re.search(r"timeline-comment|TimelineItem", a.attrs.get("class", ""))), body)
        date = first(box, "relative-time", "time-ago", "time")
        text = markdown(cleaned(body, url))
        if text.strip():
            comments.append((said(box, ".author", ".Link--primary"), (date.attrs.get("datetime") or date.text()) if date is not None else "", text))
    comments = unique(comments, key=lambda c: (c[0], c[2]))
    if not comments:
        return None
    commits = unique(t[:240] for x in root.select(".TimelineItem") + root.select(".commit") if re.search(r"\b[0-9a-f]{7,40}\b", t := x.text()))[:MOST_COMMITS]
    (who, when, text), *rest = comments
    return "code-review", sections(
        f"# {named[1] if named else title}", info([("repository", f"{m[1]}/{m[2]}"), ("number", m[3]), ("author", named[2] if named else who)]), f"## Description\n\n{text}",
        commits and "## Commits\n\n" + "\n".join(f"- {c}" for c in commits), rest and "## Comments", *(sections(f"### {w}", info([("date", d)]), t) for w, d, t in rest),
    ), 925.0


def encyclopedia(root: Node, url: str, title: str):
    if not re.search(r"(^|\.)wikipedia\.org$", host(url)):
        return None
    body = first(root, "#mw-content-text .mw-parser-output")
    if body is None or len(body.text()) < 100:
        return None
    drop = frozenset(("navbox", "reflist", "mw-editsection", "reference", "infobox-below", "metadata", "sidebar", "toc", "catlinks", "noprint", "mw-jump-link", "printfooter"))
    plain = body.copy(drop=lambda n: n.tag == "sup" or bool(drop & set(n.attrs.get("class", "").split())) or "hatnote" in n.attrs.get("class", "").split() and len(n.text()) < 220)
    clean = cleaned(plain, url)
    lead = next((p.text() for p in clean.nodes("p") if p.text() and all(a.tag != "table" for a in p.above())), "")[:500]
    media = unique((flat(i.attrs.get("alt")) or "image", s) for i in clean.nodes("img") if (s := image_source(i, url)))[:MOST_IMAGES]
    name = said(root, ".mw-page-title-main", "#firstHeading", "h1") or title
    return "encyclopedia", sections(f"# {name}", lead and f"## Summary\n\n{lead}", "## Content", markdown(clean), media and "## Media\n\n" + "\n".join(f"- [{a}]({s})" for a, s in media)), 930.0


EXTRACTORS = [video_page, forum_topic, floor_thread, code_review, encyclopedia]


def best(root: Node, url: str, title: str, extractors=None):
    """The result of the highest confidence; the first of equals."""
    found = [r for e in (EXTRACTORS if extractors is None else extractors) if (r := e(root, url, title)) and r[1].strip()]
    return max(found, key=lambda r: r[2], default=None)


@udtf(returnType="name string, body string, score double")
class ExtractPages:
    """SELECT * FROM pages, LATERAL extract_pages(html, url, title): no row where no extractor applies."""

    def eval(self, html: str, url: str, title: str):
        found = best(parse(html or ""), url or "", title or "")
        if found:
            yield found[0], found[1], float(found[2])


def register(spark: SparkSession, name: str = "extract_pages") -> None:
    spark.udtf.register(name, ExtractPages)
