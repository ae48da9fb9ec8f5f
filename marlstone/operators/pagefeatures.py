"""Features of raw HTML as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions import text as T

# What pages say that refuse access, ask for a login, or need JavaScript.
ACCESS_MARKERS = (
    "您当前请求存在异常", "暂时限制本次访问", "知乎小管家", '"code":40362', "access denied", "request has been blocked", "forbidden", "captcha",
    "bot challenge", "安全验证", "人机验证",
)
CAPTCHA_MARKERS = ("captcha", "验证")
LOGIN_MARKERS = ("login required", "sign in to continue", "log in to continue", "请先登录", "登录后查看", "登录或注册")
JS_MARKERS = (
    "javascript is disabled", "javascript 不可用", "please enable javascript", "enable javascript", "checking your browser", "正在检查您的浏览器",
    "client challenge", "just a moment", "请启用 javascript",
)

# Ids of the elements that script-made applications fill, and parts of their bundles' addresses.
ROOT_IDS = ("root", "__next", "app", "q-app", "svelte", "gatsby-focus-wrapper")
BUNDLE_PARTS = ("chunk", "bundle", "webpack", "vite", "_next/static")

_any = lambda c, terms: reduce(lambda a, b: a | b, [c.contains(t) for t in terms])


def stripped(html: Column) -> Column:
    """Text of a page without comments, head, scripts, styles and tags."""
    return T.normalized(T.replaced(
        T.text0(html), (r"(?is)<!--.*?-->", " "),
        (r"(?is)<(script|style|noscript|template|head)\b.*?</(script|style|noscript|template|head)>", " "), (r"(?s)<[^>]*>", " "),
    ))


def _count(html: Column, tag: str) -> Column:
    return T.count_of(T.text0(html), rf"(?is)<{tag}[\s>]")


def path_of(url: Column) -> Column:
    return F.regexp_extract(T.text0(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def page_kind(html: Column, url: Column) -> Column:
    """`search`, `home`, `list` or `article`, the first that holds."""
    links, paragraphs = _count(html, "a"), _count(html, "p")
    box = html.rlike(r"(?i)<input\b[^>]*\btype\s*=\s*[\"']?search\b") | html.rlike(r"(?i)<form\b[^>]*\brole\s*=\s*[\"']?search\b")
    search = box | F.lower(F.coalesce(F.try_url_decode(F.regexp_replace(url, r"\+", "%2B")), url)).rlike(r"(^|[?&])(q|query|search)=")
    root = F.btrim(path_of(url), F.lit("/")).isin("", "search", "s")
    return (
        F.when(search, "search").when(root & (links >= F.greatest(F.lit(10), 3 * paragraphs)), "home")
        .when((links >= 30) & (paragraphs < 5) & (F.length(stripped(html)) < 4000), "list").otherwise("article")
    )


def blocked_reason(text: Column, status: Column | None = None, titles: Column | None = None) -> Column:
    """Why a page shows no content, or null. `titles` is an array, best first; the three best stand before the text. The
    order of the tests and their length limits are part of the meaning."""
    said = text if titles is None else T.normalized(F.concat_ws(" ", F.slice(titles, 1, 3), text))
    t, n = F.lower(said), F.length(said)
    by_text = (
        F.when((n <= 4000) & _any(t, ACCESS_MARKERS), F.when(_any(t, CAPTCHA_MARKERS), "captcha").otherwise("access_denied"))
        .when((n <= 3000) & _any(t, LOGIN_MARKERS), "login").when(_any(t, JS_MARKERS), "js_required").when(n < 20, "js_required")
    )
    return by_text if status is None else F.when(F.coalesce(status.isin(401, 403, 429), F.lit(False)), "access_denied").otherwise(by_text)


def spa_signature(html: Column) -> Column:
    """Whether the page looks like the shell of a script-made application: a root with little text, many scripts with less,
    or a bundle with hardly any."""
    n = F.length(stripped(html))
    root = html.rlike(rf"(?i)\bid\s*=\s*[\"']?({'|'.join(ROOT_IDS)})[\"'\s>]")
    bundle = html.rlike(rf"(?i)<script\b[^>]*\bsrc\s*=\s*[\"']?[^\"'\s>]*({'|'.join(BUNDLE_PARTS)})")
    return (root & (n < 800)) | ((_count(html, "script") >= 12) & (n < 500)) | (bundle & (n < 350))


def link_density(html: Column) -> Column:
    inner = F.array_join(F.regexp_extract_all(html, F.lit(r"(?is)<a\s[^>]*>([^<]*)</a>"), F.lit(1)), "")
    return F.length(inner) / F.greatest(F.length(stripped(html)), F.lit(1))


def without_dots(path: Column) -> Column:
    """A path with its `.` and `..` parts resolved."""
    parts = F.split(path, "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda out, x: F.when(x == ".", out).when(x == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(1)))).otherwise(F.concat(out, F.array(x))))
    ends = F.element_at(parts, -1).isin(".", "..")
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.concat(F.array_join(kept, "/"), F.when(ends, F.lit("/")).otherwise(F.lit("")))).otherwise(path)


def absolute(href: Column, url: Column) -> Column:
    """A link's target: fragments, mail and telephone as they are, other schemes null, the rest against the page: its
    scheme, its site, its own address for a query, else its folder."""

    def target(x: Column) -> Column:
        own, site, path = x["href"], x["site"], x["path"]
        folder = F.when(path.contains("/"), F.regexp_replace(path, r"[^/]*$", "")).otherwise(F.lit("/"))
        rest = F.regexp_extract(own, r"^[^?#]*([?#].*)?$", 1)
        plain = F.regexp_extract(own, r"^([^?#]*)", 1)
        joined = T.bound(F.when(own.startswith("/"), plain).otherwise(F.concat(folder, plain)), without_dots)
        return (
            F.when(own.rlike(r"^(#|mailto:|tel:)") | own.rlike(r"(?i)^https?://"), own).when(own == "", url)
            .when(own.startswith("//"), F.concat(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), own)).when(own.startswith("?"), F.concat(site, path, own))
            .when(own.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None)).otherwise(F.concat(site, joined, rest))
        )

    site = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    return T.bound(F.struct(F.btrim(href).alias("href"), site.alias("site"), path_of(url).alias("path")), target)
