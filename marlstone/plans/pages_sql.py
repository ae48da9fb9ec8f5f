"""Page features that expressions can take from raw HTML, without a parser."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import pagefeatures as P
from marlstone.runtime import table

_STRIP = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', ' ', 'g'), '(?is)<(script|style|noscript|template|head)\b.*?</(script|style|noscript|template|head)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"
_LINK = r"len(regexp_extract_all(html, '(?is)<a[\s>]'))"
_PARA = r"len(regexp_extract_all(html, '(?is)<p[\s>]'))"


def queries() -> dict:
    return {
        "page_visible_text": page_visible_text, "page_kind": page_kind, "page_blocked": page_blocked, "page_spa_signature": page_spa_signature, "page_links": page_links,
        "page_link_density": page_link_density, "page_noise_terms": page_noise_terms, "page_host_stats": page_host_stats, "page_slug": page_slug, "page_title_parts": page_title_parts,
    }


def oracle_sql() -> dict[str, str]:
    noise = " + ".join(f"(length(t) - length(replace(t, '{x}', ''))) // {len(x)}" for x in T.NOISE_TERMS)
    marks = lambda terms, c="t": "(" + " OR ".join(f"contains({c}, '{x}')" for x in terms) + ")"
    auth = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
    path = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
    return {
        "page_visible_text": rf"SELECT page_id, length({_STRIP})::BIGINT AS n, md5({_STRIP}) AS text_md5 FROM pages",
        "page_kind": rf"""WITH f AS (SELECT page_id, url, {_LINK} AS l, {_PARA} AS p, length({_STRIP}) AS n, {path} AS path, html FROM pages)
SELECT page_id, CASE WHEN regexp_matches(html, '(?i)<input\b[^>]*\btype\s*=\s*["'']?search\b') OR regexp_matches(html, '(?i)<form\b[^>]*\brole\s*=\s*["'']?search\b')
  OR regexp_matches(lower(url_decode(url)), '(^|[?&])(q|query|search)=') THEN 'search'
  WHEN trim(path, '/') IN ('', 'search', 's') AND l >= greatest(10, 3 * p) THEN 'home' WHEN l >= 30 AND p < 5 AND n < 4000 THEN 'list' ELSE 'article' END AS kind FROM f""",
        "page_blocked": rf"""WITH f AS (SELECT page_id, lower({_STRIP}) AS t FROM pages) SELECT page_id, CASE WHEN length(t) <= 4000 AND {marks(P.ACCESS_MARKERS)} THEN
  CASE WHEN {marks(P.CAPTCHA_MARKERS)} THEN 'captcha' ELSE 'access_denied' END WHEN length(t) <= 3000 AND {marks(P.LOGIN_MARKERS)} THEN 'login'
  WHEN {marks(P.JS_MARKERS)} THEN 'js_required' WHEN length(t) < 20 THEN 'js_required' END AS reason FROM f""",
        "page_spa_signature": rf"""SELECT page_id, (regexp_matches(html, '(?i)\bid\s*=\s*["'']?(root|__next|app|q-app|svelte|gatsby-focus-wrapper)["''\s>]') AND length({_STRIP}) < 800)
  OR (len(regexp_extract_all(html, '(?is)<script[\s>]')) >= 12 AND length({_STRIP}) < 500) OR (regexp_matches(html, '(?i)<script\b[^>]*\bsrc\s*=\s*["'']?[^"''\s>]*(chunk|bundle|webpack|vite|_next/static)') AND length({_STRIP}) < 350) AS spa FROM pages""",
        "page_links": rf"""WITH h AS (SELECT page_id, url, trim(unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*"([^"]*)"', 1))) AS href FROM pages),
p AS (SELECT *, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS site, {path} AS path FROM h)
SELECT page_id, href, CASE WHEN regexp_matches(href, '^(#|mailto:|tel:)') THEN href WHEN regexp_matches(href, '(?i)^https?://') THEN href WHEN href = '' THEN url
  WHEN starts_with(href, '//') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*:)', 1) || href WHEN starts_with(href, '/') THEN site || href WHEN starts_with(href, '?') THEN site || path || href
  WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL ELSE site || CASE WHEN contains(path, '/') THEN regexp_replace(path, '[^/]*$', '') ELSE '/' END || href END AS target, count(*) AS n FROM p GROUP BY ALL""",
        "page_link_density": page_link_density, "page_noise_terms": page_noise_terms, "page_host_stats": page_host_stats, "page_slug": page_slug, "page_title_parts": page_title_parts,
    }


def oracle_sql() -> dict[str, str]:
    noise = " + ".join(f"(length(t) - length(replace(t, '{x}', ''))) // {len(x)}" for x in T.NOISE_TERMS)
    marks = lambda terms, c="t": "(" + " OR ".join(f"contains({c}, '{x}')" for x in terms) + ")"
    auth = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
    path = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
    return {
        "page_visible_text": rf"SELECT page_id, length({_STRIP})::BIGINT AS n, md5({_STRIP}) AS text_md5 FROM pages",
        "page_kind": rf"""WITH f AS (SELECT page_id, url, {_LINK} AS l, {_PARA} AS p, length({_STRIP}) AS n, {path} AS path, html FROM pages)
SELECT page_id, CASE WHEN regexp_matches(html, '(?i)<input\b[^>]*\btype\s*=\s*["'']?search\b') OR regexp_matches(html, '(?i)<form\b[^>]*\brole\s*=\s*["'']?search\b')
  OR regexp_matches(lower(url_decode(url)), '(^|[?&])(q|query|search)=') THEN 'search'
  WHEN trim(path, '/') IN ('', 'search', 's') AND l >= greatest(10, 3 * p) THEN 'home' WHEN l >= 30 AND p < 5 AND n < 4000 THEN 'list' ELSE 'article' END AS kind FROM f""",
        "page_blocked": rf"""WITH f AS (SELECT page_id, lower({_STRIP}) AS t FROM pages) SELECT page_id, CASE WHEN length(t) <= 4000 AND {marks(P.ACCESS_MARKERS)} THEN
  CASE WHEN {marks(P.CAPTCHA_MARKERS)} THEN 'captcha' ELSE 'access_denied' END WHEN length(t) <= 3000 AND {marks(P.LOGIN_MARKERS)} THEN 'login'
  WHEN {marks(P.JS_MARKERS)} THEN 'js_required' WHEN length(t) < 20 THEN 'js_required' END AS reason FROM f""",
        "page_spa_signature": rf"""SELECT page_id, (regexp_matches(html, '(?i)\bid\s*=\s*["'']?(root|__next|app|q-app|svelte|gatsby-focus-wrapper)["''\s>]') AND length({_STRIP}) < 800)
  OR (len(regexp_extract_all(html, '(?is)<script[\s>]')) >= 12 AND length({_STRIP}) < 500) OR (regexp_matches(html, '(?i)<script\b[^>]*\bsrc\s*=\s*["'']?[^"''\s>]*(chunk|bundle|webpack|vite|_next/static)') AND length({_STRIP}) < 350) AS spa FROM pages""",
        "page_links": rf"""WITH h AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*"([^"]*)"', 1)) AS href FROM pages)
SELECT page_id, href, CASE WHEN regexp_matches(href, '^(#|mailto:|tel:)') THEN href WHEN regexp_matches(href, '(?i)^https?://') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '^([A-Za-z]+:)', 1) || href
  WHEN starts_with(href, '/') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || href WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL ELSE regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || '/' || href END AS target, count(*) AS n FROM h GROUP BY ALL""",
        "page_link_density": rf"""SELECT page_id, round(length(array_to_string(regexp_extract_all(html, '(?is)<a\s[^>]*>([^<]*)</a>', 1), ''))::DOUBLE / greatest(length({_STRIP}), 1), 6) AS rho FROM pages""",
        "page_noise_terms": rf"WITH f AS (SELECT page_id, lower({_STRIP}) AS t FROM pages) SELECT page_id, least(50, {noise})::BIGINT AS noise FROM f",
        "page_host_stats": rf"SELECT {auth} AS authority, count(*) AS pages, sum(length(html))::BIGINT AS bytes FROM pages GROUP BY ALL",
        "page_slug": rf"""WITH p AS (SELECT page_id, url, list_filter(string_split({path}, '/'), lambda x: x <> '') AS parts FROM pages)
SELECT page_id, CASE WHEN len(parts) > 0 THEN regexp_replace(parts[len(parts)], '[-_]+', ' ', 'g') ELSE {auth} END AS slug FROM p""",
        "page_title_parts": r"""SELECT page_id, trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')), '(?i)\[\s*(edit|编辑)\s*\]', '', 'g'), '\s+[-|·]\s+.*$', '')) AS title,
  lower(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '[^\p{L}\p{N}]+', '', 'g')) AS h1_key FROM pages""",
    }


def page_visible_text(spark: SparkSession, sf: str) -> DataFrame:
    t = P.stripped(F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.length(t).cast("long").alias("n"), F.md5(t).alias("text_md5"))


def page_kind(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", P.page_kind(F.col("html"), F.col("url")).alias("kind"))


def page_blocked(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", P.blocked_reason(P.stripped(F.col("html"))).alias("reason"))


def page_spa_signature(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", P.spa_signature(F.col("html")).alias("spa"))


def page_links(spark: SparkSession, sf: str) -> DataFrame:
    h = table(spark, sf, "pages").select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*?href\s*=\s*"([^"]*)"'), F.lit(1))).alias("href")).withColumn("href", F.btrim("href"))
    return h.groupBy("page_id", "href", P.absolute(F.col("href"), F.col("url")).alias("target")).agg(F.count("*").alias("n"))


def page_link_density(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.round(P.link_density(F.col("html")), 6).alias("rho"))


def page_noise_terms(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.noise_terms(P.stripped(F.col("html")), longest=1 << 30).alias("noise"))


def page_host_stats(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").groupBy(T.authority(F.col("url")).alias("authority")).agg(F.count("*").alias("pages"), F.sum(F.length("html")).alias("bytes"))


def page_slug(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.slug_text(F.col("url")).alias("slug"))


def page_title_parts(spark: SparkSession, sf: str) -> DataFrame:
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    return table(spark, sf, "pages").select("page_id", T.clean_title(title).alias("title"), T.comparable(F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1)).alias("h1_key"))
