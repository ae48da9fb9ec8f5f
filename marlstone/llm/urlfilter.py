"""URL filters: every capture against the list entries that held when it was fetched.

Dated list events become validity intervals, and an as-of join on the capture's keys (its URL, its host and the host's
parent domains) finds the intervals that hold at fetch time. Built-in expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.runtime import table

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[\]]*)"
_AUTHORITY = r"^([A-Za-z][A-Za-z0-9+.-]*)://((?:[^/?#@]*@)?)(\[[^\]/?#]*\]|[^/?#:\[\]]*)(?::([0-9]*))?([^#]*)"


def host_of(url: Column) -> Column:
    """The host in lower case, an IPv6 address in its brackets, without a dot at the end; empty where the text is no URL."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.$", "")


def normal_url(url: Column) -> Column:
    """The URL with scheme and host in lower case, without its fragment, its scheme's own port and the host's last dot, and
    with a path; other texts as they are but for the fragment."""
    part = lambda n: F.regexp_extract(url, _AUTHORITY, n)
    scheme, port, rest = F.lower(part(1)), part(4), part(5)
    own = (port == "") | (scheme == "http") & (port == "80") | (scheme == "https") & (port == "443")
    path = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    whole = F.concat(scheme, F.lit("://"), part(2), host_of(url), F.when(own, F.lit("")).otherwise(F.concat(F.lit(":"), port)), path)
    return F.when(host_of(url) != "", whole).otherwise(F.regexp_replace(url, "#.*$", ""))


def keys_of(url: Column) -> Column:
    """(kind, pattern) of all that an entry can name: the URL in its normal form, the host, and the host's parent
    domains of two labels or more, the host among them."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    # an address has no parent domains
    n = F.when(host.startswith("[") | host.rlike(r"^[0-9.]+$"), F.lit(1)).otherwise(F.size(labels))
    domains = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    key = lambda kind, pattern: F.struct(F.lit(kind).alias("kind"), pattern.alias("pattern"))
    return F.when(
        host != "",
        F.concat(
            F.array(key("url", normal_url(url)), key("host", host)),
            F.when(n >= 2, F.transform(domains, lambda d: key("domain", d))).otherwise(F.array().cast("array<struct<kind:string,pattern:string>>")),
        ),
    )


def intervals(entries: DataFrame) -> DataFrame:
    """`entries` (list, kind, pattern, action, at) to (list, kind, pattern, since, until): from an `add` to the next
    event of the same pattern on the same list, until is null while it holds on. At one time a `remove` wins over an
    `add`. Patterns are brought to the form of captures' keys. Events with a null anywhere or another action, and repeated
    ones, say nothing more; an empty table has no intervals."""
    known = entries.select("list", "kind", "pattern", "action", "at").dropna().where("action in ('add', 'remove')")
    pattern = F.when(F.col("kind") == "url", normal_url(F.col("pattern"))).otherwise(F.regexp_replace(F.lower("pattern"), r"\.$", ""))
    one = known.withColumn("pattern", pattern).groupBy("list", "kind", "pattern", "at").agg(F.max("action").alias("action"))
    order = Window.partitionBy("list", "kind", "pattern").orderBy("at")
    return one.withColumn("until", F.lead("at").over(order)).where("action = 'add'").select("list", "kind", "pattern", F.col("at").alias("since"), "until")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """`captures` (url, fetched_at and any other columns) with blocked, n_entries and lists (names, sorted, joined by
    commas) appended; columns of these names are replaced.

    Captures without URL, host or time match nothing. Repeated captures keep a row each; an empty table on either side
    gives no matches. The keys of distinct captures are joined, so copies of a capture cost one look-up; a hot host is
    a hot key of the left side alone, which Spark splits, as each pattern has few intervals.
    """
    columns = [c for c in captures.columns if c not in ("blocked", "n_entries", "lists")]
    distinct = captures.where("url is not null and fetched_at is not null").select(F.col("url").alias("uf_url"), F.col("fetched_at").alias("uf_at")).distinct()
    asked = distinct.select("uf_url", "uf_at", F.explode(keys_of(F.col("uf_url"))).alias("key")).select("uf_url", "uf_at", F.col("key.kind").alias("uf_kind"), F.col("key.pattern").alias("uf_key"))
    held = intervals(entries)
    holds = (F.col("uf_at") >= F.col("since")) & (F.col("until").isNull() | (F.col("uf_at") < F.col("until")))
    hits = asked.join(held, (F.col("uf_kind") == F.col("kind")) & (F.col("uf_key") == F.col("pattern")) & holds)
    verdict = hits.groupBy("uf_url", "uf_at").agg(F.count("*").alias("n_entries"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"))
    return captures.select(*columns).join(verdict, (F.col("url") == F.col("uf_url")) & (F.col("fetched_at") == F.col("uf_at")), "left").select(
        *columns, F.col("n_entries").isNotNull().alias("blocked"), F.coalesce("n_entries", F.lit(0)).alias("n_entries"), F.coalesce("lists", F.lit("")).alias("lists")
    )


def _number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def dated_entries(pages: DataFrame) -> DataFrame:
    """A deterministic dated list over the hosts, domains and URLs of `pages`, for a corpus that brings none: hashes
    of the patterns decide which are listed, when, and when they are taken off again. Pages without URL give none;
    repeated ones give their entries once; an empty table gives none."""
    hosts = pages.select(host_of(F.col("url")).alias("pattern")).where("pattern <> ''").distinct()
    domains = hosts.select(F.regexp_extract("pattern", r"([^.]+\.[^.]+)$", 1).alias("pattern")).where("pattern <> ''").distinct()
    urls = pages.select(normal_url(F.col("url")).alias("pattern")).where("pattern is not null").distinct()
    listed = None
    for kind, patterns, every in (("host", hosts, 4), ("domain", domains, 8), ("url", urls, 32)):
        some = patterns.withColumn("n", _number(F.concat(F.lit(kind), "pattern"))).where(F.col("n") % every == 0)
        some = some.select(F.lit(f"{kind}s").alias("list"), F.lit(kind).alias("kind"), "pattern", "n")
        listed = some if listed is None else listed.unionByName(some)
    day = lambda n: F.timestamp_seconds(F.lit(1704067200) + n * 86400)  # noqa: E731  from 2024-01-01
    added = F.floor(F.col("n") / 32) % 200
    event = lambda action, at: F.struct(F.lit(action).alias("action"), day(at).alias("at"))
    events = F.array(event("add", added), event("remove", added + 20 + F.floor(F.col("n") / 64) % 90), event("add", added + 150))
    return listed.select("list", "kind", "pattern", F.explode(events).alias("e")).select("list", "kind", "pattern", "e.action", "e.at")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as captures of one day of 2024 each, by id; without URL they match nothing, an empty table gives no rows."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", F.timestamp_seconds(F.lit(1704067200) + (F.col("page_id") * 37 % 366) * 86400))
    return evaluate(captures, dated_entries(pages)).select("page_id", "url", F.date_format("fetched_at", "yyyy-MM-dd").alias("fetched"), "blocked", "n_entries", "lists")


OP2_SQL = r"""
WITH q AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[\]]*)', 1)), '\.$', '') AS host,
    regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://((?:[^/?#@]*@)?)(\[[^\]/?#]*\]|[^/?#:\[\]]*)(?::([0-9]*))?([^#]*)', ['scheme', 'usr', 'h', 'port', 'rest']) AS u, TIMESTAMP '2024-01-01' + to_days((page_id * 37 % 366)::INTEGER) AS t FROM pages),
p AS (SELECT page_id, url, host, t, CASE WHEN host = '' THEN regexp_replace(url, '#.*$', '') ELSE lower(u.scheme) || '://' || u.usr || host
    || CASE WHEN u.port = '' OR lower(u.scheme) = 'http' AND u.port = '80' OR lower(u.scheme) = 'https' AND u.port = '443' THEN '' ELSE ':' || u.port END
    || CASE WHEN starts_with(u.rest, '/') THEN u.rest ELSE '/' || u.rest END END AS bare FROM q),
patterns AS (
  SELECT DISTINCT 'host' AS kind, host AS pattern, 4 AS every FROM p WHERE host <> ''
  UNION SELECT DISTINCT 'domain', regexp_extract(host, '([^.]+\.[^.]+)$', 1), 8 FROM p WHERE regexp_extract(host, '([^.]+\.[^.]+)$', 1) <> ''
  UNION SELECT DISTINCT 'url', bare, 32 FROM p WHERE bare IS NOT NULL),
numbered AS (SELECT *, ('0x' || substr(md5(kind || pattern), 1, 8))::BIGINT AS n FROM patterns),
listed AS (SELECT kind || 's' AS list, kind, pattern, (n // 32) % 200 AS d, (n // 64) % 90 AS e FROM numbered WHERE n % every = 0),
held AS (
  SELECT list, kind, pattern, TIMESTAMP '2024-01-01' + to_days(d::INTEGER) AS since, TIMESTAMP '2024-01-01' + to_days((d + 20 + e)::INTEGER) AS until FROM listed
  UNION ALL SELECT list, kind, pattern, TIMESTAMP '2024-01-01' + to_days((d + 150)::INTEGER), NULL FROM listed),
parts AS (SELECT *, string_split(host, '.') AS l FROM p WHERE host <> '' AND t IS NOT NULL),
keys AS (SELECT page_id, t, 'url' AS k, bare AS q FROM parts UNION ALL SELECT page_id, t, 'host', host FROM parts
  UNION ALL SELECT page_id, t, 'domain', array_to_string(l[i:len(l)], '.') FROM (SELECT *, unnest(range(1, len(l)::BIGINT)) AS i FROM parts WHERE len(l) >= 2 AND host NOT LIKE '[%' AND NOT regexp_matches(host, '^[0-9.]+$'))),
hits AS (SELECT page_id, count(*) AS n, string_agg(DISTINCT list, ',' ORDER BY list) AS lists FROM keys JOIN held
  ON k = kind AND q = pattern AND t >= since AND (until IS NULL OR t < until) GROUP BY page_id)
SELECT p.page_id, p.url, strftime(p.t, '%Y-%m-%d') AS fetched, h.n IS NOT NULL AS blocked, coalesce(h.n, 0)::BIGINT AS n_entries, coalesce(h.lists, '') AS lists
FROM p LEFT JOIN hits h USING (page_id)
"""
