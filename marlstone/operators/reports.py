"""Reports over conversion results: compatibility score, failures, retries, summaries, expectations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as T

# Headings that mark the sections of a rendered page, and the placeholder of an empty one.
SECTIONS = ("## 页面描述", "## 可见文本", "## 主要链接", "## 正文", "## 帖子目录", "## 页面标题结构")
PLACEHOLDER = "未检测到可提取的可见正文内容"
CHALLENGE_MARKERS = ("checking your browser", "正在检查您的浏览器", "client challenge", "just a moment", "enable javascript", "javascript is disabled")
ACCESS_MARKERS = ("登录或注册", "sign in", "log in", "login", "your request has been blocked", "access denied", "forbidden")


def any_of(c: Column, terms) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(t) for t in terms])


def compat_score(markdown: Column, extractor: Column) -> Column:
    """The score of a rendered page, by its length, structure and sections; never below 0."""
    text = T.text0(markdown)
    size = F.length(T.normalized(markdown))
    capped = lambda n, most, w: F.least(n, F.lit(most)) * w
    parts = [
        F.least(size, F.lit(3000)) / 30, capped(T.count_of(text, r"(?m)^#{1,6}\s+"), 12, 4.0), capped(T.links(text), 20, 1.5), capped(T.list_items(text), 30, 1.0),
        capped(T.code_blocks(text), 5, 6.0), capped(T.count_of(text, r"(?m)^\|.+\|$"), 10, 3.0),
        *[F.when(text.contains(s), 10.0).otherwise(0.0) for s in SECTIONS],
        F.when((T.text0(extractor) != "") & (extractor != "body-fallback"), 15.0).otherwise(0.0),
        F.when(size < 120, -50.0).otherwise(0.0), F.when(text.contains(PLACEHOLDER), -30.0).otherwise(0.0),
    ]
    return F.round(F.greatest(reduce(lambda a, b: a + b, parts), F.lit(0.0)), 2)


def status_from_score(score: Column) -> Column:
    return F.when(score >= 85, "strong").when(score >= 55, "usable").when(score >= 25, "weak").otherwise("failed")


def failure_class(markdown: Column, title: Column) -> Column:
    """Challenges go before refusals; null where there is neither."""
    text = F.lower(F.regexp_replace(F.concat(T.text0(title), F.lit(" "), T.text0(markdown)), r"\s+", " "))
    return F.when(any_of(text, CHALLENGE_MARKERS), "challenge_or_js_required").when(any_of(text, ACCESS_MARKERS), "login_or_blocked")


def merge_retries(results: DataFrame, retries: DataFrame) -> DataFrame:
    """`results` (url, ok, status, score, attempt and more), each replaced by the successful retry of its url, if there
    is one; the latest counts. first_attempt_status tells what was before."""
    values = [c for c in results.columns if c != "url"]
    best = retries.where("ok").groupBy(F.col("url").alias("r_url")).agg(F.max_by(F.struct(*values), "attempt").alias("r"))
    joined = results.join(best, F.col("url") == F.col("r_url"), "left")
    pick = [F.when(F.col("r").isNotNull(), F.col(f"r.{c}")).otherwise(F.col(c)).alias(c) for c in values]
    return joined.select("url", *pick, F.when(F.col("r").isNotNull(), F.col("status")).alias("first_attempt_status"))


def summary_sets(results: DataFrame, keys: list[str]) -> DataFrame:
    """(dimension, value, n, ok): the counts of every key by itself, in one pass over the results."""
    stacked = F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), F.coalesce(F.col(k).cast("string"), F.lit("unknown")).alias("value")) for k in keys]))
    return results.select(F.col("ok"), stacked.alias("s")).groupBy("s.dimension", "s.value").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"))


def summarize(results: DataFrame) -> DataFrame:
    """One row: total, ok, success_rate, average_score, rendered_count and retry_successes."""
    total = F.count("*")
    return results.agg(
        total.alias("total"), F.count_if("ok").alias("ok"), F.coalesce(F.round(F.count_if("ok") / F.nullif(total, F.lit(0)), 4), F.lit(0.0)).alias("success_rate"),
        F.coalesce(F.round(F.avg(F.coalesce("score", F.lit(0.0))), 2), F.lit(0.0)).alias("average_score"), F.count_if("rendered").alias("rendered_count"),
        F.count_if(F.col("ok") & (F.col("attempt") > 1)).alias("retry_successes"),
    )


def category_success(results: DataFrame) -> DataFrame:
    by = results.groupBy(F.coalesce("category", F.lit("unknown")).alias("category")).agg(F.count("*").alias("total"), F.count_if("ok").alias("ok"))
    return by.withColumn("success_rate", F.round(F.col("ok") / F.col("total"), 4))


def unmet(found: dict[str, Column], least: dict[str, Column], title: Column | None = None, title_contains: Column | None = None) -> Column:
    """Names of the expectations that a row misses: counts below their minimum, and a text that the title lacks."""
    tests = [F.when(F.coalesce(found[k], F.lit(0)) < v, F.concat(F.lit(f"{k}<"), v.cast("string"))) for k, v in least.items()]
    if title_contains is not None:
        tests.append(F.when(~F.lower(T.text0(title)).contains(F.lower(title_contains)), F.concat(F.lit("title_missing:"), title_contains)))
    return F.array_compact(F.array(*tests))


def load_sites(path: str) -> list[dict[str, str]]:
    """The `sites:` list of a YAML file, its entries being maps of one level or plain addresses. The file is small and read
    on the driver; nothing but this shape is understood."""
    sites: list[dict[str, str]] = []
    inside = False
    with open(path, encoding="utf-8") as lines:
        for line in lines:
            said = line.split(" #")[0].rstrip()
            if not said.strip() or said.lstrip().startswith("#"):
                continue
            if not said.startswith((" ", "-")):
                inside = said == "sites:"
                continue
            if not inside:
                continue
            said = said.strip()
            if said.startswith("- "):
                sites.append({})
                said = said[2:].strip()
            key, colon, value = said.partition(": ")
            sites[-1][key if colon else "url"] = (value if colon else said).strip().strip("\"'")
    return sites


# The sections of the report with counts, and the columns of its table with what they show.
COUNT_SECTIONS = (("status", "Status Counts"), ("quality_status", "Quality Counts"), ("extractor", "Extractors"), ("winner_source", "Winner Sources"), ("failure_reason", "Failure Reasons"))
COLUMNS = (
    ("Status", "status", ""), ("Quality", "quality_status", ""), ("Score", "score", "0"), ("Attempt", "attempt", "1"), ("Category", "category", ""), ("Extractor", "extractor", ""),
    ("Source", "winner_source", ""), ("Candidates", "candidate_count", ""), ("Rendered", "rendered", ""), ("URL", "url", ""), ("Reason", "failure_reason", ""), ("Error", "error", ""),
)
NUMBERS = ("Score", "Attempt", "Candidates")


def report_lines(results: DataFrame) -> DataFrame:
    """(line) of the report's table of results, the worst first: failed before ok, then by score, then by address."""
    said = {
        "rendered": F.when(F.coalesce("rendered", F.lit(False)), "yes").otherwise(""), "candidate_count": F.when(F.coalesce(F.col("candidate_count"), F.lit(0)) != 0, F.col("candidate_count").cast("string")).otherwise(""),
        "error": F.replace(F.coalesce("error", F.lit("")), F.lit("|"), F.lit("\\|")),
    }
    cells = [said.get(name, F.coalesce(F.col(name).cast("string"), F.lit(default))) for _, name, default in COLUMNS]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    keys = {"k0": F.coalesce("ok", F.lit(False)), "k1": F.coalesce("score", F.lit(0.0)), "k2": F.col("url")}
    return results.select(*[c.alias(k) for k, c in keys.items()], line.alias("line")).orderBy(*keys).select("line")


def markdown_report(results: DataFrame, generated_at: str, total_sites: int | None = None) -> str:
    """The report of a benchmark run (a row a site; such runs are small) as Markdown: figures, counts, and all results."""
    one = summarize(results).first()
    counts = summary_sets(results, [k for k, _ in COUNT_SECTIONS]).where("value <> 'unknown'").orderBy(F.desc("n"), "value").collect()
    head = [
        "# Web Compatibility Benchmark", "", f"- Generated: {generated_at}", f"- Sites: {one.total}", f"- Success rate: {one.success_rate:.2%}", f"- Average score: {one.average_score}",
        f"- Retry successes: {one.retry_successes}", *([f"- Completed: {one.total / total_sites:.2%}"] if total_sites else []),
    ]
    for key, name in COUNT_SECTIONS:
        own = [f"- {r.value}: {r.n}" for r in counts if r.dimension == key]
        head += ["", f"## {name}", "", *own] if own or key in ("status", "extractor") else []
    rule = " | ".join("---:" if name in NUMBERS else "---" for name, _, _ in COLUMNS)
    table = ["| " + " | ".join(name for name, _, _ in COLUMNS) + " |", f"| {rule} |", *(r.line for r in report_lines(results).toLocalIterator())]
    return "\n".join([*head, "", "## Results", "", *table, ""])


def running_reports(results: DataFrame, order: str = "finished_at") -> DataFrame:
    """(n, ok, success_rate, average_score) after every result: what a report written each time would say."""
    from pyspark.sql import Window

    # a run is one sequence; its rows are few
    so_far = Window.partitionBy("run").orderBy(order, "url").rowsBetween(Window.unboundedPreceding, 0)
    n, ok = F.count("*").over(so_far), F.count_if("ok").over(so_far)
    return results.select("run", "url", n.alias("n"), ok.alias("ok"), F.round(ok / n, 4).alias("success_rate"), F.round(F.avg(F.coalesce("score", F.lit(0.0))).over(so_far), 2).alias("average_score"))


def pdf_report(results: DataFrame, expected: DataFrame) -> DataFrame:
    """(id, url, ok, failures) of converted samples against `expected` (id, url, min_pages, min_formulas, min_inline_images,
    min_tables, title_contains). `results` has id, title, page_count, formula_count, image_count, table_count and error; a
    sample without result, or with an error, fails."""
    joined = expected.join(results.withColumnRenamed("id", "r_id"), F.col("id") == F.col("r_id"), "left")
    pairs = {"page_count": "min_pages", "formula_count": "min_formulas", "image_count": "min_inline_images", "table_count": "min_tables"}
    missed = unmet({k: F.col(k) for k in pairs}, {k: F.coalesce(F.col(v), F.lit(0)) for k, v in pairs.items()}, F.col("title"), F.coalesce("title_contains", F.lit("")))
    failures = F.when(F.col("r_id").isNull(), F.array(F.lit("no result"))).when(F.col("error").isNotNull(), F.array(F.concat(F.lit("error: "), "error"))).otherwise(missed)
    return joined.select("id", "url", (F.size(failures) == 0).alias("ok"), failures.alias("failures"))
