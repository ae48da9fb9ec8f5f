"""The page's content: candidates from the tree, scored and chosen by columns and windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators import pagefeatures as P
from marlstone.operators import sites
from marlstone.runtime import spread
from marlstone.sources import html as H

NUMBERS = (*H.FEATURES, "R", "U", "TS", "MF")
# Which source goes first where all else is equal, and the order of the verdicts.
PRIORITY = {"specialized": 7, "semantic": 6, "trafilatura": 5, "readability": 4, "jsonld": 3, "heuristic": 2, "snapshot": 1}
RANK = {"strong": 4, "usable": 3, "weak": 2, "blocked": 1, "failed": 0}

_REGISTRY: list[Callable] = list(sites.EXTRACTORS)


def register_extractor(extract: Callable) -> Callable:
    """Add an extractor (tree, url, title) -> (name, markdown, confidence) or None; the highest confidence wins."""
    _REGISTRY.append(extract)
    return extract


def page_candidates(pages: DataFrame, extractors: list[Callable] | None = None) -> DataFrame:
    """A row for every candidate of every page (page_id, url, html). Null html is an empty page, which has none."""
    own = tuple(_REGISTRY if extractors is None else extractors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "title", "titles", "author", "created_at", "text_length", "ord", "name", "source", "source_score", "depth", "markdown", *NUMBERS]
        for batch in batches:
            rows = []
            for page_id, url, html in zip(*(batch.column(i).to_pylist() for i in range(3))):
                page, found = H.candidates(html or "", url or "", own)
                rows += [(page_id, url, page["title"], page["titles"][:3], page["author"], page["created_at"], page["text_length"], *(c[n] for n in names[7:])) for c in found]
            cols = list(zip(*rows)) if rows else [[] for _ in names]
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.string(), *[pa.float64()] * len(NUMBERS)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=names)

    schema = "page_id long, url string, title string, titles array<string>, author string, created_at string, text_length int, ord int, name string, source string, source_score double, depth int, markdown string, " + ", ".join(f"{n} double" for n in NUMBERS)
    return spread(pages.select(F.col("page_id").cast("long"), "url", "html")).mapInArrow(run, schema)


def source_bonus() -> Column:
    strong = [s for s, w in H.CONTENT if w == 40][:6]
    return (
        F.when(F.col("source") == "specialized", F.least("source_score", F.lit(900.0))).when(F.col("source") == "semantic", F.when(F.col("name").isin(*strong), 40.0).otherwise(12.0))
        .when(F.col("source") == "readability", 28.0).when(F.col("source") == "trafilatura", 30.0).when(F.col("source") == "jsonld", 35.0)
        .when(F.col("source") == "heuristic", -5.0).otherwise(0.0)
    )


def scored(candidates: DataFrame) -> DataFrame:
    """`candidates` with rho, noise_cost, duplication_cost and score. Content, structure and agreement with the metadata
    count for a candidate; noise and repetition against it; an outline never gets over 75."""
    c, least = F.col, lambda n, most: F.least(F.col(n), F.lit(float(most)))
    rho = c("A") / F.greatest(c("L"), F.lit(1.0))
    content = least("L", 30000) / 90 + 4 * least("P", 80) + least("LI", 100)
    structure = 7 * least("H", 40) + 16 * least("TB", 15) + 18 * least("CB", 25) + 2 * least("IM", 30) + 5 * least("BQ", 10) + least("IC", 2000) / 80
    noise = (
        22 * c("N") + 180 * F.greatest(F.lit(0.0), c("rho") - 0.45) + F.when((c("rho") > 0.6) & (c("P") < 4), 260.0).otherwise(0.0)
        + F.when((c("H") == 0) & (c("P") < 3) & (c("L") < 900), 120.0).otherwise(0.0)
    )
    again = 180 * F.greatest(F.lit(0.0), 0.75 - c("U")) + 120 * c("R")
    out = candidates.withColumn("rho", rho).withColumns({"noise_cost": noise, "duplication_cost": again})
    score = content + structure + 40 * c("TS") + 25 * c("MF") - c("noise_cost") - c("duplication_cost") + source_bonus()
    return out.withColumn("score", F.when(c("source") == "snapshot", F.least(score, F.lit(75.0))).otherwise(score))


def rated(candidates: DataFrame, kind: Column, blocked: Column) -> DataFrame:
    """`candidates` with quality: the first rule that holds."""
    c, snap = F.col, F.col("source") == "snapshot"
    return candidates.withColumn("quality", (
        F.when(blocked.isNotNull(), "blocked").when((c("N") >= 8) & (c("P") < 5), "weak").when((c("rho") > 0.75) & (c("P") < 3) & ~snap, "weak")
        .when(snap & kind.isin("home", "search", "list") & (c("score") >= 55), "usable")
        .when((c("score") >= 85) & (c("L") >= 600) & (c("P") >= 3) & (c("rho") <= 0.55) & (c("N") <= 5) & ~snap, "strong")
        .when((c("score") >= 55) & (c("L") >= 200), "usable").otherwise("weak")
    ))


def with_reasons(candidates: DataFrame, kind: Column, blocked: Column) -> DataFrame:
    """`candidates` (rated) with reasons, the names of what speaks for a candidate and of the rule that decided."""
    c, snap = F.col, F.col("source") == "snapshot"
    for_it = F.array_compact(F.array(
        F.when(c("P") >= 3, F.lit("paragraph_density")), F.when(c("rho") <= 0.45, F.lit("low_link_density")),
        F.when((c("H") > 0) | (c("TB") > 0) | (c("CB") > 0), F.lit("structured_content")), F.when((c("TS") >= 0.35) | (c("MF") >= 0.5), F.lit("metadata_fit")),
    ))
    plus = lambda name: F.concat(for_it, F.array(name if isinstance(name, Column) else F.lit(name)))
    or_else = lambda name: F.when(F.size(for_it) > 0, for_it).otherwise(F.array(F.lit(name)))
    good = (c("score") >= 85) & (c("L") >= 600) & (c("P") >= 3) & (c("rho") <= 0.55) & (c("N") <= 5) & ~snap
    return candidates.withColumn("reasons", (
        F.when(blocked.isNotNull(), F.array(blocked)).when((c("N") >= 8) & (c("P") < 5), plus("high_noise_weak")).when((c("rho") > 0.75) & (c("P") < 3) & ~snap, plus("navigation_link_density"))
        .when(snap & kind.isin("home", "search", "list") & (c("score") >= 55), plus(F.concat(kind, F.lit("_snapshot")))).when(good, or_else("strong_score"))
        .when((c("score") >= 55) & (c("L") >= 200), or_else("usable_score")).when(c("score") >= 25, or_else("weak_score")).otherwise(or_else("low_score"))
    ))


def ranked(pages: DataFrame, extractors: list[Callable] | None = None) -> DataFrame:
    """All candidates of all pages with score, quality and place, 1 being the page's content.

    A specialised extraction of 900 or more goes first; on a blocked page the longest candidate does; on home, search
    and list pages or script-made ones the outline does, unless another candidate is good; else quality, score, noise,
    structure, source and depth decide in this order, and then the order of the candidates.
    """
    known = pages.select(F.col("page_id").cast("long").alias("page_key"), P.page_kind(F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))).alias("kind"), P.stripped(F.col("html")).alias("page_text"), P.spa_signature(F.coalesce("html", F.lit(""))).alias("spa"))
    c = F.col
    found = scored(page_candidates(pages, extractors)).join(known, c("page_id") == c("page_key"))
    found = found.withColumn("blocked", P.blocked_reason(c("page_text"), titles=c("titles"))).drop("page_key", "page_text", "titles")
    all_of = with_reasons(rated(found, c("kind"), c("blocked")), c("kind"), c("blocked"))
    page = Window.partitionBy("page_id")
    good = F.max(~c("source").isin("snapshot", "specialized") & c("quality").isin("strong", "usable") & (c("score") >= 85)).over(page)
    outline = (c("source") == "snapshot") & (c("kind").isin("home", "search", "list") | c("spa")) & ~c("good")
    lifted = outline & (c("L") >= 120)
    staged = all_of.withColumn("good", good).withColumns({
        "score": F.when(lifted, F.greatest(c("score"), F.least(F.lit(75.0), 55 + c("H") + c("LI") + c("IM")))).otherwise(c("score")),
        "quality": F.when(lifted & c("kind").isin("home", "search", "list"), "usable").when(lifted & c("spa") & (c("L") >= 250) & (c("quality") == "weak"), "usable").otherwise(c("quality")),
        "stage": F.when((c("source") == "specialized") & (c("source_score") >= 900), 0).when(c("blocked").isNotNull(), 1).when(outline, 2).otherwise(3),
    })
    number = lambda m, k: F.create_map(*[F.lit(x) for p in m.items() for x in p])[c(k)]
    when = lambda stage, x: F.when(c("stage") == stage, x)
    order = [
        c("stage").asc(), when(0, c("source_score")).desc(), when(1, c("L")).desc(), F.coalesce(number(RANK, "quality"), F.lit(0)).desc(), c("score").desc(), c("noise_cost").asc(),
        (c("P") + c("H") + c("TB") + c("CB")).desc(), F.coalesce(number(PRIORITY, "source"), F.lit(0)).desc(), c("depth").asc(), c("ord").asc(),
    ]
    # The outline stands in only where the page has no better content: never beside a strong article or a sure extractor.
    outline_last = [F.when(c("source") == "snapshot", 1).otherwise(0).asc(), *order]
    best = F.first(F.struct("source", "quality", "source_score")).over(page.orderBy(*outline_last).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    alone, listed = c("best.source") == "snapshot", c("kind").isin("home", "search", "list")
    sure = ((c("best.quality") == "strong") & (c("kind") == "article")) | ((c("best.source") == "specialized") & (c("best.source_score") >= 900))
    wanted = (c("source") != "snapshot") | alone | (~sure & (listed | c("best.quality").isin("weak", "blocked")))
    shown = staged.withColumn("best", best).where(wanted)
    return shown.withColumn("place", F.row_number().over(page.orderBy(*order))).drop("good", "stage", "best")


def should_render(quality: Column, score: Column, blocked: Column, text_length: Column, spa: Column, fetch_error: Column | None = None) -> Column:
    """Whether the page should be fetched again with a browser; null quality means that nothing was found."""
    rules = (
        F.when(blocked.isin("access_denied", "captcha", "login"), False).when(blocked == "js_required", True)
        .when((quality == "strong") & (score >= 85) & blocked.isNull(), False).otherwise(quality.isNull() | quality.isin("weak", "blocked") | (text_length < 120) | spa)
    )
    return F.coalesce(rules if fetch_error is None else F.when(fetch_error, True).otherwise(rules), F.lit(False))


def winners(pages: DataFrame, extractors: list[Callable] | None = None) -> DataFrame:
    return ranked(pages, extractors).where("place = 1")


def top_candidates(candidates: DataFrame, most: int = 5) -> DataFrame:
    """(page_id, top): the best candidates of each page by score, with name, source, score and quality."""
    n = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), "ord"))
    best = candidates.withColumn("at", n).where(F.col("at") <= most)
    return best.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("at", "name", "source", F.round("score", 2).alias("score"), "quality"))).alias("top"))
