"""Queries that need a parser, a fold or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import extraction as X
from marlstone.operators import layout as L
from marlstone.runtime import spread, table, text_batches
from marlstone.streaming import events as E


def queries() -> dict:
    own = (
        page_candidates_ranked, page_winner, page_top5_candidates, page_markdown, pdf_grid_cells, pdf_bbox_overlap, pdf_word_lines, pdf_paragraphs,
        stream_event_windows, stream_sessions, stream_lifecycle, stream_dedup,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "pdf_grid_cells": _GRID_SQL, "pdf_bbox_overlap": _OVERLAP_SQL, "pdf_word_lines": _WORD_LINES_SQL,
        "stream_event_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
        "stream_sessions": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, floor(epoch(min(ts)))::BIGINT AS since, count(*) AS n FROM s GROUP BY user_id, k""",
        "stream_lifecycle": _LIFECYCLE_SQL,
        "stream_dedup": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    }


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    text_batches(spark)
    return table(spark, sf, "pages")


def page_candidates_ranked(spark: SparkSession, sf: str) -> DataFrame:
    return X.ranked(_pages(spark, sf)).select("page_id", "place", "name", "source", F.round("score", 4).alias("score"), "quality", "L", "P", "H", F.round("rho", 6).alias("rho"))


def page_winner(spark: SparkSession, sf: str) -> DataFrame:
    render = X.should_render(F.col("quality"), F.col("score"), F.col("blocked"), F.col("text_length"), F.col("spa"))
    return X.winners(_pages(spark, sf)).select("page_id", "title", "name", "source", F.round("score", 4).alias("score"), "quality", "kind", render.alias("render"))


def page_top5_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return X.top_candidates(X.ranked(_pages(spark, sf)))


def page_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return X.winners(_pages(spark, sf)).select("page_id", "title", F.length("markdown").alias("n"), F.md5("markdown").alias("markdown_md5"))


# ---- layout fixtures -----------------------------------------------------------------------------------------------


def pdf_grid_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as words on a page of their size, in a grid of cells of 100 by 100."""
    p = table(spark, sf, "part")
    x, y = (F.col("p_partkey") * 37 % 500).cast("double"), (F.col("p_partkey") * 91 % 300).cast("double")
    words = p.select((F.col("p_partkey") % 20).alias("doc"), F.lit(1).alias("page"), x.alias("x0"), y.alias("y0"), (x + 10).alias("x1"), (y + 8).alias("y1"), F.col("p_partkey").cast("string").alias("text"))
    row, col = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("row"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("col")
    cells = words.select("doc", "page").distinct().select("doc", "page", row).select("doc", "page", "row", col)
    edge = lambda c, k: (F.col(c) * 100 + k).cast("double")
    boxed = cells.select("*", edge("col", 0).alias("x0"), edge("row", 0).alias("y0"), edge("col", 100).alias("x1"), edge("row", 100).alias("y1"))
    return L.grid_cells(words, boxed).select("doc", "row", "col", "text")


_GRID_SQL = """WITH w AS (SELECT p_partkey % 20 AS doc, (p_partkey * 37 % 500)::DOUBLE AS x, (p_partkey * 91 % 300)::DOUBLE AS y, p_partkey::VARCHAR AS t FROM part),
c AS (SELECT DISTINCT doc, r.r AS row, k.k AS col FROM w, (SELECT unnest(range(3)) AS r) r, (SELECT unnest(range(5)) AS k) k)
SELECT c.doc, c.row::INTEGER AS row, c.col::INTEGER AS col, coalesce(string_agg(t, ' ' ORDER BY y, x, t), '') AS text FROM c LEFT JOIN w ON w.doc = c.doc AND x + 5 BETWEEN col * 100 - 1 AND col * 100 + 101 AND y + 4 BETWEEN row * 100 - 1 AND row * 100 + 101 GROUP BY ALL"""


def pdf_bbox_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as boxes against those of the same order that have line number 1."""
    l = table(spark, sf, "lineitem")  # noqa: E741
    box = l.select(F.col("l_orderkey").alias("doc"), F.lit(1).alias("page"), "l_linenumber", F.col("l_quantity").alias("x0"), (F.col("l_tax") * 100).alias("y0"), (F.col("l_quantity") + 10).alias("x1"), (F.col("l_tax") * 100 + 4).alias("y1"))
    return L.overlapping(box.where("l_linenumber > 1"), box.where("l_linenumber = 1")).select("doc", "l_linenumber")


_OVERLAP_SQL = """WITH b AS (SELECT l_orderkey AS doc, l_linenumber, l_quantity AS x0, l_tax * 100 AS y0, l_quantity + 10 AS x1, l_tax * 100 + 4 AS y1 FROM lineitem)
SELECT a.doc, a.l_linenumber FROM b a WHERE a.l_linenumber > 1 AND EXISTS (SELECT 1 FROM b t WHERE t.l_linenumber = 1 AND t.doc = a.doc
AND greatest(0.0::DOUBLE, least(a.x1, t.x1) - greatest(a.x0, t.x0)) * greatest(0.0::DOUBLE, least(a.y1, t.y1) - greatest(a.y0, t.y0)) / greatest(1e-9, (a.x1 - a.x0) * (a.y1 - a.y0)) >= 0.35)"""


def pdf_word_lines(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    x, y = (F.col("p_partkey") * 37 % 500).cast("double"), (F.col("p_partkey") % 13 * 20 + F.col("p_partkey") % 3).cast("double")
    words = p.select((F.col("p_partkey") % 20).alias("doc"), F.lit(1).alias("page"), x.alias("x0"), y.alias("y0"), (x + 10).alias("x1"), (y + 8).alias("y1"), F.col("p_partkey").cast("string").alias("text"))
    return L.word_lines(words).groupBy("doc", "line").agg(F.count("*").alias("n"))


_WORD_LINES_SQL = "SELECT p_partkey % 20 AS doc, (dense_rank() OVER (PARTITION BY p_partkey % 20 ORDER BY p_partkey % 13) - 1)::INTEGER AS line, count(*) AS n FROM part GROUP BY p_partkey % 20, p_partkey % 13"


def pdf_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as pages of lines."""
    from marlstone.functions import text as T

    lines = spread(table(spark, sf, "documents")).select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.posexplode(F.split(T.text0(F.col("text")), "\n")).alias("ord", "text"))
    return L.paragraphs_of(lines).groupBy("doc", "page", "kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


# ---- streams -------------------------------------------------------------------------------------------------------


def stream_event_windows(spark: SparkSession, sf: str) -> DataFrame:
    return E.run_once(E.windowed(E.read_events(spark, f"{sf}/events.parquet")), "complete").select(F.date_format("since", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return E.run_once(E.sessions(E.read_events(spark, f"{sf}/events.parquet"), "6 hours"), "complete").select("user_id", F.unix_timestamp("since").alias("since"), "n")


def stream_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    """Events as the log of a job for each user, whose steps go by the event's number, which also decides between events of one
    time; the last row of a job holds."""
    steps = F.array(*[F.lit(s) for s in E.STEPS])
    log = E.read_events(spark, f"{sf}/events.parquet").select(F.col("user_id").alias("job_id"), F.element_at(steps, F.when(F.col("event_id") % 997 == 0, 5).otherwise(F.col("event_id") % 4 + 1).cast("int")).alias("step"), "ts", "event_id")
    last = lambda rows: rows.groupBy("job_id").agg(F.max("n").alias("n"), F.max_by("status", "n").alias("status"))
    return E.run_once(E.lifecycle(log, None, tie="event_id"), "update", last).select("job_id", "n", "status")


_LIFECYCLE_SQL = """WITH s AS (SELECT user_id AS job_id, event_id, ts, event_id % 997 = 0 AS done FROM events), f AS (SELECT job_id, bool_or(done) AS done, count(*) AS n, max_by(event_id % 4 + 1, (ts, event_id)) AS last FROM s GROUP BY job_id)
SELECT job_id, n, CASE WHEN done THEN 'succeeded' WHEN last = 1 THEN 'pending' ELSE 'processing' END AS status FROM f"""


def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    e = E.read_events(spark, f"{sf}/events.parquet")
    return E.run_once(E.unique(e.unionByName(e)), "append").groupBy("event_type").agg(F.count("*").alias("n"))
