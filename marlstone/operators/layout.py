"""Laid-out pages (words, lines, blocks, ruling lines) as tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from marlstone.functions import text as T
from marlstone.operators import pdftext as X


def recurring_keys(lines: DataFrame, share: float = 0.45, least: int = 3, longest: int = 140) -> DataFrame:
    """(doc, key, pages) of `lines` (doc, page, text) that recur on at least max(least, share of all pages) pages."""
    keyed = lines.select("doc", "page", T.comparable(F.col("text")).alias("key"))
    total = lines.groupBy("doc").agg(F.countDistinct("page").alias("of"))
    often = keyed.where((F.col("key") != "") & (F.length("key") <= longest)).groupBy("doc", "key").agg(F.countDistinct("page").alias("pages"))
    return often.join(total, "doc").where(F.col("pages") >= F.greatest(F.lit(least), F.floor(F.col("of") * share))).select("doc", "key", "pages")


def drop_margins(blocks: DataFrame, recurring: DataFrame, top: float = 0.075, bottom: float = 0.06) -> DataFrame:
    """`blocks` (doc, page, text, y0, y1, page_height) without what recurs in the margins, page numbers there, and
    archive stamps. The recurring keys are joined by document."""
    margin = (F.col("y0") <= F.col("page_height") * top) | (F.col("y1") >= F.col("page_height") * (1 - bottom))
    keyed = blocks.withColumn("block_key", T.comparable(F.col("text"))).withColumn("in_margin", margin)
    often = recurring.select(F.col("doc").alias("r_doc"), F.col("key").alias("r_key")).distinct()
    marked = keyed.join(often, (F.col("doc") == F.col("r_doc")) & (F.col("block_key") == F.col("r_key")), "left")
    stamp = F.col("text").rlike(r"(?i)^\s*arxiv:\d{4}\.\d{4,5}")
    number = F.col("text").rlike(r"^\s*\d{1,4}\s*$") & F.col("in_margin")
    kept = ~((F.col("r_key").isNotNull() & F.col("in_margin")) | stamp | number)
    return marked.where(F.coalesce(kept, F.lit(True))).drop("block_key", "in_margin", "r_doc", "r_key")


def body_size(blocks: DataFrame) -> DataFrame:
    """(doc, body_size), the exact median of font sizes."""
    return blocks.groupBy("doc").agg(F.median("font_size").alias("body_size"))


def overlapping(blocks: DataFrame, boxes: DataFrame, least: float = 0.35) -> DataFrame:
    """`blocks` (doc, page, x0, y0, x1, y1) of which at least this share of their own area lies in one box of their page."""
    b = boxes.select(F.col("doc").alias("b_doc"), F.col("page").alias("b_page"), *[F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")])
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(F.col(hi), F.col(f"b_{hi}")) - F.greatest(F.col(lo), F.col(f"b_{lo}")))
    own = F.greatest(F.lit(1e-9), (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    return blocks.join(b, (F.col("doc") == F.col("b_doc")) & (F.col("page") == F.col("b_page")) & (side("x0", "x1") * side("y0", "y1") / own >= least), "left_semi")


def grid_cells(words: DataFrame, cells: DataFrame, slack: float = 1.0) -> DataFrame:
    """(doc, page, row, col, text): the words whose centres lie in a cell, in reading order. Both sides are small on any
    page, and the join is by page."""
    c = cells.select(F.col("doc").alias("c_doc"), F.col("page").alias("c_page"), "row", "col", *[F.col(x).alias(f"c_{x}") for x in ("x0", "y0", "x1", "y1")])
    mid = lambda a, b: (F.col(a) + F.col(b)) / 2
    inside = mid("x0", "x1").between(F.col("c_x0") - slack, F.col("c_x1") + slack) & mid("y0", "y1").between(F.col("c_y0") - slack, F.col("c_y1") + slack)
    hit = c.join(words, (F.col("doc") == F.col("c_doc")) & (F.col("page") == F.col("c_page")) & inside, "left")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct(F.round("y0", 1).alias("y"), F.col("x0").alias("x"), F.col("text").alias("t"))))), lambda w: w["t"]), " ")
    return hit.groupBy(F.col("c_doc").alias("doc"), F.col("c_page").alias("page"), "row", "col").agg(text.alias("text"))


def word_lines(words: DataFrame) -> DataFrame:
    """`words` (doc, page, x0, y0, x1, y1, text) with line, counted from the top. A word joins the line above while its
    centre is within 0.45 median heights (3.2 to 6.5) of that line's running median; the fold is a page's own."""

    def lines(page):
        import numpy as np

        page = page.assign(mid=(page.y0 + page.y1) / 2).sort_values(["mid", "x0"], kind="stable")
        limit = float(np.clip(0.45 * np.median(page.y1 - page.y0), 3.2, 6.5))
        out, now, n = [], [], 0
        for y in page.mid:
            if now and abs(y - float(np.median(now))) > limit:
                n, now = n + 1, []
            now.append(y)
            out.append(n)
        return page.drop(columns="mid").assign(line=out)

    return words.groupBy("doc", "page").applyInPandas(lines, StructType([*words.schema.fields, StructField("line", IntegerType())]))


def column_anchors(x_positions: list[float], widths: list[float], support: int = 2) -> list[float]:
    """Where columns begin: left edges clustered within 1.35 median character widths (4.5 to 7.5), two at least."""
    from statistics import median

    if not x_positions:
        return []
    limit = min(7.5, max(4.5, 1.35 * median(widths))) if widths else 4.5
    groups: list[list[float]] = []
    for x in sorted(x_positions):
        if groups and abs(x - median(groups[-1])) <= limit:
            groups[-1].append(x)
        else:
            groups.append([x])
    return [median(g) for g in groups if len(g) >= support]


def table_from_words(words: DataFrame) -> DataFrame:
    """(doc, page, rows): words put into lines, lines into columns by the nearest anchor; a matrix of cells a page."""

    def build(page):
        import pandas as pd

        anchors = column_anchors(page.x0.tolist(), ((page.x1 - page.x0) / page.text.str.len().clip(lower=1)).tolist())
        rows = []
        for _, line in page.sort_values(["line", "x0"]).groupby("line"):
            cells = [""] * max(1, len(anchors))
            for x, t in zip(line.x0, line.text):
                k = min(range(len(anchors)), key=lambda i: abs(anchors[i] - x)) if anchors else 0
                cells[k] = f"{cells[k]} {t}".strip()
            rows.append(cells)
        return pd.DataFrame({"doc": [page.doc.iloc[0]], "page": [page.page.iloc[0]], "rows": [rows]})

    kind = words.schema
    return word_lines(words).groupBy("doc", "page").applyInPandas(build, f"doc {kind['doc'].dataType.simpleString()}, page {kind['page'].dataType.simpleString()}, rows array<array<string>>")


# ---- rows of cells -------------------------------------------------------------------------------------------------


def filled(rows):
    """Number of cells with text."""
    return F.aggregate(rows, F.lit(0), lambda n, r: n + F.size(F.filter(r, lambda c: F.trim(c) != "")))


def width(rows):
    return F.aggregate(rows, F.lit(0), lambda n, r: F.greatest(n, F.size(r)))


def compact(rows):
    """Without empty rows and repeated ones; the first of each stays."""
    return F.array_distinct(F.filter(rows, lambda r: F.exists(r, lambda c: F.trim(c) != "")))


def numeric_ratio(rows):
    """Share of the cells with text that hold a digit."""
    digits = F.aggregate(rows, F.lit(0), lambda n, r: n + F.size(F.filter(r, lambda c: c.rlike(r"\d"))))
    return F.when(filled(rows) > 0, digits / filled(rows)).otherwise(F.lit(0.0))


def is_useful_table(rows):
    return (F.size(rows) >= 2) & (width(rows) >= 2) & (filled(rows) >= 4)


def is_useful_reconstruction(rows):
    return (F.size(rows) >= 3) & width(rows).between(2, 32) & (filled(rows) >= 8)


# ---- lines of text -------------------------------------------------------------------------------------------------


def line_kinds(line):
    """The kind of each line by its words alone: `heading`, `caption`, `list`, `formula`, `tail`, `break` or `text`."""

    @F.pandas_udf("string")
    def kinds(lines: pd.Series) -> pd.Series:
        return lines.map(lambda x: X.kind_of(X.flat(x), X.Block(x or "", page=-1), float("inf"), False))

    return kinds(line)


def paragraphs_of(lines: DataFrame) -> DataFrame:
    """`lines` (doc, page, ord, text) to paragraphs (doc, page, paragraph, kind, text): a gap-and-island count over each
    page. Headings, captions, list items and formulas stand alone; other lines join until a sentence ends."""

    @F.pandas_udf("boolean")
    def ends(said: pd.Series) -> pd.Series:
        return said.map(lambda x: X.ends_paragraph(X.flat(x)))

    @F.pandas_udf("string")
    def mended(said: pd.Series) -> pd.Series:
        return said.map(X.mended_text)

    page = Window.partitionBy("doc", "page").orderBy("ord")
    typed = lines.where(F.trim("text") != "").withColumns({"kind": line_kinds(F.col("text")), "ends": ends(F.col("text"))}).where("kind <> 'break'")
    before, ended = F.lag("kind").over(page), F.lag("ends").over(page)
    fresh = F.when((F.col("kind") == "text") & (before == "text") & ~ended, 0).otherwise(1)
    counted = typed.withColumn("fresh", fresh).withColumn("paragraph", F.sum("fresh").over(page.rowsBetween(Window.unboundedPreceding, 0)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: F.trim(x["text"])), " ")
    whole = counted.groupBy("doc", "page", "paragraph", "kind").agg(joined.alias("raw"))
    return whole.select("doc", "page", "paragraph", "kind", mended(F.col("raw")).alias("text"))


def iso_date(value):
    """D:YYYYMMDD... as YYYY-MM-DD; null where it is none."""
    return F.when(value.rlike(r"^D?:?\d{8}"), F.regexp_replace(value, r"^D?:?(\d{4})(\d{2})(\d{2}).*$", "$1-$2-$3"))


# ---- cells of extracted tables -------------------------------------------------------------------------------------


def cell_text(c):
    """Dot leaders to an ellipsis, no blanks before punctuation, blank lines gone; line breaks stay."""
    plain = T.replaced(T.text0(c), (r"\r\n?", "\n"), (r"(?:[ \t]*\.[ \t]*){3,}", " … "))
    lines = F.transform(F.split(plain, "\n"), lambda x: F.regexp_replace(T.normalized(x), r"\s+([:;,.])", "$1"))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def normalized_rows(rows):
    """Clean cells; rows without text are dropped."""
    return F.filter(F.transform(rows, lambda r: F.transform(r, cell_text)), lambda r: F.exists(r, lambda c: c != ""))


def without_empty_columns(rows):
    """Rows of one width without the columns that are empty in all of them, each row once."""
    w = width(rows)
    padded = F.transform(rows, lambda r: T.padded_row(r, w))
    # how many cells of each column hold text, summed over the rows
    none = F.array_repeat(F.lit(0), w)
    used = F.aggregate(padded, none, lambda n, r: F.zip_with(n, r, lambda a, c: a + F.when(c != "", 1).otherwise(0)))
    kept = lambda r: F.transform(F.filter(F.arrays_zip(r.alias("c"), used.alias("n")), lambda p: p["n"] > 0), lambda p: p["c"])
    return F.array_distinct(F.transform(padded, kept))


def renders_as_form(rows):
    """Whether a table is rather a form: wide, mostly empty, few cells a row or long ones."""
    w, n, full = width(rows), F.greatest(F.size(rows), F.lit(1)), filled(rows)
    long = F.aggregate(rows, F.lit(0), lambda s, r: s + F.size(F.filter(r, lambda c: F.length(c) >= 80)))
    per_row, blank = full / n, 1 - full / F.greatest(n * w, F.lit(1))
    return (w >= 3) & (((w <= 4) & (long >= 2) & (per_row <= 3.5)) | ((blank >= 0.35) & ((per_row <= 3.5) | (long >= 2))))


def form_lines(rows):
    """A form's rows as bullets, each once."""
    lines = F.transform(rows, lambda r: F.array_join(F.filter(F.transform(r, T.normalized), lambda c: c != ""), " | "))
    return F.array_join(F.transform(F.array_distinct(F.filter(lines, lambda x: x != "")), lambda x: F.concat(F.lit("- "), x)), "\n")


def merged_regions(regions: DataFrame) -> DataFrame:
    """`regions` (doc, page, x0, y0, x1, y1) with adjacent ones united: a gap of -1 to 10 below, widths and overlap alike
    to 0.8. Each region is compared with the one above it on its page."""
    page = Window.partitionBy("doc", "page").orderBy("y0", "x0")
    before = {c: F.lag(c).over(page) for c in ("x0", "x1", "y1")}
    gap = F.col("y0") - before["y1"]
    one, two = F.greatest(before["x1"] - before["x0"], F.lit(1.0)), F.greatest(F.col("x1") - F.col("x0"), F.lit(1.0))
    shared = F.greatest(F.lit(0.0), F.least(before["x1"], F.col("x1")) - F.greatest(before["x0"], F.col("x0")))
    joins = gap.between(-1, 10) & (F.least(one, two) / F.greatest(one, two) >= 0.8) & (shared / F.least(one, two) >= 0.8)
    island = F.sum(F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).over(page.rowsBetween(Window.unboundedPreceding, 0))
    return regions.withColumn("region", island).groupBy("doc", "page", "region").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
