"""Results as they are shown: Markdown in blocks, quality panels, and the addresses that lists of jobs are asked by."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The labels of quality.
LABELS = {"strong": "强", "usable": "可用", "weak": "偏弱", "failed": "失败"}
MOST_REASONS = 4
BLOCK = "array<struct<kind:string,level:int,text:string,source:string,rows:array<array<string>>>>"

_RULE = re.compile(r"\|(?:\s*:?-{3,}:?\s*\|)+\s*")
_IMAGE = re.compile(r"!\[([^\]]*)\]\(([^)]+)\)")


def table_rows(lines: list[str]) -> list[list[str]]:
    """Header and body of a table's lines: the outer pipes go, every other one parts cells, escaped ones too; body rows are
    as wide as the header."""
    cells = [[c.strip() for c in line.strip()[1:-1].split("|")] for line in lines]
    width = len(cells[0]) if cells else 0
    return [cells[0], *((r + [""] * width)[:width] for r in cells[2:])] if cells else []


def image_source(job_id: str, source: str) -> str:
    """Where a viewer finds an image: those of the result through the service, others where they are."""
    if re.match(r"(?i)https?://|data:", source) or not re.match(r"\.?/?assets/", source):
        return source
    return f"/api/jobs/{job_id}/assets/{re.sub('^[.]?/?assets/', '', source)}"


def blocks(markdown: str | None, job_id: str = "") -> Iterator[dict]:
    """Markdown in blocks (kind, level, text, source, rows). A line is the first of: part of a fence, of a formula, blank, an
    image alone, a table's start, a heading, a quote, else text, which joins the line above. A formula that has no end lasts
    to the last line; a fence that has none shows nothing."""
    lines = (markdown or "").replace("\r\n", "\n").split("\n")
    one = lambda kind, text="", level=0, source=None, rows=None: {"kind": kind, "level": level, "text": text, "source": source, "rows": rows}
    held: list[str] = []
    inside = ""  # fence, formula or text: what the held lines are

    def close():
        nonlocal inside
        if inside:
            kind, text = inside, (" " if inside == "paragraph" else "\n").join(held)
            held.clear()
            inside = ""
            yield one(kind, text)

    at = 0
    while at < len(lines):
        line, said = lines[at], lines[at].strip()
        at += 1
        mark = "code" if line.startswith("```") else "formula" if said == "$$" else ""
        if inside in ("code", "formula"):
            if mark == inside:
                yield from close()
            else:
                held.append(line)
            continue
        if not mark and said and not _IMAGE.fullmatch(said) and said[0] not in "|#>":
            held.append(said)
            inside = "paragraph"
            continue
        image, heading = _IMAGE.fullmatch(said), re.fullmatch(r"(#{1,6})\s+(.+)", said)
        table = said.startswith("|") and at < len(lines) and _RULE.fullmatch(lines[at].strip())
        if not (mark or not said or image or heading or table or said.startswith(">")):
            held.append(said)
            inside = "paragraph"
            continue
        yield from close()
        if mark:
            inside = mark
        elif image:
            yield one("image", image[1], source=image_source(job_id, image[2]))
        elif table:
            end = next((k for k in range(at, len(lines)) if not lines[k].strip().startswith("|")), len(lines))
            yield one("table", rows=table_rows(lines[at - 1 : end]))
            at = end
        elif heading:
            yield one("heading", heading[2], level=min(len(heading[1]) + 1, 5) if len(heading[1]) > 1 else 2)
        elif said:
            yield one("quote", re.sub(r"^>\s?", "", said))
    if inside != "code":
        yield from close()


def with_blocks(results: DataFrame, markdown: str = "markdown", job_id: str = "job_id") -> DataFrame:
    """`results` with the column blocks. Null Markdown has none; an empty table gives no rows."""

    @F.pandas_udf(BLOCK)
    def cut(texts: pd.Series, ids: pd.Series) -> pd.Series:
        return pd.Series([list(blocks(t, str(i))) for t, i in zip(texts, ids)], dtype=object)

    return results.withColumn("blocks", cut(F.col(markdown), F.col(job_id).cast("string")))


def quality_label(status: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, status), status)


def quality_panel(metadata: Column) -> Column:
    """What a viewer shows of a result's quality (score, label, reasons, warnings) from its metadata as JSON; null where there
    is no score as a number or no status as a text."""
    text = lambda name: F.get_json_object(metadata, f"$.{name}")
    score = F.try_to_number(text("quality_score"), F.lit("999.99")).cast("double")
    listed = lambda name: F.coalesce(F.from_json(text(name), "array<string>"), F.array().cast("array<string>"))
    panel = F.struct(score.alias("score"), quality_label(text("quality_status")).alias("label"), F.slice(listed("quality_reasons"), 1, MOST_REASONS).alias("reasons"), F.array_join(listed("quality_warnings"), ", ").alias("warnings"))
    return F.when(score.isNotNull() & text("quality_status").isNotNull(), panel)


def list_address(source_type: Column, status: Column, search: Column) -> Column:
    """The query by which jobs are listed: what is given, in this order, escaped."""
    part = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}="), F.url_encode(c)))
    asked = F.concat_ws("&", part("source_type", source_type), part("status_filter", status), part("search", search))
    return F.concat(F.lit("/api/jobs"), F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise(F.lit("")))
