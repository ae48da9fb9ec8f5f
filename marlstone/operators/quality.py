"""Quality of converted documents: counts, score, status, reasons and warnings as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import markdown as M
from marlstone.functions import text as T



def _or(c: Column | None, default) -> Column:
    return F.lit(default) if c is None else F.coalesce(c, F.lit(default))


def warnings_of(m: dict[str, Column]) -> Column:
    """Warnings in their order; see `score_conversions` for the names."""
    media = m["has_timeline"]
    when = lambda cond, name: F.when(cond, F.lit(name))
    nothing = ~media & (m["text_length"] < 80) & (m["images"] == 0) & (m["tables"] == 0)
    return F.array_compact(F.array(
        when(m["has_warning"], "converter_warning"),
        F.when(nothing, "no_extractable_content").when(~media & (m["text_length"] < 300), "low_text_volume"),
        when(~media & (m["text_length"] >= 1000) & (m["headings"] == 0) & (m["tables"] == 0), "low_structure_detected"),
        when(media & (m["segments"] == 0), "missing_timeline"),
        when((m["formulas"] > 0) & m["symbolic"], "formula_text_preserved_not_ocr"),
        when((m["paragraphs"] > 200) & (m["headings"] == 0), "long_text_without_headings"),
    ))


def reasons_of(m: dict[str, Column]) -> Column:
    rules = (
        (m["text_length"] >= 1200, "sufficient_text_volume"), (m["paragraphs"] >= 8, "paragraph_structure_detected"),
        (m["headings"] >= 3, "heading_hierarchy_detected"), (m["tables"] > 0, "tables_detected"), (m["images"] > 0, "images_detected"),
        (m["formulas"] > 0, "formula_blocks_detected"), (m["code_blocks"] > 0, "code_blocks_detected"),
        (m["segments"] > 0, "timestamped_timeline_detected"), (m["has_url"], "source_url_preserved"), (m["informative"], "informative_title_detected"),
    )
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in rules]))


def document_score(m: dict[str, Column]) -> Column:
    parts = [
        F.least(m["text_length"] / 160, F.lit(30.0)), *(F.least(m[k] * w, F.lit(top)) for k, w, top in (
            ("paragraphs", 1.2, 18.0), ("headings", 2.2, 14.0), ("tables", 4.0, 12.0), ("images", 2.0, 10.0), ("formulas", 1.8, 8.0), ("code_blocks", 2.5, 8.0))),
        *(F.when(m[k], F.lit(w)).otherwise(0.0) for k, w in (("informative", 6.0), ("has_url", 3.0), ("layout_engine", 4.0))),
    ]
    return reduce(lambda a, b: a + b, parts)


def media_score(m: dict[str, Column]) -> Column:
    parts = [
        F.least(m["segments"] * 5.0, F.lit(40.0)), F.least(m["text_length"] / 180, F.lit(30.0)),
        *(F.when(m[k], F.lit(w)).otherwise(0.0) for k, w in (("has_duration", 8.0), ("has_language", 6.0), ("informative", 6.0), ("has_url", 4.0))),
    ]
    return reduce(lambda a, b: a + b, parts)


def quality_status(score: Column, n_warnings: Column, empty: Column) -> Column:
    low = F.when(empty, "failed").otherwise("weak")
    return F.when(score < 25, low).when((score >= 80) & (n_warnings == 0), "strong").when(score >= 55, "usable").otherwise("weak")


def score_conversions(
    df: DataFrame, body: str = "body", title: str = "title", url: str | None = None, duration: str | None = None, language: str | None = None,
    segments: str | None = None, warning: str | None = None, table_count: str | None = None, image_count: str | None = None,
    formula_count: str | None = None, resources: str | None = None, layout_engine: str | None = None, symbolic: str | None = None,
) -> DataFrame:
    """`df` with quality_score, quality_status, quality_reasons, quality_warnings and the eight counts behind them.

    Arguments name columns; those left out count as absent. A positive table or formula count in the metadata goes
    before the counted one; of images the greatest of metadata, counted and resources holds. Null bodies are empty.
    """
    col = lambda name: None if name is None else F.col(name)
    there = lambda name: F.lit(False) if name is None else F.coalesce(F.col(name).cast("string") != "", F.lit(False))
    given = lambda name, counted: counted if name is None else F.when(F.coalesce(F.col(name), F.lit(0)) > 0, F.col(name).cast("long")).otherwise(counted)
    counted = df.select(
        "*",
        F.length(T.visible_text(F.col(body))).cast("long").alias("text_length"), T.paragraphs(F.col(body)).alias("paragraph_count"),
        T.headings(F.col(body)).alias("heading_count"), given(table_count, T.tables(F.col(body))).alias("q_tables"),
        F.greatest(T.images(F.col(body)), _or(col(image_count), 0).cast("long"), F.lit(0).cast("long") if resources is None else F.coalesce(F.size(F.col(resources)), F.lit(0)).cast("long")).alias("q_images"),
        given(formula_count, T.formulas(F.col(body))).alias("q_formulas"), T.code_blocks(F.col(body)).alias("code_block_count"),
        _or(col(segments), 0).cast("long").alias("timeline_segment_count"),
    )
    m = {
        "text_length": F.col("text_length"), "paragraphs": F.col("paragraph_count"), "headings": F.col("heading_count"), "tables": F.col("q_tables"),
        "images": F.col("q_images"), "formulas": F.col("q_formulas"), "code_blocks": F.col("code_block_count"), "segments": F.col("timeline_segment_count"),
        "has_timeline": F.col("timeline_segment_count") > 0, "has_warning": there(warning), "has_url": there(url), "has_duration": there(duration),
        "has_language": there(language), "informative": T.informative_title(F.col(title)), "layout_engine": there(layout_engine), "symbolic": there(symbolic),
    }
    warned = counted.withColumn("quality_warnings", warnings_of(m)).withColumn("quality_reasons", reasons_of(m))
    n = F.size("quality_warnings")
    raw = F.when(m["has_timeline"], media_score(m)).otherwise(document_score(m)) - F.when(n > 0, F.least(F.lit(35), 10 + n * 8)).otherwise(0)
    scored = warned.withColumn("quality_score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(F.round(raw, 6), 1))))
    status = quality_status(F.col("quality_score"), n, F.array_contains("quality_warnings", "no_extractable_content"))
    return scored.withColumn("quality_status", status).withColumnsRenamed({"q_tables": "table_count_final", "q_images": "image_count_final", "q_formulas": "formula_count_final"})


def convert_text(docs: DataFrame, text: str = "text", fallback: Column | None = None) -> DataFrame:
    """Plain texts to title and Markdown body: normalised, the first short line as title, and cleaned without it."""
    plain = docs.withColumn("body", T.plain_text(F.col(text)))
    titled = plain.withColumn("title", T.inferred_title(F.col("body"), fallback if fallback is not None else F.lit("document")))
    return titled.withColumn("body", M.clean_markdown(F.col("body"), F.col("title")))
