"""Transcripts: timed segments to a timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as T

TARGET_CHARS = 700


def merged(segments: Column, target: int = TARGET_CHARS) -> Column:
    """An ordered array of (start, end, text) folded from the left: a segment joins the current one while that has fewer
    than `target` characters. One list operation for each recording; recordings are never joined."""
    kind = "array<struct<start:double,end:double,text:string>>"

    def step(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        grown = F.struct(last["start"].alias("start"), s["end"].alias("end"), T.normalized(F.concat_ws(" ", last["text"], s["text"])).alias("text"))
        fresh = F.concat(done, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"))))
        return F.when((F.size(done) > 0) & (F.length(F.try_element_at(done, F.lit(-1))["text"]) < target), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(grown))).otherwise(fresh)

    plain = F.transform(segments, lambda s: F.struct(s["start"].cast("double").alias("start"), s["end"].cast("double").alias("end"), F.trim(s["text"]).alias("text")))
    return F.aggregate(F.filter(plain, lambda s: F.coalesce(s["text"], F.lit("")) != ""), F.array().cast(kind), step)


def timeline(recordings: DataFrame, segments: str = "segments", text: str | None = None, duration: str | None = None) -> DataFrame:
    """`recordings` with timeline (array of start, end, title, text) and duration_label, the end of the last entry.

    Blank segments are dropped. Without any, a recording's whole text, where given, is one entry from 00:00."""
    entry = lambda s, i: F.struct(T.timestamp(s["start"]).alias("start"), T.timestamp(s["end"]).alias("end"), T.segment_title(i + 1, s["text"]).alias("title"), s["text"].alias("text"))
    out = recordings.withColumn("timeline", F.transform(merged(F.col(segments)), entry))
    if text is not None:
        whole = F.array(F.struct(F.lit("00:00").alias("start"), T.timestamp(F.col(duration) if duration else F.lit(None).cast("double")).alias("end"), F.lit("full transcript").alias("title"), F.trim(F.col(text)).alias("text")))
        out = out.withColumn("timeline", F.when((F.size("timeline") == 0) & (T.text0(F.col(text)) != ""), whole).otherwise(F.col("timeline")))
    return out.withColumn("duration_label", F.try_element_at("timeline", F.lit(-1))["end"])


def conversations_as_recordings(turns: DataFrame, seconds: int = 5) -> DataFrame:
    """Conversations (conv_id, turn, text) as recordings with a segment of `seconds` for each turn."""
    order = F.array_sort(F.collect_list(F.struct("turn", "text")))
    timed = F.transform(order, lambda x, i: F.struct((i * seconds).cast("double").alias("start"), ((i + 1) * seconds).cast("double").alias("end"), x["text"].alias("text")))
    return turns.groupBy("conv_id").agg(timed.alias("segments"))


def convert_audio(recordings: DataFrame, provider: str = "LocalWhisperProvider") -> DataFrame:
    """Transcribed `recordings` (filename, segments, text, language, duration) as conversions: title, body (the entries'
    texts, a blank line between them), timeline, language, duration and the counts of the metadata. Recordings without
    segments have their whole text; null ones have an empty body."""
    timed = timeline(recordings, "segments", "text", "duration")
    body = F.array_join(F.transform("timeline", lambda e: e["text"]), "\n\n")
    name = F.element_at(F.split("filename", "/"), -1)
    return timed.select(
        F.regexp_replace(name, r"(?<=.)\.[^.]*$", "").alias("title"), F.lit("audio").alias("source_type"), body.alias("body"), "timeline", "language",
        F.coalesce("duration_label", F.when(F.col("duration").isNotNull(), T.timestamp(F.col("duration")))).alias("duration"),
        F.struct(F.lit("audio").alias("converter"), F.lit(provider).alias("asr_provider"), F.size("timeline").alias("segment_count"), F.length(body).alias("character_count"), name.alias("input_filename")).alias("metadata"),
    )


def asr_provider(setting: Column) -> Column:
    """The provider that a setting names."""
    return F.when(setting == "cloud_openai_compatible", "CloudOpenAICompatibleProvider").otherwise("LocalWhisperProvider")


def process_error(stderr: Column, stdout: Column, code: Column, most: int = 800) -> Column:
    """The last characters of what a failed process said, or its exit code."""
    said = F.btrim(F.coalesce(F.nullif(stderr, F.lit("")), F.nullif(stdout, F.lit("")), F.lit("")))
    return F.when(said == "", F.concat(F.lit("exit code "), code.cast("string"))).when(F.length(said) > most, F.substring(said, -most, most)).otherwise(said)
