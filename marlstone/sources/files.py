"""Files as tables: delimited text with its delimiter found, DOCX, plain and HTML files; results as folders of files."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import markdown as M
from marlstone.functions import text as T
from marlstone.operators import quality as Q

DELIMITERS = (",", ";", "\t", "|")
SNIFF_CHARS = 4096


def delimiter(head: str) -> str:
    """The delimiter that parts the first lines into equally many cells; comma where none does."""
    lines = [x for x in head[:SNIFF_CHARS].splitlines() if x.strip()][:20]
    best = (0, 0, ",")
    for d in DELIMITERS:
        counts = [len(next(csv.reader([x], delimiter=d), [])) - 1 for x in lines]
        if counts and min(counts) > 0:
            best = max(best, (sum(c == counts[0] for c in counts), counts[0], d), key=lambda x: x[:2])
    return best[2]


def csv_rows(content: str | None) -> list[list[str]]:
    """All rows, of whatever length; cells have single blanks. A byte-order mark is dropped."""
    body = (content or "").lstrip("﻿")
    return [[re.sub(r"\s+", " ", c).strip() for c in row] for row in csv.reader(io.StringIO(body, newline=""), delimiter=delimiter(body)) if row]


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of whole text files as UTF-8: badly encoded bytes are replaced, a byte-order mark goes."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    return raw.select("path", decoded(F.col("content")).alias("content"))


def decoded(content: Column) -> Column:
    """Bytes as text; what is no UTF-8 becomes the replacement sign."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), r"^\x{FEFF}", "")


def convert_csv(files: DataFrame) -> DataFrame:
    """(path, content) to path, body (a Markdown table), table_count and row_count (without the header)."""

    @F.pandas_udf("array<array<string>>")
    def rows(content: pd.Series) -> pd.Series:
        return content.map(csv_rows)

    parsed = files.withColumn("rows", rows("content"))
    return parsed.select("path", T.markdown_table(F.col("rows")).alias("body"), F.when(F.size("rows") > 0, 1).otherwise(0).alias("table_count"), F.greatest(F.size("rows") - 1, F.lit(0)).alias("row_count"))


# Where HTML files keep their content.
FILE_PLACES = ("article", "main", "[role=main]", "#content", ".content", ".post", ".article", ".entry-content", ".markdown-body", ".prose", "section", "div")


def convert_html(files: DataFrame) -> DataFrame:
    """(path, content) of HTML files to path, title and body: the best-scored place for content, without noise."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from marlstone.sources import html as H

        def one(html: str) -> tuple[str, str]:
            root = H.measure(H.parse(html))
            meta = H.metadata(root)
            heads = [x.text() for x in (*root.nodes("h1")[:1], *root.nodes("title")[:1])]
            title = next((t for t in [*heads, meta.get("og:title", ""), meta.get("twitter:title", "")] if t), "document")
            found = [n for s in FILE_PLACES for n in root.select(s)] + root.nodes("body")
            places = list({id(n): n for n in found}.values()) or [root]
            stream = H.Stream(root, "")
            best = max(places, key=lambda n: file_score(n, stream if id(n) in stream.range else H.Stream(n, "")))
            return title, best.markdown()

        def file_score(n, stream) -> float:
            """Text and structure for a place, links and noise against it; counts are those of what cleaning leaves."""
            size = n.length()
            if not size:
                return -1000.0
            f, *_ = H.tree_features(n, stream)
            own = [x for x in n.live() if not isinstance(x, str)]
            paragraphs = sum(x.tag == "p" and x.length() >= 20 for x in own)
            heads, code = (sum(x.tag in tags for x in own) for tags in (("h1", "h2", "h3", "h4"), ("pre", "code")))
            worth = min(size, 30000) / 80 + 16 * paragraphs + 8 * heads + 18 * f["TB"] + 12 * code + 3 * sum(x.tag == "img" for x in own)
            return worth - 180 * max(0.0, f["A"] / size - 0.35) - 80 * H.is_noise(n)

        for pdf in batches:
            got = [one(x or "") for x in pdf.content]
            yield pd.DataFrame({"path": pdf.path, "title": [t for t, _ in got], "body": [b for _, b in got]})

    found = files.select("path", "content").mapInPandas(run, "path string, title string, body string")
    return found.withColumn("body", M.clean_markdown(F.col("body"), F.col("title")))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


_BLIP = "{http://schemas.openxmlformats.org/drawingml/2006/main}blip"


def docx_images(data: bytes) -> dict[str, tuple[str, bytes]]:
    """By relation, the name and bytes of a DOCX file's images; the second of a name gets -2 before its ending, and so on."""
    out: dict[str, tuple[str, bytes]] = {}
    used: set[str] = set()
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if "word/_rels/document.xml.rels" not in z.namelist():
            return out
        for r in ElementTree.fromstring(z.read("word/_rels/document.xml.rels")):
            target = (r.get("Target") or "").lstrip("/").removeprefix("word/")
            if not (r.get("Type") or "").endswith("/image") or f"word/{target}" not in z.namelist():
                continue
            stem, dot, ending = target.rpartition("/")[2].rpartition(".")
            stem, ending = (stem, ending) if dot else (ending, "bin")
            names = (f"{stem or 'image'}{f'-{k}' if k > 1 else ''}.{ending}" for k in range(1, len(used) + 2))
            name = next(n for n in names if n not in used)
            used.add(name)
            out[r.get("Id")] = name, z.read(f"word/{target}")
    return out


def docx_markdown(data: bytes) -> tuple[str, str, int]:
    """(title, body, number of tables) of a DOCX file: paragraphs, images and tables in order, headings by style, bold,
    italic and links inline. A first heading of level 1 is the title."""
    images = docx_images(data)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        links = {}
        if "word/_rels/document.xml.rels" in z.namelist():
            links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("word/_rels/document.xml.rels"))}

    def run(r) -> str:
        text = "".join(x.text or "" if x.tag == f"{_W}t" else "\t" if x.tag == f"{_W}tab" else "\n" if x.tag in (f"{_W}br", f"{_W}cr") else "" for x in r)
        props = r.find(f"{_W}rPr")
        on = lambda name: props is not None and (p := props.find(_W + name)) is not None and p.get(f"{_W}val", "1") not in ("0", "false")
        style = props.find(f"{_W}rStyle") if props is not None else None
        core, style = text.strip(), (style.get(f"{_W}val", "") if style is not None else "").lower()
        if not core:
            return text
        mark = "`" if "code" in style else "**" * on("b") + "*" * on("i")
        return text[: len(text) - len(text.lstrip())] + mark + core + mark[::-1] + text[len(text.rstrip()) :]

    def paragraph(p) -> str:
        parts = []
        for x in p:
            if x.tag == f"{_W}r":
                parts.append(run(x))
            elif x.tag == f"{_W}hyperlink":
                label = "".join(run(r) for r in x.findall(f"{_W}r"))
                target = links.get(x.get(f"{_R}id"))
                parts.append(f"[{label}]({target})" if target and label.strip() else label)
        return "".join(parts).strip()

    def level(p) -> int:
        style = p.find(f"{_W}pPr/{_W}pStyle")
        name = (style.get(f"{_W}val", "") if style is not None else "").lower()
        m = re.fullmatch(r"(?:heading|标题)\s*([1-6])", name)
        return int(m[1]) if m else 1 if name == "title" else 0

    from marlstone.sources.html import table

    out, tables = [], 0
    for x in body if body is not None else ():
        if x.tag == f"{_W}p":
            text = paragraph(x)
            if text:
                out.append("#" * level(x) + " " * (level(x) > 0) + text)
            shown = [images[i][0] for b in x.iter(_BLIP) if (i := b.get(f"{_R}embed")) in images]
            out += [f"![{name}](./assets/{name})" for name in shown]
        elif x.tag == f"{_W}tbl":
            rows = [[" ".join(filter(None, map(paragraph, c.iter(f"{_W}p")))).replace("|", "\\|") for c in r.findall(f"{_W}tc")] for r in x.findall(f"{_W}tr")]
            if rows:
                tables += 1
                out.append(table(rows))
    title = out[0][2:] if out and out[0].startswith("# ") else ""
    return title, "\n\n".join(out), tables


def convert_docx(files: DataFrame) -> DataFrame:
    """`files` (path, content binary) to path, title, body and table_count; a file that is no DOCX has a null body."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = []
            for data in pdf.content:
                try:
                    got.append(docx_markdown(bytes(data)))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, TypeError):
                    got.append((None, None, 0))
            yield pd.DataFrame({"path": pdf.path, "title": [g[0] for g in got], "body": [g[1] for g in got], "table_count": [g[2] for g in got]})

    return files.select("path", "content").mapInPandas(run, "path string, title string, body string, table_count int")


def convert_text(files: DataFrame) -> DataFrame:
    return Q.convert_text(files.withColumnRenamed("content", "text"), fallback=F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1)).select("path", "title", "body")


def convert(files: DataFrame) -> DataFrame:
    """`files` (path, content binary) of all kinds to path, source_type, title and body, each kind by its own converter."""
    from marlstone.operators.jobs import EXTENSIONS, extension

    known = F.create_map(*[F.lit(x) for p in EXTENSIONS.items() for x in p])
    typed = files.withColumn("source_type", F.try_element_at(known, extension(F.col("path"))))
    text = typed.withColumn("content", decoded(F.col("content")))
    of = lambda df, kind, f: f(df.where(F.col("source_type") == kind)).select("path", F.lit(kind).alias("source_type"), *([F.lit(None).cast("string").alias("title")] if kind == "csv" else ["title"]), "body")
    return of(text, "text", convert_text).unionByName(of(text, "html", convert_html)).unionByName(of(text, "csv", convert_csv)).unionByName(of(typed, "docx", convert_docx))


# The headings of rendered files, what stands for missing parts, and the folder of assets.
HEADINGS = {"summary": "摘要", "body": "正文", "resources": "资源", "timeline": "时间轴"}
MISSING = {"summary": "暂无摘要。", "body": "未提取到正文内容。", "resources": "- 图片资源：\n- 附件：", "timeline": "未生成转写时间轴。", "segment": "转写片段"}
ASSETS = "./assets"


def front_matter(fields: dict[str, Column]) -> Column:
    """A YAML header of the fields that have a value, in their order, each as a quoted text."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))
    lines = [F.when(F.coalesce(c.cast("string"), F.lit("")) != "", F.concat(F.lit(f"{k}: "), quoted(c.cast("string")))) for k, c in fields.items()]
    return F.concat_ws("\n", F.lit("---"), *lines, F.lit("---"))


def _or_missing(c: Column, part: str) -> Column:
    said = F.btrim(T.text0(c), F.lit(" \n\t\r"))
    return F.when(said == "", F.lit(MISSING[part])).otherwise(said)


def render_document(
    title: Column, source_type: Column, body: Column, as_of: Column, summary: Column | None = None, url: Column | None = None, author: Column | None = None,
    created_at: Column | None = None, resources: Column | None = None, headings: dict[str, str] = HEADINGS,
) -> Column:
    """The Markdown file of a conversion: header, title, summary, body and resources (lines), the original address first.
    The time is the caller's; null parts are stood for."""
    none = F.lit(None).cast("string")
    or_none = lambda c: none if c is None else c
    head = front_matter({"title": title, "source_type": source_type, "source_url": or_none(url), "author": or_none(author), "created_at": or_none(created_at), "converted_at": F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ssXXX"), "assets_dir": F.lit(ASSETS)})
    link = F.when(F.coalesce(or_none(url), F.lit("")) != "", F.concat(F.lit("- 原始链接："), or_none(url)))
    listed = F.concat_ws("\n", link, F.array_join(F.coalesce(resources, F.array().cast("array<string>")), "\n") if resources is not None else none)
    listed = F.regexp_replace(listed, r"\n$", "")
    section = lambda name, c: F.concat(F.lit(f"## {headings[name]}\n\n"), c)
    parts = (head, F.concat(F.lit("# "), title), section("summary", _or_missing(T.summary(body) if summary is None else summary, "summary")), section("body", _or_missing(body, "body")), section("resources", F.when(listed == "", F.lit(MISSING["resources"])).otherwise(listed)))
    return F.concat(F.concat_ws("\n\n", *parts), F.lit("\n"))


def render_media(title: Column, source_type: Column, timeline: Column, as_of: Column, summary: Column, url: Column | None = None, duration: Column | None = None, language: Column | None = None, headings: dict[str, str] = HEADINGS) -> Column:
    """The Markdown file of a recording: header, title, summary and its timeline (start, end, title, text), an entry a
    section."""
    none = F.lit(None).cast("string")
    or_none = lambda c: none if c is None else c
    head = front_matter({"title": title, "source_type": source_type, "source_url": or_none(url), "duration": or_none(duration), "language": or_none(language), "converted_at": F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ssXXX"), "assets_dir": F.lit(ASSETS)})
    entry = lambda e: F.concat(F.lit("### "), F.coalesce(e["start"], F.lit("00:00")), F.lit(" - "), F.coalesce(e["end"], F.lit("")), F.lit(" "), F.coalesce(F.nullif(e["title"], F.lit("")), F.lit(MISSING["segment"])), F.lit("\n\n"), F.btrim(T.text0(e["text"])))
    told = F.when(F.coalesce(F.size(timeline), F.lit(0)) > 0, F.array_join(F.transform(timeline, entry), "\n")).otherwise(F.lit(MISSING["timeline"]))
    parts = (head, F.concat(F.lit("# "), title), F.concat(F.lit(f"## {headings['summary']}\n\n"), _or_missing(summary, "summary")), F.concat(F.lit(f"## {headings['timeline']}\n\n"), told))
    return F.concat(F.concat_ws("\n\n", *parts), F.lit("\n"))


def stats_metadata(converter: Column, counts: dict[str, Column]) -> Column:
    """The nine fields of a conversion's counts as a map; missing ones are 0."""
    names = ("paragraph_count", "heading_count", "table_count", "row_count", "image_count", "formula_count", "page_count", "character_count")
    pairs = [x for n in names for x in (F.lit(n), F.coalesce(counts.get(n, F.lit(0)), F.lit(0)).cast("string"))]
    return F.create_map(F.lit("converter"), converter, *pairs)


def image_extension(content_type: Column, url: Column) -> Column:
    """The ending of an image's file: by its type, else its address's, else .img; JPEG is .jpg."""
    import mimetypes

    kinds = sorted({k for k in mimetypes.types_map.values() if k.startswith("image/")})
    known = F.create_map(*[F.lit(x) for k in kinds for x in (k, mimetypes.guess_extension(k) or ".img")])
    path = F.regexp_extract(F.regexp_replace(T.text0(url), r"[?#].*$", ""), r"/[^/]*[^/.](\.[^./]+)$", 1)
    found = F.coalesce(F.try_element_at(known, F.lower(content_type)), F.nullif(path, F.lit("")), F.lit(".img"))
    return F.when(found.isin(".jpe", ".jpeg"), ".jpg").otherwise(found)


def local_images(images: DataFrame, downloaded: DataFrame) -> DataFrame:
    """`images` (page, url) with local, where each is to be found: its file, where `downloaded` (page, url, path) has one,
    else its address."""
    have = downloaded.groupBy(F.col("page").alias("d_page"), F.col("url").alias("d_url")).agg(F.min("path").alias("path"))
    return images.join(have, (F.col("page") == F.col("d_page")) & (F.col("url") == F.col("d_url")), "left").withColumn("local", F.coalesce("path", "url")).drop("d_page", "d_url", "path")


def append_log(lines: DataFrame, path: str) -> None:
    """Log lines (job_id, at, message) added to a table of them; what is there stays."""
    lines.select("job_id", "at", "message").write.mode("append").parquet(path)


def write_results(results: DataFrame, path: str) -> None:
    """Results (job_id, markdown and, if there, metadata) as one Parquet table: as many files as the data fills."""
    columns = [c for c in ("job_id", "markdown", "metadata") if c in results.columns]
    results.select(*columns).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_result_files(results: DataFrame, path: str) -> None:
    """The results (job_id, markdown, metadata as JSON, and assets, an array of name and content) of an asked-for few jobs as
    a folder for each: result.md, metadata.json, assets and result.zip of them all. Each task writes its own rows."""

    def write(rows) -> None:
        import os

        for r in rows:
            folder = os.path.join(path, str(r.job_id))
            os.makedirs(os.path.join(folder, "assets"), exist_ok=True)
            parts = {"result.md": (r.markdown or "").encode(), "metadata.json": (r.metadata or "{}").encode()}
            parts |= {f"assets/{os.path.basename(a['name'])}": bytes(a["content"]) for a in r.assets or []}
            for name, data in parts.items():
                with open(os.path.join(folder, name), "wb") as out:
                    out.write(data)
            with zipfile.ZipFile(os.path.join(folder, "result.zip"), "w", zipfile.ZIP_DEFLATED) as z:
                for name, data in sorted(parts.items()):
                    z.writestr(name, data)

    none = F.array().cast("array<struct<name:string,content:binary>>")
    assets = F.coalesce(F.col("assets"), none) if "assets" in results.columns else none
    results.select("job_id", "markdown", "metadata", assets.alias("assets")).foreachPartition(write)


def storage_bytes(spark: SparkSession, path: str) -> DataFrame:
    """Sizes of all files below a path, without reading them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("storage_bytes"))
