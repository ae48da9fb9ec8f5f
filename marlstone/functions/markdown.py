"""Markdown in order, line by line: one pass that the page parser and the column form share."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Lines that lead past a page's navigation, and the section for agents with its last sentence.
SKIP_LINES = ("跳转到主要内容", "skip to main content", "openai 在 chatgpt 中打开", "open in chatgpt")
AGENT_HEADING = "documentation index"
AGENT_END = "use this file to discover all available pages before exploring further"
AGENT_CHARS = 1200
#: A heading whose text stands below its marks is joined with it up to this length.
TORN_CHARS = 141


def key_of(text: str) -> str:
    """Letters and digits alone, in lower case."""
    return re.sub(r"[\W_]+", "", text).lower()


def marks(line: str) -> int:
    """How many heading marks a line begins with, 0 where it is no heading."""
    n = len(line) - len(line.lstrip("#"))
    return n if n <= 6 and (len(line) == n or line[n].isspace()) else 0


def whole_headings(lines: list[str]) -> Iterator[str]:
    """The lines, bare heading marks taken together with the next line of text where that can be their heading; the blank
    lines below go."""
    at = 0
    while at < len(lines):
        line, after = lines[at], at + 1
        if line.startswith("#") and line.strip() == "#" * marks(line.strip()):
            while after < len(lines) and not lines[after].strip():
                after += 1
            if after < len(lines) and lines[after][0] not in "#`" and len(lines[after].rstrip()) <= TORN_CHARS:
                yield f"{line.strip()} {lines[after].rstrip()}"
                at = after + 1
                while at < len(lines) and not lines[at].strip():
                    at += 1
                continue
        yield line
        at += 1


def without_agent_index(text: str) -> str:
    """Without the sections that tell agents where a site's index is, from their heading to their last sentence."""
    low = text.lower()
    if AGENT_HEADING not in low or AGENT_END not in low or len(low) != len(text):
        return text
    out, done, at = [], 0, 0
    while (begin := low.find(AGENT_HEADING, at)) >= 0:
        at = begin + len(AGENT_HEADING)
        line = low.rfind("\n", 0, begin) + 1
        head = low[line:begin].lstrip().removeprefix(">").strip()
        end = low.find(AGENT_END, at, at + AGENT_CHARS + len(AGENT_END))
        if not head or head != "#" * marks(head) or end < 0 or low[at : at + 1].isalnum() or line < done:
            continue
        at = end + len(AGENT_END)
        at += low[at : at + 1] == "."
        out += [text[done : max(done, line - 1)], "\n"]
        done = at
    return "".join([*out, text[done:]])


def without_title(lines: list[str], title: str) -> list[str]:
    """Without the first line of text, and the blank ones below, where that line says the title."""
    first = next((k for k, line in enumerate(lines) if line.strip()), None)
    if first is None or not title.strip():
        return lines
    line = lines[first].strip()
    if key_of(line[marks(line) :]) != key_of(title):
        return lines
    rest = first + 1
    while rest < len(lines) and not lines[rest].strip():
        rest += 1
    return lines[:first] + lines[rest:]


def without_bare_headings(lines: list[str]) -> list[str]:
    """Without heading marks that have no text, and the blank lines around them."""
    out: list[str] = []
    after = False
    for line in lines:
        bare = line.strip()
        if bare and bare == "#" * marks(bare):
            while out and not out[-1].strip():
                out.pop()
            after = True
        elif bare or not after:
            out.append(line)
            after = False
    return out


def spaced(lines: list[str]) -> str:
    """The lines with one blank line where there were any, and before headings of the second level on and fences; none after
    a line that ends in a fence."""
    out: list[str] = []
    gap = False
    for line in lines:
        line = line.rstrip(" \t")
        if not line:
            gap = True
            continue
        apart = gap or line[0] in "`#" and (line.startswith("```") or marks(line) >= 2 and " " in line)
        if apart and out and not out[-1].endswith("```"):
            out.append("")
        out.append(line)
        gap = False
    return "\n".join(out).strip()


def clean(text: str | None, title: str | None = "") -> str:
    """Markdown without odd blanks, torn headings, agent sections, skip links, its own title, empty headings and surplus
    blank lines. Null and empty texts are empty; a null title says nothing."""
    text = (text or "").replace("\u200b", "").replace("\xa0", " ").replace("\r\n", "\n").replace("\r", "\n")
    lines = text.split("\n")
    if "#" in text:
        lines = list(whole_headings(lines))
        lines = without_agent_index("\n".join(lines)).split("\n")
    # only a short line can lead past the navigation
    lines = [x for x in lines if len(x) > 80 or " ".join(x.split()).lower() not in SKIP_LINES]
    lines = without_title(lines, title or "")
    return spaced(without_bare_headings(lines) if "#" in text else lines)


def clean_markdown(c: Column, title: Column) -> Column:
    """`clean` of whole columns."""

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series, titles: pd.Series) -> pd.Series:
        return pd.Series([clean(a, b) for a, b in zip(texts, titles)], dtype=object)

    return cleaned(c, title)
