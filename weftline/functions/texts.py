"""Text segmentation."""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_PARAGRAPHS = 40
MAX_CHARS = 4096
MAX_WORDS = 128
#: fixed values: block tags whose end ends a paragraph, where a text comes with the ends of its blocks
NEWLINE_TAGS = (
    "address article aside blockquote canvas dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav "
    "noscript ol p pre section table tfoot ul video"
).split()
#: tags that break the paragraphs of a page read as markup: those, and what parts lines and rows there
BREAKING_TAGS = [*NEWLINE_TAGS, "br", "tr"]


def paragraphs(text: Column) -> Column:
    """Lines that are not blank, as they are, forty at most."""
    return F.slice(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"\S")), 1, MAX_PARAGRAPHS)


def first_sentence(text: Column) -> Column:
    return F.trim(F.regexp_extract(text, r"^[^.!?\n]*[.!?]?", 0))


def sentences(paragraph: Column) -> Column:
    """The whole paragraph if it is short enough for an encoder, else the sentences of its first 4096 characters."""
    cut = F.regexp_extract_all(F.substring(paragraph, 1, MAX_CHARS), F.lit(r"([^.!?]+[.!?]*)"), F.lit(1))
    parts = F.filter(F.transform(cut, lambda s: F.trim(s)), lambda s: s != "")
    return F.when(F.size(F.split(F.trim(paragraph), r"\s+")) <= MAX_WORDS, F.array(paragraph)).otherwise(parts)


def title_first_paragraph(title: Column, of: Column) -> Column:
    """The paragraphs with the title and the first of them put before; only the title if there are none."""
    return F.when(F.size(of) > 0, F.concat(F.array(F.concat(title, F.lit(" \n "), F.get(of, F.lit(0)))), of)).otherwise(F.array(title))


def html_paragraphs(html: Column) -> Column:
    """Paragraphs of a page by its block tags: other tags become a space, white space is drawn together."""
    inner = F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</(script|style|head)>|<!--.*?-->", " ")
    broken = F.regexp_replace(inner, rf"(?i)</?({'|'.join(BREAKING_TAGS)})\b[^>]*>", "\n")
    plain = F.regexp_replace(broken, r"<[^>]*>", " ")
    lines = F.transform(F.split(plain, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.filter(lines, lambda x: x != "")


def paragraphs_by_ends(text: str, ends: dict[str, list[int]]) -> list[str]:
    """Paragraphs of ``text`` whose blocks end at the given places (tag -> offsets).

    Where a block of a newline tag ends the paragraph is closed; where another ends, a space keeps words apart.  Line breaks
    go, with the spaces and tabs after them; of a run of spaces and tabs the first one stays."""
    closing: dict[int, bool] = {}
    for tag, places in sorted(ends.items()):
        for p in places:
            closing[p] = closing.get(p, False) or tag in NEWLINE_TAGS
    out, cut = [], [*sorted({0, *(p for p in closing if 0 <= p < len(text))}), len(text)] if text else []
    now, skip = "", False
    for a, b in zip(cut, cut[1:]):
        if a in closing and closing[a]:
            out.append(now)
            now = ""
        elif a in closing and text[a] != " ":
            now += " "
        for run in re.findall(r"\n|[ \t]+|[^\n \t]+", text[a:b]):
            if run == "\n":
                skip = True
            elif run[0] in " \t":
                now += "" if skip else run[0]
                skip = True
            else:
                now, skip = now + run, False
    return [p for p in (x.strip() for x in [*out, now]) if p]


def block_ends(html: str | None) -> tuple[str, dict[str, list[int]]]:
    """The text of a page without its tags, and where the blocks of each tag end in it."""
    text, ends, size = [], {}, 0
    for part in re.split(r"(<[^>]*>)", re.sub(r"(?is)<(script|style|head)\b.*?</\1>|<!--.*?-->", "", html or "")):
        tag = re.fullmatch(r"</([A-Za-z][A-Za-z0-9]*)[^>]*>|<(hr|br)\b[^>]*>", part, re.I)
        if tag:
            ends.setdefault((tag[1] or tag[2]).lower(), []).append(size)
        elif not part.startswith("<"):
            text.append(unescape(part))
            size += len(text[-1])
    return "".join(text), ends


def plain(html: str) -> str:
    return unescape(re.sub(r"<[^>]*>", "", html))
