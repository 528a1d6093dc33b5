"""HTML and model answers: what needs a parser runs in Arrow batches."""

from __future__ import annotations

import html
import json
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BREAKS = frozenset("address article blockquote br div dl dt dd figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tr ul".split())


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in ("script", "style")
        if tag in BREAKS:
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        if tag in BREAKS:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)


def text_of_html(raw: str | None) -> str | None:
    """Visible text, a line for each block, blanks made single; None if nothing is left."""
    if raw is None:
        return None
    parser = _Text()
    parser.feed(raw)
    parser.close()
    lines = (" ".join(line.split()) for line in "".join(parser.parts).split("\n"))
    return "\n".join(x for x in lines if x) or None


@F.pandas_udf(T.StringType())
def strip_html(raw: pd.Series) -> pd.Series:
    return raw.map(text_of_html, na_action="ignore")


@F.pandas_udf(T.StringType())
def unescape(raw: pd.Series) -> pd.Series:
    return raw.map(html.unescape, na_action="ignore")


def first_image(c: Column) -> Column:
    """Address of the first img; null if there is none or it isn't http(s)."""
    src = F.regexp_extract(c, r"""(?is)<img\b[^>]*?\bsrc\s*=\s*["']([^"']*)["']""", 1)
    return F.when(src.rlike(r"(?i)^https?://"), src)


def repair_cp850(text: str) -> str:
    """Undo UTF-8 read as CP850, where box-drawing characters betray it and it can be undone."""
    if not any("─" <= ch <= "╿" for ch in text):
        return text
    try:
        return text.encode("cp850").decode("utf-8")
    except (UnicodeEncodeError, UnicodeDecodeError):
        return text


@F.pandas_udf(T.StringType())
def fix_mojibake(raw: pd.Series) -> pd.Series:
    return raw.map(repair_cp850, na_action="ignore")


def balanced_object(text: str) -> str | None:
    """The first {...} whose braces balance outside strings."""
    for start in (m.start() for m in re.finditer(r"\{", text)):
        depth, quoted, skip = 0, False, False
        for i in range(start, len(text)):
            ch = text[i]
            if skip:
                skip = False
            elif quoted:
                skip, quoted = ch == "\\", ch != '"'
            elif ch == '"':
                quoted = True
            elif ch in "{}":
                depth += 1 if ch == "{" else -1
                if not depth:
                    return text[start : i + 1]
        return None
    return None


def object_in(text: str | None) -> str | None:
    """JSON object that the text is or holds, written anew; None if there is none."""
    for candidate in (text, balanced_object(text or "")):
        try:
            got = json.loads(candidate or "")
        except ValueError:
            continue
        return json.dumps(got, ensure_ascii=False) if isinstance(got, dict) else None
    return None


@F.pandas_udf(T.StringType())
def model_object(raw: pd.Series) -> pd.Series:
    """JSON object in an answer already stripped of reasoning."""
    return raw.map(object_in, na_action="ignore")
