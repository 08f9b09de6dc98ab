"""Visible text of HTML pages."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_HIDDEN = {"script", "style", "noscript"}
_BREAKS = {"p", "div", "br", "li", "ul", "ol", "section", "article", "nav", "header", "footer", "table", "pre", "blockquote"}
_HEADINGS = {f"h{i}": "#" * i for i in range(1, 7)}


class _Visible(HTMLParser):
    """Lines of what a reader sees; headings marked by #, table rows as `TABLE | a | b`."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[str] = []
        self.line: list[str] = []
        self.row: list[str] | None = None
        self.hidden = 0
        self.mark = ""

    def end_line(self) -> None:
        text = " ".join("".join(self.line).split())
        if text:
            self.lines.append(f"{self.mark} {text}" if self.mark else text)
        self.line, self.mark = [], ""

    def handle_starttag(self, tag, attrs):
        if tag in _HIDDEN:
            self.hidden += 1
        elif tag == "tr":
            self.end_line()
            self.row = []
        elif tag in ("td", "th"):
            self.line = []
        elif tag in _HEADINGS:
            self.end_line()
            self.mark = _HEADINGS[tag]
        elif tag in _BREAKS and self.row is None:
            self.end_line()

    def handle_endtag(self, tag):
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in ("td", "th") and self.row is not None:
            self.row.append(" ".join("".join(self.line).split()))
            self.line = []
        elif tag == "tr" and self.row is not None:
            if any(self.row):
                self.lines.append("TABLE | " + " | ".join(self.row))
            self.row, self.line = None, []
        elif tag in _HEADINGS or (tag in _BREAKS and self.row is None):
            self.end_line()

    def handle_data(self, data):
        if not self.hidden:
            self.line.append(data)


def visible(html: str | None) -> str | None:
    if html is None:
        return None
    parser = _Visible()
    parser.feed(html)
    parser.close()
    parser.end_line()
    return "\n".join(parser.lines)


def _all_visible(html: pd.Series) -> pd.Series:
    return html.map(visible)


def visible_text(html: Column | str) -> Column:
    """Text of an HTML column; an Arrow-batched UDF, since a tag parser has no column form."""
    return F.pandas_udf(_all_visible, "string")(html)
