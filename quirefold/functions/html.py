"""HTML to text, headings and links, as columns for well-formed input and as an Arrow function for any."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clean import _col, strip

# Elements that begin a line.
BLOCKS = "p|div|h1|h2|h3|h4|h5|h6|br|li"
SKIPPED = ("script", "style", "head")
# The entities that the column form decodes; & comes last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&hellip;": "…", "&mdash;": "—", "&ndash;": "–", "&amp;": "&"}


def drop_subtrees(c: Column | str) -> Column:
    t = _col(c)
    for tag in SKIPPED:
        t = F.regexp_replace(t, rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>", "")
    return t


def decode_entities(c: Column | str) -> Column:
    t = _col(c)
    for a, b in ENTITIES.items():
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def body(c: Column | str) -> Column:
    """Inside of the body; all of it where there is none."""
    inner = F.regexp_extract(_col(c), r"(?is)<body(?:\s[^>]*)?>(.*?)(?:</body\s*>|\z)", 1)
    return F.when(_col(c).rlike(r"(?is)<body(?:\s[^>]*)?>"), inner).otherwise(_col(c))


def html_to_text(c: Column | str, drop_comments: bool = False) -> Column:
    """Text of well-formed HTML: a line feed where a block begins, other tags vanish, comments give their text."""
    t = body(drop_subtrees(c))
    t = F.regexp_replace(t, r"(?s)<!--(.*?)-->", "" if drop_comments else "$1")
    t = F.regexp_replace(t, rf"(?is)<(?:{BLOCKS})(?:\s[^>]*)?/?>", "\n")
    t = decode_entities(F.regexp_replace(t, r"(?s)</?[a-zA-Z!][^>]*>", ""))
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def heading(c: Column | str) -> Column:
    """First h1, if it is empty the first h2, then h3; null if none has text."""
    found = []
    for level in (1, 2, 3):
        inner = F.regexp_extract(_col(c), rf"(?is)<h{level}(?:\s[^>]*)?>(.*?)</h{level}\s*>", 1)
        found.append(F.nullif(strip(decode_entities(F.regexp_replace(inner, r"(?s)<[^>]*>", ""))), F.lit("")))
    return F.coalesce(*found)


def href_base(c: Column | str) -> Column:
    """What comes before the fragment."""
    return F.substring_index(_col(c), "#", 1)


class _Text(HTMLParser):
    def __init__(self, drop_comments: bool):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip: list[str] = []
        self.start: int | None = None
        self.drop_comments = drop_comments

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skip.append(tag)
        elif not self.skip:
            if tag == "body" and self.start is None:
                self.start = len(self.out)
            if tag in BLOCKS.split("|"):
                self.out.append("\n")

    def handle_endtag(self, tag):
        if self.skip and self.skip[-1] == tag:
            self.skip.pop()

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)

    def handle_comment(self, data):
        if not self.skip and not self.drop_comments:
            self.out.append(data)


def text_of_html(html: str | None, drop_comments: bool = False) -> str | None:
    """html_to_text() for any input, by a tolerant parser."""
    if html is None:
        return None
    p = _Text(drop_comments)
    p.feed(html)
    p.close()
    return re.sub(r"\n{3,}", "\n\n", "".join(p.out[p.start or 0 :])).strip()


def any_html_to_text():
    """html_to_text() for HTML that is not well formed, as an Arrow function of a column."""
    return F.pandas_udf(lambda s: s.map(text_of_html), "string")
