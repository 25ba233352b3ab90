"""Paragraphs of HTML pages as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkweave.functions.text import strip

#: Character references that are resolved, the ampersand last.
REFERENCES = {"&nbsp;": "\xa0", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&middot;": "·", "&copy;": "©", "&mdash;": "—", "&ndash;": "–", "&hellip;": "…", "&amp;": "&"}
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
OPEN, CLOSE, TAG = r"(?i)<p(?:\s[^>]*)?>", r"(?is)(?:</p\s*>|</div\s*>|</article\s*>|</body\s*>).*$", r"(?s)<[^>]*>"


def unescape(text: Column) -> Column:
    for name, ch in REFERENCES.items():
        text = F.replace(text, F.lit(name), F.lit(ch))
    return text


def paragraphs(html: Column) -> Column:
    """``array<string>``: the stripped text of each ``<p>`` in order; an open one ends at the next or with its block.

    Script, style and comments are left out. Null gives null, a page without paragraphs an empty array.
    """
    parts = F.split(F.regexp_replace(html, HIDDEN, ""), OPEN)
    inner = F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))
    return F.transform(inner, lambda p: strip(unescape(F.regexp_replace(F.regexp_replace(p, CLOSE, ""), TAG, ""))))


def page_text(html: Column) -> Column:
    """The paragraphs' text joined by line feeds."""
    return F.array_join(paragraphs(html), "\n")
