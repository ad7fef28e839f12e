"""Text of HTML and XML, by patterns over the markup."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from passagemill.functions.text import clean_text

TAG = r"""<[!?/a-zA-Z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|<[!?/a-zA-Z][^>]*>"""
COMMENT = r"<!--.*?(?:-->|\z)"
HTML_DROPPED = rf"(?is){COMMENT}|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\z)|{TAG}"
XML_DROPPED = rf"(?s){COMMENT}|{TAG}"
# Entities replaced by built-in functions, ``&amp;`` last.
PLAIN_ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'",
    "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&amp;": "&",
}
OTHER_ENTITY = r"&(?!(?:lt|gt|quot|apos|#39|nbsp|copy|middot|amp);)(?:#|[a-zA-Z])"


def _decode_all(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def decode_entities(text: Column) -> Column:
    """Character references decoded; only rows with rarer ones leave the JVM."""
    rare = text.rlike(OTHER_ENTITY)
    plain = text
    for entity, char in PLAIN_ENTITIES.items():
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return F.when(rare, F.pandas_udf(_decode_all, "string")(F.when(rare, text))).otherwise(plain)


def without_html_tags(markup: Column) -> Column:
    """No scripts, styles, comments or tags; references still encoded."""
    return F.regexp_replace(markup, HTML_DROPPED, " ")


def without_xml_tags(markup: Column) -> Column:
    """All text nodes, CDATA included; references still encoded, and what CDATA holds is encoded too."""
    # Each section, or a stretch without one, is a piece; only sections hold text that is no markup.
    pieces = F.regexp_extract_all(markup, F.lit(r"(?s)(<!\[CDATA\[.*?\]\]>|(?:(?!<!\[CDATA\[.*?\]\]>).)++)"), F.lit(1))

    def encoded(piece: Column) -> Column:
        inner = F.regexp_extract(piece, r"(?s)\A<!\[CDATA\[(.*)\]\]>\z", 1)
        for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            inner = F.replace(inner, F.lit(char), F.lit(entity))
        return F.when(piece.rlike(r"(?s)\A<!\[CDATA\[.*\]\]>\z"), inner).otherwise(piece)

    held = F.when(F.contains(markup, F.lit("<![CDATA[")), F.array_join(F.transform(pieces, encoded), "")).otherwise(markup)
    return F.regexp_replace(held, XML_DROPPED, " ")


def markup_text(stripped: Column) -> Column:
    """Cleaned text of markup without its tags. Pass a column, not an
    expression: it is read several times."""
    return clean_text(decode_entities(stripped))
