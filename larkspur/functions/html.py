"""HTML extraction as Column expressions, and resolution of links."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import BLANK, trim_space

#: Pieces of a page: comments, declarations, raw-text elements cut at their tags, tags, text.
_PIECES = r"(?is)<!--.*?(?:-->|$)|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<title\b[^>]*>.*?</title\s*>|<textarea\b[^>]*>.*?</textarea\s*>|</?[a-zA-Z!?/][^>]*>|[^<]+|<"
_RAW = r"(?is)^<(script|style|title|textarea)\b[^>]*>(.*)</\1\s*>$"

#: A character reference, or text without one.
_REFERENCES = r"&#[xX][0-9a-fA-F]+;?|&#[0-9]+;?|&[a-zA-Z][a-zA-Z0-9]*;?|[^&]+|&"
#: The named references of HTML 5 as one literal; those that may lack their semicolon, longest first.
_NAMES = json.dumps(html5)
_BARE = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True))
#: What numbers of the C1 range stand for: the characters of Windows-1252.
_C1 = "".join(bytes([c]).decode("cp1252", "ignore") or chr(c) for c in range(128, 160))


def unescape(text: Column, attribute: bool = False) -> Column:
    """Text with its character references decoded as HTML 5 has it, in one pass.

    A name without its semicolon counts for the old names only; in an attribute not before a `=`, nor as
    the beginning of a longer name.
    """
    pattern = _REFERENCES.replace("[a-zA-Z0-9]*;?|", "[a-zA-Z0-9]*[;=]?|") if attribute else _REFERENCES
    pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when(F.startswith(p, F.lit("&#")), _number(p)).when(F.startswith(p, F.lit("&")), _name(p, attribute)).otherwise(p)), "")


def _name(p: Column, attribute: bool) -> Column:
    names = F.from_json(F.lit(_NAMES), "map<string,string>")
    whole = F.substring(p, 2, 64)
    if attribute:
        return F.coalesce(F.try_element_at(names, whole), p)
    bare = F.regexp_extract(whole, f"^(?:{_BARE})", 0)
    part = F.when(bare != "", F.concat(F.try_element_at(names, bare), F.substring(whole, F.length(bare) + 1, F.lit(1 << 30))))
    return F.coalesce(F.try_element_at(names, whole), F.when(F.length(p) <= 64, part), p)


def _number(p: Column) -> Column:
    hexed = F.regexp_extract(p, r"^&#[xX]0*([0-9a-fA-F]+)", 1)
    digits = F.regexp_extract(p, r"^&#0*([0-9]+)", 1)
    body = F.when(hexed != "", hexed).otherwise(digits)
    small = F.length(body) <= 8
    code = F.when(small & (hexed != ""), F.conv(hexed, 16, 10)).when(small & (digits != ""), digits).cast("bigint")
    bad = code.isNull() | (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(F.when(bad, F.lit(0xFFFD)).otherwise(code)), 8, "0")), "UTF-32")
    old = F.substring(F.lit(_C1), (code - 127).cast("int"), F.lit(1))
    return F.when(body == "", p).when(code.between(128, 159), old).otherwise(char)


def _pieces(html: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(_PIECES), F.lit(0))


def title(html: Column) -> Column:
    """The first title element whose trimmed text is not empty; else an empty string."""
    visible = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?(?:-->|$)|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>", "")
    found = F.regexp_extract_all(visible, F.lit(r"(?is)<title\b[^>]*>(.*?)(?:</title\s*>|$)"), F.lit(1))
    texts = F.filter(F.transform(found, lambda x: trim_space(F.when(F.contains(x, F.lit("&")), unescape(x)).otherwise(x))), lambda x: x != "")
    return F.coalesce(F.get(texts, F.lit(0)), F.lit(""))


def text(html: Column) -> Column:
    """All text nodes, each trimmed and followed by one blank; script and style text included."""
    def node(p: Column) -> Column:
        inner = F.when(p.rlike(_RAW), F.regexp_extract(p, _RAW, 2)).otherwise(p)
        code = p.rlike(r"(?i)^<(?:script|style)\b") & p.rlike(_RAW)  # no entities in code
        tag = p.rlike(r"^</?[a-zA-Z!?/]") & ~p.rlike(_RAW)
        return F.when(tag, F.lit("")).when(code | ~F.contains(p, F.lit("&")), inner).otherwise(unescape(inner))

    decoded = F.transform(_pieces(html), lambda p: trim_space(node(p)))
    kept = F.filter(decoded, lambda p: p != "")
    return F.when(F.size(kept) > 0, F.concat(F.array_join(kept, " "), F.lit(" "))).otherwise(F.lit(""))


def hrefs(html: Column) -> Column:
    """The first href of each anchor in document order, entities decoded, without removal of repeats."""
    shown = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?(?:-->|$)|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>", "")
    pattern = r"""(?is)<a(?=\s)(?:[^>"']|"[^"]*"|'[^']*')*?\shref\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""
    found = F.regexp_extract_all(shown, F.lit(pattern), F.lit(1))
    bare = F.transform(found, lambda x: F.regexp_replace(x, r"""^["']|["']$""", ""))
    return F.transform(bare, lambda x: F.when(F.contains(x, F.lit("&")), unescape(x, attribute=True)).otherwise(x))


def join_path(base: Column, link: Column) -> Column:
    """A relative link placed under its page: beside a file, below any other url."""
    cut = F.when(F.contains(base, F.lit("/")), F.regexp_replace(base, r"[^/]*$", "")).otherwise(F.concat(base, F.lit("/")))
    below = F.concat(F.regexp_replace(base, r"/+$", ""), F.lit("/"), F.regexp_replace(link, r"^/+", ""))
    return F.when(base == "", link).when(F.startswith(base, F.lit("file://")), F.concat(cut, link)).otherwise(below)


def resolve_link(base: Column, href: Column) -> Column:
    """An absolute http, https or file link as it is; any other link joined to the page's url."""
    absolute = F.startswith(href, F.lit("http://")) | F.startswith(href, F.lit("https://")) | F.startswith(href, F.lit("file://"))
    return F.when(absolute, href).otherwise(join_path(base, href))


def links(base: Column, html: Column) -> Column:
    """All resolved links of a page in document order."""
    return F.transform(hrefs(html), lambda h: resolve_link(base, h))


__all__ = ["BLANK", "hrefs", "join_path", "links", "resolve_link", "text", "title", "unescape"]
