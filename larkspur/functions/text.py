"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: white space that is trimmed from text nodes and titles, as a class of regular expressions.
BLANK = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
FNV_OFFSET, FNV_PRIME, UINT32 = 2166136261, 16777619, 4294967295


def tokenize(text: Column) -> Column:
    """Runs of ASCII letters and digits in lower case, in order, with repeats; null gives an empty list."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[a-zA-Z0-9]+"), F.lit(0))
    return F.transform(runs, F.lower)


def tokens_or(tokens: Column, content: Column) -> Column:
    """The supplied tokens as they are, unless null or empty; then the tokens of the content."""
    return F.when(F.size(F.coalesce(tokens, F.array())) > 0, tokens).otherwise(tokenize(content))


def document_id(url: Column) -> Column:
    """Identifier of the document at a url."""
    return F.sha1(F.encode(url, "UTF-8"))


def trim_space(text: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def fnv1a(token: Column) -> Column:
    """FNV-1a, 32 bits, of the UTF-8 bytes, as a non-negative BIGINT."""
    step = lambda h, b: (h.bitwiseXOR(b) * FNV_PRIME).bitwiseAND(F.lit(UINT32))
    start = F.lit(FNV_OFFSET).cast("bigint")

    def places(n: Column) -> Column:
        return F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))

    plain = F.aggregate(
        places(F.length(token)), start, lambda h, i: step(h, F.ascii(F.substring(token, i, F.lit(1))).cast("bigint"))
    )
    digits = F.hex(F.encode(token, "UTF-8"))
    wide = F.aggregate(
        places(F.length(digits) / 2), start, lambda h, i: step(h, F.conv(F.substring(digits, i * 2 - 1, F.lit(2)), 16, 10).cast("bigint"))
    )
    return F.when(F.length(token) == F.octet_length(token), plain).otherwise(wide)


def snippet(content: Column, tokens: Column, before: int = 40, plain: int = 80) -> Column:
    """Surroundings of the first query token that occurs in the content, else its beginning.

    Positions are characters of the lower-cased content; null content gives an empty snippet.
    """
    text = F.coalesce(content, F.lit(""))
    at = F.get(F.filter(F.transform(tokens, lambda t: F.instr(F.lower(text), t)), lambda p: p > 0), F.lit(0))
    start = F.greatest(at - before, F.lit(1))
    end = F.least(at + before, F.length(text) + 1)
    return (
        F.when(text == "", F.lit(""))
        .when(at.isNull(), F.substring(text, 1, plain))
        .otherwise(F.substring(text, start, end - start))
    )
