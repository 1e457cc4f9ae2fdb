"""Text helpers over whole documents, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talus import params as P
from talus.functions.columns import col

# White space as browsers see it (Java's \s is ASCII only).
WS = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, rf"^{WS}+|{WS}+$", "")


def _utf16_unit(code: Column) -> Column:
    unit = F.pmod(code, F.lit(65536))
    lone = unit.between(0xD800, 0xDFFF)
    text = F.decode(F.unhex(F.lpad(F.hex(F.when(lone, 0xFFFD).otherwise(unit)), 4, "0")), "UTF-16BE")
    return text


def decode_numeric(x: Column, hexadecimal: bool = False) -> Column:
    """Replace numeric character references. Linear in the text: split once, decode the
    codes, and zip the pieces back together. The last 16 digits tell a code modulo 65536."""
    pat, grp = (r"(?i)&#x([0-9a-f]+);", 1) if hexadecimal else (r"&#(\d+);", 1)
    codes = F.regexp_extract_all(x, F.lit(pat), F.lit(grp))
    base = 16 if hexadecimal else 10
    chars = F.transform(
        codes, lambda c: _utf16_unit(F.conv(F.substring(F.concat(F.lit("0" * 16), c), -16, 16), base, 10).cast("bigint"))
    )
    pieces = F.split(x, pat, -1)
    glued = F.array_join(
        F.zip_with(pieces, chars, lambda p, c: F.concat(p, F.coalesce(c, F.lit("")))), ""
    )
    return F.when(x.rlike(pat), glued).otherwise(x)


def html_to_text(html: Column | str) -> Column:
    """Markup to readable text: scripts and styles go, block ends become line breaks, other
    tags become blanks, entities are decoded, white space collapses."""
    t = col(html)
    t = F.regexp_replace(t, r"(?i)<(script|style)[\s\S]*?</\1>", " ")
    t = F.regexp_replace(t, r"(?i)<(br|/p|/div|/tr|/h[1-6]|/li)[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    for name, char in (("nbsp", " "), ("amp", "&"), ("lt", "<"), ("gt", ">")):
        t = F.regexp_replace(t, rf"(?i)&{name};", char)
    t = decode_numeric(t)
    t = decode_numeric(t, hexadecimal=True)
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, rf"{WS}*\n{WS}*", "\n")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return strip(t)


def decode_feed(x: Column) -> Column:
    """Entities as they occur in feeds: & < > numeric, then quotes."""
    for name, char in (("amp", "&"), ("lt", "<"), ("gt", ">")):
        x = F.regexp_replace(x, f"&{name};", char)
    x = decode_numeric(x)
    x = F.regexp_replace(x, "&quot;", '"')
    return F.regexp_replace(x, "&apos;", "'")


def short_name(name: Column | str) -> Column:
    """Company name without one trailing legal suffix, commas and full stops."""
    x = F.regexp_replace(col(name), rf"(?i),?{WS}*(inc|corp|corporation|ltd|plc|co|llc)\.?$", "")
    return strip(F.regexp_replace(x, r"[,.]", ""))


def section_extract(
    text: Column | str,
    start_pattern: str = P.SECTION_START_PATTERN,
    end_pattern: str = P.SECTION_END_PATTERN,
    min_tail: int = 5000,
    heading_chars: int = 40,
    min_body: int = 1000,
    fallback_chars: int = 60_000,
) -> Column:
    """Last occurrence of a heading with more than ``min_tail`` characters after it, up to the
    next closing heading when that lies past ``min_body``. Struct of (text, found, start),
    ``start`` 0-based.

    Works on the text split at the headings, so each document is scanned once however many
    headings it holds.
    """
    t = col(text)
    start_re, end_re = f"(?i){start_pattern}", f"(?i){end_pattern}"
    heads = F.regexp_extract_all(t, F.lit(start_re), F.lit(0))
    pieces = F.split(t, start_re, -1)
    # Running length up to each heading, as one pass over the pieces.
    marks = F.aggregate(
        F.zip_with(F.slice(pieces, 1, F.size(heads)), heads, lambda p, h: F.struct(F.length(p).alias("p"), F.length(h).alias("h"))),
        F.struct(F.lit(0).alias("at"), F.lit(-1).alias("best")),
        lambda acc, m: F.struct(
            (acc["at"] + m["p"] + m["h"]).alias("at"),
            F.when(F.length(t) - (acc["at"] + m["p"]) > min_tail, acc["at"] + m["p"])
            .otherwise(acc["best"])
            .alias("best"),
        ),
    )
    start = F.when(F.size(heads) > 0, marks["best"]).otherwise(F.lit(-1))
    rest = F.substring(t, start + heading_chars + 1, F.length(t))
    cut = F.length(F.element_at(F.split(rest, end_re, 2), 1))
    has_end = rest.rlike(end_re)
    body = F.when(has_end & (cut > min_body), F.substring(rest, F.lit(1), cut)).otherwise(rest)
    found = start >= 0
    return F.struct(
        F.when(found, F.concat(F.substring(t, start + 1, F.lit(heading_chars)), body))
        .otherwise(F.substring(t, 1, fallback_chars))
        .alias("text"),
        found.alias("found"),
        start.alias("start"),
    )


def text_cap(text: Column | str, limit: int) -> Column:
    """Struct of (text, truncated): the text cut at ``limit`` characters and whether it was longer."""
    t = col(text)
    return F.struct(F.substring(t, 1, limit).alias("text"), (F.length(t) > limit).alias("truncated"))


def name_mask(text: Column | str, ticker: Column | str, name: Column | str, mask: str = "Company A") -> Column:
    """Replace the ticker, the full name, then each name word of more than three letters, in
    that order and ignoring case."""
    words = F.filter(F.split(col(name), rf"({WS}|,)+", -1), lambda w: F.length(w) > 3)
    terms = F.concat(F.array(col(ticker), col(name)), words)
    return F.aggregate(
        terms,
        col(text),
        lambda acc, w: F.regexp_replace(
            acc, F.concat(F.lit("(?i)"), F.regexp_replace(w, r"([.*+?^${}()|\[\]\\])", r"\\$1")), F.lit(mask)
        ),
    )


def mentions(text: Column | str) -> Column:
    """Upper-case word tokens of one to five letters, an optional dollar sign removed."""
    found = F.regexp_extract_all(F.upper(col(text)), F.lit(r"\$?\b[A-Z]{1,5}\b"), F.lit(0))
    return F.transform(found, lambda t: F.replace(t, F.lit("$"), F.lit("")))
