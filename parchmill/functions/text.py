"""Byte-exact text expressions: length, cut at a boundary, excerpt, sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How far back a boundary is searched, and the excerpt size, in bytes.
SENTENCE_WINDOW = 100
PARAGRAPH_WINDOW = 50
EXCERPT_BYTES = 200


def byte_length(text: Column) -> Column:
    return F.octet_length(text).cast("bigint")


def _byte_view(text: Column, start: int, size: int) -> Column:
    """``size`` bytes from 1-based ``start``, as a string with one character per byte."""
    return F.decode(F.substring(text.cast("binary"), start, size), "ISO-8859-1")


def cut_position(text: Column, max_len: int) -> Column:
    """Number of bytes kept when ``text`` is longer than ``max_len``.

    A sentence end in the last 100 bytes wins; failing that, a blank line in
    the last 50; failing that, the limit itself. A sentence end on the very
    last byte gives ``max_len + 1``. Only the window is decoded, never the text.
    """
    lo = max(max_len - SENTENCE_WINDOW, 0)
    sentence = F.length(
        F.regexp_extract(_byte_view(text, lo + 1, max_len - lo + 1), r"(?s)^(.*[.!?])[ \n]", 1)
    )
    sentence_cut = F.when(sentence > 0, F.lit(lo + 1) + sentence).otherwise(F.lit(max_len))
    lo2 = max(max_len - PARAGRAPH_WINDOW, 1)
    paragraph = F.length(
        F.regexp_extract(_byte_view(text, lo2, max_len - lo2 + 1), r"(?s)^(.*\n\n)", 1)
    )
    paragraph_cut = F.when(paragraph > 0, F.lit(lo2 - 1) + paragraph).otherwise(F.lit(max_len))
    return F.when(sentence_cut != max_len, sentence_cut).otherwise(paragraph_cut).cast("bigint")


def take_bytes(text: Column, size: Column | int) -> Column:
    """The first ``size`` bytes, exactly, as BINARY."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.substr(text.cast("binary"), F.lit(1), size.cast("int"))


def whole_characters(data: Column) -> Column:
    """UTF-8 bytes as a string, without a character split at the end."""
    tail = F.decode(F.substr(data, F.lit(-3)), "ISO-8859-1")
    split = F.length(
        F.regexp_extract(
            tail,
            "(?s)([À-ß]|[à-ï][\u0080-¿]?|[ð-÷][\u0080-¿]{0,2})$",
            1,
        )
    )
    kept = F.substr(data, F.lit(1), F.octet_length(data) - split)
    return F.when(F.octet_length(data) == 0, F.lit("")).otherwise(kept.cast("string"))


def is_cut(text: Column, max_len: int | None, full: bool = False) -> Column:
    """True when ``truncate`` would shorten the text."""
    if full or not max_len or max_len <= 0:
        return F.lit(False)
    return F.octet_length(text) > max_len


def truncate(text: Column, max_len: int | None, full: bool = False, exact_bytes: bool = False) -> Column:
    """Cut ``text`` to about ``max_len`` bytes at a sentence or paragraph end."""
    if full or not max_len or max_len <= 0:
        return text.cast("binary") if exact_bytes else text
    cut = take_bytes(text, cut_position(text, max_len))
    over = F.octet_length(text) > max_len
    if exact_bytes:
        return F.when(over, cut).otherwise(text.cast("binary"))
    return F.when(over, whole_characters(cut)).otherwise(text)


def truncated_length(text: Column, max_len: int | None, full: bool = False) -> Column:
    """Byte length after ``truncate``, before a split last character is dropped."""
    if full or not max_len or max_len <= 0:
        return byte_length(text)
    return F.when(F.octet_length(text) > max_len, cut_position(text, max_len)).otherwise(byte_length(text))


def excerpt(text: Column) -> Column:
    """The first 200 bytes."""
    return F.when(
        F.octet_length(text) > EXCERPT_BYTES, whole_characters(take_bytes(text, EXCERPT_BYTES))
    ).otherwise(text)


def format_bytes(size: Column) -> Column:
    """``532 B``, ``1.5 KB``, ``20.0 MB`` ... with one half-even decimal."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for power, unit in enumerate("KMGTPE", start=1):
        step = 1024**power
        scaled = F.format_string(f"%.1f {unit}B", F.bround(size.cast("double") / float(step), 1))
        out = F.when(size >= F.lit(step).cast("bigint"), scaled).otherwise(out)
    return out
