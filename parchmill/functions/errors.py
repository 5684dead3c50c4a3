"""Errors as data: a nullable struct next to each result row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Error codes, message openings and classes.
GENERIC, FETCH, EXTRACTION, CACHE, INVALID_URL = (
    "generic_error",
    "fetch_failed",
    "extraction_failed",
    "cache_error",
    "invalid_url",
)
_OPENING = {
    GENERIC: "",
    FETCH: "HTTP request failed: ",
    EXTRACTION: "Content extraction failed: ",
    INVALID_URL: "invalid URL (must start with http:// or https://): ",
}
_CLASS = {FETCH: 2, EXTRACTION: 3, CACHE: 4}
ERROR_TYPE = "struct<code:string,message:string,url:string,context:string>"


def no_error() -> Column:
    return F.lit(None).cast(ERROR_TYPE)


def error_struct(kind: str, url: Column, detail: Column) -> Column:
    """Build one error. For a store error ``detail`` is ``op: cause``-free text and
    ``url`` is the operation name, which becomes the context."""
    if kind == CACHE:
        message = F.concat(F.lit("Cache "), url, F.lit(" failed: "), detail)
        address, context = F.lit(""), url
    else:
        message = F.concat(F.lit(_OPENING[kind]), detail)
        address, context = (F.lit("") if kind == GENERIC else url), F.lit("")
    return F.struct(
        F.lit(kind).alias("code"),
        message.alias("message"),
        address.alias("url"),
        context.alias("context"),
    )


def cache_error(operation: Column, detail: Column) -> Column:
    return error_struct(CACHE, operation, detail)


def error_text(error: Column) -> Column:
    """``code: message (url)``, the parenthesis only when a URL is known."""
    line = F.concat(error["code"], F.lit(": "), error["message"])
    return F.when(error["url"] != "", F.concat(line, F.lit(" ("), error["url"], F.lit(")"))).otherwise(line)


def error_class(code: Column) -> Column:
    """Network 2, extraction 3, store 4, anything else 1."""
    out = F.lit(1)
    for kind, number in _CLASS.items():
        out = F.when(code == kind, F.lit(number)).otherwise(out)
    return out
