"""Text datasets: TOON records, tables and documents, Markdown documents, JSON.

A document over a whole batch is unbounded, so it is made as numbered parts of
a fixed number of batch positions, and each part as pieces of a bounded number
of bytes; only a text larger than that stands alone in a larger piece. Put
together in the order of part and piece, without anything in between, they are
the single document.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmill.functions import toon as T
from parchmill.operators.results import STATS_FIELDS, failed_rows, ok_rows, parse_fields, select_fields

ROWS_PER_PART = 1000
MAX_PIECE_BYTES = 64 << 20
# Fixed value: what stands between two articles.
ARTICLE_SEPARATOR = "\n---\n## Next Article\n---\n\n"


def toon_object_of(df: DataFrame, fields: Sequence[str]) -> Column:
    """``key: value`` lines of some columns, in the order given."""
    schema = df.select(*fields).schema
    value = F.struct(*[F.col(name) for name in fields])
    return T.toon_object(value, schema)


def toon_records(results: DataFrame, fields: str | Sequence[str] | None = None) -> DataFrame:
    """One TOON object per result."""
    names = parse_fields(fields)
    shown = select_fields(results, names, "pos")
    return shown.select("pos", T.without_final_newlines(toon_object_of(shown, names)).alias("toon"))


def batch_stats_toon(stats: DataFrame, *keep: str) -> DataFrame:
    return stats.select(*keep, toon_object_of(stats, STATS_FIELDS).alias("toon"))


def part_of(rows_per_part: int) -> Column:
    """Part a position falls into, in exact integer arithmetic; -1 is before part 0."""
    return F.expr(f"(pos - pmod(pos, {rows_per_part})) div {rows_per_part}")


def _cut_places(rows: DataFrame, by: Sequence[str], max_bytes: int) -> DataFrame:
    """Per part, the places (``pos, rank``) where a new piece starts, from sizes alone.

    A text of more than half of ``max_bytes`` is a piece of its own; between
    those, running sums of bytes are cut at every half, so that a piece and the
    text that runs over its end stay within ``max_bytes``. A part has a fixed
    number of positions, and so has its window.
    """
    half = max(1, max_bytes // 2)
    in_part = Window.partitionBy(*by, "part").orderBy("pos", "rank")
    so_far = in_part.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = in_part.rowsBetween(Window.unboundedPreceding, -1)
    big = F.col("bytes") > half
    sized = rows.select(*by, "part", "pos", "rank", F.octet_length("text").cast("bigint").alias("bytes"))
    marked = sized.select(
        *by,
        "part",
        F.struct("pos", "rank").alias("place"),
        big.alias("big"),
        F.sum(big.cast("int")).over(so_far).alias("bigs"),
        F.floor(F.coalesce(F.sum(F.when(~big, F.col("bytes"))).over(earlier), F.lit(0)) / half).alias("fill"),
    )
    starts = marked.groupBy(*by, "part", "bigs", "big", F.when(~F.col("big"), F.col("fill")).alias("fill")).agg(
        F.min("place").alias("start")
    )
    return starts.groupBy(*by, "part").agg(F.array_sort(F.collect_list("start")).alias("starts"))


def _in_parts(rows: DataFrame, by: Sequence[str], name: str, max_bytes: int) -> DataFrame:
    """Join ``text`` of rows in ``pos, rank`` order, per part of each group and piece of a part.

    Texts cross the network once: the cuts are joined to them on the part, and
    the pieces are put together on the same partitioning.
    """
    keys = [*by, "part"]
    starts = _cut_places(rows, by, max_bytes)
    starts = starts.select(*[F.col(k).alias(f"_{k}") for k in keys], "starts")
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    cut = rows.join(starts, same).drop(*[f"_{k}" for k in keys])
    place = F.struct("pos", "rank")
    numbered = cut.withColumn("piece", F.size(F.filter("starts", lambda s: s <= place)) - 1)
    ordered = F.array_sort(F.collect_list(F.struct("pos", "rank", "text")))
    return (
        numbered.groupBy(*keys, "piece")
        .agg(ordered.alias("rows"))
        .select(*keys, "piece", F.array_join(F.transform("rows", lambda r: r["text"]), "").alias(name))
    )


def toon_table(
    df: DataFrame,
    fields: Sequence[str],
    by: Sequence[str] = (),
    rows_per_part: int = ROWS_PER_PART,
    max_bytes: int = MAX_PIECE_BYTES,
) -> DataFrame:
    """Rows as a TOON table, per group: a header with the row count, then one line each.

    ``df`` has ``pos``. The header is a row of its own in front of the group's
    first row, so counts are aggregated, not joined, and a large group is
    spread over its parts.
    """
    shown = df.select(*fields)
    part = part_of(rows_per_part)
    lines = df.select(
        *by,
        "pos",
        F.lit(1).alias("rank"),
        F.concat(
            F.lit("\n" + T.INDENT),
            T.toon_row(F.struct(*[F.col(f) for f in fields]), shown.schema.fields),
        ).alias("text"),
    )
    heads = (
        df.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"))
        .filter("n > 0")
        .select(*by, "pos", F.lit(0).alias("rank"), T.table_header(F.col("n"), list(fields)).alias("text"))
    )
    return _in_parts(lines.unionByName(heads).withColumn("part", part), by, "toon", max_bytes)


def toon_blocks(
    results: DataFrame, fields: str | Sequence[str] | None = None, stats: DataFrame | None = None
) -> DataFrame:
    """Blocks of the TOON document in ``pos`` order; statistics come first, at -1."""
    error_row = F.struct(F.col("url"), F.col("error.message").alias("error"), F.col("error.code").alias("code"))
    failed = failed_rows(results).select("pos", error_row.alias("row"))
    blocks = toon_records(ok_rows(results), fields).unionByName(
        failed.select("pos", T.toon_object(F.col("row"), failed.schema["row"].dataType).alias("toon"))
    )
    if stats is not None:
        blocks = batch_stats_toon(stats).select(F.lit(-1).cast("bigint").alias("pos"), "toon").unionByName(blocks)
    return blocks


def toon_document(
    results: DataFrame,
    fields: str | Sequence[str] | None = None,
    stats: DataFrame | None = None,
    rows_per_part: int = ROWS_PER_PART,
    max_bytes: int = MAX_PIECE_BYTES,
) -> DataFrame:
    """The batch as TOON text in parts; every block ends with a newline."""
    blocks = toon_blocks(results, fields, stats).select(
        "pos",
        F.lit(0).alias("rank"),
        F.concat("toon", F.lit("\n")).alias("text"),
        part_of(rows_per_part).alias("part"),
    )
    return _in_parts(blocks, (), "toon", max_bytes)


def markdown_articles(results: DataFrame) -> DataFrame:
    """Successful rows with ``text``: the separator, except for the first, and the Markdown.

    The first position is read without touching the documents.
    """
    ok = ok_rows(results)
    first = ok.select("pos").agg(F.min("pos")).scalar()
    lead = F.when(F.col("pos") == first, F.lit("")).otherwise(F.lit(ARTICLE_SEPARATOR))
    return ok.select("pos", F.concat(lead, F.col("markdown")).alias("text"))


def markdown_document(
    results: DataFrame, rows_per_part: int = ROWS_PER_PART, max_bytes: int = MAX_PIECE_BYTES
) -> DataFrame:
    """Markdown of the successful rows in batch order, in parts."""
    articles = markdown_articles(results).select(
        "pos", F.lit(0).alias("rank"), "text", part_of(rows_per_part).alias("part")
    )
    return _in_parts(articles, (), "document", max_bytes)


def json_lines(results: DataFrame, fields: str | Sequence[str] | None = None) -> DataFrame:
    """One JSON object per successful result, and ``url, error, code`` for a failed one."""
    names = parse_fields(fields)
    options = {"ignoreNullFields": "false"}
    shown = select_fields(ok_rows(results), names, "pos").select(
        "pos", F.to_json(F.struct(*names), options).alias("value")
    )
    error_row = F.struct("url", F.col("error.message").alias("error"), F.col("error.code").alias("code"))
    failed = failed_rows(results).select("pos", F.to_json(error_row, options).alias("value"))
    return shown.unionByName(failed)
