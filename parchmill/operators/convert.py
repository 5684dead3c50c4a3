"""HTML tokens to Markdown documents.

Inline markup is rewritten row by row inside a block; block structure (lists,
quotes, code) comes from running sums over the page; the blocks of a page are
put together by one ordered aggregate. Everything keeps the ``page_id``
partitioning of the token table.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmill.functions import html as H
from parchmill.functions.binding import reusable
from parchmill.operators.extract import SILENT_TAGS, UNTITLED, block_tokens, main_html
from parchmill.operators.windows import PAGE, before, by_page, from_here, so_far

LIST_INDENT = 4


def _nesting(*tags: str) -> Column:
    """How many of ``tags`` are open at this token."""
    named = F.col("tag").isin(list(tags))
    step = F.when(~named, 0).when(F.col("close"), -1).otherwise(1)
    return F.sum(step).over(so_far())


def _depth(steps: str) -> Column:
    """Nesting from the running sum of steps: a stray close tag counts for nothing."""
    return F.col(steps) - F.least(F.lit(0), F.min(steps).over(so_far()))


def _with_carried_marks(tokens: DataFrame) -> DataFrame:
    """Add ``carried``: the marks of bold, emphasis and link that are open where a block begins.

    A mark that holds whole blocks opens in one block and closes in a later one.
    Per kind, ``u`` marks of a block are left open at its end and ``s`` close
    what an earlier one opened. Running sums of these give the depth between
    blocks, and the least depth from a block on tells whether what is open there
    closes at all: a mark that nothing closes ends with its own block.
    """
    kinds = H.SPANNING
    out = tokens.withColumns({f"{k}_ends": H.open_ends(F.col("text"), tags) for k, tags in kinds.items()})
    out = out.withColumns(
        {f"{k}_sum": F.sum(F.col(f"{k}_ends.u") - F.col(f"{k}_ends.s")).over(so_far()) for k in kinds}
    )
    # A close tag without an open one counts for nothing.
    low = {k: F.col(f"{k}_sum") - F.col(f"{k}_ends.u") for k in kinds}
    out = out.withColumns({f"{k}_floor": F.least(F.lit(0), F.min(low[k]).over(so_far())) for k in kinds})
    out = out.withColumns(
        {f"{k}_before": F.lag(F.col(f"{k}_sum") - F.col(f"{k}_floor"), 1, 0).over(by_page()) for k in kinds}
        | {"open_link": F.last(F.when(F.col("link_ends.u") > 0, H.last_link(F.col("text"))), ignorenulls=True).over(before())}
    )
    out = out.withColumns(
        {f"{k}_open": F.col(f"{k}_before") > F.min(low[k] - F.col(f"{k}_floor")).over(from_here()) for k in kinds}
    )
    carried = F.struct(
        F.when(F.col("link_open"), F.col("open_link")).alias("link"),
        F.col("bold_open").alias("bold"),
        F.col("em_open").alias("em"),
    )
    steps = [f"{k}_{part}" for k in kinds for part in ("ends", "sum", "floor", "before", "open")]
    return out.withColumn("carried", carried).drop("open_link", *steps)


def _with_structure(tokens: DataFrame) -> DataFrame:
    """Add code, quote and list context to each token, and the marks open before it."""
    by_list_depth = so_far("list_depth")
    is_list = F.col("tag").isin("ul", "ol", "menu") & ~F.col("close")
    is_item = (F.col("tag") == "li") & ~F.col("close")
    start = F.coalesce(H.raw_attribute(F.col("attrs"), "start").try_cast("int"), F.lit(1))
    return (
        tokens.withColumns(
            {
                "code_steps": _nesting("pre"),
                "quote_steps": _nesting("blockquote"),
                "list_steps": _nesting("ul", "ol", "menu"),
            }
        )
        .withColumns(
            {
                "in_code": _depth("code_steps") > 0,
                "quote_depth": _depth("quote_steps"),
                "list_depth": _depth("list_steps"),
            }
        )
        # Here rows are still in page order; the windows of lists need one of their own.
        .transform(_with_carried_marks)
        .withColumns(
            {
                "items": F.sum(F.when(is_item, 1).otherwise(0)).over(by_list_depth),
                "last_item": F.last(F.when(is_item, F.col("pos")), ignorenulls=True).over(by_list_depth),
            }
        )
        .withColumn(
            "list",
            F.last(
                F.when(
                    is_list,
                    F.struct(
                        F.col("pos"), (F.col("tag") == "ol").alias("ordered"), start.alias("start"), F.col("items")
                    ),
                ),
                ignorenulls=True,
            ).over(by_list_depth),
        )
        .withColumn(
            "item",
            F.when(
                (F.col("list_depth") > 0) & (F.col("last_item") > F.coalesce(F.col("list.pos"), F.lit(-1))),
                F.col("last_item"),
            ),
        )
        .withColumn(
            "marker",
            F.when(
                F.col("list.ordered"),
                F.concat((F.col("items") - F.col("list.items") + F.col("list.start") - 1).cast("string"), F.lit(". ")),
            ).otherwise(F.lit("- ")),
        )
    )


@reusable
def _inline_markdown(text: str, base: str, carried: str) -> Column:
    return H.inline_markdown(F.col(text), F.coalesce(F.col(base), F.lit("")), F.col(carried))


@reusable
def _block_markdown() -> Column:
    """Markdown of one block, without list or quote prefixes."""
    tag, opens = F.col("tag"), ~F.col("close")
    inline = F.col("inline")
    level = F.when(tag.rlike("^h[1-6]$") & opens, F.substring(tag, 2, 1).cast("int"))
    heading = F.concat(
        F.repeat(F.lit("#"), level), F.lit(" "), F.regexp_replace(inline, r" *\n", " ")
    )
    rule = F.lit("* * *")
    return (
        F.when(tag.isin(SILENT_TAGS) & opens, F.lit(""))
        .when(F.col("in_code"), F.when(F.trim("text") != "", H.preformatted(F.col("text"))).otherwise(F.lit("")))
        .when(
            (tag == "hr") & opens,
            F.when(F.trim("text") == "", rule).otherwise(F.concat(rule, F.lit("\n\n"), H.escape_line_start(inline))),
        )
        .when(level.isNotNull(), F.when(inline != "", heading).otherwise(F.lit("")))
        .otherwise(H.escape_line_start(inline))
    )


def block_markdown(tokens: DataFrame) -> DataFrame:
    """Add ``part`` to each token: separator, prefixes and Markdown of its block.

    Empty blocks have an empty part and do not count as neighbours. They stay in
    the table: a filter on ``block`` would be pushed below the expression that
    makes it and evaluate that twice.
    """
    filled = F.col("block") != ""
    first_of_item = (
        filled
        & F.col("item").isNotNull()
        & (F.col("item") > F.coalesce(F.max(F.when(filled, F.col("item"))).over(before()), F.lit(-1)))
    )
    previous = F.last(
        F.when(filled, F.struct("list_depth", F.col("list.pos").alias("list_pos"))), ignorenulls=True
    ).over(before())
    # In a list, the next item follows on the next line.
    continues_list = (F.col("previous.list_depth") > 0) & (
        (F.col("list_depth") > 1)
        | (F.col("previous.list_depth") > 1)
        | (F.col("previous.list_pos") == F.col("list.pos"))
    )
    indent = F.repeat(F.lit(" " * LIST_INDENT), F.col("list_depth"))
    outer = F.repeat(F.lit(" " * LIST_INDENT), F.greatest(F.col("list_depth") - 1, F.lit(0)))
    quote_mark = F.repeat(F.lit("> "), F.col("quote_depth"))
    indented = F.when(
        F.col("item").isNotNull(),
        F.concat(
            F.when(F.col("starts"), F.concat(outer, F.col("marker"))).otherwise(indent),
            F.regexp_replace(F.col("block"), F.lit("\n"), F.concat(F.lit("\n"), indent)),
        ),
    ).otherwise(F.col("block"))
    quoted = F.when(
        F.col("quote_depth") > 0,
        F.concat(quote_mark, F.regexp_replace(F.col("lines"), F.lit("\n"), F.concat(F.lit("\n"), quote_mark))),
    ).otherwise(F.col("lines"))
    separator = (
        F.when(F.col("previous").isNull(), F.lit(""))
        .when(F.col("starts") & continues_list, F.lit("\n"))
        .otherwise(F.lit("\n\n"))
    )
    return (
        _with_structure(tokens)
        .withColumn(
            "inline",
            F.when(F.col("in_code"), F.lit("")).otherwise(_inline_markdown("text", "final_url", "carried")),
        )
        .withColumn("block", _block_markdown())
        .withColumns({"starts": first_of_item, "previous": previous})
        .withColumn("lines", indented)
        .withColumn("part", F.when(filled, F.concat(separator, quoted)).otherwise(F.lit("")))
    )


def convert_html(content: DataFrame) -> DataFrame:
    """HTML rows (``page_id, final_url, html``) to Markdown bodies.

    ``first_paragraph`` is the HTML of the first paragraph. Rows keep the
    partitioning they come with when it is by ``page_id``.
    """
    is_paragraph = (F.col("tag") == "p") & ~F.col("close") & (F.col("block") != "")
    return (
        block_markdown(block_tokens(content, "final_url"))
        .groupBy(*PAGE)
        .agg(
            F.min_by("text", F.when(is_paragraph, F.col("pos"))).alias("first_paragraph"),
            F.expr("listagg(part, '') within group (order by pos)").alias("body_md"),
        )
        .withColumn("body_md", F.coalesce("body_md", F.lit("")))
        .drop("page_no")
    )


def convert_corpus(pages: DataFrame, keep_pages: DataFrame | None = None) -> DataFrame:
    """Pages to metadata and Markdown body of their main content; only those of ``keep_pages`` if given."""
    content = main_html(pages, keep_pages).withColumnRenamed("main_html", "html")
    # Address and metadata ride on row 0 of each page's tokens.
    tokens = block_tokens(content.withColumn("page", F.struct("stated", "fallback")), "final_url", "page")
    is_paragraph = (F.col("tag") == "p") & ~F.col("close") & (F.col("block") != "")
    body = (
        block_markdown(tokens.withColumn("page", F.when(F.col("pos") == 0, F.col("page"))))
        .groupBy(*PAGE)
        .agg(
            F.first("page", ignorenulls=True).alias("page"),
            F.first("final_url").alias("final_url"),
            F.min_by("text", F.when(is_paragraph, F.col("pos"))).alias("first_paragraph"),
            F.expr("listagg(part, '') within group (order by pos)").alias("body_md"),
        )
        .select("page_id", "final_url", "page.*", "first_paragraph", "body_md")
    )
    if keep_pages is not None:
        body = body.join(keep_pages.select("page_id"), "page_id", "left_semi")

    # A page without main content keeps what it states; only a first paragraph would be a guess.
    paragraph = F.when(~F.col("fallback"), _visible_text("first_paragraph"))
    description = F.coalesce(F.nullif(F.col("stated.description"), F.lit("")), paragraph, F.lit(""))
    title = F.when(F.col("fallback") & (F.col("stated.title") == ""), F.lit(UNTITLED)).otherwise(F.col("stated.title"))
    return body.select(
        "page_id",
        "final_url",
        F.struct(
            title.alias("title"),
            F.col("stated.author").alias("author"),
            F.col("stated.publish_date").alias("publish_date"),
            description.alias("description"),
        ).alias("meta"),
        F.coalesce("body_md", F.lit("")).alias("body_md"),
        "fallback",
    )


@reusable
def _visible_text(name: str) -> Column:
    return H.visible_text(F.col(name))


def front_matter(meta: Column, final_url: Column) -> Column:
    """Document header: title, address, and the metadata that is known."""

    def line(label: str, name: str) -> Column:
        value = F.coalesce(meta[name], F.lit(""))
        return F.when(value != "", F.concat(F.lit(f"**{label}:** "), value, F.lit("\n"))).otherwise(F.lit(""))

    title = F.coalesce(meta["title"], F.lit(""))
    return F.concat(
        F.when(title != "", F.concat(F.lit("# "), title, F.lit("\n\n"))).otherwise(F.lit("")),
        F.lit("**URL:** "),
        final_url,
        F.lit("\n"),
        line("Author", "author"),
        line("Published", "publish_date"),
        line("Description", "description"),
        F.lit("\n---\n\n"),
    )


def document(front: Column, body: Column, as_of: Column) -> Column:
    """Header, body and the time stamp at the end."""
    stamp = F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.concat(front, body, F.lit("\n\n---\n<!-- Fetched: "), stamp, F.lit(" -->\n"))


def as_of_column(as_of: dt.datetime | str | Column) -> Column:
    """A fixed point in time as a Column; text and naive times are read as UTC."""
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, dt.datetime):
        as_of = (as_of.astimezone(dt.timezone.utc) if as_of.tzinfo else as_of).strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(as_of).cast("timestamp")


def documents(
    pages: DataFrame, as_of: dt.datetime | str | Column, keep_pages: DataFrame | None = None
) -> DataFrame:
    """Pages (``page_id, url, html[, final_url]``) to full Markdown documents."""
    converted = convert_corpus(pages, keep_pages)
    return converted.select(
        "page_id",
        "final_url",
        "meta",
        document(front_matter(F.col("meta"), F.col("final_url")), F.col("body_md"), as_of_column(as_of)).alias(
            "markdown"
        ),
    )
