"""Main-content extraction over the whole corpus.

Pages cross the network once, as one row each, hashed by page. From
there a page is cut into slim token rows at container tags only; their text is
measured where it is cut and left behind. Nesting, boilerplate and scores are
running sums and look-ups in windows of one page, so no token is ever paired
with a container by a join. The positions worth keeping are then joined back
to the page row, on the same partitioning and the same shuffle files.
A page is a row of the input, known by its ``page_id`` and a number made
before the exchange, so pages that share an id stay apart and a window holds
one page at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmill.functions import html as H
from parchmill.functions.binding import let, reusable
from parchmill.operators.membership import likely
from parchmill.operators.windows import PAGE, before, by_page, numbered, so_far, whole_page

# Tags matched as containers, and those that can hold the article.
CONTAINER_TAGS = ["article", "main", "section", "div", "td", "body", "nav", "aside", "footer", "header"]
CANDIDATE_TAGS = ["article", "main", "section", "div", "td", "body"]
BOILERPLATE_TAGS = ["nav", "aside", "footer", "header"]
BOILERPLATE_CLASS = r"(?i)(?:^|[^a-z])(?:ads?|advert[a-z]*|promo[a-z]*|related|shar(?:e|ing)|comments?)(?:[^a-z]|$)"
# A header in one of these is the head of an article and not of the site.
ARTICLE_TAGS = ["article", "main", "section"]
# A div whose class reads like noise is content all the same with more than this share of the page's text.
MOST_TEXT = 0.75
# Form and head elements whose text is never content.
SILENT_TAGS = ["title", "head", "textarea", "select", "option", "button"]
MIN_BLOCK_BYTES = 25
UNTITLED = "Untitled"


def clean_pages(pages: DataFrame) -> DataFrame:
    """Pages with comments, scripts, styles and noscript removed from ``html``."""
    return pages.withColumn("html", H.clean_html(F.col("html")))


def page_metadata(pages: DataFrame) -> DataFrame:
    """Title, author, day and description as the page states them."""
    return _with_metadata(clean_pages(pages)).select("page_id", "title", "author", "publish_date", "description")


def _with_metadata(clean: DataFrame) -> DataFrame:
    return clean.withColumn("metas", H.meta_attributes(F.col("html"))).withColumns(_metadata("html", "metas"))


@reusable
def _metadata(html_name: str, metas_name: str) -> dict[str, Column]:
    html, metas = F.col(html_name), F.col(metas_name)
    return {
        "title": H.page_title(html, metas),
        "author": H.page_author(html, metas),
        "publish_date": H.page_date(html, metas),
        "description": H.page_description(metas),
    }


def _explode_tokens(clean: DataFrame, tags: list[str] | None, *carried: str) -> DataFrame:
    piece = F.col("piece")
    pieces = H.split_at_tags(F.col("html"), tags)
    return numbered(clean).select(*PAGE, *carried, F.posexplode(pieces).alias("pos", "piece")).select(
        *PAGE,
        F.col("pos").cast("bigint").alias("pos"),
        H.piece_closes(piece).alias("close"),
        H.piece_tag(piece).alias("tag"),
        H.piece_attrs(piece).alias("attrs"),
        H.piece_text(piece).alias("text"),
        *carried,
    )


def tag_tokens(pages: DataFrame, tags: list[str] | None = None) -> DataFrame:
    """One row per tag with the text that follows it.

    ``tags`` limits the cut to some tags; the rest then stays inside ``text``.
    Text before the first tag is row 0 and only present when there is any.
    """
    tokens = _explode_tokens(clean_pages(pages), tags)
    return tokens.filter((F.col("pos") > 0) | (F.col("text") != ""))


def with_body(clean: DataFrame) -> DataFrame:
    """Cleaned pages with the body tag that a page may leave out, so its text has a container."""
    html = F.col("html")
    return clean.withColumn("html", F.when(html.rlike(r"(?i)<body[^a-z0-9]"), html).otherwise(F.concat(F.lit("<body>"), html)))


def partition_pages(pages: DataFrame, keep_pages: DataFrame | None = None) -> DataFrame:
    """Cleaned pages (``page_id, page_no, final_url, html``), each with a body, hashed by page.

    What crosses the network is one row per page holding the cleaned HTML:
    smaller than its tokens, and the only exchange of the extraction. The
    number of partitions is fixed, because this stage is bound by CPU and
    merging partitions by size at run time would leave cores idle. Of the pages
    outside ``keep_pages`` (``page_id``), which is counted here, nearly all are
    left out before they are cleaned; who reads the result drops the others.
    """
    final_url = F.coalesce("final_url", "url") if "final_url" in pages.columns else F.col("url")
    partitions = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = numbered(pages).select(*PAGE, final_url.alias("final_url"), F.coalesce("html", F.lit("")).alias("html"))
    if keep_pages is not None:
        rows = likely(rows, keep_pages, "page_id", keep_pages.count())
    return rows.transform(clean_pages).transform(with_body).repartition(partitions, *PAGE)


def container_tokens(pages: DataFrame, *carried: str) -> DataFrame:
    """Token rows cut at container tags only, with the text measured and dropped.

    ``worth`` sums the text blocks behind the tag, ``text_bytes`` and
    ``link_bytes`` their visible text. ``pages`` holds cleaned HTML.
    """
    tokens = _explode_tokens(pages, CONTAINER_TAGS, *carried)
    return tokens.withColumn("measure", _measured("text")).select(
        *PAGE, "pos", "close", "tag", "attrs", "measure.worth", "measure.text_bytes", "measure.link_bytes", *carried
    )


@reusable
def _measured(name: str) -> Column:
    """Worth, visible bytes and link bytes of HTML between two container tags.

    A text block of 25 bytes or more is worth 1, plus its commas, plus up to 3
    for length.
    """
    zero = F.lit(0).cast("bigint")
    # Whole-fragment passes: block tags become cuts, other tags blanks; the text
    # behind a silent tag is marked and counts as empty.
    silent, hidden = H.tag_pattern(SILENT_TAGS, closing=False), "\x02"
    cut = F.regexp_replace(F.regexp_replace(F.col(name), silent, H.CUT + hidden), H.tag_pattern(H.BLOCK_TAGS), H.CUT)
    plain = F.regexp_replace(F.when(F.contains(cut, F.lit("<")), H.without_tags(cut)).otherwise(cut), r"\s+", " ")
    blocks = F.transform(
        F.split(H.decode_entities(plain), H.CUT, -1),
        lambda t: F.when(t.startswith(hidden), F.lit("")).otherwise(F.trim(t)),
    )

    def worth(text: Column) -> Column:
        size = F.octet_length(text)
        commas = F.length(text) - F.length(F.replace(text, F.lit(","), F.lit("")))
        return F.when(size < MIN_BLOCK_BYTES, zero).otherwise(
            (1 + commas + F.least(F.floor(size / 100), F.lit(3))).cast("bigint")
        )

    def totals(texts: Column) -> Column:
        return F.struct(
            F.aggregate(texts, zero, lambda acc, t: acc + worth(t)).alias("worth"),
            F.aggregate(texts, zero, lambda acc, t: acc + F.octet_length(t)).alias("text_bytes"),
            H.link_text_bytes(F.col(name)).alias("link_bytes"),
        )

    return let(blocks, totals)


def match_containers(tokens: DataFrame, *looked_up: str) -> DataFrame:
    """Add ``mate`` (position of the matching close or open tag) and ``noise``, which goes by tag and class alone.

    Of the columns ``looked_up`` the values at the matching tag are added as
    ``mate_...``. The running count of open minus closed tags of a kind is their nesting
    level; within one level opens and closes alternate, so the neighbour at the
    same level is the match. A stray close tag has no mate, an unclosed
    container none either.
    """
    is_container = F.col("tag").isin(CONTAINER_TAGS)
    step = F.when(~is_container, 0).when(F.col("close"), -1).otherwise(1)
    by_level = Window.partitionBy(*PAGE, "tag", "level").orderBy("pos")

    def at_mate(name: str) -> Column:
        opened = ~F.lag("close").over(by_level)
        there = F.when(~F.col("close"), F.lead(name).over(by_level)).when(opened, F.lag(name).over(by_level))
        return F.when(is_container, there)

    opens_noise = F.col("tag").isin(BOILERPLATE_TAGS) | (
        (F.col("tag") == "div") & H.raw_attribute(F.col("attrs"), "class").rlike(BOILERPLATE_CLASS)
    )
    return (
        tokens.withColumn("noise", F.when(is_container & ~F.col("close"), opens_noise).otherwise(F.lit(False)))
        .withColumn(
            "level",
            F.sum(step).over(so_far("tag"))
            + F.when(is_container & F.col("close"), 1).otherwise(0),
        )
        .withColumns({f"mate_{name}".removesuffix("_pos"): at_mate(name) for name in ("pos", *looked_up)})
        .withColumn(
            "noise",
            F.when(F.col("close"), F.col("mate").isNotNull() & F.lag("noise").over(by_level)).otherwise(F.col("noise")),
        )
        .drop("level")
    )


def containers(tokens: DataFrame) -> DataFrame:
    """One row per container: where it opens and closes, unclosed = end of page."""
    page_end = F.max("pos").over(whole_page()) + 1
    return (
        match_containers(tokens)
        .withColumn("page_end", page_end)
        .filter(F.col("tag").isin(CONTAINER_TAGS) & ~F.col("close"))
        .select(
            "page_id",
            F.col("pos").alias("open_pos"),
            F.coalesce("mate", "page_end").alias("close_pos"),
            "tag",
        )
    )


def mark_boilerplate(tokens: DataFrame) -> DataFrame:
    """Add ``mate``, ``noise`` and ``dropped``: the token lies in a boilerplate container.

    The text after the closing tag already belongs to the outside. Two kinds of
    container only look like noise. A ``div`` marked by its class holds the
    page if it has more than three quarters of the visible text (a wrapper
    ``site has-ads``, a ``post comments-open``). A ``header`` in an article,
    ``main`` or section holds its headline.
    """
    size = F.col("text_bytes") if "text_bytes" in tokens.columns else _token_bytes()
    sized = tokens.withColumn("bytes", size).withColumns(
        {"read": F.coalesce(F.sum("bytes").over(before()), F.lit(0)), "page_bytes": F.sum("bytes").over(whole_page())}
    )
    is_open = ~F.col("close")
    held = F.when(is_open, F.coalesce("mate_read", "page_bytes") - F.col("read")).otherwise(F.col("read") - F.col("mate_read"))
    holds_page = (F.col("tag") == "div") & (held > F.col("page_bytes") * MOST_TEXT)
    step = F.when(~F.col("tag").isin(ARTICLE_TAGS), 0).when(is_open, 1).when(F.col("mate").isNotNull(), -1).otherwise(0)
    heads_article = (F.col("tag") == "header") & is_open & (F.col("articles") > 0)
    ends = F.when(F.col("noise") & is_open, F.coalesce("mate", F.lit(1 << 62)))
    return (
        match_containers(sized, "read")
        .withColumn("noise", F.col("noise") & ~F.coalesce(holds_page, F.lit(False)))
        .withColumn("articles", F.coalesce(F.sum(step).over(before()), F.lit(0)))
        .withColumn("noise", F.col("noise") & ~heads_article)
        .withColumn("dropped", F.coalesce(F.max(ends).over(so_far()) > F.col("pos"), F.lit(False)))
        .drop("bytes", "read", "page_bytes", "mate_read", "articles")
    )


def _token_bytes() -> Column:
    """Visible bytes behind the tag of a token that carries its text."""
    silent = F.col("tag").isin(SILENT_TAGS) & ~F.col("close")
    return F.when(silent, 0).otherwise(F.octet_length(F.trim(F.regexp_replace("text", r"\s+", " "))))


def drop_boilerplate(tokens: DataFrame) -> DataFrame:
    """Tokens outside navigation, asides, site headers, footers and ad-like divs."""
    return mark_boilerplate(tokens).filter(~F.col("dropped")).drop("noise", "mate", "dropped")


def score_containers(tokens: DataFrame) -> DataFrame:
    """Add to every token its container, that container's score, and the page's best.

    A container gets the worth of the text blocks directly inside, less the
    share of link text in them, and half of what each container directly inside
    it got that way. ``main_open`` is NULL on pages where nothing scores. Takes
    ``container_tokens``.
    """
    counts = F.col("tag").isin(CANDIDATE_TAGS) & ~F.col("noise") & ~F.col("dropped")
    in_container = Window.partitionBy(*PAGE, "container")
    in_target = Window.partitionBy(*PAGE, "target")

    def kept(name: str) -> Column:
        return F.when(F.col("dropped"), 0).otherwise(F.col(name))

    return (
        mark_boilerplate(tokens)
        .withColumn("opens", counts & ~F.col("close"))
        .withColumn(
            "depth",
            F.sum(
                F.when(F.col("opens"), 1).when(counts & F.col("close") & F.col("mate").isNotNull(), -1).otherwise(0)
            ).over(so_far()),
        )
        .withColumn("container", F.last(F.when(F.col("opens"), F.col("pos")), ignorenulls=True).over(so_far("depth")))
        # Just before a container opens, its surrounding one is the current container.
        .withColumn("target", F.when(F.col("opens"), F.lag("container").over(by_page())).otherwise(F.col("container")))
        .withColumns(
            {
                "own": F.sum(kept("worth")).over(in_container).cast("double"),
                "linked": F.try_divide(
                    F.sum(kept("link_bytes")).over(in_container), F.sum(kept("text_bytes")).over(in_container)
                ),
            }
        )
        .withColumn("net", F.col("own") * (1 - F.coalesce("linked", F.lit(0.0))))
        .withColumn("handed_up", F.sum(F.when(F.col("opens"), F.col("net") / 2)).over(in_target))
        .withColumn(
            "score", F.col("net") + F.when(F.col("opens"), 0.0).otherwise(F.coalesce("handed_up", F.lit(0.0)))
        )
        .withColumn(
            "best",
            F.max(
                F.when(
                    F.col("container").isNotNull() & (F.col("score") > 0),
                    F.struct(F.col("score"), F.col("container").alias("open_pos")),
                )
            ).over(whole_page()),
        )
        .withColumn("main_open", F.col("best.open_pos"))
        .withColumns(
            {
                "page_end": F.max("pos").over(whole_page()) + 1,
                "main_close": F.max(F.when(F.col("pos") == F.col("main_open"), F.col("mate"))).over(whole_page()),
            }
        )
    )


def main_content(tokens: DataFrame) -> DataFrame:
    """The best container of each page; pages without one have no row."""
    return (
        score_containers(tokens)
        .filter(F.col("pos") == F.col("main_open"))
        .select(
            "page_id",
            F.col("main_open").alias("open_pos"),
            F.coalesce("mate", "page_end").alias("close_pos"),
            "tag",
            F.col("best.score").alias("score"),
        )
    )


def main_html(pages: DataFrame, keep_pages: DataFrame | None = None) -> DataFrame:
    """One row per page: ``final_url``, stated metadata and the HTML of its main content.

    Without main content the whole page stays and ``fallback`` is true: the
    reader still gets something useful. ``keep_pages`` (``page_id``) limits the
    work to some pages and few others, which stay in the result.
    """
    clean = partition_pages(pages, keep_pages)
    # The address travels on row 0, so both readers of the exchange take the
    # same columns and share its files.
    addressed = clean.withColumn("address", F.col("final_url")).drop("final_url")
    scored = score_containers(
        container_tokens(addressed, "address").withColumn("address", F.when(F.col("pos") == 0, F.col("address")))
    )
    inside = F.col("main_open").isNull() | (
        (F.col("pos") >= F.col("main_open"))
        & (F.col("pos") < F.coalesce("main_close", "page_end"))
        & ~F.col("dropped")
    )
    kept = scored.groupBy(*PAGE).agg(
        F.array_sort(F.collect_list(F.when(inside, F.col("pos").cast("int")))).alias("kept"),
        F.first("main_open", ignorenulls=True).alias("main_open"),
        F.first("address", ignorenulls=True).alias("address"),
    )
    pieces = F.col("pieces")
    return (
        _with_metadata(clean)
        .withColumn("pieces", H.split_at_tags(F.col("html"), CONTAINER_TAGS))
        .join(kept, PAGE)
        .select(
            *PAGE,
            F.coalesce("address", "final_url").alias("final_url"),
            F.struct("title", "author", "publish_date", "description").alias("stated"),
            F.when(F.col("main_open").isNull(), F.col("html"))
            .otherwise(
                F.replace(
                    F.array_join(F.transform("kept", lambda i: F.get(pieces, i)), ""), F.lit(H.END), F.lit("")
                )
            )
            .alias("main_html"),
            F.col("main_open").isNull().alias("fallback"),
        )
    )


def block_tokens(content: DataFrame, *carried: str) -> DataFrame:
    """Token rows of ``html`` cut at block tags; inline markup stays in ``text``."""
    return _explode_tokens(content, H.BLOCK_TAGS, *carried)
