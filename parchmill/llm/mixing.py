"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmill.llm.common import staged

# Words, and the step of the golden-ratio sequence on 2^31 points.
WORDS = r"[^\x20\x09-\x0D]+"
POINTS = 1 << 31
GOLDEN_STEP = 1327217885

# Source shares are looked up by the cell of this grid that a point falls into.
GRID = 1024
ROWS_PER_BUCKET = 4096
SLOTS_PER_CHUNK = 1 << 16


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORDS)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """Targets from ``sizes`` (source, source_size, n_rows): one row per source.

    Sources in code-point order, null last, take the weights in turn and share
    ``share`` times all words. A target stops at ``most`` times its source; what
    it leaves is shared by weight until none is above. That is one level of
    words per weight: with sources in the order in which they fill up, the
    largest of what the rest could share after the first 0, 1, 2 ... are full.

    Adds rank, weight, target, goal (the target in whole words), and the range
    lo..hi of the source among all goals.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    turn = (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")
    fill = Window.orderBy((F.col("cap") / F.col("weight")).asc(), "rank")
    by_rank = Window.orderBy("rank")
    return (
        ranked.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), turn))
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("budget", F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)))
        .withColumn("full", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("rest", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", F.max((F.col("budget") - F.col("full")) / F.col("rest")).over(Window.partitionBy()))
        .withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")))
        .withColumn("goal", F.floor(F.col("target") + 0.5))
        .withColumn("hi", F.sum("goal").over(by_rank.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("lo", F.col("hi") - F.col("goal"))
        .drop("cap", "budget", "full", "rest", "level")
    )


def _before(rows: DataFrame, keys: list[str], part: str, order: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows before it, in ``part`` and then ``order``, within ``keys``.

    Parts are summed first, so no window holds more than one part: a key with a
    third of all rows is many parts.
    """
    sums = rows.groupBy(*keys, part).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, part, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ran = rows.withColumn("_ran", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return ran.join(starts, [*keys, part]).withColumn(name, F.col("_start") + F.col("_ran")).drop("_start", "_ran")


def schedule(targets: DataFrame, block: int) -> DataFrame:
    """The mix as slots of ``block`` words: slot, rank (of the source), block (its turn in the source).

    Slot j looks at point j of the golden-ratio sequence and takes the source
    whose share of the goals holds that point, so each stretch of slots has
    nearly the target weights. A source ends when its goal is met; the one or
    two blocks that the sequence may leave it short of follow at the end.
    """
    words, sources = targets.agg(F.coalesce(F.max("hi"), F.lit(0)), F.count(F.lit(1))).first()
    spark = targets.sparkSession
    n = -(-words // block)
    width = max(words, 1)
    point = F.pmod(F.col("id"), F.lit(POINTS)) * GOLDEN_STEP % POINTS
    slots = spark.range(n).select(
        F.col("id").alias("slot"),
        (point / F.lit(float(POINTS)) * F.lit(float(width))).alias("at"),
        F.floor(point * GRID / F.lit(POINTS)).alias("cell"),
    )
    cell = lambda c: F.least(F.greatest(F.floor(c * GRID / F.lit(width)), F.lit(0)), F.lit(GRID - 1))
    shares = targets.filter("goal > 0").select(
        "rank", "lo", "hi", F.explode(F.sequence(cell(F.col("lo") - 1), cell(F.col("hi") + 1))).alias("cell")
    )
    drawn = slots.join(shares, "cell").filter("at >= lo and at < hi").select("slot", "rank")
    chunked = drawn.withColumn("chunk", F.floor(F.col("slot") / SLOTS_PER_CHUNK))
    ranked = staged(_before(chunked, ["rank"], "chunk", ["slot"], F.lit(1), "block").select("slot", "rank", "block"), "slots")
    need = targets.filter("goal > 0").select("rank", F.ceil(F.col("goal") / block).alias("need"))
    got = ranked.groupBy("rank").agg(F.count(F.lit(1)).alias("got"))
    short = need.join(got, "rank", "left").withColumn("got", F.coalesce("got", F.lit(0))).filter("got < need")
    late = short.select("rank", F.explode(F.sequence("got", F.col("need") - 1)).alias("block"))
    in_goal = ranked.join(need, "rank").filter("block < need").select("slot", "rank", "block")
    return in_goal.unionByName(late.select((n + F.col("block") * sources + F.col("rank")).alias("slot"), "rank", "block"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: int = 2,
    block: int = 128,
    seed: str = "mix",
    name: str = "doc_id",
) -> tuple[DataFrame, DataFrame]:
    """The mix of ``docs`` (doc_id, text, source), and its rows.

    Returns (rows, pieces). rows: row (a number of its own), doc_id, size,
    source_size, target. pieces: slot, row, epoch, first (word in the document),
    words; a slot's pieces make up its block.

    A source's documents in the order of a keyed hash of the column ``name`` are one stream of words,
    cut into blocks of ``block`` words and read ``most`` times at most; a
    scheduled slot takes the next block of its source. Every source takes
    exactly its rounded target, no document more than ``most`` times its size,
    and the same table gives the same mix.

    Null texts have no words; they and sources without words take nothing. A
    null source is a source. Rows that repeat a doc_id are documents of their
    own, next to each other in the stream. An empty table gives an empty mix.
    """
    key = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(name).cast("string"), F.lit("")))), 1, 16)
    sized = staged(
        docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", size_of(F.col("text")).alias("size"), key.alias("key")),
        "sizes",
    )
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    targets = staged(source_targets(sums, weights, share, most), "targets")
    known = targets.select(F.col("source").alias("of"), "rank", "source_size", "target", "goal", "n_rows")
    rows = sized.join(known, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    parts = F.ceil(F.col("n_rows") / ROWS_PER_BUCKET)
    part = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * parts / F.lit(1 << 32))
    placed = _before(rows.withColumn("part", part), ["rank"], "part", ["key", "doc_id", "size", "row"], F.col("size"), "start")
    epochs = F.sequence(F.lit(0), F.lit(most - 1))
    laid = (
        placed.filter("size > 0 and goal > 0")
        .select("row", "rank", "size", "start", "goal", "source_size", F.explode(epochs).alias("epoch"))
        .withColumn("begin", F.col("epoch") * F.col("source_size") + F.col("start"))
        .withColumn("end", F.least(F.col("begin") + F.col("size"), F.col("goal")))
        .filter("begin < end")
    )
    first, last = F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block)
    cut = laid.withColumn("block", F.explode(F.sequence(first, last))).select(
        "rank",
        "block",
        "row",
        "epoch",
        (F.greatest(F.col("block") * block, F.col("begin")) - F.col("begin")).alias("first"),
        (F.least((F.col("block") + 1) * block, F.col("end")) - F.greatest(F.col("block") * block, F.col("begin"))).alias("words"),
    )
    pieces = schedule(targets, block).join(cut, ["rank", "block"]).select("slot", "row", "epoch", "first", "words")
    return rows.select("row", "doc_id", "size", "source_size", "target"), pieces


def mixed_sizes(docs: DataFrame, **options) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, taken (words the mix takes, repeats counted), first_slot.

    first_slot is the place in the schedule where the mix comes to the document,
    -1 if it takes none of it: in this order each stretch of documents has
    nearly the target weights.
    """
    rows, pieces = mix(docs, **options)
    taken = pieces.groupBy("row").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    return rows.join(taken, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        F.coalesce("first_slot", F.lit(-1)).cast("long").alias("first_slot"),
    )


def mixed_documents(docs: DataFrame, in_order: bool = False, **options) -> DataFrame:
    """``docs`` as the mix takes them: a row per document and reading, with all columns.

    ``in_order`` sorts the rows by the slots at which the schedule comes to them
    (one more shuffle, of whole texts), so that any stretch of what is written
    is mixed; without it a stage that deals rows anew, as packing does, loses nothing.

    A document that the end of its source's target cuts keeps the words before
    it; all others keep their text as it is. ``n_chars`` follows the text. How
    the table is cut into files makes no difference to documents with an id of their own.
    """
    whole = staged(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("at")), "documents")
    numbered = whole.select(F.col("at").alias("doc_id"), F.col("doc.doc_id").alias("name"), "doc.text", "doc.source")
    rows, pieces = mix(numbered, name="name", **options)
    taken = pieces.groupBy("row", "epoch").agg(F.sum("words").alias("words"), F.min("slot").alias("slot"))
    read = taken.join(rows.select("row", "size", F.col("doc_id").alias("at")), "row").select("at", "size", "words", "slot")
    text = F.col("doc.text")
    cut = F.when(F.col("words") >= F.col("size"), text).otherwise(
        F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"({WORDS})")), F.lit(1), F.col("words").cast("int")), " ")
    )
    out = whole.join(read, "at").withColumn("doc", F.col("doc").withField("text", cut))
    if "n_chars" in docs.columns:
        out = out.withColumn("doc", F.col("doc").withField("n_chars", F.length("doc.text").cast(docs.schema["n_chars"].dataType)))
    if in_order:
        out = out.orderBy("slot", "at", "words")
    return out.select("doc.*")
