"""Phrases whose words belong together: n-grams counted in quotient filters, scored by their loosest cut."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parchmill.llm import quotient as Q
from parchmill.llm.common import join_totals, sliced, staged

LONGEST = 4
# A shard ends with the document that brings it to so many words; a range of merged filters has about as many keys.
SHARD_WORDS = 1 << 20
RANGE_KEYS = 1 << 20
# A filter is split by at most so many bits at a time; wider splits take several rounds of merging.
FAN_BITS = 12
WORDS_PER_BUCKET = 1 << 16
SALTS = 64

# Byte tables: A-Z to a-z, a tab to a space, and marks that end a piece to a byte that UTF-8 never uses.
_STOP = b"\xff"
_FOLD = bytes(
    0xFF if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256)
)
SHARD = "shard long, lang string, words array<binary>, times array<long>, tokens binary"
GRAM = "n int, ids array<long>, times long"
FILTER = "n int, place long, shard long, filter binary"


def words_and_stops(text: bytes) -> list[bytes]:
    """Lower-cased words in order, with a stop wherever a piece ends."""
    return text.translate(_FOLD).replace(_STOP, b" \xff ").split(b" ")


def word_shards(docs: DataFrame) -> DataFrame:
    """Texts as numbers of words, a row per shard and language: its words, how often each stands there, its tokens.

    Stops, and the ends of documents, are the number -1.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        open_shards: dict[str, tuple[dict[bytes, int], list[np.ndarray]]] = {}
        held = 0

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal base
            for lang, (numbers, parts) in open_shards.items():
                tokens = np.concatenate(parts)
                # Number 0 is the stop, 1 the empty word between two spaces.
                times = np.bincount(tokens, minlength=len(numbers))
                tokens = tokens[tokens != 1] - 2
                row = [[base], [lang], [list(numbers)[2:]], [times[2:]], [np.maximum(tokens, -1).astype("<i4").tobytes()]]
                base += 1
                types = [pa.int64(), pa.string(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary()]
                columns = [pa.array(v, t) for v, t in zip(row, types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SHARD.split(", ")])

        for batch in sliced(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if lang not in open_shards:
                    numbers: dict[bytes, int] = defaultdict(count().__next__)
                    numbers[_STOP], numbers[b""]
                    open_shards[lang] = numbers, []
                numbers, parts = open_shards[lang]
                found = words_and_stops(text)
                found.append(_STOP)
                parts.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
                held += len(found)
            if held >= SHARD_WORDS:
                yield from closed()
                open_shards, held = {}, 0
        yield from closed()

    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), text.alias("text"))
    return rows.mapInArrow(shards, SHARD)


def numbered(words: DataFrame) -> tuple[DataFrame, int]:
    """``words`` (lang, word, times) with ids 0, 1, 2 ... that leave no gap, and their number."""
    n = words.count()
    buckets = max(1, -(-n // WORDS_PER_BUCKET))
    dealt = words.withColumn("bucket", F.pmod(F.xxhash64("lang", "word"), F.lit(buckets)))
    ahead = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    before = sizes.select("bucket", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("bucket").orderBy("lang", "word"))
    found = dealt.withColumn("within", within).join(before, "bucket")
    return found.select((F.col("before") + F.col("within") - 1).alias("id"), "lang", "word", "times"), n


class Layout:
    """How n-grams of word ids are packed: two halves of one or two ids each."""

    def __init__(self, n_words: int):
        self.bits = max(1, (n_words - 1).bit_length())

    def halves(self, n: int) -> tuple[int, int]:
        return (self.bits * (n - n // 2), self.bits * (n // 2))

    def pack(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        split = len(ids) - len(ids) // 2
        return self._join(ids[:split]), self._join(ids[split:])

    def _join(self, ids: list[np.ndarray]) -> np.ndarray:
        joined = ids[0]
        for more in ids[1:]:
            joined = (joined << np.uint64(self.bits)) | more
        return joined

    def unpack(self, n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rows of ``n`` ids."""
        columns = []
        for half, width in ((left, n - n // 2), (right, n // 2)):
            for i in range(width - 1, -1, -1):
                columns.append((half >> np.uint64(self.bits * i)) & np.uint64((1 << self.bits) - 1))
        return np.stack(columns, axis=1).astype(np.int64)


def _filters(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["n", "place", "shard", "filter"])


def gram_counts(shards: DataFrame, words: DataFrame, n_words: int, n_tokens: int, least: int) -> DataFrame:
    """All n-grams of 2 to 4 ``words`` (lang, word, id) that ``shards`` hold ``least`` times or more: n, ids, times.

    Every shard counts its n-grams in filters, one for each n and range of the
    permuted keys; a range's filters from all shards are merged in one task.
    Ranges are so many that a merged one has about ``RANGE_KEYS`` keys. Where that
    takes more than 2^12 of them, lots of shards are merged range by range first
    and their filters split further, so no shard is cut into more than 2^12.
    """
    layout = Layout(n_words)
    range_bits = max(0, (n_tokens // RANGE_KEYS).bit_length())

    def bits_of(n: int, wanted: int) -> int:
        return min(wanted, layout.halves(n)[0])

    def split(shard: int, n: int, keys: tuple[np.ndarray, np.ndarray, np.ndarray], wanted: int) -> list[tuple]:
        parts = Q.split(*keys, *layout.halves(n), bits_of(n, wanted))
        return [(n, place, shard, filter_) for place, filter_ in parts]

    def count_shard(group: pa.Table) -> pa.Table:
        shard, n_own, tokens = (group.column(c)[0].as_py() for c in ("shard", "n_own", "tokens"))
        known = group.column("known").combine_chunks().flatten()
        table = np.full(n_own + 1, -1, np.int64)
        table[known.field("place").to_numpy()] = known.field("id").to_numpy()
        ids = table[np.frombuffer(tokens, "<i4")]  # a stop is -1 and finds the last entry, which is no word
        out: list[tuple] = []
        for n in range(2, LONGEST + 1):
            columns = [ids[i : len(ids) - n + 1 + i] for i in range(n)] if len(ids) >= n else []
            whole = np.logical_and.reduce([c >= 0 for c in columns]) if columns else np.zeros(0, bool)
            if not whole.any():
                continue
            left, right = layout.pack([c[whole].astype(np.uint64) for c in columns])
            left, right = Q.permute(left, right, *layout.halves(n))
            keys = Q.tally(left, right, np.ones(len(left), np.int64), *layout.halves(n))
            out += split(shard, n, keys, min(range_bits, FAN_BITS))
        return _filters(out)

    def deeper(wanted: int):
        def split_lot(group: pa.Table) -> pa.Table:
            n, lot = group.column("n")[0].as_py(), group.column("shard")[0].as_py()
            return _filters(split(lot, n, Q.merge(group.column("filter").to_pylist(), *layout.halves(n)), wanted))

        return split_lot

    known = (
        shards.select("shard", "lang", F.posexplode("words").alias("place", "word"))
        .join(words.select("lang", "word", "id"), ["lang", "word"])
        .groupBy("shard")
        .agg(F.collect_list(F.struct("place", "id")).alias("known"))
    )
    rows = shards.select("shard", F.size("words").alias("n_own"), "tokens").join(known, "shard")
    filters = rows.groupBy("shard").applyInArrow(count_shard, FILTER)

    done, lots = min(range_bits, FAN_BITS), 0
    while done < range_bits:
        lots = max(1, (lots or shards.count()) >> FAN_BITS)
        done = min(range_bits, done + FAN_BITS)
        dealt = staged(filters.withColumn("shard", F.pmod(F.xxhash64("shard"), F.lit(lots))), "filters")

        filters = dealt.groupBy("n", "place", "shard").applyInArrow(deeper(done), FILTER)

    def frequent(group: pa.Table) -> pa.Table:
        n = group.column("n")[0].as_py()
        left, right, times = Q.merge(group.column("filter").to_pylist(), *layout.halves(n))
        enough = times >= least
        ids = layout.unpack(n, *Q.restore(left[enough], right[enough], *layout.halves(n)))
        return pa.table(
            [pa.array([n] * len(ids), pa.int32()), pa.array(list(ids), pa.list_(pa.int64())), pa.array(times[enough])],
            names=["n", "ids", "times"],
        )

    return filters.groupBy("n", "place").applyInArrow(frequent, GRAM)


def _with_count(rows: DataFrame, key: str, counts: DataFrame, name: str, n_rows: int) -> DataFrame:
    """``rows`` with the count of the phrase in ``key``; phrases in many rows are spread."""
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("size"))
    totals = counts.select(F.col("ids").alias(key), F.col("times").alias(name)).join(sizes, key)
    return join_totals(rows, totals, key, "size", n_rows).drop("size")


def phrases(docs: DataFrame, least: int = 30, first: int = 2000) -> DataFrame:
    """The ``first`` phrases of 2 to 4 words of each language of ``docs`` (lang, text), by score.

    Returns lang, rank, phrase, a, l, r, n, score as longs and texts. Words of a
    language that occur ``least`` times or more get numbers; no phrase holds
    another one. All n-grams of such words are counted exactly. A phrase's score
    is that of its loosest cut, floor(2,000,000 a / (l + r)), of equals the first;
    phrases that a longer one covers in at least 80 of 100 occurrences go.

    A null text is empty and a null language ``und``; rows without words, and an
    empty table, give no phrases. Equal rows count each. A text of any length is
    read whole, within one shard. Ties in score and a go by the phrase's UTF-8
    bytes, and equal phrases of different languages are different ones. Columns
    other than lang and text are not read.
    """
    shards = staged(word_shards(docs), "word-shards")
    each = shards.select("lang", F.explode(F.arrays_zip("words", "times")).alias("w"))
    all_words = staged(
        each.groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.times").alias("times")), "words"
    )
    sums = all_words.groupBy("lang").agg(F.sum("times").alias("n"))
    n_tokens = all_words.agg(F.sum("times")).first()[0] or 0
    words, n_words = numbered(all_words.filter(F.col("times") >= least))
    words = staged(words, "numbered")
    grams = staged(gram_counts(shards, words, n_words, n_tokens, least), "grams")

    counts = grams.select("ids", "times").unionByName(words.select(F.array("id").alias("ids"), "times"))
    inner = (
        "flatten(transform(sequence(2, n - 1), w -> transform(sequence(1, n - w + 1), i -> slice(ids, i, w))))"
    )
    covered = (
        grams.filter("n > 2")
        .select(F.explode(F.expr(inner)).alias("ids"), "times")
        .groupBy("ids")
        .agg(F.max("times").alias("longer"))
    )
    kept = grams.join(covered, "ids", "left").filter("longer is null or 100 * longer < 80 * times").drop("longer")
    cuts = staged(
        kept.select("ids", F.col("times").alias("a"), F.explode(F.expr("sequence(1, n - 1)")).alias("k")).selectExpr(
            "ids", "a", "k", "slice(ids, 1, k) head", "slice(ids, k + 1, size(ids)) rest"
        ),
        "cuts",
    )
    n_cuts = cuts.count()
    both = _with_count(_with_count(cuts, "head", counts, "l", n_cuts), "rest", counts, "r", n_cuts)
    score = F.expr("(2000000BD * cast(a as decimal(20, 0))) div cast(l + r as decimal(20, 0))")
    loosest = both.select("ids", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
    scored = staged(loosest.groupBy("ids", "a").agg(F.min("cut").alias("cut")), "scored")

    spelled = scored.select("ids", F.posexplode("ids").alias("at", "id"))
    sizes = spelled.groupBy("id").agg(F.count(F.lit(1)).alias("size"))
    spelled = join_totals(spelled, words.select("id", "lang", "word").join(sizes, "id"), "id", "size", LONGEST * n_cuts)
    text = F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"].cast("string")))
    named = spelled.groupBy("ids").agg(F.first("lang").alias("lang"), text.alias("phrase"))

    best = [F.col("cut.score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    found = scored.join(named, "ids").withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best)))
    found = found.filter(F.col("rank") <= first)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)))
    found = found.filter(F.col("rank") <= first).join(sums, "lang")
    return found.select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").alias("score")
    )
