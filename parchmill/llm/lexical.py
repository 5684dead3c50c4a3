"""Ranked lexical search: Block-Max MaxScore over posting lists of document shards."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parchmill.llm.common import sliced, staged

# A shard ends with so many documents, or with the one that brings it to so many words.
SHARD_DOCS = 16_384
SHARD_WORDS = 4_000_000
BLOCK = 128
SPAN = 1024
ITEMS_PER_LOT = 256

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# The same as a byte table: what is no term turns into a space, A-Z into a-z.
_FOLD = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))

INDEX = (
    "shard long, term binary, df long, n_words long, doc_ids array<long>, gaps binary, gap_bytes int, tfs binary,"
    " tf_bytes int, last binary, most_tf binary, least_n binary"
)
# The row of a shard that lists its documents has this term, which no text holds.
HEADER = b""


def term_list(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _narrow(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Slices of unsigned ``values`` as bytes, each as narrow as its largest value allows, and their widths."""
    most = np.maximum.reduceat(values, starts)
    widths = np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4))
    whole = {w: values.astype(f"<u{w}").tobytes() for w in (1, 2, 4) if (widths == w).any()}
    cut = [whole[w][s * w : e * w] for w, s, e in zip(widths.tolist(), starts.tolist(), ends.tolist(), strict=True)]
    return cut, widths


def posting_rows(shard: int, vocabulary: list[bytes], doc_ids: list, words: list[np.ndarray]) -> pa.RecordBatch:
    """The index rows of one shard: its documents, then a posting list for each term."""
    lengths = np.asarray([len(w) for w in words], dtype=np.int64)
    docs = np.repeat(np.arange(len(words), dtype=np.int64), lengths)
    pairs, tf = np.unique((np.concatenate(words).astype(np.int64) << 32) | docs, return_counts=True)
    term, doc = pairs >> 32, pairs & 0xFFFFFFFF
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    ends = np.append(starts[1:], len(term))
    sizes = ends - starts
    within = np.arange(len(term)) - np.repeat(starts, sizes)
    gap = np.diff(doc, prepend=0)
    gap[starts] = doc[starts]
    gaps, gap_bytes = _narrow(gap, starts, ends)
    tfs, tf_bytes = _narrow(tf, starts, ends)
    blocks = np.flatnonzero(within % BLOCK == 0)
    block_ends = np.append(blocks[1:], len(term)) - 1
    most_tf = np.maximum.reduceat(tf, blocks).astype("<u4").tobytes()
    least_n = np.minimum.reduceat(lengths[doc], blocks).astype("<u4").tobytes()
    last = doc[block_ends].astype("<u4").tobytes()
    at = np.concatenate([[0], np.cumsum(-(-sizes // BLOCK))]).tolist()
    spans = list(zip(at[:-1], at[1:], strict=True))

    def per_block(data: bytes) -> list[bytes]:
        return [data[4 * a : 4 * b] for a, b in spans]

    order = term[starts].tolist()
    n = len(order) + 1
    columns = [
        pa.array([shard] * n, pa.int64()),
        pa.array([HEADER] + [vocabulary[t] for t in order], pa.binary()),
        pa.array([len(words)] + sizes.tolist(), pa.int64()),
        pa.array([int(lengths.sum())] + [None] * (n - 1), pa.int64()),
        pa.array([doc_ids] + [None] * (n - 1), pa.list_(pa.int64())),
        pa.array([lengths.astype("<u4").tobytes()] + gaps, pa.binary()),
        pa.array([4] + gap_bytes.tolist(), pa.int32()),
        pa.array([b""] + tfs, pa.binary()),
        pa.array([0] + tf_bytes.tolist(), pa.int32()),
        *(pa.array([b""] + per_block(data), pa.binary()) for data in (last, most_tf, least_n)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in INDEX.split(", ")])


def build_index(docs: DataFrame) -> DataFrame:
    """Posting lists of every term of every row of ``docs`` (doc_id, text), a row per shard and term.

    Documents are numbered within their shard in the order read. A list holds
    gaps between numbers and occurrences, as narrow integers; for each block of
    128 it says the last number, the most occurrences and the fewest words of a
    document, from which a query derives the block's greatest impact. Texts
    without terms are in no shard.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        vocabulary: dict[bytes, int] = defaultdict(count().__next__)
        ids: list = []
        words: list[np.ndarray] = []
        held = 0
        for batch in sliced(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = term_list(text or b"")
                if not found:
                    continue
                ids.append(doc_id)
                words.append(np.fromiter(map(vocabulary.__getitem__, found), np.int32, len(found)))
                held += len(found)
                if len(ids) == SHARD_DOCS or held >= SHARD_WORDS:
                    yield posting_rows(base, list(vocabulary), ids, words)
                    base, held, ids, words = base + 1, 0, [], []
                    vocabulary = defaultdict(count().__next__)
        if ids:
            yield posting_rows(base, list(vocabulary), ids, words)

    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return staged(whole.mapInArrow(shards, INDEX), "postings")


class PostingList:
    """One term's list in one shard; blocks are decompressed when asked for, once."""

    def __init__(self, row: dict, damping: np.ndarray, least_damping):
        self.damping = damping
        self.gaps = np.frombuffer(row["gaps"], f"<u{row['gap_bytes']}")
        self.tfs = np.frombuffer(row["tfs"], f"<u{row['tf_bytes']}")
        self.last = np.frombuffer(row["last"], "<u4").astype(np.int64)
        most = np.frombuffer(row["most_tf"], "<u4").astype(np.int64)
        self.bounds = impact(most, least_damping(np.frombuffer(row["least_n"], "<u4").astype(np.int64)))
        self.bound = int(self.bounds.max())
        self.opened: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        # The greatest impact in each span of documents: that of the blocks which reach into it.
        begins = np.arange(0, len(damping), SPAN)
        first = np.searchsorted(self.last, begins)
        final = np.minimum(np.searchsorted(self.last, begins + SPAN - 1) + 1, len(self.last))
        self.span_bounds = np.asarray(
            [self.bounds[a:b].max() if a < b else 0 for a, b in zip(first.tolist(), final.tolist(), strict=True)], np.int64
        )

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Document numbers and impacts of block ``i``."""
        found = self.opened.get(i)
        if found is None:
            cut = slice(BLOCK * i, BLOCK * (i + 1))
            docs = np.cumsum(self.gaps[cut].astype(np.int64))
            if i:
                docs += self.last[i - 1]
            found = self.opened[i] = docs, impact(self.tfs[cut].astype(np.int64), self.damping[docs])
        return found

    def between(self, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Postings of documents numbered ``begin`` to ``end`` - 1."""
        a, b = np.searchsorted(self.last, [begin, end - 1]).tolist()
        parts = [self.block(i) for i in range(a, min(b + 1, len(self.last)))]
        if not parts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        docs, impacts = (np.concatenate(p) for p in zip(*parts, strict=True))
        cut = slice(*np.searchsorted(docs, [begin, end]).tolist())
        return docs[cut], impacts[cut]


def impact(tf: np.ndarray, damping: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * damping)


def best_documents(
    terms: list[tuple[PostingList, int]], order: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` documents of a shard with the greatest scores above 0: numbers and scores.

    ``terms`` are lists and their weights (above 0); ``order`` is the rank of
    each document among equals. Lists are sorted by their greatest
    contribution. Those whose contributions together stay below the k-th score
    so far are not essential: no document is looked at for their sake. The
    documents of the essential lists are then held against the block maxima of
    the others, strongest first, and only blocks that a document could still
    need are decompressed. Spans of documents are visited from the most
    promising on, so the k-th score rises early and the rest of the spans falls
    below it. Bounds equal to the k-th score are never cut: ties go by rank.
    """
    terms = sorted(terms, key=lambda t: t[0].bound * t[1])
    reach = np.cumsum([t.bound * w for t, w in terms]).tolist()
    promise = sum(t.span_bounds * w for t, w in terms)
    found, scores = np.empty(0, np.int64), np.empty(0, np.int64)
    least = 1
    for span in np.argsort(-promise, kind="stable").tolist():
        if promise[span] < least:
            break
        essential = int(np.searchsorted(reach, least))
        if essential == len(terms):
            break
        begin, end = span * SPAN, min((span + 1) * SPAN, len(order))
        sums = np.zeros(end - begin, np.int64)
        for postings, weight in terms[essential:]:
            docs, impacts = postings.between(begin, end)
            sums[docs - begin] += weight * impacts
        some = np.flatnonzero(sums)
        partial = sums[some]
        some = some + begin
        for i in range(essential - 1, -1, -1):
            postings, weight = terms[i]
            at = np.searchsorted(postings.last, some)
            inside = at < len(postings.last)
            at = np.where(inside, at, 0)
            most = np.where(inside, weight * postings.bounds[at], 0)
            live = partial + most + (reach[i - 1] if i else 0) >= least
            some, partial, at, inside = some[live], partial[live], at[live], inside[live]
            for b in np.unique(at[inside]).tolist():
                docs, impacts = postings.block(b)
                here = np.flatnonzero(inside & (at == b))
                place = np.minimum(np.searchsorted(docs, some[here]), len(docs) - 1)
                hit = docs[place] == some[here]
                partial[here[hit]] += weight * impacts[place[hit]]
        fit = partial >= least
        found, scores = np.concatenate([found, some[fit]]), np.concatenate([scores, partial[fit]])
        if len(found) > k:
            kept = np.lexsort((order[found], -scores))[:k]
            found, scores = found[kept], scores[kept]
        if len(found) == k:
            least = max(1, int(scores.min()))
    return found, scores


def item_terms(items: DataFrame) -> DataFrame:
    """Every distinct term of each item and its occurrences: row, term, times."""
    lowered = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    each = items.select("row", F.explode(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))).alias("term"))
    return each.groupBy("row", F.col("term").cast("binary").alias("term")).agg(F.count(F.lit(1)).alias("times"))


def search(index: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` best documents of ``index`` for each row of ``items`` (item_id, text).

    Returns item_id, rank, doc_id, score, all integer arithmetic after a term's
    weight. Items are dealt into lots of about 256. A task holds one shard and
    one lot: the posting lists of the lot's terms, each with the items that ask
    for it. Every shard answers with at most ``k`` documents an item, and these
    heaps are merged by rank.

    An item whose text is null or has no terms, or whose terms no document
    holds, has no rows. Rows of ``items`` that repeat an item_id are ranked one
    by one, and null ids stay null. Documents that repeat a doc_id are ranked
    one by one; null ids come after all others of the same score.
    """
    totals = index.filter(F.col("term") == F.lit(HEADER)).agg(F.sum("df"), F.sum("n_words")).first()
    n_docs, n_words = (totals[0] or 0), (totals[1] or 1)
    asked = staged(items.select("item_id", "text").withColumn("row", F.monotonically_increasing_id()), "items")
    lots = max(1, -(-asked.count() // ITEMS_PER_LOT))
    lot = F.pmod(F.xxhash64("row"), F.lit(lots))
    terms = item_terms(asked)
    held = index.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2 * n_docs + 2).cast("double")) / (2 * F.col("df") + 1)))
    uses = (
        terms.join(held, "term")
        .select("row", "term", (F.col("times") * weight).cast("long").alias("weight"))
        .filter("weight > 0")
        .groupBy(lot.alias("lot"), "term")
        .agg(F.collect_list(F.struct("row", "weight")).alias("uses"))
    )
    none = F.expr("cast(array() as array<struct<row: bigint, weight: bigint>>)")
    headers = index.sparkSession.range(lots).select(F.col("id").alias("lot"), F.lit(HEADER).alias("term"), none.alias("uses"))
    wanted = staged(uses.unionByName(headers), "wanted")

    def answer(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        header = next(r for r in rows if r["term"] == HEADER)
        lengths = np.frombuffer(header["gaps"], "<u4").astype(np.int64)

        def damping(n: np.ndarray) -> np.ndarray:
            return 100 - 25 + (25 * n * n_docs) // n_words

        ids = header["doc_ids"]
        by_id = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        order = np.empty(len(ids), np.int64)
        order[by_id] = np.arange(len(ids))
        of_doc = damping(lengths)
        by_item: dict[int, list[tuple[PostingList, int]]] = defaultdict(list)
        for row in rows:
            if row["uses"]:
                postings = PostingList(row, of_doc, damping)
                for use in row["uses"]:
                    by_item[use["row"]].append((postings, use["weight"]))
        out: list[tuple[int, int | None, int]] = []
        for item, own in by_item.items():
            docs, scores = best_documents(own, order, k)
            out += [(item, ids[d], s) for d, s in zip(docs.tolist(), scores.tolist(), strict=True)]
        columns = list(zip(*out, strict=True)) if out else [[], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["row", "doc_id", "score"])

    heaps = index.join(wanted, "term").groupBy("shard", "lot").applyInArrow(answer, "row long, doc_id long, score long")
    best = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = heaps.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.join(asked.select("row", "item_id"), "row").select("item_id", "rank", "doc_id", "score")
