"""Packing token sequences by best-two-fit: greedy bins whose smallest document may give way to a closer pair."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmill.llm.common import sliced, staged
from parchmill.llm.packing import Encoder

PIECES_PER_GROUP = 32_768
# Chunks of text, and words, whose ids a task remembers: some 200 bytes each.
MEMO_CHUNKS = 600_000

_LISTED = "doc_id long, piece int, start long, length long, ids_crc32 long"


def document_pieces(docs: DataFrame, vocabulary: str, room: int, end_id: int) -> DataFrame:
    """A row per piece of each document's ids, ``end_id`` last; only documents longer than ``room`` are cut."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary, MEMO_CHUNKS)
        end = np.asarray([end_id], dtype="<u4").tobytes()
        lot = 0
        for batch in sliced(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids: list = []
            numbers: list[tuple[int, int, int, int]] = []
            for doc_id, data in zip(batch.column(0).to_pylist(), encoder.encode(texts), strict=True):
                data += end
                for piece, at in enumerate(range(0, len(data), 4 * room)):
                    part = data[at : at + 4 * room]
                    ids.append(doc_id)
                    numbers.append((piece, piece * room, len(part) // 4, zlib.crc32(part)))
            if not ids:
                continue
            piece, start, length, crc = np.asarray(numbers, dtype=np.int64).T
            lots = np.arange(lot, lot + len(ids))
            lot += len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(piece, pa.int32())] + [pa.array(c, pa.int64()) for c in (start, length, crc, lots)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "lot"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, _LISTED + ", lot long")


class Stock:
    """Unpacked pieces by length, with the lengths at hand as bits of one number.

    ``at_hand`` has bit ``n`` set while a piece of length ``n`` is unpacked, and
    ``mirror`` bit ``room - n``, so that one shift and one "and" show every pair
    of lengths with a given sum.
    """

    def __init__(self, lengths: list[int], room: int):
        self.room, self.at_hand, self.mirror = room, 0, 0
        self.pieces: list[list[int]] = [[] for _ in range(room + 1)]
        for i in range(len(lengths) - 1, -1, -1):
            self.put(lengths[i], i)

    def put(self, length: int, piece: int) -> None:
        self.pieces[length].append(piece)
        self.at_hand |= 1 << length
        self.mirror |= 1 << (self.room - length)

    def take(self, length: int) -> int:
        same = self.pieces[length]
        piece = same.pop()
        if not same:
            self.at_hand ^= 1 << length
            self.mirror ^= 1 << (self.room - length)
        return piece

    def longest(self, gap: int) -> int:
        """The greatest length at hand of at most ``gap``; 0 if there is none."""
        return max(0, (self.at_hand & ((2 << gap) - 1)).bit_length() - 1)

    def closest_pair(self, gap: int, more_than: int) -> tuple[int, int] | None:
        """Two lengths at hand with the greatest sum in (more_than, gap], the most unequal of equals."""
        for total in range(gap, more_than, -1):
            either = self.at_hand & (self.mirror >> (self.room - total))
            if total % 2 == 0 and len(self.pieces[total // 2]) == 1:
                either &= ~(1 << (total // 2))
            if either:
                longer = either.bit_length() - 1
                return longer, total - longer
        return None


def best_two_fit(lengths: list[int], room: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length (1 to ``room``).

    A bin takes the longest length that fits until none does. If it then holds
    several and has room left, its smallest goes back to the stock when two
    unpacked lengths together fill its place and the gap further than it did;
    of such pairs the one with the greatest sum is taken.
    """
    stock = Stock(lengths, room)
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    opened = 0
    while stock.at_hand:
        held: list[tuple[int, int]] = []
        gap = room
        while gap and (length := stock.longest(gap)):
            held.append((length, stock.take(length)))
            gap -= length
        if gap and len(held) > 1:
            smallest, piece = held[-1]
            pair = stock.closest_pair(gap + smallest, smallest)
            if pair is not None:
                held[-1:] = [(length, stock.take(length)) for length in pair]
                stock.put(smallest, piece)
        at = 0
        for length, piece in held:
            bins[piece], offsets[piece] = opened, at
            at += length
        opened += 1
    return bins, offsets


def pack(docs: DataFrame, vocabulary: str, room: int = 2048, end_id: int = 0) -> DataFrame:
    """Pack all ``docs`` (doc_id, text) into few sequences of at most ``room`` ids.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset. What is packed are a few numbers per piece, never ids or
    texts. They are written once and dealt into random groups of about
    ``PIECES_PER_GROUP``, so that a group is bounded however large the table is
    or however often a document repeats; a lost group is packed again alone.

    A null or empty text, or one without words, is the end id alone. A document
    of up to ``room`` ids is one piece; a longer one, however long, is cut every
    ``room`` ids. Rows that repeat a doc_id, or have none, are packed one by one.
    Of equal lengths the smaller doc_id and start goes first. An empty table
    gives no rows; other columns, whatever their names, are not read.
    """
    pieces = staged(document_pieces(docs, vocabulary, room, end_id), "two-fit-pieces")
    groups = max(1, -(-pieces.count() // PIECES_PER_GROUP))
    dealt = pieces.withColumn("lot", F.pmod(F.xxhash64("doc_id", "start", "lot"), F.lit(groups)))

    def fill(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("start", "ascending")])
        bins, offsets = best_two_fit(group.column("length").to_pylist(), room)
        numbers = (group.column("lot")[0].as_py() << 32) + np.asarray(bins, dtype=np.int64)
        return (
            group.drop_columns(["lot"])
            .append_column("sequence_id", pa.array(numbers, pa.int64()))
            .append_column("offset", pa.array(offsets, pa.int64()))
        )

    return dealt.groupBy("lot").applyInArrow(fill, _LISTED + ", sequence_id long, offset long")
