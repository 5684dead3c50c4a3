"""Packing token sequences: first-fit decreasing over a tournament tree, in randomised groups."""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmill.llm.common import sliced, staged

# Chunks of text between spaces are encoded once and remembered, up to so many
# of so many characters; longer ones are encoded where they stand.
MEMO_CHUNKS = 150_000
MEMO_CHARS = 48
PIECES_PER_GROUP = 8192


# A word of Latin letters, each one code point in every normal form, and marks that part from it.
_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?&%$#*|()]*)")


def _byte_letters() -> dict[int, str]:
    """The letter a byte-level vocabulary writes for each byte: itself if it shows, else the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


BYTE_LETTERS = _byte_letters()


class Encoder:
    """Token ids of whole texts as little-endian 32-bit bytes.

    The vocabulary drops white space and lower-cases before it looks at words,
    and parts letters from marks. So a text's ids are those of its chunks
    between spaces and line ends, one after another, and a chunk of a Latin word
    and marks has the ids of the lower-cased word and of the marks. Words go to
    the tokenizer's model, everything else to the tokenizer as it is.
    """

    def __init__(self, vocabulary: str, most_chunks: int = MEMO_CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.model = self.tokenizer.model
        self.most_chunks = most_chunks
        self.words: dict[str, bytes] = {}
        self.memo: dict[str, bytes] = {"": b""}

    def _whole(self, chunk: str) -> bytes:
        ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: str) -> bytes:
        parts = _WORD.fullmatch(chunk)
        if parts is None:
            return self._whole(chunk)
        word = parts[1].lower()
        found = self.words.get(word)
        if found is None:
            letters = word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_LETTERS)
            ids = [t.id for t in self.model.tokenize(letters)]
            found = self.words[word] = struct.pack(f"<{len(ids)}I", *ids)
        if not parts[2]:
            return found
        marks = self.words.get(parts[2])
        if marks is None:
            marks = self.words[parts[2]] = self._whole(parts[2])
        return found + marks

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            chunks = text.replace("\n", " ").split(" ")
            if len(self.memo) > self.most_chunks:
                self.memo = {"": b""}
            if len(self.words) > self.most_chunks:
                self.words = {}
            new = set(chunks).difference(self.memo)
            for chunk in new:
                self.memo[chunk] = self._chunk(chunk)
            yield b"".join(map(self.memo.__getitem__, chunks))
            for chunk in new:
                if len(chunk) > MEMO_CHARS:
                    del self.memo[chunk]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, lot long"


def token_pieces(docs: DataFrame, vocabulary: str, room: int = 2048, end_id: int = 1) -> DataFrame:
    """Cut every document's ids, ``end_id`` last, into pieces of ``room`` ids and a rest."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, lot = Encoder(vocabulary), 0
        end = np.asarray([end_id], dtype="<u4").tobytes()
        for batch in sliced(batches):
            ids = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows: list[tuple] = []
            for doc_id, data in zip(ids, encoder.encode(texts), strict=True):
                data += end
                n = len(data) // 4
                for start in range(0, n, room):
                    piece = data[4 * start : 4 * (start + room)]
                    rows.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), n, lot))
                    lot += 1
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "lot"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


class Tournament:
    """Bins of one capacity under a tree whose nodes hold the most room below them."""

    def __init__(self, n: int, room: int):
        self.leaves = 1 << max(0, (n - 1).bit_length())
        self.most = [room] * (2 * self.leaves)

    def place(self, length: int) -> tuple[int, int]:
        """Put ``length`` into the first bin with room for it: bin, room left before."""
        most, at = self.most, 1
        while at < self.leaves:
            at *= 2
            if most[at] < length:
                at += 1
        left = most[at]
        most[at] -= length
        chosen = at - self.leaves
        at //= 2
        while at:
            best = max(most[2 * at], most[2 * at + 1])
            if most[at] == best:
                break
            most[at] = best
            at //= 2
        return chosen, left


def first_fit_decreasing(lengths: list[int], room: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length; bins are numbered as they open."""
    tree = Tournament(len(lengths), room)
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        bins[i], left = tree.place(lengths[i])
        offsets[i] = room - left
    return bins, offsets


def pack(docs: DataFrame, vocabulary: str, room: int = 2048, end_id: int = 1) -> DataFrame:
    """Pack all ``docs`` (doc_id, text) into sequences of at most ``room`` ids.

    Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset. Pieces (a few numbers each, never their ids) are dealt
    into random groups of about ``PIECES_PER_GROUP``; each group is packed on its
    own by first-fit decreasing, so groups are bounded whatever the table holds
    and a lost one is packed again alone. A sequence belongs to one group.

    A null or empty text is the end id alone, as is a text without words. A text
    longer than ``room`` fills sequences of its own and packs its rest. Rows
    that repeat a doc_id are packed one by one. Ties are placed in the order of
    doc_id and start. An empty table gives no rows.
    """
    pieces = staged(token_pieces(docs, vocabulary, room, end_id), "pieces")
    groups = max(1, -(-pieces.count() // PIECES_PER_GROUP))
    dealt = pieces.withColumn("lot", F.pmod(F.xxhash64("doc_id", "start", "lot"), F.lit(groups)))

    def fill(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("start", "ascending")])
        bins, offsets = first_fit_decreasing(group.column("length").to_pylist(), room)
        first = group.column("lot")[0].as_py() << 32
        return group.drop_columns(["lot"]).append_column(
            "sequence_id", pa.array((first + np.asarray(bins, dtype=np.int64)), pa.int64())
        ).append_column("offset", pa.array(offsets, pa.int64()))

    schema = PIECES.replace(", lot long", ", sequence_id long, offset long")
    return dealt.groupBy("lot").applyInArrow(fill, schema)
