"""Chat formatting by incremental black-box rendering of turn prefixes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]  # role, text
Template = Callable[[list[Turn]], str]

# Conversations are rendered whole after each of so many turns, and then whenever they have doubled.
STEP_TURNS = 16

# The control strings of the template below.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def escape(text: str) -> str:
    """No control string is left in the result; ``unescape`` gives the text back."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def marked_turns(turns: list[Turn]) -> str:
    """The production template: each turn between its marks, role on the first line."""
    return "".join(f"{OPEN}{escape(role)}\n{escape(text)}{CLOSE}\n" for role, text in turns)


_MARKED = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*?)" + re.escape(CLOSE) + "\n", re.S)


def read_marked(piece: str) -> Turn:
    """Role and text back from the rendering of one turn."""
    found = _MARKED.fullmatch(piece)
    return unescape(found[1]), unescape(found[2])


def _common(a: str, b: str) -> int:
    """Length of the common beginning, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


@dataclass
class Piece:
    """What one turn added to the rendering, and where its text stands in that."""

    text: str
    begin: int
    end: int
    rewrites: bool


class Renderer:
    """Finds the span of each next turn by comparing a template's consecutive outputs.

    Only the outputs are looked at, and each turn is rendered after all turns
    before it: right for any template, with work that grows with the square of
    a conversation's length. With ``context`` a turn is rendered after the first
    and the last of the turns before, so many together: a guess at its piece
    that ``Conversation`` holds against whole renderings.
    """

    def __init__(self, template: Template, context: int | None = None):
        self.template, self.context = template, context
        self.turns: list[Turn] = []
        self.before = template([])

    def add(self, turn: Turn) -> Piece:
        head = self.turns
        before = self.before
        after = self.template([*head, turn])
        rewrites = not after.startswith(before)
        same = _common(before, after) if rewrites else len(before)
        # Two texts that differ in every character show where the template puts the text.
        one, two = (self.template([*head, (turn[0], c)])[0 if rewrites else same :] for c in "xy")
        shared = _common(one, two)
        tail = _common(one[::-1], two[::-1])
        begin, end = (shared - same if rewrites else shared), len(after) - same - tail
        if len(one) - tail <= shared or begin < 0:  # the text does not show in what this turn added
            begin = end = len(after) - same
        piece = Piece(after[same:], begin, max(begin, end), rewrites)
        self.turns = [*head, turn]
        if self.context is not None and len(self.turns) > self.context:
            self.turns = [self.turns[0], *self.turns[2:]]
            self.before = self.template(self.turns)
        else:
            self.before = after
        return piece


def _adds_up(whole: str, said: str, pieces: list[Piece]) -> bool:
    """Is ``whole`` what was ``said`` and the pieces, one after another?"""
    at = len(said)
    if not whole.startswith(said):
        return False
    for piece in pieces:
        if piece.rewrites or not whole.startswith(piece.text, at):
            return False
        at += len(piece.text)
    return at == len(whole)


class Conversation:
    """The pieces of one conversation's turns, settled in stretches.

    Up to ``STEP_TURNS`` turns every prefix is rendered as it is. Then turns are
    rendered in a short context, and the whole prefix whenever the conversation
    has doubled and at its end. If that is the rendering settled before and the
    pieces since, they stand; if not, each prefix of the stretch is rendered
    whole and compared with the one before. So a template that puts out turn
    after turn costs a few times its output, and one that looks further back (it
    counts turns, or rewrites what is long past) costs the square of the
    conversation in stretches that show it, with the same pieces as without
    stretches. Unseen stays only a rewrite of what is over a context back that
    the template itself has undone by the end of the stretch.

    Memory holds the conversation and its rendering, which the template needs whole.
    """

    def __init__(self, template: Template):
        self.template = template
        self.steps = Renderer(template, STEP_TURNS)
        self.turns: list[Turn] = []
        self.said = self.steps.before
        self.open: list[tuple[tuple, Piece]] = []
        self.check_at = 2 * STEP_TURNS

    def add(self, key: tuple, turn: Turn) -> list[tuple[tuple, Piece]]:
        """The turns that this one settles, under the keys they came with."""
        self.open.append((key, self.steps.add(turn)))
        self.turns.append(turn)
        if len(self.turns) <= STEP_TURNS:
            self.said = self.steps.before
            settled, self.open = self.open, []
            return settled
        if len(self.turns) < self.check_at:
            return []
        self.check_at *= 2
        return self.settle()

    def settle(self) -> list[tuple[tuple, Piece]]:
        if not self.open:
            return []
        whole = self.template(self.turns)
        pieces = [piece for _, piece in self.open]
        if not _adds_up(whole, self.said, pieces):
            exact = Renderer(self.template)
            exact.turns, exact.before = self.turns[: -len(pieces)], self.said
            pieces = [exact.add(turn) for turn in self.turns[-len(pieces) :]]
        self.said = whole
        settled = [(key, piece) for (key, _), piece in zip(self.open, pieces, strict=True)]
        self.open = []
        return settled


SPANS = "conv_id long, turn long, position long, role string, piece string, text_begin long, text_end long, rewrites boolean"


def _ordered(conversations: DataFrame) -> DataFrame:
    """Conversations whole and in order on their partitions, whatever their length: nothing is collected."""
    rows = conversations.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_last(), "role", "text"]
    return rows.repartition("conv_id").sortWithinPartitions(*order)


def _stream(batches: Iterator[pa.RecordBatch], template: Template) -> Iterator[tuple[tuple, Piece]]:
    """((conv_id, turn, position, role), piece) in order; position 0 begins a conversation."""
    now, talk, position = object(), None, 0
    for batch in batches:
        for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if talk is None or conv != now:
                if talk is not None:
                    yield from talk.settle()
                now, talk, position = conv, Conversation(template), 0
            yield from talk.add((conv, turn, position, role), (role, text))
            position += 1
    if talk is not None:
        yield from talk.settle()


def format_turns(conversations: DataFrame, template: Template = marked_turns) -> DataFrame:
    """Each turn's part of its conversation's rendering, and the span of its text in it.

    Input: conv_id, turn, role, text. Output: conv_id, turn, position, role,
    piece, text_begin, text_end (in the piece), rewrites. Pieces in the order of
    position are the rendering. ``rewrites`` tells that the template changed
    what it had put out before this turn; the piece is then what follows the
    part that stayed. How prefixes are rendered is told at ``Conversation``.

    Null roles and texts are empty. Turns are in order of turn (null last), role
    and text, so repeated rows stay, next to each other. Rows without conv_id
    are one conversation. Texts are whole, however long. Further columns are left
    out, whatever their names. An empty table gives no rows.
    """

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for key, piece in _stream(batches, template):
            rows.append((*key, piece.text, piece.begin, piece.end, piece.rewrites))
            if len(rows) == 1000:
                yield _batch(rows, SPANS)
                rows = []
        yield _batch(rows, SPANS)

    return _ordered(conversations).mapInArrow(render, SPANS)


DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long, rewrites boolean"
)
_ARROW = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def conversation_digests(
    conversations: DataFrame,
    template: Template = marked_turns,
    read_back: Callable[[str], Turn] = read_marked,
    plain: Callable[[str], str] = unescape,
    loss_role: str = "assistant",
) -> DataFrame:
    """One row per conversation, read back from what the template put out.

    turns_sha256: role, line end, text, line end of each turn, as parsed from its
    piece. loss_chars, loss_sha256: the text spans of ``loss_role`` turns, made
    plain. formatted_chars: the whole rendering. rewrites: the template changed
    what it had put out, at any turn. Same rules for nulls, ties, repeated rows,
    long texts and further columns as ``format_turns``.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        state: list | None = None

        def close() -> tuple:
            conv, n, turns, chars, loss, length, rewrites = state
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), length, rewrites

        for (conv, _, position, _), piece in _stream(batches, template):
            if position == 0:
                if state is not None:
                    rows.append(close())
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, False]
                if len(rows) == 1000:
                    yield _batch(rows, DIGESTS)
                    rows = []
            role, text = read_back(piece.text)
            state[1] += 1
            state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if role == loss_role:
                masked = plain(piece.text[piece.begin : piece.end])
                state[3] += len(masked)
                state[4].update(masked.encode("utf-8", "surrogatepass"))
            state[5] += len(piece.text)
            state[6] |= piece.rewrites
        if state is not None:
            rows.append(close())
        yield _batch(rows, DIGESTS)

    return _ordered(conversations).mapInArrow(digest, DIGESTS)
