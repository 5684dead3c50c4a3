"""Licence scans: matching statistics against a suffix automaton of licence words, chained to spans."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmill.llm.common import sliced
from parchmill.llm.license_texts import NOTICES, PHRASES

# A match of fewer words starts no span; matches up to so many words apart in the
# text are one span; a notice is named if so much of it is covered.
LEAST_MATCH = 4
MOST_GAP = 8
LEAST_COVER = 0.6

# Words are ASCII letters and digits, lower-cased, and everything beyond ASCII.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


@dataclass
class State:
    length: int
    link: int
    step: dict[int, int] = field(default_factory=dict)
    # For each text that holds the state's strings: the last position of every place.
    places: dict[int, tuple[int, ...]] = field(default_factory=dict)
    # Phrases that end here: (length, phrase).
    phrases: list[tuple[int, int]] = field(default_factory=list)


class SuffixAutomaton:
    """All runs of words of several texts; each text starts again at the root."""

    def __init__(self, texts: list[list[int]], phrases: int):
        """``phrases``: so many of the first texts are phrases to be counted."""
        self.states = [State(0, -1)]
        self.texts = texts
        for t, text in enumerate(texts):
            last = 0
            for at, word in enumerate(text):
                last = self._extend(last, word)
                self.states[last].places[t] = (*self.states[last].places.get(t, ()), at)
        self._spread(phrases)

    def _extend(self, last: int, word: int) -> int:
        states = self.states
        known = states[last].step.get(word)
        if known is not None:
            return known if states[known].length == states[last].length + 1 else self._clone(last, word, known)
        states.append(State(states[last].length + 1, 0))
        new = len(states) - 1
        at = last
        while at >= 0 and word not in states[at].step:
            states[at].step[word] = new
            at = states[at].link
        if at >= 0:
            goal = states[at].step[word]
            states[new].link = goal if states[goal].length == states[at].length + 1 else self._clone(at, word, goal)
        return new

    def _clone(self, at: int, word: int, goal: int) -> int:
        states = self.states
        old = states[goal]
        states.append(State(states[at].length + 1, old.link, dict(old.step)))
        new = len(states) - 1
        old.link = new
        while at >= 0 and states[at].step.get(word) == goal:
            states[at].step[word] = new
            at = states[at].link
        return new

    def _spread(self, phrases: int) -> None:
        """Places go up the suffix links; phrases down them."""
        order = sorted(range(1, len(self.states)), key=lambda s: self.states[s].length)
        for s in reversed(order):
            link = self.states[s].link
            if link > 0:
                up = self.states[link].places
                for text, ends in self.states[s].places.items():
                    up[text] = tuple(sorted({*up.get(text, ()), *ends}))
        for p in range(phrases):
            s = 0
            for word in self.texts[p]:
                s = self.states[s].step[word]
            self.states[s].phrases.append((len(self.texts[p]), p))
        for s in order:
            link = self.states[s].link
            if link > 0:
                self.states[s].phrases = self.states[s].phrases + self.states[link].phrases

    def statistics(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """For each word: the longest run ending there that some text holds, and its state."""
        states, at, length = self.states, 0, 0
        for word in words:
            while word not in states[at].step and at:
                at = states[at].link
                length = states[at].length
            goal = states[at].step.get(word)
            if goal is None:
                length = 0
            else:
                at, length = goal, length + 1
            yield length, at


@dataclass
class Found:
    n_words: int
    places: list[tuple[int, int]]  # first word, phrase
    spans: list[tuple[int, int, str, float]]  # first word, end, notice, share of it covered


class Scanner:
    """Looks up phrases and notices in texts; built once per task."""

    def __init__(self, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES):
        self.phrases = [words_of(p) for p in phrases]
        self.labels = list(phrases.values())
        self.names = [*self.labels, *notices]
        texts = [*self.phrases, *map(words_of, notices.values())]
        self.ids: dict[bytes, int] = {}
        numbered = [[self.ids.setdefault(w, len(self.ids) + 1) for w in t] for t in texts]
        self.lengths = list(map(len, numbered))
        self.automaton = SuffixAutomaton(numbered, len(self.phrases))

    def scan(self, text: str) -> Found:
        words = words_of(text)
        if not words:
            return Found(0, [], [])
        ids = np.fromiter(map(self.ids.get, words, (0,) * len(words)), dtype=np.int32, count=len(words))
        # Words of no licence match nothing: only runs of known words are streamed.
        known = np.flatnonzero(np.diff(np.concatenate(([0], (ids > 0).view(np.int8), [0]))))
        places: list[tuple[int, int]] = []
        matches: list[tuple[int, int, int]] = []  # first word, end, state
        for begin, end in known.reshape(-1, 2).tolist():
            if end - begin < 2 and min(map(len, self.phrases)) > 1:
                continue
            run = ids[begin:end].tolist()
            held: tuple[int, int] | None = None
            for i, (length, state) in enumerate(self.automaton.statistics(run), start=begin + 1):
                for size, phrase in self.automaton.states[state].phrases:
                    if size <= length:
                        places.append((i - size, phrase))
                if held is not None and length <= held[0]:
                    matches.append((i - 1 - held[0], i - 1, held[1]))
                    held = None
                if length >= LEAST_MATCH:
                    held = (length, state)
            if held is not None:
                matches.append((end - held[0], end, held[1]))
        return Found(len(words), sorted(places), self._chain(matches))

    def _chain(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, str, float]]:
        """The spans of each notice: its heaviest chains of matches that follow each other in text and notice.

        Every place of a match in the notice is a link; one continues another if
        it begins within ``MOST_GAP`` words of its end and ends later in text and
        notice. Chains that cover enough become spans, heaviest first, among
        equals the one that ends first; a chain that runs into a span keeps
        what lies behind it. So notices quoted in a row are a span each.
        """
        links: dict[int, list[tuple[int, int, int]]] = {}  # notice: first word, end, end in the notice
        for begin, end, state in matches:
            for notice, ends in self.automaton.states[state].places.items():
                if notice >= len(self.phrases):
                    links.setdefault(notice, []).extend((begin, end, last + 1) for last in ends)
        spans = []
        for notice, found in links.items():
            found.sort()
            covers, before = _chains(found)
            need = LEAST_COVER * self.lengths[notice]
            heavy = sorted((i for i, c in enumerate(covers) if c >= need), key=lambda i: (-covers[i], i))
            taken: list[tuple[int, int]] = []
            for i in heavy:
                begin, end, last = found[i]
                at = bisect_right(taken, (begin, end))
                free = taken[at - 1][1] if at else 0
                if begin < free or (at < len(taken) and end > taken[at][0]):
                    continue
                covered, first = end - begin, last - (end - begin)
                at = before[i]
                while at >= 0 and found[at][0] >= free:
                    covered += found[at][1] - found[at][0] - max(0, found[at][1] - begin, found[at][2] - first)
                    begin, first = found[at][0], found[at][2] - (found[at][1] - found[at][0])
                    at = before[at]
                if covered >= need:
                    insort(taken, (begin, end))
                    spans.append((begin, end, self.names[notice], min(1.0, covered / self.lengths[notice])))
        return sorted(spans)


def _chains(links: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """For each of ``links`` (first word, end, end in the notice; sorted): words covered by the heaviest chain that
    ends there, and the link before it in that chain (-1: none).

    A link looks back over those that overlap it or end within ``MOST_GAP``
    words before it. Matches are maximal, so ends rise with beginnings and the
    search stops at the first that ends too early: the work is that of a few
    neighbours a link, however long the text.
    """
    covers, before = [], []
    for i, (begin, end, last) in enumerate(links):
        best, via = end - begin, -1
        for j in range(i - 1, -1, -1):
            _, other_end, other_last = links[j]
            if begin - other_end > MOST_GAP:
                break
            fresh = end - begin - max(0, other_end - begin, other_last - (last - (end - begin)))
            if other_end < end and other_last < last and fresh > 0 and covers[j] + fresh > best:
                best, via = covers[j] + fresh, j
        covers.append(best)
        before.append(via)
    return covers, before


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<first_word:long,end_word:long,notice:string,covered:double>>"
)


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """Licence phrases and notices in every whole text of ``docs`` (doc_id, text), a row per row.

    n_base counts the places of the phrases, first_word and last_word are the
    smallest and largest word they start at (null without one). ``spans`` are
    runs of words covered by the heaviest chains of matches of a notice, ``labels`` the phrases'
    and the notices' names, ``score`` the largest share of a notice covered, and
    1 where a phrase is found whole.

    Null and empty texts have no words, no labels and score 0. Texts are read
    whole, however long; of equally heavy chains the first counts. Other columns
    are not read, whatever their names. Each row stands on its own: repeated
    rows give equal rows, an empty table none.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, notices)
        spans_type = pa.list_(
            pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("notice", pa.string()), ("covered", pa.float64())])
        )
        for batch in sliced(batches):
            found = [scanner.scan(t or "") for t in batch.column(1).to_pylist()]
            base = [sorted({scanner.labels[p] for _, p in f.places}) for f in found]
            every = [sorted({*b, *(s[2] for s in f.spans)}) for b, f in zip(base, found, strict=True)]
            names = ("first_word", "end_word", "notice", "covered")
            columns = [
                batch.column(0),
                pa.array([f.n_words for f in found], pa.int64()),
                pa.array([len(f.places) for f in found], pa.int64()),
                pa.array([f.places[0][0] if f.places else None for f in found], pa.int64()),
                pa.array([f.places[-1][0] if f.places else None for f in found], pa.int64()),
                pa.array([",".join(b) for b in base], pa.string()),
                pa.array([",".join(x) for x in every], pa.string()),
                pa.array([1.0 if f.places else max((s[3] for s in f.spans), default=0.0) for f in found], pa.float64()),
                pa.array([[dict(zip(names, s, strict=True)) for s in f.spans] for f in found], spans_type),
            ]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(search, SCHEMA)
