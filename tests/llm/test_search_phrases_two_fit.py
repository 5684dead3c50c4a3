"""Lexical search, phrase collocations and best-two-fit packing against plain versions of their rules."""

import collections
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parchmill.llm import collocations, lexical, two_fit
from parchmill.llm import quotient as Q

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
CLASHES = ", shard long, term string, ids string, lot long, length long, filter string, rank int"


def frame(spark, columns, rows):
    """Rows with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, 1, "t", "i", 2, 3, "f", 4) for r in rows], columns + CLASHES)


# --- lexical search -------------------------------------------------------------


def ranked(docs, items, k):
    term = re.compile(lexical.TERM)
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    terms = [(i, collections.Counter(term.findall(lower(t)))) for i, t in docs]
    terms = [(i, c, sum(c.values())) for i, c in terms if c]
    big_n, big_l = len(terms), sum(n for *_, n in terms)
    df = collections.Counter(t for _, c, _ in terms for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in terms:
            m = 100 - 25 + (25 * n * big_n) // big_l
            score = sum(
                math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                for t in term.findall(lower(text))
                if c[t]
            )
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def test_search_equals_ranking_every_document(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SHARD_DOCS", 100)
    monkeypatch.setattr(lexical, "SPAN", 16)
    monkeypatch.setattr(lexical, "BLOCK", 4)
    monkeypatch.setattr(lexical, "ITEMS_PER_LOT", 5)
    random.seed(5)
    words = [f"w{int(random.paretovariate(0.6))}" for _ in range(400)] + ["Été", "naïve", "x9"]
    text = lambda n: " ".join(random.choices(words, k=n))
    docs = [(i, text(random.randint(1, 60))) for i in range(700)]
    docs += [(i, "same words here") for i in range(700, 760)] + [(None, "same words here"), (None, None), (5, ""), (6, "?!")]
    docs += [(761, "w1 w2 " * 40_000), (3, "same words here")]
    items = [(i, text(random.randint(1, 30))) for i in range(20)]
    items += [(20, "Same, same-words HERE"), (21, None), (22, ""), (23, "nowhereatall"), (None, "w1 w1 w3"), (7, "w2"), (24, "w1")]
    found = lexical.search(
        lexical.build_index(frame(spark, "doc_id long, text string", docs).repartition(3)),
        frame(spark, "item_id long, text string", items),
        k=20,
    )
    assert dict(found.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, ranked(docs, items, 20)))


def test_search_skips_blocks_that_cannot_matter(monkeypatch):
    monkeypatch.setattr(lexical, "SPAN", 64)
    # One rare word in each of the first documents, a common one in all.
    common, rare = list(range(4096)), list(range(30))
    words = [np.asarray([0, 1] if d in rare else [0], np.int32) for d in common]
    rows = lexical.posting_rows(0, [b"common", b"rare"], common, words).to_pylist()
    damping = np.full(4096, 100, np.int64)
    lists = [lexical.PostingList(r, damping, lambda n: np.full(len(n), 100)) for r in rows[1:]]
    docs, scores = lexical.best_documents([(lists[0], 1), (lists[1], 50)], np.arange(4096), 20)
    assert sorted(docs.tolist()) == rare[:20] and len(set(scores.tolist())) == 1
    assert len(lists[0].opened) <= 2 < len(lists[0].bounds)


def test_search_of_nothing(spark):
    none = frame(spark, "doc_id long, text string", [])
    some = frame(spark, "doc_id long, text string", [(1, "a b"), (2, None)])
    items = frame(spark, "item_id long, text string", [(1, "a")])
    assert lexical.search(lexical.build_index(none), items).count() == 0
    assert lexical.search(lexical.build_index(some), items.limit(0)).count() == 0
    # The only term is in the only document that has terms: ln(4/3) is above 0.
    assert [(r.item_id, r.rank, r.doc_id) for r in lexical.search(lexical.build_index(some), items).collect()] == [(1, 1, 1)]


# --- quotient filters and phrases --------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 64), st.integers(1, 64), st.integers(0, 6), st.integers(0, 2**32))
def test_filters_lose_nothing(left_bits, right_bits, range_bits, seed):
    rng = np.random.default_rng(seed)
    range_bits = min(range_bits, left_bits)
    n = int(rng.integers(1, 200))
    left = rng.integers(0, 2**left_bits, n, np.uint64) if left_bits < 64 else rng.integers(0, 2**64, n, np.uint64)
    right = rng.integers(0, min(2**right_bits, 50), n, np.uint64)
    counts = rng.choice([1, 2, 254, 255, 256, 10**12], n).astype(np.int64)
    want = collections.Counter()
    for a, b, c in zip(left.tolist(), right.tolist(), counts.tolist(), strict=True):
        want[a, b] += c
    filters = []
    for part in (slice(0, n // 2), slice(n // 2, n)):
        moved = Q.permute(left[part], right[part], left_bits, right_bits)
        keys = Q.tally(*moved, counts[part], left_bits, right_bits)
        filters += Q.split(*keys, left_bits, right_bits, range_bits)
    got = collections.Counter()
    for place in {p for p, _ in filters}:
        a, b, c = Q.merge([f for p, f in filters if p == place], left_bits, right_bits)
        assert not range_bits or set((a >> np.uint64(left_bits - range_bits)).tolist()) == {place}
        a, b = Q.restore(a, b, left_bits, right_bits)
        got.update(dict(zip(zip(a.tolist(), b.tolist(), strict=True), c.tolist(), strict=True)))
    assert got == want


def test_filters_are_compact():
    left, right = (np.random.default_rng(1).integers(0, 1 << 30, 100_000, np.uint64) for _ in range(2))
    keys = Q.tally(*Q.permute(left, right, 30, 30), np.ones(100_000, np.int64), 30, 30)
    assert len(Q.build(*keys, 30, 30, 0)) < 6.5 * len(keys[0])


def plain_phrases(rows, least, first):
    f = collections.defaultdict(collections.Counter)
    for lang, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            for n in range(1, 5):
                f[lang or "und"].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, counts in f.items():
        n = sum(c for p, c in counts.items() if len(p) == 1)
        candidates = {p: c for p, c in counts.items() if len(p) > 1 and c >= least}
        longer = collections.Counter()
        for p, c in candidates.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    longer[p[i : i + size]] = max(longer[p[i : i + size]], c)
        best = []
        for p, a in candidates.items():
            if 100 * longer[p] >= 80 * a:
                continue
            score, _, l, r = min(
                (2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))
            )
            best.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:first], 1)]
    return out


def speech(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "of", "née", "x_y", "\x01", "a", "b", "c", "d", "\x0bb", "New", "York", "　", "z."]
    texts = []
    for _ in range(n):
        parts = rng.choices(words, k=rng.randint(0, 25)) + rng.choice([["New", "York", "City", "Hall"], ["a\tb", "c"], []])
        texts.append((rng.choice(["en", "en", "de", None]), rng.choice([" ", "  ", "\t"]).join(parts)))
    return texts + [("en", None), ("fr", ""), ("en", "... ,,"), (None, "a b c d " * 3000), ("en", "the the the the the")] + texts[:20]


@pytest.mark.parametrize("small", [False, True])
def test_phrases_equal_counting_all_of_them(spark, monkeypatch, small):
    if small:  # many shards, ranges by several rounds of merging
        monkeypatch.setattr(collocations, "SHARD_WORDS", 300)
        monkeypatch.setattr(collocations, "RANGE_KEYS", 300)
        monkeypatch.setattr(collocations, "FAN_BITS", 2)
        monkeypatch.setattr(collocations, "WORDS_PER_BUCKET", 3)
    rows = speech(11, 300)
    docs = frame(spark, "lang string, text string", rows).repartition(3)
    got = collocations.phrases(docs, least=6, first=40)
    assert [t for _, t in got.dtypes] == ["string", "bigint", "string"] + ["bigint"] * 5
    assert sorted(map(tuple, got.collect())) == sorted(plain_phrases(rows, 6, 40))


def test_phrases_of_wide_ids(spark, monkeypatch):
    monkeypatch.setattr(collocations.Layout, "__init__", lambda self, n: setattr(self, "bits", 32))
    rows = speech(12, 100)
    got = collocations.phrases(frame(spark, "lang string, text string", rows), least=4)
    assert sorted(map(tuple, got.collect())) == sorted(plain_phrases(rows, 4, 2000))


def test_phrases_of_nothing(spark):
    assert collocations.phrases(frame(spark, "lang string, text string", [])).count() == 0
    assert collocations.phrases(frame(spark, "lang string, text string", [("en", None), ("en", "a b")])).count() == 0


# --- best-two-fit --------------------------------------------------------------------


def plain_two_fit(lengths, room):
    """Bins as lists of lengths, by looking at all unpacked lengths each time."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        held, gap = [], room
        while fits := [x for x in left if x <= gap]:
            held.append(fits[0])
            left.remove(fits[0])
            gap -= fits[0]
        if gap and len(held) > 1:
            pairs = [
                (a + b, a, b) for i, a in enumerate(left) for b in left[i + 1 :] if held[-1] < a + b <= gap + held[-1]
            ]
            if pairs:
                _, a, b = max(pairs)
                small = held.pop()
                held += [a, b]
                left.remove(a)
                left.remove(b)
                left = sorted([*left, small], reverse=True)
        bins.append(held)
    return bins


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_two_fit_equals_its_rule(lengths):
    bins, offsets = two_fit.best_two_fit(lengths, 40)
    held = collections.defaultdict(list)
    for i, b in enumerate(bins):
        held[b].append((offsets[i], lengths[i]))
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 40
    assert [[n for _, n in sorted(held[b])] for b in range(len(held))] == plain_two_fit(lengths, 40)


def test_a_closer_pair_replaces_the_smallest():
    # 6 and 3 leave a gap of 1; 2 and 2 in place of the 3 close it, and the 3 waits for the next bin.
    bins, _ = two_fit.best_two_fit([6, 3, 2, 2], 10)
    assert bins == [0, 1, 0, 0]


ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one two three"), (4, "one two three"), (None, "one two three"), (None, None),
    (5, "word " * 2047), (6, "word " * 2048), (7, "Long words. " * 30_000), (8, "ÀÉ <|endoftext|> don't 12 ß \x1c\x85 x"),
]


def test_two_fit_packs_every_id_once(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    random.seed(3)
    rows = ODD + [(100 + i, " ".join(random.choices(["at", "sea", "unlikeliest", "..."], k=random.randint(1, 1500)))) for i in range(300)]
    found = two_fit.pack(frame(spark, "doc_id long, text string", rows).repartition(4), VOCABULARY).collect()
    want = collections.Counter()
    total = 0
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            want[i, piece, start, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    sequences = collections.defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= 1.01 * total / 2048 + 1


def test_two_fit_of_nothing(spark):
    found = two_fit.pack(frame(spark, "doc_id long, text string", []), VOCABULARY)
    assert found.count() == 0
    assert [c for c, _ in found.dtypes] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
