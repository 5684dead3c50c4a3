"""Operators on texts against brute force, and what they do with nulls, empty, repeated and odd rows."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parchmill.llm import exact, jaccard, language, licenses, mixing, packing, secrets
from parchmill.llm.shingles import Signatures, WordHashes, folded, odd_sketch, shingle_set

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, keep_id string, row int, part int"


def frame(spark, rows):
    """Documents with extra columns whose names operators use inside."""
    full = [(i, t, lang, source, len(t or ""), "x", "y", 1, 2) for i, t, lang, source in rows]
    return spark.createDataFrame(full, SCHEMA)


ODD = [
    (1, None, "en", "b"),
    (2, "", "en", None),
    (3, " \t\n", None, "a"),
    (4, "one two three four five six", "en", "a"),
    (4, "one two three four five six", "en", "a"),
    (5, "one two  three\tfour five six", "en", "b"),
    (6, "one two three four five six", "en", "b"),
    (7, "word " * 30_000, "en", "c"),
    (None, "one two three four five six", None, "c"),
    (9, "ÀÉ <|endoftext|> don't 12 ß \x1c\x85 x", "fr", "d"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def test_exact_rules_for_odd_rows(odd, empty):
    found = exact.mark_duplicates(odd).collect()
    normal = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = collections.defaultdict(list)
    for i, t, *_ in ODD:
        groups[normal(t)].append(i)
    want = []
    for i, t, *_ in ODD:
        own = groups[normal(t)]
        keep = min((x for x in own if x is not None), default=None)
        want.append((i, keep, len(own), i == keep, hashlib.sha256(normal(t).encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))
    assert exact.mark_duplicates(empty).count() == 0
    kept = exact.drop_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 4, 5, 7, 9]
    assert exact.drop_duplicates(empty).count() == 0


def test_exact_passes_unique_rows_without_shuffle(spark):
    docs = frame(spark, [(i, f"text {i}", "en", "a") for i in range(300)])
    assert exact.mark_duplicates(docs).filter("kept").count() == 300
    plan = exact.drop_duplicates(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def mix_by_hand(rows, block=128):
    """Targets by giving away what is above, again and again; taken words by counting."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    totals = collections.Counter()
    for _, t, _, s in rows:
        totals[s] += size(t)
    order = sorted((s for s in totals if s is not None)) + [None] * (None in totals)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(totals.values()), list(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * level > 2 * totals[s]]
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in full:
            target[s] = 2.0 * totals[s]
            left -= target[s]
        open_ = [s for s in open_ if s not in full]
    return totals, target


def test_mix_meets_targets_and_repeats_itself(spark, odd, empty):
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(rng.integers(0, 400)), "en", f"s{rng.integers(0, 7) ** 2 // 8}") for i in range(400)]
    for docs, plain in ((frame(spark, rows).repartition(5), rows), (odd, ODD)):
        totals, target = mix_by_hand(plain)
        got = mixing.mixed_sizes(docs).collect()
        assert len(got) == len(plain)
        taken = collections.Counter()
        by_id = {i: s for i, _, _, s in plain}
        for r in got:
            assert r.taken <= 2 * r.size and r.source_size == totals[by_id[r.doc_id]]
            assert r.target == pytest.approx(target[by_id[r.doc_id]])
            taken[by_id[r.doc_id]] += r.taken
        assert all(abs(taken[s] - target[s]) <= 0.5 for s in target)
        again = mixing.mixed_sizes(docs.repartition(2)).collect()
        assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, again))
    assert mixing.mixed_sizes(empty).count() == 0


def test_mix_schedule_follows_the_weights(spark):
    rows = [(i, "w " * 1000, "en", "abcd"[i % 4]) for i in range(80)]
    docs = frame(spark, rows)
    numbered, pieces = mixing.mix(docs, block=50)
    slots = pieces.groupBy("slot").agg(F.sum("words").alias("words"), F.first("row").alias("row")).join(numbered, "row")
    slots = slots.join(docs.select("doc_id", "source"), "doc_id").orderBy("slot").collect()
    assert {s.words for s in slots} <= {50} | {s.words for s in slots if s.words < 50}
    goals = {s.source: s.target for s in slots}
    whole = sum(goals.values())
    half = slots[: len(slots) // 2]
    seen = collections.Counter(s.source for s in half)
    for source, goal in goals.items():
        assert abs(seen[source] - len(half) * goal / whole) <= 5


def test_any_stretch_of_the_mix_has_the_weights(spark):
    """Whoever reads documents by first_slot, or mixed documents in order, meets the sources by their targets all along."""
    docs = frame(spark, [(i, "w " * 128, "en", "abcd"[i % 4]) for i in range(800)])
    met = docs.join(mixing.mixed_sizes(docs), "doc_id").filter("taken > 0").orderBy("first_slot").select("source", "target", "first_slot").collect()
    assert len({r.first_slot for r in met}) == len(met)
    texts = [r.source for r in mixing.mixed_documents(docs, in_order=True).select("source").collect()]
    goals = {r.source: r.target / 128 for r in met}
    assert 0 <= len(texts) - sum(goals.values()) <= len(goals)  # the last reading of a source may be part of a document
    for at in range(50, len(texts), 50):
        seen = collections.Counter(texts[:at])
        assert all(abs(seen[s] - at * goal / len(texts)) <= 6 for s, goal in goals.items())
    nothing = mixing.mixed_sizes(docs).filter("(taken > 0) <> (first_slot >= 0)")
    assert nothing.count() == 0


def test_mixed_documents_carry_the_taken_words(odd, empty):
    got = mixing.mixed_documents(odd)
    assert got.columns == odd.columns
    count = lambda df: df.select(F.sum(mixing.size_of(F.col("text")))).first()[0]
    assert count(got) == mixing.mixed_sizes(odd).select(F.sum("taken")).first()[0]
    assert all(r.n_chars == len(r.text) for r in got.collect())
    assert mixing.mixed_documents(empty).count() == 0


def test_packing_round_trip(odd, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    rows = packing.pack(odd, VOCABULARY).collect()
    want = collections.Counter()
    for i, t, *_ in ODD:
        ids = np.asarray([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for start in range(0, len(ids), 2048):
            piece = ids[start : start + 2048]
            want[i, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)] += 1
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    places = collections.defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for pieces in places.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(empty, VOCABULARY).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'.,!sTÉñßİſ0<|>\x1c\x85́Σ")), max_size=40), max_size=4))
def test_encoder_equals_the_tokenizer(texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(VOCABULARY)
    got = [np.frombuffer(b, dtype="<u4").tolist() for b in packing.Encoder(VOCABULARY).encode(texts)]
    assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts]


@given(st.lists(st.integers(1, 50), max_size=60))
def test_first_fit_decreasing_is_first_fit(lengths):
    bins, offsets = packing.first_fit_decreasing(lengths, 50)
    filled: list[int] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = next((b for b, f in enumerate(filled) if f + lengths[i] <= 50), len(filled))
        filled += [0] * (at == len(filled))
        assert (bins[i], offsets[i]) == (at, filled[at])
        filled[at] += lengths[i]


def jaccard_by_hand(rows, words, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (doc, *_) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return collections.Counter((doc, len(sets[i]), least.get(root(i))) for i, (doc, *_) in enumerate(rows))


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        at = int(rng.integers(0, len(out) + 1))
        kind = rng.integers(0, 3)
        if kind == 0:
            out.insert(at, f"n{rng.integers(0, 99)}")
        elif out and kind == 1:
            del out[min(at, len(out) - 1)]
        elif out:
            out[min(at, len(out) - 1)] = f"n{rng.integers(0, 99)}"
    return out


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80)])
def test_jaccard_join_loses_no_link(spark, odd, empty, monkeypatch, words, percent):
    monkeypatch.setattr(jaccard, "GROUP", 8)
    monkeypatch.setattr(jaccard, "QUERIES", 4)
    monkeypatch.setattr(jaccard, "BLOCK", 6)
    monkeypatch.setattr(jaccard, "ROWS", 16)
    monkeypatch.setattr(jaccard, "SKETCH_WORDS", 64)
    monkeypatch.setattr(jaccard, "FREQUENT", 12)
    rng = np.random.default_rng(words)
    shared = [f"p{i}" for i in range(60)]
    rows = []
    for base in range(14):
        text = [f"w{rng.integers(0, 5000)}" for _ in range(int(rng.integers(3, 300)))]
        if base % 3 == 0:
            text[1:1] = shared
        for _ in range(30 if base == 5 else 6):
            rows.append((len(rows), " ".join(edited(rng, text, int(rng.integers(0, 2 + len(text) // 30)))), "en", "a"))
    # A chain: each is like the next, the ends are not alike.
    chain = [f"c{i}" for i in range(100)]
    for i in range(20):
        rows.append((len(rows), " ".join(chain[i * 2 :] + [f"d{k}" for k in range(i * 2)]), "en", "a"))
    for docs, plain in ((frame(spark, rows).repartition(4), rows), (odd, ODD)):
        got = collections.Counter(map(tuple, jaccard.similar_documents(docs, words, percent).collect()))
        assert got == jaccard_by_hand(plain, words, percent)
    assert jaccard.similar_documents(empty).count() == 0
    kept = jaccard.one_of_each(odd, words, percent)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {1, 2, 3, 4, 5, 7, 9}


@pytest.mark.parametrize("step", [16, 1 << 19])
@pytest.mark.parametrize("percent", [80, 85])
def test_sift_keeps_what_any_pair_of_a_segment_keeps(monkeypatch, percent, step):
    monkeypatch.setattr(jaccard, "SKETCH_WORDS", step)
    rng = np.random.default_rng(percent)
    sets, segments = [], []
    for base in range(12):
        tokens = rng.integers(0, 2**63, int(rng.integers(1, 300)), dtype=np.uint64)
        for copy in range(int(rng.integers(1, 9))):
            gone = int(rng.integers(0, 1 + len(tokens) // 3))
            sets.append(np.unique(np.concatenate([tokens[gone:], rng.integers(0, 2**63, copy, dtype=np.uint64)])))
            segments.append(int(rng.integers(-2, 3)) if base % 2 else base)
    sketches = [odd_sketch(t) for t in sets]

    def near(i, j):
        a, b = sorted((sketches[i], sketches[j]), key=len)
        n, m = sorted((len(sets[i]), len(sets[j])))
        if segments[i] != segments[j] or 100 * n < percent * m:
            return False
        bits = int(np.bitwise_count(a ^ (folded(b) if len(b) > len(a) else b)).sum())
        return bits * (100 + percent) <= (n + m) * (100 - percent)

    want = [any(near(i, j) for j in range(len(sets)) if j != i) for i in range(len(sets))]
    got = jaccard.near_rows(np.asarray(segments), np.asarray(list(map(len, sets))), [k.tobytes() for k in sketches], percent)
    assert got.tolist() == want and 0 < sum(want) < len(want)
    assert jaccard.near_rows(np.zeros(0, int), np.zeros(0, int), [], percent).tolist() == []


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 400), st.integers(0, 80), st.integers(0, 80), st.integers(0, 10**9), st.sampled_from([80, 85]), st.floats(0, 1))
def test_similar_sets_share_a_signature(size, drop, add, seed, percent, common):
    rng = np.random.default_rng(seed)
    one = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
    two = np.unique(np.concatenate([one[min(drop, len(one) - 1) :], rng.integers(0, 2**64, add, dtype=np.uint64)]))
    both = len(np.intersect1d(one, two))
    if 100 * both >= percent * (len(one) + len(two) - both):
        frequent = np.union1d(one, two)[rng.random(len(np.union1d(one, two))) < common]
        signatures = Signatures(percent, frequent)
        assert set(signatures.of(one).tolist()) & set(signatures.of(two).tolist())


def test_counts_and_large_differences_leave_a_shared_signature():
    rng = np.random.default_rng(3)
    for size in (1, 2, 5, 17, 60, 333, 1200):
        for _ in range(20):
            one = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
            kept = one[rng.permutation(len(one))[: -(-len(one) * 90 // 100)]]
            two = np.union1d(kept, rng.integers(0, 2**64, len(one) // 9, dtype=np.uint64))
            every = np.union1d(one, two)
            frequent = every[rng.random(len(every)) < rng.random()]
            signatures = Signatures(80, frequent, counts=rng.integers(6, 10_000, len(frequent)))
            both = len(np.intersect1d(one, two))
            if 100 * both >= 80 * (len(one) + len(two) - both):
                assert np.intersect1d(signatures.of(one), signatures.of(two)).size


@pytest.mark.parametrize("share", [0.01, 0.2, 0.4])
def test_sets_that_share_frequent_elements_only_share_no_signature(share):
    rng = np.random.default_rng(0)
    frequent = np.unique(rng.integers(0, 2**64, 2000, dtype=np.uint64))
    signatures, seen = Signatures(80, frequent), collections.Counter()
    for size in rng.integers(140, 900, 300).tolist():
        common = frequent[: int(size * share)]
        own = rng.integers(0, 2**64, size - len(common), dtype=np.uint64)
        seen.update(signatures.of(np.unique(np.concatenate([common, own]))).tolist())
    assert max(seen.values()) <= 3


@given(st.integers(1, 300), st.integers(0, 300), st.integers(0, 300), st.integers(0, 10**9))
def test_sketches_bound_the_difference(both, left, right, seed):
    pool = np.unique(np.random.default_rng(seed).integers(0, 2**64, both + left + right, dtype=np.uint64))
    one, two = pool[: both + left], np.union1d(pool[:both], pool[both + left :])
    a, b = sorted((odd_sketch(one), odd_sketch(two)), key=len)
    while len(b) > len(a):
        b = folded(b)
    assert np.bitwise_count(a ^ b).sum() <= len(np.setxor1d(one, two))


def test_shingles_of_short_and_cased_texts():
    memo = WordHashes()
    same = lambda a, b: shingle_set(a, 4, memo).tolist() == shingle_set(b, 4, memo).tolist()
    assert len(shingle_set(None, 4, memo)) == len(shingle_set(" \n", 4, memo)) == 0
    assert len(shingle_set("a b", 4, memo)) == 1 and not same("a b", "b a") and not same("a b", "ab")
    assert same("A b\tc D e", "a B c d  E") and not same("É b c d", "é b c d")
    assert len(shingle_set("a b c d " * 10, 4, memo)) == 4


def test_secret_rules_and_learned_spans(spark, odd, empty):
    rng = np.random.default_rng(1)
    key = lambda n, chars: "".join(rng.choice(list(chars), n))
    rows = []
    for i in range(600):
        hidden = [f'token = "{key(40, "0123456789abcdef")}"', f"Password: {key(20, 'ABCdef0123')}", f"AKIA{key(16, 'ABCDEF123')}"]
        plain = [f"user{i}@mail{i % 9}.example.com", f"order-{i:06d}-{i:06d}", "words without anything"]
        rows.append((i, f"thing {i} {hidden[i % 3] if i % 2 else plain[i % 3]} and more é text", "en", "a"))
    docs = frame(spark, rows)
    net = secrets.fit(docs)
    assert net is not None and 0 < net.threshold < 1
    got = {r.doc_id: r for r in secrets.scan(docs, net).collect()}
    assert sum(bool(r.spans) == bool(i % 2) for i, r in got.items()) >= 590
    assert [r.n_assign + r.n_access + r.n_hex > 0 for i, r in sorted(got.items())] == [bool(i % 2) for i in range(600)]
    bare = secrets.scan(odd, None).collect()
    assert len(bare) == len(ODD) and all(r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in bare)
    assert secrets.fit(empty) is None and secrets.scan(empty, None).count() == 0


def key_texts(n, has_key, seed=5):
    """Texts that hold a key or, where they hold none, an order number of the same look."""
    rng = np.random.default_rng(seed)
    draw = lambda size, chars: "".join(rng.choice(list(chars), size))
    keys = [lambda: f'secret = "{draw(30, "ABCdefGH0123")}"', lambda: f"AKIA{draw(16, 'ABCDEF123')}", lambda: draw(32, "0123456789abcdef")]
    return [f"thing {i} {keys[i % 3]() if has_key(i) else f'order-{i:06d}-{draw(6, "0123456789")}'} thereafter" for i in range(n)]


def test_network_learns_from_every_document(spark):
    """Before, a hash of the id chose about 4,000 documents; here all others hold the keys."""
    n = 5000
    draw = F.pmod(F.xxhash64(F.lit("fit"), F.col("id").cast("string")), F.lit(1_000_003))
    passed_over = {r.id for r in spark.range(n).filter(draw >= int(4000 / n * 1_000_003) + 1).collect()}
    assert 100 < len(passed_over) < 2000
    docs = frame(spark, [(i, t, "en", "a") for i, t in enumerate(key_texts(n, passed_over.__contains__))])
    found = secrets.findings(docs)
    assert found.filter("hit").agg(F.sum("n")).first()[0] >= len(passed_over)
    assert found.agg(F.sum("n")).first()[0] >= n
    net = secrets.fit(docs)
    assert net is not None
    assert secrets.scan(docs, net).filter("n_learned > 0").count() <= n / 100


def test_network_of_many_lots_is_that_of_all_findings(spark):
    """Counts and threshold against plain Python over all findings; order and partitions change nothing."""
    texts = key_texts(1200, lambda i: i % 12 == 0) + ["", None, "a" * 4 + "1" + "b" * 6000] + key_texts(300, lambda i: i % 2 == 0)[:200] * 2
    docs = frame(spark, [(None if i % 7 == 0 else i % 900, t, "en", "a") for i, t in enumerate(texts)])
    by_hand = collections.Counter()
    for t in texts:
        base = secrets.base_spans(t or "")
        for start, end, hit in secrets.labelled(t or ""):
            assert hit == any(s <= start and end <= e for _, s, e in base)
            by_hand.update((row.astype("<u2").tobytes(), hit) for part in secrets.parts(t, start, end) for row in part)
    one, two = (secrets.findings(docs.repartition(k)).cache() for k in (2, 5))
    assert {(bytes(r.window), r.hit): r.n for r in one.collect()} == by_hand
    net, again = secrets.train(one, epochs=3, per_lot=200), secrets.train(two.repartition(7), epochs=3, per_lot=200)
    assert net.flat().tolist() == again.flat().tolist() and net.threshold == again.threshold
    held = one.filter(F.pmod(F.xxhash64(F.lit("later"), "window"), F.lit(5)) == 4).filter("hit").collect()
    rows = np.stack([np.frombuffer(r.window, "<u2") for r in held for _ in range(r.n)])
    chance = net.probability(net.score(rows))
    assert (chance >= net.threshold).mean() >= secrets.LEAST_RECALL > (chance > net.threshold).mean()
    other = one.filter(F.pmod(F.xxhash64(F.lit("later"), "window"), F.lit(5)) == 4).filter("not hit").collect()
    false = net.probability(net.score(np.stack([np.frombuffer(r.window, "<u2") for r in other]))) >= net.threshold
    assert false.mean() <= 0.02
    assert secrets.train(one.filter("hit")) is None and secrets.train(one.filter("not hit")) is None


@pytest.mark.parametrize(
    ("text", "spans"),
    [
        ("ſecret=abcdefghijklmnop", ""),
        ("API_KEY:'abcdefghijkl'", "assign:0:21"),
        ("secret: token: abcdefghijklmnop", ""),
        ("é token=0123456789abcdef", "assign:2:24,hex:8:24"),
        ("AKIAAAAAAAAAAAAAAA x AKIAAAAAAAAAAAAAA", "access:0:18"),
        ("0123456789ABCDEF 0123456789abcde", ""),
    ],
)
def test_secret_rules(text, spans):
    assert secrets.joined(secrets.base_spans(text)) == spans


def test_network_reads_the_whole_of_a_long_candidate():
    net = secrets.Network.new(1)
    text = "x" * 20_000 + "Q9" * 40
    short, long = net.logits([(text, 0, 20_000), (text, 0, len(text))])
    parts = [net.forward(secrets.windows(text, at, min(len(text), at + secrets.WIDTH)))[0].max() for at in range(0, len(text), 64 * secrets.WIDTH)]
    assert long >= short and len(parts) > 1


def brute_statistics(texts, words):
    runs = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    return [max((n for n in range(1, i + 1) if tuple(words[i - n : i]) in runs), default=0) for i in range(1, len(words) + 1)]


@settings(max_examples=120, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=12), min_size=1, max_size=4), st.lists(st.integers(1, 5), max_size=30))
def test_matching_statistics(texts, words):
    automaton = licenses.SuffixAutomaton(texts, 0)
    got = list(automaton.statistics(words))
    assert [n for n, _ in got] == brute_statistics(texts, words)
    for i, (n, state) in enumerate(got, start=1):
        if n == 0:
            continue
        run = words[i - n : i]
        places = {t: tuple(e for e in range(n - 1, len(text)) if text[e + 1 - n : e + 1] == run) for t, text in enumerate(texts)}
        assert automaton.states[state].places == {t: ends for t, ends in places.items() if ends}


def brute_chain(links):
    """The heaviest chain by trying every one."""
    best = 0
    stack = [(end - begin, (begin, end, last)) for begin, end, last in links]
    while stack:
        covered, (b, e, at) = stack.pop()
        best = max(best, covered)
        for begin, end, last in links:
            fresh = end - begin - max(0, e - begin, at - (last - (end - begin)))
            if (begin, end) > (b, e) and begin - e <= licenses.MOST_GAP and end > e and last > at and fresh > 0:
                stack.append((covered + fresh, (begin, end, last)))
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(4, 7), st.lists(st.integers(7, 30), min_size=1, max_size=2)), max_size=6))
def test_heaviest_chain(drawn):
    links, begin, end = [], 0, 0
    for step, size, places in drawn:
        # Like matching statistics: neither of two matches lies in the other.
        begin = begin + 1 + step
        end = max(end + 1, begin + size)
        links += [(begin, end, last + end - begin) for last in places]
    links = sorted(set(links))
    covers, before = licenses._chains(links)
    assert max(covers, default=0) == brute_chain(links)
    for i, j in enumerate(before):
        if j >= 0:
            a, b = links[j], links[i]
            assert a[1] < b[1] and a[2] < b[2] and b[0] - a[1] <= licenses.MOST_GAP


def test_a_notice_keeps_its_label_with_any_words_changed():
    from parchmill.llm.license_texts import NOTICES

    scanner = licenses.Scanner()
    for name, notice in NOTICES.items():
        words = notice.split()
        if len(words) < 20:
            continue
        rng = np.random.default_rng(len(words))
        for at in range(len(words)):
            one = [*words[:at], "xylophone", *words[at + 1 :]]
            assert name in {s[2] for s in scanner.scan(" ".join(one)).spans}, (name, at)
        for _ in range(100):
            a, b = rng.integers(0, len(words), 2)
            two = [w if i not in (a, b) else "xylophone" for i, w in enumerate(words)]
            assert name in {s[2] for s in scanner.scan(" ".join(two)).spans}, (name, a, b)
    bsd = NOTICES["bsd-text"].split()
    again = " ".join(bsd).replace("made", "").rsplit("this list of", 1)
    edited = again[0].rsplit(" ", 2)[0] + " zebra this list of" + again[1].replace("and/or", "zebra")
    assert "bsd-text" in {s[2] for s in scanner.scan(edited).spans}
    many = [s for s in scanner.scan(" ".join([edited] * 300)).spans if s[2] == "bsd-text"]
    assert len(many) == 300 and all(a[1] <= b[0] for a, b in zip(many, many[1:], strict=False))


def test_license_spans_and_odd_rows(spark, odd, empty):
    from parchmill.llm.license_texts import NOTICES

    texts = [
        f"foo bar {NOTICES['mit-text']} baz",
        NOTICES["bsd-text"].replace("source and binary", "any").replace("endorse", "praise"),
        "The MIT-License, the mit\nLICENSE; GNU General Public License",
        "of the license under and the software is in the",
    ]
    got = licenses.scan(frame(spark, [(i, t, None, None) for i, t in enumerate(texts)])).orderBy("doc_id").collect()
    assert got[0].labels == "mit-text" and got[0].score > 0.95 and got[0].spans[0].first_word == 2
    assert got[1].labels == "bsd-text" and 0.6 <= got[1].score < 1
    assert (got[2].n_base, got[2].base_labels, got[2].first_word, got[2].last_word, got[2].score) == (3, "gpl,mit", 1, 7, 1.0)
    assert got[3].labels == "" and got[3].score == 0
    assert [(r.n_base, r.labels) for r in licenses.scan(odd).collect()] == [(0, "")] * len(ODD)
    assert licenses.scan(empty).count() == 0


def test_language_of_held_out_rows(spark, odd, empty):
    rng = np.random.default_rng(5)
    stock = {"aa": "the and ing tion with was here".split(), "bb": "ñoa dulo gracë meno vistu".split(), "cc": "zwk prsh tlk krv grd".split()}
    rows = []
    for i in range(400):
        lang = list(stock)[i % 3]
        rows.append((i, " ".join(rng.choice(stock[lang], int(rng.integers(3, 60)))), lang, None))
    rows += [(1000, "Русский текст совсем другой", None, None), (1001, "12 34 !?", "aa", None), (1002, None, "aa", None)]
    docs = frame(spark, rows)
    model = language.fit(docs)
    found = language.identify(docs, model).select("doc.doc_id", "doc.lang", "lang_pred", "score", "rejected").collect()
    assert all(r.lang_pred == r.lang for r in found if r.doc_id < 400) and not any(r.rejected for r in found if r.doc_id < 400)
    other = {r.doc_id: (r.lang_pred, r.score, r.rejected) for r in found if r.doc_id > 1000}
    assert other == {1001: ("und", 0.0, True), 1002: ("und", 0.0, True)}
    assert next(r.rejected for r in found if r.doc_id == 1000)
    plain = language.identify(odd, None)
    assert plain.select("doc.*").columns == odd.columns
    assert {r.lang_pred for r in plain.collect()} == {"und"}
    assert language.fit(empty) is None and language.identify(empty, model).count() == 0


@pytest.mark.parametrize("left_out", ["de", "es"])
def test_left_out_language_is_rejected(spark, left_out):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang is not null").select("doc_id", "text", "lang")
    model = language.fit(docs.filter(F.col("lang") != left_out))
    found = language.identify(docs, model).select("doc.*", "rejected", language.held_out(F.col("doc.doc_id")).alias("unseen"))
    rows = [r for r in found.collect() if r.text and language.has_letter(r.text)]
    # Of the language left out nothing was learned in any fold.
    other = [r.rejected for r in rows if r.lang == left_out]
    known = [r.rejected for r in rows if r.lang != left_out and r.unseen]
    assert len(other) > 100 and sum(other) >= 0.9 * len(other)
    assert len(known) > 150 and sum(known) <= 0.01 * len(known)


def brute_prediction(model, text):
    """Cosine to each centroid with dictionaries, n-gram by n-gram."""
    counts = language.ngram_counts(text)
    weights = {int(f): np.log1p(float(counts[f])) * float(model.idf[f]) for f in np.flatnonzero(counts)}
    norm = sum(w * w for w in weights.values()) ** 0.5
    cosines = [sum(w * float(v[f]) for f, w in weights.items()) / max(norm, 1e-12) for v in model.vectors]
    best = max(range(len(cosines)), key=lambda i: (cosines[i], -i))
    return model.languages[model.owner[best]], cosines[best]


def test_prediction_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit(docs)
    for row in language.identify(docs, model).select("doc.text", "lang_pred", "score").collect():
        if row.text and language.has_letter(row.text):
            lang, score = brute_prediction(model, row.text)
            assert abs(score - row.score) < 1e-4 and row.lang_pred == lang
        else:
            assert (row.lang_pred, row.score) == ("und", 0.0)


def test_ngram_counts_of_slices(monkeypatch):
    text = "Abc déf 12 ghi " * 50
    whole = language.ngram_counts(text)
    monkeypatch.setattr(language, "SLICE", 7)
    assert (language.ngram_counts(text) == whole).all()


def similar_texts(n_words=100, prefix="k"):
    """Three texts, the first like the second and the second like the third only."""
    text = [f"{prefix}{i}" for i in range(n_words)]
    return [" ".join(text[i * 8 :] + [f"{prefix}x{k}" for k in range(i * 8)]) for i in range(3)]


def test_near_copies_go_by_row(spark):
    one, two, _ = similar_texts()
    alone = [" ".join(f"{name}{i}" for i in range(40)) for name in "uvw"]
    rows = [
        (1, one, "en", "a"),
        (None, one.upper(), "en", "a"),
        (None, alone[0], "en", "b"),
        (None, alone[1], "en", "b"),
        (5, alone[2], "en", "a"),
        (5, two, "en", "a"),
        (6, "six " + alone[2].upper(), "en", "c"),
        (6, alone[2] + " six", "en", "c"),
        (8, "q r s t u v w", "en", "c"),
        (8, "q r s t u v w", "en", "c"),
    ]
    kept = jaccard.one_of_each(frame(spark, rows).repartition(3), 5, 80).collect()
    left = collections.Counter((r.doc_id, r.text) for r in kept)
    assert left == collections.Counter([(1, one), (None, alone[0]), (None, alone[1]), (5, alone[2]), (8, "q r s t u v w")])


def test_near_copies_without_id_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP", 1)
    rows = []
    for c in range(12):
        first, middle, last = similar_texts(prefix=f"m{c}k")
        rows += [(10 * c, first, "en", "a"), (None, middle, "en", "a"), (10 * c + 1, last, "en", "a")]
    first, middle, last = similar_texts(prefix="none")
    rows += [(None, first, "en", "a"), (None, middle, "en", "a"), (None, last, "en", "a")]
    docs = frame(spark, rows).repartition(3)
    got = collections.Counter(map(tuple, jaccard.similar_documents(docs, 5, 80).collect()))
    assert got == jaccard_by_hand(rows, 5, 80)
    kept = sorted((r.doc_id is None, r.doc_id) for r in jaccard.one_of_each(docs, 5, 80).collect())
    assert kept == [*((False, 10 * c) for c in range(12)), (True, None)]
