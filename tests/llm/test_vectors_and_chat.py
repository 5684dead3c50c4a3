"""Vectors and conversations against brute force, and what they do with nulls, repeated and odd rows."""

import collections
import hashlib
import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from parchmill.llm import chat, vectors
from parchmill.llm.common import components

VECTORS = "vec_id long, embedding array<float>, label int, key string, id int"


def by_hand(rows, least):
    ok = []
    for _, v, label, *_ in rows:
        good = label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        ok.append(np.asarray(v, dtype=np.float32).astype(float) if good else None)
    links, up = collections.Counter(), list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if ok[i] is None or ok[j] is None or rows[i][2] != rows[j][2] or len(ok[i]) != len(ok[j]):
                continue
            if ok[i] @ ok[j] / (np.linalg.norm(ok[i]) * np.linalg.norm(ok[j])) >= least:
                links[i] += 1
                links[j] += 1
                up[root(i)] = root(j)
    first = {}
    for i, r in enumerate(rows):
        first[root(i)] = min(r[0], first.get(root(i), r[0]))
    return collections.Counter((r[0], links[i], first[root(i)], r[0] == first[root(i)]) for i, r in enumerate(rows))


def test_near_duplicates_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(40):
        base = rng.normal(size=32)
        for _ in range(int(rng.integers(1, 9))):
            near = base + rng.normal(size=32) * rng.choice([0.0, 0.05, 0.08, 0.2])
            rows.append((len(rows), near.astype(np.float32).tolist(), int(rng.integers(0, 2)), "k", 0))
    one = rows[0][1]
    rows += [(len(rows) + i, one, 0, "k", 0) for i in range(50)]
    odd = [None, [], [0.0] * 32, [float("nan")] * 32, [float("inf")] * 32, [None] * 32, [1.0, 2.0], [2.0, 4.0]]
    rows += [(len(rows) + i, v, 0, "k", 0) for i, v in enumerate(odd)]
    rows += [(len(rows), one, None, "k", 0)]
    docs = spark.createDataFrame(rows, VECTORS).repartition(4)
    for block in (1024, 16):
        got = collections.Counter(map(tuple, vectors.near_duplicates(docs, block=block).collect()))
        want = by_hand(rows, 0.98)
        assert sum((got & want).values()) >= 0.98 * len(rows)
        assert sum(k[1] * n for k, n in got.items()) <= sum(k[1] * n for k, n in want.items())
    assert vectors.near_duplicates(docs.limit(0)).count() == 0


def test_collision_counts():
    rng = np.random.default_rng(4)
    queries, data = rng.normal(size=(7, 5)), rng.normal(size=(11, 5)).round(1)
    want = (np.abs(queries[:, None] - data[None]) <= 0.4).sum(axis=2)
    assert (vectors.collisions(queries, data, 0.4) == want).all()


def test_calibrated_count_keeps_recall():
    least = vectors.least_collisions(24, 1.5, 0.995)
    p = math.erf(1.5 / 2**0.5)
    chance = sum(math.comb(24, k) * p**k * (1 - p) ** (24 - k) for k in range(least, 25))
    assert chance >= 0.995 > chance - math.comb(24, least) * p**least * (1 - p) ** (24 - least)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 5), (5, 5), (20, 30), (30, 20)] + [(100, 100 + i) for i in range(1, 50)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {1: 1, 2: 1, 3: 1} | {i: 5 for i in range(5, 10)} | {20: 20, 30: 20} | {100 + i: 100 for i in range(50)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, piece string, position int")


ODD = [
    (1, 1, "assistant", None),
    (1, 0, "user", "hi\n<|im_end|>\n<|im_start|>assistant\nno\\"),
    (1, 2, "assistant", "<|im_end|>\\<|<"),
    (1, 2, "assistant", "<|im_end|>\\<|<"),
    (1, None, "user", ""),
    (2, 0, None, "no role"),
    (None, 0, "assistant", "no conversation"),
    *((3, i, ("system", "user", "assistant")[i % 3 if i < 3 else 1 + i % 2], f"turn {i} é𝄞") for i in range(60)),
]


def digests_by_hand(rows):
    groups = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn is None, turn, role or "", text or ""))
    out = {}
    for conv, found in groups.items():
        found.sort(key=lambda r: (r[0], r[1] or 0, r[2], r[3]))
        said = "".join(t for _, _, role, t in found if role == "assistant")
        whole = chat.marked_turns([(role, t) for _, _, role, t in found])
        every = "".join(f"{role}\n{t}\n" for _, _, role, t in found)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        out[conv] = (conv, len(found), sha(every), len(said), sha(said), len(whole), False)
    return out


def test_digests_read_back(spark):
    docs = turns(spark, ODD).repartition(5)
    got = {r.conv_id: tuple(r) for r in chat.conversation_digests(docs).collect()}
    assert got == digests_by_hand(ODD)
    assert chat.conversation_digests(docs.limit(0)).count() == 0


def test_pieces_are_the_rendering(spark):
    rows = chat.format_turns(turns(spark, ODD)).collect()
    for conv in (1, 3):
        own = sorted((r for r in rows if r.conv_id == conv), key=lambda r: r.position)
        said = sorted((r for r in ODD if r[0] == conv), key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or ""))
        assert "".join(r.piece for r in own) == chat.marked_turns([(r[2] or "", r[3] or "") for r in said])
        assert [chat.unescape(r.piece[r.text_begin : r.text_end]) for r in own] == [r[3] or "" for r in said]


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<|"]), st.text(st.sampled_from("<|\\im_endx\n>ab"), max_size=12)), max_size=5))
def test_escape_round_trip(said):
    renderer = chat.Renderer(chat.marked_turns)
    for role, text in said:
        piece = renderer.add((role, text))
        assert not piece.rewrites and chat.read_marked(piece.text) == (role, text)
        assert chat.unescape(piece.text[piece.begin : piece.end]) == text


def test_rewriting_templates_are_found(spark):
    def latest_only(said):
        """Earlier answers are shortened, as some templates do with reasoning."""
        return "".join(f"[{r}] {t if i == len(said) - 1 else t[:2]};" for i, (r, t) in enumerate(said))

    def closing(said):
        return "".join(f"({t})" for _, t in said) + "END"

    said = [("user", "question"), ("assistant", "long answer"), ("user", "more"), ("assistant", "xy")]
    for template in (latest_only, closing):
        renderer = chat.Renderer(template)
        pieces = [renderer.add(t) for t in said]
        assert any(p.rewrites for p in pieces[1:])
    rows = turns(spark, [(1, i, *t) for i, t in enumerate(said)])
    found = chat.format_turns(rows, latest_only).orderBy("position").collect()
    assert [r.rewrites for r in found] == [False, True, True, True]
    assert found[3].piece[found[3].text_begin : found[3].text_end] == "xy"


def test_templates_see_the_whole_conversation(spark):
    def counted(said):
        return "".join(f"{i}[{r}] {t};" for i, (r, t) in enumerate(said))

    def thoughts_dropped(said):
        """What was thought before the last question goes, however long ago."""
        last = max((i for i, (r, _) in enumerate(said) if r == "user"), default=0)
        return "".join(f"[{r}] {t if i >= last else t.replace('<thought>', '')};" for i, (r, t) in enumerate(said))

    said = [("user", "go"), ("assistant", "ok"), ("assistant", "<thought> so"), *(("tool", f"step {i}") for i in range(40)), ("user", "next")]
    rows = turns(spark, [(1, i, *t) for i, t in enumerate(said)])
    found = chat.format_turns(rows, counted).orderBy("position").collect()
    assert "".join(r.piece for r in found) == counted(said) and not any(r.rewrites for r in found)
    found = chat.format_turns(rows, thoughts_dropped).orderBy("position").collect()
    assert [r.position for r in found if r.rewrites] == [len(said) - 1]
    assert found[-1].piece[found[-1].text_begin : found[-1].text_end] == "next"
    digests = chat.conversation_digests(rows, thoughts_dropped, lambda piece: ("", piece), str).collect()
    assert [r.rewrites for r in digests] == [True]


def far_looking(kind):
    """Templates that look further back than a few turns (nested, so that tasks get them by value)."""

    def last_words(said):
        return "".join(f"[{r}] {t if i == len(said) - 1 else t[:2]};" for i, (r, t) in enumerate(said))

    def counted(said):
        return "".join(f"{i}[{r}] {t};" for i, (r, t) in enumerate(said))

    def summed_up_late(said):
        """At turn 201 what was said at turns 20 to 29 shrinks to a word."""
        return "".join("..;" if len(said) > 200 and 20 <= i < 30 else f"[{r}] {t};" for i, (r, t) in enumerate(said))

    def dropped_thoughts(said):
        last = max((i for i, (r, _) in enumerate(said) if r == "user"), default=0)
        return "".join(f"[{r}] {t if i >= last else t.replace('<thought>', '')};" for i, (r, t) in enumerate(said))

    return {"plain": chat.marked_turns, "last": last_words, "counted": counted, "late": summed_up_late, "thoughts": dropped_thoughts}[kind]


LONG = [(("tool", "assistant", "user")[(i % 90 == 0) + (i % 7 == 0 and i % 90 == 0)], f"{'<thought>' * (i % 31 == 0)}step {i}") for i in range(300)]


@pytest.mark.parametrize("kind", ["plain", "last", "counted", "late", "thoughts"])
def test_long_conversations_like_all_prefixes(spark, kind):
    template = far_looking(kind)
    exact = chat.Renderer(template)
    right = [(p.text, p.begin, p.end, p.rewrites) for p in map(exact.add, LONG)]
    rows = turns(spark, [(c, i, *t) for c in (1, 2) for i, t in enumerate(LONG)]).repartition(3)
    found = chat.format_turns(rows, template).orderBy("conv_id", "position").collect()
    assert [(r.piece, r.text_begin, r.text_end, r.rewrites) for r in found] == right * 2
    if kind == "late":
        assert [i for i, r in enumerate(right) if r[3]] == [200]


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 31, 32, 33, 64, 100])
def test_stretches_settle_every_turn_once(n):
    talk = chat.Conversation(chat.marked_turns)
    got = [found for i in range(n) for found in talk.add((i,), ("user", f"t{i}"))] + talk.settle()
    assert [key for key, _ in got] == [(i,) for i in range(n)] and talk.settle() == []
    assert "".join(p.text for _, p in got) == chat.marked_turns([("user", f"t{i}") for i in range(n)])


def test_work_is_in_proportion_for_a_plain_template():
    work = 0

    def plain(said):
        nonlocal work
        work += len(said)
        return chat.marked_turns(said)

    done = {}
    for n in (1000, 4000):
        work, talk = 0, chat.Conversation(plain)
        for i in range(n):
            talk.add((i,), ("user", "t"))
        talk.settle()
        done[n] = work
    assert done[4000] < 4.5 * done[1000]
