"""Surrogates: what is found, what it becomes, and what stays."""

import collections
import hashlib
import itertools

import pytest
import regex

from parchmill.llm import queries, surrogates

SCHEMA = "doc_id long, text string, row int, doc string, key string, mentions string, kind string"

# Text, and what must be found in it.
FOUND = [
    ("Mail John.Doe@Mail5.example.com, JOHN.DOE@MAIL5.EXAMPLE.COM.", ["John.Doe@Mail5.example.com", "JOHN.DOE@MAIL5.EXAMPLE.COM"]),
    ("éa.b@mail.example.org иван@почта.рф", ["éa.b@mail.example.org", "иван@почта.рф"]),
    ("+1 (743) 555-3824; (743) 555-3824; 743-555-3824; +49 30 1234 5678", ["+1 (743) 555-3824", "(743) 555-3824", "743-555-3824", "+49 30 1234 5678"]),
    ("ip 8.196.197.208. not 8.196.197.2080, 1.2.3, 300.1.1.1 or 1.2.3.4.5", ["8.196.197.208"]),
    ("card 4111 1111 1111 1111, 4111111111111112 and 123456789012", ["4111 1111 1111 1111", "4111111111111112"]),
    ("ssn 123-45-6789 but not 123-45-67890", ["123-45-6789"]),
    ("Mr. John Smith met Frau Weber; Mr. x, and Dr Smith.", ["Mr. John Smith", "Frau Weber", "Dr Smith"]),
    ("Господин Иван Петров и госпожа Анна Петрова", ["Господин Иван Петров", "госпожа Анна Петрова"]),
    ("sha 1eb9c654e721b4f812088970e66a6345cee33dd6 nothing @ here", []),
]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1, "d", "k", "m", "x") for i, t in texts], SCHEMA).repartition(3)


def outcome(df):
    return [(r.doc.doc_id, r.doc.text, r.surrogate_text, r.kinds) for r in df.collect()]


def luhn(digits):
    values = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(v - 9 * (v > 9) for v in values) % 10 == 0


@pytest.fixture(scope="module")
def replaced(spark):
    texts = [(i, t) for i, (t, _) in enumerate(FOUND)]
    return {i: (text, new, kinds) for i, text, new, kinds in outcome(surrogates.replace(frame(spark, texts), "k"))}


def pairs(text, new):
    """Entities of a text and what stands in their places; checks that the rest is unchanged."""
    old = list(regex.finditer(surrogates.PATTERN, text))
    gaps = regex.split(surrogates.PATTERN, text)
    match = regex.fullmatch("(.*?)".join(regex.escape(g) for g in gaps), new, flags=regex.S)
    assert match, (text, new)
    return list(zip([m[0] for m in old], match.groups(), strict=True))


def test_finds_and_keeps_the_rest(replaced):
    for i, (text, want) in enumerate(FOUND):
        _, new, kinds = replaced[i]
        assert [old for old, _ in pairs(text, new)] == want and len(kinds) == len(want)
        assert all(old != made for old, made in pairs(text, new))


def test_formats_are_kept(replaced):
    shape = lambda s: regex.sub(r"\d", "0", regex.sub(r"\p{Ll}", "a", regex.sub(r"\p{Lu}", "A", s)))
    for i in (0, 1, 2, 4, 5):
        for old, made in pairs(FOUND[i][0], replaced[i][1]):
            assert shape(old) == shape(made)
    for old, made in pairs(FOUND[4][0], replaced[4][1]):
        digits = [regex.sub(r"\D", "", x) for x in (old, made)]
        assert luhn(digits[0]) == luhn(digits[1]) and digits[0][0] == digits[1][0]
    (_, made), = pairs(FOUND[3][0], replaced[3][1])
    assert all(0 <= int(o) <= 255 for o in made.split("."))
    for old, made in pairs(FOUND[7][0], replaced[7][1]):
        assert old.split()[0] == made.split()[0] and regex.fullmatch(r"\p{Cyrillic}+", made.split()[1])
    man, woman = (made for _, made in pairs(FOUND[7][0], replaced[7][1]))
    assert man.endswith("ров") and woman.endswith("рова")


def test_the_same_entity_keeps_one_surrogate(replaced):
    one, two = (made for _, made in pairs(FOUND[0][0], replaced[0][1]))
    assert one.lower() == two.lower()
    phones = [regex.sub(r"\D", "", made)[-10:] for _, made in pairs(FOUND[2][0], replaced[2][1])][:3]
    assert len(set(phones)) == 1
    names = [made for _, made in pairs(FOUND[6][0], replaced[6][1])]
    assert names[0].split()[-1] == names[2].split()[-1] != names[1].split()[-1]


def test_crowded_names_stay_distinct_and_new(spark):
    """All addresses of one and two letters: most surrogates of the first round collide."""
    names = ["".join(p) for n in (1, 2) for p in itertools.product("abcdefghijklmnopqrstuvwxyz", repeat=n)]
    texts = [(i, f"to {n}@b.co.") for i, n in enumerate(names)]
    found = outcome(surrogates.replace(frame(spark, texts), "k"))
    made = [new[3:-1] for *_, new, _ in found]
    assert len(set(made)) == len(names) and not set(made) & {f"{n}@b.co" for n in names}


def test_odd_rows_and_reruns(spark):
    long = "word " * 30_000 + "a.b@c.example " * 300
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "x@y.example"), (4, "x@y.example"), (None, "to x@y.example!"), (7, long), (8, "Mr. $1 \\ \x00 Mr. Jo")]
    got = outcome(surrogates.replace(frame(spark, rows), "k"))
    by = collections.defaultdict(list)
    for i, _, new, _ in got:
        by[i].append(new)
    assert by[1] == [None] and by[2] == [""] and by[3] == [" \t\n"] and len(got) == len(rows)
    assert by[4] == [by[None][0][3:-1]] * 2 and by[7][0].startswith("word " * 30_000) and len(by[7][0]) == len(long)
    key = lambda r: repr(r)
    assert sorted(outcome(surrogates.replace(frame(spark, rows[::-1]), "k")), key=key) == sorted(got, key=key)
    assert sorted(outcome(surrogates.replace(frame(spark, rows), "other")), key=key) != sorted(got, key=key)
    assert surrogates.digests(frame(spark, []), "k").collect() == []


def test_query_counts_what_the_pattern_finds(spark):
    data = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    found = queries.op3_pii_surrogates(spark, data).collect()
    assert sorted(r.doc_id for r in found) == sorted(texts)
    for r in found:
        old = regex.findall(surrogates.PATTERN, texts[r.doc_id])
        assert r.n_entities == len(old) == sum(r[f"n_{k}"] for k in surrogates.KINDS)
        assert (hashlib.sha256(texts[r.doc_id].encode()).hexdigest() == r.text_sha256) == (not old)
