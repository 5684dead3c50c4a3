from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parchmill.functions import urls as U


def test_normal_form(evaluate):
    cases = {
        "HTTPS://QUAY.EXAMPLE/Dock": "https://quay.example/Dock",
        "http://quay.example/dock#pier-9": "http://quay.example/dock",
        "http://quay.example/d?tide=low&boat=7&mast": "http://quay.example/d?boat=7&mast=&tide=low",
        "HTTP://Quay.Example/D?y=2&x=1#top": "http://quay.example/D?x=1&y=2",
        "http://a/b?": "http://a/b?",
        "http://a/b?;x=1": "http://a/b",
        "http://a/b?k&k=2&a=%20x+y*~&b=%zz&;c=1": "http://a/b?a=+x+y%2A~&k=&k=2",
        "http://u:P@H.com:80/a/?utm_source=x": "http://u:P@h.com:80/a/?utm_source=x",
        "http://h/é x": "http://h/%C3%A9%20x",
        "not-a-url": "not-a-url",
        "http://a b/": None,
        "http://a/%zz": None,
    }
    assert evaluate(list(cases), U.normalize_url) == list(cases.values())


def test_key_is_stable_and_distinct(evaluate):
    keys = evaluate(
        ["HTTPS://QUAY.example/p?b=1&a=2#x", "https://quay.example/p?a=2&b=1", "https://quay.example/q"], U.url_key
    )
    assert keys[0] == keys[1] != keys[2]
    assert all(len(k) == 64 for k in keys)


_part = st.text(alphabet="abzAZ09-_.~%+*&=;é /", max_size=8)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(_part, _part, _part), min_size=30, max_size=60))
def test_normal_form_is_idempotent(evaluate, parts):
    urls = [f"https://Ex.com/{p}?{q}#{f}" for p, q, f in parts]
    once = evaluate(urls, U.normalize_url)
    twice = evaluate(once, U.normalize_url)
    assert once == twice


def test_slug(spark):
    cases = [
        ("https://quay.example/fog", "Fog; again? (Part 2)", "quay-example-fog-again-part-2.md"),
        ("http://log.quay.example/x/y", "Low TIDE", "log-quay-example-low-tide.md"),
        ("https://quay.example/", "", "quay-example-article.md"),
        ("no url here", "", "article.md"),
        ("https://quay.example/a", "?!", "quay-example-.md"),
    ]
    df = spark.createDataFrame(cases, "url string, title string, expected string")
    for row in df.withColumn("got", U.filename_slug(F.col("url"), F.col("title"))).collect():
        assert row.got == row.expected
    long = spark.createDataFrame([("https://example.com/a", "word-" * 200)], "url string, title string")
    name = long.select(U.filename_slug(F.col("url"), F.col("title"))).first()[0]
    assert len(name) <= 150 and name.endswith(".md")


def test_resolving(evaluate):
    cases = {
        "https://other.org/x": "https://other.org/x",
        "mailto:me@x.org": "mailto:me@x.org",
        "/root": "https://example.com/root",
        "leaf": "https://example.com/a/b/leaf",
        "../up": "https://example.com/a/up",
        "../../../over": "https://example.com/over",
        "./here/": "https://example.com/a/b/here/",
        "//cdn.org/i.png": "https://cdn.org/i.png",
        "#part": "https://example.com/a/b/c?d=1#part",
        "?e=2": "https://example.com/a/b/c?e=2",
        "": "https://example.com/a/b/c?d=1",
    }
    assert evaluate(list(cases), lambda c: U.resolve_url(c, F.lit("https://example.com/a/b/c?d=1"))) == list(cases.values())


def test_validity_is_case_sensitive(evaluate):
    assert evaluate(["http://a", "https://a", "HTTP://a", "ftp://a", ""], U.is_valid_url) == [True, True, False, False, False]
