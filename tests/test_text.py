import random

from parchmill.functions import text as TX


def boundary(data: bytes, limit: int) -> int:
    """Brute force over every byte position."""
    if len(data) <= limit:
        return len(data)
    ends = [
        i + 2
        for i in range(max(limit - 100, 0), limit)
        if data[i : i + 1] in (b".", b"!", b"?") and data[i + 1 : i + 2] in (b" ", b"\n")
    ]
    cut = ends[-1] if ends else limit
    if cut == limit:
        breaks = [i + 1 for i in range(max(limit - 50, 1), limit) if data[i - 1 : i + 1] == b"\n\n"]
        cut = breaks[-1] if breaks else limit
    return cut


def test_truncation_against_brute_force(evaluate):
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab é日.!? \n\n") for _ in range(rng.randint(0, 400))) for _ in range(300)]
    for limit in (1, 2, 30, 99, 101, 250):
        got = evaluate(texts, lambda c, m=limit: TX.truncate(c, m, exact_bytes=True), "string")
        expected = [t.encode()[: boundary(t.encode(), limit)] for t in texts]
        assert [bytes(g) for g in got] == expected
        shown = evaluate(texts, lambda c, m=limit: TX.truncate(c, m))
        assert shown == [e.decode(errors="ignore") for e in expected]


def test_truncation_vectors(evaluate):
    three = "First sentence. Second sentence. Third sentence."
    assert evaluate([three], lambda c: TX.truncated_length(c, 30)) == [16]
    assert evaluate(["Short text"], lambda c: TX.truncated_length(c, 100)) == [10]
    assert evaluate(["x" * 40], lambda c: TX.truncated_length(c, 15)) == [15]
    # A sentence that ends on the last byte brings its space along.
    assert evaluate(["x" * 29 + ". y"], lambda c: TX.truncated_length(c, 30)) == [31]
    assert evaluate(["\x00" * 10000], lambda c: TX.truncated_length(c, 5000)) == [5000]
    assert evaluate(["\x00" * 10000], lambda c: TX.truncated_length(c, 5000, full=True)) == [10000]
    assert evaluate(["abc"], lambda c: TX.truncate(c, 0)) == ["abc"]


def test_excerpt(evaluate):
    got = evaluate(["a" * 300, "a" * 200, "short", "é" * 150, "a" + "é" * 150], TX.excerpt)
    assert [len(g.encode()) for g in got] == [200, 200, 5, 200, 199]


def test_sizes(evaluate):
    cases = {0: "0 B", 1023: "1023 B", 1024: "1.0 KB", 1536: "1.5 KB", 1280: "1.2 KB", 1048576: "1.0 MB", 2**40: "1.0 TB", 2**62: "4.0 EB"}
    assert evaluate(list(cases), TX.format_bytes, "bigint") == list(cases.values())
