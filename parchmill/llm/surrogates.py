"""Surrogates for personal data: keyed, of the same type and format, distinct and consistent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmill.functions.binding import let
from parchmill.llm.common import join_totals, staged

# Titles that introduce a name, and the gender they state.
MALE = ("Mr", "Mister", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "господин", "Господин", "Κύριος", "κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Srta", "госпожа", "Госпожа", "Κυρία", "κυρία")
NEUTRAL = ("Dr", "Prof", "Mx")

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_NAME = r"\p{Lu}[\p{L}'’-]+"
_START = r"(?<![0-9][.-])"
_END = r"(?![\p{L}\p{N}])"
_DASHED = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
_LOCAL_PHONE = r"[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}"

# Alternatives that begin where no letter or digit stands before; each is linear in its match.
PATTERN = (
    r"(?<![\p{L}\p{N}])(?:"
    + "|".join(
        (
            r"[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}+@(?:[\p{L}\p{N}-]{1,63}\.){1,8}\p{L}{2,24}" + _END,
            rf"{_START}(?:{_OCTET}\.){{3}}{_OCTET}(?![\p{{L}}\p{{N}}]|\.[0-9])",
            rf"(?:[0-9]{{13,19}}|[0-9]{{4}}(?:[\x20-][0-9]{{4}}){{3}}|[0-9]{{4}}[\x20-][0-9]{{6}}[\x20-][0-9]{{5}}){_END}",
            _START + _DASHED + _END,
            rf"\+(?=(?:[\x20().-]{{0,2}}[0-9]){{8}})[0-9]{{1,3}}[\x20.-]?(?:\([0-9]{{1,4}}\)[\x20.-]?)?[0-9]{{2,4}}(?:[\x20.-]?[0-9]{{2,4}}){{1,4}}{_END}",
            rf"\([0-9]{{3}}\)\x20?[0-9]{{3}}[\x20.-][0-9]{{4}}{_END}",
            _START + _LOCAL_PHONE + _END,
            rf"(?:{'|'.join(MALE + FEMALE + NEUTRAL)})\.?\x20{_NAME}(?:\x20{_NAME}){{0,2}}",
        )
    )
    + ")"
)

# What a text is counted by; given and family names are persons.
KINDS = ("email", "ip", "number", "ssn", "phone", "person")

# Syllables and endings of invented names, by script.
SYLLABLES = {
    "latin": [c + v for c in "bdfgklmnprstvz" for v in "aeiou"],
    "cyrillic": [c + v for c in "бвгдзклмнпрст" for v in "аеиоу"],
    "greek": [c + v for c in "βγδζκλμνπρστ" for v in "αειο"],
}
ENDINGS = {
    ("given", "m", "latin"): "n", ("given", "f", "latin"): "na", ("given", "n", "latin"): "ne",
    ("given", "m", "cyrillic"): "н", ("given", "f", "cyrillic"): "на", ("given", "n", "cyrillic"): "не",
    ("given", "m", "greek"): "νος", ("given", "f", "greek"): "να", ("given", "n", "greek"): "νι",
    ("family", "m", "cyrillic"): "ров", ("family", "f", "cyrillic"): "рова", ("family", "n", "cyrillic"): "ренко",
    ("family", "n", "latin"): "rd", ("family", "n", "greek"): "ίδης",
}

# Proposals that an entity may make before the job fails; each round settles nearly all that are left.
ROUNDS = 64


def mentions(text: Column) -> Column:
    """The entities of a text as they stand there, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATTERN), F.lit(0))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _parts(mention: Column) -> Column:
    """What of a mention is replaced: text before it that stays, kind, value as it stands.

    A name is one part a word. Words before the last are given names and carry the
    gender its title states, as does a Cyrillic family name.
    """
    title = F.regexp_extract(mention, r"^(\S+)\x20", 1)
    bare = F.rtrim(title, F.lit("."))
    gender = F.when(bare.isin(*MALE), "m").when(bare.isin(*FEMALE), "f").otherwise("n")
    words = F.split(F.regexp_extract(mention, r"^\S+\x20(.*)$", 1), " ")
    is_given = lambda i: i < F.size(words) - 1
    names = F.transform(
        words,
        lambda w, i: F.struct(
            F.when(i == 0, F.concat(title, F.lit(" "))).otherwise(" ").alias("lead"),
            F.concat_ws(
                ":",
                F.when(is_given(i), "given").otherwise("family"),
                F.when(is_given(i) | (_script(w) == "cyrillic"), gender).otherwise("n"),
                _script(w),
            ).alias("kind"),
            w.alias("value"),
        ),
    )
    kind = (
        F.when(F.contains(mention, F.lit("@")), "email")
        .when(mention.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), "ip")
        .when(mention.rlike(f"^{_DASHED}$"), "ssn")
        .when(mention.rlike(rf"^([+(]|{_LOCAL_PHONE}$)"), "phone")
        .otherwise("number")
    )
    single = F.array(F.struct(F.lit("").alias("lead"), kind.alias("kind"), mention.alias("value")))
    return F.when(mention.rlike(r"^\p{L}[^@]*$"), names).otherwise(single)


def _canonical(kind: Column, value: Column) -> Column:
    """What is the same however it is written: case, separators and a leading +1 don't count."""
    digits = _digits(value)
    american = (kind == "phone") & (F.length(digits) == 11) & digits.startswith("1")
    return (
        F.when(american, F.substring(digits, 2, 10))
        .when(kind.isin("phone", "ssn", "number"), digits)
        .when(kind == "ip", value)
        .otherwise(F.lower(value))
    )


def _noise(secret: str, *of: Column) -> Column:
    """256 hex digits that depend on the secret and the values: 64 numbers of 16 bits."""
    inner = F.sha2(F.concat_ws("\n", F.lit(secret), *of), 256)
    return let(inner, lambda h: F.concat(*[F.sha2(F.concat(F.lit(f"{secret}\n{i}\n"), h), 256) for i in range(4)]))


def _number(noise: Column, i: Column | int, below: int) -> Column:
    at = F.pmod(i if isinstance(i, Column) else F.lit(i), F.lit(64)) * 4 + 1
    return F.conv(noise.substr(at, F.lit(4)), 16, 10).cast("int") % below


def _letter(first: str, number: Column) -> Column:
    """The letter so far after ``first``, which chr() of one byte cannot give beyond Latin."""
    alphabet = "".join(chr(ord(first) + i) for i in range(26 if first == "a" else 24))
    return F.substring(F.lit(alphabet), number % len(alphabet) + 1, F.lit(1))


def _same_shape(value: Column, noise: Column) -> Column:
    """Other letters of the same script for letters, digits for digits; the rest stays."""

    def one(c: Column, i: Column) -> Column:
        n = _number(noise, i, 1 << 16)
        return (
            F.when(c.rlike(r"\p{Nd}"), (n % 10).cast("string"))
            .when(c.rlike(r"\p{IsCyrillic}"), _letter("а", n))
            .when(c.rlike(r"\p{IsGreek}"), _letter("α", n))
            .when(c.rlike(r"\p{L}"), _letter("a", n))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _proposal(secret: str, attempt: int) -> Column:
    """Surrogate of ``canon``, a canonical value of ``kind``."""
    kind, canon, key = F.col("kind"), F.col("canon"), F.col("key")

    def email(h: Column) -> Column:
        # Addresses of one host keep one host; a short name grows if its space is used up.
        host = F.regexp_extract(canon, r"@(.*\.)[^.]*$", 1)
        more = [_number(h, 60 + i % 4, 10).cast("string") for i in range(attempt // 3)]
        other = let(_noise(secret, F.lit("host"), host), lambda n: _same_shape(host, n))
        return F.concat(_same_shape(F.substring_index(canon, "@", 1), h), *more, F.lit("@"), other, F.substring_index(canon, ".", -1))

    def phone(h: Column) -> Column:
        tail = lambda at, n: F.substring(_same_shape(canon, h), at, n)
        lead = lambda at: (_number(h, at, 8) + 2).cast("string")
        american = F.concat(lead(0), tail(2, 2), lead(3), tail(5, 6))
        return F.when(F.length(canon) == 10, american).otherwise(F.concat(F.substring(canon, 1, 2), tail(3, 64)))

    def ssn(h: Column) -> Column:
        numbers = ((665, 3), (99, 2), (9999, 4))
        return F.concat(*[F.lpad((_number(h, i, n) + 1).cast("string"), w, "0") for i, (n, w) in enumerate(numbers)])

    def number(h: Column) -> Column:
        # A valid check digit stays valid, an invalid one invalid.
        head = F.concat(F.substring(canon, 1, 1), _same_shape(canon, h).substr(F.lit(2), F.length(canon) - 2))
        right = lambda t: F.filter(F.sequence(F.lit(0), F.lit(9)), lambda d: _valid(F.concat(t, d.cast("string"))))[0]
        shift = F.when(_valid(canon), 0).otherwise(_number(h, 63, 9) + 1)
        return let(head, lambda t: F.concat(t, ((right(t) + shift) % 10).cast("string")))

    def ip(h: Column) -> Column:
        # First octets 11 to 223 without 127.
        n = _number(h, 0, 212)
        return F.concat_ws(".", F.when(n < 116, n + 11).otherwise(n + 12), *[_number(h, i, 256) for i in (1, 2, 3)])

    def name(h: Column) -> Column:
        made = F.lit(None).cast("string")
        for (role, gender, script), ending in ENDINGS.items():
            sounds = F.array(*map(F.lit, SYLLABLES[script]))
            word = F.concat(*[F.get(sounds, _number(h, i, len(SYLLABLES[script]))) for i in range(3 + attempt // 3)], F.lit(ending))
            made = F.when(kind == f"{role}:{gender}:{script}", word).otherwise(made)
        return made

    def any_kind(h: Column) -> Column:
        return (
            F.when(kind == "email", email(h))
            .when(kind == "phone", phone(h))
            .when(kind == "ssn", ssn(h))
            .when(kind == "number", number(h))
            .when(kind == "ip", ip(h))
            .otherwise(name(h))
        )

    return let(_noise(secret, key, F.lit(str(attempt))), any_kind)


def _in_format(kind: Column, value: Column, made: Column) -> Column:
    """The surrogate ``made``, written the way ``value`` is."""

    def filled(v: Column) -> Column:
        given = _digits(v)
        whole = F.concat(given.substr(F.lit(1), F.length(given) - F.length(made)), made)
        one = lambda c, i: F.when(
            c.rlike("[0-9]"), whole.substr(F.length(_digits(v.substr(F.lit(1), i + 1))), F.lit(1))
        ).otherwise(c)
        return F.array_join(F.transform(F.split(v, ""), one), "")

    upper = lambda c: (c == F.upper(c)) & (c != F.lower(c))
    alike = F.zip_with(F.split(made, ""), F.split(value, ""), lambda m, v: F.when(upper(v), F.upper(m)).otherwise(m))
    capital = F.concat(F.upper(F.substring(made, 1, 1)), F.substring(made, 2, 1 << 20))
    return (
        F.when(kind == "ip", made)
        .when(kind.isin("phone", "ssn", "number"), filled(value))
        .when(upper(value), F.upper(made))
        .when((kind == "email") & (F.length(made) == F.length(value)), F.array_join(alike, ""))
        .when(value.rlike(r"^\p{Lu}"), capital)
        .otherwise(made)
    )


def assign(entities: DataFrame, secret: str) -> DataFrame:
    """``entities`` (key, kind, canon, n; a row each) with their surrogate ``made``.

    Collision check by rounds: each unsettled entity proposes a value drawn from the
    secret, its key and the round. A proposal holds unless it is itself an entity of
    that kind, was settled earlier, or a smaller key proposes it in the same round.
    Rounds work on what is unsettled, a share that falls with each.
    """
    place = F.concat_ws(":", "kind", "made")
    held = entities.select(F.col("key").alias("place"), F.lit(None).cast("string").alias("who"))
    settled, pending = None, entities
    for attempt in range(ROUNDS):
        asked = pending.withColumn("made", _proposal(secret, attempt))
        asking = asked.select(place.alias("place"), F.col("key").alias("who"))
        won = held.unionByName(asking).groupBy("place").agg(F.min("who").alias("who"), F.count_if(F.col("who").isNull()).alias("n_held"))
        won = won.filter("n_held = 0").select(F.col("who").alias("key"), F.lit(True).alias("holds"))
        round_ = staged(asked.join(won, "key", "left"), "surrogates")
        now = round_.filter("holds").drop("holds")
        settled = now if settled is None else settled.unionByName(now)
        pending = round_.filter("holds is null").drop("holds", "made")
        if pending.isEmpty():
            return settled
        held = held.unionByName(now.select(place.alias("place"), F.lit(None).cast("string").alias("who")))
    raise ValueError(f"no free surrogates are left for {pending.count()} entities after {ROUNDS} rounds")


def replace(docs: DataFrame, secret: str) -> DataFrame:
    """Every row of ``docs`` in a struct ``doc``, with ``surrogate_text`` and ``kinds``.

    Finds e-mail and IPv4 addresses, phone numbers, numbers of 13 to 19 digits (cards,
    accounts), social security numbers, and names after a title, in whole texts.
    ``surrogate_text`` is the text with each replaced: the same type, script, gender
    and format; card numbers stay valid or invalid. The same entity has one surrogate in
    the whole table, whatever its case or separators; different ones have different
    surrogates, none of which is an entity of the table. A family name is the same
    entity with or without given names; a name without a title is not found.
    ``kinds`` has an element per entity, in order.

    Null texts stay null and empty ones empty, and texts without entities as they are.
    Repeated rows and ids are rows of their own and get equal texts; an empty table gives no rows.
    The result depends on the secret and the rows, not on their order.

    Texts without entities are passed on where they are read. What shuffles are
    mentions, their distinct values, and the texts to change, by a row number; values
    that many rows hold are broadcast. A group is one row's mentions.
    """
    rows = staged(
        docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc"), mentions(F.col("text")).alias("mentions")),
        "mentions",
    )
    found = rows.filter(F.size("mentions") > 0)
    parts = (
        found.select("row", F.posexplode("mentions").alias("pos", "mention"))
        .select("row", "pos", F.posexplode(_parts(F.col("mention"))).alias("part", "of"))
        .select("row", "pos", "part", "of.*")
        .withColumn("canon", _canonical(F.col("kind"), F.col("value")))
        .withColumn("key", F.concat_ws(":", "kind", "canon"))
    )
    parts = staged(parts, "entities")
    entities = parts.groupBy("key", "kind", "canon").agg(F.count(F.lit(1)).alias("n"))
    made = assign(staged(entities, "entities"), secret).select("key", "made", "n")
    known = join_totals(parts, made, "key", "n", parts.count())
    new = F.concat("lead", _in_format(F.col("kind"), F.col("value"), F.col("made")))
    by_row = known.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "part", new.alias("new"), "kind"))).alias("parts"))

    def rebuilt(both: Column) -> Column:
        gaps, ordered = both["gaps"], both["parts"]
        one = lambda p: F.concat(F.when(p["part"] == 0, F.get(gaps, p["pos"])).otherwise(""), p["new"])
        return F.concat(F.array_join(F.transform(ordered, one), ""), F.element_at(gaps, -1))

    first = F.filter("parts", lambda p: p["part"] == 0)
    counted = F.transform(first, lambda p: F.when(p["kind"].rlike("^(given|family):"), "person").otherwise(p["kind"]))
    gaps = F.split(F.col("doc.text"), PATTERN, -1)
    changed = found.join(by_row, "row").select(
        "doc", let(F.struct(gaps.alias("gaps"), F.col("parts").alias("parts")), rebuilt).alias("surrogate_text"), counted.alias("kinds")
    )
    none = F.array().cast("array<string>")
    same = rows.filter(F.size("mentions") == 0).select("doc", F.col("doc.text").alias("surrogate_text"), none.alias("kinds"))
    return changed.unionByName(same)


def digests(docs: DataFrame, secret: str) -> DataFrame:
    """A row per row of ``docs``: doc_id, entities of each kind, and the digest of the new text (null: of an empty one)."""
    count = lambda kind: F.size(F.filter("kinds", lambda k: k == kind)).cast("long").alias(f"n_{kind}")
    text = F.coalesce("surrogate_text", F.lit(""))
    return replace(docs, secret).select(
        "doc.doc_id",
        *map(count, KINDS),
        F.size("kinds").cast("long").alias("n_entities"),
        F.length(text).cast("long").alias("n_chars"),
        F.sha2(text.cast("binary"), 256).alias("text_sha256"),
    )
