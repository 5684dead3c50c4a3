"""Row-local HTML expressions: cleaning, tag pieces, metadata, inline Markdown.

The patterns are written so that Java's matcher runs them without recursion
or backtracking blow-up: possessive groups, negated classes, lazy dots.
"""

from __future__ import annotations

import json
from functools import reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from parchmill.functions.binding import let
from parchmill.functions.urls import resolve_url

# Control characters that HTML text cannot hold serve as marks while a block
# is rewritten. clean_html removes them from the input first.
CUT, END = "\x01", "\x02"
BOLD, BOLD_END, EM, EM_END = "\x03", "\x04", "\x05", "\x06"
LINK, LINK_TEXT, LINK_END = "\x0e", "\x0f", "\x10"
CODE, CODE_END, BREAK = "\x11", "\x12", "\x13"
TICKS = "\x14"
_MARKS = r"[\x00-\x06\x0e-\x14]"

# What is removed before anything else is read.
_NOISE = (
    r"(?is)<(?:!--.*?(?:-->|\z)"
    r"|script\b[^>]*>.*?(?:</script\s*>|\z)"
    r"|style\b[^>]*>.*?(?:</style\s*>|\z)"
    r"|noscript\b[^>]*>.*?(?:</noscript\s*>|\z)"
    r"|![^>]*>|\?[^>]*>)"
)

# Tags that start or end a block of text.
BLOCK_TAGS = [
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog",
    "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section",
    "select", "summary", "table", "tbody", "td", "textarea", "tfoot", "th", "thead", "title", "tr", "ul",
]

# Attributes of one tag up to its closing bracket. Quotes count only after "=",
# so a stray quote cannot swallow the page.
ATTRS = r"""(?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+"""
_ANY_NAME = r"[a-zA-Z][a-zA-Z0-9]*"

# Character references by name, as HTML 5 lists them: those that end in a semicolon,
# and the older ones that stand without it too.
ENTITIES = {name[:-1]: char for name, char in html5.items() if name.endswith(";")}
BARE_ENTITIES = {name: char for name, char in html5.items() if not name.endswith(";")}


def clean_html(html: Column) -> Column:
    """HTML without comments, scripts, styles, noscript and declarations."""
    return F.regexp_replace(html, f"{_NOISE}|{_MARKS}", "")


def tag_pattern(tags: list[str] | None, closing: bool = True) -> str:
    """Pattern of one tag, closing ones too unless told otherwise; all tags when ``tags`` is None."""
    name = _ANY_NAME if tags is None else "(?:" + "|".join(tags) + ")"
    return rf"(?i)(<{'/?' if closing else ''}{name}(?![a-zA-Z0-9]){ATTRS}>)"


def without_tags(inner: Column) -> Column:
    return F.regexp_replace(inner, tag_pattern(None), " ")


def split_at_tags(clean: Column, tags: list[str] | None = None) -> Column:
    """Cut cleaned HTML before each tag.

    Every piece but the first is ``<tag ...>``, an end mark, and the text up to
    the next tag. Nothing of the page is lost.
    """
    return F.split(F.regexp_replace(clean, tag_pattern(tags), f"{CUT}$1{END}"), CUT, -1)


def piece_text(piece: Column) -> Column:
    """The text part of a piece (all of it when no tag opens the piece)."""
    return F.element_at(F.split(piece, END, 2), -1)


def piece_tag(piece: Column) -> Column:
    head = F.when(F.contains(piece, F.lit(END)), F.substring_index(piece, END, 1)).otherwise(F.lit(""))
    return F.lower(F.regexp_extract(head, r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1))


def piece_closes(piece: Column) -> Column:
    return piece.startswith("</") & F.contains(piece, F.lit(END))


def piece_attrs(piece: Column) -> Column:
    head = F.when(F.contains(piece, F.lit(END)), F.substring_index(piece, END, 1)).otherwise(F.lit(""))
    # A slash closes the tag only after white space or a quote; else an unquoted value ends with it.
    return F.trim(F.regexp_extract(head, r"""(?s)^</?[a-zA-Z][a-zA-Z0-9]*(.*?)(?:(?<=[\s"'])/|(?<=^<[a-zA-Z0-9]{1,20})/)?>$""", 1))


def raw_attribute(attrs: Column, name: str) -> Column:
    """Value of an attribute as written; empty when it is missing."""
    found = F.regexp_extract(attrs, rf"""(?is)(?:^|\s){name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return F.regexp_replace(found, r"""^["']|["']$""", "")


def attribute(attrs: Column, name: str) -> Column:
    """Value of an attribute with entities decoded."""
    return decode_entities(raw_attribute(attrs, name), in_attribute=True)


_COMMON = ["lt", "gt", "quot", "apos", "nbsp", "amp"]

# Longer names first, so that the pattern finds the longest.
_BARE = "|".join(sorted(BARE_ENTITIES, key=len, reverse=True))


def _entity(name: Column) -> Column:
    """Character of a name, looked up under its first two letters; NULL for unknown names."""
    table: dict[str, dict[str, str]] = {}
    for known, char in ENTITIES.items():
        table.setdefault(known[:2], {})[known] = char
    # Folded into one constant when the query is planned.
    whole = F.from_json(F.lit(json.dumps(table)), "map<string, map<string, string>>")
    return F.try_element_at(F.try_element_at(whole, F.substring(name, 1, 2)), name)


def _bare_entity(name: Column) -> Column:
    entries = "\x01".join(f"{known}\x02{char}" for known, char in BARE_ENTITIES.items())
    return F.try_element_at(F.str_to_map(F.lit(entries), F.lit("\x01"), F.lit("\x02")), name)


def decode_entities(text: Column, is_name: bool = False, in_attribute: bool = False) -> Column:
    """Named and numeric character references become characters, once each.

    A name without a semicolon counts if it is one of the older names, the
    longest that fits; in an attribute not if a letter, digit or "=" follows,
    as in the parameters of an address. Numbers that name no character become
    U+FFFD. ``is_name`` says that ``text`` is a plain column, which costs
    nothing to repeat, so the common case stays in generated code.
    """
    bare_end = "(?![=A-Za-z0-9])" if in_attribute else ""

    def reference(item: Column) -> Column:
        # item is what followed "&": a name or number, and the text up to the next "&".
        number = F.regexp_extract(item, r"^(#[xX][0-9a-fA-F]+|#[0-9]+);?", 1)
        code = F.when(number.rlike("^#[xX]"), F.conv(F.substr(number, F.lit(3)), 16, 10)).otherwise(F.substr(number, F.lit(2)))
        name = F.regexp_extract(item, r"^([A-Za-z][A-Za-z0-9]*);", 1)
        bare = F.regexp_extract(item, f"^({_BARE}){bare_end}", 1)

        def replaced(head: Column, char: Column) -> Column:
            rest = F.substr(item, F.length(head) + 1)
            return F.concat(char, F.when(rest.startswith(";"), F.substr(rest, F.lit(2))).otherwise(rest))

        def named(found: Column) -> Column:
            return F.when(found["char"].isNotNull(), replaced(found["name"], found["char"])).otherwise(
                let(
                    bare,
                    lambda b: F.when(b != "", F.concat(_bare_entity(b), F.substr(item, F.length(b) + 1))).otherwise(
                        F.concat(F.lit("&"), item)
                    ),
                )
            )

        def numbered(n: Column) -> Column:
            char = let(F.coalesce(code.try_cast("bigint"), F.lit(0).cast("bigint")), code_point_to_char)
            return let(char, lambda c: F.when(c.isNull(), F.concat(F.lit("&"), item)).otherwise(replaced(n, c)))

        by_name = let(F.struct(name.alias("name"), F.when(name != "", _entity(name)).alias("char")), named)
        return F.when(item.rlike("^#(?:[0-9]|[xX][0-9a-fA-F])"), let(number, numbered)).otherwise(by_name)

    def decoded(parts: Column) -> Column:
        tail = F.transform(F.slice(parts, 2, F.size(parts)), reference)
        return F.concat(F.get(parts, F.lit(0)), F.array_join(tail, ""))

    def common(value: Column) -> Column:
        return reduce(lambda acc, n: F.replace(acc, F.lit(f"&{n};"), F.lit(ENTITIES[n])), _COMMON, value)

    # Most text has no reference, or only the common ones, which plain
    # replacement handles; the ampersand goes last so nothing is decoded twice.
    def choose(t: Column) -> Column:
        unusual = t.rlike(rf"&(?!(?:{'|'.join(_COMMON)});)[#A-Za-z]")
        return (
            F.when(~F.contains(t, F.lit("&")), t)
            .when(unusual, let(F.split(t, "&", -1), decoded))
            .otherwise(common(t))
        )

    return choose(text) if is_name else let(text, choose)


# Numbers of control characters from 128 on mean what that byte is in Windows-1252.
_HIGH_CONTROLS = [bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(128, 160)]


def code_point_to_char(code: Column) -> Column:
    """Character of a code point, U+FFFD where there is none; NULL for control characters, which no text may hold."""
    high = F.get(F.array(*map(F.lit, _HIGH_CONTROLS)), (code - 128).cast("int"))
    none = (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
    usable = (code >= 32) | code.isin(9, 10)
    return (
        F.when(none, F.lit("\ufffd"))
        .when(code.between(128, 159), high)
        .when(usable, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    )


def visible_text(inner: Column) -> Column:
    """Text of an inline fragment: tags out, entities decoded, white space squeezed."""
    return F.trim(F.regexp_replace(decode_entities(without_tags(inner)), r"\s+", " "))


def link_text_bytes(inner: Column) -> Column:
    """Bytes of visible text inside links of an inline fragment."""
    labels = F.regexp_extract_all(inner, F.lit(rf"(?is)<a\b{ATTRS}>(.*?)(?:</a\s*>|\z)"), 1)
    return F.when(
        inner.rlike(r"(?i)<a\b"),
        F.aggregate(
            labels,
            F.lit(0).cast("bigint"),
            lambda acc, label: acc + F.octet_length(visible_text(label)).cast("bigint"),
        ),
    ).otherwise(F.lit(0).cast("bigint"))


# --- metadata -----------------------------------------------------------------

_BYLINE = r"""<([a-z][a-z0-9]*)\s[^>]*class\s*=\s*["'](?:[^"'>]*\s)?byline(?:\s[^"'>]*)?["'][^>]*>"""


def meta_attributes(clean: Column) -> Column:
    """Attribute text of every meta tag, in page order."""
    return F.regexp_extract_all(clean, F.lit(rf"(?i)<meta\b({ATTRS})>"), 1)


def _meta_content(metas: Column, *names: str) -> Column:
    """Content of the first meta tag with one of ``names``, tried in order."""

    def one(name: str) -> Column:
        named = rf"""(?is)(?:^|\s)(?:property|name)\s*=\s*["']?{name}["']?(?:\s|/|$)"""
        hits = F.filter(metas, lambda m: m.rlike(named))
        return F.nullif(F.trim(raw_attribute(F.get(hits, F.lit(0)), "content")), F.lit(""))

    return F.coalesce(*[one(n) for n in names])


def _first_match(clean: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(clean, pattern, 1), F.lit(""))


def page_title(clean: Column, metas: Column) -> Column:
    """Social title, else the title element, else the first heading."""
    return F.coalesce(
        visible_text(
            F.coalesce(
                _meta_content(metas, "og:title", "twitter:title"),
                _first_match(clean, r"(?is)<title\b[^>]*>\s*([^<]*[^<\s])\s*</title\s*>"),
                _first_match(clean, r"(?is)<h1\b[^>]*>(.*?)</h1\s*>"),
            )
        ),
        F.lit(""),
    )


def page_author(clean: Column, metas: Column) -> Column:
    """Author named in a meta tag, else the text of the first element of class byline; up to the next tag if unclosed."""
    stated = F.coalesce(
        _meta_content(metas, "author", "article:author"),
        F.nullif(F.regexp_extract(clean, rf"(?is){_BYLINE}(.*?)</\1\s*>", 2), F.lit("")),
        F.nullif(F.regexp_extract(clean, rf"(?is){_BYLINE}([^<]*)", 2), F.lit("")),
    )
    return F.coalesce(visible_text(stated), F.lit(""))


def page_date(clean: Column, metas: Column) -> Column:
    """Publication day as ``yyyy-MM-dd``; empty when missing or unreadable."""
    first_time = F.regexp_extract(clean, rf"(?i)<time\b({ATTRS})>", 1)
    stamp = F.coalesce(
        _meta_content(metas, "article:published_time", "og:published_time", "date"),
        F.nullif(F.trim(raw_attribute(first_time, "datetime")), F.lit("")),
    )
    # The day as written by the page, in its own time zone.
    day = F.regexp_extract(stamp, r"^(\d{4}-\d{2}-\d{2})", 1)
    return F.coalesce(F.when(F.try_to_timestamp(stamp).isNotNull(), day), F.lit(""))


def page_description(metas: Column) -> Column:
    stated = _meta_content(metas, "description", "og:description", "twitter:description")
    return F.coalesce(visible_text(stated), F.lit(""))


# --- inline Markdown ----------------------------------------------------------

# Characters that would read as Markdown inside running text.
_ESCAPED = r"([\\`*_\[\]]|<(?=[a-zA-Z/!?]))"
_CODE_TAGS = ["code", "kbd", "samp", "tt"]


# Marks that may hold whole blocks, and their tags.
SPANNING = {"bold": "b|strong", "em": "em|i", "link": "a"}


def open_ends(inner: Column, tags: str) -> Column:
    """How many of ``tags`` a fragment leaves open (u), and how many it closes that it did not open (s)."""
    none = F.struct(F.lit(0).cast("bigint").alias("u"), F.lit(0).cast("bigint").alias("s"))
    slashes = F.regexp_extract_all(inner, F.lit(rf"(?i)<(/?)(?:{tags})(?![a-zA-Z0-9])"), 1)

    def step(acc: Column, slash: Column) -> Column:
        stray = (slash == "/") & (acc["u"] == 0)
        u = acc["u"] + F.when(slash == "", 1).when(stray, 0).otherwise(-1)
        return F.struct(u.alias("u"), (acc["s"] + F.when(stray, 1).otherwise(0)).alias("s"))

    return F.when(F.contains(inner, F.lit("<")), F.aggregate(slashes, none, step)).otherwise(none)


def last_link(inner: Column) -> Column:
    """Attributes of the last link tag of a fragment."""
    return F.try_element_at(F.regexp_extract_all(inner, F.lit(rf"(?i)<a(?![a-zA-Z0-9])({ATTRS})>"), 1), F.lit(-1))


def _names_link(attrs: Column) -> Column:
    return attrs.rlike(r"(?i)(?:^|\s)href\s*=")


def inline_markdown(inner: Column, base: Column, carried: Column | None = None) -> Column:
    """Markdown of one block's inline content.

    The fragment is cut at its inline tags; each piece gets a mark for its tag
    and escaped text; the marks are then paired with plain patterns. A mark
    left open is closed at the end of the block. ``carried`` (link: attributes
    of a link tag; bold, em: boolean) are the marks open where the block begins.
    """

    def squeezed(text: Column) -> Column:
        return F.regexp_replace(decode_entities(text), r"\s+", " ")

    def escaped(text: Column) -> Column:
        return F.regexp_replace(text, _ESCAPED, r"\\$1")

    def mark(tag: Column, closes: Column, attrs: Column) -> Column:
        def pair(first: str, last: str) -> Column:
            return F.when(closes, F.lit(last)).otherwise(F.lit(first))

        # A link and an image both name an address; only one is read per tag.
        address = F.when(tag == "img", raw_attribute(attrs, "src")).otherwise(raw_attribute(attrs, "href"))
        image = F.concat(F.lit("!["), squeezed(raw_attribute(attrs, "alt")), F.lit("]("))
        reference = F.concat(
            F.when(tag == "img", image).otherwise(F.lit(LINK)),
            resolve_url(F.replace(F.trim(decode_entities(address, in_attribute=True)), F.lit(" "), F.lit("%20")), base),
            F.when(tag == "img", F.lit(")")).otherwise(F.lit(LINK_TEXT)),
        )
        names_address = ((tag == "a") & _names_link(attrs)) | (
            (tag == "img") & attrs.rlike(r"(?i)(?:^|\s)src\s*=")
        )
        return (
            F.when(tag.isin("b", "strong"), pair(BOLD, BOLD_END))
            .when(tag.isin("em", "i"), pair(EM, EM_END))
            .when((tag == "a") & closes, F.lit(LINK_END))
            .when(names_address, reference)
            .when(tag == "br", F.lit(BREAK))
            .when(tag.isin(_CODE_TAGS), pair(CODE, CODE_END))
            .when(tag == "mark", pair("<mark>", "</mark>"))
            .otherwise(F.lit(""))
        )

    def piece(item: Column) -> Column:
        head = F.struct(
            piece_tag(item).alias("tag"), piece_closes(item).alias("closes"), piece_attrs(item).alias("attrs")
        )
        # Nothing is escaped inside a code span.
        return F.when(
            F.contains(item, F.lit(END)),
            let(
                F.struct(head.alias("head"), squeezed(piece_text(item)).alias("text")),
                lambda p: F.concat(
                    mark(p["head"]["tag"], p["head"]["closes"], p["head"]["attrs"]),
                    F.when(p["head"]["tag"].isin(_CODE_TAGS) & ~p["head"]["closes"], p["text"]).otherwise(
                        escaped(p["text"])
                    ),
                ),
            ),
        ).otherwise(escaped(squeezed(item)))

    marked = F.array_join(F.transform(split_at_tags(inner), piece), "")
    plain = F.regexp_replace(decode_entities(inner, is_name=True), r"\s+", " ")
    has_marks = F.contains(inner, F.lit("<"))
    if carried is not None:
        link = carried["link"]
        address = decode_entities(raw_attribute(link, "href"), in_attribute=True)
        opened = F.concat(F.lit(LINK), resolve_url(F.replace(F.trim(address), F.lit(" "), F.lit("%20")), base), F.lit(LINK_TEXT))
        marked = F.concat(
            F.when(_names_link(link), opened).otherwise(F.lit("")),
            F.when(carried["bold"], F.lit(BOLD)).otherwise(F.lit("")),
            F.when(carried["em"], F.lit(EM)).otherwise(F.lit("")),
            marked,
        )
        has_marks = has_marks | link.isNotNull() | carried["bold"] | carried["em"]
    return F.trim(F.when(has_marks, _pair_marks(marked)).otherwise(escaped(plain)))


# Pairing rules, applied in this order. Empty pairs vanish, white
# space and breaks inside a pair move out of it, an open mark ends with the block.
# Emphasis that holds no other mark comes first, so an open one ends inside the bold around it.
PAIRING = [
    (r"\x11\s*(?:\x12|$)", ""),
    (r"\x11([^\x11\x12]*```[^\x11\x12]*)(?:\x12|$)", f"{TICKS} $1 {TICKS}"),
    (r"\x11([^\x11\x12]*``[^\x11\x12]*)(?:\x12|$)", "``` $1 ```"),
    (r"\x11([^\x11\x12]*`[^\x11\x12]*)(?:\x12|$)", "`` $1 ``"),
    (r"\x11([^\x11\x12]*)(?:\x12|$)", "`$1`"),
    (r"\x12", ""),
    (r"\x0e[^\x0f]*\x0f[\s\x03-\x06\x13]*(?:\x10|$)", ""),
    (r"\x0e([^\x0f]*)\x0f\s*([^\x0e\x10]*?)\s*(?:\x10|$)", "[$2]($1)"),
    (r"\x10", ""),
    (r"\x05([\s\x13]*)(?:\x06|$)", "$1"),
    (r"\x05([\s\x13]*)([^\x03-\x06]*?)([\s\x13]*)(?:\x06|$)", "$1_$2_$3"),
    (r"\x03([\s\x13]*)(?:\x04|$)", "$1"),
    (r"\x03([\s\x13]*)([^\x03\x04]*?)([\s\x13]*)(?:\x04|$)", "$1**$2**$3"),
    (r"[\x03\x04]", ""),
    (r"\x05([\s\x13]*)(?:\x06|$)", "$1"),
    (r"\x05([\s\x13]*)([^\x05\x06]*?)([\s\x13]*)(?:\x06|$)", "$1_$2_$3"),
    (r"[\x05\x06]", ""),
    (r"[ \x13]*\x13[ \x13]*$", ""),
    (r"^[ \x13]*\x13[ \x13]*", ""),
    (r" *\x13 *", "  \n"),
    (r" {2,}([^\n ])", " $1"),
]


def _pair_marks(marked: Column) -> Column:
    paired = reduce(lambda acc, rule: F.regexp_replace(acc, *rule), PAIRING, marked)
    # A code span with many back-ticks stands between more than any run of its block has.
    return let(
        paired,
        lambda p: F.when(F.contains(p, F.lit(TICKS)), F.replace(p, F.lit(TICKS), _longer_than_runs(p))).otherwise(p),
    )


def _longer_than_runs(text: Column, least: int = 1) -> Column:
    """One back-tick more than the longest run in ``text``, and ``least`` at least."""
    longest = F.array_max(F.transform(F.regexp_extract_all(text, F.lit("(`+)"), 1), F.length))
    return F.repeat(F.lit("`"), F.greatest(F.lit(least), F.coalesce(longest, F.lit(0)) + 1))


def escape_line_start(text: Column) -> Column:
    """Keep a block from reading as heading, list item or quote."""
    return F.regexp_replace(text, r"(?m)^(?=[#>+\-])|^(\d+)(?=[.)] )", r"$1\\")


def preformatted(inner: Column) -> Column:
    """Fenced code: tags out, entities decoded, white space untouched."""
    raw = decode_entities(F.regexp_replace(inner, rf"(?i)</?{_ANY_NAME}{ATTRS}>", ""))

    def fenced(text: Column) -> Column:
        fence = _longer_than_runs(text, 3)
        return F.concat(fence, F.lit("\n"), F.regexp_replace(text, r"^\n|\s+$", ""), F.lit("\n"), fence)

    return let(raw, fenced)
