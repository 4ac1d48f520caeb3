"""HTML: escaping, tag stripping, rules between tags, merging of neighbouring lines."""

from __future__ import annotations

import json
from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import let, lines_of, replace_matches


def escape(x: Column, quote: bool = False) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")] + [('"', "&quot;"), ("'", "&#039;")] * quote
    for a, b in pairs:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


#: Fixed value: what may be a character reference.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: The longest name that stands without a semicolon.
SHORT_NAME = max(len(name) for name in html5 if not name.endswith(";"))


@lru_cache(1)
def _names() -> str:
    """HTML's names by their first letter, as JSON."""
    by_letter: dict[str, dict[str, str]] = {}
    for name, text in html5.items():
        by_letter.setdefault(name[0], {})[name] = text
    return json.dumps(by_letter, ensure_ascii=False)


def _named(name: Column) -> Column:
    """The text of a name that HTML knows, else null."""
    names = F.from_json(F.lit(_names()), "map<string,map<string,string>>")
    return F.try_element_at(F.try_element_at(names, F.left(name, F.lit(1))), name)


def _numbered(digits: Column, base: int) -> Column:
    """The character of a numeric reference. Windows-1252 stands for the numbers of its letters, U+FFFD for what is no
    character, and control and reserved numbers vanish."""
    plain = F.regexp_replace(digits, "^0+(?=.)", "")
    n = F.when(F.length(plain) <= 8, F.conv(plain, base, 10).cast("long")).otherwise(F.lit(0x110000))

    def character(n: Column) -> Column:
        windows = {k: bytes([k]).decode("cp1252", "ignore") or chr(k) for k in range(0x80, 0xA0)}
        gone = (n < 9) | (n == 0x0B) | n.between(0x0E, 0x1F) | (n == 0x7F) | n.between(0xFDD0, 0xFDEF) | ((n % 0x10000) >= 0xFFFE)
        old = F.element_at(F.array(*[F.lit(c) for c in windows.values()]), (n - 0x7F).cast("int"))
        return (
            F.when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), F.lit("\ufffd"))
            .when(n.between(0x80, 0x9F), old)
            .when(gone, "")
            .otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
        )

    return let(n, character)


def _referred(m: Column) -> Column:
    """What a reference stands for; a name that HTML doesn't know is cut to the longest known one at its beginning."""
    body = F.substring(m, F.lit(2), F.length(m))
    hexadecimal, decimal = F.regexp_extract(m, "^&#[xX]([0-9a-fA-F]+)", 1), F.regexp_extract(m, "^&#([0-9]+)", 1)
    begins = [F.when(F.length(body) > k, F.concat(_named(F.left(body, F.lit(k))), F.substring(body, F.lit(k + 1), F.length(body)))) for k in range(SHORT_NAME, 1, -1)]
    return F.when(hexadecimal != "", _numbered(hexadecimal, 16)).when(decimal != "", _numbered(decimal, 10)).otherwise(F.coalesce(_named(body), *begins, m))


def unescape(x: Column) -> Column:
    """All of HTML's character references as text, each read once: &amp;lt; is &lt;."""
    return F.when(F.contains(x, F.lit("&")), replace_matches(x, REFERENCE, _referred)).otherwise(x)


TAG = "<[^>]+>"


def strip_tags(x: Column) -> Column:
    return F.regexp_replace(x, TAG, " ")


def between_tags(x: Column, change) -> Column:
    """change(text) on what stands between tags (unescaped before, escaped after); tags stay."""
    gaps = F.transform(F.split(x, TAG, -1), lambda g: F.when(g == "", g).otherwise(escape(change(unescape(g)))))
    tags = F.regexp_extract_all(x, F.lit(f"({TAG})"), F.lit(1))
    return F.array_join(F.flatten(F.zip_with(gaps, tags, lambda g, t: F.array(g, F.coalesce(t, F.lit(""))))), "")


def fixed_between_tags(x: Column, change) -> Column:
    """change(texts) on the array of all texts between tags, so that what it remembers goes from one to the next; they are
    unescaped before and escaped after, and tags stay."""
    gaps = F.split(x, TAG, -1)
    tags = F.regexp_extract_all(x, F.lit(f"({TAG})"), F.lit(1))
    fixed = F.transform(change(F.transform(gaps, unescape)), lambda g: escape(g))
    return F.array_join(F.flatten(F.zip_with(fixed, tags, lambda g, t: F.array(g, F.coalesce(t, F.lit(""))))), "")


#: What opens a right-hand block, and numbered headings, which are not joined.
RIGHT, NUMBERED = '<p class="r">', r"^<h2>(?:[IVXLC]+\.|\d+\.|Глава|ГЛАВА|Раздел|РАЗДЕЛ)\s"


def merged_blocks(x: Column) -> Column:
    """Lines of a page's HTML: neighbouring right-hand blocks become one, and so do neighbouring h2 before the first plain
    paragraph or h3, unless numbered. Whether a line joins the one before it depends on both lines' openings only."""
    starts = lambda v, head: F.startswith(v, F.lit(head))

    def merged(lines: Column) -> Column:
        kinds = F.transform(lines, lambda v: F.when(starts(v, RIGHT), "r").when(starts(v, "<h2>"), F.when(F.rlike(v, F.lit(NUMBERED)), "H").otherwise("h")).when(starts(v, "<p>") | starts(v, "<h3>"), "p").otherwise(""))

        def joined(k: Column) -> Column:
            first = F.array_position(k, "p")
            early = lambda i: (first == 0) | (first > i)  # noqa: E731  no plain paragraph among the lines before i
            joins = lambda i: F.coalesce((i > 0) & ((F.get(k, i) == "r") & (F.get(k, i - 1) == "r") | (F.get(k, i) == "h") & F.get(k, i - 1).isin("h", "H") & early(i)), F.lit(False))
            tag = lambda i: F.when(F.get(k, i) == "r", len(RIGHT)).otherwise(4)
            close = lambda i: F.when(F.get(k, i) == "r", 4).otherwise(5)
            body = lambda v, i: F.when(joins(i), F.concat(F.lit("<br>"), F.substring(v, tag(i) + 1, F.length(v)))).otherwise(F.concat(F.when(i > 0, "\n").otherwise(""), v))
            cut = lambda b, i: F.when(joins(i + 1), F.substring(b, F.lit(1), F.length(b) - close(i))).otherwise(b)
            return F.array_join(F.transform(lines, lambda v, i: cut(body(v, i), i)), "")

        return let(kinds, joined)

    return let(F.split(x, "\n", -1), merged)


def page_body(x: Column, pairs: list[tuple[str, str]]) -> Column:
    """A page's HTML in one style: all rules between its tags, with quotes followed through it, then joined blocks."""
    from tessera.functions.style import fixed_parts

    return merged_blocks(fixed_between_tags(x, lambda texts: fixed_parts(texts, pairs)))


def page_log(x: Column, pairs: list[tuple[str, str]]) -> Column:
    """Array of the distinct (was, became) that page_body() changes by correction or punctuation, in order."""
    from tessera.functions.style import parts_log

    return parts_log(F.transform(F.split(x, TAG, -1), unescape), pairs)


def heading_level(x: Column) -> Column:
    """h2 for capitals and numbered headings (a fixed pattern), else h3."""
    numbered = r"^(?:[IVXLC]+\.?\s|Глава\s|ГЛАВА\s|Раздел\s|РАЗДЕЛ\s|Приложение\s|ПРИЛОЖЕНИЕ\s|\d+(?:\.\d+)*\.?\s+[А-ЯЁ][А-ЯЁ\s,.-]{6,}$)"
    return F.when(is_upper(x) | F.rlike(x, F.lit(numbered)), "h2").otherwise("h3")


def is_upper(x: Column) -> Column:
    return (x == F.upper(x)) & (x != F.lower(x))


def text_line(x: Column) -> Column:
    """One line of a plain text: a short line in capitals is a heading."""
    x = F.regexp_replace(F.regexp_replace(x, r"(?U)\s+", " "), "^ | $", "")
    return F.when((F.length(x) < 120) & is_upper(x), F.concat(F.lit("<h2>"), escape(x), F.lit("</h2>"))).otherwise(F.concat(F.lit("<p>"), escape(x), F.lit("</p>")))


def text_html(x: Column) -> Column:
    lines = F.filter(lines_of(x), lambda v: F.rlike(v, F.lit(r"(?U)\S")))
    return F.array_join(F.transform(lines, text_line), "\n")


def docx_paragraph(text: Column, style: Column, align: Column, bold: Column) -> Column:
    """A word processor's paragraph by style name, alignment and weight."""
    level = heading_level(text)
    head = F.concat(F.lit("<"), level, F.lit(">"), escape(text), F.lit("</"), level, F.lit(">"))
    short = bold & (F.length(text) < 220)
    p = lambda cls: F.concat(F.lit(f'<p class="{cls}">' if cls else "<p>"), escape(text), F.lit("</p>"))
    titled = F.rlike(F.lower(style), F.lit("^(heading|заголовок|title)"))
    numbered = level == "h2"
    return (
        F.when(titled | short & F.contains(align, F.lit("CENTER")), head)
        .when(F.contains(align, F.lit("CENTER")), F.when(is_upper(text), F.concat(F.lit("<h2>"), escape(text), F.lit("</h2>"))).otherwise(p("c")))
        .when(F.contains(align, F.lit("RIGHT")), p("r"))
        .when(short & numbered, head)
        .otherwise(p(""))
    )
