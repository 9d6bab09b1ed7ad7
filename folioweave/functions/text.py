"""Column functions over titles, authors, chapter text and labels."""

from __future__ import annotations

import hashlib
import json
from html import entities as html_entities

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folioweave.functions.binding import bound, strip


# Strings that count as true in a rule's result.
TRUE_WORDS = ["true", "1", "yes", "是", "✓"]

# Two ideographic spaces open a paragraph.
INDENT = "　　"


def format_html(markup: Column) -> Column:
    """Drop tags, collapse white space (line ends too), trim."""
    bare = F.regexp_replace(F.coalesce(markup, F.lit("")), "<[^>]+>", "")
    return strip(F.regexp_replace(bare, r"(?U)\s+", " "))


def clean_title(name: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(name, F.lit("")), "《|》", ""))


def clean_author(author: Column) -> Column:
    bare = F.regexp_replace(F.coalesce(author, F.lit("")), r"(?iU)^(作者|Author|By)[：:]\s*", "")
    return strip(bare)


def is_true(value: Column) -> Column:
    return F.coalesce(F.lower(value).isin(TRUE_WORDS), F.lit(False))


def quote_pattern(text: Column) -> Column:
    """``text`` as a pattern that matches it literally."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"([\\\[\](){}.*+?^$|\-])", r"\\$1")


def strip_title(text: Column, title: Column, book: Column) -> Column:
    """Remove a chapter title repeated at the text start, after the book name or punctuation."""
    title_pattern = F.regexp_replace(quote_pattern(title), " ", r"\\s*")
    pattern = F.concat(
        F.lit(r"(?U)^(?:\s|\p{P}|"), quote_pattern(book), F.lit(")*"), title_pattern, F.lit(r"\s*")
    )
    return F.regexp_replace(text, pattern, F.lit(""))


def indent_paragraphs(text: Column) -> Column:
    """Trim each line, drop empty ones, open each with two ideographic spaces."""
    lines = F.transform(F.split(text, r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"), lambda s: F.regexp_replace(s, r"^[ 　\t\r\n]+|[ 　\t\r\n]+$", ""))
    kept = F.filter(lines, lambda s: s != "")
    return F.array_join(F.transform(kept, lambda s: F.concat(F.lit(INDENT), s)), "\n")


def paragraphs(text: Column) -> Column:
    """Paragraphs split on blank lines (on lines where there is none), inner space collapsed."""
    blocks = F.split(text, r"\n[ \t]*\n")
    parts = F.when(F.size(blocks) > 1, blocks).otherwise(F.split(text, "\n"))
    tidy = F.transform(parts, lambda s: strip(F.regexp_replace(s, r"(?U)\s+", " ")))
    return F.filter(tidy, lambda s: s != "")


def count_phrase(text: Column, phrase: str) -> Column:
    quoted = phrase.replace("\\E", "\\E\\\\E\\Q")
    return F.regexp_count(text, F.lit(f"(?iu)\\Q{quoted}\\E"))


def find_phrase(text: Column, phrase: str) -> Column:
    """1-based position of the first occurrence, 0 when there is none."""
    return F.instr(F.lower(text), phrase.lower())


# -- entities ----------------------------------------------------------------


_ENTITY = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
# What numbers stand for that name no character of their own (0, carriage return, and Windows-1252 from 128 on).
_NUMBERED = {0: "\ufffd", 13: "\r", **{n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160)}}


def _names() -> Column:
    """The named entities as a constant map, the usual ones first, as a map is searched from its start."""
    usual = ["amp;", "lt;", "gt;", "quot;", "nbsp;", "middot;", "copy;", "hellip;", "mdash;", "ldquo;", "rdquo;"]
    table = {**{n: html_entities.html5[n] for n in usual}, **html_entities.html5}
    return F.from_json(F.lit(json.dumps(table)), "map<string,string>")


def _by_number(digits: Column, base: int) -> Column:
    number = F.conv(F.when(F.length(F.ltrim(digits, F.lit("0"))) > 8, F.lit("99999999")).otherwise(digits), base, 10).cast("bigint")
    named = F.from_json(F.lit(json.dumps({str(k): v for k, v in _NUMBERED.items()})), "map<string,string>")
    return bound(number, lambda n: F.coalesce(
        F.try_element_at(named, n.cast("string")),
        F.when(n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "\ufffd")
        .when(n.between(1, 8) | n.between(14, 31) | (n == 11) | (n == 127) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(0xFFFE) == 0xFFFE), "")
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))))


def unescape(text: Column) -> Column:
    """Every named and numeric entity of HTML, natively; a name without its semicolon counts as far as it is one."""
    names = _names()

    def by_name(s: Column) -> Column:
        starts = F.transform(F.sequence(F.length(s) - 1, F.lit(1), F.lit(-1)), lambda n: F.struct(
            F.try_element_at(names, F.substring(s, F.lit(1), n)).alias("value"), F.substring(s, n + 1, F.length(s)).alias("rest")))
        longest = F.get(F.filter(starts, lambda c: c["value"].isNotNull()), F.lit(0))
        prefix = F.when(F.length(s) > 2, bound(longest, lambda c: F.concat(c["value"], c["rest"])))
        return F.coalesce(F.try_element_at(names, s), prefix, F.concat(F.lit("&"), s))

    def value(s: Column) -> Column:
        return (
            F.when(s.rlike("^#[xX]"), _by_number(F.regexp_extract(s, "[0-9a-fA-F]+(?=;?$)", 0), 16))
            .when(s.startswith("#"), _by_number(F.regexp_extract(s, "[0-9]+", 0), 10)).otherwise(by_name(s))
        )

    pieces, found = F.split(text, _ENTITY, -1), F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(1))
    joined = bound(pieces, lambda p: F.concat(F.get(p, F.lit(0)), F.array_join(F.transform(
        found, lambda s, i: F.concat(value(s), F.get(p, i + 1))), "")))
    return F.when(F.contains(text, F.lit("&")), joined).otherwise(text)


def unescape_common(text: Column) -> Column:
    """The five markup entities, natively."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def escape(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


# -- numbers in titles -------------------------------------------------------

# Numerals of chapter titles and what they stand for.
NUMERALS = {
    "〇": 0, "零": 0, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9,
    "壹": 1, "贰": 2, "叁": 3, "肆": 4, "伍": 5, "陆": 6, "柒": 7, "捌": 8, "玖": 9,
    "十": 10, "拾": 10, "百": 100, "佰": 100, "千": 1000, "仟": 1000, "万": 10000, "亿": 100000000,
}
_DIGITS = "".join(c for c, v in NUMERALS.items() if v < 10)
_UNITS = "".join(c for c, v in NUMERALS.items() if v >= 10)
_FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_HALF_WIDTH = "".join(chr(c) for c in range(0x21, 0x7F))


def _unit(character: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for c in _UNITS for x in (c, NUMERALS[c])]), character).cast("bigint")


def _section(text: Column) -> Column:
    """Value of a numeral below 万: every unit times the digits before it (1 without any), and the digits at the end."""
    pairs = rf"([0-9]*)([{_UNITS}])"
    times, units = (F.regexp_extract_all(text, F.lit(pairs), F.lit(g)) for g in (1, 2))
    values = F.zip_with(times, units, lambda n, u: F.try_multiply(F.greatest(F.coalesce(n.try_cast("bigint"), F.lit(0)), F.lit(1)), _unit(u)))
    rest = F.coalesce(F.regexp_extract(text, "([0-9]*)$", 1).try_cast("bigint"), F.lit(0))
    return F.aggregate(values, rest, F.try_add)


def _placed(text: Column, mark: str, value) -> Column:
    """Sections between ``mark``, each worth a power of the mark's number more than the next one."""
    base = F.lit(NUMERALS[mark]).cast("bigint")
    return F.aggregate(F.split(text, mark, -1), F.lit(0).cast("bigint"), lambda high, part: F.try_add(F.try_multiply(high, base), value(part)))


def _numeral_value(number: Column) -> Column:
    """Value of a multiplicative numeral; -1 for anything else and for what no 64-bit number holds.

    A last digit right after a unit above ten counts in tenths of that unit.
    """
    digits = F.translate(number, _DIGITS, "".join(str(NUMERALS[c]) for c in _DIGITS))
    large = "".join(c for c in _UNITS if NUMERALS[c] > 10)
    short = rf"^(.+([{large}]))([0-9])$"

    def value(text: Column) -> Column:
        return _placed(text, "亿", lambda part: _placed(part, "万", _section))

    tail = F.try_multiply(F.regexp_extract(digits, short, 3).try_cast("bigint"), (_unit(F.regexp_extract(digits, short, 2)) / 10).cast("bigint"))
    whole = F.when(digits.rlike(short), F.try_add(value(F.regexp_extract(digits, short, 1)), tail)).otherwise(value(digits))
    return F.when(number.rlike(f"^[{_DIGITS}{_UNITS}]+$"), F.coalesce(whole, F.lit(-1))).otherwise(F.lit(-1))


def chapter_number(title: Column) -> Column:
    """``第…章`` titles with the numeral written in digits; other titles unchanged."""
    pattern = r"^(第)(.+?)(章.*)$"
    number = F.regexp_replace(
        F.translate(F.regexp_extract(title, pattern, 2), _FULL_WIDTH + "　", _HALF_WIDTH + " "), r"[ \t]", ""
    )

    def value(n: Column) -> Column:
        positional = F.translate(n, _DIGITS, "".join(str(NUMERALS[c]) for c in _DIGITS))
        return (
            F.when(n.rlike(r"^[0-9]{1,18}$"), n.cast("bigint"))
            .when((F.length(n) > 1) & n.rlike(f"^[{_DIGITS}]{{1,18}}$"), positional.cast("bigint"))
            .otherwise(_numeral_value(n))
        )

    def rewritten(v: Column) -> Column:
        head, tail = F.regexp_extract(title, pattern, 1), F.regexp_extract(title, pattern, 3)
        return F.when(v >= 0, F.concat(head, v.cast("string"), tail)).otherwise(title)

    return F.when(title.rlike(pattern), bound(bound(number, value), rewritten)).otherwise(title)


def convert_script(text: Column, simple: str, traditional: str, mode: int) -> Column:
    """Character-table conversion: 1 simplified to traditional, 2 back, anything else unchanged.

    The caller brings the table, two strings of equal length.
    """
    if mode == 1:
        return F.translate(text, simple, traditional)
    if mode == 2:
        return F.translate(text, traditional, simple)
    return text


# -- times, types, keys ------------------------------------------------------


def epoch_seconds(value: Column) -> Column:
    """Seconds from a count of seconds or milliseconds, told apart by size."""
    return F.when(value > 10_000_000_000, (value / 1000)).otherwise(value)


def format_epoch(value: Column, pattern: str = "yyyy-MM-dd HH:mm:ss", offset_hours: int = 0) -> Column:
    shifted = F.timestamp_seconds(epoch_seconds(value) + offset_hours * 3600)
    return F.date_format(shifted, pattern)


def format_epoch_short(value: Column, now: Column) -> Column:
    """Time for today, month, day and time for this year, else the date."""
    at, ref = F.timestamp_seconds(epoch_seconds(value)), F.timestamp_seconds(epoch_seconds(now))
    return (
        F.when(F.to_date(at) == F.to_date(ref), F.date_format(at, "HH:mm"))
        .when(F.year(at) == F.year(ref), F.date_format(at, "MM-dd HH:mm"))
        .otherwise(F.date_format(at, "yyyy-MM-dd"))
    )


# Content type flags of a book.
TEXT, UPDATE_ERROR, AUDIO, IMAGE, WEB_FILE, LOCAL, ARCHIVE, NOT_SHELF = 8, 16, 32, 64, 128, 256, 512, 1024


def type_flags(source_type: Column) -> Column:
    """Content flags of a source type code: 1 audio, 2 image, 3 file, else text."""
    return (
        F.when(source_type == 3, F.lit(TEXT | WEB_FILE))
        .when(source_type == 2, F.lit(IMAGE))
        .when(source_type == 1, F.lit(AUDIO))
        .otherwise(F.lit(TEXT))
    )


def add_flag(flags: Column, flag: int) -> Column:
    return flags.bitwiseOR(F.lit(flag))


def has_flag(flags: Column, flag: int) -> Column:
    return flags.bitwiseAND(F.lit(flag)) != 0


def quote_url(text: Column) -> Column:
    """Percent-encoding with ``%20`` for the blank."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def identity_key(*parts: Column) -> Column:
    """Storage key of an identity: SHA-1 over its parts, one per line."""
    return F.sha1(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def md5_middle(text: Column) -> Column:
    return F.substring(F.md5(text), 9, 16)


def hmac_hex(message: Column, key: str, algorithm: str = "sha1") -> Column:
    """Keyed digest (HMAC) in hexadecimal: two digests over the key's pads."""
    digest = {"md5": F.md5, "sha1": F.sha1, "sha256": lambda c: F.sha2(c, 256), "sha512": lambda c: F.sha2(c, 512)}[algorithm]
    block = 128 if algorithm == "sha512" else 64
    secret = key.encode()
    if len(secret) > block:
        secret = hashlib.new(algorithm, secret).digest()
    secret = secret.ljust(block, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in secret)) for pad in (0x36, 0x5C))
    return digest(F.concat(outer, F.unhex(digest(F.concat(inner, message.cast("binary"))))))
