"""Rule patterns are written for Python's ``re``; Spark runs Java's dialect.

A pattern is parsed once, when its rule is compiled, and written anew for Java piece by piece. What has no safe Java form
(conditionals, odd look-behinds, unknown pieces) has no translation: its rule is reported and left out, and no job ends by it.
"""

from __future__ import annotations

import re
import warnings
from re import _constants as op
from re import _parser as parser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

#: Python's classes in Java's Unicode mode.
_CLASSES = {
    "CATEGORY_DIGIT": r"\p{Nd}", "CATEGORY_NOT_DIGIT": r"\P{Nd}", "CATEGORY_SPACE": r"\s\x1C-\x1F", "CATEGORY_NOT_SPACE": r"\S&&[^\x1C-\x1F]",
    "CATEGORY_WORD": r"\p{L}\p{N}_", "CATEGORY_NOT_WORD": r"^\p{L}\p{N}_",
}
_MOST = 10_000
#: Open-ended look-behinds have no width in Java.
_WIDEST_BEHIND = 255


class Untranslatable(ValueError):
    """The pattern has no Java form with the same matches."""


def _char(code: int) -> str:
    return f"\\x{{{code:X}}}"


def _class(items: list) -> str:
    negate = items[0][0] is op.NEGATE
    out = []
    for kind, value in items[negate:]:
        if kind is op.LITERAL:
            out.append(_char(value))
        elif kind is op.RANGE:
            out.append(f"{_char(value[0])}-{_char(value[1])}")
        elif kind is op.CATEGORY:
            out.append(f"[{_CLASSES[str(value)]}]")
        else:
            raise Untranslatable(str(kind))
    return f"[{'^' * negate}{''.join(out)}]"


def _sequence(nodes, flags: int, names: dict[int, str]) -> str:
    return "".join(_node(kind, value, flags, names) for kind, value in nodes)


def _anchor(where, flags: int) -> str:
    if where is op.AT_BEGINNING:
        return r"(?:(?<=\n)|\A)" if flags & re.MULTILINE else r"\A"
    if where is op.AT_END:
        return r"(?=\n|\z)" if flags & re.MULTILINE else r"(?=\n?\z)"
    word = r"[\p{L}\p{N}_]"
    edge = f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))"
    fixed = {op.AT_BEGINNING_STRING: r"\A", op.AT_END_STRING: r"\z", op.AT_BOUNDARY: edge, op.AT_NON_BOUNDARY: f"(?!{edge})"}
    if where not in fixed:
        raise Untranslatable(str(where))
    return fixed[where]


def _group(value, flags: int, names: dict[int, str]) -> str:
    number, more, less, inner = value
    body = _sequence(inner, (flags | more) & ~less, names)
    switch = "".join(c for c, f in (("i", re.IGNORECASE),) if more & f)
    off = "".join(c for c, f in (("i", re.IGNORECASE),) if less & f)
    if switch or off:
        body = f"(?{switch}{'-' + off if off else ''}:{body})"
    return f"(?:{body})" if number is None else f"(?<{names[number]}>{body})" if number in names else f"({body})"


def _node(kind, value, flags: int, names: dict[int, str]) -> str:
    if kind is op.LITERAL:
        return _char(value)
    if kind is op.NOT_LITERAL:
        return f"[^{_char(value)}]"
    if kind is op.ANY:
        return r"[\s\S]" if flags & re.DOTALL else r"[^\n]"
    if kind is op.IN:
        return _class(value)
    if kind is op.BRANCH:
        return "(?:" + "|".join(_sequence(branch, flags, names) for branch in value[1]) + ")"
    if kind is op.SUBPATTERN:
        return _group(value, flags, names)
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        least, most, inner = value
        if least > _MOST or (most is not op.MAXREPEAT and most > _MOST):
            raise Untranslatable("repeat count")
        count = f"{{{least},{'' if most is op.MAXREPEAT else most}}}"
        return f"(?:{_sequence(inner, flags, names)}){count}" + {op.MAX_REPEAT: "", op.MIN_REPEAT: "?", op.POSSESSIVE_REPEAT: "+"}[kind]
    if kind is op.ATOMIC_GROUP:
        return f"(?>{_sequence(value, flags, names)})"
    if kind is op.GROUPREF:
        return f"(?:\\{value})"
    if kind is op.AT:
        return _anchor(value, flags)
    if kind in (op.ASSERT, op.ASSERT_NOT):
        direction, inner = value
        if direction < 0 and inner.getwidth()[1] > _WIDEST_BEHIND:
            raise Untranslatable("wide look-behind")
        return f"(?{'<' if direction < 0 else ''}{'=' if kind is op.ASSERT else '!'}{_sequence(inner, flags, names)})"
    raise Untranslatable(str(kind))


def java_pattern(pattern: str, dotall: bool = False) -> str:
    """A Java pattern with the same matches, groups in the same order; raises ``ValueError`` where there is none."""
    try:
        with warnings.catch_warnings(action="ignore"):  # of class syntax that may change; it is written out here
            tree = parser.parse(pattern, re.DOTALL if dotall else 0)
    except (re.error, OverflowError, RecursionError) as error:
        raise Untranslatable(str(error)) from None
    flags = tree.state.flags
    if flags & (re.LOCALE | re.ASCII):
        raise Untranslatable("ASCII or locale mode")
    body = _sequence(tree, flags, {})
    return f"(?iuU){body}" if flags & re.IGNORECASE else f"(?U){body}"


def java_replacement(replacement: str, pattern: str = "") -> str:
    """A Java replacement: ``\\1`` and ``\\g<name>`` become group numbers; everything else stands for itself.

    Raises ``ValueError`` for groups that ``pattern`` does not have.
    """
    groups = {}
    count = 99
    if pattern:
        compiled = re.compile(pattern)
        groups, count = compiled.groupindex, compiled.groups
    out, at = [], 0
    for found in re.finditer(r"\\g<(\w+)>|\\([1-9][0-9]?)|\\(.)", replacement, re.DOTALL):
        out.append(_quoted(replacement[at : found.start()]))
        named, number, other = found.groups()
        if other is not None:
            out.append(_quoted({"n": "\n", "t": "\t", "r": "\r", "\\": "\\"}.get(other, "\\" + other)))
        else:
            wanted = number or named
            group = int(wanted) if wanted.isdigit() else groups.get(wanted)
            if group is None or group > count:
                raise Untranslatable(f"no group {wanted}")
            # Java takes a following digit into the group's number only if there is such a group.
            out.append(f"${group}")
            following = replacement[found.end() : found.end() + 1]
            if following.isdigit() and group * 10 + int(following) <= count:
                raise Untranslatable("digit after a group")
        at = found.end()
    return "".join(out) + _quoted(replacement[at:])


def required_text(pattern: str) -> str:
    """The longest run of characters that stands in every match; empty where none is sure, as without regard to case."""
    parsed = parser.parse(pattern)
    if parsed.state.flags & re.IGNORECASE:
        return ""
    runs = [""]

    def read(nodes) -> None:
        for kind, value in nodes:
            if kind is op.LITERAL:
                runs[-1] += chr(value)
            elif kind is op.SUBPATTERN and not value[1] and not value[2]:
                read(value[3])
            elif kind is not op.AT:
                runs.append("")
                if kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] > 0:
                    read(value[2])
                    runs.append("")

    read(parsed)
    return max(runs, key=len)


def literal_text(pattern: str) -> str | None:
    """The one text that the pattern matches; none where it is not such a pattern."""
    parsed = parser.parse(pattern)
    plain = not parsed.state.flags & re.IGNORECASE and all(kind is op.LITERAL for kind, _ in parsed)
    return "".join(chr(value) for _, value in parsed) if plain else None


def _quoted(text: str) -> str:
    return text.replace("\\", "\\\\").replace("$", "\\$")


def python_ok(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except (re.error, OverflowError, RecursionError):
        return False
    return True


def pattern_ok(pattern: str | None) -> bool:
    """Whether the pattern is valid and has a Java form."""
    try:
        java_pattern(pattern or "")
    except ValueError:
        return False
    return True


def rule_pattern_ok(pattern: str | None) -> bool:
    """Not empty, translatable, and does not end in a bare ``|``."""
    return bool(pattern) and pattern_ok(pattern) and re.search(r"(?<!\\)\|$", pattern) is None


@F.pandas_udf(BooleanType())
def _valid(pattern: pd.Series) -> pd.Series:
    return pattern.map(rule_pattern_ok)


def valid_pattern(pattern: Column) -> Column:
    """Whether each rule pattern (one row a rule) can run; the parser of the rule dialect is Python's own."""
    return _valid(pattern)
