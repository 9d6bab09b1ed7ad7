"""Style selectors, path expressions and JSON paths as hops over a page's node array.

All three languages end in the same form: a path is an array of hops, a hop is an axis, a name and tests. An axis is an interval
of places in document order with a condition on parent or last descendant (``operators.extract``). A test may hold paths of its
own, which must (``with``) or must not (``without``) lead anywhere from the node. Such tests nest NESTED deep; what can be said
without nesting (``:not(:has(a))``, ``not(@a or @b)``) is.

What stands inside ``:not(…)`` is turned round: ``:not(ul > .a b)`` asks that no path leads from a node that is ``b`` up to an
ancestor ``.a`` with a parent ``ul``.
"""

from __future__ import annotations

import re

NESTED = 1

_PLAIN = "of: STRING, kind: STRING, name: STRING, value: STRING"
_HOP = f"STRUCT<axis: INT, tag: STRING, tests: ARRAY<STRUCT<{_PLAIN}>>>"
for _ in range(NESTED):
    TEST = f"STRUCT<{_PLAIN}, paths: ARRAY<ARRAY<{_HOP}>>>"
    _HOP = f"STRUCT<axis: INT, tag: STRING, tests: ARRAY<{TEST}>>"
#: ``places`` are tests of the place among the nodes that the hop finds from one node.
HOP = f"STRUCT<axis: INT, tag: STRING, tests: ARRAY<{TEST}>, places: ARRAY<STRUCT<{_PLAIN}>>>"

#: Up to FOLLOWING, an axis is its interval; the others have a condition besides.
(DOWN, DOWN_OR_SELF, SELF, UP, FOLLOWING, CHILD, NEXT, AFTER, UPPER, UPPER_OR_SELF, PREVIOUS, BEFORE, PRECEDING) = range(13)
#: Axes whose places count backwards.
BACKWARDS = (UP, UPPER, UPPER_OR_SELF, PREVIOUS, BEFORE, PRECEDING)
_TURNED = {DOWN: UPPER, CHILD: UP, NEXT: PREVIOUS, AFTER: BEFORE}

#: Any element; any node that can have children, the page itself too.
ELEMENT, ANY = "*", "**"
#: Tags of JSON nodes: a member has its name behind MEMBER, an item of a list is ITEM.
MEMBER, ITEM = ".", "[]"


class Unsupported(ValueError):
    pass


#: What a test is ``of``: an attribute, an element's own text, all text under it (or a JSON scalar), that text with single blanks,
#: an ordinal, or the node itself.
ATTRIBUTE, OWN, TEXT, WORDS, NODE = "@", "own", "text", "words", ""
ORDINALS = ("nth", "nth_last", "nth_type", "nth_type_last")


def test(of: str, kind: str, name: str = "", value: str = "", paths: list | None = None) -> dict:
    return {"of": of, "kind": kind, "name": name, "value": value, "paths": paths}


def ordinal(of: str, a: int, b: int) -> dict:
    """Whether an ordinal is a * n + b for some n of 0 or more."""
    return test(of, "an+b", str(a), str(b))


def leads(paths: list[list[dict]], somewhere: bool = True) -> dict:
    """The test that one of ``paths`` leads somewhere, or that none does. Paths that only ask the same of the node itself are put in."""
    flat = []
    for path in paths:
        only = path[0]["tests"][0] if len(path) == 1 and len(path[0]["tests"]) == 1 and (path[0]["axis"], path[0]["tag"]) in ((SELF, ELEMENT), (SELF, ANY)) else None
        flat += only["paths"] if only and only["kind"] == "with" else [path]
    if len(paths) == 1 and len(flat) == 1 and only and only["kind"] == "without":
        flat, somewhere = only["paths"], not somewhere
    paths = flat
    return test(NODE, "with" if somewhere else "without", paths=paths)


def hop(axis: int, tag: str = ELEMENT, tests: list | None = None, places: list | None = None) -> dict:
    return {"axis": axis, "tag": tag, "tests": tests or [], "places": places or []}


def _depth(hops: list[dict]) -> int:
    inner = [p for h in hops for t in h["tests"] for p in t["paths"] or []]
    return 1 + max(map(_depth, inner)) if inner else 0


def _fitting(hops: list[dict], source: str, level: int = 0) -> list[dict]:
    """``hops`` if its tests nest no deeper than a rule can hold, and count no places inside."""
    if _depth(hops) > NESTED:
        raise Unsupported(f"nesting of {source}")
    if level and any(h["places"] for h in hops):
        raise Unsupported(f"position inside {source}")
    for h in hops:
        for t in h["tests"]:
            for p in t["paths"] or []:
                _fitting(p, source, level + 1)
    return hops


def outside(source: str, separators: str) -> list[str]:
    """Split at separators that stand outside brackets and quotes; the separators are kept."""
    out, depth, quote, piece = [], 0, "", ""
    for c in source:
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "[(":
            depth += 1
        elif c in "])":
            depth -= 1
        elif depth == 0 and c in separators:
            out += [piece, c]
            piece = ""
            continue
        piece += c
    return [*out, piece]


def _words(source: str, word: str) -> list[str]:
    """Split at a word that stands outside brackets and quotes."""
    pieces, out = outside(source, " \t\n"), [""]
    for piece in pieces:
        if piece == word:
            out.append("")
        else:
            out[-1] += piece
    return [p.strip() for p in out]


# -- style selectors ---------------------------------------------------------

_SIMPLE = re.compile(
    r"(?P<tag>^[\w*-]+)|#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)"
    r"|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~^$*|!]?=)\s*[\"']?(?P<val>[^\"'\]]*)[\"']?\s*)?\]"
    r"|:(?P<pseudo>[\w-]+)"
)
_NTH = re.compile(r"(?:(?P<a>[+-]?\d*)n\s*(?:(?P<sign>[+-])\s*(?P<b>\d+))?|(?P<only>[+-]?\d+))", re.I)
_ORDINALS = {"nth-child": "nth", "nth-last-child": "nth_last", "nth-of-type": "nth_type", "nth-last-of-type": "nth_type_last"}
_FIRST = {"first-child": ["nth"], "last-child": ["nth_last"], "first-of-type": ["nth_type"], "last-of-type": ["nth_type_last"],
          "only-child": ["nth", "nth_last"], "only-of-type": ["nth_type", "nth_type_last"]}


def _ordinal(of: str, arg: str) -> dict:
    arg = {"odd": "2n+1", "even": "2n"}.get(arg.strip().lower(), arg.strip())
    m = _NTH.fullmatch(arg)
    if not m:
        raise Unsupported(f"position {arg}")
    if m["only"]:
        return ordinal(of, 0, int(m["only"]))
    a = {"": 1, "+": 1, "-": -1}.get(m["a"]) or int(m["a"] or 0)
    return ordinal(of, a, int(m["b"] or 0) * (-1 if m["sign"] == "-" else 1))


def _pseudo(name: str, arg: str | None) -> list[dict]:
    if name in _FIRST and arg is None:
        return [ordinal(of, 0, 1) for of in _FIRST[name]]
    if name in _ORDINALS and arg is not None:
        return [_ordinal(_ORDINALS[name], arg)]
    if name in ("contains", "-soup-contains", "-soup-contains-own") and arg is not None:
        return [test(OWN if name.endswith("own") else TEXT, "*=", value=arg.strip("\"' "))]
    if name in ("not", "is", "where", "matches") and arg is not None:
        return [leads([_turned(p) for p in css_paths(arg)], name != "not")]
    if name == "has" and arg is not None:
        return [leads(css_paths(arg, relative=True))]
    if name in ("empty", "root") and arg is None:
        return [test(NODE, name)]
    raise Unsupported(f"pseudo class {name}")


def _turned(hops: list[dict]) -> list[dict]:
    """The path that leads from a node at the end of ``hops`` back over them."""
    back = [{**hops[-1], "axis": SELF}]
    for later, earlier in zip(hops[::-1], hops[-2::-1], strict=False):
        back.append({**earlier, "axis": _TURNED[later["axis"]]})
    return back


def _argument(source: str, at: int) -> tuple[str | None, int]:
    """What stands in the parentheses that open at ``at``, and where they end."""
    if source[at:at + 1] != "(":
        return None, at
    depth, quote = 0, ""
    for i in range(at, len(source)):
        c = source[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
            if not depth:
                return source[at + 1:i], i + 1
    raise Unsupported(f"selector {source}")


def _compound(source: str, axis: int) -> dict:
    tag, tests, at = ELEMENT, [], 0
    while at < len(source):
        m = _SIMPLE.match(source, at) if at == 0 or source[at] in "#.[:" else None
        if not m:
            raise Unsupported(f"selector {source}")
        at = m.end()
        if m["tag"]:
            tag = m["tag"].lower()
        elif m["id"]:
            tests.append(test(ATTRIBUTE, "=", "id", m["id"]))
        elif m["cls"]:
            tests.append(test(ATTRIBUTE, "~=", "class", m["cls"]))
        elif m["attr"]:
            tests.append(test(ATTRIBUTE, m["op"] or "has", m["attr"].lower(), m["val"] or ""))
        else:
            arg, at = _argument(source, at)
            tests += _pseudo(m["pseudo"], arg)
    if not source:
        raise Unsupported("empty selector")
    return hop(axis, tag, tests)


_COMBINATORS = {">": CHILD, "+": NEXT, "~": AFTER}


def css_paths(selector: str, relative: bool = False) -> list[list[dict]]:
    """The paths of a selector list; a ``relative`` one may begin with a combinator."""
    paths = []
    for group in outside(selector, ",")[::2]:
        hops, axis = [], DOWN
        for piece in outside(group.strip(), " >+~"):
            if piece in _COMBINATORS:
                if axis != DOWN or not (hops or relative):
                    raise Unsupported(f"combinator {piece}")
                axis = _COMBINATORS[piece]
            elif piece.strip():
                hops.append(_compound(piece, axis))
                axis = DOWN
        if axis != DOWN or (not hops and group.strip() != group):
            raise Unsupported(f"selector {selector}")
        paths.append(_fitting(hops, selector))
    return paths


# -- path expressions --------------------------------------------------------

_AXES = {
    "child": CHILD, "descendant": DOWN, "descendant-or-self": DOWN_OR_SELF, "self": SELF, "parent": UP, "ancestor": UPPER,
    "ancestor-or-self": UPPER_OR_SELF, "following-sibling": AFTER, "preceding-sibling": BEFORE, "following": FOLLOWING, "preceding": PRECEDING,
}
_STEP = re.compile(r"(?:(?P<axis>[a-z-]+)::)?(?P<test>@[\w:*-]+|[\w:-]+\(\)|\.\.|\.|\*|[\w:-]+)\s*(?P<predicates>(?:\[.*\])?)\s*", re.S)
_COMPARED = re.compile(r"(.+?)\s*(!=|<=|>=|=|<|>)\s*(?:\"([^\"]*)\"|'([^']*)'|(-?\d+(?:\.\d+)?))", re.S)
_CALL = re.compile(r"(contains|starts-with)\(\s*(.+?)\s*,\s*(?:\"([^\"]*)\"|'([^']*)')\s*\)", re.S)
_PLACE = re.compile(r"(?:position\(\)\s*(=|!=|<=|>=|<|>)\s*)?(?:(\d+)|last\(\)(?:\s*-\s*(\d+))?)")


def _predicates(source: str) -> list[str]:
    out, depth, piece, quote = [], 0, "", ""
    for c in source:
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "[":
            depth += 1
            if depth == 1:
                continue
        elif c == "]":
            depth -= 1
            if not depth:
                out.append(piece.strip())
                piece = ""
                continue
        piece += c if depth else ""
    if depth or quote:
        raise Unsupported(f"predicate {source}")
    return out


def _place(source: str) -> dict | None:
    """The test for a predicate on the place: how to compare (``name``), with what; ``last`` counts from the end."""
    m = _PLACE.fullmatch(source)
    if not m:
        return None
    return test(NODE, "place", m[1] or "=", m[2]) if m[2] else test(NODE, "place_last", m[1] or "=", m[3] or "0")


def _any(conditions: list[list[dict]]) -> list[dict]:
    return conditions[0] if len(conditions) == 1 else [leads([[hop(SELF, ANY, c)] for c in conditions])]


def _ending(hops: list[dict], more: list[dict]) -> dict:
    """The test that ``hops`` lead to a node with ``more`` tests."""
    last = hops[-1] if hops else hop(SELF, ANY)
    return leads([[*hops[:-1], {**last, "tests": last["tests"] + more}]])


def _compared(operand: str, kind: str, value: str) -> list[dict]:
    """Tests of a node for a comparison of an attribute, its text or what a path leads to."""
    operand = operand.strip()
    if m := re.fullmatch(r"normalize-space\(\s*(.*?)\s*\)", operand):
        if m[1] not in ("", ".", "text()"):
            raise Unsupported(f"comparison of {operand}")
        return [test(WORDS, kind, value=value)]
    if m := re.fullmatch(r"@([\w:-]+)", operand):
        return [test(ATTRIBUTE, kind, m[1].lower(), value)]
    if operand in ("text()", "."):
        return [test(OWN if operand == "text()" else TEXT, kind, value=value)]
    if "(" in operand:
        raise Unsupported(f"comparison of {operand}")
    hops, reader, name = _location(operand, False)
    last = {"node": ".", "texts": "text()", "every_attr": f"@{name}"}[reader]
    return [_ending(hops, _compared(last, kind, value))]


def _condition(source: str) -> list[dict]:
    """Tests that together stand for a predicate."""
    source = source.strip()
    if len(parts := _words(source, "or")) > 1:
        return _any([_condition(p) for p in parts])
    if len(parts := _words(source, "and")) > 1:
        return [t for p in parts for t in _condition(p)]
    if source.startswith("not(") and _argument(source, 3)[1] == len(source):
        return [leads([[hop(SELF, ANY, _condition(source[4:-1]))]], False)]
    if source.startswith("(") and _argument(source, 0)[1] == len(source):
        return _condition(source[1:-1])
    if m := _CALL.fullmatch(source):
        value = m[3] if m[3] is not None else m[4]
        return _compared(m[2], "*=" if m[1] == "contains" else "^=", value)
    if m := _COMPARED.fullmatch(source):
        value = next(v for v in m.groups()[2:] if v is not None)
        return _compared(m[1], m[2], value)
    hops, reader, name = _location(source, False)
    there = {"node": [], "texts": [test(OWN, "!=")], "every_attr": [test(ATTRIBUTE, "has", name or "")]}[reader]
    return there if not hops and there else [_ending(hops, there)]


def _tests(predicates: list[str], axis: int, tag: str) -> tuple[list[dict], list[dict], list[dict]]:
    """(tests, places, tests after them): a number that comes first among children is an ordinal of the node itself."""
    tests, places, after = [], [], []
    for p in predicates:
        place = _place(p)
        of = "nth" if tag == ELEMENT else "nth_type"
        if place and not tests and not places and axis in (CHILD, DOWN, DOWN_OR_SELF) and place["name"] == "=":
            n = int(place["value"])
            tests.append(ordinal(of, 0, n) if place["kind"] == "place" else ordinal(of + "_last", 0, n + 1))
        elif place and not after:
            places.append(place)
        elif place:
            raise Unsupported(f"position after {predicates}")
        else:
            (after if places else tests).extend(_condition(p))
    return tests, places, after


def _location(source: str, rule: bool) -> tuple[list[dict], str, str | None]:
    """(hops, reader, attribute) of one location path; in a ``rule`` the first ``//`` takes the element itself in too."""
    source = source.strip()
    if source.startswith("./"):
        source = source[1:]
    pieces = outside(source, "/")[::2]
    if pieces and not pieces[0].strip() and len(pieces) > 1:
        pieces = pieces[1:]
    hops, reader, name, deep = [], "node", None, False
    if source.startswith("//"):
        pieces, deep = pieces[1:], True
    for k, piece in enumerate(pieces):
        if not piece.strip():
            if deep or k == len(pieces) - 1:
                raise Unsupported(f"xpath {source}")
            deep = True
            continue
        m = _STEP.fullmatch(piece.strip())
        if not m or reader != "node":
            raise Unsupported(f"xpath {source}")
        first, what = not hops and rule, m["test"]
        if m["axis"] == "attribute":
            what = "@" + what
        elif m["axis"] and m["axis"] not in _AXES:
            raise Unsupported(f"axis {m['axis']}")
        if what.startswith("@") or what == "text()":
            if m["predicates"] or what == "@*" or (m["axis"] and m["axis"] != "attribute"):
                raise Unsupported(f"xpath {source}")
            reader, name = ("texts", None) if what == "text()" else ("every_attr", what[1:].lower())
            if deep:
                hops.append(hop(DOWN_OR_SELF, ANY if reader == "texts" else ELEMENT))
            continue
        if what.endswith("()") and what != "node()":
            raise Unsupported(f"xpath {source}")
        axis = {".": SELF, "..": UP}.get(what, _AXES[m["axis"] or "child"])
        tag = {".": ANY, "..": ANY, "node()": ANY}.get(what, what.lower())
        tests, places, after = _tests(_predicates(m["predicates"]), axis, tag)
        if axis == SELF and tag == ANY and not (tests or places):
            if deep:
                hops.append(hop(DOWN_OR_SELF, ANY))
        elif deep and axis == CHILD and not places:
            hops.append(hop(DOWN_OR_SELF if first else DOWN, tag, tests))
        else:
            if deep:
                hops.append(hop(DOWN_OR_SELF, ANY))
            hops.append(hop(axis, tag, tests, places))
            if after:
                hops.append(hop(SELF, ANY, after))
        deep = False
    return hops, reader, name


def xpath_paths(source: str) -> tuple[list[list[dict]], str, str | None]:
    """(paths, reader, attribute) of an expression; the paths of a union are read alike and merged in document order."""
    source = source.strip()
    source = source[1:] if source.startswith(("./", ".//")) else source
    found = [_location(p, True) for p in outside(source, "|")[::2]]
    if len({f[1:] for f in found}) > 1:
        raise Unsupported(f"union of unlike parts {source}")
    for path, _, _ in found:
        _fitting(path, source)
    return [f[0] for f in found], found[0][1], found[0][2]


# -- JSON paths --------------------------------------------------------------

_JSON_STEP = re.compile(r"\s*(?:(?P<deep>\.\.)|(?P<dot>\.))?(?:(?P<name>\*|[\w$@#-]+)|(?P<open>\[))?", re.S)
_JSON_COMPARED = re.compile(r"(.+?)\s*(==|=|!=|<=|>=|<|>|=~)\s*(?:\"([^\"]*)\"|'([^']*)'|(-?\d+(?:\.\d+)?|true|false))", re.S)


def _json_condition(source: str) -> list[dict]:
    """Tests for a filter: ``@.a.b`` exists, or compares with a literal; joined by && and ||."""
    for sign, join in (("||", _any), ("&&", lambda parts: [t for p in parts for t in p])):
        at, depth, quote, parts, start = 0, 0, "", [], 0
        while at < len(source):
            c = source[at]
            if quote:
                quote = "" if c == quote else quote
            elif c in "\"'":
                quote = c
            elif c in "([":
                depth += 1
            elif c in ")]":
                depth -= 1
            elif not depth and (source.startswith(sign, at) or (sign == "&&" and c == "&")):
                parts.append(source[start:at])
                at += 2 if source.startswith(sign, at) else 1
                start = at
                continue
            at += 1
        if parts:
            return join([_json_condition(p) for p in [*parts, source[start:]]])
    source = source.strip()
    if source.startswith("(") and _argument(source, 0)[1] == len(source):
        return _json_condition(source[1:-1])
    if source.startswith("!"):
        return [leads([[hop(SELF, ANY, _json_condition(source[1:]))]], False)]
    m = _JSON_COMPARED.fullmatch(source)
    operand = (m[1] if m else source).strip()
    if not operand.startswith("@") or (m and m[2] == "=~"):
        raise Unsupported(f"json filter {source}")
    hops = json_hops("$" + operand[1:])
    if not m:
        return [leads([hops])] if hops else []
    value = next(v for v in m.groups()[2:] if v is not None)
    equal = "==" if m[5] and m[5][-1].isdigit() else "="
    return [_ending(hops, [test(TEXT, equal if m[2] in ("==", "=") else m[2], value=value)])]


def _json_bracket(inner: str, axis: int, source: str) -> dict:
    inner = inner.strip()
    if inner == "*":
        return hop(axis, ELEMENT)
    if inner.startswith("?"):
        return hop(axis, ELEMENT, _json_condition(inner[1:]))
    pieces = [p.strip() for p in outside(inner, ",")[::2]]
    if all(re.fullmatch(r"\"[^\"]*\"|'[^']*'", p) for p in pieces):
        names = [MEMBER + p[1:-1] for p in pieces]
        if len(names) == 1:
            return hop(axis, names[0])
        return hop(axis, ELEMENT, [leads([[hop(SELF, n)] for n in names])])
    tests = []
    for p in pieces:
        if m := re.fullmatch(r"-?\d+", p):
            n = int(p)
            tests.append(ordinal("nth", 0, n + 1) if n >= 0 else ordinal("nth_last", 0, -n))
        elif m := re.fullmatch(r"(-?\d*)\s*:\s*(-?\d*)\s*(?::\s*(\d*))?", p):
            if m[3] == "0":
                raise Unsupported(f"json path {source}")
            tests.append(test(NODE, "slice", f"{m[1]}:{m[2]}", m[3] or "1"))
        else:
            raise Unsupported(f"json path {source}")
    return hop(axis, ITEM, _any([[t] for t in tests]))


def json_hops(source: str) -> list[dict]:
    """The hops of a JSON path over the nodes of a parsed document."""
    source = source.strip()
    path = source[1:] if source.startswith("$") else source if source.startswith("[") else "." + source
    hops, at = [], 0
    while at < len(path):
        m = _JSON_STEP.match(path, at)
        if not m or m.end() == at or not (m["name"] or m["open"]) or (m["name"] and not (m["deep"] or m["dot"])):
            raise Unsupported(f"json path {source}")
        axis, at = (DOWN if m["deep"] else CHILD), m.end()
        if m["name"]:
            hops.append(hop(axis, ELEMENT if m["name"] == "*" else MEMBER + m["name"]))
            continue
        depth, quote, start = 1, "", at
        while at < len(path) and depth:
            c = path[at]
            if quote:
                quote = "" if c == quote else quote
            elif c in "\"'":
                quote = c
            elif c in "[]":
                depth += 1 if c == "[" else -1
            at += 1
        if depth:
            raise Unsupported(f"json path {source}")
        hops.append(_json_bracket(path[start:at - 1], axis, source))
    return _fitting(hops, source)
