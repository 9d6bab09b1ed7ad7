"""Rule strings as data: what to select, what to read from it, how to clean it.

A rule set is a table, and so are its compiled rules: nested values in columns
that one fixed Spark expression (``operators.extract``) evaluates for any
number of sources. Compilation runs once per rule set, never per page.
"""

from __future__ import annotations

import contextlib
import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioweave.functions.patterns import java_pattern, java_replacement, pattern_ok, python_ok
from folioweave.functions.selectors import ATTRIBUTE, CHILD, DOWN, HOP, OWN, Unsupported, css_paths, hop, json_hops, outside, test, xpath_paths

SPAN = "STRUCT<single: BOOLEAN, lo: INT, hi: INT, stride: INT>"
STEP = f"STRUCT<paths: ARRAY<ARRAY<{HOP}>>, exclude: BOOLEAN, spans: ARRAY<{SPAN}>>"
ALT = f"STRUCT<steps: ARRAY<{STEP}>, reader: STRING, name: STRING, json: ARRAY<{STEP}>>"
PART = f"STRUCT<kind: STRING, text: STRING, mode: STRING, op: STRING, alts: ARRAY<{ALT}>>"
RULE = (
    f"STRUCT<parts: ARRAY<{PART}>, patterns: ARRAY<STRING>, groups: INT, clean: STRING, literal: STRING, replacement: STRING, "
    "first: BOOLEAN, reverse: BOOLEAN, unsupported: STRING>"
)
FIELD = f"STRUCT<name: STRING, rule: {RULE}>"

#: What the names of fields begin with that hold variables.
PUT = "@put:"

_READERS = {"text", "textNodes", "ownText", "html", "all"}
_SCRIPT = re.compile(r"@js:|<js>", re.I)
_TEMPLATE = re.compile(r"@get:\{([^}]+)\}|\{\{(.*?)\}\}|\$(\d{1,2})", re.I | re.S)
_PUT = re.compile(r"@put:(\{[^}]+\})", re.I)

# -- selector steps with index -----------------------------------------------

_NEW_INDEX = re.compile(r"^(.*?)\[\s*(!?)\s*([-\d:,\s]+)\]$", re.S)
_OLD_INDEX = re.compile(r"^(.*?)([.!])\s*(-?\d+(?:\s*:\s*-?\d+)*)$", re.S)


def _span(text: str) -> dict:
    bounds = [int(b) if b.strip() else None for b in text.replace(" ", "").split(":")]
    if len(bounds) == 1:
        return {"single": True, "lo": bounds[0], "hi": None, "stride": 1}
    return {"single": False, "lo": bounds[0], "hi": bounds[1], "stride": bounds[2] if len(bounds) > 2 else 1}


def selector_step(source: str) -> dict:
    """One step of a default rule: a selector with an optional index suffix."""
    source = source.strip()
    exclude, spans = None, []
    if m := _NEW_INDEX.match(source):
        source, exclude = m[1].strip(), m[2] == "!"
        spans = [_span(s) for s in m[3].split(",") if s.strip()]
    elif m := _OLD_INDEX.match(source):
        source, exclude = m[1].strip(), m[2] == "!"
        spans = [_span(s) for s in re.sub(r"\s", "", m[3]).split(":")]
    elif re.search(r"[.:!]$", source):
        raise Unsupported(f"index without number in {source}")
    kind, _, name = source.partition(".")
    if source in ("", "children"):
        only = hop(CHILD)
    elif kind == "tag" and name:
        only = hop(DOWN, name.lower())
    elif kind == "class" and name:
        only = hop(DOWN, tests=[test(ATTRIBUTE, "class", "class", name)])
    elif kind == "id" and name:
        only = hop(DOWN, tests=[test(ATTRIBUTE, "=", "id", name)])
    elif kind == "text" and name:
        only = hop(DOWN, tests=[test(OWN, "*=", value=name)])
    else:
        return {"paths": css_paths(source), "exclude": exclude, "spans": spans}
    return {"paths": [[only]], "exclude": exclude, "spans": spans}


def _plain_step(paths: list) -> dict:
    return {"paths": paths, "exclude": None, "spans": []}


def _alt(steps=None, reader=None, name=None, json=None) -> dict:
    return {"steps": steps or [], "reader": reader, "name": name, "json": json}


def _reader(source: str) -> tuple[str, str | None]:
    source = source.strip()
    return (source, None) if source in _READERS else ("attr", source.lower())


def html_alt(source: str, strings: bool) -> dict:
    source = source.strip()
    if source[:5].upper() == "@CSS:":
        selector = source[5:].strip()
        if not strings:
            return _alt([_plain_step(css_paths(selector))])
        selector, _, last = selector.rpartition("@")
        return _alt([_plain_step(css_paths(selector))], *_reader(last))
    pieces = [p for p in outside(source, "@")[::2]]
    if not strings:
        return _alt([selector_step(p) for p in pieces if p.strip()])
    return _alt([selector_step(p) for p in pieces[:-1] if p.strip()], *_reader(pieces[-1]))


def xpath_alt(source: str) -> dict:
    paths, reader, name = xpath_paths(source)
    return _alt([_plain_step(paths)] if any(paths) else [], reader, name)


def json_steps(source: str) -> list[dict]:
    return [_plain_step([json_hops(source)])]


# -- whole rules -------------------------------------------------------------


def _split_alternatives(source: str) -> tuple[str, list[str]]:
    """Parts of a rule and what joins them; the first joiner that stands outside brackets and quotes decides."""
    # Signs stand at odd places; a joiner is two of a kind with nothing in between.
    op, pieces, out, k = "", outside(source, "&|%"), [""], 0
    while k < len(pieces):
        piece = pieces[k]
        double = k % 2 == 1 and pieces[k + 1:k + 3] == ["", piece]
        if double and op in ("", piece * 2):
            op = piece * 2
            out.append("")
            k += 3
        else:
            out[-1] += piece
            k += 1
    return (op, [p for p in out if p.strip()]) if op else ("", [source])


def _part(source: str, strings: bool) -> dict:
    upper = source.upper()
    if upper.startswith("@XPATH:") or source.startswith("/"):
        mode, body = "xpath", source[7:] if upper.startswith("@XPATH:") else source
    elif upper.startswith("@JSON:") or source.startswith(("$.", "$[")):
        mode, body = "json", source[6:] if upper.startswith("@JSON:") else source
    elif upper.startswith("@CSS:") or source.startswith("@@"):
        mode, body = "html", source.removeprefix("@@")
    else:
        mode, body = "auto", source
    css = body[:5].upper() == "@CSS:"
    op, pieces = _split_alternatives(body[5:] if css else body)
    alts = [_alternative("@CSS:" + p if css else p, mode, strings) for p in pieces]
    return {"kind": "rule", "text": None, "mode": mode, "op": op, "alts": alts}


def _alternative(source: str, mode: str, strings: bool) -> dict:
    """One alternative of a rule; what cannot be read finds nothing, and says so in ``refused``."""
    try:
        if mode == "xpath":
            return xpath_alt(source)
        if mode == "json":
            return _alt(reader="json", json=json_steps(source))
        alt = html_alt(source, strings)
    except Unsupported as error:
        return {**_alt([_plain_step([])], "text"), "refused": str(error)}
    if mode == "auto":
        with contextlib.suppress(Unsupported):
            alt["json"] = json_steps(source)
    return alt


def _fixed(kind: str, text: str) -> dict:
    return {"kind": kind, "text": text, "mode": None, "op": None, "alts": []}


def _is_rule(text: str) -> bool:
    return text.startswith(("@", "$.", "$[", "//"))


def _template(source: str, stored: dict[str, str]) -> list[dict]:
    parts, at = [], 0
    for m in _TEMPLATE.finditer(source):
        if m.start() > at:
            parts.append(_fixed("literal", source[at:m.start()]))
        at = m.end()
        if m[3]:
            parts.append(_fixed("group", m[3]))
            continue
        name = (m[1] or m[2]).strip()
        if m[1] and name in stored:
            name = stored[name]
            parts.append(_part(name, True))
        elif m[2] and _is_rule(name):
            parts.append(_part(name, True))
        elif re.fullmatch(r"\w+", name):
            parts.append(_fixed("variable", name))
        else:
            raise Unsupported(f"script in template {name}")
    if at < len(source):
        parts.append(_fixed("literal", source[at:]))
    return parts


_EMPTY = {
    "parts": [], "patterns": None, "groups": None, "clean": None, "literal": None, "replacement": None, "first": False,
    "reverse": False, "unsupported": None,
}


def compile_rule(source: str | None, elements: bool = False, stored: dict[str, str] | None = None) -> dict | None:
    """A rule as nested values; null for no rule. What cannot run here is said in ``unsupported``."""
    if not source or not source.strip():
        return None
    rule = dict(_EMPTY)
    try:
        if _SCRIPT.search(source):
            raise Unsupported("script")
        source = _PUT.sub("", source).strip()
        if elements:
            rule["reverse"] = source.startswith("-")
            source = source.removeprefix("-").removeprefix("+")
            if source.startswith(":"):
                patterns = source[1:].split("&&")
                if not all(map(pattern_ok, patterns)):
                    raise Unsupported(f"pattern {source}")
                rule["patterns"] = [java_pattern(p, dotall=True) for p in patterns]
                rule["groups"] = re.compile(patterns[-1]).groups
                return rule
        body, *cleaning = source.split("##")
        if cleaning:
            pattern = cleaning[0]
            ok = pattern_ok(pattern)
            if not ok and python_ok(pattern):
                raise Unsupported(f"pattern {pattern}")
            rule["clean"] = java_pattern(pattern, dotall=True) if ok and pattern else None
            rule["literal"] = None if ok else pattern
            raw = cleaning[1] if len(cleaning) > 1 else ""
            rule["first"] = len(cleaning) > 2
            try:
                rule["replacement"] = java_replacement(raw, pattern) if ok and not rule["first"] else raw
            except ValueError:
                raise Unsupported(f"replacement {raw}") from None
        if not elements and _TEMPLATE.search(body):
            rule["parts"] = _template(body, stored or {})
        elif body.strip():
            rule["parts"] = [_part(body.strip(), not elements)]
    except Unsupported as error:
        return {**_EMPTY, "unsupported": str(error)}
    refused = [alt["refused"] for part in rule["parts"] for alt in part["alts"] if "refused" in alt]
    rule["unsupported"] = "; ".join(refused) or None
    return rule


def stored_rules(rules: dict[str, str | None]) -> dict[str, str]:
    """Variables that rules of a group set (``@put``), with the rule that gives their value."""
    stored: dict[str, str] = {}
    for source in rules.values():
        for text in _PUT.findall(source or ""):
            try:
                stored.update({str(k): str(v) for k, v in json.loads(text).items()})
            except ValueError:
                continue
    return stored


def compiled_group(list_field: str | None, group) -> dict:
    rules = group.asDict() if group is not None else {}
    list_rule = rules.pop(list_field, None) if list_field else None
    stored = stored_rules(rules)
    # What the rules set for later stages is read like a field.
    named = {**rules, **{PUT + n: r for n, r in stored.items()}}
    compiled = [{"name": n, "rule": compile_rule(r, stored=stored)} for n, r in named.items()]
    return {
        "list": compile_rule(list_rule, elements=True),
        "fields": [f for f in compiled if f["rule"] is not None],
    }


def compile_group(list_field: str | None, group: Column) -> Column:
    """One rule group of a rule set: its list rule and its field rules. Runs once per rule set."""
    return F.udf(compiled_group, f"STRUCT<list: {RULE}, fields: ARRAY<{FIELD}>>", useArrow=False)(F.lit(list_field), group)
