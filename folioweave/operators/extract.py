"""Extraction: pages and compiled rules in, records out, in one Spark expression.

The rules of a source arrive as columns (``functions.rules``), so the plan is
the same for one source or thousands. Each page is parsed once, all fields of
all its elements are read inside the row, and only the small records leave it:
neither the body nor the node array is exploded or shuffled.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Sequence
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioweave.functions import selectors as sel
from folioweave.functions import text as tx
from folioweave.functions import urls
from folioweave.functions.binding import bound
from folioweave.functions.lists import positions_of
from folioweave.functions.markup import NODES, page_nodes
from folioweave.functions.patterns import java_pattern, pattern_ok, required_text
from folioweave.functions.rules import PUT, compile_group

_STRINGS = "array<string>"
_ELEMENT = "struct<node: int, groups: array<string>>"


# -- selection ---------------------------------------------------------------


def _number(text: Column) -> Column:
    return text.try_cast("double")


def _passes(nodes: Column, node: Column, test: Column, level: int) -> Column:
    kind, of, value = test["kind"], test["of"], test["value"]
    subject = (
        F.when(of == sel.ATTRIBUTE, F.try_element_at(node["attrs"], test["name"]))
        .when(of == sel.OWN, tx.strip(node["own"]))
        .when(of.isin(sel.TEXT, sel.WORDS), bound(F.coalesce(node["text"], F.array_join(_texts(nodes, node["i"]), "")), lambda text: F.when(
            of == sel.TEXT, text).otherwise(F.regexp_replace(tx.strip(text), r"\s+", " "))))
    )

    def compared(s: Column) -> Column:
        """Numbers by size, other text by code points; negative, zero or positive."""
        return F.coalesce(F.signum(_number(s) - _number(value)), F.when(s < value, -1.0).when(s == value, 0.0).otherwise(1.0))

    def agrees(s: Column) -> Column:
        words = F.array_contains(F.split(s, r"\s+"), value)
        return (
            F.when(kind == "=", s == value).when(kind == "~=", words).when(kind == "class", (s == value) | words).when(kind == "has", s.isNotNull())
            .when(kind == "^=", s.startswith(value)).when(kind == "$=", s.endswith(value)).when(kind == "*=", F.contains(s, value))
            .when(kind == "|=", (s == value) | s.startswith(F.concat(value, F.lit("-")))).when(kind == "!=", s != value)
            .when(s.isNotNull(), bound(compared(s), lambda c: F.when(kind == "==", c == 0).when(kind == "<", c < 0).when(
                kind == "<=", c <= 0).when(kind == ">", c > 0).when(kind == ">=", c >= 0)))
        )

    def counted(n: Column) -> Column:
        step, ahead = test["name"].cast("int"), n - value.cast("int")
        return F.when(step == 0, ahead == 0).otherwise((ahead % F.nullif(F.abs(step), F.lit(0)) == 0) & (ahead * F.signum(step) >= 0))

    ordinal = F.when(of == "nth", node["nth"]).when(of == "nth_last", node["nth_last"]).when(of == "nth_type", node["nth_type"]).otherwise(node["nth_type_last"])
    passed = F.when(of.isin(sel.ATTRIBUTE, sel.OWN, sel.TEXT, sel.WORDS), bound(subject, agrees)).when(kind == "an+b", bound(ordinal, counted))
    if level:
        reached = F.exists(test["paths"], lambda path: F.size(_walk(nodes, node["i"], path, level - 1, False)) > 0)
        passed = passed.when(kind.isin("with", "without"), reached == (kind == "with"))
    passed = passed.when(kind == "empty", node["last"] == node["i"]).when(kind == "root", node["up"] == 0).when(kind == "slice", _in_slice(node, test))
    return F.coalesce(passed, F.lit(False))


def _number(text: Column) -> Column:
    return text.try_cast("double")


def _in_slice(node: Column, test: Column) -> Column:
    size = node["nth"] + node["nth_last"] - 1
    ends = F.transform(F.split(test["name"], ":"), lambda e: F.nullif(e, F.lit("")).cast("int"))
    placed = bound(ends, lambda e: F.transform(e, lambda n, k: F.greatest(F.lit(0), F.when(n < 0, n + size).when(n.isNull() & (k == 0), 0).when(n.isNull(), size).otherwise(n))))
    ahead = lambda p: node["nth"] - 1 - F.get(p, F.lit(0))
    return bound(placed, lambda p: (ahead(p) >= 0) & (node["nth"] - 1 < F.get(p, F.lit(1))) & (ahead(p) % test["value"].cast("int") == 0))


def _in_place(test: Column, k: Column, size: Column) -> Column:
    """Whether the k-th of ``size`` nodes (from 0) has the place a test asks for."""
    wanted = F.when(test["kind"] == "place", test["value"].cast("int")).otherwise(size - test["value"].cast("int"))
    place, how = k + 1, test["name"]
    return (
        F.when(how == "=", place == wanted).when(how == "!=", place != wanted).when(how == "<", place < wanted)
        .when(how == "<=", place <= wanted).when(how == ">", place > wanted).otherwise(place >= wanted)
    )


def _subtree(nodes: Column, i: Column) -> Column:
    """Node ``i`` and its descendants: one slice, as nodes are in document order."""
    return F.slice(nodes, i + 1, F.get(nodes, i)["last"] - i + 1)


def _hop(nodes: Column, context: Column, hop: Column, level: int, counts: bool) -> Column:
    """The nodes one hop leads to. An axis is an interval of places and, for some, a condition on parent or last descendant."""
    axis = hop["axis"]

    def interval(x: Column) -> Column:
        parent_last = F.get(nodes, x["up"])["last"]
        low = (
            F.when(axis.isin(sel.DOWN, sel.CHILD), x["i"] + 1).when(axis.isin(sel.DOWN_OR_SELF, sel.SELF), x["i"])
            .when(axis.isin(sel.NEXT, sel.AFTER, sel.FOLLOWING), x["last"] + 1).when(axis == sel.UP, x["up"])
            .when(axis.isin(sel.BEFORE, sel.PREVIOUS), x["up"] + 1).otherwise(F.lit(0))
        )
        high = (
            F.when(axis.isin(sel.DOWN, sel.CHILD, sel.DOWN_OR_SELF), x["last"]).when(axis.isin(sel.SELF, sel.UPPER_OR_SELF), x["i"])
            .when(axis.isin(sel.NEXT, sel.AFTER), parent_last).when(axis == sel.UP, x["up"])
            .when(axis == sel.FOLLOWING, F.size(nodes) - 1).otherwise(x["i"] - 1)
        )
        return bound(F.struct(low.alias("low"), (high - low + 1).alias("n")), lambda r: F.slice(
            nodes, F.greatest(r["low"], F.lit(0)) + 1, F.when(r["low"] >= 0, F.greatest(r["n"], F.lit(0))).otherwise(0)))

    def from_one(i: Column) -> Column:
        def found(x: Column) -> Column:
            def fits(n: Column) -> Column:
                # What rules most nodes out at least cost comes first.
                tag = (n["tag"] == hop["tag"]) | (hop["tag"].startswith(sel.ELEMENT) & (
                    ~n["tag"].startswith("#") | ((hop["tag"] == sel.ANY) & (n["tag"] == "#page"))))
                beside = (n["up"] == x["up"]) & (x["up"] >= 0)
                there = (axis <= sel.FOLLOWING) | (
                    F.when(axis == sel.CHILD, n["up"] == x["i"]).when(axis.isin(sel.AFTER, sel.BEFORE), beside)
                    .when(axis == sel.NEXT, beside & (n["nth"] == x["nth"] + 1)).when(axis == sel.PREVIOUS, beside & (n["nth"] == x["nth"] - 1))
                    .when(axis.isin(sel.UPPER, sel.UPPER_OR_SELF), n["last"] >= x["last"]).otherwise(n["last"] < x["i"])
                )
                return tag & there & F.forall(hop["tests"], lambda t: _passes(nodes, n, t, level))

            return F.transform(F.filter(interval(x), fits), lambda n: n["i"])

        reached = bound(F.get(nodes, i), found)
        return bound(reached, counted) if counts else reached

    def counted(reached: Column) -> Column:
        """Tests of places, one after the other; some axes count backwards."""
        def one(left: Column, test: Column) -> Column:
            return bound(left, lambda held: F.filter(held, lambda _, k: _in_place(test, k, F.size(held))))

        ordered = F.when(axis.isin(*sel.BACKWARDS), F.reverse(reached)).otherwise(reached)
        return F.when(F.size(hop["places"]) == 0, reached).otherwise(F.aggregate(hop["places"], ordered, one))

    return F.array_distinct(F.flatten(F.transform(context, from_one)))


def _walk(nodes: Column, start: Column, path: Column, level: int, counts: bool = True) -> Column:
    """The nodes a path leads to: tests may hold paths of their own ``level`` deep, and places count where ``counts`` says so."""
    return F.aggregate(path, F.array(start), lambda context, hop: _hop(nodes, context, hop, level, counts))


def _picked(found: Column, step: Column) -> Column:
    size = F.size(found)

    def chosen(wanted: Column) -> Column:
        return F.when(step["exclude"], F.filter(found, lambda _, i: ~F.array_contains(wanted, i))).otherwise(
            F.transform(wanted, lambda i: F.get(found, i))
        )

    wanted = positions_of(step["spans"], size)
    return F.when(step["exclude"].isNull() | (size == 0), found).otherwise(bound(wanted, chosen))


def select_nodes(nodes: Column, steps: Column, start: Column, level: int = sel.NESTED) -> Column:
    """Positions of the nodes the steps lead to from node ``start``; ``level`` is how deep tests in the steps nest."""

    def path_nodes(x: Column, paths: Column) -> Column:
        found = F.transform(paths, lambda path: _walk(nodes, x, path, level))
        return F.array_sort(F.array_distinct(F.flatten(found)))

    def one_step(context: Column, step: Column) -> Column:
        return F.flatten(F.transform(context, lambda x: bound(
            path_nodes(x, step["paths"]), lambda found: _picked(found, step))))

    return F.aggregate(steps, F.array(start), one_step)


# -- reading -----------------------------------------------------------------


def _texts(nodes: Column, i: Column) -> Column:
    """Text pieces under a node; the inside of scripts and styles counts only for themselves."""
    inside = F.filter(_subtree(nodes, i), lambda n: (n["tag"] == "#text") | ((n["tag"] == "#raw") & (n["up"] == i)))
    return F.transform(inside, lambda n: n["text"])


def _opens(body: Column, node: Column) -> Column:
    """The first character of a JSON node."""
    return F.substring(body, node["begin"] + 1, F.lit(1))


def _items(nodes: Column, body: Column, found: Column) -> Column:
    """JSON nodes; a list that is found alone stands for its items."""
    def of_list(i: Column) -> Column:
        items = F.transform(F.filter(_subtree(nodes, i), lambda n: n["up"] == i), lambda n: n["i"])
        return F.when(_opens(body, F.get(nodes, i)) == "[", items)

    return bound(found, lambda f: F.coalesce(F.when(F.size(f) == 1, of_list(F.get(f, F.lit(0)))), f))


def read_nodes(nodes: Column, body: Column, found: Column, reader: Column, name: Column) -> Column:
    """Strings read off nodes: text in several forms, markup, or an attribute."""
    return bound(found, lambda bound_found: _read(nodes, body, bound_found, reader, name))


def _read(nodes: Column, body: Column, found: Column, reader: Column, name: Column) -> Column:
    def outer(i: Column) -> Column:
        node = F.get(nodes, i)
        return F.substring(body, node["begin"] + 1, node["end"] - node["begin"])

    def each(fn) -> Column:
        return F.filter(F.transform(found, fn), lambda s: F.coalesce(s != "", F.lit(False)))

    def json_value(i: Column) -> Column:
        return bound(F.get(nodes, i), lambda n: F.coalesce(n["text"], F.when(_opens(body, n).isin("[", "{"), outer(i))))

    def attribute(i: Column) -> Column:
        return F.try_element_at(F.get(nodes, i)["attrs"], name)

    pieces = lambda i: F.transform(_texts(nodes, i), tx.strip)
    direct = F.flatten(F.transform(found, lambda i: F.transform(
        F.filter(_subtree(nodes, i), lambda n: (n["up"] == i) & (n["tag"] == "#text")), lambda n: n["text"]
    )))
    return (
        F.when(reader == "text", each(lambda i: F.array_join(pieces(i), " ")))
        .when(reader == "attr", F.array_distinct(each(attribute)))
        .when(reader == "textNodes", each(lambda i: F.array_join(pieces(i), "\n")))
        .when(reader == "ownText", each(lambda i: tx.strip(F.get(nodes, i)["own"])))
        .when(reader == "html", each(
            lambda i: F.regexp_replace(outer(i), r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", "")))
        .when(reader == "all", each(outer))
        .when(reader == "every_attr", F.filter(F.transform(found, attribute), lambda s: s.isNotNull()))
        .when(reader == "texts", direct)
        .when(reader == "json", F.filter(F.transform(_items(nodes, body, found), json_value), lambda s: s.isNotNull()))
        .otherwise(F.transform(found, lambda i: F.array_join(_texts(nodes, i), "")))
    )


def _combined(lists: Column, op: Column) -> Column:
    """Lists joined by ``&&``, first non-empty by ``||``, in turn by ``%%``; the first list sets the rounds."""
    return bound(lists, lambda named: _combine(named, op))


def _combine(lists: Column, op: Column) -> Column:
    rounds = F.get(lists, F.lit(0))
    by_turn = F.flatten(F.transform(rounds, lambda _, k: F.flatten(
        F.transform(lists, lambda items: F.when(k < F.size(items), F.slice(items, k + 1, F.lit(1)))
                    .otherwise(F.slice(items, F.lit(1), F.lit(0))))
    )))
    filled = F.filter(lists, lambda items: F.size(items) > 0)
    return (
        F.when(op == "%%", by_turn)
        .when(op == "||", F.when(F.size(filled) > 0, F.get(filled, F.lit(0))).otherwise(F.get(lists, F.lit(0))))
        .otherwise(F.flatten(lists))
    )


class Page:
    """Columns of one parsed page, and the expressions that read it."""

    def __init__(self, body: Column, nodes: Column, is_json: Column, variables: Column, level: int):
        self.body, self.nodes, self.is_json, self.variables, self.level = body, nodes, is_json, variables, level

    def _reads_json(self, part: Column) -> Column:
        return (part["mode"] == "json") | ((part["mode"] == "auto") & self.is_json)

    def _found(self, part: Column, alt: Column, start: Column) -> Column:
        """Places an alternative leads to; rules for pages find nothing in documents, and the other way round."""
        reads_json = self._reads_json(part)
        steps = F.when(reads_json, alt["json"]).otherwise(alt["steps"])
        return F.coalesce(F.when(reads_json == self.is_json, select_nodes(self.nodes, steps, start, self.level)), F.array().cast("array<int>"))

    def elements(self, rule: Column) -> Column:
        """Elements a list rule finds on the page."""

        def of_part(part: Column) -> Column:
            def of_alt(alt: Column) -> Column:
                found = bound(self._found(part, alt, F.lit(0)), lambda f: F.when(self.is_json, _items(self.nodes, self.body, f)).otherwise(f))
                return F.transform(found, lambda i: F.struct(i.alias("node"), F.lit(None).cast(_STRINGS).alias("groups")))

            return _combined(F.transform(part["alts"], of_alt), part["op"])

        empty = F.array().cast(f"array<{_ELEMENT}>")
        return F.coalesce(
            F.when(rule["patterns"].isNotNull(), self._regex_elements(rule["patterns"], rule["groups"]))
            .when(F.size(rule["parts"]) > 0, of_part(F.get(rule["parts"], F.lit(0)))),
            empty,
        )

    def _regex_elements(self, patterns: Column, count: Column) -> Column:
        narrowed = F.aggregate(
            F.slice(patterns, F.lit(1), F.greatest(F.size(patterns) - 1, F.lit(0))), self.body,
            lambda text, p: F.array_join(F.regexp_extract_all(text, p, F.lit(0)), ""),
        )
        last = F.element_at(patterns, -1)
        columns = bound(narrowed, lambda text: F.transform(
            F.sequence(F.lit(0), count), lambda g: F.regexp_extract_all(text, last, g)
        ))
        return bound(columns, lambda cols: F.transform(F.get(cols, F.lit(0)), lambda _, k: F.struct(
            F.lit(None).cast("int").alias("node"),
            F.transform(cols, lambda c: F.get(c, k)).alias("groups"),
        )))

    def strings(self, rule: Column, element: Column) -> Column:
        """All strings a field rule reads from an element, cleaned."""

        def of_part(part: Column) -> Column:
            start = F.coalesce(element["node"], F.lit(0))
            read = F.transform(part["alts"], lambda alt: read_nodes(
                self.nodes, self.body, self._found(part, alt, start), F.when(self.is_json, F.lit("json")).otherwise(alt["reader"]), alt["name"]))
            lists = F.filter(read, lambda items: F.size(items) > 0)
            found = _combined(lists, part["op"])
            return F.coalesce(found, F.array().cast(_STRINGS))

        def whole(part: Column) -> Column:
            return F.when(part["kind"] == "rule", of_part(part)).otherwise(F.array(as_text(part)))

        def as_text(part: Column) -> Column:
            return (
                F.when(part["kind"] == "group", F.coalesce(
                    F.get(element["groups"], part["text"].cast("int")), F.concat(F.lit("$"), part["text"])))
                .when(part["kind"] == "variable", F.coalesce(F.try_element_at(self.variables, part["text"]), F.lit("")))
                .otherwise(part["text"])
            )

        # Each part as a list of strings; several parts are a template and make one string.
        raw = bound(F.transform(rule["parts"], whole), lambda lists: F.when(
            F.size(lists) == 1, F.get(lists, F.lit(0))
        ).otherwise(F.array(F.array_join(F.transform(lists, lambda items: F.array_join(items, "\n")), ""))))
        return F.transform(raw, lambda s: self._cleaned(rule, s))

    @staticmethod
    def _cleaned(rule: Column, text: Column) -> Column:
        pattern, replacement = rule["clean"], rule["replacement"]
        return (
            F.when(pattern.isNotNull() & rule["first"],
                   F.when(F.regexp_like(text, pattern), F.regexp_substr(text, pattern)).otherwise(replacement))
            .when(pattern.isNotNull(), F.regexp_replace(text, pattern, replacement))
            .when(rule["literal"].isNotNull() & ~rule["first"], F.replace(text, rule["literal"], replacement))
            .when(rule["literal"].isNotNull(), replacement)
            .otherwise(text)
        )


# -- jobs --------------------------------------------------------------------


def compile_stage(catalog: DataFrame, key: str, group: str | Column, list_field: str | None) -> DataFrame:
    """Compiled rules of one group: ``origin`` and ``rules``."""
    rules = F.col(group) if isinstance(group, str) else group
    return catalog.select(F.col(key).alias("origin"), compile_group(list_field, rules).alias("rules"))


def rule_errors(compiled: DataFrame) -> DataFrame:
    """Rules that cannot run, and why: ``origin``, ``field``, ``message``."""
    fields = F.concat(
        F.array(F.struct(F.lit("list").alias("name"), F.col("rules.list.unsupported").alias("message"))),
        F.transform("rules.fields", lambda f: F.struct(f["name"].alias("name"), f["rule"]["unsupported"].alias("message"))),
    )
    return (
        compiled.select("origin", F.explode(fields).alias("e"))
        .select("origin", F.col("e.name").alias("field"), "e.message").filter(F.col("message").isNotNull())
    )


def parsed_pages(pages: DataFrame) -> DataFrame:
    """Pages with a body, their nodes, and whether the body is JSON."""
    with_kind = pages.filter(F.length("body") > 0).withColumn("is_json", urls.is_json(F.col("body")))
    return with_kind.withColumn("nodes", page_nodes(F.col("body"), F.col("is_json")))


def extract_records(pages: DataFrame, compiled: DataFrame, keep: Sequence[str] = ("url",)) -> DataFrame:
    """One row per element of each page's list rule, with every field's strings.

    ``pages``: ``origin``, ``url``, ``body`` and optionally ``variables``.
    ``compiled``: ``origin``, ``rules``. Without a list rule the page itself is
    the only element. A list rule with ``-`` turns the order. ``stored`` has the
    values of ``@put``, for ``variables``.
    """
    found, records = _record_columns("variables" in pages.columns, nesting(compiled))
    joined = parsed_pages(pages).join(sent(compiled), "origin")
    return (
        joined.withColumn("__found", found)
        .select("origin", *keep, F.explode(records).alias("r"))
        .select(
            "origin", *keep, "r.ord", F.map_filter("r.fields", lambda name, _: ~name.startswith(PUT)).alias("fields"),
            F.map_filter("r.fields", lambda name, _: name.startswith(PUT)).alias("stored"))
    )


# Up to this many sources, their rules are sent to all tasks.
_SENT = 50_000


def sent(sources: DataFrame) -> DataFrame:
    """A table of sources, to be broadcast unless it has very many rows.

    Its size is unknown to the planner, as its rows come from Python. Left alone it sends the pages instead, with their
    nodes, to the one task that holds the sources, or puts all pages of a source into one task.
    """
    return F.broadcast(sources) if sources.limit(_SENT + 1).count() <= _SENT else sources


def nesting(compiled: DataFrame) -> int:
    """How deep tests nest in any of the compiled rules: the expression that runs them is half as large where none do.

    Looks at the rule sets only, never at pages.
    """
    nested = lambda rule: F.exists(rule["parts"], lambda part: F.exists(part["alts"], lambda alt: F.exists(
        F.concat(alt["steps"], F.coalesce(alt["json"], F.slice(alt["steps"], 1, 0))), lambda step: F.exists(step["paths"], lambda path: F.exists(
            path, lambda hop: F.exists(hop["tests"], lambda test: test["paths"].isNotNull()))))))
    whole = F.concat(F.filter(F.array("rules.list"), lambda r: r.isNotNull()), F.transform("rules.fields", lambda f: f["rule"]))
    deep = compiled.where(F.exists(whole, nested)).limit(1)
    return 0 if deep.isEmpty() else sel.NESTED


def records_view(pages: DataFrame, compiled: DataFrame, name: str, keep: Sequence[str] = ("url",)) -> DataFrame:
    """The records of ``extract_records`` as a view for SQL: ``fields`` maps each field to its strings."""
    records = extract_records(pages, compiled, keep)
    records.createOrReplaceTempView(name)
    return records


@cache
def _record_columns(with_variables: bool, level: int) -> tuple[Column, Column]:
    """The elements of a page and their records, as columns over ``rules``, ``nodes`` and ``body``.

    They are the same for every job, so they are put together once.
    """
    variables = F.col("variables") if with_variables else F.lit(None).cast("map<string,string>")
    page = Page(F.col("body"), F.coalesce(F.col("nodes"), F.array().cast(NODES)), F.col("is_json"), variables, level)
    rules = F.col("rules")
    whole = F.array(F.struct(F.lit(0).alias("node"), F.lit(None).cast(_STRINGS).alias("groups")))
    elements = F.when(rules["list"].isNull(), whole).otherwise(page.elements(rules["list"]))

    def record(element: Column, k: Column) -> Column:
        return F.struct(
            k.cast("bigint").alias("ord"),
            F.map_from_entries(F.transform(
                rules["fields"],
                lambda f: F.struct(f["name"].alias("key"), page.strings(f["rule"], element).alias("value")),
            )).alias("fields"),
        )

    ordered = F.when(rules["list"]["reverse"], F.reverse(F.col("__found"))).otherwise(F.col("__found"))
    return elements, F.transform(ordered, record)


def one(name: str) -> Column:
    """A field as one string: its strings joined by newline, empty when there is none."""
    return F.coalesce(F.array_join(F.try_element_at(F.col("fields"), F.lit(name)), "\n"), F.lit(""))


def many(name: str) -> Column:
    return F.coalesce(F.try_element_at(F.col("fields"), F.lit(name)), F.array().cast(_STRINGS))


def variables(inner: Column | None = None) -> Column:
    """The variables that a record's rules set (``@put``), laid over those that came with its page; empty ones cover nothing."""
    put = F.transform(F.map_entries("stored"), lambda e: F.struct(
        F.substring(e["key"], len(PUT) + 1, F.length(e["key"])).alias("key"), F.array_join(e["value"], "\n").alias("value")))
    set_here = F.map_from_entries(F.filter(put, lambda e: e["value"] != ""))
    return set_here if inner is None else F.map_concat(F.coalesce(inner, F.create_map().cast("map<string,string>")), set_here)


def with_variables(pages: DataFrame, held: DataFrame, on: Sequence[str] = ("url",)) -> DataFrame:
    """Pages with the variables of the hit or chapter that led to them: ``held`` has ``on`` and ``variables``.

    A page's own variables (those of its source) are covered by those of ``held``: the nearest scope counts.
    """
    own = F.coalesce(F.col("variables"), F.create_map().cast("map<string,string>")) if "variables" in pages.columns else F.create_map().cast("map<string,string>")
    led = held.select(*on, F.coalesce("variables", F.create_map().cast("map<string,string>")).alias("__held"))
    return pages.join(led, list(on)).withColumn("variables", F.map_concat(own, F.map_filter("__held", lambda _, v: v != ""))).drop("__held")


def link(name: str, base: Column) -> Column:
    """A field as an absolute URL; the page's own URL when there is none."""
    first = F.coalesce(F.get(many(name), F.lit(0)), F.lit(""))
    return F.when(tx.strip(first) == "", base).otherwise(urls.resolve(base, first))


def links(name: str, base: Column) -> Column:
    """A field as distinct absolute URLs in order, without empty ones and the page itself."""
    resolved = F.transform(many(name), lambda u: urls.resolve(base, u))
    return F.array_distinct(F.filter(resolved, lambda u: (u != "") & (u != base)))


def search_hits(records: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Search or discovery records as hits; records without a name go. ``keep`` names columns to carry along."""
    base = F.col("url")
    cover = one("coverUrl")
    return records.select(
        *keep, "origin", "url", "ord",
        tx.clean_title(tx.unescape(one("name"))).alias("name"),
        tx.clean_author(tx.unescape(one("author"))).alias("author"),
        F.array_join(many("kind"), ",").alias("kind"),
        tx.format_html(tx.unescape(one("intro"))).alias("intro"),
        tx.unescape(one("lastChapter")).alias("latest_chapter"),
        tx.unescape(one("wordCount")).alias("word_count"),
        F.when(cover == "", cover).otherwise(urls.resolve(base, cover)).alias("cover_url"),
        link("bookUrl", base).alias("book_url"),
    ).filter(F.col("name") != "")


def with_fallback_rules(catalog: DataFrame) -> Column:
    """Discovery rules, or the search rules where the discovery list rule is empty."""
    names = [f.name for f in catalog.schema["ruleExplore"].dataType.fields]
    search = F.struct(*[F.col("ruleSearch")[n].alias(n) for n in names])
    empty = F.coalesce(F.trim(F.col("ruleExplore")["bookList"]), F.lit("")) == ""
    return F.when(empty, search).otherwise(F.struct(*[F.col("ruleExplore")[n].alias(n) for n in names]))


def book_details(records: DataFrame, can_rename: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Detail records laid over what the book had: ``old_name``, ``old_author``.

    Name and author only replace empty ones unless renaming is allowed by the
    caller and the rules. The chapter list falls back to the page itself.
    """
    rename = (F.lit(False) if can_rename is None else can_rename) & (one("canReName") != "")
    base = F.col("url")
    cover = one("coverUrl")

    def overlaid(new: Column, old: str) -> Column:
        return F.when((new != "") & (rename | (F.coalesce(F.col(old), F.lit("")) == "")), new).otherwise(F.col(old))

    return records.select(
        *keep, "origin", "url",
        overlaid(tx.clean_title(tx.unescape(one("name"))), "old_name").alias("name"),
        overlaid(tx.clean_author(tx.unescape(one("author"))), "old_author").alias("author"),
        F.array_join(F.filter(many("kind"), lambda k: k != ""), ",").alias("kind"),
        tx.format_html(tx.unescape(one("intro"))).alias("intro"),
        tx.unescape(one("wordCount")).alias("word_count"),
        tx.unescape(one("lastChapter")).alias("latest_chapter"),
        F.when(cover == "", cover).otherwise(urls.resolve(base, cover)).alias("cover_url"),
        link("tocUrl", base).alias("toc_url"),
        F.transform(many("downloadUrls"), lambda u: urls.resolve(base, u)).alias("download_urls"),
    )


def is_inline_marker(book_url: Column) -> Column:
    """A ``data:`` book whose payload is an object with the keys of an inline marker."""
    _, text = urls.decode_data_uri(book_url)
    # Keys that make a payload an inline marker.
    wanted = F.array(F.lit("book_id"), F.lit("sources"), F.lit("tab"))
    keys = F.json_object_keys(text)
    return F.coalesce(urls.is_data_url(book_url) & (F.size(F.array_except(wanted, keys)) == 0), F.lit(False))


def chapter_rows(records: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Chapter-list records as chapters; untitled ones go, missing URLs are made up."""
    title = tx.unescape(one("chapterName"))
    volume = tx.is_true(one("isVolume"))
    address = one("chapterUrl")
    return records.select(
        *keep, "origin", F.col("url").alias("toc_url"), F.col("ord"), title.alias("title"),
        F.when(address != "", address)
        .when(volume, F.concat(title, F.col("ord").cast("string")))
        .otherwise(F.col("url")).alias("url"),
        one("updateTime").alias("tag"), volume.alias("is_volume"),
        tx.is_true(one("isVip")).alias("is_vip"), tx.is_true(one("isPay")).alias("is_pay"),
    ).filter(F.col("title") != "")


def chapter_text(records: DataFrame, image_style: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Content records: text without markup, or markup with absolute images; and next pages."""
    raw = one("content")
    style = F.upper(F.coalesce(image_style if image_style is not None else F.lit(""), F.lit("")))
    kept = keep_images(raw, F.col("url"))
    text = F.when(style.isin("", "TEXT"), tx.format_html(raw)).otherwise(kept)
    return records.select(
        *keep, "origin", "url", one("title").alias("title"), text.alias("text"),
        links("nextContentUrl", F.col("url")).alias("next_urls"),
    )


def keep_images(markup: Column, base: Column) -> Column:
    """Markup with every ``src`` absolute and in double quotes, natively: split at the attribute, resolve, join."""
    quoted = F.regexp_replace(markup, r"(?i)src='([^']*)'", 'src="$1"')
    pieces = F.split(quoted, r'(?i)src="')
    fixed = F.transform(pieces, lambda p, k: F.when(k == 0, p).otherwise(F.concat(
        F.lit('src="'), urls.resolve(base, F.regexp_extract(p, r'(?s)^([^"]*)', 1)), F.regexp_extract(p, r'(?s)^[^"]*(.*)$', 1)
    )))
    return F.array_join(fixed, "")


def article_rows(records: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Feed records as articles; a row needs a title, a link or content."""
    base = F.col("url")
    return records.select(
        *keep, "origin", F.col("url").alias("feed_url"), "ord",
        tx.unescape(one("ruleTitle")).alias("title"),
        tx.unescape(one("rulePubDate")).alias("pub_date"),
        tx.unescape(one("ruleDescription")).alias("description"),
        link("ruleImage", base).alias("image"), link("ruleLink", base).alias("link"),
        tx.format_html(one("ruleContent")).alias("content"),
    ).filter((F.col("title") != "") | (F.col("link") != "") | (F.col("content") != ""))


def review_lists(records: DataFrame, base: Column, keep: Sequence[str] = ()) -> DataFrame:
    """Parallel review lists of each page, ready for ``feeds.zip_reviews``."""
    absolute = lambda name: F.transform(many(name), lambda u: urls.resolve(base, u))
    return records.select(
        *keep, "origin", "url", many("contentRule").alias("contents"), absolute("avatarRule").alias("avatars"),
        many("postTimeRule").alias("post_times"), absolute("reviewQuoteUrl").alias("quote_urls"),
    )


@cache
def _java_pattern():
    return F.udf(lambda p: java_pattern(p) if p and pattern_ok(p) else None, "string", useArrow=False)


def detail_pages(pages: DataFrame, catalog: DataFrame, hits: DataFrame) -> DataFrame:
    """Search pages that are detail pages: their URL fits the source's pattern, or the list is empty and no pattern is set.

    ``catalog``: ``origin``, ``pattern``; ``hits``: records found on the pages. Patterns are translated once a source; one
    that cannot be fits no page (``pattern_errors`` names it).
    """
    joined = pages.join(sent(catalog.withColumn("__java", _java_pattern()(F.col("pattern")))), "origin")
    has_pattern = F.coalesce(F.col("pattern"), F.lit("")) != ""
    matched = joined.filter(has_pattern & F.col("__java").isNotNull()).filter(F.regexp_like(F.col("url"), F.col("__java")))
    empty = joined.filter(~has_pattern).join(hits.select("origin", "url").distinct(), ["origin", "url"], "left_anti")
    return matched.unionByName(empty).drop("__java")


def pattern_errors(catalog: DataFrame) -> DataFrame:
    """Address patterns that cannot run: ``origin``, ``pattern``."""
    return catalog.select("origin", "pattern").filter((F.col("pattern") != "") & _java_pattern()(F.col("pattern")).isNull())


def page_title(body: Column) -> Column:
    title = F.regexp_extract(body, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return tx.strip(F.regexp_replace(tx.unescape(title), r"(?U)\s+", " "))


def page_text(nodes: Column, fallback_title: Column) -> Column:
    """The visible text of a parsed page: its title (else ``fallback_title``), a blank line, and every piece of text on a line.

    Pieces are trimmed, empty ones go; what scripts and styles hold is no text.
    """
    title = F.get(F.filter(nodes, lambda n: n["tag"] == "title"), F.lit(0))
    named = bound(title, lambda t: F.when(t.isNotNull(), F.array_join(F.transform(_texts(nodes, t["i"]), tx.strip), " ")))
    pieces = F.filter(F.transform(_texts(nodes, F.lit(0)), tx.strip), lambda s: s != "")
    heading = F.coalesce(F.nullif(named, F.lit("")), fallback_title, F.lit(""))
    return tx.strip(F.concat(heading, F.lit("\n\n"), F.array_join(pieces, "\n")))


def image_refs(pages: DataFrame) -> DataFrame:
    """Every ``<img src>`` of a page, absolute, in order."""
    found = F.regexp_extract_all("body", F.lit(r'(?i)<img[^>]+src="([^"]+)"'), F.lit(1))
    return pages.select("url", F.posexplode(found).alias("position", "src")).withColumn(
        "src", urls.resolve(F.col("url"), F.col("src"))
    )


# -- sources by address ------------------------------------------------------

#: Characters of the pieces of an address by which patterns are found.
GRAM = 3


def _grams(text: str) -> set[str]:
    return {text[i:i + GRAM] for i in range(len(text) - GRAM + 1)}


def fetched_patterns(addresses: DataFrame, patterns: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(url, source, pattern) to try: ``patterns`` are (source, Java pattern, text in every match).

    A pattern is filed under the piece of its text that the fewest other patterns have; the pieces of an address fetch what is
    filed under them, by an equi-join, and the text itself has to stand in the address.
    """
    spark = addresses.sparkSession
    common = Counter(g for _, _, text in patterns for g in _grams(text))
    filed = [(s, p, text, min(_grams(text), key=lambda g: (common[g], g))) for s, p, text in patterns]
    index = spark.createDataFrame(filed, "source string, pattern string, __text string, __gram string")
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("url") - GRAM + 1))
    pieces = F.array_distinct(F.transform(places, lambda i: F.substring("url", i, F.lit(GRAM))))
    cut = addresses.select("url", F.explode(pieces).alias("__gram"))
    return cut.join(index, "__gram").filter(F.contains("url", "__text")).select("url", "source", "pattern")


def pages_by_pattern(pages: DataFrame, patterns: Sequence[tuple[str, str]]) -> DataFrame:
    """(page, source) pairs where the source's pattern is found in the page's URL.

    Each address tries only the patterns that its pieces fetch; those without any sure text are an array of data, tested on
    each page where it stands. Patterns that Java can't run as they are meant are left out; ``functions.patterns`` says which.
    """
    usable = [(source, java_pattern(pattern), required_text(pattern)) for source, pattern in patterns if pattern_ok(pattern)]
    loose = [{"source": s, "pattern": p} for s, p, text in usable if len(text) < GRAM]
    tests = F.from_json(F.lit(json.dumps(loose)), "array<struct<source:string,pattern:string>>")
    found = F.transform(F.filter(tests, lambda t: F.regexp_like(F.col("url"), t["pattern"])), lambda t: t["source"])
    rows = pages.withColumn("source", F.explode(found))
    indexed = [u for u in usable if len(u[2]) >= GRAM]
    if not indexed:
        return rows
    fitting = fetched_patterns(pages.select("url").distinct(), indexed).filter(F.regexp_like("url", F.col("pattern")))
    return rows.unionByName(pages.join(fitting.select("url", "source"), "url").select(*pages.columns, "source"))
