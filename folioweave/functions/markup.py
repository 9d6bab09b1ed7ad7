"""A page's markup as one array of nodes, the only step of extraction that runs in Python.

``page_nodes`` turns markup into nodes in document order. A node knows its
parent (``up``) and its last descendant (``last``), so the descendants of node
``i`` are the slice ``i + 1 … last`` and everything after parsing (selection,
text, attributes) is a Spark expression over that array. A JSON document becomes such an array too: members and items are
nodes, scalars hold their text.

Recovery from bad markup is fixed as follows: script and style hold raw text;
a ``p`` ends at the next block, ``li``, ``dt``/``dd``, ``option``, ``tr`` and
``td``/``th`` end at the next of their kind, along with the inline tags open
inside; an end tag closes what it encloses or, with no partner, is skipped.
"""

from __future__ import annotations

import json
import re
from functools import cache
from html import unescape

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from folioweave.functions.selectors import ITEM, MEMBER

NODE = (
    "STRUCT<i: INT, up: INT, last: INT, tag: STRING, attrs: MAP<STRING, STRING>, text: STRING, own: STRING, "
    "begin: INT, end: INT, nth: INT, nth_last: INT, nth_type: INT, nth_type_last: INT>"
)
NODES = f"ARRAY<{NODE}>"

# Element classes of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4",
    "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul",
}
# A start tag (key) ends the open tags of its set, looking no further than a fence.
ENDS = {
    "li": ({"li"}, {"ul", "ol"}), "option": ({"option"}, {"select"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
P_FENCE = BLOCKS - {"p"} | {"li", "td", "th", "dd", "body"}

_TOKEN = re.compile(
    r"<!--.*?-->|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>"
    r"|<(script|style)\b([^>]*)>(.*?)</\2\s*>"
    r"|</([a-zA-Z][^\s>/]*)[^>]*>"
    r"|<([a-zA-Z][^\s>/]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_JSON_TOKEN = re.compile(r'[\s,:]*(?:([\[{])|([\]}])|("(?:[^"\\]|\\.)*")|([^\s,:\[\]{}"]+))', re.S)


def _attributes(source: str) -> dict[str, str]:
    found = {}
    for name, double, single, bare in _ATTR.findall(source):
        value = double or single or bare
        found.setdefault(name.lower(), unescape(value) if "&" in value else value)
    return found


class NodeTable:
    """Nodes of pages, one list per column; node numbers count from 0 within a page."""

    def __init__(self) -> None:
        self.starts = [0]
        self.up, self.last, self.tag, self.attrs, self.text, self.own = [], [], [], [], [], []
        self.begin, self.end = [], []
        self.nth, self.nth_last, self.nth_type, self.nth_type_last = [], [], [], []

    def add_page(self, markup: str) -> None:
        base = self.starts[-1]
        open_nodes: list[int] = []
        children: dict[int, int] = {}
        of_tag: dict[tuple[int, str], int] = {}

        def add(tag, attrs, text, begin, end):
            up = open_nodes[-1] if open_nodes else -1
            i = len(self.up) - base
            self.up.append(up)
            self.last.append(i)
            self.tag.append(tag)
            self.attrs.append(attrs)
            self.text.append(text)
            self.own.append("" if text is None else None)
            self.begin.append(begin)
            self.end.append(end)
            if text is None and up >= 0:
                children[up] = nth = children.get(up, 0) + 1
                of_tag[up, tag] = nth_type = of_tag.get((up, tag), 0) + 1
                self.nth.append(nth)
                self.nth_type.append(nth_type)
            else:
                self.nth.append(None)
                self.nth_type.append(None)
                if text is not None:
                    self.own[base + up] += text
            return i

        def close_to(depth, end):
            while len(open_nodes) > depth:
                i = base + open_nodes.pop()
                self.last[i], self.end[i] = len(self.up) - base - 1, end

        def end_open(tags, fence, at):
            for depth in range(len(open_nodes) - 1, 0, -1):
                tag = self.tag[base + open_nodes[depth]]
                if tag in tags:
                    return close_to(depth, at)
                if tag in fence:
                    return None

        def add_text(text, at):
            if text and not text.isspace():
                add("#text", None, unescape(text) if "&" in text else text, at, at + len(text))

        open_nodes.append(add("#page", {}, None, 0, len(markup)))
        at = 0
        for token in _TOKEN.finditer(markup):
            begin, end = token.span()
            if begin > at:
                add_text(markup[at:begin], at)
            at = end
            cdata, raw, raw_attrs, raw_text, closed, opened, attrs = token.groups()
            if opened:
                tag = opened.lower()
                if tag in ENDS:
                    end_open(*ENDS[tag], begin)
                if tag in BLOCKS:
                    end_open(_P, P_FENCE, begin)
                i = add(tag, _attributes(attrs) if attrs else {}, None, begin, end)
                if tag not in VOID and not attrs.endswith("/"):
                    open_nodes.append(i)
            elif closed:
                tag = closed.lower()
                for depth in range(len(open_nodes) - 1, 0, -1):
                    if self.tag[base + open_nodes[depth]] == tag:
                        close_to(depth + 1, begin)
                        close_to(depth, end)
                        break
            elif raw:
                open_nodes.append(add(raw.lower(), _attributes(raw_attrs), None, begin, end))
                if raw_text and not raw_text.isspace():
                    add("#raw", None, raw_text, begin, end)
                close_to(len(open_nodes) - 1, end)
            elif cdata:
                add("#text", None, cdata, begin, end)
        add_text(markup[at:], at)
        close_to(0, len(markup))
        for i in range(base, len(self.up)):
            up, nth = self.up[i], self.nth[i]
            self.nth_last.append(None if nth is None else children[up] - nth + 1)
            self.nth_type_last.append(None if nth is None else of_tag[up, self.tag[i]] - self.nth_type[i] + 1)
        self.starts.append(len(self.up))

    def add_document(self, source: str) -> bool:
        """Nodes of a JSON document; false, and none, if it is no such document."""
        try:
            json.loads(source)
        except (ValueError, RecursionError):
            self.starts.append(len(self.up))
            return False
        base = self.starts[-1]
        open_nodes: list[tuple[int, bool]] = []  # with whether it has names
        name, sizes = None, {}
        for token in _JSON_TOKEN.finditer(source):
            opened, closed, string, other = token.groups()
            begin, end = token.span(token.lastindex)
            if closed:
                i, _ = open_nodes.pop()
                self.last[base + i], self.end[base + i] = len(self.up) - base - 1, end
                continue
            if string and open_nodes and open_nodes[-1][1] and name is None:
                name = json.loads(string)
                continue
            up = open_nodes[-1][0] if open_nodes else -1
            i = len(self.up) - base
            sizes[up] = nth = sizes.get(up, 0) + 1
            self.up.append(up)
            self.last.append(i)
            self.tag.append("#page" if up < 0 else ITEM if name is None else MEMBER + name)
            self.attrs.append({})
            self.text.append(json.loads(string) if string else None if opened or other == "null" else other)
            self.own.append(None)
            self.begin.append(begin)
            self.end.append(end)
            self.nth.append(nth if up >= 0 else None)
            name = None
            if opened:
                open_nodes.append((i, opened == "{"))
        for i in range(base, len(self.up)):
            self.nth_last.append(None if self.nth[i] is None else sizes[self.up[i]] - self.nth[i] + 1)
            self.nth_type.append(self.nth[i])
            self.nth_type_last.append(self.nth_last[i])
        self.starts.append(len(self.up))
        return True

    def columns(self) -> dict[str, list]:
        sizes = zip(self.starts, self.starts[1:])
        return {
            "i": [i for start, stop in sizes for i in range(stop - start)], "up": self.up, "last": self.last, "tag": self.tag,
            "attrs": self.attrs, "text": self.text, "own": self.own, "begin": self.begin, "end": self.end, "nth": self.nth,
            "nth_last": self.nth_last, "nth_type": self.nth_type, "nth_type_last": self.nth_type_last,
        }

    def to_arrow(self, missing: list[bool]) -> pa.Array:
        """A list of nodes per page; null where a page is ``missing``."""
        int32, string = pa.int32(), pa.string()
        columns = self.columns()
        pairs = [a or {} for a in columns.pop("attrs")]
        offsets = [0]
        for attrs in pairs:
            offsets.append(offsets[-1] + len(attrs))
        attr_map = pa.MapArray.from_arrays(
            pa.array(offsets, int32), pa.array([k for a in pairs for k in a], string), pa.array([v for a in pairs for v in a.values()], string)
        )
        arrays = {n: pa.array(c, string if n in ("tag", "text", "own") else int32) for n, c in columns.items()}
        arrays["attrs"] = attr_map
        order = ["i", "up", "last", "tag", "attrs", *list(columns)[4:]]
        nodes = pa.StructArray.from_arrays([arrays[n] for n in order], names=order)
        starts = [None if gone else at for at, gone in zip(self.starts, missing)] + [self.starts[-1]]
        return pa.ListArray.from_arrays(pa.array(starts, int32), nodes)


_P = {"p"}


def parse_nodes(markup: str) -> list[dict]:
    """Nodes of one page as dictionaries; node 0 is the page itself."""
    table = NodeTable()
    table.add_page(markup)
    columns = table.columns()
    return [dict(zip(columns, values)) for values in zip(*columns.values())]


@cache
def _nodes_udf():
    @F.arrow_udf(NODES)
    def nodes(body: pa.Array, is_json: pa.Array) -> pa.Array:
        table, missing = NodeTable(), []
        for source, document in zip(body.to_pylist(), is_json.to_pylist(), strict=True):
            missing.append(source is None)
            if source is None:
                table.starts.append(table.starts[-1])
            elif document:
                missing[-1] = not table.add_document(source)
            else:
                table.add_page(source)
        return table.to_arrow(missing)

    return nodes


def page_nodes(body: Column, is_json: Column | None = None) -> Column:
    """Nodes of each page, of a document where ``is_json`` holds; null for a null body and what is no JSON after all."""
    return _nodes_udf()(body, F.lit(False) if is_json is None else is_json)
