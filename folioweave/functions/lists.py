"""Column functions over lists: index picks, combinators, regex rows, cleaning, templates.

Every function takes and returns Spark columns and stays inside Catalyst.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# -- index picks -------------------------------------------------------------


def positions_of(spans: Column, size: Column) -> Column:
    """Distinct 0-based positions named by an array of spans (single, lo, hi, stride), in the order written.

    A span holds the positions between its bounds (both included, clamped to the list) that lie whole strides away from the
    first bound, from there to the second. Negative bounds count from the end; a stride of zero or less has the size added.
    """
    size = size.cast("int")
    every = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))

    def place(bound_: Column) -> Column:
        return F.when(bound_ < 0, bound_ + size).otherwise(bound_)

    def covered(span: Column) -> Column:
        lo, hi = (F.greatest(F.lit(0), F.least(place(b), size - 1)) for b in (F.coalesce(span["lo"], F.lit(0)), F.coalesce(span["hi"], size - 1)))
        stride = F.greatest(F.lit(1), F.when(span["stride"] > 0, span["stride"]).otherwise(span["stride"] + size))
        reached = F.filter(every, lambda i: i.between(F.least(lo, hi), F.greatest(lo, hi)) & (F.abs(i - lo) % stride == 0))
        named = F.filter(every, lambda i: i == place(span["lo"]))
        return F.when(span["single"], named).when(lo > hi, F.reverse(reached)).otherwise(reached)

    return F.array_distinct(F.flatten(F.transform(spans, covered)))


def positions(spec: list[int | tuple[int | None, int | None, int]], size: Column) -> Column:
    """Positions named by ``spec``: numbers, and ranges (first, last, stride)."""
    number = lambda n: F.lit(n).cast("int")
    spans = [
        F.struct(F.lit(not isinstance(s, tuple)).alias("single"), *(
            number(v).alias(n) for n, v in zip(("lo", "hi", "stride"), s if isinstance(s, tuple) else (s, None, 1))))
        for s in spec
    ]
    return positions_of(F.array(*spans), size)


def pick(items: Column, *spec: int | tuple[int | None, int | None, int]) -> Column:
    """The items at the positions of ``spec``, in the order written."""
    return F.transform(positions(list(spec), F.size(items)), lambda i: F.get(items, i))


def exclude(items: Column, *spec: int | tuple[int | None, int | None, int]) -> Column:
    """All items but those at the positions of ``spec``."""
    dropped = positions(list(spec), F.size(items))
    return F.filter(items, lambda _, i: ~F.array_contains(dropped, i))


# -- combinators -------------------------------------------------------------


def concat_lists(*lists: Column) -> Column:
    return F.concat(*lists)


def first_non_empty(*lists: Column) -> Column:
    result = lists[-1]
    for items in reversed(lists[:-1]):
        result = F.when(F.size(items) > 0, items).otherwise(result)
    return result


def interleave(first: Column, *others: Column) -> Column:
    """Items of the lists in turn; the first list sets the number of rounds."""
    rounds = F.transform(
        first,
        lambda item, i: F.concat(
            F.array(item),
            *[F.when(i < F.size(o), F.array(F.get(o, i))).otherwise(F.array().cast("array<string>"))
              for o in others],
        ),
    )
    return F.flatten(rounds)


# -- regular expressions -----------------------------------------------------


def regex_rows(text: Column, patterns: list[str], groups: int) -> Column:
    """Rows [whole match, group 1, …] of the last pattern.

    Each earlier pattern narrows the text to its matches, joined together.
    """
    for pattern in patterns[:-1]:
        text = F.array_join(F.regexp_extract_all(text, F.lit("(?s)" + pattern), F.lit(0)), "")
    last = F.lit("(?s)" + patterns[-1])
    columns = [F.regexp_extract_all(text, last, F.lit(g)) for g in range(groups + 1)]
    return F.transform(
        columns[0], lambda whole, i: F.array(whole, *[F.get(c, i) for c in columns[1:]])
    )


def clean_all(text: Column, pattern: str, replacement: str = "") -> Column:
    """Replace every match of ``pattern``."""
    return F.regexp_replace(text, "(?s)" + pattern, replacement)


def clean_first(text: Column, pattern: str, replacement: str = "") -> Column:
    """The first match itself, or ``replacement`` when nothing matches."""
    found = F.regexp_extract(text, "(?s)" + pattern, 0)
    return F.when(text.rlike("(?s)" + pattern), found).otherwise(F.lit(replacement))


# -- variables and templates -------------------------------------------------


def lookup_variable(key: Column | str, *scopes: Column) -> Column:
    """The first non-empty value of ``key``, nearest scope first, else empty."""
    key = F.lit(key) if isinstance(key, str) else key
    return F.coalesce(*[F.nullif(F.try_element_at(s, key), F.lit("")) for s in scopes], F.lit(""))


def fill_template(template: list[str | Column | int], groups: Column | None = None) -> Column:
    """Literal text, columns, and numbers that refer to a regex row's groups, joined."""
    parts: list[Column] = []
    for part in template:
        if isinstance(part, str):
            parts.append(F.lit(part))
        elif isinstance(part, int):
            parts.append(F.coalesce(F.get(groups, part), F.lit(f"${part}")))
        else:
            parts.append(F.coalesce(part.cast("string"), F.lit("")))
    return F.concat(*parts)


def json_at(doc: Column, path: Column | str) -> Column:
    return F.call_function("get_json_object", doc, F.lit(path) if isinstance(path, str) else path)


def _listed(found: Column, path: Column | str) -> Column:
    """Items of a found list, else null. A lone match of ``[*]`` comes as a quoted string."""
    wild = F.contains(F.lit(path) if isinstance(path, str) else path, F.lit("[*]"))
    return F.when(found.startswith("["), F.from_json(found, "array<string>")).when(
        wild & found.startswith('"'), F.from_json(F.concat(F.lit("["), found, F.lit("]")), "array<string>")
    )


def json_strings(doc: Column, path: Column | str) -> Column:
    """Strings found at a JSON path: list items for a list, one item for a scalar."""
    found = json_at(doc, path)
    return F.when(found.isNull(), F.array().cast("array<string>")).otherwise(
        F.coalesce(_listed(found, path), F.array(found))
    )


def json_string(doc: Column, path: Column | str) -> Column:
    """One string for a JSON path; list items are joined by newline."""
    found = json_at(doc, path)
    return F.coalesce(F.array_join(_listed(found, path), "\n"), found)
