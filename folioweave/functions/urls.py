"""Column functions for URLs and request planning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioweave.functions.binding import strip

# Prefixes of a URL that is taken as it is.
ABSOLUTE_PREFIXES = ("http://", "https://", "data:", "ftp://")

URL_OPTIONS = (
    "method STRING, charset STRING, headers MAP<STRING,STRING>, body STRING, type STRING, "
    "retry INT, webView STRING, webJs STRING, js STRING, serverID BIGINT"
)


def is_absolute(url: Column) -> Column:
    result = url.startswith(ABSOLUTE_PREFIXES[0])
    for prefix in ABSOLUTE_PREFIXES[1:]:
        result = result | url.startswith(prefix)
    return result


def remove_dot_segments(url: Column) -> Column:
    """``.`` and ``..`` folded out of the path of an absolute URL; query and fragment stay."""
    parts = r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)([^?#]*)(?s)(.*)$"
    head, path, tail = (F.regexp_extract(url, parts, i) for i in (1, 2, 3))
    steps = F.split(path, "/", -1)

    def step(kept: Column, part: Column) -> Column:
        up = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))
        return F.when(part == ".", kept).when(part == "..", up).otherwise(F.array_append(kept, part))

    folder = F.when(path.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit(""))
    joined = F.array_join(F.aggregate(F.slice(steps, 2, F.greatest(F.size(steps) - 1, F.lit(0))), F.array(F.lit("")), step), "/")
    clean = F.concat(head, F.when((joined == "") & (folder == "") & (path != ""), F.lit("/")).otherwise(F.concat(joined, folder)), tail)
    return F.when(path.rlike(r"/\.\.?(/|$)"), clean).otherwise(url)


def base_url(url: Column) -> Column:
    """Scheme and authority, or null."""
    return F.nullif(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]+)", 1), F.lit(""))


def resolve(base: Column, url: Column) -> Column:
    """Absolute form of ``url`` on a page at ``base``, without ``.`` and ``..`` in what is joined.

    Absolute URLs, ``//host``, ``/path``, ``?query``, ``#part`` and relative
    paths, all native. An absolute URL is taken as it is.
    """
    url = strip(F.coalesce(url, F.lit("")))
    origin = F.coalesce(base_url(base), F.lit(""))
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*:)", 1)
    no_fragment = F.regexp_replace(base, r"#.*$", "")
    no_query = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(
        F.length(no_query) > F.length(origin), F.regexp_replace(no_query, r"[^/]*$", "")
    ).otherwise(F.concat(no_query, F.lit("/")))
    result = (
        F.when(url == "", F.lit(""))
        .when(is_absolute(url), url)
        .when(F.coalesce(base, F.lit("")) == "", url)
        .when(url.startswith("//"), F.concat(scheme, url))
        .when(url.startswith("/"), F.concat(origin, url))
        .when(url.startswith("?"), F.concat(no_query, url))
        .when(url.startswith("#"), F.concat(no_fragment, url))
        .when(url.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), url)
        .otherwise(F.concat(folder, url))
    )
    joined = ~is_absolute(url) & (F.coalesce(base, F.lit("")) != "") & (url != "")
    return F.when(joined & url.rlike(r"(^|/)\.\.?(/|$|\?|#)"), remove_dot_segments(result)).otherwise(result)


def authority(url: Column) -> Column:
    """Host with port, or the URL itself where there is none."""
    found = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1)
    return F.when(found == "", url).otherwise(found)


def query_map(url: Column) -> Column:
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return F.when(query == "", F.create_map().cast("map<string,string>")).otherwise(
        F.transform_values(F.str_to_map(query, F.lit("&"), F.lit("=")), lambda _, v: F.url_decode(v))
    )


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def is_data_url(url: Column) -> Column:
    return F.ltrim(url).startswith("data:")


def has_scheme(url: Column) -> Column:
    return url.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://")


def is_json(text: Column) -> Column:
    """An object or array that parses as JSON."""
    shaped = text.rlike(r"(?sU)^\s*(\{.*\}|\[.*\])\s*$")
    return shaped & F.coalesce(F.try_parse_json(text).isNotNull(), F.lit(False))


def looks_like_html(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?is)<(!doctype|html|body|div|p|span|head|script)\b"), F.lit(False))


def percent_encoded(text: Column) -> Column:
    return F.contains(text, F.lit("%"))


# -- request planning --------------------------------------------------------


def page_alternative(template: Column, page: Column) -> Column:
    """Replace one ``<a,b,c>`` group by its element number ``page``; the last one repeats."""
    inner = F.regexp_extract(template, r"<(.*?)>", 1)
    choices = F.split(inner, ",")
    chosen = F.trim(F.element_at(choices, F.least(page.cast("int"), F.size(choices))))
    start = F.instr(template, "<")
    head = F.substring(template, F.lit(1), start - 1)
    tail = F.substring(template, start + F.length(inner) + 2, F.length(template))
    return F.when(template.rlike(r"<.*?>"), F.concat(head, chosen, tail)).otherwise(template)


def fill_request(template: Column, keyword: Column, page: Column) -> Column:
    """Fill the keyword and page names of a URL template."""
    filled = template
    for name, value in (
        ("{{key}}", keyword),
        ("{{searchKey}}", keyword),
        ("{{page}}", page.cast("string")),
        ("{{searchPage}}", page.cast("string")),
        ("{{searchPage_1}}", (page - 1).cast("string")),
    ):
        filled = F.replace(filled, F.lit(name), value)
    return filled


def split_options(request: Column) -> tuple[Column, Column]:
    """A request ``url , {json}`` as its URL and its option struct (null without options)."""
    separator = r"(?s)\s*,\s*(?=\{)"
    url = F.get(F.split(request, separator, 2), F.lit(0))
    options = F.regexp_extract(request, r"(?s)\s*,\s*(\{.*)$", 1)
    return url, F.when(options != "", F.from_json(options, URL_OPTIONS))


def form_fields(body: Column) -> Column:
    """Decoded form fields of a request body; null when the body is JSON."""
    plain = F.try_parse_json(body).isNull()
    return F.when(
        plain,
        F.transform_values(
            F.str_to_map(body, F.lit("&"), F.lit("=")),
            lambda _, v: F.url_decode(F.coalesce(v, F.lit(""))),
        ),
    )


def merge_headers(*layers: Column) -> Column:
    """Header maps laid over each other, later ones win; ``proxy`` is not a header."""
    empty = F.create_map().cast("map<string,string>")
    merged = F.map_concat(*[F.coalesce(layer, empty) for layer in layers])
    return F.map_filter(merged, lambda k, _: k != "proxy")


def decode_data_uri(uri: Column) -> tuple[Column, Column]:
    """Header and text of a ``data:`` URI, base64 or percent-encoded; options are cut off."""
    plain = F.get(F.split(uri, r"(?s)\s*,\s*(?=\{)", 2), F.lit(0))
    header = F.regexp_extract(plain, r"(?s)^data:(.*?),", 1)
    payload = F.regexp_extract(plain, r"(?s)^data:.*?,(.*)$", 1)
    text = F.when(
        F.contains(header, F.lit("base64")), F.decode(F.unbase64(payload), "UTF-8")
    ).otherwise(F.try_url_decode(payload))
    return header, text
