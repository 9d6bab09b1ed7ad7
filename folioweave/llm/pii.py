"""Personal data in texts: candidate spans, boosted trees over format and context, calibrated thresholds.

Everything is DataFrame functions and Spark's own gradient-boosted trees. Base spans follow fixed patterns and checks and are
always kept. High-recall generators propose further, overlapping spans; each candidate is described by a few small features of
its plain form (spelt-out signs are put back, so what only the base patterns ask for is hidden) and its surroundings. The trees
are trained on the counts of distinct feature combinations (a table whose size the features bound, whatever the corpus).
True are candidates on a base span of their kind and those that a word before them names; false are those that fail their kind's
check, lie on a span of another kind, or are plain numbers that nothing names; the rest has no label and is what the trees
decide. A threshold for each kind, calibrated for precision, selects.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioweave.functions.binding import bound
from folioweave.llm.tables import written

KINDS = ["email", "ip", "card", "phone"]

# The base patterns. Guards and possessive repeats keep long runs linear and change no match.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)|0++)"
_PARTS = rf"^{_PART}(?:\.{_PART}){{3}}$"

#: Generators by kind: candidate patterns and a cheap test of texts that can hold any.
GENERATORS = [
    ("email", r"[A-Za-z0-9._%+-]{1,64}+\s{0,2}(?:@|\(at\)|\[at\]|\{at\})\s{0,2}[A-Za-z0-9-]{1,63}+(?:\s?(?:\.|\(dot\)|\[dot\])\s?[A-Za-z0-9-]{1,63}+){1,8}+"),
    ("ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\s?[.,]\s?[0-9]{1,3}){3}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{4}(?:[\x20._/-]?[0-9]{4}){2}[\x20._/-]?[0-9]{1,7}(?![0-9])"),
    ("phone", r"(?<![0-9])(?:\(?00[0-9]{1,3}\)?[\x20./-]?|[0-9]{1,3}[\x20./-])?\(?[0-9]{2,4}\)?[\x20./-]?[0-9]{3,4}[\x20./-][0-9]{3,4}(?![0-9])"),
    ("phone", r"\+\s?[0-9](?:[\x20()./-]{0,2}[0-9]){7,14}"),
]
#: Words that name a kind, directly before a candidate.
_NAMED = r"(?i)(?:%s)[^A-Za-z]{0,3}\s?$"
HINTS = {"email": "mail|contact", "ip": "ip|host|addr|address|server", "card": "card|visa|mastercard|amex", "phone": "tel|phone|fon|call|fax|mobile?|contact|cell"}
_GROUPED_HEX = r"^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$"

#: Boosting rounds and depth of the trees, and the share of true candidates that a kind's threshold must reach.
ROUNDS, DEPTH, PRECISION = 10, 4, 0.9
#: Matches of a text whose list of spans is built at once.
BLOCK = 256
_RADIX = [("kind", 4), ("digits", 6), ("marks", 4), ("groups", 4), ("hint", 2), ("before", 3), ("after", 3), ("luhn", 2)]


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _checked(kind: str, hit: Column) -> Column:
    n = F.length(_digits(hit))
    if kind == "ip":
        return hit.rlike(_PARTS)
    if kind == "card":
        return n.between(12, 19) & F.call_function("luhn_check", _digits(hit))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _plain(hit: Column) -> Column:
    """A candidate as it would be written without disguise: signs for spelt-out ones, no spaces around them."""
    at = F.regexp_replace(hit, r"\s*(?:@|[(\[{]at[)\]}])\s*", "@")
    return F.regexp_replace(F.regexp_replace(at, r"\s*[(\[]dot[)\]]\s*", "."), r"\s*\.\s*", ".")


def _fits(kind: Column, plain: Column) -> Column:
    """Whether a plain form passes the check of its kind."""
    whole = {"email": plain.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++$"), "ip": _checked("ip", plain) | plain.rlike(_GROUPED_HEX)}
    out = F.lit(False)
    for k in KINDS:
        out = F.when(kind == k, whole.get(k, _checked(k, plain))).otherwise(out)
    return F.coalesce(out, F.lit(False))


def _spans(text: Column, pattern: str, check, maybe: Column) -> Column:
    """Leftmost non-overlapping matches that pass ``check``, as structs (start, end, hit) in code points.

    The matches and the gaps between them add up to the positions.
    """
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")

    def step(acc: Column, x: Column) -> Column:
        first = acc["at"] + x["gap"]
        end = first + F.length(x["hit"])
        span = F.array(F.struct(first.alias("start"), end.alias("end"), x["hit"].alias("hit")))
        spans = F.when(x["hit"].isNotNull() & check(x["hit"]), F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    def placed(block: Column, first: Column) -> Column:
        return F.aggregate(block, F.struct(first.alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])

    def in_blocks(parts: Column) -> Column:
        # Lists that grow match by match are copied each time, so they are made for blocks of matches.
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / BLOCK).cast("int")), lambda i: F.slice(parts, i * BLOCK + 1, BLOCK))
        length = lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + x["gap"] + F.coalesce(F.length(x["hit"]), F.lit(0)))
        behind = lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + length(b)))
        both = lambda blocks: F.zip_with(blocks, F.aggregate(blocks, F.array(F.lit(0)), behind), lambda b, first: F.when(b.isNull(), none).otherwise(placed(b, first)))
        return F.flatten(bound(blocks, both))

    parts = F.zip_with(hits, gaps, lambda h, g: F.struct(h.alias("hit"), F.length(g).alias("gap")))
    spans = bound(parts, lambda own: F.when(F.size(own) <= BLOCK, placed(own, F.lit(0))).otherwise(in_blocks(own)))
    return F.when(maybe, spans).otherwise(none)


def _bucket(value: Column, *bounds: int) -> Column:
    return sum(((value >= b).cast("int") for b in bounds[1:]), (value >= bounds[0]).cast("int"))


def _before(start: Column, text: Column) -> Column:
    return F.substring(text, F.greatest(start - 23, F.lit(1)), F.least(start, F.lit(24)))


def _named(kind: Column, before: Column) -> Column:
    out = F.lit(False)
    for k, words in HINTS.items():
        out = F.when(kind == k, before.rlike(_NAMED % words)).otherwise(out)
    return out


def _features(kind: Column, hit: Column, before: Column, after: Column) -> list[Column]:
    """Small whole numbers below their radix: format of the plain form, then its surroundings."""
    side = lambda c: F.when(c == "", 0).when(c.rlike(r"[\p{L}\p{N}]"), 2).otherwise(1)
    digits = _digits(hit)
    return [
        F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)]), kind),
        _bucket(F.length(digits), 4, 7, 10, 12, 16), F.least(F.length(F.regexp_replace(hit, r"[^().,:/_-]", "")), F.lit(3)),
        F.least(F.size(F.split(hit, r"[^A-Za-z0-9]+")) - 1, F.lit(3)), _named(kind, before).cast("int"),
        side(F.substring(before, -1, 1)), side(after), F.coalesce(F.call_function("luhn_check", digits), F.lit(False)).cast("int"),
    ]


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, base, proposed): base spans (start, rank of kind, end, kind) and proposals with a feature code, a label (sure, or null
    without one) and whether they may be added (open: they pass their kind's check and overlap no base span)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digit = F.col("t").rlike("[0-9]")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t")).withColumn("digit", digit)
    maybe = {
        "email": F.col("t").contains("@"), "ip": F.col("digit") & F.col("t").rlike(r"[0-9]\.[0-9]++\.[0-9]"),
        "card": F.col("digit") & F.col("t").rlike(CARD), "phone": F.col("t").contains("+"),
    }
    ranked = lambda kind, rank: (lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))
    base = [
        F.transform(_spans(F.col("t"), p, lambda h, k=k: _checked(k, h), maybe[k]), ranked(k, i))
        for i, (k, p) in enumerate(zip(KINDS, [EMAIL, IP, CARD, PHONE]))]
    rows = rows.withColumn("base", F.array_sort(F.concat(*base)))
    likely = F.col("digit") | maybe["email"] | F.col("t").rlike(r"[(\[{]at[)\]}]")
    named = lambda kind: (lambda s: F.struct(*(s[c].alias(c) for c in ("start", "end", "hit")), F.lit(kind).alias("kind")))
    drawn = [F.transform(_spans(F.col("t"), p, lambda h: F.lit(True), likely), named(k)) for k, p in GENERATORS]

    def placed(s: Column) -> Column:
        meets = lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])
        plain, before = _plain(s["hit"]), _before(s["start"], F.col("t"))
        code = F.lit(0)
        for (_, radix), value in zip(_RADIX, _features(s["kind"], plain, before, F.substring(F.col("t"), s["end"] + 1, 1))):
            code = code * radix + value
        return F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), code.alias("code"), _fits(s["kind"], plain).alias("fits"),
            _named(s["kind"], before).alias("named"), F.exists("base", lambda b: meets(b) & (b["kind"] == s["kind"])).alias("own"),
            F.exists("base", meets).alias("taken"))

    def labelled(s: Column) -> Column:
        false = ~s["fits"] | s["taken"] | ((s["kind"] == "phone") & ~s["named"])
        sure = F.when(s["own"], True).when(false, False).when(s["named"], True)
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["code"].alias("code"), sure.alias("sure"), (s["fits"] & ~s["taken"]).alias("open"))

    described = lambda s: bound(placed(s), labelled)
    return rows.select("doc_id", "base", F.transform(F.concat(*drawn), described).alias("proposed"))


def accepted_codes(found: DataFrame) -> list[int]:
    """The feature codes whose trees' probability reaches their kind's threshold. At most as many as there are codes."""
    each = found.select(F.explode("proposed").alias("p")).select("p.code", "p.sure")
    cube = written(each.groupBy("code").agg(F.count("sure").alias("n"), F.count_if("sure").alias("sure")), "pii-cube")
    sums = cube.agg(F.sum("sure").alias("sure"), F.sum("n").alias("n")).first()
    if not sums["sure"]:
        return []
    if sums["sure"] == sums["n"]:  # nothing speaks against any
        return sorted(r["code"] for r in cube.collect())
    rest, names = F.col("code"), []
    features = cube
    for name, radix in reversed(_RADIX):
        features = features.withColumn(name, (rest % radix).cast("double"))
        rest = F.floor(rest / radix)
        names.append(name)
    features = VectorAssembler(inputCols=names, outputCol="features").transform(features)
    labelled = features.where("sure > 0").select("features", F.lit(1.0).alias("label"), F.col("sure").cast("double").alias("weight")).union(
        features.where("n > sure").select("features", F.lit(0.0), (F.col("n") - F.col("sure")).cast("double")))
    trees = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, weightCol="weight", seed=1, maxBins=32).fit(labelled.coalesce(1))
    scored = trees.transform(features).select("code", "kind", "n", "sure", vector_to_array("probability")[1].alias("p")).toPandas()
    chosen: list[int] = []
    for _, kind in scored.groupby("kind"):
        judged = kind[kind["n"] > 0] if kind["n"].sum() else scored[scored["n"] > 0]  # a kind without any label takes the threshold of all
        levels = judged.groupby("p")[["sure", "n"]].sum().sort_index()
        good = levels.index[_calibrated(levels["sure"].tolist(), levels["n"].tolist()) >= PRECISION]
        if len(good):
            chosen += kind.loc[kind["p"] >= good.min(), "code"].astype(int).tolist()
    return sorted(chosen)


def _calibrated(sure: list[int], n: list[int]) -> np.ndarray:
    """The share of true candidates at each level of the trees' probability, made to rise with it by pooling neighbours."""
    pools: list[list[float]] = []  # true ones, all, levels
    for s, k in zip(sure, n):
        pools.append([s, k, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last)]
    return np.repeat([s / k for s, k, _ in pools], [levels for *_, levels in pools])


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans), one row for each row of ``docs`` (doc_id long, text string; other columns are ignored).

    ``base`` are the spans of fixed patterns that pass their checks, ``spans`` these and the selected candidates that
    overlap no base span and no earlier (of two at one place, longer) selected one; structs (start, rank, end, kind) by start, then kind;
    positions are code points from 0, ends exclusive. Texts are searched whole.

    * Null and empty texts have no spans. Repeated rows, also with a repeated or null doc_id, are searched each.
    * Without any true candidate in the table spans are the base ones; without any false one all that pass their checks are added.
    * An empty table gives an empty result.
    """
    found = written(candidates(docs), "pii-found")
    codes = F.array(*[F.lit(c) for c in accepted_codes(found)]).cast("array<int>")
    chosen = F.filter("proposed", lambda p: p["open"] & F.array_contains(codes, p["code"].cast("int")))
    ordered = F.array_sort(F.transform(chosen, lambda p: F.struct(
        p["start"].alias("start"), (F.array_position(F.array(*map(F.lit, KINDS)), p["kind"]) - 1).cast("int").alias("rank"),
        (-p["end"]).alias("minus_end"), p["kind"].alias("kind"))))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")

    def step(acc: Column, p: Column) -> Column:
        free = ~F.exists(acc, lambda b: (p["start"] < b["end"]) & (b["start"] < -p["minus_end"]))
        span = F.struct(p["start"].alias("start"), p["rank"].alias("rank"), (-p["minus_end"]).alias("end"), p["kind"].alias("kind"))
        return F.when(free, F.concat(acc, F.array(span))).otherwise(acc)

    return found.select("doc_id", "base", F.array_sort(F.concat("base", F.aggregate(ordered, none, step))).alias("spans"))


def shown(spans: str) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in brackets; of overlapping spans the first one names the place."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        named = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit("["), s["kind"], F.lit("]"))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), named.alias("out"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
