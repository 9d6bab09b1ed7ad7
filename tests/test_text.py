"""Goldens and models of text, URL, list and store functions."""

import base64
import html
import io
import random
import re
import zipfile
from urllib.parse import urljoin

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioweave.functions import fixed, lists, patterns, text, urls
from folioweave.operators import content, shelf
from folioweave.sources import schemas, stores

FEW = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))


def column(spark, value, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(value).collect()]


@pytest.mark.parametrize("title, expected", [
    ("第一千零二十五章 标题", "第1025章 标题"), ("第一零二五章", "第1025章"), ("第一千二章", "第1200章"), ("第十二章", "第12章"),
    ("第二万三千章", "第23000章"), ("第１２章", "第12章"), ("第甲章", "第甲章"), ("第三亿零五章 x", "第300000005章 x"), ("Chapter 3", "Chapter 3"),
])
def test_chapter_number(spark, title, expected):
    assert column(spark, text.chapter_number(F.col("t")), [(title,)], "t string") == [expected]


def test_titles_and_authors(spark):
    assert column(spark, text.clean_title(F.col("t")), [("　《三体》 ",), (None,)], "t string") == ["三体", ""]
    assert column(spark, text.clean_author(F.col("t")), [("作者：刘慈欣 ",), ("By: A",), ("author:  B",)], "t string") == ["刘慈欣", "A", "B"]


def test_html_and_images(spark):
    assert column(spark, text.format_html(F.col("t")), [("<p>a\n　b</p> <i>c</i>",)], "t string") == ["a b c"]
    from folioweave.operators.extract import keep_images

    got = column(spark, keep_images(F.col("t"), F.lit("https://example.com/base/i.html")), [("<div><img src=\"/cover.jpg\"><IMG SRC='a.png'></div>",)], "t string")
    assert got == ['<div><img src="https://example.com/cover.jpg"><IMG src="https://example.com/base/a.png"></div>']


def test_strip_title_takes_odd_names(spark):
    rows = [("Book (1) -- Ch. [2]\n\nbody", "Ch. [2]", "Book (1)"), ("no title", "T", "B")]
    assert column(spark, text.strip_title(F.col("t"), F.col("c"), F.col("b")), rows, "t string, c string, b string") == ["body", "no title"]


def test_resegment(spark):
    rows = [
        ("他说\n你好。\n再见", None), ("标题\n正文。", "标题"), ("说:&quot;好&quot;", ""), ("好。" * 40 + "完", "x"), ("走！\n\"\n然后\n停", ""), ("  a b\n\n c?\n d", ""),
        (None, "t"), ("", ""), ("短!!\n" + "长" * 90 + "!!尾!", ""),
    ]
    assert column(spark, content.resegment(F.col("t"), F.col("h")), rows, "t string, h string") == [
        "他说你好。\n再见", "正文。", "说：“好“", "\n".join(["好。"] * 40 + ["完"]), "走！\n\"\n然后停", "abc?\nd", None, "", "短!!\n" + "长" * 90 + "!\n!\n尾!",
    ]


def test_digests_and_coding(spark):
    assert column(spark, text.hmac_hex(F.col("t"), "secret"), [("message",)], "t string") == [base64.b64decode("DK9kn+7klT2Hv5A6wRdsReAo3xY=").hex()]
    assert column(spark, text.quote_url(F.col("t")), [("a b",)], "t string") == ["a%20b"]
    assert column(spark, F.md5(F.col("t")), [("abc",)], "t string") == ["900150983cd24fb0d6963f7d28e17f72"]


def test_find_phrase_is_literal(spark):
    rows = [("A.b a.B axb",)]
    assert column(spark, text.count_phrase(F.col("t"), "a.b"), rows, "t string") == [2]
    assert column(spark, text.find_phrase(F.col("t"), "A.B"), rows, "t string") == [1]


def test_progress(spark):
    rows = [(0.45, 1.0), (1.5, 1.0), (1.0, 0.0), (1.0, None)]
    assert column(spark, shelf.scroll_ratio(F.col("y"), F.col("m")), rows, "y double, m double") == [0.45, 1.0, 0.0, 0.0]
    rows = [(None, None, 0.3), (2, 10, 0.457), (2, None, 0.5)]
    label = shelf.progress_label(F.col("i"), F.col("n"), F.col("s"))
    assert column(spark, label, rows, "i int, n int, s double") == ["-", "3/10 45%", "3 50%"]


# -- URLs --------------------------------------------------------------------

PATHS = st.text("abc", min_size=1, max_size=4)
REFERENCES = st.one_of(
    st.just(""), PATHS, st.builds("/{}".format, PATHS), st.builds("//h.org/{}".format, PATHS), st.builds("?q={}".format, PATHS),
    st.builds("#{}".format, PATHS), st.builds("../{}/./{}".format, PATHS, PATHS), st.builds("http://o.net/{}".format, PATHS), st.builds("{}/{}?x#y".format, PATHS, PATHS),
)
BASES = st.builds("http://e.com{}".format, st.sampled_from(["", "/", "/a", "/a/", "/a/b.html", "/a/b?x=1", "/a/b#f", "/a?x=/y/z"]))


@FEW
@given(st.lists(st.tuples(BASES, REFERENCES), min_size=30, max_size=60))
def test_resolve_joins_like_the_standard(spark, pairs):
    got = column(spark, urls.resolve(F.col("b"), F.col("u")), pairs, "b string, u string")
    assert got == [urljoin(b, u) if u else "" for b, u in pairs]


def test_url_parts(spark):
    rows = [("https://example.com:8080/book?id=1&name=a%20b#x",)]
    assert column(spark, urls.authority(F.col("u")), rows, "u string") == ["example.com:8080"]
    assert column(spark, urls.url_path(F.col("u")), rows, "u string") == ["/book"]
    assert column(spark, urls.query_map(F.col("u")), rows, "u string") == [{"id": "1", "name": "a b"}]


def test_requests(spark):
    rows = [("/l<_1, _2,_3>.html", 2), ("/l<_1, _2,_3>.html", 9), ("/plain", 3)]
    assert column(spark, urls.page_alternative(F.col("t"), F.col("p")), rows, "t string, p int") == ["/l_2.html", "/l_3.html", "/plain"]
    filled = urls.fill_request(F.col("t"), F.lit("k$1"), F.col("p"))
    assert column(spark, filled, [("/{{key}}/{{page}}/{{searchPage_1}}", 2)], "t string, p int") == ["/k$1/2/1"]


def test_payloads(spark):
    rows = [('{"a":1}',), (" [1] ",), ("{bad}",), ("1",), ("<p>x",), (None,)]
    assert column(spark, F.coalesce(urls.is_json(F.col("t")), F.lit(False)), rows, "t string") == [True, True, False, False, False, False]
    assert column(spark, urls.decode_data_uri(F.col("t"))[1], [("data:text/plain,a%20b",), ("data:;base64,YWI=",)], "t string") == ["a b", "ab"]


# -- lists -------------------------------------------------------------------


# (spans, list size, positions)
PICKS = [
    ([1], 5, [1]), ([-1], 5, [4]), ([5], 5, []), ([-6], 5, []), ([2, 0, 2], 5, [2, 0]), ([(1, 3, 1)], 5, [1, 2, 3]), ([(None, None, 2)], 5, [0, 2, 4]),
    ([(3, 1, 1)], 5, [3, 2, 1]), ([(-2, None, 1)], 5, [3, 4]), ([(0, -1, -2)], 5, [0, 3]), ([(9, 0, 1)], 5, [4, 3, 2, 1, 0]), ([(4, 0, 3)], 5, [4, 1]),
    ([(0, 1, 1), (1, 3, 2)], 5, [0, 1, 3]), ([0, (None, None, 1)], 0, []), ([(2, 2, 0)], 3, [2]),
]


@pytest.mark.parametrize("spec, size, wanted", PICKS)
def test_index(spark, spec, size, wanted):
    rows = [(list("abcdef"[:size]),)]
    assert column(spark, lists.pick(F.col("x"), *spec), rows, "x array<string>") == [["abcdef"[i] for i in wanted]]
    assert column(spark, lists.exclude(F.col("x"), *spec), rows, "x array<string>") == [[c for i, c in enumerate("abcdef"[:size]) if i not in wanted]]


@FEW
@given(st.lists(st.tuples(*[st.lists(st.sampled_from("abc"), max_size=4)] * 2), min_size=10, max_size=10))
def test_interleave_against_model(spark, pairs):
    got = column(spark, lists.interleave(F.col("a"), F.col("b")), pairs, "a array<string>, b array<string>")
    assert got == [[v for i in range(len(a)) for v in [a[i], *b[i:i + 1]]] for a, b in pairs]


# -- rules -------------------------------------------------------------------


def test_rule_scope(spark):
    rule = content.ReplaceRule
    tokens = content.context_tokens(F.lit("https://a.com"), F.lit("Demo"))
    cases = [rule("x"), rule("x", scope="demo"), rule("x", scope="other"), rule("x", scope="demo", exclude_scope="a.com")]
    row = spark.range(1).select(F.transform(content.rule_array(cases), lambda r: content.in_scope(r, tokens)).alias("c")).first()
    assert row.c == [True, True, False, False]
    assert [r.valid for r in (rule(""), rule("a|"), rule(r"a\|"), rule("("), rule("(", is_regex=False))] == [False, False, True, False, True]


def test_rules_run_in_order(spark):
    rules = [
        content.ReplaceRule(r"(\w)1", r"\1-", "a", id=1), content.ReplaceRule("x$y", "$", "b", id=2, is_regex=False),
        content.ReplaceRule("q", "", "c", id=3, scope="none"), content.ReplaceRule("(?P<n>z)", r"<\g<n>>", "d", id=4),
        content.ReplaceRule("[[a]", "", "e", id=5), content.ReplaceRule("(?(1)a)", "", "f", id=6), content.ReplaceRule("(o)", r"\2", "g", id=7),
    ]
    df = spark.createDataFrame([("a1 x$y q z", "t"), ("", "t"), (None, "t")], "text string, k string")
    tokens = content.context_tokens(F.col("k"))
    out = content.apply_rules(df, "text", rules, tokens, effective="e").collect()
    assert [(r.text, r.e) for r in out] == [("- $ q <z>", ["a", "b", "d", "e"]), ("", []), ("", [])]
    assert [r.text for r in content.apply_rules(df, "text", rules, tokens).collect()] == [r.text for r in out]
    scoped = content.rules_in_scope(df.limit(1), rules, tokens).select("rule").collect()
    assert [r.rule for r in scoped] == ["a", "b", "d", "e"]


def test_plan_size_does_not_grow_with_the_rules(spark):
    df = spark.createDataFrame([("abc", "t")], "text string, k string")

    def nodes(n):
        rules = [content.ReplaceRule(f"w{i}x", f"v{i}", str(i), id=i, scope="t") for i in range(n)]
        done = content.apply_rules(df, "text", rules, content.context_tokens(F.col("k")))
        return done._jdf.queryExecution().optimizedPlan().expressions().toString().count("lambda")

    assert nodes(5) == nodes(500)


PATTERNS = [
    r"a.b", r"a.b$", r"^x|y$", r"(?m)^\w+$", r"[[a]", r"[^\d\s]+", r"\bof\b", r"(?P<n_1>a)(?P=n_1)", r"(?i)É", r"a{2,}?", r"(?<=a)b(?!c)", r"[a-z&&[b]]", r"\Aab\Z", r"\W+", r"[\W_]",
    r"(a)|b", r"\.\*", r"\x41", r"(?s)a.b", r"a(?i:B)c", r"[\]\-^]+", r"(?>a+)b", r"\S\D", "\u00e9+", r"(?x) a b # c",
]
SUBJECTS = ["a\rb", "a\nb", "axb\n", "x\ny", "of office of", "aa aab", "é É", "[[a]&^-]", "ab", "AB_1 ٣ \u2028z", "aBc abC", "", "a*.*b A", "a\u0085b"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_patterns_match_as_they_are_meant(spark, pattern):
    """Every match of the pattern, in Java as in the rule dialect."""
    got = column(spark, F.regexp_extract_all(F.col("t"), F.lit(patterns.java_pattern(pattern)), F.lit(0)), [(s,) for s in SUBJECTS], "t string")
    assert got == [[m[0] for m in re.finditer(pattern, s)] for s in SUBJECTS]


def test_patterns_without_a_java_form():
    assert not any(map(patterns.pattern_ok, ["(", "[a", r"(a)(?(1)b|c)", "a{20000}", r"(?a)\w"]))
    assert [patterns.java_replacement(r, "(?P<n>a)") for r in (r"\1$", r"\g<n>x\\")] == [r"$1\$", r"$1x\\"]
    for unknown in (r"\2", r"\10"):  # \10 names group 10
        with pytest.raises(ValueError):
            patterns.java_replacement(unknown, "(a)")


# -- bytes -------------------------------------------------------------------


def test_charsets_and_text_files(spark):
    page = "<meta charset='utf-8'>中文内容"
    rows = [(page.encode(), None, "text/html"), ("中文".encode("gbk"), "gbk", ""), (b"\xff\xfe!", None, "")]
    df = spark.createDataFrame(rows, "body binary, option string, header string")
    charset = stores.detect_charset(F.col("option"), F.col("header"), F.col("body").cast("string"))
    got = [r[0] for r in df.select(stores.decode_body(F.col("body"), charset)).collect()]
    assert got == [page, "中文", "��!"]
    files = spark.createDataFrame([("﻿有".encode(),), ("中文".encode("gbk"),), (b"\xe9\xff",)], "content binary")
    assert [r.text for r in stores.decode_text_files(files).collect()] == ["有", "中文", "éÿ"]


def test_archives(spark):
    target = io.BytesIO()
    with zipfile.ZipFile(target, "w") as archive:
        archive.writestr("b.txt", "second")
        archive.writestr("a.txt", "first")
    files = spark.createDataFrame([("z", target.getvalue())], "path string, content binary")
    assert stores.archive_text(files).first().text == "first\nsecond"
    assert stores.explode_archives(files).count() == 2


def test_store_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("k1", "a"), ("k2", "b")], "key string, value string")
    stores.write_store(rows, str(tmp_path / "store"), buckets=4)
    back = stores.read_store(spark, str(tmp_path / "store"))
    assert sorted(map(tuple, back.select("key", "value").collect())) == [("k1", "a"), ("k2", "b")]
    assert content.missing_content(rows.withColumn("x", F.lit(1)), back.filter("key = 'k1'")).first().key == "k2"


def test_shelf_file(spark):
    state = (
        '{"bookshelf":[{"key":"k","added_at":5,"book":{"name":"N"},"progress":{"chapter_index":2,"scroll_ratio":0.5}}],'
        '"bookmarks":[{"time":9,"bookName":"N","content":"c"}],"search_history":["q1","q2"],"source_health":{"s":{"passed":true,"message":"OK","tested_at":1}},"other":1}'
    )
    states = spark.createDataFrame([(state,)], "j string").select(F.from_json("j", schemas.STATE_FILE).alias("s")).select("s.*")
    row = stores.shelf_rows(states).first()
    assert (row.key, row.added_at, row.updated_at, row.name, row.author, row.chapter_index) == ("k", 5, 0, "N", "", 2)
    assert stores.bookmark_rows(states).first().book_name == "N"
    assert [r.query for r in stores.history_rows(states).collect()] == ["q1", "q2"]
    assert stores.health_rows(states).first().passed


def test_pages_rules_and_escapes(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"url":"u1","body":"b","status_code":200,"headers":{"a":"1"}}\n{"url":"u2","body":""}\n{"url":"u3"}\n')
    pages = stores.read_pages(spark, str(tmp_path), "json").collect()
    assert [(p.url, p.headers) for p in pages] == [("u1", {"a": "1"})]
    from folioweave.sources.catalog import parse_replace_rules

    texts = spark.createDataFrame([('[{"pattern":"a","order":3},{"pattern":"b","sortOrder":1,"id":7,"timeoutMillisecond":0}]',)], "j string")
    rules = content.rules_from(parse_replace_rules(texts, "j").collect())
    assert [(r.pattern, r.order, r.timeout_ms, r.scope_content) for r in rules] == [("a", 3, 3000, True), ("b", 1, 3000, True)]
    assert [r.pattern for r in content.applicable(rules, title=False)] == ["b", "a"]
    assert column(spark, text.unescape(text.escape(F.col("t"))), [("<a&\"'>",)], "t string") == ["<a&\"'>"]


ENTITIES = [
    "", "&", "&amp", "&amp;amp;", "a&lt;b&gt;c", "&notit; &notin;", "&#65;&#x41;&#X4a &#0; &#128;&#x9f;&#13;", "&#xD800;&#1114112;&#99999999999;", "&#1;x&#x7f;&#xFFFE;", "&nope; &nopeamp;",
    "&CounterClockwiseContourIntegral;", "&acE;&NotEqualTilde;", "&;&#;&#x;", "tail &eacut", "&eacute&eacute;", "&#x1F600;\u4e2d&hellip;", "&" * 50, "&copy2024", "&ampamp;", "&a b;",
]


def test_entities_are_those_of_html(spark):
    assert column(spark, text.unescape(F.col("t")), [(t,) for t in [*ENTITIES, None]], "t string") == [*map(html.unescape, ENTITIES), None]


def test_lines_end_where_they_do_in_rules(spark):
    source = "a\rb\r\nc\x0bd\x0ce\x1cf\x1dg\x1eh\x85i\u2028j\u2029k\nl"
    assert column(spark, text.indent_paragraphs(F.col("t")), [(source,)], "t string") == ["\n".join(text.INDENT + s for s in "abcdefghijkl")]


def test_long_rule_lists_look_up_what_can_match(spark):
    """Rules of a long list whose text does not stand in a document are not run; the results are those of the whole list."""
    words = [a + b + c for a in ("stone", "water", "light") for b in ("fall", "house", "wood", "mark") for c in ("", "s", "er")]
    listed = [content.ReplaceRule(w, w.upper(), w, id=i) for i, w in enumerate(words)]
    made = [
        content.ReplaceRule("LIGHTMARK", "oakentree", "made", id=100), content.ReplaceRule("oakentree", "[oak]", "later", id=101),
        content.ReplaceRule(r"(iron) +(gate)", r"\2\1", "turned", id=102), content.ReplaceRule("gateiron", "", "joined", id=103),
        content.ReplaceRule("WATERHOUSE", "done", "joined later", id=104), content.ReplaceRule("é{2}longé", "x", "rare", id=105, is_regex=False)]
    rules = listed + made
    texts = ["a waterhouse, stonewooder", "lightmarks and oakentree", "iron  gate", "WATERiron gateHOUSE waterhouse", "", None, "é{2}longé" * 2, "😀stonefall😀", "nothing here"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")

    def whole(text):
        for rule in rules:
            text = re.sub(rule.pattern, rule.replacement, text) if rule.is_regex else text.replace(rule.pattern, rule.replacement)
        return text

    out = content.apply_rules(df, "t", rules, content.context_tokens()).orderBy("i").collect()
    assert [r.t for r in out] == [whole(t or "") for t in texts]
    tried = df.select("i", F.transform(content._candidates(content.applicable(listed, False), F.coalesce("t", F.lit(""))), lambda r: r["name"]).alias("n"))
    assert {r.i: r.n for r in tried.collect() if r.n} == {
        0: ["stonewood", "stonewooder", "waterhouse"], 1: ["lightmark", "lightmarks"], 3: ["waterhouse"], 7: ["stonefall"]}


def in_turn(text, rules, names):
    """The text after rules one after the other, and the names of those that changed it."""
    fired = []
    for rule in rules:
        new = re.sub(rule.pattern, rule.replacement, text) if rule.is_regex else text.replace(rule.pattern, rule.replacement)
        if new != text:
            fired.append(rule.name)
        text = new
    return (text, fired) if names else text


def test_fixed_texts_in_one_pass_are_those_in_turn(monkeypatch):
    """Texts that overlap, hold each other, come twice or change nothing, in every order, with bytes that characters share."""
    monkeypatch.setattr(fixed, "_KEPT", 5)
    monkeypatch.setattr(fixed, "_LONGEST", 9)
    rng = random.Random(4)
    for _ in range(400):
        olds = ["".join(rng.choices("abéè", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 12))]
        pairs = [(old, rng.choice([old, "X", "Y☃", "ZZZZZZ"])) for old in olds]
        rules = fixed.FixedTexts((old.encode(), new.encode()) for old, new in pairs)
        listed = [content.ReplaceRule(old, new, i, is_regex=False) for i, (old, new) in enumerate(pairs)]
        for _ in range(10):
            source = "".join(rng.choices("aabbéè \nX", k=rng.randint(0, 40)))
            new, fired = rules.run(source.encode(), True)
            assert (new.decode(), fired) == in_turn(source, listed, True) and len(rules) <= 5
    assert fixed.FixedTexts([(b"a", b"a")]).run(b"aa\xff", True) == (b"aa\xff", [])
    assert fixed.FixedTexts([(b"a", b"b")]).run(b"\xffa\xff") == (b"\xffb\xff", [])


def test_long_lists_of_fixed_texts_run_in_one_pass(spark):
    """No fold over the rules is left, whatever their number; what needs a fold stands before and after the pass."""
    rule = content.ReplaceRule
    words = [a + b for a in ("ab", "ba", "abab", "moon", "öl") for b in ("ba", "ab", "light", "é", "x.y", "$1", "bb", "$")]
    listed = [rule(w, f"<{chr(0x4E00 + i)}\\" if i % 2 else "~", f"w{i}", i, is_regex=False) for i, w in enumerate(words)]
    texts = ["ababab moonlight öléab", "x ab1", "abx.y ölx.y x", "moon$1moon$ $", "", None, "~abab~", "\\$ off abab"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")

    def check(rules, **more):
        out = content.apply_rules(df, "t", rules, content.context_tokens(F.col("t")), **more).orderBy("i").collect()
        on = lambda t: "enabled" not in more or "off" not in (t or "")
        in_scope = lambda t: [r for r in rules if r.scope is None or r.scope in (t or "")]
        assert [(r.t, r.e) if "effective" in more else r.t for r in out] == [in_turn(t or "", in_scope(t) if on(t) else [], "effective" in more) for t in texts]

    plain = content.apply_rules(df, "t", listed, content.context_tokens())._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plain and "ArrowEvalPython" in plain
    mixed = [rule("[01]b?", "ab", "first", -2), rule("é", "", "gone", -1), *listed, rule("<(.)", r"(\1", "open", 98, scope="abab"), rule("~", "abab", "last", 99)]
    on = ~F.contains(F.coalesce("t", F.lit("")), F.lit("off"))
    for rules in (listed, mixed, [rule(re.escape(r.pattern), r.replacement.replace("\\", r"\\"), r.name, r.id) for r in listed]):
        check(rules)
        check(rules, effective="e", enabled=on)
    cut = [*listed[:20], rule("~", "?", "looks for what was put in", 20), *[rule(r.pattern, r.replacement, r.name, r.id + 1, is_regex=False) for r in listed[20:]]]
    assert [content._fixed_run(r) for r in (listed, mixed, listed[:31], cut)] == [slice(0, 40), slice(2, 42), slice(0, 0), slice(0, 0)]
    rows = df.filter("t <> ''").select("i", F.array_join(F.transform(F.split("t", " "), lambda w: F.array_join(F.transform(F.array(w), lambda v: F.concat(v, w, "t")), "")), "\n").alias("text"))
    rows = rows.withColumns({"title": F.lit("T"), "book_name": F.lit(""), "is_volume": F.lit(False)})
    nested = content.finish_content(rows, mixed, content.context_tokens(F.col("text"))).orderBy("i").collect()
    made = ["\n".join(w + w + t for w in t.split(" ")) for t in texts if t]
    whole = [in_turn(t, [r for r in mixed if r.scope is None or r.scope in t], False) for t in made]
    assert [r.text for r in nested] == ["\n".join(text.INDENT + line.strip() for line in t.split("\n") if line.strip()) for t in whole]
