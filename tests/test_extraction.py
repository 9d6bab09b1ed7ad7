"""Goldens of extraction: rules in every dialect on small pages."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioweave.functions.markup import NodeTable, parse_nodes
from folioweave.functions.rules import compile_rule
from folioweave.operators import extract as ex
from folioweave.operators import feeds
from folioweave.operators.content import ReplaceRule, apply_rules, context_tokens, finish_content
from folioweave.operators.toc import page_chains, stitch_pages
from folioweave.sources.catalog import parse_sources, read_sources, source_json, write_sources

SHELF = "<section id=shelf><h2><a href=vol/7>Harbour</a></h2><h2><a href='//cdn.test/8'>Lantern</a></h2></section>"
FIVE = "<ul>" + "".join(f"<li>e{i}</li>" for i in range(5)) + "</ul>"


def pages(spark, *rows):
    return spark.createDataFrame(list(rows), "origin string, url string, body string")


def records(spark, rows, rules, list_field=None):
    """``rules``: origin to its rule group."""
    names = sorted({n for r in rules.values() for n in r})
    group = T.StructType([T.StructField(n, T.StringType()) for n in names])
    schema = T.StructType([T.StructField("origin", T.StringType()), T.StructField("g", group)])
    catalog = spark.createDataFrame([(o, tuple(r.get(n) for n in names)) for o, r in rules.items()], schema)
    return ex.extract_records(pages(spark, *rows), ex.compile_stage(catalog, "origin", "g", list_field))


def strings(spark, body, **rules):
    row = records(spark, [("s", "https://example.com/base/", body)], {"s": rules}).first()
    return {name: row.fields.get(name, []) for name in rules}


def test_item_list(spark):
    rules = {"s": {"bookList": "id.shelf@tag.h2", "name": "a@text", "bookUrl": "a@href"}}
    found = records(spark, [("s", "http://lib.test/en/index", SHELF)], rules, "bookList")
    hits = ex.search_hits(found).orderBy("ord").collect()
    assert [(h.name, h.book_url) for h in hits] == [("Harbour", "http://lib.test/en/vol/7"), ("Lantern", "http://cdn.test/8")]


def test_json_list(spark):
    body = '{"hits": [{"t": "Ebb", "by": {"n": "R. Oak"}, "k": 3}, {"t": "Flöße", "by": {"n": "Q"}, "k": 11}, {"t": "", "k": 4}], "more": null}'
    rules = {"j": {"bookList": "$.hits", "name": "t", "author": "$.by.n", "bookUrl": "/w/{{$.k}}/{{$.by.n}}"}}
    found = ex.search_hits(records(spark, [("j", "http://api.test/q", body)], rules, "bookList")).orderBy("ord").collect()
    assert [(h.name, h.author, h.book_url) for h in found] == [("Ebb", "R. Oak", "http://api.test/w/3/R. Oak"), ("Flöße", "Q", "http://api.test/w/11/Q")]
    read = strings(
        spark, body, all="$.hits[*].t", none="$.more", object="$.hits[0].by", deep="$..n", large="$.hits[?(@.k > 3)].k", without="$.hits[?(!@.by)].k",
        either="$.hits[?(@.k == 3 || @.t == 'Flöße')].t||$.more", names="$.hits[1]['t','k']", members="$.hits[0].by.*")
    assert read == {
        "all": ["Ebb", "Flöße", ""], "none": [], "object": ['{"n": "R. Oak"}'], "deep": ["R. Oak", "Q"], "large": ["11", "4"], "without": ["4"],
        "either": ["Ebb", "Flöße"], "names": ["Flöße", "11"], "members": ["R. Oak"]}
    assert strings(spark, '{"broken": ', x="$.broken") == {"x": []}


@pytest.mark.parametrize("suffix, expected", [
    (".0", "e0"), (".-1", "e4"), (".0:2", "e0 e2"), ("!0", "e1 e2 e3 e4"), ("!0:2", "e1 e3 e4"), ("[1:3]", "e1 e2 e3"),
    ("[3:1]", "e3 e2 e1"), ("[0:4:2]", "e0 e2 e4"), ("[-1,0]", "e4 e0"), ("[!1:3]", "e0 e4"), (".9", ""), ("[2:]", "e2 e3 e4"),
])
def test_index(spark, suffix, expected):
    assert " ".join(strings(spark, FIVE, x=f"tag.li{suffix}@text")["x"]) == expected


def test_readers(spark):
    body = "<div id=a>one <b>two</b><script>x()</script> three<br><img src='/i.png'><a href='/l'>t</a><a href='/l'>t</a></div>"
    read = strings(
        spark, body, text="id.a@text", nodes="id.a@textNodes", own="id.a@ownText", html="id.a@html", every="tag.b@all", attr="a@href", texts="a@text")
    assert read == {
        "text": ["one two three t t"], "nodes": ["one\ntwo\nthree\nt\nt"], "own": ["one  three"],
        "html": ["<div id=a>one <b>two</b> three<br><img src='/i.png'><a href='/l'>t</a><a href='/l'>t</a></div>"],
        "every": ["<b>two</b>"], "attr": ["/l"], "texts": ["t", "t"],
    }


def test_combinators(spark):
    body = "<p>a</p><p>b</p><p>c</p><i>x</i><i>y</i>"
    read = strings(spark, body, both="p@text&&i@text", first="u@text||i@text", turns="p@text%%i@text", cut="i@text%%p@text")
    assert read == {"both": list("abcxy"), "first": list("xy"), "turns": list("axbyc"), "cut": list("xayb")}


def test_styles_and_paths(spark):
    body = "<div class='a b' data-k='v1'><p>1</p><p>2</p></div><div class=b><p>3</p><span>4</span></div>"
    read = strings(
        spark, body, both="@CSS:div.a.b > p@text", starts="@CSS:[data-k^=v] p@text", nth="@CSS:div p:nth-child(2)@text", any="@CSS:span, .a p@text",
        last="//div/p[last()]/text()", where="//div[@class='b']/p", attr="//div/@data-k", has="//*[contains(text(),'4')]", exact="class.a b@data-k")
    assert read == {
        "both": ["1", "2"], "starts": ["1", "2"], "nth": ["2"], "any": ["1", "2", "4"], "last": ["2", "3"], "where": ["3"],
        "attr": ["v1"], "has": ["4"], "exact": ["v1"],
    }


GARDEN = (
    "<div id=g><h4>rose</h4><p class=w>red</p><p>thorn</p><h4>fern</h4><p class='w x'>green <i>frond</i></p><ul><li>a</li><li data-n=2><b>b</b></li>"
    "<li>c</li><li data-n=4></li><li>e</li></ul><p lang=en-GB>shade</p></div><div><p>bare</p></div>"
)


SELECTORS = [
    ("h4 + p", "red|green frond"), ("h4 ~ p", "red|thorn|green frond|shade"), ("p.w + p", "thorn"), ("h4 + p + p", "thorn"), ("ul ~ p", "shade"),
    ("p:not(.w)", "thorn|shade|bare"), ("p:not(.w, [lang])", "thorn|bare"), ("p:not(h4 + p)", "thorn|shade|bare"), ("p:not(#g p)", "bare"), ("p:has(i)", "green frond"),
    ("p:has(+ h4)", "thorn"), ("div:has(> ul) > p:last-child", "shade"), ("li:not(:has(b))", "a|c|e"), ("li:nth-child(odd)", "a|c|e"), ("li:nth-child(even)", "b"),
    ("li:nth-child(3n+1)", "a"), ("li:nth-child(-n+3)", "a|b|c"), ("li:nth-last-child(2n + 1)", "a|c|e"), ("p:nth-of-type(2n)", "thorn|shade"), ("li:is(:first-child, :last-child)", "a|e"),
    ("p:only-child", "bare"), ("p:contains(frond)", "green frond"), ("p:-soup-contains-own(frond)", ""), ("[lang|=en]", "shade"), ("li:not(:empty) > *", "b"), ("li:nth-child(4) + li", "e"),
    ("div:root > h4", "rose|fern"), ("li[data-n!='2'], li:nth-child(2n+5)", "e"),
]


def test_selectors(spark):
    read = strings(spark, GARDEN, **{f"x{i}": f"@CSS:{k}@text" for i, (k, _) in enumerate(SELECTORS)})
    assert [(k, "|".join(read[f"x{i}"])) for i, (k, _) in enumerate(SELECTORS)] == SELECTORS


PATHS = [
    ("//h4[2]/following-sibling::p/text()", "green |shade"), ("//h4/following-sibling::*[1]", "red|green frond"), ("//ul/preceding-sibling::h4[1]", "fern"),
    ("//ul/preceding-sibling::h4[last()]", "rose"), ("//i/ancestor::div/h4[1]", "rose"), ("//i/..", "green frond"), ("//b/ancestor-or-self::*[2]/@data-n", "2"),
    ("//li[@data-n>3]/preceding::p[1]/i", "frond"), ("//ul/following::p", "shade|bare"), ("//li[position()>1][position()<3]", "b|c"), ("//li[not(@data-n)][2]", "c"),
    ("//li[@data-n and b]", "b"), ("//li[b='b' or .='e']", "b|e"), ("//p[i]|//h4", "rose|fern|green frond"), ("//p[contains(@class,'x')]/i | //li[1]", "frond|a"),
    ("//p[normalize-space()='green frond']/@class", "w x"), ("//p[starts-with(@lang,'en')]", "shade"), ("//div[ul]/p[last()]", "shade"), ("//p[text()='red']", "red"),
    ("//div[2]/child::p", "bare"), ("//li[last()-1]/@data-n", "4"), ("//p[@class!='w']", "green frond"), ("//ul/li[position()=last()]", "e"), ("//p[not(@class or @lang)]", "thorn|bare"),
]


def test_paths(spark):
    read = strings(spark, GARDEN, **{f"x{i}": k for i, (k, _) in enumerate(PATHS)})
    assert [(k, "|".join(read[f"x{i}"])) for i, (k, _) in enumerate(PATHS)] == PATHS


@pytest.mark.parametrize("rule", [
    "@CSS:p:hover@text", "@CSS:p + > i@text", "@CSS:li:nth-child(x)@text", "@CSS:p:has(i:not(:has(b)))@text", "//p[count(i)=1]", "//p[string-length(.)>3]", "//p/@class | //p",
    "//p[@a][2][@b][1]", "$.a[?(@.b =~ 'x')]", "$.a.length()", "$.a[::0]",
])
def test_rules_that_cannot_run_are_named(rule):
    assert compile_rule(rule)["unsupported"]


def test_documents_become_nodes():
    table = NodeTable()
    assert table.add_document(' {"a": [1, "x\\"y", {"b": null}], "": true, "c": {}} ') and not table.add_document("{") and table.add_document("7")
    columns = table.columns()
    nodes = [dict(zip(columns, values, strict=True)) for values in zip(*columns.values(), strict=True)]
    assert [(n["tag"], n["up"], n["last"], n["text"], n["nth"], n["nth_last"]) for n in nodes] == [
        ("#page", -1, 7, None, None, None), (".a", 0, 5, None, 1, 3), ("[]", 1, 2, "1", 1, 3), ("[]", 1, 3, 'x"y', 2, 2), ("[]", 1, 5, None, 3, 1),
        (".b", 4, 5, None, 1, 1), (".", 0, 6, "true", 2, 2), (".c", 0, 7, None, 3, 1), ("#page", -1, 0, "7", None, None)]


def test_cleaning(spark):
    read = strings(spark, "<p>a1b2</p><i>ab</i>", every=r"p@text##\d##-", first=r"p@text##\d##-##", none=r"i@text##\d##-##", group=r"p@text##([a-z])(\d)##\2\1", literal="p@text##b2(##x")
    assert read == {"every": ["a-b-"], "first": ["1"], "none": ["-"], "group": ["1a2b"], "literal": ["a1b2"]}


def test_variables_and_templates(spark):
    rows = [("s", "u", "<p>7</p>")]
    found = records(spark, rows, {"s": {"id": '@put:{"k":"p@text"}p@text', "link": "/b/@get:{k}?v={{other}}", "group": "x$3"}})
    assert {k: v[0] for k, v in found.first().fields.items()} == {"id": "7", "link": "/b/7?v=", "group": "x$3"}


def test_regex_rows_narrow(spark):
    body = "<ul><a>1</a></ul><ol><a>2</a><a>3</a></ol>"
    found = records(spark, [("s", "u", body)], {"s": {"list": ":<ol>.*</ol>&&<a>(\\d)</a>", "name": "n$1"}}, "list")
    assert [r.fields["name"] for r in found.orderBy("ord").collect()] == [["n2"], ["n3"]]


def test_reverse_list(spark):
    found = records(spark, [("s", "u", FIVE)], {"s": {"list": "-tag.li", "name": "text"}}, "list")
    assert [r.fields["name"][0] for r in found.orderBy("ord").collect()] == ["e4", "e3", "e2", "e1", "e0"]


def test_bad_markup():
    nodes = parse_nodes("<p><b>one<br><p>two<li>x<li>y</ul><script>var t='</p>';</script><td>1<td>2")
    shape = [(n["tag"], n["up"]) for n in nodes if not n["tag"].startswith("#")]
    tags = [t for t, _ in shape]
    assert tags == ["p", "b", "br", "p", "li", "li", "script", "td", "td"]
    assert shape[3][1] == 0 and nodes[-1]["text"] == "2"
    assert all(n["up"] < n["i"] <= n["last"] for n in nodes)


def test_what_cannot_run_is_said(spark):
    assert compile_rule("@js:result")["unsupported"] == "script"
    assert compile_rule("li.@text")["unsupported"]
    assert compile_rule("{{java.get('x')}}")["unsupported"]
    catalog = spark.createDataFrame([("s", ("@js:x", "a@text"))], "origin string, g struct<name string, url string>")
    errors = ex.rule_errors(ex.compile_stage(catalog, "origin", "g", None)).collect()
    assert [(e.origin, e.field, e.message) for e in errors] == [("s", "name", "script")]


def test_two_page_chapter(spark):
    first = "<main><h3>Part 9: Salt</h3><section class=body>grey gulls<br>over grey water</section><nav><a rel=more href='?p=2'>on</a></nav></main>"
    second = "<main><section class=body>no grey land</section></main>"
    rules = {"s": {"content": "class.body@textNodes", "title": "//h3/text()", "nextContentUrl": "@CSS:a[rel=more]@href"}}
    found = ex.chapter_text(records(spark, [("s", "http://lib.test/9", first), ("s", "http://lib.test/9?p=2", second)], rules)).cache()
    links = found.select("url", F.explode("next_urls").alias("next_url"))
    chain = page_chains(spark.createDataFrame([("http://lib.test/9", None)], "url string, next_url string"), links)
    text = chain.join(found.select("url", "text"), "url").withColumn("page_no", F.col("depth"))
    stitched = stitch_pages(text, ["start"]).join(found.select(F.col("url").alias("start"), "title"), "start")
    replace = [ReplaceRule("Part", "No.", "title", scope_title=True, scope_content=False), ReplaceRule("gr[ea]y", "dark", "content")]
    titled = apply_rules(stitched, "title", replace, context_tokens(), title=True).withColumns({"book_name": F.lit(""), "is_volume": F.lit(False)})
    done = finish_content(titled, replace, context_tokens()).first()
    assert done.title == "No. 9: Salt" and done.text == "　　dark gulls over dark water\n　　no dark land" and done.error is None


def test_feed(spark):
    body = "<dl><dt><a href=/n/41>Tide table</a><time>3 May</time></dt><dd>low at six</dd></dl>"
    page = "<main><div id=long>the whole tide table</div></main>"
    rules = {"ruleArticles": "tag.dl", "ruleTitle": "tag.a@text", "ruleLink": "tag.a@href", "rulePubDate": "tag.time@text", "ruleDescription": "tag.dd@text"}
    articles = feeds.dedupe_articles(ex.article_rows(records(spark, [("f", "http://news.test/all", body)], {"f": rules}, "ruleArticles")))
    read = ex.article_rows(records(spark, [("f", "http://news.test/n/41", page)], {"f": {"ruleContent": "id.long@text"}}))
    full = feeds.article_detail(articles, read.select(F.col("feed_url").alias("link"), F.col("content").alias("page_content")))
    replace = [ReplaceRule("Tide", "Flood", "t", scope_title=True, scope_content=False), ReplaceRule("whole", "entire", "c")]
    row = apply_rules(apply_rules(full, "title", replace, context_tokens(), title=True), "content", replace, context_tokens()).first()
    assert (row.title, row.pub_date, row.link, row.content) == ("Flood table", "3 May", "http://news.test/n/41", "the entire tide table")


def test_reviews(spark):
    body = "<ol><li><img src=face/1.png>fine<em>noon</em><q><a href='#r2'>re</a></q></li><li><img src=face/2.png>dull<em>dusk</em></li></ol>"
    rules = {"s": {"avatarRule": "img@src", "contentRule": "li@ownText", "postTimeRule": "em@text", "reviewQuoteUrl": "q@a@href"}}
    found = records(spark, [("s", "http://lib.test/9/talk", body)], rules)
    rows = feeds.zip_reviews(ex.review_lists(found, F.col("url"))).orderBy("position").collect()
    assert [(r.avatar, r.content, r.post_time, r.quote_url) for r in rows] == [
        ("http://lib.test/9/face/1.png", "fine", "noon", "http://lib.test/9/talk#r2"), ("http://lib.test/9/face/2.png", "dull", "dusk", "")]


def test_catalogue_forms(spark, tmp_path):
    as_text = '{"bookSourceUrl":"https://s","bookSourceName":"S","ruleSearch":"{\\"bookList\\":\\".item\\",\\"name\\":\\"a@text\\"}"}'
    as_object = '{"bookSourceUrl":"https://s","bookSourceName":"S","ruleSearch":{"bookList":".item","name":"a@text"},"x":1}'
    rows = parse_sources(spark.createDataFrame([(as_text,), (f"[{as_object}]",)], "json string"), "json").collect()
    assert rows[0] == rows[1] and rows[0].ruleSearch.name == "a@text"
    (tmp_path / "a.json").write_text(f"[{as_object}, {as_text}, {{}}]")
    read = read_sources(spark, str(tmp_path / "a.json"))
    assert read.count() == 2
    write_sources(read, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).filter("value LIKE '%ruleToc%'").count() == 0
    assert "ruleToc" not in source_json(read).first().json


def test_inline_marker(spark):
    rows = spark.createDataFrame([
        ('data:;base64,eyJib29rX2lkIjoiMTIzIiwic291cmNlcyI6IkRlbW8iLCJ0YWIiOiLlsI/or7QiLCJ1cmwiOiIifQ==,{"type":"x"}',), ("data:;base64,e30=",), ("https://h/x",),
    ], "u string")
    assert [r[0] for r in rows.select(ex.is_inline_marker(F.col("u"))).collect()] == [True, False, False]
