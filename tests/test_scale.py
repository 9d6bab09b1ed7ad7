"""Results must not depend on partitioning, chunks or skew; streams must equal their batch twins."""

import random

import pytest
from pyspark.sql import functions as F

from folioweave.functions import patterns
from folioweave.operators import extract as ex
from folioweave.operators import hits as op
from folioweave.operators import toc, windows
from folioweave.operators.ordered import first_per_key, numbered, with_next, with_previous
from folioweave.operators.shelf import latest_state, search_history
from folioweave.streaming import jobs

HITS = "ord int, origin string, name string, author string, kind string, book_url string, intro string, cover_url string, latest_chapter string"


def hit_rows(spark, rows):
    return spark.createDataFrame([(o, s, n, a, "", f"u{o}", i, "", "") for o, s, n, a, i in rows], HITS)


def test_merge_and_rank(spark):
    hits = hit_rows(spark, [(1, "s1", "Sunrise", "A", ""), (2, "s2", " sunrise ", "a", "x"), (3, "s1", "Sun", "B", ""), (4, "s3", "Moon", "C", "")])
    ranked = op.rank_hits(op.merge_hits(hits), "sun").collect()
    assert [(r.name, r.author, r.origin_count, r.intro, r.origins) for r in ranked] == [
        ("Sun", "B", 1, "", ["s1"]), ("Sunrise", "A", 2, "x", ["s1", "s2"]), ("Moon", "C", 1, "", ["s3"])]
    assert [r.name for r in op.rank_hits(op.merge_hits(hits), "").collect()] == ["Sunrise", "Sun", "Moon"]


def skewed(n=3000, keys=9, seed=1):
    """A third of the rows have key 0."""
    rng = random.Random(seed)
    rows = [(0 if rng.random() < 0.34 else rng.randrange(1, keys), i, rng.randrange(n)) for i in range(n)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_merge_is_stable_under_partitioning(spark, parts):
    rows = [(i, f"s{v % 11}", f"name {k}", "A", "" if v % 3 else f"i{v}") for k, i, v in skewed()]
    expected = {}
    for o, s, n, _, intro in sorted(rows):
        item = expected.setdefault(n, [o, [], ""])
        if s not in item[1]:
            item[1].append(s)
        item[2] = item[2] or intro
    got = op.merge_hits(hit_rows(spark, rows).repartition(parts)).collect()
    assert {r.name: [r.ord, r.origins, r.intro] for r in got} == expected


@pytest.mark.parametrize("width", [1, 10, 5000])
def test_order_inside_a_hot_key(spark, width):
    rows = skewed()
    df = spark.createDataFrame(rows, "k int, pos int, v int").repartition(7)
    chunk = F.floor(F.col("pos") / width)
    by_key = {}
    for k, pos, v in sorted(rows, key=lambda r: r[1]):
        by_key.setdefault(k, []).append((pos, v))
    numbers = {(r.k, r.pos): (r.idx, r.n) for r in numbered(df, ["k"], F.col("pos"), chunk, "idx", "n").collect()}
    following = {(r.k, r.pos): r.nv for r in with_next(df, ["k"], F.col("pos"), chunk, F.col("v"), "nv").collect()}
    before = {(r.k, r.pos): r.pv for r in with_previous(df, ["k"], F.col("pos"), chunk, F.col("v"), "pv").collect()}
    for k, items in by_key.items():
        for i, (pos, _) in enumerate(items):
            assert numbers[k, pos] == (i, len(items))
            assert following[k, pos] == (items[i + 1][1] if i + 1 < len(items) else None)
            assert before[k, pos] == (items[i - 1][1] if i else None)


def test_first_rows_are_limited_before_the_shuffle(spark):
    df = spark.createDataFrame(skewed(), "k int, pos int, v int")
    plan = first_per_key(df, ["k"], F.col("pos"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_toc_order(spark):
    links = spark.createDataFrame([("b", i, u) for i, u in enumerate(["u1", "u2", "u3", "u1"])], "book string, pos int, url string")
    chunk = F.floor(F.col("pos") / 2)
    got = toc.build_toc(links, chunk).orderBy("idx").collect()
    assert [(r.idx, r.url, r.pos) for r in got] == [(0, "u2", 1), (1, "u3", 2), (2, "u1", 3)]
    got = toc.build_toc(links, chunk, True).orderBy("idx").collect()
    assert [(r.idx, r.url, r.pos) for r in got] == [(0, "u3", 2), (1, "u2", 1), (2, "u1", 0)]


def test_chains_end(spark):
    links = spark.createDataFrame([("p1", "p2"), ("p2", "p3"), ("p3", "p1"), ("x", "p2"), ("e", "")], "url string, next_url string")
    starts = spark.createDataFrame([("p1",), ("x",), ("e",), ("lone",)], "start string")
    got = {}
    for r in toc.follow_links(starts, links).collect():
        got.setdefault(r.start, {})[r.depth] = r.url
    assert got == {"p1": {0: "p1", 1: "p2", 2: "p3"}, "x": {0: "x", 1: "p2", 2: "p3", 3: "p1"}, "e": {0: "e"}, "lone": {0: "lone"}}


def test_long_chain(spark):
    n = 300
    links = spark.createDataFrame([(f"p{i}", f"p{i + 1}") for i in range(n)], "url string, next_url string")
    got = toc.follow_links(spark.createDataFrame([("p0",)], "start string"), links).collect()
    assert sorted(r.depth for r in got) == list(range(n + 1))
    assert all(r.url == f"p{r.depth}" for r in got)


def test_chapters_in_a_row_make_few_rows(spark, monkeypatch):
    """Each chapter's first page links to the next chapter's: as many rows as pages, not as pairs."""
    made = []
    kept = toc.checkpointed
    monkeypatch.setattr(toc, "checkpointed", lambda df: made.append(kept(df)) or made[-1])
    n = 2_000
    heads = spark.range(n).selectExpr("concat('c', id) AS url", f"CASE WHEN id < {n - 1} THEN concat('c', id + 1) END AS next_url")
    links = spark.range(n - 1).selectExpr("concat('c', id) AS url", "concat('c', id + 1) AS next_url")
    assert toc.page_chains(heads, links).count() == n
    assert sum(df.count() for df in made) < 6 * n


def test_a_chapter_that_runs_through_another(spark):
    """Chapter a names c as its next one but runs through b; b has no next one and runs on; d goes round in a circle."""
    heads = spark.createDataFrame([("a1", "c1"), ("b1", None), ("c1", None), ("d1", "x")], "url string, next_url string")
    links = spark.createDataFrame(
        [("a1", "a2"), ("a2", "b1"), ("b1", "b2"), ("b2", "c1"), ("c1", "c2"), ("d1", "d2"), ("d2", "d1")], "url string, next_url string")
    got = {}
    for r in toc.page_chains(heads, links).collect():
        got.setdefault(r.start, {})[r.depth] = r.url
    ordered = {s: [u for _, u in sorted(p.items())] for s, p in got.items()}
    assert ordered == {"a1": ["a1", "a2", "b1", "b2"], "b1": ["b1", "b2", "c1", "c2"], "c1": ["c1", "c2"], "d1": ["d1", "d2"]}


def test_chain_stops_at_next_chapter(spark):
    links = spark.createDataFrame([(f"p{i}", f"p{i + 1}") for i in range(6)], "url string, next_url string")
    heads = spark.createDataFrame([("p0", "p2"), ("p2", None)], "url string, next_url string")
    got = toc.page_chains(heads, links).collect()
    assert sorted((r.start, r.depth) for r in got) == [("p0", 0), ("p0", 1)] + [("p2", d) for d in range(5)]


def test_parts_join_to_the_text(spark):
    pages = spark.createDataFrame([("b", i, f"t{i}" if i % 4 else "") for i in range(26)], "book string, page_no int, text string")
    whole = toc.stitch_pages(pages, ["book"]).first().text
    parts = toc.stitch_pages(pages, ["book"], 6).orderBy("part").collect()
    assert len(parts) == 5 and "\n".join(p.text for p in parts) == whole


# -- windows -----------------------------------------------------------------


def model_audit(rows, limit, span):
    start, count, out = {}, {}, {}
    for event_id, key, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        if key not in start or ts >= start[key] + span:
            start[key], count[key], out[event_id] = ts, 1, 0
        elif count[key] > limit:
            out[event_id] = start[key] + span - ts
        else:
            count[key] += 1
            out[event_id] = 0
    return out


def test_fixed_window_golden(spark):
    rows = spark.createDataFrame([(i, "s", t) for i, t in enumerate([0, 10, 20, 30])], "event_id long, source string, ts long")
    got = windows.rate_limit_audit(rows, "source", 2, 1000).orderBy("event_id").collect()
    assert [r.wait_ms for r in got] == [0, 0, 0, 970]


def test_rates_by_source(spark):
    rates = spark.createDataFrame([("a", "3/37"), ("b", "50"), ("c", "0"), ("d", "x/9"), ("e", None), ("f", " 7 "), ("g", "2/0")], "source string, rate string")
    rng = random.Random(6)
    rows = [(i, rng.choice("abcdefgh"), rng.randrange(3000)) for i in range(1200)]
    df = spark.createDataFrame(rows, "event_id long, source string, ts long")
    got = {r.event_id: r.wait_ms for r in windows.rate_limit_by_source(df, "source", rates).collect()}
    want = {}
    for source, limit, span in (("a", 3, 37), ("b", 0, 50), ("f", 0, 7)):
        want |= model_audit([r for r in rows if r[1] == source], limit, span)
    assert got == {**{r[0]: 0 for r in rows}, **want}


@pytest.mark.parametrize("seed, horizon, chunk", [(1, 4000, None), (2, 60_000, None), (3, 700, 40), (4, 20_000, 130)])
def test_windows_against_model(spark, monkeypatch, seed, horizon, chunk):
    rng = random.Random(seed)
    rows = [(i, rng.choice("aaab"), rng.randrange(horizon)) for i in range(1500)]
    df = spark.createDataFrame(rows, "event_id long, source string, ts long").repartition(5)
    if chunk:
        whole = windows.event_windows
        monkeypatch.setattr(windows, "event_windows", lambda e, k, s: whole(e, k, s, chunk))
    audit = {r.event_id: r.wait_ms for r in windows.rate_limit_audit(df, "source", 3, 37).collect()}
    assert audit == model_audit(rows, 3, 37)
    fetched = {r.event_id for r in windows.ttl_refetch(df, "source", 36).collect() if r.refetch}
    last, expected = {}, set()
    for event_id, key, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        if key not in last or ts > last[key] + 36:
            last[key] = ts
            expected.add(event_id)
    assert fetched == expected


def test_ranking_counts_sources_without_lists(spark):
    """Ranked hits that ask for no source lists gather none; the counts are those of the lists."""
    rows = [(i, f"s{i % 7}", f"Name {i % 3} ", "A", "k", f"u{i}", "", "", "") for i in range(60)] + [(99, None, "name 0", "a", "k", "u", "", "", "")]
    merged = op.merge_hits(spark.createDataFrame(rows, "ord int, origin string, name string, author string, kind string, book_url string, intro string, cover_url string, latest_chapter string"))
    ranked = op.rank_hits(merged, "name 0").select("name", "origin_count")
    assert "collect_list" not in ranked._jdf.queryExecution().optimizedPlan().toString()
    assert [r.origin_count for r in ranked.collect()] == [8, 7, 7]
    assert all(len(r.origins) == r.origin_count for r in merged.collect())


# -- streams -----------------------------------------------------------------

EVENTS = "event_id long, source string, reader long, ts timestamp, ts_ms long, amount long"


@pytest.fixture
def event_files(spark, tmp_path):
    """Six files of events, in order of time but for a little disorder across files, and a last one that closes the watermark."""
    rng = random.Random(5)
    rows = [(i, rng.choice("aab"), i % 13, 1000 * i + rng.randrange(4000), rng.randrange(30)) for i in range(600)]
    for n in range(6):
        part = [(i, s, r, t, a) for i, s, r, t, a in rows if i // 100 == n]
        df = spark.createDataFrame(part, "event_id long, source string, reader long, ts_ms long, amount long")
        df.withColumn("ts", F.timestamp_millis("ts_ms")).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    end = spark.createDataFrame([(9999, "end", 0, 10**8, 0)], "event_id long, source string, reader long, ts_ms long, amount long")
    end.withColumn("ts", F.timestamp_millis("ts_ms")).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    return str(tmp_path / "events"), rows


def stream(spark, folder):
    schema = spark.read.parquet(folder).schema
    return jobs.read_stream(spark, folder, "*.parquet", schema, files_per_batch=1)


def test_stream_rate_limit(spark, event_files):
    folder, rows = event_files
    out = jobs.run_to_files(jobs.stream_rate_limit(stream(spark, folder), "source", 3, 20_000, "1 minute"), jobs.work_folder(spark, "t"))
    got = {r.event_id: r.wait_ms for r in out.collect() if r.event_id != 9999}
    assert got == model_audit([(i, s, t) for i, s, _, t, _ in rows], 3, 20_000)


def test_stream_new_items(spark, event_files):
    folder, rows = event_files
    out = jobs.run_to_files(jobs.stream_new_items(stream(spark, folder), "source", "1 minute"), jobs.work_folder(spark, "t"))
    batch = windows.new_item_counts(
        spark.createDataFrame([(i, s, t, a) for i, s, _, t, a in rows], "event_id long, source string, ts long, amount long"), "source", F.floor(F.col("ts") / 7000))
    assert {r.event_id: r.new_items for r in out.collect() if r.event_id != 9999} == {r.event_id: r.new_items for r in batch.collect()}


def test_streams_in_order_hold_no_key_in_a_task(spark, event_files):
    """What waits and what is carried are tables: nothing hands a key's rows to one Python function, null keys and repeats included."""
    folder, rows = event_files
    odd = spark.createDataFrame([(7001, None, 0, 2000, 5), (7001, None, 0, 2000, 5), (7002, None, 0, 3000, 9)], "event_id long, source string, reader long, ts_ms long, amount long")
    odd.withColumn("ts", F.timestamp_millis("ts_ms")).coalesce(1).write.mode("append").parquet(folder)
    sizes = []
    job = jobs.stream_new_items(jobs.read_stream(spark, folder, "*.parquet", spark.read.parquet(folder).schema), "source", "1 minute")

    def seen(due, carried):
        sizes.append((due.count(), carried.count()))
        return job.decide(due, carried)

    out = jobs.run_to_files(job._replace(decide=seen), jobs.work_folder(spark, "t")).collect()
    assert sizes == [(603, 0)]
    assert sorted((r.event_id, r.new_items) for r in out if r.source is None) == [(7001, 0), (7001, 0), (7002, 4)]
    limited = jobs.stream_rate_limit(jobs.read_stream(spark, folder, "*.parquet", spark.read.parquet(folder).schema), "source", 0, 20_000, "1 minute")
    out = jobs.run_to_files(limited, jobs.work_folder(spark, "t")).collect()
    assert sorted((r.event_id, r.wait_ms) for r in out if r.source is None) == [(7001, 0), (7001, 20_000), (7002, 19_000)]


def test_stream_latest_state_and_dedupe(spark, event_files):
    folder, _ = event_files
    table = spark.read.parquet(folder).withColumn("ts", F.col("ts_ms"))
    events = stream(spark, folder).withColumn("ts", F.col("ts_ms"))
    got = jobs.stream_latest_state(events, ["source", "reader"], ["amount"], jobs.work_folder(spark, "t"))
    want = latest_state(table, ["source", "reader"], "amount")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    rows = jobs.stream_dedupe(stream(spark, folder), ["source", "reader"], "ts", "10 days").select("source", "reader")
    seen = jobs.run_to_files(rows, jobs.work_folder(spark, "t")).collect()
    assert len(seen) == len(set(seen)) == table.select("source", "reader").distinct().count()


def test_stream_merge_hits(spark, event_files):
    folder, _ = event_files
    hits = lambda df: df.select(
        F.col("event_id").alias("ord"), F.concat(F.lit("s"), "reader").alias("origin"), F.concat(F.lit(" N"), F.col("amount")).alias("name"),
        F.col("source").alias("author"), F.concat(F.lit("u"), "event_id").alias("book_url"))
    got = jobs.stream_merge_hits(hits(stream(spark, folder)), jobs.work_folder(spark, "t"))
    blank = F.lit("")
    batch = hits(spark.read.parquet(folder)).withColumns({"kind": blank, "intro": blank, "cover_url": blank, "latest_chapter": blank})
    want = op.merge_hits(batch).select("name", "author", "book_url", "origin_count")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_search_history_cap(spark):
    rows = [(1, f" q{i % 60} ", i) for i in range(200)] + [(2, "only", 5), (2, " ", 6)]
    got = search_history(spark.createDataFrame(rows, "reader int, query string, ts int"), 50).collect()
    first = sorted((r for r in got if r.reader == 1), key=lambda r: -r.ts)
    assert len(first) == 50 and first[0].query == "q19" and first[0].ts == 199
    assert [r.query for r in got if r.reader == 2] == ["only"]


def test_counts_come_with_the_job(spark):
    from folioweave.operators.health import observed

    rows, seen = observed(spark.createDataFrame([("ab",), ("c",)], "body string"), "pages")
    assert rows.count() == 2 and seen.get == {"rows": 2, "chars": 3}


def test_small_scans_are_dealt_out(spark, tmp_path, monkeypatch):
    from folioweave.sources import stores

    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    scan = spark.read.parquet(str(tmp_path / "one"))
    assert stores.spread(scan).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(stores, "SMALL_SHARE", 1)
    assert stores.spread(scan) is scan


def test_url_patterns(spark):
    pages = spark.createDataFrame([("https://a.org/x/1",), ("http://b.net/y",), ("https://a.org/",)], "url string")
    listed = [("host", r"^https?://a\.org/x/"), ("loose", r"/y$"), ("all", r"org|net")]
    want = sorted(map(tuple, ex.pages_by_pattern(pages, listed).collect()))
    assert [s for _, s in want] == ["all", "loose", "all", "all", "host"]
    assert ex.pages_by_pattern(pages, [("bad", "[a"), ("odd", "(?(1)a)")]).count() == 0


def test_many_patterns_are_fetched_not_tried(spark):
    """Ten thousand patterns: an address tries only those whose text stands in it."""
    listed = [(f"s{i}", rf"^https?://[a-z]+\.test/shelf{i:05}/\d+") for i in range(10_000)]
    rows = [(f"http{'s' * (i % 2)}://{'ab'[i % 2]}.test/shelf{37 * i:05}/{i}",) for i in range(200)] + [("http://a.test/shelf00000/x",), ("",), (None,)]
    pages = spark.createDataFrame(rows, "url string").withColumn("pattern", F.lit("clash"))
    usable = [(s, patterns.java_pattern(p), patterns.required_text(p)) for s, p in listed]
    assert usable[7][2] == ".test/shelf00007/"
    tried = ex.fetched_patterns(pages.select("url"), usable)
    assert tried.count() == 201  # one each, and the address without a number
    got = {(r.url, r.source) for r in ex.pages_by_pattern(pages, [*listed, ("loose", "/[0-9]$")]).collect()}
    assert got == {(u, f"s{37 * i}") for i, (u,) in enumerate(rows[:200])} | {(u, "loose") for u, in rows[:10]}


def test_text_in_every_match():
    cases = {"a(bc)d": "abcd", "ab?cde": "cde", "(x|yy)zz": "zz", "(abc)+d": "abc", "(?i)abc": "", "[a]bc": "abc", "^ab$": "ab", "(?:ab){2}": "ab", r"\.x.": ".x", "(ab|cd)": ""}
    assert {p: patterns.required_text(p) for p in cases} == cases


def test_pages_are_never_sent_to_the_rules(spark):
    """Rules go to the pages: neither are pages broadcast nor are all pages of a source put into one task."""
    catalog = spark.createDataFrame([("s", ("li", "a@text")), ("t", ("p", "a@text"))], "origin string, g struct<list: string, name: string>")
    pages = spark.createDataFrame([(str(i), "st"[i % 2], "<li><a>x</a></li>") for i in range(20)], "url string, origin string, body string").repartition(5)
    compiled = ex.compile_stage(catalog, "origin", "g", "list")
    records = ex.extract_records(pages, compiled)
    found = records.select("origin", "url")
    patterns = spark.createDataFrame([("s", ""), ("t", None)], "origin string, pattern string")
    details = ex.detail_pages(pages.select("origin", "url"), patterns, found)
    for df in (records, details):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "BuildLeft" not in plan
    assert records.count() == 10 and {r.origin for r in details.collect()} == {"t"}


def test_many_origins_of_an_item(spark):
    """Origins in order of arrival, equal arrivals by origin; rows are compared by checksum first, lists without an expression."""
    seen = list(range(3000))
    random.Random(5).shuffle(seen)
    rows = [(o // 2, None if o == 8 else f"s{o:04}", " Sun" if o % 3 else "sun ", "A", "") for o in seen] + [(5000, "s0001", "sun", "a", "late")]
    merged = op.merge_hits(hit_rows(spark, rows).repartition(9))
    row, = merged.collect()
    assert row.origins == [f"s{o:04}" if o != 8 else None for o in range(3000)] and row.origin_count == 3000 and row.intro == "late"
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort" not in plan and plan.count("xxhash64") >= 2
