"""Source divergence, exact top-k and ranked search against brute force and edge cases on small tables."""

import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from folioweave.llm import bpe, divergence, fuzzy_lines, merging, ranked, tables, token_counts, topk

FOLDER = "/root/testdata/sf0.001"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- tables


def test_scopes_delete_what_they_made_but_for_results(spark, tmp_path):
    made = []

    @tables.scoped("inner")
    def inner():
        made.append(tables.written(spark.range(3), "step"))
        return made[-1].withColumn("x", made[-1]["id"] + 1)

    @tables.scoped("outer")
    def outer():
        made.append(inner())
        assert made[-1].count() == 3
        return made[-1].selectExpr("sum(x) AS x"), made[-1]

    total, rows = outer()
    assert total.first()[0] == 6 and rows.count() == 3
    assert rows.written_to == made[1].written_to  # a result that is written already is not written again
    with pytest.raises(Exception, match="(?i)exist"):
        spark.read.parquet(made[0].written_to).count()


def test_a_failed_job_leaves_nothing_open(spark):
    @tables.scoped("failing")
    def failing():
        tables.written(spark.range(1), "step")
        raise ValueError("no")

    with pytest.raises(ValueError, match="no"):
        failing()
    assert tables._scopes == []


def test_blocks_hold_every_row_once(spark):
    rows = spark.range(1000).selectExpr("id", "1 AS w")
    blocks = list(tables.in_blocks(rows, 100, rows["w"], "blocks"))
    assert len(blocks) == 10
    assert sorted(r[0] for b in blocks for r in b.collect()) == list(range(1000))


def test_dropping_lines_is_linear_and_clashes_with_no_column(spark):
    text = "\n".join(map(str, range(60_000)))
    docs = spark.createDataFrame([(1, text, "x"), (2, "a\nb", "y"), (3, None, "z")], "doc_id long, text string, gone______ string")
    dropped = spark.createDataFrame([(1, list(range(1, 60_000, 2))), (2, [0, 1])], "doc_id long, dropped array<int>")
    began = time.perf_counter()
    got = {r["doc_id"]: r for r in fuzzy_lines.drop_lines(docs, dropped).collect()}
    assert time.perf_counter() - began < 20
    assert got[1]["text"] == "\n".join(map(str, range(0, 60_000, 2))) and got[1]["dropped_lines"] == 30_000
    assert (got[2]["text"], got[2]["dropped_lines"], got[3]["text"], got[3]["gone______"]) == ("", 2, None, "z")


# --- source divergence


def audited(docs, least, smoothing, top):
    words = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))) for text, lang, source in docs]
    held, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, own in words:
        held[lang].update(set(own))
        counts[lang, source].update(own)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in held[lang].items() if n >= least)
        v = len(kept)

        def shares(count):
            n = sum(count[t] for t in kept)
            return {t: 1 + (10**9 * (count[t] + smoothing)) // (n + smoothing * v) for t in kept}

        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        p = {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, f, r) for r, (i, f) in enumerate(found[: None if part == "pair" else top], 1)]
    return sorted(out)


def random_docs(seed, n):
    rng = random.Random(seed)
    words = ["Word", "word", "ÄÖ", "äö", "naïve", "x", "don't", "a1b", "同じ", "\U0001f600z"] + [f"w{chr(97 + i)}" for i in range(20)]
    return [
        (" ".join(rng.choices(words, range(len(words), 0, -1), k=rng.randint(0, 60))) if rng.random() > 0.05 else None,
         rng.choice(["en", "de", None, "xx"]), rng.choice([None, "", "ß", "a", "b", "c", "Z"])) for _ in range(n)]


@pytest.mark.parametrize(("block", "tile", "held"), [(8192, 32, 200_000), (3, 2, 5), (1, 1, 50)])
def test_divergence_against_counting(spark, monkeypatch, block, tile, held):
    for name, value in (("BLOCK", block), ("TILE", tile)):
        monkeypatch.setattr(divergence, name, value)
    docs = random_docs(block, 300) + [("only here " * 5, "fr", "alone"), (None, "it", "a"), ("", "it", "b")]
    table = spark.createDataFrame(docs, "text string, lang string, source string").repartition(3)
    counted = list(divergence._counted(iter(table.fillna("").toArrow().to_batches())))
    assert len({(r["lang"], r["source"], r["term"]) for b in counted for r in b.to_pylist()}) == sum(b.num_rows for b in counted)
    got = divergence.audit_sources(table.withColumn("term", table["lang"]).withColumn("n", table["lang"]), 10, 5, 4)
    assert sorted(map(tuple, got.collect())) == audited(docs, 10, 5, 4)
    assert {r[0] for r in audited(docs, 10, 5, 4)} >= {"it"}  # without any term, yet with pairs


def test_divergence_of_odd_texts(spark):
    docs = [("x" * 3_000_000, "en", "a"), ("y " * 1_500_000, "en", "b"), ("Ab " * 10, "en", "b"), ("\x00\x01", "en", "c")] + [("ab y", "en", "a")] * 40
    got = divergence.audit_sources(spark.createDataFrame(docs, "text string, lang string, source string"), 30)
    assert sorted(map(tuple, got.collect())) == audited(docs, 30, 5, 50)
    nothing = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.audit_sources(nothing).collect() == []


def test_run_lengths():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = int(rng.integers(1, 40))
        columns = []
        for _ in range(2):
            places = np.flatnonzero(rng.random(n) < 0.4)
            values, zero = rng.integers(1, 4, len(places)), int(rng.integers(1, 4))
            column = np.full(n, zero)
            column[places] = values
            runs = divergence.run_lengths(places, values, n, zero)
            assert (np.diff(runs[1]) != 0).all()
            assert (np.repeat(runs[1], np.diff(runs[0], append=n)) == column).all()
            columns.append((column, runs))
        (x, a), (y, b) = columns
        assert divergence.difference(a, b, n) == np.abs(x - y).sum()


def test_the_vocabulary_order_brings_equal_counts_together(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    counts = tables.written(divergence.term_counts(docs), "counts")
    terms = divergence.vocabulary(counts, 2)
    places = terms.where("lang = 'en'").select("pos", "terms", "term").collect()
    assert sorted(r["pos"] for r in places) == list(range(places[0]["terms"]))
    source, = counts.where("lang = 'en'").groupBy("source").sum("n").orderBy("sum(n)", ascending=False).select("source").first()
    own = {r["term"]: r["n"] for r in counts.where(f"lang = 'en' AND source = '{source}'").collect()}
    column = [own.get(r["term"], 0) for r in sorted(places)]
    assert 1 + sum(a != b for a, b in zip(column, column[1:], strict=False)) == len(set(column))  # one run for each count


def test_shares_of_large_counts_are_exact(spark):
    row = spark.createDataFrame([(10**15, 3 * 10**15 + 7, 10**9)], "n long, total long, terms long")
    got = row.select(divergence.share("n", "total", "terms", 5)).first()[0]
    assert got == 1 + 10**9 * (10**15 + 5) // (3 * 10**15 + 7 + 5 * 10**9)


# --- exact top-k


def best_products(rows, is_query, k, scale=1024):
    usable = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in usable:
        if is_query(i):
            scores = [(max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w, strict=True)))), j) for j, w in usable if j != i and len(w) == len(v)]
            scores.sort(key=lambda s: (-s[0], s[1]))
            out += [(i, r, j, s) for r, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


def test_top_k_against_all_products(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 64)
    monkeypatch.setattr(topk, "BLOCK_COMPONENTS", 200)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 20))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 4] + rng.normal(scale=0.2, size=20)]) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]  # many ties
    rows += [(400, None), (None, rows[0][1]), (410, [float("nan")] * 20), (420, [float("inf")] * 20), (430, [None] * 20), (440, []), (450, []),
             (460, [1.0, 2.0]), (470, [0.5, -2.0]), (480, [0.0] * 20), (490, [1e30] * 20), (491, [-1e30] * 20), (10, rows[11][1]), (10, rows[10][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).withColumns({c: F_lit() for c in ("score", "id", "number")})
    got = topk.top_k(table, table["vec_id"] % 10 == 0, k=7)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    want = best_products(rows, lambda i: i % 10 == 0, 7)
    assert sorted(map(tuple, got.collect())) == want
    assert topk.top_k(table, table["vec_id"] < 0).collect() == []


def F_lit():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_top_k_leaves_most_candidates_early():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 64))
    vectors = topk.whole(centres[rng.integers(0, 20, 8192)] + rng.normal(scale=0.1, size=(8192, 64)), 1024)
    layout = topk.Layout(vectors, np.arange(8192), np.arange(64))
    best = topk.Best(1, 10)
    left = np.array([topk.left_mass(vectors[:1, c:])[0] for c in range(topk.DIMENSIONS, 64, topk.DIMENSIONS)])
    layout.search(vectors[0], left, 0, 0, best)
    products = vectors @ vectors[0]
    order = np.lexsort((np.arange(8192), -products))
    order = order[order != 0][:10]
    assert list(best.ids[0]) == list(order) and list(best.scores[0]) == [int(products[i]) for i in order]
    rest = layout.left[2] * left[2]
    so_far = query_part = vectors[:, :24] @ vectors[0, :24]
    assert (query_part + rest >= products[order[-1]]).mean() < 0.5 and len(so_far) == 8192


def test_top_k_on_an_empty_table(spark):
    nothing = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(nothing, nothing["vec_id"] >= 0).collect() == []


# --- ranked search


def ranked_all(docs, items, k):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(t))
    counts = [(i, Counter(cut(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, length = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    terms = defaultdict(set)
    for i, t in items:
        if i is not None:
            terms[i].update(cut(t))
    out = []
    for item, own in terms.items():
        scores = []
        for i, c in counts:
            m = 50 + (50 * c.total() * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if s > 0 and i is not None:
                scores.append((s, i))
        scores.sort(key=lambda x: (-x[0], x[1]))
        out += [(item, r, i, s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("documents", "block", "cells"), [(1 << 14, 4 << 20, 1 << 13), (7, 60, 8), (64, 200, 1)])
def test_ranked_search_against_scoring_all(spark, monkeypatch, documents, block, cells):
    for name, value in (("DOCUMENTS", documents), ("BLOCK_BYTES", block), ("CELLS", cells)):
        monkeypatch.setattr(ranked, name, value)
    rng = random.Random(documents)
    words = [f"t{i}" for i in range(30)] + ["Äh", "äh", "同", "A", "a"]
    text = lambda n: " ".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=n))
    docs = [(i, text(rng.randint(0, 40))) for i in range(300)] + [(None, text(10)), (1000, None), (1001, ""), (5, text(5)), (5, text(5))]
    docs += [(2000 - i, docs[3][1]) for i in range(100)]  # copies, in falling order of their ids
    items = [(f"i{i}", text(rng.randint(1, 8))) for i in range(12)] + [(None, "t1"), ("none", None), ("unknown", "zzz"), ("i0", "t29 t28"), ("copy", docs[3][1])]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(2).withColumns({c: F_lit() for c in ("n", "terms", "norm", "score")})
    asked = spark.createDataFrame(items, "item_id string, text string").withColumn("term", F_lit())
    got = ranked.rank_documents(table, asked, k=9)
    assert sorted(map(tuple, got.collect())) == ranked_all(docs, items, 9)


def test_ranked_search_of_odd_texts(spark):
    docs = [(1, "x" * 3_000_000), (2, "y " * 1_500_000), (3, "x y \x00 z"), (4, "- - -")]
    items = [(1, "Y z"), (2, "x" * 3_000_000), (3, "!"), (3, "z z")]
    table, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string")
    assert sorted(map(tuple, ranked.rank_documents(table, asked).collect())) == ranked_all(docs, items, 50)
    assert ranked.rank_documents(table.where("doc_id < 0"), asked).collect() == []
    assert ranked.rank_documents(table, asked.where("item_id < 0")).collect() == []


def test_largest_of_stretches():
    rng = np.random.default_rng(2)
    sizes = rng.integers(0, 6, 40)
    terms = np.concatenate([np.sort(rng.choice(6, n, replace=False)) for n in sizes])
    shard = ranked.Shard(rng.permutation(40), np.full(40, 100), sizes, terms, rng.integers(1, 9, len(terms)), np.arange(1, 7))
    for low, high in [(a, b) for t in range(6) for a, b in [np.searchsorted(shard.keys, [t * shard.width, (t + 1) * shard.width])]]:
        for a in range(low, high):
            for b in range(a, high + 1):
                place, impact = shard.largest(np.array([a]), np.array([b]))
                assert impact[0] == (shard.impacts[a:b].max() if b > a else 0)
                assert b == a or shard.impacts[place[0]] == impact[0] and a <= place[0] < b


def test_ranked_search_scores_few_documents():
    rng = np.random.default_rng(4)
    docs, words = 4000, 60
    chosen = rng.random((docs, words)) < 1 / np.arange(1, words + 1)
    sizes, terms = chosen.sum(axis=1), np.nonzero(chosen)[1]
    tfs = rng.geometric(0.5, len(terms))
    weights = np.floor(1000 * np.log((2 * docs + 2) / (2 * chosen.sum(axis=0) + 1))).astype(np.int64)
    shard = ranked.Shard(np.arange(docs), np.full(docs, 100), sizes, terms, tfs, weights)
    scored = []

    class Watched(ranked.Top):
        def add(self, scores, ids):
            scored.append(len(ids))
            super().add(scores, ids)

    top = Watched(10)
    shard.search(np.array([40, 50, 59]), top)
    assert len(top.ids) == 10 and sum(scored) < chosen[:, [40, 50, 59]].any(axis=1).sum()
    assert pa.array(top.scores).to_pylist() == sorted(top.scores, reverse=True)


# --- merging


def joined_plainly(symbols, ranks):
    while True:
        best = min((ranks[p], p) for p in zip(symbols, symbols[1:], strict=False) if p in ranks) if any(p in ranks for p in zip(symbols, symbols[1:], strict=False)) else None
        if best is None:
            return symbols
        out, i = [], 0
        while i < len(symbols):
            if tuple(symbols[i:i + 2]) == best[1]:
                out.append("".join(best[1]))
                i += 2
            else:
                out.append(symbols[i])
                i += 1
        symbols = out


def test_merging_against_rounds():
    rng = random.Random(8)
    for _ in range(300):
        known, ranks = list("abc"), {}
        for rank in range(rng.randint(0, 8)):
            pair = (rng.choice(known), rng.choice(known))
            if pair not in ranks and "".join(pair) not in known:
                ranks[pair] = rank
                known.append("".join(pair))
        symbols = rng.choices("abc", k=rng.randint(0, 30))
        assert merging.joined(symbols, lambda a, b, r=ranks: (r[a, b], a + b) if (a, b) in r else None) == joined_plainly(symbols, ranks)


def test_long_words_are_counted_and_encoded_as_the_library_does():
    rng = random.Random(9)
    letters = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=300_000))
    word, byte = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
    began = time.perf_counter()
    parts = token_counts.word_parts(word)
    symbols = [*letters[:-1], letters[-1] + parts["end"]]
    assert token_counts.piece_count(symbols, parts["ranks"]) == len(Tokenizer.from_file(word).encode(letters, add_special_tokens=False).ids)
    model = bpe.model_parts(byte)
    assert bpe.merged(letters.encode(), model["ids"], model["pairs"]) == Tokenizer.from_file(byte).encode(letters, add_special_tokens=False).ids
    assert time.perf_counter() - began < 60


def test_every_code_point_is_lowered_as_the_library_does():
    lower = token_counts.lower_case()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).normalizer
    for c in [0x41, 0x130, 0x3A3, 0xA7CB, 0xA7DC, 0x1E9E, 0x10400, *range(0xC0, 0x600)]:
        assert token_counts._folded(chr(c) + "é", lower) == library.normalize_str(chr(c) + "é")
