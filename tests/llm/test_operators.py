"""The dealt operators against brute force, public libraries and edge cases on small tables."""

import itertools
import pathlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioweave.llm import (
    bpe, components, decontam, fuzzy_lines, langid, licences, linking, near_docs, pii, token_counts, url_rules, vectors,
)

FOLDER = "/root/testdata/sf0.001"
ODD = [
    (None, "no id here at all, mail a.b@c.example"), (1, None), (2, ""), (3, "   \n\t "), (4, "word"), (5, "Ünïcode ßtraße 你好 世界 \U0001f600 é"),
    (6, "same text twice over and over again"), (7, "same text twice over and over again"), (7, "same text twice over and over again"),
    (8, "x" * 70_000), (9, "1 " * 30_000), (10, "a.b@c" + ".d" * 20_000), (11, "<|endoftext|> in <|startoftext|> it's  \n\n  two"), (12, "\x00\x01 \x7f"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", 1.5) for i, t in ODD], "doc_id long, text string, found string, score double")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def spread_components(pairs, nodes):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


# --- components and linking


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 60)], [(59, i) for i in range(59)], [(2 * i, 2 * i + 1) for i in range(30)], [(3, 3)], [],
])
def test_components(spark, edges):
    table = spark.createDataFrame(edges, "a long, b long")
    got = {r["id"]: r["component"] for r in components.connected_components(table).collect()}
    edges = [e for e in edges if e[0] != e[1]]
    assert got == spread_components(edges, {n for e in edges for n in e})


def test_linking_loses_no_link_between_components(spark):
    rng = random.Random(3)
    links = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(25)}
    table = spark.createDataFrame([(1, i, 1, 0) for i in range(40)] + [(2, 99, 1, 0)], "bucket long, id long, size int, sketch long")
    similar = spark.createDataFrame(sorted(links), "a long, b long")
    sets = spark.createDataFrame([(i, [1]) for i in range(40)], "id long, elements array<long>")
    found, _ = linking.linked_components(linking.shared_buckets(table), sets, 0.8, lambda pairs: pairs.join(similar, ["a", "b"]))
    got = {r["id"]: r["component"] for r in found.collect()}
    assert all(got.get(n, n) == c for n, c in spread_components(links, range(40)).items())


def test_rare_elements(spark):
    rng = random.Random(12)
    sets = {i: rng.sample(range(60), 12) for i in range(25)}
    got = linking.rare_elements(spark.createDataFrame(list(sets.items()), "id long, elements array<long>")).collect()
    holders = {e: sorted(i for i in sets if e in sets[i]) for e in range(60)}
    told = {tuple(r["ids"]): r["n"] for r in got}
    assert all(told[ids] == sum(h == list(ids) for h in holders.values()) for ids in told)
    assert all(tuple(h) in told for h in holders.values() if 0 < len(h) <= 3) and max(map(len, told)) <= 6


# --- 6: near documents


def word_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_near(rows, share):
    sets = [(i, word_set(t)) for i, t in rows]
    pairs = [(a[0], b[0]) for a, b in itertools.combinations(sets, 2) if a[1] and b[1] and None not in (a[0], b[0])
             and len(a[1] & b[1]) >= share * len(a[1] | b[1]) - 1e-9]
    return spread_components(pairs, {i for i, _ in rows if i is not None})


@pytest.mark.parametrize("share", [0.8, 0.85])
def test_near_documents(spark, docs, share):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    expected = brute_near(rows, share)
    got = near_docs.near_duplicates(docs, share).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == expected
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(word_set(t)) for i, t in rows}


def test_large_group_of_near_copies(spark):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    got = {r["doc_id"]: r["component_id"] for r in near_docs.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 0.85).collect()}
    assert got == brute_near(rows, 0.85)


def test_near_documents_odd(spark, odd, nothing):
    got = near_docs.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    known = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got}
    assert known[None] == (3, None) and known[1] == (0, 1) and known[2] == (0, 2) and known[7] == (3, 6) and known[4] == (1, 4)
    assert near_docs.near_duplicates(nothing).count() == 0


def test_superminhash_estimates_jaccard():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = pool[:2000], pool[500:2500]
    both = near_docs.superminhash(np.concatenate([a, b]), np.repeat([0, 1], 2000), 2, 256)
    assert abs((both[0] == both[1]).mean() - 1500 / 2500) < 0.1
    few = near_docs.superminhash(pool[:3], np.zeros(3, np.int64), 1, 64)
    assert np.isfinite(few).all()


# --- 3: near vectors


def brute_vectors(rows, threshold):
    def unit(v):
        ok = v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        return np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok else None

    units = [unit(v) for _, v, _ in rows]
    links, pairs = [0] * len(rows), []
    for (i, a), (j, b) in itertools.combinations(enumerate(rows), 2):
        if a[2] is not None and a[2] == b[2] and units[i] is not None and units[j] is not None and len(a[1]) == len(b[1]) and units[i] @ units[j] >= threshold:
            links[i] += 1
            links[j] += 1
            pairs.append((a[0], b[0]))
    return links, spread_components(pairs, [r[0] for r in rows])


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL_ROWS", 20)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 8))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 12] + 0.25 * rng.normal(size=8)], i % 3) for i in range(240)]
    rows += [(240 + i, rows[0][1], 0) for i in range(30)]
    rows += [(300, None, 0), (301, [0.0] * 8, 0), (302, [float("nan")] * 8, 0), (303, rows[0][1], None), (304, [1.0, None], 0), (305, [], 0), (306, [1.0, 2.0], 0)]
    got = {r["vec_id"]: r for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    links, component = brute_vectors(rows, 0.93)
    assert len(got) == len(rows)
    for (i, _, _), n in zip(rows, links):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (n, component[i], component[i] == i)


def test_near_vectors_odd(spark):
    rows = [(None, [1.0, 0.0], 1, "x"), (5, [1.0, 0.0], 1, "y"), (5, [1.0, 0.0], 1, "y"), (5, [0.0, 1.0], 1, "y"), (6, [0.0, 1.0], 1, "y")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links string")
    got = sorted(((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in vectors.near_vectors(table).collect()), key=repr)
    assert got == sorted([(0, 0, None), (5, 1, 5), (5, 1, 5), (5, 1, 5), (6, 1, 5)], key=repr)
    assert vectors.near_vectors(table.limit(0)).count() == 0


# --- 8: decontamination


def brute_leaks(text, items, window=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    words, hit, found = cut(text), set(), set()
    for item, t in items:
        w = cut(t)
        for i in range(max(1, len(w) - window + 1)) if w else ():
            part = w[i : i + window]
            for p in range(len(words) - len(part) + 1):
                if words[p : p + len(part)] == part:
                    hit |= set(range(p, p + len(part)))
                    found.add(item)
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block", [2_000_000, 40])
def test_contamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", block)
    rng = random.Random(9)
    word = lambda: rng.choice("abcdefgh") + rng.choice(["", "é", "1"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([14, 30, 10, 3, 1, 11, 12])] + [(7, None), (8, "?!"), (8, "q w e r t z u i o p a s d")]
    items += [(9, items[1][1])]
    texts = []
    for _ in range(60):
        parts = [" ".join(word() for _ in range(rng.randrange(30)))]
        for _ in range(rng.randrange(3)):
            source = (rng.choice(items)[1] or "").split()
            at = rng.randrange(max(1, len(source)))
            parts += [", ".join(source[at : at + rng.randrange(5, 25)]).upper().replace("É", "é"), " ".join(word() for _ in range(5))]
        texts.append(" ".join(parts))
    rows = list(enumerate(texts)) + [(None, texts[0]), (3, texts[1]), (90, None), (91, "")]
    table = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_words int")
    tests = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    found = decontam.contamination(table, tests).collect()
    assert len(found) == len(rows)
    for r in found:
        n_hit = sum(s["last"] - s["first"] + 1 for s in r["found"]["spans"])
        assert (r["found"]["n_words"], n_hit, r["found"]["items"]) == brute_leaks(r["text"], items)
    clean = decontam.clean_documents(table, tests)
    assert clean.columns == table.columns
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(i) for i, t in rows if not brute_leaks(t, items)[1])


def brute_longest(docs, items, window=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    best = {}
    for item, t in items:
        w = cut(t)
        for doc, text in docs:
            words = cut(text)
            for i, p in ((i, p) for i in range(len(w)) for p in range(len(words))):
                n = 0
                while i + n < len(w) and p + n < len(words) and w[i + n] == words[p + n]:
                    n += 1
                if n >= min(window, len(w)):
                    best[item] = min(best.get(item, (0,)), (-n, doc, p, i))
    return {item: (-n, *rest) for item, (n, *rest) in best.items()}


@pytest.mark.parametrize("block, shards", [(2_000_000, 1), (30, 5)])
def test_longest_matches(spark, monkeypatch, block, shards):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", block)
    rng = random.Random(5)
    word = lambda: rng.choice("abcd") + rng.choice(["", "é"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([45, 30, 10, 3, 1, 11, 64])] + [(7, None), (8, "?!"), (8, "q w e r t z u i o p a s d")]
    items += [(9, items[1][1]), (10, "a " * 40), (11, "never seen anywhere")]
    docs = [(40, "a " * 25), (41, None), (42, ""), (43, items[6][1])]
    for n in range(25):
        parts = [" ".join(word() for _ in range(rng.randrange(20)))]
        for _ in range(rng.randrange(3)):
            source = (rng.choice(items)[1] or "").split()
            at = rng.randrange(max(1, len(source)))
            parts += [", ".join(source[at : at + rng.randrange(5, 40)]).upper().replace("É", "é"), word()]
        docs.append((n // 2, " ".join(parts)))
    table = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, words int").repartition(shards)
    nobody = spark.createDataFrame([(None, items[0][1], 1)], table.schema)
    tests = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    found = decontam.longest_matches(table.union(nobody), tests).collect()
    assert {r["item_id"]: tuple(r)[1:] for r in found} == brute_longest(docs, items) and len(found) == len({r["item_id"] for r in found})
    assert decontam.longest_matches(table.limit(0), tests).count() == decontam.longest_matches(table, tests.limit(0)).count() == 0


def test_suffix_arrays_are_sorted_whole(spark):
    rng = np.random.default_rng(3)
    words, firsts = rng.integers(0, 4, 3000).astype(np.uint64), np.array([0, 700, 700, 701, 2000, 3000])
    tests = decontam.Suffixes(np.arange(2), np.concatenate([words[100:170], words[1990:2010]]), np.array([0, 70, 90]), 10)
    shard = decontam.Shard(words, firsts, tests)
    text = np.concatenate([np.append(words[a:b].astype(int) + 1, 0) for a, b in zip(firsts, firsts[1:])])
    assert sorted(shard.order) == list(range(len(text)))
    keys = [tuple(text[i : i + 64]) for i in shard.order]
    assert keys == sorted(keys)


def test_contamination_odd(spark, odd, nothing):
    tests = spark.createDataFrame([(1, "same text twice over and over again")], "item_id long, text string")
    got = decontam.contamination(odd, tests, name="f").collect()
    assert sorted(r["doc_id"] for r in got if r["f"]["items"]) == [6, 7, 7] and len(got) == len(ODD)
    assert decontam.contamination(nothing, tests).count() == 0
    assert decontam.clean_documents(odd, tests.limit(0)).count() == len(ODD)


# --- 9 and 4: BPE and token counts


def texts_for_tokenizers(docs):
    rng = random.Random(4)
    mixed = ["".join(rng.choice("ab cdé'sSüß\n\t  123.,!?你ñ\u0301\u00a0\u2028\U0001f600İΣς½²ⅷ") for _ in range(rng.randrange(1, 80))) for _ in range(400)]
    return [t or "" for _, t in ODD] + mixed + ["a" * 300, " " * 50, "\r\n\r\n x", "don't I'LL we'Ve"] + [r["text"] for r in docs.limit(60).collect()]


def test_bpe_equals_the_library(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = texts_for_tokenizers(docs)
    got = bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()
    library = Tokenizer.from_file(path)
    for r, one in zip(sorted(got, key=lambda r: r["doc_id"]), library.encode_batch(texts, add_special_tokens=False)):
        assert r["ids"] == one.ids, repr(texts[r["doc_id"]][:80])
        assert r["decoded"] == library.decode(one.ids, skip_special_tokens=False) == texts[r["doc_id"]]


def test_every_pair_test_equals_merging():
    parts = bpe.model_parts(public_tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(8)
    sound = np.flatnonzero(parts["sound"])
    a, b = rng.choice(sound[:3000], 20_000), rng.choice(sound[:3000], 20_000)
    exact = [bpe.merged(parts["bytes"][x] + parts["bytes"][y], parts["ids"], parts["pairs"]) == [x, y] for x, y in zip(a, b)]
    assert bpe.compatible(a, b, parts).tolist() == exact


def test_bpe_odd(spark, odd, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = bpe.encode(odd, path).collect()
    assert len(got) == len(ODD) and all(r["decoded"] == (r["text"] or "") and r["found"] == "en" for r in got)
    assert bpe.encode(nothing, path).count() == 0
    assert bpe.encode(odd.withColumnRenamed("found", "ids"), path).columns == ["doc_id", "text", "score", "ids", "decoded"]


@pytest.mark.parametrize("frequent", [300_000, 50])
def test_token_counts_equal_the_library(spark, docs, frequent):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = texts_for_tokenizers(docs)
    table = spark.createDataFrame([(i % 300, t, "x") for i, t in enumerate(texts)] + [(None, None, "y")], "doc_id long, text string, n_tokens string")
    got = token_counts.token_counts(table, path, frequent).collect()
    expected = [(str(i % 300), len(t.encode()), len(e.ids)) for (i, t), e in zip(enumerate(texts), Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False))]
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == sorted([*expected, ("None", 0, 0)])
    assert token_counts.token_counts(table.limit(0), path).count() == 0


# --- 10: language


def test_language(spark, docs, odd, nothing):
    out = langid.held_out(docs["doc_id"])
    model = langid.train(docs.where(~out))
    got = langid.predict(docs.select("doc_id", "text", "lang", out.alias("out")), model).collect()
    assert all(r["out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    judged = [r for r in got if r["out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in judged) >= 0.9 * len(judged)
    assert all(0 <= r["score"] <= 1 for r in got)
    strange = {r["doc_id"]: (r["lang_pred"], r["s"]) for r in langid.predict(odd, model, score="s").collect()}
    assert all(strange[i] == ("und", 0.0) for i in (1, 2, 3, 9, 12)) and strange[4][0] != "und"
    assert langid.predict(nothing, model).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd, langid.train(nothing), score="s").collect()} == {"und"}


def test_language_equals_plain_counting(spark, docs, monkeypatch):
    """Buckets and scores against dictionaries of n-grams, with texts cut into slices of 50 characters and without."""
    def plain(text):
        s = "".join(c if c.isalpha() else " " for c in f" {(text or '').lower()} ")
        return Counter(s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1) if s[i : i + n].strip())

    def bucket(gram):
        value = lambda c: ((ord(c) ^ (ord(c) << 7) & 0xFFFFFFFF) * 0x165667B1) & 0xFFFFFFFF
        acc = sum(value(c) * int(f) for c, f in zip(gram, langid._FACTORS)) & 0xFFFFFFFF
        return ((acc ^ (acc >> 15)) * (0x2C1B3C6D + 2 * (len(gram) - 1)) & 0xFFFFFFFF) >> 32 - langid.BUCKET_BITS

    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.where("text is not null and lang is not null").orderBy("doc_id").limit(60).collect()]
    odd = [(1000 + i, t) for i, (_, t) in enumerate(ODD) if len(t or "") < 2000] + [(2000, "ΑΣ ΟΔΟΣ İı ß " * 40), (2001, "a"), (2002, "x" * 149)]
    counts, prior = {}, Counter(lang for *_, lang in rows)
    for _, text, lang in rows:
        into = counts.setdefault(lang, Counter())
        for gram, n in plain(text).items():
            into[bucket(gram)] += n
    size = 1 << langid.BUCKET_BITS
    log = lambda lang, b: np.log((counts[lang][b] + langid.SMOOTHING) / (counts[lang].total() + size * langid.SMOOTHING))
    wanted = {}
    for i, text in [r[:2] for r in rows] + odd:
        own = plain(text)
        if not any(c.isalpha() for c in (text or "").lower()):
            wanted[i] = ("und", 0.0)
            continue
        share = min(1, langid.EVIDENCE / own.total())
        points = {lang: share * sum(n * log(lang, bucket(g)) for g, n in own.items()) + np.log(prior[lang] / len(rows)) for lang in prior}
        best = max(sorted(points), key=points.get)
        wanted[i] = (best, 1 / sum(np.exp(p - points[best]) for p in points.values()))
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    asked = spark.createDataFrame([r[:2] for r in rows] + odd, "doc_id long, text string")
    model = langid.train(table)
    cut = lambda texts: [x for t in texts for x in langid.sliced([t], 50)]
    for _, text in odd:
        whole, slices = langid.grams(*next(langid.sliced([text]))), [langid.grams(*part) for part in cut([text])]
        assert sorted(whole[0]) == sorted(np.concatenate([b for b, *_ in slices])) == sorted(bucket(g) for g in plain(text).elements())
        assert whole[1].sum() == sum(n.sum() for _, n, _ in slices) and whole[2].any() == any(h.any() for *_, h in slices)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(asked, model).collect()}
    assert got.keys() == wanted.keys()
    for i, (lang, score) in wanted.items():
        assert got[i] == (lang, pytest.approx(score, abs=1e-4)), i


def test_very_long_text_has_bounded_memory():
    import tracemalloc
    text = "ab cdé " * 3_000_000
    tracemalloc.start()
    total = sum(int(langid.grams(*part)[1].sum()) for part in langid.sliced([text]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total > 3 * len(text) / 2 and peak < 16 * len(text)


def test_same_text_same_language(spark, docs):
    model = langid.train(docs.limit(100))
    rows = [(r["text"],) for r in docs.limit(20).collect()]
    alone = langid.predict(spark.createDataFrame(rows, "text string").repartition(7), model).collect()
    together = langid.predict(spark.createDataFrame(rows, "text string").coalesce(1), model).collect()
    assert sorted(alone) == sorted(together)


# --- 5: URLs


def brute_url(url):
    found = re.search(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (found[1].translate({c: c + 32 for c in range(65, 91)}), found[2]) if found else ("", "")
    fits = [(len(rule), rule, verdict) for verdict, rule in url_rules.FIXED_RULES
            for h, p in [(rule[: rule.index("/")], rule[rule.index("/") :])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    bad = any(re.search(rf"(^|[^A-Za-z0-9]){w}($|[^A-Za-z0-9])", host + path) for w in url_rules.BLOCKED_WORDS)
    return host, path, None, "block" if bad else "allow"


def test_urls(spark):
    urls = [
        None, "", "nothing", "https://", "http://com/", "http://a.com", "http://A.Com/x?y#z", "https://example.com/en/1", "https://www.example.com/en/1",
        "https://m.www.example.com/en/", "https://notexample.com/en/", "https://a.net/es/1", "https://a.net/ES/1", "https://net/fr/", "https://a.net/de/",
        "https://free-bets.example.net/de/", "https://alphabets.org/", "x://y://z.com/", "https://a.net:80/fr/", "https://a.com\n.b/net/", "http://" + "a." * 5000 + "com/",
        "ftp://poker?x", "http://x.org/Poker/poker",
    ] * 2
    table = spark.createDataFrame([(i if i % 7 else None, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rules = url_rules.host_rules(spark, url_rules.FIXED_RULES).union(url_rules.word_rules(spark, url_rules.BLOCKED_WORDS))
    got = url_rules.judge_urls(table, rules).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i if i % 7 else None, *brute_url(u))) for i, u in enumerate(urls))
    assert url_rules.judge_urls(table.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_rules.judge_urls(table, rules.limit(0)).collect()} == {"allow"}


# --- 1: personal data


def luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def brute_spans(text):
    checks = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
    }
    found = [(m.start(), i, m.end(), k) for i, (k, (p, ok)) in enumerate(checks.items()) for m in re.finditer(p, text or "") if ok(m[0])]
    return sorted(found)


def test_personal_data(spark, docs):
    rng = random.Random(11)
    pieces = ["a@b.cc", "x.y+z@mail-1.example.com", "@", ".", "_", "1.2.3.4", "999.1.1.1", "0255.001.2.3", "4539 1488 0343 6467", "4539148803436467", "+1 (555) 555-0199",
              "+49.30.1234567", "555-0199", "tel. (030) 123-4567", "\U0001f600", "é", " ", "-", "12", "+", "\n", "2001:db8:0:1:1:1:1:1", "a (at) b.org"]
    rows = [(i, "".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(rng.randrange(12)))) for i in range(300)]
    rows += [(r["doc_id"] + 1000, r["text"]) for r in docs.collect()] + [(i, t) for i, t in ODD]
    table = spark.createDataFrame([(i, t, "b") for i, t in rows], "doc_id long, text string, base string")
    got = pii.personal_data(table).collect()
    assert len(got) == len(rows)
    assert sorted(repr((r["doc_id"], [tuple(s) for s in r["base"]])) for r in got) == sorted(repr((i, brute_spans(t))) for i, t in rows)
    assert all(set(r["base"]) <= set(r["spans"]) and list(r["spans"]) == sorted(r["spans"]) for r in got)
    assert pii.personal_data(table.limit(0)).count() == 0


def test_more_personal_data_is_selected_and_redacted(spark):
    rows = [(i, f"call me: +1 (555) 555-{1000 + i} today") for i in range(80)] + [(100, "call me: (555) 555-0199 today"), (101, "paid 12 of 1999 in 4 parts")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(table).collect()}
    assert got[101] == [] and [s["kind"] for s in got[5]] == ["phone"]
    shown = table.join(pii.personal_data(table), "doc_id").select("doc_id", pii.redacted(table["text"], "spans").alias("text"))
    assert {r["doc_id"]: r["text"] for r in shown.collect()}[5] == "call me: [phone] today"


def test_disguised_personal_data_is_added(spark):
    rows = [(i, f"write to mary.{i}@mail.example.org or call +49 30 123-4{i:03d} now, lot 12.{i}.999.7 of batch 1234 5678 {i:04d}") for i in range(120)]
    more = {
        200: ("write to john (at) example (dot) org now", "email:9:36"), 201: ("ask ann [at] site.example [dot] net please", "email:4:35"),
        202: ("tel. (030) 123-4567 at any time", "phone:5:19"), 203: ("server 10 . 20 . 30 . 40 is down", "ip:7:24"),
        204: ("the years 2019 2020 2021 were good", ""), 205: ("numbers 1, 2, 3, 4 and 900, 800, 700, 600", ""), 206: ("card 4111.1111.1111.1111 was lost", "card:5:24"),
        207: ("version 300.400.500.600 of it", ""), 208: ("host fe80:0:0:0:1:2:3:4 answers", "ip:5:23"),
    }
    table = spark.createDataFrame(rows + [(i, t) for i, (t, _) in more.items()], "doc_id long, text string")
    got = {r["doc_id"]: (r["spans"], r["base"]) for r in pii.personal_data(table).select("doc_id", pii.shown("spans").alias("spans"), pii.shown("base").alias("base")).collect()}
    assert {i: got[i][0] for i in more} == {i: spans for i, (_, spans) in more.items()}
    assert {i: got[i] for i, _ in rows if got[i][0] != got[i][1]} == {}
    assert all("email:" in got[i][1] and "phone:" in got[i][1] and "ip:" not in got[i][1] for i, _ in rows)


def test_places_of_many_matches_in_one_text(spark):
    text = "".join(f"{'é' * (i % 5)} a{i}@b.example, 300.1.1.{i % 300} 10.0.0.{i % 300};" for i in range(700))
    got, = pii.personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    places = [(m.start(), "email", m.end()) for m in re.finditer(r"a[0-9]+@b\.example", text)]
    places += [(m.start(), "ip", m.end()) for m in re.finditer(r"(?<![0-9])10\.0\.0\.([0-9]+)", text) if int(m[1]) < 256]
    assert [(s["start"], s["kind"], s["end"]) for s in got["base"]] == sorted(places)


# --- 7: fuzzy lines


def brute_lines(rows, share=0.8, k=fuzzy_lines.SHINGLE):
    places = [(i, n, line) for i, t in rows if t is not None for n, line in enumerate(t.split("\n")) if line.strip(" ")]
    lines = sorted({line for _, _, line in places})
    sets = {line: {line[j : j + k] for j in range(len(line) - k + 1)} or {line} for line in lines}
    pairs = [(a, b) for a, b in itertools.combinations(lines, 2) if len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]) - 1e-9]
    component = spread_components(pairs, lines)
    dropped, seen = {}, set()
    for i, n, line in sorted((p for p in places if p[0] is not None), key=lambda p: p[:2]):
        if component[line] in seen:
            dropped.setdefault(i, []).append(n)
        seen.add(component[line])
    return dropped


def test_fuzzy_lines(spark, docs):
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdefgh     ABC9") for _ in range(rng.randrange(20, 120))) for _ in range(25)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(6)):
            line = list(rng.choice(base))
            for _ in range(rng.randrange(3)):
                line[rng.randrange(len(line))] = rng.choice("xyz")
            lines.append("".join(line))
        rows.append((i, "\n".join(lines)))
    rows += [(70, None), (71, ""), (72, "\n\n"), (73, "ab\nab\nab"), (None, base[0] + "\n" + base[0]), (74, "你好世界你好 " * 400)]
    table = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, at int")
    found = fuzzy_lines.repeated_lines(table)
    assert {r["doc_id"]: r["dropped"] for r in found.collect()} == brute_lines(rows)
    cut = fuzzy_lines.drop_lines(table, found)
    assert cut.columns == ["doc_id", "text", "at", "dropped_lines"] and cut.count() == len(rows)
    assert {r["doc_id"]: r["text"] for r in cut.collect()}[73] == "ab"
    assert fuzzy_lines.repeated_lines(table.limit(0)).count() == 0


def test_fuzzy_lines_leave_their_signatures_before_they_link(spark, docs, monkeypatch):
    """The signatures and their shuffle are off the disk when lines are linked, and buckets are found for some bands at a time."""
    asked, link = [], fuzzy_lines.linked_components

    def linked(buckets, *rest):
        root = pathlib.Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
        asked.append((list(root.glob("line-signatures-*")), buckets.columns))
        return link(buckets, *rest)

    monkeypatch.setattr(fuzzy_lines, "linked_components", linked)
    rows = [(i, f"The first line of document {i} goes on for a while.\nEach has this common line in it, more or less {i % 3}.") for i in range(30)]
    fuzzy_lines.line_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert asked == [([], ["bucket", "id", "sketch", "sketch2", "size"])]


def test_fine_sketches_tell_unlike_sets_apart(spark):
    """A bucket of two sets of which 12 of 30 MinHash values agree is done; one of like sets is not."""
    least = [(0, 1, [*range(30)]), (0, 2, [*range(12), *range(100, 118)]), (1, 3, [*range(30)]), (1, 4, [*range(25), *range(200, 205)])]
    found = spark.createDataFrame(least, "bucket long, id long, m array<long>")
    fine = found.select("bucket", "id", *linking.fine_sketches([F.col("m")[i] for i in range(30)]))
    coarse = found.select("bucket", "id", linking.sketch([F.col("m")[i] for i in range(30)]).alias("sketch"))
    assert {r.id for r in linking.shared_buckets(fine).collect()} == {3, 4}
    assert {r.id for r in linking.shared_buckets(coarse).collect()} == {1, 2, 3, 4}


def test_groups_of_alike_lines_lose_no_link(spark, monkeypatch):
    """Variants of one line that are mostly alike but not linked, joined by their differences from one near the middle."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("aeiobdlnrt") for _ in range(rng.randrange(2, 9)))
    base = [word() for _ in range(60)]
    change = lambda words, p: [word() if rng.random() < p else w for w in words if rng.random() > p / 4]
    variants = [change(base, rng.choice([0.03, 0.08, 0.12, 0.15])) for _ in range(90)]
    variants += [change(v, 0.03) for v in variants[:30]] + [base[:i] for i in range(44, 60, 2)]
    rows = [(i, " ".join(words)) for i, words in enumerate(variants)]
    told, link = [], fuzzy_lines.linked_components

    def linked(buckets, sets, ratio, verify, differences):
        def counted(pairs):
            told.append(pairs.count())
            return differences(pairs)
        return link(buckets, sets, ratio, verify, counted)

    monkeypatch.setattr(fuzzy_lines, "linked_components", linked)
    monkeypatch.setattr(linking, "COMPARED_IN_FULL", 2)
    found = fuzzy_lines.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["dropped"] for r in found.collect()} == brute_lines(rows)
    assert told and told[0] > 0


def test_a_large_bucket_is_not_compared_in_full(spark):
    """One bucket of sets that are all near by their sketches, most of them not linked."""
    rng = random.Random(5)
    centre = set(range(60))
    sets = {i: {x for x in centre if rng.random() > rng.choice([0.02, 0.1, 0.2])} | {100 + rng.randrange(900) for _ in range(rng.randrange(14))} for i in range(150)}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    similar = spark.createDataFrame(links, "a long, b long")
    whole = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, elements array<long>")
    of = whole.select(F.col("id").alias("c"), F.col("elements").alias("of_c"))
    told = [F.size("elements").alias("size"), F.array_except("elements", "of_c").alias("new"), F.size(F.array_except("of_c", "elements")).alias("missing")]
    compared = []

    def verify(pairs):
        compared.append(pairs.count())
        return pairs.join(similar, ["a", "b"])

    table = spark.createDataFrame([(1, i, 1, 0, 0) for i in sets], "bucket long, id long, size int, sketch long, sketch2 long")
    found, _ = linking.linked_components(table, None, 0.8, verify, lambda pairs: pairs.join(whole, "id").join(of, "c").select("c", "id", *told))
    got = {r["id"]: r["component"] for r in found.collect()}
    assert all(got.get(n, n) == c for n, c in spread_components(links, sets).items())
    assert compared[-1] < 4500  # 9,030 pairs of the bucket are of different components


@pytest.mark.parametrize("seed", range(3))
def test_differing_pairs_lose_no_similar_pair(spark, seed):
    rng = random.Random(seed)
    centre = set(range(60))
    sets = {0: centre}
    for i in range(1, 120):
        near = sets[rng.randrange(i)] if rng.random() < 0.6 else centre
        sets[i] = {x for x in near if rng.random() > rng.choice([0, 0.05, 0.15])} | {100 + rng.randrange(150) for _ in range(rng.randrange(14))}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9
    links = {(a, b) for a, b in itertools.combinations(sets, 2) if alike(a, b)}
    part = spread_components([p for p in links if 0 in p], sets)
    rows = [(0, 0, i, part[i], 0, 0, len(s), sorted(s - centre), len(centre - s)) for i, s in sets.items()]
    names = "c long, c_part long, id long, part long, sketch long, sketch2 long, size int, new array<long>, missing int"
    got = {(r.a, r.b) for r in linking._differing_pairs(spark.createDataFrame(rows, names), 0.8).collect()}
    apart = {(a, b) for a, b in links if part[a] != part[b]}
    assert apart and apart <= got and all(part[a] != part[b] for a, b in got)
    assert len(got) < 0.5 * sum(part[a] != part[b] for a, b in itertools.combinations(sets, 2))


def test_fuzzy_lines_of_documents(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.limit(60).collect()]
    got = {r["doc_id"]: r["dropped"] for r in fuzzy_lines.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_lines(rows)


def test_a_line_of_seventy_characters_may_differ_in_one(spark):
    line = "the quiet river turns north behind the old mill and the stone bridge near"
    rows = [(1, line), (2, line.replace("old", "odd")), (3, line.replace("mill", "hill")), (4, "another line that has nothing to do with any river, mill or stone")]
    assert brute_lines(rows, k=5) == {2: [0], 3: [0]}
    found = fuzzy_lines.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["dropped"] for r in found.collect()} == brute_lines(rows, k=5)


def test_similar_short_lines_share_buckets(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("aeiobdlnrt") for _ in range(rng.randrange(2, 9)))
    cut = lambda line: {line[j : j + 5] for j in range(len(line) - 4)}
    pairs = []
    while len(pairs) < 300:
        words = [word() for _ in range(rng.randrange(6, 14))]
        line = " ".join(words)
        words[rng.randrange(len(words))] = word()
        a, b = cut(line), cut(" ".join(words))
        if 0.8 <= len(a & b) / len(a | b) < 1:
            pairs.append((line, " ".join(words)))
    # All in lower case: an unbroken line has its start as only anchor.
    unbroken = "".join(rng.choice("aeiobdlnrt") for _ in range(300))
    pairs.append((unbroken, "x" + unbroken[1:]))
    rows = [(2 * i + side, line) for i, pair in enumerate(pairs) for side, line in enumerate(pair)]
    found = fuzzy_lines.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), shingle=5)
    dropped = {r["doc_id"] for r in found.collect()}
    assert dropped <= {2 * i + 1 for i in range(len(pairs))} and 601 in dropped and len(dropped) >= 299


# --- 2: licences


def test_licences(spark):
    rows = [
        ("a/b/c/x.py", "# Licensed under the Apache License, Version 2.0.\ncode follows here"), ("a/b/c/y.py", "nothing of that kind"), ("a/LICENSE", "Released under the MIT License."),
        ("a/z.py", None), ("q/w.py", ""), (None, "Released under the MIT License."), ("a/b/COPYING", "Some words.\nThis work is licensed under the GNU General Public License, version 3."),
        ("top", "The license is mentioned in a long line of other words about many things that have nothing to do with it"),
    ]
    filler = [(f"z/{i}/f.py", f"line {i} of the plain text\nunder and this work in {i}") for i in range(60)]
    table = spark.createDataFrame([(p, t, 1) for p, t in rows + filler], "path string, text string, score int")
    got = {r["path"]: (r["licence"], r["origin"]) for r in licences.scan_licences(table).collect()}
    assert got["a/b/c/x.py"] == ("Apache-2.0", "header") and got["a/LICENSE"] == ("MIT", "file") and got[None] == ("MIT", "file")
    assert got["a/b/c/y.py"] == ("GPL-3.0", "inherited") and got["a/z.py"] == ("MIT", "inherited") and got["a/b/COPYING"][0] == "GPL-3.0"
    assert got["q/w.py"] == got["top"] == got["z/3/f.py"] == (None, None)
    assert licences.scan_licences(table.limit(0)).count() == 0


def test_licence_texts_header_blocks_tags_and_notices_inside_lines(spark):
    texts, blocks = dict(licences.licence_texts()), dict(licences.HEADERS)
    wrapped = "\n".join("# " + " ".join(blocks["GPL-3.0"].split()[i : i + 12]) for i in range(0, 120, 12))
    notice = "This work is licensed under a Creative Commons Attribution 4.0 International License."
    rows = [
        ("b/LICENSE", "Copyright (c) 2020 Some Body\n" + texts["BSD-3-Clause"], "BSD-3-Clause"), ("m/terms", "MIT License\n\nCopyright (c) 2021 Some Body\n\n" + texts["MIT"], "MIT"),
        ("g/COPYING", texts["GPL-3.0"][:2500], "GPL-3.0"), ("a/LICENSE", texts["Apache-2.0"], "Apache-2.0"), ("h/x.py", wrapped + "\nimport os\n" * 30, "GPL-3.0"),
        ("s/x.c", "// SPDX-License-Identifier: MIT\nint main;", "MIT"), ("s/y.c", "// SPDX-License-Identifier: Zlib\nint main;", None),
        ("c/page", "many other words stand in front of it in one long paragraph about rivers " * 3 + notice + " and behind it come some more about hills" * 3, "CC-BY-4.0"),
        *((f"own{i}/LICENSE", text, name) for i, (name, text) in enumerate(licences.licence_texts())),
        ("b/x.py", "nothing of that kind", "BSD-3-Clause"), ("m/x.py", "nothing of that kind", "MIT"), ("g/x.py", "nothing of that kind", "GPL-3.0"),
    ]
    filler = [(f"z/{i}/f.py", f"line {i} of the plain text\nunder and this work in {i}", None) for i in range(60)]
    table = spark.createDataFrame([r[:2] for r in rows + filler], "path string, text string")
    got = {r["path"]: r["licence"] for r in licences.scan_licences(table).collect()}
    assert got == {path: licence for path, _, licence in rows + filler}


def test_licences_quoted_from_their_middle(spark):
    texts = dict(licences.licence_texts())
    prose = " ".join(f"river{i % 97} hill{i % 89} and the road" for i in range(120))
    rows = []
    for name, text in texts.items():
        words = text.split()
        if len(words) > licences.LONGEST:
            rows.append((f"opening/{name}", f"{prose}\n{'other opening words ' * 60}{' '.join(words[170:])}\n{prose}", name))
    gpl = texts["GPL-3.0"].split()
    middle = next(i for i in range(400, 4000) if "GNU General Public License" in " ".join(gpl[i + 75 : i + 150]))
    rows += [("quote/x", f"{prose} {' '.join(gpl[middle : middle + 300])} {prose}", "GPL-3.0"), ("prose/x", prose * 5, None)]
    filler = [(f"z/{i}/f.py", f"line {i} of the plain text\nunder and this work in {i}", None) for i in range(60)]
    table = spark.createDataFrame([r[:2] for r in rows + filler], "path string, text string")
    got = {r["path"]: r["licence"] for r in licences.scan_licences(table).collect()}
    assert got == {path: licence for path, _, licence in rows + filler}


def test_cosines_of_a_long_text_have_bounded_memory():
    import tracemalloc
    parts = licences.template_parts(licences.TEMPLATES + licences.licence_texts())
    parts |= {"idf": np.linspace(1, 4, len(parts["vocabulary"])), "rarest": 5.0, "threshold": 0.75}
    units = parts["counts"] * parts["idf"]
    parts["units"] = units / np.linalg.norm(units, axis=1, keepdims=True)
    data = np.frombuffer(b"Licensed under the work\n" * 100_000, np.uint8)
    words, unit, doc = licences._units(data, np.array([0, len(data)]))
    tracemalloc.start()
    licences.cosines(words, unit, len(doc), parts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * len(data)


def test_licence_cosines_equal_plain_counting(spark):
    parts = licences.template_parts(licences.TEMPLATES)
    parts |= {"idf": np.linspace(1, 4, len(parts["vocabulary"])), "rarest": 5.0, "threshold": 0.3}
    units = parts["counts"] * parts["idf"]
    parts["units"] = units / np.linalg.norm(units, axis=1, keepdims=True)
    texts = [t for _, t in licences.TEMPLATES] + ["Licensed under CC BY 4.0 by me, myself and I", "no such words", "license license license of mine"]
    data = np.frombuffer("\n".join(texts).encode(), np.uint8)
    words, unit, doc = licences._units(data, np.array([0, len(data)]))
    best, which = licences.cosines(words, unit, len(doc), parts)
    for i, text in enumerate(texts):
        cut = re.findall(r"[0-9a-z]+", text.lower())
        words_of = [re.findall(r"[0-9a-z]+", t.lower()) for _, t in licences.TEMPLATES]
        hashes = {w: licences.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]), *licences._byte_classes())[0][0] for w in cut + sum(words_of, [])}
        weight = lambda w: parts["idf"][np.searchsorted(parts["vocabulary"], hashes[w])] if hashes[w] in parts["vocabulary"] else 5.0
        vector = lambda ws: {w: ws.count(w) * weight(w) for w in ws}
        cosine = lambda x, y: sum(x[w] * y.get(w, 0) for w in x) / np.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
        exact = max(cosine(vector(cut), vector(w)) for w in words_of)
        assert best[i] == pytest.approx(exact) or (best[i] == 0 and exact < 0.3)
