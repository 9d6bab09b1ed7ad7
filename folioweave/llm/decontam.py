"""Benchmark decontamination with suffix arrays over shards of the training text.

Every task cuts its documents into shards of whole documents, sorts all word suffixes of a shard, and looks up every suffix
of the test items by binary search: a range of the array holds all places where its window stands, a narrower one those of its
longest match.
Documents never leave their task, so the job has no shuffle; only the test items travel, in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioweave.llm.tables import written
from folioweave.llm.words import chunks, shingle_hashes, word_hashes

WINDOW = 10

#: Words of test items in one broadcast block (8 bytes each, some six times that once indexed); more items make more blocks.
BLOCK_WORDS = 2_000_000

FOUND = "struct<n_words:long,spans:array<struct<first:long,last:long>>,items:array<long>>"


def _byte_classes() -> tuple[np.ndarray, np.ndarray]:
    """Words are runs of ASCII letters, digits and all bytes of characters beyond ASCII; A-Z are lower-cased."""
    values = np.arange(256, dtype=np.uint8)
    values[65:91] += 32
    inside = np.zeros(256, bool)
    inside[48:58] = inside[65:91] = inside[97:123] = inside[128:] = True
    return values, inside


def _tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, offsets in chunks(batch.column("text")):
            words, firsts = word_hashes(data, offsets, *_byte_classes())
            lists = pa.ListArray.from_arrays(firsts.astype(np.int32), pa.array(words.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("item_id").slice(first, last - first), lists], ["item_id", "words"])


class Suffixes:
    """The suffixes of a block of test items, ready to be searched for: plain arrays, which travel as a dictionary.

    ``words`` are the words of all items one after the other, ``rest`` how many stand from each to its item's end. A window
    begins at ``starts`` and has ``sizes`` words; windows of equal words have one number in ``which`` and one place in ``one``.
    """

    def __init__(self, ids: np.ndarray, words: np.ndarray, firsts: np.ndarray, window: int) -> None:
        counts = np.diff(firsts)
        self.words, self.ids, self.firsts = words, ids, firsts
        self.rest = np.repeat(firsts[1:], counts) - np.arange(len(words))
        keys, begin = shingle_hashes(words, firsts, window)
        text = np.repeat(np.arange(len(counts)), np.diff(begin))
        self.starts = np.arange(len(keys)) - begin[text] + firsts[text]
        _, one, which = np.unique(keys, return_index=True, return_inverse=True)
        self.which = which.reshape(-1)
        self.one, self.lengths = self.starts[one], np.minimum(counts[text], window)[one]
        pairs = np.unique(np.stack([self.which, ids[text]], axis=1), axis=0) if len(keys) else np.empty((0, 2), np.int64)
        self.items, self.item_bounds = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(one) + 1))


class Shard:
    """The suffix array of the words of some whole documents, and the places of test suffixes in it.

    Every document ends in a mark that no test holds. Suffixes are sorted by their first word, then by 2, 4, 8, .. words: two
    equal runs have one rank (the first place of their group in the array), so a run of twice the length is a pair of ranks.
    Only groups of several are sorted again. Test suffixes are looked up along the way, so sorting ends at the first depth to
    which no test suffix reaches; nothing that can match is left unsorted.
    """

    def __init__(self, words: np.ndarray, firsts: np.ndarray, tests: Suffixes | SimpleNamespace) -> None:
        owner = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
        vocabulary, code = np.unique(words, return_inverse=True)
        text = np.zeros(len(words) + len(firsts) - 1, np.int64)
        self.base = firsts[:-1] + np.arange(len(firsts) - 1)  # where each document begins among words and marks
        text[np.arange(len(words)) + owner] = code.reshape(-1) + 1
        self.tests, self.order = tests, np.argsort(text, kind="stable")
        heads = self._heads(text[self.order])
        ranks = np.empty(len(text), np.int64)
        ranks[self.order] = heads
        self.ranks, self.wanted = [ranks], []
        at = np.minimum(np.searchsorted(vocabulary, tests.words), len(vocabulary) - 1)
        wanted = np.where(vocabulary[at] == tests.words, np.searchsorted(text[self.order], at + 1), -1)
        while (wanted >= 0).any():
            self.wanted.append(wanted)
            wanted = self._doubled(wanted, 1 << (len(self.wanted) - 1))

    @staticmethod
    def _heads(keys: np.ndarray) -> np.ndarray:
        """For each place of sorted keys the first place with the same key."""
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        return np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))

    def _doubled(self, wanted: np.ndarray, depth: int) -> np.ndarray:
        """Sort by twice the depth; the ranks of test runs of that length, or -1."""
        ranks, order, n = self.ranks[-1], self.order, len(self.order)
        behind = np.zeros(n, np.int64)
        behind[: max(0, n - depth)] = ranks[depth:] + 1
        key = ranks * (n + 1) + behind
        heads = ranks[order]
        several = np.concatenate([heads[1:] == heads[:-1], [False]])
        several[1:] |= several[:-1]
        slots = np.flatnonzero(several)
        members = order[slots]
        order[slots] = members[np.argsort(key[members], kind="stable")]
        ordered = key[order]
        longer = np.empty(n, np.int64)
        longer[order] = self._heads(ordered)
        self.ranks.append(longer)
        out = np.full(len(wanted), -1, np.int64)
        first = np.flatnonzero((wanted >= 0) & (self.tests.rest >= 2 * depth))
        first = first[wanted[first + depth] >= 0]
        pair = wanted[first] * (n + 1) + wanted[first + depth] + 1
        place = np.minimum(np.searchsorted(ordered, pair), n - 1)
        out[first] = np.where(ordered[place] == pair, place, -1)
        return out

    def _narrowed(self, low: np.ndarray, high: np.ndarray, done: np.ndarray, rank: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Binary search of many test suffixes at once: where in [low, high), whose suffixes share ``done`` words, ``rank`` follows."""
        bounds = []
        for right in (False, True):
            a, b = low.copy(), high.copy()
            while len(going := np.flatnonzero(a < b)):
                middle = (a[going] + b[going]) // 2
                value = self.ranks[level][self.order[middle] + done[going]]
                less = value <= rank[going] if right else value < rank[going]
                a[going[less]] = middle[less] + 1
                b[going[~less]] = middle[~less]
            bounds.append(a)
        return bounds[0], bounds[1]

    def _reached(self, at: np.ndarray, low: np.ndarray, high: np.ndarray, done: np.ndarray, level: int, ask: np.ndarray) -> np.ndarray:
        """Lengthen the matches of the test suffixes ``at`` by 2^level words where ``ask`` and possible; says where."""
        size, depth = 1 << level, 1 << len(self.wanted)  # no match has ``depth`` words
        ask = ask & (low < high) & (done + size <= np.minimum(self.tests.rest[at], depth - 1))
        go = np.flatnonzero(ask)
        rank = self.wanted[level][at[go] + done[go]] if level < len(self.wanted) else np.full(len(go), -1)
        go, rank = go[rank >= 0], rank[rank >= 0]
        first, last = self._narrowed(low[go], high[go], done[go], rank, level)
        found = first < last
        go = go[found]
        low[go], high[go] = first[found], last[found]
        done[go] += size
        out = np.zeros(len(at), bool)
        out[go] = True
        return out

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(low, high): the range of the array in which each distinct test window stands."""
        tests = self.tests
        low, high, done = np.zeros(len(tests.one), np.int64), np.full(len(tests.one), len(self.order)), np.zeros(len(tests.one), np.int64)
        for level in reversed(range(int(tests.lengths.max(initial=1)).bit_length())):
            ask = (tests.lengths >> level & 1) == 1
            lost = ask & ~self._reached(tests.one, low, high, done, level, ask)
            high[lost] = low[lost]
        return low, high

    def longest(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(test word, words, low, high) of every test suffix whose window stands in the shard: its longest match and where.

        A longest match is its window and at most one run of each power of two behind it, the longest first.
        """
        tests = self.tests
        known = np.flatnonzero((low < high)[tests.which])
        at, number = tests.starts[known], tests.which[known]
        low, high, done = low[number], high[number], tests.lengths[number].astype(np.int64)
        for level in reversed(range(len(self.wanted))):
            self._reached(at, low, high, done, level, np.ones(len(at), bool))
        return at, done, low, high

    def places(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, word number in it) of slots of the array."""
        doc = np.searchsorted(self.base, self.order[slots], "right") - 1
        return doc, self.order[slots] - self.base[doc]


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(every slot of the ranges, number of its range)."""
    found = high - low
    of = np.repeat(np.arange(len(found)), found)
    return np.arange(found.sum()) - np.repeat(np.cumsum(found) - found, found) + low[of], of


def occurrences(words: np.ndarray, firsts: np.ndarray, tests: Suffixes | SimpleNamespace) -> tuple[np.ndarray, np.ndarray]:
    """(word position, window number) of all places in a shard where a test window stands."""
    if not len(words) or not len(tests.lengths):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    shard = Shard(words, firsts, tests)
    slots, window = _spread(*shard.windows())
    doc, place = shard.places(slots)
    return firsts[doc] + place, window


def _longest(batches: Iterator[pa.RecordBatch], parts: dict) -> Iterator[pa.RecordBatch]:
    """The longest match of each item in each shard: of equal ones that of the least doc_id, word and item word."""
    tests = SimpleNamespace(**parts)
    names = ["item_id", "words", "doc_id", "at", "item_at"]
    for batch in batches:
        for first, last, data, offsets in chunks(batch.column("text")):
            words, firsts = word_hashes(data, offsets, *_byte_classes())
            if not len(words) or not len(tests.lengths):
                continue
            ids = batch.column("doc_id").slice(first, last - first).to_numpy(zero_copy_only=False)
            shard = Shard(words, firsts, tests)
            at, done, low, high = shard.longest(*shard.windows())
            item = np.searchsorted(tests.firsts, at, "right") - 1
            most = np.zeros(len(tests.ids), np.int64)
            np.maximum.at(most, item, done)
            best = done == most[item]
            at, done, item, low, high = (x[best] for x in (at, done, item, low, high))
            ranges, of = np.unique(np.stack([low, high], axis=1), axis=0, return_inverse=True)
            homes = np.empty((len(ranges), 2), np.int64)
            for i, (a, b) in enumerate(ranges):
                doc, place = shard.places(np.arange(a, b))
                least = np.lexsort((place, ids[doc]))[0]
                homes[i] = ids[doc[least]], place[least]
            home = homes[of.reshape(-1)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (tests.ids[item], done, home[:, 0], home[:, 1], at - tests.firsts[item])], names)


def _searched(batches: Iterator[pa.RecordBatch], parts: dict, name: str) -> Iterator[pa.RecordBatch]:
    """Add what one block of tests finds, under ``name``, to the spans and items that earlier blocks have found."""
    tests = SimpleNamespace(**parts)
    for batch in batches:
        earlier = batch.column(name) if name in batch.schema.names else None
        rest = batch.drop_columns([name]) if earlier is not None else batch
        for first, last, data, offsets in chunks(batch.column("text")):
            words, firsts = word_hashes(data, offsets, *_byte_classes())
            places, window = occurrences(words, firsts, tests)
            n_docs, base = last - first, firsts[:-1]
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, places, 1)
            np.add.at(change, places + tests.lengths[window], -1)
            items: list[set[int]] = [set() for _ in range(n_docs)]
            if earlier is not None:
                for d, before in enumerate(earlier.slice(first, n_docs).to_pylist()):
                    items[d].update(before["items"])
                    for s in before["spans"]:
                        change[base[d] + s["first"]] += 1
                        change[base[d] + s["last"] + 1] -= 1
            owner = np.searchsorted(firsts, places, "right") - 1
            for d, w in np.unique(np.stack([owner, window], axis=1), axis=0) if len(places) else ():
                items[d].update(tests.items[tests.item_bounds[w] : tests.item_bounds[w + 1]].tolist())
            hit = np.cumsum(change[:-1]) > 0
            edge = np.zeros(len(words) + 1, bool)
            edge[firsts] = True
            begins, ends = hit.copy(), hit.copy()
            begins[1:] &= ~hit[:-1] | edge[1:-1]
            ends[:-1] &= ~hit[1:] | edge[1:-1]
            begins, ends = np.flatnonzero(begins), np.flatnonzero(ends)
            of = np.searchsorted(firsts, begins, "right") - 1
            bounds = np.searchsorted(of, np.arange(n_docs + 1)).astype(np.int32)
            spans = pa.StructArray.from_arrays([pa.array(begins - base[of]), pa.array(ends - base[of])], ["first", "last"])
            found = pa.StructArray.from_arrays(
                [pa.array(np.diff(firsts)), pa.ListArray.from_arrays(bounds, spans), pa.array([sorted(s) for s in items], pa.list_(pa.int64()))],
                ["n_words", "spans", "items"])
            yield pa.RecordBatch.from_arrays([*rest.slice(first, n_docs).columns, found], [*rest.schema.names, name])


def _blocks(tests: DataFrame, window: int) -> list[Broadcast]:
    """The test items with words, broadcast in blocks of about BLOCK_WORDS words."""
    spark = tests.sparkSession
    kept = tests.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = written(kept.mapInArrow(_tokenised, "item_id long, words array<long>").where(F.size("words") > 0), "tests")
    total = items.select(F.sum(F.size("words"))).first()[0] or 0
    blocks, out = max(1, -(-total // BLOCK_WORDS)), []
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toArrow()
        lists = rows.column("words").combine_chunks()
        words = lists.flatten().to_numpy().view(np.uint64)
        firsts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
        out.append(spark.sparkContext.broadcast(vars(Suffixes(rows.column("item_id").to_numpy(), words, firsts, window))))
    return out


def contamination(docs: DataFrame, tests: DataFrame, window: int = WINDOW, name: str = "found") -> DataFrame:
    """``docs`` with a column ``name`` (n_words, spans, items), row by row: where test items stand verbatim.

    ``docs`` has a text, ``tests`` has (item_id, text); other columns of ``docs`` stay as they are (one called ``name``
    is replaced), those of ``tests`` are ignored. A window is ``window`` consecutive words of an item; an item of fewer words,
    but not none, is one window. ``spans`` are the maximal runs of words inside any occurrence (word numbers from 0, both
    ends inclusive), ``items`` the item_ids with an occurring window, ascending.

    * Null and empty texts have no words and no spans; items without words or id are not looked for.
    * Repeated rows of either table are judged each by its text; a repeated item_id is listed once.
    * Empty tables give an empty result, or one without spans.
    """
    docs = docs.drop(name)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{name}` {FOUND}"])
    for sent in _blocks(tests, window):
        docs = docs.mapInArrow(lambda batches, sent=sent: _searched(batches, sent.value, name), schema)
    return docs


def longest_matches(docs: DataFrame, tests: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, words, doc_id, at, item_at): the longest verbatim match of each test item in the texts of ``docs`` (doc_id, text).

    A match has at least ``window`` words, or is a whole item of fewer; items without any are not in the result. ``words`` is its
    length, ``at`` and ``item_at`` are the numbers of its first word in the document and the item (from 0). Of equally long
    ones that with the least doc_id, then at, then item_at counts, however the documents are cut into shards.

    * Rows without a doc_id or without words hold no match; rows that repeat a doc_id are read each.
    * Rows that repeat an item_id are one item: its longest match is that of any of them. Other columns are ignored.
    * Empty tables give an empty result.
    """
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "item_id long, words long, doc_id long, at long, item_at long"
    found = [rows.mapInArrow(lambda batches, sent=sent: _longest(batches, sent.value), schema) for sent in _blocks(tests, window)]
    best = reduce(DataFrame.unionAll, found).groupBy("item_id").agg(F.min(F.struct((-F.col("words")).alias("minus"), "doc_id", "at", "item_at")).alias("best"))
    return best.select("item_id", (-F.col("best.minus")).alias("words"), "best.doc_id", "best.at", "best.item_at")


def span_words(spans: Column) -> Column:
    """Number of words inside the spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)


def clean_documents(docs: DataFrame, tests: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in whose text no test item stands; each row is judged by its own text."""
    name = "found"
    while name in docs.columns:
        name += "_"
    return contamination(docs, tests, window, name).where(F.size(F.col(name)["spans"]) == 0).drop(name)
