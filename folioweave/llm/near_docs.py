"""Near-duplicate documents by SuperMinHash: signatures, banding, verification on whole sets, union-find.

A SuperMinHash signature lets every set element take its slots in the order of a random permutation of its own, at rank
0, 1, 2, ... plus a random fraction, and keeps the least value of each slot. Ranks are correlated over the slots, which lowers
the variance of the estimate; and once every slot holds a value below rank r, no later rank can change it, so that a set of
hundreds of elements is done after two or three ranks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.llm.components import connected_components
from folioweave.llm.linking import SKETCHED, linked_components, shared_buckets
from folioweave.llm.tables import scoped, small_side, written
from folioweave.llm.words import chunks, mixed, shingle_hashes, word_hashes

WORDS = 5
BANDS, ROWS = 20, 4

#: Elements whose permutations are held at once.
_BLOCK = 1 << 17


def _byte_classes() -> tuple[np.ndarray, np.ndarray]:
    """(byte with A-Z lower-cased, whether the byte belongs to a word): words are parted by space and \\t to \\r."""
    values = np.arange(256, dtype=np.uint8)
    values[65:91] += 32
    inside = np.ones(256, bool)
    inside[[32, *range(9, 14)]] = False
    return values, inside


def distinct_shingles(data: np.ndarray, offsets: np.ndarray, length: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, firsts = word_hashes(data, offsets, *_byte_classes())
    hashes, begin = shingle_hashes(words, firsts, length)
    out = []
    for i in range(len(begin) - 1):
        own = np.sort(hashes[begin[i] : begin[i + 1]])
        out.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own)
    return out


def superminhash(elements: np.ndarray, owner: np.ndarray, n_sets: int, slots: int) -> np.ndarray:
    """Signatures (n_sets x slots) of sets given as element hashes, grouped by ``owner`` in ascending order."""
    signature = np.full((n_sets, slots), np.inf)
    bounds = np.searchsorted(owner, np.arange(n_sets + 1))
    first = 0
    while first < n_sets:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + _BLOCK, "right")) - 1)
        _fill(signature[first:last], elements[bounds[first] : bounds[last]], owner[bounds[first] : bounds[last]] - first, slots)
        first = last
    return signature


def _fill(signature: np.ndarray, elements: np.ndarray, owner: np.ndarray, slots: int) -> None:
    order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.int32), (len(elements), 1))
    flat = signature.reshape(-1)
    for rank in range(slots):
        if not len(elements):
            return
        draw = mixed(elements, 1000 + rank)
        row = np.arange(len(elements))
        chosen = rank + ((draw >> np.uint64(40)) % np.uint64(slots - rank)).astype(np.int64)
        slot = order[row, chosen].copy()
        order[row, chosen] = order[:, rank]
        order[:, rank] = slot
        value = rank + (draw & np.uint64((1 << 40) - 1)).astype(np.float64) / (1 << 40)
        np.minimum.at(flat, owner * slots + slot, value)
        done = signature.max(axis=1) <= rank + 1
        if done.any():
            stay = ~done[owner]
            elements, owner, order = elements[stay], owner[stay], order[stay]


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket key for each band of each signature."""
    bits = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), bits.shape[:2]).copy()
    for r in range(rows):
        key = mixed(key ^ bits[:, :, r], 2000 + r)
    return key.view(np.int64)


def sketches(signature: np.ndarray) -> np.ndarray:
    """Three bits of each of the first values of each signature, side by side."""
    bits = mixed(np.ascontiguousarray(signature[:, :SKETCHED]).view(np.uint64), 3000) & np.uint64(7)
    return np.bitwise_or.reduce(bits << (3 * np.arange(bits.shape[1], dtype=np.uint64)), axis=1).view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch], words: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, offsets in chunks(batch.column("text")):
            sets = distinct_shingles(data, offsets, words)
            sizes = np.array([len(s) for s in sets])
            owner = np.repeat(np.arange(len(sets)), sizes)
            signature = superminhash(np.concatenate(sets), owner, len(sets), bands * rows)
            keys = band_keys(signature, bands, rows)
            full = sizes > 0
            lists = pa.ListArray.from_arrays(
                np.concatenate([[0], np.cumsum(full * bands)]).astype(np.int32), pa.array(keys[full].reshape(-1)))
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(first, last - first), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), lists,
                 pa.array(sketches(signature))],
                ["doc_id", "n_shingles", "set_key", "bands", "sketch"])


def signatures(docs: DataFrame, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands, sketch) of ``docs`` (doc_id, text): equal set keys mean equal shingle sets."""
    return docs.select("doc_id", "text").mapInArrow(
        lambda batches: _signed(batches, words, bands, rows), "doc_id long, n_shingles long, set_key binary, bands array<long>, sketch long")


def shingle_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(id, shingles) of ``docs`` (doc_id, text): the whole sets of distinct shingle hashes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in chunks(batch.column("text")):
                sets = distinct_shingles(data, offsets, words)
                bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), lists], ["id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(work, "id long, shingles array<long>")


@scoped("near-duplicates")
def near_duplicates(docs: DataFrame, similarity: float = 0.8, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs`` (doc_id long, text string; other columns are ignored).

    Words are parted by ASCII white space, A-Z are lower-cased; a document's set are its distinct runs of ``words`` words, or
    its one whole sequence if it has fewer. Documents are linked at a Jaccard similarity of ``similarity`` or more, checked
    on their whole sets; component_id is the smallest doc_id reachable over links, kept says that it is the document's own.

    * Null, empty and white-space texts have no shingles and link with nothing.
    * Rows with equal sets are one class with one signature, however many they are; rows that repeat a doc_id belong to one
      component and get the same component_id, each by its own text.
    * A null doc_id links with nothing: its component_id is null and kept is true.
    * An empty table gives an empty result.
    """
    signed = written(signatures(docs, words, bands, rows), "signatures")
    known = signed.where("doc_id is not null and n_shingles > 0")
    classes = written(known.groupBy("set_key").agg(F.min("doc_id").alias("id")), "sets-once")
    member = written(known.select("doc_id", "set_key").join(classes, "set_key").select("doc_id", "id", "set_key"), "classes")
    own = known.join(classes.withColumnRenamed("set_key", "key"), (F.col("doc_id") == F.col("id")) & (F.col("set_key") == F.col("key")))
    buckets = shared_buckets(own.select(F.explode("bands").alias("bucket"), "id", F.col("n_shingles").alias("size"), "sketch"))
    ids = written(buckets.select(F.col("id").alias("doc_id")).distinct(), "ids")
    # A repeated doc_id with different texts has several sets; any pair of them counts.
    texts = docs.select("doc_id", "text").join(small_side(ids, 16), "doc_id", "left_semi")
    sets = written(shingle_sets(texts, words).where(F.size("shingles") > 0), "sets")

    def verify(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("of_a"))
        right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("of_b"))
        both = F.size(F.array_intersect("of_a", "of_b"))
        # 1e-9 only evens out the rounding of similarity * union: sizes are whole numbers.
        enough = both >= similarity * (F.size("of_a") + F.size("of_b") - both) - 1e-9
        return pairs.join(right, "b").join(left, "a").where(enough).select("a", "b").distinct()

    found, _ = linked_components(buckets, sets.select("id", F.col("shingles").alias("elements")), similarity, verify)
    # The classes of rows that repeat a doc_id meet in it.
    twice = member.groupBy("doc_id").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("doc_id")
    stars = written(member.join(twice, "doc_id").select(F.col("doc_id").alias("a"), F.col("id").alias("b")), "repeated")
    if not stars.isEmpty():
        found = connected_components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(stars))
    placed = member.join(found, "id", "left").select("doc_id", "set_key", F.coalesce("component", "id").alias("component_id")).distinct()
    out = signed.select("doc_id", "n_shingles", "set_key").join(placed, ["doc_id", "set_key"], "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
