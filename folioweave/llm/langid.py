"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of n-grams by language are gathered in tasks and added up by Spark; the matrix of log probabilities has a fixed
number of buckets and is broadcast; batches of texts are scored in numpy, each text by its own n-grams only.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioweave.llm.words import chunks

ORDERS = (1, 2, 3)
BUCKET_BITS = 16
#: Expected number of labelled documents that are learned from; of more, a share is drawn by a hash of doc_id and text.
TRAINING_ROWS = 200_000
#: n-grams that count as evidence; neighbouring n-grams depend on each other, so a long text is not surer than this many.
EVIDENCE = 30
SMOOTHING = 0.5
UNKNOWN = "und"

#: Text bytes scored at once: their n-grams take some hundred times as much memory. A longer text is cut into slices of as many
#: characters, whose sums are added.
CHUNK_BYTES = 1 << 19

#: Odd multipliers of the characters of an n-gram.
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def sliced(texts: list[str | None], size: int = CHUNK_BYTES) -> Iterator[tuple[list[str], int | None]]:
    """Lower-cased texts between blanks; a text that is alone and longer than ``size`` in slices, each with the first two characters
    of the next one, so that every n-gram begins in ``size`` characters of one slice only."""
    parts = [f" {(t or '').lower()} " for t in texts]
    if len(parts) == 1 and len(parts[0]) > size:
        more = max(ORDERS) - 1
        yield from (([parts[0][at : at + size + more]], size) for at in range(0, len(parts[0]), size))
    else:
        yield parts, None


def grams(parts: list[str], starts: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, n-grams of each part, whether it has a letter): n-grams of ``sliced`` parts, with blanks for all but letters.

    n-grams of blanks alone do not count, nor do those that cross the border of two parts or begin behind ``starts`` characters.
    """
    points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    value = np.where(letter, points, np.uint32(32)).astype(np.uint32)
    value = (value ^ (value << np.uint32(7))) * np.uint32(0x165667B1)
    out, owners = [], []
    owner = np.repeat(np.arange(len(parts), dtype=np.int32), np.diff(bounds))
    inside = letter
    acc = np.zeros(len(points), np.uint32)
    for order in range(max(ORDERS)):
        if order:
            acc, inside = acc[:-1], inside[:-1] | letter[order:]
        acc = acc + value[order:] * _FACTORS[order]
        if order + 1 in ORDERS:
            keep = inside & (owner[: len(acc)] == owner[order:])
            if starts is not None:
                keep[starts:] = False
            mixed = (acc[keep] ^ (acc[keep] >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * order)
            out.append(mixed >> np.uint32(32 - BUCKET_BITS))
            owners.append(owner[: len(acc)][keep])
    has = np.bincount(owner[letter], minlength=len(parts)) > 0
    which = np.concatenate(owners)
    place = np.argsort(which, kind="stable")
    return np.concatenate(out)[place], np.bincount(which, minlength=len(parts)), has


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    rows: dict[str, int] = {}
    for batch in batches:
        for first, last, *_ in chunks(batch.column("text"), CHUNK_BYTES):
            texts = batch.column("text").slice(first, last - first).to_pylist()
            langs = batch.column("lang").slice(first, last - first).to_pylist()
            for lang in langs:
                rows[lang] = rows.get(lang, 0) + 1
            for parts, starts in sliced(texts):
                buckets, counts, _ = grams(parts, starts)
                bounds = np.concatenate([[0], np.cumsum(counts)])
                for i, lang in enumerate(langs):
                    total = totals.setdefault(lang, np.zeros(1 << BUCKET_BITS, np.int64))
                    own = buckets[bounds[i] : bounds[i + 1]]
                    if len(own) < 4096:
                        np.add.at(total, own, 1)
                    else:
                        total += np.bincount(own, minlength=len(total))
    for lang, total in totals.items():
        used = np.flatnonzero(total)
        n = len(used) + 1  # the bucket -1 counts the documents
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * n, pa.string()), pa.array(np.append(used, -1).astype(np.int32)), pa.array(np.append(total[used], rows[lang]))],
            ["lang", "bucket", "n"])


def train(docs: DataFrame, rows: int = TRAINING_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages in order, log matrix of buckets x languages with the prior as its last row) from ``docs`` (doc_id, text, lang).

    Rows without a text or lang teach nothing. Of more labelled rows than ``rows`` a share is drawn by hash.
    """
    labelled = docs.where("lang is not null and text is not null").select("text", F.col("lang").cast("string").alias("lang"), "doc_id")
    total = labelled.count()
    if total > rows:
        labelled = labelled.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < int(rows / total * (1 << 20)))
    counted = labelled.select("text", "lang").mapInArrow(_learned, "lang string, bucket int, n long")
    counts = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counts.column("lang").to_pylist()))
    matrix = np.zeros(((1 << BUCKET_BITS) + 1, len(langs)))
    at = np.searchsorted(np.array(langs, dtype=object), np.array(counts.column("lang").to_pylist(), dtype=object)) if langs else []
    if langs:
        matrix[counts.column("bucket").to_numpy(), at] = counts.column("n").to_numpy()
        body = matrix[:-1] + SMOOTHING
        matrix[:-1] = np.log(body / body.sum(axis=0))
        matrix[-1] = np.log(matrix[-1] / matrix[-1].sum())
    return langs, matrix


def _scored(batches: Iterator[pa.RecordBatch], langs: list[str], matrix: np.ndarray, names: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    table = np.ascontiguousarray(matrix[:-1].T.astype(np.float32))
    for batch in batches:
        for first, last, *_ in chunks(batch.column("text"), CHUNK_BYTES):
            n = last - first
            sums, counts, has = np.zeros((n, max(1, len(langs)))), np.zeros(n, np.int64), np.zeros(n, bool)
            for parts, starts in sliced(batch.column("text").slice(first, n).to_pylist()):
                buckets, found, letters = grams(parts, starts)
                bounds, some = np.cumsum(found) - found, found > 0
                for k in range(len(langs)):
                    if some.any():
                        sums[some, k] += np.add.reduceat(table[k][buckets].astype(np.float64), bounds[some])
                counts += found
                has |= letters
            shrunk = np.minimum(1, EVIDENCE / np.maximum(counts, 1))[:, None] * sums + (matrix[-1] if langs else 0)
            best = shrunk.argmax(axis=1)
            score = 1 / np.exp(shrunk - shrunk.max(axis=1, keepdims=True)).sum(axis=1)
            known = has & bool(langs)
            pred = [langs[b] if k else UNKNOWN for b, k in zip(best, known)]
            yield pa.RecordBatch.from_arrays(
                [*batch.slice(first, last - first).columns, pa.array(pred, pa.string()), pa.array(np.where(known, score, 0.0))],
                [*batch.schema.names, *names])


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the most probable language of each text and its probability (0 to 1), row by row, by the text alone.

    * Null and empty texts and texts without a letter get ``und`` and 0, as do all texts if nothing could be learned.
    * Ties go to the first language in alphabetical order. Texts are scored whole. Repeated rows get equal results.
    * Other columns stay, but for those with the names of the new ones, which are replaced. An empty table gives an empty result.
    """
    docs = docs.drop(lang, score)
    langs, matrix = model
    sent = docs.sparkSession.sparkContext.broadcast(matrix)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{lang}` string", f"`{score}` double"])
    typed = docs.withColumn("text", F.col("text").cast("string"))
    return typed.mapInArrow(lambda batches: _scored(batches, langs, sent.value, (lang, score)), schema)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves no remainder; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0
