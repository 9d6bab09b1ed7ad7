"""Token counts of documents from the piece counts of distinct pre-tokens, without making any token id.

The corpus is read twice. The first pass gathers the distinct pre-tokens, whose pieces are counted once each. The second
makes each document's pre-token frequencies and multiplies them with those counts: frequent pre-tokens are met inside the
task from a table of fixed size, all others go through a join. So the heaviest keys never enter a shuffle.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.normalizers import Lowercase

from folioweave.llm.merging import joined as merged_pieces
from folioweave.llm.pretokens import byte_alphabet, read_tokenizer
from folioweave.llm.tables import written
from folioweave.llm.words import chunks, text_hashes

# The pre-token pattern of the word tokenizer, and the endings it parts from a word behind an apostrophe.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]

#: Rows of the table of frequent pre-tokens that every task holds.
FREQUENT = 300_000
#: Distinct pre-tokens a task gathers before it passes them on.
_GATHERED = 300_000


def word_parts(path: str) -> dict:
    """What tasks need of a BPE file with word ends: pattern, special strings, merges."""
    parsed = read_tokenizer(path)
    kinds = [n["type"] for n in parsed["normalizer"]["normalizers"]]
    split, last = parsed["pre_tokenizer"]["pretokenizers"]
    if kinds != ["NFC", "Replace", "Lowercase"] or (split["behavior"], split["invert"]) != ("Removed", True) or last["type"] != "ByteLevel":
        raise ValueError("only word tokenizers with composed, lower-cased text are supported")
    if split["pattern"]["Regex"] != WORD_PATTERN:
        raise ValueError("unknown pre-token pattern")
    model = parsed["model"]
    merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    return {
        "classes": character_classes(), "lower": lower_case(), "specials": [t["content"] for t in parsed["added_tokens"]],
        "ranks": {m: r for r, m in enumerate(merges)}, "end": model["end_of_word_suffix"] or "",
    }


def lower_case() -> dict[int, str]:
    """What the tokenizer library lower-cases, by code point: tasks may run other versions of Unicode than it does."""
    points = [c for c in range(128, 0x110000) if not 0xD800 <= c < 0xE000]
    lowered = Lowercase().normalize_str("\n".join(map(chr, points))).split("\n")
    return {**{c: chr(c + 32) for c in range(65, 91)}, **{c: low for c, low in zip(points, lowered, strict=True) if low != chr(c)}}


def character_classes() -> np.ndarray:
    """0 for white space, 1 for letters, 2 for numbers, 3 for the rest, by code point."""
    every = "".join(map(chr, range(0x110000)))
    out = np.full(len(every), 3, np.uint8)
    for code, pattern in enumerate([r"\s+", r"\p{L}+", r"\p{N}+"]):
        for run in regex.finditer(pattern, every):
            out[run.start() : run.end()] = code
    return out


def _folded(text: str, lower: dict[int, str]) -> str:
    """Composed (NFC) and lower-cased, character by character."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).translate(lower)


def pretokens(texts: list[str | None], parts: dict) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(joined text, starts, ends, text number of each pre-token, special tokens of each text), all texts at once.

    A pre-token is a run of letters, one number, or a run of other characters that are not white space; an apostrophe that
    stands alone takes a known ending with it.
    """
    specials = np.zeros(len(texts), np.int64)
    folded = []
    for i, text in enumerate(texts):
        text = text or ""
        for special in parts["specials"]:
            if special in text:
                specials[i] += text.count(special)
                text = text.replace(special, " ")
        folded.append(_folded(text, parts["lower"]))
    joined = " ".join([*folded, ""])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = parts["classes"][points]
    edge = np.ones(len(kind), bool)
    edge[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    borders = np.append(np.flatnonzero(edge), len(kind))
    word = kind[borders[:-1]] > 0
    starts, ends = borders[:-1][word], borders[1:][word]
    alone = np.flatnonzero((points[starts] == 39) & (ends - starts == 1))
    alone = alone[(alone + 1 < len(starts))]
    alone = alone[(starts[alone + 1] == ends[alone]) & (kind[ends[alone]] == 1)]
    starts, ends = starts.copy(), ends.copy()
    for t in alone:
        following = joined[starts[t + 1] : ends[t + 1]]
        taken = next((e for e in _ENDINGS if following.startswith(e)), "")
        ends[t] += len(taken)
        starts[t + 1] += len(taken)
    kept = starts < ends
    starts, ends = starts[kept], ends[kept]
    bounds = np.cumsum([len(f) + 1 for f in folded])
    return joined, starts, ends, np.searchsorted(bounds, starts, "right"), specials


def piece_count(symbols: list[str], ranks: dict) -> int:
    """Number of pieces left when the pair of least rank is joined until no pair has a rule."""

    def rule(a: str, b: str) -> tuple | None:
        rank = ranks.get((a, b))
        return None if rank is None else (rank, a + b)

    return len(merged_pieces(symbols, rule))


def _gathered(batches: Iterator[pa.RecordBatch], parts: dict) -> Iterator[pa.RecordBatch]:
    seen: dict[int, list] = {}

    def passed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.int64()), pa.array([p for p, _ in seen.values()], pa.string()), pa.array([n for _, n in seen.values()], pa.int64())],
            ["hash", "piece", "n"])

    for batch in batches:
        for first, last, *_ in chunks(batch.column("text")):
            joined, starts, ends, _, _ = pretokens(batch.column("text").slice(first, last - first).to_pylist(), parts)
            hashes, at, counts = np.unique(text_hashes(joined, starts, ends), return_index=True, return_counts=True)
            for h, i, n in zip(hashes.view(np.int64).tolist(), at.tolist(), counts.tolist()):
                if h in seen:
                    seen[h][1] += n
                else:
                    seen[h] = [joined[starts[i] : ends[i]], n]
            if len(seen) > _GATHERED:
                yield passed()
                seen.clear()
    yield passed()


def _pieces(batches: Iterator[pa.RecordBatch], parts: dict) -> Iterator[pa.RecordBatch]:
    shown = {b: c for c, b in byte_alphabet().items()}
    for batch in batches:
        counts = []
        for word in batch.column("piece").to_pylist():
            symbols = [shown[b] for b in word.encode("utf-8", "surrogatepass")]
            symbols[-1] += parts["end"]
            counts.append(piece_count(symbols, parts["ranks"]))
        yield pa.RecordBatch.from_arrays([batch.column("hash"), batch.column("n"), pa.array(counts, pa.int64())], ["hash", "n", "tokens"])


def _counted(batches: Iterator[pa.RecordBatch], parts: dict, held: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    keys, tokens = held
    for batch in batches:
        for first, last, *_ in chunks(batch.column("text")):
            joined, starts, ends, owner, specials = pretokens(batch.column("text").slice(first, last - first).to_pylist(), parts)
            distinct, which = np.unique(text_hashes(joined, starts, ends), return_inverse=True)
            distinct = distinct.view(np.int64)
            pairs, n = np.unique(owner * max(1, len(distinct)) + which, return_counts=True)
            owner, which = np.divmod(pairs, max(1, len(distinct)))
            at = np.minimum(np.searchsorted(keys, distinct), max(0, len(keys) - 1))
            known = keys[at] == distinct if len(keys) else np.zeros(len(distinct), bool)
            each = np.where(known, tokens[at] if len(keys) else 0, 0)
            total = specials.copy()
            np.add.at(total, owner, n * each[which])
            rest = ~known[which]
            bounds = np.searchsorted(owner[rest], np.arange(last - first + 1)).astype(np.int32)
            items = pa.StructArray.from_arrays([pa.array(distinct[which[rest]]), pa.array(n[rest])], ["hash", "n"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(first, last - first), batch.column("n_bytes").slice(first, last - first),
                 pa.array(total), pa.ListArray.from_arrays(bounds, items)],
                ["doc_id", "n_bytes", "known", "rest"])


def token_counts(docs: DataFrame, path: str, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens), one row for each row of ``docs`` (doc_id long, text string; other columns are ignored).

    ``path`` is a BPE file with word ends on the driver. Counts are those of the tokenizers library without added special
    tokens, truncation and padding; special strings inside a text count as their special token.

    * Null and empty texts have 0 bytes and 0 tokens. Texts of any length are counted whole.
    * Repeated rows, also with a repeated or null doc_id, are counted each. An empty table gives an empty result.
    * ``frequent`` bounds the table of pre-tokens that every task holds; it changes no count.
    """
    spark = docs.sparkSession
    parts = spark.sparkContext.broadcast(word_parts(path))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = texts.select("text").mapInArrow(lambda batches: _gathered(batches, parts.value), "hash long, piece string, n long")
    distinct = seen.groupBy("hash", "piece").agg(F.sum("n").alias("n"))
    pieces = written(distinct.mapInArrow(lambda batches: _pieces(batches, parts.value), "hash long, n long, tokens long"), "pieces")
    classes = pieces.groupBy(F.floor(F.log2("n")).alias("power")).count().collect()  # 64 rows at most
    least, taken = 62, 0
    for row in sorted(classes, reverse=True):
        taken += row["count"]
        if taken > frequent:
            break
        least = row["power"]
    top = pieces.where(F.col("n") >= F.lit(1 << least)).select("hash", "tokens").toArrow()
    order = np.argsort(top.column("hash").to_numpy())
    held = spark.sparkContext.broadcast((top.column("hash").to_numpy()[order], top.column("tokens").to_numpy()[order]))
    sized = texts.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    counted = sized.mapInArrow(
        lambda batches: _counted(batches, parts.value, held.value),
        "doc_id long, n_bytes long, known long, rest array<struct<hash:long,n:long>>")
    counted = written(counted.withColumn("row", F.monotonically_increasing_id()), "frequencies")
    open_ = counted.where(F.size("rest") > 0).select("row", F.explode("rest").alias("r")).select("row", "r.hash", "r.n")
    more = open_.join(pieces.select("hash", "tokens"), "hash").groupBy("row").agg(F.sum(F.col("n") * F.col("tokens")).alias("more"))
    n_tokens = F.col("known") + F.coalesce("more", F.lit(0))
    return counted.drop("rest").join(more, "row", "left").select("doc_id", "n_bytes", n_tokens.alias("n_tokens"))
