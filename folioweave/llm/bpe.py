"""Byte-level BPE encoding by speculation: longest-match proposals, vectorised verification, exact merging where it fails.

A sequence of tokens is the BPE encoding of its bytes exactly when each token encodes itself and each adjacent pair is
compatible, that is, merging the two tokens' bytes from scratch never joins anything across their border. So a word's
proposal can be tested pair by pair, for all distinct words of a chunk at once, and only failing words are merged step by step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.llm.merging import joined
from folioweave.llm.pretokens import BYTE_PATTERN, byte_alphabet, cutter, read_tokenizer
from folioweave.llm.words import chunks

#: Words whose encoding a task remembers; beyond it the memory starts anew, which changes no result.
REMEMBERED_WORDS = 400_000


def model_parts(path: str) -> dict:
    """Plain tables of a byte-level BPE file, to be broadcast; their size is that of the vocabulary."""
    parsed = read_tokenizer(path)
    if parsed["normalizer"] is not None or parsed["pre_tokenizer"] != {
            "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
        raise ValueError("only byte-level files with their usual pattern are supported")
    byte_of = byte_alphabet()
    ids = {bytes(byte_of[c] for c in token): i for token, i in parsed["model"]["vocab"].items()}
    merges = [m.split(" ") if isinstance(m, str) else m for m in parsed["model"]["merges"]]
    sides = [tuple(ids[bytes(byte_of[c] for c in side)] for side in merge) for merge in merges]
    token_bytes = {i: b for b, i in ids.items()}
    specials = {t["content"]: t["id"] for t in parsed["added_tokens"]}
    token_bytes |= {i: s.encode() for s, i in specials.items()}
    size = max(token_bytes) + 1
    left, right, born = np.full(size, -1), np.full(size, -1), np.full(size, -1)
    pairs: dict[tuple[int, int], tuple[int, int]] = {}
    for rank, (a, b) in enumerate(sides):
        whole = ids[token_bytes[a] + token_bytes[b]]
        pairs[a, b] = rank, whole
        if born[whole] >= 0 or max(born[a], born[b]) >= rank:
            raise ValueError("merges must make each token once, from tokens made before it")
        left[whole], right[whole], born[whole] = a, b, rank
    order = sorted((a << 32 | b, rank) for (a, b), (rank, _) in pairs.items())
    parts = {
        "ids": ids, "pairs": pairs, "specials": specials, "left": left, "right": right, "born": born,
        "keys": np.array([k for k, _ in order], np.int64), "ranks": np.array([r for _, r in order], np.int64),
        "longest": max(map(len, ids)), "pattern": BYTE_PATTERN, "bytes": [token_bytes.get(i, b"") for i in range(size)],
    }
    parts["sound"] = np.zeros(size, bool)
    for token, i in ids.items():
        parts["sound"][i] = merged(token, ids, pairs) == [i]
    return parts


def merged(word: bytes, ids: dict, pairs: dict) -> list[int]:
    """The exact encoding: join the pair of least rank, leftmost first, until none is left."""
    return joined([ids[word[i : i + 1]] for i in range(len(word))], lambda a, b: pairs.get((a, b)))


def proposed(word: bytes, ids: dict, longest: int) -> list[int]:
    """Greedy longest match from the left."""
    out, i, n = [], 0, len(word)
    while i < n:
        j = min(n, i + longest)
        while word[i:j] not in ids:
            j -= 1
        out.append(ids[word[i:j]])
        i = j
    return out


def compatible(a: np.ndarray, b: np.ndarray, parts: dict) -> np.ndarray:
    """Whether no merge crosses the border of each pair of tokens when their joint bytes are merged from scratch.

    The merges of both sides are undone from the last on. As long as the two pieces at the border are there together, a
    pair rule for them wins if it ranks before the merge that uses up either piece next.
    """
    keys, ranks, left, right, born = (parts[k] for k in ("keys", "ranks", "left", "right", "born"))
    never = np.int64(1 << 40)
    a, b = a.astype(np.int64).copy(), b.astype(np.int64).copy()
    good, todo = np.ones(len(a), bool), np.arange(len(a))
    # The rank at which the piece on each side is used up: never for the whole tokens.
    end_a, end_b = np.full(len(a), never), np.full(len(a), never)
    while len(todo):
        x, y = a[todo], b[todo]
        key = x << 32 | y
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        rank = np.where(keys[at] == key, ranks[at], never)
        # The left piece is used up at end_a, the right one at end_b. Of equal ranks the leftmost pair is merged first:
        # the left piece's own merge lies further left than the border, that of the right piece lies further right.
        bad = (rank < end_a[todo]) & (rank <= end_b[todo]) & (rank < never)
        good[todo[bad]] = False
        stay = ~bad & ((born[x] >= 0) | (born[y] >= 0))
        todo, x, y = todo[stay], x[stay], y[stay]
        undo_left = born[x] >= born[y]
        one, two = todo[undo_left], todo[~undo_left]
        end_a[one], a[one] = born[x[undo_left]], right[x[undo_left]]
        end_b[two], b[two] = born[y[~undo_left]], left[y[~undo_left]]
    return good


def encoded_words(words: list[str], parts: dict) -> list[list[int]]:
    """Token ids of each distinct word."""
    raw = [w.encode() for w in words]
    out = [proposed(w, parts["ids"], parts["longest"]) for w in raw]
    lengths = np.array([len(o) for o in out], np.int64)
    flat = np.fromiter((t for o in out for t in o), np.int64, int(lengths.sum()))
    owner = np.repeat(np.arange(len(out)), lengths)
    inside = owner[1:] == owner[:-1]
    pairs, where = np.unique(flat[:-1][inside] << 32 | flat[1:][inside], return_inverse=True)
    fits = compatible(pairs >> 32, pairs & 0xFFFFFFFF, parts)
    wrong = np.zeros(len(out), bool)
    wrong[owner[:-1][inside][~fits[where]]] = True
    wrong[owner[~parts["sound"][flat]]] = True
    for i in np.flatnonzero(wrong):
        out[i] = merged(raw[i], parts["ids"], parts["pairs"])
    return out


def _encoded(batches: Iterator[pa.RecordBatch], parts: dict, names: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    pretokens = cutter(parts["pattern"], list(parts["specials"]))
    lengths = np.array([len(b) for b in parts["bytes"]], np.int64)
    table = np.frombuffer(b"".join(parts["bytes"]), np.uint8)
    begins = np.cumsum(lengths) - lengths
    fixed = {s: np.int32(i).tobytes() for s, i in parts["specials"].items()}
    known = dict(fixed)
    for batch in batches:
        for first, last, *_ in chunks(batch.column("text")):
            rows = [pretokens(t) if t else [] for t in batch.column("text").slice(first, last - first).to_pylist()]
            fresh = list(set().union(*rows) - known.keys())
            if len(known) + len(fresh) > REMEMBERED_WORDS:
                known, fresh = dict(fixed), list(set().union(*rows) - fixed.keys())
            if fresh:
                known.update(zip(fresh, (np.array(o, np.int32).tobytes() for o in encoded_words(fresh, parts))))
            ids = [np.frombuffer(b"".join(map(known.__getitem__, row)), np.int32) for row in rows]
            flat = np.concatenate(ids)
            bounds = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
            sizes = lengths[flat]
            ends = np.concatenate([[0], np.cumsum(sizes)])
            data = table[np.arange(ends[-1]) - np.repeat(ends[:-1] - begins[flat], sizes)].tobytes()
            at = ends[bounds].tolist()
            decoded = [data[i:j].decode("utf-8", "replace") for i, j in zip(at, at[1:])]
            arrays = [pa.ListArray.from_arrays(bounds.astype(np.int32), pa.array(flat)), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.slice(first, last - first).columns, *arrays], [*batch.schema.names, *names])


def encode(docs: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the token ids of each text and the text decoded from them, row by row and without a shuffle.

    ``path`` is a byte-level BPE file on the driver. Ids are those of the tokenizers library without added special tokens,
    truncation and padding; special strings inside a text are their special token, as is that library's default.

    * Null and empty texts have an empty list and an empty decoded text. Texts of any length are encoded whole.
    * Repeated rows are encoded each; other columns stay, but for those called ``ids`` or ``decoded``, which are replaced.
    """
    docs = docs.drop(ids, decoded)
    sent = docs.sparkSession.sparkContext.broadcast(model_parts(path))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{ids}` array<int>", f"`{decoded}` string"])
    typed = docs.withColumn("text", F.col("text").cast("string"))
    return typed.mapInArrow(lambda batches: _encoded(batches, sent.value, (ids, decoded)), schema)
