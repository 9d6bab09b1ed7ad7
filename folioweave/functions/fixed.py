"""Long lists of rules that put one fixed text in the place of another, run over a text in one pass.

In such a list no rule looks for a character that an earlier one puts in, and none puts in nothing. So whatever a rule finds
when its turn comes stands in the unchanged text: all fixed texts are looked up at once, and only where some overlap are their
rules run one after the other. The work on a text does not grow with the list.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Pieces of texts that are remembered with their results, and the bytes of the longest of them.
_KEPT, _LONGEST = 200_000, 64


class FixedTexts(dict):
    """Pieces after all rules, (old, new) pairs of UTF-8, and the numbers of the rules that changed them.

    A piece holds only bytes of old texts, so none reaches beyond it. Short ones are remembered, up to a fixed number.
    """

    def __init__(self, pairs: Iterable[tuple[bytes, bytes]]) -> None:
        super().__init__()
        self.pairs = list(pairs)
        changing = [k for k, (old, new) in enumerate(self.pairs) if old != new]
        self._file(changing)
        # What holds the text of an earlier rule is gone when its own turn comes.
        self._file([k for k in changing if all(first >= k for _, _, first in self._found(self.pairs[k][0]))])

    def _file(self, numbers: list[int]) -> None:
        """File rules by their text, and the lengths of these texts by what they begin with."""
        texts = [self.pairs[k][0] for k in numbers]
        self.rule_of = dict(zip(reversed(texts), reversed(numbers), strict=True))
        self.head = min(map(len, texts), default=1)
        lengths: dict[bytes, set[int]] = {}
        for old in texts:
            lengths.setdefault(old[:self.head], set()).add(len(old))
        self.lengths = {head: tuple(sorted(found)) for head, found in lengths.items()}
        letters = b"".join(re.escape(bytes([b])) for b in sorted(set(b"".join(texts))))
        self.pieces = re.compile(b"([%s]{%d,})" % (letters, self.head)) if texts else None

    def _found(self, piece: bytes) -> list[tuple[int, int, int]]:
        """Where fixed texts begin and end and the numbers of their rules, by beginning."""
        head, lengths, rule_of = self.head, self.lengths.get, self.rule_of.get
        begun = [(at, found) for at in range(len(piece) - head + 1) if (found := lengths(piece[at:at + head]))]
        return [(at, at + n, k) for at, found in begun for n in found if (k := rule_of(piece[at:at + n])) is not None and at + n <= len(piece)]

    def __missing__(self, piece: bytes) -> tuple[bytes, tuple[int, ...]]:
        groups = []
        for at, end, k in self._found(piece):
            if groups and at < groups[-1][1]:
                groups[-1][1] = max(groups[-1][1], end)
                groups[-1][2].add(k)
            else:
                groups.append([at, end, {k}])
        out, last, fired = [], 0, set()
        for at, end, rules in groups:
            text = piece[at:end]
            for k in sorted(rules):
                if (new := text.replace(*self.pairs[k])) != text:
                    text = new
                    fired.add(k)
            out += (piece[last:at], text)
            last = end
        done = (b"".join((*out, piece[last:])), tuple(fired)) if groups else (piece, ())
        if len(piece) <= _LONGEST:
            if len(self) >= _KEPT:
                self.clear()
            self[piece] = done
        return done

    def run(self, text: bytes, named: bool = False) -> tuple[bytes, list[int]]:
        """A text after all rules and, if they are wanted, the numbers of those that changed it, in order."""
        if self.pieces is None:
            return text, []
        parts = self.pieces.split(text)
        done = [self[piece] for piece in parts[1::2]]
        parts[1::2] = [new for new, _ in done]
        return b"".join(parts), sorted(set().union(*(fired for _, fired in done))) if named else []


def replaced(text: Column, pairs: Iterable[tuple[str, str]], named: bool = False) -> Column:
    """``text`` (never null) after all rules and, if they are wanted, the numbers of those that changed it, as a struct."""
    rules = FixedTexts((old.encode(), new.encode()) for old, new in pairs)

    @F.arrow_udf("struct<text:binary,rules:array<int>>")
    def run(texts: pa.Array, again: pa.Array) -> pa.Array:
        done = [rules.run(text, named) for text in texts.to_pylist()]
        columns = pa.array([text for text, _ in done], pa.binary()), pa.array([fired for _, fired in done], pa.list_(pa.int32()))
        return pa.StructArray.from_arrays(columns, names=["text", "rules"])

    # Named twice (and sent once), the text stays a column of its own. Where the optimizer writes an expression with nested
    # lambdas into the arguments, it loses sight of the function, and the job fails.
    return run(text.cast("binary"), text.cast("binary"))
