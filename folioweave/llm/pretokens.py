"""What token counting and BPE share: tokenizer files, the byte alphabet, and cutting texts into pre-tokens."""

from __future__ import annotations

import json
from collections.abc import Callable

import regex

#: Pre-token patterns by tokenizer family. Fixed values of the public tokenizers.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next free one from 256."""
    shown = [b for b in range(256) if 33 <= b <= 126 or (161 <= b <= 255 and b != 173)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def read_tokenizer(path: str) -> dict:
    """The parsed file, on the driver. Special tokens that strip or want whole words are not supported."""
    with open(path, encoding="utf-8") as file:
        parsed = json.load(file)
    for token in parsed["added_tokens"]:
        if token["single_word"] or token["lstrip"] or token["rstrip"] or token["normalized"]:
            raise ValueError(f"unsupported special token {token['content']}")
    if parsed["model"]["type"] != "BPE":
        raise ValueError("only BPE models are supported")
    return parsed


def special_pieces(specials: list[str]) -> Callable[[str], list[tuple[bool, str]]] | None:
    """A function that parts a text at special strings: (is special, piece)."""
    if not specials:
        return None
    found = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True)) + ")")
    return lambda text: [(i % 2 == 1, piece) for i, piece in enumerate(found.split(text)) if piece]


def cutter(pattern: str, specials: list[str]) -> Callable[[str], list[str]]:
    """A function from a text to its pre-tokens in order; special strings come out whole."""
    cut = regex.compile(pattern).findall
    parts = special_pieces(specials)

    def pretokens(text: str) -> list[str]:
        if parts is None or not any(s in text for s in specials):
            return cut(text)
        out: list[str] = []
        for special, piece in parts(text):
            out += [piece] if special else cut(piece)
        return out

    return pretokens
