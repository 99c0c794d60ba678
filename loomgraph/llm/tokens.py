"""Tokenizer files, rank tables and encoders; nothing here is trained, and no vocabulary is part of the repository."""

from __future__ import annotations

import base64
import functools
import os
import re

#: Where the public vocabulary files are; every operator takes another folder as a parameter.
TOKENIZERS = "/opt/tokenizers"
RANKS = "byte_bpe_50k.tiktoken"

#: Splits text before the merges of the byte-level vocabularies. No match holds a white space after another character,
#: so every change from non-space to space is a boundary in whatever text surrounds it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: What ``\s`` means in PATTERN: the White_Space property of Unicode, which is less than ``str.isspace`` (no U+001C to U+001F).
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: The encoder's regular expression engine walks back through a run of white space and overflows its stack on one of some hundred thousand
#: characters; runs of this many are taken out beforehand and encoded as what the pattern makes of them.
LONG_RUN = 50_000
_LONG_RUNS = re.compile(f"[{WHITE}]{{{LONG_RUN},}}")


def rank_path(folder: str = TOKENIZERS, name: str = RANKS) -> str:
    return os.path.join(folder, name)


@functools.lru_cache(4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@functools.lru_cache(4)
def encoding(path: str):
    """One encoder for each worker process and file."""
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@functools.lru_cache(4)
def _one_piece(path: str):
    """An encoder of the same ranks that never splits: the merges of one pre-token of any length."""
    import tiktoken

    return tiktoken.Encoding("piece", pat_str=r"(?s:.)+", mergeable_ranks=ranks(path), special_tokens={})


def encode(path: str, text: str) -> list[int]:
    """Tokens of a text of any length and content.

    A long run of white space is one pre-token but for its last character, which PATTERN leaves to what follows; at the end of
    the text all of it is one."""
    enc = encoding(path)
    if len(text) < LONG_RUN:
        return enc.encode_ordinary(text)
    out: list[int] = []
    at = 0
    for m in _LONG_RUNS.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        out += enc.encode_ordinary(text[at : m.start()])
        out += _one_piece(path).encode_ordinary(text[m.start() : end])
        at = end
    return out + enc.encode_ordinary(text[at:])
