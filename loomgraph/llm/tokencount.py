"""Token counts with overlap resynchronisation.

A document of up to ``chunk_chars`` characters is encoded at once. A longer one is encoded in chunks that
overlap by ``overlap_chars``. Each chunk's tokens carry their byte offsets; inside the overlap, the boundaries
that both encodings share are narrowed to the proven ones: between a character that isn't white space and one that is. The
splitting pattern has no match that crosses such a place and looks ahead by one character only, so the tokens before and after it
are those of the whole document. The chunks are spliced at the middle proven boundary. Where an overlap has none (a
long run without spaces, or only spaces), it is doubled to the left and right until it has, at most until it is the whole rest.

Defined results: a null text has a null count, an empty one 0. Repeated rows are each counted. Ids may be null. Extra columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomgraph.llm.common import map_arrow
from loomgraph.llm.tokens import TOKENIZERS, WHITE, encode, rank_path, ranks

SCHEMA = "doc_id bigint, n_tokens bigint, n_chunks int, n_widened int"


@dataclass(frozen=True)
class TokenCountParams:
    chunk_chars: int = 16_384
    overlap_chars: int = 256
    tokenizers: str = TOKENIZERS


#: A white space after a character that is none and before one more character, as the splitting pattern understands white space.
_BOUNDARY = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}](?s:.))")


def _offsets(tokens: list[int], lengths: np.ndarray) -> np.ndarray:
    """Byte offset at which each token begins, and the end."""
    out = np.zeros(len(tokens) + 1, np.int64)
    np.cumsum(lengths[np.array(tokens, np.int64)], out=out[1:])
    return out


def token_lengths(path: str) -> np.ndarray:
    """Bytes of each token of a rank file."""
    table = ranks(path)
    out = np.zeros(max(table.values()) + 1, np.int64)
    for b, i in table.items():
        out[i] = len(b)
    return out


def _proven(text: str, lo: int, hi: int) -> list[int]:
    """Character positions p in (lo, hi) with text[p-1] not white space and text[p] white space followed by one more character of the window."""
    return [lo + m.start() for m in _BOUNDARY.finditer(text[lo:hi]) if m.start()]


def encode_spliced(text: str, path: str, lengths: np.ndarray, chunk: int, overlap: int) -> tuple[list[int], int, int]:
    """(tokens, chunks, widenings) of a text of any length; the tokens equal those of encoding it at once."""
    if len(text) <= chunk:
        return encode(path, text), 1, 0
    out: list[int] = []
    done, start, chunks, widened = 0, 0, 0, 0  # text before ``done`` is in ``out``
    end = min(len(text), chunk)
    left = None  # tokens of text[start:end], once they are wanted
    while True:
        chunks += 1
        if end == len(text):
            return out + _between(text, start, done, end, encode(path, text[start:]) if left is None else left, lengths), chunks, widened
        # the next chunk begins ``wide`` characters before this one's end
        wide, p = overlap, None
        while True:
            nxt = max(done, end - wide)
            nxt_end = min(len(text), nxt + max(chunk, 2 * wide))
            if places := _proven(text, nxt, end):
                left = encode(path, text[start:end]) if left is None else left
                right = encode(path, text[nxt:nxt_end])
                p = _splice(text, start, left, nxt, right, places, lengths)
                if p is not None:
                    break
            widened += 1
            if nxt == done:  # nothing left to widen to the left: take a longer text from here
                end, start, left = min(len(text), end + max(chunk, 2 * wide)), done, None
                if end == len(text):
                    break
            wide *= 2
        if p is not None:
            out += _between(text, start, done, p, left, lengths)
            done, start, end, left = p, nxt, nxt_end, right


def _cut(text: str, start: int, p: int, tokens: list[int], lengths: np.ndarray) -> int:
    """Index of the token that begins at character ``p`` of the text."""
    offs = np.zeros(len(tokens) + 1, np.int64)
    np.cumsum(lengths[np.asarray(tokens, np.int64)], out=offs[1:])
    at = len(text[start:p].encode("utf-8"))
    k = int(np.searchsorted(offs, at))
    if offs[k] != at:
        raise ValueError("a proven boundary is no token boundary")
    return k


def _between(text, start, lo, hi, tokens, lengths) -> list[int]:
    """Those of the tokens of text[start:...] that begin in [lo, hi)."""
    return tokens[_cut(text, start, lo, tokens, lengths) : _cut(text, start, hi, tokens, lengths)]


def _splice(text, start, left, nxt, right, places, lengths) -> int | None:
    """The middle one of the proven places that is a token boundary in both encodings; None without one."""
    both = []
    base = len(text[start:nxt].encode("utf-8"))
    lo, ro = set(_offsets(left, lengths).tolist()), set(_offsets(right, lengths).tolist())
    for p in places:
        at = len(text[nxt:p].encode("utf-8"))
        if base + at in lo and at in ro:
            both.append(p)
    return both[len(both) // 2] if both else None


def token_counts(docs: DataFrame, params: TokenCountParams = TokenCountParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCHEMA, one row for each row of ``docs``; ``n_widened`` counts the overlaps that had to grow."""
    path = rank_path(params.tokenizers)

    def run(it):
        lengths = token_lengths(path)
        for b in it:
            rows = [(None, None, None) if t is None else (len(x[0]), x[1], x[2]) if (x := encode_spliced(t, path, lengths, params.chunk_chars, params.overlap_chars)) else None for t in b.column(text_col).to_pylist()]
            n, c, w = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(id_col).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(c, pa.int32()), pa.array(w, pa.int32())], names=["doc_id", "n_tokens", "n_chunks", "n_widened"])

    return map_arrow(docs.select(id_col, text_col), run, SCHEMA)
