"""Byte-level BPE encoding and decoding through a sentencepiece model made from the vocabulary.

The model is serialised here, field by field: every byte sequence of the rank file becomes a piece, its bytes written
as printable characters (one for each byte value), with the negative rank as its score; the normaliser is the identity.
sentencepiece joins the neighbours whose piece scores highest, the leftmost first, which is the merge
order of the ranks. Texts are split by the vocabulary's pattern; distinct pre-tokens are encoded by sentencepiece once for each
batch and worker (a bounded memory of recent ones saves repeats), and decoding maps ids back to their bytes.

Defined results: a null text gives null ids and null checks; an empty one no ids. Repeated rows are each encoded. Extra columns aren't read. Decoding writes U+FFFD for
an id that is null, negative or not in the vocabulary, and for bytes that are no UTF-8. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomgraph.llm.common import map_arrow
from loomgraph.llm.tokens import PATTERN, RANKS, TOKENIZERS, rank_path, ranks

SCHEMA = "doc_id bigint, ids array<int>, n_tokens int, round_trip boolean"

#: Pre-tokens that a worker remembers before it begins afresh.
REMEMBERED = 400_000


@dataclass(frozen=True)
class BpeParams:
    tokenizers: str = TOKENIZERS
    ranks: str = RANKS


def byte_characters() -> list[str]:
    """A printable character for each byte value: itself where it is printable Latin-1, else one from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [""] * 256, 0x100
    for b in range(256):
        if b in own:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protobuf field: length-delimited for bytes, fixed 32 bits for floats, varint for ints."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(vocabulary: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model. Piece i + 1 is the byte sequence of rank i; piece 0 is the unknown one."""
    chars = byte_characters()
    by_rank = {r: b for b, r in vocabulary.items()}
    if sorted(by_rank) != list(range(len(by_rank))):
        raise ValueError("ranks must be 0, 1, 2 ...")
    out = [_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))]
    for r in range(len(by_rank)):
        out.append(_field(1, _field(1, "".join(chars[x] for x in by_rank[r]).encode()) + _field(2, float(-r)) + _field(3, 1)))
    trainer = _field(3, 2) + _field(4, len(by_rank) + 1) + _field(40, 0) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normalizer)


class ByteBpe:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, vocabulary: dict[bytes, int]):
        import regex
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(vocabulary))
        self.split = regex.compile(PATTERN).findall
        self.table = str.maketrans({chr(i): c for i, c in enumerate(byte_characters())})
        self.bytes_of = [b for b, _ in sorted(vocabulary.items(), key=lambda x: x[1])]
        self.memory: dict[str, bytes] = {}
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.begin = np.cumsum(self.lengths) - self.lengths

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as int32 arrays."""
        out = []
        for text in texts:
            words = self.split(text)
            memory = self.memory
            new = [w for w in set(words) if w not in memory]
            if new:
                if len(memory) + len(new) > REMEMBERED:
                    memory = self.memory = {}
                    new = list(set(words))
                mapped = [w.encode("utf-8").decode("latin-1").translate(self.table) for w in new]
                for w, ids in zip(new, self.sp.encode(mapped, num_threads=1)):
                    memory[w] = np.array(ids, np.int32).tobytes()
            out.append(np.frombuffer(b"".join(map(memory.__getitem__, words)), np.int32) - 1)
        return out

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.begin[ids] - (ends - n), n) + np.arange(total)
        return self.flat[at].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids; unknown ids and bytes that are no UTF-8 become U+FFFD."""
        ids = np.asarray(ids, np.int64)
        bad = np.flatnonzero((ids < 0) | (ids >= len(self.lengths)))
        if not len(bad):
            return self.decode_bytes(ids).decode("utf-8", "replace")
        parts = np.split(ids, np.sort(np.concatenate([bad, bad + 1])))  # every second part is one unknown id
        return b"\xef\xbf\xbd".join(self.decode_bytes(x) for x in parts[::2]).decode("utf-8", "replace")


@functools.lru_cache(2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(ranks(path))


def encode(docs: DataFrame, params: BpeParams = BpeParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCHEMA, one row for each row of ``docs``; ``round_trip`` says whether the decoded ids are the text's bytes."""
    path = rank_path(params.tokenizers, params.ranks)

    def run(it):
        bpe = byte_bpe(path)
        for whole in it:
            for i in range(0, whole.num_rows, 256):
                b = whole.slice(i, 256)
                texts = b.column(text_col).to_pylist()
                ids = bpe.encode_batch([t or "" for t in texts])
                same = [None if t is None else bpe.decode_bytes(x) == t.encode("utf-8") for t, x in zip(texts, ids)]
                n = pa.array([None if t is None else len(x) for t, x in zip(texts, ids)], pa.int32())
                offs = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offs[1:])
                lists = pa.ListArray.from_arrays(pa.array(offs, pa.int32(), mask=np.array([t is None for t in texts] + [False])), pa.array(np.concatenate(ids), pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(id_col).cast(pa.int64()), lists, n, pa.array(same, pa.bool_())], names=["doc_id", "ids", "n_tokens", "round_trip"])

    return map_arrow(docs.select(id_col, text_col), run, SCHEMA)


def decode(encoded: DataFrame, params: BpeParams = BpeParams(), id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of rows of ids; null ids give a null text."""
    path = rank_path(params.tokenizers, params.ranks)

    def run(it):
        bpe = byte_bpe(path)
        for b in it:
            texts = [None if x is None else bpe.decode(np.array([-1 if i is None else i for i in x], np.int64)) for x in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(id_col).cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return map_arrow(encoded.select(id_col, ids_col), run, "doc_id bigint, text string")


