"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file (base64 token, rank) becomes a tokenizers BPE model: every byte
maps to one printable character, every pair of tokens whose join is a token
becomes a merge, and merges are ordered by the rank of their join. Decoding
looks each id's characters up in the reversed byte table; a character whose
bytes are split over several ids comes back whole when the ids are joined.

Units. The split pattern never looks past white space except to see whether
white space ends, so the ids of a text are the ids of its units (one
optional space and a run of non-space, or a run of white space) one after
another. A task encodes each distinct unit once and keeps the ids of a
bounded number of units. Texts with characters on whose class two regular
expression engines could disagree go through the library whole.

Defined cases: null and empty texts have no ids; rows are independent, so
ties and repeated rows give repeated results; a null id stays null; other
columns are ignored whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from hourglass.llm.common import Generations, map_batches, one_thread, texts_of

# Units and pieces whose ids a process keeps, in two generations of so many:
# when the young one is full the old one goes, and what is used moves up.
UNITS_KEPT = 150_000
# Fixed value: the split pattern whose pieces ``_PIECE`` gives for plain text.
_PIECE_OF = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Characters every engine classes alike: printable ASCII, tab, line ends and
# the Latin-1 letters. The rest goes through the library whole.
_PLAIN = re.compile(r"[^\x20-\x7e\t\n\rÀ-ÖØ-öø-ÿ]")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+|\s+(?!\S)|\s+")
_UNIT = re.compile(r" ?[^ \t\n\r]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+")


@lru_cache(maxsize=1)
def byte_characters() -> list[str]:
    """The printable character that stands for each byte: the byte's own where
    it is printable, else the next free one from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


def build_tokenizer(ranks: dict[bytes, int], pattern: str):
    """A tokenizers byte-level BPE with the ids of ``ranks``."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    chars = byte_characters()
    spell = lambda token: "".join(chars[b] for b in token)
    merges = []
    for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
        for cut in range(1, len(token)):
            if token[:cut] in ranks and token[cut:] in ranks:
                merges.append((spell(token[:cut]), spell(token[cut:])))
    model = models.BPE(vocab={spell(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True)
    tokenizer = Tokenizer(model)
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tokenizer


class Codec:
    """Encoder and decoder of one task."""

    def __init__(self, path: str, pattern: str):
        one_thread()
        ranks = read_ranks(path)
        self.tokenizer = build_tokenizer(ranks, pattern)
        back = {c: b for b, c in enumerate(byte_characters())}
        self.table: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for spelled, i in self.tokenizer.get_vocab().items():
            self.table[i] = bytes(back[c] for c in spelled)
        # The plain-text split into pieces below is that of this pattern.
        self.by_pieces = pattern == _PIECE_OF
        self.units = Generations(UNITS_KEPT, self._of_units)
        self.pieces = Generations(UNITS_KEPT, self._of_pieces)

    def _of_pieces(self, pieces: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _of_units(self, units: list[str]) -> list[bytes]:
        if not self.by_pieces:
            return self._of_pieces(units)
        split = [_PIECE.findall(u) for u in units]
        known = self.pieces.fetch({p for s in split for p in s})
        return [b"".join([known[p] for p in s]) for s in split]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for text in texts:
            if _PLAIN.search(text):
                out += self._of_pieces([text])
                continue
            units = _UNIT.findall(text)
            known = self.units.fetch(units)
            out.append(b"".join(map(known.__getitem__, units)))
        return out

    def encode_with_offsets(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids and the code points [start, end) each of them touches; the ids that
        share the bytes of one character all touch it."""
        e = self.tokenizer.encode_batch([text], add_special_tokens=False)[0]
        return e.ids, e.offsets

    def decode(self, ids: bytes) -> bytes:
        table = self.table
        return b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def _codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           offsets: bool = False) -> DataFrame:
    """(id, ids array<int>[, starts, ends]) of every whole text."""
    extra = ", starts array<int>, ends array<int>" if offsets else ""
    ddl = f"{id_col} {dict(docs.dtypes)[id_col]}, ids array<int>{extra}"

    def run(batch):
        codec, texts = _codec(path, pattern), texts_of(batch, text_col)
        if not offsets:
            ids = [np.frombuffer(b, "<u4").astype("i4") for b in codec.encode_batch(texts)]
            return {id_col: batch.column(id_col), "ids": ids}
        both = [codec.encode_with_offsets(t) for t in texts]
        return {id_col: batch.column(id_col), "ids": [i for i, _ in both],
                "starts": [[s for s, _ in o] for _, o in both], "ends": [[e for _, e in o] for _, o in both]}

    return map_batches(docs.select(id_col, text_col), run, ddl)


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes, text) of every row of ids; bytes that are not UTF-8 show as U+FFFD in the text."""
    ddl = f"{id_col} {dict(encoded.dtypes)[id_col]}, bytes binary, text string"

    def run(batch):
        codec = _codec(path, pattern)
        got = [codec.decode(np.array(x or (), "<u4").tobytes()) for x in batch.column(ids_col).to_pylist()]
        return {id_col: batch.column(id_col), "bytes": got, "text": [b.decode("utf-8", "replace") for b in got]}

    return map_batches(encoded.select(id_col, ids_col), run, ddl)


def digest_round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """Encode, decode and digest every whole text in one pass: n_tokens, ids_sha256, decoded_sha256."""
    ddl = f"{id_col} {dict(docs.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batch):
        codec = _codec(path, pattern)
        ids = codec.encode_batch(texts_of(batch, text_col))
        return {id_col: batch.column(id_col), "n_tokens": [len(b) // 4 for b in ids],
                "ids_sha256": [hashlib.sha256(b).hexdigest() for b in ids],
                "decoded_sha256": [hashlib.sha256(codec.decode(b)).hexdigest() for b in ids]}

    return map_batches(docs.select(id_col, text_col), run, ddl)
