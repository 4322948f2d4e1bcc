"""Byte-level BPE encoding and decoding.

Bytes are mapped to Latin-1, so that pyahocorasick finds every vocabulary token inside a piece of text in one pass.
Encoding then walks from left to right over the longest matches and backtracks to shorter ones where a token can't
stand beside its left neighbour. Two adjacent tokens can stand side by side if no merge crosses their seam while they
are built; that is memoised by pair. Every text has one such sequence, and it is what merging by rank gives.
"""

from __future__ import annotations

import base64
import re
from array import array
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from keelson.llm.common import map_rows, whole_text
from keelson.llm.seams import NEVER, can_meet

#: Pieces of text whose ids, and pairs of tokens whose fit, a worker remembers; beyond that it starts anew.
MEMO_PIECES = 300_000
#: Bytes up to which a piece is remembered; longer ones rarely come back.
MEMO_BYTES = 64


class ByteBpe:
    """Encoder and decoder for one vocabulary of byte strings by rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.piece_pattern = regex.compile(pattern)
        self.plain_pattern, self.plain_text = _plain_variant(pattern)
        self.token_of = {rank: token for token, rank in ranks.items()}
        self._spine: dict[tuple[bytes, bool], tuple[list[bytes], list[int]]] = {}
        self._fits: dict[tuple[bytes, bytes], bool] = {}
        self._split: dict[bytes, tuple[bytes, bytes] | None] = {}
        self._shorter: dict[bytes, bytes | None] = {}
        self.memo = _Memo(self)

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        """Built where it is used: workers that only decode go without."""
        found = ahocorasick.Automaton()
        for token in self.ranks:
            found.add_word(token.decode("latin-1"), len(token))
        found.make_automaton()
        return found

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBpe:
        return _from_file(path, pattern)

    # -- encoding -----------------------------------------------------------------------------------------------

    def encode_packed(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        pattern = self.plain_pattern if self.plain_text and not self.plain_text.search(text) else self.piece_pattern
        return b"".join(map(self.memo.__getitem__, pattern.findall(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one piece: a token that is the whole piece, else the backtracking walk."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        size, longest_from, latin = len(piece), self.automaton.iter_long, piece.decode("latin-1")

        def longest(start: int) -> bytes:
            """Every byte is a token, so the leftmost longest match from here starts here."""
            last, length = next(longest_from(latin, start))
            if last - length + 1 != start:
                raise ValueError(f"no token starts at byte {start} of {piece[:40]!r}")
            return piece[start : last + 1]

        fits, shorter = self._fits, self._shorter
        dead = bytearray(size + 1)
        chosen: list[bytes] = []
        at = 0
        token: bytes | None = longest(0)
        while at < size:
            left = chosen[-1] if chosen else None
            while token is not None:
                after = at + len(token)
                if not dead[after]:
                    if left is None:
                        ok = self._reachable(token)
                    else:
                        ok = fits.get((left, token))
                        if ok is None:
                            ok = self.can_stand(left, token)
                    if ok:
                        break
                try:
                    token = shorter[token]
                except KeyError:
                    token = self._next_shorter(token)
            if token is None:  # nothing fits behind the left neighbour: take that one back and try a shorter one
                if not chosen:
                    raise ValueError(f"the vocabulary can't spell {piece[:40]!r}")
                dead[at] = 1
                token = chosen.pop()
                at -= len(token)
                token = self._next_shorter(token)
                continue
            chosen.append(token)
            at = after
            if at < size:
                token = longest(at)
        ranks = self.ranks
        return [ranks[x] for x in chosen]

    def _next_shorter(self, token: bytes) -> bytes | None:
        """The longest proper prefix that is a token."""
        found = self._shorter.get(token, b"")
        if found == b"":
            found = next((token[:n] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ranks), None)
            self._shorter[token] = found
        return found

    # -- which tokens can stand side by side ----------------------------------------------------------------------

    def _halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens whose merge builds this one; None for a token that merging never builds, () for one byte."""
        if token not in self._split:
            limit, found = self.ranks[token], None
            for cut in range(1, len(token)):
                a, b = token[:cut], token[cut:]
                if self.ranks.get(a, NEVER) < limit and self.ranks.get(b, NEVER) < limit and self._reachable(a) and self._reachable(b) and self.can_stand(a, b, limit):
                    found = (a, b)
                    break
            self._split[token] = found
        return self._split[token]

    def _reachable(self, token: bytes) -> bool:
        return len(token) == 1 or self._halves(token) is not None

    def _edge(self, token: bytes, right: bool) -> tuple[list[bytes], list[int]]:
        """The tokens that stand at one edge of a token while it is built, first to last, and the rank of the merge
        that ends each one (NEVER for the last)."""
        key = (token, right)
        if key not in self._spine:
            chain = [token]
            while len(chain[-1]) > 1:
                chain.append(self._halves(chain[-1])[right])
            chain.reverse()
            self._spine[key] = (chain, [self.ranks[x] for x in chain[1:]] + [NEVER])
        return self._spine[key]

    def can_stand(self, a: bytes, b: bytes, limit: int = NEVER) -> bool:
        """Whether no merge of rank under ``limit`` crosses the seam of a and b while both are built."""
        key = (a, b)
        if limit == NEVER and key in self._fits:
            return self._fits[key]
        ok = self._reachable(a) and self._reachable(b) and can_meet(*self._edge(a, True), *self._edge(b, False), self._rank_of, limit)
        if limit == NEVER:
            if len(self._fits) > MEMO_PIECES:
                self._fits.clear()
            self._fits[key] = ok
        return ok

    def _rank_of(self, a: bytes, b: bytes) -> int:
        return self.ranks.get(a + b, NEVER)

    # -- decoding -------------------------------------------------------------------------------------------------

    def decode_packed(self, ids: bytes) -> bytes:
        return b"".join(map(self.token_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Memo(dict):
    """Packed ids by piece of text, filled on demand."""

    def __init__(self, bpe: ByteBpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode("utf-8")
        packed = array("I", self.bpe.encode_piece(raw)).tobytes()
        if len(raw) <= MEMO_BYTES:
            if len(self) >= MEMO_PIECES:
                self.clear()
            self[piece] = packed
        return packed


def _plain_variant(pattern: str) -> tuple[re.Pattern | None, re.Pattern | None]:
    """The same pattern for the faster ``re`` module, and what a text mustn't hold for the two to agree.

    ``re`` has no letter and number classes. On ASCII without the four separator controls, and on the Latin letters
    up to U+024F, its own classes are the same.
    """
    plain = pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
    if r"\p" in plain:
        return None, None
    return re.compile(plain), re.compile("[^\x00-\x1b\x20-\x7f\xc0-\xd6\xd8-\xf6\xf8-ɏ]")


@lru_cache(maxsize=2)
def _from_file(path: str, pattern: str) -> ByteBpe:
    with open(path, "rb") as lines:
        return ByteBpe({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}, pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): the ids of every whole text, packed as little-endian unsigned 32-bit integers.

    A null text is the empty text and has no ids. Rows are kept as they are, repeated ones and null keys too; other
    columns are not read. An empty table gives an empty one. ``ranks_path`` must be there on every executor.
    """
    kind = docs.schema[key].dataType.simpleString()

    def make():
        bpe = ByteBpe.from_file(ranks_path, pattern)

        def step(rows: pa.RecordBatch) -> pa.RecordBatch:
            ids = [bpe.encode_packed(x) for x in rows.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([rows.column(0), pa.array(ids, pa.binary())], [key, "ids"])

        return step

    return map_rows(docs.select(key, whole_text(text).alias("text")), f"`{key}` {kind}, ids binary", make)


def decode(encoded: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """(key, ids, decoded): the bytes that packed ids stand for. Null ids count as none. An unknown id is an error."""
    kind = encoded.schema[key].dataType.simpleString()

    def make():
        bpe = ByteBpe.from_file(ranks_path, pattern)

        def step(rows: pa.RecordBatch) -> pa.RecordBatch:
            texts = [bpe.decode_packed(x or b"") for x in rows.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(texts, pa.binary())], [key, "ids", "decoded"])

        return step

    return map_rows(encoded.select(key, "ids"), f"`{key}` {kind}, ids binary, decoded binary", make)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, decoded): what decode() gives of encode(), by one worker for both, in one pass over the texts."""
    kind = docs.schema[key].dataType.simpleString()

    def make():
        bpe = ByteBpe.from_file(ranks_path, pattern)

        def step(rows: pa.RecordBatch) -> pa.RecordBatch:
            ids = [bpe.encode_packed(x) for x in rows.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([rows.column(0), pa.array(ids, pa.binary()), pa.array(map(bpe.decode_packed, ids), pa.binary())], [key, "ids", "decoded"])

        return step

    return map_rows(docs.select(key, whole_text(text).alias("text")), f"`{key}` {kind}, ids binary, decoded binary", make)
