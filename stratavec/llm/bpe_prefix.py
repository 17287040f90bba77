"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a piece exactly one vocabulary token can end its encoding.
An automaton over the vocabulary, with suffix links, yields the tokens that are
suffixes of a prefix; such a token is the right one if what is in front of it is
empty, or if it may stand behind the last token of that shorter prefix.  Two
tokens may be neighbours if encoding their joined bytes never merges across the
border.  Following the stored last tokens back from the end gives the ids; no
merge is ever simulated.

The border test compares the pieces that lie at the border while both tokens are
being built: the right edge of the first token's merge tree against the left edge
of the second's.  A merge across happens if its rank comes up while both of its
sides exist and neither has been taken into a larger piece; at equal ranks the
leftmost merge is first.

Pieces come from the tokenizer's own pre-tokenizer, special tokens stand for
themselves.  The vocabulary file is read on the driver and sent to the tasks
(its size is fixed); units of text are remembered, see ``token_units``.

Defined cases: a null text is the empty text, which has no tokens.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stratavec.llm.common import text_struct
from stratavec.llm.token_units import LETTERS, UnitMemory

VOCABULARY = "byte_bpe_50k.json"
# remembered answers of the border test
REMEMBERED_PAIRS = 2_000_000
_NEVER = 1 << 60


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def read_vocabulary(path: str | None = None) -> str:
    with open(path or default_vocabulary(), encoding="utf-8") as file:
        return file.read()


def byte_of_char() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: printable
    ones for themselves, the others in order from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class PrefixEncoder:
    """Encoder and decoder for one byte-level BPE vocabulary (JSON text)."""

    def __init__(self, vocabulary: str):
        model = json.loads(vocabulary)
        ids: dict[str, int] = model["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.pieces = Tokenizer.from_str(vocabulary).pre_tokenizer.pre_tokenize_str
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            key = ids[left], ids[right]
            self.rank[key] = rank
            self.parts.setdefault(ids[left + right], (*key, rank))
        self.automaton = ahocorasick.Automaton()
        for token, number in ids.items():
            if token not in self.special:
                self.automaton.add_word(token, number)
        self.automaton.make_automaton()
        self.size_of = {number: len(token) for token, number in ids.items()}
        byte_of = byte_of_char()
        self._shown = {b: c for c, b in byte_of.items()}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        for token, number in ids.items():
            self.bytes_of[number] = bytes(byte_of[c] for c in token)
        for token, number in self.special.items():
            self.bytes_of[number] = token.encode()
        self._edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self._fits: dict[int, bool] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Nodes of the tree's left (0) or right (1) edge, each with the rank of
        the merge that takes it in."""
        key = token, side
        if key not in self._edges:
            nodes, taken = [], _NEVER
            while True:
                nodes.append((token, taken))
                parts = self.parts.get(token)
                if parts is None:
                    break
                token, taken = parts[side], parts[2]
            self._edges[key] = nodes
        return self._edges[key]

    def may_follow(self, first: int, second: int) -> bool:
        """No merge crosses the border between the two tokens."""
        key = first << 32 | second
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) >= REMEMBERED_PAIRS:
                self._fits.clear()
            known = self._fits[key] = self._border_holds(first, second)
        return known

    def _border_holds(self, first: int, second: int) -> bool:
        rank = self.rank
        right_side = self._edge(second, 0)
        for left, left_taken in self._edge(first, 1):
            for right, right_taken in right_side:
                at = rank.get((left, right))
                if at is not None and at < left_taken and at <= right_taken:
                    return False
        return True

    def piece(self, text: str) -> list[int]:
        """Ids of one piece in byte-level characters."""
        n = len(text)
        last, sizes = [-1] * n + [-1], [0] * (n + 1)
        fits, size_of = self._fits, self.size_of
        for end, token in self.automaton.iter(text):
            end += 1
            if last[end] < 0:
                size = size_of[token]
                if size < end:
                    before = last[end - size]
                    if before < 0:
                        continue
                    key = before << 32 | token
                    if not (fits[key] if key in fits else self.may_follow(before, token)):
                        continue
                last[end], sizes[end] = token, size
        out, end = [], n
        while end:
            out.append(last[end])
            end -= sizes[end]
        out.reverse()
        return out

    def unit(self, unit: str) -> bytes:
        """Packed ids of a unit of text."""
        if LETTERS.fullmatch(unit):  # one piece
            shown = unit.encode().decode("latin-1").translate(self._shown)
            return array("I", self.piece(shown)).tobytes()
        return b"".join([self._remembered_piece(p) for p, _ in self.pieces(unit)])

    @lru_cache(maxsize=200_000)
    def _remembered_piece(self, text: str) -> bytes:
        return array("I", self.piece(text)).tobytes()

    def memory(self) -> tuple[UnitMemory, dict[str, bytes]]:
        special = {t: np.array([i], dtype="<u4").tobytes() for t, i in self.special.items()}
        return UnitMemory(self.unit), special

    def decode(self, packed: bytes) -> str:
        table = self.bytes_of
        ids = np.frombuffer(packed, dtype="<u4").tolist()
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _ready(vocabulary: str) -> tuple[PrefixEncoder, UnitMemory, dict[str, bytes]]:
    encoder = PrefixEncoder(vocabulary)
    return encoder, *encoder.memory()


def encode(text: str, vocabulary: str) -> list[int]:
    """Ids of one text."""
    _, memory, special = _ready(vocabulary)
    return np.frombuffer(memory.packed(text, special), dtype="<u4").tolist()


_DIGEST = pa.struct(
    [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
)


def round_trip(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """Number of tokens of every document, and digests of ids and decoded text."""
    sent = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def row(text: str) -> tuple:
        encoder, memory, special = _ready(sent.value)
        packed = memory.packed(text, special)
        decoded = encoder.decode(packed).encode("utf-8")
        return (
            len(packed) // 4,
            hashlib.sha256(packed).hexdigest(),
            hashlib.sha256(decoded).hexdigest(),
        )

    digest = text_struct(row, _DIGEST)
    return docs.select("doc_id", digest(F.col("text")).alias("d")).select("doc_id", "d.*")


def token_ids(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """``(doc_id, ids)`` of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    ids = text_struct(
        lambda text: (encode(text, sent.value),), pa.struct([("ids", pa.list_(pa.int64()))])
    )
    return docs.select("doc_id", ids(F.col("text")).alias("t")).select("doc_id", "t.ids")
