"""Byte-level BPE by prefix dynamic programming.

Each byte prefix of a piece has exactly one valid last token: the one that ends the encoding of
that prefix. A token may follow another exactly if encoding the bytes of both gives just these two,
which is decided by the merges along both sides of their border. A table of last tokens therefore
grows by appending, and after an edit only the bytes near it are worked out again.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import batched, chain

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import held, over_texts

#: Longer texts are split into pieces block by block.
WHOLE_CHARS = 1 << 20
#: Entries kept of encoded pieces, of judged pairs and of prefixes, and bytes of what they hold; beyond either, the memory starts anew.
REMEMBERED, REMEMBERED_BYTES = 400_000, 32 << 20
#: Longer pieces aren't remembered.
SHORT = 64


class Vocabulary:
    """Ranks of a byte-level vocabulary with what prefix encoding needs."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        #: Each suffix of a token: the token it is itself, or -1.
        self.suffixes: dict[bytes, int] = {}
        for token in ranks:
            for i in range(len(token)):
                suffix = token[i:]
                self.suffixes[suffix] = ranks.get(suffix, -1)
        self.halves: list[tuple[int, int]] = [(r, r) for r in range(len(self.bytes_of))]
        self.merged: dict[tuple[int, int], int] = {}
        #: Judged pairs, by left << 32 | right.
        self.follows: dict[int, bool] = {}
        self.edges: tuple[dict[int, tuple[int, ...]], dict[int, tuple[int, ...]]] = ({}, {})
        #: Last tokens of prefixes that many pieces share.
        self.prefixes: dict[bytes, int] = {}
        self.prefix_bytes = 0
        for rank in sorted(ranks.values()):
            token = self.bytes_of[rank]
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut], rank), ranks.get(token[cut:], rank)
                if left < rank and right < rank and self._judge(left, right):
                    self.halves[rank] = (left, right)
                    self.merged[left, right] = rank
                    break

    def _edge(self, token: int, side: int) -> tuple[int, ...]:
        """The tokens that stand at a token's end (side 1) or beginning (side 0) while its bytes are merged, from a byte to the token itself."""
        known = self.edges[side].get(token)
        if known is None:
            half = self.halves[token][side]
            known = self.edges[side][token] = (token,) if half == token else (*self._edge(half, side), token)
        return known

    def _judge(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both, lowest ranks first and leftmost of equal ones, never crosses their border.

        As long as it doesn't, each side is merged as it would be alone, so what meets at the border is
        one token of either edge, and a merge's rank is the token that it makes. The next merge there
        is the lowest of three: the left edge's next, the one across, and the right edge's next, in
        this order where they are equal, as it is their order in the text. If it is ever the one
        across, the border is lost; if both edges come to their ends first, it stays.
        """
        lefts, rights, never = self._edge(left, 1), self._edge(right, 0), len(self.bytes_of)
        i, j, across = 0, 0, self.merged.get
        n_left, n_right = len(lefts) - 1, len(rights) - 1
        while True:
            on_left = lefts[i + 1] if i < n_left else never
            on_right = rights[j + 1] if j < n_right else never
            crossing = across((lefts[i], rights[j]), never)
            if crossing < on_left and crossing <= on_right and crossing < never:
                return False
            if on_left == on_right == never:
                return True
            if on_left <= on_right:
                i += 1
            else:
                j += 1

    def may_follow(self, left: int, right: int) -> bool:
        pair = left << 32 | right
        known = self.follows.get(pair)
        if known is None:
            if len(self.follows) >= REMEMBERED:
                self.follows.clear()
            known = self.follows[pair] = self._judge(left, right)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        return PrefixTable(self, piece).tokens() if len(piece) > SHORT else self._encode_short(piece)

    def _encode_short(self, piece: bytes) -> list[int]:
        """As PrefixTable does, with last tokens of prefixes taken from pieces before."""
        known, table = self.prefixes, PrefixTable(self)
        if len(known) >= REMEMBERED or self.prefix_bytes >= REMEMBERED_BYTES:
            known.clear()
            self.prefix_bytes = 0
        table.data, last = piece, table.last
        for end in range(1, len(piece) + 1):
            token = known.get(prefix := piece[:end])
            if token is None:
                token = known[prefix] = table._last_token(end)
                self.prefix_bytes += end
            last.append(token)
        return table.tokens()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class PrefixTable:
    """Last tokens of all prefixes of a byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def _last_token(self, end: int) -> int:
        data, last, suffixes = self.data, self.last, self.vocabulary.suffixes
        candidates = []
        for start in range(end - 1, -1, -1):
            token = suffixes.get(data[start:end])
            if token is None:
                break
            if token >= 0:
                candidates.append((start, token))
        follows, judge = self.vocabulary.follows, self.vocabulary.may_follow
        for start, token in reversed(candidates):
            if start == 0:
                return token
            known = follows.get(last[start - 1] << 32 | token)
            if judge(last[start - 1], token) if known is None else known:
                return token
        raise ValueError("the vocabulary lacks a byte")

    def append(self, data: bytes) -> None:
        begin = len(self.data)
        self.data += data
        for end in range(begin + 1, len(self.data) + 1):
            self.last.append(self._last_token(end))

    def replace(self, start: int, stop: int, data: bytes) -> int:
        """Put data in the place of bytes start to stop; gives the number of prefixes worked out again.

        Prefixes before the edit keep their tokens. Behind it, once the last tokens of as many
        prefixes as the longest token has bytes are the old ones, all later ones are too.
        """
        old, shift = self.last, len(data) - (stop - start)
        self.data = self.data[:start] + data + self.data[stop:]
        self.last = old[:start]
        longest = max(map(len, self.vocabulary.ranks))
        same = 0
        for end in range(start + 1, len(self.data) + 1):
            token = self._last_token(end)
            self.last.append(token)
            behind = end > start + len(data)
            same = same + 1 if behind and old[end - shift - 1] == token else 0
            if same >= longest:
                self.last += old[end - shift :]
                return end - start
        return len(self.data) - start

    def tokens(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            token = self.last[end - 1]
            out.append(token)
            end -= len(self.vocabulary.bytes_of[token])
        return out[::-1]


class Pieces(dict):
    """The ids of each piece as little-endian bytes, encoded when first asked for."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.bytes = vocabulary, 0

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED or self.bytes >= REMEMBERED_BYTES:
            self.clear()
            self.bytes = 0
        data = piece.encode()
        made = np.array(self.vocabulary.encode_piece(data), "<u4").tobytes()
        if len(piece) <= SHORT:
            self[piece] = made
            self.bytes += len(data) + len(made)
        return made


def vocabulary(path: str) -> Vocabulary:
    return pieces(path).vocabulary


def loaded(path: str) -> Vocabulary:
    with open(path, "rb") as lines:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})


def pieces(path: str) -> Pieces:
    return held(("byte_bpe", path), lambda: Pieces(loaded(path)))


@cache
def compiled(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def encoded(text: str, path: str, pattern: str) -> Iterator[bytes]:
    """The ids of a text as little-endian bytes, block by block."""
    known = pieces(path).__getitem__
    if len(text) <= WHOLE_CHARS:
        yield b"".join(map(known, compiled(pattern).findall(text)))
        return
    for block in batched((m.group() for m in compiled(pattern).finditer(text)), 1 << 16):
        yield b"".join(map(known, block))


def encode(text: str, path: str, pattern: str) -> list[int]:
    """The ids of a text."""
    return list(chain.from_iterable(np.frombuffer(b, "<u4").tolist() for b in encoded(text, path, pattern)))


def digests(text: str | None, path: str, pattern: str) -> tuple[int, str, str]:
    """Number of ids, SHA-256 of the ids, SHA-256 of the bytes that the ids decode to."""
    n, of_ids, of_bytes, words = 0, hashlib.sha256(), hashlib.sha256(), vocabulary(path)
    for block in encoded(text or "", path, pattern):
        ids = np.frombuffer(block, "<u4")
        n += len(ids)
        of_ids.update(block)
        of_bytes.update(words.decode(ids.tolist()))
    return n, of_ids.hexdigest(), of_bytes.hexdigest()


def byte_bpe(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode every whole text, piece by piece of `pattern`, by the ranks in the file `path`.

    One pass over the scan, no shuffle. A null text counts as empty (no ids, digests of nothing), a
    null id is carried, repeated rows each give a row, an empty table gives none, other columns are
    ignored. with_ids adds the ids themselves as array<int>.
    """
    def rows(texts: list[str | None]) -> Iterator[tuple]:
        for text in texts:
            made = digests(text, path, pattern)
            yield (*made, encode(text or "", path, pattern)) if with_ids else made

    extra = ", ids array<int>" if with_ids else ""
    return over_texts(docs, [id_col], text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string" + extra, rows)
