"""Byte-level BPE by prefix dynamic programming, exact against merge-by-rank encoding.

For a byte string the encoding of each prefix ends in one certain token. ``PrefixEncoder`` stores that token for every
prefix: token t of length n is the last of prefix i if the last token of prefix i - n and t are *compatible*, that is,
merging the two tokens' bytes by rank never crosses the border between them. Walking the stored tokens back gives the
encoding; appending bytes goes on from the last prefix; an edit recomputes from its place until the stored tokens of
as many prefixes as the longest token has bytes agree again, and keeps the rest.

A text is cut into pieces by a pattern first and each piece is encoded by itself; a piece that is itself in the
vocabulary is that token. New pieces of a run of texts are encoded in byte order, and each goes on from the prefix that it
shares with the one before, as the last token of a prefix doesn't depend on what follows. Null texts count as empty: no tokens. Texts are never shortened. Workers remember encoded
pieces in two generations of at most ``CACHE`` entries; this changes speed only.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import re
from collections.abc import Iterable

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from sessionloom.llm import arrowio

CACHE = 250_000
PAIRS = 400_000
#: Characters of the longest piece that workers remember.
REMEMBERED = 256


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, f.read().split(b"\n")))}


def merge_by_rank(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The plain way: join the adjacent pair of lowest rank, leftmost first, until none is in the vocabulary."""
    parts = [piece[k : k + 1] for k in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, len(ranks) * 2), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank >= len(ranks) * 2:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Vocabulary:
    """Ranks, how each token comes about, and which pairs of tokens may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.bytes = ranks, {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks))
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._spines: dict[int, tuple] = {}
        self._pairs: dict[int, bool] = {}
        # tokens by their bytes from the last to the first: (node << 8 | byte) -> node, node -> token or -1
        self._step: dict[int, int] = {}
        self._token = [-1]
        for piece, token in ranks.items():
            node = 0
            for byte in reversed(piece):
                key = node << 8 | byte
                if (after := self._step.get(key)) is None:
                    after = self._step[key] = len(self._token)
                    self._token.append(-1)
                node = after
            self._token[node] = token

    def halves(self, token: int) -> tuple[int, int] | None:
        """The pair whose merge gives the token; (-1, -1) for a byte, None if merging its bytes never gives it."""
        if token not in self._halves:
            piece, found = self.bytes[token], (-1, -1)
            if len(piece) > 1:
                parts = [piece[k : k + 1] for k in range(len(piece))]
                while len(parts) > 2:
                    rank, at = min((self.ranks.get(a + b, 1 << 60), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                    if rank == 1 << 60:
                        break
                    parts[at : at + 2] = [parts[at] + parts[at + 1]]
                found = tuple(map(self.ranks.get, parts)) if len(parts) == 2 else None
            self._halves[token] = found
        return self._halves[token]

    def spines(self, token: int) -> tuple[list, list] | None:
        """(token's bytes, rank at which it is merged away) down the right and down the left edge; None: never arises."""
        if token not in self._spines:
            out: list | None = []
            for side in (1, 0):
                edge, at, ends = [], token, 1 << 60
                while at >= 0:
                    edge.append((self.bytes[at], ends))
                    if (pair := self.halves(at)) is None:
                        out = None
                        break
                    at, ends = pair[side], at
                if out is None:
                    break
                out.append(edge)
            self._spines[token] = out
        return self._spines[token]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and then b by rank gives a and b again."""
        key = a << 32 | b
        known = self._pairs.get(key)
        if known is None:
            left, right = self.spines(a), self.spines(b)
            known = left is not None and right is not None
            if known:
                get = self.ranks.get
                for x, x_ends in left[0]:
                    for y, y_ends in right[1]:
                        rank = get(x + y)
                        if rank is not None and rank < x_ends and rank <= y_ends and self.halves(rank) == (self.ranks[x], self.ranks[y]):
                            known = False
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            self._pairs[key] = known
        return known

    def extend(self, piece: bytes, last: list[int], until: int) -> None:
        """Appends to ``last`` the last tokens of the prefixes of piece, as far as the one of length ``until``."""
        step, tokens, pairs, compatible = self._step.get, self._token, self._pairs.get, self.compatible
        for end in range(len(last), until + 1):
            node, found, start = 0, [], end
            while start:
                node = step(node << 8 | piece[start - 1])
                if node is None:
                    break
                start -= 1
                if (token := tokens[node]) >= 0:
                    found.append((start, token))
            for start, token in reversed(found):
                if start:
                    known = pairs(last[start] << 32 | token)
                    if known is None:
                        known = compatible(last[start], token)
                    if known:
                        break
                elif self.spines(token) is not None:
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
            last.append(token)


class PrefixEncoder:
    """The encoding of one piece, kept for every prefix."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.piece, self.last = vocabulary, b"", [-1]
        self.append(piece)

    def append(self, more: bytes) -> None:
        self.piece += more
        self.vocabulary.extend(self.piece, self.last, len(self.piece))

    def become(self, piece: bytes) -> PrefixEncoder:
        """Another piece: prefixes that it shares with the one before stay."""
        same = 0
        for a, b in zip(self.piece, piece, strict=False):
            if a != b:
                break
            same += 1
        self.piece = piece
        del self.last[same + 1 :]
        self.vocabulary.extend(piece, self.last, len(piece))
        return self

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Replaces piece[start:stop]; returns how many prefixes were computed again."""
        old, shift = self.last, len(new) - (stop - start)
        self.piece = self.piece[:start] + new + self.piece[stop:]
        self.last = old[: start + 1]
        same = 0
        for end in range(start + 1, len(self.piece) + 1):
            self.vocabulary.extend(self.piece, self.last, end)
            same = same + 1 if end - shift > stop and self.last[end] == old[end - shift] else 0
            if same >= self.vocabulary.longest:
                self.last += old[end - shift + 1 :]
                return end - start
        return len(self.piece) - start

    def tokens(self) -> list[int]:
        out, end = [], len(self.piece)
        while end:
            out.append(self.last[end])
            end -= len(self.vocabulary.bytes[self.last[end]])
        return out[::-1]


def encode_piece(vocabulary: Vocabulary, piece: bytes) -> list[int]:
    token = vocabulary.ranks.get(piece)
    return [token] if token is not None else PrefixEncoder(vocabulary, piece).tokens()


@functools.lru_cache(1)
def _classes() -> dict[str, list[tuple[int, int]]]:
    """Ranges of code points of \\p{L}, \\p{N} and \\s as the library's own pattern engine has them (Unicode versions differ)."""
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = {}
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        engine = tiktoken.Encoding(name, pat_str=name, mergeable_ranks={bytes((k,)): k for k in range(256)}, special_tokens={})
        points = sorted(map(ord, bytes(engine.encode_ordinary(everything)).decode()))
        edges = [k for k in range(1, len(points)) if points[k] != points[k - 1] + 1]
        out[name] = [(points[i], points[j - 1]) for i, j in zip([0, *edges], [*edges, len(points)], strict=True)]
    return out


def _spelled(pattern: str, top: int) -> re.Pattern:
    """The pattern for ``re``, which lacks \\p{...}: the classes' ranges up to code point ``top`` stand in it instead."""
    ranges = {n: "".join(f"\\U{a:08x}-\\U{min(b, top):08x}" for a, b in x if a <= top) for n, x in _classes().items()}
    pieces, inside = [], False
    for part in re.findall(r"\\[pP]\{\w+\}|\\.|.", pattern, re.DOTALL):
        if part in ranges:
            pieces.append(ranges[part] if inside else f"[{ranges[part]}]")
        elif part == r"\S":
            pieces.append(f"[^{ranges[chr(92) + 's']}]")
        else:
            inside = (inside or part == "[") and part != "]"
            pieces.append(part)
    return re.compile("".join(pieces))


@functools.lru_cache(4)
def piece_finder(pattern: str):
    """text -> pieces. Texts of code points under 256 take a pattern with short classes, which is several times faster."""
    short, whole = _spelled(pattern, 0xFF).findall, _spelled(pattern, 0x10FFFF).findall

    def find(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return whole(text)
        return short(text)

    return find


class PieceCache(dict):
    """piece -> (ids joined by commas, their number, the bytes they decode to)."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.old = vocabulary, {}

    def __missing__(self, piece: str) -> tuple[str, int, bytes]:
        value = self.old.get(piece)
        if value is None:
            value = self._value(encode_piece(self.vocabulary, piece.encode()))
        if len(piece) <= REMEMBERED:
            self._keep(piece, value)
        return value

    def _value(self, ids: list[int]) -> tuple[str, int, bytes]:
        return ",".join(map(str, ids)), len(ids), b"".join(map(self.vocabulary.bytes.__getitem__, ids))

    def _keep(self, piece: str, value: tuple[str, int, bytes]) -> None:
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        self[piece] = value

    def learn(self, pieces: Iterable[str]) -> None:
        """Encodes those that aren't known in their order, so that each goes on from the prefix it shares with the one before."""
        ranks, encoder = self.vocabulary.ranks.get, PrefixEncoder(self.vocabulary)
        for piece in sorted([p for p in set(pieces) if p not in self and len(p) <= REMEMBERED]):
            value = self.old.get(piece)
            if value is None:
                whole = piece.encode()
                token = ranks(whole)
                value = self._value([token] if token is not None else encoder.become(whole).tokens())
            self._keep(piece, value)


@arrowio.resident
def cached_vocabulary(path: str) -> PieceCache:
    return PieceCache(Vocabulary(load_ranks(path)))


def encode_text(text: str, path: str, pattern: str) -> list[int]:
    cache = cached_vocabulary(path)
    return [int(x) for piece in piece_finder(pattern)(text) for x in cache[piece][0].split(",")]


def decode(ids: list[int], path: str) -> bytes:
    return b"".join(map(cached_vocabulary(path).vocabulary.bytes.__getitem__, ids))


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int> of every whole text."""

    def kernel(ids, texts):
        return pa.array(ids, pa.int64()), pa.array([encode_text((t or b"").decode(), path, pattern) for t in texts], pa.list_(pa.int32()))

    return arrowio.map_chunks(arrowio.id_text(docs), kernel, "doc_id long, ids array<int>")


def digest_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the same encoding and its decoding, digested in the worker."""

    def kernel(ids, texts):
        cache, find = cached_vocabulary(path), piece_finder(pattern)
        counts, digests, decoded = [], [], []
        pieces = [find((text or b"").decode()) for text in texts]
        cache.learn(itertools.chain.from_iterable(pieces))
        for each in pieces:
            found = [cache[piece] for piece in each]
            counts.append(sum([x[1] for x in found]))
            digests.append(hashlib.sha256(",".join([x[0] for x in found]).encode()).hexdigest())
            decoded.append(hashlib.sha256(b"".join([x[2] for x in found])).hexdigest())
        return pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())

    return arrowio.map_chunks(arrowio.id_text(docs), kernel, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest_documents(arrowio.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
