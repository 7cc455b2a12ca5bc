"""Byte-level BPE encoding and decoding with a segment tree of pair ranks.

A piece is a leaf per byte; a live leaf holds the rank of the pair formed by its token and the next live
one. Every inner node keeps the minimum of (rank, position) below it, so the root names the leftmost pair
of the least rank. A merge updates the merged leaf, the leaf that dies and the live neighbour on the left:
three point updates of logarithmic cost, which keeps a piece of n bytes at O(n log n). Short pieces that were
not met before merge side by side, a column each in numpy arrays of trees; long ones merge by themselves.

Null texts encode as the empty text. Texts are encoded whole, of any length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import bound_batches

#: No pair, or a pair without a rank.
NO_PAIR = 1 << 62
#: Distinct pieces remembered in a task; beyond it the memory starts anew, which changes no result.
REMEMBERED_PIECES = 100_000
#: The length beyond which a piece merges by itself, in bytes; a power of two.
WIDEST = 64
#: Characters of texts cut together, unless one text is longer; and pieces merged side by side.
TOGETHER, AT_ONCE = 1_000_000, 20_000
NO_RANK = 1 << 40


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece, merging the leftmost pair of the least rank until no pair has a rank."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    if n == 1:
        raise ValueError(f"byte {piece!r} has no rank")
    width = 1 << (n - 1).bit_length()
    tree = [NO_PAIR] * (2 * width)
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            tree[width + i] = rank << 32 | i
    for node in range(width - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left < right else right

    def put(position: int, value: int) -> None:
        node = width + position
        tree[node] = value
        while node > 1:
            node >>= 1
            left, right = tree[2 * node], tree[2 * node + 1]
            least = left if left < right else right
            if tree[node] == least:
                break
            tree[node] = least

    end = list(range(1, n + 1))  # where the token that starts here ends, which is where the next one starts
    before = list(range(-1, n))  # the start of the live token on the left
    while tree[1] < NO_PAIR:
        at = tree[1] & 0xFFFFFFFF
        dies = end[at]
        stop = end[at] = end[dies]
        put(dies, NO_PAIR)
        if stop < n:
            before[stop] = at
            rank = ranks.get(piece[at : end[stop]])
        else:
            rank = None
        put(at, NO_PAIR if rank is None else rank << 32 | at)
        left = before[at]
        if left >= 0:
            rank = ranks.get(piece[left:stop])
            put(left, NO_PAIR if rank is None else rank << 32 | left)
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : end[at]]])
        at = end[at]
    return ids


class PairRanks:
    """Ranks of pairs of adjacent tokens, looked up for whole arrays."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.size = max(ranks.values()) + 1
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Each pair's rank, or NO_RANK."""
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NO_RANK)


def merge_pieces(pieces: list[bytes], pairs: PairRanks, width: int) -> list[list[int]]:
    """Token ids of pieces of 2 to width bytes, a power of two; column k of each array belongs to piece k.

    The tree of a column is stored as a heap of 2 * width nodes, its leaves from width on.
    """
    n = np.array([len(p) for p in pieces])
    count, shift = len(pieces), width.bit_length() - 1
    raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(count, width)
    ids = np.ascontiguousarray(pairs.bytes[raw].T)
    end = np.repeat(np.arange(1, width + 1)[:, None], count, 1)
    before = np.repeat(np.arange(-1, width)[:, None], count, 1)
    tree = np.full((2 * width, count), NO_RANK << shift, np.int64)
    for i in range(width - 1):
        rank = np.where(i + 1 < n, pairs.find(ids[i], ids[i + 1]), NO_RANK)
        tree[width + i] = rank << shift | i
    for node in range(width - 1, 0, -1):
        np.minimum(tree[2 * node], tree[2 * node + 1], out=tree[node])
    k = np.flatnonzero(tree[1] < NO_RANK << shift)
    while len(k):
        at = tree[1, k] & (width - 1)
        dies = end[at, k]
        stop = end[dies, k]
        merged = tree[1, k] >> shift
        ids[at, k] = merged
        end[at, k] = stop
        inside = stop < n[k]
        right = np.where(inside, stop, 0)
        before[np.where(inside, stop, width), k] = at
        rank = np.where(inside, pairs.find(merged, ids[right, k]), NO_RANK)
        tree[width + at, k] = rank << shift | at
        tree[width + dies, k] = NO_RANK << shift | dies
        left = before[at, k]
        has = left >= 0
        left = np.where(has, left, at)
        rank = np.where(has, pairs.find(ids[left, k], merged), rank)
        tree[width + left, k] = rank << shift | left
        nodes = [width + left, width + at, width + dies]
        for _ in range(shift):
            for j in range(3):
                nodes[j] = nodes[j] >> 1
                tree[nodes[j], k] = np.minimum(tree[2 * nodes[j], k], tree[2 * nodes[j] + 1, k])
        k = k[tree[1, k] < NO_RANK << shift]
    out, at, rows = [[] for _ in pieces], np.zeros(count, np.int64), np.arange(count)
    while len(rows):
        for i, token in zip(rows.tolist(), ids[at, rows].tolist(), strict=True):
            out[i].append(token)
        at = end[at, rows]
        live = at < n[rows]
        at, rows = at[live], rows[live]
    return out


class Codec:
    """Encodes texts to ids and ids to bytes; made anew in each task."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pieces = ranks, regex.compile(pattern)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.pairs = PairRanks(ranks)
        self.known: dict[str, list[int]] = {}

    def _learn(self, pieces: set[str]) -> None:
        by_width: dict[int, list[str]] = {}
        for piece in pieces:
            data = piece.encode()
            if data in self.ranks:
                self.known[piece] = [self.ranks[data]]
            elif len(data) > WIDEST:
                self.known[piece] = merge_piece(data, self.ranks)
            else:
                by_width.setdefault(max(8, 1 << (len(data) - 1).bit_length()), []).append(piece)
        for width, group in by_width.items():
            for at in range(0, len(group), AT_ONCE):
                part = group[at : at + AT_ONCE]
                self.known.update(zip(part, merge_pieces([p.encode() for p in part], self.pairs, width), strict=True))

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))

    def encode_all(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text; texts are taken together up to some size, so that new pieces merge side by side."""
        at = 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size + len(texts[stop]) <= TOGETHER):
                size += len(texts[stop])
                stop += 1
            cut = [self.pieces.findall(x) for x in texts[at:stop]]
            if len(self.known) > REMEMBERED_PIECES:
                self.known.clear()
            self._learn(set().union(*cut).difference(self.known))
            for pieces in cut:
                yield list(chain.from_iterable(map(self.known.__getitem__, pieces)))
            at = stop

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _mapped(spark, path: str, pattern: str, returns: str, rows: Callable[[Codec, pd.Series], Iterable]) -> Callable[[Column], Column]:
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(load_ranks(path))  # under 1 MB, fixed by the vocabulary file

    @F.pandas_udf(returns)
    def mapped(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec(shared.value, pattern)
        for batch in batches:
            yield pd.Series(list(rows(codec, batch)), dtype=object)

    return mapped


def encode_column(spark, path: str, pattern: str) -> Callable[[Column], Column]:
    """A function from a text column to its ids, array<int>."""
    return _mapped(spark, path, pattern, "array<int>", lambda codec, texts: codec.encode_all([x or "" for x in texts]))


def decode_column(spark, path: str, pattern: str) -> Callable[[Column], Column]:
    """A function from an ids column to its bytes; null ids decode as no bytes."""
    return _mapped(spark, path, pattern, "binary", lambda codec, ids: (codec.decode([] if x is None else list(x)) for x in ids))


DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id with the count and digest of its ids and the digest of the bytes that they decode to.

    Encodes and decodes in one pass, so that ids and bytes never leave the task.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(path))

    @F.pandas_udf(DIGEST)
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = Codec(shared.value, pattern)
        decimal = {rank: str(rank) for rank in codec.tokens}
        for batch in batches:
            rows = []
            for ids in codec.encode_all([x or "" for x in batch]):
                joined = " ".join(map(decimal.__getitem__, ids)).encode()
                rows.append((len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", digest("text").alias("d")).select("doc_id", "d.*")
