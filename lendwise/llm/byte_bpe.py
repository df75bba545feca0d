"""Byte-level BPE encoding and decoding of whole texts from a file of merge ranks.

A pre-token starts as single bytes in a doubly linked list. Every pair of neighbours that a rank names waits in that
rank's bucket under the position of its left half; a bitmap of several levels, 64 bits a word, marks the buckets in
use. Find-first-set, once a level, gives the least rank, its bucket the leftmost position; an entry whose pair has
changed since is stale and skipped. A merge costs the same however long the pre-token is.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Iterator
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendwise.llm.common import resident, small_batches

CACHE_PIECES = 400_000
CACHE_PIECE_BYTES = 64
BLOCK_CHARS = 1 << 20
BLOCK_PIECES = 1 << 16


class RankQueue:
    """Positions by rank: a bucket for each rank in use, and three bitmap levels (the top one a single number) to find
    the least rank. Within a bucket the leftmost position comes first."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[int]] = {}
        self.low = [0] * ((ranks >> 6) + 1)
        self.middle = [0] * ((ranks >> 12) + 1)
        self.top = 0

    def add(self, rank: int, positions: list[int]) -> None:
        """A bucket for a rank that has none; ``positions`` ascend."""
        self.buckets[rank] = positions
        word = rank >> 6
        if not self.low[word]:
            if not self.middle[word >> 6]:
                self.top |= 1 << (word >> 6)
            self.middle[word >> 6] |= 1 << (word & 63)
        self.low[word] |= 1 << (rank & 63)

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.add(rank, [position])
        else:
            heappush(bucket, position)

    def first(self) -> int:
        """The least rank in use, -1 if there is none."""
        if not self.top:
            return -1
        word = (self.top & -self.top).bit_length() - 1
        bits = self.middle[word]
        word = word << 6 | (bits & -bits).bit_length() - 1
        bits = self.low[word]
        return word << 6 | (bits & -bits).bit_length() - 1

    def remove(self, rank: int) -> None:
        """The bucket of ``rank``, which is empty."""
        del self.buckets[rank]
        word = rank >> 6
        self.low[word] ^= 1 << (rank & 63)
        if not self.low[word]:
            self.middle[word >> 6] ^= 1 << (word & 63)
            if not self.middle[word >> 6]:
                self.top ^= 1 << (word >> 6)


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class ByteBpe:
    """Encoder for texts. Pieces met before, up to ``CACHE_PIECE_BYTES`` long, come from a bounded cache; a block's new
    pieces are merged together, end to end in one list with no pair across their edges."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=0)
        self.pieces = regex.compile(pattern)
        self.queue = RankQueue(max(ranks.values(), default=0))
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.byte_pairs = np.full(1 << 16, -1, dtype=np.int64)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.byte_pairs[token[0] << 8 | token[1]] = rank
        self.cache: dict[str, bytes] = {}

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each non-empty piece, as little-endian signed 32-bit numbers. Memory is about 100 bytes for each byte
        of the pieces."""
        ranks, longest, queue = self.ranks, self.longest, self.queue
        data = b"".join(pieces)
        n, raw = len(data), np.frombuffer(data, dtype=np.uint8).astype(np.int64)
        cuts = np.cumsum([0, *map(len, pieces)])
        edge = np.zeros(n + 1, dtype=np.uint8)  # 1 where a piece starts, and behind the last
        edge[cuts] = 1
        pairs = np.full(n, -1, dtype=np.int64)
        pairs[: n - 1] = np.where(edge[1:n] == 1, -1, self.byte_pairs[raw[:-1] << 8 | raw[1:]])
        order = np.argsort(pairs, kind="stable")
        order = order[np.searchsorted(pairs[order], 0) :]
        first = np.unique(pairs[order], return_index=True)
        for rank, positions in zip(first[0].tolist(), np.split(order, first[1][1:])):
            queue.add(rank, positions.tolist())
        pending = array("q", pairs.tobytes())  # rank of the pair that starts here, -1 if none
        token = array("i", self.bytes[raw].tobytes())  # the id that starts here, -1 inside a token
        end = array("q", range(1, n + 1))  # where the token that starts here ends, and so where the next one starts
        before = array("q", range(-1, n - 1))
        edge = edge.tobytes()
        push, rank_of = queue.push, ranks.get
        while (rank := queue.first()) >= 0:
            bucket = queue.buckets[rank]
            while bucket:
                left = heappop(bucket)
                if pending[left] != rank:
                    continue  # stale
                right = end[left]
                stop = end[left] = end[right]
                pending[right] = token[right] = -1
                token[left] = least = rank
                if edge[stop]:
                    pending[left] = -1
                else:
                    before[stop] = left
                    then = end[stop]
                    new = rank_of(data[left:then], -1) if then - left <= longest else -1
                    pending[left] = new
                    if new >= 0:
                        push(new, left)
                        least = min(least, new)
                if not edge[left]:
                    back = before[left]
                    new = rank_of(data[back:stop], -1) if stop - back <= longest else -1
                    pending[back] = new
                    if new >= 0:
                        push(new, back)
                        least = min(least, new)
                if least < rank:
                    break
            if not bucket:
                queue.remove(rank)
        ids = np.frombuffer(token, dtype=np.int32)
        starts = np.concatenate([[0], np.cumsum(ids >= 0)])[cuts] * 4
        found = ids[ids >= 0].astype("<i4").tobytes()
        return [found[lo:hi] for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist())]

    def _split(self, text: str) -> Iterator[list[str]]:
        """The matches of a text, in blocks of bounded size."""
        if len(text) <= BLOCK_CHARS and not self.pieces.groups:
            yield self.pieces.findall(text)
            return
        matches = (m.group() for m in self.pieces.finditer(text))
        while block := list(islice(matches, BLOCK_PIECES)):
            yield block

    def _join(self, texts: list[list[str]]) -> list[bytes]:
        if len(self.cache) > CACHE_PIECES:
            self.cache.clear()
        cache = self.cache
        new = [(piece, piece.encode()) for piece in set().union(*texts).difference(cache)]
        whole = {piece: self.ranks.get(raw) for piece, raw in new}
        cache.update((piece, rank.to_bytes(4, "little")) for piece, rank in whole.items() if rank is not None)
        parts = [(piece, raw) for piece, raw in new if raw and whole[piece] is None]
        if parts:
            cache.update(zip([piece for piece, _ in parts], self.merge([raw for _, raw in parts])))
        cache.setdefault("", b"")
        ids = [b"".join(map(cache.__getitem__, pieces)) for pieces in texts]
        for piece, raw in parts:
            if len(raw) > CACHE_PIECE_BYTES:
                del cache[piece]
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian signed 32-bit numbers; each match of the pattern is encoded on its own."""
        if sum(map(len, texts)) <= BLOCK_CHARS:
            return self._join([[piece for block in self._split(text) for piece in block] for text in texts])
        return [b"".join(self._join([block])[0] for block in self._split(text)) for text in texts]


Batches = Iterator[pa.RecordBatch]


def encoding(ranks_path: str, pattern: str) -> Callable[[Batches], Batches]:
    """What a worker does to encode: batches with ``text`` become the same rows with ``ids`` (a list) in its place."""

    def encode(batches: Batches) -> Batches:
        bpe = resident(("byte-bpe", ranks_path, pattern), lambda: ByteBpe(read_ranks(ranks_path), pattern))

        def out(batch: pa.RecordBatch, first: int, ids: list[bytes]) -> pa.RecordBatch:
            ends = np.cumsum([0, *(len(i) // 4 for i in ids)]).astype("<i4")
            flat = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
            rows = batch.drop_columns(["text"]).slice(first, len(ids))
            return rows.append_column("ids", pa.ListArray.from_arrays(pa.array(ends), flat))

        for batch in batches:
            texts, held, first = [], 0, 0
            for text in batch.column("text"):
                text = text.as_py() or ""
                if texts and held + len(text) > BLOCK_CHARS:
                    yield out(batch, first, bpe.encode(texts))
                    first, held, texts = first + len(texts), 0, []
                texts.append(text)
                held += len(text)
            if texts:
                yield out(batch, first, bpe.encode(texts))

    return encode


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``(doc_id, ids array<int>)`` of every row's whole ``text``, without special tokens.

    A null text counts as empty and gives no ids; bytes that are no UTF-8 count as U+FFFD; characters outside every
    match of the pattern give no ids. Repeated rows and null ids give rows of their own, an empty table an empty
    result; other columns are not read. Ranks that lack a single byte raise ``KeyError``. ``ranks_path`` must be
    readable by that path wherever Python workers run.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return valid_texts(docs).mapInArrow(encoding(ranks_path, pattern), f"doc_id {kind}, ids array<int>")


def valid_texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.make_valid_utf8("text").alias("text"))


def token_table(ranks: dict[bytes, int]) -> pa.LargeBinaryArray:
    """Token bytes at the place of their id; an id that no token has is null."""
    tokens: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return pa.array(tokens, pa.large_binary())


def joined(pieces: pa.LargeBinaryArray, ids: pa.ListArray) -> pa.LargeBinaryArray:
    """Each row's pieces end to end: those taken in order already lie so, hence rows are cuts of one buffer."""
    taken = pieces.take(ids.flatten())
    if taken.null_count:
        raise ValueError("an id that the ranks do not name")
    starts = np.frombuffer(taken.buffers()[1], dtype="<i8", count=len(taken) + 1) if len(taken) else np.zeros(1, "<i8")
    cuts = np.cumsum([0, *ids.value_lengths().fill_null(0).to_pylist()])
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(ids), [None, pa.py_buffer(starts[cuts].tobytes()), taken.buffers()[2] or pa.py_buffer(b"")]
    )


def decoding(ranks_path: str) -> Callable[[Batches], Batches]:
    """What a worker does to decode: batches with ``ids`` get their bytes as ``decoded``."""

    def decode(batches: Batches) -> Batches:
        tokens = token_table(read_ranks(ranks_path))
        for batch in batches:
            yield batch.append_column("decoded", joined(tokens, batch.column("ids")).cast(pa.binary()))

    return decode


def decode_ids(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """The same rows with the bytes of their ``ids`` as ``decoded`` (a column of that name is replaced).

    Null or empty ids give empty bytes; an id that the ranks do not name raises ``ValueError``; all other columns stay.
    """
    small_batches(encoded.sparkSession)
    kept = [c for c in encoded.columns if c.lower() != "decoded"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*kept).schema)
    return encoded.select(*kept).mapInArrow(decoding(ranks_path), f"{schema}, decoded binary")


def round_trip_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of rows encoded and decoded again, as ``encode_texts`` and
    ``decode_ids`` do it, with ids and bytes digested where they are made. The first digest is that of the decimal ids
    joined by one space."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    encode, decode = encoding(ranks_path, pattern), decoding(ranks_path)

    def digest(batches: Batches) -> Batches:
        most = max(read_ranks(ranks_path).values(), default=-1)
        decimals = pa.array([b"%d " % i for i in range(most + 1)], pa.large_binary())

        def hexes(rows: pa.Array, cut: int) -> pa.Array:
            views = (row.as_buffer() for row in rows)
            return pa.array([hashlib.sha256(memoryview(v)[: max(0, len(v) - cut)]).hexdigest() for v in views], pa.string())

        for batch in decode(encode(batches)):
            ids = batch.column("ids")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), ids.value_lengths().cast(pa.int64()), hexes(joined(decimals, ids), 1), hexes(batch.column("decoded"), 0)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return valid_texts(docs).mapInArrow(digest, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
