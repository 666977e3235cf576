"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The pairs of a pre-token wait in one bucket per merge rank. A bitmap marks the buckets that
hold something, a smaller bitmap the words of the first that are not zero, and so on up to one
word: the lowest rank is found by a few find-first-set steps, whatever the length. Buckets hold
positions of a linked list of parts; entries whose pair has changed since are skipped. A
pre-token of n bytes costs O(n log n) at worst, so one of a million bytes is no problem.

Null text is encoded as the empty text: no ids, decoded to no bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BITS = 64
CACHED = 300_000  # encoded pre-tokens kept by a task; only speed depends on it
TOGETHER = 128  # bytes; a longer pre-token gets a queue run of its own and is not kept
CHARS_AT_ONCE = 6_000_000  # texts encoded together, one at least: fewer cost less memory and more time


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 token and rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class RankQueue:
    """Positions by rank; gives the lowest rank first and the lowest position within it."""

    def __init__(self, n_ranks: int) -> None:
        self.buckets: list[list[int] | None] = [None] * n_ranks
        self.levels: list[list[int]] = []
        width = n_ranks
        while not self.levels or width > 1:
            width = -(-width // BITS)
            self.levels.append([0] * max(1, width))

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets[rank]
        if bucket:
            heappush(bucket, position)
            return
        if bucket is None:
            self.buckets[rank] = [position]
        else:
            bucket.append(position)
        for level in self.levels:
            word, bit = divmod(rank, BITS)
            before = level[word]
            level[word] = before | 1 << bit
            if before:
                return
            rank = word

    def pop(self) -> tuple[int, int] | None:
        levels = self.levels
        if not levels[-1][0]:
            return None
        rank = 0
        for level in reversed(levels):
            marks = level[rank]
            rank = rank * BITS + (marks & -marks).bit_length() - 1
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            at = rank
            for level in levels:
                word, bit = divmod(at, BITS)
                level[word] &= ~(1 << bit)
                if level[word]:
                    break
                at = word
        return rank, position


class BatchQueue:
    """As ``RankQueue`` over arrays of positions: a bucket is a list of arrays, a pop empties it."""

    def __init__(self, n_ranks: int) -> None:
        self.marks = RankQueue(n_ranks)
        self.buckets: dict[int, list[np.ndarray]] = {}

    def put(self, rank: int, places: np.ndarray) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [places]
            self.marks.push(rank, 0)
        else:
            bucket.append(places)

    def push(self, ranks: np.ndarray, places: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        cuts = np.flatnonzero(np.diff(ranks, prepend=-1))
        bounds = [*cuts.tolist(), len(ranks)]
        for rank, a, b in zip(ranks[cuts].tolist(), bounds, bounds[1:], strict=False):
            self.put(rank, places[a:b])

    def pop(self) -> tuple[int, np.ndarray] | None:
        least = self.marks.pop()
        if least is None:
            return None
        return least[0], np.concatenate(self.buckets.pop(least[0]))


class Codec:
    """Encodes and decodes with the ranks of a vocabulary, without special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        self.tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.cache: dict[str, bytes] = {}
        self.byte_ids = np.array([ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int32)
        pairs = {
            ranks[token[:cut]] << 32 | ranks[token[cut:]]: rank
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if token[:cut] in ranks and token[cut:] in ranks
        }
        self.pair_keys = np.array(sorted(pairs) or [-1], dtype=np.int64)
        self.pair_values = np.array([pairs.get(key, -1) for key in self.pair_keys.tolist()], dtype=np.int32)

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks, queue = self.ranks, self.queue
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        # Part i covers piece[i:after[i]]; waiting[i] is the rank of the pair that starts there.
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [-1] * n
        for i in range(n - 1):
            rank = ranks.get(piece[i : i + 2])
            if rank is not None:
                waiting[i] = rank
                queue.push(rank, i)
        while (least := queue.pop()) is not None:
            rank, i = least
            if waiting[i] != rank:
                continue
            gone = after[i]
            end = after[i] = after[gone]
            waiting[gone] = waiting[i] = -1
            if end < n:
                before[end] = i
                rank = ranks.get(piece[i : after[end]])
                if rank is not None:
                    waiting[i] = rank
                    queue.push(rank, i)
            left = before[i]
            if left >= 0:
                rank = ranks.get(piece[left:end])
                if rank is None:
                    waiting[left] = -1
                elif rank != waiting[left]:
                    waiting[left] = rank
                    queue.push(rank, left)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of many pre-tokens, with one queue over all of them.

        The parts of all pre-tokens are one linked list with walls. A popped rank is merged in
        every pre-token that waits for it at once, at its leftmost place; the other places go
        back. Each pre-token thus sees its own pairs in order of rank and place.
        """
        long = [i for i, piece in enumerate(pieces) if len(piece) > TOGETHER]
        out: dict[int, bytes] = {i: np.array(self.encode_piece(pieces[i]), dtype="<u4").tobytes() for i in long}
        short = [i for i, piece in enumerate(pieces) if len(piece) <= TOGETHER]
        whole = [(i, self.ranks.get(pieces[i])) for i in short]
        out |= {i: rank.to_bytes(4, "little") for i, rank in whole if rank is not None}
        left = [i for i, rank in whole if rank is None]
        out |= dict(zip(left, self._merge([pieces[i] for i in left]), strict=True))
        return [out[i] for i in range(len(pieces))]

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each joined pair of token ids, -1 if it is no token."""
        keys = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == keys, self.pair_values[at], -1)

    def _merge(self, pieces: list[bytes]) -> list[bytes]:
        lengths = np.fromiter(map(len, pieces), dtype=np.int32, count=len(pieces))
        n = int(lengths.sum())
        if n == 0:
            return [b""] * len(pieces)
        token = self.byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
        after = np.arange(1, n + 1, dtype=np.int32)
        before = np.arange(-1, n - 1, dtype=np.int32)
        starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        ends = starts[1:][owner]
        waiting = np.full(n, -1, dtype=np.int32)
        pairs = np.flatnonzero(after < ends)
        waiting[pairs] = self._pair_ranks(token[pairs], token[pairs + 1])
        queue = BatchQueue(len(self.tokens))
        pairs = pairs[waiting[pairs] >= 0]
        queue.push(waiting[pairs], pairs)
        while (least := queue.pop()) is not None:
            rank, places = least
            places = np.unique(places[waiting[places] == rank])
            if not len(places):
                continue
            first = np.ones(len(places), dtype=bool)
            first[1:] = owner[places[1:]] != owner[places[:-1]]
            if not first.all():
                queue.put(rank, places[~first])
            at = places[first]
            gone = after[at]
            end = after[gone]
            token[at] = rank
            token[gone] = -1
            after[at] = end
            waiting[gone] = waiting[at] = -1
            inner = end < ends[at]
            before[end[inner]] = at[inner]
            with_right = at[inner]
            previous = before[at]
            has_left = previous >= starts[owner[at]]
            lefts = np.concatenate([with_right, previous[has_left]])
            rights = np.concatenate([end[inner], at[has_left]])
            ranks = self._pair_ranks(token[lefts], token[rights])
            fresh = (ranks >= 0) & (ranks != waiting[lefts])
            waiting[lefts] = ranks
            queue.push(ranks[fresh], lefts[fresh])
        kept = token >= 0
        packed = token[kept].astype("<u4").tobytes()
        counts = np.concatenate([[0], np.cumsum(np.bincount(owner[kept], minlength=len(pieces)))]) * 4
        bounds = counts.tolist()
        return [packed[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.cache) > CACHED:
            self.cache.clear()
        split = [self.split(text) if text else [] for text in texts]
        new = [*set(chain.from_iterable(split)).difference(self.cache)]
        made = dict(zip(new, self.encode_pieces([piece.encode() for piece in new]), strict=True))
        self.cache.update((piece, ids) for piece, ids in made.items() if len(piece) <= TOGETHER)
        known = _Either(made, self.cache)
        return [b"".join(map(known.__getitem__, pieces)) for pieces in split]

    def decode(self, ids: bytes) -> bytes:
        """The bytes that packed ids stand for."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


class _Either(dict):
    """The new pre-tokens of a chunk, then those of the cache."""

    def __init__(self, new: dict[str, bytes], cache: dict[str, bytes]) -> None:
        super().__init__(new)
        self.cache = cache

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = self.cache[piece]
        return ids


def chunks(batch: pa.RecordBatch, name: str, at_once: int = CHARS_AT_ONCE) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Rows of a batch whose texts have about ``at_once`` bytes together, with those values."""
    column = batch.column(batch.schema.get_field_index(name))
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // at_once
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a), column.slice(a, b - a).to_pylist()


def _mapped(df: DataFrame, ranks: dict[bytes, int], pattern: str, fields: list, per_chunk) -> DataFrame:
    """Append ``fields`` to ``df``: ``per_chunk(codec, batch)`` gives the batches with their values."""
    taken = {name.lower() for name in df.columns} & {name.lower() for name, _, _ in fields}
    if taken:
        raise ValueError(f"the input has columns of these names: {sorted(taken)}")
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value, pattern)
        for batch in batches:
            for part, made in per_chunk(codec, batch):
                arrays = [pa.array(got, type=kind) for got, (_, kind, _) in zip(made, fields, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], [*part.schema.names, *(f[0] for f in fields)])

    schema = T.StructType([*df.schema.fields, *(T.StructField(name, kind) for name, _, kind in fields)])
    return df.mapInArrow(run, schema)


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Append the token ids of ``text`` (array of long; empty for null)."""

    def run(codec: Codec, batch: pa.RecordBatch) -> Iterator:
        for part, values in chunks(batch, text):
            yield part, [[np.frombuffer(made, dtype="<u4").tolist() for made in codec.encode(values)]]

    return _mapped(df, ranks, pattern, [(ids, pa.list_(pa.int64()), T.ArrayType(T.LongType()))], run)


def decode(df: DataFrame, ranks: dict[bytes, int], pattern: str, ids: str = "ids", data: str = "data") -> DataFrame:
    """Append the bytes that ``ids`` stand for (binary; empty for null). Cut texts need not be UTF-8."""

    def run(codec: Codec, batch: pa.RecordBatch) -> Iterator:
        for i in range(batch.num_rows):
            part = batch.slice(i, 1)
            value = part.column(part.schema.get_field_index(ids))[0].as_py()
            yield part, [[codec.decode(np.array(value or [], dtype="<u4").tobytes())]]

    return _mapped(df, ranks, pattern, [(data, pa.binary(), T.BinaryType())], run)


def round_trip(
    df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", at_once: int = CHARS_AT_ONCE
) -> DataFrame:
    """Append n_tokens, ids_sha256 and decoded_sha256: encode ``text``, then decode the ids.

    One pass, so ids of a whole corpus never leave the tasks. Rows are independent: repeated
    rows give repeated results, an empty or null text has no tokens.
    """
    fields = [
        ("n_tokens", pa.int64(), T.LongType()),
        ("ids_sha256", pa.string(), T.StringType()),
        ("decoded_sha256", pa.string(), T.StringType()),
    ]

    def run(codec: Codec, batch: pa.RecordBatch) -> Iterator:
        for part, values in chunks(batch, text, at_once):
            made = codec.encode(values)
            yield part, [
                [len(ids) // 4 for ids in made],
                [hashlib.sha256(ids).hexdigest() for ids in made],
                [hashlib.sha256(codec.decode(ids)).hexdigest() for ids in made],
            ]

    return _mapped(df, ranks, pattern, fields, run)
