"""Benchmark decontamination by a distributed positional inverted index.

``build`` turns the training texts into index segments: bounded runs of documents with, for
each term, the sorted positions at which it stands. Segments are split by document, so building
shuffles nothing and a segment answers for its documents alone. ``search`` takes the test items
in blocks of bounded size to every segment. For each phrase the posting lists are taken rarest
first, by their length in the segment: the positions of the rarest term give the candidate
starts, each further list, shifted by its offset in the phrase, strikes out those it lacks.

Words are those of ``words``; terms are their 64-bit hashes. Null and empty texts have no
words; rows stand for themselves, so repeated rows give repeated results.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from parchmill.llm import words as W

WINDOW = 13
SEGMENT_WORDS = 1 << 18
BLOCK_CHARS = 4_000_000  # of item texts searched for at once
PAIRS_AT_ONCE = 1 << 20  # candidate starts checked at once


# --- building ---------------------------------------------------------------------------


def _index_schema(id_type: T.DataType) -> T.StructType:
    return (
        T.StructType()
        .add("segment", T.StringType())
        .add("ids", T.ArrayType(id_type))
        .add("n_words", T.ArrayType(T.IntegerType()))
        .add("terms", T.BinaryType())
        .add("counts", T.BinaryType())
        .add("positions", T.BinaryType())
    )


def _segment(ids: list, hashes: list[np.ndarray]) -> dict:
    words = np.concatenate(hashes)
    order = np.argsort(words, kind="stable")
    ranked = words[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else order
    counts = np.diff(first, append=len(ranked))
    gaps = np.diff(order, prepend=0)
    gaps[first] = order[first]  # each list starts anew
    return {
        "segment": uuid.uuid4().hex,
        "ids": ids,
        "n_words": [len(x) for x in hashes],
        "terms": ranked[first].tobytes(),
        "counts": zlib.compress(counts.astype("<i4").tobytes(), 1),
        "positions": zlib.compress(np.ascontiguousarray(gaps.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1),
    }


def build(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Index segments of ``docs``; write them before searching, as segments are named at random."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    schema = _index_schema(rows.schema["id"].dataType)
    arrow = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes, n = [], [], 0
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), W.text_buffers(batch.column(1)), strict=True):
                ids.append(key)
                hashes.append(W.words_of(data)[0])
                n += len(hashes[-1])
                if n >= SEGMENT_WORDS or len(ids) >= SEGMENT_WORDS:
                    yield pa.RecordBatch.from_pylist([_segment(ids, hashes)], schema=arrow)
                    ids, hashes, n = [], [], 0
        if ids:
            yield pa.RecordBatch.from_pylist([_segment(ids, hashes)], schema=arrow)

    return rows.mapInArrow(run, schema)


@dataclass
class Segment:
    """A decoded segment. ``keys`` has term index and position in one sorted number."""

    terms: np.ndarray
    counts: np.ndarray
    first: np.ndarray
    positions: np.ndarray
    keys: np.ndarray
    doc_start: np.ndarray

    @classmethod
    def read(cls, terms: bytes, counts: bytes, positions: bytes, n_words: list[int]) -> Segment:
        n = np.frombuffer(zlib.decompress(counts), dtype="<i4").astype(np.int64)
        planes = np.frombuffer(zlib.decompress(positions), dtype=np.uint8)
        gaps = np.ascontiguousarray(planes.reshape(4, -1).T).view("<i4").ravel().astype(np.int64)
        first = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64) if len(n) else n
        # One running sum over all lists: each list starts at its own first position.
        ends = np.cumsum(gaps)
        before = ends[first] - gaps[first]
        at = ends - np.repeat(before, n)
        owner = np.repeat(np.arange(len(n)), n)
        starts = np.concatenate([[0], np.cumsum(n_words)]).astype(np.int64)
        return cls(np.frombuffer(terms, dtype=np.uint64), n, first, at, owner << 32 | at, starts)

    def lookup(self, wanted: np.ndarray) -> np.ndarray:
        """Index of each wanted term, -1 if the segment lacks it."""
        if not len(self.terms):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(self.terms, wanted), len(self.terms) - 1)
        return np.where(self.terms[at] == wanted, at, -1)

    def holds(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        wanted = term << 32 | position
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return self.keys[at] == wanted

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.doc_start, position, side="right") - 1


# --- phrases ----------------------------------------------------------------------------


@dataclass
class Phrases:
    """Phrases of test items: term numbers by place, -1 behind the last, the item's number and the items' names."""

    vocabulary: np.ndarray
    terms: np.ndarray
    lengths: np.ndarray
    items: np.ndarray
    names: np.ndarray

    @classmethod
    def of(cls, names: list[str], texts: list[str], window: int) -> Phrases:
        """All ``window``-word windows of each text; one window for fewer words, none for no word."""
        rows, items = [], []
        for number, hashes in enumerate(W.words_of(x)[0] for x in W.text_buffers(pa.array(texts, type=pa.string()))):
            for start in range(max(1, len(hashes) - window + 1) if len(hashes) else 0):
                rows.append(hashes[start : start + window])
                items.append(number)
        lengths = np.array([len(row) for row in rows], dtype=np.int64)
        vocabulary, numbers = np.unique(np.concatenate(rows) if rows else np.zeros(0, np.uint64), return_inverse=True)
        terms = np.full((len(rows), window), -1, dtype=np.int64)
        terms[np.arange(window) < lengths[:, None]] = numbers
        return cls(vocabulary, terms, lengths, np.array(items, dtype=np.int64), np.array(names, dtype=object))


def _candidates(segment: Segment, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Phrases all of whose terms are in the segment: their numbers, terms there, places rarest first, rarest counts."""
    known = segment.lookup(phrases.vocabulary)
    counts = np.where(known >= 0, segment.counts[known] if len(segment.counts) else 0, 0)
    used = phrases.terms >= 0
    lists = np.where(used, counts[phrases.terms] if len(counts) else 0, np.iinfo(np.int64).max)
    chosen = np.flatnonzero(lists.min(axis=1, initial=np.iinfo(np.int64).max) > 0) if len(lists) else np.zeros(0, np.int64)
    lists = lists[chosen]
    order = np.argsort(lists, axis=1, kind="stable")
    return chosen, known[phrases.terms[chosen]], order, np.take_along_axis(lists, order[:, :1], axis=1).ravel()


def _blocks(sizes: np.ndarray) -> Iterator[slice]:
    group = np.cumsum(sizes) // PAIRS_AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield slice(a, b)


def _list_places(segment: Segment, term: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and positions: the posting lists of ``term`` one after the other."""
    row = np.repeat(np.arange(len(term)), size)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    return row, segment.positions[segment.first[term][row] + inner]


def exact(segment: Segment, phrases: Phrases, slack: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every occurrence of a phrase: its number, first position and the position behind its last."""
    found = []
    chosen, terms, order, sizes = _candidates(segment, phrases)
    for part in _blocks(sizes):
        rank0 = order[part, 0]
        row, position = _list_places(segment, terms[part][np.arange(len(rank0)), rank0], sizes[part])
        start = position - rank0[row]
        lengths = phrases.lengths[chosen[part]]
        keep = start >= 0
        row, start = row[keep], start[keep]
        for step in range(1, order.shape[1]):
            place = order[part, step][row]
            used = step < lengths[row]
            fits = ~used
            fits[used] = segment.holds(terms[part][row[used], place[used]], start[used] + place[used])
            row, start = row[fits], start[fits]
        end = start + lengths[row]
        same = segment.doc_of(start) == segment.doc_of(end - 1)
        found.append((chosen[part][row[same]], start[same], end[same]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def near(segment: Segment, phrases: Phrases, slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shortest stretches of one document with all terms of a phrase, in any order, that have at
    most ``slack`` words more than the phrase. A term counts as often as the phrase has it."""
    found = []
    chosen, terms, order, sizes = _candidates(segment, phrases)
    for number, own, rank, size in zip(chosen, terms, order, sizes, strict=True):
        length = int(phrases.lengths[number])
        need = dict(zip(*(x.tolist() for x in np.unique(own[:length], return_counts=True)), strict=True))
        _, rare = _list_places(segment, own[rank[:1]], np.array([size]))
        most, places = length + slack, []
        for term in need:
            first = segment.first[term]
            at = segment.positions[first : first + segment.counts[term]]
            # Only what lies within reach of the rarest term.
            i = np.searchsorted(rare, at)
            gap = np.minimum(
                np.abs(at - rare[np.minimum(i, len(rare) - 1)]), np.abs(at - rare[np.maximum(i - 1, 0)])
            )
            places += [(int(p), term) for p in at[gap < most]]
        places.sort()
        have, missing, low = dict.fromkeys(need, 0), len(need), 0
        for position, term in places:
            have[term] += 1
            missing -= have[term] == need[term]
            while missing == 0:
                start, gone = places[low]
                if have[gone] == need[gone]:
                    ends = np.array([start, position])
                    if position + 1 - start <= most and len(set(segment.doc_of(ends).tolist())) == 1:
                        found.append((number, start, position + 1))
                    missing += 1
                have[gone] -= 1
                low += 1
    return tuple(np.array(x, dtype=np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


# --- search -----------------------------------------------------------------------------


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[list[int], list[int]]:
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    opens = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
    closes = np.concatenate([opens[1:] - 1, [len(start) - 1]])
    return start[opens].tolist(), reach[closes].tolist()


def _hits_schema(id_type: T.DataType) -> T.StructType:
    span = T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType())
    return (
        T.StructType()
        .add("segment", T.StringType())
        .add("doc", T.IntegerType())
        .add("id", id_type)
        .add("n_words", T.IntegerType())
        .add("spans", T.ArrayType(span))
        .add("items", T.ArrayType(T.StringType()))
    )


def _search_block(index: DataFrame, phrases: Phrases, match: Callable, slack: int) -> DataFrame:
    schema = _hits_schema(index.schema["ids"].dataType.elementType)
    arrow = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in schema])
    shared = index.sparkSession.sparkContext.broadcast(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
                segment = Segment.read(row["terms"], row["counts"], row["positions"], row["n_words"])
                number, start, end = match(segment, shared.value, slack)
                doc = segment.doc_of(start)
                order = np.argsort(doc, kind="stable")
                number, start, end, doc = number[order], start[order], end[order], doc[order]
                cuts = np.searchsorted(doc, np.arange(len(row["ids"]) + 1))
                spans, items = [], []
                for d, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                    if a == b:
                        spans.append([])
                        items.append([])
                        continue
                    offset = int(segment.doc_start[d])
                    merged = zip(*_merged(start[a:b] - offset, end[a:b] - offset), strict=True)
                    spans.append([{"start": x, "end": y} for x, y in merged])
                    found = np.unique(shared.value.items[number[a:b]])
                    items.append(sorted(set(shared.value.names[found])))
                columns = [
                    [row["segment"]] * len(row["ids"]),
                    range(len(row["ids"])),
                    row["ids"],
                    row["n_words"],
                    spans,
                    items,
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, type=f.type) for x, f in zip(columns, arrow, strict=True)], schema=arrow
                )

    return index.mapInArrow(run, schema)


def item_blocks(items: DataFrame, item_id: str, text: str, block_chars: int) -> Iterator[list]:
    """Items in blocks of at most about ``block_chars`` characters, each small enough for every task."""
    rows = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // block_chars)
    bucket = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, n)))
    for i in range(n):
        yield (rows if n == 1 else rows.where(bucket == i)).collect()


def search(
    index: DataFrame,
    items: DataFrame,
    item_id: str = "item_id",
    text: str = "text",
    window: int = WINDOW,
    slack: int | None = None,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """What of the items every indexed document holds: (id, n_words, spans, items), a row per document.

    ``spans``: merged word ranges covered by occurring windows, ``items``: ids of items of which
    a window occurs, as strings (null: empty), each once. With ``slack``, a window occurs where
    all its words stand in any order within that many words more (proximity); else as a phrase.
    """
    match, reach = (exact, 0) if slack is None else (near, slack)
    parts = []
    for block in item_blocks(items, item_id, text, block_chars):
        names = ["" if row.item_id is None else str(row.item_id) for row in block]
        parts.append(_search_block(index, Phrases.of(names, [row.text for row in block], window), match, reach))
    if not parts:
        parts.append(_search_block(index, Phrases.of([], [], window), match, reach))
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    if len(parts) > 1:
        hits = hits.groupBy("segment", "doc").agg(
            F.first("id").alias("id"),
            F.first("n_words").alias("n_words"),
            F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
            F.flatten(F.collect_list("items")).alias("items"),
        )
    return hits.select("id", "n_words", "spans", F.array_sort(F.array_distinct("items")).alias("items"))


def covered(spans: str) -> F.Column:
    """Words in the union of sorted word ranges."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))

    def add(state: F.Column, span: F.Column) -> F.Column:
        more = F.greatest(F.lit(0), span["end"] - F.greatest(span["start"], state["reach"]))
        return F.struct((state["n"] + more).alias("n"), F.greatest(state["reach"], span["end"]).alias("reach"))

    return F.aggregate(spans, zero, add, lambda state: state["n"])


def contamination(hits: DataFrame) -> DataFrame:
    """Per document: how many words are hit, by which items, and whether that is a twentieth or more."""
    n_hit = covered("spans").cast("long")
    return hits.select(
        F.col("id"),
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )
