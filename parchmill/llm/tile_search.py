"""Ranked lexical search: tiles of items times tiles of documents, multiplied as dense float64 matrices.

The score of a document for an item is the sum, over the item's distinct terms, of the term's weight times its
impact in the document, both whole numbers. So scores of many documents for many items are a matrix
product: impacts (documents x terms) times weights (terms x items). Only terms of the items get a
column, and every tile of items has columns of its own, in tiles of at most ``TERMS`` of them. Within a tile all partial
sums stay below 2^53, where float64 is exact whatever the order of the additions; tiles add up in 64-bit integers.

Two passes over the documents, neither of which moves a text: one counts documents, terms and the document
frequency of the items' terms, the other multiplies. Each task keeps the best ``k`` documents of
each item, equal scores by smaller doc_id, and only these are shuffled, merged in two steps so that no task
gets the candidates of all tasks.

Items are a query set: they are taken in groups of about ``GROUP_ITEMS`` items or ``GROUP_TERMS`` terms, each
of which goes to the tasks as one broadcast and reads the documents anew.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchmill.llm.words import text_buffers, words_of
from parchmill.session import cut_lineage

GROUP_ITEMS, GROUP_TERMS = 1024, 50_000  # a group's dense weights take 100 MB at most
ITEMS, TERMS = 256, 4096  # sides of a weight tile: 8 MB
DOCS, BYTES = 256, 1 << 20  # documents and bytes of text in a tile; a longer text is a tile of its own
HELD = 1 << 18  # candidates a task holds before it cuts them to the best
SALTS = 64  # partial merges of an item's candidates
EXACT = 1 << 53

_IMPACT = 1_000_000_000
_SEPARATOR = np.array([32], dtype=np.uint8)
_FOUND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
_COUNTED = "term bigint, n bigint, terms bigint"


def weight(n_documents: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * n_documents + 2) / (2 * frequency + 1)))


@dataclass(frozen=True)
class Lookup:
    """Finds the column of a term's hash."""

    hashes: np.ndarray
    likely: np.ndarray

    @staticmethod
    def of(hashes: np.ndarray) -> Lookup:
        likely = np.zeros(1 << 20, dtype=bool)
        likely[hashes >> np.uint64(44)] = True
        return Lookup(hashes, likely)

    def __call__(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``words`` of known terms, and their columns."""
        at = np.flatnonzero(self.likely[words >> np.uint64(44)])
        column = np.searchsorted(self.hashes, words[at])
        column[column == len(self.hashes)] = 0
        known = self.hashes[column] == words[at]
        return at[known], column[known]


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, terms): the hashes of each item's distinct terms. Rows of one id, null too, are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(words_of(data)[0]).view(np.int64) for data in text_buffers(batch.column(1))]
            terms = pa.array([x.tolist() for x in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), terms], names=["item_id", "terms"])

    rows = items.select(F.col(item_id).alias("item_id"), text)
    schema = T.StructType([rows.schema[0], T.StructField("terms", T.ArrayType(T.LongType()))])
    found = rows.mapInArrow(run, schema).filter(F.size("terms") > 0)
    return found.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))


@dataclass(frozen=True)
class Tile:
    """Documents with the number of their terms, and (document, column, occurrences) of known terms."""

    ids: pa.Array
    n_terms: np.ndarray
    document: np.ndarray
    column: np.ndarray
    often: np.ndarray


def _tiles(batch: pa.RecordBatch, lookup: Lookup) -> Iterator[Tile]:
    ids, held, size, first = batch.column(0), [], 0, 0
    texts = list(text_buffers(batch.column(1)))
    for at, data in enumerate(texts):
        if held and (len(held) == DOCS or size + len(data) > BYTES):
            yield _tile(ids.slice(first, len(held)), held, lookup)
            held, size, first = [], 0, at
        held.append(data)
        size += len(data)
    if held:
        yield _tile(ids.slice(first, len(held)), held, lookup)


def _tile(ids: pa.Array, texts: list[np.ndarray], lookup: Lookup) -> Tile:
    data = np.concatenate([x for text in texts for x in (text, _SEPARATOR)])
    ends = np.cumsum([len(text) + 1 for text in texts])
    words, starts, _ = words_of(data)
    document = np.searchsorted(ends, starts, side="right")
    places, column = lookup(words)
    width = len(lookup.hashes)
    cells, often = np.unique(document[places] * width + column, return_counts=True)
    return Tile(ids, np.bincount(document, minlength=len(texts)), cells // width, cells % width, often)


def _count(hashes: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup.of(hashes)
        documents, terms, frequency = 0, 0, np.zeros(len(hashes), dtype=np.int64)
        for batch in batches:
            for tile in _tiles(batch, lookup):
                documents += int(np.count_nonzero(tile.n_terms))
                terms += int(tile.n_terms.sum())
                frequency += np.bincount(tile.column, minlength=len(hashes))
        met = np.flatnonzero(frequency)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([None, *hashes[met].view(np.int64).tolist()], pa.int64()),
                pa.array([documents, *frequency[met].tolist()], pa.int64()),
                pa.array([terms, *[0] * len(met)], pa.int64()),
            ],
            names=["term", "n", "terms"],
        )

    return run


@dataclass(frozen=True)
class Weights:
    """A tile of items: the columns they use, and the weights (column, item) as triples."""

    first: int
    n_items: int
    columns: np.ndarray
    place: np.ndarray
    item: np.ndarray
    weight: np.ndarray

    def dense(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(columns, matrix) per tile of terms, every column sum times the largest impact below 2^53."""
        most = int(self.weight.max(initial=1))
        step = min(TERMS, (EXACT - 1) // (max(most, 1) * (_IMPACT // 1000)))
        out = []
        for lo in range(0, len(self.columns), step):
            inside = (self.place >= lo) & (self.place < lo + step)
            matrix = np.zeros((min(step, len(self.columns) - lo), self.n_items))
            matrix[self.place[inside] - lo, self.item[inside]] = self.weight[inside]
            out.append((self.columns[lo : lo + step], matrix))
        return out


def _weight_tiles(terms: list[np.ndarray], weights: np.ndarray) -> list[Weights]:
    """``terms``: the columns of each item; ``weights``: of each column."""
    out = []
    for first in range(0, len(terms), ITEMS):
        some = terms[first : first + ITEMS]
        column = np.concatenate(some)
        item = np.repeat(np.arange(len(some)), [len(x) for x in some])
        columns, place = np.unique(column, return_inverse=True)
        out.append(Weights(first, len(some), columns, place, item, weights[column]))
    return out


class Best:
    """The best ``k`` documents of each item so far: higher score, then smaller doc_id, null last."""

    def __init__(self, n_items: int, k: int):
        self.k, self.floor = k, np.ones(n_items, dtype=np.int64)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held, self.kept = 0, 0

    def add(self, first: int, scores: np.ndarray, doc: np.ndarray, absent: np.ndarray) -> None:
        # Not below the floor: a document as good as the k-th may still have the smaller doc_id.
        row, item = np.nonzero(scores >= self.floor[first : first + scores.shape[1]])
        self.parts.append((item + first, scores[row, item], absent[row], doc[row]))
        self.held += len(row)
        if self.held > HELD + 2 * self.kept:
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, bool, np.int64))
        item, score, absent, doc = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((doc, absent, -score, item))
        item, score, absent, doc = item[order], score[order], absent[order], doc[order]
        start = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]])) if len(item) else np.zeros(0, np.int64)
        rank = np.arange(len(item)) - np.repeat(start, np.diff(np.append(start, len(item))))
        last = rank == self.k - 1
        self.floor[item[last]] = score[last]
        top = rank < self.k
        self.parts = [(item[top], score[top], absent[top], doc[top])]
        self.held = self.kept = int(top.sum())
        return self.parts[0]


def _search(
    hashes: np.ndarray, tiles: list[Weights], items: pa.Array, documents: int, terms: int, k: int
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, best = Lookup.of(hashes), Best(len(items), k)
        dense = [(tile, tile.dense()) for tile in tiles]
        for batch in batches:
            for tile in _tiles(batch, lookup):
                # Exact at any size: Python's integers.
                length = np.array([10 + 90 * n * documents // terms if terms else 10 for n in tile.n_terms.tolist()])
                impact = _IMPACT * tile.often // (1000 * tile.often + 8 * length[tile.document])
                doc = tile.ids.fill_null(0).to_numpy(zero_copy_only=False)
                absent = np.asarray(tile.ids.is_null())
                for weights, parts in dense:
                    scores = np.zeros((len(doc), weights.n_items), dtype=np.int64)
                    for columns, matrix in parts:
                        place = np.searchsorted(columns, tile.column)
                        place[place == len(columns)] = 0
                        here = columns[place] == tile.column
                        impacts = np.zeros((len(doc), len(columns)))
                        impacts[tile.document[here], place[here]] = impact[here]
                        scores += (impacts @ matrix).astype(np.int64)
                    best.add(weights.first, scores, doc, absent)
        item, score, absent, doc = best.cut()
        for lo in range(0, len(item), 1 << 16):
            part = slice(lo, lo + (1 << 16))
            yield pa.RecordBatch.from_arrays(
                [
                    items.take(pa.array(item[part])),
                    pa.array(doc[part], pa.int64(), mask=absent[part]),
                    pa.array(score[part], pa.int64()),
                ],
                names=["item_id", "doc_id", "score"],
            )

    return run


def search(
    documents: DataFrame,
    items: DataFrame,
    k: int = 10,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    group_items: int = GROUP_ITEMS,
    group_terms: int = GROUP_TERMS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item with a score above 0.

    Equal scores go by ascending doc_id, null last; rows of equal id and score take a rank each. Terms are runs of
    letters, digits and non-ASCII characters, A-Z lower-cased, told apart by 64-bit hashes. A null or
    empty text has no terms: such a document is not counted, such an item has no rows. Items of one id are one item with
    the terms of all its rows. No documents or no items: no rows. Other columns are not read.
    """
    corpus = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("_text"))
    asked = cut_lineage(item_terms(items, item_id, item_text))
    totals = asked.agg(F.count(F.lit(1)).alias("items"), F.sum(F.size("terms")).alias("terms")).first()
    n_groups = max(1, -(-totals["items"] // group_items), -(-(totals["terms"] or 0) // group_terms))
    schema = T.StructType([asked.schema["item_id"], *_FOUND.fields])
    found = []
    for group in range(n_groups if totals["items"] else 0):
        rows = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_groups)) == group).toArrow()
        if rows.num_rows:
            best = corpus.mapInArrow(_group(corpus, rows, k), schema)
            found.append(cut_lineage(best) if n_groups > 1 else best)
    if not found:
        found = [corpus.sparkSession.createDataFrame([], schema)]
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    salted = best.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    partial = Window.partitionBy("item_id", "_salt").orderBy(*order)
    final = Window.partitionBy("item_id").orderBy(*order)
    merged = salted.withColumn("rank", F.row_number().over(partial)).filter(F.col("rank") <= k)
    ranked = merged.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def _group(corpus: DataFrame, rows: pa.Table, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Count the terms of a group of items, and make the function that searches for them."""
    items = rows.column("item_id").combine_chunks()
    terms = [np.array(x, dtype=np.int64).view(np.uint64) for x in rows.column("terms").to_pylist()]
    hashes = np.unique(np.concatenate(terms))
    counted = corpus.mapInArrow(_count(hashes), _COUNTED).groupBy("term").agg(F.sum("n"), F.sum("terms")).collect()
    n_documents, n_terms, frequency = 0, 0, np.zeros(len(hashes), dtype=np.int64)
    for term, n, n_all in counted:
        if term is None:
            n_documents, n_terms = n, n_all
        else:
            frequency[np.searchsorted(hashes, np.uint64(term % (1 << 64)))] = n
    weights = np.array([weight(n_documents, f) for f in frequency.tolist()], dtype=np.int64)
    tiles = _weight_tiles([np.searchsorted(hashes, x) for x in terms], weights)
    return _search(hashes, tiles, items, n_documents, n_terms, k)
